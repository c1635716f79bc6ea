"""Blocks of windows stay under what one index can order."""

from __future__ import annotations

import numpy as np
import pytest

from findlake.llm import repeats


def test_a_block_ends_before_an_anchor_that_would_pass_the_limit():
    sizes = {1: 1_300, 2: 2_000, 3: 2_000, 4: 5, 5: 5}
    rows = [(k, k, k, anchor, 1, b"x" * 768, m) for anchor, m in sizes.items() for k in range(m)]
    found = list(repeats.blocks(rows))
    assert [r for block in found for r in block] == rows
    assert all(sum(len(r[5]) + 1 for r in block) < 1 << 21 for block in found)
    assert [sorted({r[3] for r in block}) for block in found] == [[1], [2], [3], [4, 5]]


def test_too_many_symbols_are_an_error():
    with pytest.raises(ValueError, match="symbols"):
        repeats.suffix_order(np.ones(1 << 21, np.int64))
