"""Cutting many texts into the chunks that a pre-tokenizer's pattern matches the same way by themselves.

The pattern always ends a match before a space that a non-space follows: a run of white space leaves its last space
to the word after it, and no other kind of match goes on over white space. A line end between non-spaces is a match of
its own. Texts whose only white space is single spaces and line ends between words are cut all at once in columns, and
their chunks numbered there, so that what is done per chunk is done per distinct chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split_at_words(text: str) -> list[str]:
    """The chunks of one text: words, each with the space before it, and line ends.

    Where there is other white space, or white space stands beside white space or at an end, only the cut before the last
    space of a run is made.
    """
    words = text.split()
    gaps = len(words) - 1
    # as many spaces and line ends as gaps, and no other character outside words
    if gaps == text.count(" ") + text.count("\n") and len(text) - gaps == sum(map(len, words)) and "\0" not in text:
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    parts = text.split(" ")
    out = [parts[0]] if parts[0] else []
    for p in parts[1:]:
        if not out or p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


#: Bytes that can't stand in a text that is cut in columns: NUL, white space but space and line end, and what begins the
#: code of white space beyond ASCII (C2 85 and C2 A0; E1 9A 80; E2 80 xx and E2 81 9F; E3 80 80).
_ODD = np.zeros(256, bool)
_ODD[[0, 9, 11, 12, 13, 28, 29, 30, 31, 0xE1, 0xE2, 0xE3]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[10, 32]] = True


def _regular(texts: pa.Array) -> np.ndarray:
    """Marks texts, none of them null, that hold no white space but single spaces and line ends between words."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    out = ends[1:] > ends[:-1]
    if not len(data):
        return out
    space = _SPACE[data]
    bad = _ODD[data]
    bad[1:] |= space[1:] & space[:-1]
    bad[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    bad[ends[:-1][out]] |= space[ends[:-1][out]]
    bad[ends[1:][out] - 1] |= space[ends[1:][out] - 1]
    # a text is odd if a bad byte lies in it
    at = np.searchsorted(ends, np.flatnonzero(bad), "right") - 1
    out[at] = False
    return out


def chunked(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(chunks, each at least once; the number of each chunk of all texts in order; how many chunks each text has). Null texts are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    regular = _regular(texts)
    spread = pc.replace_substring(pc.replace_substring(texts.filter(pa.array(regular)), " ", "\0 "), "\n", "\0\n\0")
    parts = pc.split_pattern(spread, "\0")
    coded = parts.flatten().dictionary_encode()
    chunks, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    counts = np.zeros(len(texts), np.int64)
    counts[regular] = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(~regular)
    if len(odd):
        number: dict[str, int] = {}
        own = [[number.setdefault(c, len(chunks) + len(number)) for c in split_at_words(t)] for t in texts.take(pa.array(odd)).to_pylist()]
        counts[odd] = [len(x) for x in own]
        ends = np.cumsum(counts)
        every = np.empty(int(ends[-1]), np.int64)
        mine = np.zeros(len(every), bool)
        for i, x in zip(odd.tolist(), own, strict=True):
            every[ends[i] - len(x) : ends[i]] = x
            mine[ends[i] - len(x) : ends[i]] = True
        every[~mine] = code
        chunks, code = [*chunks, *number], every
    return chunks, code, counts


def gather(ids: list[bytes], code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit ids of all chunks in order, where each text's ids end) from the ids of each distinct chunk, packed."""
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<i4")
    start = np.cumsum(size) - size
    n = size[code]
    total = np.cumsum(n)
    where = np.repeat(start[code] - total + n, n)
    where += np.arange(len(where))
    return flat[where], np.append(0, total)[np.cumsum(counts)]


MARKS = frozenset(".,;:!?")
#: Letters below U+0250, which are letters to every version of Unicode.
_LETTERS = "[a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"


def sorted_out(chunks: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Chunks of letters alone, which are one match; of letters and a mark, which are two; others. A space may come first."""
    column = pa.array(chunks, pa.string())
    alone = pc.match_substring_regex(column, f"^ ?{_LETTERS}$").to_numpy(zero_copy_only=False)
    stems = pc.match_substring_regex(column, f"^ ?{_LETTERS}[.,;:!?]$").to_numpy(zero_copy_only=False)
    return tuple(list(compress(chunks, mask.tolist())) for mask in (alone, stems, ~(alone | stems)))


class Kept:
    """What is known of chunks, up to a bound: when the new ones fill a half, the older half goes."""

    def __init__(self, most: int):
        self.half = max(1, most // 2)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __iter__(self) -> Iterator[str]:
        return iter(self.new | self.old)

    def find(self, chunks: list[str]) -> tuple[list[bytes | None], list[int]]:
        """What is known of each, and which aren't."""
        found = list(map(self.new.get, chunks))
        missing = [i for i, x in enumerate(found) if x is None]
        if self.old:
            get, new = self.old.get, self.new
            for i in missing:
                if (x := get(chunks[i])) is not None:
                    found[i] = new[chunks[i]] = x
            missing = [i for i in missing if found[i] is None]
        return found, missing

    def keep(self, chunks: list[str], ids: list[bytes], longest: int) -> None:
        if max(map(len, chunks), default=0) <= longest:
            self.new.update(zip(chunks, ids, strict=True))
        else:
            self.new.update((c, x) for c, x in zip(chunks, ids, strict=True) if len(c) <= longest)
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}


def encoded(texts: pa.Array, kept: Kept, fresh: Callable[[list[str]], list[bytes]], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit ids of all texts, where each text's ids end); fresh gives the ids of chunks that aren't kept yet."""
    chunks, code, counts = chunked(texts)
    found, missing = kept.find(chunks)
    if missing:
        new = [chunks[i] for i in missing]
        ids = fresh(new)
        for i, x in zip(missing, ids, strict=True):
            found[i] = x
        kept.keep(new, ids, longest)
    return gather(found, code, counts)
