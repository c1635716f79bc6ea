"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

A leaf of the tree holds, for the live part that begins at its byte, the rank of the token that this part and the next
live part would make; the root is the leftmost least rank. A merge touches three leaves: the merged part, its right
neighbour, which dies, and its left neighbour; each is one walk to the root. Matches of the pre-tokenizer's pattern
are encoded separately. The short ones that are new in a batch of texts go through their trees side by side, as the rows of
one array, a merge each at a time; the worker keeps what it has encoded, because words repeat.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.chunks import MARKS, Kept, encoded, sorted_out
from findlake.llm.common import map_arrow, slices

#: Pieces a worker keeps; the older ones go when it is full, which costs time and changes nothing else.
KEPT_PIECES = 400_000
#: Pieces longer than this are encoded by themselves and not kept.
KEPT_LENGTH = 64
#: Bytes of texts that are encoded together.
STEP_BYTES = 2 << 20
#: Rows of one array of trees.
ROWS = 20_000
DEAD = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class ByteBPE:
    """encode(text) and decode(ids) for one rank file and one pre-tokenizer pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pairs = {}  # both halves of a token, wherever it can be cut into two tokens
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.table = self._table()
        self.findall = regex.compile(pattern).findall
        self.kept = Kept(KEPT_PIECES)  # ids as native 32-bit integers
        most = max(self.tokens) + 1
        self.known, self.sizes = np.zeros(most, bool), np.zeros(most, np.int64)
        for rank, token in self.tokens.items():
            self.known[rank], self.sizes[rank] = True, len(token)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.tokens[r] for r in sorted(self.tokens)), np.uint8)

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        n, pair = len(data), self.pairs.get
        ids = [self.single[b] for b in data]
        if n == 1:
            return (ids[0],)
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [DEAD] * (2 * size)
        for i in range(n - 1):
            if (r := pair(ids[i] << 32 | ids[i + 1])) is not None:
                tree[size + i] = r << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := tree[1]) != DEAD:
            i = least & 0xFFFFFFFF
            j = after[i]
            k, h = after[j], before[i]
            token = ids[i] = least >> 32
            ids[j], after[i] = -1, k
            here = there = None
            if k < n:
                before[k] = i
                here = pair(token << 32 | ids[k])
            if h >= 0:
                there = pair(ids[h] << 32 | token)
            for leaf, value in ((i, DEAD if here is None else here << 32 | i), (j, DEAD), (h, DEAD if there is None else there << 32 | h)):
                at = size + leaf
                if 0 <= leaf < n - 1 and tree[at] != value:
                    tree[at] = value
                    while at > 1:
                        other = tree[at ^ 1]
                        if other < value:
                            value = other
                        at >>= 1
                        if tree[at] == value:
                            break
                        tree[at] = value
        return tuple(x for x in ids if x >= 0)

    def _table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The pairs as an open-addressed hash table: keys, ranks and the shift of the hash."""
        bits = max(4, (4 * len(self.pairs)).bit_length())
        keys, ranks = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        key, rank = np.array(list(self.pairs), np.int64), np.array(list(self.pairs.values()), np.int64)
        at = _slot(key, 64 - bits)
        while len(key):
            free = keys[at] < 0
            keys[at[free]] = key[free]  # of several that want a slot the last has it
            won = keys[at] == key
            ranks[at[won]] = rank[won]
            key, rank, at = key[~won], rank[~won], at[~won] + 1 & (1 << bits) - 1
        return keys, ranks, 64 - bits

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each two tokens make, -1 if none."""
        keys, ranks, shift = self.table
        key = a << 32 | b
        at = _slot(key, shift)
        seen = keys[at]
        out = np.where(seen == key, ranks[at], -1)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & len(keys) - 1
            seen = keys[at[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = ranks[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def side_by_side(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids of pieces of 2 to size + 1 bytes; size is a power of two, the leaves of each tree."""
        m, width, wide = len(pieces), 2 * size + 2, size + 2
        lengths = np.array([len(p) for p in pieces])
        ids = np.full((m, wide), -1, np.int64)
        inside = np.arange(wide)[None, :] < lengths[:, None]
        ids[inside] = np.array(self.single, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, wide + 1), (m, 1))
        before = np.tile(np.arange(-1, wide - 1), (m, 1))
        tree = np.full((m, width), DEAD, np.int64)
        row, place = np.nonzero(inside[:, 1:])
        rank = self._pair(ids[row, place], ids[row, place + 1])
        live = rank >= 0
        tree[row[live], size + place[live]] = rank[live] << 8 | place[live]
        level = size
        while level > 1:
            level >>= 1
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        ids, after, before, tree = (x.reshape(-1) for x in (ids, after, before, tree))
        row = np.arange(m)
        root = tree[1 + row * width]
        row, root = row[root < DEAD], root[root < DEAD]
        while len(row):
            base, low, n = row * wide, row * width, lengths[row]
            i, token = root & 255, root >> 8
            j = after[base + i]
            k, h = after[base + j], before[base + i]
            ids[base + i], ids[base + j], after[base + i] = token, -1, k
            before[base + np.minimum(k, wide - 1)] = i
            here = self._pair(token, np.maximum(ids[base + np.minimum(k, wide - 1)], 0))
            there = self._pair(np.maximum(ids[base + np.maximum(h, 0)], 0), token)
            tree[low + size + i] = np.where((k < n) & (here >= 0), here << 8 | i, DEAD)
            tree[low + size + j] = DEAD
            left = np.where(h >= 0, h, i)
            tree[low + size + left] = np.where(h >= 0, np.where(there >= 0, there << 8 | h, DEAD), tree[low + size + left])
            for leaf in (i, np.minimum(j, size - 1), left):
                at = size + leaf
                for _ in range(size.bit_length() - 1):
                    at >>= 1
                    tree[low + at] = np.minimum(tree[low + 2 * at], tree[low + 2 * at + 1])
            root = tree[low + 1]
            row, root = row[root < DEAD], root[root < DEAD]
        flat = ids[ids >= 0].astype(np.int32).tobytes()
        ends = 4 * np.cumsum((ids.reshape(m, wide) >= 0).sum(axis=1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def pieces(self, new: list[str]) -> list[bytes]:
        """Ids of each of some matches of the pattern."""
        data = [p.encode() for p in new]
        found = list(map(self.ranks.get, data))
        out = [None if r is None else r.to_bytes(4, "little") for r in found]
        rest = [i for i, r in enumerate(found) if r is None]
        sizes = np.array([len(data[i]) for i in rest], np.int64)
        size = 1
        while size < KEPT_LENGTH:  # trees of one size side by side
            fits = np.flatnonzero((sizes > size // 2 + 1) & (sizes <= size + 1) if size > 1 else sizes == 2)
            for at in range(0, len(fits), ROWS):
                part = [rest[i] for i in fits[at : at + ROWS].tolist()]
                for i, ids in zip(part, self.side_by_side([data[i] for i in part], size), strict=True):
                    out[i] = ids
            size *= 2
        return [array("i", self.piece(d)).tobytes() if ids is None else ids for ids, d in zip(out, data, strict=True)]

    def _fresh(self, new: list[str]) -> list[bytes]:
        """Ids of chunks not known yet. A chunk of letters is one match, one of letters and a mark is two; others are matched out."""
        plain, stems, odd = sorted_out(new)
        matched = [self.findall(c) for c in odd]
        more = list({c[:-1] for c in stems}.union(*matched, MARKS if stems else ()).difference(plain))
        found, missing = self.kept.find(more)
        got = {c: x for c, x in zip(more, found, strict=True) if x is not None}
        plain += [more[i] for i in missing]
        got.update(zip(plain, self.pieces(plain), strict=True))
        got.update([(c, got[c[:-1]] + got[c[-1]]) for c in stems])
        got.update([(c, b"".join([got[m] for m in ms])) for c, ms in zip(odd, matched, strict=True)])
        return [got[c] for c in new]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end). Each distinct chunk of the batch is looked up or encoded once."""
        return encoded(texts, self.kept, self._fresh, KEPT_LENGTH)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        flat, ends = self.encode_array(pa.array(texts, pa.string()))
        return np.split(flat, ends[:-1])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, where the bytes of each id end)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.known[ids].all()):
            raise KeyError("an id that no token has")
        n = self.sizes[ids]
        ends = np.cumsum(n)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        for at in range(0, len(ids), 1 << 17):
            some = slice(at, at + (1 << 17))
            where = np.repeat(self.starts[ids[some]] - ends[some] + n[some], n[some])
            first = int(ends[at] - n[at])
            where += np.arange(first, first + len(where))
            out[first : first + len(where)] = self.bytes[where]
        return out, ends

    def decode(self, ids) -> bytes:
        return self.decode_flat(np.asarray(ids, np.int64))[0].tobytes()


def _slot(key: np.ndarray, shift: int) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(shift)).astype(np.int64)


@lru_cache(maxsize=4)
def _codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def _ids(codec: ByteBPE, texts: pa.Array) -> pa.Array:
    flat, ends = codec.encode_array(texts)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))


def _bytes(codec: ByteBPE, ids: pa.Array) -> pa.Array:
    """Null ids give no bytes, like no ids."""
    flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
    data, at = codec.decode_flat(flat)
    offsets = np.append(0, np.append(0, at)[ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _mapped(df: DataFrame, drop: set[str], new: list[tuple[str, T.DataType]], size_of: str, arrow: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """df without some columns and with new ones, computed from batches of a few MB of the column size_of."""
    names = [n for n, _ in new]
    kept = [f for f in df.schema.fields if f.name not in drop and f.name not in names]
    schema = T.StructType([*kept, *(T.StructField(n, kind) for n, kind in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], size_of, STEP_BYTES):
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in kept), *arrow(part)], [*(f.name for f in kept), *names])

    return map_arrow(df, run, schema)


IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with an array of token ids of each whole text. Null and empty texts have no ids; a column named like ids_col is replaced."""
    return _mapped(df, set(), [(ids_col, IDS)], text_col, lambda part: [_ids(_codec(path, pattern), part.column(part.schema.get_field_index(text_col)))])


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the bytes of each row's ids; no ids (or null) give no bytes. An unknown id is an error."""
    return _mapped(df, set(), [(bytes_col, T.BinaryType())], ids_col, lambda part: [_bytes(_codec(path, pattern), part.column(part.schema.get_field_index(ids_col)))])


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """df without its text, with ids and decoded: encode and decode in one worker, which holds one codec."""

    def both(part: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(path, pattern)
        ids = _ids(codec, part.column(part.schema.get_field_index(text_col)))
        return [ids, _bytes(codec, ids)]

    return _mapped(df, {text_col}, [("ids", IDS), ("decoded", T.BinaryType())], text_col, both)


def digest(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from the columns ids and decoded, and the columns that more names."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)
