"""Token-id files with shuffled planes.

A shard holds whole documents in id order. Its ids are cut into blocks of a fixed number of ids; each block is
transposed into byte planes (all lowest bytes, then all second bytes, ...) or bit planes, every plane is compressed
with zstandard by itself, and a chunk index at the end gives each block's place and the documents' lengths.

Layout, little-endian: b"PLN1", block size u32, plane bits u8 (8 or 1), then the compressed planes; footer: number of
blocks u32, per block and plane the compressed length u32, number of ids u64, number of documents u64, how many of the first
of them have no id u64, per document its id i64 (0 if none) and its number of ids u64; footer length u64, b"1NLP".

Shards are rows of a Parquet table (part, shard, ids, documents, payload), so that Spark's writers and readers carry
them to any store and a lost executor leaves no half-written file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake.llm.chunks import MARKS, Kept, encoded, sorted_out
from findlake.llm.common import id_and_text, map_arrow, new_path, slices

BLOCK = 65_536
#: Bytes of texts that are encoded together, and ids after which a shard ends with what is encoded so far.
STEP_BYTES = 2 << 20
SHARD_IDS = 2_000_000
KEPT_PIECES = 1_000_000
KEPT_LENGTH = 64
SHARDS = "part int, shard int, n_ids long, n_docs long, first_doc long, payload binary"


def planes(block: np.ndarray, bits: int = 8) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, least significant first."""
    rows = np.ascontiguousarray(block, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    out = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(out[:, k], bitorder="little").tobytes() for k in range(32)]


def unplanes(parts: list[bytes], n: int) -> np.ndarray:
    """Ids from 4 byte planes or 32 bit planes."""
    if len(parts) == 4:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    else:
        rows = np.packbits(np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], bits: int = 8, block: int = BLOCK, level: int = 1) -> bytes:
    """One shard; documents without an id come first."""
    unnamed = sum(d is None for d in doc_ids)
    if any(d is None for d in doc_ids[unnamed:]):
        raise ValueError("documents without an id come first")
    doc_ids = [0] * unnamed + doc_ids[unnamed:]
    press = zstandard.ZstdCompressor(level=level)
    body, index = [b"PLN1", struct.pack("<IB", block, bits)], []
    for at in range(0, len(ids), block):
        parts = [press.compress(p) for p in planes(ids[at : at + block], bits)]
        body += parts
        index += [len(p) for p in parts]
    footer = struct.pack("<I", -(-len(ids) // block)) + np.array(index, "<u4").tobytes() + struct.pack("<QQQ", len(ids), len(doc_ids), unnamed) + np.array(doc_ids, "<i8").tobytes() + np.array(lengths, "<u8").tobytes()
    return b"".join([*body, footer, struct.pack("<Q", len(footer)), b"1NLP"])


class Shard:
    """Reads a shard: documents(), or any range of ids by decompressing only the blocks it touches."""

    def __init__(self, data: bytes):
        if data[:4] != b"PLN1" or data[-4:] != b"1NLP":
            raise ValueError("not a shard")
        self.data = memoryview(data)
        self.block, bits = struct.unpack_from("<IB", data, 4)
        self.width = 4 if bits == 8 else 32
        (size,) = struct.unpack_from("<Q", data, len(data) - 12)
        at = len(data) - 12 - size
        (blocks,) = struct.unpack_from("<I", data, at)
        sizes = np.frombuffer(data, "<u4", blocks * self.width, at + 4).astype(np.int64)
        self.starts = 9 + np.concatenate([[0], np.cumsum(sizes)])
        at += 4 + 4 * blocks * self.width
        self.n_ids, n, unnamed = struct.unpack_from("<QQQ", data, at)
        self.doc_ids = [None] * unnamed + np.frombuffer(data, "<i8", n, at + 24)[unnamed:].tolist()
        self.ends = np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u8", n, at + 24 + 8 * n).astype(np.int64))])
        self.unzip = zstandard.ZstdDecompressor()

    def one(self, k: int) -> np.ndarray:
        parts = [self.unzip.decompress(self.data[self.starts[i] : self.starts[i + 1]]) for i in range(k * self.width, (k + 1) * self.width)]
        return unplanes(parts, min(self.block, self.n_ids - k * self.block))

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, "<u4")
        first = start // self.block
        return np.concatenate([self.one(k) for k in range(first, (end - 1) // self.block + 1)])[start - first * self.block : end - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids); each block is decompressed once."""
        have, at, k = np.zeros(0, "<u4"), 0, 0
        for i, doc in enumerate(self.doc_ids):
            start, end = int(self.ends[i]), int(self.ends[i + 1])
            more = [have[start - at :]]
            at = start
            n = len(more[0])
            while at + n < end:
                more.append(self.one(k))
                n, k = n + len(more[-1]), k + 1
            have = np.concatenate(more) if len(more) > 1 else more[0]
            yield doc, start, have[: end - start]


def _byte_alphabet() -> dict[int, str]:
    """The character of a byte-level vocabulary for each byte but the line end: printable ones stand for themselves, the others follow 255 in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest) if b != 10}


BYTES = _byte_alphabet()


class LibraryTokenizer:
    """The tokenizers library over chunks that end where its pre-tokenizer ends a match; what repeats is encoded once.

    The chunks that are new go to the library as the lines of one text, for a call costs more than a word. A line end
    before a chunk is a match by itself, so its token can say where each chunk's ids end. So is a mark after a letter; a chunk that ends so is its stem's ids and the mark's. Chunks of letters alone are one match, so the
    library need not match them: a second instance with the same model splits at white space instead. Everything that is
    learnt stays for the texts to come, up to a bound. A text that holds an added token goes to the library whole, which
    gives that token its own id.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner = Tokenizer.from_file(path)
        self.added = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.line_end = self.inner.encode("\n", add_special_tokens=False).ids
        self.marks = {c: self._alone(c) for c in MARKS}
        # a character of the vocabulary stands for one byte
        self.sizes = np.array([len(self.inner.id_to_token(i) or "") for i in range(self.inner.get_vocab_size())], np.int64)
        self.kept = Kept(KEPT_PIECES)

    def _alone(self, text: str) -> bytes:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks of letters, with a space before them or not; their bytes say where each chunk's ids end."""
        text = "\n".join(chunks)
        if text.isascii():
            lengths, text = list(map(len, chunks)), text.replace(" ", BYTES[32])
        else:
            lengths, text = [len(c.encode()) for c in chunks], text.encode().decode("latin-1").translate(BYTES)
        (found,) = self.plain.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        ends = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(lengths)) + 4).tolist()
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _lines(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that hold no line end and begin with a non-space or with one space and a non-space; line ends are tokens."""
        (found,) = self.inner.encode_batch_fast(["\n".join(chunks)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        ends = np.append(4 * np.flatnonzero(ids == self.line_end[0]), 4 * len(ids)).tolist()
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True)]

    def _fresh(self, new: list[str]) -> list[bytes]:
        """Ids of chunks not known yet."""
        letters, stems, odd = sorted_out(new)
        got, rest = {}, []
        for c in odd:
            if "\n" in c or c.isspace() or c.lstrip(" ")[0].isspace() or c[:2] == "  " or len(self.line_end) != 1:
                got[c] = self._alone(c)
            else:
                rest.append(c)
        more = list({c[:-1] for c in stems}.difference(letters))
        found, missing = self.kept.find(more)
        got.update((c, x) for c, x in zip(more, found, strict=True) if x is not None)
        letters += [more[i] for i in missing]
        for some, ids in ((letters, self._words), (rest, self._lines)):
            for at in range(0, len(some), 8_192):
                part = some[at : at + 8_192]
                got.update(zip(part, ids(part), strict=True))
        got.update([(c, got[c[:-1]] + self.marks[c[-1]]) for c in stems])
        return [got[c] for c in new]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end). Each distinct chunk of the batch is looked up or encoded once."""
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        if not whole.any():
            flat, ends = encoded(texts, self.kept, self._fresh, KEPT_LENGTH)
            return flat.view("<u4"), ends
        flat, ends = encoded(pc.if_else(pa.array(whole), "", texts), self.kept, self._fresh, KEPT_LENGTH)
        rows = [np.frombuffer(self._alone(texts[i].as_py()), "<u4") if w else x.view("<u4") for i, (w, x) in enumerate(zip(whole.tolist(), np.split(flat, ends[:-1]), strict=True))]
        return np.concatenate(rows), np.cumsum([len(x) for x in rows])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        flat, ends = self.encode_array(pa.array(texts, pa.string()))
        return np.split(flat, ends[:-1])


@lru_cache(maxsize=2)
def _library(path: str) -> LibraryTokenizer:
    return LibraryTokenizer(path)


def write_token_files(docs: DataFrame, tokenizer: str, out: str, end_id: int = 0, bits: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends end_id to each and writes shards in ascending id order to the table `out`.

    Parts hold ascending ranges of ids (part 0 the least), shards ascend in a part. Null and empty texts hold end_id
    alone. Rows without an id come first and stay without one; rows that repeat an id lie side by side. An empty table
    gives an empty `out`. Other columns are ignored.
    """
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    rows = id_and_text(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, total = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []

        def close() -> pa.RecordBatch:
            row = [part, number, total, len(names), names[0], pack(np.concatenate(ids), names, sizes, bits)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "shard", "n_ids", "n_docs", "first_doc", "payload"])

        for batch in batches:
            for some in slices([batch], "text", STEP_BYTES):
                flat, ends = _library(tokenizer).encode_array(some.column(1))
                ids.append(np.insert(flat, ends, end_id).astype("<u4"))
                names += some.column(0).to_pylist()
                sizes += (np.diff(ends, prepend=0) + 1).tolist()
                total += len(ids[-1])
                if total >= SHARD_IDS:
                    yield close()
                    ids, names, sizes, total, number = [], [], [], 0, number + 1
        if names:
            yield close()

    map_arrow(rows, shard, SHARDS).write.mode("overwrite").parquet(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document in the files: doc_id, part, shard, offset (in its shard), n_tokens, ids_crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "part", "shard", "offset", "n_tokens", "ids_crc32"]
        for batch in batches:
            for part, number, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = [(doc, part, number, start, len(ids), zlib.crc32(ids.tobytes())) for doc, start, ids in Shard(payload).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("part", "shard") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    shards = spark.read.schema(SHARDS).parquet(path).select("part", "shard", "payload")
    return map_arrow(shards, documents, "doc_id long, part int, shard int, offset long, n_tokens long, ids_crc32 long")


def positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files."""
    index = spark.read.schema(SHARDS).parquet(path).select("part", "shard", "n_ids")
    # sums over parts first, one small row a task of the writer, then over the shards of each part
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    index = index.withColumn("before", within).join(parts, "part").select("part", "shard", (F.col("first") + F.col("before")).alias("base"))
    docs = read_token_files(spark, path).join(index, ["part", "shard"])
    return docs.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the files to a fresh path in the shared folder and gives positions() of them."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer, path, **options)
    return positions(docs.sparkSession, path)
