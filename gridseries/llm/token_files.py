"""Token files: concatenated ids with Elias-Fano coded document boundaries.

Documents are range-partitioned by id, encoded, and cut into blocks. A block is
one binary record: a header, the document ids, the Elias-Fano coded ends of the
documents, and all ids as 16- or 32-bit integers. The ends take about
2 + log2(ids per document) bits each; a directory of ones makes each of them
readable on its own. Records are written through Spark's own file committer, so
that a lost executor leaves no half-written block and any file system works.

Cases: a null text is empty and still gets its end id; null document ids come
last; repeated ids are documents of their own, in the order of their texts; an
empty table gives no block; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridseries.llm.batches import id_and_text, slices
from gridseries.llm.byte_tokens import VOCABULARY, byte_tokens

MAGIC = b"EFT1"
HEADER = struct.Struct("<4sBBQQ")
BLOCK_IDS = 1 << 20
DIRECTORY_BITS = 512


class EliasFano:
    """A rising sequence: low bits packed, high bits as gaps in unary, a directory for `select`."""

    def __init__(self, low_bits: int, count: int, low: bytes, high: bytes, directory: np.ndarray):
        self.low_bits, self.count, self.low, self.high, self.directory = low_bits, count, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        count = len(values)
        span = int(values[-1]) if count else 0
        low_bits = max(0, (span // count).bit_length() - 1) if count else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        ones = np.zeros((span >> low_bits) + count + 1, np.uint8)
        ones[places] = 1
        directory = np.searchsorted(places, np.arange(0, len(ones), DIRECTORY_BITS)).astype("<u4")
        return cls(low_bits, count, low, np.packbits(ones, bitorder="little").tobytes(), directory)

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values at the given positions; reads only the directory's parts that hold them."""
        index = np.asarray(index, np.int64)
        if not len(index):
            return np.zeros(0, np.int64)
        part = np.searchsorted(self.directory, index, side="right") - 1
        parts, which = np.unique(part, return_inverse=True)
        step = DIRECTORY_BITS // 8
        padded = np.zeros((len(parts), step), np.uint8)
        for row, p in enumerate(parts.tolist()):
            some = np.frombuffer(self.high, np.uint8)[p * step : (p + 1) * step]
            padded[row, : len(some)] = some
        bits = np.unpackbits(padded, axis=1, bitorder="little")
        row, column = np.nonzero(bits)
        first = np.searchsorted(row, np.arange(len(parts)))
        place = column[first[which] + index - self.directory[part]] + part * DIRECTORY_BITS
        high = (place - index) << self.low_bits
        if not self.low_bits:
            return high
        at = index[:, None] * self.low_bits + np.arange(self.low_bits)
        stored = np.frombuffer(self.low, np.uint8)
        low = (stored[at >> 3] >> (at & 7)) & 1
        return high + (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def dump(self) -> bytes:
        sizes = struct.pack("<BQQQQ", self.low_bits, self.count, len(self.low), len(self.high), len(self.directory))
        return sizes + self.low + self.high + self.directory.tobytes()

    @classmethod
    def load(cls, body: memoryview) -> tuple[EliasFano, int]:
        """The structure at the start of `body`, and how many bytes it takes."""
        low_bits, count, low, high, entries = struct.unpack_from("<BQQQQ", body)
        at = struct.calcsize("<BQQQQ")
        directory = np.frombuffer(body, "<u4", entries, at + low + high)
        parts = cls(low_bits, count, bytes(body[at : at + low]), bytes(body[at + low : at + low + high]), directory)
        return parts, at + low + high + 4 * entries


def dump_block(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    known = np.packbits(np.array([i is not None for i in doc_ids], np.uint8)).tobytes()
    numbers = np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes()
    head = HEADER.pack(MAGIC, 1, width, len(doc_ids), len(ids))
    return head + known + numbers + EliasFano.of(ends).dump() + ids.astype(f"<u{width}").tobytes()


def load_block(body: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ends of the documents, and token ids of a block."""
    magic, version, width, n_docs, n_ids = HEADER.unpack_from(body)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token block")
    view, at = memoryview(body), HEADER.size
    known = np.unpackbits(np.frombuffer(view, np.uint8, -(-n_docs // 8), at))[:n_docs]
    at += -(-n_docs // 8)
    numbers = np.frombuffer(view, "<i8", n_docs, at).tolist()
    at += 8 * n_docs
    ends, size = EliasFano.load(view[at:])
    ids = np.frombuffer(view, f"<u{width}", n_ids, at + size)
    doc_ids = [n if k else None for n, k in zip(numbers, known.tolist(), strict=True)]
    return doc_ids, ends.select(np.arange(n_docs)), ids


def write_token_files(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end_id: int = 0,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode all texts and write them to `folder` in ascending id order, blocks of about `block_ids` ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(vocabulary)
        part, block = TaskContext.get().partitionId(), 0
        doc_ids, sizes, held, n_held = [], [], [], 0

        def record():
            body = dump_block(doc_ids, np.cumsum(sizes), np.concatenate(held))
            columns = [[part], [block], [len(doc_ids)], [n_held], [body]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                ["part", "block", "n_docs", "n_ids", "body"],
            )

        for batch in slices(batches):
            ids, counts = tokens.encode(batch.column("text").to_pylist())
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, np.uint32(end_id))
            doc_ids += batch.column("id").to_pylist()
            sizes += (counts + 1).tolist()
            held.append(ids)
            n_held += len(ids)
            if n_held >= block_ids:
                yield record()
                block += 1
                doc_ids, sizes, held, n_held = [], [], [], 0
        if doc_ids:
            yield record()

    rows = id_and_text(docs, id_col, text_col)
    ordered = rows.repartitionByRange(F.asc_nulls_last("id")).sortWithinPartitions(F.asc_nulls_last("id"), "text")
    blocks = ordered.mapInArrow(pack, "part int, block int, n_docs long, n_ids long, body binary")
    blocks.write.option("compression", "zstd").parquet(folder)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a folder: (doc_id, start, n_tokens, ids_crc32[, ids]).

    `start` counts the ids of all documents before it. `ids`, on request, are
    the ids as little-endian unsigned 32-bit integers.
    """
    files = spark.read.schema("part int, block int, n_docs long, n_ids long, body binary").parquet(folder)
    index = files.select("part", "block", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start")
    )
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = index.join(parts, "part").select(
        "part", "block", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("block_start")
    )
    fields = "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [field.split()[0] for field in fields.split(", ")]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, block, body = (batch.column(name)[row].as_py() for name in ("part", "block", "body"))
                doc_ids, ends, ids = load_block(body)
                starts = np.concatenate([[0], ends[:-1]])
                wide = ids.astype("<u4")
                texts = [wide[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                columns = [
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.full(n, block, np.int32)),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(starts.astype(np.int64)),
                    pa.array((ends - starts).astype(np.int64)),
                    pa.array([zlib.crc32(text) for text in texts], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(texts, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    read = files.select("part", "block", "body").mapInArrow(unpack, fields)
    out = read.join(offsets, ["part", "block"]).withColumn("start", F.col("block_start") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
