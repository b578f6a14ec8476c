"""Packing token pieces into sequences by fitting length patterns to the histogram.

All patterns of at most three lengths that fill a sequence exactly are listed;
non-negative least squares says how often each should be used; the repeats are
rounded and refined, and what they leave over is packed by best fit. All of that works on
the histogram of lengths, whose size is the sequence length and does not grow
with the corpus. Spark encodes the documents, counts the lengths and hands every
piece its place, by its rank among the pieces of its length.

Cases: a null or empty text is the end id alone; null ids and repeated rows are
documents of their own; texts of any length are cut into full pieces, the first
one shorter; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseries.llm.batches import id_and_text, slices
from gridseries.llm.byte_tokens import VOCABULARY, byte_tokens
from gridseries.session import materialise

CAPACITY = 1024
END_ID = 2
FIT_TURNS = 1000
SHARES = (64, 48, 32, 24, 16, 12, 8, 6, 5, 4, 3, 2)


def full_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three rising lengths, 0 for none, out of `lengths`, that add up to `capacity`."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[0] = True
    found = []
    for a in np.flatnonzero(have[: capacity // 3 + 1]).tolist():
        b = np.arange(a, (capacity - a) // 2 + 1)
        c = capacity - a - b
        good = have[b] & have[c]
        found.append(np.stack([np.full(good.sum(), a), b[good], c[good]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, turns: int = FIT_TURNS) -> np.ndarray:
    """Non-negative least squares of the histogram by multiplicative steps, which keep every repeat >= 0."""
    flat = patterns.reshape(-1)
    target = counts.astype(float)
    target[0] = 0
    pull = target[patterns].sum(axis=1)
    repeats = pull / max(pull.sum(), 1) * target.sum()
    for _ in range(turns):
        used = np.bincount(flat, np.repeat(repeats, 3), len(counts))
        used[0] = 0
        push = used[patterns].sum(axis=1)
        repeats = repeats * pull / np.maximum(push, 1e-12)
    return repeats


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths, number of sequences filled alike)."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    spaces: list[int] = []

    def put(space, lengths, n):
        if not room[space]:
            bisect.insort(spaces, space)
        room[space].append((lengths, n))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                lengths, n = room[space].pop()
                if not room[space]:
                    spaces.pop(at)
                used = min(n, left)
                if used < n:
                    put(space, lengths, n - used)
                put(space - length, (*lengths, length), used)
                left -= used
            else:
                each = min(capacity // length, left)
                put(capacity - each * length, (length,) * each, left // each)
                left %= each
    return [entry for space in spaces for entry in room[space]]


def _sequences(plan: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(times for _, times in plan)


def refine(plan: list, left: np.ndarray, capacity: int) -> tuple[list, np.ndarray]:
    """Takes shares of the pattern repeats back where best fit of what is left then needs fewer sequences.

    Shares grow (`SHARES`) up to a half of the repeats there are; each that saves a sequence is given up, so
    that no more patterns go than sequences are saved by.
    """
    everything = int((left * np.arange(len(left))).sum()) + capacity * _sequences(plan)
    least = -(-everything // capacity)
    best = _sequences(plan) + _sequences(best_fit(left, capacity))
    for shares in SHARES:
        for share in range(shares):
            if best <= least:
                return plan, left
            kept = [entry for k, entry in enumerate(plan) if k % shares != share]
            back = left.copy()
            for lengths, times in plan[share::shares]:
                for x in lengths:
                    back[x] += times
            now = _sequences(kept) + _sequences(best_fit(back, capacity))
            if now < best:
                best, plan, left = now, kept, back
    return plan, left


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use every piece of the histogram `counts` (by length) exactly once.

    Fitted patterns whose repeats are rounded and refined, then best fit for the residual pieces.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    patterns = full_patterns(np.flatnonzero(left), capacity)
    plan = []
    if len(patterns):
        passed = np.floor(np.cumsum(fit_repeats(patterns, left)) + 0.5).astype(np.int64)
        whole = np.diff(passed, prepend=0)
        for row in np.argsort(-whole, kind="stable")[: int((whole > 0).sum())].tolist():
            lengths = tuple(x for x in patterns[row].tolist() if x)
            times = min([int(whole[row]), *(int(left[x]) // lengths.count(x) for x in lengths)])
            if times:
                for x in lengths:
                    left[x] -= times
                plan.append((lengths, times))
    plan, left = refine(plan, left, capacity)
    return plan + best_fit(left, capacity)


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Length -> first rank, first sequence and offset of each run of pieces placed alike."""
    runs, taken, sequence = defaultdict(list), defaultdict(int), 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            runs[length].append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {length: tuple(np.array(rows, np.int64).T) for length, rows in runs.items()}


def cut_pieces(
    docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, capacity: int, keep_ids: bool
) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its task (`part`)."""
    fields = "id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * keep_ids
    names = [field.split()[0] for field in fields.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(vocabulary)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            ids, counts = tokens.encode(batch.column("text").to_pylist())
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype("<u4")
            counts = counts + 1
            pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = counts - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            begin = np.concatenate([[0], np.cumsum(length)])
            body = memoryview(ids).cast("B")
            spans = [body[4 * a : 4 * b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            kinds, firsts, sizes = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(firsts - seen[kinds], sizes)
            seen[kinds] += sizes
            columns = [
                batch.column("id").take(pa.array(doc)),
                pa.array(piece.astype(np.int32)),
                pa.array(start.astype(np.int64)),
                pa.array(length.astype(np.int64)),
                pa.array([zlib.crc32(span) for span in spans], pa.int64()),
                pa.array(np.full(len(doc), part, np.int32)),
                pa.array(rank),
            ]
            if keep_ids:
                columns.append(pa.array([bytes(span) for span in spans], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return id_and_text(docs, id_col, text_col).mapInArrow(cut, fields)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset[, ids])."""
    pieces = materialise(cut_pieces(docs, id_col, text_col, vocabulary, end_id, capacity, keep_ids), "token_pieces")
    sizes = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    places = _places(plan_packing(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(earlier, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("earlier")).drop("earlier", "part")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for kind in np.unique(length).tolist():
                firsts, sequences, offsets = places[kind]
                mine = np.flatnonzero(length == kind)
                run = np.searchsorted(firsts, rank[mine], side="right") - 1
                sequence[mine] = sequences[run] + rank[mine] - firsts[run]
                offset[mine] = offsets[run]
            kept = [name for name in batch.schema.names if name != "rank"]
            columns = [batch.column(name) for name in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "sequence_id long, offset long"])
    out = ranked.mapInArrow(place, schema)
    wanted = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids]
    return out.select(F.col("id").alias(id_col), *wanted)
