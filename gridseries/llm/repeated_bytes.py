"""Removal of repeated passages, found by sorting suffixes.

A byte goes if a string of `length` bytes that covers it also starts anywhere
else. Every such string contains an anchor: the 64-byte gram with the least hash
among its grams. Two equal strings have the same anchor at the same place, so
only suffixes that begin at anchors need sorting, and only within one gram:

1. Every anchor is sent to its gram with a hash of its surroundings, which are
   all bytes that strings around it can reach. A gram met once is done. Anchors
   whose surroundings are met twice lie in a repeated passage as a whole; blocks
   of texts settle such anchors among themselves before the shuffle.
2. What remains are anchors near the ends of repeated passages, and one of each
   kind of repeated surroundings for them to be compared with. The bytes on both
   sides of those are fetched from the texts and sorted by deep-shallow sorting,
   which gives the lengths to which any two of them agree.
3. A string that reaches `a` bytes to the left of an anchor is repeated if
   another suffix agrees for `a` bytes on the left and for the rest on the right.

Matches are judged on the input. Rows of a gram are streamed, not gathered, in
step 1; a gram with very many different surroundings is resolved in step 3 by
counting (left, right) hashes for each `a` in Spark instead of sorting them in
one task. Texts travel compressed. Surroundings are taken as equal when their
64-bit hashes, and grams when theirs, are.

Cases: a null text is empty; a text shorter than `length` loses nothing;
repeated rows are texts of their own, so each is the other's copy; null ids are
allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.batches import id_and_text, slices
from gridseries.llm.ngram_join import mixed
from gridseries.llm.suffix_sort import deep_shallow
from gridseries.session import materialise

LENGTH = 200
GRAM = 64
SEGMENT = 1 << 19
GATHERED = 1 << 15
PAIRWISE = 48
FACTOR = 0x9E3779B97F4A7C15
POSITION_BITS = np.uint64(24)


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number per byte value, and the powers of the hash's factor and of its inverse."""

    def powers(base: int, n: int) -> np.ndarray:
        out, done, step = np.ones(n, np.uint64), 1, np.uint64(base)
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * step
            step, done = step * step, 2 * done
        return out

    with np.errstate(over="ignore"):
        values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(FACTOR))
        n = 4 * SEGMENT
        return values, powers(FACTOR, n), powers(pow(FACTOR, -1, 1 << 64), n)


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Batches of (text, from, first window, last window): a text's windows cut into segments with margins."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for first in range(0, len(text) - length + 1, SEGMENT):
            last = min(first + SEGMENT, len(text) - length + 1)
            begin, end = max(0, first - length), min(len(text), last + 2 * length)
            if held and size + end - begin > 2 * SEGMENT:
                yield held
                held, size = [], 0
            held.append((i, begin, first, last, end))
            size += end - begin
    if held:
        yield held


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, position, gram hash, hash of the surroundings) of every anchor."""
    values, power, inverse = _tables()
    reach, windows = length - GRAM, length - GRAM + 1
    found = []
    for held in _pieces(texts, length):
        buffer = np.frombuffer(b"".join([texts[i][begin:end] for i, begin, _, _, end in held]), np.uint8)
        starts = np.cumsum([0, *[end - begin for _, begin, _, _, end in held]])
        with np.errstate(over="ignore"):
            sums = np.zeros(len(buffer) + 1, np.uint64)
            np.cumsum(values[buffer] * power[: len(buffer)], out=sums[1:])
            grams = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(buffer) - GRAM + 1])
        keys = grams >> POSITION_BITS << POSITION_BITS | np.arange(len(grams), dtype=np.uint64)
        padded = np.concatenate([keys, np.full(-len(keys) % windows, ~np.uint64(0))]).reshape(-1, windows)
        ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        count = len(keys) - windows + 1
        least = np.minimum(behind[:count], ahead[windows - 1 : windows - 1 + count])
        wanted = np.zeros(count, bool)
        for (_, begin, first, last, _), start in zip(held, starts.tolist(), strict=False):
            wanted[start + first - begin : start + last - begin] = True
        place = np.unique((least[wanted] & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64))
        piece = np.searchsorted(starts, place, side="right") - 1
        table = np.array(held, np.int64)
        text = table[piece, 0]
        position = place - starts[piece] + table[piece, 1]
        sizes = np.array([len(t) for t in texts], np.int64)[text]
        left, right = np.minimum(position, reach), np.minimum(sizes - position, length)
        with np.errstate(over="ignore"):
            around = mixed((sums[place + right] - sums[place - left]) * inverse[place - left])
            around = mixed(around + left.astype(np.uint64) * power[1] + right.astype(np.uint64) * power[2])
        found.append((text, position, grams[place], around))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    text, position, gram, around = (np.concatenate(column) for column in zip(*found, strict=True))
    # Segments of one text share the anchors in their margins.
    _, once = np.unique(np.stack([text, position], axis=1), axis=0, return_index=True)
    return text[once], position[once], gram[once], around[once]


MET = "gram long, around long, id long, key long, position long, reach int, twice int"
NAMES = [field.split()[0] for field in MET.split(", ")]
PASSED = 2


def _met(rows: DataFrame, length: int) -> DataFrame:
    """Anchors on their way to their gram; those a block has settled pass under a number of their own."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [text.encode("utf-8", "surrogatepass") for text in batch.column("text").to_pylist()]
            text, position, gram, around = anchors(texts, length)
            if not len(text):
                continue
            order = np.lexsort((around, gram))
            text, position, gram, around = text[order], position[order], gram[order], around[order]
            same = (gram[1:] == gram[:-1]) & (around[1:] == around[:-1])
            after, before = np.concatenate([[False], same]), np.concatenate([same, [False]])
            key = batch.column("key").to_numpy(zero_copy_only=False)[text]
            with np.errstate(over="ignore"):
                own = mixed(key.view(np.uint64) ^ mixed(position.astype(np.uint64)))
            sizes = np.array([len(t) for t in texts], np.int64)[text]
            left = np.minimum(position, length - GRAM)
            reach = (left << 16 | np.minimum(sizes - position, length)).astype(np.int32)
            columns = [
                pa.array(np.where(after, own, gram).view(np.int64)),
                pa.array(around.view(np.int64)),
                batch.column("id").take(pa.array(text)),
                pa.array(key),
                pa.array(position),
                pa.array(reach),
                pa.array(np.where(after, PASSED, np.where(before, 1, 0)).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, NAMES)

    return rows.mapInArrow(emit, MET)


def _settled(met: DataFrame) -> DataFrame:
    """(id, key, position, reach, gram, known, asked) of anchors of grams met more than once.

    `known`: the surroundings are repeated as a whole. `asked`: the anchor is
    the one of its kind to compare with other surroundings of its gram. Rows are
    streamed in the order of grams and surroundings with one row held back.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, preceded, joined = None, False, False

        def settle(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, bool, bool]:
            gram, around = (table.column(c).to_numpy() for c in ("gram", "around"))
            twice = table.column("twice").to_numpy()
            free = twice == PASSED
            gram_same = (gram[1:] == gram[:-1]) & ~free[1:] & ~free[:-1]
            kind_same = gram_same & (around[1:] == around[:-1])
            other_before = np.concatenate([[preceded], gram_same & ~kind_same])
            new_kind = np.concatenate([[True], ~kind_same])
            begin = np.maximum.accumulate(np.where(new_kind, np.arange(len(gram)), 0))
            has_before = other_before[begin]
            same_after, same_before = np.concatenate([kind_same, [False]]), np.concatenate([[joined], kind_same])
            gram_after = np.concatenate([gram_same, [False]])
            known = (twice > 0) | same_after | same_before
            asked = ~same_after & (has_before | gram_after) & ~free
            upto = len(gram) if last else len(gram) - 1
            keep = np.flatnonzero((known | asked)[:upto])
            out = table.select(["id", "key", "position", "reach", "gram"]).take(pa.array(keep))
            out = out.append_column("known", pa.array(known[keep])).append_column("asked", pa.array(asked[keep]))
            return out, bool(has_before[-1]), bool(same_before[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            out, preceded, joined = settle(table, False)
            yield from out.to_batches()
            held = table.slice(table.num_rows - 1)
        if held is not None:
            yield from settle(held, True)[0].to_batches()

    ordered = met.repartition("gram").sortWithinPartitions("gram", "around")
    schema = "id long, key long, position long, reach int, gram long, known boolean, asked boolean"
    return ordered.mapInArrow(stream, schema)


def _packed(rows: DataFrame) -> DataFrame:
    """Texts compressed, for joins that must move them."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            bodies = [packer.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(bodies, pa.binary())], ["id", "key", "body"])

    return rows.mapInArrow(press, "id long, key long, body binary")


def _same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.withColumnsRenamed({"id": "id_", "key": "key_"})
    return left.join(right, (left["key"] == right["key_"]) & left["id"].eqNullSafe(right["id_"]), how).drop("id_", "key_")


SIDES = "gram long, id long, key long, position long, left binary, right binary"


def _sides(packed: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The bytes on both sides of the grams of `asked`; those on the left backwards."""
    reach = length - GRAM

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in slices(batches, "body"):
            out = []
            for id_, key, body, wanted in zip(*[batch.column(c).to_pylist() for c in ("id", "key", "body", "wanted")], strict=True):
                text = unpacker.decompress(body)
                for entry in wanted:
                    p = entry["position"]
                    left = text[max(0, p - reach) : p][::-1]
                    out.append((entry["gram"], id_, key, p, left, text[p + GRAM : p + length]))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            names = [field.split()[0] for field in SIDES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    wanted = asked.groupBy("id", "key").agg(F.collect_list(F.struct("position", "gram")).alias("wanted"))
    return _same_row(packed, wanted, "inner").mapInArrow(cut, SIDES)


def _reaches(lefts: list[bytes], rights: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest `a` for which some other entry agrees on `a` bytes left and `reach - a` right; -1: none."""
    n = len(lefts)
    low, high = np.full(n, -1), np.full(n, -1)
    ranks, steps = [], []
    for side in (lefts, rights):
        order, shared = deep_shallow(side)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        ranks.append(rank)
        steps.append(np.array(shared))
    if n <= PAIRWISE:
        agree = []
        for rank, step in zip(ranks, steps, strict=True):
            table = np.zeros((n, n), np.int64)
            for i in range(n - 1):
                table[i, i + 1 :] = np.minimum.accumulate(step[i + 1 :])
            table = table + table.T
            agree.append(table[np.ix_(rank, rank)])
        left, right = agree
        good = left + right >= reach
        np.fill_diagonal(good, False)
        some = good.any(axis=1)
        high[some] = np.where(good, left, -1).max(axis=1)[some]
        low[some] = reach - np.where(good, right, -1).max(axis=1)[some]
        return low, high
    sizes = [np.array([len(text) for text in side]) for side in (lefts, rights)]
    for a in range(reach + 1):
        numbers = np.cumsum(steps[0] < a)[ranks[0]] * n + np.cumsum(steps[1] < reach - a)[ranks[1]]
        whole = np.flatnonzero((sizes[0] >= a) & (sizes[1] >= reach - a))
        _, which, count = np.unique(numbers[whole], return_inverse=True, return_counts=True)
        met = whole[count[which] > 1]
        high[met] = a
        low[met] = np.where(low[met] < 0, a, low[met])
    return low, high


SPAN = "id long, key long, first long, until long"


def _resolved(sides: DataFrame, length: int) -> DataFrame:
    """(id, key, first, until): what the suffixes of each gram say, gathered by gram."""
    reach = length - GRAM

    def spans(held: list[tuple]) -> pa.RecordBatch:
        low, high = _reaches([row[4] for row in held], [row[5] for row in held], reach)
        good = np.flatnonzero(high >= 0).tolist()
        first = [held[i][3] - int(high[i]) for i in good]
        until = [held[i][3] - int(low[i]) + length for i in good]
        columns = [[held[i][1] for i in good], [held[i][2] for i in good], first, until]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "key", "first", "until"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if held and row[0] != held[0][0]:
                    yield spans(held)
                    held = []
                held.append(row)
        if held:
            yield spans(held)

    return sides.repartition("gram").sortWithinPartitions("gram").mapInArrow(walk, SPAN)


def _counted(sides: DataFrame, length: int) -> DataFrame:
    """The same for grams with more suffixes than a task should hold: equal (left, right) hashes are counted."""
    reach = length - GRAM
    a = F.col("a")
    levels = sides.select("*", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("a")).filter(
        (F.octet_length("left") >= a) & (F.octet_length("right") >= reach - a)
    )
    pair = F.sha2(F.concat(F.substring("left", F.lit(1), a), F.lit(b"|"), F.substring("right", F.lit(1), reach - a)), 256)
    levels = levels.select("gram", "id", "key", "position", "a", pair.alias("pair"))
    often = levels.groupBy("gram", "a", "pair").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = levels.join(often, ["gram", "a", "pair"], "left_semi")
    ends = met.groupBy("id", "key", "position").agg(F.min("a").alias("low"), F.max("a").alias("high"))
    return ends.select(
        "id", "key", (F.col("position") - F.col("high")).alias("first"), (F.col("position") - F.col("low") + length).alias("until")
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH, gathered: int = GATHERED) -> DataFrame:
    """(id, key, first, until) of repeated stretches of (id, key, text), overlapping ones included."""
    found = materialise(_settled(_met(docs, length)), "anchors")
    left, right = F.shiftright("reach", 16), F.col("reach").bitwiseAND(0xFFFF)
    whole = found.filter("known").select(
        "id", "key", (F.col("position") - left).alias("first"), (F.col("position") + right).alias("until")
    )
    asked = found.filter("asked").select("id", "key", "position", "gram")
    crowded = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > gathered).select("gram")
    crowded = materialise(crowded, "crowded")
    sides = _sides(_packed(docs), asked, length)
    if crowded.isEmpty():
        return whole.unionByName(_resolved(sides, length))
    sides = materialise(sides, "sides")
    few, many = sides.join(crowded, "gram", "left_anti"), sides.join(crowded, "gram", "left_semi")
    return whole.unionByName(_resolved(few, length)).unionByName(_counted(many, length))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = False
) -> DataFrame:
    """One row per document: (id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]).

    `spans` are the maximal removed runs (first, until), `kept` the remaining
    bytes; a character of several bytes may be cut.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("key", F.xxhash64("id", "text"))
    spans = materialise(repeated_spans(rows, length), "spans")
    by_row = spans.groupBy("id", "key").agg(F.collect_set(F.struct("first", "until")).alias("spans"))
    fields = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    fields += ", spans array<struct<first:long,until:long>>, kept binary" * keep_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        kinds = [pa.int64()] * 4 + [pa.string()]
        if keep_text:
            kinds += [pa.list_(pa.struct([("first", pa.int64()), ("until", pa.int64())])), pa.binary()]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(kinds)]
        for batch in slices(batches, "body"):
            out = []
            for id_, body, spans in zip(*[batch.column(c).to_pylist() for c in ("id", "body", "spans")], strict=True):
                text, runs = unpacker.decompress(body), []
                for first, until in sorted((s["first"], s["until"]) for s in spans or []):
                    if runs and first <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], until)
                    else:
                        runs.append([first, until])
                edges = [0, *[edge for run in runs for edge in run], len(text)]
                kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                row = [id_, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()]
                out.append(row + [[{"first": a, "until": b} for a, b in runs], kept] * keep_text)
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    out = _same_row(_packed(rows), by_row, "left").mapInArrow(cut, fields)
    return out.withColumnRenamed("id", id_col)
