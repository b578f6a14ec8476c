"""Similarity join of texts on word n-grams, and the groups it links.

A text is the set of its n-grams, each a 57-bit number. Two texts link when
100 * shared >= percent * all of their n-grams.

1. Order. N-grams that only one set holds cannot be shared, so only the others
   count. Blocks of sets send their distinct n-grams to buckets; a bucket answers
   those it has met more than once, each with the logarithm of how often. Rare n-grams come
   first in the global order, equally rare ones by number. A set that keeps too
   few n-grams to link with anything is done; the others keep what they share
   with anyone, beside their full size.
2. Prefixes. Sets that link have one of their first n-grams in common, so many
   that the rest alone could not reach the overlap needed. Sets that meet in such an n-gram are
   tied into candidate clusters; equal sets count once.
3. Trie. The ordered sets of a cluster are stored in a trie. Each set descends
   it, sharing the overlap with common beginnings, and leaves a branch when the
   n-grams that remain cannot reach the overlap needed any more.
4. Large clusters are never gathered: their sets meet a few pivots first. What
   the largest group so found does not hold is a query set; tries of its blocks
   are sent to all sets of the cluster.

N-grams that occur more than once in a block are sent once, so that a frequent
one costs a bucket a row per block. The number of buckets grows with the input, so
a bucket has a bounded size. Distinct n-grams are taken as equal when their
numbers are.

Cases: a null or blank text has an empty set, links with nothing and is its own
group; a text shorter than n words has one n-gram, its whole sequence; a row
with a null id gets its n-gram count and a null group and takes part in no link;
rows that repeat an id with other texts share the least group of them; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.batches import id_and_text, slices
from gridseries.llm.components import components
from gridseries.session import materialise

WORDS = 3
PERCENT = 90
BUCKET_TEXT_BYTES = 16 << 20
BLOCK_NGRAMS = 1 << 20
BLOCK_SETS = 50_000
BLOCK_SIGNATURES = 1 << 20
CLUSTER_SETS = 128
CLUSTER_NGRAMS = 1 << 22
PORTION_SETS = 512
NUMBER_BITS = 57  # of an n-gram; how often it occurs is kept above them
SEVERAL = 0xFFFF  # in place of a set: more than one set of the block

ODD = np.uint64(0x9E3779B97F4A7C15)
PREFIX, PAIR = (np.uint64(x) for x in (0xEB44ACCAB455D165, 0x8CB92BA72F3D8DD7))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte (0 for ASCII white space), and whether it is white space."""
    white = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
    return np.where(white, np.uint64(0), mixed(np.arange(1, 257, dtype=np.uint64) * ODD)), white


def word_numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of the texts one after the other, and the number of words of each text.

    Words are split at ASCII white space, with A-Z in lower case; a word's
    number is a polynomial in its bytes.
    """
    values, white = _byte_values()
    bodies = [text.encode("utf-8", "surrogatepass").lower() for text in texts]
    buffer = np.frombuffer(b"\n".join([b"", *bodies, b""]), np.uint8)
    blank = white[buffer]
    begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.cumsum([len(body) + 1 for body in bodies])
    counts = np.diff(np.searchsorted(begin, np.concatenate([[0], ends])))
    if not len(begin):
        return np.zeros(0, np.uint64), counts
    sizes = np.diff(begin, append=len(buffer))
    place = np.arange(len(buffer) - begin[0]) - np.repeat(begin - begin[0], sizes)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(sizes.max()), ODD, np.uint64))
        sums = np.add.reduceat(values[buffer[begin[0] :]] * powers[place], begin - begin[0])
        return mixed(sums), counts


def ngram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The n-gram numbers of each text, ascending."""

    def ordered(numbers: np.ndarray) -> np.ndarray:
        return np.unique(numbers >> np.uint64(64 - NUMBER_BITS))

    flat, counts = word_numbers(texts)
    sizes = counts.tolist()
    whole = np.zeros(max(len(flat) - n + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        factors = [mixed(np.uint64(k + 1)) | np.uint64(1) for k in range(n)]
        for k in range(n):
            whole += flat[k : k + len(whole)] * factors[k]
        whole = mixed(whole)
        out, at = [], 0
        for size in sizes:
            if size >= n:
                out.append(ordered(whole[at : at + size - n + 1]))
            elif size:
                short = flat[at : at + size] * np.array(factors[:size])
                out.append(ordered(mixed(short.sum(dtype=np.uint64, keepdims=True) + np.uint64(size) * ODD)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += size
    return out


def set_keys(ngrams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set; the first names it among candidates, both together name it for good."""
    with np.errstate(over="ignore"):
        spread = mixed(ngrams + ODD)
        first = mixed(spread.sum(dtype=np.uint64) + np.uint64(len(ngrams)))
        second = mixed(mixed(spread ^ PAIR).sum(dtype=np.uint64))
    return int(first.view(np.int64)), int(second.view(np.int64))


def needed(x: int, y: int, percent: int) -> int:
    """Least overlap with which sets of these sizes link."""
    return -(-percent * (x + y) // (100 + percent))


def least_overlap(size: int, percent: int) -> int:
    """So many n-grams a set of this size shares with any set it links with."""
    return -(-size * percent // 100)


def prefix(ngrams: int, size: int, percent: int) -> int:
    """So many first of the n-grams that a set keeps; linked sets have one of them in common."""
    return ngrams - least_overlap(size, percent) + 1


class Trie:
    """Ordered sets by their common beginnings.

    `sizes` are the full sizes of the sets, of which `sets` hold the n-grams that
    others have as well. A node is (n-grams, depth, sets ending here, children,
    least full size, greatest length, first and last place in sorted order). An
    index of the sets' prefixes tells which branches are worth entering.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int], percent: int):
        self.sets, self.sizes, self.percent = sets, sizes, percent
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.starts: dict[int, list[int]] = {}
        for place, i in enumerate(self.order):
            for ngram in sets[i][: prefix(len(sets[i]), sizes[i], percent)].tolist():
                self.starts.setdefault(ngram, []).append(place)
        self.roots = self._build(self.order, 0)

    def _build(self, order: list[int], depth: int) -> list[tuple]:
        """Nodes for sets in order that agree up to `depth`."""
        nodes: list[tuple] = []
        todo = [(order, depth, 0, nodes)]
        while todo:
            members, depth, place, out = todo.pop()
            at = 0
            while at < len(members):
                first = self.sets[members[at]]
                until = at + 1
                while until < len(members) and self.sets[members[until]][depth] == first[depth]:
                    until += 1
                last = self.sets[members[until - 1]]
                short = min(len(first), len(last))
                differs = np.flatnonzero(first[depth:short] != last[depth:short])
                end = depth + int(differs[0]) if len(differs) else short
                ending = [i for i in members[at:until] if len(self.sets[i]) == end]
                longer = [i for i in members[at:until] if len(self.sets[i]) > end]
                least = min(self.sizes[i] for i in members[at:until])
                most = max(len(self.sets[i]) for i in members[at:until])
                children: list[tuple] = []
                out.append((first[depth:end], depth, ending, children, least, most, place + at, place + until))
                if longer:
                    todo.append((longer, end, place + at + len(ending), children))
                at = until
        return nodes

    def linked(self, probe: np.ndarray, size: int, skip=lambda i: False) -> list[int]:
        """Places of the sets that link with `probe` of full size `size`, without those that `skip` names."""
        percent, length = self.percent, len(probe)
        places = {p for ngram in probe[: prefix(length, size, percent)].tolist() for p in self.starts.get(ngram, ())}

        def fits(i: int) -> bool:
            return 100 * min(size, self.sizes[i]) >= percent * max(size, self.sizes[i]) and not skip(i)

        places = sorted(p for p in places if fits(self.order[p]))
        found, todo = [], [(node, 0) for node in self.roots] if places else []
        while todo:
            (ngrams, depth, ending, children, least, most, first, last), shared = todo.pop()
            if bisect.bisect_left(places, first) == bisect.bisect_left(places, last):
                continue
            end = depth + len(ngrams)
            if len(ngrams):
                at = np.minimum(np.searchsorted(probe, ngrams), length - 1)
                shared += int((probe[at] == ngrams).sum())
                rest = length - int(np.searchsorted(probe, ngrams[-1], side="right"))
            else:
                rest = length
            found += [i for i in ending if shared >= needed(size, self.sizes[i], percent) and not skip(i)]
            if children and shared + min(rest, most - end) >= needed(size, least, percent):
                todo += [(child, shared) for child in children]
        return found


class Groups:
    """Union-find over a few positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.parent[max(a, b)] = min(a, b)


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as gaps, byte planes one after the other, compressed."""
    gaps = np.diff(numbers, prepend=np.uint64(0)).astype("<u8")
    planes = -(-int(gaps.max()).bit_length() // 8) if len(gaps) else 0
    body = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return bytes([planes]) + pa.compress(body.tobytes(), "zstd", asbytes=True)


def _unpacked(body: bytes, count: int) -> np.ndarray:
    planes = body[0]
    if not count * planes:
        return np.zeros(count, np.uint64)
    flat = np.frombuffer(pa.decompress(body[1:], count * planes, "zstd", asbytes=True), np.uint8)
    gaps = np.zeros((count, 8), np.uint8)
    gaps[:, :planes] = flat.reshape(planes, count).T
    return np.cumsum(gaps.view("<u8").reshape(-1), dtype=np.uint64)


def _starts(ascending: np.ndarray) -> np.ndarray:
    """Whether each number differs from the one before it."""
    return np.concatenate([[True], ascending[1:] != ascending[:-1]]) if len(ascending) else np.zeros(0, bool)


# What blocks and buckets send: kind, the block, the bucket, numbers as they are packed, the sets they are in, how often they occur.
SENT = "kind int, block long, bucket long, n int, numbers binary, sets binary, often binary"
MET, LOCAL, SETS = 0, 1, 2


def _record(kind: int, block: int, bucket: int, n: int, *bodies: bytes) -> tuple:
    return kind, block, bucket, n, *bodies


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = [field.split()[0] for field in SENT.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _sent(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """Per block of texts: the distinct n-grams for each bucket, those that several of its sets hold, and its sets."""
    several = np.uint16(SEVERAL)

    def block_rows(block: int, held: list[tuple[np.ndarray, tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(ngrams) for ngrams, _ in held])
        flat = np.concatenate([ngrams for ngrams, _ in held])
        sets = np.repeat(np.arange(len(held), dtype=np.uint16), sizes)
        order = np.argsort(flat, kind="stable")
        flat, sets = flat[order], sets[order]
        first = np.flatnonzero(_starts(flat))
        times = np.diff(first, append=len(flat))
        shared = np.repeat(times > 1, times)
        numbers, owner = flat[first], np.where(times > 1, several, sets[first])
        bucket = (numbers % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")  # numbers stay ascending in each bucket
        names, begin = np.unique(bucket[order], return_index=True)
        often = np.minimum(times, 0xFFFFFFFF).astype("<u4")
        cuts = [*begin.tolist(), len(order)]
        own = block % buckets
        keys = np.array([key for _, key in held], "<i8")
        rows = [
            _record(SETS, block, own, len(held), keys.tobytes(), sizes.astype("<i8").tobytes(), b""),
            _record(LOCAL, block, own, int(shared.sum()), _packed(flat[shared]), sets[shared].astype("<u2").tobytes(), b""),
        ]
        for name, a, z in zip(names.tolist(), cuts, cuts[1:], strict=False):
            at = order[a:z]
            body = _packed(numbers[at] // np.uint64(buckets))
            counted = pa.compress(often[at].tobytes(), "zstd", asbytes=True)
            rows.append(_record(MET, block, name, z - a, body, owner[at].astype("<u2").tobytes(), counted))
            if len(rows) == 1024:
                yield _records(rows)
                rows = []
        yield _records(rows)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, seen, total = [], set(), 0
        for batch in slices(batches):
            for ngrams in ngram_sets(batch.column("text").to_pylist(), n):
                keys = set_keys(ngrams)
                if not len(ngrams) or keys in seen:
                    continue
                seen.add(keys)
                held.append((ngrams, keys))
                total += len(ngrams)
                if total >= BLOCK_NGRAMS or len(held) == BLOCK_SETS:
                    yield from block_rows(block, held)
                    block, held, seen, total = block + 1, [], set(), 0
        if held:
            yield from block_rows(block, held)

    return texts.mapInArrow(emit, SENT)


def _met(bucket: pa.Table) -> pa.Table:
    """What a bucket answers to each block: its n-grams that occur more than once, and how often (a logarithm)."""
    rows = bucket.to_pylist()
    asked = [row for row in rows if row["kind"] == MET]
    out = [tuple(row.values()) for row in rows if row["kind"] != MET]
    if asked:
        counts = [row["n"] for row in asked]
        numbers = np.concatenate([_unpacked(row["numbers"], row["n"]) for row in asked])
        often = [np.frombuffer(pa.decompress(row["often"], 4 * row["n"], "zstd", asbytes=True), "<u4") for row in asked]
        order = np.argsort(numbers, kind="stable")
        head = _starts(numbers[order])
        group = np.cumsum(head) - 1
        totals = np.bincount(group, weights=np.concatenate(often)[order]).astype(np.int64)
        total = np.empty(len(numbers), np.int64)
        total[order] = totals[group]
        at = 0
        for row, count in zip(asked, counts, strict=True):
            mine = slice(at, at + count)
            again = total[mine] > 1
            level = (np.frexp(total[mine][again].astype(np.float64))[1] - 1).astype(np.uint8)
            sets = np.frombuffer(row["sets"], "<u2")[again]
            packed = _packed(numbers[mine][again])
            if len(sets):
                out.append(_record(MET, row["block"], row["bucket"], len(sets), packed, sets.tobytes(), level.tobytes()))
            at += count
    return pa.Table.from_batches([_records(out)])


CANDIDATE = "key long, key2 long, size long, ngrams binary"


def _candidates(texts: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """The sets that may link with another one, with those of their n-grams that others hold, in global order."""

    def kept(block: pa.Table) -> pa.Table:
        keys = sizes = local = None
        numbers, sets, levels = [], [], []
        for row in block.to_pylist():
            if row["kind"] == SETS:
                keys = np.frombuffer(row["numbers"], "<i8").reshape(-1, 2)
                sizes = np.frombuffer(row["sets"], "<i8")
            elif row["kind"] == LOCAL:
                local = _unpacked(row["numbers"], row["n"]), np.frombuffer(row["sets"], "<u2")
            else:
                numbers.append(_unpacked(row["numbers"], row["n"]) * np.uint64(buckets) + np.uint64(row["bucket"]))
                sets.append(np.frombuffer(row["sets"], "<u2"))
                levels.append(np.frombuffer(row["often"], np.uint8))
        rows: list[tuple] = []
        if numbers:
            numbers, sets = np.concatenate(numbers), np.concatenate(sets)
            numbers = numbers | np.concatenate(levels).astype(np.uint64) << np.uint64(NUMBER_BITS)
            several = sets == SEVERAL
            if several.any():
                plain = numbers & np.uint64((1 << NUMBER_BITS) - 1)
                by_number = np.argsort(plain[several])
                answered, full = plain[several][by_number], numbers[several][by_number]
                numbers = np.concatenate([numbers[~several], full[np.searchsorted(answered, local[0])]])
                sets = np.concatenate([sets[~several], local[1]])
            order = np.lexsort((numbers, sets))
            numbers, sets = numbers[order], sets[order]
            begin = np.flatnonzero(_starts(sets))
            for a, z in zip(begin, [*begin[1:], len(sets)], strict=True):
                i = int(sets[a])
                if z - a >= least_overlap(int(sizes[i]), percent):
                    rows.append((int(keys[i, 0]), int(keys[i, 1]), int(sizes[i]), numbers[a:z].tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = [field.split()[0] for field in CANDIDATE.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    answers = _sent(texts, n, buckets).groupBy("bucket").applyInArrow(_met, SENT)
    return answers.groupBy("block").applyInArrow(kept, CANDIDATE)


def _postings(candidates: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(bucket, signatures, sets, which): per block of sets, one of them for each n-gram met in their prefixes."""

    def deal(held: list[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        signs = np.concatenate([s for s, _ in held])
        keys = np.repeat(np.array([key for _, key in held], np.int64), [len(s) for s, _ in held])
        order = np.lexsort((keys, signs))
        signs, keys = signs[order], keys[order]
        head = _starts(signs)
        leader = keys[np.maximum.accumulate(np.where(head, np.arange(len(signs)), 0))]
        pairs = np.unique(np.stack([keys, leader], axis=1)[keys != leader], axis=0)
        with np.errstate(over="ignore"):
            tie = mixed(pairs.astype(np.uint64) @ np.array([ODD, PAIR]) + PREFIX) if len(pairs) else np.zeros(0, np.uint64)
        signs = np.concatenate([signs[head], tie, tie])
        keys = np.concatenate([keys[head], pairs[:, 0], pairs[:, 1]])
        bucket = (signs % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        names, begin = np.unique(bucket[order], return_index=True)
        cuts = [*begin.tolist(), len(order)]
        signs, keys = signs[order], keys[order]
        parts = list(zip(cuts, cuts[1:], strict=False))
        named = [np.unique(keys[a:b], return_inverse=True) for a, b in parts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names),
                pa.array([signs[a:b].tobytes() for a, b in parts], pa.binary()),
                pa.array([sets.tobytes() for sets, _ in named], pa.binary()),
                pa.array([which.astype("<u4").tobytes() for _, which in named], pa.binary()),
            ],
            ["bucket", "signatures", "sets", "which"],
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "size", "ngrams")]
            for key, size, body in zip(*columns, strict=True):
                ngrams = np.frombuffer(body, np.uint64)
                signs = mixed(ngrams[: prefix(len(ngrams), size, percent)] ^ PREFIX)
                held.append((signs, key))
                total += len(signs)
                if total >= BLOCK_SIGNATURES:
                    yield from deal(held)
                    held, total = [], 0
        if held:
            yield from deal(held)

    return candidates.mapInArrow(emit, "bucket long, signatures binary, sets binary, which binary")


def _meeting(bucket: pd.DataFrame) -> pd.DataFrame:
    """(a, b): every set of a bucket with the least set that shares one of its signatures."""
    signs = np.frombuffer(b"".join(bucket["signatures"]), np.uint64)
    named = zip(bucket["sets"], bucket["which"], strict=True)
    keys = np.concatenate([np.frombuffer(sets, np.int64)[np.frombuffer(which, "<u4")] for sets, which in named])
    order = np.lexsort((keys, signs))
    signs, keys = signs[order], keys[order]
    head = np.concatenate([[True], signs[1:] != signs[:-1]])
    leader = keys[np.maximum.accumulate(np.where(head, np.arange(len(signs)), 0))]
    pairs = np.unique(np.stack([keys, leader], axis=1)[keys != leader], axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _measured(texts: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, key, key2) of every text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = ngram_sets(batch.column("text").to_pylist(), n)
            keys = np.array([set_keys(s) for s in sets], np.int64).reshape(-1, 2)
            columns = [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "key", "key2"])

    return texts.mapInArrow(measure, "id long, n_shingles long, key long, key2 long")


def _small_clusters(members: DataFrame, percent: int) -> DataFrame:
    """(a, a2, b, b2): links that tie together the groups of clusters that fit in memory."""

    def ties(held: list[tuple]) -> pa.RecordBatch:
        sets, sizes = [np.frombuffer(row[3], np.uint64) for row in held], [row[2] for row in held]
        trie, groups, out = Trie(sets, sizes, percent), Groups(len(sets)), []
        for i, probe in enumerate(sets):
            for j in trie.linked(probe, sizes[i], lambda j, i=i: groups.find(j) == groups.find(i)):
                if groups.find(i) != groups.find(j):
                    groups.join(i, j)
                    out.append((*held[i][:2], *held[j][:2]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "a2", "b", "b2"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held, seen = None, [], set()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "key", "key2", "size", "ngrams")]
            for row_root, key, key2, size, ngrams in zip(*columns, strict=True):
                if row_root != root:
                    if len(held) > 1:
                        yield ties(held)
                    root, held, seen = row_root, [], set()
                if (key, key2) not in seen:
                    seen.add((key, key2))
                    held.append((key, key2, size, ngrams))
        if len(held) > 1:
            yield ties(held)

    ordered = members.repartition("root").sortWithinPartitions("root")
    return ordered.mapInArrow(walk, "a long, a2 long, b long, b2 long")


def _against(members: DataFrame, queries: DataFrame, percent: int) -> DataFrame:
    """Links (a, a2, b, b2) of sets with the query sets of their cluster, as many as tie their labels together.

    Both have (root, key, key2, size, label, ngrams), the queries also the number of
    their `block`. The sets of a cluster are dealt to parts; every part meets
    every block of its cluster in a task of its own.
    """

    def probe(part: pa.Table, block: pa.Table) -> pa.Table:
        asked = block.to_pydict()
        trie = Trie([np.frombuffer(body, np.uint64) for body in asked["q_ngrams"]], asked["q_size"], percent)
        names = {label: i for i, label in enumerate(dict.fromkeys([*asked["q_label"], *part.column("label").to_pylist()]))}
        labels, groups, out = [names[label] for label in asked["q_label"]], Groups(len(names)), []
        members = zip(*[part.column(c).to_pylist() for c in ("key", "key2", "size", "label", "ngrams")], strict=True)
        for key, key2, size, label, body in members:
            own = names[label]
            known = np.frombuffer(body, np.uint64)
            for i in trie.linked(known, size, lambda i, own=own: groups.find(labels[i]) == groups.find(own)):
                if groups.find(labels[i]) != groups.find(own):
                    groups.join(labels[i], own)
                    out.append((key, key2, asked["q_key"][i], asked["q_key2"][i]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["a", "a2", "b", "b2"])

    # Written, so that the joins are planned by the size of these: a row for each large cluster.
    parts = members.groupBy("root").agg(_portions("parts"))
    blocks = queries.groupBy("root").agg((F.max("block") + 1).alias("blocks"))
    parts = materialise(parts.join(blocks, "root"), "parts")
    each = [F.col(c) for c in ("root", "key", "key2", "size", "label", "ngrams")]
    dealt = members.join(parts, "root").select(
        *each, _portion("parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    copies = queries.join(parts.drop("blocks"), "root").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    place = ["root", "part", "block"]
    theirs = [F.col(c).alias(f"q_{c}") for c in (*place, "key", "key2", "size", "label", "ngrams")]
    met = copies.select(*theirs).groupBy(*[f"q_{c}" for c in place])
    return dealt.groupBy(*place).cogroup(met).applyInArrow(probe, "a long, a2 long, b long, b2 long")


def _portions(name: str):
    """Into how many portions of bounded number and size the sets of a group are dealt."""
    by_number, by_size = F.count(F.lit(1)) / PORTION_SETS, F.sum(F.octet_length("ngrams").cast("long")) / (8 * CLUSTER_NGRAMS)
    return F.greatest(F.ceil(by_number), F.ceil(by_size)).cast("int").alias(name)


def _portion(portions: str):
    return F.pmod(F.xxhash64("key2", "key"), F.col(portions)).cast("int")


def _node(key: str, key2: str):
    return F.xxhash64(key, key2)


def _large_clusters(members: DataFrame, percent: int) -> DataFrame:
    """(a, a2, b, b2): links that tie together the groups of clusters of any size."""
    members = members.dropDuplicates(["root", "key", "key2"]).withColumn("label", _node("key", "key2"))
    members = materialise(members, "members")
    lead = members.groupBy("root").agg(F.min("key").alias("k1"), F.max("key").alias("k2"), F.min("key2").alias("k3"), F.max("key2").alias("k4"))
    lead = materialise(lead, "lead")
    pivots = members.join(lead, "root").filter("key in (k1, k2) or key2 in (k3, k4)").drop("k1", "k2", "k3", "k4")
    first = materialise(_against(members, pivots.withColumn("block", F.lit(0)), percent), "links")
    edges = first.select(_node("a", "a2").alias("a"), _node("b", "b2").alias("b"))
    roots = components(edges).withColumnsRenamed({"node": "label", "root": "grouped"})
    members = members.join(roots, "label", "left").withColumn("label", F.coalesce("grouped", "label")).drop("grouped")
    members = materialise(members, "members")
    sizes = members.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))
    main = materialise(sizes.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main")), "main")
    rest = members.join(main, "root").filter("label <> main").drop("main")
    counts = materialise(rest.groupBy("root").agg(_portions("blocks")), "counts")
    queries = rest.join(counts, "root").withColumn("block", _portion("blocks")).drop("blocks")
    return first.unionByName(_against(members, materialise(queries, "queries"), percent))


def linked_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per document: (id, n_shingles, component_id), the least id reachable by links."""
    texts = id_and_text(docs, id_col, text_col)
    named = texts.filter(F.col("id").isNotNull())
    text_bytes = named.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, text_bytes // BUCKET_TEXT_BYTES)
    candidates = materialise(_candidates(named, n, percent, buckets), "candidates")
    met = _postings(candidates, percent, buckets).groupBy("bucket").applyInPandas(_meeting, "a long, b long")
    clusters = components(met).withColumnsRenamed({"node": "key"})
    measured = materialise(_measured(texts, n), "measured")
    classes = measured.filter("id is not null and n_shingles > 0").groupBy("key", "key2").agg(F.min("id").alias("id"))
    members = materialise(candidates.join(clusters, "key"), "members")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("ngrams"))
    large = materialise(sizes.filter((F.col("sets") > CLUSTER_SETS) | (F.col("ngrams") > CLUSTER_NGRAMS)).select("root"), "large")
    links = _small_clusters(members.join(large, "root", "left_anti"), percent)
    if not large.isEmpty():
        links = links.unionByName(_large_clusters(members.join(large, "root", "left_semi"), percent))
    links = materialise(links, "links")
    edges = links.select(_node("a", "a2").alias("a"), _node("b", "b2").alias("b"))
    roots = components(edges).withColumnRenamed("node", "class")
    by_class = classes.withColumn("class", _node("key", "key2")).join(roots, "class")
    # The least id of a group, given to each of its classes; a class without links is its own group.
    least_id = by_class.groupBy("root").agg(F.min("id").alias("component_id"))
    grouped = materialise(by_class.join(least_id, "root").select("key", "key2", "component_id"), "groups")
    alone = classes.withColumnRenamed("id", "alone")
    found = (
        measured.join(alone, ["key", "key2"], "left")
        .join(grouped, ["key", "key2"], "left")
        .select(
            "id",
            "n_shingles",
            F.when(F.col("id").isNotNull(), F.coalesce("component_id", "alone", "id")).alias("component_id"),
        )
    )
    return found.withColumnRenamed("id", id_col)
