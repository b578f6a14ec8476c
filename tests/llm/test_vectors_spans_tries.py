"""Pivot clustering, personal data and the prefix trie against plain versions of their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridseries.llm import personal_data, pivot_clustering, prefix_trie
from gridseries.llm.batches import ship_code
from gridseries.llm.radix_tree import Direct, Indexed, RadixTree, Sorted, shared_length


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Centroid clustering


def plain_clusters(rows, count, rounds, dimensions, scale=64):
    """(id, cluster, distance, cluster inertia, inertia, centroid digest) by visiting every centroid."""
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) and abs(x) < 2.0**128 for x in v)
    ]
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"1:{r[0]}"), r[1]))
    at = [v for _, v in first[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, v), (_, k) in zip(kept, assign()):
            groups[k].append(v)
        at = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(at)]
    found = assign()
    sums = defaultdict(int)
    for d, k in found:
        sums[k] += d

    def small(x):
        return x if x < 2**63 else None

    return sorted(
        (
            (i, k, small(d), small(sums[k]), small(sum(sums.values())), sha(",".join(map(str, at[k]))))
            for (i, _), (d, k) in zip(kept, found)
        ),
        key=str,
    )


def clusters(spark, rows, dimensions, count, rounds, kind="float", **more):
    ship_code(spark)
    given_rows = [(i, v, "x", 1.5) for i, v in rows]
    df = spark.createDataFrame(given_rows, f"vec_id long, embedding array<{kind}>, cluster string, p double")
    found = pivot_clustering.cluster(df, dimensions=dimensions, count=count, rounds=rounds, **more)
    return sorted(map(tuple, found.collect()), key=str)


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_clusters_equal_plain(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    rows = [(int(k), (centres[k % 5] + 0.1 * rng.normal(size=8)).tolist()) for k in range(120)]
    rows += [(k, [0.5] * 8) for k in range(200, 260)]  # one vector over and over
    rows += [(7, rows[7][1]), (7, [0.0] * 8), (None, rows[3][1]), (None, [1.0] * 8)]
    rows = as_floats(rows)
    assert clusters(spark, rows, 8, 6, 3) == plain_clusters(rows, 6, 3, 8)
    assert clusters(spark, rows, 8, 6, 0, pivots=1) == plain_clusters(rows, 6, 0, 8)


def test_clusters_of_unusable_vectors(spark):
    rows = [
        (1, [0.1, -0.2, 0.3]),
        (2, None),
        (3, []),
        (4, [1.0, 2.0]),
        (5, [1.0, None, 2.0]),
        (6, [float("nan"), 0.0, 0.0]),
        (7, [float("inf"), 0.0, 0.0]),
        (8, [-0.1, -0.2, -0.3]),
        (9, [1.0, 2.0, 3.0, 4.0]),
    ]
    rows = as_floats(rows)
    found = clusters(spark, rows, 3, 16, 3)
    assert [r[0] for r in found] == [1, 8] and found == plain_clusters(rows, 16, 3, 3)
    assert clusters(spark, rows[1:3], 3, 16, 3) == []
    assert clusters(spark, [], 3, 16, 3) == []


def test_clusters_of_huge_components(spark):
    largest = float(np.finfo(np.float32).max)
    rows = as_floats([(k, [0.01 * k, largest if k == 4 else 1.0, -largest if k == 5 else 2e9 * (k % 3)]) for k in range(12)])
    assert clusters(spark, rows, 3, 4, 3) == plain_clusters(rows, 4, 3, 3)
    beyond = [(1, [2.0**200, 0.0]), (2, [1.0, 2.0])]
    assert [r[0] for r in clusters(spark, beyond, 2, 2, 1, kind="double")] == [2]


def test_ties_go_to_the_smaller_number():
    centroids = pivot_clustering.Centroids.of([[2, 0], [-2, 0], [0, 2]], [[5, 1]])
    rows = np.array([[0.0, 0.0], [0.0, 1.0]])
    far = np.sqrt(((rows - np.array([5.0, 1.0])) ** 2).sum(axis=1))[:, None]
    cluster, distance, _ = centroids.nearest(rows, far)
    assert cluster.tolist() == [0, 2] and distance.tolist() == [4, 1]


def test_pivots_save_distances():
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (16, 8))
    rows = (centres[rng.integers(0, 16, 3000)] + rng.integers(-20, 20, (3000, 8))).astype(float)
    pivots = pivot_clustering.choose_pivots(centres.tolist(), 8)
    far = np.stack([np.sqrt(((rows - np.array(p)) ** 2).sum(axis=1)) for p in pivots], axis=1)
    _, distance, taken = pivot_clustering.Centroids.of(centres.tolist(), pivots).nearest(rows, far)
    assert taken < 2 * len(rows)  # of 16 for every row
    assert distance.tolist() == ((rows[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).tolist()


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def passes_luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        doubled = int(c) * (1 + k % 2)
        total += doubled - 9 if doubled > 9 else doubled
    return total % 10 == 0


def plain_spans(text):
    found = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [
        (m.start(), m.end(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and passes_luhn(digits(m[0]))
    ]
    found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], personal_data.KINDS.index(s[2])))


@settings(max_examples=300, deadline=None)
@given(
    st.one_of(
        st.text(alphabet="a1.@_ %+é", max_size=60),
        st.text(alphabet="0123456789 -", max_size=80),
        st.text(alphabet="12 -.+()", max_size=60),
        st.text(alphabet="0.1 2.3", max_size=60),
        st.text(max_size=60),
    )
)
def test_base_spans_equal_plain(text):
    spans = personal_data.personal_spans(text)
    assert [tuple(s[:3]) for s in spans if s.kind in personal_data.KINDS] == plain_spans(text)
    added = [s for s in spans if s.kind in personal_data.MORE_KINDS]
    assert all(0 <= s.start < s.end <= len(text) and 0.5 <= s.score <= 1 for s in added)
    assert all(s.end <= o.start or o.end <= s.start for s in added for o in spans if o is not s)


def test_endless_runs_take_linear_time():
    for text in ("9" * 400_000, "a" * 400_000, "a@" * 200_000, "1." * 200_000, "+1 " * 100_000, "A1" * 200_000, "1 " * 100_000):
        personal_data.personal_spans(text)  # a quadratic scan would take minutes


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("IBAN GB82 WEST 1234 5698 7654 32 please", "iban", "GB82 WEST 1234 5698 7654 32"),
        ("to DE89370400440532013000.", "iban", "DE89370400440532013000"),
        ("ssn 123-45-6789", "ssn", "123-45-6789"),
        ("passport C01234567", "passport", "C01234567"),
        ("call 555-123-4567 now", "local_phone", "555-123-4567"),
        ("x 7536784127813050 4845168114407329 y", "card_part", "4845168114407329"),
        ("+1 (487) 555-7209 47369", "phone_part", "+1 (487) 555-7209"),
    ],
)
def test_added_kinds(text, kind, value):
    assert [(text[s.start : s.end], s.kind) for s in personal_data.personal_spans(text)] == [(value, kind)]


@pytest.mark.parametrize(
    "text",
    ["DE89370400440532013001", "123-45-6789", "ssn 666-45-6789", "ssn 123-00-6789", "order C01234567", "id 012345678", "555-123-4567"],
)
def test_unconfirmed_forms_are_left_alone(text):
    assert personal_data.personal_spans(text) == []


def test_context_moves_the_score():
    def of(text):
        return personal_data.personal_spans(text)[0].score

    assert of("card 4111111111111111") > of("4111111111111111") > of("invoice 4111111111111111")
    assert of("server 10.0.0.1") > of("10.0.0.1") > of("version 10.0.0.1")


def test_personal_data_hard(spark, hard, rows, empty):
    planted = "mail a.b@c.de, +49 30 1234567, 10.0.0.1, 4111 1111 1111 1111 é😀 x@y.zz"
    more = spark.createDataFrame([(100, planted), (None, planted), (100, planted)], "doc_id long, text string")
    docs = hard.unionByName(more, allowMissingColumns=True)
    found = personal_data.find_personal_data(docs).collect()
    texts = rows + [(100, planted), (None, planted), (100, planted)]
    got = sorted(((r.doc_id, [(s.start, s.end, s.kind) for s in r.spans if s.kind in personal_data.KINDS]) for r in found), key=str)
    assert got == sorted(((i, plain_spans(t or "")) for i, t in texts), key=str)
    assert personal_data.find_personal_data(empty).count() == 0
    clean = {r.text for r in personal_data.redact(more).collect()}
    assert clean == {"mail <email>, <phone>, <ip>, <card> é😀 <email>"}


def test_personal_data_query(spark, sf, documents):
    found = {r.doc_id: r for r in entry.queries()["op12_personal_data"](spark, sf).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for row in rows:
        spans = plain_spans(row.text or "")
        got = found[row.doc_id]
        assert [got[f"n_{k}"] for k in personal_data.KINDS] == [sum(s[2] == k for s in spans) for k in personal_data.KINDS]
        assert got.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, b, k in spans))
        assert {f"{k}:{a}:{b}" for a, b, k in spans} <= set(got.spans.split(",") if got.spans else [])


# Prefix trie


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: b[: len(b) // 2 * 2]), max_size=60))
def test_radix_tree_beginnings(keys):
    tree = RadixTree()
    for k, key in enumerate(keys):
        tree.add(key, k)
    wanted = defaultdict(set)
    for k, key in enumerate(keys):
        for length in range(2, len(key) + 1, 2):
            wanted[key[:length]].add(k)
    found = [(length, sorted(items)) for length, items in tree.aligned(2)]
    assert sorted(found) == sorted((len(b), sorted(items)) for b, items in wanted.items())


def test_radix_tree_layouts_grow():
    tree = RadixTree()
    kinds = []
    for label in range(256):
        tree.add(bytes([255 - label, 7]), label)
        kinds.append((type(tree.root.below), tree.root.below.most) if tree.root.path == b"" else None)
    assert kinds[3] == (Sorted, 4) and kinds[4] == (Sorted, 16) and kinds[16] == (Indexed, 48) and kinds[48] == (Direct, 256)
    assert [label for label, _ in tree.root.below] == list(range(256))
    assert sorted(items for _, items in tree.aligned(2)) == [[k] for k in range(256)]
    assert shared_length(b"abcd", b"abxd") == 2 and shared_length(b"", b"a") == 0 and shared_length(b"ab", b"abc") == 2


def plain_trie(rows):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) straight from the contract."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = sha(f"{len(role.encode())}:{role}{text}")[:32]
            own[conv].append(((turn is not None, turn or 0), name, (role, text)))
    turns = {c: [t[2] for t in sorted(own[c])] for c in own}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        rebuilt[c] = turns.get(base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = [out[k] for k in children[node]]
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = sorted(c for c in members[node] if len(rebuilt[c]) == len(node))
        out[node] = (
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below),
            sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below), sha(",".join(map(str, ends))),
        )
    return sorted(out.values(), key=str)


def trie(spark, rows):
    ship_code(spark)
    given_rows = [(*r, "k", 1, 2) for r in rows]
    schema = "conv_id long, turn long, role string, text string, key string, depth int, part int"
    return sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(given_rows, schema)).collect()), key=str)


def test_trie_hard(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 12), *range(100, 140), 305, -5, -100, -205]:
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["", "hé", "😀😀", "same"])))
    rows += [(500, t, "user", "hello") for t in range(300)]  # much longer than a block
    rows += [(c, t, "user", "hello") for c in (501, 502, 503) for t in range(290)]
    rows += [(7, None, None, None), (7, None, "user", None), (None, 1, "user", "lost"), (9, 3, "user", "tie"), (9, 3, "bot", "tie")]
    rows += [(11, 2, "user", "again")] * 3
    rows.append((13, 0, "us", "erx"))
    rows.append((14, 0, "user", "x"))
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_copies_over_several_trees(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", 2)
    monkeypatch.setattr(prefix_trie, "TREE_ROWS", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
    rows = [(c, t, "user", f"turn {t}") for c in range(1000, 1060) for t in range(7)]
    rows += [(c, t, "user", f"turn {t + c % 2}") for c in range(2000, 2030) for t in range(c % 5)]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []
    # All that conversation 1 has stands before its first turn of its own: only the root is left.
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert trie(spark, [(turnless, 0, "user", "x")]) == [(turnless, 0, None, 1, 0, 1, 0, sha(str(turnless)))]


def test_turns_stay_apart_for_role_and_text(spark):
    ab = spark.createDataFrame([("a", "b:c"), ("a:b", "c"), ("ab", "c")], "role string, text string")
    names = ab.select(prefix_trie.turn_name(F.col("role"), F.col("text")).alias("n")).collect()
    assert len({r.n for r in names}) == 3 and all(len(r.n) == 32 for r in names)
