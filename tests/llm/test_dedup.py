"""Exact copies, similar texts, repeated bytes and boilerplate lines, beside brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridseries.llm import exact_dedup, line_dedup, ngram_join, repeated_bytes
from gridseries.llm.batches import ship_code
from gridseries.llm.components import components
from gridseries.llm.suffix_sort import common, deep_shallow

# Exact copies.


def squeezed(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def plain_exact(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[squeezed(text)].append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for _, _, _, i in members:
            out.append((rows[i][0], keep, len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece_rows", [512, 1])
def test_exact_dedup(hard, rows, piece_rows):
    found = exact_dedup.exact_dedup(hard, piece_rows=piece_rows).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == plain_exact(rows)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({squeezed(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


@pytest.mark.parametrize("piece_rows", [512, 1])
def test_drop_copies_keeps_columns(hard, rows, piece_rows):
    kept = exact_dedup.drop_copies(hard, piece_rows=piece_rows)
    assert kept.schema == hard.schema
    found = kept.collect()
    assert sorted(squeezed(r.text) for r in found) == sorted({squeezed(t) for _, t in rows})


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


# Similar texts.


def plain_groups(rows, n, percent):
    def shingles(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        if len(words) < n:
            return frozenset([tuple(words)] if words else [])
        return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))

    docs = [(doc, shingles(text)) for doc, text in rows if doc is not None]
    parent = {doc: doc for doc, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(docs):
        for b, t in docs[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((doc, len(s), find(doc)) for doc, s in docs)


def variants(seed, bases=6, copies=12, words=60):
    """Texts with edits of growing number, some of them linked only through others, and a common line."""
    rng = random.Random(seed)
    line = " ".join(f"common{i}" for i in range(12))
    out = []
    for base in range(bases):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, words))]
        for _ in range(copies):
            text = list(text)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            out.append((len(out), " ".join(text) + (" " + line if base % 2 else "")))
    return out


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_linked_groups_hard(hard, rows, n, percent):
    found = ngram_join.linked_groups(hard, n=n, percent=percent).collect()
    assert len(found) == len(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None) == plain_groups(rows, n, percent)
    assert all(r.component_id is None for r in found if r.doc_id is None)


@pytest.mark.parametrize("gathered", [128, 2])
def test_linked_groups_variants(spark, monkeypatch, gathered):
    monkeypatch.setattr(ngram_join, "CLUSTER_SETS", gathered)
    monkeypatch.setattr(ngram_join, "PORTION_SETS", gathered)
    monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", 50 * gathered)
    ship_code(spark)
    rows = variants(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n, percent in ((3, 90), (2, 70)):
        found = ngram_join.linked_groups(df, n=n, percent=percent).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == plain_groups(rows, n, percent)


def test_linked_groups_empty(empty):
    assert ngram_join.linked_groups(empty).count() == 0


@pytest.mark.parametrize("percent", [90, 80, 50])
def test_linked_sets_share_a_prefix(percent):
    """Also when n-grams that no other set holds are left out, in any order of the others."""
    rng = np.random.default_rng(percent)
    linked = 0
    for _ in range(400):
        size = int(rng.integers(2, 300))
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        drop = rng.random(len(base)) > rng.uniform(0, 1.2 * (100 - percent) / 100)
        other = np.concatenate([base[drop], rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        shared = np.intersect1d(a, b)
        if len(b) and 100 * len(shared) >= percent * (len(a) + len(b) - len(shared)):
            linked += 1
            # Each keeps the shared ones and some that only third sets hold.
            kept = [np.union1d(shared, x[rng.random(len(x)) < 0.5]) for x in (a, b)]
            first = [k[: ngram_join.prefix(len(k), len(x), percent)] for k, x in zip(kept, (a, b))]
            assert len(np.intersect1d(*first))
    assert linked > 100


def test_packed_numbers():
    rng = np.random.default_rng(4)
    for numbers in ([], [0], [5], [0, 1, (1 << 57) - 1], np.unique(rng.integers(0, 1 << 51, 1000, dtype=np.uint64)), [7, 7, 7]):
        numbers = np.array(numbers, np.uint64)
        assert ngram_join._unpacked(ngram_join._packed(numbers), len(numbers)).tolist() == numbers.tolist()


def test_trie_finds_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 80, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(80) < rng.uniform(0, 0.2), rng.integers(0, 1 << 62, 80, dtype=np.uint64), base)) for _ in range(60)]
    sizes = [len(s) for s in sets]
    for percent in (90, 70):
        trie = ngram_join.Trie(sets, sizes, percent)
        some = [np.intersect1d(s, base) for s in sets]  # what only one set holds may be left out
        few = [i for i, s in enumerate(some) if len(s) >= ngram_join.least_overlap(sizes[i], percent)]
        small = ngram_join.Trie([some[i] for i in few], [sizes[i] for i in few], percent)
        for i, a in enumerate(sets):
            wanted = [j for j, b in enumerate(sets) if 100 * (k := len(np.intersect1d(a, b))) >= percent * (len(a) + len(b) - k)]
            assert sorted(trie.linked(a, sizes[i])) == wanted
            if i in few:
                found = {few[j] for j in small.linked(some[i], sizes[i])}
                assert sorted(found - {i}) == [j for j in wanted if j != i]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(900, 900)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for e in edges for x in e if e[0] != e[1]}


# Repeated bytes.


def plain_removed(rows, length=200):
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    count = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        steps = np.zeros(len(t) + 1, int)
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                steps[s] += 1
                steps[s + length] -= 1
        gone = np.cumsum(steps)[: len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        n_spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(t), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed=4):
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    parts = [fresh(n) for n in (199, 200, 201, 350, 800)]
    rows = []
    for i in range(60):
        body = fresh(rng.randrange(300))
        for _ in range(rng.randrange(3)):
            part = rng.choice(parts)
            cut = rng.randrange(40)
            body += part[cut * (i % 2) :] + fresh(rng.randrange(1, 200))
        rows.append((i, body))
    return rows


def test_remove_repeats_hard(hard, rows):
    found = repeated_bytes.remove_repeats(hard).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found], key=str) == plain_removed(rows)


def test_remove_repeats_passages(spark):
    ship_code(spark)
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = repeated_bytes.remove_repeats(df, keep_text=True).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found], key=str) == plain_removed(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == r.n_spans for r in found)


def test_crowded_grams_count_alike(spark):
    from pyspark.sql import functions as F

    ship_code(spark)
    df = spark.createDataFrame(passages(9), "id long, text string").withColumn("key", F.xxhash64("id", "text"))
    gathered = {tuple(r) for r in repeated_bytes.repeated_spans(df).collect()}
    counted = {tuple(r) for r in repeated_bytes.repeated_spans(df, gathered=1).collect()}
    assert gathered == counted and gathered


def test_remove_repeats_empty(empty):
    assert repeated_bytes.remove_repeats(empty).count() == 0


def test_anchors_of_long_texts_do_not_depend_on_segments(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choices("abcd ", k=9000)).encode()
    whole = repeated_bytes.anchors([b"short", text])
    monkeypatch.setattr(repeated_bytes, "SEGMENT", 1000)
    cut = repeated_bytes.anchors([b"short", text])
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))
    assert np.diff(whole[1]).max() <= 200 - repeated_bytes.GRAM + 1


@pytest.mark.parametrize("n", [5, 120])
def test_reaches(n):
    rng = random.Random(n)
    lefts = [bytes(rng.choices(b"a" * 30 + b"b", k=rng.choice([20, 136]))) for _ in range(n)]
    rights = [bytes(rng.choices(b"a" * 30 + b"b", k=rng.choice([20, 136]))) for _ in range(n)]
    low, high = repeated_bytes._reaches(lefts, rights, 136)
    for i in range(n):
        pairs = [(common(lefts[i], lefts[j]), common(rights[i], rights[j])) for j in range(n) if j != i]
        pairs = [(a, b) for a, b in pairs if a + b >= 136]
        wanted = (136 - max(b for _, b in pairs), max(a for a, _ in pairs)) if pairs else (-1, -1)
        assert (low[i], high[i]) == wanted


@pytest.mark.parametrize("shallow", [0, 3, 24])
def test_deep_shallow(shallow):
    rng = random.Random(shallow)
    for turn in range(60):
        if turn % 2:
            strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 60))) for _ in range(rng.randint(1, 40))]
        else:
            strings = [b"a" * rng.randint(0, 70) + bytes(rng.choices(b"ab", k=rng.randint(0, 5))) for _ in range(rng.randint(1, 40))]
        order, prefixes = deep_shallow(strings, shallow)
        assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
        assert prefixes[1:] == [common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


# Boilerplate lines.


def test_line_dedup(spark):
    pages = [(i, f"https://User@WWW.Site.example:80/{i}", f"<nav>Home</nav><p>Story {i} \t here</p>") for i in range(6)]
    pages += [(10, "http://small.example/", "<p>Home</p>"), (11, None, "<p>Home</p><p>Home</p>"), (12, "no address", None)]
    pages += [(13, "http://www.site.example", ""), (14, "https://www.site.example/x", "<script>var a='<p>Home</p>'</script><b>Home</b>One")]
    df = spark.createDataFrame([(*p, "h", []) for p in pages], "page_id long, url string, html string, host string, lines array<string>")
    found = {r.page_id: r for r in line_dedup.drop_site_lines(df).collect()}
    assert len(found) == len(pages)
    assert found[0].host == "www.site.example" and (found[0].n_lines, found[0].n_dropped) == (2, 1)
    assert found[3].text == "Story 3 here"
    assert found[10].text == "Home" and found[10].n_dropped == 0
    assert found[11].host == "" and found[11].n_lines == 2
    assert (found[12].n_lines, found[12].text) == (0, "") and found[13].n_lines == 0
    assert found[14].text == "One"
    assert line_dedup.drop_site_lines(df.limit(0)).count() == 0


def test_line_dedup_of_repeated_rows_and_long_pages(spark):
    long = "".join(f"<p>line {i}</p>" for i in range(60_000))
    pages = [(1, "http://a.example/", "<p>Menu</p><p>One</p>")] * 4 + [(2, "http://a.example/2", "<p>Menu</p>" + long)]
    pages += [(k, "http://a.example/k", f"<p>Menu</p><p>Page {k}</p>") for k in range(3, 9)]
    pages += [(None, "http://a.example/n", "<p>Menu</p>"), (9, "http://b.example", "<p>" + "x" * 500_000 + "</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = line_dedup.drop_site_lines(df).collect()
    assert len(found) == len(pages)
    # Repeated rows are pages of their own: "One" is on 4 of 12 pages, more than three tenths.
    assert [(r.n_lines, r.n_dropped, r.text) for r in found if r.page_id == 1] == [(2, 2, "")] * 4
    two = next(r for r in found if r.page_id == 2)
    assert (two.n_lines, two.n_dropped) == (60_001, 1) and two.text.startswith("line 0\nline 1\n")
    assert all(r.text == f"Page {r.page_id}" for r in found if r.page_id in range(3, 9))
    assert next(r for r in found if r.page_id is None).text == ""
    assert len(next(r for r in found if r.page_id == 9).text) == 500_000
