"""Decontamination, language identification, the pipeline and the registered queries."""

import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gridseries.llm import index_match, language_id
from tests.llm.test_dedup import plain_groups, squeezed
from tools.check_queries import rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(docs, items, window=10):
    """(id, words, hit words, items) by looking at every place."""
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(len(w), window)
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        out.append((doc, len(w), len(hit), len(found), sorted(found)))
    return out


ITEMS = [
    (1, "Seven wizards quietly box up five dozen liquor jugs today, the quick brown fox"),
    (2, "One."),
    (3, None),
    (4, "..."),
    (5, "école 中文"),
    (6, "one two three four five six seven eight nine ten"),
    (10, "nothing of this kind is there anywhere in all of the texts at hand"),
    (11, "ONE"),
]


def test_contamination_hard(spark, hard, rows, empty):
    items = spark.createDataFrame([(*i, 1, "t") for i in ITEMS], "item_id long, text string, id int, term string")
    found = index_match.contamination(hard.filter("doc_id is not null"), items).collect()
    wanted = plain_hits([r for r in rows if r[0] is not None], ITEMS)
    # Rows that repeat an id share their hits.
    assert sorted([tuple(r) for r in found if r.doc_id != 7], key=str) == sorted([w for w in wanted if w[0] != 7], key=str)
    assert len(index_match.contamination(hard, items).collect()) == len(rows)
    assert index_match.contamination(empty, items).count() == 0
    clean = index_match.contamination(hard, items.limit(0)).collect()
    assert len(clean) == len(rows) and all(r.n_hit == 0 and r.item_ids == [] for r in clean)


def test_contamination_small_words(spark):
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(rng.choice(["a", "b", "c"], rng.integers(0, 60)))) for i in range(30)]
    items = [(i, " ".join(rng.choice(["a", "b", "c"], rng.integers(1, 9)))) for i in range(6)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = index_match.contamination(docs, bench, window=4).collect()
    assert sorted(map(tuple, found)) == sorted(plain_hits(texts, items, 4))


def test_contamination_repeated_rows(spark):
    planted = f"before it {ITEMS[5][1]} behind it"
    texts = [(1, planted), (1, planted), (2, planted), (3, "clean"), (4, planted), (4, f"x {planted}"), (4, f"x x {planted}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[5:6], "item_id long, text string")
    found = index_match.contamination(docs, items).collect()
    # Rows of one id share their hits: places 2 to 11, 3 to 12 and 4 to 13.
    wanted = [(1, 14, 10, 1, ["6"])] * 2 + [(2, 14, 10, 1, ["6"]), (3, 1, 0, 0, [])] + [(4, n, 12, 1, ["6"]) for n in (14, 15, 16)]
    assert sorted(map(tuple, found)) == wanted


def test_decontaminated_repeated_rows(spark, tmp_path):
    spark.createDataFrame(ITEMS[5:6], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, ITEMS[5][1]), (1, ITEMS[5][1]), (2, "clean"), (2, "clean")], "doc_id long, text string")
    kept = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert [tuple(r) for r in kept.collect()] == [(2, "clean")] * 2


def test_null_ids(spark, tmp_path):
    planted = f"before it {ITEMS[5][1]}"
    texts = [(None, planted), (None, f"x {planted}"), (None, "clean"), (None, None), (1, planted), (2, "clean")]
    docs = spark.createDataFrame([(*t, k, 0) for k, t in enumerate(texts)], "doc_id long, text string, id long, own int")
    items = spark.createDataFrame(ITEMS[5:6], "item_id long, text string")
    # Documents without an id do not share their hits.
    wanted = [w for t in texts for w in plain_hits([t], ITEMS[5:6])]
    assert sorted(map(tuple, index_match.contamination(docs, items).collect()), key=str) == sorted(wanted, key=str)
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()
    assert sorted((r.id, r.doc_id, r.text) for r in kept) == [(2, None, "clean"), (3, None, None), (5, 2, "clean")]


@pytest.mark.parametrize("passage", ["Α.Σ. ΤΗ", "ΑΣ'Β", "ΑΣ .ΑΒ", "ΑΣ.ΑΒ", "'Σ Α", "ΣΑΣ ς σ"])
def test_contamination_sigma(spark, passage):
    texts = [(1, passage), (2, f"a {passage} b"), (3, f"{passage}Α"), (4, f"Α.{passage}.Α"), (5, passage.lower())]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    found = index_match.contamination(docs, items).collect()
    assert sorted(map(tuple, found)) == plain_hits(texts, [(1, passage)])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue x green"), (2, "red blue"), (3, "green blue red"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    near = index_match.proximity_matches(docs, items, 3)
    assert [tuple(r) for r in near.collect()] == [(3, 1, 0, 2)]
    assert {r.doc_id for r in index_match.proximity_matches(docs, items, 6).collect()} == {1, 3}


# Languages.


def test_identify_documents(documents):
    texts = {r.doc_id: r for r in documents.collect()}
    found = language_id.identify(documents).collect()
    assert len(found) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "es"} for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == texts[r.doc_id].lang for r in held]) >= 0.95


def plain_profiles(rows):
    """(id, held out, language, score) by adding up the vectors of all three-letter sequences one by one."""
    bound = {}

    def sequence(codes):
        if codes not in bound:
            a, b, c = (language_id.letter_vector(code, language_id.DIMENSIONS).astype(int) for code in codes)
            bound[codes] = np.roll(a, 2) * np.roll(b, 1) * c
        return bound[codes]

    def vector(text):
        codes = [0]
        for char in (text or "").lower() + "\n":
            code = ord(char) if char.isalpha() else 0
            if code or codes[-1]:
                codes.append(code)
        counts = Counter(zip(codes, codes[1:], codes[2:]))
        return sum((n * sequence(s) for s, n in counts.items()), np.zeros(language_id.DIMENSIONS, int))

    vectors = [vector(text) for _, text, _ in rows]
    held = [zlib.crc32(str(doc).encode()) % 5 == 0 for doc, _, _ in rows]
    profiles = {}
    for (_, _, lang), v, out in zip(rows, vectors, held):
        if lang is not None and not out:
            profiles[lang] = profiles.get(lang, 0) + v
    names = sorted(profiles)
    found = []
    for (doc, _, _), v, out in zip(rows, vectors, held):
        cosines = [v @ profiles[n] / max(np.linalg.norm(v) * np.linalg.norm(profiles[n]), 1e-12) for n in names]
        best = int(np.argmax(cosines))
        found.append((doc, out, names[best] if v.any() else "und", min(1.0, max(0.0, cosines[best])) if v.any() else 0.0))
    return found


def test_identify_equals_plain_profiles(documents):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()]
    rows = [(doc, text and text[:3000], lang) for doc, text, lang in rows]
    docs = documents.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for doc, out, lang, score in plain_profiles(rows):
        assert (got[doc].held_out, got[doc].lang_pred) == (out, lang)
        assert abs(got[doc].score - score) < 1e-4


def test_identify_hard(spark, hard, rows, empty):
    found = language_id.identify(hard).collect()
    assert len(found) == len(rows)
    letters = Counter((doc, any(map(str.isalpha, t or ""))) for doc, t in rows)
    assert Counter((r.doc_id, r.lang_pred != "und") for r in found) == letters
    assert language_id.identify(empty).count() == 0
    nothing = language_id.predict(hard, {})
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}


def test_text_vectors_bind_and_bundle():
    d = 64
    vector = language_id.letter_vector
    space, a, b = vector(0, d), vector(ord("a"), d), vector(ord("b"), d)
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    wanted = bind(space, a, b) + bind(a, b, space)
    got = language_id.text_vectors(["  AB!", "", "12", "ab ab"], d)
    assert (got[0] == wanted).all() and not got[1].any() and not got[2].any()
    assert (got[3] == 2 * wanted + bind(b, space, a)).all()


# The pipeline and the registered queries.


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        out.append(docs)
    return out


def test_stages_decide(spark, sf, stages):
    given, spoken, single, apart, clean, pieces = [s.collect() for s in stages]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "benchmark_index", "best_fit_packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert {r.doc_id for r in spoken} == {r.doc_id for r in given if any(map(str.isalpha, r.text or ""))}
    best = {}
    for r in sorted(spoken, key=lambda r: (-len(r.text), r.doc_id)):
        best.setdefault(squeezed(r.text), r.doc_id)
    assert {r.doc_id for r in single} == set(best.values()) and len(single) == len(best)
    groups = plain_groups([(r.doc_id, r.text) for r in single], 5, 80)
    assert {r.doc_id for r in apart} == {doc for doc, _, group in groups if doc == group}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = plain_hits([(r.doc_id, r.text) for r in apart], items)
    assert {r.doc_id for r in clean} == {doc for doc, _, hit, _, _ in hits if not hit}
    assert {r.doc_id for r in pieces} == {r.doc_id for r in clean}


def test_run_gives_the_same(spark, sf, stages):
    found = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, found)) == sorted(map(key, stages[-1].collect()))


def test_pipeline_on_hard_rows(spark, hard, empty, sf):
    for docs in (hard, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialise(stage(spark, docs, sf))
            assert docs.schema == hard.schema
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()


@pytest.mark.parametrize("name", ["op4_benchmark_index", "op8_exact_dedup", "op10_line_dedup", "op11_centroid_clustering", "op13_prefix_trie"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in os.listdir(sf):
        con.execute(f"create view {table[:-8]} as select * from '{sf}/{table}'")
    df = entry.queries()[name](spark, sf)
    rel = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, rel.fetchall())


@pytest.mark.parametrize("name", ["op1_ngram_join", "op8_exact_dedup"])
def test_sql_of_hard_rows(hard, rows, tmp_path, name):
    """Repeated and null ids, null and blank texts mean the same in SQL."""
    hard.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    df = entry.queries()[name](hard.sparkSession, str(tmp_path))
    assert rows_of(df.columns, df.collect()) == rows_of(names, rel.fetchall())


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
