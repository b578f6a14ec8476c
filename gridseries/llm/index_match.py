"""Benchmark decontamination with a distributed positional inverted index.

The index holds postings (term, document, position) of the training texts. Each
window of a benchmark item is looked up from its rarest terms: the postings of
its two rarest terms are shifted by the terms' places in the item and
intersected, which leaves few (document, item, start) candidates. Up to here
terms are spelled in lower case by Spark's own function, with one spelling of
sigma because lower case depends on what surrounds it; that can only let more
words be equal. Only the texts that still have candidates are read again; there
the postings of all exactly spelled terms of the item are intersected along the
candidate, and unbroken stretches of matched terms are exact phrase matches. Postings of terms that no window needs are never
made, so the index is as small as the benchmark allows.

The lists of terms are joined; Spark broadcasts them only while their written
size is below its limit. No list of a term is gathered: postings stay rows.

Cases: a null text has no words; an item without words matches nothing; an item
shorter than a window is one window; equal items are matched separately; empty
tables give empty results (or documents without hits); other columns are
ignored. Places belong to a row, an id with the hash of its text: repeated rows
have the same places, and different texts of one id do not mix theirs. A
document's hits are those of all texts of its id; a document without an id has
those of its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.session import match, materialise

WINDOW = 10
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _cut(text: Column) -> Column:
    """A text in lower case cut into words; the last one is empty if the text ends between words."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "^" + BETWEEN_WORDS, ""), BETWEEN_WORDS)


def exact(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def loose(text: Column) -> Column:
    """Quicker than `exact`; words equal under `exact` are equal under it, whatever stands around them."""
    # Lower case alone turns a capital sigma into a final one by the characters beside it, even across words.
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    words = _cut(F.lower(text))
    return (F.size(words) - F.when(F.element_at(words, -1) == "", 1).otherwise(0)).cast("long")


def row_key(text: Column) -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def postings(texts: DataFrame, spelling=exact) -> DataFrame:
    """(id, row, term, pos) of every word of (id, row, text).

    `loose` as spelling is quicker and lets more words be equal than `exact`.
    """
    words = texts.select("id", "row", _cut(spelling(F.col("text"))).alias("words"))
    # The outer form keeps the planner from cutting every text a second time, only to drop those without words.
    return words.select("id", "row", F.posexplode_outer("words").alias("pos", "term")).filter(F.col("term") != "")


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, loose, offset, n) of each word of the distinct rows of (item_id, text).

    `loose` is the term as the function `loose` spells it.
    """
    words = items.distinct().select(
        F.xxhash64("item_id", "text").alias("item"),
        "item_id",
        _cut(exact(F.col("text"))).alias("words"),
        n_words(F.col("text")).cast("int").alias("n"),
    )
    spread = words.select("item", "item_id", "n", F.posexplode("words").alias("offset", "term"))
    return spread.filter(F.col("term") != "").withColumn("loose", loose(F.col("term")))


def _anchors(terms: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """(term, item, offset, needed), loosely spelled: the two rarest places of each window that can occur at all."""
    known = terms.join(frequency, "loose", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    last = F.greatest(F.col("n") - window, F.lit(0))
    first = F.greatest(F.col("offset") - (window - 1), F.lit(0))
    inside = known.withColumn("start", F.explode(F.sequence(first, F.least(F.col("offset"), last))))
    rarest = Window.partitionBy("item", "start").orderBy("df", "offset")
    of_window = Window.partitionBy("item", "start")
    ranked = inside.select(
        "*", F.row_number().over(rarest).alias("rank"), F.min("df").over(of_window).alias("least")
    ).filter((F.col("least") > 0) & (F.col("rank") <= 2))
    return ranked.select(F.col("loose").alias("term"), "item", "offset", F.least(F.col("n"), F.lit(2)).alias("needed")).distinct()


def own_key(doc_id: Column, row: Column) -> Column:
    """The row key of documents without an id, which share no hits; null for all others."""
    return F.when(doc_id.isNull(), row)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text)."""
    return docs.select(F.col(id_col).alias("id"), row_key(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))


def _row_matches(texts: DataFrame, named: DataFrame, window: int) -> DataFrame:
    """(id, row, item_id, first, last) of the texts (id, row, text) and the items (item_id, text)."""
    terms = materialise(item_terms(named), "terms")
    vocabulary = materialise(terms.select(F.col("loose").alias("term")).distinct(), "vocabulary")
    met = postings(texts, loose).join(vocabulary, "term")
    frequency = met.groupBy(F.col("term").alias("loose")).agg(F.count(F.lit(1)).alias("df"))
    frequency = materialise(frequency, "frequency")
    anchors = materialise(_anchors(terms, frequency, window), "anchors")
    shifted = postings(texts, loose).join(anchors, "term")
    candidates = (
        shifted.groupBy("id", "row", "item", (F.col("pos") - F.col("offset")).alias("start"))
        .agg(F.count(F.lit(1)).alias("met"), F.max("needed").alias("needed"))
        .filter(F.col("met") >= F.col("needed"))
        .select("id", "row", "item", "start")
    )
    candidates = materialise(candidates, "candidates")
    again = match(texts, candidates.select("id", "row").distinct(), ["id", "row"], "left_semi")
    met = postings(again).join(terms, "term").withColumn("start", F.col("pos") - F.col("offset"))
    along = match(met, candidates, ["id", "row", "item", "start"], "left_semi")
    # Repeated rows give each place several times.
    along = along.dropDuplicates(["id", "row", "item", "start", "pos"])
    line = Window.partitionBy("id", "row", "item", "start").orderBy("pos")
    runs = along.withColumn("run", F.col("pos") - F.row_number().over(line))
    return (
        runs.groupBy("id", "row", "item", "item_id", "start", "run")
        .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("n").alias("n"))
        .filter(F.col("last") - F.col("first") + 1 >= F.least(F.col("n"), F.lit(window)))
        .select("id", "row", "item_id", "first", "last")
    )


def phrase_matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """(id, item_id, first, last): stretches of document words that some windows of an item cover."""
    named = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    matches = _row_matches(_rows(docs, id_col, text_col), named, window)
    return matches.select(F.col("id").alias(id_col), "item_id", "first", "last")


def hit_rows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, own) of the documents (doc_id, text) that hold a window of an item (item_id, text); `own` as `own_key` gives it."""
    matches = _row_matches(_rows(docs, "doc_id", "text"), items.select("item_id", "text"), window)
    return matches.select("id", own_key(F.col("id"), F.col("row")).alias("own")).distinct()


def proximity_matches(
    docs: DataFrame,
    items: DataFrame,
    within: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item_id, first, last): spans of at most `within` words that hold all terms of an item, in any order.

    `last` is the place where a span is complete; `first` the earliest place it may use.
    """
    texts = _rows(docs, id_col, text_col)
    named = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    terms = item_terms(named).groupBy("item", "item_id", "term").agg(F.min("offset").alias("offset"))
    sizes = terms.groupBy("item").agg(F.count(F.lit(1)).alias("n_terms"))
    terms = materialise(terms.join(sizes, "item"), "terms")
    near = Window.partitionBy("id", "row", "item").orderBy("pos").rangeBetween(1 - within, 0)
    met = postings(texts).join(terms, "term").withColumn("met", F.size(F.collect_set("term").over(near)))
    return met.filter(F.col("met") == F.col("n_terms")).select(
        F.col("id").alias(id_col), "item_id", F.greatest(F.col("pos") - (within - 1), F.lit(0)).alias("first"), F.col("pos").alias("last")
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per document: (id, n_words, n_hit, n_items, item_ids), item ids as sorted strings."""
    texts = _rows(docs, id_col, text_col)
    named = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    matches = materialise(_row_matches(texts, named, window), "matches")
    owned = matches.withColumn("own", own_key(F.col("id"), F.col("row")))
    hits = (
        owned.select("id", "own", "first", "last")
        .distinct()
        .select("id", "own", F.explode(F.sequence("first", "last")).alias("pos"))
        .groupBy("id", "own")
        .agg(F.count_distinct("pos").alias("n_hit"))
    )
    found = owned.groupBy("id", "own").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    counted = texts.select("id", own_key(F.col("id"), F.col("row")).alias("own"), n_words(F.col("text")).alias("n_words"))
    return (
        match(counted, match(hits, found, ["id", "own"]), ["id", "own"], "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
    )
