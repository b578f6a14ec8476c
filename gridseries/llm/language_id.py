"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that depends on its code point
alone. A three-letter sequence is bound to one vector by multiplying the first
letter's vector rotated twice, the second's rotated once and the third's. A text
is the sum of its sequences' vectors, a language the sum of its texts'; a text
gets the language whose vector has the greatest cosine with its own.

Letters are lower-cased; everything between them counts as one space. Sums are
of whole numbers, so they do not depend on the order in which tasks finish. What
the driver sees is one vector per language.

Cases: a null text or one without a letter is `und` with score 0, as is every
text when there is nothing to learn from; rows without a language are not learned
from; a null id counts as the empty string; equal scores go to the first language
by name; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.llm.batches import slices

DIMENSIONS = 1024
BLOCK_DOCS = 512
MOST_LANGUAGES = 1000
UNKNOWN = "und"
SEED = 20240229


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(code).isalpha() for code in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=1 << 14)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The +1/-1 vector of a code point (0: the space between words)."""
    return np.random.default_rng((SEED, code)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


def _sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of a block of texts; first places of its three-letter sequences; the text of each."""
    lowered = [text.lower() + "\n" for text in texts]
    joined = " " + "".join(lowered)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, 0)
    owner = np.concatenate([[-1], np.repeat(np.arange(len(texts)), [len(text) for text in lowered])])
    kept = np.flatnonzero((codes[1:] != 0) | (codes[:-1] != 0)) + 1
    kept = np.concatenate([[0], kept])
    codes, owner = codes[kept], owner[kept]
    if len(codes) < 3:
        return codes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = (owner[:-2] == owner[2:]) | ((codes[:-2] == 0) & (owner[1:-1] == owner[2:]))
    first = np.flatnonzero(same)
    return codes, first, owner[first + 2]


def text_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The summed vectors of texts, one row each; zeros for a text without letters."""
    codes, first, owner = _sequences(texts)
    if not len(first):
        return np.zeros((len(texts), dimensions), np.float32)
    alphabet, letters = np.unique(codes, return_inverse=True)
    n = len(alphabet)
    numbers = (letters[first].astype(np.int64) * n + letters[first + 1]) * n + letters[first + 2]
    if n**3 <= 1 << 24:
        used = np.flatnonzero(np.bincount(numbers, minlength=n**3))
        places = np.zeros(n**3, np.int64)
        places[used] = np.arange(len(used))
        which = places[numbers]
    else:
        used, which = np.unique(numbers, return_inverse=True)
    base = np.stack([letter_vector(int(code), dimensions) for code in alphabet])
    once, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    out = np.zeros((len(texts), dimensions), np.float32)
    for at in range(0, len(used), 1 << 14):  # bounds the table of bound vectors for large alphabets
        some = used[at : at + (1 << 14)]
        bound = twice[some // (n * n)] * once[some // n % n] * base[some % n]
        mine = (which >= at) & (which < at + len(some))
        counts = np.bincount(owner[mine] * len(some) + which[mine] - at, minlength=len(texts) * len(some))
        out += counts.reshape(len(texts), len(some)).astype(np.float32) @ bound.astype(np.float32)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, column):
        for at in range(0, batch.num_rows, BLOCK_DOCS):
            yield batch.slice(at, BLOCK_DOCS)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language -> unit vector, from all rows that have a language.

    Raises if there are more than `MOST_LANGUAGES` languages, because one vector
    of each is sent to every task.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in _blocks(batches):
            vectors = text_vectors(batch.column("text").to_pylist(), dimensions).astype(np.float64)
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0)
        for lang, total in sums.items():
            names = pa.array([lang] * dimensions)
            yield pa.RecordBatch.from_arrays([names, pa.array(range(dimensions), pa.int32()), pa.array(total)], ["lang", "place", "value"])

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    parts = rows.filter(F.col("lang").isNotNull()).mapInArrow(bundle, "lang string, place int, value double")
    totals = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found = totals.limit(MOST_LANGUAGES * dimensions + 1).collect()
    if len(found) > MOST_LANGUAGES * dimensions:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    model = {lang: np.zeros(dimensions) for lang in sorted({row["lang"] for row in found})}
    for row in found:
        model[row["lang"]][row["place"]] = row["value"]
    return {lang: vector / max(np.linalg.norm(vector), 1e-12) for lang, vector in model.items()}


def _best(texts: list[str | None], model: dict[str, np.ndarray], dimensions: int) -> tuple[list[str], np.ndarray]:
    """Closest language and cosine, at least 0, of each text."""
    vectors = text_vectors([text or "" for text in texts], dimensions)
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    if not model:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    names = list(model)
    scores = vectors @ np.stack([model[name] for name in names]).astype(np.float32).T
    scores = scores / np.maximum(lengths, 1e-12)[:, None]
    langs = [names[best] if length else UNKNOWN for best, length in zip(scores.argmax(axis=1), lengths, strict=True)]
    return langs, np.where(lengths > 0, np.clip(scores.max(axis=1), 0, 1), 0).astype(np.float64)


def predict(
    docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS
) -> DataFrame:
    """`docs` as (id, lang_pred, score): the closest language and its cosine, at least 0."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            langs, scores = _best(batch.column("text").to_pylist(), model, dimensions)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(score, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_predicted(
    docs: DataFrame,
    model: dict[str, np.ndarray],
    text_col: str = "text",
    accepted: Iterable[str] | None = None,
    least_score: float = 0.0,
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """The rows of `docs`, with all their columns, that are predicted as one of `accepted` (default: any but `und`)."""
    places = [f"_c{i}" for i in range(len(docs.columns))]
    text = docs.columns.index(text_col)
    wanted = set(model) if accepted is None else set(accepted)
    renamed = docs.toDF(*places)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, places[text]):
            langs, scores = _best(batch.column(text).to_pylist(), model, dimensions)
            good = [lang in wanted and score >= least_score for lang, score in zip(langs, scores.tolist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return renamed.mapInArrow(keep, renamed.schema).toDF(*docs.columns)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo `folds`, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS
) -> DataFrame:
    """One row per document: (id, held_out, lang_pred, score), learned from the documents not held out."""
    model = learn(docs.filter(~held_out(F.col(id_col))), text_col, lang_col, dimensions)
    out = predict(docs, model, id_col, text_col, dimensions)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
