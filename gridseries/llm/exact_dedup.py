"""Exact duplicates by content sort.

Sampled splitters range-partition the normalised texts (by their first
characters and a hash, so that a sample is small however long the texts are),
Spark's external sort places equal texts next to each other, and a window
compares neighbouring texts in full. A text with very many copies is first cut into pieces that are sorted
on their own; only one row per piece is merged afterwards.

Built from DataFrame functions alone. Cases: a null text counts as empty; all
empty texts are one group; a null id is ordered after every other id; of
repeated rows exactly one is kept; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.session import materialise

WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
PIECE_ROWS = 512
HEAD = 16
MOST_SPLIT_TEXTS = 100_000


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for char in WHITE:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def _split_texts(rows: DataFrame, piece_rows: int) -> DataFrame:
    """Hash of every text with more copies than a piece may hold, and its number of pieces.

    A piece grows with the table only so far that at most `MOST_SPLIT_TEXTS`
    texts can be longer than one, so this table may be broadcast.
    """
    counts = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > piece_rows)
    counts = materialise(counts, "copies")
    size = piece_rows
    while counts.filter(F.col("_copies") > size).count() > MOST_SPLIT_TEXTS:
        size *= 2
    return counts.filter(F.col("_copies") > size).select(
        "_hash", F.ceil(F.col("_copies") / size).cast("long").alias("_pieces")
    )


def _rows(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[Column] = ()) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"),
        normalised(F.col(text_col)).alias("_norm"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_points"),
        *carry,
    ).withColumn("_hash", F.xxhash64("_norm"))


def _sorted_pieces(rows: DataFrame, split: DataFrame, how: str = "left") -> DataFrame:
    """Rows with their place (`_row`) in a piece of equal texts, that piece's size and its first row's id."""
    salted = rows.join(F.broadcast(split), "_hash", how).select(
        "*", F.when(F.col("_pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_id"), "_pieces")).alias("_piece")
    )
    splitter = ["_head", "_hash", "_piece"]
    ordered = salted.withColumn("_head", F.substring("_norm", 1, HEAD)).repartitionByRange(*splitter)
    best_first = Window.partitionBy(*splitter, "_norm").orderBy(F.desc("_points"), F.asc_nulls_last("_id"))
    whole = best_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ordered.select(
        "*",
        F.row_number().over(best_first).alias("_row"),
        F.first("_id").over(whole).alias("_best"),
        F.count(F.lit(1)).over(whole).alias("_size"),
    ).withColumn("_digest", F.sha2("_norm", 256))


def _merged(pieces: DataFrame) -> DataFrame:
    """One row per split text: the piece that holds its best row, that row's id, the number of copies."""
    rank = F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("n"), "_id", "_piece")
    return (
        pieces.filter(F.col("_pieces").isNotNull() & (F.col("_row") == 1))
        .groupBy("_digest")
        .agg(F.min(rank).alias("_top"), F.sum("_size").alias("_all"))
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical without ASCII white space. The row with the
    most code points stays, then the least id.
    """
    rows = _rows(docs, id_col, text_col)
    pieces = _sorted_pieces(rows, _split_texts(rows.select("_hash"), piece_rows)).select(
        "_id", "_digest", "_points", "_piece", "_pieces", "_row", "_best", "_size"
    )
    pieces = materialise(pieces, "pieces")
    top = F.broadcast(_merged(pieces))
    return pieces.join(top, "_digest", "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("_top").isNull(), F.col("_best")).otherwise(F.col("_top._id")).alias("keep_id"),
        F.coalesce("_all", "_size").alias("group_size"),
        ((F.col("_row") == 1) & (F.col("_top").isNull() | (F.col("_top._piece") == F.col("_piece")))).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """The rows of `docs` that `exact_dedup` keeps, with all their columns.

    Only the rows of split texts are sorted twice, to settle which piece has the
    best one; no text is written between.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    carry = [F.col(f"`{name}`").alias(short) for name, short in zip(docs.columns, names, strict=True)]
    rows = _rows(docs, id_col, text_col)
    split = _split_texts(rows.select("_hash"), piece_rows)
    heads = _sorted_pieces(rows, split, "inner").select("_id", "_digest", "_points", "_piece", "_pieces", "_row", "_size")
    top = F.broadcast(materialise(_merged(heads).select("_digest", "_top"), "tops"))
    first = _sorted_pieces(_rows(docs, id_col, text_col, carry), split).filter(F.col("_row") == 1)
    return (
        first.join(top, "_digest", "left")
        .filter(F.col("_top").isNull() | (F.col("_top._piece") == F.col("_piece")))
        .select(*[F.col(short).alias(name) for name, short in zip(docs.columns, names, strict=True)])
    )
