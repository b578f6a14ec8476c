"""Walking through Arrow batches in slices of bounded text size."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with a long id and empty text for null; whatever else `docs` holds is left out."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive rows, in order, with at most `SLICE_BYTES` of `column` together (or a single row)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            before = ends[at] - sizes[at]
            until = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(at, until - at)
            at = until


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, so that their Python tasks can import it."""
    context = spark.sparkContext
    if getattr(context, "_gridseries_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="gridseries-code-")) / "gridseries.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._gridseries_shipped = True
