"""Reading demand, station and weather files."""

from __future__ import annotations

import csv
import warnings
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of each file family, as the publishers name them.
NG_COLUMNS = {
    "SETTLEMENT_DATE": "string",
    "SETTLEMENT_PERIOD": "int",
    "ND": "double",
    "ENGLAND_WALES_DEMAND": "double",
}
NY_COLUMNS = {"Time Stamp": "string", "Integrated Load": "double"}
NY_ZONE = "Name"
STATION_COLUMNS = {"USAF": "string", "LATITUDE": "double", "LONGITUDE": "double"}
WEATHER_KEYS = {"USAF": "string", "Date": "string", "HrMn": "string"}
WEATHER_VARIABLES = {"W_Spd": "float", "Air_Temp": "float", "Dew_temp": "float", "RHx": "int"}

SETTLEMENT_SECONDS = 1800
WHOLE_FILE = 1 << 50  # bytes, above the size of any file

# Accepted spellings of free-format time stamps, pattern of the text -> format.
TIME_FORMATS = {
    r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$": "M/d/yyyy H:mm:ss",
    r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$": "M/d/yyyy H:mm",
    r"^\d{1,2}/\d{1,2}/\d{4}$": "M/d/yyyy",
    r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}$": "yyyy-M-d H:mm:ss",
    r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}$": "yyyy-M-d H:mm",
    r"^\d{4}-\d{1,2}-\d{1,2}$": "yyyy-M-d",
}


class FileLoadError(Exception):
    """A file or folder could not be loaded."""


def combine(old: DataFrame | None, new: DataFrame, mode: str = "append") -> DataFrame:
    """New rows before the old ones ("append"), or instead of them ("replace")."""
    if mode not in ("append", "replace"):
        raise FileLoadError(f"load mode {mode!r} is not valid; use 'append' or 'replace'")
    return new.unionByName(old) if mode == "append" and old is not None else new


def _first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(header, base, folders, file): the first line of each file that has one, read by a task per file that stops there.

    `base` is the folder above the `name=value` folders in which the file lies, `folders` their names.
    """
    own = spark.newSession()
    # One split for each file and one file for each task, so that no task reads past its first line.
    own.conf.set("spark.sql.files.maxPartitionBytes", WHOLE_FILE)
    own.conf.set("spark.sql.files.openCostInBytes", WHOLE_FILE)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from islice((batch for batch in batches if batch.num_rows), 1)

    lines = own.read.text(paths).select(F.col("value").alias("header"), F.col("_metadata.file_path").alias("file"))
    found = lines.mapInArrow(first, "header string, file string")
    return found.select(
        "header",
        F.regexp_extract("file", "^(.*?)/[^/=]+=[^/]*/", 1).alias("base"),
        F.array_join(F.regexp_extract_all("file", F.lit("(?<=/)([^/=]+)=[^/]*/"), 1), "/").alias("folders"),
        "file",
    )


def _kinds(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str, list[str], list[str]]]:
    """(first line, base folder, names of folders, paths) of each group of files that one scan can read.

    With one kind of file only its first line reaches the driver; else also the
    names of the files, as in listing them.
    """
    files = _first_lines(spark, paths)
    kind = ["header", "base", "folders"]
    some = files.groupBy(*kind).agg(F.lit(None).alias("file")).limit(2).collect()
    rows = some if len(some) < 2 else files.orderBy("file").collect()
    found: dict[tuple, list[str]] = {}
    for row in rows:
        found.setdefault(tuple(row[k] for k in kind), []).append(row["file"])
    return [
        (header, unquote(base), unquote(folders).split("/"), [unquote(f) for f in same] if len(some) > 1 else list(paths))
        for (header, base, folders), same in found.items()
    ]


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: dict[str, str],
    malformed: str = "FAILFAST",
    lineage: bool = False,
) -> DataFrame:
    """Named columns of CSV files; a folder stands for the files in it.

    Columns are found by name in every file: files with other columns, or the
    same in another order, may be read together. Files with the same first line
    share one scan. Column names may carry blanks. A column that is not in the files may
    be the name of `name=value` folders below a folder that is asked for; its values stay
    text as they are. A value that does not fit its
    type is an error, or drops its row with `malformed="DROPMALFORMED"`.
    `lineage` adds `file` and `ingest_ord`, the order of rows as read.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        files = spark.read.text(paths).inputFiles()
    except AnalysisException as error:
        raise FileLoadError(f"no readable file or folder in {paths}") from error
    if not files:
        raise FileLoadError(f"no files in {paths}")
    kinds = _kinds(spark, paths)
    if not kinds:
        raise FileLoadError(f"no lines in {paths}")
    parts = [_read_alike(spark, *kind, columns, malformed, lineage) for kind in kinds]
    return reduce(DataFrame.unionByName, parts)


def _read_alike(
    spark: SparkSession,
    header: str,
    base: str,
    folders: list[str],
    paths: list[str],
    columns: dict[str, str],
    malformed: str,
    lineage: bool,
) -> DataFrame:
    """`read_csv` of files with the same header."""
    names = [name.strip() for name in next(csv.reader([header]))]
    # Named by place, so that names may be doubled, blank or hold dots.
    actual = {name: f"_c{names.index(name)}" for name in names}
    missing = [name for name in columns if name not in actual and name not in folders]
    if missing:
        raise FileLoadError(f"columns {missing} are not in {paths}")
    given = [name for name in columns if name not in actual]
    fields = [f"_c{k} string" for k in range(len(names))] + [f"`{name}` string" for name in given]
    scan = spark.read.option("header", True).option("nullValue", "").schema(", ".join(fields))
    raw = (scan.option("basePath", base) if given else scan).csv(paths)
    actual |= {name: name for name in given}

    def typed(name: str) -> Column:
        text = F.col(f"`{actual[name]}`")
        if columns[name] == "string":
            return text
        text = F.when(F.lower(F.trim(text)) == "nan", None).otherwise(F.trim(text))
        return text.cast(columns[name]) if malformed == "FAILFAST" else text.try_cast(columns[name])

    if malformed == "DROPMALFORMED":
        for name in columns:
            text = F.col(f"`{actual[name]}`")
            raw = raw.filter(text.isNull() | (F.lower(F.trim(text)) == "nan") | typed(name).isNotNull())
    out = [typed(name).alias(name) for name in columns]
    if lineage:
        out += [
            F.col("_metadata.file_path").alias("file"),
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("ingest_ord"),
        ]
    return raw.select(*out)


def read_present(spark: SparkSession, paths: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Like `read_csv`, but files that are not there are skipped with a warning."""
    out = None
    for path in paths:
        try:
            part = read_csv(spark, path, columns)
        except FileLoadError as error:
            warnings.warn(f"skipping {path}: {error}")
            continue
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileLoadError(f"no valid data in {list(paths)}")
    return out


def read_ng_demand(spark: SparkSession, paths, **options) -> DataFrame:
    """Half-hourly demand of Great Britain."""
    return read_csv(spark, paths, NG_COLUMNS, **options)


def read_ny_load(spark: SparkSession, paths, zones: bool = False, **options) -> DataFrame:
    """Hourly load of New York zones; `zones` keeps the zone name of unsplit files."""
    columns = {NY_ZONE: "string"} | NY_COLUMNS if zones else NY_COLUMNS
    return read_csv(spark, paths, columns, **options)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station list in columns separated by blanks, named by its first line."""
    lines = spark.read.text(path).withColumn("words", F.split(F.trim("value"), r"\s+"))
    is_header = F.array_contains("words", "USAF")
    header = lines.filter(is_header).select("words").first()
    if header is None:
        raise FileLoadError(f"{path} has no header line with USAF")
    places = {name: header["words"].index(name) for name in STATION_COLUMNS}
    return lines.filter(~is_header & (F.col("value") != "")).select(
        *[F.get("words", F.lit(places[name])).cast(type_).alias(name) for name, type_ in STATION_COLUMNS.items()]
    )


def read_weather(
    spark: SparkSession, paths, variables: Sequence[str] = ("W_Spd", "Air_Temp", "Dew_temp"), **options
) -> DataFrame:
    """Keys and requested variables of observation files."""
    columns = WEATHER_KEYS | {v.strip(): WEATHER_VARIABLES[v.strip()] for v in variables}
    return read_csv(spark, paths, columns, **options)


def parse_settlement_period(raw: DataFrame) -> DataFrame:
    """Date text and half-hour number (1 is midnight) become `Period`."""
    zero = F.lit(0)
    minutes = (F.col("SETTLEMENT_PERIOD") - 1) * (SETTLEMENT_SECONDS // 60)
    day = F.to_timestamp_ntz("SETTLEMENT_DATE", F.lit("dd-MMM-yyyy"))
    return raw.withColumn("Period", day + F.make_dt_interval(zero, zero, minutes, F.lit(0).cast("decimal(18,6)"))).drop(
        "SETTLEMENT_DATE", "SETTLEMENT_PERIOD"
    )


def parse_time_stamp(raw: DataFrame, column: str = "Time Stamp") -> DataFrame:
    """Free-format time stamps become `Period`; a text in no known format is an error."""
    text = F.col(f"`{column}`")
    period = F.when(text.isNull(), None)
    for pattern, format_ in TIME_FORMATS.items():
        period = period.when(text.rlike(pattern), F.to_timestamp_ntz(F.translate(text, "T", " "), F.lit(format_)))
    unknown = F.raise_error(F.concat(F.lit("unknown time stamp: "), text)).cast("timestamp_ntz")
    return raw.withColumn("Period", period.otherwise(unknown)).drop(column)
