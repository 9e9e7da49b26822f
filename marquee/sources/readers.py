"""Readers and writers of the listing files: all-text CSV and JSON landed under a declared schema, typed by a column map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions import casts


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """RFC 4180 CSV, every cell as text: quotes, doubled quotes and line breaks in quotes; short rows are padded, blank rows
    dropped and header names trimmed. With `columns`, unknown ones are ignored and missing ones are null.

    A file with line breaks in cells can't be split; land it as Parquet before large jobs."""
    raw = _cells(spark, path)
    if columns is None:
        return raw.na.drop("all")
    return raw.select(*[F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns]).na.drop("all")


def _cells(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", inferSchema=False).csv(path)
    names = [c.strip().removeprefix("﻿") for c in raw.columns]
    return raw.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, names, strict=True)], *more)


def in_file_order(spark: SparkSession, path: str, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cells of one or more CSV files with row_no, the place of the row from 0: files in the order of their names, and rows as they stand in them,
    blank ones left out. A file is read by one task, in order, so its rows' places need no sort; the driver gets a row for each file. `save`
    writes a table and reads it again."""
    raw = _cells(spark, path, F.col("_metadata.file_path").alias("_file"))
    cells = [c for c in raw.columns if c != "_file"]
    rows = save(raw.na.drop("all", subset=cells).withColumn("_at", F.monotonically_increasing_id()))
    base, at = [], 0
    for r in rows.groupBy("_file").agg(F.min("_at").alias("first"), F.count("*").alias("n")).orderBy("_file").collect():
        base.append((r["_file"], at - r["first"]))
        at += r["n"]
    bases = F.broadcast(spark.createDataFrame(base, "_file string, _shift long"))
    return rows.join(bases, "_file").withColumn("row_no", F.col("_at") + F.col("_shift")).drop("_file", "_at", "_shift")


def load_set(spark: SparkSession, path: str, columns: dict[str, tuple[str, str]], save: Callable[[DataFrame], DataFrame], tab: str | None = None, title: str = "title", untitled: str | None = None) -> DataFrame:
    """A listing set's files, typed, with row_no from the files' order and `untitled` for blank titles; with a `tab`, that and the positional key too. A path that
    is missing or has no rows raises ValueError, as a set must not vanish unseen."""
    try:
        raw = in_file_order(spark, path, save)
    except AnalysisException as e:
        raise ValueError(f"{path} can't be read") from e
    if raw.isEmpty():
        raise ValueError(f"{path} has no rows")
    rows = typed(raw, {**columns, "row_no": ("row_no", "keep")})
    if tab is not None:
        rows = rows.withColumns({"tab": F.lit(tab), "key": F.concat(F.lit(f"{tab}-"), F.col("row_no").cast("string"))})
    return rows.withColumn(title, F.coalesce(title, F.lit(untitled))) if untitled is not None else rows


def file_times(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(dataset, modified) of the newest file below each path, as the file system tells it; no file is opened."""
    out = None
    for name, path in paths.items():
        own = spark.read.format("binaryFile").load(path).agg(F.lit(name).alias("dataset"), F.max("modificationTime").alias("modified"))
        out = own if out is None else out.union(own)
    return out


MASTER = {"name": ("name", "txt"), "pref": ("pref", "txt"), "area": ("area", "txt"), "lat": ("lat", "num"), "lng": ("lng", "num"), "url": ("url", "txt")}
# Fixed value: how a theatre without a name is called.
NO_NAME = "(店舗名未設定)"


def theatres(raw: DataFrame) -> DataFrame:
    """The master of theatres; one without a name gets a default."""
    return typed(raw, {"chain": ("chain", "txt"), **MASTER}).withColumn("name", F.coalesce("name", F.lit(NO_NAME)))


def venues(raw: DataFrame) -> DataFrame:
    """The master of venues; rows without a name are dropped."""
    own = {k: v for k, v in MASTER.items() if k != "name"}
    return typed(raw, {"venue": ("venue", "txt"), "kind": ("kind", "txt"), **own, "capacity": ("capacity", "int")}).filter(F.col("venue").isNotNull())


def all_sets(sets: dict[str, DataFrame]) -> DataFrame:
    """Several sets as one, each row with its `tab`; columns that a set lacks are null there."""
    out = None
    for tab, rows in sets.items():
        own = rows.withColumn("tab", F.lit(tab))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def japan_date(instant: Column) -> Column:
    """The calendar day in Japan of an instant."""
    return F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(instant, F.current_timezone()), "Asia/Tokyo"))


def typed(raw: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Apply a column map {output: (column, cast)}; casts are those of `marquee.functions.casts`. A missing column is null."""

    def one(out: str, source: str, cast: str) -> Column:
        cell = F.col(f"`{source}`") if source in raw.columns else F.lit(None).cast("string")
        return (cell if cast == "keep" else casts.CASTS[cast](cell)).alias(out)

    return raw.select(*[one(out, *spec) for out, spec in columns.items()])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines. Strict reading fails on a bad line; else bad lines come in `_corrupt_record` for a quarantine."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of arrays of sites -> (section, name, url, role); entries that aren't arrays are skipped."""
    raw = spark.read.option("multiLine", True).json(path)
    sections = [f for f in raw.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    part = lambda f, c: F.col(f"x.{c}").cast("string") if c in f.dataType.elementType.names else F.lit(None).cast("string")
    each = [raw.select(F.lit(f.name).alias("section"), F.explode(F.col(f"`{f.name}`")).alias("x")).select("section", *[part(f, c).alias(c) for c in ("name", "url", "role")]) for f in sections]
    out = each[0]
    for e in each[1:]:
        out = out.union(e)
    return out


def write_listing(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Append as CSV with every cell quoted, in the given order of columns."""
    rows.select(*columns).write.mode("append").options(header=True, quoteAll=True, escape='"').csv(path)


def freshness(files: DataFrame, manifest: DataFrame, zone: str = "Asia/Tokyo") -> DataFrame:
    """(dataset, updated): the manifest's value, else the file's time, as a date of `zone`; a bare date is not shifted.
    `files` has (dataset, modified timestamp), `manifest` (dataset, value string)."""
    stamp = F.to_date(F.from_utc_timestamp(F.try_to_timestamp("value"), zone))
    value = F.when(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("value")).otherwise(stamp)
    return files.join(manifest, "dataset", "left").select("dataset", F.coalesce(value, F.to_date(F.from_utc_timestamp("modified", zone))).alias("updated"))
