"""Calendar export: one all-day entry a listing, its end exclusive."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources import publish


def escaped(c: Column) -> Column:
    """Text of an iCalendar property."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, safe in ((";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def calendar_entries(rows: DataFrame) -> DataFrame:
    """(uid, entry) of rows (uid, title, start_date, end_date) with a date."""
    stamp = lambda d: F.date_format(d, "yyyyMMdd")
    first, last = F.coalesce("start_date", "end_date"), F.coalesce("end_date", "start_date")
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("uid")), F.concat(F.lit("SUMMARY:"), escaped(F.col("title"))), F.concat(F.lit("DTSTART;VALUE=DATE:"), stamp(first)), F.concat(F.lit("DTEND;VALUE=DATE:"), stamp(F.date_add(last, 1))), F.lit("END:VEVENT")]
    return rows.filter(first.isNotNull()).select("uid", F.concat_ws("\r\n", *lines).alias("entry"))


def calendar_link(title: Column, first: Column, last: Column, base: str) -> Column:
    """A link that opens a calendar's form for a listing."""
    stamp = lambda d: F.date_format(d, "yyyyMMdd")
    return F.concat(F.lit(base), F.lit("?action=TEMPLATE&text="), F.url_encode(title), F.lit("&dates="), stamp(first), F.lit("/"), stamp(F.date_add(last, 1)))


def write_lines(lines: DataFrame, root: str, end: str = "\n") -> dict:
    """Write a table of one text column as text files that become the current ones at once: {"version", "files", "lines"}. Tasks write to a stage of their
    own and Spark commits one attempt of each; then the list of files, with their sizes, is moved into place. A retried task or a writer that dies leaves no
    second copy that a reader of the list could see."""
    spark = lines.sparkSession
    (column,) = lines.columns
    folder = f"{root}/text-{uuid.uuid4().hex[:12]}"
    lines.select(F.col(column).alias("value")).write.option("lineSep", end).text(folder)
    files = spark.read.format("binaryFile").load(folder).select("path", "length").orderBy("path").collect()
    told = {"files": [[r.path, r.length] for r in files if r.length], "end": end}
    publish.put(spark, f"{root}/FILES", json.dumps(told))
    return told


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """(file, line) of the current files, as they were listed. One that is missing or of another size fails."""
    told = json.loads(spark.read.text(f"{root}/FILES", wholetext=True).first()[0])
    paths = [p for p, _ in told["files"]]
    if not paths:
        return spark.createDataFrame([], "file string, line string")
    sizes = {r.path: r.length for r in spark.read.format("binaryFile").load(paths).select("path", "length").collect()}
    wrong = [p for p, n in told["files"] if sizes.get(p) != n]
    if wrong:
        raise ValueError(f"not as listed: {wrong[:3]}")
    return spark.read.option("lineSep", told["end"]).text(paths).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def calendar_file(rows: DataFrame, root: str) -> dict:
    """The feed of rows (uid, title, start_date, end_date) as files of lines that end in CR LF."""
    return write_lines(calendar_entries(rows).select("entry"), root, "\r\n")
