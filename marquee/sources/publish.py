"""Publishing tables: versions beside each other, a gate, and one pointer that moves at once.

A publication writes its tables to a folder of their own, reads them again for the gate, and writes a manifest: of every published table, also those that it
takes over from the version before, the folder and the number of rows. Only then the file CURRENT is replaced by one atomic rename, so
readers have all tables of one version or all of the other. A gate that says no, or a writer that dies anywhere before the rename, leaves the version that was
current; its folder stays for inspection and nothing refers to it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and move it into place, replacing one that is there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, own = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}")
    out = own.getFileSystem(conf).create(own, True)
    out.write(bytearray(text.encode()))
    out.close()
    whole = own.getFileSystem(conf).makeQualified(own)
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf).rename(whole, own.getFileSystem(conf).makeQualified(to), how)


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What is current: version, tables, the gate's row and facts; None before the first publication."""
    try:
        return json.loads(spark.read.text(f"{root}/CURRENT", wholetext=True).first()[0])
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The current tables by name."""
    now = manifest(spark, root) or {"tables": {}}
    return {name: spark.read.schema(T.StructType.fromJson(t["schema"])).parquet(t["path"]) for name, t in now["tables"].items()}


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], gate: Callable[[dict[str, DataFrame]], DataFrame] | None = None, facts: dict | None = None, stop: Callable[[str], None] = lambda _: None) -> tuple[bool, dict]:
    """(whether it is current now, its manifest). `gate` gets the written tables and gives one row with a boolean `publish`. `stop` is told of each step that is
    done."""
    before = manifest(spark, root)
    number = (before["version"] if before else 0) + 1
    folder = f"{root}/versions/{number}-{uuid.uuid4().hex[:8]}"
    said = dict(before["tables"]) if before else {}
    written = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        written[name] = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        said[name] = {"path": f"{folder}/{name}", "rows": written[name].count(), "schema": df.schema.jsonValue()}
        stop(name)
    row = gate(written).first().asDict() if gate else {"publish": True}
    told = {"version": number, "tables": said, "gate": row, "facts": {**(before["facts"] if before else {}), **(facts or {})}}
    stop("gate")
    if not row["publish"]:
        return False, told
    put(spark, f"{root}/CURRENT", json.dumps(told, default=str, ensure_ascii=False))
    stop("move")
    return True, told


def next_run(spark: SparkSession, root: str, today: date, listing: str = "listing", previous: str = "previous", dispositions: str = "dispositions") -> bool:
    """Begin a run: the listing is set aside as the previous one, and starts again without rows; what was said about rows that had gone is cleared.
    All of it becomes current together. Without a listing nothing happens."""
    now = manifest(spark, root)
    if now is None or listing not in now["tables"]:
        return False
    tables = current(spark, root)
    empty = {name: tables[name].limit(0) for name in (listing, dispositions) if name in tables}
    moved, _ = publish(spark, root, {previous: tables[listing], **empty}, facts={"taken_at": str(today), "taken": now["tables"][listing]["rows"]})
    return moved
