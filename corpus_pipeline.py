"""A corpus pipeline: language identification, near-duplicate removal, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import decontam, langid, packing, secrets, sigtree
from marquee.llm.common import BATCHES, fresh, saved, small_batches, table
from marquee.llm.queries import tokenizer


def batches_stay_small(spark: SparkSession) -> None:
    """What a stage returns is run by its caller; so that its texts go to Python in small batches then, the session is set so. run() puts the
    session's own settings back."""
    for k, v in BATCHES.items():
        spark.conf.set(k, v)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predict each text's language by compression and drop what is rejected; lang becomes the predicted one."""
    batches_stay_small(spark)
    model = langid.fit(docs, langid.fold() != 2)
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]  # none of them is named like an answer; each text is sent once
    told = langid.predict(docs.toDF(*names), model).filter("not rejected")
    return told.select(*[F.col("lang_pred" if c == "lang" else n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by five-word shingles: that of the smallest id, a null id being the largest. Rows are told apart
    by id and text: of an id's several texts in a group one stays, of repeated rows any one. Rows in no group all stay."""
    members, _ = sigtree.join(docs.select("doc_id", "text"))
    k1 = decontam.key(members.withColumn("text", F.lit(None)))[0]
    rows = saved(members.filter("grp is not null").groupBy("grp", "doc_id", "k2").agg(F.count("*").alias("n")), "grouped-rows")
    keeper = rows.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k2")).alias("x")).select("grp", F.col("x.doc_id").alias("_id"), F.col("x.k2").alias("_k2"))
    keeper = decontam.checked(saved(keeper, "keepers"))
    kept = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k2") == F.col("_k2"))
    keys = fresh(docs, "k1", "k2")
    told = saved(rows.join(keeper, "grp").select(k1.alias("k1"), "k2", "n", kept.alias("kept")), "duplicates")
    keyed = docs.withColumns(dict(zip(keys, decontam.key(docs), strict=True)))
    # keys alone are compared, and sent to the texts where they are few enough
    others = decontam.checked(saved(told.filter("not kept or n > 1").select("k1", "k2").distinct().toDF(*keys), "others"))
    twice = decontam.checked(saved(told.filter("kept and n > 1").select("k1", "k2").toDF(*keys), "twice"))
    copies = keyed.join(twice, keys, "left_semi").dropDuplicates(keys)
    return keyed.join(others, keys, "left_anti").select(*docs.columns).union(copies.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten words in a row of a benchmark item, or a whole shorter item."""
    found = decontam.report(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    keys = fresh(docs, "k1", "k2")
    hit = saved(found.filter("contaminated").select("k1", "k2").distinct().toDF(*keys), "contaminated")
    keyed = docs.withColumns(dict(zip(keys, decontam.key(docs), strict=True)))
    return keyed.join(decontam.checked(hit), keys, "left_anti").select(*docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into sequences along the Hilbert curve: a row for each piece."""
    batches_stay_small(spark)
    return packing.pieces(packing.pack(docs, tokenizer("word_bpe_49k.json")))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_redaction),
    ("packing", packed),
]

#: SQL has neither compression nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES:
            docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
