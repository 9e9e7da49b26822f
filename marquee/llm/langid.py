"""Language identification by compression.

For each language a bounded sample of labelled texts becomes a zstandard raw-content dictionary. A text, reduced to
its letters in lower case, is cut into chunks and every chunk is compressed with each dictionary; the language of the smallest total is predicted. The score is
1 - smallest / second smallest; below `min_margin` the prediction is marked as rejected.

The sample takes `sample_docs` different texts a language, those of the smallest hash, and `sample_chars` characters of each, from a place
that the hash gives; this bound is a parameter of the fit and the driver holds no more than that. A language of fewer texts gives
all of them. Prediction reads whole texts. A null text and one without a letter (str.isalpha) are `und` with score 0, and rejected; so is
every text if nothing could be learned. A labelled text without a letter teaches nothing. Ties go to the first language in order.
Repeated rows are predicted each. Columns that the input has already are kept unless they are named like the new ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import tidy

SAMPLE_DOCS, SAMPLE_CHARS, CHUNK_CHARS, LEVEL, MIN_MARGIN = 100, 2000, 4096, 3, 0.005
LETTER, OTHER = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]+")  # LETTER also finds some numerals, such as one half


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def normal(text: str) -> str:
    """What is compressed: lower-case letters, and a space for all between."""
    return OTHER.sub(" ", text.lower())


@dataclass
class LanguageModel:
    """Language -> sample bytes."""

    samples: dict[str, bytes] = field(default_factory=dict)

    def sizes(self):
        """A function text -> compressed size under each language, in order of language."""
        import zstandard as zstd

        coders = []
        for lang in sorted(self.samples):
            content = zstd.ZstdCompressionDict(self.samples[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            coders.append(zstd.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

        def total(text: str) -> list[int]:
            text = normal(text)
            chunks = [text[lo : lo + CHUNK_CHARS].encode() for lo in range(0, len(text), CHUNK_CHARS)]
            return [sum(len(coder(c)) for c in chunks) for coder in coders]

        return total


def fit(docs: DataFrame, train: Column, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Learn from text and lang of the rows for which `train` holds and both are there."""
    order = F.xxhash64("text")
    room = F.greatest(F.length("text") - sample_chars + 1, F.lit(1))
    cut = F.col("text").substr((F.pmod(order, room) + 1).cast("int"), F.lit(sample_chars))
    known = docs.filter(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", order.alias("order"), cut.alias("cut"))
    # of each language the texts of the least hashes, first in each of 64 lots of hashes, so that a language of very many texts is no one
    # task's; equal texts are one group, combined before the shuffle
    lot = F.pmod(F.shiftright("order", 7), F.lit(64)).alias("lot")
    texts = known.select("lang", "order").distinct().withColumn("lot", lot)
    few = texts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lot").orderBy("order"))).filter(F.col("rank") <= sample_docs)
    least = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).filter(F.col("rank") <= sample_docs).select("lang", "order", "rank").collect()
    wanted = docs.sparkSession.createDataFrame(least, "lang string, `order` long, rank int")
    ranked = known.join(F.broadcast(wanted), ["lang", "order"]).groupBy("lang", "rank").agg(F.min("cut").alias("cut"))
    samples: dict[str, list] = {}
    for r in ranked.collect():
        samples.setdefault(r["lang"], []).append((r["rank"], r["cut"]))
    return LanguageModel({lang: " ".join(normal(t) for _, t in sorted(own)).encode() for lang, own in samples.items()})


def predict(docs: DataFrame, model: LanguageModel, min_margin: float = MIN_MARGIN) -> DataFrame:
    """`docs` with lang_pred, score and rejected."""
    langs = sorted(model.samples)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        sizes = model.sizes()
        for batch in batches:
            pred, score = [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                if not text or not langs or not has_letter(text):
                    pred.append("und")
                    score.append(0.0)
                    continue
                got = sizes(text)
                best = min(range(len(got)), key=got.__getitem__)
                second = min((x for i, x in enumerate(got) if i != best), default=None)
                pred.append(langs[best])
                score.append(1 - got[best] / second if second else 1.0)
            rejected = [p == "und" or s < min_margin for p, s in zip(pred, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score, pa.float64()), pa.array(rejected)], [*batch.schema.names, "lang_pred", "score", "rejected"])

    kept = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return kept.mapInArrow(answers, schema)


def fold(doc_id: str = "doc_id", folds: int = 4) -> Column:
    """crc32 of a document's id as text, modulo `folds`; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds, F.lit(0))
