import random
import zlib

from pyspark.sql import functions as F

from marquee.llm import langid
from marquee.llm.common import table
from marquee.llm.queries import op7_zstd_language

WORDS = {"aa": "the of and that with which have from".split(), "bb": "der die und nicht eine werden über".split(), "cc": "où être même leçon déjà çà voilà".split()}


def text(lang, rng, n=60):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))


def test_held_out_accuracy_on_the_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = op7_zstd_language(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    assert got.rejected.mean() < 0.02


def test_rows_of_every_kind(spark):
    rng = random.Random(3)
    rows = [(i, text(lang, rng), lang) for i, lang in enumerate(sorted(WORDS) * 20)]
    model = langid.fit(spark.createDataFrame([*rows, (99, None, "aa"), (98, text("bb", rng), None), (97, " ", "zz")], "doc_id long, text string, lang string"), F.lit(True))
    assert sorted(model.samples) == sorted(WORDS)
    odd = [(1, None), (2, ""), (3, "12 !? 7"), (8, "\u00bd"), (9, "\u00b2 \u00b3 \u2460 \u2167 _"), (4, text("aa", rng)), (4, text("aa", rng)), (5, text("bb", rng, 20000)), (6, text("cc", rng).upper())]
    docs = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in odd], "doc_id long, text string, lang_pred string, score double")
    got = langid.predict(docs, model).collect()
    assert [r.lang_pred for r in got] == ["und"] * 5 + ["aa", "aa", "bb", "cc"]
    assert [r.rejected for r in got] == [True] * 5 + [False] * 4 and [r.text for r in got] == [t for _, t in odd]


def test_a_language_of_one_repeated_text_is_learned(spark):
    rng = random.Random(6)
    one = text("bb", rng)
    rows = [(i, text("aa", rng), "aa") for i in range(3000)] + [(i, one, "bb") for i in range(5000)] + [(1, "\u00bd \u00be", "cc")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert sorted(model.samples) == ["aa", "bb"] and model.samples["bb"].decode() == langid.normal(one)
    assert model == langid.fit(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string").repartition(5), F.lit(True))


def test_ties_go_to_the_first_language(spark):
    model = langid.LanguageModel({"bb": b"the same sample", "aa": b"the same sample"})
    got = langid.predict(spark.createDataFrame([("the same",)], "text string"), model).first()
    assert (got.lang_pred, got.score, got.rejected) == ("aa", 0.0, True)


def test_nothing_to_learn_or_predict(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(none, F.lit(True))
    assert langid.predict(none, model).count() == 0
    assert langid.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first().lang_pred == "und"


def test_narrow_margins_are_rejected(spark):
    rng = random.Random(4)
    model = langid.LanguageModel({lang: text(lang, rng, 4000).encode() for lang in ("aa", "bb")})
    mixed = spark.createDataFrame([(text("aa", rng, 40) + " " + text("bb", rng, 40),), (text("aa", rng, 40),)], "text string")
    assert [r.rejected for r in langid.predict(mixed, model, 0.3).collect()] == [True, False]


def test_equals_a_plain_loop_over_the_compressor(spark):
    import zstandard

    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, langid.fold() != 2)
    for r in langid.predict(docs.select("doc_id", "text"), model).collect():
        letters, gap = [], False
        for ch in (r.text or "").lower():
            if ch.isalnum() and not ch.isdecimal():
                letters.append(ch)
                gap = False
            elif not gap:
                letters.append(" ")
                gap = True
        whole = "".join(letters)
        if not any(ch.isalpha() for ch in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        sizes = {}
        for lang, sample in model.samples.items():
            content = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=langid.LEVEL)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress(whole[at : at + langid.CHUNK_CHARS].encode())) for at in range(0, len(whole), langid.CHUNK_CHARS))
        first, second = sorted(sizes.items(), key=lambda x: (x[1], x[0]))[:2]
        assert r.lang_pred == first[0] and abs(r.score - (1 - first[1] / second[1])) < 1e-12 and r.rejected == (r.score < langid.MIN_MARGIN)
