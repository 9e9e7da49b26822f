import re

import pytest

import corpus_pipeline
from marquee.llm import decontam, packing, secrets
from marquee.llm.common import saved, table
from tests.llm import test_decontam, test_secrets, test_sigtree

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        got = saved(stage(spark, docs, SF), name)
        out[name] = (docs, got)
        docs = got
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    assert all(got.columns == columns for name, (_, got) in stages.items() if name != "packing")


def test_language_drops_few(stages):
    before, after = stages["language"]
    assert 0.97 * before.count() <= after.count() <= before.count()
    lang = {r.doc_id: r.lang for r in before.collect()}
    assert sum(lang[r.doc_id] == r.lang for r in after.collect()) > 0.94 * after.count()


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    want = test_sigtree.brute([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == sorted(doc for doc, _, first in want if doc == first) and len(want) > after.count()


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, a), (1, a), (1, a), (2, a), (2, b), (None, c), (None, c), (None, c + " more"), (5, b + " more"), (None, a), (7, "other text altogether"), (8, None), (8, None), (9, "c9 " + c)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(1, a), (2, b), (9, "c9 " + c), (7, "other text altogether"), (8, None), (8, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    nulls = spark.createDataFrame([(None, c)] * 5, "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, nulls, SF).count() == 1


def test_clean_documents_stay(spark, stages):
    before, after = stages["decontamination"]
    want = test_decontam.brute([(r.doc_id, r.text) for r in before.collect()], [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    assert ids(after) == sorted(r[0] for r in want if not r[5])


def test_no_secret_is_left(stages):
    before, after = stages["secrets"]
    assert ids(after) == ids(before)
    old = {r.doc_id: r.text for r in before.collect()}
    changed = 0
    for r in after.collect():
        spans = test_secrets.brute(old[r.doc_id])
        for kind, a, b in (s.split(":") for s in spans):
            assert old[r.doc_id][int(a) : int(b)] not in r.text, kind
        changed += r.text != old[r.doc_id]
        assert r.n_chars == len(r.text) if r.text != old[r.doc_id] else True
        assert re.sub(re.escape(secrets.MASK), "", r.text) == r.text or spans or r.text != old[r.doc_id]
    assert changed > 0


def test_all_texts_are_packed(stages):
    before, after = stages["packing"]
    got = after.groupBy("doc_id").sum("length").collect()
    assert sorted(r.doc_id for r in got) == ids(before)
    total = {r.doc_id: r["sum(length)"] for r in got}
    assert all(total[r.doc_id] == r.doc_tokens for r in after.collect())
    assert packing.SIZE == 4096 and decontam.WIDTH == 10


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_other_columns_are_kept(spark):
    clash = ["k1", "k2", "spans", "score", "rejected", "lang_pred", "row", "cls", "grp", "n", "_k1", "_k2", "_spans", "_id", "kept", "x", "_", "__k1"]
    docs = table(spark, SF, "documents").limit(40).selectExpr("*", *[f"doc_id + {i} AS {c}" for i, c in enumerate(clash)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF), "clash")
        assert docs.columns[5:] == clash and all(r[c] == r.doc_id + i for r in docs.collect() for i, c in enumerate(clash)), name


def test_nulls_and_repeated_rows_in_every_stage(spark):
    """Null texts are rejected by the first stage; null ids and repeated rows go through all stages as rows of their own."""
    docs = table(spark, SF, "documents").limit(60).select("doc_id", "text", "lang", "source", "n_chars")
    some = docs.limit(3)
    nulls = docs.limit(1).selectExpr("doc_id", "cast(null as string) text", "lang", "source", "n_chars")
    rows = saved(docs.union(some).union(some.selectExpr("cast(null as long)", "text", "lang", "source", "n_chars")).union(nulls).union(nulls), "odd-rows")
    seen = lambda df: sorted(map(str, ((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())))
    told = saved(corpus_pipeline.language(spark, rows, SF), "odd")
    assert set(seen(told)) <= {x for x in seen(rows) if not x.endswith("None)")} and told.count() > 60
    kept = saved(corpus_pipeline.near_duplicates(spark, told, SF), "odd")
    assert len(seen(kept)) == len(set(seen(kept))) and set(seen(kept)) <= set(seen(told))
    assert {x.split(", ", 1)[1] for x in seen(kept)} and not any(x.startswith("(None") and x.replace("None, ", f"{i}, ", 1) in seen(told) for x in seen(kept) for i in ids(docs))
    for stage in (corpus_pipeline.decontamination, corpus_pipeline.secret_redaction):
        out = saved(stage(spark, rows, SF), "odd")
        counts = {k: seen(rows).count(k) for k in seen(rows)}
        if stage is corpus_pipeline.decontamination:
            assert all(seen(out).count(k) in (0, n) for k, n in counts.items())
        else:
            assert out.count() == rows.count() and out.filter("text is null").count() == 2
    packed = corpus_pipeline.packed(spark, rows, SF).collect()
    assert sum(r.start == 0 for r in packed) == rows.count()
