"""The pipeline over the small tables, and the operators' SQL."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from roadloom import llm
from roadloom.llm import language_bitmask, toxicity_pu

from tests.test_catalog import compare


def test_stages_keep_the_documents_columns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    assert docs.select("doc_id").distinct().count() == counts[-1]


CLASHING = ("score", "fp", "lang_pred", "lang_score", "bucket", "label", "id", "best_id", "ids", "seg", "p", "u")


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, sf, stage):
    """Null columns, clashing names and repeated rows: the same documents stay, with their own columns' values."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, None, None, None, None), (900_002, "", None, None, 0), (900_003, " \n ", "xx", "s", 3)], docs.schema)
    docs = docs.union(odd).union(odd).withColumns({c: F.lit(c) for c in CLASHING})
    out = stage(spark, docs, sf)
    if stage is corpus_pipeline.STAGES[-1][1]:
        assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    else:
        assert out.columns == docs.columns
        assert all(r[c] == c for r in out.collect() for c in CLASHING)
        assert not Counter(map(tuple, out.collect())) - Counter(map(tuple, docs.collect()))
    assert stage(spark, docs.where("FALSE"), sf).count() == 0


@pytest.mark.parametrize("name", ["op6_chat_snapshots", "op7_segment_topk"])
def test_same_as_sql(spark, sf, name):
    compare(spark, sf, llm.queries()[name], llm.oracle_sql()[name])


def test_toxicity_stage_by_a_plain_score(spark, sf):
    """What stays is what a sum of the model's weights over words and word starts puts under even odds."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity_pu.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def odds(text):
        words = set("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
        return model.bias + sum(model.weights.get(f, 0.0) for f in words | {"^" + w[:5] for w in words if len(w) > 5})

    want = {r.doc_id for r in docs.collect() if odds(r.text) < 0}
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, sf).collect()} == want
    assert 0 < len(want) <= docs.count()


def test_language_stage_by_plain_counts(spark, sf):
    """What stays has a letter, and enough of its n-grams in the best language's filter, one n-gram at a time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    filters = language_bitmask.train(docs)
    want = set()
    for r in docs.collect():
        grams = [int(h) for part in language_bitmask.gram_hashes(r.text) for h in part]
        size, shares = len(filters.slots[0]), []
        for i in range(len(filters.languages)):
            held = sum(all(filters.slots[i // 8][(g + k * ((g >> 33) | 1)) % 2**64 % size] >> i % 8 & 1 for k in range(language_bitmask.PROBES)) for g in grams)
            shares.append((held / len(grams) - filters.false_rates[i]) / (1 - filters.false_rates[i]) if grams else 0.0)
        if any(c.isalpha() for c in r.text or "") and max(shares, default=0) >= language_bitmask.LEAST_KNOWN:
            want.add(r.doc_id)
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["language"](spark, docs, sf).collect()} == want
