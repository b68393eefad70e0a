from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from tempolink.llm import mixing, quality, secrets

from .test_neardup import brute
from .test_packing import verify


def test_stages_in_order(spark, small, tmp_path):
    """Each stage's decisions take effect on what its predecessor kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before, kept = docs.columns, docs, {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, before, small).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i + 1 < len(pipeline.STAGES):
            assert after.columns == columns, name
        kept[i] = (before, after)
        before = after
    good, deduplicated, masked, mixed = (kept[i][1].collect() for i in range(4))
    assert 0 < len(good) < docs.count()
    want = brute([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in deduplicated) == sorted({want[i] for i in want})
    assert sorted(r["doc_id"] for r in masked) == sorted(r["doc_id"] for r in deduplicated)
    assert not any(secrets.base_spans(r["text"]) for r in masked)
    old = {r["doc_id"]: r["text"] for r in deduplicated}
    assert all(r["text"] == old[r["doc_id"]] or secrets.MASK in r["text"] for r in masked)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in masked} and len({r["doc_id"] for r in mixed}) == len(mixed)
    # the classifier's verdict is the score's, document by document
    scores = quality.score_documents(docs, quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet")))
    assert {r["doc_id"] for r in good} == {r["doc_id"] for r in scores.collect() if r["score"] >= quality.GOOD}
    # the mix takes no more than its share, nearly all of it, and no document twice
    tokens = lambda rows: sum(r["n"] for r in spark.createDataFrame([(r["text"],) for r in rows], "text string").select(mixing.token_count(pipeline.F.col("text")).alias("n")).collect())
    all_tokens, longest = tokens(masked), max(len(r["text"].split()) for r in masked)
    leaves = len({(r["source"], r["lang"]) for r in masked})
    assert pipeline.SHARE * all_tokens - 1 <= tokens(mixed) <= pipeline.SHARE * all_tokens + leaves * longest
    # every token of what is mixed is packed, once
    model = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    verify(model, [(r["doc_id"], r["text"]) for r in mixed], [r.asDict() for r in before.collect()])


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents_pass_through(spark, small, odd, nothing, empty):
    docs = nothing if empty else odd
    for _, stage in pipeline.STAGES[1:]:
        docs = stage(spark, docs, small)
    assert (docs.count() > 0) != empty


@pytest.mark.parametrize("empty", [False, True])
def test_every_stage_takes_odd_documents(spark, small, odd, nothing, tmp_path, empty):
    """Rows of every odd kind beside ordinary ones, clashing columns included, from the first stage on."""
    usual = spark.read.parquet(f"{small}/documents.parquet").withColumn("doc_id", pipeline.F.col("doc_id") + 1000)
    docs = (nothing if empty else odd).unionByName(usual.where("1 = 0" if empty else "1 = 1"), allowMissingColumns=True)
    columns, kept = docs.columns, [docs]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, kept[-1], small).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
        if i + 1 < len(pipeline.STAGES):
            assert kept[-1].columns == columns, name
            ids = [Counter(r["doc_id"] for r in k.select("doc_id").collect()) for k in kept[-2:]]
            assert ids[1] <= ids[0], name
    if empty:
        assert all(k.count() == 0 for k in kept)
        return
    before, after = ({r["doc_id"]: r["text"] for r in k.collect() if r["doc_id"] is not None} for k in kept[1:3])
    want = brute(list(before.items()))
    assert set(after) == {want[i] for i in want}
    mixed = kept[4].where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text").collect()
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in kept[5].collect() if r["doc_id"] is not None}
