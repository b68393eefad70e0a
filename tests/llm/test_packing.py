import zlib

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tempolink.llm import packing


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def ids_of(model, text):
    return np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def verify(model, docs, pieces):
    """Every id in exactly one piece, sequences gapless, padding little."""
    by, rows = {}, {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
        rows.setdefault(p["sequence_id"], []).append(p)
    for doc_id, text in docs:
        ids, at = ids_of(model, text), 0
        for p in sorted(by[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            part = ids[at : at + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            if "ids" in p:
                assert p["ids"] == part.tolist()
            at += p["length"]
        assert at == len(ids)
    for row in rows.values():
        at = 0
        for p in sorted(row, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_small_tables(spark, small, model):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    verify(model, docs, [r.asDict() for r in packing.op4_packing(spark, small).collect()])


def test_odd_cases(odd, nothing, model):
    distinct = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    docs = [tuple(r) for r in distinct.select("doc_id", "text").collect()]
    verify(model, docs, [r.asDict() for r in packing.pack_documents(distinct).collect()])
    assert packing.pack_documents(nothing).count() == 0
    assert packing.pack_documents(odd, with_ids=False).where("doc_id is null").agg({"length": "sum"}).head()[0] == len(ids_of(model, "one two three four five six seven")) + 1


def test_chunks_give_the_ids_of_whole_texts(model):
    tokens = packing.worker_tokenizer(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    texts = ["", " ", "a", " a", "a ", "a  b", "a \n b", "a\nb", "a\n\nb", "\n", "x\ty z", "don't we'll 123abc, 9.", "é  ü", "中文 字 ok", "a　b c", "<|endoftext|> x", "ƒ ŀŀ ʷ ²³ ½x _aª", "Hi! a, b; c: d| ||", "a\r\nb", "1. 2, word3."]
    for _ in range(2):
        assert tokens.ids(texts) == [ids_of(model, t)[:-1].tobytes() for t in texts]


def test_added_tokens_are_read_as_the_tokenizer_reads_them(model):
    tokens = packing.worker_tokenizer(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    literals = [t.content for t in model.get_added_tokens_decoder().values()]
    assert literals
    texts = [f.replace("{}", t) for t in literals for f in ("say {} now", "{}", "a{}b", "{} {}\n{}", " {} ")] + ["<|endoftext", "<| endoftext |>"]
    assert tokens.ids(texts) == [model_ids.tobytes() for model_ids in (ids_of(model, t)[:-1] for t in texts)]


def test_step_groups_are_balanced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    rows = packing.pack_documents(docs, with_ids=False).groupBy(F.shiftright("step_group", 36).alias("part"), "step_group").sum("length").collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["part"], []).append(r["sum(length)"])
    assert len(sizes) == 3 and all(len(s) > 1 for s in sizes.values())
    for s in sizes.values():
        assert max(s) <= packing.STEP_TOKENS and min(s) >= packing.STEP_TOKENS // 2 - 2048
    few = packing.pack_documents(docs.limit(3), with_ids=False)
    assert few.select("step_group").distinct().count() == few.selectExpr("shiftright(step_group, 36)").distinct().count()
