import re

import duckdb
import pytest

from tempolink.llm import licenses
from tempolink.llm.sql import LICENSES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = [(label, text.split()) for label, text in licenses.BASE]


def brute(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for label, p in BASE for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    starts = [k for k, _ in places]
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
TEXTS = [
    "Released Under the MIT License.", "cc by nc cc by nc; CC BY-NC", "apache license, version 2.0 apache license version 2", "under the MITK license", "under the mit licenſe", "KELVIN Kc by nc cc by nc",
    "under the mit", "by nc", "", None, "é under\nthe\tmit/license é",
]


def test_base_places_are_those_of_a_plain_rule(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in licenses.scan_licenses(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_on_the_small_tables(spark, small):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in licenses.op8_licenses(spark, small).collect()}
    assert got == {i: brute(t) for i, t in text.items()}


@pytest.mark.parametrize(("change", "found"), [(lambda w: w, True), (lambda w: w[:10] + ["really", "so"] + w[10:], True), (lambda w: w[:15] + w[17:], True), (lambda w: w[: len(w) // 2], False), (lambda w: w[::-1], False)])
def test_spans_bear_inserted_and_missing_words(spark, change, found):
    label, text = licenses.TEMPLATES[0]
    words = re.findall(WORD, text.lower())
    doc = "some words before " + " ".join(change(words)) + " and after"
    r = licenses.scan_licenses(spark.createDataFrame([(1, doc)], "doc_id long, text string")).head()
    assert (label in r["labels"].split(",")) == found and r["n_base"] == 0 and (r["score"] > 0) == found


@pytest.mark.parametrize("change", [lambda t: f"{t} {'of the software ' * 40}", lambda t: f"{'of the software ' * 40} {t}", lambda t: f"{'of the software ' * 40} {t} {'of the software ' * 40}", lambda t: f"{t} {t} x {t}"])
def test_a_span_isnt_lost_beside_repeats(spark, change):
    label, text = licenses.TEMPLATES[0]
    docs = spark.createDataFrame([(1, f"before {change(text)} after"), (2, "of the software " * 60)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert label in got[1]["labels"].split(",") and got[1]["score"] == 1.0
    assert got[2]["labels"] == "" and got[2]["score"] == 0
    con = duckdb.connect()
    rows = docs.toPandas()
    con.register("documents", rows)
    sql = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_words, labels, score FROM ({LICENSES})").fetchall()}
    assert sql == {i: (r["n_words"], r["labels"], r["score"]) for i, r in got.items()}


def test_spans_have_places(spark):
    label, text = licenses.TEMPLATES[5]
    spans = licenses.license_spans(spark.createDataFrame([(1, "a b c " + text + ". x")], "doc_id long, text string")).where("template >= 0").collect()
    assert [(r["label"], r["start"], r["end"], r["coverage"]) for r in spans] == [(label, 3, 3 + len(text.split()), 1.0)]


def test_odd_cases(odd, nothing):
    got = licenses.scan_licenses(odd).collect()
    assert len(got) == 13 and licenses.scan_licenses(nothing).count() == 0
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in got)[:2] == [(0, 0), (0, 7)]


def test_the_main_path_has_no_python(spark, small):
    plan = licenses.op8_licenses(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_many_templates_give_the_same_spans_by_a_shuffled_join(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"), allowMissingColumns=True)
    sent = sorted(map(str, licenses.scan_licenses(docs).collect()))
    monkeypatch.setattr(licenses, "MOST_SENT", 0)
    assert sorted(map(str, licenses.scan_licenses(docs).collect())) == sent
