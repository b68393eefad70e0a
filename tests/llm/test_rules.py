import random
import re

import pytest

from tempolink.llm import rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w, lines, seen, dup = WORDS.findall(text), text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EIGHT = "a b c d e f g h"
TEXTS = [
    None, "", " \t\n\x0b\x0c\r", "word", EIGHT, f"{EIGHT} {EIGHT}", f"{EIGHT} x {EIGHT}\n{EIGHT}", "a " * 30, f"{EIGHT} y " * 3, "x\nx\n\n\n x\nx ", "#*$%&|<> é😀 \xa0 ü", "a b\x1fc d\x85e",
    "a b c d e f g h i j k l a b c d e f g h i", "The THE the cat sat on the mat and it was not that which is for you", "\n".join(["one line that stands again"] * 9),
]


def judged(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in rules.apply_rules(docs, **how).collect()}


def test_counts_are_those_of_a_plain_rule(spark):
    pick = random.Random(5)
    texts = TEXTS + [" ".join(pick.choices("abc", k=pick.randrange(60))) for _ in range(60)] + [pick.choice([" ", "\n"]).join(pick.choices(["x y", "x", "", "# z"], k=40)) for _ in range(30)]
    got = judged(spark, texts)
    for i, text in enumerate(texts):
        want = brute(text)
        assert tuple(got[i][c] for c in BASE) == want, text
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not got[i]["kept"] or not got[i]["base_failed"]


def test_on_the_small_tables(spark, small):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r[c] for c in BASE) for r in rules.op13_rules(spark, small).collect()}
    assert got == {i: brute(t) for i, t in text.items()}


def test_the_table_is_the_verdict(spark):
    prose = " ".join(f"the word{i} of" for i in range(20))
    texts = [prose, prose + "".join(f" #{i}" for i in range(30)), " ".join(f"xyz{i}" for i in range(150)), prose + " " + "y" * 5000, "\n".join([f"the line {i // 2} of it" for i in range(9)] + ["the last"] * 9), "a " * 20]
    got = {i: r["failed"] for i, r in judged(spark, texts).items()}
    assert [got[i] for i in range(6)] == [[], ["symbols"], ["stop_words"], ["word_length"], ["repeated_windows", "repeated_lines"], ["repeated_windows", "word_length"]]
    own = judged(spark, texts, rules=[rules.Rule("long", "n_words", high=7000)], stop_words=[])
    assert [own[i]["failed"] for i in range(6)] == [[], ["long"], ["long"], [], [], []]
    assert all(r["kept"] and not r["base_failed"] for r in judged(spark, texts, rules=[]).values())


def test_good_documents_stay(spark, small):
    good = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1")
    lost = rules.op13_rules(spark, small).join(good, "doc_id").where("NOT kept AND NOT base_failed")
    assert lost.count() == 0


def test_odd_cases(odd, nothing):
    got = rules.apply_rules(odd).collect()
    assert len(got) == 13 and rules.apply_rules(nothing).count() == 0
    assert [r["n_repeat_words"] for r in got if r["doc_id"] == 5] == [30_000]
    assert all(r["base_failed"] for r in got if r["n_words"] < 20)


def test_the_main_path_has_no_python_and_no_shuffle(spark, small):
    plan = rules.op13_rules(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


@pytest.mark.parametrize("n", [7, 8, 9, 16, 17])
def test_few_words(spark, n):
    assert judged(spark, ["z " * n])[0]["n_repeat_words"] == (n if n > 8 else 0)
