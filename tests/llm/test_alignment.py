import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers as public
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tempolink.llm import alignment


@lru_cache(maxsize=1)
def models():
    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


@lru_cache(maxsize=1)
def byte_names():
    """Each byte's character, from how the tokenizer writes bytes: printable Latin ones stand for themselves."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    names = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + len(names) - len(kept))
    return {c: b for b, c in names.items()}


def plain(text):
    """(A ids, B ids, groups, links) of one text, token by token."""
    if not text:
        return [], [], [], []
    ma, mb = models()
    a, b = ma.encode(" " + text, add_special_tokens=False).ids, mb.encode(text)
    raw_a = [bytes(byte_names()[c] for c in ma.id_to_token(i)) for i in a]
    raw_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(mb.id_to_piece, b)]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return [], [], [], []
    spans = lambda raw: [(sum(map(len, raw[:i])), sum(map(len, raw[: i + 1]))) for i in range(len(raw))]
    sa, sb = spans(raw_a), spans(raw_b)
    links = [(i, j) for i, (lo, hi) in enumerate(sa) for j, (x, y) in enumerate(sb) if lo < y and x < hi]
    cuts = sorted({hi for _, hi in sa} & {hi for _, hi in sb})
    groups = [([i for i, (lo, hi) in zip(a, sa) if start <= lo < end], [j for j, (lo, hi) in zip(b, sb) if start <= lo < end]) for start, end in zip([0, *cuts], cuts)]
    return a, b, groups, links


def expected(rows):
    read = [(i, *plain(t)) for i, t in rows]
    count, most = Counter(), defaultdict(int)
    for _, a, b, _, links in read:
        count.update({(a[x], b[y]) for x, y in links})
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for i, a, b, groups, links in read:
        ids = [(a[x], b[y]) for x, y in links]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in ids), sum(count[p] for p in ids), digest))
    return sorted(out, key=str)


COLUMNS = [c.split()[0] for c in alignment.ALIGNED.split(", ")]
TEXTS = [
    None, "", " ", "a", "hello world", "hello  world\n\n  indented\ttab", "<|endoftext|> and </s> <s> <unk>", "▁ low bar", "naïve café ÀÉÎ ß ſ ª²", "日本語のテキスト 😀👩‍👩‍👧 text", "\x00\x01 \x7f\x85\xa0   　x", "don't we'll I'M",
    "x" * 300, " leading and trailing ", "123456789 3.14 1,000", "hello world", "мир труд май", "é combining", "\U0001f600" * 5, "a\r\nb\r\n", "word " * 50,
]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_equals_a_plain_reading(spark):
    pick = random.Random(4)
    alphabet = "ab Té\n😀1,'日\x1c "
    texts = TEXTS + ["".join(pick.choices(alphabet, k=pick.randrange(1, 60))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "hello world"), (3, "hello world")]
    assert rows_of(alignment.align(docs_of(spark, rows).repartition(3))) == expected(rows)


def test_on_some_of_the_small_tables_texts(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 900").collect()]
    assert len(rows) > 40 and rows_of(alignment.align(docs_of(spark, rows).repartition(5))) == expected(rows)


def test_lanes_and_slices_change_nothing(spark, small, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(40).collect()] + [None, "x" * 5000, ""]
    tokens = alignment.Tokenizers(alignment.installed())
    whole = alignment.Merged(tokens, texts)
    monkeypatch.setattr(alignment, "LANE", 16)
    parted = alignment.Merged(tokens, texts)
    n_lanes = len(alignment.lanes(np.cumsum(tokens.sizes_a[parted.a]), np.cumsum(tokens.sizes_b[parted.b]), parted.first_a, parted.first_b)[0])
    assert n_lanes > 500
    assert set(zip(whole.links_a, whole.links_b)) == set(zip(parted.links_a, parted.links_b)) and len(whole.links_a) == len(parted.links_a)
    assert whole.hashes() == parted.hashes() and all((a == b).all() for a, b in zip(whole.counts(), parted.counts()))


def test_ranks_read_as_the_tokenizer_does():
    """Every character that is left to the rank file, among others of its kind and not."""
    ma, _ = models()
    tokens = alignment.Tokenizers(alignment.installed())
    pick = random.Random(6)
    known = [chr(c) for c in range(0x250) if not alignment._OTHER.search(chr(c))]
    texts = [c + d for c in known for d in ("a", " ", "1", ".", c, "\n")] + ["".join(pick.choices(known + [" ", "\n", "'", "s"] * 20, k=40)) for _ in range(400)]
    for text in texts:
        assert tokens.ranked.encode_ordinary(" " + text) == ma.encode(" " + text, add_special_tokens=False).ids, repr(text)


def test_groups_are_the_texts_bytes(spark):
    rows = list(enumerate(TEXTS))
    got = defaultdict(list)
    for r in alignment.aligned_groups(docs_of(spark, rows)).orderBy("doc_id", "number").collect():
        got[r["doc_id"]].append(r)
    for i, text in rows:
        _, _, groups, _ = plain(text)
        assert [(r["a"], r["b"]) for r in got[i]] == groups
        assert [r["number"] for r in got[i]] == list(range(len(groups)))
        if groups:
            assert [r["start"] for r in got[i]] == [0] + [r["end"] for r in got[i]][:-1] and got[i][-1]["end"] == len((" " + text).encode())


def test_odd_cases(odd, nothing):
    got = alignment.align(odd)
    assert got.columns == COLUMNS and got.count() == 13
    assert alignment.align(nothing).count() == 0 and alignment.aligned_groups(nothing).count() == 0
    assert all(r["n_links"] == 0 and r["groups_sha256"] == "" for r in got.where("doc_id IN (2, 3)").collect())


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_packing_of_numbers(n):
    values = np.random.default_rng(n).integers(0, 2**20, n)
    assert (alignment._unpacked(alignment._packed(values), n) == values).all()
