import gzip
import hashlib
import random
import zlib

import pytest

from tempolink.llm import warcread


def record(kind, i, block, extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nWARC-Target-URI: http://e/{i}\r\nWARC-Date: 2020-02-01T00:00:00Z\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def http(body, *fields):
    return "\r\n".join(["HTTP/1.1 200 OK", *fields]).encode() + b"\r\n\r\n" + body


def chunks(body, sizes):
    out, at = b"", 0
    for n in sizes:
        out += f"{len(body[at : at + n]):x};x=1\r\n".encode() + body[at : at + n] + b"\r\n"
        at += n
    return out + b"0\r\n\r\n"


PAGE = "<p>é ü 日本</p>".encode()
CASES = {
    "plain": (http(PAGE), PAGE.decode(), PAGE),
    "a record's first line inside": (http(b"<pre>WARC/1.0\r\nWARC-Type: response\r\n\r\n</pre>"), "<pre>WARC/1.0\r\nWARC-Type: response\r\n\r\n</pre>", None),
    "latin": (http("<p>é</p>".encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1"), "<p>é</p>", None),
    "meta": (http('<meta charset="shift_jis"><p>日本</p>'.encode("shift_jis")), '<meta charset="shift_jis"><p>日本</p>', None),
    "unknown charset": (http(PAGE, "Content-Type: text/html; charset=nonsense"), PAGE.decode(), None),
    "bad bytes": (http(b"a\xffb"), "a�b", None),
    "gzip": (http(gzip.compress(PAGE), "Content-Encoding: gzip"), PAGE.decode(), None),
    "deflate": (http(zlib.compress(PAGE), "content-encoding: deflate"), PAGE.decode(), None),
    "raw deflate": (http(zlib.compress(PAGE)[2:-4], "Content-Encoding: deflate"), PAGE.decode(), None),
    "chunked": (http(chunks(PAGE, [3, 5, 100]), "Transfer-Encoding: chunked"), PAGE.decode(), PAGE),
    "chunked gzip": (http(chunks(gzip.compress(PAGE), [7, 100]), "Transfer-Encoding: chunked", "Content-Encoding: gzip"), PAGE.decode(), None),
    "said to be chunked": (http(PAGE, "Transfer-Encoding: chunked"), PAGE.decode(), PAGE),
    "said to be gzip": (http(PAGE, "Content-Encoding: gzip"), PAGE.decode(), PAGE),
    "head only": (b"HTTP/1.1 204 No Content\r\nX: y", "", b""),
    "empty": (b"", "", b""),
}


def files(parts):
    raw = b"".join(parts)
    return {"plain": raw, "stream": gzip.compress(raw), "members": b"".join(map(gzip.compress, parts)), "padded": b"".join(gzip.compress(p) + b"\0\0" for p in parts)}


@pytest.mark.parametrize("how", ["plain", "stream", "members", "padded"])
def test_every_body_is_read_as_sent(spark, tmp_path, how):
    parts = [record("warcinfo", 0, b"software: x")] + [record("response", name, block) for name, (block, _, _) in CASES.items()] + [record("request", "r", b"GET /")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(files(parts)[how])
    (tmp_path / "in" / "none.warc").write_bytes(b"")
    got = {r["record_id"][7:-1]: r for r in warcread.read_responses(spark, str(tmp_path / "in")).collect()}
    assert set(got) == set(CASES)
    for name, (block, text, sent) in CASES.items():
        assert got[name]["payload"] == text, name
        assert got[name]["http_headers"].encode() == block.split(b"\r\n\r\n")[0]
        if sent is not None:
            assert got[name]["payload_digest"] == "sha256:" + hashlib.sha256(sent).hexdigest()


def test_own_digests_and_many_records_cut_anywhere(monkeypatch):
    r = random.Random(3)
    blocks = [http(bytes(r.choices(b"ab\r\n\0WARC/1.0", k=r.randrange(300)))) for _ in range(60)]
    parts = [record("response", i, b, "WARC-Payload-Digest: sha1:X\r\n") for i, b in enumerate(blocks)]
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(warcread, "CHUNK", size)
        for data in files(parts).values():
            got = list(warcread.records(warcread.unpacked(data)))
            assert [b for _, b in got] == blocks and all(f["warc-payload-digest"] == "sha1:X" for f, _ in got)
    whole = files(parts)["members"]
    for cut in (10, 500, len(whole) // 2, len(whole) - 3):
        got = [b for _, b in warcread.records(warcread.unpacked(whole[:cut]))]
        assert got == blocks[: len(got)] and (len(got) < 60 or cut == len(whole) - 3)  # of the last only the check sum is missing
    assert warcread.response_of({"warc-payload-digest": "sha1:X"}, blocks[0])[6] == "sha1:X"


def test_a_record_without_length_ends_its_file():
    data = record("response", 1, http(b"x")) + b"WARC/1.0\r\nWARC-Type: response\r\n\r\nabc"
    assert len(list(warcread.records(iter([data])))) == 1 and list(warcread.records(iter([b"no record\r\n\r\n"]))) == []
