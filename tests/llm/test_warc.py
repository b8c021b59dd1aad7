import base64
import gzip
import hashlib
import io
from collections import Counter

import pytest

from covergraph.llm import warc

SCHEMA = "page_id long, url string, html string, record_id string, key string"


def read(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    manifest = warc.write_archives(table, **{k: v for k, v in options.items() if k in ("revisit_bytes", "roll_bytes")})
    chunks = warc.read_chunks(manifest, chunk_bytes=options.get("chunk_bytes", 1 << 20))
    return manifest, chunks, sorted(warc.record_index(chunks).collect(), key=lambda r: (r.record_id, r.record_type))


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_with_revisits(spark):
    rows = [(1, "http://a/é x", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "u\r\nWARC-Type: x", "other 中"), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\n")]
    for options in ({}, {"roll_bytes": 1}, {"chunk_bytes": 3}):
        manifest, chunks, got = read(spark, rows, **options)
        by = {int(r.record_id): r for r in got}
        for page, _, html in rows:
            assert by[page].payload_digest == digest(html) and by[page].payload_bytes == len((html or "").encode())
        assert [by[i].record_type for i in range(1, 7)] == ["revisit", "response", "response", "revisit", "response", "response"]
        assert by[1].refers_to == "2" and by[4].refers_to == "5"
        whole = {}
        for c in sorted(chunks.collect(), key=lambda c: c.chunk_no):
            whole[c.record_id] = whole.get(c.record_id, b"") + bytes(c.data)
        assert whole["3"].decode() == "other 中" and whole["1"] == b"" and whole["6"] == b"WARC/1.1\r\n\r\n"
        if "roll_bytes" in options:
            assert manifest.count() == len(rows)


def test_oversized_payload_comes_in_chunks(spark):
    body = "0123456789" * 50_000
    _, chunks, got = read(spark, [(1, "u", body)], chunk_bytes=65_536)
    parts = sorted(chunks.collect(), key=lambda c: c.chunk_no)
    assert len(parts) == 8 and max(len(c.data) for c in parts) == 65_536 and [c.is_last for c in parts] == [False] * 7 + [True]
    assert got[0].payload_digest == digest(body)


def test_smaller_payloads_are_responses(spark):
    _, _, got = read(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], revisit_bytes=3)
    assert [r.record_type for r in got] == ["response", "response", "revisit", "response"]


def test_ties_nulls_and_empty_tables(spark):
    _, _, got = read(spark, [(None, "u", "a"), (None, "u", "a"), (7, "u", "b"), (7, "u", "b"), (None, "u", "b")])
    assert Counter((r.record_id, r.record_type, r.refers_to) for r in got) == {("null", "response", None): 2, ("7", "response", None): 2, ("null", "revisit", "7"): 1}
    assert read(spark, [])[2] == []


def test_damage_is_found():
    sink = io.BytesIO()
    warc._record(sink, "1", "u", b"payload", None, "2020-01-01T00:00:00Z")
    plain = gzip.decompress(sink.getvalue())
    assert len(list(warc.chunks(io.BytesIO(plain), 4))) == 2
    with pytest.raises(ValueError, match="digest"):
        list(warc.chunks(io.BytesIO(plain.replace(b"payload", b"pAyload")), 4))
    with pytest.raises(ValueError, match="short"):
        list(warc.chunks(io.BytesIO(plain[:-8]), 4))


def test_input_cut_at_any_byte_is_an_error():
    sink = io.BytesIO()
    for k, (data, refers) in enumerate([(b"some payload", None), (None, "0"), (b"", None)]):
        warc._record(sink, str(k), "u", data, refers, "2020-01-01T00:00:00Z", (12, hashlib.sha1(b"some payload").hexdigest()) if refers else None)
    plain = gzip.decompress(sink.getvalue())
    whole = [n for n in range(len(plain) + 1) if plain[:n].endswith(b"\r\n\r\n") and (n == len(plain) or plain[n:].startswith(b"WARC/"))]
    for n in range(1, len(plain)):
        if n in whole:
            assert list(warc.chunks(io.BytesIO(plain[:n]), 5))
        else:
            with pytest.raises(ValueError):
                list(warc.chunks(io.BytesIO(plain[:n]), 5))


def test_many_copies_and_a_full_filter(spark, monkeypatch):
    init = warc.KeyFilter.__init__
    monkeypatch.setattr(warc.KeyFilter, "__init__", lambda self, keys, column: init(self, keys, column, most_bits=64))
    rows = [(i, "u", f"page {i % 40}" if i % 3 else "hot") for i in range(300)] + [(None, "u", "hot"), (None, "u", "alone")]
    _, chunks, got = read(spark, rows)
    best = {}
    for i, _, html in rows:
        best[html] = max(best.get(html, -1), -1 if i is None else i)
    want = Counter((str(i) if i is not None else "null", "revisit" if best[h] not in (-1, i) else "response", str(best[h]) if best[h] not in (-1, i) else None, digest(h)) for i, _, h in rows)
    assert Counter((r.record_id, r.record_type, r.refers_to, r.payload_digest) for r in got) == want
