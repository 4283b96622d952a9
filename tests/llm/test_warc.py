import random

import pytest

from tessera.llm import warc


def test_framing_round_trip():
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        data = random.Random(n).randbytes(n)
        assert warc.unchunked(warc.chunked(data)) == data
    for broken in (b"", b"5\r\nab", b"zz\r\n", b"2\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_pages(spark):
    big = "é<p>" * 30_000
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u\r\n4", ""), (5, "u5", big), (None, "u6", "same"), (7, "u7", big + "x"), (7, "u7", big + "x"), (9, "u", "WARC/1.1\r\n\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, kind string")
    found = warc.round_trip(pages).collect()
    assert len(found) == len(rows)
    assert all(r["error"] is None for r in found)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in found), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = max(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
        new = page == first
        want.append((page, "response" if new else "revisit", None if new else first, len(data), warc.base32_sha1(data)))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_and_errors(spark):
    records = []
    body = random.Random(1).randbytes(50_000)
    for seq in range(3):
        records += [(seq, r) for r in warc.records_of(seq, seq, "u", body, None, "t", segment=9000)]
    kept = [(s, r) for k, (s, r) in enumerate(records) if not (s == 1 and b"Segment-Number: 3" in r) and not (s == 2 and b"Total-Length" in r)]
    rows = []
    for head, block in warc.parse(iter([b"\r\n\r\n".join(r for _, r in kept) + b"\r\n\r\n"])):
        rows.append((head.get("warc-segment-origin-id") or head["warc-record-id"], int(head.get("warc-segment-number", 1)),
                     warc._number(head.get("warc-segment-total-length")), head["warc-type"], int(head["x-page-id"]), None, "u",
                     (head.get("warc-payload-digest") or "sha1:")[5:] or None, None, block))
    random.Random(2).shuffle(rows)
    out = {r["page_id"]: r for r in warc.payloads(warc.reassemble(spark.createDataFrame(rows, warc._RECORD))).collect()}
    assert bytes(out[0]["payload"]) == body and out[0]["error"] is None
    assert out[1]["error"] == "segments missing or repeated" and out[2]["error"] == "last segment missing"
