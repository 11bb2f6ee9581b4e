"""Archives: exact round trips, what a public reading of the format gives, and records that are broken."""

import base64
import gzip
import hashlib
import random
import re

import pytest

from tickspark.llm import warc
from tickspark.llm.common import Scratch

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def expected(rows, min_bytes=0):
    out, first = [], {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = data in first and len(data) >= min_bytes
        out.append((page, len(data), digest, "revisit" if again else "response", first[data] if again else None))
        first.setdefault(data, page)
    return sorted(out, key=repr)


def odd_pages():
    rng = random.Random(2)
    rows = [(i, f"http://x.example/{i}", "".join(rng.choice("aé日\r\n <>") for _ in range(rng.choice([0, 1, 50, 900])))) for i in range(60)]
    rows += [(100, None, None), (101, "http://y/ z\r\nX: 1", ""), (102, "http://y/WARC/1.1", "WARC/1.1\r\n" * 30), (103, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (104, "u", "0\r\n\r\n"), (None, "n", "nobody"), (None, "n", "nobody"), (105, "u", "nobody")]
    rows += [(200 + i, "u", "a copy of many") for i in range(40)] + [(7, "again", rows[7][2]), (7, "again", rows[7][2]), (8, "other", "eight")]
    return [*rows, (300, "long", "é" * 400_000)]


@pytest.mark.parametrize("chunk, segment", [(8192, 32768), (7, 64), (1, 5000)])
def test_round_trip(spark, chunk, segment):
    rows = [r for r in odd_pages() if chunk > 100 or len(r[2] or "") < 5000]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).selectExpr("*", "'x' AS row", "'x' AS payload", "'x' AS origin", "'x' AS type", "'x' AS value")
    df = Scratch(spark, "t").save(df)
    got = warc.round_trip(df, 0, chunk, segment)
    assert got.where("problem is not null").count() == 0
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == expected(rows)


def test_small_payloads_are_no_revisits(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), 3)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == expected(rows, 3)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def plain_records(data):
    """A reader of its own: by Content-Length, as the format says."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode()
        assert head.startswith("WARC/1.1\r\n")
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        assert data[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        at = end + 8 + size


def test_archives_are_well_formed(spark, tmp_path):
    rows = odd_pages()
    scratch = Scratch(spark, "t")
    df = scratch.save(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    warc.write_archives(df, str(tmp_path / "w"), scratch, 0, 50, 300)
    records = [r for f in (tmp_path / "w").glob("*.gz") for r in plain_records(gzip.decompress(f.read_bytes()))]
    kinds = [f["WARC-Type"] for f, _ in records]
    assert kinds.count("response") + kinds.count("revisit") == len(rows) and kinds.count("continuation") > 100
    assert len({f["WARC-Record-ID"] for f, _ in records}) == len(records)
    bodies = {}
    for f, block in records:
        if f["WARC-Type"] != "revisit":
            bodies.setdefault(f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), {})[int(f.get("WARC-Segment-Number", 1))] = (f, block)
    for parts in bodies.values():
        block = b"".join(parts[n][1] for n in range(1, len(parts) + 1))
        first, last = parts[1][0], parts[len(parts)][0]
        assert len(parts) == 1 or int(last["WARC-Segment-Total-Length"]) == len(block)
        framed, payload = block.split(b"\r\n\r\n", 1)[1], b""
        while not framed.startswith(b"0\r\n"):
            size, framed = framed.split(b"\r\n", 1)
            payload, framed = payload + framed[: int(size, 16)], framed[int(size, 16) + 2 :]
        assert first["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def rec(kind, rid, block, **more):
    fields = {"WARC-Type": kind, "WARC-Record-ID": rid} | {k.replace("_", "-"): v for k, v in more.items()}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


CHUNKED = b"HTTP/1.1 200 OK\r\ntransfer-encoding: gzip;q=0, Chunked\r\n\r\n"
HTTP = {"Content_Type": "application/http; msgtype=response"}


def seg(rid, n, block, total=None):
    more = {"WARC_Segment_Number": n} | ({"WARC_Segment_Total_Length": total} if total is not None else {})
    return rec("response", rid, block, **HTTP, **more) if n == 1 else rec("continuation", f"{rid}/{n}", block, WARC_Segment_Origin_ID=rid, **more)


def test_broken_and_foreign_records(spark, tmp_path):
    good = b"5;ext=1\r\nhello\r\n1\r\n!\r\n0\r\nTrailer: x\r\n\r\n"
    files = [
        [rec("warcinfo", "info", b"software: x"), rec("resource", "plain", b"as it is", Content_Type="text/plain"), rec("response", "whole", b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\nrest", **HTTP), rec("response", "framed", CHUNKED + good, **HTTP)],
        [seg("cut", 3, good[20:], len(CHUNKED + good)), seg("cut", 1, (CHUNKED + good)[:30])],
        [seg("cut", 2, (CHUNKED + good)[30 : len(CHUNKED) + 20]), seg("gap", 1, CHUNKED), seg("gap", 3, good, 99), seg("long", 1, CHUNKED), seg("long", 2, good, 5), seg("open", 1, CHUNKED), seg("twice", 1, CHUNKED), seg("twice", 2, good, len(CHUNKED + good)), seg("twice", 2, good, len(CHUNKED + good)), seg("orphan", 2, good, 9)],
        [rec("response", "nosize", CHUNKED + b"zz\r\nhello\r\n0\r\n\r\n", **HTTP), rec("response", "noend", CHUNKED + b"5\r\nhelloX\r\n", **HTTP), rec("response", "half", CHUNKED + b"5\r\nhel", **HTTP), rec("response", "digest", b"HTTP/1.1 200 OK\r\n\r\nx", **HTTP, WARC_Payload_Digest="sha1:AAAA")],
        [rec("revisit", "ok", b"", WARC_Refers_To="framed", WARC_Payload_Digest="sha1:" + base64.b32encode(hashlib.sha1(b"hello!").digest()).decode()), rec("revisit", "lost", b"", WARC_Refers_To="nothing", WARC_Payload_Digest="sha1:QQ"), rec("revisit", "wrong", b"", WARC_Refers_To="framed", WARC_Payload_Digest="sha1:QQ"), rec("response", "tail", b"HTTP/1.1 200 OK\r\n\r\nbody", **HTTP)[:-9]],
    ]
    (tmp_path / "a").mkdir()
    for i, records in enumerate(files):
        # A member of gzip per record, as usual.
        (tmp_path / "a" / f"{i}.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = {r["record_id"]: (r["payload_bytes"], None if r["payload"] is None else bytes(r["payload"]), r["problem"]) for r in warc.read_archives(spark, str(tmp_path / "a"), Scratch(spark, "t"), keep=True).collect()}
    hello = (6, b"hello!", None)
    none = lambda why: (None, None, why)
    assert got == {
        "info": (11, b"software: x", None), "plain": (8, b"as it is", None), "whole": (12, b"body\r\n\r\nrest", None), "framed": hello, "cut": hello,
        "gap": none("segment missing"), "long": none("total length differs"), "open": none("no last segment"), "twice": none("segment repeated"), "orphan": none("segment missing"),
        "nosize": none("chunk without size"), "noend": none("chunk without end"), "half": none("payload cut off"), "digest": (1, b"x", "digest differs"),
        "ok": hello, "lost": none("revisit of nothing"), "wrong": (6, b"hello!", "digest differs"), "tail": none("record cut off"),
    }


def test_body_in_parts_of_any_size():
    data = b"\0WARC/1.1\r\nxyz" * 50
    block = warc.HTTP_HEAD + warc.chunked(data, 13)
    assert not re.search(rb"WARC/1\.1\r\n", block)
    for step in (1, 2, 3, 17, 10_000):
        body = warc.Body(True)
        assert b"".join(body.feed(block[i : i + step]) for i in range(0, len(block), step)) == data
        body.close()
