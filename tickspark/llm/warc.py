"""WARC archives: pages to records, and records back to payloads.

Payloads lie in HTTP responses with chunked framing.  Blocks over a limit are cut
into segments: a first record and continuations, which name it and their number;
the last one states the total length.  Reading groups continuations by their
origin, orders them by number, verifies number and length, and decodes the
framing as the segments pass.

Archives are written and read by Spark's text source with separators of its own,
so they can be in any store that Spark reaches, and no task holds a file: the
version line is what separates records.  Written payloads never hold one, as a
chunk ends inside each.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import Scratch, read_table, sub_batches

VERSION = "WARC/1.1"
MARK = f"{VERSION}\r\n"
CHUNK_BYTES, SEGMENT_BYTES = 8_192, 32_768
DATE = "1970-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX = re.compile(rb"[0-9A-Fa-f]{1,15}")
#: Longest line of chunk framing, and head of a response.
LINE_LIMIT, HEAD_LIMIT = 4_096, 1 << 20

RECORD = "record_id string, page_id string, type string, payload_bytes long, payload_digest string, refers_to string, problem string, payload binary"
PART = "origin string, number long, total long, content_type string, digest string, block binary"


def digest_of(h) -> str:
    """Bare upper-case base32."""
    return base64.b32encode(h.digest()).decode()


def record_id(*parts: object) -> str:
    """The URN of a record that is named by parts."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=4)}>"


def chunked(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """Chunked framing in which no version line of an archive is whole."""
    cuts = set(range(chunk_bytes, len(payload), chunk_bytes))
    cuts |= {m.start() + 4 for m in re.finditer(rb"WARC/", payload)}
    out, start = [], 0
    for end in [*sorted(cuts), len(payload)]:
        if end > start:
            out += [b"%x\r\n" % (end - start), payload[start:end], b"\r\n"]
            start = end
    out.append(b"0\r\n\r\n")
    return b"".join(out)


class Body:
    """The payload of a block that comes in parts: of an HTTP message what follows its head, unframed if it is chunked."""

    def __init__(self, http: bool):
        self.in_head, self.framed, self.rest = http, False, b""
        self.need, self.ending, self.trailing, self.done = 0, False, False, False

    def feed(self, data: bytes) -> bytes:
        if self.in_head:
            data = self.rest + data
            end = data.find(b"\r\n\r\n")
            if end < 0:
                self.rest = data
                if len(data) > HEAD_LIMIT:
                    raise ValueError("head too long")
                return b""
            head, self.rest, self.in_head = data[:end].lower(), b"", False
            self.framed = re.search(rb"\r\ntransfer-encoding:[^\r]*\bchunked\b", head) is not None
            data = data[end + 4 :]
        return self._unframe(data) if self.framed else data

    def _unframe(self, data: bytes) -> bytes:
        data, at, out = self.rest + data, 0, []
        while not self.done:
            if self.need:
                taken = min(self.need, len(data) - at)
                out.append(data[at : at + taken])
                at, self.need = at + taken, self.need - taken
                if self.need:
                    break
                self.ending = True
            if self.ending:
                if len(data) - at < 2:
                    break
                if data[at : at + 2] != b"\r\n":
                    raise ValueError("chunk without end")
                at, self.ending = at + 2, False
            end = data.find(b"\r\n", at)
            if end < 0:
                if len(data) - at > LINE_LIMIT:
                    raise ValueError("chunk line too long")
                break
            line, at = data[at:end], end + 2
            if self.trailing:
                self.done = not line
                continue
            size = line.split(b";")[0].strip()
            if not HEX.fullmatch(size):
                raise ValueError("chunk without size")
            self.need = int(size, 16)
            self.trailing = not self.need
        self.rest = data[at:]
        return b"".join(out)

    def close(self) -> None:
        if self.in_head or self.framed and not self.done:
            raise ValueError("payload cut off")


def _record(fields: dict[str, object], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def _uri(url: str | None) -> str | None:
    """A URL without blanks or line ends, and without a version line at its end."""
    return None if url is None else re.sub(r"1\.1$", "1%2E1", urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~"))


def _records(run: str, chunk_bytes: int, segment_bytes: int, date: str) -> Callable:
    """Pages to records: a response in one or more segments, or a revisit."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sub_batches(batches, column="payload"):
            out = []
            for row, page, url, payload, digest, origin in zip(*(batch.column(c).to_pylist() for c in ("row", "page", "url", "payload", "digest", "origin")), strict=True):
                first = {"WARC-Record-ID": record_id(run, row), "WARC-Date": date, "WARC-Target-URI": _uri(url), "X-Page-ID": None if page is None else urllib.parse.quote(page, safe=""), "Content-Type": "application/http; msgtype=response"}
                if origin is not None:
                    out.append(_record({"WARC-Type": "revisit", **first, "WARC-Profile": PROFILE, "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "WARC-Refers-To": record_id(run, origin)}, HTTP_HEAD))
                    continue
                payload = payload or b""
                first["WARC-Payload-Digest"] = f"sha1:{digest_of(hashlib.sha1(payload))}"
                block = HTTP_HEAD + chunked(payload, chunk_bytes)
                parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                out.append(_record({"WARC-Type": "response", **first, "WARC-Segment-Number": 1 if len(parts) > 1 else None}, parts[0]))
                for n, part in enumerate(parts[1:], 2):
                    out.append(_record({"WARC-Type": "continuation", "WARC-Record-ID": record_id(run, row, n), "WARC-Date": date, "WARC-Segment-Origin-ID": first["WARC-Record-ID"], "WARC-Segment-Number": n, "WARC-Segment-Total-Length": len(block) if n == len(parts) else None}, part))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return build


def write_archives(pages: DataFrame, path: str, scratch: Scratch, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, segment_bytes: int = SEGMENT_BYTES, date: str = DATE, records_per_file: int = 200_000) -> None:
    """Write (page_id, url, html) as gzipped archives, a record per page.

    Of pages with equal payloads of at least min_bytes that of the smallest
    page_id (nulls last, then the first one of the table) is the response and the
    others revisit it.  A null html is an empty payload; null page_id or url have
    no field.  Equality is by SHA-256; hashes alone are grouped, and only rows that
    revisit are joined, by row number.  pages must give the same rows in the same
    order when read again, as tables do.
    """
    pages = pages.select(F.col("page_id").alias("page"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"), F.monotonically_increasing_id().alias("row"))
    light = pages.select("row", F.struct(F.col("page").isNull().alias("unknown"), "page", "row").alias("at"), F.unhex(F.sha2("payload", 256)).alias("hash"), F.sha1("payload").alias("digest"), F.length("payload").alias("size")).where(F.col("size") >= min_bytes)
    light = scratch.save(light.drop("size"), "hashes")
    copies = scratch.save(light.groupBy("hash").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    revisits = scratch.save(light.join(copies, "hash").where("row <> first.row").select("row", F.col("first.row").alias("origin"), "digest"), "revisits")
    rows = pages.join(revisits, "row", "left").select("row", F.col("page").cast("string").alias("page"), "url", F.when(F.col("origin").isNull(), F.col("payload")).alias("payload"), "digest", "origin")
    records = rows.mapInArrow(_records(uuid.uuid4().hex, chunk_bytes, segment_bytes, date), "value binary")
    writer = records.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines) if k}


def _page(fields: dict[str, str]) -> str | None:
    return urllib.parse.unquote(fields["x-page-id"]) if "x-page-id" in fields else None


def _whole(fields: dict[str, str], block: bytes, keep: bool) -> dict:
    """An unsegmented record, or the first of several without its payload."""
    out = {"record_id": fields.get("warc-record-id"), "page_id": _page(fields), "type": fields.get("warc-type"), "refers_to": fields.get("warc-refers-to")}
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if out["type"] == "revisit":
        return out | {"payload_digest": stated or None}
    return out | _payload([block], fields.get("content-type") or "", stated, keep)


def _payload(parts: list[bytes], content_type: str, stated: str, keep: bool) -> dict:
    body, h, n, kept = Body(content_type.startswith("application/http")), hashlib.sha1(), 0, []
    try:
        for part in parts:
            data = body.feed(part)
            h.update(data)
            n += len(data)
            if keep:
                kept.append(data)
        body.close()
    except ValueError as error:
        return {"problem": str(error)}
    return {"payload_bytes": n, "payload_digest": digest_of(h), "payload": b"".join(kept) if keep else None, "problem": "digest differs" if stated and stated != digest_of(h) else None}


def _parsed(keep: bool, schema) -> Callable:
    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in sub_batches(batches, column="value"):
            out = []
            for record in batch.column("value").to_pylist():
                head, found, block = record.partition(b"\r\n\r\n")
                if not record.strip():
                    continue
                fields = _fields(head)
                size = fields.get("content-length", "")
                if not found or not size.isdecimal() or len(block) < int(size):
                    out.append({"record_id": fields.get("warc-record-id"), "page_id": _page(fields), "type": fields.get("warc-type"), "problem": "record cut off"})
                    continue
                block = block[: int(size)]
                number = fields.get("warc-segment-number", "")
                if not number.isdecimal():
                    out.append(_whole(fields, block, keep))
                    continue
                total = fields.get("warc-segment-total-length", "")
                part = {"origin": fields.get("warc-segment-origin-id") or fields.get("warc-record-id"), "number": int(number), "total": int(total) if total.isdecimal() else None, "block": block, "type": fields.get("warc-type")}
                if part["type"] != "continuation":
                    part |= {"record_id": fields.get("warc-record-id"), "page_id": _page(fields), "content_type": fields.get("content-type") or "", "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": fields.get("warc-refers-to")}
                out.append(part)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return parse


def _reassembled(keep: bool, schema) -> Callable:
    """Segments sorted by origin and number to payloads; no more than one segment is held, unless payloads are kept."""

    def assemble(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, out, now = to_arrow_schema(schema), [], None

        def close() -> None:
            problem = now["problem"] or (None if now["number"] == now["last"] else "no last segment")
            if not problem and now["length"] != now["total"]:
                problem = "total length differs"
            if not problem:
                try:
                    now["body"].close()
                except ValueError as error:
                    problem = str(error)
            row = {k: now[k] for k in ("record_id", "page_id", "type", "refers_to")}
            if not problem:
                digest = digest_of(now["hash"])
                row |= {"payload_bytes": now["bytes"], "payload_digest": digest, "payload": b"".join(now["kept"]) if keep else None}
                problem = "digest differs" if now["digest"] and now["digest"] != digest else None
            out.append(row | {"problem": problem})

        for batch in sub_batches(batches, column="block"):
            for x in batch.to_pylist():
                if now is None or now["origin"] != x["origin"]:
                    if now is not None:
                        close()
                    now = {k: x[k] for k in ("origin", "page_id", "type", "refers_to", "digest")} | {"record_id": x["origin"], "problem": None, "number": 0, "last": None, "total": None, "length": 0, "bytes": 0, "hash": hashlib.sha1(), "kept": [], "body": Body((x["content_type"] or "").startswith("application/http"))}
                if x["number"] != now["number"] + 1:
                    now["problem"] = now["problem"] or ("segment repeated" if x["number"] == now["number"] else "segment missing")
                now["number"] = x["number"]
                now["length"] += len(x["block"])
                if x["total"] is not None:
                    now["last"], now["total"] = x["number"], x["total"]
                if not now["problem"]:
                    try:
                        data = now["body"].feed(x["block"])
                    except ValueError as error:
                        now["problem"] = str(error)
                        continue
                    now["hash"].update(data)
                    now["bytes"] += len(data)
                    if keep:
                        now["kept"].append(data)
            if len(out) >= 1000 or keep:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()
        if now is not None:
            close()
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return assemble


def read_archives(spark: SparkSession, path: str, scratch: Scratch, keep: bool = False) -> DataFrame:
    """(record_id, page_id, type, payload_bytes, payload_digest, refers_to, problem, payload) of each record but continuations.

    Bytes and digest are computed from the payload; of a revisit they are those
    of the record it refers to.  problem says what is wrong: a record or payload
    cut off, segments missing, repeated or of another total length, framing that
    can't be read, a digest other than stated, a revisit of nothing; its numbers
    are null then, but for a differing digest.  payload is null unless kept.  Other
    archives may be read too: records whose block holds a version line of its own
    are cut off there and say so.  page_id is text, of a field of these archives.
    """
    import pyspark.sql.types as T

    schema = T.StructType.fromDDL(f"{RECORD}, {PART}")
    lines = spark.read.option("lineSep", MARK).text(path).select(F.col("value").cast("binary").alias("value"))
    found = scratch.save(lines.mapInArrow(_parsed(keep, schema), schema), "records")
    final = T.StructType.fromDDL(RECORD)
    parts = found.where("origin is not null").repartition("origin").sortWithinPartitions("origin", "number")
    whole = found.where("origin is null").select(*final.names).unionByName(parts.mapInArrow(_reassembled(keep, final), final))
    whole = scratch.save(whole, "payloads")
    targets = whole.where("type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"), F.col("payload").alias("_payload"))
    seen = whole.where("type = 'revisit'").drop("payload_bytes", "payload").join(targets, "refers_to", "left")
    wrong = F.when(F.col("_bytes").isNull(), "revisit of nothing").when(F.col("payload_digest") != F.col("_digest"), "digest differs")
    seen = seen.select("record_id", "page_id", "type", F.col("_bytes").alias("payload_bytes"), F.coalesce("_digest", "payload_digest").alias("payload_digest"), "refers_to", F.coalesce("problem", wrong).alias("problem"), F.col("_payload").alias("payload"))
    return whole.where("type <> 'revisit' or type is null").unionByName(seen)


def round_trip(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, problem): pages written as archives and read back.

    One row per page, repeated ones included; a null page_id stays null, and
    revisits of a page without page_id refer to null.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    at = f"{scratch.root}/archives"
    write_archives(pages, at, scratch, min_bytes, chunk_bytes, segment_bytes)
    back = scratch.save(read_archives(spark, at, scratch).drop("payload"), "read")
    kind = pages.schema["page_id"].dataType
    names = back.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"))
    out = back.join(names, "refers_to", "left")
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("_page").cast(kind).alias("refers_to"), "problem")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, equal payloads of any size as revisits, read back from the archives; html null is an empty payload."""
    return round_trip(read_table(spark, sf_dir, "pages")).drop("problem")


QUERIES = {"op11_warc": op11_warc}
_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
ORACLE = {
    "op11_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, payload_bytes, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS k, first(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS origin,
  array_to_string(list_transform(range(32), lambda i: substr({_BASE32}, 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN origin END AS refers_to FROM d
"""
}
