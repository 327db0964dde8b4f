"""WARC archives: writing, reading and transaction assembly.

Each capture is three records: a request, a response (or a revisit of an equal payload) and metadata. The request
and the metadata name the response's record id in WARC-Concurrent-To. Archives are byte strings of whole records, held in a
binary column of a table in the shared folder, so that executors write and read them through Spark alone. The reader parses
records from bytes, joins those of one transaction through their identifiers and emits one nested row per capture.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, stored

#: Payloads below this are never revisits.
LEAST_REVISIT = 100
#: Bytes at which an archive is closed (a record is never cut).
ARCHIVE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(*parts) -> str:
    h = hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


#: A header of this writer's own: the record's URIs have their line ends and percent signs percent-encoded.
ESCAPED = "X-Loomgraph-URI-Escaped"


def _uris(uris: dict[str, str]) -> list[tuple[str, str]]:
    """Headers of URIs as they are; if one has a line end, all are escaped and say so."""
    if not any("\r" in v or "\n" in v or v != v.strip() for v in uris.values()):
        return list(uris.items())
    return [*((k, v.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20").replace("\t", "%09")) for k, v in uris.items()), (ESCAPED, "1")]


def _unescaped(value: str) -> str:
    for code, c in (("%09", "\t"), ("%20", " "), ("%0A", "\n"), ("%0D", "\r"), ("%25", "%")):
        value = value.replace(code, c)
    return value


def record(kind: str, rid: str, uri: str, body: bytes, content_type: str, refers_uri: str | None = None, **more: str) -> bytes:
    uris = {"WARC-Target-URI": uri} | ({} if refers_uri is None else {"WARC-Refers-To-Target-URI": refers_uri})
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), *_uris(uris), *((k.replace("_", "-"), v) for k, v in more.items()), ("Content-Type", content_type), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + CRLF + body + CRLF + CRLF


def _capture(page_id: str, url: str, html: bytes, digest: str, refers: str | None, refers_url: str, rid: str) -> bytes:
    """The three records of one capture; refers: the page that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    mark = f"sha256:{digest}"
    if refers is None:
        main = record("response", rid, url, http + html, "application/http; msgtype=response", WARC_Payload_Digest=mark)
    else:
        main = record("revisit", rid, url, http, "application/http; msgtype=response", refers_uri=refers_url, WARC_Payload_Digest=mark, WARC_Profile=REVISIT_PROFILE, WARC_Refers_To_Date=DATE)
    ask = record("request", record_id(rid, "request"), url, b"GET / HTTP/1.1\r\n\r\n", "application/http; msgtype=request", WARC_Concurrent_To=rid)
    fields = f"page-id: {page_id}\r\n" + (f"refers-to-page: {refers}\r\n" if refers is not None else "")
    meta = record("metadata", record_id(rid, "metadata"), url, fields.encode(), "application/warc-fields", WARC_Concurrent_To=rid)
    return ask + main + meta


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, digest, refers_to, refers_uri) -> one archive a row."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    held, size, n = [], 0, 0
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(6))):
            page, url, html, digest, refers, refers_url = (x.as_py() for x in row)
            page = "" if page is None else str(page)
            # Every row has an id of its own, so repeated rows stay apart; a revisit names the URI of what it repeats.
            rid = record_id(page, digest, part, n)
            n += 1
            held.append(_capture(page, url or "", html or b"", digest, None if refers is None else str(refers), refers_url or "", rid))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """page_id, url, html (binary), digest, refers_to and refers_uri (null for a response).

    Of rows with equal payloads of at least LEAST_REVISIT bytes, those with the smallest page_id are responses and the others
    refer to it; rows that repeat the smallest id with its payload are all responses. A null payload is empty; a null id
    is never the smallest where there is another.
    """
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).alias("url"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    least = rows.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("least"), F.min_by("url", "page_id").alias("uri"), F.count("*").alias("n")).filter("n > 1").select("digest", "least", "uri")
    again = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    return rows.join(least, "digest", "left").select("page_id", "url", "html", "digest", F.when(again, F.col("least")).alias("refers_to"), F.when(again, F.col("uri")).alias("refers_uri"))


def write_archives(pages: DataFrame, **columns: str) -> DataFrame:
    """A stored table with one archive of whole records a row (column archive)."""
    return stored(with_revisits(pages, **columns).mapInArrow(_archives, "archive binary"), "warc")


_NONE = dict.fromkeys(("uri", "date", "concurrent_to", "refers_to", "digest", "http_head", "payload_bytes", "payload_digest", "payload", "fields"))


def _fault(at: int, end: int, why: str) -> dict:
    return _NONE | {"id": None, "type": "fault", "fields": {"at": str(at), "bytes": str(end - at), "reason": why}}


def parse(archive: bytes) -> Iterator[dict]:
    """The records of an archive, whatever its bytes. Where one is broken (no version line, no end of its headers, no length
    or a wrong one), a row of type fault says where, how many bytes and why, and reading goes on at the next version line."""
    at, bad, why = 0, -1, ""
    while at < len(archive):
        r, end = _record(archive, at)
        if isinstance(r, str):
            if bad < 0:
                bad, why = at, r
            found = archive.find(b"WARC/1.", at + 1)
            at = found if found >= 0 else len(archive)
            continue
        if bad >= 0:
            yield _fault(bad, at, why)
            bad = -1
        yield r
        at = end
    if bad >= 0:
        yield _fault(bad, len(archive), why)


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch("[0-9]{1,18}", text) else None


def _record(archive: bytes, at: int) -> tuple[dict | str, int]:
    """(a record and where the next one starts) or (why there is none, at)."""
    if not archive.startswith(b"WARC/", at):
        return "no version line", at
    end = archive.find(b"\r\n\r\n", at)
    if end < 0:
        return "headers without an end", at
    if re.search(rb"WARC/1\.[0-9]\r\n", archive[at + 1 : end]):
        return "headers cut by another record", at
    headers: dict[str, list[str]] = {}
    for line in archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        headers.setdefault(k.strip().lower(), []).append(v.strip())
    one = lambda k: headers.get(k, [None])[0]
    length = _number(one("content-length"))
    if length is None:
        return "no length", at
    body = archive[end + 4 : end + 4 + length]
    after = end + 4 + length
    if len(body) < length:
        return "truncated", at
    if archive[after : after + 4] != b"\r\n\r\n":
        return "length and end differ", at
    kind = one("warc-type") or ""
    text = _unescaped if one(ESCAPED.lower()) == "1" else str
    r = _NONE | {"id": one("warc-record-id"), "type": kind, "uri": text(one("warc-target-uri") or ""), "date": one("warc-date"), "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": text(one("warc-refers-to-target-uri") or "") or None, "digest": one("warc-payload-digest")}
    if kind in ("request", "response", "revisit"):
        head, _, payload = body.partition(b"\r\n\r\n")
        r["http_head"] = head.decode("utf-8", "replace")
        if kind == "revisit":
            r["payload_bytes"] = _number(next((x.partition(":")[2].strip() for x in r["http_head"].split("\r\n") if x.lower().startswith("content-length:")), None))
            r["payload_digest"] = (r["digest"] or "").removeprefix("sha256:") or None
        else:
            r |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    elif kind == "metadata":
        r["fields"] = dict(x.split(": ", 1) for x in body.decode("utf-8", "replace").split("\r\n") if ": " in x)
    return r, after + 4


_KEPT = ("id", "type", "uri", "date", "concurrent_to", "refers_to", "digest", "http_head", "payload_bytes", "payload_digest", "payload", "fields")
_KINDS = dict.fromkeys(_KEPT, pa.string()) | {"payload_bytes": pa.int64(), "payload": pa.binary(), "fields": pa.map_(pa.string(), pa.string()), "concurrent_to": pa.list_(pa.string())}
_SQL = {"payload_bytes": "long", "payload": "binary", "fields": "map<string,string>", "concurrent_to": "array<string>"}
SCHEMA = ", ".join(f"{c} {_SQL.get(c, 'string')}" for c in _KEPT)


def read_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the binary column archive, faults included (see parse()); payload is null if payloads is False.
    A null archive has no records."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                rows = [r if payloads else r | {"payload": None} for r in parse(x.as_py() or b"")]
                cols = [pa.array([list(r[c].items()) if c == "fields" and r[c] is not None else r[c] for r in rows], _KINDS[c]) for c in _KEPT]
                yield pa.RecordBatch.from_arrays(cols, names=list(_KEPT))

    return archives.select("archive").mapInArrow(read, SCHEMA)


def captures(records: DataFrame) -> DataFrame:
    """One row per capture: its id and uri, and the nested request, main (response or revisit) and metadata records.

    Records meet through concurrent-to identifiers; one that names several stands in each of these captures; a part that is missing is null.
    Repeated records of a kind: the one of the smallest id stands. Faults and records without an identifier are in none.
    """
    keyed = records.filter("type <> 'fault'").withColumn("capture", F.explode(F.when(F.size("concurrent_to") > 0, F.col("concurrent_to")).otherwise(F.array("id")))).filter("capture is not null")
    pick = lambda kinds: F.min_by(F.when(F.col("type").isin(*kinds), F.struct(*_KEPT)), F.when(F.col("type").isin(*kinds), F.col("id")))
    return keyed.groupBy("capture").agg(pick(["request"]).alias("request"), pick(["response", "revisit"]).alias("main"), pick(["metadata"]).alias("metadata"))


def report(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives, reads them back and returns one row per capture. Repeated rows each have a row; a null url
    or id is empty there and null in the result; a payload of any length is one record; an empty table gives an empty result; other columns
    are ignored, whatever their names."""
    got = captures(read_records(write_archives(pages), payloads=False))
    m = F.col("main")
    return got.filter(m.isNotNull()).select(F.expr("try_cast(metadata.fields['page-id'] AS long)").alias("page_id"), m["payload_bytes"].alias("payload_bytes"), m["payload_digest"].alias("payload_digest"), m["type"].alias("record_type"), F.expr("try_cast(metadata.fields['refers-to-page'] AS long)").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS least, strlen(html) AS n FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND least <> page_id THEN least END AS refers_to FROM q
"""
