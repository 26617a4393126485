"""WARC records and the resolution of not-modified revisits.

A revisit says that a page had not changed since an earlier full response. Records are parsed from WARC bytes; each
revisit is joined as of its time to the latest earlier full response of its canonical URL, their validators are held
against each other, and the headers that a 304 may bring are merged into the response's.
"""

from __future__ import annotations

import hashlib
import re
from datetime import UTC, datetime, timedelta
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudweave.llm.common import map_arrow, table, written

#: Headers that a 304 response may update (RFC 9110, 15.4.5), lower case.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that don't name another page.
TRACKING = re.compile(r"^(utm_\w+|ref|fbclid|gclid|sessionid|sid)$")
PORTS = {"http": 80, "https": 443}
#: Intervals into which the time of all records is cut; a URL's records are carried on from one to the next.
INTERVALS = 4096
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
#: Kinds of records whose block may be an HTTP response.
HTTP_KINDS = ("response", "revisit")
PROFILES = "http://netpreserve.org/warc/1.1/revisit/"
NOT_MODIFIED, SAME_PAYLOAD = f"{PROFILES}server-not-modified", f"{PROFILES}identical-payload-digest"
#: The kind that captures give a record whose length is missing, no number, or more than is left of the archive; and
#: what is put before the profile's last part for revisits that aren't of the not-modified profile.
MALFORMED, OTHER_REVISIT = "malformed", "revisit:"
#: The field of records that follow a malformed one of unknown end in their archive.
UNSURE = "unsure"
#: Pages after which the times that archived() gives begin again.
TIMES = 1_000_000


def canonical(url: str | None) -> str:
    """host/path?query of a URL: no scheme, default port, fragment, user, www or mobile label, or tracking parameter;
    the host in lower case, the parameters in order, escapes in one form. What isn't a URL is itself, stripped."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "://" in text else f"http://{text}")
        port, host = parts.port, (parts.hostname or "").rstrip(".")
    except ValueError:
        return text
    if not host:
        return text
    host = re.sub(r"^(www\d?|m|mobile)\.(?=[^.]+\.)", "", host)
    path = quote(unquote(parts.path), safe="/~!$&'()*+,;=:@-._") or "/"
    path = re.sub(r"/(index|default)\.html?$", "/", re.sub(r"/{2,}", "/", path))
    query = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not TRACKING.match(k.lower()))
    return host + (f":{port}" if port and port != PORTS.get(parts.scheme) else "") + (path.rstrip("/") or "/") + (f"?{urlencode(query)}" if query else "")


def one_line(value: str) -> str:
    """A field's value with control characters and spaces as escapes, so that it can't end its line."""
    return re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: quote(m[0], safe=""), value)


def record(kind: str, record_id: str, url: str, when: datetime, status: str, headers: list[tuple[str, str]], body: bytes = b"", refers_to: str | None = None, profile: str | None = NOT_MODIFIED) -> bytes:
    """A WARC/1.1 response or revisit record with an HTTP block."""
    http = f"HTTP/1.1 {status}\r\n{''.join(f'{k}: {v}\r\n' for k, v in headers)}\r\n".encode() + body
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", one_line(url)), ("WARC-Date", when.strftime("%Y-%m-%dT%H:%M:%S.%fZ"))]
    head += [("WARC-Payload-Digest", f"sha1:{hashlib.sha1(body).hexdigest()}")] if kind == "response" else [("WARC-Profile", profile)] if profile else []
    head += [("WARC-Refers-To-Target-URI", one_line(refers_to))] if refers_to else []
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + http + b"\r\n\r\n"


def other_record(kind: str, record_id: str, when: datetime, content_type: str, block: bytes, url: str | None = None) -> bytes:
    """A WARC/1.1 record of another kind (warcinfo, request, metadata)."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", when.strftime("%Y-%m-%dT%H:%M:%SZ"))]
    head += [("WARC-Target-URI", one_line(url))] if url else []
    head += [("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


_HEAD_LINE = re.compile(rb"\n\r?\n(?=WARC/1\.)")


def _head(block: bytes) -> tuple[str, dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines:
        name, found, value = line.partition(":")
        if found:
            fields[name.strip().lower()] = value.strip()
    return first, fields, rest


def _status(line: str) -> int | None:
    """The code of a status line; None where it has none of three digits."""
    found = re.match(r"HTTP/\S+ +([0-9]{3})(?: |$)", line)
    return int(found[1]) if found else None


def _micros(date: str | None) -> int | None:
    """Microseconds since the epoch of a WARC-Date; None where it is missing or no date. Without a zone it is in UTC."""
    try:
        when = datetime.fromisoformat((date or "").strip())
    except ValueError:
        return None
    return ((when if when.tzinfo else when.replace(tzinfo=UTC)) - EPOCH) // timedelta(microseconds=1)


def records(data: bytes):
    """The records of WARC bytes, in order: (WARC fields, HTTP status, HTTP fields, body).

    Only responses and revisits have an HTTP response's head; others, and those of another protocol, have no status and
    no HTTP fields, and their body is the block. A record without a whole number of bytes that are there has the type
    MALFORMED and no body; the next one is looked for behind its head, or behind its HTTP body where that tells its own
    length, at the beginning of a line after an empty one. Where it doesn't, a body that quotes such a head can't be told
    from a record, so all that follows in the archive has the field UNSURE.
    """
    at, sure = 0, True
    while (at := _next_head(data, at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        _, fields, _ = _head(data[at : end + 4])
        length = fields.get("content-length", "")
        if not re.fullmatch("[0-9]{1,18}", length) or end + 4 + int(length) > len(data):
            yield fields | {"warc-type": MALFORMED}, None, {}, b""
            at = _behind_http(data, end + 4)
            sure = sure and at > end + 4
            continue
        block = data[end + 4 : end + 4 + int(length)]
        http = fields.get("warc-type") in HTTP_KINDS and block.startswith(b"HTTP/")
        first, headers, body = _head(block) if http else ("", {}, block)
        if not sure:
            fields |= {UNSURE: "1"}
        yield fields, _status(first) if http else None, headers, body
        at = end + 4 + int(length)


def _next_head(data: bytes, at: int) -> int:
    """Where the next record's head begins: here, or at a line's beginning after an empty line; -1 if nowhere."""
    if data.startswith(b"WARC/1.", at):
        return at
    found = _HEAD_LINE.search(data, max(0, at - 3))
    return found.end() if found else -1


def _behind_http(data: bytes, at: int) -> int:
    """The end of an HTTP response that begins here and tells its body's length, else here."""
    end = data.find(b"\r\n\r\n", at) if data.startswith(b"HTTP/", at) else -1
    if end < 0:
        return at
    length = _head(data[at : end + 4])[1].get("content-length", "")
    return end + 4 + int(length) if re.fullmatch("[0-9]{1,18}", length) and end + 4 + int(length) <= len(data) else at


def _kind(fields: dict[str, str]) -> str | None:
    """The type, with the profile of revisits that aren't of the not-modified one (as those without a profile are)."""
    kind, profile = fields.get("warc-type"), fields.get("warc-profile", "").strip("<>").rstrip("/").rpartition("/")[2]
    return f"{OTHER_REVISIT}{profile}" if kind == "revisit" and profile not in ("", "server-not-modified") else kind


CAPTURES = "record_id string, url string, kind string, ts long, status int, headers map<string,string>, body_sha1 string, body_bytes long"
_CAPTURES = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("kind", pa.string()), ("ts", pa.int64()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body_sha1", pa.string()), ("body_bytes", pa.int64()), ("sure", pa.bool_())])


def captures(archives: DataFrame) -> DataFrame:
    """The records of archives (warc binary), by canonical URL, ts in microseconds; null archives have none.

    A revisit that names the URL of the response which it refers to goes by that. kind is the record's type, MALFORMED
    for records that can't be read,  and OTHER_REVISIT with the profile's last part for revisits of other profiles.
    sure is false behind a malformed record of unknown end: what is there may be a quotation in its body, and a response
    answers no revisit. Dates and status codes that aren't such are null. Bodies may be of any length that fits a task's memory.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in _CAPTURES.names}
            for data in batch.column("warc").to_pylist():
                for fields, status, headers, body in records(data or b""):
                    ts = _micros(fields.get("warc-date"))
                    kind = _kind(fields)
                    full = kind == "response"
                    named = fields.get("warc-refers-to-target-uri") if kind == "revisit" else None
                    row = (fields.get("warc-record-id", "").strip("<>"), canonical((named or fields.get("warc-target-uri") or "").strip("<>")), kind, ts, status, list(headers.items()), hashlib.sha1(body).hexdigest() if full else None, len(body), UNSURE not in fields)
                    for name, value in zip(_CAPTURES.names, row, strict=True):
                        out[name].append(value)
            return out

        return step

    return map_arrow(archives.select(F.col("warc").cast("binary")), make, f"{CAPTURES}, sure boolean", _CAPTURES)


def _tag(headers: str) -> Column:
    """The entity tag, weakly compared."""
    return F.regexp_replace(F.col(headers)["etag"], "^W/", "")


def resolve(found: DataFrame) -> DataFrame:
    """record_id, url, ts, verdict, response_id, body_sha1, body_bytes, headers of each revisit among captures.

    The response is the latest strictly earlier full response (status 200) of the URL; of several at one time that of
    the greatest record_id. verdict: resolved; mismatch (validators differ: the entity tags if both have one, else the
    times of modification; the response is named, its body is not taken); unchecked (no validator to hold against, the
    body is taken); orphan (no earlier response); other (a revisit of another profile, which says nothing of validators
    and is looked up nowhere). Merged headers are the response's with the permitted ones of the
    revisit; any other verdict keeps its own. Rows without a time or URL are orphans. Repeated revisits are repeated, and
    other columns are not looked at.

    A URL that holds much of the corpus is spread over up to INTERVALS intervals of time: a response is looked for in
    the interval of the revisit, and else the latest of the intervals before is carried on to it.
    """
    span = found.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    width = max(1, -(-(high - low + 1) // INTERVALS))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull() & (F.coalesce("sure", F.lit(True)) if "sure" in found.columns else F.lit(True))
    response = F.when(full, F.struct("ts", "record_id", "headers_json", "body_sha1", "body_bytes"))
    # Maps can't be compared; the struct of which the greatest is sought has them as text, behind the time and id.
    other = F.col("kind").startswith(OTHER_REVISIT)
    own = found.select("record_id", "url", "kind", "ts", "status", "headers", "body_sha1", "body_bytes", *(["sure"] if "sure" in found.columns else []))
    rows = own.where(F.col("kind").isin(*HTTP_KINDS) | other).withColumn("headers_json", F.to_json("headers")).withColumn("_at", F.floor((F.col("ts") - low) / F.lit(width))).withColumn("_full", response)
    # Rows that are looked up nowhere and answer nothing may be very many of one URL (none), so they go no further.
    known = F.col("ts").isNotNull() & (F.coalesce("url", F.lit("")) != "") & ~other
    apart, rows = rows.where(~known), rows.where(known)
    by_interval = rows.groupBy("url", "_at").agg(F.max("_full").alias("_last"))
    carried = by_interval.select("url", "_at", F.max("_last").over(Window.partitionBy("url").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = F.max("_full").over(Window.partitionBy("url", "_at").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1))
    revisits = rows.withColumn("_inside", inside).where(F.col("kind") != "response")
    joined = revisits.join(carried, ["url", "_at"], "left").withColumn("r", F.coalesce("_inside", "_carried")).drop("_inside", "_carried")
    lost = apart.where(F.col("kind") != "response").withColumn("r", F.lit(None).cast(joined.schema["r"].dataType))
    paired = joined.unionByName(lost).withColumn("theirs", F.from_json("r.headers_json", "map<string,string>"))
    both_tags = F.col("headers")["etag"].isNotNull() & F.col("theirs")["etag"].isNotNull()
    both_times = F.col("headers")["last-modified"].isNotNull() & F.col("theirs")["last-modified"].isNotNull()
    same = F.when(both_tags, _tag("headers") == _tag("theirs")).when(both_times, F.col("headers")["last-modified"] == F.col("theirs")["last-modified"])
    verdict = F.when(other, "other").when(F.col("r").isNull(), "orphan").when(same, "resolved").when(~same, "mismatch").otherwise("unchecked")
    taken = F.col("verdict").isin("resolved", "unchecked")
    fresh = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter("theirs", lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    merged = F.when(taken, F.map_concat(kept, fresh)).otherwise(F.col("headers"))
    return paired.withColumn("verdict", verdict).select(
        "record_id", "url", "ts", "verdict", F.col("r.record_id").alias("response_id"), F.when(taken, F.col("r.body_sha1")).alias("body_sha1"), F.when(taken, F.col("r.body_bytes")).alias("body_bytes"), merged.alias("headers")
    )


def archived(pages: DataFrame, others: bool = False) -> DataFrame:
    """A WARC of each page (page_id, url, html): its response, between an earlier revisit and two later ones.

    The first revisit names the tag of the page's own body before the response came, the third a tag that has changed.
    Null URLs and texts count as empty; ids may be of any size, and pages whose ids are TIMES apart have one time. others: a warcinfo, a request and a metadata record are written too.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out = []
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                body, name = (html or "").encode(), f"urn:page:{page}"
                tag = f'"{hashlib.sha1(body).hexdigest()[:16]}"'
                start = EPOCH + timedelta(seconds=1_600_000_000) + timedelta(minutes=10 * ((page or 0) % TIMES))
                date = [(start + timedelta(minutes=m)).strftime("%a, %d %b %Y %H:%M:%S GMT") for m in (0, 1, 4, 7)]
                parts = [
                    record("revisit", f"{name}:before", url or "", start, "304 Not Modified", [("ETag", tag), ("Date", date[0])]),
                    record("response", f"{name}:full", url or "", start + timedelta(minutes=1), "200 OK", [("Content-Type", "text/html"), ("Content-Length", str(len(body))), ("ETag", tag), ("Date", date[1]), ("Last-Modified", date[1])], body),
                    record("revisit", f"{name}:same", url or "", start + timedelta(minutes=4), "304 Not Modified", [("ETag", f"W/{tag}"), ("Date", date[2]), ("Cache-Control", "max-age=60"), ("Content-Length", "0"), ("Server", "x")]),
                    record("revisit", f"{name}:changed", url or "", start + timedelta(minutes=7), "304 Not Modified", [("ETag", '"changed"'), ("Date", date[3])]),
                ]
                if others:
                    info = other_record("warcinfo", f"{name}:info", start, "application/warc-fields", b"software: cloudweave\r\nformat: WARC File Format 1.1\r\n")
                    request = other_record("request", f"{name}:request", start + timedelta(minutes=1), "application/http;msgtype=request", b"GET / HTTP/1.1\r\nUser-Agent: cloudweave\r\n\r\n", url)
                    metadata = other_record("metadata", f"{name}:metadata", start + timedelta(minutes=1), "application/warc-fields", b"fetchTimeMs: 5\r\n", url)
                    parts = [info, parts[0], request, parts[1], metadata, *parts[2:]]
                out.append(b"".join(parts))
            return {"warc": out}

        return step

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), make, "warc binary", pa.schema([("warc", pa.binary())]))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits of the archives of all pages, resolved; headers as JSON text in order of their names."""
    found = written(captures(archived(table(spark, sf_dir, "pages"), others=True)), "captures")
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("headers"))))
    return resolve(found).withColumn("headers", ordered)
