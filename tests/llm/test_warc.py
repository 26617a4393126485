import random
from datetime import timedelta

from cloudweave.llm import warc


def test_canonical_urls():
    same = ["http://www.Example.com/a/?b=2&a=1&utm_source=z#frag", "https://example.com:443/a?a=1&b=2", "m.example.com/a/?ref=q&b=2&a=1", "https://user@example.com./a//?a=1&b=2"]
    assert {warc.canonical(u) for u in same} == {"example.com/a?a=1&b=2"}
    assert warc.canonical("http://example.com") == warc.canonical("https://example.com/index.html") == "example.com/"
    assert warc.canonical("http://example.com:8080/%7Ex y") == "example.com:8080/~x%20y"
    assert warc.canonical(None) == warc.canonical(" ") == "" and warc.canonical("http://[bad") == "http://[bad"


def test_records_round_trip():
    when = warc.EPOCH + timedelta(days=1, microseconds=5)
    data = warc.record("response", "a", "http://x/", when, "200 OK", [("ETag", '"1"')], b"WARC/1.0 body\r\n\r\nmore") + warc.record("revisit", "b", "http://x/", when, "304 Not Modified", [])
    got = list(warc.records(data))
    assert [(g[0]["warc-record-id"], g[1], g[3]) for g in got] == [("<a>", 200, b"WARC/1.0 body\r\n\r\nmore"), ("<b>", 304, b"")]
    assert got[0][2] == {"etag": '"1"'} and not list(warc.records(b"")) and not list(warc.records(b"WARC/1.1 cut"))


def test_other_kinds_and_bad_dates(spark):
    when = warc.EPOCH + timedelta(days=1)
    info = warc.other_record("warcinfo", "i", when, "application/warc-fields", b"software: x\r\nformat: y\r\n")
    request = warc.other_record("request", "q", when, "application/http;msgtype=request", b"GET /x HTTP/1.1\r\nHost: x\r\n\r\n", "http://x/")
    dns = warc.other_record("response", "d", when, "text/dns", b"20200101\r\nx. 60 IN A 1.2.3.4\r\n", "dns:x")
    full = warc.record("response", "f", "http://x/", when, "200 OK", [], b"body")
    undated = warc.record("revisit", "u", "http://x/", when, "304", []).replace(b"WARC-Date: 1970-01-02T00:00:00.000000Z\r\n", b"")
    bad = warc.record("revisit", "b", "http://x/", when, "Not a code", []).replace(b"1970-01-02T00", b"soon")
    found = warc.captures(spark.createDataFrame([(bytearray(info + request + dns + full + undated + bad),)], "warc binary")).collect()
    day = 86_400_000_000
    assert [(r.record_id, r.kind, r.ts, r.status) for r in found] == [("i", "warcinfo", day, None), ("q", "request", day, None), ("d", "response", day, None), ("f", "response", day, 200), ("u", "revisit", None, 304), ("b", "revisit", None, None)]


def test_archives_with_other_records_resolve_alike(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<p>1"), (2, None, None)], "page_id long, url string, html string")
    mixed = warc.captures(warc.archived(pages, others=True))
    assert mixed.groupBy("kind").count().where("kind in ('warcinfo', 'request', 'metadata') and count = 2").count() == 3
    assert sorted(map(repr, warc.resolve(mixed).collect())) == sorted(map(repr, warc.resolve(warc.captures(warc.archived(pages))).collect()))


def plain(rows):
    out = []
    for i, u, k, t, _, h, _, _ in rows:
        if k != "revisit":
            continue
        past = [r for r in rows if r[2] == "response" and r[4] == 200 and r[1] == u and u and t is not None and r[3] is not None and r[3] < t]
        r = max(past, key=lambda r: (r[3], r[0]), default=None)
        if r is None:
            out.append((i, "orphan", None, None, h))
            continue
        theirs = r[5]
        same = None
        if "etag" in h and "etag" in theirs:
            same = h["etag"].removeprefix("W/") == theirs["etag"].removeprefix("W/")
        elif "last-modified" in h and "last-modified" in theirs:
            same = h["last-modified"] == theirs["last-modified"]
        verdict = {None: "unchecked", True: "resolved", False: "mismatch"}[same]
        merged = h if verdict == "mismatch" else theirs | {k: v for k, v in h.items() if k in warc.PERMITTED}
        out.append((i, verdict, r[0], None if verdict == "mismatch" else r[6], merged))
    return sorted(out, key=repr)


def test_resolve_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "INTERVALS", 7)
    rng = random.Random(2)
    rows = []
    for i in range(400):
        full = rng.random() < 0.4
        headers = {k: rng.choice(["1", "W/1", "2"]) for k in ("etag", "last-modified", "date", "server") if rng.random() < 0.5}
        url = rng.choice(["hot"] * 6 + ["a", "b", "c", "lone", ""])
        ts = None if rng.random() < 0.03 else rng.randint(0, 120)
        rows.append((f"r{i}", url, "response" if full else "revisit", ts, rng.choice([200, 200, 404]) if full else 304, headers, f"s{i}" if full else None, i))
    rows += [r for r in rows if r[0] == "r7"]
    got = warc.resolve(spark.createDataFrame(rows, warc.CAPTURES)).collect()
    assert sorted(((r.record_id, r.verdict, r.response_id, r.body_sha1, dict(r.headers)) for r in got), key=lambda x: repr((x[:4], sorted(x[4].items())))) == sorted(plain(rows), key=lambda x: repr((x[:4], sorted(x[4].items()))))


def test_pages_to_revisits(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com/x?ref=1", "<p>é"), (2, "https://a.example.com/x#y", "<p>other"), (3, None, None), (None, "http://b/", "")], "page_id long, url string, html string")
    found = warc.captures(warc.archived(pages))
    assert found.count() == 16
    got = {r.record_id: r for r in warc.resolve(found).collect()}
    assert got["urn:page:1:before"].verdict == "orphan" and got["urn:page:2:before"].verdict == "mismatch"
    same = got["urn:page:2:same"]
    assert same.verdict == "resolved" and same.response_id == "urn:page:2:full" and same.headers["cache-control"] == "max-age=60" and "server" not in same.headers
    assert got["urn:page:2:changed"].verdict == "mismatch" and got["urn:page:3:same"].verdict == "orphan"
    assert warc.resolve(found.limit(0)).count() == 0


def test_malformed_records_are_passed_by(spark):
    when = warc.EPOCH + timedelta(days=1)
    full = warc.record("response", "f", "http://x/", when, "200 OK", [("ETag", "1")], b"body")
    long = warc.record("response", "l", "http://x/", when, "200 OK", [], b"WARC/1.1\r\n" + b"x" * 3_000_000)
    bad = [full.replace(b"Content-Length: ", b"Content-Length: " + w).replace(b"<f>", b"<b>") for w in (b"x", b"-", b"1.", b"99999999", b"9" * 30)]
    none = full.replace(b"Content-Length", b"Length").replace(b"<f>", b"<b>")
    archives = [b"".join(bad[:3]) + full + none + full, long + full + bad[3], bad[4] + full, full[:-12], None, b"", b"WARC/1.1\r\n\r\n", b"no archive"]
    rows = [(bytearray(a) if a is not None else None, "u", 5) for a in archives]
    found = warc.captures(spark.createDataFrame(rows, "warc binary, url string, ts int"))
    counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    assert counts == {"response": 5, warc.MALFORMED: 8}
    assert {(r.record_id, r.body_bytes) for r in found.where("kind = 'response'").collect()} == {("f", 4), ("l", 3_000_010)}
    assert found.where("kind = 'malformed' and (status is not null or body_bytes > 0)").count() == 0 and warc.resolve(found).count() == 0


def test_profiles_and_named_urls(spark):
    when = warc.EPOCH + timedelta(days=1)
    late = when + timedelta(minutes=1)
    data = b"".join(
        [
            warc.record("response", "f", "http://x/a", when, "200 OK", [("ETag", "1")], b"body"),
            warc.record("revisit", "same", "http://x/a", late, "304", [("ETag", "1")]),
            warc.record("revisit", "plain", "http://x/a", late, "304", [("ETag", "1")], profile=None),
            warc.record("revisit", "old", "http://x/a", late, "304", [("ETag", "1")], profile="http://netpreserve.org/warc/1.0/revisit/server-not-modified"),
            warc.record("revisit", "digest", "http://x/a", late, "200 OK", [("ETag", "1")], profile=warc.SAME_PAYLOAD),
            warc.record("revisit", "elsewhere", "http://y/b", late, "304", [("ETag", "1")], refers_to="https://x/a/"),
            warc.record("revisit", "lost", "http://y/b", late, "304", [("ETag", "1")]),
        ]
    )
    found = warc.captures(spark.createDataFrame([(bytearray(data),)], "warc binary")).selectExpr("*", "5 as verdict", "'x' as response_id", "1 as _at", "2 as r")
    got = {r.record_id: (r.verdict, r.response_id, r.body_bytes) for r in warc.resolve(found).collect()}
    resolved = ("resolved", "f", 4)
    assert got == {"same": resolved, "plain": resolved, "old": resolved, "elsewhere": resolved, "digest": ("other", None, None), "lost": ("orphan", None, None)}


def test_ids_of_any_size(spark):
    ids = [0, -1, 420_000_000, 2**62, -(2**63), 2**63 - 1]
    pages = spark.createDataFrame([(i, f"http://h{k}/", "<p>", "clash") for k, i in enumerate(ids)], "page_id long, url string, html string, warc string")
    got = warc.resolve(warc.captures(warc.archived(pages, others=True))).collect()
    assert len(got) == 3 * len(ids) and sum(r.verdict == "resolved" for r in got) == len(ids)


def test_quoted_heads_and_urls_of_several_lines(spark):
    when = warc.EPOCH + timedelta(days=1)
    evil = warc.record("response", "evil", "http://evil/", when, "200 OK", [("ETag", "1")], b"x")
    spoil = lambda r: r.replace(b"Content-Length: ", b"Content-Length: x", 1)
    told = spoil(warc.record("response", "t", "http://a/", when, "200 OK", [("Content-Length", str(len(evil) + 4))], b"\r\n\r\n" + evil))
    inline = spoil(warc.record("response", "i", "http://a/", when, "200 OK", [], b"see " + evil))
    untold = spoil(warc.record("response", "u", "http://a/", when, "200 OK", [], b"\r\n\r\n" + evil))
    good = warc.record("response", "good", "http://b/", when, "200 OK", [("ETag", "1")], b"body")
    late = warc.record("revisit", "late", "http://evil/", when + timedelta(minutes=1), "304", [("ETag", "1")])
    split = warc.record("response", "s", "http://c/\r\nWARC-Type: revisit\r\nx: ", when, "200 OK", [], b"")
    archives = [told + good, inline + good, untold + good, split, late]
    found = warc.captures(spark.createDataFrame([(bytearray(a),) for a in archives], "warc binary"))
    rows = sorted((r.record_id, r.kind, r.sure) for r in found.where("kind <> 'malformed'").collect())
    assert rows == [("evil", "response", False), ("good", "response", False), ("good", "response", False), ("good", "response", True), ("late", "revisit", True), ("s", "response", True)]
    assert {r.record_id: r.url for r in found.collect()}["s"].startswith("c/")
    assert [(r.record_id, r.verdict) for r in warc.resolve(found).collect()] == [("late", "orphan")]


def test_rows_that_are_looked_up_nowhere_share_no_task(spark):
    when = 1_000_000
    rows = [(f"n{i}", "", "revisit", when, 304) for i in range(400)] + [(f"t{i}", "x/", "revisit", None, 304) for i in range(400)] + [("r", "x/", "response", 5, 200), ("v", "x/", "revisit", 9, 304), ("none", None, "revisit", 9, 304)]
    found = spark.createDataFrame([(*r, {}, None, 1) for r in rows], "record_id string, url string, kind string, ts long, status int, headers map<string,string>, body_sha1 string, body_bytes long")
    got = {r.record_id: (r.verdict, r.response_id) for r in warc.resolve(found).collect()}
    assert got.pop("v") == ("unchecked", "r") and len(got) == 801 and set(got.values()) == {("orphan", None)}
