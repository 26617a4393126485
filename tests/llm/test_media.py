import hashlib
import random
import zlib

from cloudweave.llm import media


def test_parse_keeps_order_positions_and_captions():
    html = """<html><script>var x="<p>no</p>"</script><body><h1>Title &amp; more</h1><p>One <b>two</b><br>three
    <img src="sha256:aa" alt="first  one"> four</p><figure><img src='sha256:bb'><img src="http://x/y.png" alt="z">
    <figcaption>Both <i>of them</i></figcaption></figure><video src="sha256:cc" title="clip"></video><img alt="none">tail"""
    got = [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in media.parse(html)]
    assert got == [
        (0, "text", "Title & more", None, None),
        (1, "text", "One two", None, None),
        (2, "text", "three", None, None),
        (3, "media", None, "aa", "first one"),
        (4, "text", "four", None, None),
        (5, "media", None, "bb", "Both of them"),
        (6, "media", None, None, "Both of them"),
        (7, "media", None, "cc", "clip"),
        (8, "text", "tail", None, None),
    ]
    assert media.parse(None) == media.parse("") == [] and media.parse("<p>open <img")[0]["text"].startswith("open")


def test_resolved_by_digest(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="sha256:k1" alt="c1"><p>b<img src="sha256:k2" alt="c2">'), (2, '<img src="sha256:k1">'), (3, None)], "doc_id long, html string")
    payloads = spark.createDataFrame([("k1", 10)], "digest string, size long")
    got = sorted(tuple(r) for r in media.resolved(media.sequences(pages), payloads).select("doc_id", "position", "caption", "digest", "size").fillna("-").fillna(-1).collect())
    assert got == [(1, 1, "c1", "k1", 10), (1, 3, "c2", "k2", -1), (2, 0, "-", "k1", 10)]


def plain_interleaved(html, payloads):
    return [(i["position"], i["kind"], i["text"], i["caption"], i["digest"], payloads.get(i["digest"]) if i["digest"] else None) for i in media.parse(html)]


def test_sequences_interleave_texts_and_resolved_media(spark):
    rng = random.Random(5)
    parts = ["<p>text {}</p>", 'loose {} <b>words</b>', '<img src="sha256:k{}" alt="alt {}">', "<figure><img src='sha256:k{}'><img src='http://x/{}'><figcaption>cap</figcaption></figure>", '<img src="http://plain/{}" title="t">', "<script>{}</script>", '<video src="sha256:hot">{}</video>']
    pages = ["".join(rng.choice(parts).replace("{}", str(rng.randint(0, 6))) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    pages += [None, "", "<p></p>", "<p>" + "long " * 20000 + '<img src="sha256:hot">', pages[0], pages[0]]
    rows = [(k, None if k % 7 == 0 else k % 50, h, "x") for k, h in enumerate(pages)]
    payloads = {f"k{k}": 10 * k for k in range(5)} | {"hot": 1}
    table = spark.createDataFrame([(d, n) for d, n in payloads.items()], "digest string, size long")
    found = media.interleaved(media.sequences(spark.createDataFrame(rows, "row_id long, doc_id long, html string, items string"), "row_id"), table)
    got = {r.row_id: (r.doc_id, [(i.position, i.kind, i.text, i.caption, i.digest, i.payload.size if i.payload else None) for i in r["items"]]) for r in found.collect()}
    assert got == {k: (d, plain_interleaved(h, payloads)) for k, d, h, _ in rows} and len(got) == len(rows)


def test_images_of_texts(spark):
    texts = [None, "", "x", "é" * 96, "é" * 96 + "y", "line\n" * 1000, "same", "same", "z" * 400000]
    docs = spark.createDataFrame([(i if i else None, t, "f") for i, t in enumerate(texts)] + [(6, "same", "f")], "doc_id long, text string, feature string")
    got = media.image_sequences(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        data = (texts[r.doc_id or 0] or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        stored, tail = media.store(data), media.store(data[-(len(data) % 192 or 192) :] if data else b"")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.feature(media.read_back(stored)[1]) 
        heading = " ".join((texts[r.doc_id or 0] or "")[:400].split())[:80]
        assert (r.position, r.caption) == (int(bool(heading)), f"Text of {len(data)} bytes")
        assert [i.kind for i in r["items"]] == ["text"] * bool(heading) + ["media", "text", "media", "text"] and [i.position for i in r["items"]] == list(range(len(r["items"])))
        if heading:
            assert r["items"][0].text == heading.strip()
        last = r["items"][-2]
        assert last.digest == hashlib.sha256(tail).hexdigest() and last.caption == "last row" and last.payload.feature == media.feature(media.read_back(tail)[1])
    same = [r for r in got if r.doc_id in (6, 7)]
    assert len({repr(r[1:]) for r in same}) == 1 and len(same) == 3
    assert media.image_sequences(docs.limit(0)).count() == 0


def test_pages_are_parsed_once_and_texts_are_not_exploded(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    plan = media.image_sequences(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan  # the one that reads the images back


def test_a_digest_that_many_pages_name(spark):
    rows = [(k, k, '<img src="sha256:hot">' * (k % 3) + f'<p>t{k}</p><img src="sha256:k{k}"><img src="sha256:hot" alt="last">') for k in range(3000)]
    table = spark.createDataFrame([("hot", 1), ("k7", 7)], "digest string, size long")
    found = media.interleaved(media.sequences(spark.createDataFrame(rows, "row_id long, doc_id long, html string"), "row_id"), table)
    got = {r.row_id: [(i.digest, i.payload.size if i.payload else None) for i in r["items"] if i.kind == "media"] for r in found.collect()}
    assert got == {k: [("hot", 1)] * (k % 3) + [(f"k{k}", 7 if k == 7 else None), ("hot", 1)] for k in range(3000)}
