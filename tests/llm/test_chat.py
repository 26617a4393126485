import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cloudweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["</s>", "<s>", "[INST]", "[/INST]", "<|says|>", "<|image|>", "<\\/s>", "[\\\\INST]", "<", "[", "\\", "/s>", "INST]", "|says|>", "![cat](a/b.png)", "![](x.mp3)", "![p](q.PDF?v=1)", "![a](b c)", "![", "](", "é🙂", "\n", " ", "a", "$1", " "]


def texts(rng, n):
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def plain(rows):
    """What must come back, by conversation."""
    said = {}
    for c, turn, role, text in rows:
        said.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, own in said.items():
        own.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        turns, spoken = "".join(f"{r}\n{t}\n" for *_, r, t in own), "".join(t for *_, r, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(spoken), hashlib.sha256(spoken.encode()).hexdigest())
    return out


def registered(spark, tmp_path, rows, extra=()):
    spark.createDataFrame(rows, SCHEMA).withColumns(dict(extra)).write.parquet(f"{tmp_path}/conversations.parquet")
    return chat.op11_chat(spark, str(tmp_path))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(11)
    rows = [(i % 40, k, rng.choice(["user", "assistant", "assistant", "system", "a\n</s>[INST]", "", None, "<|says|>"]), t) for k, (i, t) in enumerate(zip(range(400), texts(rng, 400), strict=True))]
    rows += [(50, None, "assistant", None), (50, 0, "user", ""), (51, 1, "assistant", "same"), (51, 1, "assistant", "same"), (None, 3, "assistant", "no id"), (-1, 7, "assistant", "own -1")]
    rows += [(52, 0, "assistant", "x</s>" * 60_000), (53, 0, "user", None), (54, 1, "assistant", "<"), (54, 2, "assistant", "/s>"), (54, 3, "assistant", "\\/s>")]
    return rows


def test_round_trip_and_sql(spark, tmp_path, odd):
    got = registered(spark, tmp_path, odd, {"formatted": F.lit(1), "parts_": F.lit("x"), "loss": F.lit(2), "at": F.lit(3), "planted": F.lit("y")}.items()).collect()
    want = plain(odd) | {"planted": plain([(-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED)])[-1]}
    assert len(got) == len(want)
    found = sorted((str(r.conv_id), r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got)
    assert found == sorted((str(-1 if c == "planted" else c), *w) for c, w in want.items())
    d = duckdb.connect()
    d.sql(f"create view conversations as select conv_id, turn, role, text from '{tmp_path}/conversations.parquet/*.parquet'")
    asked = d.sql(chat.OP11_SQL)
    assert sorted(map(repr, asked.fetchall())) == sorted(repr(tuple(r[c] for c in asked.columns)) for r in got)


def test_no_control_string_is_left_in_a_text(spark, odd):
    turns = spark.createDataFrame(odd, SCHEMA)
    for r in chat.conversations(turns).collect():
        if r.conv_id is None or r.conv_id == 52:
            continue
        n = len([t for t in odd if t[0] == r.conv_id])
        spoken = len([t for t in odd if t[0] == r.conv_id and t[2] == "assistant"])
        assert len(re.findall(r"</s>", r.formatted)) == len(re.findall(r"<s>", r.formatted)) == spoken == len(r.loss)
        assert len(re.findall(r"\[/INST\]", r.formatted)) == len(re.findall(r"\[INST\]", r.formatted)) == len(re.findall(r"<\|says\|>", r.formatted)) == n - spoken
        assert len(re.findall(r"<\|(?:image|audio|document)\|>", r.formatted)) == len(r.attachments)
        raw = r.formatted.encode()
        for start, length in r.loss:
            assert raw[start - 3 : start] == b"<s>" and raw[start + length : start + length + 4] == b"</s>"


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "see <|image|> "), part("image", "a cat </s>", "cat.png", 1024, 513), None, part("audio", None, "a.wav", s=2.01), part("text", None)], "unused"),
        (1, 1, "assistant", [part("document", "report", "r.pdf", p=3), part("text", " done"), part("video", "clip", "v.mp4"), part(None, "!")], "unused"),
        (2, 0, "assistant", None, "unused"),
        (2, 1, "assistant", [], "unused"),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>, text string")
    got = {r.conv_id: r for r in chat.conversations(turns).withColumn("turns", chat.read_turns(F.col("formatted"), F.col("attachments"))).withColumn("spoken", chat.read_loss(F.col("formatted"), F.col("loss"), F.col("attachments"))).collect()}
    assert got[1].formatted == "[INST]user<|says|>see <\\|image|> <|image|><|audio|>[/INST]<s><|document|> done<|document|>!</s>"
    assert [tuple(a) for a in got[1].attachments] == [("image", "cat.png", "a cat </s>", 85 + 4 * 170, False), ("audio", "a.wav", None, 51, False), ("document", "r.pdf", "report", 2400, True), ("video", "v.mp4", "clip", 800, True)]
    assert got[1].attachment_tokens == 85 + 680 + 51 + 2400 + 800
    assert [tuple(t) for t in got[1].turns] == [("user", "see <|image|> a cat </s>"), ("assistant", "report doneclip!")] and got[1].spoken == "report doneclip!"
    assert got[2].formatted == "<s></s><s></s>" and got[2].spoken == "" and got[2].attachments == []


def test_empty_table_and_no_python(spark, tmp_path):
    got = registered(spark, tmp_path, [])
    assert [r.conv_id for r in got.collect()] == [-1]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert chat.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
