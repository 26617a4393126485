import random
import re

from cloudweave.llm import rules
from cloudweave.llm.common import table


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " \n\t ", "one", " two words\n", "a a a a", "x y z x y z", "l1\nl1\n\n\nl2 \nl2", "é🙂 ünï <b> | & $", "a\x0bb\x0cc\rd e", "w\x85v u"]
    texts += ["".join(rng.choice("ab \n#") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts.append("p q r s " * 20000)
    docs = spark.createDataFrame([(i, t, "h", 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, kept int")
    got = {r.doc_id: r for r in rules.judged(docs).collect()}
    for i, t in enumerate(texts[:-1]):
        assert tuple(got[i][f] for f in rules.FEATURES) == plain(t), repr(t)
        assert got[i].base_failed == (plain(t)[0] < 50 or 100 * plain(t)[4] > 50 * plain(t)[0])
    assert got[len(texts) - 1].n_repeat_words == 80000 and got[len(texts) - 1].base_failed


def test_host_verdicts(spark):
    rng = random.Random(19)

    def text(symbols):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(100)]
        return " ".join(w + ("#" if i < symbols else "") for i, w in enumerate(words))

    rows = [(i, text(0), f"good{i % 9}") for i in range(180)] + [(500 + i, text(90), "bad") for i in range(60)]
    rows += [(600, text(45), "bad"), (601, text(45), "good1"), (602, text(0), "bad"), (603, text(90), "good1"), (None, text(0), None), (604, text(0), None), (604, text(0), None)]
    got = {r.doc_id: r.kept for r in rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[500 + i] for i in range(60)) and all(got[i] for i in range(180))
    assert (got[600], got[601], got[602], got[603], got[None], got[604]) == (False, True, True, False, True, True)


def test_empty_table(spark):
    assert rules.judged(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_hosts_decide_on_the_registered_table(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "source", "text")
    got = {r.doc_id: (r.kept, r.base_failed) for r in rules.judged(docs, drop=("text",)).collect()}
    without = {r.doc_id: r.kept for r in rules.judged(docs, limits=rules.Limits().without_hosts(), drop=("text",)).collect()}
    changed = [d for d in got if got[d][0] != without[d]]
    assert changed and not any(got[d][1] for d in changed)
    good = [r.doc_id for r in table(spark, "/root/testdata/sf0.1", "labels").where("quality = 1").collect()]
    assert all(got[d][0] or got[d][1] for d in good)


def test_limits_fall_with_the_rate(spark):
    rows = [(i, f"h{h}", 60, 600, 120 if i % 10 < h else 0, 0, 0, 5) for h in range(5) for i in range(2000)]
    counted = spark.createDataFrame(rows, "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, _n_lines long")
    got = {r._host: (r._symbols, r._dups) for r in rules.host_limits(counted, "source", rules.Limits()).collect()}
    assert sorted(got.values(), reverse=True) == [got[f"h{h}"] for h in range(5)] and 5000 <= got["h4"][0] < 5050 and 14900 < got["h0"][0] <= 15000
    assert abs(got["h2"][0] - 10000) < 50 and len(set(got.values())) == 5


def test_windows_of_one_hash_are_told_apart_by_their_words(spark, monkeypatch):
    monkeypatch.setattr(rules.F, "xxhash64", lambda *words: rules.F.lit(7).cast("long"))
    texts = ["a b c d e f", "a b c x a b c", "a b c x y z a b d x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in rules.counts(docs).collect()}
    assert [got[i] for i in range(3)] == [plain(t)[4] for t in texts]
