import itertools
import random

import numpy as np

from cloudweave.llm import toxicity


def plain_marginals(e, pair, start):
    total, one = 0.0, np.zeros(len(e))
    for tags in itertools.product((0, 1), repeat=len(e)):
        w = np.exp(start[tags[0]] + sum(e[i] for i, t in enumerate(tags) if t) + sum(pair[a, b] for a, b in zip(tags, tags[1:])))
        total += w
        one += w * np.array(tags)
    return one / total


def test_marginals_against_all_taggings():
    rng = np.random.default_rng(6)
    pair, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    for lengths in ([1], [3, 1, 7], [8, 8, 2, 1, 1, 5]):
        parts = [rng.normal(size=n) * 3 for n in lengths]
        firsts = np.cumsum(lengths) - lengths
        got = toxicity.marginals(np.concatenate(parts), firsts, pair, start)
        assert np.allclose(got, np.concatenate([plain_marginals(e, pair, start) for e in parts]))
    assert len(toxicity.marginals(np.zeros(0), np.zeros(0, int), pair, start)) == 0


def test_long_texts_in_blocks():
    rng = np.random.default_rng(7)
    pair, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    for n in (0, 1, 4, 5, 9, 10, 11, 1003):
        e = rng.normal(size=n) * 3
        want = toxicity.marginals(e, np.zeros(min(1, n), int), pair, start)
        assert np.allclose(toxicity.marginals_of_long(e, pair, start, 5), want, atol=1e-12)
    e = rng.normal(size=9) * 3
    assert np.allclose(toxicity.marginals_of_long(e, pair, start, 4), plain_marginals(e, pair, start))


def test_runs_of_texts_give_the_same_scores():
    rng = random.Random(8)
    fitted = toxicity.fit([t for _, t, _ in sample()], [x for _, _, x in sample()])
    texts = ["", *(" ".join(rng.choice(["vilename", "abcde", "rottenish", "gfedc"]) for _ in range(rng.choice([0, 1, 3, 40, 300]))) for _ in range(60)), "", "rottenest " * 2000]
    want = toxicity.Tagger(fitted).score(texts)
    alone = [toxicity.Tagger(fitted).score([t]) for t in texts]
    for chain in (1, 7, 50, 10_000):
        got = toxicity.Tagger(fitted).score(texts, chain)
        assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1]) and got[2] == want[2]
    assert np.allclose([a[0][0] for a in alone], want[0]) and sum(want[2]) == len(want[1]) > 5000


def test_a_batch_of_long_texts_in_bounded_memory():
    import tracemalloc

    tagger = toxicity.Tagger(toxicity.Field(weight={"vile": 3.0}, bias=-2.0))
    texts = ["word vile other thing " * 50_000 for _ in range(8)]  # 1.6 million words, 8.8 MB
    tracemalloc.start()
    p = tagger.score(texts)[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(p) == 1_600_000 and peak < 110 << 20


def sample():
    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(80)]
    bad = ["vilename", "rottenest", "rottenly", "rottenish", "rottenful"]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_texts_spans_and_odd_rows(spark):
    rows = sample()
    docs = spark.createDataFrame([(d, t, 9.0) for d, t, _ in rows] + [(None, "Vilename rottenly x", 1.0), (1000, None, 1.0), (1001, "", 1.0), (1002, "12 !? ", 1.0), (1003, "abc " * 50000 + "vilename rottenish VILENAME", 1.0), (0, rows[0][1], 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(d, t) for d, _, t in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit_table(docs, labels)).collect()
    assert len(got) == len(rows) + 6
    by = {r.doc_id: r for r in got}
    wrong = sum(by[d].predicted != t for d, _, t in rows if by[d].held_out)
    assert wrong == 0 and sum(by[d].held_out for d, _, _ in rows) > 50
    assert by[None].held_out and by[None].predicted == 1 and [(s.start, s.end) for s in by[None].spans] == [(0, 8), (9, 17)]
    assert by[1000].score == by[1001].score == by[1002].score < 0.5 and by[1003].predicted == 1
    assert [s.start for s in by[1003].spans] == [200000, 200009, 200019]
    assert toxicity.score(docs.limit(0), toxicity.Field()).count() == 0


def test_one_class_alone(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert toxicity.score(docs, toxicity.fit(["a b"], [0])).first().predicted == 0
    assert toxicity.score(docs, toxicity.fit([], [])).first().predicted == 0


def test_the_sample_is_not_cut_for_memory():
    assert toxicity.SAMPLE >= 1000


def test_offsets_where_lower_case_is_longer():
    text = "İİİ bad, İbad İ"
    p = np.array([0.1, 0.2, 0.3, 0.9, 0.6, 0.7, 0.1])
    assert [w for w in toxicity.tokens(text)] == ["i", "i", "i", "bad", "i", "bad", "i"]
    assert toxicity.spans(text, p) == [(4, 7, 0.9), (9, 10, 0.6), (10, 13, 0.7)]
    assert [text[a:b] for a, b, _ in toxicity.spans(text, p)] == ["bad", "İ", "bad"]
    assert toxicity.spans("İx " * 3000 + "bad", np.array([0.0] * 6000 + [1.0])) == [(9000, 9003, 1.0)]


def plain_mark(words, toxic):
    import math

    around = [{(a, w, b) for ws, t in zip(words, toxic) if t == v for a, w, b in zip(["", *ws], ws, [*ws[1:], ""])} for v in (0, 1)]
    n = [max(1, len(a)) for a in around]
    share = n[1] / sum(n)
    out = set()
    for f in {f for _, w, _ in around[1] for f in toxicity.features(w)}:
        k, rest = (sum(f in toxicity.features(w) for _, w, _ in around[v]) for v in (1, 0))
        most = max(sum(w == x for _, x, _ in around[1]) for w in {w for _, w, _ in around[1] if f in toxicity.features(w)})
        if f.endswith("*") and most > toxicity.ONE_WORD * k or k / n[1] < toxicity.LEAST_RATIO * (rest + 0.5) / n[0]:
            continue
        if k * math.log(k / ((k + rest) * share)) + (rest * math.log(rest / ((k + rest) * (1 - share))) if rest else 0) >= toxicity.LEAST_NATS:
            out.add(f)
    return out


def test_marks_against_plain_counting():
    rng = random.Random(11)
    plain = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(30)]
    words, toxic = [], []
    for i in range(60):
        ws = [rng.choice(plain) for _ in range(rng.randint(0, 30))]
        if i % 3 == 0:
            ws += [rng.choice(["rottenest", "rottenly", "rottenish", "rottenful", "vilename"]), rng.choice(plain)] * 3
        words.append(ws)
        toxic.append(int(i % 3 == 0))
    got = toxicity.mark(words, toxic)
    assert got == plain_mark(words, toxic) and "rotten*" in got


def test_share_comes_from_the_labels(spark):
    rows = sample()
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    few = spark.createDataFrame([(d, t) for d, _, t in rows] + [(d, 0) for d in range(10_000, 14_000)], "doc_id long, toxic int")
    from cloudweave.llm.common import labelled

    share = labelled(docs, few, "toxic", 5)[2]
    assert 0.015 < share < 0.03
    texts, toxic, _ = labelled(docs, few, "toxic", 50)
    assert toxicity.fit(texts, toxic, share).calibration[0] < toxicity.fit(texts, toxic, 0.5).calibration[0]


def test_fit_sample_is_one_text_an_id_within_its_bytes(spark, monkeypatch):
    from cloudweave.llm import common

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "x" * 500), (3, "y" * 40), (4, "z" * 40), (6, "w" * 40), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    texts, toxic, _ = common.labelled(docs, labels, "toxic", 10)
    assert len(texts) == len(set(texts)) and "b" not in texts
    monkeypatch.setattr(common, "FIT_TEXT", 100)
    monkeypatch.setattr(common, "FIT_BYTES", 60)
    less, ones, _ = common.labelled(docs, labels, "toxic", 10)
    assert "x" * 500 not in less and set(less) < set(texts) and all(sum(len(t) for t, v in zip(less, ones) if v == k) <= 60 for k in (0, 1))
