import random

import numpy as np

from cloudweave.llm import quality


def plain_score(net, text):
    blocks = (len(text) + quality.WIDTH + quality.BLOCK - 1) // quality.BLOCK
    data = text + bytes(blocks * quality.BLOCK - len(text))
    top = []
    for b in range(blocks):
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(b * quality.BLOCK, (b + 1) * quality.BLOCK, quality.STRIDE):
            if at + quality.WIDTH <= len(data):
                best = np.maximum(best, sum(net.filters[k, data[at + k]].astype(float) for k in range(quality.WIDTH)))
        top.append(best)
    chunks = [np.maximum(a, b) for a, b in zip(top, top[1:])] or top
    on = np.maximum(np.array(chunks) + net.bias, 0)
    return 1 / (1 + np.exp(-(np.concatenate([on.mean(0), on.max(0), [1]]) @ net.dense)))


def some_net():
    rng = np.random.default_rng(3)
    return quality.Network(rng.normal(0, 0.3, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(size=quality.FILTERS).astype(np.float32), rng.normal(0, 0.2, 2 * quality.FILTERS + 1).astype(np.float32))


def test_scores_against_plain_convolution():
    rng, net = random.Random(3), some_net()
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 7, 503, 504, 505, 512, 1024, 1500, 5000, 200)]
    assert np.allclose(quality.predict(net, texts), [plain_score(net, t) for t in texts], atol=1e-4)
    assert quality.predict(net, texts)[3] == quality.predict(net, [texts[3], texts[9]])[0]


def test_learns_and_handles_odd_rows(spark):
    rng = random.Random(33)

    def text(good):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 300))]
        return " ".join(w + ("" if good else rng.choice(["%%%", "&&&"])) for w in words)

    rows = [(i, text(i % 4), int(i % 4 > 0)) for i in range(600)]
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows] + [(None, "a b", ""), (900, None, ""), (901, "", ""), (902, "%%% " * 40000, ""), (5, rows[5][1], "")], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows] + [(None, 1), (900, 0)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit_table(docs, labels)).collect()
    assert len(got) == 605
    by = {r.doc_id: r for r in got}
    held = [(by[d].predicted, q) for d, _, q in rows if by[d].held_out]
    assert len(held) > 80 and sum(p == q for p, q in held) >= 0.97 * len(held)
    assert by[900].score == by[901].score and by[902].predicted == 0 and by[None].held_out
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert quality.score(docs.limit(0), some_net()).count() == 0


def test_one_label_alone():
    assert quality.predict(quality.fit([b"a"], [1], 0.9), [b"x"])[0] > 0.5
    assert 0 < quality.predict(quality.fit([], [], 0.5), [b""])[0] < 1
