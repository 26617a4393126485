"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

Words are tagged 0 or 1. The labels mark whole documents, so the words that the field learns from are labelled first:
a word of a toxic document is tagged 1 if the word, or its beginning, is found far more often in toxic documents of the
labelled sample than in others. The field itself has weights for words, beginnings of words and pairs of tags, fitted by
its conditional likelihood; each word's marginal is by forward and backward sums over the whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import held_out, labelled, map_arrow, table

#: At most this many labelled texts of either class, least crc32 of the id first, are fitted on.
SAMPLE = 1000
#: Words and beginnings (of so many letters) are features of the field.
BEGINNINGS = (4, 5, 6, 7)
#: A feature marks words if it is so many times likelier in toxic texts than in others, by a split of its texts between
#: the classes that speaks against chance with so many nats (12: one in 160,000).
LEAST_RATIO, LEAST_NATS = 12.0, 12.0
#: A beginning is not a feature if one word makes up more than this share of its cases.
ONE_WORD = 0.8
#: Words of lower marginals don't count in a document's expected number of toxic words.
LEAST_MARGINAL = 0.2
#: Features kept for the field: all marking ones, and so many of the commonest other words of the sample. A word outside
#: them has no weight of its own, as if it were new.
COMMON = 4000
THRESHOLD = 0.5
WORD = re.compile(r"[^\W\d_]+")
#: Words whose messages are worked out together; texts are taken whole up to it, longer ones in blocks of so many.
CHAIN_WORDS = 200_000
#: What a worker remembers of words.
REMEMBERED = 200_000
#: Rows of a document's spans that a result holds are those whose marginal reaches this.
SPAN = 0.5


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Field:
    """Weights (for tag 1 against tag 0) of features, log weights of tag pairs, and the document calibration."""

    weight: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    calibration: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        get = self.weight.get
        return self.bias + sum(get(f, 0.0) for f in features(word))


_EVEN = np.array([0.5, 0.5])


def _steps(e: np.ndarray, firsts: np.ndarray, pair: np.ndarray, start: np.ndarray) -> np.ndarray:
    """step[t][i, j]: weight of going from tag i before t to tag j at t, as strips (strips, width, 2, 2), the last one filled up."""
    n = len(e)
    width = max(1, math.isqrt(n))
    size = width * -(-n // width)
    w = np.ones((size, 2))
    top = np.maximum(e, 0)
    w[:n, 0], w[:n, 1] = np.exp(-top), np.exp(e - top)
    step = np.broadcast_to(np.exp(pair), (size, 2, 2)).copy()
    step[firsts] = np.exp(start)
    step[n:] = np.eye(2)
    return (step * w[:, None, :]).reshape(-1, width, 2, 2)


def _messages(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Normalised row vectors after each step of m (strips, width, 2, 2), with v coming in."""
    strips, width = m.shape[:2]
    product = np.broadcast_to(np.eye(2), (strips, 2, 2))
    for t in range(width):
        product = product @ m[:, t]
        product = product / product.sum(axis=(1, 2), keepdims=True)
    into = np.empty((strips, 2))
    for s in range(strips):
        into[s] = v
        v = v @ product[s]
        v = v / v.sum()
    out = np.empty((strips, width, 2))
    v = into
    for t in range(width):
        v = (v[:, None, :] @ m[:, t])[:, 0]
        v = v / v.sum(axis=1, keepdims=True)
        out[:, t] = v
    return out.reshape(-1, 2)


def _both_ways(m: np.ndarray, n: int, into: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Messages ahead to and behind each of the n words, and the one that goes back out of the first."""
    ahead = _messages(m, into)[:n]
    # The backward message at t is that of the reversed chain before its own step.
    back = _messages(m.reshape(-1, 2, 2)[::-1].transpose(0, 2, 1).reshape(m.shape), after)[::-1]
    return ahead, np.concatenate([back[1:], after[None]])[:n], back[0]


def _shares(ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    p = ahead * behind
    return p[:, 1] / p.sum(axis=1)


def marginals(e: np.ndarray, firsts: np.ndarray, pair: np.ndarray, start: np.ndarray, want_pairs: bool = False):
    """P(tag 1) of each of the chained texts' words: e are log weights of tag 1, firsts the places where texts begin.

    The texts are one chain in which a first word forgets what came before it. The chain is cut into about sqrt(n)
    strips that are worked side by side: once to get each strip's 2x2 product, then, with the right message coming in,
    for the messages themselves. So the Python loop is as long as a strip, however long a text is.
    """
    n = len(e)
    if not n:
        return (np.zeros(0), np.zeros((2, 2))) if want_pairs else np.zeros(0)
    m = _steps(e, firsts, pair, start)
    ahead, behind, _ = _both_ways(m, n, _EVEN, _EVEN)
    if not want_pairs:
        return _shares(ahead, behind)
    inner = np.ones(n, bool)
    inner[firsts] = False
    t = np.flatnonzero(inner)
    joint = ahead[t - 1][:, :, None] * m.reshape(-1, 2, 2)[t] * behind[t][:, None, :]
    return _shares(ahead, behind), (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def marginals_of_long(e: np.ndarray, pair: np.ndarray, start: np.ndarray, block: int = CHAIN_WORDS) -> np.ndarray:
    """As marginals, of one text of any length, with the steps of one block of it at a time.

    A first pass keeps the message that comes into each block; a second one, from the last block to the first, carries
    the message from behind.
    """
    if not len(e):
        return np.zeros(0)
    cuts = list(range(0, len(e), block))
    steps = lambda lo: _steps(e[lo : lo + block], np.zeros(int(lo == 0), np.int64), pair, start)
    into = [_EVEN]
    for lo in cuts[:-1]:
        into.append(_messages(steps(lo), into[-1])[-1])
    out, after = np.empty(len(e)), _EVEN
    for lo, v in zip(reversed(cuts), reversed(into), strict=True):
        ahead, behind, after = _both_ways(steps(lo), len(e[lo : lo + block]), v, after)
        out[lo : lo + block] = _shares(ahead, behind)
    return out


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _firsts(lists: list) -> np.ndarray:
    lengths = np.array([len(x) for x in lists], np.int64)
    return (np.cumsum(lengths) - lengths)[lengths > 0]


def mark(words: list[list[str]], toxic: list[int]) -> set[str]:
    """The features by which words of toxic texts are labelled.

    A word counts once for each pair of neighbours that it has in texts of a class, so what a text repeats, and what
    copies of a text repeat, counts once.
    """
    numbers: dict[str, int] = {"": 0}
    texts = []
    for ws in words:
        texts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), np.int64, len(ws)))
    names = list(numbers)
    seen, most, cases = (Counter(), Counter()), Counter(), [0, 0]
    for value in (0, 1):
        own = [t for t, label in zip(texts, toxic, strict=True) if label == value and len(t)]
        flat = np.concatenate([np.concatenate([[0], t, [0]]) for t in own]) if own else np.zeros(0, np.int64)
        around = np.stack([flat[:-2], flat[1:-1], flat[2:]], axis=1) if len(flat) else np.zeros((0, 3), np.int64)
        around = np.unique(around[around[:, 1] > 0], axis=0)  # zero stands between texts
        cases[value] = len(around)
        for i, k in enumerate(np.bincount(around[:, 1], minlength=len(names)).tolist()):
            if k:
                for f in features(names[i]):
                    seen[value][f] += k
                    if value:
                        most[f] = max(most[f], k)
    n = [max(1, c) for c in cases]
    share = n[1] / sum(n)

    def marks(f: str, k: int) -> bool:
        rest = seen[0][f]
        if f.endswith("*") and most[f] > ONE_WORD * k or k / n[1] < LEAST_RATIO * (rest + 0.5) / n[0]:
            return False
        total = k + rest
        return k * math.log(k / (total * share)) + (rest * math.log(rest / (total * (1 - share))) if rest else 0) >= LEAST_NATS

    return {f for f, k in seen[1].items() if marks(f, k)}


def fit(texts: list[str], toxic: list[int], share: float | None = None, steps: int = 40, l2: float = 1e-4) -> Field:
    """Fits the field on labelled texts; without a toxic or a clean text its scores are one half or near none.

    share: of toxic texts among all that are labelled, by which documents are calibrated; that of the texts if None.
    """
    f = Field()
    if not sum(toxic) or sum(toxic) == len(toxic):
        f.calibration = (-4.0 if not sum(toxic) else 4.0, 0.0, 0.0)
        return f
    words = [tokens(t) for t in texts]
    marks = mark(words, toxic)
    common = Counter(x for ws in words for w in set(ws) for x in features(w))
    names = sorted(marks) + [x for x, _ in common.most_common(COMMON) if x not in marks and not x.endswith("*")]
    index = {x: i for i, x in enumerate(names)}

    vocabulary: dict[str, int] = {}
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for ws in words for w in ws), np.int64)
    own = [[index[x] for x in features(w) if x in index] for w in vocabulary]
    rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
    cols = np.fromiter((i for x in own for i in x), np.int64)
    is_marked = np.array([any(x in marks for x in features(w)) for w in vocabulary], bool)
    label = np.repeat(toxic, [len(ws) for ws in words]).astype(bool) & is_marked[ids]
    firsts = _firsts(words)

    theta, bias, pair, start = np.zeros(len(names)), -2.0, np.zeros((2, 2)), np.zeros(2)
    inner = np.ones(len(ids), bool)
    inner[firsts] = False
    t = np.flatnonzero(inner)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (label[t - 1].astype(int), label[t].astype(int)), 1)
    seen_start = np.bincount(label[firsts].astype(int), minlength=2)
    moment = [np.zeros_like(x) for x in (theta, np.zeros(1), pair, start)]
    speed = [np.zeros_like(x) for x in moment]
    for k in range(1, steps + 1):
        per_word = np.bincount(rows, theta[cols], minlength=len(own)) + bias
        p, joint = marginals(per_word[ids], firsts, pair, start, want_pairs=True)
        gap = np.bincount(ids, label - p, minlength=len(own))
        begin = p[firsts]
        grads = [np.bincount(cols, gap[rows], minlength=len(names)) - l2 * len(ids) * theta / 100, np.array([gap.sum()]), seen_pairs - joint, seen_start - np.array([(1 - begin).sum(), begin.sum()])]
        for i, (x, g) in enumerate(zip((theta, bias, pair, start), grads, strict=True)):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            speed[i] = 0.99 * speed[i] + 0.01 * g * g
            delta = 0.3 * (moment[i] / (1 - 0.9**k)) / (np.sqrt(speed[i] / (1 - 0.99**k)) + 1e-6)
            if i == 1:
                bias = float(x + delta[0])
            else:
                x += delta
    f.weight, f.bias, f.pair, f.start = {n: float(v) for n, v in zip(names, theta, strict=True) if abs(v) > 1e-3}, bias, pair, start
    p = marginals((np.bincount(rows, theta[cols], minlength=len(own)) + bias)[ids], firsts, pair, start)
    x = document_features(p, [len(ws) for ws in words])
    f.calibration = _logistic(x, np.array(toxic), sum(toxic) / len(toxic) if share is None else share)
    return f


def document_features(p: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Of each text: 1, the largest marginal, log of 1 and the expected number of toxic words; texts without words have zeros."""
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1
    full = np.flatnonzero(lengths)
    if len(full):
        cuts = _firsts([range(n) for n in lengths])
        out[full, 1] = np.maximum.reduceat(p, cuts)
        out[full, 2] = np.log1p(np.add.reduceat(np.where(p >= LEAST_MARGINAL, p, 0), cuts))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, share: float, steps: int = 30, l2: float = 0.5) -> tuple[float, ...]:
    """Newton's method, with the classes weighed by the share of 1."""
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, x.T @ (weight * (y - p)) - l2 * beta)
    return tuple(float(b) for b in beta)


class Tagger:
    """Applies a field to texts; remembers the emissions of words."""

    def __init__(self, field_: Field) -> None:
        self.field = field_
        self.known: dict[str, float] = {}

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self.known
        got = list(map(known.get, words))
        if None in got:
            emission = self.field.emission
            room = len(known) < REMEMBERED
            for i, g in enumerate(got):
                if g is None:
                    got[i] = known.get(words[i])
                    if got[i] is None:
                        got[i] = emission(words[i])
                        if room:
                            known[words[i]] = got[i]
        return np.array(got, float)

    def score(self, texts: list[str], chain: int = CHAIN_WORDS) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Scores of the texts, and the marginals of all their words with each text's number of words.

        Texts are taken in runs of about `chain` words, longer ones each for itself in blocks of so many words, so that
        what is held of all texts is a number for each word.
        """
        field_ = self.field
        lengths: list[int] = []
        found, run, held = [np.zeros(0)], [], 0

        def close() -> None:
            if run:
                found.append(marginals(np.concatenate(run), _firsts(run), field_.pair, field_.start))
                run.clear()

        for text in texts:
            words = (m[0] for m in WORD.finditer(text.lower()))
            parts = [self.emissions(ws) for ws in iter(lambda: list(islice(words, chain)), [])]
            lengths.append(sum(map(len, parts)))
            if held + lengths[-1] > chain:
                close()
                held = 0
            if lengths[-1] > chain:
                found.append(marginals_of_long(np.concatenate(parts), field_.pair, field_.start, chain))
            else:
                run += parts
                held += lengths[-1]
        close()
        p = np.concatenate(found)
        z = document_features(p, lengths) @ np.array(field_.calibration)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), p, lengths


def spans(text: str, p: np.ndarray, least: float = SPAN) -> list[tuple[int, int, float]]:
    """(start, end, marginal) in code points of the words whose marginal is at least `least`."""
    if not (p >= least).any():
        return []
    low = text.lower()
    found = [(m.start(), m.end(), float(q)) for m, q in zip(WORD.finditer(low), p, strict=True) if q >= least]
    if len(low) == len(text):
        return found
    # A character may be several in lower case: each of these stands at the place of the one that it comes from.
    at = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]).tolist()
    return [(at[a], at[b - 1] + 1, q) for a, b, q in found]


SCORED = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start: long, end: long, marginal: double>>"
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])))])


def score(docs: DataFrame, fitted: Field, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and offending spans of each row of docs (doc_id, text).

    Null, empty and wordless texts get the score of a text without a toxic word, and no spans. Repeated rows are scored
    each; a null doc_id is kept and counts as held out. An empty table gives no rows; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # at most a few thousand weights, whatever the corpus

    def make():
        tagger = Tagger(shared.value)

        def step(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            s, p, lengths = tagger.score(texts)
            ends = np.cumsum(lengths)
            found = [[{"start": a, "end": b, "marginal": q} for a, b, q in spans(t, p[e - n : e])] for t, e, n in zip(texts, ends.tolist(), lengths, strict=True)]
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= threshold).astype(np.int32), "spans": found}

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out")), make, SCORED, _SCORED)


def clean(docs: DataFrame, fitted: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold.

    Null, empty and wordless texts are scored as those without a toxic word. Repeated rows are judged each, a null
    doc_id makes no difference, an empty table gives no rows, and further columns go along whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        tagger = Tagger(shared.value)
        for batch in batches:
            if batch.num_rows:
                s = tagger.score([t or "" for t in batch.column("text").to_pylist()])[0]
                yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)


def fit_table(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    texts, toxic, share = labelled(docs, labels, "toxic", sample)
    return fit(texts, toxic, share)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_table(docs, table(spark, sf_dir, "labels")))
