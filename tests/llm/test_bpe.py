import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cloudweave.llm import bpe

ODD = ["", " ", "\n", "a", "  two  spaces ", "don't we'll I'M it's", "tabs\tand\r\nlines\n\n\n end \n", "x\x1cy\x1f z\x85w\xa0v　u", "naïve Ünïcode ñandú, ＡＢ １２ Ⅷ ² ½", "<|endoftext|>a <|endoftext|> b<|endoftext|>", "aaaaaaaaaaaaaaaaaaaa bbbb    cc", "日本語 テキスト 🙂🙂 👩‍👩‍👧", "​﻿zero   sep ", "a,b. c,. d., e", "...,,,!!! ?!", "ǅ ͅ é ỹ", "123456 7 89,000.5", " lead", "end\n", "\x00\x01 \x7f"]


@pytest.fixture(scope="module")
def pair():
    path = public_tokenizers.path(bpe.TOKENIZER)
    return bpe.Codec(path), Tokenizer.from_file(path)


def check(pair, texts):
    codec, reference = pair
    for text, ids in zip(texts, codec.ids(texts), strict=True):
        want = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert codec.decode(ids) == reference.decode(want, skip_special_tokens=False) == text


def test_odd_texts(pair):
    check(pair, ODD)
    check(pair, ["q" + t + "w" for t in ODD])


def test_random_texts(pair):
    rng = random.Random(7)
    pools = ["abcdeinorst", "abcdefghijklmnopqrstuvwxyzABCDEFGH", "et \n,.'", "aeiouéñüß -'", "0123456789abc#$%", "ab", "中文字 a\t"]
    check(pair, ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for pool in pools for _ in range(300)])


def test_small_merge_tables_against_plain_merging():
    rng = random.Random(17)
    for _ in range(150):
        vocab = {bytes([b]): b for b in range(256)}
        merges, made = [], [b"a", b"b", b"c"]
        for _ in range(rng.randint(1, 12)):
            u, v = rng.choice(made), rng.choice(made)
            if u + v not in vocab:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
                made.append(u + v)
        automaton = bpe.Automaton(vocab, merges)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            parts = [word[i : i + 1] for i in range(len(word))]
            for u, v in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == u and parts[i + 1] == v:
                        parts[i : i + 2] = [u + v]
                    i += 1
            assert [automaton.labels[i] for i in automaton.encode(word)] == parts, (merges, word)


def test_table(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, "x y", 2), (99, None, 2), (99, None, 2), (100, "long, text " * 30000 + "z" * 20000, 2)]
    path = public_tokenizers.path(bpe.TOKENIZER)
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(tuple(r) for r in bpe.round_trip(docs, path).select(bpe.F.coalesce("doc_id", bpe.F.lit(-1)), "n_tokens", "ids_sha256", "decoded_sha256").collect())
    reference = Tokenizer.from_file(path)
    want = []
    for d, t, _ in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if d is None else d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = bpe.decode_column(bpe.encode_column(docs, path), path).where("doc_id < 90").orderBy("doc_id").collect()
    assert [r.text for r in back] == ODD
    assert bpe.round_trip(docs.limit(0), path).count() == 0


def points():
    return [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]


def test_every_code_point(pair):
    every = points()
    check(pair, [" ".join(f"q{c}w" for c in every[lo : lo + 2000]) for lo in range(0, len(every), 2000)])
    check(pair, ["\x87\U00018dc8觇", "a՘b ֋࢏", "՘" * 9])


def test_white_space_of_the_tokenizer_is_known(pair):
    codec = pair[0]

    def whole(around, chars):
        """The characters that the tokenizer doesn't split from what is around them."""
        cut = codec.splitter.pre_tokenize_str("".join(f"{around}{c}{around}\n" for c in chars))
        spans = {s for _, s in cut}
        return {c for i, c in enumerate(chars) if (4 * i, 4 * i + 3) in spans}

    every = points()
    for lo in range(0, len(every), 10000):
        part = every[lo : lo + 10000]
        space = set(part) - whole("!", part) - whole("a", part) - whole("1", part)
        assert all(c in " \n" or bpe.OTHER_SPACE.match(c) for c in space)
        low = [c for c in part if c < bpe.SAME_CLASSES]
        for around in ("!", "a", "1", " ", "\n", "'"):
            text = "".join(f"{around}{c}{around}" for c in low)
            assert codec.pieces(text) == [b"".join(map(codec.letters.__getitem__, w)) for w, _ in codec.splitter.pre_tokenize_str(text)]


def arcs(automaton):
    return sum(len(row) - 1 for row in automaton.rows.values())


def test_table_of_transitions(pair):
    automaton = bpe.Codec(__import__("public_tokenizers").path(bpe.TOKENIZER)).automaton
    states, first = len(automaton.rows), arcs(automaton)
    assert states == automaton.spelled > len(automaton.ids) and first >= states - 1
    steps = []
    step = automaton._step
    automaton._step = lambda row, byte: steps.append(byte) or step(row, byte)
    assert all(automaton.encode(t) == [i] for t, i in automaton.ids.items()) and not steps
    word = b"antidisestablishmentarianisms" * 50
    once = automaton.encode(word)
    compiled = len(steps)
    assert 0 < compiled <= len(word) and arcs(automaton) == first + compiled
    assert automaton.encode(word) == once and len(steps) == compiled
    assert b"".join(automaton.labels[i] for i in once) == word


def test_table_is_dropped_when_it_is_full(monkeypatch):
    rng = random.Random(3)
    vocab = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"ca": 258}
    merges = [(b"a", b"b"), (b"ab", b"c"), (b"c", b"a")]
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    want = list(map(bpe.Automaton(vocab, merges).encode, words))
    monkeypatch.setattr(bpe, "STATES", 5)
    small = bpe.Automaton(vocab, merges)
    for word, ids in zip(words, want, strict=True):
        assert small.encode(word) == ids and len(small.rows) <= small.spelled + 5
