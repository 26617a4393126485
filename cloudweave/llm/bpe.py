"""Byte-level BPE by a deterministic automaton, compiled from the merges.

The automaton over tokens accepts exactly the token sequences that the merges produce. It starts as one state with an
arc for each byte. For each merge (u, v) in turn, if the state that u leads to has an arc v, a gadget is put in: that
state is forked into one without v, to which all arcs u now lead, and every state with an arc u gets an arc uv to where
v leads. Arcs of one label always lead to one state, so a fork differs from its origin by one arc alone, and the states
after all merges are kept as the forks' removals.

Words are read byte by byte, so the automaton is made deterministic over bytes: a state of the table is the set of
places that reading may be at, each a node of the trie of labels with the token state in which that label was begun. A
beginning of a word has one accepted sequence, so at every byte just one label ends by a valid arc; the arc of the table
emits it. The rows that spell the labels are compiled when a worker starts, further ones when they are first reached; a
word is encoded by one transition a byte, and its sequence read off the emitted labels from the end. Decoding emits the
arcs' labels.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from itertools import chain
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloudweave.llm.common import map_arrow, table

TOKENIZER = "byte_bpe_50k.json"
#: Words and longest word that a worker remembers, and states of its table beyond those that spell labels; when there
#: are more they are dropped and compiled again as they are reached.
REMEMBERED, LONGEST, STATES = 800_000, 64, 200_000
#: How the byte-level pre-tokenizer splits a text (fixed value of the public byte-level BPE scheme). The classes of the
#: regex package are those of the tokenizer below this character; texts that go beyond are split by the tokenizer's own.
SAME_CLASSES = "\u0530"
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
OTHER_SPACE = regex.compile(r"[\s\x1c-\x1f\p{Z}--[ \n]]", regex.V1)
RUNS = ("  ", " \n", "\n ", "\n\n")
FOREVER = 1 << 60
#: Where a row of the table holds its places; bytes are from 0 on.
PLACES = -1


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled merges: labels (token id to bytes), and encode()."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.ids = vocab
        size = max(vocab.values()) + 1
        self.labels = [b""] * size
        for token, i in vocab.items():
            self.labels[i] = token
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        #: (label u, arc v): the merge at which v was removed from the state after u.
        self.removed: dict[tuple[int, int], int] = {}
        #: The state after each label, and the label by whose removals it is told apart.
        self.after = [0] * size
        states = 1
        for time, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.born[w] >= 0 or any(len(t) > 1 and self.born[i] < 0 for t, i in ((a, u), (b, v))) or not self._has(u, v):
                continue  # no state has both arcs, one after the other
            self.left[w], self.right[w], self.born[w] = u, v, time
            self.after[w] = self.after[v]
            self.removed[u, v] = time
            self.after[u] = states
            states += 1
        self.states = states
        self.ids = {t: i for t, i in vocab.items() if len(t) == 1 or self.born[i] >= 0}
        #: One label for each token state; labels that lead to one state have the same arcs.
        one = {}
        self.stand_in = [one.setdefault(q, i) for i, q in enumerate(self.after)]
        self.lengths = list(map(len, self.labels))
        #: The trie of the labels: node << 8 | byte to node; the label that ends at a node; whether labels go on from it.
        self.trie: dict[int, int] = {}
        self.ends, self.goes_on = [-1], [True]
        for token, i in self.ids.items():
            node = 0
            for b in token:
                self.goes_on[node] = True
                to = self.trie.setdefault(node << 8 | b, len(self.ends))
                if to == len(self.ends):
                    self.ends.append(-1)
                    self.goes_on.append(False)
                node = to
            self.ends[node] = i
        self._spell()

    def _spell(self) -> None:
        """Begins the table with the rows that spell the labels.

        A row gives for a byte the next row and the emitted label, and at PLACES its own places: pairs of a node and the
        label after which it was begun, -1 at the word's beginning.
        """
        self.first = {PLACES: ((0, -1),)}
        self.rows = {self.first[PLACES]: self.first}
        self.spelled = 1 << 62
        for token in self.ids:
            self.encode(token)
        self.spelled = len(self.rows)

    def _step(self, row: dict, byte: int) -> tuple[dict, int]:
        """Compiles the arc of a row at a byte, and puts it into the table."""
        emitted, places = -1, []
        ends, goes_on, trie = self.ends, self.goes_on, self.trie
        for node, last in row[PLACES]:
            to = trie.get(node << 8 | byte)
            if to is None:
                continue
            if emitted < 0 and ends[to] >= 0 and (last < 0 or self._has(last, ends[to])):
                emitted = ends[to]
            if goes_on[to]:
                places.append((to, last))
        if emitted < 0:
            raise ValueError("the vocabulary has no token for a byte")
        key = (*places, (0, self.stand_in[emitted]))
        if key not in self.rows and len(self.rows) - self.spelled >= STATES:
            self._spell()
        row[byte] = self.rows.setdefault(key, {PLACES: key}), emitted
        return row[byte]

    def _has(self, last: int, token: int) -> bool:
        """Whether the state after `last` has an arc `token`, by the gadgets so far.

        The state has lost v after u if u is last, or ends it and v went before what `last` ends with was merged. An
        arc uv came only to states that had u then, so the loss of a beginning of `token` before it was merged counts.
        """
        removed, born = self.removed, self.born
        y, before = last, FOREVER
        while y >= 0:
            x, until = token, FOREVER
            while x >= 0:
                time = removed.get((y, x))
                if time is not None and time < before and time <= until:
                    return False
                until = born[x]
                x = self.left[x]
            before = born[y]
            y = self.right[y]
        return True

    def encode(self, word: bytes) -> list[int]:
        """The accepted sequence that spells the word."""
        row, emitted = self.first, []
        for b in word:
            arc = row.get(b)
            row, token = arc or self._step(row, b)
            emitted.append(token)
        lengths, out, at = self.lengths, [], len(word)
        while at:
            token = emitted[at - 1]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class Codec:
    """Encodes and decodes whole texts as the tokenizer file does, without special tokens added."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.automaton = Automaton(vocab, [tuple(bytes(of[c] for c in x) for x in m) for m in pairs])
        self.automaton.labels += [b""] * (max([*special.values(), *vocab.values()]) + 1 - len(self.automaton.labels))
        for text, i in special.items():
            self.automaton.labels[i] = text.encode()
        #: The tokenizer's own pre-tokenizer, which knows its classes of characters; it only splits.
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.letters = {c: bytes([b]) for c, b in of.items()}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.between = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.known: dict[str, bytes] = {}
        self.marks = {m: self._ids(m) for m in ",."}

    def _ids(self, text: str) -> bytes:
        """Ids of a text without special tokens, by its pre-split words."""
        encode = self.automaton.encode
        return np.fromiter(chain.from_iterable(map(encode, self.pieces(text))), "<u4").tobytes()

    def pieces(self, text: str) -> list[bytes]:
        """The pre-split words of a text without special tokens."""
        if text.isascii() or max(text) < SAME_CLASSES:
            return [w.encode() for w in SPLIT.findall(text)]
        letters = self.letters
        return [b"".join(map(letters.__getitem__, w)) for w, _ in self.splitter.pre_tokenize_str(text)]

    @staticmethod
    def words(text: str) -> list[str] | None:
        """The text in parts that the pre-tokenizer splits by themselves, each with the space or line end before it.

        None where white space comes in runs, at the end or in other kinds; then only the whole text may be split.
        """
        if text[-1:] in ("", " ", "\n") or any(r in text for r in RUNS) or OTHER_SPACE.search(text):
            return None
        first, *rest = text.replace("\n", " \n").split(" ")
        return ([first] if first else []) + [w if w[0] == "\n" else " " + w for w in rest]

    def ids(self, texts: list[str]) -> list[bytes]:
        known, marks = self.known, self.marks
        plain = [None if self.between and self.between.search(t) else self.words(t) for t in texts]
        fresh = set(chain.from_iterable(w for w in plain if w)).difference(known)
        composed = {w: w[:-1] for w in fresh if w[-1] in ",." and w[-2:-1].isalpha() and w[1:-1].isalpha()}
        wanted = list(fresh.difference(composed) | set(composed.values()).difference(known))
        room = REMEMBERED - len(known)
        known.update([(w, self._ids(w)) for w in wanted])
        known.update([(w, known[core] + marks[w[-1]]) for w, core in composed.items()])
        out = [b"".join(map(known.__getitem__, w)) if w is not None else self._whole(t) for t, w in zip(texts, plain, strict=True)]
        for w in composed:
            del known[w]
        for w in wanted if room < len(wanted) else [w for w in wanted if len(w) > LONGEST]:
            del known[w]
        return out

    def _whole(self, text: str) -> bytes:
        parts = self.between.split(text) if self.between else [text]
        return b"".join(self.special.get(p) or self._ids(p) for p in parts)

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """The worker's codec for a file, kept from task to task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of each row's text."""

    def make():
        codec = codec_of(path)

        def step(batch: pa.RecordBatch) -> dict:
            ids = codec.ids([t or "" for t in batch.column("text").to_pylist()])
            return {"doc_id": batch.column("doc_id"), "ids": [np.frombuffer(b, "<u4").astype(np.int32) for b in ids]}

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, ids array<int>", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def decode_column(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of each row's ids; null ids are an empty text."""

    def make():
        codec = codec_of(path)

        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "text": [codec.decode(np.array(i or [], "<u4").tobytes()) for i in batch.column("ids").to_pylist()]}

        return step

    return map_arrow(encoded.select(F.col("doc_id").cast("long"), "ids"), make, "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each row's ids, and of the text that they decode to.

    Null and empty texts have no ids. Repeated rows are repeated, a null doc_id is kept, an empty table gives no rows
    and other columns are not looked at. Texts are encoded whole, however long.
    """

    def make():
        codec = codec_of(path)

        def step(batch: pa.RecordBatch) -> dict:
            ids = codec.ids([t or "" for t in batch.column("text").to_pylist()])
            return {
                "doc_id": batch.column("doc_id"),
                "n_tokens": [len(b) // 4 for b in ids],
                "ids_sha256": [hashlib.sha256(b).hexdigest() for b in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(b).encode()).hexdigest() for b in ids],
            }

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, DIGESTS, _DIGESTS)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token digests and decoded digests of all documents."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
