"""Token ids of whole texts by a white-space-dropping tokenizer file, with each distinct word encoded once."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

#: Words that a worker remembers; further words are encoded again in each batch in which they occur.
REMEMBERED = 500_000
#: Longer words are encoded but never remembered.
LONGEST = 48
#: White space on which str.split() and the tokenizer's own pattern might disagree, or which is rare.
ODD_SPACE = re.compile("[\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
CONTROL_SPACE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
PLAIN_SPACE = re.compile("[ \t\n\r]+")
SPECIAL = "<|"


def letters(word: str) -> bool:
    """Letters of Latin-1 alone, which the normal form leaves alone."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0100")


class WordEncoder:
    """Ids of texts as the tokenizer of `path` gives them with add_special_tokens=False.

    The tokenizer must lower case, drop white space, split letters from other characters, end each word with a token
    that carries its suffix, and never join what white space parts; then a text's ids are those of its words in turn,
    and a word of letters before one comma or stop has the ids of the word and of the mark. `ids(texts)` returns for
    each text its ids as little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.marks = {m: self._each([m])[0] for m in ",."}

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Words of letters alone, encoded as one text; each ends at a token with the suffix."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(words):
            return self._each(words)
        data, start, out = ids.tobytes(), 0, []
        for end in cuts.tolist():
            out.append(data[start:end])
            start = end
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if ODD_SPACE.search(text):
                return [w for w in PLAIN_SPACE.split(text) if w]
        else:
            if SPECIAL not in text:
                text = text.lower()
        if any(c in text for c in CONTROL_SPACE):
            return [w for w in PLAIN_SPACE.split(text) if w]
        return text.split()

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        known, marks = self.known, self.marks
        fresh = set(chain.from_iterable(split)).difference(known)
        composed = {w: w[:-1] for w in fresh if w[-1] in ",." and letters(w[:-1])}
        wanted = list(fresh.difference(composed) | set(composed.values()).difference(known))
        plain = [w for w in wanted if letters(w)]
        other = [w for w in wanted if not letters(w)]
        for words, encode in ((plain, self._joined), (other, self._each)):
            for lo in range(0, len(words), 10_000):
                part = words[lo : lo + 10_000]
                known.update(zip(part, encode(part), strict=True))
        known.update([(w, known[core] + marks[w[-1]]) for w, core in composed.items()])
        out = [b"".join(map(known.__getitem__, ws)) for ws in split]
        for w in composed:
            del known[w]
        room = REMEMBERED - len(known)
        for w in wanted if room < 0 else [w for w in other if len(w) > LONGEST]:
            del known[w]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder for a file: kept from task to task with the words it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
