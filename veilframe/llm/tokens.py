"""Token ids and counts from public tokenizers, word by word through caches.

Neither tokenizer joins characters across white space, so a text's tokens are those of its words in a row, and a word
that was met before costs one dictionary look-up. Texts to which that does not apply go through the tokenizer whole.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np

# Words that a cache takes up before it becomes the older one, which takes the place of the one before; about 200 bytes each.
MAX_CACHED = 600_000


def per_worker(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from one task to the next: one value of each kind, made again when the key changes.
    Functions travel with the job, so their modules' globals do not last; the worker's main module does."""
    kept = vars(sys.modules["__main__"]).setdefault("_veilframe_kept", {})
    if kind not in kept or kept[kind][0] != key:
        kept[kind] = key, make()
    return kept[kind][1]


class WordIds:
    """Ids of texts by a ``tokenizers`` file that lower-cases, drops white space and marks ends of words.

    Words are looked up as they stand between white space, in lower case. One that misses is taken apart into a body
    and the punctuation behind it; bodies are encoded together and split where a token ends a word.
    """

    # Characters whose lower case may depend on place or version, or which only one side takes for white space.
    ODD = re.compile("[\x1c-\x1fİɐ-\U0010ffff]")
    TAIL = ".,;:!?%$#&*|"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: set[str]) -> None:
        """Ids of words that are not in the cache: from the older one, else from the tokenizer."""
        cache, older = self.cache, self.older
        # Of letters alone, a word is one unit to the tokenizer's model; in ASCII it is spelt there as it is.
        plain: set[str] = set()
        parts: list[tuple[str, str, str]] = []
        for word in words:
            ids = older.get(word)
            if ids is not None:
                cache[word] = ids
            elif word.isalpha():
                plain.add(word)
            elif (body := word.rstrip(self.TAIL)) == "" or body.isalpha() and body != word:
                parts.append((word, body, word[len(body) :]))
            else:
                cache[word] = self._ids(word).tobytes()
        for _, body, tail in parts:
            if body and body not in cache:
                plain.add(body)
            if tail not in cache:
                cache[tail] = self._ids(tail).tobytes()
        tokenize = self.tokenizer.model.tokenize
        for word in filter(str.isascii, plain):
            cache[word] = array("I", [t.id for t in tokenize(word)]).tobytes()
        order = [w for w in plain if not w.isascii()]
        if order:
            ids = self._ids(" ".join(order))
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) == len(order):
                data, at = ids.tobytes(), 0
                for word, stop in zip(order, stops.tolist()):
                    cache[word] = data[at:stop]
                    at = stop
            else:  # a letter that is cut off from its word
                for word in order:
                    cache[word] = self._ids(word).tobytes()
        for word, body, tail in parts:
            cache[word] = (cache[body] if body else b"") + cache[tail]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.cache) > MAX_CACHED:
            self.older, self.cache = self.cache, {}
        split: list[list[str] | None] = []
        missed: set[str] = set()
        out: list[bytes | None] = []
        get, odd = self.cache.get, self.ODD.search
        for text in texts:
            words = None if "<|" in text or odd(text) else text.lower().split()
            found: list = [] if words is None else list(map(get, words))
            if None in found:
                missed.update([w for w, ids in zip(words, found) if ids is None])
                out.append(None)
            else:
                out.append(self._ids(text).tobytes() if words is None else b"".join(found))
            split.append(words)
        if missed:
            self._learn(missed)
        return [b"".join(map(get, w)) if x is None else x for x, w in zip(out, split)]


class PieceCounts:
    """Numbers of tokens by a ``sentencepiece`` file without normalization, whose pieces hold spaces in front only.

    A text is cut at its spaces; each word stands for itself with one space in front. A word with line ends in it is
    cut at these, since no piece holds one. Runs of spaces belong to the word behind them.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.tails: dict[str, int] = {}

    def _sizes(self, texts: list[str]) -> Iterator[int]:
        return map(len, self.model.encode(texts, num_threads=1))

    def learn(self, words: set[str]) -> None:
        """Sizes of words. What stands behind a line end in a word has no space in front and is kept apart."""
        known = {w: self.older[w] for w in words & self.older.keys()}
        self.cache.update(known)
        words = words - known.keys()
        broken = {w: w.split("\n") for w in words if "\n" in w}
        fresh = list({w for w in words if w not in broken} | {ps[0] for ps in broken.values()})
        for word, n in zip(fresh, self._sizes(fresh)):
            self.cache[word] = max(n, 1)
        # The model puts a space in front of what it is given; line end and text behind it follow that.
        tails = list({p for ps in broken.values() for p in ps[1:]} - self.tails.keys())
        for tail, n in zip(tails, self._sizes(["\n" + p for p in tails])):
            self.tails[tail] = n - 1
        for word, (head, *rest) in broken.items():
            self.cache[word] = self.cache[head] + sum(map(self.tails.__getitem__, rest))

    def count(self, texts: Sequence[str]) -> list[int]:
        if len(self.cache) > MAX_CACHED:
            self.older, self.cache = self.cache, {}
        if len(self.tails) > MAX_CACHED:
            self.tails.clear()
        split, missed, get = [], set(), self.cache.get
        for text in texts:
            words = self.words(text)
            if None in (found := list(map(get, words))):
                missed.update(w for w, n in zip(words, found) if n is None)
                found = words
            split.append(found)
        if missed:
            self.learn(missed)
        return [sum(map(get, x)) if x and isinstance(x[0], str) else sum(x) for x in split]

    @staticmethod
    def words(text: str) -> list[str]:
        """What stands between spaces; each has one space in front of it in the text as the model sees it."""
        if not text:
            return []
        words = text.replace("▁", " ").split(" ")  # the model's own sign for a space
        if "" not in words:
            return words
        out, spaces = [], ""
        for word in words:
            if word:
                out.append(spaces + word)
                spaces = ""
            else:
                spaces += " "
        if spaces:
            # Spaces at the end: the model's own in front makes up for one of them.
            out.append(spaces[1:])
        return out
