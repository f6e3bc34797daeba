"""Token ids of whole texts, by a public tokenizer file."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np

from rentalytics.llm.common import WORDS

# Words a worker remembers at most, twice: the recent ones and those before. Longer words are not kept.
_KEPT_WORDS, _KEPT_CHARS = 600_000, 64
# Runs of Latin letters before a mark or a blank, marks at the end of a word, and all other words as they are.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_MARKS = r".,!?;:#*$%&|<>()\-"
_BLANK = r"\x20\x09-\x0D"
_PARTS = re.compile(rf"[{_LATIN}]+(?=[{_MARKS}{_BLANK}]|\Z)|[{_MARKS}]+(?=[{_BLANK}]|\Z)|[^{_BLANK}]+")
_LETTERS = re.compile(f"[{_LATIN}]{{1,{_KEPT_CHARS}}}")
# A text of nothing else, and its parts.
_PLAIN, _PLAIN_PARTS = re.compile(f"[{_LATIN}{_MARKS}{_BLANK}]*"), re.compile(f"[{_LATIN}]+|[{_MARKS}]+")
_JOINED = 500


def default_tokenizer() -> str:
    """Path of the word-level BPE file that the packing and output queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Recent(dict):
    """Ids by word; the older half of what is known goes when the newer half is full."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def missing(self, words: Iterable[str]) -> list[str]:
        """Words not known, each once. Those known from before are recent again."""
        if len(self) > _KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        new = set(filterfalse(self.__contains__, words))
        again = {w: self.older[w] for w in new if w in self.older}
        self.update(again)
        return [w for w in new if w not in again] if again else list(new)


class WordEncoder:
    """Ids of a tokenizer whose tokens never reach over blanks, tabs and line ends.

    Such a tokenizer gives a text the ids of its words one after the other, so each different
    word is encoded once and looked up from then on. If it also takes letters and marks
    apart, ignores case and ends words visibly (as ``word_bpe_49k`` does), words are letters
    and marks of lower case, and new ones are encoded many at a time.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known = _Recent()
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        whole, letters, mark = self._each(["Ab!", "ab", "!"])
        self._apart = bool(self._ends.any()) and whole == letters + mark

    def _each(self, words: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters only, joined by blanks and cut again behind each last token."""
        out = {}
        parts = [words[i:i + _JOINED] for i in range(0, len(words), _JOINED)]
        found = self._tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)
        for part, e in zip(parts, found):
            ids = np.array(e.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                out.update((w, raw[a:b]) for w, a, b in zip(part, [0, *cuts], cuts))
            else:
                out.update(zip(part, self._each(part)))
        return out

    def _split(self, text: str) -> list[str]:
        if not self._apart:
            return WORDS.findall(text)
        if "<|" in text:  # may be a special token, which is told by its case and has marks inside
            return _PARTS.findall(text)
        try:
            text.encode("latin-1")  # there lower case is the same everywhere
        except UnicodeEncodeError:
            return _PARTS.findall(text)
        return (_PLAIN_PARTS if _PLAIN.fullmatch(text) else _PARTS).findall(text.lower())

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        collects = gc.isenabled()
        gc.disable()  # hundreds of thousands of words are made at once, and none of them in a cycle
        try:
            return self._ids(texts)
        finally:
            if collects:
                gc.enable()

    def _ids(self, texts: list[str]) -> list[bytes]:
        words = [self._split(t) for t in texts]
        new = self._known.missing(chain.from_iterable(words))
        letters = [w for w in new if _LETTERS.fullmatch(w)] if self._apart else []
        rest = list(set(new).difference(letters))
        fresh = self._letters(letters) | dict(zip(rest, self._each(rest)))
        long = {w: fresh.pop(w) for w in rest if len(w) > _KEPT_CHARS}
        self._known.update(fresh)
        get = (self._known | long if long else self._known).__getitem__
        return [b"".join(map(get, w)) for w in words]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker and file."""
    return WordEncoder(path)
