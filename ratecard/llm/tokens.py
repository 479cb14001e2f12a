"""Token ids by the public tokenizers library, memoised by stretch of non-space.

The vocabulary ``word_bpe_49k`` drops white space and no pre-token holds any, so
a text's ids are the concatenated ids of the stretches between white space.
``WordEncoder`` asks the library once for each distinct stretch and joins the
remembered bytes. In texts of usual characters, case is folded and a comma or
full stop after a word is parted from it first, as the library does itself, so
that fewer stretches are distinct; what is new and still ends in signs is asked
for as a word and a run of signs.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
from collections import defaultdict
from functools import lru_cache
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa

#: White space for Python's split but not for the library, and the separator.
_ODD = re.compile("[\x01\x1c-\x1f]")
_SEPARATOR = "\x01"
#: Outside: characters whose lower case is the same in Python and the library
#: whatever stands beside them, and which normal form C leaves alone.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\u00a1\u00ab\u00bb\u00bf-\u00ff\u0100-\u012f\u0131-\u0148\u014a-\u017e]")
#: A comma or full stop that belongs to a longer run of signs.
_RUN = re.compile(r"(?:[^\w\s]|_)[,.]")
#: Signs that the library parts from letters before them, as one run; not those that begin a contraction or stand in a special token.
_TAIL = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'
#: The same two for texts of one byte a character: usual ones, and signs as ``!`` but for commas and full stops.
_USUAL_BYTES = bytes(i for i in range(256) if not _ODD.match(chr(i)) and not _UNUSUAL.match(chr(i)))
_SIGNS = bytes(0x2E if chr(i) in ",." else 0x21 if re.match(r"[^\w\s]|_", chr(i)) else 0x20 for i in range(256))
#: How byte-level vocabularies write bytes: printable ones as they are, others as characters from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)} | {0x20: 0x20}
ID = np.dtype("<u4")
#: Texts that are encoded at a time: their new stretches are asked for together.
TOGETHER = 384
#: New words that the library gets in one text.
_LINE = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def usual(text: str) -> tuple[bool, bool]:
    """Whether all characters are usual ones, and whether a comma or full stop belongs to a run of signs."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return not _UNUSUAL.search(text) and not _ODD.search(text), bool(_RUN.search(text))
    signs = data.translate(_SIGNS)
    return not data.translate(None, _USUAL_BYTES), b".." in signs or b"!." in signs


class WordEncoder:
    """Stretch of non-space -> its ids as little-endian unsigned 32-bit bytes.

    Two generations of at most ``most`` stretches each are remembered, none
    longer than ``longest``; forgetting changes no result.
    """

    def __init__(self, path: str, most: int = 400_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        #: The library's model alone, for words that its normal form and its cuts leave as they are.
        self.bare = Tokenizer(self.library.model)  # shared, not loaded again
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.most, self.longest = most, longest
        self.young, self.old = defaultdict(bytearray), defaultdict(bytearray)
        self.gap = self._ids(_SEPARATOR)
        if len(self.gap) != 1:
            raise ValueError(f"{path}: the separator is not one token")
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        probe = "It's a\tProbe, naïve\u0301 of 12 (words)...\nÄ ok_ #x"
        if self.encode(probe) != self._ids(probe).tobytes() or self.encode("größe") != self._ids("größe").tobytes():
            raise ValueError(f"{path}: its ids of a text are not those of its stretches of non-space")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, ID)

    def _cut(self, stretches: list[str], ids: np.ndarray, ends: np.ndarray, gap: int) -> dict[str, bytes]:
        """Each stretch with its ids, which stop at ``ends`` and are ``gap`` apart."""
        data, stops = ids.tobytes(), (4 * ends).tolist()
        starts = [0, *(4 * (ends[:-1] + gap)).tolist()]
        return {stretch: data[start:stop] for stretch, start, stop in zip(stretches, starts, stops, strict=True)}

    def _learn(self, words: list[str], others: list[str]) -> dict[str, bytes]:
        """Ask the library: once for words, which are one pre-token each and end
        where an end-of-word id does, and once for other stretches."""
        out: dict[str, bytes] = {}
        if words:
            plain = [w for w in words if w.isascii()]
            words = plain + [w for w in words if not w.isascii()]
            lines = [" ".join(plain[i : i + _LINE]) for i in range(0, len(plain), _LINE)]
            if len(words) > len(plain):
                lines.append(" ".join(words[len(plain) :]).encode().decode("latin-1").translate(_BYTE_LEVEL))
            ids = np.array(list(chain.from_iterable(x.ids for x in self.bare.encode_batch_fast(lines, add_special_tokens=False))), ID)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(words):
                out = self._cut(words, ids, ends, 0)
            else:
                others = others + words
        if others:
            ids = self._ids(f" {_SEPARATOR} ".join(others))
            out |= self._cut(others, ids, np.append(np.flatnonzero(ids == self.gap[0]), len(ids)), 1)
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text; null is empty."""
        collects = gc.isenabled()
        gc.disable()  # the lists of stretches hold no cycles, and a collection would visit each stretch
        try:
            return self._encode_many(texts)
        except BaseException:
            self.young = defaultdict(bytearray)  # what is not filled in must not be found again
            raise
        finally:
            if collects:
                gc.enable()

    def _encode_many(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        jobs: list[tuple[int, list[bytes | bytearray]]] = []
        odd: list[tuple[int, str]] = []
        young, old = self.young, self.old
        known, find = len(young), young.__getitem__  # what is not there gets empty bytes, to be filled in below
        for i, text in enumerate(texts):
            if not text:
                continue
            common, run = usual(text)
            if common:
                text = text.lower()
                if not run:
                    text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
                jobs.append((i, list(map(find, text.split()))))
            elif _ODD.search(text):
                out[i] = self._ids(text).tobytes()
            else:
                odd.append((i, text))
        plain = len(young) - known  # new stretches of usual texts
        jobs += [(i, list(map(find, text.split()))) for i, text in odd]
        new = list(islice(reversed(young), len(young) - known))[::-1]  # a dictionary's last keys are its newest
        fresh = {w: old[w] for w in new if w in old}
        words, others, tailed = [], [], []  # tailed: a stretch, its letters and its signs
        for w in filterfalse(fresh.__contains__, new[:plain]):
            if w.isalpha():
                words.append(w)
            elif (head := w.rstrip(_TAIL)).isalpha():
                tailed.append((w, head, w[len(head) :]))
            else:
                others.append(w)
        others += filterfalse(fresh.__contains__, new[plain:])
        empty = [young[w] for w in new]
        for i, kept in ((1, words), (2, others)):
            for x in {t[i] for t in tailed}:
                if x in young:
                    if young[x]:  # else it is in hand already
                        fresh[x] = young[x]
                elif x in old:
                    fresh[x] = old[x]
                else:
                    kept.append(x)
        if words or others:
            fresh |= self._learn(words, others)
        for w, head, tail in tailed:
            fresh[w] = fresh[head] + fresh[tail]
        for w, ids in zip(new, empty):
            ids[:] = fresh[w]
        for i, job in jobs:
            out[i] = b"".join(job)
        young.update(fresh)
        for w in [w for w in fresh if len(w) > self.longest]:
            del young[w]
        if len(young) > self.most:
            self.old, self.young = young, defaultdict(bytearray)
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, which keeps its memory from task to task."""
    return WordEncoder(path)


def release() -> None:
    """For tasks that encode nothing: the encoders that earlier tasks left in this worker
    process go, and what is free of its memory goes back to the system."""
    shared_encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
