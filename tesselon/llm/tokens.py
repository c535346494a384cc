"""Whole texts to token ids with a vocabulary file of a public tokenizer.

Where a vocabulary drops white space and no token crosses it, the ids of a text are the ids of its words one after the
other: each word is encoded by the tokenizers library once and remembered. Whether a vocabulary is of this kind is probed
when it is loaded; with any other, and for texts that hold a special token's opening or one of the four separators which
only some libraries count as white space, whole texts go to the library.

Where a vocabulary also lowers case, texts of Latin-1 characters alone are lowered first: no two of these compose to
another, so composing and lowering may change places there (elsewhere they may not, and words are taken as they are
written). Words of small Latin-1 letters, and such words with one full stop or comma after them, skip the library's
normalising and splitting, which would leave them as they are; this too is probed.
"""

from __future__ import annotations

import os
import re
from array import array

from tesselon.llm import common

ODD = re.compile(rb"[\x1c-\x1f]|<\|")
# lower-case letters of ASCII and Latin-1, in UTF-8
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
BEYOND_LATIN_1 = re.compile(rb"[\xc4-\xff]")
#: Words remembered by a worker, at most, and bytes of the longest of them: some 80 MB together. A word is remembered from the
#: second time on that a word of its hash (of SEEN) is met.
CACHE_WORDS, LONGEST, SEEN = 400_000, 64, 1 << 22
# Texts by which a vocabulary is probed: what may be cut at white space must give the same ids whole and in words.
PROBES = ("a b", "The end. Of it,\tall\n\nof  it", "don't we'll I'm 's", "x1 2y 33", "\u00e9t\u00e9 STRASSE stra\u00dfe", "(so) -- it; \"is\" #1", " leading and trailing ", "\u4f60\u597d \u0416\u0416 \u0130. A\u030a b")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 for itself, the others numbered from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class Encoder:
    """encode(texts) -> for each text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.letters = self.tok.model, byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.seen = bytearray(SEEN)
        self.cut = all(self.whole(t) == b"".join(map(self.whole, t.split())) for t in PROBES)
        self.lowers = self.cut and all(self.whole(t) == self.whole(t.lower()) for t in (*PROBES[:7], "".join(map(chr, range(0xA0, 0x100)))))
        self.marks = {m.encode(): self.whole(m) for m in (".", ",")}
        self.direct = all(self.word(w.encode()) == self.whole(w) for w in ("thandor", "étude", "straße", "überñ", "ÿ", "z"))

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: bytes) -> bytes:
        """A word that matches LETTERS, straight from the model."""
        return array("I", [x.id for x in self.model.tokenize(word.decode("latin-1").translate(self.letters))]).tobytes()

    def learn(self, word: bytes) -> bytes:
        mark = self.marks.get(word[-1:], b"")
        letters = word[:-1] if mark else word
        if self.direct and LETTERS.fullmatch(letters):
            ids = (mark and self.known.get(letters) or self.word(letters)) + mark
        else:
            ids = self.whole(word.decode())
        at = hash(word) % SEEN
        if not self.seen[at]:
            self.seen[at] = 1
        elif len(word) <= LONGEST:
            self.known[word] = ids
        return ids

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        known, out = self.known, []
        for t in texts:
            if not t:
                out.append(b"")
            elif not self.cut or ODD.search(t):
                out.append(self.whole(t.decode()))
            else:
                if len(known) > CACHE_WORDS:
                    known.clear()
                if self.lowers and not BEYOND_LATIN_1.search(t):
                    t = t.lower() if t.isascii() else t.decode().lower().encode()
                words = t.split()
                ids = list(map(known.get, words))
                if None in ids:
                    ids = [i if i is not None else known.get(w) or self.learn(w) for i, w in zip(ids, words, strict=True)]
                out.append(b"".join(ids))
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary, as long as its tasks follow each other."""
    known = common.worker_cache("encoders")
    if path not in known:
        known[path] = Encoder(path)
    return known[path]
