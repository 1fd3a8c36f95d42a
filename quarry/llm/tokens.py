"""Whole-text encoding with a word-piece cache.

Both kinds of vocabulary file cut a text at white space before merging, so a
text's ids are the ids of its space-separated pieces in order.  Where that is
independent too, a piece is cut once more, into letter runs and what lies
between them.  Parts repeat far more than pieces or texts do; each task encodes
a part once with the tokenizers library and reuses its ids.  A text that can be
cut into parts throughout is cut at once, any other into pieces, the ids of
which are remembered as well.  Texts whose cut is not independent of the
neighbours (a space between white space) or that hold the string of an added
token (``<|endoftext|>``) are encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable

import numpy as np

from quarry.llm.spans import FORGET

#: pieces, and parts of pieces, in a generation of a worker's cache; two generations are kept (about 200 bytes an entry)
CACHE_PIECES = 200_000
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
# str.split() and \s take these for white space, the tokenizers library does not
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACED = re.compile(r"[\S\x1c-\x1f]+")
# Parts of a piece: letter runs (with a leading space) and what lies between.
# Both kinds of vocabulary cut there, if a piece has ASCII and Latin-1 letters
# only, no apostrophe (contractions) and no two white-space characters in a row.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"(?!.*\s\s)[\x00-\x26\x28-\x7F{_LETTER}]+", re.S)
_RUN = re.compile(rf" ?[{_LETTER}]+")
_PARTS = re.compile(rf" ?[{_LETTER}]+|[^{_LETTER}]+(?<! )| ")
# The same parts, found in a whole text: of pieces with a leading space (byte-level), of pieces without (word-end).
_ODD = re.compile(rf"[^\x00-\x1b\x20-\x26\x28-\x7F{_LETTER}]")
_DOUBLE = re.compile(r"\s\s")
_TEXT_PARTS = {True: re.compile(rf" ?[{_LETTER}]+| ?[^{_LETTER} ]+| "), False: re.compile(rf"[{_LETTER}]+|[^{_LETTER}\s]+")}
_ENCODERS: dict = {}
FORGET.append(_ENCODERS.clear)


class Generations:
    """Bounded cache that forgets what has not been used for a whole generation."""

    def __init__(self, size: int):
        self.size, self.now, self.before = size, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Keys without a value; the others are in ``now`` afterwards."""
        if len(self.now) > self.size:
            self.now, self.before = {}, self.now
        out = []
        for k in keys.difference(self.now):
            v = self.before.get(k)
            if v is None:
                out.append(k)
            else:
                self.now[k] = v
        return out


class Remembered(dict):
    """Values that are made when first asked for; forgets, at a ``turn``, what has not been used for a whole generation."""

    def __init__(self, size: int, make: Callable[[str], bytes]):
        self.size, self.make, self.before = size, make, {}

    def turn(self) -> None:
        if len(self) > self.size:
            self.before = dict(self)
            self.clear()

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes for themselves, the others from U+0100 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def little(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit bytes of ids."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def words(text: str) -> list[str]:
    """The text cut at what the tokenizers library takes for white space."""
    return _SPACED.findall(text) if any(c in text for c in _SEPARATORS) else text.split()


class PieceEncoder:
    """Little-endian uint32 ids of texts, as bytes.

    ``spaced``: the vocabulary keeps a leading space in a piece (byte-level);
    otherwise white space is dropped (word-end vocabularies).
    """

    def __init__(self, path: str, pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # a text with the string of an added token has its id there: such texts are encoded whole
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.spaced = bool(self.tok.encode("a b", add_special_tokens=False).ids != self.tok.encode("a  b", add_special_tokens=False).ids)
        self.width = (self.tok.get_vocab_size() - 1).bit_length()
        self.cache, self.parts = Generations(pieces), Remembered(pieces, self.part)
        # the merge model alone, if it gives what the whole tokenizer gives for words
        self.characters = dict(enumerate(byte_characters()))
        self.blank = self.characters[32]
        self.merges = None
        merges = self.tok.model.tokenize
        probe = ["the", " the", "éüñß", " Straße", "qzxkw"]
        probe = [x if self.spaced else x.strip().lower() for x in probe]
        if [[t.id for t in merges(x.encode().decode("latin-1").translate(self.characters))] for x in probe] == [
                self.tok.encode(x, add_special_tokens=False).ids for x in probe]:
            self.merges = merges

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of many different pieces: their parts are encoded once each."""
        lead = 1 if self.spaced else 0
        cut = []
        for p in pieces:
            if not self.spaced:
                p = p.lower() if _PLAIN.fullmatch(p) else p
            if p.isascii() and (p[lead:] if p[:1] == " " else p).isalpha():
                cut.append((p,))
            else:
                cut.append(_PARTS.findall(p) if _PLAIN.fullmatch(p) else (p,))
        self.parts.turn()
        get = self.parts.__getitem__
        return [get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in cut]

    def part(self, x: str) -> bytes:
        """Ids of one part."""
        if self.merges and _RUN.fullmatch(x):  # one word for the merge model, nothing to cut or normalise any more
            word = x.replace(" ", self.blank) if x.isascii() else x.encode().decode("latin-1").translate(self.characters)
            return little([t.id for t in self.merges(word)])
        return little(self.tok.encode(x, add_special_tokens=False).ids)

    def plain(self, text: str) -> bool:
        """Whether the text can be cut into parts throughout."""
        return not (_ODD.search(text) or (self.spaced and _DOUBLE.search(text)) or self.added.search(text))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        out, odd = [b""] * len(texts), []
        self.parts.turn()
        get, parts = self.parts.__getitem__, _TEXT_PARTS[self.spaced].findall
        for i, t in enumerate(texts):
            if self.plain(t):
                out[i] = b"".join(map(get, parts(t if self.spaced else t.lower())))
            else:
                odd.append(i)
        for i, ids in zip(odd, self.by_pieces([texts[i] for i in odd])):
            out[i] = ids
        return out

    def by_pieces(self, texts: list[str]) -> list[bytes]:
        # byte-level: a key stands for the piece with a space before it; the first piece of a text has none
        cut = [t.split(" ") if self.spaced else words(t) for t in texts]
        whole = {i for i, t in enumerate(texts) if self.added.search(t) or (self.spaced and _UNSAFE.search(t))}
        first = [b""] * len(texts)
        if self.spaced:
            heads = sorted({c[0] for i, c in enumerate(cut) if i not in whole and c[0]})
            ids = dict(zip(heads, self.pieces(heads)))
            first = [ids.get(c.pop(0), b"") if i not in whole else b"" for i, c in enumerate(cut)]
        for i in whole:
            first[i], cut[i] = self.whole([texts[i]])[0], []
        missing = self.cache.missing(set().union(*cut))
        cache = self.cache.now
        cache.update(zip(missing, self.pieces([" " + x for x in missing] if self.spaced else missing)))
        get = cache.__getitem__
        return [f + b"".join(map(get, c)) for f, c in zip(first, cut)]


def encoder(path: str, pieces: int = CACHE_PIECES) -> PieceEncoder:
    """One encoder per worker process, vocabulary file and cache size."""
    if (path, pieces) not in _ENCODERS:
        _ENCODERS[path, pieces] = PieceEncoder(path, pieces)
    return _ENCODERS[path, pieces]


def text_groups(texts, max_chars: int = 1 << 20):
    """(first, last) row ranges of about ``max_chars`` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > max_chars:
            yield first, i
            first, size = i, 0
        size += n + 1
    if first < len(texts):
        yield first, len(texts)
