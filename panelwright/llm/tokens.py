"""Exact token ids by the tokenizers library, fast enough for whole corpora.

A text is cut only where the tokenizer itself always cuts (its special tokens' strings, then the two splitters), and the ids of each piece are kept in tables of
bounded size per worker, so a frequent piece is encoded once. Pieces of plain Latin letters go straight to the vocabulary model; all else through the full encoder.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from operator import attrgetter

#: Letters for which normalisation is the identity, lower-casing is one to one, and every pattern of both tokenizers sees one run of letters.
LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#*$%&<>]*)")
MARKS = b".,;:!?|#*$%&<>"
#: Bytes that a generation of a table of pieces may hold, by estimate.
TABLE_BYTES = 40_000_000
#: Each of these makes a text irregular: white space other than single spaces and single newlines between words.
_ODD_SPACE = ("  ", " \n", "\n ", "\n\n", *map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_ID = attrgetter("id")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {}, 0
    for b in range(256):
        if b in plain:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return table


class Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers; encodes what it has not seen. Two generations: a full one becomes the old one, whose pieces come back when they are met again, so frequent pieces stay."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.held, self.old = encode, 0, {}

    def __missing__(self, piece):
        out = self.old.get(piece)
        if out is None:
            out = self.encode(piece)
        self.held += 200 + len(piece) + len(out)
        if self.held > TABLE_BYTES:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[piece] = out
        return out


class Encoder:
    """``encode(text)``: the ids of ``tokenizer.encode(text, add_special_tokens=False)`` as bytes of 32-bit integers. The string of a special token gives that token, as in the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        alphabet = _byte_letters()
        self.letters = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in [*range(0x80), *range(0xC0, 0x100)]}
        self.special = {t.content: array("I", [i]).tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in self.special) + ")") if self.special else None
        self.runs = Pieces(self._run)
        self.words = Pieces(self._word)  # of the lower-casing kind: bytes between white space
        self.first, self.after, self.any = Pieces(lambda p: self._piece(p, "")), Pieces(lambda p: self._piece(p, " ")), Pieces(self._full)

    def _full(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        """One unit of the pattern, given in the byte-level alphabet."""
        return array("I", map(_ID, self.model.tokenize(run))).tobytes()

    def _piece(self, piece: str, space: str) -> bytes:
        m = LETTERS.fullmatch(piece)
        if not m:
            return self._full(space + piece)
        word = m[1].lower() if self.lower else m[1]
        # Printable ASCII stands for itself in that alphabet. Runs are not kept beside their pieces: few come in two.
        own = self._run((self.letters[32] if space else "") + word if word.isascii() else (space + word).translate(self.letters))
        return own + self.runs[m[2]] if m[2] else own

    def _word(self, word: bytes) -> bytes:
        plain = word.rstrip(MARKS)
        if not plain.isalpha():  # of bytes: A-Z and a-z alone
            return self._piece(word.decode(), "")
        own = self._run(plain.lower().decode())
        return own if len(plain) == len(word) else own + self.runs[word[len(plain) :].decode()]

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(x in text for x in self.special):
            return self._plain(text)
        return b"".join(self.special.get(part) or self._plain(part) for part in self.cut.split(text))

    def _plain(self, text: str) -> bytes:
        if self.lower:
            # White space is dropped and no pattern looks past it, so ASCII white space always separates.
            return b"".join(map(self.words.__getitem__, text.encode("utf-8", "replace").split()))
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _ODD_SPACE):
            # A single space between two other characters always starts a unit.
            return b"".join(map(self.any.__getitem__, _BEFORE_SPACE.split(text)))
        out, first, after, newline = [], self.first, self.after, self.first["\n"]
        for k, line in enumerate(text.split("\n")):
            head, *rest = line.split(" ")
            if k:
                out.append(newline)
            out.append(first[head])
            out.extend(map(after.__getitem__, rest))
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, of the vocabulary last asked for."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches, path: str, end_id: int, text: str = "text", limit: int = 2_000_000) -> Iterator:
    """Of each Arrow batch with the column ``text``, slices of at most about ``limit`` characters, each with the ids of its texts (bytes, end id last)."""
    enc, end = encoder(path), array("I", [end_id]).tobytes()
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        at = 0
        while at < len(texts):
            ids, held, k = [], 0, at
            while k < len(texts) and held < limit:
                t = texts[k].as_py() or ""
                held += len(t)
                ids.append(enc.encode(t) + end)
                k += 1
            yield batch.slice(at, k - at), ids
            at = k


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
