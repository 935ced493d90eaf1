"""Encoding with a fixed public tokenizer.

``Encoder`` gives the ids of the tokenizers library as the file loads it, no setting changed; so a special token's
string in a text becomes that token's id, unless ``special_as_text`` asks for the ids of its letters. A text is cut at single spaces and line feeds that have no
white space on either side: there the pre-tokenizer always cuts too, and merges never cross its cuts, so each
piece encodes to the same ids alone as within its text. Each worker keeps the ids of pieces it has met, up to a
fixed number, and hands only new pieces to the library.
"""

from __future__ import annotations

import re
from array import array

#: Cuts are made only where neither side is white space by Unicode's rules or Python's.
SAFE = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
VOCABULARY = "byte_bpe_50k.json"
MOST_PIECES = 500_000
TAIL = ".,;:!?"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints, else the next free one after the 256th."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class OddPiece(KeyError):
    """A piece that white space makes depend on its neighbours."""


class Pieces(dict):
    """Ids of each clean piece, as bytes of little-endian unsigned 32-bit integers; filled as pieces are met."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()

    def merged(self, piece: str) -> bytes:
        """Ids of what the pre-tokenizer would not cut: letters with or without a space, or punctuation."""
        if piece.isascii():  # such letters stand for themselves
            mapped = self.letters[32] + piece[1:] if piece[:1] == " " else piece
        else:
            mapped = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        body = piece.rstrip(TAIL)
        if body.removeprefix(" ").isalpha():
            ids = self[body] + self.merged(piece[len(body) :]) if len(body) < len(piece) else self.merged(piece)
        elif piece == "\n" or piece.split() == [piece.removeprefix(" ")]:
            ids = self.whole(piece)
        else:
            raise OddPiece(piece)
        self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str, most_pieces: int = MOST_PIECES, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.most, self.known = most_pieces, Pieces(self.tokenizer)

    def odd(self, text: str) -> bytes:
        """Ids of a text with white space in runs, at its ends or of other kinds."""
        marks = [0, *(m.start() for m in SAFE.finditer(text)), len(text)]
        return b"".join(self.known.whole(text[a:b]) for a, b in zip(marks, marks[1:]))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as bytes of unsigned 32-bit integers; a null has none."""
        if not text:
            return b""
        if len(self.known) > self.most:  # the older half goes
            for piece in list(self.known)[: self.most // 2]:
                del self.known[piece]
        if "\0" in text:
            return self.odd(text)
        try:
            return b"".join(map(self.known.__getitem__, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))
        except OddPiece:
            return self.odd(text)


ENCODERS: dict[tuple[str, int, bool], Encoder] = {}


def encoder(path: str, most_pieces: int = MOST_PIECES, special_as_text: bool = False) -> Encoder:
    """This worker's encoder; tasks of one worker share it."""
    key = (path, most_pieces, special_as_text)
    if key not in ENCODERS:
        ENCODERS[key] = Encoder(*key)
    return ENCODERS[key]
