"""Token ids of whole texts, by the ``tokenizers`` library.

``Encoder`` gives the ids that ``Tokenizer.encode(text,
add_special_tokens=False)`` gives, but asks the tokenizer once per distinct
piece: a text is cut where no token can reach across (before a single blank or
newline between two non-blank characters), and the ids of its pieces are put
together.  A piece of letters is one pre-token and goes to the tokenizer's
model directly; any other goes through the whole tokenizer.  The memo of
pieces is bounded and lives as long as the Python worker.  Tokenizer files are
read on the executors, from the installed ``public_tokenizers`` package.
"""

from __future__ import annotations

import os
import re
import string
from array import array

import numpy as np

#: Pieces remembered per worker and memo (about 250 bytes each).
MEMO = 1_000_000
#: Letters below this code point have one class in all Unicode versions.
SETTLED = "԰"


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if _NATIVE else np.array(ids, "<u4").tobytes()


_NATIVE = array("I", [1]).tobytes() == b"\1\0\0\0"


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece):
        ids = self.make(piece)
        if len(self) < MEMO:
            self[piece] = ids
        return ids


def _byte_characters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character: itself
    where it is one, else the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Encoder:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(public_tokenizers.path(name))
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tok.model.tokenize
        self.normal = self.tok.normalizer.normalize_str if self.tok.normalizer else lambda x: x
        letters = string.ascii_letters
        # ASCII letters one by one, where the normalizer takes them so
        self.ascii = {ord(c): self.normal(c) for c in letters} if self.normal(letters) == "".join(map(self.normal, letters)) else None
        self.table = _byte_characters()
        self.drops_blanks = self._whole(" a") == self._whole("a")
        self.newline = self._whole("\n")
        self.alone = _Memo(self._piece)
        self.after_blank = self.alone if self.drops_blanks else _Memo(lambda p: self._piece(" " + p))

    def _whole(self, text: str) -> bytes:
        return _packed(self.tok.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of a text: by the model alone if it is one pre-token of
        letters (maybe after a blank, maybe before a comma or stop)."""
        blank = piece[:1] == " "
        core = piece[1:] if blank else piece
        tail = core[-1:] if core[-1:] in (",", ".") else ""
        core = core[:-1] if tail else core
        plain = self.ascii is not None and core.isascii()
        if not core.isalpha() or not plain and max(core) >= SETTLED:
            return self._whole(piece)
        core = core.translate(self.ascii) if plain else self.normal(core)
        if not plain and (not core.isalpha() or max(core) >= SETTLED):
            return self._whole(piece)
        if blank and not self.drops_blanks:
            core = " " + core
        letters = core.encode().decode("latin-1").translate(self.table)
        ids = _packed([t.id for t in self.model(letters)])
        return ids + self.alone[tail] if tail else ids

    def _text(self, text: str) -> bytes:
        lines = text.split("\n")
        if "  " in text or "" in lines or any(x[0] == " " or x[-1] == " " for x in lines) or not all(map(str.isprintable, lines)):
            # unusual white space: cut only between two non-blank characters
            return b"".join(map(self.alone.__getitem__, re.split(r"(?<=\S)(?=[ \n]\S)", text))) if text else b""
        if self.drops_blanks:
            return b"".join(map(self.alone.__getitem__, text.replace("\n", " ").split(" ")))
        out = []
        for line in lines:
            words = line.split(" ")
            out.append(self.alone[words[0]] + b"".join(map(self.after_blank.__getitem__, words[1:])))
        return self.newline.join(out)

    def encode(self, texts) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        return [self._text(t) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder of that vocabulary."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
