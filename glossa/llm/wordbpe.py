"""Exact, remembered encoding with a word-end BPE vocabulary of the tokenizers library.

The vocabulary's pre-tokenizer cuts a lower-cased text into words, digits and runs of signs, never across white space, and
each piece is encoded by itself. A worker remembers the ids of the pieces it has met (two generations of at most HELD) and
asks the library's BPE model for the others. A text that holds anything but plain Latin-1 signs, letters and blanks is
encoded by space-free chunks, each wholly by the library where it isn't plain; texts with the few control characters that
Python and the vocabulary split differently go to the library whole.
"""

from __future__ import annotations

import re

import numpy as np

from glossa.llm import common

HELD = 250_000

_CONTROL = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte: printable Latin-1 bytes stand for
    themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.model = self.tool.model
        self.size = self.tool.get_vocab_size()
        self.letters = byte_letters()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _met(self, piece: str) -> bytes:
        """The ids of a piece that this generation hasn't met."""
        got = self.old.get(piece)
        if got is None:
            mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            got = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
        if len(self.new) >= HELD:
            self.old, self.new = self.new, {}
        self.new[piece] = got
        return got

    def _plain(self, text: str) -> bytes:
        pieces = _PIECES.findall(text.lower())
        got = list(map(self.new.get, pieces))
        if None in got:
            for k, x in enumerate(got):
                if x is None:
                    got[k] = self.new.get(pieces[k]) or self._met(pieces[k])
        return b"".join(got)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; a null text has none."""
        if not text:
            return b""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self._plain(text)
        if _CONTROL.search(text):
            return self.library(text)
        return b"".join([self._plain(c) if _PLAIN.fullmatch(c) and "<|" not in c else self.library(c) for c in text.split()])


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This worker's encoder of a vocabulary file; it stays while the worker lives."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(common.tokenizer_path(name))
    return _ENCODERS[name]
