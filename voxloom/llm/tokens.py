"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

Byte-level BPE codes each pre-token by itself, and a space before a character that isn't one always begins a pre-token.
So a text is coded space by space: each stretch behind a space is looked up in the worker's table.  Stretches not seen
before are cut into pre-tokens, which are given to the library's model; those in characters that Unicode versions sort
differently are given to the library together, as one text, whose ids are cut where a token begins with a space.  Texts
with white space behind a space, or with the string of an added token, go through the library whole.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import numpy as np
import regex

#: Entries of a generation of a worker's table of stretches, and characters of one; a full generation becomes the old one.
CACHE, LONG = 600_000, 64
#: Entries of a worker's table of pre-tokens; a full table is emptied.
PIECES = 50_000
#: Entries of a worker's table of what its executor lacked; a full table is emptied.
RECENT = 200_000
#: Below it, every Unicode version sorts the characters alike: Latin, Greek and Cyrillic.
SETTLED = "\u0530"
#: Stretches that are given to the library at a time.
TOGETHER = 1_024
#: The pre-token pattern of byte-level BPE files (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> str:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self._check(json.load(f))
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.letters = byte_letters()
        self.space = self.letters[ord(" ")]
        self.begins[[i for t, i in vocab.items() if t.startswith(self.space)]] = True
        self.model, self.cut = self.library.model, regex.compile(PATTERN).findall
        self.pieces: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _check(file: dict) -> None:
        """Refuse files whose ids depend on more than the pre-token, or whose pre-tokens aren't the usual ones."""
        before, model = file.get("pre_tokenizer") or {}, file["model"]
        if file.get("normalizer") or model.get("type") != "BPE" or model.get("dropout") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE file: no normalizer, no prefix space, the usual pre-tokens")

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def _token(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            ids = self._token(piece)
            if len(piece) <= LONG:
                self.pieces[piece] = ids
        return ids

    def _word(self, w: str) -> bytes:
        """Ids of a stretch behind a space; letters, alone or before a stop, need no search for pre-tokens."""
        if w.isalpha():
            return self._letters(w)
        if w[-1] in ".," and w[:-1].isalpha():
            return (self.known.get(w[:-1]) or self._letters(w[:-1])) + self._piece(w[-1])
        if "\n" in w and (lines := w.split("\n")) == w.split():
            # a line break between two other characters is a pre-token, and what is behind it has no space
            first = lines[0]
            return (self.known.get(first) or self._word(first)) + b"".join([self._piece("\n") + self._line(x) for x in lines[1:]])
        return b"".join(map(self._piece, self.cut(" " + w)))

    def _letters(self, w: str) -> bytes:
        if w.isascii():
            return array("I", [t.id for t in self.model.tokenize(self.space + w)]).tobytes()
        return self._token(" " + w)

    def _line(self, w: str) -> bytes:
        """Ids of a stretch behind a line break."""
        if w.isalpha():
            return self._piece(w)
        return b"".join(map(self._piece, self.cut(w)))

    def _look_up(self, stretches: list[str]) -> dict[str, bytes]:
        """Ids of stretches behind a space, none of which begins with white space."""
        out = {}
        for k in range(0, len(stretches), TOGETHER):
            some = stretches[k : k + TOGETHER]
            raw = self._whole(" " + " ".join(some))
            at = np.flatnonzero(self.begins[np.frombuffer(raw, "<u4")]).tolist()
            out |= {w: raw[4 * a : 4 * b] for w, a, b in zip(some, at, [*at[1:], len(raw) // 4], strict=True)}
        return out

    def _plain(self, piece: str) -> bytes:
        """Ids of a pre-token; printable ASCII stands for itself."""
        if (ids := self.recent.get(piece)) is None:
            if len(self.recent) >= RECENT:
                self.recent.clear()
            if piece.isascii() and piece.isprintable():
                ids = array("I", [t.id for t in self.model.tokenize(piece.replace(" ", self.space))]).tobytes()
            else:
                ids = self._token(piece)
            if len(piece) <= LONG:
                self.recent[piece] = ids
        return ids

    def lacking(self, pieces: bytes, stretches: bytes, whole: bytes | None) -> list[bytes]:
        """Ids of what ``WordTable.code`` left open in a text: pre-tokens, then stretches; or the whole text."""
        if whole is not None:
            return [self._whole(whole.decode())]
        out = [self._plain(x) for x in pieces.decode().split("  ")] if pieces else []
        if stretches:
            odd = stretches.decode().split("  ")
            found = self._look_up([w[1:] for w in odd if w[0] == " " and max(w) >= SETTLED])
            for w in odd:
                if max(w) < SETTLED:
                    out.append(b"".join(map(self._piece, self.cut(w))))
                else:
                    out.append(found[w[1:]] if w[0] == " " else self._whole(w))
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(x in text for x in self.added):
            return self._whole(text)
        words = text.split(" ")
        known = self.known
        ids = list(map(known.get, words))
        first = words[0]
        ids[0] = b"".join(map(self._piece, self.cut(first))) if not first or max(first) < SETTLED else self._whole(first)
        if None in ids:
            at = [k for k, x in enumerate(ids) if x is None]
            others = []
            for k in at:
                w = words[k]
                if not w or w[0].isspace():  # a run of white space
                    return self._whole(text)
                if (x := self.old.get(w)) is None and (w.isascii() or max(w) < SETTLED):
                    x = self._word(w)
                if x is None:
                    others.append(w)
                else:
                    ids[k] = known[w] = x
            if others:
                found = self._look_up(others)
                for k in at:
                    if ids[k] is None:
                        ids[k] = known[words[k]] = found[words[k]]
            for k in at:
                if len(words[k]) > LONG:
                    known.pop(words[k], None)
            if len(known) >= CACHE:
                self.known, self.old = {}, known
        return b"".join(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    return Encoder(path)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
