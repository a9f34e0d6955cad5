"""Token ids of whole texts by the tokenizers library, with a cache of the pieces that stand between spaces.

A byte-level vocabulary starts a new piece at a single space or line end between two characters that are no white space,
so a text is the concatenation of such pieces, and each distinct one is encoded once per worker. A piece of common
letters, digits and signs is cut by the vocabulary's own fixed pattern and each cut is encoded by the library's model;
any other piece, and any text whose white space stands otherwise, goes through the library's encode().
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from itertools import islice

from skein.llm.common import worker_cache

#: Pieces of one of the two generations that a worker keeps (memory, not results, depends on it).
CACHE_PIECES = 500_000
#: Marks that the pattern cuts off a letter before them.
MARKS = ".,!#$%&*"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: the byte-level pattern, for pieces of the characters in _COMMON only, on which `re` cuts as it says.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")
_LETTERS = re.compile(f"[{_LETTER}]*")
_COMMON = re.compile(rf"[\x20-\x7e\n{_LETTER}]*")


class Uneven(Exception):
    """White space of a text does not stand singly between other characters."""


class _Shown(dict):
    """How the byte-level alphabet shows a character: printable bytes as themselves, the others as code points from 256 on."""

    def __init__(self):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.bytes = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, point: int) -> str:
        self[point] = out = "".join([self.bytes[b] for b in chr(point).encode()])
        return out


class Vocabulary:
    """A tokenizer file, opened once per worker."""

    def __init__(self, path: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as they are in memory: little-endian, 32 bits")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre, model = said.get("pre_tokenizer") or {}, said["model"]
        #: Whether the pieces may be cut here; for other kinds of vocabulary texts go to the library whole.
        self.by_pieces = said.get("normalizer") is None and (pre.get("type"), pre.get("use_regex", True), pre.get("add_prefix_space")) == ("ByteLevel", True, False) and model.get("type") == "BPE" and not model.get("dropout")
        # strings of the vocabulary's own marks stay whole
        added = [x["content"] for x in said.get("added_tokens", [])]
        self.by_pieces = self.by_pieces and not any(c.isspace() for x in added for c in x)
        self.added, self.codes, self.tokenize = tuple(added), _Shown(), self.tokenizer.model.tokenize

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, shown: str) -> list[int]:
        """Ids of one cut of the pattern, its bytes written as the byte-level alphabet shows them."""
        return [t.id for t in self.tokenize(shown)]

    def piece(self, text: str) -> bytes:
        if not _COMMON.fullmatch(text) or self.added and any(x in text for x in self.added):
            return self.whole(text)
        return array("I", [i for u in _PATTERN.findall(text) for i in self.letters(u.translate(self.codes))]).tobytes()


class Pieces(dict):
    """Ids by piece, in two generations: what was not asked for since the last turn goes.

    `before` is what stands before a piece; one that begins with a line end has that instead.
    """

    def __init__(self, vocabulary: Vocabulary, before: str):
        self.vocabulary, self.before, self.old, self.tails = vocabulary, before, {}, {}
        self.shown = before.translate(vocabulary.codes)
        self.line = vocabulary.piece("\n")

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            v, line = self.vocabulary, piece[:1] == "\n"
            own = piece[1:] if line else piece
            if own.isalpha() and (own.isascii() or _LETTERS.fullmatch(own)):  # one cut
                shown = own if own.isascii() else own.translate(v.codes)
                ids = array("I", v.letters(shown if line else self.shown + shown)).tobytes()
                ids = self.line + ids if line else ids
            elif not own or own[0].isspace() or own[-1].isspace() or "\u180e" in own:
                raise Uneven
            else:
                root = own.rstrip(MARKS)
                if root and len(root) < len(own) and root[-1].isalpha() and root[-1] <= "ɏ":
                    tail = own[len(root) :]
                    if tail not in self.tails:
                        if len(self.tails) > 1000:
                            self.tails.clear()
                        self.tails[tail] = v.piece(tail)
                    ids = self[piece[: len(piece) - len(tail)]] + self.tails[tail]
                else:
                    ids = v.piece(piece if line else self.before + piece)
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


_OPEN: dict[str, Vocabulary] = {}


def encode(texts: list[str], path: str) -> list[bytes]:
    """For each text its ids as little-endian unsigned 32-bit integers, as encode(text, add_special_tokens=False) gives them."""
    if path not in _OPEN:
        _OPEN[path] = Vocabulary(path)
    v = _OPEN[path]
    if not v.by_pieces:
        return [v.whole(t) for t in texts]
    first = worker_cache("tokens", lambda: Pieces(v, ""), f"first {path}")
    spaced = worker_cache("tokens", lambda: Pieces(v, " "), f"spaced {path}")
    out = []
    for t in texts:
        if not t:
            out.append(b"")
            continue
        words = t.replace("\n", " \n").split(" ")
        try:
            out.append(first[words[0]] + b"".join(map(spaced.__getitem__, islice(words, 1, None))))
        except Uneven:
            cut = _CUT.split(t)
            out.append(v.piece(cut[0]) + b"".join([v.piece(" " + x) for x in islice(cut, 1, None)]))
    return out
