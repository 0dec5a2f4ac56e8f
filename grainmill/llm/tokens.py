"""Exact token ids at corpus speed.

The tokenizers library spends most of its time on words it has seen before. Texts are cut before a
space that follows a character that is not white space; every tokenizer whose pre-tokeniser never joins
such a character with what follows gives the same ids for the pieces as for the whole. Pieces
are encoded by the library once per worker and then looked up. Each encoder holds its pieces against the library's ids
of a few probes first; a tokenizer that fails there encodes texts whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from tokenizers import Tokenizer

#: Characters of text that are cut up at once, and pieces kept by one worker before it starts afresh.
CHARS_AT_ONCE = 1 << 20
PIECES_KEPT = 1_000_000
#: Pieces that the library encodes as one text.
JOINED = 200


class _Index(dict):
    """Numbers pieces in order of first sight and remembers the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


def pieces(text: str) -> list[str]:
    """Cut before each space or line feed that follows a character that is not white space."""
    out: list[str] = []
    gap = ""
    for line in text.split("\n"):
        for word in line.split(" "):
            last = out[-1] if out else ""
            if not out or (last and not last[-1].isspace()):
                out.append(gap + word)
            else:
                out[-1] = last + gap + word
            gap = " "
        gap = "\n"
    return out


#: What the quick cut below can't handle: white space but spaces and line feeds, and its own mark.
_ODD = re.compile(r"[^\S \n]|\x00")
_ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x00"


def keys(text: str) -> list[str]:
    """The pieces of a text by key: a piece's key lacks its leading space; ``\\0`` marks pieces kept as they are."""
    out = text.replace("\n", " \n").split(" ")
    if "" in out or "\n" in out or (any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD.search(text)):
        return ["\x00" + p for p in pieces(text)]
    out[0] = "\x00" + out[0]
    return out


def _piece(key: str) -> str:
    return key[1:] if key[0] == "\x00" else key if key[0] == "\n" else " " + key


#: Marks that end a word; no pre-tokeniser in use joins one to a letter or digit before it.
_TAIL = frozenset(",.!?;:")


PROBES = ("Good day, Sir! It's 12:30.\n\nA  b c;", "\u00e9t\u00e9 o\u00f9?  na\u00efve\t1 234,56 \u20ac, x=y; if (a<b): c!", "don't stop. New York is in the USA,\nand so on and on.", "\u65e5\u672c\u8a9e \u6587 ok of the and of the")


class Encoder:
    """Encodes texts with a tokenizers file; one per Python worker and file."""

    _made: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, keep: int = PIECES_KEPT):
        self.tokenizer, self.keep, self.whole = Tokenizer.from_file(path), keep, False
        self._restart()
        self.whole = any(self.encode([p])[0].tolist() != self.tokenizer.encode(p, add_special_tokens=False).ids for p in PROBES)
        self._restart()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's own encoder, with what it has learnt from earlier batches."""
        key = (path, PIECES_KEPT)
        if key not in cls._made:
            cls._made[key] = cls(path)
        return cls._made[key]

    def _restart(self) -> None:
        self.index = _Index()
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.used = self.known = 0

    def _learn(self) -> None:
        """Ids of the new pieces: of a word and its end mark apart, as many words differ only in that."""
        new, look = self.index.new, self.index.__getitem__
        if not new:
            return
        base = self.known
        tailed, heads, rest = [], [], []
        for n, p in enumerate(new, base):  # the list grows by the words and marks looked up here
            if p[-1] in _TAIL and p[-2:-1].isalnum():
                tailed.append((n, look(p[:-1]), look("\x00" + p[-1])))
            elif p[0] != "\x00":
                heads.append(n)
            else:  # could join its neighbours
                rest.append(n)
        self.index.new = []
        self.known = base + len(new)
        self._room(self.known)
        for i in range(0, len(heads), JOINED):
            run = heads[i : i + JOINED]
            texts = [_piece(new[n - base]) for n in run]
            e = self.tokenizer.encode("".join(texts), add_special_tokens=False)
            at = np.searchsorted(np.cumsum([len(p) for p in texts]), [o[0] for o in e.offsets], side="right")
            self._store(np.array(run), np.bincount(at, minlength=len(run)), np.array(e.ids, np.uint32))
        for n, e in zip(rest, self.tokenizer.encode_batch([_piece(new[n - base]) for n in rest], add_special_tokens=False), strict=True):
            self._store(np.array([n]), np.array([len(e.ids)]), np.array(e.ids, np.uint32))
        if tailed:
            n, head, mark = np.array(tailed).T
            # A word whose own end is such a mark cannot be: its last character is a letter or digit.
            self._store(n, self.sizes[head] + self.sizes[mark], self._ids(np.stack([head, mark], 1).ravel())[0])

    def _room(self, numbers: int, ids: int = 0) -> None:
        grown = lambda x, need: x if need <= len(x) else np.concatenate([x, np.zeros(max(need, 2 * len(x)) - len(x), x.dtype)])
        self.sizes, self.starts, self.flat = grown(self.sizes, numbers), grown(self.starts, numbers), grown(self.flat, ids)

    def _store(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self._room(0, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[numbers] = sizes
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _ids(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by number, and where each piece's ids end."""
        sizes = self.sizes[which].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.starts[which] - total[:-1], sizes) + np.arange(total[-1])], total

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        out, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHARS_AT_ONCE):
                size += len(texts[to])
                to += 1
            ids, counts[at:to] = self._some(texts[at:to])
            out.append(ids)
            at = to
        return np.concatenate(out), counts

    def _some(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.whole:
            found = self.tokenizer.encode_batch(list(texts), add_special_tokens=False)
            return np.array([i for e in found for i in e.ids], np.uint32), np.array([len(e.ids) for e in found], np.int64)
        if len(self.index) > self.keep:
            self._restart()
        look, place, ends = self.index.__getitem__, [], []
        for text in texts:
            if text:
                place += map(look, keys(text))
            ends.append(len(place))
        self._learn()
        ids, total = self._ids(np.array(place, np.int64))
        return ids, np.diff(total[np.array(ends, np.int64)], prepend=0)
