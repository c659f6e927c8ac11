"""Token ids of a public tokenizer, many texts at once.

The word-level tokenizer file lower-cases, drops white space and encodes each piece
(letters, one digit, or other signs) alone. So texts are cut into pieces with
numpy, and only pieces that a worker hasn't met are encoded, by the tokenizer's own
model. Texts with characters outside a range for which the cut is certain, or with
the string of an added token, go through the tokenizer whole. A met piece is looked up by a 64-bit hash and compared
with the piece remembered, character by character; a piece that differs from the one
of its hash is encoded alone.
"""

from __future__ import annotations

import os
import re
from functools import cached_property

import numpy as np

from .words import _powers, mix

#: Characters that NFC leaves alone and whose lower case is one character: printable ASCII, tab and line ends, Latin letters and signs.
_PLAIN = re.compile("[^ -~\t\n\r¡-¬®-±´-¶¸º»¿-įĲ-ɏ]")
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
#: Pieces that a worker remembers, some 40 bytes each; beyond, it forgets them all and starts anew.
PIECES_KEPT = 500_000
_BASE = 0xA0761D6478BD642F


def _classes() -> np.ndarray:
    kinds = [_SPACE if chr(c).isspace() or c == 0 else _DIGIT if 48 <= c <= 57 else _LETTER if chr(c).isalpha() else _SIGN for c in range(0x250)]
    return np.array(kinds, np.uint8)


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        # The model for pieces that are cut and normalised already, a space between.
        self.model = Tokenizer.from_file(path)
        added = [x.content for x in self.model.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        self.model.encode_special_tokens = True  # no piece is one of these
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.model.get_vocab()
        self.dtype = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kinds = _classes()
        self._forget()

    @cached_property
    def whole(self):
        """The tokenizer as it is in the file; many workers never need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.firsts, self.ids = np.zeros(1, np.int64), np.zeros(0, self.dtype)
        self.begins, self.letters = np.zeros(1, np.int64), np.zeros(0, np.uint16)  # the pieces themselves

    def _model_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lower-cased pieces one after another, and where each piece's end."""
        lists = self.model.encode_batch_fast([" ".join(pieces[i : i + 500]) for i in range(0, len(pieces), 500)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, self.dtype) for e in lists])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("this tokenizer doesn't encode pieces alone")
        return ids, ends

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids, ends = self._model_ids(pieces)
        places = len(self.firsts) - 1 + np.arange(len(pieces))
        self.firsts = np.concatenate([self.firsts, self.firsts[-1] + ends])
        self.ids = np.concatenate([self.ids, ids])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum([len(x) for x in pieces])])
        self.letters = np.concatenate([self.letters, np.frombuffer("".join(pieces).encode("utf-16-le"), "<u2")])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.places = np.insert(self.hashes, at, hashes), np.insert(self.places, at, places)

    def _strangers(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Indexes of the pieces that aren't the remembered pieces at `place`."""
        other = sizes != np.diff(self.begins)[place]
        same = np.flatnonzero(~other)
        n = sizes[same]
        ends = np.cumsum(n)
        steps = np.arange(int(ends[-1]) if len(ends) else 0)
        here = steps + np.repeat(starts[same] - (ends - n), n)
        there = steps + np.repeat(self.begins[place[same]] - (ends - n), n)
        wrong = np.flatnonzero(points[here] != self.letters[there])
        other[same[np.unique(np.searchsorted(ends, wrong, "right"))]] = True
        return np.flatnonzero(other)

    def _pieces(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of lower-cased code points."""
        kinds = self.kinds[points]
        change = np.ones(len(points) + 1, bool)
        change[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        lone = np.flatnonzero((points == 39) & change[:-1] & change[1:])  # an apostrophe and what it contracts are one piece
        if len(lone):
            padded = np.concatenate([points, np.zeros(2, points.dtype)])
            a, b = padded[lone + 1], padded[lone + 2]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = np.any([(a == ord(x)) & (b == ord(y)) for x, y in ("re", "ve", "ll")], axis=0)
            for at, k in ((lone[one], 1), (lone[two], 2)):
                change[at + 1] = False
                change[at + 1 + k] = True
        starts = np.flatnonzero(change[:-1])
        ends = np.append(starts[1:], len(points))
        piece = kinds[starts] != _SPACE
        return starts[piece], ends[piece]

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        flat = "\0".join(texts).lower()
        points = np.frombuffer(flat.encode("utf-16-le"), "<u2")
        starts, ends = self._pieces(points)
        power, inverse = _powers(_BASE, len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(points * power[: len(points)], out=sums[1:], dtype=np.uint64)
        unique, first, which = np.unique(mix((sums[ends] - sums[starts]) * inverse[starts]), return_index=True, return_inverse=True)
        if len(self.hashes) > PIECES_KEPT:
            self._forget()
        at = np.searchsorted(self.hashes, unique)
        new = np.ones(len(unique), bool)
        within = at < len(self.hashes)
        new[within] = self.hashes[at[within]] != unique[within]
        if new.any():
            self._learn(unique[new], [flat[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            at = np.searchsorted(self.hashes, unique)
        place = self.places[at][which]
        first = self.firsts[place]
        sizes = self.firsts[place + 1] - first
        store = self.ids
        odd = self._strangers(points, starts, ends - starts, place)
        if len(odd):
            ids, stops = self._model_ids([flat[a:b] for a, b in zip(starts[odd].tolist(), ends[odd].tolist())])
            sizes[odd] = np.diff(np.concatenate([[0], stops]))
            first[odd] = len(store) + stops - sizes[odd]
            store = np.concatenate([store, ids])
        done = np.concatenate([[0], np.cumsum(sizes)])
        ids = store[np.arange(done[-1]) + np.repeat(first - done[:-1], sizes)]
        bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        cuts = done[np.searchsorted(starts, bounds)]
        return np.split(ids, cuts[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [not _PLAIN.search(t) and not self.special.search(t) for t in texts]
        out = [np.zeros(0, self.dtype)] * len(texts)
        some = [i for i, p in enumerate(plain) if p]
        if some:
            for i, ids in zip(some, self._encode_plain([texts[i] for i in some])):
                out[i] = ids
        rest = [i for i, p in enumerate(plain) if not p]
        for i in rest:
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, self.dtype)
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
