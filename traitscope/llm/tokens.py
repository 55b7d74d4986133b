"""Byte-level BPE ids of whole texts, from the ids of their space-delimited units.

The pre-tokenizer of a byte-level BPE never joins a character that is not white space with a
following blank, so a text may be cut before every such blank, and the ids of a unit are the same
wherever it stands. Units repeat; each is encoded once and kept while there is room.
"""

from __future__ import annotations

import os
import re

import numpy as np

CUT = re.compile(r"(?<=\S) ")
GLUED = re.compile(r"\s ")
#: Units kept by a worker, and the longest unit that is kept.
ROOM, LONGEST = 600_000, 48


def alone(tokenizer, texts: list[str]) -> list[bytes]:
    encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return [np.array(e.ids, "<u4").tobytes() for e in encoded]


def opening_ids(tokenizer, mark: str) -> np.ndarray:
    """Whether an id's token begins with the sign that stands for a blank."""
    vocabulary = tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token.startswith(mark)]] = True
    return out


def encode_units(tokenizer, opens: np.ndarray, units: list[str], blanks: str, together: int = 400) -> list[bytes]:
    """Ids of a blank and a unit, for many units at once.

    Units go through the tokenizer in long texts, which are cut again before every token that begins
    with a blank. A unit with a blank of its own, without any character or with white space at its
    end could grow together with its neighbour and is encoded alone.
    """
    found = re.compile(f"[{blanks}]|\\s$").search
    plain = [u != "" and found(u) is None for u in units]
    joined = [u for u, ok in zip(units, plain) if ok]
    texts = [" " + " ".join(joined[i : i + together]) for i in range(0, len(joined), together)]
    cut_ids: list[bytes] = []
    for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
        ids = np.array(e.ids, "<u4")
        cuts = [*np.flatnonzero(opens[ids]).tolist(), len(ids)]
        data = ids.tobytes()
        cut_ids += [data[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:])]
    if len(cut_ids) != len(joined):
        raise ValueError("the tokenizer joins units across blanks")
    rest = iter(alone(tokenizer, [" " + u for u, ok in zip(units, plain) if not ok]))
    cut = iter(cut_ids)
    return [next(cut) if ok else next(rest) for ok in plain]


class UnitEncoder:
    """ids(texts) -> little-endian unsigned 32-bit ids of each text, as bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.opens = opening_ids(self.tokenizer, "Ġ")
        self.units: dict[str, bytes] = {}

    def _encode(self, units: list[str]) -> list[bytes]:
        """Ids of units, each a blank and what follows it up to the next one."""
        return encode_units(self.tokenizer, self.opens, units, " ")

    def _alone(self, texts: list[str]) -> list[bytes]:
        return alone(self.tokenizer, texts)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Encode a bounded batch of texts."""
        if len(self.units) > ROOM:
            self.units.clear()
        cut, missing = [], set()
        for text in texts:
            units = (CUT if GLUED.search(text) else _BLANK).split(text) if text else []
            cut.append(units)
            missing.update(units[1:])
        known = self.units
        missing = [u for u in missing if u not in known]
        known.update(zip(missing, self._encode(missing)))
        first = self._alone([units[0] if units else "" for units in cut])
        out = [b"".join([head, *map(known.__getitem__, units[1:])]) for head, units in zip(first, cut)]
        for u in [u for u in missing if len(u) > LONGEST]:
            del known[u]
        return out


class _Blank:
    @staticmethod
    def split(text: str) -> list[str]:
        return text.split(" ")


_BLANK = _Blank()
_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The encoder of this worker for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def slices(sizes: list[int], most: int = 4 << 20) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters each."""
    out, at, held = [], 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            out.append((at, i + 1))
            at, held = i + 1, 0
    if at < len(sizes):
        out.append((at, len(sizes)))
    return out
