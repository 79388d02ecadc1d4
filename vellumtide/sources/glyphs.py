"""A page's glyphs as arrays: one string of their characters, arrays of what differs between them, and per run what doesn't. Reads like the `glyphs` struct of a page row."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import groupby

import numpy as np

NAMES = ("text", "x", "y", "size", "advance", "dir_x", "dir_y", "wmode", "font_key", "font", "flags")

_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spaces(codes: np.ndarray) -> np.ndarray:
    """Which characters are white space."""
    return _SPACE[np.minimum(codes, 0x3001)]


def blank(text: str) -> np.ndarray:
    return spaces(codes_of(text))


class Glyphs(Mapping):
    """text: a string where every glyph is one character, else a list. tails: (number of glyphs, (dir_x, dir_y, wmode, font_key, font, flags)) of runs, in order."""

    __slots__ = ("text", "x", "y", "size", "advance", "tails")

    def __init__(self, text: str | list[str], x: np.ndarray, y: np.ndarray, size: np.ndarray, advance: np.ndarray, tails: list[tuple[int, tuple]]):
        self.text, self.x, self.y, self.size, self.advance, self.tails = text, x, y, size, advance, tails

    @classmethod
    def of_runs(cls, runs: list[tuple]) -> "Glyphs":
        """runs: (text, x, y, size, advance, tail); arrays or, but for the text, single numbers."""
        if not runs:
            return cls("", *(np.zeros(0) for _ in range(4)), [])
        ns = [len(r[0]) for r in runs]
        join = lambda k: np.concatenate([r[k] if isinstance(r[k], np.ndarray) else np.full(n, r[k], np.float64) for n, r in zip(ns, runs)])
        text = "".join(r[0] for r in runs) if all(type(r[0]) is str for r in runs) else [t for r in runs for t in r[0]]
        return cls(text, *map(join, range(1, 5)), [(n, r[5]) for n, r in zip(ns, runs)])

    @classmethod
    def of(cls, columns: Mapping) -> "Glyphs":
        """Of a page row's `glyphs` struct."""
        if isinstance(columns, cls):
            return columns
        text = list(columns["text"])
        tails = [(sum(1 for _ in run), tail) for tail, run in groupby(zip(*(columns[k] for k in NAMES[5:])))]
        return cls("".join(text) if all(len(t) == 1 for t in text) else text, *(np.asarray(columns[k], np.float64) for k in NAMES[1:5]), tails)

    def __getitem__(self, name: str):
        if name in ("text", "x", "y", "size", "advance"):
            return getattr(self, name)
        k = NAMES.index(name) - 5
        return [v for n, tail in self.tails for v in [tail[k]] * n]

    def __iter__(self):
        return iter(NAMES)

    def __len__(self) -> int:
        return len(NAMES)

    def lists(self) -> dict[str, list]:
        """The columns as plain lists."""
        return {k: v.tolist() if isinstance(v := self[k], np.ndarray) else list(v) for k in NAMES}
