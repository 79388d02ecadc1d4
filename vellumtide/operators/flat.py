"""Layout of flat pages: every glyph one upright character of horizontal text, no columns of CJK glyphs among them. The rules are those of `layout`, worked out on arrays of the whole page;
pages that aren't flat take `layout`'s plain loops, with the same results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from vellumtide.operators.layout import ASCENT, BLOCK_GAP, CJK, DESCENT, LINE_SEGMENT_GAP, LINE_TOLERANCE, MAX_VERTICAL_CJK_CANDIDATES, MIN_VERTICAL_CJK_GLYPHS, WORD_GAP, by_columns, stand_alone
from vellumtide.sources.glyphs import Glyphs, codes_of, spaces


def strings(codes: np.ndarray, starts: np.ndarray) -> pa.Array:
    """An array of strings of the characters from each start to the next."""
    if not len(codes) or codes.max() < 128:
        data, at = codes.astype(np.uint8).tobytes(), np.append(starts, len(codes))
    else:
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        at = np.append(0, width.cumsum())[np.append(starts, len(codes))]
        data = codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8")
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))


class _Part:
    """What reading order needs of a line or segment."""

    __slots__ = ("a", "b", "box", "size")

    def __init__(self, a, b, box, size):
        self.a, self.b, self.box, self.size = a, b, box, size


def _upright(g: Glyphs) -> bool:
    return isinstance(g.text, str) and all(tail[:3] == (1.0, 0.0, 0) for _, tail in g.tails)


def _columns(g: Glyphs, codes: np.ndarray) -> bool:
    """Whether some glyph may stand in a column of CJK glyphs."""
    if codes.max() < 0x2E80 or CJK.search(g.text) is None:
        return False
    cjk = np.array([CJK.match(c) is not None for c in g.text])
    if not MIN_VERTICAL_CJK_GLYPHS <= cjk.sum() <= MAX_VERTICAL_CJK_CANDIDATES:
        return False
    return stand_alone(g.x[cjk], g.y[cjk], np.maximum(g.size[cjk], 1.0), np.repeat(np.unique([t[3] for _, t in g.tails], return_inverse=True)[1], [n for n, _ in g.tails])[cjk]).any()


class FlatPage:
    """Glyphs in reading order: line i of the page is [at[i], at[i + 1])."""

    @classmethod
    def of(cls, g) -> "FlatPage | None":
        """The page, or None where it isn't flat."""
        g = Glyphs.of(g) if g is not None else Glyphs.of_runs([])
        if not _upright(g):
            return None
        codes = codes_of(g.text)
        if len(codes) and (not np.isfinite(g.x.sum() + g.y.sum() + g.size.sum() + g.advance.sum()) or _columns(g, codes)):
            return None
        return cls(g, codes)

    def __init__(self, g: Glyphs, codes: np.ndarray):
        self.glyphs, self.codes, self.moved = g, codes, False
        self.x, self.y, self.size, self.advance = g.x, g.y, g.size, g.advance
        self.font = None if len({t[3:] for _, t in g.tails}) < 2 else np.repeat(np.arange(len(g.tails)), [n for n, _ in g.tails])
        self.at, self.space, self.spaced = np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0, bool)
        if not len(codes):
            return
        dy, dx = np.diff(self.y), np.diff(self.x)
        if ((dy < 0) | (dy == 0) & (dx < 0)).any():
            self._take(np.lexsort((self.x, self.y)), True)
            dy = np.diff(self.y)
        cuts = self._lines(np.append(0, np.flatnonzero(dy) + 1))
        self.at = np.append(cuts, len(codes))
        within = np.ones(len(codes) - 1, bool)
        within[cuts[1:] - 1] = False
        if (within & (np.diff(self.x) < 0)).any() or self.moved and (within & (dy != 0)).any():
            line = np.repeat(np.arange(len(cuts)), np.diff(self.at))
            self._take(np.lexsort((self.seq if self.moved else np.arange(len(codes)), self.x, line)), True)
        gap = self.x[1:] - self.x[:-1] - self.advance[:-1]
        self._measure(gap, within)
        wide = within & (gap > LINE_SEGMENT_GAP * np.maximum(self.em[1:], self.em[:-1]))
        self.parts = np.add.reduceat(np.append(0, wide), self.at[:-1]) + 1
        self.physical = self.at[:-1], self.parts, self.box[2], self.baselines()
        if (self.parts > 1).sum() >= 2:
            self._columns_first(np.flatnonzero(wide) + 1)

    def _take(self, order: np.ndarray, moved: bool) -> None:
        self.seq = self.seq[order] if self.moved else order
        self.moved = self.moved or moved
        self.codes, self.x, self.y, self.size, self.advance = (v[order] for v in (self.codes, self.x, self.y, self.size, self.advance))
        self.font = None if self.font is None else self.font[order]

    def _lines(self, levels: np.ndarray) -> np.ndarray:
        """Where lines begin; levels: where the baseline changes, from the top."""
        em = np.maximum(self.size, 1.0)
        low, high = np.minimum.reduceat(em, levels), np.maximum.reduceat(em, levels)
        out, base = [0], self.y[0]
        at = [*levels.tolist(), len(em)]
        for i, (y, lo, hi) in enumerate(zip(self.y[levels].tolist(), low.tolist(), high.tolist())):
            d = abs(y - base)
            if i and d > LINE_TOLERANCE * lo:
                out.append(at[i] if lo == hi else at[i] + int(np.argmax(d > LINE_TOLERANCE * em[at[i] : at[i + 1]])))
                base = y
        return np.array(out)

    def _measure(self, gap: np.ndarray, within: np.ndarray) -> None:
        self.em = np.maximum(self.size, 1.0)
        self.spaced = np.append(False, within & (gap > WORD_GAP * self.em[1:]))
        self.space = spaces(self.codes)
        self._boxes()

    def _boxes(self) -> None:
        self.box = self.boxes(self.at[:-1])
        self.most = np.maximum.reduceat(self.size, self.at[:-1])

    def boxes(self, starts: np.ndarray, some: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """x0, y0, x1, y1 of the glyphs (or of `some` of them) from each start to the next."""
        x, y, size, advance = (v if some is None else v[some] for v in (self.x, self.y, self.size, self.advance))
        return np.minimum.reduceat(x, starts), np.minimum.reduceat(y - ASCENT * size, starts), np.maximum.reduceat(x + advance, starts), np.maximum.reduceat(y + DESCENT * size, starts)

    def _columns_first(self, cuts: np.ndarray) -> None:
        starts = np.union1d(self.at[:-1], cuts)
        box = list(zip(*(v.tolist() for v in self.boxes(starts))))
        parts = [_Part(a, b, v, s) for a, b, v, s in zip(starts.tolist(), [*starts[1:].tolist(), len(self.codes)], box, np.maximum.reduceat(self.size, starts).tolist())]
        if (got := by_columns(parts)) is None:
            return
        spaced = self.spaced.copy()
        spaced[starts] = False
        order = np.concatenate([np.arange(p.a, p.b) for p in got])
        self._take(order, True)
        self.em, self.spaced, self.space = self.em[order], spaced[order], self.space[order]
        self.at = np.append(0, np.cumsum([p.b - p.a for p in got]))
        self.parts = np.ones(len(got), np.int64)
        self._boxes()

    def __len__(self) -> int:
        return len(self.at) - 1

    @property
    def text(self) -> str:
        """All characters in order."""
        return self.codes.tobytes().decode("utf-32-le", "surrogatepass") if self.moved else self.glyphs.text

    def baselines(self) -> np.ndarray:
        return self.y[self.at[:-1]]

    def understood(self) -> np.ndarray:
        """Glyphs before which a space is understood that isn't there."""
        out = self.spaced & ~self.space
        out[1:] &= ~self.space[:-1]
        return out

    def texts(self, starts: np.ndarray) -> list[str]:
        """Text from each start to the next, with understood spaces but before a start."""
        text, ends = self.text, [*starts[1:].tolist(), len(self.codes)]
        extra = self.understood()
        extra[starts] = False
        if not extra.any():
            return [text[a:b] for a, b in zip(starts.tolist(), ends)]
        where = np.flatnonzero(extra)
        first = np.searchsorted(where, starts).tolist()
        out = []
        for a, b, i, k in zip(starts.tolist(), ends, first, [*first[1:], len(where)]):
            cuts = [a, *where[i:k].tolist(), b]
            out.append(" ".join(text[p:q] for p, q in zip(cuts, cuts[1:])))
        return out

    def line_texts(self) -> list[str]:
        return self.texts(self.at[:-1]) if len(self) else []

    def blocks(self) -> np.ndarray:
        """The number of each line's block."""
        if not len(self):
            return np.zeros(0, np.int64)
        step = np.diff(self.baselines())
        em = np.maximum(np.maximum(self.most[1:], self.most[:-1]), 1.0)
        return np.append(0, ((step > BLOCK_GAP * em) | (-step > 0.5 * em)).cumsum())

    def words(self) -> tuple[tuple[np.ndarray, ...], pa.Array, np.ndarray]:
        """Boxes, texts and lines of all words."""
        ns = np.flatnonzero(~self.space)
        if not len(ns):
            return tuple(np.zeros(0) for _ in range(4)), pa.array([], pa.string()), np.zeros(0, np.int64)
        head = self.spaced.copy()
        head[self.at[:-1]] = True
        head[1:] |= self.space[:-1]
        starts = np.flatnonzero(head[ns])
        return self.boxes(starts, ns), strings(self.codes[ns], starts), np.searchsorted(self.at, ns[starts], "right") - 1

    def spans(self) -> np.ndarray:
        """Where stretches of one font and size within a line begin."""
        if not len(self):
            return np.zeros(0, np.int64)
        new = np.append(True, np.abs(np.diff(self.size)) > 0.1)
        if self.font is not None:
            keys = np.unique([t[3] for _, t in self.glyphs.tails], return_inverse=True)[1][self.font]
            new[1:] |= keys[1:] != keys[:-1]
        new[self.at[:-1]] = True
        return np.flatnonzero(new)

    def tail(self, i: int) -> tuple:
        """(dir_x, dir_y, wmode, font_key, font, flags) of glyph i."""
        return self.glyphs.tails[0 if self.font is None else self.font[i]][1]

    def sizes(self, a: int, b: int) -> dict[float, int]:
        """Glyphs by size in order of appearance from a to b."""
        part = self.size[a:b]
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b - a]
        out: dict[float, int] = {}
        for p, q in zip(cuts, cuts[1:]):
            s = float(part[p])
            out[s] = out.get(s, 0) + q - p
        return out

    def find(self, needle: str) -> tuple[np.ndarray, ...]:
        """Boxes of case-insensitive, non-overlapping hits within lines."""
        want, hits = needle.lower(), []
        extra = np.flatnonzero(self.understood()) if len(self) else None
        for i, line in enumerate(self.line_texts()):
            low, a = line.lower(), int(self.at[i])
            n, inner = int(self.at[i + 1]) - a, None
            if len(line) != n or len(low) != n or "Σ" in line:
                # The glyph of each character of the searched text; -1: an understood space.
                gone = set((extra[(extra > a) & (extra < a + n)] - a).tolist())
                hay, inner = [], []
                plain = "".join(map(chr, self.codes[a : a + n].tolist()))
                for k, c in enumerate(plain):
                    if k in gone:
                        hay.append(" ")
                        inner.append(-1)
                    hay.append(c.lower())
                    inner += [k] * len(hay[-1])
                low = "".join(hay)
            k = low.find(want)
            while k >= 0:
                end = k + len(want)
                own = [o for o in inner[k:end] if o >= 0] if inner is not None else (k, end - 1)
                if len(own):
                    hits.append((a + own[0], a + own[-1] + 1))
                k = low.find(want, end)
        if not hits:
            return tuple(np.zeros(0) for _ in range(4))
        ends = np.array(hits)
        if (ends[1:, 0] < ends[:-1, 1]).any():  # a glyph of several characters in two hits
            return tuple(np.concatenate(v) for v in zip(*(self.boxes(np.zeros(1, np.int64), np.arange(a, b)) for a, b in hits)))
        some = np.concatenate([np.arange(a, b) for a, b in hits]) if len(hits) < 4 else np.repeat(ends[:, 0] - np.append(0, (ends[:, 1] - ends[:, 0]).cumsum()[:-1]), ends[:, 1] - ends[:, 0]) + np.arange((ends[:, 1] - ends[:, 0]).sum())
        return self.boxes(np.append(0, (ends[:, 1] - ends[:, 0]).cumsum()[:-1]), some)
