"""Layout of a page's glyphs: lines, reading order, segments, words, spans, blocks, text and search hits.

Ordered greedy passes look at what the pass has built so far, so they run as plain loops over one page's arrays, in one Python pass with the making of the pages: no shuffle, and memory of
one page. All operators take a `PageSource` or a DataFrame of page rows (doc_id, pno, width, height, glyphs, rules, ...).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from vellumtide import schema
from vellumtide.sources.glyphs import Glyphs
from vellumtide.sources.pagesource import PageSource

# Fixed values of the document model.
LINE_TOLERANCE = 0.5
VERTICAL_LINE_TOLERANCE = 0.35
MIN_VERTICAL_CJK_GLYPHS = 3
MAX_VERTICAL_CJK_CANDIDATES = 4096
WORD_GAP = 0.15
#: Steps of stacked glyphs, and of glyphs in a row, in sizes.
STACK_STEP, ROW_STEP = (0.35, 1.35), (0.2, 1.8)
BLOCK_GAP = 1.5
LINE_SEGMENT_GAP = 2.0
COLUMN_GUTTER = 1.5
MAX_COLUMN_LINE_WIDTH_RATIO = 0.75
MIN_COLUMN_LINES = 2
MIN_COLUMN_VERTICAL_OVERLAP = 0.25
ASCENT = 0.8
DESCENT = 0.2
#: Blocks of CJK characters, for vertical inference.
CJK = re.compile("[\u2e80-\u2fff\u3000-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef\U00020000-\U0003134f]")


@dataclass(slots=True)
class Glyph:
    text: str
    x: float
    y: float
    size: float
    advance: float
    dx: float
    dy: float
    wmode: int
    font_key: str
    font: str
    flags: int
    seq: int = 0
    #: The size, at least 1; whether the baseline runs more down than across.
    em: float = 0.0
    tilted: bool = False
    #: Set as if across, found to run down: boxes stay those of the horizontal mode.
    inferred: bool = False

    def __post_init__(self):
        self.em = self.size if self.size > 1.0 else 1.0
        self.tilted = abs(self.dy) > abs(self.dx)

    def box(self) -> tuple[float, float, float, float]:
        if self.wmode == 1 and not self.inferred:
            return self.x - self.size / 2, self.y, self.x + self.size / 2, self.y + self.advance
        if self.inferred or self.dx == 1.0 and self.dy == 0.0:
            return self.x, self.y - ASCENT * self.size, self.x + self.advance, self.y + DESCENT * self.size
        ends = ((self.x, self.y), (self.x + self.dx * self.advance, self.y + self.dy * self.advance))
        pts = [(px + k * self.dy * self.size, py - k * self.dx * self.size) for px, py in ends for k in (ASCENT, -DESCENT)]
        return min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts)


def glyphs_of(columns) -> list[Glyph]:
    """Glyph objects of a page row's `glyphs` struct."""
    if columns is None:
        return []
    c = columns.lists() if isinstance(columns, Glyphs) else columns
    return [Glyph(*row, seq=i) for i, row in enumerate(zip(c["text"], c["x"], c["y"], c["size"], c["advance"], c["dir_x"], c["dir_y"], c["wmode"], c["font_key"], c["font"], c["flags"], strict=True))]


def union_box(glyphs: list[Glyph]) -> tuple[float, float, float, float]:
    if all(g.dx == 1.0 and g.wmode == 0 for g in glyphs):
        top, bottom = min(g.y - ASCENT * g.size for g in glyphs), max(g.y + DESCENT * g.size for g in glyphs)
        return min(g.x for g in glyphs), top, max(g.x + g.advance for g in glyphs), bottom
    boxes = [g.box() for g in glyphs]
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


@dataclass(slots=True)
class Line:
    glyphs: list[Glyph]
    vertical: bool = False
    _box: tuple | None = field(default=None)

    @property
    def box(self):
        if self._box is None:
            self._box = union_box(self.glyphs)
        return self._box

    @property
    def baseline(self) -> float:
        return self.glyphs[0].y

    @property
    def size(self) -> float:
        return max(g.size for g in self.glyphs)


def gap_before(prev: Glyph, cur: Glyph) -> float:
    """From the end of prev to cur, along prev's baseline."""
    if prev.dx == 1.0:
        return cur.x - prev.x - prev.advance
    return (cur.x - prev.x) * prev.dx + (cur.y - prev.y) * prev.dy - prev.advance


def spaced(prev: Glyph, cur: Glyph) -> bool:
    """Whether a space is understood between two glyphs."""
    return cur.wmode != 1 and prev.wmode != 1 and gap_before(prev, cur) > WORD_GAP * cur.em


def _is_cjk(text: str) -> bool:
    if text < "⺀":
        return False
    shown = [c for c in text if not c.isspace()]
    return bool(shown) and all(CJK.match(c) for c in shown)


def stand_alone(x: np.ndarray, y: np.ndarray, em: np.ndarray, font: np.ndarray) -> np.ndarray:
    """Which CJK glyphs have a neighbour of their font above or below and none beside them."""
    alone = np.zeros(len(x), bool)
    for a in range(0, len(x), 256):  # a slab of the distance matrix at a time
        part = slice(a, a + 256)
        scale = np.maximum(em[part, None], em[None])
        across, down = np.abs(x[part, None] - x[None]) / scale, np.abs(y[part, None] - y[None]) / scale
        same = font[part, None] == font[None]
        stacked = (same & (across <= VERTICAL_LINE_TOLERANCE) & (down >= STACK_STEP[0]) & (down <= STACK_STEP[1])).any(1)
        beside = (same & (down <= LINE_TOLERANCE) & (across >= ROW_STEP[0]) & (across <= ROW_STEP[1])).any(1)
        alone[part] = stacked & ~beside
    return alone


def _vertical_runs(glyphs: list[Glyph]) -> list[list[Glyph]]:
    """Columns of horizontal-mode CJK glyphs that are set one below another. Such a glyph has a neighbour of its font above or below and none beside it; a column's
    steps are even. Distances count in the larger of both sizes."""
    some = sorted((g for g in glyphs if _is_cjk(g.text)), key=lambda g: (g.x, g.font_key, g.y, g.seq))
    if not MIN_VERTICAL_CJK_GLYPHS <= len(some) <= MAX_VERTICAL_CJK_CANDIDATES:
        return []
    x, y, em = (np.array([getattr(g, k) for g in some]) for k in ("x", "y", "em"))
    font = np.unique([g.font_key for g in some], return_inverse=True)[1]
    alone = stand_alone(x, y, em, font)
    columns: dict[str, list[list[Glyph]]] = {}
    found: list[list[Glyph]] = []
    for i in np.flatnonzero(alone):
        g = some[i]
        mine = columns.setdefault(g.font_key, [])
        home = next((c for c in mine if abs(c[0].x - g.x) <= VERTICAL_LINE_TOLERANCE * max(c[0].em, g.em)), None)
        if home is None:
            home = []
            mine.append(home)
            found.append(home)
        home.append(g)
    out = []
    for c in found:
        c.sort(key=lambda g: (g.y, g.seq))
        if len(c) >= MIN_VERTICAL_CJK_GLYPHS and all(STACK_STEP[0] <= (q.y - p.y) / max(p.em, q.em) <= STACK_STEP[1] for p, q in zip(c, c[1:])):
            for g in c:
                g.dx, g.dy, g.wmode, g.inferred = 0.0, 1.0, 1, True
            out.append(c)
    return out


def cluster_lines(glyphs: list[Glyph]) -> list[Line]:
    """Lines: horizontal ones by baseline, then columns of CJK glyphs, then explicitly vertical ones."""
    upright = [g for g in glyphs if not g.tilted]
    tilted = [g for g in glyphs if g.tilted]
    runs = _vertical_runs(upright)
    taken = {g.seq for r in runs for g in r}
    lines, current, base = [], [], 0.0
    for g in sorted((g for g in upright if g.seq not in taken), key=lambda g: (g.y, g.x, g.seq)):
        if current and abs(g.y - base) > LINE_TOLERANCE * g.em:
            lines.append(current)
            current = []
        if not current:
            base = g.y
        current.append(g)
    if current:
        lines.append(current)
    out = [Line(sorted(part, key=lambda g: (g.x, g.seq))) for part in lines]
    out += [Line(r, True) for r in runs]
    columns: list[list[Glyph]] = []
    for g in sorted(tilted, key=lambda g: (-g.x if g.wmode else g.x, g.seq)):
        home = next((c for c in columns if abs(c[0].x - g.x) <= VERTICAL_LINE_TOLERANCE * g.em and c[0].dx * g.dx + c[0].dy * g.dy > 0.9), None)
        if home is None:
            columns.append([g])
        else:
            home.append(g)
    for c in columns:
        lead = c[0]
        out.append(Line(sorted(c, key=lambda g: (g.x * lead.dx + g.y * lead.dy, g.seq)), True))
    return out


def segments(line: Line) -> list[Line]:
    """Parts of a line between wide gaps."""
    if line.vertical:
        return [line]
    glyphs = line.glyphs
    cuts = [i for i, (prev, cur) in enumerate(zip(glyphs, glyphs[1:]), 1) if gap_before(prev, cur) > LINE_SEGMENT_GAP * max(prev.em, cur.em)]
    return [Line(glyphs[a:b]) for a, b in zip([0, *cuts], [*cuts, len(glyphs)])] if cuts else [line]


def _boundary(parts: list[Line]) -> float | None:
    """The middle of the widest gutter between the x ranges of lines that don't span the page."""
    left, right = min(p.box[0] for p in parts), max(p.box[2] for p in parts)
    narrow = sorted((p.box[0], p.box[2]) for p in parts if p.box[2] - p.box[0] <= MAX_COLUMN_LINE_WIDTH_RATIO * (right - left))
    if not narrow:
        return None
    sizes = sorted(p.size for p in parts)
    typical = sizes[len(sizes) // 2] if sizes else 12.0
    best, reach = None, narrow[0][1]
    for a, b in narrow[1:]:
        gap = a - reach
        if gap >= max(COLUMN_GUTTER * typical, 12.0) and (best is None or gap >= best[0]):
            best = (gap, (a + reach) / 2)
        reach = max(reach, b)
    return best[1] if best else None


def by_columns(parts: list[Line]) -> list[Line] | None:
    """Segments in column order, or None where no gutter parts them."""
    if len(parts) < 2 * MIN_COLUMN_LINES or (mid := _boundary(parts)) is None:
        return None
    left = [p for p in parts if p.box[2] <= mid]
    right = [p for p in parts if p.box[0] >= mid]
    across = [p for p in parts if p.box[0] < mid < p.box[2]]
    if min(len(left), len(right)) < MIN_COLUMN_LINES:
        return None
    (lt, lb), (rt, rb) = ((min(p.box[1] for p in s), max(p.box[3] for p in s)) for s in (left, right))
    shorter = min(lb - lt, rb - rt)
    if shorter <= 0 or (min(lb, rb) - max(lt, rt)) / shorter < MIN_COLUMN_VERTICAL_OVERLAP:
        return None
    centre = lambda p: (p.box[1] + p.box[3]) / 2
    sides = [centre(p) for p in left + right]
    top, bottom = [p for p in across if centre(p) <= min(sides)], [p for p in across if centre(p) >= max(sides)]
    if len(top) + len(bottom) < len(across):
        return parts
    return top + (by_columns(left) or left) + (by_columns(right) or right) + bottom


def _vertical_order(lines: list[Line]) -> list[Line]:
    """What stands above the columns, the columns from right to left, what stands between, what stands below."""
    columns = [x for x in lines if x.vertical]
    top, bottom = min(c.box[1] for c in columns), max(c.box[3] for c in columns)
    flat = [x for x in lines if not x.vertical]
    mid = lambda x: (x.box[1] + x.box[3]) / 2
    return [x for x in flat if mid(x) < top] + sorted(columns, key=lambda c: -(c.box[0] + c.box[2])) + [x for x in flat if top <= mid(x) <= bottom] + [x for x in flat if mid(x) > bottom]


def reading_order(lines: list[Line]) -> list[Line]:
    if any(x.vertical for x in lines):
        return _vertical_order(lines)
    parts = [segments(x) for x in lines]
    if sum(len(p) > 1 for p in parts) < 2:
        return lines
    return by_columns([s for p in parts for s in p]) or lines


def page_lines(columns) -> list[Line]:
    glyphs = glyphs_of(columns)
    return reading_order(cluster_lines(glyphs)) if glyphs else []


def line_text(line: Line) -> str:
    out, prev = [], None
    for g in line.glyphs:
        if prev is not None and spaced(prev, g) and not prev.text.isspace() and not g.text.isspace():
            out.append(" ")
        out.append(g.text)
        prev = g
    return "".join(out)


def words_of(line: Line) -> list[tuple[tuple, str]]:
    out, word = [], []
    for g in line.glyphs:
        if g.text.isspace():
            if word:
                out.append(word)
            word = []
            continue
        if word and spaced(word[-1], g):
            out.append(word)
            word = []
        word.append(g)
    if word:
        out.append(word)
    return [(union_box(w), "".join(g.text for g in w)) for w in out]


def spans_of(line: Line) -> list[tuple[Glyph, tuple, str]]:
    """First glyph, box and text of stretches of one font and size; no space is understood where a span begins."""
    parts: list[list[Glyph]] = []
    for g in line.glyphs:
        if not parts or parts[-1][-1].font_key != g.font_key or abs(parts[-1][-1].size - g.size) > 0.1:
            parts.append([])
        parts[-1].append(g)
    return [(p[0], union_box(p), line_text(Line(p))) for p in parts]


def blocks_of(lines: list[Line]) -> list[list[Line]]:
    out: list[list[Line]] = []
    for x in lines:
        if out:
            prev = out[-1][-1]
            step, em = x.baseline - prev.baseline, max(prev.size, x.size, 1.0)
        if not out or x.vertical or x.vertical != prev.vertical or step > BLOCK_GAP * em or -step > 0.5 * em:
            out.append([])
        out[-1].append(x)
    return out


def find_text(lines: list[Line], needle: str) -> list[tuple[float, float, float, float]]:
    """Boxes of case-insensitive, non-overlapping hits within lines. Understood spaces can be searched for but have no box."""
    if not needle:
        raise ValueError("the text to search for is empty")
    want, out = needle.lower(), []
    for line in lines:
        hay, owner, prev = [], [], None
        for i, g in enumerate(line.glyphs):
            if prev is not None and spaced(prev, g) and not prev.text.isspace() and not g.text.isspace():
                hay.append(" ")
                owner.append(None)
            low = g.text.lower()
            hay.append(low)
            owner += [i] * len(low)
            prev = g
        text, at = "".join(hay), 0
        while (k := text.find(want, at)) >= 0:
            at = k + len(want)
            hit = [o for o in owner[k:at] if o is not None]
            if hit:
                out.append(union_box(line.glyphs[hit[0] : hit[-1] + 1]))
    return out


# --- operators on page rows ----------------------------------------------------------------------------------------


def _per_page(pages: PageSource | DataFrame, make, columns: str, names: list[str]) -> DataFrame:
    return PageSource.of(pages).per_page(make, columns, names)


def _by_page(pages: PageSource | DataFrame, flat: Callable, plain: Callable, columns: str) -> DataFrame:
    """flat(page) gives columns for a flat page; plain(glyphs) tuples for any other."""
    from vellumtide.operators.flat import FlatPage

    def make(row):
        page = FlatPage.of(row["glyphs"])
        return flat(page) if page is not None else list(zip(*plain(row["glyphs"]))) or None

    return PageSource.of(pages).per_page_columns(make, columns)


def _names(columns: str) -> list[str]:
    return [c.split()[0].rstrip(":") for c in columns.split(", ")]


def _places(page) -> tuple[np.ndarray, np.ndarray]:
    """Block of every line of a flat page, and the line's number in it."""
    block = page.blocks()
    return block, np.arange(len(block)) - np.searchsorted(block, block)


def words(pages: PageSource | DataFrame) -> DataFrame:
    def flat(page):
        box, text, line = page.words()
        block, n = _places(page)
        return *box, text, block[line], n[line], np.arange(len(line)) - np.searchsorted(line, line)

    def plain(glyphs):
        for b, block in enumerate(blocks_of(page_lines(glyphs))):
            for n, line in enumerate(block):
                for w, (box, text) in enumerate(words_of(line)):
                    yield (*box, text, b, n, w)

    return _by_page(pages, flat, plain, schema.WORD)


def blocks(pages: PageSource | DataFrame) -> DataFrame:
    def flat(page):
        block = page.blocks()
        if not len(block):
            return None
        first = np.flatnonzero(np.append(True, np.diff(block) > 0))
        rows = [" ".join(x.split()) for x in page.line_texts()]
        text = ["\n".join(rows[a:b]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(rows)])]
        return *page.boxes(page.at[first]), text, np.arange(len(first)), np.zeros(len(first), np.int32)

    def plain(glyphs):
        for b, block in enumerate(blocks_of(page_lines(glyphs))):
            boxes = [x.box for x in block]
            text = "\n".join(" ".join(t for _, t in words_of(x)) for x in block)
            yield min(v[0] for v in boxes), min(v[1] for v in boxes), max(v[2] for v in boxes), max(v[3] for v in boxes), text, b, 0

    return _by_page(pages, flat, plain, schema.BLOCK)


def spans(pages: PageSource | DataFrame) -> DataFrame:
    def flat(page):
        starts = page.spans()
        if not len(starts):
            return None
        line = np.searchsorted(page.at, starts, "right") - 1
        block, n = _places(page)
        tails = [page.tail(i) for i in starts.tolist()]
        font, flags = [t[4] for t in tails], [t[5] for t in tails]
        number = np.arange(len(line)) - np.searchsorted(line, line)
        none = np.zeros(len(line))
        return block[line], n[line], number, *page.boxes(starts), page.x[starts], page.y[starts], page.size[starts], font, flags, page.texts(starts), none + 1, none, none.astype(np.int32)

    def plain(glyphs):
        for b, block in enumerate(blocks_of(page_lines(glyphs))):
            for n, line in enumerate(block):
                for k, (g, box, text) in enumerate(spans_of(line)):
                    yield (b, n, k, *box, g.x, g.y, g.size, g.font, g.flags, text, g.dx, g.dy, g.wmode)

    return _by_page(pages, flat, plain, schema.SPAN)


def page_text(pages: PageSource | DataFrame) -> DataFrame:
    whole = lambda texts: "".join(x.rstrip(" ") + "\n" for x in texts)
    return _by_page(pages, lambda page: ([whole(page.line_texts())],), lambda glyphs: [(whole(map(line_text, page_lines(glyphs))),)], "text string")


def lines(pages: PageSource | DataFrame) -> DataFrame:
    cols = "line_no long, x0 double, y0 double, x1 double, y1 double, vertical boolean, segments int, text string"

    def flat(page):
        if not len(page):
            return None
        return np.arange(len(page)), *page.box, np.zeros(len(page), bool), page.parts.astype(np.int32), [x.rstrip(" ") for x in page.line_texts()]

    def plain(glyphs):
        for n, x in enumerate(page_lines(glyphs)):
            yield (n, *x.box, x.vertical, len(segments(x)), line_text(x).rstrip(" "))

    return _by_page(pages, flat, plain, cols)


def search(pages: PageSource | DataFrame, needle: str) -> DataFrame:
    find_text([], needle)

    def flat(page):
        box = page.find(needle)
        return np.arange(len(box[0])), *box

    def plain(glyphs):
        for n, box in enumerate(find_text(page_lines(glyphs), needle)):
            yield (n, *box)

    return _by_page(pages, flat, plain, schema.HIT)


def line_segments(pages: PageSource | DataFrame) -> DataFrame:
    """Physical lines, before reading order: their number of segments and right edge."""

    def flat(page):
        if not len(page):
            return None
        at, parts, right, y = page.physical
        return np.arange(len(at)), parts.astype(np.int32), right, y

    def plain(glyphs):
        glyphs = glyphs_of(glyphs)
        for n, x in enumerate(cluster_lines(glyphs) if glyphs else []):
            yield n, len(segments(x)), x.box[2], x.baseline

    return _by_page(pages, flat, plain, "line_no long, segments int, x1 double, y double")
