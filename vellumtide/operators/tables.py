"""Tables of a page: grids of rules, and runs of aligned text rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from vellumtide import schema
from vellumtide.functions.checks import check_rect
from vellumtide.operators.layout import Line, _names, _per_page, cluster_lines, glyphs_of, segments, words_of
from vellumtide.sources.pagesource import PageSource

# Fixed values of the document model.
TABLE_SNAP_TOLERANCE = 1.0
MAX_TABLE_CELLS = 4096
MAX_TABLE_SPAN_CANDIDATES = 65_536
MIN_TEXT_TABLE_ROWS = 3
MAX_TEXT_TABLE_COLUMNS = 32
TEXT_TABLE_ALIGNMENT_TOLERANCE = 1.0
TEXT_TABLE_ROW_GAP = 2.5


def snap(values: list[float]) -> list[float]:
    """Clusters of nearby coordinates, as running means."""
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - sum(out[-1]) / len(out[-1]) <= TABLE_SNAP_TOLERANCE:
            out[-1].append(v)
        else:
            out.append([v])
    return [sum(c) / len(c) for c in out]


def _groups(rules: list[tuple]) -> list[list[tuple]]:
    """Rules connected by crossings of horizontal and vertical ones."""
    top = list(range(len(rules)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    tol = TABLE_SNAP_TOLERANCE
    flat = [i for i, r in enumerate(rules) if r[4]]
    tall = sorted((i for i, r in enumerate(rules) if not r[4]), key=lambda i: rules[i][0])
    for i in flat:
        x0, y, x1 = rules[i][0], rules[i][1], rules[i][2]
        for j in tall:
            v = rules[j]
            if v[0] > x1 + tol:
                break
            if v[0] >= x0 - tol and v[1] - tol <= y <= v[3] + tol:
                top[find(i)] = find(j)
    out: dict[int, list] = {}
    for i, r in enumerate(rules):
        out.setdefault(find(i), []).append(r)
    return list(out.values())


class _Edges:
    """Which stretches of a grid's lines are covered by rules."""

    def __init__(self, rules, xs, ys):
        tol = TABLE_SNAP_TOLERANCE
        self.flat = [self._cover([(r[0], r[2]) for r in rules if r[4] and abs(r[1] - y) <= tol], xs) for y in ys]
        self.tall = [self._cover([(r[1], r[3]) for r in rules if not r[4] and abs(r[0] - x) <= tol], ys) for x in xs]

    @staticmethod
    def _cover(parts, stops) -> list[bool]:
        merged: list[list[float]] = []
        for a, b in sorted(parts):
            if merged and a <= merged[-1][1] + TABLE_SNAP_TOLERANCE:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return [any(a - TABLE_SNAP_TOLERANCE <= p and q <= b + TABLE_SNAP_TOLERANCE for a, b in merged) for p, q in zip(stops, stops[1:])]

    def bounded(self, r0, r1, c0, c1) -> bool:
        return all(self.flat[r][c] for r in (r0, r1) for c in range(c0, c1)) and all(self.tall[c][r] for c in (c0, c1) for r in range(r0, r1))

    def divided(self, r0, r1, c0, c1) -> bool:
        """Whether some rule runs all the way through."""
        return any(all(self.flat[r][c0:c1]) for r in range(r0 + 1, r1)) or any(all(self.tall[c][r0:r1]) for c in range(c0 + 1, c1))


def tile(rules, xs, ys) -> list[tuple[int, int, int, int]] | None:
    """Cells (row, row end, column, column end) that fill the grid, merged ones included; None where they can't."""
    edges, rows, cols = _Edges(rules, xs, ys), len(ys) - 1, len(xs) - 1
    if rows * cols > MAX_TABLE_CELLS:
        return None
    used, out, tries = set(), [], 0
    for r in range(rows):
        for c in range(cols):
            if (r, c) in used:
                continue
            best = (r, r + 1, c, c + 1) if edges.bounded(r, r + 1, c, c + 1) else None
            if best is None:
                area = None
                for r1 in range(r + 1, rows + 1):
                    for c1 in range(c + 1, cols + 1):
                        tries += 1
                        if tries > MAX_TABLE_SPAN_CANDIDATES:
                            return None
                        a = (r1 - r) * (c1 - c)  # slots, whatever their size
                        if (area is None or a < area) and not any((i, j) in used for i in range(r, r1) for j in range(c, c1)) and edges.bounded(r, r1, c, c1) and not edges.divided(r, r1, c, c1):
                            best, area = (r, r1, c, c1), a
                if best is None:
                    return None
            out.append(best)
            used |= {(i, j) for i in range(best[0], best[1]) for j in range(best[2], best[3])}
    return out


def _placed(glyphs) -> list[list[tuple[float, float, str]]]:
    """Centre and text of every word, by physical line."""
    return [[((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, t) for b, t in words_of(x)] for x in cluster_lines(glyphs)] if glyphs else []


def _cell_text(placed, box) -> str:
    x0, y0, x1, y1 = box[0] - TABLE_SNAP_TOLERANCE, box[1] - TABLE_SNAP_TOLERANCE, box[2] + TABLE_SNAP_TOLERANCE, box[3] + TABLE_SNAP_TOLERANCE
    inside = (" ".join(t for x, y, t in line if x0 <= x <= x1 and y0 <= y <= y1) for line in placed)
    return "\n".join(t for t in inside if t)


class Found(Sequence):
    """Tables of one page on the driver, as `find` gives them: length, index, slice, iteration, and all their cells."""

    def __init__(self, tables_: list[dict]):
        self._tables = tuple(tables_)

    def __len__(self) -> int:
        return len(self._tables)

    def __getitem__(self, at):
        return Found(self._tables[at]) if isinstance(at, slice) else self._tables[at]

    @property
    def cells(self) -> list[tuple]:
        return [c for t in self._tables for c in t["cells"]]

    def __repr__(self) -> str:
        return f"Found({len(self)} tables)"


def grid_tables(glyphs, rules) -> list[dict]:
    out, placed = [], _placed(glyphs)
    for group in _groups(rules):
        xs, ys = snap([r[0] for r in group if not r[4]]), snap([r[1] for r in group if r[4]])
        if len(xs) < 3 or len(ys) < 3 or (cells := tile(group, xs, ys)) is None:
            continue
        slots = [(r, c, None, None) for r in range(len(ys) - 1) for c in range(len(xs) - 1)]
        for r, r1, c, c1 in cells:
            box = (xs[c], ys[r], xs[c1], ys[r1])
            slots[r * (len(xs) - 1) + c] = (r, c, box, _cell_text(placed, box))
        out.append({"box": (xs[0], ys[0], xs[-1], ys[-1]), "rows": len(ys) - 1, "cols": len(xs) - 1, "cells": slots, "strategy": "lines", "confidence": 1.0, "quality": (None, None, None)})
    return sorted(out, key=lambda t: (t["box"][1], t["box"][0]))


def _fits(first: list[Line], prev: list[Line], cur: list[Line]) -> bool:
    em = max(g.em for row in (prev, cur) for s in row for g in s.glyphs)
    gap = min(s.box[1] for s in cur) - max(s.box[3] for s in prev)
    if len(cur) != len(first) or len(cur) != len(prev) or not -0.5 * em <= gap <= TEXT_TABLE_ROW_GAP * em:
        return False
    tol = TEXT_TABLE_ALIGNMENT_TOLERANCE * em
    return all(abs(a.box[0] - b.box[0]) <= tol or abs(a.box[2] - b.box[2]) <= tol for a, b in zip(first, cur))


def _text_table(run: list[list[Line]]) -> dict | None:
    n = len(run[0])
    ends = [max(row[c].box[2] for row in run) for c in range(n)]
    starts = [min(row[c].box[0] for row in run) for c in range(n)]
    gutters = [starts[c + 1] - ends[c] for c in range(n - 1)]
    if any(g < 0 for g in gutters):
        return None
    em = max(g.em for row in run for s in row for g in s.glyphs)
    tops, bottoms = [min(s.box[1] for s in row) for row in run], [max(s.box[3] for s in row) for row in run]
    xs = [starts[0], *[(ends[c] + starts[c + 1]) / 2 for c in range(n - 1)], ends[-1]]
    ys = [tops[0], *[(bottoms[r] + tops[r + 1]) / 2 for r in range(len(run) - 1)], bottoms[-1]]
    error = max(min(abs(a.box[0] - b.box[0]), abs(a.box[2] - b.box[2])) for row in run for a, b in zip(run[0], row)) / em
    gaps = [tops[r + 1] - bottoms[r] for r in range(len(run) - 1)]
    vary, gutter = (max(gaps) - min(gaps)) / em, min(gutters) / em
    unit = lambda v: min(max(v, 0.0), 1.0)
    confidence = unit(0.65 + 0.10 * unit((len(run) - MIN_TEXT_TABLE_ROWS + 1) / 3) + 0.10 * unit(1 - error / TEXT_TABLE_ALIGNMENT_TOLERANCE) + 0.10 * unit(1 - vary / TEXT_TABLE_ROW_GAP) + 0.05 * unit(gutter / 4.0))
    cells = [(r, c, (xs[c], ys[r], xs[c + 1], ys[r + 1]), " ".join(t for _, t in words_of(s))) for r, row in enumerate(run) for c, s in enumerate(row)]
    return {"box": (xs[0], ys[0], xs[-1], ys[-1]), "rows": len(run), "cols": n, "cells": cells, "strategy": "text", "confidence": confidence, "quality": (error, gutter, vary)}


def text_tables(glyphs) -> list[dict]:
    out, run = [], []

    def close():
        if len(run) >= MIN_TEXT_TABLE_ROWS and (t := _text_table(run)):
            out.append(t)
        run.clear()

    for line in cluster_lines(glyphs) if glyphs else []:
        row = segments(line)
        if line.vertical or not 2 <= len(row) <= MAX_TEXT_TABLE_COLUMNS:
            close()
            continue
        if run and not _fits(run[0], run[-1], row):
            close()
        run.append(row)
    close()
    return sorted(out, key=lambda t: (t["box"][1], t["box"][0]))


def find(glyphs, rules, strategy: str = "lines", clip=None) -> list[dict]:
    if strategy not in ("lines", "text"):
        raise ValueError(f"no such table strategy: {strategy}")
    clip = None if clip is None else check_rect(clip)
    got = grid_tables(glyphs, rules) if strategy == "lines" else text_tables(glyphs)
    tol = TABLE_SNAP_TOLERANCE
    inside = lambda b: clip is None or b[0] >= clip[0] - tol and b[1] >= clip[1] - tol and b[2] <= clip[2] + tol and b[3] <= clip[3] + tol
    return [t for t in got if inside(t["box"])]


def extract(table: dict) -> list[list[str | None]]:
    rows: list[list] = [[None] * table["cols"] for _ in range(table["rows"])]
    for r, c, _, text in table["cells"]:
        rows[r][c] = text
    return rows


def to_markdown(rows: list[list[str | None]], fill_empty: bool = False) -> str:
    """A Markdown table of the rows, the first one its head. fill_empty: continuations take the value above, else the one to the left, in scan order."""
    rows = [list(r) for r in rows]
    if fill_empty:
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                if v is None:
                    row[c] = rows[r - 1][c] if r and rows[r - 1][c] is not None else row[c - 1] if c else None
    cell = lambda v: (v or "").replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>")
    out = ["| " + " | ".join(map(cell, row)) + " |" for row in rows]
    return "\n".join([*out[:1], "| " + " | ".join(["---"] * len(rows[0])) + " |", *out[1:]]) if rows else ""


def _of_row(row, strategy, clip):
    rules = [(r["x0"], r["y0"], r["x1"], r["y1"], r["horizontal"]) for r in (row["rules"] if row["rules"] is not None else [])]
    return find(glyphs_of(row["glyphs"]), rules, strategy, clip)


def tables(pages: PageSource | DataFrame, strategy: str = "lines", clip=None) -> DataFrame:
    find([], [], strategy, clip)

    def make(row):
        for n, t in enumerate(_of_row(row, strategy, clip)):
            yield (n, *t["box"], t["rows"], t["cols"], t["strategy"], t["confidence"], *t["quality"])

    return _per_page(pages, make, schema.TABLE, _names(schema.TABLE))


def cells(pages: PageSource | DataFrame, strategy: str = "lines", clip=None) -> DataFrame:
    """Row-major cells; slots that a merged cell covers have neither box nor text."""
    find([], [], strategy, clip)

    def make(row):
        for n, t in enumerate(_of_row(row, strategy, clip)):
            for r, c, box, text in t["cells"]:
                yield (n, r, c, *(box or (None,) * 4), text)

    return _per_page(pages, make, schema.CELL, _names(schema.CELL))


def markdown_tables(pages: PageSource | DataFrame, strategy: str = "lines", fill_empty: bool = False) -> DataFrame:
    def make(row):
        for n, t in enumerate(_of_row(row, strategy, None)):
            yield n, to_markdown(extract(t), fill_empty)

    return _per_page(pages, make, "table_no long, markdown string", ["table_no", "markdown"])


__all__ = ["Found", "cells", "extract", "find", "grid_tables", "markdown_tables", "snap", "tables", "text_tables", "tile", "to_markdown"]
