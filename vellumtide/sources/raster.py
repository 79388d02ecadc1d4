"""Rendering: pages to RGBA pixels, PNG and SVG. Fills, strokes and images are drawn; text is drawn as boxes of its glyphs' extent in the raster and as text in SVG."""

from __future__ import annotations

import math
from html import escape

import numpy as np
from pyspark.sql import DataFrame

from vellumtide.errors import PdfFault
from vellumtide.functions.geometry import MAX_RENDER_PIXELS, MAX_RENDER_SIDE
from vellumtide.sources.filesource import FileSource
from vellumtide.sources.glyphs import blank
from vellumtide.sources.pdfobjects import Pdf
from vellumtide.sources.pdfpage import Page, png

PNG_FAST = 1


def check_size(width: float, height: float, scale: float) -> tuple[int, int]:
    if not scale > 0 or not math.isfinite(scale):
        raise ValueError("the scale must be above 0")
    w, h = math.floor(width * scale), math.floor(height * scale)
    if not (1 <= w <= MAX_RENDER_SIDE and 1 <= h <= MAX_RENDER_SIDE and w * h <= MAX_RENDER_PIXELS):
        raise ValueError(f"{w} by {h} pixels are out of range")
    return w, h


def scale_of(scale: float | None, dpi: float | None) -> float:
    if scale is not None and dpi is not None:
        raise ValueError("either scale or dpi")
    return dpi / 72 if dpi is not None else 1.0 if scale is None else scale


def _fill(img: np.ndarray, points, color) -> None:
    """An even-odd polygon fill over pixel centres."""
    h, w = img.shape[:2]
    ys = [p[1] for p in points]
    for y in range(max(0, math.ceil(min(ys) - 0.5)), min(h, math.floor(max(ys) - 0.5) + 1)):
        cuts = []
        for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[0]]):
            if (y0 <= y + 0.5) != (y1 <= y + 0.5):
                cuts.append(x0 + (y + 0.5 - y0) * (x1 - x0) / (y1 - y0))
        cuts.sort()
        for a, b in zip(cuts[::2], cuts[1::2]):
            img[y, max(0, math.ceil(a - 0.5)) : max(0, min(w, math.ceil(b - 0.5)))] = color


def _boxes(img: np.ndarray, boxes: tuple[np.ndarray, ...], scale: float) -> None:
    """Black boxes over all pixel centres that one of them holds: corners count up and down, running sums tell what is inside."""
    if not len(boxes[0]):
        return
    h, w = img.shape[:2]
    x0, y0, x1, y1 = (np.ceil(v * scale - 0.5).clip(0, most).astype(np.int64) for v, most in zip(boxes, (w, h, w, h)))
    edge = np.zeros((h + 1) * (w + 1), np.int64)
    for y, x, by in ((y0, x0, 1), (y1, x1, 1), (y0, x1, -1), (y1, x0, -1)):
        edge += by * np.bincount(y * (w + 1) + x, minlength=len(edge))
    img[edge.reshape(h + 1, w + 1).cumsum(0).cumsum(1)[:h, :w] > 0] = (0, 0, 0, 255)


def _image(img: np.ndarray, corners, pixels) -> None:
    iw, ih, data, n = pixels
    src = np.frombuffer(data, np.uint8).reshape(ih, iw, n)
    src = np.repeat(src, 3, 2) if n == 1 else src
    (ox, oy), (ux, uy), (vx, vy), _ = corners
    a, b, c, d = ux - ox, vx - ox, uy - oy, vy - oy
    det = a * d - b * c
    if not det:
        return
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    x0, x1 = max(0, math.floor(min(xs))), min(img.shape[1], math.ceil(max(xs)))
    y0, y1 = max(0, math.floor(min(ys))), min(img.shape[0], math.ceil(max(ys)))
    if x0 >= x1 or y0 >= y1:
        return
    gx, gy = np.meshgrid(np.arange(x0, x1) + 0.5 - ox, np.arange(y0, y1) + 0.5 - oy)
    u, v = (d * gx - b * gy) / det, (a * gy - c * gx) / det
    ok = (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
    part = img[y0:y1, x0:x1]
    part[ok, :3] = src[((1 - v[ok]) * ih).astype(int).clip(0, ih - 1), (u[ok] * iw).astype(int).clip(0, iw - 1)]
    part[ok, 3] = 255


def pixmap(page: Page, scale: float = 1.0, background=(255, 255, 255, 255), clip=None) -> np.ndarray:
    """Straight-alpha RGBA rows. A clip crops the whole page's image, outward to whole pixels."""
    w, h = check_size(page.frame.width, page.frame.height, scale)
    bg = tuple(background) + (255,) * (4 - len(background))
    if len(bg) != 4 or any(not 0 <= v <= 255 for v in bg):
        raise ValueError("a background is three or four numbers from 0 to 255")
    img = np.empty((h, w, 4), np.uint8)
    img[:] = bg
    for kind, what, how, width in page.fills:
        pts = [(x * scale, y * scale) for x, y in what]
        if kind == "image":
            _image(img, pts, how)
            continue
        color = [round(255 * c) for c in how] + [255]
        if kind == "fill":
            _fill(img, pts, color)
        else:
            half = max(width * scale, 1.0) / 2
            for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
                n = math.hypot(x1 - x0, y1 - y0) or 1.0
                nx, ny = -(y1 - y0) / n * half, (x1 - x0) / n * half
                _fill(img, [(x0 + nx, y0 + ny), (x1 + nx, y1 + ny), (x1 - nx, y1 - ny), (x0 - nx, y0 - ny)], color)
    g = page.columns()
    shown = np.array([not t.isspace() for t in g.text], bool) if not isinstance(g.text, str) else ~blank(g.text)
    x, y, size, advance = (v[shown] for v in (g.x, g.y, g.size, g.advance))
    _boxes(img, (x, y - 0.5 * size, x + 0.8 * advance, y), scale)
    if clip is not None:
        x0, y0 = max(0, math.floor(clip[0] * scale)), max(0, math.floor(clip[1] * scale))
        x1, y1 = min(w, math.ceil(clip[2] * scale)), min(h, math.ceil(clip[3] * scale))
        if x0 >= x1 or y0 >= y1:
            raise ValueError("the clip lies outside the page")
        img = img[y0:y1, x0:x1]
    return img


def svg(page: Page) -> str:
    f = page.frame
    hex_ = lambda c: "#" + "".join(f"{round(255 * v):02x}" for v in c)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{f.width:g}" height="{f.height:g}" viewBox="0 0 {f.width:g} {f.height:g}">']
    for kind, pts, how, width in page.fills:
        if kind == "image":
            continue
        path = "M" + " L".join(f"{x:g} {y:g}" for x, y in pts)
        out.append(f'<path d="{path}" ' + (f'fill="{hex_(how)}"/>' if kind == "fill" else f'fill="none" stroke="{hex_(how)}" stroke-width="{width:g}"/>'))
    for text, x, y, size, *_ in page.glyphs:
        if not text.isspace():
            out.append(f'<text x="{x:g}" y="{y:g}" font-size="{size:g}">{escape(text)}</text>')
    return "\n".join([*out, "</svg>"])


def _drawn(content: FileSource | DataFrame, scale, dpi, background, clip, workers: int, pages: list[int] | None, names: list[str], columns: str, make) -> DataFrame:
    """doc_id, ord, pno, `names` and error of the pages asked for, in that order and as often (None: all). make(RGBA pixels) gives a tuple of `names`."""
    if not isinstance(workers, int) or isinstance(workers, bool):
        raise TypeError("workers is a whole number")
    if not 1 <= workers <= 64:
        raise ValueError("from 1 to 64 workers")
    s, blank = scale_of(scale, dpi), (None,) * len(names)

    def of_document(data):
        try:
            parsed = Pdf(data or b"")
            known = parsed.pages()
        except PdfFault as e:
            yield (None, None, *blank, str(e))
            return
        wanted = range(len(known)) if pages is None else pages
        last = {p: i for i, p in enumerate(wanted)}
        held = {}
        for i, p in enumerate(wanted):
            n = p + len(known) if p < 0 else p
            if not 0 <= n < len(known):
                yield (i, p, *blank, f"no page {p}")
                continue
            if p not in held:
                try:
                    held[p] = (*make(pixmap(Page(parsed, known[n]), s, background, clip)), None)
                except (PdfFault, ValueError) as e:
                    held[p] = (*blank, str(e))
            # A page that is asked for again is drawn once.
            yield (i, n, *(held[p] if last[p] > i else held.pop(p)))

    source = FileSource.of(content)
    source = FileSource(source.df.repartition(workers), source.make) if workers > 1 else source
    return source.rows_of(of_document, f"ord int, pno int, {columns}, error string")


def render(content: FileSource | DataFrame, scale: float | None = None, dpi: float | None = None, background=(255, 255, 255, 255), clip=None, workers: int = 1, pages: list[int] | None = None) -> DataFrame:
    """PNG files of pages: doc_id, ord, pno, width, height, png, error. pages: numbers (negatives from the end) in any order, repeats too; a number
    that a document doesn't have is an error in its row. workers: partitions that share the work."""
    make = lambda img: (img.shape[1], img.shape[0], png(img.shape[1], img.shape[0], img.tobytes(), 4, PNG_FAST))
    return _drawn(content, scale, dpi, background, clip, workers, pages, ["width", "height", "png"], "width int, height int, png binary", make)


def pixmaps(content: FileSource | DataFrame, scale: float | None = None, dpi: float | None = None, background=(255, 255, 255, 255), clip=None, workers: int = 1, pages: list[int] | None = None) -> DataFrame:
    """Pixels of pages, as `render` takes them: width, height, n (bytes a pixel), stride (bytes a row) and samples, rows of RGBA from the top."""
    make = lambda img: (img.shape[1], img.shape[0], 4, 4 * img.shape[1], img.tobytes())
    return _drawn(content, scale, dpi, background, clip, workers, pages, ["width", "height", "n", "stride", "samples"], "width int, height int, n int, stride int, samples binary", make)
