"""Page geometry as column expressions: display space has its origin top left, y down, rotation resolved and the crop box's corner at 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two A4 defaults, one of page properties and one of native geometry; limits of rendering.
A4 = (595.2756, 841.8898)
NATIVE_A4 = (595.0, 842.0)
MAX_RENDER_PIXELS = 64_000_000
MAX_RENDER_SIDE = 65_535
MAX_PARALLEL_RENDER_BYTES = 512_000_000
ESTIMATED_RENDER_BYTES_PER_PIXEL = 8
MAX_RENDER_WORKERS = 64


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def normalized(r: Column) -> Column:
    return rect(F.least(r["x0"], r["x1"]), F.least(r["y0"], r["y1"]), F.greatest(r["x0"], r["x1"]), F.greatest(r["y0"], r["y1"]))


def rotation(angle: Column) -> Column:
    return F.pmod(F.coalesce(angle, F.lit(0)), F.lit(360))


def turned(rot: Column) -> Column:
    return rot.isin(90, 270)


def page_rect(media: Column, crop: Column, rot: Column) -> Column:
    """The page's rectangle in display space."""
    box = normalized(F.coalesce(crop, media, rect(F.lit(0.0), F.lit(0.0), F.lit(A4[0]), F.lit(A4[1]))))
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    return rect(F.lit(0.0), F.lit(0.0), F.when(turned(rot), h).otherwise(w), F.when(turned(rot), w).otherwise(h))


def to_display(x: Column, y: Column, box: Column, rot: Column) -> Column:
    """A point of PDF space in display space."""
    dx = F.when(rot == 90, y - box["y0"]).when(rot == 180, box["x1"] - x).when(rot == 270, box["y1"] - y).otherwise(x - box["x0"])
    dy = F.when(rot == 90, x - box["x0"]).when(rot == 180, y - box["y0"]).when(rot == 270, box["x1"] - x).otherwise(box["y1"] - y)
    return F.struct(dx.alias("x"), dy.alias("y"))


def to_pdf(x: Column, y: Column, box: Column, rot: Column) -> Column:
    """The inverse of `to_display`."""
    px = F.when(rot == 90, box["x0"] + y).when(rot == 180, box["x1"] - x).when(rot == 270, box["x1"] - y).otherwise(box["x0"] + x)
    py = F.when(rot == 90, box["y0"] + x).when(rot == 180, box["y0"] + y).when(rot == 270, box["y1"] - x).otherwise(box["y1"] - y)
    return F.struct(px.alias("x"), py.alias("y"))


def rect_to_display(r: Column, box: Column, rot: Column) -> Column:
    a, b = to_display(r["x0"], r["y0"], box, rot), to_display(r["x1"], r["y1"], box, rot)
    return rect(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]))


def rect_to_quad(r: Column, box: Column, rot: Column) -> Column:
    """Corners top left, top right, bottom left, bottom right of a display rectangle, in PDF space."""
    pts = [to_pdf(r[x], r[y], box, rot) for x, y in (("x0", "y0"), ("x1", "y0"), ("x0", "y1"), ("x1", "y1"))]
    return F.array(*[p[k] for p in pts for k in ("x", "y")])


def rect_ok(r: Column) -> Column:
    """Finite, within single precision and in order."""
    parts = [r[k] for k in ("x0", "y0", "x1", "y1")]
    fine = F.lit(True)
    for p in parts:
        fine = fine & p.isNotNull() & ~F.isnan(p) & (F.abs(p) <= F.lit(3.4028234663852886e38))
    return fine & (r["x0"] < r["x1"]) & (r["y0"] < r["y1"])


def placement(target: Column, w: Column, h: Column, keep: bool) -> Column:
    """Where content of size w by h stands in a target rectangle: stretched to it, or in proportion and centred."""
    tw, th = target["x1"] - target["x0"], target["y1"] - target["y0"]
    if not keep:
        return rect(target["x0"], target["y0"], target["x1"], target["y1"])
    s = F.least(tw / w, th / h)
    mx, my = (tw - s * w) / 2, (th - s * h) / 2
    return rect(target["x0"] + mx, target["y0"] + my, target["x0"] + mx + s * w, target["y0"] + my + s * h)


def crop_pixels(clip: Column, scale: Column, width: Column, height: Column) -> Column:
    """Pixel bounds of a clip, outward, within the image; null where nothing is left."""
    x0, y0 = (F.greatest(F.floor(clip[k] * scale), F.lit(0)).cast("long") for k in ("x0", "y0"))
    x1 = F.least(F.ceil(clip["x1"] * scale), width).cast("long")
    y1 = F.least(F.ceil(clip["y1"] * scale), height).cast("long")
    return F.when((x0 < x1) & (y0 < y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def render_size(width: Column, height: Column, scale: Column) -> Column:
    """Pixels of a rendered page; null where the limits forbid it."""
    w, h = F.floor(width * scale).cast("long"), F.floor(height * scale).cast("long")
    ok = (scale > 0) & w.between(1, MAX_RENDER_SIDE) & h.between(1, MAX_RENDER_SIDE) & (w * h <= MAX_RENDER_PIXELS)
    return F.when(ok, F.struct(w.alias("width"), h.alias("height")))


def render_workers(asked: Column, pages: Column, most_pixels: Column) -> Column:
    budget = F.greatest(F.lit(1), F.floor(F.lit(MAX_PARALLEL_RENDER_BYTES) / (F.lit(ESTIMATED_RENDER_BYTES_PER_PIXEL) * most_pixels)))
    return F.least(asked, pages, budget).cast("long")


def snap_direction(v: Column) -> Column:
    return F.when(F.abs(v) < 1e-9, F.lit(0.0)).otherwise(v)
