"""Edits of a `Draft`, and `edit`, which applies any of them to a column of PDF files in one Python pass. Arguments are checked before anything changes."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from vellumtide.errors import PdfFault
from vellumtide.functions.checks import check_color, check_rect
from vellumtide.operators.structure import INFO_KEYS
from vellumtide.sources.filesource import FileSource
from vellumtide.sources.inspect import Outline
from vellumtide.sources.pdfobjects import Lexer, Name, Null, Op, Pdf, Ref, Stream
from vellumtide.sources.pdfpage import Frame, jpeg_header, unpng
from vellumtide.sources.pdfwriter import Draft, number, ser, text_string

# Names of standard fonts, line height, OCR baseline.
STANDARD_FONTS = {"helv": "Helvetica", "hebo": "Helvetica-Bold", "heit": "Helvetica-Oblique", "hebi": "Helvetica-BoldOblique", "cour": "Courier", "cobo": "Courier-Bold", "coit": "Courier-Oblique", "cobi": "Courier-BoldOblique", "tiro": "Times-Roman", "tibo": "Times-Bold", "tiit": "Times-Italic", "tibi": "Times-BoldItalic", "symb": "Symbol", "zadb": "ZapfDingbats"}
LEADING = 1.2
OCR_DESCENT = 0.2


class _View:
    """What Frame needs of a parsed file, for a draft."""

    def __init__(self, d: Draft):
        self.get = d.get


def frame(d: Draft, pno: int) -> Frame:
    return Frame(_View(d), d.pages[pno])


def page_no(d: Draft, pno: int) -> int:
    n = pno + len(d.pages) if pno < 0 else pno
    if not 0 <= n < len(d.pages):
        raise IndexError(f"no page {pno}")
    return n


def _to_pdf(f: Frame, x: float, y: float) -> tuple[float, float]:
    return {0: (f.x0 + x, f.y1 - y), 90: (f.x0 + y, f.y0 + x), 180: (f.x1 - x, f.y0 + y), 270: (f.x1 - y, f.y1 - x)}[f.rotation]


# --- page sets -----------------------------------------------------------------------------------------------------


def select(d: Draft, order: list[int]) -> None:
    d.pages = [dict(d.pages[page_no(d, n)]) for n in order]


def delete(d: Draft, gone: list[int]) -> None:
    out = {page_no(d, n) for n in gone}
    d.pages = [p for i, p in enumerate(d.pages) if i not in out]


def _import(d: Draft, src: Draft, pages: list[dict]) -> list[dict]:
    shift = max(d.objects, default=0)

    def moved(o):
        if isinstance(o, Ref):
            return Ref(o.num + shift, 0)
        if isinstance(o, list):
            return [moved(v) for v in o]
        if isinstance(o, dict):
            return {k: moved(v) for k, v in o.items()}
        return Stream(moved(o.head), o.raw, o.owner + shift) if isinstance(o, Stream) else o

    d.objects |= {n + shift: moved(o) for n, o in src.objects.items()}
    return [moved(p) for p in pages]


def insert(d: Draft, src: Draft, first: int = 0, last: int = -1, start_at: int = -1) -> None:
    """Pages first to last of src (reversed if first > last) before page start_at, or at the end. What nothing refers to goes when the draft is saved."""
    if src is d:
        raise ValueError("a document can't take its own pages")
    if not src.pages:
        return
    a, b = page_no(src, first), page_no(src, last)
    if start_at > len(d.pages):
        raise IndexError(f"no place {start_at}")
    some = src.pages[a : b + 1] if a <= b else src.pages[b : a + 1][::-1]
    place = len(d.pages) if start_at < 0 else start_at
    d.pages[place:place] = _import(d, src, some)


def new_page(d: Draft, at: int = -1, width: float = 595.0, height: float = 842.0) -> None:
    check_rect((0, 0, width, height))
    d.pages.insert(len(d.pages) if at < 0 else at, {"MediaBox": [0, 0, float(width), float(height)], "Resources": {}})


def copy_page(d: Draft, pno: int, to: int = -1) -> None:
    d.pages.insert(len(d.pages) if to < 0 else to, dict(d.pages[page_no(d, pno)]))


# --- attributes ----------------------------------------------------------------------------------------------------


def set_metadata(d: Draft, values: dict[str, str]) -> None:
    for k, v in values.items():
        if k not in INFO_KEYS:
            raise ValueError(f"no such metadata key: {k}")
        if not isinstance(v, str):
            raise TypeError(f"metadata values are strings, {k} isn't")
    for k, v in values.items():
        key = k[0].upper() + k[1:]
        if v:
            d.info[key] = text_string(v)
        else:
            d.info.pop(key, None)


def set_rotation(d: Draft, pno: int, angle: int) -> None:
    if angle % 90:
        raise ValueError("rotations are multiples of 90")
    d.pages[page_no(d, pno)]["Rotate"] = angle % 360


def set_box(d: Draft, pno: int, rect, box: str = "MediaBox") -> None:
    d.pages[page_no(d, pno)][box] = list(check_rect(rect))


def set_labels(d: Draft, ranges: list[dict]) -> None:
    starts = [r["startpage"] for r in ranges]
    if ranges and (min(starts) != 0 or len(set(starts)) < len(starts)):
        raise ValueError("label ranges begin at page 0 and at different pages")
    if any(r.get("style", "D") not in ("D", "R", "r", "A", "a", "") or r.get("firstpagenum", 1) < 1 for r in ranges):
        raise ValueError("an unknown style or a first number below 1")
    d.root.pop("PageLabels", None)
    nums: list = []
    for r in sorted(ranges, key=lambda r: r["startpage"]):
        head = ({"S": Name(r["style"])} if r.get("style", "D") else {}) | ({"P": text_string(r["prefix"])} if r.get("prefix") else {}) | ({"St": r["firstpagenum"]} if r.get("firstpagenum", 1) != 1 else {})
        nums += [r["startpage"], head]
    if nums:
        d.root["PageLabels"] = d.add({"Nums": nums})


def set_toc(d: Draft, entries: list[list]) -> None:
    """entries: [level, title, page from 1]."""
    before = 0
    for level, _, page in entries:
        if not 1 <= level <= before + 1 or not 1 <= page <= len(d.pages):
            raise ValueError("an outline begins at level 1, skips no level and points to pages")
        before = level
    d.root.pop("Outlines", None)
    if not entries:
        return
    top = d.add({})
    refs = [d.add({}) for _ in entries]
    path, kids = [top], {top.num: []}
    for ref, (level, title, page) in zip(refs, entries):
        path = path[:level]
        kids[path[-1].num].append(ref)
        kids[ref.num] = []
        d.objects[ref.num] = {"_pages": True, "Title": text_string(title), "Parent": path[-1], "Dest": [("page", page - 1), Name("Fit")]}
        path.append(ref)
    d.objects[top.num] = {"Type": Name("Outlines")}
    for num, some in kids.items():
        if some:
            d.objects[num] |= {"First": some[0], "Last": some[-1], "Count": len(some)}
            for a, b in zip(some, some[1:]):
                d.objects[a.num]["Next"] = b
                d.objects[b.num]["Prev"] = a
    d.root["Outlines"] = top


def set_attachments(d: Draft, files: list[dict]) -> None:
    """All attachments anew: name, data, and filename and description if wanted."""
    names = [f["name"] for f in files]
    if len(set(names)) < len(names):
        raise ValueError("attachment names are unique")
    pairs: list = []
    for f in sorted(files, key=lambda f: f["name"]):
        s = d.add(Stream({"Type": Name("EmbeddedFile"), "Filter": Name("FlateDecode")}, zlib.compress(f["data"])))
        label = text_string(f.get("filename") or f["name"])
        pairs += [text_string(f["name"]), d.add({"Type": Name("Filespec"), "F": label, "UF": label, "Desc": text_string(f.get("description") or ""), "EF": {"F": s, "UF": s}})]
    tree = dict(d.get(d.root.get("Names")) or {})
    tree.pop("EmbeddedFiles", None)
    if pairs:
        tree["EmbeddedFiles"] = d.add({"Names": pairs})
    d.root["Names"] = tree


def fill_form(d: Draft, data: bytes, values: dict[str, str | bool]) -> None:
    """Values by full field name; data is the file that the draft was read from."""
    found = {f["name"]: f for f in Outline(Pdf(data)).fields()}
    for name in values:
        if name not in found:
            raise ValueError(f"no field {name}")
        if found[name]["type"] == "signature":
            raise ValueError("signatures can't be filled in")
    for name, v in values.items():
        f = found[name]
        head = d.get(f["ref"])
        if f["type"] in ("checkbox", "radio", "button"):
            states = [s for w in f["widgets"] for s in (d.get((d.get(d.get(w).get("AP")) or {}).get("N")) or {}) if s != "Off"]
            state = (states[0] if states else "Yes") if v is True else "Off" if v is False else str(v)
            head["V"] = Name(state)
            for w in f["widgets"]:
                own = d.get((d.get(d.get(w).get("AP")) or {}).get("N")) or {}
                d.get(w)["AS"] = Name(state if state in own or not own else "Off")
        else:
            head["V"] = text_string(str(v))
    form = d.get(d.root.get("AcroForm"))
    if isinstance(form, dict):
        form["NeedAppearances"] = True


# --- annotations and drawing ---------------------------------------------------------------------------------------


def _annotate(d: Draft, pno: int, annot: dict) -> None:
    p = d.pages[page_no(d, pno)]
    had = d.get(p.get("Annots"))
    p["Annots"] = [*(had if isinstance(had, list) else []), d.add(annot)]  # a new array: copies of the page share none


def add_link(d: Draft, pno: int, rect, uri: str) -> None:
    r, f = check_rect(rect), frame(d, page_no(d, pno))
    a, b = _to_pdf(f, r[0], r[1]), _to_pdf(f, r[2], r[3])
    _annotate(d, pno, {"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])], "Border": [0, 0, 0], "A": {"S": Name("URI"), "URI": uri.encode("utf-8")}})


def add_highlight(d: Draft, pno: int, rects: list, color=(1.0, 1.0, 0.0), opacity: float = 0.5) -> None:
    rects, color = [check_rect(r) for r in rects], check_color(color)
    if not rects or not 0 < opacity <= 1:
        raise ValueError("a highlight needs rectangles and an opacity above 0, up to 1")
    f, quads, ops = frame(d, page_no(d, pno)), [], [" ".join(number(c) for c in color) + " rg /G gs"]
    for r in rects:
        q = [_to_pdf(f, x, y) for x, y in ((r[0], r[1]), (r[2], r[1]), (r[0], r[3]), (r[2], r[3]))]
        quads += [v for p in q for v in p]
        ops.append(" ".join(f"{number(x)} {number(y)} {o}" for (x, y), o in zip((q[0], q[1], q[3], q[2]), "mlll")) + " f")
    xs, ys = quads[::2], quads[1::2]
    box = [min(xs), min(ys), max(xs), max(ys)]
    form = d.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": box, "Resources": {"ExtGState": {"G": {"BM": Name("Multiply"), "ca": float(opacity)}}}}, "\n".join(ops).encode()))
    _annotate(d, pno, {"Type": Name("Annot"), "Subtype": Name("Highlight"), "Rect": box, "QuadPoints": quads, "C": list(color), "CA": float(opacity), "F": 4, "AP": {"N": form}})


def append_content(d: Draft, pno: int, ops: bytes, overlay: bool = True) -> None:
    """New content over or under the page's own, which is wrapped in q and Q once and never rewritten."""
    p = d.pages[page_no(d, pno)]
    own = d.get(p.get("Contents"))
    parts = list(own) if isinstance(own, list) else [p["Contents"]] if p.get("Contents") is not None else []
    wrapped = bool(parts) and isinstance(s := d.get(parts[0]), Stream) and s.raw == b"q\n"
    if parts and not wrapped:
        parts = [d.add(Stream({}, b"q\n")), *parts, d.add(Stream({}, b"\nQ\n"))]
    new = d.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(b"q\n" + ops + b"\nQ\n")))
    p["Contents"] = [*parts, new] if overlay else [*parts[:0], new, *parts]


def _resource(d: Draft, pno: int, kind: str, ref) -> str:
    p = d.pages[page_no(d, pno)]
    res = dict(d.get(p.get("Resources")) or {})
    some = dict(d.get(res.get(kind)) or {})
    name = next(f"V{kind[0]}{i}" for i in range(len(some) + 1) if f"V{kind[0]}{i}" not in some)
    some[name] = ref
    res[kind] = some
    p["Resources"] = res
    return name


def _upright(f: Frame, x: float, y: float) -> str:
    """A matrix that sets content upright at a display point."""
    px, py = _to_pdf(f, x, y)
    a, b, c, e = {0: (1, 0, 0, 1), 90: (0, 1, -1, 0), 180: (-1, 0, 0, -1), 270: (0, -1, 1, 0)}[f.rotation]
    return f"{a} {b} {c} {e} {number(px)} {number(py)}"


def insert_text(d: Draft, pno: int, point, text: str, size: float = 11.0, font: str = "helv", color=(0, 0, 0), overlay: bool = True) -> int:
    """Lines of text from a baseline point on; the number of lines."""
    color = check_color(color)
    if font not in STANDARD_FONTS and font not in STANDARD_FONTS.values():
        raise ValueError(f"no standard font {font}")
    try:
        rows = [r.encode("cp1252") for r in re.sub("\r\n?", "\n", text).split("\n")]
    except UnicodeEncodeError as e:
        raise ValueError("the text has characters that standard fonts lack") from e
    head = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(STANDARD_FONTS.get(font, font))} | ({} if font in ("symb", "zadb") else {"Encoding": Name("WinAnsiEncoding")})
    name = _resource(d, pno, "Font", d.add(head))
    f = frame(d, page_no(d, pno))
    ops = [b"BT " + " ".join(number(c) for c in color).encode() + f" rg /{name} {number(size)} Tf {number(size * LEADING)} TL {_upright(f, *point)} Tm".encode()]
    ops += [ser(r) + (b" Tj" if i == 0 else b" '") for i, r in enumerate(rows)]
    append_content(d, pno, b"\n".join([*ops, b"ET"]), overlay)
    return len(rows)


def fit(target, w: float, h: float, keep: bool = True):
    tw, th = target[2] - target[0], target[3] - target[1]
    if not keep:
        return target
    s = min(tw / w, th / h)
    mx, my = (tw - s * w) / 2, (th - s * h) / 2
    return target[0] + mx, target[1] + my, target[0] + mx + s * w, target[1] + my + s * h


def insert_image(d: Draft, pno: int, rect, data: bytes, keep: bool = True, overlay: bool = True) -> None:
    r = check_rect(rect)
    if data[:2] == b"\xff\xd8":
        w, h, n = jpeg_header(data)
        head = {"ColorSpace": Name({1: "DeviceGray", 4: "DeviceCMYK"}.get(n, "DeviceRGB")), "BitsPerComponent": 8, "Filter": Name("DCTDecode")}
        body = data
    else:
        w, h, rgb, alpha = unpng(data)
        head = {"ColorSpace": Name("DeviceGray" if len(rgb) == w * h else "DeviceRGB"), "BitsPerComponent": 8, "Filter": Name("FlateDecode")}
        body = zlib.compress(rgb)
        if alpha is not None:
            head["SMask"] = d.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": w, "Height": h, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8, "Filter": Name("FlateDecode")}, zlib.compress(alpha)))
    x = d.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": w, "Height": h} | head, body))
    _place(d, pno, x, fit(r, w, h, keep), 1.0, 1.0, overlay)


def _place(d: Draft, pno: int, x: Ref, box, w: float, h: float, overlay: bool) -> None:
    name, f = _resource(d, pno, "XObject", x), frame(d, page_no(d, pno))
    ops = f"{_upright(f, box[0], box[3])} cm {number((box[2] - box[0]) / w)} 0 0 {number((box[3] - box[1]) / h)} 0 0 cm /{name} Do"
    append_content(d, pno, ops.encode(), overlay)


def show_page(d: Draft, pno: int, rect, src: Draft, source_pno: int = 0, keep: bool = True, overlay: bool = True) -> None:
    """A page of another document as a form in a rectangle."""
    if src is d:
        raise ValueError("a document can't show its own pages")
    r, n = check_rect(rect), page_no(src, source_pno)
    f = frame(src, n)
    parts = src.get(src.pages[n].get("Contents"))
    raw = b"\n".join(_plain(src, s) for s in (parts if isinstance(parts, list) else [src.pages[n].get("Contents")]) if isinstance(src.get(s), Stream))
    res = _import(d, src, [{"R": src.pages[n].get("Resources", {})}])[0]["R"]
    m = f.matrix  # to display space; flipped up again for the form
    form = d.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [f.x0, f.y0, f.x1, f.y1], "Matrix": [float(v) for v in (m[0], -m[1], m[2], -m[3], m[4], f.height - m[5])], "Resources": res}, raw))
    _place(d, pno, form, fit(r, f.width, f.height, keep), f.width, f.height, overlay)


def _plain(d: Draft, ref) -> bytes:
    s = d.get(ref)
    return Pdf.stream(_Decoder(d), s)


class _Decoder:
    """Enough of a parsed file to decode a draft's stream."""

    crypt = limit = None

    def __init__(self, d: Draft):
        self.get = d.get


def add_ocr_layer(d: Draft, pno: int, words: list[tuple]) -> None:
    """Invisible text: (x0, y0, x1, y1, text) in display space, set in a font of one code for each distinct character, stretched to each word's box."""
    chars = {c: i + 1 for i, c in enumerate(dict.fromkeys(c for w in words for c in w[4]))}
    if not chars:
        return
    rows = [f"<{i:04X}> <{c.encode('utf-16-be').hex().upper()}>" for c, i in chars.items()]
    cmap = "/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + "\n".join(f"{len(rows[k : k + 100])} beginbfchar\n" + "\n".join(rows[k : k + 100]) + "\nendbfchar" for k in range(0, len(rows), 100)) + "\nendcmap end"
    kid = d.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Invisible"), "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}, "DW": 1000})
    font = d.add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Invisible"), "Encoding": Name("Identity-H"), "DescendantFonts": [kid], "ToUnicode": d.add(Stream({}, cmap.encode()))})
    name, f, ops = _resource(d, pno, "Font", font), frame(d, page_no(d, pno)), ["BT 3 Tr"]
    for x0, y0, x1, y1, text, *_ in words:
        if text and x1 > x0 and y1 > y0:
            h = y1 - y0
            stretch = 100 * (x1 - x0) / (len(text) * h)
            ops.append(f"/{name} {number(h)} Tf {number(stretch)} Tz {_upright(f, x0, y1 - OCR_DESCENT * h)} Tm <{''.join(f'{chars[c]:04X}' for c in text)}> Tj")
    append_content(d, pno, "\n".join([*ops, "ET"]).encode())


def replace_text(d: Draft, pno: int, old: str, new: str) -> int:
    """Occurrences replaced within single shown strings of simple encodings; characters the encoding lacks become '?'."""
    p = d.pages[page_no(d, pno)]
    a, b, count = old.encode("cp1252", "replace"), new.encode("cp1252", "replace"), 0
    own = d.get(p.get("Contents"))
    parts = own if isinstance(own, list) else [p.get("Contents")]
    out = []
    for ref in parts:
        if not isinstance(s := d.get(ref), Stream):
            continue
        lex, args, ops = Lexer(_plain(d, ref)), [], []
        while (t := lex.next()) is not None:
            if not isinstance(t, Op):
                args.append(t)
                continue
            if t in (b"Tj", b"'", b'"', b"TJ") and args:
                for k, v in enumerate(args):
                    if isinstance(v, bytes):
                        count += v.count(a)
                        args[k] = v.replace(a, b)
                    elif isinstance(v, list):
                        count += sum(x.count(a) for x in v if isinstance(x, bytes))
                        args[k] = [x.replace(a, b) if isinstance(x, bytes) else x for x in v]
            ops.append(b" ".join([*map(ser, args), bytes(t)]))
            args = []
        out.append(d.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(b"\n".join(ops)))))
    if count:
        p["Contents"] = out
    return count


def edit(content: FileSource | DataFrame, change: Callable[[Draft], None], password: str | None = None, **save) -> FileSource | DataFrame:
    """content: doc_id, content. Every file with `change` applied and saved (garbage, deflate, object_streams, user_pw, owner_pw, permissions); faults go to `error`."""
    source = FileSource.of(content)
    file = source.make

    def make(record):
        try:
            d = Draft(file(record)[0] or b"", password)
            change(d)
            return d.save(**save), None
        except (PdfFault, ValueError, TypeError, IndexError, KeyError) as e:
            return None, f"{type(e).__name__}: {e}"

    edited = FileSource(source.df, make)
    return edited if isinstance(content, FileSource) else edited.rows(error=True)


def merge_files(content: DataFrame, into: str, **save) -> DataFrame:
    """content: doc_id, content and the column `into`. One document for each value of it, of the pages of its documents in the order of doc_id: doc_id, content, error (of documents that were left out)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole, faults = Draft(None), []
        for doc, data in pdf.sort_values("doc_id")[["doc_id", "content"]].itertuples(index=False):
            try:
                insert(whole, Draft(bytes(data or b"")))
            except (PdfFault, ValueError) as e:
                faults.append(f"{doc}: {e}")
        return pd.DataFrame([(key[0], whole.save(**save), "; ".join(faults) or None)], columns=["doc_id", "content", "error"])

    kind = content.schema[into].dataType.simpleString()
    return content.select(into, "doc_id", "content").groupBy(into).applyInPandas(run, f"doc_id {kind}, content binary, error string")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Null", "annotations")]
