"""Structure of a parsed document as plain rows: annotations, links, form fields, page labels, outline, attachments."""

from __future__ import annotations

import re

from vellumtide.sources.pdfobjects import Name, Null, Pdf, Ref, Stream, text_of
from vellumtide.sources.pdfpage import Frame, at

_MAX_NODES = 4096


def _box(pdf: Pdf, frame: Frame, rect) -> tuple | None:
    r = pdf.get(rect)
    if not isinstance(r, list) or len(r) != 4:
        return None
    v = [float(pdf.get(x)) for x in r]
    a, b = at(frame.matrix, v[0], v[1]), at(frame.matrix, v[2], v[3])
    return min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])


def _tree(pdf: Pdf, root, leaf: str, depth: int = 32) -> list[tuple]:
    """Pairs of a name tree (leaf Names) or number tree (leaf Nums)."""
    out, stack, seen = [], [(root, 0)], set()
    while stack:
        ref, d = stack.pop()
        if isinstance(ref, Ref):
            if ref.num in seen:
                continue
            seen.add(ref.num)
        node = pdf.get(ref)
        if not isinstance(node, dict) or d > depth:
            continue
        pairs = pdf.get(node.get(leaf))
        if isinstance(pairs, list):
            out += list(zip(map(pdf.get, pairs[::2]), pairs[1::2]))
        kids = pdf.get(node.get("Kids"))
        stack += [(k, d + 1) for k in reversed(kids if isinstance(kids, list) else [])]
    return out


class Outline:
    def __init__(self, pdf: Pdf):
        self.pdf, self.pages = pdf, pdf.pages()
        self.root = pdf.get(pdf.trailer.get("Root")) or {}
        self.number = {p["_ref"]: i for i, p in enumerate(self.pages)}
        names = pdf.get(self.root.get("Names")) or {}
        self.dests = {bytes(k): v for k, v in _tree(pdf, names.get("Dests"), "Names", 16) if isinstance(k, bytes)}
        old = pdf.get(self.root.get("Dests"))
        self.dests |= {k.encode(): v for k, v in old.items()} if isinstance(old, dict) else {}

    def target(self, dest) -> tuple[int, float | None, float | None, float | None]:
        """Page number (-1: unknown), point in display space and zoom of a destination."""
        g = self.pdf.get
        dest = g(dest)
        if isinstance(dest, (bytes, Name)):
            dest = g(self.dests.get(dest.encode() if isinstance(dest, Name) else dest))
        if isinstance(dest, dict):
            dest = g(dest.get("D"))
        if not isinstance(dest, list) or not dest:
            return -1, None, None, None
        first = dest[0]
        page = self.number.get(first.num, -1) if isinstance(first, Ref) else first if type(first) is int else -1
        kind = str(g(dest[1])) if len(dest) > 1 else ""
        arg = [g(x) for x in dest[2:]]
        num = lambda i: float(arg[i]) if i < len(arg) and isinstance(arg[i], (int, float)) else None
        x, y, zoom = (num(0), num(1), num(2)) if kind == "XYZ" else (None, num(0), None) if kind in ("FitH", "FitBH") else (num(0), None, None) if kind in ("FitV", "FitBV") else (None, None, None)
        if 0 <= page < len(self.pages) and (x is not None or y is not None):
            f = Frame(self.pdf, self.pages[page])
            x, y = at(f.matrix, x if x is not None else f.x0, y if y is not None else f.y1)
        return page, x, y, zoom or None

    def annotations(self) -> list[dict]:
        """Annotations of all pages; those without subtype or rectangle are left out. Links carry kind and target."""
        g, out = self.pdf.get, []
        for pno, page in enumerate(self.pages):
            frame = Frame(self.pdf, page)
            listed = g(page.get("Annots"))
            for seq, a in enumerate(map(g, listed if isinstance(listed, list) else [])):
                if not isinstance(a, dict) or not isinstance(g(a.get("Subtype")), Name) or (box := _box(self.pdf, frame, a.get("Rect"))) is None:
                    continue
                row = {"pno": pno, "seq": seq, "type": str(g(a["Subtype"])), "bbox": box, "contents": text_of(g(a.get("Contents"))), "uri": None, "kind": None, "page": None, "to_x": None, "to_y": None, "zoom": None, "file": None, "name": None}
                act = g(a.get("A"))
                act = act if isinstance(act, dict) else {}
                s = g(act.get("S"))
                if s == "URI":
                    row |= {"kind": 2, "uri": text_of(g(act.get("URI")))}
                elif s == "GoTo" or a.get("Dest") is not None:
                    page_, x, y, z = self.target(act.get("D") if s == "GoTo" else a.get("Dest"))
                    row |= {"kind": 1, "page": page_, "to_x": x, "to_y": y, "zoom": z}
                elif s == "GoToR":
                    row |= {"kind": 5, "file": file_name(self.pdf, act.get("F"))}
                elif s == "Launch":
                    row |= {"kind": 3, "file": file_name(self.pdf, act.get("F"))}
                elif s == "Named":
                    row |= {"kind": 4, "name": str(g(act.get("N")))}
                out.append(row)
        return out

    def fields(self) -> list[dict]:
        g, out, seen, n = self.pdf.get, [], set(), 0
        form = g(self.root.get("AcroForm"))
        stack = [(f, "", None, 0, Null) for f in reversed(g(form.get("Fields")) or [])] if isinstance(form, dict) else []
        while stack and n < _MAX_NODES:
            ref, above, kind, flags, value = stack.pop()
            n += 1
            if isinstance(ref, Ref) and ref.num in seen:
                continue
            seen.add(ref.num if isinstance(ref, Ref) else id(ref))
            f = g(ref)
            if not isinstance(f, dict):
                continue
            own = text_of(g(f.get("T"))) if f.get("T") is not None else ""
            name = ".".join(x for x in (above, own) if x)
            kind, flags = g(f.get("FT")) or kind, g(f.get("Ff")) if f.get("Ff") is not None else flags
            value = g(f["V"]) if "V" in f else value
            kids = [k for k in g(f.get("Kids")) or [] if isinstance(g(k), dict)]
            if any("T" in g(k) for k in kids):
                stack += [(k, name, kind, flags, value) for k in reversed(kids)]
                continue
            out.append({"name": name, "type": field_kind(str(kind), int(flags or 0)), "value": text_of(value) if value is not Null else "", "ref": ref, "widgets": kids or [ref]})
        return sorted(out, key=lambda r: r["name"])

    def labels(self) -> list[dict]:
        out = []
        for k, v in _tree(self.pdf, self.root.get("PageLabels"), "Nums"):
            v = self.pdf.get(v)
            if isinstance(k, int) and isinstance(v, dict):
                out.append({"startpage": k, "style": str(self.pdf.get(v.get("S")) or ""), "prefix": text_of(self.pdf.get(v.get("P"))), "firstpagenum": int(self.pdf.get(v.get("St", 1)) or 1)})
        return sorted(out, key=lambda r: r["startpage"])

    def toc(self) -> list[list]:
        """[level, title, page from 1]; entries whose page is unknown are left out."""
        g, out, seen = self.pdf.get, [], set()
        top = g(self.root.get("Outlines"))
        stack = [(top.get("First"), 1)] if isinstance(top, dict) else []
        while stack:
            ref, level = stack.pop()
            e = g(ref)
            if not isinstance(e, dict) or isinstance(ref, Ref) and ref.num in seen:
                continue
            seen.add(ref.num if isinstance(ref, Ref) else id(ref))
            act = g(e.get("A"))
            page = self.target(e.get("Dest") if e.get("Dest") is not None else act.get("D") if isinstance(act, dict) else None)[0]
            if page >= 0:
                out.append([level, text_of(g(e.get("Title"))), page + 1])
            stack.append((e.get("Next"), level))
            if e.get("First") is not None:
                stack.append((e.get("First"), level + 1))
        return out

    def attachments(self) -> list[dict]:
        g, out = self.pdf.get, []
        names = g(self.root.get("Names")) or {}
        for k, v in _tree(self.pdf, names.get("EmbeddedFiles"), "Names"):
            spec = g(v)
            if isinstance(spec, dict) and isinstance(ef := g(spec.get("EF")), dict):
                s = g(ef.get("UF") if ef.get("UF") is not None else ef.get("F"))
                if isinstance(s, Stream):
                    out.append({"name": text_of(k), "filename": file_name(self.pdf, spec), "description": text_of(g(spec.get("Desc"))), "data": self.pdf.stream(s)})
        return sorted(out, key=lambda r: r["name"])

    def pdfa(self) -> tuple[int | None, str | None]:
        s = self.pdf.get(self.root.get("Metadata"))
        xmp = self.pdf.stream(s).decode("utf-8", "replace") if isinstance(s, Stream) else ""
        pick = lambda k, v: (m[1] if (m := re.search(rf"pdfaid:{k}\s*(?:=\s*[\"']|>)\s*({v})", xmp)) else None)
        part = pick("part", "[0-9]+")
        return int(part) if part else None, pick("conformance", "[A-Za-z]+")


def field_kind(kind: str, flags: int) -> str:
    if kind == "Ch":
        return "combobox" if flags & 1 << 17 else "listbox"
    if kind == "Btn":
        return "button" if flags & 1 << 16 else "radio" if flags & 1 << 15 else "checkbox"
    return {"Tx": "text", "Sig": "signature"}.get(kind, "unknown")


def file_name(pdf: Pdf, spec) -> str:
    spec = pdf.get(spec)
    if isinstance(spec, dict):
        spec = pdf.get(spec.get("UF") if spec.get("UF") is not None else spec.get("F"))
    return text_of(spec)
