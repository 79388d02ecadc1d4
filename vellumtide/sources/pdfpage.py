"""Page interpretation: content streams to glyphs, rules and images in display space (origin top left, y down, rotation resolved)."""

from __future__ import annotations

import math
import re
import struct
import unicodedata
import zlib

import numpy as np

from vellumtide.errors import PdfFault
from vellumtide.sources.glyphs import Glyphs
from vellumtide.sources.pdfobjects import Lexer, Name, Null, Op, Pdf, Stream, _unpredict, decode, text_of

# Page defaults, tolerances and flags of the document model.
NATIVE_A4 = (0.0, 0.0, 595.0, 842.0)
TABLE_AXIS_TOLERANCE = 0.5
MIN_TABLE_RULE_LENGTH = 3.0
MAX_FILLED_RULE_THICKNESS = 4.0
MIN_FILLED_RULE_ASPECT = 4.0
MAX_TABLE_RULES = 4096
ITALIC, SERIF, MONO, BOLD = 2, 4, 8, 16

#: Advance widths of printable ASCII (32 to 126) in the standard fonts; fixed values of the public font metrics.
_HELVETICA = "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
_HELVETICA_BOLD = "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584"
_TIMES = "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"


def standard_width(font: str, char: str) -> float | None:
    """Thousandths of the size, for a font named like one of the standard ones."""
    n = font.lower()
    if "courier" in n:
        return 600.0
    row = _TIMES if "times" in n else _HELVETICA_BOLD if ("helvetica" in n or "arial" in n) and "bold" in n else _HELVETICA if "helvetica" in n or "arial" in n else None
    if row is None:
        return None
    base = unicodedata.normalize("NFD", char)[:1]
    return float(row.split()[ord(base) - 32]) if base and 32 <= ord(base) <= 126 else 556.0


def mul(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def at(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


_ACCENTS = {"acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "cedilla": "CEDILLA", "ring": "RING ABOVE", "caron": "CARON"}
#: Glyph names that don't follow from a character's Unicode name by rule.
_NAMES = {"space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}", "bullet": "•", "endash": "–", "emdash": "—", "quotedblleft": "“", "quotedblright": "”", "fi": "fi", "fl": "fl", "ff": "ff", "ellipsis": "…", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "Euro": "€", "section": "§", "degree": "°"}
_DIGITS = "zero one two three four five six seven eight nine".split()


def glyph_name(name: str) -> str:
    if name in _NAMES:
        return _NAMES[name]
    if name in _DIGITS:
        return str(_DIGITS.index(name))
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni([0-9A-F]{4})+|u([0-9A-F]{4,6})", name):
        return chr(int(m[2], 16)) if m[2] else "".join(chr(int(name[i : i + 4], 16)) for i in range(3, len(name), 4))
    if (a := _ACCENTS.get(name[1:])) and name[0].isalpha():
        try:
            return unicodedata.lookup(f"LATIN {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {name[0].upper()} WITH {a}")
        except KeyError:
            return ""
    return ""


def parse_cmap(data: bytes) -> tuple[dict[bytes, str], set[int]]:
    """Code to text, and the lengths of codes, of a ToUnicode map."""
    out, lengths, lex, args = {}, set(), Lexer(data), []
    u = lambda b: b.decode("utf-16-be", "ignore")
    while (t := lex.next()) is not None:
        if not isinstance(t, Op):
            args.append(t)
            continue
        if t == b"endcodespacerange":
            lengths |= {len(x) for x in args if isinstance(x, bytes)}
        elif t == b"endbfchar":
            for a, b in zip(args[::2], args[1::2]):
                if isinstance(a, bytes) and isinstance(b, bytes):
                    out[a] = u(b)
                    lengths.add(len(a))
        elif t == b"endbfrange":
            for a, b, c in zip(args[::3], args[1::3], args[2::3]):
                if not (isinstance(a, bytes) and isinstance(b, bytes)):
                    continue
                lo, hi = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                for k in range(min(hi - lo, 0xFFFF) + 1):
                    key = (lo + k).to_bytes(len(a), "big")
                    if isinstance(c, list):
                        out[key] = u(c[k]) if k < len(c) else ""
                    elif isinstance(c, bytes) and c:
                        s = u(c)
                        out[key] = s[:-1] + chr(ord(s[-1]) + k) if s else ""
                lengths.add(len(a))
        args = []
    return out, lengths


#: Predefined CMaps that are a Python codec under another name.
_CODECS = (("RKSJ", "cp932"), ("UniJIS-UTF16", "utf-16-be"), ("UCS2", "utf-16-be"), ("UTF16", "utf-16-be"), ("GBK", "gbk"), ("GB-EUC", "gb2312"), ("ETen-B5", "big5"), ("B5pc", "big5"), ("KSCms", "cp949"), ("KSC-EUC", "euc_kr"), ("EUC-", "euc_jp"))


#: Stands for a code that isn't one character; strings shorter than this are shown character by character.
NO_CHAR, SHORT = 0xFFFFFFFF, 12


def _points(texts) -> np.ndarray:
    return np.array([ord(t) if len(t) == 1 else NO_CHAR for t in texts], np.uint32)


#: Characters of all codes, as a dictionary and as numbers.
_MAPS = {codec: {c: bytes([c]).decode(codec, "ignore") for c in range(256)} for codec in ("cp1252", "mac_roman")}
_POINTS = {codec: _points(chars.values()) for codec, chars in _MAPS.items()}


#: Fonts that files share, at most so many; what a font's entries may be there.
_FONTS: dict = {}
MOST_FONTS = 64
_OWN = frozenset((int, float, Name))
#: A line of text as most writers set it: font, size, matrix and string.
_N = rb"[\0\t\n\x0c\r ]+([+-]?(?:\d+\.?\d*|\.\d+))"
_TEXT_LINE = re.compile(rb"[\0\t\n\x0c\r ]*BT[\0\t\n\x0c\r ]+/([A-Za-z0-9]+)" + _N + rb"[\0\t\n\x0c\r ]+Tf" + _N * 6 + rb"[\0\t\n\x0c\r ]+Tm[\0\t\n\x0c\r ]*\(([^()\\]*)\)[\0\t\n\x0c\r ]*Tj[\0\t\n\x0c\r ]+ET(?=[\0\t\n\x0c\r ]|\Z)")


_SHOWN = re.compile(rb"[ -~]*")


class Font:
    def __init__(self, pdf: Pdf, head: dict, key: str):
        self._memo: dict[bytes, tuple] = {}
        g = pdf.get
        self.key = key
        sub = g(head.get("Subtype"))
        base = str(g(head.get("BaseFont")) or g(head.get("Name")) or "")
        self.name = re.sub(r"^[A-Z]{6}\+", "", base)
        self.vertical, self.codec, self.two, self.map, self.lengths = False, None, False, {}, {1}
        self.unit, self.points, self._table, self._scaled, self.plain = 0.001, None, None, {}, False
        tu = g(head.get("ToUnicode"))
        self.to_unicode = {}
        if isinstance(tu, Stream):
            self.to_unicode, lengths = parse_cmap(pdf.stream(tu))
            if sub == "Type0" and lengths:
                self.lengths = lengths
        desc = g(head.get("FontDescriptor")) or {}
        self.widths: dict[int, float] = {}
        self.default: float | None = None
        if sub == "Type0":
            kid = g((g(head.get("DescendantFonts")) or [{}])[0]) or {}
            desc = g(kid.get("FontDescriptor")) or {}
            enc = g(head.get("Encoding"))
            name = str(enc) if isinstance(enc, Name) else str(g(enc.head.get("CMapName")) or "") if isinstance(enc, Stream) else ""
            self.vertical = name.endswith("V")
            self.codec = next((c for part, c in _CODECS if part in name), None)
            self.two = self.codec in (None, "utf-16-be")
            self.default = float(g(kid.get("DW", 1000)) or 1000)
            w = g(kid.get("W")) or []
            i = 0
            w = [g(x) for x in w]
            while i + 1 < len(w):
                if isinstance(w[i + 1], list):
                    for k, v in enumerate(w[i + 1]):
                        self.widths[int(w[i]) + k] = float(g(v))
                    i += 2
                elif i + 2 < len(w):
                    for c in range(int(w[i]), min(int(w[i + 1]), int(w[i]) + 0xFFFF) + 1):
                        self.widths[c] = float(w[i + 2])
                    i += 3
                else:
                    break
        else:
            first = int(g(head.get("FirstChar", 0)) or 0)
            for k, v in enumerate(g(head.get("Widths")) or []):
                if type(v) is int or isinstance(v := g(v), (int, float)):
                    self.widths[first + k] = float(v)
            enc = g(head.get("Encoding"))
            basis = enc if isinstance(enc, Name) else g(enc.get("BaseEncoding")) if isinstance(enc, dict) else None
            codec = {"MacRomanEncoding": "mac_roman"}.get(basis, "cp1252")
            self.map = dict(_MAPS[codec])
            self.points = _POINTS[codec] if not self.to_unicode and not isinstance(enc, dict) and basis != "StandardEncoding" else None
            if basis is None or basis == "StandardEncoding":
                self.map |= {0x27: "’", 0x60: "‘"} if basis == "StandardEncoding" else {}
            if isinstance(enc, dict):
                c = 0
                for d in g(enc.get("Differences")) or []:
                    if isinstance(d := g(d), int):
                        c = d
                    elif isinstance(d, Name):
                        self.map[c] = glyph_name(d)
                        c += 1
            if sub == "Type3":
                fm = [float(g(x)) for x in g(head.get("FontMatrix")) or [0.001, 0, 0, 0.001, 0, 0]]
                self.unit = abs(fm[0]) or 0.001
        low, flags = self.name.lower(), g(desc.get("Flags")) if isinstance(desc, dict) else 0
        flags = flags if isinstance(flags, int) else 0
        self.flags = (ITALIC if flags & 64 or "italic" in low or "oblique" in low else 0) | (SERIF if flags & 2 or "times" in low or "serif" in low and "sans" not in low else 0) | (MONO if flags & 1 or "courier" in low or "mono" in low else 0) | (BOLD if flags & (1 << 18) or "bold" in low or "black" in low else 0)

    def _known(self, c: bytes) -> tuple[bytes, str, float | None]:
        """Code, text and advance in text space (or None) of a character; each is looked up once."""
        if (got := self._memo.get(c)) is None:
            num = int.from_bytes(c, "big")
            text = self.to_unicode.get(c)
            if text is None:
                text = self.map.get(num, "") if self.map else c.decode(self.codec, "ignore") if self.codec else ""
            w = self.widths.get(num, self.default)
            if w is None and text:
                w = standard_width(self.name, text[0])
            got = self._memo[c] = (c, text, None if w is None else w * self.unit)
        return got

    def table(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Characters (NO_CHAR: none or several) and advances in text space (NaN: unknown) of all codes of a simple font; None for others."""
        if self._table is None and self.codec is None and not self.two:
            if self.points is None:
                self.points = _points(self._known(bytes([c]))[1] for c in range(256))
            w = np.full(256, np.nan)
            some = [c for c in self.widths if 0 <= c < 256]
            w[some] = [self.widths[c] for c in some]
            w *= self.unit
            if len(some) < 256:
                for c in np.flatnonzero(np.isnan(w)).tolist():
                    got = self._known(bytes([c]))[2]
                    w[c] = np.nan if got is None else got
            self._table = self.points, w
            # Codes of 32 to 126 stand for themselves, and all widths are known.
            self.plain = bool((self.points[32:127] == np.arange(32, 127)).all()) and not np.isnan(w).any()
        return self._table

    def plain_text(self, raw: bytes, codes: np.ndarray) -> str | None:
        """The text of a string, where each of its codes is one character."""
        if _SHOWN.fullmatch(raw):
            return raw.decode("ascii")
        chars = self.points[codes]
        return None if (chars == NO_CHAR).any() else chars.tobytes().decode("utf-32-le", "surrogatepass")

    def scaled(self, size: float) -> np.ndarray:
        """Advances of all codes at a size."""
        if (got := self._scaled.get(size)) is None:
            if len(self._scaled) >= MOST_FONTS:
                self._scaled.clear()
            got = self._scaled[size] = self.table()[1] * size
        return got

    def codes(self, raw: bytes):
        """(code bytes, text, advance in text space or None) of each character."""
        if self.codec is None and not self.two:
            for i in range(len(raw)):
                yield self._known(raw[i : i + 1])
            return
        i = 0
        while i < len(raw):
            if self.codec is not None and not self.two:
                n = 2 if raw[i] >= 0x81 and not 0xA0 <= raw[i] <= 0xDF or raw[i] >= 0xE0 and self.codec == "cp932" else 1
            else:
                n = 2
            if self.lengths != {1} and not self.codec and self.two:
                n = max(self.lengths)
                for k in sorted(self.lengths):
                    if raw[i : i + k] in self.to_unicode:
                        n = k
                        break
            c = raw[i : i + n]
            i += max(n, 1)
            yield self._known(c)


class Frame:
    """Display geometry of a page: normalised crop box and rotation."""

    def __init__(self, pdf: Pdf, page: dict):
        box = lambda k: [float(pdf.get(v)) for v in pdf.get(page[k])] if isinstance(pdf.get(page.get(k)), list) and len(pdf.get(page[k])) == 4 else None
        x0, y0, x1, y1 = box("CropBox") or box("MediaBox") or NATIVE_A4
        self.x0, self.x1, self.y0, self.y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
        r = pdf.get(page.get("Rotate"))
        self.rotation = int(r) % 360 if isinstance(r, (int, float)) else 0
        w, h = self.x1 - self.x0, self.y1 - self.y0
        self.width, self.height = (h, w) if self.rotation in (90, 270) else (w, h)
        self.matrix = {
            0: (1, 0, 0, -1, -self.x0, self.y1),
            90: (0, 1, 1, 0, -self.y0, -self.x0),
            180: (-1, 0, 0, 1, self.x1, -self.y0),
            270: (0, -1, -1, 0, self.y1, self.x1),
        }.get(self.rotation, (1, 0, 0, -1, -self.x0, self.y1))


def as_rule(x0: float, y0: float, x1: float, y1: float):
    """An axis-aligned stroked segment in order, or None."""
    if abs(y0 - y1) <= TABLE_AXIS_TOLERANCE and abs(x1 - x0) >= MIN_TABLE_RULE_LENGTH:
        y = (y0 + y1) / 2
        return min(x0, x1), y, max(x0, x1), y, True
    if abs(x0 - x1) <= TABLE_AXIS_TOLERANCE and abs(y1 - y0) >= MIN_TABLE_RULE_LENGTH:
        x = (x0 + x1) / 2
        return x, min(y0, y1), x, max(y0, y1), False
    return None


def filled_rule(points: list[tuple[float, float]]):
    """The centre line of a thin filled rectangle (its corners), or None."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    w, h = max(xs) - min(xs), max(ys) - min(ys)
    long_, thin = max(w, h), min(w, h)
    if thin > MAX_FILLED_RULE_THICKNESS or long_ < MIN_TABLE_RULE_LENGTH or long_ < MIN_FILLED_RULE_ASPECT * max(thin, 1e-9):
        return None
    if w >= h:
        y = (min(ys) + max(ys)) / 2
        return min(xs), y, max(xs), y, True
    x = (min(xs) + max(xs)) / 2
    return x, min(ys), x, max(ys), False


class Page:
    """glyphs: (text, x, y, size, advance, dir_x, dir_y, wmode, font_key, font, flags); rules: (x0, y0, x1, y1, horizontal); images: (width, height, bbox, ext, bytes); fills: for rendering."""

    def __init__(self, pdf: Pdf, page: dict):
        self.pdf, self.page, self.frame = pdf, page, Frame(pdf, page)
        self.runs, self.rules, self.images, self.fills, self.warnings = [], [], [], [], []
        self.fonts: dict = {}
        content = pdf.get(page.get("Contents"))
        parts = content if isinstance(content, list) else [content]
        data = b"\n".join(pdf.stream(s) for p in parts if isinstance(s := pdf.get(p), Stream))
        self._run(data, pdf.get(page.get("Resources")) or {}, self.frame.matrix, 0)
        self.rules = self.rules[:MAX_TABLE_RULES]

    def columns(self) -> Glyphs:
        """All glyphs, as arrays."""
        return Glyphs.of_runs(self.runs)

    @property
    def glyphs(self) -> list[tuple]:
        """All glyphs, as tuples."""
        return list(zip(*self.columns().lists().values()))

    def _font(self, res: dict, name):
        fonts = self.pdf.get(res.get("Font")) or {}
        ref = fonts.get(name)
        key = f"{ref.num}" if hasattr(ref, "num") else f"{name}"
        known = self.pdf.fonts if hasattr(ref, "num") else self.fonts  # a page's own, or the file's
        if key not in known:
            head = self.pdf.get(ref)
            known[key] = self._made(head, key) if isinstance(head, dict) else None
        return known[key]

    def _made(self, head: dict, key: str) -> Font:
        """The font; one that refers to nothing else is kept for other files that have it too."""
        if not all(type(v) in _OWN or type(v) is list and _OWN.issuperset(map(type, v)) for v in head.values()):
            return Font(self.pdf, head, key)
        mark = key, repr(head)
        if mark not in _FONTS:
            if len(_FONTS) >= MOST_FONTS:
                _FONTS.clear()
            _FONTS[mark] = Font(self.pdf, head, key)
        return _FONTS[mark]

    def _run(self, data: bytes, res: dict, ctm, depth: int) -> None:
        if depth > 12:
            return
        g, lex, args, stack = self.pdf.get, Lexer(data), [], []
        gs = {"ctm": ctm, "font": None, "size": 0.0, "tc": 0.0, "tw": 0.0, "th": 1.0, "tl": 0.0, "rise": 0.0, "fill": (0.0, 0.0, 0.0), "stroke": (0.0, 0.0, 0.0), "lw": 1.0}
        tm = tlm = (1, 0, 0, 1, 0, 0)
        path: list[list] = []
        curved = False
        num = lambda n: [float(a) if isinstance(a, (int, float)) else 0.0 for a in ([0.0] * n + args)[-n:]]
        while True:
            while not args and (m := _TEXT_LINE.match(data, lex.pos)):
                name, size, *matrix, shown = m.groups()
                lex.pos = m.end()
                gs["font"], gs["size"] = self._font(res, Name(name.decode())), float(size)
                tlm = tuple(map(float, matrix))
                tm = self._show([shown], gs, tlm)
            t = lex.next()
            if t is None:
                return
            if not isinstance(t, Op):
                args.append(t)
                if len(args) > 512:
                    args = args[-64:]
                continue
            op = bytes(t)
            if op == b"q":
                stack.append(dict(gs))
            elif op == b"Q":
                gs = stack.pop() if stack else gs
            elif op == b"cm":
                gs["ctm"] = mul(num(6), gs["ctm"])
            elif op == b"BT":
                tm = tlm = (1, 0, 0, 1, 0, 0)
            elif op == b"Tf":
                gs["font"], gs["size"] = (self._font(res, args[-2]) if len(args) > 1 else None), num(1)[0]
            elif op in (b"Tc", b"Tw", b"TL"):
                gs[{b"Tc": "tc", b"Tw": "tw", b"TL": "tl"}[op]] = num(1)[0]
            elif op == b"Tz":
                gs["th"] = num(1)[0] / 100
            elif op == b"Ts":
                gs["rise"] = num(1)[0]
            elif op in (b"Td", b"TD"):
                x, y = num(2)
                gs["tl"] = -y if op == b"TD" else gs["tl"]
                tm = tlm = mul((1, 0, 0, 1, x, y), tlm)
            elif op == b"Tm":
                tm = tlm = tuple(num(6))
            elif op == b"T*":
                tm = tlm = mul((1, 0, 0, 1, 0, -gs["tl"]), tlm)
            elif op in (b"Tj", b"'", b'"', b"TJ"):
                if op == b'"' and len(args) > 2:
                    gs["tw"], gs["tc"] = (float(a) if isinstance(a, (int, float)) else 0.0 for a in args[-3:-1])
                if op in (b"'", b'"'):
                    tm = tlm = mul((1, 0, 0, 1, 0, -gs["tl"]), tlm)
                if args:
                    tm = self._show(args[-1] if op == b"TJ" and isinstance(args[-1], list) else [args[-1]], gs, tm)
            elif op in (b"m", b"l"):
                p = at(gs["ctm"], *num(2))
                if op == b"m" or not path:
                    path.append([p])
                else:
                    path[-1].append(p)
            elif op in (b"c", b"v", b"y"):
                curved = True
                v = num(6 if op == b"c" else 4)
                if path:
                    path[-1].append(at(gs["ctm"], v[-2], v[-1]))
            elif op == b"h":
                if path and path[-1]:
                    path[-1].append(path[-1][0])
            elif op == b"re":
                x, y, w, h = num(4)
                path.append([at(gs["ctm"], *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))])
            elif op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"n"):
                if op in (b"s", b"b", b"b*") and path and path[-1]:
                    path[-1].append(path[-1][0])
                self._paint(path, curved, op, gs)
                path, curved = [], False
            elif op in (b"rg", b"RG"):
                gs["fill" if op == b"rg" else "stroke"] = tuple(num(3))
            elif op in (b"g", b"G"):
                gs["fill" if op == b"g" else "stroke"] = (num(1)[0],) * 3
            elif op in (b"k", b"K"):
                c, m, y, k = num(4)
                gs["fill" if op == b"k" else "stroke"] = tuple((1 - v) * (1 - k) for v in (c, m, y))
            elif op == b"w":
                gs["lw"] = num(1)[0]
            elif op == b"Do" and args:
                x = g((g(res.get("XObject")) or {}).get(args[-1]))
                if isinstance(x, Stream):
                    kind = g(x.head.get("Subtype"))
                    if kind == "Form":
                        m = [float(g(v)) for v in g(x.head.get("Matrix")) or (1, 0, 0, 1, 0, 0)]
                        self._run(self.pdf.stream(x), g(x.head.get("Resources")) or res, mul(m, gs["ctm"]), depth + 1)
                    elif kind == "Image":
                        self._image(x, gs)
            elif op == b"BI":
                end = re.compile(rb"[\s]EI(?=[\s]|\Z)").search(data, lex.pos)
                lex.pos = end.end() if end else len(data)
            args = []

    def _show(self, items, gs, tm):
        font, size, th = gs["font"], gs["size"], gs["th"]
        for it in items:
            if isinstance(it, (int, float)):
                shift = -it / 1000 * size
                tm = mul((1, 0, 0, 1, 0, shift) if font is not None and font.vertical else (1, 0, 0, 1, shift * th, 0), tm)
                continue
            if not isinstance(it, bytes) or font is None:
                continue
            # Only the origin moves along a string: the linear part, and what follows from it, stays.
            ctm, rise = gs["ctm"], gs["rise"]
            m = mul((size * th, 0, 0, size, 0, rise), mul(tm, ctm))
            up, across = math.hypot(m[2], m[3]), math.hypot(m[0], m[1])
            high = up if math.isfinite(up) and up > 0 else 12.0
            dx, dy = (m[0] / across, m[1] / across) if across > 0 else (1.0, 0.0)
            if font.vertical:
                dx, dy = -m[2] / up if up else 0.0, -m[3] / up if up else 1.0
            dx, dy = 0.0 if abs(dx) < 1e-9 else dx, 0.0 if abs(dy) < 1e-9 else dy
            t2, t3 = tm[2] * ctm[0] + tm[3] * ctm[2], tm[2] * ctm[1] + tm[3] * ctm[3]
            a, b, c, d, e, f = tm
            tail = (dx, dy, int(font.vertical), font.key, font.name, font.flags)
            if len(it) >= SHORT and not font.vertical and (table := font.table()) is not None:
                e, f = self._show_string(it, table, gs, (a, b, e, f), (t2, t3), high, across, tail)
                tm = (a, b, c, d, e, f)
                continue
            out = []
            for code, text, w in font.codes(it):
                if text:
                    x, y = rise * t2 + (e * ctm[0] + f * ctm[2] + ctm[4]), rise * t3 + (e * ctm[1] + f * ctm[3] + ctm[5])
                    out.append((text, x, y, high if font.vertical else w * across if w is not None else 0.5 * high))
                step = gs["tc"] + (gs["tw"] if code == b" " else 0.0)
                if font.vertical:
                    down = -size - step
                    e, f = down * c + e, down * d + f
                else:
                    along = ((w if w is not None else 0.5) * size + step) * th
                    e, f = along * a + e, along * b + f
            if out:
                texts, *numbers = zip(*out)
                x, y, advance = (np.array(v, np.float64) for v in numbers)
                self.runs.append(("".join(texts) if all(len(t) == 1 for t in texts) else texts, x, y, high, advance, tail))
            tm = (a, b, c, d, e, f)
        return tm

    def _show_string(self, raw: bytes, table, gs, origin, rises, high: float, across: float, tail) -> tuple[float, float]:
        """A string of a simple font, set at once: the loop of `_show` on arrays, sums in the same order. Gives the origin behind it."""
        (points, widths), (a, b, e, f), (ctm, rise, size, th) = table, origin, (gs[k] for k in ("ctm", "rise", "size", "th"))
        codes = np.frombuffer(raw, np.uint8)
        font = gs["font"]
        if font.plain and not b and not ctm[1] and not gs["tc"] and not gs["tw"] and th == 1.0 and a == 1.0 and across == size and (text := font.plain_text(raw, codes)) is not None:
            # The common case of what follows, without the steps that change nothing there.
            along = font.scaled(size)[codes]
            es = np.concatenate(([e], along)).cumsum()
            x, y = rise * rises[0] + (es[:-1] * ctm[0] + f * ctm[2] + ctm[4]), rise * rises[1] + (f * ctm[3] + ctm[5])
            self.runs.append((text, x, y, high, along, tail))
            return float(es[-1]), f
        w = widths[codes]
        unknown = np.isnan(w)
        half = bool(unknown.any())
        step = gs["tc"] + np.where(codes == 32, gs["tw"], 0.0) if gs["tw"] else gs["tc"]
        along = ((np.where(unknown, 0.5, w) if half else w) * size + step) * th
        es = np.concatenate(([e], along * a)).cumsum()
        fs = np.concatenate(([f], along * b)).cumsum() if b else f
        e, f = float(es[-1]), float(fs[-1]) if b else f
        es, fs = es[:-1], fs[:-1] if b else fs
        x = rise * rises[0] + (es * ctm[0] + fs * ctm[2] + ctm[4])
        y = rise * rises[1] + (es * ctm[1] + fs * ctm[3] + ctm[5]) if b or ctm[1] else rise * rises[1] + (fs * ctm[3] + ctm[5])
        advance = np.where(unknown, 0.5 * high, w * across) if half else w * across
        chars = points[codes]
        if (chars == NO_CHAR).any():
            texts = [text for _, text, _ in font.codes(raw)]
            keep = [i for i, t in enumerate(texts) if t]
            y = y[keep] if isinstance(y, np.ndarray) else y
            x, advance, texts = x[keep], advance[keep], [texts[i] for i in keep]
            text = "".join(texts) if all(len(t) == 1 for t in texts) else texts
        else:
            text = chars.tobytes().decode("utf-32-le", "surrogatepass")
        if len(text):
            self.runs.append((text, x, y, high, advance, tail))
        return e, f

    def _paint(self, path, curved, op, gs) -> None:
        if op in (b"S", b"s", b"B", b"B*", b"b", b"b*") and not curved:
            for sub in path:
                for (x0, y0), (x1, y1) in zip(sub, sub[1:]):
                    if r := as_rule(x0, y0, x1, y1):
                        self.rules.append(r)
        if op not in (b"S", b"s", b"n"):
            for sub in path:
                if not curved and len(sub) >= 4 and (r := filled_rule(sub)):
                    self.rules.append(r)
                if len(sub) > 2:
                    self.fills.append(("fill", sub, gs["fill"], 0.0))
        if op in (b"S", b"s", b"B", b"B*", b"b", b"b*"):
            scale = math.sqrt(abs(gs["ctm"][0] * gs["ctm"][3] - gs["ctm"][1] * gs["ctm"][2]))
            self.fills += [("stroke", sub, gs["stroke"], gs["lw"] * scale) for sub in path]

    def _image(self, x: Stream, gs) -> None:
        g = self.pdf.get
        w, h = int(g(x.head.get("Width")) or 0), int(g(x.head.get("Height")) or 0)
        pts = [at(gs["ctm"], *p) for p in ((0, 0), (1, 0), (0, 1), (1, 1))]
        box = (min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts))
        try:
            data, stop = decode(self.pdf, x, self.pdf.limit, until_image=True)
            if stop == "DCTDecode":
                self.images.append((w, h, box, "jpeg", data))
                return
            if stop:
                raise PdfFault(f"no decoder for {stop}")
            rgb = samples(self.pdf, x.head, data, w, h)
            self.images.append((w, h, box, "png", png(w, h, rgb[0], rgb[1], 6)))
            self.fills.append(("image", pts, (w, h, *rgb), 0.0))
        except (PdfFault, ValueError, IndexError, struct.error) as e:
            self.warnings.append(f"an image was left out: {e}")


def samples(pdf: Pdf, head: dict, data: bytes, w: int, h: int) -> tuple[bytes, int]:
    """8-bit samples of an image and their number of channels (1 or 3)."""
    g = pdf.get
    space, bpc = g(head.get("ColorSpace")), int(g(head.get("BitsPerComponent", 8)) or 8)
    if g(head.get("ImageMask")) is True:
        space, bpc = "DeviceGray", 1
    palette = None
    if isinstance(space, list):
        kind = g(space[0])
        if kind in ("Indexed", "I"):
            base = g(space[1])
            base = g(base[0]) if isinstance(base, list) else base
            look = g(space[3])
            palette = (pdf.stream(look) if isinstance(look, Stream) else look, 1 if base in ("DeviceGray", "CalGray", "G") else 3)
            space = "Indexed"
        elif kind == "ICCBased":
            space = {1: "DeviceGray", 4: "DeviceCMYK"}.get(g(g(space[1]).head.get("N")), "DeviceRGB")
        else:
            space = {"CalGray": "DeviceGray", "Separation": "DeviceGray"}.get(kind, "DeviceRGB")
    n = {"DeviceGray": 1, "G": 1, "Indexed": 1, "DeviceCMYK": 4, "CMYK": 4}.get(space, 3)
    if bpc == 16:
        data, bpc = data[::2], 8
    if bpc < 8:
        row, top, out = (w * n * bpc + 7) // 8, (1 << bpc) - 1, bytearray()
        scale = 1 if palette else 255 // top
        for y in range(h):
            line = data[y * row : (y + 1) * row]
            out += bytes(((line[i * bpc // 8] >> (8 - bpc - i * bpc % 8)) & top) * scale for i in range(min(w * n, len(line) * 8 // bpc)))
        data = bytes(out)
    if palette:
        look, k = palette
        return b"".join(look[i * k : i * k + k].ljust(k, b"\0") for i in data[: w * h]), k
    if n == 4:
        return bytes(v for i in range(0, w * h * 4, 4) for v in (((255 - data[i + j]) * (255 - data[i + 3])) // 255 for j in range(3))), 3
    if len(data) < w * h * n:
        raise PdfFault("the image is cut short")
    return data[: w * h * n], n


def png(w: int, h: int, pixels: bytes, channels: int, level: int = 6) -> bytes:
    """An 8-bit PNG of gray (1), RGB (3) or RGBA (4) rows."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    row = w * channels
    raw = b"".join(b"\0" + pixels[y * row : (y + 1) * row] for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def unpng(data: bytes) -> tuple[int, int, bytes, bytes | None]:
    """Width, height, RGB or gray samples and alpha of a PNG (no interlace)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise PdfFault("no PNG")
    i, body, plte, trns, head = 8, b"", b"", None, None
    while i + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[i : i + 8])
        part = data[i + 8 : i + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        body += part if kind == b"IDAT" else b""
        plte = part if kind == b"PLTE" else plte
        trns = part if kind == b"tRNS" else trns
        i += 12 + n
    if head is None or head[6]:
        raise PdfFault("an interlaced or broken PNG")
    w, h, depth, color = head[:4]
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = _unpredict(zlib.decompress(body), {"Predictor": 15, "Colors": n, "BitsPerComponent": depth, "Columns": w})
    if depth == 16:
        raw = raw[::2]
    elif depth < 8:
        row, top, out = (w * n * depth + 7) // 8, (1 << depth) - 1, bytearray()
        for y in range(h):
            out += bytes(((raw[y * row + x * depth // 8] >> (8 - depth - x * depth % 8)) & top) * (1 if color == 3 else 255 // top) for x in range(w))
        raw = bytes(out)
    if color == 3:
        alpha = bytes(trns[c] if trns and c < len(trns) else 255 for c in raw) if trns else None
        return w, h, b"".join(plte[3 * c : 3 * c + 3] for c in raw), alpha
    if color in (4, 6):
        return w, h, bytes(v for k, v in enumerate(raw) if k % n != n - 1), raw[n - 1 :: n]
    return w, h, raw, None


def jpeg_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and components from the frame header."""
    if data[:2] != b"\xff\xd8":
        raise PdfFault("no JPEG")
    i = 2
    while i + 9 < len(data):
        if data[i] != 0xFF:
            i += 1
            continue
        kind = data[i + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[i + 7 : i + 9], "big"), int.from_bytes(data[i + 5 : i + 7], "big"), data[i + 9]
        i += 2 if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD9 else 2 + int.from_bytes(data[i + 2 : i + 4], "big")
    raise PdfFault("no frame header")


def info(pdf: Pdf) -> dict[str, str]:
    """The eight entries of the information dictionary and the format."""
    d = pdf.get(pdf.trailer.get("Info"))
    d = d if isinstance(d, dict) else {}
    keys = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer", "creationDate": "CreationDate", "modDate": "ModDate"}
    return {k: text_of(pdf.get(d.get(v))) if d.get(v) is not None and pdf.get(d.get(v)) is not Null else "" for k, v in keys.items()} | {"format": f"PDF {pdf.version}"}
