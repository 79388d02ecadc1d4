"""Writing PDF files: serialization of object graphs, with pruning, compression, object streams and AES-256 encryption; and drafts, editable object graphs."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib

from vellumtide.errors import PdfFault
from vellumtide.sources.pdfobjects import Aes, Name, Null, Pdf, Ref, Stream, decode, hash_r6, text_of

#: Objects in an object stream (fixed value).
PER_OBJECT_STREAM = 100
#: Names that are written as they are; what refers to nothing.
_SAFE = re.compile("[!\"$&'*-.0-;=?-Z\\\\^-z|~]*")
_PLAIN = frozenset((int, float, bool, bytes, str, Name, type(None)))


def number(x: float) -> str:
    """At most four decimals, no trailing zeros."""
    s = f"{x:.4f}".rstrip("0").rstrip(".")
    return "0" if s in ("-0", "") else s


def text_string(s: str) -> bytes:
    try:
        return s.encode("ascii")
    except UnicodeEncodeError:
        return b"\xfe\xff" + s.encode("utf-16-be")


def ser(o, seal=None) -> bytes:
    if o is None or o is Null:
        return b"null"
    if isinstance(o, bool):
        return b"true" if o else b"false"
    if isinstance(o, Name):
        if _SAFE.fullmatch(o):
            return b"/" + o.encode()
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in o.encode("latin-1", "replace"))
    if isinstance(o, int):
        return str(o).encode()
    if isinstance(o, float):
        return number(o).encode()
    if isinstance(o, str):
        o = text_string(o)
    if isinstance(o, bytes):
        if seal:
            return b"<" + seal(o).hex().encode() + b">"
        return b"(" + o.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"
    if isinstance(o, Ref):
        return f"{o.num} {o.gen} R".encode()
    if isinstance(o, (list, tuple)):
        if len(o) > 8 and set(map(type, o)) == {int}:
            return b"[" + " ".join(map(str, o)).encode() + b"]"
        return b"[" + b" ".join(ser(v, seal) for v in o) + b"]"
    if isinstance(o, dict):
        return b"<<" + b" ".join(ser(Name(k)) + b" " + ser(v, seal) for k, v in o.items() if not k.startswith("_")) + b">>"
    raise PdfFault(f"can't write a {type(o).__name__}")


def _body(o, seal=None) -> bytes:
    if isinstance(o, Stream):
        raw = seal(o.raw) if seal else o.raw
        return ser(o.head | {"Length": len(raw)}, seal) + b"\nstream\n" + raw + b"\nendstream"
    return ser(o, seal)


class Seal:
    """AES-256 (V5, R6): key and dictionary from passwords and permissions."""

    def __init__(self, user: str, owner: str | None, permissions: int = -4, rng=os.urandom):
        u, o = user.encode()[:127], (owner or user).encode()[:127]
        self.key, s = rng(32), [rng(8) for _ in range(4)]
        self.rng = rng
        U = hash_r6(u, s[0]) + s[0] + s[1]
        UE = Aes(hash_r6(u, s[1])).encrypt(self.key, bytes(16))
        O = hash_r6(o, s[2], U) + s[2] + s[3]  # noqa: E741
        OE = Aes(hash_r6(o, s[3], U)).encrypt(self.key, bytes(16))
        p = struct.pack("<i", permissions) + b"\xff" * 4 + b"Tadb" + rng(4)
        self.head = {"Filter": Name("Standard"), "V": 5, "R": 6, "Length": 256, "P": permissions, "U": U, "UE": UE, "O": O, "OE": OE, "Perms": Aes(self.key).encrypt(p, bytes(16)), "EncryptMetadata": True, "CF": {"StdCF": {"CFM": Name("AESV3"), "AuthEvent": Name("DocOpen"), "Length": 32}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}

    def __call__(self, data: bytes) -> bytes:
        iv, n = self.rng(16), 16 - len(data) % 16
        return iv + Aes(self.key).encrypt(data + bytes([n]) * n, iv)


def reachable(objects: dict[int, object], start: list) -> set[int]:
    seen: set[int] = set()
    stack = list(start)
    while stack:
        o = stack.pop()
        if isinstance(o, Ref):
            if o.num not in seen and o.num in objects:
                seen.add(o.num)
                stack.append(objects[o.num])
        elif isinstance(o, (list, tuple)):
            if not _PLAIN.issuperset(map(type, o)):
                stack += o
        elif isinstance(o, dict):
            stack += o.values()
        elif isinstance(o, Stream):
            stack += o.head.values()
    return seen


def write(objects: dict[int, object], root: Ref, info: Ref | None, version: str = "1.7", garbage: bool = False, deflate: bool = False, object_streams: bool = False, seal: Seal | None = None) -> bytes:
    if seal and object_streams:
        raise PdfFault("an encrypted file takes no object streams here")
    keep = reachable(objects, [root, *([info] if info else [])]) if garbage else set(objects)
    objs = {n: objects[n] for n in sorted(keep)}
    if deflate:
        for n, o in objs.items():
            if isinstance(o, Stream) and "Filter" not in o.head:
                objs[n] = Stream(o.head | {"Filter": Name("FlateDecode")}, zlib.compress(o.raw), n)
    out, where, packed = bytearray(f"%PDF-{version}\n%\xe2\xe3\xcf\xd3\n".encode("latin-1")), {}, {}
    top = max(objs, default=0)
    if object_streams:
        plain = [n for n, o in objs.items() if not isinstance(o, Stream)]
        for k in range(0, len(plain), PER_OBJECT_STREAM):
            top += 1
            group, heads, body = plain[k : k + PER_OBJECT_STREAM], [], bytearray()
            for i, n in enumerate(group):
                heads.append(f"{n} {len(body)}")
                body += ser(objs.pop(n)) + b" "
                packed[n] = (top, i)
            first = (" ".join(heads) + " ").encode()
            objs[top] = Stream({"Type": Name("ObjStm"), "N": len(group), "First": len(first), "Filter": Name("FlateDecode")}, zlib.compress(first + bytes(body), 6))
    for n, o in objs.items():
        where[n] = len(out)
        out += f"{n} 0 obj\n".encode() + _body(o, seal) + b"\nendobj\n"
    tail = {"Root": root} | ({"Info": info} if info else {})
    if seal:
        top += 1
        where[top] = len(out)
        out += f"{top} 0 obj\n".encode() + ser(seal.head) + b"\nendobj\n"
        tail |= {"Encrypt": Ref(top), "ID": [b"vellumtide-id-00"] * 2}
    start = len(out)
    if object_streams:
        top += 1
        where[top] = start
        rows = b"\0\0\0\0\0\0\xff\xff" + b"".join(struct.pack(">BIxH", 1, where[n], 0) if n in where else struct.pack(">BIxH", 2, *packed[n]) if n in packed else bytes(8) for n in range(1, top + 1))
        rows = b"".join(rows[i : i + 5] + rows[i + 6 : i + 8] for i in range(0, len(rows), 8))
        x = Stream({"Type": Name("XRef"), "Size": top + 1, "W": [1, 4, 2], "Filter": Name("FlateDecode")} | tail, zlib.compress(rows))
        out += f"{top} 0 obj\n".encode() + _body(x) + b"\nendobj\n"
    else:
        out += f"xref\n0 {top + 1}\n0000000000 65535 f \n".encode()
        out += b"".join(f"{where[n]:010d} 00000 n \n".encode() if n in where else b"0000000000 00000 f \n" for n in range(1, top + 1))
        out += b"trailer\n" + ser({"Size": top + 1} | tail) + b"\n"
    return bytes(out + f"startxref\n{start}\n%%EOF\n".encode())


class Draft:
    """An object graph to edit. Pages are a plain list of dictionaries with inheritance filled in; `save` writes a flat page tree."""

    def __init__(self, data: bytes | None = None, password: str | None = None):
        self.objects: dict[int, object] = {}
        self.pages: list[dict] = []
        self.version, self.root, self.info = "1.7", {"Type": Name("Catalog")}, {}
        if data is not None:
            pdf = Pdf(data, password)
            for n in pdf.objects():
                o = pdf.get(Ref(n))
                if isinstance(o, Stream):
                    if pdf.crypt is not None:
                        raw = o.raw if o.plain else pdf.crypt.decrypt(o.raw, n, 0)
                        o = Stream(o.head, raw, n)
                    if o.head.get("Type") in ("XRef", "ObjStm"):
                        continue
                if o is not Null:
                    self.objects[n] = o
            self.pages = [{k: v for k, v in p.items() if k not in ("_ref", "Parent")} for p in pdf.pages()]
            self.version = pdf.version
            self.root = dict(pdf.get(pdf.trailer["Root"]))
            i = pdf.get(pdf.trailer.get("Info"))
            self.info = dict(i) if isinstance(i, dict) else {}

    def get(self, x):
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x.num, Null)
        return Null

    def add(self, o) -> Ref:
        n = max(self.objects, default=0) + 1
        self.objects[n] = o
        return Ref(n)

    def save(self, garbage: bool = True, deflate: bool = False, object_streams: bool = False, user_pw: str | None = None, owner_pw: str | None = None, permissions: int = -4) -> bytes:
        objs = dict(self.objects)
        n = max(objs, default=0)
        tree = Ref(n + 1)
        kids = []
        for i, p in enumerate(self.pages):
            objs[n + 2 + i] = p | {"Type": Name("Page"), "Parent": tree}
            kids.append(Ref(n + 2 + i))
        n += 2 + len(self.pages)
        objs[tree.num] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
        objs[n] = self._points(self.root, kids) | {"Pages": tree}
        info = None
        if self.info:
            objs[n + 1] = self.info
            info = Ref(n + 1)
        for k, o in list(objs.items()):
            if isinstance(o, dict) and o.get("_pages"):
                objs[k] = self._points(o, kids)
        seal = Seal(user_pw or "", owner_pw, permissions) if user_pw is not None or owner_pw is not None else None
        return write(objs, Ref(n), info, self.version, garbage, deflate, object_streams, seal)

    def _points(self, o, kids):
        """References to pages by number, ('page', i), become references to the written pages."""
        if isinstance(o, tuple) and o[:1] == ("page",):
            return kids[o[1]] if 0 <= o[1] < len(kids) else Null
        if isinstance(o, list):
            return [self._points(v, kids) for v in o]
        if isinstance(o, dict):
            return {k: self._points(v, kids) for k, v in o.items() if k != "_pages"}
        return o


def text_document(pages: list[list[tuple[float, float, float, str]]], width: float = 612.0, heights: list[float] | None = None, title: str = "", object_streams: bool = False) -> bytes:
    """A document of text lines (x, y from the top, size, text), in a font whose every character is half its size wide."""
    d = Draft()
    font = d.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding"), "FirstChar": 0, "LastChar": 255, "Widths": [500] * 256})
    for i, lines in enumerate(pages):
        h = heights[i] if heights else 792.0
        ops = []
        for x, y, size, text in lines:
            raw = ser(text.encode("cp1252", "replace")).decode("latin-1")
            ops.append(f"BT /F1 {number(size)} Tf 1 0 0 1 {number(x)} {number(h - y)} Tm {raw} Tj ET")
        content = d.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress("\n".join(ops).encode("latin-1"), 1)))
        d.pages.append({"MediaBox": [0, 0, float(width), float(h)], "Resources": {"Font": {"F1": font}}, "Contents": content})
    if title:
        d.info = {"Title": text_string(title)}
    return d.save(garbage=False, object_streams=object_streams)


def stamp_id(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


__all__ = ["Draft", "Seal", "decode", "number", "reachable", "ser", "stamp_id", "text_document", "text_of", "text_string", "write"]
