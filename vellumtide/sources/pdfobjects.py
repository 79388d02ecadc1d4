"""PDF syntax: tokens, objects, cross-references, stream filters and encryption, after the public PDF specification.

`Pdf(data)` reads any byte string; damaged cross-references are rebuilt by a scan for object headers.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field

from vellumtide.errors import PasswordRefused, PdfFault

_SPACE = b"\0\t\n\x0c\r "
_STOP = b"()<>[]{}/%"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
#: What stands for itself in a string; an array of whole numbers alone.
_PLAIN = re.compile(rb"[^()\\]*")
_WHOLE = re.compile(rb"\[([\t\n\x0c\r 0-9]*)\]")
#: A whole number, another regular token, or a name, behind what is skipped; what makes a whole number a reference.
_TOKEN = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*(?:([+-]?\d+(?![^\0\t\n\x0c\r ()<>\[\]{}/%]))|([^\0\t\n\x0c\r ()<>\[\]{}/%]+)|/([^\0\t\n\x0c\r ()<>\[\]{}/%]*)|)")
_REF = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*(\+?\d+)(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%])")
_OCTAL, _HEX = re.compile(rb"[0-7]{1,3}"), re.compile(rb"#([0-9A-Fa-f]{2})")
_MAX_DEPTH = 64


class Name(str):
    """A PDF name without its slash."""

    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int = 0


@dataclass
class Stream:
    head: dict
    raw: bytes
    owner: int = 0
    plain: bool = False


class Op(bytes):
    """A keyword."""

    __slots__ = ()


class Lexer:
    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def _string(self) -> bytes:
        d, i, out, depth = self.data, self.pos + 1, bytearray(), 1
        while i < len(d):
            m = _PLAIN.match(d, i)
            out += m[0]
            i = m.end()
            if i >= len(d):
                break
            c = d[i]
            if c == 0x5C:
                i += 1
                e = d[i : i + 1]
                if e in b"nrtbf" and e:
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}[e]
                elif e.isdigit() and e < b"8":
                    m = _OCTAL.match(d, i)
                    out.append(int(m[0], 8) & 255)
                    i = m.end() - 1
                elif e == b"\r":
                    i += d[i + 1 : i + 2] == b"\n"
                elif e != b"\n":
                    out += e
            elif c == 0x28:
                depth += 1
                out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.pos = i + 1
                    return bytes(out)
                out.append(c)
            i += 1
        self.pos = i
        return bytes(out)

    def next(self, depth: int = 0):
        """The next object or keyword; None at the end."""
        if depth > _MAX_DEPTH:
            raise PdfFault("objects are nested too deeply")
        d = self.data
        m = _TOKEN.match(d, self.pos)
        self.pos = i = m.end()
        kind = m.lastindex
        if kind == 1:
            return int(m[1])
        if kind == 2:
            t = m[2]
            if _NUMBER.match(t):
                return float(t)
            if t in (b"true", b"false"):
                return t == b"true"
            return Null if t == b"null" else Op(t)
        if kind == 3:
            raw = m[3]
            return Name((_HEX.sub(lambda x: bytes([int(x[1], 16)]), raw) if b"#" in raw else raw).decode("latin-1"))
        if i >= len(d):
            return None
        c = d[i : i + 1]
        if c == b"(":
            return self._string()
        if d[i : i + 2] == b"<<":
            self.pos = i + 2
            out = {}
            while True:
                k = self.next(depth + 1)
                if k is None or k == b">>" and isinstance(k, Op):
                    return out
                v = self.value(depth + 1)
                if isinstance(v, Op):
                    if v == b">>":
                        return out
                    continue
                if isinstance(k, Name):
                    out[k] = v
        if d[i : i + 2] == b">>":
            self.pos = i + 2
            return Op(b">>")
        if c == b"<":
            end = d.find(b">", i)
            end = len(d) if end < 0 else end
            self.pos = end + 1
            h = re.sub(rb"[^0-9A-Fa-f]", b"", d[i + 1 : end])
            return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
        if c == b"[":
            if m := _WHOLE.match(d, i):
                self.pos = m.end()
                return [int(v) for v in m[1].split()]
            self.pos = i + 1
            out = []
            while True:
                v = self.value(depth + 1)
                if v is None and self.pos >= len(d) or isinstance(v, Op) and v == b"]":
                    return out
                if not isinstance(v, Op):
                    out.append(v)
        if c in b"]{})":
            self.pos = i + 1
            return Op(c)
        raise PdfFault("a stray >")

    def value(self, depth: int = 0):
        """Like next, with indirect references recognised."""
        v = self.next(depth)
        if type(v) is int and v >= 0:
            if m := _REF.match(self.data, self.pos):
                self.pos = m.end()
                return Ref(v, int(m[1]))
        return v


class _Null:
    def __repr__(self):
        return "Null"

    def __bool__(self):
        return False


Null = _Null()


# --- ciphers -------------------------------------------------------------------------------------------------------


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _aes_tables():
    """The S-box by its rule: inverses in GF(2^8), then an affine map."""
    p = q = 1
    box = [0] * 256
    while True:
        p = (p ^ (p << 1) ^ (0x1B if p & 0x80 else 0)) & 255
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 255
        if q & 0x80:
            q ^= 0x09
        x = q ^ (q << 1 | q >> 7) ^ (q << 2 | q >> 6) ^ (q << 3 | q >> 5) ^ (q << 4 | q >> 4)
        box[p] = (x ^ 0x63) & 255
        if p == 1:
            break
    box[0] = 0x63
    inv = [0] * 256
    for i, b in enumerate(box):
        inv[b] = i
    return box, inv


_BOX, _INV = _aes_tables()


def _times(a: int, b: int) -> int:
    r = 0
    while b:
        if b & 1:
            r ^= a
        a = (a << 1 ^ (0x11B if a & 0x80 else 0)) & 0x1FF
        b >>= 1
    return r


_MUL = {k: [_times(i, k) for i in range(256)] for k in (2, 3, 9, 11, 13, 14)}


class Aes:
    """AES in CBC mode, for keys of 16 and 32 bytes."""

    def __init__(self, key: bytes):
        n = len(key) // 4
        self.rounds = n + 6
        w, rcon = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
        for i in range(n, 4 * (self.rounds + 1)):
            t = list(w[-1])
            if i % n == 0:
                t = [_BOX[x] for x in t[1:] + t[:1]]
                t[0] ^= rcon
                rcon = _MUL[2][rcon]
            elif n > 6 and i % n == 4:
                t = [_BOX[x] for x in t]
            w.append([a ^ b for a, b in zip(w[i - n], t)])
        self.keys = [sum(w[4 * r : 4 * r + 4], []) for r in range(self.rounds + 1)]

    def block(self, s: bytes) -> bytes:
        two, three = _MUL[2], _MUL[3]
        s = [a ^ b for a, b in zip(s, self.keys[0])]
        for r in range(1, self.rounds + 1):
            s = [_BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if r < self.rounds:
                t = []
                for c in range(0, 16, 4):
                    a, b, d, e = s[c : c + 4]
                    t += [two[a] ^ three[b] ^ d ^ e, a ^ two[b] ^ three[d] ^ e, a ^ b ^ two[d] ^ three[e], three[a] ^ b ^ d ^ two[e]]
                s = t
            s = [a ^ b for a, b in zip(s, self.keys[r])]
        return bytes(s)

    def unblock(self, s: bytes) -> bytes:
        m9, m11, m13, m14 = (_MUL[k] for k in (9, 11, 13, 14))
        s = [a ^ b for a, b in zip(s, self.keys[-1])]
        for r in range(self.rounds - 1, -1, -1):
            s = [_INV[s[(i - 4 * (i % 4)) % 16]] for i in range(16)]
            s = [a ^ b for a, b in zip(s, self.keys[r])]
            if r:
                t = []
                for c in range(0, 16, 4):
                    a, b, d, e = s[c : c + 4]
                    t += [m14[a] ^ m11[b] ^ m13[d] ^ m9[e], m9[a] ^ m14[b] ^ m11[d] ^ m13[e], m13[a] ^ m9[b] ^ m14[d] ^ m11[e], m11[a] ^ m13[b] ^ m9[d] ^ m14[e]]
                s = t
        return bytes(s)

    def encrypt(self, data: bytes, iv: bytes) -> bytes:
        out = []
        for i in range(0, len(data), 16):
            iv = self.block(bytes(a ^ b for a, b in zip(data[i : i + 16], iv)))
            out.append(iv)
        return b"".join(out)

    def decrypt(self, data: bytes, iv: bytes) -> bytes:
        out = []
        for i in range(0, len(data) - 15, 16):
            c = data[i : i + 16]
            out.append(bytes(a ^ b for a, b in zip(self.unblock(c), iv)))
            iv = c
        return b"".join(out)


#: Padding of passwords (fixed value of the specification).
_PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def hash_r6(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    k = hashlib.sha256(password + salt + extra).digest()
    i = 0
    while True:
        e = Aes(k[:16]).encrypt((password + k + extra) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


@dataclass
class Crypt:
    """The standard security handler: password checks and object keys. Codes: 0 refused, 2 user, 4 owner, 6 both."""

    enc: dict
    file_id: bytes
    key: bytes = b""
    code: int = 0
    aes: bool = field(init=False, default=False)

    def __post_init__(self):
        e = self.enc
        self.v, self.r = int(e.get("V", 0) or 0), int(e.get("R", 2))
        self.length = 5 if self.v == 1 else int(e.get("Length", 40) or 40) // 8
        if self.v in (4, 5):
            cf = (e.get("CF") or {}).get(e.get("StmF", "StdCF")) or {}
            self.aes = cf.get("CFM") in ("AESV2", "AESV3")
            self.length = 32 if self.v == 5 else 16

    def _user_key(self, password: bytes) -> bytes:
        e = self.enc
        h = hashlib.md5((password + _PAD)[:32] + e["O"][:32] + (int(e["P"]) & 0xFFFFFFFF).to_bytes(4, "little") + self.file_id)
        if self.r >= 4 and e.get("EncryptMetadata") is False:
            h.update(b"\xff\xff\xff\xff")
        k = h.digest()
        if self.r >= 3:
            for _ in range(50):
                k = hashlib.md5(k[: self.length]).digest()
        return k[: self.length]

    def _is_user(self, key: bytes) -> bool:
        if self.r == 2:
            return rc4(key, _PAD) == self.enc["U"][:32]
        x = rc4(key, hashlib.md5(_PAD + self.file_id).digest())
        for i in range(1, 20):
            x = rc4(bytes(b ^ i for b in key), x)
        return x == self.enc["U"][:16]

    def _owner_to_user(self, password: bytes) -> bytes:
        k = hashlib.md5((password + _PAD)[:32]).digest()
        if self.r >= 3:
            for _ in range(50):
                k = hashlib.md5(k).digest()
        k, o = k[: self.length], self.enc["O"][:32]
        if self.r == 2:
            return rc4(k, o)
        for i in range(19, -1, -1):
            o = rc4(bytes(b ^ i for b in k), o)
        return o

    def open(self, password: str) -> int:
        raw = password.encode("utf-8" if self.v == 5 else "latin-1", "replace")
        code = 0
        if self.v == 5:
            raw, u, o = raw[:127], self.enc["U"][:48], self.enc["O"][:48]
            f = hash_r6 if self.r >= 6 else (lambda p, s, x=b"": hashlib.sha256(p + s + x).digest())
            if f(raw, u[32:40]) == u[:32]:
                code |= 2
                self.key = Aes(f(raw, u[40:48])).decrypt(self.enc["UE"][:32], bytes(16))
            if f(raw, o[32:40], u) == o[:32]:
                code |= 4
                self.key = Aes(f(raw, o[40:48], u)).decrypt(self.enc["OE"][:32], bytes(16))
        else:
            key = self._user_key(raw)
            if self._is_user(key):
                code, self.key = 2, key
            inner = self._user_key(self._owner_to_user(raw))
            if self._is_user(inner):
                code, self.key = code | 4, inner
        self.code |= code
        return code

    def _object_key(self, num: int, gen: int) -> bytes:
        if self.v == 5:
            return self.key
        k = self.key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if self.aes else b"")
        return hashlib.md5(k).digest()[: min(16, self.length + 5)]

    def decrypt(self, data: bytes, num: int, gen: int) -> bytes:
        key = self._object_key(num, gen)
        if not self.aes:
            return rc4(key, data)
        if len(data) < 32:
            return b""
        out = Aes(key).decrypt(data[16:], data[:16])
        return out[: -out[-1]] if out and 1 <= out[-1] <= 16 else out


# --- filters -------------------------------------------------------------------------------------------------------


def _limited(n: int, limit: int | None) -> None:
    if limit is not None and n > limit:
        raise PdfFault(f"a stream decodes to more than {limit} bytes")


def inflate(data: bytes, limit: int | None = None) -> bytes:
    z = zlib.decompressobj()
    try:
        out = z.decompress(data, limit + 1 if limit is not None else 0)
    except zlib.error:
        z, out = zlib.decompressobj(-15), b""
        for skip in (2, 0):
            try:
                out = zlib.decompressobj(-15).decompress(data[skip:], limit + 1 if limit is not None else 0)
                break
            except zlib.error:
                continue
    _limited(len(out), limit)
    return out


def _lzw(data: bytes, limit: int | None, early: int = 1) -> bytes:
    out, table, width, prev, acc, bits = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, b"", 0, 0
    for c in data:
        acc, bits = acc << 8 | c, bits + 8
        while bits >= width:
            code = acc >> (bits - width)
            bits -= width
            acc &= (1 << bits) - 1
            if code == 256:
                del table[258:]
                width, prev = 9, b""
                continue
            if code == 257:
                return bytes(out)
            entry = table[code] if code < len(table) else prev + prev[:1]
            out += entry
            _limited(len(out), limit)
            if prev:
                table.append(prev + entry[:1])
            prev = entry
            n = len(table) + early
            width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    return bytes(out)


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data:
        if c == 0x7E:
            break
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def _run_length(data: bytes, limit: int | None) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        _limited(len(out), limit)
    return bytes(out)


def _unpredict(data: bytes, parms: dict) -> bytes:
    kind = int(parms.get("Predictor", 1) or 1)
    if kind < 2:
        return data
    colors, bpc, cols = int(parms.get("Colors", 1)), int(parms.get("BitsPerComponent", 8)), int(parms.get("Columns", 1))
    bpp, row = max(1, colors * bpc // 8), (colors * bpc * cols + 7) // 8
    out = bytearray()
    if kind == 2:
        for i in range(0, len(data), row):
            line = bytearray(data[i : i + row])
            if bpc == 8:
                for k in range(bpp, len(line)):
                    line[k] = (line[k] + line[k - bpp]) & 255
            out += line
        return bytes(out)
    above = bytearray(row)
    for i in range(0, len(data), row + 1):
        how, line = data[i], bytearray(data[i + 1 : i + 1 + row])
        line += bytes(row - len(line))
        for k in range(row):
            left = line[k - bpp] if k >= bpp else 0
            if how == 1:
                add = left
            elif how == 2:
                add = above[k]
            elif how == 3:
                add = (left + above[k]) // 2
            elif how == 4:
                c = above[k - bpp] if k >= bpp else 0
                p = left + above[k] - c
                pa, pb, pc = abs(p - left), abs(p - above[k]), abs(p - c)
                add = left if pa <= pb and pa <= pc else above[k] if pb <= pc else c
            else:
                break
            line[k] = (line[k] + add) & 255
        out += line
        above = line
    return bytes(out)


_SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "RL": "RunLengthDecode", "DCT": "DCTDecode", "CCF": "CCITTFaxDecode"}
IMAGE_FILTERS = ("DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode")


def decode(pdf: "Pdf", s: Stream, limit: int | None = None, until_image: bool = False) -> tuple[bytes, str | None]:
    """The decoded bytes, and the image filter at which decoding stopped."""
    names = pdf.get(s.head.get("Filter", s.head.get("F")))
    parms = pdf.get(s.head.get("DecodeParms", s.head.get("DP")))
    names = [] if not names else names if isinstance(names, list) else [names]
    parms = parms if isinstance(parms, list) else [parms] * len(names)
    data = s.raw
    if pdf.crypt is not None and not s.plain and pdf.crypt.key:
        data = pdf.crypt.decrypt(data, s.owner, 0)
    for name, parm in zip(names, [*parms, *[None] * len(names)]):
        name, parm = _SHORT.get(pdf.get(name), pdf.get(name)), pdf.get(parm) or {}
        parm = {k: pdf.get(v) for k, v in parm.items()} if isinstance(parm, dict) else {}
        if name == "FlateDecode":
            data = _unpredict(inflate(data, limit), parm)
        elif name == "LZWDecode":
            data = _unpredict(_lzw(data, limit, int(parm.get("EarlyChange", 1))), parm)
        elif name == "ASCII85Decode":
            data = _ascii85(data[2:] if data[:2] == b"<~" else data)
        elif name == "ASCIIHexDecode":
            data = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
            data = bytes.fromhex((data + b"0" * (len(data) % 2)).decode())
        elif name == "RunLengthDecode":
            data = _run_length(data, limit)
        elif name == "Crypt":
            continue
        elif name in IMAGE_FILTERS:
            if limit is not None:
                _limited(4 * int(pdf.get(s.head.get("Width", 0)) or 0) * int(pdf.get(s.head.get("Height", 0)) or 0), limit)
            if until_image:
                return data, name
            raise PdfFault(f"the filter {name} holds an image")
        else:
            raise PdfFault(f"unknown filter {name}")
    _limited(len(data), limit)
    return data, None


# --- files ---------------------------------------------------------------------------------------------------------

_OBJ = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+obj\b")


class Pdf:
    """An object graph read from bytes. Unresolvable references are Null."""

    def __init__(self, data: bytes, password: str | None = None, limit: int | None = None):
        m = re.search(rb"%PDF-(\d\.\d)", data[:1024])
        if not m:
            raise PdfFault("no PDF header")
        self.data, self.limit, self.version = data, limit, m[1].decode()
        self.where: dict[int, tuple] = {}
        self.cache: dict[int, object] = {}
        self.trailer: dict = {}
        self.crypt: Crypt | None = None
        self.fonts: dict = {}
        self._busy: set[int] = set()
        try:
            self._xrefs()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise PdfFault("no catalog")
        except (PdfFault, ValueError, IndexError, TypeError, KeyError, AttributeError, RecursionError):
            self._rebuild()
        self._encryption(password)
        root = self.get(self.trailer.get("Root"))
        if isinstance(root, dict) and isinstance(v := self.get(root.get("Version")), str) and v > self.version:
            self.version = v

    def _xrefs(self) -> None:
        at = self.data.rfind(b"startxref")
        lex = Lexer(self.data, at + 9)
        pos, seen = lex.next() if at >= 0 else None, set()
        while type(pos) is int and pos not in seen:
            seen.add(pos)
            head = self._xref_at(pos)
            self.trailer = head | self.trailer
            extra = head.get("XRefStm")
            if type(extra) is int and extra not in seen:
                seen.add(extra)
                self._xref_at(extra)
            pos = head.get("Prev")
        if not self.where:
            raise PdfFault("no cross-references")

    def _xref_at(self, pos: int) -> dict:
        lex = Lexer(self.data, pos)
        t = lex.next()
        if isinstance(t, Op) and t == b"xref":
            while type(first := lex.next()) is int:
                n = lex.next()
                for k in range(n):
                    off, gen, kind = lex.next(), lex.next(), lex.next()
                    if kind == b"n" and off:
                        self.where.setdefault(first + k, ("at", off))
                    elif kind == b"f":
                        self.where.setdefault(first + k, ("free",))
            if first != b"trailer":
                raise PdfFault("no trailer")
            return lex.value()
        obj = self._object_at(pos)[1]
        if not isinstance(obj, Stream):
            raise PdfFault("no cross-reference stream")
        obj.plain = True
        w = [int(x) for x in obj.head["W"]]
        data, _ = decode(self, obj, self.limit)
        index = obj.head.get("Index") or [0, obj.head["Size"]]
        i = 0
        for first, n in zip(index[::2], index[1::2]):
            for k in range(n):
                f = []
                for j, size in enumerate(w):
                    f.append(int.from_bytes(data[i : i + size], "big") if size else (1 if j == 0 else 0))
                    i += size
                entry = ("at", f[1]) if f[0] == 1 else ("in", f[1], f[2]) if f[0] == 2 else ("free",)
                self.where.setdefault(first + k, entry)
        return {k: v for k, v in obj.head.items() if k in ("Root", "Info", "ID", "Encrypt", "Prev", "Size")}

    def _rebuild(self) -> None:
        """Damaged cross-references: every object header in the file, the last of a number wins."""
        self.where, self.cache = {}, {}
        for m in _OBJ.finditer(self.data):
            self.where[int(m[1])] = ("at", m.start())
        trailer = {}
        for m in re.finditer(rb"trailer", self.data):
            t = Lexer(self.data, m.end()).value()
            if isinstance(t, dict):
                trailer |= {k: v for k, v in t.items() if k != "Prev"}
        for num in list(self.where):
            o = self.get(Ref(num))
            if isinstance(o, Stream) and o.head.get("Type") == "ObjStm":
                try:
                    for k, inner in enumerate(self._packed(num)[0]):
                        self.where.setdefault(inner, ("in", num, k))
                except (PdfFault, ValueError, TypeError):
                    continue
            head = o.head if isinstance(o, Stream) else o
            if isinstance(head, dict):
                if head.get("Type") == "Catalog":
                    trailer.setdefault("Root", Ref(num))
                if head.get("Type") == "XRef":
                    trailer = {k: v for k, v in head.items() if k in ("Root", "Info", "ID", "Encrypt")} | trailer
        self.trailer = trailer
        if not isinstance(self.get(trailer.get("Root")), dict):
            raise PdfFault("no catalog in the file")

    def _object_at(self, pos: int) -> tuple[int, object]:
        lex = Lexer(self.data, pos)
        num, gen, kind = lex.next(), lex.next(), lex.next()
        if type(num) is not int or kind != b"obj":
            raise PdfFault(f"no object at {pos}")
        obj = lex.value()
        if isinstance(obj, dict):
            back = lex.pos
            if lex.next() == b"stream":
                a = lex.pos
                a += 2 if self.data[a : a + 2] == b"\r\n" else 1 if self.data[a : a + 1] in (b"\n", b"\r") else 0
                n = obj.get("Length")
                n = self.get(n) if isinstance(n, Ref) and n.num != num else n
                if type(n) is not int or n < 0 or not re.match(rb"[\0\t\n\x0c\r ]*endstream", self.data[a + n : a + n + 20]):
                    end = self.data.find(b"endstream", a)
                    n = (end if end >= 0 else len(self.data)) - a
                    n -= self.data[a + n - 2 : a + n] == b"\r\n" and 2 or self.data[a + n - 1 : a + n] in (b"\n", b"\r")
                return num, Stream(obj, self.data[a : a + n], num)
            lex.pos = back
        return num, Null if isinstance(obj, Op) else obj

    def _packed(self, num: int) -> tuple[list[int], list]:
        key = ("objstm", num)
        if key not in self.cache:
            s = self.get(Ref(num))
            data, _ = decode(self, s, self.limit)
            lex, first = Lexer(data), self.get(s.head["First"])
            heads = [(lex.next(), lex.next()) for _ in range(self.get(s.head["N"]))]
            self.cache[key] = [h[0] for h in heads], [Lexer(data, first + h[1]).value() for h in heads]
        return self.cache[key]

    def get(self, x):
        """x, or what it refers to in the end."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            num = x.num
            if num not in self.cache:
                entry = self.where.get(num, ("free",))
                if num in self._busy:
                    return Null
                self._busy.add(num)
                try:
                    if entry[0] == "at":
                        got, obj = self._object_at(entry[1])
                        if got != num:
                            raise PdfFault("the cross-reference is off")
                        if self.crypt is not None and self.crypt.key:
                            obj = self._plain(obj, num)
                    elif entry[0] == "in":
                        nums, objs = self._packed(entry[1])
                        obj = objs[nums.index(num)] if num in nums else Null
                    else:
                        obj = Null
                finally:
                    self._busy.discard(num)
                self.cache[num] = obj
            x = self.cache[num]
        return Null

    def _plain(self, obj, num: int):
        if isinstance(obj, bytes) and not isinstance(obj, Op):
            return self.crypt.decrypt(obj, num, 0)
        if isinstance(obj, list):
            return [self._plain(v, num) for v in obj]
        if isinstance(obj, dict):
            return {k: self._plain(v, num) for k, v in obj.items()}
        if isinstance(obj, Stream):
            return Stream({k: self._plain(v, num) for k, v in obj.head.items()}, obj.raw, num, obj.head.get("Type") == "XRef")
        return obj

    def _encryption(self, password: str | None) -> None:
        self.needs_pass = False
        if not (enc := self.get(self.trailer.get("Encrypt"))):
            return
        ids = self.get(self.trailer.get("ID")) or [b""]
        crypt = Crypt({k: ({a: {b: self.get(c) for b, c in self.get(d).items()} for a, d in self.get(v).items()} if k == "CF" else self.get(v)) for k, v in enc.items()}, self.get(ids[0]) or b"")
        root = self.trailer.get("Root")
        self.crypt = crypt
        self.cache, self.fonts = {}, {}
        if not crypt.open(""):
            self.needs_pass = True
            if password is not None and not crypt.open(password):
                raise PasswordRefused("the password is wrong")
        self.trailer["Root"] = root

    @property
    def is_encrypted(self) -> bool:
        return self.crypt is not None and not self.crypt.key

    def authenticate(self, password: str) -> int:
        """0 refused, 1 not needed, 2 user, 4 owner, 6 both."""
        if self.crypt is None:
            return 1
        code = self.crypt.open(password)
        if code:
            self.cache, self.fonts = {}, {}
        return code

    def stream(self, s: Stream) -> bytes:
        return decode(self, s, self.limit)[0]

    def objects(self) -> list[int]:
        return sorted(n for n, e in self.where.items() if e[0] != "free")

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with inherited attributes filled in."""
        out, seen = [], set()
        root = self.get(self.trailer.get("Root"))
        stack = [(root.get("Pages"), {})]
        while stack:
            ref, given = stack.pop()
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                node = self.get(ref)
                if isinstance(node, dict) and node.get("Type") != "Page" and "Kids" in node:
                    seen.add(ref.num)
            else:
                node = ref
            if not isinstance(node, dict):
                continue
            given = given | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node and self.get(node[k]) is not Null}
            if "Kids" in node and node.get("Type") != "Page":
                kids = self.get(node["Kids"])
                stack += [(k, given) for k in reversed(kids if isinstance(kids, list) else [])]
            else:
                out.append(node | given | {"_ref": ref.num if isinstance(ref, Ref) else 0})
        return out


def text_of(raw) -> str:
    """A text string: UTF-16, UTF-8 by mark, or PDFDocEncoding (read as cp1252 where they agree)."""
    if not isinstance(raw, bytes):
        return str(raw) if isinstance(raw, Name) else ""
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1")
