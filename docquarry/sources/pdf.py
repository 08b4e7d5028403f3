"""PDF documents.

Uses PyMuPDF where it is installed. Otherwise a small reader of our own: it
finds objects by scanning, opens Flate streams and object streams, follows the
page tree and reads the text operators of content streams, with ToUnicode maps
or the Windows Latin encoding. It does not decrypt, and orders text as the file
does.
"""

from __future__ import annotations

import re
import zlib

_SPACE = b"\x00\t\n\x0c\r "
_DELIMITERS = b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_OBJECT = re.compile(rb"(?<!\d)(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj\b")
#: A wider step between the strings of one line, in thousandths of the font size, reads as a space.
_GAP = 200


class Name(str):
    __slots__ = ()


class Ref(int):
    __slots__ = ()


class Op(str):
    __slots__ = ()


class Scanner:
    """Reads PDF values, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        d, n = self.data, len(self.data)
        while self.at < n:
            if d[self.at] in _SPACE:
                self.at += 1
            elif d[self.at : self.at + 1] == b"%":
                while self.at < n and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def value(self):
        """The next value; Op for an operator or keyword, None at the end."""
        self.skip()
        d = self.data
        c = d[self.at : self.at + 1]
        if not c:
            return None
        if d.startswith(b"<<", self.at):
            self.at += 2
            return self._dictionary()
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.at >= len(d) or d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self._reference(self.value(), out))
        if c == b"(":
            return self._string()
        if c == b"<":
            end = d.index(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"/":
            self.at += 1
            m = _TOKEN.match(d, self.at)
            self.at = m.end() if m else self.at
            return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m[0].decode("latin-1") if m else ""))
        m = _TOKEN.match(d, self.at)
        if not m:
            self.at += 1
            return Op(c.decode("latin-1"))
        self.at = m.end()
        word = m[0].decode("latin-1")
        try:
            return float(word) if "." in word else int(word)
        except ValueError:
            return {"true": True, "false": False}.get(word, Op(word))

    @staticmethod
    def _reference(value, out: list):
        if value == "R" and isinstance(value, Op) and len(out) > 1:
            out.pop()
            return Ref(out.pop())
        return value

    def _dictionary(self) -> dict:
        items: list = []
        while True:
            self.skip()
            if self.at >= len(self.data) or self.data.startswith(b">>", self.at):
                self.at += 2
                break
            items.append(self._reference(self.value(), items))
        return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, str)}

    def _string(self) -> bytes:
        out, depth, d = bytearray(), 1, self.data
        self.at += 1
        while self.at < len(d):
            c = d[self.at]
            self.at += 1
            if c == 0x5C:
                e = d[self.at : self.at + 1]
                self.at += 1
                if e in b"01234567" and e:
                    m = re.compile(rb"[0-7]{1,3}").match(d, self.at - 1)
                    self.at = m.end()
                    out.append(int(m[0], 8) & 255)
                elif e == b"\r":
                    self.at += d[self.at : self.at + 1] == b"\n"
                elif e != b"\n":
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(e, e)
            elif c == 0x28:
                depth += 1
                out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
                out.append(c)
            else:
                out.append(c)
        return bytes(out)


class Document:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.objects: dict[int, tuple] = {}
        at = 0
        while m := _OBJECT.search(data, at):
            s = Scanner(data, m.end())
            value = s.value()
            at, raw = s.at, None
            s.skip()
            if isinstance(value, dict) and data.startswith(b"stream", s.at):
                start = s.at + 6
                start += 2 if data.startswith(b"\r\n", start) else 1
                size = value.get("Length")
                end = start + size if isinstance(size, int) and not isinstance(size, Ref) else -1
                if end < 0 or b"endstream" not in data[end : end + 12]:
                    end = data.find(b"endstream", start)
                    end = len(data) if end < 0 else end
                raw, at = data[start:end], end
            self.objects[int(m[1])] = (value, raw)
        for value, raw in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and raw is not None:
                self._open(value, self.decoded(value, raw))
        trailers = [v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        if not trailers:
            raise ValueError("the PDF file has no catalog")
        if b"/Encrypt" in data:
            raise ValueError("the PDF file is encrypted")
        self.catalog = trailers[-1]

    def _open(self, head: dict, data: bytes) -> None:
        n, first = self.get(head.get("N")), self.get(head.get("First"))
        s = Scanner(data)
        places = [(s.value(), s.value()) for _ in range(n)]
        for number, at in places:
            self.objects.setdefault(number, (Scanner(data, first + at).value(), None))

    def get(self, value):
        seen = 0
        while isinstance(value, Ref) and seen < 32:
            value, seen = self.objects.get(int(value), (None, None))[0], seen + 1
        return value

    def decoded(self, head: dict, raw: bytes) -> bytes:
        filters = self.get(head.get("Filter")) or []
        for f in [filters] if isinstance(filters, str) else filters:
            if f in ("FlateDecode", "Fl"):
                raw = zlib.decompressobj().decompress(raw)
            elif f in ("ASCIIHexDecode", "AHx"):
                raw = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw.split(b">")[0]).decode())
            else:
                raise ValueError(f"the PDF filter {f} is not supported")
        return raw

    def stream(self, ref) -> bytes:
        if isinstance(ref, Ref):
            value, raw = self.objects.get(int(ref), (None, None))
            if raw is None and isinstance(value, list):
                return self.stream(value)
            return self.decoded(value, raw) if raw is not None else b""
        return b"\n".join(map(self.stream, ref)) if isinstance(ref, list) else b""

    def pages(self) -> list[dict]:
        out, seen = [], set()

        def walk(ref, inherited):
            if isinstance(ref, Ref):
                if int(ref) in seen:
                    return
                seen.add(int(ref))
            node = self.get(ref)
            if not isinstance(node, dict):
                return
            inherited = inherited | {k: node[k] for k in ("Resources",) if k in node}
            if node.get("Type") == "Page" or "Kids" not in node:
                out.append(inherited | node)
            for kid in self.get(node.get("Kids")) or []:
                walk(kid, inherited)

        walk(self.catalog.get("Pages"), {})
        return out


class Font:
    """Bytes of a string to text."""

    def __init__(self, doc: Document, font: dict):
        self.wide = font.get("Subtype") == "Type0"
        self.map: dict[int, str] = {}
        if isinstance(ref := font.get("ToUnicode"), Ref):
            self._read(doc.stream(ref))

    def _read(self, cmap: bytes) -> None:
        text = lambda b: b.decode("utf-16-be", "replace")
        s, held = Scanner(cmap), []
        while (v := s.value()) is not None:
            if isinstance(v, Op):
                if v == "endbfchar":
                    self.map |= {int.from_bytes(a, "big"): text(b) for a, b in zip(held[::2], held[1::2], strict=False)}
                elif v == "endbfrange":
                    for lo, hi, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                        for i in range(int.from_bytes(hi, "big") - int.from_bytes(lo, "big") + 1):
                            code = int.from_bytes(lo, "big") + i
                            self.map[code] = text(to[i]) if isinstance(to, list) else text((int.from_bytes(to, "big") + i).to_bytes(len(to), "big"))
                held = []
            else:
                held.append(v)

    def decode(self, data: bytes) -> str:
        if self.wide:
            codes = [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data) - 1, 2)]
            return "".join(self.map.get(c, "") for c in codes)
        return "".join(self.map.get(c) or bytes([c]).decode("cp1252", "replace") for c in data)


def _page_text(doc: Document, page: dict) -> str:
    resources = doc.get(page.get("Resources")) or {}
    fonts = {k: Font(doc, doc.get(v) or {}) for k, v in (doc.get(resources.get("Font")) or {}).items()}
    out: list[str] = []
    font, height, stack = Font(doc, {}), 0.0, []
    s = Scanner(doc.stream(page.get("Contents")))

    def line():
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    while (v := s.value()) is not None:
        if not isinstance(v, Op):
            stack.append(v)
            continue
        if v == "Tf" and len(stack) > 1:
            font = fonts.get(stack[-2], font)
        elif v in ("Td", "TD") and len(stack) > 1:
            if stack[-1]:
                line()
            elif out and stack[-2]:
                out.append(" ")
        elif v == "Tm" and len(stack) > 5:
            if stack[-1] != height:
                line()
            height = stack[-1]
        elif v == "T*" or v == "BT":
            line()
        elif v in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
            if v != "Tj":
                line()
            out.append(font.decode(stack[-1]))
        elif v == "TJ" and stack and isinstance(stack[-1], list):
            for x in stack[-1]:
                if isinstance(x, bytes):
                    out.append(font.decode(x))
                elif isinstance(x, (int, float)) and x < -_GAP and out and not out[-1].endswith(" "):
                    out.append(" ")
        elif v == "ID":  # an inline image
            end = s.data.find(b"EI", s.at)
            s.at = len(s.data) if end < 0 else end + 2
        stack = []
    return "".join(out).strip()


def page_texts(content: bytes) -> list[str]:
    """The text of each page, stripped; blank pages are empty."""
    try:
        import fitz
    except ImportError:
        doc = Document(content)
        return [_page_text(doc, p) for p in doc.pages()]
    with fitz.open(stream=content, filetype="pdf") as doc:
        return [p.get_text().strip() for p in doc]


def make_pdf(pages: list[list[str]], compress: bool = True) -> bytes:
    """A small document with one A4 page for each list of lines (Windows Latin text)."""
    parts: list[bytes] = []
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    parts.append(b"<< /Type /Catalog /Pages 2 0 R >>")
    parts.append(f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode())
    parts.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
    for i, lines in enumerate(pages):
        text = b"".join(b"(" + re.sub(rb"([()\\])", rb"\\\1", x.encode("cp1252", "replace")) + b") Tj T*\n" for x in lines)
        stream = b"BT /F1 11 Tf 14 TL 50 790 Td\n" + text + b"ET"
        stream = zlib.compress(stream) if compress else stream
        head = f"<< /Length {len(stream)}{' /Filter /FlateDecode' if compress else ''} >>\nstream\n".encode()
        parts.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
        parts.append(head + stream + b"\nendstream")
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, part in enumerate(parts, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + part + b"\nendobj\n"
    table = len(out)
    out += f"xref\n0 {len(parts) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer << /Size {len(parts) + 1} /Root 1 0 R >>\nstartxref\n{table}\n%%EOF\n".encode())
