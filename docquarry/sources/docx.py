"""Word documents by the standard library: a zip of XML."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BREAKS = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
_AROUND_RUNS = {f"{W}hyperlink", f"{W}r"}


def _text(node: ET.Element) -> str:
    """The text of a paragraph's runs and hyperlinks."""
    out = []
    for child in node:
        if child.tag in _AROUND_RUNS:
            out.append(_text(child))
        elif child.tag == f"{W}t":
            out.append(child.text or "")
        else:
            out.append(_BREAKS.get(child.tag, ""))
    return "".join(out)


def _cell_text(cell: ET.Element) -> str:
    return "\n".join(_text(p) for p in cell.findall(f"{W}p"))


def _rows(table: ET.Element) -> list[list[str]]:
    """The cells' texts by row; a merged cell counts once for each place that it covers."""
    out: list[list[str]] = []
    for row in table.findall(f"{W}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{W}tc"):
            props = cell.find(f"{W}tcPr")
            span = merge = None
            if props is not None:
                span, merge = props.find(f"{W}gridSpan"), props.find(f"{W}vMerge")
            width = int(span.get(f"{W}val", "1")) if span is not None else 1
            above = out[-1] if out else []
            continued = merge is not None and merge.get(f"{W}val", "continue") == "continue"
            text = above[len(cells)] if continued and len(above) > len(cells) else _cell_text(cell)
            cells += [text] * width
        out.append(cells)
    return out


def paragraphs_and_rows(content: bytes) -> tuple[list[str], list[list[str]]]:
    """The body's paragraphs, and the cells of all rows of its tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
    if body is None:
        return [], []
    return [_text(p) for p in body.findall(f"{W}p")], [r for t in body.findall(f"{W}tbl") for r in _rows(t)]


def make_docx(paragraphs: list[str], tables: list[list[list[str]]] = (), between: bool = False) -> bytes:
    """A small document: paragraphs, then tables (or the tables after the first paragraph)."""
    para = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    table = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    texts, grids = [para(p) for p in paragraphs], [table(t) for t in tables]
    parts = texts[:1] + grids + texts[1:] if between else texts + grids
    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(parts)}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("word/document.xml", xml)
    return out.getvalue()
