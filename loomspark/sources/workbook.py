"""Sheets of spreadsheet workbooks (a zip of XML parts), read and written with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

# Names of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(n: int) -> str:
    out, n = "", n + 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def read_sheet(data: bytes, name: str | int = 0) -> list[list[str | None]]:
    """The rows of a sheet, by name or number, as strings; missing cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:

        def part(path):
            return ElementTree.fromstring(book.read(path))

        sheets = part("xl/workbook.xml").findall(f".//{{{MAIN}}}sheet")
        found = [s for k, s in enumerate(sheets) if name in (k, s.get("name"))]
        if not found:
            raise ValueError(f"no sheet {name!r}; there are {[s.get('name') for s in sheets]}")
        links = {r.get("Id"): r.get("Target") for r in part("xl/_rels/workbook.xml.rels")}
        target = links[found[0].get(f"{{{LINKS}}}id")].lstrip("/")
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{{{MAIN}}}t")) for item in part("xl/sharedStrings.xml")]
        rows = []
        for row in part(target if target.startswith("xl/") else f"xl/{target}").iter(f"{{{MAIN}}}row"):
            own: list[str | None] = []
            for k, cell in enumerate(row.findall(f"{{{MAIN}}}c")):
                at = _column(cell.get("r")) if cell.get("r") else k
                own += [None] * (at + 1 - len(own))
                value = cell.find(f"{{{MAIN}}}v")
                if cell.get("t") == "inlineStr":
                    own[at] = "".join(t.text or "" for t in cell.iter(f"{{{MAIN}}}t"))
                elif value is not None and value.text is not None:
                    own[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            rows.append(own)
    width = max(map(len, rows), default=0)
    return [r + [None] * (width - len(r)) for r in rows]


def write_sheet(header: list[str], rows: list[tuple], name: str = "Sheet1", widths: list[float] | None = None) -> bytes:
    """A workbook of one sheet; numbers stay numbers."""

    def cell(r, c, v):
        if v is None:
            return ""
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f'<c r="{_letters(c)}{r}"><v>{v!r}</v></c>'
        return f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate([header, *rows], 1))
    cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths or [], 1))
    top = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'{top}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{KIND}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{top}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{top}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets><sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{top}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{top}<worksheet xmlns="{MAIN}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for path, text in parts.items():
            book.writestr(path, text)
    return out.getvalue()
