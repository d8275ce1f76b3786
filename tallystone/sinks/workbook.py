"""Workbooks, written with the standard library: values, bold heads, fills, widths, frozen panes, merged cells."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


@dataclass(frozen=True)
class Cell:
    value: object = None
    fill: str | None = None
    bold: bool = False


@dataclass
class Sheet:
    title: str
    rows: Iterable[Sequence[Cell | object]]
    widths: Sequence[float] = ()
    frozen: str | None = None
    merged: Sequence[str] = field(default_factory=list)


def column_name(n: int) -> str:
    """The letters of a column from 1 on."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, value, style: int) -> str:
    s = f' s="{style}"' if style else ""
    if value is None or value == "":
        return f'<c r="{ref}"{s}/>' if style else ""
    if isinstance(value, bool):
        return f'<c r="{ref}"{s} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"{s}><v>{value!r}</v></c>'
    text = "".join(c for c in str(value) if c in "\t\n\r" or c >= " ")
    return f'<c r="{ref}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write(out, sheets: Sequence[Sheet]) -> None:
    """Writes sheets to a path or a binary file. Rows are streamed; the styles are those that the cells use."""
    styles: dict[tuple, int] = {(None, False): 0}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, sheet in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                put = lambda x: f.write(x.encode())  # noqa: B023, E731
                put(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}">')
                if sheet.frozen:
                    letters = "".join(c for c in sheet.frozen if c.isalpha())
                    across, down = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters))) - 1, int(sheet.frozen[len(letters) :]) - 1
                    put(f'<sheetViews><sheetView workbookViewId="0"><pane{f" xSplit={chr(34)}{across}{chr(34)}" if across else ""}{f" ySplit={chr(34)}{down}{chr(34)}" if down else ""} topLeftCell="{sheet.frozen}" state="frozen"/></sheetView></sheetViews>')
                if sheet.widths:
                    put("<cols>" + "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(sheet.widths, 1)) + "</cols>")
                put("<sheetData>")
                for r, row in enumerate(sheet.rows, 1):
                    cells = [c if isinstance(c, Cell) else Cell(c) for c in row]
                    put(f'<row r="{r}">' + "".join(_cell(f"{column_name(i)}{r}", c.value, styles.setdefault((c.fill, c.bold), len(styles))) for i, c in enumerate(cells, 1)) + "</row>")
                put("</sheetData>")
                if sheet.merged:
                    put(f'<mergeCells count="{len(sheet.merged)}">' + "".join(f'<mergeCell ref="{m}"/>' for m in sheet.merged) + "</mergeCells>")
                put("</worksheet>")
        fills = [f for f in dict.fromkeys(f for f, _ in styles) if f]
        xfs = "".join(f'<xf numFmtId="0" fontId="{int(bold)}" fillId="{fills.index(fill) + 2 if fill else 0}" borderId="0" xfId="0" applyFill="1" applyFont="1"/>' for fill, bold in styles)
        solid = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{f}"/></patternFill></fill>' for f in fills)
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="{len(fills) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{solid}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(styles)}">{xfs}</cellXfs></styleSheet>')
        n = range(1, len(sheets) + 1)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name={quoteattr(sheets[i - 1].title)} sheetId="{i}" r:id="rId{i}"/>' for i in n) + "</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="rId0" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
