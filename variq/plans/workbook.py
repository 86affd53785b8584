"""Workbooks (Office Open XML) of DataFrames, without any other library: a zip of sheets with inline strings.

Rows are streamed from the cluster partition by partition into the file, so the driver holds one partition at a time.
A sheet of this format has 1,048,576 rows; a longer table is refused, not cut.
"""

from __future__ import annotations

import datetime
import decimal
import math
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from variq.plans.spec import ValidationError

ROWS = 1_048_576
#: Characters that a sheet's name can't have, and its longest length; of the format. Fixed values.
FORBIDDEN, LONGEST = r"[\[\]:*?/\\]", 31
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _cell(v) -> str:
    if v is None or (isinstance(v, float) and not math.isfinite(v)):
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int | float | decimal.Decimal):
        return f"<c><v>{v!r}</v></c>" if not isinstance(v, decimal.Decimal) else f"<c><v>{v}</v></c>"
    text = v.isoformat(sep=" ") if isinstance(v, datetime.datetime) else str(v)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", text))}</t></is></c>'


def _row(values) -> bytes:
    return f"<row>{''.join(map(_cell, values))}</row>".encode()


def sheet_names(names: list[str]) -> list[str]:
    """Names that the format allows, all different."""
    out: list[str] = []
    for name in names:
        base = re.sub(FORBIDDEN, "_", name)[:LONGEST] or "sheet"
        pick, k = base, 1
        while pick.lower() in [x.lower() for x in out]:
            k += 1
            pick = f"{base[: LONGEST - len(str(k)) - 1]}~{k}"
        out.append(pick)
    return out


def write(path: str, tables: dict[str, DataFrame]) -> list[str]:
    """Writes a sheet a table to a path of the driver; the sheets' names."""
    names = sheet_names(list(tables))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for k, (table, df) in enumerate(tables.items(), 1):
            with book.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as out:
                out.write(f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData>'.encode() + _row(df.columns))
                for n, row in enumerate(df.toLocalIterator(), 2):
                    if n > ROWS:
                        raise ValidationError(f"{table!r} has more rows than a sheet holds; export it as a directory")
                    out.write(_row(row))
                out.write(b"</sheetData></worksheet>")
        sheets = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, name in enumerate(names, 1))
        links = "".join(f'<Relationship Id="r{k}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        book.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{sheets}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        book.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
    return names
