"""Workbook source: .xlsx files parsed file by file inside the tasks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .files import read_parsed

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that show a date or time.
_DATE_FORMATS = set(range(14, 23)) | set(range(27, 37)) | set(range(45, 48)) | set(range(50, 59))


def _cell_at(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits) - 1, col - 1


def _texts(node) -> str:
    """Text of a shared or inline string without phonetic hints."""
    parts = []
    for child in node:
        if child.tag == _MAIN + "t":
            parts.append(child.text or "")
        elif child.tag == _MAIN + "r":
            parts.extend(t.text or "" for t in child.findall(_MAIN + "t"))
    return "".join(parts)


def _date_styles(archive) -> set[int]:
    import xml.etree.ElementTree as ET

    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ET.fromstring(archive.read("xl/styles.xml"))
    dates = set(_DATE_FORMATS)
    for fmt in root.iter(_MAIN + "numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        if re.search(r"[dmyhs]", code, re.IGNORECASE) and "general" not in code.lower():
            dates.add(int(fmt.get("numFmtId")))
    cells = root.find(_MAIN + "cellXfs")
    styles = cells.findall(_MAIN + "xf") if cells is not None else []
    return {i for i, xf in enumerate(styles) if int(xf.get("numFmtId", "0")) in dates}


def _number(raw: str, is_date: bool, epoch_1904: bool) -> tuple[str, str]:
    if is_date:
        from datetime import datetime, timedelta

        start = datetime(1904, 1, 1) if epoch_1904 else datetime(1899, 12, 30)
        serial = float(raw)
        if 0 < serial < 60 and not epoch_1904:
            serial += 1
        return str(start + timedelta(milliseconds=round(serial * 86_400_000))), "d"
    text = raw.strip()
    return (str(float(text)) if re.search(r"[.eE]", text) else str(int(text))), "n"


def _parse_sheet(stream, strings: list[str], date_styles: set[int], epoch_1904: bool):
    """Yield ("row", index, values, types) and ("merge", ...) while reading the sheet once."""
    import xml.etree.ElementTree as ET

    row_at = -1
    for _, node in ET.iterparse(stream, events=("end",)):
        if node.tag == _MAIN + "mergeCell":
            first, _, last = node.get("ref", "").partition(":")
            (r1, c1), (r2, c2) = _cell_at(first), _cell_at(last or first)
            yield ("merge", {"min_row": r1, "max_row": r2, "min_col": c1, "max_col": c2})
            continue
        if node.tag != _MAIN + "row":
            continue
        row_at = int(node.get("r", row_at + 2)) - 1
        values, types, col = [], [], -1
        for cell in node.findall(_MAIN + "c"):
            col = _cell_at(cell.get("r"))[1] if cell.get("r") else col + 1
            kind, shown = cell.get("t", "n"), cell.find(_MAIN + "v")
            raw = shown.text if shown is not None else None
            value, vtype = None, "s"
            if kind == "inlineStr":
                inline = cell.find(_MAIN + "is")
                value = _texts(inline) if inline is not None else None
            elif raw is None:
                pass
            elif kind == "s":
                value = strings[int(raw)]
            elif kind == "b":
                value, vtype = ("True" if raw == "1" else "False"), "b"
            elif kind in ("str", "e"):
                value = raw
            elif kind == "d":
                value, vtype = raw.replace("T", " "), "d"
            else:
                value, vtype = _number(raw, int(cell.get("s", "0")) in date_styles, epoch_1904)
            while len(values) < col:
                values.append(None)
                types.append("s")
            values.append(value or None)
            types.append(vtype)
        yield ("row", row_at, values, types)
        node.clear()


def _sheets(archive) -> list[tuple[int, str, str]]:
    """(position, name, member of the archive) of every sheet."""
    import posixpath
    import xml.etree.ElementTree as ET

    book = ET.fromstring(archive.read("xl/workbook.xml"))
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for pos, sheet in enumerate(book.iter(_MAIN + "sheet")):
        target = rels.get(sheet.get(_REL + "id"), "")
        found.append((pos, sheet.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))))
    return found


def _context(archive) -> tuple[list[str], set[int], bool]:
    """Shared strings, styles that show dates, and whether dates count from 1904."""
    import xml.etree.ElementTree as ET

    strings = []
    if "xl/sharedStrings.xml" in archive.namelist():
        root = ET.fromstring(archive.read("xl/sharedStrings.xml"))
        strings = [_texts(si) for si in root.findall(_MAIN + "si")]
    props = ET.fromstring(archive.read("xl/workbook.xml")).find(_MAIN + "workbookPr")
    return strings, _date_styles(archive), props is not None and props.get("date1904") in ("1", "true")


def _sheet_records(archive, file_id: str, sheet: tuple[int, str, str], context: tuple):
    """Rows of one sheet, then its own record with merged ranges, or with the error that ended it."""
    pos, name, member = sheet
    merges = []
    try:
        with archive.open(member) as stream:
            for item in _parse_sheet(stream, *context):
                if item[0] == "merge":
                    merges.append(item[1])
                else:
                    _, row_at, values, types = item
                    yield (file_id, name, pos, row_at, values, types, None, None)
    except Exception as e:  # noqa: BLE001 - one unreadable sheet does not lose the others
        yield (file_id, name, pos, None, None, None, None, f"Failed to read sheet: {e}")
        return
    yield (file_id, name, pos, None, None, None, merges, None)


def _parse_workbook(file_id: str, content: bytes):
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        context = _context(archive)
        for sheet in _sheets(archive):
            yield from _sheet_records(archive, file_id, sheet, context)


def read_workbooks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All sheets of all .xlsx files, hidden ones included, with cached values only.

    The rows of a sheet count once the whole sheet was read; one that fails half way leaves an error.

    Parse once and store the result; sheets hold at most 1,048,576 rows, so a file is a
    bounded unit of work. ``workbook_source`` reads sheet by sheet.
    """
    return read_parsed(spark, path, "xlsx", _parse_workbook)
