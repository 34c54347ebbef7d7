"""Workbooks of small results: the Office Open XML of a workbook is written with the standard library.

Frames here are results on the driver (pandas); nothing in this module is distributed.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import SparkSession

from .files import copy_local_file

Style = Callable[..., str]
Css = dict[tuple[int, int], str]


def style_on_cutoff(value: object, cutoff: float = 0, prop: str = "background-color", below: str = "red", above: str = "green", equal: str = "white", error: str = "black") -> str:
    """A style by the side of ``cutoff``; ``error`` for what cannot be compared."""
    try:
        chosen = below if value < cutoff else above if value > cutoff else equal if value == cutoff else error
    except TypeError:
        chosen = error
    return f"{prop} : {chosen};"


def style_on_condition(value: object, prop: str = "font-weight", true: str = "bold", false: str = "normal", condition: Callable[[object], bool] = bool) -> str:
    return f"{prop} : {true if condition(value) else false};"


def _rgb(colour: str) -> tuple[int, int, int]:
    c = colour.lstrip("#")
    return int(c[0:2], 16), int(c[2:4], 16), int(c[4:6], 16)


def style_colour_gradient(value: float, low: float, high: float, prop: str = "background-color", low_colour: str = "#FFFFFF", high_colour: str = "#FF0000", error: str = "#000000") -> str:
    """The colour as far between two colours as the value is between two bounds; ``error`` outside of them."""
    try:
        part = (value - low) / (high - low)
        if not 0 <= part <= 1:
            raise ValueError
        colour = "#" + "".join(f"{int(a + (b - a) * part):02X}" for a, b in zip(_rgb(low_colour), _rgb(high_colour)))
    except (TypeError, ValueError, ZeroDivisionError):
        colour = "#" + error.lstrip("#")
    return f"{prop} : {colour};"


def style_map_values(value: object, mapping: dict, prop: str = "background-color", default: str = "white", error: str = "black") -> str:
    try:
        return f"{prop} : {mapping.get(value, default)};"
    except TypeError:
        return f"{prop} : {error};"


def apply_styles(frame: pd.DataFrame, styles: dict[Style, list[str] | str]) -> Css:
    """CSS of cells by (row, column) position; of several styles for a cell all hold."""
    out: Css = {}
    for style, columns in styles.items():
        for c in [columns] if isinstance(columns, str) else columns:
            j = list(frame.columns).index(c)
            for i, v in enumerate(frame[c]):
                out[i, j] = out.get((i, j), "") + style(v)
    return out


NAMED = {"red": "FF0000", "green": "008000", "white": "FFFFFF", "black": "000000", "yellow": "FFFF00", "blue": "0000FF", "orange": "FFA500"}


def _look(css: str) -> tuple[bool, str | None, str | None]:
    """Bold, fill and font colour of a cell's CSS."""
    parts = dict(tuple(x.strip() for x in p.split(":", 1)) for p in css.split(";") if ":" in p)
    colour = lambda v: None if v is None else v.lstrip("#").upper() if v.startswith("#") else NAMED.get(v.lower())
    return parts.get("font-weight") == "bold", colour(parts.get("background-color")), colour(parts.get("color"))


def _column(j: int) -> str:
    s = ""
    j += 1
    while j:
        j, r = divmod(j - 1, 26)
        s = chr(65 + r) + s
    return s


def _cell(ref: str, value: object, style: int) -> str:
    s = f' s="{style}"' if style else ""
    if value is None or value != value:
        return f'<c r="{ref}"{s}/>'
    if isinstance(value, bool):
        return f'<c r="{ref}"{s} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) or hasattr(value, "dtype") and value.dtype.kind in "iuf":
        return f'<c r="{ref}"{s}><v>{value}</v></c>'
    return f'<c r="{ref}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _sheet(frame: pd.DataFrame, css: Css, looks: list, freeze: tuple[int, int] | None) -> str:
    pane = ""
    if freeze:
        r, c = freeze
        pane = f'<sheetViews><sheetView workbookViewId="0"><pane xSplit="{c}" ySplit="{r}" topLeftCell="{_column(c)}{r + 1}" state="frozen"/></sheetView></sheetViews>'
    rows = ["<row r=\"1\">" + "".join(_cell(f"{_column(j)}1", str(c), 0) for j, c in enumerate(frame.columns)) + "</row>"]
    for i, values in enumerate(frame.itertuples(index=False, name=None)):
        cells = []
        for j, v in enumerate(values):
            look = _look(css[i, j]) if (i, j) in css else None
            if look and look not in looks:
                looks.append(look)
            cells.append(_cell(f"{_column(j)}{i + 2}", v, looks.index(look) + 1 if look else 0))
        rows.append(f'<row r="{i + 2}">' + "".join(cells) + "</row>")
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{pane}<sheetData>{"".join(rows)}</sheetData></worksheet>'


def _styles(looks: list) -> str:
    fonts = '<font/>' + "".join(f"<font>{'<b/>' if b else ''}{f'<color rgb="FF{c}"/>' if c else ''}</font>" for b, _, c in looks)
    fills = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>' + "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="00{f}"/></patternFill></fill>' if f else '<fill><patternFill patternType="none"/></fill>' for _, f, _ in looks)
    xfs = "<xf/>" + "".join(f'<xf fontId="{i}" fillId="{i + 1}" applyFont="1" applyFill="1"/>' for i in range(1, len(looks) + 1))
    n = len(looks) + 1
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="{n}">{fonts}</fonts><fills count="{n + 1}">{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{n}">{xfs}</cellXfs></styleSheet>'


def export_to_excel(frames: pd.DataFrame | list[pd.DataFrame] | dict[str, pd.DataFrame], path: str, styles: dict[Style, list[str] | str] | None = None, columns: list[str] | None = None, freeze_panes: tuple[int, int] | None = None, spark: SparkSession | None = None, remote: str | None = None) -> str:
    """A workbook with a sheet for each frame: under its key, or Sheet1, Sheet2... Gives the path.

    With ``spark`` and ``remote`` the workbook is also copied to that path, over what is there, on whatever file system.
    """
    named = frames if isinstance(frames, dict) else {f"Sheet{i}": f for i, f in enumerate(frames if isinstance(frames, list) else [frames], 1)}
    looks: list = []
    sheets = []
    for f in named.values():
        f = f if columns is None else f[columns]
        used = {s: [c for c in ([cs] if isinstance(cs, str) else cs) if c in f.columns] for s, cs in (styles or {}).items()}
        sheets.append(_sheet(f, apply_styles(f, used), looks, freeze_panes))
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(Path(path), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rels}"><sheets>' + "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(named, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rels}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + f'<Relationship Id="rId{len(sheets) + 1}" Type="{rels}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _styles(looks))
        for i, s in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", s)
    if spark is not None and remote is not None:
        copy_local_file(spark, path, remote)
    return path
