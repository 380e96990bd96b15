"""Writers. Results (tables of rows and columns) are presented whole and are built on the
driver; records go out through Spark's own writers."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Sequence
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadro.functions.coerce import as_key, kind_of
from quadro.operators.predicates import classify
from quadro.operators.tabulate import Tabulation
from quadro.plans.spec import Conversion, PlanError


def _grid(t: Tabulation) -> list[list[object]]:
    wide = t.to_wide().drop("row_key")
    return [["", *wide.columns[1:]], *[list(r) for r in wide.collect()]]


def table_csv(t: Tabulation) -> str:
    """With a byte-order mark, every cell quoted, lines ended by CR LF."""
    quoted = lambda v: '"' + ("" if v is None else _shown(v)).replace('"', '""') + '"'
    return "﻿" + "".join(",".join(map(quoted, row)) + "\r\n" for row in _grid(t))


def _shown(v: object) -> str:
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def table_tsv(t: Tabulation) -> str:
    clean = lambda v: _shown(v).replace("\t", " ").replace("\n", " ").replace("\r", " ")
    return "\n".join("\t".join(map(clean, row)) for row in _grid(t))


def _counted(t: Tabulation) -> dict:
    return t.counters().first().asDict()


def table_json(t: Tabulation) -> str:
    cells = [r.asDict() for r in t.ordered().drop("row_sort", "col_sort").collect()]
    return json.dumps({"version": 1, "plan": json.loads(t.plan.spec.to_json()), "records": _counted(t), "warnings": t.plan.warnings, "cells": cells}, sort_keys=True, ensure_ascii=False)


portable_json = table_json


def table_xml(t: Tabulation) -> str:
    rows = "".join(f"<cell row={quoteattr(r['row_label'])} column={quoteattr(r['col_label'])}>{escape(_shown(r['value']))}</cell>" for r in t.ordered().collect())
    counts = "".join(f"<{k}>{v}</{k}>" for k, v in _counted(t).items())
    return f'<?xml version="1.0" encoding="UTF-8"?><tabulation version="1"><records>{counts}</records><cells>{rows}</cells></tabulation>'


def table_xlsx(t: Tabulation) -> bytes:
    """Two sheets: the table, and what it was made from."""
    audit = [["plan", t.plan.spec.to_json()], *[[k, v] for k, v in _counted(t).items()], *[["warning", w] for w in t.plan.warnings]]

    def sheet(grid: list[list[object]]) -> str:
        out = []
        for row in grid:
            cells = []
            for v in row:
                if isinstance(v, (int, float)) and not isinstance(v, bool):
                    if v != v or v in (float("inf"), float("-inf")):
                        raise PlanError("a value isn't finite")
                    cells.append(f"<c><v>{v}</v></c>")
                else:
                    cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v or ""))}</t></is></c>')
            out.append(f"<row>{''.join(cells)}</row>")
        return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(out)}</sheetData></worksheet>'

    kind, rel = "application/vnd.openxmlformats-officedocument.spreadsheetml", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in (1, 2)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets><sheet name="Table" sheetId="1" r:id="r1"/><sheet name="Audit" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in (1, 2)) + "</Relationships>",
        "xl/worksheets/sheet1.xml": sheet(_grid(t)), "xl/worksheets/sheet2.xml": sheet(audit),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def labelled_records(df: DataFrame, conversions: dict[str, Conversion], mode: str = "raw-and-label", source: str | None = None) -> DataFrame:
    """Records with the labels of their codes: raw, label, or both for each field."""
    out = []
    for c in df.columns:
        raw = as_key(F.col(c), kind_of(df, c))
        if c not in conversions or mode == "raw":
            out.append(raw.alias(c))
            continue
        names = F.create_map(*[F.lit(x) for k in conversions[c].categories for x in (k.sequence, k.label)])
        label = F.try_element_at(names, classify(df, c, conversions[c]))
        out += [label.alias(c)] if mode == "label" else [raw.alias(c), label.alias(f"{c}_label")]
    d = df.select(*out)
    return d.withColumn("__source", F.lit(source)) if source else d


def write_records(df: DataFrame, path: str) -> None:
    """Semicolons, a header, one file for each task."""
    df.write.csv(path, sep=";", header=True)


def lab_package(df: DataFrame, about: dict, columns: Sequence[str] | None = None) -> bytes:
    """A ZIP of data.csv and provenance.json, for an interactive look at a small selection."""
    names = list(columns or df.columns)
    rows = [";".join(names)] + [";".join("" if v is None else str(v) for v in r) for r in df.select(*names).toLocalIterator()]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data.csv", "\n".join(rows) + "\n")
        z.writestr("provenance.json", json.dumps(about | {"records": len(rows) - 1}, sort_keys=True, ensure_ascii=False))
    return out.getvalue()
