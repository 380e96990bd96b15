"""Readers and writers."""

import datetime
import json
import struct
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from quadro.functions import coerce
from quadro.operators.tabulate import tabulate
from quadro.plans.spec import Dimension, PlanError, TabulationSpec
from quadro.sources import definitions, sinks
from quadro.sources.append import append_sources
from quadro.sources.dbf import dbf_records, expand_dbc, explode, read_dbf, write_dbf, write_dbf_files
from quadro.sources.delimited import column_names, read_delimited, sniff


def test_delimiters():
    assert sniff('a;"b,c";d') == ";"
    assert sniff("a") == ","
    with pytest.raises(PlanError):
        sniff("a,b;c")
    assert column_names(["a", "", " b "]) == ["a", "COLUNA_2", "b"]
    with pytest.raises(PlanError):
        column_names(["a", "A"])


def test_delimited_types(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿code;v;t\n007;1,5;"a;b"\n010;;x\n', encoding="utf-8")
    d = read_delimited(spark, str(tmp_path / "x.csv"))
    assert dict(d.dtypes) == {"code": "string", "v": "double", "t": "string"}
    assert sorted(map(tuple, d.collect())) == [("007", 1.5, "a;b"), ("010", None, "x")]


def dbf(rows, deleted=()):
    fields = [("NAME", "C", 6, 0), ("N", "N", 6, 2), ("I", "I", 4, 0), ("D", "D", 8, 0), ("L", "L", 1, 0)]
    body = b""
    for k, (name, n, i, d, flag) in enumerate(rows):
        body += (b"*" if k in deleted else b" ") + name.ljust(6).encode("cp1252") + n.rjust(6).encode() + struct.pack("<i", i) + d.encode() + flag.encode()
    described = b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([size, dec]) + b"\0" * 14 for n, t, size, dec in fields)
    return struct.pack("<BBBBIHH20x", 3, 99, 1, 1, len(rows), 33 + 32 * len(fields), 26) + described + b"\r" + body


def test_dbf_of_every_type(spark):
    data = dbf([(" Zé ", "1.50", -3, "20240229", "T"), ("gone", "1", 1, "20240101", "F"), ("", "*", 7, "20240231", "?")], deleted={1})
    d = dbf_records(spark.createDataFrame([("a.dbf", data)], "path string, content binary"))
    assert [tuple(r) for r in d.collect()] == [(" Zé", 1.5, -3, datetime.date(2024, 2, 29), True), (None, None, 7, None, None)]
    only = dbf_records(spark.createDataFrame([("a.dbf", data)], "path string, content binary"), ["I"], deleted=True)
    assert [tuple(r) for r in only.collect()] == [(-3, False), (1, True), (7, False)]
    with pytest.raises(PlanError):
        dbf_records(spark.createDataFrame([("a.dbf", data)], "path string, content binary"), ["X"])
    with pytest.raises(Exception, match="size"):
        dbf_records(spark.createDataFrame([("a.dbf", data[:-5])], "path string, content binary")).collect()


def test_imploded_data_of_the_published_example():
    assert explode(bytes.fromhex("00048224258f807f")) == b"AIAIAIAIAIAIA"


def test_dbf_writer_refuses_what_does_not_fit(spark):
    with pytest.raises(PlanError):
        write_dbf(spark.createDataFrame([("abcdef",)], "a string"), {"a": 3})




def cnv_line(sequence, label, codes, subtotal=""):
    return f"{subtotal:>3}{sequence:>4}  {label:<50} {codes}"


def test_code_tables_round_trip():
    text = "\r\n".join(["; a comment", "3 2", cnv_line(1, "Janeiro", "01"), cnv_line(2, "Fevereiro", "02,2A-2C", "1"), cnv_line(3, "Ignorado", "00-99", "#"), "\x1a junk"])
    c = definitions.parse_cnv(text)
    assert [x.label for x in c.categories] == ["Janeiro", "Fevereiro", "Ignorado"]
    assert c.categories[1].parent == 1
    assert not c.categories[2].totalled
    assert c.precedence == "last"
    assert definitions.parse_cnv(definitions.write_cnv(c)) == c
    assert definitions.parse_cnv("1 5\n" + cnv_line(1, "x", "ABCDE")).precedence == "first"
    assert definitions.parse_cnv("2 2 F\n" + cnv_line(1, "x", "10") + "\n" + cnv_line(2, "y", "99.5")).bands == ((1, 10.0), (2, 99.5))
    with pytest.raises(PlanError):
        definitions.parse_cnv("nothing")
    with pytest.raises(PlanError):
        definitions.parse_cnv("1 2\n" + cnv_line("x", "y", "1"))


def test_wide_code_tables_read_four_columns_of_subtotal():
    row = "   56" + f"{7:>4}" + "  " + "label".ljust(100) + " 104"
    c = definitions.parse_cnv("N1 3\n" + row)
    assert (c.categories[0].parent, c.categories[0].sequence, c.categories[0].label, c.rules[0].low) == (5, 7, "label", "104")


def test_menus():
    m = definitions.parse_def(";Births\nAnasc*.dbc\nLUF,CODUF,1,uf.cnv\nSSex,SEXO,1,sex.cnv\nIWeight,PESO\nGQTD\nX what\n")
    assert m.sources == ["nasc*.dbc"]
    assert [o.roles for o in m.options] == [("row",), ("filter",)]
    assert [x.kind for x in m.measures()] == ["weighted", "sum"]
    assert m.unknown == ["X what"]
    with pytest.raises(PlanError):
        m.dimension("UF", {})


def test_saved_tables():
    sections, cells = definitions.parse_tab('TAB\n[Options]\nTitle=x\n"UF";"1995";"Total"\n"AC";1.234,5;9\n"Total";1;2\n')
    assert sections["Options"] == {"Title": "x"}
    assert cells == [("AC", "1995", 1234.5)]


def test_maps(spark):
    code, name = b"12".ljust(10), b"Acre".ljust(25)
    data = struct.pack("<Hffff", 100, 1, 1, 0, 0) + struct.pack("<BB", 1, 2) + code + struct.pack("<B", 4) + name + struct.pack("<ffH", 0.5, 0.5, 3) + struct.pack("<6f", 0, 0, 1, 0, 1, 1)
    row = definitions.parse_map(spark, data).first()
    assert (row.geocode, row.name, len(row.ring)) == ("12", "Acre", 3)
    shape = {"features": [{"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}, "properties": {"c": "9", "n": "x"}}, {"geometry": {"type": "Point", "coordinates": [0, 0]}, "properties": {}}]}
    d, warnings = definitions.read_geojson(spark, json.dumps(shape), "c", "n")
    assert [(r.geocode, r.x, r.y) for r in d.collect()] == [("9", 1.0, 1.0)]
    assert len(warnings) == 1


def test_table_writers(spark):
    t = tabulate(spark.createDataFrame([("b<", "x"), ("a", "x"), ("a", "y")], "r string, c string"), TabulationSpec(Dimension("r"), Dimension("c")))
    assert sinks.table_csv(t) == '﻿"","x","y"\r\n"a","1","1"\r\n"b<","1","0"\r\n'
    assert "b&lt;" in sinks.table_xml(t)
    assert definitions.read_portable(spark, sinks.portable_json(t)).count() == 4
    book = zipfile.ZipFile(BytesIO(sinks.table_xlsx(t)))
    assert b"<v>1.0</v>" in book.read("xl/worksheets/sheet1.xml")
    assert zipfile.ZipFile(BytesIO(sinks.lab_package(t.source, {"about": 1}))).namelist() == ["data.csv", "provenance.json"]


def test_sources_must_have_the_same_fields(spark):
    a, b = spark.range(2), spark.range(3)
    assert append_sources({"a": a, "b": b}).count() == 5
    with pytest.raises(PlanError, match="c"):
        append_sources({"a": a, "c": b.select(F.col("id").cast("int"))})


def test_dbf_files_written_by_tasks(spark, tmp_path):
    d = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, concat('é', id)) AS name", "id / 4 AS v", "date_add(DATE'2024-02-28', cast(id as int)) AS day", "id % 2 = 0 AS even").repartition(3)
    made = write_dbf_files(d, str(tmp_path / "out"), {"name": 8}, {"v": 2}, most=150).collect()
    assert sum(r.records for r in made) == 1000 and max(r.records for r in made) <= 150
    back = read_dbf(spark, str(tmp_path / "out"))
    texts = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert texts(back.collect()) == texts(d.withColumn("id", F.col("id").cast("double")).collect())
    assert write_dbf_files(d.limit(0), str(tmp_path / "none"), {"name": 8}).count() == 0


def imploded(data: bytes) -> bytes:
    """A stream of plain literals, written by the format's description."""
    bits = "".join("0" + f"{b:08b}"[::-1] for b in data) + "1" + "0000000" + "1" * 8  # the code of the longest copies, and its extra bits: the end
    bits += "0" * (-len(bits) % 8)
    return bytes([0, 4]) + bytes(int(bits[a : a + 8][::-1], 2) for a in range(0, len(bits), 8))


def test_dbc_is_a_dbf_of_an_imploded_body(spark, tmp_path):
    data = dbf([("Zé", "1.50", -3, "20240229", "T"), ("b", "2", 7, "20240101", "F")])
    size = struct.unpack_from("<H", data, 8)[0]
    packed = data[:size] + b"\0" * 4 + imploded(data[size:])
    assert expand_dbc(packed) == data
    (tmp_path / "x.dbc").write_bytes(packed)
    assert [r.NAME for r in read_dbf(spark, str(tmp_path)).orderBy("I").collect()] == ["Zé", "b"]
    for bad in (b"", b"\x02\x04\x00", imploded(b"abc")[:-3], bytes.fromhex("0004ff")):
        with pytest.raises(PlanError):
            explode(bad)


def test_cnv_file_refuses_what_windows_1252_lacks():
    c = definitions.Conversion("x", (definitions.Category(1, "São Paulo – €"),), (definitions.CodeRange(1, "1", "1"),))
    assert "São Paulo – €".encode("cp1252") in definitions.cnv_bytes(c)
    assert coerce.encode_1252("\x81a") == b"\x81a"
    with pytest.raises(ValueError, match=r"U\+0141.* at 2"):
        coerce.encode_1252("aaŁ")
