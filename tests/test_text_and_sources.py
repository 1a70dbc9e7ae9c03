from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortia.functions import text
from cohortia.sources import delimited, rules, sinks
from cohortia.sources.registry import VersionRegistry


def one(spark, kind, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


VALUES = [" a ", " x y　", "", "  ", None, "ignorado ", "NO APLICA", "ñandú", "\x1fq"]


def test_read_value_equals_python(spark):
    got = one(spark, "string", VALUES, text.read_value)
    assert got == [text.read_plain(v) for v in VALUES] == ["A", "X Y", None, None, None, None, None, "ÑANDÚ", "Q"]
    assert one(spark, "string", ["123", " 1234567 ", "x", None, "ignorado"], text.read_grd) == ["000123", "1234567", "00000X", None, None]


def test_clean_dates_numbers(spark):
    assert one(spark, "string", [" a\t b  c  d "], text.clean_text) == ["A B C D"]
    dates = one(spark, "string", ["2020-02-03", "03-02-2020", "31-02-2020", "DESCONOCIDO", "", None], text.parse_two_format_date)
    assert dates == [date(2020, 2, 3), date(2020, 2, 3), None, None, None, None]
    assert one(spark, "string", ["0,5744", ",3045", "1.2.3", "", "7"], text.parse_decimal_comma) == [0.5744, 0.3045, None, None, 7.0]
    assert one(spark, "string", ["12", "123", "x", " 1 "], lambda c: text.parse_integer(c, r"\d{1,2}", "int")) == [12, None, None, 1]
    assert one(spark, "string", ["K1Ñ-77"], text.value_mask) == ["A9A-99"] and one(spark, "string", ["KK1Ñ-77"], text.short_mask) == ["A9A-9"]
    assert one(spark, "double", [1234.5], lambda c: text.spanish_number(c, 2)) == ["1.234,50"]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "cp1252"])
def test_delimited(spark, tmp_path, encoding):
    path = tmp_path / "x.txt"
    path.write_bytes("ID|NOMBRE|NOTA\r\n1|Muñoz|a|b\r\n2||\r\n".encode(encoding))
    rows = delimited.read_delimited(spark, str(path), 2021, encoding, rename={"ID": "PACIENTE"}).orderBy("fila_origen").collect()
    assert [tuple(r) for r in rows] == [("1", "Muñoz", "a|b", 2, 2021, "x.txt"), ("2", "", "", 3, 2021, "x.txt")]
    audit = delimited.audit_lines(delimited.numbered_lines(spark, str(path), encoding), 3).collect()
    assert [(r["line"], r["n_fields"]) for r in audit] == [(2, 4)]


def test_short_line_is_an_error(spark):
    lines = spark.createDataFrame([("a|b",)], "value string")
    with pytest.raises(Exception, match="too few fields"):
        delimited.parse_fields(lines, ["x", "y", "z"]).collect()
    assert delimited.parse_fields(lines, ["x", "y", "z"], strict=False).collect()[0]["z"] is None


def test_union_years_and_projection(spark):
    a = spark.createDataFrame([(2019, 2, "x")], "anio_archivo smallint, fila_origen bigint, v string")
    b = spark.createDataFrame([(2020, 3, "y")], "anio_archivo smallint, fila_origen bigint, v string")
    assert sorted(r["encounter_id"] for r in delimited.union_years([a, b]).collect()) == [20190000002, 20200000003]
    with pytest.raises(ValueError):
        delimited.union_years([a, b.drop("v")])
    assert delimited.project_by_position(a, {2: "w"}).columns == ["w"]


def test_rules_table(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("﻿a;b\n1;2\n", encoding="utf-8")
    assert rules.read_rules(str(p), ("a",)) == [{"a": "1", "b": "2"}]
    assert rules.rules_frame(spark, str(p)).collect()[0]["b"] == "2"
    p.write_text("a;b\n1;2;3\n")
    with pytest.raises(ValueError):
        rules.read_rules(str(p))


def test_sinks_and_registry(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1234.25)], "k int, v string, x double")
    sinks.write_table(df, str(tmp_path / "t"))
    sinks.verify_written(df, str(tmp_path / "t"), "k")
    assert sinks.fingerprint(df) == sinks.fingerprint(df.orderBy(F.desc("k")).repartition(3)) != sinks.fingerprint(df.limit(1))
    assert sinks.differences(df, df).count() == 0 and sinks.differences(df, df.limit(1)).count() == 1
    assert sinks.append_columns(df, df.select("k", F.lit(1).alias("n")), "k").count() == 2
    with pytest.raises(ValueError):
        sinks.append_columns(df, df.limit(1).select("k"), "k")
    sinks.export_csv(df, str(tmp_path / "e.csv"), 2)
    assert (tmp_path / "e.csv").read_text(encoding="utf-8-sig").splitlines() == ["k;v;x", "1;a;0,50", "2;;1.234,25"]
    sinks.split_write(df.withColumn("s", F.lit("TEST")), "s", {"TEST": str(tmp_path / "s")}, ("TEST",))
    reg = VersionRegistry(str(tmp_path / "reg.json"))
    assert reg.register("t", "h1", rows=2) and not reg.register("t", "h1", rows=2) and reg.register("t", "h2", rows=3)
    reg.require("t", "h2")
    assert reg.valid("t", rows=3) and not reg.valid("t", rows=2)
    with pytest.raises(ValueError):
        reg.require("t", "h1")


def test_run_log_only_grows(spark, tmp_path):
    for i in range(2):
        sinks.append_log(spark, f"{tmp_path}/log", step="train", fold=i, ok=True, seconds=1.5)
    got = spark.read.parquet(f"{tmp_path}/log").orderBy("fold").collect()
    assert [(r["step"], r["fold"], r["ok"], r["at"] is not None) for r in got] == [("train", 0, True, True), ("train", 1, True, True)]


def test_redaction(spark):
    rows = ["12.345.678-k", " 1.234.567 ", "12345678", "123", "x 12.345.678-9", None]
    got = [r["v"] for r in spark.createDataFrame([(v,) for v in rows], "v string").select(text.redact(F.col("v")).alias("v")).collect()]
    assert got == ["omitted"] * 3 + rows[3:]
