"""Queries on cleaning, profiling, control tables and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.functions import text
from cohortia.operators import quality
from cohortia.plans.discharges import DISCHARGES_SQL, DX, PX, RECORDS_SQL, discharges, records
from cohortia.plans.registry import Registry
from cohortia.plans.sqltext import sql_blanks, sql_read, sql_read_grd
from cohortia.session import table, work_folder
from cohortia.sources import delimited

REG = Registry()
_NO_DATA = ", ".join(f"'{w}'" for w in text.NO_DATA)


TEXTS = [
    "archivo_origen", "bloque_id", "sexo", "provincia", "prevision", "cod_hospital", "tipo_actividad", "tipo_ingreso", "tipo_procedencia", "especialidad_medica",
    "servicioingreso", "servicioalta", "tipoalta", *DX, *PX, "ir_29301_cod_grd", "cdm",
]
OTHERS = ["id_egreso", "anio_archivo", "fila_origen", "fecha_carga", "id_paciente", "fecha_nacimiento", "fecha_ingreso", "fechaalta", "ir_29301_peso", "ir_29301_severidad", "ir_29301_mortalidad"]


# ---------------------------------------------------------------- cleaning

def _sql_clean(c: str) -> str:
    return f"upper(regexp_replace(trim({c}, {sql_blanks()}), '[\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]+', ' ', 'g'))"


@REG.add("clean_text", "SELECT id_egreso, " + ", ".join(f"{_sql_clean(c)} AS {c}" for c in TEXTS) + " FROM grd_2019_2024")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Every text column cleaned."""
    return table(spark, d, "grd_2019_2024").select("id_egreso", *(text.clean_text(F.col(c)).alias(c) for c in TEXTS))


NO_CODE = {c: ("0",) for c in PX}


@REG.add("null_tokens", " UNION ALL ".join(
    f"SELECT '{c}' AS col, count(*) FILTER ({_sql_clean(c)} IN ({_NO_DATA}{extra})) AS tokens, count(*) FILTER ({_sql_clean(c)} <> '' AND {_sql_clean(c)} NOT IN ({_NO_DATA}{extra})) AS kept FROM grd_2019_2024"
    for c, extra in ((c, ", '0'" if c in NO_CODE else "") for c in TEXTS)
))
def null_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Cells of every text column with a no-data word and cells kept, with '0' as a word of its own for procedures."""
    extra, cols = NO_CODE, TEXTS
    rows = table(spark, d, "grd_2019_2024").select(*(text.clean_text(F.col(c)).alias(c) for c in cols))
    sums = []
    for c in cols:
        kept = text.null_if_token(F.col(c), extra.get(c, ()))
        sums += [F.count(F.when((F.col(c) != "") & kept.isNull(), 1)).alias(f"t_{c}"), F.count(kept).alias(f"k_{c}")]
    cells = F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"t_{c}").alias("tokens"), F.col(f"k_{c}").alias("kept")) for c in cols))
    return rows.agg(*sums).select(F.inline(cells))


# Pairs are a parameter; these two unite writings of one meaning and leave the values that labels read as they are.
EQUIVALENCES = {"FUGA": "FUGA DEL PACIENTE", "URGENTE": "URGENCIA"}


@REG.add("equivalence_map", f"""WITH m(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in EQUIVALENCES.items())}), t AS (SELECT {_sql_clean('tipo_ingreso')} AS v FROM grd_2019_2024)
SELECT coalesce(m.b, t.v) AS tipo, count(*) AS n FROM t LEFT JOIN m ON m.a = t.v GROUP BY 1""")
def equivalence_map(spark: SparkSession, d: str) -> DataFrame:
    mapping = F.create_map(*(F.lit(x) for pair in EQUIVALENCES.items() for x in pair))
    v = text.clean_text(F.col("tipo_ingreso"))
    return table(spark, d, "grd_2019_2024").groupBy(F.coalesce(mapping[v], v).alias("tipo")).agg(F.count(F.lit(1)).alias("n"))


@REG.add("parse_dates_two_formats", "SELECT id_egreso, CASE WHEN id_egreso % 7 < 5 THEN fechaalta END AS parsed, CASE WHEN id_egreso % 7 < 5 THEN strftime(fechaalta, '%Y-%m-%d') WHEN id_egreso % 7 = 5 THEN 'DESCONOCIDO' ELSE '2020-02-31' END AS relayout FROM grd_2019_2024")
def parse_dates_two_formats(spark: SparkSession, d: str) -> DataFrame:
    """Dates written as text in both layouts, with blanks around, and two kinds of text that is no date."""
    k = F.col("id_egreso") % 7
    written = (
        F.when(k < 2, F.date_format("fechaalta", "yyyy-MM-dd")).when(k < 4, F.date_format("fechaalta", "dd-MM-yyyy")).when(k == 4, F.concat(F.lit(" "), F.date_format("fechaalta", "dd-MM-yyyy"), F.lit("  ")))
        .when(k == 5, "DESCONOCIDO").otherwise("31-02-2020")
    )
    rows = table(spark, d, "grd_2019_2024").select("id_egreso", written.alias("w"))
    return rows.select("id_egreso", text.parse_two_format_date(F.col("w")).alias("parsed"), text.relayout_date(text.trim_blanks(F.col("w"))).alias("relayout"))


@REG.add("parse_decimal_comma", "SELECT id_egreso, CASE WHEN id_egreso % 5 < 4 THEN CAST(printf('%.4f', ir_29301_peso) AS DOUBLE) END AS weight, CASE WHEN id_egreso % 5 < 4 THEN CAST(ir_29301_severidad AS INTEGER) END AS severity FROM grd_2019_2024")
def parse_decimal_comma(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id_egreso") % 5
    dotted = F.format_string("%.4f", "ir_29301_peso")
    written = F.when(k < 2, F.replace(dotted, F.lit("."), F.lit(","))).when(k < 4, F.regexp_replace(F.replace(dotted, F.lit("."), F.lit(",")), "^0,", ",")).otherwise("1.2.3")
    digit = F.when(k < 4, F.concat(F.lit(" "), F.col("ir_29301_severidad").cast("string"))).otherwise("12")
    rows = table(spark, d, "grd_2019_2024").select("id_egreso", F.when(F.col("ir_29301_peso").isNotNull() | (k == 4), written).alias("w"), digit.alias("s"))
    return rows.select("id_egreso", text.parse_decimal_comma(F.col("w")).alias("weight"), text.parse_integer(F.col("s"), r"\d", "int").alias("severity"))


@REG.add("pad_and_prefix", f"SELECT id_egreso, {sql_read_grd('ir_29301_cod_grd')} AS grd, substr({sql_read_grd('ir_29301_cod_grd')}, 1, 2) AS mdc, split_part({sql_read('diagnostico1')}, '.', 1) AS category, substr(replace({sql_read('diagnostico1')}, '.', ''), 1, 3) AS three FROM grd_2019_2024")
def pad_and_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "grd_2019_2024").select("id_egreso", text.read_grd("ir_29301_cod_grd").alias("grd"), text.read_value("diagnostico1").alias("dx"))
    return rows.select("id_egreso", "grd", F.substring("grd", 1, 2).alias("mdc"), text.code_category(F.col("dx")).alias("category"), F.substring(F.replace("dx", F.lit("."), F.lit("")), 1, 3).alias("three"))


@REG.add("value_mask", "WITH m AS (SELECT regexp_replace(regexp_replace(diagnostico1, '\\p{Nd}', '9', 'g'), '\\p{L}', 'A', 'g') AS mask FROM grd_2019_2024 WHERE diagnostico1 IS NOT NULL) SELECT mask, regexp_replace(regexp_replace(mask, '9+', '9', 'g'), 'A+', 'A', 'g') AS short, count(*) AS n FROM m GROUP BY 1, 2")
def value_mask(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("diagnostico1")
    return table(spark, d, "grd_2019_2024").where(c.isNotNull()).groupBy(text.value_mask(c).alias("mask"), text.short_mask(c).alias("short")).agg(F.count(F.lit(1)).alias("n"))


@REG.add("accent_fold", "SELECT translate(nombre, 'ÁÉÍÓÚÜÑáéíóúüñ', 'AEIOUUNaeiouun') AS folded, count(*) AS n FROM cat_hospitales GROUP BY 1")
def accent_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cat_hospitales").groupBy(text.fold_spanish(F.col("nombre")).alias("folded")).agg(F.count(F.lit(1)).alias("n"))


_SHAPED = {c: f"CASE WHEN id_egreso % 4 = 0 THEN ' 12.345.678-K' WHEN id_egreso % 4 = 1 THEN '9876543' ELSE {c} END" for c in ("provincia", "diagnostico1")}


@REG.add("redact_id_shapes", " UNION ALL ".join(
    f"SELECT '{c}' AS col, CASE WHEN regexp_full_match(trim({v}), '{text.ID_SHAPE}') THEN 'omitted' ELSE {v} END AS shown, count(*) AS n FROM grd_2019_2024 GROUP BY 2" for c, v in _SHAPED.items()
))
def redact_id_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Two columns into which identity numbers were written, as a report may show them."""
    rows = table(spark, d, "grd_2019_2024")
    k = F.col("id_egreso") % 4
    cells = F.array(*(F.struct(F.lit(c).alias("col"), text.redact(F.when(k == 0, " 12.345.678-K").when(k == 1, "9876543").otherwise(F.col(c))).alias("shown")) for c in _SHAPED))
    return rows.select(F.inline(cells)).groupBy("col", "shown").agg(F.count(F.lit(1)).alias("n"))


@REG.add("wide_nonnull_count", f"WITH {RECORDS_SQL} SELECT encounter_id, n_dx, n_px FROM rec")
def wide_nonnull_count(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("encounter_id", "n_dx", "n_px")


@REG.add("age_and_dates", """SELECT id_egreso, CAST(fechaalta - fecha_ingreso AS INTEGER) AS stay, CAST(floor((fecha_ingreso - fecha_nacimiento) / 365.25::DOUBLE) AS BIGINT) AS age, CAST(fecha_ingreso - DATE '1970-01-01' AS INTEGER) AS epoch_day,
  CAST(month(fechaalta) AS INTEGER) AS month, make_date(year(fechaalta), 12, 31) AS year_end FROM grd_2019_2024""")
def age_and_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "grd_2019_2024").select(
        "id_egreso", F.datediff("fechaalta", "fecha_ingreso").alias("stay"), F.floor(F.datediff("fecha_ingreso", "fecha_nacimiento") / 365.25).alias("age"),
        F.unix_date("fecha_ingreso").alias("epoch_day"), F.month("fechaalta").alias("month"), F.make_date(F.year("fechaalta"), F.lit(12), F.lit(31)).alias("year_end"),
    )


@REG.add("prefix_and_contains", f"""WITH {DISCHARGES_SQL} SELECT encounter_id, CAST(coalesce(discharge_type LIKE 'DERIVACI%', false) AS INTEGER) AS referred,
  CAST(coalesce(contains(activity, 'HOSPITALIZ') AND NOT contains(activity, 'DIURNA'), false) AS INTEGER) AS full_stay FROM b""")
def prefix_and_contains(spark: SparkSession, d: str) -> DataFrame:
    """Prefix test with null as false; contains one word and not another."""
    a = F.col("activity")
    return discharges(spark, d).select(
        "encounter_id", F.coalesce(F.col("discharge_type").startswith("DERIVACI"), F.lit(False)).cast("int").alias("referred"),
        F.coalesce(a.contains("HOSPITALIZ") & ~a.contains("DIURNA"), F.lit(False)).cast("int").alias("full_stay"),
    )


@REG.add("age_bands", """WITH a AS (SELECT floor((fecha_ingreso - fecha_nacimiento) / 365.25::DOUBLE) AS age FROM grd_2019_2024)
SELECT CASE WHEN age IS NULL OR age < 0 OR age > 110 THEN 'SIN DATO' WHEN age < 15 THEN '00-14' WHEN age < 45 THEN '15-44' WHEN age < 65 THEN '45-64' ELSE '65+' END AS band, count(*) AS n FROM a GROUP BY 1""")
def age_bands(spark: SparkSession, d: str) -> DataFrame:
    age = F.floor(F.datediff("fecha_ingreso", "fecha_nacimiento") / 365.25)
    band = F.when(age.isNull() | (age < 0) | (age > 110), "SIN DATO").when(age < 15, "00-14").when(age < 45, "15-44").when(age < 65, "45-64").otherwise("65+")
    return table(spark, d, "grd_2019_2024").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@REG.add("composite_keys", "SELECT CAST(anio_archivo AS BIGINT) * 1000000000 + fila_origen AS record_key, id_paciente * 100 + 1 AS first_person, row_number() OVER (PARTITION BY archivo_origen ORDER BY fila_origen) AS line FROM grd_2019_2024")
def composite_keys(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    line = F.row_number().over(Window.partitionBy("archivo_origen").orderBy("fila_origen")).cast("bigint")
    return table(spark, d, "grd_2019_2024").select((F.col("anio_archivo").cast("bigint") * 1_000_000_000 + F.col("fila_origen")).alias("record_key"), (F.col("id_paciente") * 100 + 1).alias("first_person"), line.alias("line"))


@REG.add("bad_line_repair", "SELECT CAST(doc_id AS VARCHAR) AS id, source, text || '|' || text AS body FROM documents WHERE text <> ''")
def bad_line_repair(spark: SparkSession, d: str) -> DataFrame:
    """Lines of three fields whose last one holds separators of its own."""
    docs = table(spark, d, "documents").where("text <> ''")
    lines = docs.select(F.concat_ws("|", F.col("doc_id").cast("string"), "source", "text", "text").alias("value"))
    return delimited.parse_fields(lines, ["id", "source", "body"])


@REG.add("line_audit", "SELECT len(string_split(text, '|')) + 2 AS fields, count(*) AS lines FROM documents WHERE text IS NOT NULL GROUP BY 1")
def line_audit(spark: SparkSession, d: str) -> DataFrame:
    """How many lines have each number of fields."""
    lines = table(spark, d, "documents").where("text IS NOT NULL").select(F.concat_ws("|", F.col("doc_id").cast("string"), "source", "text").alias("value"))
    return lines.groupBy(F.size(F.split("value", "[|]", -1)).cast("bigint").alias("fields")).agg(F.count(F.lit(1)).alias("lines"))


RAW = ["id_egreso", "cod_hospital", "tipo_ingreso", "tipoalta", "diagnostico1", "ir_29301_cod_grd", "fecha_ingreso"]


@REG.add("delimited_round_trip", f"""SELECT {', '.join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in RAW)}, 2024 AS anio FROM grd_2019_2024""")
def delimited_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Raw columns written as delimited text with a header and read back: all fields text, empty ones ''."""
    return raw_extract(spark, d).select(*RAW, F.col("anio_archivo").cast("int").alias("anio"))


@REG.add("source_lines", f"SELECT count(*) AS lines, 0 AS repeated, 1 AS least_from_two FROM grd_2019_2024")
def source_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line has its own number in its file, the header being 1."""
    per = raw_extract(spark, d).groupBy("archivo_origen").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fila_origen").alias("k"), F.min("fila_origen").alias("a"), F.max("fila_origen").alias("z"))
    return per.agg(F.sum("n").alias("lines"), F.sum(F.col("n") - F.col("k")).alias("repeated"), F.min(((F.col("a") == 2) & (F.col("z") == F.col("n") + 1)).cast("int")).alias("least_from_two"))


def raw_extract(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark, "extracto")
    rows = table(spark, d, "grd_2019_2024").select(*(F.col(c).cast("string").alias(c) for c in RAW))
    plain = {"header": True, "sep": "|", "quote": "", "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**plain).csv(folder)
    return delimited.read_delimited(spark, folder, 2024)


# ---------------------------------------------------------------- profiling and control

PROFILED = TEXTS
_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value, anio_archivo FROM grd_2019_2024" for c in PROFILED)


@REG.add("column_profile", f"""WITH c AS ({_CELLS}),
p AS (SELECT col, count(*) AS rows, count(*) FILTER (value IS NOT NULL AND trim(value) <> '') AS filled, count(*) FILTER (upper(trim(value)) IN ({_NO_DATA})) AS tokens, count(DISTINCT value) AS distinct_values,
  count(DISTINCT regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '\\p{{Nd}}', '9', 'g'), '\\p{{L}}', 'A', 'g'), '9+', '9', 'g'), 'A+', 'A', 'g')) FILTER (trim(value) <> '') AS formats FROM c GROUP BY 1)
SELECT col AS "column", rows, filled, tokens, distinct_values, formats FROM p""")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return quality.column_profile(table(spark, d, "grd_2019_2024"), PROFILED, text.NO_DATA)


@REG.add("value_frequency", "SELECT prevision AS value, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM grd_2019_2024), 6) AS share FROM grd_2019_2024 GROUP BY 1")
def value_frequency(spark: SparkSession, d: str) -> DataFrame:
    return quality.value_frequency(table(spark, d, "grd_2019_2024"), "prevision")


_CATALOG_SQL = f"""cat AS (SELECT DISTINCT 'diagnostico1' AS field, {sql_read('codigo')} AS code FROM cat_cie10 UNION SELECT DISTINCT 'grd', {sql_read_grd('cod_grd')} FROM cat_grd UNION SELECT DISTINCT 'site', {sql_read('cod_hospital')} FROM cat_hospitales),
occ AS (SELECT field, code, count(*) AS n FROM (SELECT 'diagnostico1' AS field, {sql_read('diagnostico1')} AS code FROM grd_2019_2024 UNION ALL SELECT 'grd', {sql_read_grd('ir_29301_cod_grd')} FROM grd_2019_2024
  UNION ALL SELECT 'site', {sql_read('cod_hospital')} FROM grd_2019_2024) WHERE code IS NOT NULL GROUP BY 1, 2)"""


@REG.add("catalog_coverage", f"""WITH {_CATALOG_SQL} SELECT o.field, CAST(sum(n) AS BIGINT) AS occurrences, CAST(sum(CASE WHEN c.code IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS found, count(*) AS codes, count(c.code) AS codes_found
FROM occ o LEFT JOIN cat c ON c.field = o.field AND c.code = o.code GROUP BY 1""")
def catalog_coverage(spark: SparkSession, d: str) -> DataFrame:
    fields = {"diagnostico1": text.read_value("diagnostico1"), "grd": text.read_grd("ir_29301_cod_grd"), "site": text.read_value("cod_hospital")}
    one = lambda t, f, c: table(spark, d, t).select(F.lit(f).alias("field"), c.alias("code"))
    known = one("cat_cie10", "diagnostico1", text.read_value("codigo")).unionByName(one("cat_grd", "grd", text.read_grd("cod_grd"))).unionByName(one("cat_hospitales", "site", text.read_value("cod_hospital")))
    return quality.catalog_coverage(table(spark, d, "grd_2019_2024"), fields, known)


@REG.add("top_missing_codes", f"WITH {_CATALOG_SQL} SELECT code, n FROM occ WHERE field = 'diagnostico1' AND code NOT IN (SELECT code FROM cat WHERE field = 'diagnostico1') ORDER BY n DESC, code LIMIT 20")
def top_missing_codes(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "cat_cie10").select(text.read_value("codigo").alias("code"))
    return quality.missing_codes(table(spark, d, "grd_2019_2024"), text.read_value("diagnostico1"), known)


@REG.add("top_k_codes", f"SELECT {sql_read('diagnostico1')} AS code, count(*) AS n FROM grd_2019_2024 WHERE {sql_read('diagnostico1')} IS NOT NULL GROUP BY 1 ORDER BY n DESC, code LIMIT 25")
def top_k_codes(spark: SparkSession, d: str) -> DataFrame:
    code = text.read_value("diagnostico1")
    return table(spark, d, "grd_2019_2024").select(code.alias("code")).where("code IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(25)


@REG.add("null_pct_by_year", " UNION ALL ".join(f"""SELECT anio_archivo, '{c}' AS "column", round(1 - count({c})::DOUBLE / count(*), 6) AS missing FROM grd_2019_2024 GROUP BY 1""" for c in TEXTS + OTHERS))
def null_pct_by_year(spark: SparkSession, d: str) -> DataFrame:
    return quality.null_share(table(spark, d, "grd_2019_2024").withColumn("__year", F.col("anio_archivo")), "__year", TEXTS + OTHERS).withColumnRenamed("__year", "anio_archivo")


@REG.add("monthly_control_table", f"""WITH {RECORDS_SQL} SELECT CAST(year(discharge) AS INTEGER) AS y, {', '.join(f'count(*) FILTER (month(discharge) = {m}) AS m{m:02d}' for m in range(1, 13))} FROM rec WHERE discharge IS NOT NULL GROUP BY 1""")
def monthly_control_table(spark: SparkSession, d: str) -> DataFrame:
    return quality.month_counts(records(spark, d), "discharge")


@REG.add("control_table", f"""WITH {RECORDS_SQL} SELECT year, count(*) AS rows, count(DISTINCT month(discharge)) AS months, round(avg(discharge - admit), 6) AS mean_stay, round(quantile_cont(weight, 0.5), 6) AS median_weight,
  round(avg((patient_id IS NULL)::INTEGER), 6) AS no_id, round(avg(n_dx), 6) AS mean_dx, count(DISTINCT patient_id) AS patients, count(DISTINCT site) AS sites FROM rec GROUP BY 1""")
def control_table(spark: SparkSession, d: str) -> DataFrame:
    return quality.control_table(records(spark, d))


@REG.add("reappearance", f"""WITH {RECORDS_SQL}, h AS (SELECT DISTINCT patient_id, year FROM rec WHERE patient_id IS NOT NULL)
SELECT a.year, count(*) AS ids, count(b.patient_id) AS again FROM h a LEFT JOIN h b ON b.patient_id = a.patient_id AND b.year = a.year + 1 GROUP BY 1""")
def reappearance(spark: SparkSession, d: str) -> DataFrame:
    return quality.reappearance(records(spark, d))


@REG.add("data_dictionary", f"""WITH c AS ({_CELLS}), y AS (SELECT col, anio_archivo, count(value)::DOUBLE / count(*) AS f FROM c GROUP BY 1, 2)
SELECT col AS "column", 'string' AS type, count(DISTINCT value) AS distinct_values, min(value) AS least, max(value) AS greatest, round(count(value)::DOUBLE / count(*), 6) AS filled,
  (SELECT round(min(f), 6) FROM y WHERE y.col = c.col) AS filled_least_year, (SELECT round(max(f), 6) FROM y WHERE y.col = c.col) AS filled_greatest_year FROM c GROUP BY col""")
def data_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return quality.data_dictionary(table(spark, d, "grd_2019_2024"), "anio_archivo", PROFILED)


# ---------------------------------------------------------------- sets

@REG.add("union_years", "SELECT anio_archivo, count(*) AS n, min(id_egreso) AS first_id, max(id_egreso) AS last_id FROM grd_2019_2024 GROUP BY 1")
def union_years(spark: SparkSession, d: str) -> DataFrame:
    """The two identifier blocks and what has none, stacked again under one schema, and counted by year."""
    rows = table(spark, d, "grd_2019_2024").select("anio_archivo", "id_egreso", "bloque_id")
    parts = [rows.where("bloque_id = 'A'"), rows.where("bloque_id = 'B'"), rows.where("bloque_id IS NULL OR bloque_id NOT IN ('A', 'B')")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("anio_archivo").agg(F.count(F.lit(1)).alias("n"), F.min("id_egreso").alias("first_id"), F.max("id_egreso").alias("last_id"))


def _ids(spark: SparkSession, d: str, block: str) -> DataFrame:
    return table(spark, d, "grd_2019_2024").where((F.col("bloque_id") == block) & F.col("id_paciente").isNotNull()).select("id_paciente")


@REG.add("intersect_patients", "SELECT id_paciente FROM grd_2019_2024 WHERE bloque_id = 'A' AND id_paciente IS NOT NULL INTERSECT SELECT id_paciente FROM grd_2019_2024 WHERE bloque_id = 'B' AND id_paciente IS NOT NULL")
def intersect_patients(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d, "A").intersect(_ids(spark, d, "B"))


@REG.add("except_patients", "SELECT id_paciente FROM grd_2019_2024 WHERE bloque_id = 'A' AND id_paciente IS NOT NULL EXCEPT SELECT id_paciente FROM grd_2019_2024 WHERE bloque_id = 'B' AND id_paciente IS NOT NULL")
def except_patients(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d, "A").subtract(_ids(spark, d, "B"))


@REG.add("registered_not_kept", "SELECT id_egreso FROM grd_2019_2024 WHERE id_egreso NOT IN (SELECT id_egreso FROM grd_depurado)")
def registered_not_kept(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "grd_2019_2024").select("id_egreso").join(table(spark, d, "grd_depurado").select("id_egreso"), "id_egreso", "left_anti")


@REG.add("unpivot_codes", "SELECT block, position, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS block, {i} AS position, {c} AS code FROM grd_2019_2024" for b, cols in (("DIAGNOSTICO", DX), ("PROCEDIMIENTO", PX)) for i, c in enumerate(cols, 1)) + ") WHERE code IS NOT NULL GROUP BY 1, 2")
def unpivot_codes(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(b).alias("block"), F.lit(i).alias("position"), F.col(c).alias("code")) for b, cols in (("DIAGNOSTICO", DX), ("PROCEDIMIENTO", PX)) for i, c in enumerate(cols, 1)))
    return table(spark, d, "grd_2019_2024").select(F.inline(cells)).where("code IS NOT NULL").groupBy("block", "position").agg(F.count(F.lit(1)).alias("n"))
