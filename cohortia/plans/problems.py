"""Queries of the general training-data operators: uneven keys, trailing periods, intervals, references."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.functions.text import read_grd, read_value
from cohortia.operators import intervals, references, rolling, skew
from cohortia.plans.registry import Registry
from cohortia.plans.sqltext import sql_read, sql_read_grd
from cohortia.session import cut, table

REG = Registry()

END_DAY = 20_088  # 2024-12-31 as days since 1970-01-01


def valid_stays(d: DataFrame) -> DataFrame:
    """Rows with a person, an episode and both dates in order, as integer days."""
    return d.where(
        F.col("id_persona").isNotNull() & F.col("id_episodio").isNotNull() & (F.col("fechaalta") >= F.col("fecha_ingreso"))
    ).select(
        "id_persona", F.unix_date("fecha_ingreso").alias("ingreso"), F.unix_date("fechaalta").alias("alta")
    )


def day_text(c: str):
    return F.date_from_unix_date(c).cast("string")


# ---------------------------------------------------------------- 1: a few keys hold most rows

@REG.add("p1_found", f"""
WITH t AS (SELECT count(*) AS n FROM grd_depurado),
k AS (
  SELECT 'cod_hospital' AS campo, {sql_read('cod_hospital')} AS clave FROM grd_depurado
  UNION ALL SELECT 'id_persona', CAST(id_persona AS VARCHAR) FROM grd_depurado)
SELECT campo, clave FROM k, t WHERE clave IS NOT NULL GROUP BY campo, clave, t.n HAVING count(*) * 50 >= t.n
""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "grd_depurado")
    fields = {"cod_hospital": read_value("cod_hospital"), "id_persona": F.col("id_persona")}
    return skew.heavy_keys(rows, fields, per=50).select("campo", "clave")


@REG.add("p1_hospital_year", f"""
SELECT {sql_read('cod_hospital')} AS cod_hospital, anio_archivo, count(*) AS egresos,
  count(DISTINCT id_persona) AS personas,
  CAST(sum(CASE WHEN {sql_read('tipoalta')} LIKE 'DERIVACI%' THEN 1 ELSE 0 END) AS BIGINT) AS derivaciones,
  CAST(sum(CASE WHEN {sql_read('tipoalta')} LIKE 'DERIVACI%' AND n_egresos_episodio > 1 THEN 1 ELSE 0 END) AS BIGINT) AS con_continuacion,
  CAST(sum(fechaalta - fecha_ingreso) AS BIGINT) AS dias, round(sum(ir_29301_peso), 4) AS peso
FROM grd_depurado GROUP BY 1, 2
""")
def p1_hospital_year(spark: SparkSession, d: str) -> DataFrame:
    referred = F.coalesce(read_value("tipoalta").startswith("DERIVACI"), F.lit(False))
    rows = table(spark, d, "grd_depurado").select(
        read_value("cod_hospital").alias("cod_hospital"),
        "anio_archivo",
        "id_persona",
        referred.cast("bigint").alias("der"),
        (referred & F.coalesce(F.col("n_egresos_episodio") > 1, F.lit(False))).cast("bigint").alias("cont"),
        F.datediff("fechaalta", "fecha_ingreso").cast("bigint").alias("d"),
        F.col("ir_29301_peso").alias("p"),
    )
    totals = skew.distinct_per_key(
        rows, ["cod_hospital", "anio_archivo"], "id_persona",
        derivaciones=F.col("der"), con_continuacion=F.col("cont"), dias=F.col("d"), peso=F.col("p"),
    )
    return totals.select(
        "cod_hospital", "anio_archivo", F.col("n").alias("egresos"), F.col("distintos").alias("personas"),
        "derivaciones", "con_continuacion", "dias", F.round("peso", 4).alias("peso"),
    )


@REG.add("p1_person", """
SELECT id_persona, count(*) AS egresos, CAST(sum(fechaalta - fecha_ingreso) AS BIGINT) AS dias,
  min(fecha_ingreso) AS primero, max(fechaalta) AS ultimo, round(sum(ir_29301_peso), 4) AS peso
FROM grd_depurado WHERE id_persona IS NOT NULL GROUP BY 1
""")
def p1_person(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "grd_depurado").where("id_persona IS NOT NULL")
    return skew.key_totals(
        rows, {"id_persona": F.col("id_persona")},
        egresos=F.count(F.lit(1)), dias=F.sum(F.datediff("fechaalta", "fecha_ingreso").cast("bigint")),
        primero=F.min("fecha_ingreso"), ultimo=F.max("fechaalta"), peso=F.round(F.sum("ir_29301_peso"), 4),
    )


# ---------------------------------------------------------------- 3: trailing periods

STAYS_SQL = """s AS (
  SELECT id_persona, fecha_ingreso - DATE '1970-01-01' AS ingreso, fechaalta - DATE '1970-01-01' AS alta FROM grd_depurado
  WHERE id_persona IS NOT NULL AND id_episodio IS NOT NULL AND fechaalta >= fecha_ingreso)"""


@REG.add("p3_found", f"""
WITH {STAYS_SQL},
a AS (SELECT id_persona, ingreso AS dia, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT DISTINCT id_persona, dia + k AS dia FROM a, range(0, 30) r(k) WHERE dia + k <= {END_DAY}),
t AS (
  SELECT c.id_persona, c.dia, sum(a.n) AS d30, sum(CASE WHEN a.dia > c.dia - 7 THEN a.n ELSE 0 END) AS d7
  FROM c JOIN a ON a.id_persona = c.id_persona AND a.dia BETWEEN c.dia - 29 AND c.dia GROUP BY ALL)
SELECT id_persona, strftime(DATE '1970-01-01' + CAST(dia AS INTEGER), '%Y-%m-%d') AS dia FROM t WHERE d30 >= 3 AND d7 = 0
""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    events = valid_stays(table(spark, d, "grd_depurado")).select("id_persona", F.col("ingreso").alias("dia"), F.lit(1).alias("ingresos"))
    t = rolling.rolling_totals(events, "id_persona", "dia", ["ingresos"], (7, 30), END_DAY, floor=("ingresos", 3))
    return t.where("ingresos_7 = 0").select("id_persona", day_text("dia").alias("dia"))


@REG.add("p3_rolling", f"""
WITH {STAYS_SQL},
a AS (SELECT id_persona, ingreso AS dia, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT DISTINCT id_persona, unnest(range(ingreso, alta + 1)) AS dia FROM s),
e AS (SELECT id_persona, dia, sum(n) AS n, sum(h) AS h FROM (
  SELECT id_persona, dia, n, 0 AS h FROM a UNION ALL SELECT id_persona, dia, 0, 1 FROM b) GROUP BY ALL),
c AS (SELECT DISTINCT id_persona, dia + k AS dia FROM e, range(0, 30) r(k) WHERE dia + k <= {END_DAY}),
f AS (SELECT c.id_persona, c.dia, coalesce(e.n, 0) AS n, coalesce(e.h, 0) AS h FROM c LEFT JOIN e USING (id_persona, dia)),
t AS (SELECT id_persona, dia, sum(n) OVER w7 AS i7, sum(n) OVER w30 AS i30, sum(h) OVER w7 AS h7, sum(h) OVER w30 AS h30 FROM f
  WINDOW w7 AS (PARTITION BY id_persona ORDER BY dia RANGE BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY id_persona ORDER BY dia RANGE BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT id_persona, DATE '1970-01-01' + CAST(dia AS INTEGER) AS dia, CAST(i7 AS BIGINT) AS ingresos_7, CAST(i30 AS BIGINT) AS ingresos_30,
  CAST(h7 AS BIGINT) AS dias_hospital_7, CAST(h30 AS BIGINT) AS dias_hospital_30,
  round(i7 / 7.0::DOUBLE, 6) AS ingresos_7_media, round(i30 / 30.0::DOUBLE, 6) AS ingresos_30_media,
  round(h7 / 7.0::DOUBLE, 6) AS dias_hospital_7_media, round(h30 / 30.0::DOUBLE, 6) AS dias_hospital_30_media FROM t
""")
def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Every person and day on which a 30-day total isn't 0: admissions, and days in hospital counted once a day."""
    stays = valid_stays(table(spark, d, "grd_depurado"))
    admitted = stays.select("id_persona", F.col("ingreso").alias("dia"), F.lit(1).alias("ingresos"), F.lit(0).alias("dias_hospital"))
    # Merged periods: a day covered by several stays is one day in hospital.
    covered = intervals.merge_intervals(stays, "id_persona", "ingreso", "alta").select(
        "id_persona", F.explode(F.sequence("desde", "hasta")).alias("dia"), F.lit(0).alias("ingresos"), F.lit(1).alias("dias_hospital")
    )
    measures = ["ingresos", "dias_hospital"]
    t = rolling.rolling_totals(admitted.unionByName(covered), "id_persona", "dia", measures, (7, 30), END_DAY)
    t = rolling.with_averages(t, measures)
    rounded = {c: F.round(c, 6) for c in t.columns if c.endswith("_media")}
    return t.withColumns(rounded).withColumn("dia", F.date_from_unix_date("dia"))


@REG.add("p3_calendar", f"""
WITH {STAYS_SQL},
a AS (SELECT id_persona, ingreso AS dia, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT id_persona, unnest(range(first, {END_DAY} + 1)) AS dia FROM (SELECT id_persona, min(dia) AS first FROM a GROUP BY 1)),
t AS (SELECT id_persona, dia, sum(coalesce(n, 0)) OVER w7 AS i7, sum(coalesce(n, 0)) OVER w30 AS i30 FROM c LEFT JOIN a USING (id_persona, dia)
  WINDOW w7 AS (PARTITION BY id_persona ORDER BY dia RANGE BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY id_persona ORDER BY dia RANGE BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT id_persona, count(*) AS dias, count(*) FILTER (i30 = 0) AS dias_sin_ingreso, CAST(max(i7) AS BIGINT) AS mayor_7, CAST(max(i30) AS BIGINT) AS mayor_30,
  round(avg(i7), 6) AS media_7, round(avg(i30), 6) AS media_30 FROM t GROUP BY 1
""")
def p3_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Every day of every person from the first admission to the end, days without any included, summed up per person."""
    events = valid_stays(table(spark, d, "grd_depurado")).select("id_persona", F.col("ingreso").alias("dia"), F.lit(1).alias("ingresos"))
    t = rolling.rolling_totals(events, "id_persona", "dia", ["ingresos"], (7, 30), END_DAY, whole=True)
    mean = lambda c: F.round(F.avg(c), 6)
    return t.groupBy("id_persona").agg(
        F.count(F.lit(1)).alias("dias"), F.count(F.when(F.col("ingresos_30") == 0, 1)).alias("dias_sin_ingreso"), F.max("ingresos_7").alias("mayor_7"),
        F.max("ingresos_30").alias("mayor_30"), mean("ingresos_7").alias("media_7"), mean("ingresos_30").alias("media_30"),
    )


# ---------------------------------------------------------------- 4: continuous periods and gaps

PERIODS_SQL = f"""{STAYS_SQL},
o AS (SELECT *, max(alta) OVER (PARTITION BY id_persona ORDER BY ingreso, alta ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antes FROM s),
i AS (SELECT *, sum(CASE WHEN antes IS NULL OR ingreso > antes + 1 THEN 1 ELSE 0 END)
  OVER (PARTITION BY id_persona ORDER BY ingreso, alta ROWS UNBOUNDED PRECEDING) AS isla FROM o),
p AS (SELECT id_persona, isla, min(ingreso) AS a, max(alta) AS b, count(*) AS n FROM i GROUP BY ALL),
q AS (SELECT *, lag(b) OVER (PARTITION BY id_persona ORDER BY a) AS b0 FROM p)"""


@REG.add("p4_found", f"""
WITH {PERIODS_SQL},
r AS (SELECT id_persona, 'PERIODO' AS tipo, a AS x, b AS y FROM q WHERE n >= 2
  UNION ALL SELECT id_persona, 'HUECO', b0 + 1, a - 1 FROM q WHERE b0 IS NOT NULL)
SELECT id_persona, tipo, strftime(DATE '1970-01-01' + CAST(x AS INTEGER), '%Y-%m-%d') AS desde,
  strftime(DATE '1970-01-01' + CAST(y AS INTEGER), '%Y-%m-%d') AS hasta FROM r
""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    periods = intervals.merge_intervals(valid_stays(table(spark, d, "grd_depurado")), "id_persona", "ingreso", "alta")
    both = intervals.periods_and_gaps(periods, "id_persona")
    return both.where("tipo = 'HUECO' OR n >= 2").select(
        "id_persona", "tipo", day_text("desde").alias("desde"), day_text("hasta").alias("hasta")
    )


@REG.add("p4_coverage", f"""
WITH {PERIODS_SQL}
SELECT id_persona, count(*) AS periodos, CAST(sum(n) AS BIGINT) AS estadias, CAST(sum(b - a + 1) AS BIGINT) AS dias_cubiertos,
  CAST(coalesce(sum(a - b0 - 1), 0) AS BIGINT) AS dias_hueco, CAST(max(a - b0 - 1) AS BIGINT) AS hueco_mayor FROM q GROUP BY 1
""")
def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    periods = intervals.merge_intervals(valid_stays(table(spark, d, "grd_depurado")), "id_persona", "ingreso", "alta")
    both = intervals.periods_and_gaps(periods, "id_persona")
    days = (F.col("hasta") - F.col("desde") + 1).cast("bigint")
    stay, gap = F.col("tipo") == "PERIODO", F.col("tipo") == "HUECO"
    return both.groupBy("id_persona").agg(
        F.count(F.when(stay, 1)).alias("periodos"), F.sum("n").alias("estadias"), F.sum(F.when(stay, days)).alias("dias_cubiertos"),
        F.coalesce(F.sum(F.when(gap, days)), F.lit(0)).alias("dias_hueco"), F.max(F.when(gap, days)).alias("hueco_mayor"),
    )


# ---------------------------------------------------------------- 6: orphan references

def discharge_refs(rows: DataFrame) -> DataFrame:
    fields = {"cod_hospital": read_value("cod_hospital"), "diagnostico1": read_value("diagnostico1"), "ir_29301_cod_grd": read_grd("ir_29301_cod_grd")}
    return references.references(rows, "id_egreso", F.col("fechaalta"), fields)


def catalog_spans(spark: SparkSession, d: str) -> DataFrame:
    read = lambda t, f, c: references.spans(table(spark, d, t), f, c, "vigente_desde", "vigente_hasta")
    return (
        read("cat_hospitales", "cod_hospital", read_value("cod_hospital"))
        .unionByName(read("cat_cie10", "diagnostico1", read_value("codigo")))
        .unionByName(read("cat_grd", "ir_29301_cod_grd", read_grd("cod_grd")))
    )


REFS_SQL = f"""refs AS (
  SELECT id_egreso, 'cod_hospital' AS campo, {sql_read('cod_hospital')} AS codigo, fechaalta AS dia FROM grd_depurado
  UNION ALL SELECT id_egreso, 'diagnostico1', {sql_read('diagnostico1')}, fechaalta FROM grd_depurado
  UNION ALL SELECT id_egreso, 'ir_29301_cod_grd', {sql_read_grd('ir_29301_cod_grd')}, fechaalta FROM grd_depurado),
cat AS (
  SELECT 'cod_hospital' AS campo, {sql_read('cod_hospital')} AS codigo, vigente_desde AS desde, vigente_hasta AS hasta FROM cat_hospitales
  UNION ALL SELECT 'diagnostico1', {sql_read('codigo')}, vigente_desde, vigente_hasta FROM cat_cie10
  UNION ALL SELECT 'ir_29301_cod_grd', {sql_read_grd('cod_grd')}, vigente_desde, vigente_hasta FROM cat_grd),
state AS (
  SELECT *, EXISTS (SELECT 1 FROM cat c WHERE c.campo = r.campo AND c.codigo = r.codigo) AS conocido,
    EXISTS (SELECT 1 FROM cat c WHERE c.campo = r.campo AND c.codigo = r.codigo AND (r.dia IS NULL OR
      (coalesce(c.desde, r.dia) <= r.dia AND coalesce(c.hasta, r.dia) >= r.dia))) AS hallado
  FROM refs r WHERE codigo IS NOT NULL)"""


def yearly_batches(spark: SparkSession, d: str) -> Iterator[tuple[DataFrame, DataFrame, int]]:
    """(new references, arriving spans, year): each file year's references, and the spans that begin by then. References without a
    year come first; spans that begin after the last year come with it, so that in the end all have arrived."""
    rows, parents = table(spark, d, "grd_depurado"), cut(catalog_spans(spark, d), "catalogos")
    begins = F.coalesce(F.year(F.date_from_unix_date("desde")), F.lit(0))
    years = [r[0] for r in rows.where("anio_archivo IS NOT NULL").select("anio_archivo").distinct().orderBy("anio_archivo").collect()] or [0]
    for i, year in enumerate(years):
        own, due = F.col("anio_archivo") == year, F.lit(True)
        if i == 0:
            own = own | F.col("anio_archivo").isNull()
        else:
            due = due & (begins > years[i - 1])
        if i < len(years) - 1:
            due = due & (begins <= year)
        yield discharge_refs(rows.where(own)), parents.where(due), int(year)


@REG.add("p6_found", f"WITH {REFS_SQL} SELECT id_egreso, campo FROM state WHERE NOT hallado")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphans that still wait after all yearly batches."""
    state = references.empty_state(spark)
    for new, arrived, _ in yearly_batches(spark, d):
        state = references.store(references.advance(state, new, arrived, keep_settled=False))
    return state.pending.select(F.col("id").alias("id_egreso"), "campo")


@REG.add("p6_reopened", f"""
WITH {REFS_SQL.replace("state AS", f"still AS (SELECT * FROM cat WHERE hasta IS NULL OR hasta >= DATE '1970-01-01' + {END_DAY}), state AS").replace("FROM cat c", "FROM still c")}
SELECT campo, CAST(year(dia) AS INTEGER) AS anio, count(*) AS pendientes FROM state WHERE NOT hallado GROUP BY ALL
""")
def p6_reopened(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per field and year when, after all batches, the catalog rows that have run out are deleted."""
    state = references.empty_state(spark)
    for new, arrived, _ in yearly_batches(spark, d):
        state = references.store(references.advance(state, new, arrived))
    state = references.advance(state, removed=state.parents.where(F.col("hasta") < END_DAY))
    return references.snapshot(state)


@REG.add("p6_counts", f"""
WITH {REFS_SQL}
SELECT campo, CAST(year(dia) AS INTEGER) AS anio, count(*) AS referencias,
  CAST(sum(CASE WHEN NOT conocido THEN 1 ELSE 0 END) AS BIGINT) AS ausentes,
  CAST(sum(CASE WHEN conocido AND NOT hallado THEN 1 ELSE 0 END) AS BIGINT) AS fuera_de_vigencia FROM state GROUP BY ALL
""")
def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    tried = references.probe(discharge_refs(table(spark, d, "grd_depurado")), catalog_spans(spark, d))
    n = lambda c: F.sum(c.cast("bigint"))
    return tried.groupBy("campo", F.year(F.date_from_unix_date("dia")).alias("anio")).agg(
        F.count(F.lit(1)).alias("referencias"),
        n(~F.col("conocido")).alias("ausentes"),
        n(F.col("conocido") & ~F.col("hallado")).alias("fuera_de_vigencia"),
    )


@REG.add("p6_snapshots", f"""
WITH {REFS_SQL},
b AS (SELECT DISTINCT anio_archivo AS lote FROM grd_depurado),
x AS (SELECT s.campo, s.codigo, s.dia, g.anio_archivo FROM state s JOIN grd_depurado g USING (id_egreso)),
y AS (
  SELECT b.lote, x.campo, CAST(year(x.dia) AS INTEGER) AS anio FROM b JOIN x ON x.anio_archivo <= b.lote
  WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.campo = x.campo AND c.codigo = x.codigo
    AND (c.desde IS NULL OR year(c.desde) <= b.lote OR b.lote = (SELECT max(lote) FROM b))
    AND (x.dia IS NULL OR (coalesce(c.desde, x.dia) <= x.dia AND coalesce(c.hasta, x.dia) >= x.dia))))
SELECT CAST(lote AS INTEGER) AS lote, campo, anio, count(*) AS pendientes FROM y GROUP BY ALL
""")
def p6_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Pending orphans after each yearly batch of references and of catalog spans that begin by then."""
    state, shots = references.empty_state(spark), []
    for new, arrived, year in yearly_batches(spark, d):
        state = references.store(references.advance(state, new, arrived, keep_settled=False))
        shots.append(references.snapshot(state).select(F.lit(year).alias("lote"), "campo", "anio", "pendientes"))
    return reduce(DataFrame.unionByName, shots)
