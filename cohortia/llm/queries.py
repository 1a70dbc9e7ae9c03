"""Queries of the operators for language-model training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.functions.text import read_value
from cohortia.llm import frequency, leakage, mixing, reading_level, representative, splits
from cohortia.operators.skew import sized_join
from cohortia.plans.registry import Registry
from cohortia.plans.sqltext import sql_read
from cohortia.session import cut, table

REG = Registry()

DX = [f"diagnostico{i}" for i in range(1, 13)]
PX = [f"procedimiento{i}" for i in range(1, 7)]


# ---------------------------------------------------------------- 2: splits that keep related records together

PARTS_SQL = f"p AS (SELECT id_paciente, {sql_read('conjunto')} AS conjunto FROM particion WHERE id_paciente IS NOT NULL)"
COMPONENTS_SQL = """e AS (SELECT id_paciente_1 AS a, id_paciente_2 AS b FROM enlace_pacientes WHERE id_paciente_1 IS NOT NULL AND id_paciente_2 IS NOT NULL
  UNION SELECT id_paciente_2, id_paciente_1 FROM enlace_pacientes WHERE id_paciente_1 IS NOT NULL AND id_paciente_2 IS NOT NULL),
r AS (SELECT a AS nodo, a AS otro FROM e UNION SELECT r.nodo, e.b FROM r JOIN e ON e.a = r.otro),
c AS (SELECT nodo, min(otro) AS grupo FROM r GROUP BY nodo)"""


def patient_groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.components(table(spark, d, "enlace_pacientes"), "id_paciente_1", "id_paciente_2")


@REG.add("p2_found", f"""
WITH RECURSIVE {COMPONENTS_SQL}, {PARTS_SQL},
g AS (SELECT p.id_paciente, p.conjunto, coalesce(c.grupo, p.id_paciente) AS grupo FROM p LEFT JOIN c ON c.nodo = p.id_paciente)
SELECT DISTINCT id_paciente FROM g WHERE grupo IN (SELECT grupo FROM g GROUP BY grupo HAVING count(DISTINCT conjunto) > 1)
""")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    registered = table(spark, d, "particion").select("id_paciente", read_value("conjunto").alias("conjunto"))
    return splits.torn_groups(registered, "id_paciente", "conjunto", patient_groups(spark, d)).select("id_paciente")


def dealt_discharges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "grd_depurado").where("id_persona IS NOT NULL").select("id_egreso", "id_paciente", "bloque_id")
    named = sized_join(rows, patient_groups(spark, d).withColumnRenamed("nodo", "id_paciente"), ["id_paciente"])
    named = named.withColumn("grupo", F.coalesce("grupo", "id_paciente"))
    targets = [(r["conjunto"], r["proporcion"]) for r in table(spark, d, "metas_particion").collect()]
    return splits.assign_splits(named, "grupo", targets)


SPLIT_SQL = f"""WITH RECURSIVE {COMPONENTS_SQL},
g AS (SELECT d.id_egreso, d.id_paciente, d.bloque_id, coalesce(c.grupo, d.id_paciente) AS grupo FROM grd_depurado d LEFT JOIN c ON c.nodo = d.id_paciente WHERE d.id_persona IS NOT NULL),
k AS (SELECT grupo, arg_min(conjunto, -ln((CAST('0x' || substr(md5('conjunto|' || conjunto || '|' || CAST(grupo AS VARCHAR)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / proporcion) AS conjunto
  FROM (SELECT DISTINCT grupo FROM g WHERE grupo IS NOT NULL), metas_particion WHERE proporcion > 0 GROUP BY grupo),
z AS (SELECT g.*, k.conjunto FROM g LEFT JOIN k USING (grupo))"""


@REG.add("p2_split", f"{SPLIT_SQL} SELECT id_egreso, id_paciente, bloque_id, grupo, conjunto FROM z")
def p2_split(spark: SparkSession, d: str) -> DataFrame:
    """Every discharge with a person and its set; all discharges of a patient's identifiers are in one."""
    return dealt_discharges(spark, d).select("id_egreso", "id_paciente", "bloque_id", "grupo", "conjunto")


@REG.add("p2_balance", f"""{SPLIT_SQL}
SELECT m.conjunto, m.proporcion, n.egresos, n.grupos, n.egresos::DOUBLE / (SELECT count(*) FROM z WHERE conjunto IS NOT NULL) AS lograda
FROM metas_particion m LEFT JOIN (SELECT conjunto, count(*) AS egresos, count(DISTINCT grupo) AS grupos FROM z GROUP BY 1) n USING (conjunto)""")
def p2_balance(spark: SparkSession, d: str) -> DataFrame:
    """Discharges, groups and the reached share of each set beside its target."""
    sizes = dealt_discharges(spark, d).groupBy("conjunto", "grupo").agg(F.count(F.lit(1)).alias("n"))
    sets = cut(sizes.groupBy("conjunto").agg(F.sum("n").alias("egresos"), F.count(F.lit(1)).alias("grupos")), "balance")
    goals = table(spark, d, "metas_particion")
    total = sets.where("conjunto IS NOT NULL").agg(F.sum("egresos").alias("t"))
    return goals.join(sets, "conjunto", "left").withColumn("lograda", F.col("egresos") / total.scalar())


# ---------------------------------------------------------------- 5: best representative of each duplicate group

KEYS5 = ("id_paciente", "cod_hospital", "fecha_ingreso", "fechaalta", "sexo", "fecha_nacimiento")


WORDS5 = {"grd": "ir_29301_cod_grd", "alta": "tipoalta", "ingreso": "tipo_ingreso", "prevision_salud": "prevision"}


def discharge_representatives(spark: SparkSession, d: str, words: dict[str, str], build: bool) -> DataFrame:
    keys = {k: read_value(k) if k == "cod_hospital" else F.col(k) for k in KEYS5}
    return representative.representatives(
        table(spark, d, "grd_2019_2024"), "id_egreso", keys, ("sexo", "fecha_nacimiento"),
        codes={"diagnosticos": DX, "procedimientos": PX},
        words=words, trust="ir_29301_peso", recency="fecha_carga", build=build,
    )


_FILLED = lambda cols: " + ".join(f"CASE WHEN {sql_read(c)} IS NULL THEN 0 ELSE 1 END" for c in cols)


@REG.add("p5_found", f"""
WITH t AS (SELECT id_egreso, id_paciente, {sql_read('cod_hospital')} AS h, fecha_ingreso, fechaalta, sexo, fecha_nacimiento,
    {_FILLED(DX)} AS nd, {_FILLED(PX)} AS np, ir_29301_peso AS peso, fecha_carga FROM grd_2019_2024),
u AS (SELECT id_egreso, count(*) OVER k AS n,
    row_number() OVER (PARTITION BY id_paciente, h, fecha_ingreso, fechaalta, sexo, fecha_nacimiento
      ORDER BY nd DESC, np DESC, peso DESC NULLS LAST, fecha_carga DESC NULLS LAST, id_egreso) AS r
  FROM t WHERE id_paciente IS NOT NULL AND h IS NOT NULL AND fecha_ingreso IS NOT NULL AND fechaalta IS NOT NULL
  WINDOW k AS (PARTITION BY id_paciente, h, fecha_ingreso, fechaalta, sexo, fecha_nacimiento))
SELECT id_egreso FROM u WHERE n > 1 AND r = 1
""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return discharge_representatives(spark, d, {}, build=False).select("id_egreso")


@REG.add("p5_built")
def p5_built(spark: SparkSession, d: str) -> DataFrame:
    """One record per group built field by field, beside the record that stays."""
    return discharge_representatives(spark, d, WORDS5, build=True)


# ---------------------------------------------------------------- 7: frequency of every distinct value

LONG_SQL = "x AS (" + " UNION ALL ".join(
    f"SELECT id_egreso, '{b}' AS bloque, {sql_read(c)} AS codigo FROM grd_2019_2024" for b, cols in (("DIAGNOSTICO", DX), ("PROCEDIMIENTO", PX)) for c in cols
) + f"""),
o AS (SELECT bloque, codigo, count(*) AS ocurrencias, count(DISTINCT id_egreso) AS registros FROM x WHERE codigo IS NOT NULL GROUP BY ALL),
l AS (SELECT DISTINCT bloque, {sql_read('codigo')} AS codigo FROM filtro_codigos WHERE nivel = 'COMPLETO' AND {sql_read('codigo')} IS NOT NULL),
f AS (SELECT bloque, codigo, coalesce(ocurrencias, 0) AS ocurrencias, coalesce(registros, 0) AS registros FROM o FULL JOIN l USING (bloque, codigo)),
t AS (SELECT count(*) AS n FROM grd_2019_2024)"""


def code_frequencies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "grd_2019_2024")
    found = frequency.ngram_counts(rows, {"DIAGNOSTICO": DX, "PROCEDIMIENTO": PX}, lengths=(1,))
    listed = table(spark, d, "filtro_codigos").where("nivel = 'COMPLETO'").select("bloque", read_value("codigo").alias("codigo"))
    listed = listed.where("bloque IS NOT NULL AND codigo IS NOT NULL").distinct()
    counts = found.select("bloque", F.col("ngrama")[0].alias("codigo"), "ocurrencias", "registros").join(listed, ["bloque", "codigo"], "full")
    return frequency.mark_frequencies(counts.fillna(0, ["ocurrencias", "registros"]), rows.agg(F.count(F.lit(1)).alias("n")))


@REG.add("p7_found", f"""
WITH {LONG_SQL}
SELECT bloque, codigo, 'RARO' AS marca FROM f WHERE registros < 5
UNION ALL SELECT bloque, codigo, 'COMUN' FROM f, t WHERE registros * 100 > t.n * 4
""")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return code_frequencies(spark, d).select("bloque", "codigo", F.explode("marcas").alias("marca"))


@REG.add("p7_codes", f"WITH {LONG_SQL} SELECT bloque, codigo, ocurrencias, registros FROM f")
def p7_codes(spark: SparkSession, d: str) -> DataFrame:
    return code_frequencies(spark, d).select("bloque", "codigo", "ocurrencias", "registros")


def _runs_sql(n: int) -> str:
    """Occurrences and records of every run of n filled codes, from the gap-free list of each record."""
    return f"""SELECT bloque, array_to_string(codigos[i:i + {n - 1}], ' ') AS secuencia, {n} AS n, id_egreso
      FROM (SELECT bloque, id_egreso, codigos, unnest(range(1, len(codigos) - {n} + 2)) AS i FROM z)"""


@REG.add("p7_sequences", "WITH z AS (" + " UNION ALL ".join(
    f"SELECT id_egreso, '{b}' AS bloque, list_filter([{', '.join(map(sql_read, cols))}], lambda c: c IS NOT NULL) AS codigos FROM grd_2019_2024"
    for b, cols in (("DIAGNOSTICO", DX), ("PROCEDIMIENTO", PX))
) + "), r AS (" + " UNION ALL ".join(_runs_sql(n) for n in range(1, len(DX) + 1)) + """)
SELECT bloque, secuencia, n, count(*) AS ocurrencias, count(DISTINCT id_egreso) AS registros, count(DISTINCT id_egreso) < 5 AS raro FROM r GROUP BY ALL
""")
def p7_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Every run of one code or more that a record holds, up to whole records; those in fewer than 5 records are marked."""
    found = frequency.ngram_counts(table(spark, d, "grd_2019_2024"), {"DIAGNOSTICO": DX, "PROCEDIMIENTO": PX})
    return found.select("bloque", F.array_join("ngrama", " ").alias("secuencia"), "n", "ocurrencias", "registros", (F.col("registros") < 5).alias("raro"))


# ---------------------------------------------------------------- 8: evaluation texts leaking into training text

def leaks(spark: SparkSession, d: str, n: int = 5, min_score: int = 16) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "items_evaluacion"), "item_id", "texto", n=n, min_score=min_score)


def _windows_sql(t: str, key: str, text: str) -> str:
    """Every run of 12 words of a text, words being runs of letters and digits without case and accents."""
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i
      FROM (SELECT {key}, regexp_extract_all(lower(strip_accents(nfc_normalize({text}))), '[\\p{{L}}\\p{{N}}]+') AS w FROM {t}))"""


@REG.add("p8_found", f"""
WITH i AS ({_windows_sql('items_evaluacion', 'item_id', 'texto')}), d AS ({_windows_sql('documents', 'doc_id', 'text')})
SELECT DISTINCT doc_id, item_id FROM i JOIN d USING (g)
""")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with 12 equal words in a row. Such a run holds a seed of 12 words and scores 24 by itself, so seeds may be that long and
    the bound may ask for that score: the filter pushed down, at no loss."""
    return leaks(spark, d, 12, leakage.MATCH * 12).where("racha >= 12").select("doc_id", "item_id")


@REG.add("p8_leaks")
def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """All aligned passages, edited ones too, with score, longest equal run and place."""
    return leaks(spark, d)


# ---------------------------------------------------------------- 9: mixing sources to target weights

def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts with more tokens are likelier, by the logarithm, so that stubs give way."""
    goals = table(spark, d, "mezcla_fuentes")
    counted = mixing.count_tokens(table(spark, d, "documents"), "text", ["doc_id", "source"])
    sized = cut(counted.withColumn("peso", F.log1p("tokens")), "tokens")
    targets = [(r["source"], r["peso_objetivo"], r["max_repeticiones"]) for r in goals.collect()]
    return sized, mixing.mix_sources(sized, "doc_id", "source", targets, weight="peso"), goals


@REG.add("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


@REG.add("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, mix, goals = _mix(spark, d)
    return mixing.mix_report(sized, mix, "source", goals)


@REG.add("p9_kept", "SELECT source, true AS dentro_del_maximo, true AS cuota_cumplida, true AS una_vez FROM mezcla_fuentes")
def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """What a mix must keep: no document more often than its source's cap, each source's tokens within one document of its
    share of the whole, no document twice in the mix."""
    sized, mix, goals = _mix(spark, d)
    longest = sized.groupBy("source").agg(F.max("tokens").alias("mayor"))
    mix = cut(mix, "mezcla")
    repeated = mix.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k")).groupBy("source").agg(F.max("k").alias("veces"))
    report = mixing.mix_report(sized, mix, "source", goals).join(longest, "source", "left").join(repeated, "source", "left")
    whole = mix.agg(F.sum(F.col("tokens") * F.col("copias")).alias("t"))
    return report.select(
        "source", (F.col("repeticiones_maximas") <= F.col("max_repeticiones")).alias("dentro_del_maximo"),
        (F.abs(F.col("tokens_mezcla") - F.col("peso_objetivo") * whole.scalar()) <= F.col("mayor")).alias("cuota_cumplida"), (F.coalesce("veces", F.lit(1)) == 1).alias("una_vez"),
    )


# ---------------------------------------------------------------- 10: reading level of each document

def levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "etiquetas_lectura"), "doc_id", "nivel")


@REG.add("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return levels(spark, d).where("nivel = 4").select("doc_id")


@REG.add("p10_profile")
def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters per source and level."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return docs.join(levels(spark, d), "doc_id").groupBy("source", "nivel").agg(F.count(F.lit(1)).alias("documentos"), F.sum("n_chars").alias("caracteres"))
