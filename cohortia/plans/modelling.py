"""Queries on splits, codes, features, model tables, training and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.functions.draws import QUARTER, sql_draw, sql_exploded_draw, sql_poisson
from cohortia.operators import codes, evaluate, features, model, partition
from cohortia.operators.skew import sized_join
from cohortia.plans.charlson import PREFIXES, REPLACES
from cohortia.plans.cohort import LABELS_SQL, flagged, labelled
from cohortia.plans.discharges import DISCHARGES_SQL, DX, PX, RECORDS_SQL, discharges, records
from cohortia.plans.registry import Registry
from cohortia.plans.sqltext import sql_read
from cohortia.session import cut, table

REG = Registry()
LABELS = ["readmit_30d", "readmit_30d_mdc", "readmit_7d", "readmit_7d_mdc"]
HOSPITAL = "HOSPITALIZACIÓN"  # fixed value: the activity of a full hospital stay
LEAST_N, LEAST_V, FOLDS = 100, 0.01, 5


# ---------------------------------------------------------------- splits

def strata(spark: SparkSession, d: str, cases: DataFrame | None = None) -> DataFrame:
    rows = discharges(spark, d).select("encounter_id", "patient_id", "block")
    cases = labelled(spark, d) if cases is None else cases
    return partition.patient_strata(rows.join(cases.select("encounter_id", *LABELS), "encounter_id", "left"), LABELS)


STRATA_SQL = f"""
sr AS (SELECT b.patient_id, b.block, {', '.join('lab.' + x for x in LABELS)} FROM b LEFT JOIN lab USING (encounter_id) WHERE b.patient_id IS NOT NULL),
st AS (SELECT patient_id, block, count(readmit_30d) AS cases, coalesce(sum(readmit_30d), 0)::BIGINT AS positives,
  {' || '.join(f"coalesce(max({x}), 0)::VARCHAR" for x in LABELS)} AS pattern FROM sr GROUP BY 1, 2),
su AS (SELECT *, concat_ws('-', block, CASE WHEN cases > 0 THEN pattern ELSE 'NONE' END) AS stratum FROM st)"""


def _deal_sql(purpose: str, seed: int) -> str:
    u, start = sql_draw(seed, purpose, "patient_id"), sql_draw(seed, f"{purpose}-start", "stratum")
    return f"""(SELECT *, CAST((row_number() OVER (PARTITION BY stratum ORDER BY positives, cases, {u}, patient_id) - 1 + {start} % {FOLDS}) % {FOLDS} + 1 AS INTEGER) AS part FROM su)"""


@REG.add("partition_ids", f"WITH {DISCHARGES_SQL}, {LABELS_SQL}, {STRATA_SQL} SELECT patient_id, block, stratum, CASE WHEN part = 5 THEN 'PRUEBA' ELSE 'DESARROLLO' END AS subset FROM {_deal_sql('split', 20250)}")
def partition_ids(spark: SparkSession, d: str) -> DataFrame:
    return partition.split_patients(strata(spark, d), FOLDS, 20_250).select("patient_id", "block", "stratum", "subset")


@REG.add("partition_balance", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, {STRATA_SQL},
ps AS (SELECT patient_id, block, CASE WHEN part = 5 THEN 'PRUEBA' ELSE 'DESARROLLO' END AS subset FROM {_deal_sql('split', 20250)}),
x AS (SELECT b.*, subset FROM b JOIN ps USING (patient_id, block)),
c AS (SELECT 'admit_type' AS "column", coalesce(admit_type, 'SIN DATO') AS value, subset FROM x UNION ALL SELECT 'mdc', coalesce(mdc, 'SIN DATO'), subset FROM x UNION ALL SELECT 'year', year::VARCHAR, subset FROM x),
n AS (SELECT "column", value, subset, count(*) AS n FROM c GROUP BY 1, 2, 3),
s AS (SELECT "column", value, subset, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY "column", subset), 6) AS share FROM n)
SELECT *, CAST(max(share) OVER p - min(share) OVER p <= 0.005 AND count(*) OVER p = 2 AS INTEGER) AS within FROM s WINDOW p AS (PARTITION BY "column", value)""")
def partition_balance(spark: SparkSession, d: str) -> DataFrame:
    """Composition of both subsets, and whether each value's shares lie within half a point of each other."""
    ids = cut(partition.split_patients(strata(spark, d), FOLDS, 20_250).select("patient_id", "block", "subset"), "reparto")
    return partition.within_tolerance(partition.balance(sized_join(discharges(spark, d), ids, ["patient_id", "block"], "inner"), "subset", ["admit_type", "mdc", "year"]), "subset")


def folded(spark: SparkSession, d: str, cases: DataFrame | None = None) -> DataFrame:
    """Labelled cases with the fold of their patient identifier. cases: labelled(), where it is at hand as a written table."""
    cases = cut(labelled(spark, d), "casos") if cases is None else cases
    ids = discharges(spark, d).select("encounter_id", "patient_id")
    dealt = partition.systematic_deal(strata(spark, d, cases), "stratum", ["positives", "cases"], "patient_id", FOLDS, 13, "folds")
    folds = dealt.select("patient_id", "block", F.col("part").alias("fold"))
    return sized_join(cases.join(ids, "encounter_id"), cut(folds, "pliegues"), ["patient_id", "block"], "inner")


FOLDS_SQL = f"""{STRATA_SQL},
fo AS (SELECT patient_id, block, part AS fold FROM {_deal_sql('folds', 13)}),
fc AS (SELECT lab.*, fo.fold FROM lab JOIN fo USING (patient_id, block))"""


@REG.add("cv_folds", f"WITH {DISCHARGES_SQL}, {LABELS_SQL}, {FOLDS_SQL} SELECT encounter_id, fold FROM fc")
def cv_folds(spark: SparkSession, d: str) -> DataFrame:
    return folded(spark, d).select("encounter_id", "fold")


@REG.add("temporal_groups", f"WITH {DISCHARGES_SQL}, {LABELS_SQL} SELECT year, CASE WHEN year < 2023 THEN 'TRAIN' ELSE 'EVALUATE' END AS period, count(*) AS cases FROM lab GROUP BY ALL")
def temporal_groups(spark: SparkSession, d: str) -> DataFrame:
    return partition.temporal_groups(with_patients(spark, d)).groupBy("year", "period").agg(F.count(F.lit(1)).alias("cases"))


def with_patients(spark: SparkSession, d: str) -> DataFrame:
    return cut(labelled(spark, d).join(discharges(spark, d).select("encounter_id", "patient_id"), "encounter_id"), "casos")


@REG.add("seen_patient", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, k AS (SELECT DISTINCT patient_id, block FROM lab WHERE year < 2023)
SELECT encounter_id, CASE WHEN year >= 2023 THEN CAST(k.patient_id IS NOT NULL AS INTEGER) END AS seen FROM lab LEFT JOIN k USING (patient_id, block)""")
def seen_patient(spark: SparkSession, d: str) -> DataFrame:
    """Whether the patient has a case in a training year."""
    return partition.temporal_groups(with_patients(spark, d)).select("encounter_id", "seen")


@REG.add("seen_patient_any", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, k AS (SELECT DISTINCT patient_id, block FROM b WHERE year < 2023 AND patient_id IS NOT NULL)
SELECT encounter_id, CASE WHEN year >= 2023 THEN CAST(k.patient_id IS NOT NULL AS INTEGER) END AS seen FROM lab LEFT JOIN k USING (patient_id, block)""")
def seen_patient_any(spark: SparkSession, d: str) -> DataFrame:
    """Whether the patient has any discharge in a training year."""
    rows = discharges(spark, d).select("patient_id", "block", "year")
    return partition.temporal_groups(with_patients(spark, d), known=rows).select("encounter_id", "seen")


@REG.add("registered_split_check", """WITH a AS (SELECT DISTINCT id_egreso FROM grd_depurado WHERE id_persona IS NOT NULL), b AS (SELECT DISTINCT id_egreso FROM particion)
SELECT count(*) FILTER (a.id_egreso = b.id_egreso) AS "both", count(*) FILTER (b.id_egreso IS NULL) AS only_table, count(*) FILTER (a.id_egreso IS NULL) AS only_registered FROM a FULL JOIN b ON a.id_egreso = b.id_egreso""")
def registered_split_check(spark: SparkSession, d: str) -> DataFrame:
    return partition.registered_check(table(spark, d, "grd_depurado").where("id_persona IS NOT NULL"), table(spark, d, "particion"), "id_egreso")


@REG.add("straddling_share", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, u AS (SELECT patient_id, block, count(*) AS m FROM lab WHERE patient_id IS NOT NULL GROUP BY ALL)
SELECT round(sum(m * (1 - pow(0.2::DOUBLE, m - 1))) / sum(m), 6) AS straddling FROM u""")
def straddling_share(spark: SparkSession, d: str) -> DataFrame:
    units = labelled(spark, d).join(discharges(spark, d).select("encounter_id", "patient_id"), "encounter_id").where("patient_id IS NOT NULL").groupBy("patient_id", "block").agg(F.count(F.lit(1)).alias("m"))
    return units.agg(F.round(partition.straddling_share(units, "m"), 6).alias("straddling"))


@REG.add("crosstab_split", f"""SELECT coalesce({sql_read('conjunto')}, 'SIN DATO') AS subset, CAST(sum((bloque_id = 'A')::INTEGER) AS BIGINT) AS a, CAST(sum((bloque_id = 'B')::INTEGER) AS BIGINT) AS b FROM particion GROUP BY 1""")
def crosstab_split(spark: SparkSession, d: str) -> DataFrame:
    from cohortia.functions.text import read_value

    rows = table(spark, d, "particion").select(F.coalesce(read_value("conjunto"), F.lit("SIN DATO")).alias("subset"), F.lower("bloque_id").alias("block"))
    return rows.groupBy("subset").pivot("block", ["a", "b"]).count().fillna(0)


# ---------------------------------------------------------------- codes

BLOCKS = {"DIAGNOSTICO": DX, "PROCEDIMIENTO": PX}


def record_pairs(spark: SparkSession, d: str, levels: tuple[str, ...] = ("COMPLETO", "CATEGORIA")) -> DataFrame:
    return codes.code_pairs(table(spark, d, "grd_2019_2024").withColumnRenamed("id_egreso", "encounter_id"), "encounter_id", BLOCKS, levels)


def case_pairs(spark: SparkSession, d: str, levels: tuple[str, ...] = ("COMPLETO", "CATEGORIA"), cases: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The codes of the cases with the cases' columns in keep: records are joined while they are one row each, then unfolded."""
    cases = labelled(spark, d) if cases is None else cases
    wide = table(spark, d, "grd_2019_2024").select(F.col("id_egreso").alias("encounter_id"), *DX, *PX)
    return codes.code_pairs(wide.join(cases.select("encounter_id", *keep), "encounter_id"), "encounter_id", BLOCKS, levels, keep)


_LONG = " UNION ALL ".join(f"SELECT id_egreso AS encounter_id, '{b}' AS block, {sql_read(c)} AS code FROM grd_2019_2024" for b, cols in BLOCKS.items() for c in cols)
PAIRS_SQL = f"""
lg AS ({_LONG}),
cp AS (SELECT DISTINCT encounter_id, block, 'COMPLETO' AS level, code FROM lg WHERE code IS NOT NULL
  UNION SELECT DISTINCT encounter_id, block, 'CATEGORIA', split_part(code, '.', 1) FROM lg WHERE code IS NOT NULL),
pr AS MATERIALIZED (SELECT cp.* FROM cp SEMI JOIN lab USING (encounter_id))"""


def _measures_sql(counts: str, extra: str = "") -> str:
    """Same formulas over (n, c, total, positives) as doubles."""
    return f"""(SELECT *, CASE WHEN c > 0 AND w0 > 0 THEN round(w1 / w0, 6) END AS risk, CASE WHEN w1 > w0 THEN 'RISK' WHEN w1 < w0 THEN 'PROTECTIVE' ELSE 'NONE' END AS direction,
  round(100 * w1, 6) AS rate_with, round(100 * w0, 6) AS rate_without, round(raw_chi2, 6) AS chi2, round(sqrt(raw_chi2 / total), 6) AS v FROM (
  SELECT *, c::DOUBLE / nullif(n, 0) AS w1, (positives - c)::DOUBLE / nullif(total - n, 0) AS w0,
    coalesce((c - n::DOUBLE * positives / total) ** 2 / nullif(n::DOUBLE * positives / total, 0), 0)
    + coalesce((n - c - n::DOUBLE * (total - positives) / total) ** 2 / nullif(n::DOUBLE * (total - positives) / total, 0), 0)
    + coalesce((positives - c - (total - n)::DOUBLE * positives / total) ** 2 / nullif((total - n)::DOUBLE * positives / total, 0), 0)
    + coalesce((total - n - positives + c - (total - n)::DOUBLE * (total - positives) / total) ** 2 / nullif((total - n)::DOUBLE * (total - positives) / total, 0), 0) AS raw_chi2
  FROM {counts}))"""


COUNTS_SQL = """
tt AS (SELECT count(*) AS total, sum(readmit_30d)::BIGINT AS positives FROM lab WHERE readmit_30d IS NOT NULL),
ct AS (SELECT block, level, code, count(*) AS n, sum(readmit_30d)::BIGINT AS c, any_value(total) AS total, any_value(positives) AS positives
  FROM pr JOIN lab USING (encounter_id), tt WHERE readmit_30d IS NOT NULL GROUP BY block, level, code)""".replace("SELECT block, level, code, count", "SELECT pr.block, level, code, count").replace("GROUP BY block, level", "GROUP BY pr.block, level")
CODES_SQL = f"WITH {DISCHARGES_SQL}, {LABELS_SQL}, {PAIRS_SQL}, {COUNTS_SQL}, ms AS {_measures_sql('ct')}"
LIST_A = f"n >= {LEAST_N} AND v >= {LEAST_V}"
LIST_C = f"n >= {LEAST_N} AND (v >= {LEAST_V} OR ((risk >= 2 OR risk <= 0.5) AND chi2 > {codes.CHI2_P001}))"


def measured(spark: SparkSession, d: str) -> DataFrame:
    cases = cut(labelled(spark, d).select("encounter_id", "readmit_30d"), "casos")
    return codes.association(case_pairs(spark, d, cases=cases, keep=("readmit_30d",)), cases, "encounter_id", "readmit_30d")


@REG.add("code_pairs", f"WITH {DISCHARGES_SQL}, {LABELS_SQL}, {PAIRS_SQL} SELECT encounter_id, block, level, code FROM pr")
def code_pairs(spark: SparkSession, d: str) -> DataFrame:
    return case_pairs(spark, d)


@REG.add("chi2_cramers_v", f"{CODES_SQL} SELECT block, level, code, n, c, rate_with, rate_without, chi2, v, risk, direction FROM ms")
def chi2_cramers_v(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d).select("block", "level", "code", "n", "c", "rate_with", "rate_without", "chi2", "v", "risk", "direction")


@REG.add("code_p_values")
def code_p_values(spark: SparkSession, d: str) -> DataFrame:
    return codes.with_p_value(measured(spark, d).select("block", "level", "code", "chi2")).withColumn("p", F.round("p", 9))


@REG.add("code_list_a", f"{CODES_SQL} SELECT block, level, code FROM ms WHERE {LIST_A} AND level = 'COMPLETO'")
def code_list_a(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d).where(codes.in_list_a(LEAST_N, LEAST_V) & (F.col("level") == "COMPLETO")).select("block", "level", "code")


@REG.add("code_list_c", f"{CODES_SQL} SELECT block, level, code FROM ms WHERE {LIST_C} AND level = 'COMPLETO'")
def code_list_c(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d).where(codes.in_list_c(LEAST_N, LEAST_V) & (F.col("level") == "COMPLETO")).select("block", "level", "code")


@REG.add("code_list_grouped", f"{CODES_SQL} SELECT block, level, code FROM ms WHERE {LIST_A} AND ((block = 'DIAGNOSTICO' AND level = 'CATEGORIA') OR (block = 'PROCEDIMIENTO' AND level = 'COMPLETO'))")
def code_list_grouped(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d).where(codes.in_grouped_list(LEAST_N, LEAST_V)).select("block", "level", "code")


@REG.add("codes_recovered_by_grouping", f"""{CODES_SQL}, a AS (SELECT * FROM ms WHERE {LIST_A})
SELECT m.code FROM ms m WHERE m.block = 'DIAGNOSTICO' AND m.level = 'COMPLETO' AND NOT EXISTS (SELECT 1 FROM a WHERE a.block = m.block AND a.level = m.level AND a.code = m.code)
  AND EXISTS (SELECT 1 FROM a WHERE a.block = m.block AND a.level = 'CATEGORIA' AND a.code = split_part(m.code, '.', 1))""")
def codes_recovered_by_grouping(spark: SparkSession, d: str) -> DataFrame:
    """Codes that fail alone while their category passes: a semi and an anti join."""
    m = cut(measured(spark, d).where("block = 'DIAGNOSTICO'"), "medidas")
    passed = m.where(codes.in_list_a(LEAST_N, LEAST_V))
    alone = m.where("level = 'COMPLETO'").select("code", F.substring_index("code", ".", 1).alias("category"))
    failing = alone.join(passed.where("level = 'COMPLETO'").select("code"), "code", "left_anti")
    return failing.join(passed.where("level = 'CATEGORIA'").select(F.col("code").alias("category")), "category", "left_semi").select("code")


@REG.add("threshold_grid", f"{CODES_SQL} " + " UNION ALL ".join(f"SELECT {a} AS least_n, {b}::DOUBLE AS least_v, CAST(coalesce(sum((n >= {a} AND v >= {b})::INTEGER), 0) AS BIGINT) AS codes FROM ms" for a in (50, 100, 500) for b in (0.005, 0.01, 0.02)))
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return codes.threshold_grid(measured(spark, d), [50, 100, 500], [0.005, 0.01, 0.02])


@REG.add("top_codes_by_direction", f"{CODES_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY direction ORDER BY v DESC, block, level, code) AS INTEGER) AS place FROM ms) SELECT direction, place, block, level, code, v FROM r WHERE place <= 10")
def top_codes_by_direction(spark: SparkSession, d: str) -> DataFrame:
    return codes.top_by_direction(measured(spark, d)).select("direction", "place", "block", "level", "code", "v")


@REG.add("least_rate_for_v", f"{CODES_SQL} SELECT block, level, code, round(100 * (positives::DOUBLE / total + 0.01 * sqrt(positives::DOUBLE / total * (1 - positives::DOUBLE / total) * (total - n) / n)), 6) AS least_rate FROM ms")
def least_rate_for_v(spark: SparkSession, d: str) -> DataFrame:
    return codes.least_rate_for_v(measured(spark, d)).select("block", "level", "code", "least_rate")


FOLD_COUNTS_SQL = f"""
fk AS (SELECT unnest(range(0, {FOLDS + 1})) AS k),
fot AS (SELECT k, count(*) AS total, sum(readmit_30d)::BIGINT AS positives FROM fc, fk WHERE readmit_30d IS NOT NULL AND fold <> k GROUP BY k),
fn AS (SELECT k, pr.block, level, code, count(*) FILTER (fold <> k) AS n, coalesce(sum(readmit_30d) FILTER (fold <> k), 0)::BIGINT AS c FROM pr JOIN fc USING (encounter_id), fk WHERE readmit_30d IS NOT NULL GROUP BY ALL),
fm AS (SELECT fn.*, fot.total, fot.positives FROM fn JOIN fot USING (k))"""
PER_FOLD_SQL = f"WITH {DISCHARGES_SQL}, {LABELS_SQL}, {FOLDS_SQL}, {PAIRS_SQL}, {FOLD_COUNTS_SQL}, ms AS {_measures_sql('fm')}"


def fold_measures(spark: SparkSession, d: str) -> DataFrame:
    cases = cut(folded(spark, d).select("encounter_id", "readmit_30d", "fold"), "plegados")
    return codes.per_fold(case_pairs(spark, d, ("COMPLETO",), cases, ("readmit_30d", "fold")), cases, "encounter_id", "readmit_30d", "fold", FOLDS)


@REG.add("code_counts_per_fold", f"{PER_FOLD_SQL} SELECT CAST(k AS INTEGER) AS fold, block, code, n, c, total, positives FROM ms WHERE level = 'COMPLETO'")
def code_counts_per_fold(spark: SparkSession, d: str) -> DataFrame:
    """Every code of the cases for every fold left out, zeros included."""
    return fold_measures(spark, d).select("fold", "block", "code", "n", "c", "total", "positives")


@REG.add("code_list_per_fold", f"{PER_FOLD_SQL} SELECT CAST(k AS INTEGER) AS fold, block, code FROM ms WHERE {LIST_A} AND level = 'COMPLETO'")
def code_list_per_fold(spark: SparkSession, d: str) -> DataFrame:
    return fold_measures(spark, d).where(codes.in_list_a(LEAST_N, LEAST_V)).select("fold", "block", "code")


@REG.add("list_stability", f"""{PER_FOLD_SQL}, m AS (SELECT k, block, code FROM ms WHERE {LIST_A} AND level = 'COMPLETO'), w AS (SELECT block, code FROM m WHERE k = 0),
g AS (SELECT k, CAST(count(w.code) AS BIGINT) AS "both", CAST(count(*) - count(w.code) AS BIGINT) AS entering FROM m LEFT JOIN w USING (block, code) WHERE k > 0 GROUP BY k)
SELECT CAST(k AS INTEGER) AS fold, "both", entering, (SELECT count(*) FROM w) - "both" AS leaving, round("both"::DOUBLE / nullif(entering + (SELECT count(*) FROM w), 0), 6) AS jaccard FROM g""")
def list_stability(spark: SparkSession, d: str) -> DataFrame:
    return codes.list_stability(fold_measures(spark, d).where(codes.in_list_a(LEAST_N, LEAST_V)), FOLDS)


@REG.add("code_prevalence_drift", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, {PAIRS_SQL},
y AS (SELECT pr.block, pr.level, pr.code, lab.year, count(*) AS n FROM pr JOIN lab USING (encounter_id) GROUP BY ALL), t AS (SELECT block, level, year, sum(n) AS t FROM y GROUP BY ALL),
q AS (SELECT block, level, count(*) AS years FROM t GROUP BY ALL), s AS (SELECT y.*, n / t.t::DOUBLE AS s FROM y JOIN t USING (block, level, year)),
p AS (SELECT block, level, code, min(s) AS lo, max(s) AS hi, count(*) AS seen FROM s GROUP BY ALL)
SELECT block, level, code, round(hi / lo, 6) AS ratio, years - seen AS missing_years FROM p JOIN q USING (block, level) WHERE seen < years OR hi > 3.0 * lo""")
def code_prevalence_drift(spark: SparkSession, d: str) -> DataFrame:
    return codes.prevalence_drift(case_pairs(spark, d, keep=("year",)), "year")


@REG.add("lists_per_code", """
WITH p AS (SELECT DISTINCT bloque, nivel, codigo, variable_objetivo FROM filtro_codigos WHERE pasa)
SELECT bloque, nivel, codigo, count(*) AS outcomes, string_agg(variable_objetivo, ', ' ORDER BY variable_objetivo) AS names FROM p GROUP BY ALL""")
def lists_per_code(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes whose registered list holds each code, and their names in order."""
    p = table(spark, d, "filtro_codigos").where("pasa").select("bloque", "nivel", "codigo", "variable_objetivo").distinct()
    return p.groupBy("bloque", "nivel", "codigo").agg(F.count(F.lit(1)).alias("outcomes"), F.array_join(F.sort_array(F.collect_set("variable_objetivo")), ", ").alias("names"))


@REG.add("union_of_lists_jaccard", """
WITH a AS (SELECT DISTINCT bloque, nivel, codigo FROM filtro_codigos WHERE pasa AND variable_objetivo = 'REING_30D'), b AS (SELECT DISTINCT bloque, nivel, codigo FROM filtro_codigos WHERE pasa AND variable_objetivo <> 'REING_30D'),
i AS (SELECT * FROM a INTERSECT SELECT * FROM b), u AS (SELECT * FROM a UNION SELECT * FROM b)
SELECT (SELECT count(*) FROM i) AS shared, (SELECT count(*) FROM u) AS either, round((SELECT count(*) FROM i)::DOUBLE / nullif((SELECT count(*) FROM u), 0), 6) AS jaccard""")
def union_of_lists_jaccard(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "filtro_codigos").where("pasa")
    held = p.groupBy("bloque", "nivel", "codigo").agg(F.max((F.col("variable_objetivo") == "REING_30D").cast("int")).alias("a"), F.max((F.col("variable_objetivo") != "REING_30D").cast("int")).alias("b"))
    g = held.agg(F.coalesce(F.sum((F.col("a") * F.col("b")).cast("bigint")), F.lit(0)).alias("shared"), F.count(F.lit(1)).alias("either"))
    return g.withColumn("jaccard", F.round(F.col("shared") / F.nullif("either", F.lit(0)), 6))


# ---------------------------------------------------------------- features

def episode_ends(spark: SparkSession, d: str) -> DataFrame:
    """One row per episode: its days, whether it was opened unplanned, holds a hospital stay, day surgery or a treatment session
    (a periodic treatment counts as one)."""
    rows = flagged(spark, d).where("person_id IS NOT NULL AND episode_id IS NOT NULL AND admit IS NOT NULL AND discharge IS NOT NULL")
    opening = F.col("encounter_id") == F.col("episode_id")
    any_row = lambda c: F.max(F.coalesce(c, F.lit(False)))
    return rows.groupBy("person_id", "episode_id").agg(
        F.max("discharge").alias("end"), F.max(F.when(opening, F.col("admit_type").isin("URGENCIA", "OBSTETRICA"))).alias("unplanned"), F.min("admit").alias("begin"),
        any_row(F.col("activity") == HOSPITAL).alias("hospital"), any_row(F.col("day_surgery")).alias("surgery"), any_row(F.col("session") | F.col("periodic")).alias("sessions"),
    )


def index_cases(spark: SparkSession, d: str, cases: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Each episode's last discharge, with the episode's first admission as index day. cases, ends: labelled() and episode_ends(),
    where they are at hand as written tables; so with `index` and `ends` of the functions below."""
    ends = (episode_ends(spark, d) if ends is None else ends).select("episode_id", F.col("begin").alias("index_day"))
    cases = labelled(spark, d) if cases is None else cases
    return cases.join(discharges(spark, d).select("encounter_id", "episode_id", "patient_id"), "encounter_id").join(ends, "episode_id").withColumn("admit", F.col("index_day"))


INDEX_SQL = """
en AS (SELECT person_id, episode_id, max(discharge) AS e, min(admit) AS i, max(CASE WHEN encounter_id = episode_id THEN admit_type IN ('URGENCIA', 'OBSTETRICA') END) AS unplanned,
  max(coalesce(activity = 'HOSPITALIZACIÓN', false)) AS hospital, max(day_surgery) AS surgery, max(session OR periodic) AS sessions FROM fb
  WHERE person_id IS NOT NULL AND episode_id IS NOT NULL AND admit IS NOT NULL AND discharge IS NOT NULL GROUP BY 1, 2),
ic AS (SELECT lab.encounter_id, lab.person_id, lab.episode_id, en.i, lab.block FROM lab JOIN en ON en.episode_id = lab.episode_id),
hs AS (SELECT ic.encounter_id, count(en.e) FILTER (en.e BETWEEN ic.i - 365 AND ic.i AND en.hospital) AS stays, count(en.e) FILTER (en.e BETWEEN ic.i - 365 AND ic.i AND en.unplanned AND en.hospital) AS unplanned,
  count(en.e) FILTER (en.e BETWEEN ic.i - 365 AND ic.i AND en.surgery) AS surgeries, count(en.e) FILTER (en.e BETWEEN ic.i - 365 AND ic.i AND en.sessions) AS sessions,
  least(coalesce(ic.i - max(en.e) FILTER (en.e <= ic.i AND en.hospital), 366), 366) AS days_since
  FROM ic LEFT JOIN en ON en.person_id = ic.person_id AND en.episode_id <> ic.episode_id GROUP BY ic.encounter_id, ic.i)"""


def case_history(spark: SparkSession, d: str, index: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    return features.history(
        index_cases(spark, d) if index is None else index, cut(episode_ends(spark, d), "episodios") if ends is None else ends, 365,
        {"stays": F.col("hospital"), "unplanned": F.col("unplanned") & F.col("hospital"), "surgeries": F.col("surgery"), "sessions": F.col("sessions")},
    )


@REG.add("prior_stays_365d", f"WITH {DISCHARGES_SQL}, {LABELS_SQL}, {INDEX_SQL} SELECT encounter_id, stays FROM hs")
def prior_stays_365d(spark: SparkSession, d: str) -> DataFrame:
    return case_history(spark, d).select("encounter_id", "stays")


@REG.add("prior_unplanned_365d", f"WITH {DISCHARGES_SQL}, {LABELS_SQL}, {INDEX_SQL} SELECT encounter_id, unplanned FROM hs")
def prior_unplanned_365d(spark: SparkSession, d: str) -> DataFrame:
    return case_history(spark, d).select("encounter_id", "unplanned")


@REG.add("prior_surgeries_and_sessions", f"WITH {DISCHARGES_SQL}, {LABELS_SQL}, {INDEX_SQL} SELECT encounter_id, surgeries, sessions FROM hs")
def prior_surgeries_and_sessions(spark: SparkSession, d: str) -> DataFrame:
    return case_history(spark, d).select("encounter_id", "surgeries", "sessions")


@REG.add("days_since_last", f"WITH {DISCHARGES_SQL}, {LABELS_SQL}, {INDEX_SQL} SELECT encounter_id, CAST(days_since AS BIGINT) AS days_since FROM hs")
def days_since_last(spark: SparkSession, d: str, index: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    ends = episode_ends(spark, d) if ends is None else ends
    return features.days_since_last(index_cases(spark, d) if index is None else index, ends.where("hospital"), 365)


@REG.add("window_truncated", f"WITH {DISCHARGES_SQL}, {LABELS_SQL}, {INDEX_SQL} SELECT encounter_id, CAST(i - 365 < CASE block WHEN 'A' THEN DATE '2019-01-01' WHEN 'B' THEN DATE '2021-01-01' END AS INTEGER) AS truncated FROM ic")
def window_truncated(spark: SparkSession, d: str, index: DataFrame | None = None) -> DataFrame:
    begin = F.when(F.col("block") == "A", F.lit("2019-01-01")).when(F.col("block") == "B", F.lit("2021-01-01")).cast("date")
    index = index_cases(spark, d) if index is None else index
    return index.select("encounter_id", (F.date_sub("admit", 365) < begin).cast("int").alias("truncated"))


@REG.add("history_bands_rate", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, {INDEX_SQL}
SELECT CASE WHEN stays = 0 THEN '0' WHEN stays = 1 THEN '1' WHEN stays <= 3 THEN '2-3' ELSE '4+' END AS band, count(*) AS cases, count(readmit_30d) AS observed,
  CAST(coalesce(sum(readmit_30d), 0) AS BIGINT) AS positives, round(coalesce(sum(readmit_30d), 0)::DOUBLE / nullif(count(readmit_30d), 0), 6) AS rate FROM hs JOIN lab USING (encounter_id) GROUP BY 1""")
def history_bands_rate(spark: SparkSession, d: str) -> DataFrame:
    from cohortia.operators.labels import rates_by

    s = F.col("stays")
    band = F.when(s == 0, "0").when(s == 1, "1").when(s <= 3, "2-3").otherwise("4+")
    j = case_history(spark, d).select("encounter_id", band.alias("band")).join(labelled(spark, d), "encounter_id")
    return rates_by(j, ["band"], "readmit_30d")


_PX_SQL = f"""px(condition, prefix, weight) AS (VALUES {', '.join(f"('{c}', '{p}', {w})" for c, p, w in PREFIXES)})"""
_DROP_SQL = " AND ".join(f"NOT (condition = '{mild}' AND EXISTS (SELECT 1 FROM mk s WHERE s.encounter_id = m.encounter_id AND s.condition = '{severe}'))" for severe, mild in REPLACES)


def _comorbidity_sql(columns: list[str]) -> str:
    codes_sql = " UNION ".join(f"SELECT id_egreso AS encounter_id, replace({sql_read(c)}, '.', '') AS bare FROM grd_2019_2024 WHERE {sql_read(c)} IS NOT NULL" for c in columns)
    return f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, {_PX_SQL}, dc AS ({codes_sql}), hit AS MATERIALIZED (SELECT DISTINCT bare, condition, weight FROM (SELECT DISTINCT bare FROM dc) JOIN px ON starts_with(bare, prefix)),
mk AS MATERIALIZED (SELECT DISTINCT encounter_id, condition, weight FROM dc JOIN hit USING (bare) SEMI JOIN lab USING (encounter_id))"""


def diagnosis_pairs(spark: SparkSession, d: str, columns: list[str], cases: DataFrame) -> DataFrame:
    wide = table(spark, d, "grd_2019_2024").select(F.col("id_egreso").alias("encounter_id"), *columns)
    return codes.code_pairs(wide.join(cases.select("encounter_id"), "encounter_id"), "encounter_id", {"DIAGNOSTICO": columns})


def _comorbidity(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    prefixes = spark.createDataFrame(PREFIXES, "condition string, prefix string, weight bigint")
    return features.comorbidity(diagnosis_pairs(spark, d, columns, labelled(spark, d)), prefixes, REPLACES, "encounter_id")


_SCORE_SQL = f"SELECT encounter_id, CAST(count(*) AS INTEGER) AS conditions, CAST(sum(weight) AS BIGINT) AS score FROM mk m WHERE {_DROP_SQL} GROUP BY 1"


@REG.add("comorbidity_score", f"{_comorbidity_sql(DX[1:])} {_SCORE_SQL}")
def comorbidity_score(spark: SparkSession, d: str) -> DataFrame:
    """Charlson conditions and score of the cases that have any, from the secondary diagnoses."""
    return _comorbidity(spark, d, DX[1:])


@REG.add("comorbidity_with_principal", f"{_comorbidity_sql(DX)} {_SCORE_SQL}")
def comorbidity_with_principal(spark: SparkSession, d: str) -> DataFrame:
    return _comorbidity(spark, d, DX)


@REG.add("condition_rates", f"""{_comorbidity_sql(DX[1:])}
SELECT condition, count(*) AS n, round(avg(readmit_30d), 6) AS rate, round(count(*)::DOUBLE / (SELECT count(readmit_30d) FROM lab), 6) AS prevalence FROM mk JOIN lab USING (encounter_id) WHERE readmit_30d IS NOT NULL GROUP BY 1""")
def condition_rates(spark: SparkSession, d: str) -> DataFrame:
    """Prevalence and re-admission rate of each comorbid condition."""
    prefixes = spark.createDataFrame(PREFIXES, "condition string, prefix string, weight bigint")
    cases = cut(labelled(spark, d).select("encounter_id", "readmit_30d"), "casos")
    marks = features.condition_marks(diagnosis_pairs(spark, d, DX[1:], cases), prefixes, "encounter_id")
    return features.condition_rates(marks, cases, "encounter_id", "readmit_30d")


RAW_CATEGORIES = {"insurance": "prevision", "province": "provincia", "speciality": "especialidad_medica", "service": "servicioingreso"}
RAW_LEVELS = {"severity": "ir_29301_severidad", "mortality_risk": "ir_29301_mortalidad"}
_NAMED = lambda cols, t: ", ".join(f"coalesce({t}.{c}, 'SIN DATO') AS {c}" for c in cols)


@REG.add("case_features", f"""WITH {DISCHARGES_SQL}, {RECORDS_SQL}, {LABELS_SQL}, {INDEX_SQL},
rw AS (SELECT id_egreso AS encounter_id, {', '.join(f'{sql_read(c)} AS {n}' for n, c in RAW_CATEGORIES.items())}, {', '.join(f'CAST({c} AS INTEGER) AS {n}' for n, c in RAW_LEVELS.items())} FROM grd_2019_2024),
es AS (SELECT episode_id, count(*) AS parts, count(DISTINCT site) AS sites, max(CASE WHEN encounter_id = episode_id THEN admit_type END) AS opened_as FROM b WHERE episode_id IS NOT NULL GROUP BY 1)
SELECT lab.encounter_id, CAST(floor((ic.i - lab.birth) / 365.25::DOUBLE) AS BIGINT) AS age, CAST(lab.discharge - ic.i AS INTEGER) AS stay, {_NAMED(['sex', 'admit_type', 'mdc', 'origin', 'activity', 'discharge_type'], 'lab')}, {_NAMED(RAW_CATEGORIES, 'rw')},
  coalesce(es.opened_as, 'SIN DATO') AS opened_as, CASE WHEN lab.weight <> 0 THEN lab.weight END AS weight, rec.n_dx, rec.n_px, rw.severity, rw.mortality_risk, es.parts, es.sites, CAST(es.parts > 1 AS INTEGER) AS transferred,
  CAST(month(lab.discharge) AS INTEGER) AS month, CAST(isodow(lab.discharge) >= 6 AS INTEGER) AS weekend
FROM lab JOIN ic USING (encounter_id) JOIN rec USING (encounter_id) JOIN rw USING (encounter_id) JOIN es ON es.episode_id = lab.episode_id""")
def case_features(spark: SparkSession, d: str, index: DataFrame | None = None) -> DataFrame:
    """Features of the case and its episode: missing categories get a label, a weight of 0 is missing."""
    from cohortia.functions.text import read_value

    rows = discharges(spark, d)
    own = rows.select("encounter_id", "sex", "birth", "weight", "origin", "activity")
    raw = table(spark, d, "grd_2019_2024").select(
        F.col("id_egreso").alias("encounter_id"), *(read_value(c).alias(n) for n, c in RAW_CATEGORIES.items()), *(F.col(c).cast("int").alias(n) for n, c in RAW_LEVELS.items())
    )
    opening = F.col("encounter_id") == F.col("episode_id")
    whole = rows.where("episode_id IS NOT NULL").groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("parts"), F.count_distinct("site").alias("sites"), F.max(F.when(opening, F.col("admit_type"))).alias("opened_as")
    )
    counts = records(spark, d).select("encounter_id", "n_dx", "n_px")
    named = lambda c: F.coalesce(c, F.lit("SIN DATO")).alias(c)
    index = index_cases(spark, d) if index is None else index
    joined = index.join(own, "encounter_id").join(counts, "encounter_id").join(raw, "encounter_id").join(whole, "episode_id")
    return joined.select(
        "encounter_id", F.floor(F.datediff("admit", "birth") / 365.25).alias("age"), F.datediff("discharge", "admit").alias("stay"),
        *map(named, ("sex", "admit_type", "mdc", "origin", "activity", "discharge_type", *RAW_CATEGORIES, "opened_as")),
        F.when(F.col("weight") != 0, F.col("weight")).alias("weight"), "n_dx", "n_px", *RAW_LEVELS, "parts", "sites", (F.col("parts") > 1).cast("int").alias("transferred"),
        F.month("discharge").alias("month"), (F.weekday("discharge") >= 5).cast("int").alias("weekend"),
    )


MERGED = ["site", "admit_type", "discharge_type", "origin", "activity", "mdc", "sex"]


@REG.add("rare_merge", f"WITH {DISCHARGES_SQL}, n AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", coalesce({c}, 'SIN DATO') AS value, count(*) AS n FROM b GROUP BY 2""" for c in MERGED) + """)
SELECT "column", CASE WHEN n < 100 THEN 'OTRO' ELSE value END AS value, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1, 2""")
def rare_merge(spark: SparkSession, d: str) -> DataFrame:
    """Seven category columns, missing values named and rare ones united, and how often each value then stands."""
    rows = discharges(spark, d).select(*MERGED)
    for c in MERGED:
        rows = features.merge_rare(rows, c, 100)
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in MERGED))
    return rows.select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _auroc_sql(score: str, source: str) -> str:
    return f"""SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y)::DOUBLE * (count(*) - sum(y)), 0), 6) AS auroc
FROM (SELECT y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS r FROM {source})"""


@REG.add("univariate_auroc", f"WITH {DISCHARGES_SQL}, {LABELS_SQL}, {INDEX_SQL}, q AS (SELECT stays, readmit_30d AS y FROM hs JOIN lab USING (encounter_id) WHERE readmit_30d IS NOT NULL) {_auroc_sql('stays', 'q')}")
def univariate_auroc(spark: SparkSession, d: str) -> DataFrame:
    j = case_history(spark, d).select("encounter_id", "stays").join(labelled(spark, d), "encounter_id")
    return features.auroc(j, "stays", "readmit_30d")


@REG.add("extreme_categories", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL},
c AS (SELECT 'mdc' AS "column", coalesce(mdc, 'SIN DATO') AS value, readmit_30d AS y FROM lab WHERE readmit_30d IS NOT NULL UNION ALL SELECT 'site', coalesce(site, 'SIN DATO'), readmit_30d FROM lab WHERE readmit_30d IS NOT NULL),
r AS (SELECT "column", value, avg(y) AS rate FROM c GROUP BY 1, 2 HAVING count(*) >= 1000)
SELECT "column", min_by(value, {{'r': rate, 'v': value}}) AS lowest, round(min(rate), 6) AS lowest_rate, max_by(value, {{'r': rate, 'v': value}}) AS highest, round(max(rate), 6) AS highest_rate FROM r GROUP BY 1""")
def extreme_categories(spark: SparkSession, d: str) -> DataFrame:
    return features.extreme_categories(labelled(spark, d), ["mdc", "site"], "readmit_30d", 1000)


# ---------------------------------------------------------------- model tables

FORBIDDEN = {"days_to_next", "next_id", "readmit_7d_mdc", "readmit_30d_mdc"}
CASE_COLUMNS = ["encounter_id", "patient_id", "fold", "mdc", "admit_type", "stay", "stays", "unplanned", "readmit_7d", "readmit_30d"]


def model_case_table(spark: SparkSession, d: str) -> DataFrame:
    begin = index_cases(spark, d).select("encounter_id", F.datediff("discharge", "admit").alias("stay"))
    h = case_history(spark, d).select("encounter_id", "stays", "unplanned")
    cases = folded(spark, d).join(begin, "encounter_id").join(h, "encounter_id")
    made = cases.withColumn("mdc", F.coalesce("mdc", F.lit("SIN DATO"))).withColumn("admit_type", F.coalesce("admit_type", F.lit("SIN DATO"))).select(*CASE_COLUMNS)
    return model.without_outcomes(made, FORBIDDEN)


@REG.add("model_cases", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, {FOLDS_SQL}, {INDEX_SQL}
SELECT fc.encounter_id, fc.patient_id, fc.fold, coalesce(fc.mdc, 'SIN DATO') AS mdc, coalesce(fc.admit_type, 'SIN DATO') AS admit_type, CAST(fc.discharge - ic.i AS INTEGER) AS stay, hs.stays, hs.unplanned, readmit_7d, readmit_30d
FROM fc JOIN ic USING (encounter_id) JOIN hs USING (encounter_id)""")
def model_cases(spark: SparkSession, d: str) -> DataFrame:
    return model_case_table(spark, d)


@REG.add("model_codes", f"{CODES_SQL}, a AS MATERIALIZED (SELECT block, level, code FROM ms WHERE {LIST_A}) SELECT pr.encounter_id, block, level, code FROM pr JOIN a USING (block, level, code)")
def model_codes(spark: SparkSession, d: str) -> DataFrame:
    listed = measured(spark, d).where(codes.in_list_a(LEAST_N, LEAST_V)).select("block", "level", "code")
    return case_pairs(spark, d).join(cut(listed, "lista"), ["block", "level", "code"])


@REG.add("code_matrix_sizes", f"""{CODES_SQL}, a AS (SELECT 'A' AS list, block, level, code FROM ms WHERE {LIST_A} AND level = 'COMPLETO' UNION ALL SELECT 'C', block, level, code FROM ms WHERE {LIST_C} AND level = 'COMPLETO'
  UNION ALL SELECT 'SIN_FILTRO', block, level, code FROM ms WHERE n >= {LEAST_N} AND level = 'COMPLETO'),
h AS (SELECT list, count(*) AS ones, count(DISTINCT encounter_id) AS cases_with_code FROM a JOIN pr USING (block, level, code) GROUP BY 1), k AS (SELECT list, count(*) AS columns FROM a GROUP BY 1)
SELECT list, columns, ones, cases_with_code, round(ones::DOUBLE / (columns * (SELECT count(*) FROM lab)), 6) AS density FROM k JOIN h USING (list)""")
def code_matrix_sizes(spark: SparkSession, d: str) -> DataFrame:
    m = cut(measured(spark, d).where("level = 'COMPLETO'"), "medidas")
    named = lambda name, rule: m.where(rule).select(F.lit(name).alias("list"), "block", "level", "code")
    lists = named("A", codes.in_list_a(LEAST_N, LEAST_V)).unionByName(named("C", codes.in_list_c(LEAST_N, LEAST_V))).unionByName(named("SIN_FILTRO", F.col("n") >= LEAST_N))
    return model.matrix_size(case_pairs(spark, d, ("COMPLETO",)), lists, labelled(spark, d), "encounter_id")


# ---------------------------------------------------------------- training

MODEL_NUMERIC = ["stay", "weight", "stays", "unplanned", "surgeries", "sessions", "age", "n_dx", "n_px", "days_since", "weekend", "truncated", "severity", "mortality_risk", "parts", "sites"]
MODEL_CATEGORIES = ["sex", "mdc", "admit_type", "month", "site", "origin", "activity", "discharge_type", *RAW_CATEGORIES, "opened_as"]
MODEL_LOGGED = ("stay", "weight", "stays", "unplanned", "surgeries", "sessions")


def training_table(spark: SparkSession, d: str, known: DataFrame, dealt: DataFrame) -> DataFrame:
    """Cases with the features of the case, its history and its site. known, dealt: labelled() and folded() as written tables.
    Labels, episodes and index days are found once and read by every feature."""
    ends = cut(episode_ends(spark, d), "episodios")
    index = cut(index_cases(spark, d, known, ends), "indice")
    sites = known.select("encounter_id", F.coalesce("site", F.lit("SIN DATO")).alias("site"))
    cases = dealt.select("encounter_id", "fold", "readmit_30d").join(case_features(spark, d, index), "encounter_id").join(sites, "encounter_id")
    history = case_history(spark, d, index, ends).select("encounter_id", "stays", "unplanned", "surgeries", "sessions")
    for more in (history, days_since_last(spark, d, index, ends).select("encounter_id", "days_since"), window_truncated(spark, d, index)):
        cases = cases.join(more, "encounter_id")
    return cases.select("encounter_id", "fold", "readmit_30d", *MODEL_NUMERIC, *MODEL_CATEGORIES)


def _oof(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Full-size models on all features and the codes of list A, taken from the other folds' cases."""
        known = cut(labelled(spark, d), "casos")
        dealt = cut(folded(spark, d, known).select("encounter_id", "readmit_30d", "fold"), "plegados")
        cases = cut(training_table(spark, d, known, dealt), "tabla")
        pairs = cut(case_pairs(spark, d, ("COMPLETO",), known), "pares")
        per_fold = codes.per_fold(pairs, dealt, "encounter_id", "readmit_30d", "fold", FOLDS)
        lists = cut(per_fold.where(codes.in_list_a(LEAST_N, LEAST_V) & (F.col("fold") > 0)).select("fold", "block", "level", "code"), "listas")
        return model.out_of_fold(cases, "encounter_id", "readmit_30d", "fold", kind, MODEL_NUMERIC, MODEL_CATEGORIES, pairs, MODEL_LOGGED, lists=lists)

    return run


for _name, _kind in (("cv_logistic_oof", "LR"), ("cv_forest_oof", "RF"), ("cv_gbt_oof", "GB")):
    REG.add(_name)(_oof(_kind))


@REG.add("folds_disjoint", f"WITH {DISCHARGES_SQL}, {LABELS_SQL}, {FOLDS_SQL} SELECT patient_id, block FROM fc GROUP BY ALL HAVING count(DISTINCT fold) > 1")
def folds_disjoint(spark: SparkSession, d: str) -> DataFrame:
    """Patient identifiers of a block in more than one fold: none."""
    cases = folded(spark, d).withColumn("unit", F.struct("patient_id", "block"))
    return model.disjoint_folds(cases, "unit", "fold").select("unit.patient_id", "unit.block")


# ---------------------------------------------------------------- evaluation

def scored(spark: SparkSession, d: str) -> DataFrame:
    """Cases with a deterministic score in [0.02, 0.62]: more for many earlier days in hospital and for urgent admissions."""
    ids = discharges(spark, d).select("encounter_id", "patient_id", "weight")
    urgent = F.coalesce((F.col("admit_type") == "URGENCIA").cast("double"), F.lit(0.0))
    score = F.round(0.02 + 0.1 * urgent + 0.5 * F.least(F.coalesce("weight", F.lit(0.0)), F.lit(10.0)) / 10, 3)
    return labelled(spark, d).join(ids, "encounter_id").withColumn("score", score).where("readmit_30d IS NOT NULL").select("encounter_id", "patient_id", "year", "score", F.col("readmit_30d").alias("y"))


SCORED_SQL = """sc AS (SELECT encounter_id, patient_id, year, readmit_30d AS y,
  round(0.02::DOUBLE + 0.1::DOUBLE * coalesce((admit_type = 'URGENCIA')::INTEGER, 0) + 0.5::DOUBLE * least(coalesce(weight, 0.0), 10.0) / 10, 3) AS score FROM lab WHERE readmit_30d IS NOT NULL)"""


def _ranking_sql(source: str, by: str = "", w: str = "1") -> str:
    part, keys = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f"""SELECT {keys}round(sum(p / all_p * tp / (tp + fp)), 6) AS auprc, round(sum(q * (tp - p / 2)) / (any_value(all_p) * any_value(all_q)), 6) AS auroc FROM (
  SELECT *, sum(p) OVER ({part} ORDER BY score DESC) AS tp, sum(q) OVER ({part} ORDER BY score DESC) AS fp, sum(p) OVER ({part}) AS all_p, sum(q) OVER ({part}) AS all_q FROM (
    SELECT {keys}score, sum({w} * y)::DOUBLE AS p, sum({w} * (1 - y))::DOUBLE AS q FROM {source} GROUP BY ALL)) {'GROUP BY ' + by if by else ''}"""


@REG.add("auprc_auroc", f"WITH {DISCHARGES_SQL}, {LABELS_SQL}, {SCORED_SQL} {_ranking_sql('sc')}")
def auprc_auroc(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ranking_metrics(evaluate.score_table(scored(spark, d), "score", "y"))


@REG.add("metrics_by_fold", f"WITH {DISCHARGES_SQL}, {LABELS_SQL}, {SCORED_SQL}, {FOLDS_SQL}, sf AS (SELECT sc.*, fc.fold FROM sc JOIN fc USING (encounter_id)) {_ranking_sql('sf', 'fold')}")
def metrics_by_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).join(folded(spark, d).select("encounter_id", "fold"), "encounter_id")
    return evaluate.ranking_metrics(evaluate.score_table(rows, "score", "y", ("fold",)), ("fold",))


@REG.add("metrics_by_year", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, {SCORED_SQL}, k AS ({_ranking_sql('sc', 'year')}), o AS (SELECT year, count(*) AS n, round(avg(y), 6) AS observed, round(avg(score), 6) AS predicted FROM sc GROUP BY 1)
SELECT year, n, auprc, auroc, observed, predicted FROM k JOIN o USING (year)""")
def metrics_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Discrimination per year, and the observed rate beside the mean of what was predicted."""
    rows = cut(scored(spark, d), "puntajes")
    ranks = evaluate.ranking_metrics(evaluate.score_table(rows, "score", "y", ("year",)), ("year",))
    shares = rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("observed"), F.round(F.avg("score"), 6).alias("predicted"))
    return ranks.join(F.broadcast(shares), "year")  # one row per year


@REG.add("brier_prevalence", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, {SCORED_SQL}
SELECT year, count(*) AS n, round(avg(y), 6) AS prevalence, round(avg((score - y) * (score - y)), 6) AS brier, round(avg(y) * (1 - avg(y)), 6) AS reference_brier FROM sc GROUP BY year""")
def brier_prevalence(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.brier(scored(spark, d), "score", "y", ("year",))


@REG.add("calibration_by_newton")
def calibration_by_newton(spark: SparkSession, d: str) -> DataFrame:
    """Over all cases (year null) and per year."""
    rows = cut(scored(spark, d), "puntajes")
    found = evaluate.calibration(rows, "score", "y") + evaluate.calibration(rows, "score", "y", "year")
    return spark.createDataFrame([(None if y is None else int(y), *(round(v, 6) for v in x)) for y, *x in found], "year int, intercept double, slope_intercept double, slope double")


DRAWS = 1000
_W = sql_poisson(sql_exploded_draw(18, "bootstrap", "draw", "patient_id"), span=QUARTER)


@REG.add("bootstrap_weights", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, {SCORED_SQL}, u AS (SELECT DISTINCT patient_id FROM sc WHERE patient_id IS NOT NULL),
w AS (SELECT CAST(draw AS INTEGER) AS draw, patient_id, {_W} AS w FROM u, range(1, {DRAWS + 1}) r(draw))
SELECT draw, count(*) AS units, CAST(sum(w) AS BIGINT) AS total, CAST(sum(w * w) AS BIGINT) AS squares, CAST(max(w) AS INTEGER) AS most FROM w WHERE w > 0 GROUP BY draw""")
def bootstrap_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weights of all draws, summed up per draw."""
    w = evaluate.bootstrap_weights(scored(spark, d), "patient_id", DRAWS)
    return w.groupBy("draw").agg(F.count(F.lit(1)).alias("units"), F.sum("w").alias("total"), F.sum(F.col("w") * F.col("w")).alias("squares"), F.max("w").alias("most"))


BOOT_SQL = f"""bg AS (SELECT patient_id, score, y, count(*) AS k FROM sc WHERE patient_id IS NOT NULL GROUP BY ALL),
bw AS MATERIALIZED (SELECT * FROM (SELECT CAST(draw AS INTEGER) AS draw, bg.*, k * {_W} AS w FROM bg, range(1, {DRAWS + 1}) r(draw)) WHERE w > 0)"""
COARSE_SQL = f"""bx AS (SELECT draw, w, y, round(score, 1) AS score FROM bw), m AS ({_ranking_sql('bw', 'draw', 'w')}), k AS ({_ranking_sql('bx', 'draw', 'w')})"""


@REG.add("bootstrap_interval", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, {SCORED_SQL}, {BOOT_SQL}, m AS ({_ranking_sql('bw', 'draw', 'w')})
SELECT 'auprc' AS metric, round(quantile_cont(auprc, 0.025), 6) AS low, round(quantile_cont(auprc, 0.975), 6) AS high FROM m
UNION ALL SELECT 'auroc', round(quantile_cont(auroc, 0.025), 6), round(quantile_cont(auroc, 0.975), 6) FROM m""")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.percentile_interval(evaluate.bootstrap_metrics(scored(spark, d), "patient_id", "score", "y", DRAWS), ["auprc", "auroc"])


def coarse_and_full(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Metrics of a coarsened score and of the full one over the same draws."""
    rows = cut(scored(spark, d), "puntajes")
    metrics = lambda t: cut(evaluate.bootstrap_metrics(t, "patient_id", "score", "y", DRAWS), "medidas")
    return metrics(rows.withColumn("score", F.round("score", 1))), metrics(rows)


@REG.add("paired_verdict", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, {SCORED_SQL}, {BOOT_SQL}, {COARSE_SQL},
d AS (SELECT (m.auprc - k.auprc) / m.auprc AS dp, m.auroc - k.auroc AS dr FROM k JOIN m USING (draw)),
q AS (SELECT avg(dp) AS mp, quantile_cont(dp, 0.025) AS lp, quantile_cont(dp, 0.975) AS hp, avg(dr) AS mr, quantile_cont(dr, 0.025) AS lr, quantile_cont(dr, 0.975) AS hr FROM d),
v AS (SELECT *, CASE WHEN lp > 0.1 OR lr > 0.02 THEN 'LOSES' WHEN hp <= 0.1 AND hr <= 0.02 THEN 'NOT_WORSE' ELSE 'UNDECIDED' END AS verdict FROM q)
SELECT 'auprc' AS metric, round(mp, 6) AS mean, round(lp, 6) AS low, round(hp, 6) AS high, verdict FROM v UNION ALL SELECT 'auroc', round(mr, 6), round(lr, 6), round(hr, 6), verdict FROM v""")
def paired_verdict(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.paired_verdict(*coarse_and_full(spark, d))


@REG.add("weighting_verdict", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, {SCORED_SQL}, {BOOT_SQL}, {COARSE_SQL}, d AS (SELECT (m.auprc - k.auprc) / k.auprc AS d FROM k JOIN m USING (draw))
SELECT round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, CASE WHEN quantile_cont(d, 0.025) > 0.1 THEN 'WEIGH' ELSE 'PLAIN' END AS verdict FROM d""")
def weighting_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The rule of the weighting trial, with the coarse score in the place of plain training."""
    return evaluate.weighting_verdict(*coarse_and_full(spark, d))
