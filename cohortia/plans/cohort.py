"""Queries on records, persons, episodes, rules and labels."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.operators import criteria, dedup, episodes, identity, labels
from cohortia.operators.criteria import Rule, false_if_null
from cohortia.operators.skew import sized_join
from cohortia.plans.discharges import DISCHARGES_SQL, RECORDS_SQL, discharges, records
from cohortia.plans.registry import Registry
from cohortia.session import cut, table

REG = Registry()
STAY_KEY = ["patient_id", "site", "admit", "discharge"]
CONTENT = [
    "id_paciente", "bloque_id", "sexo", "fecha_nacimiento", "provincia", "prevision", "cod_hospital", "tipo_actividad", "tipo_ingreso", "tipo_procedencia",
    "especialidad_medica", "fecha_ingreso", "servicioingreso", "fechaalta", "servicioalta", "tipoalta", *(f"diagnostico{i}" for i in range(1, 13)),
    *(f"procedimiento{i}" for i in range(1, 7)), "ir_29301_cod_grd", "cdm", "ir_29301_peso", "ir_29301_severidad", "ir_29301_mortalidad",
]


# ---------------------------------------------------------------- repeated records

@REG.add("dup_exact_flag", f"""
WITH t AS (SELECT id_egreso, row_number() OVER (PARTITION BY archivo_origen, {', '.join(CONTENT)} ORDER BY fila_origen) AS r FROM grd_2019_2024)
SELECT id_egreso, CAST(r > 1 AS INTEGER) AS dup_exact FROM t
""")
def dup_exact_flag(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "grd_2019_2024")
    return dedup.exact_copies(rows, CONTENT, "archivo_origen", "fila_origen").select("id_egreso", F.col("dup_exact").cast("int").alias("dup_exact"))


@REG.add("dup_key_flag", f"""
WITH {RECORDS_SQL}, k AS (SELECT patient_id, site, admit, discharge FROM rec WHERE patient_id IS NOT NULL AND site IS NOT NULL AND admit IS NOT NULL
  AND discharge IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
SELECT encounter_id, CAST(k.patient_id IS NOT NULL AS INTEGER) AS dup_key FROM rec LEFT JOIN k USING (patient_id, site, admit, discharge)
""")
def dup_key_flag(spark: SparkSession, d: str) -> DataFrame:
    return dedup.key_repeats(records(spark, d), STAY_KEY).select("encounter_id", F.col("dup_key").cast("int").alias("dup_key"))


@REG.add("keep_most_complete", f"""
WITH {RECORDS_SQL}, x AS (SELECT id_egreso FROM (SELECT id_egreso, row_number() OVER (PARTITION BY archivo_origen, {', '.join(CONTENT)} ORDER BY fila_origen) AS c FROM grd_2019_2024) WHERE c = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY patient_id, site, admit, discharge, sex, birth ORDER BY n_dx DESC, n_px DESC, weight DESC NULLS LAST, encounter_id) AS k,
  patient_id IS NOT NULL AND site IS NOT NULL AND admit IS NOT NULL AND discharge IS NOT NULL AS full_key FROM rec SEMI JOIN x ON x.id_egreso = rec.encounter_id)
SELECT encounter_id FROM r WHERE NOT full_key OR k = 1
""")
def keep_most_complete(spark: SparkSession, d: str) -> DataFrame:
    """Exact copies go first, also those without a full key; then one record of each group stays."""
    order = [("n_dx", False), ("n_px", False), ("weight", True)]
    copies = dedup.exact_copies(table(spark, d, "grd_2019_2024"), CONTENT, "archivo_origen", "fila_origen").where("dup_exact").select(F.col("id_egreso").alias("encounter_id"))
    rows = records(spark, d).join(copies, "encounter_id", "left_anti")
    return dedup.keep_most_complete(rows, STAY_KEY, ["sex", "birth"], "encounter_id", order).select("encounter_id")


@REG.add("repeat_sizes", f"""
WITH {RECORDS_SQL}, s AS (SELECT count(*) AS size FROM rec WHERE patient_id IS NOT NULL AND site IS NOT NULL AND admit IS NOT NULL
  AND discharge IS NOT NULL GROUP BY patient_id, site, admit, discharge)
SELECT size, count(*) AS groups, CAST(sum(size) AS BIGINT) AS rows FROM s GROUP BY size
""")
def repeat_sizes(spark: SparkSession, d: str) -> DataFrame:
    return dedup.control_windows(records(spark, d), STAY_KEY)


@REG.add("incoherent_dates", f"""
WITH {RECORDS_SQL}, n AS (SELECT year, admit IS NULL AS a, discharge IS NULL AS b, birth IS NULL AS c, coalesce(discharge < admit, false) AS d, coalesce(birth > admit, false) AS e,
  coalesce((admit - birth) > 110 * 365.25, false) AS f, coalesce(year(discharge) <> year, false) AS g, coalesce(year(admit) < year - 1, false) AS h FROM rec)
SELECT year, sum(a::BIGINT)::BIGINT AS no_admit, sum(b::BIGINT)::BIGINT AS no_discharge, sum(c::BIGINT)::BIGINT AS no_birth, sum(d::BIGINT)::BIGINT AS discharge_before_admit,
  sum(e::BIGINT)::BIGINT AS birth_after_admit, sum(f::BIGINT)::BIGINT AS older_than_110, sum(g::BIGINT)::BIGINT AS discharge_outside_year, sum(h::BIGINT)::BIGINT AS admit_before_last_year
FROM n GROUP BY year
""")
def incoherent_dates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.incoherent_dates(records(spark, d), "year", "admit", "discharge", "birth")


# ---------------------------------------------------------------- persons

PERSONS_SQL = """
cmb AS (SELECT patient_id, count(*) AS combos FROM (SELECT DISTINCT patient_id, sex, birth FROM b WHERE patient_id IS NOT NULL) GROUP BY 1),
gen AS (SELECT patient_id FROM cmb WHERE combos >= 5),
br AS (SELECT DISTINCT patient_id, birth FROM b WHERE birth IS NOT NULL AND patient_id IS NOT NULL AND patient_id NOT IN (SELECT patient_id FROM gen)),
lk AS (SELECT x.patient_id, x.birth AS p, y.birth AS q FROM br x JOIN br y USING (patient_id)
  WHERE abs(x.birth - y.birth) <= 366 OR (month(x.birth) = month(y.birth) AND day(x.birth) = day(y.birth))),
rch AS (SELECT patient_id, p, q FROM lk UNION SELECT r.patient_id, r.p, l.q FROM rch r JOIN lk l ON l.patient_id = r.patient_id AND l.p = r.q),
own AS (SELECT patient_id, p AS birth, min(q) AS owner FROM rch GROUP BY 1, 2),
num AS (SELECT patient_id, birth, CAST(dense_rank() OVER (PARTITION BY patient_id ORDER BY owner) AS INTEGER) AS n FROM own),
prs AS (SELECT patient_id, max(n) AS persons FROM num GROUP BY 1)"""


@REG.add("assign_persons", f"""
WITH RECURSIVE {DISCHARGES_SQL}, {PERSONS_SQL}
SELECT b.encounter_id, CASE WHEN b.patient_id IS NULL OR b.patient_id IN (SELECT patient_id FROM gen) THEN NULL
  WHEN num.n IS NOT NULL THEN b.patient_id * 100 + num.n
  WHEN b.birth IS NULL AND coalesce(prs.persons, 1) = 1 THEN b.patient_id * 100 + 1 END AS person_id
FROM b LEFT JOIN num USING (patient_id, birth) LEFT JOIN prs USING (patient_id)
""")
def assign_persons(spark: SparkSession, d: str) -> DataFrame:
    return identity.assign_persons(discharges(spark, d)).select("encounter_id", "person_id")


@REG.add("generic_ids", f"""
WITH RECURSIVE {DISCHARGES_SQL}, {PERSONS_SQL}
SELECT patient_id, combos, (SELECT count(*) FROM b WHERE b.patient_id = cmb.patient_id) AS n FROM cmb WHERE combos >= 5
""")
def generic_ids(spark: SparkSession, d: str) -> DataFrame:
    return identity.generic_ids(discharges(spark, d))


@REG.add("ambiguous_identity", f"""
WITH RECURSIVE {DISCHARGES_SQL}, {PERSONS_SQL},
v AS (SELECT patient_id, count(DISTINCT birth) AS births, count(DISTINCT sex) AS sexes FROM b WHERE patient_id IS NOT NULL GROUP BY 1)
SELECT patient_id, CASE WHEN births > 1 AND sexes > 1 THEN 'BOTH' WHEN births > 1 THEN 'BIRTH' ELSE 'SEX' END AS varies,
  CASE WHEN combos >= 5 THEN 'GENERIC' WHEN persons > 1 THEN 'SEVERAL' ELSE 'ONE' END AS resolved
FROM v LEFT JOIN cmb USING (patient_id) LEFT JOIN prs USING (patient_id) WHERE births > 1 OR sexes > 1
""")
def ambiguous_identity(spark: SparkSession, d: str) -> DataFrame:
    return identity.ambiguous_identity(discharges(spark, d))


@REG.add("id_overlap_between_years", f"""
WITH {RECORDS_SQL}, h AS (SELECT patient_id, year, min(sex) AS s0, max(sex) AS s1, min(birth) AS b0, max(birth) AS b1 FROM rec WHERE patient_id IS NOT NULL GROUP BY 1, 2)
SELECT x.year AS year_a, y.year AS year_b, count(*) AS ids, CAST(sum(CASE WHEN x.s0 IS NOT DISTINCT FROM y.s0 AND x.s1 IS NOT DISTINCT FROM y.s1 AND x.s0 IS NOT DISTINCT FROM x.s1
  AND x.b0 IS NOT DISTINCT FROM y.b0 AND x.b1 IS NOT DISTINCT FROM y.b1 AND x.b0 IS NOT DISTINCT FROM x.b1 THEN 1 ELSE 0 END) AS BIGINT) AS same
FROM h x JOIN h y ON x.patient_id = y.patient_id AND x.year < y.year GROUP BY 1, 2
""")
def id_overlap_between_years(spark: SparkSession, d: str) -> DataFrame:
    return identity.continuity(records(spark, d), "patient_id", "year")


@REG.add("mode_per_id", f"""
WITH {RECORDS_SQL}, n AS (SELECT patient_id, site, count(*) AS n FROM rec WHERE patient_id IS NOT NULL AND site IS NOT NULL GROUP BY 1, 2)
SELECT patient_id, site, n FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY n DESC, site) AS r FROM n) WHERE r = 1
""")
def mode_per_id(spark: SparkSession, d: str) -> DataFrame:
    return identity.mode_per_key(records(spark, d), "patient_id", "site")


@REG.add("lag_lead_admissions", f"""
WITH {DISCHARGES_SQL} SELECT encounter_id, lag(admit) OVER w AS previous, lead(admit) OVER w AS following FROM b WHERE person_id IS NOT NULL AND admit IS NOT NULL
WINDOW w AS (PARTITION BY person_id ORDER BY admit, encounter_id)
""")
def lag_lead_admissions(spark: SparkSession, d: str) -> DataFrame:
    rows = discharges(spark, d).where("person_id IS NOT NULL AND admit IS NOT NULL")
    return identity.sequence_gap(rows, "person_id", "admit").select("encounter_id", "previous", "following")


# ---------------------------------------------------------------- episodes

EPISODES_SQL = """
us AS (SELECT * FROM b WHERE person_id IS NOT NULL AND discharge >= admit),
pv AS (SELECT *, row_number() OVER w AS pos, max({'z': discharge, 'a': admit, 'i': encounter_id}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ld FROM us
  WINDOW w AS (PARTITION BY person_id ORDER BY admit, discharge, encounter_id)),
ll AS (SELECT pv.*, l.site AS l_site, l.admit AS l_admit, l.discharge AS l_discharge, l.discharge_type AS l_type FROM pv LEFT JOIN us l ON l.encounter_id = pv.ld.i),
cn AS (SELECT *, coalesce(admit - l_discharge < 0 OR (admit - l_discharge BETWEEN 0 AND 1 AND site IS DISTINCT FROM l_site)
  OR (admit = l_discharge AND site IS NOT DISTINCT FROM l_site AND admit = l_admit AND discharge = l_discharge), false) AS cont,
  coalesce(l_type LIKE 'DERIVACI%', false) OR coalesce(origin LIKE 'OTROS HOSPITALES%', false) AS mark FROM ll),
ep AS (SELECT *, last_value(CASE WHEN NOT cont THEN encounter_id END IGNORE NULLS) OVER (PARTITION BY person_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS own_episode FROM cn)"""


@REG.add("episode_id", f"WITH {DISCHARGES_SQL}, {EPISODES_SQL} SELECT encounter_id, own_episode AS episode_id, CAST(cont AS INTEGER) AS continues FROM ep")
def episode_id(spark: SparkSession, d: str) -> DataFrame:
    e = episodes.build_episodes(discharges(spark, d).drop("episode_id"))
    return e.select("encounter_id", "episode_id", F.col("continues").cast("int").alias("continues"))


@REG.add("episode_size", f"""WITH {DISCHARGES_SQL}, {EPISODES_SQL},
s AS (SELECT own_episode, CAST(count(*) AS INTEGER) AS episode_size FROM ep GROUP BY 1) SELECT episode_size, count(*) AS episodes FROM s GROUP BY 1""")
def episode_size(spark: SparkSession, d: str) -> DataFrame:
    e = episodes.build_episodes(discharges(spark, d).drop("episode_id")).where("encounter_id = episode_id")
    return e.groupBy("episode_size").agg(F.count(F.lit(1)).alias("episodes"))


@REG.add("episode_final_discharge", f"""WITH {DISCHARGES_SQL}, {EPISODES_SQL}
SELECT own_episode AS episode_id, encounter_id FROM (SELECT *, row_number() OVER (PARTITION BY own_episode ORDER BY discharge DESC, admit DESC, encounter_id DESC) AS r FROM ep) WHERE r = 1""")
def episode_final_discharge(spark: SparkSession, d: str) -> DataFrame:
    return episodes.build_episodes(discharges(spark, d).drop("episode_id")).where("final").select("episode_id", "encounter_id")


@REG.add("transfer_concordance", f"""WITH {DISCHARGES_SQL}, {EPISODES_SQL},
k AS (SELECT *, admit - l_discharge AS dd FROM ep WHERE l_discharge IS NOT NULL),
g AS (SELECT *, CASE WHEN dd < 0 THEN '<0' WHEN dd <= 3 THEN CAST(dd AS VARCHAR) WHEN dd <= 7 THEN '4-7' WHEN dd <= 30 THEN '8-30' END AS band FROM k)
SELECT band, count(*) AS rows, CAST(sum(mark::INTEGER) AS BIGINT) AS marked, CAST(sum(cont::INTEGER) AS BIGINT) AS joined, CAST(sum((mark AND cont)::INTEGER) AS BIGINT) AS joined_marked
FROM g WHERE band IS NOT NULL GROUP BY band""")
def transfer_concordance(spark: SparkSession, d: str) -> DataFrame:
    return episodes.transfer_concordance(episodes.build_episodes(discharges(spark, d).drop("episode_id")))


@REG.add("episode_attributes", f"""WITH {DISCHARGES_SQL}, {EPISODES_SQL}
SELECT person_id, own_episode AS episode_id, min(admit) AS "begin", max(discharge) AS "end", count(DISTINCT site) AS sites,
  max(CASE WHEN regexp_matches(coalesce(dx, ''), '^[IJ]') THEN 1 ELSE 0 END) AS critical, max(CASE WHEN encounter_id = own_episode THEN admit_type END) AS opened_as,
  max_by(discharge_type, {{'z': discharge, 'a': admit, 'i': encounter_id}}) FILTER (discharge_type IS NOT NULL) AS last_type FROM ep GROUP BY 1, 2""")
def episode_attributes(spark: SparkSession, d: str) -> DataFrame:
    return episodes.episode_attributes(episodes.build_episodes(discharges(spark, d).drop("episode_id")), "^[IJ]")


# ---------------------------------------------------------------- rules

RULES = [
    Rule("E01", "no_person", "BOTH", required=True), Rule("E02", "generic_id", "BOTH"), Rule("E03", "bad_dates", "BOTH", required=True), Rule("E04", "activity_2019", "BOTH"),
    Rule("E05", "not_final"), Rule("E06", "died"), Rule("E07", "referred_hospital"), Rule("E08", "referred_private"), Rule("E09", "no_grd"), Rule("E10", "missing_data"),
    Rule("E11", "near_block_end"), Rule("E12", "left_on_own", active=False), Rule("E13", "day_surgery"), Rule("E14", "session"), Rule("E15", "periodic"),
]
# Fixed values of the columns that the flags read.
ACTIVITY_2019 = ("HOSPITALIZACIÓN DIURNA", "HOSPITALIZACIÓN EN URGENCIA")
DAY_SURGERY = "CIRUGÍA MAYOR AMBULATORIA"
TO_HOSPITAL, TO_PRIVATE = "DERIVACIÓN OTRO HOSPITAL", "DERIVACIÓN INST. PRIVADA"
LEFT_ON_OWN = ("ALTA VOLUNTARIA", "FUGA DEL PACIENTE")
PERIODIC = ("PROGRAMADA",)
MOST_AGE = 110


def flagged(spark: SparkSession, d: str) -> DataFrame:
    """Discharges with one boolean column per rule but near_block_end and not_final, which hang on other rules; missing values
    count as false."""
    rows = discharges(spark, d)
    generic = identity.generic_ids(rows).select("patient_id", F.lit(True).alias("generic_id"))
    rows = sized_join(rows, generic, ["patient_id"]).withColumn("generic_id", false_if_null(F.col("generic_id")))
    age = F.datediff("admit", "birth") / 365.25
    marks = {
        "no_person": F.col("patient_id").isNull() | (F.col("person_id").isNull() & ~F.col("generic_id")),
        "bad_dates": F.col("admit").isNull() | F.col("discharge").isNull() | (F.col("discharge") < F.col("admit")),
        "activity_2019": F.col("activity").isin(*ACTIVITY_2019), "died": F.col("discharge_type") == "FALLECIDO",
        "referred_hospital": F.col("discharge_type").startswith(TO_HOSPITAL), "referred_private": F.col("discharge_type").startswith(TO_PRIVATE),
        "no_grd": F.col("grd").isNull() | false_if_null(F.col("mdc") == "99"),
        "missing_data": F.col("birth").isNull() | F.col("discharge_type").isNull() | false_if_null(F.col("birth") > F.col("admit")) | false_if_null(age > MOST_AGE),
        "left_on_own": F.col("discharge_type").isin(*LEFT_ON_OWN), "day_surgery": F.col("activity").startswith(DAY_SURGERY), "session": F.col("dx").startswith("Z51"),
    }
    rows = rows.withColumns({k: false_if_null(c) for k, c in marks.items()})
    short = F.col("admit_type").isin(*PERIODIC) & (F.datediff("discharge", "admit") <= 1)
    return criteria.periodic_treatment(rows, short & ~F.col("bad_dates") & ~F.col("activity_2019") & ~F.col("day_surgery") & ~F.col("session"))


def ruled(rows: DataFrame, rules: list[Rule], label_rules: labels.LabelRules, require_mark: bool | None = None) -> DataFrame:
    """rows of flagged() with trackable, the two missing flags, reason, is_case and may_readmit. require_mark: episodes are built anew
    over the trackable rows, joining transfers with or without a mark; by default they are those of the table."""
    criteria.disjoint_kinds(PERIODIC, label_rules.unplanned)
    near = F.date_add("discharge", min(label_rules.windows) + label_rules.margin) > labels.block_end(label_rules)
    rows = rows.withColumn("near_block_end", false_if_null(near)).withColumn("trackable", criteria.trackable(rules))
    if require_mark is not None:
        built = episodes.build_episodes(rows.where("trackable").drop("episode_id"), require_mark=require_mark).select("encounter_id", "episode_id")
        rows = rows.drop("episode_id").join(built, "encounter_id", "left")
    return criteria.apply_rules(criteria.mark_not_final(rows), rules)


def _flags_sql(n: str = "", active: dict[str, bool] | None = None, least_follow_up: int = 37) -> str:
    """Common tables fl (all flags and trackable) and ru (reason), named with the suffix n."""
    rules = [replace(r, active=(active or {}).get(r.code, r.active)) for r in RULES]
    both = " AND ".join(["person_id IS NOT NULL", "coalesce(discharge >= admit, false)", *(f"NOT {r.flag}" for r in rules if r.active and r.role == "BOTH")])
    return f"""
ft{n} AS (SELECT *, {both} AS trackable, coalesce(discharge + {least_follow_up} > CASE block WHEN 'A' THEN DATE '2020-12-31' WHEN 'B' THEN DATE '2024-12-31' END, false) AS near_block_end FROM fb{n}),
fin{n} AS (SELECT max_by(encounter_id, {{'z': discharge, 'a': admit, 'i': encounter_id}}) AS encounter_id FROM ft{n} WHERE trackable AND episode_id IS NOT NULL GROUP BY episode_id),
fl{n} AS (SELECT *, trackable AND encounter_id NOT IN (SELECT encounter_id FROM fin{n}) AS not_final FROM ft{n}),
ru{n} AS (SELECT *, CASE {" ".join(f"WHEN {r.flag} THEN '{r.code}'" for r in rules if r.active)} END AS reason FROM fl{n})"""


FLAGS_BASE_SQL = """
fgen AS (SELECT patient_id FROM (SELECT DISTINCT patient_id, sex, birth FROM b WHERE patient_id IS NOT NULL) GROUP BY 1 HAVING count(*) >= 5),
f0 AS (SELECT b.*, coalesce(patient_id IN (SELECT patient_id FROM fgen), false) AS generic_id, coalesce(admit IS NULL OR discharge IS NULL OR discharge < admit, false) AS bad_dates,
  coalesce(activity IN ('HOSPITALIZACIÓN DIURNA', 'HOSPITALIZACIÓN EN URGENCIA'), false) AS activity_2019, coalesce(discharge_type = 'FALLECIDO', false) AS died,
  coalesce(discharge_type LIKE 'DERIVACIÓN OTRO HOSPITAL%', false) AS referred_hospital, coalesce(discharge_type LIKE 'DERIVACIÓN INST. PRIVADA%', false) AS referred_private,
  grd IS NULL OR coalesce(mdc = '99', false) AS no_grd, birth IS NULL OR discharge_type IS NULL OR coalesce(birth > admit, false) OR coalesce((admit - birth) / 365.25::DOUBLE > 110, false) AS missing_data,
  coalesce(discharge_type IN ('ALTA VOLUNTARIA', 'FUGA DEL PACIENTE'), false) AS left_on_own, coalesce(activity LIKE 'CIRUGÍA MAYOR AMBULATORIA%', false) AS day_surgery,
  coalesce(dx LIKE 'Z51%', false) AS session FROM b),
cand AS (SELECT encounter_id, person_id, admit, substr(replace(dx, '.', ''), 1, 3) AS cat FROM f0 WHERE person_id IS NOT NULL AND dx IS NOT NULL AND NOT bad_dates AND NOT activity_2019
  AND NOT day_surgery AND NOT session AND admit_type = 'PROGRAMADA' AND discharge - admit <= 1),
prd AS (SELECT c.encounter_id FROM cand c JOIN cand e ON e.person_id = c.person_id AND e.cat = c.cat AND c.admit - e.admit BETWEEN 1 AND 365 GROUP BY 1 HAVING count(*) >= 2),
fb AS (SELECT *, patient_id IS NULL OR (person_id IS NULL AND NOT generic_id) AS no_person, encounter_id IN (SELECT encounter_id FROM prd) AS periodic FROM f0)"""
FLAGS_SQL = f"{FLAGS_BASE_SQL}, {_flags_sql()}"


@REG.add("criteria_flags", f"WITH {DISCHARGES_SQL}, {FLAGS_SQL} SELECT encounter_id, {', '.join(f'CAST({r.flag} AS INTEGER) AS {r.flag}' for r in RULES)} FROM fl")
def criteria_flags(spark: SparkSession, d: str) -> DataFrame:
    return ruled(flagged(spark, d), RULES, labels.LabelRules()).select("encounter_id", *(F.col(r.flag).cast("int").alias(r.flag) for r in RULES))


@REG.add("exclusion_reason", f"WITH {DISCHARGES_SQL}, {FLAGS_SQL} SELECT encounter_id, reason, CAST(reason IS NULL AS INTEGER) AS is_case, CAST(coalesce(encounter_id = episode_id, false) AND trackable AS INTEGER) AS may_readmit FROM ru")
def exclusion_reason(spark: SparkSession, d: str) -> DataFrame:
    out = ruled(flagged(spark, d), criteria.validate_rules(RULES), labels.LabelRules())
    return out.select("encounter_id", "reason", F.col("is_case").cast("int").alias("is_case"), F.col("may_readmit").cast("int").alias("may_readmit"))


@REG.add("waterfall_steps", f"WITH {DISCHARGES_SQL}, {FLAGS_SQL}, w AS (" + " UNION ALL ".join(
    f"SELECT {i + 1} AS step, '{r.code}' AS code, {int(r.active)} AS active, sum({r.flag}::BIGINT) AS met, sum(coalesce(reason = '{r.code}', false)::BIGINT) AS removed,"
    f" {'CAST(NULL AS BIGINT)' if r.active else f'sum(({r.flag} AND reason IS NULL)::BIGINT)'} AS would_remove, count(*) AS total FROM ru" for i, r in enumerate(RULES)
) + ") SELECT step, code, active, met::BIGINT AS met, removed::BIGINT AS removed, would_remove::BIGINT AS would_remove, (total - sum(removed) OVER (ORDER BY step))::BIGINT AS remaining FROM w")
def waterfall_steps(spark: SparkSession, d: str) -> DataFrame:
    rules = criteria.validate_rules(RULES)
    return criteria.waterfall(ruled(flagged(spark, d), rules, labels.LabelRules()), rules)


@REG.add("periodic_treatment", f"WITH {DISCHARGES_SQL}, {FLAGS_SQL} SELECT encounter_id FROM prd")
def periodic_treatment(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).where("periodic").select("encounter_id")


@REG.add("referral_sites_all_years", f"""
WITH {DISCHARGES_SQL}, s AS (SELECT site FROM b WHERE site IS NOT NULL GROUP BY 1 HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM b)),
r AS (SELECT b.site, b.year, count(*) AS n, sum(CASE WHEN discharge_type LIKE 'DERIVACI%' THEN 1 ELSE 0 END) AS ref FROM b JOIN s USING (site) GROUP BY 1, 2)
SELECT site, CAST(sum(ref) AS BIGINT) AS referrals, CAST(min_by(ref, year) AS BIGINT) AS first_year, CAST(max_by(ref, year) AS BIGINT) AS last_year FROM r GROUP BY 1
""")
def referral_sites_all_years(spark: SparkSession, d: str) -> DataFrame:
    rows = discharges(spark, d).where("site IS NOT NULL")
    per = rows.groupBy("site", "year").agg(F.sum(false_if_null(F.col("discharge_type").startswith("DERIVACI")).cast("bigint")).alias("ref"))
    years = table(spark, d, "grd_depurado").agg(F.count_distinct("anio_archivo").alias("y"))
    g = per.groupBy("site").agg(F.sum("ref").alias("referrals"), F.min_by("ref", "year").alias("first_year"), F.max_by("ref", "year").alias("last_year"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") == years.scalar()).drop("n")


# ---------------------------------------------------------------- labels

def _labels_sql(name: str, counting: str, source: str = "ru", margin: int = 30, no_related: str = "mdc = '14'", key: str = "mdc") -> str:
    return f"""
{name}r AS (SELECT *, {counting} AND NOT coalesce(grd LIKE '146%' OR grd LIKE '147%', false) AND NOT coalesce(dx LIKE 'Z51%', false) AND trackable AND encounter_id = episode_id AS counts,
  CASE WHEN mdc <> '99' THEN {key} END AS kin FROM {source} WHERE person_id IS NOT NULL AND episode_id IS NOT NULL AND admit IS NOT NULL AND discharge IS NOT NULL),
{name}e AS (SELECT person_id, episode_id, min_by(encounter_id, {{'k': encounter_id <> episode_id, 'a': admit, 'z': discharge, 'i': encounter_id}}) AS opening FROM {name}r GROUP BY 1, 2),
{name}o AS (SELECT e.person_id, e.episode_id, o.kin, o.counts, o.admit, {{'a': o.admit, 'z': o.discharge, 'i': o.encounter_id}} AS pos, o.encounter_id FROM {name}e e JOIN {name}r o ON o.encounter_id = e.opening),
{name}c AS (SELECT z.*, o.pos FROM {name}o o JOIN {name}r z USING (person_id, episode_id) WHERE z.reason IS NULL),
{name}n AS (SELECT c.encounter_id, min_by(o.admit, o.pos) AS day, min_by(o.encounter_id, o.pos) AS next_id, min_by(o.admit, o.pos) FILTER (o.kin = c.kin) AS day_mdc
  FROM {name}c c JOIN {name}o o ON o.person_id = c.person_id AND o.pos > c.pos AND o.counts GROUP BY 1),
{name}x AS (SELECT c.*, n.day - c.discharge AS days_to_next, n.day_mdc - c.discharge AS days_mdc, n.next_id, CASE c.block WHEN 'A' THEN DATE '2020-12-31' WHEN 'B' THEN DATE '2024-12-31' END AS block_end
  FROM {name}c c LEFT JOIN {name}n n USING (encounter_id)),
{name} AS (SELECT *,
  CASE WHEN discharge <= block_end - {7 + margin} THEN coalesce(days_to_next <= 7, false)::INTEGER END AS readmit_7d, CASE WHEN discharge <= block_end - {30 + margin} THEN coalesce(days_to_next <= 30, false)::INTEGER END AS readmit_30d,
  CASE WHEN discharge <= block_end - {7 + margin} AND NOT coalesce({no_related}, false) THEN coalesce(days_mdc <= 7, false)::INTEGER END AS readmit_7d_mdc,
  CASE WHEN discharge <= block_end - {30 + margin} AND NOT coalesce({no_related}, false) THEN coalesce(days_mdc <= 30, false)::INTEGER END AS readmit_30d_mdc FROM {name}x)"""


UNPLANNED_SQL = "coalesce(admit_type IN ('URGENCIA', 'OBSTETRICA'), false)"
LABELS_SQL = f"{FLAGS_SQL}, {_labels_sql('lab', UNPLANNED_SQL)}"
ALL_FORMS_SQL = _labels_sql("alf", "true", no_related="false").replace("AND NOT coalesce(grd LIKE '146%' OR grd LIKE '147%', false) AND NOT coalesce(dx LIKE 'Z51%', false) ", "")


def labelled(spark: SparkSession, d: str, rules: labels.LabelRules = labels.LabelRules()) -> DataFrame:
    """The cases that the exclusion rules leave, with their labels."""
    return labels.label_readmissions(ruled(flagged(spark, d), RULES, rules), rules)


for _label in ("readmit_7d", "readmit_30d", "readmit_7d_mdc", "readmit_30d_mdc"):
    @REG.add("readmit_30d_related" if _label == "readmit_30d_mdc" else "readmit_7d_related" if _label == "readmit_7d_mdc" else _label, f"WITH {DISCHARGES_SQL}, {LABELS_SQL} SELECT encounter_id, {_label} FROM lab")
    def _one_label(spark: SparkSession, d: str, label: str = _label) -> DataFrame:
        return labelled(spark, d).select("encounter_id", label)


@REG.add("days_to_next", f"WITH {DISCHARGES_SQL}, {LABELS_SQL} SELECT encounter_id, CAST(days_to_next AS INTEGER) AS days_to_next, next_id FROM lab")
def days_to_next(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select("encounter_id", "days_to_next", "next_id")


def _rates_sql(keys: str, label: str = "readmit_30d", source: str = "lab") -> str:
    return f"""SELECT {keys}, count(*) AS cases, count({label}) AS observed, CAST(coalesce(sum({label}), 0) AS BIGINT) AS positives,
  round(coalesce(sum({label}), 0)::DOUBLE / nullif(count({label}), 0), 6) AS rate FROM {source} GROUP BY ALL"""


@REG.add("readmission_30d_by_year_mdc", f"WITH {DISCHARGES_SQL}, {LABELS_SQL} {_rates_sql('year, mdc')}")
def readmission_30d_by_year_mdc(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: 30-day unplanned re-admission by year and major diagnostic category."""
    return labels.rates_by(labelled(spark, d), ["year", "mdc"], "readmit_30d")


@REG.add("rates_by_group", f"WITH {DISCHARGES_SQL}, {LABELS_SQL} {_rates_sql('admit_type, discharge_type', 'readmit_7d')}")
def rates_by_group(spark: SparkSession, d: str) -> DataFrame:
    return labels.rates_by(labelled(spark, d), ["admit_type", "discharge_type"], "readmit_7d")


@REG.add("rates_by_site_year", f"WITH {DISCHARGES_SQL}, {LABELS_SQL} {_rates_sql('site, year')}")
def rates_by_site_year(spark: SparkSession, d: str) -> DataFrame:
    return labels.rates_by(labelled(spark, d), ["site", "year"], "readmit_30d")


@REG.add("rates_by_presence", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, w AS (SELECT site, min(year) AS first_year, count(DISTINCT year) = (SELECT count(DISTINCT year) FROM b) AS whole FROM b WHERE site IS NOT NULL GROUP BY 1)
SELECT year, CAST(whole AS INTEGER) AS all_years, count(*) AS cases, count(readmit_30d) AS observed, CAST(coalesce(sum(readmit_30d), 0) AS BIGINT) AS positives,
  round(coalesce(sum(readmit_30d), 0)::DOUBLE / nullif(count(readmit_30d), 0), 6) AS rate FROM lab JOIN w USING (site) GROUP BY 1, 2""")
def rates_by_presence(spark: SparkSession, d: str) -> DataFrame:
    """Rates per year of the sites that report in all years and of those that came or went."""
    sites = labels.site_presence(discharges(spark, d)).select("site", "all_years")
    return labels.rates_by(sized_join(labelled(spark, d), sites, ["site"], "inner"), ["year", "all_years"], "readmit_30d")


@REG.add("censoring_bands", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, k AS (SELECT *, make_date(year(discharge), 12, 31) AS e FROM lab WHERE readmit_30d IS NOT NULL)
SELECT CASE WHEN e - discharge < 7 THEN '00-06' WHEN e - discharge < 15 THEN '07-14' WHEN e - discharge < 22 THEN '15-21' WHEN e - discharge < 31 THEN '22-30' WHEN e - discharge < 61 THEN '31-60' WHEN e - discharge < 91 THEN '61-90' ELSE '91+' END AS band,
  count(*) AS cases, CAST(sum(readmit_30d) AS BIGINT) AS positives, CAST(sum((readmit_30d = 1 AND discharge + CAST(days_to_next AS INTEGER) > e)::INTEGER) AS BIGINT) AS invisible FROM k GROUP BY 1""")
def censoring_bands(spark: SparkSession, d: str) -> DataFrame:
    out = labels.censoring_bands(labelled(spark, d), "readmit_30d", 30)
    return out.withColumn("invisible", F.coalesce("invisible", F.lit(0)))


@REG.add("site_rate_quantiles", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, r AS (SELECT site, avg(readmit_30d) AS rate FROM lab GROUP BY 1 HAVING count(readmit_30d) >= 20)
SELECT count(*) AS sites, round(min(rate), 6) AS lowest, round(quantile_cont(rate, 0.25), 6) AS q1, round(quantile_cont(rate, 0.5), 6) AS median, round(quantile_cont(rate, 0.75), 6) AS q3, round(max(rate), 6) AS highest FROM r""")
def site_rate_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return labels.site_rate_quantiles(labelled(spark, d), "readmit_30d")


@REG.add("planned_vs_all", f"""WITH {DISCHARGES_SQL}, {LABELS_SQL}, {ALL_FORMS_SQL}
SELECT lab.year, count(lab.readmit_30d) AS observed, CAST(sum(lab.readmit_30d) AS BIGINT) AS unplanned, CAST(sum(alf.readmit_30d) AS BIGINT) AS all_forms FROM lab JOIN alf USING (encounter_id) GROUP BY 1""")
def planned_vs_all(spark: SparkSession, d: str) -> DataFrame:
    base = labelled(spark, d).select("encounter_id", "year", "readmit_30d")
    other = labelled(spark, d, labels.LabelRules().all_forms()).select("encounter_id", F.col("readmit_30d").alias("other"))
    return base.join(other, "encounter_id").groupBy("year").agg(F.count("readmit_30d").alias("observed"), F.sum("readmit_30d").alias("unplanned"), F.sum("other").alias("all_forms"))


@REG.add("site_presence", f"""WITH {DISCHARGES_SQL}
SELECT site, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS years, count(*) AS rows, CAST(count(DISTINCT year) = (SELECT count(DISTINCT year) FROM b) AS INTEGER) AS all_years
FROM b WHERE site IS NOT NULL GROUP BY 1""")
def site_presence(spark: SparkSession, d: str) -> DataFrame:
    return labels.site_presence(discharges(spark, d))


@REG.add("id_quality_by_year", f"""WITH RECURSIVE {DISCHARGES_SQL}, {PERSONS_SQL}, {LABELS_SQL},
am AS (SELECT patient_id FROM b WHERE patient_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT birth) > 1 OR count(DISTINCT sex) > 1)
SELECT year, count(*) AS cases, count(am.patient_id) AS ambiguous, round(avg(readmit_30d), 6) AS rate, round(avg(readmit_30d) FILTER (am.patient_id IS NULL), 6) AS rate_without FROM lab LEFT JOIN am USING (patient_id) GROUP BY 1""")
def id_quality_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Cases under ambiguous identifiers per year, and the rate with and without them."""
    rows = discharges(spark, d)
    shaky = identity.ambiguous_identity(rows).select("patient_id", F.lit(1).alias("shaky"))
    cases = labelled(spark, d).join(rows.select("encounter_id", "patient_id"), "encounter_id").join(shaky, "patient_id", "left")
    return cases.groupBy("year").agg(
        F.count(F.lit(1)).alias("cases"), F.count("shaky").alias("ambiguous"), F.round(F.avg("readmit_30d"), 6).alias("rate"),
        F.round(F.avg(F.when(F.col("shaky").isNull(), F.col("readmit_30d"))), 6).alias("rate_without"),
    )


# ---------------------------------------------------------------- scenarios

@dataclass(frozen=True)
class Scenario:
    """One decision changed against the principal analysis: rules switched, label rules replaced, transfers that need a mark, or cases
    of ambiguous identifiers left out."""

    switched: tuple[str, ...] = ()
    rules: labels.LabelRules = labels.LabelRules()
    require_mark: bool | None = None
    steady_only: bool = False


SCENARIOS = {
    "principal": Scenario(), "activity_2019": Scenario(("E04",)), "day_surgery": Scenario(("E13",)), "sessions": Scenario(("E14",)),
    "births_related": Scenario(rules=labels.LabelRules(no_related=())), "mdc_13_14": Scenario(rules=labels.LabelRules(mdc_groups=(("13", "14"),))),
    "no_margin": Scenario(rules=labels.LabelRules(margin=0)), "marked_transfers": Scenario(require_mark=True), "referred": Scenario(("E07", "E08")),
    "periodic": Scenario(("E15",)), "steady_identity": Scenario(steady_only=True),
}


def scenario_cases(rows: DataFrame, s: Scenario) -> DataFrame:
    """The labelled cases of a scenario from the rows of flagged()."""
    rules = criteria.validate_rules(RULES, dict.fromkeys(s.switched, False))
    cases = labels.label_readmissions(ruled(rows, rules, s.rules, s.require_mark), s.rules)
    if not s.steady_only:
        return cases
    shaky = identity.ambiguous_identity(rows).select("patient_id")
    return cases.join(rows.join(F.broadcast(shaky), "patient_id", "left_semi").select("encounter_id"), "encounter_id", "left_anti")


def _scenario_sql() -> str:
    parts, ends = [], []
    for i, (name, s) in enumerate(SCENARIOS.items()):
        source = f"fb_{i}"
        if s.require_mark:
            mark = "(coalesce(l_type LIKE 'DERIVACI%', false) OR coalesce(origin LIKE 'OTROS HOSPITALES%', false))"
            own = EPISODES_SQL.replace("FROM b WHERE person_id IS NOT NULL AND discharge >= admit", "FROM ft_0 WHERE trackable").replace("site IS DISTINCT FROM l_site)", f"site IS DISTINCT FROM l_site AND {mark})")
            parts.append(f"{own}, {source} AS (SELECT fb.* EXCLUDE (episode_id), ep.own_episode AS episode_id FROM fb LEFT JOIN ep ON ep.encounter_id = fb.encounter_id)")
        else:
            parts.append(f"{source} AS (SELECT * FROM fb)")
        grouped = any("14" in g for g in s.rules.mdc_groups)
        parts.append(_flags_sql(f"_{i}", dict.fromkeys(s.switched, False), 7 + s.rules.margin))
        parts.append(_labels_sql(
            f"lb_{i}", UNPLANNED_SQL, f"ru_{i}", s.rules.margin, "false" if grouped or not s.rules.no_related else "mdc = '14'", "CASE WHEN mdc = '14' THEN '13' ELSE mdc END" if grouped else "mdc",
        ))
        kept = " WHERE patient_id NOT IN (SELECT patient_id FROM b WHERE patient_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT birth) > 1 OR count(DISTINCT sex) > 1)" if s.steady_only else ""
        ends.append(f"""SELECT '{name}' AS scenario, count(*) AS cases, count(readmit_30d) AS observed, CAST(sum(readmit_30d) AS BIGINT) AS positives, round(avg(readmit_30d), 6) AS rate,
  count(readmit_30d_mdc) AS observed_mdc, CAST(sum(readmit_30d_mdc) AS BIGINT) AS positives_mdc FROM lb_{i}{kept}""")
    return f"WITH {DISCHARGES_SQL}, {FLAGS_BASE_SQL}, {', '.join(parts)} {' UNION ALL '.join(ends)}"


@REG.add("scenario_rates", _scenario_sql())
def scenario_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of each scenario, one change at a time against the principal rules; the flags are made once."""
    rows = cut(flagged(spark, d), "criterios")
    each = [
        scenario_cases(rows, s).agg(
            F.count(F.lit(1)).alias("cases"), F.count("readmit_30d").alias("observed"), F.sum("readmit_30d").alias("positives"), F.round(F.avg("readmit_30d"), 6).alias("rate"),
            F.count("readmit_30d_mdc").alias("observed_mdc"), F.sum("readmit_30d_mdc").alias("positives_mdc"),
        ).select(F.lit(name).alias("scenario"), "*")
        for name, s in SCENARIOS.items()
    ]
    return reduce(DataFrame.unionByName, each)


@REG.add("scenario_diff", f"""WITH {DISCHARGES_SQL}, {FLAGS_BASE_SQL}, {_flags_sql()}, {_labels_sql('p', UNPLANNED_SQL)}, fb_q AS (SELECT * FROM fb), {_flags_sql('_q', {'E07': False, 'E08': False})}, {_labels_sql('q', UNPLANNED_SQL, 'ru_q')}
SELECT CAST(sum((p.encounter_id IS NULL)::INTEGER) AS BIGINT) AS added, CAST(sum((q.encounter_id IS NULL)::INTEGER) AS BIGINT) AS removed,
  CAST(sum((p.encounter_id = q.encounter_id AND p.readmit_30d IS DISTINCT FROM q.readmit_30d)::INTEGER) AS BIGINT) AS changed,
  CAST(sum((p.encounter_id = q.encounter_id AND p.readmit_30d IS NOT DISTINCT FROM q.readmit_30d)::INTEGER) AS BIGINT) AS same
FROM p FULL JOIN q ON p.encounter_id = q.encounter_id""")
def scenario_diff(spark: SparkSession, d: str) -> DataFrame:
    """Added, removed and changed cases when referred discharges are kept."""
    rows = cut(flagged(spark, d), "criterios")
    base, other = (scenario_cases(rows, SCENARIOS[k]) for k in ("principal", "referred"))
    return criteria.scenario_diff(base, other, "encounter_id", ["readmit_30d"])


@REG.add("referral_breakdown", f"""WITH {DISCHARGES_SQL}, {FLAGS_BASE_SQL}, fb_q AS (SELECT * FROM fb), {_flags_sql('_q', {'E07': False, 'E08': False})}
SELECT CASE WHEN referred_private THEN 'PRIVATE' ELSE 'HOSPITAL' END AS referred, coalesce(reason, 'CASE') AS outcome, count(*) AS n FROM ru_q WHERE referred_hospital OR referred_private GROUP BY 1, 2""")
def referral_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of referred discharges when their own rules are off: a case, or the rule that then takes them."""
    rules = criteria.validate_rules(RULES, {"E07": False, "E08": False})
    rows = ruled(flagged(spark, d), rules, labels.LabelRules()).where("referred_hospital OR referred_private")
    kind = F.when(F.col("referred_private"), "PRIVATE").otherwise("HOSPITAL")
    return rows.groupBy(kind.alias("referred"), F.coalesce("reason", F.lit("CASE")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@REG.add("transfer_breakdown", f"""WITH {DISCHARGES_SQL}, {EPISODES_SQL},
k AS (SELECT *, cont AND NOT mark AND admit >= l_discharge AND NOT (admit = l_discharge AND site IS NOT DISTINCT FROM l_site) AS split FROM ep)
SELECT coalesce(admit_type, 'SIN DATO') AS admit_type, count(*) AS splits, CAST(sum((admit_type IN ('URGENCIA', 'OBSTETRICA'))::INTEGER) AS BIGINT) AS would_count FROM k WHERE split GROUP BY 1""")
def transfer_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Admissions that would open an episode of their own if joining needed a transfer mark, and those that would count as
    unplanned re-admissions."""
    with_leader = episodes.with_leader(discharges(spark, d).drop("episode_id"))
    split = with_leader.where(episodes.continues() & ~episodes.continues(require_mark=True))
    urgent = F.col("admit_type").isin("URGENCIA", "OBSTETRICA").cast("bigint")
    return split.groupBy(F.coalesce("admit_type", F.lit("SIN DATO")).alias("admit_type")).agg(F.count(F.lit(1)).alias("splits"), F.sum(urgent).alias("would_count"))
