"""The discharge tables under neutral names, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.functions.text import count_filled, read_grd, read_value
from cohortia.plans.sqltext import sql_read, sql_read_grd
from cohortia.session import table

DX = [f"diagnostico{i}" for i in range(1, 13)]
PX = [f"procedimiento{i}" for i in range(1, 7)]
BLOCK_END = {"A": "2020-12-31", "B": "2024-12-31"}

_READ = {
    "sex": "sexo", "site": "cod_hospital", "activity": "tipo_actividad", "admit_type": "tipo_ingreso",
    "origin": "tipo_procedencia", "discharge_type": "tipoalta", "dx": "diagnostico1", "mdc": "cdm",
}
_PLAIN = {
    "encounter_id": "id_egreso", "year": "anio_archivo", "patient_id": "id_paciente", "block": "bloque_id",
    "birth": "fecha_nacimiento", "admit": "fecha_ingreso", "discharge": "fechaalta", "weight": "ir_29301_peso",
}
_COHORT = {"person_id": "id_persona", "episode_id": "id_episodio"}


def _select(rows: DataFrame, plain: dict[str, str], extra: dict | None = None) -> DataFrame:
    return rows.select(
        *(F.col(c).alias(n) for n, c in plain.items()),
        *(read_value(c).alias(n) for n, c in _READ.items()),
        read_grd("ir_29301_cod_grd").alias("grd"),
        *(c.alias(n) for n, c in (extra or {}).items()),
    )


def records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "grd_2019_2024")
    counts = {"n_dx": count_filled([read_value(c) for c in DX]), "n_px": count_filled([read_value(c) for c in PX])}
    return _select(rows, _PLAIN, counts)


def discharges(spark: SparkSession, d: str) -> DataFrame:
    """The kept discharges with their persons and episodes."""
    return _select(table(spark, d, "grd_depurado"), _PLAIN | _COHORT)


def _sql_select(plain: dict[str, str], extra: str, source: str) -> str:
    cols = [f"{c} AS {n}" for n, c in plain.items()] + [f"{sql_read(c)} AS {n}" for n, c in _READ.items()]
    return f"SELECT {', '.join(cols)}, {sql_read_grd('ir_29301_cod_grd')} AS grd{extra} FROM {source}"


def _sql_count(cols: list[str]) -> str:
    return "CAST(" + " + ".join(f"(CASE WHEN {sql_read(c)} IS NULL THEN 0 ELSE 1 END)" for c in cols) + " AS INTEGER)"


RECORDS_SQL = f"rec AS ({_sql_select(_PLAIN, f', {_sql_count(DX)} AS n_dx, {_sql_count(PX)} AS n_px', 'grd_2019_2024')})"
DISCHARGES_SQL = f"b AS ({_sql_select(_PLAIN | _COHORT, '', 'grd_depurado')})"
