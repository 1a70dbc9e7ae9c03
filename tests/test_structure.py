import ast
import os
import pathlib

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
CHECKED = ["p1_found", "p3_found", "p4_found", "p6_found", "assign_persons", "episode_id", "waterfall_steps", "readmission_30d_by_year_mdc", "partition_ids", "chi2_cramers_v", "prior_stays_365d", "auprc_auroc", "control_table",
           "exclusion_reason", "keep_most_complete", "code_counts_per_fold", "metrics_by_year", "p3_calendar", "p6_reopened", "delimited_round_trip", "comorbidity_score", "redact_id_shapes",
           "bootstrap_interval", "case_features", "scenario_diff", "seen_patient_any", "rare_merge"]


def test_core_does_not_import_llm():
    for p in (ROOT / "cohortia").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), p


def test_entry_without_llm(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "cohortia.llm.queries", None)
    assert "p1_found" in e.queries() and not any(k.startswith("p2_") for k in e.queries())


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(__import__("__spark_entry__").oracle_sql()) if os.environ.get("ALL_QUERIES") else CHECKED)
def test_query_equals_sql(spark, data, name):
    compare_with_sql(spark, data, name)


def compare_with_sql(spark, data, name):
    import duckdb
    import pandas as pd

    import __spark_entry__ as e
    from tools.compare import rows

    con = duckdb.connect()
    for p in pathlib.Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = e.queries()[name](spark, data)
    mine = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
    cur = con.execute(e.oracle_sql()[name])
    other = pd.DataFrame(cur.fetchall(), columns=[x[0] for x in cur.description], dtype=object)
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)
