"""Records, persons, episodes, rules and labels on hand-written edge rows and against row-by-row walks."""

import random
from datetime import date, timedelta

import pytest

from cohortia.operators import criteria, dedup, episodes, identity, labels
from cohortia.operators.criteria import Rule

D0 = date(2022, 1, 1)


def day(n):
    return None if n is None else D0 + timedelta(days=n)


STAY = "encounter_id bigint, patient_id bigint, person_id bigint, site string, admit date, discharge date, sex string, birth date, admit_type string, discharge_type string, origin string, dx string, grd string, mdc string, block string, year int"


def stays(spark, rows):
    base = {"admit": None, "discharge": None, "patient_id": 1, "person_id": 101, "site": "h", "sex": "M", "birth": None, "admit_type": "URGENCIA", "discharge_type": "DOMICILIO", "origin": "APS", "dx": "I10", "grd": "010101", "mdc": "01", "block": "B", "year": 2022}
    names = [c.split()[0] for c in STAY.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], STAY)


def test_exact_and_key_repeats(spark):
    df = spark.createDataFrame([(1, "f", 1, "a", None), (2, "f", 1, "a", None), (3, "g", 1, "a", None), (4, "f", None, "a", 1)], "id int, file string, k int, v string, w int")
    flags = {r["id"]: r["dup_exact"] for r in dedup.exact_copies(df, ["k", "v", "w"], "file", "id").collect()}
    assert flags == {1: False, 2: True, 3: False, 4: False}
    keys = {r["id"]: r["dup_key"] for r in dedup.key_repeats(df, ["k", "v"]).collect()}
    assert keys == {1: True, 2: True, 3: True, 4: False}


def test_keep_most_complete(spark):
    rows = [(1, 5, "a", 2, 1, None), (2, 5, "a", 2, 1, 0.5), (3, 5, "a", 2, 0, 9.0), (4, None, "a", 0, 0, None), (5, None, "a", 0, 0, None), (6, 6, None, 1, 1, 1.0), (7, 6, None, 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "id int, k int, loose string, nd int, np int, w double")
    kept = dedup.keep_most_complete(df, ["k"], ["loose"], "id", [("nd", False), ("np", False), ("w", True)])
    assert sorted(r["id"] for r in kept.collect()) == [2, 4, 5, 6]


@pytest.mark.parametrize(
    ("births", "expected"),
    [
        (["1950-05-10", "1951-05-11"], {1}),  # 366 days apart
        (["1950-05-10", "1970-05-10"], {1}),  # same day and month
        (["1950-01-01", "1980-02-02"], {1, 2}),
        (["1950-01-01", "1950-12-01", "1951-11-01"], {1}),  # a chain of close dates
    ],
)
def test_persons_of_an_identifier(spark, births, expected):
    rows = [{"encounter_id": i, "birth": date.fromisoformat(b)} for i, b in enumerate(births)] + [{"encounter_id": 99}]
    got = {r["encounter_id"]: r["person_id"] for r in identity.assign_persons(stays(spark, rows)).collect()}
    assert {v - 100 for k, v in got.items() if k < 99} == expected
    assert got[0] == 101 and got[99] == (101 if expected == {1} else None)


def test_generic_identifiers(spark):
    rows = [{"encounter_id": i, "patient_id": p, "birth": date(1950 + 3 * i, 1 + i, 1)} for p, n in ((4, 4), (5, 5)) for i in range(n)]
    df = stays(spark, rows)
    assert [r["patient_id"] for r in identity.generic_ids(df).collect()] == [5]
    got = identity.assign_persons(df).collect()
    assert all((r["person_id"] is None) == (r["patient_id"] == 5) for r in got)


def test_a_missing_birth_is_a_combination(spark):
    rows = [{"encounter_id": i, "birth": date(1950 + 3 * i, 1 + i, 1) if i < 4 else None} for i in range(5)]
    assert [(r["patient_id"], r["combos"]) for r in identity.generic_ids(stays(spark, rows)).collect()] == [(1, 5)]
    assert all(r["person_id"] is None for r in identity.assign_persons(stays(spark, rows)).collect())


def test_exclusions_decide_on_cases_and_readmissions(spark):
    """The dead are no case, a transfer's first part neither; a day case of a kind that can't be followed is no re-admission."""
    from pyspark.sql import functions as F

    rules = [Rule("E04", "odd", "BOTH"), Rule("E05", "not_final"), Rule("E06", "died")]
    rows = [{"encounter_id": 1, "admit": day(0), "discharge": day(2)}, {"encounter_id": 2, "admit": day(2), "discharge": day(5), "site": "k"},
            {"encounter_id": 3, "admit": day(7), "discharge": day(7), "origin": "ODD"}, {"encounter_id": 4, "admit": day(20), "discharge": day(25), "discharge_type": "FALLECIDO"}]
    df = stays(spark, rows).withColumn("episode_id", F.when(F.col("encounter_id") == 2, 1).otherwise(F.col("encounter_id")).cast("bigint"))
    df = df.withColumn("odd", F.col("origin") == "ODD").withColumn("died", F.col("discharge_type") == "FALLECIDO").withColumn("trackable", criteria.trackable(rules))
    got = labels.label_readmissions(criteria.apply_rules(criteria.mark_not_final(df), rules)).collect()
    assert [(r["encounter_id"], r["readmit_7d"], r["readmit_30d"], r["next_id"]) for r in got] == [(2, 0, 1, 4)]
    with pytest.raises(ValueError):
        criteria.disjoint_kinds(("PROGRAMADA", "URGENCIA"), ("URGENCIA",))


def walk(rows):
    """Row by row: (id -> episode) by the rule's own words."""
    out, leader, current = {}, None, None
    for r in sorted(rows, key=lambda r: (r["admit"], r["discharge"], r["encounter_id"])):
        cont = False
        if leader:
            d = (r["admit"] - leader["discharge"]).days
            other = r["site"] != leader["site"]
            cont = d < 0 or (0 <= d <= 1 and other) or (d == 0 and not other and r["admit"] == leader["admit"] and r["discharge"] == leader["discharge"])
        current = current if cont else r["encounter_id"]
        out[r["encounter_id"]] = current
        if leader is None or (r["discharge"], r["admit"], r["encounter_id"]) >= (leader["discharge"], leader["admit"], leader["encounter_id"]):
            leader = r
    return out


def test_episodes_edges(spark):
    plan = [(1, 0, 10, "h"), (2, 2, 5, "h"), (3, 10, 12, "k"), (4, 13, 15, "h"), (5, 17, 18, "k"), (6, 18, 20, "k"), (7, 30, 30, "h"), (8, 30, 30, "h")]
    rows = [{"encounter_id": i, "admit": day(a), "discharge": day(z), "site": s} for i, a, z, s in plan]
    rows += [{"encounter_id": 50, "person_id": None, "admit": day(0), "discharge": day(1)}, {"encounter_id": 51, "admit": day(3), "discharge": day(1)}]
    got = {r["encounter_id"]: r["episode_id"] for r in episodes.build_episodes(stays(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 7}


def test_episodes_against_walk(spark):
    rng = random.Random(7)
    rows = []
    for p in range(12):
        for _ in range(rng.randrange(1, 15)):
            a = rng.randrange(0, 60)
            rows.append({"encounter_id": len(rows), "person_id": p, "admit": day(a), "discharge": day(a + rng.randrange(0, 9)), "site": rng.choice(["h", "k", None])})
    got = {r["encounter_id"]: r["episode_id"] for r in episodes.build_episodes(stays(spark, rows)).collect()}
    for p in range(12):
        own = walk([r for r in rows if r["person_id"] == p])
        assert {k: got[k] for k in own} == own
    finals = episodes.build_episodes(stays(spark, rows)).where("final").groupBy("episode_id").count().where("count <> 1")
    assert finals.count() == 0


def label_rows(spark, rows, rules=labels.LabelRules()):
    df = stays(spark, rows).selectExpr("*", "encounter_id AS episode_id", "true AS is_case", "true AS may_readmit")
    return {r["encounter_id"]: r for r in labels.label_readmissions(df, rules).collect()}


@pytest.mark.parametrize(("gap", "in7", "in30"), [(0, 1, 1), (7, 1, 1), (8, 0, 1), (30, 0, 1), (31, 0, 0)])
def test_label_windows(spark, gap, in7, in30):
    got = label_rows(spark, [{"encounter_id": 1, "admit": day(0), "discharge": day(5)}, {"encounter_id": 2, "admit": day(5 + gap), "discharge": day(60)}])
    assert (got[1]["readmit_7d"], got[1]["readmit_30d"], got[1]["days_to_next"], got[1]["next_id"]) == (in7, in30, gap, 2)


def test_label_precedence_and_related(spark):
    first = {"encounter_id": 1, "admit": day(0), "discharge": day(5)}
    for change in ({"grd": "146101"}, {"dx": "Z51.1"}, {"admit_type": None}, {"admit_type": "PROGRAMADA"}):
        assert label_rows(spark, [first, {"encounter_id": 2, "admit": day(8), "discharge": day(9), **change}])[1]["readmit_7d"] == 0
    got = label_rows(spark, [first, {"encounter_id": 2, "admit": day(7), "discharge": day(8), "mdc": "02"}, {"encounter_id": 3, "admit": day(10), "discharge": day(11)}])
    assert (got[1]["readmit_7d"], got[1]["readmit_7d_mdc"], got[1]["next_id"]) == (1, 1, 2)
    assert label_rows(spark, [{**first, "mdc": None}, {"encounter_id": 2, "admit": day(7), "discharge": day(8), "mdc": None}])[1]["readmit_7d_mdc"] == 0
    births = [{**first, "mdc": "14"}, {"encounter_id": 2, "admit": day(7), "discharge": day(8), "mdc": "13"}]
    assert label_rows(spark, births)[1]["readmit_7d_mdc"] is None and label_rows(spark, births)[1]["readmit_7d"] == 1
    for rules, want in ((labels.LabelRules(no_related=()), 0), (labels.LabelRules(mdc_groups=(("13", "14"),)), 1), (labels.LabelRules().all_forms(), 0)):
        assert label_rows(spark, births, rules)[1]["readmit_7d_mdc"] == want
    assert label_rows(spark, [{**first, "mdc": "99"}, {"encounter_id": 2, "admit": day(7), "discharge": day(8), "mdc": "99"}])[1]["readmit_7d_mdc"] == 0


@pytest.mark.parametrize(("before_end", "seen7", "seen30"), [(36, False, False), (37, True, False), (59, True, False), (60, True, True)])
def test_censoring(spark, before_end, seen7, seen30):
    z = date(2024, 12, 31) - timedelta(days=before_end)
    r = label_rows(spark, [{"encounter_id": 1, "admit": z, "discharge": z}])[1]
    assert (r["readmit_7d"] is not None, r["readmit_30d"] is not None) == (seen7, seen30)


def test_rules(spark):
    rules = [Rule("E06", "a"), Rule("E13", "b", "BOTH"), Rule("E20", "c", active=False)]
    df = spark.createDataFrame([(1, 1, True, True, True), (2, 2, False, True, False), (3, 3, False, False, True), (4, 3, False, False, False)], "encounter_id int, episode_id int, a boolean, b boolean, c boolean")
    df = df.selectExpr("*", "1 AS person_id", "DATE '2022-01-01' AS admit", "DATE '2022-01-02' AS discharge").withColumn("trackable", criteria.trackable(rules))
    out = criteria.apply_rules(df, criteria.validate_rules(rules))
    got = {r["encounter_id"]: (r["reason"], r["is_case"], r["may_readmit"]) for r in out.collect()}
    assert got == {1: ("E06", False, False), 2: ("E13", False, False), 3: (None, True, True), 4: (None, True, False)}
    steps = [tuple(r) for r in criteria.waterfall(out, rules).select("code", "met", "removed", "would_remove", "remaining").orderBy("step").collect()]
    assert steps == [("E06", 1, 1, None, 3), ("E13", 2, 1, None, 2), ("E20", 2, 0, 1, 2)]
    for bad in (lambda: criteria.validate_rules([Rule("x", "a", required=True)], {"x": False}), lambda: criteria.validate_rules(rules, {"nope": True}), lambda: criteria.validate_rules([*rules, Rule("E06", "d")])):
        with pytest.raises(ValueError):
            bad()


def test_periodic_treatment(spark):
    from pyspark.sql import functions as F

    plan = {1: [0, 365], 2: [0, 100, 365], 3: [0, 1, 366], 4: [5, 5, 5], 5: [0, 10, 20]}
    rows = [{"encounter_id": p * 10 + i, "person_id": p, "admit": day(a), "discharge": day(a)} for p, days in plan.items() for i, a in enumerate(days)]
    out = criteria.periodic_treatment(stays(spark, rows), F.lit(True))
    assert sorted(r["encounter_id"] for r in out.where("periodic").collect()) == [22, 52]
