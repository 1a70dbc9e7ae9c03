import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import codes, evaluate, features, model, partition, quality, trees
from cohortia.plans import modelling


def test_association_against_correlation(spark):
    rng = random.Random(3)
    cases = [(i, rng.choice([0, 0, 1])) for i in range(200)] + [(999, None)]
    held = [(i, "D", "COMPLETO", c) for i, _ in cases for c in "abc" if rng.random() < {"a": 0.5, "b": 0.1, "c": 0.02}[c]]
    df = spark.createDataFrame(cases, "id int, y int")
    got = codes.association(spark.createDataFrame(held, "id int, block string, level string, code string"), df, "id", "y").collect()
    ys = {i: y for i, y in cases if y is not None}
    for r in got:
        xs = {i: 0 for i in ys} | {i: 1 for i, _, _, c in held if c == r["code"] and i in ys}
        mx, my = sum(xs.values()) / len(xs), sum(ys.values()) / len(ys)
        cov = sum((xs[i] - mx) * (ys[i] - my) for i in ys)
        v = abs(cov) / math.sqrt(sum((x - mx) ** 2 for x in xs.values()) * sum((y - my) ** 2 for y in ys.values()))
        assert abs(r["v"] - v) < 1e-6 and abs(r["chi2"] - v * v * 200) < 1e-4


def test_code_pairs_counts_a_code_once(spark):
    df = spark.createDataFrame([(1, " a1.2", "A1.2", None), (2, "IGNORADO", "", "b9.1")], "id int, d1 string, d2 string, d3 string")
    got = sorted(tuple(r) for r in codes.code_pairs(df, "id", {"D": ["d1", "d2", "d3"]}, ("COMPLETO", "CATEGORIA")).collect())
    assert got == [(1, "D", "CATEGORIA", "A1"), (1, "D", "COMPLETO", "A1.2"), (2, "D", "CATEGORIA", "B9"), (2, "D", "COMPLETO", "B9.1")]


def test_p_value_threshold(spark):
    df = spark.createDataFrame([(codes.CHI2_P001,), (0.0,), (3.841459,)], "chi2 double")
    assert [round(r["p"], 5) for r in codes.with_p_value(df).collect()] == [0.001, 1.0, 0.05]


def test_systematic_deal_is_even(spark):
    units = spark.createDataFrame([(i, "big" if i % 50 else "small", i % 3) for i in range(1000)], "u int, s string, o int")
    dealt = partition.systematic_deal(units, "s", ["o"], "u", 5, 1, "t")
    n = {(r["s"], r["part"]): r["count"] for r in dealt.groupBy("s", "part").count().collect()}
    assert {v for (s, _), v in n.items() if s == "big"} == {196} and {v for (s, _), v in n.items() if s == "small"} == {4}
    again = partition.systematic_deal(units.repartition(7), "s", ["o"], "u", 5, 1, "t")
    assert sorted(map(tuple, dealt.select("u", "part").collect())) == sorted(map(tuple, again.select("u", "part").collect()))


def brute_auroc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_ranking_metrics_with_ties(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.3)) for _ in range(200)]
    df = spark.createDataFrame([*rows, (None, 1), (0.5, None)], "s double, y int")
    got = evaluate.ranking_metrics(evaluate.score_table(df, "s", "y")).first()
    tp = fp = ap = 0
    total = sum(y for _, y in rows)
    for s in sorted({s for s, _ in rows}, reverse=True):
        p, q = sum(y for t, y in rows if t == s), sum(1 - y for t, y in rows if t == s)
        tp, fp = tp + p, fp + q
        ap += p / total * tp / (tp + fp)
    assert abs(got["auroc"] - brute_auroc(rows)) < 1e-6 and abs(got["auprc"] - ap) < 1e-6
    assert abs(features.auroc(df, "s", "y").first()["auroc"] - brute_auroc(rows)) < 1e-6


def test_calibration_recovers_shift_and_slope(spark):
    rng = random.Random(11)
    sig = lambda x: 1 / (1 + math.exp(-x))
    rows = [(sig(x), int(rng.random() < sig(0.5 + 2 * x))) for x in (rng.gauss(0, 1) for _ in range(8000))]
    df = spark.createDataFrame([(*r, i % 2) for i, r in enumerate([*rows, (0.0, 0), (1.0, 1)])], "s double, y int, g int")
    ((name, _, intercept, slope),) = evaluate.calibration(df, "s", "y")
    assert name is None and abs(slope - 2) < 0.2 and abs(intercept - 0.5) < 0.15
    parts = evaluate.calibration(df, "s", "y", "g")
    alone = evaluate.calibration(df.where("g = 1"), "s", "y")[0]
    assert [p[0] for p in parts] == ["0", "1"] and all(abs(a - b) < 1e-9 for a, b in zip(parts[1][1:], alone[1:]))
    assert evaluate.calibration(df.limit(0), "s", "y") == []


@pytest.mark.parametrize("upto", [-1, 0])
@pytest.mark.parametrize("backwards", [False, True])
def test_carried_equals_one_window(spark, upto, backwards):
    """Shard by shard gives what one window over the whole group gives, with a third of all rows in one group."""
    from pyspark.sql import Window

    from cohortia.operators.ordered import carried, month_of, running_last, running_max

    rng = random.Random(5)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(1, 9), rng.randrange(400), rng.choice([None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g int, n int, v int").selectExpr("*", "date_add(DATE '2022-01-01', n) AS d")
    order = [F.desc("d"), F.desc("id")] if backwards else ["d", "id"]
    whole = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    last = running_last(F.col("v"), F.struct("d", "id"), backwards)
    for name, over, plain in (("last", last, F.last("v", ignorenulls=True)), ("max", running_max(F.col("v")), F.max("v"))):
        got = carried(df, ["g"], month_of("d"), order, name, over, upto, backwards)
        assert sorted(map(str, got.select("id", name).collect())) == sorted(map(str, df.withColumn(name, plain.over(whole)).select("id", name).collect()))


def test_history_borders(spark):
    from datetime import date, timedelta

    d = date(2022, 6, 1)
    ev = [(1, 10, d), (1, 11, d - timedelta(365)), (1, 12, d - timedelta(366)), (1, 13, d), (2, 20, d + timedelta(1))]
    events = spark.createDataFrame(ev, "person_id bigint, episode_id bigint, end date")
    cases = spark.createDataFrame([(100, 1, d, 10), (200, 2, d, 20)], "encounter_id bigint, person_id bigint, admit date, episode_id bigint")
    got = {r["encounter_id"]: r["n"] for r in features.history(cases, events, 365, {"n": F.lit(True)}).collect()}
    assert got == {100: 2, 200: 0}  # ends on the day and 365 days before count, 366 and its own zero-day stay don't
    since = {r["encounter_id"]: r["days_since"] for r in features.days_since_last(cases, events, 365).collect()}
    assert since == {100: 0, 200: 366}


def test_comorbidity_hierarchy(spark):
    pairs = spark.createDataFrame([(1, "C50.1"), (1, "C78.0"), (2, "C50.1"), (3, "Z00")], "id int, code string")
    prefixes = spark.createDataFrame([("cancer", "C", 4), ("spread", "C7", 7)], "condition string, prefix string, weight bigint")
    got = {r["id"]: (r["conditions"], r["score"]) for r in features.comorbidity(pairs, prefixes, [("spread", "cancer")], "id").collect()}
    assert got == {1: (1, 7), 2: (1, 4)}


def test_bootstrap_weights_mean_one(spark):
    w = evaluate.bootstrap_weights(spark.range(2000).withColumnRenamed("id", "u"), "u", 5).agg(F.sum("w")).first()[0]
    assert abs(w / 10000 - 1) < 0.05


def test_expand_spec():
    assert quality.expand_spec("diagnostico{2-4}") == ["diagnostico2", "diagnostico3", "diagnostico4"] and quality.expand_spec("x") == ["x"]


def test_design_divides_marks_by_their_deviation(spark):
    cases = spark.createDataFrame([(i, "a" if i < 2 else "b", float(i)) for i in range(10)], "id int, c string, x double")
    pairs = spark.createDataFrame([(i, "D", "COMPLETO", "Z") for i in (0, 9)], "id int, block string, level string, code string")
    train, vocab = cases.where("id < 8"), model.vocabulary(cases, ["c"], pairs, "id")
    got = {r["id"]: r["features"] for r in model.design(cases, "id", ["x"], ["c"], {"x": (0.0, 0.0, 1.0)}, vocab, pairs, train=train).collect()}
    slot = {f: i + 1 for i, f in enumerate(vocab)}
    level, code = 1 / math.sqrt(0.25 * 0.75), 1 / math.sqrt(0.125 * 0.875)  # 2 and 1 of 8 training rows
    assert abs(got[0][slot["c=a"]] - level) < 1e-9 and abs(got[9][slot["c=b"]] - level) < 1e-9 and got[9][slot["c=a"]] == 0
    assert abs(got[9][slot["D|COMPLETO|Z"]] - code) < 1e-9 and got[1][slot["D|COMPLETO|Z"]] == 0


def test_only_the_codes_of_the_folds_list_enter(spark):
    cases = spark.createDataFrame([(i, i % 2 + 1, i // 2 % 2, "a", 0.0) for i in range(80)], "id int, fold int, y int, c string, x double")
    pairs = spark.createDataFrame([(i, "D", "COMPLETO", "Z") for i in range(80) if i // 2 % 2], "id int, block string, level string, code string")
    lists = spark.createDataFrame([(1, "D", "COMPLETO", "Z")], "fold int, block string, level string, code string")
    got = model.out_of_fold(cases, "id", "y", "fold", "LR", ["x"], ["c"], pairs, lists=lists).collect()
    assert {r["probability"] > 0.6 or r["probability"] < 0.4 for r in got if r["fold"] == 1} == {True}
    assert {r["probability"] for r in got if r["fold"] == 2} == {0.5}


def test_registered_training_is_whole(spark, data, monkeypatch):
    seen = []
    monkeypatch.setattr(model, "out_of_fold", lambda *a, **k: seen.append((a, k)))
    modelling.REG.queries["cv_forest_oof"](spark, data)
    (_, _, _, _, kind, numeric, categorical, pairs, logged), more = seen[0]
    assert kind == "RF" and not more.get("small") and {"site", "sex"} <= set(categorical) and {"age", "weight"} <= set(numeric) and set(logged) <= set(numeric)
    assert pairs.columns == ["encounter_id", "block", "level", "code"] and more["lists"].columns == ["fold", "block", "level", "code"]


def test_bootstrap_of_a_thousand_draws_is_registered(spark, data, monkeypatch):
    seen = []
    whole = evaluate.bootstrap_metrics
    monkeypatch.setattr(evaluate, "bootstrap_metrics", lambda *a: seen.append(a[4]) or whole(*a[:4], 2))
    for name in ("bootstrap_interval", "paired_verdict", "weighting_verdict"):
        modelling.REG.queries[name](spark, data)
    assert seen == [1000] * 5


@pytest.mark.parametrize(("prc", "roc", "verdict"), [(0.05, 0.01, "NOT_WORSE"), (0.2, 0.01, "LOSES"), (0.05, 0.03, "LOSES"), (None, 0.01, "UNDECIDED")])
def test_joint_verdict(spark, prc, roc, verdict):
    """The auprc's margin is a share of the other's value, the auroc's is in points; both decide together."""
    falls = [prc if prc is not None else i / 100 for i in range(40)]
    a = spark.createDataFrame([(i, 0.5 * (1 - f), 0.7 - roc) for i, f in enumerate(falls)], "draw int, auprc double, auroc double")
    b = spark.createDataFrame([(i, 0.5, 0.7) for i in range(40)], "draw int, auprc double, auroc double")
    got = {r["metric"]: r for r in evaluate.paired_verdict(a, b).collect()}
    assert {r["verdict"] for r in got.values()} == {verdict} and abs(got["auroc"]["mean"] - roc) < 1e-6
    assert evaluate.weighting_verdict(a, b).first()["verdict"] == ("WEIGH" if prc == 0.2 else "PLAIN")


def test_codes_of_a_left_out_fold_are_zero(spark):
    pairs = spark.createDataFrame([(1, "D", "C", "x"), (2, "D", "C", "x"), (1, "D", "C", "y")], "id int, block string, level string, code string")
    cases = spark.createDataFrame([(1, 1, 1), (2, 0, 2), (3, 0, 2)], "id int, y int, f int")
    got = {(r["code"], r["fold"]): (r["n"], r["c"], r["total"], r["positives"]) for r in codes.per_fold(pairs, cases, "id", "y", "f", 2).collect()}
    assert got == {("x", 0): (2, 1, 3, 1), ("x", 1): (1, 0, 2, 0), ("x", 2): (1, 1, 1, 1), ("y", 0): (1, 1, 3, 1), ("y", 1): (0, 0, 2, 0), ("y", 2): (1, 1, 1, 1)}
    kept = codes.per_fold(pairs.join(cases, "id"), cases, "id", "y", "f", 2)
    assert {(r["code"], r["fold"]): (r["n"], r["c"], r["total"], r["positives"]) for r in kept.collect()} == got


def test_bootstrap_metrics_equal_repeated_rows(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(9), rng.randrange(4) / 4, rng.randrange(2)) for _ in range(120)]
    df = spark.createDataFrame(rows, "u int, s double, y int")
    w = {(r["draw"], r["u"]): r["w"] for r in evaluate.bootstrap_weights(df, "u", 3).collect()}
    for r in evaluate.bootstrap_metrics(df, "u", "s", "y", 3).collect():
        assert abs(r["auroc"] - brute_auroc([(s, y) for u, s, y in rows for _ in range(w.get((r["draw"], u), 0))])) < 1e-6


def learnable(spark, n=400):
    rng = random.Random(6)
    cases, pairs = [], []
    for i in range(n):
        x, z, c = rng.choice([None, *range(12)]), rng.random(), rng.choice("abcd")
        pairs += [(i, "D", "COMPLETO", k) for k in "UVW" if rng.random() < 0.3]
        odds = 0.1 + 0.04 * (x or 0) + 0.2 * (c == "b") + 0.2 * any(p[0] == i and p[3] == "U" for p in pairs[-3:])
        cases.append((i, i % 3 + 1, None if i == 7 else int(rng.random() < odds), x, int(z * 20) / 4, c))
    lists = [(f, "D", "COMPLETO", k) for f, ks in ((1, "UV"), (2, "U"), (3, "UVW")) for k in ks]
    return (
        spark.createDataFrame(cases, "id int, fold int, y int, x int, z double, c string"), spark.createDataFrame(pairs, "id int, block string, level string, code string"),
        spark.createDataFrame(lists, "fold int, block string, level string, code string"),
    )


@pytest.mark.parametrize("weighted", [False, True])
def test_boosting_in_a_task_equals_sparks(spark, weighted):
    cases, pairs, lists = learnable(spark)
    run = lambda k: {r["id"]: (r["fold"], r["probability"]) for r in model.out_of_fold(cases, "id", "y", "fold", "GB", ["x", "z"], ["c"], pairs, weighted=weighted, small=True, lists=lists, task_rows=k).collect()}
    own, sparks = run(1000), run(0)
    assert own.keys() == sparks.keys() and len(own) == 399
    assert all(own[i][0] == f and abs(own[i][1] - p) < 1e-5 for i, (f, p) in sparks.items())


def test_forest_in_a_task_is_like_sparks(spark):
    cases, pairs, lists = learnable(spark, 1500)
    run = lambda df, k: {r["id"]: r["probability"] for r in model.out_of_fold(df, "id", "y", "fold", "RF", ["x", "z"], ["c"], pairs, lists=lists, task_rows=k).collect()}
    own = run(cases, 5000)
    assert own == run(cases.repartition(5), 5000)  # the order of rows has no say
    sparks = run(cases, 0)
    a, b = [own[i] for i in sparks], list(sparks.values())
    mean = lambda v: sum(v) / len(v)
    cov = lambda u, v: mean([(x - mean(u)) * (y - mean(v)) for x, y in zip(u, v)])
    assert cov(a, b) / math.sqrt(cov(a, a) * cov(b, b)) > 0.9 and abs(mean(a) - mean(b)) < 0.02


@pytest.mark.parametrize("w", [None, (1.0, 3.7)])
def test_forest_nodes_counted_alone_or_together_are_the_same(monkeypatch, w):
    """A large node passes over its own columns, small ones are counted at once: neither changes a probability."""
    rng = np.random.default_rng(5)
    n, sizes, n_codes = 3000, [3, 40, 1], 6

    def made(n):
        rows, codes = np.nonzero(rng.random((n, n_codes)) < [0.5, 0.1, 0.02, 0.3, 0.0, 1.0])
        return trees.Cases([rng.integers(0, 32, n).astype(np.uint8) for _ in range(3)], [rng.integers(0, k, n).astype(np.uint8) for k in sizes], sizes, rows, codes, n_codes)

    train, test = made(n), made(500)
    y = ((train.cols[0] > 12) ^ (train.cols[4] < 9) ^ train.holds(np.arange(n), np.zeros(n, np.int64)) ^ (rng.random(n) < 0.2)).astype(float)
    found = []
    for large in (1, 60, n + 1):
        monkeypatch.setattr(trees, "LARGE", large)
        found.append(trees.forest(train, y, w, test, 8, 9, 3, chunk=7))
    assert np.array_equal(found[0], found[1]) and np.array_equal(found[0], found[2]) and found[0].std() > 0.05


def test_trees_are_dealt_to_all_cores(spark, monkeypatch):
    for folds, grown, cores in ((5, 100, 8), (5, 100, 2), (3, 7, 64), (1, 1, 1), (5, 10, 6)):
        shares = model.tree_shares(folds, grown, cores)
        assert sorted((f, t) for s in shares for f, a, b in s for t in range(a, b)) == [(f, t) for f in range(folds) for t in range(grown)]
        sizes = [sum(b - a for _, a, b in s) for s in shares]
        assert len(shares) == min(max(folds, cores), 4 * folds) and max(sizes) - min(sizes) <= 1
    cases, pairs, lists = learnable(spark, 600)
    run = lambda: {r["id"]: r["probability"] for r in model.out_of_fold(cases, "id", "y", "fold", "RF", ["x", "z"], ["c"], pairs, lists=lists, small=True).collect()}
    deal, found = model.tree_shares, []
    for cores in (1, 9):  # who grows a tree has no say
        monkeypatch.setattr(model, "tree_shares", lambda folds, trees, _, c=cores: deal(folds, trees, c))
        found.append(run())
    assert found[0].keys() == found[1].keys() and all(abs(p - found[1][i]) < 2e-6 for i, p in found[0].items())


def test_columns_counted_as_one_are_parted_again(monkeypatch):
    """Boosting counts combinations of columns in large nodes: each column gets what it gets alone."""
    rng = np.random.default_rng(6)
    n, sizes = 5000, [3, 300, 1, 12]
    train = trees.Cases([rng.integers(0, k, n).astype(np.uint8) for k in (2, 32, 5)], [rng.integers(0, k, n).astype(np.min_scalar_type(k)) for k in sizes], sizes, np.arange(n), rng.integers(0, 4, n), 4)
    at, g, mark = np.sort(rng.permutation(n)[:4000]), rng.integers(-8, 8, n) / 8, np.zeros(n, bool)
    monkeypatch.setattr(trees, "CELLS", 1000)
    groups = trees.joined(train)
    assert sorted(c for _, m, _ in groups for c in m) == list(range(7)) and len(groups) == 3
    for rows in (None, at):
        for w in (None, rng.integers(1, 3, n).astype(float)):
            monkeypatch.setattr(trees, "CELLS", 1000)
            one = trees._counts(train, groups, rows, w, g, mark)
            monkeypatch.setattr(trees, "CELLS", n + 1)
            assert np.array_equal(one, trees._counts(train, groups, rows, w, g, mark)) and one[0, :32].sum() == (len(g if rows is None else rows) if w is None else w[slice(None) if rows is None else rows].sum())


def test_labels_are_found_once_for_training(spark, data, monkeypatch):
    """Every feature reads the same written labels and episodes."""
    found = {"labelled": 0, "episode_ends": 0}
    for name in found:
        whole = getattr(modelling, name)
        monkeypatch.setattr(modelling, name, lambda *a, n=name, f=whole: found.update({n: found[n] + 1}) or f(*a))
    monkeypatch.setattr(model, "out_of_fold", lambda cases, *a, **k: cases)
    table = modelling.REG.queries["cv_gbt_oof"](spark, data)
    assert found == {"labelled": 1, "episode_ends": 1} and table.count() == modelling.REG.queries["cv_folds"](spark, data).count()
