"""Out-of-fold training: Spark ML, and trees that hold a fold in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.session import cut


def _levels(categorical: list[str]) -> Column:
    return F.array(*(F.concat_ws("=", F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("SIN DATO"))) for c in categorical))


def _code() -> Column:
    return F.concat_ws("|", "block", "level", "code")


def vocabulary(cases: DataFrame, categorical: list[str], pairs: DataFrame | None = None, record_id: str = "encounter_id") -> list[str]:
    """The 0/1 columns in order of the name: one per level of each categorical column (none dropped) and per code of pairs (block,
    level, code). They are the columns of the model's matrix, so they fit where the model does."""
    names = cases.select(F.explode(_levels(categorical)).alias("feature")).distinct()
    if pairs is not None:
        names = names.unionByName(pairs.select(_code().alias("feature")).distinct()).distinct()
    return sorted(r[0] for r in names.collect())


def training_statistics(train: DataFrame, numeric: list[str], logged: tuple[str, ...] = ()) -> dict[str, tuple[float, float, float]]:
    """column -> (median, mean, population standard deviation) of the training rows, medians exact, after log1p for `logged`."""
    med = train.agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in numeric)).first()
    filled = {c: _numeric(c, float(med[c] or 0.0), c in logged) for c in numeric}
    sums = train.agg(*(F.avg(x).alias(f"m_{c}") for c, x in filled.items()), *(F.stddev_pop(x).alias(f"s_{c}") for c, x in filled.items())).first()
    return {c: (float(med[c] or 0.0), float(sums[f"m_{c}"] or 0.0), float(sums[f"s_{c}"] or 0.0)) for c in numeric}


def _numeric(c: str, median: float, log: bool) -> Column:
    x = F.coalesce(F.col(c).cast("double"), F.lit(median))
    return F.log1p(F.greatest(x, F.lit(0.0))) if log else x


def design(cases: DataFrame, record_id: str, numeric: list[str], categorical: list[str], stats: dict[str, tuple[float, float, float]], vocab: list[str], pairs: DataFrame | None = None, logged: tuple[str, ...] = (), train: DataFrame | None = None) -> DataFrame:
    """cases with `features`, a sparse vector: z-scored numeric columns, then the 0/1 columns of the vocabulary. train: its rows
    give each 0/1 column's share p, and the column is divided by sqrt(p (1 - p)); one that is constant there stays as it is.
    The 0/1 columns aren't centred, which keeps the matrix sparse. Vectors are put together inside the JVM."""
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, VectorAssembler
    from pyspark.ml.linalg import Vectors

    marked = cases.withColumn("__marks", _levels(categorical))
    if pairs is not None:
        kept = pairs.join(cases.select(record_id), record_id, "left_semi")
        held = kept.groupBy(record_id).agg(F.collect_set(_code()).alias("__codes"))  # one record's codes
        marked = marked.join(held, record_id, "left").withColumn("__marks", F.concat("__marks", F.coalesce("__codes", F.array().cast("array<string>")))).drop("__codes")
    scale = [1.0] * len(vocab)
    if train is not None:
        total = max(train.count(), 1)
        shares = marked.join(train.select(record_id), record_id, "left_semi").select(F.explode(F.array_distinct("__marks")).alias("feature")).groupBy("feature").agg((F.count(F.lit(1)) / total).alias("p"))
        slot = {f: i for i, f in enumerate(vocab)}
        for r in shares.collect():
            if r["feature"] in slot and 0 < r["p"] < 1:
                scale[slot[r["feature"]]] = 1 / (r["p"] * (1 - r["p"])) ** 0.5
    for i, c in enumerate(numeric):
        marked = marked.withColumn(f"__n{i}", (_numeric(c, stats[c][0], c in logged) - stats[c][1]) / (stats[c][2] or 1.0))
    ones = CountVectorizerModel.from_vocabulary(vocab, "__marks", "__ones")
    marked = ones.setBinary(True).transform(marked)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="__ones", outputCol="__scaled").transform(marked)
    whole = VectorAssembler(inputCols=[*(f"__n{i}" for i in range(len(numeric))), "__scaled"], outputCol="features").transform(scaled)
    return whole.select(*cases.columns, "features")


def estimator(kind: str, n: int, seed: int = 17, small: bool = False):
    """LR: L1 logistic with C = 1; RF: forest; GB: boosting. Same families as common single-node settings, other solvers:
    forests and boosting are binned and depth-capped here."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "w"}
    if kind == "LR":
        return LogisticRegression(elasticNetParam=1.0, regParam=1.0 / max(n, 1), standardization=False, maxIter=30 if small else 1000, tol=1e-4, **common)
    if kind == "RF":
        return RandomForestClassifier(numTrees=10 if small else 100, featureSubsetStrategy="sqrt", maxDepth=5 if small else 20, seed=seed, **common)
    if kind == "GB":
        return GBTClassifier(maxIter=5 if small else 100, stepSize=0.3, maxDepth=3 if small else 6, seed=seed, **common)
    raise ValueError(f"unknown model {kind}")


def out_of_fold(cases: DataFrame, record_id: str, label: str, fold: str, kind: str, numeric: list[str], categorical: list[str], pairs: DataFrame | None = None, logged: tuple[str, ...] = (), weighted: bool = False, small: bool = False, lists: DataFrame | None = None, task_rows: int = 4_000_000) -> DataFrame:
    """(record, fold, probability) of every case with a label, each predicted by a model fitted without its fold.

    Medians, means and deviations come from the training rows only. lists (fold, block, level, code): the codes of pairs that
    enter while that fold is predicted; without it all do. LR divides the 0/1 columns by their deviation and alone takes
    `logged`. weighted: positives weigh n0 / n1. RF and GB: up to task_rows cases trees grow in tasks that hold all cases (some
    150 bytes each, see fold_trees()), beyond that they are Spark's.
    """
    from pyspark.ml.functions import vector_to_array

    known = cases.where(F.col(label).isNotNull())
    linear = kind == "LR"
    if not linear and known.count() <= task_rows:
        return fold_trees(known, record_id, label, fold, kind, numeric, categorical, pairs, weighted, small, lists)
    logged = logged if linear else ()
    vocab = None
    folds = [r[0] for r in known.select(fold).distinct().orderBy(fold).collect()]
    out: DataFrame | None = None
    for f in folds:
        train = known.where(F.col(fold) != f)
        stats = training_statistics(train, numeric, logged) if linear else {c: (v[0], 0.0, 1.0) for c, v in training_statistics(train, numeric).items()}
        own = pairs
        if pairs is not None and lists is not None:
            own = pairs.join(cut(lists.where(F.col("fold") == f).select("block", "level", "code"), "lista"), ["block", "level", "code"], "left_semi")
        if vocab is None or lists is not None:
            vocab = vocabulary(known, categorical, own, record_id)
        data = design(known, record_id, numeric, categorical, stats, vocab, own, logged, train if linear else None).withColumn("label", F.col(label).cast("double"))
        n0, n1 = (train.where(F.col(label) == v).count() for v in (0, 1))
        data = cut(data.withColumn("w", F.when(F.lit(weighted) & (F.col("label") == 1), F.lit(n0 / max(n1, 1))).otherwise(1.0)).select(record_id, fold, "features", "label", "w"), "matriz")
        fitted = estimator(kind, n0 + n1, small=small).fit(data.where(F.col(fold) != f))
        scored = fitted.transform(data.where(F.col(fold) == f)).select(record_id, fold, F.round(vector_to_array("probability")[1], 6).alias("probability"))
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("no case has a label")
    return out


def fold_trees(known: DataFrame, record_id: str, label: str, fold: str, kind: str, numeric: list[str], categorical: list[str], pairs: DataFrame | None = None, weighted: bool = False, small: bool = False, lists: DataFrame | None = None, seed: int = 17) -> DataFrame:
    """out_of_fold() for RF and GB with the sizes of estimator(). A task grows one fold's boosted trees, or its share of all folds' forests
    (tree_shares()), and is sent all cases once: numbers, the place of each category's level, and the places of the codes held.
    Cases are put in order of the record first and a tree's draws hang on its number, so the result hangs on the cases alone."""
    levels: dict[str, list[str]] = {c: [] for c in categorical}
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("SIN DATO")).alias("v")) for c in categorical)))
    for r in sorted(map(tuple, known.select(cells.alias("x")).select("x.c", "x.v").distinct().collect())):
        levels[r[0]].append(r[1])
    at = lambda c: F.array_position(F.array(*map(F.lit, levels[c])), F.coalesce(F.col(c).cast("string"), F.lit("SIN DATO"))).cast("int") - 1
    rows = known.select(record_id, fold, F.col(label).cast("double").alias("__y"), *(F.col(c).cast("double").alias(f"__n{i}") for i, c in enumerate(numeric)), *(at(c).alias(f"__c{i}") for i, c in enumerate(categorical)))
    folds = [r[0] for r in known.select(fold).distinct().orderBy(fold).collect()]
    if not folds:
        raise ValueError("no case has a label")
    used: dict = dict.fromkeys(folds)
    places: dict[str, int] = {}
    if pairs is not None:
        own = pairs.select(_code().alias("code")) if lists is None else lists.where(F.col("fold").isin(folds)).select("fold", _code().alias("code"))
        listed = [tuple(r) for r in own.distinct().collect()]
        places = {c: i for i, c in enumerate(sorted({x[-1] for x in listed}))}
        if lists is not None:
            used = {f: sorted(places[c] for g, c in listed if g == f) for f in folds}
    if places:
        named = known.sparkSession.createDataFrame(list(places.items()), "__code string, __place int")
        held = pairs.withColumn("__code", _code()).join(F.broadcast(named), "__code").groupBy(record_id).agg(F.collect_set("__place").alias("__held"))  # one record's codes
        rows = rows.join(held, record_id, "left")
    else:
        rows = rows.withColumn("__held", F.lit(None).cast("array<int>"))
    rows = cut(rows, "matriz")
    sizes = [len(levels[c]) for c in categorical]
    n_numeric, fold_kind, id_kind = len(numeric), known.schema[fold], known.schema[record_id]
    if kind not in ("RF", "GB"):
        raise ValueError(f"unknown model {kind}")
    grown = 10 if small else 100
    work = tree_shares(len(folds), grown, known.sparkSession.sparkContext.defaultParallelism) if kind == "RF" else [[(i, 0, 0)] for i in range(len(folds))]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from cohortia.operators import trees

        read = trees.Reader(n_numeric, sizes)
        mine = None
        for b in batches:
            if b.num_rows:
                mine = b.column("__k")[0].as_py()
                read.add(b, record_id, fold)
        if mine is None:
            return
        for i, first, last in work[mine]:
            f = folds[i]
            train, y, test, ids = read.parts(f, used[f], len(places))
            w = (1.0, float((y == 0).sum() / max((y == 1).sum(), 1))) if weighted else None
            if kind == "GB":
                p = np.round(trees.boosted(train, y, None if w is None else np.where(y == 1, w[1], w[0]), test, 5 if small else 100, 3 if small else 6, 0.3), 6)
            else:
                p = trees.forest(train, y, w, test, grown, 5 if small else 20, seed, first=first, last=last)
            del train, y, test
            columns = [ids, pa.array([f] * len(p), read.fold_type), pa.array(np.full(len(p), first, np.int32)), pa.array(p)]
            yield pa.RecordBatch.from_arrays(columns, [record_id, fold, "__first", "probability"])

    dealt = rows.withColumn("__k", F.explode(F.array(*map(F.lit, range(len(work)))))).repartitionById(len(work), "__k")
    schema = T.StructType([id_kind, fold_kind, T.StructField("__first", T.IntegerType()), T.StructField("probability", T.DoubleType())])
    made = dealt.mapInArrow(run, schema)
    if kind == "GB":
        return cut(made.drop("__first"), "estimadas")
    parts = F.array_sort(F.collect_list(F.struct("__first", "probability")))  # one for each task that had a share of the fold's trees
    whole = made.groupBy(record_id, fold).agg(F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["probability"]), 6).alias("probability"))
    return cut(whole, "estimadas")


def tree_shares(folds: int, trees: int, cores: int) -> list[list[tuple[int, int, int]]]:
    """Per task (fold, first tree, tree after its last): all folds' trees dealt evenly to a task a core, from one to four tasks a fold."""
    tasks = min(max(folds, cores), 4 * folds)
    edges = [folds * trees * k // tasks for k in range(tasks + 1)]
    return [[(f, max(a - f * trees, 0), min(b - f * trees, trees)) for f in range(folds) if a < (f + 1) * trees and b > f * trees] for a, b in zip(edges, edges[1:])]


def without_outcomes(df: DataFrame, forbidden: set[str]) -> DataFrame:
    """df itself; raises ValueError if it has a column that knows the outcome."""
    if leaks := forbidden & set(df.columns):
        raise ValueError(f"columns that know the outcome: {sorted(leaks)}")
    return df


def disjoint_folds(cases: DataFrame, unit: str, fold: str) -> DataFrame:
    """Units that lie in more than one fold; must be empty."""
    return cases.groupBy(unit).agg(F.min(fold).alias("a"), F.max(fold).alias("b")).where("a < b").select(unit)


def matrix_size(pairs: DataFrame, lists: DataFrame, cases: DataFrame, record_id: str) -> DataFrame:
    """Per list: columns, ones, cases with any code and density of the case x code matrix."""
    total = cases.agg(F.count(F.lit(1)).alias("t"))
    cols = lists.groupBy("list").agg(F.count(F.lit(1)).alias("columns"))
    hits = pairs.join(lists, ["block", "level", "code"]).groupBy("list", record_id).agg(F.count(F.lit(1)).alias("k"))
    g = hits.groupBy("list").agg(F.sum("k").alias("ones"), F.count(F.lit(1)).alias("cases_with_code"))
    return cols.join(g, "list", "left").select("list", "columns", F.coalesce("ones", F.lit(0)).alias("ones"), F.coalesce("cases_with_code", F.lit(0)).alias("cases_with_code"),
                                              F.round(F.coalesce("ones", F.lit(0)) / (F.col("columns") * total.scalar()), 6).alias("density"))


def training_grid(outcomes: list[str], kinds: list[str], lists: list[str], done: set[tuple] = frozenset()) -> list[tuple[str, str, str, bool]]:
    """(outcome, model, list, weighted) still to be trained; combinations in `done` are passed over, which resumes a run."""
    return [c for o in outcomes for k in kinds for x in lists for w in (False, True) if (c := (o, k, x, w)) not in done]
