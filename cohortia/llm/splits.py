"""Splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.session import cut, drop_cut


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60, hot_share: int = 64) -> DataFrame:
    """(nodo, grupo): connected components of the links, grupo being the least node of the component.

    Hash-to-min. Every node holds a cluster of nodes, at first itself and its neighbours. In each round a node
    sends its whole cluster to the cluster's least node, and that least node to all members; a node's next
    cluster is what it received. It ends when nothing changes, after a number of rounds logarithmic in the
    diameter; the least node of a component then holds it whole and all others hold the least node.

    Clusters are rows (nodo, miembro), never collected values, so a component may hold a third of all nodes. A
    node with at least 1/hot_share of all rows is hot; there are at most hot_share of them, so their minima are
    broadcast and only the other nodes' rows are joined by shuffle. Each round is written to the shared folder.

    Links with a missing end count for nothing; repeated links, either order and links of a node with itself
    do no harm. Nodes without links don't occur. An empty table gives no rows.
    """
    ends = links.select(F.col(a).alias("nodo"), F.col(b).alias("miembro")).where("nodo IS NOT NULL AND miembro IS NOT NULL")
    both = ends.select(F.inline(F.array(F.struct("nodo", "miembro"), F.struct(F.col("miembro").alias("nodo"), F.col("nodo").alias("miembro")),
                                        F.struct("nodo", F.col("nodo").alias("miembro")), F.struct(F.col("miembro").alias("nodo"), "miembro"))))
    clusters = cut(both.distinct(), "hashtomin")
    seen = _signature(clusters)
    for _ in range(max_rounds):
        least = clusters.groupBy("nodo").agg(F.min("miembro").alias("menor"), F.count(F.lit(1)).alias("n"))
        hot = [r["nodo"] for r in least.where(F.col("n") * hot_share >= max(seen[0], 10_000)).select("nodo").collect()]
        is_hot = F.col("nodo").isin(hot) if hot else F.lit(False)
        joined = clusters.where(~is_hot).join(least.drop("n"), "nodo")
        if hot:
            joined = joined.unionByName(clusters.where(is_hot).join(F.broadcast(least.drop("n").where(is_hot)), "nodo"))
        sent = joined.select(F.inline(F.array(F.struct(F.col("menor").alias("nodo"), "miembro"), F.struct(F.col("miembro").alias("nodo"), F.col("menor").alias("miembro")))))
        new = cut(sent.distinct(), "hashtomin")
        now = _signature(new)
        drop_cut(clusters)
        clusters = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    return clusters.groupBy("nodo").agg(F.min("miembro").alias("grupo"))


def _signature(clusters: DataFrame) -> tuple:
    """Row count and order-free content hash; two rounds with equal signatures hold the same rows."""
    r = clusters.agg(F.count(F.lit(1)), F.sum(F.xxhash64("nodo", "miembro").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("miembro", "nodo"))).first()
    return tuple(r)


def group_of(ids: DataFrame, column: str, groups: DataFrame) -> DataFrame:
    """ids with `grupo`: the component of the identifier, or the identifier itself where it has no links."""
    found = ids.join(groups.withColumnRenamed("nodo", column), column, "left")
    return found.withColumn("grupo", F.coalesce("grupo", F.col(column)))


def torn_groups(registered: DataFrame, column: str, label: str, groups: DataFrame) -> DataFrame:
    """(column, grupo) of every identifier in registered whose group has rows under more than one label.

    Rows are first reduced to distinct (identifier, label); per group only the least and the greatest label are
    kept, so a huge group is two values. A missing label counts for nothing, a missing identifier is no case.
    """
    held = registered.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(label).alias("__lo"), F.max(label).alias("__hi"))
    named = group_of(held, column, groups)
    torn = named.groupBy("grupo").agg(F.min("__lo").alias("__a"), F.max("__hi").alias("__b")).where("__a < __b").select("grupo")
    return named.join(torn, "grupo", "left_semi").select(column, "grupo")


def rendezvous(group: str, weights: list[tuple[str, float]], seed: str = "conjunto"):
    """Column: the label chosen for the group by weighted rendezvous hashing.

    Each label scores -ln(u)/weight with u a hash of (seed, label, group) in (0, 1); the least score wins, so
    label s is chosen with probability weight_s / sum, and adding a label moves only the groups it takes.
    """
    def score(label: str, weight: float):
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(label), F.col(group).cast("string"))), 1, 12), 16, 10).cast("double")
        return -F.ln((h + 0.5) / F.lit(float(16**12))) / F.lit(float(weight))

    live = sorted((s, w) for s, w in weights if w > 0)
    if not live:
        raise ValueError("no label has a positive weight")
    return F.array_min(F.array(*(F.struct(score(s, w).alias("k"), F.lit(s).alias("v")) for s, w in live)))["v"]


def assign_splits(rows: DataFrame, group: str, targets: list[tuple[str, float]]) -> DataFrame:
    """rows with `conjunto`: every group in one set, by weighted rendezvous hashing with the targets as weights.

    A group's set depends on its name, the sets and their weights alone: adding rows or groups moves no other, at any size. The
    expected shares are the targets; a group with a tenth of all rows falls as it falls, so the reached shares belong into a report.
    Where they matter more than stability, balanced_splits deals large groups by room. A missing group gets a null set.
    """
    return rows.withColumn("conjunto", F.when(F.col(group).isNotNull(), rendezvous(group, targets)))


def balanced_splits(rows: DataFrame, group: str, targets: list[tuple[str, float]], heavy_share: int = 500) -> DataFrame:
    """Like assign_splits, but the sets' shares of rows come near the targets even where single groups are large.

    Groups with at least 1/heavy_share of all rows, of which there are at most heavy_share, are dealt first, largest first, each by
    rendezvous hashing over what the sets still lack; the other groups are hashed with the rest as weights. A group's set so
    depends on the large groups too.
    """
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(sizes, "grupos")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    goal = sum(w for _, w in targets)
    left = {s: w / goal * total for s, w in targets}
    heavy = sizes.where(F.col("n") * heavy_share >= total).orderBy(F.desc("n"), group).collect()
    fixed: list[tuple[str, str]] = []
    spark = rows.sparkSession
    for r in heavy:
        room = [(s, q - r["n"]) for s, q in left.items() if q - r["n"] > 0] or [max(left.items(), key=lambda x: x[1])]
        label = _rendezvous_py(str(r[group]), room)
        left[label] -= r["n"]
        fixed.append((r[group], label))
    rest = [(s, max(q, 0.0)) for s, q in left.items()]
    if not any(w > 0 for _, w in rest):
        rest = targets
    chosen = F.when(F.col(group).isNotNull(), rendezvous(group, rest))
    if not fixed:
        return rows.withColumn("conjunto", chosen)
    kind = rows.select(group).schema[0].dataType.simpleString()
    known = spark.createDataFrame(fixed, f"{group} {kind}, __fijo string")
    return rows.join(F.broadcast(known), group, "left").withColumn("conjunto", F.coalesce("__fijo", chosen)).drop("__fijo")


def _rendezvous_py(key: str, weights: list[tuple[str, float]], seed: str = "conjunto") -> str:
    import hashlib
    import math

    def score(s: str, w: float) -> float:
        h = int(hashlib.md5(f"{seed}|{s}|{key}".encode()).hexdigest()[:12], 16)
        return -math.log((h + 0.5) / 16**12) / w

    return min((score(s, w) if w > 0 else math.inf, s) for s, w in weights)[1]
