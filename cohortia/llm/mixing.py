"""Mixing sources to target weights, measured in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cohortia.session import cut

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern with which that vocabulary's texts are cut into pieces before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_file(tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> bytes:
    with open(f"{tokenizers}/{vocabulary}", "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, text: str, keep: list[str], tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """keep columns and `tokens`, the number of tokens of the whole text; a missing text has 0.

    The vocabulary file is read where the driver runs and sent with the job, so executors need no copy of it.
    """
    rows = docs.select(*keep, F.col(text).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_file(tokenizers, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(sent.value)
        for b in batches:
            sizes = [len(own.encode_ordinary(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sizes, pa.int64())], [*keep, "tokens"])

    schema = rows.drop("__text").schema.add("tokens", LongType())
    return rows.mapInArrow(run, schema)


def plan_mix(available: dict[str, float], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens to take from each source: target share of the total, which is the largest that no source's cap
    prevents, or `total` if that is smaller. Sources without tokens can give nothing; the other shares are scaled to
    sum to 1."""
    live = [(s, w, r) for s, w, r in targets if available.get(s, 0) > 0 and w and w > 0 and r and r > 0]
    scale = sum(w for _, w, _ in live)
    if not live:
        return {}
    reach = min(r * available[s] / (w / scale) for s, w, r in live)
    size = reach if total is None else min(reach, total)
    return {s: w / scale * size for s, w, _ in live}


def mix_sources(
    sized: DataFrame, doc_id: str, source: str, targets: list[tuple[str, float, int]],
    weight: str | None = None, total: float | None = None, seed: int = 42, buckets: int = 4096,
) -> DataFrame:
    """sized (doc_id, source, tokens[, weight]) with `copias`: how often each document enters the mix, 0 rows left out.

    Expected copies of a document are rate * weight, with the source's rate such that its expected tokens equal its
    quota; no document exceeds the source's cap. The whole part is certain. The rest is the inclusion
    probability p of Pareto order sampling: documents are ranked by odds(u) / odds(p), u being a hash of the
    id in (0, 1), and taken in that order until the source's quota of tokens is met, which fixes the size of the
    sample whatever the order brings.

    The place where a quota is met is found without sorting a source: tokens are summed per bucket of the ranking
    variable (at most `buckets` rows a source), and only the one bucket in which the quota falls is put in order.
    A source with nearly all rows is spread over all tasks up to there.

    Sources missing from the targets, missing sources and documents without tokens don't enter; a missing weight is
    1 and a weight must not be negative. Repeated ids are documents of their own with one u. An empty table gives
    no rows.
    """
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    rows = sized.where(F.col("tokens") > 0).select(doc_id, source, "tokens", w.alias("__w")).where("__w > 0")
    available = {r[0]: float(r[1]) for r in rows.groupBy(source).agg(F.sum("tokens")).where(F.col(source).isin([t[0] for t in targets])).collect()}
    quota = plan_mix(available, targets, total)
    if not quota:
        return rows.limit(0).select(doc_id, source, "tokens", F.lit(0).cast("int").alias("copias"))
    caps = {s: float(r) for s, _, r in targets}
    rate = _rates(rows, source, quota, caps, available if weight is None else None)

    spark = sized.sparkSession
    plan = F.broadcast(spark.createDataFrame([(s, rate[s], caps[s], q) for s, q in quota.items()], "__s string, __rate double, __cap double, __quota double"))
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    expected = F.least(F.col("__rate") * F.col("__w"), F.col("__cap"))
    dealt = rows.join(plan, F.col(source) == F.col("__s")).withColumn("__sure", F.floor(expected + 1e-9).cast("int")).withColumn("__p", F.greatest(expected - F.col("__sure"), F.lit(0.0)))
    ranked = dealt.withColumn("__x", F.when(F.col("__p") > 1e-9, (F.lit(u) / (1 - u)) / (F.col("__p") / (1 - F.col("__p")))))
    ranked = cut(ranked.withColumn("__b", F.floor(F.col("__x") / (1 + F.col("__x")) * buckets).cast("int")), "mezcla")

    certain = ranked.groupBy("__s").agg(F.sum(F.col("tokens") * F.col("__sure")).alias("__certain"), F.first("__quota").alias("__quota"))
    sums = ranked.where(F.col("__b").isNotNull()).groupBy("__s", "__b").agg(F.sum("tokens").alias("__t"))
    upto = sums.withColumn("__upto", F.sum("__t").over(Window.partitionBy("__s").orderBy("__b")))
    need = certain.select("__s", (F.col("__quota") - F.col("__certain")).alias("__need"))
    edge = upto.join(need, "__s").where("__upto >= __need").groupBy("__s").agg(F.min_by(F.struct("__b", (F.col("__upto") - F.col("__t")).alias("before")), "__b").alias("__e"), F.first("__need").alias("__need"))
    placed = ranked.join(F.broadcast(edge), "__s", "left")
    below = F.col("__b").isNotNull() & (F.col("__e").isNull() | (F.col("__b") < F.col("__e.__b")))
    at_edge = F.col("__b") == F.col("__e.__b")
    order = Window.partitionBy("__s").orderBy("__x", doc_id, "tokens").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("__e.before") + F.sum("tokens").over(order) - F.col("tokens") / 2 <= F.col("__need")
    on_edge = placed.where(at_edge).withColumn("copias", F.col("__sure") + fits.cast("int"))
    others = placed.where(~F.coalesce(at_edge, F.lit(False))).withColumn("copias", F.col("__sure") + below.cast("int"))
    return others.unionByName(on_edge).where("copias > 0").select(doc_id, source, "tokens", "copias")


def _rates(rows: DataFrame, source: str, quota: dict[str, float], caps: dict[str, float], available: dict[str, float] | None) -> dict[str, float]:
    """Copies per unit of weight: tokens * min(rate * weight, cap) must add up to the quota. Documents at the cap are
    set aside and the rate of the others raised until no more reach it; one aggregate a round, few rounds."""
    if available is not None:
        return {s: q / available[s] for s, q in quota.items()}
    rate = dict.fromkeys(quota, 0.0)
    for _ in range(60):
        cases = F.lit(math.inf)
        for s, r in rate.items():
            cases = F.when(F.col(source) == s, F.lit(caps[s] / r if r else math.inf)).otherwise(cases)
        capped = F.col("__w") >= cases
        sums = rows.where(F.col(source).isin(list(quota))).groupBy(source).agg(
            F.sum(F.when(capped, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(~capped, F.col("tokens") * F.col("__w")).otherwise(0.0)).alias("rest")
        )
        new = {r[0]: max((quota[r[0]] - caps[r[0]] * r["full"]) / r["rest"], rate[r[0]]) if r["rest"] > 0 else math.inf for r in sums.collect()}
        if all(abs(new[s] - rate[s]) <= 1e-12 * max(1.0, new[s]) or new[s] == rate[s] for s in rate):
            break
        rate = new
    return {s: min(r, 1e300) for s, r in rate.items()}


def mix_report(sized: DataFrame, mix: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    """Per source of the targets: tokens there and taken, target and reached share, documents and most copies."""
    there = sized.groupBy(source).agg(F.sum("tokens").alias("tokens_disponibles"))
    took = mix.groupBy(source).agg(
        F.sum(F.col("tokens") * F.col("copias")).alias("tokens_mezcla"), F.count(F.lit(1)).alias("documentos"), F.max("copias").alias("repeticiones_maximas")
    )
    whole = took.agg(F.sum("tokens_mezcla").alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        targets.join(there, source, "left").join(took, source, "left")
        .select(
            source, "peso_objetivo", "max_repeticiones", zero("tokens_disponibles").alias("tokens_disponibles"), zero("tokens_mezcla").alias("tokens_mezcla"),
            zero("documentos").alias("documentos"), zero("repeticiones_maximas").alias("repeticiones_maximas"),
            (zero("tokens_mezcla") / whole.scalar()).alias("peso_logrado"),
            (zero("tokens_mezcla") / F.nullif("tokens_disponibles", F.lit(0))).alias("repeticiones_medias"),
        )
    )
