"""References to records that do not exist, kept as incremental state."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.operators.skew import sized_join
from cohortia.session import cut

REF = "campo string, codigo string, dia int, id bigint"
SPAN = "campo string, codigo string, desde int, hasta int"


def references(df: DataFrame, record_id: str, day: Column, fields: dict[str, Column]) -> DataFrame:
    """Long form (campo, codigo, dia, id) of several reference columns; a missing code refers to nothing."""
    each = F.array(*(F.struct(F.lit(k).alias("campo"), c.alias("codigo")) for k, c in fields.items()))
    return df.select(F.col(record_id).alias("id"), F.unix_date(day).alias("dia"), F.inline(each)).where(
        F.col("codigo").isNotNull()
    ).select("campo", "codigo", "dia", "id")


def spans(df: DataFrame, field: str, code: Column, since: str, until: str) -> DataFrame:
    """Parents as validity spans, both days included; a missing bound is open."""
    return df.select(
        F.lit(field).alias("campo"), code.alias("codigo"), F.unix_date(since).alias("desde"), F.unix_date(until).alias("hasta")
    ).where(F.col("codigo").isNotNull())


@dataclass
class OrphanState:
    """parents: the index of valid spans; pending: references without a parent; settled: the others, kept so that
    a deletion can reopen them. fresh: those of settled that no store() has written yet; rewritten: a deletion has changed
    settled itself."""

    parents: DataFrame
    pending: DataFrame
    settled: DataFrame | None
    fresh: DataFrame | None = None
    rewritten: bool = False

    def all_settled(self) -> DataFrame | None:
        parts = [t for t in (self.settled, self.fresh) if t is not None]
        return reduce(DataFrame.unionByName, parts) if parts else None


def empty_state(spark: SparkSession) -> OrphanState:
    none = lambda schema: spark.range(0).select(F.from_json(F.lit(None).cast("string"), schema).alias("x")).select("x.*")
    return OrphanState(none(SPAN), none(REF), none(REF))


def probe(refs: DataFrame, parents: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """refs with `hallado`: whether a span of the code holds on the day; without a day any span will do.

    The index has one row per code, with its distinct spans. The spans are counted first: up to broadcast_rows of them are
    broadcast, so that the references aren't shuffled; a larger index is joined by shuffle, with codes that
    hold at least 1/64 of the references salted.
    """
    index = parents.groupBy("campo", "codigo").agg(F.collect_set(F.struct("desde", "hasta")).alias("__spans"))
    joined = sized_join(refs, index, ["codigo", "campo"], broadcast_rows=broadcast_rows, size=parents.count())
    inside = lambda s: (s["desde"].isNull() | (F.col("dia") >= s["desde"])) & (s["hasta"].isNull() | (F.col("dia") <= s["hasta"]))
    found = F.when(F.col("__spans").isNull(), False).when(F.col("dia").isNull(), True).otherwise(F.exists("__spans", inside))
    return joined.select("campo", "codigo", "dia", "id", found.alias("hallado"), F.col("__spans").isNotNull().alias("conocido"))


def _without(spans: DataFrame, removed: DataFrame) -> DataFrame:
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("campo", "codigo", "desde", "hasta")]
    return spans.alias("p").join(removed.alias("r"), same, "left_anti")


def advance(
    state: OrphanState,
    new_refs: DataFrame | None = None,
    arrived: DataFrame | None = None,
    removed: DataFrame | None = None,
    keep_settled: bool = True,
) -> OrphanState:
    """The state after one batch.

    New references probe the index with the arrived spans. Waiting orphans meet the arrived spans only, as all others have
    failed them before. Removed spans (compared as whole rows, missing bounds equal; what arrives and leaves in one batch
    leaves) drop out of the index, and the settled references to their codes are probed again. Each argument may be left out or
    empty. A repeated reference stays repeated, a repeated span counts once. With keep_settled=False settled
    references are forgotten, which is enough where nothing is ever removed.

    What a batch costs so depends on the batch and on the orphans waiting, not on all references seen. The result is a plan:
    store() writes it, so that plans don't grow and a run can go on where another ended.
    """
    coming = arrived if arrived is None or removed is None else _without(arrived, removed)
    parents = state.parents if coming is None else state.parents.unionByName(coming)
    pending, resolved = state.pending, None
    if coming is not None:
        met = probe(pending, coming)
        pending, resolved = _split(met)
    settled, fresh, rewritten = state.settled, state.fresh, state.rewritten
    if removed is not None:
        whole = state.all_settled()
        if whole is None:
            raise ValueError("without settled references a removal can't reopen any")
        parents = _without(parents, removed)
        codes = removed.select("campo", "codigo").distinct()
        lost, held = _split(probe(whole.join(codes, ["campo", "codigo"], "left_semi"), parents))
        pending = pending.unionByName(lost)
        settled, fresh, rewritten = whole.join(codes, ["campo", "codigo"], "left_anti").unionByName(held), None, True
    if new_refs is not None:
        waiting, held = _split(probe(new_refs, parents))
        pending = pending.unionByName(waiting)
        resolved = held if resolved is None else resolved.unionByName(held)
    if not keep_settled:
        settled = fresh = None
    elif resolved is not None:
        fresh = resolved if fresh is None else fresh.unionByName(resolved)
    return OrphanState(parents, pending, settled, fresh, rewritten)


def _split(tried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orphans, found) of probed references."""
    plain = lambda rows: rows.drop("hallado", "conocido")
    return plain(tried.where(~F.col("hallado"))), plain(tried.where("hallado"))


def store(state: OrphanState, folder: str | None = None) -> OrphanState:
    """The state, written and read back. Without a folder as cuts of this session, of which the settled references of earlier batches
    stay as they were written; with one as a whole, from which load_state() takes it up again."""
    if folder is None:
        known = state.settled
        if state.rewritten:
            known = cut(state.all_settled(), "settled")
        elif state.fresh is not None:
            new = cut(state.fresh, "settled")
            known = new if known is None else known.unionByName(new)
        return OrphanState(cut(state.parents, "parents"), cut(state.pending, "pending"), known)
    parts = {"parents": state.parents.distinct(), "pending": state.pending, "settled": state.all_settled()}
    for k, t in parts.items():
        if t is not None:
            t.write.parquet(f"{folder}/{k}")
    return load_state(state.pending.sparkSession, folder, parts["settled"] is not None)


def load_state(spark: SparkSession, folder: str, settled: bool = True) -> OrphanState:
    read = lambda k, schema: spark.read.schema(schema).parquet(f"{folder}/{k}")
    return OrphanState(read("parents", SPAN), read("pending", REF), read("settled", REF) if settled else None)


def snapshot(state: OrphanState) -> DataFrame:
    """(campo, anio, pendientes) of the orphans still pending; year null where the reference has no day."""
    return state.pending.groupBy("campo", F.year(F.date_from_unix_date("dia")).cast("int").alias("anio")).agg(
        F.count(F.lit(1)).alias("pendientes")
    )
