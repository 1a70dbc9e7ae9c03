"""Best representative of each group of duplicate records, by token-level consensus."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.functions.text import read_plain
from cohortia.session import cut

SEP = "\x1f"


@lru_cache(maxsize=200_000)
def read_cached(value: str | None) -> str | None:
    return read_plain(value)


Profile = list[dict[str, float]]


# ---------------------------------------------------------------- alignment of weighted profiles

def align(a: Profile, b: Profile) -> list[tuple[int, int]]:
    """Global alignment of two profiles as pairs of places, -1 for a gap.

    A pair of places scores by the share of weight on which they agree, from -1 to 2; a gap costs 1.
    """
    if not a or not b:
        return [(i, -1) for i in range(len(a))] + [(-1, j) for j in range(len(b))]
    if len(a) == len(b) and all(x.keys() == y.keys() for x, y in zip(a, b)):
        return [(i, i) for i in range(len(a))]
    sums_a, sums_b = [sum(x.values()) for x in a], [sum(y.values()) for y in b]
    rows = [[-float(j) for j in range(len(b) + 1)]]
    moves: list[list[int]] = []
    for i, x in enumerate(a):
        above, row, move = rows[-1], [-float(i + 1)], []
        for j, y in enumerate(b):
            shared = sum(w * y[t] for t, w in x.items() if t in y) / (sums_a[i] * sums_b[j])
            options = (above[j] + 3 * shared - 1, above[j + 1] - 1, row[j] - 1)
            best = max(range(3), key=options.__getitem__)
            row.append(options[best])
            move.append(best)
        rows.append(row)
        moves.append(move)
    i, j, path = len(a), len(b), []
    while i or j:
        step = moves[i - 1][j - 1] if i and j else (1 if i else 2)
        i, j = i - (step != 2), j - (step != 1)
        path.append((i if step != 2 else -1, j if step != 1 else -1))
    return path[::-1]


def merge_profiles(a: Profile, b: Profile) -> Profile:
    out: Profile = []
    for i, j in align(a, b):
        place = dict(a[i]) if i >= 0 else {}
        for t, w in (b[j] if j >= 0 else {}).items():
            place[t] = place.get(t, 0) + w
        out.append(place)
    return out


def consensus(profile: Profile, total: float) -> list[str]:
    """The token with most weight at each place, ties to the smaller. total is the weight of all records that fill the field: those with
    nothing at a place vote for a gap there, and where the gap outweighs every token the place is left out."""
    agreed = []
    for place in profile:
        token = min(place, key=lambda t: (-place[t], t))
        if place[token] >= total - sum(place.values()):
            agreed.append(token)
    return agreed


def distance(tokens: tuple[str, ...], agreed: list[str]) -> int:
    """Places of the alignment with the consensus at which the two differ: gaps on either side and other tokens."""
    if list(tokens) == agreed:
        return 0
    pairs = align([{t: 1.0} for t in agreed], [{t: 1.0} for t in tokens])
    return sum(i < 0 or j < 0 or agreed[i] != tokens[j] for i, j in pairs)


def seats(tokens: tuple[str, ...], profile: Profile) -> list[int]:
    """The places of a record whose tokens are part of the profile when it is laid on it: every token takes a place, in order, with
    the greatest weight agreed upon, then with fewest tokens outvoted."""
    m, n = len(tokens), len(profile)
    if m > n:
        raise ValueError("the profile doesn't hold the record")
    if m == n:
        return list(range(n))
    most = [(0.0, 0)] * (n + 1)  # (agreed weight, -outvoted) of the tokens so far in the first j places
    taken: list[list[bool]] = []
    for i, t in enumerate(tokens, 1):
        row, took = [(-1.0, 0)] * (n + 1), [False] * (n + 1)
        for j in range(i, n - m + i + 1):
            place = profile[j - 1]
            weight = place.get(t, 0.0)
            w, lost = most[j - 1]
            here = (w + weight, lost - (weight < max(place.values())))
            took[j] = j == i or here > row[j - 1]
            row[j] = here if took[j] else row[j - 1]
        most = row
        taken.append(took)
    out, j = [], n
    for took in reversed(taken):
        while not took[j]:
            j -= 1
        j -= 1
        out.append(j)
    return out[::-1]


def seat(tokens: tuple[str, ...], profile: Profile) -> tuple[int, int]:
    """(places left empty, tokens outvoted) of a record laid on the profile by seats()."""
    at = seats(tokens, profile)
    return len(profile) - len(at), sum(profile[j].get(t, 0.0) < max(profile[j].values()) for t, j in zip(tokens, at))


# ---------------------------------------------------------------- mergeable state of a group

def new_state(fields: list[str]) -> dict:
    return {"n": 0, "best": None, "fields": {f: {"profile": [], "weight": 0, "values": {}} for f in fields}}


def add_record(state: dict, values: dict[str, tuple[str, ...]], copies: int) -> None:
    """Lays the record's tokens on the profiles, with a weight that grows with what it fills."""
    weight = copies * (1.0 + sum(map(len, values.values())))
    state["n"] += copies
    for f, tokens in values.items():
        if not tokens:
            continue
        held = state["fields"][f]
        held["profile"] = merge_profiles(held["profile"], [{t: weight} for t in tokens])
        held["weight"] += weight
        key = SEP.join(tokens)
        held["values"][key] = held["values"].get(key, 0) + weight


def ranked_consensus(profiles: list[Profile], candidates: list[list]) -> list[list[str]]:
    """The consensus of each ranking field when every candidate votes at its places, gaps too, with more weight than all candidates
    together that fill less, field by field, or come after it by the tie-breaks."""
    order = sorted(candidates, key=lambda c: ([-len(t) for t in c[0]], c[1]), reverse=True)
    agreed = []
    for k, profile in enumerate(profiles[:len(candidates[0][0])]):
        votes: Profile = [{} for _ in profile]
        for i, (fields, _) in enumerate(order):
            for t, j in zip(fields[k], seats(fields[k], profile)):
                votes[j][t] = votes[j].get(t, 0) + (1 << i)
        agreed.append(consensus([v for v in votes if v], (1 << len(order)) - 1))
    return agreed


def choose(state: dict, candidates: list[list]) -> None:
    """best: of the candidates [tokens of each ranking field, tie-breaks], the one with the smallest edit distance to the
    consensus of ranked_consensus(), field by field, and then the least tie-breaks.

    One candidate a part of the group is enough: who outvotes its part either outvotes the other part's or is outvoted by it.
    """
    agreed = ranked_consensus([held["profile"] for held in state["fields"].values()], candidates)
    state["best"] = min(candidates, key=lambda c: ([distance(t, a) for t, a in zip(c[0], agreed)], c[1]))


def merge_states(a: dict, b: dict) -> dict:
    a["n"] += b["n"]
    for f, other in b["fields"].items():
        held = a["fields"][f]
        held["profile"] = merge_profiles(held["profile"], other["profile"])
        held["weight"] += other["weight"]
        for v, w in other["values"].items():
            held["values"][v] = held["values"].get(v, 0) + w
    choose(a, [a["best"], b["best"]])
    return a


def closest_values(state: dict) -> dict[str, list[str] | None]:
    """Per field the existing value that is closest to the consensus, then that with most weight, then the smaller. A field that no
    record fills stays missing."""
    out: dict[str, list[str] | None] = {}
    for f, held in state["fields"].items():
        agreed = consensus(held["profile"], held["weight"])
        ranked = ((distance(tuple(v.split(SEP)), agreed), -w, v) for v, w in held["values"].items())
        best = min(ranked, default=None)
        out[f] = best[-1].split(SEP) if best else None
    return out


# ---------------------------------------------------------------- the operator

def _micros(c: str) -> Column:
    """Microseconds of a timestamp with or without zone, in the order of its wall clock."""
    clock = F.hour(c) * 3600 + F.minute(c) * 60
    return F.unix_date(F.col(c).cast("date")).cast("bigint") * 86_400_000_000 + clock.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), F.col(c)) * 1_000_000).cast("bigint")


def representatives(
    df: DataFrame,
    record_id: str,
    keys: dict[str, Column],
    optional: tuple[str, ...],
    codes: dict[str, list[str]],
    words: dict[str, str],
    trust: str,
    recency: str,
    block: int = 512,
    salts: int = 8,
    broadcast_groups: int = 1_000_000,
    build: bool = True,
) -> DataFrame:
    """One row per group of two or more records with equal keys: the keys, `n` records, the `record_id` of the
    record that stays, and per field the value built for the group (array of tokens; null with build=False).

    Method: the values of a field are token sequences (codes: the filled numbered columns in order; words: the words
    of a text column). They are aligned progressively into a profile, and each token votes at its place with the weight
    of its record. Built values: records that have nothing at a place vote for a gap there, and the existing value closest to
    the consensus is emitted. The record that stays: the one closest to the consensus of a second vote on the same places, over
    the fields of `codes` in order. There a record outvotes all others together that fill fewer columns or, filling as many, have
    less `trust`, then an earlier `recency` (missing last in both), then a greater id. So it is the record with most columns
    filled, ties broken in that order.

    Scale: groups are found from key hashes alone, which is all that is shuffled of rows without a double. Up to
    broadcast_groups repeated hashes (two numbers each) are broadcast to the wide rows; beyond, both sides are joined by
    a salted shuffle. Exact copies are collapsed by a combined aggregate; a group's records are dealt to blocks of about
    `block`, one profile each, and profiles are merged level by level, never more than `block` in one task. Groups are
    compared by their keys in the end, so equal hashes do no harm.

    Keys not in `optional` must be present for a row to belong to a group; missing equals missing for the others.
    Values are read (trimmed, upper case, no-data words missing). Empty tables give no rows.
    """
    key_names = list(keys)
    packed = lambda cols: F.concat_ws(SEP, *(F.coalesce(F.col(c), F.lit("")) for c in cols))
    rows = df.select(
        F.col(record_id).alias("__id"),
        *(c.alias(k) for k, c in keys.items()),
        *(packed(cols).alias(f"__c{i}") for i, cols in enumerate(codes.values())),
        *(F.col(c).alias(f"__w{i}") for i, c in enumerate(words.values())),
        F.col(trust).cast("double").alias("__trust"),
        _micros(recency).alias("__recent"),
    )
    for k in key_names:
        if k not in optional:
            rows = rows.where(F.col(k).isNotNull())
    rows = rows.withColumn("__g", F.xxhash64(*key_names)).withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int"))
    groups = cut(rows.groupBy("__g").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), "grupos")
    if groups.count() <= broadcast_groups:
        members = rows.join(F.broadcast(groups), "__g")
    else:
        members = rows.join(groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["__g", "__salt"])

    fields = [*(f"__c{i}" for i in range(len(codes))), *(f"__w{i}" for i in range(len(words)))]
    latest = F.min(F.struct(F.coalesce(-F.col("__recent"), F.lit(2**62)).alias("late"), F.col("__id").alias("id")))
    variants = members.groupBy(*key_names, *fields, "__trust", "__n").agg(F.count(F.lit(1)).alias("copies"), latest.alias("first"))
    blocks = F.ceil(F.col("__n") / block).cast("bigint")
    dealt = variants.withColumn("bloques", blocks).withColumn("bloque", F.pmod(F.xxhash64("first.id"), "bloques"))
    listed = dealt.groupBy(*key_names, "bloques", "bloque").agg(
        F.collect_list(F.struct(*fields, "__trust", "copies", F.col("first.late").alias("late"), F.col("first.id").alias("id"))).alias("__rows")
    )
    names = [*codes, *words]
    result = T.ArrayType(T.StringType())
    base = [f for f in listed.schema.fields if f.name in (*key_names, "bloques", "bloque")]
    schema = T.StructType([*base, T.StructField("n", T.LongType()), T.StructField(record_id, T.LongType()), *(T.StructField(f, result) for f in names), T.StructField("__state", T.StringType())])
    n_codes = len(codes)

    def from_rows(rows_of_group: list[dict]) -> dict:
        state = new_state(names)
        read = []
        for r in rows_of_group:
            values = {}
            for f, column in zip(names, fields):
                raw = r[column]
                parts = [] if raw is None else raw.split(SEP) if column.startswith("__c") else (read_cached(raw) or "").split()
                values[f] = tuple(v for p in parts if (v := read_cached(p) if column.startswith("__c") else p))
            read.append((r, values))
        candidates = []
        for r, values in sorted(read, key=lambda x: (-sum(map(len, x[1].values())), x[0]["id"])):  # the fullest lead the alignment
            trusted = [1, 0.0] if r["__trust"] is None else [0, -r["__trust"]]
            add_record(state, values, r["copies"])
            candidates.append([[values[f] for f in names[:n_codes]], [*trusted, r["late"], r["id"]]])
        choose(state, candidates)
        return state

    def from_states(states: list[str]) -> dict:
        held = [json.loads(s) for s in sorted(states)]
        state = held[0]
        for other in held[1:]:
            state = merge_states(state, other)
        return state

    def runner(column: str, make):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = [batch.column(batch.schema.get_field_index(f.name)) for f in base]
                many = batch.column(batch.schema.get_field_index("bloques")).to_pylist()
                out: dict[str, list] = {k: [] for k in ("n", record_id, *names, "__state")}
                for i, value in enumerate(batch.column(batch.schema.get_field_index(column))):
                    state = make(value.as_py())
                    out["n"].append(state["n"])
                    out[record_id].append(state["best"][-1][-1])
                    whole = many[i] == 1
                    built = closest_values(state) if whole and build else dict.fromkeys(names)
                    for f in names:
                        out[f].append(built[f])
                    out["__state"].append(None if whole else json.dumps(state))
                kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.string())] * len(names), pa.string()]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, t) for v, t in zip(out.values(), kinds))], [*(f.name for f in base), *out])

        return run

    done = cut(listed.mapInArrow(runner("__rows", from_rows), schema), "consenso")
    whole = done.where("bloques = 1")
    rest = done.where("bloques > 1")
    while rest.limit(1).count():
        fewer = rest.groupBy(*key_names, F.ceil(F.col("bloques") / block).cast("bigint").alias("bloques"), F.pmod("bloque", F.ceil(F.col("bloques") / block)).cast("bigint").alias("bloque")).agg(F.collect_list("__state").alias("__states"))
        done = cut(fewer.mapInArrow(runner("__states", from_states), schema), "consenso")
        whole, rest = whole.unionByName(done.where("bloques = 1")), done.where("bloques > 1")
    return whole.where("n > 1").drop("bloques", "bloque", "__state")
