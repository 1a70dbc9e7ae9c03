import random
from collections import Counter

import pytest

from cohortia.functions.text import read_plain
from cohortia.llm import frequency

D, P = ["d1", "d2", "d3", "d4"], ["p1", "p2"]
SCHEMA = ", ".join(f"{c} string" for c in [*D, *P, "n", "bloque"])


def brute(rows, depth):
    occ, rec = Counter(), Counter()
    for r in rows:
        for block, part in (("D", r[:4]), ("P", r[4:6])):
            codes = [c for c in map(read_plain, part) if c]
            own = [(block, tuple(codes[i : i + n])) for n in range(1, depth + 1) for i in range(len(codes) - n + 1)]
            occ.update(own)
            rec.update(set(own))
    return {k: (occ[k], rec[k]) for k in occ}


@pytest.mark.parametrize("block_rows", [7, 100_000])
@pytest.mark.parametrize("depth", [1, 3, 4])
def test_against_brute_force(spark, depth, block_rows):
    rng = random.Random(depth)
    rows = [tuple(rng.choice(["a", " A", "b", "c", "ignorado", "", None]) for _ in range(6)) + ("x", "y") for _ in range(150)]
    rows += [("a", "a", "a", "a", None, None, "x", "y")] * 3 + [(None,) * 8, ("a" * 5000, None, None, None, "ñ", "Ñ", "x", "y")]
    got = {(r["bloque"], tuple(r["ngrama"])): (r["ocurrencias"], r["registros"]) for r in frequency.ngram_counts(spark.createDataFrame(rows, SCHEMA), {"D": D, "P": P}, depth, block_rows=block_rows).collect()}
    assert got == brute(rows, depth)


def test_marks_and_empty(spark):
    counts = spark.createDataFrame([("r", 4), ("m", 5), ("c", 5), ("none", 0)], "codigo string, registros bigint")
    total = spark.createDataFrame([(125,)], "n bigint")
    got = {r["codigo"]: r["marcas"] for r in frequency.mark_frequencies(counts, total).collect()}
    assert got == {"r": ["RARO"], "m": [], "c": [], "none": ["RARO"]}  # 5 of 125 is 4 %, which isn't above it
    tiny = {r["codigo"]: r["marcas"] for r in frequency.mark_frequencies(counts, spark.createDataFrame([(50,)], "n bigint")).collect()}
    assert tiny["r"] == ["RARO", "COMUN"] and tiny["m"] == ["COMUN"]
    assert frequency.ngram_counts(spark.createDataFrame([], SCHEMA), {"D": D}, 2).count() == 0


def test_single_codes_are_the_first_intervals_of_the_whole_array(spark):
    rng = random.Random(3)
    rows = [tuple(rng.choice(["a", "b", "c", None]) for _ in range(6)) + ("x", "y") for _ in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {(r["bloque"], tuple(r["ngrama"])): (r["ocurrencias"], r["registros"]) for r in frequency.ngram_counts(df, {"D": D, "P": P}).collect()}
    single = {(r["bloque"], tuple(r["ngrama"])): (r["ocurrencias"], r["registros"]) for r in frequency.ngram_counts(df, {"D": D, "P": P}, lengths=(1,)).collect()}
    assert whole == brute(rows, 4) and single == {k: v for k, v in whole.items() if len(k[1]) == 1}
