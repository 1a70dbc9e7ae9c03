from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortia.llm import mixing

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)]


def sized(spark, n=4000):
    rows = [(i, "abc"[i % 3] if i % 3 < 2 or i % 12 == 2 else None, 10 + i % 7, "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, copias string")


def test_shares_caps_and_report(spark):
    df = sized(spark)
    mix = mixing.mix_sources(df, "doc_id", "source", TARGETS)
    took = Counter()
    for r in mix.collect():
        assert 1 <= r["copias"] <= dict((s, c) for s, _, c in TARGETS)[r["source"]]
        took[r["source"]] += r["tokens"] * r["copias"]
    total = sum(took.values())
    there = {r["source"]: r["t"] for r in df.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert abs(total - min(c * there[s] / w for s, w, c in TARGETS)) < 60
    for s, w, _ in TARGETS:
        assert abs(took[s] - w * total) < 40
    goals = spark.createDataFrame(TARGETS, "source string, peso_objetivo double, max_repeticiones int")
    report = {r["source"]: r for r in mixing.mix_report(df, mix, "source", goals).collect()}
    assert {s: report[s]["tokens_mezcla"] for s in took} == dict(took)
    again = mixing.mix_sources(df.repartition(5), "doc_id", "source", TARGETS)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mix.collect()))


def test_unequal_probabilities(spark):
    rows = [(i, "a", 10, 0.5 if i % 2 else 1.0) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, w double")
    mix = mixing.mix_sources(df, "doc_id", "source", [("a", 1.0, 1)], weight="w", total=18_000).collect()
    assert abs(len(mix) - 1800) <= 1  # fixed size: 1800 documents of 10 tokens
    odd = sum(r["doc_id"] % 2 for r in mix)
    assert abs(odd / len(mix) - 1 / 3) < 0.05


def test_weights_at_the_cap(spark):
    rows = [(i, "a", 10, 100.0 if i < 100 else 1.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, w double")
    mix = {r["doc_id"]: r["copias"] for r in mixing.mix_sources(df, "doc_id", "source", [("a", 1.0, 2)], weight="w", total=6_500).collect()}
    assert all(mix[i] == 2 for i in range(100)) and abs(sum(mix.values()) - 650) <= 1


def test_whole_copies_and_missing_sources(spark):
    rows = [(i, "a", 5) for i in range(10)] + [(100, "z", 5), (101, None, 5), (102, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    mix = {r["doc_id"]: r["copias"] for r in mixing.mix_sources(df, "doc_id", "source", [("a", 0.5, 2), ("gone", 0.5, 3)]).collect()}
    assert mix == {i: 2 for i in range(10)}
    assert mixing.mix_sources(df.limit(0), "doc_id", "source", TARGETS).count() == 0


def test_ties_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a", 5)] * 40 + [(2, "a", 5)] * 40, "doc_id bigint, source string, tokens bigint")
    mix = mixing.mix_sources(df, "doc_id", "source", [("a", 1.0, 1)], total=200).collect()
    assert sum(r["tokens"] * r["copias"] for r in mix) == 200


def test_tokens(spark):
    try:
        own = mixing.encoding(mixing.vocabulary_file())
    except OSError:
        pytest.skip("the vocabulary files are not here")
    texts = ["", None, "hola mundo", "<|endoftext|>", "a " * 30_000, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["tokens"] for r in mixing.count_tokens(df, "text", ["doc_id"]).collect()}
    assert got == {i: len(own.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert own.decode(own.encode_ordinary("niño ￿ 12")) == "niño ￿ 12"
