from pyspark.sql import functions as F

from cohortia.operators import references as R

REFS = [("h", "A", 10, 1), ("h", "A", 99, 2), ("h", "B", 5, 3), ("h", "C", None, 4), ("h", "Z", None, 5), ("h", "A", 10, 1)]
SPANS = [("h", "A", 0, 50), ("h", "A", 0, 50), ("h", "C", 3, 4), ("g", "B", None, None)]


def ids(state):
    return sorted(r["id"] for r in state.pending.collect())


def frames(spark):
    return spark.createDataFrame(REFS, R.REF), spark.createDataFrame(SPANS, R.SPAN)


def test_one_batch(spark):
    refs, spans = frames(spark)
    s = R.advance(R.empty_state(spark), refs, spans)
    assert ids(s) == [2, 3, 5]  # repeated references stay, a missing day takes any span, another field's code doesn't count
    assert {(r["campo"], r["anio"], r["pendientes"]) for r in R.snapshot(s).collect()} == {("h", 1970, 2), ("h", None, 1)}


def test_late_parents_and_deletions(spark):
    refs, spans = frames(spark)
    s = R.advance(R.empty_state(spark), refs)
    assert ids(s) == [1, 1, 2, 3, 4, 5]
    s = R.advance(s, arrived=spans)
    assert ids(s) == [2, 3, 5]
    s = R.advance(s, removed=spark.createDataFrame([("h", "A", 0, 50)], R.SPAN))
    assert ids(s) == [1, 1, 2, 3, 5]
    s = R.advance(s, arrived=spark.createDataFrame([("h", "A", None, None)], R.SPAN))
    assert ids(s) == [3, 5]


def test_state_is_taken_up_again(spark, tmp_path):
    refs, spans = frames(spark)
    R.store(R.advance(R.empty_state(spark), refs), f"{tmp_path}/one")
    s = R.store(R.advance(R.load_state(spark, f"{tmp_path}/one"), arrived=spans), f"{tmp_path}/two")
    assert ids(s) == [2, 3, 5] and sorted(r["id"] for r in s.settled.collect()) == [1, 1, 4]
    gone = spark.createDataFrame([("h", "C", 3, 4), ("h", "nothing", 1, 2)], R.SPAN)
    assert ids(R.advance(R.load_state(spark, f"{tmp_path}/two"), removed=gone)) == [2, 3, 4, 5]
    both = R.advance(s, arrived=spark.createDataFrame([("h", "Z", 1, 2)], R.SPAN), removed=spark.createDataFrame([("h", "Z", 1, 2)], R.SPAN))
    assert ids(both) == [2, 3, 5]


def test_shuffled_probe_equals_broadcast(spark):
    refs, spans = frames(spark)
    a = R.probe(refs, spans).collect()
    b = R.probe(refs, spans, broadcast_rows=0).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_long_form_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x", "kept apart")], "id_egreso int, d date, c string, campo string")
    assert R.references(df, "id_egreso", F.col("d"), {"c": F.col("c"), "n": F.lit(None).cast("string")}).collect() == [("c", "x", None, 1)]
    refs, spans = frames(spark)
    assert ids(R.advance(R.empty_state(spark), refs.limit(0), spans)) == []
    assert ids(R.advance(R.empty_state(spark), refs, spans.limit(0))) == [1, 1, 2, 3, 4, 5]


def test_stream(spark, tmp_path):
    from cohortia.streaming.orphans import pending_stream

    schema = "campo string, codigo string, tipo string, dia int, hasta int"
    batches = [[("h", "A", "REF", 10, None), ("h", "A", "REF", 99, None)], [("h", "A", "ALTA", 0, 50)], [("h", "A", "BAJA", 0, 50)]]
    seen = []
    (tmp_path / "in").mkdir()
    stream = pending_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, i: seen.extend(r["pendientes"] for r in df.collect())).start()
    try:
        for i, b in enumerate(batches):
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [2, 1, 2]
