import random

import numpy as np
import pytest

from cohortia.llm import reading_level as R

BANK = {
    1: ["Coma pan.", "Use ropa limpia.", "Me duele el pie.", "Tome agua hoy.", "Venga el lunes."],
    2: ["El equipo decidió cambiar la venda otra vez.", "Cuando hay dolor conviene avisar a la familia.", "Mi martes empezó con fiebre y tos en casa."],
    3: ["El paciente ingresa por neumonía adquirida con descenso de los parámetros inflamatorios.", "Se inicia antibioticoterapia endovenosa hasta completar el estudio indicado."],
    4: ["La caracterización epidemiológica retrospectiva desaconseja categóricamente la interpretación probabilística de las estimaciones institucionales, independientemente de la disponibilidad presupuestaria.", "La interoperabilidad semántica compromete significativamente la identificación inequívoca de complicaciones posoperatorias, requiriéndose evaluaciones multidisciplinarias complementarias."],
}


def make(rng, level):
    body = [rng.choice(BANK[level]) for _ in range(rng.randrange(6, 15))]
    body.insert(rng.randrange(len(body)), rng.choice(BANK[rng.choice([1, 2, 3, 4])]))  # one sentence of any level
    text = " ".join(body)
    return text.lower().replace(".", "") if rng.random() < 0.3 else text


def corpus(spark, n=400):
    rng = random.Random(6)
    truth = {i: rng.choice([1, 2, 3, 4]) for i in range(n)}
    docs = [(i, make(rng, lv), "x") for i, lv in truth.items()] + [(9001, None, "x"), (9002, "", "x"), (9003, "12 34 ...", "x"), (9004, make(rng, 4) * 2000, "x")]
    labels = [(i, lv if rng.random() > 0.05 or lv == 4 else max(1, min(3, lv + 1)), 1) for i, lv in truth.items() if i % 3 == 0]
    labels += [(i, lv, 2) for i, lv, _ in labels[:10]] + [(9001, 2, 1), (77_777, 1, 1), (3, None, 1), (None, 2, 1)]
    return truth, spark.createDataFrame(docs, "doc_id bigint, text string, nivel string"), spark.createDataFrame(labels, "doc_id bigint, nivel int, revisor int")


def test_held_out_accuracy(spark):
    truth, docs, labels = corpus(spark)
    got = {r["doc_id"]: r["nivel"] for r in R.reading_levels(docs, "doc_id", "text", labels, "doc_id", "nivel").collect()}
    held = [i for i in truth if i % 3]
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.9
    assert all((got[i] == 4) == (truth[i] == 4) for i in held)
    assert (got[9001], got[9002], got[9003], got[9004]) == (None, None, None, 4) and len(got) == len(truth) + 4


def test_held_out_labels_of_the_tables(spark):
    """Two of five labelled documents of the generated tables are held out, by a hash of the id."""
    import os

    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("the generated tables are not here")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "etiquetas_lectura"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) < 2
    got = R.reading_levels(docs, "doc_id", "text", labels.where(~held), "doc_id", "nivel").withColumnRenamed("nivel", "p")
    pairs = [(r["nivel"], r["p"]) for r in labels.where(held & F.col("nivel").isNotNull()).join(got, "doc_id").where("p IS NOT NULL").collect()]
    hardest = {(a == 4, b == 4) for a, b in pairs}
    assert len(pairs) > 300 and sum(a == b for a, b in pairs) / len(pairs) > 0.92
    wrong = sum((a == 4) != (b == 4) for a, b in pairs)
    assert (True, True) in hardest and wrong <= 0.02 * sum(a == 4 for a, _ in pairs) + 1


def test_empty_and_unusable_labels(spark):
    _, docs, labels = corpus(spark, 30)
    assert R.reading_levels(docs.limit(0), "doc_id", "text", labels.limit(0), "doc_id", "nivel").count() == 0
    with pytest.raises(ValueError):
        R.reading_levels(docs, "doc_id", "text", labels.limit(0), "doc_id", "nivel")


def test_column_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.integers(1, 300, 200).astype(float), rng.normal(size=(200, len(R.FEATURES)))])
    y = np.digitize(x[:, 1] * 2 + x[:, 2], [-1, 0, 1]) + 1
    m = R.fit_ordinal(x, y)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, f array<double>")
    got = [r["k"] for r in df.select("i", m.level(F.col("f")).alias("k")).orderBy("i").collect()]
    assert got == m.predict(x).tolist() and (m.predict(x) == y).mean() > 0.85
    assert list(m.cuts) == sorted(m.cuts)
