import random

from cohortia.llm import leakage as L


def brute(docs, items):
    runs = lambda t: {tuple(w[i : i + 12]) for w in [L.words_of(t)] for i in range(len(w) - 11)}
    own = {k: runs(t) for k, t in items}
    return {(d, k) for d, t in docs for k, r in own.items() if runs(t) & r}


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id bigint, text string, item_id int, puntaje string"), spark.createDataFrame(items, "item_id bigint, texto string")


def test_words():
    assert L.words_of("Ñandú, ACCIÓN / 2x ﬁn") == ["nandu", "accion", "2x", "fin"]
    assert L.words_of("acción") == L.words_of("acción") == ["accion"] and L.words_of(None) == L.words_of("") == []


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)] + ["niño", "café"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, make(rng.choice([5, 12, 13, 40]))) for k in range(12)]
    docs = []
    for i in range(150):
        words = make(rng.choice([0, 3, 30, 120]))
        _, own = rng.choice(items)
        a = rng.randrange(0, max(1, len(own) - 11))
        n = rng.choice([10, 11, 12, 20])
        part = [w.upper().replace("Ñ", "N").replace("É", "E") if i % 2 else w for w in own[a : a + n]]
        at = rng.randrange(0, len(words) + 1)
        docs.append((i, rng.choice([" ", " / ", "\n", ", "]).join(words[:at] + part + words[at:])))
    docs += [(500, None), (501, ""), (502, "solo"), (503, " ".join(make(20_000) + items[-1][1]))]
    texts = [(k, " ".join(w)) for k, w in items] + [(99, None), (98, "")]
    d, t = frames(spark, docs, texts)
    want = brute(docs, [(k, x) for k, x in texts if x])
    found = L.find_leaks(d, "doc_id", "text", t, "item_id", "texto", min_score=1)
    assert {(r["doc_id"], r["item_id"]) for r in found.where("racha >= 12").collect()} == want
    blocks = L.find_leaks(d, "doc_id", "text", t, "item_id", "texto", min_score=1, block_words=60)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.where("racha >= 12").collect()} == want


def test_edited_copy_scores(spark):
    item = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce"
    edited = item.replace("siete", "SIETE cambiado").replace("doce", "otro")
    d, t = frames(spark, [(1, f"antes {edited} despues"), (2, "nada que ver aqui")], [(7, item)])
    got = L.find_leaks(d, "doc_id", "text", t, "item_id", "texto").collect()
    assert [(r["doc_id"], r["item_id"], r["racha"]) for r in got] == [(1, 7, 7)] and got[0]["puntaje"] >= 22


def test_empty(spark):
    d, t = frames(spark, [(1, "a b c")], [(1, "a b c d e f g")])
    assert L.find_leaks(d.limit(0), "doc_id", "text", t, "item_id", "texto").count() == 0
    assert L.find_leaks(d, "doc_id", "text", t.limit(0), "item_id", "texto").count() == 0


def test_edited_copies_are_found_however_many(spark):
    item = [f"p{i}" for i in range(24)]
    edited = [w if i % 8 else f"otra{i}" for i, w in enumerate(item)]  # in every run of 12 words one is changed
    d, t = frames(spark, [(i, " ".join([f"a{i}", *edited, f"z{i}"])) for i in range(60)] + [(99, " ".join(edited[9:14]))], [(7, " ".join(item))])
    got = {r["doc_id"]: (r["puntaje"], r["racha"]) for r in L.find_leaks(d, "doc_id", "text", t, "item_id", "texto").collect()}
    assert got == {i: (2 * 21 - 2, 7) for i in range(60)}


def test_align_equals_row_by_row():
    rng = random.Random(4)
    make = lambda low, most: L.np.array([rng.randrange(low, 6) for _ in range(rng.randint(1, most))])
    items, parts = [make(0, 20) for _ in range(300)], [make(-1, 40) for _ in range(300)]
    assert list(zip(*(x.tolist() for x in L.align(items, parts)))) == [L.smith_waterman(a, b) for a, b in zip(items, parts)]


def test_bound_loses_no_alignment():
    """Trimmed passages give what whole stretches aligned in full give, over a small vocabulary in which words recur."""
    rng = random.Random(9)
    for vocabulary, least in ((12, 8), (40, 16), (200, 16)):
        items = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(6, 40))] for _ in range(15)]
        texts = []
        for _ in range(60):
            own = rng.choice(items)
            a = rng.randrange(len(own))
            part = [w for w in own[a : a + rng.randint(5, 30)] if rng.random() > 0.08]
            texts.append(" ".join([f"w{rng.randrange(vocabulary * 2)}" for _ in range(30)] + part + [f"w{rng.randrange(vocabulary * 2)}" for _ in range(30)]))
        index = L.ItemIndex.build(list(range(15)), items, 5)
        got = {(d, k): s for d, k, s, *_ in L.leaks_in(texts, index, least)}
        want = {}
        for d, t in enumerate(texts):
            words = L.words_of(t)
            for k, own in enumerate(items):
                if {tuple(own[i : i + 5]) for i in range(len(own) - 4)} & {tuple(words[i : i + 5]) for i in range(len(words) - 4)}:
                    ids = {w: i for i, w in enumerate(own)}
                    s = L.smith_waterman(L.np.array([ids[w] for w in own]), L.np.array([ids.get(w, -1) for w in words]))[0]
                    if s >= least:
                        want[d, k] = s
        near = {p: s for p, s in want.items() if p in got}
        assert got.keys() <= want.keys() and near == got and len(got) >= 0.99 * len(want)  # far from every seed nothing is sought


def test_recall_of_edited_copies(spark):
    """Planted passages of 20 words of an item with every word changed, left out or doubled with 8 %: at least 0.9 are found, beside
    a hot stock phrase that a third of all documents and every item hold."""
    rng = random.Random(11)
    stock = [f"s{i}" for i in range(7)]
    items = [[f"i{k}x{rng.randrange(60)}" for _ in range(30)] + stock + [f"i{k}x{rng.randrange(60)}" for _ in range(10)] for k in range(20)]
    docs, planted = [], set()
    for d in range(600):
        body = [f"c{rng.randrange(400)}" for _ in range(60)]
        if d % 3 == 0:
            body[20:20] = stock
        if d % 2 == 0:
            k = rng.randrange(20)
            a = rng.randrange(10)
            part = []
            for w in items[k][a : a + 20]:
                roll = rng.random()
                part += [w, w] if roll < 0.025 else [] if roll < 0.05 else ["otra"] if roll < 0.08 else [w]
            body[40:40] = part
            planted.add((d, k))
        docs.append((d, " ".join(body)))
    d, t = frames(spark, docs, [(k, " ".join(w)) for k, w in enumerate(items)])
    found = {(r["doc_id"], r["item_id"]) for r in L.find_leaks(d, "doc_id", "text", t, "item_id", "texto").collect()}
    assert len(found & planted) >= 0.9 * len(planted) and len(found - planted) <= 0.05 * len(found)


def test_portions():
    assert list(L._portions([])) == [] and list(L._portions([None, "", "a"])) == [(0, 3)]
    assert list(L._portions(["a"] * 5, most=2)) == [(0, 2), (2, 4), (4, 5)]
    assert list(L._portions(["aaa", "b" * 9, "c", "d"], most_chars=5)) == [(0, 1), (1, 2), (2, 4)]
