import zlib

from opsloom.llm.language_id import fit, identify, predict, presence


def test_accuracy_and_split_on_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in identify(docs).collect()}
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert set(out) == set(true)
    for d, r in out.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [d for d, r in out.items() if r.held_out]
    assert sum(out[d].lang_pred == true[d] for d in held) / len(held) > 0.95


def test_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "lang")
    model = fit(docs)
    odd = spark.createDataFrame([(1, None), (1, ""), (2, "12 !?"), (None, "the and of"), (3, "é" * 300_000), (4, "the"), (4, "the")], "doc_id long, text string").selectExpr("*", "1 as lang", "'x' as score")
    out = sorted([(r.doc_id, r.lang_pred, r.held_out) for r in predict(odd, model).collect()], key=str)
    assert [x[1] for x in out if x[0] == 1] == ["und", "und"] and [x[1] for x in out if x[0] == 2] == ["und"]
    assert all(x[1] != "und" for x in out if x[0] in (3, 4, None)) and len(out) == 7
    assert [r.lang_pred for r in identify(odd.withColumn("lang", odd.lang.cast("string")).where("false")).collect()] == []
    none = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in identify(none).collect()} == {"und"}


def test_presence_in_stretches(monkeypatch):
    import numpy as np

    from opsloom.llm import language_id

    texts = [b"Hello there", b"", b"abc" * 50, b"x"]
    data, lens = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    whole = presence(data, lens)
    monkeypatch.setattr(language_id, "STRETCH", 7)
    assert (presence(data, lens) == whole).all() and whole.sum(axis=1)[1] == 0


def test_every_language_is_learned(spark):
    """Far more languages than landmarks, one of a single row, one of many copies of a row; no shuffle of texts."""
    import random

    r = random.Random(4)
    rows, letters = [], "abcdefghijklmnopqrstuvwxyz"
    for k in range(260):
        own = [c + d for c, d in zip(r.sample(letters, 8), r.sample(letters, 8))]
        rows += [(1000 * k + i, " ".join("".join(r.choices(own, k=3)) for _ in range(60)), f"l{k}") for i in range(12)]
    single = next(i for i in range(10**6, 10**6 + 50) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows += [(single, "жзийк лмноп", "one"), *[(single, "кириллица только здесь", "copies")] * 500]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs)
    assert set(model.languages) == {f"l{k}" for k in range(260)} | {"one", "copies"}
    out = predict(docs, model).collect()
    truth = {(d, lang) for d, _, lang in rows if lang[0] == "l"}
    held = [x for x in out if x.held_out]
    assert sum((x.doc_id, x.lang_pred) in truth for x in held) / len(held) > 0.8
    from opsloom.llm.language_id import recognised

    odd = docs.limit(5).unionByName(spark.createDataFrame([(1, None, None), (2, "12 !", "x"), (None, "words", None)], docs.schema)).selectExpr("*", "array(1) as _x", "text as score")
    kept = recognised(odd, model)
    assert kept.schema == odd.schema and sorted(str(x.doc_id) for x in kept.collect()) == sorted([*(str(x.doc_id) for x in odd.limit(5).collect()), "None"])
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()


def test_against_plain_kernel_and_ridge(spark):
    """Presences as sets, the kernel by intersection, Nyström map and ridge from their formulas, for every document."""
    import math

    import numpy as np

    from opsloom.llm import language_id as L

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "1 2 3", None, "s", 5), (10**6 + 2, "Ab", "de", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = docs.select("doc_id", "text", "lang", L.held_out(docs.doc_id).alias("out")).collect()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

    def present(text):
        data, out = (text or "").encode().translate(low), set()
        for n in range(1, 5):
            for i in range(len(data) - n + 1):
                out.add((((int.from_bytes(data[i : i + n], "big") ^ (n * 0x1F35)) * 0x9E3779B1) & 0xFFFFFFFF) >> 18)
        return out

    def alike(x, y):
        return len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y)))

    train = {(r.doc_id, r.text, r.lang) for r in rows if not r.out and r.lang is not None and r.text is not None}
    numbers = {(d, t): u for d, t, u in docs.selectExpr("doc_id", "text", "pmod(xxhash64(doc_id, text), 1L << 40) / cast(1L << 40 as double) as u").collect()}
    train = sorted((numbers[d, t], lang, present(t)) for d, t, lang in train)
    names = sorted({lang for _, lang, _ in train})
    each = -(-L.LANDMARKS // len(names))
    marks = [x for name in names for x in [p for _, lang, p in train if lang == name][:each]]
    gram = np.array([[alike(x, y) for y in marks] for x in marks])
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.array([[alike(x, y) for y in marks] for _, _, x in train]) @ root
    target = np.array([[1.0 if lang == name else -1.0 for name in names] for _, lang, _ in train])
    weights = root @ np.linalg.solve(phi.T @ phi + L.RIDGE * len(phi) / 100 * np.eye(phi.shape[1]), phi.T @ target)
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        x = present(r.text)
        f = L.SHARPNESS * (np.array([alike(x, y) for y in marks]) @ weights)
        e = np.exp(f - f.max())
        best = np.sort(f)[::-1]
        assert abs(got[r.doc_id].score - e.max() / e.sum()) < 2e-3
        assert got[r.doc_id].lang_pred == names[int(f.argmax())] or best[0] - best[1] < 1e-2
