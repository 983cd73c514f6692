import re

import numpy as np

from opsloom.llm.weak_labels import classify, estimate


def test_estimate_recovers_accuracies():
    r = np.random.default_rng(2)
    truth = r.random(20000) < 0.8
    accuracy, speaks = np.array([0.9, 0.8, 0.7, 0.85, 0.75]), np.array([0.9, 0.6, 0.8, 0.5, 0.9])
    right = r.random((20000, 5)) < accuracy
    votes = np.where(r.random((20000, 5)) < speaks, np.where(right == truth[:, None], 1, -1), 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, found = estimate(patterns, counts)
    assert np.allclose(found["good"] / speaks, accuracy, atol=0.05) and abs(found["prior"] - 0.8) < 0.04
    assert ((0 <= post) & (post <= 1)).all()


def plain_votes(text):
    """The labellers one by one, over characters and words."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in raw)
    blanks = sum(c == 32 or 9 <= c <= 13 for c in raw)
    odd = b"#$%&*|@^~<>{}[]\\=_+`"
    n, some = max(len(raw), 1), max(len(words), 1)
    symbols = sum(c in odd for c in raw) / n
    odd_words = sum(any(c in odd for c in w) for w in words) / some
    lettered = letters / max(len(raw) - blanks, 1)
    upper = sum(65 <= c <= 90 for c in raw) / max(letters, 1)
    mean = sum(map(len, words)) / some
    varied = len(set(words)) / some
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    fresh, stops = len(set(triples)) / max(len(triples), 1), sum(c in b".!?" for c in raw) / some
    pairs = [
        (symbols < 0.004, symbols > 0.02), (odd_words < 0.03, odd_words > 0.15), (lettered > 0.93, lettered < 0.88), (upper < 0.12, upper > 0.4), (3.2 < mean < 10, mean <= 2 or mean >= 12),
        (varied > 0.5 or len(words) < 60, varied < 0.3 and len(words) >= 60), (fresh > 0.7 or len(triples) < 20, fresh < 0.5 and len(triples) >= 20),
        (1 / 60 < stops < 1 / 4, (stops == 0 and len(words) > 30) or stops > 0.5), (len(words) >= 40, len(words) < 12),
    ]
    return "".join("-" if bad else "+" if good else "0" for good, bad in pairs)


def plain_posterior(votes):
    """EM with one document after the other."""
    post = [0.1 if "-" in v else 0.9 for v in votes]
    for _ in range(200):
        chance = {}
        for c in (0, 1):
            for j in range(len(votes[0])):
                w = dict.fromkeys("-0+", 1.0)
                for v, p in zip(votes, post):
                    w[v[j]] += p if c else 1 - p
                chance[c, j] = {k: x / sum(w.values()) for k, x in w.items()}
        prior = min(max(sum(post) / len(post), 1e-3), 1 - 1e-3)
        new = []
        for v in votes:
            a, b = prior, 1 - prior
            for j, x in enumerate(v):
                a, b = a * chance[1, j][x], b * chance[0, j][x]
            new.append(a / (a + b))
        if max(abs(x - y) for x, y in zip(new, post)) < 1e-9:
            break
        post = new
    return post


def test_against_brute_force(spark):
    """Votes and posteriors of the whole fixture, and the scorer's training labels."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a b c")], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in classify(docs).collect()}
    assert {d: r.votes for d, r in out.items()} == {d: plain_votes(t) for d, t in texts.items()}
    order = sorted(texts)
    want = plain_posterior([out[d].votes for d in order])
    assert all(abs(out[d].label - p) < 1e-4 for d, p in zip(order, want))


def test_held_out_accuracy_on_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    out = {r.doc_id: r for r in classify(docs).collect()}
    assert len(out) == docs.count()
    good = [out[d].keep for d, q in labels.items() if q == 1]
    bad = [not out[d].keep for d, q in labels.items() if q == 0]
    print("kept of good", np.mean(good), "dropped of bad", np.mean(bad))
    assert np.mean(good) > 0.93 and np.mean(bad) > 0.95
    # the accuracies that EM estimates without labels, against those on the labelled documents
    votes = np.array([["-0+".index(c) - 1 for c in out[d].votes] for d in out])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, found = estimate(patterns, counts)
    for q, name, v in ((1, "wrong", -1), (1, "good", 1), (0, "bad", -1)):
        own = np.array([["-0+".index(c) - 1 for c in out[d].votes] for d, x in labels.items() if x == q])
        assert np.abs((own == v).mean(axis=0) - found[name]).max() < 0.06, name


def test_edges(spark):
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "the and of"), (3, "$$$ %%%"), (3, "$$$ %%%")], "doc_id long, text string").selectExpr("*", "1 as votes", "'x' as keep")
    out = classify(odd).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and len(r.votes) == 9 for r in out)
    assert classify(odd.where("false")).count() == 0


def test_scorer_against_a_plain_one(spark):
    """Presences, training by plain sums over the same order of rows, and every document's score."""
    import math

    from opsloom.llm import weak_labels as W

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    out = {r.doc_id: r for r in W.classify(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    cells = {}
    for d, t in texts.items():
        data = np.frombuffer(t.encode(), np.uint8)
        cells[d] = [int(i) for i in np.flatnonzero(W.presence(data, np.array([len(data)]))[0])]
    order = sorted(texts, key=lambda d: (d, out[d].votes))
    size, label = W.presence(np.zeros(0, np.uint8), np.array([0])).shape[1], {d: out[d].label for d in order}
    good, bad = max(sum(label.values()), 1e-9), max(sum(1 - x for x in label.values()), 1e-9)
    w, const, rng = np.zeros(size), 0.0, np.random.default_rng(11)
    chance = lambda d: 1 / (1 + math.exp(-max(-50, min(50, sum(w[i] for i in cells[d]) / math.sqrt(max(1, len(cells[d]))) + const))))
    for epoch in range(W.EPOCHS):
        turn, step = rng.permutation(len(order)), W.RATE * 8 / (1 + epoch)
        for a in range(0, len(turn), 128):
            own = [order[i] for i in turn[a : a + 128]]
            g = {d: (label[d] * (1 - (p := chance(d))) / good - (1 - label[d]) * p / bad) * len(order) / 2 for d in own}
            w *= 1 - W.DECAY * step
            for d in own:
                for i in cells[d]:
                    w[i] += step * g[d] / math.sqrt(len(cells[d])) / len(own)
            const += step * sum(g.values()) / len(own) / 4
    for d in order:
        assert abs(out[d].score - chance(d)) < 1e-3 and out[d].keep == (out[d].score >= 0.5)
