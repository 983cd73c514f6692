import random

from opsloom.llm.token_counts import at_limit, default_ranks, encoding, length_quantile, suffix_sums, token_histogram

FIELDS = ["n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "docs_up_to", "tokens_up_to", "truncated_total", "quantile", "total_docs", "total_tokens"]


def brute(lengths):
    n, total = len(lengths), sum(lengths)
    return sorted((x, lengths.count(x), sum(y >= x for y in lengths), sum(y for y in lengths if y >= x), sum(y <= x for y in lengths), sum(y for y in lengths if y <= x), sum(min(x, y) for y in lengths), sum(y <= x for y in lengths) / n, n, total) for x in set(lengths))


def rows(df):
    return sorted(tuple(r[c] for c in FIELDS) for r in df.collect())


def test_sums_across_stretches(spark):
    r = random.Random(1)
    lengths = [r.choice([0, 1, 1023, 1024, 1025, 5000, 70000, r.randrange(9000)]) for _ in range(300)]
    counts = spark.createDataFrame([(x, lengths.count(x)) for x in set(lengths)], "n_tokens long, n_docs long")
    sums = suffix_sums(counts)
    assert rows(sums) == brute(lengths)
    for limit in (0, 1, 1024, 4999, 10**6):
        got = at_limit(sums, limit).first()
        assert (got.docs_up_to, got.truncated_total) == (sum(x <= limit for x in lengths), sum(min(x, limit) for x in lengths))
    assert length_quantile(sums, 0.5).first()[0] == sorted(lengths)[149]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    more = spark.createDataFrame([(None,), ("",), ("a b",), ("a b",)], "text string")
    enc = encoding(*default_ranks())
    lengths = [len(enc.encode_ordinary(r.text or "")) for r in docs.unionByName(more).collect()]
    assert rows(token_histogram(docs.unionByName(more).selectExpr("*", "1 as n_docs"))) == brute(lengths)
    assert token_histogram(docs.limit(0)).count() == 0
