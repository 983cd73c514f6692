import hashlib
import sys
from array import array
from pathlib import Path

import public_tokenizers
import sentencepiece

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus_pipeline  # noqa: E402
import test_jaccard_join  # noqa: E402
import test_phrase_index  # noqa: E402

SF = "/root/testdata/sf0.001"


def repeats(rows, length=200):
    from collections import Counter

    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, raw):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        if not any(gone) or not all(gone):
            out.append((d, bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")))
    return out


def test_pipeline_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    groups = {d: c for d, _, c in test_jaccard_join.brute(rows, 4, 85)}
    rows = [(d, t) for d, t in rows if groups[d] == d]
    rows = repeats(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r[0] for r in test_phrase_index.brute(rows, items, 10) if r[5]}
    assert leaked
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((d, hashlib.sha256(array("I", lib.encode(t)).tobytes()).hexdigest()) for d, t in rows if d not in leaked)
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).where("round_trip").collect())
    assert got == want


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars").limit(2).unionByName(docs).unionByName(docs.limit(0))
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, odd, SF).columns == docs.columns
        assert f(spark, docs.limit(0), SF).count() == 0


def test_repeated_and_null_ids(spark, tmp_path):
    import shutil

    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF}/documents.parquet")
    rows = table.to_pylist()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    for k, r in enumerate(rows):
        r["doc_id"] = None if k % 5 == 0 else 7 if k % 5 == 1 else r["doc_id"]
    long = " ".join(f"Wort{k}" for k in range(60))
    leak = max((t for _, t in items if t), key=len)
    more = [(None, "123 456"), (None, f"null id {leak}"), (90001, long), (90001, long), (None, long), (None, "one of the null texts"), (None, "another of the null texts"), (90002, "a text of an id"), (90002, "some words under that id")]
    rows += [rows[-1] | {"doc_id": d, "text": t, "n_chars": len(t)} for d, t in more]
    rows += rows[:40]
    pq.write_table(pa.Table.from_pylist(rows, schema=table.schema), tmp_path / "documents.parquet", row_group_size=50)
    shutil.copy(f"{SF}/benchmark.parquet", tmp_path)

    left = [(r["doc_id"], r["text"]) for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]
    groups = {}
    for k, _, c in test_jaccard_join.brute([(k, t) for k, (_, t) in enumerate(left)], 4, 85):
        groups.setdefault(c, []).append(k)
    least = sorted(min(g, key=lambda k: (left[k][0] is None, left[k][0] or 0, k)) for g in groups.values())
    assert len(least) < len(left)
    left = repeats([left[k] for k in least])
    assert (90001, long) in left
    leaked = {r[0] for r in test_phrase_index.brute([(k, t) for k, (_, t) in enumerate(left)], items, 10) if r[5]}
    assert any(left[k][0] is None for k in leaked)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted(((d, hashlib.sha256(array("I", lib.encode(t)).tobytes()).hexdigest()) for k, (d, t) in enumerate(left) if k not in leaked), key=str)
    got = sorted(((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert got == want
