import random

import public_tokenizers
import sentencepiece

from opsloom.llm.wfst_pieces import SPACE, _fields, compile_model, encode_decode

PATH = public_tokenizers.path("piece_bpe_32k.model")
EDGE = ["", " ", "   ", "a", " a", "a  b   c ", "Hello  world\n\ttab ﬁ ½ 　x", "日本語テキスト", "\x00\x01é", "🙂🙃 ok", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "==== ---- \\\\\\\\", "  \n  \n", "x" * 3000, "12345 67", "don't ŁÓDŹ", "a▁b"]


def test_same_ids_as_the_library():
    t, lib = compile_model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(3)
    alphabet = "aabcdeeeiiiorstnhl  \n.,'éüß0123-_/=ABCT日🙂ж"
    texts = EDGE + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(4000)]
    texts += [" ".join(r.choice(t.pieces) + r.choice(t.pieces) for _ in range(6)).replace(SPACE, " ") for _ in range(4000)]
    for x in texts:
        assert list(t.encode(x)) == lib.encode(x), x
        assert t.decode(t.encode(x)) == lib.decode(lib.encode(x)) == x.replace(SPACE, " "), x


def test_query_on_fixture_and_edges(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(EDGE)] + [(None, None), (1, None), (1, None)], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in docs.unionByName(more).collect() if r.text is not None}
    out = encode_decode(docs.unionByName(more).selectExpr("*", "1 as ids"), with_output=True).collect()
    assert len(out) == 200 + len(EDGE) + 3 and all(r.round_trip for r in out)
    for r in out:
        if r.decoded is None:
            assert r.ids == [] and r.n_tokens == 0
        elif r.doc_id in texts:
            assert r.ids == lib.encode(texts[r.doc_id]), r.doc_id
    assert encode_decode(docs.limit(0)).count() == 0


def test_unigram_paths_are_least():
    """A model file made by hand: unigram pieces with weights, against every segmentation."""
    import itertools
    import struct
    import tempfile

    from opsloom.llm.wfst_pieces import BYTE_WEIGHT

    def field(n, value):
        return bytes([n << 3 | 2, len(value)]) + value

    pieces = {"a": -1.0, "b": -1.2, "ab": -1.5, "aba": -2.9, "ba": -2.3, "bb": -2.0, SPACE: -1.1, SPACE + "a": -1.3}
    body = field(1, field(1, b"<unk>") + b"\x18\x02") + b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", w)) for p, w in pieces.items())
    body += field(2, b"\x18\x01") + field(3, b"\x18\x01\x20\x00\x28\x01")
    with tempfile.NamedTemporaryFile(suffix=".model") as f:
        f.write(body)
        f.flush()
        t = compile_model(f.name)
    weight = lambda ids: sum(-pieces[t.pieces[i]] if i else BYTE_WEIGHT for i in ids)

    def least(x):
        if not x:
            return 0.0
        return min([w + least(x[len(p) :]) for p, v in pieces.items() if x.startswith(p) for w in [-v]] + ([BYTE_WEIGHT + least(x[1:])] if x[0] not in pieces else []))

    for n in range(1, 8):
        for x in itertools.product("abc ", repeat=n) if n < 5 else [("a", "b", "b", "a", "b", "a", "c")[:n]]:
            x = "".join(x)
            assert abs(weight(t.encode(x)) - least(SPACE + x.replace(" ", SPACE))) < 1e-4, x


def models(tmp_path):
    """The default model with another normaliser, and with user-defined pieces."""
    with open(PATH, "rb") as f:
        model = f.read()

    def field(n, value):
        size, head = len(value), b""
        while size > 127:
            head += bytes([size & 127 | 128])
            size >>= 7
        return bytes([n << 3 | 2]) + head + bytes([size]) + value

    maps = {}
    for rule in ("nfkc", "nmt_nfkc_cf"):
        proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        maps[rule] = next(dict(_fields(v))[2] for n, v in _fields(proto) if n == 3)
    # later fields of a kind are merged into earlier ones
    made = {
        "map": model + field(3, field(2, maps["nfkc"])),
        "map and white space": model + field(3, field(2, maps["nmt_nfkc_cf"]) + b"\x20\x01"),
        "white space, no prefix": model + field(3, b"\x18\x00\x20\x01"),
        "own pieces": model + b"".join(field(1, field(1, p.encode()) + b"\x18\x04") for p in ("<x>", "bqc", "<x>y")),
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
        yield name, str(tmp_path / name)


def test_normalisers_and_own_pieces_as_the_library(tmp_path):
    r = random.Random(6)
    alphabet = "aabcdeeeiiiorstnhl  \n.,'éüß0123-_/=ABCT日🙂ж　ﬁ½Ａｶﾞ①Å\u0301\u200b\x01<x>y"
    alphabet = [*alphabet, "<x>", "bqc"]
    texts = [x for x in EDGE if SPACE not in x] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 50))) for _ in range(2500)]
    for name, path in models(tmp_path):
        t, lib = compile_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
        for x in texts:
            assert list(t.encode(x)) == lib.encode(x), (name, x)
            assert t.decode(t.encode(x)) == t.plain(x), (name, x)
        assert len(t.normal.rules) > 4000 or "map" not in name


def test_long_chunks():
    """Texts without a space."""
    t, lib = compile_model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(2)
    for x in ("".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/AZ") for _ in range(30_000)), "x" * 9000, "日本語テキスト" * 2000, "=-" * 6000):
        assert list(t.encode(x)) == lib.encode(x)


def test_weights_decide():
    """The acceptor aside, other weights give other paths: the search reads them."""
    t = compile_model(PATH)
    t.bpe = False
    plain = t.path("▁internationalisation")
    t.arcs, t.machine = {p: (i, 1.0) for p, (i, _) in t.arcs.items()}, None
    fewest = t.path("▁internationalisation")
    assert len(fewest) <= len(plain) and fewest != plain


def test_other_models_are_refused(tmp_path):
    import pytest

    with open(PATH, "rb") as f:
        model = f.read()
    (tmp_path / "m.model").write_bytes(model + b"\x12\x02\x18\x03")  # a word model
    with pytest.raises(ValueError, match="unigram and BPE"):
        compile_model(str(tmp_path / "m.model"))


def test_cut_where_no_piece_crosses():
    """Chunks give the text again and hold every piece that can occur in it; a word is one chunk whatever follows it."""
    import re

    t = compile_model(PATH)
    r = random.Random(8)
    alphabet = "aabcdeéüßł  \n.,'0123-_/=AB日🙂жЖا" + SPACE
    for x in ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))).replace(" ", SPACE) for _ in range(2000)] + [r.choice(t.pieces) + r.choice(t.pieces) for _ in range(2000)]:
        chunks = t.chunk.findall(x)
        assert "".join(chunks) == x
        ends = {0, *(sum(map(len, chunks[: k + 1])) for k in range(len(chunks)))}
        for cut in ends - {0, len(x)}:
            assert not any(x[a:b] in t.arcs for a in range(max(0, cut - 16), cut) for b in range(cut + 1, min(len(x), cut + 16) + 1)), (x, cut)
    assert t.chunk.findall(SPACE + "word.\nNext,12") == [SPACE + "word", ".", "\n", "Next", ",", "1", "2"]
    assert re.fullmatch(t.chunk, "x" * 3000)


def test_groups_of_texts_with_little_memory(monkeypatch):
    """Shared prefixes, forgotten chunks, steps and pairs, long chunks between short ones: the ids of single texts."""
    from opsloom.llm import wfst_pieces as w

    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(9)
    words = ["".join(r.choice("aeinrst") for _ in range(r.randint(1, 9))) + r.choice(["", "", ".", ",\n", "é", "日", "🙂"]) for _ in range(3000)] + ["aei" * 40, "aei" * 39 + "x", "🙂" * 9]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, ""] + EDGE
    for name, value in (("REMEMBERED", 50), ("TOGETHER", 200), ("STEPS", 100), ("PAIRS", 100), ("LONG_CHUNK", 100)):
        monkeypatch.setattr(w, name, value)
    t = compile_model(PATH)
    for x, ids in zip(texts, t.encode_all(texts), strict=True):
        assert list(ids) == lib.encode(x or ""), x
    assert len(t.known) <= 50 + 200 + 60 and len(t.steps) <= 100


def test_words_before_punctuation_are_composed_once():
    """A word is remembered without the punctuation behind it."""
    t = compile_model(PATH)
    composed, paths = [], t.paths
    t.paths = lambda chunks: paths(composed.extend(chunks) or chunks)
    t.encode_all(["word word. word, (word) word;\nword"])
    assert sorted(c for c in composed if "word" in c) == ["word", SPACE + "word"]


def test_large_ids_beside_a_null(spark):
    rows = spark.createDataFrame([(2**53 + 1, "a"), (None, "b"), (-(2**63), None)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in encode_decode(rows).collect()} == {2**53 + 1, None, -(2**63)}
