import hashlib
import random

import numpy as np
import pytest
from oracle import DATA

from vecspark.llm import bpe, queries, token_counts

tokenizers = pytest.importorskip("tokenizers")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ñ", "'s", "'ll", "'l", "1", "23", "!", "<|endoftext|>", "<|", "日本", "\U0001f600", "े", "²", "​", "\x00", "th", "the", "QX", "ZZ", "aaaa" * 20]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_spec(queries.tokenizer_path()))


def test_encoding_and_decoding_as_the_library(library, codec):
    draw = random.Random(1)
    for _ in range(4000):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 14)))
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want and codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_long_pieces(library, codec):
    for text in ("ab" * 30_000, "é" * 20_000, " " * 50_000, "x" * 70_000):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text).ids


def test_no_token_spans_a_cut(codec):
    for token in codec.table:
        if token and token != b"<|endoftext|>":
            assert not codec.cuts(token)


def test_query_as_the_library(spark, library):
    sf = f"{DATA}/sf0.001"
    got = {r.doc_id: r for r in queries.op6_bpe(spark, sf).collect()}
    for d in queries.table(spark, sf, "documents").collect():
        e = library.encode(d.text or "", add_special_tokens=False)
        row = got[d.doc_id]
        assert row.n_tokens == len(e.ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(e.ids, dtype="<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, odd, odd_rows, nothing, library):
    rows = bpe.encode_documents(odd, queries.tokenizer_path()).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r.decoded in {(o[1] or "") for o in odd_rows if o[0] == r.doc_id} and len(r.ids) == r.n_tokens
    assert bpe.encode_documents(nothing, queries.tokenizer_path()).collect() == []
    out = bpe.tokenized(odd, queries.tokenizer_path()).collect()
    assert len(out) == len(odd_rows) and all(r.decoded for r in out)


@pytest.fixture(scope="module")
def plain_library():
    own = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    own.encode_special_tokens = True
    return own


@pytest.mark.parametrize(("leaf", "fan", "tail"), [(2, 2, 1), (128, 16, 64), (3, 4, 7)])
def test_counts_follow_edits(plain_library, monkeypatch, leaf, fan, tail):
    monkeypatch.setattr(token_counts, "LEAF", leaf)
    monkeypatch.setattr(token_counts, "FAN", fan)
    monkeypatch.setattr(token_counts, "TAIL", tail)
    own = bpe.Codec(bpe.read_spec(queries.tokenizer_path()), special=False)
    draw = random.Random(4)
    for _ in range(800):
        x = token_counts.CountedText.of("".join(draw.choice(PIECES) for _ in range(draw.randint(0, 40))), own)
        for _ in range(4):
            x = token_counts.from_columns(own, *token_counts.columns_of(list(x.leaves())))
            a = draw.randint(0, len(x.text))
            b = min(len(x.text), a + draw.choice([0, 1, 2, 9]))
            new = "".join(draw.choice(PIECES) for _ in range(draw.choice([0, 1, 3])))
            want = x.text[:a] + new + x.text[b:]
            x.edit(a, b, new)
            assert x.text == want
            assert x.n_tokens == len(plain_library.encode(want, add_special_tokens=False).ids)
            assert x.n_pieces == len(own.pattern.findall(want))


def test_edits_touch_little(plain_library, monkeypatch):
    own = bpe.Codec(bpe.read_spec(queries.tokenizer_path()), special=False)
    x, encoded = token_counts.CountedText.of("some words here " * 5000, own), []
    plain = token_counts.tokens_of
    monkeypatch.setattr(token_counts, "tokens_of", lambda codec, piece: encoded.append(piece) or plain(codec, piece))
    for at in (40_000, 0, 79_990, 12):
        assert x.edit(at, at + 3, "new") < 8
    assert len(encoded) == x.encoded < 32
    assert x.edit(100, 70_000, "") < 8 and x.root.chars < 11_000


def after(text, edits):
    for start, end, new in edits:
        start, end = (max(0, min(x, len(text))) for x in (start, end))
        text = text[:start] + new + text[max(start, end) :]
    return text


def test_counts_query(spark, plain_library):
    sf = f"{DATA}/sf0.001"
    got = {r.doc_id: r for r in queries.op8_token_counts(spark, sf).collect()}
    docs = queries.table(spark, sf, "documents").selectExpr("doc_id", "text", "cast(coalesce(length(text), 0) as bigint) AS n_chars")
    for d in token_counts.revision(docs).collect():
        before = d.text or ""
        text = after(before, d.edits)
        row = got[d.doc_id]
        assert row.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [row.n_tokens_before, row.n_tokens] == [len(plain_library.encode(t, add_special_tokens=False).ids) for t in (before, text)]
        assert row.n_reencoded < 60 or row.n_pieces < 60


def test_two_rounds_of_edits_from_tables(spark, odd, odd_rows, nothing, plain_library):
    trees = token_counts.counted(odd, queries.tokenizer_path())
    rounds = [[(4, 1, 0, 99, "x"), (6, 2, 5, 9, " and"), (6, 1, 0, 0, "It's "), (10, 1, None, 3, "y"), (5, 1, 100_000, 100_003, "here"), (None, 1, 0, 5, "no"), (77, 1, 0, 0, "z")], [(6, 1, 3, 8, "\n\n1"), (1, 1, 0, 0, "new")]]
    texts = {i: [t or "" for j, t, *_ in odd_rows if j == i] for i in {r[0] for r in odd_rows}}
    for edits in rounds:
        table = spark.createDataFrame(edits, "doc_id bigint, seq int, start bigint, end bigint, new string")
        trees = token_counts.edited(token_counts.with_edits(trees, table), queries.tokenizer_path())
        for i in texts:
            own = [e[2:] for e in sorted(e for e in edits if e[0] == i and i is not None and e[2] is not None)]
            texts[i] = [after(t, own) for t in texts[i]]
        rows = trees.collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0), "".join(r.texts)) for r in rows) == sorted(((i is None, i or 0), t) for i, own in texts.items() for t in own)
        for r in rows:
            assert r.n_tokens == len(plain_library.encode("".join(r.texts), add_special_tokens=False).ids) and r.n_chars == sum(r.chars)
    assert token_counts.edited(token_counts.with_edits(token_counts.counted(nothing, queries.tokenizer_path()), table), queries.tokenizer_path()).collect() == []


def test_workers_keep_nothing_for_the_next_task(spark):
    def kept(batches):
        import sys

        import pyarrow as pa

        for batch in batches:
            entries = getattr(sys.modules.get("_vecspark_cache"), "entries", {})
            yield pa.RecordBatch.from_pylist([{"n": sum("Qzxjv" in getattr(e, "words", ()) for e in entries.values())}] * batch.num_rows, schema=pa.schema([("n", pa.int64())]))

    docs = spark.createDataFrame([(1, "Qzxjv")], "doc_id bigint, text string")
    assert bpe.tokenized(docs, queries.tokenizer_path()).collect()[0].decoded
    assert spark.range(0, 64, 1, 16).mapInArrow(kept, "n bigint").agg({"n": "sum"}).first()[0] == 0
