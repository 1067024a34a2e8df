import hashlib
import random

import numpy as np
import pytest
from oracle import DATA, check, connection
from llm_conftest import frame

from vecspark.llm import bwt, queries, suffix_dedup


def brute(rows):
    first = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            first[w] = min(first.get(w, 1 << 62), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(1 for j in range(len(t)) if gone[j] and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r.doc_id if r.doc_id is not None else 1 << 61, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(df).collect())


def test_columns_give_the_sorted_suffixes():
    draw = random.Random(3)
    for _ in range(150):
        letters = draw.choice([b"ab", b"abc", bytes(range(256))])
        own = [bytes(draw.choice(letters) for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(1, 9))]
        b, lcp, string, length = bwt.column_wise(*bwt.of_bytes(own))
        suffix = lambda i, k: [c + 1 for c in own[i][len(own[i]) - k :]]
        want = sorted(((i, k) for i in range(len(own)) for k in range(len(own[i]) + 1)), key=lambda x: [(c, 0) for c in suffix(*x)] + [(0, x[0])])
        assert list(zip(string.tolist(), length.tolist())) == want
        for q, (i, k) in enumerate(want):
            assert b[q] == (own[i][len(own[i]) - k - 1] + 1 if k < len(own[i]) else 0)
            if q:
                x, y = suffix(*want[q - 1]), suffix(i, k)
                assert lcp[q] == next((n for n, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))


def test_query_against_brute_force(spark):
    sf = f"{DATA}/sf0.001"
    rows = [(r.doc_id, (r.text or "").encode()) for r in queries.table(spark, sf, "documents").collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10_suffix_dedup(spark, sf).collect())
    assert got == brute(rows) and sum(r[2] for r in got) > 0


def test_query_matches_sql(spark):
    sf = f"{DATA}/sf0.001"
    check(queries.op10_suffix_dedup(spark, sf), connection(sf), queries.ORACLE_SQL["op10_suffix_dedup"])


@pytest.mark.parametrize("segment_bytes", [1 << 20, 3000, 1])
@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh \n", "aé日"])
def test_dull_texts_against_brute_force(spark, letters, segment_bytes):
    draw = random.Random(7)
    passages = ["".join(draw.choice(letters) for _ in range(draw.choice([49, 50, 51, 80, 300]))) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [draw.choice(passages) if draw.random() < 0.5 else "".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(draw.randint(0, 4))]
        texts.append("".join(parts))
    docs = frame(spark, texts + texts[:3])
    got = found(suffix_dedup.remove_repeats(docs.repartition(3), segment_bytes=segment_bytes, share_anchors=64, hot=20))
    assert got == brute([(i, t.encode()) for i, t in enumerate(texts + texts[:3])])


def test_many_texts_at_one_anchor_and_small_collections(spark):
    middle = "the same four and twenty bytes of text in all of them, always, "
    texts = [f"{i:05d} {i * 7919 % 1000:03d} " + middle + f"{i * 31 % 97:02d} end {i}" for i in range(120)]
    texts += [t[3:] for t in texts[:40]]
    for options in ({}, {"hot": 5}, {"hot": 5, "share_anchors": 50, "segment_bytes": 900}):
        got = found(suffix_dedup.remove_repeats(frame(spark, texts), **options))
        assert got == brute([(i, t.encode()) for i, t in enumerate(texts)])
    runs, first, known = suffix_dedup.earliest([(t.encode()[:76], 20) for t in texts[:50]], np.arange(50), 7)
    assert runs.sum() == len(known) and (known <= 49).all()


def test_odd_rows(spark, odd, odd_rows, nothing):
    rows = [(r[0] if r[0] is not None else 1 << 61, (r[1] or "").encode()) for r in odd_rows]
    assert found(suffix_dedup.remove_repeats(odd)) == brute(rows)
    assert suffix_dedup.remove_repeats(nothing).collect() == []
