import re

import numpy as np
import pytest
import xxhash
from oracle import DATA
from llm_conftest import frame, prose

from vecspark.llm import queries, simhash
from vecspark.llm.components import components, forest


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64)) if h else 0


def linked(ids, fps, limit=2):
    """Smallest id of each row's component, by comparing all pairs."""
    own = list(range(len(ids)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    f = np.array(fps, dtype=np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= limit).tolist():
            a, b = root(i), root(i + 1 + j)
            if a != b:
                own[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(least.get(root(i), x), x)
    return [least.get(root(i)) for i in range(len(ids))]


def test_query_against_all_pairs(spark):
    sf = f"{DATA}/sf0.001"
    docs = queries.table(spark, sf, "documents").collect()
    got = {r.doc_id: r for r in queries.op1_simhash(spark, sf).collect()}
    fps = [slow(d.text) for d in docs]
    assert [got[d.doc_id].fingerprint for d in docs] == [f"{f:016x}" for f in fps]
    assert [got[d.doc_id].component_id for d in docs] == linked([d.doc_id for d in docs], fps)


def test_odd_rows(spark, odd, odd_rows, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows)
    want = linked([r[0] for r in odd_rows], [slow(r[1]) for r in odd_rows])
    known = lambda x: -1 if x is None else x
    expected = sorted((known(r[0]), known(w)) for r, w in zip(odd_rows, want))
    assert sorted((known(r.doc_id), known(r.component_id)) for r in rows) == expected
    assert simhash.near_duplicates(nothing).collect() == []
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 4, 5, 6, 9, 10, 21]
    assert simhash.one_of_each(nothing).collect() == []


@pytest.mark.parametrize("limits", [(64, 1 << 16), (4, 1 << 16), (2, 3)])
def test_links_of_small_large_and_hot_buckets(spark, limits):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12).astype(np.uint64)
    fps = {int(b) for b in base}
    for b in base[:4]:
        for _ in range(60):
            x = int(b)
            for bit in rng.integers(0, 64, int(rng.integers(0, 4))):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    edges = simhash.links(distinct, pairwise=limits[0], in_task=limits[1]).collect()
    for e in edges:
        assert bin((e.u ^ e.v) & (2**64 - 1)).count("1") <= 2
    roots = dict(forest((e.u, e.v) for e in edges))
    groups = {}
    for x in signed:
        groups.setdefault(roots.get(x, x), set()).add(x)
    want = linked(signed, [x % 2**64 for x in signed])
    by = {}
    for x, w in zip(signed, want):
        by.setdefault(w, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, by.values()))


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}, 300: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_majority():
    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 8, 77):
        r = rng.integers(0, 2**63, (k, 2)).astype(np.uint64)
        want = [sum((sum(int(x) >> b & 1 for x in r[:, c]) * 2 > k) << b for b in range(64)) for c in range(2)]
        assert simhash.majority(r).tolist() == want


def test_similar_texts_meet_and_others_stay_apart(spark):
    texts, groups = [], []
    for g in range(40):
        words = prose(g, 300).split()
        texts.append(" ".join(words))
        groups.append(g)
        for n in range(2):
            edited = list(words)
            edited[50 + 100 * n] = "edited"
            texts.append(" ".join(edited))
            groups.append(g)
    got = {r.id: r.component_id for r in simhash.similar_documents(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [3 * g for g in groups]
    assert sorted(r.doc_id for r in simhash.one_of_each(frame(spark, texts)).collect()) == [3 * g for g in range(40)]


@pytest.mark.parametrize(("block", "decoys"), [(512, 0), (40, 0), (512, 10_000)])
def test_all_pairs_of_a_segment_group_meet(spark, block, decoys):
    rng, rows = np.random.default_rng(5), []
    for _ in range(100):
        base = rng.integers(0, 2, 64 * simhash.WIDE)
        base[:24] = 1
        partner = base.copy()
        for i in range(1, 170):
            partner[12 * i + 12 + (0 if i == 1 else rng.integers(0, 12)) if i < 169 else 30] ^= 1
        rows += [base, partner]
    more = rng.integers(0, 2, (decoys, 64 * simhash.WIDE))
    more[:, :24] = 1
    wide = np.packbits(np.concatenate([np.array(rows), more]).astype(np.uint8), axis=1)
    nodes = spark.createDataFrame([(i, w.tobytes()) for i, w in enumerate(wide)], "node bigint, wide binary")
    doubts = []
    edges = simhash.near_nodes(nodes, 0.8, lambda doubt: doubts.append(doubt.count()) or doubt.limit(0), block)
    assert {r.node: r.root for r in components(edges).collect()} == {2 * i + 1: 2 * i for i in range(100)} and doubts == [0, 0]


def test_windows_of_bits():
    raw = np.random.default_rng(1).integers(0, 256, (5, 256)).astype(np.uint8)
    bits = np.unpackbits(np.concatenate([raw, raw[:, :9]], axis=1), axis=1)
    ring = np.concatenate([raw, raw[:, :9]], axis=1)
    for bit in (0, 12, 24, 36, 2040 - 2040 % 12):
        assert simhash.window(ring, bit).tolist() == [int("".join(map(str, b[bit : bit + 64])), 2) for b in bits]


def jaccard(a, b):
    a, b = (set(simhash.shingles(t.encode(), 5)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_pairs_of_all_similarities_are_decided_by_their_shingles(spark):
    rng, texts = np.random.default_rng(7), []
    for g in range(150):
        words = prose(1000 + g, 250).split()
        texts.append(" ".join(words))
        for at in rng.permutation(48)[: rng.integers(3, 10)]:
            words[5 * at + 2] = f"other{at}"
        texts.append(" ".join(words))
    got = {r.id: r.component_id for r in simhash.similar_documents(frame(spark, texts)).collect()}
    pairs = [(jaccard(texts[2 * g], texts[2 * g + 1]), got[2 * g] == got[2 * g + 1]) for g in range(150)]
    like = [met for j, met in pairs if j >= 0.8]
    assert sum(like) / len(like) >= 0.95 and not any(met for j, met in pairs if j < 0.8) and len(like) > 50


def test_rows_of_one_id_and_unlike_texts_stay(spark):
    rows = [(1, prose(1, 60)), (1, prose(2, 60)), (1, prose(1, 60)), (2, prose(2, 60) + " x"), (None, prose(1, 60)), (None, prose(3, 60)), (None, prose(3, 60))]
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id bigint, text string, vs_id int, at int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r.vs_id) for r in kept.collect()) == sorted([(1, rows[0][1], 7), (1, rows[1][1], 7), (0, rows[5][1], 7)])


def test_links_grow_with_the_rows_of_a_group_not_its_segments(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base, linked = rng.integers(0, 2, 64 * simhash.WIDE), []
    wide = np.packbits((base ^ (rng.random((60, len(base))) < 0.04)).astype(np.uint8), axis=1)
    nodes = spark.createDataFrame([(i, w.tobytes()) for i, w in enumerate(wide)], "node bigint, wide binary")
    close = simhash.close_nodes
    monkeypatch.setattr(simhash, "close_nodes", lambda pairs, *more: linked.append(pairs.count()) or close(pairs, *more))
    edges = simhash.near_nodes(nodes, 0.8, lambda doubt: doubt.limit(0))
    assert {r.node: r.root for r in components(edges).collect()} == dict.fromkeys(range(1, 60), 0)
    assert linked[0] <= 60 * simhash.LINKS  # each row with all others before
