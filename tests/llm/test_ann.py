import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from vecspark.llm import ann, queries


def exact(ids, x, query, k):
    scores = (x * query[1]).sum(axis=1)
    own = np.array(ids) != query[0]
    order = np.lexsort((np.array(ids)[own], -scores[own]))[:k]
    return np.array(ids)[own][order].tolist(), scores[own][order].tolist()


@pytest.mark.parametrize("tile", [1, 2, 3])
def test_walk_takes_cells_by_falling_sum(tile):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=6), rng.normal(size=5)
    sizes = rng.integers(0, 3, (6, 5))
    assert ann.walk(a, b, sizes, 10**9, tile).tolist() == np.flatnonzero(sizes).tolist()
    sums = (a[:, None] + b[None, :]).ravel()
    for wanted in (1, 7, 20):
        some = ann.walk(a, b, sizes, wanted, tile)
        assert sizes.ravel()[some].sum() >= min(wanted, sizes.sum())
        if tile == 1:
            by_sum = [c for c in np.argsort(-sums) if sizes.ravel()[c]]
            assert sorted(some) == sorted(by_sum[: len(some)]) and sizes.ravel()[by_sum[: len(some) - 1]].sum() < wanted


def test_shelves_cut_cells_in_order():
    low, high = ann.shelves(np.array([3, 0, 4, 25, 1, 0]), 10)
    assert low.tolist() == [0, 0, 0, 0, 3, 3] and high.tolist() == [0, 0, 0, 3, 3, 3]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_recall(spark, sf):
    sf = f"{DATA}/{sf}"
    rows = queries.table(spark, sf, "embeddings").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)
    found = {}
    for r in queries.op4_ann(spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        want, scores = exact(ids, x, (q, x[ids.index(q)]), 20)
        hits += len(set(want) & {i for i, _ in got})
        by = dict(zip(ids, (x * x[ids.index(q)]).sum(axis=1)))
        assert len(got) == len(want) and all(abs(by[i] - s) < 1e-12 for i, s in got)
    assert hits / (20 * len(found)) >= 0.9


def test_recall_with_a_partial_walk(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {}
    for r in ann.neighbours(df, F.col("vec_id") % 100 == 0, k=10, cells_per_half=64, share=0.18, depth=3, shelf_rows=300, query_rows=11).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found[q] & set(exact(range(3000), x, (q, x[q]), 10)[0])) for q in found)
    assert len(found) == 30 and hits / 300 >= 0.9


def test_a_cell_of_a_third_of_all_rows_and_a_stray_length(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8))
    x[100:240] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, [1.0] * n) for i in range(1000, 1006) for n in (1, 9)]
    found = {}
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20, shelf_rows=16, query_rows=7).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: ids for q, ids in found.items()} == {q: exact(range(400), x, (q, x[q]), 20)[0] for q in range(0, 400, 20)}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), (8, []), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (None, [9.0, 9.0]), (40, None), (60, [1.0])]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id bigint, embedding array<double>, cell int, rank int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.neighbours(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0] == [(0, 1, 6, 1.0), (0, 2, 7, 1.0), (0, 3, 20, 0.5)]
    assert {g[2] for g in got if g[0] == 20} == {0, 6, 7} and {g[0] for g in got} == {0, 20}
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.neighbours(df, F.lit(False)).collect() == []
