import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import metrics, vectors
from vecspark.operators import evaluate, exact


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(c) for c in v]) for i, v in enumerate(x)], "id bigint, v array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    return rng.normal(size=(70, 6)), rng.normal(size=(9, 6))


@pytest.mark.parametrize("name", ["l2", "mips", "cosine"])
def test_blocks_agree_with_brute_force(spark, data, name):
    x, q = data
    found = exact.knn(table(spark, x), table(spark, q), 5, name, block_rows=16, query_rows=4).collect()
    own = metrics.METRICS[name]
    for r in range(len(q)):
        dist = own.exact(q[r], x)
        want = np.lexsort((np.arange(len(x)), dist))[:5]
        rows = sorted((f for f in found if f.qid == r), key=lambda f: f.rank)
        assert [f.id for f in rows] == want.tolist()
        assert np.allclose([f.dist for f in rows], dist[want] * own.sign)


@pytest.mark.parametrize("name", ["l2", "mips", "cosine"])
def test_columns_agree_with_blocks(spark, data, name):
    x, q = data
    pairs = table(spark, x).crossJoin(table(spark, q).select(F.col("id").alias("qid"), F.col("v").alias("qv")))
    one = {(r.qid, r.rank): r.id for r in exact.knn_sql(pairs, 4, name).collect()}
    two = {(r.qid, r.rank): r.id for r in exact.knn(table(spark, x), table(spark, q), 4, name).collect()}
    assert one == two


def test_ties_and_nulls_and_few_rows(spark):
    base = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (None, [0.0, 0.0]), (7, [0.0, 1.0])], "id bigint, v array<double>")
    ask = spark.createDataFrame([(0, [1.0, 0.0])], "id bigint, v array<double>")
    rows = exact.knn(base, ask, 10).orderBy("rank").collect()
    assert [(r.rank, r.id) for r in rows] == [(1, 1), (2, 3), (3, 7)]
    assert exact.knn(base.limit(0), ask, 3).collect() == []


def test_range_and_merge(spark, data):
    x, q = data
    near = exact.within(table(spark, x), table(spark, q), 6.0, block_rows=16, query_rows=4).collect()
    want = {(r, i) for r in range(len(q)) for i in range(len(x)) if ((q[r] - x[i]) ** 2).sum() <= 6.0}
    assert {(r.qid, r.id) for r in near} == want
    parts = {"a": exact.knn(table(spark, x[:35]), table(spark, q), 5), "b": exact.knn(table(spark, x[35:], 35), table(spark, q), 5)}
    whole = {(r.qid, r.rank): r.id for r in exact.knn(table(spark, x), table(spark, q), 5).collect()}
    assert {(r.qid, r.rank): r.id for r in exact.merged(parts, 5).collect()} == whole


def test_mips_by_augmented_l2_ranks_alike(spark, data):
    x, q = data
    base = vectors.mips_base(table(spark, x), "v").select("id", F.col("prepared").alias("v"))
    ask = table(spark, q).select("id", vectors.mips_query("v").alias("v"))
    one = {(r.qid, r.rank): r.id for r in exact.knn(base, ask, 5).collect()}
    two = {(r.qid, r.rank): r.id for r in exact.knn(table(spark, x), table(spark, q), 5, "mips").collect()}
    assert one == two


def test_half_base64_and_rotation(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 1 / 3])], "id bigint, v array<double>")
    row = df.select(vectors.half_precision("v").alias("h"), vectors.vector_base64("v", 4).alias("b"), vectors.rotated("v", vectors.rotation(3)).alias("r"), metrics.norm("v").alias("n")).first()
    assert row.h == [float(np.float16(x)) for x in (1, 2, 1 / 3)]
    import base64

    assert np.frombuffer(base64.b64decode(row.b), "<f4").tolist() == [1.0, 2.0, np.float32(1 / 3), 0.0]
    assert np.isclose(np.linalg.norm(row.r), row.n)


def test_unknown_metric():
    with pytest.raises(ValueError):
        metrics.metric("hamming")


@pytest.mark.parametrize("values", [[5], [3, 1, 2, 2, 2, 9, 9], list(range(100))])
def test_percentile_rule(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = {r.p: r.value for r in evaluate.at_fractions(df, "x", [0.0, 0.25, 0.5, 0.95], top=True).collect()}
    s = sorted(values)
    assert got == {p: float(s[min(int(p * len(s)), len(s) - 1)]) for p in (0.0, 0.25, 0.5, 0.95, 1.0)}


@pytest.mark.parametrize("universal", [None, "u"])
def test_labels_by_blocks(spark, data, universal):
    x, q = data
    marks = [["a", "b"], ["b"], ["u"], ["c", "a"], []]
    own = [marks[i % 5] for i in range(len(x))]
    ask = [["a", "b"], ["c"], ["u"], []]
    base = spark.createDataFrame([(i, v.tolist(), m) for i, (v, m) in enumerate(zip(x, own))], "id bigint, v array<double>, labels array<string>")
    queries = spark.createDataFrame([(i, v.tolist(), ask[i % 4]) for i, v in enumerate(q)], "id bigint, v array<double>, labels array<string>")
    got = {}
    for r in exact.knn_labelled(base, queries, 5, universal=universal, block_rows=16, query_rows=4).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    for i in range(len(q)):
        held = [j for j in range(len(x)) if set(own[j]) & set(ask[i % 4]) or (universal and universal in own[j])]
        want = sorted(held, key=lambda j: (((q[i] - x[j]) ** 2).sum(), j))[:5]
        assert got.get(i, []) == want


def test_many_ties_beyond_the_spare_rows(spark):
    x = np.array([[1.0, 0.0]] * 40 + [[0.0, 1.0]] * 40)[::-1]
    q = np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]])
    got = {}
    for r in exact.knn(table(spark, x), table(spark, q), 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {0: [40, 41, 42, 43, 44], 1: [0, 1, 2, 3, 4], 2: [0, 1, 2, 3, 4]}
    some = exact.knn(table(spark, x), table(spark, x[:3]), 60, skip_self=True).groupBy("qid").count().collect()
    assert {r["count"] for r in some} == {60}
