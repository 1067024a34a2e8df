"""The registered queries on vectors and the SQL they are checked against.

All run over the whole table. Searches take as queries every row whose id is
divisible by 100. Fixed centres are the ten labels' centroids; fixed graphs are
exact nearest-neighbour graphs; samples are arithmetic in the id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions import metrics as M
from vecspark.functions import vectors as V
from vecspark.operators import dynamic, evaluate, exact, graph, labels, pag, partition, pq
from vecspark.operators.graph import GraphParams
from vecspark.plans import indices
from vecspark.plans.params import IndexConfig
from vecspark.streaming import window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIM = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def asked(df: DataFrame) -> DataFrame:
    return df.where(F.col("id") % 100 == 0)


def six(name: str):
    return F.round(F.col(name), 6).alias(name)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


# SQL pieces: e is the table, q its query rows, p(a, b) products, l2(a, b), kn(...) the ranking.
E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
Q = "q AS (SELECT id AS qid, v AS qv, label AS ql FROM e WHERE id % 100 = 0)"


def ip_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def l2_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def cos_sql(a: str, b: str) -> str:
    return f"1 - {ip_sql(a, b)} / (sqrt({ip_sql(a, a)}) * sqrt({ip_sql(b, b)}))"


def knn_cte(name: str, k: int, dist: str = "", order: str = "dist", base: str = "e", where: str = "true") -> str:
    return f"{name} AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY {order}, id) AS rank, id, dist FROM (SELECT qid, id, {dist or l2_sql('v', 'qv')} AS dist FROM q, {base} WHERE {where}) QUALIFY rank <= {k})"


CENTROIDS = "c AS (SELECT label AS centre, list(m ORDER BY pos) AS cv FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY label, pos) GROUP BY label)"
KNN_SHOWN = "SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM {}"

# --- scalar functions


def neighbours_by_id(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("a_id"), F.col("v").alias("a")).join(df.select((F.col("id") - 1).alias("a_id"), F.col("v").alias("b")), "a_id")


def pairs_sql(value: str) -> str:
    return f"WITH {E} SELECT x.id AS a_id, round({value}, 6) AS value FROM e x JOIN e y ON y.id = x.id + 1"


@query(pairs_sql(l2_sql("x.v", "y.v")))
def l2_pairs(spark, sf_dir):
    return neighbours_by_id(rows(spark, sf_dir)).select("a_id", F.round(M.l2_squared("a", "b"), 6).alias("value"))


@query(pairs_sql(ip_sql("x.v", "y.v")))
def ip_pairs(spark, sf_dir):
    return neighbours_by_id(rows(spark, sf_dir)).select("a_id", F.round(M.inner_product("a", "b"), 6).alias("value"))


@query(pairs_sql(cos_sql("x.v", "y.v")))
def cosine_pairs(spark, sf_dir):
    return neighbours_by_id(rows(spark, sf_dir)).select("a_id", F.round(M.cosine_distance("a", "b"), 6).alias("value"))


@query(pairs_sql(f"{ip_sql('x.v', 'x.v')} - 2 * {ip_sql('x.v', 'y.v')}"))
def fastl2_pairs(spark, sf_dir):
    return neighbours_by_id(rows(spark, sf_dir)).select("a_id", F.round(M.fast_l2("a", "b"), 6).alias("value"))


@query(pairs_sql(l2_sql("x.v", "y.v")))
def sql_function_pairs(spark, sf_dir):
    M.register(spark)
    return neighbours_by_id(rows(spark, sf_dir)).selectExpr("a_id", "round(l2_sq(a, b), 6) AS value")


@query(f"WITH {E} SELECT id, round(sqrt({ip_sql('v', 'v')}), 6) AS norm FROM e")
def vector_norms(spark, sf_dir):
    return rows(spark, sf_dir).select("id", F.round(M.norm("v"), 6).alias("norm"))


def unnested(df: DataFrame, name: str) -> DataFrame:
    return df.select("id", F.posexplode(name).alias("pos", "value")).select("id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


def unnest_sql(value: str, cast: str = "") -> str:
    return f"WITH {E} SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(x AS DOUBLE), 6) AS value FROM (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM (SELECT id, {value} AS w FROM e))"


@query(unnest_sql(f"list_transform(v, lambda x: x / sqrt({ip_sql('v', 'v')}))"))
def normalise(spark, sf_dir):
    return unnested(rows(spark, sf_dir).withColumn("w", V.normalised("v")), "w")


BIAS, SCALE = -0.5, 1.0


@query(unnest_sql(f"list_transform(v, lambda x: trunc((x - ({BIAS})) * (254.0::DOUBLE / {SCALE})))").replace("embedding::DOUBLE[] AS v", "list_transform(embedding::DOUBLE[], lambda y: y * 0.5) AS v"))
def quantise_int8(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("h", F.transform(M.doubles("v"), lambda x: x * 0.5))
    wide = df.withColumn("w", F.transform("h", lambda x: ((x - BIAS) * (254.0 / SCALE)).cast("int")))
    return unnested(wide, "w")


@query(unnest_sql("list_transform(v, lambda x: (x - 0.25) * 3.0)"))
def dequantise(spark, sf_dir):
    return unnested(rows(spark, sf_dir).withColumn("w", V.dequantised("v", 0.25, 3.0)), "w")


@query(unnest_sql("list_transform(v, lambda x: trunc(x * 100))"))
def type_casts(spark, sf_dir):
    return unnested(rows(spark, sf_dir).withColumn("w", V.cast_to(F.transform(M.doubles("v"), lambda x: x * 100), "int8")), "w")


@query(f"WITH {E}, s AS (SELECT id, list_transform(v, lambda x: x * (1 + id % 3)) AS u FROM e), t AS (SELECT max(sqrt({ip_sql('u', 'u')})) AS top FROM s) SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round(x, 4) AS value FROM (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM (SELECT id, list_append(list_transform(u, lambda x: x / top), sqrt(greatest(0, 1 - {ip_sql('u', 'u')} / (top * top)))) AS w FROM s, t))")
def mips_prep_base(spark, sf_dir):
    scaled = rows(spark, sf_dir).select("id", F.transform(M.doubles("v"), lambda x: x * (1 + F.col("id") % 3)).alias("u"))
    return V.mips_base(scaled, "u").select("id", F.posexplode("prepared").alias("pos", "value")).withColumn("value", F.round("value", 4))


@query(unnest_sql(f"list_append(list_transform(v, lambda x: x / sqrt({ip_sql('v', 'v')})), 0.0)"))
def mips_prep_query(spark, sf_dir):
    return unnested(rows(spark, sf_dir).withColumn("w", V.mips_query("v")), "w")


@query(f"WITH {E} SELECT round(max(sqrt({ip_sql('v', 'v')})), 6) AS max_norm FROM e")
def max_norm(spark, sf_dir):
    return rows(spark, sf_dir).agg(F.round(F.max(M.norm("v")), 6).alias("max_norm"))


@query(f"WITH {E}, {CENTROIDS} SELECT id, round({ip_sql('r', 'r')}, 6) AS residual FROM (SELECT id, list_transform(list_zip(v, cv), lambda p: p[1] - p[2]) AS r FROM e JOIN c ON label = centre)")
def centroid_residuals(spark, sf_dir):
    e = rows(spark, sf_dir)
    r = e.join(partition.centroid(e, "v", "label"), "label").withColumn("r", V.residual("v", "centroid"))
    return r.select("id", F.round(M.inner_product("r", "r"), 6).alias("residual"))


PERCENTS = ", ".join(f"({p / 100})" for p in range(0, 100, 5))
FRACTIONS = [p / 100 for p in range(0, 100, 5)]


def percentiles_sql(values: str, more: str = "") -> str:
    return f"WITH {E}, x AS ({values}), s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM x), f(p) AS (VALUES {PERCENTS}{more}) SELECT CAST(p AS DOUBLE) AS p, round(CAST(value AS DOUBLE), 6) AS value FROM f JOIN s ON i = least(floor(CAST(p AS DOUBLE) * n), n - 1)"


@query(percentiles_sql("SELECT round((1 + id % 7) * sqrt(" + ip_sql("v", "v") + "), 6) AS value FROM e", ", (1.0)"))
def norm_percentiles(spark, sf_dir):
    norms = rows(spark, sf_dir).select(F.round((1 + F.col("id") % 7) * M.norm("v"), 6).alias("n"))
    return rounded(evaluate.at_fractions(norms, "n", FRACTIONS, top=True), "value")


@query(percentiles_sql("SELECT value FROM events WHERE value IS NOT NULL").replace(f"WITH {E}, ", "WITH "))
def latency_percentile_rule(spark, sf_dir):
    found = evaluate.at_fractions(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", FRACTIONS)
    return found.select("p", F.round(F.col("value").cast("double"), 6).alias("value"))


# --- exact searches


def shown(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("rank").cast("int").alias("rank"), "id", six("dist"))


def exact_10(spark, sf_dir, name):
    e = rows(spark, sf_dir)
    return shown(exact.knn(e, asked(e), 10, name))


@query(f"WITH {E}, {Q}, {knn_cte('k', 10)} " + KNN_SHOWN.format("k"))
def exact_knn_l2(spark, sf_dir):
    return exact_10(spark, sf_dir, "l2")


@query(f"WITH {E}, {Q}, {knn_cte('k', 10, ip_sql('v', 'qv'), '-dist')} " + KNN_SHOWN.format("k"))
def exact_knn_mips(spark, sf_dir):
    return exact_10(spark, sf_dir, "mips")


@query(f"WITH {E}, {Q}, {knn_cte('k', 10, cos_sql('v', 'qv'))} " + KNN_SHOWN.format("k"))
def exact_knn_cosine(spark, sf_dir):
    return exact_10(spark, sf_dir, "cosine")


@query(f"WITH {E}, q AS (SELECT id AS qid, v AS qv FROM e), {knn_cte('k', 10, where='qid <> id')} " + KNN_SHOWN.format("k"))
def exact_knn_all(spark, sf_dir):
    e = rows(spark, sf_dir)
    return shown(exact.knn(e, e, 10, skip_self=True))


@query(f"WITH {E}, {Q}, m AS (SELECT id + 1 AS id, v FROM e), {knn_cte('k', 10, base='m', where='id % 10 <> 0')} " + KNN_SHOWN.format("k"))
def knn_with_tags(spark, sf_dir):
    e = rows(spark, sf_dir)
    tagged = e.select((F.col("id") + 1).alias("id"), "v").where(F.col("id") % 10 != 0)
    return shown(exact.knn(tagged, asked(e), 10))


RADIUS = 1.6


@query(f"WITH {E}, {Q} SELECT qid, id, round(dist, 6) AS dist FROM (SELECT qid, id, {l2_sql('v', 'qv')} AS dist FROM q, e) WHERE dist <= {RADIUS}")
def exact_range(spark, sf_dir):
    e = rows(spark, sf_dir)
    return rounded(exact.within(e, asked(e), RADIUS), "dist")


@query(f"WITH {E}, {Q} SELECT qid, count(*) AS n FROM (SELECT qid, {l2_sql('v', 'qv')} AS dist FROM q, e) WHERE dist <= {RADIUS} GROUP BY qid")
def range_counts(spark, sf_dir):
    e = rows(spark, sf_dir)
    return exact.within(e, asked(e), RADIUS).groupBy("qid").agg(F.count("*").alias("n"))


@query(f"WITH {E}, {Q}, {knn_cte('k', 20)} SELECT qid, list(id ORDER BY id) AS ids FROM k WHERE dist <= {RADIUS} GROUP BY qid")
def range_truth_pruned(spark, sf_dir):
    e = rows(spark, sf_dir)
    truth = exact.knn(e, asked(e), 20)
    return truth.where(F.col("dist") <= RADIUS).groupBy("qid").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("labels", F.array(F.col("label").cast("string")))


@query(f"WITH {E}, {Q}, {knn_cte('k', 10, where='label IN (3, 0)')} " + KNN_SHOWN.format("k"))
def knn_by_label_single(spark, sf_dir):
    e = labelled(rows(spark, sf_dir))
    kept = e.where(labels.matches(F.col("labels"), F.array(F.lit("3")), "0"))
    return shown(exact.knn(kept, asked(e), 10))


@query(f"WITH {E}, {Q}, {knn_cte('k', 10, where='label = ql')} " + KNN_SHOWN.format("k"))
def knn_by_query_label(spark, sf_dir):
    e = labelled(rows(spark, sf_dir))
    return shown(exact.knn_labelled(e, asked(e), 10))


@query(f"WITH {E}, {Q}, {knn_cte('k', 10, where='label = ql OR label = 0')} " + KNN_SHOWN.format("k"))
def knn_universal_label(spark, sf_dir):
    e = labelled(rows(spark, sf_dir))
    return shown(exact.knn_labelled(e, asked(e), 10, universal="0"))


@query(f"WITH {E}, {Q}, {knn_cte('k', 10)} SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) AS dist, CAST(id % 3 AS VARCHAR) AS part FROM k")
def multi_index_merge(spark, sf_dir):
    e = rows(spark, sf_dir)
    parts = {str(i): exact.knn(e.where(F.col("id") % 3 == i), asked(e), 10) for i in range(3)}
    return exact.merged(parts, 10).select("qid", F.col("rank").cast("int").alias("rank"), "id", six("dist"), "part")


# --- evaluation: the results are exact over the rows whose id is not divisible by 4


def truth_and_lossy(spark, sf_dir, k=10):
    e = rows(spark, sf_dir)
    return exact.knn(e, asked(e), k), exact.knn(e.where(F.col("id") % 4 != 0), asked(e), k), e


LOSSY = f"WITH {E}, {Q}, {knn_cte('t', 10)}, {knn_cte('r', 10, where='id % 4 <> 0')}"


@query(f"{LOSSY} SELECT 100.0::DOUBLE * (SELECT count(*) FROM r JOIN t USING (qid, id)) / ((SELECT count(*) FROM q) * 10) AS recall")
def recall_at_k(spark, sf_dir):
    truth, found, _ = truth_and_lossy(spark, sf_dir)
    return evaluate.recall_at(truth, found, 10, ties=False)


@query(f"WITH {E}, {Q}, {knn_cte('t', 20, f'floor({l2_sql(chr(118), chr(113) + chr(118))} * 10)')}, {knn_cte('r', 10, where='id % 4 <> 0')}, kth AS (SELECT qid, dist AS last FROM t WHERE rank = 10), good AS (SELECT t.qid, id FROM t JOIN kth USING (qid) WHERE rank <= 10 OR dist = last) SELECT 100.0::DOUBLE * (SELECT count(*) FROM r JOIN good USING (qid, id)) / ((SELECT count(*) FROM q) * 10) AS recall")
def recall_with_ties(spark, sf_dir):
    e = rows(spark, sf_dir)

    def tenths(ids, x, qids, q):
        """The 20 nearest of a block by whole tenths of the distance, ties to the smaller id."""
        out = ([], [], [])
        for name, v in zip(qids, q):
            dist = np.floor(((x - v) ** 2).sum(axis=1) * 10)
            near = np.lexsort((ids, dist))[:20]
            for c, values in zip(out, (np.full(len(near), name), ids[near], dist[near]), strict=True):
                c.append(values)
        return tuple(np.concatenate(c) for c in out)

    near = exact.tiled(exact.vectors(e, "id", "v"), exact.vectors(asked(e), "id", "v"), tenths)
    truth = exact.top_k(near, 20).select("qid", "rank", "id", "dist")
    return evaluate.recall_at(truth, exact.knn(e.where(F.col("id") % 4 != 0), asked(e), 10), 10)


@query(f"WITH {E}, {Q}, {knn_cte('t', 20)}, {knn_cte('r', 10, where='id % 4 <> 0')}, a AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM t WHERE id % 5 <> 0 QUALIFY n <= 10) SELECT 100.0::DOUBLE * (SELECT count(*) FROM r JOIN a USING (qid, id)) / ((SELECT count(*) FROM q) * 10) AS recall")
def recall_active_tags(spark, sf_dir):
    truth, found, e = truth_and_lossy(spark, sf_dir, 20)
    active = evaluate.active_truth(truth, e.where(F.col("id") % 5 != 0), 10)
    return evaluate.recall_at(active, found.where("rank <= 10"), 10, ties=False)


RANGES = f"WITH {E}, {Q}, t AS (SELECT qid, id FROM q, e WHERE {l2_sql('v', 'qv')} <= {RADIUS}), r AS (SELECT * FROM t WHERE id % 4 <> 0)"


@query(f"{RANGES}, s AS (SELECT q.qid, count(t.id) AS n, count(r.id) AS h FROM q LEFT JOIN t ON q.qid = t.qid LEFT JOIN r ON r.qid = t.qid AND r.id = t.id GROUP BY q.qid) SELECT round(avg(CASE WHEN n = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * h / n END), 6) AS recall FROM s")
def range_recall(spark, sf_dir):
    e = rows(spark, sf_dir)
    truth = exact.within(e, asked(e), RADIUS)
    return rounded(evaluate.range_recall(truth, truth.where(F.col("id") % 4 != 0), asked(e).select(F.col("id").alias("qid"))), "recall")


@query(f'{RANGES} SELECT (SELECT count(*) FROM r) AS found, (SELECT count(*) FROM t) AS "true", round((SELECT count(*) FROM r)::DOUBLE / (SELECT count(*) FROM t), 6) AS ratio')
def ratio_of_sums(spark, sf_dir):
    e = rows(spark, sf_dir)
    truth = exact.within(e, asked(e), RADIUS)
    return rounded(evaluate.ratio_of_sums(truth, truth.where(F.col("id") % 4 != 0)), "ratio")


# --- labels: a row's own, "all", and marks by id


def many_labels(df: DataFrame) -> DataFrame:
    marks = [F.col("label").cast("string"), F.lit("all"), *(F.when(F.col("id") % m == 0, F.lit(f"by_{m}")) for m in (2, 3, 5))]
    return df.withColumn("labels", F.array_sort(F.array_compact(F.array(*marks))))


POINT_LABEL = "pl AS (SELECT id, unnest(list_filter([CAST(label AS VARCHAR), 'all', CASE WHEN id % 2 = 0 THEN 'by_2' END, CASE WHEN id % 3 = 0 THEN 'by_3' END, CASE WHEN id % 5 = 0 THEN 'by_5' END], lambda x: x IS NOT NULL)) AS label FROM e)"


@query(f"WITH {E}, {POINT_LABEL} SELECT label, count(*) AS n FROM pl GROUP BY label")
def label_histogram(spark, sf_dir):
    return labels.histogram(many_labels(rows(spark, sf_dir)))


@query(percentiles_sql(f"WITH {POINT_LABEL} SELECT count(*) AS value FROM pl GROUP BY label"))
def label_stats_percentiles(spark, sf_dir):
    found = labels.count_percentiles(many_labels(rows(spark, sf_dir)))
    return found.select("p", F.col("value").cast("double").alias("value"))


@query(f"WITH {E}, {POINT_LABEL}, n AS (SELECT id, count(*) AS c FROM pl GROUP BY id) SELECT (SELECT count(*) FROM e) AS n_points, round(avg(c), 6) AS labels_per_point, round(avg(CASE WHEN c >= 4 THEN 1.0 ELSE 0.0 END), 6) AS dense_share, (SELECT count(DISTINCT label) FROM pl) AS n_labels, round((SELECT avg(c) FROM (SELECT count(*) AS c FROM pl GROUP BY label)), 6) AS points_per_label FROM n")
def label_statistics(spark, sf_dir):
    return rounded(labels.statistics(many_labels(rows(spark, sf_dir)), dense=4), "labels_per_point", "dense_share", "points_per_label")


@query(f"WITH {E}, {POINT_LABEL} SELECT label, count(*) AS n FROM pl GROUP BY label ORDER BY n DESC, label LIMIT 3")
def label_top(spark, sf_dir):
    return labels.most_frequent(many_labels(rows(spark, sf_dir)))


@query(f"WITH {E}, {POINT_LABEL} SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS label_id FROM (SELECT DISTINCT label FROM pl WHERE label <> 'all') UNION ALL SELECT 'all', 0")
def label_map(spark, sf_dir):
    return labels.label_map(many_labels(rows(spark, sf_dir)), universal="all")


@query(f"WITH {E}, {POINT_LABEL}, m AS (SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS label_id FROM (SELECT DISTINCT label FROM pl WHERE label <> 'all') UNION ALL SELECT 'all', 0) SELECT id, coalesce(label_id, 0) AS label_id FROM (SELECT id, CAST(label + id % 2 * 100 AS VARCHAR) AS label FROM e) LEFT JOIN m USING (label)")
def label_conversion(spark, sf_dir):
    e = rows(spark, sf_dir)
    wanted = e.select("id", (F.col("label") + F.col("id") % 2 * 100).cast("string").alias("label"))
    return labels.converted(wanted, labels.label_map(many_labels(e), universal="all"), universal=True).select("id", "label_id")


@query(f"WITH {E}, {POINT_LABEL}, p AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY label) - 1 AS pos FROM pl) SELECT id, CAST(pos // 2 AS INTEGER) AS copy, list(label ORDER BY label) AS labels FROM p GROUP BY id, pos // 2")
def dense_label_breakup(spark, sf_dir):
    return labels.broken_up(many_labels(rows(spark, sf_dir)), 2)


@query(f"WITH {E}, {POINT_LABEL} SELECT DISTINCT id FROM pl WHERE label IN ('by_3', '7')")
def label_overlap_semijoin(spark, sf_dir):
    return labels.having_any(many_labels(rows(spark, sf_dir)), spark.createDataFrame([("by_3",), ("7",)], "label string"))


@query(f"WITH {E}, {POINT_LABEL}, n AS (SELECT id, string_agg(label, ',' ORDER BY label) AS line FROM pl GROUP BY id) SELECT id, list_sort(string_split(line, ',')) AS labels FROM n")
def label_lines(spark, sf_dir):
    lines = many_labels(rows(spark, sf_dir)).select("id", F.concat(F.concat_ws(", ", "labels"), F.lit("\r")).alias("value"))
    return lines.select("id", labels.parse_labels(lines).alias("labels"))


@query(f"WITH {E} SELECT id, string_agg(CAST(CAST(round(x, 3) AS DECIMAL(9,3)) AS VARCHAR), chr(9) ORDER BY pos) AS value FROM (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY id")
def vectors_as_tsv(spark, sf_dir):
    from vecspark.sources.binary import vectors_tsv

    return vectors_tsv(rows(spark, sf_dir).withColumn("v", F.transform(M.doubles("v"), lambda x: F.round(x, 3).cast("decimal(9,3)"))))


# --- centres


@query(f"WITH {E} SELECT CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS value FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY pos")
def centroid(spark, sf_dir):
    return rounded(partition.centroid(rows(spark, sf_dir), "v").select(F.posexplode("centroid").alias("pos", "value")), "value")


WHOLE_CENTROID = "c AS (SELECT list(m ORDER BY pos) AS cv FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY pos))"


@query(f"WITH {E}, {WHOLE_CENTROID} SELECT id, round({l2_sql('v', 'cv')}, 6) AS dist FROM e, c ORDER BY {l2_sql('v', 'cv')}, id LIMIT 1")
def medoid(spark, sf_dir):
    return rounded(partition.medoid(rows(spark, sf_dir), "id", "v"), "dist")


@query(f"WITH {E}, {CENTROIDS} SELECT label, id, round(dist, 6) AS dist FROM (SELECT label, id, {l2_sql('v', 'cv')} AS dist FROM e JOIN c ON label = centre) QUALIFY row_number() OVER (PARTITION BY label ORDER BY dist, id) = 1")
def medoid_per_label(spark, sf_dir):
    return rounded(partition.medoid(rows(spark, sf_dir), "id", "v", "label"), "dist")


def label_centres(spark, sf_dir) -> np.ndarray:
    """The labels' centroids as a fixed codebook of ten rows."""
    return np.array([r.centroid for r in partition.centroid(rows(spark, sf_dir), "v", "label").orderBy("label").collect()])


NEAR_CENTRES = f"n AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY dist, centre) AS rank, centre, dist FROM (SELECT id, centre, {l2_sql('v', 'cv')} AS dist FROM e, c))"


@query(f"WITH {E}, {CENTROIDS}, {NEAR_CENTRES} SELECT id, CAST(centre AS INTEGER) AS centre, round(dist, 6) AS dist FROM n WHERE rank = 1")
def assign_nearest_pivot(spark, sf_dir):
    return rounded(partition.nearest_centres(rows(spark, sf_dir), label_centres(spark, sf_dir)).select("id", "centre", "dist"), "dist")


@query(f"WITH {E}, {CENTROIDS}, {NEAR_CENTRES} SELECT id, CAST(rank AS INTEGER) AS rank, CAST(centre AS INTEGER) AS centre FROM n WHERE rank <= 2")
def assign_two_nearest(spark, sf_dir):
    return partition.nearest_centres(rows(spark, sf_dir), label_centres(spark, sf_dir), 2).select("id", "rank", "centre")


@query(f"WITH {E}, {CENTROIDS}, {NEAR_CENTRES} SELECT CAST(centre AS INTEGER) AS centre, count(*) AS n FROM n WHERE rank <= 2 GROUP BY centre")
def cluster_sizes(spark, sf_dir):
    return partition.shards(rows(spark, sf_dir), label_centres(spark, sf_dir)).groupBy(F.col("shard").alias("centre")).agg(F.count("*").alias("n"))


@query(f"WITH {E}, {CENTROIDS}, {NEAR_CENTRES}, o AS (SELECT centre, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM n JOIN e USING (id) WHERE rank = 1) SELECT CAST(centre AS INTEGER) AS centre, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS value FROM o GROUP BY centre, pos")
def lloyd_one_iteration(spark, sf_dir):
    centres, _ = partition.lloyd(rows(spark, sf_dir), label_centres(spark, sf_dir))
    flat = [(i, j, float(x)) for i, row in enumerate(centres) for j, x in enumerate(row)]
    return rounded(spark.createDataFrame(flat, "centre int, pos int, value double"), "value")


MIXED = "(id % 2147483648 * 1103515245 + 12345) % 2147483648"


@query(f"WITH {E} SELECT id FROM e ORDER BY {MIXED}, id LIMIT 100")
def sample_fixed_size(spark, sf_dir):
    return partition.fixed_sample(rows(spark, sf_dir).select("id"), 100)


PLACED = f"{CENTROIDS}, {NEAR_CENTRES}, pl AS (SELECT centre AS shard, id FROM n WHERE rank <= 2)"


@query(f"WITH {E}, {PLACED}, m AS (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY id) - 1 AS local_id, id FROM pl) SELECT CAST(shard AS INTEGER) AS shard, local_id, id FROM m WHERE local_id % 2 = 0")
def shard_id_map(spark, sf_dir):
    e = rows(spark, sf_dir)
    ids = partition.local_ids(partition.shards(e, label_centres(spark, sf_dir)))
    return partition.with_global_ids(ids.where("local_id % 2 = 0").select("shard", "local_id"), ids).select("shard", "local_id", "id")


@query(f"WITH {E}, {PLACED} SELECT CAST(shard AS INTEGER) AS shard, id, [CAST(label AS VARCHAR)] AS labels FROM pl JOIN e USING (id)")
def shard_label_extract(spark, sf_dir):
    e = labelled(rows(spark, sf_dir))
    return partition.shard_labels(partition.shards(e, label_centres(spark, sf_dir)), e)


@query(f"WITH {E}, x AS (SELECT id AS line, CASE WHEN id = 90 THEN '' ELSE CAST(label AS VARCHAR) END AS label FROM e) SELECT min(line) AS line, label FROM x WHERE line < (SELECT min(line) FROM x WHERE label = '') GROUP BY label")
def query_filter_lines(spark, sf_dir):
    from vecspark.sources.text import query_filters

    lines = rows(spark, sf_dir).select(F.col("id").alias("line"), F.when(F.col("id") == 90, "").otherwise(F.concat(F.col("label").cast("string"), F.lit("\r"))).alias("value"))
    return query_filters(lines, unique=True)


# --- product quantisation with the fixed codebook, 8 chunks

CHUNKS = 8
CODES = f"d AS (SELECT id, j, centre, {l2_sql('v[j * 8 + 1 : j * 8 + 8]', 'cv[j * 8 + 1 : j * 8 + 8]')} AS dist FROM e, c, range({CHUNKS}) AS r(j)), codes AS (SELECT id, j, centre AS code, dist AS err FROM d QUALIFY row_number() OVER (PARTITION BY id, j ORDER BY dist, centre) = 1)"
ADC = f"tab AS (SELECT qid, j, centre, {l2_sql('qv[j * 8 + 1 : j * 8 + 8]', 'cv[j * 8 + 1 : j * 8 + 8]')} AS part FROM q, c, range({CHUNKS}) AS r(j)), adc AS (SELECT qid, id, sum(part) AS dist FROM codes JOIN tab ON tab.j = codes.j AND centre = code GROUP BY qid, id)"


@query(f"WITH {E}, {CENTROIDS}, {CODES} SELECT id, CAST(j AS INTEGER) AS chunk, CAST(code AS INTEGER) AS code FROM codes")
def pq_encode_fixed(spark, sf_dir):
    return pq.encoded(rows(spark, sf_dir), pq.fixed(label_centres(spark, sf_dir), CHUNKS)).select("id", F.posexplode("code").alias("chunk", "code"))


@query(f"WITH {E}, {CENTROIDS}, {CODES} SELECT id, round(sum(err), 6) AS error FROM codes GROUP BY id")
def pq_inflate_error(spark, sf_dir):
    return rounded(pq.inflated_error(rows(spark, sf_dir), pq.fixed(label_centres(spark, sf_dir), CHUNKS)), "error")


@query(f"WITH {E}, {Q}, {CENTROIDS}, {CODES}, {ADC} SELECT qid, id, round(dist, 6) AS dist FROM adc")
def pq_adc_distance(spark, sf_dir):
    e = rows(spark, sf_dir)
    return rounded(pq.lookup_distances(e, asked(e), pq.fixed(label_centres(spark, sf_dir), CHUNKS)), "dist")


@query(f"WITH {E}, {Q}, {CENTROIDS}, {CODES}, {ADC}, s AS (SELECT qid, id FROM adc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) <= 30), r AS (SELECT s.qid, id, {l2_sql('v', 'qv')} AS dist FROM s JOIN e USING (id) JOIN q ON q.qid = s.qid) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM r QUALIFY rank <= 10")
def pq_shortlist_rerank(spark, sf_dir):
    e = rows(spark, sf_dir)
    return shown(pq.reranked(e, asked(e), pq.fixed(label_centres(spark, sf_dir), CHUNKS), 10))


# --- graphs: exact nearest neighbours, 4 each


def knn_graph(df: DataFrame, k: int = 4) -> DataFrame:
    return exact.knn(df, df, k, skip_self=True).groupBy(F.col("qid").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("nbrs"))


ALL_Q = "q AS (SELECT id AS qid, v AS qv FROM e)"
GRAPH4 = f"{ALL_Q}, {knn_cte('k4', 4, where='qid <> id')}, g AS (SELECT qid AS src, id AS dst, dist FROM k4)"


@query(f"WITH {E}, {GRAPH4}, n AS (SELECT dst, count(*) AS c FROM g GROUP BY dst) SELECT max(c) AS max_degree, round(avg(c), 6) AS avg_degree, min(c) AS min_degree, count(*) FILTER (WHERE c < 2) AS n_sparse FROM n")
def knn_graph_degree_stats(spark, sf_dir):
    stats = graph.degrees(graph.reversed_edges(knn_graph(rows(spark, sf_dir))))
    return stats.select(*(F.col(c).cast("bigint").alias(c) for c in ("max_degree", "min_degree", "n_sparse")), six("avg_degree"))


@query(f"WITH {E}, {GRAPH4} SELECT dst AS id, list(src ORDER BY src) AS nbrs FROM g GROUP BY dst")
def graph_reverse_edges(spark, sf_dir):
    return graph.reversed_edges(knn_graph(rows(spark, sf_dir)))


@query(f"WITH {E}, {GRAPH4}, u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g) SELECT src AS id, list(dst ORDER BY dst) AS nbrs FROM u GROUP BY src")
def graph_union_dedupe(spark, sf_dir):
    g = knn_graph(rows(spark, sf_dir))
    return graph.united(g, graph.reversed_edges(g))


HALVES = f"{ALL_Q}, {knn_cte('ka', 4, where='qid <> id AND qid % 3 <> 0 AND id % 3 <> 0')}, {knn_cte('kb', 4, where='qid <> id AND qid % 3 <> 1 AND id % 3 <> 1')}"


@query(f"WITH {E}, {HALVES}, u AS (SELECT qid, id, dist FROM ka UNION SELECT qid, id, dist FROM kb) SELECT qid AS id, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank, id AS nbr, round(dist, 6) AS dist FROM u QUALIFY rank <= 5")
def shard_graph_merge(spark, sf_dir):
    e = rows(spark, sf_dir)
    shards = [knn_graph(e.where(F.col("id") % 3 != i)) for i in (0, 1)]
    return rounded(graph.nearest_united(shards, e, 5), "dist")


@query(f"WITH RECURSIVE {E}, {GRAPH4}, walk AS (SELECT 0::BIGINT AS id, 0 AS level UNION SELECT dst, level + 1 FROM walk JOIN g ON src = id WHERE level < 32), first AS (SELECT id, min(level) AS level FROM walk GROUP BY id) SELECT level, count(*) AS n FROM first GROUP BY level")
def bfs_levels(spark, sf_dir):
    return graph.levels(knn_graph(rows(spark, sf_dir)), spark.createDataFrame([(0,)], "id bigint"))


@query(f"WITH {E}, {GRAPH4} SELECT round(dist, 6) AS radius FROM (SELECT dist, row_number() OVER (ORDER BY dist) - 1 AS i, count(*) OVER () AS n FROM g) WHERE i = floor(n * 0.15::DOUBLE)")
def edge_radius_quantile(spark, sf_dir):
    e = rows(spark, sf_dir)
    lengths = graph.edge_lengths(knn_graph(e), e)
    return evaluate.at_fractions(lengths, "dist", [0.15]).select(F.round("value", 6).alias("radius"))


@query(f"WITH {E}, {GRAPH4}, o AS (SELECT dist AS overall FROM (SELECT dist, row_number() OVER (ORDER BY dist) - 1 AS i, count(*) OVER () AS n FROM g) WHERE i = floor(n * 0.15::DOUBLE)), w AS (SELECT src, dist FROM (SELECT src, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS i, count(*) OVER (PARTITION BY src) AS n FROM g) WHERE i = floor(n * 0.5::DOUBLE)) SELECT src AS id, round(least(dist, overall), 6) AS radius FROM w, o")
def radius_per_node(spark, sf_dir):
    e = rows(spark, sf_dir)
    return rounded(pag.radii(graph.edge_lengths(knn_graph(e), e), pag.PagParams()), "radius")


# --- aggregation points: a fifth of the rows

PARAMS = pag.PagParams(sample_rate=0.2, redundant=2, extra_rate=1.0)
AGGS = "s AS (SELECT id, v, ((id % 2147483648) * 1103515245 + 12345) % 2147483648 < 429496729 AS is_agg FROM e), a AS (SELECT id AS agg_id, v AS av FROM s WHERE is_agg), r AS (SELECT id, v FROM s WHERE NOT is_agg)"
OFFERS = f"o AS (SELECT id, agg_id, dist, row_number() OVER (PARTITION BY id ORDER BY dist, agg_id) AS choice FROM (SELECT id, agg_id, {l2_sql('v', 'av')} AS dist FROM r, a) QUALIFY choice <= 2), ivf AS (SELECT agg_id, id, dist FROM o QUALIFY row_number() OVER (PARTITION BY agg_id ORDER BY dist, id) <= {PARAMS.capacity})"
PROBES = f"p AS (SELECT qid, agg_id, dist AS agg_dist FROM (SELECT qid, agg_id, {l2_sql('av', 'qv')} AS dist FROM q, a) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, agg_id) <= 5)"
PROBED = f"m AS (SELECT DISTINCT qid, id FROM p JOIN ivf USING (agg_id) UNION SELECT qid, agg_id FROM p), f AS (SELECT m.qid, m.id, {l2_sql('v', 'qv')} AS dist FROM m JOIN e ON e.id = m.id JOIN q ON q.qid = m.qid) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM f QUALIFY rank <= 10"


def sampled(spark, sf_dir):
    e = exact.vectors(rows(spark, sf_dir), "id", "v")
    aggs, rest = pag.aggregation_points(e, PARAMS)
    return e, aggs, rest


def lists_of(rest: DataFrame, aggs: DataFrame) -> DataFrame:
    return pag.placed(pag.candidates(rest, aggs, PARAMS.redundant, "nearest", PARAMS), PARAMS.capacity)


@query(f"WITH {E}, {AGGS} SELECT id, is_agg FROM s")
def pag_sample(spark, sf_dir):
    return rows(spark, sf_dir).select("id", partition.hash_sample("id", PARAMS.sample_rate).alias("is_agg"))


@query(f"WITH {E}, {AGGS}, {OFFERS} SELECT id, agg_id, round(dist, 6) AS dist FROM o WHERE choice = 1")
def pag_assign_top1(spark, sf_dir):
    _, aggs, rest = sampled(spark, sf_dir)
    return rounded(pag.candidates(rest, aggs, 1, "nearest", PARAMS).select("id", "agg_id", "dist"), "dist")


@query(f"WITH {E}, {AGGS}, {OFFERS} SELECT agg_id, id, round(dist, 6) AS dist FROM ivf")
def pag_assign_capacity(spark, sf_dir):
    _, aggs, rest = sampled(spark, sf_dir)
    return rounded(lists_of(rest, aggs), "dist")


@query(f"WITH {E}, {AGGS}, {OFFERS} SELECT id FROM r WHERE id NOT IN (SELECT id FROM ivf)")
def pag_promoted(spark, sf_dir):
    _, aggs, rest = sampled(spark, sf_dir)
    return rest.select("id").join(lists_of(rest, aggs).select("id").distinct(), "id", "left_anti")


@query(f"WITH {E}, {Q}, {AGGS}, {OFFERS}, {PROBES}, {PROBED}")
def pag_probe_search(spark, sf_dir):
    e, aggs, rest = sampled(spark, sf_dir)
    return shown(pag.search(e, aggs, lists_of(rest, aggs), asked(e), pag.probed(aggs, asked(e), 5), 10))


STOP = "least_p AS (SELECT qid, min(agg_dist) AS nearest FROM p0 GROUP BY qid), p AS (SELECT p0.* FROM p0 JOIN least_p USING (qid) WHERE agg_dist <= 1.2::DOUBLE * (nearest + 2 * 0.05::DOUBLE))"


@query(f"WITH {E}, {Q}, {AGGS}, {OFFERS}, {PROBES.replace('p AS', 'p0 AS', 1).replace('<= 5', '<= 20')}, {STOP}, {PROBED}")
def pag_route_stop(spark, sf_dir):
    e, aggs, rest = sampled(spark, sf_dir)
    radius = aggs.select("id", F.lit(0.05).alias("radius"))
    probes = pag.stopped_early(pag.probed(aggs, asked(e), 20), radius, 1.2)
    return shown(pag.search(e, aggs, lists_of(rest, aggs), asked(e), probes, 10))


# --- changes: live rows are ids from 1; batches and deletes by arithmetic


def live_rows(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("v").cast("array<double>").alias("v")).where("id % 3 <> 0")


NEW_BATCH = "b AS (SELECT id, v FROM e WHERE id % 2 = 0)"


@query(f"WITH {E}, {NEW_BATCH} SELECT id, CASE WHEN id = 0 OR id % 3 <> 0 THEN -1 ELSE 0 END AS status FROM b")
def insert_dedupe_status(spark, sf_dir):
    e = rows(spark, sf_dir)
    batch = e.select("id", F.col("v").cast("array<double>").alias("v")).where("id % 2 = 0")
    return dynamic.insert_status(batch, live_rows(e)).select("id", "status")


@query(f"WITH {E} SELECT id, CASE WHEN id = 0 OR id % 3 <> 0 THEN -1 WHEN row_number() OVER (PARTITION BY id = 0 OR id % 3 <> 0 ORDER BY id) <= 50 THEN 0 ELSE -1 END AS status FROM e")
def insert_capacity_status(spark, sf_dir):
    e = rows(spark, sf_dir)
    live = live_rows(e)
    return dynamic.insert_status(e.select("id", F.col("v").cast("array<double>").alias("v")), live, capacity=live.count() + 50).select("id", "status")


@query(f"WITH {E} SELECT id FROM e WHERE id % 7 = 0 AND id % 3 = 0")
def lazy_delete_failed(spark, sf_dir):
    e = rows(spark, sf_dir)
    return dynamic.failed_deletes(live_rows(e), e.where("id % 7 = 0"))


@query(f"WITH {E} SELECT id FROM e WHERE id % 3 <> 0 AND id % 7 <> 0")
def live_set_after_delete(spark, sf_dir):
    e = rows(spark, sf_dir)
    return dynamic.active(live_rows(e), e.where("id % 7 = 0").select("id")).select("id")


@query(f"WITH {E} SELECT count(*) FILTER (WHERE id % 3 <> 0 AND id % 7 <> 0) AS active, count(*) FILTER (WHERE id % 3 <> 0 AND id % 7 = 0) AS deleted, count(*) FILTER (WHERE id % 3 = 0 AND id % 7 = 0) AS unknown FROM e")
def consolidation_report(spark, sf_dir):
    e = rows(spark, sf_dir)
    return dynamic.consolidated(live_rows(e), e.where("id % 7 = 0").select("id"))[1]


@query(f"WITH {E}, {Q}, {knn_cte('k', 10, where='id % 7 <> 0')} " + KNN_SHOWN.format("k"))
def knn_after_delete(spark, sf_dir):
    e = rows(spark, sf_dir)
    return shown(exact.knn(dynamic.active(e, e.where("id % 7 = 0").select("id")), asked(e), 10))


@query(f"WITH {E}, {GRAPH4}, l AS (SELECT src, dst FROM g WHERE src % 7 <> 0), c AS (SELECT src, dst FROM l WHERE dst % 7 <> 0 UNION SELECT l.src, g.dst FROM l JOIN g ON g.src = l.dst WHERE l.dst % 7 = 0 AND g.dst % 7 <> 0 AND g.dst <> l.src) SELECT e.id, coalesce(list(dst ORDER BY dst) FILTER (WHERE dst IS NOT NULL), []) AS nbrs FROM e LEFT JOIN c ON c.src = e.id WHERE e.id % 7 <> 0 GROUP BY e.id")
def consolidate_candidates(spark, sf_dir):
    e = rows(spark, sf_dir)
    return dynamic.repaired_candidates(knn_graph(e), e.where("id % 7 = 0").select("id"))


@query(f"WITH {E}, n AS (SELECT max(id) + 1 AS n FROM e), st AS (SELECT unnest(range(0, CAST(greatest(0, (n - 200) // 50) AS BIGINT) + 1)) AS step, n FROM n) SELECT CAST(step AS INTEGER) AS step, CAST(greatest(step - 1, 0) * 50 AS BIGINT) AS first, CAST(least(n, 200 + step * 50) - 1 AS BIGINT) AS last, count(*) AS n_live FROM st JOIN e ON id BETWEEN greatest(step - 1, 0) * 50 AND least(n, 200 + step * 50) - 1 GROUP BY step, n")
def sliding_window_live_set(spark, sf_dir):
    window.check_window(200, 50, 1000)
    return window.steps(rows(spark, sf_dir), 200, 50)


@query(f"WITH {E}, x AS (SELECT CAST(ceil((CASE WHEN id < 100 THEN 0 ELSE (id - 100) // 25 + 1 END) / 4.0) AS INTEGER) AS snapshot, count(*) AS n FROM e GROUP BY 1) SELECT snapshot, CAST(sum(n) OVER (ORDER BY snapshot) AS BIGINT) AS n_rows FROM x")
def snapshot_counts(spark, sf_dir):
    return window.snapshots(rows(spark, sf_dir), 100, 25, 4)


# --- approximate indices: no SQL; each row carries the recall that its result reached


def with_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return shown(found).join(F.broadcast(evaluate.recall_at(truth, found, k, ties=False)))


PLAIN = GraphParams(degree=16, list_size=32)


@query()
def vamana_search(spark, sf_dir):
    e = rows(spark, sf_dir).drop("label")
    index = indices.StaticIndex.build(e, IndexConfig(DIM), PLAIN, shards=2)
    return with_recall(index.search(asked(e), 10, 64), exact.knn(e, asked(e), 10), 10)


@query()
def node_visit_counts(spark, sf_dir):
    e = rows(spark, sf_dir).drop("label")
    index = indices.StaticIndex.build(e, IndexConfig(DIM), PLAIN)
    return graph.visit_counts(index.graphs, asked(e), 32)


@query()
def merged_by_search_graph(spark, sf_dir):
    e = rows(spark, sf_dir).drop("label")
    index = indices.StaticIndex.build(e, IndexConfig(DIM), PLAIN, shards=2)
    return graph.degrees(graph.merged_by_search(index.graphs, e, 16))


@query()
def search_sweep(spark, sf_dir):
    e = rows(spark, sf_dir).drop("label")
    index = indices.StaticIndex.build(e, IndexConfig(DIM), PLAIN)
    return indices.sweep(index, asked(e), exact.knn(e, asked(e), 10), 10, [10, 20, 40]).drop("seconds", "qps")


@query()
def vamana_search_mips(spark, sf_dir):
    e = rows(spark, sf_dir).drop("label")
    index = indices.StaticIndex.build(e, IndexConfig(DIM, "mips"), PLAIN)
    return with_recall(index.search(asked(e), 10, 64), exact.knn(e, asked(e), 10, "mips"), 10)


@query()
def filtered_vamana_search(spark, sf_dir):
    e = labelled(rows(spark, sf_dir)).drop("label")
    index = indices.StaticIndex.build(e, IndexConfig(DIM), GraphParams(degree=32, list_size=64), filtered=True)
    return with_recall(index.search(asked(e), 10, 64, labels_col="labels"), exact.knn_labelled(e, asked(e), 10), 10)


@query()
def stitched_search(spark, sf_dir):
    e = labelled(rows(spark, sf_dir)).drop("label")
    index = indices.StaticIndex.build(e, IndexConfig(DIM), PLAIN, stitched=GraphParams(degree=32))
    return with_recall(index.search(asked(e), 10, 64, labels_col="labels"), exact.knn_labelled(e, asked(e), 10), 10)


@query()
def pag_graph_search(spark, sf_dir):
    e = rows(spark, sf_dir).drop("label")
    index = indices.PagIndex.build(e, pag.PagParams(sample_rate=0.1))
    return with_recall(index.search(asked(e), 10, 64), exact.knn(e, asked(e), 10), 10)


@query()
def pq_trained_search(spark, sf_dir):
    e = rows(spark, sf_dir)
    index = indices.QuantisedIndex.build(e, IndexConfig(DIM), 16, centres=64)
    return with_recall(index.search(asked(e), 10, 5), exact.knn(e, asked(e), 10), 10)


@query()
def opq_search(spark, sf_dir):
    e = rows(spark, sf_dir)
    index = indices.QuantisedIndex.build(e, IndexConfig(DIM), 16, centres=32, rotated=True)
    return with_recall(index.search(asked(e), 10, 5), exact.knn(e, asked(e), 10), 10)


@query()
def quantised_range_search(spark, sf_dir):
    e = rows(spark, sf_dir)
    index = indices.QuantisedIndex.build(e, IndexConfig(DIM), 16, centres=64)
    return rounded(index.within(asked(e), RADIUS), "dist")


@query()
def kmeanspp_partition(spark, sf_dir):
    e = rows(spark, sf_dir)
    return partition.shards(e, partition.kmeans(e, 8)).groupBy("shard").agg(F.count("*").alias("n"))


@query()
def random_vectors(spark, sf_dir):
    return indices.random_vectors(spark, 1000, 16).select("id", F.round(M.norm("v"), 6).alias("norm"))


@query()
def zipf_labels(spark, sf_dir):
    return labels.histogram(indices.random_labels(spark, 1000, 20, "zipf"))


@query()
def simulated_aggregate_recall(spark, sf_dir):
    return evaluate.simulated_recall(spark, 4, 10, [0.99, 0.98, 0.97, 0.96, 0.95], 200)
