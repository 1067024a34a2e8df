"""Static, quantised and dynamic indices over tables ``id``, ``v``[, ``labels``].

``StaticIndex`` walks sharded graphs; ``QuantisedIndex`` ranks by product
quantisation and reranks exactly (the role of an index on disk); ``PagIndex``
probes aggregation points' lists; ``DynamicIndex`` takes inserts and deletes.
Saved indices are folders of Parquet tables with a JSON file of settings.
"""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.metrics import METRICS
from vecspark.functions.vectors import mips_base, mips_query, normalised
from vecspark.operators import dynamic, evaluate, exact, graph, pag, partition, pq
from vecspark.operators.graph import GraphParams
from vecspark.plans.params import IndexConfig, list_size_for
from vecspark.storage import stored


def _settings(spark: SparkSession, path: str, values: dict | None = None) -> dict:
    """Written or read through Spark, so that any of its file systems serves."""
    place = f"{path}/settings"
    if values is not None:
        spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(place)
        return values
    return json.loads(spark.read.text(place).first()[0])


def unit_rows(df: DataFrame) -> DataFrame:
    """Vectors normalised, for graphs over cosine: squared distance ranks alike."""
    return df.withColumn("v", normalised("v"))


#: Bytes of a task's memory that a shard's graph may take.
BUDGET = float(1 << 30)
#: Rows of a shard, on average: a shard is built in one task, whose time grows faster than its rows.
SHARD_ROWS = 2048


def shard_centres(rows: DataFrame, dim: int, params: GraphParams, shards: int | None, replicas: int, budget: float, seed: int, shard_rows: int = SHARD_ROWS) -> np.ndarray | None:
    """Centres of ``shards`` shards, or of as many as the budget and ``shard_rows`` ask for; none where one shard does.

    Two ``shards`` or more are the least: they are cut finer where they would
    outgrow ``shard_rows``, so that the tasks that build them do not grow with the table.
    """
    if shards is None:
        n = rows.count()
        parts = -(-n * replicas // shard_rows)
        if partition.ram_estimate(max(n * replicas // parts, 1) if n > shard_rows else n, dim, params.degree) > budget:
            return partition.centres_for_budget(rows, budget, dim, params.degree, replicas, seed=seed)
        return None if n <= shard_rows else partition.sampled_centres(rows, parts, 5, seed)
    if shards == 1:
        return None
    parts = -(-rows.count() * replicas // shard_rows)
    return partition.kmeans(rows, shards, 5, seed) if parts <= shards else partition.sampled_centres(rows, parts, 5, seed)


def in_shards(rows: DataFrame, centres: np.ndarray | None, replicas: int) -> DataFrame:
    """``shard``, ``id``, ``v``."""
    if centres is None:
        return rows.select(F.lit(0).alias("shard"), "id", "v")
    return partition.shards(rows, centres, min(replicas, len(centres)))


class StaticIndex:
    """Graphs over overlapping shards; searched shard by shard and merged."""

    def __init__(self, config: IndexConfig, params: GraphParams, rows: DataFrame, graphs: DataFrame, universal: str | None = None):
        self.config, self.params, self.rows, self.graphs, self.universal = config, params, rows, graphs, universal

    @classmethod
    def build(cls, rows: DataFrame, config: IndexConfig, params: GraphParams = GraphParams(), shards: int | None = None, replicas: int = 2, filtered: bool = False, stitched: GraphParams | None = None, universal: str | None = None, seed: int = 0, budget: float = BUDGET, codes: int | None = None) -> StaticIndex:
        """k-means shards, each row in its ``replicas`` nearest; or one stitched graph of labels' graphs.

        Without ``shards`` there are as many as keep the largest one within
        ``budget`` bytes of a task's memory; two or more are the least, cut finer
        on larger tables. With ``codes`` (bytes a row) the rows
        are found by their quantised vectors while building; pruning stays exact.
        """
        if rows.isEmpty():
            raise ValueError("no rows to index")
        x = exact.vectors(rows, "id", "v", *(["labels"] if "labels" in rows.columns else []))
        if x.where(F.size("v") != config.dim).limit(1).count():
            raise ValueError(f"vectors of other than {config.dim} dimensions")
        walked = unit_rows(x) if config.metric == "cosine" else x
        if config.metric == "mips":
            walked = mips_base(x, "v").drop("v").withColumnRenamed("prepared", "v")
        dim = config.dim + (config.metric == "mips")
        if stitched is not None:
            most = max(1, int(budget / partition.ram_estimate(1, dim, stitched.degree)))
            made = graph.stitched(walked, params, stitched, most)
        else:
            centres = shard_centres(walked, dim, params, shards, replicas, budget, seed)
            placed = in_shards(walked, centres, replicas)
            book = None if codes is None else pq.trained(walked, codes, seed=seed)
            made = graph.built(placed.join(walked.select("id", "labels"), "id") if filtered else placed, params, filtered, book)
        return cls(config, params, x, stored(made, "graph"), universal)

    def search(self, queries: DataFrame, k: int, complexity: int = 100, labels_col: str | None = None) -> DataFrame:
        """``qid``, ``rank``, ``id``, ``dist`` in the index's metric, reranked by exact distance."""
        size = list_size_for(k, complexity)
        q = exact.vectors(queries, "id", "v", *([labels_col] if labels_col else []))
        walked = q
        if self.config.metric == "cosine":
            walked = unit_rows(q)
        elif self.config.metric == "mips":
            walked = q.withColumn("v", mips_query("v"))
        found = graph.searched(self.graphs, walked, k, size, self.universal, labels_col=labels_col)
        if self.config.metric == "l2":
            return found
        own = METRICS[self.config.metric]
        scored = found.select("qid", "id").join(self.rows.select("id", "v"), "id").join(q.select(F.col("id").alias("qid"), F.col("v").alias("qv")), "qid").withColumn("dist", own.column("qv", "v"))
        return exact.top_k(scored, k, F.col("dist") * own.sign).select("qid", "rank", "id", "dist")

    def vector(self, ids: DataFrame) -> DataFrame:
        return self.rows.join(ids.select("id"), "id", "left_semi")

    def save(self, path: str) -> None:
        spark = self.rows.sparkSession
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.graphs.write.mode("overwrite").parquet(f"{path}/graphs")
        _settings(spark, path, {"config": vars(self.config), "params": vars(self.params), "universal": self.universal})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> StaticIndex:
        s = _settings(spark, path)
        return cls(IndexConfig(**s["config"]), GraphParams(**s["params"]), spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/graphs"), s["universal"])


class QuantisedIndex:
    """Codes guide, exact distances decide: a shortlist by lookup tables, reranked."""

    def __init__(self, config: IndexConfig, rows: DataFrame, book: pq.Codebook):
        if config.metric == "cosine":
            raise ValueError("normalise the vectors and use l2")
        self.config, self.rows, self.book = config, rows, book

    @classmethod
    def build(cls, rows: DataFrame, config: IndexConfig, chunks: int, centres: int = pq.CENTRES, rotated: bool = False, seed: int = 0) -> QuantisedIndex:
        x = exact.vectors(rows, "id", "v", *(["labels"] if "labels" in rows.columns else []))
        if rotated:
            return cls(config, x, pq.trained_rotated(x, chunks, centres, seed=seed))
        return cls(config, x, pq.trained(x, chunks, centres, zero_mean=config.metric == "l2", seed=seed))

    def __len__(self) -> int:
        return self.rows.count()

    def codes(self, ids: DataFrame) -> DataFrame:
        """``id``, ``code`` of some rows."""
        return pq.encoded(self.rows.join(ids.select("id"), "id", "left_semi"), self.book)

    def about(self) -> dict:
        """Rows, dimensions, metric and bytes of a code."""
        return {"rows": len(self), "dim": self.config.dim, "metric": self.config.metric, "chunks": self.book.chunks}

    def search(self, queries: DataFrame, k: int, factor: int = 3, labels_col: str | None = None, universal: str | None = None) -> DataFrame:
        """The ``k`` nearest of a shortlist of ``factor * k``; with ``labels_col`` among rows of the queries' labels."""
        return pq.reranked(self.rows, queries, self.book, k, factor, self.config.metric, labels_col=labels_col, universal=universal)

    def within(self, queries: DataFrame, radius: float, least: int = 100, most: int = 10_000) -> DataFrame:
        """Rows within ``radius``: the shortlist doubles while over half of it lies inside."""
        size = least
        while True:
            found = pq.reranked(self.rows, queries, self.book, size, 1, self.config.metric).where(F.col("dist") <= radius)
            full = found.groupBy("qid").count().where(F.col("count") >= size / 2).limit(1).count()
            if not full or size >= most:
                return found.select("qid", "id", "dist")
            size = min(size * 2, most)


    def save(self, path: str, clusters: int = 8) -> None:
        """Rows are laid out by nearest centre and place in it, so that near rows share files."""
        spark = self.rows.sparkSession
        laid = partition.clustered(self.rows, partition.kmeans(self.rows, clusters, 3))
        if "labels" in self.rows.columns:
            laid = laid.join(self.rows.select("id", "labels"), "id").repartitionByRange("centre", "position").sortWithinPartitions("centre", "position")
        laid.drop("centre", "position").write.mode("overwrite").parquet(f"{path}/rows")
        pq.encoded(self.rows, self.book).write.mode("overwrite").parquet(f"{path}/codes")
        flat = [(j, c, row.tolist()) for j, book in enumerate(self.book.centres) for c, row in enumerate(book)]
        spark.createDataFrame(flat, "chunk int, code int, centre array<double>").write.mode("overwrite").parquet(f"{path}/codebook")
        turn = self.book.rotation
        _settings(spark, path, {"config": vars(self.config), "bounds": list(self.book.bounds), "mean": self.book.mean.tolist(), "rotation": None if turn is None else turn.tolist()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuantisedIndex:
        s = _settings(spark, path)
        flat = spark.read.parquet(f"{path}/codebook").orderBy("chunk", "code").collect()  # chunks x centres rows
        centres = tuple(np.array([r.centre for r in flat if r.chunk == j]) for j in range(len(s["bounds"]) - 1))
        turn = None if s["rotation"] is None else np.array(s["rotation"])
        return cls(IndexConfig(**s["config"]), spark.read.parquet(f"{path}/rows"), pq.Codebook(tuple(s["bounds"]), centres, np.array(s["mean"]), turn))


class PagIndex:
    """Aggregation points, the graph over them, and their lists."""

    def __init__(self, params: pag.PagParams, rows: DataFrame, aggs: DataFrame, lists: DataFrame, radius: DataFrame, graphs: DataFrame):
        self.params, self.rows, self.aggs, self.lists, self.radius, self.graphs = params, rows, aggs, lists, radius, graphs

    @classmethod
    def build(cls, rows: DataFrame, params: pag.PagParams = pag.PagParams(), rule: str = "radii", links: GraphParams = GraphParams(degree=32, list_size=64), rounds: int = 2, budget: float = BUDGET, seed: int = 0) -> PagIndex:
        """A graph over the sampled points gives the radii, by which the others choose lists; promoted points join the graph."""
        x = exact.vectors(rows, "id", "v")
        first, _ = pag.aggregation_points(x, params)
        first = stored(first, "points")
        if first.isEmpty():
            raise ValueError("no row was sampled: raise sample_rate")
        dim = first.select(F.size("v")).first()[0]
        centres = shard_centres(first, dim, links, None, 2, budget, seed)
        graphs = stored(graph.built(in_shards(first, centres, 2), links), "graph")
        lengths = stored(graph.edge_lengths(graph.united(graphs), first), "lengths")
        radius = stored(pag.radii(lengths, params) if not lengths.isEmpty() else first.select("id", F.lit(0.0).alias("radius")), "radius")
        aggs, lists = pag.built(x, params, rule, rounds, radius=radius)
        aggs = stored(aggs, "points")
        later = aggs.join(first.select("id"), "id", "left_anti")
        if not later.isEmpty():
            graphs = stored(graph.grown(graphs, in_shards(later, centres, 2), links), "graph")
            lengths = graph.edge_lengths(graph.united(graphs).join(later.select("id"), "id", "left_semi"), aggs)
            radius = stored(radius.unionByName(pag.radii_below(lengths, later, radius, params)), "radius")
        return cls(params, x, aggs, lists, radius, graphs)

    def probes(self, queries: DataFrame, nprobe: int | None, how: str = "walk", complexity: int = 100) -> DataFrame:
        """``qid``, ``agg_id``, ``agg_dist``: the lists each query reads.

        ``walk``: the ``nprobe`` nearest points that a walk finds; ``route``: those
        on its way until the radii say stop, in reach of the nearest; ``exact``: the
        nearest of all points.
        """
        if how == "exact":
            return pag.probed(self.aggs, queries, nprobe)
        named = lambda df: df.select("qid", F.col("id").alias("agg_id"), F.col("dist").alias("agg_dist"))
        if how == "walk":
            return named(graph.searched(self.graphs, queries, nprobe, max(nprobe, complexity)))
        if how != "route":
            raise ValueError(f"unknown way {how!r}")
        path = named(graph.routed(self.graphs, self.radius, queries, self.params.early_stop))
        return pag.stopped_early(path, self.radius, self.params.early_stop)

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, how: str = "walk", complexity: int = 100) -> DataFrame:
        return pag.search(self.rows, self.aggs, self.lists, queries, self.probes(queries, nprobe, how, complexity), k)

    def save(self, path: str) -> None:
        """Lists are stored sorted by aggregation point, so that a probe reads few row groups."""
        self.lists.repartitionByRange("agg_id").sortWithinPartitions("agg_id", "dist").write.mode("overwrite").parquet(f"{path}/lists")
        for name, df in (("rows", self.rows), ("aggs", self.aggs), ("radius", self.radius), ("graphs", self.graphs)):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        _settings(self.rows.sparkSession, path, {"params": vars(self.params)})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PagIndex:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(pag.PagParams(**_settings(spark, path)["params"]), read("rows"), read("aggs"), read("lists"), read("radius"), read("graphs"))


class DynamicIndex:
    """Live rows, tombstones and the shards' graphs in versioned folders.

    New rows are inserted into the graphs of their nearest shards; deleted ones are
    left out of results at once, and of the graphs when deletes are consolidated.
    Once the live rows outgrow the shards' budget the graphs are built anew over more.
    """

    def __init__(self, spark: SparkSession, config: IndexConfig, path: str, params: GraphParams = GraphParams(degree=32, list_size=64), budget: float = BUDGET, replicas: int = 2):
        self.spark, self.config, self.path, self.params, self.budget, self.replicas = spark, config, path, params, budget, replicas
        self.live = spark.createDataFrame([], "id bigint, v array<double>")
        self.dead = spark.createDataFrame([], "id bigint")
        self.graphs = spark.createDataFrame([], graph.GRAPH)
        self.centres: np.ndarray | None = None
        if config.metric == "mips":
            raise ValueError("inner products need the largest norm beforehand: use a static index")

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        place = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)

    def _walked(self, df: DataFrame) -> DataFrame:
        return unit_rows(df) if self.config.metric == "cosine" else df

    def __len__(self) -> int:
        return dynamic.active(self.live, self.dead).count()

    def insert(self, rows: DataFrame) -> DataFrame:
        """Status of each row: 0 inserted, -1 refused. A batch beyond the capacity is refused whole, with an error."""
        if rows.where((F.col("id") == 0) | F.col("id").isNull()).limit(1).count():
            raise ValueError("id 0 is reserved")
        if rows.where(F.size("v") != self.config.dim).limit(1).count():
            raise ValueError(f"vectors of other than {self.config.dim} dimensions")
        if self.config.max_vectors is not None:
            if not dynamic.capacity_check(self.live.count(), self.dead.count(), rows.count(), self.config.max_vectors):
                self.consolidate()
        status = self._keep("status", dynamic.insert_status(rows.select("id", F.col("v").cast("array<double>").alias("v")), self.live))
        fresh = status.where("status = 0").drop("status")
        self.live = self._keep("live", self.live.unionByName(fresh))
        shards = 1 if self.centres is None else len(self.centres)
        each = self.live.count() * (self.replicas if shards > 1 else 1) // shards
        if each > SHARD_ROWS or partition.ram_estimate(each, self.config.dim, self.params.degree) > self.budget:
            walked = self._walked(self.live)
            self.centres = shard_centres(walked, self.config.dim, self.params, None, self.replicas, self.budget / 2, 0, SHARD_ROWS // 2)
            self.graphs = self._keep("graphs", graph.built(in_shards(walked, self.centres, self.replicas), self.params))
        else:
            self.graphs = self._keep("graphs", graph.grown(self.graphs, in_shards(self._walked(fresh), self.centres, self.replicas), self.params))
        return status.select("id", "status")

    def delete(self, ids: DataFrame) -> DataFrame:
        """Marks ids deleted; returns those that do not live."""
        failed = self._keep("failed", dynamic.failed_deletes(dynamic.active(self.live, self.dead), ids))
        gone = ids.select(F.col("id").cast("bigint").alias("id")).distinct().join(failed, "id", "left_anti")
        self.dead = self._keep("dead", self.dead.unionByName(gone).distinct())
        return failed

    def consolidate(self) -> DataFrame:
        """Drops deleted rows and repairs the edges that led to them."""
        left, report = dynamic.consolidated(self.live, self.dead)
        report = self._keep("report", report)
        self.graphs = self._keep("graphs", graph.shrunk(self.graphs, self.dead, self.params))
        self.live = self._keep("live", left)
        self.dead = self.spark.createDataFrame([], "id bigint")
        return report

    def search(self, queries: DataFrame, k: int, complexity: int = 100) -> DataFrame:
        """The ``k`` nearest live rows that a walk over the graphs finds; deleted rows lead on but are no results."""
        size = list_size_for(k, complexity)
        live = graph.searched(self.graphs, self._walked(exact.vectors(queries, "id", "v")), k, size, without=self.dead)
        if self.config.metric == "cosine":
            live = live.withColumn("dist", F.col("dist") / 2)
        return live

    def search_exact(self, queries: DataFrame, k: int) -> DataFrame:
        return exact.knn(dynamic.active(self.live, self.dead), queries, k, self.config.metric)

    def save(self, path: str) -> None:
        """Pending deletes are consolidated first."""
        if not self.dead.isEmpty():
            self.consolidate()
        self.live.write.mode("overwrite").parquet(f"{path}/rows")
        self.graphs.write.mode("overwrite").parquet(f"{path}/graphs")
        _settings(self.spark, path, {"config": vars(self.config), "params": vars(self.params), "budget": self.budget, "replicas": self.replicas, "centres": None if self.centres is None else self.centres.tolist()})

    @classmethod
    def load(cls, spark: SparkSession, path: str, work: str) -> DynamicIndex:
        s = _settings(spark, path)
        index = cls(spark, IndexConfig(**s["config"]), work, GraphParams(**s["params"]), s["budget"], s["replicas"])
        index.centres = None if s["centres"] is None else np.array(s["centres"])
        index.live, index.graphs = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/graphs")
        return index


def answer(spark: SparkSession, body: str, indices: dict[str, StaticIndex], default_list: int = 100) -> str:
    """A JSON request ``{query, k, query_id, Ls}`` over several indices, answered in JSON: the body of a search service."""
    begun = time.time()
    asked = json.loads(body)
    k, size = int(asked["k"]), int(asked.get("Ls", default_list))
    if k <= 0 or k > size:
        raise ValueError(f"k={k} must lie between 1 and Ls={size}")
    queries = spark.createDataFrame([(int(asked.get("query_id", 0)), [float(x) for x in asked["query"]])], "id bigint, v array<double>")
    metric_name = next(iter(indices.values())).config.metric
    rows = exact.merged({name: index.search(queries, k, size) for name, index in indices.items()}, k, metric_name).orderBy("rank").collect()
    return json.dumps({"query_id": asked.get("query_id", 0), "k": k, "indices": [r.id for r in rows], "distances": [r.dist for r in rows], "partition": [r.part for r in rows], "time_taken_in_us": int((time.time() - begun) * 1e6)})


def sweep(index, queries: DataFrame, truth: DataFrame, k: int, sizes: list[int]) -> DataFrame:
    """``size``, ``seconds``, ``qps``, ``at``, ``recall``: a search for each list size, with recall at 1 to ``k``."""
    spark, n, rows = queries.sparkSession, queries.count(), []
    for size in sizes:
        if size < k:
            continue
        begun = time.time()
        found = stored(index.search(queries, k, size), "sweep")
        seconds = time.time() - begun
        rows += [(size, seconds, n / seconds, at, evaluate.recall_at(truth, found, at).first().recall) for at in range(1, k + 1)]
    return spark.createDataFrame(rows, "size int, seconds double, qps double, at int, recall double")


def random_vectors(spark: SparkSession, n: int, dim: int, size: float = 1.0, kind: str = "float", seed: int = 0) -> DataFrame:
    """``id``, ``v``: random directions of a given norm; bytes are rounded, unsigned ones around 128."""
    if kind not in ("float", "int8", "uint8"):
        raise ValueError(f"unknown element type {kind!r}")

    def run(batches):
        for batch in batches:
            rows = []
            for i in batch["id"]:
                v = np.random.default_rng((seed, int(i))).normal(size=dim)
                v = v / np.linalg.norm(v) * size
                rows.append(v if kind == "float" else np.rint(v) + (128 if kind == "uint8" else 0))
            yield pd.DataFrame({"id": batch["id"], "v": rows})

    return spark.range(n).mapInPandas(run, "id bigint, v array<double>")


def random_labels(spark: SparkSession, n: int, labels: int, how: str = "random", seed: int = 0) -> DataFrame:
    """``id``, ``labels``: each label at even odds, by Zipf's law (0.7 / i), or one each."""
    if how not in ("random", "zipf", "one_per_point"):
        raise ValueError(f"unknown distribution {how!r}")

    def run(batches):
        for batch in batches:
            rows = []
            for i in batch["id"]:
                draw = np.random.default_rng((seed, int(i)))
                if how == "one_per_point":
                    rows.append([str(int(draw.integers(1, labels + 1)))])
                else:
                    odds = 0.5 if how == "random" else 0.7 / np.arange(1, labels + 1)
                    rows.append([str(j + 1) for j in np.flatnonzero(draw.random(labels) < odds)] or ["0"])
            yield pd.DataFrame({"id": batch["id"], "labels": rows})

    return spark.range(n).mapInPandas(run, "id bigint, labels array<string>")
