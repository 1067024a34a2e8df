import os

import numpy as np
import pytest

from vecspark.operators import dynamic, labels, partition
from vecspark.operators.graph import GraphParams
from vecspark.plans.indices import DynamicIndex
from vecspark.plans.params import IndexConfig
from vecspark.streaming.window import WindowedTable, check_window


def rows(spark, ids):
    return spark.createDataFrame([(i, [float(i or 0)] * 3) for i in ids], "id bigint, v array<double>")


def test_insert_search_delete_save(spark, tmp_path):
    index = DynamicIndex(spark, IndexConfig(3, max_vectors=4), str(tmp_path / "work"))
    assert {r.id: r.status for r in index.insert(rows(spark, [1, 2, 3])).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.id: r.status for r in index.insert(rows(spark, [3])).collect()} == {3: -1}
    assert index.search(rows(spark, [2]), 1).first().id == 2
    assert [r.id for r in index.delete(rows(spark, [2, 9]).select("id")).collect()] == [9]
    assert index.search(rows(spark, [2]), 1).first().id != 2
    index.insert(rows(spark, [4, 5]))
    assert len(index) == 4
    with pytest.raises(RuntimeError):
        index.insert(rows(spark, [6]))
    with pytest.raises(ValueError):
        index.insert(rows(spark, [0]))
    index.save(str(tmp_path / "saved"))
    again = DynamicIndex.load(spark, str(tmp_path / "saved"), str(tmp_path / "work2"))
    assert sorted(r.id for r in again.live.collect()) == [1, 3, 4, 5]


def test_status_of_odd_rows(spark):
    status = dynamic.insert_status(rows(spark, [7, 7, 0, None, 8]), rows(spark, [8]))
    got = sorted((r.id if r.id is not None else -1, r.status) for r in status.collect())
    assert got == [(-1, -1), (0, -1), (7, -1), (7, 0), (8, -1)]


def test_stream_keeps_the_window(spark, tmp_path):
    import os

    for i in range(4):
        rows(spark, range(1 + i * 10, 11 + i * 10)).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        for f in (tmp_path / f"part{i}").glob("*.parquet"):
            os.makedirs(tmp_path / "in", exist_ok=True)
            f.rename(tmp_path / "in" / f"{i}.parquet")
    table = WindowedTable(spark, str(tmp_path / "table"), window=15)
    seen = []
    stream = spark.readStream.schema("id bigint, v array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table.follow(stream, str(tmp_path / "checkpoint"), lambda live, n: seen.append(live.count())).awaitTermination()
    ids = sorted(r.id for r in table.live().collect())
    assert len(seen) == 4 and len(ids) == 15 and seen[0] == 10
    with pytest.raises(ValueError):
        check_window(10, 5, 12)


def test_unknown_label_is_an_error(spark):
    mapping = spark.createDataFrame([("a", 1)], "label string, label_id int")
    asked = spark.createDataFrame([("b",)], "label string")
    with pytest.raises(Exception, match="unknown label"):
        labels.converted(asked, mapping).collect()
    assert labels.converted(asked, mapping, universal=True).first().label_id == 0


def test_stored_tables_are_released(spark):
    from vecspark import storage

    storage.release(spark)
    kept, named = storage.stored(spark.range(5), "five"), storage.bucketed(spark.range(9), "id", spark.range(9))
    assert kept.count() == 5 and named.count() == 9
    paths = [path for _, path, _ in storage.MADE]
    assert storage.release(spark) == 2 and storage.release(spark) == 0
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_dynamic_index_grows_over_shards_and_repairs_edges(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(301, 4))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) if i], "id bigint, v array<double>")
    params = GraphParams(degree=12, list_size=24)
    index = DynamicIndex(spark, IndexConfig(4), str(tmp_path / "work"), params, budget=partition.ram_estimate(150, 4, 12))
    for low in range(0, 301, 75):
        index.insert(table.where((table.id >= low) & (table.id < low + 75)))
    assert len(index) == 300 and len(index.centres) >= 3
    sizes = [r["count"] for r in index.graphs.groupBy("shard").count().collect()]
    assert max(sizes) <= 200
    index.delete(table.where("id % 3 = 0").select("id"))
    for step in range(2):
        found = index.search(table.where("id <= 40"), 5, 48).collect()
        want = {q: [i for i in np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable") if i and i % 3][:5] for q in range(1, 41)}
        assert all(r.id % 3 for r in found)
        assert sum(r.id in want[r.qid] for r in found) >= 0.95 * 200
        if not step:
            assert index.consolidate().first().deleted == 100
    rows = index.graphs.collect()
    assert all(r.id % 3 and all(j % 3 for j in r.nbrs) and len(r.nbrs) <= 12 for r in rows)
