import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import DATA

from vecspark.llm import queries, shards


def test_fisher_yates_is_a_uniform_permutation():
    seen = Counter(tuple(shards.fisher_yates(3, (7, i))) for i in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850
    assert sorted(shards.fisher_yates(1000, (1,)).tolist()) == list(range(1000))
    assert shards.fisher_yates(0, (1,)).tolist() == [] and shards.fisher_yates(1, (1,)).tolist() == [0]


def test_query_obeys_the_law(spark):
    sf = f"{DATA}/sf0.001"
    docs = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op3_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


@pytest.mark.parametrize("bucket_bytes", [1 << 25, 20_000])
def test_same_order_whatever_the_partitions(spark, odd, odd_rows, bucket_bytes):
    one, two = (shards.shard_documents(df, 4, bucket_bytes=bucket_bytes) for df in (odd, odd.repartition(7)))
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.text or "", r.shard, r.slot)
    assert sorted(map(key, one.collect())) == sorted(map(key, two.collect()))
    assert len(one.collect()) == len(odd_rows)
    other = shards.shard_documents(odd, 4, seed=18, bucket_bytes=bucket_bytes)
    assert sorted(map(key, other.collect())) != sorted(map(key, one.collect()))


def test_empty_and_written(spark, odd, nothing, tmp_path):
    assert shards.shard_documents(nothing).collect() == []
    shards.write_shards(shards.shard_documents(odd, 3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and {r.shard for r in back.collect()} == {0, 1, 2}


def test_order_is_unrelated_to_ids(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    got = sorted(shards.shard_documents(rows, 1).collect(), key=lambda r: r.slot)
    assert abs(np.corrcoef([r.doc_id for r in got], np.arange(4000))[0, 1]) < 0.06
