import inspect
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_conftest import frame, prose
from oracle import DATA, check, connection

from vecspark.llm import decontaminate, queries
from vecspark.storage import worker_cache


def brute(text, items, n):
    words = decontaminate.words_of(None if text is None else text.encode())
    hit, found = set(), set()
    for item, t in items:
        for w in decontaminate.windows_of(decontaminate.words_of(None if t is None else t.encode()), n):
            for s in range(len(words) - len(w) + 1):
                if tuple(words[s : s + len(w)]) == w:
                    hit |= set(range(s, s + len(w)))
                    found.add(str(item))
    return len(words), sorted(hit), sorted(found)


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_matches_sql(spark, sf):
    check(queries.op2_decontaminate(spark, f"{DATA}/{sf}"), connection(f"{DATA}/{sf}"), queries.ORACLE_SQL["op2_decontaminate"])


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_small_alphabet_against_brute_force(spark, block_bytes):
    draw = random.Random(4)
    make = lambda k: " ".join(draw.choice(["a", "B", "c,", "É"]) for _ in range(k))
    texts = [make(draw.randint(0, 60)) for _ in range(80)] + [None, ""]
    items = [(i, make(draw.randint(0, 9))) for i in range(12)] + [(50, None), (51, ""), (52, "a b"), (53, "a b")]
    got = decontaminate.contamination(frame(spark, texts), items_of(spark, items), n=4, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_words, r.hits, r["items"]) for r in got} == {i: brute(t, items, 4) for i, t in enumerate(texts)}


def test_odd_rows(spark, odd, odd_rows, nothing):
    items = items_of(spark, [(1, odd_rows[6][1]), (2, None)])
    rows = decontaminate.digests(decontaminate.contamination(odd, items)).collect()
    assert len(rows) == len(odd_rows)
    assert {r.doc_id for r in rows if r.contaminated} == {6, 7, 8}
    kept = decontaminate.clean_documents(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - 4
    assert decontaminate.contamination(nothing, items).collect() == []
    free = decontaminate.contamination(odd, items.limit(0)).collect()
    assert len(free) == len(odd_rows) and not any(r.hits or r.items for r in free)


def test_proximity(spark):
    docs = frame(spark, ["one two x three four", "one two three four", "one x x x x two three", "two one"])
    items = items_of(spark, [(9, "one two three")])
    got = {r.doc_id: r.items for r in decontaminate.contamination(docs, items, n=3, slop=1).collect()}
    assert got == {0: ["9"], 1: ["9"], 2: [], 3: []}
    lists = [np.array([4, 20]), np.array([5, 23])]
    assert decontaminate.near(lists, [0, 1], 0).tolist() == [4]
    assert decontaminate.near(lists, [0, 1], 2).tolist() == [4, 20]


@pytest.mark.parametrize("block_bytes", [1, 25, 1 << 20])
def test_rows_of_equal_or_no_id_stay_apart_in_any_blocks(spark, block_bytes):
    texts = [(3, "a b c d"), (3, "e f g"), (3, "a b c d"), (None, "a b c x"), (None, "nothing here"), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    items = [(1, "a b c"), (2, "e f g"), (2, "x"), (None, "b c"), (None, "here"), (5, None)]
    got = decontaminate.contamination(docs, items_of(spark, items), n=3, block_bytes=block_bytes).collect()
    named = [("" if i is None else i, t) for i, t in items]
    want = sorted((i is None, i or 0, *brute(t, named, 3)) for i, t in texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.hits, r.items) for r in got) == want
    kept = decontaminate.clean_documents(docs, items_of(spark, items), n=3, block_bytes=block_bytes).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(4, None)]


def test_segments_of_any_size_find_the_same(spark):
    draw = random.Random(8)
    texts = [" ".join(draw.choice("abcdef") for _ in range(draw.randint(0, 40))) for _ in range(60)]
    items = items_of(spark, [(i, " ".join(draw.choice("abcdef") for _ in range(5))) for i in range(6)])
    whole = decontaminate.search(decontaminate.build_index(frame(spark, texts)), decontaminate.Phrases([(r.item_id, r.text.encode()) for r in items.collect()], 3))
    parts = decontaminate.search(decontaminate.build_index(frame(spark, texts), segment_bytes=30), decontaminate.Phrases([(r.item_id, r.text.encode()) for r in items.collect()], 3))
    assert sorted((r.id, r.hits, r["items"]) for r in whole.collect()) == sorted((r.id, r.hits, r["items"]) for r in parts.collect())


def test_stage_of_the_pipeline_looks_at_a_megabyte_at_once(monkeypatch):
    plain, sizes, text = decontaminate.postings, [], prose(3, 200)
    monkeypatch.setattr(decontaminate, "postings", lambda texts: sizes.append(sum(map(len, texts))) or plain(texts))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5000)), "text": [text] * 5000})
    run = inspect.signature(decontaminate.clean_documents).parameters["segment_bytes"].default
    kept = list(decontaminate.clean_rows(iter([batch]), decontaminate.Phrases([(1, b"of no text " * 4)], 10), "text", run))
    assert sum(x.num_rows for x in kept) == 5000 and sum(sizes) == 5000 * len(text.encode())
    assert len(sizes) > 4 and max(sizes) <= 1 << 20  # all at once before


def test_worker_gives_back_what_other_stages_kept():
    worker_cache(("codec", "x", True), lambda: bytes(1 << 20))
    list(decontaminate.clean_rows(iter([]), decontaminate.Phrases([], 10), "text", 1 << 20))
    assert worker_cache(("codec", "x", True), lambda: None) is None  # the megabyte before
