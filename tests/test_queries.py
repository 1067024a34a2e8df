import pytest
from oracle import DATA, check, connection

from vecspark.queries import ORACLE_SQL, QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    check(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


#: Least recall of each approximate search at its registered settings.
LEAST = {"vamana_search": 90, "vamana_search_mips": 90, "filtered_vamana_search": 90, "stitched_search": 90, "pq_trained_search": 70, "opq_search": 70, "pag_graph_search": 90}


@pytest.mark.parametrize("name", sorted(LEAST))
def test_approximate_search_reaches_recall(spark, name):
    found = QUERIES[name](spark, SF).collect()
    assert {r.qid for r in found} == {0, 100, 200, 300, 400} and found[0].recall >= LEAST[name]


def test_other_approximate_queries(spark):
    rows = lambda name: QUERIES[name](spark, SF).collect()
    sweep = {(r.size, r["at"]): r.recall for r in rows("search_sweep")}
    assert len(sweep) == 30 and sweep[40, 10] >= 90 and sweep[40, 10] >= sweep[10, 10]
    visits = rows("node_visit_counts")
    assert len(visits) > 100 and max(r.visits for r in visits) == 5
    merged = rows("merged_by_search_graph")[0]
    assert merged.max_degree <= 16 and merged.min_degree >= 8
    inside, exact = rows("quantised_range_search"), rows("exact_range")
    assert {(r.qid, r.id) for r in inside} <= {(r.qid, r.id) for r in exact} and len(inside) >= 0.9 * len(exact)
    assert sum(r.n for r in rows("kmeanspp_partition")) == 1000
    assert all(r.norm == 1.0 for r in rows("random_vectors"))
    zipf = {int(r.label): r.n for r in rows("zipf_labels")}
    assert 630 < zipf[1] < 770 and 290 < zipf[2] < 410 and zipf[1] > zipf[2] > zipf[5] > zipf[20]
    simulated = rows("simulated_aggregate_recall")
    assert simulated


def test_entry_lists_every_query(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
