import pytest
from oracle import DATA, check, connection

from vecspark import queries, scenarios

MORE = sorted(n for n, f in queries.QUERIES.items() if f.__module__ == scenarios.__name__)


@pytest.fixture(scope="module")
def con():
    return connection(f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", MORE)
def test_scenario_matches_sql(spark, con, name):
    check(queries.QUERIES[name](spark, f"{DATA}/sf0.001"), con, queries.ORACLE_SQL[name])


def test_probes_are_whole_where_points_outnumber_the_list(spark, monkeypatch):
    monkeypatch.setattr(scenarios, "LONG", 5)
    check(queries.QUERIES["pag_graph_probes"](spark, f"{DATA}/sf0.01"), connection(f"{DATA}/sf0.01"), queries.ORACLE_SQL["pag_graph_probes"])
