import pytest

import __spark_entry__ as entry
from denovospark.plans import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
CHEAP = ["targets_pair", "boundary_losses", "word_ions", "word_pair_hits", "event_decharged", "event_pivots", "graph_edges", "kmer_counts", "mass_query", "suffix_ranks", "nearest_line", "type_shares"]


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, name, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""


def test_registry():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and registry.FLAGSHIP in names


def test_entry(spark):
    assert entry.entry(spark).columns == ["spectrum", "n_pairs", "n_hits", "cost_u"]
