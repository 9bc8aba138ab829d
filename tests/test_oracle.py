"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connection, differences

from linkscope import queries as Q

SF = "/root/testdata/sf0.001"
Q.load()
#: All-pairs walks take SQL and Spark several seconds each; one of a kind is enough here.
SLOW = {"gr19_round_trips", "gr20_distance_band_pool", "gr22_eccentricity", "gr23_aspl", "gr24_reachability", "ce2_harmonic", "ce2_harmonic_directed", "ce5_pagerank", "ce5_pagerank_top", "ce10_score_sources", "ce14_agreement", "gr15_strong_components", "gr18_shortest_path", "gr36_distance_lookup", "ce1_closeness", "gr25_asymmetric_links"}


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(set(Q.ORACLE_SQL) - SLOW))
def test_same_as_sql(spark, duck, name):
    assert differences(spark, Q.QUERIES, Q.ORACLE_SQL, name, SF, duck) == ""
