"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Cue words by kind for the invented texts of the tables: function words, as these hold no others.
CUES = {"ally": ["of", "with"], "family": ["and", "or"], "foe": ["the", "a"]}

#: The order-succession graph and its symmetric form.
F1 = """nodes AS (SELECT CAST(c_custkey AS BIGINT) AS node FROM customer),
edges AS (SELECT DISTINCT CAST(a.o_custkey AS BIGINT) AS src, CAST(b.o_custkey AS BIGINT) AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderpriority = '1-URGENT' AND a.o_custkey <> b.o_custkey),
und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges),
sym AS (SELECT a AS src, b AS dst FROM und UNION ALL SELECT b, a FROM und),
deg AS (SELECT n.node, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, coalesce(d.k, 0) AS degree FROM nodes n LEFT JOIN (SELECT dst, count(*) AS k FROM edges GROUP BY dst) i ON i.dst = n.node LEFT JOIN (SELECT src, count(*) AS k FROM edges GROUP BY src) o ON o.src = n.node LEFT JOIN (SELECT src, count(*) AS k FROM sym GROUP BY src) d ON d.src = n.node)"""
W = f"WITH {F1}"
#: Weak components of F1 by contraction is for Spark; SQL walks from each node.
CC = """cc AS (SELECT node, min(m) AS component FROM (WITH RECURSIVE walk(node, m) AS (SELECT node, node FROM nodes UNION SELECT s.dst, w.m FROM walk w JOIN sym s ON s.src = w.node WHERE w.m <= s.dst) SELECT * FROM walk) GROUP BY node),
sizes AS (SELECT component, count(*) AS size FROM cc GROUP BY component),
big AS (SELECT node FROM cc WHERE component = (SELECT component FROM sizes ORDER BY size DESC, component LIMIT 1))"""
#: All hop distances along the arrows.
DIST = """dist AS (WITH RECURSIVE walk(source, node, d) USING KEY (source, node) AS (SELECT node, node, 0 FROM nodes UNION SELECT w.source, e.dst, min(w.d + 1) FROM walk w JOIN edges e ON e.src = w.node LEFT JOIN recurring.walk r ON r.source = w.source AND r.node = e.dst WHERE r.node IS NULL GROUP BY w.source, e.dst) SELECT source, node, d AS dist FROM walk)"""
UDIST = DIST.replace("dist AS", "udist AS", 1).replace("JOIN edges e", "JOIN sym e")
