"""Queries on the dependency graph. Every line item is an import: its part depends on one of the next parts of its package.

A package has PACKAGE parts; beyond its end the import wraps round in every third package, which makes cycles there, and stays
at the last part in others. So nodes and edges grow with the tables, and what a node reaches is bounded by its package.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import as_score, is_hotspot
from ..functions.storage import saved
from ..operators import delta, graph, index
from .catalog import query, table

PACKAGE = 20
EDGES = f"""items AS (SELECT l_partkey AS src, l_partkey // {PACKAGE} AS package, l_partkey % {PACKAGE} + 1 + l_linenumber % 4 AS spot FROM lineitem),
edges AS (SELECT src, package * {PACKAGE} + CASE WHEN spot < {PACKAGE} THEN spot WHEN package % 3 = 0 THEN spot % {PACKAGE} ELSE {PACKAGE} - 1 END AS dst FROM items)"""
ALL = f"{EDGES}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"
HUB = f"{ALL}, hub AS (SELECT dst AS start FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
REACH = f"{ALL}, links AS (SELECT DISTINCT src, dst FROM edges), reach(start, node) AS (SELECT src, dst FROM links UNION SELECT r.start, e.dst FROM reach r JOIN links e ON e.src = r.node)"


def edges(spark, sf_dir, *more):
    package, at = F.floor(F.col("l_partkey") / PACKAGE), F.col("l_partkey") % PACKAGE + 1 + F.col("l_linenumber") % 4
    to = F.when(at < PACKAGE, at).when(package % 3 == 0, at % PACKAGE).otherwise(PACKAGE - 1)
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (package * PACKAGE + to).alias("dst"), *more)


def hub(own):
    return own.groupBy(F.col("dst").alias("start")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "start").limit(1).select("start")


@query(f"""WITH {ALL}, i AS (SELECT dst AS node, count(*) AS c, count(DISTINCT src) AS d FROM edges GROUP BY dst), o AS (SELECT src AS node, count(*) AS c FROM edges GROUP BY src)
SELECT node, coalesce(i.c, 0) AS consumers, coalesce(o.c, 0) AS dependencies, coalesce(i.d, 0) AS distinct_consumers FROM nodes LEFT JOIN i USING (node) LEFT JOIN o USING (node)""")
def reverse_graph(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


@query(f"WITH {ALL} SELECT node, coalesce(list(src ORDER BY src) FILTER (src IS NOT NULL), []) AS consumers FROM nodes LEFT JOIN edges ON dst = node GROUP BY node")
def consumer_lists(spark, sf_dir):
    own = edges(spark, sf_dir)
    return graph.reverse(own, graph.nodes(own))


@query(f"""WITH RECURSIVE {HUB}, bfs(node, level) AS (SELECT start, 0 FROM hub UNION SELECT e.src, b.level + 1 FROM bfs b JOIN edges e ON e.dst = b.node WHERE b.level < 4)
SELECT node, min(level) AS level FROM bfs WHERE node NOT IN (SELECT start FROM hub) GROUP BY node""")
def impact_bfs(spark, sf_dir):
    own = edges(spark, sf_dir)
    return graph.impact(own, hub(own), 4).where("start != node").select("node", "level")


@query(f"""WITH RECURSIVE {REACH}, p AS (SELECT * FROM reach WHERE start <> node)
SELECT node, coalesce(f, 0) AS transitive_dependencies, coalesce(b, 0) AS transitive_dependents FROM nodes
LEFT JOIN (SELECT start AS node, count(*) AS f FROM p GROUP BY 1) USING (node) LEFT JOIN (SELECT node, count(*) AS b FROM p GROUP BY 1) USING (node)""")
def reachability(spark, sf_dir):
    return graph.closure_counts(edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {REACH}, m AS (SELECT a.start AS node, b.start AS other FROM reach a JOIN reach b ON a.node = b.start AND b.node = a.start)
SELECT node, least(node, min(other)) AS component FROM m GROUP BY node""")
def scc_members(spark, sf_dir):
    return graph.strong_components(edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {REACH}, own AS (SELECT node, least(node, min(other)) AS component FROM (SELECT a.start AS node, b.start AS other FROM reach a JOIN reach b ON a.node = b.start AND b.node = a.start) GROUP BY node),
inside AS (SELECT l.src, l.dst, a.component FROM links l JOIN own a ON a.node = l.src JOIN own b ON b.node = l.dst AND a.component = b.component),
walk(component, node, level, path) AS (SELECT component, component, 0, [component] FROM own WHERE node = component
UNION ALL SELECT w.component, i.dst, w.level + 1, min(list_append(w.path, i.dst)) FROM walk w JOIN inside i ON i.component = w.component AND i.src = w.node WHERE w.level < {PACKAGE} AND (w.level = 0 OR w.node <> w.component) GROUP BY w.component, i.dst, w.level)
SELECT component, array_to_string(arg_min(path, level), ' ') AS cycle FROM walk WHERE level > 0 AND node = component GROUP BY component""")
def cycle_witness(spark, sf_dir):
    return graph.cycle_witnesses(edges(spark, sf_dir)).select("component", F.array_join("cycle", " ").alias("cycle"))


#: Imports shipped late come and those returned early go.
CAME, WENT = "l_shipdate >= DATE '1998-08-01'", "l_returnflag = 'R' AND l_shipdate < DATE '1992-06-01'"


@query(f"""WITH RECURSIVE {REACH.replace("FROM lineitem", f"FROM lineitem WHERE NOT ({WENT})")}, m AS (SELECT a.start AS node, b.start AS other FROM reach a JOIN reach b ON a.node = b.start AND b.node = a.start)
SELECT node, least(node, min(other)) AS component FROM m GROUP BY node""")
def components_after_changes(spark, sf_dir):
    """Components of the graph before some imports came and others went, changed to those of the graph as it is then."""
    own = saved(edges(spark, sf_dir, F.expr(CAME).alias("came"), F.expr(WENT).alias("went")), "edges")
    before = saved(graph.strong_components(own.where("NOT came")), "before")
    after = saved(own.where("NOT went").select("src", "dst").distinct(), "after")  # rounds of a search read them
    return delta.applied(before, delta.components(before, own.where("went"), own.where("came"), after))


CHAIN = "links AS (SELECT s_suppkey AS src, s_suppkey + 1 AS dst FROM supplier UNION SELECT s_suppkey, 1 FROM supplier WHERE s_suppkey % 9 = 0)"


@query(f"""WITH {CHAIN}, n AS (SELECT DISTINCT unnest([src, dst]) AS node FROM links), top AS (SELECT max(src) AS ring FROM links WHERE dst = 1 AND src > 1), ends AS (SELECT min(node) AS first, max(node) AS last FROM n)
SELECT n.node, (last - n.node + CASE WHEN n.node BETWEEN 1 AND ring THEN n.node - 1 ELSE 0 END)::BIGINT AS transitive_dependencies,
(CASE WHEN n.node BETWEEN 1 AND ring THEN ring - first ELSE n.node - first END)::BIGINT AS transitive_dependents FROM n, top, ends""")
def chain_reach(spark, sf_dir):
    """One path through all suppliers, from every ninth of which an edge leads back to the first: what each reaches, however long the path."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("src"))
    links = own.select("src", (F.col("src") + 1).alias("dst")).union(own.where("src % 9 = 0").select("src", F.lit(1).cast("long")))
    return graph.closure_counts(links)


CONNECTED = "edges AS (SELECT l_orderkey AS src, l_orderkey * 3 // 5 + l_linenumber AS dst FROM lineitem WHERE l_orderkey * 3 // 5 + l_linenumber <> l_orderkey)"


@query(f"""WITH RECURSIVE {CONNECTED}, links AS (SELECT DISTINCT src, dst FROM edges), own AS (SELECT DISTINCT unnest([src, dst]) AS node FROM links),
low AS (SELECT node FROM own WHERE node <= 20), reach(start, node) AS (SELECT src, dst FROM links WHERE src <= 20 UNION SELECT r.start, e.dst FROM reach r JOIN links e ON e.src = r.node),
m AS (SELECT a.start AS node, b.start AS other FROM reach a JOIN reach b ON a.node = b.start AND b.node = a.start)
SELECT node, least(node, min(other)) AS component FROM m GROUP BY node""")
def connected_components(spark, sf_dir):
    """A graph that hangs together: an order depends on some of about three fifths its number, so all lead to a few cycles among the least."""
    to = F.floor(F.col("l_orderkey") * 3 / 5) + F.col("l_linenumber")
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), to.cast("long").alias("dst"))
    return graph.strong_components(own.where("src != dst"))


EGO = f"""{HUB}, up(node, level) AS (SELECT start, 0 FROM hub UNION SELECT e.src, b.level + 1 FROM up b JOIN edges e ON e.dst = b.node WHERE b.level < 2),
down(node, level) AS (SELECT start, 0 FROM hub UNION SELECT e.dst, b.level + 1 FROM down b JOIN edges e ON e.src = b.node WHERE b.level < 2),
u AS (SELECT node, min(level) AS level FROM up GROUP BY node), d AS (SELECT node, min(level) AS level FROM down GROUP BY node),
hops AS (SELECT node, coalesce(-u.level, d.level) AS hop FROM u FULL JOIN d USING (node))"""


@query(f"WITH RECURSIVE {EGO} SELECT node, hop FROM hops")
def ego_network(spark, sf_dir):
    own = edges(spark, sf_dir)
    start = hub(own)
    return graph.ego(own, start, 2).where(~F.col("node").isin(start.first()[0]) | (F.col("hop") == 0))


@query(f"""WITH RECURSIVE {EGO}, links AS (SELECT DISTINCT src, dst FROM edges), reach(start, node) AS (SELECT src, dst FROM links UNION SELECT r.start, e.dst FROM reach r JOIN links e ON e.src = r.node),
c AS (SELECT DISTINCT a.start AS node FROM reach a JOIN reach b ON a.node = b.start AND b.node = a.start)
SELECT DISTINCT src, dst, CASE WHEN a.hop >= 0 AND b.hop > a.hop THEN 'down' WHEN b.hop <= 0 AND a.hop < b.hop THEN 'up' ELSE 'neutral' END AS direction,
src IN (SELECT node FROM c) AND dst IN (SELECT node FROM c) AS in_cycle FROM edges JOIN hops a ON a.node = src JOIN hops b ON b.node = dst""")
def ego_edges(spark, sf_dir):
    own = edges(spark, sf_dir)
    return graph.edge_directions(own, ego_network(spark, sf_dir), graph.strong_components(own))


@query(f"WITH {ALL}, kept AS (SELECT node FROM nodes WHERE node % 5 <> 0) SELECT src, dst FROM edges WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept)")
def visible_subgraph(spark, sf_dir):
    own = edges(spark, sf_dir)
    return graph.induced(own, graph.nodes(own).where("node % 5 != 0"))


@query(f"""WITH {ALL}, near AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) WHERE a <> b)
SELECT a AS node, CASE WHEN b % 10 < 8 THEN 'd' || (b % 10) ELSE 'unknown' END AS domain, count(*) AS n FROM near GROUP BY 1, 2""")
def neighbor_domains(spark, sf_dir):
    own = edges(spark, sf_dir)
    named = graph.nodes(own).where("node % 10 < 8").withColumn("domain", F.concat(F.lit("d"), (F.col("node") % 10).cast("string")))
    return graph.neighbour_domains(own, named)


@query(f"""WITH RECURSIVE {REACH}, c AS (SELECT DISTINCT a.start AS node FROM reach a JOIN reach b ON a.node = b.start AND b.node = a.start),
i AS (SELECT dst AS node, count(*) AS c FROM edges GROUP BY dst), t AS (SELECT node, count(*) AS n FROM reach WHERE start <> node GROUP BY node)
SELECT node, coalesce(i.c, 0) AS consumers, coalesce(t.n, 0) AS dependents, node IN (SELECT node FROM c) AS in_cycle,
coalesce(i.c, 0) >= 3 AND coalesce(t.n, 0) >= 5 AND node % 2 = 0 AS hotspot FROM nodes LEFT JOIN i USING (node) LEFT JOIN t USING (node)""")
def file_analysis(spark, sf_dir):
    """Degrees, closures, cycles and hotspots of all nodes at once; a score of 0.2 for each consumer, odd nodes are tested."""
    own = saved(edges(spark, sf_dir), "edges")
    all_ = graph.degrees(own).join(graph.closure_counts(own), "node").join(graph.strong_components(own).select("node", F.lit(True).alias("cyclic")), "node", "left")
    hot = is_hotspot(F.col("consumers") * 0.2, F.col("transitive_dependents"), F.col("node") % 2 != 0)
    return all_.select("node", "consumers", F.col("transitive_dependents").alias("dependents"), F.coalesce("cyclic", F.lit(False)).alias("in_cycle"), hot.alias("hotspot"))


@query(f"WITH {ALL} SELECT src, dst FROM edges WHERE src % 50 <> 0 UNION ALL SELECT node AS src, node + 1 AS dst FROM nodes WHERE node % 50 = 0 AND node IN (SELECT src FROM edges)")
def edge_replace(spark, sf_dir):
    own = edges(spark, sf_dir)
    files = own.where("src % 50 = 0").select("src").distinct()
    return graph.with_replaced(own, files.select("src", (F.col("src") + 1).alias("dst")), files)


@query(f"""WITH {ALL} SELECT node::VARCHAR AS path, if(node % 4 = 0, '.', 'd' || (node % 10)) AS domain, if(node % 4 = 0, 0, (node % 100) * 0.01)::DECIMAL(6,2) AS score FROM nodes""")
def graph_nodes(spark, sf_dir):
    own = graph.nodes(edges(spark, sf_dir))
    known = own.where("node % 4 != 0").select(F.col("node").cast("string").alias("path"), F.concat(F.lit("d"), (F.col("node") % 10).cast("string")).alias("domain"), as_score(F.col("node") % 100).alias("score"))
    return index.graph_nodes(own.select(F.col("node").cast("string").alias("path")), known)


@query(f"WITH {EDGES} SELECT count(*) AS edges, count(DISTINCT src) AS sources FROM edges")
def edge_totals(spark, sf_dir):
    return edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"))


@query(f"WITH {EDGES} SELECT dst AS node, count(*) AS consumers FROM edges GROUP BY dst ORDER BY consumers DESC, node LIMIT 5")
def top_consumers(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir)).where("consumers > 0").orderBy(F.desc("consumers"), "node").limit(5).select("node", "consumers")
