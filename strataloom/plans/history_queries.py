"""Queries on history and scores. A customer plays a file, the week of an order in a block of 50 customers a commit, the order's priority an author.

So a commit has at most 50 files at any size, and pairs of files that share commits grow as the tables do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, scoring
from ..functions.scoring import as_score
from ..operators import history, incremental, index
from .catalog import query, table

CHURN_SQL = """
SELECT o_custkey AS file, count(DISTINCT date_trunc('week', o_orderdate)) AS churn, count(DISTINCT o_orderpriority) AS authors
FROM orders GROUP BY o_custkey"""
PAIRS_SQL = """
own AS (SELECT DISTINCT o_custkey AS file, date_trunc('week', o_orderdate) AS week, o_custkey // 50 AS block FROM orders),
pairs AS (SELECT a.file, b.file AS other, count(*) AS n FROM own a JOIN own b ON a.week = b.week AND a.block = b.block AND a.file <> b.file GROUP BY 1, 2)"""
SIGNALS_SQL = f"""
churned AS ({CHURN_SQL}), {PAIRS_SQL},
most AS (SELECT file, max(n) AS max_cochange FROM pairs GROUP BY file),
value AS (SELECT o_custkey AS file, max(o_totalprice) AS top, count_if(o_orderstatus = 'P')::BIGINT AS pending FROM orders GROUP BY o_custkey),
signals AS (
  SELECT c_custkey AS file, c_mktsegment AS domain, coalesce(pending, 0) AS consumers, c_mktsegment = 'BUILDING' AS has_hooks, c_acctbal < 0 AS has_external_imports,
         c_nationkey % 5 = 0 AS has_env_vars, c_custkey % 7 = 0 AS has_api_calls, c_custkey % 11 = 0 AS has_todo_comments, c_custkey % 3 = 0 AS has_tests,
         coalesce(churn, 0) AS churn, coalesce(authors, 0) AS authors, coalesce(max_cochange, 0) AS max_cochange
  FROM customer LEFT JOIN churned c ON c.file = c_custkey LEFT JOIN most m ON m.file = c_custkey LEFT JOIN value v ON v.file = c_custkey)"""
POINTS = {
    "consumers": "least(10 * consumers, 40)", "hooks": "if(has_hooks, 20, 0)", "external_imports": "if(has_external_imports, 10, 0)", "env_vars": "if(has_env_vars, 10, 0)",
    "api_calls": "if(has_api_calls, 10, 0)", "todo_comments": "if(has_todo_comments, 5, 0)", "untested": "CASE WHEN has_tests THEN 0 WHEN consumers > 0 THEN 15 ELSE 5 END",
    "churn": "least(churn, 15)", "authors": "if(authors > 3, 5, 0)",
    "co_change": "CASE WHEN 10 * max_cochange >= 6 * greatest(churn, 1) AND max_cochange >= 3 THEN 15 WHEN 10 * max_cochange >= 4 * greatest(churn, 1) AND max_cochange >= 2 THEN 10 ELSE 0 END",
}
SCORE_SQL = "(CAST(least(" + " + ".join(POINTS.values()) + ", 100) AS DECIMAL(6,0)) * 0.01)::DECIMAL(6,2)"
SCORED_SQL = f"{SIGNALS_SQL}, scored AS (SELECT *, {SCORE_SQL} AS score FROM signals)"


def commits(spark, sf_dir):
    own = table(spark, sf_dir, "orders")
    return own.select(F.col("o_custkey").alias("file"), F.struct(F.date_trunc("week", "o_orderdate").alias("week"), F.floor(F.col("o_custkey") / 50).alias("block")).alias("commit"), F.col("o_orderpriority").alias("author"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("order"))


def signals(spark, sf_dir):
    """A row of signals for each customer; the flags come from the customer's own columns."""
    own, made = table(spark, sf_dir, "customer"), commits(spark, sf_dir)
    pending = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("consumers"))
    files = own.select(
        F.col("c_custkey").alias("file"), F.col("c_mktsegment").alias("domain"), (F.col("c_mktsegment") == "BUILDING").alias("has_hooks"), (F.col("c_acctbal") < 0).alias("has_external_imports"),
        (F.col("c_nationkey") % 5 == 0).alias("has_env_vars"), (F.col("c_custkey") % 7 == 0).alias("has_api_calls"), (F.col("c_custkey") % 11 == 0).alias("has_todo_comments"), (F.col("c_custkey") % 3 == 0).alias("has_tests"),
    )
    joined = files.join(pending, "file", "left").join(history.churn(made), "file", "left").join(history.max_cochange(made), "file", "left")
    return joined.fillna(0, ["consumers", "churn", "authors", "max_cochange"])


def scored(spark, sf_dir):
    return signals(spark, sf_dir).withColumn("score", as_score(scoring.criticality_points()))


@query(f"WITH {SCORED_SQL} SELECT file, domain, score, consumers, churn, authors, max_cochange FROM scored ORDER BY score DESC, file LIMIT 20")
def criticality(spark, sf_dir):
    return scored(spark, sf_dir).select("file", "domain", "score", "consumers", "churn", "authors", "max_cochange").orderBy(F.desc("score"), "file").limit(20)


@query(f"WITH {SCORED_SQL} SELECT file, score FROM scored")
def criticality_all(spark, sf_dir):
    return scored(spark, sf_dir).select("file", "score")


@query("WITH " + SIGNALS_SQL + " " + " UNION ALL ".join(f"SELECT file, '{t}' AS term, ({sql})::BIGINT AS points, {most}::BIGINT AS most FROM signals" for (t, sql), (_, most) in zip(POINTS.items(), scoring.TERMS, strict=True)))
def score_breakdown(spark, sf_dir):
    return signals(spark, sf_dir).select("file", F.explode(scoring.breakdown()).alias("t")).select("file", "t.term", "t.points", "t.most")


@query(f"WITH {SCORED_SQL} SELECT file, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'mid' ELSE 'low' END AS badge FROM scored")
def score_badge(spark, sf_dir):
    return scored(spark, sf_dir).select("file", scoring.badge(F.col("score")).alias("badge"))


@query("""
WITH r AS (SELECT o_custkey AS file, o_orderkey AS "order", row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders)
SELECT file, "order", rank FROM r WHERE rank <= 10""")
def churn_recent10(spark, sf_dir):
    own = commits(spark, sf_dir).drop("commit").withColumn("commit", F.col("order"))
    return history.recent(own).select("file", "order", F.col("rank").cast("long").alias("rank"))


@query(CHURN_SQL)
def author_count(spark, sf_dir):
    return history.churn(commits(spark, sf_dir))


@query(f"WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, other) AS rank FROM pairs) SELECT * FROM r WHERE rank <= 10")
def cochange_top10(spark, sf_dir):
    return history.cochanged(commits(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH own AS (SELECT DISTINCT l_suppkey AS file, l_orderkey::VARCHAR AS commit FROM lineitem UNION SELECT s_suppkey, 'all' FROM supplier),
pairs AS (SELECT a.file, b.file AS other, count(*) AS n FROM own a JOIN own b ON a.commit = b.commit AND a.file <> b.file GROUP BY 1, 2)
SELECT file, other, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, other) AS rank FROM pairs) WHERE rank <= 10""")
def large_commit(spark, sf_dir):
    """Suppliers of an order change together, and one commit changes all suppliers: it is paired piece by piece."""
    small = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").cast("string").alias("commit"))
    own = small.union(table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("all")))
    return history.cochanged(own).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH churned AS ({CHURN_SQL}), {PAIRS_SQL}, most AS (SELECT file, max(n) AS max_cochange FROM pairs GROUP BY file)
SELECT file, churn, max_cochange, ({POINTS["co_change"]})::BIGINT AS points FROM churned JOIN most USING (file)""")
def cochange_ratio(spark, sf_dir):
    made = commits(spark, sf_dir)
    own = history.churn(made).join(history.max_cochange(made), "file")
    return own.select("file", "churn", "max_cochange", scoring.cochange_points(F.col("max_cochange"), F.col("churn")).cast("long").alias("points"))


BOOST_SQL = """
own AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'src/api/v1/route.ts' WHEN 1 THEN 'lib/a.ts' WHEN 2 THEN 'src/useThing.ts' WHEN 3 THEN 'src/view.tsx' WHEN 4 THEN 'src/a.test.ts' ELSE 'README.md' END AS path,
        CASE o_orderstatus WHEN 'P' THEN 'added' WHEN 'F' THEN 'modified' ELSE 'unchanged' END AS edit, (o_orderkey % 41)::BIGINT AS base FROM orders),
kinds AS (SELECT *, CASE id % 6 WHEN 0 THEN 'api-route' WHEN 1 THEN 'lib' WHEN 2 THEN 'hook' WHEN 3 THEN 'component' WHEN 4 THEN 'skip:test' ELSE 'aux' END AS category FROM own),
boosted AS (SELECT *, CASE WHEN category = 'skip:test' THEN 0 ELSE
   CASE edit WHEN 'added' THEN if(category = 'aux', 10, 40) WHEN 'modified' THEN if(category = 'aux', 5, 15) ELSE 0 END
   + CASE category WHEN 'api-route' THEN 20 WHEN 'lib' THEN 10 WHEN 'hook' THEN 10 WHEN 'component' THEN 5 ELSE 0 END END AS boost FROM kinds)"""


def edited(spark, sf_dir):
    own, key = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    path = F.when(key == 0, "src/api/v1/route.ts").when(key == 1, "lib/a.ts").when(key == 2, "src/useThing.ts").when(key == 3, "src/view.tsx").when(key == 4, "src/a.test.ts").otherwise("README.md")
    edit = F.when(F.col("o_orderstatus") == "P", "added").when(F.col("o_orderstatus") == "F", "modified").otherwise("unchanged")
    return own.select(F.col("o_orderkey").alias("id"), path.alias("path"), edit.alias("edit"), (F.col("o_orderkey") % 41).alias("base"))


@query(f"WITH {BOOST_SQL} SELECT id, category, edit, (CAST(base + boost AS DECIMAL(6,0)) * 0.01)::DECIMAL(6,2) AS score, category = 'skip:test' AS skipped FROM boosted")
def diff_boost(spark, sf_dir):
    own = edited(spark, sf_dir).withColumn("category", paths.category(F.col("path")))
    points = F.col("base") + scoring.boost_points(F.col("category"), F.col("edit"))
    return own.select("id", "category", "edit", as_score(points).alias("score"), paths.is_skipped(F.col("category")).alias("skipped"))


@query(f"""WITH {BOOST_SQL}, forced AS (SELECT id FROM boosted WHERE edit = 'added' AND category NOT IN ('skip:test', 'aux') ORDER BY base DESC, id LIMIT 8)
SELECT b.id, category <> 'skip:test' AND (base + boost >= 50 OR f.id IS NOT NULL) AS uses_llm, base >= 35 AS premium FROM boosted b LEFT JOIN forced f ON f.id = b.id""")
def llm_gate(spark, sf_dir):
    """A small forced set passes whatever its score; the premium tier looks at the score without boosts."""
    own = edited(spark, sf_dir).withColumn("category", paths.category(F.col("path")))
    forced = own.where((F.col("edit") == "added") & paths.is_source(F.col("category"))).orderBy(F.desc("base"), "id").limit(8)
    boosted = F.col("base") + scoring.boost_points(F.col("category"), F.col("edit"))
    gated = own.join(F.broadcast(forced.select("id", F.lit(True).alias("forced"))), "id", "left")
    uses = scoring.synthesis_gate(F.lit(True), paths.is_skipped(F.col("category")), boosted, 50, F.coalesce("forced", F.lit(False)))
    return gated.select("id", uses.alias("uses_llm"), (F.col("base") >= 35).alias("premium"))


@query("""SELECT 'lib/f' || o_orderkey || '.ts' AS path, l AS consumers FROM (SELECT o_orderkey, (o_totalprice / 1000)::BIGINT AS l FROM orders WHERE o_orderstatus = 'P') ORDER BY l DESC, path LIMIT 8""")
def quota_topn(spark, sf_dir):
    own = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("lib/f"), F.col("o_orderkey").cast("string"), F.lit(".ts")).alias("path"), F.lit("added").alias("edit"), F.rint(F.col("o_totalprice") / 1000).cast("long").alias("consumers"))
    return index.quota(own, 8).select("path", "consumers")


@query("""SELECT p_partkey AS part, (sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END))::BIGINT AS hit, count(l_partkey) AS found,
CASE WHEN count(l_partkey) > 0 THEN (sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END))::DOUBLE / count(l_partkey) END AS coverage_pct
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""")
def coverage_ratio(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count_if(F.col("l_returnflag") == "R").alias("hit"), F.count(F.lit(1)).alias("found"))
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")).join(lines, "part", "left").fillna(0, ["hit", "found"])
    return own.withColumn("coverage_pct", F.expr("try_divide(cast(hit as double), found)"))


NOW = "2001-04-01"
INDEX_SQL = f"""
{SCORED_SQL}, entries AS (SELECT 'packages/' || lower(domain) || '/src/f' || file || '.ts' AS path, 'packages/' || lower(domain) AS domain, score, if(has_hooks, 'm1', 'static') AS model,
  last_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS stale FROM scored JOIN (SELECT o_custkey AS file, max(o_orderdate) AS last_at FROM orders GROUP BY 1) USING (file))"""


def entries(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.max("o_orderdate").alias("generated_at"))
    own = scored(spark, sf_dir).join(last, "file")
    path = F.concat(F.lit("packages/"), F.lower("domain"), F.lit("/src/f"), F.col("file").cast("string"), F.lit(".ts"))
    notes = own.select(path.alias("path"), "score", F.when(F.col("has_hooks"), "m1").otherwise("static").alias("model"), "generated_at", F.array().cast("array<string>").alias("purpose_inferred"), F.array(F.lit("a file")).alias("purpose_observed"))
    nobody = spark.createDataFrame([], "node string, consumers array<string>")
    return index.entries(notes, nobody, F.lit(NOW).cast("timestamp"))


@query(f"WITH {INDEX_SQL} SELECT path, domain, score, model, stale FROM entries")
def index_entries(spark, sf_dir):
    return entries(spark, sf_dir).select("path", "domain", "score", "model", "stale")


@query(f"WITH {INDEX_SQL} SELECT count(*) AS total_files, count_if(model <> 'static')::BIGINT AS synthesized_files, count_if(stale)::BIGINT AS stale_files FROM entries")
def index_header(spark, sf_dir):
    return index.header(entries(spark, sf_dir))


@query(f"WITH {INDEX_SQL} SELECT path, score FROM entries WHERE score >= 0.5 ORDER BY score DESC, path LIMIT 20")
def threshold_topk(spark, sf_dir):
    return index.at_least(entries(spark, sf_dir)).select("path", "score")


@query(f"WITH {INDEX_SQL} SELECT path, score FROM entries WHERE domain = 'packages/building'")
def domain_lookup(spark, sf_dir):
    return index.of_domain(entries(spark, sf_dir), "packages/building").select("path", "score")


@query(f"""WITH {INDEX_SQL}, g AS (SELECT domain, count(*) AS files, sum(score)::DECIMAL(16,2) AS score_sum, max(score) AS score_max FROM entries GROUP BY domain)
SELECT *, row_number() OVER (ORDER BY score_sum::DOUBLE / files DESC, domain) AS rank FROM g""")
def domain_breakdown(spark, sf_dir):
    own = index.domains(entries(spark, sf_dir))
    return own.withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {INDEX_SQL} SELECT path, domain, score, max(score) OVER (PARTITION BY domain) AS domain_best FROM entries WHERE score >= 0.4 AND contains(lower(path), 'f1')")
def sidebar_filter(spark, sf_dir):
    return index.sidebar(entries(spark, sf_dir), 0.4, "F1").select("path", "domain", "score", "domain_best")


@query(f"WITH {INDEX_SQL} SELECT path FROM entries WHERE stale")
def update_stale(spark, sf_dir):
    return incremental.update_set(entries(spark, sf_dir))


@query(f"""WITH {SIGNALS_SQL}, c AS (SELECT *, CASE WHEN file % 2 = 0 THEN (file % 100) / 100.0::DOUBLE END AS coverage_pct, has_hooks AS has_side_effects FROM signals)
SELECT file, (if(consumers >= 1 AND NOT has_tests, 1, 0) + if(consumers >= 3 AND coalesce(coverage_pct < 0.5, false), 1, 0) + if(has_env_vars AND NOT has_tests, 1, 0)
 + if(churn >= 10 AND authors >= 3, 1, 0) + if(has_side_effects AND consumers >= 2, 1, 0))::BIGINT AS facts,
 (consumers >= 1 AND NOT has_tests) AS untested, (churn >= 10 AND authors >= 3) AS volatile FROM c""")
def cross_signals(spark, sf_dir):
    own = signals(spark, sf_dir).withColumn("coverage_pct", F.when(F.col("file") % 2 == 0, (F.col("file") % 100) / F.lit(100.0))).withColumn("has_side_effects", F.col("has_hooks"))
    said = own.select("file", scoring.cross_signals().alias("facts"))
    has = lambda start: F.exists("facts", lambda x: F.startswith(x, F.lit(start)))
    return said.select("file", F.size("facts").cast("long").alias("facts"), has("Consumed by").alias("untested"), has("Volatile").alias("volatile"))


@query("""SELECT count(*) AS total, count_if(quality = 1)::BIGINT AS with_tests, count_if(quality = 0)::BIGINT AS without_tests, sum(CASE WHEN toxic = 0 THEN 0.5 END)::DOUBLE AS coverage_sum, count(CASE WHEN toxic = 0 THEN 1 END) AS coverage_files
FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL""")
def repo_stats(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return index.repo_stats(own.select((F.col("quality") == 1).alias("has_tests"), F.when(F.col("toxic") == 0, F.lit(0.5)).alias("coverage_pct")))

