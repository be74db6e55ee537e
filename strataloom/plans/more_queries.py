"""Queries on settings, serving, prompts and reports, over tables made of columns in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.scoring import as_score
from ..operators import governance, graph, history, incremental, index, notes, parsers, prompts, resolve, search
from ..sources import git_log
from . import generate
from .catalog import query, table


def _s(c):
    return c.cast("string")


@query("""SELECT CASE doc_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'info' END AS severity, count(*) AS n FROM documents GROUP BY 1""")
def severity_counts(spark, sf_dir):
    key = F.col("doc_id") % 3
    return governance.severity_counts(table(spark, sf_dir, "documents").select(F.when(key == 0, "error").when(key == 1, "warn").otherwise("info").alias("severity")))


@query("""SELECT sum(CASE WHEN o_orderkey % 3 <> 0 THEN o_shippriority + 0.5::DOUBLE END)::DOUBLE AS cost, (sum(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 1000 END))::BIGINT AS duration_ms, count(*) AS calls FROM (SELECT *, o_orderkey % 7 AS o_shippriority FROM orders)""")
def usage_totals(spark, sf_dir):
    """Halves add up exactly in any order."""
    key = F.col("o_orderkey")
    return prompts.usage(table(spark, sf_dir, "orders").select(F.when(key % 3 != 0, key % 7 + F.lit(0.5)).alias("cost"), F.when(key % 5 != 0, key % 1000).alias("duration_ms")))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'hook' WHEN p_partkey % 4 = 0 THEN 'type-definition' WHEN p_partkey % 4 = 1 AND p_size % 2 = 0 THEN 'service' WHEN p_size % 7 = 0 THEN 'service' ELSE 'utility' END AS file_type FROM part""")
def prompt_file_type(spark, sf_dir):
    key, size, none = F.col("p_partkey"), F.col("p_size"), F.array().cast("array<string>")
    name = F.when(key % 4 == 0, F.when(key % 8 == 0, "src/A.DTO.ts").otherwise("src/a.models.tsx")).when(key % 4 == 1, "src/dto.ts").otherwise("src/a.modelx.ts")
    exports = F.when((key % 4 == 1) & (size % 2 == 0), F.when(key % 8 == 1, F.array(F.lit("x"), F.lit("userstore"))).otherwise(F.array(F.lit("TaskManager")))).otherwise(F.array(F.lit("ManagerOf")))
    kind = prompts.file_type(name, F.when(size % 5 == 0, F.array(F.lit("useX"))).otherwise(none), exports, F.when(size % 7 == 0, F.array(F.lit("/api"))).otherwise(none))
    return table(spark, sf_dir, "part").select(key.alias("id"), kind.alias("file_type"))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS path, l_suppkey AS dep FROM lineitem), a AS (SELECT s_suppkey AS dep, ['f' || s_suppkey, s_name] AS exports FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT path, list(dep || ':' || array_to_string(exports, ',') ORDER BY dep) AS told FROM e JOIN a USING (dep) GROUP BY path""")
def dependency_exports(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    key = F.col("s_suppkey")
    exports = F.when(key % 3 != 0, F.array(F.concat(F.lit("f"), _s(key)), F.col("s_name"))).otherwise(F.array().cast("array<string>"))
    found = prompts.dependency_exports(edges, table(spark, sf_dir, "supplier").select(key.alias("path"), exports.alias("exports")))
    return found.select("path", F.transform(F.map_entries("dependency_exports"), lambda e: F.concat(_s(e["key"]), F.lit(":"), F.array_join(e["value"], ","))).alias("told"))


GO_SQL = """own AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 3 = 0 THEN 'svc/b' || (p_partkey // 50) ELSE 'lib' END AS dir, CASE WHEN p_partkey % 3 = 0 THEN 'example.com/svc' || (p_partkey // 50) ELSE 'example.com/root' END AS module FROM part)"""


@query(f"""WITH {GO_SQL} SELECT dir || '/f' || n || '.go' AS src, dir || '/p' || (n % 3) || '/a.go' AS dst FROM own WHERE n % 3 = 0 UNION ALL
SELECT dir || '/f' || n || '.go', 'lib/p1/a.go' FROM own WHERE n % 3 <> 0""")
def go_edges(spark, sf_dir):
    """Each file imports a package of the nearest module above it, one of another module, and one of the library."""
    key = F.col("p_partkey")
    block = _s(F.floor(key / 50))
    part = table(spark, sf_dir, "part")
    nested = key % 3 == 0
    where = F.when(nested, F.concat(F.lit("svc/b"), block)).otherwise("lib")
    own_module = F.when(nested, F.concat(F.lit("example.com/svc"), block)).otherwise("example.com/root")
    wanted = F.when(nested, F.concat(own_module, F.lit("/p0"))).otherwise(F.concat(own_module, F.lit("/lib/p1")))
    body = F.concat(F.lit('package a\nimport (\n\t"'), wanted, F.lit('"\n\t"example.com/elsewhere/x"\n\t"fmt"\n)\n'))
    sources = part.select(F.concat(where, F.lit("/f"), _s(key), F.lit(".go")).alias("path"), body.alias("content"))
    packages = part.where(nested).select(F.concat(where, F.lit("/p0/a.go")).alias("path"), F.lit("package p\n").alias("content")).distinct()
    root = spark.createDataFrame([("go.mod", "module example.com/root\n"), ("lib/p1/a.go", "package p\n")], "path string, content string")
    mods = part.where(nested).select(F.concat(where, F.lit("/go.mod")).alias("path"), F.concat(F.lit("module "), own_module, F.lit("\n\ngo 1.22\n")).alias("content")).distinct()
    files = sources.unionByName(packages).unionByName(root).unionByName(mods)
    modules = parsers.go_modules(files)
    go = files.where(F.col("path").endswith(".go"))
    return generate.dependency_edges(parsers.analyses(go, modules=modules), go.select("path"), modules=modules)


@query("""SELECT 'src/d' || (p_partkey % 9) || '/f' || p_partkey || '.ts' AS file, CASE WHEN p_partkey % 3 = 0 THEN '../x/a' ELSE './b' END AS specifier,
CASE WHEN p_partkey % 3 = 0 THEN 'src/x/a.ts' ELSE 'src/d' || (p_partkey % 9) || '/b/index.ts' END AS path, CASE WHEN p_partkey % 3 = 0 THEN 0.9 ELSE 0.4 END::DECIMAL(6,2) AS score FROM part WHERE p_partkey % 4 <> 0 AND (p_partkey % 3 = 0 OR p_partkey % 9 < 6)""")
def hover_lookup(spark, sf_dir):
    key = F.col("p_partkey")
    spec = F.when(key % 4 == 0, "axios").when(key % 3 == 0, "../x/a").otherwise("./b")
    imports = table(spark, sf_dir, "part").select(F.concat(F.lit("src/d"), _s(key % 9), F.lit("/f"), _s(key), F.lit(".ts")).alias("file"), spec.alias("specifier"))
    known = [("src/x/a.ts", 90), ("src/x/a.tsx", 10), ("src/x/a/index.ts", 20), *((f"src/d{k}/b/index.ts", 40) for k in range(6))]
    entries = spark.createDataFrame(known, "path string, points int").select("path", as_score(F.col("points")).alias("score"))
    return resolve.hovers(imports, entries)


@query("""SELECT c_custkey AS id, '## f' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN chr(10) || '  score: +0.25' ELSE chr(10) || '  score: -0.10' END ||
CASE WHEN c_custkey % 3 = 0 THEN chr(10) || '  purpose:' || chr(10) || '    + ' || c_mktsegment || chr(10) || '    - old' ELSE '' END AS report FROM customer""")
def diff_report(spark, sf_dir):
    key = F.col("c_custkey")
    delta = as_score(F.when(key % 4 == 0, 0).when(key % 4 == 1, 25).otherwise(-10))
    none = F.array().cast("array<string>")
    fields = {"purpose": (F.when(key % 3 == 0, F.array("c_mktsegment")).otherwise(none), F.when(key % 3 == 0, F.array(F.lit("old"))).otherwise(none)), "invariants": (none, none)}
    return table(spark, sf_dir, "customer").select(key.alias("id"), text.diff_report(F.concat(F.lit("f"), _s(key)), delta, fields).alias("report"))


ENTRIES_SQL = "own AS (SELECT 'p/' || c_mktsegment || '/f' || c_custkey AS path, c_mktsegment AS domain, ((c_custkey * 7) % 101)::INT AS points, c_custkey % 5 = 0 AS stale FROM customer), e AS (SELECT *, (points * 0.01)::DECIMAL(6,2) AS score FROM own)"


def entries(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("p/"), "c_mktsegment", F.lit("/f"), _s(key)).alias("path"), F.col("c_mktsegment").alias("domain"), as_score(key * 7 % 101).alias("score"), (key % 5 == 0).alias("stale"), F.concat(F.lit("does "), _s(key)).alias("purpose"))


@query(f"WITH {ENTRIES_SQL} SELECT 'BUILDING' AS domain, count(*) AS files, round(sum(score) / count(*), 2)::DOUBLE AS average FROM e WHERE domain = 'BUILDING'")
def domain_summary(spark, sf_dir):
    return index.domain_summary(entries(spark, sf_dir), "BUILDING").withColumn("average", F.col("average").cast("double"))


@query(f"WITH {ENTRIES_SQL} SELECT count(*) AS total_files, count_if(stale)::BIGINT AS stale_files, round(sum(score) / count(*), 2)::DOUBLE AS average FROM e")
def index_totals(spark, sf_dir):
    return index.totals(entries(spark, sf_dir)).withColumn("average", F.col("average").cast("double"))


@query(f"""WITH {ENTRIES_SQL}, g AS (SELECT domain, max(score) AS best, count(*) AS n FROM e GROUP BY domain)
SELECT domain, best, NULL AS score, NULL AS path, '## ' || domain || ' — ' || n || ' files' AS text FROM g
UNION ALL SELECT e.domain, g.best, e.score, e.path, '- `' || e.path || '` (' || e.score || ') does ' || split_part(e.path, '/f', -1) FROM e JOIN g ON g.domain = e.domain""")
def index_markdown(spark, sf_dir):
    """A line is a row. The heading's rounded average is left out; all else is compared."""
    return index.markdown(entries(spark, sf_dir)).withColumn("text", F.when(F.col("path").isNull(), F.regexp_replace("text", ", average [^,]*$", "")).otherwise(F.col("text")))


@query("""WITH RECURSIVE items AS (SELECT l_partkey AS src, l_partkey // 20 AS package, l_partkey % 20 + 1 + l_linenumber % 4 AS spot FROM lineitem),
edges AS (SELECT src, package * 20 + CASE WHEN spot < 20 THEN spot WHEN package % 3 = 0 THEN spot % 20 ELSE 19 END AS dst FROM items), nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
hub AS (SELECT min(src) AS start FROM edges), links AS (SELECT DISTINCT src, dst FROM edges),
up(node, level) AS (SELECT start, 0 FROM hub UNION SELECT e.src, b.level + 1 FROM up b JOIN links e ON e.dst = b.node WHERE b.level < 2),
down(node, level) AS (SELECT start, 0 FROM hub UNION SELECT e.dst, b.level + 1 FROM down b JOIN links e ON e.src = b.node WHERE b.level < 2),
focus AS (SELECT node FROM (SELECT node FROM up UNION SELECT node FROM down) WHERE node % 10 <> 3 OR node IN (SELECT start FROM hub)),
wide AS (SELECT node FROM nodes WHERE node % 100 >= 40 AND node % 10 <> 3)
SELECT 'focus' AS mode, src, dst FROM edges WHERE src IN (SELECT node FROM focus) AND dst IN (SELECT node FROM focus)
UNION ALL SELECT 'all', src, dst FROM edges WHERE src IN (SELECT node FROM wide) AND dst IN (SELECT node FROM wide)""")
def focus_subgraph(spark, sf_dir):
    """A score threshold and hidden domains; in focus the threshold does not count."""
    from .graph_queries import edges

    own = edges(spark, sf_dir)
    nodes = graph.nodes(own).select("node", F.concat(F.lit("d"), _s(F.col("node") % 10)).alias("domain"), as_score(F.col("node") % 100).alias("score"))
    first = own.agg(F.min("src")).first()[0]
    focus = graph.visible(nodes, own, 0.4, ("d3",), first, 2).select(F.lit("focus").alias("mode"), "src", "dst")
    return focus.unionByName(graph.visible(nodes, own, 0.4, ("d3",)).select(F.lit("all").alias("mode"), "src", "dst"))


@query("""WITH now AS (SELECT l_orderkey AS path, l_suppkey AS dep, 'h' || (l_suppkey % 4) AS hash FROM lineitem GROUP BY 1, 2), was AS (SELECT path, dep, 'old' AS hash FROM now WHERE path % 3 = 0)
SELECT path, dep, hash FROM was UNION ALL SELECT path, dep, hash FROM now WHERE path NOT IN (SELECT path FROM was)""")
def fingerprint_bootstrap(spark, sf_dir):
    now = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_suppkey").alias("dep")).distinct().withColumn("hash", F.concat(F.lit("h"), _s(F.col("dep") % 4)))
    return incremental.bootstrapped(now.where("path % 3 = 0").withColumn("hash", F.lit("old")), now)


@query("""SELECT 'src/g' || (p_partkey % 25) || '/f' || p_partkey || '.ts' AS path, CASE p_partkey % 25 WHEN 0 THEN 'a.md' WHEN 1 THEN 'c.md' ELSE 'm.md' END AS doc FROM part WHERE p_partkey % 25 IN (0, 1, 2) AND p_partkey <> 25
UNION ALL SELECT 'src/g0/f25.ts', 'b.md' WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = 25)""")
def governance_lookup(spark, sf_dir):
    """Its own path, else a directory above that is known, else a mapped directory."""
    key = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("src/g"), _s(key % 25), F.lit("/f"), _s(key), F.lit(".ts")).alias("path"))
    known = [("src/g0", ["a.md"], [], []), ("src/g0/f25.ts", ["b.md"], ["x"], []), ("src/g1", ["c.md"], [], ["y"]), ("src/g", ["no.md"], [], [])]
    mapped = spark.createDataFrame([("m.md", "src/g2/"), ("m.md", "src/g0"), ("z.md", "src/g2")], "doc string, pattern string")
    out = governance.governed(files, spark.createDataFrame(known, "path string, governing_docs array<string>, constraints array<string>, decisions array<string>"), mapped)
    return out.select("path", F.col("governing_docs")[0].alias("doc"))


@query("""SELECT p_partkey::VARCHAR AS doc, 'src/' || p_partkey AS "from", 'lib/' || (p_size % 9) AS "to" FROM part WHERE p_size % 4 <> 3""")
def forbidden_rules(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    verb = F.when(size % 4 == 0, " must not depend on ").when(size % 4 == 1, " Cannot import from ").when(size % 4 == 2, " should reach into ").otherwise(" may reach ")
    said = F.concat(F.lit("Here `src/"), _s(key), F.lit("`"), verb, F.lit("`lib/"), _s(size % 9), F.lit("`, and src/a must not use src/a."))
    return governance.forbidden_rules(table(spark, sf_dir, "part").select(_s(key).alias("path"), said.alias("content"))).select("doc", "from", "to")


@query("""SELECT p_partkey AS id, ['run' || p_partkey || '(a: number): Promise<void>', 'class C' || p_partkey || ' { go(x: string): void; stop() }', 'interface I { a: string; b?: number }', 'type T = { k: "' || p_brand || '"; n: 1 }', 'enum E { A, B }'] AS signatures,
p_size % 2 = 0 AS effects, CASE WHEN p_size % 3 = 0 THEN ['/own/' || p_partkey] ELSE [] END AS calls FROM part""")
def signature_forms(spark, sf_dir):
    """Classes with their methods, interfaces with their properties; a pattern and a package of the settings' own."""
    key, size = F.col("p_partkey"), F.col("p_size")
    source = F.concat(
        F.lit("import q from '"), F.when(size % 2 == 0, "my-tracker/x").otherwise("path"), F.lit("'\nexport class C"), _s(key), F.lit(" extends B {\n  private p = 1\n  go(x: string): void { if (x) { y() } }\n  private no() {}\n  stop() {}\n}\nexport enum E { A = 1, B }\n"),
        F.lit("export interface I { a: string; b?: number }\nexport type T = { k: \""), "p_brand", F.lit("\"; n: 1 }\nexport async function run"), _s(key), F.lit("(a: number): Promise<void> { "), F.when(size % 3 == 0, F.concat(F.lit("callOwn('/own/"), _s(key), F.lit("')"))).otherwise(""), F.lit(" }\n"),
    )
    options = parsers.Options((r"callOwn\('([^']+)'", "(unclosed"), ("my-tracker",))
    out = parsers.analyses(table(spark, sf_dir, "part").select(F.concat(F.lit("f"), _s(key), F.lit(".ts")).alias("path"), source.alias("content")), options)
    return out.select(F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("id"), "signatures", F.col("has_side_effects").alias("effects"), F.col("api_calls").alias("calls"))


@query("""WITH c AS (SELECT o_orderkey AS n, 'f' || o_custkey AS name, o_orderdate AS at FROM orders)
SELECT CASE WHEN substr(name, 2)::BIGINT % 3 = 0 THEN 'g' || substr(name, 2) ELSE name END AS file, n::VARCHAR AS commit FROM c
UNION ALL SELECT DISTINCT 'g' || substr(name, 2), 'r' || substr(name, 2) FROM c WHERE substr(name, 2)::BIGINT % 3 = 0""")
def renamed_history(spark, sf_dir):
    """Every third file gets another name after its last commit; its history is under that name."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_custkey")
    own = orders.select(F.concat(F.lit("f"), _s(key)).alias("file"), _s(F.col("o_orderkey")).alias("commit"), F.col("o_orderdate").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("was"))
    moved = orders.where(key % 3 == 0).select(key).distinct().select(F.concat(F.lit("g"), _s(key)).alias("file"), F.concat(F.lit("r"), _s(key)).alias("commit"), F.lit("2100-01-01").cast("timestamp").alias("at"), F.concat(F.lit("f"), _s(key)).alias("was"))
    return git_log.followed(own.unionByName(moved)).select("file", "commit")


FUZZY_SQL = r"""
words AS (SELECT doc_id AS key, field, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM (SELECT doc_id, 'text' AS field, text AS t FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents)),
lens AS (SELECT key, field, len(w) AS length FROM words WHERE len(w) > 0), stats AS (SELECT field, count(*) AS n, avg(length) AS mean FROM lens GROUP BY field),
tf AS (SELECT key, field, term, count(*) AS tf FROM (SELECT key, field, unnest(w) AS term FROM words) GROUP BY 1, 2, 3),
q AS (SELECT * FROM (VALUES ('licens'), ('tokne'), ('src1')) v(word)),
near AS (SELECT term, word, levenshtein(term, word) AS edit, greatest(1, round(0.2 * length(word)))::INT AS most FROM (SELECT DISTINCT term FROM tf), q),
hits AS (SELECT term, max(CASE WHEN term = word THEN 1.0::DOUBLE WHEN starts_with(term, word) THEN 0.375::DOUBLE * length(word) / length(term) WHEN edit BETWEEN 1 AND most THEN 0.45::DOUBLE / (1 + edit) END) AS weight FROM near GROUP BY term),
own AS (SELECT tf.*, weight FROM tf JOIN hits USING (term) WHERE weight IS NOT NULL), df AS (SELECT term, field, count(*) AS df FROM own GROUP BY 1, 2),
s AS (SELECT key, sum(weight * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (0.5::DOUBLE + tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * length / mean)))) AS score, list_sort(list(DISTINCT field)) AS fields
 FROM own JOIN df USING (term, field) JOIN lens USING (key, field) JOIN stats USING (field) GROUP BY key)"""


@query(f"WITH {FUZZY_SQL} SELECT key, fields, row_number() OVER (ORDER BY round(score, 9) DESC, key) AS rank FROM s ORDER BY rank LIMIT 20")
def fuzzy_search(spark, sf_dir):
    """Prefix and fuzzy terms too; ranks, not scores, are compared."""
    from pyspark.sql import Window

    own = search.text_index(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", ["text", "source"], blocks=False)
    best = search.search(own, "licens tokne src1", 20)
    return best.select("key", "fields", F.row_number().over(Window.orderBy(F.desc("score"), "key")).cast("long").alias("rank")).orderBy("rank")
