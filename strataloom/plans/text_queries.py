"""Queries on text, paths, documents of governance, search and incremental state. Where the tables hold no such text, it is made of their columns in both engines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import business_rules as rules_op
from ..operators import governance, incremental, resolve, search
from ..sources.files import scanned
from ..streaming.watch import debounced
from .catalog import query, table

PATH_SQL = """paths AS (SELECT p_partkey AS id, CASE p_partkey % 12
 WHEN 0 THEN 'packages/' || lower(p_type) || '/src/' || replace(p_name, ' ', '-') || '.ts' WHEN 1 THEN 'src/api/v' || p_size || '/route.ts' WHEN 2 THEN 'src/hooks/useP' || p_partkey || '.ts'
 WHEN 3 THEN 'apps/web/' || replace(p_name, ' ', '/') || '.tsx' WHEN 4 THEN 'src/core/' || replace(p_name, ' ', '_') || '.test.ts' WHEN 5 THEN 'dist/' || p_size || '.js'
 WHEN 6 THEN 'tsconfig.base.json' WHEN 7 THEN 'src/types.ts' WHEN 8 THEN 'docs/' || p_partkey || '.md' WHEN 9 THEN 'src/db/' || replace(p_name, ' ', '-') || '.repository.ts'
 WHEN 10 THEN 'libs/ui/index.ts' ELSE 'README.md' END AS path FROM part)"""


def part_paths(spark, sf_dir):
    own, key = table(spark, sf_dir, "part"), F.col("p_partkey") % 12
    dash = lambda c: F.regexp_replace("p_name", " ", c)
    size, number = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    forms = [
        F.concat(F.lit("packages/"), F.lower("p_type"), F.lit("/src/"), dash("-"), F.lit(".ts")), F.concat(F.lit("src/api/v"), size, F.lit("/route.ts")), F.concat(F.lit("src/hooks/useP"), number, F.lit(".ts")),
        F.concat(F.lit("apps/web/"), dash("/"), F.lit(".tsx")), F.concat(F.lit("src/core/"), dash("_"), F.lit(".test.ts")), F.concat(F.lit("dist/"), size, F.lit(".js")), F.lit("tsconfig.base.json"), F.lit("src/types.ts"),
        F.concat(F.lit("docs/"), number, F.lit(".md")), F.concat(F.lit("src/db/"), dash("-"), F.lit(".repository.ts")), F.lit("libs/ui/index.ts"),
    ]
    path = F.lit("README.md")
    for k, form in reversed(list(enumerate(forms))):
        path = F.when(key == k, form).otherwise(path)
    return own.select(F.col("p_partkey").alias("id"), path.alias("path"))


@query(f"""WITH {PATH_SQL} SELECT DISTINCT path FROM paths WHERE regexp_matches(path, '^(?:.+/)?[^/]*\\.tsx?$')
AND NOT regexp_matches(path, '^dist/.*$|^(?:.+/)?[^/]*\\.test\\.ts$') ORDER BY path""")
def scan_filter(spark, sf_dir):
    return scanned(part_paths(spark, sf_dir).select("path"), ("**/*.ts", "**/*.tsx"), ("dist/**", "**/*.test.ts"))


@query("SELECT doc_id AS path, sha1(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return incremental.hashes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query(f"""WITH {PATH_SQL} SELECT id, CASE WHEN path NOT LIKE '%/%' THEN '.' WHEN split_part(path, '/', 1) IN ('packages', 'apps', 'libs', 'modules', 'services') THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2)
ELSE split_part(path, '/', 1) END AS domain FROM paths""")
def domain_of_path(spark, sf_dir):
    return part_paths(spark, sf_dir).select("id", paths.domain(F.col("path")).alias("domain"))


@query(f"""WITH {PATH_SQL} SELECT id, CASE id % 12 WHEN 0 THEN 'lib' WHEN 1 THEN 'api-route' WHEN 2 THEN 'hook' WHEN 3 THEN 'component' WHEN 4 THEN 'skip:test' WHEN 5 THEN 'skip:generated' WHEN 6 THEN 'skip:config'
WHEN 7 THEN 'skip:type-only' WHEN 8 THEN 'aux' WHEN 9 THEN 'default-source' WHEN 10 THEN 'default-source' ELSE 'aux' END AS category FROM paths""")
def categorize_path(spark, sf_dir):
    return part_paths(spark, sf_dir).select("id", paths.category(F.col("path")).alias("category"))


@query(f"""WITH {PATH_SQL} SELECT id, CASE WHEN id % 12 = 9 THEN 'Data access layer — wraps persistence calls' WHEN id % 12 = 4 THEN 'Test suite' WHEN id % 12 = 2 THEN 'React hook' WHEN id % 12 = 3 THEN 'React component'
WHEN id % 12 = 10 THEN 'Barrel export — public API of the enclosing directory' END AS label FROM paths""")
def filename_label(spark, sf_dir):
    return part_paths(spark, sf_dir).select("id", paths.filename_label(F.col("path")).alias("label"))


SOURCE_SQL = """sources AS (SELECT p_partkey AS id, 'const x = 1' || chr(10) || CASE p_size % 7 WHEN 0 THEN '// TODO: ' || p_name WHEN 1 THEN '  // FIXME ' || p_name WHEN 2 THEN '// HACK: ' || p_name
 WHEN 3 THEN '// CONTRACT: ' || p_name WHEN 4 THEN '// WHY ' || p_name WHEN 5 THEN '// notes on ' || p_name ELSE 'f() // a todo for ' || p_name END || chr(10)
 || 'const MAX_ITEMS = ' || p_size || chr(10) || 'if (n > ' || (p_size * 2) || ') go()' || chr(10) || 'z.string().min(' || p_size || ')' || chr(10) || 'const ' || CASE WHEN p_size % 2 = 0 THEN 'BASE_FEE' ELSE 'retryDelay' END || ' = 3' AS content FROM part)"""


def part_sources(spark, sf_dir):
    own, key, name, size = table(spark, sf_dir, "part"), F.col("p_size") % 7, F.col("p_name"), F.col("p_size").cast("string")
    said = [("// TODO: ", 0), ("  // FIXME ", 1), ("// HACK: ", 2), ("// CONTRACT: ", 3), ("// WHY ", 4), ("// notes on ", 5)]
    comment = F.concat(F.lit("f() // a todo for "), name)
    for start, k in said:
        comment = F.when(key == k, F.concat(F.lit(start), name)).otherwise(comment)
    constant = F.when(F.col("p_size") % 2 == 0, "BASE_FEE").otherwise("retryDelay")
    lines = [F.lit("const x = 1"), comment, F.concat(F.lit("const MAX_ITEMS = "), size), F.concat(F.lit("if (n > "), (F.col("p_size") * 2).cast("string"), F.lit(") go()")), F.concat(F.lit("z.string().min("), size, F.lit(")")), F.concat(F.lit("const "), constant, F.lit(" = 3"))]
    return own.select(F.col("p_partkey").alias("id"), F.concat_ws("\n", *lines).alias("content"))


@query(f"""WITH {SOURCE_SQL} SELECT s.id, CASE p_size % 7 WHEN 0 THEN 'todo' WHEN 1 THEN 'fixme' WHEN 2 THEN 'hack' WHEN 3 THEN 'invariant' WHEN 4 THEN 'decision' ELSE 'todo' END AS tag,
CASE p_size % 7 WHEN 0 THEN 'TODO: ' || p_name WHEN 1 THEN 'FIXME ' || p_name WHEN 2 THEN 'HACK: ' || p_name WHEN 3 THEN 'CONTRACT: ' || p_name WHEN 4 THEN 'WHY ' || p_name ELSE 'a todo for ' || p_name END AS comment
FROM sources s JOIN part ON p_partkey = s.id WHERE p_size % 7 <> 5""")
def comment_tags(spark, sf_dir):
    return text.tagged_comments(part_sources(spark, sf_dir), "id", "content").select("id", "tag", "comment")


@query(f"""WITH {SOURCE_SQL}, r AS (
SELECT id, 0 AS pos, 'numeric_limit' AS type, 3 AS line, 'upper/lower bound constant: MAX_ITEMS =' AS description FROM sources
UNION ALL SELECT s.id, 1, 'numeric_limit', 4, 'Numeric boundary check: > ' || (p_size * 2) FROM sources s JOIN part ON p_partkey = s.id
UNION ALL SELECT id, 2, 'schema_validation', 5, 'Schema constraint: .min( validation' FROM sources
UNION ALL SELECT s.id, 3, 'business_constant', 6, CASE WHEN p_size % 2 = 0 THEN 'Business constant: BASE_FEE' ELSE 'Domain constant: retryDelay' END FROM sources s JOIN part ON p_partkey = s.id)
SELECT id, pos::BIGINT AS pos, type, line::BIGINT AS line, description FROM r""")
def business_rules(spark, sf_dir):
    return rules_op.business_rules(part_sources(spark, sf_dir), "id", "content").select("id", "pos", "type", "line", "description")


@query("""SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS links FROM pages""")
def regex_extract_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sort_array(text.found(F.col("html"), 'href="([^"]+)"')).alias("links"))


WORDS = {"en": (" the ",), "de": (" und ",), "es": (" para ",), "fr": (" pour ",)}


@query("""SELECT doc_id, contains(lower(text), CASE CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END WHEN 'de' THEN ' und ' WHEN 'es' THEN ' para ' WHEN 'fr' THEN ' pour ' ELSE ' the ' END) AS hit FROM documents""")
def keyword_by_language(spark, sf_dir):
    """Every fifth tag is unknown, the others carry a region, so base tags and the fallback are tried too."""
    own = table(spark, sf_dir, "documents")
    tag = F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.concat("lang", F.lit("-R")))
    return own.select("doc_id", text.keyword_hit(F.col("text"), tag, WORDS).alias("hit"))


@query("""SELECT p_partkey AS id, list_filter([CASE WHEN p_size % 3 = 0 THEN 'Reads/writes cache' END, CASE WHEN p_size % 5 = 0 THEN 'Persists data to a database' END, CASE WHEN p_size % 7 = 0 THEN 'HTTP framework entry point' END], lambda x: x IS NOT NULL) AS labels FROM part""")
def import_category(spark, sf_dir):
    size = F.col("p_size")
    imports = F.array_compact(F.array(F.when(size % 3 == 0, "redis"), F.when(size % 5 == 0, "knex/lib"), F.when(size % 7 == 0, "express"), F.lit("redis/none"), F.lit("left-pad")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.import_labels(imports).alias("labels"))


@query("""SELECT p_partkey AS id, p_size % 4 < 2 AS side_effects, CASE WHEN p_size % 3 = 0 THEN 'zod/v4' END AS validation FROM part""")
def import_flags(spark, sf_dir):
    size = F.col("p_size")
    imports = F.array_compact(F.array(F.when(size % 4 == 0, "@Sentry/node"), F.when(size % 4 == 1, "fast-news"), F.when(size % 3 == 0, "zod/v4"), F.lit("path")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.has_side_effects(imports).alias("side_effects"), text.validation_package(imports).alias("validation"))


@query("""WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'perf(core): less' WHEN 1 THEN 'Hotfix for ' || o_orderpriority WHEN 2 THEN 'We chose ' || o_clerk WHEN 3 THEN 'Substituiu X' WHEN 4 THEN 'add a test' ELSE 'REVERT: y' END AS message,
 CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'pt-PT' WHEN 2 THEN 'xx' ELSE 'de' END AS language FROM (SELECT *, 'it' AS o_clerk FROM orders))
SELECT id, id % 6 IN (0, 5) OR (id % 6 = 2 AND language IN ('en', 'xx')) OR (id % 6 = 3 AND language = 'pt-PT') AS decision, regexp_matches(lower(message), 'hotfix|rollback|workaround|revert|hack|fix|breaking') AS risky FROM c""")
def commit_kinds(spark, sf_dir):
    key = F.col("o_orderkey")
    said = [F.lit("perf(core): less"), F.concat(F.lit("Hotfix for "), "o_orderpriority"), F.lit("We chose it"), F.lit("Substituiu X"), F.lit("add a test")]
    message, language = F.lit("REVERT: y"), F.when(key % 4 == 0, "en").when(key % 4 == 1, "pt-PT").when(key % 4 == 2, "xx").otherwise("de")
    for k, form in enumerate(said):
        message = F.when(key % 6 == k, form).otherwise(message)
    own = table(spark, sf_dir, "orders").select(key.alias("id"), message.alias("message"), language.alias("language"))
    return own.select("id", text.is_decision(F.col("message"), F.col("language")).alias("decision"), (F.size(text.risky_messages(F.array("message"))) > 0).alias("risky"))


@query("""WITH own AS (SELECT doc_id AS id, [lang, source, 'a', 'a'] AS new, [lang, 'b', 'b'] AS old FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, [lang, lang], [lang] FROM documents WHERE doc_id % 2 = 1)
SELECT id, list_filter(new, lambda x: NOT list_contains(old, x)) AS added, list_filter(old, lambda x: NOT list_contains(new, x)) AS removed FROM own""")
def note_diff(spark, sf_dir):
    own = table(spark, sf_dir, "documents")
    even = F.col("doc_id") % 2 == 0
    new = F.when(even, F.array("lang", "source", F.lit("a"), F.lit("a"))).otherwise(F.array("lang", "lang"))
    old = F.when(even, F.array("lang", F.lit("b"), F.lit("b"))).otherwise(F.array("lang"))
    return own.select(F.col("doc_id").alias("id"), new.alias("new"), old.alias("old")).select("id", text.bag_minus(F.col("new"), F.col("old")).alias("added"), text.bag_minus(F.col("old"), F.col("new")).alias("removed"))


@query("""SELECT doc_id AS id, list_concat([lang, source], list_filter([' ' || upper(lang) || ' ', 'x', source], lambda y: lower(trim(y)) NOT IN (lang, source))) AS items FROM documents""")
def merge_lists(spark, sf_dir):
    more = F.array(F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")), F.lit("x"), F.col("source"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.merged(F.array("lang", "source"), more).alias("items"))


@query("""WITH imports AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"/]+)"', 1)) AS name FROM pages),
targets AS (SELECT DISTINCT 'src/' || name || CASE WHEN length(name) % 3 = 0 THEN '.ts' WHEN length(name) % 3 = 1 THEN '.js' ELSE '/index.ts' END AS path FROM imports WHERE page_id % 2 = 0 UNION SELECT DISTINCT 'src/' || name || '.js' FROM imports WHERE length(name) % 6 = 0 AND page_id % 2 = 0),
c AS (SELECT page_id, name, unnest([{'r': 0, 'p': 'src/' || name}, {'r': 1, 'p': 'src/' || name || '.ts'}, {'r': 2, 'p': 'src/' || name || '.tsx'}, {'r': 3, 'p': 'src/' || name || '.js'}, {'r': 20, 'p': 'src/' || name || '/index.ts'}]) AS c FROM (SELECT DISTINCT page_id, name FROM imports))
SELECT page_id, name, arg_min(path, c.r) AS target FROM c JOIN targets ON path = c.p GROUP BY 1, 2""")
def ranked_resolution(spark, sf_dir):
    names = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"/]+)"'), F.lit(1)))).alias("name"))
    even = names.where("page_id % 2 = 0")
    size = F.length("name") % 3
    one = even.select(F.concat(F.lit("src/"), "name", F.when(size == 0, ".ts").when(size == 1, ".js").otherwise("/index.ts")).alias("path"))
    two = even.where(F.length("name") % 6 == 0).select(F.concat(F.lit("src/"), "name", F.lit(".js")).alias("path"))
    imports = names.select(F.concat(F.lit("src/pages/p"), F.col("page_id").cast("string"), F.lit(".ts")).alias("file"), F.xxhash64("name").alias("pos"), F.concat(F.lit("../"), "name").alias("specifier"))
    out = resolve.resolved(imports, one.union(two).distinct())
    return out.select(F.regexp_extract("file", r"p(\d+)\.ts$", 1).cast("long").alias("page_id"), F.substring("specifier", 4, 1 << 30).alias("name"), "target")


@query("""WITH f AS (SELECT 'src/d' || (item_id % 5) || '/m' || item_id || '.ts' AS path, item_id FROM benchmark),
t AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'tests/m' || (doc_id // 3) || '.test.ts' WHEN doc_id % 3 = 1 THEN 'src/d' || (doc_id % 5) || '/__tests__/all-m' || (doc_id // 3) || '.ts' ELSE 'src/m' || doc_id || '.ts' END AS path FROM documents)
SELECT DISTINCT f.path AS path, t.path AS test FROM f JOIN t ON split_part(t.path, '/', -1) IN ('m' || item_id || '.test.ts') OR (contains(t.path, '__tests__') AND starts_with(t.path, 'src/d' || (item_id % 5) || '/') AND contains(split_part(t.path, '/', -1), 'm' || item_id))""")
def related_theta(spark, sf_dir):
    item, doc = F.col("item_id"), F.col("doc_id")
    s = lambda c: c.cast("string")
    files = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src/d"), s(item % 5), F.lit("/m"), s(item), F.lit(".ts")).alias("path"))
    test = F.when(doc % 3 == 0, F.concat(F.lit("tests/m"), s(F.floor(doc / 3)), F.lit(".test.ts"))).when(doc % 3 == 1, F.concat(F.lit("src/d"), s(doc % 5), F.lit("/__tests__/all-m"), s(F.floor(doc / 3)), F.lit(".ts"))).otherwise(F.concat(F.lit("src/m"), s(doc), F.lit(".ts")))
    return resolve.related_tests(files, table(spark, sf_dir, "documents").select(test.alias("path")).distinct())


ITEMS_SQL = "items AS (SELECT doc_id AS key, (doc_id % 100)::BIGINT AS score, text FROM documents)"


@query(f"WITH {ITEMS_SQL} SELECT key, score FROM items WHERE contains(lower(text), 'license') ORDER BY score DESC, key LIMIT 20")
def substring_search(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), (F.col("doc_id") % 100).alias("score"), F.lit("text").alias("field"), "text")
    return search.substring_scan(own, "License").select("key", "score")


BM25_SQL = r"""
words AS (SELECT doc_id AS key, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
lens AS (SELECT key, len(w) AS length FROM words WHERE len(w) > 0), stats AS (SELECT count(*) AS n, avg(length) AS mean FROM lens),
tf AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(w) AS term FROM words) WHERE term IN ('license', 'token') GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT key, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (0.5::DOUBLE + tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * length / mean)))) AS score FROM tf JOIN df USING (term) JOIN lens USING (key), stats GROUP BY key)"""


def documents_index(spark, sf_dir):
    return search.text_index(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", ["text"], blocks=False)


def ranked_keys(found):
    return found.select("key", F.row_number().over(Window.orderBy(F.desc("score"), "key")).cast("long").alias("rank")).orderBy("rank")


@query(f"WITH {BM25_SQL} SELECT key, row_number() OVER (ORDER BY round(score, 9) DESC, key) AS rank FROM s ORDER BY rank LIMIT 10")
def bm25_search(spark, sf_dir):
    """Exact terms only, the first ten by blocks; ranks, not scores, are compared."""
    return ranked_keys(search.search(documents_index(spark, sf_dir), "license token", 10, prefix=False, fuzzy=0))


@query(f"WITH {BM25_SQL} SELECT key, row_number() OVER (ORDER BY round(score, 9) DESC, key) AS rank FROM s ORDER BY rank LIMIT 10")
def hyphen_search(spark, sf_dir):
    """A query is split where texts are: at whatever is no letter or digit."""
    return ranked_keys(search.search(documents_index(spark, sf_dir), "(License)-token", 10, prefix=False, fuzzy=0))


TERMS_SQL = r"SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM "


#: DuckDB compares bytes; letters of two bytes that the tables hold become one, capitals, which no term has.
SINGLE = "translate({}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"


@query(f"""WITH known AS (SELECT term, {SINGLE.format("term")} AS t FROM ({TERMS_SQL} documents)), asked AS (SELECT term AS word, {SINGLE.format("term")} AS w FROM ({TERMS_SQL} benchmark) WHERE length(term) BETWEEN 3 AND 12)
SELECT word, term, levenshtein(w, t)::INT AS distance FROM asked JOIN known ON length(t) <= 14 AND abs(length(t) - length(w)) <= 2 AND w <> t
WHERE levenshtein(w, t) <= CASE WHEN length(w) < 8 THEN 1 ELSE 2 END""")
def near_terms(spark, sf_dir):
    """The terms of all documents near each of the benchmark's words of 3 to 12 letters, by forms with letters left out."""
    known = table(spark, sf_dir, "documents").select(F.explode(search.terms("text")).alias("term")).distinct().where(F.length("term") <= search.FORM_LETTERS)
    forms = known.select(F.explode(search.forms_of(F.col("term"))).alias("form"), "term")
    words = table(spark, sf_dir, "benchmark").select(F.explode(search.terms("text")).alias("word")).distinct().where(F.length("word").between(3, 12))
    return search.near_terms(words, forms, F.when(F.length("word") < 8, 1).otherwise(2))


@query("""WITH q AS (SELECT DISTINCT substr(url, length(url) - 7, 6) AS query FROM pages WHERE page_id % 100 = 0)
SELECT query, count(*) AS n, min(page_id) AS first FROM q JOIN pages ON contains(lower(url), lower(query)) WHERE length(query) >= 3 GROUP BY query""")
def trigram_search(spark, sf_dir):
    """A piece of the address of every hundredth page, looked for in all addresses by its rarest trigrams."""
    pages = table(spark, sf_dir, "pages")
    index = search.gram_index(pages.select(F.col("page_id").alias("key"), F.lit(0).alias("score"), F.lit("url").alias("field"), F.col("url").alias("text")))
    queries = pages.where("page_id % 100 = 0").select(F.expr("substr(url, length(url) - 7, 6)").alias("query")).distinct()
    return search.substring_matches(index, queries).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))


@query("""WITH now AS (SELECT doc_id AS path, sha1(text) AS hash FROM documents), was AS (SELECT doc_id AS path, CASE WHEN quality = 1 THEN sha1(text) ELSE 'old' END AS hash FROM documents JOIN labels USING (doc_id) UNION ALL SELECT -1, 'gone')
SELECT path, CASE WHEN now.hash IS NULL THEN 'deleted' WHEN was.hash IS NULL THEN 'new' WHEN now.hash = was.hash THEN 'unchanged' ELSE 'changed' END AS status FROM now FULL JOIN was USING (path)""")
def cache_status(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    now = incremental.hashes(docs)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), "quality")
    was = now.join(labels, "path").select("path", F.when(F.col("quality") == 1, F.col("hash")).otherwise("old").alias("hash"))
    return incremental.status(now, was.unionByName(spark.createDataFrame([(-1, "gone")], "path long, hash string")))


@query("""WITH e AS (SELECT DISTINCT doc_id AS path, doc_id // 7 AS dep FROM documents UNION SELECT doc_id, doc_id // 3 FROM documents),
h AS (SELECT doc_id AS path, sha1(text) AS hash FROM documents), now AS (SELECT e.path, e.dep, hash FROM e JOIN h ON h.path = e.dep),
was AS (SELECT path, dep, CASE WHEN dep % 9 = 0 THEN 'old' ELSE hash END AS hash FROM now WHERE dep % 11 <> 0), known AS (SELECT doc_id AS path FROM labels),
d AS (SELECT DISTINCT coalesce(now.path, was.path) AS path FROM now FULL JOIN was ON now.path = was.path AND now.dep = was.dep WHERE now.hash IS DISTINCT FROM was.hash)
SELECT path, path IN (SELECT path FROM d) AS stale FROM known""")
def fingerprint_stale(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    edges = docs.select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 7).alias("dst")).union(docs.select("doc_id", F.floor(F.col("doc_id") / 3)))
    now = incremental.fingerprints(edges, incremental.hashes(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))))
    was = now.where("dep % 11 != 0").withColumn("hash", F.when(F.col("dep") % 9 == 0, "old").otherwise(F.col("hash")))
    return incremental.stale_dependencies(now, was, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path")))


@query("""SELECT doc_id AS path, sha1(text) AS hash FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'old' FROM labels WHERE doc_id % 2 = 1""")
def state_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.lit("old").alias("hash"))
    return incremental.upserted(old, incremental.hashes(docs), present=table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path")))


@query("""WITH said AS (SELECT 'doc' || (doc_id % 7) AS doc, 'src/f' || (doc_id // 3) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '.ts' END AS path FROM documents), files AS (SELECT DISTINCT 'src/f' || (doc_id // 2) || '.ts' AS path FROM labels)
SELECT path AS evidence, min(doc) AS doc, 'warn' AS severity FROM said WHERE regexp_matches(path, '\\.[a-zA-Z0-9]{1,5}$') AND path NOT IN (SELECT path FROM files) GROUP BY path""")
def missing_mentions(spark, sf_dir):
    doc = F.col("doc_id")
    path = F.concat(F.lit("src/f"), F.floor(doc / 3).cast("string"), F.when(doc % 4 == 0, "").otherwise(".ts"))
    said = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), (doc % 7).cast("string")).alias("doc"), path.alias("path"))
    files = table(spark, sf_dir, "labels").select(F.concat(F.lit("src/f"), F.floor(doc / 2).cast("string"), F.lit(".ts")).alias("path")).distinct()
    return governance.missing_files(said, files).select("evidence", "doc", "severity")


@query(f"""WITH {PATH_SQL} SELECT DISTINCT path AS file FROM paths WHERE split_part(path, '/', 1) IN ('src', 'lib', 'internal', 'pkg', 'packages', 'apps', 'modules') AND NOT starts_with(path, 'src/core/') AND NOT starts_with(path, 'packages/')""")
def undeclared_domain(spark, sf_dir):
    mapped = spark.createDataFrame([("d.md", "src/core/"), ("d.md", "src/cor"), ("d.md", "packages")], "doc string, pattern string")
    return governance.undeclared_domains(part_paths(spark, sf_dir).select("path").distinct(), mapped).select("file")


FILE_EDGES = "e AS (SELECT 'src/a' || l_partkey || '/x.ts' AS src, 'src/b' || l_suppkey || '/y.ts' AS dst FROM lineitem)"


def file_edges(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem")
    s = lambda c: c.cast("string")
    return own.select(F.concat(F.lit("src/a"), s(F.col("l_partkey")), F.lit("/x.ts")).alias("src"), F.concat(F.lit("src/b"), s(F.col("l_suppkey")), F.lit("/y.ts")).alias("dst"))


@query(f"""WITH {FILE_EDGES}, r AS (SELECT * FROM (VALUES ('src/a1', 'src/b2'), ('src/a2', 'src'), ('src/a3', 'src/b'), ('src/a5', 'src/b5')) v(f, t))
SELECT src AS file, dst, count(*) AS n FROM (SELECT src, dst FROM e JOIN r ON starts_with(src, f || '/') AND (dst = t OR starts_with(dst, t || '/'))) GROUP BY 1, 2""")
def forbidden_edges(spark, sf_dir):
    docs = spark.createDataFrame([("a.md", "`src/a1` must not depend on `src/b2`. src/a2 cannot import from src/lib-none\nsrc/a3 may not use src/b."), ("b.md", "src/a5 must depend on src/b5")], "path string, content string")
    more = spark.createDataFrame([("c.md", "src/a2", "src", "by hand")], "doc string, from string, to string, raw string")
    out = governance.forbidden_edges(file_edges(spark, sf_dir), governance.forbidden_rules(docs).unionByName(more))
    return out.select("file", F.regexp_extract("message", 'imports from "([^"]+)"', 1).alias("dst")).groupBy("file", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FILE_EDGES} SELECT dst AS file, count(*)::VARCHAR || ' reverse dependencies' AS evidence FROM e WHERE NOT starts_with(dst, 'src/b1/') AND dst <> 'src/b2/y.ts' AND dst <> 'src/b3/y.ts' GROUP BY dst HAVING count(*) >= 5""")
def undocumented_hotspot(spark, sf_dir):
    own = file_edges(spark, sf_dir)
    said = spark.createDataFrame([("d.md", "src/b2/y.ts")], "doc string, path string")
    mapped = spark.createDataFrame([("d.md", "src/b1/")], "doc string, pattern string")
    files = own.select(F.col("dst").alias("path")).distinct().where("path != 'src/b3/y.ts'")
    return governance.undocumented_hotspots(own, files, said, mapped).select("file", "evidence")


@query("""SELECT p_partkey::VARCHAR AS path, 'Decisions' AS heading, '- ' || p_name || chr(10) || '- second' AS body FROM part WHERE p_size % 3 <> 0
UNION ALL SELECT p_partkey::VARCHAR, 'Rules', 'last ' || p_name FROM part""")
def markdown_sections(spark, sf_dir):
    """A heading followed by another has no section, of equal headings the last body counts."""
    first = F.when(F.col("p_size") % 3 == 0, F.lit("# Decisions\n")).otherwise(F.concat(F.lit("# Decisions\n- "), "p_name", F.lit("\n- second\n")))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("intro\n"), first, F.lit("## Rules\nfirst\n### Rules\nlast "), "p_name").alias("content"))
    return governance.sections(docs).select("path", "heading", "body")


@query("""SELECT p_partkey::VARCHAR AS path, row_number() OVER (PARTITION BY p_partkey ORDER BY k) AS rank, p_name || ' rule ' || k AS item FROM part, range(3) r(k) WHERE length(p_name || ' rule ' || k) BETWEEN 11 AND 299""")
def doc_constraints(spark, sf_dir):
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat(F.lit("- "), "p_name", F.lit(" rule "), k.cast("string"))), "\n")
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit("contract").alias("category"), F.concat(F.lit("# Must hold\n"), body, F.lit("\n- short\n# Else\n- "), "p_name", F.lit(" is not one")).alias("content"))
    return governance.constraints(docs).withColumn("rank", F.col("rank").cast("long"))


DEBOUNCE_SQL = """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id AS filename, max(ts) AS last_at, count(*) AS events FROM s GROUP BY user_id, session"""


@query(DEBOUNCE_SQL)
def debounce(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("filename"), F.col("ts").alias("at"))
    return debounced(own, "2 hours").select("filename", "last_at", "events")
