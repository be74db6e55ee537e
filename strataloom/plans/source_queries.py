"""Queries on sources, parsers, the language-model edge and the whole run, over repositories made of the tables' columns."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import incremental, notes, parsers, synthesis
from ..sources import coverage, documents, files, git_log
from ..sources.config import Config
from . import generate
from .catalog import query, table

NOW = "2001-09-01"


@query("""SELECT 'src/p' || p_partkey || '.ts' AS path, 0.5::DOUBLE AS coverage_pct FROM part WHERE p_size % 5 = 1 AND p_size % 2 = 0 UNION ALL
SELECT 'src/p' || p_partkey || '.ts', p_size::DOUBLE / (p_size * 2 + 1) FROM part WHERE p_size % 5 <> 0 AND NOT (p_size % 5 = 1 AND p_size % 2 = 0)""")
def lcov_coverage(spark, sf_dir):
    """Records without lines give no row, of two records of a file the last counts."""
    size, name = F.col("p_size"), F.concat(F.lit("SF:src/p"), F.col("p_partkey").cast("string"), F.lit(".ts\n"))
    record = lambda lf, lh: F.concat(name, F.lit("LF:"), lf.cast("string"), F.lit("\nLH:"), lh.cast("string"), F.lit("\nend_of_record\n"))
    first = record(F.when(size % 5 == 0, 0).otherwise(size * 2 + 1), F.when(size % 5 == 0, 0).otherwise(size))
    second = F.when((size % 5 == 1) & (size % 2 == 0), record(F.lit(20), F.lit(10))).otherwise("")
    return coverage.lcov(table(spark, sf_dir, "part").select(F.concat(F.lit("TN:\n"), first, second).alias("value")))


@query("""SELECT CASE WHEN o_orderkey % 5 = 4 THEN 'new' || o_orderkey ELSE 'f' || o_orderkey END AS path, CASE o_orderkey % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' WHEN 3 THEN 'added' ELSE 'modified' END AS edit FROM orders
UNION ALL SELECT 'f' || o_orderkey, 'deleted' FROM orders WHERE o_orderkey % 5 = 4""")
def diff_status(spark, sf_dir):
    key, name = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    two = lambda status: F.concat(F.lit(status), F.lit("\tf"), name)
    line = F.when(key == 0, two("A")).when(key == 1, two("M")).when(key == 2, two("D")).when(key == 3, F.concat(F.lit("C90\told\tf"), name)).otherwise(F.concat(F.lit("R95\tf"), name, F.lit("\tnew"), name))
    return git_log.parsed_diff(table(spark, sf_dir, "orders").select(line.alias("value")))


@query("""SELECT 'f' || l_partkey AS file, l_orderkey::VARCHAR AS commit, 'M' AS status, 'ann | co' AS author FROM lineitem""")
def commit_log(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.collect_list("l_partkey"), lambda p: F.concat(F.lit("M\tf"), p.cast("string"))), "\n").alias("rows"))
    line = F.concat(F.lit("\u001e"), F.col("l_orderkey").cast("string"), F.lit("\u001f2001-01-01T00:00:00+00:00\u001fann | co\u001ffix: a | b\n\n"), "rows", F.lit("\n"))
    return git_log.parsed_log(own.select(line.alias("value"))).select("file", "commit", "status", "author")


def repository(own):
    """A file for each part: it imports the part before (twice every fifth time) and a package, and exports a function."""
    n = F.col("p_partkey")
    s = lambda c: c.cast("string")
    near = F.concat(F.lit("import { f"), s(n - n % 7), F.lit(" } from './f"), s(n - n % 7), F.lit("'\n"))
    text = F.concat(
        near, F.when(n % 5 == 0, near).otherwise(""), F.when(n % 3 == 0, "import axios from 'axios'\n").otherwise(""), F.when(n % 4 == 0, F.concat(F.lit("// TODO: "), "p_name", F.lit("\n"))).otherwise(""),
        F.lit("export function f"), s(n), F.lit("(a: number): string { return process.env.KEY_"), s(n % 10), F.lit(" }\n"),
    )
    path = F.concat(F.lit("packages/b"), s(n % 7 * 0 + F.floor(n / 70)), F.lit("/src/f"), s(n), F.lit(".ts"))
    return own.select(path.alias("path"), F.lit(".ts").alias("extension"), F.length(text).cast("long").alias("size"), text.alias("content"), F.sha1(text.cast("binary")).alias("hash"))


@query("""SELECT p_partkey AS id, ['f' || p_partkey] AS exports, ['KEY_' || (p_partkey % 10)] AS env_vars,
CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS local_imports, CASE WHEN p_partkey % 3 = 0 THEN ['axios'] ELSE [] END AS external_imports, 'f' || p_partkey || '(a: number): string' AS signature, p_partkey % 4 = 0 AS todo FROM part""")
def parse_source(spark, sf_dir):
    own = parsers.analyses(repository(table(spark, sf_dir, "part")))
    return own.select(F.regexp_extract("path", r"f(\d+)\.ts$", 1).cast("long").alias("id"), "exports", "env_vars", F.size("local_imports").cast("long").alias("local_imports"), "external_imports", F.col("export_details")[0]["signature"].alias("signature"), (F.size("comments.todo") > 0).alias("todo"))


def commits_of(spark, sf_dir):
    """A row for each line item: the parts of a package shipped in a week are the files of a commit, 70 at most."""
    own = table(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("packages/b"), F.floor(F.col("l_partkey") / 70).cast("string"), F.lit("/src/f"), F.col("l_partkey").cast("string"), F.lit(".ts"))
    message = F.when(F.col("l_linestatus") == "O", "fix: it").otherwise("refactor: that")
    return own.select(path.alias("file"), F.concat(F.date_trunc("week", "l_shipdate").cast("string"), F.lit(" b"), F.floor(F.col("l_partkey") / 70).cast("string")).alias("commit"), F.col("l_shipdate").alias("at"), F.col("l_returnflag").alias("author"), message.alias("message"), F.lit("M").alias("status"))


def whole_run(spark, sf_dir):
    covered = spark.createDataFrame([("packages/b0/src/f0.ts", 0.25), ("packages/b0/src/f7.ts", 0.9)], "path string, coverage_pct double")
    docs = spark.createDataFrame([("docs/architecture.md", ".md", 1, "# Design\n## Domain rules\n- packages/b0 must stay free of imports\nsee `packages/b0/src/f0.ts` and `packages/b9/gone.ts`\npackages/b1 must not depend on packages/b1/src.\n## Decisions\n- one package for each brand", "x")], "path string, extension string, size long, content string, hash string")
    own = repository(table(spark, sf_dir, "part")).unionByName(docs)
    return generate.run(own, commits_of(spark, sf_dir), covered, Config("."), F.lit(NOW).cast("timestamp"), searched=False)


@query()
def generated_notes(spark, sf_dir):
    """Notes of a whole run; checked by tests."""
    made = whole_run(spark, sf_dir)
    return made.notes.select("file_path", "criticality_score", *(F.size(F.col(f)["observed"]).alias(f) for f in rules.NOTE_FIELDS))


@query()
def generated_markdown(spark, sf_dir):
    return notes.markdown(whole_run(spark, sf_dir).notes)


@query("""WITH own AS (SELECT p_partkey AS n FROM part) SELECT 'packages/b' || (n // 70) || '/src/f' || n || '.ts' AS src, 'packages/b' || (n // 70) || '/src/f' || (n - n % 7) || '.ts' AS dst
FROM own, range(2) r(k) WHERE k = 0 OR n % 5 = 0""")
def dependency_edges(spark, sf_dir):
    own = repository(table(spark, sf_dir, "part"))
    return generate.dependency_edges(parsers.analyses(own), own.select("path"))


FORMS = ("plain", "fenced", "prose", "broken", "bare")


def replies(spark, sf_dir):
    """A reply in one of five forms for each part: only the broken and the bare ones cannot be used."""
    field = json.dumps({"observed": [], "inferred": ["an {odd} \\ thing"], "confidence": 0.5, "evidence": [{"type": "odd", "detail": "d"}]})
    whole = "{" + ", ".join(f'"{f}": {field}' for f in rules.NOTE_FIELDS) + "}"
    said = {"plain": whole, "fenced": f"Here:\n```json\n{whole}\n```", "prose": f"I think {whole} is right", "broken": whole[:-9], "bare": "no idea"}
    key = F.col("p_partkey") % len(FORMS)
    text = F.lit(None).cast("string")
    for k, name in enumerate(FORMS):
        text = F.when(key == k, F.lit(said[name])).otherwise(text)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("prompt"))


def _note_columns():
    one = F.struct(F.array(F.lit("seen")).alias("observed"), F.array().cast("array<string>").alias("inferred"), F.lit(0.6).alias("confidence"), F.array(F.struct(F.lit("code").alias("type"), F.lit("D").alias("detail"))).alias("evidence"))
    return [one.cast(synthesis.FIELD).alias(f) for f in rules.NOTE_FIELDS]


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 < 3 THEN 'fake' ELSE 'static' END AS model, CASE WHEN p_partkey % 5 < 3 THEN 1 ELSE 0 END::BIGINT AS inferred, 1::BIGINT AS evidence, CASE WHEN p_partkey % 5 < 3 THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence FROM part""")
def llm_merge(spark, sf_dir):
    """The injected model gives back its prompt; evidence that is there already is not repeated."""
    own = replies(spark, sf_dir).select("id", "prompt", *_note_columns(), F.lit("static").alias("model"))
    out = synthesis.synthesised(own, lambda prompt: prompt, "fake", delays=())
    return out.select("id", "model", F.size("purpose.inferred").cast("long").alias("inferred"), F.size("purpose.evidence").cast("long").alias("evidence"), F.col("purpose.confidence").alias("confidence"))


@query("""WITH d AS (SELECT 'docs/ADR/' || doc_id || '.md' AS path, 'other' AS category FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'Quality/' || doc_id || '.yml', 'quality' FROM documents WHERE doc_id % 3 = 1)
SELECT * FROM d""")
def governance_docs(spark, sf_dir):
    key, name = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    path = F.when(key == 0, F.concat(F.lit("docs/ADR/"), name, F.lit(".md"))).when(key == 1, F.concat(F.lit("Quality/"), name, F.lit(".yml"))).otherwise(F.concat(F.lit("Quality/"), name, F.lit(".txt")))
    return documents.governance_docs(table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"))).select("path", "category")


@query("""SELECT to_json({'path': 'src/' || p_partkey || '.ts', 'extension': '.ts', 'size': p_size})::VARCHAR AS value FROM part""")
def scan_listing(spark, sf_dir):
    own = table(spark, sf_dir, "part")
    return files.listing(own.select(F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), F.lit(".ts").alias("extension"), F.col("p_size").alias("size")))


@query("""SELECT (count(*) - count(*) FILTER (doc_id % 4 = 0))::BIGINT AS write, (count(*) FILTER (doc_id % 4 = 0))::BIGINT AS skip, (count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 3 = 0))::BIGINT AS llm FROM documents""")
def dry_run(spark, sf_dir):
    return incremental.dry_run(table(spark, sf_dir, "documents").select((F.col("doc_id") % 4 == 0).alias("hit"), (F.col("doc_id") % 3 == 0).alias("uses_llm")))
