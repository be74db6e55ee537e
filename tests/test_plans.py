"""Sources, the whole run, serving queries, streaming, and the entry module."""

import dataclasses
import os
import subprocess

import duckdb
import pytest
from pyspark.sql import functions as F

from strataloom.operators import search
from strataloom.plans import all_queries, all_sql, generate, serve, source_queries
from strataloom.sources import config, coverage, documents, files, git_log
from strataloom.streaming import watch

SF = "/root/testdata/sf0.001"


def now():
    return F.lit("2024-06-01").cast("timestamp")


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    own = {
        "src/index.ts": "import { u } from './utils'\nimport { u as w } from './utils'\nexport function main(): void {}\n",
        "src/utils.ts": "// TODO: tidy\nexport const u = () => process.env.HOME_DIR\n",
        "src/utils.test.ts": "import { u } from './utils'\n",
        "src/user.controller.ts": "import axios from 'axios'\nimport { main } from './index'\nexport class UserController {}\n",
        "pkg/a.py": "from .b import x\nimport os\ndef f(): ...\n",
        "pkg/b.py": "x = 1\n",
        "docs/architecture.md": "# Plan\n## Rules\n- src/index stays without any state\nsee `src/utils.ts` and `src/gone.ts`\n",
        "coverage/lcov.info": "SF:src/utils.ts\nLF:50\nLH:10\nend_of_record\nSF:src/index.ts\nLF:0\nLH:0\nend_of_record\n",
        "node_modules/x/index.ts": "export const no = 1\n",
    }
    for name, text in own.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=A | B", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("add", "src")
    git("commit", "-qm", "feat: first | part")
    for k in range(3):
        for name in ("src/index.ts", "src/utils.ts"):
            with open(root / name, "a") as f:
                f.write(f"// {k}\n")
        git("commit", "-qam", "fix: both because needed")
    git("checkout", "-qb", "side")
    (root / "src/new.ts").write_text("export const n = 1\n")
    git("add", "src/new.ts")
    git("mv", "src/user.controller.ts", "src/person.controller.ts")
    git("commit", "-qm", "add")
    git("checkout", "-q", "main")
    return str(root)


@pytest.fixture(scope="module")
def made(spark, repo):
    own = config.Config(repo, include=("**/*.ts", "**/*.py"))
    return generate.run_repository(spark, own, now())


def test_scan(spark, repo):
    out = files.scan_repository(spark, repo)
    assert [r["path"] for r in files.by_path(out).collect()] == ["src/index.ts", "src/user.controller.ts", "src/utils.ts"]
    one = out.where("path = 'src/utils.ts'").first()
    assert one["extension"] == ".ts" and one["size"] == len(one["content"]) and len(one["hash"]) == 40
    assert '"path":"src/index.ts"' in files.listing(out).first()["value"]


def test_git(spark, repo):
    own = git_log.history(spark, repo)
    out = {r["file"]: r["n"] for r in own.groupBy("file").agg(F.countDistinct("commit").alias("n")).collect()}
    assert out["src/index.ts"] == 4 and out["src/user.controller.ts"] == 1
    assert own.where("message = 'feat: first | part'").first()["author"] == "A | B"
    subprocess.run(["git", "-C", repo, "checkout", "-q", "side"], check=True)
    changes = {(r["path"], r["edit"]) for r in git_log.changes(spark, repo, "main").collect()}
    subprocess.run(["git", "-C", repo, "checkout", "-q", "main"], check=True)
    assert changes == {("src/new.ts", "added"), ("src/person.controller.ts", "modified"), ("src/user.controller.ts", "deleted")}
    assert git_log.changes(spark, repo, "no-such-ref").count() == 0 and git_log.history(spark, "/nowhere").count() == 0


def test_coverage(spark):
    text = "SF:a\nLF:20\nLH:18\nend_of_record\nSF:b\nLF:50\nLH:10\nend_of_record\nSF:c\nLF:0\nLH:0\nend_of_record\nSF:a\nLF:10\nLH:1\nend_of_record\n"
    assert {r["path"]: r["coverage_pct"] for r in coverage.lcov(spark.createDataFrame([(text,)], "value string")).collect()} == {"a": 0.1, "b": 0.2}
    own = spark.createDataFrame([('{"total": {"lines": {"pct": 1}}, "x": {"lines": {"pct": 50}}}',)], "value string")
    assert [tuple(r) for r in coverage.summary(own).collect()] == [("x", 0.5)]


def test_config(tmp_path):
    assert config.load_config(str(tmp_path)) == config.Config(str(tmp_path))
    (tmp_path / "strataloom.json").write_text('{"language": "de", "include": ["**/*.py"]}')
    assert config.load_config(str(tmp_path)).include == ("**/*.py",)
    (tmp_path / "strataloom.json").write_text('{"concurrency": 50}')
    with pytest.raises(ValueError):
        config.load_config(str(tmp_path))
    assert config.repositories("a=/p, b=/q") == {"a": "/p", "b": "/q"} and config.repositories("/x/repo") == {"repo": "/x/repo"}
    for bad in ("", "a=/p,a=/q", "a="):
        with pytest.raises(ValueError):
            config.repositories(bad)
    assert config.project_context("  ") is None and config.project_context("x" * 5_000).endswith("truncated]")
    assert config.tsconfig_aliases('{// c\n"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"],}}}') == {"@/*": ["src/*"]}
    assert config.bundler_aliases("resolve: { alias: { '@lib': path.resolve(__dirname, './lib') } }") == {"@lib": ["lib"]}
    with pytest.raises(ValueError):
        config.inside(".", "../x")


def test_notes_of_a_run(made):
    own = {r["file_path"]: r for r in made.notes.collect()}
    assert set(own) == {"src/index.ts", "src/utils.ts", "src/user.controller.ts", "pkg/a.py", "pkg/b.py"}
    utils = own["src/utils.ts"]
    assert utils["debug_signals"]["reverse_dep_count"] == 2 and utils["debug_signals"]["has_tests"] and utils["debug_signals"]["coverage_pct"] == 0.2
    assert "TODO: tidy" in utils["known_pitfalls"]["observed"] and any("Co-changes" in x for x in utils["known_pitfalls"]["observed"])
    assert any("HOME_DIR" in x for x in utils["invariants"]["observed"]) and any(x.startswith("Low line coverage: 20.0%") for x in utils["impact_validation"]["observed"])
    assert utils["purpose"]["confidence"] == 0.6 and utils["important_decisions"]["observed"]
    controller = own["src/user.controller.ts"]["purpose"]["observed"]
    assert controller[0].startswith("HTTP controller") and len(controller) >= 2
    assert own["pkg/b.py"]["debug_signals"]["reverse_dep_count"] == 1
    assert float(utils["criticality_score"]) == pytest.approx(0.20 + 0.10 + 0.05 + 0.04 + 0.15)


def test_serving(made):
    assert serve.call(made, "search_by_criticality", threshold=0.5).first()["path"] == "src/utils.ts"
    impact = {r["path"]: r["level"] for r in serve.call(made, "get_impact", file_path="src/utils.ts").collect()}
    assert impact == {"src/index.ts": 1, "src/user.controller.ts": 2}
    assert serve.call(made, "get_impact", file_path="none.ts").count() == 0
    assert "src/user.controller.ts" in [r["key"] for r in serve.call(made, "full_text_search", query="controler").collect()]
    assert serve.call(made, "substring_search", query="tidy").first()["key"] == "src/utils.ts"
    assert serve.call(made, "get_domain", domain="src").count() == 3
    assert serve.call(made, "get_divergences", type="missing_file").first()["evidence"] == "src/gone.ts"
    assert serve.call(made, "get_stats").first()["total"] == 5
    assert serve.call(made, "get_file_note", file_path="src/index.ts").count() == 1
    assert serve.call(made, "get_architecture_context", top_n=2).count() == 2
    assert {r["node"]: r["transitive_dependents"] for r in serve.call(made, "get_all_analyses").collect()}["src/utils.ts"] == 2
    one = serve.call(made, "get_file_analysis", path="src/utils.ts").collect()
    assert [(r["node"], r["transitive_dependents"], r["transitive_dependencies"], r["in_cycle"]) for r in one] == [("src/utils.ts", 2, 0, False)]
    assert {(r["src"], r["dst"]) for r in serve.call(made, "get_links").collect()} == {("src/index.ts", "src/utils.ts"), ("src/user.controller.ts", "src/index.ts"), ("pkg/a.py", "pkg/b.py")}
    assert serve.call(made, "get_hover", file_path="src/index.ts", specifier="./utils").first()["path"] == "src/utils.ts"
    told = serve.call(made, "get_governance_context").first()
    assert told["detected"] and told["documents"][0]["path"] == "docs/architecture.md" and "governance" in told["summary"]
    assert serve.call(made, "get_architecture_totals").first()["total_files"] == 5 and serve.call(made, "get_domain_summary", domain="src").first()["files"] == 3
    assert serve.call(made, "get_index").count() == 5 and serve.call(made, "get_graph").count() == 5 and serve.call(made, "get_cycles").count() == 0
    for bad in ({"name": "none"}, {"name": "get_domain", "domain": "none"}, {"name": "full_text_search", "query": ""}, {"name": "get_file_note", "file_path": "/etc/passwd"}):
        with pytest.raises(ValueError):
            serve.call(made, **bad)


def test_plan_write_and_incremental(spark, made, repo, tmp_path):
    nothing = spark.createDataFrame([], "path string, edit string")
    own = config.Config(repo, include=("**/*.ts", "**/*.py"))
    plan = {r["path"]: r for r in generate.plan(made, made, nothing, own, True).collect()}
    assert all(r["hit"] for r in plan.values()) and not generate.plan(made, made, nothing, own, True, force=True).where("hit").count()
    changed = made.hashes.withColumn("hash", F.when(F.col("path") == "src/utils.ts", "old").otherwise(F.col("hash")))
    prints = made.fingerprints.withColumn("hash", F.when(F.col("dep") == "src/utils.ts", "old").otherwise(F.col("hash")))
    earlier = dataclasses.replace(made, hashes=changed, fingerprints=prints)
    assert {r["path"] for r in generate.plan(made, earlier, nothing, own, True).where("NOT hit").collect()} == {"src/utils.ts", "src/index.ts"}
    out = str(tmp_path)
    assert generate.stored(spark, out) is None
    generate.write(made, out)
    everything = files.scan_repository(spark, repo, ("src/*.ts", "pkg/*.py"), ("**/*.test.ts",))
    edited = everything.withColumn("content", F.when(F.col("path") == "src/index.ts", "export const alone = 1").otherwise(F.col("content")))
    batch = spark.createDataFrame([("src/index.ts",)], "filename string")
    later = F.lit("2024-06-09").cast("timestamp")
    for _ in range(2):
        generate.apply_changes(spark, out, batch, edited, git_log.history(spark, repo), spark.createDataFrame([], "path string, coverage_pct double"), own, later)
    kept = generate.stored(spark, out)
    found = {r["file_path"]: r for r in kept.notes.collect()}
    assert found["src/utils.ts"]["debug_signals"]["reverse_dep_count"] == 0 and found["src/index.ts"]["debug_signals"]["reverse_dep_count"] == 1
    days = {p: str(r["generated_at"])[:10] for p, r in found.items()}
    assert days == {"src/index.ts": "2024-06-09", "src/utils.ts": "2024-06-09", "src/user.controller.ts": "2024-06-09", "pkg/a.py": "2024-06-01", "pkg/b.py": "2024-06-01"}
    assert serve.call(kept, "full_text_search", query="alone").count() >= 0 and serve.call(kept, "get_index").count() == 5
    assert len([n for n in os.listdir(out) if n.startswith("v")]) == 2  # the current version and the one before


def test_unchanged_files_keep_their_notes(spark, repo, made):
    """Notes of files that are as they were stay, whatever time it is; settings, force, a glob and a list choose otherwise."""
    own, later = config.Config(repo, include=("**/*.ts", "**/*.py")), F.lit("2025-01-01").cast("timestamp")
    days = lambda run: {r["file_path"]: str(r["generated_at"])[:4] for r in run.notes.collect()}
    again = lambda own=own, **chosen: generate.run_repository(spark, own, later, earlier=made, chosen=generate.Chosen(**chosen))
    same = again()
    assert set(days(same).values()) == {"2024"} and same.fresh.count() == 0
    assert same.index.where("stale").count() == 5 and same.notes.count() == 5
    assert set(days(again(force=True)).values()) == {"2025"}
    some = days(again(force=True, pattern="src/*.ts"))
    assert {p for p, y in some.items() if y == "2025"} == {p for p in some if p.startswith("src/")} and len(some) == 5
    one = again(paths=spark.createDataFrame([("pkg/b.py",), ("gone.py",)], "path string"))
    assert {p for p, y in days(one).items() if y == "2025"} == {"pkg/b.py"}
    assert set(days(again(dataclasses.replace(own, language="de"))).values()) == {"2025"}
    gone = dataclasses.replace(made, notes=made.notes.where("file_path != 'pkg/b.py'"))
    assert {p for p, y in days(generate.run_repository(spark, own, later, earlier=gone)).items() if y == "2025"} == {"pkg/b.py"}


def test_history_by_ranges(spark, repo, monkeypatch):
    """Ranges of one commit give the same rows as one range; a date leaves ranges out."""
    rows = lambda df: sorted(map(str, df.collect()))
    whole, cut = git_log.history(spark, repo), git_log.commit_texts(spark, repo, 1)
    assert cut.rdd.getNumPartitions() == 4 and rows(git_log.history(spark, repo, size=1)) == rows(whole)
    latest = whole.agg(F.max("at")).first()[0]
    assert rows(git_log.history(spark, repo, since=latest)) == rows(whole.where(F.col("at") >= F.lit(latest)))
    assert git_log.commit_texts(spark, repo, 1).where(F.col("at") > F.lit("2999-01-01").cast("timestamp")).rdd.getNumPartitions() == 1


def test_documents(spark, tmp_path):
    assert documents.state(spark, f"{tmp_path}/none", "path string, hash string").count() == 0
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.json").write_text('{"file_path": "a"}')
    (tmp_path / "n/b.json").write_text('{"file_path": ')
    good, bad = documents.notes(spark, f"{tmp_path}/n", "file_path string")
    assert [r["file_path"] for r in good.collect()] == ["a"] and bad.count() == 1
    index = spark.createDataFrame([("a", ["b", "c"])], "path string, dependents array<string>")
    assert documents.edges_or_dependents(None, index).count() == 2


def test_debounced_stream(spark, tmp_path):
    rows = [("a.ts", "2024-01-01 00:00:00.000"), ("a.ts", "2024-01-01 00:00:00.200"), ("a.ts", "2024-01-01 00:00:05.000"), ("b.ts", "2024-01-01 00:00:00.100"), ("dist/c.ts", "2024-01-01 00:00:00.100"), ("z.ts", "2024-01-01 01:00:00.000")]
    own = spark.createDataFrame(rows, "filename string, at string").withColumn("at", F.to_timestamp("at"))
    expected = {("a.ts", 2), ("a.ts", 1), ("b.ts", 1)}
    kept = watch.relevant(own, ("**/*.ts",), ("dist/**",))
    assert {(r["filename"], r["events"]) for r in watch.debounced(kept).collect()} == expected | {("z.ts", 1)}
    own.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = watch.relevant(spark.readStream.schema(own.schema).parquet(f"{tmp_path}/in"), ("**/*.ts",), ("dist/**",))
    seen = []
    query = watch.watch(stream, lambda df, n: seen.extend((r["filename"], r["events"]) for r in df.collect()), f"{tmp_path}/cp")
    query.awaitTermination(60)
    assert set(seen) == expected  # z.ts waits for the watermark


@pytest.mark.parametrize("name", ["criticality", "domain_breakdown", "impact_bfs", "comment_tags", "ranked_resolution", "fingerprint_stale", "debounce", "parse_source", "llm_merge", "undeclared_domain", "note_diff"])
def test_queries_against_duckdb(spark, name):
    own = all_queries()[name](spark, SF)
    db = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = db.execute(f"SELECT * FROM ({all_sql()[name]})")
    names = sorted(d[0] for d in wanted.description)
    order = [[d[0] for d in wanted.description].index(n) for n in names]
    rows = sorted((tuple(map(str, (r[k] for k in order))) for r in wanted.fetchall()))
    assert sorted(own.columns) == names and rows
    assert sorted(tuple(map(str, r)) for r in own.select(*(f"`{n}`" for n in names)).collect()) == rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_fuzzy_and_generated(spark):
    assert all_queries()["fuzzy_search"](spark, SF).count() > 0
    made = source_queries.generated_notes(spark, SF)
    assert made.count() == 200 and made.where("criticality_score > 1 OR criticality_score < 0").count() == 0


def test_generated_notes_take_every_part_and_line_item(spark, tmp_path):
    items = [(1, 5_000, 1, "2001-01-01"), (1, 4_999, 2, "2001-01-02"), (2, 5_000, 7, "2001-02-01"), (2, 5_001, 1, "2001-02-01"), (3, 5_000, 3, "2001-02-02")]
    own = spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int, l_shipdate string")
    own.selectExpr("l_orderkey", "l_partkey", "l_linenumber", "cast(l_shipdate AS timestamp) AS l_shipdate", "'O' AS l_linestatus", "'A' AS l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"part {k}") for k in (0, 4_999, 5_001, 5_000)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    path = lambda k: f"packages/b{k // 70}/src/f{k}.ts"
    found = {r["file_path"]: r["debug_signals"] for r in source_queries.whole_run(spark, str(tmp_path)).notes.collect()}
    assert set(found) == {path(k) for k in (0, 4_999, 5_001, 5_000)}
    weeks = {(k, at[:7]) for _, k, _, at in items}  # a month holds one week here
    for k in (4_999, 5_001, 5_000):
        assert found[path(k)]["churn_score"] == sum(own == k for own, _ in weeks)
    assert [(r["path"], r["count"]) for r in found[path(5_000)]["co_changed_files"]] == [(path(4_999), 1), (path(5_001), 1)]


def test_search_ranks_all_matches_by_the_rounded_score(spark):
    """1,500 matches that tie once rounded: the least keys come first, whatever block they are in."""
    docs = spark.range(1_500).select(F.col("id").alias("key"), F.when(F.col("id") % 2 == 0, "license token").otherwise("token license").alias("text")).repartition(7)
    out = search.search(search.text_index(docs, "key", ["text"]), "license token", 10, prefix=False, fuzzy=0)
    assert [r["key"] for r in out.collect()] == list(range(10))
