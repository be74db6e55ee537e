"""Commands, stored tables and requests over a small repository; prompts, aliases, renames, governance and shapes of signatures."""

import dataclasses
import json
import subprocess
import sys
import time
import types

import pytest
from pyspark.sql import functions as F

from strataloom import cli
from strataloom.operators import governance, graph, parsers, prompts
from strataloom.plans import generate, protocol
from strataloom.sources import config, coverage, documents, git_log


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    home = tmp_path_factory.mktemp("commands")
    own = {
        "src/index.ts": "import { u } from './utils'\nexport function main(): void {}\n",
        "src/utils.ts": "// TODO: tidy\nexport const u = () => 1\n",
        "src/order.service.ts": "import { u } from '@/deep'\nexport class OrderService { place(n: number): void {} }\n",
        "lib/deep.ts": "export const deep = 1\n",
        "tsconfig.json": '{ // aliases\n"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["nowhere/*"]}}}',
        "vite.config.ts": "export default { resolve: { alias: { '@': './lib' } } }\n",
        "docs/architecture.md": "# Plan\n## Rules\n- src stays without any state\nsee `src/utils.ts`\n",
        "coverage/coverage-summary.json": json.dumps({"total": {"lines": {"pct": 1}}, str(home) + "/src/utils.ts": {"lines": {"pct": 25}}}),
        "strataloom.json": json.dumps({"output": "notes"}),
    }
    for name, text in own.items():
        (home / name).parent.mkdir(parents=True, exist_ok=True)
        (home / name).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(home), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("add", "src")
    git("commit", "-qm", "first")
    time.sleep(1.1)
    git("mv", "src/order.service.ts", "src/orders.service.ts")
    git("commit", "-qm", "rename")
    return str(home)


def test_commands(spark, root):
    said = []
    cli.main(["scan", "--root", root, "--format", "json"], said.append)
    assert {json.loads(x)["path"] for x in said} == {"src/index.ts", "src/utils.ts", "src/orders.service.ts", "lib/deep.ts"}
    said.clear()
    cli.main(["generate", "--root", root, "--verbose"], said.append)
    assert said[0].startswith("4 of 4 notes made") and any(x.startswith("untested: files") for x in said)
    said.clear()
    cli.main(["generate", "--root", root, "--dry-run"], said.append)
    assert said == ["0 to write, 4 to skip, 0 for a model"]
    with open(f"{root}/src/utils.ts", "a") as f:
        f.write("// FIXME: more\n")
    said.clear()
    cli.main(["watch", "--root", root, "--rounds", "1"], said.append)
    assert said == ["1 files changed"]
    ask = lambda n, method, **p: json.dumps({"jsonrpc": "2.0", "id": n, "method": method, "params": p})
    lines = [
        ask(1, "initialize"), ask(2, "tools/list"), ask(3, "tools/call", name="full_text_search", arguments={"query": "fixme"}), ask(4, "tools/call", name="list_repos", arguments={}), "not json", ask(5, "no/such"),
        ask(6, "tools/call", name="get_file_note", arguments={}), ask(7, "tools/call", name="get_domain", arguments={"domain": "none"}), json.dumps({"method": "notifications/initialized"}), "",
        ask(8, "tools/call", name="get_file_analysis", arguments={"path": "src/utils.ts"}), ask(9, "tools/call", name="nothing", arguments={}),
    ]
    said.clear()
    args = cli._parser().parse_args(["serve", "--root", root])
    cli.serve(spark, args, said.append, lines)
    by = {json.loads(x)["id"]: json.loads(x) for x in said}
    told = lambda n: json.loads(by[n]["result"]["content"][0]["text"])
    assert by[1]["result"]["serverInfo"]["name"] == "strataloom" and len(by[2]["result"]["tools"]) > 15
    assert told(3)["rows"][0]["key"] == "src/utils.ts" and told(4)["count"] == 1 and told(8)["rows"][0]["consumers"] == 1
    assert by[None]["error"]["code"] == -32700 and by[5]["error"]["code"] == by[9]["error"]["code"] == -32601 and by[6]["error"]["code"] == by[7]["error"]["code"] == -32602
    assert len(said) == 10
    made = generate.stored(spark, f"{root}/notes/tables")
    with open(f"{root}/notes/tables/notes/src/utils.ts.json") as f:
        assert json.load(f)["file_path"] == "src/utils.ts"
    assert {(r["src"], r["dst"]) for r in made.edges.collect()} == {("src/index.ts", "src/utils.ts"), ("src/orders.service.ts", "lib/deep.ts")}
    notes = {r["file_path"]: r["debug_signals"] for r in made.notes.collect()}
    assert notes["src/utils.ts"]["coverage_pct"] == 0.25 and notes["src/orders.service.ts"]["churn_score"] == 2
    asked = {r["path"]: r for r in generate.prompted(made.signals, made.files, made.edges, made.files, config.Config(root), generate.Provider(str, "m")).collect()}
    assert asked["src/orders.service.ts"]["file_type"] == "service" and "lib/deep.ts: deep" in asked["src/orders.service.ts"]["prompt"]
    old = made.notes.where("file_path = 'src/index.ts'")
    assert generate.merged_notes(made.notes, old, made.files).count() == 4
    made.postings = made.grams = None
    assert protocol.serve.call(made, "full_text_search", query="FIXME: mo").first()["key"] == "src/utils.ts"
    before = {r["file_path"]: r["generated_at"] for r in made.notes.collect()}
    said.clear()
    cli.main(["generate", "--root", root], said.append)
    assert said[0].startswith("0 of 4 notes made")
    cli.main(["update", "--root", root], said.append)
    assert said[1] == "0 stale notes"
    old = generate.stored(spark, f"{root}/notes/tables")
    assert {r["file_path"]: r["generated_at"] for r in old.notes.collect()} == before
    aged = generate.saved(old.notes.withColumn("generated_at", F.when(F.col("file_path") == "lib/deep.ts", F.lit("2001-01-01").cast("timestamp")).otherwise(F.col("generated_at"))), "aged")
    times = aged.select(F.col("file_path").alias("path"), "generated_at")
    generate.write(dataclasses.replace(old, notes=aged, index=generate.saved(old.index.drop("generated_at").join(times, "path").select(*old.index.columns), "index")), f"{root}/notes/tables")
    said.clear()
    cli.main(["update", "--root", root], said.append)
    assert said[0] == "1 stale notes" and said[1].startswith("1 of 4 notes made")
    now = {r["file_path"]: r["generated_at"] for r in generate.stored(spark, f"{root}/notes/tables").notes.collect()}
    assert now.pop("lib/deep.ts") > before.pop("lib/deep.ts") and now == before
    assert generate.index.ranked(generate.stored(spark, f"{root}/notes/tables").index).count() == 4


def a_model():
    """A model that knows of one pitfall, breaks on a file, and is paid; a function of its own, so that workers need no module of the tests."""

    def reply(prompt):
        if "File: src/broken.ts" in prompt:
            raise ValueError("no such file")
        field = lambda *inferred: {"observed": [], "inferred": list(inferred), "confidence": 0.9, "evidence": [{"type": "code", "detail": "read"}]}
        note = {n: field() for n in ("purpose", "invariants", "sensitive_dependencies", "important_decisions", "impact_validation")} | {"known_pitfalls": field("mind the gap", prompt.count("Keep to the plan") * "context")}
        return {"content": "```json\n" + json.dumps(note) + "\n```", "usage": {"cost": 0.25}}

    return reply


def test_runs_ask_a_model(spark, tmp_path, monkeypatch):
    """Files that matter are asked about once, failures keep the static note, usage is counted as tables are written; cached files are not asked about."""
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("import { b } from './b'\nimport x from './broken'\n")
    (tmp_path / "src/b.ts").write_text("export const b = process.env.B\n")
    (tmp_path / "src/broken.ts").write_text("export default 1\n")
    (tmp_path / "strataloom.context.md").write_text("  Keep to the plan\n")
    (tmp_path / "strataloom.json").write_text(json.dumps({"llm_threshold": 0}))
    module = types.ModuleType("fake_model")
    module.ask = a_model()
    monkeypatch.setitem(sys.modules, "fake_model", module)
    said = []
    cli.main(["generate", "--root", str(tmp_path), "--provider", "fake_model:ask", "--model", "fake", "--dry-run"], said.append)
    assert said == ["3 to write, 0 to skip, 3 for a model"]
    said.clear()
    cli.main(["generate", "--root", str(tmp_path), "--provider", "fake_model:ask", "--model", "fake", "--verbose"], said.append)
    figures = dict(x.split(": ", 1) for x in said[1:] if not x.startswith("top"))
    assert said[0].startswith("3 of 3 notes made") and figures["calls"] == "3" and figures["failed_calls"] == "1" and figures["cost"] == "0.5"
    assert figures["synthesised"] == "2" and figures["parse_errors"] == "0" and figures["edges"] == "2" and figures["divergences"] == "info 0"
    assert sum(x.startswith("top: src/") for x in said) == 3
    made = generate.stored(spark, f"{tmp_path}/.ai-notes/tables")
    notes = {r["file_path"]: r for r in made.notes.collect()}
    assert {k: r["model"] for k, r in notes.items()} == {"src/a.ts": "fake", "src/b.ts": "fake", "src/broken.ts": "static"}
    assert notes["src/a.ts"]["known_pitfalls"]["inferred"] == ["mind the gap", "context"] and notes["src/a.ts"]["debug_signals"]["direct_dep_count"] == 2
    assert {r["path"]: r["model"] for r in made.index.collect()}["src/b.ts"] == "fake"
    assert {r["path"]: (r["cost"], r["error"]) for r in made.calls.collect()}["src/broken.ts"] == (None, "ValueError: no such file")
    assert protocol.serve.call(made, "full_text_search", query="gap").count() == 2
    said.clear()
    cli.main(["generate", "--root", str(tmp_path), "--provider", "fake_model:ask", "--verbose"], said.append)
    assert said[0].startswith("0 of 3 notes made") and "calls: 0" in said and "cost: 0" in said and "synthesised: 2" in said


def test_a_better_model_for_high_scores(spark):
    one = "struct<observed:array<string>,inferred:array<string>,confidence:double,evidence:array<struct<type:string,detail:string>>>"
    bare = F.struct(F.array().cast("array<string>").alias("observed"), F.array().cast("array<string>").alias("inferred"), F.lit(0.1).alias("confidence"), F.array().cast("array<struct<type:string,detail:string>>").alias("evidence")).cast(one)
    names = spark.createDataFrame([(f"f{k}", k % 2 == 0) for k in range(9)], "path string, premium boolean")
    notes = names.select(F.col("path").alias("file_path"), *(bare.alias(n) for n in generate.rules.NOTE_FIELDS), F.lit("static").alias("model"))
    provider = generate.Provider(a_model(), "small", premium=generate.Provider(a_model(), "large"))
    made, calls = generate.synthesised_notes(notes, names.where("path != 'f8'"), names.select("path", F.lit("File: x").alias("prompt")), provider, 3)
    assert {r["file_path"]: r["model"] for r in made.collect()} == {f"f{k}": "static" if k == 8 else "large" if k % 2 == 0 else "small" for k in range(9)}
    assert calls.count() == 8 and generate.prompts.usage(calls).first()["cost"] == 2.0


def test_watching_applies_changes_as_they_come(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("import { b } from './b'\n")
    (tmp_path / "src/b.ts").write_text("export const b = 1\n")
    said = []
    cli.main(["generate", "--root", str(tmp_path)], said.append)
    own = config.load_config(str(tmp_path))
    query = cli.watching(spark, own, said.append, 0.5)
    while not (tmp_path / ".ai-notes/watch/looks/seen.json").exists():
        time.sleep(0.2)
    (tmp_path / "src/b.ts").write_text("// TODO: more\nexport const b = 1\n")
    end = time.time() + 300
    while len(said) < 2 and time.time() < end:
        time.sleep(0.5)
    query.stop()
    assert said[1] == "1 files changed"
    notes = {r["file_path"]: r["known_pitfalls"]["observed"] for r in generate.stored(spark, f"{tmp_path}/.ai-notes/tables").notes.collect()}
    assert "TODO: more" in notes["src/b.ts"] and set(notes) == {"src/a.ts", "src/b.ts"}


def test_pages_bring_all_rows(spark):
    """3,000 nodes and repeated, null and descending keys come whole, in order, whatever the page; two repositories, and no other, are read."""
    nodes = spark.createDataFrame([(f"f{k % 1_500:04d}", k % 7 * 0.1 if k % 50 else None, ["x"]) for k in range(3_000)], "path string, score double, more array<string>").repartition(5)
    for order, size in (([("path", True)], 1_000), ([("score", False), ("path", True)], 701)):
        rows, mark, pages = [], None, 0
        while pages == 0 or mark is not None:
            page, mark = protocol.page_of(nodes, order, json.loads(json.dumps(mark)) if mark else None, size)
            rows, pages = rows + page, pages + 1
            assert len(page) <= size
        sort = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]
        assert pages == -(-3_000 // size)
        assert [(r["path"], r.get("score")) for r in rows] == [(r["path"], r["score"]) for r in nodes.orderBy(*sort, "score").collect()]
    run = lambda name: types.SimpleNamespace(nodes=nodes.where(F.col("path") == name))
    repositories = {"a": ("/a", run("f0001")), "b": ("/b", run("f0002")), "c": ("/c", None)}
    found = protocol.called(repositories, "get_graph", {"repo": "a,b", "page": 3})
    assert found["more"] and [r["repo"] for r in found["rows"]] == ["a", "a", "b"]
    rest = protocol.called(repositories, "get_graph", {"repo": "a,b", "page": 3, "after": found["next"]})
    assert [(r["repo"], r["path"]) for r in rest["rows"]] == [("b", "f0002")] and not rest["more"] and rest["next"] is None
    with pytest.raises(protocol.Refused):
        protocol.called(repositories, "get_graph", {"repo": "a,x"})


def test_one_run_at_a_time():
    job, gate = protocol.Job(), []
    job.start(lambda say: (say("a"), say("b"), gate or time.sleep(0.5)))
    with pytest.raises(protocol.Refused):
        job.start(lambda say: None)
    while job.running:
        time.sleep(0.05)
    assert job.status(1) == {"running": False, "error": None, "lines": ["b"], "next": 2}
    job.start(lambda say: 1 / 0, wait=True)
    assert job.status()["error"].startswith("ZeroDivisionError")


def test_runs_by_request(spark, tmp_path):
    (tmp_path / "a.ts").write_text("export const a = 1\n")
    cli.main(["generate", "--root", str(tmp_path)], [].append)
    (tmp_path / "b.ts").write_text("import { a } from './a'\n")
    call = lambda name, **a: json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})
    said = []

    def lines():
        yield call("start_run")
        yield call("start_run")
        while json.loads(json.loads(said[-1]).get("result", {"content": [{"text": '{"running": true}'}]})["content"][0]["text"])["running"]:
            time.sleep(0.5)
            yield call("run_status", since=0)
        yield call("get_graph")
        yield call("run_status", repo="none")
        yield json.dumps({"jsonrpc": "2.0", "id": 2, "method": "tools/list"})

    cli.serve(spark, cli._parser().parse_args(["serve", "--root", str(tmp_path)]), said.append, lines())
    replies = [json.loads(x) for x in said]
    assert replies[1]["error"]["code"] == 409 and replies[-2]["error"]["code"] == -32602
    status = json.loads(replies[-4]["result"]["content"][0]["text"])
    assert not status["running"] and status["error"] is None and status["lines"][0].startswith("1 of 2 notes made") and status["next"] == 1
    assert json.loads(replies[-3]["result"]["content"][0]["text"])["count"] == 2
    assert {"start_run", "run_status"} <= {t["name"] for t in replies[-1]["result"]["tools"]}


def test_renames_are_followed(spark, root):
    rows = [("b", "1", 1, None), ("c", "2", 2, "b"), ("d", "3", 3, "c"), ("b", "4", 4, None), ("x", "5", 5, None)]
    own = spark.createDataFrame(rows, "file string, commit string, at int, was string").withColumn("at", F.timestamp_seconds("at"))
    assert {(r["file"], r["commit"]) for r in git_log.followed(own).collect()} == {("d", "1"), ("d", "2"), ("d", "3"), ("b", "4"), ("x", "5")}


def test_names_of_all_kinds(spark, tmp_path):
    """History, renames and differences of names that git would quote."""
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    names = ["é.ts", 'qu"ote.ts', "back\\slash.ts", "tab\there.ts", "日本.ts"]
    for name in names:
        (tmp_path / name).write_text(f"export const a = 1 // {name}\n" * 5)
    git("add", ".")
    git("commit", "-qm", "first")
    time.sleep(1.1)
    git("mv", "é.ts", "ü.ts")
    git("commit", "-qm", "second")
    (tmp_path / "日本.ts").write_text("x\n")
    git("commit", "-qam", "third")
    found = {r["file"]: r["n"] for r in git_log.history(spark, str(tmp_path)).groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {"ü.ts": 2, 'qu"ote.ts': 1, "back\\slash.ts": 1, "tab\there.ts": 1, "日本.ts": 2}
    assert {(r["path"], r["edit"]) for r in git_log.changes(spark, str(tmp_path), "HEAD~2").collect()} == {("ü.ts", "modified"), ("é.ts", "deleted"), ("日本.ts", "modified")}


def test_coverage_falls_back(spark):
    rows = [("coverage/coverage-summary.json", '{"total": {"lines": {"pct": 9}}, "/r/a.ts": {"lines": {"pct": 50}}}')]
    files = spark.createDataFrame(rows, "path string, content string")
    assert [tuple(r) for r in coverage.coverage(files, "/r").collect()] == [("a.ts", 0.5)]
    broken = files.unionByName(spark.createDataFrame([("coverage/lcov.info", "nothing of use")], "path string, content string"))
    assert coverage.coverage(broken, "/r").count() == 0


def test_aliases_of_the_first_bundler_win():
    found = config.merged_aliases('{"compilerOptions": {"paths": {"@a/*": ["x/*"], "@b": ["y"]}}}', {"metro.config.js": "alias: { '@b': 'no' }", "vite.config.js": "alias: { '@b': './z' }"})
    assert found == {"@a/*": ["x/*"], "@b": ["z"]}


def test_unreadable_state_is_empty(spark, tmp_path):
    (tmp_path / "hashes").mkdir()
    (tmp_path / "hashes" / "part-0.parquet").write_bytes(b"PAR1 no table PAR1")
    assert documents.state(spark, str(tmp_path / "hashes"), "path string, hash string").count() == 0
    assert documents.state(spark, str(tmp_path / "none"), "path string, hash string").count() == 0


def test_components_by_colouring(spark):
    """Against Kosaraju's two passes on random graphs, self-loops included."""
    import random

    r = random.Random(3)
    edges = [(a, b) for k in range(4) for a, b in ((100 * k + r.randint(0, 14), 100 * k + r.randint(0, 14)) for _ in range(18))]
    ahead = {n: {b for a, b in edges if a == n} for e in edges for n in e}

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            for b in ahead[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    all_reach = {n: reach(n) for n in ahead}
    expected = {n: min(m for m in all_reach[n] if n in all_reach[m]) for n in ahead if n in all_reach[n]}
    found = graph.strong_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["node"]: r["component"] for r in found.collect()} == expected


def test_shapes_of_signatures():
    text = "export abstract class A extends B {\n  constructor(x: string) {}\n  get v() { return 1 }\n  a(): void {}\n  private b() {}\n  c = () => 1\n  d<T>(t: T): T { return t }\n}\ninterface P { a: string; b?: { c: number } }\nexport type L = { k: 'x'; n: 1 }\n"
    own = parsers.parse("a.ts", text)
    assert own["signatures"] == ["class A { a(): void; d(t: T): T }", "interface P { a: string; b?: { c: number } }", "type L = { k: 'x'; n: 1 }"]
    assert parsers.skeleton("a.ts", "x\n" * 300 + text).count("\n") < 20


def test_style_is_that_of_the_documents(spark):
    docs = lambda *names: governance.style(spark.createDataFrame([(n,) for n in names], "path string")).first()["style"]
    assert docs("Docs/brief.md", "Docs/plan.md", "Docs/project.md") == "nebula-like" and docs("ADR/1.md") == "custom" and docs() == "none"


def test_system_prompt():
    assert "English" in prompts.system_prompt() and "pt-BR" in prompts.system_prompt("pt-BR") and "## Project context" in prompts.system_prompt("en", "x")
