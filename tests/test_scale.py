"""Steps that hold at size: work dealt over cores, joins without a broadcast of what grows, no row for each pair."""

import collections
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataloom.functions import rules, storage
from strataloom.operators import delta, graph, history, notes, parsers, resolve, search, synthesis
from strataloom.plans import source_queries


def test_parsing_and_merging_use_all_cores(spark):
    """One split of input is dealt over the cores before Python sees it."""
    own = spark.range(64).coalesce(1).select(F.concat(F.lit("f"), "id", F.lit(".ts")).alias("path"), F.lit("export const a = 1").alias("content"))
    assert parsers.analyses(own).select(F.spark_partition_id().alias("p")).distinct().count() > 4
    field = F.lit(None).cast(synthesis.FIELD)
    asked = own.select("path", F.lit("no idea").alias("prompt"), *(field.alias(f) for f in rules.NOTE_FIELDS), F.lit("static").alias("model"))
    out = synthesis.synthesised(asked, lambda prompt: prompt, "fake", delays=())
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert out.where("model = 'static' AND call.error IS NOT NULL").count() == 64


def test_objects_of_a_reply(spark):
    """Braces in strings, escapes and strings that are not closed, against a walk by character."""

    def walk(text):
        for start in (k for k, c in enumerate(text) if c == "{"):
            depth, quoted, escaped = 0, False, False
            for at in range(start, len(text)):
                c = text[at]
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = quoted
                elif c == '"':
                    quoted = not quoted
                elif not quoted and c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        yield text[start : at + 1]
                        break

    r = random.Random(3)
    for _ in range(5_000):
        text = "".join(r.choice('{}"\\ax\n') for _ in range(r.randint(0, 14)))
        assert list(synthesis._objects(text)) == list(walk(text))


def test_first_pairs_of_large_commits(spark, monkeypatch):
    """The first pairs of each file are those of all pairs, whatever larger commits files share; a commit of all files makes no row for each pair."""
    monkeypatch.setattr(history, "PIECE", 10)
    for seed in range(3):
        r = random.Random(seed)
        rows = [(f"f{k}", c) for c, share in (("all", 1.0), ("x", 0.5), ("y", 0.3), ("z", 0.3)) for k in range(60) if r.random() < share]
        rows += [(f"f{r.randrange(70)}", f"c{r.randrange(30)}") for _ in range(90)]
        own = spark.createDataFrame(rows, "file string, commit string")
        for keep in (1, 4):
            wanted = {}
            for x in sorted(history.pair_counts(own).collect(), key=lambda x: (x["file"], -x["n"], x["other"])):
                wanted.setdefault(x["file"], []).append((x["other"], x["n"]))
            found = {}
            for x in sorted(history.cochanged(own, keep).collect(), key=lambda x: (x["file"], x["rank"])):
                found.setdefault(x["file"], []).append((x["other"], x["n"]))
            assert found == {f: v[:keep] for f, v in wanted.items()}
    monkeypatch.setattr(history, "PIECE", 1_000)
    everything = spark.range(3_000).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("all").alias("commit"))
    assert history.best_pairs(everything, 10).count() <= 3_000 * 11


@pytest.mark.parametrize("seed", [0, 3])
def test_large_graphs_go_by_parts(spark, monkeypatch, seed):
    """Parts of a graph in bins of tasks, and one too large for a task, against brute force."""
    r = random.Random(seed)
    edges = [(base + r.randrange(n), base + r.randrange(n)) for base, n, k in [(100 * b, 1 + 2 * b, b * (2 + seed)) for b in range(1, 9)] for _ in range(k)]
    edges += [(2_000 + k, 2_001 + k) for k in range(70)] + [(2_070, 2_050)]
    monkeypatch.setattr(graph, "LOCAL_EDGES", 40 if seed < 2 else 100)
    monkeypatch.setattr(graph, "BIN_EDGES", 30)
    monkeypatch.setattr(graph, "BLOCK_TARGETS", 64)
    ahead = {n: {b for a, b in edges if a == n} for e in edges for n in e}

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            for b in ahead[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    all_ = {n: reach(n) for n in ahead}
    own = spark.createDataFrame(edges, "src long, dst long")
    calls = []
    whole = graph.local_closures
    monkeypatch.setattr(graph, "local_closures", lambda e: calls.append(1) or whole(e))
    counts = {x["node"]: (x["transitive_dependencies"], x["transitive_dependents"]) for x in graph.closure_counts(own).collect()}
    assert calls and counts == {n: (len(all_[n] - {n}), sum(n in v for m, v in all_.items() if m != n)) for n in all_}
    found = {x["node"]: x["component"] for x in graph.strong_components(own).collect()}
    assert found == {n: min(m for m in all_[n] if n in all_[m]) for n in all_ if n in all_[n]}


def plans_saved(monkeypatch, *modules):
    """The plans of all that these modules save from here on."""
    plans = []
    for module in modules:
        monkeypatch.setattr(module, "saved", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or storage.saved(df, name))
    return plans


def test_components_after_changes_are_joined_without_a_broadcast(spark, monkeypatch):
    """Sides of joins that grow with the graph are never sent to the driver, whatever the rounds, and components are those of the graph after the changes."""
    monkeypatch.setattr(storage, "FEW_ROWS", -1)
    monkeypatch.setattr(graph, "LOCAL_EDGES", 60)
    r = random.Random(5)
    rows = [(20 * (k // 40) + r.randrange(20), 20 * (k // 40) + r.randrange(20), r.random() < 0.1, r.random() < 0.1) for k in range(240)]
    own = spark.createDataFrame(rows, "src long, dst long, came boolean, went boolean")
    before = graph.strong_components(own.where("NOT came")).localCheckpoint()
    after = own.where("NOT went").select("src", "dst").distinct().localCheckpoint()
    plans = plans_saved(monkeypatch, graph, delta)
    found = delta.applied(before, delta.components(before, own.where("went"), own.where("came"), after))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, graph.strong_components(after).collect()))


def test_cycles_are_searched_without_a_broadcast(spark, monkeypatch):
    """No join of the search for cycles sends a side that grows with the graph to the driver."""
    monkeypatch.setattr(storage, "FEW_ROWS", -1)
    plans = plans_saved(monkeypatch, graph)
    own = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1), (4, 5), (5, 6), (6, 4), (6, 7), (7, 7)], "src long, dst long")
    parts = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7)], "node long, component long")
    assert sorted(map(tuple, graph.cycle_witnesses(own, parts).collect())) == [(1, [1, 2, 1]), (4, [4, 5, 6, 4]), (7, [7, 7])]
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p]


def test_directions_of_edges_send_no_components_to_the_driver(spark, monkeypatch):
    """Nodes of cycles, which are as many as the graph's, are merged; so is what a search has reached."""
    own = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4)], "src long, dst long")
    hops = spark.createDataFrame([(1, -1), (2, 0), (3, 1)], "node long, hop int").hint("merge")
    out = graph.edge_directions(own, hops, spark.createDataFrame([(1, 1), (2, 1)], "node long, component long"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, 2, "up", True), (2, 1, "neutral", True), (2, 3, "down", False)]
    monkeypatch.setattr(storage, "FEW_ROWS", -1)
    plans = plans_saved(monkeypatch, graph)
    assert graph.reach(spark.createDataFrame([(1,)], "start long"), own).count() == 3
    assert len(plans) > 3 and not [p for p in plans if "Broadcast" in p]


def test_reach_by_level(spark):
    """What nodes reach and are reached from, with levels, by a walk that takes its start."""
    r = random.Random(1)
    edges = [(r.choice("abcdefghij"), r.choice("abcdefghij")) for _ in range(16)]

    def walk(edges, start):
        seen, todo, level = {start: 0}, {start}, 0
        while todo:
            level += 1
            todo = {d for s, d in edges if s in todo and d not in seen}
            seen |= dict.fromkeys(todo, level)
        return {k: v for k, v in seen.items() if v}

    own, start = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("a",)], "start string")
    assert {x["node"]: x["level"] for x in graph.reach(start, own).collect()} == walk(edges, "a")
    assert {x["node"]: x["level"] for x in graph.impact(own, start, 2).collect()} == {k: v for k, v in walk([(b, a) for a, b in edges], "a").items() if v <= 2}


def test_imports_are_joined_without_a_broadcast(spark):
    """Files of the root, with endings, index files and the first Go file of a directory, each row of an import read once and none sent to all tasks."""
    files = spark.createDataFrame([(p,) for p in ("a.ts", "a.tsx", "index.ts", "src/index.ts", "src/b.js", "src/b", "pkg/z_test.go", "pkg/m.go")], "path string")
    said = [("src/x.ts", "../a", "a.ts"), ("x.ts", ".", "index.ts"), ("src/x.ts", ".", "src/index.ts"), ("src/x.ts", "./b", "src/b"), ("src/x.ts", "./b.js", "src/b.js"), ("x.go", "./pkg", "pkg/m.go"), ("x.ts", "./gone", None)]
    imports = spark.createDataFrame([(f, k, s) for k, (f, s, _) in enumerate(said)], "file string, pos int, specifier string")
    out = resolve.resolved(imports, files)
    assert {x["pos"]: x["target"] for x in out.collect()} == {k: t for k, (*_, t) in enumerate(said) if t}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.split("== Initial Plan ==")[0].count("SortMergeJoin") == 1


def test_substrings_are_looked_up_where_the_index_is_read(spark, monkeypatch):
    """Queries are not what the index is dealt by, no pair of a query and an item is counted, and matches are those of a scan."""
    r = random.Random(2)
    texts = {k: "".join(r.choice("abC") for _ in range(12)) for k in range(200)}
    index = search.gram_index(spark.createDataFrame([(k, 0, "f", t) for k, t in texts.items()], "key int, score int, field string, text string"))
    asked = ["abca", "CBA", "aaaaa", "bcab", "xyz", "ab"]
    monkeypatch.setattr(storage, "FEW_ROWS", -1)
    plans = plans_saved(monkeypatch, search)
    out = search.substring_matches(index, spark.createDataFrame([(q,) for q in asked], "query string"))
    assert sorted((x["query"], x["key"]) for x in out.collect()) == sorted((q, k) for q in asked[:-1] for k, t in texts.items() if q.lower() in t.lower())
    assert "Window" not in plans[-1] and "Aggregate" not in plans[-1] and "Broadcast" not in plans[-1]
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()


def some_texts(spark):
    r = random.Random(4)
    words = ["license", "licence", "lisense", "token", "tokens", "tokne", "took", "apple", "unimaginable", "unimaginably", "internationalize", "internationalise"]
    return spark.createDataFrame([(k, " ".join(r.choice(words) for _ in range(1 + r.randrange(30)))) for k in range(300)], "id int, text string")


def test_one_query_makes_no_forms_of_all_terms(spark):
    """An index for one query has no forms; what it finds is what one with forms does."""
    own = some_texts(spark)
    once, kept = search.text_index(own, "id", ["text"], blocks=False), search.text_index(own, "id", ["text"])
    assert once.forms is None and kept.forms is not None
    for query in ("licens tokne", "unimaginble", "internationalyze took", "on"):
        assert sorted(map(tuple, search.matching_terms(once, query).collect())) == sorted(map(tuple, search.matching_terms(kept, query).collect()))


def test_one_query_reads_postings_once(spark, monkeypatch):
    """Bounds, the first ranges and the ranges to read are all taken from the postings of matching terms, which are saved."""
    index, kept = search.text_index(some_texts(spark), "id", ["text"], blocks=False), search.text_index(some_texts(spark), "id", ["text"])
    reads = []
    monkeypatch.setattr(search, "saved", lambda df, name: reads.append((name, any("/postings/" in f for f in df.inputFiles()))) or storage.saved(df, name))
    out = search.search(index, "license tokne", 5)
    assert [n for n, read in reads if read] == ["terms", "matched"] and not any("/postings/" in f for f in out.inputFiles())
    assert [tuple(x) for x in out.collect()] == [tuple(x) for x in search.search(kept, "license tokne", 5).collect()]


def test_generated_notes_make_no_index_of_their_texts(spark, monkeypatch):
    """What the query does not return is not written for it."""

    def never(*_, **__):
        raise AssertionError("tables of search are not read")

    monkeypatch.setattr(search, "text_index", never)
    monkeypatch.setattr(search, "gram_index", never)
    made = source_queries.generated_notes(spark, "/root/testdata/sf0.001")
    assert made.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    return sum(x.totalShuffleWrite() for x in [spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0)])


def test_history_is_dealt_in_few_bytes(spark):
    """Commits that touch the same files meet in a task before their pairs are dealt; shuffles took 2.4 times the bytes of the rows before, and 1.3 now."""
    row = F.col("id")
    folder = F.pmod(F.xxhash64(row), F.lit(20))
    path = F.concat(F.lit("packages/b"), folder, F.lit("/src/f"), F.pmod(F.xxhash64(row, F.lit(1)), F.lit(12)), F.lit(".ts"))
    commit = F.concat(F.lit("2001-01-01 00:00:00 "), F.pmod(F.xxhash64(row, F.lit(2)), F.lit(60)), F.lit(" b"), folder)
    own = storage.saved(spark.range(20_000).select(path.alias("file"), commit.alias("commit"), F.timestamp_seconds(row).alias("at"), F.lit("ann").alias("author"), F.lit("fix: it").alias("message")), "commits")
    before = shuffled(spark)
    own.repartition("file").write.format("noop").mode("overwrite").save()
    once = shuffled(spark) - before
    history.git_signals(own).write.format("noop").mode("overwrite").save()
    assert 0 < shuffled(spark) - before - once < 1.8 * once


@pytest.mark.parametrize(("piece", "hot"), [(1_000, 1_000_000), (6, 1_000_000), (1_000, 20), (6, 20)])
def test_signals_of_history(spark, monkeypatch, piece, hot):
    """Against brute force: files twice in a commit, commits of one file, nulls, large commits, files that come often."""
    monkeypatch.setattr(history, "PIECE", piece)
    monkeypatch.setattr(history, "HOT", hot)
    r = random.Random(piece + hot)
    rows = [(f"d{r.randrange(4)}/f{min(r.randrange(12), r.randrange(12))}", f"c{r.randrange(25)}", f"2024-01-{r.randrange(1, 29):02}", r.choice("xyz"), r.choice(("fix", "wip"))) for _ in range(150)]
    rows += [("d0/f0", f"c{k}", "2024-02-01", "x", "all") for k in range(25)] + [("d9/alone", "one", "2024-02-02", None, "m"), ("d9/none", None, "2024-02-02", "y", "m"), (None, "c1", "2024-02-02", "y", "m")]
    own = spark.createDataFrame(rows, "file string, commit string, at string, author string, message string").withColumn("at", F.to_timestamp("at"))
    found = {x["file"]: x for x in history.git_signals(own).where("file IS NOT NULL").collect()}
    files = {c: {x[0] for x in rows if x[1] == c and x[0]} for c in {x[1] for x in rows if x[1]}}
    assert set(found) == {x[0] for x in rows if x[0]}
    for f, x in found.items():
        mine = [k for k in rows if k[0] == f]
        assert (x["churn"], x["authors"]) == (sum(f in k for k in files.values()), len({k[3] for k in mine if k[3]}))
        near = collections.Counter(o for k in files.values() if f in k for o in k if o != f)
        first = sorted(near.items(), key=lambda o: (-o[1], o[0]))[:10]
        assert [tuple(o) for o in x["co_changed"] or []] == first and x["max_cochange"] == (first[0][1] if first else 0)
        newest = sorted(mine, key=lambda k: (k[2], k[1] or "", k[4], k[3] or ""), reverse=True)[:10]
        assert [(o["date"].strftime("%Y-%m-%d"), o["hash"], o["message"], o["author"]) for o in x["recent_commits"]] == [(k[2], k[1], k[4], k[3]) for k in newest]


@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize(("most", "names"), [(4_000_000, 500_000), (50, 500_000), (4_000_000, 5)])
def test_sums_of_pairs_are_given_out_in_parts(monkeypatch, own, most, names):
    monkeypatch.setattr(history, "MOST_PAIRS", most)
    monkeypatch.setattr(history, "MOST_NAMES", names)
    r = random.Random(most)
    lists = [sorted(r.sample(range(30), r.randrange(1, 12))) for _ in range(200)]
    batches = [pa.record_batch([pa.array(lists[k : k + 20], pa.list_(pa.int64()))], names=["files"]) for k in range(0, 200, 20)]
    found = collections.Counter()
    for x in history.summed_pairs(iter(batches), own):
        for a, b, n in zip(*(c.to_pylist() for c in x.columns), strict=True):
            found[a, b] += n
    assert found == collections.Counter((a, b) for x in lists for a in x for b in x if own or a != b)


def test_notes_are_made_in_the_rows_of_their_signals(spark):
    """Nothing is dealt anew for them: items were rows of their own, grouped and joined again."""
    made = source_queries.whole_run(spark, "/root/testdata/sf0.001")
    plan = notes.assembled(made.signals, F.lit("2001-09-01").cast("timestamp"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
