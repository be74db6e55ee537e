"""Operators on small graphs, histories, documents and states."""

import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import business_rules, governance, graph, history, incremental, index, notes, parsers, resolve, search, synthesis


def pairs(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


@pytest.mark.parametrize(
    "edges, groups",
    [([("A", "B"), ("B", "A")], ["AB"]), ([("A", "B"), ("B", "C")], []), ([("A", "B"), ("B", "C"), ("C", "A")], ["ABC"]), ([("A", "B"), ("B", "A"), ("C", "D"), ("D", "C"), ("B", "C")], ["AB", "CD"]), ([("A", "A"), ("A", "B")], ["A"])],
)
def test_strong_components(spark, edges, groups):
    out = {}
    for r in graph.strong_components(pairs(spark, edges)).collect():
        out.setdefault(r["component"], []).append(r["node"])
    assert sorted("".join(sorted(v)) for v in out.values()) == groups


def brute_reach(edges, start):
    seen, todo, level = {start: 0}, [start], 0
    while todo:
        level += 1
        todo = [d for s, d in edges if s in todo and d not in seen]
        seen |= dict.fromkeys(todo, level)
    return {k: v for k, v in seen.items() if v}


@pytest.mark.parametrize("seed", [1, 2])
def test_reachability(spark, seed):
    r = random.Random(seed)
    edges = [(r.choice("abcdefghij"), r.choice("abcdefghij")) for _ in range(16)]
    own = pairs(spark, edges)
    start = spark.createDataFrame([("a",)], "start string")
    assert {x["node"]: x["level"] for x in graph.reach(start, own).collect()} == brute_reach(edges, "a")
    assert {x["node"]: x["level"] for x in graph.impact(own, start, 2).collect()} == {k: v for k, v in brute_reach([(b, a) for a, b in edges], "a").items() if v <= 2}
    counts = {x["node"]: (x["transitive_dependencies"], x["transitive_dependents"]) for x in graph.closure_counts(own).collect()}
    for n, c in counts.items():
        assert c == (len(brute_reach(edges, n)), len(brute_reach([(b, a) for a, b in edges], n)))


def test_degrees_count_repeats(spark):
    own = pairs(spark, [("a", "b"), ("a", "b"), ("c", "b")])
    out = {r["node"]: (r["consumers"], r["dependencies"], r["distinct_consumers"]) for r in graph.degrees(own).collect()}
    assert out == {"a": (0, 2, 0), "b": (3, 0, 2), "c": (0, 1, 0)}
    assert {r["node"]: r["consumers"] for r in graph.reverse(own, graph.nodes(own)).collect()} == {"a": [], "b": ["a", "a", "c"], "c": []}


def test_ego_prefers_upstream(spark):
    own = pairs(spark, [("a", "m"), ("m", "b"), ("b", "a"), ("x", "a")])
    hops = {r["node"]: r["hop"] for r in graph.ego(own, spark.createDataFrame([("m",)], "start string"), 1).collect()}
    assert hops == {"m": 0, "a": -1, "b": 1}


def commits(spark):
    rows = [("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y"), ("b", 2, "y"), ("c", 2, "y"), ("a", 3, "x"), ("a", 3, "x")]
    return spark.createDataFrame([(f, str(c), a, f"2024-01-{c:02}", f"m{c}") for f, c, a in rows], "file string, commit string, author string, at string, message string").withColumn("at", F.to_timestamp("at"))


def test_history(spark):
    own = commits(spark)
    assert {r["file"]: (r["churn"], r["authors"]) for r in history.churn(own).collect()} == {"a": (3, 2), "b": (2, 2), "c": (1, 1)}
    near = {(r["file"], r["other"]): (r["n"], r["rank"]) for r in history.cochanged(own).collect()}
    assert near["a", "b"] == (2, 1) and near["a", "c"] == (1, 2) and ("a", "a") not in near
    assert history.cochanged(own, most_files=2).where("file = 'c'").count() == 0
    signals = history.git_signals(own.dropDuplicates(["file", "commit"])).where("file = 'a'").first()
    assert signals["recent_messages"] == ["m3", "m2", "m1"] and signals["max_cochange"] == 2


def test_resolution_order(spark):
    files = spark.createDataFrame([("src/u.ts",), ("src/u.js",), ("src/d/index.tsx",), ("lib/x.go",), ("lib/a_test.go",), ("src/exact.css",), ("src/deep/m.py",)], "path string")
    rows = [("src/a.ts", 0, "./u"), ("src/a.ts", 1, "./d"), ("src/a.ts", 2, "@/u"), ("src/k/b.ts", 3, "../exact.css"), ("main.go", 4, "mod/lib"), ("src/a.ts", 5, "react"), ("src/a.ts", 6, "./deep/m"), ("src/a.ts", 7, "./none")]
    out = resolve.resolved(spark.createDataFrame(rows, "file string, pos int, specifier string"), files, {"@/*": ["./src/*".removeprefix("./")]}, "mod")
    assert {r["pos"]: r["target"] for r in out.collect()} == {0: "src/u.ts", 1: "src/d/index.tsx", 2: "src/u.ts", 3: "src/exact.css", 4: "lib/x.go", 6: "src/deep/m.py"}


def test_related_tests(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b/c.ts",), ("top.ts",)], "path string")
    tests = spark.createDataFrame([("test/a.test.ts",), ("src/__tests__/a-more.ts",), ("src/b/x/__tests__/c.ts",), ("other/__tests__/a.ts",), ("src/b/c.spec.tsx",)], "path string")
    out = {(r["path"], r["test"]) for r in resolve.related_tests(files, tests).collect()}
    assert out == {("src/a.ts", "test/a.test.ts"), ("src/a.ts", "src/__tests__/a-more.ts"), ("src/b/c.ts", "src/b/x/__tests__/c.ts"), ("src/b/c.ts", "src/b/c.spec.tsx")}


DOC = "intro\n# Design\n## Empty\n## Rules for src\n- keep src/core pure of input\n- tiny\n* imports go one way only\nsee `src/core/a.ts` and src/gone/b.ts, ok\n## Decisions\n- we chose tables over objects\nsrc/core must not depend on src/infra. src/a should use src/b\n"


def governed(spark):
    return spark.createDataFrame([("docs/architecture.md", "architecture", DOC)], "path string, category string, content string")


def test_governance(spark):
    docs = governed(spark)
    assert [r["heading"] for r in governance.sections(docs).orderBy("pos").collect()] == ["Rules for src", "Decisions"]
    assert {r["path"] for r in governance.mentioned(docs).collect()} == {"src/core/a.ts", "src/gone/b.ts"}
    assert [r["item"] for r in governance.constraints(docs).orderBy("rank").collect()] == ["keep src/core pure of input", "imports go one way only"]
    assert [r["item"] for r in governance.decisions(docs).collect()] == ["we chose tables over objects"]
    assert governance.titles(docs).first()["title"] == "Design" and governance.style(docs).first()["style"] == "custom"
    own = {r["path"]: r for r in governance.file_governance(docs).collect()}
    assert own["src/core/a.ts"]["constraints"] and own["src/core/a.ts"]["decisions"] == ["we chose tables over objects"]
    assert "### architecture" in governance.summary_text(docs)


def test_divergences(spark):
    files = spark.createDataFrame([("src/core/a.ts",), ("src/infra/x.ts",), ("src/new/y.ts",)], "path string")
    edges = pairs(spark, [("src/core/a.ts", "src/infra/x.ts"), ("src/infra/x.ts", "src/core/a.ts")] + [("src/core/a.ts", "src/new/y.ts")] * 5)
    out = {(r["type"], r["file"], r["evidence"]) for r in governance.divergences(governed(spark), files, edges).collect()}
    assert ("missing_file", None, "src/gone/b.ts") in out
    assert ("undocumented_hotspot", "src/new/y.ts", "5 reverse dependencies") in out
    assert {(t, f) for t, f, _ in out if t == "forbidden_dependency"} == {("forbidden_dependency", "src/core/a.ts")}
    assert {f for t, f, _ in out if t == "undeclared_domain"} == {"src/new/y.ts"}
    assert governance.forbidden_rules(governed(spark), negated_only=False).count() == 2
    nothing = governed(spark).limit(0)
    assert governance.divergences(nothing, files, edges).count() == 0


def test_business_rules():
    text = "const MAX_X = 3\nif (n >= 10) go()\nif (!isAdmin) {\n throw new ForbiddenError()\n}\nz.email().min(2)\n@IsEmail()\nconst TAX_RATE = 2\nconst retryDelay = 5\nif (bad) {\n throw new Oops()\n}\n"
    found = [(k, line) for k, _, line, _ in business_rules.rules_in(text)]
    assert found == [("numeric_limit", 1), ("numeric_limit", 2), ("permission_guard", 3), ("permission_guard", 4), ("schema_validation", 6), ("schema_validation", 7), ("business_constant", 8), ("business_constant", 9), ("conditional_throw", 10)]
    assert business_rules.rules_in("") == []


def test_fingerprints(spark):
    rows = {"same": ({"d": "1"}, {"d": "1"}), "value": ({"d": "2"}, {"d": "1"}), "added": ({"d": "1", "e": "1"}, {"d": "1"}), "removed": ({}, {"d": "1"}), "empty": ({}, {})}
    flat = lambda k: spark.createDataFrame([(p, d, h) for p, v in rows.items() for d, h in v[k].items()], "path string, dep string, hash string")
    known = spark.createDataFrame([(p,) for p in rows], "path string")
    out = {r["path"]: r["stale"] for r in incremental.stale_dependencies(flat(0), flat(1), known).collect()}
    assert out == {"same": False, "value": True, "added": True, "removed": True, "empty": False}


def test_state(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    was = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", "1")], "path string, hash string")
    state = incremental.status(now, was)
    assert {r["path"]: r["status"] for r in state.collect()} == {"a": "unchanged", "b": "changed", "c": "new", "d": "deleted"}
    merged = incremental.upserted(was, now)
    assert {(r["path"], r["hash"]) for r in merged.collect()} == {("a", "1"), ("b", "2"), ("c", "3"), ("d", "1")}
    assert {tuple(r) for r in incremental.upserted(merged, now).collect()} == {tuple(r) for r in merged.collect()}
    assert incremental.upserted(was, now, present=now).where("path = 'd'").count() == 0
    stale = spark.createDataFrame([("a", True)], "path string, stale boolean")
    assert not incremental.cache_hits(state, stale).where("hit").count()
    assert incremental.cache_hits(state, stale.where("false")).where("hit").first()["path"] == "a"


def test_quota_and_ranking(spark):
    rows = [(f"lib/file{k}.ts", "added", k) for k in range(12)] + [("lib/x.test.ts", "added", 99), ("lib/y.ts", "modified", 99)]
    own = spark.createDataFrame(rows, "path string, edit string, consumers int")
    assert [r["path"] for r in index.quota(own, 5).collect()] == [f"lib/file{k}.ts" for k in range(11, 6, -1)]
    assert index.quota(own, 0).count() == 0


def random_graphs():
    r = random.Random(6)
    out = [(a, b) for k in range(5) for a, b in ((100 * k + r.randint(0, 13), 100 * k + r.randint(0, 13)) for _ in range(16 + 3 * k))]
    return out + [(a, b) for a, b in ((r.randint(0, 450), r.randint(0, 450)) for _ in range(40)) if a // 100 < b // 100]


def brute_reach(edges):
    ahead = {n: {b for a, b in edges if a == n} for e in edges for n in e}

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            for b in ahead[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    return ahead, {n: reach(n) for n in ahead}


@pytest.mark.parametrize("local", [2_000_000, 0])
def test_components_and_reach(spark, monkeypatch, local):
    """In one task and by rounds of joins, against plain search; names as well as numbers; one target and many in a block."""
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    monkeypatch.setattr(graph, "BLOCK_TARGETS", 64)
    edges = random_graphs()
    ahead, reach = brute_reach(edges)
    expected = {n: min(m for m in reach[n] if n in reach[m]) for n in ahead if n in reach[n]}
    own = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    assert {r["node"]: r["component"] for r in graph.strong_components(own).collect()} == expected
    counts = {r["node"]: (r["transitive_dependencies"], r["transitive_dependents"]) for r in graph.closure_counts(own).collect()}
    assert counts == {n: (len(reach[n] - {n}), sum(n in reach[m] for m in ahead if m != n)) for n in ahead}
    if local:
        named = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}") for a, b in edges], "src string, dst string")
        assert {r["node"]: r["component"] for r in graph.strong_components(named).collect()} == {f"n{n:03d}": f"n{c:03d}" for n, c in expected.items()}
        assert {r["node"]: r["transitive_dependents"] for r in graph.closure_counts(named).collect()} == {f"n{n:03d}": c for n, (_, c) in counts.items()}
        nothing = spark.createDataFrame([], "src long, dst long")
        assert graph.strong_components(nothing).count() == graph.closure_counts(nothing).count() == graph.cycle_witnesses(nothing).count() == 0


def test_long_chain(spark):
    """10,000 nodes in a row, a cycle at the end: no round for each node."""
    links = [(k, k + 1) for k in range(10_000)] + [(10_000, 9_000)]
    own = spark.createDataFrame(links, "src long, dst long")
    found = {r["node"]: r["component"] for r in graph.strong_components(own).collect()}
    assert found == {n: 9_000 for n in range(9_000, 10_001)}
    counts = {r["node"]: (r["transitive_dependencies"], r["transitive_dependents"]) for r in graph.closure_counts(own).collect()}
    assert counts == {n: (10_000 - n, n) if n < 9_000 else (1_000, 10_000) for n in range(10_001)}


def test_cycle_witnesses(spark):
    """One shortest cycle for each component, the first by its nodes; a self-loop is a cycle."""
    edges = random_graphs() + [(900, 900), (901, 902), (902, 901), (901, 901)]
    ahead, reach = brute_reach(edges)
    least = {min(m for m in reach[n] if n in reach[m]) for n in ahead if n in reach[n]}
    expected = {}
    for start in least:
        paths = [[start]]
        while start not in expected:
            paths = [[*p, b] for p in paths for b in sorted(ahead[p[-1]]) if b == start or (b not in p and start in reach[b])]
            if done := [p for p in paths if p[-1] == start]:
                expected[start] = min(done)
            best = {}
            for p in sorted(paths):
                best.setdefault(p[-1], p)
            paths = list(best.values())
    found = {r["component"]: r["cycle"] for r in graph.cycle_witnesses(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == expected and found[901] == [901, 901] and any(len(c) > 3 for c in found.values())


def test_large_commits_are_cut(spark, monkeypatch):
    """Pieces of a commit give each pair once, as an uncut commit does; no key of the join has more than two pieces' pairs."""
    rows = [(f"f{k}", "big", k) for k in range(120)] + [(f"f{k}", f"c{k % 9}", k) for k in range(60)] + [("f1", "big", 1)]
    own = spark.createDataFrame(rows, "file string, commit string, n int")
    whole = {(r["file"], r["other"]): r["n"] for r in history.pair_counts(own).collect()}
    assert len(whole) == 120 * 119
    monkeypatch.setattr(history, "PIECE", 10)
    assert {(r["file"], r["other"]): r["n"] for r in history.pair_counts(own).collect()} == whole
    assert {(r["file"], r["other"]): r["n"] for r in history.pair_counts(own, most_files=100).collect()} == {k: n for k in whole if (n := whole[k] - 1)}


def test_search(spark):
    docs = spark.createDataFrame([("a", "payment gateway token", "x"), ("b", "user profile", "payment"), ("c", "something else on", "y"), ("d", "see api-route", None)], "id string, purpose string, notes string")
    built = search.text_index(docs, "id", ["purpose", "notes"])
    get = lambda q, **k: [r["key"] for r in search.search(built, q, **k).collect()]
    assert set(get("payment")) == {"a", "b"} and get("paymnt") and get("gate") == ["a"] and get("zzzzzz") == []
    assert get("gate", prefix=False, fuzzy=0) == []
    assert get("api-route") == ["d"] and get("(Profile)") == ["b"] and get("of") == []  # two letters allow for no edit
    for empty in (" ", "-"):
        with pytest.raises(ValueError):
            get(empty)


def brute_search(docs, query, limit, prefix, fuzzy):
    """BM25+ over all terms and documents."""
    import collections
    import math
    import re

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *(0 for _ in b)] if not b else _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    cut = lambda t: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w]
    fields = {f: {k: collections.Counter(cut(t[f])) for k, t in docs.items() if cut(t[f])} for f in next(iter(docs.values()))}
    weight = {}
    for term in {t for f in fields.values() for c in f.values() for t in c}:
        for w in set(cut(query)):
            most, d = round(fuzzy * len(w)), distance(term, w)
            own = 1.0 if term == w else 0.375 * len(w) / len(term) if prefix and term.startswith(w) else 0.45 / (1 + d) if 0 < d <= most else 0
            weight[term] = max(weight.get(term, 0), own)
    scores, found = collections.Counter(), collections.defaultdict(set)
    for f, own in fields.items():
        mean = sum(sum(c.values()) for c in own.values()) / len(own)
        df = collections.Counter(t for c in own.values() for t in c)
        for k, c in own.items():
            for t, tf in c.items():
                if weight[t]:
                    idf = math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5))
                    scores[k] += weight[t] * idf * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * sum(c.values()) / mean)))
                    found[k].add(f)
    return [(k, sorted(found[k])) for k in sorted(scores, key=lambda k: (-round(scores[k], 9), k))][:limit]


def test_blocks_give_the_same_best_and_are_not_all_read(spark, monkeypatch):
    """Against all scores, with several fields, prefixes, near and long words; documents that tie come by key."""
    import random

    monkeypatch.setattr(search, "BLOCK_DOCS", 4)
    r = random.Random(4)
    words = [f"w{k}" for k in range(30)] + ["license", "licence", "licenses", "internationalization", "internationalisation", "internationalizations", "lic"]
    docs = {k: {"text": " ".join(r.choices(words, k=r.randint(0, 90))), "title": r.choice(["", "license w3", "w4"])} for k in range(400)}
    docs |= {k: {"text": "license tie", "title": ""} for k in range(500, 530)}
    own = spark.createDataFrame([(k, t["text"], t["title"]) for k, t in docs.items()], "id long, text string, title string").repartition(3)
    built = search.text_index(own, "id", ["text", "title"])
    for query, limit, prefix, fuzzy in (("license w3", 10, False, 0), ("licens", 7, True, 0.2), ("internationalisations w1", 5, True, 0.2), ("tie", 12, False, 0), ("lic-w4", 50, True, 0.2), ("license", 10_000, True, 0.2)):
        out = [(x["key"], x["fields"]) for x in search.search(built, query, limit, prefix, fuzzy).collect()]
        assert out == brute_search(docs, query, limit, prefix, fuzzy), query
        assert {(x["key"]) for x in search.search(built, query, None, prefix, fuzzy).collect()} >= {k for k, _ in out}
    weights = search.weighed(built, "tie w3", False, 0)
    stored = built.blocks.join(weights, ["term", "field"])
    assert stored.join(search.ranges_to_read(built, weights, 3), "range", "left_semi").count() < 0.7 * stored.count()


def test_near_terms(spark):
    """Against all distances: words of 3 to 12 letters, one and two edits, letters beyond the BMP."""
    import random

    r = random.Random(8)
    base = ["".join(r.choices("abcé😀", k=r.randint(1, 14))) for _ in range(150)]
    known = sorted(set(base) | {b[: (k := r.randrange(len(b)))] + r.choice(["", "a", "zz"]) + b[k + r.randint(0, 1) :] for b in base for _ in range(3)} - {""})
    known = [t for t in known if len(t) <= search.FORM_LETTERS]
    words = [w for w in base if 3 <= len(w) <= 12]
    terms = spark.createDataFrame([(t,) for t in known], "term string")
    own = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    found = {tuple(x) for x in search.near_terms(own, terms.select(F.explode(search.forms_of(F.col("term"))).alias("form"), "term")).collect()}
    all_ = own.crossJoin(terms).withColumn("distance", F.levenshtein("word", "term")).where("distance BETWEEN 1 AND 2")
    assert found == {tuple(x) for x in all_.collect()} and len(found) > 100
    plan = search.near_terms(own, terms.select(F.explode(search.forms_of(F.col("term"))).alias("form"), "term"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "(form" in plan


def test_substrings_by_trigrams(spark):
    import random

    r = random.Random(5)
    rows = [(k, k % 3, r.choice(["f", "g"]), "".join(r.choices("abAB é", k=r.randint(0, 25)))) for k in range(300)] + [(1_000, 1, "f", None), (1_001, 1, "f", "")]
    items = spark.createDataFrame(rows, "key long, score long, field string, text string").repartition(3)
    index = search.gram_index(items)
    queries = sorted({t[at : at + r.randint(1, 6)] for _, _, _, t in r.sample(rows[:300], 110) if len(t) > 8 for at in [r.randrange(len(t) - 7)]} | {"zzzz", "aba", "ABA", "a", "  "})
    for q in queries:
        assert search.substring_search(index, q, 1_000).collect() == search.substring_scan(items, q, 1_000).collect(), q
    assert len(queries) >= 40
    assert [x["key"] for x in search.substring_search(index, "ABA", 2).collect()] == [x["key"] for x in search.substring_scan(items, "aba", 2).collect()]


@pytest.mark.parametrize("reply", ['{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": 1} done', 'x {"a": 1, "b": "} \\" {"} y', "{bad} then {\"a\": 1}"])
def test_tolerant_json(reply):
    assert synthesis.parsed_json(reply)["a"] == 1


@pytest.mark.parametrize("reply", ["", "none", '{"a": '])
def test_json_errors(reply):
    with pytest.raises(ValueError):
        synthesis.parsed_json(reply)


def test_replies_are_checked():
    own = {f: {"confidence": 0.5, "evidence": [{"type": "odd", "detail": 1}]} for f in ("purpose", "invariants", "sensitive_dependencies", "important_decisions", "known_pitfalls", "impact_validation")}
    assert synthesis.checked_note(own)["purpose"] == {"observed": [], "inferred": [], "confidence": 0.5, "evidence": [{"type": "code", "detail": "1"}]}
    with pytest.raises(ValueError):
        synthesis.checked_note(own | {"purpose": {"confidence": 2}})
    with pytest.raises(ValueError):
        synthesis.checked_note([])


def test_retry():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise RuntimeError("429 slow down")

    with pytest.raises(RuntimeError):
        synthesis.with_retry(fails, sleep=waits.append)
    assert waits == [1.0, 2.0, 4.0] and len(calls) == 4
    with pytest.raises(KeyError):
        synthesis.with_retry(lambda: {}["x"], sleep=waits.append)
    assert len(waits) == 3


def test_parsers():
    ts = parsers.parse("a.ts", "import a from './a'\nimport b from \"b\"\n// import c from 'c'\n/** Says. */\nexport async function useIt(x: number): Promise<void> { await import('@/lazy') }\nexport const f = (a: string) => a\nclass Hidden {}\nexport { f as g }\n// TODO: z\nconst s = `export function no() {}`\n")
    assert ts["imports"] == ["./a", "b", "@/lazy"] and ts["local_imports"] == ["./a", "@/lazy"] and ts["external_imports"] == ["b"]
    assert ts["exports"] == ["useIt", "f", "g"] and ts["hooks"] == ["useIt"] and ts["comments"]["todo"] == ["TODO: z"]
    assert ts["export_details"][0] == {"name": "useIt", "signature": "async useIt(x: number): Promise<void>", "kind": "function", "doc_comment": "Says."}
    py = parsers.parse("a.py", "import os, sys\nfrom .m import (\n x)\n__all__ = ['f']\ndef f(a):\n    '''One.'''\ndef g(): ...\nclass K: ...\nos.getenv('A_B')\n# NOTE here\n")
    assert py["imports"] == ["os", ".m"] and py["exports"] == ["f"] and py["env_vars"] == ["A_B"] and py["symbols"] == ["f", "g", "K"] and py["comments"]["decision"] == ["NOTE here"]
    assert py["export_details"][0]["doc_comment"] == "One."
    go = parsers.parse("a.go", 'package p\nimport "fmt"\nimport (\n "os"\n x "a/b"\n)\n// Run it.\nfunc (s *S) Run(a int) error {\n}\ntype T struct {\n A int\n}\nfunc hidden() {}\nvar x = os.Getenv("K")\n')
    assert go["imports"] == ["fmt", "os", "a/b"] and go["exports"] == ["Run", "T"] and go["env_vars"] == ["K"]
    assert go["export_details"][0] == {"name": "Run", "signature": "func (s *S) Run(a int) error", "kind": "function", "doc_comment": "Run it."}
    assert parsers.parse("a.css", "x") == parsers.empty() and parsers.parse("a.ts", None)["exports"] == []


def test_a_failing_parser_leaves_an_empty_row(spark, monkeypatch):
    monkeypatch.setitem(parsers.PARSERS, ".ts", lambda text, options: 1 / 0)
    assert parsers.parse("a.ts", "x")["error"].startswith("ZeroDivisionError") and parsers.parse("a.ts", "x")["imports"] == []


def test_note_differences(spark):
    names = ("purpose", "invariants", "sensitive_dependencies", "important_decisions", "known_pitfalls", "impact_validation")
    make = lambda items, score: spark.sql(f"SELECT 'a' file_path").select("file_path", F.lit(score).cast("decimal(6,2)").alias("criticality_score"), *(F.struct(F.array(*map(F.lit, items)).cast("array<string>").alias("observed"), F.array().cast("array<string>").alias("inferred"), F.lit(0.1).alias("confidence"), F.array().cast("array<struct<type:string,detail:string>>").alias("evidence")).alias(n) for n in names))
    out = notes.differences(make(["x", "y"], 0.1), make(["y", "z", "z"], 0.3)).first()
    assert out["purpose"]["added"] == ["z", "z"] and out["purpose"]["removed"] == ["x"] and float(out["score_delta"]) == 0.2
    assert notes.differences(make(["x"], 0.1), make(["x"], 0.1)).count() == 0
