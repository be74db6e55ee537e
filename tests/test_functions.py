"""Column functions on small hand-made rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from strataloom.functions import paths, rules, scoring, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>"}[type(v)]) for k, v in values.items())))
    return row.select(column.alias("x")).first()["x"]


def each(spark, column, values):
    own = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, p string")
    return [r["x"] for r in own.select("k", column(F.col("p")).alias("x")).orderBy("k").collect()]


def test_globs(spark):
    cases = ["src/a.ts", "a.ts", "src/x/y.tsx", "src/a.test.ts", "node_modules/x/a.ts", "src/__tests__/a.ts", "src/a.d.ts"]
    found = each(spark, lambda p: paths.any_glob(p, rules.DEFAULT_INCLUDE) & ~paths.any_glob(p, rules.DEFAULT_EXCLUDE), cases)
    assert found == [True, True, True, False, False, False, False]
    assert paths.glob_regex("a{b,c}/*.ts") == r"^a\{b,c\}/[^/]*\.ts$"


def test_categories(spark):
    cases = {
        "lib/x.test.ts": "skip:test", "dist/a.js": "skip:generated", "src/package.json": "skip:config", "src/a.d.ts": "skip:type-only", "src/api/v1/route.ts": "api-route", "src/controllers/a.ts": "api-route",
        "src/useX.ts": "hook", "lib/a.ts": "lib", "packages/a/src/b.ts": "lib", "src/A.tsx": "component", "src/a.ts": "default-source", "README.md": "aux", "src\\controllers\\a.ts": "api-route", "Dockerfile": "skip:config",
    }
    assert each(spark, paths.category, list(cases)) == list(cases.values())


def test_domains(spark):
    assert each(spark, paths.domain, ["a.ts", "src/x/y.ts", "packages/core/src/a.ts", "apps/web.ts"]) == [".", "src", "packages/core", "apps/web.ts"]


def test_path_parts(spark):
    cases = ["src/a.b.ts", "x", ".env", "d/Makefile"]
    assert each(spark, paths.extension, cases) == [".ts", "", "", ""]
    assert each(spark, paths.dirname, cases) == ["src", ".", ".", "d"]
    assert each(spark, paths.normalised, ["a/./b/../c", "../x", "a//b", "a/../../b"]) == ["a/c", "../x", "a/b", "../b"]
    assert each(spark, lambda p: paths.relative(p, "/r"), ["/r/a/b", "/q/a"]) == ["a/b", "/q/a"]


def test_filename_labels(spark):
    labels = each(spark, paths.filename_label, ["src/a.controller.ts", "use-cases/a.ts", "src/useAuth.ts", "src/index.ts", "index.ts", "db/migrations/1.sql", "a.py"])
    assert [x and x.split(" ")[0] for x in labels] == ["HTTP", "Use", "React", "Barrel", None, "Database", None]


SIGNALS = {"consumers": 0, "has_hooks": False, "has_external_imports": False, "has_env_vars": False, "has_api_calls": False, "has_todo_comments": False, "has_tests": False, "churn": 0, "authors": 0, "max_cochange": 0}


@pytest.mark.parametrize(
    "more, points",
    [({}, 5), ({"has_tests": True}, 0), ({"consumers": 1}, 25), ({"consumers": 9, "has_tests": True}, 40), ({"churn": 4, "max_cochange": 3, "has_tests": True}, 19), ({"churn": 4, "max_cochange": 1, "has_tests": True}, 4),
     ({"churn": 50, "max_cochange": 5, "has_tests": True}, 15), ({"churn": 5, "max_cochange": 2, "has_tests": True}, 15), ({"authors": 4, "has_tests": True}, 5),
     ({"consumers": 9, "has_hooks": True, "has_external_imports": True, "has_env_vars": True, "has_api_calls": True, "churn": 20, "authors": 5}, 100)],
)
def test_criticality(spark, more, points):
    own = SIGNALS | more
    assert one(spark, scoring.criticality_points(), **own) == points
    assert one(spark, scoring.as_score(scoring.criticality_points()), **own) == Decimal(points) / 100
    terms = one(spark, scoring.breakdown(), **own)
    assert min(100, sum(t["points"] for t in terms)) == points and all(t["points"] <= t["most"] for t in terms)


@pytest.mark.parametrize("category, edit, points", [("default-source", "added", 40), ("api-route", "added", 60), ("component", "added", 45), ("aux", "added", 10), ("default-source", "modified", 15), ("aux", "modified", 5), ("lib", "unchanged", 10), ("skip:test", "added", 0)])
def test_boost(spark, category, edit, points):
    assert one(spark, scoring.boost_points(F.col("c"), F.col("e")), c=category, e=edit) == points


def test_cross_signals(spark):
    own = {"consumers": 3, "has_tests": False, "coverage_pct": 0.2, "has_env_vars": True, "churn": 10, "authors": 3, "has_side_effects": True}
    assert len(one(spark, scoring.cross_signals(), **own)) == 5
    assert one(spark, scoring.cross_signals(), **(own | {"consumers": 0, "has_tests": True, "churn": 1})) == []


def test_decisions_by_language(spark):
    cases = [("refactor: x", "xx", True), ("we did it because", "en", True), ("porque sim", "pt-BR", True), ("substituiu", "pt-PT", True), ("porque", "de", False), ("weil", "de-AT", True), ("chose", "zz", True), ("plain", "en", False)]
    own = spark.createDataFrame([(k, m, n) for k, (m, n, _) in enumerate(cases)], "k int, m string, n string")
    assert [r["x"] for r in own.select("k", text.is_decision(F.col("m"), F.col("n")).alias("x")).orderBy("k").collect()] == [c for *_, c in cases]


def test_imports(spark):
    assert one(spark, text.import_labels(F.col("i")), i=["redis", "knex/x", "axios/y", "redis"]) == ["Reads/writes cache", "Persists data to a database"]
    assert one(spark, text.has_side_effects(F.col("i")), i=["fast-news"]) is True
    assert one(spark, text.has_side_effects(F.col("i")), i=["left-pad"]) is False
    assert one(spark, text.validation_package(F.col("i")), i=["a", "zod/v4", "joi"]) == "zod/v4"
    assert one(spark, text.risky_messages(F.col("i")), i=["Hotfix", "plain"]) == ["Hotfix"]


def test_lists(spark):
    assert one(spark, text.bag_minus(F.col("a"), F.col("b")), a=["x", "x", "y"], b=["y"]) == ["x", "x"]
    assert one(spark, text.merged(F.col("a"), F.col("b")), a=["One"], b=[" one ", "two"]) == ["One", "two"]


def test_extractions(spark):
    source = "fetch('u1'); axios.get(\"u2\"); process.env.A_B process.env.A_B fetch('u1')"
    assert one(spark, text.api_calls(F.col("s")), s=source) == ["u1", "u2"]
    assert one(spark, text.env_vars(F.col("s")), s=source) == ["A_B"]


def test_comment_tags(spark):
    cases = ["// TODO x", "x() // fixme", "// notes", "// NOTE: y", "// NOTE", "# no", "// a HACK todo", "plain todo"]
    assert each(spark, text.comment_tag, cases) == ["todo", "fixme", None, "decision", None, None, "todo", None]
