"""Notes: everything known of a file as items of six fields, put together into one nested record in the row of its signals.

Items are lists of strings, named by the list of the field that they belong to; positions order the items of a list.
"""

from __future__ import annotations

import contextlib
import functools
import os

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, rules, scoring, text
from ..functions.scoring import as_score

SCHEMA_VERSION = "1.0.0"
_s = F.lit
#: Items: the field and its list that they belong to, their place there, and an array of them.
Item = tuple[str, str, int, Column]


def _texts(strings: Column, field: str, pos: int, form=lambda x: x) -> Item:
    return field, "observed", pos, F.transform(strings, lambda x: form(x))


def _evidence(strings: Column, field: str, pos: int, kind: str, form=lambda x: x) -> Item:
    return field, "evidence", pos, F.transform(strings, lambda x: F.struct(_s(kind).alias("type"), form(x).alias("detail")))


def _both(strings: Column, field: str, pos: int, kind: str, said=lambda x: x, proof=lambda x: x) -> list[Item]:
    return [_texts(strings, field, pos, said), _evidence(strings, field, pos, kind, proof)]


def _if(test: Column, string: Column) -> Column:
    return F.when(test, F.array(string)).otherwise(F.array().cast("array<string>"))


def _pre(prefix: str, suffix: str = ""):
    return lambda x: F.concat(_s(prefix), x, _s(suffix))


def signals(analyses: DataFrame, edges: DataFrame, tests: DataFrame, coverage: DataFrame, git: DataFrame, cyclic: DataFrame, divergences: DataFrame, governance: DataFrame) -> DataFrame:
    """All inputs of a note, a row for each analysed file: left joins by path, absent lists empty and absent counts 0.

    edges (src, dst), tests (path, test), coverage (path, coverage_pct), git (file, ...), cyclic (node), divergences (file, ...),
    governance (path, governing_docs, constraints, decisions).
    """
    strings = F.array().cast("array<string>")
    lists = {
        "consumers_list": edges.groupBy(F.col("dst").alias("path")).agg(F.sort_array(F.collect_list("src")).alias("consumers_list")),
        "dependencies_list": edges.groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_list("dst")).alias("dependencies_list")),
        "related_tests": tests.groupBy("path").agg(F.sort_array(F.collect_set("test")).alias("related_tests")),
    }
    found = divergences.where("file IS NOT NULL").groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("type", "severity", "message", "doc"))).alias("divergences"))
    out = analyses
    for name, own in lists.items():
        out = out.join(own, "path", "left").withColumn(name, F.coalesce(name, strings))
    out = out.join(coverage, "path", "left").join(git.withColumnRenamed("file", "path"), "path", "left").join(found, "path", "left").join(governance, "path", "left")
    out = out.join(cyclic.select(F.col("node").alias("path"), _s(True).alias("cyclic")), "path", "left")
    for name in ("recent_messages", "governing_docs", "constraints", "decisions"):
        out = out.withColumn(name, F.coalesce(name, strings))
    for name in ("co_changed", "recent_commits", "divergences"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    out = out.fillna(0, ["churn", "authors", "max_cochange"]).fillna(False, ["cyclic"])
    some = lambda c: F.size(c) > 0
    return out.select(
        "*", F.size("consumers_list").cast("long").alias("consumers"), some("hooks").alias("has_hooks"), some("external_imports").alias("has_external_imports"), some("env_vars").alias("has_env_vars"),
        some("api_calls").alias("has_api_calls"), (F.size("comments.todo") + F.size("comments.fixme") + F.size("comments.hack") > 0).alias("has_todo_comments"), some("related_tests").alias("has_tests"),
    )


def items(language: str = "en") -> list[Item]:
    """The items of a row of signals. The sentences are fixed values: results depend on them."""
    said = lambda d: F.concat(d["signature"], F.when(d["doc_comment"].isNull(), "").otherwise(F.concat(_s(" — "), d["doc_comment"])))
    hook = lambda h: F.coalesce(F.get(F.filter("export_details", lambda d: d["name"] == h), _s(0))["signature"], F.concat(h, _s("()")))
    details = F.filter("export_details", lambda d: ~F.array_contains("hooks", d["name"]))
    first5, pct = F.slice("consumers_list", 1, 5), F.col("coverage_pct")
    percent = F.concat(F.format_number(pct * 100, 1), _s("%"))
    frequent = F.filter("co_changed", lambda c: c["count"] >= 2)
    label, validation = paths.filename_label(F.col("path")), text.validation_package(F.col("external_imports"))
    decided = F.filter("recent_messages", lambda m: text.is_decision(m, _s(language)))
    facts = scoring.cross_signals()
    loads = F.filter(facts, lambda x: F.startswith(x, _s("Importing this module")))
    others = F.filter(facts, lambda x: ~F.startswith(x, _s("Importing this module")))
    shown = lambda xs, n=None: F.array_join(F.slice(xs, 1, n) if n else xs, ", ")
    few = F.size("hooks") + F.size(details)
    plain = (F.size("export_details") == 0) & (F.size("exports") > 0) & (F.size("hooks") == 0)
    p, i, s, d, k, v = rules.NOTE_FIELDS
    return [
        *_both(_if(label.isNotNull(), label), p, 0, "code", proof=_pre("Filename pattern: ")),
        *_both(F.transform("hooks", hook), p, 1, "code", _pre("Hook: "), _pre("export function ")),
        _texts(F.transform(details, lambda x: F.concat(F.when(x["kind"] == "type", "Type: ").otherwise("Export: "), said(x))), p, 2),
        _evidence(F.transform(details, lambda x: x["signature"]), p, 2, "code"),
        *_both(_if(plain, shown("exports")), p, 3, "code", _pre("Exports: "), _pre("Exported symbols: ")),
        *_both(_if(F.col("has_side_effects") & (few <= 1), _s("Has side effects (module-level execution)")), p, 4, "code", proof=lambda x: _s("Module has top-level side effects")),
        _texts(_if(F.col("has_api_calls") & (few <= 2), shown("api_calls", 3)), p, 5, _pre("Makes API calls: ")),
        _evidence(_if(F.col("has_api_calls") & (few <= 2), shown("api_calls")), p, 5, "code", _pre("API calls: ")),
        _evidence(_if(F.col("consumers") > 0, shown("consumers_list", 3)), p, 6, "graph", _pre("Consumed by: ")),
        *_both(F.col("governing_docs"), p, 7, "doc", _pre("Governed by: "), _pre("Governance document: ")),
        *_both(F.col("comments.invariant"), i, 0, "comment"),
        *_both(_if(validation.isNotNull(), validation), i, 1, "code", _pre("Runtime schema validation via '", "'"), _pre("import from '", "'")),
        _texts(_if(F.col("has_env_vars"), shown("env_vars")), i, 2, _pre("Requires env vars to be set: ")),
        _evidence(F.col("env_vars"), i, 2, "code", _pre("process.env.")),
        _texts(_if(F.col("has_hooks"), _s('Exported hooks must follow React hooks rules (name starts with "use")')), i, 3),
        _evidence(_if(F.col("has_hooks"), shown("hooks")), i, 3, "code", _pre("hooks: ")),
        *_both(text.import_labels(F.col("external_imports")), i, 4, "code"),
        *_both(loads, i, 5, "code"),
        *_both(F.col("constraints"), i, 6, "doc", _pre("Doc constraint: ")),
        *_both(F.col("external_imports"), s, 0, "code", proof=_pre("import from '", "'")),
        *_both(first5, s, 1, "graph", proof=_pre("Reverse dep: ")),
        *_both(F.col("comments.decision"), d, 0, "comment"),
        *_both(decided, d, 1, "git", _pre('Commit: "', '"')),
        *_both(F.col("decisions"), d, 2, "doc", _pre("Doc decision: ")),
        *(x for n, tag in enumerate(("todo", "fixme", "hack")) for x in _both(F.col(f"comments.{tag}"), k, n, "comment")),
        _evidence(text.risky_messages(F.col("recent_messages")), k, 3, "git"),
        _texts(_if(F.size(frequent) > 0, F.array_join(F.transform(frequent, lambda c: c["path"]), ", ")), k, 4, _pre("Co-changes frequently with: ")),
        _evidence(_if(F.size(frequent) > 0, F.size(frequent).cast("string")), k, 4, "git", _pre("Co-changed with ", " files (see impactValidation)")),
        *_both(_if(F.col("cyclic"), _s("Participates in a circular import cycle")), k, 5, "graph", proof=lambda x: _s("File is part of a circular dependency cycle")),
        _texts(F.transform("divergences", lambda x: F.concat(F.when(x["severity"] == "error", "Divergence (error): ").when(x["severity"] == "warn", "Divergence: ").otherwise("Divergence (info): "), x["message"])), k, 6),
        _evidence(F.transform("divergences", lambda x: F.concat(F.when(x["doc"].isNull(), "").otherwise(F.concat(x["doc"], _s(": "))), x["message"])), k, 6, "doc"),
        *_both(others, k, 7, "graph"),
        *_both(F.col("consumers_list"), v, 0, "graph", proof=_pre("Consumer: ")),
        *_both(F.col("related_tests"), v, 1, "test", proof=_pre("Related test: ")),
        _texts(F.transform("co_changed", lambda c: c["path"]), v, 2),
        _evidence(F.transform("co_changed", lambda c: F.concat(_s("Co-changed "), c["count"].cast("string"), _s("x: "), c["path"])), v, 2, "git"),
        _texts(_if(pct.isNotNull(), F.when(pct < 0.5, F.concat(_s("Low line coverage: "), percent, _s(" — high risk for regressions"))).otherwise(F.concat(_s("Line coverage: "), percent))), v, 3),
        _evidence(_if(pct.isNotNull(), percent), v, 3, "test", _pre("Coverage report: ", " lines covered")),
    ]


def assembled(own: DataFrame, generated_at: Column, language: str = "en") -> DataFrame:
    """A nested note for each file of signals: observed texts once each (case apart), evidence, confidence, score, signals.

    All of a note is in one row, so nothing is dealt anew.
    """
    told = sorted(items(language), key=lambda x: x[2])
    none = F.array().cast("array<string>")

    def listed(name: str, kind: str, form: str) -> Column:
        return F.coalesce(F.concat(*(x.cast(form) for field, part, _, x in told if (field, part) == (name, kind))), F.array().cast(form))

    # Texts are a column of their own first, so that they are made once, not for each use of them.
    texts = own.select("*", *(listed(f, "observed", "array<string>").alias(f"{f}_observed") for f in rules.NOTE_FIELDS))

    def once(name: str) -> Column:
        return F.aggregate(f"{name}_observed", none, lambda done, x: F.when(F.exists(done, lambda y: F.lower(y) == F.lower(x)), done).otherwise(F.concat(done, F.array(x))))

    folded = texts.select("*", *(once(f).alias(f"{f}_once") for f in rules.NOTE_FIELDS))

    def field(name: str) -> Column:
        full, bare = rules.CONFIDENCE[name]
        said, proof = F.col(f"{name}_once"), listed(name, "evidence", "array<struct<type:string,detail:string>>")
        return F.struct(said.alias("observed"), none.alias("inferred"), F.when(F.size(said) > 0, full).otherwise(bare).cast("double").alias("confidence"), proof.alias("evidence")).alias(name)

    debug = F.struct(
        F.col("consumers").alias("reverse_dep_count"), F.size("dependencies_list").cast("long").alias("direct_dep_count"), "has_hooks", "has_external_imports", "has_env_vars", "has_api_calls", "has_todo_comments",
        "has_tests", "coverage_pct", F.col("churn").alias("churn_score"), F.col("authors").alias("author_count"), F.col("co_changed").alias("co_changed_files"),
    )
    return folded.select(
        _s(SCHEMA_VERSION).alias("schema_version"), F.col("path").alias("file_path"), *map(field, rules.NOTE_FIELDS), F.col("recent_commits").alias("recent_changes"),
        as_score(scoring.criticality_points()).alias("criticality_score"), debug.alias("debug_signals"), generated_at.alias("generated_at"), _s("static").alias("model"),
    )


def all_items(field: Column) -> Column:
    return F.concat(field["observed"], field["inferred"])


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, score_delta, and for each field what was added and removed; files with no difference are left out."""
    a, b = old.alias("a"), new.alias("b")
    own = a.join(b, F.col("a.file_path") == F.col("b.file_path"))
    both = [(f, all_items(F.col(f"a.{f}")), all_items(F.col(f"b.{f}"))) for f in rules.NOTE_FIELDS]
    fields = [F.struct(text.bag_minus(y, x).alias("added"), text.bag_minus(x, y).alias("removed")).alias(f) for f, x, y in both]
    delta = F.col("b.criticality_score") - F.col("a.criticality_score")
    out = own.select(F.col("b.file_path").alias("file_path"), delta.alias("score_delta"), *fields)
    changed = functools.reduce(lambda x, y: x | y, ((F.size(F.col(f)["added"]) > 0) | (F.size(F.col(f)["removed"]) > 0) for f in rules.NOTE_FIELDS))
    return out.where(changed | (F.abs("score_delta") >= 0.01))


def diff_texts(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, text: the report of each note that changed."""
    fields = {f: (F.col(f)["added"], F.col(f)["removed"]) for f in rules.NOTE_FIELDS}
    return differences(old, new).select("file_path", text.diff_report(F.col("file_path"), F.col("score_delta"), fields).alias("text"))


def search_documents(notes: DataFrame) -> DataFrame:
    """id, a text for each field, and all evidence: what the index is built on."""
    fields = [F.array_join(all_items(F.col(f)), " ").alias(f) for f in rules.NOTE_FIELDS]
    proof = F.array_join(F.flatten(F.array(*(F.transform(F.col(f)["evidence"], lambda e: e["detail"]) for f in rules.NOTE_FIELDS))), " ")
    return notes.select(F.col("file_path").alias("id"), *fields, proof.alias("evidence"))


def markdown(notes: DataFrame) -> DataFrame:
    """file_path, text: a page for each note; empty sections are left out."""

    def section(name: str) -> Column:
        own = F.col(name)
        title = name.replace("_", " ").title()
        rows = F.array_join(F.transform(own["observed"], lambda x: F.concat(_s("- "), x)), "\n")
        guessed = F.array_join(F.transform(own["inferred"], lambda x: F.concat(_s("> "), x)), "\n")
        cell = lambda x: F.replace(x, _s("|"), _s("\\|"))
        proof = F.array_join(F.transform(own["evidence"], lambda e: F.concat(_s("| "), e["type"], _s(" | "), cell(e["detail"]), _s(" |"))), "\n")
        whole = F.concat_ws("\n\n", _s(f"## {title}"), F.nullif(rows, _s("")), F.nullif(guessed, _s("")), F.when(F.size(own["evidence"]) > 0, F.concat(_s("| type | detail |\n|-|-|\n"), proof)))
        return F.when(F.size(all_items(own)) > 0, whole)

    log = F.array_join(F.transform("recent_changes", lambda c: F.concat(_s("- "), F.date_format(c["date"], "yyyy-MM-dd"), _s(" `"), F.left(c["hash"].cast("string"), _s(7)), _s("` "), c["message"], _s(" ("), c["author"], _s(")"))), "\n")
    head = F.concat(_s("# "), "file_path", _s("\n\nscore "), F.col("criticality_score").cast("string"), _s(", model "), "model")
    return notes.select("file_path", F.concat_ws("\n\n", head, *map(section, rules.NOTE_FIELDS), F.when(F.size("recent_changes") > 0, F.concat(_s("## Changes\n\n"), log))).alias("text"))


def pretty(own: DataFrame) -> DataFrame:
    """file_path, text: each note as indented JSON."""
    return own.select("file_path", F.to_json(F.struct(*own.columns), {"pretty": "true"}).alias("text"))


def write_files(own: DataFrame, folder: str) -> None:
    """A pretty JSON file for each note, at its own path and ".json" below a folder; a path that leads out of the repository is an error.

    A file is written under another name and then renamed, so that a reader, or a task that runs twice, never meets half of one.
    """
    outside = own.where(F.col("file_path").rlike(r"(^|/)\.\.(/|$)") | F.startswith("file_path", F.lit("/"))).select("file_path").limit(1).collect()
    if outside:
        raise ValueError(f"{outside[0][0]!r} leads out of {folder!r}")

    def put(rows):
        attempt = TaskContext.get().taskAttemptId()
        for r in rows:
            target = os.path.join(folder, f"{r['file_path']}.json")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(f"{target}.{attempt}", "w", encoding="utf-8") as f:
                f.write(r["text"])
            os.replace(f"{target}.{attempt}", target)

    pretty(own).select("file_path", "text").foreachPartition(put)


def remove_files(spark, folder: str, present: DataFrame, before: DataFrame | None) -> None:
    """Deletes the files of notes that there were before (file_path) and are no longer."""
    if before is None:
        return

    def drop(rows):
        for r in rows:
            with contextlib.suppress(FileNotFoundError):
                os.remove(os.path.join(folder, f"{r['file_path']}.json"))

    before.join(present, "file_path", "left_anti").foreachPartition(drop)
