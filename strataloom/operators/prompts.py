"""What a language model is asked about a file: its type, what it imports, and a prompt as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

TESTS, TEST_LINES = 3, 80
CONSUMERS, TYPE_CONSUMERS, CO_CHANGED = 8, 10, 5
DOC_BLOCKS, DOC_CHARS = 10, 20
#: What is asked for, by the type of a file.
ASKED = {
    "hook": "For each exported hook say what it manages, its parameters and result, what it depends on without saying so, and its effects.",
    "type-definition": "For each exported type say what it models, its main fields and their constraints, and who depends on its shape.",
    "service": "For each operation say what it does, its inputs and outputs, the systems it reaches, and how it fails.",
    "utility": "For each export say what it does, its parameters and result, and edge cases.",
}


def is_type_file(path: Column) -> Column:
    """Whether a path names a file of types, case apart."""
    own = F.regexp_replace(F.lower(path), r"\.tsx?$", "")
    known = F.lit(False)
    for part in rules.TYPE_FILE_PARTS:
        known = known | own.endswith(part)
    return F.lower(path).rlike(r"\.tsx?$") & known


def file_type(path: Column, hooks: Column, exports: Column, calls: Column) -> Column:
    """hook before type-definition before service (by the name of an export or a call) before utility."""
    service = F.exists(exports, lambda e: e.rlike(rules.SERVICE_EXPORT)) | (F.size(calls) > 0)
    return F.when(F.size(hooks) > 0, "hook").when(is_type_file(path), "type-definition").when(service, "service").otherwise("utility")


def dependency_exports(edges: DataFrame, analyses: DataFrame) -> DataFrame:
    """path, dependency_exports: the exports of each direct dependency that has some, by its path."""
    own = edges.select(F.col("src").alias("path"), F.col("dst").alias("dep")).distinct()
    named = analyses.where(F.size("exports") > 0).select(F.col("path").alias("dep"), "exports")
    pairs = F.array_sort(F.collect_list(F.struct("dep", "exports")))
    return own.join(named, "dep").groupBy("path").agg(F.map_from_entries(pairs).alias("dependency_exports"))


def doc_blocks(source: Column) -> Column:
    """The first blocks of documentation that say something."""
    blocks = F.regexp_extract_all(source, F.lit(r"(?s)(/\*\*.*?\*/)"), F.lit(1))
    return F.slice(F.filter(blocks, lambda b: F.length(b) > DOC_CHARS), 1, DOC_BLOCKS)


def test_excerpts(tests: DataFrame, files: DataFrame) -> DataFrame:
    """path, test_text: the first lines of the first related tests (path, test) of each file."""
    text = files.select(F.col("path").alias("test"), F.array_join(F.slice(F.split("content", "\n"), 1, TEST_LINES), "\n").alias("text"))
    own = tests.join(text, "test", "left").select("path", F.struct("test", F.concat(F.lit("// "), F.substring_index("test", "/", -1), F.lit("\n"), F.coalesce("text", F.lit("not available"))).alias("text")).alias("t"))
    first = own.groupBy("path").agg(F.slice(F.array_sort(F.collect_list("t")), 1, TESTS).alias("tests"))
    return first.select("path", F.array_join(F.transform("tests", lambda t: t["text"]), "\n\n---\n\n").alias("test_text"))


def system_prompt(language: str = "en", context: str | None = None) -> str:
    name = "English" if language == "en" else language
    more = f"\n\n## Project context\n\n{context}" if context else ""
    return (
        f"You write operational notes on single files of a code base, in {name} only.{more}\n\n"
        "Use the evidence given and nothing else. Keep what is observed apart from what is inferred. Name functions, callers and commits. "
        "Each field has observed, inferred, confidence from 0 to 1, and evidence (type, detail); a list without evidence stays empty. Reply with one JSON object."
    )


def _listed(name: str, items: Column, none: str = "none") -> Column:
    return F.concat(F.lit(f"{name}:\n"), F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise(none), F.lit("\n\n"))


def prompts(signals: DataFrame, sources: DataFrame, edges: DataFrame, tests: DataFrame, system: str, max_lines: int | None = None) -> DataFrame:
    """path, file_type, prompt of each file of notes.signals, from its source (sources: path, content) and what is known of it."""
    own = signals.join(sources.select("path", "content"), "path").join(dependency_exports(edges, signals.select("path", "exports")), "path", "left").join(test_excerpts(tests, sources), "path", "left")
    kind = file_type(F.col("path"), F.col("hooks"), F.col("exports"), F.col("api_calls"))
    rows = F.split("content", "\n")
    source = F.col("content") if max_lines is None else F.when(F.size(rows) > max_lines, F.concat(F.array_join(F.slice(rows, 1, max_lines), "\n"), F.lit(f"\n// ... (cut at {max_lines} lines)"))).otherwise(F.col("content"))
    asked = F.create_map(*(x for k, v in ASKED.items() for x in (F.lit(k), F.lit(v))))
    consumers = F.slice("consumers_list", 1, F.when(F.col("file_type") == "type-definition", TYPE_CONSUMERS).otherwise(CONSUMERS))
    imported = F.transform(F.map_entries(F.coalesce("dependency_exports", F.create_map().cast("map<string,array<string>>"))), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", ")))
    facts = F.to_json(F.struct("imports", "exports", "hooks", "env_vars", "api_calls", "comments", "has_side_effects"))
    history = F.to_json(F.struct("churn", "authors", "recent_messages", F.slice("co_changed", 1, CO_CHANGED).alias("co_changed")))
    parts = [
        F.lit(system + "\n\n"), F.lit("File: "), F.col("path"), F.lit("\nType: "), F.col("file_type"), F.lit("\n"), F.element_at(asked, F.col("file_type")), F.lit("\n\n"),
        _listed("Signatures", F.col("signatures")), F.lit("Facts: "), facts, F.lit("\n\n"), _listed("Exports of direct dependencies", imported), _listed("Consumers", consumers),
        F.lit("History: "), history, F.lit("\n\n"), _listed("Documentation in the file", doc_blocks(F.col("content"))),
        F.lit("Tests:\n"), F.coalesce("test_text", F.lit("none")), F.lit("\n\nSource:\n"), source,
    ]
    return own.withColumn("file_type", kind).select("path", "file_type", F.concat(*parts).alias("prompt"))


def usage(calls: DataFrame) -> DataFrame:
    """cost, duration_ms, calls: sums over calls (cost, duration_ms), each without its own nulls; every call counts."""
    return calls.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"), F.count(F.lit(1)).alias("calls"))
