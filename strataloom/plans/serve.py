"""Serving queries by name over the tables of a run: each is a plan; parameters are checked before anything runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scoring import is_hotspot
from ..operators import business_rules, governance, graph, index, resolve, search
from ..sources import documents
from ..sources.config import inside
from .generate import Run, note_texts

TOOLS: dict[str, Callable[..., DataFrame]] = {}
#: The order of the rows of a query that ranks, as columns and whether they ascend; what follows in it is any order that is total.
ORDER: dict[str, list[tuple[str, bool]]] = {
    **{name: [("score", False), ("path", True)] for name in ("search_by_criticality", "get_index", "get_architecture_context", "get_domain")},
    "get_impact": [("level", True), ("score", False), ("path", True)],
    "full_text_search": [("score", False), ("key", True)],
    "substring_search": [("score", False), ("key", True)],
    "get_graph": [("path", True)],
    "get_links": [("src", True), ("dst", True)],
    "get_cycles": [("component", True), ("node", True)],
}


def tool(f):
    TOOLS[f.__name__] = f
    return f


@tool
def get_file_note(made: Run, file_path: str) -> DataFrame:
    return made.notes.where(F.col("file_path") == inside(".", file_path))


@tool
def search_by_criticality(made: Run, threshold: float = 0.5, limit: int = 20) -> DataFrame:
    return index.at_least(made.index, threshold, limit)


@tool
def get_index(made: Run) -> DataFrame:
    return index.ranked(made.index)


@tool
def get_architecture_context(made: Run, top_n: int = 10) -> DataFrame:
    """The first entries with their notes' purposes and pitfalls, and their domain's size and average."""
    top = index.ranked(made.index).limit(top_n)
    said = made.notes.select(F.col("file_path").alias("path"), F.col("purpose.observed").alias("purposes"), F.col("known_pitfalls.observed").alias("pitfalls"))
    own = index.domains(made.index).select("domain", "files", F.round(F.col("score_sum") / F.col("files"), 2).alias("average"))
    return top.join(said, "path", "left").join(own, "domain", "left").orderBy(F.desc("score"), "path")


@tool
def get_architecture_totals(made: Run) -> DataFrame:
    """Files, stale notes and average score; an empty index has no average."""
    return index.totals(made.index)


@tool
def get_governance_context(made: Run) -> DataFrame:
    """detected, style, documents (path, category, title, sections), mappings and the summary for prompts, in one row."""
    docs = made.documents
    own = docs.select("path", "category").join(governance.titles(docs), "path").join(governance.sections(docs).groupBy("path").agg(F.count(F.lit(1)).alias("sections")), "path", "left").fillna(0, ["sections"])
    listed = own.agg(F.array_sort(F.collect_list(F.struct("path", "category", "title", "sections"))).alias("documents"))
    mapped = governance.mappings(docs).agg(F.array_sort(F.collect_list(F.struct("pattern", "doc"))).alias("mappings"))
    one = governance.style(docs).select((F.col("documents") > 0).alias("detected"), "style")
    return one.crossJoin(listed).crossJoin(mapped).crossJoin(governance.summary(docs).withColumnRenamed("text", "summary"))  # each is one row


@tool
def get_impact(made: Run, file_path: str, depth: int = 2, include_notes: bool = False) -> DataFrame:
    """Files that a change reaches, by level and score; none for an unknown file."""
    start = made.files.sparkSession.createDataFrame([(inside(".", file_path),)], "start string")
    hit = graph.impact(made.edges, start, depth).where("node != start").select(F.col("node").alias("path"), "level")
    out = hit.join(made.index.select("path", "score", "domain", "purpose"), "path", "left").fillna({"score": 0, "domain": "", "purpose": ""})
    if include_notes:
        out = out.join(made.notes.withColumnRenamed("file_path", "path"), "path", "left")
    return out.orderBy("level", F.desc("score"), "path")


@tool
def full_text_search(made: Run, query: str, limit: int = 20) -> DataFrame:
    """key, score, criticality, domain, fields; an empty query is an error. Without postings the notes are scanned for the query as it stands."""
    if not query.strip():
        raise ValueError("the query is empty")
    if made.postings is None:
        found = substring_search(made, query, limit).select("key", F.col("score").cast("double").alias("score"), F.array_distinct(F.transform("matches", lambda m: m["field"])).alias("fields"))
        meta = made.index.select(F.col("path").alias("key"), F.col("score").alias("criticality"), "domain")
        return found.join(meta, "key", "left").fillna({"criticality": 0, "domain": ""}).select("key", "score", "fields", "criticality", "domain").orderBy(F.desc("score"), "key")
    hits = search.search(made.text, query, limit)
    meta = made.index.select(F.col("path").alias("key"), F.col("score").alias("criticality"), "domain")
    return hits.join(meta, "key", "left").fillna({"criticality": 0, "domain": ""}).orderBy(F.desc("score"), "key")


@tool
def substring_search(made: Run, query: str, limit: int = 20) -> DataFrame:
    """What the search falls back to without an index: by trigrams where there are any."""
    if made.grams is None:
        return search.substring_scan(note_texts(made.notes), query, limit)
    return search.substring_search(made.substrings, query, limit)


@tool
def get_domain(made: Run, domain: str) -> DataFrame:
    """A domain's entries by score; an unknown one is an error that names those there are."""
    out = index.of_domain(made.index, domain)
    if not out.limit(1).count():
        known = [r[0] for r in made.index.select("domain").distinct().orderBy("domain").limit(200).collect()]
        raise ValueError(f"no domain {domain!r}; there are {', '.join(known)}")
    return out


@tool
def get_domain_summary(made: Run, domain: str) -> DataFrame:
    """domain, files, average of one domain."""
    return index.domain_summary(made.index, domain)


@tool
def get_business_rules(made: Run, path: str) -> DataFrame:
    return business_rules.business_rules(made.files.where(F.col("path") == inside(".", path)))


@tool
def get_divergences(made: Run, severity: str | None = None, type: str | None = None) -> DataFrame:
    out = made.divergences
    for name, value in (("severity", severity), ("type", type)):
        out = out if value is None else out.where(F.col(name) == value)
    return out


@tool
def get_stats(made: Run) -> DataFrame:
    return index.repo_stats(made.notes.select("debug_signals.has_tests", "debug_signals.coverage_pct"))


@tool
def get_graph(made: Run) -> DataFrame:
    """The nodes of the graph: path, domain, score."""
    return made.nodes


@tool
def get_links(made: Run) -> DataFrame:
    """The links of the graph: src, dst of the edges, or without them of the index's dependents."""
    return documents.edges_or_dependents(made.edges, made.index)


@tool
def get_visible_graph(made: Run, least: float = 0.0, hidden: tuple[str, ...] = (), focus: str | None = None, depth: int = 1) -> DataFrame:
    """src, dst of the links between visible files: those from a score on, or the focus file's neighbours whatever theirs; hidden domains go, but never the focus."""
    return graph.visible(made.nodes.withColumnRenamed("path", "node"), made.edges, least, hidden, focus and inside(".", focus), depth)


@tool
def get_hover(made: Run, file_path: str, specifier: str) -> DataFrame:
    """path, score, purpose, stale of the note that an import of a file means: the first of four candidates that has one."""
    return resolve.hover(made.index, inside(".", file_path), specifier)


@tool
def get_cycles(made: Run) -> DataFrame:
    """node, component of the files on cycles, and for each component one shortest cycle, by name."""
    own = made.components
    return own.join(graph.cycle_witnesses(made.edges, own).withColumn("cycle", F.array_join("cycle", " -> ")), "component").select("node", "component", "cycle")


@tool
def get_file_analysis(made: Run, path: str) -> DataFrame:
    """Degrees, reach, cycle membership of one file, and whether it is a hotspot: what it reaches is looked for from it alone."""
    start = made.files.where(F.col("path") == inside(".", path)).select(F.col("path").alias("start"))
    count = lambda found, name: found.where("node != start").groupBy(F.col("start").alias("node")).agg(F.count(F.lit(1)).alias(name))
    ahead, back = graph.reach(start, made.edges), graph.reach(start, graph.flipped(made.edges))
    degrees = graph.degrees(made.edges, made.files.select(F.col("path").alias("node"))).join(start.select(F.col("start").alias("node")), "node", "left_semi")
    loop = ahead.where("node = start").unionByName(ahead.join(back.select("start", "node"), ["start", "node"], "left_semi")).select(F.col("start").alias("node")).distinct()
    cyclic = loop.unionByName(made.edges.where("src = dst").select(F.col("src").alias("node"))).distinct().withColumn("in_cycle", F.lit(True))
    own = degrees.join(count(ahead, "transitive_dependencies"), "node", "left").join(count(back, "transitive_dependents"), "node", "left").join(cyclic, "node", "left")
    return _with_hotspot(made, own)


@tool
def get_all_analyses(made: Run) -> DataFrame:
    """get_file_analysis of all files at once, from the closure of all pairs: for small graphs."""
    own = graph.degrees(made.edges, made.files.select(F.col("path").alias("node"))).join(graph.closure_counts(made.edges), "node", "left").join(made.components.select("node", F.lit(True).alias("in_cycle")), "node", "left")
    return _with_hotspot(made, own)


def _with_hotspot(made: Run, own: DataFrame) -> DataFrame:
    tested = made.notes.select(F.col("file_path").alias("node"), F.col("criticality_score").alias("score"), F.col("debug_signals.has_tests").alias("tested"))
    out = own.join(tested, "node", "left").fillna(0, ["transitive_dependencies", "transitive_dependents"]).fillna(False, ["in_cycle", "tested"])
    return out.withColumn("hotspot", is_hotspot(F.col("score"), F.col("transitive_dependents"), F.col("tested")))


def call(made: Run, name: str, **parameters) -> DataFrame:
    if name not in TOOLS:
        raise ValueError(f"no query {name!r}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[name](made, **parameters)
