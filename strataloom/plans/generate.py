"""The batch run: scan, parse, graph, signals, score, notes, aggregates, state."""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, rules, scoring
from ..functions.storage import saved
from ..operators import delta, governance, graph, history, incremental, index, notes, parsers, prompts, resolve, search, synthesis
from ..sources import coverage, documents, files, git_log
from ..sources.config import Config, merged_aliases

COMMITS = "file string, commit string, at timestamp, author string, message string, status string"


@dataclass
class Run:
    """The tables of a run; all are lazy plans over saved inputs."""

    files: DataFrame
    documents: DataFrame
    signals: DataFrame
    analyses: DataFrame
    edges: DataFrame
    notes: DataFrame
    index: DataFrame
    nodes: DataFrame
    divergences: DataFrame
    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    forms: DataFrame
    fields: DataFrame
    items: DataFrame
    grams: DataFrame
    counts: DataFrame
    #: Of all files as they are now: what analyses are made of.
    parsed: DataFrame
    #: Of files as they were when their note was made, and of the dependencies they had then.
    hashes: DataFrame
    fingerprints: DataFrame
    #: digest: of the settings that analyses and notes depend on.
    settings: DataFrame
    #: path of the files whose note this run has made.
    fresh: DataFrame
    #: path, model, cost, duration_ms, error: of the calls to a model that this run has made.
    calls: DataFrame
    #: node, component: files on cycles.
    components: DataFrame

    @property
    def text(self) -> search.TextIndex:
        return search.TextIndex(self.postings, self.blocks, self.terms, self.forms, self.fields)

    @property
    def substrings(self) -> search.GramIndex:
        return search.GramIndex(self.items, self.grams, self.counts)


@dataclass(frozen=True)
class Chosen:
    """Whose notes a run makes: all that need one, or with force all; of them those that match a glob, or those that are listed (path)."""

    force: bool = False
    pattern: str | None = None
    paths: DataFrame | None = None


@dataclass(frozen=True)
class Provider:
    """A model: a callable from a prompt to a reply (a text, or a mapping with content, model and usage) and its name.

    premium: another one for files of a high score. The callables run in Python workers, so they are picklable or importable there.
    """

    complete: Callable[[str], str | dict]
    model: str
    premium: Provider | None = None
    context: str | None = None
    max_lines: int | None = None
    timeout: float = 30.0
    delays: tuple[float, ...] = synthesis.DELAYS


CALLS = "path string, model string, cost double, duration_ms long, error string"


def dependency_edges(analyses: DataFrame, all_files: DataFrame, aliases: dict[str, list[str]] | None = None, go_module: str | None = None, modules: DataFrame | None = None) -> DataFrame:
    """src, dst of local imports that mean a file; an import written twice is two edges. A dotted Python module becomes a path.

    modules (dir, module): an import of a Go file's own module means a path below the module's directory.
    """
    own = analyses.select(F.col("path").alias("file"), F.posexplode("local_imports").alias("pos", "specifier"))
    dots = F.length(F.regexp_extract("specifier", r"^(\.+)", 1))
    python = F.concat(F.when(dots <= 1, "./").otherwise(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))), F.translate(F.regexp_replace("specifier", r"^\.+", ""), ".", "/"))
    fixed = own.withColumn("specifier", F.when(F.col("file").endswith(".py") & F.col("specifier").startswith("."), python).otherwise(F.col("specifier")))
    if modules is not None:
        fixed = below_modules(fixed, modules)
    defaults = {"@/": ["src"], "~/": ["src"]}
    return resolve.resolved(fixed, all_files, aliases or {k.rstrip("/"): v for k, v in defaults.items()}, go_module).select(F.col("file").alias("src"), F.col("target").alias("dst"))


def below_modules(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports (file, pos, specifier) with those of a Go file's own module made relative to the file."""
    files = imports.where(F.col("file").endswith(".go")).select(F.col("file").alias("path")).distinct()
    known = parsers.with_go_modules(files, modules).join(modules, "module").select(F.col("path").alias("file"), "module", "dir")
    spec, up = F.col("specifier"), paths.dirname(F.col("file"))
    inside = (spec == F.col("module")) | F.startswith(spec, F.concat("module", F.lit("/")))
    below = F.concat_ws("/", F.when(F.col("dir") != ".", F.col("dir")), F.ltrim(F.expr("substring(specifier, length(module) + 1)"), F.lit("/")))
    steps = F.when(up == ".", F.lit("./")).otherwise(F.repeat(F.lit("../"), F.size(F.split(up, "/"))))
    return imports.join(known, "file", "left").select("file", "pos", F.when(inside, F.concat(steps, below)).otherwise(spec).alias("specifier"))


def settings_digest(config: Config) -> str:
    """Of the settings that analyses and notes depend on; a change of them makes all anew."""
    return hashlib.sha1(repr((config.language, config.api_call_patterns, config.side_effect_packages)).encode()).hexdigest()


def due(own: DataFrame, now: DataFrame, prints: DataFrame, earlier: Run | None, config: Config, chosen: Chosen) -> DataFrame:
    """path of the files whose note is to be made: without an earlier run of the same settings all of own, else those that are
    new or changed, or whose dependencies have changed."""
    if chosen.paths is not None:
        return own.join(chosen.paths, "path", "left_semi").select("path")
    out = own.select("path")
    if earlier is not None and not chosen.force and same_settings(earlier, config):
        out = out.join(hits(now, prints, earlier).where("hit"), "path", "left_anti")
    return out if chosen.pattern is None else out.where(paths.any_glob(F.col("path"), (chosen.pattern,)))


def same_settings(earlier: Run, config: Config) -> bool:
    return [r["digest"] for r in earlier.settings.collect()] == [settings_digest(config)]


def hits(now: DataFrame, prints: DataFrame, earlier: Run) -> DataFrame:
    """path, hit: files that are as they were when their note was made, with dependencies that are so too.

    A file without a stored fingerprint gets its present one as if it had been stored, so it is not stale for lack of one.
    """
    before = incremental.bootstrapped(earlier.fingerprints, prints)
    known = before.select("path").unionByName(prints.select("path")).distinct()
    noted = earlier.notes.select(F.col("file_path").alias("path"))
    return incremental.cache_hits(incremental.status(now, earlier.hashes).join(noted, "path", "left_semi"), incremental.stale_dependencies(prints, before, known))


def run(all_files: DataFrame, commits: DataFrame, covered: DataFrame, config: Config, now: Column, aliases: dict[str, list[str]] | None = None, go_module: str | None = None, earlier: Run | None = None, chosen: Chosen | None = None, provider: Provider | None = None, changes: DataFrame | None = None, searched: bool = True) -> Run:
    """All tables of a repository from its files (path, extension, size, content, hash), history and coverage.

    earlier: files whose hash is the same are not parsed again, and notes that are still right stay as they are, with the
    time they were made at. Analyses and edges are saved once, since every later table reads them; all else is joined by path
    in one plan. provider: who is asked about the files that plan sends to a model, favouring changes (path, edit). searched:
    whether the tables of search are made, which are written at once and larger than the notes.
    """
    own = files.scanned(all_files, config.include, config.exclude)
    options, modules = parsers.Options(config.api_call_patterns, config.side_effect_packages, go_module), parsers.go_modules(all_files)
    kept = earlier is not None and same_settings(earlier, config)
    analysed = saved(reused(own, all_files, options, modules, earlier.analyses, earlier.parsed) if kept else parsers.analyses(own, options, modules), "analyses")
    edges = saved(dependency_edges(analysed, all_files.select("path"), aliases, go_module, modules), "edges")
    return assembled(own, all_files, analysed, edges, commits, covered, config, now, earlier, chosen, provider, changes, searched)


def assembled(own: DataFrame, all_files: DataFrame, analysed: DataFrame, edges: DataFrame, commits: DataFrame, covered: DataFrame, config: Config, now: Column, earlier: Run | None = None, chosen: Chosen | None = None, provider: Provider | None = None, changes: DataFrame | None = None, searched: bool = True) -> Run:
    """The tables of a run from saved analyses and edges; index, search and nodes are of the stored and the fresh notes together."""
    docs = saved(documents.governance_docs(all_files), "docs")
    found = saved(governance.divergences(docs, own.select("path"), edges), "divergences")
    components = saved(graph.strong_components(edges), "components")
    signals = saved(
        notes.signals(
            analysed, edges, resolve.related_tests(own, all_files), covered, history.git_signals(commits), components, found, governance.governed(own.select("path"), governance.file_governance(docs), governance.mappings(docs))
        ), "signals",
    )
    hashes = all_files.select("path", "hash")
    prints = incremental.fingerprints(edges, hashes)
    fresh = saved(due(own, hashes, prints, earlier, config, chosen or Chosen()), "fresh")
    told = signals if earlier is None and chosen in (None, Chosen(), Chosen(force=True)) else signals.join(fresh, "path", "left_semi")
    made = notes.assembled(told, now, config.language)
    noted, held = hashes, prints
    if earlier is not None:
        made = merged_notes(earlier.notes, made, own)
        old = own.select("path").join(fresh, "path", "left_anti")  # what was not made anew is as it was
        noted = hashes.join(old, "path", "left_anti").unionByName(earlier.hashes.join(old, "path", "left_semi"))
        held = prints.join(old, "path", "left_anti").unionByName(incremental.bootstrapped(earlier.fingerprints, prints).join(old, "path", "left_semi"))
    made, calls = saved(made, "notes"), all_files.sparkSession.createDataFrame([], CALLS)
    if provider is not None:
        wanted = gated(indexed(made, own, edges, now, config), changes, config, True).where("uses_llm").join(fresh, "path", "left_semi")
        made, calls = synthesised_notes(made, saved(wanted, "asked"), prompted(signals, own, edges, all_files, config, provider), provider, config.concurrency)
    entries = indexed(made, own, edges, now, config)
    texts = notes.search_documents(made)
    words = search.text_index(texts, "id", texts.columns[1:]) if searched else search.TextIndex(*[None] * 5)
    grams = search.gram_index(note_texts(made)) if searched else search.GramIndex(*[None] * 3)
    settings = all_files.sparkSession.createDataFrame([(settings_digest(config),)], "digest string")
    return Run(
        own, docs, signals, analysed, edges, made, entries, index.graph_nodes(own.select("path"), entries), found, words.postings, words.blocks, words.terms, words.forms, words.fields,
        grams.items, grams.grams, grams.counts, hashes, noted, held, settings, fresh, calls, components,
    )


def indexed(made: DataFrame, own: DataFrame, edges: DataFrame, now: Column, config: Config) -> DataFrame:
    """The index of notes."""
    flat = made.select(F.col("file_path").alias("path"), F.col("criticality_score").alias("score"), "model", F.col("purpose.observed").alias("purpose_observed"), F.col("purpose.inferred").alias("purpose_inferred"), "generated_at")
    return index.entries(flat, graph.reverse(edges, own.select(F.col("path").alias("node"))), now, config.stale_days)


def note_texts(made: DataFrame) -> DataFrame:
    """key, score, field, text: what notes say, for substrings."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.concat(F.col(f)["observed"], F.col(f)["inferred"], F.transform(F.col(f)["evidence"], lambda e: e["detail"])).alias("texts")) for f in rules.NOTE_FIELDS))
    each = made.select(F.col("file_path").alias("key"), F.col("criticality_score").alias("score"), F.explode(fields).alias("f"))
    return each.select("key", "score", "f.field", F.explode("f.texts").alias("text"))


def run_repository(spark: SparkSession, config: Config, now: Column, **more) -> Run:
    """run over a checked-out repository."""
    everything = ("**/*",)
    all_files = saved(files.scan_repository(spark, config.root, everything, ("**/.git/**", "**/node_modules/**", f"{config.output}/**")), "files")
    commits = saved(git_log.history(spark, config.root), "commits")
    more.setdefault("aliases", aliases_of(all_files) or None)
    return run(all_files, commits, coverage.coverage(all_files, config.root), config, now, **more)


def aliases_of(all_files: DataFrame) -> dict[str, list[str]]:
    """The path aliases of a repository's own settings: a few files of the root, read on the driver."""
    found = {r["path"]: r["content"] for r in all_files.where(F.col("path").isin("tsconfig.json", *rules.BUNDLER_FILES)).select("path", "content").collect()}
    return merged_aliases(found.pop("tsconfig.json", None), found)


def reused(own: DataFrame, all_files: DataFrame, options: parsers.Options, modules: DataFrame, analyses: DataFrame, hashes: DataFrame) -> DataFrame:
    """Analyses of own: the stored ones where path and hash are those of the earlier run, all others parsed."""
    same = own.join(hashes.select("path", "hash"), ["path", "hash"], "left_semi").join(analyses.select("path"), "path", "left_semi").select("path")
    kept = analyses.join(same, "path", "left_semi")
    return kept.unionByName(parsers.analyses(own.join(same, "path", "left_anti"), options, modules))


def merged_notes(stored: DataFrame, fresh: DataFrame, present: DataFrame) -> DataFrame:
    """What aggregates are made of after a run over some files: its notes over the stored ones, without those of files that are gone."""
    return incremental.upserted(stored, fresh, "file_path", present.select(F.col("path").alias("file_path")))


def prompted(signals: DataFrame, own: DataFrame, edges: DataFrame, all_files: DataFrame, config: Config, provider: Provider) -> DataFrame:
    """path, file_type, prompt of every file of own."""
    tests = resolve.related_tests(own, all_files)
    return prompts.prompts(signals, own, edges, tests, prompts.system_prompt(config.language, provider.context), provider.max_lines)


def synthesised_notes(made: DataFrame, wanted: DataFrame, asked: DataFrame, provider: Provider, parallel: int) -> tuple[DataFrame, DataFrame]:
    """Notes, those of wanted (path, premium) merged with a model's replies, and the calls made for them (CALLS).

    Replies are saved, so nothing that reads the notes or the calls asks again.
    """
    parts = ["file_path", *rules.NOTE_FIELDS, "model"]
    texts = wanted.join(asked.select("path", "prompt"), "path").withColumnRenamed("path", "file_path")
    own = made.select(*parts).join(texts, "file_path")
    tiers = [(provider, own)] if provider.premium is None else [(provider, own.where("NOT premium")), (provider.premium, own.where("premium"))]
    replies = None
    for tier, rows in tiers:
        found = synthesis.synthesised(rows.select(*parts, "prompt"), tier.complete, tier.model, tier.timeout, parallel, tier.delays).drop("prompt")
        replies = found if replies is None else replies.unionByName(found)
    replies = saved(replies, "replies")
    rest = made.join(wanted.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    merged = made.drop(*parts[1:]).join(replies.drop("call"), "file_path").select(*made.columns)
    calls = replies.select(F.col("file_path").alias("path"), "model", "call.cost", "call.duration_ms", "call.error")
    return saved(rest.unionByName(merged), "notes_with_replies"), calls


def restaled(entries: DataFrame, now: Column, days: int) -> DataFrame:
    """The index with stale as of now: notes grow old while they are stored."""
    return entries.withColumn("stale", index.is_stale(F.col("generated_at"), now, days))


def first_files(made: Run, top: int = 5) -> DataFrame:
    """path, score: the first files by score, for a report."""
    return index.ranked(made.index).limit(top).select("path", "score")


def plan(made: Run, earlier: Run | None, changes: DataFrame, config: Config, provider: bool, force: bool = False) -> DataFrame:
    """path, hit, boosted, uses_llm, premium: what a run would do with each file, given an earlier one."""
    joined = gated(made.index, changes, config, provider)
    if earlier is None or force or not same_settings(earlier, config):
        joined = joined.withColumn("hit", F.lit(False))
    else:
        joined = joined.join(hits(made.parsed, incremental.fingerprints(made.edges, made.parsed), earlier), "path", "left")
    return joined.select("path", F.coalesce("hit", F.lit(False)).alias("hit"), "boosted", "uses_llm", "premium")


def gated(entries: DataFrame, changes: DataFrame | None, config: Config, provider: bool) -> DataFrame:
    """path, boosted, uses_llm, premium: which files of an index a model is asked about, and which of them a better one."""
    changes = entries.sparkSession.createDataFrame([], "path string, edit string") if changes is None else changes
    own = entries.select("path", "score", F.size("dependents").cast("long").alias("consumers")).join(changes, "path", "left").withColumn("category", paths.category(F.col("path")))
    forced = index.quota(own, config.new_source_quota).select("path", F.lit(True).alias("forced"))
    boosted = F.col("score") + scoring.as_score(scoring.boost_points(F.col("category"), F.col("edit")))
    uses = scoring.synthesis_gate(F.lit(provider), paths.is_skipped(F.col("category")), boosted, config.llm_threshold, F.coalesce("forced", F.lit(False)))
    return own.join(forced, "path", "left").select("path", boosted.alias("boosted"), uses.alias("uses_llm"), (F.col("score") >= config.high_threshold).alias("premium"))


#: Tables that a batch of changes alters in part, with the names of what it replaces rows by; all others are written whole: governance
#: documents and what departs from them, the settings, and what the run itself has made.
KEYED = {
    "files": "path", "signals": "path", "analyses": "path", "edges": "src", "notes": "file_path", "index": "path", "nodes": "path", "postings": "key", "blocks": "term, field, range", "terms": "term, field",
    "forms": "term", "fields": "field", "items": "key", "grams": "item", "counts": "gram", "parsed": "path", "hashes": "path", "fingerprints": "path", "components": "node",
}
#: After so many versions that hold changes a full one is written.
MOST_LAYERS = 8

#: What look-ups narrow a table by: its rows lie in ranges of it, so that files and row groups are pruned.
SORTED = {"postings": "term", "blocks": "term", "terms": "term", "forms": "form", "grams": "gram", "counts": "gram", "notes": "file_path", "index": "path", "nodes": "path", "edges": "src", "divergences": "file"}


def versions(spark: SparkSession, out: str):
    """Hadoop's file system of a folder, and its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def current(spark: SparkSession, out: str) -> str | None:
    """The folder of the version that readers are to take: the last one of which all tables were written."""
    system, path = versions(spark, out)
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/v*/_DONE")
    found = [str(f.getPath().getParent().getName()) for f in system.globStatus(pattern) or []] if system.exists(path) else []
    return f"{out}/{max(found)}" if found else None


def stored(spark: SparkSession, out: str) -> Run | None:
    """The current version of a written run, read back: what serving and the next run start from; None where there is none."""
    folder = current(spark, out)
    return folder and read_version(spark, folder)


def read_version(spark: SparkSession, folder: str) -> Run:
    """The tables of a version: of one that holds changes those of the last full one, under all changes since."""
    *above, base = chain(spark, folder)
    found = {}
    for f in dataclasses.fields(Run):
        if f.name not in KEYED or not above:
            found[f.name] = spark.read.parquet(f"{folder}/{f.name}")
            continue
        found[f.name] = spark.read.parquet(f"{base}/{f.name}")
        for layer in reversed(above):
            found[f.name] = delta.applied(found[f.name], delta.Change(spark.read.parquet(f"{layer}/{f.name}_gone"), spark.read.parquet(f"{layer}/{f.name}_rows")))
    return Run(**found)


def chain(spark: SparkSession, folder: str) -> list[str]:
    """A version, the one that its changes are to, and so on to a full one."""
    out = [folder]
    while True:
        system, path = versions(spark, f"{out[-1]}/_OVER_*")
        below = [str(f.getPath().getName()).removeprefix("_OVER_") for f in system.globStatus(path) or []]
        if not below:
            return out
        out.append(f"{folder.rpartition('/')[0]}/{below[0]}")


@dataclass(frozen=True)
class Written:
    """The folder of a version, and the figures of the run: counted while its tables were written, by no query of their own."""

    folder: str
    figures: dict[str, float]


def _figures() -> dict[str, tuple[Column, ...]]:
    """What is counted of a table's rows as they are written."""
    one, level = F.count(F.lit(1)), F.col("severity")
    return {
        "notes": (one.alias("notes"), F.count_if(~F.coalesce("debug_signals.has_tests", F.lit(False))).alias("untested"), F.count_if(F.col("model") != "static").alias("synthesised")),
        "fresh": (one.alias("made"),),
        "analyses": (one.alias("files"), F.count_if(F.col("error").isNotNull()).alias("parse_errors")),
        "edges": (one.alias("edges"),),
        "calls": (one.alias("calls"), F.count_if(F.col("error").isNotNull()).alias("failed_calls"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms")),
        "divergences": tuple(F.count_if(level == s).alias(f"divergences_{s}") for s in ("error", "warn", "info")),
    }


def write(made: Run, out: str, keep: int = 2) -> Written:
    """The tables as Parquet in the folder of a new version, which counts once all of them are written; older ones but for the last keep go.

    Figures are observed on the plans that write the tables. Notes also as JSON lines and a pretty file each, the index also as JSON and Markdown.
    """
    spark = made.notes.sparkSession
    last = current(spark, out)
    folder = _next(out, last)
    counted, seen = _figures(), {}
    for f in dataclasses.fields(Run):
        table = _by_range(getattr(made, f.name), f.name)
        if f.name in counted:
            seen[f.name] = Observation(f.name)
            table = table.observe(seen[f.name], *counted[f.name])
        table.write.mode("overwrite").parquet(f"{folder}/{f.name}")
    made.notes.write.mode("overwrite").json(f"{folder}/notes_json")
    notes.write_files(made.notes.join(made.fresh.select(F.col("path").alias("file_path")), "file_path", "left_semi"), f"{out}/notes")
    notes.remove_files(spark, f"{out}/notes", made.notes.select("file_path"), last and read_version(spark, last).notes.select("file_path"))
    _listings(made.index, folder)
    made.fingerprints.orderBy("path", "dep").write.mode("overwrite").json(f"{folder}/fingerprints_json")
    notes.markdown(made.notes).select("text").write.mode("overwrite").text(f"{folder}/notes_markdown", lineSep="\n\f\n")
    _done(spark, out, folder, keep)
    return Written(folder, {k: v for o in seen.values() for k, v in o.get.items()})


def _next(out: str, last: str | None) -> str:
    return f"{out}/v{int(last.rpartition('/v')[2]) + 1 if last else 1:09d}"


def _by_range(table: DataFrame, name: str) -> DataFrame:
    return table.repartitionByRange(SORTED[name]).sortWithinPartitions(SORTED[name]) if name in SORTED else table


def _listings(entries: DataFrame, folder: str) -> None:
    """The index as JSON and Markdown: a line for each file."""
    index.ranked(entries).write.mode("overwrite").json(f"{folder}/index_json")
    lines = F.when(F.col("path").isNull(), F.concat(F.lit("\n"), "text")).otherwise(F.col("text"))
    index.markdown(entries).select(lines.alias("text")).write.mode("overwrite").text(f"{folder}/index_markdown")  # part after part in order


def _done(spark: SparkSession, out: str, folder: str, keep: int) -> None:
    """Marks a version as one that counts; older ones go, but for the last keep and what these hold changes to."""
    system, _ = versions(spark, out)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system.create(hadoop(f"{folder}/_DONE")).close()
    done = sorted(str(f.getPath().getParent().getName()) for f in system.globStatus(hadoop(f"{out}/v*/_DONE")))
    needed = {f.rpartition("/")[2] for name in done[-keep:] for f in chain(spark, f"{out}/{name}")}
    for name in done:
        if name not in needed:
            system.delete(hadoop(f"{out}/{name}"), True)


def write_changes(spark: SparkSession, changes: dict[str, delta.Change], wholes: dict[str, DataFrame], out: str, keep: int = 2, in_part: bool = True) -> str:
    """A new version that holds what a batch changes in the current one (see KEYED), and the other tables whole.

    Rows written are in proportion to the changes, but for the index's listings. Notes' own files are those of the batch;
    notes and fingerprints as one JSON or Markdown export come with the next full version, after MOST_LAYERS of these or at
    once without in_part. What kept versions hold changes to is kept with them.
    """
    last = current(spark, out)
    folder, before = _next(out, last), read_version(spark, last)
    if not in_part or len(chain(spark, last)) > MOST_LAYERS:
        merged = {name: delta.applied(getattr(before, name), change) for name, change in changes.items()}
        return write(Run(**merged, **wholes), out, keep).folder
    for name, change in changes.items():
        change.gone.write.mode("overwrite").parquet(f"{folder}/{name}_gone")
        _by_range(change.rows, name).write.mode("overwrite").parquet(f"{folder}/{name}_rows")
    for name, table in wholes.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    system, path = versions(spark, f"{folder}/_OVER_{last.rpartition('/')[2]}")
    system.create(path).close()
    notes.write_files(changes["notes"].rows, f"{out}/notes")
    notes.remove_files(spark, f"{out}/notes", changes["notes"].rows.select("file_path"), changes["notes"].gone)
    _listings(read_version(spark, folder).index, folder)
    _done(spark, out, folder, keep)
    return folder


def apply_changes(spark: SparkSession, out: str, changed: DataFrame, all_files: DataFrame, commits: DataFrame, covered: DataFrame, config: Config, now: Column, in_part: bool = False) -> None:
    """A micro-batch of changed files (filename) against the current version, written as the next one: whole, or in part.

    What a change can reach is made anew, and all other rows stay: analyses of the files; edges of these, and where files came
    or went of all whose imports now mean another file; components around the edges that came and went; signals, notes, index
    and search rows of affected files: those and their neighbours, as edges were and as they are, the files of tests that
    changed, and files that are on a cycle anew or no longer. Departures from documents are found anew as a table; in notes of other
    files they, like history, coverage and governance, are taken up by the next run that makes them. Idempotent: the same batch again gives the same tables.
    """
    earlier = stored(spark, out)
    options, modules = parsers.Options(config.api_call_patterns, config.side_effect_packages), parsers.go_modules(all_files)
    own = saved(files.scanned(all_files, config.include, config.exclude), "files")
    hashes = all_files.select("path", "hash")
    went = earlier.parsed.select("path").union(earlier.files.select("path")).distinct().join(own.select("path"), "path", "left_anti").join(hashes, "path", "left_anti")
    came = own.select("path").join(earlier.files.select("path"), "path", "left_anti")
    left = earlier.files.select("path").join(own.select("path"), "path", "left_anti")
    moved = saved(changed.select(F.col("filename").alias("path")).union(went).union(came).union(left).distinct(), "moved")
    analyses = delta.Change(moved, saved(parsers.analyses(own.join(moved, "path", "left_semi"), options, modules), "analyses_of_changed"))

    aliases, known = aliases_of(all_files) or None, all_files.select("path")
    settled = moved.where(F.col("path").isin("tsconfig.json", *rules.BUNDLER_FILES) | F.col("path").rlike(r"(^|/)go\.mod$"))
    others = came.union(left).union(hashes.select("path").join(earlier.parsed, "path", "left_anti")).union(went).union(settled).limit(1).count()
    if others:  # an import may mean another file than before
        resolved = saved(dependency_edges(delta.applied(earlier.analyses, analyses), known, aliases, modules=modules), "resolved")
        sign = earlier.edges.select("src", "dst", F.lit(-1).alias("n")).unionByName(resolved.select("src", "dst", F.lit(1).alias("n")))
        turned = sign.groupBy("src", "dst").agg(F.sum("n").alias("n")).where("n != 0").select("src")
        sources = saved(turned.union(moved.select("path")).distinct(), "sources")
        fresh_edges = saved(resolved.join(sources, "src", "left_semi"), "fresh_edges")
    else:
        sources = moved.select(F.col("path").alias("src"))
        fresh_edges = saved(dependency_edges(analyses.rows, known, aliases, modules=modules), "fresh_edges")
    edges = delta.Change(sources, fresh_edges)
    linked = saved(delta.applied(earlier.edges, edges), "edges")
    old_edges = saved(earlier.edges.join(sources, "src", "left_semi"), "old_edges")
    cycles = delta.components(earlier.components, old_edges.select("src", "dst").exceptAll(fresh_edges.select("src", "dst")), fresh_edges.select("src", "dst").exceptAll(old_edges.select("src", "dst")), linked)

    docs = saved(documents.governance_docs(all_files), "docs")
    found = saved(governance.divergences(docs, own.select("path"), linked), "divergences")
    told = earlier.components.join(cycles.gone, "node", "left_semi").select("node", F.lit(1).alias("n")).unionByName(cycles.rows.select("node", F.lit(-1).alias("n")))
    looped = told.groupBy("node").agg(F.sum("n").alias("n")).where("n != 0").select("node")
    tests = resolve.related_tests(own, all_files)
    tested = tests.join(moved.withColumnRenamed("path", "test"), "test", "left_semi").select("path").union(
        earlier.signals.select("path", F.explode("related_tests").alias("test")).join(moved.withColumnRenamed("path", "test"), "test", "left_semi").select("path")
    )
    up = linked.union(earlier.edges).join(moved.withColumnRenamed("path", "dst"), "dst", "left_semi").select("src")
    near = moved.union(sources).union(old_edges.select("dst")).union(fresh_edges.select("dst")).union(up).union(looped).union(tested)
    gone = saved(near.distinct(), "affected")

    part = own.join(gone, "path", "left_semi")
    about = linked.join(gone.select(F.col("path").alias("src"), F.lit(True).alias("a")), "src", "left").join(gone.select(F.col("path").alias("dst"), F.lit(True).alias("b")), "dst", "left").where("a OR b").select("src", "dst")
    about = saved(about, "edges_of_affected")
    analysed = delta.applied(earlier.analyses, analyses).join(gone, "path", "left_semi")
    governed = governance.governed(part.select("path"), governance.file_governance(docs), governance.mappings(docs))
    loops = delta.applied(earlier.components, cycles)
    signals = saved(notes.signals(analysed, about, tests.join(gone, "path", "left_semi"), covered, history.git_signals(commits), loops, found, governed), "signals")
    made = saved(notes.assembled(signals, now, config.language), "notes")
    entries = saved(indexed(made, part, about, now, config), "index")
    texts, keys = notes.search_documents(made), gone.select(F.col("path").alias("key"))
    over = lambda rows, key="path": delta.Change(gone.withColumnRenamed("path", key), rows)
    some = hashes.join(gone.union(moved).distinct(), "path", "left_semi")
    changes = {
        "files": over(part), "signals": over(signals), "analyses": analyses, "edges": edges, "notes": over(made, "file_path"), "index": over(entries), "nodes": over(index.graph_nodes(part.select("path"), entries)),
        "parsed": delta.Change(moved, hashes.join(moved, "path", "left_semi")), "hashes": over(some), "fingerprints": over(incremental.fingerprints(about, hashes).join(gone, "path", "left_semi")), "components": cycles,
        **delta.text_changes(earlier.text, keys, texts, "id", texts.columns[1:]), **delta.gram_changes(earlier.substrings, keys, note_texts(made)),
    }
    settings = spark.createDataFrame([(settings_digest(config),)], "digest string")
    write_changes(spark, changes, {"documents": docs, "divergences": found, "settings": settings, "fresh": part.select("path"), "calls": spark.createDataFrame([], CALLS)}, out, in_part=in_part)
