"""Documents that govern a repository, and where the code departs from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, rules
from ..functions.text import lines


def style(docs: DataFrame) -> DataFrame:
    """style, documents: the first style with three of the four indicator documents, the second with any document, else the third."""
    known = F.count_if(F.col("path").isin(*rules.STYLE_DOCUMENTS))
    n, (full, any_doc, none) = F.count(F.lit(1)), rules.STYLES
    return docs.agg(F.when(known >= rules.STYLE_INDICATORS, full).when(n > 0, any_doc).otherwise(none).alias("style"), n.alias("documents"))


def sections(docs: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """key, pos, heading, body: Markdown sections of levels 1 to 3; a heading followed at once by another has none, of equal headings the last body counts, at the first one's place."""
    own = lines(docs, key, text)
    title = F.regexp_extract("line", r"^#{1,3}\s+(.+)", 1)
    marked = own.withColumn("title", F.when(title != "", F.trim(title)))
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("section", F.count("title").over(order)).where("section > 0")
    whole = numbered.groupBy(key, "section").agg(
        F.max("title").alias("heading"), F.min("pos").alias("pos"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("title").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n"), ).alias("body"),
        F.count_if(F.col("title").isNull()).alias("n"),
    ).where("n > 0")
    return whole.groupBy(key, "heading").agg(F.min("pos").alias("pos"), F.max_by("body", "section").alias("body")).select(key, "pos", "heading", "body")


def titles(docs: DataFrame) -> DataFrame:
    """path, title: the first heading of level 1, else the name without its suffix."""
    own = F.regexp_extract("content", r"(?m)^#\s+(.+)", 1)
    stem = F.regexp_replace(paths.basename(F.col("path")), r"(?<=.)\.[^.]*$", "")
    return docs.select("path", F.when(own != "", F.trim(own)).otherwise(stem).alias("title"))


def mentioned(docs: DataFrame) -> DataFrame:
    """doc, path: the source paths that a document mentions, in backticks or plainly, each once."""
    both = F.array_union(F.regexp_extract_all("content", F.lit(rules.QUOTED_PATH), F.lit(1)), F.regexp_extract_all("content", F.lit(rules.PLAIN_PATH), F.lit(1)))
    return docs.select(F.col("path").alias("doc"), F.explode(both).alias("path"))


def mappings(docs: DataFrame) -> DataFrame:
    """doc, pattern: directories that sections of architecture and structure documents speak of; repeats kept."""
    own = docs.where(F.col("category").isin("architecture", "structure"))
    return sections(own).select(F.col("path").alias("doc"), F.explode(F.regexp_extract_all("body", F.lit(rules.MAPPED_PATH), F.lit(1))).alias("pattern"))


def _bullets(docs: DataFrame, headings: tuple[str, ...], keep: int = 20) -> DataFrame:
    own = sections(docs).where(F.lower("heading").rlike("|".join(headings)))
    line = own.select("path", F.col("pos").alias("section"), F.posexplode(F.split("body", "\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    return line.where(F.col("line").rlike(r"^[-*] ")).withColumn("item", F.trim(F.substring("line", 3, 1 << 30))), Window.partitionBy("path").orderBy("section", "at"), keep


def constraints(docs: DataFrame) -> DataFrame:
    """path, rank, item: bullets of 11 to 299 characters below headings on rules, in contract, architecture and quality documents; 20 each."""
    found, order, keep = _bullets(docs.where(F.col("category").isin("contract", "architecture", "quality")), rules.CONSTRAINT_HEADINGS)
    own = found.where(F.length("item").between(11, 299)).withColumn("rank", F.row_number().over(order))
    return own.where(F.col("rank") <= keep).select("path", "rank", "item")


def decisions(docs: DataFrame) -> DataFrame:
    """As constraints, below headings on decisions, in architecture and other documents; the marker counts in the length."""
    found, order, keep = _bullets(docs.where(F.col("category").isin("architecture", "other")), rules.DECISION_HEADINGS)
    own = found.where(F.length("line").between(11, 299)).withColumn("rank", F.row_number().over(order))
    return own.where(F.col("rank") <= keep).select("path", "rank", "item")


def file_governance(docs: DataFrame) -> DataFrame:
    """path, governing_docs, constraints, decisions of every path that a document mentions."""
    said = mentioned(docs)
    own = said.groupBy("path").agg(F.sort_array(F.collect_set("doc")).alias("governing_docs"))
    below = said.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    mapped = mappings(docs).select("doc", _clean(F.col("pattern")).alias("above")).distinct()
    rules_of = below.join(mapped, "above").select("path", "doc").distinct().join(constraints(docs).select(F.col("path").alias("doc"), "rank", "item"), "doc")
    why = said.join(decisions(docs).select(F.col("path").alias("doc"), "rank", "item"), "doc")

    def listed(df, name):
        return df.groupBy("path").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("doc", "rank", "item"))), lambda x: x["item"])).alias(name))

    empty = F.array().cast("array<string>")
    out = own.join(listed(rules_of, "constraints"), "path", "left").join(listed(why, "decisions"), "path", "left")
    return out.select("path", "governing_docs", F.coalesce("constraints", empty).alias("constraints"), F.coalesce("decisions", empty).alias("decisions"))


def governed(files: DataFrame, known: DataFrame, mapped: DataFrame) -> DataFrame:
    """path, governing_docs, constraints, decisions of each of files that a document speaks of.

    A file takes what is known of its own path; else of the first known path (by name) that is a directory above it or that it
    is a directory of; else the documents whose mapped directory holds it. All three are equi-joins on ancestors.
    """
    columns = ["path", "governing_docs", "constraints", "decisions"]
    exact = files.select("path").join(known, "path").select(columns)
    rest = files.select("path").join(exact, "path", "left_anti")
    held = rest.select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    over = held.join(known.select(F.col("path").alias("above"), "governing_docs", "constraints", "decisions"), "above")
    inside = known.select(F.col("path").alias("key"), "governing_docs", "constraints", "decisions", F.explode(ancestors(F.col("path"))).alias("path")).where("key != path")
    under = rest.join(inside, "path").select("path", F.col("key").alias("above"), "governing_docs", "constraints", "decisions")
    first = F.min(F.struct("above", "governing_docs", "constraints", "decisions")).alias("first")
    contained = over.unionByName(under).groupBy("path").agg(first).select("path", "first.governing_docs", "first.constraints", "first.decisions")
    empty = F.array().cast("array<string>")
    prefix = held.join(contained.select("path"), "path", "left_anti").join(mapped.select(_clean(F.col("pattern")).alias("above"), "doc"), "above")
    named = prefix.groupBy("path").agg(F.array(F.min("doc")).alias("governing_docs")).select("path", "governing_docs", empty.alias("constraints"), empty.alias("decisions"))
    return exact.unionByName(contained).unionByName(named)


def ancestors(path):
    """The path and all directories above it: what turns a prefix test into an equi-join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def missing_files(said: DataFrame, files: DataFrame) -> DataFrame:
    """Mentioned paths with a suffix that no file has."""
    own = said.groupBy("path").agg(F.min("doc").alias("doc")).where(F.col("path").rlike(r"\.[a-zA-Z0-9]{1,5}$"))
    gone = own.join(files.select("path"), "path", "left_anti")
    return gone.select(
        F.lit("missing_file").alias("type"), F.lit("warn").alias("severity"), F.format_string(rules.MISSING_FILE_SAID, "path").alias("message"),
        F.lit(None).cast("string").alias("file"), "doc", F.col("path").alias("evidence"),
    )


def _clean(pattern):
    return F.trim(F.regexp_replace(pattern, "^/+|/+$", ""))


def undeclared_domains(files: DataFrame, mapped: DataFrame) -> DataFrame:
    """Files below a source root that no declared directory holds; nothing where none is declared.

    A file meets the patterns by its ancestors, an equi-join, instead of a test of each pattern.
    """
    declared = mapped.select(_clean(F.col("pattern")).alias("above")).distinct()
    named = mapped.agg(F.min("doc").alias("doc"), F.array_sort(F.collect_set(_clean(F.col("pattern")))).alias("all")).where(F.size("all") > 0)
    own = files.where(F.substring_index("path", "/", 1).isin(*rules.SOURCE_ROOTS)).select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    covered = own.join(declared, "above").select("path").distinct()
    out = own.select("path").distinct().join(covered, "path", "left_anti").crossJoin(F.broadcast(named))  # named is one row
    shown = F.concat(F.lit("Declared: "), F.array_join(F.slice("all", 1, 5), ", "), F.when(F.size("all") > 5, ", …").otherwise(""))
    return out.select(
        F.lit("undeclared_domain").alias("type"), F.lit("info").alias("severity"), F.lit(rules.UNDECLARED_DOMAIN_SAID).alias("message"),
        F.col("path").alias("file"), "doc", shown.alias("evidence"),
    )


def forbidden_rules(docs: DataFrame, negated_only: bool = False) -> DataFrame:
    """doc, from, to, raw: sentences on what a directory must, should or cannot depend on. negated_only: a rule must say not (or cannot)."""
    place = rules.FORBIDDEN_PLACE
    verb = r"(?:cannot|can not|(?:must|should|may) not)\s+(?:depend on|import from|access|use|reach into)" if negated_only else rules.FORBIDDEN_VERB
    pattern = rf"(?i)`?{place}`?\s+{verb}\s+`?{place}`?"
    own = docs.select("path", *(F.regexp_extract_all("content", F.lit(pattern), F.lit(k)).alias(n) for n, k in (("raw", 0), ("from", 1), ("to", 2))))
    each = own.select(F.col("path").alias("doc"), F.explode(F.arrays_zip("raw", "from", "to")).alias("r"))
    return each.select("doc", _clean(F.col("r.from")).alias("from"), _clean(F.col("r.to")).alias("to"), F.trim("r.raw").alias("raw")).where(F.col("from") != F.col("to"))


def forbidden_edges(edges: DataFrame, forbidden: DataFrame) -> DataFrame:
    """One row for each edge and rule it breaks, repeats kept. Edges meet rules by the ancestors of their source, an equi-join."""
    numbered = edges.select("src", "dst", F.explode(ancestors(F.col("src"))).alias("from"))
    broken = numbered.join(forbidden, "from").where((F.col("dst") == F.col("to")) | F.startswith("dst", F.concat("to", F.lit("/"))))
    message = F.format_string(rules.FORBIDDEN_SAID, "src", "dst", "from", "to")
    return broken.select(F.lit("forbidden_dependency").alias("type"), F.lit("error").alias("severity"), message.alias("message"), F.col("src").alias("file"), "doc", F.col("raw").alias("evidence"))


def undocumented_hotspots(edges: DataFrame, files: DataFrame, said: DataFrame, mapped: DataFrame, least: int = rules.HOTSPOT_CONSUMERS) -> DataFrame:
    """Files with many consumers that no document mentions or maps."""
    busy = edges.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).join(files.select("path"), "path", "left_semi")
    plain = busy.join(said.select("path"), "path", "left_anti")
    declared = mapped.select(_clean(F.col("pattern")).alias("above")).distinct()
    covered = plain.select("path", F.explode(ancestors(F.col("path"))).alias("above")).join(declared, "above").select("path")
    out = plain.join(covered, "path", "left_anti")
    n = F.col("n").cast("string")
    return out.select(
        F.lit("undocumented_hotspot").alias("type"), F.lit("warn").alias("severity"), F.format_string(rules.UNDOCUMENTED_HOTSPOT_SAID, n).alias("message"),
        F.col("path").alias("file"), F.lit(None).cast("string").alias("doc"), F.concat(n, F.lit(" reverse dependencies")).alias("evidence"),
    )


def divergences(docs: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """type, severity, message, file, doc, evidence of all four detectors."""
    said, mapped = mentioned(docs), mappings(docs)
    any_doc = docs.limit(1).select(F.lit(1).alias("one"))
    hot = undocumented_hotspots(edges, files, said, mapped).crossJoin(F.broadcast(any_doc)).drop("one")
    return missing_files(said, files).unionByName(undeclared_domains(files, mapped)).unionByName(forbidden_edges(edges, forbidden_rules(docs))).unionByName(hot)


def summary_rows(docs: DataFrame, mapped: int = 20) -> DataFrame:
    """pos, text: the lines that a prompt is told of the documents: by category, 200 characters of each first section, the first mappings."""
    first = sections(docs).groupBy("path").agg(F.min_by("body", "pos").alias("body"))
    own = docs.select("path", "category").join(titles(docs), "path").join(first, "path", "left")
    excerpt = F.trim(F.translate(F.left(F.coalesce("body", F.lit("")), F.lit(200)), "\n", " "))
    more = F.when(excerpt != "", F.concat(F.lit("\n  "), excerpt, F.when(F.length("body") > 200, "...").otherwise(""))).otherwise("")
    line = F.concat(F.lit("- **"), "title", F.lit("** (`"), "path", F.lit("`)"), more)
    each = own.groupBy("category").agg(F.min("path").alias("first"), F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("rows"))
    text = F.concat(F.lit("### "), "category", F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    kinds = each.select(F.lit(1).alias("part"), F.col("first").alias("pos"), text.alias("text"))
    head = style(docs).select(F.lit(0).alias("part"), F.lit("").alias("pos"), F.concat(F.lit("## Project governance ("), "style", F.lit(")\n"), F.col("documents").cast("string"), F.lit(" governance documents detected.\n")).alias("text"))
    said = mappings(docs).orderBy("doc", "pattern").limit(mapped).select(F.concat(F.lit("- `"), "pattern", F.lit("` → governed by `"), "doc", F.lit("`")).alias("line"))
    listed = said.agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"), F.count(F.lit(1)).alias("n")).where("n > 0")
    return head.unionByName(kinds).unionByName(listed.select(F.lit(2).alias("part"), F.lit("").alias("pos"), F.concat(F.lit("### Domain mappings\n"), "lines").alias("text")))


def summary(docs: DataFrame, chars: int = 4_000) -> DataFrame:
    """text: the summary of the documents for a prompt, one row, cut."""
    whole = summary_rows(docs).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "text"))), lambda r: r["text"]), "\n").alias("text"))
    return whole.select(F.left("text", F.lit(chars)).alias("text"))


def summary_text(docs: DataFrame, chars: int = 4_000) -> str:
    return summary(docs, chars).first()["text"]


def severity_counts(found: DataFrame) -> DataFrame:
    """severity, n of divergences: what a run reports of them."""
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
