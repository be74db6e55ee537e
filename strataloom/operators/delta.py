"""Tables kept right under changed rows: only what a change can reach is made anew.

A change of a table is what goes (keys) and what comes in its place (rows); `applied` reads a table under it. Components,
postings and trigrams are changed through what they are made of, so a change costs what it touches, not the size of the table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import joined, merged, saved
from . import graph, search

#: Rounds of a search along edges; where they do not do, all components are made anew.
ROUNDS = 40


@dataclass(frozen=True)
class Change:
    """gone: distinct keys, under the names of the table's key columns; rows: what takes their place."""

    gone: DataFrame
    rows: DataFrame


def applied(table: DataFrame, change: Change) -> DataFrame:
    """The table under a change. Keys are never null."""
    return table.join(change.gone, change.gone.columns, "left_anti").select(*table.columns).unionByName(change.rows.select(*table.columns))


def reached(starts: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """node: what any of the starts (node) reaches along edges (src, dst), the starts included; None where the rounds do not do.

    A row for each node, whatever start it is reached from; every round is saved.
    """
    frontier = saved(starts.select("node").distinct(), "frontier")
    seen = frontier
    for _ in range(rounds):
        if not frontier.limit(1).count():
            return seen
        step = edges.join(joined(frontier.select(F.col("node").alias("src"))), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = saved(step.join(joined(seen), "node", "left_anti"), "frontier")
        seen = saved(seen.unionByName(frontier), "seen")
    return None


def components(before: DataFrame, removed: DataFrame, added: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> Change:
    """How strongly connected components (node, component) change when edges are removed and added; edges: as they are afterwards.

    A component that is new or has grown holds an added edge, so all of it is reached from the end of one and reaches the
    start of one. One that has shrunk without that has lost an edge inside it. What neither holds for is as it was; the rest
    consists of whole components, before and after, and only the edges inside it are looked at.
    """
    a, b = (before.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("src", "component"), ("dst", "other")))
    broken = saved(removed.select("src", "dst").distinct().join(merged(a), "src").join(merged(b), "dst").where("component = other").select("component").distinct(), "broken")
    lost = before.join(joined(broken), "component", "left_semi").select("node")
    ahead = reached(added.select(F.col("dst").alias("node")), edges, rounds)
    region = None
    if ahead is not None:
        ahead = joined(ahead)
        ahead_edges = saved(graph.induced(edges, ahead).distinct(), "ahead")
        sources = added.select(F.col("src").alias("node")).join(ahead, "node", "left_semi")
        region = reached(sources, graph.flipped(ahead_edges), rounds)
    if region is None:
        nodes = before.select("node").union(graph.nodes(edges)).distinct()
        return Change(joined(saved(nodes, "region")), saved(graph.strong_components(edges), "components"))
    region = joined(saved(region.union(lost).distinct(), "region"))
    return Change(region, saved(graph.strong_components(graph.induced(edges, region)), "components"))


def text_changes(index: search.TextIndex, keys: DataFrame, docs: DataFrame, key: str, fields: list[str]) -> dict[str, Change]:
    """How the tables of a text index change when the documents of keys (key) go and docs come.

    New documents are dealt into the ranges that there are. Document counts of terms and fields change by those of the
    documents that go and come; a block that has lost or got a posting is made anew from its postings.
    """
    deals = index.blocks.select(F.shiftright("range", 40).cast("int").alias("spread"), F.col("range").bitwiseAND(F.lit((1 << 40) - 1)).alias("part"))
    known = {r["spread"]: r["parts"] for r in deals.groupBy("spread").agg((F.max("part") + 1).alias("parts")).collect()}  # a row for each class of length
    gone = saved(index.postings.join(keys, "key", "left_semi"), "gone_postings")
    fresh = search.text_index(docs, key, fields, parts=known)
    postings = Change(keys, fresh.postings)

    touched = saved(gone.select("term", "field", "range").union(fresh.postings.select("term", "field", "range")).distinct(), "touched_blocks")
    own = applied(index.postings.join(touched, ["term", "field", "range"], "left_semi"), postings)
    blocks = Change(touched, saved(search.blocks_of(own), "blocks"))

    signed = gone.select("term", "field", F.lit(-1).alias("n")).unionByName(fresh.postings.select("term", "field", F.lit(1).alias("n")))
    moved = saved(signed.groupBy("term", "field").agg(F.sum("n").alias("n")), "touched_terms")
    counted = moved.join(index.terms, ["term", "field"], "left").select("term", "field", (F.coalesce("df", F.lit(0)) + F.col("n")).cast("long").alias("df"))
    terms = Change(moved.select("term", "field"), saved(counted.where("df > 0"), "terms"))

    about = saved(moved.select("term").where(F.length("term") <= search.FORM_LETTERS).distinct(), "about")
    left = applied(index.terms.join(about, "term", "left_semi"), replace(terms, rows=terms.rows.join(about, "term", "left_semi"))).select("term").distinct()
    forms = Change(about, left.select(F.explode(search.forms_of(F.col("term"))).alias("form"), "term"))

    sizes = gone.select("key", "field", "length").distinct().withColumn("n", F.lit(-1)).unionByName(fresh.postings.select("key", "field", "length").distinct().withColumn("n", F.lit(1)))
    moved_sizes = sizes.groupBy("field").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.col("length")).alias("longer"))
    n, words = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0)), F.coalesce(F.round(F.col("n") * F.col("mean")), F.lit(0.0)) + F.coalesce("longer", F.lit(0))
    now = index.fields.join(moved_sizes, "field", "full").select("field", n.cast("long").alias("n"), words.alias("words")).where("n > 0")
    means = saved(now.select("field", "n", (F.col("words") / F.col("n")).alias("mean")), "fields")
    every = index.fields.select("field").union(means.select("field")).distinct()  # a row for each field
    return {"postings": postings, "blocks": blocks, "terms": terms, "forms": forms, "fields": Change(every, means)}


def gram_changes(index: search.GramIndex, keys: DataFrame, items: DataFrame) -> dict[str, Change]:
    """How the tables of a substring index change when the items of keys (key) go and items (key, score, field, text) come."""
    gone = saved(index.items.join(keys, "key", "left_semi").select("item"), "gone_items")
    last = index.items.agg(F.coalesce(F.max("item") + 1, F.lit(0))).first()[0]
    fresh = search.gram_index(items)
    own = fresh.items.withColumn("item", F.col("item") + last)
    grams = fresh.grams.withColumn("item", F.col("item") + last)
    signed = index.grams.join(gone, "item", "left_semi").select("gram", F.lit(-1).alias("n")).unionByName(grams.select("gram", F.lit(1).alias("n")))
    moved = saved(signed.groupBy("gram").agg(F.sum("n").alias("more")), "touched_grams")
    counted = moved.join(index.counts, "gram", "left").select("gram", (F.coalesce("n", F.lit(0)) + F.col("more")).cast("long").alias("n"))
    return {"items": Change(keys, own), "grams": Change(gone, grams), "counts": Change(moved.select("gram"), saved(counted.where("n > 0"), "counts"))}
