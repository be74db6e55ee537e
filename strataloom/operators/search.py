"""Full-text search over fields of documents, and search for substrings.

An index is five tables. Documents are dealt into ranges of about BLOCK_DOCS of like length; a block is the postings of a
term in a field and a range, and has a row of its own with the greatest term frequency and the least length in it, so what
any of its documents can score is bounded without reading its postings. The best k are found in two steps: the ranges with the highest bounds are scored, and
then only those whose bound reaches the k-th score. The dictionary holds each term under all its forms with up to two
letters left out; two words within two edits of each other share a form, so near terms are found by a join and verified.

Substrings are found by trigrams: what holds the rarest of a query's is verified.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import joined, saved

K1, B, DELTA = 1.2, 0.7, 0.5
PREFIX_WEIGHT, FUZZY_WEIGHT, FUZZY = 0.375, 0.45, 0.2
BLOCK_DOCS = 128
#: Classes of document length for each doubling of it.
LENGTH_CLASSES = 8
#: Edits that the dictionary's forms allow for, and the longest term under forms: two more letters than the longest word with so few edits.
EDITS, FORM_LETTERS = 2, 14
#: Scores are rounded to so many digits, so that ties do not depend on the order of sums.
DIGITS = 9


@dataclass
class TextIndex:
    """postings: term, field, range, key, tf, length; blocks: term, field, range, n, most_tf, least_length; terms: term, field, df; forms: form, term; fields: field, n, mean."""

    postings: DataFrame
    blocks: DataFrame | None
    terms: DataFrame
    forms: DataFrame | None
    fields: DataFrame


@dataclass
class GramIndex:
    """items: item, key, score, field, text; grams: gram, item; counts: gram, n."""

    items: DataFrame
    grams: DataFrame
    counts: DataFrame


def terms(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, split where an index splits texts."""
    return sorted(set("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in query.lower()).split()))


def edits(length: int, fuzzy: float = FUZZY) -> int:
    """How many edits a word of so many letters allows."""
    return round(fuzzy * length)


def without_letter(word: Column) -> Column:
    """The word under every form with one letter left out."""
    one = F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.concat(F.substring(word, 1, k - 1), F.substring(word, k + 1, F.length(word))))
    return F.when(F.length(word) > 0, one).otherwise(F.array().cast("array<string>"))


def forms_of(word: Column) -> Column:
    """The word itself and all its forms with one or two letters left out, each once."""
    one = without_letter(word)
    return F.array_distinct(F.concat(F.array(word), one, F.flatten(F.transform(one, without_letter))))


def counted(words: Column, n: Column) -> Column:
    """(term, tf) of each distinct word of a sorted array of n words, one at least: a run of equal words is a term."""
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (F.get(words, k) != F.get(words, F.greatest(k - 1, F.lit(0)))))
    ends = F.concat(F.slice(starts, 2, n), F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(words, a).alias("term"), (b - a).cast("long").alias("tf")))


def blocks_of(postings: DataFrame) -> DataFrame:
    """A row for each block of the postings."""
    return postings.groupBy("term", "field", "range").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most_tf"), F.min("length").alias("least_length"))


def text_index(docs: DataFrame, key: str, fields: list[str], blocks: bool = True, parts: dict[int, int] | None = None) -> TextIndex:
    """The index of docs (key, fields); a key names one document. Texts are split once, and terms counted where a text is read.

    Without blocks, for an index that one query is asked of, a search makes the rows of those blocks only that its terms have,
    and compares its words with all terms of about their length; the forms of all terms would be a hundred rows for each.
    parts: how many ranges an index that docs are added to has of each class of length.
    """
    split = docs.select(F.col(key).alias("key"), *(F.array_sort(terms(F.col(f"`{f}`"))).alias(f"t{k}") for k, f in enumerate(fields)))
    sizes = [F.greatest(F.size(f"t{k}"), F.lit(0)) for k in range(len(fields))]  # of a null text 0
    total = sum(sizes[1:], sizes[0])
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"t{k}").alias("terms"), sizes[k].alias("length")) for k, f in enumerate(fields))))
    spread = F.floor(F.log2(total + 1) * LENGTH_CLASSES).cast("int")
    own = saved(split.select("key", spread.alias("spread"), each.alias("e")).where("e.length > 0").select("key", "spread", "e.*"), "split")
    known = parts or {}
    sizes_of = {r["spread"]: max(known.get(r["spread"], 1), -(-r["n"] // BLOCK_DOCS)) for r in own.groupBy("spread").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class of length
    parts = F.element_at(F.create_map(*(F.lit(x) for p in sizes_of.items() for x in p)), F.col("spread")) if sizes_of else F.lit(1)
    rank = (F.col("spread").cast("long") * (1 << 40) + F.pmod(F.xxhash64("key"), parts)).alias("range")
    postings = saved(own.select("key", "field", "length", rank, F.explode(counted(F.col("terms"), F.col("length"))).alias("e")).select("e.term", "field", "range", "key", "e.tf", "length"), "postings")
    words = postings.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    forms = words.where(F.length("term") <= FORM_LETTERS).select("term").distinct().select(F.explode(forms_of(F.col("term"))).alias("form"), "term")
    return TextIndex(postings, blocks_of(postings) if blocks else None, words, forms if blocks else None, own.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")))


def near_terms(words: DataFrame, forms: DataFrame, most: Column | int = EDITS) -> DataFrame:
    """word, term, distance: for each word the terms within so many edits (at most EDITS), itself left out; terms of FORM_LETTERS letters at most.

    Words and terms meet by equal forms, so no term is compared with a word that it shares no form with.
    """
    asked = words.select("word", F.explode(forms_of(F.col("word"))).alias("form"))
    pairs = asked.join(forms, "form").select("word", "term").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "term")).where((F.col("distance") > 0) & (F.col("distance") <= most))


def matching_terms(index: TextIndex, query: str, prefix: bool = True, fuzzy: float = FUZZY) -> DataFrame:
    """term, weight: the index's terms that a query word is, begins, or nearly is, with the best weight.

    Words that allow for more than EDITS edits (13 letters and more), or all in an index without forms, are compared with all
    terms of about their length.
    """
    words = query_terms(query)
    if not words:
        raise ValueError("the query is empty")
    spark = index.terms.sparkSession
    known = index.terms.select("term")
    asked = F.broadcast(spark.createDataFrame([(w, edits(len(w), fuzzy)) for w in words], "word string, most int"))  # a row for each word of a query
    if prefix:
        begins = known.where(_any(F.startswith("term", F.lit(w)) for w in words)).distinct()
        pairs = begins.join(asked, F.startswith("term", "word")).select("term", "word")
    else:
        pairs = known.where(F.col("term").isin(*words)).distinct().select("term", F.col("term").alias("word"))
    most = 0 if index.forms is None else EDITS
    short = [w for w in words if 0 < edits(len(w), fuzzy) <= most]
    long = [w for w in words if edits(len(w), fuzzy) > most]
    if short:
        pairs = pairs.union(near_terms(F.broadcast(spark.createDataFrame([(w,) for w in short], "word string")), index.forms).select("term", "word"))
    if long:
        about = _any(F.length("term").between(len(w) - edits(len(w), fuzzy), len(w) + edits(len(w), fuzzy)) for w in long)
        pairs = pairs.union(known.where(about).distinct().join(asked.where(F.col("most") > most), F.abs(F.length("term") - F.length("word")) <= F.col("most")).select("term", "word"))
    apart = F.levenshtein("term", "word")
    weight = F.when(F.col("term") == F.col("word"), 1.0)
    if prefix:
        weight = weight.when(F.startswith("term", "word"), PREFIX_WEIGHT * F.length("word") / F.length("term"))
    weight = weight.when((apart > 0) & (apart <= F.col("most")), FUZZY_WEIGHT / (1 + apart))
    return pairs.distinct().join(asked, "word").groupBy("term").agg(F.max(weight.cast("double")).alias("weight")).where("weight IS NOT NULL")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _part(tf: str, length: str) -> Column:
    """What a term in a field adds to a score: greater with its frequency, less with the field's length."""
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.col("weight") * idf * (DELTA + F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / F.col("mean"))))


def weighed(index: TextIndex, query: str, prefix: bool = True, fuzzy: float = FUZZY) -> DataFrame:
    """term, field, weight, df, docs, mean of the terms that a query matches."""
    fields = index.fields.select("field", F.col("n").alias("docs"), "mean")
    return index.terms.join(matching_terms(index, query, prefix, fuzzy), "term").join(F.broadcast(fields), "field")  # a row for each field


def scored(postings: DataFrame) -> DataFrame:
    """key, score, fields from postings with the weights of their terms."""
    found = postings.groupBy("key").agg(F.sum(_part("tf", "length")).alias("score"), F.sort_array(F.collect_set("field")).alias("fields"))
    return found.withColumn("score", F.round("score", DIGITS))


def ranges_to_read(index: TextIndex, own: DataFrame, limit: int, matched: DataFrame | None = None) -> DataFrame:
    """range of the ranges that may hold one of the best for the terms in own (see weighed); matched: the postings of these terms with what own has of them, where they are made already.

    The first limit ranges by bound hold as many matches at least, so the limit-th score in them is one that the bounds of
    all others have to reach.
    """
    matched = index.postings.join(joined(own), ["term", "field"]) if matched is None else matched
    blocks = blocks_of(matched) if index.blocks is None else index.blocks
    bounds = saved(blocks.join(own, ["term", "field"]).groupBy("range").agg(F.sum(_part("most_tf", "least_length")).alias("bound")), "bounds")
    first = [r["range"] for r in bounds.orderBy(F.desc("bound"), "range").limit(limit).collect()]
    best = [r["score"] for r in scored(matched.where(F.col("range").isin(first))).select("score").orderBy(F.desc("score")).limit(limit).collect()]
    most = F.col("bound") >= (best[-1] - 10.0**-DIGITS if best and len(best) >= limit else 0.0)
    return bounds.where(most | F.col("range").isin(first)).select("range")


def search(index: TextIndex, query: str, limit: int | None = 20, prefix: bool = True, fuzzy: float = FUZZY) -> DataFrame:
    """key, score, fields: documents with a matching term, by BM25+ summed over terms and fields, ties by key; limit None: all, in no order.

    Document counts and mean lengths are taken per field over the whole index; only postings of matching terms are scored, and
    with a limit only those of ranges that can hold one of the best.
    """
    if index.blocks is None and (prefix or fuzzy):  # all terms are looked through, and that more than once; exact ones are filtered before they are counted
        index = replace(index, terms=saved(index.terms, "terms"))
    own = saved(weighed(index, query, prefix, fuzzy), "weights")
    matched = index.postings.join(joined(own), ["term", "field"])
    if limit is None:
        return scored(matched)
    if index.blocks is None:
        matched = saved(matched, "matched")
    return scored(matched.join(ranges_to_read(index, own, limit, matched), "range", "left_semi")).orderBy(F.desc("score"), "key").limit(limit)


def grams_of(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    letters = F.split(text, "")
    two = F.zip_with(letters, F.slice(letters, 2, F.greatest(F.size(letters), F.lit(1))), lambda a, b: F.concat(a, b))
    three = F.zip_with(two, F.slice(letters, 3, F.greatest(F.size(letters), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(three, lambda g: g.isNotNull()))


def gram_index(items: DataFrame) -> GramIndex:
    """The index of items (key, score, field, text), case apart."""
    own = saved(items.select(F.monotonically_increasing_id().alias("item"), "key", "score", "field", "text"), "items")
    grams = saved(own.select(F.explode(grams_of(F.lower("text"))).alias("gram"), "item"), "grams")
    return GramIndex(own, grams, grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))


def substring_matches(index: GramIndex, queries: DataFrame) -> DataFrame:
    """query, item, key, score, field, text: the items that hold each query (column query, at least three characters), case apart.

    A query asks for its rarest trigram only; an item that has it is verified. A query one of whose trigrams is nowhere has no
    match and asks for nothing. What is asked for is saved, so the index is read in its own splits and not by the tasks that
    the queries are dealt to, and an item meets a query once, so nothing is counted for the pair.
    """
    asked = queries.select("query", F.lower("query").alias("low")).where(F.length("low") >= 3).distinct()
    each = asked.select("query", F.explode(grams_of(F.col("low"))).alias("gram")).join(index.counts, "gram", "left")
    known = each.withColumn("missing", F.max(F.col("n").isNull()).over(Window.partitionBy("query"))).where("NOT missing")
    rare = known.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("n", "gram"))).where("rank = 1")
    wanted = joined(saved(rare.select("query", "gram"), "wanted"))
    near = joined(saved(index.grams.join(wanted, "gram").select("query", "item"), "near"))
    return index.items.join(near, "item").where(F.contains(F.lower("text"), F.lower("query"))).select("query", "item", "key", "score", "field", "text")


def substring_search(index: GramIndex, query: str, limit: int = 20) -> DataFrame:
    """What substring_scan gives, by the index; queries of less than three characters are scanned for."""
    if len(query) < 3:
        return substring_scan(index.items, query, limit)
    return _listed(substring_matches(index, index.items.sparkSession.createDataFrame([(query,)], "query string")), limit)


def substring_scan(items: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """key, score, matches: documents whose items (key, score, field, text) hold the query, case apart: the first by index order."""
    return _listed(items.where(F.contains(F.lower("text"), F.lit(query.lower()))), limit)


def _listed(hit: DataFrame, limit: int) -> DataFrame:
    each = hit.groupBy("key", "score").agg(F.array_sort(F.collect_list(F.struct("field", "text"))).alias("matches"))
    return each.orderBy(F.desc("score"), "key").limit(limit)
