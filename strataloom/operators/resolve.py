"""Which file an import means, and which tests belong to a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, rules


def candidates(imports: DataFrame, aliases: dict[str, list[str]] | None = None, go_module: str | None = None) -> DataFrame:
    """file, pos, rank, base: the paths (without suffix) that a specifier can mean, best first.

    Relative ones from the file's directory; a Go module's own prefix from the root; then each alias by its targets.
    """
    spec = F.col("specifier")
    bases = [F.when(spec.startswith("."), paths.normalised(F.concat_ws("/", paths.dirname(F.col("file")), spec)))]
    free = ~spec.startswith(".")
    if go_module:
        bases.append(F.when(free & ((spec == go_module) | spec.startswith(go_module + "/")), paths.normalised(F.substring(spec, len(go_module) + 1, 1 << 30))))
    for alias, targets in (aliases or {}).items():
        clean = alias.removesuffix("/*")
        for target in targets:
            rest = F.regexp_replace(F.substring(spec, len(clean) + 1, 1 << 30), "^/", "")
            bases.append(F.when(free & ((spec == clean) | spec.startswith(clean + "/")), paths.normalised(F.concat_ws("/", F.lit(target.removesuffix("/*")), rest))))
    return imports.select("file", "pos", "specifier", F.posexplode(F.array(*bases)).alias("base_rank", "base")).where("base IS NOT NULL")


def resolved(imports: DataFrame, files: DataFrame, aliases: dict[str, list[str]] | None = None, go_module: str | None = None) -> DataFrame:
    """file, pos, specifier, target of all imports (file, pos, specifier) that mean one of files (column path).

    Order: the file itself, its name with each suffix, the first non-test .go file of a directory, the directory's index files.
    Each file is known by what is left of its path without each ending that it has, so an equi-join on that meets the imports,
    of which there is a row for each base; then the best rank of each import.
    """
    tails = [("", 0), *((s, k + 1) for k, s in enumerate(rules.RESOLVE_SUFFIXES)), *(("/" + n, k + 20) for k, n in enumerate(rules.INDEX_NAMES))]
    base = candidates(imports, aliases, go_module)
    path = F.col("path")
    cut = [(F.when(path.endswith(t), F.substring(path, F.lit(1), F.length(path) - len(t))), r) for t, r in tails]
    cut += [(F.when(path == t[1:], F.lit("")), r) for t, r in tails if t.startswith("/")]  # in the root
    known = F.filter(F.array(*(F.struct(b.alias("base"), F.lit(r).alias("tail_rank")) for b, r in cut)), lambda x: x["base"].isNotNull())
    named = files.select("path", F.explode(known).alias("t")).select("t.base", "path", "t.tail_rank")
    go = files.where(F.col("path").endswith(".go")).select(paths.dirname(F.col("path")).alias("base"), "path", F.col("path").endswith("_test.go").alias("test"))
    first_go = go.groupBy("base").agg(F.min(F.struct("test", "path")).alias("least")).select("base", F.col("least.path").alias("path"), F.lit(10).alias("tail_rank"))
    # What a table of a few MB yields is much larger than its files say, so neither side is to be broadcast.
    met = base.join(named.unionByName(first_go).hint("merge"), "base")
    best = F.row_number().over(Window.partitionBy("file", "pos").orderBy("base_rank", "tail_rank", "path"))
    return met.withColumn("best", best).where("best = 1").select("file", "pos", "specifier", F.col("path").alias("target"))


HOVER_TAILS = ("", ".ts", ".tsx", "/index.ts")


def hover(index: DataFrame, file: str, specifier: str) -> DataFrame:
    """path, score, purpose, stale of the first file that a relative import can mean and that has an entry; no row for other imports."""
    base = paths.normalised(F.concat_ws("/", paths.dirname(F.lit(file)), F.lit(specifier)))
    names = F.array(*(F.concat(base, F.lit(t)) for t in HOVER_TAILS))
    own = index.withColumn("at", F.array_position(names, F.col("path"))).where((F.col("at") > 0) & F.lit(specifier.startswith(".")))
    return own.orderBy("at").limit(1).select("path", "score", "purpose", "stale")


def hovers(imports: DataFrame, index: DataFrame) -> DataFrame:
    """file, specifier, path, score: hover of all relative imports at once, an equi-join on the candidates."""
    base = paths.normalised(F.concat_ws("/", paths.dirname(F.col("file")), F.col("specifier")))
    each = F.posexplode(F.array(*(F.concat(base, F.lit(t)) for t in HOVER_TAILS))).alias("at", "path")
    own = imports.where(F.startswith("specifier", F.lit("."))).select("file", "specifier", each).join(index.select("path", "score"), "path")
    return own.groupBy("file", "specifier").agg(F.min(F.struct("at", "path", "score")).alias("first")).select("file", "specifier", "first.path", "first.score")


def related_tests(files: DataFrame, tests: DataFrame) -> DataFrame:
    """path, test: tests named after a file, or in a __tests__ directory below its own with its name in theirs; each once.

    The first rule is an equi-join on the stem. For the second each test in a __tests__ directory is given all directories
    above it, so it too is an equi-join, with the name as a filter.
    """
    own = files.select("path", paths.dirname(F.col("path")).alias("dir"), F.regexp_replace(paths.basename(F.col("path")), r"(?<=.)\.[^.]*$", "").alias("stem"))
    name = paths.basename(F.col("test"))
    suffix = "|".join(s.replace(".", r"\.") for s in rules.TEST_SUFFIXES)
    all_tests = tests.select(F.col("path").alias("test"))
    by_name = all_tests.where(name.rlike(f"({suffix})$")).withColumn("stem", F.regexp_replace(name, f"({suffix})$", ""))
    parts = F.split(paths.dirname(F.col("test")), "/")
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit(".")))
    near = all_tests.where(F.contains("test", F.lit("__tests__"))).select("test", F.explode(F.array_distinct(above)).alias("dir"))
    first = own.join(by_name, "stem").select("path", "test")
    second = own.join(near, "dir").where(F.contains(paths.basename(F.col("test")), F.col("stem"))).select("path", "test")
    return first.union(second).distinct()
