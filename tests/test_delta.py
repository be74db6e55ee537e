"""Tables changed in part against tables made anew."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import delta, graph, search
from strataloom.plans import generate, serve
from strataloom.sources import config, files


def rows(df, *columns):
    return sorted((tuple(map(str, r)) for r in df.select(*(columns or sorted(df.columns))).collect()))


@pytest.mark.parametrize("rounds", [delta.ROUNDS, 1])
def test_components_under_changes(spark, rounds):
    """Random edges come and go, self-loops included; with too few rounds all is made anew."""
    r = random.Random(5)
    make = lambda n: [(100 * p + r.randint(0, 12), 100 * p + r.randint(0, 12)) for p in range(5) for _ in range(n)]
    old, added = make(16), make(2)
    removed = r.sample(old, 8)
    left = list(old)
    for e in removed:
        left.remove(e)
    frame = lambda e: spark.createDataFrame(e, "src long, dst long")
    before = graph.strong_components(frame(old))
    found = delta.applied(before, delta.components(before, frame(removed), frame(added), frame(left + added), rounds))
    assert rows(found) == rows(graph.strong_components(frame(left + added)))


def test_components_far_from_a_change_are_left_alone(spark):
    frame = lambda e: spark.createDataFrame(e, "src long, dst long")
    far = [(100 + n, 100 + (n + 1) % 50) for n in range(50)]
    before = graph.strong_components(frame([*far, (1, 2)]))
    change = delta.components(before, frame([]), frame([(2, 1)]), frame([*far, (1, 2), (2, 1)]))
    assert rows(change.gone) == [("1",), ("2",)] and rows(change.rows, "node", "component") == [("1", "1"), ("2", "1")]


def test_search_under_changes(spark):
    """Documents that go, come and change, one after another, against an index of what there is in the end."""
    r = random.Random(7)
    words = ["route", "api", "license", "model", "store", "über", "a1", "cache", "internationalisation"]
    text = lambda: " ".join(r.choices(words, k=r.randint(0, 12)))
    docs = {f"d{k}": (text(), text()) for k in range(40)}
    frame = lambda ids: spark.createDataFrame([(i, *docs[i]) for i in ids], "id string, x string, y string")
    items = lambda ids: spark.createDataFrame([(i, 1.0, f, t) for i in ids for f, t in zip("xy", docs[i], strict=True)], "key string, score double, field string, text string")
    index, grams = search.text_index(frame(docs), "id", ["x", "y"]), search.gram_index(items(docs))
    for touched, dropped in ((["d1", "d2", "new"], ["d3"]), (["d2", "other"], ["new", "d4"])):
        docs |= {i: (text() + f" only{i}", text()) for i in touched}
        for i in dropped:
            docs.pop(i)
        keys = spark.createDataFrame([(i,) for i in touched + dropped], "key string")
        own = delta.text_changes(index, keys, frame(touched), "id", ["x", "y"])
        index = search.TextIndex(**{n: generate.saved(delta.applied(getattr(index, n), c), n) for n, c in own.items()})
        more = delta.gram_changes(grams, keys, items(touched))
        grams = search.GramIndex(**{n: generate.saved(delta.applied(getattr(grams, n), c), n) for n, c in more.items()})
    whole, all_grams = search.text_index(frame(docs), "id", ["x", "y"]), search.gram_index(items(docs))
    for name in ("terms", "forms", "fields"):
        assert rows(getattr(index, name)) == rows(getattr(whole, name)), name
    assert rows(index.postings.drop("range")) == rows(whole.postings.drop("range"))
    assert rows(index.blocks) == rows(search.blocks_of(index.postings))
    assert rows(grams.counts) == rows(all_grams.counts) and rows(grams.items.drop("item")) == rows(all_grams.items.drop("item"))
    assert grams.items.select("item").distinct().count() == grams.items.count()
    for query in ("api route", "licence", "onlyother"):
        assert rows(search.search(index, query, 10)) == rows(search.search(whole, query, 10))
    assert rows(search.substring_search(grams, "LYOTH")) == rows(search.substring_search(all_grams, "LYOTH")) != []


def source(r, n):
    """A file that imports some of n others, which may not be there."""
    lines = [f"import {{ x{k} }} from './f{k}'" for k in r.sample(range(n), r.randint(0, 2))]
    return "\n".join([*lines, f"export const v{r.randint(0, 9)} = process.env.KEY_{r.randint(0, 3)}", *["// TODO: later"] * r.randint(0, 1)]) + "\n"


def test_batches_give_what_a_run_over_all_gives(spark, tmp_path, monkeypatch):
    """Twenty random edits in two batches: files change, come and go; all tables are those of a run over all. Only what is affected is
    written, and after enough such versions a full one."""
    r, n, out = random.Random(11), 24, str(tmp_path / "out")
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    put = lambda k: (root / f"src/f{k}.ts").write_text(source(r, n))
    for k in range(0, n, 2):
        put(k)
    (root / "src/f0.test.ts").write_text("import { x0 } from './f0'\n")
    for k in range(60):
        (root / f"src/alone{k}.ts").write_text(f"export const v{k} = 1\n")
    own, now = config.Config(str(root), include=("src/*.ts",)), F.lit("2024-06-01").cast("timestamp")
    covered, commits = spark.createDataFrame([], "path string, coverage_pct double"), spark.createDataFrame([], generate.COMMITS)
    scan = lambda: generate.saved(files.scan_repository(spark, str(root), ("**/*",), ()), "files")
    generate.write(generate.run(scan(), commits, covered, own, now), out)
    monkeypatch.setattr(generate, "MOST_LAYERS", 1)
    for batch in range(2):
        edited = set()
        for _ in range(10):
            k = r.randrange(n)
            edited.add(f"src/f{k}.ts")
            if (root / f"src/f{k}.ts").exists() and r.random() < 0.3:
                (root / f"src/f{k}.ts").unlink()
            else:
                put(k)
        generate.apply_changes(spark, out, spark.createDataFrame([(p,) for p in edited], "filename string"), scan(), commits, covered, own, now, in_part=True)
        folder = generate.current(spark, out)
        assert len(generate.chain(spark, folder)) == 2 - batch
        if batch == 0:
            for name in ("files", "signals", "analyses", "notes", "index", "nodes", "parsed", "hashes"):
                assert 0 < spark.read.parquet(f"{folder}/{name}_rows").count() <= n, name
            assert not spark.read.parquet(f"{folder}/notes_rows").where(F.contains("file_path", F.lit("alone"))).count()
    found, expected = generate.stored(spark, out), generate.run(scan(), commits, covered, own, now)
    for name in ("files", "analyses", "edges", "signals", "notes", "index", "nodes", "divergences", "terms", "forms", "counts", "parsed", "hashes", "fingerprints", "components"):
        assert rows(getattr(found, name)) == rows(getattr(expected, name)), name
    assert rows(found.postings.drop("range")) == rows(expected.postings.drop("range")) and rows(found.items.drop("item")) == rows(expected.items.drop("item"))
    assert rows(serve.call(found, "full_text_search", query="todo")) == rows(serve.call(expected, "full_text_search", query="todo"))
    assert {f"src/{p.removesuffix('.json')}" for p in os.listdir(f"{out}/notes/src")} == {p for (p,) in rows(expected.notes, "file_path")}
