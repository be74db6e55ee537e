"""Manifest, decontamination and whitening, as registered and as operators, against brute-force versions of their contracts."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import merkle_manifest, queries, whitening, winnowing

BENCHMARK = "item_id long, text string, length int, fp string, item string"
VECTORS = "vec_id long, embedding array<float>, label int, x string, component string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """The tables that the queries read, with columns whose names clash."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark_rows(), BENCHMARK).repartition(2).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(vector_rows(), VECTORS).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty_folder(spark, nothing, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    nothing.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], BENCHMARK).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], VECTORS).write.parquet(f"{path}/embeddings.parquet")
    return path


# --- manifest ---


def brute_manifest(rows, arity=2):
    def leaf(i, source, lang, n, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    def climb(nodes):
        """The root, and of each node the siblings on its way (before, after)."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k : k + arity] for k in range(0, len(nodes), arity)]
            for p, a in zip(paths, at, strict=True):
                run = runs[a // arity]
                p.append((run[: a % arity], run[a % arity + 1 :]))
            at, nodes = [a // arity for a in at], [sha("".join(r)) for r in runs]
        return nodes[0], paths

    groups = collections.defaultdict(list)
    for i, text, lang, source, n, *_ in rows:
        shown = n + 1 if n is not None and i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n
        groups[lang].append((i is not None, i or 0, leaf(i, source, lang, n, text), leaf(i, source, lang, shown, text), i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: climb([r[2] for r in sorted(groups[g])]) for g in order}
    root, tops = climb([made[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(sorted(groups[g]), made[g][1], strict=True):
            whole, node = path + top, r[3]
            for before, after in whole:
                node = sha("".join([*before, node, *after]))
            out.append((r[4], r[2], made[g][0], root, sha("".join(x for b, a in whole for x in b + a)), node, node == root))
    return out


def test_manifest(spark, folder, brute_rows, monkeypatch):
    expected = bag(brute_manifest(brute_rows))
    assert {v for *_, v in expected} == {True, False}
    assert bag(queries.op11_merkle_manifest(spark, folder).collect()) == expected
    monkeypatch.setattr(merkle_manifest, "LEAST_BLOCK", 4)  # many blocks: the forest resolves what crosses them
    assert bag(queries.op11_merkle_manifest(spark, folder).collect()) == expected
    assert queries.op11_merkle_manifest(spark, folder).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_of_many_groups(spark, monkeypatch, arity):
    """More groups than a block has leaves, runs of one to three siblings, groups that end within a range."""
    monkeypatch.setattr(merkle_manifest, "LEAST_BLOCK", 4)
    r = random.Random(arity)
    rows = [(k, f"t{k}", r.choice([None, *(f"l{n}" for n in range(23))]), "s", k) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = merkle_manifest.manifest(docs, arity)
    own = out.select("id", *(F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "siblings", "shown_root")), F.col("shown_root") == F.col("root")).collect()
    assert bag(own) == bag(brute_manifest(rows, arity))


def test_forest_is_an_associative_monoid():
    """However nodes are dealt to fragments and fragments merged, roots, spine and paths are the same."""
    r = random.Random(3)
    widths = {0: 1, 1: 2, 5: 13, 9: 64, 11: 37}
    nodes = [(t, w, 0, k, hashlib.sha256(f"{t}.{k}".encode()).digest()) for t, w in widths.items() for k in range(w)]
    found = []
    for _ in range(5):
        r.shuffle(nodes)
        parts = [merkle_manifest.Forest(3) for _ in range(7)]
        for node in nodes:
            parts[r.randrange(7)].add(*node)
        assert any(p.open for p in parts)
        while len(parts) > 1:
            parts.append(parts.pop(r.randrange(len(parts))).merged(parts.pop(r.randrange(len(parts)))))
        assert not parts[0].open
        found.append((parts[0].roots, parts[0].spine))
    assert all(f == found[0] for f in found)
    assert all(merkle_manifest.folded(d, parts[0].path(t, k)) == parts[0].roots[t] for t, _, _, k, d in nodes)


# --- decontamination ---


def benchmark_rows():
    from conftest import rows

    r, own = random.Random(9), [t for _, t, *_ in rows() if t]
    tokens = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", winnowing_lower(t)) for t in own]
    long = [t for t in tokens if len(t) > 40]
    texts = [" ".join(t[5:18]) for t in long[:6]] + ["  ".join(t[3:30]).upper() for t in long[6:9]] + ["-".join(t[2:12]) for t in long[9:11]]
    texts += [" ".join(t[7:11]) for t in long[11:14]] + [tokens[0][1], "never seen words at all in any of these texts here today", "", None, "?!", "zzz", texts[0], "one", "one two"]
    texts += [" ".join(r.choices(long[0], k=15)), f"before {' '.join(long[2][10:25])} after"]
    return [(k if k != 3 else None, t, 1, "f", "i") for k, t in enumerate(texts)] + [(5, texts[1], 1, "f", "i")]


def winnowing_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_leaks(docs, items, window=10):
    def cut(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", winnowing_lower(t))

    windows = collections.defaultdict(set)
    for i, t in items:
        ws = cut(t)
        n = min(window, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            windows[tuple(ws[k : k + n])].add("" if i is None else str(i))
    lengths, out = {len(w) for w in windows}, []
    for i, t in docs:
        ws, hit, found = cut(t), set(), set()
        for n in lengths:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(ws[k : k + n])]
        out.append((i, len(ws), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def test_decontamination(spark, folder, brute_rows, monkeypatch):
    expected = bag(brute_leaks([r[:2] for r in brute_rows], [r[:2] for r in benchmark_rows()]))
    assert len({r[3] for r in expected}) > 3
    assert bag(queries.op12_winnowing(spark, folder).collect()) == expected
    monkeypatch.setattr(winnowing, "fingerprint_bitmap", lambda windows: np.full(1 << 13, 255, np.uint8))  # a bitmap that is full leaves all to the join
    assert bag(queries.op12_winnowing(spark, folder).collect()) == expected


def test_decontamination_spans(spark):
    docs = spark.createDataFrame([(1, "a b c. d e f; g h"), (2, "x y"), (3, "c d, e q c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "c d e"), ("j", "d e f g"), ("k", "y"), ("l", "c d e f")], "item_id string, text string")
    out = {r["doc_id"]: r for r in winnowing.decontaminated(docs, items, window=3).collect()}
    assert [tuple(s) for s in out[1]["spans"]] == [(2, 7)] and out[1]["items"] == ["i", "j", "l"] and out[1]["n_hit"] == 5
    assert [tuple(s) for s in out[2]["spans"]] == [(1, 2)] and out[2]["items"] == ["k"]
    assert [tuple(s) for s in out[3]["spans"]] == [(0, 3), (4, 8)] and out[3]["items"] == ["i", "j", "l"]


def test_word_hashes_do_not_depend_on_place():
    """Slices, words that cross them, words too long for them, and gaps."""
    r = random.Random(1)
    long = "q" * (winnowing.LONGEST + 5)
    parts = [r.choice(["alpha", "b", "ünï", long, "x" * winnowing.LONGEST, "9"]) for _ in range(900)]
    text = " ".join(parts[:500]) + "." * (winnowing.SLICE + 100) + " ".join(parts[500:])
    found = winnowing.Words(text.encode()).hashes().tolist()
    own = {w: winnowing.Words(w.encode()).hashes().tolist()[0] for w in set(parts)}
    assert found == [own[w] for w in parts] and len(set(own.values())) == len(own)


def test_winnowing_guarantee():
    """Every window of m words has its fingerprint in any text that holds it, and few are kept."""
    r = random.Random(2)
    for length in range(1, 11):
        span = [f"w{r.randrange(50)}" for _ in range(length)]
        kept = []
        for _ in range(20):
            ws = [f"w{r.randrange(50)}" for _ in range(30)] + span + [f"w{r.randrange(50)}" for _ in range(30)]
            least, fresh = winnowing.winnowed(winnowing.Words(" ".join(ws).encode()).hashes(), length)
            kept.append(least[30])
            assert least[30] in least[fresh]
        assert len(set(kept)) == 1


# --- whitening ---


def vector_rows():
    r = np.random.default_rng(4)
    base = r.normal(size=(300, 20)) @ np.diag(np.linspace(2, 0.1, 20))
    rows = [(k, v) for k, v in enumerate(base.tolist())] + [(1_000 + k, base[k % 3].tolist()) for k in range(90)]
    rows += [(7, base[7].tolist()), (7, base[8].tolist()), (None, base[9].tolist()), (401, None), (402, []), (403, [1.0] * 3), (404, [None, *[1.0] * 19]), (405, [float("nan"), *[1.0] * 19]), (406, [float("inf"), *[1.0] * 19]), (407, [-0.0] * 20)]
    return [(i, v, 1, "x", "c") for i, v in rows]


def brute_whitening(rows):
    kept = [(i, [int(np.floor(float(np.float32(c)) * 256)) for c in v]) for i, v, *_ in rows if v and len(v) == 20 and all(c is not None and np.isfinite(c) for c in v)]
    distinct = np.array(sorted({tuple(v) for _, v in kept}))
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, values[::-1], vectors[:, ::-1]


def test_whitening(spark, folder):
    kept, n, sums, values, vectors = brute_whitening(vector_rows())
    out = queries.op13_whitening(spark, folder).collect()
    assert len(out) == 4 * len(kept) and {r["n"] for r in out} == {n}
    assert bag((r["vec_id"], r["component"], r["deviation"]) for r in out) == bag((i, c, sum((n * x - int(s)) ** 2 for x, s in zip(v, sums, strict=True))) for i, v in kept for c in (1, 2, 3, 4))
    by = collections.defaultdict(list)
    for r in out:
        by[r["component"]].append((str(r["vec_id"]), r["whitened"]))
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
    for c, own in by.items():
        expected = [(str(i), float((np.array(v) - sums / n) @ vectors[:, c - 1] / np.sqrt(values[c - 1]))) for i, v in kept]
        away = min(max(abs(a[1] - sign * b[1]) for a, b in zip(sorted(own), sorted(expected, key=lambda e: (e[0], sign * e[1])), strict=True)) for sign in (1, -1))
        assert away < 1e-9


def test_whitening_tiles_are_the_covariance(spark, monkeypatch):
    """Column blocks of unequal width, several row blocks, tiles that are given out before the end of a task."""
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "LEAST_WIDTH", 3)
    monkeypatch.setattr(whitening, "TILE_BYTES", 1)
    rows = [(i, v) for i, v, *_ in vector_rows()]
    model, _ = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    x = np.array(sorted({tuple(int(np.floor(c * 256)) for c in v) for _, v in rows if v and len(v) == 20 and all(c is not None and np.isfinite(c) for c in v)}))
    assert np.allclose(model.components @ np.diag(model.values) @ model.components.T, np.cov(x.T, bias=True), atol=1e-8)


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    assert bag(whitening.whitened(same).collect()) == bag((i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2))
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")
    out = {(r["vec_id"], r["component"]): r for r in whitening.whitened(line).collect()}
    assert abs(out[1, 1]["whitened"]) == pytest.approx(1) and out[1, 1]["explained"] == pytest.approx(1) and out[1, 2]["whitened"] is None and out[1, 1]["identity_error"] < 1e-9
    huge = spark.createDataFrame([(1, [1e15]), (2, [-1e15])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whitened(huge).collect()} == {None}


def test_on_empty_tables(spark, empty_folder, folder, docs):
    for query in (queries.op11_merkle_manifest, queries.op12_winnowing, queries.op13_whitening):
        assert query(spark, empty_folder).count() == 0
        assert query(spark, empty_folder).columns == query(spark, folder).columns
    clean = winnowing.decontaminated(docs, spark.read.parquet(f"{empty_folder}/benchmark.parquet")).collect()
    assert len(clean) == docs.count() and not any(r["n_hit"] or r["items"] for r in clean)
