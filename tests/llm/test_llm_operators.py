"""Each operator against a brute-force version on one fixture of awkward rows, and on an empty table."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataloom.llm import boundary_bpe, common, cuckoo_dedup, deleted_interpolation, golay_simhash, imatch, mixing, ppm_langid, secret_dfa, token_orc, vector_packing, word_pieces

BPE = public_tokenizers.path("word_bpe_49k.json")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def crc(i):
    return zlib.crc32(str(i).encode() if i is not None else b"")


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_deleted_interpolation(docs, brute_rows):
    out = deleted_interpolation.scores(docs).collect()
    tokens = [(i, [*words(t), "\n"]) for i, t, *_ in brute_rows]
    c = collections.Counter(w for i, ws in tokens if crc(i) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    expected = bag((i, crc(i) % 10 == 0, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    assert bag((*r[:5], round(r["base_score"], 6)) for r in out) == expected
    assert all(r["score"] < 0 for r in out)
    held = [r for r in out if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def brute_scores(rows):
    """Scores of a bigram model whose weights are learned by plain EM on the deleted texts, token by token."""
    texts = [(i, ["\n", *words(t), "\n"]) for i, t, *_ in rows]  # the end of the text before is the first token's context

    def counts(keep):
        word, pair = collections.Counter(), collections.Counter()
        for i, ws in texts:
            if keep(crc(i) % 10):
                word.update(ws[1:])
                pair.update(zip(ws, ws[1:], strict=False))
        return word, pair, sum(word.values()), len(word)

    def estimates(model, a, b):
        word, pair, n, v = model
        return 1 / (v + 1), word[b] / n if n else 0.0, pair[a, b] / word[a] if word[a] else 0.0

    def bucket(n):
        return n.bit_length()

    model = counts(lambda c: c not in (0, 9))
    held = [(bucket(model[0][a]), estimates(model, a, b)) for i, ws in texts if crc(i) % 10 == 9 for a, b in zip(ws, ws[1:], strict=False)]

    def fit(own):
        weights = deleted_interpolation.DEFAULT_WEIGHTS
        for _ in range(deleted_interpolation.EM_ROUNDS):
            sums = [0.0] * 3
            for p in own:
                parts = [w * x for w, x in zip(weights, p, strict=True)]
                sums = [s + x / sum(parts) for s, x in zip(sums, parts, strict=True)]
            weights = [s / sum(sums) for s in sums]
        weights = [max(w, least) for w, least in zip(weights, (1e-6, 1e-9, 0.0), strict=True)]
        return [w / sum(weights) for w in weights]

    learned = collections.defaultdict(lambda f=fit([p for _, p in held]): f) | {b: fit([p for x, p in held if x == b]) for b in {b for b, _ in held}}
    model, out = counts(lambda c: c != 0), []
    for i, ws in texts:
        score = 0.0
        for a, b in zip(ws, ws[1:], strict=False):
            weights = [w if k < 2 or model[0][a] else 0.0 for k, w in enumerate(learned[bucket(model[0][a])])]
            score += math.log10(sum(w * p for w, p in zip(weights, estimates(model, a, b), strict=True)) / sum(weights))
        out.append((i, len(ws) - 1, round(score, 4)))
    return out


def test_deleted_interpolation_scores(docs, brute_rows, monkeypatch):
    """With a grid so fine that a cell holds one ratio, scores are those of plain EM; with the grid in use they are near."""
    expected = sorted(brute_scores(brute_rows), key=str)
    rough = deleted_interpolation.scores(docs).collect()
    monkeypatch.setattr(deleted_interpolation, "GRID", 4_096)
    exact = deleted_interpolation.scores(docs).collect()
    for out, tolerance in ((exact, 1e-6), (rough, 2e-3)):
        own = sorted(((r["doc_id"], r["n_tokens"], round(r["score"], 4)) for r in out), key=str)
        by = collections.defaultdict(list)
        for i, n, x in own:
            by[i, n].append(x)
        for i, n, x in expected:
            assert min(abs(x - y) for y in by[i, n]) <= tolerance * max(1, abs(x)) + 1e-4, (i, n, x, by[i, n])


def test_chunks_and_ranges_grow_with_the_root():
    """A row of a chunk and a range for at most one in ROOT^2 tokens, however many there are."""
    for tokens in (10**11, 10**13, 10**15):
        chunk, ranges = deleted_interpolation.planned(tokens)
        assert tokens / chunk * ranges <= 1.1 * tokens / deleted_interpolation.ROOT**2
    assert deleted_interpolation.planned(10**6) == (deleted_interpolation.CHUNK_TOKENS, 1)


def test_deleted_interpolation_is_a_distribution():
    """The mixture over the vocabulary and one unknown word sums to one in every bucket."""
    weights = deleted_interpolation.learned_weights([(1, 4, 8, 10, 10.0, 20.0), (1, -(1 << 20), -(1 << 20), 3, 0.0, 0.0), (5, 12, 40, 7, 21.0, 70.0)])
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all()
    assert weights[5, 2] > weights[1, 2]


def test_deleted_interpolation_small_chunks_agree(spark, docs, monkeypatch):
    whole = {(r["doc_id"], r["n_tokens"]): r["score"] for r in deleted_interpolation.scores(docs).collect()}
    monkeypatch.setattr(deleted_interpolation, "RANGE_KEYS", 500)
    again = {(r["doc_id"], r["n_tokens"]): r["score"] for r in deleted_interpolation.scores(docs.repartition(7)).collect()}
    assert whole.keys() == again.keys() and all(math.isclose(whole[k], again[k], rel_tol=1e-9) for k in whole)


def test_token_orc(spark, docs, brute_rows):
    path = common.shared_path(spark, "tokens")
    token_orc.write_tokens(docs, path, BPE)
    library = Tokenizer.from_file(BPE)
    keys = {r["t"]: r["k"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), common.row_key().alias("k")).collect()}
    own = [(i, keys[t or ""], np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t, *_ in brute_rows]
    own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, expected = 0, []
    for i, _, ids in own:
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert bag(token_orc.checksums(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == bag(expected)
    found = token_orc.read_tokens(spark, path).where("doc_id = 207").collect()
    assert found[0]["tokens"][-1] == 2 and len(found) == 1


def test_token_orc_files_follow_each_other(spark, docs, monkeypatch):
    """Many files give the rows that one file gives, also where an id repeats over several of them."""
    more = docs.unionByName(docs.where("doc_id = 4").crossJoin(spark.range(40)).drop("id").withColumn("text", F.concat("text", F.rand(3).cast("string"))))
    more = common.saved(more, "more")
    out = []
    for size in (1 << 30, 4_000):
        monkeypatch.setattr(token_orc, "FILE_BYTES", size)
        path = common.shared_path(spark, "tokens")
        token_orc.write_tokens(more, path, BPE)
        out.append(bag(token_orc.checksums(spark, path).collect()))
    assert out[0] == out[1]
    assert token_orc.read_tokens(spark, path).select("_metadata.file_name").distinct().count() > 3


def test_vector_packing(docs, brute_rows):
    out = vector_packing.shard_documents(docs, shards=4).collect()
    text = {}
    for i, t, *_ in brute_rows:
        text.setdefault((i, zlib.crc32((t or "").encode())), t or "")
    assert bag((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == bag((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in brute_rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_packing_balances_three_measures():
    r = np.random.default_rng(3)
    loads = np.stack([r.pareto(2.5, 5_000) + 1, r.integers(1, 100, 5_000), np.ones(5_000)], axis=1)
    shard = vector_packing.pack_vectors(loads, 24)
    for k in range(3):
        own = np.bincount(shard, loads[:, k], 24)
        assert own.max() / own.mean() < 1.02 and own.min() / own.mean() > 0.98


def test_a_huge_group_is_cut_only_where_asked(spark):
    docs = spark.createDataFrame([(k, "same words here" if k % 2 else f"text {k}") for k in range(2_000)], "doc_id long, text string")
    own = vector_packing.shard_documents(docs, shards=8, cut_above=0.5).collect()
    sizes = collections.Counter()
    for r in own:
        sizes[r["shard"]] += r["size"]
    assert len(own) == 2_000 and len(sizes) == 8 and max(sizes.values()) < 1.1 * sum(sizes.values()) / 8
    whole = vector_packing.shard_documents(docs, shards=8).collect()
    assert len({r["shard"] for r in whole if r["doc_id"] % 2}) == 1 and len(whole) == 2_000


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: w[s] * level for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def test_mixing(docs, brute_rows):
    out = [r.asDict() | {f"_{k}": v for k, v in r["mix"].asDict().items()} for r in mixing.mixed(docs.select("doc_id", "text", "source")).collect()]
    sizes = collections.Counter()
    for _, t, _, s, *_ in brute_rows:
        sizes[s] += len(words(t))
    target = brute_targets(sizes)
    assert {(r["source"], r["_source_size"]) for r in out} == set(sizes.items())
    for r in out:
        assert math.isclose(r["_target"], target[r["source"]], rel_tol=1e-9)
        assert r["_size"] == len(words(r["text"])) and 0 <= r["_copies"] <= 2
    emitted = mixing.emitted(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r["_copies"] for r in out)


@pytest.mark.parametrize("seed", range(5))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{k}": r.choice([0, 1, 10, 1_000, 50_000]) for k in range(7)} | {None: r.randint(0, 100)}
    out = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    expected = brute_targets(sizes)
    assert all(math.isclose(x["target"], expected[x["source"]], rel_tol=1e-9, abs_tol=1e-9) for x in out)


def test_imatch(docs, brute_rows):
    out = imatch.compared(docs).collect()
    own = sorted(((i, t or "") for i, t, *_ in brute_rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    by_text = collections.defaultdict(set)
    assert bag((r["doc_id"], r["n_chars"]) for r in out) == bag((i, len(t)) for i, t in own)
    edits = collections.Counter()
    ids = collections.Counter(i for i, _ in own)
    for k, (i, t) in enumerate(own):
        following = own[(k + 1) % len(own)]
        if ids[i] == 1 and ids[following[0]] == 1:
            edits[i, imatch.edited(t, following[1])] += 1
    got = {(r["doc_id"], r["edited"]) for r in out}
    assert set(edits) <= got
    whole = imatch.fingerprints(docs).collect()
    text_of = collections.defaultdict(set)
    for i, t in own:
        text_of[i].add(t)
    for r in whole:
        if len(text_of[r["doc_id"]]) == 1:
            by_text[next(iter(text_of[r["doc_id"]]))].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r["near_edited"] for r in out if r["n_chars"] > 50]) > np.mean([r["near_next"] for r in out if r["n_chars"] > 50])
    assert imatch.likeness("", "") == 1.0 and imatch.likeness("aaaaaaaa--------", "aaaaaaaabbbbbbbb") == 0.5


def test_imatch_ranges(spark, docs, brute_rows, monkeypatch):
    """Many ranges, some of which begin or end inside a run of one doc_id, give every row the next that the order gives."""
    more = [(i, t or "") for i, t, *_ in brute_rows] + [(77, f"same id {k}") for k in range(30)] + [(None, f"none {k}") for k in range(20)] + [(2**62 + 1, "far"), (-(2**62), "low")]
    frame = common.saved(spark.createDataFrame(more, "doc_id long, text string"), "more")
    key = {r["text"]: r["k"] for r in frame.select("text", common.row_key().alias("k")).collect()}
    own = sorted(more, key=lambda r: (r[0] is None, -(r[0] or 0), key[r[1]]))
    expected = bag((i, imatch.edited(t, own[(k + 1) % len(own)][1])) for k, (i, t) in enumerate(own))
    for rows, most in ((1_000_000, 10), (7, 1_000), (3, 9)):
        monkeypatch.setattr(imatch, "RANGE_ROWS", rows)
        monkeypatch.setattr(imatch, "MOST_RANGES", most)
        assert bag((r["doc_id"], r["edited"]) for r in imatch.compared(frame).collect()) == expected
        assert len(imatch.neighbour_ranges(common.keyed(frame, "doc_id", "text"), rows, most)) <= most


def brute_imatch(texts):
    """Fingerprints by plain sets and whole numbers."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    df = collections.Counter(w for t in texts for w in set(words(t)))
    band = {w for w, n in df.items() if imatch.LOW * len(texts) <= n <= imatch.HIGH * len(texts)}
    rates = [rate for rate, n in imatch.RATES for _ in range(n)]
    out = []
    for t in texts:
        terms = sorted(xxhash.xxh64_intdigest(w.encode()) for w in set(words(t)) & band)
        parts = [[h for h in terms if mix(h ^ (0x9E3779B97F4A7C15 * (k + 1) & mask)) >> (64 - rate) == 0] for k, rate in enumerate(rates)] + [terms]
        out.append("".join(f"{xxhash.xxh32_intdigest(b''.join(h.to_bytes(8, 'little') for h in own), k):08x}" if own else imatch.EMPTY for k, own in enumerate(parts)))
    return out


def test_imatch_fingerprints(docs, brute_rows):
    expected = bag((i, f) for (i, *_), f in zip(brute_rows, brute_imatch([r[1] for r in brute_rows]), strict=True))
    assert bag((r["doc_id"], r["fingerprint"]) for r in imatch.fingerprints(docs).collect()) == expected


def test_exact_dedup(docs, brute_rows):
    out = cuckoo_dedup.exact_dedup(docs).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in brute_rows:
        groups[hashlib.sha256(lower(t).encode()).digest()].append(i)
    top = {d: max((i for i in ids if i is not None), default=None) for d, ids in groups.items()}
    assert bag((r["doc_id"], r["keep_id"], r["group_size"]) for r in out) == bag((i, top[d], len(ids)) for d, ids in groups.items() for i in ids)
    kept = [bytes(r["digest"]) for r in out if r["kept"]]
    assert len(kept) == len(set(kept)) == len(groups)
    assert cuckoo_dedup.without_copies(docs).count() == len(groups) and cuckoo_dedup.without_copies(docs).columns == docs.columns


def brute_packing(groups, shards, buckets, bucket_of):
    """Two rounds of the rule in plain Python: (size, tokens, n) by digest, the shard of each digest."""
    total = [max(1, sum(g[k] for g in groups.values())) for k in range(3)]
    share = {d: max(g[k] / total[k] for k in range(3)) for d, g in groups.items()}

    def pack(items, own_share):
        left, out = np.ones((shards, 3)), {}
        for name, load in items:
            own = own_share(np.array(load, float))
            out[name] = at = int(np.argmax(left @ own))
            left[at] -= own
        return out

    large = {d for d in groups if share[d] * shards * vector_packing.LARGE > 1}
    bins, at = collections.defaultdict(lambda: [0, 0, 0]), {}
    for b in range(buckets):
        own = sorted((d for d in groups if d not in large and bucket_of[d] == b), key=lambda d: (-share[d], d))
        for d, k in pack([(d, groups[d]) for d in own], lambda x: x / (np.array(total, float) / (shards * buckets))).items():
            at[d] = b, k
            bins[b, k] = [x + y for x, y in zip(bins[b, k], groups[d], strict=True)]
    items = [((b"", *k), v) for k, v in bins.items()] + [((d, -1, -1), groups[d]) for d in large]
    items.sort(key=lambda x: x[0])
    items.sort(key=lambda x: -max(x[1][k] / total[k] * shards for k in range(3)))
    placed = pack(items, lambda x: x / np.array(total, float) * shards)
    return {d: placed[(d, -1, -1) if d in large else (b"", *at[d])] for d in groups}


def test_vector_packing_follows_the_rule(spark, monkeypatch):
    """Against plain Python, where most groups are packed in buckets and a few are large; equal texts stay together."""
    monkeypatch.setattr(vector_packing, "BUCKET_GROUPS", 700)
    r = random.Random(2)
    texts = [f"t{k} " + "ab cde " * r.randint(5, 60) for k in range(2_500)] + [f"large{k} " + "ab cde " * 900 for k in range(3)]
    own = [*enumerate(texts), *((10_000 + k, texts[k]) for k in range(200))]
    frame = spark.createDataFrame(own, "doc_id long, text string")
    out = vector_packing.shard_documents(frame, shards=3).collect()
    assert len(out) == len(own)
    for value in (lambda x: x["size"], lambda x: x["tokens"], lambda x: 1):
        held = [sum(value(x) for x in out if x["shard"] == s) for s in range(3)]
        assert max(held) < 1.02 * sum(held) / 3
    groups = collections.defaultdict(lambda: [0, 0, 0])
    for _, t in own:
        g = groups[hashlib.sha256(t.encode()).digest()]
        groups[hashlib.sha256(t.encode()).digest()] = [g[0] + len(t) + 8, g[1] + len(t.split()), g[2] + 1]
    buckets = -(-len(groups) // 700)
    keys = spark.createDataFrame([(bytearray(d),) for d in groups], "d binary").select("d", F.pmod(F.xxhash64("d"), F.lit(buckets)).alias("b")).collect()
    expected = brute_packing(groups, 3, buckets, {bytes(k["d"]): k["b"] for k in keys})
    text_of = dict(own)
    wrong = [x for x in out if expected[hashlib.sha256(text_of[x["doc_id"]].encode()).digest()] != x["shard"]]
    assert not wrong


def test_exact_dedup_merges_in_the_index(spark):
    """Copies come from several tasks and are merged by the buckets' indexes, not by a group-by before them."""
    own = [(k if k % 9 else None, hashlib.sha256(b"%d" % (k % 40 if k % 3 else 0)).digest()) for k in range(1_200)]
    rows = common.saved(spark.createDataFrame(own, "doc_id long, digest binary").repartition(4), "digests")
    found = cuckoo_dedup.index_groups(rows, 1_200)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    groups = collections.defaultdict(list)
    for i, d in own:
        groups[d].append(-1 if i is None else i)
    assert bag((bytes(r["digest"]), r["keep_id"], r["group_size"]) for r in found.collect()) == bag((d, max(g), len(g)) for d, g in groups.items())


def test_cuckoo_index():
    r, index, live = random.Random(1), cuckoo_dedup.CuckooIndex(4), {}
    for k in range(6_000):
        digest = hashlib.sha256(str(r.randint(0, 2_000)).encode()).digest()
        old = index.delete(digest)
        assert old == live.pop(digest, None)
        if r.random() < 0.6:
            index.insert(digest, k)
            live[digest] = k
    assert dict(index.items()) == live and len(index) == len(live) and index.resizes > 0
    assert all(index.maybe(d) and index.get(d) == v for d, v in live.items())
    assert index.get(hashlib.sha256(b"absent").digest()) is None
    assert sum(map(len, index.marks)) == len(live)


def test_cuckoo_hits_are_verified():
    """Digests with one fingerprint and place hit the filter; only the stored digest tells them apart."""
    index, own = cuckoo_dedup.CuckooIndex(64), [bytes(10) + bytes([k]) * 22 for k in range(3)]
    index.insert(own[0], "a")
    assert index.maybe(own[1]) and index.get(own[1]) is None and index.delete(own[1]) is None
    index.insert(own[1], "b")
    assert index.delete(own[0]) == "a" and index.get(own[0]) is None and index.get(own[1]) == "b"


def test_exact_dedup_goes_through_the_filter(spark, monkeypatch):
    """Where the filter knows nothing, copies from several tasks are not found: nothing beside it merges them."""
    own = [(k, hashlib.sha256(b"%d" % (k % 7)).digest()) for k in range(70)]
    rows = common.saved(spark.createDataFrame(own, "doc_id long, digest binary").repartition(3), "digests")
    sums = cuckoo_dedup.task_sums(rows).toArrow()
    index = cuckoo_dedup.CuckooIndex()
    monkeypatch.setattr(index, "maybe", lambda digest: False)
    for digest, top, n in zip(*(sums.column(c).to_pylist() for c in ("digest", "top", "n")), strict=True):
        assert index.delete(digest) is None
        index.insert(digest, (top, n))
    assert len(index) == sums.num_rows > 7 == cuckoo_dedup.index_groups(rows, 70).count()


def brute_fingerprint(text):
    ws = words(text)
    shingles = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                la, lb = label[a], label[b]
                if la != lb:
                    label = [min(la, lb) if x in (la, lb) else x for x in label]
    return label


def brute_wide(text):
    """Both fingerprints of the wide links, by plain sums."""
    ws = words(text)

    def majority(hashed):
        total = sum(w for _, w in hashed)
        return sum(1 << b for b in range(64) if 2 * sum(w for h, w in hashed if h >> b & 1) > total)

    own = majority([(xxhash.xxh64_intdigest(w.encode(), 42), 1 + math.log(n)) for w, n in collections.Counter(ws).items()]) if ws else 0
    shingles = [" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))] if ws else []
    return own, majority([(xxhash.xxh64_intdigest(s.encode(), 42), 1) for s in shingles])


def brute_wide_components(both):
    label = list(range(len(both)))
    for a in range(len(both)):
        for b in range(a):
            if (both[a][0] ^ both[b][0]).bit_count() <= 5 and (both[a][1] ^ both[b][1]).bit_count() <= 15 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


def edited_copies(r, n=60):
    """Texts, and of each some copies with a few words changed; all others share nothing but common words."""
    vocabulary, out = [f"w{k}" for k in range(3_000)] + ["the", "of", "and", "to"] * 150, []
    for k in range(n):
        base = r.choices(vocabulary, k=r.randint(120, 400))
        out.append((k, base))
        for _ in range(r.randint(0, 3)):
            own = list(base)
            for at in r.sample(range(len(own)), max(1, len(own) // 60)):
                own[at] = r.choice(vocabulary)
            out.append((k, own))
    return [(k, " ".join(ws)) for k, ws in out]


def test_wide_links(spark, docs, brute_rows):
    """Components of the wide links against all pairs, on awkward rows and on edited copies."""
    own = [(i, t or "") for i, t, *_ in brute_rows] + [(1_000 + k, t) for k, (_, t) in enumerate(edited_copies(random.Random(1), 30))]
    both = [brute_wide(t) for _, t in own]
    label = brute_wide_components(both)
    least = {}
    for (i, _), c in zip(own, label, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    out = golay_simhash.similar(spark.createDataFrame(own, "doc_id long, text string").repartition(3)).collect()
    assert bag((r["doc_id"], r["component_id"]) for r in out) == bag((i, least[c]) for (i, _), c in zip(own, label, strict=True))
    assert sum(r["stays"] for r in out) >= len(set(label))


def test_wide_links_find_near_copies():
    """Of pairs that share four fifths of their 5-word shingles at least nine in ten are linked, and no others that share less than a third."""
    own = edited_copies(random.Random(2), 150)
    shingled = [{" ".join(ws[k : k + 5]) for k in range(len(ws) - 4)} for ws in (words(t) for _, t in own)]
    both = [(golay_simhash.word_simhash(t.encode()), golay_simhash.simhash(t.encode(), 5)) for _, t in own]
    near, linked = set(), set()
    for a in range(len(own)):
        for b in range(a):
            share = len(shingled[a] & shingled[b]) / len(shingled[a] | shingled[b])
            if share >= 0.8:
                near.add((a, b))
            if (both[a][0] ^ both[b][0]).bit_count() <= 5 and (both[a][1] ^ both[b][1]).bit_count() <= 15:
                linked.add((a, b))
                assert share > 1 / 3
    assert len(near) > 60 and len(near & linked) >= 0.9 * len(near)


def test_wide_keys_meet():
    """Fingerprints within five bits have a key in common."""
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(300)]
    near = [f ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for f in base]
    rows, keys = golay_simhash.wide_keys(np.array(base + near, np.uint64).view(np.int64))
    held = collections.defaultdict(set)
    for row, key in zip(rows.tolist(), keys.tolist(), strict=True):
        held[row].add(key)
    assert all(held[k] & held[len(base) + k] for k in range(len(base))) and keys.max() < 1 << 31


def test_near_dedup(docs, brute_rows):
    out = golay_simhash.near_dedup(docs).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in brute_rows]
    label = brute_components(fps)
    least = {}
    for (i, *_), c in zip(brute_rows, label, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    expected = bag((i, f - (f >> 63 << 64), least[c]) for (i, *_), f, c in zip(brute_rows, fps, label, strict=True))
    assert bag((r["doc_id"], r["fp"], r["component_id"]) for r in out) == expected
    assert golay_simhash.without_near_copies(docs).count() == len(set(label))


def test_golay_decodes_three_errors():
    r = np.random.default_rng(2)
    word = r.integers(0, 1 << 23, 2_000)
    index = golay_simhash.codeword_index(word)
    assert index.max() < 1 << 12
    codes = np.unique(golay_simhash.codeword_index(np.arange(1 << 18)) )
    assert len(codes) <= 4_096
    flip = word.copy()
    errors = golay_simhash._syndrome_errors()[golay_simhash._syndrome(word)]
    assert (np.bitwise_count(errors) <= 3).all() and (golay_simhash._syndrome(flip ^ errors) == 0).all()


def test_all_links_within_two_bits_share_a_key(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(150)]
    fps = set(base)
    for f in base:
        for _ in range(3):
            a, b = r.sample(range(64), 2)
            fps |= {f ^ (1 << a), f ^ (1 << a) ^ (1 << b)}
    fps = sorted(fps)
    signed = [f - (f >> 63 << 64) for f in fps]
    edges = golay_simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {x["node"]: x["root"] for x in golay_simhash.components(edges).collect()}
    mine = collections.defaultdict(set)
    for f in signed:
        mine[roots.get(f, f)].add(f)
    brute = collections.defaultdict(set)
    for f, c in zip(signed, brute_components(fps), strict=True):
        brute[c].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, brute.values()))


def test_dense_buckets_are_dealt(monkeypatch):
    r = random.Random(4)
    center = r.getrandbits(64)
    fps = np.unique(np.array([center ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(700)], np.uint64))
    whole = golay_simhash.forest(fps)
    monkeypatch.setattr(golay_simhash, "DENSE", 40)
    assert (golay_simhash.forest(fps) == whole).all()
    assert (whole == brute_components([int(f) for f in fps])).all()


def test_boundary_bpe(docs, brute_rows):
    library = Tokenizer.from_file(BPE)
    own = [(i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in brute_rows]
    expected = bag((i, ids, library.decode(list(ids), skip_special_tokens=False)) for i, ids in own)
    assert bag((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in boundary_bpe.encoded(docs, BPE).collect()) == expected


def test_forced_boundaries_and_word_encoder_agree_with_the_library(monkeypatch):
    r, library, bpe, encoder = random.Random(7), Tokenizer.from_file(BPE), boundary_bpe.BoundaryBpe(BPE), token_orc.encoder_of(BPE)
    alphabet = "abcdefghijklmnop'sSTtrRvVe1239-_=%$#é ßüñ́日Ωı\n\t😀"
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(1_500)] + ["=" * 500, "ab" * 400, "ſ K ẞ", "One, TWO. three; it's, 4: x?! (no), é, a's. <|STARTOFTEXT|> end.", "<|endoftext|>, <|EndOfText|>."]
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.encode(t.encode()).tolist() for t in texts] == wanted
    monkeypatch.setattr(word_pieces, "BLOCK_BYTES", 16)
    assert [bpe.words.encode_long(t.encode()).tolist() for t in texts] == wanted
    ids, bounds = encoder.encode([t.encode() for t in texts], 2)
    assert [ids[a : b - 1].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == wanted
    assert bpe.piece_ids([b"a", b"zq"])[1].sum() == len(bpe.piece_ids([b"a", b"zq"])[0])


KINDS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, enough) in enumerate(KINDS) for m in p.finditer(text or "") if enough(m))


def test_secret_spans(docs, brute_rows):
    names = [k for k, *_ in KINDS]
    out = secret_dfa.secret_spans(docs).collect()
    expected = bag((i, tuple((KINDS[k][0], a, b) for a, k, b in brute_spans(t))) for i, t, *_ in brute_rows)
    assert bag((r["doc_id"], tuple(tuple(s) for s in r["spans"] if s["kind"] in names)) for r in out) == expected
    assert sum(len(x[1]) for x in expected) >= 4


def test_automaton_against_regex():
    r, scanner = random.Random(11), secret_dfa.scanner_of(secret_dfa.RULES)
    parts = ["token", "PassWord", "secret", "api_key", "apikey", "=", ": ", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "x", "é", "-----BEGIN RSA PRIVATE KEY-----", "ghp_abcdefghijklmnopqrst", "\n", "aaaaaa"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(3_000)] + ["token=" + "a" * 5_000, "f" * 4_096 + "token: " + "b" * 40]
    spans = scanner.spans([t.encode() for t in texts])
    names = [k for k, *_ in KINDS]
    for t, own in zip(texts, spans, strict=True):
        assert [(a, names.index(n), b) for n, a, b in own if n in names] == brute_spans(t)
        assert [(a, b) for n, a, b in own if n == "pem"] == [m.span() for m in re.finditer(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", t)]
        assert [(a, b) for n, a, b in own if n == "forge"] == [m.span() for m in re.finditer(r"gh[oprsu]_[A-Za-z0-9]{20,}", t)]


def test_language_id(spark):
    r = random.Random(8)
    vocabulary = {"en": "the of and that with from this water house green".split(), "de": "der die und nicht wasser haus grün über straße".split(), "fr": "le les des été où maison vert avec être".split()}
    rows = [(k, " ".join(r.choices(vocabulary[lang], k=12)), lang) for k in range(400) for lang in [("en", "de", "fr")[k % 3]]]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !!", "de"), (903, "LE LES DES", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = ppm_langid.train(docs)
    out = {x["doc_id"]: x["l"] for x in docs.select("doc_id", ppm_langid.language_column(spark, trees).alias("l")).collect()}
    held = [(k, lang) for k, _, lang in rows if k < 900 and crc(k) % 4 == 2]
    assert held and np.mean([out[k]["lang"] == lang for k, lang in held]) > 0.97
    assert [out[k]["lang"] for k in (900, 901, 902, 903)] == ["und", "und", "und", "fr"]
    assert all(0 <= x["score"] <= 1 for x in out.values())
    assert {x["doc_id"] for x in ppm_langid.recognised(docs, trees).collect()} == {k for k, *_ in rows} - {900, 901, 902}


def test_code_lengths_are_those_of_escaping():
    """Against a plain recursive version on small training texts of two languages; all 256 bytes are symbols."""
    texts = {"a": b"abracadabra arcade \xc3\xa9t\xc3\xa9", "b": b"barbara said 12 \xd0\xb4\xd0\xb0"}
    chains = {lang: collections.Counter(ppm_langid.text_codes(t).tolist()) for lang, t in texts.items()}
    rows = [(lang, c, n) for lang, own in chains.items() for c, n in own.items()]
    trees = ppm_langid.fitted(pa.table({"lang": [r[0] for r in rows], "code": [r[1] for r in rows], "n": [r[2] for r in rows]}))
    assert trees.langs == ["a", "b"]

    def bits(lang, context, s):
        grams = collections.Counter()
        for c, n in chains[lang].items():
            chain = tuple(c.to_bytes(4, "big"))
            if chain[3 - len(context) : 3] == context:
                grams[chain[3]] += n
        total, kinds = sum(grams.values()), len(grams)
        if grams[s]:
            return math.log2((total + kinds) / grams[s])
        rest = bits(lang, context[1:], s) if context else 8.0
        return (math.log2((total + kinds) / kinds) if total else 0.0) + rest

    def folded(text):
        return bytes(32 if 9 <= b <= 13 else 48 if 48 <= b <= 57 else b for b in text.lower())

    scorer, said = ppm_langid.Scorer(trees), [b"a", b"Arcade was 7 bars", b"\xc3\xa9 \xd0\xb4\xd0\xb0 zzz", b"\xff\x00 qabra", b""]
    for text, own in zip(said, scorer.bits(said), strict=True):
        chain = b"   " + folded(text)
        for lang, total in zip("ab", own, strict=True):
            assert math.isclose(total, sum(bits(lang, tuple(chain[k : k + 3]), chain[k + 3]) for k in range(len(text))), rel_tol=1e-5)
    long = b"barbara arcade " * 900
    whole = scorer.bits([long, b"x", long])
    ppm_langid_block, ppm_langid.BLOCK = ppm_langid.BLOCK, 1
    assert np.allclose(scorer.bits([long, b"x", long]), whole)
    ppm_langid.BLOCK = ppm_langid_block


def test_empty_tables(spark, nothing):
    assert deleted_interpolation.scores(nothing).count() == 0
    path = common.shared_path(spark, "empty")
    token_orc.write_tokens(nothing, path, BPE)
    assert token_orc.checksums(spark, path).count() == 0
    assert vector_packing.shard_documents(nothing).count() == 0
    assert mixing.mixed(nothing).count() == 0 and mixing.emitted(nothing).count() == 0
    assert imatch.compared(nothing).count() == 0
    assert cuckoo_dedup.exact_dedup(nothing).count() == 0 and cuckoo_dedup.without_copies(nothing).count() == 0
    assert golay_simhash.near_dedup(nothing).count() == 0 and golay_simhash.without_near_copies(nothing).count() == 0
    assert boundary_bpe.encoded(nothing, BPE).count() == 0
    assert secret_dfa.secret_spans(nothing).count() == 0
    assert ppm_langid.recognised(nothing, ppm_langid.train(nothing)).count() == 0


def test_packing_of_integers():
    r = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.array([0], np.uint64), r.integers(0, 1 << 63, 1_000).astype(np.uint64), np.array([(1 << 64) - 1], np.uint64)):
        assert (common.unpack(common.pack(values)) == values).all()
        assert (common.unpack_sorted(common.pack_sorted(np.sort(values))) == np.sort(values)).all()


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    """In bytes, and never a long word; what is forgotten is encoded alike again."""
    r, library = random.Random(3), Tokenizer.from_file(BPE)
    bpe = boundary_bpe.BoundaryBpe(BPE)
    bpe.words.memo.most = 40_000
    for _ in range(40):
        text = " ".join("".join(r.choices("abcdeé'1", k=r.randint(1, 9))) for _ in range(200)) + " " + "xyz" * 100
        assert bpe.words.encode([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        memo = bpe.words.memo
        assert memo.held <= 20_000 and max(map(len, [*memo.young, *memo.old]), default=0) <= word_pieces.LONGEST_KEY
    bpe.words.forget()
    assert not memo.young and not memo.old


def test_pieces_are_encoded_once():
    """Whatever stands around a piece, also in another text or call."""
    library, own, asked = Tokenizer.from_file(BPE), token_orc.library_pieces(BPE), []
    encoder = word_pieces.WordPieces(BPE, lambda pieces: (asked.extend(pieces), own(pieces))[1])
    texts = ["word word, (word) Word's 'word' $$ word$$.", "[word] été ÉTÉ! «été»", "", " \n", "état,été 日本 word日本"]
    for part in (texts[:3], texts[3:], texts):
        ids, bounds = encoder.encode([t.encode() for t in part], 2)
        assert [ids[a : b - 1].tolist() for a, b in itertools.pairwise(bounds)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
    here = [p for p in asked if "日".encode() not in p]
    assert len(here) == len(set(here)) and {b"word", "été".encode(), b"$$"} <= set(here)


def test_control_characters_are_encoded_as_the_library_does():
    library, encoder = Tokenizer.from_file(BPE), token_orc.encoder_of(BPE)
    texts = ["a\x00b", "\x01 \x1f\x1c end", "one\x7ftwo, \x85\xa0x"]
    for t in texts:
        assert encoder.encode([t.encode()])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_blocks_give_what_whole_texts_give(monkeypatch):
    """Blocks of a few texts, numbered together or not, texts longer than a block, null texts, several batches."""
    r, library, encoder = random.Random(2), Tokenizer.from_file(BPE), token_orc.encoder_of(BPE)
    texts = [" ".join("".join(r.choices("abé'1,", k=r.randint(1, 6))) for _ in range(r.choice([0, 3, 30, 90]))) for _ in range(120)] + [None, ""]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array(texts[a:b], pa.string())], schema=schema) for a, b in ((0, 50), (50, 50), (50, len(texts)))]
    wanted = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    monkeypatch.setattr(word_pieces, "AT_ONCE", 7)
    for block, shared in ((200, 500), (1, 1), (1 << 20, 1 << 20)):
        monkeypatch.setattr(word_pieces, "BLOCK_BYTES", block)
        monkeypatch.setattr(word_pieces, "SHARED_BYTES", shared)
        found = [(i, ids[a:b].tolist()) for rows, ids, bounds in word_pieces.encoded_blocks(batches, "text", encoder, 2) for i, (a, b) in zip(rows.column(0).to_pylist(), itertools.pairwise(bounds), strict=True)]
        assert found == [*enumerate(wanted)]


def test_cuts_are_certain():
    """No token holds two symbols between which a cut is made; uncut merging gives the same ids."""
    r, bpe = random.Random(5), boundary_bpe.BoundaryBpe(BPE)
    pieces = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(1, 45))).encode() for _ in range(400)]
    ids, lens = bpe.piece_ids(pieces)
    at = 0
    for piece, n in zip(pieces, lens.tolist(), strict=True):
        symbols = np.frombuffer(piece, np.uint8).astype(np.int16)
        symbols[-1] += 256
        assert bpe.merges.merged_long(bpe.alone[symbols].tolist()) == ids[at : at + n].tolist()
        at += n
