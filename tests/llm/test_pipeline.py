"""The pipeline against a brute-force version, stage by stage and as a whole."""

import collections
import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from strataloom.llm import mixing, ppm_langid, queries, sql
from test_llm_operators import brute_targets, brute_wide, brute_wide_components, lower, words


def test_stages_follow_each_other():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run(spark, docs, brute_rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    scorer = ppm_langid.Scorer(ppm_langid.train(docs))
    bits = scorer.predict([(r[1] or "").encode() for r in brute_rows])
    rows = [r for r, (_, _, b) in zip(brute_rows, bits, strict=True) if re.search(r"[^\W\d_]", r[1] or "") and b < 8]
    newest = {}
    for r in rows:
        key = lower(r[1])
        if key not in newest or (r[0] is not None and (newest[key][0] is None or r[0] > newest[key][0])):
            newest[key] = r
    rows = list(newest.values())
    label = brute_wide_components([brute_wide(r[1]) for r in rows])
    groups = collections.defaultdict(list)
    for r, c in zip(rows, label, strict=True):
        groups[c].append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = brute_targets(sizes)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = collections.Counter()
    for r in rows:
        rate = target[r[3]] / sizes[r[3]] if sizes[r[3]] else 0
        unit = int(hashlib.md5(f"{mixing.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        ids = library.encode(r[1], add_special_tokens=False).ids
        if copies := int(rate) + (unit < rate - int(rate)):
            expected[r[0], tuple(ids)] += copies
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in out) == expected


def test_columns_are_kept(spark, docs, brute_rows):
    """Other columns keep their names and values, also those that an operator might want for itself."""
    own = {r: None for r in brute_rows}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert all(tuple(r) in own for r in out.collect())


def test_empty_table(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "ids_sha256" in out.columns


def test_every_operator_has_a_query():
    own = queries.queries()
    assert [int(n[2:].split("_")[0]) for n in own] == list(range(1, 14))
    assert set(sql.oracle_sql()) <= set(own)
