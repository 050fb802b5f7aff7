"""Exact and near dedup against brute force, and on odd rows."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import exact_dedup, near_dedup, queries
from pagelake.llm.components import components, merged

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()


@pytest.mark.parametrize("fan_in", [2, 8])
def test_tree_of_runs_finds_every_group(spark, documents, texts, fan_in):
    runs = exact_dedup.digest_runs(documents.repartition(13))
    found = {r.proof.hex(): (r.keep_id, r.group_size) for r in exact_dedup.merge_runs(runs, "smallest", fan_in).collect()}
    groups = defaultdict(list)
    for doc_id, text in texts.items():
        groups[sha(text)].append(doc_id)
    assert found == {key: (min(ids), len(ids)) for key, ids in groups.items()}


def test_equal_digests_with_other_proofs_stay_apart(spark):
    rows = [(1, 7, b"x", 1, 0, 0), (2, 7, b"y", 1, 1, 1), (3, 7, b"x", 1, 2, 2)]
    runs = spark.createDataFrame(rows, "doc_id long, digest long, proof binary, size long, run int, row long")
    assert sorted((bytes(r.proof), r.keep_id, r.group_size) for r in exact_dedup.merge_runs(runs).collect()) == [(b"x", 1, 2), (b"y", 2, 1)]


def test_exact_dedup_of_odd_rows(odd, empty):
    rows = exact_dedup.exact_dedup(odd, "largest").collect()
    assert len(rows) == odd.count() and all(r.text_sha256 for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.text_sha256].append(r)
    assert all(sum(r.kept for r in group) == 1 and {r.group_size for r in group} == {len(group)} for group in by.values())
    assert {r.keep_id for r in by[sha("")]} == {2} and {r.keep_id for r in by[sha("same text here")]} == {6}
    assert {r.keep_id for r in by[sha("no id at all")]} == {None}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_dropping_copies_keeps_one_row_of_each_text(odd, empty):
    for drop in (exact_dedup.drop_exact_copies, near_dedup.drop_near_copies):
        kept = drop(odd)
        assert kept.columns == odd.columns
        assert Counter(sha(r.text) for r in kept.collect()) == Counter({sha(r.text) for r in odd.collect()})
        assert drop(empty).count() == 0


def brute_classes(docs):
    """Classes by comparing all pairs that share a shingle."""
    sampler = near_dedup.sampler_for(near_dedup.document_frequencies(near_dedup.shingle_sets(docs)))
    shingler, sets, holders = near_dedup.Shingler(), {}, defaultdict(list)
    for r in docs.collect():
        shingles, counts = shingler.shingles(shingler.word_hashes(r.text))
        sets[r.doc_id] = shingles, sampler.weights(shingles, counts)
        for s in shingles.tolist():
            holders[s].append(r.doc_id)
    pairs = {p for ids in holders.values() for p in itertools.combinations(sorted(ids), 2)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in sorted(pairs):
        if near_dedup.similarity(*sets[a], *sets[b]) >= near_dedup.SIMILARITY:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in sets}


def test_near_duplicates_lose_no_link(spark, documents):
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents).collect()} == brute_classes(documents)


def test_chains_and_crowded_buckets_are_settled(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWDED", 2)
    base = [f"w{k}" for k in range(200)]
    rows, n = [], 0
    for chain in range(6):  # each step changes some words, so ends of a chain are far apart
        words = [f"c{chain}{w}" for w in base]
        for step in range(8):
            rows.append((n, " ".join(words)))
            words = words[:]
            words[step * 20 : step * 20 + 6] = [f"s{chain}{step}{k}" for k in range(6)]
            n += 1
    shared = " ".join(f"p{k}" for k in range(150))
    for k in range(30):  # a passage that many share
        rows.append((n, shared + " " + " ".join(f"own{k}x{j}" for j in range(60 + k))))
        n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert found == brute_classes(docs)
    assert len(set(found[i] for i in range(48))) == 6


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert sum(r.kept for r in rows) == len({sha(r.text) for r in odd.collect()})
    assert near_dedup.near_duplicates(empty).count() == 0


def test_similarity_of_samples_follows_weighted_jaccard():
    import numpy as np

    draw = np.random.default_rng(5)
    sampler = near_dedup.Sampler(draw.random(near_dedup.DF_BUCKETS), bands=400, rows=1)
    a = np.unique(draw.integers(1 << 32, size=300, dtype=np.uint64).astype(np.uint32))
    b = np.unique(np.concatenate([a[:240], draw.integers(1 << 32, size=60, dtype=np.uint64).astype(np.uint32)]))
    wa, wb = sampler.weights(a, None), sampler.weights(b, None)
    same = (sampler.samples(a, wa) == sampler.samples(b, wb)).mean()
    assert abs(same - near_dedup.similarity(a, wa, b, wb)) < 0.08


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 107), (101, 107), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {107: 100, 101: 100}
    assert components(edges.where("1 = 0")).count() == 0
    parts = components(edges.where("a % 2 = 0"))
    assert {r.node: r.root for r in merged(parts, edges.where("a % 2 = 1")).collect()} == found


def test_registered_columns(spark):
    assert queries.op9_near_dedup(spark, "/root/testdata/sf0.001").columns == ["doc_id", "class_id", "class_size", "kept"]


def test_crowd_pairs_leave_out_no_similar_pair(spark):
    """A thousand rows of one crowded bucket: texts around a passage, pairs of them near the threshold. Every similar
    pair meets, and few others do."""
    rng = np.random.default_rng(11)
    passage = [f"p{k}" for k in range(120)]
    texts = []
    for k in range(500):
        own = [f"q{k}x{j}" for j in range(int(rng.integers(20, 90)))]
        texts.append(passage + own)
        edited = [w if rng.random() > 0.018 else f"e{k}x{j}" for j, w in enumerate(passage + own)]
        texts.append(edited)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sampler = near_dedup.sampler_for(near_dedup.document_frequencies(near_dedup.shingle_sets(docs)))
    rows = near_dedup.shingle_sets(docs)
    by_row = {r.row: r for r in rows.collect()}
    weighted = {}
    for k, r in by_row.items():
        shingles = np.frombuffer(r.shingles, "<u4")
        weighted[k] = shingles, sampler.weights(shingles, None if r.times is None else np.frombuffer(r.times, "<u4"))
    met = {tuple(r) for r in near_dedup.crowd_pairs(rows, rows.select("row", F.col("row").alias("own")), sampler, 0.8).collect()}
    similar = {p for p in itertools.combinations(sorted(weighted), 2) if near_dedup.similarity(*weighted[p[0]], *weighted[p[1]]) >= 0.8}
    close = [p for p in similar if near_dedup.similarity(*weighted[p[0]], *weighted[p[1]]) < 0.83]
    assert similar <= met and len(close) > 20 and len(met) < 20_000
