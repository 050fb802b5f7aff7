"""Sharding and packing: laws, exact round trips, brute force."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagelake.llm import packing, queries, shared, sharding


def test_ring_places_rows_as_one_by_one():
    """The filling by arcs gives each shard what rows walking one after another would."""
    points, owners = sharding.ring_points(5, 16)
    draw = np.random.default_rng(1)
    arcs = np.sort(draw.integers(len(points), size=3000))
    counts = np.bincount(arcs, minlength=len(points))
    capacity = sharding.capacities(3000, 5, 0.05)
    pieces = sharding.fill_clockwise(owners, counts, capacity)
    assert sum(n for _, _, n, _ in pieces) == 3000
    room, left = capacity.copy(), counts.copy()
    placed = {}
    for hop in range(5):
        for arc in range(len(points)):
            tour = list(dict.fromkeys(np.roll(owners, -arc).tolist()))
            take = min(left[arc], room[tour[hop]])
            left[arc] -= take
            room[tour[hop]] -= take
            if take:
                placed[arc, tour[hop]] = placed.get((arc, tour[hop]), 0) + take
    assert {(a, s): n for a, _, n, s in pieces} == placed
    for arc in np.flatnonzero(counts):
        mine = [(first, n) for a, first, n, _ in pieces if a == arc]
        assert [f for f, _ in mine] == np.cumsum([0, *[n for _, n in mine]])[:-1].tolist()


def test_one_more_shard_moves_few_rows():
    keys = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, size=20_000, dtype=np.int64)

    def owner(shards):
        points, owners = sharding.ring_points(shards)
        arcs = np.searchsorted(points, np.sort(keys)) % len(points)
        pieces = sharding.fill_clockwise(owners, np.bincount(arcs, minlength=len(points)), sharding.capacities(len(keys), shards, 0.1))
        out = np.empty(len(keys), int)
        order = np.argsort(arcs, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(arcs, minlength=len(points)))])
        for arc, first, n, shard in pieces:
            out[order[starts[arc] + first : starts[arc] + first + n]] = shard
        return out

    assert (owner(8) != owner(9)).mean() < 0.35


@pytest.mark.parametrize("slices", [250_000, 7])
def test_shards_are_even_and_slots_gapless(spark, documents, odd, empty, monkeypatch, slices):
    monkeypatch.setattr(shared, "ROWS_PER_SLICE", slices)
    for docs in (documents, odd):
        rows = sharding.shard_documents(docs, 8).collect()
        texts = sorted((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert sorted((r["size"], r.text_crc32) for r in rows) == texts
        slots = [sorted(r.slot for r in rows if r.shard == s) for s in range(8)]
        assert max(map(len, slots)) - min(map(len, slots)) <= 1 and all(x == list(range(len(x))) for x in slots)
    assert sharding.shard_documents(empty, 8).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_word_wise_encoding_equals_the_tokenizer(tokenizer, texts):
    plain = packing.encoder(**{k.replace("tokenizer_", ""): v for k, v in queries.vocabulary().items() if k == "tokenizer_path"})
    fast = packing.encoder(queries.vocabulary()["tokenizer_path"], *queries.vocabulary()["ranks"])
    odd = ["", " ", "a  b", "\n a", "a \n b\n\n  c", " lead", "x\t y", "é  b", "tail  \n", "　 q\u2003 r", "hi<|endoftext|> you <|endoftext|>", "a\x1c b\x85 c", "it's 1,000.5 'll", "a" * 3000, "don't\u00a0 stop "]
    for text in [*odd, *list(texts.values())[:60]]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(plain(text), "<u4").tolist() == want, text[:40]
        assert np.frombuffer(fast(text), "<u4").tolist() == want, text[:40]


def test_packing_is_an_exact_round_trip(spark, documents, odd, empty, tokenizer):
    for docs in (documents, odd):
        rows = packing.pack_documents(docs, **queries.vocabulary()).collect()
        want = []
        for r in docs.collect():
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
            cut = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
            cut = cut if cut[-1] == len(ids) else [*cut, len(ids)]
            want += [(r.doc_id is None, r.doc_id or 0, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
        assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
        sequences = {}
        for r in rows:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 1024
        bound = -(-sum(r.length for r in rows) // 1024)
        large = sum(r.length > 512 for r in rows)
        assert len(sequences) <= 1.02 * max(bound, large) + 2
    assert packing.pack_documents(empty, **queries.vocabulary()).count() == 0


def test_configurations_are_best_and_near_the_bound():
    draw = np.random.default_rng(4)
    values = np.concatenate([[0], draw.random(12)])
    best = packing.best_configuration(values, 12)

    def brute(room, top):
        return max((values[n] + brute(room - n, n) for n in range(1, min(room, top) + 1)), default=0.0)

    assert np.isclose(best @ values, brute(12, 12)) and best @ np.arange(13) <= 12
    histogram = np.zeros(1025, np.int64)
    np.add.at(histogram, np.minimum(1024, 1 + draw.gamma(1.2, 300, size=40_000).astype(int)), 1)
    plan = packing.packing_plan(histogram)
    used = np.zeros(1025, np.int64)
    for counts, times in plan:
        assert sum(n * c for n, c in counts.items()) <= 1024
        for n, c in counts.items():
            used[n] += c * times
    assert (used == histogram).all()
    bound = -(-int(histogram @ np.arange(1025)) // 1024)
    assert sum(times for _, times in plan) <= 1.01 * bound


def test_gapless_rank_splits_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_PER_SLICE", 100)
    rows = shared.numbered(spark.range(3000).select((F.col("id") % 3 * (F.col("id") % 2)).cast("int").alias("g")), "test")
    ranked, sizes = shared.gapless_rank(rows, "g")
    got = ranked.collect()
    for g, n in sizes.items():
        assert sorted(r["rank"] for r in got if r.g == g) == list(range(n))
