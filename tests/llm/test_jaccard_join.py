"""The size-aware join against every pair of sets."""

import random
from collections import defaultdict
from pathlib import Path

import pytest

from pagelake.llm import jaccard_join as join
from pagelake.plans import reuse


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    lists = defaultdict(list)
    for k, s in enumerate(sets):
        for shingle in s:
            lists[shingle].append(k)
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = {(a, b) for members in lists.values() for i, a in enumerate(members) for b in members[i + 1 :]}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            root[top(b)] = top(a)
    ids = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[top(k)].append(doc_id)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    return sorted(((d, len(sets[k]), min(ids[top(k)], default=None)) for k, (d, _) in enumerate(rows)), key=key)


def found(df):
    rows = [tuple(r) for r in join.jaccard_join(df).select("doc_id", "n_shingles", "component_id").collect()]
    return sorted(rows, key=lambda r: tuple(-1 if x is None else x for x in r))


def test_documents(spark, documents, texts):
    assert found(documents) == plain(list(texts.items()))


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def clusters():
    """Groups of edited texts of many sizes around the threshold, and unlike texts around common passages."""
    rng, rows = random.Random(7), []
    for size in [5, 6, 7, 9, 11, 14, 17, 20, 23, 26, 30, 45, 80, 200]:
        for _ in range(6):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size + 4)]
            for _ in range(5):
                start, stop = rng.randrange(3), len(base) - rng.randrange(3)
                rows.append(" ".join(edited(rng, base[start:stop], rng.randrange(1 + size // 25 + (rng.random() < 0.3)))))
                if rng.random() < 0.5:
                    rows.append(" ".join(base + [f"x{rng.randrange(9)}" for _ in range(rng.randrange(1 + size // 5))]))
    passage = [f"p{k}" for k in range(60)]
    for k in range(150):
        own = [f"q{rng.randrange(10**6)}" for _ in range(rng.choice([2, 6, 10, 13, 14, 15, 20, 60]))]
        rows.append(" ".join(own + passage if k % 2 else edited(rng, passage, k % 3) + own))
    lines = [" ".join(f"l{k}_{j}" for j in range(8)) for k in range(12)]
    rows += ["\n".join(rng.sample(lines, rng.randrange(1, 10))) for _ in range(150)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("light", [None, 0, 9, 24])
def test_clusters(spark, clusters, monkeypatch, light):
    """Alike wherever the bound between light and heavy sets lies."""
    if light is not None:
        monkeypatch.setattr(join, "light_bound", lambda sets, spots: light)
    df = spark.createDataFrame(clusters, "doc_id long, text string").repartition(6)
    expected = plain(clusters)
    assert found(df) == expected
    assert 100 < len({r[2] for r in expected}) < len(clusters) - 200


def test_order_does_not_matter(spark, clusters, monkeypatch):
    """Without frequencies and further leaders the links are the same."""
    monkeypatch.setattr(join, "frequency_sketch", lambda docs: join.np.zeros(join.PLACES * join.COUNTERS, join.np.int64))
    monkeypatch.setattr(join, "LEADERS", 1)
    assert found(spark.createDataFrame(clusters, "doc_id long, text string")) == plain(clusters)


def test_needed():
    for a in range(1, 60):
        for b in range(a, 60):
            least = next(t for t in range(2 * b + 1) if 100 * t >= 80 * (a + b - t))
            assert join.needed(a, b) == least
        assert join.entering(a) == a - -(-4 * a // 5) + 1
        assert join.subsets(a, 24) == sum(len(join.left_out(a, join.needed(*p))) for p in join.size_pairs(a, 24)) if a <= 24 else True


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(odd) == plain(rows)
    assert found(empty) == []


@pytest.mark.parametrize("long", [1_000_000, 4])
def test_lists(spark, clusters, monkeypatch, long):
    """Every list with several entries, whole, with its most central entry; long lists apart from the others."""
    monkeypatch.setattr(join, "LONG_LIST", long)
    monkeypatch.setattr(join, "SAMPLED", 1)
    monkeypatch.setattr(join, "BUCKET_ENTRIES", 50)
    monkeypatch.setattr(join, "DEALT_AT_ONCE", 70)
    df = spark.createDataFrame(clusters, "doc_id long, text string").repartition(3)
    sets = join.led_sets(df, join.frequency_sketch(df)).where("n > 0").select("row", "n", "lead")
    lists = defaultdict(list)
    for row, n, lead in sets.collect():
        for pos, token in enumerate(lead[: join.entering(n)]):
            lists[token].append((n <= join.MOST_LIGHT, pos, row, n))
    wanted = {(token, row, n, pos, min(x)[1:]) for token, x in lists.items() if len(x) > 1 for _, pos, row, n in x}
    rows = [(r.token, r.row, r.n, r.pos, tuple(r.x)) for r in join.listed(sets).collect()]
    assert set(rows) == wanted and len(rows) == len(wanted)
    assert any(len(x) > 4 for x in lists.values())


def test_long_lists_give_the_same(spark, clusters, monkeypatch):
    monkeypatch.setattr(join, "LONG_LIST", 4)
    monkeypatch.setattr(join, "SAMPLED", 1)
    assert found(spark.createDataFrame(clusters, "doc_id long, text string")) == plain(clusters)


def test_big_tables_are_removed_on_the_way(spark, clusters, monkeypatch):
    """Whole sets and leads are the bulk of the disk: neither stays after the step that reads it."""
    paths, real = [], reuse.scratch_path
    monkeypatch.setattr(reuse, "scratch_path", lambda *given: paths.append(real(*given)) or paths[-1])
    join.jaccard_join(spark.createDataFrame(clusters, "doc_id long, text string")).count()
    name = lambda path: Path(path).name.rsplit("-", 1)[0]
    left = {name(path) for path in paths if Path(path).exists()}
    assert {"led-sets", "whole-sets"} <= {name(path) for path in paths} and "lists" in left
    assert not left & {"led-sets", "shared-shingles", "close-pairs", "wanted-sets", "whole-sets"}
