import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from pagelake.functions.sql import register
from pagelake.operators.cache import cached_flag
from pagelake.operators.extract import rule_extractor
from pagelake.sources.page_store import PageStore, write_page_store
from pagelake.sources.pages import PAGE_SCHEMA, load_page_stream
from pagelake.streaming.cached_flag import BucketLives, ResultLives, stream_cached_flag
from pagelake.streaming.cache_store import CacheStore, merged
from pagelake.streaming.extract import stream_extract
from pagelake.streaming.pages import stream_clean

T0 = datetime.datetime(2024, 1, 1)
LOG_SCHEMA = "key STRING, ts TIMESTAMP, request_id LONG"


def log_rows(rows):
    return [(key, T0 + datetime.timedelta(seconds=t), i) for key, t, i in rows]


def run_flags(spark, folder, batches, ttl, delay):
    """One micro-batch per list of rows; returns {request_id: cached}."""
    (folder / "in").mkdir()
    flagged = stream_cached_flag(spark.readStream.schema(LOG_SCHEMA).parquet(f"{folder}/in"), ttl, delay)
    for rows in batches:
        spark.createDataFrame(log_rows(rows), LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = (
            flagged.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return {r.request_id: r.cached for r in spark.read.schema(flagged.schema).parquet(f"{folder}/out").collect()}


def test_flags_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("aab"), t * 7, t) for t in range(120)]
    shuffled = sorted(rows, key=lambda row: row[1] + rng.randrange(0, 100))
    batches = [shuffled[i : i + 50] for i in range(0, 120, 50)] + [[("end", 10**6, -1)]]
    streamed = run_flags(spark, tmp_path, batches, 60, "200 seconds")
    batch = cached_flag(spark.createDataFrame(log_rows(rows), LOG_SCHEMA), 60)
    assert streamed == {r.request_id: r.cached for r in batch.collect()}


class MemoryState:
    """State kept in memory that tells which keys were read."""

    def __init__(self):
        self.held, self.read, self.timers = {}, [], []

    def getValueState(self, name, *schemas):
        return self.values.setdefault(name, MemoryState())

    getMapState = getValueState
    values = None

    def registerTimer(self, at):
        self.timers.append(at)

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        self.read.append(key)
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def iterator(self):
        return iter(list(self.held.items()))

    def exists(self):
        return () in self.held

    def get(self):
        return self.held[()]

    def update(self, value):
        self.held[()] = value

    def clear(self):
        self.held.clear()


class Moment:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_timer_reads_only_the_buckets_that_are_due():
    """Rows of any micro-batch order; a timer leaves later buckets unread, and labels equal those of a plain scan."""
    handle, second, ttl = MemoryState(), 1_000_000, 25
    handle.values = {}
    lives = ResultLives(ttl * second, 10 * second)
    lives.init(handle)
    rng = random.Random(4)
    rows = [(rng.randrange(0, 300), i) for i in range(200)]
    for k in range(0, 200, 23):
        part = pd.DataFrame({"at": [t * second for t, _ in rows[k : k + 23]], "request_id": [i for _, i in rows[k : k + 23]]})
        list(lives.handleInputRows(("a",), iter([part]), None))
    assert len(handle.timers) == 30 and all(at % 10_000 == 0 for at in handle.timers)
    waiting, found = handle.values["waiting"], {}
    for watermark in (5_000, 20_000, 120_000, 125_000, 400_000):
        waiting.read.clear()
        for frame in lives.handleExpiredTimer(("a",), Moment(watermark), Moment(watermark)):
            found |= {r.request_id: r.cached for r in frame.itertuples()}
        assert all((bucket + 1) * 10_000 <= watermark for bucket, _ in waiting.read)
        assert set(found) == {i for t, i in rows if (t // 10 + 1) * 10_000 <= watermark}
    want, ends = {}, None
    for t, i in sorted(rows):
        want[i] = ends is not None and t < ends
        ends = ends if want[i] else t + ttl
    assert found == want and not waiting.held and not handle.values["life"].held


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    batches = [[("a", 0, 1), ("a", 1000, 2)], [("a", 5, 3), ("a", 1001, 4)], [("end", 10**6, -1)]]
    assert run_flags(spark, tmp_path, batches, 100, "10 seconds") == {1: False, 2: False, 4: True}


def test_waiting_requests_cost_no_calls_to_the_state_store():
    """Whole buckets of a key are labelled with a few calls, however many they are; ids of any size stay, missing ones too."""
    second, ttl = 1_000_000, 25
    handle = MemoryState()
    handle.values = {}
    lives = BucketLives(ttl * second, 10 * second)
    lives.init(handle)
    rng = random.Random(5)
    rows = [(rng.randrange(0, 3000), i + 2**53) for i in range(500)] + [(7, None), (7, None)]
    want, ends = [], None
    for t, i in sorted(rows, key=lambda row: (row[0], row[1] is not None, row[1] or 0)):
        cached = ends is not None and t < ends
        ends = ends if cached else t + ttl
        want.append((t * second, i, cached))
    found, calls = [], len(handle.timers)
    for low, high in ((0, 1200), (1200, 3000)):
        part = [row for row in rows if low <= row[0] < high]
        rng.shuffle(part)
        frames = [
            pd.DataFrame({"at": [t * second for t, _ in some], "known": [i is not None for _, i in some], "request_id": [i or 0 for _, i in some]})
            for some in (part[:40], part[40:])
        ]
        for frame in lives.handleInputRows(("a",), iter(frames), Moment(high * 1000)):
            found += [(r.at, None if pd.isna(r.request_id) else r.request_id, r.cached) for r in frame.itertuples()]
    assert found == want
    assert len(handle.timers) - calls <= 2
    list(lives.handleExpiredTimer(("a",), Moment(10**7), Moment(10**7)))
    assert not handle.values["life"].held


SITE = "https://s.org"


def write_pages(spark, folder):
    rows = [(1, SITE + "/a", "<p>Alpha</p><a href='/b'>b</a>"), (2, SITE + "/b", "<p>Beta</p>" + "w" * 50)]
    spark.createDataFrame(rows, PAGE_SCHEMA).write.parquet(folder)
    return spark.read.parquet(folder)


def test_stream_clean(spark, tmp_path):
    write_pages(spark, str(tmp_path / "in"))
    cleaned = stream_clean(load_page_stream(spark, str(tmp_path / "in")), 10)
    query = cleaned.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    query.awaitTermination()
    found = {r.page_id: r.content for r in spark.table("cleaned").collect()}
    assert found[1] == f"Alphab\n\nLinks found on this page:\nb: {SITE}/b"
    assert found[2] == "Betawwwwww...\n[Content truncated]"


def test_stream_extract_uses_earlier_batches_only(spark, tmp_path):
    pages = write_pages(spark, str(tmp_path / "pages"))
    schema = {"type": "object", "properties": {"name": {"type": "string"}}, "required": ["name"]}
    incoming = "request_id LONG, url STRING, asked_at TIMESTAMP"

    def ask(*rows):
        spark.createDataFrame(list(rows), incoming).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream_extract(
            spark.readStream.schema(incoming).parquet(str(tmp_path / "in")), pages, schema, rule_extractor({"name": ("^([A-Z][a-z]+)", 1)}),
            str(tmp_path / "cache"), str(tmp_path / "results"), str(tmp_path / "log"),
        ).awaitTermination()

    ask((1, SITE + "/a", T0), (2, SITE + "/a", T0))
    ask((3, SITE + "/a", T0 + datetime.timedelta(hours=23)), (4, SITE + "/b", T0))
    ask((5, SITE + "/a", T0 + datetime.timedelta(hours=24)), (6, SITE + "/none", T0))
    rows = {r.request_id: r for r in spark.read.parquet(str(tmp_path / "results")).collect()}
    assert [rows[i].cached for i in (1, 2, 3, 4, 5)] == [False, False, True, False, False]
    assert rows[6].stage == "fetch" and rows[1].data == rows[3].data
    store = CacheStore(spark, str(tmp_path / "cache"))
    seen = [store.before(*at).count() for at in ((0, T0), (1, T0), (2, T0), (1, T0 + datetime.timedelta(hours=24)))]
    assert seen == [0, 1, 2, 0]


def test_stream_extract_with_merged_cache_and_store(spark, tmp_path):
    """A stream whose cache is merged between batches, over a page store, gives what one without gives."""
    table = write_pages(spark, str(tmp_path / "pages"))
    write_page_store(table, str(tmp_path / "store"), 4)
    schema = {"type": "object", "properties": {"name": {"type": "string"}}, "required": ["name"]}
    incoming = "request_id LONG, url STRING, asked_at TIMESTAMP"
    found = {}
    for name, pages, fan in (("plain", table, 100), ("merged", PageStore(spark, str(tmp_path / "store")), 2)):
        folder = tmp_path / name
        for k, hour in enumerate((0, 5, 23, 25, 26, 50)):
            rows = [(3 * k + i, SITE + place, T0 + datetime.timedelta(hours=hour)) for i, place in enumerate(("/a", "/b", "/none"))]
            spark.createDataFrame(rows, incoming).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            stream_extract(
                spark.readStream.schema(incoming).parquet(str(folder / "in")), pages, schema, rule_extractor({"name": ("^([A-Z][a-z]+)", 1)}),
                str(folder / "cache"), str(folder / "results"), str(folder / "log"), fan=fan,
            ).awaitTermination()
        rows = spark.read.parquet(str(folder / "results")).select("request_id", "status", "stage", "cached", "data").collect()
        found[name] = sorted(map(tuple, rows), key=repr)
    assert found["plain"] == found["merged"] and {r[3] for r in found["plain"]} == {True, False, None}
    store = CacheStore(spark, str(tmp_path / "merged" / "cache"), 2)
    parts = store.parts()[1]
    assert len(parts) < 6 and max(p["level"] for p in parts) >= 1 and len(CacheStore(spark, str(tmp_path / "plain" / "cache")).parts()[1]) == 6
    folders = {p.name for p in (tmp_path / "merged" / "cache" / "parts").iterdir() if not p.name.startswith(".")}
    assert folders == {p["name"] for p in parts}
    # Rows that expired before the last merge are gone.
    assert store.rows(parts).agg(F.min("expires_at")).first()[0] > T0 + datetime.timedelta(hours=24)


def entries(spark, *rows):
    hours = lambda h: T0 + datetime.timedelta(hours=h)
    return spark.createDataFrame([(k, d, hours(c), hours(e)) for k, d, c, e in rows], "key STRING, data STRING, created_at TIMESTAMP, expires_at TIMESTAMP")


def test_merging_and_replay(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path), 3)
    assert store.before(9).count() == 0 and not store.compact(5, T0)
    batches = [entries(spark, ("a", "1", 0, 24), ("b", "2", 0, 24)), entries(spark, ("a", "3", 2, 26)), entries(spark, ("a", "4", 9, 33), ("c", None, 9, 33))]
    for k, rows in enumerate(batches):
        store.add(rows, k)
    horizon = T0 + datetime.timedelta(hours=5)
    # Batch 2 itself is running: two parts before it, nothing to merge; from batch 3 on there are three.
    assert not store.compact(2, horizon) and store.compact(3, horizon) and not store.compact(3, horizon)
    rows = sorted((r.key, r.data) for r in store.before(3).collect())
    assert rows == [("a", "3"), ("a", "4"), ("b", "2"), ("c", None)] and len(store.parts()[1]) == 1
    store.add(entries(spark, ("d", "5", 10, 34)), 3)
    assert store.before(3).count() == 4 and store.before(4).count() == 5
    store.add(entries(spark, ("d", "6", 10, 34), ("e", "7", 10, 34)), 3)
    assert sorted(r.data for r in store.before(4).where("key IN ('d', 'e')").collect()) == ["6", "7"]
    assert store.before(4, T0 + datetime.timedelta(hours=24)).where("key = 'b'").count() == 0
    late = merged(store.before(4), F.lit(T0 + datetime.timedelta(hours=33)))
    assert sorted(r.key for r in late.collect()) == ["d", "e"]


def test_sql_names(spark):
    register(spark)
    text = "'ab' || repeat('c', 20) || '\\n\\nLinks found on this page:\\nx: y'"
    row = spark.sql(f"SELECT truncate_content({text}, 4) t, snippet('abcdef', 3) s, url_parts('no url') u, truncate_content(null, 3) n").first()
    assert row.t == "abcc...\n[Content truncated]\n\nLinks found on this page:\nx: y"
    assert (row.s, row.u, row.n) == ("abc...", ["", "", ""], None)
    links = spark.sql("SELECT l.* FROM VALUES ('<a href=\"/x\">X</a>', 'https://s.org/') AS p(html, url), LATERAL page_links(p.html, p.url) l")
    assert tuple(links.first()) == (0, "X", "/x", "https://s.org/x")
    assert spark.sql("SELECT snippet(CAST(id AS STRING), 1) FROM range(3)").select(F.count("*")).first()[0] == 3
