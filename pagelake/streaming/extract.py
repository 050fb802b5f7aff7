"""Extraction over a stream of requests with the cache as a table."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelake.operators.extract import Extractor, extract
from pagelake.plans.reuse import materialize, scratch_scope
from pagelake.sources.page_store import PageStore
from pagelake.streaming.cache_store import FAN, CacheStore

SLACK = datetime.timedelta(hours=1)


def stream_extract(
    requests: DataFrame,
    pages: DataFrame | PageStore,
    schema: dict,
    extractor: Extractor,
    cache_path: str,
    results_path: str,
    checkpoint: str,
    trigger: dict | None = None,
    fan: int = FAN,
    slack: datetime.timedelta = SLACK,
    **options,
) -> StreamingQuery:
    """Start `operators.extract.extract` per micro-batch of (request_id, url, asked_at).

    Results go to one folder per batch and new cache rows to a part of the cache (`CacheStore`), both
    replaced when the batch is replayed, so a restart neither loses nor doubles rows. `fan` parts
    are merged into one from time to time, without rows that no batch can find any more: a batch's time may
    lie up to `slack` before that of an earlier one. With a page store a batch reads only the folders of
    its urls. The batch's time is its latest request, which a replay sees alike. `trigger` takes the arguments of Spark's trigger, for
    example {"processingTime": "1 minute"} for a stream that goes on; by default what is there is worked off.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = batch.agg(F.max("asked_at")).first()[0]
        if now is None:
            return
        with scratch_scope(spark):
            store = CacheStore(spark, cache_path, fan)
            while store.compact(batch_id, now - slack):
                pass
            outcome = extract(batch, pages, schema, extractor, store.before(batch_id, now), F.lit(now), **options)
            entries = materialize(outcome.new_entries, "new-entries")
            outcome.results.write.mode("overwrite").parquet(f"{results_path}/batch_id={batch_id}")
            store.add(entries, batch_id)

    return (
        requests.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
