"""Results that are expensive and used more than once."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def scratch_path(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir. `outlives`: see `materialize`."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pagelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/pagelake/{name}-{uuid.uuid4().hex}"
    scopes = getattr(_scopes, "open", [])
    if len(scopes) > outlives:
        scopes[-1 - outlives].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables materialized inside once the block ends; write results before that."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str = "table", outlives: bool = False) -> DataFrame:
    """Write the result once as Parquet and go on from the written table.

    Later readers prune columns, lost executors cost nothing upstream, and the
    lineage ends here. The files stay in the shared folder unless a `scratch_scope` is open;
    a table that `outlives` the innermost scope is left to the one around it.
    """
    path = scratch_path(df.sparkSession, name, outlives)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
