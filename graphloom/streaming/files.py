"""A stream of file versions: each batch is compared with the cache and only what changed is extracted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.incremental import changed, refreshed
from ..storage import overwrite


def watch(spark: SparkSession, source: str, schema: str, cache: str, extract) -> object:
    """Starts a query over Parquet files of (path, sha256, …) rows in `source`; `extract(files) -> DataFrame` (path, sha256, …) fills the cache at `cache`.

    A batch that is repeated after a failure finds the cache of before, since batches alternate between two tables.
    """

    def step(batch: DataFrame, n: int) -> None:
        old = spark.read.parquet(f"{cache}/{(n + 1) % 2}") if n else None
        fresh = extract(changed(batch, old) if old is not None else batch)
        new = fresh.unionByName(refreshed(batch, old, fresh.limit(0)).unionByName(old.join(batch.select("path"), "path", "left_anti"))) if old is not None else fresh
        overwrite(new, f"{cache}/{n % 2}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{cache}/checkpoint").trigger(availableNow=True).start()
