"""A keyed store that batches change in part.

Rows lie in buckets by a hash of their key, each in a folder of the batch that wrote it
last; a manifest per batch says which that is.  A batch reads and writes only the
buckets that its keys fall into, so what it costs follows its own size as long as it
touches few of them.  Every batch makes new folders and one new manifest and changes
none: a replay writes its own again, and who reads an older manifest is not disturbed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
_MANIFEST = "bucket int, batch long"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def manifest(spark: SparkSession, store: str, number: int) -> dict[int, int]:
    """The batch that wrote each bucket last, after batch ``number``: a row a bucket at most."""
    path = f"{store}/manifest/number={number}"
    if number < 0 or not _exists(spark, f"{path}/_SUCCESS"):
        return {}
    return {r["bucket"]: r["batch"] for r in spark.read.schema(_MANIFEST).parquet(path).collect()}


def numbers(spark: SparkSession, store: str) -> list[int]:
    """Batches whose manifests are there, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/manifest")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(p.getName().partition("=")[2]) for p in found if _exists(spark, f"{p}/_SUCCESS"))


def _rows(spark: SparkSession, store: str, of: dict[int, int]) -> DataFrame | None:
    paths = [f"{store}/data/batch={n}/bucket={b}" for b, n in sorted(of.items())]
    return spark.read.parquet(*paths) if paths else None


def read(spark: SparkSession, store: str, number: int | None = None) -> DataFrame | None:
    """The rows after batch ``number`` (None: the newest); None of an empty store."""
    known = numbers(spark, store)
    return _rows(spark, store, manifest(spark, store, known[-1] if number is None else number)) if known else None


def _bucket(key: str | list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in ([key] if isinstance(key, str) else key)]), F.lit(buckets)).cast("int")


def _touched(df: DataFrame, bucket: Column) -> list[int]:
    return [r["b"] for r in df.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets at most


def met(df: DataFrame, number: int, store: str, key: str | list[str], buckets: int = BUCKETS) -> DataFrame | None:
    """The rows that batch ``number`` finds in the buckets that ``df`` touches."""
    before = manifest(df.sparkSession, store, number - 1)
    return _rows(df.sparkSession, store, {b: before[b] for b in _touched(df, _bucket(key, buckets)) if b in before})


def upsert_batch(df: DataFrame, number: int, store: str, upsert: Callable[[DataFrame | None, DataFrame], DataFrame], key: str | list[str], buckets: int = BUCKETS) -> None:
    """Upsert a batch: ``upsert`` gets the stored rows of the touched buckets and the
    batch's rows, and gives all rows of those buckets.  A batch without rows keeps the
    manifest.  The number of buckets is that of the first batch for good."""
    spark = df.sparkSession
    bucket = _bucket(key, buckets)
    df = df.persist()
    before = manifest(spark, store, number - 1)
    touched = _touched(df, bucket)
    if touched:
        stored = _rows(spark, store, {b: before[b] for b in touched if b in before})
        rows = upsert(stored, df).withColumn("bucket", bucket)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/data/batch={number}")
    now = before | dict.fromkeys(touched, number)
    spark.createDataFrame(sorted(now.items()), _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/number={number}")
    df.unpersist()


def compact(spark: SparkSession, store: str, keep: int = 2) -> int:
    """Remove what no one of the newest ``keep`` manifests names, those manifests' elders
    too; how many folders went.  At least two are kept, as the newest batch may run again
    from the one before."""
    known = numbers(spark, store)
    kept = known[-max(keep, 2) :]
    alive = {(n, b) for k in kept for b, n in manifest(spark, store, k).items()}
    hadoop, conf, gone = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration(), 0

    def remove(path: str) -> None:
        at = hadoop.Path(path)
        at.getFileSystem(conf).delete(at, True)

    data = hadoop.Path(f"{store}/data")
    files = data.getFileSystem(conf)
    for batch in files.listStatus(data) if files.exists(data) else []:
        n = int(batch.getPath().getName().partition("=")[2])
        folders = [s.getPath() for s in files.listStatus(batch.getPath()) if s.getPath().getName().startswith("bucket=")]
        dead = [p for p in folders if (n, int(p.getName().partition("=")[2])) not in alive]
        for p in [batch.getPath()] if len(dead) == len(folders) else dead:
            if not kept or n <= kept[-1]:  # a newer batch is being written
                remove(p.toString())
                gone += 1
    for k in known[: -len(kept)] if kept else []:
        remove(f"{store}/manifest/number={k}")
    return gone


def upsert_stream(rows: DataFrame, store: str, checkpoint: str, upsert: Callable[[DataFrame | None, DataFrame], DataFrame], key: str = "fingerprint", buckets: int = BUCKETS):
    """Upsert a stream's batches into a store."""

    def batch(df: DataFrame, number: int) -> None:
        upsert_batch(df, number, store, upsert, key, buckets)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(keys: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """An upsert that keeps a key's newest row; a batch has a key once."""

    def upsert(stored: DataFrame | None, df: DataFrame) -> DataFrame:
        if stored is None:
            return df
        rest = [c for c in df.columns if c not in keys]
        both = stored.select(*df.columns, F.lit(0).alias("_newer")).unionByName(df.withColumn("_newer", F.lit(1)))
        return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_newer").alias("_row")).select(*keys, "_row.*")

    return upsert


def latest_stream(aggregates: DataFrame, keys: list[str], store: str, checkpoint: str, buckets: int = BUCKETS):
    """The newest value of every window in a store.  The stream is in update mode: its
    state ends with the watermark, a batch hands over only the windows it changed, and
    closed windows stay in the store."""

    def batch(df: DataFrame, number: int) -> None:
        upsert_batch(df, number, store, latest(keys), keys, buckets)

    return aggregates.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
