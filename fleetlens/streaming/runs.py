"""Starting streams: file sources, sinks and checkpoints in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import checkpoint_dir, ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state larger than memory, and the provider that stateful processors need; their runners get this package."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


CHECKPOINT_FILES = "spark.sql.streaming.checkpointFileManagerClass"
_STREAMING = "org.apache.spark.sql.execution.streaming"
FILE_SYSTEM_FILES = [f"{_STREAMING}{package}.FileSystemBasedCheckpointFileManager" for package in (".checkpointing", "")]
SOURCE_LOG_DELAY = "spark.sql.streaming.fileSource.log.cleanupDelay"


@contextmanager
def plain_checkpoints(spark: SparkSession, folder: str) -> Iterator[None]:
    """Streams that start and end in here have cheaper logs, when ``folder``, where they lie, is on a local disk.

    Spark's choice for logs, Hadoop's file context, starts a program there for each link it asks about and each
    permission, some thirty in a micro-batch, and small micro-batches wait for little else. A file system starts few. Either
    way a log is written beside its name and renamed, which is atomic on a local disk, and either reads what the other
    wrote. Logs of a source's files that are no longer needed (of all but the last 100 micro-batches) go at once, as each
    micro-batch lists those that are there. Other folders, and what the session sets itself, are left alone.
    """
    jvm = spark._jvm
    known = [name for name in FILE_SYSTEM_FILES if jvm.org.apache.spark.util.Utils.classIsLoadable(name)]
    where = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    settings = {CHECKPOINT_FILES: known[0], SOURCE_LOG_DELAY: "0"} if known and where.getUri().getScheme() == "file" else {}
    held = spark.conf.getAll
    settings = {k: v for k, v in settings.items() if k not in held}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in settings:
            spark.conf.unset(k)


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A given table as a stream; event time becomes a UTC instant, which watermarks require.

    The number of files per micro-batch bounds what one key can bring to a stateful step at a time.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # written as a pattern, the path may be one file or a folder of files
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(f"{sf_dir}/{name}.parque[t]")
    times = {f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"}
    return df.withColumns(times) if times else df


def folder_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class Drain:
    """Closes the windows of a stream that has come to its end.

    Event time stands still at the last row, so what is open then would never be given out. A drained stream also reads
    a folder that is empty at first. Once all rows are through, ``close`` puts one row there, the last one again,
    ``AHEAD`` later, and the query goes on with it. ``rows_only`` leaves out what came of that row: it lies beyond
    half of ``AHEAD``, counted from the data's own last instant.
    """

    AHEAD = timedelta(days=366)

    def __init__(self, rows: DataFrame, ts: str = "ts"):
        self.spark, self.rows, self.ts = rows.sparkSession, rows, ts
        self.path = new_folder(self.spark, "drain")
        self.spark.createDataFrame([], rows.schema).write.parquet(self.path)
        self.last = rows.agg(F.max(ts)).first()[0]

    def stream(self, rows: DataFrame) -> DataFrame:
        return rows.unionByName(folder_stream(self.spark, self.path, self.rows.schema))

    def close(self) -> None:
        if self.last is not None:
            row = self.rows.agg(F.max_by(F.struct(*self.rows.columns), self.ts).alias("r")).select("r.*")
            later = F.col(self.ts) + F.make_dt_interval(days=F.lit(self.AHEAD.days))
            row.withColumn(self.ts, later).select(*self.rows.columns).write.mode("append").parquet(self.path)

    def rows_only(self, out: DataFrame, instant: str) -> DataFrame:
        return out if self.last is None else out.filter(F.col(instant) < F.lit(self.last + self.AHEAD / 2))


def run_to_end(stream: DataFrame, name: str, drains: tuple[Drain, ...] = (), interval: str | None = None) -> DataFrame:
    """Process everything available into a Parquet sink and read the result back.

    With ``drains`` the query runs on over their closing rows. ``interval`` (such as "30 seconds") keeps a polling
    query going instead, which the caller stops; there is no end then to read back from.
    """
    spark = stream.sparkSession
    out = new_folder(spark, name)

    def start():
        writer = (
            stream.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", out + "-checkpoint").outputMode("append")
        )
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

    if interval:
        return start()
    start().awaitTermination()
    if drains:
        for drain in drains:
            drain.close()
        start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def state_at_end(stream: DataFrame, name: str, variable: str) -> DataFrame:
    """key and value of a state variable after everything available has been processed."""
    out = new_folder(stream.sparkSession, name)
    checkpoint = out + "-checkpoint"
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.format("statestore").option("stateVarName", variable).load(checkpoint)
