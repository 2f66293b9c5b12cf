"""Job queue: JSON envelopes keyed by tenant, so one tenant stays in order.

The queue is Kafka on a cluster and a folder of files elsewhere. Offsets live in
the stream's checkpoint: delivery is at least once, and exactly once into an
idempotent sink (a consumer that commits before it parses would lose messages).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

ENVELOPE_SCHEMA = (
    "job_id string, organization_id string, job_type string, prompt string, parameters map<string,string>, "
    "payload string, timeout_seconds int, callback_url string, created_at string"
)


def to_messages(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def from_messages(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    return df.select("key", F.from_json(F.col("value").cast("string"), schema).alias("m")).select("key", "m.*")


MESSAGES_PER_FILE = 10_000


def write_jobs(
    messages: DataFrame, path: str | None = None, kafka: dict[str, str] | None = None, order: list[str] | None = None,
    per_file: int = MESSAGES_PER_FILE, partitions: int | None = None,
) -> None:
    """Write (key, value). Kafka's own partitioner keeps a tenant on one partition; a folder's files hold at most
    ``per_file`` messages, so that whole files make up a bounded fetch.

    With ``order`` a tenant's messages also arrive in that order, which takes one writer per tenant;
    without it a large tenant is written by many tasks. ``partitions`` deals a folder's messages into as many folders
    (``partition_path``), for one consumer each; with ``order`` a tenant's messages stay in one of them.
    """
    dealt_by = ["key"] if order else ["key", "value"]
    if order:
        messages = messages.repartition("key").sortWithinPartitions("key", *order).drop(*order)
    if kafka:
        messages.write.format("kafka").options(**{"kafka.acks": "all", **kafka}).save()
    else:
        writer = messages.write
        if partitions:
            dealt = F.pmod(F.xxhash64(*dealt_by), F.lit(partitions))
            writer = messages.withColumn("partition", dealt).write.partitionBy("partition")
        writer.mode("append").option("maxRecordsPerFile", per_file).parquet(path)


def partition_path(path: str, partition: int) -> str:
    """One partition's folder, as a pattern, so that a stream may read it before its first message."""
    return f"{path}/partition={{{partition}}}"


def write_jobs_stream(
    messages: DataFrame, checkpoint: str, path: str | None = None, kafka: dict[str, str] | None = None,
    per_file: int = MESSAGES_PER_FILE,
) -> StreamingQuery:
    out = messages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if kafka:
        return out.format("kafka").options(**{"kafka.acks": "all", **kafka}).start()
    return out.format("parquet").option("path", path).option("maxRecordsPerFile", per_file).start()


def read_jobs_stream(
    spark: SparkSession, path: str | None = None, kafka: dict[str, str] | None = None, files_per_batch: int = 100,
    glob: str | None = None, schema: T.StructType | str = "key string, value string", fetch_limit: int | None = None,
    per_file: int = MESSAGES_PER_FILE,
) -> DataFrame:
    """Messages of the queue as a stream; the checkpoint of the sink tracks offsets.

    One fetch takes at most ``fetch_limit`` messages, of a folder in whole files of at most ``per_file``, or without that
    limit ``files_per_batch`` files. How often one is made is the sink's trigger (``interval`` of ``runs.run_to_end``)."""
    if kafka:
        limit = {"maxOffsetsPerTrigger": str(fetch_limit)} if fetch_limit else {}
        return spark.readStream.format("kafka").options(**kafka, **limit).load().select(
            F.col("key").cast("string"), F.col("value").cast("string")
        )
    if fetch_limit is not None:
        if fetch_limit < per_file:
            raise ValueError(f"a file may hold {per_file} messages, more than one fetch")
        files_per_batch = fetch_limit // per_file
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


SERVERS_SCHEMA = "struct<servers: map<string, struct<url: string, type: string>>>"


def _is_object(c: Column) -> Column:
    """Well-formed JSON whose top is an object; from_json alone reads broken text as nulls."""
    return F.coalesce(F.try_parse_json(c).isNotNull() & F.ltrim(c).startswith("{"), F.lit(False))


def decode_envelope(df: DataFrame, value: str = "value", config_schema: str | None = SERVERS_SCHEMA) -> DataFrame:
    """Parse the envelope and find its config: payload, else parameters['config'], else an error."""
    raw = F.col(value).cast("string")
    m = F.from_json(raw, ENVELOPE_SCHEMA)
    out = df.withColumn("envelope", m)
    payload = F.nullif(F.col("envelope.payload"), F.lit(""))
    given = F.try_element_at(F.col("envelope.parameters"), F.lit("config"))
    out = out.withColumn("config_json", F.coalesce(payload, given)).withColumn(
        "config_source",
        F.when(payload.isNotNull(), F.lit("payload")).when(given.isNotNull(), F.lit("parameters")),
    )
    # fixed values: the error texts, here and in resolve_server
    errors = [
        F.when(~_is_object(raw), F.lit("failed to unmarshal job envelope")),
        F.when(F.col("config_json").isNull(), F.lit("no config found in payload or parameters")),
    ]
    if config_schema is not None:
        out = out.withColumn("config", F.from_json("config_json", config_schema))
        errors.append(F.when(~_is_object(F.col("config_json")), F.lit("failed to parse MCP config")))
    return out.withColumn("error", F.coalesce(*errors))


def resolve_server(df: DataFrame, name: Column, config: str = "config") -> DataFrame:
    """Server entry by name; a missing name or a type other than sse is an error."""
    entry = F.try_element_at(F.col(config)["servers"], name)
    return df.withColumn("server", entry).withColumn(
        "error",
        F.coalesce(
            F.when(F.col("server").isNull(), F.concat(F.lit("server "), name, F.lit(" not found in configuration"))),
            F.when(
                F.col("server.type") != "sse", F.concat(F.lit("unsupported server type: "), F.col("server.type"))
            ),
        ),
    )
