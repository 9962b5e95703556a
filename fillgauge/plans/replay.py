"""Bounded replays: feed a table to a streaming job piece by piece and read its result."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from fillgauge.session import shared_dir
from fillgauge.streaming.jobs import DELTA_SCHEMA, read_snapshots, stream_delta


def catch_up(writer: DataStreamWriter) -> None:
    """Process what is available, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


@contextmanager
def state_partitions(spark: SparkSession):
    """State is split once, at a query's first start: by the cluster's cores rather than a fixed number."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def replay(
    spark: SparkSession,
    pieces: Iterable[DataFrame],
    start: Callable[[DataFrame, str, str], DataStreamWriter],
    purpose: str,
) -> str:
    """Append each piece to the source folder and let the job catch up; returns the output folder.

    ``start(stream, out, checkpoint)`` builds the writer. The query stops and
    restarts from its checkpoint between pieces, so a replay also tests recovery.
    """
    base = shared_dir(spark, purpose)
    source, out, checkpoint = f"{base}/source", f"{base}/out", f"{base}/checkpoint"
    for piece in pieces:
        piece.write.mode("append").parquet(source)
        with state_partitions(spark):
            catch_up(start(read_snapshots(spark, source, piece.schema), out, checkpoint))
    return out


def to_parquet(job: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, str, str], DataStreamWriter]:
    """A starter that appends the job's rows to parquet."""

    def start(stream: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
        return (
            job(stream)
            .writeStream.outputMode("append")
            .format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
        )

    return start


def delta_starter(stream: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Changes and late rows side by side, in folders of their own."""
    return to_parquet(stream_delta)(stream, out, checkpoint).partitionBy("late")


def chained(job: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, str, str], DataStreamWriter]:
    """A starter for jobs on deltas: first catch up the deltas, then stream these into ``job``."""

    def start(stream: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
        deltas = f"{out}-deltas"
        catch_up(delta_starter(stream, deltas, f"{checkpoint}-deltas"))
        source = stream.sparkSession.readStream.schema(DELTA_SCHEMA).parquet(deltas).where("late = 0")
        return to_parquet(job)(source, out, checkpoint)

    return start
