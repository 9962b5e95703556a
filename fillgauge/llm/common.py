"""Helpers shared by the corpus operators: Arrow batches of bounded size, files on shared storage."""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillgauge import session

#: Bounds of one Arrow batch on its way to or from a Python worker.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """The library's session settings, and bounded Arrow batches for long texts."""
    session.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def column(name: str) -> Column:
    """A column by its literal name, dots and other signs included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """The id, text and named further columns alone; a null text reads as empty.

    Other columns are left behind, so none can clash with those an operator adds.
    """
    return docs.select(
        column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"), *(column(c).alias(c) for c in more)
    )


def once(value: Column) -> Column:
    """A column that is computed where it stands and nowhere else.

    The optimiser moves cheap-looking columns into their readers, loops over lists
    included, and into filters further down. It leaves alone what is marked as
    depending on the row's place, which this is, though its value does not.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def sliced(rows: Sequence, size, limit: int = BATCH_BYTES, most: int = BATCH_ROWS) -> Iterator[list]:
    """Cut a sequence into lists of bounded summed ``size`` and length, in order."""
    held, total = [], 0
    for row in rows:
        if held and (total + size(row) > limit or len(held) >= most):
            yield held
            held, total = [], 0
        held.append(row)
        total += size(row)
    if held:
        yield held


def storage(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared folder, from any executor."""
    if uri.startswith("file:") and not uri.startswith("file://"):  # as Hadoop writes local paths
        uri = uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


class Committed:
    """A file that appears under its name only when complete.

    An attempt writes beside it and renames. Attempts of one task write the same
    bytes, so whichever comes last, readers see one whole file.
    """

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path = fs, path
        self.hidden = f"{os.path.dirname(path)}/_attempt-{uuid.uuid4().hex}"

    def __enter__(self):
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.stream = self.fs.open_output_stream(self.hidden)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.fs.move(self.hidden, self.path)
        else:
            self.fs.delete_file(self.hidden)


def row_keys() -> Iterator[int]:
    """In a task: keys of its rows, which no other task gives. They hold for what is written with them, not for another run."""
    return itertools.count(TaskContext.get().partitionId() << 40)


def one_row_per_task(table: DataFrame, key: str, rows: int) -> DataFrame:
    """Deal a small table of work items (files, blocks) out, about one to a task."""
    return table.repartitionByRange(max(1, rows), key)
