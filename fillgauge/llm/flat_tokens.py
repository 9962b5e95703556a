"""Token ids as flat unsigned integer files with 64-bit document offsets.

Format. A folder holds shards numbered in document order. A shard has

* ``part-00007.bin``: the ids of its documents, end id included, back to back,
  little-endian unsigned, 16 bits wide where every id fits, else 32;
* ``part-00007.idx``: little-endian unsigned 64-bit numbers, one more than it has
  documents: where each document starts in the ids of the whole folder, then
  where the last one ends;
* ``part-00007.doc``: little-endian signed 64-bit document ids (the least such
  number stands for null).

``shards`` beside them is a table of the shards with documents, ids and bases.
Bases are prefix sums over the shards' counts; no pass over the ids is needed
for them. Readers map the files where the folder is on a mounted file system
and read ranges where it is not.

Documents go in ascending id order, null ids first, rows of one id by their
text. Results in special cases: a null text is empty, and an empty one is its
end id alone; repeated rows stay; other columns are not carried; an empty table
gives no shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillgauge.llm import common, tokens

NULL_ID = -(1 << 63)
SHARD = "part long, width long, docs long, tokens long"


def _name(root: str, part: int, kind: str) -> str:
    return f"{root}/part-{part:05d}.{kind}"


def _write_ids(batches: Iterator[pa.RecordBatch], root: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Ids, local offsets and document ids of one shard."""
    part = TaskContext.get().partitionId()
    coder = tokens.loaded(tokenizer)
    end = np.array([end_id], coder.kind).tobytes()
    fs, folder = common.storage(root)
    doc_ids, lengths, stream, file = [], [], None, None
    try:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for rows in common.sliced(range(len(ids)), lambda k: len(texts[k])):
                if stream is None:
                    file = common.Committed(fs, _name(folder, part, "bin"))
                    stream = file.__enter__()
                found = coder.encode([texts[k] for k in rows])
                for k, f in zip(rows, found):
                    stream.write(f)
                    stream.write(end)
                    lengths.append(len(f) // coder.width + 1)
                    doc_ids.append(NULL_ID if ids[k] is None else ids[k])
    except BaseException as error:
        if file is not None:
            file.__exit__(type(error))
        raise
    if file is None:
        return
    file.__exit__(None)
    ends = np.cumsum([0, *lengths], dtype="<u8")
    for kind, values in (("doc", np.array(doc_ids, "<i8")), ("len", ends)):
        with common.Committed(fs, _name(folder, part, kind)) as out:
            out.write(values.tobytes())
    yield pa.RecordBatch.from_pydict({"part": [part], "width": [coder.width], "docs": [len(lengths)], "tokens": [int(ends[-1])]})


def _write_offsets(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Local offsets plus the shard's base."""
    fs, folder = common.storage(root)
    for batch in batches:
        for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
            local = _mapped(fs, _name(folder, part, "len"), np.dtype("<u8"))
            with common.Committed(fs, _name(folder, part, "idx")) as out:
                out.write((local + np.uint64(base)).tobytes())
        yield batch


def _mapped(fs, path: str, kind: np.dtype) -> np.ndarray:
    """A file as an array: mapped where the file system is a mounted one."""
    if fs.type_name == "local":
        return np.memmap(path, kind, "r") if fs.get_file_info(path).size else np.empty(0, kind)
    return np.frombuffer(fs.open_input_file(path).read_buffer(), kind)


class Tokens:
    """Ranges of a shard's ids."""

    def __init__(self, fs, path: str, width: int):
        self.kind = np.dtype(f"<u{width}")
        self.map = np.memmap(path, self.kind, "r") if fs.type_name == "local" else None
        self.file = None if self.map is not None else fs.open_input_file(path)

    def __getitem__(self, span: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[span]
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at((span.stop - span.start) * width, span.start * width), self.kind)


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    fs, folder = common.storage(root)
    for batch in batches:
        for part, width in zip(batch.column("part").to_pylist(), batch.column("width").to_pylist()):
            ids = Tokens(fs, _name(folder, part, "bin"), width)
            ends = _mapped(fs, _name(folder, part, "idx"), np.dtype("<u8")).astype(np.int64)
            docs = _mapped(fs, _name(folder, part, "doc"), np.dtype("<i8")).tolist()
            local = ends - ends[0]
            for rows in common.sliced(range(len(docs)), lambda k: 4 * int(local[k + 1] - local[k])):
                at = ids[slice(int(local[rows[0]]), int(local[rows[-1] + 1]))].astype("<u4")
                spans = [(int(local[k] - local[rows[0]]), int(local[k + 1] - local[rows[0]])) for k in rows]
                columns = [
                    [None if docs[k] == NULL_ID else docs[k] for k in rows], [int(ends[k]) for k in rows],
                    [b - a for a, b in spans], [at[a:b].tobytes() for a, b in spans],
                ]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, DOCS)], schema=DOCS)


def write(docs: DataFrame, root: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode every text and write the folder ``root`` on storage that all executors share."""
    spark = common.prepare(docs.sparkSession)
    rows = common.texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    # the text's hash lets equal ids spread over shards
    ordered = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    written = ordered.mapInArrow(lambda b: _write_ids(b, root, tokenizer, end_id), SHARD)
    written.write.parquet(f"{root}/counts")
    counts = spark.read.schema(SHARD).parquet(f"{root}/counts")
    # one row a shard: the only thing that comes together
    bases = counts.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    dealt = common.one_row_per_task(bases, "part", counts.count())
    dealt.mapInArrow(lambda b: _write_offsets(b, root), f"{SHARD}, base long").write.parquet(f"{root}/shards")


def read(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ids as little-endian unsigned 32-bit integers."""
    shards = spark.read.schema(f"{SHARD}, base long").parquet(f"{root}/shards")
    dealt = common.one_row_per_task(shards.select("part", "width"), "part", shards.count())
    return dealt.mapInArrow(lambda b: _read(b, root), "doc_id long, start long, n_tokens long, ids binary")
