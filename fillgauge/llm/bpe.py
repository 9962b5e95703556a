"""BPE encoding and decoding of whole texts with a segment tree over pair ranks.

A pre-token starts as one symbol per byte. The leaves of a segment tree hold,
for every adjacent pair, its merge rank and place; every node holds the least
of its children, so the root is the lowest-rank pair, the leftmost among equals.
That pair is merged, the three leaves around it change, and each change climbs
to the root in a logarithm of the length. Merging ends when the root holds no
mergeable pair. A pre-token of n bytes, however long, takes O(n log n).

Pre-tokens are found, and kept with their ids while short, as ``tokens`` says.

Results in special cases: a null text is empty and has no ids; an empty text
decodes to an empty text; ids whose bytes are not UTF-8 decode with U+FFFD for
what cannot be read; unknown ids decode to nothing; null ids decode to null;
repeated rows stay; other columns of the input are not carried.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fillgauge.llm import common, tokens

#: Above every rank.
NONE = 1 << 62


def byte_signs() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others, in order, for the
    characters from U+0100 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Vocabulary:
    """Merges and tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids, signs = model["vocab"], byte_signs()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.added.values()]) + 1
        self.byte_ids = [ids.get(signs[b], -1) for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left id, right id) -> (rank, merged id)
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        back = {s: b for b, s in signs.items()}
        self.bytes = [b""] * self.size
        for token, i in [*ids.items(), *self.added.items()]:
            known = all(c in back for c in token)
            self.bytes[i] = bytes(back[c] for c in token) if known else token.encode()


def merge(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Ids of one pre-token from the ids of its bytes."""
    n = len(symbols)
    if n < 2:
        return symbols
    ids = list(symbols)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    absent = (NONE, 0)
    # a node is rank * size + place, so that the least is the leftmost of the lowest rank
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = merges.get((ids[i], ids[i + 1]), absent)[0]
        if rank is not NONE:
            tree[size + i] = rank * size + i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))

    def put(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            least = value if value < other else other
            if tree[node] == least:
                return
            tree[node] = value = least

    while tree[1] != NONE:
        i = tree[1] % size
        j = after[i]
        ids[i] = merges[ids[i], ids[j]][1]
        ids[j] = -1
        after[i] = k = after[j]
        if j < n - 1 or k < n:
            put(j, NONE)
        if k < n:
            before[k] = i
            rank = merges.get((ids[i], ids[k]), absent)[0]
            put(i, NONE if rank is NONE else rank * size + i)
        else:
            put(i, NONE)
        h = before[i]
        if h >= 0:
            rank = merges.get((ids[h], ids[i]), absent)[0]
            put(h, NONE if rank is NONE else rank * size + h)
    return [x for x in ids if x >= 0]


def tree_encoder(path: str) -> tokens.Encoder:
    """An encoder whose pre-tokens are merged by ``merge``."""
    words = Vocabulary(path)
    kind = np.dtype(f"<u{tokens.id_width(words.size)}")
    byte_ids, merges = words.byte_ids, words.merges

    def make(strings: list[str]) -> list[bytes]:
        return [np.array(merge([i for b in s.encode() if (i := byte_ids[b]) >= 0], merges), kind).tobytes() for s in strings]

    found = tokens.Encoder(make, words.size, words.added)
    found.bytes = words.bytes
    return found


def decode_ids(ids: np.ndarray, table: list[bytes]) -> str:
    """Text of the ids; bytes that are not UTF-8 become U+FFFD."""
    n = len(table)
    return b"".join([table[i] if 0 <= i < n else b"" for i in ids.tolist()]).decode("utf-8", "replace")


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _id_lists(found: list[bytes], kind: np.dtype) -> pa.ListArray:
    flat = np.frombuffer(b"".join(found), kind).astype(np.int32)
    ends = np.cumsum([0] + [len(f) // kind.itemsize for f in found], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = tokens.loaded(path, tree_encoder)
    for batch in batches:
        rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))
        for some in common.sliced(rows, lambda r: len(r[1])):
            found = coder.encode([t for _, t in some])
            yield pa.record_batch([pa.array([i for i, _ in some], pa.int64()), _id_lists(found, coder.kind)], schema=IDS)


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = tokens.loaded(path, tree_encoder).bytes
    for batch in batches:
        lists = batch.column("ids")
        texts = [None if x is None else decode_ids(x, table) for x in _rows(lists)]
        yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])


def _rows(lists: pa.ListArray) -> Iterator[np.ndarray | None]:
    ends, flat = lists.offsets.to_numpy(), lists.values.fill_null(-1).to_numpy(zero_copy_only=False)
    for k, there in enumerate(lists.is_valid().to_pylist()):
        yield flat[ends[k] : ends[k + 1]] if there else None


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, special tokens not added."""
    common.prepare(docs.sparkSession)
    rows = common.texts(docs, id_col, text_col)
    return rows.mapInArrow(lambda b: _encoded(b, tokenizer), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, decoded``: the text of every list of ids, special tokens kept."""
    common.prepare(encoded.sparkSession)
    rows = encoded.select(common.column(id_col).alias("doc_id"), common.column(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda b: _decoded(b, tokenizer), "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass, so that ids cross to the worker only once."""
    common.prepare(docs.sparkSession)
    rows = common.texts(docs, id_col, text_col)
    return rows.mapInArrow(lambda b: _decoded(_encoded(b, tokenizer), tokenizer), "doc_id long, ids array<int>, decoded string")
