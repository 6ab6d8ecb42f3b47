"""Token-id files: frequency-ranked ids in byte-aligned variable-length codes, control bytes kept apart.

Encoding writes every document's ids once, together with each task's id counts. The counts of the whole
corpus (one number per vocabulary entry) give every id its rank, so that the most frequent 256 ids take one
byte. Documents are then dealt by ranges of doc_id and written in that order as self-contained blocks:

    magic, n_docs, n_tokens | doc lengths | control bytes (two bits per id: bytes - 1) | data bytes

A block's tables hold doc ids and where it starts within its partition; the totals of the partitions, one
number each, turn that into positions in the whole. Decoding looks a control byte up in a numpy table of
four code lengths, and gathers the data bytes of all ids at once.

Cases: a null text has only its end id. Null doc_ids come first; equal doc_ids follow each other in the
order they were read. An empty table gives files without blocks. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, new_path, shuffle_partitions
from .word_ids import word_ids

MAGIC = b"LTB1"
HEAD = "<4sIQ"
BLOCK_TOKENS = 1 << 20

#: Control byte -> lengths of its four codes.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) bytes of unsigned ranks."""
    r = ranks.astype(np.uint32)
    n = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = n - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    ends = np.cumsum(n, dtype=np.int64)
    at = ends - n
    data = np.empty(int(ends[-1]) if len(r) else 0, np.uint8)
    for k in range(4):
        some = slice(None) if k == 0 else n > k
        data[at[some] + k] = r[some] >> np.uint32(8 * k)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first n ranks: lengths by table lookup, bytes gathered by position."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32) if n else np.empty(0, np.uint32)
    for k in range(1, int(length.max(initial=1))):
        some = length > k
        out[some] |= raw[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of doc_id, part, seq, ids; and one row per task with its counts instead."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        words, part, seq = word_ids(path), TaskContext.get().partitionId(), 0
        size = max(words.vocab_size, end_id + 1)
        small = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        counts, end = np.zeros(size, np.int64), np.array([end_id], "<u4").tobytes()
        kind = None
        for b in batches:
            kind = b.column("doc_id").type
            n = b.num_rows
            ids = [np.frombuffer(words.encode(t) + end, "<u4") for t in b.column("text").to_pylist()]
            counts += np.bincount(np.concatenate(ids), minlength=size) if ids else 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array([i.astype(small).tobytes() for i in ids], pa.binary()), pa.nulls(n, pa.binary())],
                ["doc_id", "part", "seq", "ids", "counts"],
            )
            seq += n
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([part], pa.int32()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["doc_id", "part", "seq", "ids", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, part int, seq long, ids binary, counts binary")


def _total_counts(encoded: DataFrame, size: int) -> np.ndarray:
    """Sum of all tasks' counts: first in up to 16 tasks, then on the driver (16 vectors of one number per id)."""

    def add(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("counts"):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    rows = encoded.where(F.col("counts").isNotNull()).select("counts").repartition(16).mapInArrow(add, "counts binary").collect()
    return sum((np.frombuffer(r.counts, np.int64) for r in rows), np.zeros(size, np.int64))


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    """Write the documents' ids under folder/blocks, folder/ranks and folder/parts."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    small = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    encoded = materialize(_encode(docs, path, end_id), "token-ids")
    counts = _total_counts(encoded, size)
    by_rank = np.lexsort((np.arange(size), -counts)).astype("<u4")
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("start_in_part", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(encoded.schema["doc_id"].dataType)), T.StructField("body", T.BinaryType())])

    def blocks(batches):
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids, docs, held, kind = [], [], 0, None

        def flush():
            nonlocal ids, docs, held, block, start
            lengths = np.array([len(i) for i in ids], "<u4")
            control, data = pack(rank[np.concatenate(ids)])
            body = struct.pack(HEAD, MAGIC, len(ids), held) + lengths.tobytes() + control + data
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([docs], pa.list_(kind)), pa.array([body], pa.binary())], [f.name for f in schema])
            block, start, ids, docs, held = block + 1, start + held, [], [], 0
            return out

        for b in batches:
            kind = b.column("doc_id").type
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                a = np.frombuffer(x, small)
                ids.append(a)
                docs.append(d)
                held += len(a)
                if held >= BLOCK_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    order = ["doc_id", "part", "seq"]
    rows = encoded.where(F.col("ids").isNotNull()).select(*order, "ids").repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = rows.select("doc_id", "ids").mapInArrow(blocks, schema)
    placed.write.option("compression", "none").parquet(f"{folder}/blocks")
    written = spark.read.parquet(f"{folder}/blocks")
    written.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.parquet(f"{folder}/parts")
    spark.sql("SELECT 1").select(F.unhex(F.lit(by_rank.tobytes().hex())).alias("by_rank")).write.parquet(f"{folder}/ranks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids (little-endian 32-bit) from the files alone."""
    by_rank = np.frombuffer(spark.read.parquet(f"{folder}/ranks").first().by_rank, "<u4")
    totals = sorted((r.part, r.n_tokens) for r in spark.read.parquet(f"{folder}/parts").collect())
    before = dict(zip((p for p, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist()[:-1], strict=True))
    blocks = spark.read.parquet(f"{folder}/blocks")
    doc_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for part, start, docs, body in zip(*(b.column(c).to_pylist() for c in ("part", "start_in_part", "doc_ids", "body")), strict=True):
                magic, n_docs, n = struct.unpack_from(HEAD, body)
                if magic != MAGIC:
                    raise ValueError("not a token block")
                at = struct.calcsize(HEAD) + 4 * n_docs
                lengths = np.frombuffer(body, "<u4", n_docs, struct.calcsize(HEAD)).astype(np.int64)
                split = at + -(-n // 4)
                ids = by_rank[unpack(body[at:split], body[split:], n)]
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, b.column("doc_ids").type.value_type), pa.array(before[part] + start + starts), pa.array([ids[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary())],
                    ["doc_id", "start", "ids"],
                )

    return blocks.select("part", "start_in_part", "doc_ids", "body").mapInArrow(run, f"doc_id {doc_type}, start long, ids binary")


def write_and_read(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written to the shared folder."""
    folder = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, folder, path, end_id)
    back = read_token_files(docs.sparkSession, folder)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
