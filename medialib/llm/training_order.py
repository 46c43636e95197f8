"""Training order: every sequence gets a global slot by a keyed permutation, and shards hold the slots in order.

Sequences are numbered densely (a task's first number plus the place in the task). A Feistel network on the least even
number of bits that covers them, walked along its cycle until it lands inside, permutes the numbers without a sort or
a table. Shards are range partitions of the slots; each is a chain of blobs of fixed-size records, so the record of
slot s lies at ``(s mod per_shard) * stride`` of shard ``s div per_shard`` and reading can start at any slot.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialib.llm.arrays import mix
from medialib.llm.steps import Steps
from medialib.llm.tokens import END, coder, default_path

#: Ids in a sequence, records in a shard and in a blob of it, rounds of the network.
LENGTH, PER_SHARD, PER_BLOB, ROUNDS = 1024, 8192, 64, 6
HEAD = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("length", "<i4")])


def stride(length: int = LENGTH) -> int:
    """Bytes of a record: the head and ``length`` ids of two bytes, the unused ones zero."""
    return HEAD.itemsize + 2 * length


def _round(half: np.ndarray, key: int, k: int, bits: int) -> np.ndarray:
    return mix(half ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF), k) >> np.uint64(64 - bits)


def permute(x: np.ndarray, count: int, key: int, inverse: bool = False) -> np.ndarray:
    """The place of each number below ``count`` under the permutation of ``key``, or back."""
    bits = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << bits) - 1)
    x = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(bits), x[todo] & low
        for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ _round(left, key, k, bits), left
            else:
                left, right = right, left ^ _round(right, key, k, bits)
        x[todo] = left << np.uint64(bits) | right
        todo = todo[x[todo] >= count]
    return x.astype(np.int64)


def sequences(docs: DataFrame, id_col: str, text_col: str, length: int, tokenizer: str) -> DataFrame:
    """``(record, task, row)``: the fixed-size records of every document's ids, an end id after each."""

    def work(batches):
        code, task, row = coder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            ids_of = code.texts(b.column("t"))
            records: list[bytes] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), ids_of, strict=True):
                ids = np.append(ids, np.uint32(END)).astype("<u2")
                for piece, start in enumerate(range(0, len(ids), length)):
                    part = ids[start:start + length]
                    head = np.array([(-1 if doc is None else doc, piece, len(part))], HEAD)
                    records.append(head.tobytes() + part.tobytes() + bytes(2 * (length - len(part))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(records, pa.binary()), pa.array(np.full(len(records), task, np.int32)),
                 pa.array(row + np.arange(len(records), dtype=np.int64))], ["record", "task", "row"])
            row += len(records)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        work, "record binary, task int, row bigint")


def materialise(docs: DataFrame, path: str, key: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                per_shard: int = PER_SHARD, tokenizer: str | None = None) -> int:
    """Write the shards of ``docs`` to ``path`` and return the number of sequences.

    The same files, split size and key give the same order. Null or empty text: a sequence of the end id alone. Null
    id: written as -1. Repeated rows: each has its sequences. Empty table: no shards. Further columns are not looked at.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "order")
    rows = steps.settle(sequences(docs, id_col, text_col, length, tokenizer or default_path()), "sequences")
    # One row a task.
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy("task").agg(F.count("*").alias("n"))
    firsts = steps.settle(tasks.select("task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "firsts")
    count = firsts.agg(F.sum("n")).first()[0] or 0

    def place(batches):
        for b in batches:
            slot = permute(b.column("first").to_numpy() + b.column("row").to_numpy(), count, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array((slot // per_shard).astype(np.int32)), pa.array(slot), b.column("record")], ["shard", "slot", "record"])

    def gather(batches):
        first, held = None, []

        def blob():
            return pa.RecordBatch.from_arrays(
                [pa.array([first // per_shard], pa.int32()), pa.array([first]), pa.array([b"".join(held)], pa.binary())],
                ["shard", "first_slot", "payload"])

        for b in batches:
            for slot, record in zip(b.column("slot").to_pylist(), b.column("record").to_pylist(), strict=True):
                if held and slot % per_shard % PER_BLOB == 0:
                    yield blob()
                    held = []
                if not held:
                    first = slot
                held.append(record)
        if held:
            yield blob()

    shards = max(1, -(-count // per_shard))
    placed = rows.join(firsts.select("task", "first"), "task").mapInArrow(place, "shard int, slot bigint, record binary")
    # A shard is never split: ranges are of shard numbers, as many as there are shards.
    ordered = placed.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot")
    blobs = ordered.mapInArrow(gather, "shard int, first_slot bigint, payload binary")
    blobs.write.mode("overwrite").option("compression", "zstd").parquet(path)
    steps.clear("sequences")
    return count


def read_from(spark: SparkSession, path: str, slot: int = 0, length: int = LENGTH) -> DataFrame:
    """``(slot, shard, offset, doc_id, piece, length, ids_crc32, ids)`` from ``slot`` on; blobs before it are pruned."""
    size, per_blob = stride(length), PER_BLOB

    def work(batches):
        for b in batches:
            for shard, first, payload in zip(*(b.column(c).to_pylist() for c in ("shard", "first_slot", "payload")), strict=True):
                out = []
                for k in range(len(payload) // size):
                    record = payload[k * size:(k + 1) * size]
                    head = np.frombuffer(record, HEAD, 1)[0]
                    ids = np.frombuffer(record, "<u2", int(head["length"]), HEAD.itemsize)
                    out.append((first + k, shard, int(head["doc_id"]), int(head["piece"]), len(ids),
                                zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32)))
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()),
                     pa.array(c[4], pa.int32()), pa.array(c[5], pa.int64()), pa.array(list(c[6]), pa.list_(pa.int32()))],
                    ["slot", "shard", "doc_id", "piece", "length", "ids_crc32", "ids"])

    table = spark.read.schema("shard int, first_slot bigint, payload binary").parquet(path)
    table = table.where((F.col("first_slot") > slot - per_blob) & (F.length("payload") > 0))
    return table.mapInArrow(work, "slot bigint, shard int, doc_id bigint, piece int, length int, ids_crc32 bigint, "
                                  "ids array<int>").where(F.col("slot") >= slot)
