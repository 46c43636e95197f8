"""Best-fit packing of token pieces into sequences of fixed capacity, on runs of equal lengths and gaps.

The dealt method, bulk-synchronous rounds with distributed sweeps, was tried and replaced: it needed more sequences and
some hundred Spark jobs (figures in the README). Equal lengths are interchangeable, so documents and gaps are kept as
runs (size, count), whose number is bounded by the capacity and not by the corpus; the driver places the runs, longest
first, each in the smallest gaps that hold it, conflicts going by rank. The rows stay distributed: they are ranked
inside (length, task) groups and look their rank up in the plan, of a few thousand rows.
"""

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialib.llm.steps import Steps
from medialib.llm.tokens import END, coder, default_path

CAPACITY = 4096


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, task, row)``: each document's ids, cut only where too long."""

    def work(batches):
        code, task, row = coder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), code.texts(b.column("t")), strict=True):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    out.append((doc, piece, start, len(part), zlib.crc32(part.tobytes()), task, row))
                    row += 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(),
                     pa.int64(), pa.int32(), pa.int64()), strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "row"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, row bigint")


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 among the pieces of one length, without gathering a length: counts of (length, task) give
    each task its first rank, and rows are numbered inside their own task."""
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (pieces.groupBy("length", "task").count()
              .withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"))
    inside = Window.partitionBy("length", "task").orderBy("row")
    return (pieces.withColumn("rank", F.row_number().over(inside) - 1).join(firsts, ["length", "task"])
            .withColumn("rank", F.col("first") + F.col("rank")).drop("first"))


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """Where each (length, rank) goes, as runs: ranks from ``rank`` on, ``fit`` of them a sequence, the first one in
    ``sequence`` at ``offset``. Returns the runs and the number of sequences."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # size of gap: runs of (first sequence, how many)
    sizes: list[int] = []
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def give_back(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        updates = []
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                gap, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            else:
                gap = sizes[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            fit = gap // length
            full = min(count, left // fit)
            rest = min(left - full * fit, fit) if full < count else 0
            out.append((length, rank, first, capacity - gap, fit))
            updates.append((gap - fit * length, first, full))
            if rest:
                updates.append((gap - rest * length, first + full, 1))
            updates.append((gap, first + full + bool(rest), count - full - bool(rest)))
            left -= full * fit + rest
            rank += full * fit + rest
        for u in updates:
            give_back(*u)
    columns = list(zip(*out, strict=True)) if out else [()] * 5
    names = ("length", "rank", "sequence", "offset", "fit")
    return {n: np.asarray(c, np.int64) for n, c in zip(names, columns, strict=True)}, opened


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece of a document.

    A document is its ids and one end id; only longer ones are cut, into pieces of ``capacity`` ids. Sequences hold
    pieces without gaps from offset 0 and at most ``capacity`` ids. The result is that of best-fit decreasing over the
    whole table. Null or empty text: the end id alone. Null ids, repeated rows: every row is packed. Equal lengths go
    by task and row, so another split of the input may place them otherwise, in as many sequences. Empty table: no
    rows. Further columns are not looked at.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "packing")
    pieces = steps.settle(token_pieces(docs, id_col, text_col, capacity, tokenizer or default_path()), "pieces")
    # At most ``capacity`` rows, whatever the table's size.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, _ = plan(counts, capacity)
    order = np.lexsort((runs["rank"], runs["length"]))
    runs = {k: v[order] for k, v in runs.items()}
    step = np.int64(1) << np.int64(48)
    keys = runs["length"] * step + runs["rank"]

    def work(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * step + rank, "right") - 1
            k = rank - runs["rank"][at]
            fit = runs["fit"][at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(runs["sequence"][at] + k // fit), pa.array(runs["offset"][at] + k % fit * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
