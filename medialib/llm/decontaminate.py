"""Benchmark decontamination by winnowing.

Of every window of ``WINDOW`` consecutive k-gram hashes the least is kept as a fingerprint (Schleimer et al. 2003), so
any ``k + WINDOW - 1`` words that a document and an item share hold a fingerprint both have kept, at the same place of
the shared span. With k + WINDOW - 1 = 10 no shared window of ten words is missed. Hits are then extended word by word
in both directions, and only runs as long as a window count.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialib.llm.arrays import ALNUM, blocks, lists, ngram_hash, signed
from medialib.llm.steps import Steps

SPAN = 10


def split_span(span: int) -> tuple[int, int]:
    """k and window of the winnowing that guarantees every shared run of ``span`` words."""
    window = max(1, (span + 1) // 2)
    return span - window + 1, window


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every window, the last of equal ones; fewer hashes than a window give none."""
    count = len(hashes) - window + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(count) + window - 1 - view.argmin(axis=1))


def fingerprints(table: DataFrame, key: str, text_col: str, spans: list[int], own_span: int | None) -> DataFrame:
    """``(key, span, print, place)``: the winnowed fingerprints of each text for each guaranteed span.

    ``own_span``: for items, whose only span is that or their own length if they are shorter.
    """

    def work(batches):
        for b in batches:
            rows, span_of, prints, places = [], [], [], []
            for block in blocks(b.column("t"), ALNUM, fold=True):
                words = block.word_hash()
                bounds = block.first
                for span in spans:
                    k, window = split_span(span)
                    grams = ngram_hash(words, k)
                    for i in range(block.texts):
                        lo, hi = bounds[i], bounds[i + 1]
                        if hi - lo < span or own_span and span != min(own_span, hi - lo):
                            continue
                        at = winnow(grams[lo:hi - k + 1], window)
                        rows.append(np.full(len(at), block.lo + i))
                        span_of.append(np.full(len(at), span, np.int32))
                        prints.append(signed(grams[lo:hi - k + 1][at]))
                        places.append(at.astype(np.int32))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column(key).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(span_of)),
                     pa.array(np.concatenate(prints)), pa.array(np.concatenate(places))],
                    [key, "span", "print", "place"])

    return table.mapInArrow(work, f"{key} bigint, span int, print bigint, place int")


def _items(bench: DataFrame) -> DataFrame:
    """``(item, words, n)``: the word hashes of each item that has a word."""

    def work(batches):
        for b in batches:
            found = []
            for block in blocks(b.column("t"), ALNUM, fold=True):
                words = block.word_hash()
                found += [signed(words[lo:hi]) for lo, hi in zip(block.first[:-1], block.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("item"), lists(found, pa.int64()), pa.array([len(x) for x in found], pa.int32())],
                ["item", "words", "n"])

    return bench.mapInArrow(work, "item bigint, words array<bigint>, n int").where("n > 0 and item is not null")


def _spread(doc: np.ndarray, item: np.ndarray, at: int, place: int) -> tuple[int, int]:
    """Bounds in ``doc`` of the longest run of equal words around place ``at`` (``place`` in the item)."""
    back = min(at, place)
    same = doc[at - back:at][::-1] == item[place - back:place][::-1]
    lo = at - (back if same.all() else int(same.argmin()))
    ahead = min(len(doc) - at, len(item) - place)
    same = doc[at:at + ahead] == item[place:place + ahead]
    return lo, at + (ahead if same.all() else int(same.argmin()))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", span: int = SPAN,
                  hash_col: str | None = None) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans)``, one row per input row; ``hash_col`` adds ``xxhash64`` of its text.

    Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased in A-Z. A window is ``span``
    consecutive item words, or all words of a shorter item. ``spans`` lists the maximal runs of document words inside
    occurrences of windows as [from, to) word places, ``n_hit`` counts their words, ``items`` holds the ids of items
    with an occurring window, sorted as strings.

    Null or empty text: no words, no hits. Item without words or id: ignored. Null doc id: its row is returned with
    its word count and no hits. Repeated rows: each is returned, with equal results. Empty tables: no hits, or no
    rows. Further columns are not looked at.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "decontaminate")
    asked = bench.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("t")).dropDuplicates()
    items = steps.settle(_items(asked).withColumn("item_row", F.xxhash64("item", "words")), "items")
    # Spans in use: the full one and the lengths of shorter items, so at most ``span`` of them.
    spans = sorted(r[0] for r in items.select(F.least("n", F.lit(span))).distinct().limit(span).collect())
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("t")).withColumn(
        "hash", F.xxhash64("t"))
    asked_prints = steps.settle(
        fingerprints(asked.where("item is not null").withColumnRenamed("item", "doc"), "doc", "t", spans, span)
        .withColumnRenamed("doc", "item").select("item", "span", "print", F.col("place").alias("item_place")).distinct(), "prints")
    met = (fingerprints(texts.where("doc is not null").select("doc", "t"), "doc", "t", spans, None)
           .join(asked_prints, ["span", "print"]).select("doc", "item", "place", "item_place").distinct())
    # One row a document: its meetings, bounded by its own words times the items they belong to.
    met = (met.groupBy("doc", "item", (F.col("place") - F.col("item_place")).alias("shift"))
           .agg(F.collect_set("item_place").alias("places"))
           .join(items.select("item", "words", "n"), "item")
           .groupBy("doc").agg(F.collect_list(F.struct("item", "shift", "places", "words")).alias("met")))
    met = steps.settle(met, "met")

    def extend(batches):
        for b in batches:
            n_hit, ids, runs = [], [], []
            met_rows = b.column("met")
            for block in blocks(b.column("t"), ALNUM, fold=True):
                hashes = signed(block.word_hash())
                for i in range(block.texts):
                    words = hashes[block.first[i]:block.first[i + 1]]
                    hit, by = np.zeros(len(words) + 1, np.int64), set()
                    for m in met_rows[block.lo + i].as_py():
                        item, shift = np.asarray(m["words"], np.int64), m["shift"]
                        seen = -1
                        for place in sorted(m["places"]):
                            # A row of the same id with another text may not hold this meeting.
                            if place < seen or place + shift >= len(words):
                                continue
                            lo, hi = _spread(words, item, place + shift, place)
                            seen = hi - shift
                            if hi - lo >= min(span, len(item)):
                                hit[lo] += 1
                                hit[hi] -= 1
                                by.add(str(m["item"]))
                    inside = np.cumsum(hit)[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
                    n_hit.append(int(inside.sum()))
                    ids.append(sorted(by))
                    runs.append([{"from": int(x), "to": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), b.column("hash"), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())),
                 pa.array(runs, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))],
                ["doc", "hash", "n_hit", "items", "spans"])

    def count(batches):
        for b in batches:
            n = [np.diff(block.first) for block in blocks(b.column("t"), ALNUM, fold=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), b.column("hash"), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))],
                ["doc", "hash", "n_words"])

    # Texts of documents with a meeting are picked by their ids first, a table of one number a document, so that the
    # others' texts are only shuffled where even those ids are too many to broadcast.
    picked = texts.join(steps.settle(met.select("doc"), "ids"), "doc", "left_semi").join(met, "doc")
    found = picked.mapInArrow(
        extend, "doc bigint, hash bigint, n_hit bigint, items array<string>, spans array<struct<from:int,to:int>>")
    found = steps.settle(found.dropDuplicates(["doc", "hash"]).where("n_hit > 0"), "found")
    rows = texts.mapInArrow(count, "doc bigint, hash bigint, n_words bigint").join(found, ["doc", "hash"], "left")
    return rows.select(
        F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")).alias("spans"),
        *([F.col("hash").alias(hash_col)] if hash_col else []))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``decontaminate``."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], span: int = SPAN) -> list[tuple]:
    """The same by comparing every window with every place; for tests."""
    def words(t):
        out, now = [], []
        for ch in t or "":
            ch = chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
            if "0" <= ch <= "9" or "a" <= ch <= "z" or ord(ch) >= 0x80:
                now.append(ch)
            elif now:
                out.append("".join(now))
                now = []
        return out + (["".join(now)] if now else [])

    asked = [(i, words(t)) for i, t in items if i is not None]
    rows = []
    for d, t in docs:
        own, hit, by = words(t), set(), set()
        for item, w in asked:
            size = min(span, len(w))
            for j in range(len(w) - size + 1 if size else 0):
                for at in range(len(own) - size + 1):
                    if own[at:at + size] == w[j:j + size]:
                        hit.update(range(at, at + size))
                        by.add(str(item))
        joined = ",".join(sorted(by))
        rows.append((d, len(own), len(hit), len(by), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return rows
