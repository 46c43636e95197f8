"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all signature coordinates: the first scatters the shingles over ``DOMAIN`` places, the second
orders the places, and coordinate k is the least order met when the second is shifted circularly by k (C-MinHash,
Li and Li 2021). With 24 bands of 5 rows a pair of similarity .85 misses every band once in 1.3 million.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialib.llm.arrays import blocks, lists, mix, ngram_hash, signed
from medialib.llm.steps import Steps
from medialib.operators.components import connected_components

DOMAIN_BITS = 20
BANDS, ROWS = 24, 5


@lru_cache(2)
def _circle(coordinates: int) -> np.ndarray:
    """Row x holds the orders that coordinates 0, 1, ... give place x: the second permutation read on from x."""
    order = np.random.RandomState(20_211).permutation(1 << DOMAIN_BITS).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:coordinates]]), coordinates)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; shorter texts are one shingle, empty ones none."""
    for block in blocks(column, fold=True):
        words = block.word_hash()
        for lo, hi in zip(block.first[:-1], block.first[1:], strict=True):
            yield np.unique(ngram_hash(words[lo:hi], min(n, hi - lo))) if hi > lo else words[:0]


def set_id(hashes: np.ndarray) -> int:
    """Name of a set: equal sets share it."""
    return int(mix(np.asarray([mix(hashes, 7).sum() + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    circle = _circle(coordinates)
    places = (mix(hashes, 11) >> np.uint64(64 - DOMAIN_BITS)).astype(np.int64)
    parts = [circle[places[i:i + 4096]].min(axis=0) for i in range(0, len(places), 4096)]
    return parts[0] if len(parts) == 1 else np.minimum.reduce(parts)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    kept = ngram_hash_rows(sig.astype(np.uint64).reshape(bands, rows))
    return signed(mix(kept + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3))


def ngram_hash_rows(table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(table), np.uint64)
    for k in range(table.shape[1]):
        out = mix(out + table[:, k], k)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, hash, n_shingles, set_id, bands)`` of every row, ``hash`` being ``xxhash64`` of its text; ``bands`` is empty for an empty set."""

    def work(batches):
        for b in batches:
            sizes, names, keys = [], [], []
            for s in shingle_sets(b.column("t"), shingle):
                sizes.append(len(s))
                names.append(set_id(s) if len(s) else None)
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("hash"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), lists(keys, pa.int64())],
                ["doc_id", "hash", "n_shingles", "set_id", "bands"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t")).withColumn("hash", F.xxhash64("t")).mapInArrow(
        work, "doc_id bigint, hash bigint, n_shingles bigint, set_id bigint, bands array<bigint>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``(set_id, items)``: the sorted shingle hashes of each distinct set among ``docs(doc_id, t)``."""

    def work(batches):
        for b in batches:
            found = list(shingle_sets(b.column("t"), shingle))
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in found], pa.int64()), lists([signed(s) for s in found], pa.int64())],
                ["set_id", "items"])

    return docs.select("t").mapInArrow(work, "set_id bigint, items array<bigint>").dropDuplicates(["set_id"])


def _left_over(tried: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of one hub's spokes that may still be linked though not both are linked to the hub.

    With D the difference of a set from the hub, two sets differ in D(a) ^ D(b). Linked ones differ in at most T =
    (100 - percent) / (100 + percent) of their joint size, and a set not linked to the hub has more in D than T with
    the hub's size in place of the other's. So the two share over half of the other's D, less the slack that sizes
    give, and one of that other's rarest shingles, as many as it need not share and one more, is among them; how many
    follows from both D. Sets with edits of their own share none of these, however large the group.
    """
    limit = (100 - percent) / (100 + percent)
    size = sets.select(F.col("set_id").alias("own"), F.col("n_shingles").alias("n"))
    component = found.withColumnRenamed("node", "own")
    spokes = (tried.join(size, "own").join(component, "own", "left").withColumn("component", F.coalesce("component", "own")))
    mixed = (spokes.groupBy("hub").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
             .where("c0 < c1").select("hub"))
    hub_size = sets.select(F.col("set_id").alias("hub"), F.col("n_shingles").alias("hub_n"))
    spokes = spokes.join(mixed, "hub").join(hub_size, "hub")
    flat = spokes.select("hub", "own", "linked", "n", "hub_n", "component", F.size("apart").alias("d"),
                         F.explode("apart").alias("item"))
    rarity = flat.groupBy("hub", "item").agg(F.count("*").alias("f")).where("f > 1")
    # Shingles of one spoke alone tie nothing, but stand first in its order.
    order = (flat.join(rarity, ["hub", "item"]).groupBy("hub", "own", "n", "hub_n", "component", "d")
             .agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("common")))
    need = F.ceil((F.col("d") + limit * (F.col("hub_n") - F.col("n")) - 1e-6) / 2).cast("int")
    alone = F.col("d") - F.size("common")
    first = F.slice("common", 1, F.greatest(F.lit(0), F.col("d") - F.greatest(F.lit(1), need) + 1 - alone))
    offered = order.select("hub", F.col("own").alias("x"), F.col("n").alias("nx"), F.col("d").alias("dx"),
                           F.col("component").alias("cx"), alone.alias("alone"), F.posexplode(first).alias("pos", "c")).select(
        "hub", "x", "nx", "dx", "cx", (F.col("alone") + F.col("pos")).alias("place"), F.col("c.item").alias("item"))
    asking = flat.where("not linked").select("hub", F.col("own").alias("y"), F.col("n").alias("ny"), F.col("d").alias("dy"),
                                             F.col("component").alias("cy"), "item")
    share = F.ceil((F.col("dx") + F.col("dy") - limit * (F.col("nx") + F.col("ny")) - 1e-6) / 2)
    met = offered.join(asking, ["hub", "item"]).where(
        (F.col("x") != F.col("y")) & (F.col("cx") != F.col("cy")) & (F.col("place") <= F.col("dx") - F.greatest(F.lit(1), share))
        & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    done = tried.select(F.least("hub", "own").alias("a"), F.greatest("hub", "own").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    percent: int = 85, bands: int = BANDS, rows: int = ROWS, hash_col: str | None = None,
                    group_col: str | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row; ``hash_col`` adds ``xxhash64`` of its text,
    ``group_col`` a name of its component that differs even where one id has texts of several components.

    Texts are linked where ``100 * |A & B| >= percent * |A | B|`` over their sets of distinct lower-cased (A-Z)
    ``shingle``-word shingles; a component is named by the smallest id reachable. Equal sets are one node, so masses
    of copies cost one row. In every bucket each set is verified against one hub, and of the other pairs only those
    are verified that may still link two components (see ``_left_over``): no pair that shares a bucket is left out,
    and no group is expanded into pairs.

    Null or empty text: empty set, its own component. Null id: a row of its own with null component, kept. Repeated
    rows: each is returned, with equal results. Rows with one id but different texts: each row has the component of its own text. Ties can't
    arise, as ids name components. Columns besides the two named are not looked at.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "near-dup")
    sig = steps.settle(signatures(docs, id_col, text_col, shingle, bands, rows), "signatures")
    sets = (sig.where("set_id is not null and doc_id is not null").groupBy("set_id", "n_shingles")
            .agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")))
    sets = steps.settle(sets, "sets")

    entries = sets.select("set_id", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = steps.settle(entries.join(shared, "key"), "buckets")
    # The hub of a bucket: its set with most bucket mates overall, which near-copies of one text gather around.
    crowd = live.groupBy("set_id").agg(F.sum("n").alias("mates"))
    hubs = live.join(crowd, "set_id").groupBy("key").agg(F.max(F.struct("mates", "set_id")).alias("h")).select(
        "key", F.col("h.set_id").alias("hub"))
    spokes = live.join(hubs, "key").where("set_id <> hub").select("hub", F.col("set_id").alias("own")).distinct()
    spokes = steps.settle(spokes, "spokes")
    nodes = spokes.select(F.explode(F.array("hub", "own")).alias("set_id")).distinct()
    reps = nodes.join(sets.select("set_id", "rep"), "set_id").select("rep").distinct()
    texts = docs.select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).alias("t")).join(reps, "rep", "left_semi")
    items = steps.settle(_sets(texts, shingle), "items")

    def compared(pairs: DataFrame, a: str, b: str) -> DataFrame:
        """``pairs`` with both sets, ``common`` and ``linked``."""
        both = (pairs.join(items.select(F.col("set_id").alias(b), F.col("items").alias("ib")), b)
                .join(items.select(F.col("set_id").alias(a), F.col("items").alias("ia")), a))
        both = both.withColumn("common", F.size(F.array_intersect("ia", "ib")))
        return both.withColumn("linked", F.col("common") * 100 >= (F.size("ia") + F.size("ib") - F.col("common")) * percent)

    # Every set against the hubs of its buckets, with the shingles the two don't share.
    apart = F.concat(F.array_except("ib", "ia"), F.array_except("ia", "ib"))
    tried = steps.settle(compared(spokes, "hub", "own").select("hub", "own", "linked", apart.alias("apart")), "tried")
    links = tried.where("linked").select(F.col("hub").alias("a"), F.col("own").alias("b"))
    found = connected_components(links, "a", "b", keys=())
    more = steps.settle(compared(steps.settle(_left_over(tried, sets, found, percent), "rest"), "a", "b")
                        .where("linked").select("a", "b"), "more")
    if not more.isEmpty():
        found = connected_components(links.unionByName(more), "a", "b", keys=())
    steps.clear("items", "buckets", "rest")

    # Names by smallest document id, then back to the rows.
    named = (sets.select("set_id", "rep").join(found.withColumnRenamed("node", "set_id"), "set_id", "left")
             .withColumn("component", F.coalesce("component", "set_id")))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_set = named.join(least, "component").select("set_id", "component", "component_id")
    out = sig.select("doc_id", "hash", "n_shingles", "set_id").join(by_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
                      *([F.col("hash").alias(hash_col)] if hash_col else []),
                      *([F.coalesce("component", "hash").alias(group_col)] if group_col else []))
