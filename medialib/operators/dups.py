"""Near-duplicate clips: candidate pairs, sets, the copy to keep and why, content lookup, suppression."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialib.functions.ranking import top_k
from medialib.functions.when import DAY, ts
from medialib.operators.components import connected_components
from medialib.operators.simjoin import near_fingerprints
from medialib.session import Rounds, settle

SAME_CONTENT, ALMOST_EXACT = 6, 3
WINDOW = 7 * DAY
RATIO_LOW, RATIO_HIGH = 0.75, 1.34
CELL = ["library_id", "folder"]
#: Pairs of linked clips up to which one task walks them; it reads them in order and holds one entry a clip.
WALK = 1_000_000


def _profiles(clips: DataFrame) -> DataFrame:
    """Clips that no rule can tell apart (folder, fingerprint, length, second) as one row each."""
    return (clips.where(F.coalesce("phash", F.lit(0)) != 0)
            .groupBy("library_id", F.lower("folder_name").alias("folder"), "phash",
                     "duration_ms", "date_added_sec")
            .agg(F.count("*").alias("copies"), F.min("id").alias("node")))


def similar_length(a: Column, b: Column) -> Column:
    """a : b within .75 to 1.34, or either unknown. Not symmetric: 1.334 passes one way only."""
    return (a <= 0) | (b <= 0) | F.try_divide(a, b).between(RATIO_LOW, RATIO_HIGH)


def duplicate_pairs(clips: DataFrame) -> DataFrame:
    """Directed candidate edges ``(library_id, folder, a, b, distance, copies_a, copies_b)``.

    Nodes are groups of indistinguishable clips, named by their lowest id; an edge
    a to b says every clip of b is a mate of every clip of a. A group of several
    clips has an edge to itself. The seven-day window is an equi-join on week
    cells with the two neighbours, then the exact test.
    """
    p = _profiles(clips)
    near = near_fingerprints(p.withColumnRenamed("phash", "asked"), p, SAME_CONTENT, CELL)
    week = F.floor(F.col("date_added_sec") / WINDOW)
    left = p.select(*CELL, F.col("phash").alias("asked"), F.col("node").alias("a"),
                    F.col("copies").alias("copies_a"), F.col("duration_ms").alias("_da"),
                    F.col("date_added_sec").alias("_ta"),
                    F.explode(F.array(week - 1, week, week + 1)).alias("_w"))
    right = p.select(*CELL, "phash", F.col("node").alias("b"), F.col("copies").alias("copies_b"),
                     F.col("duration_ms").alias("_db"), F.col("date_added_sec").alias("_tb"),
                     week.alias("_w"))
    return (left.join(near, [*CELL, "asked"]).join(right, [*CELL, "phash", "_w"])
            .where((F.abs(F.col("_ta") - F.col("_tb")) < WINDOW)
                   & similar_length(F.col("_da"), F.col("_db"))
                   & ((F.col("a") != F.col("b")) | (F.col("copies_a") > 1)))
            .select(*CELL, "a", "b", "distance", "copies_a", "copies_b",
                    F.col("_ta").alias("time_a"), F.col("_tb").alias("time_b")))


def _members(clips: DataFrame, groups: DataFrame) -> DataFrame:
    """Give every clip the set of its group: ``groups`` is (library_id, node, set_id)."""
    nodes = _profiles(clips).join(groups, ["library_id", "node"]).drop("copies", "node")
    keyed = clips.withColumn("folder", F.lower("folder_name"))
    return keyed.join(nodes, ["library_id", "folder", "phash", "duration_ms", "date_added_sec"]).drop("folder")


def duplicate_components(clips: DataFrame) -> DataFrame:
    """Clips of duplicate sets, a set being everything linked by candidate pairs; adds ``set_id``."""
    edges = settle(duplicate_pairs(clips), "dup-pairs")
    linked = connected_components(edges, "a", "b").select(
        "library_id", "node", F.col("component").alias("set_id"))
    alone = (edges.where("a = b").select("library_id", F.col("a").alias("node"))
             .join(linked, ["library_id", "node"], "left_anti")
             .withColumn("set_id", F.col("node")))
    return _members(clips, linked.unionByName(alone))


def duplicate_sets(clips: DataFrame, walk: int = WALK) -> DataFrame:
    """Clips of duplicate sets as a walk in date order forms them; adds ``set_id``.

    In order of date (then id) every clip not yet taken takes all its untaken
    mates. Clips that no chain of mates links cannot affect each other, so linked
    clips are labelled first; those with up to ``walk`` pairs are walked as they
    are, many groups a task in one pass over sorted pairs, and only larger ones in rounds.
    """
    edges = settle(duplicate_pairs(clips).select(
        "library_id", "folder", "a", "b", F.col("time_a").alias("t")), "dup-pairs")
    linked = connected_components(edges.where("a <> b"), "a", "b").select("library_id", F.col("node").alias("a"), "component")
    named = settle(edges.join(linked, ["library_id", "a"], "left").withColumn("component", F.coalesce("component", "a"))
                   .where("a IS NOT NULL AND b IS NOT NULL"), "dup-named")
    many = named.groupBy("library_id", "component").agg(F.count("*").alias("_n")).where(F.col("_n") > walk).select("library_id", "component")
    small = _walked(named.join(many, ["library_id", "component"], "left_anti"))
    large = named.join(many, ["library_id", "component"], "left_semi")
    if large.isEmpty():
        return _members(clips, small)
    return _members(clips, settle(small, "dup-walked").unionByName(_sets_in_rounds(large, walk)))


def _walked(pairs: DataFrame) -> DataFrame:
    return (pairs.select("library_id", "component", "t", "a", "b").repartition("library_id", "component")
            .sortWithinPartitions("library_id", "component", "t", "a")
            .mapInArrow(_walk_sets, "library_id string, node bigint, set_id bigint"))


def _walk_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The walk over pairs that come by linked clips, then by turn: ``(library_id, node, set_id)``.

    Only the owners of one group of linked clips are held, never its pairs.
    """
    owner: dict[int, int] = {}
    here = turn = None
    free, done = False, ([], [], [])

    def close():
        for out, more in zip(done, ([here[0]] * len(owner) if here else [], owner, owner.values()), strict=True):
            out.extend(more)

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(done, (pa.string(), pa.int64(), pa.int64()), strict=True)],
                                          ["library_id", "node", "set_id"])

    for batch in batches:
        for library, component, t, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if here != (library, component):
                close()
                owner, here, turn = {}, (library, component), None
            if turn != (t, a):
                turn, free = (t, a), a not in owner
            if free and b not in owner:
                owner[b] = owner[a] = a
        yield flush()
        done = ([], [], [])
    close()
    yield flush()


def _sets_in_rounds(pairs: DataFrame, walk: int) -> DataFrame:
    """The same for linked clips of any number, until ``walk`` pairs are left of all, which are walked.

    A clip's turn can be settled once no earlier unsettled clip could take it or
    share a mate with it, so each round settles every such clip of all libraries
    at once; a set is never gathered in one task. Settled clips leave with all their
    pairs, so the walk over what is left goes on where the rounds end.
    """
    rounds = Rounds(pairs.sparkSession, "dup-edges")
    edges = rounds.settle(pairs.select("library_id", "component", "a", "b", F.struct("t", F.col("a").alias("n")).alias("turn")))
    taken = None
    while taken is None or edges.count() > walk:
        # The earliest unsettled clip that could claim each target, itself included.
        selves = edges.select("library_id", "a", "turn").distinct()
        claims = edges.select("library_id", F.col("b").alias("node"), "turn").unionByName(
            selves.select("library_id", F.col("a").alias("node"), "turn"))
        first = claims.groupBy("library_id", "node").agg(F.min("turn").alias("_first"))
        asks = edges.select("library_id", "a", F.col("b").alias("node"), "turn").unionByName(
            selves.select("library_id", "a", F.col("a").alias("node"), "turn"))
        leaders = (asks.join(first, ["library_id", "node"])
                   .groupBy("library_id", "a").agg(F.min(F.col("_first") == F.col("turn")).alias("_ready"))
                   .where("_ready").select("library_id", "a"))
        won = edges.join(leaders, ["library_id", "a"]).select(
            "library_id", F.col("b").alias("node"), F.col("a").alias("set_id"))
        own = leaders.select("library_id", F.col("a").alias("node"), F.col("a").alias("set_id"))
        step = settle(won.unionByName(own).distinct(), "dup-round")
        taken = step if taken is None else taken.unionByName(step)
        gone = step.select("library_id", "node")
        edges = rounds.settle(
            edges.join(gone.withColumnRenamed("node", "a"), ["library_id", "a"], "left_anti")
            .join(gone.withColumnRenamed("node", "b"), ["library_id", "b"], "left_anti"))
    return taken.unionByName(_walked(edges.withColumn("t", F.col("turn.t"))))


def keepers(members: DataFrame) -> DataFrame:
    """One row per set: the clip to keep, how many go, and the bytes they free.

    Sharpest, then most finished, most smiles, largest frame, most watched, then
    first by date and id. Expects engagement columns.
    """
    order = F.struct(F.col("sharpness").alias("o1"), F.col("avg_completion").alias("o2"),
                     F.col("smile_count").alias("o3"),
                     (F.col("width").cast("bigint") * F.col("height")).alias("o4"),
                     F.col("watch_count").alias("o5"),
                     (-F.col("date_added_sec")).alias("o6"), (-F.col("id")).alias("o7"))
    kept = F.struct("id", "size_bytes", "sharpness", "smile_count", "avg_completion")
    sets = members.groupBy("library_id", "set_id").agg(
        F.count("*").alias("members"), F.max_by(kept, order).alias("_k"),
        F.sum("size_bytes").alias("_bytes"), F.sum("smile_count").alias("_smiles"),
        F.max("sharpness").alias("_sharpest"))
    return sets.select(
        "library_id", "set_id", F.col("_k.id").alias("keeper_id"), "members",
        (F.col("_bytes") - F.col("_k.size_bytes")).alias("savings_bytes"),
        (F.col("_smiles") - F.col("_k.smile_count")).alias("other_smiles"),
        (F.col("_sharpest") > F.col("_k.sharpness")).alias("beaten"),
        F.col("_k.smile_count").alias("keeper_smiles"), F.col("_k.avg_completion").alias("keeper_completion"))


def keeper_reason(sets: DataFrame) -> DataFrame:
    """Adds the sentence saying why the kept clip was kept, judged against its own set."""
    others, sharper = F.col("other_smiles"), F.col("beaten")
    return sets.withColumn("reason", F.when((others == 0) & ~sharper, "The only one of its kind")
                           .when((others > 0) & (F.col("keeper_smiles") >= others), "Everyone in it is smiling")
                           .when(~sharper, "The sharpest frame")
                           .when(F.col("keeper_completion") > 0.6, "The one you actually finished")
                           .otherwise("Best overall quality"))


def media_library(clips: DataFrame, photos: DataFrame) -> DataFrame:
    """Clips and photos as one table of fingerprints with what a verdict needs."""
    cols = ["library_id", "id", "phash", "folder_name", "date_added_sec"]
    return (clips.select(*cols, F.lit("clip").alias("kind"))
            .unionByName(photos.select(*cols, F.lit("photo").alias("kind"))))


def content_match(queries: DataFrame, library: DataFrame, k: int = SAME_CONTENT, top: int = 12) -> DataFrame:
    """Best items per query: ``queries`` is (query_id, library_id, frame_no, phash).

    Distance is the least over a query's frames. Of items bearing one fingerprint
    only the first ``top`` by id can place, so a mass of copies is cut before the join.
    """
    frames = queries.where(F.coalesce("phash", F.lit(0)) != 0).select(
        "query_id", "library_id", F.col("phash").alias("asked"))
    near = near_fingerprints(frames, library, k)
    by_id = [F.asc("id"), F.asc("kind")]
    first = top_k(library.where(F.coalesce("phash", F.lit(0)) != 0), ["library_id", "phash"], by_id, top, "_r")
    best = (frames.join(near, ["library_id", "asked"])
            .groupBy("query_id", "library_id", "phash").agg(F.min("distance").alias("distance")))
    hits = best.join(first.drop("_r"), ["library_id", "phash"])
    return top_k(hits, ["query_id", "library_id"], [F.asc("distance"), *by_id], top)


def content_verdict(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """One sentence per query: what and where its best match is, or that it is new."""
    asked = queries.groupBy("query_id", "library_id").agg(
        F.count_if(F.coalesce("phash", F.lit(0)) != 0).alias("_frames"))
    best = matches.where("rank = 1").select("query_id", "library_id", "distance", "kind", "id",
                                            "folder_name", "date_added_sec")
    near = F.when(F.col("distance") <= ALMOST_EXACT, "an almost-exact copy of").otherwise("looks like")
    text = F.concat(F.lit("This is "), near, F.lit(" your "), F.col("kind"), F.lit(' in "'),
                    F.col("folder_name"), F.lit('" — '), F.date_format(ts("date_added_sec"), "MMM d, yyyy"))
    verdict = (F.when(F.col("_frames") == 0, "Couldn't read that file's frames — nothing to match against")
               .when(F.col("id").isNull(), "Not in your library yet — this file is new to you").otherwise(text))
    return asked.join(best, ["query_id", "library_id"], "left").select(
        "query_id", "library_id", "id", "distance", verdict.alias("verdict"))


def suppression(dismissals: DataFrame, clips: DataFrame, k: int = SAME_CONTENT) -> DataFrame:
    """Dismissed clips and everything within ``k`` bits of one, one hop, whatever the folder."""
    gone = dismissals.select("library_id", F.col("video_id").alias("id")).distinct()
    seeds = clips.join(gone, ["library_id", "id"], "left_semi").select(
        "library_id", F.col("phash").alias("asked"))
    near = near_fingerprints(seeds, clips, k).select("library_id", "phash").distinct()
    spread = clips.join(near, ["library_id", "phash"], "left_semi").select("library_id", "id")
    return gone.unionByName(spread).distinct()
