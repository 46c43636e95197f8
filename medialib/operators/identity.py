"""Who is who: matching vectors to persons, repairing fragments and mixtures, and human corrections."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialib.functions.ranking import sliced_position, top_k
from medialib.functions.text import blank, first_upper, strip_extension
from medialib.operators.components import connected_components
from medialib.operators.ontology import GENERIC_WORDS
from medialib.operators.simjoin import (
    best_two_persons, blocked, cosine_pairs, normalised, person_links, sliced)
from medialib.operators.vectorbuckets import cosine_pairs_buckets
from medialib.session import settle

MATCH_SIM, MATCH_MARGIN = 0.42, 0.05
ADOPT_SIM, ADOPT_MARGIN = 0.50, 0.08
MERGE_SIM, CLUSTER_SIM = 0.45, 0.55
SPLIT_MIN_VECTORS, SPLIT_SEPARATION, SPLIT_WITHIN, SPLIT_ROUNDS = 6, 0.25, 0.35, 12
ONE_TASK = 2_000


def cosine_clusters(vectors: DataFrame, threshold: float = CLUSTER_SIM, recall: float | None = None) -> DataFrame:
    """Single-linkage clusters ``(library_id, id, cluster)``; -1 for vectors on their own.

    ``recall``: pairs by buckets, of which that share is found at least; None compares all with all.
    """
    pairs = cosine_pairs(vectors, threshold) if recall is None else cosine_pairs_buckets(vectors, threshold, recall)
    linked = connected_components(pairs, "a", "b").select(
        "library_id", F.col("node").alias("id"), F.col("component").alias("cluster"))
    return vectors.select("library_id", "id").join(linked, ["library_id", "id"], "left").withColumn(
        "cluster", F.coalesce("cluster", F.lit(-1).cast("bigint")))


def with_denials(asking: DataFrame, denials: DataFrame) -> DataFrame:
    """Attach to each vector the persons the user ruled out for its clip."""
    deny = denials.groupBy("library_id", "video_id").agg(F.collect_set("person_id").alias("deny"))
    return asking.join(deny, ["library_id", "video_id"], "left")


def match(asking: DataFrame, stored: DataFrame, min_sim: float = MATCH_SIM,
          min_margin: float = MATCH_MARGIN) -> DataFrame:
    """Decision per asking vector: ``(library_id, id, person_id, ambiguous, best, margin)``.

    A person counts by its most similar vector. Below ``min_sim`` nobody; too close
    to the runner-up ambiguous; where one person competes the runner-up counts 0.
    """
    scores = best_two_persons(asking, stored.where("person_id >= 0"))
    two = top_k(scores, ["library_id", "id"], [F.desc("sim"), F.asc("person_id")], 2, "_r")
    d = two.groupBy("library_id", "id").agg(
        F.max(F.when(F.col("_r") == 1, F.col("sim"))).alias("best"),
        F.max(F.when(F.col("_r") == 1, F.col("person_id"))).alias("_p"),
        F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("sim"))), F.lit(0.0)).alias("_second"))
    d = asking.select("library_id", "id").join(d, ["library_id", "id"], "left").withColumn(
        "margin", F.coalesce(F.col("best") - F.col("_second"), F.lit(0.0)))
    close = (F.col("best") >= min_sim) & (F.col("margin") < min_margin)
    sure = (F.col("best") >= min_sim) & (F.col("margin") >= min_margin)
    return d.select("library_id", "id", F.when(sure, F.col("_p")).otherwise(-1).alias("person_id"),
                    F.coalesce(close, F.lit(False)).alias("ambiguous"),
                    F.coalesce("best", F.lit(0.0)).alias("best"), "margin")


def assign_or_create(fresh: DataFrame, stored: DataFrame, persons: DataFrame, denials: DataFrame,
                     min_sim: float = MATCH_SIM, min_margin: float = MATCH_MARGIN) -> DataFrame:
    """``(library_id, id, person_id, created)`` for vectors that just arrived.

    Clear matches go to their person, ambiguous ones to nobody (-1). The rest are
    clustered among themselves and each cluster becomes a new person, so the
    result does not depend on the order of arrival.
    """
    decided = settle(match(with_denials(fresh, denials), stored, min_sim, min_margin), "matched")
    matched = decided.where((F.col("person_id") >= 0) | F.col("ambiguous")).select(
        "library_id", "id", "person_id", F.lit(False).alias("created"))
    left = fresh.join(decided.where((F.col("person_id") < 0) & ~F.col("ambiguous")), ["library_id", "id"], "left_semi")
    c = cosine_clusters(left, min_sim).withColumn(
        "cluster", F.when(F.col("cluster") < 0, F.col("id")).otherwise(F.col("cluster")))
    last = persons.groupBy("library_id").agg(F.max("id").alias("_last"))
    heads = c.select("library_id", "cluster").distinct()
    numbered = sliced_position(heads, ["library_id"], "cluster", 100_000, "_n")
    ids = numbered.join(last, "library_id", "left").select(
        "library_id", "cluster", (F.coalesce("_last", F.lit(-1)) + 1 + F.col("_n")).cast("int").alias("person_id"))
    made = c.join(ids, ["library_id", "cluster"]).select(
        "library_id", "id", "person_id", F.lit(True).alias("created"))
    return matched.unionByName(made)


def consolidate(vectors: DataFrame, above: float = MERGE_SIM) -> DataFrame:
    """``(library_id, person_id, survivor)``: persons that are one, and who remains.

    Merging the closest two until none is close joins exactly the persons that are
    linked; the one with most vectors survives, then the lowest id.
    """
    groups = connected_components(person_links(vectors, above), "a", "b").withColumnRenamed("node", "person_id")
    sizes = vectors.where("person_id >= 0").groupBy("library_id", "person_id").agg(F.count("*").alias("_n"))
    g = groups.join(sizes, ["library_id", "person_id"])
    best = g.groupBy("library_id", "component").agg(
        F.max_by("person_id", F.struct("_n", (-F.col("person_id")).alias("_o"))).alias("survivor"))
    return g.join(best, ["library_id", "component"]).select("library_id", "person_id", "survivor")


def repoint(df: DataFrame, mapping: DataFrame, to: str = "survivor") -> DataFrame:
    """Apply ``(library_id, person_id, survivor)`` to any table with a person_id."""
    m = mapping.select("library_id", "person_id", F.col(to).alias("_to"))
    return df.join(m, ["library_id", "person_id"], "left").withColumn(
        "person_id", F.coalesce("_to", "person_id")).select(*df.columns)


def adopt_unassigned(vectors: DataFrame, denials: DataFrame, min_sim: float = ADOPT_SIM,
                     min_margin: float = ADOPT_MARGIN) -> DataFrame:
    """``(library_id, id, person_id)`` for parked vectors that now have a clear owner."""
    parked = with_denials(vectors.where("person_id < 0"), denials)
    return match(parked, vectors, min_sim, min_margin).where("person_id >= 0").select(
        "library_id", "id", "person_id")


def _two_modes(unit: np.ndarray) -> tuple[int, int, float, float]:
    """Sizes of two spherical clusters, their separation and the weaker mean similarity."""
    sims = unit @ unit.T
    np.fill_diagonal(sims, 2.0)
    i, j = divmod(int(np.argmin(sims)), len(unit))
    a, b = unit[i], unit[j]
    for _ in range(SPLIT_ROUNDS):
        first = unit @ a >= unit @ b
        if first.all() or not first.any():
            return len(unit), 0, 0.0, 0.0
        a, b = unit[first].sum(0), unit[~first].sum(0)
        a, b = a / max(np.linalg.norm(a), 1e-9), b / max(np.linalg.norm(b), 1e-9)
    within = min(float((unit[first] @ a).mean()), float((unit[~first] @ b).mean()))
    return int(first.sum()), int((~first).sum()), 1.0 - float(a @ b), within


_MODES = "library_id string, person_id int, n_first bigint, n_second bigint, separation double, within double"


def _modes_in_task(units: DataFrame) -> DataFrame:
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = np.stack(pdf.sort_values("id")["unit"].to_numpy())
        return pd.DataFrame([(pdf["library_id"].iloc[0], pdf["person_id"].iloc[0], *_two_modes(unit))],
                            columns=[c.split()[0] for c in _MODES.split(", ")])
    return units.groupBy("library_id", "person_id").applyInPandas(kernel, _MODES)


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _mean_directions(units: DataFrame, by) -> DataFrame:
    """Unit mean vector per key, summed dimension by dimension."""
    sums = units.select(*by, F.posexplode("unit").alias("pos", "v")).groupBy(*by, "pos").agg(F.sum("v").alias("v"))
    return sums.groupBy(*by).agg(normalised(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])).alias("mean"))


def _modes_spread(units: DataFrame) -> DataFrame:
    """The same two clusters for persons too large for one task: every round is a grouped sum."""
    who = ["library_id", "person_id"]

    def farthest(pdf: pd.DataFrame) -> pd.DataFrame:
        q, s = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        least = None
        for part, sims in sliced(q, s) if len(s) else ():
            sims[part["id"].to_numpy()[:, None] >= s["id"].to_numpy()[None, :]] = 2.0
            i, j = divmod(int(np.argmin(sims)), sims.shape[1])
            if least is None or sims[i, j] < least[0]:
                least = sims[i, j], part["id"].iloc[i], s["id"].iloc[j]
        rows = [] if least is None else [(pdf["library_id"].iloc[0], pdf["person_id"].iloc[0], *least)]
        return pd.DataFrame(rows, columns=["library_id", "person_id", "sim", "a", "b"])

    pairs = blocked(units, units, who, 1024, farthest,
                     "library_id string, person_id int, sim double, a bigint, b bigint")
    seed = pairs.groupBy(*who).agg(F.min(F.struct("sim", "a", "b")).alias("s"))
    vec = units.select("library_id", "id", "unit")
    modes = (seed.select(*who, F.col("s.a").alias("_a"), F.col("s.b").alias("_b"))
             .join(vec.withColumnsRenamed({"id": "_a", "unit": "c1"}), ["library_id", "_a"])
             .join(vec.withColumnsRenamed({"id": "_b", "unit": "c2"}), ["library_id", "_b"]).drop("_a", "_b"))
    modes = settle(modes, "modes")
    for _ in range(SPLIT_ROUNDS):
        sided = units.join(modes, who).withColumn("_g", (_dot("unit", "c1") >= _dot("unit", "c2")).cast("int"))
        means = _mean_directions(sided, [*who, "_g"])
        split = means.groupBy(*who).agg(F.max(F.when(F.col("_g") == 1, F.col("mean"))).alias("m1"),
                                        F.max(F.when(F.col("_g") == 0, F.col("mean"))).alias("m2"))
        assigned = settle(sided.select(*who, "id", "unit", "_g"), "sides")
        modes = settle(split.where(F.col("m1").isNotNull() & F.col("m2").isNotNull())
                       .select(*who, F.col("m1").alias("c1"), F.col("m2").alias("c2")), "modes")
    done = assigned.join(modes, who).withColumn("_s", F.when(F.col("_g") == 1, _dot("unit", "c1")).otherwise(_dot("unit", "c2")))
    return done.groupBy(*who).agg(
        F.count_if(F.col("_g") == 1).alias("n_first"), F.count_if(F.col("_g") == 0).alias("n_second"),
        (1.0 - F.first(_dot("c1", "c2"))).alias("separation"),
        F.least(F.avg(F.when(F.col("_g") == 1, F.col("_s"))), F.avg(F.when(F.col("_g") == 0, F.col("_s")))).alias("within"))


def split_scan(vectors: DataFrame, persons: DataFrame, separation: float = SPLIT_SEPARATION,
               one_task: int = ONE_TASK) -> DataFrame:
    """Persons with ``split_suggested`` recomputed: two tight, well separated modes.

    Persons the user silenced keep what they have. A person of up to ``one_task``
    vectors is examined by one task, a larger one by distributed rounds of the
    same procedure over all of its vectors.
    """
    silent = persons.where(F.coalesce("split_silenced", F.lit(False))).select(
        "library_id", F.col("id").alias("person_id"))
    mine = vectors.where("person_id >= 0").join(silent, ["library_id", "person_id"], "left_anti").select(
        "library_id", "person_id", "id", normalised("vec").alias("unit")).where(F.size("unit") > 0)
    sizes = mine.groupBy("library_id", "person_id").agg(F.count("*").alias("_n"))
    units = settle(mine.join(sizes.where(F.col("_n") >= SPLIT_MIN_VECTORS), ["library_id", "person_id"]), "units")
    modes = _modes_in_task(units.where(F.col("_n") <= one_task).drop("_n"))
    large = units.where(F.col("_n") > one_task).drop("_n")
    if not large.isEmpty():
        modes = modes.unionByName(_modes_spread(large))
    verdict = modes.select(
        "library_id", F.col("person_id").alias("id"),
        ((F.col("n_first") >= 2) & (F.col("n_second") >= 2) & (F.col("separation") >= separation)
         & (F.col("within") >= SPLIT_WITHIN)).alias("_two"))
    return (persons.join(verdict, ["library_id", "id"], "left")
            .withColumn("split_suggested", F.when(F.coalesce("split_silenced", F.lit(False)), F.col("split_suggested"))
                        .otherwise(F.coalesce("_two", F.lit(False)))).drop("_two"))


def person_centroids(vectors: DataFrame) -> DataFrame:
    """``(library_id, person_id, vectors, centroid, mean_similarity)``."""
    who = ["library_id", "person_id"]
    units = vectors.where("person_id >= 0").select(*who, "id", normalised("vec").alias("unit"))
    means = _mean_directions(units, who).withColumnRenamed("mean", "centroid")
    near = units.join(means, who).groupBy(*who).agg(
        F.count("*").alias("vectors"), F.avg(F.greatest(F.lit(-1.0), F.least(
            F.lit(1.0), _dot("unit", "centroid")))).alias("mean_similarity"))
    return near.join(means, who)


def suggest_names(clips: DataFrame, persons: DataFrame) -> DataFrame:
    """``(library_id, person_id, suggestion, clips)`` from words shared by a person's paths.

    Once per clip; at least two clips must bear the word; most frequent first, then
    alphabetical. Only persons without a name of their own are considered.
    """
    open_to = persons.where(~F.col("verified") & blank("name")).select(
        "library_id", F.col("id").alias("person_id"))
    mine = clips.where("person_id >= 0").join(open_to, ["library_id", "person_id"], "left_semi")
    path = F.lower(F.concat_ws(" ", strip_extension("display_name"), "folder_name"))
    words = F.array_distinct(F.filter(
        F.split(path, "[^a-z]+"), lambda w: (F.length(w) > 2) & ~w.isin(GENERIC_WORDS)))
    n = mine.select("library_id", "person_id", F.explode(words).alias("word")).groupBy(
        "library_id", "person_id", "word").agg(F.count("*").alias("clips")).where("clips >= 2")
    best = n.groupBy("library_id", "person_id").agg(F.min(F.struct(
        (-F.col("clips")).alias("o"), "word")).alias("b"))
    return best.select("library_id", "person_id", first_upper("b.word").alias("suggestion"),
                       (-F.col("b.o")).alias("clips"))


def primary_person(clips: DataFrame, vectors: DataFrame, persons: DataFrame,
                   placed: DataFrame | None = None) -> DataFrame:
    """Clips with person_id set to the person of their best vector, -1 when none or gone.

    ``placed (library_id, id, person_id)`` are clips a person was given to by hand;
    they keep that person even without vectors.
    """
    best = vectors.where("person_id >= 0").groupBy("library_id", F.col("video_id").alias("id")).agg(
        F.max_by("person_id", F.struct("quality", (-F.col("id")).alias("_o"))).alias("_best"))
    alive = persons.select("library_id", F.col("id").alias("_best"), F.lit(True).alias("_alive"))
    out = (clips.join(best, ["library_id", "id"], "left").join(alive, ["library_id", "_best"], "left")
           .withColumn("person_id", F.when(F.col("_alive"), F.col("_best")).otherwise(-1)))
    if placed is not None:
        hand = placed.select("library_id", "id", F.col("person_id").alias("_hand"))
        out = out.join(hand, ["library_id", "id"], "left").withColumn(
            "person_id", F.coalesce("_hand", "person_id"))
    return out.select(*clips.columns)


# ---- human corrections ---------------------------------------------------------------------

def resolve_merges(merges: DataFrame) -> DataFrame:
    """``(library_id, person_id, survivor)`` after merges ``(library_id, ts, person_id, target_id)``.

    Each merge moves whoever is ``person_id`` at that moment, so a person follows
    the earliest later merge of wherever it has got to; rounds equal the longest chain.
    """
    m = settle(merges.where("person_id <> target_id").select("library_id", "ts", "person_id", "target_id"), "merges")
    at = settle(m.groupBy("library_id", "person_id").agg(
        F.min(F.struct("ts", "target_id")).alias("s")).select(
        "library_id", "person_id", F.col("s.target_id").alias("survivor"), F.col("s.ts").alias("t")), "merged")
    step = m.withColumnsRenamed({"person_id": "survivor", "target_id": "_to", "ts": "_ts"})
    while True:
        hop = (at.join(step, ["library_id", "survivor"]).where(F.col("_ts") > F.col("t"))
               .groupBy("library_id", "person_id").agg(F.min(F.struct("_ts", "_to")).alias("s")))
        if hop.isEmpty():
            return at.drop("t")
        at = settle(at.join(hop, ["library_id", "person_id"], "left").select(
            "library_id", "person_id", F.coalesce("s._to", "survivor").alias("survivor"),
            F.coalesce("s._ts", "t").alias("t")), "merged")


def merge_all_named(persons: DataFrame, vectors: DataFrame, names: DataFrame) -> DataFrame:
    """Persons called or suggested ``names (library_id, name)`` fold into the one with most vectors.

    A person asked for by both its names ties their groups together: everyone tied has one survivor.
    """
    asked = names.select("library_id", F.lower("name").alias("_k")).distinct()
    both = persons.select("library_id", F.col("id").alias("person_id"), F.explode(F.array_distinct(F.array(
        F.lower("name"), F.lower("suggested_name")))).alias("_k")).where(~blank("_k"))
    n = vectors.groupBy("library_id", "person_id").agg(F.count("*").alias("_n"))
    hit = both.join(asked, ["library_id", "_k"]).join(n, ["library_id", "person_id"], "left").na.fill(0, ["_n"])
    hit = settle(hit, "named")
    low = hit.groupBy("library_id", "_k").agg(F.min("person_id").alias("_low"))
    tied = connected_components(hit.join(low, ["library_id", "_k"]), "person_id", "_low").withColumnRenamed("node", "person_id")
    once = (hit.select("library_id", "person_id", "_n").distinct().join(tied, ["library_id", "person_id"], "left")
            .withColumn("component", F.coalesce("component", "person_id")))
    keep = once.groupBy("library_id", "component").agg(
        F.max_by("person_id", F.struct("_n", (-F.col("person_id")).alias("_o"))).alias("survivor"))
    return once.join(keep, ["library_id", "component"]).select("library_id", "person_id", "survivor")


def split_out(vectors: DataFrame, clips: DataFrame, denials: DataFrame, corrections: DataFrame):
    """Take clips away from a person: vectors and clips become unassigned, and a denial remembers it.

    ``corrections`` is (library_id, video_id, person_id). Returns vectors, clips, denials.
    """
    c = corrections.select("library_id", "video_id", "person_id").distinct().withColumn("_out", F.lit(True))
    v = vectors.join(c, ["library_id", "video_id", "person_id"], "left").withColumn(
        "person_id", F.when(F.col("_out"), -1).otherwise(F.col("person_id"))).select(*vectors.columns)
    gone = c.select("library_id", F.col("video_id").alias("id"), "_out").distinct()
    k = clips.join(gone, ["library_id", "id"], "left").withColumn(
        "person_id", F.when(F.col("_out"), -1).otherwise(F.col("person_id"))).select(*clips.columns)
    return v, k, denials.unionByName(c.drop("_out").select(*denials.columns)).distinct()


def move_clips(vectors: DataFrame, clips: DataFrame, persons: DataFrame, moves: DataFrame):
    """Give clips to a person by hand: ``moves`` is (library_id, video_id, person_id, ts); last one wins."""
    last = moves.groupBy("library_id", "video_id").agg(F.max_by("person_id", "ts").alias("_to"))
    v = vectors.join(last, ["library_id", "video_id"], "left").withColumn(
        "person_id", F.coalesce("_to", "person_id")).select(*vectors.columns)
    k = clips.join(last.withColumnRenamed("video_id", "id"), ["library_id", "id"], "left").withColumn(
        "person_id", F.coalesce("_to", "person_id")).select(*clips.columns)
    sure = last.select("library_id", F.col("_to").alias("id"), F.lit(True).alias("_v")).distinct()
    p = persons.join(sure, ["library_id", "id"], "left").withColumn(
        "verified", F.col("verified") | F.coalesce("_v", F.lit(False))).select(*persons.columns)
    return v, k, p


def person_flags(persons: DataFrame, corrections: DataFrame) -> DataFrame:
    """Apply silence, verify, forget and rename rows ``(library_id, ts, op, person_id, name)``.

    Each flag takes the last correction that touches it.
    """
    last = lambda ops, what: F.max_by(what, F.when(F.col("op").isin(ops), F.col("ts")))
    c = corrections.groupBy("library_id", F.col("person_id").alias("id")).agg(
        last(["verify", "rename", "forget"], F.col("op") != "forget").alias("_ver"),
        last(["silence", "forget"], F.col("op") == "silence").alias("_sil"),
        F.max(F.col("op") == "silence").alias("_hush"), last(["rename"], F.col("name")).alias("_name"))
    had = lambda col: F.col(col)
    return persons.join(c, ["library_id", "id"], "left").withColumns({
        "verified": F.coalesce(had("_ver"), had("verified")),
        "split_silenced": F.coalesce(had("_sil"), had("split_silenced")),
        "split_suggested": F.when(F.coalesce("_hush", F.lit(False)), False).otherwise(F.col("split_suggested")),
        "name": F.coalesce("_name", "name")}).select(*persons.columns)


def nonempty_persons(persons: DataFrame, vectors: DataFrame) -> DataFrame:
    held = vectors.where("person_id >= 0").select("library_id", F.col("person_id").alias("id")).distinct()
    return persons.join(held, ["library_id", "id"], "left_semi")
