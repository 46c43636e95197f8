"""Identity queries over the test tables. The vectors there are far apart, so thresholds are
lower than the operators' defaults; planted clusters for the defaults are in the tests."""

from pyspark.sql import functions as F

from medialib.operators import identity, shelves, simjoin, vectorbuckets
from medialib.plans.registry import as_long, query, r6


def _decision(d):
    return d.select("library_id", "id", *as_long("person_id"), "ambiguous",
                    r6("best").alias("best"), r6("margin").alias("margin"))


def _vectors(b):
    return b.vectors()


@query
def cosine_pairs(b):
    return simjoin.cosine_pairs(_vectors(b), 0.30).select("library_id", "a", "b", r6("sim").alias("sim"))


@query
def cosine_pairs_buckets(b):
    """Pairs by buckets; small ones, so that the test tables fill many."""
    return vectorbuckets.cosine_pairs_buckets(_vectors(b), 0.30, crowd=64).select("library_id", "a", "b", r6("sim").alias("sim"))


@query
def cosine_bucket_recall(b):
    """What the buckets find of all pairs, held against comparing all with all."""
    keys = ["library_id", "a", "b"]
    exact = simjoin.cosine_pairs(_vectors(b), 0.30).withColumn("_exact", F.lit(1))
    found = vectorbuckets.cosine_pairs_buckets(_vectors(b), 0.30, crowd=64).drop("sim").withColumn("_found", F.lit(1))
    both = exact.join(found, keys, "full_outer").groupBy("library_id").agg(
        F.count("_exact").alias("pairs"), F.count_if(F.col("_exact").isNull()).alias("untrue"),
        F.count_if(F.col("_exact").isNotNull() & F.col("_found").isNotNull()).alias("_hit"))
    return both.select("library_id", "pairs", "untrue", (F.col("_hit") >= 0.9 * F.col("pairs")).alias("reached"))


@query
def cosine_clusters(b):
    return identity.cosine_clusters(_vectors(b), 0.35)


@query
def match_gate(b):
    v = _vectors(b)
    return _decision(identity.match(v.where("person_id < 0"), v, 0.30, 0.02))


@query
def match_gate_denied(b):
    v = _vectors(b)
    return _decision(identity.match(identity.with_denials(v.where("person_id < 0"), b.denials()), v, 0.30, 0.02))


@query
def assign_or_create(b):
    v = _vectors(b)
    return identity.assign_or_create(v.where("person_id < 0"), v.where("person_id >= 0"), b.persons(), b.denials(), 0.30, 0.02) \
        .select("library_id", "id", *as_long("person_id"), "created")


@query
def consolidate_persons(b):
    return identity.consolidate(_vectors(b), 0.42).select("library_id", *as_long("person_id", "survivor"))


@query
def adopt_unassigned(b):
    return identity.adopt_unassigned(_vectors(b), b.denials(), 0.30, 0.02).select(
        "library_id", "id", *as_long("person_id"))


@query
def split_scan(b):
    return identity.split_scan(_vectors(b), b.persons()).select(
        "library_id", *as_long("id"), "split_suggested", "split_silenced")


@query
def person_centroids(b):
    return identity.person_centroids(_vectors(b)).select(
        "library_id", *as_long("person_id", "vectors"), r6("mean_similarity").alias("mean_similarity"),
        r6(F.col("centroid")[0]).alias("c_first"), r6(F.col("centroid")[63]).alias("c_last"))


@query
def suggest_names(b):
    return identity.suggest_names(b.clips(), b.persons()).select(
        "library_id", *as_long("person_id", "clips"), "suggestion")


@query
def primary_person(b):
    gone = b.persons().where("id <> 3")
    return identity.primary_person(b.clips(), _vectors(b), gone).select("library_id", "id", *as_long("person_id"))


@query
def apply_merges(b):
    """Person 1 is merged into 2, then 2 into 3, in every library; empty persons go; 4 is silenced."""
    row = lambda ts, op, p, t: F.struct(F.lit(ts).alias("ts"), F.lit(op).alias("op"),
                                        F.lit(p).alias("person_id"), F.lit(t).alias("target_id"))
    fixes = b.persons().select("library_id").distinct().select("library_id", F.inline(F.array(
        row(1, "merge", 1, 2), row(2, "merge", 2, 3), row(3, "silence", 4, -1)))).withColumn("name", F.lit(None).cast("string"))
    vectors = identity.repoint(_vectors(b), identity.resolve_merges(fixes.where("op = 'merge'")))
    persons = identity.person_flags(identity.nonempty_persons(b.persons(), vectors), fixes.where("op <> 'merge'"))
    n = vectors.groupBy("library_id", F.col("person_id").alias("id")).agg(F.count("*").alias("vectors"))
    return persons.join(n, ["library_id", "id"]).select(
        "library_id", *as_long("id", "vectors"), "split_suggested", "split_silenced")


@query
def merge_named(b):
    names = b.persons().select("library_id", F.lit("sara").alias("name")).distinct()
    return identity.merge_all_named(b.persons(), _vectors(b), names).select(
        "library_id", *as_long("person_id", "survivor"))


@query
def split_out(b):
    fixes = b.denials()
    v, c, d = identity.split_out(_vectors(b), b.clips(), b.denials().where("person_id <> 2"), fixes)
    tag = lambda df, n, i: df.select(F.lit(n).alias("table"), "library_id", F.col(i).alias("id"),
                                     *as_long("person_id"))
    return tag(v, "vector", "id").unionByName(tag(c, "clip", "id")).unionByName(tag(d, "denial", "video_id"))


@query
def move_clips(b):
    moves = b.dismissals().select("library_id", "video_id", F.lit(6).alias("person_id"), F.lit(1).alias("ts"))
    v, c, p = identity.move_clips(_vectors(b), b.clips(), b.persons(), moves)
    return (v.select(F.lit("vector").alias("table"), "library_id", "id", *as_long("person_id"))
            .unionByName(c.select(F.lit("clip").alias("table"), "library_id", "id", *as_long("person_id")))
            .unionByName(p.select(F.lit("verified").alias("table"), "library_id", F.col("id").cast("bigint").alias("id"),
                                  F.col("verified").cast("bigint").alias("person_id"))))


@query
def nonempty_persons(b):
    return identity.nonempty_persons(b.persons(), _vectors(b).where("person_id <> 5")).select(
        "library_id", *as_long("id"))


@query
def name_collisions(b):
    return shelves.name_collisions(b.persons()).select("library_id", "name_key", *as_long("persons"))
