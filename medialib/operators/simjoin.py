"""Similarity joins: fingerprints within a Hamming distance, vectors above a cosine.

Fingerprints: two 64-bit values within k bits agree, in at least one of B bands,
on all but k // B bits. The asking side is expanded to every band value within
that radius and equi-joined with the other side; the exact distance is checked
after. Joins run between distinct fingerprints, so copies cost one row.

Vectors: exact mode multiplies blocks of bounded size; only hits leave a task.
"""

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialib.session import settle

WHOLE = tuple(range(64))
#: Blocks a key is cut into while they stay below ``GROWN`` times their least size; a kernel multiplies ``SLICE`` rows at once.
PARTS, GROWN, SLICE = 8, 16, 512


@cache
def flip_masks(bits: tuple[int, ...], radius: int) -> tuple[int, ...]:
    """Signed 64-bit masks flipping at most ``radius`` of the given bit positions."""
    out = []
    for r in range(radius + 1):
        for pick in combinations(bits, r):
            m = sum(1 << b for b in pick)
            out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return tuple(out)


def _bands(bits: tuple[int, ...], n: int) -> list[tuple[int, ...]]:
    cut = [round(i * len(bits) / n) for i in range(n + 1)]
    return [bits[cut[i]:cut[i + 1]] for i in range(n)]


def _signed(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _long(v: int) -> Column:
    return F.lit(v).cast("bigint")


def _probes(h: Column, bands, radius: int) -> Column:
    """Every (band, band value) a fingerprint within reach may have."""
    def of_band(n, bits):
        kept = h.bitwiseAND(_long(_signed(bits)))
        flips = F.array(*[_long(m) for m in flip_masks(bits, radius)])
        return F.transform(flips, lambda f: F.struct(
            F.lit(n).alias("band"), kept.bitwiseXOR(f).alias("part")))

    return F.concat(*[of_band(n, bits) for n, bits in enumerate(bands)])


def _parts(h: Column, bands) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("band"), h.bitwiseAND(_long(_signed(bits))).alias("part"))
                     for n, bits in enumerate(bands)])


def _first_band(diff: Column, bands, radius: int) -> Column:
    """The first band in which a pair is within the radius: it counts there and nowhere else."""
    out = None
    for n, bits in enumerate(bands):
        close = F.bit_count(diff.bitwiseAND(_long(_signed(bits)))) <= radius
        out = F.when(close, n) if out is None else out.when(close, n)
    return out


def near_fingerprints(asking: DataFrame, stored: DataFrame, k: int, keys=("library_id",),
                      bands: int | None = None, split_above: int = 20_000) -> DataFrame:
    """``(keys, asked, phash, distance)`` for every two distinct-or-equal fingerprints within k.

    ``asking`` has ``(keys, asked)``, ``stored`` has ``(keys, phash)``; 0 means
    "not computed" and never matches. A band value shared by more than
    ``split_above`` stored fingerprints is joined on a second band of the other
    bits as well, so no bucket is compared all against all.
    """
    keys = list(keys)
    bands = bands or (4 if k < 8 else 6)
    outer = _bands(WHOLE, bands)
    radius = k // bands
    known = lambda df, col: df.where(F.coalesce(col, F.lit(0)) != 0).select(
        *keys, F.col(col).alias("phash")).distinct()
    # Both sides are used several times below; writing the distinct fingerprints once
    # keeps whatever produced them from being recomputed.
    prints = settle(known(asking, "asked").withColumn("_side", F.lit(0)).unionByName(
        known(stored, "phash").withColumn("_side", F.lit(1))), "fingerprints")
    a = prints.where("_side = 0").select(*keys, F.col("phash").alias("asked"))
    s = prints.where("_side = 1").select(*keys, "phash")
    ask = a.select(*keys, "asked", F.inline(_probes(F.col("asked"), outer, radius)))
    put = s.select(*keys, "phash", F.inline(_parts(F.col("phash"), outer)))
    bucket = [*keys, "band", "part"]
    crowded = put.groupBy(*bucket).agg(F.count("*").alias("_n")).where(F.col("_n") > split_above).drop("_n")

    diff = F.col("asked").bitwiseXOR(F.col("phash"))
    once = (F.bit_count(diff) <= k) & (F.col("band") == _first_band(diff, outer, radius))
    if crowded.isEmpty():
        return ask.join(put, bucket).where(once).select(
            *keys, "asked", "phash", F.bit_count(diff).alias("distance"))
    crowded = settle(crowded, "crowded")
    plain = ask.join(put.join(crowded, bucket, "left_anti"), bucket).where(once)
    inner_n = max(2, bands - 1)
    inner_radius = k // inner_n
    hot_ask, hot_put = ask.join(crowded, bucket, "left_semi"), put.join(crowded, bucket, "left_semi")
    split = None
    for n, bits in enumerate(outer):
        inner = _bands(tuple(b for b in WHOLE if b not in bits), inner_n)
        left = hot_ask.where(F.col("band") == n).select(*bucket, "asked", F.inline(
            F.transform(_probes(F.col("asked"), inner, inner_radius), lambda p: F.struct(
                p["band"].alias("band2"), p["part"].alias("part2")))))
        right = hot_put.where(F.col("band") == n).select(*bucket, "phash", F.inline(
            F.transform(_parts(F.col("phash"), inner), lambda p: F.struct(
                p["band"].alias("band2"), p["part"].alias("part2")))))
        hit = left.join(right, [*bucket, "band2", "part2"]).where(
            once & (F.col("band2") == _first_band(diff, inner, inner_radius)))
        hit = hit.select(*keys, "asked", "phash")
        split = hit if split is None else split.unionByName(hit)
    pairs = plain.select(*keys, "asked", "phash").unionByName(split)
    return pairs.withColumn("distance", F.bit_count(diff))


def fingerprint_pairs(items: DataFrame, k: int = 6, keys=("library_id",), **kw) -> DataFrame:
    """Every two fingerprints of one key within k bits, with how many items bear each.

    ``pairs`` is the number of item pairs a row stands for. Copies of one
    fingerprint are one row at distance 0, not a row per pair of copies.
    """
    keys = list(keys)
    held = items.where(F.coalesce("phash", F.lit(0)) != 0).groupBy(*keys, "phash").agg(
        F.count("*").alias("copies"), F.min("id").alias("first_id"))
    near = near_fingerprints(held.withColumnRenamed("phash", "asked"), held, k, keys, **kw)
    near = near.where(F.col("asked") <= F.col("phash"))
    left = held.select(*keys, F.col("phash").alias("asked"), F.col("copies").alias("copies_a"),
                       F.col("first_id").alias("first_a"))
    right = held.select(*keys, "phash", F.col("copies").alias("copies_b"), F.col("first_id").alias("first_b"))
    same = F.col("asked") == F.col("phash")
    out = near.join(left, [*keys, "asked"]).join(right, [*keys, "phash"])
    return (out.withColumn("pairs", F.when(
        same, (F.col("copies_a") * (F.col("copies_a") - 1) / 2).cast("bigint"))
        .otherwise(F.col("copies_a") * F.col("copies_b")))
        .where("pairs > 0").withColumnsRenamed({"asked": "phash_a", "phash": "phash_b"}))


# ---- vectors -------------------------------------------------------------------------------

def normalised(vec) -> Column:
    """Unit vector; a zero or empty vector becomes an empty array and matches nothing."""
    v = F.col(vec) if isinstance(vec, str) else vec
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm >= 1e-9, F.transform(v, lambda x: F.try_divide(x, norm))).otherwise(F.array().cast("array<double>"))


def cosine(a, b) -> Column:
    """Clamped cosine of two array columns; 0 when sizes differ or a norm vanishes."""
    x, y = F.col(a), F.col(b)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v)
    norm = F.sqrt(size(x) * size(y))
    return F.when((F.size(x) != F.size(y)) | (norm < 1e-9), 0.0).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, norm))))


def blocked(asking: DataFrame, stored: DataFrame, keys, block: int, kernel, schema: str, mirrored: bool = False) -> DataFrame:
    """Run ``kernel`` on every (asking block, stored block) of a key.

    A key is cut into blocks by id hash, so the largest library is spread over many
    tasks. Every row goes to each block of the other side, so blocks of ``block`` rows
    grow with the key: it has ``PARTS`` of them, and more only where they would pass
    ``GROWN * block`` rows. ``mirrored``: both sides are the same rows and order does
    not matter, so a pair of blocks meets once.
    """
    keys = list(keys)
    size = F.least(F.lit(float(GROWN * block)), F.greatest(F.lit(float(block)), F.count("*") / F.lit(PARTS)))
    blocks = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias(name))
    na, ns = blocks(asking, "_na"), blocks(stored, "_ns")
    shape = na.join(ns, keys)
    zero = F.lit(0).cast("bigint")
    rows = lambda df, own, side, mine, spread, lo, hi: (
        df.join(shape, keys).withColumn(mine, F.pmod(F.xxhash64("id"), F.col(own)))
        .withColumn(spread, F.explode(F.sequence(lo, hi))).withColumn("_side", F.lit(side)).drop("_na", "_ns"))
    last = lambda n: F.col(n).cast("bigint") - 1
    left = rows(asking, "_na", 0, "_ba", "_bs", F.col("_ba") if mirrored else zero, last("_ns"))
    right = rows(stored, "_ns", 1, "_bs", "_ba", zero, F.col("_bs") if mirrored else last("_na"))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.groupBy(*keys, "_ba", "_bs").applyInPandas(kernel, schema)


def _matrix(vecs: pd.Series):
    """Row indices per vector length, with the stacked matrix of each."""
    sizes = vecs.map(len).to_numpy()
    for n in np.unique(sizes):
        if n:
            at = np.flatnonzero(sizes == n)
            yield n, at, np.stack(vecs.to_numpy()[at])


def similarities(q: pd.DataFrame, s: pd.DataFrame) -> np.ndarray:
    """Clamped dot products of unit vectors; vectors of different length score 0."""
    out = np.zeros((len(q), len(s)))
    stored = {n: (at, m) for n, at, m in _matrix(s["unit"])}
    for n, at, m in _matrix(q["unit"]):
        if n in stored:
            cols, other = stored[n]
            out[np.ix_(at, cols)] = np.clip(m @ other.T, -1.0, 1.0)
    return out


def sliced(q: pd.DataFrame, s: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """``q`` in slices, each with its similarities to ``s``: a block of any size takes bounded memory."""
    for lo in range(0, len(q), SLICE):
        part = q.iloc[lo:lo + SLICE]
        yield part, similarities(part, s)


def cosine_pairs(vectors: DataFrame, threshold: float, block: int = 1024,
                 strict: bool = False) -> DataFrame:
    """``(library_id, a, b, sim)`` with a < b for vectors of one library at or above ``threshold``."""
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        q, s = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        lib, same, ids_s = pdf["library_id"].iloc[0], pdf["_ba"].iloc[0] == pdf["_bs"].iloc[0], s["id"].to_numpy()
        found = [pd.DataFrame({"library_id": [], "a": [], "b": [], "sim": []})]
        for part, sims in sliced(q, s):
            ids_q = part["id"].to_numpy()
            hit = (sims > threshold) if strict else (sims >= threshold)
            if same:
                hit &= ids_q[:, None] < ids_s[None, :]
            i, j = np.nonzero(hit)
            found.append(pd.DataFrame({"library_id": lib, "a": np.minimum(ids_q[i], ids_s[j]), "b": np.maximum(ids_q[i], ids_s[j]), "sim": sims[i, j]}))
        return pd.concat(found[1:] or found, ignore_index=True)

    unit = vectors.select("library_id", "id", normalised("vec").alias("unit"))
    return blocked(unit, unit, ["library_id"], block, kernel,
                    "library_id string, a bigint, b bigint, sim double", mirrored=True)


def best_two_persons(asking: DataFrame, stored: DataFrame, block: int = 1024) -> DataFrame:
    """Per asking vector its two best persons by maximum similarity: ``(library_id, id, person_id, sim)``.

    ``asking`` may carry ``deny`` (array of person ids that must not compete). A
    block keeps only its own two best persons: a person beaten by two others in
    the block holding its best vector cannot be among the best two overall.
    """
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        q, s = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1].sort_values("person_id")
        lib = pdf["library_id"].iloc[0]
        none = pd.DataFrame({"library_id": [], "id": [], "person_id": [], "sim": []})
        if q.empty or s.empty:
            return none
        persons, starts = np.unique(s["person_id"].to_numpy(), return_index=True)
        found = []
        for part, sims in sliced(q, s):
            best = np.maximum.reduceat(sims, starts, axis=1)
            denied = part["deny"].map(lambda d: 0 if d is None else len(d)).to_numpy()
            if denied.any():
                who = np.concatenate([d for d, n in zip(part["deny"], denied, strict=True) if n])
                at = np.minimum(np.searchsorted(persons, who), len(persons) - 1)
                known = persons[at] == who
                best[np.repeat(np.arange(len(part)), denied)[known], at[known]] = -np.inf
            order = np.argsort(-best, axis=1, kind="stable")[:, :2]
            at = np.repeat(np.arange(len(part)), order.shape[1])
            sim = best[at, order.ravel()]
            keep = np.isfinite(sim)
            found.append(pd.DataFrame({"library_id": lib, "id": part["id"].to_numpy()[at][keep],
                                       "person_id": persons[order.ravel()][keep], "sim": sim[keep]}))
        return pd.concat(found, ignore_index=True)

    if "deny" not in asking.columns:
        asking = asking.withColumn("deny", F.lit(None).cast("array<int>"))
    a = asking.select("library_id", "id", normalised("vec").alias("unit"), "deny")
    s = stored.select("library_id", "id", normalised("vec").alias("unit"), "person_id")
    per_block = blocked(a, s, ["library_id"], block, kernel,
                         "library_id string, id bigint, person_id int, sim double")
    return per_block.groupBy("library_id", "id", "person_id").agg(F.max("sim").alias("sim"))


def person_links(vectors: DataFrame, above: float, block: int = 1024) -> DataFrame:
    """``(library_id, a, b, sim)``: persons whose closest vectors exceed ``above``, a < b."""
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        q, s = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        ps, found = s["person_id"].to_numpy(), []
        for part, sims in sliced(q, s):
            pq = part["person_id"].to_numpy()
            i, j = np.nonzero((sims > above) & (pq[:, None] != ps[None, :]))
            hits = pd.DataFrame({"a": np.minimum(pq[i], ps[j]), "b": np.maximum(pq[i], ps[j]), "sim": sims[i, j]})
            found.append(hits.groupby(["a", "b"], as_index=False)["sim"].max())
        out = pd.concat(found or [pd.DataFrame({"a": [], "b": [], "sim": []})]).groupby(["a", "b"], as_index=False)["sim"].max()
        out.insert(0, "library_id", pdf["library_id"].iloc[0])
        return out

    unit = vectors.where("person_id >= 0").select(
        "library_id", "id", normalised("vec").alias("unit"), "person_id")
    parts = blocked(unit, unit, ["library_id"], block, kernel,
                     "library_id string, a int, b int, sim double", mirrored=True)
    return parts.groupBy("library_id", "a", "b").agg(F.max("sim").alias("sim"))


