import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from medialib.operators import dups, simjoin
from medialib.operators.components import connected_components
from tests.rows import clips, watched_clips


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def bits(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


def random_hashes(n, seed):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(n // 6)]
    out = []
    for _ in range(n):
        h = rnd.choice(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 6, 9, 11])):
            h ^= 1 << rnd.randrange(64)
        out.append(signed(h))
    return out + [0, 0]


def test_hamming_pairs_equal_brute_force_with_and_without_crowded_buckets(spark):
    hashes = random_hashes(120, 1)
    df = spark.createDataFrame([("a" if i % 3 else "b", i, h) for i, h in enumerate(hashes)],
                               "library_id string, id bigint, phash bigint")
    for k, split in [(6, 20_000), (6, 3), (10, 20_000), (10, 3)]:
        want = {}
        for i, a in enumerate(hashes):
            for j in range(i + 1, len(hashes)):
                b = hashes[j]
                if a and b and (i % 3 > 0) == (j % 3 > 0) and bits(a, b) <= k:
                    key = ("a" if i % 3 else "b", min(a, b), max(a, b))
                    want[key] = want.get(key, 0) + 1
        rows = simjoin.fingerprint_pairs(df, k, split_above=split).collect()
        got = {(r["library_id"], r["phash_a"], r["phash_b"]): r["pairs"] for r in rows}
        assert len(got) == len(rows) and got == want


def test_components_on_chain_star_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(5, i) for i in range(6, 30)] + [(50, 51), (51, 52), (52, 50)]
    random.Random(3).shuffle(edges)
    df = spark.createDataFrame([("x", a, b) for a, b in edges], "library_id string, a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    assert all(got[i] == 100 for i in range(100, 131)) and all(got[i] == 5 for i in range(5, 30))
    assert got[50] == got[51] == got[52] == 50


def walk(rows):
    """The greedy rule, one clip after the other."""
    used, sets = set(), {}
    by_folder = {}
    for r in sorted(rows, key=lambda r: (r["date_added_sec"], r["id"])):
        by_folder.setdefault((r["library_id"], r["folder_name"].lower()), []).append(r)
    for group in by_folder.values():
        for a in group:
            if a["id"] in used:
                continue
            mates = [b for b in group if b["id"] != a["id"] and b["id"] not in used
                     and abs(b["date_added_sec"] - a["date_added_sec"]) < 7 * 86_400
                     and (a["duration_ms"] <= 0 or b["duration_ms"] <= 0 or 0.75 <= a["duration_ms"] / b["duration_ms"] <= 1.34)
                     and bits(a["phash"], b["phash"]) <= 6]
            if mates:
                for m in [a, *mates]:
                    used.add(m["id"])
                    sets[m["id"]] = a["id"]
    return sets


@pytest.mark.parametrize("pairs", [dups.WALK, 12, 0])
def test_duplicate_sets_equal_the_walk(spark, pairs):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(4)]
    rows = []
    for i in range(160):
        h = rnd.choice(base)
        for _ in range(rnd.choice([0, 0, 2, 3, 4])):
            h ^= 1 << rnd.randrange(64)
        rows.append(dict(id=i, library_id=rnd.choice("ab"), folder_name=rnd.choice(["Cam", "CAM", "x"]), phash=signed(h),
                         date_added_sec=1_700_000_000 + rnd.choice([0, 3, 6.9, 7, 8, 12, 15]) * 86_400 // 1 * 1 + rnd.randrange(3),
                         duration_ms=rnd.choice([0, 750, 1000, 1334, 1337, 2000])))
    for r in rows:
        r["date_added_sec"] = int(r["date_added_sec"])
    got = {r["id"]: r["set_id"] for r in dups.duplicate_sets(clips(spark, rows), pairs).collect()}
    assert got == walk(rows)


def test_many_linked_clips_are_walked_in_one_pass_over_their_pairs(spark, monkeypatch):
    def rounds(pairs, walk):
        raise AssertionError("walked in rounds")
    monkeypatch.setattr(dups, "_sets_in_rounds", rounds)
    # Two groups of 200 clips that are mates of each other: 39,800 pairs each, more than one task grouped before.
    rows = [dict(id=i, library_id="ab"[i % 2], phash=77, date_added_sec=1_700_000_000 + i) for i in range(400)]
    got = {r["id"]: r["set_id"] for r in dups.duplicate_sets(clips(spark, rows)).collect()}
    assert got == {i: i % 2 for i in range(400)}


def test_rounds_end_where_what_is_left_can_be_walked(spark, monkeypatch):
    rounds = []
    kept = dups.settle
    monkeypatch.setattr(dups, "settle", lambda df, label="step": rounds.append(label) or kept(df, label))
    # A chain of 24 clips settles two a round; a pair of mates each way and none of copies.
    rows = [dict(id=i, phash=77, date_added_sec=1_000_000_000 + i * 5 * 86_400) for i in range(24)]
    got = {r["id"]: r["set_id"] for r in dups.duplicate_sets(clips(spark, rows), 40).collect()}
    assert got == {i: i - i % 2 for i in range(24)} and rounds.count("dup-round") == 2


def test_the_walk_over_batches_equals_the_walk_over_groups():
    rnd = random.Random(11)
    rows, want = [], set()
    for group in range(40):
        pairs = sorted({(rnd.randrange(3), rnd.randrange(9), rnd.randrange(9)) for _ in range(rnd.randrange(1, 30))})
        owner = {}
        for turn in sorted({p[:2] for p in pairs}):
            mates = [b for t, a, b in pairs if (t, a) == turn and b not in owner]
            if turn[1] not in owner and mates:
                owner |= dict.fromkeys(mates, turn[1]) | {turn[1]: turn[1]}
        rows += [("ab"[group % 2], group, *p) for p in pairs]
        want |= {("ab"[group % 2], group, *o) for o in owner.items()}
    # Nodes are told apart by their group.
    rows = [(lib, g, t, 100 * g + a, 100 * g + b) for lib, g, t, a, b in rows]
    table = pa.Table.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["library_id", "component", "t", "a", "b"])
    out = [r for b in dups._walk_sets(iter(table.to_batches(max_chunksize=7))) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(out) == len(want) and set(out) == {(lib, 100 * g + n, 100 * g + s) for lib, g, n, s in want}


def test_a_long_chain_of_contested_clips_takes_no_rounds(spark, monkeypatch):
    def rounds(pairs):
        raise AssertionError("walked in rounds")
    monkeypatch.setattr(dups, "_sets_in_rounds", rounds)
    rows = [dict(id=i, phash=77, date_added_sec=1_000_000_000 + i * 5 * 86_400) for i in range(1_000)]
    got = {r["id"]: r["set_id"] for r in dups.duplicate_sets(clips(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(1_000)}


def test_keeper_order_savings_and_reasons(spark):
    rows = [dict(id=1, sharpness=5.0, size_bytes=100), dict(id=2, sharpness=9.0, size_bytes=50, smile_count=1),
            dict(id=3, sharpness=9.0, size_bytes=70, smile_count=2)]
    m = watched_clips(spark, rows).withColumn("set_id", F.lit(1))
    r = dups.keeper_reason(dups.keepers(m)).first()
    assert (r["keeper_id"], r["savings_bytes"], r["members"]) == (3, 150, 3)
    assert r["reason"] == "Everyone in it is smiling"


def test_content_match_takes_best_frame_and_never_zero(spark):
    lib = spark.createDataFrame([("a", 1, 0b1111, "f", 0, "clip"), ("a", 2, 0, "f", 0, "clip"), ("b", 3, 0b1111, "f", 0, "photo"),
                                 ("a", 4, (1 << 20) - 1, "f", 86_400, "photo")],
                                "library_id string, id bigint, phash bigint, folder_name string, date_added_sec bigint, kind string")
    q = spark.createDataFrame([(1, "a", 0, 0b1), (1, "a", 1, 0b111), (2, "a", 0, 0), (3, "a", 0, -1)],
                              "query_id bigint, library_id string, frame_no int, phash bigint")
    hits = dups.content_match(q, lib)
    assert [(r["query_id"], r["id"], r["distance"]) for r in hits.collect()] == [(1, 1, 1)]
    said = {r["query_id"]: r["verdict"] for r in dups.content_verdict(q, hits).collect()}
    assert said[1] == 'This is an almost-exact copy of your clip in "f" — Jan 1, 1970'
    assert said[2].startswith("Couldn't read") and said[3].startswith("Not in your library")


def test_many_copies_do_not_multiply(spark):
    """A third of a library bearing one fingerprint is one row of pairs, and the top list is still exact."""
    df = spark.range(3000).selectExpr("'a' AS library_id", "id", "CASE WHEN id % 3 = 0 THEN 77L ELSE id * 1000003 + 5 END AS phash",
                                      "'f' AS folder_name", "id AS date_added_sec", "'clip' AS kind")
    row = simjoin.fingerprint_pairs(df, 0).where("phash_a = 77").collect()
    assert len(row) == 1 and row[0]["pairs"] == 1000 * 999 // 2
    q = spark.createDataFrame([(1, "a", 0, 77)], "query_id bigint, library_id string, frame_no int, phash bigint")
    assert [r["id"] for r in dups.content_match(q, df, k=0).orderBy("rank").collect()] == [3 * i for i in range(12)]
