import numpy as np

from medialib.operators import identity
from medialib.sources import schemas


def vectors(spark, rows):
    """rows: (id, person, vector[, clip])"""
    return spark.createDataFrame([("a", r[0], r[3] if len(r) > 3 else r[0], r[1], [float(x) for x in r[2]], 1.0) for r in rows],
                                 schemas.VECTORS)


def near(angle):
    return [np.cos(angle), np.sin(angle)]


def decide(spark, stored, vec, deny=(), **bars):
    v = vectors(spark, [(1000, -1, vec), *[(i, p, x) for i, (p, x) in enumerate(stored)]])
    d = spark.createDataFrame([("a", 1000, p) for p in deny], schemas.DENIALS)
    r = identity.match(identity.with_denials(v.where("person_id < 0"), d), v, **bars).first()
    return r["person_id"], r["ambiguous"]


def test_gate_ambiguity_denial_and_lone_person(spark):
    two = [(1, near(0.0)), (2, near(1.2))]
    assert decide(spark, two, near(0.1)) == (1, False)
    assert decide(spark, two, near(0.6)) == (-1, True)
    assert decide(spark, two, near(0.1), deny=[1]) == (2, False)
    assert decide(spark, two, near(3.1)) == (-1, False)
    assert decide(spark, [(1, near(0.0))], near(1.1)) == (1, False)
    assert decide(spark, [], near(0.1)) == (-1, False)


def test_best_vector_counts_not_the_centroid(spark):
    stored = [(1, near(0.0)), (1, near(2.0)), (2, near(0.5))]
    assert decide(spark, stored, near(2.05)) == (1, False)


def test_leftovers_found_new_persons_whatever_their_order(spark):
    stored = vectors(spark, [(1, 4, [1, 0, 0])])
    fresh = vectors(spark, [(10, -1, [0, 1, 0]), (11, -1, [0.05, 1, 0]), (12, -1, [0, 0, 1]), (13, -1, [1, 0.05, 0])])
    persons = spark.createDataFrame([("a", 4, "", "", False, False, False)], schemas.PERSONS)
    none = spark.createDataFrame([], schemas.DENIALS)
    got = {r["id"]: (r["person_id"], r["created"]) for r in
           identity.assign_or_create(fresh.repartition(3), stored, persons, none).collect()}
    assert got == {10: (5, True), 11: (5, True), 12: (6, True), 13: (4, False)}


def planted(n, spread, seed):
    rnd = np.random.default_rng(seed)
    a, b = np.eye(8)[0], np.eye(8)[1]
    rows = [c + rnd.normal(0, spread, 8) for c in (a, b) for _ in range(n)]
    return [v / np.linalg.norm(v) for v in rows]


def test_split_scan_flags_two_modes_on_both_paths_and_respects_silence(spark):
    two, one = planted(8, 0.1, 1), planted(8, 0.1, 2)[:8]
    rows = [(i, 1, v) for i, v in enumerate(two)] + [(100 + i, 2, v) for i, v in enumerate(one)] \
        + [(200 + i, 3, v) for i, v in enumerate(two)] + [(300 + i, 4, v) for i, v in enumerate(two[:3])]
    persons = spark.createDataFrame([("a", i, "", "", False, i == 2, i == 3) for i in (1, 2, 3, 4)], schemas.PERSONS)
    for limit in (2000, 4):
        got = {r["id"]: r["split_suggested"] for r in identity.split_scan(vectors(spark, rows), persons, one_task=limit).collect()}
        assert got == {1: True, 2: False, 3: False, 4: False}


def test_consolidation_links_transitively_and_keeps_the_largest(spark):
    rows = [(1, 1, near(0.0)), (2, 2, near(1.0)), (3, 2, near(1.05)), (4, 3, near(2.0)), (5, 9, near(-1.6))]
    got = {r["person_id"]: r["survivor"] for r in identity.consolidate(vectors(spark, rows)).collect()}
    assert got == {1: 2, 2: 2, 3: 2}


def test_merges_follow_time(spark):
    m = spark.createDataFrame([("a", 1, 1, 2), ("a", 2, 2, 3), ("b", 1, 2, 3), ("b", 2, 1, 2)],
                              "library_id string, ts int, person_id int, target_id int")
    got = {(r["library_id"], r["person_id"]): r["survivor"] for r in identity.resolve_merges(m).collect()}
    assert got == {("a", 1): 3, ("a", 2): 3, ("b", 2): 3, ("b", 1): 2}


def test_flags_take_the_last_word(spark):
    p = spark.createDataFrame([("a", 1, "", "Omar", False, True, None), ("a", 2, "", "", True, False, True)], schemas.PERSONS)
    c = spark.createDataFrame([("a", 1, "silence", 1, None), ("a", 2, "rename", 1, "Omar B"), ("a", 3, "forget", 2, None)],
                              "library_id string, ts int, op string, person_id int, name string")
    r = {x["id"]: x for x in identity.person_flags(p, c).collect()}
    assert (r[1]["name"], r[1]["verified"], r[1]["split_suggested"], r[1]["split_silenced"]) == ("Omar B", True, False, True)
    assert (r[2]["verified"], r[2]["split_silenced"]) == (False, False)


def test_hand_placed_clip_without_vectors_keeps_its_person(spark):
    from tests.rows import clips
    c = clips(spark, [dict(id=1, person_id=5), dict(id=2, person_id=5)])
    people = spark.createDataFrame([("a", 5, "", "", False, False, None)], schemas.PERSONS)
    hand = spark.createDataFrame([("a", 1, 5)], "library_id string, id bigint, person_id int")
    got = {r["id"]: r["person_id"] for r in identity.primary_person(c, vectors(spark, []), people, hand).collect()}
    assert got == {1: 5, 2: -1}


def test_a_person_asked_for_by_both_names_has_one_survivor(spark):
    people = spark.createDataFrame([("a", 1, "Ann", "", True, False, None), ("a", 2, "Ann", "Bo", False, False, None),
                                    ("a", 3, "", "Bo", False, False, None), ("a", 4, "Cy", "", False, False, None)], schemas.PERSONS)
    v = vectors(spark, [(1, 1, near(0.0)), (2, 2, near(0.1)), (3, 3, near(0.2)), (4, 3, near(0.3))])
    names = spark.createDataFrame([("a", "ann"), ("a", "BO")], "library_id string, name string")
    merges = identity.merge_all_named(people, v, names)
    assert {(r["person_id"], r["survivor"]) for r in merges.collect()} == {(1, 3), (2, 3), (3, 3)}
    moved = identity.repoint(v, merges)
    assert moved.count() == 4 and {r["person_id"] for r in moved.collect()} == {3}
