import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from medialib.session import settle
from medialib.sources import catalog, schemas
from medialib.streaming import jobs
from medialib.streaming.taste_state import TasteProcessor, fade
from medialib.streaming.upserts import Upserts
from tests.rows import clips

DAY_MS = 86_400_000
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
T0_MS = int(T0.timestamp() * 1000)


def event(row, clip, day, completion, viewer=1):
    return (row, viewer, "a", clip, T0 + dt.timedelta(days=day), float(completion), completion < 0.15, 9)


def events(spark, rows):
    return spark.createDataFrame(rows, schemas.WATCH_EVENTS)


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def state(table):
    return {(r["viewer_id"], r["key"]): (round(r["likes"], 6), round(r["dislikes"], 6), r["last_seen_ms"], r["learned_at_ms"])
            for r in jobs.learned_taste(table).collect()}


def fold(known, learned, batch, keys, now):
    """The rule event by event: fade what is known, then vote; ``batch``: (clip, day, completion)."""
    stamp = now if learned is None else learned
    if learned is not None:
        h = (now - learned) / (21 * DAY_MS)
        if h >= 0.5:
            known = {k: (a * 0.5 ** h, d * 0.5 ** h, t) for k, (a, d, t) in known.items() if (a + d) * 0.5 ** h >= 1}
    for clip, day, completion in batch:
        if clip not in keys or 0.2 <= completion < 0.7:
            continue
        at = T0_MS + round(day * DAY_MS)
        for k in keys[clip]:
            a, d, t = known.get(k, (0.0, 0.0, 0))
            known[k] = (a + (completion >= 0.7), d + (completion < 0.2), max(t, at))
        stamp = max(stamp, at)
    return known, stamp


@pytest.mark.parametrize("event_time", [False, True])
def test_taste_stream_equals_the_rule_and_restarts_from_its_checkpoint(spark, tmp_path, event_time):
    rnd = random.Random(7)
    lib = clips(spark, [dict(id=1, category="pet"), dict(id=2, category="trip"), dict(id=3, category="pet", person_id=4, duration_ms=9_000)])
    keys = {1: ["cat:pet", "folder:f", "dur:long"], 2: ["cat:trip", "folder:f", "dur:long"], 3: ["cat:pet", "person:4", "folder:f", "dur:short"]}
    src, table = str(tmp_path / "ev"), jobs.taste_table(spark, str(tmp_path / "t"))
    want, row, sent = {}, 0, []
    for first_day, now_day in ((0, 4), (5, 9), (21, 26), (60, 70)):
        rows = []
        for viewer in (1, 2):
            said = [(rnd.choice([1, 2, 3, 99]), first_day + rnd.randint(0, 3), rnd.choice([0.1, 0.5, 0.9, 0.95])) for _ in range(5 if first_day else 12)]
            if viewer == 2 and first_day == 5:
                continue  # a viewer without news stays as it was
            known, learned = want.get(viewer, ({}, None))
            want[viewer] = fold(known, None if event_time else learned, said, keys, T0_MS + now_day * DAY_MS)
            if event_time and learned is not None:
                want[viewer] = (want[viewer][0], max([learned, *(t for _, _, t in want[viewer][0].values())]))
            for clip, day, completion in said:
                row += 1
                rows.append(event(row, clip, day, completion, viewer))
        events(spark, rows + rows + sent[-3:]).coalesce(1).write.mode("append").parquet(src)
        sent += rows
        # Each delivery is a run of its own: state comes from the checkpoint alone.
        run(jobs.learn_taste(jobs.event_stream(spark, src), lib, table, str(tmp_path / "cp"), F.lit(T0_MS + now_day * DAY_MS),
                             event_time, late="90 days"))
    got = state(table)
    assert got == {(v, k): (round(a, 6), round(d, 6), t, learned) for v, (known, learned) in want.items() for k, (a, d, t) in known.items()}
    run(jobs.learn_taste(jobs.event_stream(spark, src), lib, table, str(tmp_path / "cp"), F.lit(0), event_time, late="90 days"))
    assert state(table) == got  # nothing new: the cursor holds


def test_late_events_are_left_out_by_the_stream_itself(spark, tmp_path):
    lib, src = clips(spark, [dict(id=1, category="pet")]), str(tmp_path / "ev")
    table = jobs.taste_table(spark, str(tmp_path / "t"))
    # Spark judges lateness by the watermark of the batch before.
    for rows in ([event(1, 1, 10, 0.9)], [event(2, 1, 10, 0.9)], [event(3, 1, 2, 0.9), event(4, 1, 10, 0.9)]):
        events(spark, rows).coalesce(1).write.mode("append").parquet(src)
    run(jobs.learn_taste(jobs.event_stream(spark, src, 1), lib, table, str(tmp_path / "cp")))
    assert state(table)[(1, "cat:pet")][0] == 3.0


def test_counters_survive_repeats_cap_attention_and_write_what_a_batch_touched(spark, tmp_path):
    rows = [event(i, 1, i / 10, 0.9) for i in range(5)] + [event(9, 2, 0, 0.05)]
    src, marks = str(tmp_path / "ev"), str(tmp_path / "fav")
    events(spark, rows + rows).repartition(3).write.parquet(src)
    spark.createDataFrame([("a", 2), ("a", 7)], "library_id string, video_id bigint").write.parquet(marks)
    table = jobs.counters_table(spark, str(tmp_path / "t"))

    def go():
        marked = spark.readStream.schema("library_id string, video_id bigint").parquet(marks)
        run(jobs.live_counters(jobs.event_stream(spark, src, 1), table, str(tmp_path / "cp"), marked, late="30 days"))
    go()
    seen = lambda: {r["video_id"]: (r["watch_count"], r["skip_count"], r["attention"]) for r in table.read().collect()}
    assert seen() == {1: (5, 0, 3.0), 2: (1, 1, 1.5), 7: (0, 0, 1.5)}
    before = {r["batch"] for r in spark.read.parquet(table.root).select("batch").distinct().collect()}
    events(spark, [event(20, 2, 3, 0.9)]).write.mode("append").parquet(src)
    go()
    assert seen() == {1: (5, 0, 3.0), 2: (2, 1, 2.5), 7: (0, 0, 1.5)}
    fresh = spark.read.parquet(table.root).where(~F.col("batch").isin(list(before)))
    assert [r["video_id"] for r in fresh.collect()] == [2]


def test_upserts_newest_row_counts_and_a_retry_replaces_its_batch(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "k bigint, v string, gone boolean")
    table = Upserts(spark, str(tmp_path / "t"), ["k"], "k BIGINT, v STRING, gone BOOLEAN", tombstone="gone").start(make((1, "a", False), (2, "b", None)))
    table.start(make((9, "z", False)))  # it exists: nothing happens
    table.write(make((2, "c", False), (3, "d", False)), 0)
    table.write(make((1, "x", True), (3, "half", False)), 1)
    table.write(make((1, "x", True), (3, "e", False)), 1)
    rows = lambda **how: sorted((r.k, r.v) for r in table.read(**how).collect())
    assert rows() == [(2, "c"), (3, "e")]
    assert rows(below=1) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(only=make((3, "", False), (4, "", False))) == [(3, "e")]
    copy = Upserts(spark, str(tmp_path / "u"), ["k"], table.schema, "gone").start(table.read())
    assert sorted((r.k, r.v) for r in copy.read().collect()) == rows()


def test_events_are_appended_once_by_day(spark, tmp_path):
    src, out = str(tmp_path / "ev"), str(tmp_path / "out")
    rows = [event(i, 1, i / 2, 0.5) for i in range(8)]
    events(spark, rows + rows).repartition(2).write.parquet(src)
    run(jobs.append_event_stream(jobs.event_stream(spark, src, 1), out, str(tmp_path / "cp"), late="30 days"))
    events(spark, [event(7, 1, 3.5, 0.5), event(8, 1, 4, 0.5)]).write.mode("append").parquet(src)
    run(jobs.append_event_stream(jobs.event_stream(spark, src, 1), out, str(tmp_path / "cp"), late="30 days"))
    assert sorted(r["row_id"] for r in catalog.read_events(spark, out).collect()) == list(range(9))


def test_change_feed_touches_only_named_rows_and_never_sweeps(spark, tmp_path):
    known = clips(spark, [dict(id=1, category="pet"), dict(id=2)])
    table = Upserts(spark, str(tmp_path / "t"), ["library_id", "id"], schemas.CLIPS).start(known)
    listing = spark.createDataFrame([("a", i, f"new{i}.mp4", "f", 30_000, 10, 1_700_000_000, 10, 10) for i in (1, 2, 3)],
                                    "library_id string, id bigint, display_name string, folder_name string, duration_ms bigint, "
                                    "size_bytes bigint, date_added_sec bigint, width int, height int")
    src = str(tmp_path / "ch")
    spark.createDataFrame([("a", 1), ("a", 1), ("a", 3)], "library_id string, id bigint").write.parquet(src)
    changes = spark.readStream.schema("library_id string, id bigint").parquet(src)
    run(jobs.follow_changes(changes, lambda: listing, table, str(tmp_path / "cp")))
    got = {r["id"]: (r["display_name"], r["category"]) for r in table.read().collect()}
    assert got == {1: ("new1.mp4", "pet"), 2: ("x.mp4", "unknown"), 3: ("new3.mp4", "unknown")}
    assert settle(spark.read.parquet(f"{table.root}/batch=0")).count() == 2


def test_vectors_are_placed_as_they_arrive(spark, tmp_path):
    src = str(tmp_path / "v")
    row = lambda i, v: ("a", i, i, -1, v, 1.0)
    people = spark.createDataFrame([], schemas.PERSONS)
    none = spark.createDataFrame([], schemas.DENIALS)
    table = jobs.vectors_table(spark, str(tmp_path / "t")).start()
    go = lambda: run(jobs.follow_vectors(spark.readStream.schema(schemas.VECTORS).parquet(src), lambda: people, lambda: none,
                                         table, str(tmp_path / "cp")))
    for rows in ([row(1, [1.0, 0.0]), row(2, [0.99, 0.1])], [row(3, [0.98, 0.15]), row(4, [0.0, 1.0])]):
        spark.createDataFrame(rows, schemas.VECTORS).coalesce(1).write.mode("append").parquet(src)
        go()
    assert {r["id"]: r["person_id"] for r in table.read().collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert {r["id"] for r in spark.read.parquet(f"{table.root}/batch=1").collect()} == {3, 4}


def test_a_batch_reads_and_writes_the_state_of_a_viewer_once():
    class Value:
        calls, held = 0, None

        def exists(self):
            return self.held is not None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, row):
            self.calls, self.held = self.calls + 1, row

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return states.setdefault(name, Value())

        def getMapState(self, *a):  # noqa: N802
            raise AssertionError("a round trip for each bucket")

    states, day = {}, 86_400_000
    votes = lambda names, at: pd.DataFrame({"key": names, "liked": 1.0, "disliked": 0.0, "at_ms": at, "now_ms": at})
    learner = TasteProcessor(True)
    learner.init(Handle())
    names = [f"k{i}" for i in range(200)]
    list(learner.handleInputRows((1, "a"), iter([votes(names, 0), votes([*names[:100], None], 0)]), None))
    got = next(learner.handleInputRows((1, "a"), iter([votes(["k0", "new"], 21 * day)]), None)).set_index("key")
    assert [v.calls for v in states.values()] == [3]
    # After three weeks one vote is too little to keep, two are not unless a half-life has gone by.
    want = {n: fade(2.0 if i < 100 else 1.0, 0.0, 21 * day) for i, n in enumerate(names)}
    assert got.loc["k0", "likes"] == (want["k0"] or (0.0,))[0] + 1 and got.loc["new", "likes"] == 1.0
    kept = dict(zip(states["taste"].held[1], states["taste"].held[2], strict=True))
    assert kept == {n: b[0] for n, b in want.items() if b} | {"k0": got.loc["k0", "likes"], "new": 1.0}
