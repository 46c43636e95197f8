import random

from medialib.llm.decontaminate import brute_force, decontaminate, digest, split_span, winnow


def test_every_shared_span_is_found(spark, frame, prose):
    rnd = random.Random(4)
    items = [(i, prose(rnd.choice([3, 8, 10, 11, 25, 40]), 100 + i)) for i in range(25)]
    items += [(90, ""), (91, None), (None, "x y z"), (92, items[0][1]), (93, "the-Same, words; the same words")]
    rows = []
    for i in range(60):
        words = prose(rnd.randint(0, 120), 500 + i).split()
        for _ in range(rnd.randint(0, 3)):
            own = rnd.choice(items)[1] or ""
            part = own.split()[rnd.randint(0, 3):rnd.randint(4, 40)]
            at = rnd.randint(0, len(words))
            words[at:at] = part
        rows.append((i, " ".join(words).title() + ("." if i % 3 else "")))
    rows += [(70, None), (71, ""), (72, "the same words"), (73, "The Same Words THE SAME words the same words")]
    bench = spark.createDataFrame([(*x, "s", 1) for x in items], "item_id bigint, text string, words string, place int")
    got = sorted(tuple(r) for r in digest(decontaminate(frame(rows), bench)).collect())
    assert got == sorted(brute_force(rows, items))


def test_edges(spark, frame):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    rows = [(1, "a b"), (None, "c"), (1, "a b")]
    got = [tuple(r)[:4] for r in digest(decontaminate(frame(rows), bench)).collect()]
    assert sorted(got, key=str) == [(1, 2, 0, 0), (1, 2, 0, 0), (None, 1, 0, 0)]
    assert decontaminate(frame([]), bench).collect() == []


def test_winnowing_guarantee():
    import numpy as np
    rnd = np.random.RandomState(1)
    for span in range(1, 13):
        k, window = split_span(span)
        assert k + window - 1 == span and k >= 1
        x = rnd.randint(0, 5, size=200).astype(np.uint64)
        at = winnow(x, window)
        assert all(((at >= i) & (at < i + window)).any() for i in range(len(x) - window + 1))
