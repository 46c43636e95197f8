import random
import re

import pytest

from medialib.llm.near_dup import near_duplicates


def brute(rows, shingle=3, percent=85):
    def fold(t):
        return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets.append({tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("edits", [1, 3, 8])
def test_components_equal_all_pairs(frame, prose, edits):
    rnd = random.Random(edits)
    rows = []
    for family in range(6):
        words = prose(80 + 10 * family, family).split()
        for _ in range(14):
            if rnd.random() < 0.3:
                words = list(words)  # a chain: later ones start from an edited one
            own = list(words)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(len(own))] = "edit" + str(rnd.randrange(10 ** 6))
            words = own if rnd.random() < 0.4 else words
            rows.append((len(rows) * 7 % 1009, " ".join(own).upper() if rnd.random() < 0.3 else " ".join(own)))
    rows += [(2000 + i, t) for i, t in enumerate(["", None, "one", "One two", "one  two", " \n", "ONE TWO", "é", "É", "a b c", "a\tb\nc"])]
    got = [tuple(r) for r in near_duplicates(frame(rows)).collect()]
    assert sorted(got) == brute(rows)


def test_edges(spark, frame, prose):
    assert near_duplicates(frame([])).collect() == []
    text = prose(60, 1)
    got = near_duplicates(frame([(None, text), (5, text), (5, text), (3, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got) == [
        (0, 58, 5, True), (3, 0, 3, True), (5, 58, 5, True), (5, 58, 5, True)]
    long = prose(40_000, 2)
    got = near_duplicates(frame([(1, long), (2, long + " tail")])).collect()
    assert {r.component_id for r in got} == {1}


def test_a_large_group_of_copies_and_near_copies(frame, prose):
    base = prose(120, 3).split()
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(300 + i, " ".join(base[:40] + [f"w{i}"] + base[41:])) for i in range(300)]
    got = near_duplicates(frame(rows)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
