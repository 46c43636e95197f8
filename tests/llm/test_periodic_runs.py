import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from medialib.llm.periodic_runs import LastEnds, automaton, periodic_runs, planted, runs_of, stretches


def brute_runs(words, least=6, times=4):
    """Runs by comparing the words with themselves at every shift."""
    out, n = [], len(words)
    for d in range(1, n // 2 + 1):
        i = 0
        while i + d < n:
            j = i
            while j + d < n and words[j] == words[j + d]:
                j += 1
            size = j - i + d
            if j > i and size >= max(least, times * d) and not any(
                    all(words[k] == words[k + p] for k in range(i, i + size - p)) for p in range(1, d)):
                out.append((i, size, d))
            i = j + 1 if j == i else j
    return sorted(out)


def brute_row(doc_id, text, least=6, times=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, least, times)
    kept = [w for i, w in enumerate(words) if not any(s + d <= i < s + size for s, size, d in runs)]
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    first = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, hashlib.sha256("".join(f"{s},{z},{d}\n" for s, z, d in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(kept).encode()).hexdigest())


def patterned(rnd, letters):
    words = [rnd.randrange(letters) for _ in range(rnd.randint(0, 50))]
    for _ in range(rnd.randint(0, 2)):
        at, period = rnd.randint(0, len(words)), rnd.randint(1, 7)
        words[at:at] = (words[at:at + period] * rnd.randint(1, 8))[:rnd.randint(0, 40)]
    return words


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (3, 3)])
def test_runs_and_stretches_equal_brute_force(least, times):
    rnd = random.Random(least)
    for _ in range(600):
        words = patterned(rnd, rnd.randint(1, 4))
        want = brute_runs(words, least, times)
        assert runs_of(words, least, times) == want
        hashed = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        cut = [(s + lo, size, d) for lo, hi in stretches(hashed, np.array([0, len(words)]), least, times)
               for s, size, d in runs_of(words[lo:hi], least, times)]
        assert sorted(cut) == want


def test_access_gives_the_last_end_of_every_suffix():
    rnd = random.Random(3)
    for _ in range(60):
        words = patterned(rnd, 2)
        link, length, prefix = automaton(words)
        tree = LastEnds(link, length)
        for e, state in enumerate(prefix):
            pieces = sorted(tree.access(state, e), key=lambda p: p[1])
            for size in range(1, e + 1):
                before = max((j for j in range(size - 1, e) if words[j - size + 1:j + 1] == words[e - size + 1:e + 1]), default=None)
                assert next((end for end, longest in pieces if longest >= size), None) == before


def test_equal_to_brute_force(frame, prose):
    rnd = random.Random(21)
    rows = []
    for i in range(260):
        kind = i % 4
        text = prose(rnd.randint(0, 90), i) if kind < 2 else " ".join("né%d" % w for w in patterned(rnd, 3))
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(text.split(" ")) + rnd.choice(["", " ", "\n"])))
    rows += [(700, None), (701, ""), (702, " \n"), (703, "a " * 6), (704, "a " * 5), (705, "a b " * 4), (706, "a b " * 3),
             (707, "x " + "a b c " * 5 + "a y " + "q " * 9), (None, "z " * 8), (5, "dup " * 7), (5, "dup " * 7), (-10, "u v " * 5),
             (708, "a a " * 8)]
    assert sum(planted(i, 5) is not None for i, _ in rows) > 10
    got = [tuple(r) for r in periodic_runs(frame(rows), order=planted).collect()]
    assert sorted(got, key=str) == sorted((brute_row(*r) for r in rows), key=str)
    assert periodic_runs(frame([])).collect() == []


def test_very_long_texts(frame, prose):
    text = prose(3_000, 5)
    rows = [(1, text + " stop " + " ".join([prose(700, 6)] * 9)), (2, "w " * 60_000), (3, prose(40_000, 7))]
    got = {r.doc_id: tuple(r)[1:6] for r in periodic_runs(frame(rows)).collect()}
    assert got[1] == (1, 3_001, 6_300, 700, 9_000)
    assert got[2] == (1, 0, 60_000, 1, 60_000_000)
    assert got[3] == (0, None, None, None, None)
