import random

from medialib.llm.line_dedup import dedup_lines


def filled(text):
    return [" ".join(x.split()) for x in text.split("\n") if x.split()]


def test_later_runs_go_and_first_ones_stay(frame, prose):
    rnd = random.Random(3)
    pool = [prose(rnd.randint(1, 6), i) for i in range(40)]
    rows = []
    for i in range(60):
        lines = [rnd.choice(pool + [f"own {i} {j}" for j in range(15)]) for j in range(rnd.randint(0, 12))]
        if rows and rnd.random() < 0.6:
            other = rnd.choice(rows)[1].split("\n")
            at = rnd.randint(0, max(0, len(other) - 1))
            lines[rnd.randint(0, len(lines)):0] = other[at:at + rnd.randint(1, 6)]
        rows.append((i, "\n".join(x + rnd.choice(["", "", "\n", "  "]) for x in lines)))
    got = {r.doc_id: r for r in dedup_lines(frame(rows), removed_col="gone").collect()}
    before = dict(rows)
    kept = {d: filled(r.text) for d, r in got.items()}
    # Order of the kept lines is that of the text; nothing is made up.
    for d, r in got.items():
        left = iter(before[d].split("\n"))
        assert all(x in left for x in r.text.split("\n")) or r.text == ""
        assert r.gone == len(before[d].split("\n")) - (len(r.text.split("\n")) if r.gone == 0 or r.text else 0) or r.text == ""
    # The first place of every pair of lines stays with the corpus: every line still stands somewhere.
    assert {x for t in before.values() for x in filled(t)} == {x for t in kept.values() for x in t}
    # Guarantee: of every run of three lines that stands in an earlier document, two lines or more are gone.
    seen = set()
    for d in sorted(before):
        own = filled(before[d])
        runs = [tuple(own[i:i + 3]) for i in range(len(own) - 2)]
        if any(r in seen for r in runs):
            assert len(own) - len(kept[d]) >= 2
        seen |= set(runs)
    # Only lines inside pairs that stand earlier go.
    pairs = set()
    for d in sorted(before):
        own = filled(before[d])
        mine = [tuple(own[i:i + 2]) for i in range(len(own) - 1)]
        repeated = {x for i, p in enumerate(mine) if p in pairs or p in mine[:i] for x in p}
        gone = list(own)
        for x in kept[d]:
            gone.remove(x)
        assert set(gone) <= repeated
        pairs |= set(mine)


def test_copies_and_edges(frame):
    text = "alpha one\nbeta two\ngamma three\n\ndelta four"
    rows = [(1, text), (2, text), (3, "head\n" + text + "\ntail"), (4, None), (5, ""), (None, text), (6, "alpha one"), (2, text),
            (7, "z z\n" * 6)]
    got = sorted(((r.doc_id or 0, r.text) for r in dedup_lines(frame(rows)).collect()), key=str)
    assert got == sorted([(1, text), (2, ""), (2, ""), (3, "head\ntail"), (4, None), (5, ""), (0, text), (6, "alpha one"),
                          (7, "z z")], key=str)
    assert dedup_lines(frame([])).collect() == []
    assert dedup_lines(frame(rows)).columns == frame(rows).columns


def test_single_lines_and_pairs(frame, prose):
    long = prose(60, 1)
    rows = [(1, f"a b\nc d\n{long}\ne f"), (2, f"own\n{long}\nown two"), (3, "x y\na b\nc d\nz z"), (4, f"a b\n{long}"), (5, long)]
    got = {r.doc_id: r.text for r in dedup_lines(frame(rows)).collect()}
    assert got == {1: rows[0][1], 2: "own\nown two", 3: "x y\nz z", 4: "a b", 5: ""}
    got = {r.doc_id: r.text for r in dedup_lines(frame(rows), lone=1).collect()}
    assert got == {1: rows[0][1], 2: "own\nown two", 3: "x y\nz z", 4: "", 5: ""}
    rnd = random.Random(8)
    pool = [prose(rnd.randint(1, 12), i) for i in range(30)]
    rows = [(i, "\n".join(rnd.choice([*pool, f"own {i} {j}"]) for j in range(rnd.randint(0, 12)))) for i in range(60)]
    got = {r.doc_id: filled(r.text) for r in dedup_lines(frame(rows), lone=1).collect()}
    pairs = {r.doc_id: filled(r.text) for r in dedup_lines(frame(rows), lone=99).collect()}
    wide = {r.doc_id: filled(r.text) for r in dedup_lines(frame(rows), window=2).collect()}
    seen, twos = set(), set()
    for d, text in rows:
        own = filled(text)
        assert got[d] == [x for x in dict.fromkeys(own) if x not in seen]
        assert all(x not in seen for x in wide[d] if len(x.split()) >= 8)
        seen |= set(own)
        gone = set()
        for i, p in enumerate(zip(own, own[1:])):
            gone |= {i, i + 1} if p in twos else set()
            twos.add(p)
        assert pairs[d] == [x for i, x in enumerate(own) if i not in gone]


def test_runs_and_single_lines_across_parts(frame, monkeypatch):
    """Winnowed runs, then single lines: together every later repeat goes, in texts of many parts too."""
    rnd = random.Random(21)
    base = [f"line {i} of it" for i in range(700)]
    rows = [(1, "\n".join(base)), (2, "\n".join(["new start", *base[100:500], "new end", *base[90:95]])), (3, "x\n" * 900 + "\n".join(base[300:640])),
            (4, "\n".join(rnd.choice(base[:40]) for _ in range(600))), (5, "\n".join(["x", "y"] * 400)), (5, "\n".join(base[5:300])), (5, "own 5\nx")]
    got = [(r.doc_id, filled(r.text)) for r in dedup_lines(frame(rows), window=3, lone=1).collect()]
    assert sorted(got) == [(1, base), (2, ["new start", "new end"]), (3, ["x"]), (4, []), (5, []), (5, ["own 5"]), (5, ["y"])]
    wide = {r.doc_id: filled(r.text) for r in dedup_lines(frame(rows[:2]), window=4, lone=99).collect()}
    assert wide[2][:2] == ["new start", "new end"]  # the runs are found from fingerprints alone
