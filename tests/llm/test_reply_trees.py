import hashlib
import random

import pytest

from medialib.llm.reply_trees import chain, digest, escape, format_trees, read_back, unescape

HOSTILE = ["", "\\", "\\\\", "</turn>", "<turn user>", "\\</turn>", "\\e", "\\b\\t", "<turn <turn </turn</turn>>", "\\\\e</turn>\\", "a\nb",
           "### Assistant: \\### ok", "é𝄞</turn>ü", " <turn", "turn>", ">"]


def paths_of(rows, keep=None):
    """Root-to-leaf paths by walking up; rows: (tree, id, parent, role, text, score)."""
    best = {}
    for r in rows:
        if r[1] is not None:
            rank = (-(r[5] or 0.0), r[3] or "", r[4] or "")
            if (r[0], r[1]) not in best or rank < best[r[0], r[1]][0]:
                best[r[0], r[1]] = (rank, r)
    nodes = {k: r for k, (_, r) in best.items()}
    parents = {(r[0], r[2]) for r in nodes.values()}
    out = {}
    for (tree, leaf) in nodes:
        if (tree, leaf) in parents:
            continue
        path, at = [], (tree, leaf)
        while at in nodes and len(path) <= len(nodes):
            path.append(nodes[at])
            at = (tree, nodes[at][2])
        if len(path) <= len(nodes):
            score = sum(r[5] or 0.0 for r in path) / len(path)
            out.setdefault(tree, []).append((-score, leaf, [(r[3] or "", r[4] or "") for r in reversed(path)]))
    return {(tree, leaf): (-s, turns) for tree, found in out.items() for s, leaf, turns in sorted(found)[:keep]}


def frame(spark, rows):
    schema = "tree bigint, id bigint, parent bigint, role string, text string, score double, leaf string, up string, depth string, above string"
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema)
    return df.repartition(3) if rows else df


def check(spark, rows, keep=None):
    got = read_back(format_trees(frame(spark, rows), score="score", keep=keep)).collect()
    want = paths_of(rows, keep)
    assert {(r.tree, r.leaf) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        score, turns = want[r.tree, r.leaf]
        assert abs(r.score - score) < 1e-9
        assert [(s.role, s.text) for s in r.said] == turns and r.mask_fits
        # The bounds in the whole text, and nothing else, hold the learned texts.
        cuts = [r.formatted[t.start:t.end] for t in r.turns]
        assert [t.loss for t in r.turns] == [role == "assistant" for role, _ in turns]
        assert [c.replace("\\e", "</turn>").replace("\\t", "<turn ").replace("\\b", "\\") for c in cuts] == [t for _, t in turns]


@pytest.mark.parametrize("keep", [None, 1, 3])
def test_random_trees(spark, keep):
    rnd = random.Random(4)
    rows = []
    for tree in range(25):
        size = rnd.randint(1, 30)
        for i in range(size):
            parent = None if i == 0 else rnd.choice([rnd.randrange(i), i - 1, i - 1])
            rows.append((tree, i, parent, rnd.choice(["user", "assistant", "system", "a>b", "<turn x"]), rnd.choice(HOSTILE), rnd.choice([0.0, 0.5, 1.0, None])))
    rows += [(30, 1, 2, "user", "circle", 1.0), (30, 2, 1, "user", "circle", 1.0), (30, 3, 2, "user", "under it", 1.0), (30, 4, 4, "user", "itself", 1.0),
             (31, 5, 99, "user", "parent absent", 1.0), (31, None, 5, "user", "no id", 1.0), (None, 1, None, None, None, None), (None, 2, 1, "assistant", "n", 2.0),
             (32, 1, None, "user", "twice", 1.0), (32, 1, None, "user", "twice", 1.0), (32, 1, None, "user", "better", 2.0), (32, 2, 1, "assistant", "reply", 0.0),
             (33, 1, None, "user", "two roots", 0.0), (33, 2, None, "user", "tie", 0.0)]
    check(spark, rows, keep)


def test_deep_tree_and_very_long_text(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 1.0) for i in range(700)]
    rows += [(2, 0, None, "user", "long </turn> \\" * 50_000, 1.0), (2, 1, 0, "assistant", "é" * 300_000, 1.0)]
    check(spark, rows)


def test_empty(spark):
    assert format_trees(frame(spark, [])).collect() == []


def test_escapes_are_reversible(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["\\", "<turn ", "</turn>", "<", "/", "e", "b", "t", " "]) for _ in range(12)) for _ in range(500)] + HOSTILE
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", escape(df["t"]).alias("e")).withColumn("back", unescape(escape(df["t"]))).collect()
    assert all(r.back == r.t and "</turn>" not in r.e and "<turn " not in r.e for r in got)


def test_conversations_by_turn(spark):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(HOSTILE)) for c in range(20) for t in range(rnd.randint(1, 9))]
    rows += [(50, 0, None, None), (51, 3, "assistant", "same"), (51, 3, "assistant", "same"), (51, 3, "assistant", "also"), (51, None, "user", "first"),
             (None, 0, "user", "no id"), (None, 1, "assistant", "no id")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, tree string")
    got = {r.conv_id: tuple(r)[1:] for r in digest(read_back(format_trees(chain(turns, "conv_id", "turn")))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    conversations = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        conversations.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(conversations)
    for c, said in conversations.items():
        learned = "".join(t for r, t in said if r == "assistant")
        assert got[c][:4] == (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(learned), sha(learned)) and got[c][5]
