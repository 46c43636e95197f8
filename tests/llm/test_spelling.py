import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from medialib.llm import spelling
from medialib.llm.spelling import KdTree, letter_codes, letter_counts, near_words, variants, word_counts
from medialib.llm.steps import Steps

FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


def brute_counts(rows, least, misspell):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(FOLD)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if misspell and doc_id is not None and h % misspell == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            if len(word) >= least:
                out[word] += 1
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, least=6, least_count=5, ratio=5, misspell=None):
    n = {w: c for w, c in brute_counts(rows, least, misspell).items() if c >= least_count}
    near = {w: [o for o in n if abs(len(o) - len(w)) < 2 and one_edit(o, w)] for w in n}
    best = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: o for w, o in best.items() if n[o] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w, ""), root(w), n[w], len(near[w]), n[form[w]] if w in form else -1) for w in n)


def result(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def corpus(rnd, texts, vocabulary):
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(texts):
        words = []
        for w in rnd.choices(vocabulary, weights, k=rnd.randint(0, 120)):
            if rnd.random() < 0.2:
                at = rnd.randrange(len(w))
                w = w[:at] + rnd.choice(["", "a", "é", w[at] + "o"]) + w[at + 1:]
            words.append(rnd.choice([w, w.title(), w.upper()]))
        rows.append((i, "".join(w + rnd.choice([" ", ", ", "\n", "ā", "1", "一", "Ÿ"]) for w in words)))
    return rows


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcéÀ×ÿ" if rnd.random() < .3 else "abde") for _ in range(rnd.randint(4, 10))) for _ in range(60)]
    extra = [(900, None), (901, ""), (None, "éclair " * 7), (902, "aaaaaab " * 6 + "aaaaaa " * 40), (5, "dupword " * 3),
             (5, "dupword " * 3), (903, "x" * 5_000 + " " + ("x" * 4_999 + " ") * 5), (904, ("x" * 5_000 + " ") * 4), (905, "longtext " * 9_000)]
    return corpus(rnd, 150, vocabulary) + extra


@pytest.mark.parametrize("misspell", [None, 7])
def test_counts_equal_brute_force(frame, rows, misspell):
    got = {r.word: r.n for r in word_counts(frame(rows), misspell=misspell).collect()}
    assert got == dict(brute_counts(rows, 6, misspell))


@pytest.mark.parametrize("bounds", [{}, {"sample": 60, "cell": 8, "members": 5}])
def test_equal_to_brute_force(frame, rows, bounds):
    assert result(variants(frame(rows), misspell=7, **bounds)) == brute(rows, misspell=7)


def test_edges(frame):
    assert variants(frame([])).collect() == []
    assert variants(frame([(1, None), (2, "short words"), (None, "")])).collect() == []
    chain = [(1, "abcdefg " * 5 + "abcdefh " * 25 + "abcdeih " * 125 + "abcjeih " * 625 + "kbcjeih " * 3_125)]
    assert {r.root for r in variants(frame(chain)).collect()} == {"kbcjeih"}
    tied = [(1, "mmmmmm " * 5 + "mmmmmz " * 30 + "mmmmma " * 30 + "mmmmmé " * 30)]
    assert {r.word: r.form for r in variants(frame(tied)).collect()}["mmmmmm"] == "mmmmma"
    with pytest.raises(ValueError):
        variants(frame([]), ratio=1)


def test_words_of_the_same_letters_are_all_compared(spark):
    # Every order of the same letters: no count parts them, so blocks and halves do.
    rnd = random.Random(9)
    words = sorted({"".join(rnd.sample("aabbbcccdd", 10)) for _ in range(1_500)} | {"".join(rnd.sample("aabbbcccdde", 11)) for _ in range(300)})
    words += [w[:4] + "x" + w[5:] for w in words[:200]] + [w[:7] + w[8:] for w in words[:200]]
    words = sorted(set(words))
    df = spark.createDataFrame([(w, i + 5) for i, w in enumerate(words)], "word string, n bigint").repartition(3)
    got = sorted((r.word, r.other, r.other_n) for r in near_words(df, Steps(spark, "t"), members=400).collect())
    place = {w: i + 5 for i, w in enumerate(words)}
    known = set(words)
    want = {(a, b) for a in words for i in range(len(a))
            for b in {a[:i] + a[i + 1:], *(a[:i] + c + a[i + 1:] for c in "abcdex")} if b in known and b != a}
    want |= {(b, a) for a, b in want}
    assert got == sorted((a, b, place[b]) for a, b in want)


def test_boxes_out_of_reach_hold_no_near_word():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(800)]
    counts = letter_counts(letter_codes(words, 7))
    tree = KdTree(counts, 16)
    assert sorted(np.concatenate([r for r in tree.rows if r is not None]).tolist()) == list(range(800))
    ask = letter_counts(letter_codes([w[:3] + "a" + w[3:] for w in words], 8))
    for counts_asked, fewer in ((counts, 1), (ask, 0)):
        seen = {(int(q), int(m)) for leaf, rows in tree.reach(counts_asked, fewer, 1) for q in rows for m in tree.rows[leaf]}
        assert len(seen) < 0.5 * 800 * 800
        change = counts[None, :, :] - counts_asked[:, None, :]
        fits = (np.maximum(change, 0).sum(2) <= fewer) & (np.maximum(-change, 0).sum(2) <= 1)
        assert set(zip(*np.nonzero(fits))) <= seen


def test_check_sums_of_long_runs():
    import pyarrow as pa
    from medialib.llm.arrays import blocks
    runs = spelling.Letters(next(iter(blocks(pa.array(["abc é" + "Q" * 200 + "÷", "zz"])))))
    which = np.arange(len(runs.start))
    heads = np.array([zlib.crc32(b"-12:")] * len(which), np.uint32)
    raw = runs.data.tobytes()
    assert [zlib.crc32(b"-12:" + raw[s:e]) for s, e in zip(runs.start, runs.end)] == spelling.checksums(runs, which, heads).tolist()
