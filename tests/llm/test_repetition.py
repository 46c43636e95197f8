import random
import re
from collections import Counter

from medialib.llm.repetition import NGRAM_LIMITS, repetition


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def inside(n):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        many = Counter(grams)
        return {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + n)}
    chars = sum(map(len, words))
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            dup_chars += len(line) if line in seen else 0
            seen.add(line)
    shares = [sum(len(words[j]) for j in inside(n)) / max(chars, 1) for n in NGRAM_LIMITS]
    repeat = len(inside(3))
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    line_share = dup_chars / max(len(text), 1)
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, repeat, failed,
            not failed and all(s <= x for s, x in zip(shares, NGRAM_LIMITS.values(), strict=True)) and line_share <= 0.3,
            round(line_share, 9), [round(s, 9) for s in shares])


def test_equal_to_brute_force(frame, prose):
    rnd = random.Random(8)
    rows = []
    for i in range(80):
        lines = [prose(rnd.randint(0, 20), rnd.randint(0, 30)) + rnd.choice(["", "!", " #x é|", "\t", "\r"]) for _ in range(rnd.randint(0, 14))]
        rows.append((i, "\n".join(lines)))
    rows += [(90, None), (91, ""), (92, " \n \n"), (93, "a " * 70), (94, "\n".join(["x y z"] * 40)), (None, "é"), (5, "dup"), (5, "dup"),
             (95, prose(30_000, 9))]
    got = repetition(frame(rows)).collect()
    have = sorted(((r.doc_id, (*tuple(r)[1:8], round(r.dup_line_share, 9), [round(s, 9) for s in r.ngram_shares])) for r in got), key=str)
    assert have == sorted(((d, brute(t)) for d, t in rows), key=str)
    assert repetition(frame([])).collect() == []
