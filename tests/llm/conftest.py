import random

import pytest

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu".split()
#: Names that operators use inside; documents may carry them too.
CLASHING = ("t", "doc", "hash", "key", "row", "task", "length", "score", "component", "lines", "bands", "items", "_ld_doc", "_ld_hash", "_ld_runs", "runs", "c0")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)


@pytest.fixture(scope="session")
def prose():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(400)]

    def make(words, seed):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(words))
    return make


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, parts=3):
        rows = [tuple(r) + ("en", "s", len(r[1] or "")) + tuple("x" for _ in CLASHING) for r in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        return df.repartition(parts) if rows else df
    return make
