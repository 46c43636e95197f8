import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from medialib.llm.packing import pack, plan
from medialib.llm.tokens import Coder, default_path

TOK = Tokenizer.from_file(default_path())
CODER = Coder(default_path())


def ids(text):
    return TOK.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aAbzZé'ßİΣς́.,!st 12٣ \n\t\x1c\x85\xa0<|>endoftx漢🙂_-Àÿ× ", max_size=30), max_size=6))
def test_ids_equal_the_tokenizer_s(texts):
    texts += ["<|endoftext|>", "A<|ENDOFTEXT|>. b's 'S"]
    assert [x.tolist() for x in CODER.texts(pa.array(texts))] == [ids(t)[:-1] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), max_size=25))
def test_plan_is_best_fit_decreasing(counts):
    runs, opened = plan(counts, 60)
    fill = defaultdict(list)
    order = np.lexsort((runs["rank"], runs["length"]))
    for length, n in counts.items():
        rows = [i for i in order if runs["length"][i] == length]
        starts = [int(runs["rank"][i]) for i in rows]
        for rank in range(n):
            i = rows[np.searchsorted(starts, rank, "right") - 1]
            k = rank - runs["rank"][i]
            fill[int(runs["sequence"][i] + k // runs["fit"][i])].append((int(runs["offset"][i] + k % runs["fit"][i] * length), length))
    assert sorted(fill) == list(range(opened))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 60
    gaps = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        best = min((g for g in gaps if g >= length), default=None)
        if best is None:
            gaps.append(60 - length)
        else:
            gaps.remove(best)
            gaps.append(best - length)
    assert opened == len(gaps)


def test_pieces_and_places(frame, prose):
    rows = [(i, prose(n, i)) for i, n in enumerate([0, 1, 5, 40, 40, 40, 300, 900, 2000])]
    rows += [(50, None), (None, "x"), (3, rows[3][1])]
    got = pack(frame(rows), capacity=256).collect()
    want = []
    for d, t in rows:
        own = ids(t)
        for k, start in enumerate(range(0, len(own), 256)):
            part = own[start:start + 256]
            want.append((d, k, start, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) <= -(-sum(w[3] for w in want) // 256) + 1
    assert pack(frame([])).collect() == []
