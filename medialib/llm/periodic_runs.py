"""Periodic runs of words: a suffix automaton whose link tree is recoloured by link-cut access.

After word ``e`` is appended, the path from its prefix's state to the root holds every suffix that ends there. Access
recolours that path with ``e``; each piece of it that had one colour tells where its suffixes last ended. A piece with
colour ``e - d`` whose longest suffix has ``d`` words or more is a square of period ``d`` that ends at ``e``: the suffix
and its last occurrence touch or overlap, and no shorter period fits, or the last occurrence would be nearer. A run of
period ``d`` is a square at every end from its ``2 * d``-th word on, so squares of one period at consecutive ends are
one run.

Words that cannot be in a run are left out before: a run of ``least`` words or more and of ``times`` periods says each
of its 5-word windows (or shorter ones, where ``least`` asks for less) at a second place inside itself. So a run lies
within one stretch of words covered by windows that the stretch itself repeats; such stretches are narrowed until they
stay as they are, and each gets an automaton of its own.
"""

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialib.llm.arrays import NOT_SPACE, U64, Block, blocks, mix, ngram_hash, repeated

LEAST, TIMES = 6, 4
#: Passes that narrow stretches; stopping early only leaves more to the automaton.
PASSES = 6

COLUMNS = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
           "runs_sha256 string, collapsed_sha256 string")


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """``(link, length, state of each prefix)`` of the suffix automaton of ``words``; state 0 is the root."""
    link, length, moves, prefix = [-1], [0], [{}], []
    last = 0
    for w in words:
        state = len(link)
        length.append(length[last] + 1)
        moves.append({})
        link.append(0)
        p = last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = state
            p = link[p]
        if p >= 0:
            q = moves[p][w]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(link)
                length.append(length[p] + 1)
                moves.append(dict(moves[q]))
                link.append(link[q])
                link[q] = link[state] = clone
                while p >= 0 and moves[p].get(w) == q:
                    moves[p][w] = clone
                    p = link[p]
        prefix.append(state)
        last = state
    return link, length, prefix


class LastEnds:
    """The link tree as preferred paths in splay trees: all states of one splay tree last ended at the same word.

    ``up`` is the splay parent or, at the root of a splay tree, the state above the top of its path. Splay order is
    depth, so the deepest state of a path is the rightmost.
    """

    def __init__(self, link: list[int], length: list[int]):
        n = len(link)
        self.up, self.left, self.right = list(link), [-1] * n, [-1] * n
        self.length = length
        #: End of the last occurrence, kept at the root of each splay tree.
        self.end = [-1] * n

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner >= 0:
            up[inner] = p
        up[p] = x
        up[x] = g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def _is_root(self, x: int) -> bool:
        p = self.up[x]
        return p < 0 or (self.left[p] != x and self.right[p] != x)

    def _splay(self, x: int) -> None:
        if self._is_root(x):
            return
        root = x
        while not self._is_root(root):
            root = self.up[root]
        end = self.end[root]
        while not self._is_root(x):
            p = self.up[x]
            if not self._is_root(p):
                g = self.up[p]
                self._rotate(p if (self.left[g] == p) == (self.left[p] == x) else x)
            self._rotate(x)
        self.end[x] = end

    def access(self, x: int, e: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from ``x`` to the root with ``e``; give ``(last end, longest suffix)`` of each old piece."""
        below = -1
        v = x
        while v >= 0:
            self._splay(v)
            if self.end[v] >= 0:
                yield self.end[v], self.length[v]
            # What hung below v on its old path becomes a path of its own, with its old colour.
            cut = self.right[v]
            if cut >= 0:
                self.end[cut] = self.end[v]
            self.right[v] = below
            below = v
            v = self.up[v]
        self.end[below] = e
        # x to the root is one path now; x on top keeps later accesses short.
        self._splay(x)
        self.end[x] = e


def squares(words: list[int]) -> list[tuple[int, int]]:
    """``(period, last word)`` of every square whose half is no repetition itself."""
    link, length, prefix = automaton(words)
    tree = LastEnds(link, length)
    found = []
    for e, state in enumerate(prefix):
        for before, longest in tree.access(state, e):
            if longest >= e - before:
                found.append((e - before, e))
    return found


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of at least ``least`` words and ``times`` periods, in order of start, period."""
    ends: dict[int, list[list[int]]] = {}
    for d, e in squares(words):
        spans = ends.setdefault(d, [])
        if spans and spans[-1][1] == e - 1:
            spans[-1][1] = e
        else:
            spans.append([e - 2 * d + 1, e])
    return sorted((s, e - s + 1, d) for d, spans in ends.items() for s, e in spans if e - s + 1 >= max(least, times * d))


def stretches(words: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Bounds of stretches of words outside which no run lies; ``first``: bounds of the texts."""
    # The part of a run before its last period is said again one period later: that many words at least.
    n = max(1, least - least // times)
    low, high = first[:-1], first[1:]
    for _ in range(PASSES):
        wide = high - low >= max(least, n + 1)
        low, high = low[wide], high[wide]
        if not len(low):
            break
        sizes = high - low
        base = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(base[-1]) - np.repeat(base[:-1], sizes) + np.repeat(low, sizes)
        flat = words[at]
        grams = ngram_hash(flat, n)
        whole = np.flatnonzero(owner[:len(grams)] == owner[n - 1:])
        keys = mix(grams[whole] + owner[whole].astype(U64) * U64(0x9E3779B97F4A7C15), 5)
        starts = whole[repeated(keys)]
        depth = np.zeros(len(flat) + 1, np.int64)
        np.add.at(depth, starts, 1)
        np.add.at(depth, starts + n, -1)
        covered = np.cumsum(depth)[:-1] > 0
        # A stretch ends where cover ends or its owner does.
        before = np.concatenate([[False], covered[:-1] & (owner[1:] == owner[:-1])])
        after = np.concatenate([covered[1:] & (owner[1:] == owner[:-1]), [False]])
        begin, end = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after)
        same = len(begin) == len(low) and covered.all()
        low, high = at[begin], at[end] + 1
        if same:
            break
    return list(zip(low.tolist(), high.tolist(), strict=True))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words to read for texts that the contract of the query makes periodic; None: as they stand."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for s, size, d in runs:
        depth[s + d] += 1
        depth[s + size] -= 1
    return np.cumsum(depth)[:-1] == 0


def _measure(block: Block, ids: list[int | None], order: Callable[[int | None, int], np.ndarray | None] | None,
             least: int, times: int) -> Iterator[tuple]:
    """The columns after the id of each text of a block."""
    words = block.word_hash()
    places: list[np.ndarray | None] = [None] * block.texts
    if order:
        places = [order(d, int(n)) for d, n in zip(ids, np.diff(block.first), strict=True)]
        words = words.copy()
        for i, at in enumerate(places):
            if at is not None:
                lo, hi = block.first[i], block.first[i + 1]
                words[lo:hi] = words[lo:hi][at]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(block.texts)]
    for lo, hi in stretches(words, block.first, least, times):
        # The automaton needs equality only: small numbers in place of hashes.
        _, small = np.unique(words[lo:hi], return_inverse=True)
        text = int(np.searchsorted(block.first, lo, "right")) - 1
        base = lo - int(block.first[text])
        runs[text] += [(s + base, size, d) for s, size, d in runs_of(small.tolist(), least, times)]
    raw = block.data.tobytes()
    for i, found in enumerate(runs):
        lo, hi = int(block.first[i]), int(block.first[i + 1])
        found.sort()
        if places[i] is None and not found:
            kept = raw[block.offsets[i]:block.offsets[i + 1]].split()
        else:
            at = (np.arange(hi - lo) if places[i] is None else places[i])[_kept(hi - lo, found)] + lo
            kept = [raw[s:e] for s, e in zip(block.start[at].tolist(), block.end[at].tolist(), strict=True)]
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        yield (len(found), *best, 1000 * best[1] // best[2] if found else None,
               hashlib.sha256("".join(f"{s},{size},{d}\n" for s, size, d in found).encode()).hexdigest(),
               hashlib.sha256(b" ".join(kept)).hexdigest())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES,
                  order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)``, one row per input row.

    A run: consecutive words with smallest period q, at least ``max(least, times * q)`` of them, that no neighbour
    extends (``times`` >= 2). ``start`` (from 0), ``length``, ``period`` and ``exponent_milli`` are those of the longest
    run (ties: smallest start, then period), null where there is none. ``order(doc_id, n)`` may give the places whose
    words are read instead of the text's own order. Digests are of all runs as ``start,length,period`` lines, and of the
    words left when each run keeps its first period only, joined by a space.

    Null or empty text: no words, no runs, digests of nothing. Nulls in the id, repeated rows: each row by itself, rows
    with a null id as they stand. Empty table: no rows. Other columns are not looked at. Memory follows the longest
    periodic text: some 1 kB a word of it.
    """

    def work(batches):
        for b in batches:
            for block in blocks(b.column("t")):
                ids = b.column("doc_id").slice(block.lo, block.texts)
                rows = zip(*_measure(block, ids.to_pylist(), order, least, times), strict=True)
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))],
                                                 [c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(work, COLUMNS)
