"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One inserted, deleted or replaced letter changes the counts of a word's letters by two at most: a replaced one takes one
letter and gives another, an inserted or deleted one is a single letter more or less. So for each pair of lengths (equal,
or one letter longer) a word need only be compared with the words of those boxes of a k-d tree that it can reach with
that many letters more and fewer; what a box holds is then verified letter by letter.

A first tree a length, fitted on a bounded sample of words (``SAMPLE``), cuts the vocabulary into cells. Every word is a
member of one cell and asks in every cell it can reach; a longer word asks the shorter ones, equal lengths ask cells
after their own, so each pair meets once. A task sorts by cell, keeps one cell's members with a tree of their own, and
lets the askers stream past. Cells that sampling left too large, or that no letter count can cut (anagrams), are dealt
into blocks of bounded size, each asked in turn.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialib.llm.arrays import FOLD, Block, blocks, mix, text_of
from medialib.llm.steps import Steps

LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: Words the first trees are fitted on, all lengths together; words a cell should hold; words of a leaf inside a cell.
SAMPLE, CELL, LEAF = 50_000, 4_096, 16
#: Most members a task keeps at once, in words and in letters; and letters of askers looked at in one go.
MEMBERS, LETTERS = 16_384, 1 << 22
#: A node of which no letter count parts at least this share stays a leaf.
SHARE = 1 / 32
#: a-z, then U+00C0 to U+00FF.
ALPHABET = 26 + 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = True


def _crc_table() -> np.ndarray:
    """The byte table of crc32 by its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_TABLE = _crc_table()


class Letters(Block):
    """The maximal runs of a-z (A-Z folded) and U+00C0 to U+00FF of a block of texts."""

    def __init__(self, block: Block):
        self.lo, self.offsets, self.texts = block.lo, block.offsets, block.texts
        self.data = data = FOLD[block.data]
        n = len(data)
        inside = _LETTER[data]
        # Bytes 80 to BF are letters after C3 only.
        inside[1:] &= (data[1:] & 0xC0 != 0x80) | (data[:-1] == 0xC3)
        if n:
            inside[0] &= data[0] & 0xC0 != 0x80
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)


def checksums(runs: Letters, which: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """crc32 of ``head + run`` for the runs ``which``; ``heads``: crc32 of each run's head."""
    start, size = runs.start[which], (runs.end - runs.start)[which]
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    state = heads[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    longest = int(size[0]) if len(size) else 0
    for j in range(min(longest, 64)):
        k = int(np.searchsorted(-size, -j, "left"))
        s = state[:k]
        state[:k] = _TABLE[(s ^ runs.data[start[:k] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-size, -64, "left"))):
        state[i] = zlib.crc32(runs.data[start[i] + 64:start[i] + size[i]].tobytes(), int(state[i]))
    out = np.empty(len(which), np.uint32)
    out[order] = state
    return out


def _spellings(runs: Letters, ids: list[int | None], least: int, misspell: int | None) -> tuple[list[bytes], np.ndarray]:
    """Distinct results of the runs of a block, as UTF-8, and how often each occurs."""
    which = np.flatnonzero(runs.word_chars() >= least)
    if not len(which):
        return [], np.zeros(0, np.int64)
    raw = runs.data.tobytes()
    changed: list[bytes] = []
    if misspell:
        known = np.array([d is not None for d in ids])
        heads = np.array([zlib.crc32(f"{d}:".encode()) for d in ids], np.uint32)
        owner = text_of(runs)[which]
        sums = checksums(runs, which, heads[owner])
        hit = (sums % np.uint32(misspell) == 0) & known[owner]
        for i, h in zip(which[hit].tolist(), sums[hit].tolist(), strict=True):
            word = raw[runs.start[i]:runs.end[i]].decode()
            at = h % len(word)
            if len(word) > least:
                changed.append((word[:at] + word[at + 1:]).encode())
        which = which[~hit]
    _, at, n = np.unique(runs.word_hash()[which], return_index=True, return_counts=True)
    at = which[at]
    words = [raw[s:e] for s, e in zip(runs.start[at].tolist(), runs.end[at].tolist(), strict=True)]
    return words + changed, np.concatenate([n, np.ones(len(changed), np.int64)])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS,
                misspell: int | None = None) -> DataFrame:
    """``(word, n)``: distinct runs of letters of at least ``least`` code points and how often they occur, over whole texts.

    ``misspell``: a run loses one code point where that number divides the crc32 of ``id:run``; rows without an id
    count as they stand.
    """

    def work(batches):
        for b in batches:
            for block in blocks(b.column("t")):
                ids = b.column("doc_id").slice(block.lo, block.texts).to_pylist()
                words, n = _spellings(Letters(block), ids, least, misspell)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                                                 ["word", "n"])

    cut = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"))
    return cut.mapInArrow(work, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def letter_codes(words: list[str], length: int) -> np.ndarray:
    """One row a word of that length: 0-25 for a-z, then U+00C0 to U+00FF."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)
    return np.where(flat >= 0xC0, flat - np.uint8(0xC0 - 26), flat - np.uint8(0x61))


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """One row a word: how often it has each letter."""
    n, length = codes.shape
    flat = (np.arange(n)[:, None] * ALPHABET + codes).ravel()
    return np.bincount(flat, minlength=n * ALPHABET).reshape(n, ALPHABET).astype(np.int32)


class KdTree:
    """Boxes of letter counts; each inner node parts words with at most ``cut`` of one letter from those with more."""

    def __init__(self, counts: np.ndarray, leaf: int):
        self.letter, self.cut, self.low, self.high = [], [], [], []
        #: Rows of ``counts`` in each leaf, by node.
        self.rows: list[np.ndarray | None] = []
        todo = [(np.arange(len(counts)), None, "")]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.letter)
            if parent is not None:
                getattr(self, side)[parent] = node
            letter, cut = self._best_cut(counts[rows]) if len(rows) > leaf else (-1, 0)
            for field, value in ((self.letter, letter), (self.cut, cut), (self.low, -1), (self.high, -1)):
                field.append(value)
            self.rows.append(rows if letter < 0 else None)
            if letter >= 0:
                fits = counts[rows, letter] <= cut
                todo += [(rows[~fits], node, "high"), (rows[fits], node, "low")]

    @staticmethod
    def _best_cut(counts: np.ndarray) -> tuple[int, int]:
        """The letter and count that part the words most evenly; letter -1 if none parts off ``SHARE`` of them."""
        n, best = len(counts), (0, -1, 0)
        top = counts.max(axis=0)
        for cut in range(min(int(top.max()), 4)):
            more = np.count_nonzero(counts > cut, axis=0)
            even = np.minimum(more, n - more)
            letter = int(even.argmax())
            best = max(best, (int(even[letter]), letter, cut))
        spread = top - counts.min(axis=0)
        letter = int(spread.argmax())
        if best[0] < SHARE * n and spread[letter] > 4:
            cut = int(np.median(counts[:, letter]))
            more = int(np.count_nonzero(counts[:, letter] > cut))
            best = max(best, (min(more, n - more), letter, cut))
        return (best[1], best[2]) if best[0] >= max(1, SHARE * n) else (-1, 0)

    def reach(self, counts: np.ndarray, fewer: int, more: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(leaf, rows)``: the rows of ``counts`` that some point of the leaf's box can equal once they have lost at
        most ``more`` letters and gained at most ``fewer``."""
        none = np.zeros(len(counts), np.int32)
        todo = [(0, np.arange(len(counts)), none, none, {}, {})]
        while todo:
            node, rows, lack, excess, least, most = todo.pop()
            letter, cut = self.letter[node], self.cut[node]
            if letter < 0:
                yield node, rows
                continue
            have = counts[rows, letter]
            beyond = excess + np.maximum(0, have - cut)
            if letter in most:
                beyond -= np.maximum(0, have - most[letter])
            short = lack + np.maximum(0, cut + 1 - have)
            if letter in least:
                short -= np.maximum(0, least[letter] - have)
            keep = beyond <= more
            if keep.any():
                todo.append((self.low[node], rows[keep], lack[keep], beyond[keep], least, {**most, letter: cut}))
            keep = short <= fewer
            if keep.any():
                todo.append((self.high[node], rows[keep], short[keep], excess[keep], {**least, letter: cut + 1}, most))


def _half_hash(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[:, j] + np.uint64(1)
    return mix(out)


class Cell:
    """The members of one cell (or block of it), all of one length, searched by words as long or one letter longer."""

    def __init__(self, length: int, words: list[str], n: list[int]):
        self.length, self.words, self.n = length, words, n
        self.codes = letter_codes(words, length)
        self.tree = KdTree(letter_counts(self.codes), LEAF)
        self.head, self.tail = self._halves(self.codes)

    def _halves(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first and the last half of a member; one edit leaves one of the two as it is."""
        half = self.length // 2
        return _half_hash(codes[:, :half]), _half_hash(codes[:, codes.shape[1] - self.length + half:])

    def _meetings(self, members: np.ndarray, head: np.ndarray, tail: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(askers, members)`` of a leaf with an equal half; ``head`` and ``tail`` are those of the askers."""
        if len(members) <= 4 * LEAF:
            step = max(1, LETTERS // len(members))
            for lo in range(0, len(head), step):
                q, m = np.nonzero((head[lo:lo + step, None] == self.head[members]) | (tail[lo:lo + step, None] == self.tail[members]))
                yield q + lo, members[m]
            return
        # A leaf no count can part: halves looked up in order; what meets by both is taken by the first.
        for theirs, own in ((head, self.head[members]), (tail, self.tail[members])):
            order = np.argsort(own, kind="stable")
            low, high = np.searchsorted(own[order], theirs, "left"), np.searchsorted(own[order], theirs, "right")
            lo = 0
            while lo < len(theirs):
                total = np.cumsum(high[lo:] - low[lo:])
                hi = lo + max(1, int(np.searchsorted(total, LETTERS, "right")))
                sizes = (high - low)[lo:hi]
                q = np.repeat(np.arange(lo, min(hi, len(theirs))), sizes)
                at = np.arange(len(q)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[lo:hi], sizes)
                m = members[order[at]]
                if theirs is tail:
                    fresh = head[q] != self.head[m]
                    q, m = q[fresh], m[fresh]
                yield q, m
                lo = hi

    def _near(self, codes: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether asker and member differ by one letter, place by place."""
        out = np.zeros(len(q), bool)
        step = max(1, LETTERS // self.length)
        for lo in range(0, len(q), step):
            ask, own = codes[q[lo:lo + step]], self.codes[m[lo:lo + step]]
            if codes.shape[1] == self.length:
                out[lo:lo + step] = np.count_nonzero(ask != own, axis=1) == 1
            else:
                # Equal up to the letter too many, and from the one after it on.
                same = np.logical_and.accumulate(ask[:, :-1] == own, axis=1).sum(axis=1)
                later = np.logical_and.accumulate((ask[:, 1:] == own)[:, ::-1], axis=1).sum(axis=1)
                out[lo:lo + step] = same + later >= self.length
        return out

    def search(self, words: list[str] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(places in words, members)`` of near pairs; without ``words`` the pairs among the members, each once."""
        length = len(words[0]) if words else self.length
        codes = letter_codes(words, length) if words else self.codes
        head, tail = self._halves(codes) if words else (self.head, self.tail)
        fewer = int(length == self.length)
        for leaf, rows in self.tree.reach(letter_counts(codes), fewer, 1):
            members = self.tree.rows[leaf]
            if not len(members):
                continue
            for q, m in self._meetings(members, head[rows], tail[rows]):
                q = rows[q]
                if not words:
                    q, m = q[q < m], m[q < m]
                near = self._near(codes, q, m)
                yield q[near], m[near]


def _lengths(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the words of each length."""
    size = np.array([len(w) for w in words])
    for length in np.unique(size).tolist():
        yield length, np.flatnonzero(size == length)


def fit_cells(sample: list[str], total: int, cell: int = CELL) -> dict[int, KdTree]:
    """A tree for each length in a sample of ``total`` words, with about ``cell`` of all words a leaf."""
    leaf = max(8, cell * len(sample) // max(total, 1))
    trees = {}
    for length, at in _lengths(sample):
        tree = KdTree(letter_counts(letter_codes([sample[i] for i in at], length)), leaf)
        tree.rows = []
        trees[length] = tree
    return trees


def _cells(words: list[str], length: int, trees: dict[int, KdTree], fewer: int, more: int) -> tuple[np.ndarray, np.ndarray]:
    """``(places in words, cell)``: the cells of that length that each word reaches."""
    if length not in trees:
        return np.arange(len(words)), np.zeros(len(words), np.int64)
    found = [(rows, np.full(len(rows), leaf)) for leaf, rows in
             trees[length].reach(letter_counts(letter_codes(words, len(words[0]))), fewer, more)]
    return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])


_SLOT = "length int, cell int, block int, asks boolean, word string, n bigint"


def place_words(vocab: DataFrame, trees: dict[int, KdTree]) -> DataFrame:
    """``(length, cell)`` of every word: the cell it is a member of."""

    def work(batches):
        for b in batches:
            words = b.column("word").to_pylist()
            for length, at in _lengths(words):
                _, cell = _cells([words[i] for i in at], length, trees, 0, 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), length), pa.int32()), pa.array(cell, pa.int32())],
                                                 ["length", "cell"])

    return vocab.select("word").mapInArrow(work, "length int, cell int")


def route(vocab: DataFrame, trees: dict[int, KdTree], crowds: dict[tuple[int, int], int], shortest: int = 0) -> DataFrame:
    """Every word once as a member of its cell, and once for each cell (and block of it) it asks.

    ``crowds``: the number of blocks of cells with too many members for one. ``shortest``: length of the shortest word.
    """

    def rows(words, n, slot, length):
        """Member and asker rows of words of one length; ``slot``: a hash that deals them to blocks."""
        own = np.zeros(len(words), np.int64)
        at, cell = _cells(words, length, trees, 0, 0)
        own[at] = cell
        many = np.array([crowds.get((length, int(c)), 1) for c in own])
        block = slot % many
        yield length, own, block, False, np.arange(len(words))
        for to in range(length, max(length - 2, shortest - 1), -1):
            at, cell = _cells(words, to, trees, int(to == length), 1)
            many = np.array([crowds.get((to, int(c)), 1) for c in cell], np.int64)
            at, cell = np.repeat(at, many), np.repeat(cell, many)
            place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            if to == length:
                # Equal lengths meet in the later of their two places, or among the members of one.
                after = (cell > own[at]) | ((cell == own[at]) & (place > block[at]))
                at, cell, place = at[after], cell[after], place[after]
            yield to, cell, place, True, at

    def work(batches):
        for b in batches:
            every, counts = b.column("word"), b.column("n")
            words, slots = every.to_pylist(), b.column("slot").to_numpy(zero_copy_only=False)
            for length, which in _lengths(words):
                part = pa.array(which)
                own, n = every.take(part), counts.take(part)
                for to, cell, block, asks, at in rows([words[i] for i in which], n, slots[which], length):
                    size = len(at)
                    for lo in range(0, size, 1 << 16):
                        some = at[lo:lo + (1 << 16)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), to), pa.int32()), pa.array(cell[lo:lo + len(some)], pa.int32()),
                             pa.array(block[lo:lo + len(some)], pa.int32()), pa.array(np.full(len(some), asks)),
                             own.take(pa.array(some)), n.take(pa.array(some))], [c.split()[0] for c in _SLOT.split(", ")])

    slot = F.pmod(F.xxhash64("word"), F.lit(1 << 20)).alias("slot")
    return vocab.select("word", "n", slot).mapInArrow(work, _SLOT)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways round, from rows sorted by slot, members first."""
    slot, members, counts, cell = None, [], [], None

    def told(words, n, found):
        for q, m in found:
            if len(q):
                a, an = [words[i] for i in q], [n[i] for i in q]
                o, on = [cell.words[i] for i in m], [cell.n[i] for i in m]
                yield pa.RecordBatch.from_arrays([pa.array(a + o), pa.array(on + an, pa.int64()), pa.array(o + a)],
                                                 ["word", "other_n", "other"])

    def closed():
        """Ends the list of members: their tree, and the pairs among them."""
        nonlocal cell
        if cell is None and members:
            cell = Cell(slot[0], members, counts)
            yield from told(cell.words, cell.n, cell.search(None))

    for b in batches:
        keys = np.stack([b.column(c).to_numpy() for c in ("length", "cell", "block")] +
                        [b.column("asks").to_numpy(zero_copy_only=False).astype(np.int32)])
        words, n = b.column("word").to_pylist(), b.column("n").to_pylist()
        # A stretch of rows of one slot and kind; askers of two lengths apart.
        sizes = np.array([len(w) for w in words])
        edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0) | (np.diff(sizes) != 0)) + 1).tolist(), len(words)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            at, asks = tuple(keys[:3, lo].tolist()), keys[3, lo]
            if at != slot:
                yield from closed()
                slot, members, counts, cell = at, [], [], None
            if not asks:
                members += words[lo:hi]
                counts += n[lo:hi]
                continue
            yield from closed()
            if cell is not None:
                step = max(1, LETTERS // max(1, cell.length))
                for i in range(lo, hi, step):
                    j = min(hi, i + step)
                    yield from told(words[i:j], n[i:j], cell.search(words[i:j]))
    yield from closed()


def near_words(vocab: DataFrame, steps: Steps, sample: int = SAMPLE, cell: int = CELL, members: int = MEMBERS) -> DataFrame:
    """``(word, other, other_n)`` for all words ``(word, n)``, distinct and of letters, that are one edit apart, both ways."""
    spark = vocab.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, shortest = vocab.agg(F.count("*"), F.min(F.length("word"))).first()
    some = vocab.where(F.pmod(F.xxhash64("word", F.lit(1)), F.lit(max(total, 1))) < sample).select("word").limit(2 * sample)
    trees = fit_cells([r.word for r in some.collect()], total, cell)
    spread = vocab.repartition(parts)
    most = F.least(F.lit(members), F.greatest(F.lit(1), F.lit(LETTERS) / F.col("length"))).cast("bigint")
    crowded = place_words(spread, trees).groupBy("length", "cell").agg(F.count("*").alias("c")) \
        .select("length", "cell", F.ceil(F.col("c") / most).alias("blocks")).where("blocks > 1")
    crowds = {(r.length, r.cell): r.blocks for r in crowded.collect()}
    routed = route(spread, trees, crowds, shortest or 0).repartition(parts, "length", "cell", "block") \
        .sortWithinPartitions("length", "cell", "block", "asks", F.length("word"))
    return routed.mapInArrow(_pairs, "word string, other_n bigint, other string")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS,
             least_count: int = LEAST_COUNT, ratio: int = RATIO, misspell: int | None = None, **bounds: int) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per distinct word of ``least`` letters and ``least_count`` uses.

    ``n_near``: words one inserted, deleted or replaced code point away. ``form``: the most frequent of them (ties:
    smallest in code-point order) if it occurs at least ``ratio`` (2 or more) times as often, ``form_n`` its count;
    else null. ``root``: the last word reached by following forms, the word itself without one.

    Words are the runs of ASCII letters (A-Z lower-cased) and U+00C0 to U+00FF of whole texts, counted over all rows,
    repeated ones included. Null and empty texts have none. An empty table or vocabulary: no rows. Other columns are
    not looked at. ``bounds``: ``sample``, ``cell``, ``members`` of `near_words`.
    """
    if ratio < 2:
        raise ValueError("forms must grow, or following them need not end")
    steps = Steps(docs.sparkSession, "spelling")
    counted = word_counts(docs, id_col, text_col, least, misspell).where(F.col("n") >= least_count)
    vocab = steps.settle(counted, "vocabulary")
    near = near_words(vocab, steps, **bounds).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    formed = steps.settle(vocab.join(near, "word", "left").select(
        "word", F.when(fits, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    links = steps.settle(formed.where("form is not null").select("word", F.col("form").alias("root")), "links-0")
    # A form occurs ``ratio`` times as often as its word, so chains are short; each round doubles what a link spans.
    turn = 0
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = links.join(further, "root", "left")
        if longer.where("_next is not null").isEmpty():
            break
        turn += 1
        links = steps.settle(longer.select("word", F.coalesce("_next", "root").alias("root")), f"links-{turn}")
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
