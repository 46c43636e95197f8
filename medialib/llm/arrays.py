"""Words, word hashes and n-gram hashes of many texts at once, as numpy arrays over Arrow buffers.

All functions work on a block of whole texts (`Block`), so a batch of small texts costs a few passes over its bytes
and no Python loop per word. Hashes are 64-bit: a polynomial over the bytes, mixed; equal words always have equal
hashes, different ones differ but for a chance of about 2^-64 a pair.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: Byte classes of words: anything but blank and \t..\r; and letters, digits and every non-ASCII character.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z and nothing else.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + U64((int(seed) * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = down = np.ones(1, U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


class Block:
    """The words of some whole texts.

    ``start``/``end``: byte bounds of each word in ``data``; ``first[i]:first[i+1]``: the words of text i;
    ``lo``: place of the first text in its batch.
    """

    def __init__(self, lo: int, data: np.ndarray, offsets: np.ndarray, word: np.ndarray, fold: bool, marks: bool = False):
        self.lo, self.offsets = lo, offsets
        self.data = FOLD[data] if fold else data
        inside = word[self.data]
        n = len(inside)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        if marks:
            cut[self._closing_marks(inside)] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.texts = len(offsets) - 1

    def _closing_marks(self, inside: np.ndarray) -> np.ndarray:
        """Places of a full stop or comma that follows an ASCII or Latin-1 letter and ends its word."""
        data = self.data
        at = np.flatnonzero((data == 0x2E) | (data == 0x2C))
        at = at[at >= 2]
        last = np.append(~inside[1:], True)[at] if len(at) else at.astype(bool)
        at = at[last]
        one, two = data[at - 1], data[at - 2]
        ascii_letter = ((one | 0x20) >= 0x61) & ((one | 0x20) <= 0x7A)
        return at[ascii_letter | (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)]

    def word_hash(self) -> np.ndarray:
        up, down = _Powers.of(len(self.data))
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * up[: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def word_chars(self) -> np.ndarray:
        """Code points of each word: bytes that don't continue a character."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=total[1:])
        return total[self.end] - total[self.start]


def ngram_hash(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    out = np.zeros(size, U64)
    for k in range(n):
        out = out * U64(_BASE) + words[k:k + size]
    return mix(out, seed + n)


def blocks(column: pa.Array, word: np.ndarray = NOT_SPACE, fold: bool = False, marks: bool = False,
           size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of whole texts of about ``size`` bytes; null counts as empty.

    ``marks``: a full stop or comma at the end of a word of letters is a word of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    bounds = np.frombuffer(ends, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, "right")) - 1)
        yield Block(lo, raw[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], word, fold, marks)
        lo = hi


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one array a row."""
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


#: Everything but the line feed: a block cut with it has the non-empty lines as its words.
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[0x0A] = False


def text_of(block: Block) -> np.ndarray:
    """The number, within the block, of the text each word belongs to."""
    return np.repeat(np.arange(block.texts), np.diff(block.first))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def repeated_grams(block: Block, words: np.ndarray, n: int) -> np.ndarray:
    """True for every word inside an n-gram that occurs at least twice in its text, the first included."""
    grams = ngram_hash(words, n)
    owner = text_of(block)
    whole = owner[:len(grams)] == owner[n - 1:]
    keys = mix(grams + owner[:len(grams)].astype(U64) * U64(_BASE), 5)[whole]
    at = np.flatnonzero(whole)[repeated(keys)]
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + n, -1)
    return np.cumsum(depth)[:-1] > 0


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive bounds."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_lines(lines: Block, solid: np.ndarray) -> np.ndarray:
    """True for every line with a word that equals an earlier line of its text; ``solid``: word bytes of the data."""
    filled = np.concatenate([[0], np.cumsum(solid)])
    owner = text_of(lines)
    keys = mix(lines.word_hash() + owner.astype(U64) * U64(_BASE), 5)
    has_word = filled[lines.end] > filled[lines.start]
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return later & has_word
