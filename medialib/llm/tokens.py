"""Token ids of texts by a fixed public tokenizer, inside Arrow tasks.

Words recur, so each task process keeps the ids of the words it has met: blocks of texts are cut at ASCII white space
and before closing full stops and commas, words are told apart by their 64-bit hashes, and only new ones go through the
tokenizer. That gives the tokenizer's own ids: its pre-tokenizer never joins across those cuts, and neither does its
normaliser. (Two of the words one process keeps share a hash with a chance of some 10^-8.)
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from medialib.llm.arrays import blocks

END = 1
#: Words one task process keeps; when full it starts anew. About 60 bytes each.
KEPT_WORDS = 2_000_000
# One pre-token each: simple letters, and the ASCII signs after them.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[!-/:-@\[-`{-~]*\Z|[.,]\Z")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Coder:
    """Turns texts into ids; one per task process and tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.last = np.zeros(self.tok.get_vocab_size() + 1, bool)
        for piece, i in self.tok.get_vocab().items():
            self.last[i] = piece.endswith("</w>")
        self._fresh()

    def _fresh(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes, sorted
        self.place = np.zeros(0, np.int64)  # of each: its number
        self.ends = np.zeros(1, np.int64)  # word number i has flat[ends[i]:ends[i + 1]]
        self.flat = np.zeros(0, np.uint32)

    def _encode(self, plain: list[str], odd: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has. Plain words go as one text, told apart at the
        ids that end a pre-token."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if plain:
            ids = self.tok.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids
            flat.append(np.asarray(ids, np.uint32))
            cut = np.flatnonzero(self.last[flat[-1]]) + 1
            tokens = np.cumsum([1 if len(w) == 1 or w[-1].isalpha() else 2 for w in plain])
            if len(cut) != tokens[-1]:
                raise RuntimeError("a run of letters or signs is not one pre-token in this tokenizer")
            sizes.append(np.diff(cut[tokens - 1], prepend=0))
        for e in self.tok.encode_batch_fast(odd, add_special_tokens=False) if odd else ():
            flat.append(np.asarray(e.ids, np.uint32))
            sizes.append(np.asarray([len(e.ids)]))
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        plain = np.fromiter((_PLAIN.match(w) is not None for w in words), bool, len(words))
        order = np.argsort(~plain, kind="stable")
        words, split = [words[i] for i in order], int(plain.sum())
        flat, sizes = self._encode(words[:split], words[split:])
        number = np.empty(len(words), np.int64)
        number[order] = len(self.ends) - 1 + np.arange(len(words))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat])
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.place = np.insert(self.place, at, number)

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        for block in blocks(column, marks=True, size=1 << 20):
            hashes, first, back = np.unique(block.word_hash(), return_index=True, return_inverse=True)
            if len(self.known) + len(hashes) > KEPT_WORDS:
                self._fresh()
            at = np.searchsorted(self.known, hashes)
            new = np.ones(len(hashes), bool)
            if len(self.known):
                new = self.known[np.minimum(at, len(self.known) - 1)] != hashes
            if new.any():
                raw = block.data.tobytes()
                which = first[new]
                self._learn(hashes[new], [raw[s:e].decode() for s, e in zip(block.start[which], block.end[which], strict=True)])
                at = np.searchsorted(self.known, hashes)
            word = self.place[at][back] if len(hashes) else np.zeros(0, np.int64)
            begin, sizes = self.ends[word], self.ends[word + 1] - self.ends[word]
            total = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.flat[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])]
            bounds = total[block.first]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                yield ids[lo:hi]


@lru_cache(1)
def coder(path: str) -> Coder:
    return Coder(path)
