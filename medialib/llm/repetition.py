"""Quality rules on repetition: how much of a text lies inside n-grams and lines it says more than once.

Rolling hashes of several n-gram lengths are compared within each text, in numpy over blocks of texts; a word counts
once however many repeated n-grams cover it. N-grams of 5 to 10 words and lines are measured, as for the Gopher corpus
(Rae et al. 2021). Its limits (.15 to .10, lines .20) reject short clean texts that say one sentence twice; the ones
here ask for three tenths of the text.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialib.llm.arrays import NOT_NEWLINE, NOT_SPACE, Block, blocks, repeated_grams, repeated_lines, sums

#: Largest share of word characters inside repeated n-grams, by n; and of characters inside repeated lines.
NGRAM_LIMITS = {5: 0.30, 6: 0.30, 7: 0.30, 8: 0.30, 9: 0.30, 10: 0.30}
LINE_LIMIT = 0.30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COLUMNS = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "base_failed boolean, kept boolean, dup_line_share double, ngram_shares array<double>")


def measure(block: Block, limits: dict[int, float], line_limit: float) -> list[np.ndarray]:
    """The columns after the id, one array each (``ngram_shares`` as a matrix), for the texts of a block."""
    words, chars = block.word_hash(), block.word_chars()
    n_words, word_chars = np.diff(block.first), sums(chars, block.first)
    repeat_words = sums(repeated_grams(block, words, 3), block.first)
    lines = Block(block.lo, block.data, block.offsets, NOT_NEWLINE, False)
    again = repeated_lines(lines, NOT_SPACE[block.data])
    line_chars = lines.word_chars()
    all_chars = np.maximum(sums((block.data & 0xC0) != 0x80, block.offsets), 1)
    line_share = sums(line_chars * again, lines.first) / all_chars
    shares = np.stack([sums(chars * repeated_grams(block, words, n), block.first) / np.maximum(word_chars, 1)
                       for n in limits], axis=1)
    failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
    passed = (shares <= np.asarray(list(limits.values()))).all(axis=1) & (line_share <= line_limit)
    return [n_words, word_chars, sums(SYMBOLS[block.data], block.offsets), sums(again, lines.first), repeat_words,
            failed, passed & ~failed, line_share, shares]


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] | None = None,
               line_limit: float = LINE_LIMIT) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, dup_line_share,
    ngram_shares)``, one row per input row.

    Null or empty text: no words, so ``base_failed``. Nulls in the id and repeated rows pass through, each text is
    measured by itself. A share at its limit still passes. Empty table: no rows. Further columns are not looked at.
    """
    limits = limits or NGRAM_LIMITS

    def work(batches):
        for b in batches:
            for block in blocks(b.column("t")):
                *plain, shares = measure(block, limits, line_limit)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(block.lo, block.texts), *(pa.array(c) for c in plain),
                     pa.ListArray.from_arrays(pa.array(np.arange(block.texts + 1, dtype=np.int32) * shares.shape[1]),
                                              pa.array(shares.ravel()))],
                    [c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(work, COLUMNS)
