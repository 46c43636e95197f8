"""Quality classifier by Bradley-Terry ranking.

From labelled texts, preference pairs (one of label 1 over one of label 0) are drawn, and a linear score is learnt by
logistic loss on the pairs' feature differences. The texts a score quantile rejects are those below the threshold that
parts the labels best among the quantiles of the sample. Features are counts over the whole text only.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialib.llm.arrays import (
    NOT_NEWLINE, NOT_SPACE, Block, blocks, mix, repeated, repeated_grams, repeated_lines, sums, text_of)

#: At most this many labelled texts are fitted on (each a row of some 20 numbers on the driver), with this many pairs.
SAMPLE = 20_000
PAIRS = 60_000
#: A score of at least this means label 1.
ACCEPT = 0.7

FEATURES = ("log_words", "word_chars", "upper", "digit", "sign", "mark", "bar", "bang", "distinct", "repeat3", "repeat2",
            "stutter", "lines", "dup_lines", "capital", "ends", "short", "long", "non_ascii", "few")


def _share(table: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[table] = True
    return out


_UPPER, _DIGIT, _LETTER = (_share(list(range(a, b))) for a, b in ((65, 91), (48, 58), (97, 123)))
_SIGN = _share(list(b"#*$%&<>=_~^@\\{}[]/+"))
_END = _share(list(b".,;:?"))


def features(block: Block) -> np.ndarray:
    """One row of ``FEATURES`` for each text of the block."""
    data, first = block.data, block.first
    words, chars, n = block.word_hash(), block.word_chars(), np.diff(first)
    per_word, per_byte = np.maximum(n, 1), np.maximum(np.diff(block.offsets), 1)

    def byte(mask):
        return sums(mask, block.offsets) / per_byte

    def word(mask):
        return sums(mask, first) / per_word

    owner = text_of(block)
    again = repeated(mix(words + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 9))
    stutter = np.zeros(len(words), bool)
    stutter[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    lines = Block(block.lo, data, block.offsets, NOT_NEWLINE, False)
    n_lines = np.maximum(np.diff(lines.first), 1)
    head = data[block.start] if len(words) else data[:0]
    tail = data[block.end - 1] if len(words) else data[:0]
    return np.stack([
        np.log1p(n), sums(chars, first) / per_word, byte(_UPPER[data]), byte(_DIGIT[data]), byte(_SIGN[data]),
        np.sqrt(byte(_SIGN[data])), np.sqrt(byte(data == 0x7C)), np.sqrt(byte(data == 0x21)), 1 - word(again),
        word(repeated_grams(block, words, 3)), word(repeated_grams(block, words, 2)), word(stutter),
        n_lines / per_word, sums(repeated_lines(lines, NOT_SPACE[data]), lines.first) / n_lines,
        word(_UPPER[head]), word(_END[tail]), word(chars <= 2), word(chars >= 14), byte(data >= 0x80),
        np.exp(-n / 20.0)], axis=1)


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights, and the threshold and slope of the score; a neutral model if a label is missing."""
    centre, scale = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES)), x.std(axis=0) + 1e-9 if len(x) else np.ones(len(FEATURES))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    w, threshold, slope = np.zeros(x.shape[1]), 0.0, 1.0
    if len(good) and len(bad):
        z = np.clip((x - centre) / scale, -8, 8)
        rng = np.random.RandomState(seed)
        diff = z[good[rng.randint(len(good), size=pairs)]] - z[bad[rng.randint(len(bad), size=pairs)]]
        for _ in range(30):
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance the worse one wins
            gradient = diff.T @ p / pairs - ridge * w
            curve = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w))
            step = np.linalg.solve(curve, gradient)
            w += step * min(1.0, 5 / np.abs(step).max())
            if np.abs(step).max() < 1e-7:
                break
        s = z @ w
        # The quantile of the scores that parts the labels best; at equal merit the one rejecting least.
        cuts = np.quantile(s, np.arange(1, 400) / 400)
        order = np.sort(s[good]), np.sort(s[bad])
        merit = 1 - np.searchsorted(order[0], cuts) / len(good) + np.searchsorted(order[1], cuts) / len(bad)
        threshold = float(cuts[int(merit.argmax())])
        spread = np.abs(s - threshold)
        slope = 2.0 / max(float(np.median(spread)), 1e-9)
    return {"centre": centre, "scale": scale, "w": w, "threshold": np.float64(threshold), "slope": np.float64(slope)}


def apply(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1; ``ACCEPT`` falls on the threshold."""
    s = np.clip((x - model["centre"]) / model["scale"], -8, 8) @ model["w"] - model["threshold"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * s + np.log(ACCEPT / (1 - ACCEPT)), -30, 30)))


def held_out(col: str = "doc_id", folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Fit on a bounded sample of the labelled texts outside the held-out fold, chosen by a hash of the id.

    Null ids or labels are no labels; an id labelled twice counts with the mean, from one half on as 1.
    """
    known = (labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
             .where("doc_id is not null and y is not null").where(~held_out()))
    share = min(1.0, 0.9 * sample / max(1, known.count()))
    known = (known.where(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 20)) < int(share * (1 << 20)))
             .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).limit(sample))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"))
    # The sample is bounded by ``sample`` rows of two numbers.
    chosen = texts.join(F.broadcast(known), "doc_id")

    def work(batches):
        for b in batches:
            for block in blocks(b.column("t")):
                x = features(block)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(block.lo, block.texts), b.column("y").slice(block.lo, block.texts),
                     pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                    ["doc_id", "y", "x"])

    rows = chosen.mapInArrow(work, "doc_id bigint, y int, x array<double>").toPandas().sort_values("doc_id")
    x = np.asarray(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["y"].to_numpy(int))


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
          carry: list[str] | None = None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row, or the columns ``carry`` with ``predicted``.

    Null text counts as empty; empty texts get the score of their features. Null ids are never held out. Repeated rows
    are each scored, equal texts alike. A score of exactly ``ACCEPT`` is accepted. Empty table: no rows. Further
    columns are not looked at.
    """
    def work(batches):
        for b in batches:
            for block in blocks(b.column("t")):
                s = apply(model, features(block))
                rest = [b.column(c).slice(block.lo, block.texts) for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], [*kept, "score", "predicted"])

    if carry is None:
        kept = ["doc_id"]
        table = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"))
        out = table.mapInArrow(work, "doc_id bigint, score double, predicted int")
        return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
    kept = [f"c{i}" for i in range(len(carry))]
    table = docs.select(*(F.col(c).alias(k) for c, k in zip(carry, kept, strict=True)), F.col(text_col).alias("t"))
    kinds = dict(table.dtypes)
    out = table.mapInArrow(work, ", ".join(f"{k} {kinds[k]}" for k in kept) + ", score double, predicted int")
    return out.select(*(F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)), "predicted")
