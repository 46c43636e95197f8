"""64-bit fingerprints: from text (SimHash) and from luma grids (gradient hash), and sharpness."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bit(i: int) -> int:
    """Bit ``i`` as a signed 64-bit value."""
    return (1 << i) - (1 << 64) if i == 63 else 1 << i


def simhash64(df: DataFrame, key: str, text: str, pattern: str, min_len: int) -> DataFrame:
    """One 64-bit SimHash per row of ``df`` over its distinct tokens.

    A token's bits are the first 16 hex digits of its md5. Counting is a plain
    grouped sum with map-side combine, so a long text is never held as a group.
    Rows without tokens are absent from the result.
    """
    tokens = (df.select(key, F.explode(F.array_distinct(F.filter(
        F.split(F.lower(text), pattern), lambda t: F.length(t) >= min_len))).alias("_t"))
        .withColumn("_m", F.md5("_t")))
    halves = tokens.select(
        key,
        F.conv(F.substring("_m", 1, 8), 16, 10).cast("bigint").alias("_hi"),
        F.conv(F.substring("_m", 9, 8), 16, 10).cast("bigint").alias("_lo"))
    # One sum counts bit i of both halves, 32 bits of room each.
    counts = [F.sum(F.expr(f"shiftleft(shiftright(_hi, {i}) & 1L, 32) + (shiftright(_lo, {i}) & 1L)"))
              .alias(f"_c{i}") for i in range(32)]
    counted = halves.groupBy(key).agg(F.count("*").alias("_n"), *counts)
    half = F.col("_n") / 2
    low = lambda i: F.col(f"_c{i}").bitwiseAND(F.lit(0xFFFFFFFF))
    bits = [F.when((low(b) if b < 32 else F.shiftright(f"_c{b - 32}", 32)) > half,
                   F.lit(_bit(b)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for b in range(64)]
    return counted.select(key, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("phash"))


def hamming(a, b) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def gradient_hash(grid, width: int = 9, height: int = 8) -> Column:
    """64-bit hash of a row-major luma grid: a bit is set where a cell outshines its right neighbour.

    Bits fill from the least significant, row by row.
    """
    g = F.col(grid) if isinstance(grid, str) else grid
    bits, n = [], 0
    for y in range(height):
        for x in range(width - 1):
            at = y * width + x
            bits.append(F.when(g[at] > g[at + 1], F.lit(_bit(n)).cast("bigint"))
                        .otherwise(F.lit(0).cast("bigint")))
            n += 1
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def step_sharpness(grid, width) -> Column:
    """Mean squared brightness change over two pixels along each row of a row-major grid.

    ``width`` may differ per row of the table (a column) or be one integer.
    """
    g = F.col(grid) if isinstance(grid, str) else grid
    w = F.lit(width) if isinstance(width, int) else width
    at = F.sequence(F.lit(0), F.size(g) - 1)
    kept = F.filter(at, lambda i: (i % w) < w - 2)
    squares = F.transform(kept, lambda i: F.pow(
        (F.element_at(g, (i + 3).cast("int")) - F.element_at(g, (i + 1).cast("int"))).cast("double"), 2.0))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)
    return F.when((w > 2) & (F.size(kept) > 0), total / F.size(kept)).otherwise(F.lit(0.0))


def luma(r, g, b) -> Column:
    """Integer brightness of an RGB pixel; weights .299/.587/.114, fixed values."""
    return (F.col(r) * 0.299 + F.col(g) * 0.587 + F.col(b) * 0.114).cast("int")
