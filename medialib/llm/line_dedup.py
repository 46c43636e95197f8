"""Line de-duplication by winnowing over line hashes.

A text is the sequence of its lines with a word. Of every ``window`` consecutive hashes of ``run`` lines the least is a
fingerprint, so a repeated run of ``run + window - 1`` lines or more always holds one. Fingerprints are joined with the
first place that has them, matches are extended line by line in both directions, and the later copy is deleted. Lines of
``lone`` words or more that lie in no such run are then deleted by their own hash: what a run has taken has an earlier
place, so the first place of a line is never inside one. Order is by document id.

Texts are kept in parts of ``PART`` lines, so that a match carries two parts and not two texts; an extension ends with
the shorter part, and the run goes on from the fingerprints of the next one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialib.llm.arrays import NOT_NEWLINE, NOT_SPACE, Block, blocks, lists, mix, ngram_hash, signed, text_of
from medialib.llm.decontaminate import winnow
from medialib.llm.steps import Steps

RUN, WINDOW, LONE = 2, 1, 8
PART = 128
_SPANS = "array<struct<from:int,to:int>>"


def line_hashes(block: Block, words: np.ndarray, lines: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, raw line number, text and words of each line with a word; lines that differ in white space alone are equal."""
    line_of = np.searchsorted(lines.start, block.start, "right") - 1
    starts = np.flatnonzero(np.diff(line_of, prepend=-1))
    place = np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words))))
    keyed = mix(words + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 13)
    total = np.concatenate([[np.uint64(0)], np.cumsum(keyed, dtype=np.uint64)])
    used = line_of[starts]
    hashes = mix(total[np.append(starts[1:], len(words))] - total[starts], 17)
    feeds = np.concatenate([[0], np.cumsum(block.data == 0x0A)])
    owner = text_of(lines)[used]
    number = feeds[lines.start[used]] - feeds[block.offsets[owner]]
    return hashes, number, owner, np.diff(np.append(starts, len(words)))


def line_prints(docs: DataFrame, run: int, window: int, lone: int) -> DataFrame:
    """``(doc, hash, part, lines, numbers, words, prints, places)``, a row for each part of each row of ``docs(doc, hash, t)``.

    A part repeats the first ``run - 1`` lines of the next one. ``numbers`` are raw line numbers, one more than lines:
    the last is that of the line after, or the number of raw lines. ``words`` is empty if every line may be a single one.
    """

    def work(batches):
        for b in batches:
            for block in blocks(b.column("t")):
                lines = Block(block.lo, block.data, block.offsets, NOT_NEWLINE, False)
                hashes, number, owner, words = line_hashes(block, block.word_hash(), lines)
                bounds = np.searchsorted(owner, np.arange(block.texts + 1))
                feeds = np.concatenate([[0], np.cumsum(block.data == 0x0A)])
                total = feeds[block.offsets[1:]] - feeds[block.offsets[:-1]] + 1
                row, part, kept = [], [], {c: [] for c in ("lines", "numbers", "words", "prints", "places")}
                for text, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    grams = ngram_hash(hashes[lo:hi], run)
                    at = winnow(grams, min(window, max(1, len(grams))))
                    after = np.append(number[lo:hi], total[text])
                    for k in range(-(-(hi - lo) // PART)):
                        begin, end = k * PART, min(hi - lo, (k + 1) * PART + run - 1)
                        mine = at[np.searchsorted(at, begin):np.searchsorted(at, begin + PART)]
                        row.append(block.lo + text)
                        part.append(k)
                        kept["lines"].append(signed(hashes[lo + begin:lo + end]))
                        kept["numbers"].append(after[begin:end + 1])
                        kept["words"].append(words[lo + begin:lo + end] if lone > 1 else words[:0])
                        kept["prints"].append(signed(grams[mine]))
                        kept["places"].append(mine)
                taken = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc").take(taken), b.column("hash").take(taken), pa.array(part, pa.int32()),
                     *(lists(v, pa.int64() if c in ("lines", "prints") else pa.int32()) for c, v in kept.items())],
                    ["doc", "hash", "part", *kept])

    return docs.mapInArrow(work, "doc bigint, hash bigint, part int, lines array<bigint>, numbers array<int>, "
                                 "words array<int>, prints array<bigint>, places array<int>")


def _extend(own: np.ndarray, src: np.ndarray, at: int, place: int) -> tuple[int, int]:
    """Bounds in ``own`` of the longest run of equal lines through ``at`` there and ``place`` in the source."""
    back = min(at, place)
    same = own[at - back:at][::-1] == src[place - back:place][::-1]
    lo = at - (back if same.all() else int(same.argmin()))
    ahead = min(len(own) - at, len(src) - place)
    same = own[at:at + ahead] == src[place:place + ahead]
    return lo, at + (ahead if same.all() else int(same.argmin()))


def _later(places: DataFrame) -> DataFrame:
    """Rows of ``places(print, doc, hash, place, ...)`` whose print has an earlier place, with the first as ``src``."""
    me = F.struct("doc", "hash", "place")
    first = places.groupBy("print").agg(F.min(me).alias("src"), F.max(me).alias("last")).where("src < last").drop("last")
    return places.join(first, "print").where(me > F.col("src"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
                  window: int = WINDOW, lone: int = LONE) -> DataFrame:
    """``(doc, hash, runs)`` for texts with repeated runs; ``runs``: [from, to) numbers of the lines to delete.

    ``hash`` is ``xxhash64`` of the text: rows of one id and text are one document. A blank line goes with the line
    before it.
    """
    steps = Steps(docs.sparkSession, "lines")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("t")).where(
        "doc is not null and t is not null").select("doc", F.xxhash64("t").alias("hash"), "t")
    known = steps.settle(line_prints(texts, run, window, lone), "prints")
    flat = known.select("doc", "hash", F.inline(F.arrays_zip(F.col("prints").alias("print"), F.col("places").alias("place"))))
    parts = known.drop("prints", "places").dropDuplicates(["doc", "hash", "part"])
    key = ["doc", "hash", "part"]
    extended = steps.settle(_extended(parts.drop("words"), _later(flat)).groupBy(*key).agg(
        F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("runs")).alias("runs")), "runs")

    free = ~F.exists(F.coalesce("places", F.array().cast(_SPANS)),
                     lambda s: (s["from"] <= F.col("line.at")) & (F.col("line.at") < s["to"]))
    tall = F.lit(True) if lone <= 1 else F.get("words", F.col("line.at")) >= lone
    single = (parts.join(extended.select(*key, "places"), key, "left")
              .withColumn("line", F.explode(F.transform(F.slice("lines", 1, PART), lambda x, i: F.struct(x.alias("print"), i.alias("at")))))
              .where(free & tall)
              .select("doc", "hash", "line.print", (F.col("part") * PART + F.col("line.at")).alias("place"),
                      F.get("numbers", F.col("line.at")).alias("from"), F.get("numbers", F.col("line.at") + 1).alias("to")))
    spans = extended.select("doc", "hash", "runs").unionByName(
        _later(single).groupBy("doc", "hash").agg(F.collect_set(F.struct("from", "to")).alias("runs")))
    return steps.settle(spans.groupBy("doc", "hash").agg(F.flatten(F.collect_list("runs")).alias("runs"))
                        .mapInArrow(_merged, f"doc bigint, hash bigint, runs {_SPANS}"), "deleted")


def _merged(batches):
    """``runs`` in order, overlapping and touching ones as one."""
    for b in batches:
        out = []
        for runs in b.column("runs").to_pylist():
            held: list[dict] = []
            for r in sorted(runs, key=lambda r: r["from"]):
                if held and r["from"] <= held[-1]["to"]:
                    held[-1]["to"] = max(held[-1]["to"], r["to"])
                else:
                    held.append(r)
            out.append(held)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc"), b.column("hash"), pa.array(out, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))],
            ["doc", "hash", "runs"])


def _extended(parts: DataFrame, hits: DataFrame) -> DataFrame:
    """``(doc, hash, part, places, runs)``: the runs around fingerprints met, extended line by line.

    ``places`` are lines of the part, ``runs`` the same as raw line numbers. A row ties one part with one part of a source.
    """
    of = lambda place: F.floor(place / PART).cast("int")
    met = hits.groupBy("doc", "hash", of(F.col("place")).alias("part"), F.col("src.doc").alias("src_doc"), F.col("src.hash").alias("src_hash"),
                       of(F.col("src.place")).alias("src_part")).agg(F.collect_set(F.struct(
                           (F.col("place") % PART).alias("at"), (F.col("src.place") % PART).alias("there"))).alias("met"))
    both = (met.join(parts, ["doc", "hash", "part"])
            .join(parts.select(F.col("doc").alias("src_doc"), F.col("hash").alias("src_hash"), F.col("part").alias("src_part"),
                               F.col("lines").alias("src_lines")), ["src_doc", "src_hash", "src_part"]))
    span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def work(batches):
        for b in batches:
            places, runs = [], []
            for own, src, numbers, met in zip(*(b.column(c).to_pylist() for c in ("lines", "src_lines", "numbers", "met")), strict=True):
                own, src = np.asarray(own, np.int64), np.asarray(src, np.int64)
                found, reach = [], {}
                for at, there in sorted((m["at"], m["there"]) for m in met):
                    if at >= reach.get(at - there, 0):  # else inside a run of the same shift
                        lo, hi = _extend(own, src, at, there)
                        reach[at - there] = hi
                        found.append((lo, hi))
                places.append([{"from": lo, "to": hi} for lo, hi in found])
                runs.append([{"from": numbers[lo], "to": numbers[hi]} for lo, hi in found])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc", "hash", "part")), pa.array(places, span), pa.array(runs, span)],
                ["doc", "hash", "part", "places", "runs"])

    return both.select("doc", "hash", "part", "lines", "src_lines", "numbers", "met").mapInArrow(
        work, f"doc bigint, hash bigint, part int, places {_SPANS}, runs {_SPANS}")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, window: int = WINDOW,
                lone: int = LONE, removed_col: str | None = None) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from the text, every row and column kept.

    Guarantee: a line of ``lone`` words or more that stands earlier in the corpus, in id order and then by place, goes,
    and a run of ``run + window - 1`` lines or more that stands earlier loses at least ``run`` lines, with a window of 1
    all of them. With ``lone`` = 1 every later repeat of a line goes, whatever its length. The earliest place of every
    line stays. Null text stays null, null ids stay whole. Rows of one
    id and one text are one document and are treated alike. ``removed_col`` adds the number of deleted lines. Other
    columns, whatever their names, pass through.
    """
    runs = repeated_runs(docs, id_col, text_col, run, window, lone)
    # Columns go by position, as any name may be taken.
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own, text = docs.toDF(*named.values()), F.col(named[text_col])
    # Merged at every size: beyond small tables the runs are too many to broadcast, and the plan should not depend on that.
    joined = own.join(runs.hint("merge"), (F.col(named[id_col]).cast("bigint") == F.col("doc")) & (F.xxhash64(text) == F.col("hash")),
                      "left")
    lines = F.split(text, "\n")
    stays = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: (i >= r["from"]) & (i < r["to"])))
    hit = F.col("runs").isNotNull()
    new_text = F.when(hit, F.array_join(stays, "\n")).otherwise(text)
    columns = [(new_text if c == text_col else F.col(n)).alias(f"out_{n}") for c, n in named.items()]
    columns.append(F.when(hit, F.size(lines) - F.size(stays)).otherwise(0).cast("bigint").alias("removed"))
    out = joined.select(*columns)
    return out.toDF(*docs.columns, removed_col) if removed_col else out.drop("removed").toDF(*docs.columns)
