"""Language identification by compression: the language whose text, as a zstandard dictionary, shrinks a text most.

One raw-content dictionary per language is cut from a bounded sample of its labelled texts; every whole text is
compressed with each, and the smallest result names the language. Where the second smallest is within a margin, the
prediction is marked as rejected.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialib.functions.ranking import top_k
from medialib.llm.quality_rank import held_out

#: A dictionary is at most PIECES cuts of PIECE characters; only the LANGUAGES languages with most texts have one.
PIECES, PIECE, LANGUAGES = 256, 1024, 400
LEVEL = 3
#: The least lead over the second language, as a share of the compressed size, that is trusted.
MARGIN = 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          pieces: int = PIECES, piece: int = PIECE) -> dict[str, bytes]:
    """A dictionary per language, from rows outside the held-out fold with an id, a language and a text.

    From every language about ``pieces`` texts are chosen by a hash of id and text, and of each a cut of ``piece``
    characters at a hashed place; of equal texts one counts. Beyond
    ``LANGUAGES`` languages the ones with fewest texts are not learnt.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"),
                       F.col(lang_col).alias("lang"))
    rows = rows.where(~held_out("doc_id", 3, 1)).where("lang is not null and t is not null and doc_id is not null")
    if rows.isEmpty():
        return {}
    scale = 1 << 30
    # A row a language, and at most LANGUAGES of them: what is broadcast and collected here doesn't grow with the table.
    langs = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in langs.collect()}
    chances = docs.sparkSession.createDataFrame(
        [(lang, int(min(1.0, 2 * pieces / n) * scale)) for lang, n in counts.items()], "lang string, chance long")
    chosen = rows.join(F.broadcast(chances), "lang").where(F.pmod(F.xxhash64("doc_id", "t", F.lit(17)), F.lit(scale)) < F.col("chance"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.greatest(F.length("t") - F.lit(piece), F.lit(0)) + 1) + 1
    cuts = chosen.select("lang", F.xxhash64("t").alias("h"), F.substring("t", place.cast("int"), F.lit(piece)).alias("cut"))
    # One cut of equal texts, and the first of each language by hash: ``pieces`` rows, whatever ids repeat.
    cuts = top_k(cuts.groupBy("lang", "h").agg(F.min("cut").alias("cut")), ["lang"], [F.asc("h")], pieces)
    by: dict[str, dict[int, str]] = {}
    for r in cuts.collect():
        by.setdefault(r["lang"], {})[r["h"]] = r["cut"]
    return {lang: "\n".join(v for _, v in sorted(by[lang].items())).lower().encode()
            for lang in sorted(by, key=lambda x: (-counts[x], x))}


@lru_cache(1)
def _coders(dictionaries: tuple[bytes, ...]):
    import zstandard

    out = []
    for d in dictionaries:
        known = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False))
    return out


def classify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
             margin: float = MARGIN) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, trusted)``, one row per input row.

    ``score`` is from 0 to 1: how far the chosen language leads the second, in hundredths of its compressed size on a
    logistic scale; of equal sizes the language with more labelled texts wins, with a score of .5. Case is ignored. Null text, or one without a
    letter, or no dictionary at all: ``und``, score 0, not trusted. Null ids are never held out; repeated rows are each
    returned. Empty table: no rows. Further columns are not looked at.
    """
    names, content = list(dictionaries), tuple(dictionaries.values())

    def work(batches):
        coders = _coders(content)
        for b in batches:
            langs, scores, trusted = [], [], []
            for text in b.column("t").to_pylist():
                if not coders or not text or not _LETTER.search(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    trusted.append(False)
                    continue
                raw = text.lower().encode()
                sizes = [len(c.compress(raw)) for c in coders]
                best = int(np.argmin(sizes))
                second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
                lead = (second - sizes[best]) / max(second, 1)
                langs.append(names[best])
                scores.append(float(1 / (1 + np.exp(-min(100 * lead, 30)))))
                trusted.append(lead >= margin)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(trusted)],
                ["doc_id", "lang_pred", "score", "trusted"])

    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        work, "doc_id bigint, lang_pred string, score double, trusted boolean")
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "trusted")
