"""Index-then-rank search over every item's document, for a table of queries at once."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialib.functions.ranking import top_k
from medialib.functions.text import (
    ASCII_BREAK, UNICODE_BREAK, blank, blank_to_null, tag_list, word_tokens)
from medialib.functions.when import DAY, ts
from medialib.operators.classify import shape_transcript
from medialib.session import settle

ITEM = ["library_id", "kind", "id"]
RESULTS = 60
LONGEST_KEY = 8
#: Folders a gram index is dealt to.
GRAM_FILES = 128
#: Pieces of letters a task hands on at once.
PIECES = 1 << 16
#: Items of a library that meet its queries in one piece.
BLOCK = 4_096
#: Items of all libraries that make one block more when only the best of each block are kept.
BEST_BLOCK = 131_072
#: Letters of all libraries' fields that make one block more.
LETTERS = 1 << 22
_NO_ID = -1 << 63
#: One item in so many is scored to learn what the last result of a query scores at least.
FLOOR_SAMPLE = 16
# Words that route a query straight to a list.
PEOPLE_WORDS = ["people", "person", "faces", "face", "smiles", "smiling", "selfie", "selfies"]
VOICE_WORDS = ["talking", "voice", "speech", "someone talking", "speaking"]
UNNAMED, PHOTOS_TITLE, FACELESS = "Someone in particular", "Photos", "No faces yet"


def _or_empty(c) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _person_text() -> Column:
    return F.trim(F.concat_ws(" ", _or_empty("suggested_name"), _or_empty("name")))


def clip_documents(clips: DataFrame, persons: DataFrame) -> DataFrame:
    """``(library_id, id, text)``: everything a clip can be found by, lower-cased."""
    p = persons.select("library_id", F.col("id").alias("person_id"), _person_text().alias("_who"))
    joined = clips.join(p, ["library_id", "person_id"], "left")
    parts = [_or_empty(c) for c in ("display_name", "folder_name", "category", "tags", "about",
                                    "prosody_tags", "transcript", "_who")]
    return joined.select("library_id", "id", F.lower(F.concat_ws(
        " ", *parts, F.date_format(ts("date_added_sec"), "yyyy-MM"))).alias("text"))


def photo_documents(photos: DataFrame) -> DataFrame:
    parts = [_or_empty(c) for c in ("display_name", "folder_name", "category", "tags", "about")]
    return photos.select("library_id", "id", F.lower(F.concat_ws(
        " ", *parts, F.date_format(ts("date_added_sec"), "yyyy-MM"))).alias("text"))


def documents_index(clips: DataFrame, photos: DataFrame, persons: DataFrame) -> DataFrame:
    return clip_documents(clips, persons).withColumn("kind", F.lit("clip")).unionByName(
        photo_documents(photos).withColumn("kind", F.lit("photo")))


def person_label(person_id) -> Column:
    """"Person A" to "Person Z", then with a number; empty when nobody is known."""
    p = F.col(person_id)
    letter = F.char(F.lit(65) + p % 26)
    again = F.when(p >= 26, (F.floor(p / 26) + 1).cast("string")).otherwise("")
    return F.when(p < 0, "").otherwise(F.concat(F.lit("Person "), letter, again))


def _spaced(parts) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (F.trim(x) != "")), " ")


def _what() -> Column:
    parts = [F.col("category"), F.array_join(tag_list("tags"), " "), _or_empty("about")]
    return _spaced([F.when(p != "unknown", p) for p in parts])


def _month() -> Column:
    return F.concat_ws("-", F.year(ts("date_added_sec")), F.month(ts("date_added_sec")))


def memory_docs(clips: DataFrame, photos: DataFrame) -> DataFrame:
    """``(library_id, kind, id, text)``: the document a match is scored on.

    Unlike the search document it has no file name for clips, and months unpadded.
    Expects ``watch_count`` on the clips.
    """
    faces = F.when(F.col("face_count") > 0, F.concat(F.col("face_count").cast("string"), F.lit(" faces")))
    smile = F.when(F.col("smile_count") > 0, "smiling")
    fav = F.when(F.col("is_favorite"), "favorite")
    again = F.when(F.col("watch_count") > 2, "rewatched")
    c = clips.select("library_id", F.lit("clip").alias("kind"), "id", F.lower(_spaced([
        person_label("person_id"), _what(), F.col("folder_name"), _month(),
        _spaced([faces, smile, fav, again]), shape_transcript("transcript")])).alias("text"))
    p = photos.select("library_id", F.lit("photo").alias("kind"), "id", F.lower(_spaced([
        _what(), F.col("folder_name"), _month(), _spaced([faces, smile, fav]),
        F.col("display_name")])).alias("text"))
    return c.unionByName(p)


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, library_id, pos, term)``: up to eight distinct words of two letters or more."""
    words = F.slice(F.array_distinct(word_tokens("text", UNICODE_BREAK, 2)), 1, 8)
    return queries.select("query_id", "library_id", F.posexplode(words).alias("pos", "term"))


def postings(documents: DataFrame) -> DataFrame:
    """``(library_id, kind, p2, term, id)``, one row per distinct word of a document."""
    words = F.array_distinct(word_tokens("text", UNICODE_BREAK, 2))
    return documents.select(*ITEM, F.explode(words).alias("term")).withColumn(
        "p2", F.substring("term", 1, 2))


def write_postings(df: DataFrame, path: str) -> None:
    """Wholesale rebuild, laid out by prefix so that a query reads only its prefixes."""
    (df.repartition("p2", F.pmod(F.xxhash64("term"), F.lit(32)))
     .write.mode("overwrite").partitionBy("p2").parquet(path))


def reindex(index: DataFrame, ids: DataFrame, documents: DataFrame) -> DataFrame:
    """Replace the postings of the named items only (after a rename, say)."""
    fresh = postings(documents.join(ids.select(*ITEM), ITEM, "left_semi"))
    return index.join(ids.select(*ITEM), ITEM, "left_anti").unionByName(fresh)


def index_freshness(media: DataFrame, documents: DataFrame) -> DataFrame:
    """Per library and medium whether the index holds as many rows as there are items."""
    m = media.groupBy("library_id", "kind").agg(F.count("*").alias("media"))
    d = documents.groupBy("library_id", "kind").agg(F.count("*").alias("indexed"))
    return m.join(d, ["library_id", "kind"], "full_outer").na.fill(0).withColumn(
        "fresh", F.col("media") == F.col("indexed"))


def prefix_hits(terms: DataFrame, index: DataFrame) -> DataFrame:
    """``(library_id, kind, asked, id)``: items with a word that an asked word starts.

    A query word equals a stored prefix (up to eight letters; longer ones are
    checked after), so matching is an equi-join on the vocabulary.
    """
    asked = terms.select("library_id", "term").distinct().select(
        "library_id", F.col("term").alias("asked"), F.substring("term", 1, LONGEST_KEY).alias("_key"))
    vocabulary = index.select("library_id", "kind", "term").distinct().select(
        "library_id", "kind", "term", F.explode(F.transform(
            F.sequence(F.lit(2), F.least(F.lit(LONGEST_KEY), F.length("term"))),
            lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("_key"))
    matched = asked.join(vocabulary, ["library_id", "_key"]).where(
        F.col("term").startswith(F.col("asked"))).drop("_key")
    return matched.join(index.drop("p2"), ["library_id", "kind", "term"]).select(
        "library_id", "kind", "asked", "id").distinct()


def prefix_candidates(terms: DataFrame, index: DataFrame, limit: int | None = None,
                      texts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Per query and medium every item with a word that a query word starts; with ``limit`` those with most such words.

    Every item with a matching word takes part; only ``limit`` cuts, and at equal counts keeps the lowest ids. The pairs
    come out of one task each and are neither grouped nor shuffled. ``texts``: the queries and the scoring documents of
    `match_scores`, whose pairs (one for each row of both) then also tell ``_said`` and ``_found``, what it scores by.
    """
    asked = terms.groupBy("query_id", "library_id").agg(F.collect_list(F.xxhash64("term")).alias("a"))
    # An item without an id has a number of its own.
    numbered = F.coalesce(_number("kind", "id"), F.lit(_NO_ID) + (F.col("kind") == "photo").cast("int"))
    held = prefix_hits(terms, index).groupBy("library_id", numbered.alias("item")).agg(
        F.collect_set(F.xxhash64("asked")).alias("a"))
    none = F.array().cast("array<bigint>")
    if texts is None:
        asked, held = asked.withColumn("b", none), held.withColumn("b", none)
    else:
        queries, docs = texts
        said = queries.select("query_id", word_tokens("text", ASCII_BREAK, 2).alias("_w"))
        asked = asked.join(said.select("query_id", F.transform("_w", lambda w: F.xxhash64(w)).alias("b")), "query_id")
        # A row of the documents is told by its text, so that several of one item stay apart.
        docs = docs.select("library_id", _number("kind", "id").alias("item"), "kind", "id", F.xxhash64("text").alias("name"), "text").where("id is not null")
        words = said.join(terms.select("query_id", "library_id").distinct(), "query_id").select("library_id", F.explode("_w").alias("word"))
        found = word_hits(words, docs, "name").groupBy("library_id", "item", "name").agg(F.collect_set(F.xxhash64("word")).alias("b"))
        held = (held.join(docs.select("library_id", "item", "name"), ["library_id", "item"])
                .join(found, ["library_id", "item", "name"], "left").select("library_id", "item", "a", F.coalesce("b", none).alias("b")))
    kind, id_ = _item_of("item")
    found = _block_pairs(asked, settle(held, "items")).select(
        "query_id", "library_id", kind, F.when(F.col("item") > _NO_ID + 1, id_).alias("id"), "matched", *([] if texts is None else ["_said", "_found"]))
    return found if limit is None else top_k(found, ["query_id", "kind"], [F.desc("matched"), F.asc("id")], limit).drop("rank")


def _postings_of(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, where the holders of each start, and the holders: places in ``lists``."""
    words = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    order = np.argsort(words, kind="stable")
    known, first = np.unique(words[order], return_index=True)
    return known, np.append(first, len(words)), np.repeat(np.arange(len(lists)), [len(x) for x in lists])[order]


def _counts(held_by, words: np.ndarray, n: int) -> np.ndarray:
    """How many of ``words`` each of ``n`` holders has."""
    known, first, items = held_by
    at = np.searchsorted(known, words)
    at = at[at < len(known)] if not len(known) else at[known[np.minimum(at, len(known) - 1)] == words]
    return np.bincount(np.concatenate([np.zeros(0, np.int64), *(items[first[k]:first[k + 1]] for k in at)]), minlength=n)


def _block_pairs(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``(query_id, library_id, item, matched, _said, _found)``: the pairs of rows of ``asked(query_id, library_id, a, b)``
    and ``held(library_id, item, a, b)`` with a word of ``a`` in common: how many they share there, how many words
    ``asked.b`` has (-1: it is null) and how many of them the item's.

    Items are dealt into blocks of about ``BLOCK``; each block of a library holds its postings in one task, which the
    library's queries pass one by one. Words are compared by 64-bit hashes.
    """
    blocks = held.count() // BLOCK + 1
    place = F.pmod(F.xxhash64("item"), F.lit(blocks))
    rows = (held.where("library_id is not null").select("library_id", place.alias("block"), F.lit(0).alias("role"), F.col("item").alias("who"), "a", "b")
            .unionByName(asked.where("library_id is not null").select(
                "library_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
                F.lit(1).alias("role"), F.col("query_id").alias("who"), "a", "b")))

    def work(batches):
        block, who, a, b, ready, out, size = None, [], [], [], None, [], 0

        def flush():
            library, query, item, *numbers = zip(*out, strict=True)
            n = [len(x) for x in item]
            back = np.repeat(np.arange(len(n)), n)
            return pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int64()).take(pa.array(back)), pa.array(library, pa.string()).take(pa.array(back)),
                 pa.concat_arrays(item), *(pa.array(np.concatenate(x)) for x in numbers)],
                ["query_id", "library_id", "item", "matched", "_said", "_found"])

        for batch in batches:
            library, place, role, names = (batch.column(x).to_pylist() for x in ("library_id", "block", "role", "who"))
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column("a"), batch.column("b"))]
            worded = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                first, second = (values[offsets[i]:offsets[i + 1]] for offsets, values in lists)
                if block != (library[i], place[i]):
                    block, who, a, b, ready = (library[i], place[i]), [], [], [], None
                if role[i] == 0:
                    who.append(names[i])
                    a.append(first.copy())
                    b.append(second.copy())
                    continue
                if ready is None:
                    ready = pa.array(who, pa.int64()), _postings_of(a), _postings_of(b)
                items, by_index, by_text = ready
                if not len(items):
                    continue
                matched = _counts(by_index, first, len(items))
                met = np.flatnonzero(matched)
                if len(met):
                    out.append((library[i], names[i], items.take(pa.array(met)), matched[met], np.full(len(met), len(second) if worded[i] else -1),
                                _counts(by_text, second, len(items))[met]))
                    size += len(met)
                if size > 1 << 16:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return (rows.repartition("library_id", "block").sortWithinPartitions("library_id", "block", "role")
            .mapInArrow(work, "query_id bigint, library_id string, item bigint, matched bigint, _said bigint, _found bigint"))


def _cut(batches, sizes: tuple[int, ...]):
    """The batches of `grams`: as many texts together as have ``PIECES`` pieces, or one with more."""
    for b in batches:
        keep = [n for n in b.schema.names if n != "text"]
        found, first, held = [], 0, 0
        for i, text in enumerate(b.column("text").to_pylist()):
            letters = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.int64)
            packed = [np.zeros(0, np.int64)]
            for n in sizes:
                if len(letters) >= n:
                    piece = letters[:len(letters) - n + 1]
                    for k in range(1, n):
                        piece = piece << 21 | letters[k:len(letters) - n + 1 + k]
                    packed.append(piece)
            found.append(np.unique(np.concatenate(packed)))
            held += len(found[-1])
            if held >= PIECES or i + 1 == b.num_rows:
                at = pa.array(np.repeat(np.arange(first, i + 1), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in keep), pa.array(np.concatenate(found))], [*keep, "gram"])
                found, first, held = [], i + 1, 0


def grams(texts: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """The columns of ``texts`` but ``text``, and ``gram``: each distinct piece of so many letters, as the number its code
    points make (21 bits each). Texts are cut whole; a task holds the pieces of few at a time."""
    schema = ", ".join(f"{n} {t}" for n, t in texts.dtypes if n != "text") + ", gram bigint"
    return texts.mapInArrow(lambda batches: _cut(batches, sizes), schema)


def haystacks(clips: DataFrame, photos: DataFrame) -> DataFrame:
    """``(library_id, kind, id, text)``: the fields a substring is looked for in, each apart."""
    field = lambda names: F.lower(F.concat_ws("\u0001", *[_or_empty(f) for f in names])).alias("text")
    return clips.select(*_item("clip"), field(["display_name", "tags", "category", "folder_name", "transcript"])).unionByName(
        photos.select(*_item("photo"), field(["display_name", "tags", "category", "folder_name"])))


def gram_postings(hay: DataFrame) -> DataFrame:
    """``(library_id, kind, id, gram)``: which pieces of two and three letters each item holds."""
    return grams(hay)


def _file_of(gram) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_FILES)).cast("int")


def write_gram_index(postings: DataFrame, path: str) -> None:
    """Postings by piece, in ``GRAM_FILES`` folders, and how many items of a library hold each piece."""
    filed = postings.withColumn("file", _file_of("gram"))
    (filed.repartition("file", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("gram", "library_id")
     .write.mode("overwrite").partitionBy("file").parquet(f"{path}/postings"))
    stored = postings.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("file", "library_id", "gram").agg(F.count("*").alias("items")).write.mode("overwrite").partitionBy("file") \
        .parquet(f"{path}/counts")


def reindex_grams(index: DataFrame, ids: DataFrame, hay: DataFrame) -> DataFrame:
    """Replace the postings of the named items only; those no longer in ``hay`` go.

    The names are written first: Spark then knows how few they are and neither shuffles nor sorts the postings for them.
    """
    named = settle(ids.select(*ITEM).distinct(), "renamed")
    return index.join(named, ITEM, "left_anti").unionByName(
        gram_postings(hay.join(named, ITEM, "left_semi")).select(*index.columns))


def substring_candidates(queries: DataFrame, clips: DataFrame, photos: DataFrame, index: str | None = None) -> DataFrame:
    """``(query_id, library_id, kind, id)``: items with the whole query inside one field.

    A field containing the query contains each of its pieces of three letters (of two, for a query of two). Queries
    meet items on their rarest piece, and only there the text is compared. ``index``: where `write_gram_index` keeps the
    pieces; of it the counts of the asked pieces and the files of the rarest ones in that library are read. Without one
    the pieces are cut now, where a block of texts lies.
    """
    every = queries.select("query_id", "library_id", F.lower("text").alias("_q")).where(F.length("_q") >= 2)
    hay = haystacks(clips, photos)
    if index is None:
        kind, id_ = _item_of("item")
        return _block_substrings(every.withColumnRenamed("_q", "text"), hay).select("query_id", "library_id", kind, id_.alias("id"))
    # A text many people search for is looked up once.
    q = every.select("library_id", "_q").distinct().withColumn("text", F.col("_q"))
    short = F.length("_q") == 2
    asked = grams(q.where(short), (2,)).unionByName(grams(q.where(~short), (3,)))
    wanted = asked.select("library_id", "gram").distinct()
    held, spread = (q.sparkSession.read.parquet(f"{index}/{part}") for part in ("postings", "counts"))
    spread = spread.where(F.col("file").isin(_files(wanted)))
    # A piece no item has rules the query out; such queries drop here.
    rarest = settle(asked.join(spread, ["library_id", "gram"], "left").na.fill(0, ["items"])
                    .groupBy("library_id", "_q").agg(F.min(F.struct("items", "gram")).alias("_b"))
                    .where("_b.items > 0").select("library_id", "_q", F.col("_b.gram").alias("gram")), "rarest")
    held = held.where(F.col("file").isin(_files(rarest)))
    hits = (rarest.join(held.select(*ITEM, "gram"), ["library_id", "gram"]).join(hay, ITEM)
            .where(F.contains(F.col("text"), F.col("_q"))).drop("text", "gram"))
    return hits.join(every, ["library_id", "_q"]).select("query_id", "library_id", "kind", "id")


def _block_substrings(every: DataFrame, hay: DataFrame) -> DataFrame:
    """``(query_id, library_id, item)``: items of `haystacks` with the text of a query of its library inside.

    Texts are dealt into blocks of about ``LETTERS`` letters; each block of a library holds its pieces in one task, which
    the library's queries pass one by one. A query starts at the places of its rarest piece and is compared three
    letters at a time at what is left of them.
    """
    place = F.xxhash64("id", "kind")
    texts = hay.where("library_id is not null and id is not null and text is not null")
    blocks = max(4, (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // LETTERS + 1)
    rows = (texts.select("library_id", F.pmod(place, F.lit(blocks)).alias("block"), F.lit(0).alias("role"),
                         F.lit(0).cast("bigint").alias("name"), _number("kind", "id").alias("who"), "text")
            .unionByName(every.where("library_id is not null").select(
                "library_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
                F.lit(1).alias("role"), F.xxhash64("text").alias("name"), F.col("query_id").alias("who"), "text")))
    # No letter has this number, so no query reaches from one text into the next.
    end = np.array([(1 << 21) - 1] * 3, np.int64)

    def letters(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)

    def laid_out(who: list, parts: list):
        codes = np.concatenate([x for p in parts for x in (p, end)])
        piece = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
        order = np.argsort(piece, kind="stable")
        starts = np.cumsum([0] + [len(p) + len(end) for p in parts])
        return np.array(who, np.int64), starts, piece, order, piece[order]

    def found(ready, text: str) -> np.ndarray:
        """Numbers of the items with the text, those listed k times k * k times, as a join on their key gives them."""
        who, starts, piece, order, ordered = ready
        q = letters(text)
        if len(q) == 2:
            asked = np.array([q[0] << 42 | q[1] << 21])
            last = asked | (1 << 21) - 1
        else:
            asked = last = q[:-2] << 42 | q[1:-1] << 21 | q[2:]
        first, past = np.searchsorted(ordered, asked), np.searchsorted(ordered, last, side="right")
        k = int(np.argmin(past - first))
        at = order[first[k]:past[k]] - k
        at = at[(at >= 0) & (at + len(asked) <= len(piece))]
        if len(q) > 2:
            for j in [*range(0, len(asked), 3), len(asked) - 1]:
                if not len(at):
                    break
                at = at[piece[at + j] == asked[j]]
        if not len(at):
            return who[:0]
        items, times = np.unique(who[np.unique(np.searchsorted(starts, at, side="right") - 1)], return_counts=True)
        return np.repeat(items, times * times)

    def work(batches):
        block, who, parts, ready, said, hits, out, size = None, [], [], None, None, None, [], 0

        def flush():
            library, query, item = zip(*out, strict=True)
            back = pa.array(np.repeat(np.arange(len(item)), [len(x) for x in item]))
            return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()).take(back), pa.array(library, pa.string()).take(back),
                                               pa.array(np.concatenate(item))], ["query_id", "library_id", "item"])

        for batch in batches:
            for library, place, role, names, text in zip(*(
                    batch.column(x).to_pylist() for x in ("library_id", "block", "role", "who", "text")), strict=True):
                if block != (library, place):
                    block, who, parts, ready, said = (library, place), [], [], None, None
                if role == 0:
                    who.append(names)
                    parts.append(letters(text).astype(np.uint32))
                    continue
                if not who:
                    continue
                ready = ready or laid_out(who, parts)
                # Equal texts come one after the other.
                if said != text:
                    said, hits = text, found(ready, text)
                if len(hits):
                    out.append((library, names, hits))
                    size += len(hits)
                if size > 1 << 16:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return (rows.repartition("library_id", "block").sortWithinPartitions("library_id", "block", "role", "name")
            .mapInArrow(work, "query_id bigint, library_id string, item bigint"))


def _files(pieces: DataFrame) -> list[int]:
    """The folders of a gram index that hold these pieces: ``GRAM_FILES`` numbers at most."""
    return [r.file for r in pieces.select(_file_of("gram").alias("file")).distinct().collect()]


def _item(kind: str):
    return ["library_id", F.lit(kind).alias("kind"), "id"]


def search_routes(queries: DataFrame, persons: DataFrame) -> DataFrame:
    """``(query_id, library_id, route, person_id)``: people, voice, person or general."""
    said = F.lower(F.trim("text"))
    names = persons.select("library_id", "id", F.explode(F.array(
        F.lower("name"), F.lower("suggested_name"))).alias("_said")).where(~blank("_said")) \
        .groupBy("library_id", "_said").agg(F.min("id").alias("person_id"))
    q = queries.where(F.length("text") >= 2).select("query_id", "library_id", said.alias("_said"))
    j = q.join(names, ["library_id", "_said"], "left")
    route = (F.when(F.col("_said").isin(PEOPLE_WORDS), "people").when(F.col("_said").isin(VOICE_WORDS), "voice")
             .when(F.col("person_id").isNotNull(), "person").otherwise("general"))
    return j.withColumn("route", route).select(
        "query_id", "library_id", "route",
        F.when(F.col("route") == "person", F.col("person_id")).alias("person_id"))


def route_results(routes: DataFrame, clips: DataFrame, voice_limit: int = 200) -> DataFrame:
    """Clips of every routed list in use, once per ``(library_id, route, person_id)``.

    Queries with the same route share one list; readers join on the route. People
    are ordered by smiles then faces, the others newest first.
    """
    used = routes.where("route <> 'general'").select(
        "library_id", "route", F.coalesce("person_id", F.lit(-1)).alias("person_id")).distinct()
    cols = ["library_id", "id", "smile_count", "face_count", "date_added_sec"]
    need = lambda r: used.where(F.col("route") == r)
    faces = clips.where("face_count > 0").select(*cols).join(need("people"), "library_id")
    heard = top_k(clips.where(F.contains(F.col("prosody_tags"), F.lit("speaking"))).select(*cols), ["library_id"],
                  [F.desc("date_added_sec"), F.asc("id")], voice_limit, "_r").drop("_r")
    one = clips.select(*cols, "person_id").join(need("person"), ["library_id", "person_id"])
    out = faces.unionByName(heard.join(need("voice"), "library_id")).unionByName(one)
    return out.select("library_id", "route", "person_id", "id", "smile_count", "face_count", "date_added_sec")


def match_scores(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of a query's ASCII words found in the scoring document of each paired item.

    Pairs that tell ``_said`` and ``_found`` (`prefix_candidates`) are scored by these, without another look at the texts.
    """
    if "_found" in pairs.columns:
        return pairs.withColumn("score", F.when(F.col("_said") == 0, 0.0).when(
            F.col("_said") > 0, F.try_divide("_found", "_said"))).drop("_said", "_found")
    words = queries.select("query_id", word_tokens("text", ASCII_BREAK, 2).alias("_w"))
    j = pairs.join(words, "query_id").join(docs, ITEM)
    hits = F.size(F.filter("_w", lambda w: F.contains(F.col("text"), w)))
    return j.withColumn("score", F.when(F.size("_w") == 0, 0.0).otherwise(F.try_divide(hits, F.size("_w")))) \
        .drop("_w", "text")


def search_ranked(prefix: DataFrame, net: DataFrame, queries: DataFrame, docs: DataFrame,
                  ties: DataFrame, results: int = RESULTS) -> DataFrame:
    """Blend of both candidate lists, all of them scored: best ``results`` per query.

    ``ties`` is ``(library_id, kind, id, tie)``: watch count of a clip, date of a
    photo. Substring hits survive a score of zero, others do not.
    """
    pool = net.select("query_id", "library_id", "kind", "id", F.lit(True).alias("_net")).unionByName(
        prefix.select("query_id", "library_id", "kind", "id", F.lit(False).alias("_net")))
    pool = pool.groupBy("query_id", "library_id", "kind", "id").agg(F.max("_net").alias("_net"))
    scored = match_scores(pool, queries, docs).join(ties, ITEM)
    kept = scored.where((F.col("score") > 0) | F.col("_net"))
    return top_k(kept, ["query_id"], [F.desc("score"), F.desc("tie"), F.asc("kind"), F.asc("id")], results) \
        .select("query_id", "library_id", "kind", "id", "score", "tie", "rank")


def query_words(queries: DataFrame) -> DataFrame:
    """``(query_id, library_id, word, _all, times)``: each ASCII word of two letters or more, how often the query says it,
    and how many words the query has."""
    words = queries.select("query_id", "library_id", word_tokens("text", ASCII_BREAK, 2).alias("_w")).where(F.size("_w") > 0)
    return words.select("query_id", "library_id", F.size("_w").alias("_all"), F.explode("_w").alias("word")) \
        .groupBy("query_id", "library_id", "word", "_all").agg(F.count("*").alias("times"))


def _number(kind, id_) -> Column:
    """Clips and photos of a library as one row of numbers, which are cheaper to group by."""
    return F.col(id_) * 2 + (F.col(kind) == "photo").cast("int")


def _item_of(number) -> list[Column]:
    n = F.col(number)
    return [F.when(F.pmod(n, F.lit(2)) == 1, "photo").otherwise("clip").alias("kind"), F.shiftright(n, 1).alias("id")]


def word_hits(words: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """``(library_id, word, item)`` and ``more`` columns of ``docs``: numbers of the items whose scoring document contains
    an asked word.

    A word of letters and digits lies inside one word of the document, so asked words are looked up among the pieces
    (of up to eight letters) of a library's distinct words, and no text is held against a query.
    """
    held = docs.select("library_id", _number("kind", "id").alias("item"), *more,
                       F.explode(F.array_distinct(word_tokens("text", ASCII_BREAK, 2))).alias("token"))
    asked = words.select("library_id", "word").distinct().withColumn("_key", F.substring("word", 1, LONGEST_KEY))
    pieces = F.expr(f"""array_distinct(flatten(transform(sequence(2, least({LONGEST_KEY}, length(token))),
        n -> transform(sequence(1, length(token) - n + 1), i -> substring(token, i, n)))))""")
    parts = held.select("library_id", "token").distinct().select("library_id", "token", F.explode(pieces).alias("_key"))
    inside = asked.join(parts, ["library_id", "_key"]).where(F.contains(F.col("token"), F.col("word"))).drop("_key")
    return inside.join(held, ["library_id", "token"]).select("library_id", "word", "item", *more).distinct()


def _asked(words: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, library_id, a, b, said)``: a query's terms, its ASCII words as often as it says them, and how many they are."""
    a = terms.groupBy("query_id", "library_id").agg(F.collect_list(F.xxhash64("term")).alias("a"))
    b = words.groupBy("query_id", "library_id").agg(
        F.flatten(F.collect_list(F.array_repeat(F.xxhash64("word"), F.col("times").cast("int")))).alias("b"), F.min("_all").cast("bigint").alias("said"))
    return a.join(b, ["query_id", "library_id"], "full_outer")


def _held(hits: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """``(library_id, item, a, b)``: the asked terms that an item's index and the asked words that its document holds."""
    a = found.groupBy("library_id", "item").agg(F.collect_set(F.xxhash64("asked")).alias("a"))
    b = hits.groupBy("library_id", "item").agg(F.collect_set(F.xxhash64("word")).alias("b"))
    return a.join(b, ["library_id", "item"], how)


def _block_best(asked: DataFrame, held: DataFrame, results: int, net: DataFrame | None = None) -> DataFrame:
    """``(query_id, library_id, item, got, score, tie)``: of each block of items the best ``results`` of each query.

    ``asked`` is `_asked` with ``floor``, ``held`` is `_held` with ``tie``, ``net(query_id, library_id, item)`` the items
    that stay whatever they score. The others have a word of their index that a word of the query starts and ``floor``
    matched words or more. Every item of a block is scored where the block lies; blocks grow with the libraries, so what
    leaves them grows with the queries.
    """
    blocks = max(4, held.count() // BEST_BLOCK + 1)
    place = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")
    none = F.lit(None).cast("array<bigint>")
    items = held.where("library_id is not null and item is not null").select(
        "library_id", place, F.lit(0).alias("role"), F.col("item").alias("who"), "a", "b", F.col("tie").alias("number"),
        F.lit(None).cast("bigint").alias("said"), none.alias("net"))
    asks = asked.where("library_id is not null and query_id is not null").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    if net is None:
        asks = asks.withColumn("net", none)
    else:
        lists = net.where("item is not null").groupBy("query_id", "library_id", place).agg(F.collect_set("item").alias("net"))
        asks = asks.join(lists, ["query_id", "library_id", "block"], "left")
    rows = items.unionByName(asks.select("library_id", "block", F.lit(1).alias("role"), F.col("query_id").alias("who"), "a", "b",
                                         F.col("floor").alias("number"), "said", "net"))
    schema = pa.schema([("query_id", pa.int64()), ("library_id", pa.string()), ("item", pa.int64()), ("got", pa.int64()),
                        ("score", pa.float64()), ("tie", pa.int64())])

    def laid_out(who: list, numbers: list, a: list, b: list):
        """A block with its items in the order in which equal scores rank."""
        items, unknown = np.array(who, np.int64), np.array([n is None for n in numbers], bool)
        ties = np.array([n or 0 for n in numbers], np.int64)
        order = np.lexsort((items >> 1, items & 1, ~ties, unknown))
        items = items[order]
        return (items, pa.array(ties[order], mask=unknown[order]), np.argsort(items, kind="stable"),
                _postings_of([a[k] for k in order]), _postings_of([b[k] for k in order]))

    def best(ready, a: np.ndarray, b: np.ndarray, floor: int, said: int, net: np.ndarray):
        items, ties, by_item, by_index, by_text = ready
        n = len(items)
        got, pooled = _counts(by_text, b, n), _counts(by_index, a, n) > 0
        able = pooled & (got >= max(floor, 1))
        if len(net):
            at = by_item[np.minimum(np.searchsorted(items, net, sorter=by_item), n - 1)]
            able[at[items[at] == net]] = True
        met = np.flatnonzero(able)
        worth = got[met] * np.where(pooled[met], len(b), said)
        if len(met) > results:
            first = np.argpartition(-(worth * n + (n - 1 - met)), results - 1)[:results]
            met = met[first]
        score = got[met] / np.where(pooled[met], max(said, 1), max(len(b), 1))
        return items[met], got[met], score, ties.take(pa.array(met))

    def work(batches):
        block, who, numbers, a, b, ready, out, size = None, [], [], [], [], None, [], 0

        def flush():
            library, query, item, got, score, tie = zip(*out, strict=True)
            back = pa.array(np.repeat(np.arange(len(item)), [len(x) for x in item]))
            return pa.RecordBatch.from_arrays([
                pa.array(query, pa.int64()).take(back), pa.array(library, pa.string()).take(back), pa.array(np.concatenate(item)),
                pa.array(np.concatenate(got)), pa.array(np.concatenate(score)), pa.concat_arrays(tie)], schema=schema)

        for batch in batches:
            library, place, role, names, number, said = (
                batch.column(x).to_pylist() for x in ("library_id", "block", "role", "who", "number", "said"))
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(x) for x in ("a", "b", "net"))]
            for i in range(batch.num_rows):
                first, second, net = (values[offsets[i]:offsets[i + 1]] for offsets, values in lists)
                if block != (library[i], place[i]):
                    block, who, numbers, a, b, ready = (library[i], place[i]), [], [], [], [], None
                if role[i] == 0:
                    who.append(names[i])
                    numbers.append(number[i])
                    a.append(first.copy())
                    b.append(second.copy())
                    continue
                if not who:
                    continue
                ready = ready or laid_out(who, numbers, a, b)
                won = best(ready, first, second, number[i] or 0, said[i] or 0, net)
                if len(won[0]):
                    out.append((library[i], names[i], *won))
                    size += len(won[0])
                if size > 1 << 16:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return (rows.repartition("library_id", "block").sortWithinPartitions("library_id", "block", "role").mapInArrow(
        work, "query_id bigint, library_id string, item bigint, got bigint, score double, tie bigint"))


def _floors(words: DataFrame, hits: DataFrame, terms: DataFrame, found: DataFrame, results: int) -> DataFrame:
    """``(query_id, floor)``: matched words of the last result among one item in ``FLOOR_SAMPLE``; the last of all items
    has as many at least. Queries with fewer results there have none."""
    some = F.pmod(F.xxhash64("item"), F.lit(FLOOR_SAMPLE)) == 0
    held = settle(_held(hits.where(some), found.where(some)).withColumn("tie", F.lit(None).cast("bigint")), "sampled-items")
    known = _block_best(_asked(words, terms).withColumn("floor", F.lit(None).cast("bigint")), held, results)
    return top_k(known, ["query_id"], [F.desc("got"), F.asc("item")], results, salt="item").where(F.col("rank") == results) \
        .select("query_id", F.col("got").alias("floor"))


def search_best(queries: DataFrame, index: DataFrame, net: DataFrame, docs: DataFrame, ties: DataFrame,
                results: int = RESULTS) -> DataFrame:
    """The rows of `search_ranked` over every item, without a table of scored pairs.

    ``index`` is `postings`, ``net`` the substring hits. Items lie in blocks with the asked words they hold; each query
    passes the blocks of its library and takes the best of each along. A sample of the items gives each query a floor:
    matched words that its last result has at least, below which nothing leaves a block.
    """
    terms, words = query_terms(queries), settle(query_words(queries), "words")
    hits = settle(word_hits(words, docs).where("item is not null"), "word-hits")
    found = settle(prefix_hits(terms, index).select("library_id", "asked", _number("kind", "id").alias("item")).where("item is not null"), "prefix-hits")
    numbered = lambda df, *more: df.select("library_id", _number("kind", "id").alias("item"), *more)
    held = (numbered(docs).distinct().join(numbered(ties, "tie").groupBy("library_id", "item").agg(F.max("tie").alias("tie")), ["library_id", "item"])
            .join(_held(hits, found, "full_outer"), ["library_id", "item"], "left"))
    asked = (queries.select("query_id", "library_id").distinct().join(_asked(words, terms), ["query_id", "library_id"], "left")
             .join(_floors(words, hits, terms, found, results), "query_id", "left"))
    order = [F.desc("score"), F.desc("tie"), F.asc("kind"), F.asc("id")]
    best = _block_best(asked, settle(held, "items"), results, numbered(net, "query_id")).select(
        "query_id", "library_id", *_item_of("item"), "score", "tie")
    best = top_k(best, ["query_id"], order, results).drop("rank", "tie")
    # An item listed several times is a result as often.
    return top_k(best.join(ties, ITEM), ["query_id"], order, results).select("query_id", "library_id", "kind", "id", "score", "tie", "rank")


def tie_breaks(clips: DataFrame, photos: DataFrame) -> DataFrame:
    """``(library_id, kind, id, tie)``: watch count of clips, date of photos."""
    return clips.select(*_item("clip"), F.col("watch_count").cast("bigint").alias("tie")).unionByName(
        photos.select(*_item("photo"), F.col("date_added_sec").alias("tie")))


def lens(hits: DataFrame, as_of: int, voice: str = "all", days: int | None = None,
         category: str | None = None, folder: str | None = None) -> DataFrame:
    """Narrow results: ``voice`` is all, people, favorites or talking; expects item columns."""
    cond = {"all": F.lit(True), "people": F.col("face_count") > 0, "favorites": F.col("is_favorite"),
            "talking": F.contains(_or_empty("prosody_tags"), F.lit("speaking"))}[voice]
    if days is not None:
        cond = cond & (F.col("date_added_sec") >= as_of - days * DAY)
    if category is not None:
        cond = cond & (F.col("category") == category)
    if folder is not None:
        cond = cond & (F.lower("folder_name") == folder.lower())
    return hits.where(cond)


def search_sections(hits: DataFrame, persons: DataFrame) -> DataFrame:
    """``(query_id, section, title, size, first_rank)``: results of a query by person.

    Persons by size, unnamed after named on ties, then photos, then clips without
    anyone. A query with a single section gets no title. ``hits`` carries rank and
    person_id (null or negative for none) and at most a page of rows per query.
    """
    names = persons.select("library_id", F.col("id").alias("person_id"), F.trim(F.coalesce(
        blank_to_null("name"), "suggested_name")).alias("_name"))
    h = hits.join(names, ["library_id", "person_id"], "left")
    person = (F.col("kind") == "clip") & (F.coalesce("person_id", F.lit(-1)) >= 0)
    h = h.withColumn("_block", F.when(person, 0).when(F.col("kind") == "photo", 1).otherwise(2)) \
        .withColumn("_who", F.when(person, F.col("person_id")).otherwise(-1))
    title = F.when(F.col("_block") == 0, F.coalesce(blank_to_null("_name"), F.lit(UNNAMED))) \
        .when(F.col("_block") == 1, PHOTOS_TITLE).otherwise(FACELESS)
    s = h.groupBy("query_id", "_block", "_who", title.alias("title")).agg(
        F.count("*").alias("size"), F.min("rank").alias("first_rank"))
    w = Window.partitionBy("query_id")
    order = w.orderBy("_block", F.desc("size"), (F.col("title") == UNNAMED).cast("int"), "first_rank")
    return s.withColumn("section", F.row_number().over(order)).withColumn("_n", F.count("*").over(w)).select(
        "query_id", "section", F.when(F.col("_n") > 1, F.col("title")).alias("title"), "size", "first_rank")


def section_hits(hits: DataFrame, sections: DataFrame) -> DataFrame:
    """``(query_id, section, pos, kind, id)``: the results of each section in rank order.

    ``sections`` is what ``search_sections`` made of the same hits: each starts with the rank ``first_rank``.
    """
    person = (F.col("kind") == "clip") & (F.coalesce("person_id", F.lit(-1)) >= 0)
    who = F.when(person, F.col("person_id")).when(F.col("kind") == "photo", -2).otherwise(-1)
    h = hits.withColumn("_who", who)
    first = h.groupBy("query_id", "_who").agg(F.min("rank").alias("first_rank"))
    placed = h.join(first, ["query_id", "_who"]).join(sections.select("query_id", "section", "first_rank"), ["query_id", "first_rank"])
    within = Window.partitionBy("query_id", "section").orderBy("rank")
    return placed.select("query_id", "section", F.row_number().over(within).alias("pos"), "kind", "id")


def search_suggestions(clips: DataFrame, most: int = 7) -> DataFrame:
    """``(library_id, pos, suggestion)``: two fixed words, then categories and folders with weight."""
    def top(col, least, k, base):
        n = clips.where(~blank(col)).groupBy("library_id", F.col(col).alias("suggestion")).agg(
            F.count("*").alias("n")).where(F.col("n") >= least)
        if col == "category":
            n = n.where("suggestion <> 'unknown'")
        return top_k(n, ["library_id"], [F.desc("n"), F.asc("suggestion")], k, "_r", salt="suggestion").select(
            "library_id", (F.col("_r") + base).alias("_at"), "suggestion")
    fixed = clips.select("library_id").distinct().select("library_id", F.posexplode(
        F.array(F.lit("talking"), F.lit("people"))).alias("_at", "suggestion"))
    rows = fixed.unionByName(top("category", 3, 3, 10)).unionByName(top("folder_name", 5, 2, 20))
    once = rows.groupBy("library_id", "suggestion").agg(F.min("_at").alias("_at"))
    return top_k(once, ["library_id"], [F.asc("_at")], most, "pos", salt="suggestion").drop("_at")


def recent_searches(searches: DataFrame, keep: int = 6) -> DataFrame:
    """Newest ``keep`` distinct searches per viewer: ``(viewer_id, text, at, rank)``."""
    s = searches.withColumn("text", F.trim("text")).where(F.length("text") >= 2)
    once = s.groupBy("viewer_id", "text").agg(F.max("at").alias("at"))
    return top_k(once, ["viewer_id"], [F.desc("at"), F.asc("text")], keep, salt="text")
