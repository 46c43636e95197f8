import random

import pyarrow as pa
from pyspark.sql import functions as F

from medialib.operators import search
from medialib.session import settle
from medialib.sources import schemas
from tests.rows import photos, watched_clips

Q = "query_id bigint, library_id string, text string"


def test_terms_split_on_anything_but_letters_and_digits(spark):
    q = spark.createDataFrame([(1, "a", 'Beach* "OR" (2020) شاطئ a beach'), (2, "a", "! ?"),
                               (3, "a", " ".join(f"w{i}" for i in range(12)))], Q)
    got = {}
    for r in search.query_terms(q).orderBy("query_id", "pos").collect():
        got.setdefault(r["query_id"], []).append(r["term"])
    assert got == {1: ["beach", "or", "2020", "شاطئ"], 3: [f"w{i}" for i in range(8)]}


def library(spark):
    c = watched_clips(spark, [dict(id=1, display_name="beach_day.mp4", watch_count=3, person_id=0), dict(id=2, tags="beaches,sea"),
                              dict(id=3, transcript="we met at the beachfront"), dict(id=4)])
    p = photos(spark, [dict(id=1, display_name="beach.jpg"), dict(id=2, tags="dog")])
    people = spark.createDataFrame([("a", 0, "Zoë", "", True, False, None)], schemas.PERSONS)
    return c, p, people


def run(spark, texts):
    c, p, people = library(spark)
    q = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], Q)
    index = search.postings(search.documents_index(c, p, people))
    prefix = search.prefix_candidates(search.query_terms(q), index)
    net = search.substring_candidates(q, c, p)
    ranked = search.search_ranked(prefix, net, q, search.memory_docs(c, p), search.tie_breaks(c, p))
    return q, prefix, net, ranked


def hits(df):
    return {(r["query_id"], r["kind"], r["id"]) for r in df.collect()}


def test_prefix_finds_words_and_net_finds_pieces(spark):
    _, prefix, net, ranked = run(spark, ["beac", "each", "zoë", "ea", "do"])
    assert hits(prefix) == {(0, "clip", 1), (0, "clip", 2), (0, "clip", 3), (0, "photo", 1), (2, "clip", 1), (4, "photo", 2)}
    assert {h for h in hits(net) if h[0] == 1} == {(1, "clip", 1), (1, "clip", 2), (1, "clip", 3), (1, "photo", 1)}
    assert {h for h in hits(net) if h[0] == 3} == {(3, "clip", 1), (3, "clip", 2), (3, "clip", 3), (3, "photo", 1)}
    # A name is in the search document but not in the scoring document, and no net holds it.
    assert not [h for h in hits(ranked) if h[0] == 2]


def test_photos_win_ties_and_scores_lead(spark):
    _, _, _, ranked = run(spark, ["beach"])
    order = [(r["kind"], r["id"]) for r in ranked.orderBy("rank").collect()]
    assert order[0] == ("photo", 1) and order[-1] == ("clip", 1)  # the file name of a clip scores nothing


def test_labels_letters_and_numbers(spark):
    df = spark.createDataFrame([(-1,), (0,), (25,), (26,), (52,)], "p int")
    got = [r[0] for r in df.select(search.person_label("p")).collect()]
    assert got == ["", "Person A", "Person Z", "Person A2", "Person A3"]


def test_sections_order_and_collapse(spark):
    people = spark.createDataFrame([("a", 1, "Ann", "", True, False, None), ("a", 2, "", "", False, False, None),
                                    ("a", 3, "", " Bo ", False, False, None)], schemas.PERSONS)
    rows = [(1, "clip", 2), (1, "clip", 1), (1, "photo", -1), (1, "clip", -1), (1, "clip", 3), (1, "clip", 3), (2, "photo", -1), (2, "photo", -1)]
    h = spark.createDataFrame([(q, "a", k, i, p, i) for i, (q, k, p) in enumerate(rows)],
                              "query_id bigint, library_id string, kind string, id bigint, person_id int, rank int")
    got = [(r["query_id"], r["title"], r["size"]) for r in search.search_sections(h, people).orderBy("query_id", "section").collect()]
    assert got == [(1, "Bo", 2), (1, "Ann", 1), (1, "Someone in particular", 1), (1, "Photos", 1), (1, "No faces yet", 1), (2, None, 2)]


def test_index_layout_prunes_by_prefix(spark, tmp_path):
    c, p, people = library(spark)
    search.write_postings(search.postings(search.documents_index(c, p, people)), str(tmp_path / "ix"))
    read = spark.read.parquet(str(tmp_path / "ix")).where("p2 = 'be'")
    assert {r["term"] for r in read.collect()} >= {"beach", "beaches", "beachfront"}
    assert "PartitionFilters: [isnotnull(p2" in read._jdf.queryExecution().toString()


def test_the_best_match_may_have_the_highest_id(spark):
    c = watched_clips(spark, [dict(id=i, category="boat", transcript="sea") for i in range(2_000)]
                      + [dict(id=5_000, category="boat", transcript="sea harbour sunset")])
    p = photos(spark, [])
    people = spark.createDataFrame([], schemas.PERSONS)
    q = spark.createDataFrame([(1, "a", "sea harbour sunset boat")], Q)
    index = search.postings(search.documents_index(c, p, people))
    prefix = search.prefix_candidates(search.query_terms(q), index)
    net = search.substring_candidates(q, c, p)
    ranked = search.search_ranked(prefix, net, q, search.memory_docs(c, p), search.tie_breaks(c, p))
    assert ranked.orderBy("rank").first()["id"] == 5_000
    assert search.prefix_candidates(search.query_terms(q), index, None).count() == 2_001


def test_of_many_tied_items_the_largest_tie_value_wins(spark):
    c = watched_clips(spark, [dict(id=i, category="boat", transcript="sea") for i in range(700)])
    c = c.withColumn("watch_count", F.when(F.col("id") == 699, 9).otherwise(F.col("watch_count")).cast(c.schema["watch_count"].dataType))
    people = spark.createDataFrame([], schemas.PERSONS)
    p = photos(spark, [])
    q = spark.createDataFrame([(1, "a", "boat sea")], Q)
    prefix = search.prefix_candidates(search.query_terms(q), search.postings(search.documents_index(c, p, people)))
    ranked = search.search_ranked(prefix, search.substring_candidates(q, c, p), q, search.memory_docs(c, p), search.tie_breaks(c, p))
    assert prefix.count() == 700 and ranked.orderBy("rank").first()["id"] == 699


def ranks(df):
    return sorted((r.query_id, r["rank"], r.kind, r.id, round(r.score, 9), r.tie) for r in df.collect())


def test_bounded_search_equals_scoring_everything(spark):
    rnd = random.Random(6)
    common, rare = ["la", "de", "en", "mer", "a1"], ["".join(rnd.choice("abdel") for _ in range(rnd.randint(2, 11))) for _ in range(60)]
    said = lambda n: " ".join(rnd.choice(common if rnd.random() < .6 else rare) for _ in range(n))
    c = watched_clips(spark, [dict(id=i, library_id="ab"[i % 2], category=rnd.choice(rare), tags=rnd.choice(rare), transcript=said(rnd.randint(0, 30)),
                                   watch_count=rnd.randint(0, 3)) for i in range(1_500)]).repartition(3)
    p = photos(spark, [dict(id=i, library_id="ab"[i % 2], tags=said(3).replace(" ", ","), date_added_sec=1_700_000_000 + i % 5) for i in range(900)])
    people = spark.createDataFrame([], schemas.PERSONS)
    texts = [said(rnd.randint(1, 25)) for _ in range(40)] + ["", "?!", "de", "LA DE la de", rare[0], "zzzz unknown", "é de", "mer, mer; mer rare"]
    q = spark.createDataFrame([(i, "ab"[i % 2], t) for i, t in enumerate(texts)], Q)
    index = settle(search.postings(search.documents_index(c, p, people)))
    net, docs = settle(search.substring_candidates(q, c, p)), settle(search.memory_docs(c, p))
    plain = search.search_ranked(search.prefix_candidates(search.query_terms(q), index), net, q, docs, search.tie_breaks(c, p), 15)
    words, terms = search.query_words(q), search.query_terms(q)
    found = search.prefix_hits(terms, index).select("library_id", "asked", search._number("kind", "id").alias("item"))
    assert search._floors(words, search.word_hits(words, docs), terms, found, 15).where("floor > 4").count() > 3  # bounds are at work
    assert ranks(search.search_best(q, index, net, docs, search.tie_breaks(c, p), 15)) == ranks(plain)


def test_bounded_search_finds_the_last_of_2000_tied_items(spark):
    c = watched_clips(spark, [dict(id=i, category="boat", transcript="sea") for i in range(2_000)])
    c = c.withColumn("watch_count", F.when(F.col("id") == 1_999, 9).otherwise(F.col("watch_count")).cast(c.schema["watch_count"].dataType))
    p, people = photos(spark, []), spark.createDataFrame([], schemas.PERSONS)
    q = spark.createDataFrame([(1, "a", "boat sea")], Q)
    best = search.search_best(q, search.postings(search.documents_index(c, p, people)), search.substring_candidates(q, c, p),
                              search.memory_docs(c, p), search.tie_breaks(c, p))
    assert best.orderBy("rank").first()["id"] == 1_999 and best.count() == 60


def test_pieces_equal_brute_force(spark):
    texts = ["", "a", "ab", "abcabc", "é𝄞x\u0000y", None, "x" * 5_000]
    got = {}
    for r in search.grams(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")).collect():
        got.setdefault(r.id, []).append(r.gram)

    def number(piece):
        out = 0
        for ch in piece:
            out = out << 21 | ord(ch)
        return out
    want = {i: sorted({number(t[k:k + n]) for n in (2, 3) for k in range(len(t) - n + 1)}) for i, t in enumerate(texts) if t and len(t) > 1}
    assert {i: sorted(g) for i, g in got.items()} == want


def test_stored_pieces_give_the_same_hits_and_only_their_files_are_read(spark, tmp_path):
    c, p, _ = library(spark)
    q = spark.createDataFrame([(i, "a", t) for i, t in enumerate(["each", "ea", "do", "beachfront", "zz", "the beachf", "_day"])], Q)
    path = str(tmp_path / "grams")
    search.write_gram_index(search.gram_postings(search.haystacks(c, p)), path)
    stored = search.substring_candidates(q, c, p, path)
    assert hits(stored) == hits(search.substring_candidates(q, c, p)) != set()
    plan = stored._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(file" in plan or "PartitionFilters: [file" in plan
    moved = c.withColumn("tags", F.when(F.col("id") == 2, "river").otherwise(F.col("tags")))
    ids = spark.createDataFrame([("a", "clip", 2), ("a", "photo", 2)], "library_id string, kind string, id bigint")
    again = search.reindex_grams(search.gram_postings(search.haystacks(c, p)), ids, search.haystacks(moved, p.where("id <> 2")))
    fresh = search.gram_postings(search.haystacks(moved, p.where("id <> 2")))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, fresh.collect()))


def test_a_task_holds_the_pieces_of_few_texts(monkeypatch):
    monkeypatch.setattr(search, "PIECES", 10)
    texts = ["abcdef", None, "ab", "", "abcdefghijklmnop", "xyz", "abab"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    out = list(search._cut([batch, batch.slice(0, 0)], (2, 3)))
    # The longest text has 29 pieces; it may come after fewer than ten.
    assert len(out) == 3 and max(b.num_rows for b in out) < 10 + 29
    pieces = {(i, sum(ord(c) << 21 * (n - 1 - k) for k, c in enumerate(t[j:j + n])))
              for i, t in enumerate(texts) for n in (2, 3) for j in range(len(t or "") - n + 1)}
    rows = [r for b in out for r in zip(b.column("id").to_pylist(), b.column("gram").to_pylist(), strict=True)]
    assert len(rows) == len(pieces) and set(rows) == pieces


def test_reindexing_a_few_items_does_not_shuffle_the_index(spark):
    c, p, _ = library(spark)
    hay = search.haystacks(c, p)
    ids = spark.createDataFrame([("a", "clip", 2), ("a", "clip", 2), ("a", "photo", None)], "library_id string, kind string, id bigint")
    again = search.reindex_grams(search.gram_postings(hay), ids, hay)
    assert "Exchange hashpartitioning" not in again._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, search.gram_postings(hay).collect()))


def test_pairs_are_not_shuffled_and_equal_scoring_text_by_text(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 7)
    rnd = random.Random(5)
    words = ["la", "lamer", "de", "mer", "a1", "été"]
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    c = watched_clips(spark, [dict(id=i, library_id="ab"[i % 2], transcript=said(rnd.randint(0, 6))) for i in range(60)])
    p = photos(spark, [dict(id=i, library_id="ab"[(i or 0) % 2], tags=said(2)) for i in [*range(40), None]])
    people = spark.createDataFrame([], schemas.PERSONS)
    q = spark.createDataFrame([(i, "ab"[i % 2], said(rnd.randint(0, 5))) for i in range(20)] + [(3, "b", "mer mer zz"), (4, "a", None), (None, "a", "de")], Q)
    index = settle(search.postings(search.documents_index(c, p, people)))
    docs = search.memory_docs(c, p)
    docs = settle(docs.unionByName(docs.where("id % 5 = 0")).unionByName(docs.where("id = 7").withColumn("text", F.lit("de mer"))))
    terms = search.query_terms(q)
    pairs = search.prefix_candidates(terms, index)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("MapInArrow")] and "MapInArrow" in plan
    want = {}
    for r in terms.withColumnRenamed("term", "asked").join(search.prefix_hits(terms, index), ["library_id", "asked"]).collect():
        want[r.query_id, r.library_id, r.kind, r.id] = want.get((r.query_id, r.library_id, r.kind, r.id), 0) + 1
    assert {(r.query_id, r.library_id, r.kind, r.id): r.matched for r in pairs.collect()} == want and pairs.count() == len(want) > 300
    assert any(i is None for *_, i in want) and any(i is None for i, *_ in want)
    asked = q.select("query_id", "text")
    rows = lambda df: sorted((r.query_id, r.kind, r.id, r.matched, -1 if r.score is None else round(r.score, 9)) for r in df.collect())
    scored = search.match_scores(search.prefix_candidates(terms, index, texts=(asked, docs)), asked, docs)
    assert rows(scored) == rows(search.match_scores(pairs, asked, docs))


def test_blocks_of_texts_give_the_same_hits_as_comparing_every_text(spark, monkeypatch):
    monkeypatch.setattr(search, "LETTERS", 40)
    rnd = random.Random(9)
    said = lambda n: "".join(rnd.choice("abé𝄞 ") for _ in range(n))
    c = watched_clips(spark, [dict(id=i, library_id="ab"[i % 2], display_name="", folder_name="", category="", transcript=said(rnd.randint(0, 40))) for i in range(60)]
                      + [dict(id=None, transcript="ab ab")])
    p = photos(spark, [dict(id=i, library_id="ab"[i % 2], display_name=said(9), folder_name="", category="") for i in range(30)])
    texts = [said(n) for n in (1, 2, 2, 3, 3, 4, 4, 5, 6, 7)] * 2 + [None, "", "\u0001\u0001", "é𝄞", "AB", "b" * 50]
    q = spark.createDataFrame([(i, "ab"[i % 2], t) for i, t in enumerate(texts)] + [(0, "a", texts[1]), (70, None, "ab")], Q)
    got = search.substring_candidates(q, c, p)
    hay = search.haystacks(c, p).where("id is not null").withColumnRenamed("text", "hay").collect()
    want = [(r.query_id, r.library_id, h.kind, h.id) for r in q.collect() if len(r.text or "") > 1 for h in hay
            if h.library_id == r.library_id and r.text.lower() in h.hay]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("MapInArrow")]


def test_scored_pairs_stay_in_their_block(spark, monkeypatch):
    monkeypatch.setattr(search, "BEST_BLOCK", 100)
    c = watched_clips(spark, [dict(id=i, category="boat", transcript="sea" if i % 3 else "sea sun", watch_count=i % 5) for i in range(2_000)])
    p, people = photos(spark, [dict(id=1, tags="boat,sea")]), spark.createDataFrame([], schemas.PERSONS)
    q = spark.createDataFrame([(1, "a", "boat sea sun"), (2, "a", "oat"), (3, "a", "?")], Q)
    index, docs = search.postings(search.documents_index(c, p, people)), search.memory_docs(c, p)
    net, ties = search.substring_candidates(q, c, p), search.tie_breaks(c, p)
    best = search._block_best
    left = []
    monkeypatch.setattr(search, "_block_best", lambda *a: left.append(settle(best(*a))) or left[-1])
    got = search.search_best(q, index, net, docs, ties, 15)
    plain = search.search_ranked(search.prefix_candidates(search.query_terms(q), index), net, q, docs, ties, 15)
    assert ranks(got) == ranks(plain) and got.count() == 30
    # 2,001 items in 21 blocks: no query takes more than 15 out of one.
    assert max(r["count"] for r in left[-1].groupBy("query_id").count().collect()) <= 15 * 21
