import random

from medialib.llm.components import components
from medialib.llm.url_aliases import judge


def link(to):
    return f'<head><link data-x="1" href="{to}" rel="canonical"></head>'


def refresh(to):
    return f'<META http-equiv="Refresh" content="0; url={to}">'


def test_blocks_reach_aliases_and_allow_wins(spark):
    rows = [
        (1, "http://a.net/1", refresh("http://b.example.org/es/x")),  # redirect to a blocked url
        (2, "http://c.net/p?utm_source=f#top", link("http://a.net/1")),  # alias of an alias
        (3, "https://c.net/p", ""),  # the same url as 2 without tracking
        (4, "http://d.net/1", link("http://x.com/de/1")),  # blocked alias, but also an allowed one
        (5, "http://d.net/1", refresh("http://x.com/fr/1")),
        (6, "http://www.example.org/en/2", link("http://b.example.org/es/x")),  # own allow wins over the blocked alias
        (7, "http://e.net/a/b", link("../x")), (8, "http://e.net/q", link("//x.com/de/2")), (9, "http://x.com/y", link("/de/7")),
        (10, None, None), (11, "no url", link("http://x.com/de/1")), (12, "HTTP://Sub.EXAMPLE.org/en/15?q#f", None),
        (13, "http://example.org.evil.net/es/", None), (14, "http://org/", None), (3, "https://c.net/p", ""),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id bigint, url string, html string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(df).collect()}
    assert judge(df).count() == len(rows)
    assert [got[i][3] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == ["allow"] * 3 + ["allow", "allow", "allow", "allow", "block", "block"]
    assert got[10] == ("", "", None, "allow") and got[11] == ("", "", None, "allow")
    assert got[12] == ("sub.example.org", "/en/15", "example.org/en/1", "block")
    assert got[13][2] is None and got[14][2:] == ("org/", "allow")
    # Without page 6, which is allowed itself, nothing in the group is.
    left = {r.page_id: r.verdict for r in judge(df.where("page_id <> 6")).collect()}
    assert [left[i] for i in (1, 2, 3)] == ["block"] * 3


def test_long_chain_and_known_redirects(spark):
    rows = [(i, f"http://s.net/{i}", link(f"http://s.net/{i + 1}")) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.verdict for r in judge(df).collect()} == {"allow"}
    more = spark.createDataFrame([("http://s.net/60", "http://u.com/de/"), (None, "x")], "from_url string, to_url string")
    assert {r.verdict for r in judge(df, more_edges=more).collect()} == {"block"}
    assert judge(df.limit(0)).collect() == []


def test_every_link_of_a_page_counts(spark):
    far = "<p>" + "x " * 200_000
    rows = [(1, "http://a.net/1", link("http://a.net/2") + far + link("http://u.com/de/1")),
            (2, "http://a.net/3", refresh("http://a.net/4") + refresh("http://u.com/de/2")), (3, "http://a.net/2", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.verdict for r in judge(df).collect()} == {1: "block", 2: "block", 3: "block"}


def test_components_equal_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(i, i + 1) for i in range(2000, 2070)] + [(7, 7), (None, 5), (3000, -9)] * 2
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {(r.node, r.component) for r in components(df).collect()} == {(x, find(x)) for x in list(parent)}
    assert components(df.limit(0)).collect() == []
