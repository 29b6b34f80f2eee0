"""Pinned examples and brute-force comparisons of the reading operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import numbers, text, timing
from pagemill.operators.relational import numbered, unique_names
from pagemill.operators.sessions import accrue, day_segments
from pagemill.operators.toc import deepest_match, first_match, resolved_hrefs
from pagemill.operators.blocks import block_rows, inline_rows, page_blocks
from pagemill.operators.toc import toc_entries
from pagemill.sources.trees import decode_entities, element_trees
from pagemill.streaming.session_state import Session, session_log, stream_sessions


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("title,slug", [("Щедрість і ЖУК", "shchedrist-i-zhuk"), ("  Crème—Brûlée!! ", "creme-brulee"), ("Straße 7", "strasse-7"), ("***", ""), ("подъезд", "podezd")])
def test_slugify(spark, title, slug):
    assert one(spark, text.slugify(F.col("t")), t=title) == slug


def test_slugs_are_clamped_and_named(spark):
    assert one(spark, text.book_slug(F.col("t"), F.col("a")), t="War", a="Leo T.") == "war-by-leo-t"
    assert one(spark, text.book_slug(F.col("t"), F.col("a")), t="", a="") == "untitled"
    assert one(spark, text.clamp_slug(F.col("t"), 5), t="abcd-efg") == "abcd"
    assert one(spark, text.collection_slug(F.col("t")), t="!!") == "collection"


@pytest.mark.parametrize("raw,want", [('"  quoted   text "', "quoted text"), ("“x”", "x"), ("'a' b", "'a' b"), ("«y z»", "y z"), ('"', '"')])
def test_selection(spark, raw, want):
    assert one(spark, text.normalise_selection(F.col("t")), t=raw) == want


@pytest.mark.parametrize("title,label,index,want", [("Chapter 3", "Notes", 2, "Notes"), ("Chapter 3", None, 5, "Chapter 3"), ("part_07", "x.xhtml", 0, "(untitled)"), ("1.2", " Real ", 0, "Real")])
def test_titles(spark, title, label, index, want):
    frame = spark.createDataFrame([(title, label, index)], "t string, l string, i int")
    assert frame.select(text.normalise_title(text.said_title(F.col("t")), text.said_title(F.col("l")), F.col("i"))).first()[0] == want


def test_numbers(spark):
    assert [one(spark, numbers.pages(F.col("c")), c=c) for c in (0, 1, 2700, 2699, 180_000)] == [None, 1, 2, 1, 100]
    assert [one(spark, numbers.percent(F.col("a"), F.col("b")), a=a, b=b) for a, b in ((1, 8), (0, 0), (9, 8), (45, 100))] == [13, 0, 100, 45]
    assert [one(spark, numbers.failure_kind(F.col("s")), s=s) for s in (429, 404, 500, 418)] == ["retry", "drop", "retry", "retry"]
    assert one(spark, numbers.session_failure_kind(F.col("s")), s=418) == "drop"
    assert [one(spark, numbers.font_scale(F.col("s")), s=s) for s in ("150%", "1em", "9em", "inherit", "0.3333em", "small", "large", "XX-Large", "smaller", "150 %", "0em", "-1em", "1.2.3em", "1.5.em", "1.em")] == [1.5, None, 2.0, None, 0.5, 0.875, 1.125, 1.5, 0.85, 1.5, None, None, None, None, None]
    assert [one(spark, numbers.font_weight(F.col("s")), s=s) for s in ("bold", "449", "450", "x", "12345", "1" * 30)] == [700, None, 500, None, 900, 900]
    assert one(spark, numbers.half_up(F.col("x")), x=-2.5) == -2


def test_day_split(spark):
    got = one(spark, timing.split_by_day(F.col("s"), F.col("n")), s=86_390, n=86_420)
    assert [(str(x.day), x.seconds) for x in got] == [("1970-01-01", 10), ("1970-01-02", 86_400), ("1970-01-03", 10)]
    assert one(spark, timing.split_by_day(F.col("s"), F.col("n")), s=86_390, n=10)[0].seconds == 10
    assert one(spark, timing.split_by_day(F.col("s"), F.col("n")), s=5, n=0) == []


def events(spark, n, seed, span=90_000):
    rng = random.Random(seed)
    rows, ms = [], 1_704_067_000_000
    for k in range(n):
        ms += rng.choice([0, 1000, 30_000, 89_999, 90_000, 90_001, span])
        rows.append((k, ms, rng.randrange(3), rng.choice(["view", "click", "error", "purchase"])))
    df = spark.createDataFrame(rows, "event_id long, ms long, user_id long, event_type string")
    return rows, df.select("event_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "user_id", "event_type")


def test_accrual_against_a_state_machine(spark):
    rows, df = events(spark, 600, 1)
    got = {r.event_id: r.elapsed for r in accrue(df, "user_id", "event_type", "ts", "event_id", F.col("event_type") == "error", 90_000).collect()}
    seen, last = {}, {}
    for k, ms, user, kind in rows:
        live = {d: t for d, t in seen.get(user, {}).items() if t >= ms - 90_000}
        assert got[k] == (max(0, (ms - last[user] + 500) // 1000) if live else 0)
        seen[user] = {d: t for d, t in live.items() if d != kind} if kind == "error" else {**live, kind: ms}
        last[user] = ms


def test_segments_add_up(spark):
    _, df = events(spark, 400, 2, 80_000_000)
    a = accrue(df, "user_id", "event_type", "ts", "event_id", F.col("event_type") == "error", 100_000_000)
    assert a.agg(F.sum("elapsed")).first()[0] == day_segments(a, "user_id").agg(F.sum("seconds")).first()[0]


def test_session_ends_with_the_last_device():
    s = Session()
    assert s.apply(0, "a", True, 90_000) is None
    assert s.apply(0, "a", False, 90_000) == (1, 0, False)
    assert s.apply(30_000, "b", False, 90_000) == (1, 30, False)
    assert s.apply(60_000, "a", True, 90_000) == (1, 30, False)
    assert s.apply(90_000, "b", True, 90_000) == (1, 30, True)
    assert s.apply(95_000, "b", False, 90_000) == (2, 0, False)
    assert s.apply(185_001, "a", True, 90_000) == (2, 0, True)


def test_stream_equals_batch(spark, tmp_path):
    _, df = events(spark, 300, 3)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = sorted(map(tuple, session_log(df, 90_000).collect()))
    stream = stream_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 90_000)
    q = stream.writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("sessions").collect())) == batch


def test_unique_names_with_natural_suffixes(spark):
    rows = [(1, "a"), (2, "a"), (3, "a-2"), (4, "a"), (5, "b")]
    got = unique_names(spark.createDataFrame([(0, *r) for r in rows], "g int, id int, base string"), ["g"], "base", [F.asc("id")], "slug").collect()
    slugs = {r.id: r.slug for r in got}
    assert slugs == {1: "a", 2: "a-3", 3: "a-2", 4: "a-4", 5: "b"}
    many = [(1000 + i, "n") for i in range(80)] + [(i, f"n-{i}") for i in range(2, 122, 2)]
    got = unique_names(spark.createDataFrame([(0, *r) for r in many], "g int, id int, base string"), ["g"], "base", [F.asc("id")], "slug").collect()
    assert len({r.slug for r in got}) == len(many) and {r.slug for r in got if r.base == "n"} == {"n", *[f"n-{k}" for k in [k for k in range(3, 400) if k % 2 or k > 120][:79]]}


def test_deepest_label_against_the_fold(spark):
    rng, rows, want, first = random.Random(6), [], {}, {}

    def grow(book, parent, depth, made):
        nodes = []
        for _ in range(rng.randint(0, 3) if depth else rng.randint(1, 4)):
            node = len(made)
            made.append(None)
            hit, label = rng.random() < 0.4, rng.choice(["", f"L{node}", f"L{node}"])
            rows.append((book, node, parent, depth, node, label, hit))
            nodes.append((hit and bool(label), label, depth, grow(book, node, depth + 1, made) if depth < 4 else []))
        return nodes

    def fold(nodes):
        best = None
        for hit, label, depth, below in nodes:
            if hit:
                best = (depth, label)
            nested = fold(below)
            if nested and (not best or nested[0] >= best[0]):
                best = nested
        return best

    for book in range(150):
        best = fold(grow(book, None, 0, []))
        if best:
            want[book] = best[1]
    toc = spark.createDataFrame(rows, "book int, node int, parent int, depth int, preorder int, label string, hit_ boolean")
    assert {r.book: r.label for r in deepest_match(toc, ["book"], F.col("hit_")).collect()} == want
    for r in rows:
        if r[6]:
            first.setdefault(r[0], r[5])
    assert {r.book: r.label for r in first_match(toc, ["book"], F.col("hit_")).collect()} == first


def test_resolved_hrefs(spark):
    chapters = spark.createDataFrame([(1, 0, "a.html", None, "c0"), (1, 1, "a.html", "x", "c1"), (1, 2, "b.html", "y", "c2"), (1, 3, "b.html", "z", "c3")], "book int, idx int, path string, anchor string, chapter string")
    toc = spark.createDataFrame([(1, 0, "a.html", "x"), (1, 1, "a.html", "q"), (1, 2, "b.html", "q"), (1, 3, "none.html", None), (1, 4, "a.html", None)], "book int, node int, path string, anchor string")
    assert {r.node: r.chapter for r in resolved_hrefs(toc, chapters).collect()} == {0: "c1", 1: "c0", 2: "c2", 3: None, 4: "c0"}


def test_entities():
    assert decode_entities("&amp;lt; &#65;&#x42; &nbsp; &#0; &quot;") == "&lt; AB &nbsp; &#0; \""


PAGE = """<html><head><title>T</title><style>p{text-indent:2em} .c, p.d {text-align:center; font-size: large} a > b {color:red} div{font-weight:bold}</style></head><body>
<div id="top"><section><h1>One <b>bo</b><b>ld</b></h1><p class="c" style="font-size:150%">Hi <a href="x"><i>li</i>nk</a> &amp; more  <br> next</p></section>
<div id="in" align="right"><p>para<img src="w.png" width="300" alt="w">tail</p><p><img src="s.png" alt="s"></p></div></div>
<ul id="l"><li>a<ul><li>nested</li></ul></li><li> </li><li>b <em>c</em></li></ul> stray <em>alone</em><blockquote>q</blockquote><p> </p><img alt="none"><img src="z.png" alt="zz"><script>var p = "<p>no</p>"</script></body></html>"""


def test_blocks_and_inlines(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>a<p>b<div>c<p>d</div>"), (4, "no blocks")], "page_id long, html string")
    blocks = page_blocks(element_trees(pages, "html"), "page_id")
    rows = sorted(block_rows(blocks, "page_id").collect(), key=lambda r: (r.page_id, r.n))
    got = [(r.kind, r.level, r.anchor, r.text, r.src, r.align, r.font, r.weight, r.indent) for r in rows if r.page_id == 1]
    assert got == [
        ("heading", 1, "top", "One bold", None, None, None, 700, None),
        ("paragraph", None, None, "Hi link & more\nnext", None, "center", 1.5, 700, 2.0),
        ("paragraph", None, "in", "para", None, "right", None, 700, 2.0),
        ("image", None, None, "w", "w.png", None, None, None, None),
        ("paragraph", None, None, "tail", None, "right", None, 700, 2.0),
        ("image", None, None, "s", "s.png", None, None, None, None),
        ("list", None, "l", "a\nb c", None, None, None, None, None),
        ("paragraph", None, None, "alone", None, None, None, None, None),
        ("blockquote", None, None, "q", None, None, None, None, None),
        ("image", None, None, "zz", "z.png", None, None, None, None),
    ]
    assert [(r.n, r.id) for r in rows if r.page_id == 3] == [(1, "3::b1"), (2, "3::b2"), (3, "3::b3")]
    assert [[i.text for i in r["items"]] for r in rows if r.kind == "list"] == [["a", "b c"]]
    runs = sorted((r.block, r["item"], r.n, r.text, r.bold, r.italic, r.href) for r in inline_rows(blocks, "page_id").where("page_id = 1 and kind = 'text' and block in (1, 2, 7)").collect())
    assert runs == [
        (1, 0, 1, "One ", False, False, None), (1, 0, 2, "bold", True, False, None),
        (2, 0, 1, "Hi ", False, False, None), (2, 0, 2, "li", False, True, "x"), (2, 0, 3, "nk", False, False, "x"), (2, 0, 4, " & more \n next", False, False, None),
        (7, 1, 1, "a", False, False, None), (7, 2, 1, "b ", False, False, None), (7, 2, 2, "c", False, True, None),
    ]


def test_contents_trees(spark):
    nav = '<html><body><nav epub:type="toc"><h1>no</h1><ol><li><a href="a.x">One</a><ol><li><a href="b.x"></a></li><li><span> </span><ol><li>Deep <i>label</i></li></ol></li></ol></li><li><span></span></li></ol></nav></body></html>'
    ncx = '<ncx><navMap><navPoint id="1"><navLabel><text> P </text></navLabel><content src="p.x#1"/><navPoint><navLabel><text/></navLabel><content src="q.x"/></navPoint></navPoint></navMap></ncx>'
    rows = toc_entries(element_trees(spark.createDataFrame([("nav", nav), ("ncx", ncx), ("none", "<p>x</p>"), ("null", None)], "book string, markup string"), "markup"), "book").collect()
    said = lambda b: [(r.depth, r.label, r.href) for r in sorted(rows, key=lambda r: r.preorder) if r.book == b]
    assert said("nav") == [(0, "One", "a.x"), (1, "b.x", "b.x"), (1, "Untitled section", None), (2, "Deep label", None)]
    assert said("ncx") == [(0, "P", "p.x#1"), (1, "q.x", "q.x")] and {r.book for r in rows} == {"nav", "ncx"}
    parents = {r.node: r.parent for r in rows if r.book == "nav"}
    assert sum(p is None for p in parents.values()) == 1 and all(p is None or p in parents for p in parents.values())


@pytest.mark.parametrize("raw,parts", [("see https://example.com/a/b?x=1 now", ["see https://", "example.", "com/", "a/", "b?", "x=", "1 now"]), ("e.g. well-known", ["e.g. well-known"]), ("123,456,789,012,345", ["123,456,789,012,345"]), ("averyveryverylongword...", ["averyveryverylongword..."])])
def test_break_points(spark, raw, parts):
    from pagemill.functions.styles import break_points

    assert one(spark, break_points(F.col("t")), t=raw) == parts


def test_style_rules():
    from pagemill.sources.css import rules_of

    css = "/* x */ p, .lead { text-indent: 1em !important; color: red } p > a { x: y } h1.big{font-size:2em;} @media print { p { margin: 0 } }"
    assert rules_of(css) == [("p", "text-indent", "1em"), ("p", "color", "red"), (".lead", "text-indent", "1em"), (".lead", "color", "red"), ("h1.big", "font-size", "2em"), ("p", "margin", "0")]


def test_many_entities_in_one_text():
    """Time grows with the text: 300,000 entities in one paragraph."""
    import time

    from pagemill.sources.trees import tree_of

    began = time.process_time()
    tree = tree_of("<p>" + "a&amp;" * 300_000 + "</p>")
    assert tree.texts[1] == "a&" * 300_000 and time.process_time() - began < 20


def test_places_in_groups_of_any_size(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.randrange(50), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g string, v int, id long").repartition(5)
    got = {r.id: r.place for r in numbered(df, ["g"], [F.desc("v"), F.asc("id")], "place").collect()}
    for g in ("hot", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    assert numbered(df.limit(0), ["g"], [F.asc("id")], "place").collect() == []
