"""Blocks, inline runs and styles from element trees, with DataFrame functions only.

What an element becomes is decided by its tag, and by whether it stands inside
another block: paragraphs, quotes, headings, lists and pictures are blocks,
containers without blocks of their own are paragraphs, and so are inline
elements outside of any block. Everything stays in the row of its page, so
that nothing is shuffled until blocks become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.numbers import font_scale, font_weight
from pagemill.functions.styles import alignment, declared, indent

#: Containers, and inline elements that are paragraphs where they stand alone.
CONTAINERS = ["article", "body", "div", "main", "section"]
INLINE = ["a", "b", "br", "cite", "code", "em", "i", "small", "span", "strong", "sub", "sup"]
HEADINGS = [f"h{n}" for n in range(1, 7)]
#: Fixed value: pictures at least this wide stand between paragraphs, not in them.
WIDE = 200
#: Where a picture's own width is noted, once its header is known.
NATURAL_WIDTH = "natural-width"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _kind(x: Column) -> Column:
    tag = x["tag"]
    plain = tag.isin(*CONTAINERS) & ~x["holds_blocks"]
    return F.when(tag == "img", "image").when(tag == "blockquote", "blockquote").when(tag.isin(*HEADINGS), "heading").when(tag.isin("ol", "ul"), "list").when((tag == "p") | plain | tag.isin(*INLINE), "paragraph")


def _attribute(x: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_element_at(x["attrs"], F.lit(n)) for n in names])


def style_rules(css: Column) -> Column:
    """A style sheet to an array of (selector, align, font, weight, indent), in order. Selectors
    are `tag` or `.class`; of `tag.class` the class counts; others are left out."""
    pattern = r"([^{}@]+)\{([^{}]*)\}"
    stripped = F.regexp_replace(css, r"(?s)/\*.*?\*/", "")

    def of_rule(heads: Column, body: Column) -> Column:
        clean = F.regexp_replace(body, "(?i)!important", "")
        names = F.transform(F.split(heads, ","), lambda s: F.btrim(s, F.lit(" \t\r\n")))
        simple = F.filter(names, lambda s: s.rlike(r"^([A-Za-z][A-Za-z0-9]*)?(\.[a-zA-Z][\w-]*)?$") & (s != ""))
        keys = F.transform(simple, lambda s: F.when(F.contains(s, F.lit(".")), F.concat(F.lit("."), F.substring_index(s, ".", -1))).otherwise(F.lower(s)))
        hints = F.struct(alignment(clean, F.lit(None).cast("string")).alias("align"), font_scale(declared(clean, "font-size")).alias("font"), font_weight(declared(clean, "font-weight")).alias("weight"), indent(clean).alias("indent"))
        return _let(hints, lambda h: F.transform(keys, lambda k: F.struct(k.alias("selector"), h["align"].alias("align"), h["font"].alias("font"), h["weight"].alias("weight"), h["indent"].alias("indent"))))

    return F.flatten(F.zip_with(F.regexp_extract_all(stripped, F.lit(pattern), F.lit(1)), F.regexp_extract_all(stripped, F.lit(pattern), F.lit(2)), of_rule))


def _own_style(x: Column, rules: Column) -> Column:
    """An element's own hints: its style attribute, then its classes (later ones first), then its tag."""
    style, align = _attribute(x, "style"), _attribute(x, "align")
    classes = F.filter(F.split(F.coalesce(_attribute(x, "class"), F.lit("")), r"\s+"), lambda c: c != "")
    keys = F.concat(F.reverse(F.transform(classes, lambda c: F.concat(F.lit("."), c))), F.array(x["tag"]))

    def ruled(name: str) -> Column:
        found = F.transform(keys, lambda k: F.element_at(F.concat(F.array(F.lit(None).cast(_TYPES[name])), F.transform(F.filter(rules, lambda r: (r["selector"] == k) & r[name].isNotNull()), lambda r: r[name])), -1))
        return F.get(F.filter(found, lambda v: v.isNotNull()), 0)

    inline = {"align": alignment(style, align), "font": font_scale(declared(style, "font-size")), "weight": font_weight(declared(style, "font-weight")), "indent": indent(style)}
    styled = F.when(style.isNotNull() | align.isNotNull(), F.struct(*[v.alias(k) for k, v in inline.items()]))
    sheet = F.when(F.size(rules) > 0, F.struct(*[ruled(k).alias(k) for k in inline]))
    return F.struct(*[F.coalesce(styled[k], sheet[k]).cast(_TYPES[k]).alias(k) for k in inline])


_TYPES = {"align": "string", "font": "double", "weight": "int", "indent": "double"}


def _inlines(leaves: Column, after: Column) -> Column:
    """The pieces below an element: text, line ends and pictures with their state, which the
    elements numbered above `after` give: neighbours of equal state are one run."""

    def piece(x: Column) -> Column:
        around = lambda test: F.filter(x["path"], lambda a: (a > after) & test(a))
        node = lambda a: F.element_at("nodes", a)
        has = lambda *tags: F.size(around(lambda a: node(a)["tag"].isin(*tags))) > 0
        links = around(lambda a: (node(a)["tag"] == "a") & _attribute(node(a), "href").isNotNull())
        weights = F.filter(F.transform(F.concat(F.filter(x["path"], lambda a: a > after), F.array(x["n"])), lambda a: F.element_at("own", a)["inline_weight"]), lambda w: w.isNotNull())
        href = F.when(F.size(links) > 0, _attribute(node(F.element_at(links, -1)), "href"))
        text = F.when(x["tag"] == "br", "\n").when(x["tag"] == "#text", F.regexp_replace(x["text"], r"\s+", " "))
        return F.struct(
            F.when(x["tag"] == "img", "image").otherwise("text").alias("kind"), has("b", "strong").alias("bold"), has("em", "i").alias("italic"), href.alias("href"), F.try_element_at(weights, F.lit(-1)).alias("weight"),
            F.coalesce(text, _attribute(x, "alt"), F.lit("")).alias("text"), F.when(x["tag"] == "img", _attribute(x, "src")).alias("src"), _attribute(x, NATURAL_WIDTH, "width").try_cast("int").alias("width"),
        )

    def runs(pieces: Column) -> Column:
        state = lambda p: F.struct(p["kind"], p["bold"], p["italic"], p["href"], p["weight"])
        fresh = lambda i: (i == 1) | (F.get(pieces, i - 1)["kind"] == "image") | ~state(F.get(pieces, i - 1)).eqNullSafe(state(F.get(pieces, i - 2)))
        starts = F.filter(F.sequence(F.lit(1), F.size(pieces)), fresh)
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(pieces) + 1))
        whole = lambda a, b: F.transform(F.array(F.get(pieces, a - 1)), lambda p: p.withField("text", F.array_join(F.transform(F.slice(pieces, a, b - a), lambda q: q["text"]), "")))[0]
        return F.filter(F.when(F.size(pieces) > 0, F.zip_with(starts, ends, whole)).otherwise(pieces), lambda p: (p["kind"] == "image") | (p["text"] != ""))

    return _let(F.transform(leaves, piece), runs)


def inline_text(inlines: Column) -> Column:
    """The text of runs: no blanks around line ends, runs of blanks collapsed, trimmed."""
    text = F.array_join(F.transform(F.filter(inlines, lambda p: p["kind"] == "text"), lambda p: p["text"]), "")
    return F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n"), r"[ \t]{2,}", " "), F.lit(" \t\r\n"))


def _pictures(inlines: Column) -> Column:
    return F.filter(inlines, lambda p: p["kind"] == "image")


def _as_blocks(b: Column) -> Column:
    """One block, or several: a block of nothing but pictures is these, and wide pictures
    stand between what is before and after them. The anchor goes to the first part."""
    block = lambda kind, text, inlines, anchor, src: F.struct(kind.alias("kind"), text.alias("text"), inlines.alias("inlines"), anchor.alias("anchor"), src.alias("src"))
    none = F.lit(None).cast("string")
    picture = lambda p, anchor: block(F.lit("image"), p["text"], F.slice(b["inlines"], 1, 0), anchor, p["src"])
    wide = lambda p: (p["kind"] == "image") & (p["width"] >= WIDE)

    def parts(at: Column) -> Column:
        """at: the places of wide pictures, with 0 before and one past the end after them."""
        between = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda lo, hi: F.struct(F.slice(b["inlines"], lo + 1, hi - lo - 1).alias("inlines"), F.get(b["inlines"], hi - 1).alias("picture"), (hi <= F.size(b["inlines"])).alias("has")))
        whole = F.transform(between, lambda g: F.array(block(b["kind"], inline_text(g["inlines"]), g["inlines"], none, none), F.when(g["has"], picture(g["picture"], none))))
        kept = F.filter(F.flatten(whole), lambda x: x.isNotNull() & ((x["text"] != "") | (x["kind"] == "image") | (F.size(_pictures(x["inlines"])) > 0)))
        return F.transform(kept, lambda x, i: F.when(i == 0, x.withField("anchor", b["anchor"])).otherwise(x))

    places = F.concat(F.array(F.lit(0)), F.filter(F.transform(b["inlines"], lambda p, i: F.when(wide(p), i + 1)), lambda i: i.isNotNull()), F.array(F.size(b["inlines"]) + 1))
    single = F.array(block(b["kind"], b["text"], b["inlines"], b["anchor"], b["src"]))
    only = (b["text"] == "") & (F.size(_pictures(b["inlines"])) > 0)
    return F.when(b["kind"].isin("list", "image"), single).when(only, F.transform(_pictures(b["inlines"]), lambda p: picture(p, b["anchor"]))).when(F.exists(b["inlines"], wide), _let(places, parts)).otherwise(single)


def with_natural_widths(trees: DataFrame, widths: str) -> DataFrame:
    """The trees with the widths of pictures, a map by their address, noted at their elements."""
    width = lambda x: F.try_element_at(F.col(widths), F.try_element_at(x["attrs"], F.lit("src")))
    noted = lambda x: F.map_concat(F.map_filter(x["attrs"], lambda k, _: k != NATURAL_WIDTH), F.create_map(F.lit(NATURAL_WIDTH), width(x).cast("string")))
    nodes = F.transform("nodes", lambda x: F.when((x["tag"] == "img") & width(x).isNotNull(), x.withField("attrs", noted(x))).otherwise(x))
    return trees.withColumn("nodes", F.when(F.size(F.coalesce(F.col(widths), F.create_map().cast("map<string,int>"))) > 0, nodes).otherwise(F.col("nodes"))).drop(widths)


def page_blocks(trees: DataFrame, key: str) -> DataFrame:
    """Trees (key, nodes) to (key, blocks): an array of structs with n (from 1), id, kind, level,
    ordered, anchor, text, inlines, items, src, align, font, weight and indent.

    Blocks without text and pictures are left out. A list's items are its own elements,
    without lists inside them; items that hold nothing are left out. Styles come from
    the element, its classes and tag in the page's own sheets, and else from what is
    around it. A container's anchor goes to its first block that has none.
    """
    sheet = F.array_join(F.transform(F.filter("nodes", lambda x: x["tag"] == "#style"), lambda x: x["text"]), "\n")
    rows = trees.select(key, "nodes", style_rules(sheet).alias("rules"))
    own = F.transform("nodes", lambda x: F.struct(_kind(x).alias("kind"), _own_style(x, F.col("rules")).alias("style"), font_weight(declared(_attribute(x, "style"), "font-weight")).alias("inline_weight"), _attribute(x, "id", "name").alias("anchor")))
    rows = rows.select(key, "nodes", own.alias("own"))
    of = lambda a: F.element_at("own", a)
    outer = lambda x: of(x["n"])["kind"].isNotNull() & ~F.exists(x["path"], lambda a: of(a)["kind"].isNotNull()) & ~F.exists(x["path"], lambda a: F.element_at("nodes", a)["tag"] == "head")
    rows = rows.select(key, "nodes", "own", F.filter("nodes", outer).alias("roots"))

    below = lambda r: F.filter(F.slice("nodes", r["n"], r["last"] - r["n"] + 1), lambda x: x["tag"].isin("#text", "br") | ((x["tag"] == "img") & _attribute(x, "src").isNotNull()))

    def item(x: Column) -> Column:
        nested = lambda leaf: F.exists(leaf["path"], lambda a: (F.element_at("nodes", a)["parent"] == x["n"]) & F.element_at("nodes", a)["tag"].isin("ol", "ul"))
        return _let(_inlines(F.filter(below(x), lambda leaf: ~nested(leaf)), x["n"]), lambda i: F.struct(inline_text(i).alias("text"), i.alias("inlines")))

    def built(r: Column) -> Column:
        kind = of(r["n"])["kind"]
        items = F.filter(F.transform(F.filter(F.slice("nodes", r["n"], r["last"] - r["n"] + 1), lambda x: (x["parent"] == r["n"]) & (x["tag"] == "li")), item), lambda i: (i["text"] != "") | (F.size(_pictures(i["inlines"])) > 0))
        inlines = _inlines(below(r), F.when(r["tag"].isin(*INLINE), r["n"] - 1).otherwise(r["n"]))
        chain = F.concat(r["path"], F.array(r["n"]))
        style = {k: F.try_element_at(F.filter(F.transform(chain, lambda a: of(a)["style"][k]), lambda v: v.isNotNull()), F.lit(-1)) for k in _TYPES}

        def block(i: Column) -> Column:
            listed, pictured = kind == "list", kind == "image"
            text = F.when(listed, F.array_join(F.transform(i["items"], lambda x: x["text"]), "\n")).when(pictured, F.coalesce(_attribute(r, "alt"), F.lit(""))).otherwise(inline_text(i["inlines"]))
            return F.struct(
                r["n"].alias("node"), r["path"].alias("path"), kind.alias("kind"), F.when(kind == "heading", F.substring(r["tag"], 2, 1).cast("int")).alias("level"), F.when(listed, r["tag"] == "ol").alias("ordered"), of(r["n"])["anchor"].alias("anchor"),
                text.alias("text"), i["inlines"].alias("inlines"), i["items"].alias("items"), F.when(pictured, _attribute(r, "src")).alias("src"), *[F.when(~pictured, v).alias(k) for k, v in style.items()],
            )

        none = F.slice(inlines, 1, 0)
        return _let(F.struct(F.when(kind.isin("list", "image"), none).otherwise(inlines).alias("inlines"), F.when(kind == "list", items).otherwise(F.slice(items, 1, 0)).alias("items")), block)

    rows = rows.select(key, "nodes", "own", F.transform("roots", built).alias("built"))
    full = lambda b: F.when(b["kind"] == "image", b["src"].isNotNull()).when(b["kind"] == "list", F.size(b["items"]) > 0).otherwise((b["text"] != "") | (F.size(_pictures(b["inlines"])) > 0))
    rows = rows.select(key, "nodes", "own", F.filter("built", full).alias("built"))
    # A container's anchor: the block before starts outside the container, so this one is its first.
    before = lambda i: F.coalesce(F.get("built", i - 1)["node"], F.lit(0))
    lent = lambda b, i: F.filter(b["path"], lambda a: (a > before(i)) & F.element_at("nodes", a)["tag"].isin(*CONTAINERS) & of(a)["anchor"].isNotNull())
    anchored = F.transform("built", lambda b, i: b.withField("anchor", F.coalesce(b["anchor"], of(F.try_element_at(lent(b, i), F.lit(-1)))["anchor"])))
    rows = rows.select(key, anchored.alias("built"))
    keep = ["level", "ordered", "items", "align", "font", "weight", "indent"]
    parted = F.transform("built", lambda b: _let(_as_blocks(b), lambda ps: F.transform(ps, lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text"), p["inlines"].alias("inlines"), p["anchor"].alias("anchor"), p["src"].alias("src"), *[F.when(p["kind"] != "image", b[k]).alias(k) for k in keep]))))
    rows = rows.select(key, F.flatten(parted).alias("blocks"))
    number = lambda b, i: F.struct((i + 1).alias("n"), F.concat(F.col(key).cast("string"), F.lit("::b"), (i + 1).cast("string")).alias("id"), b["kind"].alias("kind"), b["level"].alias("level"), b["ordered"].alias("ordered"), b["anchor"].alias("anchor"), b["text"].alias("text"), b["inlines"].alias("inlines"), b["items"].alias("items"), b["src"].alias("src"), *[b[k].alias(k) for k in _TYPES])
    return rows.select(key, F.transform("blocks", number).alias("blocks"))


def _rows(blocks: DataFrame, key: str) -> DataFrame:
    # The outer form, since a filter for pages without blocks would be pushed down through
    # all the expressions that make the blocks, and make them anew.
    return blocks.select(key, F.explode_outer("blocks").alias("b")).where(F.col("b").isNotNull())


def block_rows(blocks: DataFrame, key: str) -> DataFrame:
    """One row a block."""
    return _rows(blocks, key).select(key, "b.*")


def inline_rows(blocks: DataFrame, key: str) -> DataFrame:
    """One row an inline run: (key, block, item, n, kind, text, bold, italic, href, weight, src);
    item is 0 outside of lists."""
    groups = F.concat(F.array(F.struct(F.lit(0).alias("item"), F.col("b.inlines").alias("inlines"))), F.transform("b.items", lambda x, i: F.struct((i + 1).alias("item"), x["inlines"].alias("inlines"))))
    each = _rows(blocks, key).select(key, F.col("b.n").alias("block"), F.explode_outer(groups).alias("g")).select(key, "block", "g.item", F.posexplode_outer("g.inlines").alias("n", "p"))
    return each.where(F.col("p").isNotNull()).select(key, "block", "item", (F.col("n") + 1).alias("n"), *[F.col(f"p.{c}").alias(c) for c in ("kind", "text", "bold", "italic", "href", "weight", "src")])
