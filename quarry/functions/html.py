"""HTML field extraction (P1-P10) as native regexp + higher-order functions.

No per-row parser: a page is cut into tokens with one regular expression in
which ``<script>``/``<style>`` elements and comments are single alternatives,
so a ``</p>`` inside a script string does not split text.  Text nodes are the
pieces between tokens, entity-decoded and stripped (Python ``str.strip``).

Nested elements (``div[class*=desc]``, ``article``) are matched to their
closing tag by a running depth over that element's tags only, so nesting and
unclosed elements (which run to the end of the document) are handled without a
tree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as T

# Java regexes.  The rest of a tag steps over quoted values; one with an open quote ends at the next ">".
REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
TAG = r"<[A-Za-z/!?]" + REST + r"|<[A-Za-z/!?][^>]*>"
COMMENT = r"<!--.*?-->"
# Groups 1/2: raw text of a script/style element.
TOKEN = r"(?is)" + COMMENT + r"|<script\b[^>]*>(.*?)</script\s*>|<style\b[^>]*>(.*?)</style\s*>|" + TAG
CODE = r"<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
# One attribute: name, and value if it has one.  Matched in order, so text inside a quoted value is no attribute.
ATTRIBUTE = r"""[\s/]+[^\s=/>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
SEP = "\u0001"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lone_lt(html) -> Column:
    """``<`` that starts no tag, as a character reference."""
    return F.regexp_replace(_col(html), r"<([^A-Za-z/!?])", "&lt;$1")


def without_code(html) -> Column:
    """HTML without comments, scripts and styles: what can hold tags."""
    return F.regexp_replace(_col(html), r"(?is)" + COMMENT + "|" + CODE, " ")


def text_nodes(fragment) -> Column:
    """Stripped, non-empty text nodes of an HTML fragment, in document order."""
    pieces = F.split(F.regexp_replace(lone_lt(fragment), TOKEN, SEP + "$1$2" + SEP), SEP)
    return F.filter(F.transform(pieces, lambda p: T.ustrip(T.decode_entities(p))), lambda p: p != "")


def body(html) -> Column:
    """Everything inside ``<body>``; a missing ``</body>`` runs to the end."""
    inner = F.regexp_extract(_col(html), r"(?is)<body\b[^>]*>(.*)", 1)
    return F.regexp_replace(inner, r"(?is)</body\s*>.*", "")


def page_title(html) -> Column:
    """First text of ``<title>`` (entity-decoded, not stripped); NULL if none."""
    raw = F.regexp_extract(_col(html), r"(?is)<title\b[^>]*>([^<]*)", 1)
    return F.nullif(T.decode_entities(raw), F.lit(""))


def attr_value(tag, name: str) -> Column:
    """Value of attribute ``name`` in one start tag string; NULL when absent."""
    attributes = F.regexp_extract_all(_col(tag), F.lit(ATTRIBUTE), 0)
    of_name = F.filter(attributes, lambda a: F.lower(F.regexp_extract(a, r"""^[\s/]+([^\s=/>"']+)""", 1)) == name)
    raw = F.regexp_extract(F.try_element_at(of_name, F.lit(1)), r"""=\s*("[^"]*"|'[^']*'|[^\s"'>]+)$""", 1)

    def unquoted(r):
        quoted = r.startswith('"') | r.startswith("'")
        return F.when(r == "", F.lit(None).cast("string")).when(quoted, r.substr(F.lit(2), F.length(r) - 2)).otherwise(r)

    return _let(_let(raw, unquoted), T.decode_entities)


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once; interpreted lambdas would compute every mention of it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _start_tags(html, tag: str) -> Column:
    return F.regexp_extract_all(without_code(html), F.lit(r"(?is)<" + tag + r"\s" + REST + "|<" + tag + r"\s[^>]*>"), 0)


def page_meta(html, name: str) -> Column:
    """``content`` of the first ``<meta name="...">`` (exact name)."""
    first = F.try_element_at(F.filter(_start_tags(html, "meta"), lambda m: attr_value(m, "name") == name), F.lit(1))
    return attr_value(first, "content")


# HTML void elements (they never contain text).
VOID_ELEMENTS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
                 "track", "wbr"]
# Java regex: one token = comment | script/style element | tag | text run.
BODY_TOKEN = r"(?is)" + COMMENT + "|" + CODE + "|" + TAG + r"|[^<]+"


def _token_delta(t: Column) -> Column:
    """What a token adds to the depth; void elements, scripts and styles add nothing, nor do their stray end tags."""
    name = F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    return (
        F.when(~t.startswith("<"), 0)
        .when(t.startswith("<!") | t.startswith("<?"), 0)
        .when(name.isin(*VOID_ELEMENTS, "script", "style"), 0)
        .when(t.startswith("</"), -1)
        .when(t.rlike(r"/\s*>\z"), 0)
        .otherwise(1)
    )


def _depths(deltas: Column, clipped: bool) -> Column:
    """The running sum after each delta; ``clipped``: it never falls below 0.

    An append copies its array, so sums run over parts of about the square root
    of the length and are then carried from part to part.  In a part, ``s`` is
    the plain sum and ``r`` the clipped one from 0; a part that starts at d has
    greatest(d + s, r).
    """

    def after(d: Column, x: Column) -> Column:
        return F.greatest(d + x["s"], x["r"]) if clipped else d + x["s"]

    def inside(acc: Column, x: Column) -> Column:
        s, r = acc["s"] + x, F.greatest(acc["r"] + x, F.lit(0))
        return F.struct(s.alias("s"), r.alias("r"), F.array_append(acc["out"], F.struct(s.alias("s"), r.alias("r"))).alias("out"))

    def carried(acc: Column, part: Column) -> Column:
        sums = F.transform(part, lambda x: after(acc["d"], x))
        return F.struct(F.coalesce(after(acc["d"], F.try_element_at(part, F.lit(-1))), acc["d"]).alias("d"), F.array_append(acc["out"], sums).alias("out"))

    def over(ds: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(ds))), F.lit(1)).cast("int")
        starts = F.sequence(F.lit(1), F.greatest(F.size(ds), F.lit(1)), step)
        zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("r"), F.array().cast("array<struct<s:int,r:int>>").alias("out"))
        parts = F.transform(starts, lambda i: F.aggregate(F.slice(ds, i, step), zero, inside)["out"])
        return F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.array().cast("array<array<int>>").alias("out")), carried)["out"])

    return _let(deltas, over)


def page_text_lines(html) -> Column:
    """P4 (``body *::text``): text nodes inside an element below ``body`` --
    text sitting directly under ``body`` is not included; script and style
    contents count as text of their element.  End tags without a start don't
    lower the depth below the body's."""
    tokens = F.regexp_extract_all(lone_lt(body(html)), F.lit(BODY_TOKEN), 0)

    def texts(z: Column) -> Column:
        def keep(t: Column, i: Column) -> Column:
            inner = F.regexp_extract(t, r"(?is)^<(?:script|style)\b[^>]*>(.*)</(?:script|style)\s*>\z", 1)
            is_code = t.rlike(r"(?is)^<(script|style)\b")
            return F.when(is_code, inner).when(~t.startswith("<") & (F.coalesce(F.get(z["depths"], i - 1), F.lit(0)) > 0), t)

        raw = F.filter(F.transform(z["tokens"], keep), lambda p: p.isNotNull())
        return F.filter(F.transform(raw, lambda p: T.ustrip(T.decode_entities(p))), lambda p: p != "")

    return _let(tokens, lambda t: _let(F.struct(t.alias("tokens"), _depths(F.transform(t, _token_delta), True).alias("depths")), texts))


def body_text_nodes(html) -> Column:
    """``body ::text``: every text node below ``body``, including text sitting
    directly under it."""
    return text_nodes(body(html))


def page_text_clean(html) -> Column:
    """P5: the ``body ::text`` lines joined by newlines."""
    return F.array_join(body_text_nodes(html), "\n")


def _is_code(t: Column) -> Column:
    return t.rlike(r"(?is)^<(!--|script\b|style\b)")


def with_element_texts(df, html: str, out: str, tag: str, class_substr: str | None = None):
    """P6/P7 on a DataFrame: ``out`` = for each ``<tag>`` (whose class contains
    ``class_substr``, when given) its text nodes joined by ``\\n``; empty
    results dropped.

    The tag list, the segments between tags and the running depth are staged
    in their own columns so the per-element lambdas read them instead of
    re-running the regular expressions.
    """
    # comments, scripts and styles are tokens, so tags inside them aren't
    tag_re = r"(?is)(" + COMMENT + "|" + CODE + "|<" + tag + r"\b" + REST + "|<" + tag + r"\b[^>]*>|</" + tag + r"\s*>)"
    st = df.withColumn("_et_tags", F.regexp_extract_all(F.col(html), F.lit(tag_re), 1)).withColumn(
        "_et_segs", F.split(F.col(html), tag_re)
    )
    st = st.withColumn(
        "_et_d",
        F.transform("_et_tags", lambda t: F.when(t.startswith("</"), -1).when(_is_code(t) | t.rlike(r"/\s*>\z"), 0).otherwise(1)),
    )
    # an element is left where its depth is: of the tags of one level in their order, the one behind a start tag ends it

    def by_level(z):
        level = F.transform(z["deltas"], lambda d, i: F.struct((F.get(z["depths"], i) + F.when(d == -1, 1).otherwise(0)).alias("level"), (i + 1).alias("at"), d.alias("d")))
        return F.sort_array(F.filter(level, lambda x: x["d"] != 0))

    st = st.withColumn("_et_levels", _let(F.struct(F.col("_et_d").alias("deltas"), _depths(F.col("_et_d"), False).alias("depths")), by_level))

    def texts(z):
        tags, segs, levels = (z[c] for c in ("tags", "segs", "levels"))

        def element(x, i):
            then = F.get(levels, i + 1)
            ends = F.when(then["level"] == x["level"], then["at"]).otherwise(F.size(tags) + 1)  # or past the end
            opens = x["d"] == 1
            if class_substr is not None:
                opens = opens & F.coalesce(attr_value(F.try_element_at(tags, x["at"]), "class").contains(class_substr), F.lit(False))
            return F.when(opens, F.struct(x["at"].alias("at"), ends.alias("to")))

        def text_of(e):
            def piece(x):  # a segment, after the script before it
                before = F.try_element_at(tags, x - 1)
                return text_nodes(F.concat(F.when((x > e["at"] + 1) & _is_code(before), before).otherwise(F.lit("")), F.try_element_at(segs, x)))

            return F.array_join(F.flatten(F.transform(F.sequence(e["at"] + 1, e["to"]), piece)), "\n")

        elements = F.sort_array(F.filter(F.transform(levels, element), lambda e: e.isNotNull()))
        return F.filter(F.transform(elements, text_of), lambda s: s != "")

    staged = F.struct(F.col("_et_tags").alias("tags"), F.col("_et_segs").alias("segs"), F.col("_et_levels").alias("levels"))
    return st.withColumn(out, _let(staged, texts)).drop("_et_tags", "_et_segs", "_et_d", "_et_levels")


def with_desc_divs(df, html: str = "html", out: str = "desc_divs", class_substr: str = "desc"):
    """P6."""
    return with_element_texts(df, html, out, "div", class_substr)


def with_article_texts(df, html: str = "html", out: str = "article_texts"):
    """P7."""
    return with_element_texts(df, html, out, "article")


def page_links_raw(html) -> Column:
    """Every ``a[href]`` value as written (entity-decoded)."""
    return F.filter(F.transform(_start_tags(html, "a"), lambda t: attr_value(t, "href")), lambda v: v.isNotNull())


def page_images(html) -> Column:
    """P10: every ``img[src]`` value as written."""
    return F.filter(F.transform(_start_tags(html, "img"), lambda t: attr_value(t, "src")), lambda v: v.isNotNull())
