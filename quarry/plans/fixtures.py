"""Literal rows the driver tables lack, unioned into the inputs in *both*
engines (Spark ``createDataFrame`` and SQL ``VALUES``) so that a check is not
vacuous.  One definition per fixture, rendered twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import sqltext

_SPARK_TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "INTEGER": "int", "BOOLEAN": "boolean"}


class Fixture:
    def __init__(self, cols: Sequence[tuple[str, str]], rows: Sequence[Sequence]):
        self.cols = list(cols)
        self.rows = [tuple(r) for r in rows]

    def df(self, spark: SparkSession) -> DataFrame:
        ddl = ", ".join(f"{c} {_SPARK_TYPES[t]}" for c, t in self.cols)
        return spark.createDataFrame(self.rows, ddl)

    def sql(self) -> str:
        return sqltext.values(self.rows, self.cols)


NBSP = "\u00a0"

# Blank texts.
BLANK_DOCS = Fixture(
    [("doc_id", "BIGINT"), ("text", "VARCHAR")],
    [(-1, None), (-2, ""), (-3, "   "), (-4, NBSP + NBSP), (-5, "\n\t \n"), (-6, " ok " + NBSP)],
)

# F8: texts hitting the fixed tag keywords.
TAG_TEXTS = Fixture(
    [("doc_id", "BIGINT"), ("text", "VARCHAR")],
    [
        (-11, "Admission opens in May."),
        (-12, "The LIBRARY is on campus."),
        (-13, "Pick a course or a module."),
        (-14, "Join a club during Orientation."),
        (-15, "Apply for the degree programme."),
        (-16, "Nothing to see here."),
        (-17, "Prevent bad events."),
    ],
)

_P1 = (
    "<html><head><title>Fixture &amp; One</title>"
    '<meta content="Desc first" name="description"><meta name=\'keywords\' content=\'k1, k2\'></head>'
    '<body><p>Hello &nbsp; world</p><p>Caf&#233; &rsquo;s &eacute;t&eacute; &#x27;q&#x27; &amp;lt; &bogus;</p>'
    '<script>var t="</p>";</script><!-- a note -->'
    '<div class="item desc"><p>Outer</p><div class="desc-inner">Inner <b>bold</b></div><p>tail</p></div>'
    '<div class="desc"></div><div class="plain">no</div>'
    "<article><p>A1</p><article><p>A2</p></article><p>A3</p></article>\n"
    '<a href="https://other.example.org/x">abs</a><a href="//cdn.example.com/lib.js">proto</a>'
    '<a href="../up/one">up</a><a href="?q=2">query</a><a href="#frag">frag</a><a href="">empty</a>'
    '<a href="mailto:someone@example.com">mail</a>'
    "<a href='http://fx.example.com/dir/sub/page.html?x=1#top'>self</a><a href=plain.html>plain</a>"
    '<a href="./a/./b/../c">dots</a><a href="/c1">cycle</a><a name="anchor">no href</a>\n'
    "<img src=\"/img/a.png\"><img alt=\"x\" src='/img/b.png'>\n"
    "direct text under body</body></html>"
)


def _cycle_page(n: int) -> str:
    return (f"<html><head><title>Cycle {n}</title><meta name=\"description\" content=\"\"></head><body>"
            f"<main><p>Cycle page {n}</p><a href=\"/c{n % 4 + 1}\">next</a></main></body></html>")


# P*, F1-F4, J6, C1, C7: pages the driver table lacks (meta tags, images,
# nesting, every href form, a 4-page link cycle reached from a root page).
PAGES_EXTRA = Fixture(
    [("page_id", "BIGINT"), ("url", "VARCHAR"), ("html", "VARCHAR")],
    [
        (-101, "http://fx.example.com/dir/sub/page.html?x=1#top", _P1),
        (-102, "http://fx.example.com/",
         "<html><head><title></title><meta name=\"keywords\" content=\"\"></head><body><div><a href=\"c1\">start</a>"
         "</div></body></html>"),
        (-103, "http://fx.example.com/c1", _cycle_page(1)),
        (-104, "http://fx.example.com/c2", _cycle_page(2)),
        (-105, "http://fx.example.com/c3", _cycle_page(3)),
        (-106, "http://fx.example.com/c4", _cycle_page(4)),
        (-107, "http://fx.example.com/c1?dup=1", "<html><body><p>no title, no body close"),
    ],
)

# Urls with content types.
ROUTES = Fixture(
    [("url", "VARCHAR"), ("content_type", "VARCHAR")],
    [
        ("http://fx.example.com/files/A.PDF", None),
        ("http://fx.example.com/files/a.pdf?x=1", "text/html"),
        ("http://fx.example.com/download", "application/pdf; charset=x"),
        ("http://fx.example.com/", "Application/PDF"),
        ("http://fx.example.com", None),
        ("http://fx.example.com/a/b/?p=1&q=2", "text/html; charset=utf-8"),
        ("http://fx.example.com//x//", None),
    ],
)

# Extracted PDF page texts, out of order, blank lines, a failed file.
PDF_PAGES = Fixture(
    [("url", "VARCHAR"), ("page_no", "BIGINT"), ("page_text", "VARCHAR"), ("error", "VARCHAR")],
    [
        ("http://fx.example.com/r.pdf", 2, "third  \n\n  page", None),
        ("http://fx.example.com/r.pdf", 0, "  first line\r\nsecond line  ", None),
        ("http://fx.example.com/r.pdf", 1, "   \n ", None),
        ("http://fx.example.com/bad.pdf", 0, None, "EOF marker not found"),
        ("http://fx.example.com/empty.pdf", 0, "", None),
    ],
)

# Dialog turns the driver table lacks.
CONV_EXTRA = Fixture(
    [("conv_id", "BIGINT"), ("turn", "BIGINT"), ("role", "VARCHAR"), ("text", "VARCHAR")],
    [
        (-1, 0, "user", "Hello there"),
        (-1, 1, "assistant", "Question: what?\nAnswer: this\n  What is z?\nReal content here.\n\nWhat now？\nWhat"),
        (-1, 2, "user", "exit"),
        (-1, 3, "user", "after exit"),
        (-2, 0, "user", "QUIT"),
        (-2, 1, "user", "never seen"),
        (-3, 0, "user", "  WHO ARE YOU and how can you help  "),
        (-3, 1, "user", "What can you do?"),
        (-3, 2, "user", "exit now"),
        (-3, 3, "assistant", "Sure.\nYou: stop here###more</s>"),
        (-3, 4, "user", "I need help"),
        (-3, 5, "user", "please assist me"),
        (-4, 0, "user", None),
        (-4, 1, "user", "   "),
        (-4, 2, "user", NBSP),
        (-4, 3, "user", ""),
        (-4, 4, "assistant", "###starts with stop"),
        (-4, 5, "assistant", "no stop at all \nThe user asked: x"),
        (-4, 6, "system", "be brief"),
    ],
)
