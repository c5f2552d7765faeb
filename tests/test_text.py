"""Scalar text expressions against the Python string semantics they restate."""


from pyspark.sql import functions as F

from quarry.functions import text as T

SAMPLES = [
    "  hello world  ",
    " nbsp　ideographic ",
    "line1\nline2\r\nline3\x0bline4 ",
    "",
    "\t\n ",
    "Question: a?\nAnswer: b\nWhat is it?\nkeep me\n  What now？  \nWhat",
    "One. Two!  Three? four",
]


def test_strip_split_splitlines(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "t string")
    got = df.select(T.ustrip("t").alias("s"), T.usplit_words("t").alias("w"),
                    F.filter(T.split_lines("t"), lambda x: x != "").alias("l")).collect()
    for s, r in zip(SAMPLES, got):
        assert r["s"] == s.strip()
        assert r["w"] == s.split()
        assert r["l"] == [x for x in s.splitlines() if x != ""]


def test_clean_text_and_qa(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "t string")
    got = df.select(T.clean_text("t").alias("c"), T.clean_qa_lines("t").alias("q")).collect()
    for s, r in zip(SAMPLES, got):
        assert r["c"] == s.replace("\n", " ").strip()
    # question and answer lines go, the others are joined by blanks
    assert [r["q"] for r in got] == [
        "hello world", "nbsp　ideographic", "line1 line2 line3 line4", "", "", "keep me What", "One. Two!  Three? four",
    ]


def test_infer_tags_and_intents(spark):
    texts = ["Admission to the LIBRARY", "prevent issues", "nothing", "Join a club, pick a module"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.infer_tags("t")).collect()]
    expected = []
    for t in texts:
        tags = [tag for tag, kws in T.DEFAULT_TAG_RULES if any(k in t.lower() for k in kws)]
        expected.append(tags)
    assert got == expected
    q = spark.createDataFrame([("  Which way?",), ("WHO ARE YOU",), ("plain request",)], "q string")
    got = [r[0] for r in q.select(T.detect_intent("q")["intent"]).collect()]
    assert got == ["greeting", "identity", None]  # substring rule: "hi" inside "which"


def test_truncate_at_stop(spark):
    df = spark.createDataFrame([("a###b</s>c",), ("x\nYou: y",), ("no stop",), ("###",)], "t string")
    got = [r[0] for r in df.select(T.truncate_at_stop("t", max_tokens=1024)).collect()]
    assert got == ["a", "x", "no stop", ""]
    capped = spark.createDataFrame([("a b  c d",)], "t string").select(T.truncate_at_stop("t", max_tokens=2)).first()[0]
    assert capped == "a b"


def test_decode_entities_matches_html_unescape(spark):
    import html

    samples = ["a &amp;lt; b", "x&rsquo;s &eacute;t&eacute; &#39;q&#39; &#x27;h&#X41; &#128512;", "&&& plain",
               "&copy;&middot;&nbsp;end", "t&eacute;&#233;"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[0] for r in df.select(T.decode_entities("t")).collect()]
    assert got == [html.unescape(s) for s in samples]
    odd = spark.createDataFrame([("&bogus; &#0; &amp",)], "t string").select(T.decode_entities("t")).first()[0]
    assert odd == "&bogus; &#0; &amp"  # malformed references stay as written
