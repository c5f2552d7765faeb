"""Text expressions (Column -> Column), all JVM-side.

Python's ``str.strip`` / ``str.split`` / ``str.splitlines`` are Unicode-aware while
Spark's ``trim`` only removes U+0020, so the whitespace and line-break classes
are spelled out here and used through ``regexp_replace`` / ``split``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters for which Python's str.isspace() is true (Java regex syntax).
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# The same characters, for functions that take a set of them.
WS_CHARS = "".join(re.findall(WS, "".join(map(chr, range(0x3001)))))
# Line boundaries of Python's str.splitlines() (Java regex syntax).
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"

# HTML character references: the HTML 4 named entities of Python's standard
# library table (plus &apos;), and numeric references &#NNN; / &#xHH;.
ENTITY_CHARS = {**{name: chr(cp) for name, cp in name2codepoint.items()}, "apos": "'"}
MAX_CODE_POINT = 0x10FFFF


# Tag rules (tag, keywords), in declared order.
DEFAULT_TAG_RULES = [
    ("admissions", ["admission", "apply", "requirements", "enrollment"]),
    ("facilities", ["campus", "hostel", "library", "canteen"]),
    ("courses", ["course", "degree", "programme", "module"]),
    ("student_life", ["event", "orientation", "cca", "club"]),
]

# Intent phrases in declared order.  Responses are our own wording.
DEFAULT_INTENTS = [
    ("greeting", ["hello", "hi", "hey", "good morning", "good afternoon"],
     "Hello! How can I help you today?"),
    ("identity", ["who are you", "what is your name", "identify yourself"],
     "I am a virtual assistant that answers questions from this site's pages."),
    ("capabilities", ["what can you do", "how can you help", "what are your functions"],
     "I can answer questions using the documents in this corpus."),
    ("help", ["help", "i need help", "assist me"],
     "Ask me anything covered by the indexed pages."),
]

# Stop strings of the answer generator.
DEFAULT_STOPS = ["\nYou:", "\nThe user asked:", "</s>", "###"]

# Our own prompt template; {context} and {query} are the slots.
DEFAULT_PROMPT_TEMPLATE = (
    "Reply from the passages below and from nothing else. Keep to short, everyday "
    "sentences, spell out every link in full, and say so when the passages hold no reply.\n"
    "\n"
    "Passages:\n"
    "{context}\n"
    "\n"
    "Request: {query}\n"
    "Reply:\n"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_str(s: str) -> Column:
    return F.lit(s)


def ustrip(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def usplit_words(c) -> Column:
    """Python ``str.split()``: split on Unicode whitespace runs, no empty items."""
    return F.filter(F.split(_col(c), rf"{WS}+"), lambda w: w != "")


def split_lines(c) -> Column:
    """Python ``str.splitlines()`` (a trailing empty item may remain; callers filter)."""
    return F.split(_col(c), LINE_BREAK)


def decode_entities(c) -> Column:
    """Decode character references in one pass over the ``&``-separated
    pieces: a piece starting with ``name;``, ``#NNN;`` or ``#xHH;`` is a
    reference (unknown names and invalid code points stay as written), so a
    decoded ``&amp;`` is never decoded again."""
    t = _col(c)
    table = F.create_map(*[x for k, v in sorted(ENTITY_CHARS.items()) for x in (F.lit(k), F.lit(v))])
    pieces = F.split(t, "&")

    def piece(p):
        # one regex per piece: the reference body (name, #NNN or #xHH) before ';'
        ref = F.regexp_extract(p, r"^(#[xX][0-9A-Fa-f]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
        is_hex = ref.startswith("#x") | ref.startswith("#X")
        is_dec = ref.startswith("#") & ~is_hex
        named = F.when((ref != "") & ~ref.startswith("#"), F.try_element_at(table, ref))
        cp = F.when(is_hex, F.conv(F.substring(ref, 3, 8), 16, 10).cast("int")).when(
            is_dec, F.substring(ref, 2, 8).cast("int"))
        valid = cp.between(1, MAX_CODE_POINT) & ~cp.between(0xD800, 0xDFFF)
        numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))
        rep = F.coalesce(named, numeric)
        return F.when(rep.isNotNull(), F.concat(rep, F.substring(p, F.length(ref) + 2, 1 << 30))).otherwise(
            F.concat(F.lit("&"), p))

    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), piece)
    decoded = F.array_join(F.concat(F.slice(pieces, 1, 1), rest), "")
    return F.when(t.contains("&"), decoded).otherwise(t)


def clean_text(c) -> Column:
    """newline -> space, then strip."""
    return ustrip(F.replace(_col(c), F.lit("\n"), F.lit(" ")))


def select_text_source(article_texts, text_lines, content) -> Column:
    """first non-empty of article_texts, text_lines, content, joined by a space.

    ``content`` is a string (PDF records) and is taken whole.
    """
    a, t, c = _col(article_texts), _col(text_lines), _col(content)
    return (
        F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.array_join(a, " "))
        .when(F.coalesce(F.size(t), F.lit(0)) > 0, F.array_join(t, " "))
        .otherwise(F.coalesce(c, F.lit("")))
    )


def infer_tags(text, rules: Sequence[tuple[str, Sequence[str]]] = DEFAULT_TAG_RULES) -> Column:
    """F8: ordered tags whose keywords occur (substring) in the lowered text."""
    low = F.lower(_col(text))
    conds = []
    for tag, words in rules:
        hit = None
        for w in words:
            e = low.contains(F.lit(w.lower()))
            hit = e if hit is None else (hit | e)
        conds.append(F.when(hit, F.lit(tag)))
    return F.array_compact(F.array(*conds))


def detect_intent(query, intents=DEFAULT_INTENTS, whole_word: bool = False) -> Column:
    """struct(intent, response) of the first intent (declared order) with a
    phrase contained in the lowered, stripped query; NULL when none."""
    q = F.lower(ustrip(_col(query)))
    out = None
    for name, phrases, response in intents:
        hit = None
        for p in phrases:
            if whole_word:
                e = q.rlike(r"(?<![\p{L}\p{N}_])" + _re_quote(p) + r"(?![\p{L}\p{N}_])")
            else:
                e = q.contains(F.lit(p))
            hit = e if hit is None else (hit | e)
        val = F.struct(F.lit(name).alias("intent"), F.lit(response).alias("response"))
        out = F.when(hit, val) if out is None else out.when(hit, val)
    return out


def _re_quote(s: str) -> str:
    return "\\Q" + s + "\\E"


def clean_qa_lines(text) -> Column:
    """drop Q/A-styled lines, join the rest by a space, strip."""
    lines = split_lines(text)
    kept = F.filter(
        lines,
        lambda ln: ~(
            ustrip(ln).rlike(r"^(Question:|Answer:)")
            | ustrip(ln).rlike("^What .*[?？]$")
        ),
    )
    return ustrip(F.array_join(kept, " "))


def build_prompt(context, query, template: str = DEFAULT_PROMPT_TEMPLATE) -> Column:
    """fill the template's {context} and {query} slots."""
    pre, rest = template.split("{context}", 1)
    mid, post = rest.split("{query}", 1)
    return F.concat(F.lit(pre), _col(context), F.lit(mid), _col(query), F.lit(post))


def truncate_at_stop(text, stops: Sequence[str] = DEFAULT_STOPS, max_tokens: int = 1024) -> Column:
    """cut at the earliest stop string, then cap at ``max_tokens``
    whitespace tokens (kept tokens re-joined by one space only when capped)."""
    t = _col(text)
    pos = F.least(*[F.nullif(F.instr(t, s), F.lit(0)) for s in stops]) if len(stops) > 1 else F.nullif(
        F.instr(t, stops[0]), F.lit(0)
    )
    cut = F.when(pos.isNull(), t).otherwise(F.substring(t, F.lit(1), pos - 1))
    words = usplit_words(cut)
    return F.when(F.size(words) > max_tokens, F.array_join(F.slice(words, 1, max_tokens), " ")).otherwise(cut)


def count_tokens(sentence, limit: int = 512) -> Column:
    """Whitespace token count, capped at ``limit`` (the truncation of the tokenizer)."""
    return F.least(F.lit(limit), F.size(usplit_words(sentence)))


def split_sentences(text) -> Column:
    """Rule splitter: break after '.', '!' or '?' followed by whitespace;
    sentences stripped, empties dropped."""
    pieces = F.split(_col(text), rf"(?<=[.!?]){WS}+")
    return F.filter(F.transform(pieces, ustrip), lambda s: s != "")
