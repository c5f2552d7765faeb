"""DuckDB SQL fragments for the independent oracle (``oracle_sql()``).

The oracle restates each operator's semantics in plain SQL over the same
parquet tables.  RE2 (DuckDB) differs from Java regex: ``\\s`` lacks \\x0B,
code points are written ``\\x{..}``, there is no look-around, and replacement
groups are ``\\1``.
"""

from __future__ import annotations

from collections.abc import Sequence

WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}]+"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def ustrip(e: str) -> str:
    return f"regexp_replace({e}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def words(e: str) -> str:
    return f"list_filter(string_split_regex({e}, '{WS}+'), lambda w: w <> '')"


def clean(e: str) -> str:
    return ustrip(f"replace({e}, chr(10), ' ')")


def split_lines(e: str) -> str:
    return f"string_split_regex({e}, '{LINE_BREAK}')"


def decode_entities(e: str) -> str:
    from quarry.functions.text import ENTITY_CHARS, MAX_CODE_POINT

    table = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in sorted(ENTITY_CHARS.items())) + "}"
    name = "regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1)"
    dec = "regexp_extract(p, '^#([0-9]{1,7});', 1)"
    hx = "regexp_extract(p, '^#[xX]([0-9A-Fa-f]{1,6});', 1)"
    named = f"(CASE WHEN {name} <> '' THEN {table}[{name}] END)"
    cp = f"(CASE WHEN {dec} <> '' THEN CAST({dec} AS INTEGER) WHEN {hx} <> '' THEN CAST(('0x' || {hx}) AS INTEGER) END)"
    valid = f"({cp} BETWEEN 1 AND {MAX_CODE_POINT} AND NOT {cp} BETWEEN 55296 AND 57343)"
    numeric = f"(CASE WHEN {valid} THEN chr({cp}) END)"
    used = (f"(CASE WHEN {named} IS NOT NULL THEN length({name}) + 2 WHEN {numeric} IS NOT NULL THEN "
            f"(CASE WHEN {dec} <> '' THEN length({dec}) + 3 ELSE length({hx}) + 4 END) END)")
    piece = f"(CASE WHEN {used} IS NOT NULL THEN coalesce({named}, {numeric}) || substr(p, {used}) ELSE '&' || p END)"
    parts = f"string_split({e}, '&')"
    decoded = (f"array_to_string(list_concat({parts}[1:1], list_transform({parts}[2:len({parts})], lambda p: {piece})), '')")
    return f"(CASE WHEN contains({e}, '&') THEN {decoded} ELSE {e} END)"


def tags(e: str, rules=None) -> str:
    from quarry.functions.text import DEFAULT_TAG_RULES

    rules = rules or DEFAULT_TAG_RULES
    parts = []
    for tag, kws in rules:
        cond = " OR ".join(f"contains(lower({e}), {q(k.lower())})" for k in kws)
        parts.append(f"CASE WHEN {cond} THEN {q(tag)} END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',')"


def bucket_codes_sql(e: str, dim: int = 384) -> str:
    """Signed bucket codes of the hashing embedder (list of ints)."""
    return (
        f"list_transform(regexp_extract_all(lower({e}), '{WORD}', 0), lambda w: "
        f"(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END) * "
        f"((CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dim}) + 1))"
    )


def sparse_embedding_cte(name: str, src: str, key: str, text: str, dim: int = 384) -> str:
    """CTE ``name(key, bucket, w)``: unit-norm hashing weights, rounded through float32."""
    return f"""{name}_c AS (
  SELECT {key} AS k, unnest({bucket_codes_sql(text, dim)}) AS c FROM {src}
), {name}_t AS (
  SELECT k, abs(c) - 1 AS bucket, sum(sign(c)) AS tf FROM {name}_c GROUP BY 1, 2 HAVING sum(sign(c)) <> 0
), {name} AS (
  SELECT k AS {key}, bucket,
         CAST(CAST(tf / sqrt(sum(tf * tf) OVER (PARTITION BY k)) AS FLOAT) AS DOUBLE) AS w
  FROM {name}_t
)"""


def values(rows: Sequence[Sequence], cols: Sequence[tuple[str, str]]) -> str:
    """Inline literal rows as a typed subquery."""

    def lit(v, t):
        if v is None:
            return f"CAST(NULL AS {t})"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return f"CAST({v!r} AS {t})"
        return f"CAST({q(str(v))} AS {t})"

    body = ", ".join("(" + ", ".join(lit(v, t) for v, (_, t) in zip(r, cols)) + ")" for r in rows)
    names = ", ".join(c for c, _ in cols)
    return f"(SELECT * FROM (VALUES {body}) AS _v({names}))"


# ---------------------------------------------------------------- HTML (RE2)
REST = r"""(?:[^>"']|"[^"]*"|'[^']*')*>"""
TAG = r"<[A-Za-z/!?]" + REST + r"|<[A-Za-z/!?][^>]*>"
CODE = r"<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
TOKEN = r"(?is)<!--.*?-->|<script\b[^>]*>(.*?)</script\s*>|<style\b[^>]*>(.*?)</style\s*>|" + TAG
ATTRIBUTE = r"""[\s/]+[^\s=/>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
ATTRIBUTE_NAME = r"""^[\s/]+([^\s=/>"']+)"""
ATTRIBUTE_VALUE = r"""=\s*("[^"]*"|'[^']*'|[^\s"'>]+)$"""


def lone_lt(e: str) -> str:
    return f"regexp_replace({e}, '<([^A-Za-z/!?])', '&lt;\\1', 'g')"


def without_code(e: str) -> str:
    return f"regexp_replace({e}, {q('(?is)<!--.*?-->|' + CODE)}, ' ', 'g')"


def text_nodes(e: str) -> str:
    pieces = f"string_split(regexp_replace({lone_lt(e)}, {q(TOKEN)}, chr(1) || '\\1\\2' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({pieces}, lambda p: {ustrip(decode_entities('p'))}), lambda p: p <> '')"


VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
BODY_TOKEN = r"(?is)<!--.*?-->|" + CODE + "|" + TAG + r"|[^<]+"


def element_text_lines(body_e: str) -> str:
    """P4 (text inside an element below body) as a fold over body tokens."""
    void = ", ".join(q(v) for v in [*VOID, "script", "style"])
    name = r"lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1))"
    is_code = r"regexp_matches(t, '(?is)^<(script|style)\b')"
    delta = (r"CASE WHEN NOT starts_with(t, '<') OR starts_with(t, '<!') OR starts_with(t, '<?') THEN 0 "
             f"WHEN {name} IN ({void}) THEN 0 WHEN starts_with(t, '</') THEN -1 "
             r"WHEN regexp_matches(t, '/\s*>\z') THEN 0 ELSE 1 END")
    inner = r"regexp_extract(t, '(?is)^<(?:script|style)\b[^>]*>(.*)</(?:script|style)\s*>\z', 1)"
    keep = f"CASE WHEN {is_code} THEN {inner} WHEN NOT starts_with(t, '<') AND acc.d > 0 THEN t END"
    fold = (f"list_reduce(list_prepend('<!---->', regexp_extract_all({lone_lt(body_e)}, {q(BODY_TOKEN)}, 0)), "
            f"lambda acc, t: {{'d': greatest(acc.d + ({delta}), 0), 'out': CASE WHEN ({keep}) IS NOT NULL "
            f"THEN list_append(acc.out, {keep}) ELSE acc.out END}}, {{'d': 0, 'out': []::VARCHAR[]}}).out")
    return f"list_filter(list_transform({fold}, lambda p: {ustrip(decode_entities('p'))}), lambda p: p <> '')"


def body(e: str) -> str:
    return f"regexp_replace(regexp_extract({e}, '(?is)<body\\b[^>]*>(.*)', 1), '(?is)</body\\s*>.*', '')"


def title(e: str) -> str:
    raw = f"regexp_extract({e}, {q('(?is)<title' + chr(92) + 'b[^>]*>([^<]*)')}, 1)"
    return f"nullif({decode_entities(raw)}, '')"


def attr(tag: str, name: str) -> str:
    of_name = (f"list_filter(regexp_extract_all({tag}, {q(ATTRIBUTE)}, 0), "
               f"lambda attribute: lower(regexp_extract(attribute, {q(ATTRIBUTE_NAME)}, 1)) = {q(name)})[1]")
    raw = f"regexp_extract({of_name}, {q(ATTRIBUTE_VALUE)}, 1)"
    val = (f"CASE WHEN {raw} IS NULL OR {raw} = '' THEN NULL WHEN {raw}[1] IN (chr(34), chr(39)) "
           f"THEN {raw}[2:length({raw}) - 1] ELSE {raw} END")
    return decode_entities(val)


def start_tags(e: str, tag: str) -> str:
    pattern = "(?is)<" + tag + r"\s" + REST + "|<" + tag + r"\s[^>]*>"
    return f"regexp_extract_all({without_code(e)}, {q(pattern)}, 0)"


def meta(e: str, name: str) -> str:
    first = f"list_filter({start_tags(e, 'meta')}, lambda m: {attr('m', 'name')} = {q(name)})[1]"
    return attr(first, "content")


def attr_list(e: str, tag: str, name: str) -> str:
    return f"list_filter(list_transform({start_tags(e, tag)}, lambda t: {attr('t', name)}), lambda v: v IS NOT NULL)"


def element_texts_ctes(src: str, key: str, html: str, tag: str, class_substr: str | None, name: str) -> str:
    """CTEs producing ``name(key, texts list)`` for P6/P7."""
    tag_re = q("(?is)(<!--.*?-->|" + CODE + "|<" + tag + r"\b" + REST + "|<" + tag + r"\b[^>]*>|</" + tag + r"\s*>)")
    code = r"'(?is)^<(!--|script\b|style\b)'"
    close = "coalesce(list_filter(range(j + 1, len(tags) + 1), lambda x: depth[x] = depth[j] - 1)[1], len(tags) + 1)"
    piece = f"(CASE WHEN x > j + 1 AND regexp_matches(tags[x - 1], {code}) THEN tags[x - 1] ELSE '' END || segs[x])"
    cls = f" AND coalesce(contains({attr('tags[j]', 'class')}, {q(class_substr)}), false)" if class_substr else ""
    return f"""{name}_a AS (
  SELECT {key}, regexp_extract_all({html}, {tag_re}, 1) AS tags, string_split_regex({html}, {tag_re}) AS segs FROM {src}
), {name}_b AS (
  SELECT *, list_transform(tags, lambda t: CASE WHEN starts_with(t, '</') THEN -1
                                                WHEN regexp_matches(t, {code}) OR regexp_matches(t, '/\\s*>\\z') THEN 0 ELSE 1 END) AS d FROM {name}_a
), {name}_c AS (
  SELECT *, list_transform(range(1, len(d) + 1), lambda i: list_sum(d[1:i])) AS depth FROM {name}_b
), {name} AS (
  SELECT {key}, list_filter(list_transform(
      list_filter(range(1, len(tags) + 1), lambda j: d[j] = 1{cls}),
      lambda j: array_to_string(flatten(list_transform(range(j + 1, {close} + 1), lambda x: {text_nodes(piece)})), chr(10))),
    lambda x: x <> '') AS texts
  FROM {name}_c
)"""


# ---------------------------------------------------------------- URLs (RE2)
URL_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(e: str, i: int) -> str:
    return f"regexp_extract({e}, {q(URL_RE)}, {i})"


def normal_escapes(e: str) -> str:
    """Blanks and non-ASCII characters escaped, escapes in upper case, unreserved ones decoded."""
    plain = f"""array_to_string(list_transform(string_split(replace({e}, ' ', '%20'), ''),
      lambda c: CASE WHEN ord(c) > 127 THEN url_encode(c) ELSE c END), '')"""
    return f"""array_to_string(list_transform(string_split({plain}, '%'), lambda p, i:
      CASE WHEN i = 1 THEN p
           WHEN NOT regexp_matches(p, '^[0-9A-Fa-f]{{2}}') THEN '%' || p
           WHEN regexp_matches(upper(p[:2]), '^(?:2D|2E|5F|7E|3[0-9]|[46][1-9A-F]|[57][0-9A])') THEN chr(('0x' || p[:2])::INT) || p[3:]
           ELSE '%' || upper(p[:2]) || p[3:] END), '')"""


def request_key(e: str) -> str:
    """The canonical request of an http(s) url."""
    netloc = url_part(e, 2)
    user = f"regexp_extract({netloc}, '^(?:[^@]*@)?', 0)"
    scheme = f"lower({url_part(e, 1)})"
    host = f"lower(substr({netloc}, length({user}) + 1))"
    host = f"""CASE {scheme} WHEN 'http' THEN regexp_replace({host}, ':(?:80)?$', '') WHEN 'https' THEN regexp_replace({host}, ':(?:443)?$', '') ELSE {host} END"""
    path = f"CASE WHEN {url_part(e, 3)} = '' THEN '/' ELSE {url_part(e, 3)} END"
    named = f"""list_sort(list_transform(list_filter(string_split(replace({normal_escapes(url_part(e, 4))}, '%20', '+'), '&'), lambda x: x <> ''),
      lambda x: {{'n': regexp_extract(x, '^[^=]*', 0), 'v': substr(x, length(regexp_extract(x, '^[^=]*', 0)) + 2)}}))"""
    query = f"array_to_string(list_transform({named}, lambda x: x.n || '=' || x.v), '&')"
    front = f"CASE WHEN regexp_matches({e}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//') THEN CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END || '//' || {user} || {host} WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END"
    return f"({front} || {normal_escapes(path)} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)"


def suffix(query: str, frag: str) -> str:
    return f"(CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END || CASE WHEN {frag} <> '' THEN '#' || {frag} ELSE '' END)"


def url_join(b: str, h: str) -> str:
    h = f"regexp_replace(regexp_replace({h}, '[\\t\\r\\n]', '', 'g'), '^[\\x00-\\x20]+', '')"
    bs, bn, bp, bq = f"lower({url_part(b, 1)})", url_part(b, 2), url_part(b, 3), url_part(b, 4)
    hs, hn, hp, hq, hf = f"lower({url_part(h, 1)})", url_part(h, 2), url_part(h, 3), url_part(h, 4), url_part(h, 5)
    base_parts = f"string_split({bp}, '/')"
    base_dir = f"(CASE WHEN {base_parts}[-1] <> '' THEN {base_parts}[1:len({base_parts}) - 1] ELSE {base_parts} END)"
    rel = f"list_concat({base_dir}, string_split({hp}, '/'))"
    rel_clean = (f"(CASE WHEN len({rel}) >= 2 THEN list_concat(list_concat({rel}[1:1], "
                 f"list_filter({rel}[2:len({rel}) - 1], lambda x: x <> '')), {rel}[len({rel}):len({rel})]) ELSE {rel} END)")
    segs = f"(CASE WHEN starts_with({hp}, '/') THEN string_split({hp}, '/') ELSE {rel_clean} END)"
    fold = (f"list_reduce(list_prepend('.', {segs}), lambda acc, s: CASE WHEN s = '..' THEN acc[1:len(acc) - 1] "
            f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])")
    resolved = f"(CASE WHEN {segs}[-1] IN ('.', '..') THEN list_append({fold}, '') ELSE {fold} END)"
    path0 = f"array_to_string({resolved}, '/')"
    path1 = f"(CASE WHEN {path0} = '' THEN '/' ELSE {path0} END)"
    path = f"(CASE WHEN starts_with({path1}, '/') THEN {path1} ELSE '/' || {path1} END)"
    prefix = f"{bs} || '://'"
    has_netloc = f"regexp_matches({h}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//')"
    foreign = f"({hs} <> '' AND ({hs} <> {bs} OR {hs} NOT IN ('http', 'https', 'ftp', 'file', '')))"
    return f"""(CASE WHEN {h} IS NULL OR {b} IS NULL THEN NULL
      WHEN {h} = '' THEN {b}
      WHEN {foreign} THEN {h}
      WHEN {has_netloc} AND {hn} <> '' THEN {prefix} || {hn} || {hp} || {suffix(hq, hf)}
      WHEN {hp} = '' THEN {prefix} || {bn} || {bp} || {suffix(f"(CASE WHEN {hq} <> '' THEN {hq} ELSE {bq} END)", hf)}
      ELSE {prefix} || {bn} || {path} || {suffix(hq, hf)} END)"""


def slug(url: str, kind: str) -> str:
    path = f"regexp_replace(regexp_replace({url_part(url, 3)}, ';[^/]*$', ''), '^/+|/+$', '', 'g')"
    query = f"translate({url_part(url, 4)}, '=&', '__')"
    base = f"(CASE WHEN {path} = '' THEN (CASE WHEN {kind} = 'pdf' THEN 'pdf_root' ELSE 'root' END) ELSE replace({path}, '/', '_') END)"
    return f"(CASE WHEN {query} <> '' THEN {base} || '_' || {query} ELSE {base} END)"


def route(url: str, ct: str) -> str:
    return (f"(CASE WHEN contains(lower(coalesce({ct}, '')), 'application/pdf') OR ends_with(lower({url}), '.pdf') "
            f"THEN 'pdf' ELSE 'html' END)")


# ---------------------------------------------------------------- dialog / sentences
def intent_case(e: str, intents=None) -> tuple[str, str]:
    from quarry.functions.text import DEFAULT_INTENTS

    intents = intents or DEFAULT_INTENTS
    qx = f"lower({ustrip(e)})"
    name, resp = [], []
    for n, phrases, r in intents:
        cond = " OR ".join(f"contains({qx}, {q(p)})" for p in phrases)
        name.append(f"WHEN {cond} THEN {q(n)}")
        resp.append(f"WHEN {cond} THEN {q(r)}")
    return "(CASE " + " ".join(name) + " END)", "(CASE " + " ".join(resp) + " END)"


def clean_qa(e: str) -> str:
    keep = (f"list_filter({split_lines(e)}, lambda ln: NOT (regexp_matches({ustrip('ln')}, '^(Question:|Answer:)') "
            f"OR regexp_matches({ustrip('ln')}, '^What .*[?？]$')))")
    return ustrip(f"array_to_string({keep}, ' ')")


def truncate_at_stop(e: str, max_tokens: int = 1024) -> str:
    from quarry.functions.text import DEFAULT_STOPS

    pos = "least(" + ", ".join(f"nullif(instr({e}, {q(s)}), 0)" for s in DEFAULT_STOPS) + ")"
    cut = f"(CASE WHEN {pos} IS NULL THEN {e} ELSE left({e}, {pos} - 1) END)"
    return (f"(CASE WHEN len({words(cut)}) > {max_tokens} THEN array_to_string({words(cut)}[1:{max_tokens}], ' ') "
            f"ELSE {cut} END)")


def sentences(e: str) -> str:
    marked = f"regexp_replace({e}, '([.!?]){WS}+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {ustrip('x')}), lambda x: x <> '')"


# words, pieces of a text up to a stop and white space, and the type before a piece's full stop
_LETTERS = "A-Za-zÀ-ÿ"
_CORE = rf"[{_LETTERS}](?:[{_LETTERS}.]*[{_LETTERS}])?"
WORD_TYPE = rf"^[^{_LETTERS}0-9.]*({_CORE})(\.?)[^{_LETTERS}0-9.]*$"
PIECE = rf"(?s).+?(?:[.!?]{WS}+|\z)"
LAST = rf"(?s)^(?:.*{WS})?[^{_LETTERS}0-9.]*({_CORE})\.{WS}+$"


def sentence_chunk_ctes(src: str, name: str, limit: int = 512) -> str:
    """``name(doc_id, chunk_pos, chunk_text)``: greedy sentence packing."""
    return f"""{name}_s AS (
  SELECT doc_id, {sentences(clean('text'))} AS s FROM {src}
), {name}_l AS (
  SELECT doc_id, s, list_transform(s, lambda x: CAST(least({limit}, len({words('x')})) AS BIGINT)) AS lens FROM {name}_s
), {name}_i AS (
  SELECT doc_id, s, list_reduce(lens, lambda acc, l: CASE WHEN acc.no < 0 OR acc.cur + l > {limit}
        THEN {{'cur': l, 'no': acc.no + 1, 'ids': list_append(acc.ids, acc.no + 1)}}
        ELSE {{'cur': acc.cur + l, 'no': acc.no, 'ids': list_append(acc.ids, acc.no)}} END,
      {{'cur': CAST(0 AS BIGINT), 'no': CAST(-1 AS BIGINT), 'ids': CAST([] AS BIGINT[])}}).ids AS ids FROM {name}_l
), {name}_c AS (
  SELECT doc_id, list_transform(range(0, coalesce(ids[-1] + 1, 0)),
           lambda c: array_to_string(list_filter(s, lambda x, i: ids[i] = c), ' ')) AS cs FROM {name}_i
), {name} AS (
  SELECT doc_id, chunk_pos, chunk_text FROM (
    SELECT doc_id, CAST(unnest(range(len(cs))) AS BIGINT) AS chunk_pos, unnest(cs) AS chunk_text FROM {name}_c)
  WHERE chunk_text <> ''
)"""


def mmr_ctes(hits: str, qemb: str, cemb: str, k: int = 4, lam: float = 0.5) -> str:
    """MMR oracle, unrolled: ``hits(qid, rank, id)``, sparse query / chunk
    weights ``qemb(qk, bucket, w)`` and ``cemb(id, bucket, w)``; ends with
    ``mmr_picks(qid, pick, rank, id)``."""
    mu = 1.0 - lam
    parts = [f"""cnorm AS (SELECT id, sqrt(sum(w * w)) AS n FROM {cemb} GROUP BY id
), qnorm AS (SELECT qk, sqrt(sum(w * w)) AS n FROM {qemb} GROUP BY qk
), cands AS (
  SELECT h.qid, h.rank AS r, h.id,
         floor(coalesce((SELECT sum(q.w * c.w) FROM {qemb} q JOIN {cemb} c USING (bucket) WHERE q.qk = h.qid AND c.id = h.id), 0)
               / ((SELECT n FROM qnorm WHERE qk = h.qid) * (SELECT n FROM cnorm WHERE cnorm.id = h.id)) * 1000000 + 0.5) / 1000000 AS sim
  FROM {hits} h
), pc AS (
  SELECT a.qid, a.r AS r1, b.r AS r2,
         floor(coalesce((SELECT sum(x.w * y.w) FROM {cemb} x JOIN {cemb} y USING (bucket) WHERE x.id = a.id AND y.id = b.id), 0)
               / ((SELECT n FROM cnorm WHERE cnorm.id = a.id) * (SELECT n FROM cnorm WHERE cnorm.id = b.id)) * 1000000 + 0.5) / 1000000 AS cos
  FROM cands a JOIN cands b ON a.qid = b.qid
), s1 AS (
  SELECT qid, r AS p FROM cands QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, r) = 1
), sel1 AS (SELECT qid, p FROM s1
), m1 AS (
  SELECT c.qid, c.r, pc.cos AS ms FROM cands c JOIN s1 USING (qid) JOIN pc ON pc.qid = c.qid AND pc.r1 = c.r AND pc.r2 = s1.p
)"""]
    for t in range(2, k + 1):
        parts.append(f""", s{t} AS (
  SELECT c.qid, c.r AS p FROM cands c JOIN m{t-1} m USING (qid, r)
  WHERE NOT EXISTS (SELECT 1 FROM sel{t-1} x WHERE x.qid = c.qid AND x.p = c.r)
  QUALIFY row_number() OVER (PARTITION BY c.qid ORDER BY CAST({lam} AS DOUBLE) * c.sim - CAST({mu} AS DOUBLE) * m.ms DESC, c.r) = 1
), sel{t} AS (SELECT qid, p FROM sel{t-1} UNION ALL SELECT qid, p FROM s{t}
), m{t} AS (
  SELECT m.qid, m.r, greatest(m.ms, pc.cos) AS ms FROM m{t-1} m JOIN s{t} USING (qid)
  JOIN pc ON pc.qid = m.qid AND pc.r1 = m.r AND pc.r2 = s{t}.p
)""")
    union = " UNION ALL ".join(f"SELECT qid, CAST({t} AS BIGINT) AS pick, p FROM s{t}" for t in range(1, k + 1))
    parts.append(f""", mmr_picks AS (
  SELECT u.qid, u.pick, u.p AS rank, c.id FROM ({union}) u JOIN cands c ON c.qid = u.qid AND c.r = u.p
)""")
    return "".join(parts)
