"""URL expressions: parts, ``urljoin`` (P9), slug (P12), routing (P11) and
link predicates (F1-F4) -- all native Spark expressions.

``url_join`` follows Python's ``urllib.parse.urljoin`` (RFC 3986 merge and
dot-segment removal; the base fragment is dropped; a foreign scheme is
returned as written).  Dot segments are removed by a fold over the path parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3986 appendix B: scheme, authority, path, query, fragment.
URL_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
RELATIVE_SCHEMES = ("http", "https", "ftp", "file", "")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _part(url, i) -> Column:
    return F.regexp_extract(_col(url), URL_RE, i)


def url_scheme(url) -> Column:
    return F.lower(_part(url, 1))


def url_netloc(url) -> Column:
    return _part(url, 2)


def url_has_netloc(url) -> Column:
    return _col(url).rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//")


def url_path(url) -> Column:
    return _part(url, 3)


def url_query(url) -> Column:
    return _part(url, 4)


def url_fragment(url) -> Column:
    return _part(url, 5)


def url_hostname(url) -> Column:
    """Lowered host without userinfo and port."""
    return F.lower(F.regexp_extract(url_netloc(url), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def _suffix(query: Column, fragment: Column) -> Column:
    return F.concat(
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def remove_dot_segments(segments: Column) -> Column:
    """Resolve '.' and '..' in a list of path segments (a '..' at the top is dropped)."""
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    last = F.try_element_at(segments, F.lit(-1))
    return F.when(last.isin(".", ".."), F.array_append(resolved, F.lit(""))).otherwise(resolved)


def clean_href(href) -> Column:
    """An address without tabs and line breaks, and blanks and control characters before it."""
    return F.regexp_replace(F.regexp_replace(_col(href), r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")


def url_join(base, href) -> Column:
    """Python ``urljoin(base, href)``."""
    # bound once: an interpreted lambda would clean it again for every part
    return F.element_at(F.transform(F.array(clean_href(href)), lambda h: join_clean(base, h)), 1)


def join_clean(base, href) -> Column:
    """``url_join`` for a cleaned ``href``."""
    b, h = _col(base), _col(href)
    bs, bn, bp, bq = url_scheme(b), url_netloc(b), url_path(b), url_query(b)
    hs, hn, hp, hq, hf = url_scheme(h), url_netloc(h), url_path(h), url_query(h), url_fragment(h)
    prefix = F.concat(bs, F.lit("://"))
    # relative path merge
    base_parts = F.split(bp, "/")
    base_dir = F.when(F.try_element_at(base_parts, F.lit(-1)) != "", F.slice(base_parts, 1, F.size(base_parts) - 1)).otherwise(
        base_parts
    )
    rel = F.concat(base_dir, F.split(hp, "/"))
    n = F.size(rel)
    rel_clean = F.when(
        n >= 2,
        F.concat(F.slice(rel, 1, 1), F.filter(F.slice(rel, 2, F.greatest(n - 2, F.lit(0))), lambda x: x != ""),
                 F.slice(rel, n, 1)),
    ).otherwise(rel)
    segs = F.when(hp.startswith("/"), F.split(hp, "/")).otherwise(rel_clean)
    path = F.array_join(remove_dot_segments(segs), "/")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    merged = F.concat(prefix, bn, path, _suffix(hq, hf))
    same_doc = F.concat(prefix, bn, bp, _suffix(F.when(hq != "", hq).otherwise(bq), hf))
    with_netloc = F.concat(prefix, hn, hp, _suffix(hq, hf))
    foreign = (hs != "") & ((hs != bs) | ~hs.isin(*RELATIVE_SCHEMES))
    return (
        F.when(h.isNull() | b.isNull(), F.lit(None).cast("string"))
        .when(h == "", b)
        .when(foreign, h)
        .when(url_has_netloc(h) & (hn != ""), with_netloc)
        .when(hp == "", same_doc)
        .otherwise(merged)
    )


# Escapes of RFC 3986's unreserved characters, and the ports a scheme implies.
UNRESERVED_ESCAPE = r"^(?:2D|2E|5F|7E|3[0-9]|[46][1-9A-F]|[57][0-9A])"
DEFAULT_PORTS = {"http": "80", "https": "443"}


def normal_escapes(part) -> Column:
    """A URL part with blanks and non-ASCII characters escaped, escapes in upper case, and none of an unreserved character."""
    chars = F.split(F.regexp_replace(_col(part), " ", "%20"), "")
    ascii_only = F.array_join(F.transform(chars, lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.url_encode(c)).otherwise(c)), "")

    def one(p: Column, i: Column) -> Column:
        code = F.upper(F.substring(p, 1, 2))
        rest = F.substring(p, 3, 1 << 30)
        escaped = F.when(code.rlike(UNRESERVED_ESCAPE), F.concat(F.unhex(code).cast("string"), rest)).otherwise(F.concat(F.lit("%"), code, rest))
        return F.when(i == 0, p).when(p.rlike("^[0-9A-Fa-f]{2}"), escaped).otherwise(F.concat(F.lit("%"), p))

    return F.array_join(F.transform(F.split(ascii_only, "%"), one), "")


def request_key(url) -> Column:
    """The address as the request it makes: scheme and host in lower case, without the scheme's own port and the
    fragment, escapes normalised, query arguments sorted by name and value (``+`` is a blank, a name alone has an
    empty value, empty arguments go)."""

    def of(u: Column) -> Column:
        scheme, netloc = url_scheme(u), url_netloc(u)
        user = F.regexp_extract(netloc, r"^(?:[^@]*@)?", 0)
        host = F.lower(F.substr(netloc, F.length(user) + 1))
        for name, port in DEFAULT_PORTS.items():
            host = F.when(scheme == name, F.regexp_replace(host, f":(?:{port})?$", "")).otherwise(host)
        path = F.when(url_path(u) == "", F.lit("/")).otherwise(url_path(u))
        arguments = F.filter(F.split(F.replace(normal_escapes(url_query(u)), F.lit("%20"), F.lit("+")), "&"), lambda x: x != "")

        def named(x: Column) -> Column:
            name = F.regexp_extract(x, "^[^=]*", 0)
            return F.struct(name.alias("n"), F.substr(x, F.length(name) + 2).alias("v"))

        query = F.array_join(F.transform(F.sort_array(F.transform(arguments, named)), lambda x: F.concat(x["n"], F.lit("="), x["v"])), "&")
        front = F.when(url_has_netloc(u), F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), F.lit("//"), user, host)).when(
            scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit(""))
        return F.concat(front, normal_escapes(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))

    return F.element_at(F.transform(F.array(_col(url)), of), 1)


def route_content_type(url, content_type) -> Column:
    """P11: 'pdf' when the content type names application/pdf or the lowered
    url ends with '.pdf', else 'html'."""
    ct = F.lower(F.coalesce(_col(content_type), F.lit("")))
    is_pdf = ct.contains("application/pdf") | F.lower(_col(url)).endswith(".pdf")
    return F.when(is_pdf, F.lit("pdf")).otherwise(F.lit("html"))


def page_slug(url, kind) -> Column:
    """Path (without ``;params``) stripped of '/', '/' -> '_', plus '_' + query ('=' and '&' ->
    '_'); an empty path is 'root' for HTML and 'pdf_root' for PDF."""
    path = F.regexp_replace(F.regexp_replace(url_path(url), r";[^/]*$", ""), r"^/+|/+$", "")
    query = F.translate(url_query(url), "=&", "__")
    empty = F.when(_col(kind) == "pdf", F.lit("pdf_root")).otherwise(F.lit("root"))
    base = F.when(path == "", empty).otherwise(F.translate(path, "/", "_"))
    return F.when(query != "", F.concat(base, F.lit("_"), query)).otherwise(base)


def link_same_host(src, dst) -> Column:
    """the link's netloc equals the page's netloc."""
    return url_netloc(dst) == url_netloc(src)


def link_allowed_subpath(src, dst, subpaths: Sequence[str] = ("/",), start_urls: Sequence[str] = ()) -> Column:
    """the page is a start url, or the link path equals / starts with an allowed subpath."""
    p = url_path(dst)
    ok = F.lit(False)
    for s in subpaths:
        ok = ok | (p == s) | p.startswith(s)
    if start_urls:
        ok = ok | _col(src).isin(*start_urls)
    return ok


def link_not_self(src, dst) -> Column:
    """F3."""
    return _col(dst) != _col(src)


def link_allowed_domain(dst, domains: Sequence[str]) -> Column:
    """host equals a listed domain or is a subdomain of one."""
    host = url_hostname(dst)
    ok = F.lit(False)
    for d in domains:
        d = d.lower()
        ok = ok | (host == d) | host.endswith("." + d)
    return ok
