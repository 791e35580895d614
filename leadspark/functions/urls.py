"""URL functions: parsing, canonical form, host tags.

The canonical form is built as a chain of projections rather than one nested
expression. Each projection names an intermediate part once, so Catalyst keeps
them as separate Projects inside one whole-stage-codegen span and no regex is
evaluated twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark import constants as K

# scheme, authority, path, query of any reference (RFC 3986, appendix B)
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_SAFE_PATH = r"^[A-Za-z0-9_.~/:@!$&'()*+,;=\-]*$"
# Form-encoding escapes that a quoted path writes literally; the last one is the
# percent sign itself and has to be undone after all others.
_PATH_LITERALS = [("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%21", "!"), ("%24", "$"), ("%26", "&"),
                  ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2B", "+"), ("%2C", ","), ("%3B", ";"),
                  ("%3D", "="), ("%7E", "~"), ("%25", "%")]


def _any(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def _swap(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def percent_decode(col: Column, plus_is_space: bool = False) -> Column:
    """Decode %XX escapes; a malformed escape stays as it is."""
    kept = F.regexp_replace(col, "%(?![0-9A-Fa-f]{2})", "%25")
    if not plus_is_space:
        kept = _swap(kept, "+", "%2B")
    return F.when(col.rlike("[%+]"), F.try_url_decode(kept)).otherwise(col)


def quote_path(col: Column) -> Column:
    """Decode, then percent-encode everything a path may not hold literally."""
    encoded = _swap(F.url_encode(percent_decode(col)), "+", "%20")
    for old, new in _PATH_LITERALS:
        encoded = _swap(encoded, old, new)
    return F.when(col.rlike(_SAFE_PATH), col).otherwise(encoded)


def quote_form(col: Column) -> Column:
    """Form-encode one query key or value."""
    return F.when(col.rlike(r"^[A-Za-z0-9_.\-]*$"), col).otherwise(
        _swap(_swap(F.url_encode(col), "*", "%2A"), "%7E", "~"))


def query_pairs(query: Column) -> Column:
    """Decoded (k, v) structs of a query string; pairs without a value are left out."""
    raw = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    return F.transform(raw, lambda p: F.struct(
        percent_decode(F.substring_index(p, "=", 1), True).alias("k"),
        percent_decode(F.substr(p, F.locate("=", p) + 1), True).alias("v")))


def _pair_value(pairs: Column, key: str) -> Column:
    """Value of the last pair with this key."""
    return F.get(F.reverse(F.filter(pairs, lambda p: p["k"] == key)), F.lit(0))["v"]


def netloc(url: Column) -> Column:
    """Authority part as written, lower-cased (keeps port and user info)."""
    return F.lower(F.regexp_extract(url, _SPLIT, 2))


def url_path(url: Column) -> Column:
    """Path without the parameters (;...) of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _SPLIT, 3), r";[^/]*$", "")


def host(url: Column) -> Column:
    """Host, lower-cased, without user info or port; empty when there is none."""
    return _host_of(F.regexp_extract(url, _SPLIT, 2))


def _host_of(authority: Column) -> Column:
    plain = F.regexp_extract(authority, r"^(?:.*@)?([^:@\[]*)", 1)
    bracketed = F.regexp_extract(authority, r"\[([^\]]*)\]", 1)
    return F.lower(F.when(authority.contains("["), bracketed).otherwise(plain))


def _bracketed_address(authority: Column) -> Column:
    """Whether the authority is [an IPv6 address] with nothing but user info before it and a port behind it."""
    inner = F.regexp_extract(authority, r"^(?:[^\[\]]*@)?\[([^\[\]]*)\](?::[^\[\]]*)?$", 1)
    part = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    groups = F.regexp_replace(F.regexp_replace(inner, "%[^%]+$", ""), rf"(?<=:){part}(?:\.{part}){{3}}$", "0:0")
    full = groups.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
    short = groups.rlike("^(?!.*::.*::)(?!:[^:])(?=.*::)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$") & ~groups.rlike("[^:]:$")
    return full | short | inner.rlike("^v[0-9A-Fa-f]+\\..+$")


def origin(url: Column) -> Column:
    """scheme://authority, the key of a robots table."""
    return F.concat(F.lower(F.regexp_extract(url, _SPLIT, 1)), F.lit("://"), F.regexp_extract(url, _SPLIT, 2))


def is_useful(url: Column) -> Column:
    low = F.lower(url)
    junk_file = url_path(low).rlike(r"\.(?:" + "|".join(K.JUNK_EXTENSIONS) + ")$")
    return ~_any([low.contains(s) for s in K.JUNK_SUBSTRINGS] + [junk_file])


def platform(url: Column, host_col: Column | None = None) -> Column:
    """Coarse source tag; the order of the table is its priority.

    Pass an already projected ``host_col`` on big inputs, so the host is cut out once.
    """
    h, low = host(url) if host_col is None else host_col, F.lower(url)
    tag = F
    for needle, name in K.PLATFORM_NEEDLES:
        tag = tag.when(h.contains(needle), F.lit(name))
    tag = tag.when(h.contains("forum") | low.contains("/forum") | low.contains("/thread"), F.lit("forum"))
    bare = F.regexp_replace(h, r"^www\.", "")
    return tag.when(bare != "", bare).otherwise(F.lit("web"))


def is_strict(url: Column, host_col: Column | None = None) -> Column:
    h = host(url) if host_col is None else host_col
    return _any([h.contains(s) for s in K.STRICT_HOST_NEEDLES])


def is_wall_url(url: Column) -> Column:
    return url_path(url).rlike(K.WALL_PATH_RX)


def _tidy(url: Column) -> Column:
    """Outer white space and control characters go, as do inner tabs and line ends."""
    outer = F.regexp_replace(url, rf"^[\x00-\x20{K.WS}]+|[{K.WS}]+$", "")
    return F.regexp_replace(outer, r"[\t\r\n]", "")


def with_canonical_url(df: DataFrame, src: str, out: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Add column ``out``: the canonical form of ``src``, null when it is not an http(s) URL.

    Apply it once: a second pass would decode one more level of %25 escapes.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != out]
    base = [F.col(c) for c in keep]

    def step(d: DataFrame, carry: list[str], **named: Column) -> DataFrame:
        return d.select(*base, *carry, *[c.alias(n) for n, c in named.items()])

    # 1. unwrap one level of search-engine redirect
    d = step(df, [], _u=_tidy(F.col(src)))
    u = F.col("_u")
    d = step(d, ["_u"], _a=netloc(u), _p=F.regexp_extract(u, _SPLIT, 3),
             _qp=F.when(netloc(u).rlike(r"(?:duckduckgo|google)\.com$"),
                        query_pairs(F.regexp_extract(u, _SPLIT, 4))))
    a, p, qp = F.col("_a"), F.col("_p"), F.col("_qp")
    target = F.coalesce(
        F.when(a.endswith("duckduckgo.com") & p.startswith("/l/"), percent_decode(_pair_value(qp, "uddg"))),
        F.when(a.endswith("google.com") & (p == "/url"),
               F.coalesce(_pair_value(qp, "q"), _pair_value(qp, "url"))))
    d = step(d, [], _u=F.coalesce(_tidy(target), u))

    # 2. split
    d = step(d, [], _s=F.lower(F.regexp_extract(u, _SPLIT, 1)), _a=F.regexp_extract(u, _SPLIT, 2),
             _p=F.regexp_extract(u, _SPLIT, 3), _q=F.regexp_extract(u, _SPLIT, 4))
    s, q = F.col("_s"), F.col("_q")
    port_text = F.when(a.contains("["), F.regexp_extract(a, r"\][^:]*:(.*)$", 1)).otherwise(
        F.regexp_extract(a, r"^(?:.*@)?[^:]*:(.*)$", 1))
    d = step(d, ["_s"], _h=F.regexp_replace(_host_of(a), r"\.+$", ""), _port=port_text,
             _bad=(a.contains("[") | a.contains("]")) & ~_bracketed_address(a),
             # parameters of the last segment go; slashes are collapsed, then trimmed
             _p=F.regexp_replace(F.regexp_replace(p, r";[^/]*$", ""), "/{2,}", "/"),
             _qp=F.when(q.contains("="), query_pairs(q)))

    # 3. normalise each part
    h, port = F.col("_h"), F.col("_port")
    dots = F.length(h) - F.length(_swap(h, ".", ""))
    new_host = (F.when(h.endswith("linkedin.com"), "www.linkedin.com")
                .when(h.endswith("reddit.com"), "www.reddit.com")
                .when(h.endswith("quora.com") & (dots == 1), "www.quora.com")
                .when(h.startswith("m.") & (dots >= 2), F.concat(F.lit("www."), F.substr(h, F.lit(3))))
                .otherwise(h))
    tracked = lambda k: F.lower(k).isin(K.TRACKING_PARAMS) | _any(
        [F.lower(k).startswith(x) for x in K.TRACKING_PREFIXES])
    d = step(d, ["_s", "_port"], _h=new_host,
             _ok=s.isin("http", "https") & (h != "") & ~F.col("_bad")
             & ((port == "") | (port.rlike("^[0-9]+$") & (F.try_to_number(port, F.lit("9" * 38)) <= 65535))),
             _p=quote_path(F.when(p == "", "/").when(F.length(p) > 1, F.rtrim(p, F.lit("/"))).otherwise(p)),
             _q=F.array_join(F.transform(
                 F.array_sort(F.filter(qp, lambda x: ~tracked(x["k"]))),
                 lambda x: F.concat(quote_form(x["k"]), F.lit("="), quote_form(x["v"]))), "&"))

    # 4. put together
    number = F.try_to_number(port, F.lit("9" * 38)).cast("int")
    whole = F.when(F.col("_ok"), F.concat(
        F.when(_any([h.endswith(x) for x in K.HTTPS_ONLY_HOSTS]), "https").otherwise(s), F.lit("://"), h,
        F.when((port == "") | number.isin(80, 443), "").otherwise(F.concat(F.lit(":"), number.cast("string"))),
        p, F.when(F.coalesce(q, F.lit("")) == "", "").otherwise(F.concat(F.lit("?"), q))))
    return d.select(*base, F.explode(F.array(whole)).alias(out))
