"""String and array normalisers, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark import constants as K


def let(value: Column, body) -> Column:
    """body(value) with the value computed once.

    A lambda re-evaluates outer expressions for every element; a lambda variable is
    a computed value, so binding one keeps array work linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BLANKS = " " * len(K.WS_CHARS)


def collapse(col: Column) -> Column:
    """One space for every run of white space, none at the ends.

    Single blanks, nearly all of them, are left alone by the pattern.
    """
    return F.btrim(F.regexp_replace(F.translate(col, K.WS_CHARS, _BLANKS), " {2,}", " "))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(K.WS_CHARS))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(K.WS_CHARS))


def clean_str(col: Column) -> Column:
    """Collapsed text; placeholders become null."""
    return let(collapse(col), lambda tidy: F.when(~F.lower(tidy).isin(K.PLACEHOLDERS), tidy))


def clean_list(arr: Column) -> Column:
    """Cleaned items, blanks dropped, first spelling of each kept in order; never null."""
    items = F.filter(F.transform(arr, clean_str), lambda x: x.isNotNull())
    return F.coalesce(first_spellings(items), F.array().cast("array<string>"))


def first_spellings(arr: Column) -> Column:
    """Drop later items that differ from an earlier one only in case."""
    return first_by(arr, F.lower)


def first_by(arr: Column, key) -> Column:
    """Keep the first item of each key, in order.

    Keys are sorted with their positions, the first of each run of equal keys stays, and the positions left are sorted
    back: no item looks through the others.
    """
    def firsts(s: Column) -> Column:
        new = lambda p, i: (i == 0) | ~F.get(s["p"], i - 1)["k"].eqNullSafe(p["k"])
        kept = F.array_sort(F.transform(F.filter(s["p"], new), lambda p: p["i"]))
        return F.transform(kept, lambda i: F.get(s["a"], i))

    return let(arr, lambda a: let(F.struct(a.alias("a"), F.array_sort(F.transform(
        a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))).alias("p")), firsts))


_PORTION = 64


def _appended(xs: Column) -> Column:
    return F.aggregate(xs, F.array().cast("array<int>"), lambda acc, n: F.array_append(
        acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n))


def running_sum(xs: Column) -> Column:
    """Sums of an array of ints up to and including each item.

    Appending copies what is there, so sums are made within portions of fixed size and over the portions, and then added: the work is
    that of a few dozen passes, not of the square of the length.
    """
    def whole(s: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1)), F.lit(_PORTION))
        return let(F.transform(starts, lambda i: _appended(F.slice(s, i, F.lit(_PORTION)))), shifted)

    def shifted(parts: Column) -> Column:
        before = let(F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0))), lambda t: F.concat(F.array(F.lit(0)), _appended(t)))
        return F.flatten(let(F.struct(parts.alias("p"), before.alias("b")), lambda x: F.transform(
            x["p"], lambda p, i: let(F.get(x["b"], i), lambda b: F.transform(p, lambda v: v + b)))))

    return let(xs, lambda s: F.when(F.size(s) <= _PORTION, _appended(s)).otherwise(whole(s)))


def occurrence(arr: Column) -> Column:
    """For each item how often it has occurred up to there, itself included: 1, 2, ...

    Items are sorted with their positions; each run of equal ones is numbered, and the numbers are sorted back.
    """
    def numbered(s: Column) -> Column:
        last = F.size(s["p"])
        starts = F.filter(F.sequence(F.lit(0), last - 1), lambda j: (j == 0) | ~F.get(s["p"], j - 1)["x"].eqNullSafe(F.get(s["p"], j)["x"]))
        counts = let(F.struct(starts.alias("a"), last.alias("n")), lambda t: F.flatten(F.transform(
            t["a"], lambda a, k: F.sequence(F.lit(1), F.coalesce(F.get(t["a"], k + 1), t["n"]) - a))))
        return F.transform(F.array_sort(F.zip_with(s["p"], counts, lambda p, c: F.struct(p["i"].alias("i"), c.alias("c")))), lambda y: y["c"])

    pairs = F.array_sort(F.transform(arr, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.when(F.size(arr) > 0, let(F.struct(pairs.alias("p")), numbered)).otherwise(F.array().cast("array<int>"))


def digits(col: Column) -> Column:
    return F.regexp_replace(col, r"[^\p{Nd}]", "")


def clean_email(col: Column) -> Column:
    bare = F.regexp_replace(F.btrim(clean_str(col), F.lit(K.EMAIL_TRIM_CHARS)), "^mailto:", "")
    return let(bare, lambda b: F.when(b.rlike("^" + K.EMAIL_RX + "$"), F.lower(b)))


def clean_phone(col: Column) -> Column:
    def kept(s: Column) -> Column:
        plus = F.when(F.regexp_extract(s["v"], r"\+?\p{Nd}", 0).startswith("+"), "+").otherwise("")
        return F.when(F.length(s["d"]).between(8, 15), F.concat(plus, s["d"]))

    return let(clean_str(col), lambda v: let(F.struct(v.alias("v"), digits(v).alias("d")), kept))


def cap_evidence(col: Column) -> Column:
    return let(clean_str(col), lambda v: F.when(F.length(v) > K.MAX_EVIDENCE_CHARS, F.concat(
        rstrip(F.substring(v, 1, K.MAX_EVIDENCE_CHARS - 1)), F.lit("…"))).otherwise(v))


def absolute_url(col: Column) -> Column:
    """Trimmed URL, null unless it is an absolute http(s) one."""
    value = strip(col)
    return F.when(value.rlike("^https?://"), value)


def name_key(col: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z]+", " "))


def phone_key(col: Column) -> Column:
    d = digits(F.coalesce(col, F.lit("")))
    return F.when(F.length(d) >= 8, F.right(d, F.lit(10))).otherwise("")


def place_head(col: Column) -> Column:
    return strip(F.substring_index(F.lower(col), ",", 1))


def places_agree(a: Column, b: Column) -> Column:
    """Unknown on a side, or the first part of one place occurs in the other."""
    unknown = lambda c: F.coalesce(c, F.lit("")) == ""
    return unknown(a) | unknown(b) | F.lower(b).contains(place_head(a)) | F.lower(a).contains(place_head(b))


def slug(col: Column) -> Column:
    dashed = F.btrim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    short = F.substring(dashed, 1, K.MAX_SLUG_CHARS)
    return F.when(short == "", "person").otherwise(short)


def _spelled(word: str) -> str:
    edge = r"[\p{L}\p{N}_]"
    # the look-ahead only lets the search skip places where nothing can start
    return rf"(?=[{word[0]}\[({{])(?:\[{word}\]|\({word}\)|\{{{word}\}}|(?<!{edge}){word}(?!{edge}))"


def compact(col: Column) -> Column:
    """Lower case, spelled-out "at" / "dot" as signs, no white space at all.

    White space around the words needs no pattern of its own: it is removed in the end.
    """
    signs = F.regexp_replace(F.regexp_replace(F.lower(col), _spelled("at"), "@"), _spelled("dot"), ".")
    return F.translate(signs, K.WS_CHARS, "")


def clean_markdown(col: Column) -> Column:
    """Images out, links to their text, blanks collapsed, capped."""
    out = F.regexp_replace(col, r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\((?:https?:)?[^)]*\)", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.substring(strip(out), 1, K.MAX_PAGE_CHARS)


def draft_text(col: Column) -> Column:
    return F.substring(collapse(F.coalesce(col, F.lit(""))), 1, K.MAX_MESSAGE_CHARS)


def snippet_text(title: Column, snippet: Column) -> Column:
    """The search hit as page content, for pages that could not be opened."""
    blank = F.lit("")
    return strip(F.concat(F.lit("Title: "), F.coalesce(title, blank),
                          F.lit("\nSnippet: "), F.coalesce(snippet, blank)))


def extraction_prompt(intent: Column, url: Column, platform: Column, content: Column,
                      snippet_only: Column, legacy: bool = False) -> Column:
    """Request text for one page, to be answered by a model outside this engine."""
    heading = (K.PROMPT_HEADING_LEGACY if legacy else K.PROMPT_HEADING) + "\n"
    limit = K.MAX_PROMPT_CHARS_LEGACY if legacy else K.MAX_PROMPT_CHARS
    return F.concat(F.lit("Sourcing intent: "), strip(intent), F.lit("\nPage URL: "), url,
                    F.lit("\nPlatform: "), platform, F.lit("\n\n"),
                    F.when(snippet_only, K.SNIPPET_NOTE + "\n\n").otherwise(""), F.lit(heading),
                    F.substring(content, 1, limit), F.lit("\n" + K.PROMPT_END))


def wave_tag(wave_no: Column, platform: Column) -> Column:
    return F.concat(F.lit("W"), wave_no.cast("string"), F.lit(":"), platform)


def reason_key(error: Column) -> Column:
    return F.when(error == K.ROBOTS_ERROR, error).otherwise(
        F.substring(F.substring_index(error, ";", 1), 1, K.MAX_REASON_CHARS))


def join_list(arr: Column) -> Column:
    return F.concat_ws("; ", arr)


def split_list(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), strip)
    return F.filter(parts, lambda x: x != "")
