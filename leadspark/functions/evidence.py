"""Checks that what was extracted is really on the page, and whose it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark import constants as K
from leadspark.functions import text as T


# The same matches as EMAIL_RX: an address can only start where a run of its characters
# starts or where the match before ended, so other places are skipped.
_EMAIL_SCAN = r"(?:\G|(?<![A-Za-z0-9._%+-]))" + K.EMAIL_RX.replace("+@", "++@", 1)
# The same matches as PHONE_RX, with a cheap first look at the character.
_PHONE_SCAN = r"(?=[+\p{Nd}])" + K.PHONE_RX
_DIGITS_NEAR = r"\p{Nd}[^\p{L}]?\p{Nd}[^\p{L}]?\p{Nd}"


def words(col: Column) -> Column:
    return F.filter(F.split(F.lower(col), "[^a-z0-9]+"), lambda w: w != "")


def words_share(quoted: Column, page_words: Column) -> Column:
    """Share of ``quoted`` words, counted with repeats, that are among ``page_words``.

    One hash difference against the page leaves the words it lacks. Repeats are then
    counted against the smaller of lacking and found words, so a quote that is fully on
    the page costs no more than that one pass.
    """
    def share(s: Column) -> Column:
        within = lambda xs: F.size(F.filter(s["w"], lambda w: F.array_contains(xs, w)))
        few = F.size(s["lacking"]) * 2 <= F.size(F.array_distinct(s["w"]))
        hits = F.when(few, F.size(s["w"]) - within(s["lacking"])).otherwise(
            T.let(F.array_except(s["w"], s["lacking"]), within))
        return F.when(F.size(s["w"]) > 0, hits / F.size(s["w"]))

    return T.let(quoted, lambda w: T.let(
        F.struct(w.alias("w"), F.array_except(w, page_words).alias("lacking")), share))


def grounded_share(evidence: Column, content: Column) -> Column:
    return words_share(words(evidence), F.split(F.lower(content), "[^a-z0-9]+"))


def is_grounded(evidence: Column, content: Column) -> Column:
    return F.coalesce(grounded_share(evidence, content) >= K.GROUNDING_MIN_OVERLAP, F.lit(False))


def email_on_page(email: Column, content: Column) -> Column:
    """The address occurs in the text, as written or spelled out."""
    value = F.lower(T.strip(email))
    return F.coalesce((email != "") & (F.lower(content).contains(value) | T.compact(content).contains(value)),
                      F.lit(False))


def page_phone_keys(content: Column) -> Column:
    """Last ten digits of every phone-like run; texts without digits close together have none."""
    runs = F.transform(F.regexp_extract_all(content, F.lit(_PHONE_SCAN), F.lit(0)), T.digits)
    keys = F.transform(F.filter(runs, lambda d: F.length(d) >= 8), lambda d: F.right(d, F.lit(10)))
    return F.when(content.rlike(_DIGITS_NEAR), keys).otherwise(F.array().cast("array<string>"))


def phone_on_page(phone: Column, content: Column) -> Column:
    d = T.digits(F.coalesce(phone, F.lit("")))
    return F.coalesce((F.length(d) >= 8) & F.array_contains(page_phone_keys(content), F.right(d, F.lit(10))),
                      F.lit(False))


def thread_bodies(content: Column, name: Column) -> Column:
    """struct(own, others): the thread lines by this author and by everybody else."""
    who = F.lower(T.strip(F.coalesce(name, F.lit(""))))
    lines = F.arrays_zip(
        F.regexp_extract_all(content, F.lit(K.THREAD_LINE_RX), F.lit(1)).alias("a"),
        F.regexp_extract_all(content, F.lit(K.THREAD_LINE_RX), F.lit(2)).alias("b"))
    mine = lambda x, w: (w != "") & (F.lower(T.strip(x["a"])) == w)
    body = lambda xs, keep: F.array_join(F.transform(F.filter(xs, keep), lambda x: x["b"]), "\n")
    return T.let(F.struct(lines.alias("xs"), who.alias("w")), lambda s: F.struct(
        body(s["xs"], lambda x: mine(x, s["w"])).alias("own"),
        body(s["xs"], lambda x: ~mine(x, s["w"])).alias("others")))


def owned(value: Column, on_page, content: Column, own: Column, others: Column) -> Column:
    """On the page, and either in the person's own lines or in nobody else's."""
    present = (F.coalesce(value, F.lit("")) != "") & on_page(value, content)
    return present & (on_page(value, own) | ~on_page(value, others))


def looks_personal(title: Column, snippet: Column) -> Column:
    """The snippet is long enough and reads like a person's own post."""
    long_enough = F.length(F.coalesce(snippet, F.lit(""))) > K.MIN_SNIPPET_CHARS
    return long_enough & T.snippet_text(title, snippet).rlike(K.SIGNAL_RX)


MENTIONS = "array<struct<kind:string,value:string,start:int>>"


def _mentions(text: Column, kind: str, rx: str) -> Column:
    """array<struct(kind, value, start)> in text order; start is 0-based."""
    def place(s: Column) -> Column:
        # a match ends after all gaps and all matches up to and including itself
        ends = T.running_sum(F.zip_with(s["v"], s["g"], lambda v, g: F.length(v) + F.length(g)))
        return F.zip_with(s["v"], ends, lambda v, e: F.struct(
            F.lit(kind).alias("kind"), v.alias("value"), (e - F.length(v)).alias("start")))

    return T.let(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), lambda v: F.when(
        F.size(v) > 0, T.let(F.struct(v.alias("v"), F.slice(F.split(text, rx, -1), 1, F.size(v)).alias("g")), place)
    ).otherwise(F.array().cast(MENTIONS)))


def _first_values(found: Column) -> Column:
    return T.first_by(found, lambda m: F.lower(m["value"]))


def _phone_shaped(m: Column) -> Column:
    return T.let(T.digits(m["value"]), lambda d: F.length(d).between(9, 15) & (
        F.size(F.array_distinct(F.split(d, ""))) >= 4))


def email_mentions(text: Column) -> Column:
    found = _first_values(_mentions(text, "EMAIL", _EMAIL_SCAN))
    return F.when(text.contains("@"), found).otherwise(F.array().cast(MENTIONS))


def phone_mentions(text: Column) -> Column:
    found = _first_values(F.filter(_mentions(text, "PHONE", _PHONE_SCAN), _phone_shaped))
    return F.when(text.rlike(_DIGITS_NEAR), found).otherwise(F.array().cast(MENTIONS))


def mention_context(text: Column, m: Column) -> Column:
    start = F.greatest(m["start"] - K.CONTACT_BEFORE, F.lit(0))
    stop = m["start"] + F.length(m["value"]) + K.CONTACT_AFTER
    return T.collapse(F.substring(text, start + 1, stop - start))


def contact_mentions(text: Column) -> Column:
    """array<struct(kind, value, context)>: e-mails first, then phones, each value once."""
    found = F.concat(email_mentions(text), phone_mentions(text))
    return F.transform(found, lambda m: F.struct(
        m["kind"].alias("kind"), m["value"].alias("value"), mention_context(text, m).alias("context")))


def contact_lines(mentions: Column) -> Column:
    return F.array_join(F.transform(mentions, lambda m: F.concat(
        m["kind"], F.lit(" "), m["value"], F.lit(" — context: …"), m["context"], F.lit("…"))), "\n")
