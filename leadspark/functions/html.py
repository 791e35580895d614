"""HTML pages to text and author-attributed threads.

Tag soup needs a tokenizer, so this is the one page step that leaves the JVM: an
Arrow-batched map over (keys, html). Everything after the split into text nodes
(contacts, assembly, caps) is built from JVM expressions again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark import constants as K
from leadspark.functions import evidence as E
from leadspark.functions import text as T

_DROP = frozenset(K.DROP_TAGS)
_UNREAD = frozenset(["template", "rt", "rp"])   # their strings are not page text
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_AMPERSAND = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
_SIGN = "\ud800"     # stands for a plain ampersand; no text of a frame holds it

PAGE_PARTS = "title string, nodes string, thread array<struct<kind:string,author:string,body:string>>, parse_error string"
PIECE = 64           # pages that are Python objects at a time
_PART_TYPES = [pa.string(), pa.string(), pa.list_(pa.struct([(f, pa.string()) for f in ("kind", "author", "body")])), pa.string()]


class _Nodes(HTMLParser):
    """Collects text nodes the way a lenient tree would hold them.

    An end tag closes everything up to its nearest open namesake; an unclosed tag
    stays open until its parent closes, so an unclosed dropped tag hides what follows.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.pending: list[str] = []
        self.everywhere: list[str] = []
        self.in_body: list[str] | None = None
        self.body_depth = self.title_depth = 0
        self.title: list[str] | None = None
        self.scripts: list[str] = []
        self.data_script = False

    def _flush(self) -> None:
        text, self.pending = "".join(self.pending).replace(_SIGN, "&"), []
        if self.data_script:
            self.scripts.append(text)
            return
        text = text.strip()
        if not text or not _DROP.isdisjoint(self.open):
            return
        if self.title_depth:
            self.title.append(text)
        if _UNREAD.isdisjoint(self.open):
            self.everywhere.append(text)
            if self.body_depth:
                self.in_body.append(text)

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in _VOID:
            return
        self.open.append(tag)
        depth = len(self.open)
        if tag == "body" and self.in_body is None and _DROP.isdisjoint(self.open):
            self.in_body, self.body_depth = [], depth
        elif tag == "title" and self.title is None and _DROP.isdisjoint(self.open):
            self.title, self.title_depth = [], depth
        elif tag == "script":
            self.data_script = dict(attrs).get("type") == "application/ld+json"

    def handle_endtag(self, tag):
        self._flush()
        self.data_script = False
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if len(self.open) < self.body_depth:
            self.body_depth = 0
        if len(self.open) < self.title_depth:
            self.title_depth = 0

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[6:])
            self._flush()


def _objects(data) -> Iterator[dict]:
    """Every object of a JSON tree, parents before children, in document order."""
    stack = [data]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            yield node
            stack.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            stack.extend(reversed(node))


def _author(value) -> str:
    if isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, dict):
        value = value.get("name") or value.get("alternateName")
    return str(value or "").strip() or "unknown"


def _thread(scripts: list[str], key_chars: int | None) -> list[dict]:
    lines: dict[tuple[str, str], dict] = {}
    for script in scripts:
        try:
            data = json.loads(script)
        except (ValueError, RecursionError):
            continue
        for obj in _objects(data):
            body = obj.get("articleBody") or obj.get("text")
            body = " ".join(body.split()) if isinstance(body, str) else ""
            if body:
                kind = "COMMENT" if str(obj.get("@type")) in ("Comment", "Answer") else "POST"
                who = _author(obj.get("author"))
                lines.setdefault((who, body if key_chars is None else body[:key_chars]), {"kind": kind, "author": who, "body": body})
    return list(lines.values())


def _only_closed(html: str) -> str:
    """The page with a sign for every ampersand that does not begin a known reference closed by a semicolon."""
    return _AMPERSAND.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else _SIGN + (m[1] or ""), html)


def _parts(html: str | None, key_chars: int | None = K.THREAD_KEY_CHARS, closed_only: bool = False) -> tuple[str, str, list[dict], str | None]:
    """Title, text nodes, thread, and what went wrong: a page the tokenizer refuses must not end the job."""
    nodes = _Nodes()
    try:
        nodes.feed(_only_closed(html or "") if closed_only else html or "")
        nodes.close()
    except (AssertionError, ValueError, IndexError) as refused:
        return "", "", [], str(refused).replace(_SIGN, "&") or type(refused).__name__
    nodes._flush()
    text = nodes.everywhere if nodes.in_body is None else nodes.in_body
    return " ".join(nodes.title or []), "\n".join(text), _thread(nodes.scripts, key_chars), None


def _read(batches: Iterator[pa.RecordBatch], key_chars: int | None, closed_only: bool) -> Iterator[pa.RecordBatch]:
    """The parts of pages, which are the last column, a few pages at a time: memory does not grow with the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            piece = batch.slice(at, PIECE)
            columns = zip(*[_parts(h, key_chars, closed_only) for h in piece.column(piece.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *[pa.array(list(c), t) for c, t in zip(columns, _PART_TYPES)]],
                                             names=[*piece.schema.names[:-1], "title", "nodes", "thread", "parse_error"])


def page_parts(df: DataFrame, html: str = "html", keep: list[str] | None = None, key_chars: int | None = K.THREAD_KEY_CHARS,
               closed_only: bool = False) -> DataFrame:
    """``keep`` columns plus title, body text nodes (one per line), thread lines and parse_error (null for readable pages).

    Of thread lines by one author that agree in their first ``key_chars`` characters the first stays; None compares whole lines.
    A character reference without its semicolon (``&amp``) is read as browsers do; with ``closed_only`` it stays as written.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != html]

    slim = df.select(*keep, F.col(html).alias("__html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(partial(_read, key_chars=key_chars, closed_only=closed_only), f"{fields}, {PAGE_PARTS}" if fields else PAGE_PARTS)


def body_text(nodes: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(nodes, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def thread_text(thread: Column) -> Column:
    return F.array_join(F.transform(thread, lambda x: F.concat(
        x["kind"], F.lit(" by "), x["author"], F.lit(": "), x["body"])), "\n")


def render(title: Column, thread: Column, text: Column, contacts: Column, limit: int | None = None) -> Column:
    """The page document: title, thread, contacts, text; empty sections are left out. ``limit`` cuts it to so many characters."""
    section = lambda head, body: F.when(body != "", F.concat(F.lit(head), body))
    doc = F.concat_ws("\n\n", section("# ", title), section(K.THREAD_HEADING + " (structured, with authors)\n", thread),
                      section("## Contact details found on the page\n", contacts),
                      F.concat(F.lit("## Page text\n"), text))
    return T.strip(doc) if limit is None else F.substring(T.strip(doc), 1, limit)


def with_page_text(df: DataFrame, html: str = "html", keep: list[str] | None = None, out: str = "text", limit: int | None = None,
                   key_chars: int | None = K.THREAD_KEY_CHARS) -> DataFrame:
    """``keep`` columns plus title, thread (array), parse_error and the rendered page document, whole unless ``limit`` cuts it."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != html]
    d = page_parts(df, html, keep, key_chars).select(
        *keep, "title", "thread", "parse_error", thread_text(F.col("thread")).alias("_t"), body_text(F.col("nodes")).alias("_b"))
    d = d.withColumn("_m", E.contact_mentions(F.concat("_t", F.lit("\n"), "_b")))
    return d.select(*keep, "title", "thread", "parse_error", render(
        F.col("title"), F.col("_t"), F.col("_b"), E.contact_lines(F.col("_m")), limit).alias(out))


def thread_rows(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per thread line with its position."""
    return parts.select(*keys, F.posexplode("thread").alias("pos", "x")).select(
        *keys, "pos", "x.kind", "x.author", "x.body")


@F.udtf(returnType="pos int, kind string, author string, body string", useArrow=True)
class ThreadLines:
    """Table function over a page: its thread lines in order. ``key_chars`` as in ``page_parts``, null compares whole lines."""

    def eval(self, html: str, key_chars: int):
        for pos, line in enumerate(_parts(html, key_chars)[2]):
            yield pos, line["kind"], line["author"], line["body"]


def register(spark: SparkSession) -> None:
    """Make ``thread_lines(html, key_chars)`` known to SQL, for use in a lateral join."""
    spark.udtf.register("thread_lines", ThreadLines)


def title_fast(html: Column) -> Column:
    """Title without leaving the JVM, entities as written; for jobs that need nothing else."""
    return T.collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
