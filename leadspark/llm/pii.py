"""Personal data: fixed patterns first, then identifiers found through the contexts they share.

Base spans (e-mail, IP address, card, phone) come from fixed patterns. Every base entity is a seed. What stands around a seed
(the words before it, or the word before and the word after) is a lexical pattern. The same patterns are read around every other
token that looks like an identifier. Patterns and instances form a graph; Spark scores it in rounds: a pattern is as good as the instances in its
slot, weighed down while few seeds support it, and an instance is as good as its best pattern. Instances that end above
``ACCEPT`` in a pattern above ``ACCEPT`` become further spans of the pattern's kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import stored, whole_text

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 5         # different seeds that a pattern needs
ACCEPT = 0.9
PRIOR = 0.25        # how much a pattern with few seeds is weighed down

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")      # a start inside a run of digits fails where the run's own start fails
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
#: What may be an identifier of a kind not seen yet: one token, at least six characters, three digits.
_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9@._+/-]{4,62}[A-Za-z0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_NEAR = 60          # characters read on each side of a slot for its words


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans, in order."""
    if not _ANY.search(text):
        return []
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 14 <= len(m[0]) and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a slot."""
    before = [w.lower() for w in _WORD.findall(text[max(0, start - _NEAR):start])][-2:]
    after = _WORD.search(text, end, end + _NEAR)
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0].lower()}")
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_SLOTS = "array<struct<start:int,end:int,kind:int,instance:string,patterns:array<string>>>"
_SLOT_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow mapper from (row, doc_id, text) to counts, base spans, and the slots: seeds (kind 0 to 3) and other identifiers (kind -1)."""
    for batch in batches:
        counts: list[list[int]] = [[] for _ in KINDS]
        bases, digests, slots = [], [], []
        for text in batch.column(2):
            text = text.as_py()
            spans = base_spans(text)
            own = [{"start": s, "end": e, "kind": k, "instance": text[s:e].lower(), "patterns": contexts(text, s, e)} for s, k, e in spans]
            if _ANY.search(text):
                starts, ends = [s for s, _, _ in spans], []
                for _, _, e in spans:
                    ends.append(max(e, ends[-1] if ends else 0))
                for m in _TOKEN.finditer(text):
                    if sum(c.isdigit() for c in m[0]) < 3:
                        continue
                    i = bisect_right(starts, m.end() - 1)
                    if i and ends[i - 1] > m.start():
                        continue
                    own.append({"start": m.start(), "end": m.end(), "kind": -1, "instance": m[0].lower(), "patterns": contexts(text, m.start(), m.end())})
            for k, column in enumerate(counts):
                column.append(sum(x[1] == k for x in spans))
            base = written(spans)
            bases.append(base)
            digests.append(hashlib.sha256(base.encode()).hexdigest())
            slots.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in counts], pa.array(bases, pa.string()), pa.array(digests, pa.string()), pa.array(slots, _SLOT_TYPE)],
            ["row", "doc_id", *[f"n_{k}" for k in KINDS], "base", "base_sha256", "slots"])


def read(docs: DataFrame) -> DataFrame:
    """Base findings and slots of each row, stored."""
    schema = "row long, doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + f", base string, base_sha256 string, slots {_SLOTS}"
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole_text().alias("text")).mapInArrow(_read, schema))


def discover(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """(pattern, kind, instance): the occurrences that count as identifiers of a kind, by scoring the pattern-instance graph.

    Edges are counted once for each different (pattern, instance), so copies of a document add nothing.
    """
    edges = found.select(F.explode("slots").alias("s")).select("s.kind", "s.instance", F.explode("s.patterns").alias("pattern")).distinct()
    seeds = edges.filter("kind >= 0")
    # A pattern belongs to the kind that most of its seeds have.
    kinds = seeds.groupBy("pattern", "kind").agg(F.count("*").alias("n")).groupBy("pattern").agg(
        F.max(F.struct("n", (-F.col("kind")).alias("k"))).alias("top"))
    induced = kinds.filter(F.col("top.n") >= support).select("pattern", (-F.col("top.k")).alias("of"), F.col("top.n").alias("n_seeds"))
    graph = stored(edges.join(induced, "pattern").withColumn("seed", F.col("kind") == F.col("of")).select("pattern", "of", "n_seeds", "instance", "seed"))
    scores = graph.groupBy("instance", "of").agg(F.max(F.col("seed").cast("double")).alias("score"))
    patterns = None
    for _ in range(rounds):
        patterns = stored(graph.join(scores, ["instance", "of"]).groupBy("pattern", "of").agg(
            (F.avg("score") * F.first("n_seeds") / (F.first("n_seeds") + PRIOR)).alias("good")))
        best = graph.join(patterns, ["pattern", "of"]).groupBy("instance", "of").agg(F.max("seed").alias("seed"), F.max("good").alias("good"))
        scores = stored(best.select("instance", "of", F.when(F.col("seed"), 1.0).otherwise(F.col("good")).alias("score")))
    return (graph.filter("NOT seed").join(patterns.filter(F.col("good") >= accept), ["pattern", "of"])
            .join(scores.filter(F.col("score") >= accept), ["instance", "of"]).select("pattern", F.col("of").alias("kind"), "instance").distinct())


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    A null text counts as empty: no spans and the digest of the empty string. Repeated rows and null ids keep their own rows.
    Offsets are in code points, ends exclusive. Other columns are not read. An empty table gives an empty result.
    """
    found = read(docs)
    accepted = discover(found)
    slots = found.select("row", F.explode("slots").alias("s")).filter("s.kind < 0").select(
        "row", "s.start", "s.end", "s.instance", F.explode("s.patterns").alias("pattern"))
    names = F.array(*[F.lit(k) for k in KINDS])
    extra = slots.join(accepted, ["pattern", "instance"]).groupBy("row", "start", "end").agg(F.min("kind").alias("kind")).groupBy("row").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("extra"))
    base = F.transform(F.filter(F.col("slots"), lambda s: s["kind"] >= 0), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    every = F.array_sort(F.concat(base, F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    return found.join(extra, "row", "left").select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"))
