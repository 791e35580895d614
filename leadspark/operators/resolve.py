"""Which records are the same person.

Records come in batches of a few pages. Inside a batch rows are folded in order: a row joins the first earlier person it
matches and fills that person's blanks, else it starts a new person. The outcome depends on the order, so the fold is
sequential inside a batch; batches are small and independent, and are folded side by side in one Arrow-batched pass over rows
sorted by batch. Afterwards the persons of a batch meet stored rows and the persons of earlier batches by equi-joins on
pre-aggregated keys: e-mail, phone, and name with place. A later batch's value wins over an earlier one.

No step looks at the size of a group to choose its way.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadspark.functions import text as T
from leadspark.operators.keyed import cut, spread
from leadspark.schemas import LIST_FIELDS, RECORD_FIELDS

MATCH = ["m", "named", "loc", "e", "p"]


# --- matching fields ---------------------------------------------------------------
def match_fields(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Keys used for matching; '' where there is none. ``m`` only holds names of two words or more."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = T.name_key(F.col("name"))
    return rows.select(*keep, F.when(key.contains(" "), key).otherwise("").alias("m"), (text("name") != "").alias("named"),
                       F.lower(text("current_location")).alias("loc"), F.lower(text("email")).alias("e"),
                       T.phone_key(F.col("phone")).alias("p"))


def same_person(a: str, b: str) -> Column:
    """Condition over two aliased rows with matching fields."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    apart = lambda f: (x(f) != "") & (y(f) != "") & (x(f) != y(f))
    equal = lambda f: (x(f) != "") & (x(f) == y(f))
    return equal("e") | equal("p") | (
        equal("m") & ~apart("e") & ~apart("p") & T.places_agree(x("loc"), y("loc")))


def _keys(e: Column, p: Column, m: Column) -> Column:
    tagged = lambda tag, c: F.when(c != "", F.concat(F.lit(tag), c))
    return F.filter(F.array(tagged("e:", e), tagged("p:", p), tagged("m:", m)), lambda k: k.isNotNull())


# --- linked groups -----------------------------------------------------------------
def linked_groups(edges: DataFrame) -> DataFrame:
    """(id, component) from (id, key): ids that share keys, directly or through others.

    A key stands for the smallest of its ids, and an id links the smallest ids of its keys. Only these links, without repeats, go
    through the rounds: many ids with the same keys make one link, and an id whose keys agree makes none.

    In the rounds every id starts with its own number. Each round a key takes the smallest label of its
    ids, an id the smallest of its keys, and then the label of that label (which halves
    long chains). Labels only shrink, so an unchanged sum means that nothing moved. Frequent keys are
    pre-aggregated on one side of each join and split by adaptive execution on the other.
    """
    edges = edges.select("id", "key")
    first = edges.groupBy("key").agg(F.min("id").alias("first"))
    links = cut(edges.join(first, "key").select("id", "first"))
    own = cut(links.groupBy("id").agg(F.min("first").alias("root")))
    apart = cut(links.join(own, "id").filter("first <> root").select("first", "root").distinct())
    linked = apart.select(F.col("first").alias("id"), F.col("root").alias("key")).unionByName(
        apart.select(F.col("root").alias("id"), F.col("root").alias("key")).distinct())
    roots = _labels(linked).withColumnRenamed("id", "root")
    return own.join(roots, "root", "left").select("id", F.coalesce("component", "root").alias("component"))


def _labels(edges: DataFrame) -> DataFrame:
    """The rounds of ``linked_groups``."""
    edges = cut(edges)
    labels = cut(edges.select("id").distinct().withColumn("component", F.col("id")))
    checksum = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    while True:
        low = edges.join(labels, "id").groupBy("key").agg(F.min("component").alias("component"))
        per_id = cut(edges.join(low, "key").groupBy("id").agg(F.min("component").alias("step")))
        jump = per_id.select(F.col("id").alias("step"), F.col("step").alias("component"))
        labels = cut(per_id.join(jump, "step", "left").select("id", F.least("step", "component").alias("component")))
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == checksum:
            return labels
        checksum = now


# --- the ordered fold ----------------------------------------------------------------
def _head(place: str) -> str:
    return place.split(",")[0].strip()


def _grams(place: str) -> set[str]:
    """All pieces of one to three characters, and the empty one."""
    return {place[i:i + n] for n in (1, 2, 3) for i in range(len(place) - n + 1)} | {""}


class _Places:
    """Places seen under one name, found by the rule that the head of one lies inside the other."""

    def __init__(self) -> None:
        self.seen: set[str] = set()
        self.by_head: dict[str, list[str]] = {}
        self.lengths: set[int] = set()
        self.by_gram: dict[str, list[str]] = {}

    def add(self, place: str) -> None:
        if place and place not in self.seen:
            self.seen.add(place)
            head = _head(place)
            self.by_head.setdefault(head, []).append(place)
            self.lengths.add(len(head))
            for gram in _grams(place):
                self.by_gram.setdefault(gram, []).append(place)

    def agreeing(self, place: str) -> set[str]:
        inner = {place[i:i + n] for n in self.lengths for i in range(len(place) - n + 1)}
        found = {other for piece in inner if piece in self.by_head for other in self.by_head[piece]}
        head = _head(place)
        # The rarest piece of the head that is indexed leads to all places that can hold the head.
        pieces = [head[i:i + 3] for i in range(max(1, len(head) - 2))]
        rarest = min((self.by_gram.get(g, []) for g in pieces), key=len)
        return found | {other for other in rarest if head in other}


class _Persons:
    """Persons found so far in one batch, indexed for first-match lookups.

    A person is known by the number of its first row, so the smallest number is the first. Heaps may hold a
    person under former fields; such entries are dropped when they come up.
    """

    def __init__(self) -> None:
        self.state: dict[int, list] = {}
        self.by_contact: dict[tuple[str, str], int] = {}
        self.by_name: dict[tuple, list[int]] = {}
        self.places: dict[str, _Places] = {}

    def put(self, who: int, m: str, named: bool, loc: str, e: str, p: str) -> None:
        self.state[who] = [m, named, loc, e, p]
        for key in (("e", e), ("p", p)):
            if key[1]:
                self.by_contact[key] = min(who, self.by_contact.get(key, who))
        if m:
            self.places.setdefault(m, _Places()).add(loc)
            for place in (loc, None):       # None: whatever the place
                heapq.heappush(self.by_name.setdefault((m, place, not e, not p), []), who)

    def _first(self, m: str, place: str | None, no_mail: bool, no_phone: bool) -> int | None:
        heap = self.by_name.get((m, place, no_mail, no_phone), [])
        while heap:
            name, _, loc, e, p = self.state[heap[0]]
            if name == m and place in (None, loc) and (not e, not p) == (no_mail, no_phone):
                return heap[0]
            heapq.heappop(heap)
        return None

    def _named(self, m: str, loc: str, e: str, p: str) -> list[int]:
        if m not in self.places:
            return []
        places = {"", *self.places[m].agreeing(loc)} if loc else [None]
        # Equal contacts are looked up elsewhere: where the row has a contact the person must have none.
        kinds = [(a, b) for a in (True, False) for b in (True, False) if (a or not e) and (b or not p)]
        return [w for place in places for kind in kinds if (w := self._first(m, place, *kind)) is not None]

    def fold(self, seq: int, m: str, named: bool, loc: str, e: str, p: str) -> int:
        found = [w for key in (("e", e), ("p", p)) if key[1] and (w := self.by_contact.get(key)) is not None]
        found += self._named(m, loc, e, p) if m else []
        if not found:
            self.put(seq, m, named, loc, e, p)
            return seq
        who = min(found)
        old = self.state[who]
        new = [old[0] if old[1] else m, old[1] or named, old[2] or loc, old[3] or e, old[4] or p]
        if new != old:
            self.put(who, *new)
        return who


def _fold_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(seq, leader) for rows that arrive batch by batch, each in order; one batch is open at a time."""
    persons = _Persons()
    for frame in frames:
        out = []
        for nth, seq, *fields in zip(*[frame[c].tolist() for c in ["nth", "seq", *MATCH]]):
            if nth == 1:
                persons = _Persons()
            out.append((seq, persons.fold(seq, *fields)))
        yield pd.DataFrame(out, columns=["seq", "leader"])


def leaders(rows: DataFrame) -> DataFrame:
    """(seq, leader): the first row, within its batch, of the person each row belongs to.

    ``rows`` holds unique numbers ``seq`` that give the order, and ``batch``. The row number is there for its requirement: a window
    makes Spark guarantee that a batch is whole in one partition and in order, also after adaptive re-planning. The fold works much
    on few bytes, so the batches are dealt over all tasks.
    """
    nth = F.row_number().over(W.partitionBy("batch").orderBy("seq"))
    return match_fields(spread(rows, "batch"), ["seq", "batch"]).withColumn("nth", nth).select("nth", "seq", *MATCH).mapInPandas(
        _fold_batches, "seq long, leader long")


# --- merging -----------------------------------------------------------------------
def merged(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row per person: first filled value of each field, lists united in order.

    ``seq`` and ``source_url`` are those of the first row. Scalars use min_by, lists are
    united item by item, so even a person with very many rows is pre-aggregated.
    """
    d = rows.join(assigned, "seq")
    scalars = [f for f in RECORD_FIELDS if f not in LIST_FIELDS and f != "source_url"]
    first = lambda f: F.min_by(F.col(f), F.when(F.coalesce(f, F.lit("")) != "", F.col("seq")))
    out = d.groupBy("leader").agg(
        F.count("*").alias("n_rows"), F.min_by("source_url", "seq").alias("source_url"),
        *[first(f).alias(f) for f in scalars])
    items = d.select("leader", "seq", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("vs")) for f in LIST_FIELDS])).alias("x")).select(
        "leader", "seq", "x.field", F.posexplode("x.vs").alias("pos", "item"))
    once = items.groupBy("leader", "field", "item").agg(F.min(F.struct("seq", "pos")).alias("at"))
    ordered = lambda f: F.transform(F.array_sort(F.collect_list(
        F.when(F.col("field") == f, F.struct("at", "item")))), lambda x: x["item"]).alias(f)
    lists = once.groupBy("leader").agg(*[ordered(f) for f in LIST_FIELDS])
    empty = F.array().cast("array<string>")
    return out.join(lists, "leader", "left").select(
        F.col("leader").alias("seq"), "n_rows",
        *[(F.coalesce(f, empty) if f in LIST_FIELDS else F.col(f)).alias(f) for f in RECORD_FIELDS])


# --- stored rows -------------------------------------------------------------------
def stored_lookup(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows that share a name, e-mail or phone key with any incoming row: one semi-join over tagged keys."""
    cols = ["name", "current_location", "email", "phone", "source_url"]

    def tagged(d: DataFrame, keep: list[str]) -> DataFrame:
        fields = match_fields(d, list(dict.fromkeys([*keep, "name"]))).withColumn("k", T.name_key(F.col("name")))
        return fields.select(*keep, F.explode(_keys(F.col("e"), F.col("p"), F.col("k"))).alias("key"))

    wanted = tagged(rows, []).distinct()
    return tagged(stored, cols).join(wanted, "key", "left_semi").drop("key").dropDuplicates(["source_url"])


def first_matches(new: DataFrame, old: DataFrame) -> DataFrame:
    """(seq, src): for each row of ``new`` (seq and matching fields) the smallest ``src`` of the rows of ``old`` that are the same person."""
    found = _by_name(new, old)
    for key in ("e", "p"):
        first = old.filter(F.col(key) != "").groupBy(key).agg(F.min("src").alias("src"))
        found = found.unionByName(new.filter(F.col(key) != "").join(first, key).select("seq", "src"))
    return found.groupBy("seq").agg(F.min("src").alias("src"))


def _with_starts(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``rows`` (m, loc) once for each ``key`` of ``heads`` (m, key) of the same name that lies inside the place.

    A key has three characters at most, so the keys of one name are bounded; most names have one.
    """
    starts = heads.groupBy("m").agg(F.collect_set("key").alias("starts"))
    inside = F.filter("starts", lambda s: F.contains(F.col("loc"), s))
    return rows.join(starts, "m").withColumn("key", F.explode(inside)).drop("starts")


def _by_name(new: DataFrame, old: DataFrame) -> DataFrame:
    """Matches by equal full name, no contrary contact and a place that agrees.

    Equal contacts are looked up elsewhere, so here a side that has a contact needs the other to have none. That leaves a few
    classes (place, has e-mail, has phone) for each name; both sides are reduced to their classes before they meet. The
    place rule (the head of one place lies inside the other) becomes an equi-join on the first three characters of
    the head, for which the other place is listed only under those that its name has and that lie inside it, and is then checked.
    """
    kinds = ["m", "loc", "he", "hp"]
    classes = lambda d: d.filter(F.col("m") != "").withColumn("he", F.col("e") != "").withColumn("hp", F.col("p") != "")
    asked = classes(new)
    need = cut(asked.select(*kinds).distinct())
    have = cut(classes(old.join(need.select("m").distinct(), "m", "left_semi")).groupBy(*kinds).agg(F.min("src").alias("src")))
    head, start = T.place_head(F.col("loc")), F.substring("head", 1, 3)
    needed, held = (d.filter("loc <> ''") for d in (need, have))
    by_head = held.groupBy("m", head.alias("head"), "he", "hp").agg(F.min("src").alias("src")).withColumn("key", start)
    asked_heads = needed.select(*kinds, head.alias("head")).withColumn("key", start)
    free = ~(F.col("n.he") & F.col("h.he")) & ~(F.col("n.hp") & F.col("h.hp"))

    def meet(n: DataFrame, h: DataFrame, on: list[str], agree: Column) -> DataFrame:
        both = n.alias("n").join(h.alias("h"), [F.col(f"n.{c}") == F.col(f"h.{c}") for c in on])
        return both.filter(free & agree).select(*[F.col(f"n.{k}").alias(k) for k in kinds], F.col("h.src").alias("src"))

    hits = meet(_with_starts(needed, by_head), by_head, ["m", "key"], F.col("n.loc").contains(F.col("h.head")))
    hits = hits.unionByName(meet(asked_heads, _with_starts(held, asked_heads), ["m", "key"], F.col("h.loc").contains(F.col("n.head"))))
    anywhere = lambda d: d.groupBy("m", "he", "hp").agg(F.min("src").alias("src"))
    hits = hits.unionByName(meet(need.filter("loc = ''"), anywhere(have), ["m"], F.lit(True)))
    hits = hits.unionByName(meet(needed, anywhere(have.filter("loc = ''")), ["m"], F.lit(True)))
    return asked.join(hits.groupBy(*kinds).agg(F.min("src").alias("src")), kinds).select("seq", "src")


def stored_matches(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """(seq, stored_url): the first stored row, by source URL, that is the same person."""
    old = cut(match_fields(spread(stored, "source_url"), ["source_url"]).withColumnRenamed("source_url", "src"))
    return first_matches(cut(match_fields(rows, ["seq"])), old).withColumnRenamed("src", "stored_url")


def _roots(parents: DataFrame) -> DataFrame:
    """(seq, root) from (seq, parent) where a parent is smaller or the row itself; chains are halved each round."""
    now, moved = cut(parents.select("seq", F.col("parent").alias("root"))), 1
    while moved:
        up = now.select(F.col("seq").alias("root"), F.col("root").alias("above"))
        step = cut(now.join(up, "root").select("seq", "root", "above"))
        moved = step.filter("root <> above").limit(1).count()
        now = step.select("seq", F.col("above").alias("root"))
    return now


def resolve(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per person, pointed at the stored row of the same person where there is one.

    ``rows`` holds seq, batch (growing with seq) and the record fields. A person of a batch is compared, as it first came in, with the
    stored rows, and if none of them is the same with the persons of earlier batches. Of the batches of one person, the last value of
    a scalar wins and lists are united; ``seq`` is that of the first row.
    """
    rows = cut(rows)
    assigned = cut(leaders(rows))
    people = cut(merged(rows, assigned).join(rows.select("seq", "batch"), "seq"))
    starters = rows.join(assigned.filter("seq = leader").select("seq"), "seq", "left_semi")
    kept = cut(stored_matches(starters, stored))
    place = F.struct("batch", "seq")
    first = first_matches(cut(match_fields(starters, ["seq"])), cut(match_fields(people, ["seq", "batch"]).withColumn("src", place).drop("seq", "batch")))
    earlier = first.join(people.select("seq", "batch"), "seq").filter(F.col("src.batch") < F.col("batch")).select("seq", F.col("src.seq").alias("parent"))
    parents = people.select("seq").join(kept.select("seq", F.col("seq").alias("own")), "seq", "left").join(earlier, "seq", "left").select(
        "seq", F.coalesce("own", "parent", "seq").alias("parent"))
    of = _roots(parents).join(kept.withColumnRenamed("seq", "root"), "root", "left")
    # Two roots may point at the same stored row, so persons come together by the row they point at.
    pointed = people.join(of, "seq").withColumn("to", F.coalesce("stored_url", F.concat(F.lit("\u0001"), F.col("root").cast("string"))))
    filled = lambda f: F.when(F.coalesce(f, F.lit("")) != "", F.col("seq"))
    scalars = [f for f in RECORD_FIELDS if f not in LIST_FIELDS and f != "source_url"]
    empty = F.array().cast("array<string>")
    united = lambda f: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", f))), lambda x: x[f])))
    out = pointed.groupBy("to").agg(
        F.min("seq").alias("seq"), F.sum("n_rows").alias("n_rows"), F.coalesce(F.first("stored_url"), F.min_by("source_url", "seq")).alias("source_url"),
        *[F.max_by(F.col(f), filled(f)).alias(f) for f in scalars], *[F.coalesce(united(f), empty).alias(f) for f in LIST_FIELDS])
    return out.select("seq", "n_rows", *RECORD_FIELDS)
