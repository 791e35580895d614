"""Entity resolution: groups worked out by hand."""

import time

from pyspark.sql import functions as F

from leadspark import schemas as SC
from leadspark.operators import resolve as R
from leadspark.operators import review as RV
from leadspark.plans import batch as B
from leadspark.plans.batch import numbered_records
from leadspark.schemas import RECORD

ROWS = "seq bigint, batch bigint, " + RECORD
BLANK = dict(name=None, current_role=None, skills=[], current_location=None, target_countries=[], evidence_snippet=None, email=None, phone=None, platform=None)


def frame(spark, *people, batch=0):
    rows = [{**BLANK, "seq": i, "batch": batch, "source_url": f"http://h/{i}", **p} for i, p in enumerate(people)]
    return spark.createDataFrame(rows, ROWS)


def groups(spark, *people):
    """Numbers of the rows of each person."""
    out = {}
    for r in R.leaders(frame(spark, *people)).collect():
        out.setdefault(r.leader, []).append(r.seq)
    return sorted(sorted(g) for g in out.values())


def lee(**fields):
    return dict(name="Ann Lee", **fields)


def test_contacts_make_one_person(spark):
    assert groups(spark, dict(name="A", email="x@a.co"), dict(name="B", email="X@A.CO")) == [[0, 1]]
    assert groups(spark, dict(name="A", phone="+91 98765 43210"), dict(name="B", phone="9876543210")) == [[0, 1]]
    assert groups(spark, dict(phone="12345"), dict(phone="12345")) == [[0], [1]]        # too short to count


def test_names_need_two_words_and_agreeing_facts(spark):
    assert groups(spark, lee(), dict(name="ann  lee!", current_location="Pune")) == [[0, 1]]
    assert groups(spark, dict(name="Ann"), dict(name="Ann")) == [[0], [1]]
    assert groups(spark, lee(email="a@x.co"), lee(email="b@x.co")) == [[0], [1]]
    assert groups(spark, lee(phone="1111111111"), lee(phone="2222222222")) == [[0], [1]]
    assert groups(spark, lee(current_location="Pune, MH"), lee(current_location="Delhi")) == [[0], [1]]
    assert groups(spark, lee(current_location="Delhi, IN"), lee(current_location="New Delhi")) == [[0, 1]]
    assert groups(spark, lee(current_location="New Delhi"), lee(current_location="delhi")) == [[0, 1]]


def test_the_order_decides(spark):
    a, b, c = lee(phone="1111122222"), lee(email="a@x.com"), lee(email="b@x.com")
    assert groups(spark, a, b, c) == [[0, 1], [2]]
    assert groups(spark, a, c, b) == [[0, 1], [2]]
    assert groups(spark, b, c, a) == [[0, 2], [1]]


def test_the_first_match_wins(spark):
    # Row 3 fits person 0 by name and person 1 by phone: the earlier one takes it.
    assert groups(spark, lee(), dict(name="Bob Ray", phone="3333333333"), dict(name="C"), lee(phone="3333333333")) == [[0, 3], [1], [2]]


def test_a_nameless_person_gets_a_name(spark):
    assert groups(spark, dict(email="a@x.co"), lee(email="a@x.co"), lee()) == [[0, 1, 2]]


def test_filled_contacts_change_what_matches(spark):
    # Person 0 gains an address from row 1; row 2 has another address and stands alone, row 3 has none and joins the first.
    assert groups(spark, lee(), lee(email="a@x.co"), lee(email="b@x.co"), lee()) == [[0, 1, 3], [2]]


def test_batches_fold_on_their_own_and_meet_later(spark):
    first = frame(spark, lee(email="a@x.co", current_role="old", skills=["s1"]), dict(name="Bob Ray"))
    second = frame(spark, {}, {}, dict(name="Ann B Lee", email="a@x.co", current_role="new", skills=["s2", "s1"]), dict(name="Bob Ray", phone="4444444444"), batch=1).filter("seq > 1")
    third = frame(spark, *[{}] * 4, lee(email="z@x.co"), dict(name="x", phone="+4444444444", current_role="r"), batch=2).filter("seq > 3")
    none = frame(spark, lee()).drop("seq", "batch").limit(0)
    got = {r.seq: r for r in R.resolve(first.unionByName(second).unionByName(third), none).collect()}
    assert sorted(got) == [0, 1, 4]
    ann, bob = got[0], got[1]
    assert (ann.n_rows, ann.name, ann.current_role, ann.skills, ann.source_url) == (2, "Ann B Lee", "new", ["s1", "s2"], "http://h/0")
    assert (bob.n_rows, bob.name, bob.phone, bob.current_role, bob.source_url) == (3, "x", "+4444444444", "r", "http://h/1")


def test_stored_rows_come_first(spark):
    stored = frame(spark, lee(source_url="http://s/2"), lee(email="a@x.co", source_url="http://s/1"), dict(name="Cy", phone="5555555555", source_url="http://s/3"))
    new = frame(spark, lee(email="a@x.co"), lee(email="b@x.co"), dict(name="D", phone="5555555555"), dict(name="E F"))
    got = {r.seq: r.stored_url for r in R.stored_matches(new, stored.drop("seq", "batch")).collect()}
    assert got == {0: "http://s/1", 1: "http://s/2", 2: "http://s/3"}
    got = {r.seq: (r.n_rows, r.source_url) for r in R.resolve(new, stored.drop("seq", "batch")).collect()}
    assert got == {0: (1, "http://s/1"), 1: (1, "http://s/2"), 2: (1, "http://s/3"), 3: (1, "http://h/3")}


def test_places_of_stored_rows(spark):
    stored = [(f"http://s/{i}", place) for i, place in enumerate(["Goa, India", "Old Goa", "Pune", "Po", ", XX"])]
    old = frame(spark, *[dict(name=f"N {chr(97 + i)}a Lee", current_location=p, source_url=u) for i, (u, p) in enumerate(stored)])
    new = frame(spark, *[dict(name=f"N {chr(97 + i)}a Lee", current_location=p) for i, p in enumerate(["North Goa, IN", "goa", "Pune City", "Porto", "Oslo"])])
    got = {r.seq: r.stored_url for r in R.stored_matches(new, old.drop("seq", "batch")).collect()}
    # "north goa" holds "goa"; "old goa" holds "goa"; "pune city" holds "pune"; "porto" holds "po"; an empty head lies in every place.
    assert got == {i: f"http://s/{i}" for i in range(5)}


def test_many_places_of_one_name_stay_cheap():
    start, persons = time.perf_counter(), R._Persons()
    assert all(persons.fold(i, "ann lee", True, f"town {i:05d} x, state {i % 7}", "", "") == i for i in range(8000))
    assert persons.fold(9000, "ann lee", True, "near town 00042 x", "", "") == 42
    assert persons.fold(9001, "ann lee", True, "", "", "") == 0
    assert time.perf_counter() - start < 5


def test_equal_positions_lose_nobody(spark):
    items = spark.createDataFrame([(f"http://u/{i}", 0) for i in range(12)], "url string, pos bigint")
    records = spark.createDataFrame([(f"http://u/{i}", k, f"P {i} {k}") for i in range(12) for k in range(3)], "url string, pos int, name string")
    got = numbered_records(records, items, 5).orderBy("seq").collect()
    assert len({r.seq for r in got}) == 36 and len({r.batch for r in got}) == 3
    assert [(r.url, r.pos) for r in got] == sorted((f"http://u/{i}", k) for i in range(12) for k in range(3))
    assert all(len({r.batch for r in got if r.url == u}) == 1 for u in {r.url for r in got})


def test_ids_with_the_same_keys_stay_out_of_the_rounds(spark, monkeypatch):
    ids = [(i, f"{kind}{i % 3}") for i in range(300) for kind in "abc"] + [(400, "a0"), (400, "x"), (401, "x"), (7, "x")]
    sizes, cut = [], R.cut

    def counted(d):
        out = cut(d)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(R, "cut", counted)
    got = {r.id: r.component for r in R.linked_groups(spark.createDataFrame(ids, "id bigint, key string")).collect()}
    assert got == {**{i: 2 if i % 3 == 2 else 0 for i in range(300)}, 400: 0, 401: 0}      # 7 joins the groups of 0 and 1
    assert max(sizes[2:]) < 10


def test_a_long_chain_of_links(spark):
    chain = [(i, k) for i in range(60) for k in (f"k{(i * 37) % 61}", f"k{(i * 37 + 37) % 61}")]
    assert {r.component for r in R.linked_groups(spark.createDataFrame(chain, "id bigint, key string")).collect()} == {0}


def test_saved_rows_of_one_file_are_many_tasks(spark, monkeypatch):
    parts, cut = [], B.cut

    def counted(d):
        out = cut(d)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(B, "cut", counted)
    rows = RV.export_rows(frame(spark, *[lee(email=f"{i}@x.co") for i in range(20)]).coalesce(1)).withColumn("pos", F.col("seq"))
    saved = B.saved_records(rows.drop("seq", "batch"), SC.empty(spark, SC.CANDIDATES), F.current_timestamp())
    assert parts[0] == int(spark.conf.get("spark.sql.shuffle.partitions")) and saved.candidates.count() == 20


def test_a_place_is_listed_under_the_starts_of_its_name_only(spark):
    rows = spark.createDataFrame([("ann lee", "new delhi, in"), ("bob ray", "oslo")], "m string, loc string")
    heads = spark.createDataFrame([("ann lee", "del"), ("ann lee", "new"), ("ann lee", "osl"), ("bob ray", "")], "m string, key string")
    assert sorted(R._with_starts(rows, heads).select("m", "key").collect()) == [("ann lee", "del"), ("ann lee", "new"), ("bob ray", "")]
