
from pyspark.sql import functions as F

from leadspark.functions import evidence as E
from leadspark.functions import text as T
from leadspark.operators import extraction as X

L = F.lit


def strings(*xs):
    return F.array(*[L(x) for x in xs])


def check(spark, pairs):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(pairs)]).first()
    assert list(row) == [w for _, w in pairs]


def test_cleaning(spark):
    null = L(None).cast("string")
    check(spark, [
        (T.clean_email(L("<mailto:Jane.Doe@Example.com>.")), "jane.doe@example.com"),
        (T.clean_email(L("MAILTO:a@b.co")), None),
        (T.clean_phone(L("(+91) 98765 43210")), "+919876543210"),
        (T.clean_phone(L("00919876543210")), "00919876543210"),
        (T.clean_phone(L("1234567")), None),
        (T.clean_list(strings(" CNC ", "cnc", "N/A", "Fanuc")), ["CNC", "Fanuc"]),
        (T.clean_list(L(None).cast("array<string>")), []),
        (T.clean_str(L(" a  \x1cb\n")), "a b"), (T.clean_str(L(" Not  Mentioned ")), None), (T.clean_str(null), None),
        (T.cap_evidence(L("a" * 598 + " bcd")), "a" * 598 + "…"), (T.cap_evidence(L("a" * 600)), "a" * 600),
        (T.slug(L("B-B")), "b-b"), (T.slug(null), "person"), (T.name_key(L("ann  lee!")), "ann lee"),
        (T.phone_key(L("+91 98765-43210")), "9876543210"), (T.phone_key(L("1234567")), ""),
        (T.places_agree(L("Pune, MH"), L("Delhi")), False), (T.places_agree(null, L("Pune")), True),
        (T.places_agree(L("Pune, MH"), L("near pune")), True),
        (T.clean_markdown(L("a ![i](u) [t](https://x)\n\n\n\nb")), "a t\n\nb"),
        (T.compact(L("Name AT gmail (dot) Com at")), "name@gmail.com@"), (T.compact(L("cat dotted")), "catdotted"),
        (T.reason_key(L("HTTP 403; HTTP 500")), "HTTP 403"), (T.split_list(L(" a ;; b;")), ["a", "b"]),
    ])


def test_mentions_and_ownership(spark):
    content = L("COMMENT by Ann: mail ann@x.com\nPOST by Bob: call bob@x.com\nextra zed@x.com")
    keeps = lambda who, mail: E.owned(L(mail), E.email_on_page, content, E.thread_bodies(content, L(who))["own"],
                                      E.thread_bodies(content, L(who))["others"])
    check(spark, [
        (F.size(E.contact_mentions(L("4785380592391139"))), 0), (F.size(E.contact_mentions(L("111 222 1112"))), 0),
        (E.contact_mentions(L("152.143.123.131"))[0]["kind"], "PHONE"),
        (E.is_grounded(L("Open to work abroad"), L("open work")), False),
        (E.is_grounded(L("Open to work abroad"), L("open to work")), True),
        (E.is_grounded(L(None).cast("string"), L("open to work")), False), (E.is_grounded(L("é!"), L("é!")), False),
        (E.grounded_share(L("a a a b c d"), L("a")), 0.5), (E.grounded_share(L("a a b"), L("a b c")), 1.0),
        (keeps("Ann", "ann@x.com"), True), (keeps(" aNN ", "bob@x.com"), False), (keeps("Ann", "zed@x.com"), True),
        (E.email_on_page(L("name@gmail.com"), L("mail name at gmail dot com")), True),
        (E.phone_on_page(L("+91 98765 43210"), L("x 9876543210 y")), True),
        (E.looks_personal(L("t"), L("I am looking for a job in Germany, please help me")), True),
    ])


def test_mentions_by_hand(spark):
    """Kind and value of each mention; a value counts once whatever its case, and digits that belong to a longer run do not count."""
    cases = [
        ("a@b.com-foo@c.org x@y x@@z.com", [("EMAIL", "a@b.com"), ("EMAIL", "-foo@c.org")]),
        ("write Ann.Lee+jobs@mail.example.org, or ann.lee+jobs@MAIL.example.org.", [("EMAIL", "Ann.Lee+jobs@mail.example.org")]),
        ("call +91-987-654-3210, or 0012345678901", [("PHONE", "+91-987-654-3210"), ("PHONE", "0012345678901")]),
        ("two signs between digits end a number: +91 (987) 654-3210", []),
        ("id 1234567890123456 ref 9876543210/1 5/9876543210", []),
        ("987-654-3210 and 987 654 3210", [("PHONE", "987-654-3210"), ("PHONE", "987 654 3210")]),
        ("11111111 1222221111", []),
        ("no contact", []),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = [[(m.kind, m.value) for m in r.m] for r in d.select("i", E.contact_mentions(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_context_of_a_mention(spark):
    text = "x" * 200 + " write\tto\n a@b.co " + "y" * 100
    m = spark.range(1).select(E.contact_mentions(F.lit(text)).alias("m")).first().m[0]
    assert m.context == "x" * (160 - len(" write\tto\n ")) + " write to a@b.co " + "y" * 59


def test_source_urls(spark):
    u = lambda *xs: [("u" if x is None else f"u#candidate-{x}") for x in xs]
    names = F.array(L("A"), L("B b"), L("B-B"), L("C"), L(None).cast("string"))
    clash = strings("first", "x", "x", "x-2", "x", "x-2", "X 2")
    check(spark, [
        (X.assigned_urls(L("u"), names), u(None, "b-b", "b-b-2", "c", "person")),
        (X.assigned_urls(L("u"), clash), u(None, "x", "x-2", "x-2-2", "x-3", "x-2-3", "x-2-4")),
        (X.assigned_urls(L("u"), F.array().cast("array<string>")), []),
    ])


def test_replies(spark):
    rows = [("a", '{"candidates": [{"name": "Ann", "skills": ["x"]}]}', None), ("b", "```json\n{\"candidates\": []}\n```", None),
            ("c", "", None), ("d", "no json", None), ("e", '{"candidates": [{"name": 5}]}', None), ("f", '{"candidates": null}', None),
            ("g", "[]", None), ("h", "{}", "quota"), ("i", '{"candidates": [{"skills": [1]}]}', None), ("j", '{"x": 1}', None)]
    d = X.parse_replies(spark.createDataFrame(rows, "url string, reply string, error_kind string"))
    got = {r.url: (len(r.people), r.error_kind) for r in d.collect()}
    assert got == {"a": (1, None), "b": (0, None), "c": (0, None), "d": (0, "invalid"), "e": (0, "invalid"), "f": (0, "invalid"),
                   "g": (0, "invalid"), "h": (0, "quota"), "i": (0, "invalid"), "j": (0, None)}


def test_verified_people(spark):
    page = ("COMMENT by Ann: I weld, mail ann at x dot com\nCOMMENT by Bob: call +91 98765 43210\n"
            "POST by Rec: write rec@x.com\nfooter info@x.com")
    people = ('{"candidates": [{"name": "Ann", "evidence_snippet": "I weld", "email": "ann@x.com", "phone": "9876543210"},'
              '{"name": "Bob", "evidence_snippet": "call", "email": "rec@x.com", "phone": "98765 43210"},'
              '{"name": "Cy", "evidence_snippet": "never said this", "email": "info@x.com"},'
              '{"name": "Dee", "evidence_snippet": "write", "email": "info@x.com"}]}')
    d = X.parse_replies(spark.createDataFrame([("u", people, None)], "url string, reply string, error_kind string"))
    v = X.verified_people(d.select("url", L(page).alias("content"), "people")).first()
    assert [(p.name, p.email, p.phone) for p in v.people] == [
        ("Ann", "ann@x.com", None), ("Bob", None, "98765 43210"), ("Dee", "info@x.com", None)]
    assert (v.n_people, v.n_ungrounded) == (4, 1)


def test_running_sums_and_occurrences(spark):
    import random
    import time
    from itertools import accumulate

    rng = random.Random(1)
    lists = [[], [3], [1] * 64, [1] * 65, [rng.randrange(9) for _ in range(1000)], list(range(8192))]
    got = spark.createDataFrame([(i, xs) for i, xs in enumerate(lists)], "i int, xs array<int>").select(
        "i", T.running_sum(F.col("xs")).alias("s"), T.occurrence(F.col("xs").cast("array<string>")).alias("n")).orderBy("i").collect()
    for r, xs in zip(got, lists):
        seen = {}
        count = [seen.setdefault(x, []).append(1) or len(seen[x]) for x in xs]
        assert r.s == list(accumulate(xs)) and r.n == count
    from leadspark.functions import evidence as E
    from leadspark.operators import extraction as X

    many = " ".join(f"p{i % 4000}@mail.example.com x" for i in range(8000))
    names = [f"ann {i % 50}" for i in range(8000)]
    d = spark.createDataFrame([(many, names)], "t string, names array<string>").select(
        F.size(E.email_mentions(F.col("t"))).alias("m"), F.size(F.array_distinct(X.assigned_urls(F.lit("u"), F.col("names")))).alias("u"))
    d.collect()
    start = time.perf_counter()
    r = d.first()
    assert (r.m, r.u) == (4000, 8000) and time.perf_counter() - start < 5
