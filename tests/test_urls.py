import random

from pyspark.sql import functions as F

from leadspark.functions import urls as U

GOLDENS = [
    ("http://blog.ththan.example.net/en/369#top", "http://blog.ththan.example.net/en/369"),
    ("https://ththin.example.com/en/671?utm_source=feed", "https://ththin.example.com/en/671"),
    ("http://ththre.example.com/fr/825?page=2&ref=x", "http://ththre.example.com/fr/825?page=2"),
    ("https://m.ththth.example.net/en/25#top", "https://www.ththth.example.net/en/25"),
    ("https://blog.tiontion.example.com/en/853/", "https://blog.tiontion.example.com/en/853"),
    ("http://in.linkedin.com/in/Jane//Doe/?trk=abc&b=2&a=1", "https://www.linkedin.com/in/Jane/Doe?a=1&b=2"),
    ("https://old.reddit.com/r/x/?sort=new", "https://www.reddit.com/r/x"),
    ("http://h.example.com:443/a;j=1?x=1&y=", "http://h.example.com/a?x=1"),
    ("https://duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.com%2Fp&rut=z", "https://example.com/p"),
    ("http://u@h.example.com/a%2525b", "http://h.example.com/a%25b"),
    ("http://h.example.com", "http://h.example.com/"),
    ("ftp://x/y", None), ("http://h:99999/", None), ("http://h:80x/", None), ("", None), (None, None),
]


def canon(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    return [r.url for r in U.with_canonical_url(df, "u").orderBy("i").collect()]


def test_goldens(spark):
    assert canon(spark, [u for u, _ in GOLDENS]) == [w for _, w in GOLDENS]


BY_RULE = [
    # scheme, host, user info, port
    ("HTTPS://H.Example.COM/A", "https://h.example.com/A"), ("https://user:pw@h.net:8080/", "https://h.net:8080/"), ("http://h.net:/a", "http://h.net/a"),
    ("http://h.net:080/a", "http://h.net/a"), ("http://h.net./a", "http://h.net/a"), ("mailto:a@b.co", None), ("//h.net/a", None), ("http:///a", None),
    ("http://m.site.org/a", "http://www.site.org/a"), ("http://m.co/a", "http://m.co/a"),
    # bracketed hosts
    ("http://[abc]/x", None), ("http://[::1/x", None), ("http://::1]/x", None), ("http://[1:2:3]/x", None), ("http://[::1::2]/x", None), ("http://a[::1]/x", None),
    # path
    ("http://h.net/a/b;x=1/c;y=2;z", "http://h.net/a/b;x=1/c"), ("http://h.net//a///b//", "http://h.net/a/b"), ("http://h.net/%7Ea%20b", "http://h.net/~a%20b"),
    ("http://h.net/\u00e9", "http://h.net/%C3%A9"), ("http://h.net/a b", "http://h.net/a%20b"), ("http://h.net/;p", "http://h.net/"),
    # query
    ("http://h.net/?b=2&a=1&a=0", "http://h.net/?a=0&a=1&b=2"), ("http://h.net/?UTM_X=1&q=a+b%26c", "http://h.net/?q=a+b%26c"), ("http://h.net/?a=&b", "http://h.net/"),
    ("http://h.net/?q=\u00e9#f", "http://h.net/?q=%C3%A9"),
    # redirects
    ("https://www.google.com/url?q=https%3A%2F%2Fexample.com%2Fp%3Fz%3D1&sa=U", "https://example.com/p?z=1"), ("https://www.google.com/url?url=http://h.net/a", "http://h.net/a"),
    ("https://www.google.com/search?q=http://h.net/a", "https://www.google.com/search?q=http%3A%2F%2Fh.net%2Fa"),
    ("//duckduckgo.com/l/?uddg=http%3A%2F%2Fh.net", "http://h.net/"),
]


def test_each_rule_by_hand(spark):
    got = canon(spark, [u for u, _ in BY_RULE])
    assert [(u, g) for (u, _), g in zip(BY_RULE, got)] == BY_RULE


def test_a_second_pass_changes_nothing_without_escapes(spark):
    rnd = random.Random(5)
    urls = ["http://" + rnd.choice(["h.example.com", "M.site.org", "in.linkedin.com", "a.b.:8080", "u@h.net"]) + "/" + "".join(
        rnd.choice(["a", "Z", "/", "//", "~", "*", "=", ":", "."]) for _ in range(rnd.randint(0, 8))) + "x?" + "&".join(
        rnd.choice(["a", "ref", "utm_x", "B"]) + rnd.choice(["", "=", "=1", "=z.y"]) for _ in range(rnd.randint(0, 4))) for _ in range(300)]
    once = canon(spark, urls)
    assert None not in once and canon(spark, once) == once
    assert not any(x in u for u in once for x in ("#", "utm_", "ref=", "m.site.org") if not (x == "m.site.org" and "www" in u))


def test_parameters_are_no_path(spark):
    df = spark.createDataFrame([("http://h.example/a.jpg;x=1",), ("http://h.example/x;captcha",), ("http://h.example/login;a",)], "u string")
    got = [(r.ok, r.wall) for r in df.select(U.is_useful(F.col("u")).alias("ok"), U.is_wall_url(F.col("u")).alias("wall")).collect()]
    assert got == [(False, False), (True, False), (True, True)]


def test_tags(spark):
    rows = [("https://www.linkedin.com/in/a", "linkedin", True), ("https://fedex.com/", "x", True),
            ("https://forum.example.org/", "forum", True), ("https://example.org/threads/1", "forum", True),
            ("https://www.example.org/", "example.org", True), ("https://a.example/x.PNG", "a.example", False),
            ("https://a.example/?u=youtube.com", "a.example", False)]
    df = spark.createDataFrame(rows, "u string, p string, ok boolean")
    for r in df.select("*", U.platform(F.col("u")).alias("gp"), U.is_useful(F.col("u")).alias("gok")).collect():
        assert (r.gp, r.gok) == (r.p, r.ok), r.u


def test_filters_stay_above_the_canonical_chain(spark):
    d = U.with_canonical_url(spark.range(1).select(F.lit("http://h/a").alias("u")), "u").filter("url IS NOT NULL AND length(url) > 3")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")
    assert len(plan) < 50_000
