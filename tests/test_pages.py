from pyspark.sql import functions as F

from leadspark.functions import html as H
from leadspark.operators import pages as P

PAGE = """<html><head><title> A  &amp; B </title><script type="application/ld+json">
{"@type": "Post", "author": [{"name": "Ann"}], "articleBody": "Hi\\n there", "comment": [
 {"@type": "Comment", "author": {"alternateName": "bob"}, "text": "mail bob@x.com"}, {"@type": "Answer", "text": "none"},
 {"@type": "Comment", "author": {"alternateName": "bob"}, "text": "mail bob@x.com"}]}</script>
<script type="application/ld+json">{broken</script><style>p{}</style></head>
<body><nav>menu</nav>One <b>two</b><!-- c --> three<br>four<div><form>hidden<p>also</div>five<footer>f</footer></body></html>"""


def test_page_parts(spark):
    r = H.page_parts(spark.createDataFrame([(1, PAGE), (2, "plain &lt;x&gt; <p>text"), (3, None)], "i int, html string")).orderBy("i").collect()
    assert r[0].title == "A  & B" and r[0].nodes.split("\n") == ["One", "two", "three", "four", "five"]
    assert [tuple(t) for t in r[0].thread] == [("POST", "Ann", "Hi there"), ("COMMENT", "bob", "mail bob@x.com"), ("COMMENT", "unknown", "none")]
    assert r[1].nodes == "plain <x>\ntext" and r[2].nodes == ""


def test_references_cut_short(spark, tmp_path):
    """The registered query leaves a reference without its semicolon as its SQL does; the function's default reads it."""
    import duckdb

    import __spark_entry__ as E

    html = ["<html><head><title>R&amp;D &amp;&amp</title></head><body><p>a &lt;b&gt; &am</p><p>x&copy y & z&nope; &amp;lt;</p></body></html>",
            '<html><head><title>T &lt</title><script type="application/ld+json">{"text": "a&amp b", "author": "ann"}</script></head><body>&</body></html>']
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    assert [r.title for r in H.page_parts(pages).orderBy("page_id").collect()] == ["R&D &&", "T <"]
    assert H.page_parts(pages, closed_only=True).filter("page_id = 1").first().thread[0].body == "a&amp b"
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in E.queries()["page_text"](spark, str(tmp_path)).select("page_id", "title", "text").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT page_id, title, text FROM ({E.oracle_sql()['page_text']})").fetchall())
    assert got[0][1] == "R&D &&amp"


def test_rendered_page(spark):
    t = H.with_page_text(spark.createDataFrame([(PAGE,)], "html string")).first().text
    assert t.startswith("# A  & B\n\n## Post and comments (structured, with authors)\nPOST by Ann: Hi there\nCOMMENT by bob: mail bob@x.com\n")
    assert "\n\n## Contact details found on the page\nEMAIL bob@x.com — context: …" in t
    assert t.endswith("\n\n## Page text\nOne\ntwo\nthree\nfour\nfive")


def test_classifier(spark):
    long, html = "x" * 300, "text/html"
    cases = [(200, "http://h/a", html, long, (True, False, None)), (200, "http://h/a", html, "x" * 100, (False, True, "login wall / bot check / empty page")),
             (403, "http://h/a", html, long, (False, True, "HTTP 403")), (404, "http://h/a", html, long, (False, False, "HTTP 404")),
             (200, "http://h/login", html, long, (False, True, "login wall")), (200, "http://h/?x=/login", html, long, (True, False, None)),
             (200, "http://h/a", "application/pdf", long, (False, False, "unsupported content-type application/pdf")),
             (200, "http://h/a", html, "captcha" + "x" * 993, (False, True, "login wall / bot check / empty page")),
             (200, "http://h/a", html, "captcha" + "x" * 1293, (True, False, None)),
             (200, "http://h/a", None, "captcha ## Post and comments" + "x" * 993, (True, False, None))]
    d = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, status int, u string, ctype string, text string")
    got = P.with_outcome(d, P.classify(F.col("u"), F.col("status"), F.col("ctype"), F.col("text")), ["i"]).orderBy("i").collect()
    assert [(r.ok, r.blocked, r.error) for r in got] == [c[4] for c in cases]


def test_robots(spark):
    body = "User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow: /a b\nAllow: /c/ok\nDisallow: /c\nDisallow: /q?x=1\nDisallow:\n"
    robots = spark.createDataFrame([("http://h", body), ("http://n", "User-agent: *\nDisallow: /")], "base string, body string")
    want = {"http://h/": True, "http://h/a%20b/1": False, "http://h/c/ok": True, "http://h/c/no": False, "http://h/q?x=12": False,
            "http://h/q?y": True, "http://n/x": False, "http://n": False, "http://other/x": True, "http://h:80/c": True}
    got = P.with_robots(spark.createDataFrame([(u,) for u in want], "url string"), robots)
    assert {r.url: r.allowed for r in got.collect()} == want


def test_robots_rules_as_the_standard_library_reads_them(spark):
    """Random texts of lines in any order; the standard parser decides."""
    import random
    from urllib.robotparser import RobotFileParser

    rng = random.Random(2)
    lines = ["User-agent: *", "user-agent:*", "USER-AGENT : * # all", "User-agent: bot", "User-agent:", "User-agent: */x", "Disallow: /a", "Allow: /a/b", "Disallow:", "Disallow: /c d",
             "Disallow: /%7Ee?x=1&y", "Allow: /f?", "Disallow: /g#", "Disallow: /h;", "Disallow: /i;j;", "Disallow: *", "Crawl-delay: 3", "Request-rate: 1/5", "Sitemap: http://h/s", "", "", "  ",
             "# comment", "nonsense", "Allow : /k # c", "Disallow: /é"]
    bodies = [(str(i), rng.choice(["\n", "\r\n", "\r"]).join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(400)] + [("none", None)]
    got = {r.base: [(x.allow, x.path) for x in r.rules] for r in P.robots_rules(spark.createDataFrame(bodies, "base string, body string")).collect()}
    ruled = 0
    for base, body in bodies:
        parser = RobotFileParser()
        parser.parse((body or "").splitlines())
        entry = next((e for e in parser.entries if e.applies_to("*")), parser.default_entry)
        want = [(r.allowance, r.path) for r in entry.rulelines] if entry else []
        assert got.get(base, []) == want, body
        ruled += bool(want)
    assert ruled > 100
    assert "Python" not in P.robots_rules(spark.createDataFrame(bodies, "base string, body string"))._jdf.queryExecution().toString()


def test_long_comments_with_equal_starts(spark):
    """Whole lines are compared when asked; the table function is callable from SQL."""
    start = "same start " * 30
    html = ('<script type="application/ld+json">[' + ", ".join('{"@type": "Comment", "author": "ann", "text": "%s%s"}' % (start, end) for end in ("one", "two", "one")) + "]</script>")
    page = spark.createDataFrame([(html,)], "html string")
    count = lambda **how: len(H.page_parts(page, **how).first().thread)
    assert (count(), count(key_chars=None), count(key_chars=5)) == (1, 2, 1)
    H.register(spark)
    page.createOrReplaceTempView("one_page")
    got = spark.sql("SELECT t.* FROM one_page, LATERAL thread_lines(html, CAST(NULL AS INT)) t ORDER BY pos").collect()
    assert [(r.pos, r.kind, r.author, r.body[-3:]) for r in got] == [(0, "COMMENT", "ann", "one"), (1, "COMMENT", "ann", "two")]
    assert spark.sql("SELECT t.* FROM one_page, LATERAL thread_lines(html, 200) t").count() == 1
    assert spark.sql("SELECT t.* FROM VALUES (CAST(NULL AS STRING)) v(html), LATERAL thread_lines(html, 200) t").count() == 0


def test_legacy_outcomes(spark):
    from leadspark.plans import batch as B

    long = "word " * 900
    pages = [("http://h/1", True, 200, None, long), ("http://h/2", False, None, "Blocked by robots", None), ("http://h/3", True, 407, None, long),
             ("http://h/4", True, 200, None, "captcha " + "x" * 3000), ("http://h/5", True, 0, None, "![i](u) [a](http://x) " + long), ("http://h/6", False, 500, "", long)]
    responses = spark.createDataFrame([(u, "direct", *r) for u, *r in pages], "url string, via string, success boolean, status int, error string, markdown string")
    got = {r.url: r for r in B.outcomes_of(responses.select("url"), responses, None, B.Settings(legacy=True)).collect()}
    assert {u[-1]: (r.ok, r.blocked, r.error) for u, r in got.items()} == {
        "1": (True, False, None), "2": (False, True, "Blocked by robots"), "3": (False, False, "HTTP 407"), "4": (False, True, "login wall / bot check / empty page"),
        "5": (True, False, None), "6": (False, False, "crawl failed")}
    assert got["http://h/5"].markdown.startswith("a word")


def test_a_page_the_tokenizer_refuses_fails_alone(spark):
    from leadspark.plans import batch as B

    long = "<p>" + "good words " * 60
    pages = [("http://h/1", 200, "text/html", "<p>a<![foo bar]>b"), ("http://h/2", 200, "text/html", long), ("http://h/3", 403, "text/html", long),
             ("http://h/4", 200, "application/pdf", long)]
    responses = spark.createDataFrame([(u, u, s, c, h, "direct") for u, s, c, h in pages], "url string, final_url string, status int, ctype string, html string, via string")
    items = responses.select("url")
    got = {r.url: r for r in B.outcomes_of(items, responses, None, B.Settings()).collect()}
    assert got["http://h/1"].error.startswith("HTML parsing failed: ") and not got["http://h/1"].blocked
    assert got["http://h/2"].ok and got["http://h/2"].markdown.startswith("## Page text")
    assert (got["http://h/3"].blocked, got["http://h/3"].markdown, got["http://h/3"].error) == (True, "", "HTTP 403")
    assert got["http://h/4"].error == "unsupported content-type application/pdf"


def test_pages_on_which_quotes_cannot_be_told_apart(spark, tmp_path):
    """No word at all, and the words of the invented quote: the registered query marks them as its SQL does."""
    import duckdb

    import __spark_entry__ as E

    texts = {8: "Plain words.", 9: "Éé.", 10: "The zz and the QQ", 17: "zz alone", 18: "", 19: "İ zzqq"}
    rows = [(k, v, "en", "src", len(v)) for k, v in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in E.queries()["verified_people"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(E.oracle_sql()["verified_people"]).fetchall())
    assert [n for _, n, _ in got] == [1, -1, -1, 1, -1, 1]


def test_pages_of_a_large_batch_are_read_a_few_at_a_time(spark):
    import pyarrow as pa

    pages = [f"<title>t{i}</title><p>page {i}</p>" if i % 7 else None for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(300)), "__html": pages})
    pieces = list(H._read(iter([batch]), None, False))
    assert max(p.num_rows for p in pieces) <= H.PIECE and [i for p in pieces for i in p.column(0).to_pylist()] == list(range(300))
    d = spark.createDataFrame(list(enumerate(pages)), "id int, html string").coalesce(1)
    assert {r.id: (r.title, r.parse_error) for r in H.page_parts(d).collect()} == {i: (f"t{i}" if i % 7 else "", None) for i in range(300)}
