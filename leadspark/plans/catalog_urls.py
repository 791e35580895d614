"""Registered queries: URLs, hits, waves, ledger, plans, run counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadspark import constants as K
from leadspark.functions import text as T
from leadspark.functions import urls as U
from leadspark.operators import hits as HT
from leadspark.operators import ledger as L
from leadspark.operators import searchplan as SP
from leadspark.operators import stats as S
from leadspark.operators.keyed import cut, first_per
from leadspark.plans import batch as B
from leadspark.plans import driver_views as V
from leadspark.plans import sqltext as Q
from leadspark.plans.registry import query

col = F.col


@query(f"""WITH {Q.HITS} SELECT {Q.platform('url')} AS platform, count(*) AS urls, count(DISTINCT {Q.host('url')}) AS hosts
FROM (SELECT DISTINCT url FROM hits WHERE {Q.useful('url')}) GROUP BY 1""")
def platform_counts(spark, sf):
    """Hits to canonical, useful, first-seen URLs, counted per platform."""
    h = V.page_hits(spark, sf).select("query_seq", "engine_seq", "rank", "url")
    once = HT.first_hits(h.filter(U.is_useful(col("url")))).select("url", U.host(col("url")).alias("host"))
    return once.select("host", U.platform(col("url"), col("host")).alias("platform")).groupBy("platform").agg(
        F.count("*").alias("urls"), F.count_distinct("host").alias("hosts"))


@query(f"WITH {Q.CANON} SELECT page_id, url, canon FROM canon")
def canonical_urls(spark, sf):
    return U.with_canonical_url(V.table(spark, sf, "pages").select("page_id", "url"), "url", "canon", ["page_id", "url"])


@query(f"""WITH {Q.CANON}, u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN canon WHEN 1 THEN canon || '?v=youtube.com'
  WHEN 2 THEN replace(canon, '://', '://in.linkedin.com.') || '/login' ELSE 'http://x:y@' || {Q.host('canon')} || ':8080/thread/pic.JPG' END AS url
  FROM canon)
SELECT page_id, url, {Q.host('url')} AS host, {Q.netloc('url')} AS netloc, {Q.useful('url')} AS useful, {Q.platform('url')} AS platform,
  ({' OR '.join(f"contains({Q.host('url')}, '{n}')" for n in K.STRICT_HOST_NEEDLES)}) AS strict,
  regexp_matches({Q.path('url')}, '(?i)authwall|/login|/signin|/checkpoint|/uas/login|captcha') AS wall FROM u""")
def useful_platform(spark, sf):
    d = canonical_urls(spark, sf).select("page_id", "canon")
    c, k = col("canon"), col("page_id") % 4
    d = d.select("page_id", F.when(k == 0, c).when(k == 1, F.concat(c, F.lit("?v=youtube.com"))).when(
        k == 2, F.concat(F.replace(c, F.lit("://"), F.lit("://in.linkedin.com.")), F.lit("/login"))).otherwise(
        F.concat(F.lit("http://x:y@"), U.host(c), F.lit(":8080/thread/pic.JPG"))).alias("url"))
    d = d.select("page_id", "url", U.host(col("url")).alias("host"))
    u, h = col("url"), col("host")
    return d.select("page_id", "url", "host", U.netloc(u).alias("netloc"), U.is_useful(u).alias("useful"),
                    U.platform(u, h).alias("platform"), U.is_strict(u, h).alias("strict"), U.is_wall_url(u).alias("wall"))


@query(f"""WITH {Q.HITS} SELECT url, query, rank, title FROM hits
QUALIFY row_number() OVER (PARTITION BY url ORDER BY query_seq, rank) = 1""")
def first_hits(spark, sf):
    return HT.first_hits(V.page_hits(spark, sf)).select("url", "query", "rank", "title")


@query(f"""WITH {Q.HITS}, once AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY rank) = 1)
SELECT query, rank, url FROM once QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 4""")
def hits_capped(spark, sf):
    h = V.page_hits(spark, sf)
    return HT.topped_up(V.queries25(spark, sf), h, h.limit(0), 2, "duckduckgo").select("query", "rank", "url")


_PRIMARY = f"""prim AS (SELECT 'q' || seq AS query, 0 AS engine_seq, page_id AS rank, canon AS url,
  'hit ' || page_id AS title, 'snippet ' || page_id AS snippet
  FROM (SELECT *, page_id // 30 AS k, CASE WHEN k % 3 = 2 OR (k % 3 = 1 AND page_id % 30 < 2) THEN k ELSE k - k % 3 + 2 END AS seq FROM canon)
  WHERE canon IS NOT NULL AND {Q.useful('canon')} QUALIFY row_number() OVER (PARTITION BY seq, canon ORDER BY page_id) = 1)"""
_SECONDARY = f"""sec AS (SELECT query, 1 AS engine_seq, rank, url, title, snippet FROM (
  SELECT 'q' || (page_id // 30) AS query, page_id % 30 AS rank, canon AS url, 'result ' || page_id AS title, 'text ' || page_id AS snippet,
    row_number() OVER (PARTITION BY page_id // 30, canon ORDER BY page_id) AS rn
  FROM canon WHERE canon IS NOT NULL AND {Q.useful('canon')}) WHERE rn = 1)"""
_ALL_RESULTS = 30       # all that a query has


@query(f"WITH {Q.CANON}, {_PRIMARY} SELECT query, rank, url, title, snippet FROM prim")
def primary_hits(spark, sf):
    return HT.primary_hits(V.raw_primary(spark, sf)).select("query", "rank", "url", "title", "snippet")


@query(f"WITH {Q.CANON}, {_SECONDARY} SELECT query, rank, url, title, snippet FROM sec")
def secondary_hits(spark, sf):
    return HT.secondary_hits(V.raw_secondary(spark, sf), _ALL_RESULTS).select("query", "rank", "url", "title", "snippet")


_TOPPED = f"""{Q.CANON}, {_PRIMARY}, {_SECONDARY}, q AS (SELECT DISTINCT 'q' || (page_id // 30) AS query FROM pages),
  thin AS (SELECT query FROM q WHERE (SELECT count(*) FROM prim WHERE prim.query = q.query) < 3),
  allhits AS (SELECT * FROM prim WHERE query IN (SELECT query FROM q) UNION ALL SELECT * FROM sec WHERE query IN (SELECT query FROM thin)),
  topped AS (SELECT * FROM (SELECT * FROM allhits QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY engine_seq, rank) = 1)
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY engine_seq, rank) <= 60)"""


@query(f"WITH {_TOPPED} SELECT query, engine_seq, rank, url FROM topped")
def engine_topup(spark, sf):
    return _topped(spark, sf).select("query", "engine_seq", "rank", "url")


def _topped(spark, sf, primary=None):
    return HT.topped_up(V.result_queries(spark, sf), primary or HT.primary_hits(V.raw_primary(spark, sf)),
                        HT.secondary_hits(V.raw_secondary(spark, sf), _ALL_RESULTS), _ALL_RESULTS)


@query(f"""WITH {_TOPPED}, n AS (SELECT query, count(*) AS hits FROM topped GROUP BY query)
SELECT q.query, CASE WHEN t.query IS NULL THEN 'ddg' ELSE 'ddg, google' END AS sources, coalesce(n.hits, 0) AS hits,
  CASE WHEN n.hits IS NULL AND substr(q.query, 2)::INT % 4 = 3 THEN 'ddg: timeout: 15s; google: HTTP 500' END AS error,
  substr(q.query, 2)::INT % 5 = 0 AS rate_limited
FROM q LEFT JOIN thin t USING (query) LEFT JOIN n USING (query)""")
def query_summary(spark, sf):
    primary = cut(HT.primary_hits(V.raw_primary(spark, sf)))
    used = HT.engines_used(V.result_queries(spark, sf), primary)
    return HT.query_summary(used, V.query_log(spark, sf), cut(_topped(spark, sf, primary)))


@query(f"""WITH {Q.HITS}, f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY query_seq, rank) AS rn FROM hits)
SELECT query, count(*) AS results, count(*) FILTER (rn = 1) AS new FROM f GROUP BY query""")
def query_new_hits(spark, sf):
    return HT.new_hits_per_query(V.page_hits(spark, sf))


@query(f"""WITH {Q.WAVE_HITS} SELECT url, wave_no, pos FROM wave_hits
QUALIFY row_number() OVER (PARTITION BY url ORDER BY wave_no, pos) = 1""")
def wave_dedup(spark, sf):
    return HT.first_wave(V.wave_hits(spark, sf))


_FRESH_WAVES = f"""{Q.WAVE_HITS}, {Q.LEDGER}, fresh AS (
  SELECT url, wave_no, pos, row_number() OVER (PARTITION BY wave_no ORDER BY pos) AS wave_pos FROM (
    SELECT * FROM wave_hits QUALIFY row_number() OVER (PARTITION BY url ORDER BY wave_no, pos) = 1) w
  WHERE url NOT IN (SELECT url FROM ledger WHERE {Q.HANDLED}))"""


@query(f"""WITH {_FRESH_WAVES} SELECT wave_no, url, wave_pos, (wave_pos - 1) // 5 + 1 AS batch_no,
  'W' || wave_no || ':p' || (wave_no % 2) AS wave_tag FROM fresh WHERE wave_pos <= 30""")
def wave_batches(spark, sf):
    d = B.wave_urls(V.wave_hits(spark, sf), V.ledger(spark, sf), V.as_of())
    d = d.withColumn("platform", F.concat(F.lit("p"), col("wave_no") % 2))
    return B.tagged(d).select("wave_no", "url", "wave_pos", "batch_no", "wave_tag")


@query(f"""WITH {Q.WAVE_HITS}, w AS (SELECT *, row_number() OVER (PARTITION BY wave_no ORDER BY pos) AS wave_pos FROM wave_hits)
SELECT wave_no, pos, wave_pos, (wave_pos - 1) // 8 + 1 AS batch_no FROM w""")
def wave_batches_all(spark, sf):
    d = V.wave_hits(spark, sf).select("wave_no", "pos")
    return HT.all_batches(d, 8).select("wave_no", "pos", "wave_pos", "batch_no")


@query("""SELECT query_seq AS seq, 'q' || query_seq AS query FROM (SELECT DISTINCT o_orderkey AS query_seq FROM orders)
ORDER BY query_seq DESC LIMIT 120""")
def recent_queries(spark, sf):
    q = V.table(spark, sf, "orders").select(col("o_orderkey").alias("seq"), F.concat(F.lit("q"), "o_orderkey").alias("query"))
    return HT.recent_queries(q)


# --- ledger ------------------------------------------------------------------------
@query(f"""WITH {Q.LEDGER} SELECT url, min(page_id) AS pos FROM pages WHERE url <> ''
AND url NOT IN (SELECT url FROM ledger WHERE {Q.HANDLED}) GROUP BY url""")
def fresh_urls(spark, sf):
    return L.fresh_urls(V.page_urls(spark, sf), V.ledger(spark, sf), V.as_of())


_NEW_LEDGER = f"""{Q.LEDGER}, incoming AS (
  SELECT url, arg_min('N' || (page_id % 2), page_id) AS tag FROM (
    SELECT url || CASE WHEN page_id % 3 = 0 THEN 'new' ELSE '' END AS url, page_id FROM pages) GROUP BY url),
recorded AS (
  SELECT coalesce(l.url, i.url) AS url, CASE WHEN l.url IS NULL THEN {Q.netloc('i.url')} ELSE l.domain END AS domain,
    CASE WHEN go THEN i.tag ELSE l.wave_tag END AS wave_tag, CASE WHEN go THEN 'pending' ELSE l.status END AS status,
    CASE WHEN go THEN {Q.TS} ELSE l.scraped_at END AS scraped_at
  FROM (SELECT l.url AS lu, i.url AS iu, i.url IS NOT NULL AND (l.url IS NULL OR coalesce(l.status IN ('robots', 'quota', 'pending'), false)) AS go
        FROM ledger l FULL JOIN incoming i ON l.url = i.url) j
  LEFT JOIN ledger l ON l.url = j.lu LEFT JOIN incoming i ON i.url = j.iu)"""


def _incoming(spark, sf):
    return V.page_urls(spark, sf).withColumn(
        "url", F.concat("url", F.when(col("pos") % 3 == 0, "new").otherwise("")))


@query(f"WITH {_NEW_LEDGER} SELECT url, domain, wave_tag, status, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at FROM recorded")
def ledger_record(spark, sf):
    d = L.record_urls(V.ledger(spark, sf), _incoming(spark, sf), V.as_of())
    return d.withColumn("scraped_at", V.text_of(col("scraped_at")))


@query("SELECT count(DISTINCT url || CASE WHEN page_id % 3 = 0 THEN 'new' ELSE '' END) AS recorded FROM pages")
def ledger_recorded_count(spark, sf):
    return L.recorded_count(_incoming(spark, sf))


@query(f"""WITH {Q.LEDGER}, s AS (SELECT DISTINCT url, CASE length(url) % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'walled' ELSE 'failed' END AS status
  FROM (SELECT url || CASE WHEN page_id % 3 = 0 THEN 'new' ELSE '' END AS url FROM pages))
SELECT l.url, l.domain, l.wave_tag, CASE WHEN s.url IS NULL THEN l.status ELSE s.status END AS status FROM ledger l LEFT JOIN s ON s.url = l.url""")
def ledger_status(spark, sf):
    n = F.length("url") % 3
    s = _incoming(spark, sf).select("url", F.when(n == 0, "ok").when(n == 1, "walled").otherwise("failed").alias("status"))
    return L.set_status(V.ledger(spark, sf), s).select("url", "domain", "wave_tag", "status")


# --- plans -------------------------------------------------------------------------
_PLAN = """w AS (SELECT p_size + 1 AS wave_no, p_name, min(p_partkey) AS first_at FROM part GROUP BY 1, 2),
q AS (SELECT wave_no, p_name AS query, row_number() OVER (PARTITION BY wave_no ORDER BY first_at) AS rn FROM w WHERE wave_no % 5 <> 0
  AND wave_no IN (SELECT DISTINCT wave_no FROM w WHERE wave_no % 5 <> 0 ORDER BY wave_no LIMIT 6)),
done AS (SELECT DISTINCT CASE WHEN starts_with(p_name, 'red') THEN lower(p_name) ELSE 'x ' || p_name END AS k FROM part)"""


@query(f"""WITH {_PLAN} SELECT wave_no, 'Wave ' || wave_no AS wave_name, 'p' || (wave_no % 3) AS platform, query_no, query FROM (
  SELECT wave_no, query, row_number() OVER (PARTITION BY wave_no ORDER BY rn) AS query_no FROM q WHERE lower(query) NOT IN (SELECT k FROM done))
WHERE query_no <= 4""")
def plan_cleanup(spark, sf):
    return SP.planned_queries(SP.cleaned_plan(V.plan(spark, sf)), V.done_queries(spark, sf), 6, 4)


@query(f"""WITH {_PLAN} SELECT wave_no, array_to_string(list(query ORDER BY rn), '|') AS queries FROM q WHERE rn <= 5 GROUP BY wave_no""")
def plan_cleanup_legacy(spark, sf):
    none = V.done_queries(spark, sf).limit(0)
    p = SP.as_plan(SP.planned_queries(SP.cleaned_plan(V.plan(spark, sf)), none, 6, 5))
    return p.select("wave_no", F.array_join("queries", "|").alias("queries"))


# --- counters ----------------------------------------------------------------------
_WAVE_URLS = f"""{_FRESH_WAVES}, found AS (SELECT DISTINCT wave_no, url FROM wave_hits),
marked AS (SELECT 'wave ' || w.wave_no AS wave, f.url IS NOT NULL AS is_fresh, coalesce(f.wave_pos <= 30, false) AS is_taken,
    CASE WHEN f.wave_pos <= 30 THEN f.pos % 4 <> 0 END AS ok, CASE WHEN f.wave_pos <= 30 THEN f.pos % 8 = 0 END AS blocked,
    CASE WHEN f.wave_pos <= 30 THEN f.pos % 3 END AS records, CASE WHEN f.wave_pos <= 30 THEN f.pos % 2 END AS dropped
  FROM found w LEFT JOIN fresh f ON f.url = w.url AND f.wave_no = w.wave_no),
waves AS (SELECT wave, count(*) AS found, count(*) FILTER (NOT is_fresh) AS duplicates, count(*) FILTER (is_taken) AS fresh,
    count(*) FILTER (ok) AS crawled, count(*) FILTER (blocked) AS blocked, count(*) FILTER (NOT ok AND NOT blocked) AS failed,
    coalesce(sum(records), 0)::BIGINT AS records, coalesce(sum(dropped), 0)::BIGINT AS dropped FROM marked GROUP BY wave)"""


def _wave_rows(spark, sf):
    hits, ledger = V.wave_hits(spark, sf), V.ledger(spark, sf)
    fresh = HT.first_wave(hits).join(ledger.filter(L.handled(V.as_of())).select("url"), "url", "left_anti")
    taken = HT.capped_batches(fresh).select("wave_no", "url", "pos", F.lit(True).alias("is_taken"))
    found = hits.select("wave_no", "url").distinct()
    d = found.join(fresh.select("wave_no", "url", F.lit(True).alias("is_fresh")), ["wave_no", "url"], "left").join(
        taken, ["wave_no", "url"], "left")
    pos = col("pos")    # null where the page was not taken
    return d.select(
        F.concat(F.lit("wave "), "wave_no").alias("wave"), F.coalesce("is_fresh", F.lit(False)).alias("is_fresh"),
        F.coalesce("is_taken", F.lit(False)).alias("is_taken"), (pos % 4 != 0).alias("ok"), (pos % 8 == 0).alias("blocked"),
        (pos % 3).alias("records"), (pos % 2).alias("dropped"))


def _waves(spark, sf):
    return S.wave_stats(_wave_rows(spark, sf))


@query(f"WITH {_WAVE_URLS} SELECT *, false AS is_total FROM waves UNION ALL SELECT NULL, {', '.join(f'sum({c})::BIGINT' for c in S.COUNTERS)}, true FROM waves")
def wave_report(spark, sf):
    """Waves and run in one pass by grouping sets."""
    return S.wave_report(_wave_rows(spark, sf)).select("wave", *S.COUNTERS, "is_total")


@query(f"WITH {_WAVE_URLS} SELECT * FROM waves")
def wave_stats(spark, sf):
    return _waves(spark, sf)


@query(f"WITH {_WAVE_URLS} SELECT {', '.join(f'sum({c})::BIGINT AS {c}' for c in S.TOTALS)} FROM waves")
def run_totals(spark, sf):
    return S.run_totals(_waves(spark, sf))


def _folded(c: str) -> str:
    mods = {"found": ("dedup", "n"), "duplicates": ("dedup", "n % 7"), "fresh": ("dedup", "n % 30"),
            "crawled": ("", "n % 11"), "blocked": ("", "n % 5"), "failed": ("", "n % 3"), "records": ("", "n % 13"),
            "dropped": ("", "n % 2")}
    kind, value = mods[c]
    has = "kind = 'dedup'" if kind else "kind IN ('saved', 'wave_end')"
    return f"coalesce(arg_max({value}, (ts, seq)) FILTER ({has}), 0) AS {c}"


FOLDED_SQL = f"""WITH {Q.RUN_EVENTS} SELECT wave, {', '.join(_folded(c) for c in S.COUNTERS)} FROM run_events
WHERE wave IS NOT NULL AND kind IN ('dedup', 'saved', 'wave_end', 'wave_start') GROUP BY wave"""


@query(FOLDED_SQL)
def event_fold(spark, sf):
    return S.folded_stats(V.run_events(spark, sf))


@query(f"""WITH {Q.RUN_EVENTS} SELECT seq, strftime(ts, '%H:%M:%S') || ' ' || CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in S.ICONS.items())} ELSE '•' END
 || ' ' || CASE WHEN wave IS NULL THEN '' ELSE '[' || wave || '] ' END || message AS line FROM run_events ORDER BY ts DESC, seq DESC LIMIT 250""")
def recent_events(spark, sf):
    return S.recent_lines(V.run_events(spark, sf))


@query("SELECT doc_id, left(split_part(e, ';', 1), 60) AS reason FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'disallowed by robots.txt' ELSE text || '; HTTP 500' END AS e FROM documents)")
def error_reasons(spark, sf):
    error = F.when(col("doc_id") % 5 == 0, K.ROBOTS_ERROR).otherwise(F.concat("text", F.lit("; HTTP 500")))
    return V.table(spark, sf, "documents").select("doc_id", T.reason_key(error).alias("reason"))


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_per_source(spark, sf):
    return first_per(V.table(spark, sf, "documents").select("source", "doc_id"), ["source"], ["doc_id"])


# --- whole run ---------------------------------------------------------------------
_RUN = f"""{_TOPPED}, {Q.LEDGER},
nq AS (SELECT query, seq, seq % 3 + 1 AS wave_no FROM (SELECT query, substr(query, 2)::INT AS seq FROM q)),
pq AS (SELECT *, row_number() OVER (PARTITION BY wave_no ORDER BY seq) AS query_no FROM nq WHERE seq % 10 <> 9),
found AS (SELECT wave_no, url, query_no, engine_seq, rank FROM (SELECT * FROM topped JOIN pq USING (query))
  QUALIFY row_number() OVER (PARTITION BY wave_no, url ORDER BY query_no, engine_seq, rank) = 1),
fresh AS (SELECT *, row_number() OVER (PARTITION BY wave_no ORDER BY query_no, engine_seq, rank) AS wave_pos FROM (
  SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY url ORDER BY wave_no, query_no, engine_seq, rank) = 1) f
  WHERE url NOT IN (SELECT url FROM ledger WHERE {Q.HANDLED}))"""


def _run(spark, sf):
    """Result queries as a plan of three waves; every tenth ran before, spelled differently."""
    q = V.result_queries(spark, sf)
    wave = (col("query_seq") % 3 + 1).alias("wave_no")
    # a wave's queries are one row each in the plan's input, and a plan row lists them
    plan = q.groupBy(wave).agg(F.transform(F.array_sort(F.collect_list(F.struct("query_seq", "query"))), lambda x: x["query"]).alias("queries")).select(
        "wave_no", F.concat(F.lit("Wave "), "wave_no").alias("wave_name"), F.concat(F.lit("p"), "wave_no").alias("platform"), "queries")
    done = q.filter("query_seq % 10 = 9").select(F.concat(F.lit(" "), F.upper("query")).alias("query"))
    return B.run_waves(plan, done, HT.primary_hits(V.raw_primary(spark, sf)), HT.secondary_hits(V.raw_secondary(spark, sf), _ALL_RESULTS), V.query_log(spark, sf),
                       V.ledger(spark, sf), V.as_of(), B.Settings(num_waves=3, queries_per_wave=1_000_000, max_results=_ALL_RESULTS))


@query(f"""WITH {_RUN} SELECT wave_no, url, wave_pos, (wave_pos - 1) // 5 + 1 AS batch_no, 'W' || wave_no || ':p' || wave_no AS wave_tag
FROM fresh WHERE wave_pos <= 30""")
def run_batches(spark, sf):
    return _run(spark, sf).todo.select("wave_no", "url", "wave_pos", "batch_no", "wave_tag")


@query(f"""WITH {_RUN}, w AS (SELECT f.wave_no AS wave, r.url IS NULL AS duplicate, coalesce(r.wave_pos <= 30, false) AS taken
  FROM found f LEFT JOIN fresh r ON r.url = f.url AND r.wave_no = f.wave_no)
SELECT wave, grouping(wave) = 1 AS is_total, count(*) AS found, count(*) FILTER (duplicate) AS duplicates, count(*) FILTER (taken) AS fresh FROM w GROUP BY ROLLUP (wave)""")
def run_report(spark, sf):
    return _run(spark, sf).report
