"""SQL fragments shared by the twins of the registered queries."""

from __future__ import annotations

from leadspark import constants as K
from leadspark.plans.driver_views import AS_OF

TS = f"TIMESTAMP '{AS_OF}'"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{K.WS}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{K.WS}]+|[{K.WS}]+$', '', 'g')"


def clean(x: str) -> str:
    return f"(CASE WHEN lower({collapse(x)}) IN ({quoted(K.PLACEHOLDERS)}) THEN NULL ELSE {collapse(x)} END)"


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[^:/?#]+://(?:[^/?#]*@)?([^/?#:@]*)', 1))"


def netloc(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[^:/?#]+://([^/?#]*)', 1))"


def path(u: str) -> str:
    return f"regexp_replace(regexp_extract({u}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"


def platform(u: str) -> str:
    h = host(u)
    cases = " ".join(f"WHEN contains({h}, '{n}') THEN '{t}'" for n, t in K.PLATFORM_NEEDLES)
    return (f"(CASE {cases} WHEN contains({h}, 'forum') OR contains(lower({u}), '/forum') OR contains(lower({u}), '/thread') "
            f"THEN 'forum' WHEN regexp_replace({h}, '^www\\.', '') <> '' THEN regexp_replace({h}, '^www\\.', '') ELSE 'web' END)")


def useful(u: str) -> str:
    junk = " OR ".join(f"contains(lower({u}), '{s}')" for s in K.JUNK_SUBSTRINGS)
    return f"NOT ({junk} OR regexp_matches({path(u)}, '(?i)\\.({'|'.join(K.JUNK_EXTENSIONS)})$'))"


def _key(x: str) -> str:
    return f"lower(split_part({x}, '=', 1))"


# canon(page_id, url, html, canon): the canonical form, for URLs without escapes or redirects
CANON = f"""canon AS (
  SELECT page_id, url, html, CASE WHEN regexp_matches(url, '^https?://[^/?#]') THEN
    (CASE WHEN {' OR '.join(f"ends_with(h, '{x}')" for x in K.HTTPS_ONLY_HOSTS)} THEN 'https' ELSE s END) || '://' || h
    || (CASE WHEN length(p) > 1 THEN rtrim(p, '/') WHEN p = '' THEN '/' ELSE p END)
    || (CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END) END AS canon
  FROM (SELECT page_id, url, html, s, regexp_replace(regexp_replace(p0, ';[^/]*$', ''), '/{{2,}}', '/', 'g') AS p,
    CASE WHEN ends_with(h0, 'linkedin.com') THEN 'www.linkedin.com' WHEN ends_with(h0, 'reddit.com') THEN 'www.reddit.com'
         WHEN h0 IN ('quora.com') THEN 'www.quora.com'
         WHEN starts_with(h0, 'm.') AND length(h0) - length(replace(h0, '.', '')) >= 2 THEN 'www.' || substr(h0, 3)
         ELSE h0 END AS h,
    list_sort(list_filter(string_split(q0, '&'), lambda x: regexp_matches(x, '^[^=]*=.')
      AND NOT list_contains([{quoted(K.TRACKING_PARAMS)}], {_key('x')})
      AND NOT ({' OR '.join(f"starts_with({_key('x')}, '{t}')" for t in K.TRACKING_PREFIXES)}))) AS q
    FROM (SELECT page_id, url, html, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS s,
      rtrim({host('url')}, '.') AS h0, {path('url')} AS p0, regexp_extract(url, '\\?([^#]*)', 1) AS q0 FROM pages)))"""

TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"

HITS = f"""{CANON}, hits AS (
  SELECT 'q' || (page_id % 25) AS query, page_id % 25 AS query_seq, 'ddg' AS engine, page_id AS rank, canon AS url,
         {collapse(TITLE)} AS title FROM canon WHERE canon IS NOT NULL)"""

_LEDGER_STATUS = ("CASE WHEN event_id % 10 = 7 THEN NULL WHEN event_type = 'purchase' THEN 'ok' WHEN event_type = 'view' "
                  "THEN 'snippet' WHEN event_type = 'click' THEN 'pending' WHEN event_type = 'error' THEN 'failed' "
                  "WHEN event_type = 'signup' THEN 'quota' END")

LEDGER = f"""ledger AS (
  SELECT url, {netloc('url')} AS domain, tag AS wave_tag, status, ts AS scraped_at FROM (
    SELECT p.url, 'W' || (e.user_id % 3) || ':seed' AS tag, {_LEDGER_STATUS} AS status, e.ts,
           row_number() OVER (PARTITION BY p.url ORDER BY e.ts DESC, e.event_id DESC) AS rn
    FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)) WHERE rn = 1)"""

HANDLED = (f"NOT (coalesce(status, '') IN ('robots', 'quota') OR (status = 'pending' AND scraped_at < {TS} - INTERVAL 1 HOUR))")

WAVE_HITS = f"""{CANON}, wave_hits AS (
  SELECT page_id % 3 + 1 + k AS wave_no, page_id * 2 + k AS pos, canon AS url
  FROM canon CROSS JOIN (SELECT unnest([0, 1]) AS k))"""


def letters(x: str) -> str:
    return f"translate({x}::VARCHAR, '0123456789', 'abcdefghij')"


def initcap(x: str) -> str:
    return f"upper(substr({x}, 1, 1)) || lower(substr({x}, 2))"


PEOPLE = f"""people AS (
  SELECT k AS seq, who || ' ' || lower(seg) AS name, CASE WHEN k % 5 <> 0 THEN {initcap('seg')} END AS "current_role",
    [o_orderpriority, seg] AS skills,
    CASE WHEN k % 7 = 0 THEN 'Port ' || n_name WHEN k % 6 <> 0 THEN n_name || ', east' END AS current_location,
    [o_orderstatus] AS target_countries, 'order ' || k AS evidence_snippet,
    CASE WHEN k % 9 = 0 THEN 'alt.' || who || '@example.org' WHEN k % 3 = 0 THEN who || '@example.com' END AS email,
    CASE WHEN k % 20 = 0 THEN '+92' || num WHEN k % 4 = 0 THEN '+91' || num END AS phone,
    'https://people.example.org/' || k AS source_url, CASE WHEN k % 2 = 0 THEN 'forum' ELSE 'linkedin' END AS platform
  FROM (SELECT o_orderkey AS k, {letters('c_custkey')} AS who, lpad(c_custkey::VARCHAR, 8, '7') AS num, c_mktsegment AS seg,
          o_orderpriority, o_orderstatus, n_name FROM orders JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey))"""

STORED = f"""stored AS (
  SELECT 'c' || k AS id, who || ' ' || CASE WHEN k % 2 = 0 THEN lower(seg) ELSE 'other' END AS name,
    {initcap('seg')} AS "current_role", [seg] AS skills, CASE WHEN k % 3 <> 0 THEN n_name END AS current_location,
    ['F'] AS target_countries, 'customer ' || k AS evidence_snippet,
    CASE WHEN k % 4 = 0 THEN who || '@example.com' END AS email,
    CASE WHEN k % 5 = 0 THEN '+91' || lpad(k::VARCHAR, 8, '7') END AS phone,
    'https://stored.example.org/' || k AS source_url, CASE WHEN k % 10 <> 0 THEN lower(seg) END AS platform,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours((k % 1000)::INT) AS discovered_at,
    CASE WHEN k % 6 = 0 THEN 'posted_on_page' END AS contact_source, NULL::TIMESTAMP AS contact_shared_at,
    CASE WHEN k % 8 <> 0 THEN 'new' END AS outreach_status, NULL::VARCHAR AS outreach_message,
    NULL::TIMESTAMP AS outreach_sent_at, NULL::VARCHAR AS reply_text, NULL::TIMESTAMP AS replied_at
  FROM (SELECT c_custkey AS k, {letters('c_custkey')} AS who, c_mktsegment AS seg, n_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey))"""

RESPONSES = """responses AS (
  SELECT doc_id AS k, doc_id, 'https://docs.example.org/' || doc_id AS url,
    'https://docs.example.org/' || CASE WHEN doc_id % 17 = 3 THEN 'login/' ELSE '' END || doc_id AS final_url,
    CASE WHEN doc_id % 11 = 1 THEN 403 WHEN doc_id % 13 = 2 THEN 404 WHEN doc_id % 19 = 4 THEN 500 ELSE 200 END AS status,
    CASE WHEN doc_id % 23 = 5 THEN 'application/pdf' WHEN doc_id % 7 = 6 THEN '' ELSE 'text/html; charset=utf-8' END AS ctype,
    CASE WHEN doc_id % 3 = 0 THEN 'scrape.do' ELSE 'direct' END AS via, text FROM documents)"""

_WALL = K.WALL_PHRASES_RX.replace("(?iu)", "(?i)").replace("'", "''")
_WALLED = f"(length(text) < 250 OR (length(text) < 1200 AND NOT contains(text, '{K.THREAD_HEADING}') AND regexp_matches(text[1:3000], '{_WALL}')))"
_BLOCK = f"(status IN (401, 403, 407, 429, 999) OR regexp_matches({path('final_url')}, '{K.WALL_PATH_RX.replace('(?iu)', '(?i)')}'))"
_OTHER = "(ctype <> '' AND NOT contains(ctype, 'html') AND NOT contains(ctype, 'text'))"

OUTCOMES = f"""{RESPONSES}, outcomes AS (
  SELECT doc_id, url, via, text, NOT {_BLOCK} AND status < 400 AND NOT {_OTHER} AND NOT {_WALLED} AS ok,
    {_BLOCK} OR (status < 400 AND NOT {_OTHER} AND {_WALLED}) AS blocked,
    CASE WHEN {_BLOCK} THEN CASE WHEN status >= 400 THEN 'HTTP ' || status ELSE 'login wall' END
         WHEN status >= 400 THEN 'HTTP ' || status WHEN {_OTHER} THEN 'unsupported content-type ' || ctype[1:40]
         WHEN {_WALLED} THEN '{K.WALL_ERROR}' END AS error FROM responses)"""

RUN_EVENTS = """run_events AS (
  SELECT event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'saved' WHEN 'view' THEN 'dedup' WHEN 'click' THEN 'wave_end'
      WHEN 'error' THEN 'warning' WHEN 'signup' THEN 'wave_start' END AS kind,
    CASE WHEN event_id % 8 <> 0 THEN 'wave ' || (user_id % 5) END AS wave, event_type || ' by ' || user_id AS message,
    trunc(value * 100)::BIGINT AS n FROM events)"""

OUTREACH = """oev AS (
  SELECT 'c' || user_id AS id, event_id AS k, CASE event_id % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'status' ELSE 'reply' END AS kind,
    ['new', 'drafted', 'sent', 'replied', 'not_interested'][(event_id // 3) % 5 + 1] AS status,
    CASE WHEN event_id % 3 = 0 THEN 'hello ' || event_id WHEN event_id % 2 = 0 THEN 'note ' || event_id END AS message,
    CASE WHEN event_id % 3 = 2 THEN 'my mail is r' || event_id || '@example.net' END AS reply_text,
    CASE event_id % 4 WHEN 0 THEN false WHEN 1 THEN true END AS interested,
    CASE WHEN event_id % 5 = 0 THEN 'r' || event_id || '@example.net' END AS email,
    CASE WHEN event_id % 7 = 0 THEN '+9199' || lpad(event_id::VARCHAR, 8, '0') END AS phone, ts FROM events)"""

CHANGES = f"""{OUTREACH}, changes AS (
  SELECT id, count(*) > 0 AS hit,
    arg_max(CASE WHEN kind = 'draft' THEN 'drafted' WHEN kind = 'status' THEN status
                 WHEN interested = false THEN 'not_interested' ELSE 'replied' END, k) AS outreach_status,
    arg_max(message, k) FILTER (kind = 'draft' OR (kind = 'status' AND message IS NOT NULL)) AS outreach_message,
    max(ts) FILTER (kind = 'status' AND status = 'sent' AND k = last_sent) AS outreach_sent_at,
    arg_max(reply_text, k) FILTER (kind = 'reply') AS reply_text, arg_max(ts, k) FILTER (kind = 'reply') AS replied_at,
    arg_max(email, k) FILTER (kind = 'reply' AND email IS NOT NULL) AS email,
    arg_max(phone, k) FILTER (kind = 'reply' AND phone IS NOT NULL) AS phone,
    CASE WHEN bool_or(kind = 'reply' AND (email IS NOT NULL OR phone IS NOT NULL)) THEN 'shared_in_reply' END AS contact_source,
    arg_max(ts, k) FILTER (kind = 'reply' AND (email IS NOT NULL OR phone IS NOT NULL)) AS contact_shared_at
  FROM (SELECT *, max(CASE WHEN kind = 'status' AND status = 'sent' THEN k END) OVER (PARTITION BY id) AS last_sent FROM oev)
  GROUP BY id)"""
