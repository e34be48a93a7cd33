"""DuckDB SQL twins of the registered queries (the correctness cross-check).

The fixture views are spelled out as CTEs over the pre-registered tables.
"""

from __future__ import annotations

from ..functions.pii_patterns import patterns

V_REQUESTS = """gw_requests AS (
  SELECT event_id AS request_id, ts, user_id AS tenant,
         CASE WHEN event_type IN ('view', 'click') THEN 'HIT' ELSE 'MISS' END AS outcome,
         CAST(floor(value) AS BIGINT) AS latency_ms,
         CASE WHEN event_type IN ('view', 'click')
              THEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) / 1000.0::DOUBLE END AS distance
  FROM events WHERE event_type <> 'error')"""

V_PII = """gw_pii AS (
  SELECT event_id, ts,
         (['CREDIT_CARD', 'EMAIL_ADDRESS', 'IBAN_CODE', 'IP_ADDRESS', 'PHONE_NUMBER', 'US_SSN', 'PERSON'])
           [(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 7) + 1] AS entity,
         '[REDACTED] request ' || CAST(event_id AS VARCHAR) AS message
  FROM events WHERE event_type = 'error')"""

V_PAIRS = """gw_pairs AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

V_MESSAGES = """gw_messages AS (SELECT conv_id, turn, role, text AS content FROM conversations)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + ",\n"


def _runs_sql(gap_us: int, upto: str | None = None) -> str:
    where = f"WHERE ts <= TIMESTAMP '{upto}'" if upto else ""
    return f"""r AS (SELECT ts, request_id, latency_ms FROM gw_requests {where}),
o AS (SELECT ts, latency_ms,
        CASE WHEN lag(ts) OVER (ORDER BY ts, request_id) IS NULL
               OR epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, request_id)) >= {gap_us}
             THEN 1 ELSE 0 END AS nr,
        request_id FROM r),
s AS (SELECT ts, latency_ms, sum(nr) OVER (ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS run_id FROM o),
runs AS (SELECT CAST(run_id AS BIGINT) AS run_id, min(ts) AS run_start, max(ts) AS run_end,
                count(*) AS n_requests, CAST(sum(latency_ms) AS BIGINT) AS sum_latency_ms,
                sum(latency_ms) / count(*) AS avg_latency_ms
         FROM s GROUP BY run_id)"""


HOUR_US = 3_600_000_000

SQL: dict[str, str] = {}

SQL["metrics"] = with_views(V_REQUESTS, V_PII) + _runs_sql(24 * HOUR_US, "2024-01-31 00:00:00") + """,
last_run AS (SELECT * FROM runs ORDER BY run_end DESC LIMIT 1),
lat AS (SELECT coalesce(max(CASE WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(run_end) < 86400000000
                                 THEN avg_latency_ms END), 0.0) AS avg_latency_ms FROM last_run),
c AS (SELECT count(*) AS total_requests, count_if(outcome = 'HIT') AS cache_hits,
             count_if(outcome = 'MISS') AS cache_misses
      FROM gw_requests WHERE ts <= TIMESTAMP '2024-01-31 00:00:00'),
p AS (SELECT count(*) AS pii_blocked FROM gw_pii WHERE ts <= TIMESTAMP '2024-01-31 00:00:00')
SELECT c.total_requests, c.cache_hits, c.cache_misses, p.pii_blocked,
       round(lat.avg_latency_ms, 6) AS avg_latency_ms,
       c.cache_hits * 1500 AS tokens_saved,
       round(c.cache_hits * 1500 * 0.000002::DOUBLE, 6) AS estimated_cost_saved,
       round(CASE WHEN c.total_requests > 0 THEN c.cache_hits / c.total_requests * 100.0::DOUBLE ELSE 0.0 END, 6)
         AS cache_hit_rate,
       1 AS active_tenants
FROM c, p, lat"""

SQL["traffic_by_minute"] = with_views(V_REQUESTS)[:-2] + """
SELECT strftime(ts, '%Y%m%d%H%M') AS bucket, count(*) AS total_requests,
       count_if(outcome = 'HIT') AS cache_hits
FROM gw_requests GROUP BY 1"""

SQL["timeline"] = with_views(V_REQUESTS) + """spine AS (
  SELECT i AS point, TIMESTAMP '2024-01-15 12:00:30' + (i - 29) * INTERVAL 1 MINUTE AS t FROM range(30) r(i)),
m AS (SELECT strftime(ts, '%Y%m%d%H%M') AS bucket, count(*) AS total_requests,
             count_if(outcome = 'HIT') AS cache_hits FROM gw_requests GROUP BY 1)
SELECT point, strftime(t, '%H:%M') AS time, strftime(t, '%Y%m%d%H%M') AS bucket,
       coalesce(m.total_requests, 0) AS total_requests, coalesce(m.cache_hits, 0) AS cache_hits
FROM spine LEFT JOIN m ON m.bucket = strftime(t, '%Y%m%d%H%M')"""

SQL["latency_by_run"] = with_views(V_REQUESTS) + _runs_sql(30 * 60_000_000) + """
SELECT run_id, run_start, run_end, n_requests, sum_latency_ms, round(avg_latency_ms, 6) AS avg_latency_ms
FROM runs"""

SQL["avg_latency_current"] = with_views(V_REQUESTS) + _runs_sql(30 * 60_000_000, "2024-01-30 23:59:00") + """,
last_run AS (SELECT * FROM runs ORDER BY run_end DESC LIMIT 1),
open_run AS (SELECT * FROM last_run
             WHERE epoch_us(TIMESTAMP '2024-01-30 23:59:00') - epoch_us(run_end) < 1800000000)
SELECT TIMESTAMP '2024-01-30 23:59:00' AS as_of, coalesce(max(n_requests), 0) AS n_requests,
       round(coalesce(max(avg_latency_ms), 0.0), 6) AS avg_latency_ms FROM open_run"""

_HIT_EVENTS = """hit_ev AS (
  SELECT request_id AS event_id, ts, 'cache_hit' AS type,
         'Cache HIT · distance ' || printf('%.4f', distance) AS message,
         'Latency: ' || CAST(latency_ms AS VARCHAR) || 'ms' AS detail,
         printf('%.4f', distance) AS meta_distance, CAST(latency_ms AS VARCHAR) AS meta_latency,
         NULL::VARCHAR AS meta_entity
  FROM gw_requests WHERE outcome = 'HIT')"""
_PII_EVENTS = """pii_ev AS (
  SELECT event_id, ts, 'pii_blocked' AS type, message, 'Entity: ' || entity AS detail,
         NULL::VARCHAR AS meta_distance, NULL::VARCHAR AS meta_latency, entity AS meta_entity
  FROM gw_pii),
all_ev AS (SELECT * FROM hit_ev UNION ALL SELECT * FROM pii_ev)"""

SQL["hit_events"] = with_views(V_REQUESTS, _HIT_EVENTS)[:-2] + "\nSELECT * FROM hit_ev"
SQL["event_ring"] = with_views(V_REQUESTS, V_PII, _HIT_EVENTS, _PII_EVENTS)[:-2] + \
    "\nSELECT * FROM all_ev ORDER BY ts DESC, event_id DESC LIMIT 100"
SQL["event_feed"] = with_views(V_REQUESTS, V_PII, _HIT_EVENTS, _PII_EVENTS)[:-2] + \
    "\nSELECT * FROM all_ev ORDER BY ts DESC, event_id DESC LIMIT 50"

SQL["request_outcome"] = with_views(V_REQUESTS)[:-2] + """
SELECT request_id, ts, outcome AS cache, latency_ms,
       CASE WHEN outcome = 'HIT' THEN distance END AS similarity,
       false AS pii_detected, '' AS pii_entities
FROM gw_requests"""

V_VEC = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""
V_DIST = """d AS (SELECT q.vec_id, c.vec_id AS match_id, 1 - list_cosine_similarity(q.e, c.e) AS distance
       FROM v q JOIN v c ON q.vec_id <> c.vec_id),
nn AS (SELECT vec_id, match_id, distance FROM d
       QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, match_id) = 1)"""

SQL["knn1"] = with_views(V_VEC, V_DIST)[:-2] + """
SELECT vec_id, match_id, round(distance, 4) AS distance FROM nn"""

SQL["hit_decision"] = with_views(V_VEC, V_DIST)[:-2] + """
SELECT vec_id, match_id, round(distance, 4) AS distance,
       CASE WHEN distance <= 0.62 THEN 'HIT' ELSE 'MISS' END AS outcome FROM nn"""

SQL["near_misses"] = with_views(V_VEC, V_DIST)[:-2] + """
SELECT vec_id, match_id, round(distance, 4) AS distance FROM nn WHERE distance > 0.62"""

SQL["neighbor_pairs"] = with_views(V_VEC)[:-2] + """
SELECT a.vec_id AS src_id, b.vec_id AS dst_id, round(1 - list_cosine_similarity(a.e, b.e), 4) AS distance
FROM v a JOIN v b ON a.vec_id < b.vec_id
WHERE 1 - list_cosine_similarity(a.e, b.e) <= 0.62"""

SQL["cache_replay"] = "WITH RECURSIVE " + ",\n".join([V_VEC, """e AS (
  SELECT a.vec_id AS src, b.vec_id AS dst, 1 - list_cosine_similarity(a.e, b.e) AS distance
  FROM v a JOIN v b ON a.vec_id < b.vec_id
  WHERE 1 - list_cosine_similarity(a.e, b.e) <= 0.62)""", """nb AS (SELECT dst, list(src) AS srcs FROM e GROUP BY dst)""",
    """o AS (SELECT v.vec_id, row_number() OVER (ORDER BY v.vec_id) AS rn,
             coalesce(nb.srcs, []::BIGINT[]) AS srcs
      FROM v LEFT JOIN nb ON nb.dst = v.vec_id)""",
    """walk(rn, leaders) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT o.rn, CASE WHEN len(list_intersect(w.leaders, o.srcs)) > 0 THEN w.leaders
                    ELSE list_append(w.leaders, o.vec_id) END
  FROM walk w JOIN o ON o.rn = w.rn + 1)""",
    """fin AS (SELECT unnest(leaders) AS vec_id FROM (SELECT leaders FROM walk ORDER BY rn DESC LIMIT 1))""",
    """best AS (SELECT dst AS vec_id, src AS match_id, distance FROM e JOIN fin ON fin.vec_id = e.src
         QUALIFY row_number() OVER (PARTITION BY dst ORDER BY distance, src) = 1)"""]) + """
SELECT v.vec_id, CASE WHEN fin.vec_id IS NULL THEN 'HIT' ELSE 'MISS' END AS outcome,
       CASE WHEN fin.vec_id IS NULL THEN best.match_id END AS match_id,
       CASE WHEN fin.vec_id IS NULL THEN round(best.distance, 4) END AS distance
FROM v LEFT JOIN fin ON fin.vec_id = v.vec_id LEFT JOIN best ON best.vec_id = v.vec_id"""

# equal arrival times are decided by id, so the order is that of the ids
SQL["cache_replay_ties"] = SQL["cache_replay"]

# the even vectors are entries from the start, the odd ones are walked
SQL["cache_replay_warm"] = (SQL["cache_replay"]
    .replace("FROM v a JOIN v b ON a.vec_id < b.vec_id",
             "FROM v a JOIN v b ON b.vec_id % 2 = 1 AND (a.vec_id % 2 = 0 OR a.vec_id < b.vec_id)")
    .replace("LEFT JOIN nb ON nb.dst = v.vec_id)", "LEFT JOIN nb ON nb.dst = v.vec_id WHERE v.vec_id % 2 = 1)")
    .replace("SELECT 0::BIGINT, []::BIGINT[]", "SELECT 0::BIGINT, (SELECT list(vec_id) FROM v WHERE vec_id % 2 = 0)")
    + " WHERE v.vec_id % 2 = 1")

SQL["knn1_pivots"] = SQL["knn1"]
SQL["neighbor_pairs_pivots"] = SQL["neighbor_pairs"]

# the walk carries the entries and the match of the row just decided; a store ends the entry of its key
SQL["cache_replay_keys"] = "WITH RECURSIVE " + ",\n".join([V_VEC, """e AS (
  SELECT a.vec_id AS src, b.vec_id AS dst, 1 - list_cosine_similarity(a.e, b.e) AS distance
  FROM v a JOIN v b ON a.vec_id < b.vec_id
  WHERE 1 - list_cosine_similarity(a.e, b.e) <= 0.62)""",
    """nb AS (SELECT dst, list(src ORDER BY distance, src) AS srcs FROM e GROUP BY dst)""",
    """o AS (SELECT v.vec_id, row_number() OVER (ORDER BY v.vec_id) AS rn,
             coalesce(nb.srcs, []::BIGINT[]) AS srcs
      FROM v LEFT JOIN nb ON nb.dst = v.vec_id)""",
    """walk(rn, entries, vec_id, match_id) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT rn, CASE WHEN m IS NOT NULL THEN entries
                  ELSE list_append(list_filter(entries, lambda x: x % 40 <> vec_id % 40), vec_id) END, vec_id, m
  FROM (SELECT o.rn, w.entries, o.vec_id, list_filter(o.srcs, lambda x: list_contains(w.entries, x))[1] AS m
        FROM walk w JOIN o ON o.rn = w.rn + 1))"""]) + """
SELECT w.vec_id, CASE WHEN match_id IS NULL THEN 'MISS' ELSE 'HIT' END AS outcome, match_id,
       round(e.distance, 4) AS distance
FROM walk w LEFT JOIN e ON e.src = w.match_id AND e.dst = w.vec_id WHERE w.rn > 0"""

KEY_SQL = "'prompt:' || left(sha256(regexp_replace(lower({t}), '^\\s+|\\s+$', '', 'g')), 32)"
TRIM_SQL = "regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
UUID_SQL = ("substring({h}, 1, 8) || '-' || substring({h}, 9, 4) || '-' || substring({h}, 13, 4) || '-' "
            "|| substring({h}, 17, 4) || '-' || substring({h}, 21, 12)")

SQL["last_prompt"] = """
SELECT conv_id, coalesce(arg_max(text, turn), '') AS prompt, arg_max(role, turn) AS last_role
FROM conversations GROUP BY conv_id"""

SQL["message_filter"] = """
SELECT conv_id, turn, role, text AS content FROM conversations
WHERE coalesce(role, '') <> '' AND text IS NOT NULL"""

SQL["prompt_key"] = f"""
SELECT conv_id, turn, {KEY_SQL.format(t='text')} AS key FROM conversations"""

SQL["session_clean"] = """
SELECT conv_id, count(*) AS message_count, min(turn) AS first_turn, max(turn) AS last_turn,
       arg_max(role, turn) AS last_role
FROM conversations WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> '' GROUP BY conv_id"""

SQL["session_id_valid"] = f"""
WITH u AS (SELECT conv_id, turn, {UUID_SQL.format(h='md5(text)')} AS u FROM conversations),
s AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN u WHEN 1 THEN upper(u) ELSE substring(u, 1, 35) END
             AS session_id FROM u)
SELECT conv_id, turn, session_id,
       coalesce(regexp_matches(session_id,
         '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$', 'i'), false) AS valid
FROM s"""

_SESSION_LOG = f"""log AS (
  SELECT {UUID_SQL.format(h='md5(CAST(conv_id AS VARCHAR))')} AS session_id,
         TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 60 + turn) * INTERVAL 1 MINUTE AS updated_at,
         'save' AS op, conv_id, role, text, CASE WHEN turn % 2 = 0 THEN '{{"turn":' || turn || '}}' END AS meta
  FROM conversations
  UNION ALL
  SELECT {UUID_SQL.format(h='md5(CAST(conv_id AS VARCHAR))')},
         TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 60 + turn + 1) * INTERVAL 1 MINUTE,
         'delete', NULL, NULL, NULL, NULL
  FROM (SELECT conv_id, arg_max(role, turn) AS last_role, max(turn) AS turn FROM conversations GROUP BY conv_id)
  WHERE last_role = 'user')"""

SQL["session_load"] = "WITH " + _SESSION_LOG + """,
latest AS (SELECT * FROM log WHERE updated_at <= TIMESTAMP '2024-01-09 12:00:00'
           QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, (op = 'delete') DESC) = 1),
alive AS (SELECT * FROM latest
          WHERE op = 'save' AND epoch(TIMESTAMP '2024-01-09 12:00:00') - epoch(updated_at) < 604800)
SELECT r.session_id, a.updated_at IS NOT NULL AS found,
       CASE WHEN a.conv_id % 3 = 0 AND a.conv_id % 5 <> 4 THEN 'own-model' ELSE 'llama-3.3-70b-versatile' END AS model,
       a.updated_at, CASE WHEN a.conv_id % 5 <> 4 THEN 2 ELSE 0 END AS n_messages,
       CASE WHEN a.conv_id % 5 <> 4 THEN a.role END AS role, CASE WHEN a.conv_id % 5 <> 4 THEN a.text END AS content,
       CASE WHEN a.conv_id % 5 <> 4 THEN a.meta END AS meta
FROM (SELECT DISTINCT session_id FROM log) r LEFT JOIN alive a USING (session_id)"""

SQL["session_saved"] = "WITH " + _SESSION_LOG + """
SELECT session_id, updated_at, role, text AS content, meta FROM log
WHERE op = 'save' AND conv_id % 5 <> 4 AND role IN ('user', 'assistant') AND coalesce(text, '') <> ''"""

SQL["preview_chars"] = """
SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '…' ELSE text END AS preview,
       CASE WHEN length(text) > 80 THEN left(text, 80) ELSE text END AS preview80,
       CAST(length(text) AS BIGINT) AS n_chars
FROM documents"""

SQL["preview_bytes"] = """
WITH k AS (SELECT doc_id, text,
                  list_max(list_filter(range(0, 61), lambda i: strlen(left(text, i)) <= 60)) AS k
           FROM documents)
SELECT doc_id,
       CASE WHEN strlen(text) > 60
            THEN left(text, k) || CASE WHEN strlen(left(text, k)) < 60 THEN '�' ELSE '' END || '…'
            ELSE text END AS preview,
       CAST(strlen(text) AS BIGINT) AS n_bytes
FROM k"""

_CACHE = V_PAIRS + f""",
w AS (SELECT {KEY_SQL.format(t='prompt')} AS key, prompt AS original_text,
             {TRIM_SQL.format(t='response')} AS response_text, conv_id, turn FROM gw_pairs),
c AS (SELECT * FROM w WHERE coalesce(original_text, '') <> '' AND coalesce(response_text, '') <> ''
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY conv_id DESC, turn DESC) = 1)"""

SQL["cache_upsert"] = "WITH " + _CACHE + """
SELECT key, original_text, response_text, conv_id, turn FROM c"""

SQL["cache_list"] = "WITH " + _CACHE + """
SELECT key, original_text AS prompt,
       CASE WHEN length(response_text) > 120 THEN left(response_text, 120) || '…' ELSE response_text END
         AS response_preview,
       CAST(length(response_text) AS BIGINT) AS response_length
FROM (SELECT * FROM c ORDER BY key LIMIT 50) WHERE coalesce(original_text, '') <> ''"""

SQL["cache_stats"] = "WITH " + _CACHE + """
SELECT count(DISTINCT key) AS entry_count, 64 AS embedding_dim, 0.62::DOUBLE AS threshold,
       'gemini-embedding-001' AS model FROM c"""

_USER_TURNS = """WITH users AS (
  SELECT u.conv_id, u.turn, u.text, 1 + (a.turn IS NOT NULL)::INT + (b.turn IS NOT NULL)::INT AS n
  FROM conversations u
  LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn - 1
  LEFT JOIN conversations b ON b.conv_id = u.conv_id AND b.turn = u.turn - 2
  WHERE u.role = 'user')"""

SQL["request_parse"] = _USER_TURNS + """
SELECT conv_id, turn, CASE WHEN conv_id % 7 = 6 THEN 'llama-3.3-70b-versatile' END AS model,
       CASE WHEN conv_id % 7 = 6 THEN n ELSE 1 END::BIGINT AS n_messages, conv_id % 7 = 6 AND turn = 0 AS stream,
       CASE conv_id % 7 WHEN 3 THEN '7' WHEN 4 THEN '[map[text:' || text || ' type:text]]' ELSE text END AS prompt
FROM users WHERE conv_id % 7 IN (3, 4, 6)"""

SQL["request_rejected"] = _USER_TURNS + "\nSELECT conv_id, turn FROM users WHERE conv_id % 7 IN (0, 1, 2, 5)"

SQL["sse_text"] = "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'"
SQL["sse_chunks"] = SQL["sse_text"]
SQL["json_text"] = """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '{"choices":[{"message":{"content":5}}]}' ELSE text END AS text
FROM conversations WHERE role = 'assistant'"""

SQL["embed_new"] = r"""
WITH t AS (
  SELECT DISTINCT regexp_replace(text, '^\s+|\s+$', '', 'g') AS text,
         CASE WHEN role = 'user' THEN 'SEMANTIC_SIMILARITY' ELSE 'RETRIEVAL_DOCUMENT' END AS task_type
  FROM conversations
), b AS (
  SELECT text, task_type, list_transform(
           list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''),
           lambda w: (position(md5(w)[1] IN '0123456789abcdef') - 1) % 8) AS b
  FROM t WHERE text <> ''
)
SELECT sha256(text) AS text_key, task_type, CASE WHEN task_type = 'SEMANTIC_SIMILARITY' THEN 0 ELSE 1 END AS run,
       array_to_string(list_transform(range(0, 8), lambda i: len(list_filter(b, lambda x: x = i))), ' ') AS buckets
FROM b"""

SQL["event_decode"] = with_views(V_REQUESTS, V_PII)[:-2] + """
SELECT 'cache_hit' AS type, 'Cache HIT · distance ' || printf('%.4f', distance) AS message,
       'Latency: ' || CAST(latency_ms AS VARCHAR) || 'ms' AS detail,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, date_trunc('second', ts) AS ts,
       printf('%.4f', distance) AS meta_distance, CAST(latency_ms AS VARCHAR) AS meta_latency,
       NULL::VARCHAR AS meta_entity
FROM gw_requests WHERE outcome = 'HIT'
UNION ALL
SELECT 'pii_blocked', message, 'Entity: ' || entity,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END
         || '+00:00', ts, NULL, NULL, entity
FROM gw_pii"""


def _pii_cascade_sql(source: str, key_cols: str, text: str) -> str:
    """CTE chain s0..s6 replaying the redaction cascade with RE2 patterns."""
    from ..functions.pii_patterns import patterns

    pats = patterns("re2")
    parts = [f"s0 AS (SELECT {key_cols}, {text} AS _orig, coalesce({text}, '') AS t0 FROM {source})"]
    for i, (entity, pat) in enumerate(pats, start=1):
        parts.append(f"s{i} AS (SELECT *, regexp_matches(t{i-1}, '{pat}') AS f{i}, "
                     f"regexp_replace(t{i-1}, '{pat}', '<{entity}>', 'g') AS t{i} FROM s{i-1})")
    n = len(pats)
    flags = ", ".join(f"CASE WHEN f{i} THEN '{e}' END" for i, (e, _) in enumerate(pats, start=1))
    parts.append(f"red AS (SELECT *, CASE WHEN _orig IS NULL THEN NULL ELSE t{n} END AS sanitized_text, "
                 f"list_sort(list_filter([{flags}], lambda x: x IS NOT NULL)) AS ents FROM s{n})")
    return ",\n".join(parts)


SQL["pii_redact"] = "WITH " + _pii_cascade_sql("documents", "doc_id", "text") + \
    "\nSELECT doc_id, sanitized_text FROM red"

SQL["pii_entities"] = "WITH " + _pii_cascade_sql("documents", "doc_id", "text") + \
    "\nSELECT doc_id, array_to_string(ents, ',') AS entities, len(ents) > 0 AS has_pii FROM red"


def _pii_matches_sql() -> str:
    from ..functions.pii_patterns import patterns

    cols = ",\n       ".join(
        f"CAST(len(regexp_extract_all(coalesce(text, ''), '{p}')) AS BIGINT) AS n_{e.lower()}"
        for e, p in patterns("re2"))
    return f"SELECT doc_id,\n       {cols}\nFROM documents"


SQL["pii_matches"] = _pii_matches_sql()


def _luhn_sql() -> str:
    from ..functions.pii_patterns import patterns

    card = dict(patterns("re2"))["CREDIT_CARD"]
    return f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{card}')) AS cand
           FROM documents),
d AS (SELECT doc_id, regexp_replace(cand, '[^0-9]', '', 'g') AS ds FROM c),
l AS (SELECT doc_id,
             list_sum(list_transform(range(length(ds)), lambda i:
               CASE WHEN i % 2 = 0 THEN CAST(substring(ds, length(ds) - i, 1) AS INTEGER)
                    ELSE (CAST(substring(ds, length(ds) - i, 1) AS INTEGER) * 2) % 10
                         + (CAST(substring(ds, length(ds) - i, 1) AS INTEGER) * 2) // 10 END)) % 10 = 0
               AS ok
      FROM d),
g AS (SELECT doc_id, count(*) AS n_c, count_if(ok) AS n_v FROM l GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(g.n_c, 0) AS BIGINT) AS n_card_candidates,
       CAST(coalesce(g.n_v, 0) AS BIGINT) AS n_card_valid
FROM documents LEFT JOIN g ON g.doc_id = documents.doc_id"""


SQL["pii_cards_valid"] = _luhn_sql()

_NUMBERS = """acc AS (
  SELECT doc_id, text AS body, lpad(CAST((doc_id * 7919) % 1000000000 AS VARCHAR), 18, '0') AS account FROM documents
), chk AS (
  SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'GB' ELSE 'DE' END AS country, CASE WHEN doc_id % 2 = 0
    THEN lpad(CAST(98 - CAST(account || '131400' AS HUGEINT) % 97 AS VARCHAR), 2, '0') ELSE '42' END AS digits FROM acc
), numbered AS (
  SELECT doc_id, country, digits, account, 'Pay to ' || country || digits || account || ', ssn 123-45-'
    || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '. ' || coalesce(body, '') AS text FROM chk)"""

SQL["pii_iban_valid"] = "WITH " + _NUMBERS + f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '{dict(patterns("re2"))["IBAN_CODE"]}')) AS BIGINT) AS n_iban_candidates,
       CASE WHEN CAST(account || CASE country WHEN 'DE' THEN '1314' ELSE '1611' END || digits AS HUGEINT) % 97 = 1 THEN 1 ELSE 0 END::BIGINT AS n_iban_valid
FROM numbered"""


# the bodies hold no IBAN, so one that fails its check is as good as not there
SQL["pii_redact_numbers"] = "WITH " + _NUMBERS + ",\n" + _pii_cascade_sql("""(SELECT doc_id, CASE
  WHEN CAST(account || CASE country WHEN 'DE' THEN '1314' ELSE '1611' END || digits AS HUGEINT) % 97 = 1 THEN text
  ELSE replace(text, country || digits || account, 'x') END AS text FROM numbered)""", "doc_id", "text") + \
    "\nSELECT doc_id, array_to_string(ents, ',') AS entities FROM red"


def _spans_sql() -> str:
    """Spans level by level: a match counts unless it overlaps one that counts of a level before."""
    from ..functions.pii_patterns import CHECKS, SCORES, patterns

    parts, kept = [_NUMBERS], []
    for k, (entity, pat) in enumerate(patterns("re2")):
        parts.append(f"""m{k} AS (
  SELECT doc_id, i, unnest_value AS value, CAST(length(piece) AS INT) AS gap FROM (
    SELECT doc_id, unnest(range(len(vals))) AS i, unnest(vals) AS unnest_value, unnest(pieces[1:len(vals)]) AS piece
    FROM (SELECT doc_id, regexp_extract_all(text, '{pat}') AS vals, string_split_regex(text, '{pat}') AS pieces FROM numbered)))""")
        clash = " AND ".join(f"NOT EXISTS (SELECT 1 FROM k{j} WHERE k{j}.doc_id = p.doc_id AND k{j}.s < p.e AND p.s < k{j}.e)" for j in kept)
        parts.append(f"""k{k} AS (
  SELECT * FROM (SELECT doc_id, '{entity}' AS entity, value, e - length(value) AS s, e FROM (
    SELECT *, sum(gap + length(value)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM m{k})) p{' WHERE ' + clash if clash else ''})""")
        kept.append(k)
    luhn = """list_sum(list_transform(range(length(ds)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substring(ds, length(ds) - i, 1) AS INTEGER)
      ELSE (CAST(substring(ds, length(ds) - i, 1) AS INTEGER) * 2) % 10
           + (CAST(substring(ds, length(ds) - i, 1) AS INTEGER) * 2) // 10 END)) % 10 = 0"""
    iban = ("left(value, 2) IN ('DE', 'GB') AND length(value) = 22 AND TRY_CAST(substring(value, 5) || CASE left(value, 2) "
            "WHEN 'DE' THEN '1314' ELSE '1611' END || substring(value, 3, 2) AS HUGEINT) % 97 = 1")
    scores = " ".join(f"WHEN '{e}' THEN {s}::DOUBLE" for e, s in SCORES.items())
    assert set(CHECKS) == {"CREDIT_CARD", "IBAN_CODE"}
    return "WITH " + ",\n".join(parts) + f""",
every AS ({" UNION ALL ".join(f"SELECT * FROM k{k}" for k in kept)}),
d AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS ds FROM every)
SELECT doc_id, entity, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", CASE
  WHEN entity = 'CREDIT_CARD' AND {luhn} THEN 1.0::DOUBLE WHEN entity = 'IBAN_CODE' AND {iban} THEN 1.0::DOUBLE
  ELSE CASE entity {scores} END END AS score, value FROM d"""


SQL["pii_spans"] = _spans_sql()

SQL["pii_person"] = r"""
WITH RECURSIVE names AS (
  SELECT DISTINCT array_to_string(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')[1:(conv_id + turn) % 3 + 1], ' ') AS name
  FROM conversations
), split AS (
  SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+') AS w,
         string_split_regex(text, '[\p{L}\p{M}\p{N}_]+') AS g
  FROM documents
), each AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w, unnest(g[1:len(w)]) AS g FROM split
), words AS (
  SELECT doc_id, i, w, sum(length(g)) OVER x + sum(length(w)) OVER x - length(w) AS start,
         lead(g) OVER x AS g2, lead(w) OVER x AS w2, lead(g, 2) OVER x AS g3, lead(w, 2) OVER x AS w3
  FROM each WINDOW x AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
  SELECT doc_id, i, 1 AS k, start, w AS name, start + length(w) AS "end" FROM words
  UNION ALL
  SELECT doc_id, i, 2, start, w || ' ' || w2, start + length(w) + length(g2) + length(w2)
  FROM words WHERE regexp_full_match(g2, '\s+')
  UNION ALL
  SELECT doc_id, i, 3, start, w || ' ' || w2 || ' ' || w3, start + length(w) + length(g2) + length(w2) + length(g3) + length(w3)
  FROM words WHERE regexp_full_match(g2, '\s+') AND regexp_full_match(g3, '\s+')
), hits AS (
  SELECT r.* FROM runs r JOIN names n ON n.name = r.name AND n.name <> ''
  QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY k DESC) = 1
), nexts AS (
  SELECT a.*, b.i AS following FROM hits a ASOF LEFT JOIN hits b ON a.doc_id = b.doc_id AND a.i + a.k <= b.i
), kept AS (
  SELECT * FROM nexts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1
  UNION ALL
  SELECT n.* FROM kept k JOIN nexts n ON n.doc_id = k.doc_id AND n.i = k.following
)
SELECT doc_id, 'PERSON' AS entity, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", name AS value FROM kept"""

_PII_EV = "WITH " + _pii_cascade_sql("documents", "doc_id", "text") + """,
ev AS (SELECT doc_id, unnest(ents) AS entity,
              '[REDACTED] ' || CASE WHEN length(sanitized_text) > 80 THEN left(sanitized_text, 80)
                                    ELSE sanitized_text END AS message
       FROM red WHERE len(ents) > 0)"""

SQL["pii_events"] = _PII_EV + "\nSELECT doc_id, entity, message, 'Entity: ' || entity AS detail FROM ev"
SQL["pii_counts"] = _PII_EV + "\nSELECT entity, count(*) AS blocks FROM ev GROUP BY entity"

SQL["pii_last_message"] = "WITH " + _pii_cascade_sql(
    "(SELECT c.*, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations c)",
    "conv_id, turn, role, last_turn", "text") + """
SELECT conv_id, turn, role, turn = last_turn AS scrubbed,
       CASE WHEN turn = last_turn THEN sanitized_text ELSE _orig END AS sanitized,
       CASE WHEN turn = last_turn THEN array_to_string(ents, ',') ELSE '' END AS entities
FROM red"""

SQL["replay_metrics"] = SQL["cache_replay"].replace(
    "\nSELECT v.vec_id, CASE WHEN fin.vec_id IS NULL THEN 'HIT' ELSE 'MISS' END AS outcome,", """,
res AS (SELECT v.vec_id, CASE WHEN fin.vec_id IS NULL THEN 'HIT' ELSE 'MISS' END AS outcome,""").replace(
    "LEFT JOIN best ON best.vec_id = v.vec_id", """LEFT JOIN best ON best.vec_id = v.vec_id)
SELECT count(*) AS total_requests, count_if(outcome = 'HIT') AS cache_hits, count_if(outcome = 'MISS') AS cache_misses,
       count_if(outcome = 'MISS') AS entries_stored, count_if(outcome = 'HIT') * 1500 AS tokens_saved,
       round(count_if(outcome = 'HIT') * 1500 * 0.000002::DOUBLE, 6) AS estimated_cost_saved,
       round(count_if(outcome = 'HIT') / count(*) * 100.0::DOUBLE, 6) AS cache_hit_rate
FROM res""")

SQL["neighbor_counts"] = with_views(V_VEC)[:-2] + """,
d AS (SELECT b.vec_id, a.vec_id AS src, 1 - list_cosine_similarity(a.e, b.e) AS distance
      FROM v a JOIN v b ON a.vec_id < b.vec_id),
c AS (SELECT vec_id, count_if(distance <= 0.62) AS n_within FROM d GROUP BY vec_id),
n AS (SELECT vec_id, src AS nearest_id, distance FROM d
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, src) = 1)
SELECT v.vec_id, CAST(coalesce(c.n_within, 0) AS BIGINT) AS n_within, n.nearest_id,
       round(n.distance, 4) AS distance
FROM v LEFT JOIN c ON c.vec_id = v.vec_id LEFT JOIN n ON n.vec_id = v.vec_id"""

SQL["neighbor_counts_pivots"] = with_views(V_VEC)[:-2] + """,
d AS (SELECT b.vec_id, a.vec_id AS src, 1 - list_cosine_similarity(a.e, b.e) AS distance
      FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE 1 - list_cosine_similarity(a.e, b.e) <= 0.62)
SELECT v.vec_id, count(d.src) AS n_within, arg_min(d.src, (d.distance, d.src)) AS nearest_id,
       round(min(d.distance), 4) AS distance
FROM v LEFT JOIN d ON d.vec_id = v.vec_id GROUP BY v.vec_id"""

SQL["stream_traffic"] = SQL["traffic_by_minute"]
SQL["stream_redaction"] = SQL["pii_redact"]
SQL["stream_runs"] = SQL["latency_by_run"].replace("SELECT run_id, run_start, run_end, n_requests", "SELECT run_start, n_requests")
SQL["stream_counters"] = with_views(V_REQUESTS)[:-2] + """
SELECT total_requests, cache_hits, cache_misses, cache_hits * 1500 AS tokens_saved,
       round(cache_hits * 1500 * 0.000002::DOUBLE, 6) AS estimated_cost_saved,
       round(cache_hits / total_requests * 100.0::DOUBLE, 6) AS cache_hit_rate
FROM (SELECT count(*) AS total_requests, count_if(outcome = 'HIT') AS cache_hits,
             count_if(outcome = 'MISS') AS cache_misses FROM gw_requests)"""
