"""SQL twins of the queries in `tables`, for DuckDB."""

from __future__ import annotations

from ..tables import contexts, file_scan
from ..tables.line_rules import LINE_RULES
from . import oracle as o
from .tables import OWN_RULE, SHARDS

_HISTORY = f"""{o.PLANTED},
bodies AS (SELECT (doc_id % {SHARDS})::INT AS shard, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS body FROM planted GROUP BY 1),
lines AS (
  SELECT shard, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no
  FROM (SELECT shard, string_split_regex(body || chr(10), {o.q(o._LINE_BREAK)})[:-2] AS parts FROM bodies))"""

_SPOILT = "CASE WHEN k % 25 = 3 THEN 'cut' WHEN k % 25 = 7 THEN 'list' WHEN k % 100 = 11 THEN 'blank' END"

_LOGS = f"""{o.EVENTS},
logs AS (
  SELECT *, event_id AS k, (event_id % {SHARDS})::INT AS shard, row_number() OVER (PARTITION BY event_id % {SHARDS} ORDER BY event_id) AS position
  FROM guarded),
judged AS (
  SELECT *, CASE WHEN k % 50 = 17 THEN 'field of another type' WHEN {_SPOILT} = 'cut' THEN 'not JSON' WHEN {_SPOILT} = 'list' THEN 'not an object' END AS problem
  FROM logs WHERE k % 50 = 17 OR {_SPOILT} IS DISTINCT FROM 'blank')"""

_PATH = ("CASE doc_id % 7 WHEN 0 THEN 'docs/' || doc_id WHEN 1 THEN '../' || doc_id WHEN 2 THEN '/docs/' || doc_id WHEN 3 THEN 'docs//' || doc_id "
         "WHEN 4 THEN 'docs/./' || doc_id WHEN 5 THEN 'docs/..' || doc_id ELSE 'docs/' || doc_id || '/' END")


def _safe(path: str) -> str:
    return rf"NOT ({path} = '' OR starts_with({path}, '/') OR regexp_matches({path}, '(^|/)(\.\.?)?(/|$)'))"


def oracle_sql(given: dict[str, str]) -> dict[str, str]:
    """``given`` are the twins of the other queries, some of which are read further here."""
    pages = f"WITH {o.PAGES}, {o.host_ctes('', 'planted_pages', 'page_id', 'html')}"
    decoded = f"reasons = ['{contexts.DECODED_SHELL_REASON}']"
    return {
        "history_lines": f"WITH {_HISTORY}, {o.verdict_ctes('lines', 'shard, line_no', 'line')} "
                         f"SELECT shard, line_no, line, code, {o._JOINED} FROM v_verdict JOIN lines USING (shard, line_no) WHERE code <> 0",
        "history_line_counts": f"WITH {_HISTORY} SELECT shard, count(*) AS lines, max(line_no) AS last, sum(line_no)::BIGINT AS total FROM lines GROUP BY shard",
        "chat_export_positions": f"""WITH {o.TURNS}, placed AS (
  SELECT *, CASE WHEN conv_id % {SHARDS} = 3 THEN conv_id % 48 ELSE conv_id % {SHARDS} END::INT AS shard FROM turns)
SELECT shard, row_number() OVER (PARTITION BY shard, conv_id % {SHARDS} ORDER BY conv_id, turn) AS position, lower(role) AS role, text FROM placed""",
        "chat_quarantine": f"""WITH {o.TURNS}, k AS (SELECT *, {_SPOILT} AS bad FROM (SELECT *, conv_id * 8 + turn AS k FROM turns))
SELECT conv_id, turn, CASE WHEN bad IN ('cut', 'blank') THEN 'not JSON' END AS problem,
       CASE WHEN bad IS NULL THEN lower(role) END AS role, CASE WHEN bad IS NULL THEN text ELSE '' END AS text FROM k""",
        "guard_json": f"""WITH {o.TURNS}, strict AS (
  SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 3 THEN text || chr(10) ELSE text END AS text FROM turns WHERE (conv_id + turn) % 4 <> 2),
{o.verdict_ctes('strict', 'conv_id, turn')}
SELECT conv_id, turn, code = 0 AS allowed, action AS verdict, code, {o._JOINED}, matched FROM v_verdict
UNION ALL SELECT conv_id, turn, false, 'DANGEROUS', 2, '{contexts.INPUT_ERROR_REASON}', NULL FROM turns WHERE (conv_id + turn) % 4 = 2""",
        "session_messages": "SELECT conv_id * 1000 + turn AS id, role, length(text)::INT AS chars FROM conversations "
                            "WHERE lower(role) IN ('assistant', 'model', 'agent') AND length(text) > 0",
        "event_quarantine": f"WITH {_LOGS} SELECT shard, position, problem FROM judged WHERE problem IS NOT NULL",
        "tolerant_events": f"WITH {_LOGS} SELECT verdict, count(*) AS events FROM judged WHERE problem IS NULL GROUP BY verdict",
        "event_log_round_trip": f"WITH {o.EVENTS} SELECT command, verdict, count(*) AS events, sum(epoch_us(ts) // 1000)::BIGINT AS millis FROM guarded GROUP BY ALL",
        "event_times": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) WHEN 2 THEN epoch_us(ts) - 7200000000 "
                       "WHEN 3 THEN epoch_us(date_trunc('day', ts)) END AS micros FROM events",
        "protocol_check": f"""WITH {o.EVENTS}, c AS (
  SELECT *, CASE verdict WHEN 'DANGEROUS' THEN 2 WHEN 'SUSPICIOUS' THEN 1 ELSE 0 END AS c0, event_id AS e FROM guarded),
v AS (SELECT *, e % 11 <> 3 AND e % 13 <> 2 AND e % 17 <> 5 AND e % 19 <> 4 AND e % 23 <> 6 AND e % 29 <> 8 AS valid FROM c)
SELECT event_id, valid, CASE WHEN valid THEN verdict ELSE 'DANGEROUS' END AS verdict, CASE WHEN valid AND c0 = 0 THEN 0 ELSE 2 END AS exit_code,
       CASE WHEN valid THEN command ELSE '{contexts.PROTOCOL_ERROR_REASON}' END AS reasons FROM v""",
        "metric_file": f"SELECT pos + 1 AS line_no, value FROM ({given['metric_lines']})",
        "file_tree_read": "SELECT 'skill=' || (item_id % 5) AS skill, item_id AS item, sha256(rtrim(text, chr(10))) AS sha256 FROM benchmark",
        "line_findings_profile": f"WITH {o.file_ctes(rules=(OWN_RULE, *LINE_RULES), benign=False)} SELECT skill, path, line, severity, risk FROM found",
        "report_published": o._files(
            ", k AS (SELECT skill, row_number() OVER (PARTITION BY skill ORDER BY path, CASE WHEN line = 0 THEN 2147483647 ELSE line END, "
            "risk)::INT AS rank, path, line, risk, left(context, 60) AS context FROM found WHERE severity = 'BLOCK') "
            "SELECT * FROM k WHERE rank <= 20"),
        "report_round_trip": o._files("SELECT severity, risk, count(*) AS findings FROM found GROUP BY ALL"),
        "verdicts_limited": o._documents(f"""SELECT doc_id, CASE WHEN large THEN 2 ELSE code END::INT AS code, CASE WHEN large THEN 'DANGEROUS' ELSE action END AS action,
  CASE WHEN large THEN '{contexts.TOO_LARGE_REASON}' ELSE array_to_string(reasons, '|') END AS reasons,
  CASE WHEN large THEN NULL WHEN {decoded} THEN left(matched, 80) ELSE matched END AS matched
FROM (SELECT v_verdict.*, strlen(text) > 2000 AS large FROM v_verdict JOIN planted USING (doc_id))"""),
        "sorted_findings": f"WITH {o.SARIF} SELECT l_orderkey, id, path, line, row_number() OVER (PARTITION BY l_orderkey ORDER BY "
                           "coalesce(path, ''), coalesce(line, 0), id, fingerprint)::INT AS rank FROM sarif",
        "sarif_limited": "SELECT CASE WHEN n > 5 THEN 'document has too many findings' END AS problem, count(*) AS documents "
                         "FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY ALL",
        "rule_problems": """WITH r AS (SELECT (['blocked', 'suspicious', 'safe_installers', 'other'])[p_partkey % 4 + 1] AS section,
  floor(p_partkey / 6.0)::INT AS ord, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS rule_id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS pattern FROM part)
SELECT s.section, NULL::INT AS ord, 'missing or empty section' AS problem FROM (VALUES ('blocked'), ('suspicious'), ('safe_installers'), ('bounty_spam')) s(section)
WHERE s.section NOT IN (SELECT section FROM r)
UNION ALL SELECT section, ord, CASE WHEN section = 'other' THEN 'unknown section' ELSE 'empty rule field' END FROM r
WHERE section = 'other' OR trim(rule_id) = '' OR coalesce(trim(pattern), '') = ''
UNION ALL SELECT section, ord, 'duplicate position' FROM r GROUP BY section, ord HAVING count(*) > 1""",
        "unsafe_paths": f"""SELECT path, CASE WHEN NOT ({_safe('path')}) THEN 'unsafe baseline path' ELSE 'invalid baseline digest' END AS problem
FROM (SELECT {_PATH} AS path, doc_id % 13 = 5 OR text IS NULL AS bad FROM documents) WHERE NOT ({_safe('path')}) OR bad""",
        "safe_paths": f"SELECT page_id, coalesce({_safe('path')}, false) AS safe FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages)",
        "tree_equality": """WITH a AS (SELECT 'docs/' || doc_id AS path, sha256(text) AS sha256, n_chars, CASE WHEN doc_id % 62 <> 2 THEN lang END AS lang FROM documents WHERE doc_id % 41 <> 4),
b AS (SELECT 'docs/' || doc_id AS path, sha256(text) AS sha256, n_chars + (doc_id % 29 = 1)::INT AS n_chars, CASE WHEN doc_id % 31 <> 2 THEN lang END AS lang
      FROM documents WHERE doc_id % 37 <> 3)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'unexpected'
  WHEN a.sha256 IS NOT DISTINCT FROM b.sha256 AND a.n_chars IS NOT DISTINCT FROM b.n_chars AND a.lang IS NOT DISTINCT FROM b.lang THEN 'ok' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.path = b.path""",
        "distinct_targets": "SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) AS asked FROM lineitem GROUP BY l_suppkey",
        "failures": o._documents("SELECT doc_id, code, toxic AS expected FROM v_verdict JOIN labels USING (doc_id) "
                                 "WHERE CASE WHEN toxic = 0 THEN code <> 0 ELSE code < 1 END ORDER BY doc_id LIMIT 10"),
        "blocklist_digest": f"""{pages} SELECT count(*) AS hosts, sha256('[' || string_agg('"' || host || '"', ',' ORDER BY host) || ']') AS sha256
FROM (SELECT DISTINCT lower(raw_host) AS host FROM host)""",
        "normal_hosts": f"{pages} SELECT DISTINCT lower(raw_host) AS host FROM host",
    }
