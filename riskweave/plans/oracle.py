"""SQL twins of the registered queries, for DuckDB.

They state the same results in another engine and another regex dialect (RE2:
no look-around, no back-reference, ASCII word characters), with joins, windows
and list functions in place of the operators' own way of computing them.
"""

from __future__ import annotations

from ..tables import contexts, file_scan, host_signals, page_rules, shell_rules
from ..tables.line_rules import LINE_RULES
from . import payloads

# --- text helpers ----------------------------------------------------------


def q(value: str) -> str:
    """A string literal; control characters are spelled with chr()."""
    parts, plain = [], ""
    for c in value:
        if ord(c) < 32 or ord(c) in (0x200B, 0xFEFF):
            parts.append("'" + plain.replace("'", "''") + "'")
            parts.append(f"chr({ord(c)})")
            plain = ""
        else:
            plain += c
    parts.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def has(column: str, pattern: str, options: str = "i") -> str:
    return f"regexp_matches({column}, {q(pattern)}, '{options}')"


def replace(column: str, pattern: str, by: str, options: str = "g") -> str:
    return f"regexp_replace({column}, {q(pattern)}, {q(by)}, '{options}')"


_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}\x{2066}-\x{2069}\x{feff}]"
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


_NARROW = "".join(map(chr, range(0x21, 0x7F)))
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


def normalized(column: str) -> str:
    # Of the compatibility forms, the planted texts hold full-width ASCII.
    sql = f"translate(coalesce({column}, ''), '{_WIDE}', {q(_NARROW)})"
    sql = replace(sql, r"\x1b\[[0-?]*[ -/]*[@-~]", "")
    sql = replace(sql, r"\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)", "")
    sql = replace(sql, _INVISIBLE, "")
    for _ in range(4):
        sql = replace(sql, r"[^\x08]\x08", "")
    sql = replace(sql, r"^\x08+", "")
    return f"trim({replace(sql, f'[{_SPACES}]+', ' ')})"


def page_normalized(column: str) -> str:
    spaces = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    return f"trim({replace(replace(f'coalesce({column}, {q('')})', _INVISIBLE, ''), f'[{spaces}]+', ' ')})"


def canonical(column: str) -> str:
    sql = replace(column, r"\\([A-Za-z0-9_./-])", r"\1")
    sql = replace(sql, r"(^|[^\w/])/(?:usr/)?bin/((?:ba|z|da)?sh)\b", r"\1\2", "gi")
    sql = replace(sql, r"\|\s*command\s+((?:ba|z|da)?sh)\b", r"| \1", "gi")
    sql = replace(sql, r"\brm\s+--recursive\b", "rm -r", "gi")
    sql = replace(sql, r"\brm\s+(-[^\s]+)\s+--force\b", r"rm \1 -f", "gi")
    # Mark runs of flags, then merge each by what it holds.
    sql = f"regexp_replace({sql}, {q(chr(92) + 'brm' + chr(92) + 's+((?:-[rf]+' + chr(92) + 's+){2,})')}, 'rm ' || chr(1) || '\\1' || chr(2), 'gi')"
    sql = replace(sql, r"\x01(?:-r+\s+)+\x02", "-r ", "gi")
    sql = replace(sql, r"\x01(?:-f+\s+)+\x02", "-f ", "gi")
    return replace(sql, r"\x01(?:-[rf]+\s+)+\x02", "-rf ", "gi")


# --- rules without look-around ---------------------------------------------

_IRC_CORE = (r"\b(?:connect|start|getting)\s+(?:with|into)\s+(?:the\s+)?"
             r"(?:underworld|hackers|dark|market|warez|carding|handler)\b")
_IRC_BEFORE = r"""(?:rule for ["']|rule ["']|rule: |example |test |audit |discussion )$"""
_IRC_AFTER = (r"""^[\s\w'"\-]*(?:to understand|to study|to learn|to defend|to protect|to research|"""
              r"in the document|in the report|for research)")
_RM = r"\brm\s+-[a-z]*(?:f[a-z]*r|r[a-z]*f)[a-z]*\s+(?:/|~|\$HOME)\s*$"
_ALERT = r"\beval\s*\(\s*(?:'\s*alert\s*\(\s*1\s*\)\s*;?\s*'|""" + r'"\s*alert\s*\(\s*1\s*\)\s*;?\s*")\s*\)'


def _location() -> str:
    def inner(outer, quote):
        return (rf"{outer}\s*document\.location\s*=\s*{quote}https?://[^/'\"\s)]+(?:/[^'\"\s)]*)?"
                rf"{quote}\s*;?\s*{outer}\s*\)")
    return r"\beval\s*\(\s*(?:" + "|".join(inner(o, i) for o in "'\"" for i in "'\"") + ")"


RESTATED = {
    "destructive_command_option_permutation": _RM,
    "browser_eval_alert_one": _ALERT,
    "browser_eval_document_location_external": _location(),
    "irc_handler_connect": _IRC_CORE,
}


def re2(rule_id: str, pattern: str) -> str:
    return RESTATED.get(rule_id, pattern)


def rule_test(column: str, rule_id: str, pattern: str) -> str:
    if rule_id != "irc_handler_connect":
        return has(column, re2(rule_id, pattern))
    pieces = f"string_split_regex({column}, {q('(?i)' + _IRC_CORE)})"
    return (f"({has(column, _IRC_CORE)} AND len(list_filter(range(1, len({pieces})), lambda i: "
            f"NOT {has(f'{pieces}[i]', _IRC_BEFORE)} AND NOT {has(f'{pieces}[i + 1]', _IRC_AFTER)})) > 0)")


def hit_list(column: str, rules) -> str:
    tests = ", ".join(f"CASE WHEN {rule_test(column, rid, p)} THEN {i} END" for i, (rid, p) in enumerate(rules, 1))
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


def rule_rows(name: str, rules, kinds) -> str:
    rows = ", ".join(
        f"({i}, {q(rid)}, {q('(?i)' + re2(rid, p))}, {q('(?i)^([' + chr(92) + 's' + chr(92) + 'S]*?)(?:' + re2(rid, p) + ')')}, {c}, {n})"
        for i, ((rid, p), (c, n)) in enumerate(zip(rules, kinds), 1))
    return f"{name}(ord, rule_id, pattern, prefixed, in_context, installer) AS (VALUES {rows})"


def _kinds(rules):
    return [(str("paste" in rid).lower(),
             str(rid.startswith(contexts.INSTALLER_ID_PREFIX) or rid in contexts.INSTALLER_IDS).lower())
            for rid, _ in rules]


_MARKERS = "|".join(f"(?:{m})" for m in contexts.SAFE_CONTEXT_MARKERS)
_HTTPS = r"""https://[^\s'\"|;]+"""
_KNOWN = "^(?:" + "|".join(f"(?:{p})" for _, p in shell_rules.SAFE_INSTALLERS) + ")$"


def _payload_rows() -> str:
    rows = ", ".join(f"({i}, {q(kind)}, {code}, {q(text)})" for i, (kind, code, text) in enumerate(payloads.TEXT_PAYLOADS))
    return f"payloads(pid, category, expected, payload) AS (VALUES {rows})"


PLANTED = f"""{_payload_rows()},
planted AS (
  SELECT d.doc_id, d.lang, d.source, coalesce(p.category, 'none') AS category, coalesce(p.expected, 0)::INT AS expected,
         CASE WHEN p.pid IS NULL THEN d.text ELSE d.text || chr(10) || p.payload END AS text
  FROM documents d LEFT JOIN payloads p ON d.doc_id % {payloads.TEXT_MODULUS} = p.pid)"""

TURNS = f"""{_payload_rows()},
turns AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN p.pid IS NULL THEN c.text ELSE c.text || chr(10) || p.payload END AS text
  FROM conversations c LEFT JOIN payloads p ON (c.conv_id * 31 + c.turn) % {payloads.TEXT_MODULUS} = p.pid)"""

_PAGE_ROWS = ", ".join(f"({i}, {q(p)})" for i, p in enumerate(payloads.PAGE_PAYLOADS))
PAGES = f"""page_payloads(pid, payload) AS (VALUES {_PAGE_ROWS}),
planted_pages AS (
  SELECT g.page_id, g.url, CASE WHEN p.pid IS NULL THEN g.html
         ELSE g.html || chr(10) || '<script>' || p.payload || '</script>' END AS html
  FROM pages g LEFT JOIN page_payloads p ON g.page_id % {payloads.PAGE_MODULUS} = p.pid)"""


def judged_ctes(prefix: str, source: str, keys: str, column: str, rule_table: str, clause: str, context: str,
                installer: str) -> str:
    """From ``source(keys, column, hits)``: ``<prefix>blocked(keys, code, reasons, matched)``."""
    return f"""
{prefix}hit AS (
  SELECT {keys}, {column} AS t, r.*, regexp_extract({column}, r.pattern, 0) AS m, regexp_extract({column}, r.prefixed, 1) AS pre
  FROM (SELECT *, unnest(hits) AS hit_at FROM {source}) s JOIN {rule_table} r ON r.ord = s.hit_at),
{prefix}judged AS (
  SELECT *, CASE WHEN in_context AND {context.format(clause=clause)} THEN '{contexts.SAFE_CONTEXT_REASON}'
                 WHEN installer AND {installer.format(t='t')} THEN '{contexts.SAFE_INSTALLER_REASON}' END AS why
  FROM {prefix}hit),
{prefix}blocked AS (
  SELECT {keys}, CASE WHEN bool_or(why IS NULL) THEN 2 ELSE 1 END AS code,
         CASE WHEN bool_or(why IS NULL) THEN [arg_min(rule_id, ord) FILTER (why IS NULL)]
              ELSE [arg_max(rule_id, ord), arg_max(why, ord)] END AS reasons,
         CASE WHEN bool_or(why IS NULL) THEN arg_min(m, ord) FILTER (why IS NULL) ELSE arg_max(m, ord) END AS matched
  FROM {prefix}judged GROUP BY {keys})"""


_CLAUSE = ("regexp_extract(pre, '[^.!?\\n]*$', 0) || m || "
           "regexp_extract(substr(t, length(pre) + length(m) + 1), '^[^.!?\\n]*', 0)")
_CONTEXT = f"regexp_matches({{clause}}, {q(_MARKERS)}, 'i')".replace("{2,}", "{{2,}}")
_INSTALLER = (f"len(regexp_extract_all({{t}}, {q(_HTTPS)}, 0, 'i')) = 1 AND "
              f"regexp_matches(rtrim(regexp_extract({{t}}, {q(_HTTPS)}, 0, 'i'), ')],'), {q(_KNOWN)}, 'i')")


def host_ctes(prefix: str, source: str, keys: str, column: str) -> str:
    """``<prefix>host(keys, pos, raw_host)`` and ``<prefix>scored(..., signals, reasons, code)``."""
    suffixes = ", ".join(q(s) for s in host_signals.FREE_SUBDOMAIN_SUFFIXES)
    tlds = ", ".join(q(s) for s in host_signals.SUSPECT_TLDS)
    tokens = ", ".join(q(s) for s in host_signals.LOOKALIKE_TOKENS)
    seeds = ", ".join(q(s) for s in host_signals.SEED_HOSTS)
    return f"""
{prefix}url AS (
  SELECT {keys}, unnest(urls) AS url, generate_subscripts(urls, 1) - 1 AS pos
  FROM (SELECT {keys}, regexp_extract_all({column}, {q(host_signals.URL_PATTERN)}, 0, 'i') AS urls FROM {source})),
{prefix}host AS (
  SELECT {keys}, pos, rtrim(lower(regexp_extract(url, {q(host_signals.HOST_PATTERN)}, 1, 'i')), '.') AS raw_host FROM {prefix}url),
{prefix}signal AS (
  SELECT *, raw_host AS host, raw_host IN ({seeds}) AS listed,
         {has('raw_host', host_signals.IP_LITERAL_PATTERN)} AS ip, {has('raw_host', host_signals.PUNYCODE_PATTERN)} AS puny,
         len(list_filter([{tlds}], lambda x: ends_with(raw_host, x))) > 0 AS tld,
         len(list_filter([{suffixes}], lambda x: raw_host = x OR ends_with(raw_host, '.' || x))) > 0 AS free,
         len(list_filter([{tokens}], lambda x: contains(raw_host, x))) > 0 AS look
  FROM {prefix}host),
{prefix}counted AS (
  SELECT *, 2 * ip::INT + 2 * puny::INT + tld::INT + free::INT AS base FROM {prefix}signal),
{prefix}scored AS (
  SELECT *, CASE WHEN listed THEN 0 ELSE base + (base > 0 AND look)::INT END AS signals,
         CASE WHEN listed THEN 2 WHEN base + (base > 0 AND look)::INT >= 2 THEN 1 ELSE 0 END AS code,
         CASE WHEN listed THEN ['phish_seed_blocklist: ' || host] ELSE list_filter([
           CASE WHEN ip THEN 'phish_ip_literal_host: ' || host END, CASE WHEN puny THEN 'phish_punycode_host: ' || host END,
           CASE WHEN tld THEN 'phish_suspect_tld: ' || host END, CASE WHEN free THEN 'phish_free_subdomain_host: ' || host END,
           CASE WHEN base > 0 AND look THEN 'phish_lookalike_token: ' || host END], lambda x: x IS NOT NULL) END AS reasons
  FROM {prefix}counted),
{prefix}hostv AS (
  SELECT {keys}, max(code) AS code, flatten(list(reasons ORDER BY pos)) AS reasons FROM {prefix}scored GROUP BY {keys})"""


_BLOB = r"""['"]([A-Za-z0-9+/=\s]{20,})['"]\s*\|\s*base64"""


def verdict_ctes(source: str, keys: str, column: str = "text", p: str = "v_") -> str:
    """The cascade over ``source``; ends in ``<p>verdict(keys, code, action, reasons, matched)``."""
    spam = " ".join(f"WHEN {rule_test('t', rid, pat)} THEN {q(rid)}" for rid, pat in shell_rules.BOUNTY_SPAM)
    using = f"USING ({keys})"
    susp_ids = ", ".join(q(rid) for rid, _ in shell_rules.SUSPICIOUS)
    return f"""
{p}norm AS (SELECT {keys}, {normalized(column)} AS n FROM {source}),
{p}canon AS (SELECT {keys}, {canonical('n')} AS t FROM {p}norm),
{p}hits AS (
  SELECT {keys}, t, CASE {spam} END AS spam, {hit_list('t', shell_rules.BLOCKED)} AS hits,
         list_transform({hit_list('t', shell_rules.SUSPICIOUS)}, lambda i: ([{susp_ids}])[i]) AS susp FROM {p}canon),
{rule_rows(p + 'rules', shell_rules.BLOCKED, _kinds(shell_rules.BLOCKED))},
{judged_ctes(p, p + 'hits', keys, 't', p + 'rules', _CLAUSE, _CONTEXT, _INSTALLER)},
{host_ctes(p, p + 'canon', keys, 't')},
{p}blob AS (
  SELECT {keys}, unnest(bs) AS blob, generate_subscripts(bs, 1) AS nth
  FROM (SELECT {keys}, regexp_extract_all(t, {q(_BLOB)}, 1) AS bs FROM {p}canon)),
{p}each AS (
  SELECT {keys}, nth, coalesce(try(decode(from_base64(CASE WHEN length(replace(blob, ' ', '')) % 4 = 0 THEN replace(blob, ' ', '') ELSE '' END))), '') AS d
  FROM {p}blob),
{p}decoded AS (
  SELECT {keys}, coalesce(string_agg(d, chr(10) || chr(1) || chr(10) ORDER BY nth) FILTER (d <> ''), '') AS d FROM {p}each GROUP BY {keys}),
{p}dhits AS (SELECT {keys}, d, {hit_list('d', shell_rules.BLOCKED)} AS hits FROM {p}decoded),
{judged_ctes(p + 'd', p + 'dhits', keys, 'd', p + 'rules', _CLAUSE, _CONTEXT, _INSTALLER)},
{p}decv AS (
  SELECT {keys}, d, CASE WHEN b.code IS NOT NULL THEN [b.reasons[1] || '{contexts.DECODED_SUFFIX}']
                   WHEN {has('d', contexts.DECODED_SHELL_PATTERN)} THEN ['{contexts.DECODED_SHELL_REASON}'] END AS reasons,
         CASE WHEN b.code IS NOT NULL THEN b.matched WHEN {has('d', contexts.DECODED_SHELL_PATTERN)} THEN d END AS matched
  FROM {p}decoded LEFT JOIN {p}dblocked b {using} WHERE d <> ''),
{p}stage AS (
  SELECT {keys}, CASE
      WHEN h.spam IS NOT NULL THEN {{'code': 2, 'reasons': ['bounty_spam: ' || h.spam], 'matched': NULL::VARCHAR}}
      WHEN b.code IS NOT NULL THEN {{'code': b.code, 'reasons': b.reasons, 'matched': b.matched}}
      WHEN o.code > 0 THEN {{'code': o.code, 'reasons': o.reasons, 'matched': NULL::VARCHAR}}
      WHEN d.reasons IS NOT NULL THEN {{'code': 2, 'reasons': d.reasons, 'matched': d.matched}}
      WHEN len(h.susp) > 0 THEN {{'code': 1, 'reasons': h.susp, 'matched': NULL::VARCHAR}}
      ELSE {{'code': 0, 'reasons': []::VARCHAR[], 'matched': NULL::VARCHAR}} END AS v
  FROM {p}hits h LEFT JOIN {p}blocked b {using} LEFT JOIN {p}hostv o {using} LEFT JOIN {p}decv d {using}),
{p}verdict AS (
  SELECT {keys}, v.code::INT AS code, (['SAFE', 'SUSPICIOUS', 'DANGEROUS'])[v.code + 1] AS action, v.reasons AS reasons,
         v.matched AS matched FROM {p}stage)"""


_JOINED = "array_to_string(reasons, '|') AS reasons"


def _documents(select: str) -> str:
    return f"WITH {PLANTED}, {verdict_ctes('planted', 'doc_id')} {select}"


def _turns(select: str) -> str:
    return f"WITH {TURNS}, spoken AS (SELECT * FROM turns WHERE lower(role) IN ('assistant', 'model', 'agent') AND length(text) > 0), {verdict_ctes('spoken', 'conv_id, turn')} {select}"


LINES = f"""lines AS (
  SELECT doc_id, source, line, line_no FROM (
    SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM (
      SELECT doc_id, source, CASE WHEN all_parts[-1] = '' THEN all_parts[:-2] ELSE all_parts END AS parts FROM (
        SELECT doc_id, source, string_split_regex(text, {q(_LINE_BREAK)}) AS all_parts FROM planted))))"""


def _lines(select: str) -> str:
    return f"WITH {PLANTED}, {LINES}, {verdict_ctes('lines', 'doc_id, line_no', 'line')} {select}"


def _findings(select: str) -> str:
    """All matches with their positions: ``found(doc_id, source, section, ord, rule_id, start, matched)``."""
    sections = (("bounty_spam", shell_rules.BOUNTY_SPAM), ("blocked", shell_rules.BLOCKED), ("suspicious", shell_rules.SUSPICIOUS))
    tables = ", ".join(rule_rows(f"r_{name}", rules, _kinds(rules)) for name, rules in sections)
    parts = " UNION ALL ".join(f"""
      SELECT doc_id, source, '{name}' AS section, ord::INT AS ord, rule_id, length(regexp_extract(t, prefixed, 1))::INT AS start,
             regexp_extract(t, pattern, 0) AS matched
      FROM (SELECT *, unnest({hit_list('t', rules)}) AS hit_at FROM canon) JOIN r_{name} ON ord = hit_at""" for name, rules in sections)
    return (f"WITH {PLANTED}, norm AS (SELECT doc_id, source, {normalized('text')} AS n FROM planted), "
            f"canon AS (SELECT doc_id, source, {canonical('n')} AS t FROM norm), {tables}, found AS ({parts}) {select}")


# --- pages -------------------------------------------------------------------


def page_ctes() -> str:
    kinds = [(str(rid == contexts.PAGE_CONTEXT_ID).lower(), str(rid.startswith(contexts.INSTALLER_ID_PREFIX)).lower())
             for rid, _ in page_rules.PAGE_BLOCKED]
    known = "|".join(f"(?:{p})" for p in page_rules.PAGE_SAFE_INSTALLERS)
    installer = (f"len(regexp_extract_all({{t}}, {q(_HTTPS)}, 0, 'i')) = 1 AND "
                 f"regexp_matches(regexp_replace(regexp_extract({{t}}, {q(_HTTPS)}, 0, 'i'), '[\\])],?$', ''), {q(known)}, 'i')")
    context = f"regexp_matches({{clause}}, {q(contexts.PAGE_SAFE_CONTEXT)}, 'i')"
    ids = ", ".join(q(rid) for rid, _ in page_rules.PAGE_SUSPICIOUS)
    return f"""
w_norm AS (SELECT page_id, {page_normalized('html')} AS t FROM planted_pages),
w_hits AS (SELECT page_id, t, {hit_list('t', page_rules.PAGE_BLOCKED)} AS hits,
                  list_transform({hit_list('t', page_rules.PAGE_SUSPICIOUS)}, lambda i: ([{ids}])[i]) AS susp FROM w_norm),
{rule_rows('w_rules', page_rules.PAGE_BLOCKED, kinds)},
{judged_ctes('w_', 'w_hits', 'page_id', 't', 'w_rules', _CLAUSE, context, installer)},
w_stage AS (
  SELECT page_id, CASE
      WHEN b.code = 2 THEN {{'code': 2, 'reasons': b.reasons, 'matched': b.matched}}
      WHEN len(h.susp) > 0 THEN {{'code': 1, 'reasons': h.susp, 'matched': NULL::VARCHAR}}
      WHEN b.code = 1 THEN {{'code': 1, 'reasons': b.reasons, 'matched': b.matched}}
      ELSE {{'code': 0, 'reasons': []::VARCHAR[], 'matched': NULL::VARCHAR}} END AS v
  FROM w_hits h LEFT JOIN w_blocked b USING (page_id)),
w_verdict AS (
  SELECT page_id, v.code::INT AS code, (['SAFE', 'SUSPICIOUS', 'DANGEROUS'])[v.code + 1] AS action, v.reasons AS reasons,
         v.matched AS matched FROM w_stage)"""


# --- files -------------------------------------------------------------------


def _not_starting_with(words, chars: str, at_least: int) -> str:
    """RE2 for a run of ``chars`` (lower case) that starts with none of the words."""
    options = []
    prefixes = {""}
    for word in words:
        prefixes.update(word[:i] for i in range(len(word)))
    for prefix in sorted(prefixes):
        stop = {word[len(prefix)] for word in words if word.startswith(prefix) and len(word) > len(prefix)}
        rest = "".join(c for c in chars if c not in stop)
        options.append(f"{prefix}[{rest.replace('-', '')}-][a-z0-9_-]{{{max(at_least - len(prefix) - 1, 0)},}}")
    return "(?:" + "|".join(options) + ")"


_WORD_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789_-"
_CREDENTIAL = (r"(?:OPENAI_API_KEY|ANTHROPIC_API_KEY|AWS_SECRET|GH_TOKEN|GITHUB_TOKEN)[^=]*=\s*['\"]?"
               + _not_starting_with(("your", "xxx", "example"), _WORD_CHARS, 16))


def line_test(column: str, risk: str, pattern: str) -> str:
    if "(?!" not in pattern:
        return has(column, pattern)
    if risk == "hardcoded credential literal":
        return has(column, _CREDENTIAL)
    head, _, banned = pattern.partition("(?!")
    return f"({has(column, head)} AND NOT {has(column, head + '(?:' + banned)})"


def file_ctes(skill: str = "source", rules=LINE_RULES, benign: bool = True) -> str:
    rows = ", ".join(f"({i}, {q(f)}, {str(b).lower()}, {q(t)})" for i, (f, b, t) in enumerate(payloads.LINE_PAYLOADS))
    exts = ", ".join(q(e) for e in payloads.EXTENSIONS)
    scan = ", ".join(q(e) for e in file_scan.SCANNABLE_EXTENSIONS)
    data = ", ".join(q(e) for e in file_scan.DATA_EXTENSIONS)
    first = " ".join(f"WHEN {line_test('t', risk, pat)} THEN {q(risk)}" for risk, pat in rules)
    keep = ", ".join(q(r) for r in file_scan.KEEP_BLOCK_RISKS)
    strip = f"regexp_replace(line, {q(f'^[{_SPACES}]+|[{_SPACES}]+$')}, '', 'g')"
    name = "regexp_escape(f)"
    lazy = file_scan.EVERY_DOWNLOAD_PATTERN
    allowed = "|".join(f"(?:{p})" for p in file_scan.ALLOWED_FETCH_CONTEXTS)
    return f"""line_payloads(pid, family, should_block, payload) AS (VALUES {rows}),
tree AS (
  SELECT d.doc_id, {skill} AS skill, ([{exts}])[d.doc_id % 5 + 1] AS ext, p.family, p.should_block,
         'scripts/' || d.doc_id || ([{exts}])[d.doc_id % 5 + 1] AS path,
         CASE WHEN p.pid IS NULL THEN d.text
              WHEN d.doc_id % 5 = 0 AND d.doc_id % 7 = 0 THEN d.text || chr(10) || '```bash' || chr(10) || p.payload || chr(10) || '```'
              ELSE d.text || chr(10) || p.payload END AS content
  FROM documents d LEFT JOIN line_payloads p ON d.doc_id % {payloads.LINE_MODULUS} = p.pid),
scanned AS (SELECT * FROM tree WHERE ext IN ({scan})),
split AS (
  SELECT skill, path, ext, CASE WHEN all_parts[-1] = '' THEN all_parts[:-2] ELSE all_parts END AS parts FROM (
    SELECT *, string_split_regex(content, {q(_LINE_BREAK)}) AS all_parts FROM scanned)),
numbered AS (
  SELECT skill, path, ext, {strip} AS t, line_no FROM (
    SELECT skill, path, ext, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM split)),
fenced AS (
  SELECT *, starts_with(t, '```') AND ext = '.md' AS fence,
         ext = '.md' AND sum((starts_with(t, '```'))::INT) OVER (PARTITION BY path, skill ORDER BY line_no) % 2 = 0 AS prose
  FROM numbered),
kept AS (SELECT * FROM fenced WHERE NOT fence AND t <> '' AND NOT (starts_with(t, '#') AND ext <> '.md')),
ruled AS (SELECT *, CASE {first} END AS risk FROM kept),
line_found AS (
  SELECT skill, path, line_no, t AS context,
    CASE WHEN risk IN ({keep}) THEN 'BLOCK' WHEN prose THEN 'REVIEW' WHEN benign THEN 'REVIEW'
         WHEN ext IN ({data}) THEN 'REVIEW' ELSE 'BLOCK' END AS severity,
    CASE WHEN risk IN ({keep}) THEN risk WHEN prose THEN risk || '{file_scan.PROSE_SUFFIX}'
         WHEN benign THEN risk || '{file_scan.BENIGN_SUFFIX}' ELSE risk END AS risk
  FROM (SELECT *, {str(benign).lower()} AND ((risk = {q(file_scan.PIPE_RISK)} AND {has('t', file_scan.BENIGN_PIPE_SOURCES)})
               OR (risk = {q(file_scan.RM_RISK)} AND {has('t', file_scan.BENIGN_RM_SPECIFIC)})) AS benign
        FROM ruled WHERE risk IS NOT NULL)),
idiom_found AS (
  SELECT skill, path, line_no, t AS context, 'REVIEW' AS severity, unnest(list_filter([
    CASE WHEN {has('t', file_scan.SHELL_TRUE_PATTERN)} THEN {q(file_scan.SHELL_TRUE_RISK)} END,
    CASE WHEN {has('t', file_scan.EXEC_PATTERN)} AND NOT contains(t, 're.compile') AND NOT contains(t, 'ast.literal_eval')
         THEN {q(file_scan.EXEC_RISK)} || regexp_extract(t, {q(file_scan.EXEC_PATTERN)}, 1, 'i') END,
    CASE WHEN {has('t', file_scan.REMOTE_FETCH_PATTERN)} AND NOT {has('t', allowed)} THEN {q(file_scan.REMOTE_FETCH_RISK)} END],
    lambda x: x IS NOT NULL)) AS risk
  FROM ruled WHERE risk IS NULL AND NOT prose),
bodies AS (
  SELECT *, list_filter(fnames, lambda f: regexp_matches(body, {q('(?i)' + file_scan.INTERPRETER_PREFIX)} || {name} || '\\b')) AS run FROM (
    SELECT skill, path, body, list_distinct(list_concat(regexp_extract_all(body, {q(file_scan.DOWNLOAD_PATTERN)}, 1, 'i'),
                                                        regexp_extract_all(body, {q(lazy)}, 1, 'i'))) AS fnames
    FROM (SELECT skill, path, array_to_string(parts, chr(10)) AS body FROM split))),
cross_found AS (
  SELECT skill, path, 0 AS line_no, '{file_scan.CROSS_CONTEXT}' AS context, 'BLOCK' AS severity, unnest(list_filter([
    CASE WHEN len(run) > 0 THEN {q(file_scan.CROSS_EXECUTE_RISK)} END,
    CASE WHEN len(list_filter(fnames, lambda f: NOT list_contains(run, f) AND regexp_matches(body, {q('(?i)' + file_scan.CHMOD_PREFIX)} || {name} || '\\b')
              AND regexp_matches(body, '(?m)' || {name} || '\\s*$'))) > 0 THEN {q(file_scan.CROSS_CHMOD_RISK)} END,
    CASE WHEN contains(body, 'LaunchAgents/') AND contains(body, '.plist') AND {has('body', file_scan.LAUNCHCTL_PATTERN)}
         THEN {q(file_scan.CROSS_LAUNCH_RISK)} END], lambda x: x IS NOT NULL)) AS risk
  FROM bodies),
found AS (
  SELECT skill, path, string_split(path, '/')[-1] AS file, line_no::INT AS line, severity, risk, context FROM (
    SELECT skill, path, line_no, severity, risk, context FROM line_found
    UNION ALL SELECT skill, path, line_no, severity, risk, context FROM idiom_found
    UNION ALL SELECT skill, path, line_no, severity, risk, context FROM cross_found)),
rolled AS (
  SELECT s.skill, s.files_scanned, coalesce(f.b, 0) AS block_count, coalesce(f.r, 0) AS review_count,
         CASE WHEN coalesce(f.b, 0) > 0 THEN 'BLOCK' WHEN coalesce(f.r, 0) > 0 THEN 'REVIEW' ELSE 'CLEAN' END AS verdict
  FROM (SELECT skill, count(*) AS files_scanned FROM scanned GROUP BY skill) s
  LEFT JOIN (SELECT skill, count(*) FILTER (severity = 'BLOCK') AS b, count(*) FILTER (severity = 'REVIEW') AS r
             FROM found GROUP BY skill) f USING (skill))"""


def _files(select: str, skill: str = "source") -> str:
    return f"WITH {file_ctes(skill)} {select}"


_FOLDER = "d.source || '-' || d.doc_id"

# --- events ------------------------------------------------------------------

EVENTS = """guarded AS (
  SELECT event_id, ts, 'log-' || (user_id % 4) AS log, event_type AS command,
         CASE event_type WHEN 'error' THEN 'DANGEROUS' WHEN 'purchase' THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict,
         event_type IN ('error', 'view') AS is_chat, event_type = 'signup' AND event_id % 50 = 0 AS is_reset
  FROM events)"""

_COUNTS = """count(*) AS total, count(*) - count(*) FILTER (verdict = 'SUSPICIOUS') - count(*) FILTER (verdict = 'DANGEROUS') AS safe,
  count(*) FILTER (verdict = 'SUSPICIOUS') AS suspicious, count(*) FILTER (verdict = 'DANGEROUS') AS dangerous"""

BREAKER = f"""{EVENTS},
numbered AS (
  SELECT *, sum(is_reset::INT) OVER (PARTITION BY log ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM guarded),
recent AS (
  SELECT *, count(*) OVER (PARTITION BY log, epoch ORDER BY ts RANGE BETWEEN INTERVAL 120 MINUTES PRECEDING AND CURRENT ROW) AS recent
  FROM numbered WHERE verdict = 'DANGEROUS'),
alerts AS (SELECT log, epoch, event_id, ts, recent FROM recent WHERE is_chat AND recent >= 3)"""

# --- chunks ------------------------------------------------------------------


def _chunks(resets: bool = False) -> str:
    """With resets, a text before a chunk reaches back to the last reset of its stream."""
    is_reset = "(conv_id + turn) % 7 = 3" if resets else "false"
    n = 2 * len(payloads.SPLIT_PAYLOADS) + 1
    rows = ", ".join(f"({i}, {q(a)}, {q(b)})" for i, (a, b) in enumerate(payloads.SPLIT_PAYLOADS))
    return f"""WITH halves(pid, l, r) AS (VALUES {rows}),
cut AS (
  SELECT c.conv_id, c.turn, CASE WHEN h.pid IS NULL THEN c.text WHEN c.turn % 2 = 0 THEN c.text || ' ' || h.l
                                 ELSE h.r || ' ' || c.text END AS text
  FROM conversations c LEFT JOIN halves h ON (c.conv_id + floor(c.turn / 2.0)::BIGINT) % {n} = h.pid),
stretch AS (SELECT *, {is_reset} AS is_reset, sum(({is_reset})::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM cut),
chunk AS (SELECT conv_id, turn, e, {normalized('text')} AS chunk FROM stretch WHERE NOT is_reset),
spoken AS (
  SELECT *, array_to_string(list(chunk) OVER (PARTITION BY conv_id, e ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ' ') AS past
  FROM chunk WHERE chunk <> ''),
buffered AS (SELECT conv_id, turn, chunk, ltrim(right(coalesce(past, ''), {contexts.STREAM_LOOKBACK})) AS buffer FROM spoken),
candidates AS (
  SELECT conv_id, turn, 0 AS cand, chunk AS text FROM buffered
  UNION ALL SELECT conv_id, turn, 1, {normalized('buffer || chunk')} FROM buffered
  UNION ALL SELECT conv_id, turn, 2, {normalized("buffer || ' ' || chunk")} FROM buffered
  UNION ALL SELECT conv_id, turn, 0, '' FROM chunk WHERE chunk = ''),
{verdict_ctes('candidates', 'conv_id, turn, cand')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY code DESC, cand) AS rn FROM v_verdict)
SELECT conv_id, turn, code, action, {_JOINED}, matched FROM ranked WHERE rn = 1"""


# --- SARIF -------------------------------------------------------------------

_SEVERITY_LIST = ", ".join(q(s) for s in contexts.SEVERITIES)
SARIF = f"""facts AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS part, l_suppkey, 'RULE' || (l_partkey % 40) AS id,
         CASE WHEN l_partkey % 3 = 0 THEN (l_quantity / 5)::DECIMAL(6,1) END AS score,
         CASE WHEN l_partkey % 40 % 2 = 0 THEN ([{_SEVERITY_LIST}])[l_partkey % 40 % 6 + 1] END AS rule_severity,
         ([{', '.join(q(x) for x in ('high', 'medium', 'low', 'informational', 'unknown'))}])[l_partkey % 5 + 1] AS by_level,
         'ships by ' || l_returnflag AS message,
         CASE WHEN l_partkey % 7 <> 0 THEN 'src/' || l_partkey || '.py' END AS path,
         CASE WHEN l_partkey % 7 <> 0 THEN l_suppkey::INT END AS line
  FROM lineitem),
sarif AS (
  SELECT l_orderkey, id,
         CASE WHEN rule_severity IS NOT NULL THEN 'Rule number ' || (part % 40) ELSE id END AS title,
         CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score > 0 THEN 'low'
              WHEN rule_severity IS NOT NULL THEN rule_severity ELSE by_level END AS severity,
         message, path, line,
         CASE WHEN part % 4 = 0 THEN 'fp-' || part ELSE left(sha256(id || chr(0) || coalesce(path, 'None') || chr(0) ||
              coalesce(line::VARCHAR, 'None') || chr(0) || message), 24) END AS fingerprint
  FROM facts)"""

# --- snapshots ---------------------------------------------------------------

SNAPSHOTS = """baseline AS (SELECT 'docs/' || doc_id AS path, sha256(text) AS sha256 FROM documents),
present AS (
  SELECT 'docs/' || doc_id AS path, sha256(CASE WHEN coalesce(quality, 1) = 0 THEN text || '!' ELSE text END) AS sha256
  FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0
  UNION ALL SELECT 'items/' || item_id, sha256(text) FROM benchmark),
diff AS (
  SELECT path, CASE WHEN p.sha256 IS NULL THEN 'missing' WHEN b.sha256 IS NULL THEN 'unexpected'
                    WHEN p.sha256 = b.sha256 THEN 'ok' ELSE 'changed' END AS state
  FROM baseline b FULL OUTER JOIN present p USING (path)),
sources AS (
  SELECT 'docs/' || doc_id AS path, sha256(text) AS sha256, 0 AS source_rank, 'archive-2' AS source, TIMESTAMP '2024-02-02' AS ts
  FROM documents WHERE lang <> 'en'
  UNION ALL SELECT 'docs/' || doc_id, sha256(CASE WHEN n_chars < 500 THEN text || '?' ELSE text END), 0, 'archive-1',
                   TIMESTAMP '2024-02-01' FROM documents
  UNION ALL SELECT 'docs/' || doc_id, sha256(text), 1, 'history', TIMESTAMP '2024-03-01' FROM documents WHERE lang <> 'fr')"""

# --- scores ------------------------------------------------------------------


def _score(source: str, group: str = "") -> str:
    names = f"{group}, " if group else ""
    by = f" GROUP BY ROLLUP ({group})" if group else ""
    return f"""outcomes AS (
  SELECT *, CASE WHEN expected = 0 THEN CASE WHEN code = 0 THEN 'tn' ELSE 'fp' END
                 WHEN (expected = 1 AND code >= 1) OR (expected = 2 AND code = 2) THEN 'tp' ELSE 'fn' END AS o FROM ({source})),
counts AS (
  SELECT {names}count(*) AS samples, count(*) FILTER (o = 'tp') AS tp, count(*) FILTER (o = 'tn') AS tn,
         count(*) FILTER (o = 'fp') AS fp, count(*) FILTER (o = 'fn') AS fn FROM outcomes{by}),
ratios AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision_,
         CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall_,
         CASE WHEN samples = 0 THEN 0.0::DOUBLE ELSE (tp + tn)::DOUBLE / samples END AS accuracy_ FROM counts)
SELECT {names}samples, tp, tn, fp, fn, round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(accuracy_, 6) AS accuracy,
       round(CASE WHEN precision_ + recall_ = 0 THEN 0.0::DOUBLE ELSE 2 * precision_ * recall_ / (precision_ + recall_) END, 6) AS f1
FROM ratios"""




def _warning() -> str:
    return """CASE code WHEN 2 THEN 'This output was blocked because it appears to contain dangerous or manipulated instructions. Do not paste or execute it.'
      WHEN 1 THEN 'Warning: this output contains suspicious patterns. Please review carefully before executing anything.' ELSE '' END AS warning"""


def oracle_sql() -> dict[str, str]:
    from .oracle_tables import oracle_sql as more
    given = _oracle_sql()
    return {**given, **more(given)}


def _oracle_sql() -> dict[str, str]:
    verdict_cols = f"code, action, {_JOINED}, matched"
    document_hosts = (f"WITH {PLANTED}, {host_ctes('', 'planted', 'doc_id', 'text')}")
    page_hosts = f"WITH {PAGES}, {host_ctes('', 'planted_pages', 'page_id', 'html')}"
    decoded_action = "CASE WHEN d.reasons IS NULL THEN 'SAFE' ELSE 'DANGEROUS' END AS action"
    audit = "conv_id, turn, code = 0 AS allowed, action AS verdict, code"
    return {
        "verdicts_documents": _documents(f"SELECT doc_id, {verdict_cols} FROM v_verdict"),
        "verdicts_long_rows": f"""WITH long_rows AS (
  SELECT doc_id // 32 AS row_id, string_agg(coalesce(text, '') || ' ' || repeat(([{', '.join(q(b) for b in payloads.BEGINNINGS)}])[doc_id % {len(payloads.BEGINNINGS)} + 1], 40), ' ' ORDER BY doc_id) AS text
  FROM documents GROUP BY 1), {verdict_ctes('long_rows', 'row_id')} SELECT row_id, {verdict_cols} FROM v_verdict""",
        "verdict_counts_by_lang": _documents(
            "SELECT lang, action, count(*) AS documents FROM v_verdict JOIN planted USING (doc_id) GROUP BY lang, action"),
        "guard_envelopes": _documents(
            f"SELECT doc_id, code = 0 AS allowed, action AS verdict, code, {_JOINED}, {_warning()} FROM v_verdict"),
        "findings_all_rules": _findings("SELECT doc_id, section, ord, rule_id, start, matched FROM found"),
        "findings_rule_table": _findings("SELECT doc_id, section, ord, rule_id, start, matched FROM found"),
        "findings_user_rules": f"""WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
rules AS (SELECT DISTINCT array_to_string(list_slice(w, i, i + 3), ' ') AS rule_id FROM (SELECT w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)),
d AS (SELECT doc_id, regexp_replace(lower({canonical('n')}), '[ ,.;:!?]+', ' ', 'g') AS t FROM (SELECT doc_id, {normalized('text')} AS n FROM documents))
SELECT doc_id, rule_id FROM d JOIN rules ON contains(t, rule_id)""",
        "rule_table_verdicts": _documents(f"""SELECT doc_id, v.code::INT AS code, (['SAFE', 'SUSPICIOUS', 'DANGEROUS'])[v.code + 1] AS action,
  array_to_string(v.reasons, '|') AS reasons, v.matched AS matched FROM (SELECT doc_id, CASE
      WHEN h.spam IS NOT NULL THEN {{'code': 2, 'reasons': ['bounty_spam: ' || h.spam], 'matched': NULL::VARCHAR}}
      WHEN b.code IS NOT NULL THEN {{'code': b.code, 'reasons': b.reasons, 'matched': b.matched}}
      WHEN len(h.susp) > 0 THEN {{'code': 1, 'reasons': h.susp, 'matched': NULL::VARCHAR}}
      ELSE {{'code': 0, 'reasons': []::VARCHAR[], 'matched': NULL::VARCHAR}} END AS v
  FROM v_hits h LEFT JOIN v_blocked b USING (doc_id))"""),
        "top_rules_by_source": _findings(
            ", c AS (SELECT source, section, rule_id, count(*) AS hits FROM found GROUP BY ALL), "
            "k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hits DESC, section, rule_id)::INT AS rank FROM c) "
            "SELECT * FROM k WHERE rank <= 5"),
        "risky_lines": _lines(
            f"SELECT doc_id, line_no::INT AS line_no, line, code, action, {_JOINED} "
            "FROM v_verdict JOIN lines USING (doc_id, line_no) WHERE code <> 0"),
        "risky_line_summary": _lines(
            "SELECT source, count(*) FILTER (code <> 0) AS risky_lines, max(code) FILTER (code <> 0) AS worst_code, "
            "true AS any_risky FROM v_verdict JOIN lines USING (doc_id, line_no) GROUP BY source HAVING max(code) > 0"),
        "decoded_payloads": _documents(
            f"SELECT doc_id, d AS decoded, (CASE WHEN d.reasons IS NULL THEN 0 ELSE 2 END)::INT AS code, {decoded_action}, "
            "coalesce(array_to_string(d.reasons, '|'), '') AS reasons, d.matched AS matched FROM v_decv d"),
        "document_lines": f"WITH {PLANTED}, {LINES} SELECT source, count(*) AS lines FROM lines GROUP BY source",
        "hosts_extracted": f"{page_hosts} SELECT page_id, pos::INT AS pos, raw_host FROM host",
        "page_url_hosts": f"WITH {host_ctes('', 'pages', 'page_id', 'url')} SELECT host, signals::INT AS signals, "
                          "code::INT AS code, count(*) AS urls FROM scored GROUP BY ALL",
        "host_signals": f"{document_hosts} SELECT doc_id, pos::INT AS pos, raw_host, host, signals::INT AS signals, {_JOINED}, "
                        "code::INT AS code FROM scored",
        "host_verdicts": f"{document_hosts} SELECT doc_id, code::INT AS code, {_JOINED} FROM hostv",
        "blocklist_hits": f"{page_hosts} SELECT page_id, pos::INT AS pos, host FROM scored WHERE listed",
        "verdicts_joined_blocklist": _documents(f"SELECT doc_id, {verdict_cols} FROM v_verdict"),
        "conversation_audit": _turns(f"SELECT {audit}, {_JOINED} FROM v_verdict"),
        "conversation_audit_rollup": _turns(
            "SELECT conv_id, count(*) AS scanned, count(*) FILTER (code > 0) AS flagged, max(code) AS highest_code "
            "FROM v_verdict GROUP BY ROLLUP (conv_id)"),
        "chat_json_flatten": f"WITH {TURNS} SELECT conv_id, turn, lower(role) AS role, text FROM turns",
        "chat_strict_content": f"WITH {TURNS} SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 2 THEN NULL "
                               "WHEN 3 THEN text || chr(10) ELSE text END AS text, (conv_id + turn) % 4 <> 2 AS valid FROM turns",
        "chat_export": "SELECT conv_id, turn, json_object('role', role, 'content', text)::VARCHAR AS record FROM conversations "
                       "WHERE role = 'assistant'",
        "page_verdicts": f"WITH {PAGES}, {page_ctes()} SELECT page_id, {verdict_cols} FROM w_verdict",
        "profile_parity": f"WITH {PAGES}, {page_ctes()}, {verdict_ctes('planted_pages', 'page_id', 'html')} "
                          "SELECT page_id, a.code AS left_code, b.code AS right_code FROM v_verdict a JOIN w_verdict b USING (page_id) "
                          "WHERE a.code <> b.code",
        "line_findings": _files("SELECT * FROM found"),
        "skill_rollup": _files("SELECT * FROM rolled"),
        "sweep_summary": _files(
            "SELECT count(*) AS skills_scanned, count(*) FILTER (verdict = 'CLEAN') AS clean, "
            "count(*) FILTER (verdict = 'REVIEW') AS review, count(*) FILTER (verdict = 'BLOCK') AS block FROM rolled", _FOLDER),
        "gate_refusals": _files(
            "SELECT family, coalesce(verdict, '') <> 'BLOCK' AS admitted, count(*) AS files "
            "FROM tree LEFT JOIN rolled USING (skill) GROUP BY ALL", _FOLDER),
        "refusal_report": _files(
            ", k AS (SELECT skill, row_number() OVER (PARTITION BY skill ORDER BY path, CASE WHEN line = 0 THEN 2147483647 ELSE line END, "
            "risk)::INT AS rank, path, line, risk, context FROM found WHERE severity = 'BLOCK') "
            "SELECT * FROM k WHERE rank <= 20"),
        "secret_literals": _files(
            "SELECT skill, severity, risk, count(*) AS files FROM found WHERE risk LIKE 'hardcoded credential literal%' GROUP BY ALL"),
        "recall_by_family": _files(
            ", c AS (SELECT family, should_block, (verdict = 'BLOCK') = should_block AS ok FROM scanned JOIN rolled USING (skill) "
            "WHERE family IS NOT NULL) SELECT family, should_block, count(*) AS cases, count(*) FILTER (ok) AS right, "
            "round(count(*) FILTER (ok)::DOUBLE / count(*), 6) AS share FROM c GROUP BY family, should_block", _FOLDER),
        "event_metrics": f"WITH {EVENTS} SELECT log, {_COUNTS} FROM guarded GROUP BY log",
        "verdict_histogram": f"WITH {EVENTS} SELECT verdict, count(*) AS events FROM guarded GROUP BY verdict",
        "event_status": f"WITH {EVENTS} SELECT epoch_us(ts) AS ts, event_id, verdict, command, command AS reasons FROM guarded "
                        "ORDER BY ts DESC, event_id DESC LIMIT 5",
        "incidents": f"WITH {EVENTS} SELECT epoch_us(ts) AS ts, event_id, command, command AS reasons FROM guarded "
                     "WHERE verdict = 'DANGEROUS' ORDER BY ts DESC, event_id DESC LIMIT 10",
        "event_health": f"WITH {EVENTS}, last AS (SELECT * FROM guarded ORDER BY ts DESC, event_id DESC LIMIT 10), "
                        "c AS (SELECT count(*) AS recent, count(*) FILTER (verdict = 'DANGEROUS') AS recent_dangerous FROM last) "
                        "SELECT *, CASE WHEN recent >= 3 AND recent_dangerous >= 3 THEN 'DEGRADED' WHEN recent_dangerous > 0 THEN 'WARN' "
                        "ELSE 'HEALTHY' END AS health FROM c",
        "metric_lines": f"""WITH {EVENTS}, m AS (SELECT {_COUNTS} FROM guarded)
SELECT (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS value FROM (SELECT [
  '# HELP guard_events_total Total guard events.', '# TYPE guard_events_total counter', 'guard_events_total ' || total,
  '# HELP guard_events_by_verdict Guard events by verdict.', '# TYPE guard_events_by_verdict gauge',
  'guard_events_by_verdict{{verdict="SAFE"}} ' || safe, 'guard_events_by_verdict{{verdict="SUSPICIOUS"}} ' || suspicious,
  'guard_events_by_verdict{{verdict="DANGEROUS"}} ' || dangerous, '# HELP guard_circuit_open Whether the circuit breaker is open.',
  '# TYPE guard_circuit_open gauge', 'guard_circuit_open 0'] AS l FROM m)""",
        "breaker_alerts": f"WITH {BREAKER} SELECT log, epoch, event_id, epoch_us(ts) AS ts, recent FROM alerts",
        "breaker_epochs": f"WITH {BREAKER}, opened AS (SELECT log, epoch, min(ts) AS opened_at, count(*) AS alerts FROM alerts GROUP BY log, epoch) "
                          "SELECT log, epoch, epoch_us(opened_at) AS opened_at, alerts, (SELECT count(*) FROM numbered n WHERE n.log = o.log "
                          "AND n.epoch = o.epoch AND n.is_chat AND n.ts > o.opened_at) AS blocked_chats FROM opened o",
        "breaker_stream": f"WITH {BREAKER} SELECT log, epoch, event_id, epoch_us(ts) AS ts FROM alerts",
        "danger_watch_hourly": f"WITH {EVENTS} SELECT epoch_us(date_trunc('hour', ts)) AS window_start, "
                               "epoch_us(date_trunc('hour', ts)) + 3600000000 AS window_end, count(*) AS dangerous FROM guarded "
                               "WHERE verdict = 'DANGEROUS' GROUP BY ALL HAVING count(*) >= 3",
        "danger_stream": f"WITH {EVENTS} SELECT epoch_us(date_trunc('hour', ts)) AS window_start, "
                         "epoch_us(date_trunc('hour', ts)) + 3600000000 AS window_end, count(*) AS dangerous FROM guarded "
                         "WHERE verdict = 'DANGEROUS' GROUP BY ALL HAVING count(*) >= 3",
        "chunk_verdicts": _chunks(),
        "chunk_stream": _chunks(),
        "chunk_verdicts_reset": _chunks(resets=True),
        "chunk_stream_reset": _chunks(resets=True),
        "guard_stream": f"WITH {TURNS}, {verdict_ctes('turns', 'conv_id, turn')} "
                        "SELECT code = 0 AS allowed, action AS verdict, count(*) AS turns FROM v_verdict GROUP BY ALL",
        "sarif_findings": f"WITH {SARIF} SELECT * FROM sarif",
        "sarif_severity_counts": f"WITH {SARIF} SELECT l_orderkey, count(*) AS total, "
                                 + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in contexts.SEVERITIES)
                                 + " FROM sarif GROUP BY l_orderkey",
        "snapshot_digest": "SELECT doc_id AS path, sha256(text) AS sha256 FROM documents",
        "snapshot_diff": f"WITH {SNAPSHOTS} SELECT * FROM diff",
        "recover_rows": f"""WITH {SNAPSHOTS},
broken AS (SELECT path, b.sha256 FROM diff JOIN baseline b USING (path) WHERE state IN ('missing', 'changed')),
best AS (SELECT path, s.source, s.ts, row_number() OVER (PARTITION BY path ORDER BY source_rank, ts DESC) AS rn
         FROM sources s JOIN broken USING (path, sha256))
SELECT path, sha256, source, epoch_us(ts) AS ts FROM broken LEFT JOIN (SELECT * FROM best WHERE rn = 1) USING (path)""",
        "keep_latest": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, "
                       "o_orderkey DESC) <= 7 AS kept FROM orders",
        "evaluate_overall": _documents(", " + _score("SELECT code, expected FROM v_verdict JOIN planted USING (doc_id)")),
        "evaluate_by_category": _documents(
            ", " + _score("SELECT category, code, expected FROM v_verdict JOIN planted USING (doc_id)", "category")),
        "evaluate_against_labels": _documents(
            ", " + _score("SELECT code, toxic AS expected FROM v_verdict JOIN labels USING (doc_id)")),
    }
