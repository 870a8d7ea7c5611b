"""SQL of those queries that SQL can express."""

from __future__ import annotations

from .urlfilter import ALPHABET, BEGIN, END, MODELS, ORDER, RANGE, RULES, STEPS


def crc32(text: str) -> str:
    """CRC-32 of an expression of ASCII text."""
    bits = "list_reduce([xor(c, b)] || list_transform(range(8), lambda z: 0::UBIGINT), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))"
    return f"xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split({text}, ''), lambda x: ord(x)::UBIGINT), lambda c, b: {bits}), 4294967295::UBIGINT)"


def _plus(key: str, cost: str, letter: str) -> str:
    """A key (nine digits of cost, then the audit) after one more edit; null stays null."""
    return f"(lpad(CAST(CAST(left({key}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{letter}')"


def _conversations() -> str:
    """Least keys of the four grammar states, row by row, in place of a search; then the repaired turns by the audit."""
    extra = "(CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END)"
    free = "r.fault IN ('', 'truncated')"

    def keep(state: str, initial: str) -> str:
        return f"CASE WHEN {free} AND r.initial = '{initial}' THEN {_plus(state, extra, 'K')} END"

    def rerole(state: str) -> str:
        return f"CASE WHEN {free} THEN {_plus(state, f'3 + {extra}', 'R')} END"

    to_user = [f(s, "u") if f is keep else f(s) for f in (keep, rerole) for s in ("s.k0", "s.k1", "s.k3")]
    steps = {
        "k0": _plus("s.k0", "4", "D"),
        "k1": f"least({_plus('s.k1', '4', 'D')}, {keep('s.k0', 's')})",
        "k2": f"least({_plus('s.k2', '4', 'D')}, {', '.join(to_user)})",
        "k3": f"least({_plus('s.k3', '4', 'D')}, {keep('s.k2', 'a')}, {rerole('s.k2')})",
    }
    inserted2 = f"least(k2, {_plus('k0', '3', 'I')}, {_plus('k1', '3', 'I')}, {_plus('k3', '3', 'I')})"
    draw = crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    return f"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {draw} % 20 AS d FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, LATERAL (SELECT unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) t(copy)
), ordered AS (
  SELECT *, row_number() OVER w AS n, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), again AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen FROM ordered
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM again
), counted AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size
  FROM faulty GROUP BY conv_id
), state AS (
  SELECT conv_id, 0 AS n, '000000000' AS k0, CAST(NULL AS VARCHAR) AS k1, '000000003I' AS k2, '000000006II' AS k3 FROM counted
  UNION ALL
  SELECT conv_id, n, k0, k1, k2, least(k3, {_plus('k2', '3', 'I')}) AS k3
  FROM (SELECT conv_id, n, k0, k1, {inserted2} AS k2, k3
    FROM (SELECT s.conv_id, r.n, {', '.join(f'{v} AS {k}' for k, v in steps.items())} FROM state s JOIN faulty r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = s.n + 1))
), best AS (
  SELECT s.conv_id, CAST(left(least(k0, k3), 9) AS BIGINT) AS cost, substr(least(k0, k3), 10) AS audit FROM state s JOIN counted c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.n = c.size
), letters AS (
  SELECT conv_id, pos, audit[pos] AS letter FROM best, LATERAL (SELECT unnest(range(1, length(audit) + 1))) t(pos)
), placed AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS n, count(*) FILTER (letter <> 'D') OVER w AS kept FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), told AS (
  SELECT p.conv_id, p.pos, p.letter, p.kept, CASE WHEN p.letter <> 'I' THEN r.role END AS role, CASE WHEN p.letter <> 'I' THEN r.text ELSE '' END AS text,
    max(CASE WHEN p.kept = 1 AND p.letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS system
  FROM placed p LEFT JOIN faulty r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.n = r.n AND p.letter <> 'I'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (kept - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS whole FROM told WHERE letter <> 'D' GROUP BY conv_id
)
SELECT i.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counted c ON i.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON i.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN repaired r ON i.conv_id IS NOT DISTINCT FROM r.conv_id
"""


def _urls() -> str:
    """Counts and estimates level by level as in the operator, each level a table of its own."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in ordered]
    level = [(v, m) for v in ("allow", "block") for m in MODELS]
    sums = ", ".join(f"sum({' + '.join(v + h for h in MODELS[m])}) AS n_{v}_{m}" for v, m in level)
    tables = []
    for k in range(1, ORDER + 2):
        shorter = {(v, m): f"t.k_{v}_{m}" if k > 1 else f"(1.0::DOUBLE / {ALPHABET})" for v, m in level}
        estimate = ", ".join(f"CASE WHEN s_{v}_{m} > 0 THEN (n_{v}_{m} + t_{v}_{m} * {shorter[v, m]}) / (s_{v}_{m} + t_{v}_{m}) ELSE {shorter[v, m]} END AS k_{v}_{m}" for v, m in level)
        behind = ", ".join(f"sum(n_{v}_{m}) AS s_{v}_{m}, sum(CASE WHEN n_{v}_{m} > 0 THEN 1 ELSE 0 END) AS t_{v}_{m}" for v, m in level)
        tables.append(f"""
g{k} AS (SELECT substr(w, {ORDER + 2 - k}, {k}) AS g, {sums} FROM counts GROUP BY 1
), b{k} AS (SELECT left(g, {k - 1}) AS context, {behind} FROM g{k} GROUP BY 1
), e{k} AS (SELECT x.g, {estimate} FROM g{k} x JOIN b{k} b ON b.context = left(x.g, {k - 1}) {f"JOIN e{k - 1} t ON t.g = substr(x.g, 2)" if k > 1 else ""}
)""")
    ratio = ", ".join(f"CAST(round((ln(k_allow_{m}) - ln(k_block_{m})) * 1e9) AS BIGINT) AS m_{m}" for m in MODELS)
    return f"""
WITH urls AS (
  SELECT url, weight, host, path, CASE {' '.join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits)} END AS rule, CASE {' '.join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)} END AS verdict,
    CASE WHEN sha256(url) < '8' THEN 0 ELSE 1 END AS half, length(host || path) + 1 AS size
  FROM (SELECT url, weight, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT url, count(*) AS weight, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM (SELECT coalesce(url, '') AS url FROM pages) GROUP BY url))
), windows AS (
  SELECT url, weight, verdict, half, size, substr(repeat('{BEGIN}', {ORDER}) || host || path || '{END}', CAST(i AS BIGINT), {ORDER + 1}) AS w FROM urls, LATERAL (SELECT unnest(range(1, size + 1))) t(i)
), counts AS (
  SELECT w, {', '.join(f"sum(CASE WHEN verdict = '{v}' AND half = {h} THEN weight ELSE 0 END) AS {v}{h}" for v in ('allow', 'block') for h in (0, 1))} FROM windows GROUP BY w
), {','.join(tables)}, ratios AS (SELECT g, {ratio} FROM e{ORDER + 1}
), scored AS (
  SELECT url, {', '.join(f'CAST(sum(m_{m}) AS BIGINT) AS m_{m}' for m in MODELS)} FROM windows JOIN ratios ON w = g GROUP BY url
), found AS (
  SELECT u.*, m_all / CAST(size AS DOUBLE) / 1e9 AS score, CAST(least(greatest(floor((CASE WHEN half = 0 THEN m_0 ELSE m_1 END) / CAST(size AS DOUBLE) / 1e9 * {STEPS}), {-RANGE * STEPS}), {RANGE * STEPS}) AS BIGINT) AS step FROM urls u JOIN scored s USING (url)
), bins AS (
  SELECT step, sum(CASE verdict WHEN 'allow' THEN weight ELSE 0 END) AS a, sum(CASE verdict WHEN 'block' THEN weight ELSE 0 END) AS b FROM found WHERE verdict IS NOT NULL GROUP BY step
  UNION ALL SELECT {RANGE * STEPS + 1}, 0, 0
), totals AS (SELECT sum(a) AS all_a, sum(b) AS all_b FROM bins
), rated AS (
  SELECT step, (all_a - (sum(a) OVER w - a)) * all_b + (sum(b) OVER w - b) * all_a AS rate, all_a * all_b > 0 AS both_kinds FROM bins, totals WINDOW w AS (ORDER BY step)
), bound AS (SELECT coalesce((SELECT step FROM rated WHERE both_kinds ORDER BY rate DESC, abs(step), step LIMIT 1), 0) / CAST({STEPS} AS DOUBLE) AS bound
)
SELECT p.page_id, f.host, f.path, f.rule, coalesce(f.verdict, CASE WHEN f.score >= bound THEN 'allow' ELSE 'block' END) AS verdict FROM pages p JOIN found f ON coalesce(p.url, '') = f.url, bound
"""


CONVERSATIONS = _conversations()
URLS = _urls()
