"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force.

No SQL: operators 1 and 6 (XXH64), 9 (CRC-32), 7, 8 and 10 (learned models), 4 (a parser), 5 (canonical windows),
12 (all periods of a text), 13 (eigenvectors).
"""

from __future__ import annotations

from pairmine.llm.lines import MIN_CHARS
from pairmine.llm.mixing import EPOCHS, SEED

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIX_SOURCES = rf"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, CAST({EPOCHS} * s AS DOUBLE) AS cap,
         row_number() OVER (ORDER BY {EPOCHS} * s / w, source NULLS LAST) AS k
  FROM sources
), levels AS (
  SELECT k, w, cap, CAST(sum(s) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM ordered
), cut AS (
  SELECT k, rest, open FROM levels WHERE w * rest / open <= cap ORDER BY k LIMIT 1
), targets AS (
  SELECT o.source, o.s, CASE WHEN o.k < c.k THEN o.cap ELSE o.w * c.rest / c.open END AS target FROM ordered o, cut c
), plan AS (
  SELECT source, s, target, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS times FROM targets
), running AS (
  SELECT d.doc_id, d.size, p.s, p.target, p.times,
         CAST(round(p.target - p.times * p.s) AS BIGINT) - (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size) AS room
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, s AS source_size, target,
       CAST(times * size + greatest(0, least(size, room)) AS BIGINT) AS taken
FROM running
"""

LINE_DEDUP = f"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs
), keyed AS (
  SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_SPACES})")} AS k FROM lines
), shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT x.doc_id, x.pos, x.line, s.k IS NOT NULL AND x.doc_id > s.first AS gone FROM keyed x LEFT JOIN shared s ON x.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _spans(kind: str, rank: int, pattern: str, kept: str) -> str:
    """Matches of a pattern with their places: what stands before a match is the pieces and matches up to it."""
    return f"""
  SELECT row, '{kind}' AS kind, {rank} AS rank, m, start, start + length(m) AS stop FROM (
    SELECT row, unnest(ms) AS m,
           unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS start
    FROM (SELECT row, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM docs)
  ) WHERE {kept}"""


_SPACE = r"\x20*"
_QUOTE = """["'']?"""
_NAMES = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
_ASSIGN = f"({_NAMES}){_QUOTE}{_SPACE}[:=]{_SPACE}{_QUOTE}([A-Za-z0-9+/_.=-]+)"
_ACCESS, _HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"

SECRETS = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
), spans AS ({_spans("assign", 1, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6")}
  UNION ALL {_spans("access", 2, _ACCESS, "length(m) >= 20")}
  UNION ALL {_spans("hex", 3, _HEX, "length(m) >= 24")}
), lists AS (
  SELECT row, count(*) FILTER (rank = 1) AS n_assign, count(*) FILTER (rank = 2) AS n_access, count(*) FILTER (rank = 3) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": MIX_SOURCES, "op3_line_dedup": LINE_DEDUP, "op11_secret_ledger": SECRETS}
