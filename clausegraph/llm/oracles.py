"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import re

from .licenses import PHRASES, TEMPLATES
from .ngram_scores import ALPHA
from .shards import placement_sql

#: A-Z to lower case, other characters as they are; null as empty.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Runs of digits, letters and non-ASCII characters.
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

EXACT = f"""
    WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)"""

DECONTAMINATION = f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS w FROM benchmark),
      p AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') AS phrase FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM b WHERE len(w) > 0)),
      pl AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS k FROM d, (SELECT DISTINCT n FROM p))),
      h AS (SELECT doc_id, k, n, item FROM pl JOIN p USING (n, phrase)),
      c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM h) GROUP BY doc_id),
      i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"""

LM_SCORES = f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), t AS (SELECT doc_id, len(w) AS m, w[k] AS x, CASE WHEN k > 1 THEN w[k - 1] END AS c FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM d)),
      u AS (SELECT x, count(*) AS n FROM t GROUP BY x), ud AS (SELECT doc_id, x, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT c, x, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY ALL), bd AS (SELECT doc_id, c, x, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY ALL),
      s AS (SELECT t.doc_id, t.c, greatest(1, (SELECT count(*) FROM t) - t.m) AS rest, coalesce(b.n - bd.n, 0) AS nb, uc.n - ucd.n AS nc, u.n - ud.n AS nx
        FROM t JOIN u ON u.x = t.x JOIN ud ON ud.doc_id = t.doc_id AND ud.x = t.x LEFT JOIN b ON b.c = t.c AND b.x = t.x LEFT JOIN bd ON bd.doc_id = t.doc_id AND bd.c = t.c AND bd.x = t.x LEFT JOIN u uc ON uc.x = t.c LEFT JOIN ud ucd ON ucd.doc_id = t.doc_id AND ucd.x = t.c),
      g AS (SELECT doc_id, sum(CASE WHEN nb > 0 THEN ln(nb / nc) WHEN nx > 0 THEN ln(nx / rest) + CASE WHEN c IS NULL THEN 0 ELSE ln({ALPHA}) END ELSE ln({ALPHA}) * CASE WHEN c IS NULL THEN 1 ELSE 2 END - ln(rest) END) AS log_score FROM s GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(log_score, 0) AS log_score, CASE WHEN len(w) > 0 THEN log_score / len(w) END AS mean_log_score FROM d LEFT JOIN g USING (doc_id)"""


def template_regex(template: str) -> str:
    """The template over words joined by spaces, with a space before and after each text."""
    out = " "
    for part in re.split(r"(<<.*?>>)", template):
        if part == "<<optional>>":
            out += "(?:"
        elif part == "<<end>>":
            out += ")?"
        elif part.startswith("<<any "):
            low, high = part[6:-2].split()
            out += rf"(?:[^ ]+ ){{{low},{high}}}"
        else:
            out += "".join(w + " " for w in re.findall(r"[0-9a-z]+", part.lower()))
    return out


def license_sql() -> str:
    places = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, k - 1 AS k FROM t WHERE list_slice(w, k, k + {len(p.split()) - 1}) = {p.split()}" for p, label in PHRASES.items())
    own = ", ".join(f"CASE WHEN regexp_matches(j, '{template_regex(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
    return f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d), p AS ({places}),
      b AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, list(DISTINCT label) AS labels FROM p GROUP BY doc_id),
      o AS (SELECT doc_id, list_filter([{own}], lambda x: x IS NOT NULL) AS own FROM (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS j FROM d))
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), own))), ',') AS labels, CAST(CASE WHEN len(own) > 0 THEN 1 WHEN n_base > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score
    FROM d LEFT JOIN b USING (doc_id) JOIN o USING (doc_id)"""


ORACLES = {"op3_decontamination": DECONTAMINATION, "op4_sharding": placement_sql(), "op5_lm_scores": LM_SCORES, "op8_exact_dedup": EXACT, "op10_license_scan": license_sql()}
