"""DuckDB SQL of the operators' queries that SQL can express; each says anew what the contract asks for.

Left out: op1 (HTML), op3 (training), op6 and op10 (XXH64 in the order and the fingerprints), op9 and
op13 (tested against brute force), op12 (CRC-32, and profiles, tested likewise).
"""

from __future__ import annotations

from seamark.llm import chat, licenses, line_rules, secrets
from seamark.llm.common import LOWER, SPACE, UPPER

#: The contract's own words and windows, stated again.
BETWEEN, SIZE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", 10


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(text: str, between: str = SPACE) -> str:
    return f"list_filter(string_split_regex({text}, {_q(between)}), lambda x: x <> '')"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {_q(pattern)}))"


def _secrets() -> str:
    base = (
        ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18),
        ("hex", "[0-9a-f]{16,}", 0, 16),
    )
    parts = []
    for no, (kind, pattern, group, least) in enumerate((*base, *((k, p, g, n) for k, p, _, g, n in secrets.MORE_RULES))):
        rx = _q(pattern)
        parts.append(f"""
        SELECT n_doc, {no} AS no, {_q(kind)} AS kind, length(g) >= {least} AS kept, length(m) AS n,
               sum(length(p)) OVER w + sum(length(m)) OVER w - length(m) AS s FROM (
          SELECT n_doc, unnest(p) AS p, unnest(m) AS m, unnest(g) AS g, unnest(range(1, len(m) + 2)) AS k FROM (
            SELECT n_doc, string_split_regex(t, {rx}) AS p, regexp_extract_all(t, {rx}) AS m, regexp_extract_all(t, {rx}, {group}) AS g
            FROM docs WHERE regexp_matches(t, {rx})))
        WHERE m IS NOT NULL WINDOW w AS (PARTITION BY n_doc ORDER BY k)""")
    return f"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS n_doc, doc_id, coalesce(text, '') AS t FROM documents),
    hits AS ({" UNION ALL ".join(parts)}),
    told AS (SELECT n_doc, no, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS x FROM hits WHERE kept),
    per AS (SELECT n_doc, count(*) FILTER (no = 0) AS n0, count(*) FILTER (no = 1) AS n1, count(*) FILTER (no = 2) AS n2,
            string_agg(x, ',' ORDER BY s, no) FILTER (no < 3) AS base, string_agg(x, ',' ORDER BY s, no) AS every FROM told GROUP BY n_doc)
    SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM docs d LEFT JOIN per USING (n_doc)"""


def _licenses() -> str:
    def canonical(t: str) -> str:
        out = f"lower({t})"
        for a, b in licenses.SPELLINGS:
            out = f"replace({out}, {_q(a)}, {_q(b)})"
        out = f"regexp_replace({out}, {_q(licenses.COPYRIGHT_LINE)}, '', 'g')"
        return f"sha256(trim(regexp_replace({out}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')))"

    values = ", ".join(f"({_q(i)}, {_q(t)})" for i, t in licenses.KNOWN)
    speaks = _q(licenses.SPEAKS)
    return f"""
    WITH known AS (SELECT {canonical("t")} AS d, min(i) AS license_id FROM (VALUES {values}) v(i, t) GROUP BY 1),
    docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    lines AS (SELECT doc_id, {canonical("x")} AS d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM docs) WHERE regexp_matches(lower(x), {speaks})),
    per AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM lines JOIN known USING (d) GROUP BY doc_id),
    texts AS (SELECT doc_id, {canonical("t")} AS digest FROM docs)
    SELECT doc_id, digest, k.license_id, coalesce(n, 0) AS n_lines, coalesce(ids, '') AS line_licenses
    FROM texts LEFT JOIN known k ON k.d = digest LEFT JOIN per USING (doc_id)"""


def _chat() -> str:
    rx = "\\\\|" + "|".join("".join("\\" + c if not c.isalnum() else c for c in x) for x in chat.CONTROL)
    marks = len(chat.OPEN) + len(chat.MID) + len(chat.CLOSE)
    return f"""
    WITH said AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    per AS (SELECT conv_id, count(*) AS n_turns,
      string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
      CAST(sum({marks} + length(role) + length(text) + {_count("role", rx)} + {_count("text", rx)}) AS BIGINT) AS formatted_chars FROM said GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM per"""


def _decontamination() -> str:
    words = lambda t: _words(f"translate(coalesce({t}, ''), '{UPPER}', '{LOWER}')", BETWEEN)
    return f"""
    WITH docs AS (SELECT doc_id, {words("text")} AS w FROM documents),
    items AS (SELECT item_id, {words("text")} AS w FROM benchmark),
    starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SIZE} + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0),
    wins AS (SELECT DISTINCT item_id, w[i:i + {SIZE} - 1] AS win FROM starts),
    sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
    places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
    hits AS (SELECT doc_id, i, n, item_id FROM places JOIN wins ON win = w[i:i + n - 1]),
    hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
    hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


def _quality_rules() -> str:
    r = line_rules
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS w FROM documents),
    windows AS (SELECT doc_id, i, w[i:i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
    often AS (SELECT doc_id, win FROM windows GROUP BY ALL HAVING count(*) > 1),
    again AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM windows JOIN often USING (doc_id, win), (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
    lines AS (SELECT doc_id, x, len({_words("x")}) AS n, {_count("x", r.NOISE_RUN)} AS noise, {_count("x", r.SEPARATOR)} AS marks
              FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM docs)),
    judged AS (SELECT *, n > 0 AND (noise > {r.MAX_NOISY} * n OR (n >= {r.PROSE_WORDS} AND NOT regexp_matches(x, {_q(r.SENTENCE)}) AND n > {r.MAX_AGAIN} * len(list_distinct({_words("x")}))) OR (marks >= 3 AND marks > {r.MAX_SEPARATORS} * n)
               OR (n <= {r.BOILERPLATE_WORDS} AND regexp_matches(lower(x), {_q(r.BOILERPLATE)}))) AS fails FROM lines),
    per AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT x) FILTER (n > 0) AS dup,
            coalesce(sum(length(regexp_replace(x, {_q(SPACE)}, '', 'g'))) FILTER (NOT fails), 0) AS left_chars FROM judged GROUP BY doc_id),
    base AS (SELECT doc_id, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
             {_count("t", r.SYMBOLS)} AS n_symbols, dup AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words, left_chars
             FROM docs JOIN per USING (doc_id) LEFT JOIN again a USING (doc_id)),
    failed AS (SELECT *, n_words < {r.MIN_WORDS} OR 100 * n_repeat_words > {r.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND left_chars >= {r.MIN_KEPT} * word_chars AS kept FROM failed"""


def _hard_negatives() -> str:
    return """
    WITH given AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS e FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL),
    v AS (SELECT n, vec_id, label, list_transform(e, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM given
          WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.n AS an, a.vec_id AS anchor_id, b.n AS bn, b.vec_id AS id, a.label = b.label AS same, CAST(coalesce(list_dot_product(a.x, b.x), 0) AS BIGINT) AS score
          FROM v a JOIN v b ON a.n <> b.n AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY an ORDER BY score DESC, id NULLS LAST, bn) <= 5)
    SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.an = p.an AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
    WINDOW w AS (PARTITION BY p.an, p.bn ORDER BY s.score DESC, s.id NULLS LAST, s.bn)
    QUALIFY row_number() OVER w <= 5"""


ORACLE: dict[str, str] = {
    "op2_secret_scan": _secrets(),
    "op4_license_scan": _licenses(),
    "op5_chat_format": _chat(),
    "op7_decontamination": _decontamination(),
    "op8_quality_rules": _quality_rules(),
    "op11_hard_negatives": _hard_negatives(),
}
