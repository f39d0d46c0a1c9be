"""DuckDB equivalents of the training-data queries that SQL can express."""

from __future__ import annotations

from . import mixing, quality_rules

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))

_MEASURE = {
    "n_words": "n_words",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "stop_ratio": "n_stop / least(greatest(n_kinds, 1), 100)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "stutter_ratio": "n_stutter / greatest(n_words, 1)",
    "bullet_ratio": "n_bullets / greatest(n_lines, 1)",
}
_RULES = " AND ".join(
    f"{_MEASURE[r.measure]} {op} {bound}" for r in quality_rules.RULES for op, bound in ((">=", r.least), ("<=", r.most)) if bound is not None
)


def measured(source: str) -> str:
    """A WITH list (d, w, win, rep, m) that ends in the measures of ``source``'s documents."""
    return f"""d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {source}),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k
    FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS covered FROM (
    SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (
        SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1) GROUP BY rid),
m AS (SELECT w.rid, w.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls) AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered, 0)::BIGINT AS n_repeat_words,
    len(list_intersect(list_distinct(list_transform(ws, lambda x: lower(x))), [{_STOP}])) AS n_stop,
    len(list_distinct(ws)) AS n_kinds,
    len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_stutter,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS n_bullets
    FROM w LEFT JOIN rep ON w.rid = rep.rid)"""


OP1 = f"""WITH {measured('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {_RULES} AS kept
FROM m"""

OP2 = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT rid, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS k
    FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
gone AS (SELECT rid, list_distinct(flatten(list(range(i, i + 35)))) AS ps FROM hit GROUP BY rid),
word AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
dead AS (SELECT rid, unnest(ps) AS p FROM gone),
kept AS (SELECT word.rid, string_agg(w, ' ' ORDER BY word.p) AS t, count(*) AS n
    FROM word ANTI JOIN dead ON word.rid = dead.rid AND word.p = dead.p GROUP BY word.rid)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.rid = kept.rid"""



def mixed(source: str) -> str:
    """A WITH list that ends in ``mixed``: ``source``'s documents with tokens, topic, chance and draw."""
    quoted = {k: "chr(10)" if v == "\n" else f"'{v}'" for k, v in mixing.TRAITS.items()}
    names = list(quoted)
    score = {k: f"CASE WHEN d_{k} > 0 THEN ({k} - m_{k}) / d_{k} END" for k in names}
    top = f"greatest({', '.join(f'z_{k}' for k in names)})"
    cases = " ".join(f"WHEN z_{k} >= {mixing.STANDS_OUT} AND z_{k} = {top} THEN '{k}'" for k in names)
    parts = [
        f"""c AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM {source})""",
        f"""f0 AS (SELECT doc_id, source, lang, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {1 << 52}.0 AS draw,
    {', '.join(f"(length(t) - length(translate(t, {v}, ''))) / greatest(length(t), 1) AS {k}" for k, v in quoted.items())} FROM c)""",
        f"st AS (SELECT {', '.join(f'avg({k}) AS m_{k}, stddev_pop({k}) AS d_{k}' for k in names)} FROM f0)",
        f"z AS (SELECT f0.*, {', '.join(f'{e} AS z_{k}' for k, e in score.items())} FROM f0 CROSS JOIN st)",
        f"b AS MATERIALIZED (SELECT doc_id, source, lang, tokens, draw, CASE {cases} ELSE 'plain' END AS topic FROM z)",
        "cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM b GROUP BY ALL HAVING sum(tokens) > 0)",
        *[f"t_{m} AS (SELECT {m}, pow(s, {mixing.TEMPER}) / sum(pow(s, {mixing.TEMPER})) OVER () AS target FROM (SELECT {m}, sum(tokens) AS s FROM cells GROUP BY {m}))" for m in mixing.MARGINS],
        """w0 AS MATERIALIZED (SELECT cells.*, tokens / sum(tokens) OVER () AS share, tokens / sum(tokens) OVER () AS weight, a.target AS x_source, l.target AS x_lang, p.target AS x_topic
    FROM cells JOIN t_source a ON cells.source IS NOT DISTINCT FROM a.source JOIN t_lang l ON cells.lang IS NOT DISTINCT FROM l.lang JOIN t_topic p ON cells.topic = p.topic)""",
    ]
    k = 0
    for _ in range(mixing.SWEEPS):
        for m in mixing.MARGINS:
            parts.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (weight * x_{m} / sum(weight) OVER (PARTITION BY {m}) AS weight) FROM w{k})")
            k += 1
    far = 1 / mixing.KEEP
    parts += [
        f"r AS (SELECT *, (weight / sum(weight) OVER ()) / share AS ratio FROM w{k})",
        f"g AS (SELECT CASE WHEN max(ratio) > {far} THEN ({far} - 1) / (max(ratio) - 1) ELSE 1 END AS part FROM r)",
        f"""mixed AS (SELECT b.*, CASE WHEN b.tokens > 0 THEN least(1, {mixing.KEEP} * ((1 - part) + part * r.ratio)) ELSE 1 END AS chance
    FROM b CROSS JOIN g LEFT JOIN r ON b.source IS NOT DISTINCT FROM r.source AND b.lang IS NOT DISTINCT FROM r.lang AND b.topic = r.topic)""",
    ]
    return ",\n".join(parts)


OP7 = f"""WITH {mixed('documents')}
SELECT doc_id, tokens, topic, round(chance, 6) AS chance, draw < chance AS kept FROM mixed"""

ORACLES = {"op1_quality_rules": OP1, "op2_substring_dedup": OP2, "op7_mixing": OP7}
