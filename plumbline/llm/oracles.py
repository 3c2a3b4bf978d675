"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from plumbline.llm import urls

_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _level(name: str, rows: str) -> str:
    """Shrinks groups (rows: n, bad, prior) as urls does."""
    noise, rate = "prior * (1 - prior)", "CAST(bad AS DOUBLE) / n"
    return f"""{name}_in AS ({rows}), {name}_rho AS (
      SELECT round(least(1.0, greatest(1e-3, coalesce((sum(CASE WHEN n > 0 THEN n * pow({rate} - prior, 2) END) - sum(CASE WHEN n > 0 THEN {noise} END))
        / nullif(sum(CASE WHEN n > 0 THEN (n - 1) * {noise} END), 0), 1e-3))), 9) AS rho FROM {name}_in), {name} AS (
      SELECT *, prior * m + bad AS alpha, (1 - prior) * m + n - bad AS beta FROM (SELECT *, least({urls.STRENGTH[1]}, greatest({urls.STRENGTH[0]}, 1 / rho - 1)) AS m FROM {name}_in, {name}_rho))"""


def url_reputation() -> str:
    two = ", ".join(f"'{s}'" for s in urls.TWO_LABEL_SUFFIXES)
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fit = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    name = f"regexp_replace(host, '{urls._PORT}', '')"
    address = f"regexp_matches({name}, '{urls._ADDRESS}')"
    last = lambda k: f"array_to_string(string_split({name}, '.')[-{k}:], '.')"
    sums = "CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad"
    mean = "alpha / (alpha + beta) AS prior"
    total = "(alpha + beta)"
    return f"""WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{_PATTERN}', 1), '{urls._UPPER}', '{urls._LOWER}'), '') AS host, coalesce(regexp_extract(url, '{_PATTERN}', 2), '') AS path FROM pages),
    r AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{r}'" for c, r, _ in fit)} END AS rule, CASE {' '.join(f"WHEN {c} THEN '{v}'" for c, _, v in fit)} END AS ruled FROM p),
    c AS (SELECT host, count(rule) AS n, CAST(coalesce(sum(CASE WHEN ruled = 'block' THEN 1 ELSE 0 END), 0) AS BIGINT) AS bad FROM r GROUP BY 1),
    h AS (SELECT host, CASE WHEN {address} THEN {name} WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {address} THEN '' WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix, n, bad FROM c),
    d AS (SELECT domain, suffix, {sums} FROM h GROUP BY ALL), s AS (SELECT suffix, {sums} FROM d GROUP BY ALL),
    {_level("by_suffix", f"SELECT *, CAST({urls.ROOT_RATE} AS DOUBLE) AS prior FROM s")},
    {_level("by_domain", f"SELECT d.*, x.prior FROM d JOIN (SELECT suffix, {mean} FROM by_suffix) x USING (suffix)")},
    {_level("by_host", f"SELECT h.*, x.prior FROM h JOIN (SELECT domain, suffix, {mean} FROM by_domain) x USING (domain, suffix)")},
    j AS (SELECT host, round(alpha / {total}, 9) AS rate, round(alpha / {total} - {urls.BOUND} * sqrt(alpha * beta / ({total} * {total} * ({total} + 1))), 9) AS bound FROM by_host)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bound > {urls.BLOCK_RATE} THEN 'block' ELSE 'allow' END) AS verdict, rate AS bad_rate, bound AS bad_bound FROM r LEFT JOIN j USING (host)"""


_WORD = r"[^\x20\x09-\x0D]+"

MIX_TARGETS = f"""WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
    z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY 1),
    r AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, CAST(3 * source_size AS DOUBLE) AS most, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM z),
    l AS (SELECT *, most / weight AS ratio, (total - coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
    o AS (SELECT arg_min(level, ratio) AS open_level FROM l WHERE level <= ratio),
    t AS (SELECT source, source_size, CASE WHEN level > ratio THEN most ELSE least(most, weight * coalesce(open_level, 0)) END AS target FROM l, o)
    SELECT doc_id, size, source_size, round(CAST(target AS DOUBLE), 6) AS target FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source"""

SECRET_COUNTS = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    m AS (SELECT doc_id, regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS a,
      regexp_extract_all(text, 'AKIA[A-Z0-9]+') AS k, regexp_extract_all(text, '[0-9a-f]+') AS h FROM d)
    SELECT doc_id, CAST(len([x FOR x IN a IF length(x) >= 6]) AS BIGINT) AS n_assign, CAST(len([x FOR x IN k IF length(x) >= 20]) AS BIGINT) AS n_access, CAST(len([x FOR x IN h IF length(x) >= 24]) AS BIGINT) AS n_hex FROM m"""

QUALITY_BASE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_WORD}')) AS word, generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) AS i FROM d),
    f AS (SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS five, lead(i, 4) OVER o AS last FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM f WHERE last IS NOT NULL),
    p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, range(5) t(k) WHERE n > 1 GROUP BY 1),
    l AS (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_WORD}')] AS lines FROM d),
    v AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY 1),
    q AS (SELECT d.doc_id, CAST(coalesce(v.n, 0) AS BIGINT) AS n_words, CAST(coalesce(v.chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN p USING (doc_id))
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q"""

EXACT_NEIGHBOURS = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
    s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS score FROM e q JOIN e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id AND len(q.v) = len(e.v)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, round(score, 9) AS score FROM r WHERE rank <= 5"""

ORACLES = {"exact_neighbours": EXACT_NEIGHBOURS, "op7_url_reputation": url_reputation(), "mix_targets": MIX_TARGETS, "secret_counts": SECRET_COUNTS, "quality_base": QUALITY_BASE}
