"""SQL that checks the queries, where SQL can express them."""

_WORD = r"[^\x20\x09-\x0D]+"

_HOST_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
win AS (SELECT doc_id, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '{_WORD}') GROUP BY doc_id),
base AS (SELECT w.doc_id, source, len(ws) AS n_words, length(list_aggregate(list_concat(ws, ['']), 'string_agg', '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS failed FROM j GROUP BY source),
p AS (SELECT (sum(failed) + 0.5) / (sum(n) + 1.0)::DOUBLE AS mean, coalesce(var_samp(failed / n), 0) AS v0, avg(1 / n) AS inv FROM h),
q AS (SELECT mean, mean * (1 - mean) AS bin, greatest(v0 - mean * (1 - mean) * inv, mean * (1 - mean) / 1000) AS between_hosts FROM p),
s AS (SELECT mean, greatest(bin / between_hosts - 1, 1) AS k FROM q),
r AS (SELECT source, n, k, (failed + mean * k) / (n + k) AS rate FROM h, s),
bad AS (SELECT source FROM r WHERE rate >= 0.6 AND rate - 2 * sqrt(rate * (1 - rate) / (n + k + 1)) >= 0.5)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM j.source) AS kept
FROM j"""


def line_dedup_sql(table: str) -> str:
    """doc_id, n_lines, n_removed and cleaned text of a table with unique doc_id."""
    return rf"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM {table}),
win AS (SELECT doc_id, i, w FROM (SELECT doc_id, i, lines[i] || chr(10) || lines[i+1] || chr(10) || lines[i+2] AS w
        FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l)) WHERE regexp_matches(w, '{_WORD}')),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM later),
kept AS (SELECT k.doc_id, string_agg(x, chr(10) ORDER BY p) AS t, count(*) AS n
         FROM (SELECT doc_id, unnest(lines) AS x, unnest(range(1, len(lines) + 1)) AS p FROM l) k
         ANTI JOIN gone g ON k.doc_id = g.doc_id AND k.p = g.p GROUP BY k.doc_id)
SELECT l.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(kept.t, '') END AS text
FROM l LEFT JOIN kept USING (doc_id)"""


_NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{_WORD}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, ways.b FROM reach r JOIN ways ON r.other = ways.a)
SELECT doc_id, n::BIGINT AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEMPLATES = rf"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
sg AS (SELECT rid, host, string_split(path, '/')[2:] AS segs FROM p),
sh AS (SELECT *, list_transform(segs, lambda s: CASE WHEN length(s) > 32 THEN '<long>' ELSE regexp_replace(s, '[0-9]+', '9', 'g') END) AS shapes FROM sg),
each AS (SELECT rid, host, place, segs[place + 1] AS segment, array_to_string(shapes[1:place], '/') AS ahead
    FROM (SELECT *, unnest(range(0, len(segs))) AS place FROM sh)),
nodes AS (SELECT host, place, ahead, segment, count(*) AS n FROM each GROUP BY ALL),
parents AS (SELECT host, place, ahead, count(*) AS children FROM nodes GROUP BY ALL),
literal AS (SELECT host, place, ahead, segment, true AS stays FROM nodes JOIN parents USING (host, place, ahead)
    WHERE NOT regexp_matches(segment, '[0-9]') AND length(segment) <= 32 AND (n >= 8 OR children <= 12)),
tok AS (SELECT rid, list(CASE WHEN stays THEN segment ELSE '*' END ORDER BY place) AS tokens
    FROM each LEFT JOIN literal USING (host, place, ahead, segment) GROUP BY rid),
lab AS (SELECT doc_id AS page_id, max((quality = 0)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
pg AS (SELECT p.*, coalesce(tokens, []) AS tokens, bad FROM p LEFT JOIN tok USING (rid) LEFT JOIN lab USING (page_id)),
counted AS (SELECT host, tokens, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM pg GROUP BY ALL),
branch AS (SELECT * FROM (SELECT host, labelled, bad, tokens, place, tokens[place + 1] AS token, array_to_string(tokens[1:place], '/') AS parent
    FROM (SELECT *, unnest(range(0, len(tokens))) AS place FROM counted)) WHERE token <> '*'),
kids AS (SELECT host, place, parent, token, sum(labelled) AS l, sum(bad) AS b FROM branch GROUP BY ALL),
fam AS (SELECT host, place, parent, sum(l) AS pl, sum(b) AS pb, count(*) AS k FROM kids GROUP BY ALL),
apart AS (SELECT host, place, parent, token, true AS stays FROM (SELECT *, pb::DOUBLE / nullif(pl, 0) AS pooled FROM kids JOIN fam USING (host, place, parent))
    WHERE k = 1 OR (l > 0 AND pl > l AND abs(b::DOUBLE / nullif(l, 0) - (pb - b)::DOUBLE / nullif(pl - l, 0))
        > 1.96 * sqrt(pooled * (1 - pooled) * (1.0::DOUBLE / nullif(l, 0) + 1.0::DOUBLE / nullif(pl - l, 0))))),
free AS (SELECT host, tokens, list(place) AS open FROM branch ANTI JOIN apart USING (host, place, parent, token) GROUP BY ALL),
merged AS (SELECT host, tokens, n, labelled, bad, '/' || array_to_string(list_transform(tokens,
    lambda t, i: CASE WHEN list_contains(coalesce(open, []), i - 1) THEN '*' ELSE t END), '/') AS template FROM counted LEFT JOIN free USING (host, tokens)),
tem AS (SELECT host, template, sum(labelled) AS labelled, sum(bad) AS bad FROM merged GROUP BY ALL),
hos AS (SELECT host, sum(labelled) AS hl, sum(bad) AS hb FROM tem GROUP BY ALL),
tot AS (SELECT (sum(hb) + 0.5::DOUBLE) / (sum(hl) + 1.0::DOUBLE) AS overall FROM hos),
jud AS (SELECT host, template, hl >= 3 AND (bad + 4.0::DOUBLE * ((hb + 4.0::DOUBLE * overall) / (hl + 4.0::DOUBLE))) / (labelled + 4.0::DOUBLE) >= 0.5 AS rejected
    FROM tem JOIN hos USING (host), tot),
res AS (SELECT pg.*, template, rejected, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM pg JOIN merged USING (host, tokens) JOIN jud USING (host, template))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN rejected THEN 'block' ELSE 'allow' END AS verdict, template FROM res"""


_AUDIT = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT doc_id, t, part, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, (len(ws) < 200)::INT AS a, (100 * len(list_distinct(ws)) < 50 * len(ws))::INT AS b,
    (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT AS c,
    regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce(least < w.doc_id, false)::INT AS e,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM w JOIN first USING (t) LEFT JOIN lab ON lab.doc_id = w.doc_id),
m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS bits, a + b + c + d + e AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM f GROUP BY ALL),
o AS (SELECT '' AS done UNION ALL SELECT done || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(done, x)),
s AS (SELECT done AS filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(done) = 5),
k AS (SELECT filter_order, step, (1 << (ascii(filter_order[step]) - 65))::BIGINT AS own,
    coalesce(list_sum(list_transform(range(1, step), lambda i: (1 << (ascii(filter_order[i]) - 65))::BIGINT)), 0)::BIGINT AS ahead FROM s)
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER ((bits & (ahead | own)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((bits & own) <> 0 AND (bits & ahead) = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((bits & own) <> 0 AND (bits & ahead) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (bits = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER ((bits & own) <> 0 AND (bits & ahead) = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER ((bits & own) <> 0 AND (bits & ahead) = 0), 0)::BIGINT AS toxic_lost,
    coalesce(sum(n * 120 // nullif(fails, 0)) FILTER ((bits & own) <> 0), 0)::BIGINT AS shapley
FROM m, k GROUP BY part, filter_order, step, own, ahead"""


_COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
pc AS (SELECT lang, ws, count(*) AS times FROM w WHERE len(ws) > 0 GROUP BY ALL),
g AS (SELECT lang, size, ws[i:i + size - 1] AS g, times FROM (SELECT lang, ws, times, size, unnest(range(1, len(ws) - size + 2)) AS i
    FROM (SELECT lang, ws, times, unnest(range(1, 6)) AS size FROM pc) WHERE len(ws) >= size)),
f AS (SELECT lang, size, g, array_to_string(g, ' ') AS phrase, sum(times)::HUGEINT AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE size >= 2 AND f >= 100),
cut AS (SELECT lang, phrase, f AS a, k, array_to_string(g[:k], ' ') AS x, array_to_string(g[k + 1:], ' ') AS y
    FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, k, fx.f AS l, fy.f AS r, n, (1000 * a * n) // (fx.f * fy.f) AS score
    FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.phrase = x JOIN f fy ON fy.lang = cut.lang AND fy.phrase = y JOIN t ON t.lang = cut.lang),
worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, f, array_to_string(g[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - m + 2)) AS i
    FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size >= 3))),
big AS (SELECT lang, phrase, max(f) AS longer FROM sub GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN big ON big.lang = worst.lang AND big.phrase = worst.phrase WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000"""


_NEAR_VECTORS = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT r, vec_id, v FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r < b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT r, r AS other FROM e UNION SELECT reach.r, ways.b FROM reach JOIN ways ON reach.other = ways.a),
c AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN e o ON o.r = reach.other GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n_links FROM ways GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN c USING (r) LEFT JOIN n USING (r)"""


SQL = {"op12_pivot_index": _NEAR_VECTORS, "op13_collocations": _COLLOCATIONS, "op11_filter_audit": _AUDIT, "op1_url_templates": _TEMPLATES, "op8_lsh_forest": _NEAR, "op2_host_rules": _HOST_RULES, "op5_line_windows": line_dedup_sql("documents")}
