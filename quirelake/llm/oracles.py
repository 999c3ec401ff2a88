"""SQL (DuckDB) that gives the rows of the queries which SQL can express."""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: ``links`` (a, b) and ``nodes`` (id) to the smallest id that each node reaches.
_REACH = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT l.b, r.c FROM reach r JOIN both_ways l ON r.id = l.a),
    component AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""

VECTOR_JOIN = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    fine AS (SELECT id, v FROM nodes WHERE len(v) > 0 AND len([x FOR x IN v IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0),
    links AS (SELECT x.id AS a, y.id AS b FROM fine x JOIN fine y ON x.id < y.id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
    {_REACH}
    SELECT n.id AS vec_id, (SELECT count(*) FROM both_ways l WHERE l.a = n.id) AS n_links, component_id, n.id = component_id AS kept FROM nodes n JOIN component USING (id)"""

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
    shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
    nodes AS (SELECT doc_id AS id FROM documents),
    {_REACH}
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN component ON d.doc_id = component.id"""

SUBSTRING_DEDUP = f"""WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
    first AS (SELECT s, min(doc_id) AS lo FROM windows GROUP BY s),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN first USING (s) WHERE lo < doc_id),
    words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

#: Terms, the kept ones of each language, counts of each group (also of those without any), probabilities, and both parts.
SOURCE_DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents),
    tokens AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS c FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
    langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
    counted AS (SELECT lang, source, term, count(*) AS c FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
    grp AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counted USING (lang, source) GROUP BY g.lang, g.source),
    prob AS (SELECT k.lang, g.source, k.term, coalesce(x.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(x.c, 0) + 1)) // (g.n + l.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 1)) // (l.n + l.v) AS q
        FROM kept k JOIN grp g USING (lang) JOIN langs l USING (lang) LEFT JOIN counted x ON x.lang = k.lang AND x.source = g.source AND x.term = k.term),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM prob a JOIN prob b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM prob WHERE c > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM parts)
    SELECT lang, source, part, item, value, k::INTEGER AS rank FROM ranked WHERE part = 'pair' OR k <= 200"""

#: Phrases of 1 to 4 words with their counts, each cut of the candidates, and what no longer candidate makes up for.
PHRASES = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d)),
    total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    starts AS (SELECT lang, w, len(w) AS m, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
    grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= m),
    f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
    cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    asked AS (SELECT lang, k, phrase, a, j, array_to_string(w[1 : j], ' ') AS x, array_to_string(w[j + 1 : k], ' ') AS y FROM cand, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
    cuts AS (SELECT q.*, l.c AS l, r.c AS r, ((2000000::HUGEINT * a) // (l.c + r.c))::BIGINT AS score FROM asked q JOIN f l ON l.lang = q.lang AND l.k = q.j AND l.phrase = q.x JOIN f r ON r.lang = q.lang AND r.k = q.k - q.j AND r.phrase = q.y),
    lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1),
    free AS (SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.lang = c.lang AND o.k > c.k AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * o.a::HUGEINT >= 80 * c.a)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
    SELECT x.lang, rank, phrase, a, l, r, n, score FROM ranked x JOIN total t ON x.lang = t.lang WHERE rank <= 2000"""

ORACLES = {"op4_vector_join": VECTOR_JOIN, "op8_ngram_join": NGRAM_JOIN, "op9_substring_dedup": SUBSTRING_DEDUP, "op11_source_divergence": SOURCE_DIVERGENCE, "op13_phrases": PHRASES}
