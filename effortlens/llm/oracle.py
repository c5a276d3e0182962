"""DuckDB SQL for the opN_ queries that SQL can express."""

ORACLE = {
    "op1_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
h AS (SELECT dw.doc_id, dw.l, dw.i, bw.item_id FROM dw JOIN bw USING (l, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS j
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(j, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op10_mixing": r"""
WITH d AS (
  SELECT doc_id, source, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
o AS (
  SELECT *, coalesce(sum(3 * source_size) OVER f, 0) AS clamped, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS free,
    sum(source_size) OVER () AS total
  FROM s WINDOW f AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (
  SELECT CAST(total - clamped AS DOUBLE) / CAST(free AS DOUBLE) AS level
  FROM o WHERE 3 * source_size >= CAST(total - clamped AS DOUBLE) / CAST(free AS DOUBLE) * weight
  ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM s, lv),
w AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (SELECT *, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) AS rest FROM w),
g AS (
  SELECT source, k, gsize, coalesce(sum(gsize) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, k, sum(size) AS gsize FROM d GROUP BY source, k))
SELECT d.doc_id, d.size, p.source_size, p.target,
  CAST(whole * size + CASE WHEN before + gsize <= rest THEN size WHEN before >= rest THEN 0
    ELSE floor((rest - before) * size / CAST(gsize AS DOUBLE)) END AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN g ON g.source IS NOT DISTINCT FROM d.source AND g.k = d.k
""",
    "op7_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (g) WHERE doc_id > first)),
k AS (
  SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) u ANTI JOIN gone ON gone.doc_id = u.doc_id AND gone.p = u.p
  GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
}

#: Both operators that remove repeated passages keep and remove the same words.
ORACLE["op3_suffix_dedup"] = ORACLE["op7_substring_dedup"]


def _vector_codes(rounds: int = 4) -> str:
    """Every part against every entry, once a round; squared distances of whole numbers, exact below 2^53."""
    distance = "list_inner_product(p.x, p.x) + list_inner_product(b.c, b.c) - 2 * list_inner_product(p.x, b.c)"
    steps = [
        """
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id ASC NULLS LAST, v) AS r, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))),
p AS MATERIALIZED (
  SELECT r, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM kept, unnest([0, 1, 2, 3]) AS u(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 256)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.r, p.part, b.entry, CAST({distance} AS BIGINT) AS d FROM p JOIN b{k} b USING (part)) GROUP BY r, part)""")
        if k < rounds:
            steps.append(f"""
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(s.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(floor(total / n) ORDER BY k) AS c FROM (
      SELECT part, entry, k, sum(x) AS total, count(*) AS n
      FROM (SELECT a.part, a.entry, unnest(p.x) AS x, unnest(range(len(p.x))) AS k FROM a{k} a JOIN p USING (r, part)) GROUP BY part, entry, k)
    GROUP BY part, entry) s ON s.part = b.part AND s.entry = b.entry)""")
    return f"""
WITH {",".join(steps)},
book AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, k)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(c) AS v, unnest(range(len(c))) AS k FROM b{rounds})),
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), book
"""


def _spot_signatures() -> str:
    from effortlens.llm.spotsigs import ANCHORS

    common = ", ".join(f"'{w}'" for w in sorted(ANCHORS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, len(coalesce(text, '')) AS n FROM documents),
o AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS after FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (
  SELECT doc_id, n, 0 AS kind, text FROM o
  UNION ALL SELECT doc_id, n, 1, substr(text, 1, n - n // 3) || substr(after, 1, n // 3) FROM o
  UNION ALL SELECT doc_id, n, 2, after FROM o),
w AS (SELECT doc_id, n, kind, text, list_filter(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM e),
c AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: w[i] NOT IN ({common})) AS p FROM w),
s AS (
  SELECT *, flatten(list_transform(range(1, len(p)), lambda k:
    list_transform(CASE WHEN k > 8 AND p[k] - p[k - 8] = 8 THEN [p[k] - 1] ELSE range(CASE WHEN k = 1 THEN 1 ELSE p[k - 1] + 1 END, p[k]) END, lambda i: substr(md5(concat_ws(' ', w[i], w[p[k]], w[p[k + 1]])), 1, 12)))) AS chains
  FROM c),
f AS (
  SELECT doc_id, n, kind, text, list_sort(list_distinct(CASE WHEN len(chains) > 0 THEN chains WHEN len(w) > 0
    THEN list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: substr(md5(array_to_string(w[i:i + 2], ' ')), 1, 12)) ELSE [] END)) AS spots
  FROM s),
g AS (
  SELECT a.doc_id, a.n, a.spots AS own, b.spots AS edited, b.text AS edited_text, c.spots AS next
  FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.kind = 1 JOIN f c ON a.doc_id = c.doc_id AND c.kind = 2 WHERE a.kind = 0),
j AS (SELECT *, len(list_intersect(own, edited)) AS ne, len(list_intersect(own, next)) AS nn FROM g)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited_text) AS edited_sha256, array_to_string(own, ',') AS fingerprint,
  array_to_string(edited, ',') AS edited_fingerprint,
  CASE WHEN len(own) + len(edited) = 0 THEN 1.0 ELSE CAST(ne AS DOUBLE) / (len(own) + len(edited) - ne) END AS near_edited,
  CASE WHEN len(own) + len(next) = 0 THEN 1.0 ELSE CAST(nn AS DOUBLE) / (len(own) + len(next) - nn) END AS near_next
FROM j
"""


ORACLE["op11_vector_codes"] = _vector_codes()
ORACLE["op12_spot_signatures"] = _spot_signatures()
#: Words that are one edit apart share what one deletion leaves of both, at the same place, or of the longer.
ORACLE["op13_spelling_variants"] = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents) GROUP BY doc_id, run),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM runs, tab),
v AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM h)
  WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
del AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM v)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM del a JOIN del b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT del.word, v.word FROM del JOIN v ON del.rest = v.word
  UNION SELECT v.word, del.word FROM del JOIN v ON del.rest = v.word),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(near.other, (-v.n, near.other)) AS form, max(v.n) AS form_n FROM near JOIN v ON near.other = v.word GROUP BY near.word),
t AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
path AS (SELECT word, word AS at FROM t UNION ALL SELECT path.word, t.form FROM path JOIN t ON path.at = t.word WHERE t.form IS NOT NULL)
SELECT t.word, t.form, path.at AS root, t.n, CAST(t.n_near AS BIGINT) AS n_near, CAST(t.form_n AS BIGINT) AS form_n
FROM t JOIN path USING (word) JOIN t AS top ON top.word = path.at WHERE top.form IS NULL
"""
