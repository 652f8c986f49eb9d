"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontam, divergence, jaccard, langid, licenses, media, mixing, resampling, secrets, tokens, urls, warc
from ._common import Scratch, need, table

TOKENIZER = "piece_bpe_32k.model"
OP8_RULE = jaccard.Rule(k=3, num=90, den=100)


def op1_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return langid.language_report(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filters(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op5_secret_scans(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op6_media_columns(spark, sf_dir):
    return media.text_media(table(spark, sf_dir, "documents"))


def op7_license_scans(spark, sf_dir):
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark, sf_dir):
    return jaccard.link_documents(table(spark, sf_dir, "documents"), OP8_RULE)


#: Fixed by the task's contract: one more conversation, whose texts look like marks.
EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op9_chat_formatting(spark, sf_dir):
    schema = "conv_id long, turn long, role string, text string"
    rows = need(table(spark, sf_dir, "conversations"), conv_id="long", turn="long", role="string", text="string")
    back = chat.read_chat(chat.format_chat(rows.unionByName(spark.createDataFrame(EXTRA, schema))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(said).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        digest(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_token_counts(spark, sf_dir):
    import public_tokenizers

    # A corpus is counted once and read many times: the first run fills the cache, the second encodes nothing.
    path, cache = public_tokenizers.path(TOKENIZER), Scratch(spark, "counts").folder("cache")
    docs = table(spark, sf_dir, "documents")
    tokens.add_counts(docs, path, cache)
    return tokens.count_tokens(docs, path, cache_dir=cache)


def op11_importance_resampling(spark, sf_dir):
    return resampling.importance_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark, sf_dir):
    return divergence.divergence_report(table(spark, sf_dir, "documents"))


def op13_warc(spark, sf_dir):
    return warc.warc_report(table(spark, sf_dir, "pages"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_language_id, op3_decontamination, op4_url_filters, op5_secret_scans, op6_media_columns,
        op7_license_scans, op8_ngram_jaccard, op9_chat_formatting, op10_token_counts,
        op11_importance_resampling, op12_source_divergence, op13_warc, pipeline,
    )
}

_SCATTER = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"

#: The license rules as SQL values; letters beyond ASCII are the letter Z there, as in the texts of the SQL.
_RULES = ", ".join(f"({p}, '{x}', '{k}', '{''.join(c if c.isascii() else 'Z' for c in r)}')" for p, x, k, r in licenses.rules())

ORACLES = {
    "op1_mixing": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    {_SCATTER.format("'17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')")} AS scatter FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 3.0::DOUBLE * source_size AS most, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source ASC NULLS LAST) AS i FROM s
), lv AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r
), line AS (SELECT min_by(level, i) AS level FROM lv WHERE most >= level * w),
t AS (
  SELECT lv.source, source_size, least(most, coalesce(line.level * w, most)) AS target,
    {_SCATTER.format("'17:' || coalesce('s' || lv.source, 'n')")} >> 8 AS off FROM lv, line
), c AS (
  SELECT doc_id, source, size, CAST(floor(sqrt(size::DOUBLE) * 2) AS BIGINT) AS cls, scatter FROM d
), p AS (
  SELECT *, CAST(floor(scatter * ceil(count(*) OVER (PARTITION BY source, cls) / 20000.0::DOUBLE) / 4294967296.0::DOUBLE) AS BIGINT) AS part FROM c
), k AS (
  SELECT *, row_number() OVER (PARTITION BY source, cls ORDER BY part, size DESC, scatter, doc_id) AS pos FROM p
), cl AS (
  SELECT source, cls, count(*) AS n, sum(size)::DOUBLE AS w, row_number() OVER (PARTITION BY source ORDER BY cls DESC) AS i FROM c GROUP BY source, cls
), f AS (
  SELECT source, off, target AS want, source_size::DOUBLE AS lft, CAST(0 AS BIGINT) AS passed, CAST(0 AS BIGINT) AS rate, CAST(0 AS BIGINT) AS prior, CAST(NULL AS BIGINT) AS cls, CAST(0 AS BIGINT) AS i FROM t
  UNION ALL
  SELECT source, off, want - (((off + passed + rate * n) >> 24) - ((off + passed) >> 24)) * (w / n), lft - w, passed + rate * n, rate, passed, cls, i
  FROM (SELECT f.source, f.off, f.want, f.lft, f.passed, cl.n, cl.w, cl.cls, cl.i, CAST(floor(CASE WHEN f.lft > 0 THEN least(3.0::DOUBLE, greatest(0.0::DOUBLE, f.want / f.lft)) ELSE 0.0::DOUBLE END * 16777216.0::DOUBLE) AS BIGINT) AS rate
    FROM f JOIN cl ON cl.source IS NOT DISTINCT FROM f.source AND cl.i = f.i + 1)
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM (
  SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN k.size > 0 THEN ((f.off + f.prior + f.rate * pos) >> 24) - ((f.off + f.prior + f.rate * (pos - 1)) >> 24) ELSE 0 END AS copies
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source JOIN f ON f.source IS NOT DISTINCT FROM k.source AND f.cls = k.cls)
""",
    "op3_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ts FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
dt AS (SELECT r, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS p FROM d),
bt AS (SELECT i, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS q, len(ts) AS n, least(13, (4 * len(ts) + 4) // 5) AS need FROM b),
e AS (SELECT r, i, n, need, p, q, count(*) OVER (PARTITION BY r, i, p - q) AS c, row_number() OVER (PARTITION BY r, i, p - q ORDER BY p) AS k FROM dt JOIN bt USING (t)),
f AS (SELECT * FROM e WHERE c >= need),
s AS (SELECT x.r, x.i, x.n, y.k - x.k + 1 AS m, y.p - x.p + 1 AS l, x.p, x.q FROM f x JOIN f y ON y.r = x.r AND y.i = x.i AND y.p - y.q = x.p - x.q AND y.k >= x.k + x.need - 1 AND 4 * (y.k - x.k + 1) >= 3 * (y.p - x.p + 1)),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY m DESC, l, p, q) = 1)
SELECT doc_id, item_id, m AS matched, l AS overlap_tokens, n AS item_tokens, p AS doc_start, q AS item_start, m / l AS identity FROM best JOIN d USING (r) JOIN b USING (i)
""",
    "op5_secret_scans": f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
kinds(kind, rank, pattern) AS (VALUES ('assign', 0, '(?i:(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?)([A-Za-z0-9+/_.=-]+)'), ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]+'), ('entropy', 3, '[A-Za-z0-9+/_=.-]{{20,}}')),
m AS (SELECT r, kind, rank, regexp_split_to_array(text, pattern) AS gaps, regexp_extract_all(text, pattern, 0) AS found, CASE WHEN kind = 'assign' THEN regexp_extract_all(text, pattern, 1) ELSE regexp_extract_all(text, pattern, 0) END AS vals FROM t, kinds WHERE regexp_matches(text, pattern)),
u AS (SELECT r, kind, rank, unnest(found) AS match, unnest(vals) AS val, unnest(gaps[:len(found)]) AS gap, generate_subscripts(found, 1) AS k FROM m),
s AS (SELECT r, kind, rank, match, val, CAST(sum(length(gap) + length(match)) OVER (PARTITION BY r, kind ORDER BY k) AS BIGINT) AS "end" FROM u),
base AS (SELECT r, kind, rank, "end" - length(match) AS start, "end" FROM s WHERE (kind = 'assign' AND length(val) >= 12) OR (kind = 'access' AND length(match) >= 18) OR (kind = 'hex' AND length(match) >= 16)),
c AS (SELECT r, match, "end" - length(match) AS start, "end", regexp_replace(match, '^([A-Za-z]{{2,10}}[_-]){{1,3}}', '') AS bare FROM s WHERE kind = 'entropy'),
d AS (SELECT *, CASE WHEN length(bare) >= 20 THEN bare ELSE match END AS core FROM c),
e AS (SELECT *, list_max(list_transform(range(1, length(core) - 18), lambda i: list_aggregate(string_split(substr(core, i, 20), ''), 'entropy'))) AS bits,
    len(list_filter(range(1, length(core)), lambda i: regexp_full_match(substr(core, i, 2), '[a-z][A-Z0-9]|[A-Z][0-9]|[0-9][A-Za-z]'))) AS changes FROM d),
f AS (SELECT *, CASE WHEN regexp_full_match(core, '[0-9a-fA-F]+') THEN 2.85 WHEN regexp_full_match(core, '[A-Z2-7=-]+') THEN CASE WHEN changes >= greatest(2, length(core) / 12.0) THEN 3.30 ELSE 4.05 END
    WHEN regexp_full_match(core, '[0-9A-Z+/_=.-]+|[0-9a-z+/_=.-]+') THEN CASE WHEN changes >= greatest(3, length(core) / 12.0) THEN 3.40 ELSE 4.05 END
    WHEN regexp_full_match(core, '[A-Za-z]+') THEN 3.55 ELSE CASE WHEN changes >= greatest(4, length(core) / 12.0) THEN 3.63 ELSE 4.05 END END AS least FROM e),
more AS (SELECT r, 'entropy' AS kind, 3 AS rank, start, "end" FROM f WHERE bits >= least AND len(list_filter([match, core], lambda v:
    regexp_full_match(v, '[A-Z]+|[a-z]*([A-Z]{{1,6}}[a-z]{{2,}}|([A-Z][a-z])+[A-Z][a-z]{{2,}})*([A-Z]{{0,6}}|([A-Z][a-z])+)') OR (regexp_full_match(v, '[A-Za-z._/=-]+') AND regexp_matches(v, '[._/=-][A-Za-z]') AND NOT regexp_matches(v, '[A-Za-z]{{19}}'))
    OR regexp_full_match(v, '[0-9._/=+-]+') OR regexp_full_match(v, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') OR regexp_matches(v, '(?i)example|sample|placeholder|lorem|www\\.'))) = 0
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = f.r AND b.start <= f.start AND b."end" >= f."end")),
n AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS said FROM base GROUP BY r),
g AS (SELECT r, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(said, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN n USING (r) LEFT JOIN g USING (r)
""",
    "op7_license_scans": f"""
WITH rules(priority, label, keyword, pattern) AS (VALUES {_RULES}),
t AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(' ' || translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ', '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^\\x00-\\x7F]', 'Z', 'g') AS norm FROM documents),
m AS (SELECT r, priority, label, regexp_split_to_array(norm, '\\b(?:' || pattern || ')\\b') AS gaps, regexp_extract_all(norm, '\\b(?:' || pattern || ')\\b', 0) AS found
  FROM t JOIN rules ON contains(norm, translate(keyword, 'é', 'Z')) AND regexp_matches(norm, '\\b(?:' || pattern || ')\\b')),
u AS (SELECT row_number() OVER () AS g, * FROM m),
v AS (SELECT g, r, priority, label, unnest(found) AS match, unnest(gaps[:len(found)]) AS gap, generate_subscripts(found, 1) AS k FROM u),
w AS (SELECT r, priority, label, length(match) - length(replace(match, ' ', '')) AS inner_, CAST(sum(length(gap) - length(replace(gap, ' ', '')) + length(match) - length(replace(match, ' ', ''))) OVER (PARTITION BY g ORDER BY k) AS BIGINT) AS "end" FROM v),
hits AS (SELECT DISTINCT r, priority, label, "end" - inner_ - 1 AS start, "end" FROM w),
stay AS (SELECT * FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE b.r = a.r AND b.start <= a.start AND b."end" >= a."end" AND (b.priority > a.priority OR (b.priority = a.priority AND b."end" - b.start > a."end" - a.start)))),
base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits WHERE priority = 100 GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM stay UNION SELECT r, label FROM hits WHERE priority = 100) GROUP BY r),
told AS (SELECT r, CAST(sum(priority) AS DOUBLE) AS s FROM stay GROUP BY r)
SELECT doc_id, CAST(length(norm) - length(replace(norm, ' ', '')) - 1 AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(s / (s + 50.0::DOUBLE), 0.0::DOUBLE) AS score
FROM t LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN told USING (r)
""",
    "op8_ngram_jaccard": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT b.a, b.b FROM b JOIN n p ON p.doc_id = b.a JOIN n q ON q.doc_id = b.b WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT documents.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, coalesce(min(r.b), documents.doc_id) AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN r ON r.a = documents.doc_id GROUP BY documents.doc_id
""",
    "op9_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), n AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM c
), e AS (
  SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS r, replace(replace(text, '\', '\\'), '<|', '<\|') AS t,
    CASE WHEN role = lag(role) OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text) THEN 0 ELSE 1 END AS head FROM n
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(t) + CASE WHEN head = 1 THEN length('<|turn|>' || r || '<|text|>' || '<|end|>') ELSE length('<|join|>') END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, own
""",
    "op11_importance_resampling": r"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
x AS (SELECT 0 AS goal, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, -row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT goal, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM x),
g AS (SELECT goal, r, unnest(flatten(list_transform(range(3), lambda k: list_transform(range(1, len(ws) + 1 - k), lambda i: array_to_string(ws[i:i+k], ' '))))) AS f FROM w),
n AS (SELECT goal, r, f, count(*) AS c FROM g GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM n)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2*i+1:2*i+2] AS BIGINT))), lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1])), 4294967295) % 10000 AS bucket FROM h, crc),
m AS (SELECT bucket, coalesce(sum(c) FILTER (goal = 0), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (goal = 1), 0)::DOUBLE AS t FROM n JOIN b USING (f) GROUP BY bucket),
v AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM m) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM m) + 10000)))) AS BIGINT) AS gain FROM m),
d AS (SELECT r, CAST(sum(c) AS BIGINT) AS n_features, CAST(sum(c * gain) AS BIGINT) AS weight FROM n JOIN b USING (f) JOIN v USING (bucket) WHERE goal = 0 GROUP BY r),
e AS (SELECT doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN d USING (r) WHERE goal = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * (SELECT count(*) FROM e WHERE words >= 20) // 100 THEN place END AS rank FROM o
""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.size, 0) + 2 * v.v) AS BIGINT) AS p,
  CAST(1 + (1000000000::HUGEINT * (k.total + 2)) // (v.whole + 2 * v.v) AS BIGINT) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10
""",
    "op13_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS keeper, sha1(payload) AS h FROM p)
SELECT page_id, octet_length(payload) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * j)) & 31), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to FROM m
""",
}
