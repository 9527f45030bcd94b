"""The registered queries of this folder and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import conversations, decontamination, language, licenses, line_dedup, near_dedup, neighbours, packing, phrases, spelling, tokens, toxicity, urls
from factloom.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def lowered(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_SETS = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lowered("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b.b, r.root FROM reach r JOIN both_ways b ON b.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op2_minhash_near_dedup", _SETS)
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), shingle=4, percent=80)


_LINES = """
WITH l AS (SELECT doc_id, source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
             lambda x: x <> ''))) AS line FROM documents),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT source, line FROM l JOIN t USING (source) GROUP BY source, line, pages HAVING count(*) >= 5 AND count(*) > 0.1 * pages),
h AS (SELECT source, list(line) AS gone FROM b GROUP BY source),
k AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts,
        list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(coalesce(gone, []), trim(x))) AS kept
      FROM documents LEFT JOIN h USING (source))
SELECT doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(parts) - len(kept), 0) AS BIGINT) AS n_dropped,
  md5(array_to_string(kept, chr(10))) AS kept_md5 FROM k
"""


@query("op3_line_dedup", _LINES)
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    found = line_dedup.boilerplate(docs, "source", "text")
    cleaned = line_dedup.drop_lines(docs, found, "source", "text")
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 5) == 0
    models = language.train(docs.filter(~held_out))
    found = language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), "text", models, "p")
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, labels.filter(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), toxicity.toxicity(F.col("text"), model).alias("t"))
    return found.select(
        "doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= 0.7).cast("int").alias("predicted"),
        F.size("t.passages").cast("bigint").alias("n_passages"),
    )


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.best_fit(docs, "doc_id", packing.word_count(F.col("text")))


_LEAKS = rf"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
it AS (SELECT item_id, len(w) AS length, least(len(w), 5) AS size, unnest(range(0, greatest(len(w) - 4, 1))) AS o, w FROM iw WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, length, size, o, array_to_string(w[o + 1:o + size], ' ') AS g FROM it),
ds AS (SELECT doc_id, size, unnest(range(0, len(w) - size + 1)) AS p, w FROM dw, (SELECT DISTINCT size FROM i) WHERE len(w) >= size),
d AS (SELECT doc_id, p, array_to_string(w[p + 1:p + size], ' ') AS g FROM ds),
m AS MATERIALIZED (SELECT doc_id, p, g FROM d SEMI JOIN i ON d.g = i.g),
f AS (SELECT g, count(DISTINCT doc_id) AS n FROM m GROUP BY g),
wt AS (SELECT DISTINCT i.item_id, i.length, i.size, i.g,
         round(1000 * (1 + ln(((SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) + 1.0) / (coalesce(n, 0) + 1)))) AS weight FROM i LEFT JOIN f ON f.g = i.g),
s AS (SELECT DISTINCT doc_id, length, p - o AS start FROM m JOIN i ON i.g = m.g),
c AS (SELECT DISTINCT s.doc_id, wt.item_id, s.start, wt.g, wt.weight FROM s JOIN wt ON wt.length = s.length
      JOIN m ON m.doc_id = s.doc_id AND m.g = wt.g AND m.p BETWEEN s.start AND s.start + s.length - wt.size),
t AS (SELECT item_id, sum(weight) AS total, count(*) AS n FROM wt GROUP BY item_id),
k AS (SELECT doc_id, item_id, start, sum(weight) / any_value(total) AS by_weight, count(*) / any_value(n) AS alike FROM c JOIN t USING (item_id) GROUP BY ALL),
h AS (SELECT *, by_weight >= 0.8 AS heavy, max(by_weight) OVER (PARTITION BY doc_id, item_id) >= 0.8 AS any_heavy FROM k WHERE by_weight >= 0.8 OR alike >= 0.8)
SELECT doc_id, item_id, round(max(CASE WHEN heavy THEN by_weight ELSE alike END), 6) AS similarity, CAST(greatest(min(start), 0) AS BIGINT) AS first_word, count(*) AS n_windows
FROM h WHERE heavy = any_heavy GROUP BY doc_id, item_id
"""


@query("op4_benchmark_decontamination", _LEAKS)
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_WORDS = rf"list_filter(regexp_split_to_array({lowered('text')}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_PHRASES = " UNION ALL ".join(f"SELECT '{t.label}' AS label, {_list(t.words)} AS p" for t in licenses.PHRASES)
_NOTICES = " UNION ALL ".join(f"SELECT '{t.label}' AS label, {_list(sorted(set(t.words)))} AS p, {t.need} AS need" for t in licenses.NOTICES)
_LICENCES = f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
p AS ({_PHRASES}), n AS ({_NOTICES}),
places AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM w) JOIN p ON w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p),
b AS (SELECT doc_id, label, 1.0 AS score FROM places),
blocks AS (SELECT doc_id, list_distinct(w[64 * k + 1:64 * k + 128]) AS bw FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 63) // 64)) AS k FROM w)),
m AS (SELECT doc_id, label, len(list_intersect(bw, p)) AS shared, len(p) AS size, need FROM blocks, n WHERE len(list_intersect(bw, p)) >= need),
every AS (SELECT doc_id, label, score FROM b UNION ALL SELECT doc_id, label, shared / size FROM m),
g AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score FROM every GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels
      FROM places GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN a ON a.doc_id = w.doc_id LEFT JOIN g ON g.doc_id = w.doc_id
"""


@query("op1_license_scan", _LICENCES)
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licences(table(spark, folder, "documents").select("doc_id", "text"))


#: Steps after which the rest of the ranks is below 0.85 ** 200, some 1e-14.
_STEPS = 200
_URLS = rf"""
WITH RECURSIVE r0 AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r0),
u AS (SELECT page_id, html, {lowered("raw")} AS host, regexp_extract(substr(rest, len(raw) + 1), '^[^?#]*') AS path FROM h),
rules(kind, name, start) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (SELECT page_id, arg_max(name || start, len(name || start)) AS rule, arg_max(kind, len(name || start)) AS ruled FROM u JOIN rules
        ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id),
m AS (SELECT u.page_id, host, path, rule, ruled FROM u LEFT JOIN fit ON fit.page_id = u.page_id),
links AS (SELECT src, dst, count(*) AS weight FROM (SELECT page_id, host AS src, {lowered("unnest(list_distinct(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']?(?:https?:)?//([^/?#\"''\\s<>]+)', 1)))")} AS dst
          FROM u) WHERE src <> '' AND src <> dst GROUP BY src, dst),
names AS (SELECT host FROM u WHERE host <> '' UNION SELECT dst FROM links WHERE dst <> ''),
up(src, dst) AS (SELECT host, substr(host, strpos(host, '.') + 1) FROM names WHERE len(string_split(host, '.')) > 2
       UNION SELECT dst, substr(dst, strpos(dst, '.') + 1) FROM up WHERE len(string_split(dst, '.')) > 2),
edges AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up) GROUP BY src, dst),
flows AS MATERIALIZED (SELECT 'allow' AS kind, src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges
          UNION ALL SELECT 'block', dst, src, weight / sum(weight) OVER (PARTITION BY dst) FROM edges),
seeds AS (SELECT ruled AS kind, host, count(*) / sum(count(*)) OVER (PARTITION BY ruled) AS seed FROM m WHERE ruled IS NOT NULL AND host <> '' GROUP BY ruled, host),
steps AS (SELECT 0 AS k, kind, host, seed * (1 - 0.85) AS part FROM seeds
  UNION ALL SELECT s.k + 1, f.kind, f.dst, sum(s.part * f.share * 0.85) FROM steps s JOIN flows f ON f.kind = s.kind AND f.src = s.host WHERE s.k < {_STEPS} GROUP BY s.k, f.kind, f.dst),
hosts AS (SELECT host, coalesce(sum(part) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(part) FILTER (kind = 'block'), 0) AS distrust FROM steps GROUP BY host)
SELECT page_id, m.host, path, rule, coalesce(ruled, CASE WHEN distrust > trust * (1 + 1e-4) THEN 'block' ELSE 'allow' END) AS verdict
FROM m LEFT JOIN hosts ON hosts.host = m.host
"""


@query("op5_url_filter", _URLS)
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = urls.judged(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "host", "path", "rule", "verdict")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", tokens.token_counts(F.col("text")).alias("t"))
    return docs.select("doc_id", "t.n_tokens", F.round("t.log_prob", 6).alias("log_prob"))


@query("op7_nearest_neighbours")
def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbours(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)


#: A table of the byte-wise crc32, and the crc32 of a list of bytes.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc)"""


def _crc(column: str) -> str:
    code = "unicode(x)"
    both = f"flatten(list_transform(string_split({column}, ''), lambda x: CASE WHEN {code} < 128 THEN [{code}] ELSE [192 + ({code} >> 6), 128 + ({code} & 63)] END))"
    return f"xor(list_reduce(CAST({both} AS BIGINT[]), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


_VARIANTS = rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all({lowered("text")}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, k, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM g, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
      UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.less UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.less),
b AS (SELECT p.word, count(*) AS n_near, min({{'less': -v.n, 'near': p.near}}) AS best FROM p JOIN v ON v.word = p.near GROUP BY p.word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * v.n THEN best.near END AS form,
       CASE WHEN -best.less >= 10 * v.n THEN -best.less END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
up AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
e AS (SELECT up.word, up.root FROM up JOIN f ON f.word = up.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f LEFT JOIN e ON e.word = f.word
"""


@query("op11_spelling_variants", _VARIANTS)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, folder, "documents").select("doc_id", "text")))


_BLANKS = " || ".join(f"chr({k})" for k in (32, 9, 10, 11, 12, 13))
_REPAIRS = rf"""
WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT conv_id, turn, role, text, {_crc("key")} % 20 AS f FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
        CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy
      FROM h WHERE f <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before, rtrim(text, {_BLANKS}) AS bare FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM r),
m AS MATERIALIZED (SELECT conv_id, turn, role, text, i, bare = '' AS blank, bare <> '' AND nth > 1 AS again, bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS open,
        before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au') AS wrong FROM o),
rule(q, letter, q2) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
edit AS (SELECT q, 'K' AS edit, letter, q2, 0 AS cost FROM rule UNION ALL SELECT q, 'R', letter, q2, 3 FROM rule WHERE letter <> 's'
         UNION ALL SELECT q, 'D', '', q, 4 FROM (VALUES (''), ('s'), ('u'), ('a')) x(q)),
more AS (SELECT q, q2, 1 AS k, chr(10) || CASE letter WHEN 'u' THEN 'user:' ELSE 'assistant:' END AS added FROM rule WHERE letter <> 's'
         UNION ALL SELECT q, 'a', 2, chr(10) || 'user:' || chr(10) || 'assistant:' FROM (VALUES (''), ('s')) x(q)
         UNION ALL SELECT q, q, 0, '' FROM (VALUES (''), ('s'), ('u'), ('a')) x(q)),
c AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, q2 AS q, {{'cost': 3 * k, 'audit': repeat('I', k), 'text': added}} AS b FROM c, more WHERE q = ''
  UNION ALL
  SELECT s.conv_id, s.i, o.q2, min({{'cost': s.cost + 3 * o.k, 'audit': s.audit || repeat('I', o.k), 'text': s.text || o.added}}) FROM (
    SELECT w.conv_id, m.i, e.q2 AS q, w.b.cost + e.cost + CASE WHEN open AND edit <> 'D' THEN 3 ELSE 0 END AS cost, w.b.audit || edit AS audit,
      w.b.text || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || m.text
        ELSE chr(10) || CASE letter WHEN 'u' THEN 'user:' ELSE 'assistant:' END || m.text END AS text
    FROM walk w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 JOIN edit e ON e.q = w.q
    WHERE edit = 'D' OR (NOT blank AND NOT again AND (edit = 'R' OR role[1] = letter))) s JOIN more o ON o.q = s.q GROUP BY s.conv_id, s.i, o.q2),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again) AS duplicate,
        count_if(open) AS truncated, count_if(wrong) AS illegal FROM m GROUP BY conv_id),
best AS (SELECT w.conv_id, min(w.b) AS b FROM walk w LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(n.n, 0) AND w.q IN ('', 'a') GROUP BY w.conv_id)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.b.cost AS BIGINT) AS cost, best.b.audit AS audit,
  sha256(substr(best.b.text, 2)) AS repaired_sha256
FROM best LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM best.conv_id
"""


@query("op12_conversation_repair", _REPAIRS)
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    report, _ = conversations.repair(conversations.damaged(table(spark, folder, "conversations")), with_text=False)
    return report.withColumnRenamed("sha256", "repaired_sha256")


@query("op13_phrase_fingerprints")
def op13_phrase_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.fingerprints(table(spark, folder, "documents").select("doc_id", "text"))
