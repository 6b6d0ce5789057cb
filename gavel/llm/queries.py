"""The registered queries of the training-data operators, one per operator,
over the whole given tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm import byte_bpe, chat, exact_dedup, filter_audit, fingerprints, importance, language_id, mixing, near_dedup, substring_dedup, suffix_dedup, token_files, toxicity
from gavel.llm.common import id_crc, read_table

#: Names of the public vocabulary files; their folder is the tokenizers package's.
BYTE_RANKS, WORD_TOKENIZER = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"
END_ID = 1


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(read_table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_crc("doc_id") % 4 == 2
    model = language_id.fit(docs.filter(~held_out))
    found = language_id.predict(docs, *model)
    return found.select(F.col("id").alias("doc_id"), (id_crc("id") % 4 == 2).alias("held_out"), "lang_pred", "score")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read_table(spark, sf_dir, "documents"), vocabulary(BYTE_RANKS), split_pattern())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("repetitions")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(read_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(read_table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read_table(spark, sf_dir, "conversations"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark)
    token_files.write(read_table(spark, sf_dir, "documents"), path, vocabulary(WORD_TOKENIZER), END_ID)
    return token_files.digests(spark, path)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_near_dedup, op3_language_id, op4_byte_bpe, op5_mixing, op6_fingerprints, op7_substring_dedup, op8_chat_format, op9_token_files, op10_toxicity, op11_importance, op12_filter_audit, op13_suffix_dedup)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "op2_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id""",
    "op8_chat_format": """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT conv_id, turn, role, text, row_number() OVER w AS pos, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS said,
      count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
full_ AS (SELECT conv_id, n, md5(said) AS h FROM n WHERE pos = n),
inner_ AS (SELECT DISTINCT md5(said) AS h FROM n WHERE pos < n),
kept AS (SELECT min(conv_id) AS conv_id, n FROM full_ WHERE h NOT IN (SELECT h FROM inner_) GROUP BY h, n)
SELECT k.conv_id, ((pos - 1) // 4096)::BIGINT AS piece, k.n AS n_turns,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text
FROM kept k JOIN n t ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL""",
    "op5_mixing": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
      ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
v AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, source_size * 2.0::DOUBLE AS most FROM z),
o AS (SELECT *, sum(most) OVER q AS cap_to, sum(w) OVER q AS w_to, sum(w) OVER () AS w_all, sum(source_size) OVER () * 1.5::DOUBLE AS pour
      FROM v WINDOW q AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (pour - coalesce(cap_to, 0)) / (w_all - coalesce(w_to, 0)) AS level FROM o
      WHERE w * ((pour - coalesce(cap_to, 0)) / (w_all - coalesce(w_to, 0))) <= most ORDER BY most / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(most, w * (SELECT level FROM l)) AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest,
      sum(size) OVER (PARTITION BY d.source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY d.source, key) AS here
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN upto <= rest THEN 1
      WHEN upto - here <= rest AND (rest - (upto - here)) * 2 >= here THEN 1 ELSE 0 END)::BIGINT AS taken FROM c""",
    "op11_importance": """
WITH RECURSIVE g AS (SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
      UNION ALL SELECT b, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM g WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS tab FROM g WHERE k = 8),
w AS (SELECT x.*, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM (SELECT 'd' AS kind, doc_id, row_number() OVER () AS uid, text FROM documents UNION ALL SELECT 't', NULL, -row_number() OVER (), text FROM benchmark) x),
f AS (SELECT kind, uid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
h AS (SELECT f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(tab[xor(c, b) % 256 + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM u, tab),
n AS (SELECT kind, uid, bucket, count(*) AS n FROM f JOIN h USING (f) GROUP BY ALL),
z AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 't'), 0)::DOUBLE AS t FROM n GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM z),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM z, a),
v AS (SELECT uid, sum(n * gain)::BIGINT AS total, sum(n)::BIGINT AS n FROM n JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY uid),
s AS (SELECT doc_id, uid, coalesce(v.n, 0)::BIGINT AS n_features, len(w) >= 20 AS may,
      CASE WHEN v.n > 0 THEN (total - ((total % v.n) + v.n) % v.n) // v.n ELSE 0 END::BIGINT AS weight,
      ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN v USING (uid) WHERE kind = 'd'),
o AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id NULLS LAST, uid) AS place, count(*) OVER (PARTITION BY may) AS n_may FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 25 * n_may // 100 THEN place END::BIGINT AS rank FROM r""",
    "op12_filter_audit": """
WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
      100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails,
      coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w JOIN m USING (t) LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, k::INT AS step, substr(o, k, 1) AS f, substr(o, 1, k - 1) AS before
      FROM o, (SELECT unnest(range(1, 6)) AS k) WHERE len(o) = 5),
r AS (SELECT c.part, filter_order, step, f, fails[ascii(f) - 64] AS hit, n, good, toxic,
      list_bool_or(list_transform(range(1, 6), lambda i: fails[i] AND contains(before, chr((64 + i)::INT)))) AS gone,
      len(list_filter(fails, lambda x: x)) AS n_fails FROM c, s)
SELECT part, filter_order, step, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN hit AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
       (sum(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r GROUP BY part, filter_order, step, f""",
    "op13_suffix_dedup": """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, p, b[p + 1:p + 50] AS s FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 49)) AS p FROM t)),
f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY s),
c AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new
      FROM p JOIN f USING (s) WHERE doc_id > first),
n AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM c),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM n GROUP BY doc_id, span),
k AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM r GROUP BY doc_id),
j AS (SELECT t.doc_id, b, n_removed, n_spans, list_concat([0], z) AS starts, list_concat(a, [octet_length(b)]) AS ends FROM t LEFT JOIN k USING (doc_id))
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN b ELSE list_reduce(list_transform(range(1, len(starts) + 1), lambda i: b[starts[i] + 1:ends[i]]), lambda x, y: x || y) END) AS kept_sha256 FROM j""",
}
