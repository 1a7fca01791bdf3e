"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import chat, decontaminate, embeddings, importance, neighbours, packing, quality, secrets, sharding, simhash, substrings, whitening, wordpieces
from placeloom.llm.common import table, temporary_dir

PACK_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COUNT_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(spark, table(spark, sf_dir, "documents"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(spark, table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.token_counts(spark, table(spark, sf_dir, "documents"), COUNT_VOCABULARY)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_documents(spark, table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    return chat.chat_digest(rows.unionByName(probe))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), PACK_TOKENIZER)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended in batches, compacted and read back through the current manifest."""
    store = sharding.shard_documents(spark, table(spark, sf_dir, "documents"), f"{temporary_dir(spark, 'shards')}/store")
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(spark, table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(spark, table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_vectors(spark, table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_quality, op2_secrets, op3_embeddings, op4_token_counts, op5_simhash, op6_chat, op7_packing, op8_sharding, op9_substrings, op10_decontamination, op11_importance, op12_neighbours, op13_whitening)
    return {f.__name__: f for f in every}


ORACLES = {
    "op2_secrets": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rules(kind, rank, pat, judged, least) AS (VALUES
  ('assign', 0, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 6),
  ('access', 1, '(AKIA[A-Z0-9]{16,})', 1, 20),
  ('hex', 2, '([0-9a-f]{24,})', 1, 24),
  ('forge', 3, '(gh[pousr]_[A-Za-z0-9]{36,})', 1, 0),
  ('pem', 4, '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 1, 0)),
m AS (
  SELECT doc_id, 'assign' AS kind, 0 AS rank, 6 AS least, string_split_regex(t, (SELECT pat FROM rules WHERE rank = 0)) AS gaps, regexp_extract_all(t, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS ms, regexp_extract_all(t, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS js FROM d
  UNION ALL SELECT doc_id, 'access', 1, 20, string_split_regex(t, 'AKIA[A-Z0-9]{16,}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}', 0) FROM d
  UNION ALL SELECT doc_id, 'hex', 2, 24, string_split_regex(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}', 0), regexp_extract_all(t, '[0-9a-f]{24,}', 0) FROM d
  UNION ALL SELECT doc_id, 'forge', 3, 0, string_split_regex(t, 'gh[pousr]_[A-Za-z0-9]{36,}'), regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]{36,}', 0), regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]{36,}', 0) FROM d
  UNION ALL SELECT doc_id, 'pem', 4, 0, string_split_regex(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0), regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0) FROM d),
s AS (
  SELECT doc_id, kind, rank, least, i, len(js[i]) AS jl, len(ms[i]) AS ml,
         list_sum([len(x) for x in gaps[1:i]]) + coalesce(list_sum([len(x) for x in ms[1:i - 1]]), 0) AS start
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0)),
f AS (SELECT doc_id, kind, rank, start, kind || ':' || start::BIGINT || ':' || (start + ml)::BIGINT AS span FROM s WHERE jl >= least),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)""",
    "op3_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS low FROM v UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node WHERE r.low < l.b),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON c.node = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) ON a = v.vec_id""",
    "op6_chat": r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, len(regexp_extract_all(text, '\w+|[^\w\s]')) + 4 AS tok,
  16 + len(role) + len(replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<|', '&lt;|'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), '<<SYS>>', '&lt;<SYS>>'), '<</SYS>>', '&lt;</SYS>>'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]')) AS chars FROM raw),
h AS (SELECT conv_id, CASE WHEN role = 'system' THEN 1 ELSE 0 END AS skip, CASE WHEN role = 'system' THEN tok ELSE 0 END AS sys_tok, CASE WHEN role = 'system' THEN chars ELSE 0 END AS sys_chars FROM t WHERE k = 1),
u AS (SELECT t.conv_id, k - skip - 1 AS i, tok, chars, sum(tok) OVER w AS upto, 512 - sys_tok AS room FROM t JOIN h ON t.conv_id IS NOT DISTINCT FROM h.conv_id WHERE k > skip WINDOW w AS (PARTITION BY t.conv_id ORDER BY k)),
g(conv_id, i, start, base, room) AS (
  SELECT conv_id, 0::BIGINT, 0::BIGINT, 0::HUGEINT, room::BIGINT FROM u WHERE i = 0
  UNION ALL
  SELECT g.conv_id, u.i, CASE WHEN u.upto - g.base > g.room THEN u.i ELSE g.start END, CASE WHEN u.upto - g.base > g.room THEN u.upto - u.tok ELSE g.base END, CASE WHEN u.upto - g.base > g.room THEN u.room - 128 ELSE g.room END
  FROM g JOIN u ON u.conv_id IS NOT DISTINCT FROM g.conv_id AND u.i = g.i + 1),
wins AS (SELECT conv_id, start FROM g GROUP BY ALL),
past AS (SELECT w.conv_id, w.start, coalesce(sum(b.chars), 0) AS chars FROM wins w JOIN u f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.start
  LEFT JOIN u b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND w.start > 0 AND b.i < w.start AND (f.upto - f.tok) - (b.upto - b.tok) <= 128 GROUP BY w.conv_id, w.start),
sizes AS (SELECT conv_id, count(*) AS n_windows, sum(chars) AS chars FROM past GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM t GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  (d.chars - h.sys_chars + coalesce(n_windows, 1) * h.sys_chars + coalesce(sizes.chars, 0))::BIGINT AS formatted_chars, coalesce(n_windows, 1) AS n_windows
FROM d JOIN h ON d.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN sizes ON d.conv_id IS NOT DISTINCT FROM sizes.conv_id""",
    "op9_substrings": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d WHERE len(h) >= 200)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS head FROM r),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(head) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT c.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front FROM c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op11_importance": r"""
WITH RECURSIVE c(b, v, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM c WHERE k < 8),
tab AS MATERIALIZED (SELECT b, v FROM c WHERE k = 8),
w AS MATERIALIZED (SELECT *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT 's' AS side, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark)),
f AS MATERIALIZED (SELECT side, doc_id, array_to_string(ws[i:i + n - 1], ' ') AS feature FROM (SELECT side, doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(n))),
u AS MATERIALIZED (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)),
g(feature, h, p, x) AS (SELECT feature, h, 0, 4294967295::BIGINT FROM u
  UNION ALL SELECT feature, h, p + 1, xor(x >> 8, v) FROM g JOIN tab ON b = xor(x, ('0x' || substr(h, 2 * p + 1, 2))::BIGINT) & 255 WHERE 2 * p < len(h)),
k AS MATERIALIZED (SELECT feature, xor(x, 4294967295) % 10000 AS bucket FROM g WHERE 2 * p = len(h)),
n AS MATERIALIZED (SELECT side, doc_id, bucket, count(*) AS n FROM f JOIN k USING (feature) GROUP BY ALL),
t AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM n GROUP BY bucket),
a AS (SELECT sum(s) AS s, sum(t) AS t FROM t),
gain AS (SELECT bucket, floor(1000 * ln(((t.t + 1) * (a.s + 10000))::DOUBLE / ((t.s + 1) * (a.t + 10000))::DOUBLE))::BIGINT AS gain FROM t, a),
d AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM n JOIN gain USING (bucket) WHERE side = 's' GROUP BY doc_id),
r AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN d ON d.doc_id = w.doc_id WHERE side = 's'),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS many FROM r WHERE n_words >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * many // 100 THEN rank END AS rank FROM r LEFT JOIN o USING (doc_id)""",
    "op8_sharding": "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
}


def _pieces_sql() -> str:
    """Greedy cover of every distinct unit, one piece a step."""
    symbols = ", ".join("'" + s.replace("'", "''") + "'" for s in wordpieces.byte_symbols())
    return rf"""
WITH RECURSIVE v AS MATERIALIZED (SELECT DISTINCT regexp_replace(k, '</w>$', chr(57344)) AS piece FROM (SELECT unnest(json_keys(json, '$.model.vocab')) AS k FROM read_json_objects('{COUNT_VOCABULARY}', format='unstructured', maximum_object_size=100000000))),
t AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\p{{Z}}\s\x0b\x1c-\x1f\x{{85}}]+')) AS unit FROM documents),
s AS MATERIALIZED (SELECT unit, array_to_string(list_transform(range(0, len(h) // 2), lambda i: ([{symbols}])[('0x' || substr(h, 2 * i + 1, 2))::INT + 1]), '') || chr(57344) AS word FROM (SELECT unit, hex(encode(unit)) AS h FROM (SELECT DISTINCT unit FROM t))),
longest AS (SELECT max(len(piece)) AS m FROM v),
g(unit, word, pos, n) AS (
  SELECT unit, word, 0, 0 FROM s
  UNION ALL
  SELECT unit, any_value(word), coalesce(max(pos + len(piece)), -1), any_value(n) + 1 FROM (
    SELECT g.unit, g.word, g.pos, g.n, v.piece FROM (SELECT *, unnest(range(1, (SELECT m FROM longest) + 1)) AS l FROM g WHERE pos >= 0 AND pos < len(word)) g LEFT JOIN v ON v.piece = substr(g.word, g.pos + 1, g.l) AND len(v.piece) = g.l)
  GROUP BY unit),
c AS (SELECT unit, CASE WHEN min(pos) < 0 THEN 1 ELSE max(n) END AS n FROM g GROUP BY unit)
SELECT d.doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\p{{Z}}\s\x0b\x1c-\x1f\x{{85}}]+'), lambda w: w <> ''))::BIGINT AS n_words
FROM documents d LEFT JOIN (SELECT doc_id, sum(n) AS n_tokens FROM t JOIN c USING (unit) GROUP BY doc_id) USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return ORACLES | {"op4_token_counts": _pieces_sql()}
