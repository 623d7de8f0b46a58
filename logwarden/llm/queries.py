"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, importance, media, mixing, neardup, packing, quality, repair, search, secrets, substrings, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50, against all rows."""
    vectors = search.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return search.search(vectors, F.col("vec_id") % 50 == 0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.tokenizer_path())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digests(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are dated by page_id: one a second from 2024 on."""
    date = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(31_536_000)))
    index = warc.archive_pages(_table(spark, sf_dir, "pages"), date)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe_conversation(spark))
    return chat.conversation_digests(chat.format_events(chat.events_of_turns(turns)))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(_table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents with 20 words or more, weighed towards the benchmark."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.conversation_reports(repair.repair(repair.damage(_table(spark, sf_dir, "conversations"))))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_exact_search, op2_packing, op3_mixing, op4_toxicity, op5_substring_dedup, op6_warc, op7_near_dedup, op8_chat, op9_media, op10_secrets, op11_importance, op12_repair, op13_quality, pipeline)
    return {f.__name__: f for f in every}


OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP6 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(body)) AS n, max(page_id) OVER (PARTITION BY h) AS last_id,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST(concat('0x', substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS digest
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = last_id OR last_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM d
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>)', '\1\2\\\3', 'g') AS escaped,
         regexp_replace(role, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>)', '\1\2\\\3', 'g') AS escaped_role
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + length(escaped_role) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP5 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35
), h AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 34], ' ')) AS k FROM s
), r AS (
  SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY k) > 1
), x AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r
), g AS (
  SELECT doc_id, list(j) AS gone FROM x GROUP BY doc_id
), k AS (
  SELECT w.doc_id, len(words) AS n, coalesce(len(gone), 0) AS m,
         CASE WHEN gone IS NULL THEN words ELSE list_transform(list_where(list_zip(words, range(1, len(words) + 1)), list_transform(range(1, len(words) + 1), lambda j: NOT list_contains(gone, j))), lambda z: z[1]) END AS kept
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), u AS (
  SELECT doc_id, words, unnest(CASE WHEN len(words) >= 5 THEN range(1, len(words) - 3) WHEN len(words) > 0 THEN [1] ELSE [] END) AS i FROM w
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i : i + 4], ' ')) AS k FROM u
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT e.b, r.seen FROM r JOIN e ON r.node = e.a WHERE r.seen < e.b
), m AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
)
SELECT m.node AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.node = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.node
"""


#: CRC-32 bit by bit, over the bits of each distinct feature.
OP11 = r"""
WITH d AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark
), w AS (
  SELECT side, doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d
), f AS (
  SELECT r, side, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w
), c AS (
  SELECT r, side, feature, count(*) AS n FROM f GROUP BY ALL
), x AS (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM c)
), b AS (
  SELECT feature, CAST(xor(list_reduce(list_transform(range(4 * len(h)),
           lambda i: (CAST('0x' || substr(h, CAST(i // 8 * 2 + 1 AS BIGINT), 2) AS BIGINT) >> CAST(i % 8 AS BIGINT)) & 1),
           lambda a, bit: xor(a >> 1, 3988292384 * (xor(a, bit) & 1)), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT) % 10000 AS bucket FROM x
), n AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (WHERE side = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (WHERE side = 1), 0) AS DOUBLE) AS t FROM c JOIN b USING (feature) GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000)))) AS BIGINT) AS gain FROM n
), o AS (
  SELECT r, sum(n * gain) AS total FROM c JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 0 GROUP BY r
), k AS (
  SELECT doc_id, len(words) AS n_words, greatest(0, 2 * len(words) - 1) AS n_features, CASE WHEN len(words) = 0 THEN 0 ELSE floor(CAST(total AS DOUBLE) / (2 * len(words) - 1)) END AS weight,
         CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN o USING (r) WHERE side = 0
), z AS (
  SELECT *, CAST(weight AS BIGINT) + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM k
), p AS (
  SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS candidates FROM z
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN place <= 25 * candidates // 100 THEN place END AS rank FROM p
"""


#: Least suffixes of edits, row by row from the end; up to three inserted turns before each.
OP12 = r"""
WITH RECURSIVE k AS (
  SELECT *, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations
), d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(range(4 * len(h)), lambda i: (CAST('0x' || substr(h, CAST(i // 8 * 2 + 1 AS BIGINT), 2) AS BIGINT) >> CAST(i % 8 AS BIGINT)) & 1),
           lambda a, bit: xor(a >> 1, 3988292384 * (xor(a, bit) & 1)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM k
), e AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(role, 1, 64), substr(text, 1, 64), md5(length(role) || ':' || role || text)) AS i, substr(role, 1, 1) AS initial FROM e
), r AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair, lag(1) OVER (PARTITION BY conv_id ORDER BY i) AS later FROM o
), n AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE later = 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
), g(mid, symbol, next) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), a(q, before, mid) AS (
  VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (0, 'III', 2), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (1, 'III', 2), (2, '', 2), (2, 'I', 3), (2, 'II', 2), (2, 'III', 3), (3, '', 3), (3, 'I', 2), (3, 'II', 3), (3, 'III', 2)
), t(initial, q, label, cost, stays, next) AS (
  SELECT CAST(NULL AS VARCHAR), q, before || 'D', 2 * length(before) + 3, false, mid FROM a
  UNION ALL SELECT NULL, q, before || 'R', 2 * length(before) + 2, true, next FROM a JOIN g USING (mid) WHERE symbol <> 's'
  UNION ALL SELECT symbol, q, before || 'K', 2 * length(before), true, next FROM a JOIN g USING (mid)
), v AS (
  SELECT conv_id, n AS i, e.q, {'c': e.c, 's': e.s} AS w FROM n, (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) e(q, c, s)
  UNION ALL
  SELECT v.conv_id, v.i - 1, t.q, min({'c': CAST(v.w.c + t.cost + CASE WHEN t.stays AND r.fault = 'truncated' THEN 1 ELSE 0 END AS INTEGER), 's': t.label || v.w.s})
  FROM v JOIN r ON r.conv_id = v.conv_id AND r.i = v.i JOIN t ON t.next = v.q AND (t.initial IS NULL OR t.initial = r.initial) AND (NOT t.stays OR r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY v.conv_id, v.i, t.q
), p AS (
  SELECT conv_id, w.c AS cost, w.s AS audit FROM v WHERE i = 0 AND q = 0
), l AS (
  SELECT conv_id, j, substr(audit, CAST(j AS BIGINT), 1) AS label FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS j FROM p)
), x AS (
  SELECT *, sum(CASE WHEN label <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS i FROM l
), y AS (
  SELECT x.conv_id, j, label, r.role, CASE WHEN label = 'I' THEN '' ELSE r.text END AS text, row_number() OVER (PARTITION BY x.conv_id ORDER BY j) AS place,
         first_value(label = 'K' AND r.initial = 's') OVER (PARTITION BY x.conv_id ORDER BY j) AS led
  FROM x LEFT JOIN r ON r.conv_id = x.conv_id AND r.i = x.i WHERE label <> 'D'
), z AS (
  SELECT conv_id, string_agg(CASE WHEN label = 'K' THEN role WHEN (place + CAST(led AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS whole FROM y GROUP BY conv_id
)
SELECT u.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) u LEFT JOIN n USING (conv_id) LEFT JOIN p USING (conv_id) LEFT JOIN z USING (conv_id)
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL takes whole tables in bearable time. The others are tested against brute force: op2, op3 and op9 store or draw, op4 learns, and op10's places in a text are beyond SQL."""
    return {"op1_exact_search": OP1, "op5_substring_dedup": OP5, "op6_warc": OP6, "op7_near_dedup": OP7, "op8_chat": OP8, "op11_importance": OP11, "op12_repair": OP12}
