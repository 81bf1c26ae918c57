"""Registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plantpulse.llm import byte_bpe, conversation_repair, importance, media, packing, quality_classifier, token_files, warc
from plantpulse.llm.html_extraction import extract
from plantpulse.llm.near_dedup import near_dedup
from plantpulse.llm.quality_rules import quality_rules
from plantpulse.llm import substring_dedup as windows20
from plantpulse.llm import suffix_dedup as strings100
from plantpulse.session import ship_package


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Most rows of a batch sent to Python: texts are kilobytes each.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """The package on the executors, and batches of texts that stay a few megabytes."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    set_to = int(spark.conf.get(key))
    if not 0 < set_to <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), percent=85)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings100.digest(strings100.suffix_dedup(_table(spark, sf_dir, "documents")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows20.digest(windows20.substring_dedup(_table(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.media_column(_table(spark, sf_dir, "documents")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(_table(spark, sf_dir, "pages")).drop("target_uri")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(whole), whole)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: The words of a text, as the contracts define them.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
hit AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
lines AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS l FROM d),
worded AS (SELECT *, array_to_string(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS norm, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM worded GROUP BY doc_id),
sizes AS (SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY host),
frequent AS (SELECT host, norm FROM worded JOIN sizes USING (host) GROUP BY host, norm, host_docs HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > 0.02 * host_docs),
removed AS (SELECT doc_id, sum(n) AS n_removed FROM worded JOIN frequent USING (host, norm) GROUP BY doc_id),
base AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM base
"""

_NEAR = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, ways.b FROM reach r JOIN ways ON ways.a = r.to_id)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(to_id) AS component_id, min(to_id) = r.id AS kept FROM reach r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""

_WINDOWS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i)),
gone AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
at_word AS (SELECT DISTINCT doc_id, i + o AS j FROM gone, LATERAL (SELECT unnest(range(0, 20)) AS o)),
cut AS (SELECT doc_id, list(j) AS js FROM at_word GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(js), 0) AS n_removed, sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(js, k)) END, ' '), '')) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""

_WARC = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM last
"""

#: crc32 as SQL: a table of 256 entries made by its rule, then a step a byte.
_CRC = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"


def _crc_sql(text: str) -> str:
    pairs = f"list_transform(range(CAST(length(hex(encode({text}))) // 2 AS BIGINT)), lambda k: CAST('0x' || hex(encode({text}))[2 * k + 1:2 * k + 2] AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {pairs}), lambda x, b: xor(x >> 8, t[1 + (xor(x, b) & 255)])), 4294967295)"


_REPAIR = f"""
WITH RECURSIVE {_CRC},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM src, (VALUES (0), (1)) AS v(n) WHERE fate <> 0 AND (n = 0 OR fate = 3)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
rows AS MATERIALIZED (SELECT conv_id, turn, role, text, i, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM num),
ins(s, t, paid, letters, added) AS (VALUES (0, 0, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, '', ''), (1, 2, 3, 'I', chr(10) || 'user:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 0, '', ''), (2, 3, 3, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 3, 'I', chr(10) || 'user:')),
act AS (SELECT r.conv_id, r.i, t AS s, 4 AS paid, 'D' AS letter, t, '' AS added FROM rows r, (VALUES (0), (1), (2), (3)) AS v(t)
  UNION ALL SELECT conv_id, i, s, CASE fault WHEN 3 THEN 3 ELSE 0 END, 'K', t, chr(10) || role || ':' || text FROM rows JOIN (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) AS k(s, c, t) USING (c) WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, i, s, CASE fault WHEN 3 THEN 6 ELSE 3 END, 'R', t, chr(10) || name || ':' || text FROM rows, (VALUES (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')) AS k(s, t, name) WHERE fault IN (0, 3)),
ways AS MATERIALIZED (SELECT a.conv_id, a.i, n.s, n.paid + a.paid AS paid, n.letters || a.letter AS letters, a.t, n.added || a.added AS added FROM act a JOIN ins n ON n.t = a.s),
best(conv_id, i, s, b) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'made': ''}} FROM rows
  UNION ALL SELECT p.conv_id, w.i, w.t, min({{'cost': CAST(p.b.cost + w.paid AS BIGINT), 'audit': p.b.audit || w.letters, 'made': p.b.made || w.added}}) FROM best p JOIN ways w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.i = p.i + 1 AND w.s = p.s GROUP BY p.conv_id, w.i, w.t),
sums AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated, count_if(i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
done AS (SELECT k.conv_id, any_value(k.gaps) AS gaps, any_value(k.blank) AS blank, any_value(k.duplicate) AS duplicate, any_value(k.truncated) AS truncated, any_value(k.illegal) AS illegal, min({{'cost': CAST(p.b.cost + e.paid AS BIGINT), 'audit': p.b.audit || e.letters, 'made': p.b.made || e.added}}) AS b
  FROM sums k JOIN best p ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.i = k.n JOIN ins e ON e.s = p.s AND e.t IN (0, 3) GROUP BY k.conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(d.b.cost, 0) AS cost, coalesce(d.b.audit, '') AS audit, sha256(coalesce(d.b.made[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM a.conv_id
"""

_RESAMPLE = f"""
WITH {_CRC},
texts AS (SELECT 0 AS which, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT which, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
f AS MATERIALIZED (SELECT which, doc_id, unnest(w) AS g FROM w UNION ALL SELECT which, doc_id, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM w),
place AS MATERIALIZED (SELECT g, {_crc_sql('g')} % 10000 AS b FROM (SELECT DISTINCT g FROM f), crc),
counts AS (SELECT b, count_if(which = 0) AS s, count_if(which = 1) AS t FROM f JOIN place USING (g) GROUP BY b),
total AS (SELECT CAST(sum(s) AS DOUBLE) + 10000 AS big_s, CAST(sum(t) AS DOUBLE) + 10000 AS big_t FROM counts),
gain AS (SELECT b, CAST(floor(1000 * ln(((t + 1) * big_s) / ((s + 1) * big_t))) AS BIGINT) AS gain FROM counts, total),
mean AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS sum_gain FROM f JOIN place USING (g) JOIN gain USING (b) WHERE which = 0 GROUP BY doc_id),
scored AS (SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((sum_gain - ((sum_gain % n_features + n_features) % n_features)) // n_features, 0) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || w.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM w LEFT JOIN mean USING (doc_id) WHERE which = 0),
able AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score, a.rank FROM scored s LEFT JOIN able a ON a.doc_id = s.doc_id AND a.rank <= 25 * a.n // 100
"""


def oracle_sql() -> dict[str, str]:
    """SQL twins of the operators that SQL can express at this size."""
    return {"op1_quality_rules": _QUALITY, "op2_near_dedup": _NEAR, "op6_substring_dedup": _WINDOWS, "op8_warc": _WARC, "op12_conversation_repair": _REPAIR, "op13_importance_resampling": _RESAMPLE}
