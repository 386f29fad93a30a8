"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.llm import (
    attention_quality,
    bin_completion,
    conversation_repair,
    importance_resampling,
    line_labels,
    multiset_fingerprint,
    ngram_join,
    pivotal_mix,
    secret_markov,
    sentencepiece_rounds,
    token_blocks,
    warc_revisit,
    window_dedup,
)
from dispatchlake.llm.common import table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisit.resolve_revisits(table(spark, sf_dir, "pages")).drop("url")


OP1_SQL = """
WITH p AS (
    SELECT page_id, sha1(coalesce(html, '')) AS digest,
           strlen(coalesce(html, '')) AS bytes
    FROM pages
), o AS (
    SELECT *, max(page_id) OVER (PARTITION BY digest, bytes) AS original FROM p
)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM o
"""


def op2_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return line_labels.label_lines(docs, labels)


def op3_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = window_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (
    SELECT doc_id,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), win AS (
    SELECT doc_id, i, array_to_string(words[i:i + 12], chr(32)) AS seq
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)
), late AS (
    SELECT doc_id, i
    FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS first_id FROM win)
    WHERE doc_id > first_id
), gone AS (
    SELECT DISTINCT doc_id, i + j AS k FROM late, (SELECT unnest(range(0, 13)) AS j)
), word AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w
), kept AS (
    SELECT word.doc_id, count(*) AS n_kept,
           string_agg(word, ' ' ORDER BY word.k) AS kept_text
    FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.k = gone.k
    WHERE gone.k IS NULL
    GROUP BY word.doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words,
       (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_blocks(table(spark, sf_dir, "documents"))


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return attention_quality.quality(docs, labels)


def op7_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_markov.find_secrets(table(spark, sf_dir, "documents"))
    return secret_markov.report(found)


def op8_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack(table(spark, sf_dir, "documents"))


def op9_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pivotal_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id,
           regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS words
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], chr(32)) AS shingle
    FROM (
        SELECT doc_id, words,
               unnest(range(1, greatest(len(words) - 1, least(len(words), 1) + 1))) AS i
        FROM w
    )
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_have AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id
), link AS (
    SELECT a, b FROM both_have JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
    WHERE 100 * k >= 90 * (x.n + y.n - k)
), edge AS (
    SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
    SELECT doc_id, doc_id AS other FROM w
    UNION
    SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.other = edge.a
), least_id AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN least_id ON w.doc_id = least_id.doc_id
"""


def op11_sentencepiece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_rounds.digests(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance_resampling.resample(docs, target, grams=1).drop("n_words")


# DuckDB has no crc32: two steps of four bits per byte, on a table of sixteen entries
CRC_TABLE = "[" + ", ".join(
    str(reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(4), k)) for k in range(16)
) + "]"

def crc32_sql(text: str) -> str:
    """SQL expression for the unsigned crc32 of a text's UTF-8 bytes."""
    digits, hexes = f"hex({text})", "'123456789ABCDEF'"
    # low four bits of a byte first
    nibbles = (
        f"list_transform(range(0, length({digits})), lambda i: "
        f"strpos({hexes}, {digits}[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END])::BIGINT)"
    )
    step = f"xor(c >> 4, {CRC_TABLE}[xor(c & 15, x) + 1])"
    whole = f"list_concat([4294967295::BIGINT], {nibbles})"
    return f"xor(list_reduce({whole}, lambda c, x: {step}), 4294967295)"


OP12_SQL = rf"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), b AS (
    SELECT unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM benchmark
), f AS (
    SELECT doc_id, unnest(words) AS word FROM w
), known AS (
    SELECT word, {crc32_sql("word")} % 10000 AS bucket
    FROM (SELECT word FROM f UNION SELECT word FROM b)
), s AS (
    SELECT bucket, count(*) AS n FROM f JOIN known USING (word) GROUP BY bucket
), t AS (
    SELECT bucket, count(*) AS n FROM b JOIN known USING (word) GROUP BY bucket
), gain AS (
    SELECT k.bucket, floor(1000 * ln(
        (coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS gain
    FROM (SELECT DISTINCT bucket FROM known) k
    LEFT JOIN s ON k.bucket = s.bucket LEFT JOIN t ON k.bucket = t.bucket
), mean AS (
    SELECT doc_id, sum(gain)::BIGINT AS total, count(*) AS n
    FROM f JOIN known USING (word) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
    SELECT w.doc_id, len(words)::BIGINT AS n_features,
           coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
           coalesce(floor(total::DOUBLE / n), 0)::BIGINT + floor(-1000 * ln(-ln(
               (('0x' || substr(sha256('2024:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
               / 4294967296)))::BIGINT AS score
    FROM w LEFT JOIN mean ON w.doc_id = mean.doc_id
), placed AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
           count(*) OVER () AS n
    FROM scored WHERE n_features >= 20
)
SELECT scored.*, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed ON scored.doc_id = placed.doc_id
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(damaged)


def _step(way: str, cost: str, letter: str, line: str | None = None) -> str:
    """SQL for a way (cost, audit, lines) with one more edit."""
    lines = f"list_append({way}.t, {line})" if line else f"{way}.t"
    return f"{{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 't': {lines}}}"


def _use(way: str, role: str) -> str:
    """SQL for keeping or reroling the row as `role`, free to go or not."""
    kept = f"CASE WHEN initial = '{role[0]}' THEN role ELSE '{role}' END || ':' || text"
    return (
        f"{{'c': {way}.c + extra + (initial <> '{role[0]}')::BIGINT,"
        f" 'a': {way}.a || CASE WHEN initial = '{role[0]}' THEN 'K' ELSE 'R' END,"
        f" 't': list_append({way}.t, {kept})}}"
    )


USER, ASSISTANT = "'user:'", "'assistant:'"
OP13_SQL = rf"""
WITH RECURSIVE d AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {crc32_sql("key")} % 20 AS kind
    FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
          FROM conversations)
), r AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                     ELSE text END AS text,
           unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS again
    FROM d WHERE kind <> 0
), o AS (
    SELECT *, role[1] AS initial, regexp_replace(text, '[ 	-]+$', '') AS bare,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS nth
    FROM r
), f AS (
    SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                   WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
    FROM o
), numbers AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
    FROM f GROUP BY conv_id
), steps AS (
    SELECT conv_id, i, role, text, initial, coalesce(fault IN ('blank', 'duplicate'), FALSE) AS must,
           CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra
    FROM f
), way AS (
    SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS b0,
           {{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS b1, b1 AS b2, b1 AS b3
    FROM numbers
    UNION ALL
    SELECT conv_id, i, {_step("b0", "2", "D")},
           list_min([{_step("b1", "2", "D")},
                     CASE WHEN initial = 's' AND NOT must THEN {{'c': b0.c + extra,
                         'a': b0.a || 'K', 't': list_append(b0.t, role || ':' || text)}} END]),
           list_min([{_step("i2", "2", "D")}, CASE WHEN NOT must THEN {_use("b0", "user")} END,
                     CASE WHEN NOT must THEN {_use("b1", "user")} END,
                     CASE WHEN NOT must THEN {_use("i3", "user")} END]),
           list_min([{_step("i3", "2", "D")}, CASE WHEN NOT must THEN {_use("i2", "assistant")} END])
    FROM (
        SELECT *, list_min([b3, {_step("i2", "5", "I", ASSISTANT)}]) AS i3
        FROM (
            SELECT steps.*, b0, b1, b3,
                   list_min([b2, {_step("b0", "5", "I", USER)}, {_step("b1", "5", "I", USER)},
                             {_step("b3", "5", "I", USER)}]) AS i2
            FROM way JOIN steps ON way.conv_id = steps.conv_id AND steps.i = way.i + 1
        )
    )
), best AS (
    SELECT numbers.conv_id, list_min([b0, b3, {_step("b2", "5", "I", ASSISTANT)},
               {{'c': b1.c + 10, 'a': b1.a || 'II', 't': b1.t || [{USER}, {ASSISTANT}]}}]) AS b
    FROM way JOIN numbers ON way.conv_id = numbers.conv_id AND way.i = n
)
SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
       coalesce(b.a, '') AS audit,
       sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) every
LEFT JOIN numbers ON every.conv_id IS NOT DISTINCT FROM numbers.conv_id
LEFT JOIN best ON every.conv_id = best.conv_id
"""


QUERIES = {
    "op1_warc_revisits": (op1_warc_revisits, OP1_SQL),
    "op2_line_labels": (op2_line_labels, None),
    "op3_multiset_fingerprint": (op3_multiset_fingerprint, None),
    "op4_window_dedup": (op4_window_dedup, OP4_SQL),
    "op5_token_blocks": (op5_token_blocks, None),
    "op6_attention_quality": (op6_attention_quality, None),
    "op7_secret_markov": (op7_secret_markov, None),
    "op8_bin_completion": (op8_bin_completion, None),
    "op11_sentencepiece_rounds": (op11_sentencepiece_rounds, None),
    "op12_importance_resampling": (op12_importance_resampling, OP12_SQL),
    "op13_conversation_repair": (op13_conversation_repair, OP13_SQL),
    "op10_ngram_join": (op10_ngram_join, OP10_SQL),
    "op9_pivotal_mix": (op9_pivotal_mix, None),
}
