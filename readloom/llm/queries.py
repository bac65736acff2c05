"""The registered queries of the training-data operators: each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import read_table
from readloom.llm.decontamination import decontaminate
from readloom.llm.exact_dedup import exact_dedup
from readloom.llm.infill import fill_in_middle, restored
from readloom.llm.lattice import lattice_scores
from readloom.llm.mixing import mix
from readloom.llm.neighbours import nearest
from readloom.llm.packing import pack
from readloom.llm.quality import quality_scores
from readloom.llm.resampling import resample
from readloom.llm.simhash import simhash_components
from readloom.llm.substrings import substring_dedup
from readloom.llm.toxicity import toxicity_scores
from readloom.llm.warc import read_warc, write_warc


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(read_table(spark, sf_dir, "pages")), with_payload=False).drop("url")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op5_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"), with_text=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), keep_ids=False)


def op9_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(read_table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


#: In the order of their numbers.
QUERIES = (
    op1_exact_dedup, op2_source_mixing, op3_warc_archives, op4_simhash_dedup, op5_quality_compression, op6_substring_dedup, op7_toxicity, op8_best_fit_packing,
    op9_lattice_scores, op10_nearest_neighbours, op11_importance_resampling, op12_decontamination, op13_fill_in_middle,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_warc_archives": OP3_SQL, "op6_substring_dedup": OP6_SQL, "op10_nearest_neighbours": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_fill_in_middle": OP13_SQL}


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP10_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score
FROM d
QUALIFY rank <= 10
"""

OP3_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

OP6_SQL = """
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), h AS (
    SELECT doc_id, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS p
    FROM (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda p: md5(array_to_string(w[p:p + 49], ' '))) AS hs FROM d WHERE len(w) >= 50)
), f AS (
    SELECT h, min(doc_id) AS first FROM h GROUP BY h
), r AS (
    SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM h JOIN f USING (h) WHERE first < doc_id
), x AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), k AS (
    SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS s, count(*) AS n FROM x ANTI JOIN r USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, coalesce(s, sha256('')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP11_SQL = r"""
WITH tables AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), texts AS (
    SELECT true AS doc, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark
), words AS (
    SELECT row_number() OVER () AS row, doc, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM texts
), runs AS (
    SELECT row, doc, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM words
), counted AS (
    SELECT row, doc, feature, count(*) AS n FROM runs GROUP BY ALL
), bytes AS (
    SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM counted)
), buckets AS (
    SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
                                    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM bytes, tables
), entries AS (
    SELECT row, doc, bucket, sum(n)::BIGINT AS n FROM counted JOIN buckets USING (feature) GROUP BY ALL
), sums AS (
    SELECT bucket, coalesce(sum(n) FILTER (doc), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT doc), 0)::DOUBLE AS t FROM entries GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT coalesce(sum(s), 0) FROM sums) + 10000) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM sums) + 10000))))::BIGINT AS gain FROM sums
), means AS (
    SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM entries JOIN gains USING (bucket) WHERE doc GROUP BY row
), scored AS (
    SELECT row, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM words LEFT JOIN means USING (row) WHERE doc
), ranked AS (
    SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (row)
"""

OP12_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda p: array_to_string(w[p:p + least(len(w), 10) - 1], ' '))) AS words
    FROM b WHERE len(w) > 0
), sizes AS (
    SELECT DISTINCT size FROM windows
), runs AS (
    SELECT row, size, unnest(range(1, len(w) - size + 2)) AS p, unnest(list_transform(range(1, len(w) - size + 2), lambda p: array_to_string(w[p:p + size - 1], ' '))) AS words
    FROM d, sizes WHERE len(w) >= size
), met AS (
    SELECT row, p, size, item FROM runs JOIN windows USING (size, words)
), hit AS (
    SELECT row, count(DISTINCT i) AS n_hit FROM (SELECT DISTINCT row, unnest(range(p, p + size)) AS i FROM met) GROUP BY row
), named AS (
    SELECT row, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT row, item FROM met) GROUP BY row
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""

OP13_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (
    SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS k1, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS k2, ('0x' || h[17:24])::BIGINT % 100 AS r, ('0x' || h[25:32])::BIGINT % 100 AS o FROM d
), f AS (
    SELECT doc_id, text, n, array_to_string(w[1:least(k1, k2)], '') AS a, array_to_string(w[least(k1, k2) + 1:greatest(k1, k2)], '') AS b, array_to_string(w[greatest(k1, k2) + 1:n], '') AS c,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r >= 50 THEN 'plain' WHEN o < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
"""
