"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm import bpe_codec, hilbert_ann, licence_scan, merkle, ngram_join, packing, pii_scan, quality_mil, secret_scan, segment_topk, simhash, substring_dedup, token_alignment
from gridpulse.llm.common import table


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan.report(table(spark, sf_dir, "documents"))


def op3_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.find_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_codec.encode_decode(docs, vocabulary())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.neighbours(table(spark, sf_dir, "embeddings"))


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op8_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op11_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.report(table(spark, sf_dir, "documents"), a, b)


#: The same integers by brute force.
OP8_SQL = """
WITH used AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM used q JOIN used c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""


#: Every set against every other that shares a shingle, and what can be reached.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), classes AS (SELECT min(doc_id) AS cls, list_sort(s) AS s, count(*) AS n FROM sets WHERE len(s) > 0 GROUP BY 2
), member AS (SELECT sets.doc_id, cls FROM sets JOIN classes ON list_sort(sets.s) = classes.s
), shingles AS (SELECT cls, len(s) AS n, unnest(s) AS g FROM classes
), pairs AS (
  SELECT a.cls AS a, b.cls AS b, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m FROM shingles a JOIN shingles b ON a.g = b.g AND a.cls < b.cls GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (n + m - common)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT cls AS a, cls AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b
), named AS (SELECT a AS cls, min(b) AS component FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id
FROM sets LEFT JOIN member USING (doc_id) LEFT JOIN named USING (cls)
"""

#: Every window counted.
OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM windows WHERE g IN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1)
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


#: Trees level by level, then each leaf's way up; the check sum of an id bit by bit (3988292384: its polynomial).
OP12_SQL = r"""
WITH RECURSIVE field AS (
  SELECT doc_id, lang, source, text, n_chars, row_number() OVER () AS id,
    list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)) AS crc
  FROM documents
), told AS (
  SELECT id, doc_id, lang, crc, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') AS m, coalesce(strlen(text) || ':' || text, '-') AS t
  FROM field
), leaf AS (
  SELECT id, doc_id, lang, sha256(a || n || t) AS leaf, CASE WHEN xor(crc, 4294967295::UBIGINT) % 7 = 0 THEN sha256(a || m || t) ELSE sha256(a || n || t) END AS own FROM told
), seat AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang IS NOT NULL, lang) - 1 AS g FROM leaf
), tree AS (
  SELECT 0 AS k, g, i, leaf AS h FROM seat
  UNION ALL
  SELECT k + 1, g, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM tree) WHERE c > 1 GROUP BY k, g, i // 2
), height AS (SELECT g, max(k) AS top FROM tree GROUP BY g
), sub AS (SELECT g, h FROM tree JOIN height USING (g) WHERE k = top
), crown AS (
  SELECT 0 AS k, g AS i, h FROM sub
  UNION ALL
  SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM crown) WHERE c > 1 GROUP BY k, i // 2
), way AS (
  SELECT id, s.k AS k, x.h AS h, x.i < s.i AS l FROM (SELECT id, g, k, i >> k AS i FROM seat JOIN height USING (g), range(top) r(k)) s LEFT JOIN tree x ON x.g = s.g AND x.k = s.k AND x.i = xor(s.i, 1)
  UNION ALL
  SELECT id, 1000 + s.k, x.h, x.i < s.i FROM (SELECT id, k, g >> k AS i FROM seat, range((SELECT max(k) FROM crown)) r(k)) s LEFT JOIN crown x ON x.k = s.k AND x.i = xor(s.i, 1)
), steps AS (
  SELECT id, string_agg(h, '' ORDER BY k) AS proof, list(struct_pack(h := coalesce(h, ''), l := coalesce(l, false)) ORDER BY k) AS w FROM way GROUP BY id
), climb AS (
  SELECT id, own AS h, 1 AS j FROM seat
  UNION ALL
  SELECT c.id, sha256(CASE WHEN w[j].l THEN w[j].h || c.h ELSE c.h || w[j].h END), j + 1 FROM climb c JOIN steps USING (id) WHERE j <= len(w)
), folded AS (SELECT id, arg_max(h, j) AS h FROM climb GROUP BY id
), root AS (SELECT arg_max(h, k) AS root FROM crown)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded.h AS folded_root, folded.h = root AS verified
FROM seat JOIN sub USING (g) LEFT JOIN steps USING (id) JOIN folded USING (id), root
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_pii_anchors": op2_pii_anchors,
        "op3_licence_rules": op3_licence_rules,
        "op4_bpe_codec": op4_bpe_codec,
        "op5_hilbert_ann": op5_hilbert_ann,
        "op6_attention_quality": op6_attention_quality,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_segment_topk": op8_segment_topk,
        "op9_best_two_fit_packing": op9_best_two_fit_packing,
        "op10_secret_scan": op10_secret_scan,
        "op11_simhash_vptree": op11_simhash_vptree,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op3_licence_rules": licence_scan.oracle(), "op7_substring_dedup": OP7_SQL, "op8_segment_topk": OP8_SQL, "op12_merkle_manifest": OP12_SQL}
