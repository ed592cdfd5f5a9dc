"""Queries of the corpus operators: each applies its operator to the whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, common, decontaminate, licenses, minhash, pii, quality, substrings, suffixes, toxicity


def tokenizer() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def held_out(key: Column) -> Column:
    """Rows that no label may be learned from."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, *tokenizer()).drop("text")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        common.sha256_of(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        common.sha256_of(F.col("decoded")).alias("decoded_sha256"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in pii.KINDS], common.sha256_of(told(base)).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")


def learnable(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """The labels that may be learned from: key, label."""
    rows = common.table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return rows.select(F.col("doc_id").alias("key"), F.col(label).alias("label"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.fit(keyed(spark, sf_dir), learnable(spark, sf_dir, "quality"))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, model).drop("text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.fit(keyed(spark, sf_dir), learnable(spark, sf_dir, "toxic"))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, model).drop("text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.col("places.label")
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.col("license_spans.label")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.least(F.coalesce(F.array_max("license_spans.covered"), F.lit(0.0)), F.lit(1.0))).alias("score"),
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.group(common.table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85).drop("row", "root")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicate(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", common.sha256_of(F.col("kept")).alias("kept_sha256"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.deduplicate(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", common.sha256_of(F.col("kept")).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.judge(docs, decontaminate.find(docs, common.table(spark, sf_dir, "benchmark"))).drop("text")
    return out.withColumn("items", F.array_join("items", ","))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_licenses": op5_licenses,
    "op6_minhash": op6_minhash,
    "op7_substrings": op7_substrings,
    "op8_nearest": op8_nearest,
    "op9_suffixes": op9_suffixes,
    "op10_decontaminate": op10_decontaminate,
}

#: The same results by brute force in SQL, where it is bearable on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op6_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
each AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words)),
runs AS (SELECT doc_id, string_agg(word, ' ') OVER w AS k, count(*) OVER w AS n FROM each WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
sets AS (SELECT DISTINCT doc_id, k FROM runs WHERE n = 5 UNION SELECT doc_id, array_to_string(ws, ' ') FROM words WHERE len(ws) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)""",
    "op7_substrings": r"""
WITH words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
each AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words)),
runs AS (SELECT doc_id, i, string_agg(word, ' ') OVER w AS k, count(*) OVER w AS n FROM each WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
firsts AS (SELECT k, min(doc_id) AS first FROM runs WHERE n = 13 GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM runs JOIN firsts USING (k) WHERE n = 13 AND first < doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)""",
    # Each window of an item with at most ``wrong`` substitutions holds one of ``wrong`` + 1 parts unchanged.
    "op10_decontaminate": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
items AS (SELECT item_id, ws, least(13, len(ws)) AS w, least(13, len(ws)) - ceil(0.8 * least(13, len(ws)))::bigint AS wrong FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark) WHERE len(ws) > 0),
starts AS (SELECT *, unnest(range(0, len(ws) - w + 1)) AS s FROM items),
parts AS (SELECT *, j * w // (wrong + 1) AS a, (j + 1) * w // (wrong + 1) AS b FROM (SELECT *, unnest(range(0, wrong + 1)) AS j FROM starts)),
seeds AS (SELECT item_id, s, w, a, b - a AS n, array_to_string(ws[s + a + 1 : s + b], ' ') AS k FROM parts),
sizes AS (SELECT DISTINCT n FROM seeds),
places AS (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM docs, sizes WHERE len(ws) >= n),
grams AS (SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS k FROM places),
lies AS (SELECT DISTINCT doc_id, item_id, s, w, i - a AS o FROM grams JOIN seeds USING (n, k) WHERE i >= a),
hits AS (SELECT doc_id, l.item_id, o, l.w FROM lies l JOIN docs d USING (doc_id) JOIN items m ON m.item_id = l.item_id
  WHERE o + l.w <= len(d.ws) AND 100 * len(list_filter(range(1, l.w + 1), lambda x: d.ws[o + x] = m.ws[s + x])) >= 80 * l.w),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_overlap, min(p) AS first_word FROM (SELECT doc_id, unnest(range(o, o + w)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items, coalesce(n_overlap, 0) AS n_overlap, first_word FROM docs LEFT JOIN named USING (doc_id) LEFT JOIN covered USING (doc_id)""",
    "op9_suffixes": r"""
WITH raws AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT r, p, md5(b[p + 1 : p + 400]) AS k FROM (SELECT r, b, unnest(range(0, n - 399)) AS p FROM raws)),
gone AS (SELECT r, p FROM starts WHERE k IN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1)),
runs AS (SELECT r, min(p) AS begin, max(p) + 400 AS finish FROM (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM gone)) GROUP BY r, run),
pieces AS (SELECT r, coalesce(lag(finish) OVER (PARTITION BY r ORDER BY begin), 0) AS a, begin AS z FROM runs UNION ALL SELECT raws.r, coalesce(max(finish), 0), any_value(n) FROM raws LEFT JOIN runs ON runs.r = raws.r GROUP BY raws.r),
kept AS (SELECT r, string_agg(CASE WHEN z > a THEN hex(b[a + 1 : z]) ELSE '' END, '' ORDER BY a) AS h FROM pieces JOIN raws USING (r) GROUP BY r),
sums AS (SELECT r, count(*) AS n_spans, sum(finish - begin)::bigint AS n_removed FROM runs GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256 FROM raws JOIN kept USING (r) LEFT JOIN sums USING (r)""",
}
