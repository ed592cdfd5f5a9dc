"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all the documents its predecessor kept. All stages but the last
return the columns of ``docs``; the last one returns the tokenised documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm import bpe, common, decontaminate, minhash, pii, toxicity
from sparquill.llm.queries import keyed, learnable, tokenizer

#: Documents with a toxicity score from here on are rejected.
TOXIC = 0.7
#: Least similarity of near-duplicates in hundredths, on shingles of five words.
SIMILAR = 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; the models learn from all labels that may be learned from."""
    model = toxicity.fit(keyed(spark, sf_dir), learnable(spark, sf_dir, "toxic"))
    return toxicity.score(docs, model, score_col="__toxicity").where(F.col("__toxicity") < TOXIC).select(docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id, and every document without words.

    Rows are told apart by id and text together, so different texts of one id, and rows without ids, each count. Of rows
    that agree in both, one stays.
    """
    docs = docs.withColumn("__row", common.row_key(F.col("doc_id"), F.col("text")))
    kept = common.stored(minhash.kept_rows(minhash.group(docs, percent=SIMILAR)), "kept")
    alone = docs.join(common.small(kept.where("n = 1 or root is null").select(F.col("row").alias("__row"))), "__row", "left_semi")
    several = docs.join(common.small(kept.where("n > 1 and root is not null").select(F.col("row").alias("__row"))), "__row", "left_semi")
    return alone.unionByName(several.dropDuplicates(["__row"])).select(*[c for c in docs.columns if c != "__row"])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    judged = decontaminate.judge(docs, decontaminate.find(docs, common.table(spark, sf_dir, "benchmark")))
    return judged.where("not contaminated").select(docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data and the terms that reveal it replaced; n_chars follows the text."""
    clean = pii.sanitise(pii.find(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids; the ids decode to the text's bytes."""
    out = bpe.round_trip(docs, *tokenizer())
    same = F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")) == F.col("decoded")
    out = out.withColumn("ids", F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("ids do not decode to the text")).cast("array<int>")))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("tokens", tokenised),
]

#: No SQL can express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
