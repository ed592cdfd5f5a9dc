"""The catalogue: one query for each operator, with the SQL that gives the same rows where SQL can.

Roles of the tables: ``documents`` is the corpus (a source's documents in order are its pages), ``benchmark`` the
questions, ``embeddings`` the vectors of documents (vec_id = doc_id) or the patches of pages (four to a page), ``conversations``
the log of questions.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text as tx, vectors as vx
from ..operators import bm25, cache, chunking, compare, dense, evaluate, filters, fusion, multihop, multimodal, pages, prompts, rerank, tables, visual
from ..operators.ranking import few, top
from ..session import delete, work_dir
from ..streaming import traffic
from . import config as cf
from .retriever import Retriever

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL pieces


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return literal(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]"
        return str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


def sql_tokens(c: str) -> str:
    return rf"list_filter(string_split_regex(trim(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+'), lambda x: length(x) > 1)"


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def sql_words(c: str) -> str:
    return rf"list_filter(string_split_regex({sql_strip(c)}, '\s+'), lambda x: x <> '')"


def sql_any(c: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {literal(p)})" for p in phrases) + ")"


def sql_count(c: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains({c}, {literal(p)})::bigint" for p in phrases) + ")"


def sql_upper(c: str) -> str:
    return f"(upper({c}) = {c} AND lower({c}) <> {c})"


def sql_header(c: str) -> str:
    w = sql_words(c)
    first = sql_upper("substring(x, 1, 1)")
    return f"(({sql_upper(sql_strip(c))} AND length({sql_strip(c)}) < 100) OR (len({w}) <= 6 AND len({w}) > 0 AND len(list_filter({w}, lambda x: {first}))::double / greatest(len({w}), 1) > 0.7))"


def sql_table_like(c: str) -> str:
    return rf"(len(regexp_extract_all({c}, '[\d,]+\.?\d*')) >= 2 OR ((contains({c}, chr(9)) OR contains({c}, '  ')) AND len(string_split_regex({sql_strip(c)}, '\t|\s{{2,}}')) >= 3))"


def sql_content_type(c: str) -> str:
    lines = f"string_split({sql_strip(c)}, chr(10))"
    ratio = f"len(list_filter({lines}, lambda y: {sql_table_like('y')}))::double / len({lines})"
    mean = f"(length({sql_strip(c)}) - len({lines}) + 1)::double / len({lines})"
    return f"CASE WHEN len({lines}) <= 3 AND {mean} < 100 AND ({sql_upper(sql_strip(c))} OR {sql_header(c)}) THEN 'header' WHEN {ratio} > 0.5 AND len({lines}) > 3 THEN 'table' WHEN {ratio} > 0.2 THEN 'mixed' ELSE 'text' END"


def sql_section(c: str) -> str:
    head = f"substring(lower({c}), 1, 500)"
    return "CASE " + " ".join(f"WHEN regexp_matches({head}, {literal(p)}) THEN {literal(label)}" for p, label in tx.SECTIONS) + " END"


def sql_numeric(c: str) -> str:
    v = sql_strip(c)
    v = f"(CASE WHEN starts_with({v}, '(') AND ends_with({v}, ')') THEN '-' || substring({v}, 2, length({v}) - 2) ELSE {v} END)"
    v = rf"regexp_replace({v}, '[$€£¥,\s]', '', 'g')"
    return f"CASE WHEN ends_with({v}, '%') THEN TRY_CAST(left({v}, length({v}) - 1) AS double) / 100 ELSE TRY_CAST({v} AS double) END"


def sql_bm25(questions: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    return f"""
toks AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
questions AS ({questions}),
q AS (SELECT query_id, unnest({sql_tokens('text')}) AS term FROM questions),
scored AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""


def sql_dense(metric: str, vectors: str = "embeddings", questions: str = "SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0") -> str:
    a, b = "q.v::double[]", "e.embedding::double[]"
    score = {"cosine": f"list_cosine_similarity({a}, {b})", "l2": f"-greatest(list_inner_product({a}, {a}) + list_inner_product({b}, {b}) - 2 * list_inner_product({a}, {b}), 0)"}[metric]
    return f"""
dq AS ({questions}),
ds AS (SELECT query_id, vec_id, round({score}, 6) AS score FROM dq q, {vectors} e),
de AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ds)"""


NUMBERED = "SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents"
PAIRED = "SELECT item_id AS query_id, embedding AS v FROM benchmark JOIN embeddings ON vec_id = item_id"
KNOWN = "(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))"
LISTS = f"{sql_bm25()}, {sql_dense('l2', KNOWN, PAIRED)}, dl20 AS (SELECT query_id, vec_id AS doc_id, rank, round(1 / (1 + -score), 6) AS score FROM de WHERE rank <= 20), sp20 AS (SELECT query_id, doc_id, rank, score FROM bm WHERE rank <= 20)"


def sql_fused(wd: float, ws: float, k: int, key: str = "doc_id") -> str:
    text = "JOIN documents USING (doc_id)" if key == "text" else ""
    return f"""
SELECT query_id, {key}, arg_max(doc_id, list * 1000 + rank) AS doc, round(sum(w / ({k} + rank)), 6) AS rrf, min(list * 1000 + rank) AS met,
 max(CASE WHEN list = 0 THEN rank END) AS dense_rank, arg_max(score, rank) FILTER (list = 0) AS dense_score, max(CASE WHEN list = 1 THEN rank END) AS sparse_rank, arg_max(score, rank) FILTER (list = 1) AS sparse_score
FROM (SELECT *, 0 AS list, {wd}::double AS w FROM dl20 UNION ALL SELECT *, 1, {ws}::double FROM sp20) {text} GROUP BY query_id, {key}"""


# ---------------------------------------------------------------- shared tables


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_INDEXES: dict[tuple[str, str], str] = {}


def _forget(spark: SparkSession) -> None:
    while _INDEXES and spark.sparkContext._jsc is not None:
        delete(spark, _INDEXES.popitem()[1])


def index(spark: SparkSession, d: str) -> bm25.Bm25Index:
    """The index of a folder's documents, built and saved on first use in a session, and loaded from then on."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        if not _INDEXES:
            atexit.register(_forget, spark)
        path = f"{work_dir(spark)}/sparquill/bm25-{uuid.uuid4().hex}"
        bm25.save(bm25.build(table(spark, d, "documents")), path)
        _INDEXES[key] = path
    return bm25.load(spark, _INDEXES[key])


def asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The queries of searches over vectors: every id divisible by 50."""
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def retriever(spark: SparkSession, d: str) -> Retriever:
    docs = pages.numbered(table(spark, d, "documents")).select("doc_id", "text", "lang", "page")
    return Retriever(docs, table(spark, d, "embeddings"), index(spark, d))


def paired(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return questions(spark, d).join(vectors, "query_id")


def both_lists(spark: SparkSession, d: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    r = retriever(spark, d)
    return r._dense(paired(spark, d), k, None), r._sparse(questions(spark, d), k, None)


# ---------------------------------------------------------------- sparse


@query(f"WITH {sql_bm25()} SELECT query_id, rank, doc_id, score FROM bm WHERE rank <= 5")
def bm25_topk(spark, d):
    return bm25.search(index(spark, d), questions(spark, d), 5)


@query(f"SELECT count(*) AS n, round(avg(len({sql_tokens('text')})), 6) AS avgdl FROM documents")
def bm25_index_stats(spark, d):
    return bm25.stats(table(spark, d, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY term")
def bm25_df(spark, d):
    return bm25.document_frequency(bm25.postings(table(spark, d, "documents")))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY ALL")
def doc_term_freq(spark, d):
    return bm25.postings(table(spark, d, "documents")).select("doc_id", "term", "tf")


@query(f"WITH {sql_bm25()}, ok AS (SELECT bm.*, row_number() OVER (PARTITION BY query_id ORDER BY bm.rank) AS r FROM bm JOIN ({NUMBERED}) USING (doc_id) WHERE bm.rank <= 15 AND lang = 'en' AND page <= 20) SELECT query_id, r AS rank, doc_id, score FROM ok WHERE r <= 5")
def sparse_filtered_post(spark, d):
    found = bm25.search(index(spark, d), questions(spark, d), 15)
    docs = pages.numbered(table(spark, d, "documents")).select("doc_id", "lang", "page")
    return filters.post_filter(found, docs, (F.col("lang") == "en") & filters.MetadataFilter(page_end=20).condition(), 5).select("query_id", "rank", "doc_id", "score")


@query(f"WITH {sql_bm25()}, ok AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id)) SELECT query_id, rank, doc_id FROM ok WHERE rank <= 5")
def quality_filtered_bm25(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    return top(bm25.score(index(spark, d), questions(spark, d)).join(good, "doc_id", "left_semi"), 5).select("query_id", "rank", "doc_id")


# ---------------------------------------------------------------- dense


@query(f"WITH {sql_dense('l2')} SELECT query_id, rank, vec_id, -score + 0.0 AS distance, round(1 / (1 - score), 6) AS similarity FROM de WHERE rank <= 5")
def dense_l2_topk(spark, d):
    return dense.with_similarity(dense.search(table(spark, d, "embeddings"), asked_vectors(spark, d), 5, "l2"))


@query(f"WITH {sql_dense('cosine')} SELECT query_id, rank, vec_id, score AS cosine FROM de WHERE rank <= 5")
def dense_cosine_topk(spark, d):
    return dense.search(table(spark, d, "embeddings"), asked_vectors(spark, d), 5, "cosine").withColumnRenamed("score", "cosine")


@query(f"WITH {sql_dense('l2')} SELECT query_id, rank, vec_id, round(1.0::double / rank, 6) AS score FROM de WHERE rank <= 5")
def dense_rank_scores(spark, d):
    found = dense.search(table(spark, d, "embeddings"), asked_vectors(spark, d), 5, "l2").withColumn("score", F.lit(None).cast("double"))
    return dense.with_rank_scores(found)


_OPEN = f"WITH {sql_dense('l2', KNOWN)}, ok AS (SELECT de.query_id, de.vec_id, de.score, row_number() OVER (PARTITION BY de.query_id ORDER BY de.rank) AS r FROM de JOIN ({NUMBERED}) p ON p.doc_id = de.vec_id WHERE lang = 'en' AND page <= 20 AND de.rank <= MOST) SELECT query_id, r AS rank, vec_id AS doc_id, round(1 / (1 - score), 6) AS score FROM ok WHERE r <= 5"


def _filtered(spark, d, mode: str) -> DataFrame:
    docs = pages.numbered(table(spark, d, "documents")).select("doc_id", "text", "lang", "page")
    if mode == "pre":
        docs = docs.where("lang = 'en'")
        config = cf.RetrievalConfig(filter_mode="pre").with_metadata_filter(page_end=20)
        return Retriever(docs, table(spark, d, "embeddings")).retrieve(asked_vectors(spark, d), config)
    found = Retriever(docs, table(spark, d, "embeddings")).retrieve(asked_vectors(spark, d), cf.RetrievalConfig(top_k=15))
    return filters.post_filter(found, docs.drop("text"), (F.col("lang") == "en") & filters.MetadataFilter(page_end=20).condition(), 5).select("query_id", "rank", "doc_id", "score")


@query(_OPEN.replace("MOST", "15"))
def dense_filtered_post(spark, d):
    return _filtered(spark, d, "post")


@query(_OPEN.replace("MOST", "1000000000"))
def dense_filtered_pre(spark, d):
    return _filtered(spark, d, "pre")


_BUCKETS = "list_transform(range(0, 32), lambda b: len(list_filter({0}, lambda t: ('0x' || substr(md5(t), 1, 8))::bigint % 32 = b))::double)"


@query(f"WITH e AS (SELECT doc_id AS vec_id, {_BUCKETS.format(sql_tokens('text'))} AS embedding FROM documents), {sql_dense('cosine', '(SELECT * FROM e)', 'SELECT item_id AS query_id, ' + _BUCKETS.format(sql_tokens('text')) + ' AS v FROM benchmark')} SELECT query_id, rank, vec_id AS doc_id, score AS cosine FROM de WHERE rank <= 5")
def embedded_topk(spark, d):
    embed = vx.hashed_embedding(tx.tokens(F.col("text")))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), embed.alias("embedding"))
    found = dense.search(docs, questions(spark, d).select("query_id", embed.alias("vector")), 5, "cosine")
    return found.select("query_id", "rank", F.col("vec_id").alias("doc_id"), F.col("score").alias("cosine"))


# ---------------------------------------------------------------- fusion

_RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, met)"


@query(f"WITH {LISTS}, f AS ({sql_fused(0.7, 0.3, 60)}), r AS (SELECT *, {_RANKED} AS rank FROM f) SELECT query_id, rank, doc_id, rrf, dense_rank, dense_score, sparse_rank, sparse_score FROM r WHERE rank <= 5")
def hybrid_rrf(spark, d):
    out = fusion.fuse(*both_lists(spark, d), key="doc_id")
    return out.select("query_id", "rank", "doc_id", "rrf", "dense_rank", "dense_score", "sparse_rank", "sparse_score")


@query(f"WITH {LISTS}, f AS ({sql_fused(0.7, 0.3, 60, 'text')}), r AS (SELECT *, {_RANKED} AS rank FROM f) SELECT query_id, rank, doc AS doc_id, rrf, dense_rank, dense_score, sparse_rank, sparse_score FROM r WHERE rank <= 5")
def hybrid_rrf_textkey(spark, d):
    texts = table(spark, d, "documents").select("doc_id", "text")
    out = fusion.fuse(*[x.join(texts, "doc_id") for x in both_lists(spark, d)])
    return out.select("query_id", "rank", "doc_id", "rrf", "dense_rank", "dense_score", "sparse_rank", "sparse_score")


_GRID = [(0.7, 0.3, 10), (0.7, 0.3, 60), (0.5, 0.5, 10), (0.5, 0.5, 60), (1.0, 0.0, 10), (1.0, 0.0, 60)]


@query(f"WITH {LISTS}, " + ", ".join(f"f{i} AS ({sql_fused(*g)})" for i, g in enumerate(_GRID)) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}/{b}/{k}' AS config, query_id, {_RANKED} AS rank, doc_id, rrf FROM f{i}" for i, (a, b, k) in enumerate(_GRID)) + ") WHERE rank <= 5")
def rrf_weighted_grid(spark, d):
    lists, out = both_lists(spark, d), None
    for a, b, k in _GRID:
        part = fusion.fuse(*lists, weights=(a, b), k=k, key="doc_id").select(F.lit(f"{a}/{b}/{k}").alias("config"), "query_id", "rank", "doc_id", "rrf")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {LISTS}, f AS ({sql_fused(0.7, 0.3, 60, 'text')}), r AS (SELECT *, {_RANKED} AS rank FROM f), ok AS (SELECT r.query_id, r.doc AS doc_id, r.rrf, row_number() OVER (PARTITION BY query_id ORDER BY r.rank) AS n FROM r JOIN ({NUMBERED}) p ON p.doc_id = r.doc WHERE page <= 20 AND r.rank <= 15) SELECT query_id, n AS rank, doc_id, rrf AS score FROM ok WHERE n <= 5")
def hybrid_filtered_post(spark, d):
    return retriever(spark, d).retrieve(paired(spark, d), cf.HYBRID.with_metadata_filter(page_end=20))


# ---------------------------------------------------------------- second stage and configurations

_RERANKED = """, c AS (SELECT l.query_id, l.doc_id, l.rank, l.score, list_distinct({q}) AS qt, {t} AS dt FROM {lists} l JOIN benchmark b ON b.item_id = l.query_id JOIN documents x ON x.doc_id = l.doc_id WHERE l.rank <= 20),
rs AS (SELECT *, round(coalesce(len(list_intersect(qt, dt))::double / nullif(len(qt), 0), 0), 6) AS rerank_score FROM c),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank_rank FROM rs)"""


def _reranked(lists: str) -> str:
    return _RERANKED.format(q=sql_tokens("b.text"), t=sql_tokens("x.text"), lists=lists)


@query(f"WITH {sql_bm25()}{_reranked('bm')} SELECT query_id, doc_id, rank AS original_rank, rerank_rank, score AS original_score, rerank_score FROM rr WHERE rerank_rank <= 5")
def rerank_overlap(spark, d):
    found = bm25.search(index(spark, d), questions(spark, d), 20)
    rows = found.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").join(questions(spark, d).select("query_id", F.col("text").alias("query")), "query_id")
    return rerank.rerank(rows)


@query(f"WITH {LISTS} SELECT query_id, rank, doc_id, score FROM dl20 WHERE rank <= 5")
def preset_baseline(spark, d):
    return retriever(spark, d).retrieve(paired(spark, d), cf.BASELINE)


@query(f"WITH {LISTS}{_reranked('dl20')} SELECT query_id, rerank_rank AS rank, doc_id, rerank_score AS score FROM rr WHERE rerank_rank <= 5")
def preset_reranked(spark, d):
    return retriever(spark, d).retrieve(paired(spark, d), cf.RERANKED)


@query(f"WITH {LISTS}, f AS ({sql_fused(0.7, 0.3, 60, 'text')}), r AS (SELECT *, {_RANKED} AS rank FROM f) SELECT query_id, rank, doc AS doc_id, rrf AS score FROM r WHERE rank <= 5")
def preset_hybrid(spark, d):
    return retriever(spark, d).retrieve(paired(spark, d), cf.HYBRID)


@query(f"WITH {LISTS}, f AS ({sql_fused(0.7, 0.3, 60, 'text')}), fl AS (SELECT query_id, doc AS doc_id, rrf AS score, {_RANKED} AS rank FROM f){_reranked('fl')} SELECT query_id, rerank_rank AS rank, doc_id, rerank_score AS score FROM rr WHERE rerank_rank <= 5")
def preset_hybrid_reranked(spark, d):
    return retriever(spark, d).retrieve(paired(spark, d), cf.HYBRID_RERANKED)


@query(f"WITH {sql_bm25()}, p AS ({NUMBERED}), s AS (SELECT query_id, list('[page ' || page || '] ' || p.text ORDER BY rank) AS c FROM bm JOIN p USING (doc_id) WHERE rank <= 3 GROUP BY query_id) SELECT query_id, 'Answer from the context only; if it does not hold the answer, say so.' || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10) || 'Context:' || chr(10) || array_to_string(c, chr(10) || chr(10)) || chr(10) || chr(10) || 'Answer:' AS prompt FROM s JOIN benchmark b ON item_id = query_id")
def answer_prompts(spark, d):
    docs = pages.numbered(table(spark, d, "documents")).select("doc_id", "page", "text")
    found = bm25.search(index(spark, d), questions(spark, d), 3).join(docs, "doc_id")
    rows = prompts.gathered(found, prompts.page_body(), 3).join(questions(spark, d), "query_id")
    return rows.select("query_id", prompts.answer_prompt(F.col("text"), F.col("contexts")).alias("prompt"))


@query(f"WITH {sql_bm25()} SELECT query_id, '[' || string_agg('{{\"rank\":' || rank || ',\"doc_id\":' || doc_id || '}}', ',' ORDER BY rank) || ']' AS result FROM bm WHERE rank <= 5 GROUP BY query_id")
def results_as_json(spark, d):
    return prompts.as_json(bm25.search(index(spark, d), questions(spark, d), 5), ["rank", "doc_id"])


_ANSWERS = [(1, '{"answer": "yes", "pages": [4, 8]}'), (2, "not json"), (3, None), (4, '{"answer": "no"}')]


@query(f"SELECT id::bigint AS id, CASE id WHEN 1 THEN 'yes' WHEN 4 THEN 'no' END AS answer, CASE id WHEN 1 THEN '4,8' END AS pages, id IN (2, 3) AS failed FROM {values(_ANSWERS, 'id, body')}")
def parsed_answers(spark, d):
    rows = spark.createDataFrame(_ANSWERS, "id bigint, body string")
    a = prompts.parsed(F.col("body"), "answer string, pages array<bigint>")
    return rows.select("id", a["value"]["answer"].alias("answer"), F.array_join(a["value"]["pages"], ",").alias("pages"), a["failed"].alias("failed"))


# ---------------------------------------------------------------- pages and chunks

_REPORT = [("report", 1, "EXECUTIVE SUMMARY\nWe grew."), ("report", 2, "plain prose"), ("report", 3, "Notes to the financial statements\nNote 1"), ("report", 4, "Figure 2: Income by year, 1,200 and 35%"), ("report", 5, "Liquidity Risk\nFY 2024, 12/31/2024"), ("report", 6, "a, b, c\n1, 2, 3\n4, 5, 6\n7, 8, 9"), ("report", 7, ""), ("report", 8, "Table 3: Loans outstanding\nx  y  z\n1  2  3"), ("report", 9, "Auditor's report"), ("report", 10, "Exhibit 1. Trend chart")]
_PAGES = f"SELECT source, page, text FROM ({NUMBERED}) UNION ALL SELECT source, page::bigint, text FROM {values(_REPORT, 'source, page, text')}"


def report_pages(spark: SparkSession, d: str) -> DataFrame:
    more = spark.createDataFrame(_REPORT, "source string, page bigint, text string")
    return pages.numbered(table(spark, d, "documents")).select("source", "page", "text").unionByName(more)


@query(f"WITH p AS ({_PAGES}), s AS (SELECT source, page, {sql_section('text')} AS own FROM p) SELECT source, page, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY source ORDER BY page ROWS UNBOUNDED PRECEDING), 'Introduction') AS section FROM s")
def page_sections(spark, d):
    return pages.sections(report_pages(spark, d)).select("source", "page", "section")


@query(f"WITH p AS ({_PAGES}), m AS (SELECT source, page, {sql_content_type('text')} AS content_type, regexp_matches(lower(text), {literal(tx.FIGURES)}) AS has_figures, len({sql_words('text')}) AS word_count, len(string_split({sql_strip('text')}, chr(10))) AS line_count FROM p) SELECT *, content_type IN ('table', 'mixed') AS has_tables FROM m")
def page_metadata(spark, d):
    return pages.metadata(report_pages(spark, d)).drop("text")


@query(f"WITH p AS ({_PAGES}) SELECT source, page, array_to_string(list_filter(list_transform(string_split(text, chr(10))[1:20], lambda y: {sql_strip('y')}), lambda z: z <> '' AND length(z) < 100 AND {sql_header('z')})[1:5], '|') AS headers FROM p")
def page_headers(spark, d):
    return report_pages(spark, d).select("source", "page", F.array_join(tx.headers(F.col("text")), "|").alias("headers"))


@query(f"WITH p AS ({_PAGES}) SELECT source, page, regexp_matches(text, {literal(tx.NUMBERS)}) AS has_numbers, regexp_matches(text, {literal(tx.DATES)}) AS has_dates FROM p")
def chunk_flags(spark, d):
    return report_pages(spark, d).select("source", "page", tx.has_numbers(F.col("text")).alias("has_numbers"), tx.has_dates(F.col("text")).alias("has_dates"))


def _sql_caption(patterns: list[str], limit: int) -> str:
    found = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(text, {literal(p)}) THEN trim(regexp_extract(text, {literal(p)}, 0)) END" for p in patterns) + ")"
    return f"CASE WHEN length({found}) > {limit} THEN left({found}, {limit}) || '...' ELSE {found} END"


@query(f"WITH p AS ({_PAGES}) SELECT source, page, {_sql_caption(tx.TABLE_CAPTIONS, 200)} AS table_caption, {_sql_caption(tx.FIGURE_CAPTIONS, 300)} AS figure_caption, regexp_matches(text, {literal(tx.FIGURE_MENTION)}) AS mentions_figure FROM p")
def captions(spark, d):
    t = F.col("text")
    return report_pages(spark, d).select("source", "page", tx.table_caption(t).alias("table_caption"), tx.figure_caption(t).alias("figure_caption"), tx.mentions_figure(t).alias("mentions_figure"))


@query(f"SELECT page::bigint AS page FROM {values(_REPORT, 'source, page, text')} WHERE regexp_matches(text, {literal(tx.FIGURE_MENTION)}) AND page NOT IN (4)")
def pages_without_figures(spark, d):
    report = spark.createDataFrame(_REPORT, "source string, page bigint, text string")
    return pages.without_figures(report, spark.createDataFrame([(4,)], "page bigint")).select("page")


@query(f"WITH p AS (SELECT page::bigint AS page, text FROM {values(_REPORT, 'source, page, text')}) SELECT page, text, coalesce(CASE page WHEN 1 THEN 'Executive Summary' WHEN 2 THEN 'Executive Summary' END, 'Unknown') AS section FROM p WHERE length({sql_strip('text')}) > 0")
def built_documents(spark, d):
    report = spark.createDataFrame(_REPORT, "source string, page bigint, text string").select("page", "text")
    about = spark.createDataFrame([(1, "Executive Summary"), (2, "Executive Summary")], "page bigint, section string")
    return pages.documents(report, about)


@query("SELECT doc_id, i AS chunk_index, substring(text, 1 + i * 850, 1000) AS text, length(substring(text, 1 + i * 850, 1000)) AS n_chars FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text) - 150, 1) - 1) // 850 + 1)) AS i FROM documents)")
def chunks_fixed_stride(spark, d):
    return chunking.split_stride(table(spark, d, "documents"))


# Pieces of at least 1000 characters are split again by the next separators; runs of shorter ones are merged: a state of
# chunks that are full, pieces held and their size takes one piece after another.
_SEPARATORS = "[chr(10) || chr(10), chr(10), ' ', '']"
_CUT_OFF = "coalesce(list_filter(range(0, len(a.held) + 1), lambda j: (j = len(a.held) OR a.total - coalesce(list_sum(list_transform(a.held[1 : j], lambda h: length(h))), 0) <= 150 AND a.total - coalesce(list_sum(list_transform(a.held[1 : j], lambda h: length(h))), 0) + e.total <= 1000))[1], 0)"
_STEP = f"CASE WHEN a.total + e.total > 1000 THEN {{'full': a.full || [array_to_string(a.held, '')], 'held': a.held[{_CUT_OFF} + 1 :] || e.held, 'total': (a.total - coalesce(list_sum(list_transform(a.held[1 : {_CUT_OFF}], lambda h: length(h))), 0) + e.total)::bigint}} ELSE {{'full': a.full, 'held': a.held || e.held, 'total': a.total + e.total}} END"


@query(f"""
WITH RECURSIVE todo(doc_id, path, text, sep) AS (
  SELECT doc_id, []::bigint[], text, 1::bigint FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, list_append(path, i), piece, lv + 1 FROM (SELECT doc_id, path, lv, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i FROM (
    SELECT doc_id, path, lv, list_filter(CASE WHEN s = '' THEN list_transform(range(1, length(text) + 1), lambda k: text[k]) ELSE list_transform(range(1, len(cut) + 1), lambda k: CASE WHEN k = 1 THEN cut[k] ELSE s || cut[k] END) END, lambda x: x <> '') AS pieces
    FROM (SELECT *, string_split(text, s) AS cut FROM (SELECT *, ({_SEPARATORS})[lv] AS s FROM (SELECT *, coalesce(list_filter(range(sep, 5), lambda k: contains(text, ({_SEPARATORS})[k]))[1], 4) AS lv FROM todo)))))
  WHERE lv < 4 AND length(piece) >= 1000),
split AS (SELECT doc_id, path, lv, list_filter(CASE WHEN s = '' THEN list_transform(range(1, length(text) + 1), lambda k: text[k]) ELSE list_transform(range(1, len(cut) + 1), lambda k: CASE WHEN k = 1 THEN cut[k] ELSE s || cut[k] END) END, lambda x: x <> '') AS pieces
  FROM (SELECT *, string_split(text, s) AS cut FROM (SELECT *, ({_SEPARATORS})[lv] AS s FROM (SELECT *, coalesce(list_filter(range(sep, 5), lambda k: contains(text, ({_SEPARATORS})[k]))[1], 4) AS lv FROM todo)))),
each AS (SELECT doc_id, path, lv, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i FROM split),
runs AS (SELECT *, sum(CASE WHEN length(piece) >= 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, path ORDER BY i) AS run FROM each),
groups AS (SELECT doc_id, list_append(path, min(i)) AS path, list_reduce(list({{'full': []::varchar[], 'held': [piece], 'total': length(piece)}} ORDER BY i), lambda a, e: {_STEP}) AS r FROM runs WHERE length(piece) < 1000 GROUP BY doc_id, path, run),
chunks AS (SELECT doc_id, path, unnest(list_append(r.full, array_to_string(r.held, ''))) AS raw, unnest(range(0, len(r.full) + 1)) AS k FROM groups),
kept AS (SELECT doc_id, path, k, {sql_strip('raw')} AS text FROM chunks)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path, k) - 1 AS chunk_index, text, length(text) AS n_chars FROM kept WHERE text <> ''""")
def chunks_recursive(spark, d):
    return chunking.split_recursive(table(spark, d, "documents"))


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS chunk_index FROM documents")
def chunk_numbers(spark, d):
    return chunking.chunk_index(table(spark, d, "documents"), ["source", "lang"], "doc_id").select("doc_id", "lang", "chunk_index")


def _sql_html() -> str:
    out = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, {literal(entity)}, {literal(char)})"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@query(rf"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, {_sql_html()} AS body, len({sql_words(_sql_html())}) AS n_words FROM pages")
def html_pages_text(spark, d):
    body = pages.html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", pages.html_title(F.col("html")).alias("title"), body.alias("body"), tx.word_count(body).alias("n_words"))


# ---------------------------------------------------------------- questions

_TURNS = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"
_COMPLEX = rf"(len({sql_words('text')}) >= 10 AND ({sql_any('lower(text)', tx.COMPLEX_WORDS)} OR length(text) - length(replace(text, '?', '')) > 1 OR regexp_matches(text, '\d+\.\s|\d+\)')))"


def _sql_parts(c: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({c}, '(?i)\s+and\s+|\s+also\s+|,\s*and\s+|\.\s+'), lambda p: {sql_strip('p')}), lambda p: length(p) > 10)"


def _sql_decomposed(c: str) -> str:
    asked = f"list_transform({_sql_parts(c)}[1:3], lambda p: CASE WHEN ends_with(p, '?') THEN p ELSE regexp_replace(p, '\\.+$', '') || '?' END)"
    return f"CASE WHEN len({_sql_parts(c)}) > 1 THEN {asked} ELSE [{c}] END"


@query(f"SELECT conv_id, turn, {_COMPLEX} AS is_complex FROM ({_TURNS})")
def query_complexity(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", tx.is_complex(F.col("text")).alias("is_complex"))


@query(f"WITH x AS (SELECT conv_id, turn, {_sql_decomposed('text')} AS parts FROM ({_TURNS})) SELECT conv_id, turn, i - 1 AS hop, parts[i] AS sub_query FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM x)")
def query_decompose(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(tx.decompose(F.col("text"))).alias("p"))
    return rows.select("conv_id", "turn", "p.hop", "p.sub_query")


_DOUBLE = "SELECT a.item_id AS query_id, a.text || ' and ' || b.text AS text FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"
_HOPS = f"SELECT query_id, i - 1 AS hop, parts[i] AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT query_id, CASE WHEN {_COMPLEX} THEN {_sql_decomposed('text')} ELSE [text] END AS parts FROM ({_DOUBLE})))"


@query(
    f"WITH {sql_bm25(f'SELECT query_id * 10 + hop AS query_id, text FROM ({_HOPS})')}, l AS (SELECT query_id // 10 AS query_id, query_id % 10 AS hop, rank, doc_id, text FROM bm JOIN documents USING (doc_id) WHERE rank <= 5), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, left(text, 200) ORDER BY rank, hop) AS n FROM l), p AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, hop) AS position, hop, doc_id FROM o WHERE n = 1) SELECT query_id, position, hop, doc_id FROM p WHERE position <= 10"
)
def multihop_round_robin(spark, d):
    b = table(spark, d, "benchmark")
    pairs = b.select(F.col("item_id").alias("query_id"), F.col("text").alias("x")).join(b.select((F.col("item_id") - 1).alias("query_id"), F.col("text").alias("y")), "query_id")
    asked = pairs.select("query_id", F.concat("x", F.lit(" and "), "y").alias("text"))
    ix = index(spark, d)
    return multihop.search(asked, table(spark, d, "documents"), lambda q, k: bm25.search(ix, q, k))


# ---------------------------------------------------------------- patches

# Documents of ten pages of four patches.
_PATCHES = f"{sql_dense('cosine')}, pt AS (SELECT query_id, vec_id // 40 AS doc_id, vec_id // 4 % 10 AS page, vec_id AS patch_id, score, rank FROM de WHERE rank <= 50), pn AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, page ORDER BY score DESC, patch_id) AS n, max(score) OVER (PARTITION BY query_id, doc_id, page) AS most FROM pt)"


def all_patches(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(F.floor(v / 40).alias("doc_id"), (F.floor(v / 4) % 10).alias("page"), v.alias("patch_id"), "embedding")


def top_patches(spark: SparkSession, d: str) -> DataFrame:
    found = dense.search(table(spark, d, "embeddings"), asked_vectors(spark, d), 50, "cosine")
    return found.select("query_id", F.floor(F.col("vec_id") / 40).alias("doc_id"), (F.floor(F.col("vec_id") / 4) % 10).alias("page"), F.col("vec_id").alias("patch_id"), "score", "rank")


@query(f"WITH {_PATCHES} SELECT query_id, rank, doc_id, page, patch_id, score FROM pt")
def patch_topk(spark, d):
    return top_patches(spark, d).select("query_id", "rank", "doc_id", "page", "patch_id", "score")


@query(f"WITH {_PATCHES} SELECT query_id, doc_id, page, patch_id, score FROM pt WHERE score >= 0.25")
def patch_threshold(spark, d):
    return visual.thresholded(top_patches(spark, d), 0.25).select("query_id", "doc_id", "page", "patch_id", "score")


@query(f"WITH {_PATCHES}" + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT query_id, doc_id, page, '{a}' AS agg, round({e} + 1e-12, 6) AS score, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, count_if(score >= 0.5 * most)::bigint AS num_relevant FROM pn GROUP BY query_id, doc_id, page" for a, e in (("max", "max(score)"), ("mean", "avg(score)"), ("sum", "sum(score)"), ("weighted", "sum(score / n)"))) + ")")
def patch_page_scores(spark, d):
    patches, out = top_patches(spark, d), None
    for a in visual.AGGREGATIONS:
        part = visual.page_scores(patches, a).select("query_id", "doc_id", "page", F.lit(a).alias("agg"), "score", "mean_score", "max_score", "num_relevant")
        out = part if out is None else out.unionByName(part)
    return out


_COLOUR = "CASE WHEN score > 0.7 THEN 'green' WHEN score > 0.5 THEN 'yellow' WHEN score > 0.3 THEN 'orange' ELSE 'red' END"
_TOP_PAGES = "pg AS (SELECT query_id, doc_id, page, row_number() OVER (PARTITION BY query_id ORDER BY most DESC, doc_id, page) AS page_rank, most FROM (SELECT DISTINCT query_id, doc_id, page, most FROM pn))"


@query(f"WITH {_PATCHES}, {_TOP_PAGES} SELECT query_id, page_rank, doc_id, page, n AS patch_rank, patch_id, score, {_COLOUR} AS colour FROM pn JOIN pg USING (query_id, doc_id, page) WHERE page_rank <= 5 AND n <= 3")
def patch_attribution(spark, d):
    return visual.attribution(visual.page_scores(top_patches(spark, d)))


@query(f"WITH {_PATCHES}, {_TOP_PAGES} SELECT query_id, page_rank, doc_id, page, most AS score, (SELECT count(*) FROM embeddings) AS n_patches, (SELECT count(DISTINCT vec_id // 4) FROM embeddings) AS n_pages FROM pg WHERE page_rank <= 5")
def visual_retrieve(spark, d):
    return visual.retrieve(all_patches(spark, d), asked_vectors(spark, d)).select("query_id", "page_rank", "doc_id", "page", "score", "n_patches", "n_pages")


_CONTEXTS = f"{_PATCHES}, {_TOP_PAGES}, cx AS (SELECT query_id, page_rank, doc_id, page, most AS confidence FROM pg WHERE page_rank <= 3 AND (doc_id * 10 + page) % 3 <> 0)"


def found_contexts(spark: SparkSession, d: str) -> DataFrame:
    images = all_patches(spark, d).where("(doc_id * 10 + page) % 3 <> 0")
    return visual.contexts(visual.page_scores(top_patches(spark, d)), images)


@query(f"WITH {_CONTEXTS} SELECT * FROM cx")
def visual_contexts(spark, d):
    return found_contexts(spark, d)


@query(f"WITH {_CONTEXTS} SELECT query_id, count(*) AS n_contexts, round(avg(confidence) + 1e-12, 6) AS confidence FROM cx GROUP BY query_id")
def visual_confidence(spark, d):
    return visual.confidence(found_contexts(spark, d))


_DIGITS = "printf('%.2f', {} + 1e-9)"
_PAGE_PART = f"'\nPage ' || page || ' (confidence: ' || {_DIGITS.format('confidence')} || '):\n  - ' || len(t) || ' relevant region(s) identified' || array_to_string(list_transform(t, lambda p: '\n  - Region at (' || {_DIGITS.format('(p.patch_id % 2) * 0.5::double')} || ', ' || {_DIGITS.format('(p.patch_id // 2 % 2) * 0.5::double')} || '), score: ' || {_DIGITS.format('p.score')}), '')".replace("\n", "' || chr(10) || '")


@query(
    f"WITH {_CONTEXTS}, w AS (SELECT query_id, page_rank, page, confidence, list({{'patch_id': patch_id, 'score': score}} ORDER BY n) AS t FROM cx JOIN pn USING (query_id, doc_id, page) WHERE n <= 3 GROUP BY ALL), v AS (SELECT query_id, count(*) AS c, string_agg({_PAGE_PART}, '' ORDER BY page_rank) AS body FROM w GROUP BY query_id) SELECT query_id, 'QUERY: item ' || query_id || chr(10) || chr(10) || c || ' page image(s) follow, with their most relevant regions. Answer from them, cite page and place, or say NOT FOUND IN VISUAL CONTEXT.' || chr(10) || chr(10) || 'RELEVANT PAGES:' || chr(10) || body AS prompt FROM v"
)
def visual_prompts(spark, d):
    scored = visual.page_scores(top_patches(spark, d))
    rows = found_contexts(spark, d).join(scored.select("query_id", "doc_id", "page", "top_patches"), ["query_id", "doc_id", "page"])
    place = lambda p: F.struct((p["patch_id"] % 2 * 0.5).alias("x"), (F.floor(p["patch_id"] / 2) % 2 * 0.5).alias("y"), p["score"].alias("score"))
    shown = F.struct("page", "confidence", F.transform("top_patches", place).alias("patches"))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("page_rank", shown.alias("p")))).alias("r"))
    return listed.select("query_id", prompts.page_prompt(F.concat(F.lit("item "), F.col("query_id").cast("string")), F.transform("r", lambda x: x["p"])).alias("prompt"))


@query(
    f"WITH {_CONTEXTS}, n AS (SELECT query_id, doc_id, page, least(count(*), 3) AS n_patches FROM pn GROUP BY ALL), s AS (SELECT query_id, round(avg(confidence) + 1e-12, 6) AS confidence, count(*) AS n, string_agg(doc_id || '/' || page || '/' || n_patches, ' ' ORDER BY page_rank) AS sources FROM cx JOIN n USING (query_id, doc_id, page) GROUP BY query_id) SELECT vec_id AS query_id, CASE WHEN n IS NULL THEN 'No relevant visual context was found.' ELSE 'see ' || n || ' page(s)' END AS answer, coalesce(confidence, 0) AS confidence, coalesce(sources, '') AS sources FROM embeddings LEFT JOIN s ON query_id = vec_id WHERE vec_id % 50 = 0 OR vec_id = 7"
)
def visual_answers(spark, d):
    scored = visual.page_scores(top_patches(spark, d))
    found = found_contexts(spark, d).join(scored.select("query_id", "doc_id", "page", "top_patches"), ["query_id", "doc_id", "page"])
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0 or vec_id = 7").select(F.col("vec_id").alias("query_id"), F.lit("?").alias("question"))
    out = visual.answers(asked, found, lambda q, c: F.concat(F.lit("see "), F.size(c).cast("string"), F.lit(" page(s)")))
    shown = F.array_join(F.transform("sources", lambda s: F.concat_ws("/", s["doc_id"].cast("string"), s["page"].cast("string"), s["n_patches"].cast("string"))), " ")
    return out.withColumn("sources", shown)


@query(f"WITH {_PATCHES}, c AS (SELECT query_id, doc_id, page, least(floor((patch_id % 2) * 0.5 * 16), 15)::bigint AS cell_col, least(floor((patch_id // 2 % 2) * 0.5 * 12), 11)::bigint AS cell_row, max(score) AS score FROM pt GROUP BY ALL), m AS (SELECT *, max(score) OVER (PARTITION BY query_id, doc_id, page) AS most FROM c) SELECT query_id, doc_id, page, cell_row, cell_col, round(CASE WHEN most > 0 THEN score / most ELSE score END, 6) AS heat FROM m")
def patch_heat(spark, d):
    patches = top_patches(spark, d).withColumns({"x": F.col("patch_id") % 2 * F.lit(0.5), "y": F.floor(F.col("patch_id") / 2) % 2 * F.lit(0.5)})
    return visual.heat(patches)


@query(f"SELECT doc_id, page, patch_id, failed, list_sum(embedding) AS n_terms, embedding[1] AS first_bucket FROM (SELECT doc_id // 40 AS doc_id, doc_id // 4 % 10 AS page, doc_id AS patch_id, text IS NULL OR length(text) < 400 AS failed, CASE WHEN failed THEN list_transform(range(0, 32), lambda i: 0::double) ELSE {_BUCKETS.format(sql_tokens('text'))} END AS embedding FROM documents)")
def patch_embeddings(spark, d):
    """Texts stand for the descriptions of patches; short ones for those that can't be described."""
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 40).alias("doc_id"), (F.floor(F.col("doc_id") / 4) % 10).alias("page"), F.col("doc_id").alias("patch_id"), "text")
    described = F.when(F.length("text") >= 400, F.col("text"))
    out = visual.embedded(rows, described, lambda c: F.when(c.isNotNull(), vx.hashed_embedding(tx.tokens(c))), 32)
    return out.select("doc_id", "page", "patch_id", "failed", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("n_terms"), F.col("embedding")[0].alias("first_bucket"))


_SIZES = [(0, 1, 100, 200), (0, 2, 333, 501), (1, 1, 1240, 1754)]


@query(
    f"WITH g AS (SELECT doc_id::bigint AS doc_id, page::bigint AS page, width, height, unnest([0, 1]) AS row FROM {values(_SIZES, 'doc_id, page, width, height')}), c AS (SELECT *, unnest([0, 1]) AS col FROM g), b AS (SELECT *, width // 2 AS bw, height // 2 AS bh FROM c), e AS (SELECT *, col * bw AS px, row * bh AS py, least(col * bw + bw + floor(bw * 0.1::double), width) AS xe, least(row * bh + bh + floor(bh * 0.1::double), height) AS ye FROM b) SELECT doc_id, page, format('p{{:03d}}_r{{:d}}_c{{:d}}', page, row, col) AS patch_id, row::bigint AS row, col::bigint AS col, px::bigint AS pixel_x, py::bigint AS pixel_y, (xe - px)::bigint AS pixel_width, (ye - py)::bigint AS pixel_height, round(px::double / width, 6) AS x, round(py::double / height, 6) AS y, round((xe - px)::double / width, 6) AS w, round((ye - py)::double / height, 6) AS h FROM e"
)
def patch_grid(spark, d):
    return visual.grid(spark.createDataFrame(_SIZES, "doc_id bigint, page bigint, width bigint, height bigint"))


# ---------------------------------------------------------------- cache

_ENTRIES = "(SELECT * FROM embeddings WHERE vec_id < 400)"
_LOOKUP = f"{sql_dense('cosine', _ENTRIES, 'SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id >= 400')}, lk AS (SELECT query_id AS probe_id, score >= 0.3 AS hit, CASE WHEN score >= 0.3 THEN vec_id END AS entry_id, score AS similarity FROM de WHERE rank = 1)"


def looked_up(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    probes = v.where("vec_id >= 400").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return cache.lookup(v.where("vec_id < 400"), probes, cache.CacheConfig(threshold=0.3))


@query(f"WITH {_LOOKUP} SELECT * FROM lk")
def cache_lookup(spark, d):
    return looked_up(spark, d)


@query(f"WITH {_LOOKUP} SELECT count_if(hit)::bigint AS hits, (count(*) - count_if(hit))::bigint AS misses, count(*) AS total, round(count_if(hit)::double / count(*), 6) AS hit_rate FROM lk")
def cache_stats(spark, d):
    return cache.statistics(looked_up(spark, d))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 500")
def cache_fifo(spark, d):
    return cache.newest(table(spark, d, "events"), 500).select("event_id", "user_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def cache_fifo_sharded(spark, d):
    return cache.newest(table(spark, d, "events"), 3, by=["user_id"]).select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-10 00:00:00') - epoch(ts) <= 432000")
def cache_ttl(spark, d):
    return cache.alive(table(spark, d, "events"), F.lit("2024-01-10 00:00:00"), 432000).select("event_id")


@query("SELECT date_trunc('hour', ts)::timestamp AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def cache_traffic(spark, d):
    return traffic.windows(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# ---------------------------------------------------------------- modalities

_ASKED = [(1, "Show the climate investment chart"), (2, "What was the total income per quarter?"), (3, "Who wrote it"), (4, "green finance trends over time")]


@query(f"WITH q AS (SELECT id::bigint AS query_id, {sql_count('lower(q)', multimodal.TABLE_WORDS)} AS t, {sql_count('lower(q)', multimodal.IMAGE_WORDS)} AS i FROM {values(_ASKED, 'id, q')} UNION ALL SELECT 100 + item_id, {sql_count('lower(text)', multimodal.TABLE_WORDS)}, {sql_count('lower(text)', multimodal.IMAGE_WORDS)} FROM benchmark), w AS (SELECT query_id, t, i, 0.4::double * t / (t + i + 1) + 0.1::double AS tw, 0.4::double * i / (t + i + 1) + 0.1::double AS iw FROM q) SELECT query_id, round(CASE WHEN t + i = 0 THEN 0.6 ELSE 0.3::double / (0.3::double + tw + iw) END, 6) AS text_w, round(CASE WHEN t + i = 0 THEN 0.25 ELSE tw / (0.3::double + tw + iw) END, 6) AS table_w, round(CASE WHEN t + i = 0 THEN 0.15 ELSE iw / (0.3::double + tw + iw) END, 6) AS image_w FROM w")
def modality_intent(spark, d):
    asked = spark.createDataFrame(_ASKED, "query_id bigint, text string").unionByName(questions(spark, d).withColumn("query_id", F.col("query_id") + 100))
    w = multimodal.intent(F.col("text"))
    return asked.select("query_id", *[F.round(w[n], 6).alias(n) for n in ("text_w", "table_w", "image_w")])


@query(f"WITH {LISTS}, pt AS (SELECT query_id, vec_id AS id, rank FROM de WHERE vec_id % 2 = 0), im AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM pt) SELECT query_id, 'text' AS modality, rank, doc_id AS id FROM bm WHERE rank <= 5 UNION ALL SELECT query_id, 'table', rank, doc_id FROM dl20 WHERE rank <= 3 UNION ALL SELECT query_id, 'image', rank, id FROM im WHERE rank <= 2")
def modality_mixed(spark, d):
    r = retriever(spark, d)
    text = bm25.search(index(spark, d), questions(spark, d), 5).select("query_id", "rank", F.col("doc_id").alias("id"))
    dense_ = lambda only, k: r._dense(paired(spark, d), k, only).select("query_id", "rank", F.col("doc_id").alias("id"))
    return multimodal.combine(text, dense_(None, 3), dense_(r.docs.where("doc_id % 2 = 0"), 2))


_ITEMS = [("t1", 4, "Loans by year", None, "a | b"), ("t2", None, None, None, "c | d"), ("f1", 7, "Growth", "bar", "Bars that grow"), ("f2", 8, None, None, "A map"), (None, 9, "", "", "no id")]
_ITEM = "'[{kind}: ' || coalesce(item_id, 'unknown') || ', Page ' || coalesce(page::varchar, '?') || ']' || CASE WHEN coalesce(chart_type, '') <> '' THEN ' (Type: ' || chart_type || ')' ELSE '' END || CASE WHEN coalesce(caption, '') <> '' THEN chr(10) || 'Caption: ' || caption ELSE '' END || chr(10) || text"
_ITEM_VALUES = values(_ITEMS, "item_id, page, caption, chart_type, text")


def _items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ITEMS, "item_id string, page bigint, caption string, chart_type string, text string")


def _item_sql(kind: str) -> str:
    many = kind.lower() + "s"
    return f"SELECT '{kind}' AS kind, 'Answer from these {many} only. Name the {kind.lower()}, its page and the values used; if they do not hold the answer, say so.' || chr(10) || chr(10) || '{many.upper()}:' || chr(10) || string_agg({_ITEM.format(kind=kind)}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY text) || chr(10) || chr(10) || 'Question: How much?' || chr(10) || chr(10) || 'Answer:' AS prompt FROM {_ITEM_VALUES} UNION ALL SELECT '{kind}', 'Question: How much?' || chr(10) || chr(10) || 'No {many} were retrieved.' || chr(10) || chr(10) || 'Answer: I cannot answer this question, as no {many} were found.'"


@query(_item_sql("Table") + " UNION ALL " + _item_sql("Figure"))
def item_prompts(spark, d):
    out = None
    for kind in ("Table", "Figure"):
        bodies = _items(spark).select("text", prompts.item_body(kind).alias("body")).agg(F.transform(F.array_sort(F.collect_list(F.struct("text", "body"))), lambda x: x["body"]).alias("bodies"))
        rows = bodies.unionByName(bodies.select(F.lit(None).cast("array<string>").alias("bodies")))
        part = rows.select(F.lit(kind).alias("kind"), prompts.item_prompt(kind, F.lit("How much?"), F.col("bodies")).alias("prompt"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT 'table' AS modality, item_id, page::bigint AS page, coalesce(caption, '') AS caption, text, NULL AS chart_type FROM {_ITEM_VALUES} UNION ALL SELECT 'image', item_id, page::bigint, coalesce(caption, ''), text, coalesce(chart_type, '') FROM {_ITEM_VALUES}")
def items_as_documents(spark, d):
    items = _items(spark)
    return multimodal.as_documents(items, "table").unionByName(multimodal.as_documents(items.withColumnRenamed("text", "description"), "image"), allowMissingColumns=True)


@query(f"WITH {sql_bm25()}, docs AS (SELECT * FROM documents WHERE doc_id % 3 <> 0) SELECT query_id, rank, bm.doc_id, lang, source, n_chars FROM bm LEFT JOIN docs USING (doc_id) WHERE rank <= 5")
def hits_with_records(spark, d):
    records = table(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id", "lang", "source", "n_chars")
    return multimodal.with_records(bm25.search(index(spark, d), questions(spark, d), 5).select("query_id", "rank", "doc_id"), records, "doc_id")


_IMAGES = [(1, 1, 11, "[FIGURE] Page 1\nContact information, tel: 1"), (1, 2, 12, "Bar chart of climate investment"), (1, 3, 13, "Income graph"), (2, 1, 21, "Image from page"), (2, 2, 22, "Line chart of income"), (2, 3, 23, "Image from financial report with growth"), (3, 1, 31, "Signature of the president"), (3, 2, 32, "Deloitte logo"), (4, 1, 41, "Managing director"), (4, 2, 42, "Loan volume trend"), (4, 3, 43, "Balance")]
_BOILER = f"(lower(description) <> '' AND ({sql_any('lower(description)', [p.lower() for p in tx.BOILERPLATE])} OR (length(description) < 150 AND {sql_any('lower(description)', tx.GENERIC)} AND NOT {sql_any('lower(description)', tx.SUBSTANTIVE)})))"


@query(
    f"WITH i AS (SELECT query_id::bigint AS query_id, rank::bigint AS rank, id::bigint AS id, description FROM {values(_IMAGES, 'query_id, rank, id, description')}), q AS (SELECT id::bigint AS query_id, lower(q) AS q FROM {values(_ASKED, 'id, q')}), m AS (SELECT i.*, {_BOILER} AS is_boilerplate, {sql_any('q', tx.THEME_TRIGGERS)} AS thematic, list_filter([{', '.join(map(literal, tx.THEMES))}], lambda t: contains(q, t)) AS themes FROM i JOIN q USING (query_id)), k AS (SELECT *, len(themes) = 0 OR len(list_filter(themes, lambda t: contains(lower(description), t))) > 0 AS matches FROM m), f AS (SELECT *, bool_or(matches AND NOT is_boilerplate) OVER (PARTITION BY query_id) AS found FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_boilerplate, rank) AS position FROM f WHERE NOT thematic OR (NOT is_boilerplate AND (matches OR NOT found))) SELECT query_id, position, id, is_boilerplate FROM r WHERE position <= 2"
)
def image_boilerplate_order(spark, d):
    images = spark.createDataFrame(_IMAGES, "query_id bigint, rank bigint, id bigint, description string")
    return multimodal.order_images(images.join(spark.createDataFrame(_ASKED, "query_id bigint, query string"), "query_id"))


_CUT = [(1, 80, 80), (2, 79, 300), (3, 1000, 100), (4, 600, 100), (5, 100, 660), (6, 100, 670)]


@query(f"SELECT id::bigint AS id, width >= 80 AND height >= 80 AND width::double / height BETWEEN 0.15 AND 6 AS kept FROM {values(_CUT, 'id, width, height')}")
def image_size_filter(spark, d):
    rows = spark.createDataFrame(_CUT, "id bigint, width bigint, height bigint")
    return rows.select("id", tx.is_chart_size(F.col("width"), F.col("height")).alias("kept"))


_FIGURES = [(3, "f1", "substantive", "Figure 1: Loans", "Bars by year", ["loans", "growth"], "bar", "year", "amount", "up"), (4, "f2", "boilerplate", None, "Logo", None, "unknown", None, None, None)]


@query(f"WITH f AS (SELECT * FROM {values(_FIGURES, 'page, figure_id, content, caption, description, topics, chart_type, x, y, trend')}) SELECT figure_id, concat_ws(chr(10), '[FIGURE] Page ' || page || ', ' || figure_id, CASE WHEN content = 'boilerplate' THEN '[BOILERPLATE: contact/logo/footer - not substantive content.]' END, 'Caption: ' || caption, description, CASE WHEN len(topics) > 0 THEN 'Topics: ' || array_to_string(topics, ', ') END, CASE WHEN chart_type <> 'unknown' THEN 'Chart type: ' || chart_type END, 'X-axis: ' || x, 'Y-axis: ' || y, 'Trend: ' || trend) AS description FROM f")
def image_descriptions(spark, d):
    f = spark.createDataFrame(_FIGURES, "page bigint, figure_id string, content string, caption string, description string, topics array<string>, chart_type string, x string, y string, trend string")
    return f.select("figure_id", tx.description_of(*[F.col(c) for c in ("page", "figure_id", "content", "caption", "description", "topics", "chart_type", "x", "y", "trend")]).alias("description"))


# ---------------------------------------------------------------- tables

_CELLS = [(i, v) for i, v in enumerate(["(30)", "$(30)", "5%", "(5%)", "1,485", "—", "–", "-", "N/A", "n/a", "", "  ", "$ 1,200.50", "€7", "12 345", "abc", "1e5", "-4", "+2.5", ".5", None])]
_GRIDS = [(1, "t1", "Loans", [["Year", "", "Amount"], ["2023", "a", "1,485"], ["2024", "b", "(30)", "x"]]), (2, "t2", None, [["k", "k"], ["5%", "6%"], ["7"]])]


@query(f"SELECT id::bigint AS id, raw, {sql_numeric('raw')} AS value FROM {values(_CELLS, 'id, raw')}")
def table_numeric(spark, d):
    rows = spark.createDataFrame(_CELLS, "id bigint, raw string")
    return rows.select("id", "raw", numbers.numeric(F.col("raw")).alias("value"))


def _grids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_GRIDS, "page bigint, table_id string, caption string, rows array<array<string>>")


@query(
    f"WITH g AS (SELECT * FROM {values(_GRIDS, 'page, table_id, caption, rows')}), m AS (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS width FROM g) SELECT table_id, array_to_string(list_concat(['[TABLE] Page ' || page || ', ' || table_id], CASE WHEN caption IS NOT NULL THEN ['Caption: ' || caption] ELSE [] END, ['| ' || array_to_string(list_transform(rows[1], lambda c: trim(c)), ' | ') || ' |', '|' || array_to_string(list_transform(rows[1], lambda c: '---'), '|') || '|'], list_transform(rows[2:], lambda r: '| ' || array_to_string(list_concat(list_transform(r, lambda c: trim(c)), list_transform(range(0, width - len(r)), lambda z: '')), ' | ') || ' |')), chr(10)) AS text FROM m"
)
def table_markdown(spark, d):
    return _grids(spark).select("table_id", tables.markdown(F.col("page"), F.col("table_id"), F.col("caption"), F.col("rows")).alias("text"))


@query(f"SELECT table_id, len(rows) - 1 AS row_count, len(rows[1]) AS col_count, list_max(list_transform(rows, lambda r: len(r))) AS width FROM {values(_GRIDS, 'page, table_id, caption, rows')}")
def table_shape(spark, d):
    s = tables.structured(F.col("rows"))
    return _grids(spark).select("table_id", s["row_count"].alias("row_count"), s["col_count"].alias("col_count"), tables.shape(F.col("rows"))["col_count"].alias("width"))


# ---------------------------------------------------------------- comparison and evaluation

_SETS = f"WITH {LISTS}, a AS (SELECT query_id, list(doc_id) AS a FROM bm WHERE rank <= 5 GROUP BY ALL), b AS (SELECT query_id, list(doc_id) AS b FROM dl20 WHERE rank <= 5 GROUP BY ALL), s AS (SELECT query_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM a FULL JOIN b USING (query_id)), c AS (SELECT query_id, len(a) AS n_a, len(b) AS n_b, len(list_intersect(a, b)) AS overlap FROM s), v AS (SELECT *, n_a - overlap AS only_a, n_b - overlap AS only_b, round(overlap::double / nullif(n_a + n_b - overlap, 0), 6) AS jaccard FROM c)"


def _compared(spark: SparkSession, d: str) -> DataFrame:
    dense_, sparse_ = both_lists(spark, d, 5)
    return compare.page_sets(sparse_, dense_)


@query(f"{_SETS} SELECT * FROM v")
def compare_pipelines(spark, d):
    return _compared(spark, d)


@query(f"{_SETS} SELECT query_id, CASE WHEN {sql_any('lower(b.text)', tx.VISUAL_WORDS)} THEN 'b' WHEN overlap < least(n_a, n_b) / 2 AND only_b > 0 THEN 'b' WHEN jaccard > 0.7 THEN CASE WHEN length(b.text) < 150 THEN 'a' ELSE 'b' END WHEN 150 > length(b.text) * 1.5 THEN 'b' ELSE 'a' END AS preferred FROM v JOIN benchmark b ON item_id = query_id")
def pipeline_preference(spark, d):
    rows = _compared(spark, d).join(questions(spark, d), "query_id")
    n = F.length("text")
    c = F.col
    return rows.select("query_id", compare.preferred(c("text"), c("overlap"), c("n_a"), c("n_b"), c("only_b"), c("jaccard"), n, F.lit(150), n, F.lit(150)).alias("preferred"))


_WORDS = "list_distinct({0})"


@query(f"WITH p AS (SELECT a.item_id, a.text AS ta, b.text AS tb, list_distinct({sql_words('lower(a.text)')}) AS x, list_distinct({sql_words('lower(b.text)')}) AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1), c AS (SELECT *, len(list_intersect(x, y)) AS common FROM p) SELECT item_id, length(ta) AS length_a, length(tb) AS length_b, common, len(x) - common AS only_a, len(y) - common AS only_b, round(common::double / greatest(len(x) + len(y) - common, 1), 6) AS jaccard, round(common::double / greatest(len(x), len(y), 1), 6) AS overlap FROM c")
def answer_overlap(spark, d):
    b = table(spark, d, "benchmark")
    rows = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return rows.select("item_id", compare.word_overlap(F.col("text"), F.col("other")).alias("o")).select("item_id", "o.*")


_TRUTH = "SELECT item_id AS query_id, doc_id FROM benchmark b, documents x WHERE contains(x.text, b.text)"


@query(f"WITH {LISTS}, truth AS ({_TRUTH}), lists AS (SELECT 'sparse' AS mode, query_id, doc_id, rank FROM bm WHERE rank <= 8 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM dl20 WHERE rank <= 8), ks AS (SELECT unnest([3, 5, 8])::bigint AS k), f AS (SELECT mode, query_id, k, min(rank) AS first, count(*) AS n FROM lists JOIN truth USING (query_id, doc_id), ks WHERE rank <= k GROUP BY ALL), e AS (SELECT query_id, count(*) AS relevant, mode, k FROM truth, (VALUES ('sparse'), ('dense')) m(mode), ks GROUP BY ALL) SELECT mode, k, round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END), 6) AS hit_rate, round(avg(coalesce(1.0::double / first, 0)), 6) AS mrr, round(avg(coalesce(n::double / relevant, 0)), 6) AS page_recall FROM e LEFT JOIN f USING (mode, query_id, k) GROUP BY ALL")
def eval_hit_at_k(spark, d):
    dense_, sparse_ = both_lists(spark, d, 8)
    lists = sparse_.select(F.lit("sparse").alias("mode"), "query_id", "doc_id", "rank").unionByName(dense_.select(F.lit("dense").alias("mode"), "query_id", "doc_id", "rank"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"), F.split("text", " ")[0].alias("first"), F.split("text", " ")[1].alias("second"))
    # Documents that hold a passage hold its first two words side by side, or run on into other characters at its ends.
    docs = table(spark, d, "documents").select("doc_id", "text")
    words = docs.select("doc_id", "text", F.split("text", r"\s+").alias("w"))
    pairs = words.select("doc_id", F.explode(F.array_distinct(F.filter("w", lambda x: x != ""))).alias("second"))
    near = pairs.join(few(items.select("query_id", "second")), "second").select("query_id", "doc_id").distinct()
    truth = near.join(items, "query_id").join(docs, "doc_id").where(F.contains("text", "passage")).select("query_id", "doc_id")
    return evaluate.hits(lists, truth, [3, 5, 8])


@query("SELECT * FROM (VALUES ('a'), ('b')) s(store), (VALUES ('dense'), ('sparse'), ('hybrid')) m(mode), (VALUES (3::bigint), (5), (8)) k(k), (VALUES (true), (false)) r(reranked)")
def eval_grid(spark, d):
    return evaluate.grid(spark, ["a", "b"], ["dense", "sparse", "hybrid"], [3, 5, 8], [True, False])


def _sql_cover(of: str, by: str) -> str:
    return f"round(coalesce(len(list_intersect(list_distinct({sql_tokens(of)}), {sql_tokens(by)}))::double / nullif(len(list_distinct({sql_tokens(of)})), 0), 0), 6)"


_SAMPLES = f"WITH {sql_bm25()}, c AS (SELECT query_id, list(text ORDER BY rank) AS contexts FROM bm JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY ALL), s AS (SELECT query_id, b.text AS question, contexts, left(contexts[1], 300) || CASE WHEN length(contexts[1]) > 300 THEN '...' ELSE '' END AS answer, array_to_string(contexts, chr(10) || chr(10)) AS joined FROM c JOIN benchmark b ON item_id = query_id), e AS (SELECT query_id, {_sql_cover('answer', 'joined')} AS faithfulness, {_sql_cover('question', 'answer')} AS answer_relevance, round(len(list_filter(contexts, lambda z: {_sql_cover('question', 'z')} >= 0.1))::double / len(contexts), 6) AS context_precision, {_sql_cover('question', 'joined')} AS context_recall FROM s)"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    found = bm25.search(index(spark, d), questions(spark, d), 5).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    rows = prompts.gathered(found, F.col("text"), 5).join(questions(spark, d).withColumnRenamed("text", "question"), "query_id")
    rows = rows.withColumn("answer", prompts.extractive(F.col("question"), F.col("contexts")))
    return rows.select("query_id", evaluate.metrics(F.col("question"), F.col("answer"), F.col("contexts"), F.col("question")).alias("m")).select("query_id", "m.*")


@query(f"{_SAMPLES} SELECT * FROM e")
def eval_metrics(spark, d):
    return _samples(spark, d)


@query(f"{_SAMPLES} SELECT query_id % 2 AS part, round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_relevance), 6) AS answer_relevance, round(avg(context_precision), 6) AS context_precision, round(avg(context_recall), 6) AS context_recall FROM e GROUP BY ALL")
def eval_means(spark, d):
    return evaluate.means(_samples(spark, d).withColumn("part", F.col("query_id") % 2), ["part"], ["faithfulness", "answer_relevance", "context_precision", "context_recall"])


_TYPES = [(1, "text"), (2, "table"), (3, "image"), (4, "combination"), (5, "combination (table and text)"), (6, "combination (image and text)"), (7, "combination (text"), (8, None)]


@query(f"SELECT id::bigint AS id, content_type, coalesce(content_type IN ('combination', 'image', 'combination (table and text)'), false) AS selected FROM {values(_TYPES, 'id, content_type')}")
def judge_selection(spark, d):
    rows = spark.createDataFrame(_TYPES, "id bigint, content_type string")
    return rows.withColumn("selected", evaluate.is_judged(F.col("content_type")))


_STRUCTURED = [(1, '{"answer": "a"}', None), (2, "broken", '{"answer": "b"}'), (3, None, "broken"), (4, None, None)]


@query(f"SELECT id::bigint AS id, CASE WHEN json_valid(x) THEN x::json ->> 'answer' WHEN json_valid(y) THEN y::json ->> 'answer' END AS answer, CASE WHEN json_valid(x) THEN 'first' WHEN json_valid(y) THEN 'second' ELSE 'error' END AS origin FROM {values(_STRUCTURED, 'id, x, y')}")
def structured_answers(spark, d):
    rows = spark.createDataFrame(_STRUCTURED, "id bigint, x string, y string")
    return rows.select("id", prompts.structured(F.col("x"), F.col("y"), "answer string").alias("s")).select("id", "s.value.answer", "s.origin")


_CAPTIONED = [(1, "img", "A bar chart", "chart", None), (2, "img", None, None, "timeout"), (3, "", "unused", "chart", None), (4, "img", "A logo", None, None), (5, None, None, None, None), (6, "img", None, None, None)]


@query(f"SELECT id::bigint AS id, CASE WHEN caption IS NULL THEN 'caption_failed: ' || coalesce(error, 'no answer') ELSE caption END AS description, CASE WHEN caption IS NULL THEN 'unknown' ELSE coalesce(role, 'unknown') END AS role FROM {values(_CAPTIONED, 'id, content, caption, role, error')} WHERE length(content) > 0")
def described_images(spark, d):
    rows = spark.createDataFrame(_CAPTIONED, "id bigint, content string, caption string, chart string, error string").withColumn("content", F.col("content").cast("binary"))
    caption = F.struct(F.col("caption").alias("description"), F.col("chart").alias("role"))
    return multimodal.described(rows, caption, F.col("error")).select("id", "description", "role")


_VERDICTS = [(1, "combination", '{"score": 0.75, "reasoning": "good"}'), (2, "image", "no json"), (3, "image", None), (4, "text", '{"score": 1.0, "reasoning": "good"}'), (5, "combination", '{"reasoning": "no score"}'), (6, None, None)]


@query(f"SELECT id::bigint AS id, CASE WHEN c THEN coalesce(score, 0) END AS judge_score, CASE WHEN c THEN CASE WHEN score IS NULL THEN 'Judge error' ELSE reasoning END END AS judge_reasoning FROM (SELECT id, coalesce(type IN ('combination', 'image', 'combination (table and text)'), false) AS c, CASE WHEN json_valid(v) THEN (v::json ->> 'score')::double END AS score, CASE WHEN json_valid(v) THEN v::json ->> 'reasoning' END AS reasoning FROM {values(_VERDICTS, 'id, type, v')})")
def judge_scores(spark, d):
    rows = spark.createDataFrame(_VERDICTS, "id bigint, content_type string, v string")
    return evaluate.judged(rows, F.col("v")).select("id", "judge_score", "judge_reasoning")


@query(f"WITH {sql_bm25()}, c AS (SELECT query_id, list(text ORDER BY rank) AS contexts, list(score ORDER BY rank) AS scores FROM bm JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY ALL) SELECT item_id AS query_id, coalesce(len(contexts), 0) AS n_contexts, coalesce(list_sum(list_transform(contexts, lambda x: length(x))), 0)::bigint AS n_chars, scores[1] AS best, CASE WHEN contexts IS NULL THEN '' ELSE left(contexts[1], 300) || CASE WHEN length(contexts[1]) > 300 THEN '...' ELSE '' END END AS answer FROM benchmark LEFT JOIN c ON item_id = query_id")
def eval_samples(spark, d):
    found = bm25.search(index(spark, d), questions(spark, d), 3)
    rows = evaluate.samples(found, table(spark, d, "documents"), questions(spark, d).withColumnRenamed("text", "question"), prompts.extractive, 3)
    n_chars = F.aggregate("contexts", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return rows.select("query_id", F.size("contexts").cast("bigint").alias("n_contexts"), n_chars.alias("n_chars"), F.get("scores", F.lit(0)).alias("best"), "answer")


@query("SELECT id::bigint AS id, least(1.0::double, greatest(0.0::double, v::double)) AS score, round(a::double / greatest(v::double, 0.1), 6) AS speedup FROM (VALUES (1, 1.5, 20), (2, -0.5, 30), (3, 0.25, 40)) t(id, v, a)")
def clamped_scores(spark, d):
    rows = spark.createDataFrame([(1, 1.5, 20), (2, -0.5, 30), (3, 0.25, 40)], "id bigint, v double, a bigint")
    return rows.select("id", numbers.clamp(F.col("v")).alias("score"), compare.speedup(F.col("a"), F.col("v")).alias("speedup"))
