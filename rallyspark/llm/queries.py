"""Registered queries of the corpus operators: (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyspark.llm import flac, langid, lexical, linededup, neardup, packing, pieces, preference, quality, resampling, secrets, sharding, topk
from rallyspark.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(~langid.held_out()))
    found = docs.select("doc_id", langid.held_out().alias("held_out"), langid.predicted(net)(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda c: F.size(c).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(secrets.joined("base").cast("binary"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.pairs(table(spark, sf_dir, "conversations")))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_near_dedup, op2_sharding, op3_language_id, op4_sentencepiece, op5_quality, op6_flac, op7_packing, op8_secret_scans, op9_preference, op10_topk,
    op11_resampling, op12_line_dedup, op13_ranked_search,
)
QUERIES = {f.__name__: f for f in _ALL}
# op10: row numbers are in DuckDB's scan order and serve only to leave out the query's own row
ORACLES = {
    "op9_preference": preference.ORACLE,
    "op11_resampling": resampling.ORACLE,
    "op12_line_dedup": linededup.ORACLE,
    "op13_ranked_search": lexical.ORACLE,
    "op10_topk": """
        WITH rows AS (
          SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT r, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM rows),
        scores AS (
          SELECT q.r AS q, q.vec_id AS query_id, c.r, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM parts q JOIN parts c ON q.i = c.i AND q.r <> c.r
          WHERE q.vec_id % 100 = 0 GROUP BY ALL)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 10""",
}
