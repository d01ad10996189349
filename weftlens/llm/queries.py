"""The subpackage's registered queries: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document and digests of its ids and of what they decode to."""
    from weftlens.llm import bpe

    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 1024 tokens."""
    from weftlens.llm import best_fit

    return best_fit.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document under verified links of similarity 0.8 or more, and its number of links."""
    from weftlens.llm import near_dup

    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes that a repeated string of 400 covers."""
    from weftlens.llm import suffix_dedup

    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model of subword bags."""
    from weftlens.llm import toxicity

    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id rows of all documents, written and read back, with a CRC-32 of their ids."""
    from weftlens.llm import binary_rows, scratch

    path = scratch.new_path(spark, "token-rows")
    binary_rows.write(binary_rows.rows(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")), path)
    return binary_rows.digests(spark.read.parquet(path))


def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every query on shifted Hilbert curves."""
    from weftlens.llm import curves

    return curves.nearest(table(spark, sf_dir, "embeddings"))


def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by the attention model and by the unigram base."""
    from weftlens.llm import attention_lm

    return attention_lm.scores(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by both co-trained views and combined."""
    from weftlens.llm import quality

    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a film: payload read back, clips and features."""
    from weftlens.llm import avi

    return avi.digests(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document for the benchmark's texts, and the rank of the quarter that is drawn."""
    from weftlens.llm import importance

    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 32 leading components, whitened."""
    from weftlens.llm import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 2048 tokens."""
    from weftlens.llm import cutting_stock

    return cutting_stock.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), dtype="<u2", ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_byte_bpe, op2_best_fit, op3_near_duplicates, op4_suffix_dedup, op5_toxicity, op6_token_rows, op7_hilbert_neighbours, op8_attention_lm, op9_quality, op10_avi_media, op11_importance, op12_whitening, op13_cutting_stock]
    return {f.__name__: f for f in found}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_FEATURES = "list_concat(words, list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1]))"
#: CRC-32 of a string by bytes: its table follows from eight steps of the polynomial.
_CRC_TABLE = "SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(feature)), lambda k: ('0x' || substr(hex(encode(feature)), 2 * k + 1, 2))::BIGINT)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295)"
_IMPORTANCE = f"""WITH steps AS ({_CRC_TABLE}), d AS (SELECT doc_id, {_WORDS} AS words FROM documents), u AS MATERIALIZED (SELECT doc_id, unnest({_FEATURES}) AS feature FROM d), v AS MATERIALIZED (SELECT unnest({_FEATURES}) AS feature FROM (SELECT {_WORDS} AS words FROM benchmark)),
 names AS MATERIALIZED (SELECT feature, {_CRC} % 10000 AS bucket FROM (SELECT feature FROM u UNION SELECT feature FROM v), steps),
 s AS (SELECT bucket, count(*) AS s FROM u JOIN names USING (feature) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM v JOIN names USING (feature) GROUP BY 1),
 g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
 w AS (SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM u JOIN names USING (feature) JOIN g USING (bucket) GROUP BY 1),
 y AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(words) AS words, (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
 z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM y WHERE words >= 20)
 SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor(25 * (SELECT count(*) FROM z) / 100) THEN place END AS rank FROM y LEFT JOIN z USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op11_importance": _IMPORTANCE}
