"""Columns of the corpus queries that SQL can express, on the small tables, in DuckDB with CRC-32 from zlib."""

import os
import zlib

import duckdb
import pytest

from weftlens.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.create_function("crc32", lambda s: zlib.crc32(s.encode()), ["VARCHAR"], "BIGINT")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return lambda text: sorted(con.execute(text).fetchall())


def rows(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()))


def test_decoded_bytes_are_the_text(spark, sql):
    assert rows(queries.op1_byte_bpe(spark, DATA), "doc_id", "decoded_sha256") == sql("SELECT doc_id, sha256(coalesce(text, '')) FROM documents")


def test_texts_without_repeats_stay_whole(spark, sql):
    found = queries.op4_suffix_dedup(spark, DATA).cache()
    assert rows(found, "doc_id", "n_bytes") == sql("SELECT doc_id, strlen(coalesce(text, '')) FROM documents")
    whole = dict(sql("SELECT doc_id, sha256(coalesce(text, '')) FROM documents"))
    kept = {r.doc_id: r for r in found.collect()}
    assert all((r.n_removed == 0) == (r.n_spans == 0) and (r.n_removed > 0 or r.kept_sha256 == whole[k]) for k, r in kept.items())
    copies = [k for (k,) in sql("SELECT doc_id FROM documents WHERE strlen(text) >= 400 AND text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")]
    assert copies and all(kept[k].n_removed == kept[k].n_bytes for k in copies)


def test_folds(spark, sql):
    for query in (queries.op5_toxicity, queries.op9_quality):
        assert rows(query(spark, DATA), "doc_id", "held_out") == sql("SELECT doc_id, crc32(doc_id::VARCHAR) % 5 = 0 FROM documents")


def test_base_of_the_language_model(spark, sql):
    expected = sql(
        """WITH w AS (SELECT doc_id, crc32(doc_id::VARCHAR) % 5 = 1 AS held, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        t AS (SELECT doc_id, held, unnest(list_append(list_transform(words, lambda x: 'w' || x), 'end')) AS token FROM w), c AS (SELECT token, count(*) AS c FROM t WHERE NOT held GROUP BY 1), s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT doc_id, held, count(*), count(c), any_value(n)::BIGINT, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 6) FROM t LEFT JOIN c USING (token), s GROUP BY 1, 2"""
    )
    found = [(*r[:5], round(r[5], 6)) for r in rows(queries.op8_attention_lm(spark, DATA), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")]
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert max(abs(a[5] - b[5]) for a, b in zip(found, expected, strict=True)) < 1e-4


def test_payloads_of_films(spark, sql):
    expected = """SELECT doc_id, strlen(coalesce(text, '')) AS n, greatest(1, ceil(n / 192)::BIGINT) * 192 AS size, sha256(coalesce(text, '') || repeat(' ', size - n)) FROM documents"""
    assert rows(queries.op10_avi_media(spark, DATA), "doc_id", "n_bytes", "payload_bytes", "payload_sha256") == sql(expected)


def test_importance_in_sql(spark, sql):
    assert rows(queries.op11_importance(spark, DATA), "doc_id", "n_features", "weight", "score", "rank") == sql(queries.oracle_sql()["op11_importance"])


def test_deviations_in_sql(spark, sql):
    expected = sql(
        """WITH e AS (SELECT vec_id, k, floor(64 * embedding[k]::DOUBLE)::BIGINT + 1000000 AS x FROM embeddings, range(1, len(embedding) + 1) r(k)), s AS (SELECT k, sum(x) AS s, count(*) AS n FROM e GROUP BY 1)
        SELECT vec_id, any_value(n)::BIGINT, sum((n * x - s) * (n * x - s))::BIGINT FROM e JOIN s USING (k) GROUP BY 1"""
    )
    assert rows(queries.op12_whitening(spark, DATA).where("component = 1"), "vec_id", "n", "deviation") == expected
