"""The registered queries against their SQL, and the pipeline against a plain version of it."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from strikelens.llm import mixing, oracle, pii, queries, sampling, toxicity  # noqa: E402
from test_near_copies import _groups  # noqa: E402


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert set(oracle.ORACLE) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle.ORACLE[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.select(columns).collect())


def test_pipeline_equals_plain_version(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    rows = [r.asDict() for r in docs.collect()]
    chain = queries.toxicity_chain(docs, queries.table(spark, sf_dir, "labels"))
    _, bad = toxicity._verdicts([r["text"] for r in rows], chain, 0.75)
    rows = [r for r, b in zip(rows, bad, strict=True) if not b]

    stay = _groups({r["doc_id"]: r["text"] or "" for r in rows})
    kept = [r for r in rows if r["doc_id"] in stay]

    stages = dict(corpus_pipeline.STAGES)
    third = spark.createDataFrame(kept, docs.schema)
    model = pii.fit_on(third)
    for r in kept:
        r["text"] = None if r["text"] is None else _masked(r["text"], model)
    assert sorted(map(repr, stages["personal data"](spark, third, sf_dir).collect())) == sorted(
        map(repr, spark.createDataFrame(kept, docs.schema).collect())
    )
    fourth = spark.createDataFrame(kept, docs.schema)
    passes = [r.doc_id for r in mixing.mix(fourth, repeat=queries.PIPELINE_REPEAT).collect()]
    pieces = sampling.Pieces(corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    sampler = sampling.Sampler(pieces)
    texts = {r["doc_id"]: r["text"] or "" for r in kept}
    want = []
    for i in passes:
        [starts] = sampler.lattices.starts([texts[i]])
        want.append((i, sampler.samples([starts], 1, [sampling.row_key(i, 0)])[0][0][0].tolist()))
    found = [(r.doc_id, r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert sorted(found) == sorted(want)


def _masked(text, model):
    out, done = "", 0
    for start, end, kind in pii.all_spans(text, model):
        if start >= done:
            out += text[done:start] + f"<{kind}>"
        done = max(done, end)
    return out + text[done:]


def test_stages_keep_the_columns(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").withColumn("toxic", queries.F.lit("x")).withColumn("fp", queries.F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_take_empty_tables(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
