"""The pipeline against plain versions of its stages; the learned languages are those of the operator, tested elsewhere."""

import ast
import re

import pyarrow as pa
import pytest
from test_decontaminate import brute
from test_near_stage import plain_groups
from test_packing import check, tokenizer  # noqa: F401

import corpus_pipeline
from millrace.llm import language_id


def tables(spark, documents, benchmark, folder):
    documents.write.parquet(f"{folder}/documents.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def benchmark(spark, small):
    odd = spark.createDataFrame([(None, "the of"), (900, None), (901, "")], "item_id long, text string")
    return spark.read.parquet(f"{small}/benchmark.parquet").unionByName(odd)


def of_each(rows, group):
    """The row of the smallest id of each group, null ids last."""
    best = {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        best.setdefault(group(text), (key, text))
    return list(best.values())


def plain(rows, model, items):
    texts = pa.array([t for _, t in rows], pa.string())
    found = language_id.predict(texts, model)
    assert all((lang == "und") == (not any(c.isalpha() for c in t or "")) for lang, (_, t) in zip(found.lang, rows))
    rows = [r for r, lang, score in zip(rows, found.lang, found.score) if lang != "und" and score >= 0.3]
    after = [len(rows)]
    rows = of_each(rows, lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t))
    after.append(len(rows))
    group = {t: g for (_, t), g in zip(rows, plain_groups(rows))}
    rows = of_each(rows, group.get)
    after.append(len(rows))
    dirty = {i for i, *_, bad in map(ast.literal_eval, brute([(i, t) for i, (_, t) in enumerate(rows)], items)) if bad}
    rows = [r for i, r in enumerate(rows) if i not in dirty]
    return rows, [*after, len(rows)]


def test_run_over_odd_and_given_documents(spark, odd, small, benchmark, tokenizer, tmp_path):  # noqa: F811
    given = spark.read.parquet(f"{small}/documents.parquet")
    given = given.withColumn("doc_id", given.doc_id + 10_000)
    docs = odd.unionByName(given, allowMissingColumns=True)
    folder = tables(spark, docs, benchmark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    wanted, after = plain(rows, language_id.train(docs), [(r["item_id"], r["text"]) for r in benchmark.collect()])
    assert len(rows) > after[0] > after[1] > after[2] >= after[3] > 100
    check(corpus_pipeline.run(spark, folder).collect(), wanted, tokenizer)


def test_stages_keep_the_columns(spark, odd, benchmark, tmp_path):
    folder = tables(spark, odd, benchmark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes


def test_empty_documents(spark, empty, benchmark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, empty, benchmark, tmp_path)).count() == 0


def test_without_benchmark_items(spark, odd, benchmark, tmp_path):
    folder = tables(spark, odd, benchmark.where("false"), tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.clean_stage(spark, docs, folder).count() == docs.count()
