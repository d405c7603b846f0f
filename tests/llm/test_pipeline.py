import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
import rows
from logspark.llm.queries import ORACLES, QUERIES
from logspark.llm.tables import staged

SF_DIR = entry_point.SMOKE_DIR
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    df = QUERIES[name](spark, SF_DIR)
    result = connection.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(tuple(r) for r in result.fetchall())


def with_passage(spark):
    """The awkward rows and one that holds a benchmark passage."""
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    return rows.documents(spark, [*rows.texts(), (50, f"before. {item} after", "en", "s")])


@needs_tables
def test_stages_on_awkward_rows(spark):
    docs = with_passage(spark)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, SF_DIR), f"test-{name}")
        if name != "mixing":
            assert docs.columns == before.columns
        seen[name] = sorted((r.doc_id if r.doc_id is not None else -1 for r in docs.collect()))
    assert not {4, 5, 6, 7, 12} & set(seen["language"]) and {1, 8, 10, 13, -1, 50} <= set(seen["language"])
    assert seen["lines"] == seen["language"]
    # 2 and 3 are as 1, 9 as 8; of the rows without id one stays; the second 11 lost all lines.
    assert seen["near_duplicates"] == [-1, 1, 8, 10, 11, 11, 13, 50]
    assert seen["decontamination"] == [-1, 1, 8, 10, 11, 11, 13]
    assert set(seen["mixing"]) <= set(seen["decontamination"])
    assert all(0 < r.taken <= 2 * r.mix_size for r in docs.collect())


@needs_tables
def test_empty_documents(spark):
    docs = rows.documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF_DIR), f"empty-{name}")
        assert docs.count() == 0


@needs_tables
def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF_DIR), f"turn-{name}")
    got = corpus_pipeline.run(spark, SF_DIR)
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in docs.collect())
