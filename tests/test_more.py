"""Queries beside their SQL, on rows that the test tables lack."""

import json

import pytest

from pyspark.sql import functions as F

from curatrix.operators import rules
from curatrix.plans import exports, more
from curatrix.sources import readers

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"


def beside_sql(spark, rows, name, folder):
    import duckdb

    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return sorted(map(tuple, more.QUERIES[name](spark, str(folder)).collect())), sorted(db.execute(more.ORACLE_SQL[name]).fetchall())


def test_mix_is_rounded_as_by_sql(spark, tmp_path):
    # 0.9 * 9 / 32 * 14 and 0.9 * 41 / 128 * 24 end with a half in exact numbers and below it in doubles
    found, wanted = beside_sql(spark, [(1, "2622;", "en", "s", 5), (2, "2222[2:", "en", "s", 7), (3, "2", "en", "s", 1), (4, "a quiet song", None, None, None)], "a13_no_vocals", tmp_path)
    assert found == wanted and len(found) == 4
    assert found[0][1].split(",")[1] == "3.5438" and found[1][1].split(",")[6] == "6.9188"


def test_captions_come_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    rules.repeats(F.col("caption"))
    assert int(spark.conf.get(key)) <= 1000


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "3000")
    yield
    spark.conf.set(key, before)


def test_document_is_read_in_splits(spark, tmp_path, small_splits):
    rows = [(i, "a line\nand é " * (i % 40), "en", "s", i) for i in range(300)]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = exports.k2_json_lines(spark, str(tmp_path))
    # no task holds the document
    assert found.rdd.getNumPartitions() > 10
    kept = [i for i in range(300) if i % 29]
    assert sorted(map(tuple, found.collect())) == [(k, str(i), len(kept)) for k, i in enumerate(kept)]


@pytest.mark.parametrize("text", [
    '{"metadata": {"name": "x"}, "samples": [\n{"id": "a"},{"id": "b"}\n,{"id": "c"}\n]}\n', '{"metadata": {"name": "x"}, "samples": [\n{"id": "a"},\n{"id": "b"},\n{"id": "c"}\n]}\n',
    json.dumps({"metadata": {"name": "x"}, "samples": [{"id": x} for x in "abc"]}, indent=2), json.dumps({"samples": [{"id": x} for x in "abc"], "metadata": {"name": "x"}}),
    '{"metadata": {"name": "x"}, "samples": [\n{"id": "a"}\n,{"id": "b"}\n,{"id": "c"}\n]}\n',
])
def test_documents_of_any_layout(spark, tmp_path, text):
    path = tmp_path / "d.json"
    path.write_text(text)
    metadata, rows = readers.dataset(spark, str(path))
    assert [json.loads(r.metadata) for r in metadata.collect()] == [{"name": "x"}]
    assert sorted((r.pos, r.id, tuple(r["keys"])) for r in rows.collect()) == [(0, "a", ("id",)), (1, "b", ("id",)), (2, "c", ("id",))]
