"""Streams over tables kept as one file or as a folder of part files, and streams without rows."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from mediaframe import catalog
from mediaframe.streaming import streams

catalog.load()


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The tables of the smallest data set, each a folder of three part files."""
    root = tmp_path_factory.mktemp("tables")
    for name in ("conversations", "embeddings", "events", "customer"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["progress_stream", "identify_stream", "enrich_stream"])
def test_folders_and_files_give_the_same_rows(spark, folders, name):
    got, want = (sorted(map(str, catalog.QUERIES[name](spark, sf).collect())) for sf in (folders, SF))
    assert got == want and got


def test_streams_without_rows_give_empty_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("job_id bigint, seq bigint, stage string, pct double").parquet(str(tmp_path / "in"))
    assert streams.drain(streams.progress_stream(source), "complete").count() == 0
    probes = spark.readStream.schema("vec_id bigint, embedding array<float>").parquet(str(tmp_path / "in"))
    bank = lambda: spark.createDataFrame([(1, 1, 1, [1.0, 0.0])], "ref_id bigint, owner int, crop_group bigint, embedding array<float>")
    assert streams.identify_stream(probes, bank, 0.4, 0.05).filter(F.col("vec_id") > 0).count() == 0
