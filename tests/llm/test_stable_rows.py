"""Rows keep their numbers when scans are split anew between two jobs, as when executors come or go."""

import pytest
from pyspark.sql import functions as F

from quern.llm import common, mixing, repeats, similar, simhash
from quern.llm.common import numbered
from quern.llm.substring_dedup import substring_dedup
from quern.llm.suffix_dedup import suffix_dedup


@pytest.fixture(scope="module")
def files(spark, data, tmp_path_factory):
    """The documents in 16 files of unequal size."""
    path = str(tmp_path_factory.mktemp("files") / "documents.parquet")
    spark.read.parquet(f"{data}/documents.parquet").repartition(16, F.expr("doc_id div 7 % 40")).write.parquet(path)
    return path


@pytest.fixture
def resplit(spark, monkeypatch):
    """From here on every table that an operator stores is followed by another way to split files."""
    before, turn = common.stored, [0]
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism")

    def split():
        turn[0] += 1
        for name, value in zip(names, (("20k", "0", "8"), ("90k", "0", "3"), ("1g", "4m", "1"))[turn[0] % 3], strict=True):
            spark.conf.set(name, value)

    def stored(df):
        out = before(df)
        split()
        return out

    for module in (repeats, similar, simhash, mixing, common):
        monkeypatch.setattr(module, "stored", stored)
    split()
    yield
    for name in names:
        spark.conf.unset(name)


def rows(df):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("operator", [suffix_dedup, substring_dedup, similar.similar_dedup, simhash.simhash_dedup, mixing.mixed])
def test_same_result(spark, files, operator, request):
    docs = spark.read.parquet(files)
    want = rows(operator(docs))
    request.getfixturevalue("resplit")
    assert rows(operator(spark.read.parquet(files))) == want and len(want) > 50


def test_numbers(spark, files, resplit):
    docs = spark.read.parquet(files)
    first = {r.row: r.doc_id for r in numbered(docs.where("doc_id > 5")).collect()}
    common.stored(docs.limit(1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    assert first == {r.row: r.doc_id for r in numbered(docs.where("doc_id > 5")).collect()} and len(first) == docs.where("doc_id > 5").count()
    # other inputs are stored with their numbers
    for other in (docs.union(docs), docs.sample(0.5), spark.range(9).withColumn("doc_id", F.col("id")), docs.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2))))):
        found = numbered(other)
        got = [(r.row, r.doc_id) for r in found.collect()]
        assert got == [(r.row, r.doc_id) for r in found.collect()] and len({r for r, _ in got}) == len(got)
    assert numbered(docs.withColumn("_metadata", F.lit(1))).columns == [*docs.columns, "_metadata", "row"]


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
