import pytest

from sextant import scratch


class Fake:
    """A session of a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Fake)


def test_tables_lie_in_the_folder_that_is_set(spark):
    df = scratch.written(spark.range(5), "five")
    assert df.count() == 5 and df.columns == ["id"]
    assert spark.conf.get("spark.checkpoint.dir").removeprefix("file://") in df.inputFiles()[0]
