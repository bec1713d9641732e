"""The shared folder: whose it is, and what is left in it."""

import pytest
from codelode import common


class _Context:
    """A context of a cluster that names no shared folder."""

    master = "yarn"

    class _jsc:
        class sc:
            def getCheckpointDir(self):
                class Nothing:
                    def isDefined(self):
                        return False

                return Nothing()


class _Session:
    sparkContext = _Context()

    class conf:
        @staticmethod
        def get(name, default=None):
            return default


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        common.shared_dir(_Session())


def test_scratch_follows_the_checkpoint_folder_and_is_deletable(spark, tmp_path):
    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    try:
        spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
        scratch = common.Scratch(spark)
        assert str(tmp_path) in scratch.root
        assert scratch.write(spark.range(3), "few").count() == 3
        assert list(tmp_path.rglob("*.parquet"))
        scratch.drop()
        assert not list(tmp_path.rglob("*.parquet"))
    finally:
        if before.isDefined():
            spark.sparkContext._jsc.sc().setCheckpointDir(before.get().rsplit("/", 1)[0])
