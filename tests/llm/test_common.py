from pathlib import Path

import pytest

from factloom.llm import common


def test_stored_rows_come_back_and_are_removed(spark):
    df = common.stored(spark.range(5))
    at = [Path(f.removeprefix("file:")) for f in df.inputFiles()]
    assert df.count() == 5 and all(p.exists() for p in at)
    assert common.remove_stored(spark) >= 1
    assert not any(p.exists() for p in at)
    assert common.remove_stored(spark) == 0


class Cluster:
    """A session on a cluster without a checkpoint folder."""

    master = "spark://host:7077"
    conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
    getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    @property
    def sparkContext(self):  # noqa: N802
        return self


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        common.shared_folder(Cluster())
