import os
from types import SimpleNamespace

import pytest

from convolens import runtime


def session(master, checkpoint=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint, setCheckpointDir=lambda d: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=context)


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(session(master))
    assert runtime.shared_dir(session(master, "/shared")) == "/shared"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_one_machine_may_use_its_own(master):
    assert os.path.isdir(runtime.shared_dir(session(master)))


def test_release_deletes_scratch_only(spark, tmp_path):
    other = tmp_path / "mine"
    spark.range(3).write.parquet(str(other))
    before = dict(runtime._scratch)
    runtime._scratch.clear()
    try:
        kept = runtime.stored(spark.range(5))
        (path,) = runtime._scratch[spark.sparkContext.applicationId]
        local = path.removeprefix("file:")
        assert kept.count() == 5 and os.path.isdir(local)
        assert runtime.release(spark) == 1 and not os.path.exists(local)
        assert other.exists() and runtime.release(spark) == 0
    finally:
        runtime._scratch.update(before)
