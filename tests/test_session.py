"""Where intermediates may be written, and that they are removed again."""

import os

import pytest

from vaneflow.session import fallback_root, release, scratch_root, stage


def test_setting_is_used(spark):
    assert scratch_root(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"])
def test_local_folder_is_refused_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        fallback_root(master, "file:/data/warehouse")
    assert fallback_root(master, "hdfs://store/warehouse/") == "hdfs://store/warehouse/scratch"


def test_local_folder_is_fine_on_one_machine():
    assert fallback_root("local[8]", "file:/data/warehouse") == "file:/data/warehouse/scratch"


def test_release_removes_staged_tables(spark):
    staged = stage(spark.range(10), "numbers")
    folder = os.path.dirname(staged.inputFiles()[0]).removeprefix("file:").replace("///", "/")
    assert staged.count() == 10 and os.path.isdir(folder)
    release(spark)
    assert not os.path.exists(folder)
