from types import SimpleNamespace

import pytest

from stopwise import deploy


def session(master, named=None):
    context = SimpleNamespace(master=master, applicationId="app", getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named), sparkContext=context)


def test_shared_folder_is_named_on_a_cluster():
    assert deploy.shared_dir(session("spark://host:7077", "s3a://bucket/tmp/")) == "s3a://bucket/tmp/stopwise/app"
    assert deploy.shared_dir(session("local[4]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            deploy.shared_dir(session(master))


def test_heaps_and_kept_tables(spark):
    deploy.free_heaps(spark)
    assert sorted(deploy.kept(spark.range(3), "test").collect()) == sorted(spark.range(3).collect())
