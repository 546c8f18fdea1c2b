import os
from types import SimpleNamespace

import pytest

from tidemark import session as S


def test_scratch_folders_are_new_and_cleared(spark, tmp_path):
    a, b = S.scratch(spark, "x"), S.scratch(spark, "x")
    assert a != b
    spark.range(3).write.parquet(a)
    assert spark.read.parquet(a).count() == 3
    assert S.clear_scratch(spark) >= 2 and not os.path.exists(a.removeprefix("file:"))
    assert S.clear_scratch(spark) == 0


def test_a_cluster_must_name_a_shared_folder():
    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=sc))
