from types import SimpleNamespace

import pytest

from pairlab import session


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_only_a_local_session_may_store_in_a_temporary_folder():
    assert session.shared_dir(fake("local[8]")) and session.shared_dir(fake("local"))
    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake(master))
        assert session.scratch_path(fake(master, "hdfs://x/ck/"), "a").startswith("hdfs://x/ck/pairlab-app-1/a-")


def test_stages_are_stored_by_folder_and_cleared(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "p int, q string, r int")
    kept = session.cut_lineage(df, "t", by=("p",))
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    assert sorted(map(tuple, kept.collect())) == [(1, "a", 5), (2, "b", 6)]
    assert "PartitionFilters: [isnotnull(p" in kept.filter("p = 1")._jdf.queryExecution().toString()
    root = spark._jvm.org.apache.hadoop.fs.Path(session.session_root(spark))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(root)
    session.clear_scratch(spark)
    assert not files.exists(root)
