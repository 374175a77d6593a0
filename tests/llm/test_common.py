from types import SimpleNamespace

import pytest

from pixelframe.llm import common


def session(master, named=None):
    """As much of a session as the shared folder is taken from."""
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named if key == "spark.checkpoint.dir" else default), sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_must_name_the_shared_folder(master):
    with pytest.raises(RuntimeError):
        common.shared_dir(session(master))
    assert common.shared_dir(session(master, "hdfs://x/shared/")) == "hdfs://x/shared"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_process_may_use_a_folder_of_its_own(master):
    one = session(master)
    assert common.shared_dir(one) and common.shared_dir(one) == common.shared_dir(one)


def test_staged_tables_keep_rows_and_types(spark):
    df = spark.createDataFrame([(1, None, [1.5]), (None, "x", None)], "a bigint, b string, c array<double>")
    back = common.staged(df, "t")
    assert back.dtypes == df.dtypes and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert common.staged(df.where("false"), "t").count() == 0


def test_finished_deletes_what_was_staged_on_the_way(spark):
    from pathlib import Path

    paths = []

    def make():
        one = common.staged(spark.range(5).withColumnRenamed("id", "a"), "inner")
        two = common.finished(lambda: common.staged(one.where("a > 1"), "deep").where("a > 2"), "middle")
        paths.extend(p.removeprefix("file:") for df in (one, two) for p in df.inputFiles())
        return one.join(two, "a")

    out = common.finished(make, "outer")
    assert sorted(r.a for r in out.collect()) == [3, 4] and paths and not any(Path("/" + p.lstrip("/")).exists() for p in paths)
    with pytest.raises(ZeroDivisionError):
        common.finished(lambda: 1 / 0, "broken")
    assert common._MADE == []
