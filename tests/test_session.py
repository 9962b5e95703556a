"""The shared folder for intermediate tables."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from fillgauge import session


def fake(master: str, folder: str | None = None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake(master), "t")
    assert session.shared_dir(fake(master, "hdfs:///shared/"), "t").startswith("hdfs:///shared/fillgauge-t-")


def test_a_local_session_may_use_a_temporary_one():
    assert "/fillgauge-" in session.shared_dir(fake("local[4]"), "t")


def test_written_tables_can_be_removed(spark, tmp_path):
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: str(tmp_path)), sparkContext=spark.sparkContext)
    spark.range(5).write.parquet(session.shared_dir(named, "t"))
    (tmp_path / "other").mkdir()
    assert len(list(tmp_path.iterdir())) == 2
    session.remove_written(named)
    assert [p.name for p in tmp_path.iterdir()] == ["other"]
