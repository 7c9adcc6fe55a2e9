import os

import pytest

from treeline import session


def test_cut_keeps_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "cast(null as string) as `tokens:chars-4`", "array(id) as place")
    written = session.cut(df)
    assert written.schema.simpleString() == df.schema.simpleString()
    assert sorted(written.collect()) == sorted(df.collect())


def test_dropped_cuts_are_gone(spark):
    session.cut(spark.range(3))
    places = list(session._cuts)
    assert all(os.path.isdir(p.removeprefix("file:")) for p in places)
    assert session.drop_cuts(spark) == len(places)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in places)


def test_the_named_folder_is_used(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before is not None:
        assert session.checkpoint_dir(spark) == before
    else:
        assert session.checkpoint_dir(spark)


def test_a_cluster_must_name_its_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Fake:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Fake())


def test_many_small_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"repo_id={i:03}").mkdir()
        (tmp_path / f"repo_id={i:03}" / "part-0.txt").write_text("x\ny\n")
    before, context = spark.conf.get(session.LISTING), spark.sparkContext
    context.setJobGroup("listing", "folders")
    with session.folders_listed_together(spark):
        lines = spark.read.schema("value string, repo_id string").text(str(tmp_path))
    context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    stages = [s for job in status.getJobIdsForGroup("listing") for s in status.getJobInfo(job).stageIds]
    assert stages and max(status.getStageInfo(s).numTasks for s in stages) <= 4 * context.defaultParallelism < 100
    assert spark.conf.get(session.LISTING) == before
    assert lines.groupBy("repo_id").count().where("count = 2").count() == 100
