"""Where intermediate tables go."""

from __future__ import annotations

import os

import pytest

from threadlake import session


class Named:
    """A session whose settings name a folder; everything else is the real session."""

    def __init__(self, spark, folder, master="local[2]"):
        self._spark, self._folder, self._master = spark, folder, master
        self.conf = self

    def get(self, key, default=None):
        return self._folder if key == "spark.checkpoint.dir" else default

    @property
    def sparkContext(self):
        return self

    @property
    def master(self):
        return self._master

    def getCheckpointDir(self):
        return None

    def __getattr__(self, name):
        return getattr(self._spark.sparkContext, name)


def test_the_named_folder_wins_and_is_emptied(spark, tmp_path):
    named = Named(spark, str(tmp_path))
    assert session.shared_folder(named) == str(tmp_path)
    spark.range(5).write.parquet(f"{session.run_folder(named)}/five")
    session.drop_intermediate(named)
    assert not os.listdir(tmp_path)


def test_a_cluster_must_name_its_folder(spark):
    with pytest.raises(ValueError):
        session.shared_folder(Named(spark, None, "spark://host:7077"))


def test_tables_are_written_below_the_folder(spark):
    table = session.materialize(spark.range(5), "five")
    assert table.count() == 5
    assert all("/five-" in f for f in table.inputFiles())


def test_a_local_session_gets_a_folder_once(spark):
    assert session.shared_folder(spark) == session.shared_folder(spark)


def test_batches_are_bounded_in_bytes(spark):
    assert session.SETTINGS["spark.sql.execution.arrow.maxBytesPerBatch"] == spark.conf.get(
        "spark.sql.execution.arrow.maxBytesPerBatch"
    )
