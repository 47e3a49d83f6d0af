"""Where intermediates go."""

import pytest
from conftest import same_rows

from tidecast.sources.scratch import fresh_dir, shared_root, written


class Session:
    """Only the settings of a session."""

    def __init__(self, **settings):
        self.settings = settings

    @property
    def conf(self):
        return self

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_named_folder_is_used():
    settings = {"spark.checkpoint.dir": "hdfs://shared/cp", "spark.master": "yarn"}
    assert shared_root(Session(**settings)) == "hdfs://shared/cp"


def test_cluster_without_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Session(**{"spark.master": "yarn"}))


def test_local_session_may_go_without():
    assert shared_root(Session(**{"spark.master": "local[2]"}))


def test_written_table_is_the_same(spark):
    df = spark.range(100).selectExpr("id", "if(id % 3 = 0, NULL, id) AS k")
    assert same_rows(written(df, "t"), df)
    assert written(df.limit(0), "t").dtypes == df.dtypes
    assert fresh_dir(spark, "a") != fresh_dir(spark, "a")
