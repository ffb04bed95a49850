"""Session settings and the work folder."""

import pytest

from pulseline import session


def test_own_tuning_stays(spark):
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1MB")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        session.configure(spark)
        assert spark.conf.get(key) == "1MB"
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        spark.conf.set(key, before)


def test_work_dir_is_fresh_and_shared(spark):
    one, two = session.work_dir(spark, "x"), session.work_dir(spark, "x")
    assert one != two
    assert one.startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))


def test_cluster_needs_a_shared_folder():
    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Context:
        master = "yarn"
        getConf = staticmethod(Conf)

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(Session(), "x")
