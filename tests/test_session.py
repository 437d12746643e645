import pytest

from feedloom import session


class Fake:
    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: folder or default)})()


def test_the_cluster_names_the_shared_folder():
    path = session.shared_folder(Fake("yarn", "hdfs:///shared/"), "daily")
    assert path.startswith("hdfs:///shared/daily-")
    assert path != session.shared_folder(Fake("yarn", "hdfs:///shared/"), "daily")


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    assert session.shared_folder(Fake("local-cluster[2,1,1024]", "file:///shared"), "daily").startswith("file:///shared/")
    with pytest.raises(ValueError, match="one machine"):
        session.shared_folder(Fake("yarn", "file:///shared"), "daily")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake("local-cluster[2,1,1024]"), "daily")


def test_only_a_local_master_may_go_without():
    assert "feedloom-" in session.shared_folder(Fake("local[4]"), "daily")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake("spark://host:7077"), "daily")


def test_settings(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
