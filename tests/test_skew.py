from lexmill import scratch
from lexmill.operators.skew import hot_keys, spread_join


def test_spread_join_is_a_join(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 100), (None, 101), (3, 102)], "k int, x int")
    other = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "e")], "k int, y string")
    want = sorted(map(tuple, rows.join(other, "k").collect()))
    assert [tuple(r) for r in hot_keys(rows, "k", 10, 20).collect()] == [(1, 3)]
    for piece in (5, 20, 1000):
        assert sorted(map(tuple, spread_join(rows, other, "k", 10, piece).collect())) == want
    assert spread_join(rows.limit(0), other, "k").count() == 0
    assert spread_join(rows, other.limit(0), "k", 10, 5).count() == 0


def test_scopes_delete_what_they_do_not_keep(spark):
    from lexmill.storage.fs import Fs

    gone = kept = None
    with scratch.Scope(spark) as outer:
        with scratch.Scope(spark) as inner:
            gone = scratch.materialise(spark.range(3), "gone")._lexmill_path
            kept = inner.keep(scratch.materialise(spark.range(5), "kept"))
        assert kept.count() == 5
        assert not Fs(spark, gone).exists("")
        assert outer.paths == [kept._lexmill_path]
    assert not Fs(spark, kept._lexmill_path).exists("")


def test_no_silent_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    import pytest

    with pytest.raises(scratch.NoSharedFolderError):
        scratch.shared_dir(Session)
