import __spark_entry__ as E

from conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert [r["epoch"] for r in sorted(rows, key=lambda r: r["epoch"])] == [1, 2, 3, 4, 5]
    assert sum(r["is_best"] for r in rows) == 1 and all(0.0 <= r["accuracy"] <= 1.0 for r in rows)
    assert [f.name for f in df.schema.fields] == ["epoch", "accuracy", "is_best"]


def test_every_query_has_oracle_or_is_documented():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_small_queries_run(spark):
    q = E.queries()
    for name in ["to_long", "pminhash_samples", "squeeze_job", "train_ovr", "split_shares", "scan_run_logs"]:
        assert q[name](spark, SF_SMALL).count() > 0


def test_checkpoint_fallback_when_session_names_none():
    from skein.session import ensure_checkpoint_dir

    class _Conf:
        def get(self, key, default=None):
            return default

    class _SC:
        def __init__(self, master="local[4]"):
            self.dir, self.master = None, master

        def getCheckpointDir(self):
            return self.dir

        def getConf(self):
            return _Conf()

        def setCheckpointDir(self, path):
            self.dir = "file:" + path

    class _Spark:
        sparkContext = _SC()

        @property
        def conf(self):  # the core config must not be written at run time
            raise AssertionError("spark.conf must not be touched")

    got = ensure_checkpoint_dir(_Spark())
    assert got.startswith("file:") and "skein-ckpt-" in got


def test_no_local_checkpoint_folder_on_a_cluster():
    import pytest

    from skein.session import ensure_checkpoint_dir

    class _SC:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class _Spark:
        sparkContext = _SC()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Spark())
