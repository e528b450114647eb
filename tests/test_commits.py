"""Tables with manifests: what a save that fails leaves behind, and readers during a save."""
import pytest
from pyspark.sql import functions as F

from tidemark.operators.checkpoints import Checkpoints


@pytest.fixture
def kept(spark, tmp_path):
    return Checkpoints(spark, f"file://{tmp_path}/c", "settings")


def values(df):
    return sorted(r.id for r in df.collect())


def test_a_save_that_fails_between_its_writes_leaves_the_old_table(spark, kept, monkeypatch):
    kept.save(spark.range(5), "t")
    old = kept.meta("t")

    def fail(*a):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Checkpoints, "_publish", fail)
        with pytest.raises(OSError):
            kept.save(spark.range(50), "t")
    assert kept.meta("t") == old and values(kept.load("t")) == [0, 1, 2, 3, 4] and kept.is_fresh("t")
    bad = spark.range(3).select("id", F.raise_error(F.lit("broken")).cast("string").alias("x"))
    with pytest.raises(Exception, match="broken"):
        kept.save(bad, "t")
    assert values(kept.load("t")) == [0, 1, 2, 3, 4]
    kept.save(spark.range(2), "t")
    assert values(kept.load("t")) == [0, 1] and kept.meta("t")["rows"] == 2 and [m["name"] for m in kept.list()] == ["t"]


def test_a_first_save_that_fails_leaves_no_table(spark, kept, monkeypatch):
    monkeypatch.setattr(Checkpoints, "_publish", lambda *a: (_ for _ in ()).throw(OSError()))
    with pytest.raises(OSError):
        kept.save(spark.range(5), "t")
    with pytest.raises(FileNotFoundError):
        kept.load("t")
    assert kept.meta("t") is None and kept.list() == []


def test_a_table_made_of_itself_and_its_reader(spark, kept):
    kept.save(spark.range(4), "t")
    reader = kept.load("t")
    kept.save(kept.load("t").select((F.col("id") * 10).alias("id")), "t")
    assert values(kept.load("t")) == [0, 10, 20, 30] and values(reader) == [0, 1, 2, 3]
    kept.save(spark.range(1), "t")
    versions = kept._fs().listStatus(kept._path("t.versions"))
    assert len([1 for _ in versions]) == 2
    kept.clear("t")
    assert kept.list() == [] and not kept._fs().exists(kept._path("t.versions"))
