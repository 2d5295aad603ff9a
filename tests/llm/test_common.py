"""The shared folder: an error on a cluster without one, and what forget() leaves."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from tessera.llm import common


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    monkeypatch.setattr(common, "_own", {})
    away = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: other), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError):
        common.shared_dir(away)


def test_saved_tables_go_with_forget(spark, monkeypatch):
    monkeypatch.setattr(common, "_own", {})
    df = common.save(spark.range(5), "five")
    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    assert df.count() == 5 and any(folder.rglob("five/*.parquet"))
    common.forget(spark)
    assert not folder.exists()
    assert common.save(spark.range(3), "three").count() == 3


def test_small_counts_rows(spark):
    assert common.small(spark.range(5), 5) and not common.small(spark.range(6), 5)
