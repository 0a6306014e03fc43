import os
from types import SimpleNamespace

import pytest

from seqloom.session import drop, materialize, work_dir


def session(named, master="local[4]"):
    get = lambda _key, default=None: named or default
    return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=get), applicationId="stub", master=master))


def test_the_named_folder_comes_first():
    assert work_dir(session("hdfs://shared/work/")) == "hdfs://shared/work"
    with pytest.raises(RuntimeError):
        work_dir(session(None, "spark://host:7077"))
    own = work_dir(session(None))
    assert own.startswith("file:///") and own == work_dir(session(None))


def test_tables_are_written_and_dropped(spark):
    d, path = materialize(spark.range(5), "numbers")
    assert path.startswith(f"{work_dir(spark)}/numbers-") and d.count() == 5
    drop(spark, path)
    assert not os.path.exists(path.removeprefix("file://"))
