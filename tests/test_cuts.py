import gc
import os
import subprocess
import sys
import time

import pytest

from wardspan.operators import cuts

MODULES = ["activity", "alerting", "evaluation", "history", "ingesting", "named", "people", "registry", "scores", "streams", "texts"]


@pytest.mark.parametrize("name", MODULES)
def test_each_module_can_come_first(name):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", f"import wardspan.plans.{name}"], cwd=root, check=True, timeout=120)


def folder_of(df):
    return cuts._reader(df)[1].removeprefix("file:")


def test_a_callers_checkpoint_survives_and_cuts_go(spark):
    jvm = spark._jvm
    own = cuts.cut(spark.range(10))
    theirs, kept = spark.range(20).checkpoint(), cuts.cut(spark.range(30))
    paths = [folder_of(df) for df in (own, theirs, kept)]
    assert spark.sparkContext.getConf().get("spark.cleaner.referenceTracking.cleanCheckpoints") is None
    assert all(map(os.path.isdir, paths))
    derived = kept.filter("id > 3")
    del own, theirs, kept
    for _ in range(20):
        gc.collect()
        jvm.System.gc()
        cuts.sweep(spark)
        if not os.path.isdir(paths[0]):
            break
        time.sleep(0.2)
    assert [os.path.isdir(p) for p in paths] == [False, True, True] and derived.count() == 26


def test_release(spark):
    df = cuts.cut(spark.range(5))
    path = folder_of(df)
    cuts.release(df, spark.range(3))
    assert not os.path.exists(path) and all(entry[2] != path for entry in cuts._KEPT)
