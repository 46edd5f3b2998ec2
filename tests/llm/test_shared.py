import os

import numpy as np
import pytest

from tessella.llm import shared


def test_written_and_released(spark):
    df = shared.written(spark.range(5).toDF("id"), "t")
    assert df.count() == 5
    made = [p.removeprefix("file://") for p in shared._made]
    assert made and os.path.isdir(made[-1])
    shared.release(spark)
    assert not any(map(os.path.exists, made)) and not shared._made


def test_steps_are_released(spark):
    shared.written(spark.range(1).toDF("id"), "kept")
    begun = shared.mark()
    for k in range(3):
        last = shared.written(spark.range(k + 1).toDF("id"), "step")
    made = [p.removeprefix("file://") for p in shared._made]
    shared.release(spark, begun, keep=1)
    assert [os.path.isdir(p) for p in made[begun - 1 :]] == [True, False, False, True] and last.count() == 3
    shared.release(spark)


class Cluster:
    """A session on a cluster that names no shared folder."""

    class conf:  # noqa: N801
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Context:
                    class getCheckpointDir:  # noqa: N801
                        isDefined = staticmethod(lambda: False)

                return Context


def test_a_cluster_needs_a_shared_folder():
    made = list(shared._made)
    with pytest.raises(RuntimeError):
        shared.shared_dir(Cluster)
    assert shared._made == made


def test_bitmap(spark):
    rows = spark.range(1000).selectExpr("xxhash64(id) AS key")
    keys = np.array([r.key for r in rows.collect()])
    bits = shared.bitmap(rows, "key")
    assert shared.in_bitmap(bits, keys).all() and shared.in_bitmap(bits, np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 10_000)).mean() < 0.1
    assert not shared.in_bitmap(shared.bitmap(rows.limit(0), "key"), keys).any()


class Session:
    """A session whose cluster names a shared folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(name, default=None):
            return "hdfs://cluster/shared/" if name == "spark.checkpoint.dir" else default


def test_folder_is_the_sessions():
    try:
        assert shared.shared_dir(Session).startswith("hdfs://cluster/shared/")
    finally:
        shared._made.pop()
