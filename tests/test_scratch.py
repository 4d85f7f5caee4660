from tessella.sources import scratch


def test_cut_and_clear(spark):
    before = dict(scratch._WRITTEN)
    scratch._WRITTEN.clear()
    a, b = scratch.cut(spark.range(5), "t"), scratch.cut(spark.range(3), "t")
    assert a.count() == 5 and a._scratch_path.startswith(scratch.scratch_root(spark))
    scratch.discard(a)
    assert list(scratch._WRITTEN) == [b._scratch_path]
    scratch.clear()
    assert not scratch._WRITTEN
    scratch._WRITTEN.update(before)
