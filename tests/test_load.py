"""A load writes the tables that are asked for, with the same rows in any order."""

import os
import shutil

from boxline.sources import star

SF = "/root/testdata/sf0.001"


def same(a, b):
    names = sorted(a.columns)
    assert names == sorted(b.columns) and a.select(names).exceptAll(b.select(names)).isEmpty() and b.select(names).exceptAll(a.select(names)).isEmpty()


def test_tables_are_written_when_asked_for(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("one", "two", "three")]
    for path in paths:
        shutil.copytree(SF, path)
    few, some, whole = (star.load(spark, p) for p in paths)
    folder = lambda m: os.path.dirname(star._written(spark, m.sf_dir, "fixtures"))
    whole.write()
    same(few.fixtures, whole.fixtures)
    assert os.listdir(folder(few)) == ["fixtures"]
    for name in ("daily", "matches", "fixtures"):
        same(getattr(some, name), getattr(whole, name))
    assert sorted(os.listdir(folder(some))) == ["daily", "fixtures", "matches", "sold"]
    for name in ("tickets", "customers"):
        same(getattr(some, name), getattr(whole, name))
