"""Builds that break off, builds beside open readers, and what is removed."""

import json
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from heliograph.operators import margin as mg
from heliograph.plans import builder as bd
from heliograph.plans.builder import CatalogBuilder
from heliograph.plans.catalog import Catalog
from heliograph.sources import storage

SCHEMA = "source_id bigint, ra double, dec double"


def frame(spark, n, first=0):
    return spark.createDataFrame([(first + i, (i * 137.5) % 360, ((i * 61.8) % 178) - 89) for i in range(n)], SCHEMA)


def make(spark, where, df, **k):
    return CatalogBuilder(spark, "c", source=df, **({"order_k": 4, "threshold": 30, "margin": 0.5, "location": str(where), "allow_overflow": True} | k))


def seen(cat):
    ids = sorted(r.source_id for r in cat.load(["source_id"]).collect())
    near = sorted(map(tuple, cat.load(["source_id", "Norder", "Npix"], "neighbor").collect())) if cat.meta["margin"] else None
    return ids, near, len(cat), cat.partitions().agg(F.sum("n")).first()[0], cat.density().agg(F.sum("n")).first()[0], cat.cone_search(10, 10, 40).count()


#: each step of a build: module or class, and the name that breaks after or before its work
STEPS = [(bd.pt, "density"), (bd.pt, "partition_map"), (bd.pt, "in_partitions"), (bd, "write_tree"), (mg, "margin_rows"), (storage, "write_text"), (storage, "replace_text")]


@pytest.mark.parametrize("owner,name", STEPS, ids=[n for _, n in STEPS])
def test_a_build_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch, owner, name):
    make(spark, tmp_path, frame(spark, 120)).build()
    reader = Catalog(spark, "c", str(tmp_path))
    before = seen(reader)
    plain = getattr(owner, name)

    def broken(*a, **k):
        if name in ("write_tree", "write_text"):
            plain(*a, **k)
        raise OSError("broken off")

    monkeypatch.setattr(owner, name, broken)
    with pytest.raises(OSError, match="broken off"):
        make(spark, tmp_path, frame(spark, 40, 1000), order_k=3).build()
    monkeypatch.undo()
    assert seen(Catalog(spark, "c", str(tmp_path))) == before == seen(reader)
    left = make(spark, tmp_path, frame(spark, 1))
    assert left.vacuum() == []  # too young
    removed = left.vacuum(hours=-1)
    assert all(x.startswith("builds/") for x in removed) and len(removed) <= 1
    assert seen(reader) == before


def test_lost_rows_leave_the_old_build(spark, tmp_path):
    make(spark, tmp_path, frame(spark, 50)).build()
    b = make(spark, tmp_path, frame(spark, 80))
    b.density()
    b.rows = b.rows.where("source_id > 3")
    with pytest.raises(bd.LostRows):
        b.build()
    assert seen(Catalog(spark, "c", str(tmp_path)))[2] == 50


def test_a_rebuild_without_margin_has_none(spark, tmp_path):
    old = make(spark, tmp_path, frame(spark, 300)).build()
    n = old.load(which="neighbor").count()
    assert n
    new = make(spark, tmp_path, frame(spark, 10), margin=None).build()
    with pytest.raises(FileNotFoundError):
        new.load(which="neighbor")
    assert old.load(which="neighbor").count() == n and old.load().count() == 300


def test_kept_builds_and_their_tables(spark, tmp_path):
    path = f"{tmp_path}/s.csv"
    names = []
    for n in (5, 6, 7, 8):
        with open(path, "w") as f:
            f.write("source_id,ra,dec\n" + "".join(f"{i},{i},{i}\n" for i in range(n)))
        cat = CatalogBuilder(spark, "c", [path], order_k=2, margin=None, location=str(tmp_path)).build()
        names.append(cat.meta["build"])
    assert cat.builds() == [names[3], names[2]]
    assert Catalog(spark, "c", str(tmp_path), build=names[2]).load().count() == 7
    with pytest.raises(FileNotFoundError):
        Catalog(spark, "c", str(tmp_path), build=names[0])
    there = sorted(x.name.split(".")[0] for x in (tmp_path / "c").iterdir() if not x.name.startswith("."))
    assert there == ["builds", "c_meta", "density", "density", "source", "source"]
    with pytest.raises(ValueError):
        make(spark, tmp_path, frame(spark, 1), keep=0)


def test_metadata_is_whole_at_any_time(spark, tmp_path):
    path, done = f"{tmp_path}/x.json", []

    def look():
        n = 0
        while not done:
            n += 1
            with open(path) as f:
                assert len(set(json.load(f)["v"])) == 1
        return n

    storage.replace_text(spark, path, json.dumps({"v": [0] * 20_000}))
    with ThreadPoolExecutor() as pool:
        reads = pool.submit(look)
        end = time.time() + 3
        k = 0
        while time.time() < end:
            k += 1
            storage.replace_text(spark, path, json.dumps({"v": [k] * 20_000}))
        done.append(True)
        assert reads.result() > 10 and k > 10


def test_catalogues_without_builds_still_open(spark, tmp_path):
    """Metadata and trees side by side, as older builds left them."""
    cat = make(spark, tmp_path, frame(spark, 60)).build()
    old = tmp_path / "old"
    old.mkdir()
    for which in ("catalog", "neighbor", "partitions"):
        spark.read.parquet(f"{cat.base}/{which}").write.partitionBy(*(["Norder", "Dir", "Npix"] if which != "partitions" else [])).parquet(str(old / which))
    meta = {k: v for k, v in cat.meta.items() if k not in ("build", "history")} | {"density": "partitions"}
    (old / "old_meta.json").write_text(json.dumps(meta))
    assert Catalog(spark, "old", str(tmp_path)).load().count() == 60
