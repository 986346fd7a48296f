"""Epochs of the store: a stop between any two writes changes nothing; input
listings of artefacts; markdown."""

import os

import pytest
from pyspark.sql import functions as F

from lexgraph.sources import store as ST
from lexgraph.sources.corpus import strip_markdown
from lexgraph.streaming.ingest import ingest_available


def corpus(folder, names):
    os.makedirs(folder, exist_ok=True)
    for n in names:
        with open(os.path.join(folder, n), "w") as f:
            f.write(f"Text of {n} says hello. It is {n} again.")


def tables(spark, root):
    """All rows that count, without the numbers of epochs."""
    out = {k: sorted(map(str, ST.open_store(spark, root, "t", k).drop("vocab_epoch").collect())) for k in ("chunks", "embeddings", "counted", "quarantine")}
    return out | {"vocab": sorted(map(str, ST.vocabulary(spark, root, "t").collect()))}


def test_stop_between_any_two_writes(spark, tmp_path, monkeypatch):
    src = str(tmp_path / "corpus")
    corpus(src, ["a.txt", "b.md", "c.bin"])
    run = lambda root: ingest_available(spark, src, str(tmp_path / root), "t", str(tmp_path / f"{root}-ck"), embed=True, dim=8)
    run("whole")
    writes = {"n": 0, "stop": None}
    write, commit = ST.Epoch.write, ST.Epoch.commit

    def stopping(self, *args, **kw):
        writes["n"] += 1
        if writes["n"] == writes["stop"]:
            raise RuntimeError("stopped here")
        return write(self, *args, **kw)

    def no_commit(self):
        writes["n"] += 1
        if writes["n"] == writes["stop"]:
            raise RuntimeError("stopped here")
        return commit(self)

    monkeypatch.setattr(ST.Epoch, "write", stopping)
    monkeypatch.setattr(ST.Epoch, "commit", no_commit)
    for stop in (2, 4, 5, 6):  # before the chunks, the counted names, the vectors, the manifest
        writes.update(n=0, stop=stop)
        with pytest.raises(Exception):
            run(f"r{stop}")
        assert all(not rows for rows in tables(spark, str(tmp_path / f"r{stop}")).values())
        writes["stop"] = None
        run(f"r{stop}")
        assert tables(spark, str(tmp_path / f"r{stop}")) == tables(spark, str(tmp_path / "whole"))
    corpus(src, ["d.txt"])
    for root in ("whole", "r4"):
        run(root)
    assert tables(spark, str(tmp_path / "r4")) == tables(spark, str(tmp_path / "whole"))
    e = ST.open_store(spark, str(tmp_path / "whole"), "t", "embeddings")
    assert {r["vocab_epoch"]: r["n"] for r in e.groupBy("vocab_epoch").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 2, 2: 1}
    df = {r["token"]: r["df"] for r in ST.vocabulary(spark, str(tmp_path / "whole"), "t").collect()}
    assert df["hello"] == 3 and df["d"] == 1


def test_batch_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("x",)], "chunk_id string")
    for _ in range(2):
        e = ST.Epoch(spark, str(tmp_path), "t", "src", 7)
        if not e.done:
            e.write(rows, "counted")
            e.commit()
    assert ST.epochs(spark, str(tmp_path), "t").count() == 1
    ST.save_store(spark.createDataFrame([("y",)], "chunk_id string"), str(tmp_path), "t", "counted", mode="overwrite")
    assert [r["chunk_id"] for r in ST.open_store(spark, str(tmp_path), "t", "counted").collect()] == ["y"]


def test_artefact_follows_its_input(spark, tmp_path):
    src = str(tmp_path / "in")
    corpus(src, ["a.txt"])
    made = []

    def make():
        made.append(1)
        return spark.read.text(src)

    get = lambda: ST.materialize(spark, str(tmp_path / "store"), "lines", {"k": 1}, make, inputs=[src]).count()
    assert get() == 1 and get() == 1 and len(made) == 1
    corpus(src, ["b.txt"])
    assert get() == 2 and len(made) == 2


def test_markdown_keeps_what_is_no_mark(spark):
    cases = {"snake_case(x)": "snake_case(x)", "2*3*4": "2*3*4", "see a.b/c_d": "see a.b/c_d", "**bold** and *it*": "bold and it",
             "`a_b_c` and _x_": "a_b_c and x", "https://e.org/a_b_/c*d* *z*": "https://e.org/a_b_/c*d* z", "# Title\n\ntext": "Title\n\ntext",
             "#tag": "#tag", "- one\n- two": "one\ntwo", "[t](u) ![i](j)": "t i", "***b***": "b", "a * b * c": "a * b * c", "": "", "``x`` y": "x y"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "md string, want string")
    got = rows.select("md", "want", strip_markdown("md").alias("got")).collect()
    assert {r["md"]: r["got"] for r in got} == cases
