"""The registered queries of the subpackage: SQL oracles, and the pipeline
stage by stage on planted cases."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import corpus_pipeline  # noqa: E402
from lexgraph.llm.queries import ORACLES, QUERIES  # noqa: E402
from oracle_check import compare, duck  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf, name):
    r = compare(spark, duck(sf), sf, name, QUERIES[name], ORACLES[name])
    assert r["ok"], r


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_stages_on_planted_cases(spark, tmp_path):
    item = words("bench", 30)
    line = "A line of the licence that very many documents hold word for word."
    rows = [(i, words(f"d{i}w", 60) + ("\n" + line if i < 12 else ""), "en", f"s{i % 3}", 1, "x") for i in range(300)]
    rows += [(400, rows[50][1], "en", "s0", 1, "x"),                                             # exact copy
             (401, rows[51][1].replace("d51w30", "other"), "en", "s0", 1, "x"),                  # near copy
             (402, words("pre", 40) + " " + item + " " + words("post", 40), "en", "s1", 1, "x"),  # benchmark passage
             (403, None, None, None, None, None), (404, "", "en", "s0", 0, "x"), (405, " ", "en", "s0", 0, "x"), (406, "!!", "en", "s0", 0, "x")]
    toxic = [(1000 + i, words(f"t{i}a", 20) + " " + " ".join(f"vile{j}z" for j in range(4)) + " " + words(f"t{i}b", 20), "en", "s2", 1, "x")
             for i in range(120)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    spark.createDataFrame(rows + toxic, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(r[0], 0) for r in rows if r[0] < 300] + [(r[0], 1) for r in toxic]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = {r[0] for r in rows}
    kept = set(seen["toxicity"])
    assert {403, 404, 405, 406} <= kept
    assert len(kept & clean) >= 0.98 * len(clean) and len(kept - clean) <= 0.05 * len(toxic)
    held = [i for i in range(12) if i in kept]
    with_line = [i for i in held if line in (seen["line dedup"][i]["text"] or "")]
    assert with_line == held[-1:]
    near = set(seen["near dedup"])
    assert not near & {400, 401} and {50, 51} & kept <= near
    assert set(seen["decontamination"]) == near - {402}
    assert set(seen["packing"]) == set(seen["decontamination"])
    assert 403 in seen["packing"] and 404 in seen["packing"]


def test_pipeline_of_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
