"""Filter interaction audit: adders, odd rows against SQL, empty tables."""

import duckdb
import numpy as np

from lexgraph.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string, mask int, word string"
LABELS = "doc_id long, quality int, toxic int, part string"


def test_positional_counts_equal_bit_sums():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 7, 100, 4097):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert fa.positional_counts(words).tolist() == [int(((words >> b) & 1).sum()) for b in range(32)]
        times = rng.integers(1, 300, n)
        assert fa.positional_counts(words, times).tolist() == [int((times * ((words >> b) & 1)).sum()) for b in range(32)]


def both(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/l")
    got = fa.audit(spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/l"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM read_parquet('{tmp_path}/l/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({fa.SQL})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, None, "en"), (2, "", None), (3, "", ""), (4, long, "en"), (5, long, "en"), (5, long, "de"), (6, "A#B", "en"),
            (None, long, "en"), (None, long, None), (7, "x " * 70_000, "fr"), (8, "ÄÄ  y", "fr"), (9, long.upper(), "de"),
            (10, "\x0b\x0c w\n", "de"), (11, long + " a|b", "en")]
    labels = [(4, 1, 0), (4, 0, 0), (5, None, 1), (6, 0, 1), (7, 1, None), (None, 1, 1), (99, 1, 1)]
    got, want = both(spark, tmp_path, [(*d, 1, "extra") for d in docs], [(*x, "extra") for x in labels])
    assert got == want and len(got) == 600 * 4


def test_nothing(spark, tmp_path):
    got, want = both(spark, tmp_path, [], [])
    assert got == want == []
