"""Files written by hand are read back."""

import gzip
import struct

import numpy as np
import pytest

from tests.conftest import rows
from vicinage.sources import vectors as V


def got(df):
    return [(r[0], list(map(float, r[1]))) for r in sorted(df.collect())]


def test_fvecs(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "a.fvecs").write_bytes(b"".join(struct.pack("<i", 3) + r.tobytes() for r in x))
    assert got(V.read_fvecs(spark, str(tmp_path / "a.fvecs"))) == [(i, r.tolist()) for i, r in enumerate(x)]
    some = spark.createDataFrame([(2,)], "id long")
    assert got(V.read_fvecs(spark, str(tmp_path / "a.fvecs"), some)) == [(2, x[2].tolist())]
    (tmp_path / "b.fvecs").write_bytes(b"\3\0\0\0abc")
    with pytest.raises(Exception):
        V.read_fvecs(spark, str(tmp_path / "b.fvecs")).collect()


def test_raw_idx_npy(spark, tmp_path):
    x = np.arange(6, dtype=np.float64).reshape(2, 3)
    (tmp_path / "a.bin").write_bytes(x.tobytes())
    assert got(V.read_raw(spark, str(tmp_path / "a.bin"), 3, "f8")) == [(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])]
    (tmp_path / "many").mkdir()
    for k in (2, 0, 1):
        (tmp_path / "many" / f"{k}.bin").write_bytes(np.array([[k, 1 / 3]] * (k + 1)).tobytes())
    assert got(V.read_raw(spark, str(tmp_path / "many"), 2, "f8")) == [(0, [0.0, 1 / 3]), (1, [1.0, 1 / 3]), (2, [1.0, 1 / 3]), (3, [2.0, 1 / 3]), (4, [2.0, 1 / 3]), (5, [2.0, 1 / 3])]
    (tmp_path / "a.gz").write_bytes(gzip.compress(struct.pack(">4i", 2051, 2, 1, 2) + bytes([1, 2, 3, 4])))
    assert got(V.read_idx(spark, str(tmp_path / "a.gz"))) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    np.save(tmp_path / "a.npy", x)
    assert len(got(V.read_npy(spark, str(tmp_path / "a.npy"), 3))) == 2


def test_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text("2 2 2\n1 2\n3 4\n")
    assert [list(r[1]) for r in V.read_metric_text(spark, str(tmp_path / "m.txt")).collect()] == [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "w.txt").write_text("9 2 6\nabc\nabd\n")
    assert [r["word"] for r in V.read_metric_text(spark, str(tmp_path / "w.txt")).collect()] == ["abc", "abd"]
    (tmp_path / "q.txt").write_text("2\n5\n7\n")
    assert rows(V.read_query_ids(spark, str(tmp_path / "q.txt"))) == [(5,), (7,)]
    (tmp_path / "u.txt").write_text("3\n0 4\n1 2\n2 9\n")
    assert [tuple(r)[1:] for r in V.read_update_log(spark, str(tmp_path / "u.txt")).orderBy("seq").collect()] == [("insert", 4), ("delete", 2), ("query", 9)]
    (tmp_path / "c.csv").write_text("1,2\n3,4\n")
    assert sorted(list(r[1]) for r in V.read_csv(spark, str(tmp_path / "c.csv")).collect()) == [[1.0, 2.0], [3.0, 4.0]]


def test_pair_sink(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2), (0, 5)], "i long, j long")
    V.write_pairs(pairs, str(tmp_path / "p"), 10)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [(0, 5, 5), (1, 2, 12)]
    with pytest.raises(Exception):
        V.write_pairs(pairs, str(tmp_path / "p"))
