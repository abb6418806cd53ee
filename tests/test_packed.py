"""Packed vectors, the generating data source and the SQL functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomvec.functions.packed import decode, encode, is_packed, pack, unpack
from loomvec.functions.vectors import drawn, drawn_array, to_precision
from loomvec.operators.assign import assign, validate
from loomvec.operators.kernel import matrix
from loomvec.operators.kmeans import KMeans, kmeans
from loomvec.plans.sql import register
from loomvec.sources.points import first_k, gaussian_points, points, read_gaussian

POINTS = "batch_id int, point_id long, x array<double>"


@pytest.mark.parametrize("kind", ["half", "bfloat"])
def test_codec_rounds_as_the_format(kind):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.standard_normal((200, 6)) * 10.0 ** rng.integers(-6, 4, (200, 6)), [[0.0, -0.0, np.inf, -np.inf, 1.0, 2.0**-20]]])
    rows = encode(x, kind)
    assert rows.shape == (201, 13) and (decode(rows) == to_precision(x, kind)).all()
    assert np.isnan(decode(encode(np.array([[np.nan]]), kind))).all() and np.isinf(decode(encode(np.array([[1e39]]), kind))).all()
    assert decode(np.zeros((0, 5), np.uint8)).shape == (0, 2)
    with pytest.raises(ValueError, match="one format"):
        decode(np.vstack([encode(x[:1], "half"), encode(x[:1], "bfloat")]))
    column = pa.array([r.tobytes() for r in rows], pa.binary())
    assert (matrix(column.slice(3, 50), 6) == to_precision(x[3:53], kind)).all()
    for bad in (column.slice(0, 2).to_pylist() + [None], column.slice(0, 2).to_pylist() + [b"h12"]):
        with pytest.raises(ValueError, match="not of length 6"):
            matrix(pa.array(bad, pa.binary()), 6)


@pytest.mark.parametrize("kind", ["half", "bfloat"])
def test_packed_points_give_the_same_labels_from_a_quarter_of_the_bytes(spark, tmp_path, kind):
    pts = gaussian_points(spark, 2, 600, 32, 3)
    short = pack(pts, kind)
    assert short.columns == pts.columns and is_packed(short, "x") and not is_packed(pts, "x")
    for name, df in (("long", pts), ("short", short)):
        df.coalesce(1).write.parquet(str(tmp_path / name), compression="none")
    size = {n: sum(f.stat().st_size for f in (tmp_path / n).glob("*.parquet")) for n in ("long", "short")}
    assert size["short"] < 0.3 * size["long"]
    read = points(spark.read.parquet(str(tmp_path / "short")), "point_id", "x", "batch_id")
    start = first_k(pts, 5)
    for bounds in (False, True):
        one, two = kmeans(pts, 5, 4, init=start, precision=kind), kmeans(read, 5, 4, init=first_k(read, 5), precision=kind, bounds=bounds)
        labels = [sorted(map(tuple, r.labels.collect())) for r in (one, two)]
        assert labels[0] == labels[1]
    assert sorted(map(tuple, KMeans(5, 2, precision=kind).fit(read, start).predict(read).collect())) == sorted(map(tuple, KMeans(5, 2, precision=kind).fit(pts, start).predict(pts).collect()))
    back = {(r.batch_id, r.point_id): r.x for r in unpack(read).collect()}
    assert all(back[r.batch_id, r.point_id] == to_precision(np.array(r.x), kind).tolist() for r in pts.collect())


def test_broken_packed_points_are_refused(spark):
    good = pack(spark.createDataFrame([(0, 0, [1.0, 2.0])], POINTS), "half")
    start = spark.createDataFrame([(0, 0, [0.0, 0.0])], "batch_id int, k int, c array<double>")
    for bad in (None, bytearray(b"h1"), bytearray(b"")):
        both = good.unionByName(spark.createDataFrame([(0, 1, bad)], good.schema))
        with pytest.raises(ValueError, match="not of length 2"):
            validate(both, 2)
        with pytest.raises(ValueError, match="not of length 2"):
            kmeans(both, 1, 1, init=start)
    assert assign(good, start).first().cluster_id == 0 and pack(spark.createDataFrame([], POINTS), "half").count() == 0
    with pytest.raises(Exception, match="a vector is null"):
        pack(spark.createDataFrame([(0, 0, None)], POINTS), "half").collect()


def test_generated_table_does_not_depend_on_its_partitions(spark):
    want = {(r.batch_id, r.point_id): r.x for r in gaussian_points(spark, 2, 700, 5, 9).collect()}
    for parts in (1, 7):
        table = read_gaussian(spark, batches=2, rows=700, dims=5, seed=9, partitions=parts)
        got = {(r.batch_id, r.point_id): r.x for r in table.collect()}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-13, atol=1e-13) for k in want)
    ids = np.arange(1000)
    assert drawn_array(4, ids, ids * 3).tolist() == [r[0] for r in spark.range(0, 1000, 1, 1).select(drawn(4, F.col("id"), F.col("id") * 3)).collect()]
    assert read_gaussian(spark, rows=0, dims=2).count() == 0


def test_sql_functions(spark):
    register(register(spark))
    row = spark.sql("SELECT vector_dot(array(1D, 2D), array(3D, 4D)) d, squared_norm(array(3D, 4D)) n, squared_distance(array(0D, 0D), array(3D, 4D)) e, "
                    "nearest_centroid(array(1D), array(named_struct('k', 1, 'c', array(2D)), named_struct('k', 0, 'c', array(0D)), named_struct('k', 2, 'c', array(9D)))) k").first()  # fmt: skip
    assert tuple(row) == (11.0, 25.0, 25.0, 0)  # a tie goes to the lower number
