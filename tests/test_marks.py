import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from robustlake.functions import marks as M
from robustlake.functions import pixels as X


def scenes(n, side, seed=1):
    """Smooth images with some grain, away from black and white."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:side, 0:side]
    waves = [128 + 35 * np.sin(x / rng.uniform(3, 9) + rng.uniform(0, 6)) + 25 * np.cos(y / rng.uniform(3, 9)) for _ in range(n)]
    return np.clip(np.rint(np.stack(waves) + rng.normal(0, 4, (n, side, side))), 40, 215)


@pytest.mark.parametrize("name, side, count", [("dwtDctSvd", 64, 32), ("dwt_dct_svd", 70, 56), ("spread-dct", 64, 56), ("SPREAD_DCT", 61, 49)])
def test_bits_come_back(name, side, count):
    batch, bits = scenes(12, side), np.random.default_rng(2).integers(0, 2, (12, count)).astype(float)
    out = M.hide(name, batch, bits)
    assert out.shape == batch.shape and out.min() >= 0 and out.max() <= 255 and (out == np.rint(out)).all()
    assert (M.read(name, out, count) == bits).all() and (M.read(name, batch, count) != bits).any()
    assert 0 < np.abs(out - batch).mean() < 12


def test_the_largest_coefficient_keeps_most_bits_and_votes_help():
    batch = scenes(30, 64)
    right = []
    for count in (64, 4):
        bits = np.random.default_rng(4).integers(0, 2, (30, count)).astype(float)
        right.append((M.read("dwtDct", M.hide("dwtDct", batch, bits), count) == bits).mean())
    assert right[0] > 0.7 and right[1] >= right[0] and right[1] > 0.9, right


def test_low_band_and_tiles():
    batch = np.arange(2 * 36.0).reshape(2, 6, 6)
    assert M.low_band(batch)[0, 0, 0] == (0 + 1 + 6 + 7) / 2 and M.low_band(batch).shape == (2, 3, 3)
    assert (M.untiled(M.tiled(batch, 4) * 2, batch)[:, :4, :4] == batch[:, :4, :4] * 2).all() and (M.untiled(M.tiled(batch, 4) * 2, batch)[:, 4:] == batch[:, 4:]).all()
    c = M.cosine(4)
    assert np.abs(c @ c.T - np.eye(4)).max() < 1e-12


def test_names_and_capacity():
    assert M.mark_of("DWT-DCT") is M.mark_of("dwtDct")
    with pytest.raises(KeyError):
        M.mark_of("nothing")
    with pytest.raises(ValueError):
        M.register("dwt_dct", M.mark_of("dwtDct"))
    with pytest.raises(ValueError):
        M.hide("spread-dct", scenes(1, 16), np.ones((1, 5)))
    with pytest.raises(ValueError):
        M.read("spread-dct", scenes(1, 16), 5)
    assert (M.hide("spread-dct", scenes(1, 16), np.ones((1, 0))) == scenes(1, 16)).all() and M.read("dwtDct", scenes(3, 16), 0).shape == (3, 0)


def test_columns_with_nulls_and_texts_of_any_length(spark):
    a, b = (x.astype(int).ravel().tolist() for x in scenes(2, 16))
    df = spark.createDataFrame([(1, a, "1010"), (2, None, "1"), (3, b, None), (4, b, "01"), (5, a, "")], "id int, px array<int>, bits string").coalesce(1)
    out = df.select("id", "px", "bits", M.marked(F.col("px"), F.col("bits"), "spread-dct", 16).alias("out"))
    got = {r.id: r for r in out.select("id", "px", "out", M.unmarked(F.col("out"), 4, "spread-dct", 16).alias("read")).collect()}
    assert got[1].read == "1010" and got[4].read == "0101" and got[2].out is None and got[3].read is None and got[5].out == a


def test_a_block_in_the_jvm_equals_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(0, 256, 64).tolist(), int(rng.integers(0, 2))) for k in range(30)]
    df = spark.createDataFrame(rows, "id int, px array<int>, bit int")
    for r in df.select("px", "bit", X.spread_embed(F.col("px"), F.col("bit")).alias("out"), X.spread_extract(F.col("px")).alias("read")).collect():
        block = np.array(r.px, float).reshape(1, 1, 8, 8)
        exact = M._hide_spread(block, np.array([[r.bit]], float)).ravel()
        assert np.abs(np.clip(np.floor(exact), 0, 255) - r.out).max() == 0 and r.read == int(M._read_spread(block)[0, 0])


def test_similarity_and_information(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 4, 64)
    rows = [(a.tolist(), a.tolist()), (a.tolist(), (3 - a).tolist()), ([7] * 64, [9] * 64), (a.tolist(), [9] * 64), (a.tolist(), rng.permutation(a).tolist())]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>").coalesce(1)
    got = df.select(X.nmi(F.col("a"), F.col("b")).alias("nmi"), X.ms_ssim(F.col("a"), F.col("b")).alias("ms"), X.entropy(F.col("a")).alias("h"), X.pooled(F.col("a"), 8).alias("half")).collect()
    assert [round(r.nmi, 9) for r in got[:4]] == [1, 1, 1, 0] and 0 <= got[4].nmi < 0.4
    assert abs(got[0].ms - 1) < 1e-9 and got[4].ms < 1
    shares = np.bincount(a) / 64
    assert math.isclose(got[0].h, -sum(p * math.log2(p) for p in shares if p)) and got[2].h == 0
    assert np.allclose(got[0].half, a.reshape(4, 2, 4, 2).mean(axis=(1, 3)).ravel())
