import numpy as np
import pytest
from pyspark.sql import functions as F

from robustlake.functions import pixels as X
from robustlake.functions.kernels import CHAINS, KERNELS, apply, attacked, attempted, blurred, canonical, capability, equalised, homography, kernel_of, resampled, smoothed, warped


@pytest.mark.parametrize("name", [*KERNELS, *CHAINS, "combined_physical"])
def test_kernels_keep_shape_and_range(name):
    batch = np.random.default_rng(1).integers(0, 256, (5, 16, 16)).astype(float)
    out = apply(name, batch, 0.5, np.arange(5))
    assert out.shape == batch.shape and out.min() >= 0 and out.max() <= 255
    assert (out == apply(name, batch, 0.5, np.arange(5))).all()
    assert (apply(name, batch[2:3], 0.5, np.arange(2, 3)) == out[2:3]).all()  # the batch does not matter


def test_kernels_at_rest():
    batch = np.random.default_rng(2).integers(0, 256, (3, 8, 8)).astype(float)
    for name in ("identity", "rotation", "resized_crop", "erasing", "brightness", "contrast", "gaussian_blur", "gaussian_noise", "homography", "illumination", "moire", "halftone", "paper", "tone"):
        assert (apply(name, batch, 0.0, np.arange(3)) == batch).all(), name
    flat = np.full((1, 8, 8), 90.0)
    assert np.abs(apply("jpeg", flat, 0.0, np.arange(1)) - flat).max() <= 2 and (apply("resize", flat, 1.0, np.arange(1)) == flat).all()
    with pytest.raises(KeyError):
        apply("nothing", batch, 0.5, np.arange(3))


def test_names_are_found_in_any_case_and_say_that_they_take_batches():
    assert kernel_of("JPEG") is KERNELS["jpeg"] and capability("Jpeg")["supported"] and capability("combined_physical")["supported"]
    with pytest.raises(KeyError):
        capability("nothing")


def test_cubic_resampling():
    ramp = np.tile(np.arange(12.0), (12, 1))[None]
    assert np.abs(resampled(ramp, 12, 12) - ramp).max() < 1e-9
    assert np.abs(resampled(ramp, 6, 6)[0, 3, 2:4] - [4.5, 6.5]).max() < 1e-9
    assert (resampled(np.full((1, 4, 6), 7.0), 9, 5).round(9) == 7).all()


def test_rotation_is_black_outside_and_blur_has_the_radius_as_deviation():
    white = np.full((1, 16, 16), 255.0)
    out = apply("rotation", white, 1.0, np.arange(1))[0]
    assert out[0, 0] == out[-1, -1] == 0 and out[8, 8] == 255
    point = np.zeros((1, 41, 41))
    point[0, 20, 20] = 1
    spread = blurred(point, 3.0)[0]
    variance = (spread * (np.arange(41) - 20)[:, None] ** 2).sum()
    assert abs(variance - 9) < 0.3 and abs(spread.sum() - 1) < 1e-9


def test_homography_and_its_inverse():
    h = homography(32, 12, 7, 5)
    assert np.abs(h @ [16, 16, 1] / (h @ [16, 16, 1])[2] - [16, 16, 1]).max() < 1e-9  # the middle stays
    y, x = np.mgrid[0:32, 0:32]
    smooth = (128 + 60 * np.sin(x / 6) + 40 * np.cos(y / 7))[None]
    back = warped(warped(smooth, h), np.linalg.inv(h))
    assert np.abs(back - smooth)[0, 8:24, 8:24].max() < 1.5 and np.abs(warped(smooth, h) - smooth).max() > 20


def test_chains_grow_with_their_strength():
    y, x = np.mgrid[0:32, 0:32]
    batch = np.repeat((128 + 60 * np.sin(x / 6) + 40 * np.cos(y / 7))[None], 6, axis=0)
    for name in CHAINS:
        gaps = [np.abs(apply(name, batch, s, np.arange(6)) - batch).mean() for s in (0.0, 0.5, 1.0)]
        assert 0 < gaps[0] < gaps[1] and gaps[2] > gaps[0], (name, gaps)


def test_attacked_column(spark):
    df = spark.createDataFrame([(1, [10] * 64), (2, None), (3, [200] * 64)], "id long, px array<int>")
    got = {r.id: r.x for r in df.select("id", attacked(F.col("px"), "brightness", 0.5, F.col("id")).alias("x")).collect()}
    assert got == {1: [15] * 64, 2: None, 3: [255] * 64}


def test_errors_become_data(spark):
    df = spark.createDataFrame([(1, [10] * 64), (2, None), (3, [200] * 63), (4, [20] * 64)], "id long, px array<int>").coalesce(1)
    got = {r.id: r.x for r in df.select("id", attempted(F.col("px"), "brightness", 0.5, F.col("id")).alias("x")).collect()}
    assert got[1].ok and got[1].px == [15] * 64 and got[4].px == [30] * 64 and "ValueError" in got[1].fallback
    assert not got[3].ok and got[3].error.startswith("ValueError") and not got[2].ok and got[2].px is None
    whole = df.where("id in (1, 4)").select(attempted(F.col("px"), "brightness", 0.5, F.col("id")).alias("x")).collect()
    assert all(r.x.ok and r.x.fallback is None and r.x.error is None for r in whole)


def test_canonical_images(spark):
    ramp = [x % 30 * 8 for x in range(30 * 20)]
    df = spark.createDataFrame([(1, ramp, 30, 20), (2, [5] * 400, 20, 20), (3, None, 3, 3), (4, [1], 2, 2)], "id long, px array<int>, w int, h int")
    got = {r.id: r.c for r in df.select("id", canonical(F.col("px"), F.col("w"), F.col("h"), 40).alias("c")).collect()}
    assert got[1].resized == [60, 40] and got[1].box == [10, 0, 50, 40] and len(got[1].px) == 1600
    assert set(got[2].px) == {5} and got[3] is None and got[4] is None
    # the literal of the blueprint: 300 x 200 covers 512 as 768 x 512, cut at 128
    one = spark.createDataFrame([([7] * 60000, 300, 200)], "px array<int>, w int, h int").select(canonical(F.col("px"), F.col("w"), F.col("h")).alias("c")).first().c
    assert one.resized == [768, 512] and one.box == [128, 0, 640, 512]


def test_haar_bits_survive_their_own_tile(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.integers(60, 190, 64).tolist(), "".join(rng.choice(["0", "1"], 16))) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, px array<int>, bits string")
    sent = df.select("bits", "px", X.haar_embed(F.col("px"), F.col("bits"), 18.0).alias("out"))
    for r in sent.select("bits", "px", "out", X.haar_extract(F.col("out"), 16, 18.0).alias("got")).collect():
        assert r.got == r.bits and max(abs(a - b) for a, b in zip(r.px, r.out)) <= 28


def test_haar_reads_its_block_once():
    """Columns are expressions: a block that stands in one k times is computed k times."""
    assert str(X.haar_embed(F.col("block"), F.col("bits"), 18.0)).count("block") == 1
    assert str(X.haar_extract(F.col("block"), 16, 18.0)).count("block") == 1


def test_combined_physical_prints_before_it_shows():
    batch, seeds = np.random.default_rng(3).integers(0, 256, (4, 16, 16)).astype(float), np.arange(4)
    for strength, printed, shown in ((0.3, 0.3, 0.0), (0.8, 0.5, 0.3)):
        first = apply("print_camera", batch, printed, seeds * 100)
        assert (apply("combined_physical", batch, strength, seeds) == apply("screen_shoot", first, shown, seeds * 100 + 1)).all()


def test_smoothing_keeps_edges_and_takes_grain():
    rng = np.random.default_rng(7)
    edge = np.where(np.arange(24) < 12, 40.0, 200.0) + np.zeros((1, 24, 24))
    out = smoothed(edge + rng.normal(0, 2, edge.shape), 2, 30.0)
    assert np.abs(out - edge).max() < 4 and np.abs(out - edge).mean() < 1.2
    assert (smoothed(np.full((2, 8, 8), 9.0), 2, 30.0) == 9).all()


def test_equalised_tiles():
    # a limit that never acts: the curve of a tile is the cumulative share of its values
    image = np.random.default_rng(8).integers(0, 256, (64, 64)).astype(float)
    free = equalised(image, 256.0)
    corner = image[:8, :8]
    for y, x in ((0, 0), (3, 2)):  # closer to the corner than the middle of the first tile: its curve alone
        assert free[y, x] == np.rint((corner <= corner[y, x]).sum() * 255 / 64)
    # tiles of 256 pixels: at a limit of one pixel a value the histogram is nearly even, and values hardly move
    y, x = np.mgrid[0:128, 0:128]
    ramp = np.rint(60 + x / 2 + y / 4.0)
    assert np.abs(equalised(ramp, 1.0) - ramp).mean() < 15 < np.abs(equalised(ramp, 64.0) - ramp).mean()
    assert equalised(image[:13, :13], 2.0).shape == (13, 13) and np.ptp(equalised(np.full((16, 16), 77.0), 2.0)) == 0


def test_faded_film_narrows_the_range_and_clarity_widens_steps():
    y, x = np.mgrid[0:64, 0:64]
    batch = np.rint(128 + 50 * np.sin(x / 5) + 40 * np.cos(y / 6))[None]
    spans = [np.ptp(apply("cew_e3", batch, s, np.arange(1))) for s in (0.0, 0.5, 1.0)]
    assert np.ptp(batch) > spans[0] > spans[1] > spans[2]
    black = np.zeros((1, 16, 16))
    assert 0 < apply("cew_e3", black, 0.5, np.arange(1)).min() < apply("cew_e3", black, 1.0, np.arange(1)).min()
    # lights are pressed, so the spread of the whole may shrink; steps between neighbours grow with the strength
    steps = [np.abs(np.diff(z)).mean() for z in (batch, *(apply("cew_e4", batch, s, np.arange(1)) for s in (0.0, 0.5, 1.0)))]
    assert steps[0] < steps[1] < steps[2] < steps[3]
