"""Perturbation kernels on grey images as Arrow-vectorised UDFs, behind one registry.

An image is an array of side * side pixels 0..255, row by row. A kernel takes a
float batch (n, side, side), relative strengths in [0, 1] and seeds, and gives a
batch of the same shape. ``attacked`` applies a kernel, or a chain of them, to a
column: Spark deals the rows, numpy does the arithmetic of one Arrow batch.
``attempted`` does the same and turns errors into data.

Steps that only move colours (saturation, tint, colour temperature, phases of
the colour channels) leave a grey image as it is and are not here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray, float, np.ndarray], np.ndarray]

#: The parameter at strength 0 and at strength 1.
RANGES = {
    "rotation": (0.0, 45.0),
    "resized_crop": (1.0, 0.5),
    "erasing": (0.0, 0.25),
    "brightness": (1.0, 2.0),
    "contrast": (1.0, 2.0),
    "gaussian_blur": (0.0, 20.0),
    "gaussian_noise": (0.0, 0.1),
    "jpeg": (90.0, 10.0),
}
#: Parameters of the physical chains at strengths 0, 0.5 and 1.
SCREEN = {
    "yaw": (5, 12, 22), "pitch": (3, 7, 13), "roll": (2, 5, 8), "distance": (0.96, 0.84, 0.70), "dfocus": (0.35, 0.65, 0.95), "illum": (0.060, 0.120, 0.180),
    "glare": (0.00, 0.025, 0.070), "moire": (0.080, 0.240, 0.340), "moire_period": (11, 8, 6), "noise": (0.014, 0.032, 0.040), "jpeg": (90, 78, 72),
    "gamma": (1.015, 1.035, 1.06), "brightness": (1.01, 1.02, 1.03), "contrast": (1.03, 1.05, 1.08),
}
PRINT = {
    "yaw": (5, 12, 16), "pitch": (3, 7, 9), "roll": (2, 4, 5), "distance": (0.94, 0.84, 0.78), "dfocus": (0.45, 1.30, 1.25), "illum": (0.070, 0.130, 0.140),
    "glare": (0.020, 0.060, 0.050), "halftone_cell": (3, 6, 6), "paper": (0.010, 0.020, 0.020), "cmyk": (0.40, 1.05, 1.02), "noise": (0.015, 0.030, 0.030),
    "jpeg": (88, 78, 78), "gamma": (1.020, 1.060, 1.065), "brightness": (1.01, 1.03, 1.030), "contrast": (1.035, 1.080, 1.085),
}
#: Parameters of the edits at strengths 0, 0.5 and 1, as far as they touch grey.
EDITS = {
    "cew_e1": {"exposure_ev": (0.10, 0.25, 0.40), "contrast": (0.04, 0.08, 0.12), "sharpen": (0.4, 0.8, 1.2)},
    "cew_e2": {"contrast": (0.04, 0.08, 0.12), "tone_curve": (0.05, 0.10, 0.18)},
    "cew_e3": {"contrast": (-0.03, -0.06, -0.10), "black_lift": (0.01, 0.03, 0.06), "local_contrast": (-0.02, -0.05, -0.08)},
    "cew_e4": {"local_contrast": (0.08, 0.20, 0.35), "tone_strength": (0.20, 0.50, 0.78), "sharpen": (0.5, 1.0, 1.5), "shadow_lift": (0.03, 0.08, 0.12)},
}
#: Fixed value: the ordered screen of 4 x 4 dots, in sixteenths.
BAYER = np.array([[0, 8, 2, 10], [12, 4, 14, 6], [3, 11, 1, 9], [15, 7, 13, 5]]) / 16
#: Fixed value: the luminance table of baseline JPEG.
LUMINANCE = np.array(
    [
        [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
        [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
    ]
)

KERNELS: dict[str, Kernel] = {}


def kernel(name: str) -> Callable[[Kernel], Kernel]:
    def keep(function: Kernel) -> Kernel:
        KERNELS[name] = function
        return function

    return keep


def parameter(name: str, strength: float) -> float:
    low, high = RANGES[name]
    return low + (high - low) * min(1.0, max(0.0, strength))


def cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    """Keys' cubic kernel."""
    x = np.abs(x)
    near, far = ((a + 2) * x - (a + 3)) * x * x + 1, ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def sampled(batch: np.ndarray, y: np.ndarray, x: np.ndarray, border: str = "nearest", a: float = -0.5) -> np.ndarray:
    """Cubic values at (y, x) of each image. Outside: the nearest pixel, a mirror image, or black."""
    side = batch.shape[1]
    y, x = np.broadcast_to(y, batch.shape), np.broadcast_to(x, batch.shape)
    top, left = np.floor(y).astype(int), np.floor(x).astype(int)
    rows, out = np.arange(len(batch))[:, None, None], np.zeros(batch.shape)

    def inside(at: np.ndarray) -> np.ndarray:
        if border == "mirror":
            at = np.mod(at, 2 * side)
            return np.minimum(at, 2 * side - 1 - at)
        return np.clip(at, 0, side - 1)

    for i in range(-1, 3):
        for j in range(-1, 3):
            weight = cubic(y - (top + i), a) * cubic(x - (left + j), a)
            out += weight * batch[rows, inside(top + i), inside(left + j)]
    if border == "black":
        out = np.where((y > -0.5) & (y < side - 0.5) & (x > -0.5) & (x < side - 0.5), out, 0.0)
    return out


@lru_cache(maxsize=256)
def resampling(source: int, target: int, a: float = -0.5) -> np.ndarray:
    """(target, source) weights of cubic resampling; going down, the kernel is as wide as a target pixel."""
    scale = source / target
    reach = max(1.0, scale)
    centre = (np.arange(target) + 0.5) * scale
    weights = cubic((np.arange(source) + 0.5 - centre[:, None]) / reach, a)
    return weights / weights.sum(axis=1, keepdims=True)


def resampled(batch: np.ndarray, height: int, width: int) -> np.ndarray:
    """Cubic resize of images (n, h, w)."""
    return resampling(batch.shape[1], height) @ batch @ resampling(batch.shape[2], width).T


def preset(table: dict[str, tuple], strength: float) -> dict[str, float]:
    """Parameters at a strength: linear between those of 0, 0.5 and 1."""
    at = min(1.0, max(0.0, strength))
    return {name: float(np.interp(at, (0, 0.5, 1), values)) for name, values in table.items()}


def grid(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    side = batch.shape[1]
    y, x = np.mgrid[0:side, 0:side].astype(float)
    return np.broadcast_to(y, batch.shape), np.broadcast_to(x, batch.shape)


def draws(seeds: np.ndarray, count: int) -> np.ndarray:
    """(n, count) uniform numbers, by each image's own seed."""
    return np.stack([np.random.default_rng(int(s)).random(count) for s in seeds]) if len(seeds) else np.zeros((0, count))


@kernel("identity")
def identity(batch, strength, seeds):
    return batch


@kernel("rotation")
def rotation(batch, strength, seeds):
    angle, middle = np.deg2rad(parameter("rotation", strength)), (batch.shape[1] - 1) / 2
    y, x = grid(batch)
    y, x = y - middle, x - middle
    # turned against the clock; what comes from outside is black
    return sampled(batch, middle + y * np.cos(angle) + x * np.sin(angle), middle - y * np.sin(angle) + x * np.cos(angle), "black", a=-1.0)


@kernel("resized_crop")
def resized_crop(batch, strength, seeds):
    """A random box of the kept area, stretched back to the whole."""
    side = batch.shape[1]
    part = np.sqrt(parameter("resized_crop", strength)) * (side - 1)
    at = draws(seeds, 2) * (side - 1 - part)
    y, x = grid(batch)
    return sampled(batch, at[:, 0, None, None] + y * part / (side - 1), at[:, 1, None, None] + x * part / (side - 1))


@kernel("erasing")
def erasing(batch, strength, seeds):
    side = batch.shape[1]
    edge = int(round(side * np.sqrt(parameter("erasing", strength))))
    at = np.floor(draws(seeds, 2) * (side - edge + 1))
    y, x = grid(batch)
    top, left = at[:, 0, None, None], at[:, 1, None, None]
    return np.where((y >= top) & (y < top + edge) & (x >= left) & (x < left + edge), 0.0, batch)


@kernel("brightness")
def brightness(batch, strength, seeds):
    return batch * parameter("brightness", strength)


@kernel("contrast")
def contrast(batch, strength, seeds):
    grey = np.floor(batch.mean(axis=(1, 2), keepdims=True) + 0.5)
    return grey + (batch - grey) * parameter("contrast", strength)


def blurred(batch: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur; behind the edge stands the last pixel."""
    if sigma <= 0:
        return batch
    side, reach = batch.shape[1], int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    rows = np.zeros((side, side))
    for k, w in zip(range(-reach, reach + 1), weights / weights.sum()):
        np.add.at(rows, (np.arange(side), np.clip(np.arange(side) + k, 0, side - 1)), w)
    return rows @ batch @ rows.T


@kernel("gaussian_blur")
def gaussian_blur(batch, strength, seeds):
    """The radius is the standard deviation."""
    return blurred(batch, parameter("gaussian_blur", strength))


@kernel("gaussian_noise")
def gaussian_noise(batch, strength, seeds):
    noise = [np.random.default_rng(int(s)).normal(0, 255 * parameter("gaussian_noise", strength), batch.shape[1:]) for s in seeds]
    return batch + np.stack(noise) if len(seeds) else batch


def cosines() -> np.ndarray:
    k, x = np.mgrid[0:8, 0:8]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)


def compressed(batch: np.ndarray, quality: float) -> np.ndarray:
    """Quantised cosine blocks (sides must be multiples of 8)."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    table = np.clip(np.floor((LUMINANCE * scale + 50) / 100), 1, 255)
    n, side, _ = batch.shape
    tiles = (batch - 128).reshape(n, side // 8, 8, side // 8, 8).swapaxes(2, 3)
    c = cosines()
    kept = np.rint(c @ tiles @ c.T / table) * table
    return (c.T @ kept @ c).swapaxes(2, 3).reshape(n, side, side) + 128


@kernel("jpeg")
def jpeg(batch, strength, seeds):
    return compressed(batch, parameter("jpeg", strength))


@kernel("resize")
def resize(batch, strength, seeds):
    """To the scale that the strength names (0: 0.5) and back."""
    side = batch.shape[1]
    inner = max(1, int(side * (strength or 0.5)))
    return resampled(np.clip(np.rint(resampled(batch, inner, inner)), 0, 255), side, side)


# --- blocks of the physical chains ---


def homography(side: int, yaw: float, pitch: float, roll: float, focal: float = 1.2) -> np.ndarray:
    """Where a camera turned by these degrees sees the plane of an image: 3 x 3, pixels to pixels."""
    turns = []
    for angle, (i, j) in ((roll, (0, 1)), (yaw, (2, 0)), (pitch, (1, 2))):
        c, s = np.cos(np.deg2rad(angle)), np.sin(np.deg2rad(angle))
        turn = np.eye(3)
        turn[[i, j, i, j], [i, j, j, i]] = c, c, -s, s
        turns.append(turn)
    rotated = turns[0] @ turns[1] @ turns[2]
    f, half = focal * side, side / 2
    # a plane point (x, y, 0) about the middle, projected with focal length f from distance f
    project = np.array([[f, 0, 0], [0, f, 0], [0, 0, 1]]) @ np.column_stack((rotated[:, 0], rotated[:, 1], [0, 0, f]))
    shift = np.array([[1, 0, half], [0, 1, half], [0, 0, 1]])
    return shift @ project @ np.linalg.inv(shift)


def warped(batch: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Images moved by a homography; outside is a mirror image."""
    side = batch.shape[1]
    y, x = np.mgrid[0:side, 0:side].astype(float)
    u, v, w = np.tensordot(np.linalg.inv(h), np.stack((x, y, np.ones_like(x))), 1)
    return sampled(batch, v / w, u / w, "mirror", a=-0.75)


def field(rng: np.random.Generator, points: int, side: int) -> np.ndarray:
    """A smooth random field in [0, 1]."""
    rough = resampled(rng.normal(0, 1, (1, points, points)), side, side)[0]
    return (rough - rough.min()) / (np.ptp(rough) + 1e-6)


def each(batch: np.ndarray, seeds: np.ndarray, work: Callable[[np.ndarray, np.random.Generator], np.ndarray]) -> np.ndarray:
    """``work`` on every image with the generator of its own seed."""
    return np.stack([work(x, np.random.default_rng(int(s))) for x, s in zip(batch, seeds)]) if len(batch) else batch


def lit(batch: np.ndarray, amount: float, glare: float, seeds: np.ndarray) -> np.ndarray:
    """An uneven light, and a bright spot."""
    side = batch.shape[1]
    y, x = np.mgrid[0:side, 0:side]

    def one(image, rng):
        image = image * (1 + amount * (2 * field(rng, 4, side) - 1))
        at = rng.uniform(0.2, 0.8, 2) * side
        return image + 120 * glare * np.exp(-((y - at[0]) ** 2 + (x - at[1]) ** 2) / (2 * (0.18 * side) ** 2))

    return np.clip(each(batch, seeds, one), 0, 255) if amount > 0 or glare > 0 else batch


def rippled(batch: np.ndarray, intensity: float, period: float, degrees: float, seeds: np.ndarray) -> np.ndarray:
    """Two gratings of nearly equal pitch, strongest in patches."""
    side = batch.shape[1]
    y, x = np.mgrid[0:side, 0:side]

    def one(image, rng):
        patches = 0.08 + 0.92 * field(rng, 3, side) ** 2
        waves = np.zeros((side, side))
        for k in range(2):
            angle = np.deg2rad(degrees + rng.uniform(-8, 8) + 1.5 * k)
            pitch = 2 * np.pi / max(2.0, period) * (1 + 0.03 * k + rng.uniform(-0.01, 0.01))
            waves += np.sin(pitch * (x * np.cos(angle) + y * np.sin(angle)) + rng.uniform(0, 0.5))
        return image * (1 + intensity * patches * waves / 2)

    return np.clip(each(batch, seeds, one), 0, 255) if intensity > 0 else batch


def noisy(batch: np.ndarray, sigma: float, seeds: np.ndarray) -> np.ndarray:
    return np.clip(each(batch, seeds, lambda image, rng: image + rng.normal(0, 255 * sigma, image.shape)), 0, 255) if sigma > 0 else batch


def toned(batch: np.ndarray, gamma: float = 1.0, brightness: float = 1.0, contrast: float = 1.0) -> np.ndarray:
    """What gain control does to grey: gamma, contrast about the middle, brightness."""
    x = np.clip(batch / 255, 0, 1) ** max(0.05, gamma)
    return np.clip(np.clip((x - 0.5) * contrast + 0.5, 0, 1) * brightness, 0, 1) * 255


def odd(size: float) -> int:
    return max(1, int(round(size)) | 1)


def screened(batch: np.ndarray, cell: float) -> np.ndarray:
    """Ordered dots that run together, mixed in by the size of their cell."""
    if cell <= 1:
        return batch
    side, width = batch.shape[1], odd(cell)
    dots = np.where(batch / 255 > np.tile(BAYER, (side // 4 + 1, side // 4 + 1))[:side, :side], 255.0, 0.0)
    dots = blurred(dots, 0.3 * ((width - 1) * 0.5 - 1) + 0.8) * 0.97
    share = min(0.30, 0.06 + 0.045 * cell)
    return np.clip(batch * (1 - share) + dots * share, 0, 255)


def papered(batch: np.ndarray, amount: float, seeds: np.ndarray) -> np.ndarray:
    """The grain of paper."""
    grain = lambda image, rng: image + blurred(rng.normal(0, 255 * amount, (1, *image.shape)), 0.8)[0]
    return np.clip(each(batch, seeds, grain), 0, 255) if amount > 0 else batch


def captured(batch: np.ndarray, p: dict[str, float], seeds: np.ndarray, scale: float) -> np.ndarray:
    """What a camera adds: defocus (more at an angle), noise, gain control, compression."""
    angle = 1 + max(abs(p["yaw"]), abs(p["pitch"])) / 30
    batch = blurred(batch, p["dfocus"] * angle * scale)
    batch = noisy(batch, p["noise"] * scale, seeds + 3)
    return compressed(toned(batch, p["gamma"], p["brightness"], p["contrast"]), p["jpeg"])


@kernel("homography")
def perspective(batch, strength, seeds):
    p = preset(SCREEN, strength)
    return warped(batch, homography(batch.shape[1], p["yaw"] * strength, p["pitch"] * strength, p["roll"] * strength))


@kernel("illumination")
def illumination(batch, strength, seeds):
    return lit(batch, strength * 0.18, strength * 0.07, seeds)


@kernel("moire")
def moire(batch, strength, seeds):
    return rippled(batch, strength * 0.34, 8, 5, seeds)


@kernel("halftone")
def halftone(batch, strength, seeds):
    return screened(batch, 1 + 5 * strength)


@kernel("paper")
def paper(batch, strength, seeds):
    return papered(batch, 0.02 * strength, seeds)


@kernel("tone")
def tone(batch, strength, seeds):
    return toned(batch, 1 + 0.06 * strength, 1 + 0.03 * strength, 1 + 0.08 * strength)


def screen_shoot(batch, strength, seeds):
    """Perspective, light, moire (finer from afar), camera, and the perspective put right again."""
    p = preset(SCREEN, strength)
    h = homography(batch.shape[1], p["yaw"], p["pitch"], p["roll"])
    batch = lit(warped(batch, h), p["illum"], p["glare"], seeds)
    batch = rippled(batch, p["moire"], p["moire_period"] / max(0.3, p["distance"]), p["roll"], seeds + 1)
    return warped(captured(batch, p, seeds, 1.0), np.linalg.inv(h))


def print_camera(batch, strength, seeds, distance: float | None = None):
    """Ink (a narrower range, dots, paper), perspective, light, camera (all stronger from near), and the perspective put right again."""
    p = preset(PRINT, strength)
    scale = float(np.clip(p["distance"] / max(0.3, distance or p["distance"]), 0.65, 1.6))
    h = homography(batch.shape[1], p["yaw"], p["pitch"], p["roll"])
    batch = papered(screened(toned(batch, brightness=1 + 0.03 * p["cmyk"]), p["halftone_cell"]), p["paper"], seeds + 2)
    batch = lit(warped(batch, h), p["illum"] * scale, p["glare"] * scale, seeds)
    return warped(captured(batch, p, seeds, scale), np.linalg.inv(h))


# --- edits ---


def sharpened(batch: np.ndarray, radius: float, amount: float, threshold: float) -> np.ndarray:
    """Unsharp mask: differences from the blurred image above a threshold, added."""
    gap = batch - blurred(batch, radius)
    return np.where(np.abs(gap) > threshold, batch + gap * amount, batch)


def stretched(batch: np.ndarray, cut: float = 0.01) -> np.ndarray:
    """The whole range of grey for all but a share of the pixels at each end."""
    low, high = (np.quantile(batch, q, axis=(1, 2), keepdims=True, method=m) for q, m in ((cut, "lower"), (1 - cut, "higher")))
    return np.where(high > low, (batch - low) * 255 / np.maximum(high - low, 1e-9), batch)


def contrasted(batch: np.ndarray, factor: float) -> np.ndarray:
    grey = np.floor(batch.mean(axis=(1, 2), keepdims=True) + 0.5)
    return grey + (batch - grey) * factor


@kernel("cew_e1")
def auto_tone(batch, strength, seeds):
    p = preset(EDITS["cew_e1"], strength)
    batch = np.clip(np.clip(stretched(batch), 0, 255) * 2 ** p["exposure_ev"], 0, 255)
    return sharpened(np.clip(contrasted(batch, 1 + p["contrast"]), 0, 255), 1.0, p["sharpen"], 2)


@kernel("cew_e2")
def warm_vivid(batch, strength, seeds):
    p = preset(EDITS["cew_e2"], strength)
    x = np.clip(contrasted(batch, 1 + p["contrast"]), 0, 255) / 255
    return 255 * (x + p["tone_curve"] * (x - 0.5) * (1 - np.abs(2 * x - 1)))


def whole(batch: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(batch), 0, 255)


def smoothed(batch: np.ndarray, reach: int, spread: float) -> np.ndarray:
    """Bilateral filter over a disc; three equal channels add to the distance of two values."""
    side = batch.shape[1]
    wide = np.pad(batch, ((0, 0), (reach, reach), (reach, reach)), mode="reflect")
    total, weight = np.zeros(batch.shape), np.zeros(batch.shape)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            if dy * dy + dx * dx > reach * reach:
                continue
            near = wide[:, reach + dy : reach + dy + side, reach + dx : reach + dx + side]
            share = np.exp(-(9 * (near - batch) ** 2 + dy * dy + dx * dx) / (2 * spread * spread))
            total, weight = total + share * near, weight + share
    return total / weight


def equalised(image: np.ndarray, limit: float, tiles: int = 8) -> np.ndarray:
    """Adaptive histogram equalisation of one image: a curve for each of 8 x 8 tiles, its slope limited, mixed between tile middles."""
    side = image.shape[0]
    edge = -(-side // tiles)
    grey = np.pad(image.astype(int), (0, edge * tiles - side), mode="symmetric")
    tile, area, bins = np.arange(edge * tiles) // edge, edge * edge, np.arange(256)
    counts = np.bincount(((tile[:, None] * tiles + tile) * 256 + grey).ravel(), minlength=tiles * tiles * 256).reshape(-1, 256)
    cap = max(1, int(limit * area / 256))
    # what stands above the limit is dealt to all values, the rest of it to evenly placed ones
    over = np.maximum(counts - cap, 0).sum(axis=1)
    rest = (over % 256)[:, None]
    step = np.maximum(256 // np.maximum(rest, 1), 1)
    counts = np.minimum(counts, cap) + (over // 256)[:, None] + ((bins % step == 0) & (bins // step < rest))
    curves = np.clip(np.rint(counts.cumsum(axis=1) * 255 / area), 0, 255).reshape(tiles, tiles, 256)
    place = np.arange(side) / edge - 0.5
    first = np.floor(place).astype(int)
    share, out = place - first, np.zeros((side, side))
    for down, share_y in ((first, 1 - share), (first + 1, share)):
        for across, share_x in ((first, 1 - share), (first + 1, share)):
            own = curves[np.clip(down, 0, tiles - 1)[:, None], np.clip(across, 0, tiles - 1), grey[:side, :side]]
            out += share_y[:, None] * share_x * own
    return np.rint(out)


@kernel("cew_e3")
def faded_film(batch, strength, seeds):
    """Black is lifted and contrast taken away, a matte version mixed in, and the result smoothed between its edges."""
    p = preset(EDITS["cew_e3"], strength)
    fade = min(1.0, max(0.2, p["black_lift"] / 0.08))
    x = batch / 255
    faded = whole(255 * (0.5 + (1 + p["contrast"]) * (x + p["black_lift"] * fade * (1 - x) - 0.5)))
    matte = faded + (whole(0.86 * faded + 24) - faded) * 0.35 * (1 + fade)
    out = whole(batch + (whole(matte) - batch) * (0.45 + 0.4 * fade))
    return out + (whole(smoothed(out, 2, 30.0)) - out) * min(0.45, 3 * abs(p["local_contrast"]))


@kernel("cew_e4")
def clarity(batch, strength, seeds):
    """Shadows lifted, lights pressed, local contrast by equalised tiles, and sharpened."""
    p = preset(EDITS["cew_e4"], strength)
    tone, x = p["tone_strength"], batch / 255
    lifted = x + p["shadow_lift"] * tone * (1 - x) ** 3
    mapped = whole(255 * (lifted - (0.12 + 0.08 * tone) * tone * x**2 * np.maximum(lifted - 0.45, 0)))
    local = each(mapped, seeds, lambda image, rng: equalised(image, 1.2 + 2.4 * p["local_contrast"]))
    mixed = whole(mapped + (local - mapped) * (0.2 + 0.35 * p["local_contrast"]))
    return sharpened(whole(contrasted(mixed, 1 + 0.08 * tone)), 1.0, p["sharpen"], 2)


#: Chains of blocks, as one kernel each.
CHAINS: dict[str, Kernel] = {"screen_shoot": screen_shoot, "print_camera": print_camera}


def kernel_of(name: str) -> Kernel:
    """By name, in any case."""
    found = KERNELS.get(name.lower()) or CHAINS.get(name.lower())
    if found is None:
        raise KeyError(f"no kernel named {name}")
    return found


def capability(name: str) -> dict[str, object]:
    """Whether a kernel takes whole batches (all of these do), and who says so."""
    return {"name": name.lower(), "supported": name == "combined_physical" or kernel_of(name) is not None, "stage": "attack", "source": "declared"}


def apply(name: str, batch: np.ndarray, strength: float, seeds: np.ndarray) -> np.ndarray:
    """A kernel or chain; ``combined_physical`` prints first and spends what exceeds half its strength on the screen."""
    if name == "combined_physical":
        first = apply("print_camera", batch, min(strength, 0.5), seeds * 100)
        return apply("screen_shoot", first, max(0.0, strength - 0.5), seeds * 100 + 1)
    out = kernel_of(name)(batch, strength, seeds)
    if len(out) != len(batch):
        raise ValueError(f"{name} gave {len(out)} results for {len(batch)} images")
    return np.clip(np.floor(out + 0.5), 0, 255)


def attacked(pixels: Column, name: str, strength: float, seed: Column, side: int = 8) -> Column:
    """The pixels after an attack. Null images stay null; images of another size fail."""

    @F.arrow_udf("array<int>")
    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for images, seeds in batches:
            there = images.is_valid().to_numpy(zero_copy_only=False)
            flat = images.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
            batch = flat.reshape(int(there.sum()), side, side)
            done = apply(name, batch, strength, seeds.to_numpy(zero_copy_only=False)[there].astype(np.int64))
            counts = np.where(there, side * side, 0)
            out = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(done.astype(np.int32).ravel()))
            yield out if there.all() else pa.array([x if t else None for x, t in zip(out.to_pylist(), there)], pa.list_(pa.int32()))

    return work(pixels, seed)


def attempted(pixels: Column, name: str, strength: float, seed: Column, side: int = 8) -> Column:
    """struct<ok, error, fallback, px>: errors of a row become its data, and never fail the job.

    A batch that fails as a whole is done again image by image, with the reason in ``fallback``.
    """

    @F.arrow_udf("struct<ok:boolean,error:string,fallback:string,px:array<int>>")
    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for images, seeds in batches:
            rows, numbers = images.to_pylist(), seeds.to_pylist()
            reason, done = None, None
            try:
                batch = np.array(rows, float).reshape(len(rows), side, side)
                done = apply(name, batch, strength, np.array(numbers, np.int64)).astype(np.int32).reshape(len(rows), -1).tolist()
            except Exception as failure:  # the rows tell which of them it was
                reason = f"{type(failure).__name__}: {failure}"
            out = []
            for k, (row, number) in enumerate(zip(rows, numbers)):
                if done is not None:
                    out.append({"ok": True, "error": None, "fallback": None, "px": done[k]})
                    continue
                try:
                    one = apply(name, np.array(row, float).reshape(1, side, side), strength, np.array([number], np.int64))
                    out.append({"ok": True, "error": None, "fallback": reason, "px": one.astype(np.int32).ravel().tolist()})
                except Exception as failure:
                    out.append({"ok": False, "error": f"{type(failure).__name__}: {failure}", "fallback": reason, "px": None})
            kind = pa.struct([("ok", pa.bool_()), ("error", pa.string()), ("fallback", pa.string()), ("px", pa.list_(pa.int32()))])
            yield pa.array(out, kind)

    return work(pixels, seed)


def canonical(pixels: Column, width: Column, height: Column, target: int = 512) -> Column:
    """A grey image of any size as a square of ``target`` pixels: resized until it covers it, and cut from the middle.

    struct<px, resized array<int>, box array<int>>; null for an image without pixels.
    """

    @F.arrow_udf("struct<px:array<int>,resized:array<int>,box:array<int>>")
    def work(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("px", pa.list_(pa.int32())), ("resized", pa.list_(pa.int32())), ("box", pa.list_(pa.int32()))])
        for images, widths, heights in batches:
            out = []
            for px, w, h in zip(images.to_pylist(), widths.to_pylist(), heights.to_pylist()):
                if not px or not w or not h or len(px) != w * h:
                    out.append(None)
                    continue
                scale = max(target / w, target / h)
                w2, h2 = max(target, round(w * scale)), max(target, round(h * scale))
                left, top = (w2 - target) // 2, (h2 - target) // 2
                image = resampled(np.array(px, float).reshape(1, h, w), h2, w2)[0, top : top + target, left : left + target]
                whole = np.clip(np.floor(image + 0.5), 0, 255).astype(int).ravel().tolist()
                out.append({"px": whole, "resized": [w2, h2], "box": [left, top, left + target, top + target]})
            yield pa.array(out, kind)

    return work(pixels, width, height)
