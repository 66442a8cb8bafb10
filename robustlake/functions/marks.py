"""Marks hidden in grey images, as Arrow-vectorised UDFs behind one registry.

A mark hides bits (n, k) in a float batch (n, side, side) and reads k bits of
each image again. Both work on tiles; bits take turns over the tiles, and what
is read is the mean of a bit's tiles. ``marked`` and ``unmarked`` apply a mark
to a column: Spark deals the rows, numpy does the arithmetic of one Arrow batch.

Defined results: a null image or null bits give null, an image of another size
or more bits than tiles fail with the reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the step of the quantised coefficients.
STEP = 36.0
#: Fixed value: how far apart a bit keeps two coefficients.
GAP = 18.0


@dataclass(frozen=True)
class Mark:
    """hide(tiles, bits) -> tiles and read(tiles) -> 0..1, on (n, tiles, edge, edge); ``low``: on the low Haar band of the image."""

    edge: int
    low: bool
    hide: Callable[[np.ndarray, np.ndarray], np.ndarray]
    read: Callable[[np.ndarray], np.ndarray]


MARKS: dict[str, Mark] = {}


def register(name: str, mark: Mark) -> Mark:
    """Under a name in any spelling of case, hyphens and underscores; a name is given once."""
    key = plain(name)
    if key in MARKS:
        raise ValueError(f"two marks named {name}")
    MARKS[key] = mark
    return mark


def plain(name: str) -> str:
    return name.lower().replace("-", "").replace("_", "")


def mark_of(name: str) -> Mark:
    found = MARKS.get(plain(name))
    if found is None:
        raise KeyError(f"no mark named {name}")
    return found


def cosine(edge: int) -> np.ndarray:
    """The orthonormal cosine transform of this many points."""
    k, x = np.mgrid[0:edge, 0:edge]
    return np.sqrt(np.where(k == 0, 1, 2) / edge) * np.cos((2 * x + 1) * k * np.pi / (2 * edge))


def tiled(plane: np.ndarray, edge: int) -> np.ndarray:
    """(n, tiles, edge, edge), row by row; what is left over at the right and below is in no tile."""
    down, across = plane.shape[1] // edge, plane.shape[2] // edge
    cut = plane[:, : down * edge, : across * edge].reshape(len(plane), down, edge, across, edge)
    return cut.swapaxes(2, 3).reshape(len(plane), down * across, edge, edge)


def untiled(tiles: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """``plane`` with these tiles in it."""
    edge, out = tiles.shape[-1], plane.copy()
    down, across = plane.shape[1] // edge, plane.shape[2] // edge
    whole = tiles.reshape(len(plane), down, across, edge, edge).swapaxes(2, 3)
    out[:, : down * edge, : across * edge] = whole.reshape(len(plane), down * edge, across * edge)
    return out


def low_band(batch: np.ndarray) -> np.ndarray:
    """The low band of the Haar transform: half the sum of each 2 x 2 tile."""
    return tiled(batch, 2).sum(axis=(2, 3)).reshape(len(batch), batch.shape[1] // 2, batch.shape[2] // 2) / 2


def stepped(size: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """A quarter or three quarters into the step that a size stands in."""
    return (size // STEP + 0.25 + 0.5 * bits) * STEP


def _peaks(tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients of the tiles, flat; where the largest besides the first stands; its value."""
    c = cosine(tiles.shape[-1])
    flat = (c @ tiles @ c.T).reshape(*tiles.shape[:2], -1)
    at = np.abs(flat[..., 1:]).argmax(axis=-1)[..., None] + 1
    return flat, at, np.take_along_axis(flat, at, -1)[..., 0]


def _hide_peak(tiles: np.ndarray, bits: np.ndarray) -> np.ndarray:
    flat, at, value = _peaks(tiles)
    np.put_along_axis(flat, at, (np.where(value < 0, -1, 1) * stepped(np.abs(value), bits))[..., None], -1)
    c = cosine(tiles.shape[-1])
    return c.T @ flat.reshape(tiles.shape) @ c


def _read_peak(tiles: np.ndarray) -> np.ndarray:
    return (np.abs(_peaks(tiles)[2]) % STEP > STEP / 2).astype(float)


def _hide_singular(tiles: np.ndarray, bits: np.ndarray) -> np.ndarray:
    c = cosine(tiles.shape[-1])
    u, s, v = np.linalg.svd(c @ tiles @ c.T)
    s[..., 0] = stepped(s[..., 0], bits)
    return c.T @ ((u * s[..., None, :]) @ v) @ c


def _read_singular(tiles: np.ndarray) -> np.ndarray:
    # the transform is orthonormal, so singular values are those of the tiles
    return (np.linalg.svd(tiles, compute_uv=False)[..., 0] % STEP > STEP / 2).astype(float)


def _split(tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pattern of two mirrored coefficients of middle frequency, and how far each tile keeps them apart."""
    c = cosine(tiles.shape[-1])
    weights = np.outer(c[3], c[4]) - np.outer(c[4], c[3])
    return weights, (tiles * weights).sum(axis=(2, 3))


def _hide_spread(tiles: np.ndarray, bits: np.ndarray) -> np.ndarray:
    weights, apart = _split(tiles)
    return tiles + ((np.where(bits > 0, GAP, -GAP) - apart) / 2)[..., None, None] * weights


def _read_spread(tiles: np.ndarray) -> np.ndarray:
    return (_split(tiles)[1] > 0).astype(float)


register("dwtDct", Mark(4, True, _hide_peak, _read_peak))
register("dwtDctSvd", Mark(4, True, _hide_singular, _read_singular))
register("spread-dct", Mark(8, False, _hide_spread, _read_spread))


def hide(name: str, batch: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Images (n, side, side) with bits (n, k), as whole pixels 0..255."""
    mark = mark_of(name)
    plane = low_band(batch) if mark.low else batch
    tiles = tiled(plane, mark.edge)
    if bits.shape[1] > tiles.shape[1]:
        raise ValueError(f"{name}: {bits.shape[1]} bits, but {tiles.shape[1]} tiles")
    if not bits.shape[1]:
        return batch
    turn = bits[:, np.arange(tiles.shape[1]) % bits.shape[1]]
    moved = untiled(mark.hide(tiles, turn), plane) - plane
    if mark.low:  # a pixel takes half of what its tile of 2 x 2 moves by
        moved = np.pad(np.repeat(np.repeat(moved / 2, 2, axis=1), 2, axis=2), ((0, 0), (0, batch.shape[1] % 2), (0, batch.shape[2] % 2)))
    return np.clip(np.floor(batch + moved + 0.5), 0, 255)


def read(name: str, batch: np.ndarray, count: int) -> np.ndarray:
    """(n, count) bits."""
    mark = mark_of(name)
    votes = mark.read(tiled(low_band(batch) if mark.low else batch, mark.edge))
    if count > votes.shape[1]:
        raise ValueError(f"{name}: {count} bits, but {votes.shape[1]} tiles")
    return np.stack([votes[:, k::count].mean(axis=1) > 0.5 for k in range(count)], axis=1) if count else np.zeros((len(batch), 0), bool)


def marked(pixels: Column, bits: Column, name: str, side: int = 8) -> Column:
    """Pixels that hide the bits of each row, a text of 0 and 1."""
    mark_of(name)

    @F.arrow_udf("array<int>")
    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for images, texts in batches:
            out: list[list[int] | None] = [None] * len(images)
            groups: dict[int, list[int]] = {}  # images of equally many bits are done at once
            rows, said = images.to_pylist(), texts.to_pylist()
            for k, (row, text) in enumerate(zip(rows, said)):
                if row is not None and text is not None:
                    groups.setdefault(len(text), []).append(k)
            for n, own in groups.items():
                batch = np.array([rows[k] for k in own], float).reshape(len(own), side, side)
                wanted = np.array([[c == "1" for c in said[k]] for k in own], float).reshape(len(own), n)
                done = hide(name, batch, wanted).astype(np.int32).reshape(len(own), -1)
                for k, px in zip(own, done.tolist()):
                    out[k] = px
            yield pa.array(out, pa.list_(pa.int32()))

    return work(pixels, bits)


def unmarked(pixels: Column, count: int, name: str, side: int = 8) -> Column:
    """The bits that an image holds, as a text of 0 and 1."""
    mark_of(name)

    @F.arrow_udf("string")
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for images in batches:
            there = images.is_valid().to_numpy(zero_copy_only=False)
            batch = images.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(there.sum()), side, side)
            texts = iter("".join("01"[int(b)] for b in row) for row in read(name, batch, count))
            yield pa.array([next(texts) if t else None for t in there], pa.string())

    return work(pixels)
