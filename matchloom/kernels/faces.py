"""Detection, alignment and extraction of faces around pluggable detectors and embedders.

Detectors and embedders are callables registered in jobs.DETECTORS and jobs.EMBEDDERS. None comes with this library:
they need image decoders and model files. What is arithmetic (picking, rescaling, alignment, the contract of
extraction) is here and is tested with stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import augment
from matchloom.kernels import jobs


@dataclass(frozen=True)
class Detection:
    box: tuple[int, int, int, int]
    score: float
    landmarks: np.ndarray | None = None

    @property
    def area(self) -> int:
        return self.box[2] * self.box[3]


def decode(content: bytes) -> np.ndarray | None:
    """A gray image, or null if it can't be read. Needs an image library; without one this raises ImportError."""
    try:
        from io import BytesIO

        from PIL import Image
    except ImportError as e:
        raise ImportError("decoding images needs an image library, which isn't installed here") from e
    try:
        return np.asarray(Image.open(BytesIO(content)).convert("L"))
    except OSError:
        return None


def rescaled(d: Detection, factor: float) -> Detection:
    """A detection on a shrunk image in pixels of the original."""
    marks = None if d.landmarks is None else d.landmarks / factor
    return Detection(tuple(int(round(v / factor)) for v in d.box), d.score, marks)


def pick(found: list[Detection], by: str = "area") -> Detection | None:
    """The largest face, or the one with the best score; the first on ties."""
    return max(found, key=lambda d: getattr(d, by), default=None)


def eye_pair(eyes: list[tuple[int, int, int, int]], height: int) -> tuple | None:
    """Of boxes of eyes the widest pair whose centres are at most a quarter of the height apart vertically, left first."""
    centre = lambda b: (b[0] + b[2] / 2, b[1] + b[3] / 2)
    pairs = [(a, b) for i, a in enumerate(eyes) for b in eyes[i + 1 :] if abs(centre(a)[1] - centre(b)[1]) <= 0.25 * height and a[0] != b[0]]
    best = max(pairs, key=lambda p: abs(centre(p[0])[0] - centre(p[1])[0]), default=None)
    return None if best is None else tuple(sorted(map(centre, best)))


def levelled(t: np.ndarray, left: tuple[float, float], right: tuple[float, float]) -> np.ndarray:
    """The tile turned so that the eyes lie on one line."""
    a = np.arctan2(right[1] - left[1], right[0] - left[0])
    c, (cos, sin) = (np.array(t.shape[::-1]) - 1) / 2, (np.cos(a), np.sin(a))
    turn = np.array([[cos, sin], [-sin, cos]])
    return warped(t, np.column_stack((turn, c - turn @ c)), t.shape[0])


def similarity(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 2 x 3 matrix of rotation, scale and shift that fits points best in least squares (Umeyama 1991)."""
    ms, md = src.mean(0), dst.mean(0)
    a, b = src - ms, dst - md
    u, s, vt = np.linalg.svd(b.T @ a)
    flip = np.diag([1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    scale = (s * np.diag(flip)).sum() / max((a**2).sum(), 1e-12)
    turn = scale * u @ flip @ vt
    return np.column_stack((turn, md - turn @ ms))


def warped(t: np.ndarray, matrix: np.ndarray, side: int) -> np.ndarray:
    """The image through a 2 x 3 matrix onto a square, nearest pixels, black outside."""
    full = np.linalg.inv(np.vstack((matrix, [0, 0, 1])))
    yy, xx = np.mgrid[0:side, 0:side]
    x, y = [full[i, 0] * xx + full[i, 1] * yy + full[i, 2] for i in (0, 1)]
    xi, yi = np.rint(x).astype(int), np.rint(y).astype(int)
    inside = (xi >= 0) & (yi >= 0) & (xi < t.shape[1]) & (yi < t.shape[0])
    return np.where(inside, t[np.clip(yi, 0, t.shape[0] - 1), np.clip(xi, 0, t.shape[1] - 1)], 0).astype(np.uint8)


def equalized(t: np.ndarray) -> np.ndarray:
    """Gray values by their share of pixels up to them."""
    counts = np.bincount(t.ravel(), minlength=256)
    first = counts[np.flatnonzero(counts)[0]] if t.size else 0
    return t if t.size == first else np.clip(np.rint((counts.cumsum() - first) * 255.0 / (t.size - first)), 0, 255).astype(np.uint8)[t]


def extract(image: np.ndarray | None, detect: Callable, side: int = 100, least: int = 32, longest: int = 640, prepare: Callable = equalized) -> dict:
    """face (or null) and reason: unreadable, image_too_small, no_face or ok. The whole image never stands in for a face."""
    if image is None:
        return {"face": None, "reason": "unreadable"}
    h, w = image.shape
    if h < least or w < least:
        return {"face": None, "reason": "image_too_small"}
    small = image[:: max(1, -(-max(h, w) // longest)), :: max(1, -(-max(h, w) // longest))]
    found = pick([rescaled(d, small.shape[0] / h) for d in detect(small)])
    if found is None:
        return {"face": None, "reason": "no_face"}
    x, y = max(0, min(w - 1, found.box[0])), max(0, min(h - 1, found.box[1]))
    cut = image[y : y + max(1, min(h - y, found.box[3])), x : x + max(1, min(w - x, found.box[2]))]
    ys, xs = [(np.arange(side) * n // side) for n in cut.shape]
    return {"face": prepare(cut[ys][:, xs]).tobytes(), "reason": "ok"}


def extracted(images: DataFrame, detector: str, side: int = 100) -> DataFrame:
    """path, face, reason for rows of images(path, content); each partition looks its detector up once."""
    detect = jobs.registered(jobs.DETECTORS, detector)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"path": p, **extract(decode(c), detect, side)} for p, c in zip(b["path"], b["content"])], columns=["path", "face", "reason"])

    return images.select("path", "content").mapInPandas(run, "path string, face binary, reason string")


def embedded(faces: DataFrame, embedder: str) -> DataFrame:
    """path, embedding of rows of faces(path, face): the embedder takes a list of byte strings and gives a matrix."""
    embed = jobs.registered(jobs.EMBEDDERS, embedder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["face"].notna()]
            if len(b):
                yield pd.DataFrame({"path": b["path"].tolist(), "embedding": [row.tolist() for row in np.asarray(embed(b["face"].tolist()), np.float64)]})

    return faces.select("path", "face").mapInPandas(run, "path string, embedding array<double>")


def augment_missing(tiles: DataFrame, done: DataFrame, strength: str, side: int = 8) -> DataFrame:
    """path, tile of random variants for rows of tiles(path, tile) that `done` lacks; seeds come from the path."""
    left = tiles.join(done.select("path"), "path", "left_anti")
    return left.select("path", augment.augmented(F.col("tile"), side, F.crc32(F.col("path").cast("binary")), strength).alias("tile"))
