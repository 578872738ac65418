"""Detectors over decoded images (numpy arrays): run them in Arrow functions over whatever decoder is installed."""

from __future__ import annotations

import numpy as np


def otsu_threshold(gray: np.ndarray) -> int:
    """The grey level that parts the histogram with the largest variance between classes."""
    counts = np.bincount(gray.astype(np.uint8).ravel(), minlength=256).astype(float)
    weight, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    rest = weight[-1] - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        between = weight * rest * (mass / weight - (mass[-1] - mass) / rest) ** 2
    return int(np.nanargmax(np.where((weight > 0) & (rest > 0), between, -1)))


def local_mean_threshold(gray: np.ndarray, block: int = 31, c: float = 10) -> np.ndarray:
    """True where a pixel is darker than its block's mean less c; sums of a padded integral image."""
    r = block // 2
    padded = np.pad(gray.astype(float), r, mode="edge")
    total = np.pad(padded.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n, m = gray.shape
    s = total[block : block + n, block : block + m] - total[:n, block : block + m] - total[block : block + n, :m] + total[:n, :m]
    return gray < s / block**2 - c


def ink_fraction(gray: np.ndarray) -> float:
    """Share of pixels below the mean."""
    return float((gray < gray.mean()).mean()) if gray.size else 0.0


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of four-connected components, 0 outside: the least label spreads along rows and columns until nothing moves."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        up = labels.copy()
        for axis in (0, 1):
            for step in (1, -1):
                other = np.roll(up, step, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0 if step == 1 else -1
                other[tuple(edge)] = 0
                up = np.where(mask & (other > 0), np.minimum(up, other), up)
        if np.array_equal(up, labels):
            return labels
        labels = up


def obscured(rgb: np.ndarray) -> bool:
    """A region that is largely covered: strong colours above 20 %, dark above 8 %, one component above a quarter."""
    top, low = rgb.max(2).astype(float), rgb.min(2).astype(float)
    strong = np.divide(top - low, top, out=np.zeros_like(top), where=top > 0) > 0.4
    dark = top < 60
    found = np.bincount(components(strong | dark).ravel())[1:]
    return bool(strong.mean() > 0.2 and dark.mean() > 0.08 and found.size and found.max() > 0.25 * top.size)


def raster_profile(images: list[np.ndarray]) -> tuple[int, int, float]:
    """(page-sized images, small ones, largest share of dark pixels)."""
    full = sum(i.shape[0] >= 1000 and i.shape[1] >= 1000 for i in images)
    small = sum(96 <= min(i.shape[:2]) and max(i.shape[:2]) <= 800 for i in images)
    return full, small, max((float((i < 220).mean()) for i in images), default=0.0)


def legibility(words: list[float], ink: float) -> str:
    """illegible or none, from word confidences and ink: enough ink, and no words or mostly doubtful ones."""
    low = sum(w < 50 for w in words) / len(words) if words else 1.0
    mean = sum(words) / len(words) if words else 0.0
    return "illegible" if ink >= 0.05 and (not words or (mean <= 55 and low >= 0.35)) else "none"
