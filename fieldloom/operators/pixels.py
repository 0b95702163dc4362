"""Pixel operators on numpy arrays (height x width x 3, uint8), for use inside Python workers.

Binary PGM and PPM files are decoded here; other formats need PIL. Nothing here needs OpenCV.
"""

from __future__ import annotations

import io
import re

import numpy as np


def decode(raw: bytes) -> np.ndarray:
    """RGB pixels of a file; raises ValueError with the reason."""
    if m := re.match(rb"P([56])\s+(?:#[^\n]*\n)?(\d+)\s+(\d+)\s+255\s", raw):
        depth = 3 if m[1] == b"6" else 1
        width, height = int(m[2]), int(m[3])
        pixels = np.frombuffer(raw, np.uint8, width * height * depth, m.end()).reshape(height, width, depth)
        return np.repeat(pixels, 3, 2) if depth == 1 else pixels
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("this format needs PIL") from None
    return np.asarray(Image.open(io.BytesIO(raw)).convert("RGB"))


def encode(rgb: np.ndarray) -> bytes:
    """A binary PPM file."""
    return b"P6 %d %d 255\n" % (rgb.shape[1], rgb.shape[0]) + np.ascontiguousarray(rgb, np.uint8).tobytes()


def lightness(rgb: np.ndarray) -> np.ndarray:
    """CIE L* of sRGB pixels, scaled to 0..255."""
    c = rgb / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    y = linear @ np.array([0.2126, 0.7152, 0.0722])
    return np.where(y > 216 / 24389, 116 * np.cbrt(y) - 16, y * 24389 / 27) * 2.55


def with_lightness(rgb: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The pixels with another lightness: each pixel's linear light is scaled, so hue stays."""
    star = np.clip(new, 0, 255) / 2.55
    want = np.where(star > 8, ((star + 16) / 116) ** 3, star * 27 / 24389)
    c = rgb / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    have = linear @ np.array([0.2126, 0.7152, 0.0722])
    scaled = np.clip(np.where(have[..., None] > 0, linear * (want / np.maximum(have, 1e-9))[..., None], want[..., None]), 0, 1)
    srgb = np.where(scaled <= 0.0031308, scaled * 12.92, 1.055 * scaled ** (1 / 2.4) - 0.055)
    return np.round(srgb * 255).astype(np.uint8)


def stretch(rgb: np.ndarray, low: float = 1.0, high: float = 99.0) -> tuple[np.ndarray, float, float]:
    """Lightness between two percentiles stretched to the whole range; the percentiles. A flat image stays as it is."""
    light = lightness(rgb)
    a, b = np.percentile(light, [low, high])
    return (with_lightness(rgb, (light - a) * 255 / (b - a)) if b > a else rgb.copy()), float(a), float(b)


def clipping(before: np.ndarray, after: np.ndarray, edge: float = 0.5) -> dict[str, float]:
    """Mean lightness before and after, and the shares of pixels at either end."""
    a, b = lightness(before), lightness(after)
    return {"original_brightness_mean": float(a.mean()), "final_brightness_mean": float(b.mean()), "final_l_clip_low_ratio": float((b <= edge).mean()), "final_l_clip_high_ratio": float((b >= 255 - edge).mean())}


def adaptive_equalize(rgb: np.ndarray, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation of lightness: a table for each tile, blended between tile centres. Dark images get twice the limit."""
    light = lightness(rgb)
    limit = 4.0 if light.mean() < 90 else 2.0
    h, w = light.shape
    rows, cols = np.minimum(np.arange(h) * tiles // h, tiles - 1), np.minimum(np.arange(w) * tiles // w, tiles - 1)
    level = np.clip(light, 0, 255).astype(np.int64)
    tile = rows[:, None] * tiles + cols[None, :]
    counts = np.bincount((tile * 256 + level).ravel(), minlength=tiles * tiles * 256).reshape(-1, 256).astype(float)
    size = np.maximum(counts.sum(1, keepdims=True), 1)
    cap = np.maximum(limit * size / 256, 1)
    cut = np.minimum(counts, cap)
    cut += (counts.sum(1, keepdims=True) - cut.sum(1, keepdims=True)) / 256
    table = np.cumsum(cut, 1) / size * 255

    def blend(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) * tiles / n - 0.5
        lo = np.clip(np.floor(at), 0, tiles - 1).astype(int)
        return lo, np.clip(lo + 1, 0, tiles - 1), np.clip(at - lo, 0, 1)

    (r0, r1, fr), (c0, c1, fc) = blend(h), blend(w)
    look = lambda r, c: table[r[:, None] * tiles + c[None, :], level]
    top = look(r0, c0) * (1 - fc) + look(r0, c1) * fc
    bottom = look(r1, c0) * (1 - fc) + look(r1, c1) * fc
    return with_lightness(rgb, top * (1 - fr[:, None]) + bottom * fr[:, None])


def corners(points: np.ndarray) -> np.ndarray:
    """Four points as top left, top right, bottom right, bottom left: the extremes along the two diagonals."""
    p = np.asarray(points, float)
    down, up = p @ np.array([1.0, 1.0]), p @ np.array([1.0, -1.0])
    return p[[down.argmin(), up.argmax(), down.argmax(), up.argmin()]]


def crossing(a: tuple[float, float], b: tuple[float, float], least_angle: float = 0.17) -> np.ndarray | None:
    """Where two lines in (rho, theta) form meet; None if they are close to parallel."""
    (ra, ta), (rb, tb) = a, b
    turn = np.sin(tb - ta)
    if abs(turn) < least_angle:
        return None
    return np.array([ra * np.sin(tb) - rb * np.sin(ta), rb * np.cos(ta) - ra * np.cos(tb)]) / turn


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3x3 matrix that takes four points to four others."""
    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    return np.append(np.linalg.solve(np.array(rows, float), np.asarray(target, float).ravel()), 1).reshape(3, 3)


def unwarp(rgb: np.ndarray, quad: np.ndarray, least: int = 20) -> np.ndarray:
    """The quadrilateral as an upright rectangle with its longer sides' lengths, by bilinear look-up; one too small leaves the image alone."""
    q = corners(quad)
    side = np.linalg.norm(np.roll(q, -1, 0) - q, axis=1)
    width, height = int(max(side[0], side[2])), int(max(side[1], side[3]))
    if min(width, height) < least:
        return rgb
    back = homography(np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]]), q)
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    u, v, s = np.tensordot(back, np.stack([x, y, np.ones_like(x)]).astype(float), 1)
    u, v = np.clip(u / s, 0, rgb.shape[1] - 1), np.clip(v / s, 0, rgb.shape[0] - 1)
    u0, v0 = np.minimum(u.astype(int), rgb.shape[1] - 2 if rgb.shape[1] > 1 else 0), np.minimum(v.astype(int), rgb.shape[0] - 2 if rgb.shape[0] > 1 else 0)
    fu, fv = (u - u0)[..., None], (v - v0)[..., None]
    u1, v1 = np.minimum(u0 + 1, rgb.shape[1] - 1), np.minimum(v0 + 1, rgb.shape[0] - 1)
    out = (rgb[v0, u0] * (1 - fu) + rgb[v0, u1] * fu) * (1 - fv) + (rgb[v1, u0] * (1 - fu) + rgb[v1, u1] * fu) * fv
    return np.round(out).astype(np.uint8)


def describe(raw: bytes) -> dict:
    """format, mode, width and height; raises like decode."""
    height, width = decode(raw).shape[:2]
    if m := re.match(rb"P([56])", raw):
        return {"format": "PPM", "mode": "RGB" if m[1] == b"6" else "L", "width": width, "height": height}
    from PIL import Image

    image = Image.open(io.BytesIO(raw))
    return {"format": image.format, "mode": image.mode, "width": width, "height": height}


def document_quad(rgb: np.ndarray, least_area: float = 0.05, aspect: tuple[float, float] = (1.2, 1.9)) -> np.ndarray | None:
    """The corners of a document that stands out from its ground by lightness, or None.

    Lightness is parted in two by the cut with the most variance between its sides; the side that the image's border has less of is
    the document. Its extremes along the two diagonals are the corners, if they hold area enough in a card's proportions, mostly filled.
    """
    light = np.clip(lightness(rgb), 0, 255).astype(np.uint8)
    n = np.bincount(light.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = total / below - (total[-1] - total) / (below[-1] - below)
    cut = int(np.nan_to_num(below * (below[-1] - below) * gap**2).argmax())
    mask = light > cut
    border = np.concatenate([mask[0], mask[-1], mask[:, 0], mask[:, -1]])
    if border.mean() > 0.5:
        mask = ~mask
    y, x = np.nonzero(mask)
    if not len(x):
        return None
    q = corners(np.stack([x, y], 1))
    area = abs(np.dot(q[:, 0], np.roll(q[:, 1], -1)) - np.dot(q[:, 1], np.roll(q[:, 0], -1))) / 2
    side = np.linalg.norm(np.roll(q, -1, 0) - q, axis=1)
    long_side, short_side = max(side[0], side[2]), max(side[1], side[3])
    ratio = max(long_side, short_side) / max(1.0, min(long_side, short_side))
    if area < least_area * mask.size or not aspect[0] <= ratio <= aspect[1] or len(x) < 0.8 * area:
        return None
    return q


def straighten(rgb: np.ndarray) -> np.ndarray:
    """The document upright, where one is found; else the image as it is."""
    quad = document_quad(rgb)
    return rgb if quad is None else unwarp(rgb, quad)


def largest_center(boxes: list[tuple[float, float, float, float]]) -> tuple[float, float] | None:
    """The centre of the largest of boxes (x, y, width, height)."""
    if not boxes:
        return None
    x, y, w, h = max(boxes, key=lambda b: b[2] * b[3])
    return x + w / 2, y + h / 2


def shrink(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest-neighbour resampling to a size."""
    rows, cols = (np.arange(height) + 0.5) * rgb.shape[0] / height, (np.arange(width) + 0.5) * rgb.shape[1] / width
    return rgb[rows.astype(int)[:, None], cols.astype(int)[None, :]]
