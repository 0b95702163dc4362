"""Image stages and adapters for OCR engines.

Pixels live only inside Python workers: `binaryFile` rows go through mapInPandas, one engine per worker. Native libraries (PIL for formats
other than PPM and PGM, OCR engines) may be absent; then a file's row says so in `status` and `reason`, and the stage goes on.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pixels

# Columns of the stages' logs.
LOADED = "filename string, status string, reason string, height int, width int, channels int"
RESIZED = (
    "filename string, status string, reason string, original_width int, original_height int, original_long_side int, final_width int, final_height int, "
    "final_long_side int, downscaled boolean, very_low_res boolean"
)
CONTRASTED = (
    "filename string, status string, reason string, method string, low_percentile double, high_percentile double, stretch_low double, stretch_high double, "
    "original_brightness_mean double, final_brightness_mean double, final_l_clip_low_ratio double, final_l_clip_high_ratio double"
)
BLOCKS = "array<struct<text: string, bbox: array<array<double>>, confidence: double>>"
READ = f"filename string, status string, reason string, raw struct<full: string, blocks: {BLOCKS}>"

#: Builders of OCR engines by name: device -> (image bytes -> (full text, blocks or None)).
ENGINES: dict[str, Callable[[str], Callable[[bytes], tuple[str, list | None]]]] = {}


def register_engine(name: str, build: Callable[[str], Callable[[bytes], tuple[str, list | None]]]) -> None:
    ENGINES[name] = build


def build_engine(name: str, device: str = "cpu"):
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name}; known: {sorted(ENGINES)}")
    return ENGINES[name](device)


def tesseract(device: str):
    import pytesseract
    from PIL import Image

    return lambda raw: (pytesseract.image_to_string(Image.open(io.BytesIO(raw)), config="--oem 3 --psm 11"), None)


def easyocr(device: str):
    import easyocr as lib
    import numpy as np
    from PIL import Image

    reader = lib.Reader(["en"], gpu=device != "cpu")

    def read(raw: bytes) -> tuple[str, list]:
        found = reader.readtext(np.asarray(Image.open(io.BytesIO(raw)).convert("RGB")))
        blocks = [{"text": t, "bbox": [[float(x), float(y)] for x, y in box], "confidence": float(c)} for box, t, c in found if t.strip()]
        return "\n".join(b["text"] for b in ordered(blocks)), ordered(blocks)

    return read


def paddle(device: str):
    import numpy as np
    from paddleocr import PaddleOCR
    from PIL import Image

    reader = PaddleOCR(use_angle_cls=True, lang="en", use_gpu=device == "cuda", show_log=False)

    def read(raw: bytes) -> tuple[str, list]:
        pages = reader.ocr(np.asarray(Image.open(io.BytesIO(raw)).convert("RGB")), cls=True)
        lines = (pages[0] if pages else None) or []  # a page without text is None
        blocks = ordered([{"text": str(t).strip(), "bbox": [[float(x), float(y)] for x, y in box], "confidence": float(c)} for box, (t, c) in lines if str(t).strip()])
        return "\n".join(b["text"] for b in blocks), blocks

    return read


def sidecar(device: str):
    """No recognition: the file's content is the text, a block a line. For transcripts beside or instead of images."""

    def read(raw: bytes) -> tuple[str, list]:
        lines = [t for t in raw.decode("utf-8").splitlines() if t.strip()]
        box = lambda i, t: [[0.0, 12.0 * i], [6.0 * len(t), 12.0 * i], [6.0 * len(t), 12.0 * i + 10], [0.0, 12.0 * i + 10]]
        return "\n".join(lines), [{"text": t, "bbox": box(i, t), "confidence": 1.0} for i, t in enumerate(lines)]

    return read


def ordered(blocks: list[dict]) -> list[dict]:
    """By smallest y, then smallest x, stable."""
    return sorted(blocks, key=lambda b: (min(p[1] for p in b["bbox"]), min(p[0] for p in b["bbox"])))


register_engine("tesseract", tesseract)
register_engine("easyocr", easyocr)
register_engine("paddleocr", paddle)
register_engine("text", sidecar)


INVENTORY = "filename string, status string, reason string, bytes long, format string, mode string, width int, height int, is_valid boolean"


def inventory(files: DataFrame) -> DataFrame:
    """A row for each file: its bytes, format, mode and size, and whether it can be decoded."""

    def one(raw: bytes) -> dict:
        return pixels.describe(raw)

    out = _each(files, one, INVENTORY)
    sizes = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("bytes"))
    return out.drop("bytes").join(sizes, "filename").withColumn("is_valid", F.col("status") == "ok")


def changed(files: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """filename (with the suffix of what it now is) and content after a change of pixels, for sinks.write_files; files that fail are left out: the log has them."""

    def one(raw: bytes) -> dict:
        return {"content": pixels.encode(change(pixels.decode(raw)))}

    out = _each(files, one, "filename string, status string, reason string, content binary").filter("status = 'ok'")
    return out.select(F.concat(F.regexp_replace("filename", r"\.[^.]*$", ""), F.lit(".ppm")).alias("filename"), "content")


def resized(rgb: np.ndarray, cap: int = 1800) -> np.ndarray:
    """The pixels of the resize stage: never enlarged."""
    height, width = rgb.shape[:2]
    scale = min(1.0, cap / max(width, height))
    return rgb if scale == 1.0 else pixels.shrink(rgb, max(1, round(width * scale)), max(1, round(height * scale)))


def load_images(files: DataFrame) -> DataFrame:
    """files: binaryFile rows. status, reason and size of each; a file that can't be decoded fails alone."""

    def one(raw: bytes) -> dict:
        height, width, channels = pixels.decode(raw).shape
        return {"height": height, "width": width, "channels": channels}

    return _each(files, one, LOADED)


def _each(files: DataFrame, one: Callable[[bytes], dict], schema: str) -> DataFrame:
    """one(content) for each file as a row with status ok; a file that fails has its reason instead."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    whole = [c.strip().split(" ")[0] for c in schema.split(",") if c.strip().endswith(" int")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                row = {"filename": path.rsplit("/", 1)[-1], "status": "ok", "reason": ""}
                try:
                    row |= one(content)
                except Exception as e:  # the file's own row says why
                    row |= {"status": "failed", "reason": f"{type(e).__name__}: {e}"}
                rows.append(row)
            yield pd.DataFrame(rows, columns=names, dtype=object).astype({c: "Int32" for c in whole})

    return files.select("path", "content").mapInPandas(run, schema)


def resize_images(files: DataFrame, cap: int = 1800, low: int = 300) -> DataFrame:
    """The resize stage's log: sizes before and after, never enlarged."""

    def one(raw: bytes) -> dict:
        height, width, _ = pixels.decode(raw).shape
        scale = min(1.0, cap / max(width, height))
        w, h = max(1, round(width * scale)), max(1, round(height * scale))
        before = {"original_width": width, "original_height": height, "original_long_side": max(width, height)}
        return before | {"final_width": w, "final_height": h, "final_long_side": max(w, h), "downscaled": max(width, height) > cap, "very_low_res": max(width, height) < low}

    return _each(files, one, RESIZED)


def normalize_contrast(files: DataFrame, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """The contrast stage's log: percentiles, brightness and clipping after stretching lightness."""

    def one(raw: bytes) -> dict:
        before = pixels.decode(raw)
        after, a, b = pixels.stretch(before, low, high)
        return {"method": "lightness stretch", "low_percentile": low, "high_percentile": high, "stretch_low": a, "stretch_high": b} | pixels.clipping(before, after)

    return _each(files, one, CONTRASTED)


def recognize(files: DataFrame, engine: str, device: str = "cpu", transform: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """OCR of each file; one engine a worker, built at its first file."""
    build = ENGINES.get(engine)
    if build is None:
        raise ValueError(f"unknown engine {engine}; known: {sorted(ENGINES)}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, why = None, ""
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    read = read or build(device)
                    full, blocks = read(transform(content) if transform else content)
                    rows.append((name, "ok", "", {"full": full, "blocks": blocks}))
                except Exception as e:
                    why = f"{type(e).__name__}: {e}"
                    rows.append((name, "failed", why, None))
            yield pd.DataFrame(rows, columns=["filename", "status", "reason", "raw"], dtype=object)

    return files.select("path", "content").mapInPandas(run, READ)


PREPROCESSING: dict[str, Callable[[bytes], bytes] | None] = {"none": None}


def register_preprocessing(name: str, step: Callable[[bytes], bytes]) -> None:
    PREPROCESSING[name] = step


def _step(change: Callable) -> Callable[[bytes], bytes]:
    return lambda raw: pixels.encode(change(pixels.decode(raw)))


def preprocessing(name: str) -> Callable[[bytes], bytes] | None:
    """The step of a name; an unknown name means all of them."""
    return PREPROCESSING.get(name, PREPROCESSING["full"])


def grayscale(rgb):
    return pixels.with_lightness(rgb.mean(2, keepdims=True).repeat(3, 2), pixels.lightness(rgb))


register_preprocessing("grayscale", _step(grayscale))
register_preprocessing("contrast", _step(lambda rgb: pixels.stretch(rgb)[0]))
register_preprocessing("equalize", _step(pixels.adaptive_equalize))
register_preprocessing("perspective", _step(pixels.straighten))
register_preprocessing("full", _step(lambda rgb: pixels.adaptive_equalize(pixels.straighten(rgb))))
