"""Picture files: written, read, resized and compared; each picture is decoded and resized once."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .helpers import ssim_of
from .ranks import stored

#: The sharpness of the cubic kernel and the bits of its weights.
SHARPNESS, BITS = -0.5, 22
PLANES = "path string, height int, width int, data binary"


def bicubic_weights(new: int, old: int) -> np.ndarray:
    """``(new, old)`` whole weights of 22 bits: each new pixel is a cubic of the old ones around its middle;
    where pixels are lost the kernel is stretched over all that a new one covers (antialiasing)."""
    scale = old / new
    stretch = max(scale, 1.0)
    out = np.zeros((new, old))
    for i in range(new):
        middle = (i + 0.5) * scale
        low, high = max(int(middle - 2 * stretch + 0.5), 0), min(int(middle + 2 * stretch + 0.5), old)
        x = np.abs((np.arange(low, high) - middle + 0.5) / stretch)
        a = SHARPNESS
        w = np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0.0))
        out[i, low:high] = w / w.sum()
    return np.trunc(out * (1 << BITS) + np.where(out < 0, -0.5, 0.5))


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """``(height, width, channels)`` bytes, by antialiased bicubic interpolation, rounded after each axis."""
    out = image.astype(float)
    for axis, new in ((1, width), (0, height)):
        if new != out.shape[axis]:
            out = np.moveaxis(np.tensordot(bicubic_weights(new, out.shape[axis]), out, (1, axis)), 0, axis)
            out = np.clip(np.floor((out + (1 << (BITS - 1))) / (1 << BITS)), 0, 255)
    return out.astype(np.uint8)


def write_bitmaps(pictures: DataFrame, folder: str) -> DataFrame:
    """Writes ``name, height, width, pixels`` (rows of red, green, blue, from the top) as 24-bit bitmap files
    under ``folder`` of any file system that Arrow reaches; ``path`` of each. A task that runs again
    writes the same files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for name, height, width, pixels in zip(batch["name"], batch["height"], batch["width"], batch["pixels"], strict=True):
                rows = np.frombuffer(bytes(pixels), np.uint8).reshape(height, width * 3)
                rows = rows.reshape(height, width, 3)[::-1, :, ::-1].reshape(height, width * 3)
                body = np.pad(rows, ((0, 0), (0, -3 * width % 4))).tobytes()
                head = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0)
                with system.open_output_stream(f"{base}/{name}.bmp") as f:
                    f.write(head + body)
            yield pd.DataFrame({"path": [f"{folder}/{n}.bmp" for n in batch["name"]]})

    return stored(pictures.select("name", "height", "width", "pixels").mapInPandas(run, "path string"), "bitmaps")


def picture_planes(spark: SparkSession, folder: str, side: int | None = 224) -> DataFrame:
    """``path, height, width, data`` (red, green and blue a pixel) of the pictures under ``folder``, brought to
    ``side`` x ``side`` unless that is None. An opacity is left out, gray becomes three channels, files
    that aren't pictures go."""
    read = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, height, width, channels, data in zip(batch["origin"], batch["height"], batch["width"], batch["nChannels"], batch["data"], strict=True):
                image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                image = image[:, :, 2::-1] if channels >= 3 else np.repeat(image[:, :, :1], 3, axis=2)
                if side:
                    image = resized(image, side, side)
                out.append((path, *image.shape[:2], image.tobytes()))
            yield pd.DataFrame(out, columns=["path", "height", "width", "data"])

    return read.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, PLANES)


def pixel_statistics(planes: DataFrame) -> DataFrame:
    """``path, height, width, red, green, blue``: sums of each channel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = np.array([np.frombuffer(d, np.uint8).reshape(-1, 3).sum(0, dtype=np.int64) for d in batch["data"]]).reshape(-1, 3)
            yield batch[["path", "height", "width"]].assign(red=sums[:, 0], green=sums[:, 1], blue=sums[:, 2])

    return planes.mapInPandas(run, "path string, height int, width int, red long, green long, blue long")


def _similarity() -> Column:
    """The mean structural similarity of the channels of two pictures; the second is brought to the size of
    the first if they differ. Null where that is smaller than the window of 7."""

    @F.pandas_udf(DoubleType())
    def score(ha: pd.Series, wa: pd.Series, a: pd.Series, hb: pd.Series, wb: pd.Series, b: pd.Series) -> pd.Series:
        out: list[float | None] = []
        for p, q, x, r, s, y in zip(ha, wa, a, hb, wb, b, strict=True):
            x, y = np.frombuffer(x, np.uint8).reshape(p, q, 3), np.frombuffer(y, np.uint8).reshape(r, s, 3)
            y = y if (p, q) == (r, s) else resized(y, p, q)
            out.append(float(ssim_of(x.transpose(2, 0, 1).astype(float), y.transpose(2, 0, 1).astype(float)).mean()) if min(p, q) >= 7 else None)
        return pd.Series(out, dtype=object)

    return score(*[F.col(f"_{c}_{n}") for n in "ab" for c in ("height", "width", "data")])


def image_pair_scores(pairs: DataFrame, folder: str, side: int | None = 224) -> DataFrame:
    """``pairs`` (``path_a, path_b``, paths as the image source gives them or, of local files, without scheme) with the ``similarity`` of the
    pictures under ``folder``; pairs with an unreadable or missing picture go. With ``side`` each picture is
    brought to that size once, before the join, which so moves small pictures only; with None the second
    of a pair is brought to the size of the first."""
    planes = picture_planes(pairs.sparkSession, folder, side)
    planes = stored(planes, "planes")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    pairs = pairs.withColumns({f"_path_{n}": plain(f"path_{n}") for n in "ab"})
    of = {n: planes.select(plain("path").alias(f"_path_{n}"), *[F.col(c).alias(f"_{c}_{n}") for c in ("height", "width", "data")]) for n in "ab"}
    both = pairs.join(of["a"], "_path_a").join(of["b"], "_path_b")
    return both.select(*[c for c in pairs.columns if not c.startswith("_path_")], _similarity().alias("similarity")).where("similarity is not null")
