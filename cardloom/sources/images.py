"""Images as tensors for a scorer."""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels of each side of a tensor.
SIDE = 512
_HEADER = re.compile(rb"P([56])\s+(?:#.*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """file_name and content of all files of a folder."""
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


def decode(content: bytes, side: int = SIDE) -> np.ndarray:
    """1 x side x side x 3 numbers from 0 to 1.

    Portable grey and pixel maps are read here, each pixel from the nearest one; other formats need Pillow.
    """
    head = _HEADER.match(content)
    if not head:
        from PIL import Image

        picture = Image.open(io.BytesIO(content)).convert("RGB").resize((side, side))
        return np.asarray(picture, np.float32)[None] / 255
    depth, width, height = (3 if head[1] == b"6" else 1), int(head[2]), int(head[3])
    pixels = np.frombuffer(content, np.uint8, width * height * depth, head.end()).reshape(height, width, depth)
    rows, columns = ((np.arange(side) * 2 + 1) * n // (2 * side) for n in (height, width))
    return np.repeat(pixels[rows][:, columns], 3 // depth, axis=2).astype(np.float32)[None] / int(head[4])


def scored(images: DataFrame, make_scorer: Callable[[], Callable[[np.ndarray], tuple[float, float]]]) -> DataFrame:
    """file_name, boy, girl: what a scorer, made once by each task, says of each image; (0, 0) where reading or scoring fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make_scorer()
        for batch in batches:
            out = []
            for content in batch["content"]:
                try:
                    boy, girl = score(decode(bytes(content)))
                except Exception:  # any failure of an image is its own: it gets no score
                    boy, girl = 0.0, 0.0
                out.append((float(boy), float(girl)))
            yield pd.DataFrame({"file_name": batch["file_name"], "boy": [x[0] for x in out], "girl": [x[1] for x in out]})

    return images.select("file_name", "content").mapInPandas(run, "file_name string, boy double, girl double")
