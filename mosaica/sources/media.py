"""Media files and their local descriptors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The suffixes of media files.
IMAGES = (".jpg", ".jpeg", ".png")
AUDIO = (".mp3", ".wav", ".flac", ".ogg")


def media_files(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(object_id, content) of the files below a folder, by suffix in any case."""
    wanted = "|".join(s.replace(".", r"\.") for s in suffixes)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(f"({wanted})$")).select(F.col("path").alias("object_id"), "content")


def descriptors(files: DataFrame, extract: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(object_id, desc_no, vec): ``extract`` gives a matrix a file (``sources.descriptors`` has two); files that give none
    are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.asarray(extract(content.as_py()), np.float32)
                if found.size:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(range(len(found)), pa.int32()), pa.array(found.tolist(), pa.list_(pa.float32()))], ["object_id", "desc_no", "vec"])

    return files.mapInArrow(run, "object_id string, desc_no int, vec array<float>")
