"""PNG files of image rows: a Spark data source that writes them in parallel, with a commit. Reading them is Spark's image source's work (images.read_images)."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: A PNG file's first bytes, and its colour types by number of channels.
SIGNATURE = bytes([137, 80, 78, 71, 13, 10, 26, 10])
COLOUR_TYPE = {1: 0, 3: 2, 4: 6}


def encode(width: int, height: int, channels: int, data: bytes) -> bytes:
    """The PNG file of interleaved bytes: grey, RGB or RGBA, rows unfiltered."""
    if channels not in COLOUR_TYPE or width < 1 or height < 1 or len(data) != width * height * channels:
        raise ValueError(f"no PNG of {width} x {height} x {channels} from {len(data)} bytes")
    rows = np.zeros((height, 1 + width * channels), np.uint8)  # each begins with its filter, none
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPE[channels], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def images_of(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height, channels, data) of pixels (image_id, w, h, idx, r, g, b, and a for four channels): the inverse of images.pixels_of().

    Channels are held to bytes. A row is an image, so an image's pixels meet in one task, as in its file.
    """
    names = ["r", "g", "b", *(["a"] if "a" in pixels.columns else [])]
    byte = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), x))), 2, "0")
    rows = pixels.select("image_id", "w", "h", F.struct("idx", F.concat(*[byte(F.col(n)) for n in names]).alias("v")).alias("p"))
    held = rows.groupBy("image_id").agg(F.first("w").cast("int").alias("width"), F.first("h").cast("int").alias("height"), F.array_sort(F.collect_list("p")).alias("p"))
    return held.select("image_id", "width", "height", F.lit(len(names)).alias("channels"), F.unhex(F.array_join(F.col("p.v"), "")).alias("data"))


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _PngWriter(DataSourceArrowWriter):
    """Each task writes its images into a folder of the job's own; the commit moves them to their names, an abort deletes the folder."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = self._at()
        own = f"{base}/_temporary-{self.job}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        files = []
        for batch in iterator:
            for i in range(batch.num_rows):
                name, w, h, n, data = (batch.column(c)[i].as_py() for c in ("image_id", "width", "height", "channels", "data"))
                if data is None or n not in COLOUR_TYPE:
                    continue
                with system.open_output_stream(f"{own}/{name}.png") as out:
                    out.write(encode(w, h, n, data))
                files.append(f"{own}/{name}.png")
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = self._at()
        for m in messages:
            for f in m.files if m else ():
                system.move(f, f"{base}/{f.rsplit('/', 1)[1]}")
        system.delete_dir(f"{base}/_temporary-{self.job}") if messages else None

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = self._at()
        if system.get_file_info(f"{base}/_temporary-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_temporary-{self.job}")


class PngSource(DataSource):
    """format("png"): writes rows (image_id, width, height, channels, data) as path/image_id.png; null data and other channel counts give no file."""

    @classmethod
    def name(cls) -> str:
        return "png"

    def writer(self, schema, overwrite: bool) -> _PngWriter:
        return _PngWriter(self.options["path"])


def write_images(images: DataFrame, path: str) -> None:
    """images (image_id, width, height, channels, data) as PNG files in the folder `path`, which all executors must see."""
    images.sparkSession.dataSource.register(PngSource)
    images.select("image_id", "width", "height", "channels", "data").write.format("png").mode("append").save(path)
