"""Reading marked-up books from files: USFM by its events, USX by its tree, both from zip files too."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.sources.markup import VERSE, detect_encoding, usx_rows
from segmill.sources.usfm import Style, tokenized
from segmill.sources.usfm_events import placed, text_rows


def book_files(spark: SparkSession, path: str, encoding: str | None = "utf-8-sig", inside: str = r"(?i)\.(sfm|usfm|usx)$") -> DataFrame:
    """path, content (text of USFM), usx (bytes) of all books of a path, those in zip files too.  Without an encoding each file's is detected."""

    def members(name: str, content: bytes) -> Iterator[tuple]:
        if name.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for n in sorted(z.namelist()):
                    if re.search(inside, n):
                        yield from members(f"{name}!{n}", z.read(n))
        elif name.lower().endswith(".usx"):
            yield name, None, content
        else:
            yield name, content.decode(encoding or detect_encoding(content), errors="replace" if encoding is None else "strict"), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame(list(members(name, bytes(content))), columns=["path", "content", "usx"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, content string, usx binary")


def read_books(spark: SparkSession, path: str, encoding: str | None = "utf-8-sig", inside: str = r"(?i)\.(sfm|usfm|usx)$", styles: dict[str, Style] | None = None, include_markers: bool = False) -> DataFrame:
    """book, chapter, verse, position, style, text of all USFM and USX files of a path.

    A verse is one row, with all its paragraphs; ranges that overlap are one verse,
    a verse met again is passed over.  Headings, other paragraphs and cells have verse 0.
    """
    files = book_files(spark, path, encoding, inside)
    rows = text_rows(placed(tokenized(files.where("content is not null").select("path", "content"), styles), styles), include_markers)
    verse = F.when(F.col("kind") == "verse", F.col("verse")).otherwise("0")
    usfm = rows.where("book is not null and (kind = 'verse' or text <> '')").select("book", "chapter", verse.alias("verse"), "position", F.coalesce("style", F.lit("")).alias("style"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["usx"]:
                yield pd.DataFrame(usx_rows(bytes(content)), columns=[c.split()[0] for c in VERSE.split(", ")])

    return usfm.unionByName(files.where("usx is not null").select("usx").mapInPandas(run, VERSE))
