"""Scans of archives, metric logs, images and small documents."""

from __future__ import annotations

import hashlib
import io
import json
import shutil
import stat
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import scalars as S

from .scan import text_csv

#: Members of at most this many bytes with one of these suffixes are read as text, to be searched for secrets.
SMALL_TEXT, TEXT_SUFFIXES = 1 << 20, (".json", ".yaml", ".yml", ".csv", ".txt")
MEMBERS = "archive string, path string, size long, sha256 string, is_dir boolean, is_link boolean, text string"


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        for archive, content in zip(x["path"], x["content"], strict=True):
            rows = []
            with zipfile.ZipFile(io.BytesIO(content)) as opened:
                for m in opened.infolist():
                    digest, text = hashlib.sha256(), None
                    with opened.open(m) as data:
                        while part := data.read(1 << 20):
                            digest.update(part)
                    if m.file_size <= SMALL_TEXT and m.filename.lower().endswith(TEXT_SUFFIXES):
                        text = opened.read(m).decode("utf-8", "replace")
                    rows.append((archive, m.filename, m.file_size, digest.hexdigest(), m.is_dir(), stat.S_ISLNK(m.external_attr >> 16 & 0xFFFF), text))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBERS.split(", ")])


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """The members of every ZIP of ``path`` (a glob or folder): MEMBERS. Archives are read in parallel, one in memory at a time; members stream."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return read.mapInPandas(_members, MEMBERS)


def metric_log(spark: SparkSession, path: str) -> DataFrame:
    """A CSV log as (file, position, metric, value) with names stripped; a value that is no finite number is null, for ``suites.run_log`` to name."""
    rows = text_csv(spark, path).withColumn("_file", F.input_file_name())
    names = [c for c in rows.columns if c != "_file"]
    wide = rows.withColumn("_at", F.monotonically_increasing_id())
    pairs = F.explode(F.array(*[F.struct(F.lit(c.strip()).alias("metric"), S.number(F.col(f"`{c}`")).alias("value")) for c in names]))
    return wide.select(F.col("_file").alias("file"), F.col("_at").alias("position"), pairs.alias("p")).select("file", "position", "p.*")


def class_names(document: str) -> list[str]:
    """The classes of a dataset's metadata: a list, or a map of the numbers from 0 on; else ValueError."""
    names = read_mapping(document).get("names")
    if isinstance(names, dict):
        order = sorted(int(k) for k in names)
        if order != list(range(len(order))):
            raise ValueError("class numbers are not 0, 1, 2, ...")
        by_number = {int(k): v for k, v in names.items()}
        names = [by_number[i] for i in order]
    if not isinstance(names, list) or not names or len(set(names)) != len(names) or not all(isinstance(x, str) and x for x in names):
        raise ValueError("no list of distinct class names")
    return names


def read_mapping(text: str) -> dict:
    """A JSON document, or a YAML one where a YAML library is there; anything but a mapping raises."""
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError:
            raise ValueError("the document is no JSON and there is no YAML library") from None
        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError("the document is not a mapping")
    return value


def configured(text: str, kinds: dict[str, type], ranges: dict[str, tuple[float, float]] | None = None) -> dict:
    """A mapping with exactly the keys of ``kinds``, each of its type and within its range; all faults are named at once."""
    value, faults = read_mapping(text), []
    faults += [f"{k} is unknown" for k in sorted(set(value) - set(kinds))] + [f"{k} is missing" for k in sorted(set(kinds) - set(value))]
    for k, kind in kinds.items():
        if k not in value:
            continue
        own = value[k]
        if not isinstance(own, kind if kind is not float else (int, float)) or (isinstance(own, bool) and kind is not bool):
            faults.append(f"{k} is no {kind.__name__}")
        elif k in (ranges or {}) and not ranges[k][0] <= own <= ranges[k][1]:
            faults.append(f"{k} is out of range")
    if faults:
        raise ValueError("; ".join(faults))
    return value


def import_zip(archive: str, target: str) -> int:
    """Unpacks an archive into a new folder, whole or not at all; members with unsafe paths or links raise. Returns the number of files."""
    from .sinks import publish

    def unpack(folder: str) -> None:
        with zipfile.ZipFile(archive) as opened:
            for m in opened.infolist():
                parts = m.filename.rstrip("/").split("/")
                if m.filename.startswith("/") or "\\" in m.filename or any(p in ("", ".", "..") for p in parts) or parts[0].endswith(":") or stat.S_ISLNK(m.external_attr >> 16 & 0xFFFF):
                    raise ValueError(f"unsafe member {m.filename}")
                if m.is_dir():
                    continue
                out = Path(folder, *parts)
                out.parent.mkdir(parents=True, exist_ok=True)
                with opened.open(m) as data, open(out, "xb") as copy:
                    shutil.copyfileobj(data, copy)
                count.append(m.filename)

    count: list[str] = []
    publish(unpack, target)
    return len(count)


def _image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the head of a PNG, GIF, BMP or JPEG; None for anything else or a cut file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"BM" and len(data) >= 26:
        return int.from_bytes(data[18:22], "little", signed=True), abs(int.from_bytes(data[22:26], "little", signed=True))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + size
    return None


def image_heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, width, height, readable) of every file below ``path``, sizes from image heads: no pixel is decoded."""
    @F.pandas_udf("width int, height int")
    def size(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_image_size(bytes(x)) or (None, None) for x in content], columns=["width", "height"]).astype({"width": "Int32", "height": "Int32"})

    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    out = read.select("path", F.sha2("content", 256).alias("sha256"), size("content").alias("s"))
    return out.select("path", "sha256", "s.width", "s.height", F.col("s.width").isNotNull().alias("readable"))
