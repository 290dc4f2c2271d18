"""Driver-side outputs of small documents: canonical JSON, descriptors, deterministic archives, reports, published in one step."""

from __future__ import annotations

import hashlib
import json
import math
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame


def plain(value):
    """``value`` with numpy numbers and arrays, paths and rows as what JSON has; a number that is not finite raises."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return plain(value.asDict(recursive=True))
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, Path):
        return value.as_posix()
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("not a finite number")
    return value


def write_json(path: str, value) -> None:
    """Indented JSON with sorted keys; refuses an existing file."""
    text = json.dumps(plain(value), indent=2, sort_keys=True, allow_nan=False) + "\n"
    with open(path, "x", encoding="utf-8", newline="\n") as out:
        out.write(text)


def write_same(path: str, value) -> None:
    """``write_json``, where a file that holds the same value already is left as it is and any other raises."""
    if Path(path).exists():
        if json.loads(Path(path).read_text(encoding="utf-8")) != plain(value):
            raise FileExistsError(f"{path} holds another value")
        return
    write_json(path, value)


def write_ordered_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> int:
    """One CSV file with the given columns, rows by ``order``, line ends LF; returns the number of rows. Rows pass one by one through the driver."""
    import csv

    n = 0
    with open(path, "x", encoding="utf-8", newline="") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(columns)
        for row in df.orderBy(*order).select(*columns).toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def descriptor(path: str, root: str, views: dict[str, str], names: list[str]) -> None:
    """A dataset descriptor in YAML: root, the file list or folder of each view, and the classes by number. Every value is quoted as JSON, which YAML reads."""
    lines = [f"path: {json.dumps(root)}", *[f"{k}: {json.dumps(v)}" for k, v in views.items()], "names:", *[f"  {i}: {json.dumps(n)}" for i, n in enumerate(names)]]
    with open(path, "x", encoding="utf-8", newline="\n") as out:
        out.write("\n".join(lines) + "\n")


def file_list(df: DataFrame, column: str, path: str) -> int:
    """One path a line, sorted."""
    n = 0
    with open(path, "x", encoding="utf-8", newline="\n") as out:
        for row in df.select(column).orderBy(column).toLocalIterator():
            out.write(f"{row[0]}\n")
            n += 1
    return n


def deterministic_zip(path: str, root: str, names: list[str]) -> list[dict]:
    """A ZIP of ``names`` below ``root``, by name and with one fixed time, so equal files give equal bytes; beside it its digest. Returns the inventory."""
    inventory = []
    with zipfile.ZipFile(path, "x", zipfile.ZIP_DEFLATED) as out:
        for name in sorted(names):
            data = (Path(root) / name).read_bytes()
            inventory.append({"path": name, "size": len(data), "sha256": hashlib.sha256(data).hexdigest()})
            entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            entry.compress_type, entry.external_attr = zipfile.ZIP_DEFLATED, 0o100644 << 16
            out.writestr(entry, data)
    digest = hashlib.sha256(Path(path).read_bytes()).hexdigest()
    Path(f"{path}.sha256").write_text(f"{digest}  {Path(path).name}\n", encoding="utf-8")
    return inventory


def publish(make, path: str) -> None:
    """Calls ``make`` with a new folder beside ``path`` and renames it to ``path`` once it is whole; nothing appears if it fails."""
    target = Path(path)
    if target.exists():
        raise FileExistsError(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    stage = tempfile.mkdtemp(prefix=f".{target.name}-", dir=target.parent)
    try:
        make(stage)
        os.rename(stage, target)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise


def markdown(title: str, tables: dict[str, DataFrame]) -> str:
    """A report with a table for each small result."""
    out = [f"# {title}"]
    for name, df in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|") for v in row) + " |" for row in df.collect()]
    return "\n".join(out) + "\n"
