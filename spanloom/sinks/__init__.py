"""Sinks: cut lists, JSON documents and all-or-nothing replacement of several files."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import shutil
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = ("index", "start_sample", "end_sample", "length_samples", "start_seconds", "end_seconds", "text", "status")


def cut_list(intervals: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """keys and the eight columns of a cut list, numbered from 1, seconds with six decimals."""
    line = Window.partitionBy(*keys).orderBy("start", "end")
    seconds = lambda c: F.format_string("%.6f", F.col(c) / F.lit(float(rate)))
    have = lambda c: F.col(c) if c in intervals.columns else F.lit("")
    return intervals.select(*keys, F.row_number().over(line).cast("long").alias("index"), F.col("start").alias("start_sample"), F.col("end").alias("end_sample"), (F.col("end") - F.col("start")).alias("length_samples"), seconds("start").alias("start_seconds"), seconds("end").alias("end_seconds"), have("text").alias("text"), have("status").alias("status"))


def cut_list_csv(rows: Iterable) -> bytes:
    """One project's cut list as UTF-8 CSV with a byte-order mark."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(COLUMNS)
    for r in rows:
        writer.writerow([r[c] for c in COLUMNS])
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def commit(staged: dict[Path, Path], overwrite: bool = True) -> None:
    """Move staged files to their places, all of them or none: what was there comes back on failure.

    Without overwrite, a place that is taken is a failure before anything moves.
    """
    for final in staged.values():
        if final.is_dir():
            raise IsADirectoryError(final)
        if final.exists() and not overwrite:
            raise FileExistsError(final)
    kept: dict[Path, Path] = {}
    placed: list[Path] = []
    try:
        for temporary, final in staged.items():
            if final.exists():
                kept[final] = final.with_name(f".{final.name}.{uuid.uuid4().hex}")
                os.replace(final, kept[final])
            os.replace(temporary, final)
            placed.append(final)
    except OSError:
        for final in placed:
            final.unlink(missing_ok=True)
        for final, backup in kept.items():
            os.replace(backup, final)
        raise
    for backup in kept.values():
        backup.unlink(missing_ok=True)


def save_json(document: dict, path: Path) -> None:
    """Write a JSON document through a file beside it, flushed to disk before it takes the name."""
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with part.open("w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def load_json(path: Path) -> dict:
    """Read a JSON document, with or without a byte-order mark."""
    return json.loads(path.read_text(encoding="utf-8-sig"))


def tree_digest(top: Path) -> str:
    """SHA-256 over the files below a folder in order: length of the name, name, bytes."""
    h = hashlib.sha256()
    for p in sorted(p for p in top.rglob("*") if p.is_file()):
        name = p.relative_to(top).as_posix().encode()
        h.update(len(name).to_bytes(8, "big") + name)
        with p.open("rb") as f:
            shutil.copyfileobj(f, _Into(h))
    return h.hexdigest()


class _Into:
    """A digest as a file to write to."""

    def __init__(self, digest):
        self.write = digest.update
