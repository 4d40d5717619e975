"""PCM WAV files and DOCX documents as Python data sources.

A WAV file is read in ranges of frames, a partition each, which seek to their place; a filter on
`sample` becomes a smaller range where Spark hands filters to Python sources, and the options
`first` and `last` do the same anywhere. A document is one partition.
"""

from __future__ import annotations

import io
import re
import wave
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Frames of a batch and of a partition, and the largest document part that is parsed.
FRAMES, RANGE, PART_BYTES = 65_536, 1 << 22, 64 << 20
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def listed(path: str, suffix: str) -> list[str]:
    """The files at a path or below it, as full URIs or paths that every executor can open."""
    fs, root = pafs.FileSystem.from_uri(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted(path.rstrip("/") + f.path[len(root.rstrip("/")) :] for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(suffix))


def opened(path: str) -> io.BytesIO:
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(root) as stream:
        return io.BytesIO(stream.read())


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FilesReader(DataSourceReader):
    suffix = ""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [FilePartition(p) for p in listed(self.path, self.suffix)]


class FramesPartition(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def header(path: str) -> tuple[int, int, int, int]:
    """(rate, channels, bytes of a sample, frames) of a WAV file. A header without frames, or of another kind, is an error."""
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(root) as stream, wave.open(stream) as f:
        found = f.getframerate(), f.getnchannels(), f.getsampwidth(), f.getnframes()
    if min(found[:3]) <= 0 or found[2] > 4:
        raise ValueError(f"no PCM audio of 8 to 32 bits: {path}")
    return found


def decoded(raw: bytes, width: int) -> np.ndarray:
    """Samples in [-1, 1) of 8-, 16-, 24- or 32-bit PCM."""
    b = np.frombuffer(raw, np.uint8)
    if width == 1:
        return (b.astype(np.float64) - 128) / 128
    wide = np.zeros((len(b) // width, 4), np.uint8)
    wide[:, 4 - width :] = b.reshape(-1, width)
    return wide.view("<i4")[:, 0] / 2.0**31


class WavReader(FilesReader):
    suffix = ".wav"

    def __init__(self, path: str, first: int = 0, last: int | None = None):
        super().__init__(path)
        self.first, self.last = max(0, first), last

    def pushFilters(self, filters):  # noqa: N802  the name is Spark's
        for f in filters:
            name, value = type(f).__name__, getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("sample",) or not isinstance(value, int):
                yield f
            elif name in ("GreaterThan", "GreaterThanOrEqual"):
                self.first = max(self.first, value + (name == "GreaterThan"))
            elif name in ("LessThan", "LessThanOrEqual"):
                bound = value + (name == "LessThanOrEqual")
                self.last = bound if self.last is None else min(self.last, bound)
            else:
                yield f

    def partitions(self):
        found = []
        for path in listed(self.path, self.suffix):
            frames = header(path)[3]
            stop = frames if self.last is None else min(frames, self.last)
            found += [FramesPartition(path, at, min(at + RANGE, stop)) for at in range(self.first, stop, RANGE)]
        return found or [FramesPartition("", 0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        """A row for each sample and channel of the partition's frames."""
        if partition.last <= partition.first:
            return
        fs, root = pafs.FileSystem.from_uri(partition.path)
        with fs.open_input_file(root) as stream, wave.open(stream) as f:
            rate, channels, width = f.getframerate(), f.getnchannels(), f.getsampwidth()
            f.setpos(partition.first)
            at = partition.first
            while at < partition.last and (raw := f.readframes(min(FRAMES, partition.last - at))):
                v = decoded(raw, width)
                n = len(v) // channels
                path = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(v), np.int32)), [partition.path]).cast(pa.string())
                sample = np.repeat(np.arange(at, at + n), channels)
                yield pa.RecordBatch.from_arrays([path, pa.array(np.full(len(v), rate, np.int32)), pa.array(sample), pa.array(np.tile(np.arange(channels, dtype=np.int32), n)), pa.array(v)], ["path", "rate", "sample", "channel", "v"])
                at += n


class WavSource(DataSource):
    """spark.read.format("pcm_wav").load(path): path, rate, sample, channel, v. Options first and last bound the samples."""

    @classmethod
    def name(cls) -> str:
        return "pcm_wav"

    def schema(self) -> str:
        return "path string, rate int, sample long, channel int, v double"

    def reader(self, schema) -> WavReader:
        last = self.options.get("last")
        return WavReader(self.options["path"], int(self.options.get("first", 0)), None if last is None else int(last))


class WavInfoReader(FilesReader):
    suffix = ".wav"

    def read(self, partition):
        rate, channels, width, frames = header(partition.path)
        yield partition.path, rate, channels, frames, frames * 1000 // rate, "wav", f"pcm_u{width * 8}" if width == 1 else f"pcm_s{width * 8}le"


class WavInfoSource(DataSource):
    """spark.read.format("pcm_wav_info").load(path): what the header says of each file, and the duration that follows."""

    @classmethod
    def name(cls) -> str:
        return "pcm_wav_info"

    def schema(self) -> str:
        return "path string, sample_rate int, channels int, total_samples long, duration_ms long, format_name string, codec_name string"

    def reader(self, schema) -> WavInfoReader:
        return WavInfoReader(self.options["path"])


#: Characters that stand for the elements of a run: the hyphens are the ones that Unicode has for them, so offsets stay.
MARKS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "\u2011", "softHyphen": "\u00ad"}


def runs_of(data: io.BytesIO) -> Iterator[tuple[int, int, str, str | None]]:
    """(paragraph, run, text, highlight) of a document; tabs, breaks and hyphens as characters."""
    try:
        with zipfile.ZipFile(data) as z:
            info = z.getinfo("word/document.xml")
            if info.file_size > PART_BYTES:
                raise ValueError("the document part is too large")
            root = ElementTree.fromstring(z.read(info))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(f"no DOCX document: {e}") from e
    for p, paragraph in enumerate(root.iter(f"{WORD}p")):
        for r, run in enumerate(paragraph.iter(f"{WORD}r")):
            text = "".join((n.text or "") if n.tag == f"{WORD}t" else MARKS.get(n.tag.removeprefix(WORD), "") for n in run.iter())
            light = run.find(f"{WORD}rPr/{WORD}highlight")
            yield p, r, text, None if light is None else light.get(f"{WORD}val")


class DocxReader(FilesReader):
    suffix = ".docx"

    def read(self, partition):
        for p, r, text, light in runs_of(opened(partition.path)):
            yield partition.path, p, r, text, light


class DocxSource(DataSource):
    """spark.read.format("docx_runs").load(path): path, paragraph, run, text, highlight."""

    @classmethod
    def name(cls) -> str:
        return "docx_runs"

    def schema(self) -> str:
        return "path string, paragraph int, run int, text string, highlight string"

    def reader(self, schema) -> DocxReader:
        return DocxReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the sources known, and let filters on `sample` reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)
    spark.dataSource.register(WavInfoSource)
    spark.dataSource.register(DocxSource)


#: Suffixes that are taken for audio.
AUDIO = re.compile(r"\.(wav|mp3|m4a|aac|flac|ogg|opus|wma)$", re.IGNORECASE)


def is_audio(path: str) -> bool:
    return AUDIO.search(path) is not None
