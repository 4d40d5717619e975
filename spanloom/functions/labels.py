"""Small scalar rules: excerpts, repeated contexts, positions in time, clocks, names, keys and views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.text import escaped


def substr(text: Column, start: Column, length: Column) -> Column:
    """`length` characters from `start` (from 0)."""
    return text.substr((start + 1).cast("int"), length.cast("int"))


def excerpt(text: Column, start: Column, end: Column, radius: int) -> Column:
    """The characters up to `radius` around [start, end), and where the range lies in them."""
    first = F.greatest(start - radius, F.lit(0))
    last = F.least(end + radius, F.length(text))
    return F.struct(substr(text, first, last - first).alias("text"), (start - first).alias("start"), (end - first).alias("end"))


def times_in(text: Column, part: Column) -> Column:
    """How often part occurs in text, overlaps included; an empty part never does."""
    return F.when(F.length(part) > 0, F.regexp_count(text, F.concat(F.lit("(?="), escaped(part), F.lit(")")))).otherwise(0).cast("long")


def is_repeated(corpus: Column, target: Column, before: Column, after: Column, around: int = 8) -> Column:
    """Whether a target occurs again in the corpus and its context, `around` characters on either side, is not unique.

    All are normalised texts. An empty target is not repeated.
    """
    wide = F.concat(F.right(before, F.lit(around)), target, F.left(after, F.lit(around)))
    return (times_in(corpus, target) > 1) & (times_in(corpus, wide) != 1)


def proportional(length: Column, start: Column, end: Column, from_ms: Column, to_ms: Column) -> Column:
    """The times of characters [start, end) of a text of `length` spread evenly over [from_ms, to_ms]."""
    span = (to_ms - from_ms) / F.greatest(length, F.lit(1))
    return F.struct((from_ms + span * start).alias("start"), (from_ms + span * end).alias("end"))


def interpolated(span_start: Column, span_end: Column, start_ms: Column, end_ms: Column, low: Column, high: Column) -> Column:
    """A span of characters clipped to [low, high), its times in proportion; null if nothing is left."""
    a, b = F.greatest(span_start, low), F.least(span_end, high)
    rate = (end_ms - start_ms) / (span_end - span_start)
    return F.when(b > a, F.struct(a.alias("start"), b.alias("end"), (start_ms + rate * (a - span_start)).alias("start_ms"), (start_ms + rate * (b - span_start)).alias("end_ms")))


def clock_ms(ms: Column) -> Column:
    """M:SS.mmm of milliseconds."""
    whole = F.floor(ms)
    return F.format_string("%d:%02d.%03d", F.floor(whole / 60000), F.floor(whole % 60000 / 1000), whole % 1000)


def iso_with_zone(text: Column) -> Column:
    """Whether text is an ISO 8601 time with a zone."""
    return F.coalesce(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$") & F.try_to_timestamp(F.regexp_replace(text, " ", "T")).isNotNull(), F.lit(False))


def reason_label(reason: Column, labels: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, reason), F.replace(reason, F.lit("_"), F.lit(" ")))


def state_key(*parts: Column) -> Column:
    """The first twelve hex digits of a digest over the parts as canonical JSON."""
    return F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 12)


def output_name(path: Column, suffix: str) -> Column:
    """The file's name without its extension, and a suffix."""
    return F.concat(F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1), F.lit(suffix))


def sample_to_pixel(sample: Column, first: Column, last: Column, width: int) -> Column:
    return F.least(F.greatest((sample - first) * width / F.greatest(last - first, F.lit(1)), F.lit(0.0)), F.lit(float(width)))


def pixel_to_sample(x: Column, first: Column, last: Column, width: int) -> Column:
    return F.least(F.greatest((first + F.bround(x * (last - first) / width)).cast("long"), first), last)


def zoomed(first: Column, last: Column, at: Column, factor: float, total: Column, least: int) -> Column:
    """A view [first, last) scaled about `at`, which keeps its place; at least `least` wide, within the signal."""
    wide = F.least(F.greatest((last - first) * factor, F.lit(float(least))), total.cast("double"))
    begin = at - (at - first) * wide / F.greatest(last - first, F.lit(1))
    begin = F.floor(F.least(F.greatest(begin, F.lit(0.0)), total - wide))
    return F.struct(begin.alias("first"), (begin + F.floor(wide)).alias("last"))


def next_match(text: Column, part: str, after: Column) -> Column:
    """Where part occurs from `after` on (from 0), else from the start; -1 if nowhere."""
    quoted = F.lit(part)
    later = F.position(quoted, text, after.cast("int") + 1)
    return F.when(later > 0, later - 1).otherwise(F.position(quoted, text) - 1)


def mp3_rate(rate: Column) -> Column:
    """The nearest rate that MP3 files may have, the larger on ties; multiples of 44.1 kHz above 48 kHz stay in their family.

    Fixed values: the format's rates.
    """
    rates = (8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000)
    best = F.element_at(F.array_sort(F.array(*[F.struct(F.abs(rate - r).alias("d"), F.lit(-r).alias("r")) for r in rates])), 1)["r"] * -1
    return F.when((rate > 48000) & (rate % 44100 == 0), F.lit(44100)).otherwise(best)


#: Suffixes of files that are taken for audio.
AUDIO = ("wav", "mp3", "m4a", "aac", "flac", "ogg", "opus", "wma")


def is_audio(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(*AUDIO)
