"""Text functions: normalisation, occurrences, n-grams, clock strings and parsed tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: What normalisation drops: punctuation, symbols, controls, separators and white space; marks stay.
DROPPED = r"[\p{P}\p{S}\p{C}\p{Z}\s]"


def normalized(text: Column) -> Column:
    """Case-folded text without what is dropped; for Latin text, where only the sharp s folds to two letters."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), DROPPED, "")


def normalize_with_origin(text: str) -> tuple[str, list[int]]:
    """Any text, character by character: NFKC, folded, filtered; and where each character comes from."""
    out, origin = [], []
    for i, c in enumerate(text):
        for d in unicodedata.normalize("NFKC", c).casefold():
            if not d.isspace() and unicodedata.category(d)[0] not in "PSCZ":
                out.append(d)
                origin.append(i)
    return "".join(out), origin


def normalized_any(df: DataFrame, text: str) -> DataFrame:
    """df with norm and origin, by the full Unicode rule."""
    schema = StructType([*df.schema, StructField("norm", StringType()), StructField("origin", ArrayType(IntegerType()))])

    def run(batches):
        for pdf in batches:
            done = [normalize_with_origin(t or "") for t in pdf[text]]
            yield pdf.assign(norm=[d[0] for d in done], origin=pd.Series([d[1] for d in done], index=pdf.index, dtype=object))

    return df.mapInPandas(run, schema)


def normalized_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df with norm_<name> for each name, by the full Unicode rule."""
    schema = StructType([*df.schema, *[StructField(f"norm_{n}", StringType()) for n in names]])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{f"norm_{n}": [normalize_with_origin(t or "")[0] for t in pdf[n]] for n in names})

    return df.mapInPandas(run, schema)


def normalized_range(origin: Column, start: Column, end: Column) -> Column:
    """The range of normalised positions whose origins lie in [start, end); null if there is none."""
    inside = F.filter(F.transform(origin, lambda x, i: F.when((x >= start) & (x < end), i)), lambda i: i.isNotNull())
    return F.when(F.size(inside) > 0, F.struct(F.array_min(inside).alias("start"), (F.array_max(inside) + 1).alias("end")))


def escaped(literal: Column) -> Column:
    return F.regexp_replace(literal, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def occurrences(text: Column, literal: str) -> Column:
    """How often literal occurs, overlapping occurrences included."""
    quoted = "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in literal)
    return F.regexp_count(text, F.lit(f"(?={quoted})")).cast("long")


def grams(df: DataFrame, keys: list[str], text: str, width: int) -> DataFrame:
    """keys, pos (from 0), gram: every run of `width` characters, from one pass over the text."""
    return df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))).alias("pos", "gram")).select(*keys, F.col("pos").cast("long").alias("pos"), "gram")


def unique_gram_pairs(reference: DataFrame, observed: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, ref_pos, obs_pos, gram: grams that occur once in the reference and once in the observed text."""
    once = lambda df, name: grams(df, keys, "text", width).groupBy(*keys, "gram").agg(F.min("pos").alias(name), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return once(reference, "ref_pos").join(once(observed, "obs_pos"), [*keys, "gram"])


#: Fixed value of the document format: the word that a time anchor begins with; a name and the time follow.
SPEAKER = "\u53d1\u8a00\u4eba"


def anchor_ms(text: Column) -> Column:
    """The time of an anchor in milliseconds - the speaker's word, a name or none, and MM:SS or HH:MM:SS with one to three digits
    first -; null if the line is no anchor."""
    blank = r"[\t \u00a0\u3000]"
    head = rf"^{blank}*{SPEAKER}(?:{blank}+[^\d:\r\n]{{1,40}}?)?{blank}+"
    long, short = rf"{head}([0-9]{{1,3}}):([0-5][0-9]):([0-5][0-9]){blank}*\z", rf"{head}([0-9]{{1,3}}):([0-5][0-9]){blank}*\z"
    part = lambda pattern, k: F.regexp_extract(text, pattern, k).cast("long")
    return F.when(text.rlike(long), (part(long, 1) * 3600 + part(long, 2) * 60 + part(long, 3)) * 1000).when(text.rlike(short), (part(short, 1) * 60 + part(short, 2)) * 1000)


def clock(ms: Column) -> Column:
    """HH:MM:SS of milliseconds, rounded down."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def context(text: Column, start: Column, end: Column, width: int = 12) -> tuple[Column, Column]:
    """Up to `width` characters before start and after end (from 0)."""
    first = F.greatest(start - width, F.lit(0))
    return text.substr((first + 1).cast("int"), (start - first).cast("int")), text.substr((end + 1).cast("int"), F.lit(width))


def sample_range(start_ms: Column, end_ms: Column, rate: Column | int, total: Column | int) -> Column:
    """Samples of a range in ms: rounded half to even, kept in the signal, one sample at least."""
    rate, total = (x if isinstance(x, Column) else F.lit(x) for x in (rate, total))
    total = total.cast("long")
    a = F.least(F.greatest(F.bround(start_ms * rate / 1000).cast("long"), F.lit(0).cast("long")), total - 1)
    b = F.greatest(F.least(F.bround(end_ms * rate / 1000).cast("long"), total), a + 1)
    return F.struct(a.alias("start"), b.alias("end"))


def sample_at(ms: Column, rate: Column | int, total: Column | int) -> Column:
    """The sample at a time: rounded half to even, from 0 to total; null for null."""
    rate, total = (x if isinstance(x, Column) else F.lit(x) for x in (rate, total))
    return F.when(ms.isNotNull(), F.greatest(F.lit(0).cast("long"), F.least(total.cast("long"), F.bround(ms * rate / 1000).cast("long"))))


def serialized_tokens(text: Column) -> Column:
    """Records `token start end;` as an array of (token, start, end); what doesn't parse goes."""
    pattern = r"^\s*(.*\S)\s+(-?\d+(?:\.\d+)?)\s+(-?\d+(?:\.\d+)?)\s*$"
    parts = F.filter(F.split(text, ";"), lambda x: x.rlike(pattern))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("token"), F.regexp_extract(x, pattern, 2).cast("double").alias("start"), F.regexp_extract(x, pattern, 3).cast("double").alias("end")))


#: The blocks of Han characters.
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{30000}-\x{323AF}]"


def is_han(letter: Column) -> Column:
    """Whether a character is Han."""
    return letter.rlike(rf"^{HAN}\z")


def phonetic_keys(letters: DataFrame, sounds: DataFrame) -> DataFrame:
    """letters (letter, ...) with key: the sound of a character by the dictionary `sounds` (letter, sound), else the character itself.

    The dictionary is joined by letter; equal keys are sound-alikes.
    """
    return letters.join(sounds, "letter", "left").withColumn("key", F.coalesce(F.concat(F.lit("sound:"), "sound"), F.concat(F.lit("literal:"), "letter"))).drop("sound")


def without_tags(text: Column) -> Column:
    """text without <...>."""
    return F.regexp_replace(text, "<[^>]+>", "")


def confidence_of(record: Column, keys: tuple[str, ...] = ("confidence", "score", "probability", "prob")) -> Column:
    """The first valid probability of a JSON record by the precedence of keys; booleans and texts that are no numbers are none."""
    v = F.try_parse_json(record)

    def at(key: str) -> Column:
        told = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
        return F.when(told != "BOOLEAN", probability(F.try_variant_get(v, f"$.{key}", "string")))

    return F.coalesce(*[at(k) for k in keys])


def duration_ms(samples: Column, rate: Column) -> Column:
    """Whole milliseconds of samples, rounded down."""
    return F.floor(samples * 1000 / rate).cast("long")


def probability(value: Column) -> Column:
    """A number in [0, 1], otherwise null."""
    v = value.try_cast("double")
    return F.when(v.between(0.0, 1.0), v)
