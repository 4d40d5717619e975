"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer of UTF-8 bytes is chosen when the smallest of its inner s-mers, by hash, is its first
or its last one. Whether it is chosen depends on its own K bytes alone, so texts that share a
passage share its anchors wherever it stands. Bytes, unlike code points, are found at a place
without walking there. A fingerprint keeps, for each of REGISTERS classes of k-mers, the
smallest hash of the chosen ones and the place of that anchor, so two fingerprints are matched
by position: an anchor in both counts if another one is the same way apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import text_of

K, S = 12, 8
#: Texts are cut into blocks of so many bytes, each with the K - 1 that follow.
STRIDE = 4096
#: Registers of a fingerprint, bits of a hash and of a place in each (places count up to 2**PLACE, then anew), registers in one number.
REGISTERS, BITS, PLACE, LANES = 128, 11, 10, 3
WIDE = BITS + PLACE
NUMBERS = -(-REGISTERS // LANES)
#: Rows of a range, and ranges, at most: the table of ranges that is broadcast has a row each. Sampled ids a range.
RANGE, RANGES, SAMPLED = 256, 65_536, 4
#: Parts of a range of one id, at most.
PARTS = 1 << 20


def anchors(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """rows' columns `keep` and a hash for each closed syncmer of the column text, with its place (from 0).

    Places count bytes. A text of at most 2K bytes that isn't empty gives one more row, of its
    whole, since it may hold no syncmer.
    """
    raw = rows.select(*keep, F.col(text).cast("binary").alias("_raw"))
    n = F.octet_length("_raw")
    cut = raw.where(n > 0).select(*keep, "_raw", F.explode(F.sequence(F.lit(0), n - 1, F.lit(STRIDE))).alias("_base"))
    cut = cut.select(*keep, "_base", n.alias("_n"), F.col("_raw").substr(F.col("_base") + 1, F.lit(STRIDE + K - 1)).alias("_piece"))
    size = F.octet_length("_piece")
    inner = F.when(size >= K, F.sequence(F.lit(1), F.greatest(F.lit(1), size - (K - 1)))).otherwise(F.array().cast("array<int>"))
    at = cut.select(*keep, "_base", "_piece", F.explode(F.when(F.col("_n") <= 2 * K, F.concat(inner, F.array(F.lit(0)))).otherwise(inner)).alias("_at"))
    hashes = [F.xxhash64(F.col("_piece").substr(F.col("_at") + i, F.lit(S))) for i in range(K - S + 1)]
    # each hash stands once in the condition, as a filter computes repeated expressions anew
    closed = F.least(hashes[0], hashes[-1]) <= F.least(*hashes[1:-1])
    whole = F.col("_at") == 0
    kmer = F.when(whole, F.col("_piece")).otherwise(F.col("_piece").substr(F.col("_at"), F.lit(K)))
    place = F.col("_base") + F.greatest(F.col("_at") - 1, F.lit(0))
    return at.where(whole | closed).select(*keep, place.alias("place"), F.xxhash64(kmer, whole.cast("int")).alias("hash"))


def ranged(docs: DataFrame) -> tuple[Column, Column]:
    """(bucket, tie) of each row: ranges of ids with about as many rows each, numbered in rising order.

    The bounds are quantiles of a sample of the ids, of bounded size, so ids may lie anywhere.
    An id, or null, that has many rows is a range of its own, cut into parts by a hash of
    the text: its tie, which is null for all other rows.
    """
    n = docs.count()
    ranges = min(RANGES, max(1, n // RANGE))
    rate = min(1.0, SAMPLED * ranges / max(n, 1))
    counts: dict[int | None, int] = {}
    for (i,) in docs.select("doc_id").sample(rate, 7).collect() if ranges > 1 else ():
        counts[i] = counts.get(i, 0) + 1
    hot = {i: min(PARTS, -(-c // SAMPLED)) for i, c in counts.items() if c >= 4 * SAMPLED}
    known = sorted(i for i in counts if i is not None)
    bounds, held = [], 0
    for i in known:
        if i in hot or held >= SAMPLED:
            bounds.append(i)
            held = 0
        held += counts[i]
        if i in hot and i < (1 << 63) - 1:
            bounds.append(i + 1)
            held = 0
    bounds = sorted(set(bounds))
    doc = F.col("doc_id")
    if not bounds:
        at = F.lit(0)
    else:
        listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
        at = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= len(bounds)) & (F.get(listed, low + step - 1) <= doc), low + step).otherwise(low))
    at = F.when(doc.isNull(), F.lit(-1)).otherwise(at).cast("long")
    if not hot:
        return at, F.lit(None).cast("long")
    tie = F.when(F.coalesce(doc.isin([i for i in hot if i is not None]), F.lit(False)) | (doc.isNull() & F.lit(None in hot)), F.xxhash64("text"))
    parts = F.lit(hot.get(None, 1))
    for i, k in hot.items():
        if i is not None:
            parts = F.when(doc == i, F.lit(k)).otherwise(parts)
    part = F.floor(F.shiftrightunsigned(tie, 32) * parts / F.lit(float(1 << 32))).cast("long")
    return at * PARTS + (PARTS - 1) - F.coalesce(part, F.lit(0)), F.when(tie.isNotNull(), F.shiftrightunsigned(tie, 32))


def ordered(docs: DataFrame) -> DataFrame:
    """bucket, pos, doc_id, text, next_text, edge: each document with the text of the next one.

    The order is by falling doc_id (null last; equal ids by text, where they have many rows
    by a hash of it first), and after the last document comes the first. Rows are dealt to
    ranges, and a copy of the first document of each range goes to the end of the range
    before, as its edge; so the text is shuffled once and no range has many more rows than
    another. Rows that repeat entirely stay in one range.
    """
    bucket, tie = ranged(docs)
    rows = docs.withColumn("_own", bucket).withColumn("_tie", tie)
    tops = rows.groupBy("_own").agg(F.max("doc_id").alias("_top"), F.min("_tie").alias("_first"))
    before = F.coalesce(F.lead("_own").over(Window.orderBy("_own")), F.min("_own").over(Window.partitionBy()))
    edges = tops.select(F.col("_own").alias("_of"), "_top", "_first", before.alias("_to"))
    rows = rows.join(F.broadcast(edges), F.col("_own") == F.col("_of"))
    first = F.col("doc_id").eqNullSafe(F.col("_top")) & F.col("_tie").eqNullSafe(F.col("_first"))
    to = F.array_compact(F.array(F.struct(F.col("_own").alias("bucket"), F.lit(False).alias("edge")), F.when(first, F.struct(F.col("_to").alias("bucket"), F.lit(True).alias("edge")))))
    rows = rows.select("doc_id", "text", "_tie", F.explode(to).alias("_to")).select("_to.bucket", "_to.edge", "doc_id", "text", "_tie")
    # never null; said here, so that both readers of these rows have one plan and one shuffle
    rows = rows.where(F.col("bucket").isNotNull())
    line = Window.partitionBy("bucket").orderBy("edge", F.desc_nulls_last("doc_id"), "_tie", "text")
    return rows.select("bucket", F.row_number().over(line).alias("pos"), "doc_id", "text", F.lead("text").over(line).alias("next_text"), "edge")


def matched(a: Column, b: Column) -> Column:
    """For each register of two fingerprints (as numbers): how far its anchor's places are apart, -1 if the anchors differ, -2 if both have none."""
    lane = lambda x, i: F.shiftright(x, WIDE * (LANES - 1 - i)).bitwiseAND(F.lit((1 << WIDE) - 1))

    def told(x: Column, y: Column) -> Column:
        apart = (x - y).bitwiseAND(F.lit((1 << PLACE) - 1))
        return F.when((x == 0) & (y == 0), F.lit(-2)).when(F.shiftright(x, PLACE) != F.shiftright(y, PLACE), F.lit(-1)).otherwise(apart)

    return F.flatten(F.zip_with(a, b, lambda x, y: F.array(*[told(lane(x, i), lane(y, i)) for i in range(LANES)])))


def likeness(registers: Column) -> Column:
    """Of `matched` registers, those that agree by those filled in either, 0 to 1; two empty fingerprints are alike.

    A register agrees if its anchor is at the same place in both texts, or as far apart as
    another one's: a shared passage has all its anchors the same way apart, wherever it stands.
    """
    same = F.filter(registers, lambda v: v >= 0)
    alone = F.filter(F.array_distinct(same), lambda v: (v != 0) & (F.size(F.filter(same, lambda w: w == v)) == 1))
    filled = F.size(F.array_remove(registers, -2))
    return F.when(filled == 0, F.lit(1.0)).otherwise((F.size(same) - F.size(alone)) / F.greatest(filled, F.lit(1)))


def registers(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys and numbers, which hold the registers: rows whose keys are equal make one fingerprint.

    If rows are dealt by one of the keys, nothing is shuffled: both sums are taken in place.
    Texts without a syncmer have no row here.
    """
    hashes = anchors(rows, text, keys)
    far = (1 << 30) - 1
    packed = F.shiftleft(F.shiftrightunsigned("hash", 31), 30).bitwiseOR(F.least(F.col("place"), F.lit(far)).cast("long"))
    lane = hashes.select(*keys, F.col("hash").bitwiseAND(F.lit(REGISTERS - 1)).cast("int").alias("_reg"), packed.alias("_v"))
    least = lane.groupBy(*keys, "_reg").agg(F.min("_v").alias("_v"))
    hashed = F.shiftleft(F.pmod(F.shiftright("_v", 30), F.lit((1 << BITS) - 1)) + 1, PLACE)
    value = hashed.bitwiseOR(F.col("_v").bitwiseAND(F.lit((1 << PLACE) - 1)))
    placed = least.select(*keys, F.floor(F.col("_reg") / LANES).cast("int").alias("_number"), value.alias("_value"), F.pmod("_reg", F.lit(LANES)).alias("_lane"))
    power = F.element_at(F.array(*[F.lit(1 << WIDE * (LANES - 1 - i)) for i in range(LANES)]).cast("array<bigint>"), F.col("_lane") + 1)
    placed = placed.select(*keys, "_number", (F.col("_value") * power).alias("_part"))
    sums = placed.groupBy(*keys).agg(*[F.sum(F.when(F.col("_number") == i, F.col("_part")).otherwise(F.lit(0))).alias(f"_s{i}") for i in range(NUMBERS)])
    return sums.select(*keys, F.array(*[f"_s{i}" for i in range(NUMBERS)]).alias("numbers"))


def shown(numbers: Column) -> Column:
    """A fingerprint as text: 16 hex digits for each number."""
    return F.array_join(F.transform(numbers, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def none_filled() -> Column:
    """The numbers of an empty text."""
    return F.array_repeat(F.lit(0).cast("long"), NUMBERS)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and fingerprint of each document, for any table with an id; null texts are empty.

    Rows that repeat an id make one fingerprint, of all their texts. Texts of any length are
    read whole; other columns are ignored; an empty table gives none.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    found = registers(rows.where("text <> ''").repartition("id"), "text", ["id"])
    ids = rows.select(F.col("id").alias("_id")).distinct()
    return ids.join(found, F.col("_id").eqNullSafe(F.col("id")), "left").select(F.col("_id").alias("id"), shown(F.coalesce("numbers", none_filled())).alias("fingerprint"))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the start of the next document's text instead of its own second
    half. A null text is empty; the fingerprint of an empty text is all zeros. Null ids come
    last, ties of ids are in the order of their texts. Repeated rows each have a place in the
    order; a table of one row has itself as the next; texts of any length are read whole;
    an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    rows = ordered(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    rows = rows.select("bucket", "pos", "edge", "doc_id", "text", F.when(~F.col("edge"), edited).alias("edited"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))
    bodies = rows.select("bucket", "pos", F.explode(kinds).alias("_k")).select("bucket", "pos", "_k.kind", "_k.body").where("body <> ''")
    found = registers(bodies, "body", ["bucket", "pos", "kind"])
    pairs = found.groupBy("bucket", "pos").agg(*[F.max(F.when(F.col("kind") == k, F.col("numbers"))).alias(n) for k, n in ((0, "_own"), (1, "_edited"))])
    told = rows.select("bucket", "pos", "edge", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    both = told.join(pairs, ["bucket", "pos"], "left").select(*told.columns, *[F.coalesce(c, none_filled()).alias(c) for c in ("_own", "_edited")])
    after = both.withColumn("_next", F.lead("_own").over(Window.partitionBy("bucket").orderBy("pos"))).where(~F.col("edge"))
    near = after.select("*", matched(F.col("_own"), F.col("_edited")).alias("_to_edited"), matched(F.col("_own"), F.col("_next")).alias("_to_next"))
    return near.select("doc_id", "n_chars", "edited_sha256", shown(F.col("_own")).alias("fingerprint"), shown(F.col("_edited")).alias("edited_fingerprint"), likeness(F.col("_to_edited")).alias("near_edited"), likeness(F.col("_to_next")).alias("near_next"))
