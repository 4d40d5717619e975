"""Near-duplicate documents by an LSH forest, every link confirmed on full shingle sets.

Documents with equal shingle sets become one class at once. Each class has a MinHash
signature, and each tree of the forest sorts the classes by its own order of the signature's
values. Neighbours in a sorted order have the longest common prefix and are the candidates: at
most two a tree and class, in a region of any density. What shares a prefix of DEPTH values is
a region, and depth follows the region: one with more than DENSE classes is sorted again, by as
many further values as its size asks for. Of its candidates each class proposes the few
whose signatures are most like its own.

Regions whose classes are not yet one component are joined exactly (:func:`families`): every
set is told by its difference from what most of its family share, so near copies with few
changes are linked to one centre by arithmetic, and only sets that differ in the same places
have to be compared. Links come out, a star and what is left, never the pairs of a family.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import HOT_KEYS, lookup, text_of, written
from spanloom.llm.components import components

#: Trees, values of a region's prefix, values of a signature. A pair with similarity 0.8 misses all regions with a chance of 3e-6.
TREES, DEPTH = 24, 4
SIGNATURE = TREES * DEPTH
#: Equal values (of SIGNATURE) below which a pair is not looked at: at 0.8 the chance to be below is 1e-8.
IN_DOUBT = 55
#: Classes of a region from which it is sorted by more values; partners a class proposes in the first pass.
DENSE, PROPOSED = 8, 3
#: Families whose common shingles are broadcast, and how many shingles each may have at most: 20 MB in all.
HOT_FAMILIES, CORE = 48, 50_000
WORD_MEMO = 100_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(11)
FACTORS = _rng.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)

_WORDS: dict[bytes, int] = {}


def words_of(text: str) -> list[bytes]:
    """Words between white space, with A-Z in lower case."""
    return text.encode().lower().split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str, width: int = 4) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than a shingle make one."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    try:
        codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_WORDS) > WORD_MEMO:
            _WORDS.clear()
        for w in words:
            if w not in _WORDS:
                _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(width, len(codes))
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * MULTIPLIER + codes[k : len(codes) - n + 1 + k]
    return np.unique(mixed(h))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures of non-empty sets, one row each."""
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), SIGNATURE), np.uint32)
    for k in range(SIGNATURE):
        out[:, k] = np.minimum.reduceat((flat * FACTORS[k] + SHIFTS[k]) >> np.uint64(32), starts)
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
    if not small or 100 * small < percent * large:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, set_id, sig of each row; set_id is a digest of the set, null when it is empty."""

    def sketched(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingles(t, width) for t in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs = dict(zip(full, signatures([sets[i] for i in full]) if full else [], strict=True))
                cols = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.md5(s.tobytes()).hexdigest() if len(s) else None for s in sets], pa.string()), pa.array([sigs[i].tobytes() if i in sigs else None for i in range(len(sets))], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "set_id", "sig"])

    return docs.mapInArrow(sketched, "doc_id long, n long, set_id string, sig binary")


def region_of(sig: np.ndarray, tree: int) -> np.ndarray:
    """The regions of signatures in a tree: a hash of the tree and of the first DEPTH values of its order."""
    region = np.full(len(sig), tree + 1, np.uint64)
    for k in range(tree * DEPTH, tree * DEPTH + DEPTH):
        region = mixed(region * MULTIPLIER + sig[:, k].astype(np.uint64))
    return region


def forest_rows(reps: DataFrame) -> DataFrame:
    """region, deep, id: the place of each class in each tree; deep is the order within a region."""

    def placed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, SIGNATURE).astype(np.uint64)
            for tree in range(TREES):
                order = (np.arange(2 * DEPTH) + tree * DEPTH) % SIGNATURE
                region = region_of(sig, tree)
                deep = np.zeros(len(ids), np.uint64)
                for k in order[DEPTH:]:
                    deep = deep << np.uint64(16) | (sig[:, k] >> np.uint64(16))
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(deep.view(np.int64)), pa.array(ids, pa.int64())], ["region", "deep", "id"])

    return reps.select("id", "sig").mapInArrow(placed, "region long, deep long, id long")


def neighbours(rows: DataFrame) -> DataFrame:
    """region, a, b: neighbours in the sorted orders. a equals b where a partition begins or ends.

    The orders are cut into ranges of (region, deep, id), so a region of any size is spread
    over tasks; the rows with a equal to b keep the members at the cuts.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["region", "deep", "id"]

    def chained(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            region, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            if last is None:
                region, ids = np.concatenate([region[:1], region]), np.concatenate([ids[:1], ids])
            else:
                region, ids = np.concatenate([[last[0]], region]), np.concatenate([[last[1]], ids])
            same = region[1:] == region[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(region[1:][same], pa.int64()), pa.array(ids[:-1][same], pa.int64()), pa.array(ids[1:][same], pa.int64())], ["region", "a", "b"])
            last = (region[-1], ids[-1])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([last[1]], pa.int64())], ["region", "a", "b"])

    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(chained, "region long, a long, b long")


def deeper(members: DataFrame, reps: DataFrame) -> DataFrame:
    """region, deep, id of members (region, size, id), sorted by more values the more a region holds.

    Two sets with similarity 0.8 agree in a value with that chance, so among `size` of them the
    nearest share about log(size) / log(1.25) values beyond the region's; a region gets as many,
    up to the whole order of its tree.
    """

    def placed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            region = batch.column(0).to_numpy(zero_copy_only=False)
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, SIGNATURE)
            tree = np.zeros(len(region), np.int64)
            for t in range(TREES):
                tree[region_of(sig, t).view(np.int64) == region] = t
            depth = np.minimum(SIGNATURE - DEPTH, np.ceil(np.log(sizes) / np.log(1.25)).astype(np.int64))
            deep = [np.roll(s, -(t + 1) * DEPTH)[:d].astype(">u4").tobytes() for s, t, d in zip(sig, tree, depth, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deep, pa.binary()), batch.column(2)], ["region", "deep", "id"])

    rows = members.join(reps.select("id", "sig"), "id").select("region", "size", "id", "sig")
    return rows.mapInArrow(placed, "region long, deep binary, id long")


def alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b, equal: the pairs whose signatures agree in IN_DOUBT values or more, and in how many."""

    def counted(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, SIGNATURE) for i in (2, 3))
            equal = (x == y).sum(1)
            kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(equal, pa.int64())], ["a", "b", "equal"])
            yield kept.filter(pa.array(equal >= IN_DOUBT))

    sig = reps.select("id", "sig").dropDuplicates(["id"])
    rows = pairs.join(sig.toDF("a", "x"), "a").join(sig.toDF("b", "y"), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(counted, "a long, b long, equal long")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    texts: id, text. The text of b goes to each of its pairs and the pairs of one a follow its
    own text, so a task holds the set of one a and reads the rest row by row.
    """
    heads = pairs.select("a").distinct().join(texts, F.col("a") == F.col("id")).select("a", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(pairs.join(texts, F.col("b") == F.col("id")).select("a", "b", "text"))
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def checked(batches):
        head, own = None, None
        for batch in batches:
            found = []
            for a, b, text in zip(*batch.columns, strict=True):
                a, b = a.as_py(), b.as_py()
                if b is None:
                    head, own = a, shingles(text.as_py(), width)
                elif a == head and linked(own, shingles(text.as_py(), width), percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.repartition(n, "a").sortWithinPartitions("a", F.asc_nulls_first("b")).mapInArrow(checked, "a long, b long")


def own_texts(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """id, text: for each of reps (id, set_id) a text with that set, of the rows with that id."""

    def told(batches):
        for batch in batches:
            fits = [hashlib.md5(shingles(t.as_py(), width).tobytes()).hexdigest() == s.as_py() for t, s in zip(batch.column(1), batch.column(2), strict=True)]
            yield batch.select(["id", "text"]).filter(pa.array(fits, pa.bool_()))

    found = docs.join(reps.select("id", "set_id"), F.col("doc_id") == F.col("id")).select("id", "text", "set_id")
    return found.mapInArrow(told, "id long, text string").dropDuplicates(["id"])


def sets_of(rows: DataFrame, width: int) -> DataFrame:
    """rows (family, size, component, id, text) with n and items, the shingles, instead of the text."""

    def listed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingles(t.as_py(), width).view(np.int64) for t in part.column(4)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["family", "size", "component", "id", "n", "items"])

    return rows.select("family", "size", "component", "id", "text").mapInArrow(listed, "family long, size long, component long, id long, n long, items array<long>")


def families(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that make every two linked sets of a family one component, exactly.

    members: family, size, component, id. The core of a family is what more than half of its
    sets hold, and D(a) the shingles in which a differs from the core. As
    |a ^ b| = |D(a) ^ D(b)|, sets a and b are linked if and only if

        slack(a) + slack(b) + 2 * (100 + percent) * |D(a) & D(b)| >= 0,
        slack(a) = (100 - percent) * |a| - (100 + percent) * |D(a)|.

    A pair that is linked without the last term is linked, as both are, to the set of the
    family with the most slack: those links are a star. Any other pair has a set outside the
    star and shares differences, which are indexed by their rarest (prefix filter): a set that
    needs k shared differences and has r that another set has too is looked up by the r-k+1
    rarest of them. The shared differences alone then tell the pairs.
    """
    gain = 2 * (100 + percent)
    sets = written(sets_of(members.join(texts, "id"), width), "sets")
    counts = written(sets.select("family", "size", F.explode("items").alias("item")).groupBy("family", "item").agg(F.count(F.lit(1)).alias("c"), F.max("size").alias("size")).where("c > 1"), "counts")
    cores = counts.where("2 * c > size").groupBy("family").agg(F.collect_list("item").alias("core"), F.max("size").alias("size"))
    keyed = sets.withColumn("key", F.col("family").cast("string"))
    told = lookup(keyed, cores.select(F.col("family").cast("string").alias("key"), "core", "size"), "key", ["core"], "size", F.concat(F.lit("#"), F.col("id").cast("string")), HOT_FAMILIES, F.size("core") <= CORE)
    core = F.coalesce("core", F.array().cast("array<long>"))
    differ = told.select("family", "component", "id", "n", F.concat(F.array_except("items", core), F.array_except(core, "items")).alias("differ"))
    differ = differ.withColumn("slack", (100 - percent) * F.col("n") - (100 + percent) * F.size("differ"))
    differ = written(differ, "differences")

    best = differ.groupBy("family").agg(F.max(F.struct("slack", "id")).alias("best"), F.count(F.lit(1)).alias("size")).select(F.col("family").cast("string").alias("key"), F.col("best.slack").alias("most"), F.col("best.id").alias("centre"), "size")
    slim = differ.select("family", "component", "id", "slack", F.col("family").cast("string").alias("key"))
    slim = written(lookup(slim, best, "key", ["most", "centre"], "size", F.concat(F.lit("#"), F.col("id").cast("string"))).drop("key"), "slack")
    star = slim.where("slack + most >= 0 AND id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))

    shared = counts.withColumn("rare", F.when(2 * F.col("c") > F.col("size"), F.col("size") - F.col("c")).otherwise(F.col("c"))).where("rare > 1").select("family", "item", "rare")
    hot = shared.orderBy(F.desc("rare"), "family", "item").limit(HOT_KEYS).select("family", "item", F.col("rare").alias("often"))
    each = differ.select("family", "id", F.explode("differ").alias("item")).join(F.broadcast(hot), ["family", "item"], "left")
    common = each.where("often IS NOT NULL").select("id", F.col("often").alias("rare"), "item")
    common = common.unionByName(each.where("often IS NULL").join(shared, ["family", "item"]).select("id", "rare", "item"))
    rest = common.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rare", "item"))).alias("rest"))
    rest = slim.join(rest, "id").withColumn("r", F.size("rest")).withColumn("out", F.col("slack") + F.col("most") < 0)
    least = F.when(F.col("out"), F.ceil(-(F.col("slack") + F.col("most")) / gain)).otherwise(F.floor((F.col("most") - F.col("slack")) / gain) + 1).cast("int")
    rest = written(rest.withColumn("least", least).where("least <= r").withColumn("rest", F.col("rest.item")).drop("most", "centre"), "rest")
    index = rest.select("family", "component", "id", "slack", "r", "out", F.explode(F.slice("rest", 1, F.col("r") - F.col("least") + 1)).alias("item"))
    x, y = index.where("out").alias("x"), index.alias("y")
    may = (F.col("x.slack") + F.col("y.slack") + gain * F.least("x.r", "y.r") >= 0) & (F.col("x.component") != F.col("y.component")) & (~F.col("y.out") | (F.col("x.id") < F.col("y.id")))
    pairs = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.item") == F.col("y.item")) & may).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), (F.col("x.slack") + F.col("y.slack")).alias("slack")).distinct()
    own = rest.select("id", "rest")
    both = pairs.join(own.toDF("a", "_x"), "a").join(own.toDF("b", "_y"), "b")
    return star.unionByName(both.where(F.col("slack") + gain * F.size(F.array_intersect("_x", "_y")) >= 0).select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text).

    Two documents are linked when their sets of word shingles share at least percent/100 of
    their union; component_id is the smallest doc_id reachable, and kept marks its document.
    A text that is null or without words has no shingles, is linked with nothing and kept.
    Rows with a null doc_id are linked with nothing, have a null component_id and are kept.
    Repeated rows give repeated rows. Rows that repeat a doc_id with different texts go by their
    own texts; where the same doc_id is the smallest of two sets, these are one class, and the
    set with the smaller digest is compared with others. Ties of likeness go to the smaller
    doc_id. Texts of any length are read whole, a row at a time. Other columns, whatever their
    names, are ignored. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    sketched = written(sketch(docs, width), "sketches")
    classes = sketched.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    spread = F.concat(F.lit("#"), F.coalesce(F.col("doc_id"), F.xxhash64("sig")).cast("string"))
    classed = lookup(sketched, classes, "set_id", ["rep"], "copies", spread)
    own = F.col("doc_id") == F.col("rep")
    rep = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    classed = written(classed.select("doc_id", "n", rep.alias("rep"), *[F.when(own, F.col(c)).alias(c) for c in ("set_id", "sig")]), "classes")
    reps = written(classed.where("sig IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct("set_id", "sig")).alias("own")).select("id", "own.*"), "signatures")

    near = written(neighbours(forest_rows(reps)), "neighbours")
    members = near.select("region", F.explode(F.array("a", "b")).alias("id")).distinct()
    members = written(members.withColumn("key", F.col("region").cast("string")), "members")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    spread = F.concat(F.lit("#"), F.col("id").cast("string"))
    members = written(lookup(members, sizes.where("size > 1"), "key", ["size", "first"], "size", spread).where("size > 1"), "regions")
    more = neighbours(deeper(members.where(F.col("size") > DENSE), reps))
    met = near.unionByName(more).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    scored = alike(met, reps)
    ends = scored.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e"), "a", "b", "equal")
    nth = F.row_number().over(Window.partitionBy("e.id").orderBy(F.desc("equal"), "e.to"))
    proposed = written(ends.withColumn("nth", nth).where(F.col("nth") <= PROPOSED).select("a", "b").distinct(), "proposed")
    texts = written(own_texts(docs, reps.join(members.select("id").distinct(), "id"), width), "texts")
    label = components(confirm(proposed, texts, width, percent))

    labelled = members.join(label, "id", "left").select("key", "first", "size", "id", F.coalesce("component", "id").alias("component"))
    labelled = written(labelled, "labelled")
    mixed_up = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("size").alias("size")).where("low < high")
    several = written(lookup(labelled.drop("size"), mixed_up, "key", ["low", "size"], "size", spread).where("low IS NOT NULL"), "several")
    family = components(several.select(F.col("first").alias("a"), F.col("id").alias("b"))).select("id", F.col("component").alias("family"))
    family = written(several.select("id", "component").distinct().join(family, "id").withColumn("key", F.col("family").cast("string")), "families")
    family = lookup(family, family.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key", ["size"], "size", spread)
    links = families(family.select("family", "size", "component", "id"), texts, width, percent)
    to = label.select(F.col("id").alias("_id"), "component")
    for end in ("a", "b"):
        links = links.join(to, F.col(end) == F.col("_id"), "left").withColumn(end, F.coalesce("component", end)).drop("_id", "component")
    merged = components(links)
    joined = label.join(merged.select(F.col("id").alias("component"), F.col("component").alias("_top")), "component", "left").select("id", F.coalesce("_top", "component").alias("top"))
    alone = merged.join(label, "id", "left_anti").select("id", F.col("component").alias("top"))
    tops = written(joined.unionByName(alone), "tops")

    sized = classed.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).join(tops, F.col("rep") == F.col("id")).select(F.col("rep").cast("string").alias("key"), "top", "n")
    rows = lookup(classed.select("doc_id", F.col("n").alias("n_shingles"), "rep", F.col("rep").cast("string").alias("key")), sized, "key", ["top"], "n", F.concat(F.lit("#"), F.col("doc_id").cast("string")))
    component = F.coalesce("top", "rep")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
