"""Near-duplicate links by bottom-k sketches of word shingles, verified exactly.

One hash function orders all shingles.  A document's sketch holds its
``SKETCH`` smallest hashes; up to that size it is the whole set.  The smallest
hashes of the union of two documents belong to both sketches wherever both
documents have them, so sketches alone give an estimate of the similarity.

1. Texts with the same words are one class; each class is sketched once.
2. Inverted lists: two retained values that are neighbours in a sketch make a
   list.  Values that very many sketches hold, as those of a passage that many
   texts share, are left out before, so lists stay short; a sketch that mostly
   has such values also lists its runs of three with them, which is how large
   groups of copies meet, and sets of at most ``TINY`` shingles list each value.
   Of the first ``SKETCH`` values of the union, a linked pair shares each with
   probability 0.75; that no two in a row are shared has a chance below 1e-20,
   and below 1e-7 where half of the values are hot.
3. Every list links its members to the one that meets most others in its lists,
   which is linear in the list.  The pairs are filtered by the union sketch, then verified on the full
   sets.
4. Lists whose members are not yet all in one component hold further pairs
   across components.  The members' full sets are ordered, common shingles
   last: linked sets then share one of the first quarter (a seventh for the
   smaller set), at places that leave room for the rest.  Only pairs that do are
   compared, so texts around one much-copied text that differ in shingles of
   their own never unfold into all their pairs.  This filter is exact; the
   sample that tells common shingles only decides how much it spares.
5. Components by alternating star contraction.

Edge cases: without words or text a document is linked with nothing; fewer
words than a shingle give one shingle; repeated rows are one class; a row with
a NULL id joins no component and keeps NULL as its component; an empty table
gives an empty result.  Ids that repeat with other texts are one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from inkveil.llm.common import batch_udf, is_empty, small_or_all, staged

SHINGLE = 5
PERCENT = 75
SKETCH, RUN, COLD_RUN, TINY = 96, 3, 2, 8
# A value is hot if so many sketches hold it, or more than this share of all retained values.
HOT, HOT_SHARE = 1000, 200_000
# With fewer cold values than these, or than half of the sketch, a sketch also lists its runs with hot values.
LEAST_COLD = 40
# Estimates below this share of the threshold are dropped only if this many standard errors away from it.
ERRORS = 5.0
# Lists with members in several components are compared in blocks of so many.
BLOCK = 256
# Shingles in so many of the texts of one in ``COMMON_SHARE`` are common; they are marked in a bitmap of 2 ** BITS.
COMMON, COMMON_SHARE, BITS = 3, 16, 23
# Common shingles meet only between sets of sizes that may be linked; sizes of one class differ by this factor at most.
SIZE_CLASS = 1.05
# Ids of documents to be verified are broadcast if counted to be at most so many; else joined by a shuffle.
BROADCAST_IDS = 500_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
# Words are hashed as polynomials of their bytes modulo two primes, whose residues make 62 bits.
_PRIMES, _BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 1_597_334_677)
# Bytes of a text are hashed in blocks of about so many.
TEXT_BLOCK = 1 << 20
# Values of full sets handed on at a time, and bytes of a row group of their table.
SET_VALUES, ROW_GROUP = 1 << 19, 16 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all positions."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> tuple[np.ndarray, list[np.ndarray]]:
    """Per byte whether it is part of a word, and its value modulo each prime; A-Z count as a-z."""
    part = np.ones(256, np.int8)
    part[[0x20, *range(0x09, 0x0E)]] = 0
    lower = np.arange(256)
    lower[65:91] += 32
    with np.errstate(over="ignore"):
        value = mixed((lower.astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[0])
    return part, [value % np.uint64(p - 1) + np.uint64(1) for p in _PRIMES]


_PART, _VALUES = _byte_values()


def _powers(base: int, p: int, size: int) -> np.ndarray:
    """The first powers of ``base`` modulo ``p``, ``size`` at least, by doubling."""
    powers = np.ones(1, np.uint64)
    while len(powers) < size:
        powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), p)) % np.uint64(p)])
    return powers


class Hasher:
    """64-bit hashes of the words of a text and of its shingles; powers are kept for the next text."""

    def __init__(self) -> None:
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []

    def _grow(self, size: int) -> None:
        if not self.powers or len(self.powers[0][0]) < size:
            size = max(size, 1 << 16)
            self.powers = [(_powers(b, p, size), _powers(pow(b, -1, p), p, size)) for b, p in zip(_BASES, _PRIMES)]

    def words(self, text: str | None) -> np.ndarray:
        """The hash of each word: per prime the sum of its bytes' values times powers, shifted to the word's begin."""
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        found = []
        at = 0
        while at < len(data):
            end = min(len(data), at + TEXT_BLOCK)
            while end < len(data) and _PART[data[end]]:  # a block ends between words
                rest = np.flatnonzero(_PART[data[end : end + TEXT_BLOCK]] == 0)
                end = end + int(rest[0]) if len(rest) else min(len(data), end + TEXT_BLOCK)
            block = data[at:end]
            self._grow(len(block) + 1)
            edges = np.diff(np.concatenate([[0], _PART[block], [0]]).astype(np.int8))
            starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            own = np.zeros(len(starts), np.uint64)
            for value, (powers, inverse), p in zip(_VALUES, self.powers, map(np.uint64, _PRIMES)):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[block] * powers[: len(block)] % p, dtype=np.uint64)])
                own = own << np.uint64(31) | (sums[ends] - sums[starts]) % p * inverse[starts] % p
            with np.errstate(over="ignore"):
                found.append(mixed(own + (ends - starts).astype(np.uint64) * _MULTIPLIERS[1]))
            at = end
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    @staticmethod
    def shingles(words: np.ndarray) -> np.ndarray:
        """Sorted distinct hashes of the shingles of word hashes."""
        if not len(words):
            return words
        n = max(1, len(words) - SHINGLE + 1)
        total = np.full(n, min(len(words), SHINGLE), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(SHINGLE, len(words))):
                total = mixed(total + words[k : k + n] * _MULTIPLIERS[k])
        return np.unique(total)


def runs(values: np.ndarray, length: int) -> np.ndarray:
    """A key for each ``length`` values that are neighbours."""
    n = max(0, len(values) - length + 1)
    with np.errstate(over="ignore"):
        key = values[:n] + np.uint64(length)
        for k in range(1, length):
            key = mixed(key * np.uint64(3) + values[k : n + k])
    return key


def list_keys(sketch: np.ndarray, size: int, hot: np.ndarray) -> np.ndarray:
    """Keys of the inverted lists that a sketch belongs to; ``hot`` is sorted."""
    cold = sketch
    if len(hot):
        place = np.searchsorted(hot, sketch).clip(max=len(hot) - 1)
        cold = sketch[hot[place] != sketch]
    keys = [runs(cold, COLD_RUN)]
    if len(cold) < max(len(sketch) / 2, LEAST_COLD):
        keys.append(runs(sketch, RUN))
    if size <= TINY:
        keys.append(mixed(sketch + np.uint64(1)))
    return np.unique(np.concatenate(keys))


def estimate_fails(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int) -> bool:
    """Whether the union sketch rules a link out."""
    if 100 * min(size_a, size_b) < PERCENT * max(size_a, size_b):
        return True
    union = np.union1d(a, b)
    whole = size_a <= SKETCH and size_b <= SKETCH
    if not whole:
        union = union[:SKETCH]
    both = len(np.intersect1d(np.intersect1d(a, union, assume_unique=True), b, assume_unique=True))
    share, t = both / len(union), PERCENT / 100
    # The smallest hashes of the union are drawn from it without putting back; at the threshold it has so many.
    left = max(0.0, 1 - len(union) * (1 + t) / (size_a + size_b))
    margin = 0.0 if whole else ERRORS * (t * (1 - t) * left / len(union)) ** 0.5 + 1 / len(union)
    return share < t - margin - 1e-12


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


_SKETCHES = "words_key binary, n_shingles long, sketch array<long>"


@batch_udf(_SKETCHES)
def _sketches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hasher = Hasher()
    for batch in texts:
        rows = []
        for text in batch:
            words = hasher.words(text)
            key = hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None
            values = hasher.shingles(words)
            rows.append((key, len(values), as_long(values[:SKETCH])))
        yield pd.DataFrame(rows, columns=["words_key", "n_shingles", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, set`` of ``node, text``, a few megabytes at a time however long the texts are."""
    hasher = Hasher()
    for batch in batches:
        nodes, sets = [], []
        for place, (node, text) in enumerate(zip(batch.column("node"), batch.column("text")), 1):
            nodes.append(node.as_py())
            sets.append(as_long(hasher.shingles(hasher.words(text.as_py()))))
            if place == batch.num_rows or sum(map(len, sets)) > SET_VALUES:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])
                nodes, sets = [], []


def _prefixes(common: np.ndarray):
    """Per set of ``_sets`` its size, the first quarter of its values, common ones last, and how many of these are not."""

    def ordered_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sets(batches):
            sizes, prefixes, rare = [], [], []
            for one in batch.column("set"):
                values = one.values.to_numpy()
                bucket = values.view(np.uint64) >> np.uint64(64 - BITS)
                marked = (common[bucket >> np.uint64(6)] >> (bucket & np.uint64(63)) & np.uint64(1)).astype(bool)
                length = len(values) - (PERCENT * len(values) + 99) // 100 + 1 if len(values) else 0
                sizes.append(len(values))
                prefixes.append(np.concatenate([values[~marked], values[marked]])[:length])
                rare.append(int((~marked).sum()))
            arrays = [batch.column("node"), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(rare, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "n", "prefix", "rare"])

    return ordered_prefixes


def _list_keys(hot: np.ndarray):
    @batch_udf("array<long>")
    def keys(sketches: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series(
            [as_long(list_keys(np.asarray(s, np.int64).view(np.uint64), n, hot)) for s, n in zip(sketches, sizes)], dtype=object
        )

    return keys("sketch", "n_shingles")


def hot_values(nodes: DataFrame) -> np.ndarray:
    """The values in more than ``HOT`` sketches, or in more than one in ``HOT_SHARE`` of all retained values, sorted.

    So there are at most ``HOT_SHARE`` of them, whatever the input.
    """
    counted = nodes.select(F.explode("sketch").alias("value")).groupBy("value").count()
    total = nodes.agg(F.sum(F.size("sketch"))).first()[0] or 0
    rows = counted.where(F.col("count") > max(HOT, total / HOT_SHARE)).select("value").collect()
    return np.sort(np.array([r.value for r in rows], np.int64).view(np.uint64))


@batch_udf("boolean")
def _may_link(a: pd.Series, size_a: pd.Series, b: pd.Series, size_b: pd.Series) -> pd.Series:
    def unsigned(x):
        return np.asarray(x, np.int64).view(np.uint64)

    return pd.Series(
        [not estimate_fails(unsigned(x), n, unsigned(y), m) for x, n, y, m in zip(a, size_a, b, size_b)], dtype=bool
    )


@batch_udf("boolean")
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact: the sets are sorted arrays of hashes."""

    def link(x, y) -> bool:
        both = len(np.intersect1d(np.asarray(x), np.asarray(y), assume_unique=True))
        return 100 * both >= PERCENT * (len(x) + len(y) - both)

    return pd.Series([link(x, y) for x, y in zip(a, b)], dtype=bool)


def one_row_each(rows: DataFrame, doc_id: str) -> DataFrame:
    """One of the rows of each id, and all without one.  Only rows whose id comes again are shuffled."""
    again = rows.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.count("*").alias("times")).where("times > 1").select(doc_id)
    again = staged(again, "near-again")
    if is_empty(again):
        return rows
    again = small_or_all(again, BROADCAST_IDS)
    return rows.join(again, doc_id, "left_anti").unionByName(rows.join(again, doc_id, "left_semi").dropDuplicates([doc_id]))


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs ``a, b`` those that are linked: by union sketch, then on full sets of what is left."""

    def side(of: DataFrame, name: str, *columns: str) -> DataFrame:
        return of.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    hopeful = staged(
        pairs.join(side(sketches, "a", "n_shingles", "sketch"), "a").join(side(sketches, "b", "n_shingles", "sketch"), "b")
        .where(_may_link("a_sketch", "a_n_shingles", "b_sketch", "b_n_shingles")).select("a", "b"),
        "near-hopeful",
    )
    wanted = hopeful.select(F.col("a").alias("node")).union(hopeful.select("b")).distinct()
    texts = one_row_each(sets.join(small_or_all(wanted, BROADCAST_IDS), "node", "left_semi"), "node")
    full = staged(texts.select("node", "text").mapInArrow(_sets, "node long, set array<long>"), "near-sets", ROW_GROUP)
    return (
        hopeful.join(side(full, "a", "set"), "a").join(side(full, "b", "set"), "b")
        .where(_linked("a_set", "b_set")).select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of all nodes in links ``a, b``: the smallest node reachable.

    Alternating large and small stars: each round points the larger
    neighbours of a node, then a node's smaller neighbours, to the smallest
    one.  Minima are taken map-side, so hubs are no burden.
    """
    edges = staged(links.select("a", "b").where("a <> b"), "near-links")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        after = staged(small.where("a <> b").distinct(), "near-stars")
        if after.count() == edges.count() and is_empty(after.join(edges, ["a", "b"], "left_anti")):
            roots = after.select(F.col("b").alias("node")).distinct()
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                roots.select("node", F.col("node").alias("component"))
            )
        edges = after


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, words_key, n_shingles, sketch`` per row; equal words have equal keys, no words have none."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), _sketches(text).alias("s")).select("doc_id", "s.*")


def classes(rows: DataFrame) -> DataFrame:
    """Per class of texts with the same words: ``node`` (smallest id), ``words_key``, ``n_shingles`` and ``sketch``."""
    return (
        rows.where("words_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("words_key")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    )


def near_links(nodes: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links ``a, b`` between nodes of ``classes`` that connect every component."""
    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    of_list = Window.partitionBy("key")
    members = staged(
        nodes.select("node", F.explode(_list_keys(hot_values(nodes))).alias("key"))
        .withColumn("first", F.min("node").over(of_list)).withColumn("last", F.max("node").over(of_list))
        .withColumn("length", F.count("*").over(of_list))
        .where("first < last").select("key", "node", "length"),
        "near-lists",
    )
    # The member that meets most others is the likeliest to be linked with them.
    met = members.groupBy("node").agg(F.sum("length").alias("met"))
    centre = F.max(F.struct("met", "node")).over(of_list)["node"]
    stars = members.join(met, "node").withColumn("centre", centre).select(F.col("centre").alias("x"), F.col("node").alias("y"))
    pairs = staged(ordered(stars), "near-stars")
    links = staged(_verified(pairs, nodes, texts), "near-first")
    # What the stars left open: members of lists with members in several components.
    found = components(links)
    placed = members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = F.min("component").over(of_list) < F.max("component").over(of_list)
    open_nodes = placed.withColumn("several", several).where("several").groupBy("node").agg(F.first("component").alias("component"))
    weights = small_or_all(found.groupBy("component").agg(F.count("*").alias("weight")), BROADCAST_IDS)
    open_nodes = staged(open_nodes.join(weights, "component", "left").fillna(1, ["weight"]).select("node", "component", "weight"), "near-open")
    more = staged(_verified(across(open_nodes, texts).join(pairs, ["a", "b"], "left_anti"), nodes, texts), "near-second")
    return links.union(more)


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def common_values(sets: DataFrame) -> np.ndarray:
    """A bitmap by leading bits of the values that several of these sets hold."""
    counted = sets.select(F.explode("set").alias("value")).groupBy("value").count().where(F.col("count") >= COMMON)
    bucket = f"shiftrightunsigned(value, {64 - BITS})"
    words = counted.groupBy(F.expr(f"CAST(shiftright({bucket}, 6) AS INT)").alias("word"))
    bitmap = np.zeros(1 << BITS - 6, np.int64)
    for r in words.agg(F.expr(f"bit_or(shiftleft(1L, CAST({bucket} & 63 AS INT)))").alias("bits")).collect():
        bitmap[r.word] = r.bits
    return bitmap.view(np.uint64)


def prefix_rows(open_nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """A row per value by which a node may meet a smaller set (``larger``), and per value by which a larger one.

    Linked sets of ``n`` and ``m`` values share at least ``PERCENT * (n + m) / (100 + PERCENT)``, so the first value that
    they share has as many from its place on in both.  ``size_class`` is that of the smaller set, -1 for rare values.
    """
    sample = open_nodes.where(F.pmod(F.xxhash64("node"), F.lit(COMMON_SHARE)) == 0)

    def of(some: DataFrame) -> DataFrame:
        return texts.join(small_or_all(some.select("node"), BROADCAST_IDS), "node", "left_semi").select("node", "text")

    common = common_values(of(sample).mapInArrow(_sets, "node long, set array<long>"))
    cut = of(open_nodes).mapInArrow(_prefixes(common), "node long, n long, prefix array<long>, rare long")
    rows = cut.join(small_or_all(open_nodes, BROADCAST_IDS), "node")
    rows = rows.select("node", "component", "weight", "n", "rare", F.posexplode("prefix").alias("place", "value"))
    size_class = lambda n: F.floor(F.log(n) / F.log(F.lit(SIZE_CLASS))).cast("int")
    least = F.expr(f"({PERCENT} * n + 99) div 100")
    most = F.expr(f"least(n, ({100 + PERCENT} * (n - place) - {PERCENT} * n) div {PERCENT})")
    rare = F.col("place") < F.col("rare")
    smaller = F.expr(f"{100 + PERCENT} * (n - place) >= {2 * PERCENT} * n")
    targets = F.when(rare, F.array(F.lit(-1))).otherwise(F.sequence(size_class(least), size_class(most)))
    columns = ["value", "node", "component", "weight", "n", "place"]
    return (
        rows.where(most >= least).select(*columns, F.lit(True).alias("larger"), F.explode(targets).alias("size_class"))
        .union(rows.where(smaller).select(*columns, F.lit(False), F.when(rare, -1).otherwise(size_class(F.col("n")))))
    )


def across(open_nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs of nodes in different components that the order of their sets does not rule out.

    In a list of a value the members of its heaviest component meet the others only, in blocks of bounded size.
    """
    of_list = Window.partitionBy("value", "size_class")
    members = staged(
        prefix_rows(open_nodes, texts)
        .withColumn("low", F.min("component").over(of_list)).withColumn("high", F.max("component").over(of_list))
        .withColumn("heaviest", F.max(F.struct("weight", "component")).over(of_list)["component"])
        .withColumn("blocks", F.ceil(F.count("*").over(of_list) / F.lit(BLOCK)).cast("int"))
        .where("low < high").drop("low", "high", "weight"),
        "near-prefixes",
    )
    heavy = F.col("component") == F.col("heaviest")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")

    def slot(of_heavy: bool, block: Column) -> Column:
        return F.struct(F.lit(of_heavy).alias("of_heavy"), block.alias("block"))

    def slots(of_heavy: bool) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda block: slot(of_heavy, block))

    def side(larger: bool, name: str, where: Column) -> DataFrame:
        return members.where(F.col("larger") == larger).withColumn("slot", F.explode(where)).select(
            "value", "size_class", "slot.of_heavy", "slot.block", F.col("node").alias(name),
            *(F.col(c).alias(f"{c[0]}{name}") for c in ("component", "n", "place")),
        )

    x = side(True, "x", F.when(heavy, F.array(slot(True, own))).otherwise(slots(False)))
    y = side(False, "y", F.when(heavy, F.array(slot(False, own))).otherwise(F.concat(F.array(slot(False, own)), slots(True))))
    met = x.join(y, ["value", "size_class", "of_heavy", "block"])
    shared = " AND ".join(f"{100 + PERCENT} * (n{i} - p{i}) >= {PERCENT} * (nx + ny)" for i in "xy")
    order = f"(nx > ny OR nx = ny AND x > y) AND 100 * ny >= {PERCENT} * nx"
    return ordered(met.where(f"cx <> cy AND {order} AND {shared}").select("x", "y"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``."""
    rows = staged(sketched(docs, doc_id, text), "near-rows")
    nodes = staged(classes(rows), "near-classes")
    found = components(near_links(nodes, docs, doc_id, text))
    placed = nodes.join(found, "node", "left").select("words_key", F.coalesce("component", "node").alias("class_component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return rows.drop("sketch").join(placed, "words_key", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id, once if the id comes again.  Rows without an id stay, all of them."""
    gone = near_duplicates(docs, doc_id, text).where("component_id < doc_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return one_row_each(docs.join(small_or_all(gone, BROADCAST_IDS), doc_id, "left_anti"), doc_id)
