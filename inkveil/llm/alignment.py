"""Alignment of two tokenizers' tokens over the same texts, with corpus-wide counts of linked ids.

Tokenizer A reads a blank and the text, tokenizer B the text, before which it
puts a blank of its own, so both cover the same bytes.  Where an A token and a
B token end at the same byte they are linked, and the text is cut into groups.

1. Every text is encoded once; its ids go to a table in the shared folder.
2. The distinct pairs of linked ids, found task by task and then across tasks,
   are dealt into buckets by their B id.  Each bucket builds a minimal perfect
   hash of its pairs: a pair alone in its slot of a bit field is settled, the
   others go on to a smaller field; the rank of its bit is a pair's index.
   The pairs are kept at their index, so a foreign pair is recognized.
3. The texts are aligned again and counted: each task adds into dense vectors
   indexed by the hash, held in blocks that come to be when first touched, and
   the vectors of the tasks are summed in a tree, block by block.
4. The texts are aligned once more and the counts of their links looked up.

Pairs are bounded by the two vocabularies, but those can make many: buckets are
taken together up to ``KEYS`` pairs, and steps 3 and 4 go round once for each
such set.  All pairs of a B id are in one bucket, so the highest count of an id
is known within its round.  What is sent to the tasks of a round, and what the
driver holds of it, is therefore bounded by ``KEYS`` at every size of corpus.

Edge cases: texts that are NULL or empty, and texts whose tokens do not spell a
blank and the text (a text that holds U+2581, say), have no tokens, no groups
and an empty digest.  Repeated rows and repeated or NULL ids are rows of their
own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from inkveil.llm.bpe import byte_letters
from inkveil.llm.common import staged

# Pairs of one round: 16 bytes each, and about one for the hash.
KEYS = 4 << 20
# About so many pairs share a bucket; a B id with more has a larger one.
BUCKET = 1 << 12
# Spreads B ids over the buckets.
SPREAD = 2_654_435_761
# Counts of one block of the dense vectors.
BLOCK = 1 << 12
# A field has so many slots a pair.
ROOM = 2
# Tokens aligned at a time, bytes of ids passed on at a time, distinct pairs held by a task before they are passed on.
TOGETHER, WRITTEN, HELD = 1 << 20, 4 << 20, 1 << 21
# Bytes of a row group of the table of ids: a task holds one while it writes.
ROW_GROUP = 16 << 20


class Tokens:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        split, model = spec["pre_tokenizer"], spec["model"]
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        special = {t["content"] for t in spec["added_tokens"]}
        spelled = {bytes(byte[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
        merged = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
        order = [model["vocab"][s] for s in merged]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("tokenizer A is no plain byte-level one")
        if order != sorted(order) or any(len(s) == 1 and i >= order[0] for s, i in spelled.items()):
            raise ValueError("the ids of tokenizer A do not follow its merges")
        # The ids being in order of the merges, they serve as ranks; special tokens are left out and so are plain text.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.a = tiktoken.Encoding(path_a, pat_str=pattern, mergeable_ranks=spelled, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(spelled.values()) + 1)
        for s, i in spelled.items():
            self.bytes_a[i] = s
        b = self.b
        self.bytes_b = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(b.get_piece_size())
        ]
        self.sizes_a, self.sizes_b = (np.array([*map(len, t)], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        # How ids are written: in two bytes where they fit.
        self.kind_a, self.kind_b = ("<u2" if len(t) <= 1 << 16 else "<u4" for t in (self.bytes_a, self.bytes_b))
        # Ids with what follows them in the text of the groups: within a group, at the end of one.
        self.written_a = [f"{i}{end}" for end in ",|" for i in range(len(self.bytes_a))]
        self.written_b = [f"{i}{end}" for end in ",;" for i in range(len(self.bytes_b))]

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids by A and by B, both empty where they don't spell a blank and the text."""
        if text:
            whole = " " + text
            a, b = self.a.encode_ordinary(whole), self.b.encode(text)
            data = whole.encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) == data == b"".join(map(self.bytes_b.__getitem__, b)):
                return a, b
        return [], []

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``a`` and in ``b`` of the tokens that end together; both may run over several texts."""
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        at = np.searchsorted(ends_b, ends_a)
        linked_a = np.flatnonzero(ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a) if len(b) else np.zeros(0, dtype=np.int64)
        return linked_a, at[linked_a]

    def groups(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Iterator[str]:
        """The groups of one text, as text: ``a1,a2|b1;a3|b2,b3``."""
        whole = np.empty(len(a) + len(b), dtype=object)
        last_a, last_b = (np.zeros(len(x), dtype=np.int64) for x in (a, b))
        last_a[ends_a] = last_b[ends_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_a = np.concatenate([[0], ends_b + 1])[group_a]  # B tokens of earlier groups
        before_b = (ends_a + 1)[group_b]  # A tokens up to this group
        whole[np.arange(len(a)) + before_a] = [self.written_a[i] for i in (a + last_a * len(self.bytes_a)).tolist()]
        whole[np.arange(len(b)) + before_b] = [self.written_b[i] for i in (b + last_b * len(self.bytes_b)).tolist()]
        return "".join(whole.tolist())[:-1]


@functools.lru_cache(maxsize=2)
def tokens(path_a: str, path_b: str) -> Tokens:
    """Loaded once per Python process."""
    return Tokens(path_a, path_b)


ENCODED = "row long, a binary, b binary, n_a long, n_b long, n_groups long, groups_sha256 string"
MADE_NAMES = ["a", "b", "n_a", "n_b", "n_groups", "groups_sha256"]
MADE = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def _encoding(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokens(path_a, path_b)
        for batch in batches:
            begin, size, done = 0, 0, []
            for place, text in enumerate(batch.column("text"), 1):
                a, b = (np.array(ids, dtype=np.int64) for ids in both.encode(text.as_py()))
                ends_a, ends_b = both.ends(a, b)
                digest = hashlib.sha256(both.groups(a, b, ends_a, ends_b).encode()).hexdigest() if len(a) else ""
                ids = [a.astype(both.kind_a).tobytes(), b.astype(both.kind_b).tobytes()]
                done.append((*ids, len(a), len(b), len(ends_a), digest))
                size += sum(map(len, ids))
                if size > WRITTEN or place == batch.num_rows:
                    made = [pa.array(c, t) for c, t in zip(zip(*done), MADE)]
                    given = [batch.column(c).slice(begin, place - begin) for c in ("keys", "row")]
                    yield pa.RecordBatch.from_arrays([*given, *made], names=["keys", "row", *MADE_NAMES])
                    begin, size, done = place, 0, []

    return run


def _links(both: Tokens, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, pairs (A id << 32 | B id) of all links, and where each row's links begin, of some rows at a time."""
    for batch in batches:
        n = batch.column("n_a").to_numpy()
        at = 0
        while at < len(n):
            take = max(1, int(np.searchsorted(np.cumsum(n[at:]), TOGETHER, side="right")))
            part = batch.slice(at, take)
            a, b = (
                np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=kind).astype(np.int64)
                for c, kind in (("a", both.kind_a), ("b", both.kind_b))
            )
            ends_a, ends_b = both.ends(a, b)
            starts = np.searchsorted(ends_a, np.concatenate([[0], np.cumsum(part.column("n_a").to_numpy())]))
            yield part.column("row").to_numpy(), a[ends_a] << 32 | b[ends_b], starts
            at += take


def _pairs(path_a: str, path_b: str):
    """The distinct pairs of a task, passed on when many are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, dtype=np.int64)
        for _, pairs, _ in _links(tokens(path_a, path_b), batches):
            known = np.union1d(known, pairs)
            if len(known) > HELD:
                yield pa.RecordBatch.from_pydict({"pair": known})
                known = known[:0]
        yield pa.RecordBatch.from_pydict({"pair": known})

    return run


# Minimal perfect hashing.


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of 64 bits for each key and level: multiply and shift, as in splitmix."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit fields, level by level, and the distinct ``keys`` in order of their index."""
    fields, places, begin, level = [], [], 0, 0
    left, settled = keys, []
    while len(left):
        slots = (_mixed(left, level) % np.uint64(ROOM * len(left))).astype(np.int64)
        held = np.bincount(slots, minlength=ROOM * len(left))
        alone = held[slots] == 1
        fields.append(held == 1)
        places.append(begin + slots[alone])
        settled.append(left[alone])
        begin, left, level = begin + len(held), left[~alone], level + 1
    order = np.argsort(np.concatenate(places)) if places else []
    return fields, np.concatenate(settled)[order] if settled else keys


def _bucket_hash(table: pa.Table) -> pa.Table:
    """One bucket's hash, of its fields' sizes and bits, and its pairs by index."""
    fields, keys = build_hash(table.column("pair").to_numpy())
    return pa.table({
        "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int64()),
        "sizes": pa.array([[len(f) for f in fields]], pa.list_(pa.int64())),
        "bits": pa.array([np.packbits(np.concatenate(fields), bitorder="little").tobytes()], pa.binary()),
        "pairs": pa.array([keys.astype("<i8").tobytes()], pa.binary()),
    })


HASHES = "bucket long, sizes array<long>, bits binary, pairs binary"


class PerfectHash:
    """Index of each of the pairs of some buckets, from their fields laid end to end."""

    def __init__(self, rows: list, buckets: int):
        depth = max((len(r["sizes"]) for r in rows), default=0)
        self.buckets = buckets
        self.begin, self.size = (np.zeros((depth, buckets), dtype=np.int64) for _ in range(2))
        bits, at = [], 0
        for r in rows:
            for level, size in enumerate(r["sizes"]):
                self.begin[level, r["bucket"]], self.size[level, r["bucket"]] = at, size
                at += size
            bits.append(np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), count=sum(r["sizes"]), bitorder="little"))
        flat = np.concatenate(bits) if bits else np.zeros(0, dtype=np.uint8)
        self.words = np.packbits(np.pad(flat, (0, -len(flat) % 64)), bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.rank = np.cumsum(ones) - ones
        self.pairs = np.concatenate([np.frombuffer(r["pairs"], dtype="<i8") for r in rows]) if rows else np.zeros(0, dtype=np.int64)

    def index(self, pairs: np.ndarray) -> np.ndarray:
        """The index of each pair, -1 for one that was not hashed."""
        found = np.full(len(pairs), -1, dtype=np.int64)
        left, bucket = np.arange(len(pairs)), bucket_of(pairs, self.buckets)
        for level in range(len(self.size)):
            sizes = self.size[level, bucket[left]]
            left, sizes = left[sizes > 0], sizes[sizes > 0]  # no field: a foreign pair
            slots = self.begin[level, bucket[left]] + (_mixed(pairs[left], level) % sizes.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[slots >> 6], (slots & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[left[hit]] = (self.rank[slots >> 6] + below)[hit]
            left = left[~hit]
        found[found >= 0] = np.where(self.pairs[found[found >= 0]] == pairs[found >= 0], found[found >= 0], -1)
        return found


def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a pair, by its B id alone."""
    return (pairs & 0xFFFFFFFF) * SPREAD % (1 << 32) % buckets


# Counting and looking up.


COUNTS = "block int, branch int, counts binary"


def _counting(path_a: str, path_b: str, hashed, branches: int):
    """A task's dense vector of counts, in blocks; those without a count are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, both, task = hashed.value, tokens(path_a, path_b), 0
        size = len(index.pairs)
        vector = np.zeros(size + -size % BLOCK, dtype=np.int64)

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal task
            for batch in batches:
                task = batch.column("task")[0].as_py() if batch.num_rows else task
                yield batch

        for _, pairs, _ in _links(both, noted()):
            found, counts = np.unique(pairs, return_counts=True)
            at = index.index(found)
            here = at >= 0  # the others belong to another round
            vector[at[here]] += counts[here]
        for block, counts in enumerate(vector.reshape(-1, BLOCK)):
            if counts.any():
                yield _block(block, task % branches, counts)

    return run


def _block(block: int, branch: int, counts: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([block], pa.int32()), pa.array([branch], pa.int32()), pa.array([counts.astype("<i8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "branch", "counts"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), dtype="<i8") for c in table.column("counts"))
    return pa.Table.from_batches([_block(table.column("block")[0].as_py(), table.column("branch")[0].as_py(), total)])


def _looked_up(path_a: str, path_b: str, hashed, values):
    """``n_best`` and ``count_sum`` of the links of each row that belong to the round."""

    @F.arrow_udf("n_best long, count_sum long")
    def found(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index, (counts, best), both = hashed.value, values.value, tokens(path_a, path_b)
        for a, b, n_a in columns:
            sums: list[np.ndarray] = []
            batch = pa.RecordBatch.from_arrays([n_a, a, b, n_a], names=["row", "a", "b", "n_a"])
            for _, pairs, starts in _links(both, iter([batch])):
                distinct, place = np.unique(pairs, return_inverse=True)
                at = index.index(distinct)
                of = [np.where(at >= 0, v[at], 0)[place] if len(v) else np.zeros(len(pairs), dtype=np.int64) for v in (best, counts)]
                running = [np.concatenate([[0], np.cumsum(v, dtype=np.int64)]) for v in of]
                sums.append(np.array([r[starts[1:]] - r[starts[:-1]] for r in running]))
            both_sums = np.concatenate(sums, axis=1) if sums else np.zeros((2, 0), dtype=np.int64)
            yield pa.StructArray.from_arrays([*map(pa.array, both_sums)], names=["n_best", "count_sum"])

    return found("a", "b", "n_a")


def bucket(b: Column, buckets: int) -> Column:
    """As ``bucket_of``, in SQL."""
    return b * SPREAD % (1 << 32) % buckets


def aligned(docs: DataFrame, keys: list[str], text: str, path_a: str, path_b: str) -> DataFrame:
    """The ``keys`` of each row with ``n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` of its text."""
    spark = docs.sparkSession
    numbered = docs.select(F.struct(*keys).alias("keys"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    encode = _encoding(path_a, path_b)
    kind = numbered.schema["keys"].dataType.simpleString()
    texts = staged(numbered.select("keys", "row", "text").mapInArrow(encode, f"keys {kind}, {ENCODED}"), "aligned", ROW_GROUP)
    # Vectors come one a task, so their number follows the cores rather than the data.
    tasks = min(texts.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism)
    branches = max(1, math.isqrt(tasks))
    ids = texts.where("n_a > 0").select("row", "a", "b", "n_a", F.spark_partition_id().alias("task")).coalesce(max(1, tasks))
    pairs = staged(ids.mapInArrow(_pairs(path_a, path_b), "pair long").distinct(), "aligned-pairs")
    buckets = max(1, pairs.count() // BUCKET)
    dealt = pairs.withColumn("bucket", bucket(F.col("pair").bitwiseAND(0xFFFFFFFF), buckets))
    hashes = staged(dealt.groupBy("bucket").applyInArrow(_bucket_hash, HASHES), "aligned-hashes")
    results = [_round(texts, ids, hashes, some, buckets, branches, path_a, path_b) for some in _rounds(hashes)]
    if len(results) == 1:
        found = results[0]
    else:
        parts = [staged(r.select("row", "found.*"), "aligned-round") for r in results]
        sums = functools.reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "row long, n_best long, count_sum long"))
        total = sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_best", "count_sum")])
        found = texts.join(total, "row", "left").withColumn(
            "found", F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")])
        )
    return found.select("keys.*", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256", "found.*")


def _rounds(hashes: DataFrame) -> Iterator[list[int]]:
    """Buckets taken together: as many as have ``KEYS`` pairs, one at least."""
    some, held = [], 0
    for r in hashes.select("bucket", (F.octet_length("pairs") / 8).cast("long").alias("n")).orderBy("bucket").collect():
        if some and held + r["n"] > KEYS:
            yield some
            some, held = [], 0
        some.append(r["bucket"])
        held += r["n"]
    if some:
        yield some


def _round(texts: DataFrame, ids: DataFrame, hashes: DataFrame, some: list[int], buckets: int, branches: int, path_a: str, path_b: str) -> DataFrame:
    """``texts`` with ``found``: what the pairs of some buckets give."""
    context = texts.sparkSession.sparkContext
    rows = hashes.where(F.col("bucket").between(some[0], some[-1])).orderBy("bucket").collect()
    index = PerfectHash(rows, buckets)
    hashed = context.broadcast(index)
    parts = ids.mapInArrow(_counting(path_a, path_b, hashed, branches), COUNTS)
    halfway = parts.groupBy("block", "branch").applyInArrow(_added, COUNTS)
    counts = np.zeros(len(index.pairs) + -len(index.pairs) % BLOCK, dtype=np.int64)
    for r in halfway.groupBy("block").applyInArrow(_added, COUNTS).collect():
        counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], dtype="<i8")
    counts = counts[: len(index.pairs)]
    of = index.pairs & 0xFFFFFFFF
    highest = np.zeros(int(of.max(initial=0)) + 1, dtype=np.int64)
    np.maximum.at(highest, of, counts)
    values = context.broadcast((counts, (counts == highest[of]).astype(np.int64)))
    return texts.withColumn("found", _looked_up(path_a, path_b, hashed, values))
