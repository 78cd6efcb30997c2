"""Whitening by the exact characteristic polynomial of the integer scatter.

1. One pass over the vectors sums n, the entries and their products per task,
   in exact integers; the partial sums are added up in a tree whose leaves are
   rows of the matrix.  M = n * sum(x x') - S S' is n^2 times the covariance,
   to the last digit: centring by the mean first is the same sum, as nothing is
   rounded, and needs no second pass.
2. Spark reduces M to Hessenberg form modulo one prime after the other and so
   finds the characteristic polynomial modulo each; Chinese remaindering gives
   its whole coefficients, which the trace bounds.
3. All its roots are real, so the sign changes of the polynomial moved by a
   tell how many roots lie above a (Budan and Fourier).  Halving intervals
   isolates each of the largest roots; isolated roots are halved on by sign.
4. A component spans the null space of M - root: inverse iteration in
   fixed-point numbers of ``BITS`` bits, equal roots in one task, each vector
   made orthogonal to those before it.

What leaves the tasks for the driver is bounded by the dimension d alone: d
rows of sums, d + 1 residues a prime, one vector a component.

Edge cases: vectors that are NULL, empty, or hold a NULL or non-finite entry
take no part; neither do those with an entry whose x is not a long, nor those
of another length than the most frequent one (the longer, if tied).  Of equal
roots any orthonormal vectors serve.  Directions without variance have no
whitened value, so there are at most as many components as the matrix has rank:
a table of equal vectors, of one or of none gives no row.  Repeated rows count
each, NULL ids stay, extra columns pass through.  ``deviation`` is NULL where
the exact sum is beyond a long.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from inkveil.llm.common import batch_udf

SCALE, SHIFT = 1024, 100_000
# Rows of a block, and bits of a limb: products of limbs, summed over a block, are exact in a double.
BLOCK, LIMB = 1 << 10, 21
# Partial sums of one matrix row meet in so many groups before the last one.
BRANCHES = 64
# Bits behind the point in inverse iteration, and to which a root is found.
BITS, ROOT_BITS = 256, 128
ROUNDS = 8
# x beyond this is no long any more.
LARGEST = 1 << 62


def entries(vector: Column) -> Column:
    """floor(1024 * c) + 100000 of each entry as longs; NULL where the vector takes no part."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    whole = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < float(LARGEST), F.lit(False)))
    return F.when(whole & (F.size(vector) > 0), scaled)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of ``column`` that have ``width`` entries."""
    column = column.filter(pc.equal(pc.list_value_length(column), width))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _products(block: np.ndarray) -> np.ndarray:
    """block' block in exact integers: a product of doubles for each two limbs."""
    peak = int(np.abs(block).max(initial=0))
    if peak < 1 << LIMB:
        part = block.astype(float)
        return (part.T @ part).astype(np.int64).astype(object)
    low = np.abs(block)
    limbs = []
    while low.any():
        limbs.append(np.sign(block) * (low & ((1 << LIMB) - 1)).astype(float))
        low >>= LIMB
    total = np.zeros((block.shape[1],) * 2, dtype=object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _sums(width: int):
    """A task's count, sums and products, a row for each row of the matrix, as decimal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
        task = None
        for batch in batches:
            task = batch.column("task")[0].as_py() if task is None and batch.num_rows else task
            rows = _matrix(batch.column("x"), width)
            n += len(rows)
            for at in range(0, len(rows), BLOCK):
                block = rows[at : at + BLOCK]
                total += block.astype(object).sum(axis=0)
                products += _products(block)
        if n:
            yield _sum_rows(((i, [n, total[i], *products[i]]) for i in range(width)), task)

    return run


def _sum_rows(rows, branch: int) -> pa.RecordBatch:
    rows = [*rows]
    return pa.RecordBatch.from_pydict({
        "i": pa.array([i for i, _ in rows], pa.int32()),
        "branch": pa.array([branch % BRANCHES] * len(rows), pa.int32()),
        "sums": pa.array([[str(s) for s in sums] for _, sums in rows], pa.list_(pa.string())),
    })


SUMS = "i int, branch int, sums array<string>"


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.array([*map(int, sums)], dtype=object) for sums in table.column("sums").to_pylist())
    return pa.Table.from_batches([_sum_rows([(table.column("i")[0].as_py(), total)], table.column("branch")[0].as_py())])


def scatter(vectors: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of the vectors in column ``x``, and n * sum(x x') - S S', all exact."""
    widths = vectors.where("x IS NOT NULL").groupBy(F.size("x").alias("width")).count()
    common = widths.orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return 0, [], np.zeros((0, 0), dtype=object)
    width = common["width"]
    parts = vectors.where(F.size("x") == width).select("x", F.spark_partition_id().alias("task")).mapInArrow(_sums(width), SUMS)
    halfway = parts.groupBy("i", "branch").applyInArrow(_added, SUMS)
    rows = sorted(halfway.groupBy("i").applyInArrow(_added, SUMS).collect(), key=lambda r: r["i"])
    found = np.array([[*map(int, r["sums"])] for r in rows], dtype=object)
    n, total = found[0, 0], found[:, 1]
    return n, [*total], n * found[:, 2:] - np.outer(total, total)


# The characteristic polynomial.


def _prime(n: int) -> bool:
    """Miller and Rabin's test, exact below 2^32 with these witnesses."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7):
        x = pow(a, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes below 2^31 whose product is over ``bound``."""
    primes, product = [], 1
    for p in filter(_prime, count((1 << 31) - 1, -2)):
        if product > bound:
            return primes
        primes.append(p)
        product *= p
    raise AssertionError


def coefficient_bound(dimension: int, trace: int) -> int:
    """No coefficient is larger in size: e_k of roots that aren't negative is at most C(d, k) (trace / d)^k."""
    return max(math.comb(dimension, k) * trace**k // dimension**k + 1 for k in range(dimension + 1))


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(xI - matrix) modulo ``p`` < 2^31, constant term first, by way of Hessenberg form."""
    d = len(matrix)
    h = (matrix % p).astype(np.int64)
    for k in range(d - 2):
        rest = np.flatnonzero(h[k + 1 :, k])
        if not len(rest):
            continue
        pivot = k + 1 + rest[0]
        if pivot != k + 1:
            h[[pivot, k + 1]] = h[[k + 1, pivot]]
            h[:, [pivot, k + 1]] = h[:, [k + 1, pivot]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for m in range(1, d + 1):
        last = h[m - 1, m - 1]
        polys[m, 1:] = polys[m - 1, :-1]
        polys[m] = (polys[m] - last * polys[m - 1]) % p
        below = 1
        for i in range(m - 1, 0, -1):  # the product of the entries under the diagonal
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            polys[m] = (polys[m] - below * int(h[i - 1, m - 1]) % p * polys[i - 1]) % p
    return polys[d]


def remaindered(residues: list[list[int]], primes: list[int]) -> list[int]:
    """The whole numbers nearest to 0 that leave these residues."""
    product = math.prod(primes)
    shares = [product // p * pow(product // p, -1, p) for p in primes]
    whole = (sum(r * s for r, s in zip(column, shares)) % product for column in zip(*residues))
    return [c - product if 2 * c > product else c for c in whole]


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Whole coefficients of det(xI - matrix), constant term first; the primes are shared out over the tasks."""
    primes = primes_for(2 * coefficient_bound(len(matrix), int(np.trace(matrix))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"p": batch["p"], "residues": [polynomial_modulo(matrix, int(p)).tolist() for p in batch["p"]]})

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    given = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    found = {r["p"]: r["residues"] for r in given.mapInPandas(run, "p long, residues array<long>").collect()}
    return remaindered([found[p] for p in primes], primes)


# Its roots.


class Roots:
    """The roots of a polynomial all of whose roots are real and at least 0, as multiples of 2^-scale."""

    def __init__(self, coefficients: list[int], trace: int):
        self.degree = len(coefficients) - 1
        self.scale = max(0, ROOT_BITS - trace.bit_length())
        self.coefficients = [c << (self.scale * (self.degree - k)) for k, c in enumerate(coefficients)]
        self.top = (trace << self.scale) + 1
        self._above: dict[int, int] = {}

    def above(self, a: int) -> int:
        """How many roots, each as often as it occurs, are larger than ``a``: sign changes of the polynomial moved by a."""
        if a not in self._above:
            c = self.coefficients[:]
            for low in range(self.degree):  # Horner's scheme again and again
                for k in range(self.degree - 1, low - 1, -1):
                    c[k] += a * c[k + 1]
            signs = [x > 0 for x in c if x]
            self._above[a] = sum(s != t for s, t in zip(signs, signs[1:]))
        return self._above[a]

    def _sign(self, a: int) -> int:
        value = 0
        for c in reversed(self.coefficients):
            value = value * a + c
        return (value > 0) - (value < 0)

    def largest(self, rank: int) -> int:
        """The ``rank``-th largest root, rounded up to a whole multiple."""
        low, high = -1, self.top  # the root lies above low and not above high
        for a in self._above:  # from earlier searches
            if self._above[a] >= rank:
                low = max(low, a)
            else:
                high = min(high, a)
        while high - low > 1:
            mid = (low + high) // 2
            if self.above(low) - self.above(high) == 1:
                sign = self._sign(mid)
                inside = sign and sign != (1 if self.above(high) % 2 == 0 else -1)
            else:
                inside = self.above(mid) >= rank
            low, high = (mid, high) if inside else (low, mid)
        return high


# Its components.


def _null_vector(matrix: np.ndarray, root: Fraction, earlier: list[list[int]]) -> list[int]:
    """A vector that (matrix - root) takes to 0, orthogonal to ``earlier``, as fixed-point numbers of length 1."""
    d, one = len(matrix), 1 << BITS
    a = matrix * one
    a[np.diag_indices(d)] -= root.numerator * one // root.denominator
    rows = np.arange(d)
    for k in range(d):
        pivot = k + int(np.argmax(np.abs(a[k:, k])))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            rows[[k, pivot]] = rows[[pivot, k]]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            a[k + 1 :, k] = (a[k + 1 :, k] << BITS) // a[k, k]
            a[k + 1 :, k + 1 :] -= (a[k + 1 :, k, None] * a[None, k, k + 1 :]) >> BITS
    chance = random.Random(len(earlier))
    vector = _unit([chance.randrange(-one, one) for _ in range(d)], earlier)
    for _ in range(ROUNDS):
        solved = np.array(vector, dtype=object)[rows]
        for k in range(1, d):
            solved[k] -= int(a[k, :k].dot(solved[:k])) >> BITS
        for k in range(d - 1, -1, -1):
            known = int(a[k, k + 1 :].dot(solved[k + 1 :])) if k + 1 < d else 0
            solved[k] = ((int(solved[k]) << BITS) - known) // a[k, k]
        before, vector = vector, _unit([int(v) for v in solved], earlier)
        change = min(max(abs(x - s * y) for x, y in zip(vector, before)) for s in (1, -1))
        if change >> (BITS - 100) == 0:
            break
    return vector


def _unit(vector: list[int], earlier: list[list[int]]) -> list[int]:
    """``vector`` made orthogonal to ``earlier`` and of length 1, twice for the digits lost in the first go."""
    for _ in range(2):
        length = math.isqrt(sum(v * v for v in vector)) or 1
        vector = [(v << BITS) // length for v in vector]
        for other in earlier:
            along = sum(v * w for v, w in zip(vector, other)) >> BITS
            vector = [v - (along * w >> BITS) for v, w in zip(vector, other)]
    length = math.isqrt(sum(v * v for v in vector)) or 1
    return [(v << BITS) // length for v in vector]


def components_of(spark, matrix: np.ndarray, roots: list[Fraction]) -> list[list[float]]:
    """A unit vector for each root; a task for each group of equal roots."""
    groups: dict[Fraction, list[int]] = {}
    for k, root in enumerate(roots):
        groups.setdefault(root, []).append(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for root in batch["root"]:
                found: list[list[int]] = []
                for k in groups[Fraction(root)]:
                    found.append(_null_vector(matrix, Fraction(root), found))
                    yield pd.DataFrame({"k": [k], "vector": [[v / (1 << BITS) for v in found[-1]]]})

    given = spark.createDataFrame([(str(root),) for root in groups], "root string").repartition(len(groups))
    rows = given.mapInPandas(run, "k int, vector array<double>").collect()
    return [r["vector"] for r in sorted(rows, key=lambda r: r["k"])]


@dataclass(frozen=True)
class Whitening:
    """The fit: n, sums of the entries, unit components by falling eigenvalue, eigenvalues and trace of the covariance."""

    n: int
    sums: list[int]
    components: list[list[float]]
    eigenvalues: list[float]
    explained: list[float]

    def applied(self, x: Column) -> Column:
        """``deviation`` and ``whitened`` of a vector of longs; NULL for one that takes no part."""
        n, sums = self.n, np.array(self.sums, dtype=object)
        lengths = np.sqrt(np.array(self.eigenvalues))
        directions = np.array(self.components).reshape(-1, len(sums)).T / lengths if len(lengths) else np.zeros((len(sums), 0))
        small = (1 << 62) // max(1, n)

        @batch_udf("deviation long, whitened array<double>")
        def whiten(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                fit = np.array([v is not None and len(v) == len(sums) for v in batch], dtype=bool)
                rows = np.stack(batch[fit].to_list()) if fit.any() else np.zeros((0, len(sums)), dtype=np.int64)
                if max(int(np.abs(rows).max(initial=0)), max(map(abs, self.sums), default=0) // max(1, n) + 1) < small:
                    far = rows * np.int64(n) - sums.astype(np.int64)
                else:
                    far = rows.astype(object) * n - sums
                peak = max(int(np.abs(far).max(initial=0)), 1)
                square = far if peak * peak * len(sums) < 1 << 63 else far.astype(object)
                deviation, whitened = [None] * len(batch), [None] * len(batch)
                squares, images = (square * square).sum(axis=1), far.astype(float) / n @ directions
                for place, s, image in zip(np.flatnonzero(fit), squares, images):
                    deviation[place], whitened[place] = int(s) if s < 1 << 63 else None, image
                yield pd.DataFrame({"deviation": pd.array(deviation, dtype="Int64"), "whitened": whitened})

        return whiten(x)


def fit(vectors: DataFrame, most: int = 8) -> Whitening:
    """The first ``most`` components of the vectors in column ``x`` (see ``entries``)."""
    spark = vectors.sparkSession
    n, sums, matrix = scatter(vectors)
    trace = int(np.trace(matrix)) if n else 0
    if not trace:
        return Whitening(n, sums, [], [], [])
    roots = Roots(characteristic_polynomial(spark, matrix), trace)
    found = [Fraction(roots.largest(k), 1 << roots.scale) for k in range(1, min(most, roots.above(0)) + 1)]
    components = components_of(spark, matrix, found)
    return Whitening(n, sums, components, [float(r / n**2) for r in found], [float(r / trace) for r in found])


def identity_error(whitened: DataFrame, most: int) -> float | None:
    """The largest entry, in size, of the covariance of column ``whitened`` minus the identity, measured over its rows.

    Each task leaves ``most`` sums and their products; the values are centred already, so nothing cancels.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + most + most * most)
        for batch in batches:
            if len(batch):
                rows = np.stack(batch["whitened"].to_list())
                total += np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
        yield pd.DataFrame({"place": range(len(total)), "value": total})

    parts = whitened.where("whitened IS NOT NULL").select("whitened").mapInPandas(moments, "place int, value double")
    sums = {r["place"]: r["value"] for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect()}
    if not most or not sums.get(0):
        return None
    means = np.array([sums[1 + i] for i in range(most)]) / sums[0]
    products = np.array([sums[1 + most + i] for i in range(most * most)]).reshape(most, most) / sums[0]
    return float(np.abs(products - np.outer(means, means) - np.eye(most)).max())


def whitened(df: DataFrame, vector: Column, most: int = 8) -> tuple[DataFrame, Whitening]:
    """The rows of ``df`` whose vector takes part, with a struct ``white`` of ``deviation, whitened`` for a column
    of that name, and the fit.  Vectors are read through ``entries``."""
    read = df.withColumn("white", entries(vector)).where("white IS NOT NULL")
    model = fit(read.select(F.col("white").alias("x")), most)
    return read.withColumn("white", model.applied(F.col("white"))).where("white.whitened IS NOT NULL"), model
