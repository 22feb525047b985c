"""Whitening of embeddings by the exact characteristic polynomial (operator 12).

Every vector entry ``c`` becomes the integer ``floor(scale * c)``.  All
that is fitted comes from integers without rounding:

1. Every partition sums its vectors and their outer products exactly (float64
   products of small limbs, added up as integers); the partitions' sums are
   added row by row of the matrix.  ``C = n * sum x x' - S S'`` is the integer
   scatter matrix, ``n * n`` times the covariance, centred before anything is rounded.
2. The characteristic polynomial of ``C`` modulo enough 31-bit primes: one task
   each for a share of the primes reduces ``C`` to Hessenberg form and expands
   its determinant.  Chinese remaindering gives the integer coefficients; the
   number of primes follows from Maclaurin's bound on them, and one more prime checks them.
3. All roots are real and not negative, so Descartes' rule counts the roots above
   a point exactly.  Halving separates the greatest roots, exact signs narrow them
   until they are known to many more bits than their distance to the next.
4. Inverse iteration in long decimals solves for the null space of ``C - root I``,
   a task for each root.  Only then are values rounded to doubles.

The driver holds ``dim * dim`` integers and ``dim + 1`` coefficients, whatever the
number of rows.  Rows are read twice (sums, projection); the projections are
staged, and their own mean and centred covariance tell the identity error.

Defined cases: rows whose vector is null or empty, holds a null or non-finite
entry, or has another length than most (the shortest of the commonest lengths)
are left out; entries beyond ``2**62`` after scaling are held at that bound.
Repeated rows count each.  Roots nearer than ``2**-200`` of the greatest
are one root of that multiplicity, for which any orthonormal basis of its space serves.
Components without variance are not returned, so without variance there are no rows.
``deviation`` is null where its exact value is no long; ``deviation_exact`` holds
it up to 38 digits.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal, getcontext, localcontext
from itertools import accumulate
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut_lineage

LIMB = 20
WORD = 40  # bits of the parts in which sums travel as longs
PARTS = 5
BLOCK = 4096  # rows: products of two limbs summed over a block are exact doubles
SAME = 200  # roots that agree to so many bits are one


# --- exact sums -------------------------------------------------------------

def integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    """``floor(scale * c)`` as longs."""
    bound = float(1 << 62)
    return np.clip(np.floor(scale * vectors), -bound, bound).astype("int64")


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Float arrays whose sum, each times ``2**LIMB`` more than the one before, is ``x``."""
    out = []
    while True:
        if not len(x) or max(-int(x.min()), int(x.max())) < 1 << LIMB:
            return [*out, x.astype("float64")]
        out.append((x & ((1 << LIMB) - 1)).astype("float64"))
        x = x >> LIMB


def as_int(x: np.ndarray) -> np.ndarray:
    return x.astype("int64").astype(object)


def outer_sums(x: np.ndarray) -> np.ndarray:
    """``sum x x'`` of long rows as Python integers."""
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for at in range(0, len(x), BLOCK):
        parts = limbs(x[at:at + BLOCK])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total = total + as_int(a.T @ b) * (1 << LIMB * (i + j))
    return total


def column_sums(x: np.ndarray) -> np.ndarray:
    total = np.zeros(x.shape[1], dtype=object)
    for at in range(0, len(x), BLOCK):
        for i, a in enumerate(limbs(x[at:at + BLOCK])):
            total = total + as_int(a.sum(axis=0)) * (1 << LIMB * i)
    return total


def packed(values: Iterable[int]) -> list[int]:
    """Integers as PARTS longs each, the last one signed, so that sums of longs add them up."""
    out = []
    for v in values:
        for _ in range(PARTS - 1):
            out.append(int(v) & ((1 << WORD) - 1))
            v = int(v) >> WORD
        out.append(int(v))
    return out


def unpacked(longs: list[int]) -> list[int]:
    return [sum(int(v) << WORD * k for k, v in enumerate(longs[at:at + PARTS])) for at in range(0, len(longs), PARTS)]


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def scatter(rows: DataFrame, dim: int, scale: float) -> tuple[int, list[int], np.ndarray]:
    """(n, sums S, integer scatter matrix) of ``floor(scale * vector)``."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
        for batch in batches:
            if batch.num_rows:
                x = integers(matrix_of(batch.column(0), dim), scale)
                n, s, g = n + len(x), s + column_sums(x), g + outer_sums(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *range(dim)], pa.int32()),
                 pa.array([packed([n, *s]), *(packed(r) for r in g)], pa.list_(pa.int64()))], names=["row", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "sums": [np.sum(np.stack(pdf["sums"].to_list()), axis=0)]})

    parts = rows.select("vector").mapInArrow(sums, "row int, sums array<bigint>")
    total = {r["row"]: unpacked(r["sums"]) for r in parts.groupBy("row").applyInPandas(add, "row int, sums array<bigint>").collect()}
    if not total:
        return 0, [0] * dim, np.zeros((dim, dim), dtype=object)
    n, *s = total[-1]
    g = np.array([total[i] for i in range(dim)], dtype=object).reshape(dim, dim)
    return n, s, n * g - np.outer(np.array(s, dtype=object), np.array(s, dtype=object))


# --- characteristic polynomial ----------------------------------------------

def is_prime(n: int) -> bool:
    """Miller-Rabin; exact for n below 3,215,031,751."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_above(bits: int) -> list[int]:
    """The greatest 31-bit primes whose product has more than ``bits`` bits, and one more."""
    out, product, n = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits + 1:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    while not is_prime(n):
        n -= 2
    return [*out, n]


def coefficient_bits(dim: int, trace: int) -> int:
    """Bits that hold every coefficient: the k-th is at most comb(dim, k) * (trace / dim) ** k."""
    return max((comb(dim, k) * trace ** k // dim ** k + 1).bit_length() for k in range(dim + 1))


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, highest first, of det(x I - matrix) modulo a 31-bit prime."""
    h, dim = matrix.copy(), len(matrix)
    for m in range(1, dim - 1):
        nonzero = np.flatnonzero(h[m:, m - 1])
        if not len(nonzero):
            continue
        i = m + int(nonzero[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        if u.any():
            h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
            h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    polys = np.zeros((dim + 1, dim + 1), dtype="int64")  # [k] is that of the leading k x k part, lowest first
    polys[0, 0] = 1
    for k in range(1, dim + 1):
        new = np.zeros(dim + 1, dtype="int64")
        new[1:] = polys[k - 1, :-1]
        weight, t = np.zeros(k, dtype="int64"), 1
        for i in range(k - 1, -1, -1):
            weight[i] = int(h[i, k - 1]) * t % p
            t = t * int(h[i, i - 1]) % p if i else 0
        polys[k] = (new - (weight[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[dim, ::-1].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Integer coefficients, highest first, of det(x I - matrix) for a positive semidefinite integer matrix."""
    dim, trace = len(matrix), int(sum(matrix[i, i] for i in range(len(matrix))))
    primes = primes_above(coefficient_bits(dim, trace))
    shared = spark.sparkContext.broadcast(matrix)

    def reduce(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["p"].tolist():
                part = (shared.value % p).astype("int64")
                yield pd.DataFrame({"p": [p], "residues": [polynomial_mod(part, p)]})

    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    frame = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    residues = {r["p"]: r["residues"] for r in frame.mapInPandas(reduce, "p long, residues array<bigint>").collect()}
    shared.unpersist()
    return remaindered(residues, primes)


def remaindered(residues: dict[int, list[int]], primes: list[int]) -> list[int]:
    """The polynomial with these residues; its roots are not negative, so the signs alternate."""
    *use, check = primes
    values, product = [0] * len(residues[check]), 1
    for p in use:
        inverse = pow(product, -1, p)
        values = [v + product * ((((-r if k % 2 else r) - v) * inverse) % p) for k, (v, r) in enumerate(zip(values, residues[p]))]
        product *= p
    signed = [-v if k % 2 else v for k, v in enumerate(values)]
    if [v % check for v in signed] != residues[check]:
        raise ArithmeticError("the primes do not hold the coefficients")
    return signed


# --- roots ------------------------------------------------------------------

@dataclass
class Root:
    """``times`` roots in ``(at * 2**exponent, (at + 1) * 2**exponent]``."""

    at: int
    exponent: int
    times: int


def scaled(coefficients: list[int], exponent: int) -> list[int]:
    """The polynomial whose roots are ``2**-exponent`` times as large, times a power of two."""
    if exponent >= 0:
        top = len(coefficients) - 1
        return [c << exponent * (top - k) for k, c in enumerate(coefficients)]
    return [c << -exponent * k for k, c in enumerate(coefficients)]


def roots_above(coefficients: list[int], at: int, exponent: int) -> int:
    """How many roots exceed ``at * 2**exponent``: sign changes after moving that point to 0, exact as all roots are real."""
    c = scaled(coefficients, exponent)[::-1]
    if at:
        power, moved = 1, []
        for v in c:
            moved.append(v * power)
            power *= at
        c = moved
        for i in range(len(c) - 1):  # Taylor shift by one
            c[i:] = list(accumulate(reversed(c[i:])))[::-1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(coefficients: list[int], at: int, exponent: int) -> int:
    acc = 0
    for c in scaled(coefficients, exponent):
        acc = acc * at + c
    return (acc > 0) - (acc < 0)


def greatest_roots(coefficients: list[int], wanted: int) -> list[Root]:
    """The greatest positive roots, falling, until ``wanted`` of them are found and one more is set apart.

    Each is narrowed until its interval is ``2**-100`` of the distance to its neighbours.
    """
    c = list(coefficients)
    while len(c) > 1 and c[-1] == 0:
        c.pop()  # roots at zero
    if len(c) == 1:
        return []
    top = (-c[1]).bit_length()  # the sum of all roots
    todo, found = [(Root(0, top, len(c) - 1), 0)], []
    while todo and sum(r.times for r in found) <= wanted:
        root, above = todo.pop()  # the greatest open interval; so many roots lie above it
        if root.times == 1 or root.exponent < top - SAME - len(c).bit_length():
            found.append(root)
            continue
        over = roots_above(c, 2 * root.at + 1, root.exponent - 1) - above
        for upper, times, beyond in ((False, root.times - over, above + over), (True, over, above)):
            if times:
                todo.append((Root(2 * root.at + upper, root.exponent - 1, times), beyond))
    uppers = [sign_at(c, r.at + 1, r.exponent) for r in found]
    while True:
        loose = [i for i, r in enumerate(found) if r.times == 1 and distance(found, i) < Decimal(2) ** (r.exponent + 100)]
        if not loose:
            return found
        for i in loose:
            r = found[i]
            sign = sign_at(c, 2 * r.at + 1, r.exponent - 1)
            upper = sign not in (0, uppers[i])
            found[i] = Root(2 * r.at + upper, r.exponent - 1, 1)
            if not upper:
                uppers[i] = sign


def distance(roots: list[Root], i: int) -> Decimal:
    """From one interval to the next on either side, zero included; exact enough to compare powers of two."""
    with localcontext() as context:
        context.prec = 1000
        low = [Decimal(r.at) * Decimal(2) ** r.exponent for r in roots]
        high = [Decimal(r.at + 1) * Decimal(2) ** r.exponent for r in roots]
        gaps = [low[i] - (high[i + 1] if i + 1 < len(roots) else 0)]
        if i:
            gaps.append(low[i - 1] - high[i])
        return min(gaps)


# --- components -------------------------------------------------------------

def factored(a: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """LU factors in one array and the row order, with row pivoting; a zero pivot becomes tiny."""
    a, order = a.copy(), list(range(len(a)))
    tiny = max(abs(v) for v in a.flat) * Decimal(10) ** -(getcontext().prec - 10)
    for k in range(len(a)):
        i = k + max(range(len(a) - k), key=lambda j: abs(a[k + j, k]))
        if i != k:
            a[[i, k]] = a[[k, i]]
            order[i], order[k] = order[k], order[i]
        if a[k, k] == 0:
            a[k, k] = tiny
        a[k + 1:, k] = a[k + 1:, k] / a[k, k]
        a[k + 1:, k + 1:] = a[k + 1:, k + 1:] - np.multiply.outer(a[k + 1:, k], a[k, k + 1:])
    return a, order


def solved(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x = b[order]
    for k in range(len(x)):
        x[k + 1:] = x[k + 1:] - lu[k + 1:, k] * x[k]
    for k in range(len(x) - 1, -1, -1):
        x[k] = x[k] / lu[k, k]
        x[:k] = x[:k] - lu[:k, k] * x[k]
    return x


def unit(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            v = v - o * np.dot(o, v)
    return v / np.dot(v, v).sqrt()


def null_space(matrix: np.ndarray, root: Root, top: int) -> list[list[float]]:
    """Orthonormal vectors of the root's space, each with its greatest entry positive; ``top`` bits hold the trace."""
    dim, out, start = len(matrix), [], 0
    with localcontext() as context:
        context.prec = 40 + int(0.61 * (top - root.exponent))
        mu = (Decimal(2 * root.at + 1) / 2) * Decimal(2) ** root.exponent
        a = np.array([[Decimal(int(v)) for v in r] for r in matrix], dtype=object).reshape(dim, dim)
        a[np.diag_indices(dim)] -= mu
        lu, order = factored(a)
        while len(out) < root.times:
            start += 1
            v = np.array([Decimal(1 + (j + 1) * 2654435761 * start % 1009) / 1009 for j in range(dim)], dtype=object)
            for _ in range(4):
                v = unit(solved(lu, order, unit(v, out)), out)
            if max(abs(x) for x in a.dot(v)) <= Decimal(2) ** (root.exponent + 20):
                out.append(v)
            elif start > 50 * root.times:
                raise ArithmeticError("no vector of the root's space was found")
        flat = []
        for v in out:
            lead = max(range(dim), key=lambda j: (abs(v[j]), -j))
            flat.append([float(x if v[lead] > 0 else -x) for x in v])
    return flat


@dataclass
class Whitening:
    """n, sums, and for each component the root of the scatter matrix, its unit vector and share of the trace."""

    n: int
    sums: list[int]
    roots: list[float]
    vectors: list[list[float]]
    explained: list[float]


def fit(rows: DataFrame, dim: int, scale: float, components: int) -> Whitening:
    """Fit on ``rows(vector array<double>)``, all of length ``dim``."""
    spark = rows.sparkSession
    n, sums, matrix = scatter(rows, dim, scale)
    trace = int(sum(matrix[i, i] for i in range(dim)))
    if not trace:
        return Whitening(n, sums, [], [], [])
    found = greatest_roots(characteristic_polynomial(spark, matrix), components)
    left, use = components, []
    for r in found:
        if left > 0:
            use.append(r)
            left -= r.times
    top = trace.bit_length()
    shared = spark.sparkContext.broadcast(matrix)

    def solve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["i"].tolist():
                yield pd.DataFrame({"i": [i], "vectors": [null_space(shared.value, use[i], top)]})

    frame = spark.createDataFrame([(i,) for i in range(len(use))], "i int").repartition(len(use))
    spaces = {r["i"]: r["vectors"] for r in frame.mapInPandas(solve, "i int, vectors array<array<double>>").collect()}
    shared.unpersist()
    roots, vectors = [], []
    with localcontext() as context:
        context.prec = 60
        for i, r in enumerate(use):
            value = Decimal(2 * r.at + 1) / 2 * Decimal(2) ** r.exponent
            for v in spaces[i][:components - len(roots)]:
                roots.append(value)
                vectors.append([float(x) for x in v])
        return Whitening(n, sums, [float(r) for r in roots], vectors, [float(r / trace) for r in roots])


def project(rows: DataFrame, key: str, dim: int, scale: float, model: Whitening) -> DataFrame:
    """``key, deviation, deviation_exact, w`` of every row."""
    n, sums = model.n, model.sums
    directions = np.array(model.vectors).reshape(-1, dim).T / np.sqrt(np.array(model.roots))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(matrix_of(batch.column(1), dim), scale)
            largest = n * max(-int(x.min()), int(x.max())) + max(map(abs, sums))
            if dim * largest ** 2 < 1 << 63:
                z = n * x - np.array(sums, dtype="int64")
                squares = np.einsum("ij,ij->i", z, z).tolist()
            else:
                z = n * x.astype(object) - np.array(sums, dtype=object)
                squares = (z * z).sum(axis=1).tolist()
            w = z.astype("float64") @ directions
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v if v < 1 << 63 else None for v in squares], pa.int64()),
                 pa.array([Decimal(v) if v < 10 ** 38 else None for v in squares], pa.decimal128(38, 0)),
                 pa.array(list(w), pa.list_(pa.float64()))], names=[key, "deviation", "deviation_exact", "w"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "vector").mapInArrow(
        run, f"`{key}` {kind}, deviation long, deviation_exact decimal(38,0), w array<double>")


def identity_error(projected: DataFrame, components: int) -> float:
    """Largest absolute entry of the projections' covariance (divisor n, centred first) minus the identity."""
    means = projected.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(components)]).first()
    centred = [F.col("w")[i] - F.lit(means[f"m{i}"]) for i in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    moments = projected.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(moments[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: float = 1024,
           components: int = 8) -> DataFrame:
    """``key, component, n, deviation, deviation_exact, whitened, explained, identity_error`` for each usable row and component.

    A constant added to every integer cancels in all of them, so none is.
    """
    spark = table.sparkSession
    kind = table.schema[key].dataType.simpleString()
    out = (f"`{key}` {kind}, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, "
           "explained double, identity_error double")
    given = table.select(key, F.col(vector).cast("array<double>").alias("vector"))
    proper = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    given = given.where(proper & (F.size("vector") > 0))
    common = given.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], out)
    dim = common["d"]
    rows = given.where(F.size("vector") == dim)
    model = fit(rows, dim, scale, components)
    k = len(model.roots)
    if not k:
        return spark.createDataFrame([], out)
    # A checkpoint keeps the partitions, so rows come out in the table's order; files are read largest first.
    projected = cut_lineage(project(rows, key, dim, scale, model))
    error = identity_error(projected, k)
    shares = F.array(*[F.lit(x) for x in model.explained])
    return (projected.select(key, "deviation", "deviation_exact", F.posexplode("w").alias("at", "whitened"))
            .select(key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                    "deviation_exact", "whitened", F.get(shares, "at").alias("explained"), F.lit(error).alias("identity_error")))
