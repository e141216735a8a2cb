"""Embedding whitening by spectrum slicing (operator 11).

Spark computes exact integer sums of the scaled vectors, then their centred covariance, in tasks that
hand on one matrix each as cells to be summed. The covariance (dims x dims, whatever the number of
vectors) is decomposed on the driver: the inertia of an LDL^T factorisation of V - sI tells how many
eigenvalues lie above s, so bisection isolates the k-th largest; Rayleigh quotient iteration converges to
it cubically from there; two more inertia counts, just above and just below the value found, certify that
it is number k. Whitened vectors are written once, their covariance is taken from the written values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import stage

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
LEAST_SHARE = 1e-12   # components with no larger share of the trace have no direction to speak of
RESULT = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double",
          "identity_error": "double"}
LIMIT = 1 << 31       # scaled entries are held within +-LIMIT


def scaled(batch, column: str, dims: int | None = None):
    """(rows, x): positions in an Arrow batch of the usable vectors of ``dims`` entries, and
    floor(SCALE * entry) + SHIFT of their entries as a matrix of 64-bit integers."""
    import numpy as np
    import pyarrow.compute as pc

    lists = batch.column(column)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
    rows = np.flatnonzero(lengths == dims)
    if len(rows) == 0:
        return rows, np.zeros((0, dims), dtype=np.int64)
    flat = lists.take(rows).flatten()
    values = np.asarray(flat.cast("float64").fill_null(float("nan")), dtype=np.float64).reshape(len(rows), dims)
    fine = np.isfinite(values).all(axis=1)
    x = np.clip(np.floor(SCALE * values[fine]) + SHIFT, -LIMIT, LIMIT).astype(np.int64)
    return rows[fine], x


def inertia_above(v, shift: float) -> int:
    """Number of eigenvalues of the symmetric matrix ``v`` above ``shift``: the positive ones of the
    block-diagonal factor of V - shift I = P L D L^T P^T (Bunch-Kaufman pivoting, blocks of 1 or 2)."""
    import numpy as np

    a = v - shift * np.eye(len(v))
    positive, alpha = 0, (1 + 17 ** 0.5) / 8
    while len(a):
        n = len(a)
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if n > 1 else 0
        most = column[r - 1] if n > 1 else 0.0
        pair = False
        if most == 0:
            pass
        elif abs(a[0, 0]) < alpha * most:
            row = np.abs(a[r])
            row[r] = 0
            if abs(a[0, 0]) * row.max() < alpha * most * most:
                if abs(a[r, r]) >= alpha * row.max():
                    order = [r, *range(1, r), 0, *range(r + 1, n)]
                    a = a[np.ix_(order, order)]
                else:
                    pair = True
        if pair:
            order = [0, r, *range(1, r), *range(r + 1, n)]
            a = a[np.ix_(order, order)]
            block, rest = a[:2, :2], a[2:, :2]
            positive += 1 if np.linalg.det(block) < 0 else 2 * (block[0, 0] > 0)
            a = a[2:, 2:] - rest @ np.linalg.solve(block, rest.T)
        else:
            d = a[0, 0]
            positive += d > 0
            rest = a[1:, 0]
            a = a[1:, 1:] - (np.outer(rest, rest) / d if most else 0)
    return int(positive)


def leading_eigenpairs(v, count: int, least: float):
    """(values, vectors as columns) of the ``count`` largest eigenvalues above ``least``, largest first,
    each certified by inertia counts to be number k of the spectrum."""
    import numpy as np

    n = len(v)
    norm = float(np.abs(v).sum(axis=1).max())  # Gershgorin: no eigenvalue is larger
    if norm == 0:
        return np.zeros(0), np.zeros((n, 0))
    slack = 64 * n * np.finfo(float).eps * norm
    count = min(count, inertia_above(v, max(least, slack)))
    values, found = [], np.zeros((n, 0))
    rng = np.random.default_rng(0)
    for k in range(1, count + 1):
        lo, hi = 0.0, 1.01 * norm           # above lo: k eigenvalues at least; above hi: fewer than k
        for _ in range(200):
            # bisect until the k-th eigenvalue is alone (or in a cluster that rounding cannot part)
            while hi - lo > slack and inertia_above(v, lo) - inertia_above(v, hi) > 1:
                lo, hi = _halve(v, k, lo, hi)
            value, vector = _rayleigh(v, (lo + hi) / 2, found, rng)
            if inertia_above(v, value + slack) < k <= inertia_above(v, value - slack):
                break                       # the counts certify that it is number k
            lo, hi = _halve(v, k, lo, hi)   # the iteration left for a neighbour: start closer
        else:
            raise RuntimeError(f"eigenvalue {k} was not found")
        values.append(value)
        found = np.column_stack([found, vector])
    return np.array(values), found


def _halve(v, k: int, lo: float, hi: float):
    mid = (lo + hi) / 2
    return (mid, hi) if inertia_above(v, mid) >= k else (lo, mid)


def _rayleigh(v, shift: float, found, rng):
    """Rayleigh quotient iteration from an inverse iteration at ``shift``, orthogonal to ``found``."""
    import numpy as np

    n = len(v)
    unit = np.eye(n)

    def solved(s, b):
        for nudge in (0, 1, 4):  # a shift that is an eigenvalue to the last bit
            try:
                z = np.linalg.solve(v - (s + nudge * np.spacing(max(abs(s), 1e-300))) * unit, b)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(z).all() and np.linalg.norm(z) > 0:
                z = z / np.linalg.norm(z)
                z = z - found @ (found.T @ z)
                if np.linalg.norm(z) > 1e-8:
                    return z / np.linalg.norm(z)
        return b

    z = rng.standard_normal(n)
    z -= found @ (found.T @ z)
    z /= np.linalg.norm(z)
    for _ in range(3):
        z = solved(shift, z)
    best = (np.inf, 0.0, z)
    for _ in range(20):
        value = float(z @ v @ z)
        error = float(np.linalg.norm(v @ z - value * z))
        if error >= best[0]:
            break
        best = (error, value, z)
        z = solved(value, z)
    return best[1], best[2]


@dataclass
class Whitening:
    """A fitted transformation: vectors of ``dims`` entries to ``len(values)`` whitened components."""
    dims: int
    n: int
    sums: list[int] = field(repr=False)
    trace: float
    values: list[float]
    vectors: object = field(repr=False)  # dims x components

    def transform(self, vectors: DataFrame, column: str = "embedding", carry: list[str] = ()) -> DataFrame:
        """The carried columns, ``deviation`` (null where it does not fit a long) and ``whitened`` (one
        double per component) of every usable vector of ``vectors``. The two names must not be carried."""
        if {"deviation", "whitened"} & set(carry):
            raise ValueError("deviation and whitened are names of the result")
        n, dims, sums, width = self.n, self.dims, self.sums, len(self.values)
        turn, roots = self.vectors, [v ** 0.5 for v in self.values]

        def apply(batches):
            import numpy as np
            import pyarrow as pa

            whole = np.array([s // n for s in sums], dtype=np.int64)
            rest = [s % n for s in sums]
            part = np.array(rest, dtype=np.int64)
            for b in batches:
                rows, x = scaled(b, column, dims)
                if len(rows) == 0:
                    continue
                y = x - whole
                centred = y - part / n
                rough = ((n * centred) ** 2).sum(axis=1)
                d = n * y - part
                exact = (d * d).sum(axis=1).tolist()
                for i in np.flatnonzero(rough > 9e18).tolist():  # near or beyond the largest long
                    big = sum((n * int(a) - r) ** 2 for a, r in zip(y[i], rest)) if rough[i] < 9.5e18 else 1 << 63
                    exact[i] = big if big < 1 << 63 else None
                white = (centred @ turn) / roots
                kept = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*[kept.column(c) for c in carry], pa.array(exact, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(white.ravel()))],
                    names=[*carry, "deviation", "whitened"])

        source = vectors.select(*carry, column) if column not in carry else vectors.select(*carry)
        schema = vectors.select(*carry).schema.add("deviation", "long").add("whitened", T.ArrayType(T.DoubleType()))
        return source.mapInArrow(apply, schema)


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit over all usable vectors: not null, without null or non-finite entries, of the most frequent
    length above 0 (the longest of several). None if there are no vectors or they are all equal.

    Entries c count as floor(1024 c) + 100000, held within +-2^31. Components whose eigenvalue is
    no more than 1e-12 of the trace are left out, so a table of low rank has fewer than ``components``.
    """
    import numpy as np

    only = vectors.select(F.col(column).alias("embedding"))
    usable = only.filter("size(embedding) > 0 AND NOT exists(embedding, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity'))")
    most = usable.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if most is None:
        return None
    dims, n = most["dims"], most["count"]

    def sum_up(batches):
        import pyarrow as pa

        total = np.zeros(dims, dtype=np.int64)
        for b in batches:
            total += scaled(b, "embedding", dims)[1].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(total)], names=["i", "s"])

    sums = [0] * dims
    for r in only.mapInArrow(sum_up, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        sums[r["i"]] = int(r["s"])
    whole, part = np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64)

    def multiply(batches):
        import pyarrow as pa

        total = np.zeros((dims, dims))
        for b in batches:
            d = (scaled(b, "embedding", dims)[1] - whole) - part / n
            total += d.T @ d
        upper = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array((upper[0] * dims + upper[1]).astype(np.int32)), pa.array(total[upper])], names=["cell", "s"])

    v = np.zeros((dims, dims))
    # dims (dims + 1) / 2 cells come to the driver, whatever the number of vectors
    for r in only.mapInArrow(multiply, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        i, j = divmod(r["cell"], dims)
        v[i, j] = v[j, i] = r["s"] / n
    trace = float(np.trace(v))
    values, turn = leading_eigenpairs(v, components, LEAST_SHARE * trace)
    return Whitening(dims, n, sums, trace, values.tolist(), turn) if len(values) else None


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of the column ``whitened`` minus the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    row = white.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(row, pairs))


def whiten(vectors: DataFrame, column: str = "embedding", id_col: str = "vec_id",
           components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: id, component (from 1), n, deviation, whitened,
    explained, identity_error. Repeated rows and ids come back as often as they are there; a null id is
    an id like any other. Tables that are empty, or whose vectors are all equal, give no rows."""
    model = fit(vectors, column, components)
    if model is None:
        return vectors.select(F.col(id_col), *[F.lit(None).cast(t).alias(c) for c, t in RESULT.items()]).limit(0)
    own = vectors.select(F.col(id_col).alias("id"), F.col(column).alias("embedding"))
    white = stage(model.transform(own, carry=["id"]), "whitened")
    error = identity_error(white, len(model.values))
    shares = F.array(*[F.lit(v / model.trace) for v in model.values])
    return (white.select("id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
            .select(F.col("id").alias(id_col), (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                    "deviation", "whitened", F.get(shares, F.col("_k")).alias("explained"), F.lit(error).alias("identity_error")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the eight leading whitened components of every vector of ``embeddings``."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
