"""Embedding near-dedup by NN-descent (operator 3).

Each distinct vector keeps a list of its K most similar vectors of *other* components. A pass adds
the leaves of new random projection trees to the lists and refines them by joining neighbours of
neighbours, round after round, until a round changes no list: the members of a vector's list (and
of the lists it is in) are compared with each other. Pairs at the threshold join their vectors to
components; what a list holds of its own component then makes room, so a list that was full of links
goes on with further vectors. Lists are carried from pass to pass. Passes that bring no link are
followed by an audit, which compares a bounded sample with all vectors and only measures: the search
goes on while its recall is below the bound, and fails if the bound is never reached. Link counts
are then taken exactly inside each component, block against block, without emitting pairs; vectors
so close to their component's centre that any two of them must be linked are counted without being
compared.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import stage
from quire.llm.graph import connected_components

THRESHOLD = 0.95
K = 8               # length of a neighbour list
LEAF = 128          # vectors in a tree leaf, on average
TREES = 6           # trees per pass
QUIET = 2           # passes in a row without a new link after which the search has settled
PASSES = 100        # a search that has not settled by then fails
AUDIT = 1000        # audited vectors
RECALL = 0.999      # least mean share of an audited vector's links that are in its component
LARGE = 0.01        # share of all vectors above which a component is large
BLOCK = 256


def _matrix(column):
    """A list column of equal lengths as a matrix of doubles."""
    import numpy as np
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): every row's node (null if the vector links with nothing), and every distinct
    usable vector with its number of rows, unit vector and norm."""
    v = F.col(vec_col).cast("array<double>")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable, v).alias("v"))
    # scaled by the largest component, so that squares neither overflow nor vanish
    top = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("v", F.when(top > 0, F.transform("v", lambda x: x / top + 0.0)))
    rows = stage(rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v"))), "vectors")
    groups = rows.filter("node IS NOT NULL").groupBy("node", "v").agg(F.count(F.lit(1)).alias("mult"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    nodes = (groups.withColumn("norm", norm).withColumn("dim", F.size("v"))
             .withColumn("u", F.transform("v", lambda x: x / F.col("norm"))))
    nodes = stage(nodes, "vector-nodes")
    if nodes.groupBy("node").count().filter("count > 1").limit(1).count():
        raise RuntimeError("two vectors share a 64-bit name")
    return rows.select("id", "node"), nodes


def _leaf_lists(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """(node, nbr, sim): the K nearest vectors of other components in the leaves of random trees.

    A leaf is the sign pattern under random hyperplanes. A pattern with too many vectors, like that
    of a crowd, is cut by as many further hyperplanes through its own mean as it takes, and what is
    still too large by hash."""
    depth = max(0, math.ceil(math.log2(max(1, n) / LEAF)))
    zs = [f"z{i}" for i in range(depth)]

    def code(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            dim = b.column("dim").to_numpy()
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                u, node = _matrix(b.column("u").take(pa.array(at))), b.column("node").take(pa.array(at))
                for t in range(TREES):
                    p = u @ np.random.default_rng([seed, t, d]).standard_normal((d, 2 * depth))
                    codes = ((p[:, :depth] > 0) @ (1 << np.arange(depth, dtype=np.int64))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [node, pa.array(np.full(len(at), t * 100_000 + d, np.int64)), pa.array(codes),
                         *(pa.array(np.ascontiguousarray(p[:, depth + i])) for i in range(depth))],
                        names=["node", "tree", "code", *zs])

    fields = "".join(f", {z} double" for z in zs)
    coded = stage(nodes.select("node", "dim", "u").mapInArrow(code, f"node long, tree long, code long{fields}"), "nn-codes")
    stats = coded.groupBy("tree", "code").agg(F.count(F.lit(1)).alias("c"), *[F.avg(z).alias(f"m{z}") for z in zs])
    planes = F.ceil(F.log2(F.col("c") / LEAF))
    cut = sum((F.when((planes > i) & (F.col(z) > F.col(f"m{z}")), F.lit(1 << i)).otherwise(F.lit(0)) for i, z in enumerate(zs)), F.lit(0))
    cut = coded.join(stats, ["tree", "code"]).select("node", "tree", "code", cut.cast("long").alias("cut"))
    sizes = cut.groupBy("tree", "code", "cut").agg(F.ceil(F.count(F.lit(1)) / (2 * LEAF)).alias("parts"))
    leaf = (cut.join(sizes, ["tree", "code", "cut"])
            .withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "node"), "parts")).drop("parts"))

    def nearest(table):
        import numpy as np
        import pyarrow as pa

        u, comp = _matrix(table["u"]), table["comp"].to_numpy()
        node = table["node"].to_numpy()
        s = u @ u.T
        s[comp[:, None] == comp] = -2.0
        k = min(K, len(node) - 1)
        if k < 1:
            at = np.zeros((0, 0), np.int64)
            k = 0
        else:
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        i = np.repeat(np.arange(len(node)), k)
        j = at.reshape(-1)
        ok = s[i, j] > -1.5
        i, j = i[ok], j[ok]
        return pa.table({"node": node[i], "nbr": node[j], "sim": s[i, j]})

    return (leaf.join(nodes.select("node", "u", "comp"), "node").groupBy("tree", "code", "cut", "part")
            .applyInArrow(nearest, "node long, nbr long, sim double"))


def _best(lists: DataFrame) -> DataFrame:
    """The K best entries of each list; one is fresh if no round has seen it yet."""
    order = Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")
    return (lists.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
            .withColumn("r", F.row_number().over(order)).filter(F.col("r") <= K).drop("r"))


def _carried(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """The lists without vectors of the own component; a list that lost some is to be joined again."""
    comps = nodes.select("node", "comp")
    both = (lists.join(comps, "node").join(comps.select(F.col("node").alias("nbr"), F.col("comp").alias("other")), "nbr")
            .withColumn("lost", F.max(F.col("comp") == F.col("other")).over(Window.partitionBy("node"))))
    return both.filter("comp != other").select("node", "nbr", "sim", F.col("lost").alias("fresh"))


def _refine(nodes: DataFrame, lists: DataFrame, n: int) -> DataFrame:
    """One neighbours-of-neighbours join: better neighbours found among the members of each list
    and of the (K best) lists that a vector is in, wherever one of these is fresh."""
    back = Window.partitionBy("nbr").orderBy(F.desc("sim"), "node")
    inverse = (lists.withColumn("r", F.row_number().over(back)).filter(F.col("r") <= K)
               .select(F.col("nbr").alias("pivot"), F.col("node").alias("member"), "fresh"))
    members = (lists.select(F.col("node").alias("pivot"), F.col("nbr").alias("member"), "fresh").unionByName(inverse)
               .unionByName(lists.select(F.col("node").alias("pivot"), F.col("node").alias("member"), F.lit(False).alias("fresh")))
               .groupBy("pivot", "member").agg(F.max("fresh").alias("fresh"))
               .withColumn("live", F.max("fresh").over(Window.partitionBy("pivot"))).filter("live").select("pivot", "member"))
    floors = lists.groupBy("node").agg(F.when(F.count(F.lit(1)) >= K, F.min("sim")).otherwise(-1.0).alias("floor"))
    known = nodes.select("node", "u", "comp").join(floors, "node", "left").select(
        F.col("node").alias("member"), "u", "comp", F.coalesce("floor", F.lit(-1.0)).alias("floor"))
    bundles = max(1, n // 512)

    def join(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("pivot")
        u, comp, floor = _matrix(table["u"]), table["comp"].to_numpy(), table["floor"].to_numpy()
        node, pivot = table["member"].to_numpy(), table["pivot"].to_numpy()
        starts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]])
        stops = np.r_[starts[1:], len(pivot)]
        a, b, c = [], [], []
        for x, y in zip(starts.tolist(), stops.tolist()):
            if y - x < 2:
                continue
            s = u[x:y] @ u[x:y].T
            s[comp[x:y, None] == comp[None, x:y]] = -2.0
            k = min(K, y - x - 1)
            j = np.argpartition(-s, k - 1, axis=1)[:, :k].reshape(-1)
            i = np.repeat(np.arange(y - x), k)
            ok = s[i, j] > np.maximum(floor[x:y], -1.5)[i]
            a.append(node[x:y][i[ok]])
            b.append(node[x:y][j[ok]])
            c.append(s[i[ok], j[ok]])
        none = np.zeros(0, np.int64)
        return pa.table({"node": np.concatenate([none, *a]), "nbr": np.concatenate([none, *b]),
                         "sim": np.concatenate([none.astype(float), *c])})

    # members of one pivot have one dimension: lists never cross dimensions
    dims = nodes.select(F.col("node").alias("pivot"), "dim")
    return (members.join(known, "member").join(dims, "pivot")
            .groupBy("dim", F.pmod(F.xxhash64("pivot"), F.lit(bundles)).alias("bundle"))
            .applyInArrow(join, "node long, nbr long, sim double"))


def _audit(nodes: DataFrame, threshold: float, seed: int) -> float:
    """Recall measured on AUDIT vectors, compared with all vectors: the mean share of a vector's links
    that lead into its component, over those that have links. One half of the sample is drawn from all
    vectors, the other from those outside the large components, and the lower of the two counts.
    Nothing that is found here enters the result."""
    n = nodes.count()
    large = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > LARGE * n).select("comp")
    draw = F.xxhash64(F.lit(seed), "node")
    parts = [rows.orderBy(draw).limit(AUDIT // 2).select("node", "comp", "dim", "u", F.lit(k).alias("half"))
             for k, rows in enumerate((nodes, nodes.join(large, "comp", "left_anti")))]
    sample = parts[0].unionByName(parts[1]).toArrow()
    shared = nodes.sparkSession.sparkContext.broadcast(sample)  # AUDIT vectors at most

    def run(batches):
        import numpy as np
        import pyarrow as pa

        q = shared.value
        q_dim, q_node, q_comp = (q[c].to_numpy() for c in ("dim", "node", "comp"))
        sets = {int(d): (np.flatnonzero(q_dim == d), _matrix(q["u"].take(pa.array(np.flatnonzero(q_dim == d)))))
                for d in np.unique(q_dim)}
        for b in batches:
            if not b.num_rows:
                continue
            dim, node, comp = (b.column(c).to_numpy() for c in ("dim", "node", "comp"))
            found, missed = np.zeros(len(q_node), np.int64), np.zeros(len(q_node), np.int64)
            for d, (at_q, uq) in sets.items():
                at = np.flatnonzero(dim == d)
                if not len(at):
                    continue
                i, j = np.nonzero(_matrix(b.column("u").take(pa.array(at))) @ uq.T >= threshold)
                i, j = at[i], at_q[j]
                i, j = i[node[i] != q_node[j]], j[node[i] != q_node[j]]
                same = comp[i] == q_comp[j]
                found += np.bincount(j[same], minlength=len(found))
                missed += np.bincount(j[~same], minlength=len(found))
            at = np.flatnonzero(found + missed)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, found[at], missed[at])], names=["q", "found", "missed"])

    sums = (nodes.select("node", "comp", "dim", "u").mapInArrow(run, "q long, found long, missed long")
            .groupBy("q").agg(F.sum("found").alias("found"), F.sum("missed").alias("missed")).collect())  # AUDIT rows at most
    half = sample["half"].to_pylist()
    shares: list[list[float]] = [[], []]
    for r in sums:
        shares[half[r["q"]]].append(r["found"] / (r["found"] + r["missed"]))
    return min((sum(x) / len(x) for x in shares if x), default=1.0)


def vector_components(nodes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, float]:
    """(nodes with ``comp``, audited recall). Passes go on until QUIET in a row bring no link and the
    audited recall is RECALL or more; it is an error if PASSES do not reach this."""
    n = nodes.count()
    current = nodes.withColumn("comp", F.col("node"))
    lists = links = None
    quiet, recall = 0, 0.0
    for p in range(PASSES):
        leaves = _leaf_lists(current, n, p).withColumn("fresh", F.lit(True))
        lists = stage(_best(leaves if lists is None else leaves.unionByName(_carried(lists, current))), "nn-lists")
        while lists.filter("fresh").limit(1).count():
            better = _refine(current, lists, n).withColumn("fresh", F.lit(True))
            lists = stage(_best(lists.withColumn("fresh", F.lit(False)).unionByName(better)), "nn-lists")
        new = lists.filter(F.col("sim") >= threshold).select(F.col("node").alias("a"), F.col("nbr").alias("b"))
        quiet += 1
        if new.limit(1).count():
            quiet = 0
            links = stage(new if links is None else links.unionByName(new), "nn-links")
            current = _label(nodes, links)
        elif quiet >= QUIET:
            recall = _audit(current, threshold, p)
            if recall >= RECALL:
                return current, recall
    raise RuntimeError(f"near vectors: not settled after {PASSES} passes, last audited recall {recall:.4f}, wanted {RECALL}")


def _label(nodes: DataFrame, links: DataFrame) -> DataFrame:
    comps = connected_components(links).withColumnRenamed("node", "_n")
    return stage(nodes.join(comps, F.col("node") == F.col("_n"), "left")
                 .withColumn("comp", F.coalesce("component", "node")).drop("_n", "component"), "nn-nodes")


def count_links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, n): for every node, the rows of other nodes of its component that it is linked with.

    A vector within half the threshold's angle of its component's centre is core; core vectors are
    linked with each other by the triangle inequality of angles and are only counted. All other
    pairs are compared block by block."""
    sizes = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("comp")
    inside = nodes.join(sizes, "comp")
    dims = [r["dim"] for r in nodes.select("dim").distinct().collect()]  # a handful of vector lengths
    widest = max(dims, default=0)
    centres = (inside.groupBy("comp").agg(F.array(*[F.sum(F.get("u", F.lit(i))) for i in range(widest)]).alias("centre")))
    inside = inside.join(centres, "comp")
    dot = F.aggregate(F.zip_with("u", F.slice("centre", 1, F.col("dim")), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    length = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda a, x: a + F.coalesce(x * x, F.lit(0.0))))
    half = math.cos(math.acos(threshold) / 2 - 1e-7)
    core = F.coalesce(dot / F.when(length > 0, length) >= half, F.lit(False))
    inside = stage(inside.withColumn("core", core).select("comp", "node", "mult", "v", "norm", "core"), "links-members")
    shape = inside.groupBy("comp").agg(
        F.ceil(F.count_if("core") / BLOCK).alias("cores"), F.ceil(F.count_if(~F.col("core")) / BLOCK).alias("others"),
        F.sum(F.when(F.col("core"), F.col("mult")).otherwise(0)).alias("core_rows"))
    placed = inside.join(shape, "comp").withColumn("blk", F.when(
        F.col("core"), F.pmod(F.xxhash64("node"), F.greatest(F.col("cores"), F.lit(1)))).otherwise(
        F.col("cores") + F.pmod(F.xxhash64("node"), F.greatest(F.col("others"), F.lit(1)))))
    known = placed.filter("core").select("node", (F.col("core_rows") - F.col("mult")).alias("n"))
    first = F.when(F.col("core"), F.col("cores")).otherwise(F.lit(0).cast("long"))
    last = F.col("cores") + F.col("others") - 1
    other = F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>")))
    dealt = (placed.withColumn("with", other)
             .select("comp", F.least("blk", "with").alias("i"), F.greatest("blk", "with").alias("j"),
                     "blk", "node", "mult", "v", "norm"))

    def count(table):
        import numpy as np
        import pyarrow as pa

        v, norm, mult = _matrix(table["v"]), table["norm"].to_numpy(), table["mult"].to_numpy()
        node, blk = table["node"].to_numpy(), table["blk"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        x, y = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        linked = (v[x] @ v[y].T) / (norm[x][:, None] * norm[y]) >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
            return pa.table({"node": node[x], "n": linked @ mult[y]})
        return pa.table({"node": np.r_[node[x], node[y]], "n": np.r_[linked @ mult[y], linked.T @ mult[x]]})

    compared = dealt.groupBy("comp", "i", "j").applyInArrow(count, "node long, n long")
    return known.unionByName(compared).groupBy("node").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows are linked when the cosine of their vectors is at least ``threshold``. Null, empty and zero
    vectors and vectors with null or non-finite components link with nothing; vectors of different
    lengths do not link. Equal vectors are one node, so copies cost nothing; each counts as a link
    of the others. A null id is treated as the smallest of all and returned as null; ``kept`` is
    true for the row whose id is its component's.
    """
    low = -(1 << 63)
    rows, nodes = distinct_vectors(vectors.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(low))), "_id", vec_col)
    labelled, _ = vector_components(nodes, threshold)
    counts = count_links(labelled, threshold).withColumnRenamed("node", "_m")
    info = (labelled.select("node", "comp", "mult").join(counts, F.col("node") == F.col("_m"), "left")
            .select(F.col("node").alias("_n"), "comp", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    full = stage(rows.join(info, F.col("node") == F.col("_n"), "left").drop("_n", "node"), "vector-links")
    least = full.filter("comp IS NOT NULL").groupBy(F.col("comp").alias("_c")).agg(F.min("id").alias("root"))
    found = F.coalesce("root", "id")
    return full.join(least, F.col("comp") == F.col("_c"), "left").select(
        F.when(F.col("id") != low, F.col("id")).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(found != low, found).alias("component_id"), (F.col("id") == found).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every vector's links and component."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON n.x = c.vec_id
"""
