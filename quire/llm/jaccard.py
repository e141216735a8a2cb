"""N-gram Jaccard join by signature trees (operator 4).

1. Every whole text becomes its set of distinct 5-word shingles (64-bit hashes). Texts with the
   same set share a set id; the rest works on sets.
2. Shingles are counted over all sets and ordered by (count up to HOT, hash). Two sets of Jaccard
   similarity t or more share one of the first ``n - ceil(t n) + 1`` shingles of each in any such
   order, so a set is filed under these only, and a shingle that no other set has is no file at all.
3. The sets filed under a shingle are compared with two pivots of that file; links found join them.
4. What is still apart is compared by signature trees of one level, without inner nodes: a leaf is up to LEAF sets that are already
   joined, with the OR of their token bitmaps, their size range and their fewest bits; under every
   shingle the leaves of different components are traversed pairwise, and a pair goes on to its
   sets, then to the exact count, only while the largest overlap that the bitmaps and sizes
   allow reaches the threshold. Sets of one component need no comparison. Leaves do not span
   components, so the unlinked sets that share a filed shingle are paired in full before the bitmaps
   prune the pairs: no link is lost, but such a file costs the square of its sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import arrow_schema, release, stage
from quire.llm.graph import connected_components
from quire.llm.tokens import text_batches

N_WORDS = 5
PERCENT = 75           # similarity in percent
HOT = 64               # counts are told apart below this
CHUNK_PAIRS = 800_000
LEAF = 32
SIG_WORDS = 16         # 64-bit words of a token bitmap


def shingler(k: int):
    """A function from text to its sorted distinct shingle hashes (numpy uint64)."""
    import numpy as np
    import xxhash

    class Hashes(dict):
        def __missing__(self, word):
            if len(self) > 200_000:
                self.clear()
            h = self[word] = xxhash.xxh3_64_intdigest(word)
            return h

    of_word = Hashes()
    mult = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]

    def shingles(text: str | None):
        # bytes.lower() changes A-Z only and bytes.split() splits at space and U+0009..U+000D
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(of_word.__getitem__, words), dtype=np.uint64, count=len(words))
        w = min(k, len(words))
        acc = np.full(len(words) - w + 1, w, np.uint64)
        for j in range(w):
            acc = (acc ^ h[j:j + len(acc)]) * mult[0]
            acc ^= acc >> np.uint64(29)
        acc = acc * mult[1]
        acc ^= acc >> np.uint64(32)
        return np.unique(acc)

    return shingles


_ROW = "key int, kind int, a binary, b binary, c binary, d binary"
SET_ROW, SIZE_ROW, PAIR_ROW, COUNT_ROW = 0, 1, 2, 3


def _rows(rows, schema):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(schema))],
                                      schema=schema)


def _by_key(keys, order_also, *arrays):
    """Slices of aligned arrays for each key: (key, slices...)."""
    import numpy as np
    order = np.lexsort((order_also, keys))
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
    stops = np.r_[starts[1:], len(keys)] if len(keys) else []
    arrays = [x[order] for x in arrays]
    for s, e in zip(starts, stops):
        yield int(keys[s]), [x[s:e] for x in arrays]


def _runs(values):
    """Run-length code of an array: the values of its runs and their lengths as bytes, a run of more
    than 255 in several parts."""
    import numpy as np
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    n = np.diff(np.r_[start, len(values)])
    parts = -(-n // 255)
    lengths = np.full(int(parts.sum()), 255, np.uint8)
    lengths[np.cumsum(parts) - 1] = n - 255 * (parts - 1)
    return np.repeat(values[start], parts), lengths


def _bucket_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` hash partitions a key that lands in it, so that as many buckets as there
    are partitions are dealt evenly. Few large buckets keep the shingles of a set together, whose id
    then compresses away."""
    rows = (spark.range(64 * parts + 1024).select(F.col("id").cast("int").alias("key"))
            .groupBy(F.pmod(F.hash("key"), F.lit(parts)).alias("p")).agg(F.min("key").alias("key")).collect())
    keys = {r["p"]: r["key"] for r in rows}
    return [keys.get(p, p) for p in range(parts)]


def _emit_shingles(id_col: str, k: int, bucket_keys: list[int]):
    """Packs the shingles of a chunk of texts into a row per shingle range. A shingle that HOT or
    more sets of the chunk have is counted here and travels with its sets, not with the counts."""
    buckets = len(bucket_keys)
    schema = arrow_schema(_ROW)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingles = shingler(k)
        seen: dict[int, object] = {}
        sets: list[tuple] = []
        held = 0

        def flush():
            ids, set_ids, checks, sizes = (np.array([s[i] for s in sets], np.int64) for i in range(4))
            rows = [(bucket_keys[int(ids[0]) % buckets], SET_ROW, ids.tobytes(), set_ids.tobytes(),
                     checks.tobytes(), sizes.tobytes())]
            names = np.fromiter(seen, np.int64, len(seen))
            lens = np.array([len(v) for v in seen.values()], np.int64)
            tok = np.concatenate([np.zeros(0, np.uint64), *seen.values()])
            own = np.repeat(names, lens)
            order = np.argsort(tok, kind="stable")
            tok, own = tok[order], own[order]
            start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, np.int64)
            n = np.diff(np.r_[start, len(tok)])
            hot = n >= HOT
            is_hot = np.repeat(hot, n)
            for key, (t, c) in _by_key((tok[start[hot]] % np.uint64(buckets)).astype(np.int64), tok[start[hot]],
                                       tok[start[hot]], n[hot]):
                rows.append((bucket_keys[key], COUNT_ROW, t.tobytes(), c.astype(np.int64).tobytes(), None, None))
            cold_t, cold_s = tok[~is_hot], own[~is_hot]
            for key, (t, s) in _by_key((cold_t % np.uint64(buckets)).astype(np.int64), cold_s, cold_t, cold_s):
                own_names, times = _runs(s)
                rows.append((bucket_keys[key], PAIR_ROW, t.tobytes(), own_names.tobytes(), times.tobytes(), None))
            hot_t, hot_s = tok[is_hot], own[is_hot]
            order = np.argsort(hot_s, kind="stable")
            hot_t, hot_s = hot_t[order], hot_s[order]
            lo, hi = np.searchsorted(hot_s, names, "left"), np.searchsorted(hot_s, names, "right")
            at = np.arange(len(names))
            for key, (i,) in _by_key(names % buckets, at, at):
                each = [hot_t[lo[x]:hi[x]] for x in i]
                rows.append((bucket_keys[key], SIZE_ROW, names[i].tobytes(), lens[i].tobytes(), (hi[i] - lo[i]).astype(np.int64).tobytes(),
                             np.concatenate(each).tobytes()))
            seen.clear()
            sets.clear()
            for i in range(0, len(rows), 64):
                yield _rows(rows[i:i + 64], schema)

        for b in text_batches(batches):
            for row, text in zip(b.column(id_col).to_pylist(), b.column("text").to_pylist()):
                s = shingles(text)
                if len(s):
                    with np.errstate(over="ignore"):
                        mixed = s * np.uint64(0xD6E8FEB86659FD93)
                        mixed ^= mixed >> np.uint64(31)
                        name = int((np.bitwise_xor.reduce(mixed) * np.uint64(0x9E3779B97F4A7C15)
                                    + mixed.sum(dtype=np.uint64)) >> np.uint64(1))
                    check = int((s ^ (s >> np.uint64(17))).sum(dtype=np.uint64).astype(np.int64))
                else:
                    name = check = -1
                sets.append((row, name, check, len(s)))
                if len(s) and name not in seen:
                    seen[name] = s
                    held += len(s)
                if held >= CHUNK_PAIRS or len(sets) >= 100_000:
                    yield from flush()
                    held = 0
        if sets:
            yield from flush()
        pa.default_memory_pool().release_unused()

    return run


def _cat(parts, kind):
    """The packed parts as one array; the list is emptied."""
    import numpy as np
    out = np.frombuffer(b"".join(parts), dtype=kind)
    parts.clear()
    return out


def _count_shingles(bucket_keys: list[int]):
    """Counts every shingle of a range of hashes and hands those of two sets and more back to the
    sets, which are packed by range of set ids."""
    buckets = len(bucket_keys)
    schema = arrow_schema(_ROW)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tok, own, times, hot_t, hot_n = [], [], [], [], []
        for b in batches:
            keep = []
            for r in b.to_pylist():
                if r["kind"] == PAIR_ROW:
                    tok.append(r["a"])
                    own.append(r["b"])
                    times.append(r["c"])
                elif r["kind"] == COUNT_ROW:
                    hot_t.append(r["a"])
                    hot_n.append(r["b"])
                else:
                    keep.append(tuple(r.values()))
            if keep:
                yield _rows(keep, schema)
        t, s = _cat(tok, np.uint64), np.repeat(_cat(own, np.int64), _cat(times, np.uint8))
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])] if len(t) else np.zeros(0, bool)
        t, s = t[new], s[new]
        start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
        n = np.diff(np.r_[start, len(t)])
        if hot_t:
            ht, inv = np.unique(_cat(hot_t, np.uint64), return_inverse=True)
            hn = np.bincount(inv, weights=_cat(hot_n, np.int64)).astype(np.int64)
            at = np.searchsorted(ht, t[start])
            at[at == len(ht)] = 0
            n_all = n + np.where(ht[at] == t[start], hn[at], 0)
        else:
            n_all = n
        df = np.repeat(np.minimum(n_all, HOT), n)
        two = df >= 2
        t, s, df = t[two], s[two], df[two].astype(np.uint8)
        rows = []
        for key, (x, y, z) in _by_key(s % buckets, s, t, s, df):
            names, lengths = _runs(y)
            rows.append((bucket_keys[key], PAIR_ROW, x.tobytes(), names.tobytes(), lengths.tobytes(), z.tobytes()))
            if len(rows) == 64:
                yield _rows(rows, schema)
                rows = []
        if rows:
            yield _rows(rows, schema)
        pa.default_memory_pool().release_unused()

    return run


_SETS = "kind int, id long, set_id long, chk long, n long, m long, keys array<long>, tokens binary, sig array<long>"


def _file_sets(percent: int):
    """Chooses the shingles under which each set of a range of set ids is filed."""
    schema = arrow_schema(_SETS)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tok, own, times, cnt, names, sizes = [], [], [], [], [], []
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == SET_ROW:
                    ids, set_ids, checks, n = (np.frombuffer(r[c], np.int64) for c in "abcd")
                    m = len(ids)
                    none = pa.nulls(m)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.zeros(m, np.int32)), pa.array(ids), pa.array(set_ids), pa.array(checks), pa.array(n)]
                        + [none.cast(schema.field(i).type) for i in range(5, 9)], schema=schema)
                elif r["kind"] == SIZE_ROW:
                    a, n, k = (np.frombuffer(r[c], np.int64) for c in "abc")
                    names.append(r["a"])
                    sizes.append(r["b"])
                    tok.append(r["d"])
                    own.append(r["a"])
                    times.append(r["c"])
                    cnt.append(np.full(int(k.sum()), HOT, np.uint8).tobytes())
                else:
                    tok.append(r["a"])
                    own.append(r["b"])
                    times.append(np.frombuffer(r["c"], np.uint8).astype(np.int64).tobytes())
                    cnt.append(r["d"])
        t, s, df = _cat(tok, np.uint64), np.repeat(_cat(own, np.int64), _cat(times, np.int64)), _cat(cnt, np.uint8)
        order = np.lexsort((t, df, s))
        t, s, df = t[order], s[order], df[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])] if len(t) else np.zeros(0, bool)
        t, s = t[new], s[new]
        name, first = np.unique(_cat(names, np.int64), return_index=True)
        size = _cat(sizes, np.int64)[first]
        lo, hi = np.searchsorted(s, name, "left"), np.searchsorted(s, name, "right")
        shared = hi - lo
        prefix = size - (percent * size + 99) // 100 + 1
        n_keys = np.minimum(prefix - (size - shared), shared)
        out: list[tuple] = []
        for i in np.flatnonzero(n_keys > 0).tolist():
            own_t = t[lo[i]:hi[i]]
            bits = np.zeros(64 * SIG_WORDS, np.uint8)
            bits[(own_t >> np.uint64(20)) % np.uint64(64 * SIG_WORDS)] = 1
            out.append((1, None, int(name[i]), None, int(size[i]), int(shared[i]), own_t[:n_keys[i]].view(np.int64).tolist(),
                        np.sort(own_t).tobytes(), np.packbits(bits).view(np.int64).tolist()))
            if len(out) == 500:
                yield _rows(out, schema)
                out = []
        if out:
            yield _rows(out, schema)
        pa.default_memory_pool().release_unused()

    return run


def shingle_sets(docs: DataFrame, id_col: str, k: int, percent: int) -> DataFrame:
    """Stage table of two kinds of rows: kind 0, (id, set_id, chk, n) of every text; kind 1, every
    set that is filed under some shared shingle, with these keys, its shared shingles and bitmap."""
    # every shingle passes here once: twice the usual partitions halve what a task holds
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _bucket_keys(docs.sparkSession, parts)
    packed = docs.select(id_col, "text").mapInArrow(_emit_shingles(id_col, k, keys), _ROW)
    counted = packed.repartition(parts, "key").mapInArrow(_count_shingles(keys), _ROW)
    filed = counted.repartition(parts, "key").mapInArrow(_file_sets(percent), _SETS)
    return stage(filed, "shingle-sets")


def _sizes_fit(n1: Column, n2: Column, percent: int) -> Column:
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of set ids whose exact similarity reaches the threshold. Shingles that one set
    alone has cannot be common, so the shared ones and the sizes give the exact count."""
    left = sets.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    schema = arrow_schema("a long, b long")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for i, (x, y, na, nb) in enumerate(zip(batch.column("ta"), batch.column("tb"), batch.column("na").to_pylist(),
                                                   batch.column("nb").to_pylist())):
                both = len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64),
                                          assume_unique=True))
                if 100 * both >= percent * (na + nb - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in "ab"], schema=schema)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long")


def _missing(x, y) -> Column:
    """Bits of one bitmap that the other does not have."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(SIG_WORDS)), F.lit(0))


def _common(x, y) -> Column:
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.get(y, F.lit(i)))) for i in range(SIG_WORDS)), F.lit(0))


def _bits(x) -> Column:
    return sum((F.bit_count(F.get(x, F.lit(i))) for i in range(SIG_WORDS)), F.lit(0))


def tree_pairs(keys: DataFrame, sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components that may still be linked, by signature trees of one level.

    Each set's bit that is missing in the other side is a shingle the other side does not have, so
    the overlap of two sets is at most ``m - missing`` of each (m: its shared shingles), and of two
    leaves at most ``max(m - bits) + common bits``."""
    labelled = (sets.select("set_id", "n", "m", "sig").join(comps.select(F.col("node").alias("_n"), "component"),
                                                            F.col("set_id") == F.col("_n"), "left")
                .withColumn("comp", F.coalesce("component", "set_id")).drop("_n", "component"))
    sizes = labelled.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / LEAF).alias("chunks"))
    labelled = stage(labelled.join(sizes, "comp").withColumn("chunk", F.pmod(F.xxhash64("set_id"), "chunks")).drop("chunks"),
                     "jaccard-components")
    slack = F.col("m") - _bits(F.col("sig"))  # shingles that share a bit with another of the set
    leaves = labelled.groupBy("comp", "chunk").agg(
        F.min("set_id").alias("leaf"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(slack).alias("slack"),
        F.array(*[F.bit_or(F.get("sig", F.lit(i))) for i in range(SIG_WORDS)]).alias("bits"))
    of_set = labelled.select("set_id", "comp", "chunk")
    at = keys.select("token", "set_id").join(of_set, "set_id")
    apart = at.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("token")
    files = stage(at.join(apart, "token").select("token", "comp", "chunk").distinct().join(leaves, ["comp", "chunk"])
                  .drop("chunk"), "jaccard-files")
    x, y = (files.select(*[F.col(c).alias(f"{c}_{s}") for c in files.columns if c != "token"], "token") for s in "xy")
    # enough overlap for the smallest sizes of both leaves: percent * (n1 + n2) <= (100 + percent) * overlap
    overlap = F.least(F.col("slack_x"), F.col("slack_y")) + _common(F.col("bits_x"), F.col("bits_y"))
    fits = ((100 * F.col("hi_x") >= percent * F.col("lo_y")) & (100 * F.col("hi_y") >= percent * F.col("lo_x"))
            & (percent * (F.col("lo_x") + F.col("lo_y")) <= (100 + percent) * overlap))
    nodes = x.join(y, (x["token"] == y["token"]) & (F.col("comp_x") < F.col("comp_y")) & fits)
    nodes = nodes.select("leaf_x", "leaf_y").distinct()
    members = labelled.join(leaves.select("comp", "chunk", "leaf"), ["comp", "chunk"]).select("leaf", "set_id", "n", "m", "sig")
    members = stage(members, "jaccard-leaves")
    a = members.select(F.col("leaf").alias("leaf_x"), F.col("set_id").alias("a"), F.col("n").alias("na"),
                       F.col("m").alias("ma"), F.col("sig").alias("sa"))
    b = members.select(F.col("leaf").alias("leaf_y"), F.col("set_id").alias("b"), F.col("n").alias("nb"),
                       F.col("m").alias("mb"), F.col("sig").alias("sb"))
    most = F.least(F.col("ma") - _missing(F.col("sa"), F.col("sb")), F.col("mb") - _missing(F.col("sb"), F.col("sa")))
    return (nodes.join(a, "leaf_x").join(b, (nodes["leaf_y"] == b["leaf_y"]) & _sizes_fit(F.col("na"), F.col("nb"), percent)
                                         & (percent * (F.col("na") + F.col("nb")) <= (100 + percent) * most))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", k: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Texts are compared by their sets of ``k``-word shingles (A-Z lower-cased; with fewer words, the
    whole sequence is the one shingle); two are linked when 100 * intersection >= percent * union.
    ``component_id`` is the smallest id reachable by links, the row's own included. Null or empty
    texts and texts without words have an empty set, no link, and their own id. Rows with equal ids
    count as one node; a null id is treated as the smallest of all and returned as null.
    """
    low = -(1 << 63)
    ids = docs.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(low)))
    table = shingle_sets(ids, "_id", k, percent)
    release(docs.sparkSession)
    rows = table.filter("kind = 0").select("id", "set_id", "chk", "n")
    names = (rows.filter("n > 0").groupBy("set_id").agg(F.min("id").alias("first"), F.min("chk").alias("c1"),
                                                        F.max("chk").alias("c2")))
    if names.filter("c1 != c2").limit(1).count():
        raise RuntimeError("two shingle sets share a 63-bit name")
    sets = table.filter("kind = 1").drop("kind", "id", "chk")
    keys = sets.select("set_id", "n", "m", F.explode("keys").alias("token"))
    pivots = (keys.groupBy("token").agg(
        F.max_by(F.struct("set_id", "n"), F.struct("m", "set_id")).alias("p1"),
        F.min_by(F.struct("set_id", "n"), F.struct(F.xxhash64("set_id"), F.col("set_id"))).alias("p2"),
        F.count(F.lit(1)).alias("c")).filter("c > 1").select("token", F.explode(F.array_distinct(F.array("p1", "p2"))).alias("p")))
    near = (keys.join(pivots, "token").filter(F.col("set_id") != F.col("p.set_id"))
            .filter(_sizes_fit(F.col("n"), F.col("p.n"), percent))
            .select(F.least("set_id", "p.set_id").alias("a"), F.greatest("set_id", "p.set_id").alias("b")).distinct())
    links = stage(verify(near, sets, percent), "jaccard-links")
    release(docs.sparkSession)
    comps = connected_components(links)
    more = verify(tree_pairs(keys, sets, comps, percent), sets, percent)
    comps = connected_components(links.unionByName(more))
    roots = names.select("set_id", "first").join(comps, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "first", F.coalesce("component", "set_id").alias("comp"))
    least = roots.groupBy("comp").agg(F.min("first").alias("root"))
    root = roots.join(least, "comp").select(F.col("set_id").alias("_s"), "root")
    own = F.when(F.col("id") == low, None).otherwise(F.col("id"))
    found = F.coalesce("root", "id")
    return rows.join(root, F.col("set_id") == F.col("_s"), "left").select(
        own.alias(id_col), F.col("n").alias("n_shingles"), F.when(found == low, None).otherwise(found).alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's number of shingles and component."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
