"""Substring deduplication by super-k-mer partitioning (operator 12).

A window is ``WINDOW`` consecutive words; its minimiser is the smallest hash of the ``GRAM``-word
sequences in it. Consecutive windows that share a minimiser travel as one packed string (their words,
joined by spaces) to the minimiser's bucket: equal windows have equal minimisers, so they meet there,
and a word travels about three times instead of 50. A bucket's windows are sorted by hash and document,
equal neighbours are compared as text, and only ranges of words to remove travel back.

The strings of a task go to each bucket as one compressed block; there Spark sorts them by minimiser.

Frequent strings. Inside a task, equal packed strings are met before anything travels: all but the one
with the smallest document are removed on the spot. Minimisers that many different strings share (the
ends of a passage that a third of all documents hold) would fill one bucket; they are counted first, and
the windows of those above a share of the total go by a 128-bit hash of the whole window instead, of
which Spark takes the smallest document by partial aggregation. A bucket that is still too large for a
task's memory passes its windows on the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WORD, arrow_schema, release, stage

WINDOW = 50
GRAM = 8
MAX_RUN = 512             # windows in one packed string
SLICE_BYTES = 3_000_000   # text that a task handles at a time
SEGMENT_WORDS = 200_000   # longer documents are cut, overlapping by a window
CHUNK_BYTES = 500_000
HOT_STRINGS = 20_000      # a bucket with more strings is split, if it is also above
HOT_SHARE = 20_000        # one part in so many of all strings: at most so many minimisers are hot
BUCKET_WINDOWS = 1_000_000  # windows of a bucket that a task gathers
SHARDS = 256              # tasks among which the holders of one window are dealt
BUCKETS = 3               # buckets for each shuffle partition, as strings travel compressed and are sorted as they are
GROUP_WINDOWS = 50_000   # windows of whole buckets that are sorted together


def _mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words:
    """Words of a buffer of texts in which each word is followed by one space."""

    FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd

    def __init__(self, buffer: bytes):
        import numpy as np

        self.buffer = buffer
        self.raw = np.frombuffer(buffer, dtype=np.uint8)
        self.ends = np.flatnonzero(self.raw == 32)
        self.starts = np.empty_like(self.ends)
        if len(self.ends):
            self.starts[0] = 0
            self.starts[1:] = self.ends[:-1] + 1

    def hashes(self, seed: int = 0):
        """A 64-bit hash of every word: a polynomial in its bytes, mixed."""
        import numpy as np

        if not len(self.ends):
            return np.zeros(0, dtype=np.uint64)
        factor = self.FACTORS[seed]
        inverse = pow(factor, -1, 1 << 64)
        powers, n = [np.uint64(f) * np.ones(len(self.raw), dtype=np.uint64) for f in (factor, inverse)], len(self.raw)
        for p in powers:
            p[0] = 1
        np.multiply.accumulate(powers[0], out=powers[0])
        np.multiply.accumulate(powers[1], out=powers[1])
        terms = powers[0]
        terms *= self.raw.astype(np.uint64) + np.uint64(1)
        terms[self.ends] = 0
        return _mix(np.add.reduceat(terms, self.starts) * powers[1][self.starts])


def _rolling(h, length: int, factor: int):
    """A mixed polynomial of every ``length`` consecutive hashes."""
    import numpy as np

    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, f = np.zeros(n, dtype=np.uint64), 1
    for k in range(length):
        total += h[k:k + n] * np.uint64(f)
        f = f * factor % (1 << 64)
    return _mix(total)


def _sliding_min(g, width: int):
    """Minimum of every ``width`` consecutive values, by doubling."""
    import numpy as np

    reach = 1
    while reach * 2 <= width:
        g = np.minimum(g[:len(g) - reach], g[reach:])
        reach *= 2
    if reach < width:
        g = np.minimum(g[:len(g) - (width - reach)], g[width - reach:])
    return g


def _normal(text: bytes) -> bytes:
    """The text's words joined by one space."""
    import re

    table = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))
    return re.sub(rb"  +", b" ", text.translate(table)).strip(b" ")


def _segments(batch, window: int):
    """(row of the batch, number of the first word, words joined by spaces) of texts of a window or
    more; long ones are cut so that every window is in just one segment."""
    import numpy as np

    for row, text in enumerate(batch.column("text")):
        text = text.as_buffer()
        if text is None or text.size < 2 * window - 1:
            continue
        words = _normal(text.to_pybytes())
        if words.count(b" ") < window - 1:
            continue
        if len(words) <= CHUNK_BYTES:
            yield row, 0, words
            continue
        ends = np.append(np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 32), len(words))
        for a in range(0, len(ends) - window + 1, SEGMENT_WORDS):
            z = min(len(ends), a + SEGMENT_WORDS + window - 1)
            yield row, a, words[ends[a - 1] + 1 if a else 0:ends[z - 1]]


def _chunks(batch, window: int):
    """Segments in groups of about CHUNK_BYTES: (rows, first words, _Words, first word of each in it)."""
    import numpy as np

    group, size = [], 0

    def closed():
        words = _Words(b" ".join(s[2] for s in group) + b" ")
        counts = [s[2].count(b" ") + 1 for s in group]
        return (np.array([s[0] for s in group]), np.array([s[1] for s in group]), words, np.cumsum([0, *counts]))

    for s in _segments(batch, window):
        if group and size + len(s[2]) > CHUNK_BYTES:
            yield closed()
            group, size = [], 0
        group.append(s)
        size += len(s[2])
    if group:
        yield closed()


def _super_kmers(words: _Words, bounds, window: int, gram: int):
    """(segment, first word, windows, minimiser) of every run of windows with one minimiser."""
    import numpy as np

    minimisers = _sliding_min(_rolling(words.hashes(), gram, 0xA0761D6478BD642F), window - gram + 1)
    segment = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(minimisers)]
    valid = np.arange(len(minimisers)) + window <= bounds[1:][segment]
    at = np.flatnonzero(valid)
    if not len(at):
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    m, s = minimisers[at], segment[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1])
    first = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(since % MAX_RUN == 0)  # long runs are cut
    return s[first], at[first], np.diff(np.append(first, len(at))), m[first]


def _runs(words: _Words, bounds, window: int, gram: int):
    """Super-k-mers with their packed strings as (start byte, end byte) in the buffer."""
    segment, at, n, m = _super_kmers(words, bounds, window, gram)
    return segment, at, n, m, words.starts[at], words.ends[at + n + window - 2] if len(at) else at


ROW = "key long, doc long, name long, start long, n int, packed binary"


def _record(kinds, columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types)], names=kinds.names)


BLOCK = "bucket int, rows binary"


def _deflate(rows: list[tuple], parts: int):
    """(bucket numbers, compressed blocks) of rows ROW dealt to ``parts`` buckets by key."""
    import numpy as np
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    key, doc, name, start, n, packed = zip(*rows)
    numbers = [np.array(x, dtype=np.int64) for x in (key, doc, name, start, n)]
    length = np.array([-1 if x is None else len(x) for x in packed], dtype=np.int64)
    bucket = numbers[0] % parts
    order = np.argsort(bucket, kind="stable")
    found, cuts = np.unique(bucket[order], return_index=True)
    blocks = []
    for part in np.split(order, cuts[1:]):
        head = np.concatenate([[len(part)], *[x[part] for x in (*numbers, length)]])
        blocks.append(press.compress(head.tobytes() + b"".join(packed[i] or b"" for i in part.tolist())))
    return found, blocks


def _inflate(kinds):
    """Task function: rows ROW of the blocks of a bucket."""
    def apply(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        for b in batches:
            for block in b.column("rows"):
                raw = zstandard.ZstdDecompressor().decompress(block.as_buffer())
                count = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
                key, doc, name, start, n, length = np.frombuffer(raw, dtype=np.int64, offset=8, count=6 * count).reshape(6, count)
                null = length < 0
                ends = np.cumsum(np.where(null, 0, length))
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32))
                valid = pa.array(~null).buffers()[1]
                packed = pa.Array.from_buffers(pa.binary(), count, [valid, offsets, pa.py_buffer(raw[8 + 48 * count:])])
                whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((key, doc, name, start, n), kinds.types)] + [packed], names=kinds.names)
                for i in range(0, count, 10_000):
                    yield whole.slice(i, 10_000)

    return apply


def _pack(window: int, gram: int, hot: list[int], wanted: bool, parts: int = 0):
    """Task function: rows ROW of the super-k-mers whose minimiser is hot (``wanted``) or not, in
    compressed blocks BLOCK for ``parts`` buckets if that is not 0. Rows without ``packed`` are ranges of
    windows to remove, found inside the task. With ``hot`` None the rows are (key, strings) counts."""
    kinds = None if hot is None else arrow_schema(ROW)

    def apply(batches):
        import numpy as np
        import pyarrow as pa

        from quire.llm.tokens import text_batches

        chosen = np.array(sorted(hot or []), dtype=np.int64)
        for batch in text_batches(batches, SLICE_BYTES):
            docs, names = np.asarray(batch.column("doc")), np.asarray(batch.column("name"))
            best: dict = {}
            gone = []
            for rows, firsts, words, bounds in _chunks(batch, window):
                segment, at, n, m, a, z = _runs(words, bounds, window, gram)
                key = m.view(np.int64)
                if len(chosen):
                    is_hot = np.isin(key, chosen)
                    pick = np.flatnonzero(is_hot if wanted else ~is_hot)
                    segment, at, n, key, a, z = (x[pick] for x in (segment, at, n, key, a, z))
                doc, name = docs[rows[segment]], names[rows[segment]]
                start = firsts[segment] + at - bounds[segment]
                buffer = words.buffer
                for k, d, w, s, c, i, j in zip(key.tolist(), doc.tolist(), name.tolist(), start.tolist(), n.tolist(), a.tolist(), z.tolist()):
                    text = buffer[i:j]
                    was = best.get(text)
                    if was is None:
                        best[text] = (k, d, w, s, c)
                    elif was[1] < d:
                        gone.append((k, d, w, s, c))
                    elif was[1] > d:
                        gone.append(was)
                        best[text] = (k, d, w, s, c)
                    # strings of one document stay for each other: their windows are judged by the first
                    elif (was[2], was[3]) != (w, s):
                        best.setdefault((text, d, w, s), (k, d, w, s, c))
            if hot is None:
                keys, counts = np.unique(np.array([x[0] for x in best.values()], dtype=np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "strings"])
                continue
            rows = [(*x, t if isinstance(t, bytes) else t[0]) for t, x in best.items()] + [(*x, None) for x in gone]
            if parts and rows:
                buckets, blocks = _deflate(rows, parts)
                for i in range(0, len(blocks), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(buckets[i:i + 64], pa.int32()), pa.array(blocks[i:i + 64], pa.binary())],
                                                     names=["bucket", "rows"])
                continue
            for i in range(0, len(rows), 20_000):
                yield _record(kinds, list(zip(*rows[i:i + 20_000])))

    return apply


def _spread(n, total: int):
    """(row, place in the row) of every window of rows with ``n`` windows."""
    import numpy as np

    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(total) - np.repeat(np.cumsum(n) - n, n)


def _windows(packed, n, window: int):
    """(words, index of the row, place in the row, first word in the buffer) of packed strings."""
    import numpy as np

    words = _Words(b" ".join(packed) + b" ")
    row, place = _spread(n, int(n.sum()))
    base = np.cumsum(n + window - 1) - (n + window - 1)
    return words, row, place, base[row] + place


FOUND = "f1 long, f2 long, doc long, name long, start long, n int, pending boolean"


def _found(doc, name, start, n):
    """Rows FOUND of ranges of windows to remove."""
    import numpy as np

    zero = np.zeros(len(doc), dtype=np.int64)
    return [zero, zero, doc, name, start, n, zero.astype(bool)]


def _fingerprints(packed, doc, name, start, n, window: int):
    """Rows FOUND, still open, of every window by a 128-bit hash."""
    import numpy as np

    words, row, place, at = _windows(packed, n, window)
    f1, f2 = (_rolling(words.hashes(seed), window, words.FACTORS[1 - seed])[at].view(np.int64) for seed in (0, 1))
    return [f1, f2, doc[row], name[row], start[row] + place, np.ones(len(row), dtype=np.int32), np.ones(len(row), dtype=bool)]


def _repeats(packed, key, doc, n, window: int):
    """(row, place) of the windows that a row with a smaller document holds too. Sorted by hash and
    document, and compared as text: where the hash is shared by different texts, each text is judged
    by itself."""
    import numpy as np

    words, row, place, at = _windows(packed, n, window)
    f = _rolling(words.hashes(), window, words.FACTORS[1])[at]
    d = doc[row]
    order = np.lexsort((d, f))
    f, d = f[order], d[order]
    new = np.ones(len(f), dtype=bool)
    new[1:] = f[1:] != f[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    hit = np.flatnonzero(d > d[first])
    if not len(hit):
        return row[:0], place[:0]
    starts, ends, buffer = words.starts[at[order]], words.ends[at[order] + window - 1], words.buffer
    a, z, i, j = (x.tolist() for x in (starts[hit], ends[hit], starts[first[hit]], ends[first[hit]]))
    differs = [k for k in range(len(hit)) if buffer[a[k]:z[k]] != buffer[i[k]:j[k]]]
    if differs:
        clash = np.unique(first[hit[differs]])
        hit = hit[~np.isin(first[hit], clash)]
        least: dict[bytes, int] = {}
        members = np.flatnonzero(np.isin(first, clash)).tolist()
        texts = [buffer[starts[k]:ends[k]] for k in members]
        for k, t in zip(members, texts):
            least.setdefault(t, int(d[k]))  # in the order of documents
        hit = np.append(hit, [k for k, t in zip(members, texts) if d[k] > least[t]]).astype(np.int64)
    back = order[hit]
    back.sort()
    return row[back], place[back]


def _count(window: int):
    """Task function over rows ROW sorted by key: rows FOUND."""
    kinds = arrow_schema(FOUND)

    def judged(t):
        """FOUND columns of whole buckets."""
        import numpy as np

        key, doc, name, start, n = (np.asarray(t.column(c)) for c in ("key", "doc", "name", "start", "n"))
        closed = np.asarray(t.column("packed").is_null())
        if closed.any():
            yield _found(doc[closed], name[closed], start[closed], n[closed])
        live = np.flatnonzero(~closed)
        live = live[np.argsort(key[live], kind="stable")]
        if not len(live):
            return
        k = key[live]
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        bucket = np.cumsum(new) - 1
        low, high = (f.reduceat(doc[live], np.flatnonzero(new)) for f in (np.minimum, np.maximum))
        several = live[(low < high)[bucket]]  # buckets of more than one document
        if not len(several):
            return
        ends, a = np.append(np.flatnonzero(np.diff(key[several])) + 1, len(several)), 0
        windows = np.cumsum(n[several], dtype=np.int64)
        while a < len(several):  # whole buckets, together about GROUP_WINDOWS
            done = windows[a - 1] if a else 0
            z = int(ends[min(np.searchsorted(windows[ends - 1], done + GROUP_WINDOWS), len(ends) - 1)])
            part = several[a:z]
            a = z
            packed = t.column("packed").take(part).to_pylist()
            row, place = _repeats(packed, key[part], doc[part], n[part], window)
            if not len(row):
                continue
            fresh = np.ones(len(row), dtype=bool)
            fresh[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
            at = np.flatnonzero(fresh)
            own = part[row[at]]
            yield _found(doc[own], name[own], start[own] + place[at], np.diff(np.append(at, len(row))))

    def opened(t):
        """FOUND columns of a part of a bucket that is too large to gather."""
        import numpy as np

        closed = t.filter(t.column("packed").is_null())
        if closed.num_rows:
            yield _found(*[np.asarray(closed.column(c)) for c in ("doc", "name", "start", "n")])
        t = t.filter(t.column("packed").is_valid())
        for i in range(0, t.num_rows, 2_000):
            part = t.slice(i, 2_000)
            doc, name, start, n = (np.asarray(part.column(c)) for c in ("doc", "name", "start", "n"))
            yield _fingerprints(part.column("packed").to_pylist(), doc, name, start, n, window)

    def apply(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held, large = None, None  # rows of the last bucket so far; the key of a bucket that is being passed on
        for b in batches:
            t = pa.table(b) if not isinstance(b, pa.Table) else b
            if not t.num_rows:
                continue
            if held is not None and held.num_rows:
                t = pa.concat_tables([held, t])
            key = np.asarray(t.column("key"))
            cut = int(np.searchsorted(key, key[-1]))  # sorted by key: the last bucket may go on
            done, held = t.slice(0, cut), t.slice(cut)
            if large is not None and done.num_rows:
                size = int(np.searchsorted(key[:cut], large, side="right"))
                for c in opened(done.slice(0, size)):
                    yield _record(kinds, c)
                done = done.slice(size)
            if done.num_rows:
                for c in judged(done.combine_chunks()):
                    yield _record(kinds, c)
            if large != key[-1]:
                large = int(key[-1]) if pc.sum(held.column("n")).as_py() > BUCKET_WINDOWS else None
            if large is not None:
                for c in opened(held):
                    yield _record(kinds, c)
                held = held.slice(held.num_rows)
        if held is not None and held.num_rows:
            for c in (opened if large is not None else judged)(held.combine_chunks()):
                yield _record(kinds, c)

    return apply


def _open_windows(window: int):
    """Task function over rows ROW of hot minimisers: rows FOUND, open by hash or already closed."""
    kinds = arrow_schema(FOUND)

    def apply(batches):
        import numpy as np

        for b in batches:
            closed = b.filter(b.column("packed").is_null())
            if closed.num_rows:
                yield _record(kinds, _found(*[np.asarray(closed.column(c)) for c in ("doc", "name", "start", "n")]))
            live = b.filter(b.column("packed").is_valid())
            for i in range(0, live.num_rows, 2_000):
                part = live.slice(i, 2_000)
                doc, name, start, n = (np.asarray(part.column(c)) for c in ("doc", "name", "start", "n"))
                yield _record(kinds, _fingerprints(part.column("packed").to_pylist(), doc, name, start, n, window))

    return apply


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    gram: int = GRAM) -> DataFrame:
    """(doc, name, ranges) of every text with words to remove: the words [a, b) of each range are covered
    by windows that a document with a smaller id holds too. ``name`` is a hash that tells texts with the
    same id apart. Rows without an id are left out: they neither lose words nor make others lose any.
    Rows with one id are one document, so they remove nothing from each other."""
    if not 0 < gram <= window:
        raise ValueError("a gram is a part of a window")
    spark = docs.sparkSession
    texts = docs.filter(F.col(id_col).isNotNull() & (F.length(text_col) >= 2 * window - 1)).select(
        F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("name"), F.col(text_col).alias("text"))
    counts = stage(texts.mapInArrow(_pack(window, gram, None, False), "key long, strings long")
                   .groupBy("key").agg(F.sum("strings").alias("strings")), "minimisers")
    total = counts.agg(F.sum("strings")).first()[0] or 0
    # at most HOT_SHARE keys can each have more than that share of the total
    hot = [r[0] for r in counts.filter(F.col("strings") > max(HOT_STRINGS, total // HOT_SHARE)).select("key").collect()]
    parts = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = (texts.mapInArrow(_pack(window, gram, hot, False, parts), BLOCK).repartitionById(parts, F.col("bucket"))
             .mapInArrow(_inflate(arrow_schema(ROW)), ROW).sortWithinPartitions("key").mapInArrow(_count(window), FOUND))
    if hot:
        found = found.unionByName(texts.mapInArrow(_pack(window, gram, hot, True), ROW)
                                  .mapInArrow(_open_windows(window), FOUND))
    found = stage(found, "windows")
    release(spark)
    closed = found.filter("NOT pending").select("doc", "name", "start", "n")
    open_rows = found.filter("pending")
    if not open_rows.isEmpty():
        # a window that a third of all documents hold is dealt to SHARDS tasks and never gathered
        dealt = open_rows.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(SHARDS)).cast("int"))
        least = (dealt.groupBy("f1", "f2", "shard").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
                 .groupBy("f1", "f2").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.collect_set("shard").alias("shards"))
                 .filter("least < most").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.explode("shards").alias("g"), "least"))
        late = dealt.join(least, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("shard") == F.col("g"))).filter("doc > least")
        closed = closed.unionByName(late.select("doc", "name", "start", "n"))
    return (closed.distinct().groupBy("doc", "name")
            .agg(F.collect_list(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + (window - 1)).alias("b"))).alias("ranges")))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (),
                     window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """Id, carried columns, ``n_words``, ``n_removed`` and ``kept`` (the remaining words joined by one
    space; with ``digest`` their sha256 as ``kept_sha256``) of every row of ``docs``.

    Words are runs of anything but space and U+0009..U+000D. A null or empty text has no words. Rows
    without an id keep all words. Repeated rows come back as often as they are there. The names of the
    result must not be carried."""
    if {"n_words", "n_removed", "kept", "kept_sha256", "_text", "_ranges"} & {id_col, *carry}:
        raise ValueError("a carried column has a name of the result")
    marks = repeated_ranges(docs, id_col, text_col, window, gram).withColumnsRenamed(
        {"doc": "_doc", "name": "_name", "ranges": "_ranges"})
    own = (F.col(id_col) == F.col("_doc")) & (F.xxhash64("_text") == F.col("_name"))
    rows = (docs.select(id_col, *carry, F.col(text_col).alias("_text")).join(marks.hint("merge"), own, "left")
            .select(id_col, *carry, "_text", "_ranges"))
    named = [id_col, *carry]

    def apply(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            counts, removed, kept = [], [], []
            for text, ranges in zip(b.column("_text"), b.column("_ranges")):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                counts.append(len(words))
                if ranges.is_valid:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, np.asarray(ranges.values.field("a")), 1)
                    np.add.at(edge, np.asarray(ranges.values.field("b")), -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    removed.append(len(words) - int(stay.sum()))
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                else:
                    removed.append(0)
                left = b" ".join(words)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in named], pa.array(counts, pa.int64()),
                                              pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=[*named, "n_words", "n_removed", "kept_sha256" if digest else "kept"])

    schema = docs.select(*named).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256" if digest else "kept", "string")
    return rows.mapInArrow(apply, schema)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: word counts and the sha256 of the remaining words of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, digest=True)


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
p AS (SELECT doc_id, r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW}),
k AS (SELECT doc_id, r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS t FROM p),
f AS (SELECT r, i FROM k QUALIFY min(doc_id) OVER (PARTITION BY t) < doc_id),
c AS (SELECT DISTINCT r, i + o AS i FROM f, (SELECT unnest(range({WINDOW})) AS o)),
w AS (SELECT doc_id, r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT w.r, count(*) AS n_words, count(c.i) AS n_removed,
             string_agg(w.w, ' ' ORDER BY w.i) FILTER (WHERE c.i IS NULL) AS kept
      FROM w LEFT JOIN c ON c.r = w.r AND c.i = w.i GROUP BY w.r)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.r = d.r
"""
