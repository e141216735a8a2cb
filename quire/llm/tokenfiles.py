"""Token-id files (operators 6 and 8).

Operator 6 writes the ids of all documents, in ascending doc_id order, as patched
frame-of-reference blocks: 256 ids a block, the block's minimum subtracted, the rest packed at a
percentile-chosen width, what does not fit kept in an exception list, block starts in an index.
Operator 8 scans flat, unindexed files of plain ids for end-of-document identifiers.

Files are written by the tasks to the shared folder through Arrow's file systems (local, HDFS,
object stores). A file's name holds a random part, and only the files that finished tasks report
are read, so a task that is run again leaves an unread file at worst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import arrow_schema, shared_path, stage
from quire.llm.tokens import encoder, text_batches

BLOCK = 256          # ids a block
LANES = 8            # a block is packed as 8 lanes of 32 values, each into whole 32-bit words
PERCENTILE = 90      # of a block's values that must fit its width
FILE_IDS = 4_000_000  # a file is closed when it holds so many ids
MAGIC = b"PFOR0001"


def pack_blocks(ids):
    """(bytes, block starts, widths) of ids as patched frame-of-reference blocks.

    A block: minimum u32, width u8, zero u8, exceptions u16, values u32[width * 8], exception
    positions u16[n] (padded to 4 bytes), exception values u32[n]. The last block is filled up with
    its own minimum; the number of ids is kept outside.
    """
    import numpy as np

    n = len(ids)
    count = -(-n // BLOCK)
    x = np.zeros(count * BLOCK, dtype=np.uint32)
    x[:n] = ids
    x[n:] = ids[(count - 1) * BLOCK:].min() if n else 0
    x = x.reshape(count, BLOCK)
    low = x.min(axis=1)
    x = x - low[:, None]
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    fits = np.partition(x, rank, axis=1)[:, rank] if count else np.zeros(0, np.uint32)
    width = np.ceil(np.log2(fits.astype(np.float64) + 1)).astype(np.int64)
    high = np.zeros(x.shape, dtype=bool)
    for w in np.unique(width[width < 32]).tolist():
        rows = np.flatnonzero(width == w)
        high[rows] = (x[rows] >> np.uint32(w)) > 0
    n_high = high.sum(axis=1)
    # every part of a block is made of whole 32-bit words
    begin = np.concatenate([[0], np.cumsum(2 + width * LANES + (n_high + 1) // 2 + n_high)]).astype(np.int64)
    out = np.zeros(begin[-1], dtype="<u4")
    out[begin[:-1]] = low
    out[begin[:-1] + 1] = width | n_high << 16
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        body = np.where(high[rows], np.uint32(0), x[rows]).reshape(len(rows), BLOCK // LANES, LANES)
        words = np.zeros((len(rows), w, LANES), dtype=np.uint32)
        for step in range(BLOCK // LANES):
            at, shift = divmod(step * w, 32)
            words[:, at] |= body[:, step] << np.uint32(shift)
            if shift + w > 32:
                words[:, at + 1] |= body[:, step] >> np.uint32(32 - shift)
        out[begin[rows][:, None] + 2 + np.arange(w * LANES)] = words.reshape(len(rows), -1)
    block, place = np.nonzero(high)
    k = np.arange(len(block)) - (np.cumsum(n_high) - n_high)[block]
    at = begin[block] + 2 + width[block] * LANES
    out.view("<u2")[2 * at + k] = place
    out[at + (n_high[block] + 1) // 2 + k] = x[block, place]
    return out.tobytes(), (4 * begin).astype("<u8"), width


def unpack_blocks(data, starts, n: int, first: int = 0, last: int | None = None):
    """Ids of the blocks ``first`` to ``last`` (all of them by default) of a packed body."""
    import numpy as np

    raw = np.frombuffer(data, dtype=np.uint8)
    count = -(-n // BLOCK)
    last = count if last is None else last
    begin = starts[first:last].astype(np.int64)
    x = np.zeros((len(begin), BLOCK), dtype=np.uint32)
    if not len(begin):
        return x.reshape(-1)
    head = raw[begin[:, None] + np.arange(8)]
    low = head[:, :4].copy().view("<u4").reshape(-1)
    width = head[:, 4].astype(np.int64)
    n_high = head[:, 6:].copy().view("<u2").reshape(-1).astype(np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if not w:
            continue
        words = raw[begin[rows][:, None] + 8 + np.arange(4 * w * LANES)].view("<u4").reshape(len(rows), w, LANES)
        mask = np.uint32((1 << w) - 1)
        body = np.empty((len(rows), BLOCK // LANES, LANES), dtype=np.uint32)
        for step in range(BLOCK // LANES):
            at, shift = divmod(step * w, 32)
            v = words[:, at] >> np.uint32(shift)
            if shift + w > 32:
                v = v | (words[:, at + 1] << np.uint32(32 - shift))
            body[:, step] = v & mask
        x[rows] = body.reshape(len(rows), BLOCK)
    for r in np.flatnonzero(n_high).tolist():
        a = int(begin[r] + 8 + 4 * width[r] * LANES)
        k = int(n_high[r])
        values = a + 2 * k + (-2 * k) % 4
        x[r, np.frombuffer(data, "<u2", k, a)] = np.frombuffer(data, "<u4", k, values)
    x += low[:, None]
    return x.reshape(-1)[:max(0, min(n - first * BLOCK, (last - first) * BLOCK))]


def file_bytes(doc_ids, lengths, ids) -> bytes:
    """A file: magic, documents u64, ids u64, blocks u64, doc_id i64[], length u64[], block starts
    u64[blocks + 1], blocks."""
    import struct

    import numpy as np

    body, starts, _ = pack_blocks(ids)
    return b"".join([MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(starts) - 1),
                     np.asarray(doc_ids, "<i8").tobytes(), np.asarray(lengths, "<u8").tobytes(),
                     starts.tobytes(), body])


def read_file(data: bytes):
    """(doc_ids, lengths, ids) of a file's bytes."""
    import struct

    import numpy as np

    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, blocks = struct.unpack_from("<QQQ", data, 8)
    at = 32
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
    starts = np.frombuffer(data, "<u8", blocks + 1, at + 16 * docs)
    return doc_ids, lengths, unpack_blocks(data[at + 16 * docs + 8 * (blocks + 1):], starts, n)


def by_doc_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text) range-partitioned and sorted by doc_id, nulls first, ties by text. The range
    is over (doc_id, hash of the text), so a repeated id is split as well."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    return (rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").drop("_h"))


def file_system(path: str):
    """(Arrow file system, name in it) of a path as Spark writes it: with a scheme, Spark's names of the
    S3 client included, or with ``file:`` and any number of slashes, or plain."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if colon and scheme in ("s3a", "s3n"):
        path, scheme = f"s3:{rest}", "s3"
    if colon and scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_files(docs: DataFrame, tokenizer: str, end_id: int, flat_type: str = "", literal_specials: bool = False) -> DataFrame:
    """Write the ids of every whole text (null: empty), each followed by ``end_id``, in the order of
    the rows, to packed files, or to flat files of ids of ``flat_type`` ("<u2" or "<u4"). Returns one
    row per document: doc_id, part and number of its file (files sort by these in document order), its
    ordinal in the file, the file's path and length in ids. A null doc_id is written as the smallest
    long. An id that ``flat_type`` cannot hold is an error."""
    folder = shared_path(docs.sparkSession, "token-files")
    ddl = "doc_id long, part int, number int, ordinal long, path string, file_ids long"
    schema = arrow_schema(ddl)

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(tokenizer, literal_specials)
        end = np.array([end_id], dtype="<u4").tobytes()
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list[bytes] = []
        n_ids = 0

        def close():
            nonlocal number, n_ids
            lengths = [len(h) // 4 for h in held]
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            keys = [-(1 << 63) if d is None else d for d in doc_ids]
            path = f"{folder}/part-{part:06d}-{number:05d}-{uuid.uuid4().hex}"
            where, name = file_system(path)
            where.create_dir(name.rpartition("/")[0], recursive=True)
            if flat_type and len(ids) and int(ids.max()) > np.iinfo(flat_type).max:
                raise ValueError(f"an id does not fit {flat_type}")
            with where.open_output_stream(name) as f:
                f.write(ids.astype(flat_type).tobytes() if flat_type else file_bytes(keys, lengths, ids))
            m = len(doc_ids)
            out = pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array([part] * m, pa.int32()), pa.array([number] * m, pa.int32()),
                 pa.array(range(m), pa.int64()), pa.array([path] * m), pa.array([n_ids] * m, pa.int64())], schema=schema)
            number, n_ids = number + 1, 0
            doc_ids.clear()
            held.clear()
            return out

        for b in text_batches(batches):
            for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                doc_ids.append(d)
                held.append(ids + end)
                n_ids += len(ids) // 4 + 1
                if n_ids >= FILE_IDS:
                    yield close()
        if doc_ids:
            yield close()

    return stage(docs.select("doc_id", "text").mapInArrow(run, ddl), "token-manifest")


def files_of(manifest: DataFrame) -> DataFrame:
    """One row per file, with the number of ids in all files before it."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return (manifest.filter("ordinal = 0").select("part", "number", "path", "file_ids")
            .withColumn("before", F.coalesce(F.sum("file_ids").over(before), F.lit(0))))


def file_tasks(spark: SparkSession) -> int:
    """Number of tasks that files are dealt to. It is given to ``repartition``: without a number adaptive
    execution would see a few bytes of paths and read all files in one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def read_documents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, doc_id, start, n_tokens, ids_crc32) of every document, decoded from packed files of
    ``files`` (path, before); ``start`` counts from ``before`` at the start of its file."""
    ddl = "path string, doc_id long, start long, n_tokens long, ids_crc32 long"
    schema = arrow_schema(ddl)

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for path, before in zip(b.column("path").to_pylist(), b.column("before").to_pylist()):
                where, name = file_system(path)
                with where.open_input_file(name) as f:
                    doc_ids, lengths, ids = read_file(f.read())
                stops = np.cumsum(lengths)
                starts = stops - lengths
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(lengths)), pa.array(doc_ids, pa.int64(), mask=doc_ids == -(1 << 63)),
                     pa.array(starts + before), pa.array(lengths), pa.array(crc, pa.int64())], schema=schema)

    return files.select("path", "before").repartition(file_tasks(spark), "path").mapInArrow(run, ddl)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: encode all documents, write the packed files, and return each document's
    start, length and checksum as read back from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_files(by_doc_id(docs), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_documents(spark, files_of(manifest)).select("doc_id", "start", "n_tokens", "ids_crc32")


SCAN_BLOCK = 1_000_000  # ids that one step of the separator scan reads


def scan_flat_files(files: DataFrame, end_id: int, width: int = 4, block: int = SCAN_BLOCK) -> DataFrame:
    """Documents of flat, unindexed token files: (path, ordinal, start, n_tokens), ``start`` in ids
    from the start of the file, the separator not counted in ``n_tokens``.

    ``files`` has path and file_ids. Each file is read in blocks by different tasks; a block is
    searched for ``end_id`` at once, and what a block cannot know, how many separators come before
    it and where the last of them is, comes from a prefix scan over the blocks' summaries. Ids after
    the last separator make no document.
    """
    blocks = (files.select("path", "file_ids", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("file_ids") / block) - 1).cast("long"))).alias("block"))
        .repartition(file_tasks(files.sparkSession), "path", "block"))
    ddl = "path string, block long, n long, first long, last long, ends array<long>"
    schema = arrow_schema(ddl)
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for path, k in zip(b.column("path").to_pylist(), b.column("block").to_pylist()):
                where, name = file_system(path)
                with where.open_input_file(name) as f:
                    f.seek(k * block * width)
                    ids = np.frombuffer(f.read(block * width), dtype=kind)
                ends = np.flatnonzero(ids == end_id) + k * block
                has = len(ends) > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([k], pa.int64()), pa.array([len(ends)], pa.int64()),
                     pa.array([int(ends[0]) if has else None], pa.int64()),
                     pa.array([int(ends[-1]) if has else None], pa.int64()),
                     pa.array([ends], pa.list_(pa.int64()))], schema=schema)

    found = blocks.mapInArrow(run, ddl)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (found.withColumn("_n", F.coalesce(F.sum("n").over(before), F.lit(0)))
                .withColumn("_last", F.coalesce(F.max("last").over(before), F.lit(-1))))
    each = stitched.select("path", "_n", "_last", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(F.col("_last")) + 1
    return each.select("path", (F.col("_n") + F.col("i")).alias("ordinal"), start.alias("start"),
                       (F.col("end") - start).alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents, as they come, to flat files of plain 16-bit ids, each ended by id 49407,
    and count every document's tokens by scanning the files for that id: doc_id, n_tokens (without
    the separator). The scan itself sees ids alone; the ordinals it finds are matched with the order
    in which the documents were written. A null or empty text has no tokens; rows that share an id, or have
    none, come back one by one."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=49407, flat_type="<u2",
                           literal_specials=True)
    scanned = scan_flat_files(files_of(manifest), 49407, width=2)
    # both sides grow with the documents: Spark's estimate of what Python emits must not turn one into a broadcast
    return (scanned.hint("merge").join(manifest.select("path", "ordinal", "doc_id"), ["path", "ordinal"]).select("doc_id", "n_tokens"))
