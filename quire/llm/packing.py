"""Best-fit packing (operator 10).

Best-fit decreasing over pieces of documents. A piece's length is one of at most ``capacity``
values, so all documents of one length are placed together: a segment tree over the remaining
capacities finds the tightest open sequences that still take the length, and a whole run of such
sequences is filled at once. Its placements (a table whose size depends on the capacity alone) say
for the r-th piece of a length which sequence and offset it gets; ranks come from distributed
prefix sums. The result is that of best-fit decreasing on the single documents, each placed in
logarithmic time, without gathering them anywhere.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import arrow_schema, random_key, running_sum, stage
from quire.llm.tokens import encoder, text_batches

CAPACITY = 4096
END_ID = 1


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: marks which have open sequences and
    finds the smallest marked capacity that is at least a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def mark(self, capacity: int, open_: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = open_
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        i = length + self.leaves
        if self.any[i]:
            return length
        while i > 1:  # up to the first ancestor with a marked right sibling, then down its left edge
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first_rank, per_sequence, first_sequence, offset), ordered by length and
    first_rank: the pieces of ``length`` with ranks from ``first_rank`` on fill sequences from
    ``first_sequence`` on, ``per_sequence`` in each, the first at ``offset``.

    Runs of sequences with the same remaining capacity are kept as (first, count). A run that takes
    a length is left with less than half its capacity or is split, so the number of placements is
    bounded by about 3 * capacity * log2(capacity), whatever the number of documents.
    """
    tree = CapacityTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(left: int, first: int, count: int) -> None:
        if count:
            runs[left].append((first, count))
            if len(runs[left]) == 1:
                tree.mark(left, True)

    placed, n_seq = [], 0
    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            left = tree.tightest(length)
            if left is None:
                left = capacity
                first, count = n_seq, -(-todo // (capacity // length))
                n_seq += count
            else:
                first, count = runs[left].pop()
                if not runs[left]:
                    tree.mark(left, False)
            per = left // length
            full = min(count, todo // per)
            extra = todo - full * per if full < count else 0
            placed.append((length, rank, per, first, capacity - left))
            put(left - per * length, first, full)
            if extra:
                put(left - extra * length, first + full, 1)
            put(left, first + full + bool(extra), count - full - bool(extra))
            rank += full * per + extra
            todo -= full * per + extra
    return sorted(placed)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
           carry: tuple = ("doc_id",)) -> DataFrame:
    """Token pieces of whole texts: the carried columns, piece, start, length, ids_crc32.

    Null and empty texts have the end id alone. Documents of more than ``capacity`` ids are cut
    into pieces of ``capacity``; nothing else is cut."""
    fields = [f for f in docs.select(*carry).schema]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    ddl += ", piece int, start long, length long, ids_crc32 long"
    schema = arrow_schema(ddl)

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        enc = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        width = 4 * capacity
        for b in text_batches(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(enc.encode(b.column("text").to_pylist())):
                ids += end
                for k, a in enumerate(range(0, len(ids), width)):
                    part = ids[a:a + width]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at = pa.array(row, pa.int64())
            cols = [b.column(c).take(at) for c in carry]
            cols += [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.select(*carry, "text").mapInArrow(run, ddl)


def pack(parts: DataFrame, ties: list[str], capacity: int = CAPACITY, seed: str = "pack") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table with ``length`` (1 to ``capacity``).

    ``ties`` identify a row; rows that tie are interchangeable. Every row is placed, every sequence
    is filled from 0 without gaps. An empty table gives an empty table."""
    parts = stage(parts.withColumn("_key", random_key(F.lit(seed), *[F.col(c) for c in ties])), "pack-pieces")
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_decreasing(histogram, capacity)
    ranked = parts.withColumn("_one", F.lit(1))
    ranked = running_sum(ranked, "length", "_key", ties, "_one", "_rank").drop("_one", "_key")
    out = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(out)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(plan, dtype=np.int64).reshape(-1, 5)
        shift = 1 << 48
        begins = table[:, 0] * shift + table[:, 1]
        for b in batches:
            if b.num_rows == 0:
                continue
            length = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy()
            p = table[np.searchsorted(begins, length * shift + rank, side="right") - 1]
            k = rank - p[:, 1]
            seq = p[:, 3] + k // p[:, 2]
            off = p[:, 4] + k % p[:, 2] * length
            cols = [b.column(n) for n in schema.names[:-2]] + [pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return ranked.mapInArrow(place, out)


def pack_documents(docs: DataFrame, tokenizer: str, row_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Documents packed into sequences, one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. ``row_id`` names a column that tells rows with equal doc_id apart."""
    carry = ("doc_id",) if row_id == "doc_id" else ("doc_id", row_id)
    parts = pieces(docs, tokenizer, capacity, carry=carry)
    return (pack(parts, [row_id, "piece"] if row_id != "doc_id" else ["doc_id", "piece", "length", "ids_crc32"], capacity)
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document in pieces of at most 4096 ids, each with its sequence and offset."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
