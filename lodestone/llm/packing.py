"""Best-fit packing of token sequences by large-item matching.

Sizes are whole numbers up to the capacity, so what decides the packing is how
many pieces have each size: a table of at most `capacity` rows, whatever the
input. The plan is made from it on the driver, for all pieces of a size at
once: pieces above a third of the capacity, of which a bin holds two at most,
are matched greedily with the largest that still fits; smaller ones, from the
largest, go to the least gap that holds them. Bins filled alike are one entry
of the plan. Each piece then finds its place by its rank among those of its
size, which is counted in buckets, so no size gathers in one task.

Nulls are empty texts. Every document ends with END_ID. Documents longer than
the capacity are cut from their end into full pieces; the first may be shorter.
Repeated rows, also of a missing id, are packed each; pieces of a size are equal
in rank, and ties go by their columns. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import free, releasing, saved, small_batches, whole

CAPACITY = 2048
END_ID = 0
#: Rows of a bucket in which ranks are counted.
BUCKET_ROWS = 50_000

_encoders: dict = {}


def encoder(merges: bytes, pattern: str, specials: tuple[tuple[str, int], ...]):
    """The tokenizer of a rank file's contents, one for each process."""
    key = (zlib.crc32(merges), len(merges), pattern, specials)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, merges.splitlines())}
        _encoders[key] = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))
    return _encoders[key]


def default_tokenizer() -> tuple[str, str, tuple[tuple[str, int], ...]]:
    """The 50k byte-level vocabulary: its rank file gives the ids of its JSON file several times as fast."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN, (("<|endoftext|>", 50256),)


def cut(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    count = -(-tokens // capacity)
    first = tokens - (count - 1) * capacity
    return [(0, first)] + [(first + i * capacity, capacity) for i in range(count - 1)]


def _tokenized(shared, capacity: int, keep: bool):
    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*shared.value).encode_to_numpy
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py(), allowed_special="all"), np.uint32(END_ID)).astype("<u4")
                for i, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = [key, i, start, length, zlib.crc32(part.tobytes())] + [part] * keep
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.uint32())] * keep
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            if keep:
                arrays[-1] = arrays[-1].cast(pa.list_(pa.int64())).cast(pa.list_(pa.int32()))
            yield pa.record_batch(arrays, names)

    return run


def tokenize(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer=None, ids: bool = False) -> DataFrame:  # noqa: A002
    """A row per piece: key, piece, start, length, ids_crc32, and the ids if asked for."""
    small_batches(docs.sparkSession)
    schema = "key bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    made = docs.select(F.col(id).cast("bigint"), whole(text))
    path, *rest = tokenizer or default_tokenizer()
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), *rest))
    return made.mapInArrow(releasing(_tokenized(shared, capacity, ids)), schema)


class _Bins:
    """Bins by what they hold: (sizes) to how many, and by gap."""

    def __init__(self, capacity: int):
        self.capacity, self.by_gap = capacity, {}

    def put(self, held: tuple[int, ...], count: int) -> None:
        if count:
            self.by_gap.setdefault(self.capacity - sum(held), Counter())[held] += count


def plan(sizes: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Contents of bins and how many are filled so, for sizes {size: count}."""
    left = Counter({s: n for s, n in sizes.items() if n})
    bins = _Bins(capacity)
    third = capacity / 3
    for big in sorted((s for s in left if s > third), reverse=True):
        while left[big]:
            mate = next((s for s in range(min(big, capacity - big), int(third), -1) if s > third and left[s] and (s != big or left[s] > 1)), None)
            if mate is None:
                bins.put((big,), left.pop(big))
                break
            pairs = left[big] // 2 if mate == big else min(left[big], left[mate])
            left[big] -= pairs
            left[mate] -= pairs
            bins.put((big, mate), pairs)
    for small in sorted((s for s in left if s <= third and left[s]), reverse=True):
        n = left[small]
        while n:
            gap = next((g for g in range(small, capacity) if bins.by_gap.get(g)), None)
            if gap is None:
                each = capacity // small
                bins.put((small,) * each, n // each)
                bins.put((small,) * (n % each), int(n % each > 0))
                break
            each, found = gap // small, bins.by_gap[gap]
            held, count = next(iter(found.items()))
            full = min(count, n // each)
            rest = n - full * each if full < count else 0
            used = full + (rest > 0)
            found[held] -= used
            if not found[held]:
                del found[held]
            bins.put(held + (small,) * each, full)
            if rest:
                bins.put(held + (small,) * rest, 1)
            n -= full * each + rest
    return [(held, count) for found in bins.by_gap.values() for held, count in found.items()]


def _places(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, last rank, sequence of the first, sequences between ranks x width, offset).

    The w equal pieces that follow each other in a kind of bin take w * count ranks.
    """
    taken: Counter = Counter()
    rows, sequence = [], 0
    for held, count in made:
        offset, i = 0, 0
        while i < len(held):
            size, width = held[i], 1
            while i + width < len(held) and held[i + width] == size:
                width += 1
            first = taken[size]
            taken[size] += width * count
            rows.append((size, first, taken[size] - 1, sequence, width, offset))
            offset += size * width
            i += width
        sequence += count
    return rows


def pack(pieces: DataFrame, key: str = "key", length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; columns of these names are an error.

    The plan is broadcast: its rows are bounded by the capacity, not by the input.
    """
    spark = pieces.sparkSession
    free(pieces, "sequence_id", "offset")
    counts = pieces.groupBy(F.col(length).alias("__size")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r[0]: r[1] for r in counts.collect()}
    rows = _places(plan(sizes, capacity))
    total = sum(sizes.values())
    buckets = max(1, min(1 << 16, total // BUCKET_ROWS))
    others = [c for c in pieces.columns if c != length]
    work = pieces.withColumn("__b", F.pmod(F.xxhash64(*others), F.lit(buckets)))
    per = work.groupBy(F.col(length).alias("__s"), F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("__s").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("__s", "__c", F.coalesce(before, F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(length, "__b").orderBy(*others))
    ranked = work.withColumn("__i", inner).join(per, (F.col(length) == F.col("__s")) & (F.col("__b") == F.col("__c")))
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__i") - 1)
    schema = "__size bigint, __first bigint, __last bigint, __seq bigint, __width int, __at bigint"
    places = spark.createDataFrame([tuple(int(x) for x in r) for r in rows], schema)
    on = (F.col(length) == F.col("__size")) & F.col("__rank").between(F.col("__first"), F.col("__last"))
    out = ranked.join(F.broadcast(places), on)
    nth = F.col("__rank") - F.col("__first")
    return out.select(
        *pieces.columns, (F.col("__seq") + F.floor(nth / F.col("__width"))).cast("bigint").alias("sequence_id"),
        (F.col("__at") + F.col(length) * (nth % F.col("__width"))).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer=None, ids: bool = False) -> DataFrame:  # noqa: A002
    """A row per piece of the documents with its place in a sequence of at most capacity tokens."""
    pieces = saved(tokenize(docs, id, text, capacity, tokenizer, ids))
    return pack(pieces, capacity=capacity).withColumnRenamed("key", id)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
