"""SimHash near-duplicates, candidates by pigeonring filtering.

A fingerprint is the majority vote of the 64-bit hashes of a text's word
shingles. Two fingerprints within tau bits, cut in m segments on a ring, have a
segment from which every run of l segments differs in at most l * tau / m bits.
So candidates meet in a bucket of one segment that agrees and a next one that
differs in one bit at most; longer runs are tested before the full check.

Nulls count as empty texts and empty texts have fingerprint zero. Equal
fingerprints are one node whatever their number. Rows with a missing id get a
class too but don't name it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import releasing, saved, small_batches, whole
from lodestone.llm.graph import components

SEED = 42
BITS = 64
#: Hashes counted at a time: bounds the memory that a very long text takes.
_PART = 1 << 14
#: For each byte its bits as the eight bytes of a word, and how many such words fit into one sum.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
_FIT = 255


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits."""
    words = _SPREAD[hashes.view(np.uint8)].reshape(-1, 8)
    sums = np.add.reduceat(words, np.arange(0, len(words), _FIT), axis=0)
    return sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of ASCII-lower-cased words, in parts of bounded length; none for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    n = max(len(words) - shingle + 1, 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _PART):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + _PART], stops[i : i + _PART], strict=True)], "<u8")


def fingerprint(text: str, shingle: int) -> int:
    """Majority bits over the shingle hashes, as an unsigned 64-bit int."""
    votes, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, shingle):
        votes += _votes(h)
        n += len(h)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    @F.arrow_udf("bigint")
    def f(texts: pa.Array) -> pa.Array:
        made = np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64)
        return pa.array(made.view(np.int64))

    return f


def segments(tau: int) -> list[tuple[int, int]]:
    """(first bit, width) of the tau + 1 segments of the ring."""
    m = tau + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _budgets(tau: int) -> list[int]:
    m = tau + 1
    return [(k + 1) * tau // m for k in range(m)]


def _keys(tau: int):
    """mapInArrow: each fingerprint under its bucket keys.

    A pair whose second segments differ in one bit differ in parity there, so
    only odd ones are also filed under the neighbours of their second segment.
    """
    ring = segments(tau)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), 20_000):
                fps = all_fps[at : at + 20_000]
                keys, owners = [], []
                for i, (shift, width) in enumerate(ring):
                    to, next_width = ring[(i + 1) % len(ring)]
                    first = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    second = (fps >> np.uint64(to)) & np.uint64((1 << next_width) - 1)
                    head = (np.uint64(i) << np.uint64(48)) | (first << np.uint64(next_width))
                    keys.append(head | second)
                    owners.append(fps)
                    odd = np.bitwise_count(second) & 1 == 1
                    flips = second[odd][:, None] ^ (np.uint64(1) << np.arange(next_width, dtype=np.uint64))
                    keys.append((head[odd][:, None] | flips).ravel())
                    owners.append(np.repeat(fps[odd], next_width))
                yield pa.record_batch([
                    pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners).view(np.int64)),
                    pa.array(np.repeat(np.arange(len(ring), dtype=np.int32).repeat(2), [len(k) for k in keys])),
                ], ["key", "fp", "ring"])

    return run


def _near(one: np.uint64, others: np.ndarray, start: int, tau: int) -> np.ndarray:
    """Which of others lie within tau bits of one: first the runs from start, then the full check."""
    ring, budgets = segments(tau), _budgets(tau)
    diff = others ^ one
    left = np.arange(len(others))
    mask = 0
    for k in range(len(ring) - 1):
        shift, width = ring[(start + k) % len(ring)]
        mask |= ((1 << width) - 1) << shift
        if k:
            left = left[np.bitwise_count(diff[left] & np.uint64(mask)) <= budgets[k]]
    return left[np.bitwise_count(diff[left]) <= tau]


def _span(fps: np.ndarray, start: int, tau: int) -> list[tuple[int, int]]:
    """A spanning forest of a bucket's links: each step compares one node with those not reached yet."""
    rest, edges, queue = fps, [], []
    while len(rest):
        if queue:
            node = queue.pop()
        else:
            node, rest = rest[0], rest[1:]
        found = _near(node, rest, start, tau)
        if len(found):
            edges += [(int(node), int(x)) for x in rest[found]]
            queue += list(rest[found])
            rest = np.delete(rest, found)
    return edges


def _linked(tau: int):
    """mapInArrow over rows sorted by bucket: the links of each bucket, as a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: tuple[np.ndarray, ...] | None = None

        def flush(key: np.ndarray, fp: np.ndarray, ring: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.array([], int)
            sizes = np.diff(np.append(starts, len(key)))
            pairs = starts[sizes == 2]
            x, y = fp[pairs], fp[pairs + 1]
            near = np.bitwise_count(x ^ y) <= tau
            edges = [*zip(x[near].tolist(), y[near].tolist(), strict=True)]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                edges += _span(np.unique(fp[s : s + n]), int(ring[s]), tau)
            a = np.array([e[0] for e in edges], np.uint64).view(np.int64)
            b = np.array([e[1] for e in edges], np.uint64).view(np.int64)
            return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
            if carry is not None:
                now = [np.concatenate([p, q]) for p, q in zip(carry, now, strict=True)]
            last = now[0] == now[0][-1] if len(now[0]) else np.array([], bool)
            carry = tuple(x[last] for x in now)
            yield flush(*(x[~last] for x in now))
        if carry is not None:
            yield flush(*carry)

    return run


def linked_fingerprints(fps: DataFrame, tau: int) -> DataFrame:
    """Links (a, b) among the distinct fingerprints fp that connect all pairs within tau bits."""
    keyed = fps.select("fp").mapInArrow(releasing(_keys(tau)), "key bigint, fp bigint, ring int")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(releasing(_linked(tau)), "a bigint, b bigint")


def simhash_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, tau: int = 4) -> DataFrame:  # noqa: A002
    """(id, fp, component_id) for each row: the least id among the rows reachable by links of at most tau bits.

    Empty tables give empty results. Repeated rows, also of one id, are rows of
    their own. Shuffles: one row per text of 16 bytes, then the bucket keys of
    distinct fingerprints, then links between different fingerprints only.
    """
    small_batches(docs.sparkSession)
    rows = saved(docs.select(F.col(id).cast("bigint").alias(id), _fingerprints(shingle)(whole(text)).alias("fp")))
    nodes = saved(rows.groupBy("fp").agg(F.min(id).alias("least")))
    labels = components(linked_fingerprints(nodes, tau)).withColumnRenamed("node", "fp")
    labels = saved(labels)
    classes = labels.join(nodes, "fp").groupBy("label").agg(F.min("least").alias("component_id"))
    linked = labels.join(classes, "label").select("fp", "component_id")
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(named, "fp").select(id, "fp", "component_id")


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and classes of documents: 4-word shingles, at most 4 bits apart."""
    out = simhash_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, tau=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
