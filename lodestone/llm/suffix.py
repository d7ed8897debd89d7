"""Removal of repeated byte strings by hash-compared suffix sorting.

A byte goes if a string of `width` bytes that covers it also starts anywhere
else, in the same text or another. Three steps:

1. Anchors. Each window of width bytes elects its least-hashed k-gram, so equal
   windows elect the same one. Consecutive windows with one anchor are a
   segment. Segments are dealt out by the anchor's hash: an anchor seen once
   has no repeated window; a segment seen twice is repeated throughout. Segments
   are equal if the 128-bit BLAKE2 digests of their bytes are.
2. Edges. What is left are segments whose anchor is repeated but which aren't
   so as a whole. Their texts, with one of each repeated segment of the anchor,
   go to the anchor's bucket. There the suffixes from the anchors are sorted by
   mergesort; two suffixes are compared by binary search for their common
   extension over prefix polynomial hashes. The extensions of neighbours give
   the classes of suffixes equal to any depth; with the hash of what stands to
   the left, windows that occur twice. Both are then verified byte by byte, and
   hashes that collide are replaced.
3. Removal. The runs found go to their texts, which drop them.

Nulls are empty texts; texts shorter than width lose nothing; repeated rows lose
all but what is shorter than width; equal texts are worked on twice at most in
each task, and named by 128 bits of hash. An empty table gives an empty result.
Memory is bounded by a block of windows, a block of contexts, and the longest
text; of an anchor a task holds one row for each different segment, up to
`bucket`. An anchor with more isn't sorted in one task: the digests of its
windows are counted in a distributed aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import release, releasing, saved, small_batches, whole

WIDTH = 200
GRAM = 32
#: Bytes of text, and contexts, handled at a time.
BLOCK_BYTES = 1 << 18
BLOCK_CONTEXTS = 1 << 12
#: Bytes that are hashed at a time: an index and its values take 8 bytes for each.
_STEP = 1 << 16
#: Different segments of one anchor that a task sorts; beyond, windows are counted.
BUCKET = 1 << 13

_U = np.uint64
_LOW = _U((1 << 24) - 1)


def _inverse(x: int) -> int:
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % 2**64
    return y


class Rolling:
    """Prefix polynomial hashes modulo 2**64 with random byte values."""

    def __init__(self, seed: int, size: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(0, 2**64, 256, dtype=_U) | _U(1)
        base = int(rng.integers(0, 2**64, dtype=_U)) | 5
        self.base, self.back = _U(base), _U(_inverse(base))
        self.up = self.down = np.ones(1, _U)
        self.grow(size)

    def grow(self, size: int) -> None:
        if len(self.up) <= size:
            for name, b in (("up", self.base), ("down", self.back)):
                p = np.full(size + 1, b, _U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, data: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        """Running hash of data; place, where given, is each byte's place in its own text."""
        self.grow(len(data) if place is None else int(place.max(initial=0)) + 1)
        out = np.zeros(len(data) + 1, _U)
        for at in range(0, len(data), _STEP):
            end = min(at + _STEP, len(data))
            part = self.table[data[at:end]]
            part *= self.up[at:end] if place is None else self.up[place[at:end]]
            part[:1] += out[at : at + 1]
            np.cumsum(part, out=out[at + 1 : end + 1])
        return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_rollers: dict[int, Rolling] = {}


def _roller(seed: int) -> Rolling:
    if seed not in _rollers:
        if len(_rollers) > 2:
            _rollers.clear()
        _rollers[seed] = Rolling(seed, 1 << 12)
    return _rollers[seed]


# -- step 1: anchors and segments -------------------------------------------------


def digests(parts: list[bytes]) -> np.ndarray:
    """128 bits of BLAKE2 of each, as two columns of ints."""
    return np.frombuffer(b"".join([blake2b(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)


def segments(raw: bytes, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """core, s1, s2, p, lo, hi, last, times of each segment of one text.

    Hash of the anchor, digest of the segment, the anchor's place, first and last
    window. A run of equal segments, as periodic text has them, is one entry with
    its number and its very last window.
    """
    data = np.frombuffer(raw, np.uint8)
    r, out, span = _roller(1), [], width - gram + 1
    last = len(data) - width
    for at in range(0, last + 1, BLOCK_BYTES):
        windows = min(BLOCK_BYTES, last + 1 - at)
        part = data[at : at + windows + width - 1]
        prefix = r.prefix(part)
        n = len(part) - gram + 1
        grams = mix((prefix[gram:] - prefix[:-gram]) * r.down[:n])
        keys = (grams & ~_LOW) | np.arange(n, dtype=_U)
        padded = np.concatenate([keys, np.full(-n % span, ~_U(0))]).reshape(-1, span)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & _LOW).astype(np.int64)
        lo = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        hi = np.append(lo[1:] - 1, windows - 1)
        p = least[lo]
        out.append((grams[p], p + at, lo + at, hi + at))
    core, p, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
    cut = lambda i: raw[lo[i] : hi[i] + width]
    same = np.append(False, (core[1:] == core[:-1]) & (np.diff(hi - lo) == 0))
    for i in np.flatnonzero(same):
        same[i] = cut(i - 1) == cut(i)
    first = np.flatnonzero(~same)
    end = np.append(first[1:], len(core))
    made = digests([cut(i) for i in first.tolist()])
    return core[first], made[:, 0], made[:, 1], p[first], lo[first], hi[first], hi[end - 1], end - first


def _anchored(width: int, gram: int):
    """mapInArrow over (text, tk, th): a row for each segment of each text that this task hasn't met twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], int] = {}
        for batch in batches:
            made, held = [], 0
            for text, tk, th in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py()
                met[tk, th] = met.get((tk, th), 0) + 1
                # A third meeting adds nothing: two rows of a segment already show that it is repeated.
                if len(raw) < width or met[tk, th] > 2:
                    continue
                core, s1, s2, *places = segments(raw, width, gram)
                n = len(core)
                made.append((core, s1, s2, np.full(n, tk), np.full(n, th), *places))
                held += n
                if held > 100_000:
                    yield _segment_rows(made)
                    made, held = [], 0
            if made:
                yield _segment_rows(made)

    return run


_SEGMENTS = "core bigint, s1 bigint, s2 bigint, tk bigint, th bigint, p int, lo int, hi int, last int, times int"


def _segment_rows(made: list) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*made, strict=True)]
    arrays = [pa.array(c.view(np.int64)) for c in columns[:5]] + [pa.array(c.astype(np.int32)) for c in columns[5:]]
    return pa.record_batch(arrays, ["core", "s1", "s2", "tk", "th", "p", "lo", "hi", "last", "times"])


_KINDS = "kind int, core bigint, tk bigint, th bigint, p int, lo int, hi int"


def _sorted_out(bucket: int):
    """mapInArrow over segments sorted by anchor and digest.

    Gives the repeated segments (kind 0) and, for anchors that also have others,
    those (kind 1; 3 in a crowded bucket) with one of each repeated one (2; 4).
    Of the anchor whose rows may go on it keeps a row for each different segment.
    """

    def row_batch(*parts: tuple[int | np.ndarray, list[np.ndarray]]) -> pa.RecordBatch:
        kind = np.concatenate([np.broadcast_to(np.asarray(k, np.int32), len(rows[0])) for k, rows in parts])
        columns = [np.concatenate(x) for x in zip(*(rows for _, rows in parts), strict=True)]
        return pa.record_batch([pa.array(kind), *map(pa.array, columns)], ["kind", "core", "tk", "th", "p", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = None, None
        for batch in chain(batches, [None]):
            if batch is None:
                if held is None:
                    return
                rows = held
            else:
                if not len(batch):
                    continue
                rows = [c.to_numpy() for c in batch.columns] + [np.zeros(len(batch), bool)]
                rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            core, s1, s2, tk, th, p, lo, hi, last, times, sent = rows
            new_core = np.append(True, core[1:] != core[:-1])
            new_seg = new_core | np.append(True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))
            of_core, of_seg = np.cumsum(new_core) - 1, np.cumsum(new_seg) - 1
            total = np.bincount(of_seg, weights=times)[of_seg]
            repeated = total > 1
            closed = np.ones(len(core), bool) if batch is None else of_core != of_core[-1]
            different = np.bincount(of_core, weights=new_seg)[of_core]
            edges = np.bincount(of_core, weights=~repeated)[of_core]
            full = (different > bucket) | (core == crowded if crowded is not None else False)
            pick = lambda at, end: [x[at] for x in (core, tk, th, p, lo)] + [end[at]]
            whole_ = np.flatnonzero(repeated & ~sent)
            edge = np.flatnonzero(closed & ~repeated & ((different > 1) | full))
            stand = np.flatnonzero(closed & repeated & new_seg & ((edges > 0) | full))
            # A repeated run goes whole; of a stand-in one segment is enough.
            yield row_batch((0, pick(whole_, last)), (1 + 2 * full[edge], pick(edge, hi)), (2 + 2 * full[stand], pick(stand, hi)))
            if batch is None:
                return
            keep = np.flatnonzero(~closed & new_seg)
            held = [x[keep] for x in rows]
            held[9], held[10] = np.minimum(total[keep], 2).astype(times.dtype), sent[keep] | repeated[keep]
            if len(keep) > bucket:
                crowded = core[-1]
                at = keep[:-1]  # the last segment may go on
                yield row_batch((np.where(repeated[at], 4, 3), pick(at, hi)))
                held = [x[-1:] for x in held]

    return run


# -- step 2: contexts and the suffix sort --------------------------------------------


_CONTEXTS = [("kind", pa.int32()), ("core", pa.int64()), ("tk", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("q", pa.int32()), ("context", pa.binary())]


def _contexts(width: int):
    """mapInArrow over (text, tk, th, places): the bytes of each listed segment."""

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _CONTEXTS, strict=True)], [n for n, _ in _CONTEXTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[tuple] = []
            for text, tk, th, places in zip(*batch.columns, strict=True):
                tk, th = tk.as_py(), th.as_py()
                if (tk, th) in met:
                    continue
                met.add((tk, th))
                data = text.as_py()
                for x in places.as_py():
                    out.append((x["kind"], x["core"], tk, th, x["lo"], x["p"] - x["lo"], data[x["lo"] : x["hi"] + width]))
                    if len(out) >= 10_000:
                        yield rows(out)
                        out = []
            if out:
                yield rows(out)

    return run


class Suffixes:
    """Texts laid end to end with prefix hashes; suffixes start at `at` and end at `end`."""

    def __init__(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, group: np.ndarray, limit: int, seed: int, place: np.ndarray | None = None):
        self.data, self.at, self.end, self.group, self.limit = data, at, end, group, limit
        self.roller = _roller(seed)
        self.prefix = self.roller.prefix(data, place)
        self.place = None if place is None else np.append(place, place.dtype.type(0))

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the bytes a to b of one text; not yet mixed, so that equal bytes alone decide."""
        return (self.prefix[b] - self.prefix[a]) * self.roller.down[a if self.place is None else self.place[a]]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common extension of suffixes x and y, up to limit: binary search over hashes of prefixes."""
        a, b = self.at[x], self.at[y]
        low = np.zeros(len(x), np.int64)
        high = np.minimum(np.minimum(self.end[x] - a, self.end[y] - b), self.limit)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            i, j, middle = a[open_], b[open_], (low[open_] + high[open_] + 1) // 2
            same = self.hash(i, i + middle) == self.hash(j, j + middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Does suffix x sort before y? By group, then bytes; ties by number."""
        out = self.group[x] < self.group[y]
        tied = np.flatnonzero(self.group[x] == self.group[y])
        if len(tied):
            p, q = x[tied], y[tied]
            n = self.extension(p, q)
            i, j = self.at[p] + n, self.at[q] + n
            done_p, done_q = (i >= self.end[p]) | (n >= self.limit), (j >= self.end[q]) | (n >= self.limit)
            byte = lambda k: self.data[np.minimum(k, len(self.data) - 1)]
            less = np.where(done_p | done_q, done_p & ~done_q, byte(i) < byte(j))
            equal = done_p & done_q
            out[tied] = np.where(equal, p < q, less)
        return out

    def sort(self) -> np.ndarray:
        """Mergesort, all merges of a level at once: each element searches its place in the run beside its own."""
        n = len(self.at)
        order = np.argsort(self.group, kind="stable")
        width = 1
        while width < n:
            place = np.arange(n)
            run = place // width
            start = (run ^ 1) * width  # the partner run
            low = np.minimum(start, n)
            high = np.minimum(start + width, n)
            base = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                smaller = self.before(order[middle], order[open_])
                low[open_] = np.where(smaller, middle + 1, low[open_])
                high[open_] = np.where(smaller, high[open_], middle)
            to = (run // 2) * 2 * width + (place - run * width) + (low - base)
            merged = np.empty_like(order)
            merged[to] = order
            order = merged
            width *= 2
        return order


def _true_extension(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """Common extension by comparing bytes, forward (step 1) or backward (-1)."""
    out = np.zeros(len(a), np.int64)
    alive = np.flatnonzero(most > 0)
    k = 0
    while len(alive):
        i, j = a[alive] + step * k, b[alive] + step * k
        alive = alive[data[i] == data[j]]
        out[alive] = k + 1
        k += 1
        alive = alive[most[alive] > k]
    return out


def repeated_windows(contexts: list[bytes], q: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of the windows that occur at least twice among the contexts of their group.

    q is the anchor's place in its context. Hashes that turn out to collide are
    replaced by others until every class is verified.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(contexts), np.uint8)
    ramp = np.arange(sizes.max(), dtype=np.int32)
    place = np.concatenate([ramp[:n] for n in sizes.tolist()])
    anchor = starts + q
    seed = 2
    while True:
        s = Suffixes(data, anchor, ends, group, width, seed, place)
        order = s.sort()
        x, y = order[:-1], order[1:]
        shared = np.where(group[x] == group[y], s.extension(x, y), -1)
        most = np.minimum(np.minimum(ends[x] - anchor[x], ends[y] - anchor[y]), width)
        true = _true_extension(data, anchor[x], anchor[y], np.where(shared >= 0, most, 0), 1)
        found = None if (np.where(shared >= 0, true, -1) != shared).any() else _classes(s, order, shared, q, sizes, width)
        if found is not None:
            break
        seed += 1
    at = np.flatnonzero(found)
    owner = np.searchsorted(ends, at, "right")
    return owner, at - starts[owner]


def _classes(s: Suffixes, order: np.ndarray, shared: np.ndarray, q: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray | None:
    """Which bytes of the data start repeated windows, or None if a hash collided.

    A window that starts d bytes before the anchor equals another if the two
    suffixes share width - d bytes and the d bytes before them agree.
    """
    hit = np.zeros(len(s.data), bool)
    # Of each context the one that it was last compared with, and how far the bytes to the left agree.
    other, depth = np.full(len(q), -1), np.zeros(len(q), np.int64)
    qo, rest = q[order], (sizes - q)[order]
    for d in range(int(q.max()) + 1):
        need = width - d
        has = np.flatnonzero((qo >= d) & (rest >= need))
        if len(has) < 2:
            continue
        cls = np.cumsum(np.append(0, shared < need))[has]
        who = order[has]
        at = s.at[who]
        left = s.hash(at - d, at)
        by = np.lexsort((left, cls))
        c, h, who = cls[by], left[by], who[by]
        new = np.append(True, (c[1:] != c[:-1]) | (h[1:] != h[:-1]))
        run = np.cumsum(new) - 1
        twice = np.bincount(run)[run] > 1
        if not twice.any():
            continue
        found, lead = who[twice], who[np.flatnonzero(new)][run][twice]
        hit[s.at[found] - d] = True
        a, b = found[found != lead], lead[found != lead]
        new = other[a] != b
        x, y = a[new], b[new]
        other[x] = y
        depth[x] = _true_extension(s.data, s.at[x] - 1, s.at[y] - 1, np.minimum(q[x], q[y]), -1)
        if (depth[a] < d).any():
            return None
    return hit


_SPANS = "tk bigint, th bigint, a int, b int"


def _bucket_sort(width: int):
    """mapInArrow over contexts sorted by core: spans of repeated windows of the edges."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        kind, core, tk, th, lo, q = (table.column(i).to_numpy() for i in range(6))
        owner, start = repeated_windows(table.column(6).to_pylist(), q.astype(np.int64), core, width)
        mine = kind[owner] == 1
        owner, start = owner[mine], start[mine]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (np.diff(start) > 1))) if len(owner) else np.array([], int)
        last = np.append(first, len(owner))[1:] - 1  # none where first has none
        of = owner[first]
        a, b = lo[of] + start[first], lo[of] + start[last] + width
        return pa.record_batch([pa.array(tk[of]), pa.array(th[of]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["tk", "th", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            at = 0
            while at < len(batch):  # a batch may hold several blocks
                piece = batch.slice(at, max(BLOCK_CONTEXTS - count, BLOCK_CONTEXTS >> 3))
                held.append(piece)
                at += len(piece)
                count += len(piece)
                if count >= BLOCK_CONTEXTS:
                    table = pa.Table.from_batches(held)
                    core = table.column(1).to_numpy()
                    whole_ = int(np.searchsorted(core == core[-1], True))
                    if whole_:
                        yield solve(table.slice(0, whole_))
                        held = table.slice(whole_).to_batches()
                        count = len(table) - whole_
        if count:
            yield solve(pa.Table.from_batches(held))

    return run


def _window_digests(width: int):
    """mapInArrow over contexts of crowded buckets: the digest of each window, and where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, tk, th, lo, context in zip(*(batch.column(i) for i in (0, 2, 3, 4, 6)), strict=True):
                data = context.as_py()
                n = len(data) - width + 1
                made = digests([data[i : i + width] for i in range(n)])
                where = np.arange(lo.as_py(), lo.as_py() + n, dtype=np.int32)
                yield pa.record_batch([
                    pa.array(made[:, 0].copy()), pa.array(made[:, 1].copy()), pa.array(np.full(n, kind.as_py() == 4)),
                    pa.array(np.full(n, tk.as_py())), pa.array(np.full(n, th.as_py())), pa.array(where),
                ], ["h1", "h2", "stand", "tk", "th", "a"])

    return run


def _named(text: Column) -> dict[str, Column]:
    """A text's name, 128 bits of hash."""
    return {"__tk": F.xxhash64(text), "__th": F.xxhash64(F.lit("second"), text)}


def repeated_spans(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(tk, th, a, b): byte spans to remove, of texts given as (__data binary, __tk, __th)."""
    rows = texts.select("__data", "__tk", "__th").mapInArrow(releasing(_anchored(width, gram)), _SEGMENTS)
    sorted_ = rows.repartition("core").sortWithinPartitions("core", "s1", "s2")
    parts = saved(sorted_.mapInArrow(releasing(_sorted_out(bucket)), _KINDS))
    spans = parts.filter("kind = 0").select("tk", "th", F.col("lo").alias("a"), (F.col("hi") + width).alias("b")).distinct()
    edges = parts.filter("kind > 0").groupBy("tk", "th").agg(F.collect_list(F.struct("kind", "core", "p", "lo", "hi")).alias("places"))
    met = texts.join(edges, (F.col("__tk") == F.col("tk")) & (F.col("__th") == F.col("th")))
    schema = "kind int, core bigint, tk bigint, th bigint, lo int, q int, context binary"
    contexts = saved(met.select("__data", "tk", "th", "places").mapInArrow(releasing(_contexts(width)), schema))
    sorted_ = contexts.filter("kind < 3").repartition("core").sortWithinPartitions("core")
    sparse = sorted_.mapInArrow(releasing(_bucket_sort(width)), _SPANS)
    digested = "h1 bigint, h2 bigint, stand boolean, tk bigint, th bigint, a int"
    windows = contexts.filter("kind > 2").mapInArrow(releasing(_window_digests(width)), digested)
    twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = windows.filter("not stand").join(twice, ["h1", "h2"], "left_semi")
    crowded = crowded.select("tk", "th", "a", (F.col("a") + width).alias("b"))
    return spans.unionAll(sparse).unionAll(crowded)


def _removed(data: bytes, spans: list | None) -> tuple[bytes, int, int]:
    """What is kept, how many bytes went, in how many runs."""
    kept, at, runs, gone = [], 0, 0, 0
    end = -1
    for a, b in sorted(spans or ()):
        if a > end:
            kept.append(data[at:a])
            runs += 1
            gone += b - a
        elif b > end:
            gone += b - end
        end = max(end, b)
        at = max(at, end)
    kept.append(data[at:])
    return b"".join(kept), gone, runs


def _places(spans: pa.Scalar) -> list[tuple[int, int]] | None:
    return [(x["a"], x["b"]) for x in spans.as_py()] if spans.is_valid else None


def _with_spans(docs: DataFrame, text: str, width: int = WIDTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """docs with __spans, null where nothing goes.

    Shuffles: a row of 60 bytes for each ~85 bytes of text, the texts once to
    fetch contexts and once to meet their spans.
    """
    small_batches(docs.sparkSession)
    named = _named(whole(text))
    spans = repeated_spans(docs.select(whole(text).cast("binary").alias("__data"), *(c.alias(n) for n, c in named.items())), width, gram, bucket)
    spans = saved(spans.groupBy("tk", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    spans = spans.select(F.col("tk").alias("__k"), F.col("th").alias("__h"), F.col("spans").alias("__spans"))
    return docs.withColumns(named).join(spans, (F.col("__tk") == F.col("__k")) & (F.col("__th") == F.col("__h")), "left")


def remove_repeats(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with __kept (the remaining bytes), __removed (bytes) and __runs (maximal removed runs).

    Rows keep all their columns. Options: width, gram, bucket.
    """

    @F.arrow_udf("struct<kept: binary, removed: bigint, runs: bigint>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        made = [_removed(t.as_py().encode(), _places(s)) for t, s in zip(texts, spans, strict=True)]
        columns = [*zip(*made, strict=True)] if made else [(), (), ()]
        return pa.StructArray.from_arrays(
            [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            ["kept", "removed", "runs"],
        )

    out = _with_spans(docs, text, **options).withColumn("__cut", cut(whole(text), F.col("__spans")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.col("__cut.kept").alias("__kept"), F.col("__cut.removed").alias("__removed"), F.col("__cut.runs").alias("__runs"))


def without_repeats(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with the repeats dropped from the text; code points cut in two at an edge go as a whole."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        made = [_removed(t.as_py().encode(), _places(s))[0].decode("utf-8", "ignore") if s.is_valid else None for t, s in zip(texts, spans, strict=True)]
        made = pa.array(made, pa.string())
        release()
        return made

    # One function cuts and decodes: of two, each would have its own workers, and the texts would pass through both.
    made = F.when(F.col("__spans").isNotNull(), cut(whole(text), F.col("__spans"))).otherwise(F.col(f"`{text}`"))
    return _with_spans(docs, text, **options).withColumn(text, made).select([F.col(f"`{c}`") for c in docs.columns])


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """documents without repeated 200-byte strings, as a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select(
        "doc_id", F.octet_length(whole()).cast("bigint").alias("n_bytes"), F.col("__removed").alias("n_removed"),
        F.col("__runs").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"),
    )
