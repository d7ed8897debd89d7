"""Near-duplicate texts by Jaccard similarity of word shingles, candidates by pigeonring filtering.

64 majority bits place texts of similarity 0.8 five to fifteen bits apart, where
no segment is likely to agree. So the ring here has 24 boxes, each the least of
the shingles' hashes under its own mixing: a box differs with probability one
minus the similarity, and at 0.8 more than TAU differ for one pair in a
thousand. Of two texts within TAU boxes some start has all its runs of l boxes
within l * TAU / 24 differing ones; its first two boxes agree, which is the
bucket. Longer runs and the whole ring are tested inside the bucket; links that
pass are checked against the shingles themselves.

A bucket of up to SMALL rings sends all its links. A larger one sends one
spanning forest, of the nearest links. Where these leave texts of a family, which is
all that meet in such buckets, in different classes, the shingle sets themselves
settle it: the texts outside the family's largest class are compared with all
others through an inverted index in each task, which gives only links that join
classes. Families are cut in blocks by the bytes of their sets, so no pair of
texts is ever a row, and what a task holds is bounded.

Nulls count as empty texts; texts without words are alike. Equal texts, also
repeated rows, are one node, named by XXH64. An empty table gives an empty
result; a hub's sets are copied once for each _PART links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import release, releasing, saved, small_batches, whole
from lodestone.llm.graph import components
from lodestone.llm.simhash import shingle_hashes

BOXES = 24
#: Boxes that may differ, and how many of each run of 1, 2, ... boxes.
TAU = 11
BUDGETS = np.arange(1, BOXES + 1) * TAU // BOXES
#: Buckets of so many rings send all their links, at most half as many for each ring;
#: larger ones send a spanning forest, of links of up to the first of these distances where they connect, then the next.
SMALL, TIERS = 16, (2, 5, 8, TAU)
#: Links of one text that are checked against one copy of its shingle set.
_PART = 256
#: Bytes of shingle sets that one block of a family has.
BLOCK = 4 << 20
_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 1 << 64, BOXES, np.uint64)
_ODD = _rng.integers(0, 1 << 64, BOXES, np.uint64) | np.uint64(1)
_STARTS = _rng.integers(0, 1 << 64, BOXES, np.uint64)


def boxes(text: str, shingle: int) -> bytes:
    """The ring of a text: BOXES little-endian unsigned 32-bit ints, zero for a text without words."""
    least = None
    for h in shingle_hashes(text, shingle):
        now = ((h[:, None] ^ _XOR) * _ODD).min(axis=0)
        least = now if least is None else np.minimum(least, now)
    return bytes(4 * BOXES) if least is None else (least & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def shingle_set(text: str, shingle: int) -> bytes:
    """The distinct shingle hashes, ascending."""
    parts = [np.unique(h) for h in shingle_hashes(text, shingle)]
    return np.unique(np.concatenate(parts)).astype("<u8").tobytes() if parts else b""


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two shingle sets; two empty ones are alike."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _of_text(make, shingle: int):
    @F.arrow_udf("binary")
    def f(texts: pa.Array) -> pa.Array:
        made = pa.array([make(t.as_py(), shingle) for t in texts], pa.binary())
        release()
        return made

    return f


def _alike(share: float):
    @F.arrow_udf("boolean")
    def f(one: pa.Array, other: pa.Array) -> pa.Array:
        return pa.array([jaccard(a.as_py(), b.as_py()) >= share for a, b in zip(one, other, strict=True)], pa.bool_())

    return f


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: each ring (node, boxes) under each start's bucket key, with a byte of every box in t0 to t2."""
    for batch in batches:
        ring = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, BOXES)
        tags = np.ascontiguousarray(ring.astype(np.uint8)).view("<i8")
        pair = ring.astype(np.uint64) | (np.roll(ring, -1, axis=1).astype(np.uint64) << np.uint64(32))
        keys = ((pair ^ _STARTS) * _ODD).view(np.int64)
        repeat = lambda x: pa.array(np.repeat(x, BOXES))
        yield pa.record_batch([
            pa.array(keys.ravel()), repeat(batch.column(0).to_numpy()), pa.array(np.tile(np.arange(BOXES, dtype=np.int32), len(ring))),
            *(repeat(tags[:, i]) for i in range(BOXES // 8)),
        ], ["key", "node", "start", "t0", "t1", "t2"])


def within(differ: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which rows of box differences keep all runs from their start, the whole ring included, in budget."""
    turned = np.take_along_axis(differ, (starts[:, None] + np.arange(BOXES)) % BOXES, axis=1)
    return (turned.cumsum(axis=1) <= BUDGETS).all(axis=1)


def _pairs(tags: np.ndarray, start: int) -> np.ndarray:
    """All links of a small bucket."""
    x, y = np.triu_indices(len(tags), 1)
    near = within(tags[x] != tags[y], np.full(len(x), start))
    return np.stack([x[near], y[near]], axis=1)


def _span(tags: np.ndarray, start: int, tau: int) -> np.ndarray:
    """A spanning forest of a bucket's links of at most tau boxes: each step compares one ring with those not reached yet."""
    rest, edges, queue = np.arange(len(tags)), [], []
    while len(rest):
        if queue:
            at = queue.pop()
        else:
            at, rest = rest[0], rest[1:]
        differ = tags[rest] != tags[at]
        near = (differ.sum(axis=1) <= tau) & within(differ, np.full(len(rest), start))
        edges += [(at, x) for x in rest[near]]
        queue += list(rest[near])
        rest = rest[~near]
    return np.array(edges, int).reshape(-1, 2)


def _forest(tags: np.ndarray, start: int) -> np.ndarray:
    """One spanning forest of a bucket's links: a link of more boxes only between what those of fewer leave apart."""
    root, edges = list(range(len(tags))), []

    def of(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for tau in TIERS:
        for x, y in _span(tags, start, tau).tolist():
            a, b = of(x), of(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((x, y))
    return np.array(edges, int).reshape(-1, 2)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by bucket, their first, in runs of whole buckets."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        if not len(now[0]):
            continue
        held.append(now)
        if now[0][0] == now[0][-1] and held[0][0][0] == now[0][0]:
            continue  # one bucket so far
        now = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = now[0] == now[0][-1]
        held = [[x[last] for x in now]]
        yield [x[~last] for x in now]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _sizes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket begins, and its rows."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.array([], int)
    return first, np.diff(np.append(first, len(key)))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows sorted by bucket: the links (a, b, -1) of each bucket, all of them or a spanning forest.

    Each ring of a bucket that sends a forest gives a row (key, node, start) too.
    """
    for key, node, start, *tags in _buckets(batches):
        first, sizes = _sizes(key)
        tags = np.stack(tags, axis=1).view(np.uint8)
        two = first[sizes == 2]
        two = two[within(tags[two] != tags[two + 1], start[two])]
        a, b, kind = [node[two]], [node[two + 1]], [np.full(len(two), -1, np.int32)]
        for s, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own, at = tags[s : s + n], int(start[s])
            edges = _pairs(own, at) if n <= SMALL else _forest(own, at)
            a.append(node[edges[:, 0] + s])
            b.append(node[edges[:, 1] + s])
            kind.append(np.full(len(edges), -1, np.int32))
            if n > SMALL:
                a.append(key[s : s + n])
                b.append(node[s : s + n])
                kind.append(start[s : s + n])
        yield pa.record_batch([pa.array(np.concatenate(x)) for x in (a, b, kind)], ["a", "b", "start"])


def joining(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], ask: np.ndarray, share: float) -> list[tuple[int, int]]:
    """Links of at least that similarity from the texts marked by ask to any, none of which the links before it imply."""
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, of = np.unique(np.concatenate(sets), return_inverse=True) if sizes.sum() else (np.empty(0), np.empty(0, int))
    by = np.argsort(of, kind="stable")
    holders, cuts = owner[by], np.searchsorted(of[by], np.arange(len(values) + 1))
    ends = np.cumsum(sizes)
    _, group = np.unique(labels, return_inverse=True)
    out = []
    for x in np.flatnonzero(ask):
        if (group == group[0]).all():
            break
        own = of[ends[x] - sizes[x] : ends[x]]
        both = np.bincount(np.concatenate([holders[cuts[i] : cuts[i + 1]] for i in own]), minlength=len(sets)) if len(own) else np.where(sizes == 0, 1, 0)
        total = sizes + sizes[x] - both
        near = both >= share * total if len(own) else both > 0
        for y in np.flatnonzero(near & (group != group[x])):
            if group[y] != group[x]:
                out.append((int(nodes[x]), int(nodes[y])))
                group[group == group[y]] = group[x]
    return out


def _settled(share: float):
    """mapInArrow over (family, one, two, node, label, ask, set) sorted by family and blocks: links that join classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def solve() -> pa.RecordBatch:
            node, label, ask, sets = (list(x) for x in zip(*rows, strict=True))
            links = joining(np.array(node), np.array(label), [np.frombuffer(x, "<u8") for x in sets], np.array(ask, bool), share)
            return pa.record_batch([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for family, one, two, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (family, one, two) != now:
                    if rows:
                        yield solve()
                    now, rows = (family, one, two), []
                rows.append(row)
        if rows:
            yield solve()

    return run


_KEYED = "key bigint, node bigint, start int, t0 bigint, t1 bigint, t2 bigint"


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sent(nodes: DataFrame) -> DataFrame:
    """What _linked gives for (node, boxes)."""
    keyed = nodes.select("node", "boxes").mapInArrow(releasing(_keys), _KEYED)
    # In the order of nodes the forests of a family's buckets mostly start from the same text, so their links coincide.
    spread = keyed.repartition("key").sortWithinPartitions("key", "node")
    return spread.mapInArrow(releasing(_linked), "a bigint, b bigint, start int")


def candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b), a < b, among (node, boxes) that connect all nodes within TAU boxes."""
    return _ordered(_sent(nodes).filter("start < 0"))


def _family_links(members: DataFrame, labels: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Links that join classes within the families of members (key, node) of large buckets."""
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"))
    family = components(members.join(hubs, "key").select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("label", "family")
    known = family.join(labels, "node", "left").join(sets, "node")
    known = saved(known.select("family", "node", F.coalesce("label", "node").alias("label"), "set"))
    classes = known.groupBy("family", "label").agg(F.sum(F.octet_length("set") + 64).alias("bytes"))
    cut = lambda x: F.ceil(x / BLOCK).cast("int")
    main = F.max(F.struct("bytes", "label"))
    split = classes.groupBy("family").agg(main["label"].alias("main"), cut(main["bytes"]).alias("large"), cut(F.sum("bytes") - main["bytes"]).alias("small"))
    rows = known.join(split.filter("small > 0"), "family").withColumn("ask", F.col("label") != F.col("main"))
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("own", F.when(F.col("ask"), spread(F.col("small"))).otherwise(F.col("small") + spread(F.col("large"))))
    # Each block outside the main class meets every other block once; within itself it is compared each time.
    others = F.filter(F.sequence(F.lit(0), F.col("small") + F.col("large") - 1), lambda o: (o != F.col("own")) & ((o < F.col("small")) | F.col("ask")))
    rows = rows.select("family", "own", "node", "label", "ask", "set", F.explode(others).alias("o"))
    rows = rows.select("family", F.least("own", "o").alias("one"), F.greatest("own", "o").alias("two"), "node", "label", "ask", "set")
    spread_ = rows.repartition("family", "one", "two").sortWithinPartitions("family", "one", "two", "node")
    return _ordered(spread_.mapInArrow(releasing(_settled(share)), "a bigint, b bigint"))


def _checked(edges: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The edges whose shingle sets have at least that similarity.

    A text with many links is dealt out in parts, each with a copy of its set.
    """
    many = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / _PART).alias("parts")).filter("parts > 1")
    dealt = saved(edges.join(many, "a", "left").withColumn("part", F.pmod(F.hash("b"), F.coalesce("parts", F.lit(1))).cast("int")))
    heads = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("node", "a"), "a")
    both = dealt.join(heads, ["a", "part"]).join(sets.select(F.col("node").alias("b"), F.col("set").alias("other")), "b")
    return both.filter(_alike(share)(F.col("set"), F.col("other"))).select("a", "b")


def near_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, share: float = 0.8) -> DataFrame:  # noqa: A002
    """(id, node, class_node, component_id) for each row; component_id is the least id of the row's class.

    Classes are the components of links of at least that similarity. Empty
    tables give empty results, repeated rows rows of their own; a class of rows
    without ids has a null component_id.
    """
    small_batches(docs.sparkSession)
    body = docs.select(F.col(id).cast("bigint").alias("id"), whole(text).alias("text")).withColumn("node", F.xxhash64("text"))
    rows = saved(body.select("id", "node", _of_text(boxes, shingle)("text").alias("boxes")))
    nodes = saved(rows.groupBy("node").agg(F.min("id").alias("least"), F.min("boxes").alias("boxes")))
    sent = saved(_sent(nodes))
    edges = saved(_ordered(sent.filter("start < 0")))
    members = sent.filter("start >= 0").select(F.col("a").alias("key"), F.col("b").alias("node"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).unionAll(members.select("node")).distinct().join(nodes, "node").select("node", F.col("least").alias("id"))
    same_id = (F.col("r.node") == F.col("e.node")) & F.col("r.id").eqNullSafe(F.col("e.id"))
    texts = body.alias("r").join(ends.alias("e"), same_id).select("r.node", "r.text")
    sets = saved(texts.withColumn("set", _of_text(shingle_set, shingle)("text")).groupBy("node").agg(F.min("set").alias("set")))
    first = saved(_checked(edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, share))
    label = saved(components(first))
    named = edges.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
    named = named.join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    apart = saved(named.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"))
    links = saved(first.unionAll(_checked(apart, sets, share)))
    label = saved(components(links))
    if not members.isEmpty():
        label = saved(components(links.unionAll(_family_links(members, label, sets, share))))
    labels = nodes.select("node", "least").join(label, "node", "left")
    labels = saved(labels.select("node", "least", F.coalesce("label", "node").alias("class_node")))
    classes = labels.groupBy("class_node").agg(F.min("least").alias("component_id"))
    named = labels.join(classes, "class_node").select("node", "class_node", "component_id")
    return rows.select(F.col("id").alias(id), "node").join(named, "node").select(id, "node", "class_node", "component_id")


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, share: float = 0.8) -> DataFrame:  # noqa: A002
    """Of each class of near-duplicates one row with the least id; columns as they were.

    Classes whose rows all lack ids keep one row too.
    """
    classes = near_classes(docs, id, text, shingle, share)
    kept = classes.filter(F.col(id).eqNullSafe(F.col("component_id"))).groupBy("class_node").agg(F.min("node").alias("node"), F.min(id).alias("id"))
    marked = docs.withColumn("__lo_node", F.xxhash64(whole(text))).withColumn("__lo_id", F.col(id).cast("bigint"))
    kept = kept.select(F.col("node").alias("__k_node"), F.col("id").alias("__k_id"))
    same = (F.col("__lo_node") == F.col("__k_node")) & F.col("__lo_id").eqNullSafe(F.col("__k_id"))
    return marked.join(kept, same, "left_semi").dropDuplicates(["__lo_node", "__lo_id"]).select(docs.columns)
