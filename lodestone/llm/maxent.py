"""A hashed maximum-entropy language model with class-factored softmax.

P(token | context) = P(class | context) * P(subclass | class, context) *
P(word | subclass, context). The most frequent training words are the model's
vocabulary, dealt to classes of classes; all others share one class, in which a
word has its smoothed share of the corpus counts, so the model gives every token
a probability. Context features are the word before, the pair before, and skips
over one and two words, hashed to rows of weights for the classes and, with the
class, for what it divides into; biases start from counts.

Counts of all training documents' words come from a distributed aggregation.
Weights are trained by rounds of distributed gradient updates. Documents are
dealt to shards by a hash of id and text, as many as there are tokens for, and
come in the order of that hash, so neither partitions nor a task that is run
again change the model. A shard runs AdaGrad from the current weights over every
position of its documents; a round averages the changes over the shards that
made them. Each shard belongs to one round, so each position is learned once.
Scoring works in numpy batches.

Counts of words too rare for the broadcast dictionary of HEAD words are joined,
not broadcast. Nulls are empty texts, whose only token is the end; long texts
are worked on in parts. Repeated rows are scored alike and learned each. Without
training documents every token has the count 0, and the base model's share; an
empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import releasing, remainder, saved, small_batches, whole

FOLDS, HELD_OUT = 7, 2
#: Words whose counts are broadcast.
HEAD = 100_000
#: Children of a class; the root's last child is the class of all words outside the vocabulary.
BRANCH, LEVELS = 16, 3
VOCABULARY = (BRANCH - 1) * BRANCH ** (LEVELS - 1)
#: Hashed rows of weights of each level.
ROWS = (1 << 14, 1 << 16, 1 << 16)
ROUNDS, SHARD_TOKENS, RATE = 2, 2_000_000, 0.15
BATCH = 8192
#: Distinct words a task counts before it hands them on, and bytes of a text handled at a time.
_HELD, _PART = 400_000, 1 << 20

END = b"\n"  # not a word: words hold no white space
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_SPACE = re.compile(rb"[ \t-\r]")

Weights = tuple[np.ndarray, ...]


def word_parts(text: str) -> Iterator[list[bytes]]:
    """Words of the text with A-Z in lower case, then the end, in lists of bounded length."""
    data = text.encode("utf-8", "surrogatepass").lower()
    at = 0
    while len(data) - at > _PART and (cut := _SPACE.search(data, at + _PART)):
        yield data[at : cut.start()].split()
        at = cut.start()
    yield [*data[at:].split(), END]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            for words in word_parts(text.as_py()):
                held.update(words)
                if len(held) > _HELD:
                    yield flush()
    if held:
        yield flush()


def most_frequent(counts: DataFrame, head: int) -> list[tuple[bytes, int]]:
    """The head most frequent words of (word, n) with their counts, ties by word.

    The least count among them is found first, from how many words have each count, so
    partitions send the words that are wanted instead of head each; words of that count
    itself are ordered in Spark.
    """
    least, room = 0, head
    for n, words in sorted(counts.groupBy("n").agg(F.count(F.lit(1))).collect(), reverse=True):
        if words > room:
            least = n
            break
        room -= words
    rows = counts.filter(F.col("n") > least).collect()
    if least and room:
        rows += counts.filter(F.col("n") == least).orderBy("word").limit(room).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


class Model:
    """The dictionary of frequent words, and what the weights start from."""

    def __init__(self, head: list[bytes], counts: np.ndarray, total: int, distinct: int):
        self.index = {w: i for i, w in enumerate(head)}
        self.counts, self.total, self.distinct = counts, total, distinct
        # Words in order of count, dealt so that a class has words of like count.
        self.size = size = min(len(head), VOCABULARY)
        words = np.zeros(VOCABULARY)
        words[:size] = np.maximum(counts[:size], 1)
        self.tail_types = distinct - size
        self.tail_tokens = total - int(counts[:size].sum())
        self.biases = []
        for level in range(LEVELS):
            sums = words.reshape(-1, BRANCH ** (LEVELS - 1 - level)).sum(axis=1)
            sums = np.append(sums, self.tail_tokens + self.tail_types + 1) if not level else sums
            self.biases.append(np.where(sums > 0, np.log(np.maximum(sums, 1)), -30.0).astype(np.float32).reshape(-1, BRANCH))
        self.context = np.array([zlib.crc32(w) for w in head], _U)

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Head index of each token (-1: none), and its hash as a context."""
        get = self.index.get
        at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        context = np.take(self.context, at, mode="wrap") if len(self.context) else np.zeros(len(at), _U)
        rare = np.flatnonzero(at < 0)
        context[rare] = [zlib.crc32(words[i]) for i in rare.tolist()]
        return at, context

    def parts(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """Head indices, features and tokens of the text, part by part."""
        before = np.array([1, 2, 3], _U)  # what stands before the text, nearest last
        for words in word_parts(text):
            at, context = self.tokens(words)
            line = np.concatenate([before, context])
            yield at, context_features(line), words
            before = line[-3:]

    def targets(self, at: np.ndarray) -> np.ndarray:
        return np.where((at >= 0) & (at < self.size), at, VOCABULARY)


def context_features(line: np.ndarray) -> np.ndarray:
    """(tokens, 4) hashes for the tokens after the first three: the word before, the pair before, skips over one and two words."""
    one, two, three = line[2:-1], line[1:-2], line[:-3]
    out = np.empty((len(one), 4), _U)
    np.multiply(one, _ODD[0], out=out[:, 0])
    np.add(one * _ODD[1], two * _ODD[2], out=out[:, 1])
    np.multiply(two, _ODD[3], out=out[:, 2])
    np.multiply(three, _ODD[4], out=out[:, 3])
    return out


def _rows(features: np.ndarray, level: int, classes: np.ndarray) -> np.ndarray:
    """Rows of weights, shape (features, positions), from features of that shape."""
    h = features + (classes.astype(_U) * _ODD[1] + _U(level)) if level else features.copy()
    h ^= h >> _U(29)
    h *= _ODD[2]
    h >>= _U(65 - ROWS[level].bit_length())
    return h.astype(np.uint16)


#: Logarithms between which a float32 holds exponentials and sums of BRANCH of them.
_EXP = 80.0


def _softmax(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and their sums; shifted by the greatest where they could leave the range of a float32."""
    z = np.take(weights, rows[0], axis=0)
    for row in rows[1:]:
        z += np.take(weights, row, axis=0)
    z += bias
    if not (z.max() < _EXP and z.min() > -_EXP):
        z -= np.ascontiguousarray(z.T).max(axis=0)[:, None]
    np.exp(z, out=z)
    return z, np.einsum("ij->i", z)


def _picked(children: np.ndarray) -> np.ndarray:
    """Where the children stand in the raveled values of their positions."""
    return np.arange(0, BRANCH * len(children), BRANCH) + children


#: Rows that occur up to so often in a batch are summed occurrence by occurrence, the others one by one.
_FEW = 4


def _row_sums(g: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries of rows, shape (features, positions), and the sums of g over the positions of each, in order."""
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    sorted_ = flat[order]
    at = np.tile(np.arange(len(g)), len(rows))[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    times = np.diff(np.append(first, len(at)))
    total = np.take(g, at[first], axis=0)
    for n in range(2, _FEW + 1):
        few = np.flatnonzero(times == n)
        own = np.take(total, few, axis=0)
        for k in range(1, n):
            own += np.take(g, at[first[few] + k], axis=0)
        total[few] = own
    if len(often := np.flatnonzero(times > _FEW)):
        own = np.take(g, at[np.repeat(times > _FEW, times)], axis=0)
        total[often] = np.add.reduceat(own, np.cumsum(times[often]) - times[often], axis=0)
    return sorted_[first], total


def _walk(model: Model, features: np.ndarray, targets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, positions, biases, rows, children) down the classes; words outside the vocabulary end at the first."""
    inside = np.flatnonzero(targets < VOCABULARY)
    features = np.ascontiguousarray(features.T)
    for level in range(LEVELS):
        width = BRANCH ** (LEVELS - 1 - level)
        at = inside if level else np.arange(len(targets))
        if not len(at):
            return
        if level == 1:
            features, targets = np.take(features, at, axis=1), targets[at]
        child = targets // width
        parent = child // BRANCH
        # The root has one row of biases, for all positions.
        bias = np.take(model.biases[level], parent, axis=0) if level else model.biases[0]
        yield level, at, bias, _rows(features, level, parent), child % BRANCH


def log_probabilities(model: Model, weights: Weights, features: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target; for those outside the vocabulary that of their class alone."""
    out = np.zeros(len(targets))
    for a in range(0, len(targets), BATCH):
        part = out[a : a + BATCH]
        for level, at, bias, rows, child in _walk(model, features[a : a + BATCH], targets[a : a + BATCH]):
            z, sums = _softmax(bias, weights[level], rows)
            part[at] += np.log(np.take(z, _picked(child)) / sums)
    return out


#: Rows whose sums, squares and weights an update has at hand at once: they fit a core's cache.
_CHUNK = 1 << 11


def update(model: Model, weights: Weights, squares: Weights, features: np.ndarray, targets: np.ndarray) -> None:
    """One AdaGrad update of all levels from a batch of positions: observed minus expected, summed per row."""
    for level, _, bias, rows, child in _walk(model, features, targets):
        g, sums = _softmax(bias, weights[level], rows)
        g /= sums[:, None]
        g.ravel()[_picked(child)] -= 1
        all_to, totals = _row_sums(g, rows)
        for a in range(0, len(all_to), _CHUNK):
            to, total = all_to[a : a + _CHUNK], totals[a : a + _CHUNK]
            square = total * total
            square += np.take(squares[level], to, axis=0)
            squares[level][to] = square
            square += 1e-3
            total *= RATE
            total /= np.sqrt(square, out=square)
            weight = np.take(weights[level], to, axis=0, out=square, mode="clip")
            weight -= total
            weights[level][to] = weight


_PIECE = 1 << 12  # rows of weights sent as one record
_CHANGES = "level int, at int, shard int, change binary"


def _trained(shared, current):
    """mapInArrow over training texts (shard, text) sorted by shard: the changes each shard makes to the weights, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, base = shared.value, current.value
        now = weights = squares = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def learn(least: int) -> None:
            """Updates by whole batches; what is left is kept, if it is less than least."""
            nonlocal held, count
            if count < max(least, 1):
                return
            features, at = (np.concatenate(x) for x in zip(*held, strict=True))
            targets = model.targets(at)
            a = 0
            while count - a >= least and a < count:
                update(model, weights, squares, features[a : a + BATCH], targets[a : a + BATCH])
                a += BATCH
            held, count = [(features[a:], at[a:])], max(count - a, 0)

        def done() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            learn(1)
            for level, (new, old) in enumerate(zip(weights, base, strict=True)):
                for a in range(0, len(new), _PIECE):
                    change = new[a : a + _PIECE] - old[a : a + _PIECE]
                    if change.any():
                        values = (level, a, now, change.tobytes())
                        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
                        yield pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["level", "at", "shard", "change"])

        for batch in batches:
            for shard, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now:
                    yield from done()
                    now, held, count = shard, [], 0
                    weights, squares = [w.copy() for w in base], [np.zeros_like(w) for w in base]
                for at, features, _ in model.parts(text.as_py()):
                    held.append((features, at))
                    count += len(at)
                    learn(BATCH)
        yield from done()

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over changes sorted by piece and shard: their mean over the shards that changed a row."""
    now, total, made = None, None, None

    def done() -> pa.RecordBatch:
        mean = (total / np.maximum(made, 1)[:, None]).astype(np.float32).tobytes()
        return pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([mean], pa.binary())], ["level", "at", "change"])

    for batch in batches:
        for level, at, change in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            x = np.frombuffer(change, np.float32).reshape(-1, BRANCH).astype(float)
            if (level, at) != now:
                if now is not None:
                    yield done()
                now, total, made = (level, at), np.zeros_like(x), np.zeros(len(x))
            total += x
            made += x.any(axis=1)
    if now is not None:
        yield done()


def zeros() -> Weights:
    return tuple(np.zeros((n, BRANCH), np.float32) for n in ROWS)


def train(texts: DataFrame, model: Model, rounds: int = ROUNDS) -> Weights:
    """Weights from (id, text). The driver holds the model alone, whose size is fixed."""
    sc = texts.sparkSession.sparkContext
    weights = zeros()
    if not model.total or not rounds:
        return weights
    shared = sc.broadcast(model)
    shards = rounds * -(-model.total // (rounds * SHARD_TOKENS))
    dealt = texts.withColumn("__h", F.xxhash64("id", "t")).withColumn("__s", F.pmod("__h", F.lit(shards)).cast("int"))
    for turn in range(rounds):
        current = sc.broadcast(weights)
        own = dealt.filter(F.col("__s") % rounds == turn).repartition(shards // rounds, "__s").sortWithinPartitions("__s", "__h", "id", "t")
        changes = own.select("__s", "t").mapInArrow(releasing(_trained(shared, current)), _CHANGES)
        means = changes.repartition(8, "level", "at").sortWithinPartitions("level", "at", "shard")
        weights = tuple(w.copy() for w in weights)
        for r in means.mapInArrow(_averaged, "level int, at int, change binary").toLocalIterator():
            x = np.frombuffer(r["change"], np.float32).reshape(-1, BRANCH)
            weights[r["level"]][r["at"] : r["at"] + len(x)] += x
    return weights


def _scored(shared, current):
    """mapInArrow over (id, fold, text): sums over the head words, and the others with their numbers."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["row", "id", "fold", "n_tokens", "n_known", "base", "score", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = shared.value, current.value
        counts = model.counts.astype(float)
        base_of = np.log10((counts + 1) / (model.total + model.distinct + 1))
        tail_of = np.log10((counts + 1) / (model.tail_tokens + model.tail_types + 1))
        row = TaskContext.get().partitionId() << 33
        done: list[list] = []
        held: list[tuple] = []  # what isn't scored yet: (document, head indices, features)
        count = 0

        def score() -> None:
            """Adds what the held parts give to their documents."""
            nonlocal held, count
            if not held:
                return
            at = np.concatenate([at for _, at, _ in held])
            logs = log_probabilities(model, weights, np.concatenate([f for _, _, f in held]), model.targets(at)) / np.log(10)
            tokens = [len(at) for _, at, _ in held]
            of = np.repeat(np.arange(len(held)), tokens)
            in_tail = np.flatnonzero(at >= model.size)
            logs[in_tail] += np.take(tail_of, at[in_tail])
            known = np.flatnonzero(at >= 0)
            summed = lambda x, which: np.bincount(of[which], x, len(held)).tolist()
            sums = zip(held, tokens, summed(None, known), summed(np.take(base_of, at[known]), known), summed(logs, slice(None)), strict=True)
            for (doc, _, _), *found in sums:
                for i, x in enumerate(found):
                    doc[3 + i] += x
            held, count = [], 0

        def flush() -> pa.RecordBatch:
            score()
            columns = [list(c) for c in zip(*done, strict=True)]
            rare = columns.pop()
            done.clear()
            ends = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            words, times = ([x for r in rare for x in get(r)] for get in (Counter.keys, Counter.values))
            inner = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int32())], ["word", "times"])
            lists = pa.ListArray.from_arrays(pa.array(ends), inner)
            return pa.record_batch([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), lists], names)

        for batch in batches:
            size = 0
            for key, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                doc = [row, key, fold, 0, 0, 0.0, 0.0, Counter()]
                done.append(doc)
                row += 1
                for at, features, words in model.parts(text.as_py()):
                    doc[7].update([words[j] for j in np.flatnonzero(at < 0).tolist()])
                    held.append((doc, at, features))
                    count += len(at)
                    if count >= 8 * BATCH:
                        score()
                size += len(doc[7])
                if size >= _HELD // 4:
                    yield flush()
                    size = 0
            if done:
                yield flush()

    return run


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:  # noqa: A002
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    fold = remainder(id, FOLDS).cast("int")
    rows = docs.select(F.col(id).cast("bigint").alias("id"), fold.alias("fold"), whole(text).alias("t"))
    training = rows.filter(F.col("fold") != HELD_OUT).select("id", "t")
    counts = saved(training.select("t").mapInArrow(releasing(_counted), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, head)
    model = Model([w for w, _ in top], np.array([n for _, n in top], np.int64), total, distinct)
    weights = train(training, model, rounds)
    sc = spark.sparkContext
    schema = "row bigint, id bigint, fold int, n_tokens bigint, n_known bigint, base double, score double, rare array<struct<word:binary,times:int>>"
    parts = saved(rows.select("id", "fold", "t").mapInArrow(releasing(_scored(sc.broadcast(model), sc.broadcast(weights))), schema))
    # Words beyond the dictionary: their counts by a join, their logs summed for each row.
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    joined = rare.join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    log = lambda bottom: F.sum(F.col("times") * F.log10((n + 1) / F.lit(float(bottom))))
    sums = joined.groupBy("row").agg(
        log(total + distinct + 1).alias("rare_base"), log(model.tail_tokens + model.tail_types + 1).alias("rare_score"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
    )
    out = parts.drop("rare").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        F.col("id").alias(id), (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("score") + zero("rare_score")).alias("score"),
    )


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model and by smoothed counts."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
