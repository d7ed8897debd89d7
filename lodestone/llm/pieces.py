"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary's pieces stand in a trie over their UTF-8 bytes, kept as two
arrays. The best segmentation of a text has the greatest sum of scores; of equal
ones that with the longest last piece. A character that no piece spells alone
goes as bytes, each a piece, at the least score less UNKNOWN_PENALTY. Spaces are
written as the marker U+2581, and one is put in front; a marker in a text goes
as bytes, so decoding always gives the text back.

No piece has a marker behind another character, so a text is cut before
markers and each part, with its marks, is segmented for itself and remembered
for a while. A vocabulary with other pieces is segmented text by text.

Scores are those of the vocabulary file: tokenizers aren't trained here. Nulls are
empty texts, which have no pieces. Repeated rows are coded alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free, small_batches, whole

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Pieces with a score below this have no log score of their own, as runs of markers; they count one less than the least of the others.
RESERVED = -1e8
#: Parts whose pieces a task remembers; bytes of a part that is segmented with others; parts and characters at once.
_REMEMBERED, _SHORT, _AT_ONCE, _TOGETHER = 400_000, 48, 4096, 1 << 20


def build_trie(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value arrays: the child of node s by byte c is base[s] + c + 1 if check says s."""
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for key, value in zip(keys, values, strict=True):
        node = 0
        for c in key:
            to = children[node].get(c)
            if to is None:
                to = children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = to
        ends[node] = value
    size = 2 * len(children) + 1024
    used = bytearray(size)
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used[0], value[0] = 1, ends[0]
    # Where to look for room: for one child, and for several. The second moves on past crowded ground.
    free, wide = 257, 257
    place, stack = {0: 0}, [0]
    while stack:
        node = stack.pop()
        kids, at = children[node], place[node]
        if not kids:
            continue
        codes = sorted(kids)
        while used[free]:
            free += 1
        start = (free if len(codes) == 1 else max(free, wide)) - codes[0] - 1
        tries = 0
        while any(used[start + c + 1] for c in codes):
            start += 1
            tries += 1
        if tries > 64 and len(codes) > 1:
            wide = start + codes[0] + 1
        base[at] = start
        for c in codes:
            slot = start + c + 1
            used[slot] = 1
            check[slot], value[slot] = at, ends[kids[c]]
            place[kids[c]] = slot
            stack.append(kids[c])
        if max(start, free) + 1024 > size:
            grow = size
            used.extend(bytearray(grow))
            base = np.append(base, np.zeros(grow, np.int32))
            check, value = np.append(check, np.full(grow, -1, np.int32)), np.append(value, np.full(grow, -1, np.int32))
            size += grow
    return base, check, value


@dataclass
class Vocabulary:
    """Pieces by id, their scores, ids of the byte pieces, the trie of the others, and an unknown character's score."""

    pieces: list[str]
    scores: list[float]
    bytes_: list[int]
    trie: tuple[np.ndarray, np.ndarray, np.ndarray]
    unknown: float
    whole_words: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names, scores = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
        odd = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        return cls.of(names, scores, [i for i in range(n) if sp.is_byte(i)], odd)

    @classmethod
    def of(cls, names: list[str], scores: list[float], bytes_: list[int], odd: list[bool]) -> Vocabulary:
        plain = [i for i, x in enumerate(odd) if not x]
        least = min((scores[i] for i in plain if scores[i] > RESERVED), default=0.0)
        scores = [s if s > RESERVED else least - 1 for s in scores]
        trie = build_trie([names[i].encode() for i in plain], plain)
        return cls(names, scores, bytes_, trie, least - UNKNOWN_PENALTY, not any(MARK in names[i].lstrip(MARK) for i in plain))


class Coder:
    """Encodes and decodes by a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.base, self.check, self.value = (x.tolist() for x in v.trie)
        self.unknown = v.unknown
        self.known: dict[str, bytes] = {}
        self.spell = {i: p.replace(MARK, " ").encode() for i, p in enumerate(v.pieces)}
        self.spell |= {i: bytes([k]) for k, i in enumerate(v.bytes_)}
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall if v.whole_words else lambda t: [t]

    def segment(self, data: bytes) -> list[int]:
        """Viterbi over UTF-8 bytes."""
        n, base, check, value, scores = len(data), self.base, self.check, self.value, self.vocabulary.scores
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        at = 0
        while at < n:
            lead = data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            node, here, alone = 0, best[at], False
            for i in range(at, n):
                to = base[node] + data[i] + 1
                if check[to] != node:
                    break
                node = to
                piece = value[node]
                if piece >= 0:
                    score = here + scores[piece]
                    if i + 1 == at + width:
                        alone = True
                    if score > best[i + 1]:
                        best[i + 1], came[i + 1] = score, (at, piece)
            if not alone and here + self.unknown > best[at + width]:
                best[at + width], came[at + width] = here + self.unknown, (at, -1)
            at += width
        out: list[int] = []
        while n:
            start, piece = came[n]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.vocabulary.bytes_[b] for b in reversed(data[start:n])]
            n = start
        return out[::-1]

    def segment_many(self, parts: list[bytes]) -> list[list[int]]:
        """segment() of many short strings at once: one step of all their searches at a time."""
        base, check, value = self.vocabulary.trie
        scores = np.array(self.vocabulary.scores)
        lens = np.array([len(x) for x in parts])
        size, count = int(lens.max()), len(parts)
        data = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in parts), np.uint8).reshape(count, size).astype(np.int64)
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        best = np.full((count, size + 1), -np.inf)
        best[:, 0] = 0
        came, by = np.zeros((count, size + 1), np.int32), np.full((count, size + 1), -1, np.int32)
        for at in range(size):
            rows = np.flatnonzero((lens > at) & ((data[:, at] & 0xC0) != 0x80))
            here, node, alone = best[rows, at], np.zeros(len(rows), np.int64), np.zeros(count, bool)
            first, wide = rows, width[rows, at]
            live, held, span = rows, here, wide
            for i in range(at, size):
                to = base[node] + data[live, i] + 1
                ok = (check[to] == node) & (lens[live] > i)
                if not ok.any():
                    break
                live, node, held, span = live[ok], to[ok], held[ok], span[ok]
                piece = value[node]
                hit = piece >= 0
                if not hit.any():
                    continue
                row, found = live[hit], piece[hit]
                score = held[hit] + scores[found]
                alone[row[span[hit] == i + 1 - at]] = True
                better = score > best[row, i + 1]
                row = row[better]
                best[row, i + 1], came[row, i + 1], by[row, i + 1] = score[better], at, found[better]
            stray = ~alone[first]
            row, end = first[stray], (at + wide)[stray]
            score = here[stray] + self.unknown
            better = score > best[row, end]
            row, end = row[better], end[better]
            best[row, end], came[row, end], by[row, end] = score[better], at, -1
        spell = self.vocabulary.bytes_
        out = []
        for x, n, back, pieces in zip(parts, lens.tolist(), came.tolist(), by.tolist(), strict=True):
            ids: list[int] = []
            while n:
                if pieces[n] >= 0:
                    ids.append(pieces[n])
                else:
                    ids += [spell[b] for b in reversed(x[back[n] : n])]
                n = back[n]
            out.append(ids[::-1])
        return out

    def learn(self, parts: set[str]) -> None:
        """Segments the parts that aren't remembered."""
        if len(self.known) >= _REMEMBERED:
            self.known.clear()
        new = sorted((p.encode("utf-8", "surrogatepass"), p) for p in parts if p not in self.known)
        new.sort(key=lambda x: len(x[0]))
        short = [x for x in new if len(x[0]) <= _SHORT]
        for a in range(0, len(short), _AT_ONCE):
            block = short[a : a + _AT_ONCE]
            for (_, part), ids in zip(block, self.segment_many([x[0] for x in block]), strict=True):
                self.known[part] = np.array(ids, "<u4").tobytes()
        for data, part in new[len(short) :]:
            self.known[part] = np.array(self.segment(data), "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        spelled = np.array([self.vocabulary.bytes_[b] for b in MARK.encode()], "<u4").tobytes()
        cut = [[self.cut((MARK if not i else "") + t.replace(" ", MARK)) for i, t in enumerate(x.split(MARK))] if x else [] for x in texts]
        self.learn({part for parts in cut for piece in parts for part in piece})
        known = self.known.__getitem__
        made = [spelled.join([b"".join(map(known, piece)) for piece in parts]) for parts in cut]
        for part in [p for p in self.known if len(p) > _SHORT]:
            del self.known[part]
        return made

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text: pieces and bytes joined, markers as spaces, without the one in front."""
        joined = b"".join(map(self.spell.__getitem__, ids)).decode("utf-8", "replace")
        return joined.removeprefix(" ")


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    if id(shared.value) not in _coders:
        _coders.clear()
        _coders[id(shared.value)] = Coder(shared.value)
    return _coders[id(shared.value)]


def _blocks(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in blocks of limited length; a longer text is a block."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1])
        if size >= _TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def default_vocabulary() -> str:
    import public_tokenizers as P

    return P.path("piece_bpe_32k.model")


def encode_texts(docs: DataFrame, text: str = "text", vocabulary: str | None = None, name: str = "ids") -> DataFrame:
    """docs with an array of piece ids; a column of that name is an error. The vocabulary is read once and broadcast."""
    free(docs, name)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary or default_vocabulary()))

    @F.arrow_udf("array<int>")
    def f(texts: pa.Array) -> pa.Array:
        coder = _coder(shared)
        made = [ids for block in _blocks(texts) for ids in coder.encode_many(block)]
        offsets = np.cumsum([0, *(len(m) // 4 for m in made)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), "<i4")))

    return docs.withColumn(name, f(whole(text)))


def decode_ids(docs: DataFrame, ids: str = "ids", vocabulary: str | None = None, name: str = "decoded") -> DataFrame:
    """docs with the text of an array of piece ids; null ids give an empty text; a column of that name is an error."""
    free(docs, name)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary or default_vocabulary()))

    @F.arrow_udf("string")
    def f(column: pa.Array) -> pa.Array:
        decode = _coder(shared).decode
        return pa.array([decode(x.as_py() or ()) for x in column], pa.string())

    return docs.withColumn(name, f(F.col(f"`{ids}`")))


def _digests(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        is_byte = np.isin(np.arange(len(coder.vocabulary.pieces)), coder.vocabulary.bytes_)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for block in _blocks(batch.column(1)):
                for text, data in zip(block, coder.encode_many(block), strict=True):
                    ids = np.frombuffer(data, "<u4")
                    back = coder.decode(ids.tolist())
                    digest = hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()
                    values = (len(ids), int(is_byte[ids].sum()), zlib.crc32(data), digest, back == text)
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "decoded_sha256", "round_trip"])

    return run


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Pieces of documents as a digest, and whether decoding them gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text"))
    shared = spark.sparkContext.broadcast(Vocabulary.load(default_vocabulary()))
    return docs.mapInArrow(_digests(shared), "doc_id bigint, n_pieces bigint, n_bytes bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean")
