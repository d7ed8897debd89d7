"""The training-data operators against brute force, with nulls, empty and repeated rows, and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import ann, chat, cws, maxent, packing, pieces, pii, quality, rings, simhash, suffix
from lodestone.llm.common import prefix_sums
from lodestone.llm.graph import components
from tests.conftest import SF

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["an", "the", "or", "é", "ion", "xy", "ab", "Be"]) + r.choice(["s", "", "ed"]) for _ in range(n))


def test_prefix_sums(spark):
    xs = [random.Random(i).choices(range(9), k=n) for i, n in enumerate((0, 1, 5, 256, 257, 1000))]
    df = spark.createDataFrame([(x,) for x in xs], "x array<int>")
    got = [r[0] for r in df.select(prefix_sums(F.col("x"))).collect()]
    assert sorted(map(tuple, got)) == sorted(tuple(sum(x[:i]) for i in range(len(x))) for x in xs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 1 ---------------------------------------------------------------------------


def test_neighbours(spark):
    r = np.random.Generator(np.random.PCG64(3))
    centres = r.standard_normal((12, 16))
    v = centres[r.integers(0, 12, 1500)] + 0.4 * r.standard_normal((1500, 16))
    v[200:230] = v[199]
    rows = [(i, x.tolist(), i) for i, x in enumerate(v)]
    rows += [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [None] + [1.0] * 15, 0), (5003, [float("nan")] * 16, 0), (None, [1.0] * 16, 0), (5004, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cell int")
    got = {}
    for q, rank, i, s in ann.neighbours(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(q, []).append((rank, i, s))
    norm = np.sqrt((v * v).sum(axis=1))
    hits = 0
    assert set(got) == set(range(0, 1500, 50))
    for q, found in got.items():
        cos = (v * v[q]).sum(axis=1) / (norm * norm[q])
        cos[q] = -9
        best = np.lexsort((np.arange(1500), -cos))[:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(abs(cos[f[1]] - f[2]) < 1e-12 for f in found)
        hits += len({f[1] for f in found} & set(best.tolist()))
        if q == 200:
            assert [f[1] for f in found] == [199, 201, 202, 203, 204]
    assert hits / (5 * len(got)) >= 0.9
    assert ann.neighbours(df.limit(0), df.limit(0)).count() == 0
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


def test_neighbours_of_odd_vectors(spark):
    """Repeated rows, two vectors of one id, other lengths, and components of any size, against brute force."""
    r = np.random.Generator(np.random.PCG64(5))
    rows = [(i, (r.standard_normal(6) * 10.0 ** int(r.integers(-200, 200))).tolist()) for i in range(0, 120)]
    rows += [(i, r.standard_normal(3).tolist()) for i in range(200, 220)]
    rows += rows[:12] * 2 + [(0, rows[1][1]), (50, [1e200] * 6), (100, [1e-200] * 6), (300, [-0.5] * 6), (4, [5e-324] * 6)]
    df = spark.createDataFrame([(i, v, -1, -2.0) for i, v in rows], "vec_id bigint, embedding array<double>, q bigint, score double").repartition(5)
    got = {}
    for q, rank, i, s in ann.neighbours(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(q, []).append((rank, i, round(s, 9)))
    distinct = sorted({(i, tuple(v)) for i, v in rows})

    def turned(v):
        v = np.array(v) / np.abs(v).max()
        return v / math.sqrt((v * v).sum())

    expected = {}
    for q, v in distinct:
        if q % 50 == 0:
            cos = sorted((-round(float(turned(v) @ turned(w)), 9), i) for i, w in distinct if len(w) == len(v) and (i, w) != (q, v))
            expected.setdefault(q, []).extend((n + 1, i, -c) for n, (c, i) in enumerate(cos[:5]))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in expected.items()}


def test_queries_are_not_copied_to_cells(spark, monkeypatch):
    """All rows query many cells that prune nothing, in several sweeps: what is written stays near the queries times the tasks."""
    monkeypatch.setattr(ann, "CELL", 8)
    monkeypatch.setattr(ann, "ASKED", 100 * 8 * 24, raising=False)
    r = np.random.Generator(np.random.PCG64(6))
    v = r.standard_normal((600, 24))
    v[300:310] = v[299]
    v[400:420] = v[399] * np.arange(2, 22)[:, None]  # as near as each other, but not equal
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(3)
    written = []
    saved = ann.saved
    monkeypatch.setattr(ann, "saved", lambda x: written.append(saved(x)) or written[-1])
    got = {}
    for q, rank, i, s in ann.neighbours(df, df).collect():
        got.setdefault(q, []).append((rank, i, s))
    rows = [t.count() for t in written if t.columns == ["q", "id", "mark", "score"]]
    assert sum(rows) <= 6 * 600 * (1 + 4)  # 4 shuffle partitions, so at most 4 tasks a sweep
    cos = v @ v.T / np.outer(*[np.sqrt((v * v).sum(axis=1))] * 2)
    np.fill_diagonal(cos, -9)
    hits = 0
    for q in range(600):
        found = sorted(got[q])
        best = np.lexsort((np.arange(600), -cos[q].round(12)))[:5]
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(cos[q, i] - s) < 1e-12 for _, i, s in found)
        hits += len({f[1] for f in found} & set(best.tolist()))
    assert hits / 3000 >= 0.9
    assert [f[1] for f in sorted(got[305])] == [299, 300, 301, 302, 303]


# -- 2 ---------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(x) if not i % 2 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            out += [(kind, m.start(), m.end())] if ok else []
    return out


def test_pii(spark):
    r = random.Random(4)
    bits = ["a@b.co", "x_y@z.com_q@r.org", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "é🎉", " ", "\n", "-", "..", "@", "5", "@a.b", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789", "00012.0.0.1"]
    texts = ["".join(r.choices(bits, k=r.randrange(1, 12))) for _ in range(300)]
    texts += [None, "", "1 " * 20_000, "a.b" * 20_000, "+" * 999, "1.1." * 3000, "a@b" + ".c" * 20_000, "x@y.z " * 700]
    got = {r["doc_id"]: r["pii"] for r in pii.find_pii(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i] if s["kind"] in BASE] == base_spans(t), t[:80]
    kinds = {s["kind"] for x in got.values() for s in x}
    assert kinds >= {"iban", "ssn"}
    alone = pii.find_pii(docs_of(spark, ["call 123-45-6789", "social security 123-45-6789", "account GB82WEST12345698765432", "GB82WEST12345698765433"])).collect()
    assert {r["doc_id"]: [s["kind"] for s in r["pii"]] for r in alone} == {0: [], 1: ["ssn"], 2: ["iban"], 3: []}
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(docs_of(spark, [*texts, "no data here"])).collect()}
    assert masked[len(texts)] == "no data here" and masked[texts.index(None)] is None
    assert not any(base_spans(t) for t in masked.values())


def test_masks_what_is_found(spark):
    """The pipeline's stage masks each span of find_pii, by its score with context, also where spans overlap."""
    import corpus_pipeline

    texts = ["é social security 123-45-6789 .", "call 123-45-6789", "mail security@x.org 123-45-6789", "account GB82 WEST 1234 5698 7654 32 then 4111 1111 1111 1111", "+123.45.67.8 55 123 é", None]
    docs = docs_of(spark, texts)
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.pii_stage(spark, docs, SF).collect()}
    assert [masked[i] for i in range(3)] == ["é social security <SSN> .", "call 123-45-6789", "mail <EMAIL> <SSN>"] and masked[5] is None
    for r in pii.find_pii(docs).collect():
        for s in r["pii"]:
            assert r["text"][s["start"] : s["end"]] not in masked[r["doc_id"]]
    assert masked[3] == "account <IBAN> then <CARD>" and masked[4] == "<PHONE> é"


# -- 3 ---------------------------------------------------------------------------


def test_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weights = quality.train(docs, labels)
    out = quality.score(docs, weights).join(labels, "doc_id").select("doc_id", "score", "quality").collect()
    kept = [(r["score"], r["quality"]) for r in out]
    clean = np.mean([s for s, y in kept if y == 1])
    junk = np.mean([s for s, y in kept if y == 0])
    assert clean > junk + 0.1 and np.mean([s >= quality.THRESHOLD for s, y in kept if y == 1]) > 0.97
    odd = docs_of(spark, [None, "", "word", "a b " * 50_000])
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, weights).collect())
    assert (quality.train(docs, labels.limit(0)) == 0).all()
    assert np.array_equal(weights, quality.train(docs.repartition(5), labels))


def slow_ftrl(rows, order):
    """Follow-the-regularised-leader one coordinate at a time; rows are ({feature: value}, label)."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for k in order:
        x, y = rows[k]
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
            n[i] += g * g
    return {i: weight(i) for i in z}


def test_learner_against_a_slow_one():
    texts = [(prose(20, i), i % 2) for i in range(30)] + [("", 1), ("word", 0)]
    rows = [(dict(zip(*(x.tolist() for x in quality.features(t, 12)), strict=True)), y) for t, y in texts]
    order = [i for epoch in range(2) for i in np.random.Generator(np.random.PCG64(epoch)).permutation(len(rows))]
    expected, got = slow_ftrl(rows, order), quality.fit(texts, bits=12, epochs=2)
    assert all(abs(got[i] - expected.get(i, 0.0)) < 1e-4 for i in range(1 << 12)) and np.abs(got).max() > 0.05


def test_held_out_labels_are_ranked(spark):
    """Area under the curve on labels that the query didn't learn from, and its other columns."""
    sf = SF.replace("0.001", "0.01")
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect())
    rows = quality.op3_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) in (0, 1)]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert len(good) > 10 and len(bad) > 3
    assert np.mean([a > b for a in good for b in bad]) > 0.95


# -- 4 ---------------------------------------------------------------------------


def generalised_jaccard(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    top = sum(max(x[w], y[w]) for w in x | y)
    return sum(min(x[w], y[w]) for w in x | y) / top if top else 1.0


def test_fingerprints(spark):
    texts = [prose(80, i) for i in range(40)]
    texts = [t for t in texts for t in (t, t[: len(t) * (1 + len(t) % 3) // 4] + prose(40, len(t)))]
    texts += ["", None, "   "]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:] + texts[:1], strict=True))], "doc_id bigint, a string, b string")
    made = cws.sketch(df, {"fa": "a", "fb": "b"}, samples=64)
    got = {r["doc_id"]: r for r in made.withColumn("s", cws.likeness(F.col("fa"), F.col("fb"), 64)).collect()}
    errors = [got[i]["s"] - generalised_jaccard(a or "", b or "") for i, (a, b) in enumerate(zip(texts, texts[1:] + texts[:1], strict=True))]
    assert abs(np.mean(errors)) < 0.04 and np.abs(errors).max() < 0.3
    assert all(got[i]["fb"] == got[(i + 1) % len(texts)]["fa"] for i in got)


def test_fingerprint_query(spark, tmp_path):
    """All columns of the query, with ids that repeat or are missing, repeated rows, empty texts and a long one."""
    r = random.Random(8)
    texts = [prose(r.randrange(0, 30), i) for i in range(60)] + [None, "", prose(20_000, 1)] + [prose(9, i) for i in range(90)] + ["same"] * 5
    ids = r.sample(range(-(10**6), 10**6), 63) + [77] * 60 + [None] * 30 + [5] * 5
    docs_of(spark, texts, ids).write.parquet(str(tmp_path / "documents.parquet"))
    got = cws.op4_document_fingerprints(spark, str(tmp_path)).collect()
    tie = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((i is not None, i or 0, tie[t or ""], t or "") for i, t in zip(ids, texts, strict=True)))
    prints = {(x["doc_id"], x["n_chars"], x["edited_sha256"]): x for x in got}
    by_text, expected = {}, []
    for (has, i, _, t), (_, _, _, u) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 4
        digest = hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()
        expected.append((i if has else None, len(t), digest))
        x = prints[expected[-1]]
        assert by_text.setdefault(t, x["fingerprint"]) == x["fingerprint"]
    assert Counter(expected) == Counter((x["doc_id"], x["n_chars"], x["edited_sha256"]) for x in got)

    def alike(a, b):
        return sum(a[8 * n : 8 * n + 8] == b[8 * n : 8 * n + 8] for n in range(cws.SAMPLES)) / cws.SAMPLES

    near = Counter()
    for (has, i, _, t), (_, _, _, u) in zip(order, order[1:] + order[:1], strict=True):
        near[(i if has else None, by_text[t], alike(by_text[t], by_text[u]))] += 1
    assert near == Counter((x["doc_id"], x["fingerprint"], x["near_next"]) for x in got)
    assert all(x["near_edited"] == alike(x["fingerprint"], x["edited_fingerprint"]) for x in got)
    assert len({f for t, f in by_text.items() if t}) > 100 and by_text[""] == cws.EMPTY * cws.SAMPLES
    assert cws.fingerprints(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_equal_texts_get_equal_prints(spark):
    """A text's print doesn't depend on the text beside it: terms that both have equally often are sampled once."""
    texts = [prose(60, i) for i in range(20)]
    df = spark.createDataFrame([(i, a, b) for i, a in enumerate(texts) for b in (a, texts[0], a + " an", "")], "i bigint, a string, b string")
    made = cws.sketch(df.withColumn("k", F.monotonically_increasing_id()), {"fa": "a", "fb": "b"}, samples=8)
    prints = {}
    for x in made.collect():
        assert prints.setdefault(x["i"], x["fa"]) == x["fa"]
    alone = cws.sketch(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "i bigint, a string, b string"), {"fa": "b", "fb": "a"}, samples=8)
    assert {x["i"]: x["fb"] for x in alone.collect()} == prints


# -- 5 ---------------------------------------------------------------------------


def simple_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(len(w) - k + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tau", [4, 7])
def test_simhash(spark, tau):
    texts = [prose(30 + i % 5, i) for i in range(60)]
    texts += [t + " xy" for t in texts[:30]] + [t.replace("an", "or", 1) for t in texts[:30]] + texts[:5] + [None, "", "a", "A b"]
    fps = [simple_fingerprint(t, 4) for t in texts]
    assert fps == [simhash.fingerprint(t or "", 4) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= tau and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_classes(docs_of(spark, texts), shingle=4, tau=tau).collect()}
    assert got == dict(enumerate(label))


def test_pigeonring_finds_every_link(spark):
    """Random pairs at each distance up to tau are linked, none beyond."""
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(300)]
    near = [x ^ sum(1 << b for b in r.sample(range(64), i % 7)) for i, x in enumerate(base)]
    signed = [x - (1 << 64) if x >> 63 else x for x in {*base, *near}]
    links = simhash.linked_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 4).collect()
    found = {frozenset((a % 2**64, b % 2**64)) for a, b in links}
    assert found == {frozenset((x, y)) for x, y in zip(base, near, strict=True) if 0 < (x ^ y).bit_count() <= 4}


def near_duplicates(texts, shingle=5, share=0.8):
    """{id: least id of its class} by comparing all texts."""
    sets = {}
    for i, t in texts.items():
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[k : k + shingle]) for k in range(max(len(ws) - shingle + 1, 1))} if ws else set()
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(sorted(texts), 2):
        x, y = sets[i], sets[j]
        if x == y or len(x & y) >= share * len(x | y):
            i, j = sorted((root(i), root(j)))
            label[j] = i
    return {i: root(i) for i in texts}


def edited(text, n, r):
    words = text.split()
    for at in r.sample(range(len(words)), n):
        words[at] = f"new{r.getrandbits(30)}"
    return " ".join(words)


def test_near_classes(spark):
    """Texts at all similarities, with a hub of many near copies, against all pairs."""
    r = random.Random(3)
    base = [" ".join(f"w{r.getrandbits(14)}" for _ in range(120 + i)) for i in range(60)]
    texts = base + [edited(t, 1 + i % 6, r) for i, t in enumerate(base)]
    texts += [edited(base[0], 1, r) for _ in range(150)] + base[:9] + [base[3].upper(), None, "", " ", "one two", "One  two", "one"]
    r.shuffle(texts)
    got = {x["doc_id"]: x["component_id"] for x in rings.near_classes(docs_of(spark, texts)).collect()}
    assert got == near_duplicates(dict(enumerate(texts)))


def test_large_buckets_stay_linked(spark):
    """A spanning forest of a bucket connects what all its pairs connect."""
    r = np.random.default_rng(4)
    tags = np.repeat(r.integers(0, 256, (6, rings.BOXES), np.uint8), 30, axis=0)
    tags[np.arange(180), r.integers(2, rings.BOXES, 180)] ^= 1

    def classes(edges):
        label = list(range(len(tags)))
        for _ in tags:
            for x, y in edges:
                label[x] = label[y] = min(label[x], label[y])
        return label

    forest = rings._span(tags, 0, rings.TAU)
    assert len(forest) == 174 and classes(forest.tolist()) == classes(rings._pairs(tags, 0).tolist())


def test_a_large_bucket_sends_one_forest():
    """Links at all distances: the nearest that connect the rings, one less than the rings of each class."""
    r = np.random.default_rng(7)
    tags = np.repeat(r.integers(0, 256, (5, rings.BOXES), np.uint8), 60, axis=0)
    for row in tags:
        row[r.integers(2, rings.BOXES, r.integers(0, 6))] ^= r.integers(1, 256, dtype=np.uint8)
    columns = [np.zeros(300, np.int64), np.arange(300), np.zeros(300, np.int32), *np.ascontiguousarray(tags).view("<i8").T]
    batch = pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "node", "start", "t0", "t1", "t2"])
    sent = [x for b in rings._linked(iter([batch])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]

    def classes(edges):
        label = list(range(300))
        for _ in range(300):
            before = list(label)
            for x, y in edges:
                label[x] = label[y] = min(label[x], label[y])
            if label == before:
                return label

    links = [(a, b) for a, b, start in sent if start < 0]
    assert classes(links) == classes(rings._pairs(tags, 0).tolist())
    assert len(links) == 300 - len(set(classes(links))) and len(sent) == len(links) + 300


def test_large_buckets_lose_no_link(spark):
    """160 texts of one template, each alike to one other only: most forest edges are refused."""
    r = random.Random(9)
    template, used, texts = [f"w{i}" for i in range(454)], [], []
    while len(used) < 160:
        slots = r.sample(range(4, 450, 5), 11)  # words whose shingles don't overlap: 3 changed in both texts, 4 in either
        both = {*slots[:7]}, {*slots[:3], *slots[7:]}
        if all(len(x & y) < 4 for x in both for y in used):
            used += both
            for own in (slots[3:7], slots[7:]):
                ws = list(template)
                for at in slots[:3]:
                    ws[at] = f"c{len(used)}"
                for at in own:
                    ws[at] = f"o{r.getrandbits(40)}"
                texts.append(" ".join(ws))
    r.shuffle(texts)
    got = {x["doc_id"]: x["component_id"] for x in rings.near_classes(docs_of(spark, texts)).collect()}
    expected = near_duplicates(dict(enumerate(texts)))
    assert len(set(expected.values())) == 80 and got == expected


@pytest.mark.parametrize(("seed", "words", "block"), [(1, 120, 4 << 20), (2, 120, 8 << 10), (3, 100, 20 << 10)])
def test_variants_without_their_base(spark, monkeypatch, seed, words, block):
    """300 variants of one text with two words replaced in each, whose similarities lie on both sides of 0.8, in one and in many blocks."""
    monkeypatch.setattr(rings, "BLOCK", block)
    r = random.Random(seed)
    base = " ".join(f"w{r.getrandbits(20)}" for _ in range(words))
    texts = [edited(base, 2, r) for _ in range(300)] + [None, "  ", "one"]
    expected = near_duplicates(dict(enumerate(texts)))
    assert len(set(expected.values())) > 10
    assert {x["doc_id"]: x["component_id"] for x in rings.near_classes(docs_of(spark, texts)).collect()} == expected


def test_deduplicate(spark):
    texts = [prose(50, 1)] * 3 + [prose(50, 2), None, "", prose(50, 3)]
    kept = rings.deduplicate(docs_of(spark, texts, [5, 4, 5, 7, 8, 9, None]))
    assert sorted(((r["doc_id"], r["lang"]) for r in kept.collect()), key=str) == sorted([(4, "en"), (7, "en"), (8, "en"), (None, "en")], key=str)
    assert kept.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    assert rings.deduplicate(docs_of(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [100, 4, 2])
@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_segments_in_batches_of_any_size(size, bucket):
    """An anchor's segments may fill whole batches; what is kept of it doesn't change the outcome."""
    r = np.random.default_rng(2)
    core, s1, s2 = np.sort(r.integers(0, 4, 50)), r.integers(0, 9, 50), r.integers(0, 2, 50)
    order = np.lexsort((s2, s1, core))
    columns = [core, s1[order], s2[order], np.arange(50), np.arange(50), *(np.full(50, 9, np.int32) for _ in range(4)), np.ones(50, np.int32)]
    names = ["core", "s1", "s2", "tk", "th", "p", "lo", "hi", "last", "times"]
    whole = pa.record_batch([pa.array(c) for c in columns], names)
    parts = [whole.slice(i, size) for i in range(0, 50, size)]

    def rows(batches):
        return sorted(tuple(x.values()) for b in suffix._sorted_out(bucket)(iter(batches)) for x in b.to_pylist())

    def key(i):
        return int(columns[0][i]), int(columns[1][i]), int(columns[2][i])

    times, different = Counter(map(key, range(50))), Counter(c for c, _, _ in set(map(key, range(50))))
    got = rows(parts)
    assert {x[2] for x in got if x[0] == 0} == {i for i in range(50) if times[key(i)] > 1}
    assert {x[2] for x in got if x[0] in (1, 3)} >= {i for i in range(50) if times[key(i)] == 1 and different[key(i)[0]] > 1}
    for x in got:
        if x[0] and different[x[1]] <= bucket - (size < 50):
            assert x[0] < 3
        if x[0] and different[x[1]] > bucket + 1:
            assert x[0] > 2
    if bucket == 100:
        assert got == rows([whole])


# -- 6 ---------------------------------------------------------------------------


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r[0]: r[1] for r in docs.collect()} | {10_001: None, 10_002: "", 10_003: "ZZZunseen zzzUNSEEN"}
    rows = docs.unionByName(spark.createDataFrame([(i, texts[i]) for i in (10_001, 10_002, 10_003)], "doc_id bigint, text string"))
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = maxent.score_texts(rows, head=1500).collect()
    assert len(got) == len(texts)
    ours = theirs = 0
    for r in got:
        ws = tokens[r["doc_id"]]
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(ws) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        if r["held_out"]:
            ours, theirs = ours + r["score"], theirs + r["base_score"]
    assert ours > theirs
    assert maxent.score_texts(docs.limit(0)).count() == 0


def test_model_is_a_distribution():
    """Classes, and words within them, sum to one in any context."""
    counts = np.sort(np.random.Generator(np.random.PCG64(1)).integers(2, 999, 5000))[::-1]
    model = maxent.Model([b"w%d" % i for i in range(5000)], counts, int(counts.sum()) + 500, 5500)
    r = np.random.Generator(np.random.PCG64(2))
    weights = tuple(r.normal(0, 0.5, w.shape).astype(np.float32) for w in maxent.zeros())
    features = np.repeat(maxent.context_features(model.context[:4]), maxent.VOCABULARY + 1, axis=0)
    p = np.exp(maxent.log_probabilities(model, weights, features, np.arange(maxent.VOCABULARY + 1)))
    assert abs(p.sum() - 1) < 1e-3


@pytest.mark.parametrize("distinct", [1, 3, 60, 4000])
def test_sums_of_rows(distinct):
    r = np.random.default_rng(distinct)
    g, rows = r.normal(size=(500, 16)).astype(np.float32), r.integers(0, distinct, (4, 500)).astype(np.uint16)
    want = np.zeros((distinct, 16))
    for f in range(4):
        np.add.at(want, rows[f], g)
    to, total = maxent._row_sums(g, rows)
    assert to.tolist() == sorted(set(rows.ravel().tolist()))
    assert np.allclose(total, want[to], atol=1e-3)


def test_exponentials_of_any_size():
    """Ordinary logarithms aren't shifted, which takes a pass over all; those beyond the range of a float32 are."""
    r = np.random.default_rng(2)
    bias, rows = r.normal(size=(50, 16)).astype(np.float32), r.integers(0, 9, (4, 50)).astype(np.uint16)
    for scale in (1, 30, 300, 3000):
        weights = (scale * r.normal(size=(9, 16))).astype(np.float32)
        z, sums = maxent._softmax(bias, weights, rows)
        logs = bias.astype(float) + weights.astype(float)[rows].sum(axis=0)
        most = logs.max(axis=1, keepdims=True)
        want = np.exp(logs - most) / np.exp(logs - most).sum(axis=1, keepdims=True)
        assert np.isfinite(z).all() and np.isfinite(sums).all() and (sums > 0).all()
        assert np.allclose(z / sums[:, None], want, rtol=0.02, atol=1e-6)
        assert scale > 1 or np.allclose(z, np.exp(logs), rtol=1e-4)


def test_update_lowers_the_loss():
    """A step moves against the gradient, which is taken by differences here."""
    model = maxent.Model([b"w%d" % i for i in range(50)], np.arange(150, 100, -1), 7000, 60)
    r = np.random.Generator(np.random.PCG64(3))
    features = r.integers(0, 1 << 63, (40, 4), np.uint64)
    targets = r.integers(0, 50, 40)
    weights, squares = maxent.zeros(), maxent.zeros()
    before = maxent.log_probabilities(model, weights, features, targets).sum()
    maxent.update(model, weights, squares, features, targets)
    for level, at, _, rows, _ in maxent._walk(model, features, targets):
        row, child, step = rows[0, 0], 5, 1e-2
        moved = tuple(w.copy() for w in maxent.zeros())
        moved[level][row, child] += step
        slope = (maxent.log_probabilities(model, moved, features, targets).sum() - before) / step
        if abs(slope) > 1e-2:
            assert np.sign(weights[level][row, child]) == np.sign(slope)
            assert abs(squares[level][row, child] - slope**2) < 0.05 * slope**2 + 1e-3
    assert maxent.log_probabilities(model, weights, features, targets).sum() > before


def test_update_in_chunks(monkeypatch):
    """Rows updated a few at a time become what one plain AdaGrad step over all positions makes of them."""
    monkeypatch.setattr(maxent, "_CHUNK", 7)
    model = maxent.Model([b"w%d" % i for i in range(50)], np.arange(150, 100, -1), 7000, 60)
    r = np.random.Generator(np.random.PCG64(4))
    features, targets = r.integers(0, 1 << 63, (90, 4), np.uint64)[r.integers(0, 40, 90)], r.integers(0, 50, 90)
    weights, squares = ([r.normal(0, 0.2, w.shape).astype(np.float32) ** k for w in maxent.zeros()] for k in (1, 2))
    want = [(w.astype(float), s.astype(float)) for w, s in zip(weights, squares, strict=True)]
    for level, at, _, rows, child in maxent._walk(model, features, targets):
        parent = targets[at] // maxent.BRANCH ** (maxent.LEVELS - 1 - level) // maxent.BRANCH
        logs = model.biases[level][parent] + want[level][0][rows].sum(axis=0)
        g = np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True)
        g[np.arange(len(at)), child] -= 1
        sums = np.zeros_like(want[level][0])
        for row in rows:
            np.add.at(sums, row, g)
        want[level][1][:] += sums**2
        want[level][0][:] -= maxent.RATE * sums / np.sqrt(want[level][1] + 1e-3)
    maxent.update(model, weights, squares, features, targets)
    for (w, s), weight, square in zip(want, weights, squares, strict=True):
        assert np.allclose(weight, w, rtol=1e-4, atol=1e-5) and np.allclose(square, s, rtol=1e-4, atol=1e-5)


def test_most_frequent_words(spark):
    """The words by count, ties by word, wherever the head ends."""
    r = random.Random(8)
    words = [(bytes([r.randrange(256), i % 256, i // 256]), r.choice([1, 1, 1, 2, 2, 3, 7, 9])) for i in range(400)]
    counts = spark.createDataFrame(words, "word binary, n bigint").repartition(5)
    want = sorted(words, key=lambda x: (-x[1], x[0]))
    for head in (0, 1, 30, 399, 400, 1000):
        assert maxent.most_frequent(counts, head) == want[:head]
    assert maxent.most_frequent(counts.limit(0), 5) == []


class Held:
    """A broadcast of a value in this process."""

    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("part", [1 << 20, 20])
def test_shards_train_on_every_position(monkeypatch, part):
    """Each position of each text is learned once, also of the shortest and of long texts in parts."""
    monkeypatch.setattr(maxent, "_PART", part)
    monkeypatch.setattr(maxent, "BATCH", 64)
    r = random.Random(6)
    texts = ["", "one", "one two", *(" ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(3, 160))) for _ in range(50))]
    counts = Counter(w for t in texts for ws in maxent.word_parts(t) for w in ws).most_common()
    assert sum(n for _, n in counts) == sum(len(t.split()) + 1 for t in texts)
    model = maxent.Model([w for w, _ in counts], np.array([n for _, n in counts]), sum(n for _, n in counts), len(counts))
    learnt, seen = Counter(), []

    def update(model, weights, squares, features, targets):
        learnt.update(targets.tolist())
        seen.append(features)

    monkeypatch.setattr(maxent, "update", update)
    shards = sorted(i % 3 for i in range(len(texts)))
    batches = [pa.record_batch([pa.array(shards[i : i + 7], pa.int32()), pa.array(texts[i : i + 7])], ["s", "t"]) for i in range(0, len(texts), 7)]
    list(maxent._trained(Held(model), Held(maxent.zeros()))(iter(batches)))
    assert learnt == Counter({i: n for i, (_, n) in enumerate(counts)})
    # Features carry over from part to part.
    whole = Counter()
    for t in texts:
        line = np.concatenate([np.array([1, 2, 3], np.uint64), [zlib.crc32(w) for w in [*t.encode().split(), maxent.END]]]).astype(np.uint64)
        whole.update(map(tuple, maxent.context_features(line).tolist()))
    assert whole == Counter(map(tuple, np.concatenate(seen).tolist()))


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(docs.limit(2))
    one, five = (sorted(map(tuple, maxent.score_texts(docs.repartition(n), head=900).collect())) for n in (1, 5))
    for x, y in zip(one, five, strict=True):
        assert x[:5] == y[:5] and math.isclose(x[5], y[5], rel_tol=1e-9) and math.isclose(x[6], y[6], rel_tol=1e-6)


# -- 7 ---------------------------------------------------------------------------


def test_plan_fills_bins():
    r = random.Random(2)
    for _ in range(30):
        sizes = Counter(r.choice([r.randrange(1, 100), r.randrange(1, 30), 100]) for _ in range(r.randrange(0, 400)))
        made = packing.plan(sizes, 100)
        held = Counter()
        for bins, count in made:
            assert sum(bins) <= 100 and count > 0 and sum(s > 100 / 3 for s in bins) <= 2
            for s in bins:
                held[s] += count
        assert held == Counter({k: n for k, n in sizes.items() if n})
        least = -(-sum(s * n for s, n in sizes.items()) // 100)
        assert sum(c for _, c in made) <= max(least * 1.25 + 1, sum(n for s, n in sizes.items() if s > 50) + least)


def test_packing(spark, monkeypatch):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [prose(random.Random(i).choice([3, 20, 60, 300]), i) for i in range(80)] + [None, "", "x", "a <|endoftext|> b", prose(20, 1), prose(20, 1)]
    rows = packing.pack_documents(docs_of(spark, texts), capacity=128, ids=True).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    bins = {}
    for i, t in enumerate(texts):
        ids = slow.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(got[i], key=lambda r: r["piece"])
        assert [x for p in parts for x in p["ids"]] == ids
        assert all(p["length"] == 128 for p in parts[1:]) and parts[0]["length"] <= 128
        assert [p["start"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts)])[:-1].tolist()
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
            bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist() and sum(n for _, n in held) <= 128
    total = sum(r["length"] for r in rows)
    assert len(bins) <= 1.05 * total / 128 + 1
    assert packing.pack_documents(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_packing_repeated_rows_keep_their_ids(spark):
    docs = docs_of(spark, ["a b", "a b", "a b", None], [1, 1, None, None])
    rows = packing.pack_documents(docs, ids=True).collect()
    assert sorted((str(r["doc_id"]), len(r["ids"]) == r["length"]) for r in rows) == [("1", True), ("1", True), ("None", True), ("None", True)]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4


def test_names_that_exist_are_refused(spark):
    docs = docs_of(spark, ["a"])
    for make in (
        lambda: pii.find_pii(docs, name="Lang"), lambda: quality.score(docs, np.zeros(2, np.float32), name="source"), lambda: pieces.encode_texts(docs, name="text"),
        lambda: pieces.decode_ids(docs, "lang", name="TEXT"), lambda: packing.pack(packing.tokenize(docs).withColumn("offset", F.lit(1))),
    ):
        with pytest.raises(ValueError, match="exist already"):
            make()


def test_empty_tables_and_extra_columns(spark, tmp_path):
    """Queries on no documents, and on rows with columns named like the operators' own."""
    docs_of(spark, []).write.parquet(str(tmp_path / "none/documents.parquet"))
    odd = docs_of(spark, ["a b c", None, "", "a b c"], [1, 2, None, 1])
    for name in ("node", "tk", "score", "ids", "pii", "length", "h", "key", "a", "b", "row"):
        odd = odd.withColumn(name, F.lit("x"))
    odd.write.parquet(str(tmp_path / "odd/documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "none/labels.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "odd/labels.parquet"))
    for query in (pii.op2_pii, quality.op3_quality_classifier, cws.op4_document_fingerprints, simhash.op5_simhash_near_dedup, maxent.op6_lm_scoring, packing.op7_best_fit_packing, pieces.op8_sentencepiece, suffix.op9_suffix_array_dedup):
        assert query(spark, str(tmp_path / "none")).count() == 0
        assert Counter(r["doc_id"] for r in query(spark, str(tmp_path / "odd")).collect()) == {1: 2, 2: 1, None: 1}


# -- 8 ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(pieces.Vocabulary.load(pieces.default_vocabulary()))


def best_pieces(coder, text):
    v = coder.vocabulary
    known = {p: i for i, p in enumerate(v.pieces) if i > 2 and i not in set(v.bytes_)}
    s = pieces.MARK + text.replace(" ", pieces.MARK)
    best, came = [0.0] + [-math.inf] * len(s), [None] * (len(s) + 1)
    for a in range(len(s)):
        for e in range(a + 1, min(len(s), a + 16) + 1):
            i = known.get(s[a:e])
            if i is not None and best[a] + v.scores[i] > best[e]:
                best[e], came[e] = best[a] + v.scores[i], (a, [i])
        if s[a] not in known and best[a] + v.unknown > best[a + 1]:
            best[a + 1], came[a + 1] = best[a] + v.unknown, (a, [v.bytes_[b] for b in s[a].encode()])
    out, n = [], len(s)
    while n:
        n, ids = came[n]
        out = ids + out
    return out


def test_pieces(spark, coder):
    r = random.Random(6)
    kinds = [lambda: r.randrange(32, 127), lambda: r.randrange(0xA0, 0x250), lambda: 32, lambda: r.randrange(0x4E00, 0x9FFF), lambda: r.randrange(0x1F300, 0x1F600), lambda: 10]
    texts = ["".join(chr(r.choice(kinds)()) for _ in range(r.randrange(1, 30))) for _ in range(60)] + ["x" * 300 + " y", "  a   b "]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode_many(texts)] == [best_pieces(coder, t) for t in texts]
    assert coder.segment(texts[0].encode()) == coder.segment_many([texts[0].encode()])[0]
    texts += ["", None, " ", f"{pieces.MARK}a{pieces.MARK}", "\0\r\n\t"]
    out = pieces.decode_ids(pieces.encode_texts(docs_of(spark, texts))).collect()
    assert all(x["decoded"] == (x["text"] or "") for x in out)


def message(*fields):
    """A protocol buffer of (number, value): bytes, text, floats and small ints."""
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
        elif isinstance(value, int):
            out += bytes([number << 3, value])
        else:
            value = value.encode() if isinstance(value, str) else value
            size, n = b"", len(value)
            while n >= 128:
                size, n = size + bytes([n & 127 | 128]), n >> 7
            out += bytes([number << 3 | 2]) + size + bytes([n]) + value
    return out


def test_pieces_agree_with_the_library(tmp_path):
    """A unigram model of given log scores, coded by the sentencepiece library and here."""
    import sentencepiece

    r = random.Random(4)
    names = {"".join(r.choices("abcé", k=r.randrange(1, 6))) for _ in range(150)} | set("abcé")
    names |= {pieces.MARK + x for x in r.sample(sorted(names), 60)} | {pieces.MARK}
    made = [("<unk>", 0.0, 2), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((x, -r.uniform(1, 12) - len(x) * 0.37, 1) for x in sorted(names))]
    body = [(1, message((1, x), (2, score), (3, kind))) for x, score, kind in made]
    # A unigram model (field 3) with byte fallback (field 35) and no normalisation.
    model = message(*body, (2, message((3, 1)) + b"\x98\x02\x01"), (3, message((1, "identity"), (3, 1), (4, 0), (5, 1))))
    path = tmp_path / "unigram.model"
    path.write_bytes(model)
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    coder = pieces.Coder(pieces.Vocabulary.load(str(path)))
    texts = ["".join(r.choices("abcé  ", k=r.randrange(1, 40))) for _ in range(300)] + ["a ü b", "漢字 a"]
    for t in texts:
        own, theirs = np.frombuffer(coder.encode(t), "<u4").tolist(), library.encode(t)
        assert own == theirs, (t, coder.vocabulary.unknown)
        assert coder.decode(own) == t


# -- 9 ---------------------------------------------------------------------------


def removed(texts, width):
    data = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - width + 1):
            if times[b[i : i + width]] > 1:
                gone[i : i + width] = 1
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((kept, int(gone.sum()), int(((gone[1:] == 0) & (gone[:-1] == 1)).sum())))
    return out


@pytest.mark.parametrize(("width", "gram", "bucket"), [(40, 8, 1 << 15), (40, 8, 3), (20, 6, 1 << 15)])
def test_repeats(spark, width, gram, bucket):
    r = random.Random(width + bucket)
    shared = [prose(r.randrange(10, 60), i) for i in range(10)]
    texts = []
    for i in range(120):
        parts = [(lambda p, a: p[a : r.randrange(a, len(p))])(p := r.choice(shared), r.randrange(len(p) // 2)) if r.random() < 0.4 else prose(r.randrange(1, 30), 1000 * i + k) for k in range(r.randrange(6))]
        texts.append("".join(parts))
    texts += [texts[5]] * 4 + [None, "", "a" * 300, "ab" * 90, "é" * 80]
    out = suffix.remove_repeats(docs_of(spark, texts), width=width, gram=gram, bucket=bucket).collect()
    got = {x["doc_id"]: (bytes(x["__kept"]), x["__removed"], x["__runs"]) for x in out}
    assert [got[i] for i in range(len(texts))] == removed(texts, width)


def test_repeats_query(spark, tmp_path):
    """All columns of the query, with a text longer than a block, repeated rows, and a passage that stands astride two blocks."""
    r = random.Random(12)
    passage = prose(90, 3)
    long = "".join(chr(r.choice([97, 98, 32, 233, 0x4E2D])) for _ in range(suffix.BLOCK_BYTES))
    cut = len(long[: suffix.BLOCK_BYTES // 2])
    texts = [long[:cut] + passage + long[cut:] + passage, "x" + passage, passage[5:], None, "", "short", prose(60, 5), prose(60, 5), "ab" * 400, "z" * 199, "z" * 199]
    docs_of(spark, texts, [9, 8, 7, 6, 5, 4, 3, 3, None, 1, 0]).write.parquet(str(tmp_path / "documents.parquet"))
    got = suffix.op9_suffix_array_dedup(spark, str(tmp_path)).collect()
    expected = [(i, len((t or "").encode()), gone, runs, hashlib.sha256(kept).hexdigest()) for i, t, (kept, gone, runs) in zip([9, 8, 7, 6, 5, 4, 3, 3, None, 1, 0], texts, removed(texts, 200), strict=True)]
    assert Counter(tuple(x[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for x in got) == Counter(expected)
    assert suffix.remove_repeats(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_colliding_hashes_are_replaced(monkeypatch):
    """Hashes under which all strings of a length are equal change nothing."""
    r = random.Random(3)
    contexts, q = [], []
    for _ in range(60):
        left, right = "".join(r.choices("ab", k=r.randrange(6))), "".join(r.choices("ab", k=r.randrange(12, 20)))
        contexts.append(f"{left}##{right}".encode())
        q.append(len(left))
    good = suffix.repeated_windows(contexts, np.array(q), np.zeros(60, np.int64), 12)
    made = suffix._roller

    def weak(seed):
        roller = suffix.Rolling(seed, 64)
        if seed < 4:
            roller.table = np.full(256, 3, np.uint64) + (np.arange(256, dtype=np.uint64) & np.uint64(seed - 2))
            roller.up, roller.down, roller.base, roller.back = np.ones(99, np.uint64), np.ones(99, np.uint64), np.uint64(1), np.uint64(1)
        return roller if seed < 4 else made(seed)

    monkeypatch.setattr(suffix, "_roller", weak)
    found = suffix.repeated_windows(contexts, np.array(q), np.zeros(60, np.int64), 12)
    assert [x.tolist() for x in found] == [x.tolist() for x in good] and len(found[0])
    times = Counter(c[i : i + 12] for c, at in zip(contexts, q, strict=True) for i in range(len(c) - 11) if i <= at)
    assert {(o, i) for o, i in zip(*(x.tolist() for x in found), strict=True)} == {(k, i) for k, (c, at) in enumerate(zip(contexts, q, strict=True)) for i in range(min(at, len(c) - 12) + 1) if times[c[i : i + 12]] > 1}


def test_blocks_of_contexts_without_a_repeat():
    """A block whose windows all occur once gives no span, whatever other blocks give."""
    names, kinds = zip(*suffix._CONTEXTS, strict=True)

    def batch(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    once = [(1, 7, i, i, 10 * i, 2, bytes([97 + i] * 12)) for i in range(5)]
    twice = [(1, 8, i, i, 10 * i, 2, b"abcdefghijkl" + bytes([97 + i])) for i in range(2)]
    solve = suffix._bucket_sort(12)
    rows = lambda batches: sorted(tuple(r.values()) for b in solve(iter(batches)) for r in b.to_pylist())
    assert rows([]) == rows([batch(once)]) == rows([batch(once[:1])]) == []
    assert rows([batch([(2, 8, i, i, 0, 2, b"abcdefghijkl") for i in range(2)])]) == []
    assert rows([batch(once + twice)]) == rows([batch(once), batch(twice)]) == [(0, 0, 0, 12), (1, 1, 10, 22)]


def test_a_batch_of_many_contexts_is_solved_in_blocks(monkeypatch):
    """A batch that holds several blocks is cut at anchors; an anchor larger than a block stays whole."""
    names, kinds = zip(*suffix._CONTEXTS, strict=True)
    cores = sorted([k // 5 for k in range(200)] + [20] * 45)
    r = random.Random(7)
    rows = [(1, core, i, i, 10 * i, 2, bytes(r.choices(b"ab", k=14))) for i, core in enumerate(cores)]
    batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))
    solved, solve = [], suffix.repeated_windows
    monkeypatch.setattr(suffix, "repeated_windows", lambda contexts, *a: (solved.append(len(contexts)), solve(contexts, *a))[1])

    def spans(block):
        monkeypatch.setattr(suffix, "BLOCK_CONTEXTS", block)
        solved.clear()
        return sorted(tuple(x.values()) for b in suffix._bucket_sort(8)(iter([batch])) for x in b.to_pylist())

    whole = spans(1000)
    assert whole and solved == [245]
    assert spans(16) == whole and sum(solved) == 245
    assert sorted(solved)[-1] == 50 and sorted(solved)[-2] <= 16


def test_hashes_of_contexts_take_few_bytes():
    """Arrays of 8 bytes for each byte of the contexts are made once, not for each step of the hash."""
    r = np.random.Generator(np.random.PCG64(4))
    contexts = [x.tobytes() for x in r.integers(97, 123, (4000, 400), np.uint8)]
    contexts[1] = contexts[0]
    group = np.repeat(np.arange(500), 8)
    tracemalloc.start()
    try:
        owner, _ = suffix.repeated_windows(contexts, np.full(4000, 100), group, 200)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert owner.tolist() == [0] * 101 + [1] * 101
    assert most < 24 * sum(map(len, contexts))


def test_repeats_are_dropped_by_one_python_function(spark):
    """The texts go to Python once for the cut; code points cut in two go as a whole, missing texts stay missing."""
    passage = "é" * 30
    docs = docs_of(spark, ["a" + passage, passage + "b", None, "", "c" * 15])
    out = suffix.without_repeats(docs, width=21, gram=8)
    assert out.columns == docs.columns
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {x["doc_id"]: x["text"] for x in out.collect()} == {0: "a", 1: "b", 2: None, 3: "", 4: "c" * 15}


def test_suffix_sort_orders_suffixes():
    data = np.frombuffer(prose(300, 1).encode(), np.uint8)
    at = np.sort(np.random.Generator(np.random.PCG64(1)).choice(len(data), 200, replace=False)).astype(np.int64)
    s = suffix.Suffixes(data, at, np.full(200, len(data)), np.zeros(200, np.int64), 10**6, 5)
    text = data.tobytes()
    assert s.sort().tolist() == sorted(range(200), key=lambda i: text[at[i] :])


# -- 10 --------------------------------------------------------------------------


def test_chat_against_sql(spark, duck):
    got = chat.op10_chat_formatting(spark, SF)
    made = duck.execute(chat.ORACLE["op10_chat_formatting"])
    names = [d[0] for d in made.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(made.fetchall())


def test_chat_windows(spark):
    r = random.Random(3)
    odd = ["</s>", "[INST]", "\\", "[\\", "<<SYS>>", "é", "\n", "x" * 50, "[ROLE]", "[/TEXT]"]
    talks = {}
    for i in range(30):
        roles = (["system"] if i % 3 else []) + ["user", "assistant", "tool", "user", "assistant"] * r.randrange(0, 9)
        talks[i] = [(role, "".join(r.choices(odd, k=r.randrange(0, 9)))) for role in roles] or [("system", "only")]
    rows = [(i, k, role, text, "extra") for i, turns in talks.items() for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame([*rows, (99, 0, None, None, "x"), (None, None, "user", "hi", "x")], "conv_id bigint, turn bigint, role string, text string, window string").repartition(4)
    windows = chat.format_chats(df, budget=120, history=30)
    back = {}
    for w in chat.read_chats(windows).collect():
        back.setdefault(w["conv_id"], []).append((w["window"], w["turns"], w["losses"]))
    for i, turns in talks.items():
        parts = sorted(back[i])
        assert [(t["role"], t["text"]) for _, ts, _ in parts for t in ts] == turns
        assert [x for _, _, ls in parts for x in ls] == [t for role, t in turns if role == "assistant"]
    assert [(t["role"], t["text"]) for t in back[99][0][1]] == [("", "")] and back[None][0][1][0]["text"] == "hi"
    for w in windows.filter("window > 0 and conv_id % 3 != 0").collect():
        assert w["formatted"].startswith("<<SYS>>") and w["fresh"] > 0
