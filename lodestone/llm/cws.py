"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text is a weighted set: its words, weighted by how often they occur. Each of
the samples draws, for a word, gamma variables r and c of shape 2 and a uniform
b, all from hashes of word and sample; with weight w, t = floor(ln w / r + b)
and ln a = ln c - r (t - b + 1). The word of least a, with its t, is the sample. Two
texts agree in a sample with the probability of their generalised Jaccard
similarity, so the share of equal samples estimates it.

A sample is kept as 32 bits of hash. Nulls are empty texts; texts without a
word have the fingerprint of EMPTY samples, alike only to each other. Rows order
by id, missing ones first, then by a hash of the text; repeated rows follow each
other. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import let, saved, whole

SAMPLES = 32
#: Quantiles that one aggregation finds, as a multiple of their number.
_ACCURACY = 100
EMPTY = "00000000"
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def _sample(term: Column, log_weight: Column, k: int) -> Column:
    """Order and identity of one term in sample k: ln a as the upper 31 bits, a mark of (term, t) as the lower 32.

    The mark is made of those bits of the term's hash that hardly bear on r, so
    being least leaves them uniform.
    """
    h, g = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    part = lambda x, shift, bits: (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")) + 0.5) / float(1 << bits)
    mask = lambda x, m: x.bitwiseAND(F.lit(m).cast("bigint"))
    r = -F.ln(part(h, 0, 32) * part(h, 32, 32))
    c = -F.ln(part(g, 0, 24) * part(g, 24, 24))
    b = part(g, 48, 16)
    t = F.floor(log_weight / r + b)
    log_a = F.ln(c) - r * (t - b + 1.0)
    rank = F.floor((log_a + 128.0) * float(1 << 23)).cast("bigint")
    own = mask(h, 0xFFFF).bitwiseOR(mask(F.shiftrightunsigned(h, 16), 0xFFFF0000))
    return F.shiftleft(rank, 32).bitwiseOR(own.bitwiseXOR(mask(t.cast("bigint"), 0xFFFFFFFF)))


def _hashes(text: Column, tag: int) -> Column:
    """Hashes of a text's words, the lowest bit replaced by the tag."""
    words = F.filter(F.split(F.lower(text), _SPACE), lambda w: w != "")
    clear = F.lit(-2).cast("bigint")
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(clear).bitwiseOR(F.lit(tag).cast("bigint")))


def _runs(hashes: Column) -> Column:
    """(value, times) of the runs of a sorted array."""

    def starts(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - 1)
        return F.filter(at, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

    def lengths(s: Column, at: Column) -> Column:
        ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s)))
        return F.zip_with(at, ends, lambda a, b: F.struct(F.get(s, a).alias("value"), (b - a).alias("times")))

    none = F.array().cast("array<struct<value:bigint,times:int>>")
    return let(F.sort_array(hashes), lambda s: F.when(F.size(s) == 0, none).otherwise(let(starts(s), lambda at: lengths(s, at))))


def _terms(hashes: Column) -> Column:
    """(term, times, texts) of tagged hashes: texts has bit 1 for the first text, bit 2 for the second.

    A term that both texts have equally often is one entry, so that it is sampled once.
    """

    def marked(runs: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            tag = r["value"].bitwiseAND(F.lit(1).cast("bigint"))
            other = F.get(runs, F.when(tag == 0, i + 1).otherwise(i - 1))
            same = F.coalesce((F.shiftright(other["value"], 1) == F.shiftright(r["value"], 1)) & (other["times"] == r["times"]), F.lit(False))
            texts = F.when(tag == 0, F.when(same, 3).otherwise(1)).otherwise(F.when(same, 0).otherwise(2))
            return F.struct(F.shiftright(r["value"], 1).alias("term"), r["times"].alias("times"), texts.alias("texts"))

        return F.filter(F.transform(runs, one), lambda r: r["texts"] != 0)

    return let(_runs(hashes), marked)


def sketch(docs: DataFrame, texts: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """docs' columns but for the texts, with a fingerprint string for each entry {result: text column}, two at most.

    The other columns must tell the rows apart. A row's words are exploded and
    aggregated in the same task where docs are dealt by some of these; else what
    is shuffled is one row of 8 bytes per sample for each text.
    """
    names, kept = list(texts), [c for c in docs.columns if c not in texts.values()]
    tagged = [_hashes(whole(texts[n]), i) for i, n in enumerate(names)]
    terms = docs.select(*kept, F.explode_outer(_terms(F.concat(*tagged))).alias("__r"))
    weight = F.ln(F.col("__r.times").cast("double"))
    terms = terms.select(*kept, F.col("__r.texts").alias("__in"), F.col("__r.term").alias("__term"), weight.alias("__w"))
    # One minimum for each set of texts that a term can be in: a row evaluates a sample once,
    # in a method of its own, which the JVM compiles.
    mins = []
    for k in range(samples):
        x = _sample(F.col("__term"), F.col("__w"), k)
        mins += [F.min(F.when(F.col("__in") == i, x)).alias(f"__s{i}_{k}") for i in (1, 2, 3)]
    # All columns are keys: strings among the aggregates would make this a sort aggregation.
    out = terms.groupBy(*kept).agg(*mins)
    least = lambda i, k: F.least(F.col(f"__s{i + 1}_{k}"), F.col(f"__s3_{k}"))
    hexed = lambda c: F.coalesce(F.lower(F.right(F.lpad(F.hex(c), 16, "0"), F.lit(8))), F.lit(EMPTY))
    return out.select(*kept, *(F.concat(*(hexed(least(i, k)) for k in range(samples))).alias(n) for i, n in enumerate(names)))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints."""
    part = lambda x, k: F.substring(x, 8 * k + 1, 8)
    same = sum((F.when(part(a, k) == part(b, k), 1).otherwise(0) for k in range(1, samples)), F.when(part(a, 0) == part(b, 0), 1).otherwise(0))
    return same / float(samples)


def _nums(xs: list[int]) -> Column:
    """An array of longs as one literal, however many: both functions are folded."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>") if xs else F.array().cast("array<bigint>")


def _bounds(df: DataFrame, key: str, high: int, low: int) -> list[int]:
    """About high * low approximate quantiles of the key, found in two aggregations of bounded state."""
    shares = lambda n: [i / n for i in range(1, n)]
    first = df.select(F.percentile_approx(key, shares(high), _ACCURACY * high)).first()[0] if high > 1 else []
    first = sorted(set(first or []))
    if low < 2:
        return first
    part = F.size(F.filter(_nums(first), lambda b: b < F.col(key)))
    inner = df.filter(F.col(key).isNotNull()).groupBy(part.alias("p")).agg(F.percentile_approx(key, shares(low), _ACCURACY * low).alias("q")).collect()
    return sorted(first + [x for r in inner for x in r["q"]])


def with_bucket(df: DataFrame, key: str, tie: str) -> DataFrame:
    """df with __bucket, which rises with (key, tie): about as many buckets as a bucket has rows.

    Bounds that coincide tell of a key with many rows. These, and rows without a
    key, are cut by the tie, a uniform hash.
    """
    rows, missing = df.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
    total = max(1, math.ceil(math.sqrt(rows)))
    level = math.ceil(math.sqrt(total))
    bounds = Counter(_bounds(df.select(key), key, level, level))
    cuts, often = sorted(bounds), {x: n for x, n in sorted(bounds.items()) if n > 2}
    width = max(1, math.ceil(math.sqrt(len(cuts))))
    id_, at = F.col(key), F.lit(0)
    if cuts:
        below = lambda xs: F.size(F.filter(xs, lambda b: b < id_))
        high = below(_nums(cuts[width - 1 :: width]))
        at = let(high * width, lambda n: n + below(F.slice(_nums(cuts), n + 1, F.lit(width))))
    parts = F.when(id_.isNull(), missing // total + 1).otherwise(1)
    if often:
        heavy = F.map_from_arrays(_nums(list(often)), _nums(list(often.values())))
        parts = F.when(id_.isNull(), parts).otherwise(F.coalesce(F.element_at(heavy, id_), F.lit(1).cast("bigint")))
    share = F.least(F.floor((F.col(tie) / float(1 << 64) + 0.5) * parts), parts - 1).cast("bigint")
    # Of the ids up to a bound that has many rows, these come last, in buckets of their own.
    order = F.when(id_.isNull(), -1).otherwise(at * 2 + (parts > 1).cast("int")).cast("bigint")
    return df.withColumn("__bucket", F.shiftleft(order, 32) + share)


def with_next(df: DataFrame, key: list[str], wanted: dict[str, str], bucket: str = "__bucket", place: str | None = None) -> DataFrame:
    """df with columns of the next row by key: {result: column}; after the last row comes the first.

    place names a column for the row's number in its bucket. Rows are windows within a bucket; only the first row of each bucket goes to
    the bucket before it, so nothing gathers but one row per bucket.
    """
    w = Window.partitionBy(bucket).orderBy(*(F.col(k).asc_nulls_first() for k in key))
    inner = df.withColumns({f"__in_{new}": F.lead(old).over(w) for new, old in wanted.items()} | {"__last": F.lead(F.lit(1)).over(w).isNull()} | ({place: F.row_number().over(w)} if place else {}))
    least = F.struct(*(x for k in key for x in (F.col(k).isNotNull().alias(f"has_{k}"), F.col(k))))
    firsts = df.groupBy(bucket).agg(F.min_by(F.struct(*wanted.values()), least).alias("__f"))
    across = Window.orderBy(bucket)
    edge = firsts.select(F.col(bucket).alias("__b"), F.coalesce(F.lead("__f").over(across), F.first("__f").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__n"))
    joined = inner.join(edge, F.col(bucket) == F.col("__b"))
    made = {new: F.when(F.col("__last"), F.col("__n")[old]).otherwise(F.col(f"__in_{new}")) for new, old in wanted.items()}
    return joined.select(*df.columns, *([place] if place else []), *(v.alias(k) for k, v in made.items()))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:  # noqa: A002
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text has its last quarter replaced by the start of the next row's
    text. Rows are told apart by their place in a bucket, which follows from
    (id, text) alone, so a task that is run again numbers them alike.
    """
    rows = docs.select(F.col(f"`{id}`").cast("bigint").alias("__id"), whole(f"`{text}`").alias("__text"))
    rows = with_bucket(rows.withColumn("__tie", F.xxhash64("__text")), "__id", "__tie")
    order = ["__id", "__tie", "__text"]
    chained = with_next(rows, order, {"__next": "__text"}, place="__place")
    n = F.char_length("__text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.left(F.col("__text"), n - cut), F.left(F.col("__next"), cut))
    # One column for what is only carried: code is generated for 100 columns at most, 96 of them minima.
    own = F.concat_ws(":", n.cast("string"), F.sha2(edited, 256), F.col("__id").cast("string"))
    both = chained.select("__bucket", "__place", own.alias("__own"), F.col("__text").alias("text"), edited.alias("edited"))
    made = saved(sketch(both, {"fingerprint": "text", "edited_fingerprint": "edited"}, samples))
    part = lambda i: F.get(F.split("__own", ":"), F.lit(i))
    out = with_next(made, ["__place"], {"__next": "fingerprint"})
    return out.select(
        part(2).cast("bigint").alias(id), part(0).cast("bigint").alias("n_chars"), part(1).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("__next"), samples).alias("near_next"),
    )


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike neighbours are."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
