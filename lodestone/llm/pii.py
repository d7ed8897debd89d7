"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

All of it is DataFrame functions. split() and regexp_extract_all() with one
pattern give the text between matches and the matches; prefix sums of their
lengths give the spans, in code points. Patterns have possessive repeats and
start at the edge of a run of their characters, which neither changes a match
nor lets a long run cost more than its length.

Kinds email, ip, card and phone are always reported when their check holds;
iban (mod 97) and ssn are added where their score with context reaches
ADDED_SCORE. Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free, let, prefix_sums, whole

ADDED_SCORE = 0.6
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _counted(m: Column, least: int, most: int) -> Column:
    return F.char_length(_digits(m)).between(least, most)


def luhn(m: Column) -> Column:
    """Does the number pass Luhn? From the right, every second digit counts double, less 9 if above 9."""

    def total(r: Column) -> Column:
        twice = F.translate(r, "0123456789", "0246813579")
        digit = lambda s, i: F.substr(s, i, F.lit(1)).cast("int")
        each = lambda acc, i: acc + F.when(i % 2 == 1, digit(r, i)).otherwise(digit(twice, i))
        return F.aggregate(F.sequence(F.lit(1), F.char_length(r)), F.lit(0), each)

    return let(F.reverse(_digits(m)), lambda r: total(r) % 10 == 0)


def mod97(m: Column) -> Column:
    """Is the account number's check 1? The first four characters go last, letters count from 10."""
    order = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def rest(s: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            v = F.instr(order, F.substr(s, i, F.lit(1))) - 1
            return (acc * F.when(v < 10, 10).otherwise(100) + v) % 97

        return F.aggregate(F.sequence(F.lit(1), F.char_length(s)), F.lit(0), step)

    plain = F.replace(m, F.lit(" "), F.lit(""))
    return let(plain, lambda p: let(F.concat(F.substr(p, F.lit(5)), F.left(p, F.lit(4))), rest) == 1)


@dataclass(frozen=True)
class Kind:
    """A pattern, a sign without which it can't match, a check, a prior score and context words."""

    name: str
    pattern: str
    sign: str | None
    check: Callable[[Column], Column]
    prior: float
    words: str
    base: bool = True


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda m: F.lit(True), 0.8, "mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".",
         lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, r"\bip\b|host|server|address"),
    Kind("card", r"[0-9](?:[ -]?+[0-9])++", None, lambda m: _counted(m, 13, 19) & luhn(m), 0.7, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", lambda m: _counted(m, 9, 15), 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", None,
         mod97, 0.6, "iban|account|bank|transfer", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-",
         lambda m: ~m.rlike("^(?:000|666|9..)|-00-|0000$"), 0.3, r"\bssn\b|social|security", base=False),
)

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _pieces(text: Column, kind: Kind, then: Callable[[Column, Column], Column], none: Column) -> Column:
    """then(matches, the text before each) of a text, or none if nothing matches."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    matches = F.when(text.contains(kind.sign), matches).otherwise(F.array().cast("array<string>")) if kind.sign else matches
    some = lambda ms: let(F.split(text, kind.pattern, -1), lambda ps: then(ms, ps))
    return let(matches, lambda ms: F.when(F.size(ms) == 0, none).otherwise(some(ms)))


def _spans(text: Column, kind: Kind) -> Column:
    def made(ms: Column, ps: Column) -> Column:
        first = F.slice(ps, F.lit(1), F.size(ms))
        lengths = F.zip_with(first, ms, lambda p, m: F.char_length(p) + F.char_length(m))

        def span(row: Column, i: Column) -> Column:
            m, p = row["m"], row["p"]
            near = F.lower(F.concat(F.right(p, F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(F.get(ps, i + 1), F.lit(CONTEXT_CHARS))))
            score = F.least(F.lit(kind.prior) + F.when(near.rlike(kind.words), CONTEXT_BONUS).otherwise(0.0), F.lit(1.0))
            start = row["at"] + F.char_length(p)
            return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.char_length(m)).alias("end"), score.alias("score"), kind.check(m).alias("ok"))

        rows = F.arrays_zip(prefix_sums(lengths).alias("at"), first.alias("p"), ms.alias("m"))
        found = F.filter(F.transform(rows, span), lambda s: s["ok"] if kind.base else s["ok"] & (s["score"] >= ADDED_SCORE))
        return F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))

    return _pieces(text, kind, made, F.array().cast(_SPAN))


def find_pii(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """docs with an array of (kind, start, end, score), by kind as in KINDS, then start.

    A column of that name is an error. Rows, also repeated ones, are looked at one
    by one; an empty table gives an empty result.
    """
    free(docs, name, "__pii_text")
    held = docs.withColumn("__pii_text", whole(text))
    made = F.concat(*(_spans(F.col("__pii_text"), k) for k in KINDS))
    return held.withColumn(name, made).drop("__pii_text")


def _masked(text: Column, kind: Kind) -> Column:
    def made(ms: Column, ps: Column) -> Column:
        tag = F.lit(f"<{kind.name.upper()}>")
        parts = F.zip_with(ps, ms, lambda p, m: F.concat(p, F.when(m.isNull(), "").when(kind.check(m), tag).otherwise(m)))
        return F.array_join(parts, "")

    return _pieces(text, kind, made, text)


def _without(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <KIND>; of spans that overlap the first gives the kind, and all are replaced."""
    order = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("tag"))
    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))
    between = lambda at, end: F.substr(text, (at + 1).cast("int"), (end - at).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        more = F.when(s["start"] >= acc["at"], F.array(between(acc["at"], s["start"]), s["tag"])).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(acc["out"], more).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    def done(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substr(text, (acc["at"] + 1).cast("int"), F.char_length(text)))

    return F.aggregate(F.array_sort(F.transform(spans, order)), begin, step, done)


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the spans of find_pii replaced by <KIND>, then what still matches, kind after kind; other texts, also nulls, stay as they are."""
    found = find_pii(docs, text, "__pii")
    out = found.withColumn(text, F.when(F.size("__pii") == 0, F.col(text)).otherwise(_without(whole(text), F.col("__pii")))).drop("__pii")
    for kind in KINDS:
        if kind.base or kind.prior >= ADDED_SCORE:
            out = out.withColumn(text, _masked(F.col(text), kind))
    return out


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in documents, as counts and digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).drop("text")
    write = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("bigint")
    base = [k.name for k in KINDS if k.base]
    first = F.filter("pii", lambda s: s["kind"].isin(*base))
    return found.select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in base),
        F.sha2(F.array_join(F.transform(first, write), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", write), ",").alias("spans"),
    )
