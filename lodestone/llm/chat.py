"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is its marks around the escaped text. Marks start with [ or <, and
escaping puts a backslash behind each of these in a text, so no mark occurs in
a text, and taking one backslash from behind each restores it.

Turns go to windows in order: a window takes turns while the prefix sum of
their tokens stays within the room that the budget leaves beside the system
turn and the repeated history; a longer turn is a window of its own. Every later
window repeats the system turn and, before its new turns, the latest ones whose
tokens fit in the history's share. Loss spans mark the assistant texts among
the new turns, so each counts once. A token is taken as four bytes.

Null texts and roles are empty; rows order by turn, then role and text; rows
without a conv_id are a conversation of their own. A conversation is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import let, prefix_sums

BUDGET = 1024
HISTORY = 256
BYTES_PER_TOKEN = 4
#: role: what stands before and after a text. Other roles are written out.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_ROLE = ("[ROLE]", "[/ROLE]", "[/TEXT]")
_TURN = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE\].*?\[/TEXT\]"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"([\[<])", r"$1\\")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"([\[<])\\", "$1")


def _pick(role: Column, at: int, other: Column) -> Column:
    out = F.when(role == "system", MARKS["system"][at])
    for name in ("user", "assistant"):
        out = out.when(role == name, MARKS[name][at])
    return out.otherwise(other)


def _turns(rows: Column) -> Column:
    """Per turn: role, head (mark), body (escaped), tail (mark), chars and tokens of all three."""

    def one(r: Column) -> Column:
        role, body = r["role"], escape(r["text"])
        head = _pick(role, 0, F.concat(F.lit(_ROLE[0]), escape(role), F.lit(_ROLE[1])))
        tail = _pick(role, 1, F.lit(_ROLE[2]))
        return F.struct(role.alias("role"), head.alias("head"), F.concat(head, body, tail).alias("all"), F.char_length(body).alias("body"))

    def sized(t: Column) -> Column:
        tokens = F.ceil(F.octet_length(t["all"]) / BYTES_PER_TOKEN).cast("int")
        return F.struct(t["role"].alias("role"), t["all"].alias("all"), F.char_length(t["head"]).alias("head"), t["body"].alias("body"), F.char_length(t["all"]).alias("chars"), tokens.alias("tokens"))

    return F.transform(F.transform(rows, one), sized)


def _starts(turns: Column, room: Column) -> Column:
    """The first turn of each window."""
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("i"))

    def step(acc: Column, t: Column) -> Column:
        new = (F.size(acc["starts"]) == 0) | (acc["used"] + t["tokens"] > room)
        return F.struct(
            F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(new, t["tokens"].cast("bigint")).otherwise(acc["used"] + t["tokens"]).alias("used"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(turns, zero, step, lambda acc: acc["starts"])


def _loss(turns: Column, at: Column) -> Column:
    """Spans of the assistant texts in rendered turns that start at code point `at`."""
    chars = F.transform(turns, lambda t: t["chars"])

    def spans(ts: Column, ps: Column) -> Column:
        zipped = F.zip_with(ts, ps, lambda t, p: F.struct(t["role"].alias("role"), (at + p + t["head"]).alias("start"), (at + p + t["head"] + t["body"]).alias("end")))
        return F.transform(F.filter(zipped, lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return let(prefix_sums(chars), lambda ps: spans(turns, ps))


def _window(system: Column, turns: Column, sums: Column, start: Column, stop: Column, history: int) -> Column:
    """(formatted, fresh: where its new turns start, loss) of the turns start to stop."""
    first = F.greatest(start - history, F.lit(0))
    back = F.size(F.filter(F.slice(sums, first + 1, start - first), lambda p: F.get(sums, start) - p <= history))
    text = lambda ts: F.array_join(F.transform(ts, lambda t: t["all"]), "")

    def made(old: Column, new: Column) -> Column:
        before = F.concat(text(F.when(start == 0, F.slice(system, 1, 0)).otherwise(system)), text(old))
        return let(before, lambda b: _row(b, new, start, system))

    def _row(b: Column, new: Column, start: Column, system: Column) -> Column:
        lead = F.when(start == 0, text(system)).otherwise(F.lit(""))
        at = (F.char_length(b) + F.char_length(lead)).cast("bigint")
        return F.struct(F.concat(b, lead, text(new)).alias("formatted"), F.char_length(b).alias("fresh"), _loss(new, at).alias("loss"))

    old, new = F.slice(turns, start - back + 1, back), F.slice(turns, start + 1, stop - start)
    return let(old, lambda o: let(new, lambda n: made(o, n)))


def format_chats(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, fresh, loss): loss spans are code points of formatted; new turns start at fresh."""
    empty = F.lit("")
    row = F.struct("turn", F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    held = held.select("conv_id", _turns(F.col("rows")).alias("turns"))

    def windows(system: Column, turns: Column) -> Column:
        used = F.aggregate(system, F.lit(0), lambda a, t: a + t["tokens"])
        sums = prefix_sums(F.transform(turns, lambda t: t["tokens"]))
        none = F.size(turns) == 0

        def each(starts: Column, ps: Column) -> Column:
            at = F.when(none, F.array(F.lit(0))).otherwise(starts)
            stops = F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(turns)))
            return F.zip_with(at, stops, lambda a, b: _window(system, turns, ps, a, b, history))

        return let(sums, lambda ps: let(_starts(turns, F.lit(budget - history) - used), lambda starts: each(starts, ps)))

    def split(turns: Column) -> Column:
        lead = F.when(F.get(turns, F.lit(0))["role"] == "system", 1).otherwise(0)
        return let(lead, lambda n: let(F.slice(turns, F.lit(1), n), lambda s: let(F.slice(turns, n + 1, F.size(turns)), lambda rest: windows(s, rest))))

    made = held.select("conv_id", F.posexplode(split(F.col("turns"))).alias("window", "w"))
    return made.select("conv_id", "window", "w.formatted", "w.fresh", "w.loss")


def read_chats(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, losses) from formatted windows: new turns as (role, text), and the texts under the loss."""

    def parse(t: Column) -> Column:
        inner = lambda head, tail: F.substr(t, F.lit(len(head) + 1), F.char_length(t) - len(head) - len(tail))
        role, body = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, (head, tail) in MARKS.items():
            role = F.coalesce(role, F.when(t.startswith(head), name))
            body = F.coalesce(body, F.when(t.startswith(head), inner(head, tail)))
        cut = F.instr(t, _ROLE[1])
        other = F.substr(t, F.lit(len(_ROLE[0]) + 1), cut - len(_ROLE[0]) - 1)
        rest = F.substr(t, cut + len(_ROLE[1]), F.char_length(t) - cut - len(_ROLE[1]) - len(_ROLE[2]) + 1)
        return F.struct(F.coalesce(role, unescape(other)).alias("role"), unescape(F.coalesce(body, rest)).alias("text"))

    fresh = F.substr("formatted", F.col("fresh") + 1, F.char_length("formatted"))
    turns = F.transform(F.regexp_extract_all(fresh, F.lit(_TURN), F.lit(0)), parse)
    span = lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return windows.select("conv_id", "window", turns.alias("turns"), F.transform("loss", span).alias("losses"), F.char_length("formatted").alias("chars"))


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back, as a digest."""
    own = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id bigint, turn bigint, role string, text string"))
    back = read_chats(format_chats(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = back.select("conv_id", F.struct("window", F.size("turns").alias("n"), said.alias("said"), F.array_join("losses", "").alias("loss"), "chars").alias("w"))
    per = per.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    total = lambda f: F.aggregate("ws", F.lit(0).cast("bigint"), lambda a, w: a + w[f])
    joined = lambda f: F.array_join(F.transform("ws", lambda w: w[f]), "")
    return per.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.char_length(joined("loss")).cast("bigint").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )


_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 END AS marks,
    length(regexp_replace(text, '[^\\[<]', '', 'g')) AS added,
    CASE WHEN role IN ('system', 'user', 'assistant') THEN 0 ELSE strlen(role) + length(regexp_replace(role, '[^\\[<]', '', 'g')) END AS name_bytes,
    CASE WHEN role IN ('system', 'user', 'assistant') THEN 0 ELSE length(role) + length(regexp_replace(role, '[^\\[<]', '', 'g')) END AS name_chars
  FROM rows_),
s AS (
  SELECT *, (k = 1 AND role = 'system') AS sys, marks + added + name_chars + length(text) AS chars,
    CAST(ceil((marks + added + name_bytes + strlen(text)) / {BYTES_PER_TOKEN}.0) AS BIGINT) AS tokens FROM t),
lead AS (SELECT conv_id, max(CASE WHEN sys THEN tokens ELSE 0 END) AS sys_tokens, max(CASE WHEN sys THEN chars ELSE 0 END) AS sys_chars FROM s GROUP BY conv_id),
u AS (
  SELECT s.*, sys_tokens, sys_chars, row_number() OVER (PARTITION BY s.conv_id ORDER BY k) AS i,
    coalesce(sum(tokens) OVER (PARTITION BY s.conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN lead USING (conv_id) WHERE NOT sys),
w AS (
  SELECT conv_id, i, tokens AS used, true AS opens FROM u WHERE i = 1
  UNION ALL
  SELECT u.conv_id, u.i, CASE WHEN w.used + u.tokens > {BUDGET - HISTORY} - u.sys_tokens THEN u.tokens ELSE w.used + u.tokens END,
    w.used + u.tokens > {BUDGET - HISTORY} - u.sys_tokens
  FROM w JOIN u ON u.conv_id = w.conv_id AND u.i = w.i + 1),
again AS (
  SELECT a.conv_id, sum(a.sys_chars + coalesce(b.chars, 0)) AS chars FROM
    (SELECT u.* FROM u JOIN w USING (conv_id, i) WHERE opens AND i > 1) a
    LEFT JOIN LATERAL (SELECT sum(h.chars) AS chars FROM u h WHERE h.conv_id = a.conv_id AND h.i < a.i AND a.before - h.before <= {HISTORY}) b ON true
  GROUP BY a.conv_id)
SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(s.chars) + coalesce(max(again.chars), 0) AS BIGINT) AS formatted_chars
FROM s LEFT JOIN again ON again.conv_id = s.conv_id GROUP BY s.conv_id
"""
ORACLE = {"op10_chat_formatting": _SQL}
