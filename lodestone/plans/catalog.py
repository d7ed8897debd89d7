"""One query for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

import os
import tempfile
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.functions import (
    across,
    c,
    contains,
    cummax,
    cummean,
    cummin,
    cumsum,
    dense_rank,
    desc,
    grepl,
    is_na,
    lag,
    lead,
    lit,
    max_,
    mean,
    min_,
    n,
    nchar,
    rank,
    row_number,
    starts_with,
    substr,
    sum_,
    where,
)
from lodestone.operators import bind_cols, bind_rows
from lodestone.plans.frame import Frame
from lodestone.sources import (
    read_blocks,
    read_csv,
    read_geotiff,
    read_parquet,
    read_sqlite,
    write_blocks,
    write_csv,
    write_geotiff,
    write_sqlite,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Registers f(tables, name) under its name, where t("orders") reads a table."""

    def register(f: Callable[[Callable[[str], Frame]], Frame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: read_parquet(spark, f"{sf_dir}/{name}.parquet")).to_df()

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _nulled(x: Frame) -> Frame:
    """lineitem with missing quantities where the line number is 3."""
    kept = x.mutate(q=c.l_quantity).filter(c.l_linenumber != 3)
    gone = x.filter(c.l_linenumber == 3).mutate(q=lit(None))
    return bind_rows(kept, gone)


_NULLED = "(SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS q FROM lineitem)"

# -- projection and filter ----------------------------------------------------


@_query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_quantity * 2) AS sum_qty2,
    min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, CAST(count(*) AS DOUBLE) AS n
    FROM lineitem WHERE l_quantity > 10 AND l_returnflag <> 'N' GROUP BY l_returnflag, l_linestatus""")
def flagship(t):
    x = t("lineitem").filter(c.l_quantity > 10, c.l_returnflag != "N").group_by("l_returnflag", "l_linestatus")
    return x.summarise(
        sum_qty=sum_(c.l_quantity), sum_qty2=sum_(c.l_quantity * 2),
        min_qty=min_(c.l_quantity), max_qty=max_(c.l_quantity), n=n(), groups="drop",
    )


@_query("SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'A'")
def filter_basic(t):
    return t("lineitem").filter(c.l_quantity > 45, c.l_returnflag == "A").select("l_orderkey", "l_quantity", "l_discount")


@_query(f"SELECT l_orderkey, q FROM {_NULLED} WHERE (q > 40 OR l_discount > 0.09) AND NOT (q < 10)")
def filter_three_valued(t):
    x = _nulled(t("lineitem"))
    return x.filter(((c.q > 40) | (c.l_discount > 0.09)) & ~(c.q < 10)).select("l_orderkey", "q")


@_query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def select_rename(t):
    return t("orders").select("o_orderkey", "o_totalprice").rename(id="o_orderkey", price="o_totalprice")


@_query("SELECT CAST(p_size AS BIGINT) AS p_size, p_retailprice, p_type FROM part")
def select_helpers(t):
    return t("part").select(where("int64"), starts_with("P_RETAIL"), contains("type")).select("-p_partkey")


@_query("SELECT o_totalprice, o_orderkey, o_custkey FROM orders")
def relocate(t):
    x = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return x.relocate("o_totalprice").relocate("o_orderkey", before="o_custkey")


@_query("""SELECT l_orderkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_quantity AS neg,
    (l_quantity + l_partkey) * 2.0 - l_suppkey / 4.0 AS mixed FROM lineitem""")
def mutate_arith(t):
    x = t("lineitem").mutate(
        charge=c.l_extendedprice * (1 - c.l_discount) * (1 + c.l_tax), neg=-c.l_quantity,
        mixed=(c.l_quantity + c.l_partkey) * 2.0 - c.l_suppkey / 4.0,
    )
    return x.select("l_orderkey", "charge", "neg", "mixed")


@_query("""SELECT l_orderkey, l_partkey // 7 AS by7, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE (-l_partkey) // (l_suppkey % 5) END AS by_col,
    CASE WHEN l_quantity = 10 THEN l_extendedprice / 0.0 ELSE l_extendedprice / (l_quantity - 10) END AS dbl FROM lineitem""")
def mutate_int_division(t):
    x = t("lineitem").mutate(by7=c.l_partkey / 7, by_col=-c.l_partkey / (c.l_suppkey % 5), dbl=c.l_extendedprice / (c.l_quantity - 10))
    return x.select("l_orderkey", "by7", "by_col", "dbl")


@_query("""SELECT l_orderkey, l_partkey % 7 AS r7, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE (-l_partkey) % (l_suppkey % 5) END AS r_col,
    (-l_quantity) % 4.0 AS r_dbl FROM lineitem""")
def mutate_mod(t):
    x = t("lineitem").mutate(r7=c.l_partkey % 7, r_col=-c.l_partkey % (c.l_suppkey % 5), r_dbl=-c.l_quantity % 4.0)
    return x.select("l_orderkey", "r7", "r_col", "r_dbl")


@_query("SELECT l_orderkey, l_quantity * 100 AS l_quantity, l_quantity + 1 AS y, (l_quantity + 1) * 2 AS z FROM lineitem")
def mutate_sequential(t):
    x = t("lineitem").mutate(l_quantity=c.l_quantity * 100, y=c.l_quantity + 1, z=c.y * 2)
    return x.select("l_orderkey", "l_quantity", "y", "z")


@_query(f"SELECT l_orderkey, q IS NULL AS gone, q + 1 AS q1 FROM {_NULLED}")
def mutate_is_na(t):
    return _nulled(t("lineitem")).transmute(l_orderkey=c.l_orderkey, gone=is_na(c.q), q1=c.q + 1)


@_query("SELECT o_totalprice / 2.0 AS half, o_orderkey + 1 AS next FROM orders")
def transmute(t):
    return t("orders").transmute(half=c.o_totalprice / 2.0, next=c.o_orderkey + 1)


@_query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS chars FROM documents")
def nchar_bytes(t):
    return t("documents").transmute(doc_id=c.doc_id, bytes=nchar(c.text), chars=nchar(c.text, chars=True))


@_query("""SELECT o_orderkey, substr(o_orderpriority, 1, 3) AS a, substr(o_orderpriority, 3, 4) AS b,
    CASE WHEN o_orderkey % 4 < 2 THEN '' ELSE substr(o_orderpriority, 2, CAST(o_orderkey % 4 AS INT) - 1) END AS c FROM orders""")
def substr_bounds(t):
    x = t("orders")
    return x.transmute(
        o_orderkey=c.o_orderkey, a=substr(c.o_orderpriority, 0, 3), b=substr(c.o_orderpriority, 3, 6),
        c=substr(c.o_orderpriority, 2, c.o_orderkey % 4),
    )


@_query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') AND NOT contains(p_name, 'red')")
def grepl_fixed(t):
    return t("part").filter(grepl("ring", c.p_name) & ~grepl("red", c.p_name)).select("p_partkey", "p_name")


# -- aggregation ----------------------------------------------------------------


@_query("""SELECT l_suppkey, sum(l_quantity) AS s, avg(l_quantity) AS m, CAST(count(*) AS DOUBLE) AS n,
    CAST(min(l_partkey) AS DOUBLE) AS lo, CAST(max(l_partkey) AS DOUBLE) AS hi FROM lineitem GROUP BY l_suppkey""")
def group_sum_mean_n(t):
    x = t("lineitem").group_by("l_suppkey")
    return x.summarise(s=sum_(c.l_quantity), m=mean(c.l_quantity), n=n(), lo=min_(c.l_partkey), hi=max_(c.l_partkey))


@_query(f"""SELECT l_suppkey, CASE WHEN bool_or(q IS NULL) THEN NULL ELSE sum(q) END AS s,
    CASE WHEN bool_or(q IS NULL) THEN NULL ELSE avg(q) END AS m, CASE WHEN bool_or(q IS NULL) THEN NULL ELSE min(q) END AS lo,
    CASE WHEN bool_or(q IS NULL) THEN NULL ELSE max(q) END AS hi FROM {_NULLED} GROUP BY l_suppkey""")
def agg_na_poison(t):
    x = _nulled(t("lineitem")).group_by("l_suppkey")
    return x.summarise(s=sum_(c.q), m=mean(c.q), lo=min_(c.q), hi=max_(c.q))


@_query(f"""SELECT l_suppkey, l_returnflag, coalesce(sum(q), 0) AS s, coalesce(avg(q), 'NaN'::DOUBLE) AS m,
    coalesce(min(q), 'Infinity'::DOUBLE) AS lo, coalesce(max(q), '-Infinity'::DOUBLE) AS hi
    FROM {_NULLED} GROUP BY l_suppkey, l_returnflag""")
def agg_na_rm(t):
    x = _nulled(t("lineitem")).group_by("l_suppkey", "l_returnflag")
    return x.summarise(s=sum_(c.q, na_rm=True), m=mean(c.q, na_rm=True), lo=min_(c.q, na_rm=True), hi=max_(c.q, na_rm=True), groups="drop")


@_query("""SELECT l_suppkey, 0.0::DOUBLE AS s, 'Infinity'::DOUBLE AS lo, '-Infinity'::DOUBLE AS hi
    FROM lineitem WHERE l_linenumber = 3 GROUP BY l_suppkey""")
def agg_all_na_identity(t):
    x = _nulled(t("lineitem")).filter(c.l_linenumber == 3).group_by("l_suppkey")
    return x.summarise(s=sum_(c.q, na_rm=True), lo=min_(c.q, na_rm=True), hi=max_(c.q, na_rm=True))


@_query("SELECT l_suppkey, sum(l_quantity + l_linenumber) AS s, avg(l_quantity * l_linenumber) AS m FROM lineitem GROUP BY l_suppkey")
def agg_nested_expr(t):
    x = t("lineitem").group_by("l_suppkey")
    return x.summarise(s=sum_(c.l_quantity + c.l_linenumber), m=mean(c.l_quantity * c.l_linenumber))


@_query("SELECT CAST(count(*) AS DOUBLE) AS n, sum(l_quantity) AS s FROM lineitem WHERE l_quantity > 1e9 HAVING count(*) > 0")
def agg_empty_input(t):
    return t("lineitem").filter(c.l_quantity > 1e9).summarise(n=n(), s=sum_(c.l_quantity))


@_query("""SELECT l_returnflag, sum(l_quantity) AS l_quantity_s, CAST(sum(l_linenumber) AS DOUBLE) AS l_linenumber_s,
    max(l_quantity) AS l_quantity_hi, CAST(max(l_linenumber) AS DOUBLE) AS l_linenumber_hi FROM lineitem GROUP BY l_returnflag""")
def across_summarise(t):
    x = t("lineitem").group_by("l_returnflag")
    return x.summarise(across(["l_quantity", "l_linenumber"], {"s": sum_, "hi": max_}))


@_query("SELECT o_orderkey, o_totalprice * 2 AS d_o_totalprice, o_custkey * 2 AS d_o_custkey FROM orders")
def across_mutate(t):
    x = t("orders").mutate(across(["o_totalprice", "o_custkey"], lambda x: x * 2, names="d_{col}"))
    return x.select("o_orderkey", "d_o_totalprice", "d_o_custkey")


@_query("SELECT l_returnflag, sum(l_quantity) AS qty FROM lineitem GROUP BY l_returnflag")
def count_wt(t):
    return t("lineitem").count("l_returnflag", wt=c.l_quantity, name="qty")


@_query("SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC NULLS FIRST")
def count_sort(t):
    return t("orders").count("o_orderpriority", sort=True)


@_query("SELECT l_linestatus, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_linestatus")
def tally(t):
    return t("lineitem").group_by("l_linestatus").tally()


@_query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_cols(t):
    return t("lineitem").distinct("l_returnflag", "l_linestatus")


@_query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def distinct_keep_all(t):
    x = t("orders").with_order("o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")
    return x.distinct("o_custkey", keep_all=True)


@_query("""SELECT o_orderpriority, k, v FROM (SELECT o_orderpriority, CAST(row_number() OVER w AS BIGINT) AS k, o_totalprice AS v FROM orders
    WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)) WHERE k <= 5""")
def reframe_sorted(t):
    def five(pdf):
        return pdf.sort_values(["o_totalprice", "o_orderkey"], ascending=[False, True]).head(5)

    def top(pdf):
        best = five(pdf)
        return {"k": range(1, len(best) + 1), "v": best["o_totalprice"].to_numpy()}

    x = t("orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return x.group_by("o_orderpriority").reframe(top, "k bigint, v double", partial=five)


# -- joins -------------------------------------------------------------------------

_BIG = "(SELECT * FROM orders WHERE o_totalprice > 200000)"
_ON = "c.c_custkey = o.o_custkey"


def _sides(t):
    left = t("customer").select("c_custkey", "c_name")
    right = t("orders").filter(c.o_totalprice > 200000).select("o_orderkey", "o_custkey")
    return left, right, {"c_custkey": "o_custkey"}


@_query(f"SELECT c_custkey, c_name, o_orderkey FROM customer c JOIN {_BIG} o ON {_ON}")
def inner_join(t):
    x, y, by = _sides(t)
    return x.inner_join(y, by)


@_query(f"SELECT c_custkey, c_name, o_orderkey FROM customer c LEFT JOIN {_BIG} o ON {_ON}")
def left_join(t):
    x, y, by = _sides(t)
    return x.left_join(y, by)


@_query(f"SELECT o_custkey AS c_custkey, c_name, o_orderkey FROM (SELECT c_custkey + 20 AS c_custkey, c_name FROM customer) c RIGHT JOIN {_BIG} o ON {_ON}")
def right_join(t):
    x, y, by = _sides(t)
    return x.mutate(c_custkey=c.c_custkey + 20).right_join(y, by)


@_query(f"""SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, o_orderkey
    FROM (SELECT c_custkey + 20 AS c_custkey, c_name FROM customer) c FULL JOIN {_BIG} o ON {_ON}""")
def full_join(t):
    x, y, by = _sides(t)
    return x.mutate(c_custkey=c.c_custkey + 20).full_join(y, by)


@_query(f"SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM {_BIG} o WHERE {_ON})")
def semi_join(t):
    x, y, by = _sides(t)
    return x.semi_join(y, by)


@_query(f"SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM {_BIG} o WHERE {_ON})")
def anti_join(t):
    x, y, by = _sides(t)
    return x.anti_join(y, by)


@_query("""SELECT k, a.name AS "name.c", b.name AS "name.s" FROM (SELECT c_custkey AS k, c_name AS name FROM customer) a
    JOIN (SELECT s_suppkey AS k, s_name AS name FROM supplier) b USING (k)""")
def join_suffix(t):
    x = t("customer").select(k="c_custkey", name="c_name")
    y = t("supplier").select(k="s_suppkey", name="s_name")
    return x.inner_join(y, "k", suffix=(".c", ".s"))


@_query("SELECT c_custkey, c_name, s_name FROM customer JOIN (SELECT CAST(s_suppkey AS DOUBLE) AS k, s_name FROM supplier) ON c_custkey = k")
def join_coerce(t):
    y = t("supplier").transmute(k=c.s_suppkey * 1.0, s_name=c.s_name)
    return t("customer").select("c_custkey", "c_name").inner_join(y, {"c_custkey": "k"})


@_query("SELECT CAST(c_nationkey AS BIGINT) AS nation, c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def join_m2m(t):
    x = t("customer").select("c_custkey", nation="c_nationkey").relocate("nation")
    return x.inner_join(t("supplier").select("s_suppkey", nation="s_nationkey"), "nation", many=True)


@_query("SELECT CAST(n_regionkey AS BIGINT) AS regionkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_natural(t):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        x = t("nation").select("n_name", regionkey="n_regionkey").relocate("regionkey")
        return x.inner_join(t("region").rename(regionkey="r_regionkey"))


# -- windows -------------------------------------------------------------------------


def _by_customer(t):
    return t("orders").with_order("o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice").group_by("o_custkey")


def _all_events(t):
    return t("events").with_order("event_id").select("event_id", "user_id", "value")


def _window(name: str, call, sql: str, grouped: bool) -> None:
    key, table = ("o_orderkey", "orders") if grouped else ("event_id", "events")
    part = "PARTITION BY o_custkey " if grouped else ""
    text = f"SELECT {key}, CAST({sql} AS DOUBLE) AS w FROM {table} WINDOW w AS ({part}ORDER BY {key}), f AS ({part}ORDER BY {key} ROWS UNBOUNDED PRECEDING)"
    text = text.replace("<p>", part)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def table_of(x: str) -> Frame:
            return read_parquet(spark, f"{sf_dir}/{x}.parquet")

        x = _by_customer(table_of) if grouped else _all_events(table_of)
        return x.mutate(w=call).select(key, "w").to_df()

    QUERIES[name], SQL[name] = run, text


_window("row_number", row_number(), "row_number() OVER w", True)
_window("rank", rank("o_totalprice"), "rank() OVER (<p>ORDER BY o_totalprice NULLS LAST)", True)
_window("dense_rank", dense_rank("o_totalprice"), "dense_rank() OVER (<p>ORDER BY o_totalprice NULLS LAST)", True)
_window("lag", lag("o_totalprice", 2, default=-1.0), "lag(o_totalprice, 2, -1) OVER w", True)
_window("lead", lead("o_totalprice"), "lead(o_totalprice) OVER w", True)
_window("cumsum", cumsum("o_orderkey"), "sum(o_orderkey) OVER f", True)
_window("cummean", cummean("o_orderkey"), "CAST(sum(o_orderkey) OVER f AS DOUBLE) / count(*) OVER f", True)
_window("cummin", cummin("o_totalprice"), "min(o_totalprice) OVER f", True)
_window("cummax", cummax("o_totalprice"), "max(o_totalprice) OVER f", True)
_window("row_number_all", row_number(), "row_number() OVER w", False)
_window("rank_all", rank("value"), "rank() OVER (ORDER BY value NULLS LAST)", False)
_window("dense_rank_all", dense_rank("user_id"), "dense_rank() OVER (ORDER BY user_id NULLS LAST)", False)
_window("lag_all", lag("value", 3), "lag(value, 3) OVER w", False)
_window("lead_all", lead("value", 1, default=0.0), "lead(value, 1, 0) OVER w", False)
_window("cumsum_all", cumsum("user_id"), "sum(user_id) OVER f", False)
_window("cummean_all", cummean("user_id"), "CAST(sum(user_id) OVER f AS DOUBLE) / count(*) OVER f", False)
_window("cummin_all", cummin("value"), "min(value) OVER f", False)
_window("cummax_all", cummax("value"), "max(value) OVER f", False)


@_query("""SELECT o_orderkey, CASE WHEN max(CAST(v IS NULL AS INT)) OVER f = 1 THEN NULL ELSE CAST(sum(v) OVER f AS DOUBLE) END AS w FROM
    (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS v FROM orders)
    WINDOW f AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def cumsum_poison(t):
    x = t("orders").select("o_orderkey", "o_custkey")
    gone = x.filter(c.o_orderkey % 5 == 0).mutate(v=lit(None))
    x = bind_rows(x.filter(c.o_orderkey % 5 != 0).mutate(v=c.o_orderkey), gone).with_order("o_orderkey")
    return x.group_by("o_custkey").mutate(w=cumsum("v")).select("o_orderkey", "w")


# -- order, slices, binding --------------------------------------------------------


@_query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority NULLS LAST, o_totalprice DESC NULLS FIRST, o_orderkey")
def arrange_multi(t):
    x = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return x.arrange("o_orderpriority", desc("o_totalprice"), "o_orderkey")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def slice_head(t):
    return t("orders").with_order("o_orderkey").slice_head(25).select("o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def slice_tail(t):
    return t("orders").with_order("o_orderkey").slice_tail(25).select("o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 100")
def slice_min(t):
    return t("orders").with_order("o_orderkey").slice_min("o_totalprice", 100).select("o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 100")
def slice_max(t):
    return t("orders").with_order("o_orderkey").slice_max("o_totalprice", 100).select("o_orderkey", "o_totalprice")


@_query("""SELECT CAST(c_custkey AS DOUBLE) AS k, c_name AS name FROM customer
    UNION ALL SELECT s_acctbal, s_name FROM supplier""")
def bind_rows_coerce(t):
    return bind_rows(t("customer").select(k="c_custkey", name="c_name"), t("supplier").select(k="s_acctbal", name="s_name"))


@_query("""SELECT 1::BIGINT AS src, c_custkey AS k, c_mktsegment AS seg FROM customer
    UNION ALL SELECT 2::BIGINT, s_suppkey, NULL FROM supplier""")
def bind_rows_id(t):
    return bind_rows(t("customer").select(k="c_custkey", seg="c_mktsegment"), t("supplier").select(k="s_suppkey"), id="src")


@_query("SELECT DISTINCT k FROM (SELECT c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def union_distinct(t):
    return bind_rows(t("customer").select(k="c_nationkey"), t("supplier").select(k="s_nationkey")).distinct()


@_query("""SELECT a.o_orderkey, b.price FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) a
    JOIN (SELECT o_totalprice AS price, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders) b USING (i)""")
def bind_cols_rows(t):
    x = t("orders").with_order("o_orderkey").select("o_orderkey")
    y = t("orders").with_order("o_orderkey").arrange("o_totalprice").select(price="o_totalprice")
    return bind_cols(x, y)


# -- formats: written, read again, compared by SQL with the table ------------------


def _roundtrip(name: str, sql: str, make, write, read) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "file")
        write(make(lambda x: read_parquet(spark, f"{sf_dir}/{x}.parquet")), path)
        return read(spark, path).to_df()

    QUERIES[name], SQL[name] = run, sql


def _customers(t):
    return t("customer").with_order("c_custkey").transmute(
        id=c.c_custkey, name=c.c_name, balance=c.c_acctbal, rich=c.c_acctbal > 5000,
    )


_CUSTOMERS = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, {} AS rich FROM customer"
_roundtrip("csv_roundtrip", _CUSTOMERS.format("c_acctbal > 5000"), _customers, write_csv, read_csv)
_roundtrip(
    "sqlite_roundtrip", _CUSTOMERS.format("CAST(c_acctbal > 5000 AS BIGINT)"), _customers,
    lambda f, p: write_sqlite(f, p, "t"), lambda s, p: read_sqlite(s, p, "t"),
)
_roundtrip("blocks_roundtrip", _CUSTOMERS.format("c_acctbal > 5000"), _customers, write_blocks, read_blocks)


def _grid(t):
    x = t("customer")
    return x.transmute(x=c.c_custkey % 10 * 2.0, y=c.c_custkey / 10 * 3.0, band1=c.c_acctbal, band2=c.c_custkey * 1.0)


_roundtrip(
    "geotiff_roundtrip",
    """SELECT x * 2.0::DOUBLE AS x, y * 3.0::DOUBLE AS y, c_acctbal AS band1, c_custkey::DOUBLE AS band2
    FROM (SELECT range AS x FROM range(0, 10)) CROSS JOIN
    (SELECT unnest(range(min(c_custkey) // 10, max(c_custkey) // 10 + 1)) AS y FROM customer)
    LEFT JOIN customer ON c_custkey = y * 10 + x""",
    _grid, lambda f, p: write_geotiff(f, p, compress=True), read_geotiff,
)
