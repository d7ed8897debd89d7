"""Times the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lodestone import (
    bind_rows, c, build_session, cumsum, dense_rank, desc, grepl, lag, lead, mean, n, nchar, rank,
    read_parquet, row_number, substr, sum_,
)

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def scenarios(spark):
    def t(name):
        return read_parquet(spark, f"{DIR}/{name}.parquet")

    line = t("lineitem")
    three = ("l_orderkey", "l_quantity", "l_extendedprice")
    supplier = t("supplier").select("s_suppkey", "s_name")
    long_key = line.mutate(k=c.l_suppkey)
    yield "b01_filter_select", lambda: line.filter(c.l_quantity > 45).select(*three)
    yield "b02_filter_select_broad", lambda: line.filter(c.l_quantity > 25).select(*three)
    yield "b03_wide_select", lambda: line.select(*three)
    yield "b04_group_summarise_1k", lambda: line.group_by("l_suppkey").summarise(s=sum_(c.l_quantity), m=mean(c.l_extendedprice), n=n())
    yield "b05_group_summarise_50k", lambda: line.group_by("l_orderkey").summarise(s=sum_(c.l_quantity), n=n())
    yield "b06_filter_group_summarise", lambda: line.filter(c.l_quantity > 25).group_by("l_suppkey").summarise(s=sum_(c.l_quantity), n=n())
    yield "b07_arrange_full", lambda: line.arrange("l_extendedprice").slice_head(10)
    yield "b08_slice_min_100", lambda: line.slice_min("l_extendedprice", 100)
    yield "b09_left_join_lookup", lambda: line.left_join(supplier, {"l_suppkey": "s_suppkey"})
    yield "b10_filter_join", lambda: line.filter(c.l_quantity > 25).left_join(supplier, {"l_suppkey": "s_suppkey"})
    yield "b11_inner_join_m2m", lambda: t("customer").inner_join(t("supplier"), {"c_nationkey": "s_nationkey"})
    yield "b12_join_long_string_key", lambda: t("orders").inner_join(t("customer").select("c_custkey", "c_name"), {"o_custkey": "c_custkey"}).inner_join(t("customer").select("c_name", "c_acctbal"), "c_name")
    yield "b13_window_grouped", lambda: line.group_by("l_suppkey").mutate(rn=row_number(), cs=cumsum("l_quantity"))
    yield "b14_window_lag_lead", lambda: line.mutate(a=lag("l_quantity"), b=lead("l_quantity"))
    yield "b15_bind_rows_filter", lambda: bind_rows(line, line).filter(c.l_quantity > 25)
    yield "b16_mutate_arithmetic", lambda: long_key.mutate(v=(c.l_quantity + c.l_extendedprice) * c.l_tax - c.l_discount / (c.l_quantity + 1.0))
    yield "b17_nested_agg_expr", lambda: line.group_by("l_suppkey").summarise(s=sum_(c.l_extendedprice * (1 - c.l_discount)), m=mean(c.l_quantity * c.l_tax))
    yield "b18_string_nchar_substr", lambda: t("documents").transmute(a=nchar(c.text), b=substr(c.text, 1, 10))
    yield "b19_string_grepl_filter", lambda: t("documents").filter(grepl("the", c.text))
    yield "b20_rank_dense_rank", lambda: line.mutate(a=rank("l_extendedprice"), b=dense_rank("l_extendedprice"))
    yield "arrange_desc", lambda: line.arrange(desc("l_extendedprice"))


def main() -> None:
    spark = build_session(f"local[{CPUS}]", "bench", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    read_parquet(spark, f"{DIR}/lineitem.parquet").summarise(n=n()).to_df().collect()
    times = {}
    for name, make in scenarios(spark):
        began = time.perf_counter()
        make().to_df().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    began = time.perf_counter()
    read_parquet(spark, f"{DIR}/lineitem.parquet").to_df().write.mode("overwrite").parquet("/tmp/lodestone-bench")
    times["b00_write"] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
