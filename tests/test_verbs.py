"""Contracts of the verbs on small tables: missing values, types, names, order, grouping."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone import (
    NA, across, all_of, any_of, bind_cols, bind_rows, c, contains, cols_between, cummax, cummean, cummin, cumsum,
    dense_rank, desc, ends_with, everything, from_pandas, grepl, is_na, lag, last_col, lead, lit, matches, max_, mean,
    min_, n, nchar, rank, row_number, starts_with, substr, sum_, where,
)
from lodestone.operators import aggregate, window
from lodestone.plans import catalog
from lodestone.types import LatticeError, common
from tests.conftest import SF


@pytest.fixture(scope="module")
def t(spark):
    def make(**columns):
        return from_pandas(spark, pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()}))

    return make


def values(frame, *names):
    rows = [tuple(r) for r in frame.select(*names or frame.columns).to_df().collect()]
    return [r[0] for r in rows] if len(rows and rows[0]) == 1 else rows


def test_filter_keeps_only_true(t):
    x = t(x=[1, None, 3, 4], y=[1.5, 2.5, None, 0.5])
    assert values(x.filter(c.x > 1), "x") == [3, 4]
    assert values(x.filter(~is_na(c.x), is_na(c.y)), "x") == [3]
    assert values(x.filter((c.x > 3) | (c.y > 2)), "y") == [2.5, 0.5]
    assert x.filter() is x
    assert values(x.filter(c.x > 99)) == []
    with pytest.raises(LatticeError):
        x.filter(c.x + 1)
    with pytest.raises(KeyError):
        x.filter(c.zz > 1)


def test_division_and_remainder(t):
    x = t(a=[7, -7, 5, None], b=[2, 2, 0, 1])
    assert values(x.transmute(q=c.a / c.b, r=c.a % c.b)) == [(3, 1), (-3, -1), (None, None), (None, None)]
    assert values(x.transmute(h=c.a / 2.0), "h") == [3.5, -3.5, 2.5, None]
    y = t(a=[1.0, -1.0, 0.0, -7.5], b=[0.0, 0.0, 0.0, 2.0])
    got = values(y.transmute(q=c.a / c.b, r=c.a % c.b))
    assert got[0][0] == math.inf and got[1][0] == -math.inf and math.isnan(got[2][0]) and got[3] == (-3.75, -1.5)
    assert all(math.isnan(g[1]) for g in got[:3])


def test_lattice(t):
    assert common("bool", "double") == "double"
    x = t(b=[True, False, None], i=[1, 2, 3], s=["a", "b", None])
    assert values(x.transmute(v=c.b + c.b), "v") == [2, 0, None]
    assert x.transmute(v=c.b + c.i).kinds == {"v": "int64"}
    with pytest.raises(LatticeError):
        x.filter(c.s == 1)
    with pytest.raises(LatticeError):
        x.mutate(v=c.s + 1)
    assert values(x.transmute(v=c.s == NA), "v") == [None] * 3


def test_strings(t):
    x = t(s=["hello", "é", "", None, "pineapple"], k=[2, 1, 1, 1, None])
    assert values(x.transmute(v=nchar(c.s)), "v") == [5, 2, 0, None, 9]
    assert values(x.transmute(v=nchar(c.s, chars=True)), "v") == [5, 1, 0, None, 9]
    assert values(x.transmute(v=substr(c.s, 0, 3)), "v") == ["hel", "é", "", None, "pin"]
    assert values(x.transmute(v=substr(c.s, 3, 2)), "v") == ["", "", "", None, ""]
    assert values(x.transmute(v=substr(c.s, c.k, 99)), "v") == ["ello", "é", "", None, None]
    assert values(x.filter(grepl("app", c.s)), "s") == ["pineapple"]
    assert values(x.transmute(v=grepl("", c.s)), "v") == [True, True, True, None, True]


def test_mutate_visibility(t):
    x = t(x=[1, 2], g=["a", "b"]).group_by("g")
    y = x.mutate(x=c.x * 100, y=c.x + 1, z=c.y * 2)
    assert y.groups == ("g",)
    assert values(y, "x", "y", "z") == [(100, 2, 4), (200, 3, 6)]
    assert y.columns == ["x", "g", "y", "z"]
    assert x.filter(c.x > 0).groups == ()


def test_selection(t):
    x = t(aa=[1], ab=["s"], ba=[1.5], zz=[True])
    assert x.select(starts_with("A")).columns == ["aa", "ab"]
    assert x.select(ends_with("a"), everything()).columns == ["aa", "ba", "ab", "zz"]
    assert x.select(-contains("a")).columns == ["zz"]
    assert x.select(matches("^.a$")).columns == ["aa", "ba"]
    assert x.select(last_col(), 1).columns == ["zz", "aa"]
    assert x.select(any_of(["nope", "ab"]), cols_between("ba", "zz")).columns == ["ab", "ba", "zz"]
    assert x.select(where("int64"), "-aa").columns == []
    assert x.relocate("zz", after="aa").columns == ["aa", "zz", "ab", "ba"]
    assert x.rename(q="ab").columns == ["aa", "q", "ba", "zz"]
    for bad in (lambda: x.select(all_of(["nope"])), lambda: x.rename(q="nope"), lambda: x.relocate("aa", before="nope")):
        with pytest.raises(KeyError):
            bad()


def test_aggregates(t):
    x = t(g=["a", "a", "b", None], v=[1, None, 3, 4], w=[None, None, 1.0, 2.0]).group_by("g")
    got = {r[0]: r[1:] for r in values(x.summarise(s=sum_(c.v), r=sum_(c.v, na_rm=True), n=n()))}
    assert got == {"a": (None, 1.0, 2.0), "b": (3.0, 3.0, 1.0), None: (4.0, 4.0, 1.0)}
    y = {r[0]: r[1:] for r in values(x.summarise(s=sum_(c.w, True), m=mean(c.w, True), lo=min_(c.w, True), hi=max_(c.w, True)))}
    assert y["a"][0] == 0 and math.isnan(y["a"][1]) and y["a"][2:] == (math.inf, -math.inf)
    assert values(x.ungroup().filter(c.v > 99).summarise(n=n())) == []
    with pytest.raises(LatticeError):
        t(s=["a"]).summarise(m=mean(c.s))
    two = x.mutate(h=lit(1)).group_by("g", "h")
    assert two.summarise(n=n()).groups == ("g",) and two.summarise(n=n(), groups="keep").groups == ("g", "h")
    with pytest.raises(ValueError):
        two.summarise(n=n(), groups="odd")
    assert x.ungroup().summarise(across(["v", "w"], {"s": sum_}, na_rm=True)).columns == ["v_s", "w_s"]


def test_joins(t):
    x, y = t(k=[1, 2, None], v=["a", "b", "c"]), t(k=[2.0, 3.0, None], v=["p", "q", "r"])
    assert values(x.inner_join(y, "k")) == [(2, "b", "p")]
    assert x.left_join(y, "k").columns == ["k", "v.x", "v.y"]
    assert sorted(values(x.full_join(y, "k")), key=str) == sorted([(1.0, "a", None), (2.0, "b", "p"), (None, "c", None), (3.0, None, "q"), (None, None, "r")], key=str)
    assert sorted(values(x.right_join(y, "k")), key=str) == sorted([(2.0, "b", "p"), (3.0, None, "q"), (None, None, "r")], key=str)
    assert values(x.anti_join(y, "k"), "v") == ["a", "c"]
    with pytest.raises(LatticeError, match="key type mismatch"):
        x.inner_join(y, {"v": "k"})
    with pytest.raises(KeyError, match="not found in y"):
        x.inner_join(y, {"k": "zz"})


def test_order(t):
    x = t(k=[2, None, 1, 2], v=["a", "b", "c", "d"])
    assert values(x.arrange("k"), "v") == ["c", "a", "d", "b"]
    assert values(x.arrange(desc("k")), "v") == ["b", "a", "d", "c"]
    assert values(x.slice_head(2), "v") == ["a", "b"]
    assert values(x.slice_tail(2), "v") == ["c", "d"]
    assert values(x.slice_min("k", 1), "v") == ["c"]
    assert values(x.slice_max("k", 2), "v") == ["b", "a"]
    assert values(x.slice_min("k", 0)) == []
    assert values(x.slice_min("k", 2, with_ties=True), "v") == ["c", "a", "d"]
    assert values(x.distinct("k", keep_all=True).arrange("k"), "v") == ["c", "a", "b"]


def _windows():
    return dict(rn=row_number(), r=rank("v"), d=dense_rank("v"), lg=lag("v", 2, default=-1.0), ld=lead("v"), s=cumsum("v"), m=cummean("v"), lo=cummin("v"), hi=cummax("v"))


@pytest.mark.parametrize("wide", [False, True])
def test_windows(t, monkeypatch, wide):
    """The same results in one task and bucket by bucket."""
    if wide:
        monkeypatch.setattr(window, "SINGLE_TASK_ROWS", 2)
        monkeypatch.setattr(window, "BUCKET_ROWS", 2)
    x = t(i=list(range(8)), v=[3, 1, 3, 2, 9, None, 1, 4]).with_order("i")
    got = x.mutate(**_windows()).arrange("i")
    assert values(got, "rn") == [1.0, 2, 3, 4, 5, 6, 7, 8]
    assert values(got, "r") == [4.0, 1, 4, 3, 7, 8, 1, 6]
    assert values(got, "d") == [3.0, 1, 3, 2, 5, 6, 1, 4]
    assert values(got, "lg") == [-1.0, -1, 3, 1, 3, 2, 9, None]
    assert values(got, "ld") == [1.0, 3, 2, 9, None, 1, 4, None]
    assert values(got, "s") == [3.0, 4, 7, 9, 18, None, None, None]
    assert values(got, "m")[:5] == [3, 2, 7 / 3, 9 / 4, 18 / 5]
    assert values(got, "lo") == [3.0, 1, 1, 1, 1, None, None, None]
    assert values(got, "hi") == [3.0, 3, 3, 3, 9, None, None, None]
    with pytest.raises(LatticeError):
        t(s=["a"]).mutate(v=cumsum("s"))


def test_binding(t):
    x, y = t(a=[1, 2], b=["x", "y"]), t(a=[0.5], z=[True])
    assert values(bind_rows(x, y, id="src")) == [(1, 1.0, "x", None), (1, 2.0, "y", None), (2, 0.5, None, True)]
    with pytest.raises(LatticeError):
        bind_rows(x, t(a=["s"]))
    assert values(bind_cols(x, t(q=[7, 8]))) == [(1, "x", 7), (2, "y", 8)]
    with pytest.raises(ValueError, match="same number of rows"):
        bind_cols(x, y)


def test_results(t):
    x = t(a=[1, 2, 3], b=["x", "y", None])
    assert x.pull() == ["x", "y", None] and x.pull("a") == [1, 2, 3] and x.pull(1) == [1, 2, 3]
    with pytest.raises(IndexError):
        x.pull(9)
    assert len(x.head(2)) == 2 and "a: int64" in repr(x) and "Physical Plan" in x.explain()
    assert x.count("b", sort=True).columns == ["b", "n"]
    out = x.group_by("b").reframe(lambda p: {"k": [0, 1]}, "k bigint")
    assert sorted(values(out)) == [("x", 0), ("x", 1), ("y", 0), ("y", 1)]


def test_join_of_many_to_many_is_dealt_out(spark):
    """Few keys, one of them of most rows: the rows are those of the plain join, and no task makes most of them."""
    x = from_pandas(spark, pd.DataFrame({"k": [i % 2 * (i % 3) for i in range(1200)], "v": range(1200)}))
    y = from_pandas(spark, pd.DataFrame({"k": [i % 3 for i in range(30)], "w": range(30)}))
    x, y = x.mutate(k=c.k * 1.0), y.filter(c.k < 2)
    for how in ("inner_join", "left_join"):
        plain, dealt = (getattr(x, how)(y, "k", many=many) for many in (False, True))
        got = dealt.to_df().groupBy(F.spark_partition_id()).count().collect()
        assert max(r[1] for r in got) < sum(r[1] for r in got) / 8
        assert dealt.columns == plain.columns
        assert sorted(values(dealt), key=str) == sorted(values(plain), key=str)
    got = catalog.QUERIES["join_m2m"](spark, SF)
    assert "SortMergeJoin" in got._jdf.queryExecution().toString() and len(got.columns) == 3


@pytest.mark.parametrize("held", [50_000, 10])
def test_reframe_of_parts(spark, monkeypatch, held):
    """Tasks cut their rows first: fn gets few of a large group, and gives what it gives for all."""
    monkeypatch.setattr(aggregate, "HELD_ROWS", held)
    monkeypatch.setattr(aggregate, "BATCHES", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    data = pd.DataFrame({"g": ["a", "b", None, "a"] * 1000, "v": [float(i * 7919 % 4001) for i in range(4000)], "i": range(4000)})
    data.loc[5, "v"] = None
    x = from_pandas(spark, data).group_by("g")

    def two(p):
        return p.sort_values(["v", "i"]).head(2)

    def fn(p):
        return {"i": two(p)["i"].to_numpy(), "few": len(p) < 300}

    schema = "i bigint, few boolean"
    try:
        got, whole = sorted(values(x.reframe(fn, schema, partial=two))), sorted(values(x.reframe(fn, schema)))
        with pytest.raises(Exception, match="with their index"):
            x.reframe(fn, schema, partial=lambda p: two(p).set_axis([-1, -2])).collect()
        alone = x.ungroup().reframe(fn, schema, partial=two)
        assert sorted(values(alone, "i")) == sorted(data.sort_values("v")["i"].head(2))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r[:2] for r in got] == [r[:2] for r in whole] and len(got) == 4
    assert all(r[2] for r in got) and not any(r[2] for r in whole)


def test_reframe_keeps_row_order(t):
    """In row order, descending with missing values first; fn sees no hidden column."""
    x = t(g=["a"] * 4 + ["b"], k=[2, None, 1, 3, 0], s=["x", "y", "z", "w", "v"]).arrange(desc("k")).group_by("g")
    got = x.reframe(lambda p: {"all": ["".join(p["s"])], "cols": [",".join(p.columns)]}, "all string, cols string")
    assert sorted(values(got)) == [("a", "ywxz", "g,k,s"), ("b", "v", "g,k,s")]
