"""Round trips and error cases of the formats."""

import pandas as pd
import pytest

from lodestone import c, from_pandas, read_blocks, read_csv, read_geotiff, read_parquet, read_sqlite
from lodestone.sources import write_blocks, write_csv, write_geotiff, write_parquet, write_sqlite


@pytest.fixture
def x(spark):
    return from_pandas(spark, pd.DataFrame({
        "i": pd.Series([1, None, 3], dtype=object), "d": pd.Series([0.1, None, -2.5], dtype=object),
        "b": pd.Series([True, None, False], dtype=object), "s": pd.Series(['a,"b"\nc', None, "é"], dtype=object),
    }))


def rows(frame):
    return [tuple(r) for r in frame.to_df().collect()]


def test_blocks(spark, x, tmp_path):
    path = str(tmp_path / "x")
    write_blocks(x, path, batch_size=2)
    assert rows(read_blocks(spark, path)) == rows(x)
    (tmp_path / "bad").write_bytes(b"nope")
    with pytest.raises(ValueError, match="not a block file"):
        read_blocks(spark, str(tmp_path / "bad"))
    write_blocks(x.filter(c.i > 9), path)
    assert rows(read_blocks(spark, path)) == []


def test_csv(spark, x, tmp_path):
    path = str(tmp_path / "x.csv")
    write_csv(x, path)
    back = read_csv(spark, path)
    assert rows(back) == rows(x) and list(back.kinds.values()) == ["int64", "double", "bool", "string"]
    (tmp_path / "y.csv").write_text("a,b,c\n1,NA,x\n\n2.5,true\n3,FALSE,z,extra\n")
    got = read_csv(spark, str(tmp_path / "y.csv"))
    assert got.kinds == {"a": "double", "b": "bool", "c": "string"}
    assert rows(got) == [(1.0, None, "x"), (2.5, True, None), (3.0, False, "z")]


def test_sqlite(spark, x, tmp_path):
    path = str(tmp_path / "x.db")
    write_sqlite(x, path, "t")
    got = read_sqlite(spark, path, "t", batch_size=2)
    assert [r[:2] for r in rows(got)] == [r[:2] for r in rows(x)] and got.pull("s") == x.pull("s")
    with pytest.raises(ValueError, match="table not found"):
        read_sqlite(spark, path, "zz")
    (tmp_path / "bad").write_bytes(b"nope" * 100)
    with pytest.raises(ValueError, match="not a SQLite database"):
        read_sqlite(spark, str(tmp_path / "bad"), "t")


@pytest.mark.parametrize("compress", [False, True])
def test_geotiff(spark, tmp_path, compress):
    path = str(tmp_path / "x.tif")
    grid = pd.DataFrame([(x * 0.5, y * 2.0, float(x + 10 * y)) for x in range(4) for y in range(300)], columns=["x", "y", "v"])
    frame = from_pandas(spark, grid).filter(c.v != 11.0)
    write_geotiff(frame, path, compress)
    back = read_geotiff(spark, path)
    assert back.meta["width"] == 4 and back.meta["height"] == 300
    got = {(r[0], r[1]): r[2] for r in rows(back)}
    assert len(got) == 1200 and got[0.5, 2.0] is None and got[1.5, 8.0] == 43.0
    with pytest.raises(ValueError, match="no pixels"):
        write_geotiff(frame.filter(c.x > 99), path)


def test_parquet_order(spark, x, tmp_path):
    path = str(tmp_path / "x.parquet")
    write_parquet(x, path)
    assert read_parquet(spark, path).filter(c.i > 0).slice_tail(1).pull("i") == [3]


def test_geotiff_foreign_files(spark, tmp_path):
    """Classic files of both byte orders, integer samples, planar bands, nodata, and no georeference."""
    import struct

    for order, name in (("<", "II"), (">", "MM")):
        for planar in (1, 2):
            bands = [[1, 2, 3, -9], [5, 6, 7, 8]]  # two columns, two rows
            pixels = [v for band in bands for v in band] if planar == 2 else [v for cell in zip(*bands, strict=True) for v in cell]
            data = struct.pack(f"{order}8h", *pixels)
            nodata = b"-9\0\0"
            at = 8
            offsets = [at, at + 8] if planar == 2 else [at]
            sizes = [8, 8] if planar == 2 else [16]
            more = at + len(data)
            tags = [(256, 3, [2]), (257, 3, [2]), (258, 3, [16, 16]), (259, 3, [1]), (262, 3, [1]), (273, 4, offsets), (277, 3, [2]), (278, 3, [2]), (279, 4, sizes), (284, 3, [planar]), (339, 3, [2, 2])]
            entries, extra = b"", b""
            for tag, kind, values in tags:
                body = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
                if len(body) > 4:
                    extra, body = extra + body, struct.pack(f"{order}I", more + len(extra))
                entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
            entries += struct.pack(f"{order}HHI", 42113, 2, 3) + nodata
            head = name.encode() + struct.pack(f"{order}HI", 42, more + len(extra))
            path = tmp_path / f"{name}{planar}.tif"
            path.write_bytes(head + data + extra + struct.pack(f"{order}H", len(tags) + 1) + entries + bytes(4))
            rows = sorted(map(tuple, read_geotiff(spark, str(path)).to_df().select("x", "y", "band1", "band2").collect()))
            assert rows == [(0.5, 0.5, 3.0, 7.0), (0.5, 1.5, 1.0, 5.0), (1.5, 0.5, None, 8.0), (1.5, 1.5, 2.0, 6.0)]


def test_stateless_verbs_on_a_stream(spark, tmp_path):
    from lodestone import c
    from lodestone.streaming import apply_stateless

    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    out = apply_stateless(stream, lambda f: f.filter(c.id > 6).mutate(twice=c.id * 2).select("twice"))
    query = out.writeStream.format("memory").queryName("made").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r[0] for r in spark.table("made").collect()) == [14, 16, 18]
