"""Readers and writers: Parquet (native), CSV, SQLite, GeoTIFF, block files, pandas."""

from lodestone.sources.blocks import read_blocks, write_blocks
from lodestone.sources.delimited import read_csv, write_csv
from lodestone.sources.geotiff import read_geotiff, write_geotiff
from lodestone.sources.parquet import from_pandas, read_parquet, write_parquet
from lodestone.sources.sqlite import read_sqlite, write_sqlite

__all__ = [
    "from_pandas", "read_blocks", "read_csv", "read_geotiff", "read_parquet", "read_sqlite",
    "write_blocks", "write_csv", "write_geotiff", "write_parquet", "write_sqlite",
]
