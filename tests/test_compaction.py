"""Block copying of Parquet files and the records of tiny files."""

import glob

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenscan.operators.compaction import compact_entities, consolidate, file_records, list_files
from lumenscan.sources.parquet_blocks import merge_files, open_fs, read_footer


SCHEMA = pa.schema({"i": pa.int64(), "s": pa.string(), "v": pa.list_(pa.float64())})


def table(n, start=0):
    return pa.table({"i": pa.array(range(start, start + n), pa.int64()), "s": [f"x{i % 3}" if i % 5 else None for i in range(n)], "v": [[float(i)] * (i % 4) for i in range(n)]}, schema=SCHEMA)


@pytest.mark.parametrize("codec", ["snappy", "zstd", "none"])
def test_merge_keeps_rows_and_blocks(tmp_path, codec):
    files, want = [], []
    for k, n in enumerate((5, 0, 1000, 1)):
        t = table(n, k * 10_000)
        files.append(str(tmp_path / f"{k}.parquet"))
        pq.write_table(t, files[-1], compression=codec, row_group_size=300, use_dictionary=k % 2 == 0)
        want += t.to_pylist()
    m = merge_files(files, str(tmp_path / "out/all.parquet"))
    f = pq.ParquetFile(m.path)
    assert f.read().to_pylist() == want
    assert (m.rows, m.blocks, m.files_in, m.ok) == (1006, 6, 4, True) and f.num_row_groups == 6
    # Statistics came along, so row groups can still be pruned.
    assert f.metadata.row_group(f.num_row_groups - 1).column(0).statistics.min == 30_000
    # The copied chunks are byte for byte the same: the sum of compressed sizes is kept.
    size = lambda p: sum(p.metadata.row_group(g).column(c).total_compressed_size for g in range(p.num_row_groups) for c in range(3))
    assert size(f) == sum(size(pq.ParquetFile(x)) for x in files)


def test_merge_refuses_other_schema_and_leaves_nothing(tmp_path):
    pq.write_table(table(3), tmp_path / "a.parquet")
    pq.write_table(pa.table({"i": [1.5]}), tmp_path / "b.parquet")
    with pytest.raises(ValueError):
        merge_files([str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")], str(tmp_path / "o/c.parquet"))
    assert not glob.glob(str(tmp_path / "o/*.parquet"))
    with pytest.raises(ValueError):
        merge_files([], str(tmp_path / "o/c.parquet"))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=30), min_size=1, max_size=5))
def test_merge_any_text(tmp_path_factory, columns):
    d = tmp_path_factory.mktemp("m")
    for k, c in enumerate(columns):
        pq.write_table(pa.table({"t": pa.array(c, pa.string())}), d / f"{k}.parquet")
    m = merge_files([str(d / f"{k}.parquet") for k in range(len(columns))], str(d / "out.parquet"))
    assert pq.read_table(m.path).column("t").to_pylist() == [x for c in columns for x in c]
    fs, place = open_fs(m.path)
    with fs.open_input_file(place) as f:
        assert read_footer(f, f.size())[3][1] == m.rows


def test_consolidate_many_small_files(spark, tmp_path):
    spark.range(3000).repartition(60).withColumn("t", F.col("id") % 7).write.parquet(str(tmp_path / "in"))
    files = list_files(spark, str(tmp_path / "in")).withColumn("grp", F.lit("all"))
    total = files.agg(F.sum("length")).first()[0]
    report = consolidate(files, "file://" + str(tmp_path / "out"), total // 4).collect()
    assert 4 <= len(report) <= 6 and sum(r["n_rows"] for r in report) == 3000 and all(r["valid"] for r in report)
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert got.count() == 3000 and got.select("id").distinct().count() == 3000


FILES = "file_id long, entityname string, state string, written_at timestamp, content string, n_copies int"


def test_records_of_tiny_files(spark):
    t = "2022-01-01 00:00:0"
    rows = [
        (1, "Shot_Colour ", "committed", t + "1", "# id\ttype\tlength\tfeature\n1\ta\t2\t0.5  1\r\n2\tb\t1\t-3e1\n\n", 1),
        (2, "`shot_colour`", "committed", t + "2", "1\ta\t2\t5e-1 1.0\r3\tc\t3\t1 2", 1),
        (3, "other", "committed", t + "3", "1\ta\t1\t1\n1\ta\t1\t1\nx\ta\t1\t1\n4\ta\t1\tzz", 1),
        (4, "other", "aborted", t + "3", "9\ta\t1\t1", 1), (5, "other", "committed", t + "3", None, 1), (6, None, "committed", t + "3", "7\ta\t0\t", 1),
    ]
    df = spark.createDataFrame([(*r[:3], None, *r[4:]) for r in rows], FILES)
    got = sorted((r["entity"], r["ap_id"], r["n_copies"], r["values"]) for r in compact_entities(df, 1 << 10)[0].collect())
    assert got == [("", 7, 1, []), ("other", 1, 2, [1.0]), ("shot_colour", 1, 2, [0.5, 1.0]), ("shot_colour", 2, 1, [-30.0])]
    assert file_records(df).count() == 6
    empty, report = compact_entities(df.limit(0))
    assert empty.count() == 0 and report.count() == 0
