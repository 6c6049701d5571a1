"""Result files: written, committed, read by blocks, with filters, and what is wrong told."""

import math
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import resultfile as R

MODEL = """    1C
    1UUSER
    2C                             3                                     1
 -1         1 0.00000E+00 1.00000E+00-2.50000E-01
 -1         7 1.50000E+00 0.00000E+00 0.00000E+00
 -1        12-1.00000E-30 2.00000E+10 0.00000E+00
 -3
    3C                             2                                     1
 -1         4    3    0WATER
 -2         1         7        12         1
 -1         9    1    0    2
 -2         1         7        12         1         1         7        12
 -2         1
 -3
    1PSTEP                         1           3           2
  100CL  101 0.500000000           2                     0    1           1
 -4  STRESS      7    1
 -5  SXX         1    4    1    1
 -5  SYY         1    4    2    2
 -5  SZZ         1    4    3    3
 -5  SXY         1    4    1    2
 -5  SYZ         1    4    2    3
 -5  SZX         1    4    3    1
 -5  MISES       1    4    0    0
 -5  ALL         1    2    0    0    1ALL
 -1         1 1.00000E+00 2.00000E+00 3.00000E+00 4.00000E+00 5.00000E+00 6.00000E+00
 -2           7.00000E+00
 -1         7-1.00000E+00-2.00000E+00-3.00000E+00-4.00000E+00-5.00000E+00         NaN
 -2          -7.00000E+00
 -3
 9999
"""


def test_a_file_of_another_writer(spark, tmp_path):
    text = MODEL.replace("STRESS      7    1", "STRESS      8    1")
    (tmp_path / "a.txt").write_text(text)
    path = str(tmp_path / "a.txt")
    assert [tuple(r) for r in R.read(spark, path, "nodes").collect()] == [(1, 0.0, 1.0, -0.25), (7, 1.5, 0.0, 0.0), (12, -1e-30, 2e10, 0.0)]
    got = R.read(spark, path, "elements").collect()
    assert [(r["elem"], r["type"], r["material"], len(r["nodes"])) for r in got] == [(4, 3, "WATER", 4), (9, 1, "2", 8)]
    rows = R.read(spark, path).collect()
    assert [(r["step"], r["increment"], r["time"], r["name"], r["node"]) for r in rows] == [(2, 3, 0.5, "STRESS", 1), (2, 3, 0.5, "STRESS", 7)]
    assert rows[0]["values"] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0] and math.isnan(rows[1]["values"][5])
    blocks = R.read(spark, path, "blocks").collect()
    assert [(b["kind"], b["n_rows"]) for b in blocks] == [("nodes", 3), ("elements", 2), ("results", 2)]
    assert blocks[2]["components"] == ["SXX", "SYY", "SZZ", "SXY", "SYZ", "SZX", "MISES"]


def test_wrong_row_count_in_a_header_and_odd_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text(MODEL.replace("    2C                             3", "    2C                            99").replace("STRESS      7    1", "STRESS      8    1"))
    assert R.read(spark, str(tmp_path / "a.txt"), "nodes").count() == 3
    (tmp_path / "a.txt").write_text(MODEL.replace("-2.50000E-01", "-2.50000E-01 "))
    with pytest.raises(Exception, match="characters a row"):
        R.read(spark, str(tmp_path / "a.txt"), "nodes").collect()
    with pytest.raises(Exception, match="is not there"):
        R.read(spark, str(tmp_path / "none")).collect()


def sets(spark, n=500):
    return spark.range(n).select(
        (F.col("id") % 5).cast("int").alias("step"), F.lit(1).alias("increment"), ((F.col("id") % 5) * 0.125).alias("time"), F.when(F.col("id") % 2 == 0, "DISP").otherwise("FORC").alias("name"), (F.col("id") * 3).alias("node"), F.array(*[(F.col("id") * k / 8.0) for k in range(8)]).alias("values")
    )


def test_rows_come_back_from_several_partitions(spark, tmp_path, monkeypatch):
    where = "file://" + str(tmp_path / "out")
    R.write(sets(spark), where, parts=3, components={"DISP": [f"D{k}" for k in range(8)]})
    assert sum(name.startswith("part-") for name in os.listdir(tmp_path / "out")) >= 2
    assert not any("_temporary" in name for name in os.listdir(tmp_path / "out"))
    back = R.read(spark, where)
    assert back.rdd.getNumPartitions() >= 10
    assert sorted(map(str, back.collect())) == sorted(map(str, sets(spark).collect()))
    # Without the writers' indices the files are scanned, with the same outcome.
    for name in os.listdir(tmp_path / "out"):
        if name.startswith("_blocks"):
            os.rename(tmp_path / "out" / name, tmp_path / name)
    assert sorted(map(str, R.read(spark, where).collect())) == sorted(map(str, sets(spark).collect()))


def test_pieces_of_blocks_meet_at_records(tmp_path, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 700)
    rows = "".join(R._element_lines({"elem": e, "type": 4 if e % 2 else 3, "material": e % 7, "nodes": list(range(e, e + (20 if e % 2 else 4)))}) for e in range(1, 200))
    nodes = "".join(R._value_lines(k, [k / 4.0, -k, 1e-120]) for k in range(1, 300))
    (tmp_path / "m.txt").write_text(f"    1C\n    2C{'':18}{299:12d}{'':37}1\n{nodes} -3\n    3C{'':18}{199:12d}{'':37}1\n{rows} -3\n 9999\n")
    for what, key, n in (("elements", "elem", 199), ("nodes", "node", 299)):
        reader = R.Reader({"path": str(tmp_path / "m.txt"), "what": what})
        pieces = reader.partitions()
        assert len(pieces) > 10
        got = [x for p in pieces for batch in reader.read(p) for x in batch.column(batch.schema.get_field_index(key)).to_pylist()]
        assert got == list(range(1, n + 1))


def test_filters_are_pushed_to_blocks(spark, tmp_path):
    where = str(tmp_path / "out")
    R.write(sets(spark), where, parts=2)
    held = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = R.read(spark, where, filters="true").filter("name = 'DISP' and time > 0.2 and node < 900")
        assert some.rdd.getNumPartitions() < R.read(spark, where).rdd.getNumPartitions()
        assert sorted(map(str, some.collect())) == sorted(map(str, sets(spark).filter("name = 'DISP' and time > 0.2 and node < 900").collect()))
        assert R.read(spark, where, filters="true").filter("step in (1, 3) and increment <= 1").count() == 200
        assert R.read(spark, where, filters="true").filter("step = 77").count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", held)
    assert R.read(spark, where, name="FORC", step="0,2").count() == 100


def test_overwrite_append_and_empty(spark, tmp_path):
    where = str(tmp_path / "out")
    R.write(sets(spark, 50), where)
    R.write(sets(spark, 20), where)
    assert R.read(spark, where).count() == 70
    R.write(sets(spark, 30), where, mode="overwrite")
    assert R.read(spark, where).count() == 30
    R.write(sets(spark, 0), where, mode="overwrite")
    assert R.read(spark, where).count() == 0
    model = spark.createDataFrame([(1, 3, "1", [1, 2, 3, 4])], R.SCHEMAS["elements"])
    R.write(model, where, "elements")
    assert R.read(spark, where, "elements").collect() == model.collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    where = str(tmp_path / "out")
    R.write(sets(spark, 10), where)
    before = sorted(os.listdir(where))
    with pytest.raises(Exception, match="more than 8 letters"):
        R.write(sets(spark, 10).withColumn("name", F.lit("MUCHTOOLONG")), where)
    with pytest.raises(Exception, match="null in a row"):
        R.write(sets(spark, 10).withColumn("values", F.lit(None).cast("array<double>")), where)
    assert sorted(os.listdir(where)) == before and R.read(spark, where).count() == 10


@pytest.mark.parametrize("value", [0.0, -0.0, 1.0, -123456.0, 9.87654e-38, 1e-120, 3.4e38, -2.5e-5])
def test_values_take_twelve_characters(value):
    text = R._value(value)
    assert len(text) == 12 and float(text) == pytest.approx(value, rel=1e-5, abs=1e-99)
    assert len(R._value(math.inf)) == len(R._value(1e300)) == len(R._value(math.nan)) == 12
    assert len(R._time(value)) == 12
