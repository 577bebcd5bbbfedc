"""Source order, client exports, replaced tables and readers of whole pages."""


import pytest
from pyspark.sql import functions as F

from fieldmark.operators import locations
from fieldmark.sources import exports, files, ordered


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_rows_keep_their_place_over_many_splits(spark, tmp_path, small_splits):
    sizes = {"a.csv": 3000, "b.csv": 1, "c.csv": 0, "d.csv": 777}
    for name, n in sizes.items():
        (tmp_path / name).write_text("id,v\n" + "".join(f"{name}{i},{i}\n" for i in range(n)))
    paths = [str(tmp_path / n) for n in sizes]
    got = ordered.read_in_order(spark, paths[::-1])
    assert spark.read.csv(paths[0]).rdd.getNumPartitions() > 5
    rows = [(r._source, r._ord, r.id) for r in got.orderBy(*ordered.source_order()).collect()]
    assert rows == [(3 - k, i, f"{name}{i}") for k, (name, n) in reversed(list(enumerate(sizes.items()))) for i in range(n)]
    one = ordered.read_in_order(spark, [str(tmp_path / "*.csv")]).orderBy(*ordered.source_order())
    assert [r.id for r in one.collect()] == [f"{name}{i}" for name, n in sizes.items() for i in range(n)]


def test_union_of_headers_and_quoted_lines_keep_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"x\ny"\n2,z\n')
    (tmp_path / "b.csv").write_text("id,size\n3,7\n")
    got = ordered.read_in_order(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], quoted_lines=True)
    assert [(r.id, r.note, r["size"], r._ord) for r in got.orderBy(*ordered.source_order()).collect()] == [("1", "x\ny", None, 0), ("2", "z", None, 1), ("3", None, "7", 0)]


def test_readers_give_the_order(spark, tmp_path, small_splits):
    head = ",".join(locations.REQUIRED)
    for cc, n in (("dk", 300), ("us", 2)):
        (tmp_path / cc).mkdir()
        lines = [",".join(f"{cc}{i}" if c == "establishment_id" else "1" for c in locations.REQUIRED) for i in range(n)]
        (tmp_path / cc / "locations.csv").write_text("\n".join([head, *lines]) + "\n")
    read = files.read_register(spark, str(tmp_path / "dk/locations.csv"), ["establishment_id"], ["latitude"], ordered=True)
    assert [r.establishment_id for r in read.orderBy("_ord").collect()] == [f"dk{i}" for i in range(300)]
    assert sorted(r._ord for r in read.collect()) == list(range(300))
    both = locations.read_countries(spark, str(tmp_path), ["dk", "us"], ordered=True)
    assert sorted((r.country, r._ord, r.establishment_id) for r in both.collect()) == sorted((cc, i, f"{cc}{i}") for cc, n in (("dk", 300), ("us", 2)) for i in range(n))
    union = files.read_all(spark, [str(tmp_path / "us/locations.csv"), str(tmp_path / "dk/locations.csv")], ordered=True)
    assert [r.establishment_id for r in union.orderBy(*ordered.source_order()).collect()][:4] == ["us0", "us1", "dk0", "dk1"]


def test_dropped_rows_leave_their_places(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,x\n0,1\n1,bad\n2,3\n")
    got = files.read_register(spark, str(tmp_path / "r.csv"), ["id"], ["x"], "drop", ordered=True)
    assert sorted((r.id, r.x, r._ord) for r in got.collect()) == [("0", 1.0, 0), ("2", 3.0, 2)]


def test_numbered_files(spark, tmp_path):
    for n in (1, 3):
        (tmp_path / f"part_{n}.csv").write_text(f"id\n{n}\n")
    found = ordered.numbered_files(spark, f"{tmp_path}/part_{{}}.csv", range(1, 5))
    assert found == [f"{tmp_path}/part_1.csv", f"{tmp_path}/part_3.csv"]
    assert [r.id for r in ordered.read_in_order(spark, found).orderBy(*ordered.source_order()).collect()] == ["1", "3"]


def to_csv(rows):
    """The client's text, by hand."""
    if not rows:
        return ""
    headers = list(dict.fromkeys(k for r in rows for k in r))

    def esc(v):
        if v is None:
            return ""
        s = repr(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
        return '"' + s.replace('"', '""') + '"' if any(x in s for x in '",\n') else s

    return "\n".join([",".join(headers), *(",".join(esc(r.get(h)) for h in headers) for r in rows)])


def joined(path):
    return b"".join(f.read_bytes() for f in sorted(path.glob("part-*"))).decode()


def test_client_csv_is_the_clients_bytes(spark, tmp_path):
    first = [{"Type": "Lab", "Name": n, "Lat": x} for n, x in ((" x ", 1.0), ("", 47.25), ('say "a"', None), ("a,b", -0.5), ("line\nfeed", 1e-5), ("Ünï\r", 100.0))]
    second = [{"Name": f"n{i}", "Type": None, "Size": i} for i in range(500)]
    a = spark.createDataFrame([(r["Type"], r["Name"], r["Lat"], i) for i, r in enumerate(first)], "Type string, Name string, Lat double, _ord int").repartition(4)
    b = spark.createDataFrame([(r["Name"], None, r["Size"], i) for i, r in enumerate(second)], "Name string, Type string, Size int, _ord int").repartition(5)
    empty = spark.createDataFrame([], "Other string, _ord int")
    exports.write_client_csv([a, empty, b], [["_ord"]] * 3, str(tmp_path / "e"))
    want = to_csv([r | {"Lat": "0.00001"} if r["Lat"] == 1e-5 else r for r in first] + second)
    assert joined(tmp_path / "e") == want + "\n"
    exports.write_client_csv([empty], [["_ord"]], str(tmp_path / "none"))
    assert joined(tmp_path / "none") == ""


def test_numbers_as_scripts_write_them(spark):
    numbers = [0.0, -0.0, 1.0, -122.4194, 47.606209, 1e21, 1.5e-7, 1e-7, 123456789.125, 1e20, float("nan"), 5e-324, 0.1]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i").select(exports.script_number(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == ["0", "0", "1", "-122.4194", "47.606209", "1e+21", "1.5e-7", "1e-7", "123456789.125", "100000000000000000000", "NaN", "4.9e-324", "0.1"]


def test_fixed_header(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, "x"), ("a", 1, " y ")], "name string, n int, extra string")
    exports.write_fixed(df, ["n", "lacking", "name"], ["n"], str(tmp_path / "f"))
    assert joined(tmp_path / "f") == "n,lacking,name\n1,,a\n2,,b\n"


def test_table_is_replaced_from_itself_and_survives_an_interruption(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    exports.replace_table(spark.range(3), path)
    exports.replace_table(exports.read_current(spark, path).selectExpr("id + 10 as id"), path)
    ids = lambda p=None: sorted(r.id for r in (spark.read.parquet(p) if p else exports.read_current(spark, path)).collect())
    assert ids() == [10, 11, 12] and ids(f"{path}.backup") == [0, 1, 2]
    rename, calls = exports._rename, []

    def fails_second(fs, source, target):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        rename(fs, source, target)

    monkeypatch.setattr(exports, "_rename", fails_second)
    with pytest.raises(OSError, match="lost"):
        exports.replace_table(exports.read_current(spark, path).selectExpr("id + 10 as id"), path)
    assert ids() == [10, 11, 12]  # between the two steps the backup is the table
    monkeypatch.setattr(exports, "_rename", rename)
    exports.replace_table(exports.read_current(spark, path).selectExpr("id + 100 as id"), path)
    assert ids() == [110, 111, 112] and ids(f"{path}.backup") == [10, 11, 12]
    with pytest.raises(FileNotFoundError):
        exports.read_current(spark, f"{path}-none")
