"""CSV dialect, ids from content, work folder."""

import pytest
from pyspark.sql import functions as F

from linkwise import session
from linkwise.operators.prepare import with_unique_id
from linkwise.sources import quoted
from linkwise.sources.reader import DataLoadError, load, load_multiple
from linkwise.sources.writer import save


def test_csv_quotes_line_feeds_and_missing_fields(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,name,address\n1,"Ann ""Bo"" Lee","5 Main, ""B"""\n2,"two\nlines", x \n3,c\n4,None,\n')
    rows = [tuple(r) for r in load(spark, str(path)).orderBy("id").collect()]
    assert rows == [("1", 'Ann "Bo" Lee', '5 Main, "B"'), ("2", "two\nlines", " x "), ("3", "c", None), ("4", None, None)]


def test_quoted_csv_is_read_by_many_tasks(spark, tmp_path):
    """Splits inside quoted fields of several lines, records longer than a split, several files: as the whole-file read."""
    import random

    rng = random.Random(3)
    parts = ["plain", "two\nlines", 'say ""hi""', "a,b", "", "\n\n", 'x\n""\ny', "long " * 60, "None", " pad ", "é\n日本"]
    for name, n in (("a", 400), ("b", 3), ("c", 0)):
        rows = [f'{name}{i},"{rng.choice(parts)}{rng.choice(parts)}",{rng.choice(["z", "", "q q"])}' for i in range(n)]
        rows += [f'{name}-huge,"{"many lines" + chr(10) * 3000}",z', f"{name}-short", ""]
        (tmp_path / "q.csv").mkdir(exist_ok=True)
        (tmp_path / "q.csv" / f"{name}.csv").write_text("\n".join(["id,text,more", *rows]) + ("\n" if name == "a" else ""))
    path = str(tmp_path / "q.csv")
    whole = sorted(map(tuple, load(spark, path).collect()), key=str)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("100", "777", "5000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = load(spark, path)
            assert df.columns == ["id", "text", "more"] and "MapInArrow" in df._jdf.queryExecution().toString()
            assert quoted.lines(spark, path).select(F.spark_partition_id()).distinct().count() > 4
            assert sorted(map(tuple, df.collect()), key=str) == whole
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(whole) == 400 + 3 + 2 * 3
    assert "MapInArrow" not in load(spark, path)._jdf.queryExecution().toString()


def test_surplus_fields_in_a_split_file_are_an_error(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("id,name\n" + "".join(f'{i},"a\nb"\n' for i in range(100)) + "x,b,EXTRA\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        with pytest.raises(Exception, match="more fields than the header: x"):
            load(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_surplus_fields_are_an_error(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("id,name\n1,a\n2,b,EXTRA\n")
    with pytest.raises(Exception, match="more fields than the header"):
        load(spark, str(path)).select("id").collect()


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'say "hi", or\nnot'), ("2", "  outer blanks "), ("3", "back\\slash \\\" quote"), ("4", "'")]
    df = spark.createDataFrame(rows, "id string, text string")
    save(df, str(tmp_path / "c.csv"))
    assert sorted(map(tuple, load(spark, str(tmp_path / "c.csv")).collect())) == rows


def test_json_array(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    assert sorted((r.a, r.b) for r in load(spark, str(path)).collect()) == [("1", "x"), ("2", None)]


def test_ids_do_not_depend_on_files(spark, tmp_path):
    rows = [(f"n{i % 40}", "x" if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = []
    for n in (1, 8):
        df.repartition(n).write.parquet(str(tmp_path / f"p{n}"))
        back = with_unique_id(spark.read.parquet(str(tmp_path / f"p{n}")))
        got.append(sorted((r.a, r.b or "", r.unique_id) for r in back.collect()))
    assert got[0] == got[1]
    assert len({r[2] for r in got[0]}) == 300


def test_ids_of_a_row_with_many_copies(spark):
    """Copies beyond one task's share, in any order and any number of partitions."""
    rows = [("hot", None)] * 400 + [("hot", "")] * 7 + [(f"n{i}", "x") for i in range(600)]
    got = []
    for seed, parts, copies in ((1, 3, 100_000), (2, 7, 30), (3, 1, 399), (4, 2, 400)):
        df = spark.createDataFrame(rows, "a string, b string").repartition(parts).orderBy(F.rand(seed))
        ids = with_unique_id(df, copies=copies)
        got.append(sorted((r.a, r.b is None, r.unique_id) for r in ids.collect()))
    assert all(g == got[0] for g in got) and len({g[2] for g in got[0]}) == len(rows)
    assert with_unique_id(spark.createDataFrame([], "a string")).count() == 0


@pytest.fixture
def mixed_files(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id long, x string").write.parquet(str(tmp_path / "a.parquet"))
    spark.createDataFrame([("2", 0.5)], "id string, y double").write.parquet(str(tmp_path / "b.parquet"))
    spark.createDataFrame([(3, "c")], "id long, x string").write.parquet(str(tmp_path / "c.parquet"))
    (tmp_path / "d.json").write_text('[{"id": 4, "x": "d"}, {"id": 5, "z": true}]')
    (tmp_path / "e.csv").write_text("id,y\n6,None\n")
    return [str(tmp_path / n) for n in ("a.parquet", "b.parquet", "c.parquet", "d.json", "e.csv")]


def test_files_of_different_types_and_columns(spark, mixed_files):
    got = load_multiple(spark, mixed_files)
    assert set(got.dtypes) == {(c, "string") for c in ("id", "x", "y", "z")}
    assert sorted((r.id, r.x, r.y, r.z) for r in got.collect()) == [
        ("1", "a", None, None), ("2", None, "0.5", None), ("3", "c", None, None), ("4", "d", None, None),
        ("5", None, None, "true"), ("6", None, None, None)]
    alone = load_multiple(spark, mixed_files, concat=False)
    assert [f.count() for f in alone] == [1, 1, 1, 2, 1]


def test_options_go_to_the_formats_that_know_them(spark, mixed_files, tmp_path):
    (tmp_path / "f.json").write_text('{"id": 7}\n{"id": 8}\n')
    (tmp_path / "g.csv").write_text("id;y\n9;z\n")
    paths = [mixed_files[0], str(tmp_path / "f.json"), str(tmp_path / "g.csv")]
    got = load_multiple(spark, paths, lines=True, sep=";", columns=["id"], multi_line=False)
    assert sorted(r.id for r in got.collect()) == ["1", "7", "8", "9"] and "x" not in got.columns


@pytest.mark.parametrize("name, message", [("none.parquet", "File not found"), ("none.csv", "File not found"),
                                           ("none.json", "File not found"), ("a.xlsx", "Unsupported"), ("bad.parquet", "Failed to load")])
def test_every_failure_is_a_load_error(spark, mixed_files, tmp_path, name, message):
    (tmp_path / "bad.parquet").write_text("no parquet at all")
    for concat in (True, False):
        with pytest.raises(DataLoadError, match=message):
            load_multiple(spark, [mixed_files[0], str(tmp_path / name)], concat=concat)


def test_no_files_is_a_load_error(spark):
    with pytest.raises(DataLoadError):
        load_multiple(spark, [])


class _Context:
    def __init__(self, master, folder=None):
        self.master, self.folder, self.applicationId = master, folder, "app-1"

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master, conf):
        self.sparkContext, self.values = _Context(master), conf
        self.conf = self

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Session("spark://host:7077", {}))
    assert session.ensure_checkpoint_dir(_Session("yarn", {session.CHECKPOINT_CONF: "hdfs:///w"})) == "hdfs:///w"
    assert "app-1" in session.ensure_checkpoint_dir(_Session("local[2]", {}))
