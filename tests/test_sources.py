import pytest

from gapline.session import shared_folder
from gapline.sources import readers, versions, writers
from tests.helpers import at, times


@pytest.fixture()
def folder(spark):
    return shared_folder(spark)


def test_csv_wanted_and_preview(spark, folder):
    path = writers.write_csv(spark.createDataFrame([(i, f"n{i}") for i in range(9)], "a int, b string"), f"{folder}/x.csv")
    assert readers.read_csv(spark, path, ["b", "zz"]).columns == ["b"]
    assert readers.read_csv(spark, path, rows=4).count() == 4
    assert dict(readers.read_csv(spark, path, schema="a INT, b STRING").dtypes)["a"] == "int"


def test_optional_source(spark, folder):
    assert readers.read_optional(spark, f"{folder}/none.csv", "a INT").columns == ["a"]
    assert readers.read_optional(spark, None, "a INT").count() == 0
    path = writers.write_parquet(spark.range(3), f"{folder}/r.parquet")
    assert readers.read_optional(spark, path, "id BIGINT", "parquet").count() == 3


def test_parts_must_have_needed_columns(spark, folder):
    a = writers.write_parquet(times(spark, [("x", at(1), 1.0)], "id string, ts timestamp, v double"), f"{folder}/a.parquet")
    b = writers.write_csv(spark.createDataFrame([("y", "bad", "2.5")], "id string, ts string, v string"), f"{folder}/b.csv")
    got = {r.id: (r.ts, r.v) for r in readers.read_parts(spark, [a, b], ["id", "ts"], ["ts"]).collect()}
    assert got == {"x": (at(1), 1.0), "y": (None, 2.5)}
    with pytest.raises(ValueError):
        readers.read_parts(spark, [a], ["birth"])
    with pytest.raises(ValueError):
        readers.read_parts(spark, [], ["id"])
    with pytest.raises(ValueError):
        readers.read_parts(spark, ["x.xlsx"], ["id"])


def test_label_times_name_bad_values(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:01.5",), ("2024-01-01 00:00:02",), (None,)], "s string")
    got = [r.t for r in readers.strict_label_times(df, "s", "t").collect()]
    assert got == [at(1.5), at(2), None]
    with pytest.raises(ValueError, match="01/02/2024"):
        readers.strict_label_times(spark.createDataFrame([("01/02/2024",)], "s string"), "s", "t")


def test_keep_list_falls_back_to_first_column(spark, folder):
    path = writers.write_csv(spark.createDataFrame([(" a ", 1), ("b", 2), ("b", 3), (" ", 4)], "who string, n int"), f"{folder}/k.csv")
    assert sorted(r[0] for r in readers.read_keep_list(spark, path).collect()) == ["a", "b"]


def test_column_list(spark, folder):
    path = writers.write_column_list(spark, ["b", "a"], f"{folder}/c", ordered=False)
    assert readers.read_column_list(spark, path) == ["a", "b"]
    assert readers.read_column_list(spark, writers.write_column_list(spark, ["b", "a"], f"{folder}/d")) == ["b", "a"]


def test_stored_step_runs_once(spark, folder):
    files = []
    for force in (False, False, True):
        step = writers.materialize(spark, f"{folder}/step", lambda: spark.range(4), force)
        assert step.count() == 4
        files.append(set(step.inputFiles()))
    assert files[0] == files[1] and files[1] != files[2]
    # another plan under the same path is another step
    assert writers.materialize(spark, f"{folder}/step", lambda: spark.range(5)).count() == 5


def test_stored_step_sees_a_changed_input(spark, folder):
    source = writers.write_parquet(spark.range(5), f"{folder}/in")
    make = lambda: spark.read.parquet(source).where("id >= 0")
    assert writers.materialize(spark, f"{folder}/changed", make).count() == 5
    writers.write_parquet(spark.range(9), source)
    assert writers.materialize(spark, f"{folder}/changed", make).count() == 9
    assert versions.versions(spark, f"{folder}/changed") == [1, 2]


def test_versions_are_whole_and_never_lost(spark, folder):
    path = f"{folder}/table"
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    assert versions.write_version(spark, spark.range(2), path) == 1
    old = versions.read_version(spark, path)
    # a new version is made from the old one, while readers still hold that
    assert versions.write_version(spark, old.where("id = 1"), path) == 2
    assert (old.count(), versions.read_version(spark, path).count(), versions.read_version(spark, path, 1).count()) == (2, 1, 2)
    # a writer that counted before the other one published takes the next number
    spark.range(7).write.parquet(f"{path}/data-late")
    assert versions._publish(spark, path, {"data": "data-late", "fingerprint": None}, 2) == 3
    assert versions.read_version(spark, path).count() == 7 and versions.read_version(spark, path, 2).count() == 1
    # a writer that dies before publishing changes nothing
    spark.range(1).write.parquet(f"{path}/data-lost")
    assert versions.read_version(spark, path).count() == 7
    versions.prune(spark, path, 1)
    assert versions.versions(spark, path) == [3] and versions.read_version(spark, path).count() == 7


def test_replace_swaps_the_table(spark, folder):
    path = f"{folder}/t.parquet"
    writers.replace_parquet(spark, spark.range(2), path)
    # the new table is made from the old one
    writers.replace_parquet(spark, spark.read.parquet(path).filter("id = 1"), path)
    assert [r.id for r in spark.read.parquet(path).collect()] == [1] and not writers.exists(spark, f"{path}.tmp")


def test_empty_sink_keeps_columns(spark, folder):
    path = writers.write_parquet(spark.createDataFrame([], "a INT, b STRING"), f"{folder}/e.parquet")
    assert readers.parquet_columns(spark, path) == ["a", "b"] and readers.read_parquet(spark, path, ["b", "q"]).columns == ["b"]


def test_shared_folder_follows_the_session():
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "hdfs://shared/checkpoints/" if key == "spark.checkpoint.dir" else default

    assert shared_folder(Session).startswith("hdfs://shared/checkpoints/gapline-")
