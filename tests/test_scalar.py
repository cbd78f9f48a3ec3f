import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gapline.config import DRUG_RULES
from gapline.functions import clock, scalar


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_duration_text(spark):
    got = column(spark, ["01:30", "27:13.2", "1:02:30", "5", "x", "", None, "30:75", "1,5", "1:2:3:4", "a:5"], scalar.duration_minutes)
    assert got[0] == 90
    assert got[1] == pytest.approx(27.22)
    assert got[2] == 62.5
    assert got[3] == 5
    assert got[4:7] == [None, None, None]
    assert got[7] == 30 * 60 + 75
    assert got[8] == 1.5
    assert got[9:] == [None, None]


def test_stage_minutes(spark):
    df = spark.createDataFrame(
        [(2.0, 1.0, 5.0), (None, 10.0, 25.0), (None, 30.0, 20.0), (None, None, 20.0), (None, 5.0, None)],
        "h double, b double, e double")
    assert [r[0] for r in df.select(scalar.stage_minutes("h", "b", "e")).collect()] == [120.0, 15.0, 20.0, None, None]


def test_signed_hms(spark):
    got = column(spark, [0.0, -1.5, 3661.25, -90000.0, None, 359999.96], scalar.signed_hms, "double")
    assert got[:5] == ["00:00:00.0", "-00:00:01.5", "01:01:01.2", "-25:00:00.0", None]
    assert got[5] == "99:59:60.0"


def test_safe_name(spark):
    got = column(spark, ["  HGB (g/dL) ", "__a--b__", "%%%", "", None, "x" * 100, "A+B_1"], scalar.safe_name)
    assert got == ["HGB_g_dL", "a_b", "unknown", "unknown", "unknown", "x" * 80, "A+B_1"]


def test_drug_rules_first_match_wins(spark):
    names = ["Oxytocin 5 IU", "cytotec", "METHERGIN inj", "Hartman`s", "Sodium Chloride 0.9% bag", "sodium chloride 3%",
             "oxytocin in lactated ringers", None, "paracetamol"]
    assert column(spark, names, lambda c: scalar.first_match(c, DRUG_RULES)) == [
        "OXYTOCIN", "MISOPROSTOL", "METHYLERGONOVINE", "LACTATED_RINGERS", "SODIUM_CHLORIDE_0_9", None, "OXYTOCIN", None, None]


def test_gender_and_pose(spark):
    assert column(spark, [" Female", "M", "0", "1", "נקבה", "זכר", "?", None], scalar.gender_code) == [
        0.0, 1.0, 0.0, 1.0, 0.0, 1.0, None, None]
    assert column(spark, ["  Head .", "BREECH!?", None, " ..."], scalar.pose_text) == ["head", "breech", "", ""]


def test_numbers(spark):
    assert column(spark, ["1.5", " 2 ", "nan", "x", None, ""], scalar.lenient_double) == [1.5, 2.0, None, None, None, None]
    assert column(spark, ["3", None, "-1", "x", "0"], scalar.positive_flag) == [1, 0, 0, 0, 0]
    assert column(spark, ["0", None, "2"], scalar.zero_flag) == [1, 1, 0]
    assert column(spark, [float("inf"), float("-inf"), float("nan"), 1.25, None], scalar.matrix_float, "double") == [
        None, None, None, 1.25, None]
    assert column(spark, [None, -1.0, 5.0, 50.0], lambda c: scalar.clip(c, 0, 10), "double") == [None, 0.0, 5.0, 10.0]
    assert column(spark, [1.0, 2.0, 3.0, 3.1], lambda c: scalar.within(c, (2, 3)), "double") == [None, 2.0, 3.0, None]


def test_strict_number_raises(spark):
    with pytest.raises(PySparkException):
        column(spark, ["1", "bad"], scalar.strict_double)


def test_derived_signals(spark):
    df = spark.createDataFrame([(120.0, 80.0, 60.0), (0.0, 80.0, 60.0), (None, 80.0, 60.0)], "s double, d double, p double")
    rows = df.select(scalar.mean_pressure("s", "d"), scalar.shock_index("p", "s"), scalar.pulse_pressure("s", "d")).collect()
    assert rows[0][0] == pytest.approx(93.3333333)
    assert rows[0][1:] == (0.5, 40.0)
    assert rows[1][1] is None and rows[2] == (None, None, None)
    bmi = spark.createDataFrame([(60.0, 170.0), (60.0, 0.0)], "w double, h double").select(scalar.body_mass_index("w", "h")).collect()
    assert bmi[0][0] == pytest.approx(20.761245) and bmi[1][0] is None


def test_parsing(spark):
    assert [str(x) for x in column(spark, ["2024-01-02 03:04:05.678901", "x 2024-01-02 03:04:05", "no"], clock.second_timestamp)] == [
        "2024-01-02 03:04:05", "2024-01-02 03:04:05", "None"]
    got = column(spark, ["2024-01-02 03:04:05", " 2024-01-02 03:04:05.25 ", "2024-01-02", None], clock.two_format_timestamp)
    assert [str(x) for x in got] == ["2024-01-02 03:04:05", "2024-01-02 03:04:05.250000", "None", "None"]
    with pytest.raises(PySparkException):
        column(spark, ["2024-13-02 03:04:05"], clock.two_format_timestamp)
    with pytest.raises(PySparkException):
        column(spark, ["2024-01-02 03:04:05"], clock.strict_timestamp)
    assert str(column(spark, ["2024/01/02 03:04:05.5"], clock.strict_timestamp)[0]) == "2024-01-02 03:04:05.500000"
    assert column(spark, ["soon"], clock.lenient_timestamp) == [None]


def test_cells_below_zero(spark):
    assert column(spark, [-1, 0, 1, -10, 9, 10], lambda c: clock.cell(c, 10), "long") == [-1, 0, 0, -1, 0, 1]
    assert column(spark, [-1, 0, 1, 10, 11], lambda c: clock.ceil_cell(c, 10), "long") == [0, 0, 1, 1, 2]
