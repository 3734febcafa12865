"""Worked examples of the scalar functions."""

from pyspark.sql import functions as F

from laplens.functions import ids, measures, text
from laplens.sources.bundle import hex_float


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_run_id_keeps_letters_and_digits(spark):
    a = [F.lit(x) for x in ("r03", " Assen ", "FP", "#7", "1.0")]
    b = [F.lit(x) for x in ("", "as-sen", None, "x", "bad")]
    row = one(spark, ids.run_id(*a), ids.run_id(*b), ids.lap_id(F.lit("X"), F.lit("zz")))
    assert tuple(row) == ("R03_ASSEN_FP_7_R1", "UNK_ASSEN_UNK_X_R1", "X_L0")


def test_lap_times_both_ways(spark):
    texts = ["1:37.455", "1'38,7", "1:38.7", "98.7", "DNF", "P6", "-", "", "1:30", None, "2:05.250 *"]
    row = one(spark, *[text.lap_seconds(F.lit(t).cast("string")) for t in texts])
    assert tuple(row) == (97.455, 98.7, 98.7, 98.7, None, None, None, None, None, None, 125.25)
    back = one(spark, *[text.lap_text(F.lit(v).cast("double")) for v in (97.455, 59.9996, 119.9999, 60.0, None)])
    assert tuple(back) == ("1:37.455", "1:00.000", "2:00.000", "1:00.000", "—")


def test_dates_in_every_format(spark):
    cases = {"25.1127": "2025-11-27", "26.0215": "2026-02-15", "27/11/2025": "2025-11-27", "2025-11-27": "2025-11-27",
             "27.11.2025": "2025-11-27", "11/27/2025": "2025-11-27", "soon": "soon"}
    row = one(spark, *[text.parse_date(F.lit(k)) for k in cases])
    assert list(row) == list(cases.values())
    assert one(spark, text.parse_date(F.lit("soon"), strict=True))[0] is None


def test_rounds_sessions_circuits(spark):
    row = one(spark, text.normal_round(F.lit("R01")), text.normal_round(F.lit("T03_X")), text.normal_round(F.lit(None), F.lit("T04 PLACE")),
              text.normal_round(F.lit("WORKSHOP")), text.normal_session(F.lit("l1")), text.normal_session(F.lit("L1"), profile="header"),
              text.normal_circuit(F.lit("workshop")), text.normal_circuit(F.lit("workshop"), "header"))
    assert tuple(row) == ("ROUND1", "TEST3", "TEST4", "WORKSHOP", "FP", "TEST_D1", "PHILLIP ISLAND", "WORKSHOP")


def test_text_helpers(spark):
    row = one(spark, text.short_number(F.lit(2.50)), text.short_number(F.lit(3.0)), text.short_number(F.lit(None).cast("double")),
              text.number_before_paren(F.lit("81.5 (wet)"), 80, 50, 120), text.number_before_paren(F.lit("900 (x)"), 80, 50, 120),
              text.truthy(F.lit(" yes")), text.lenient_double(F.lit("1,234.5")), text.lenient_double(F.lit("31,5"), True),
              text.trailing_number(F.lit("D2-X-09.MES")), text.trailing_number(F.lit("none")),
              text.log_circuit(F.lit("a\r\nPath for measurement: C:\\d\\R03_SOME_PLACE.26\\X.MES\r\n")))
    assert tuple(row) == ("2.5", "3", "—", 81.5, 80.0, True, 1234.5, 31.5, 9, 1, "Some Place")
    assert text.headers(["A\nB", None, "A B", ""]) == ["A B", "_col1", "A B_2", "_col3"]
    assert one(spark, text.tags(F.lit("Chatter, grip;\n ,Pump")))[0] == ["chatter", "grip", "pump"]


def test_deltas_and_tiers(spark):
    d = lambda a, b: measures.delta_text(F.lit(a), F.lit(b))
    m = lambda a, b, p: measures.delta_mark(F.lit(a), F.lit(b), F.lit(p))
    row = one(spark, d(1.0, 3.5), d(3.5, 1.0), d(1.0, 1.0), m(2.0, 1.0, "lower"), m(2.0, 1.0, "higher"), m(2.0, 1.0, "neutral"))
    assert tuple(row) == ("+2.5", "-2.5", "0", "better", "worse", "")
    tiers = {n: [one(spark, measures.tier(F.lit(i + 1), F.lit(n)))[0] for i in range(n)] for n in (1, 2, 3, 4)}
    assert tiers == {1: ["FAST"], 2: ["FAST", "SLOW"], 3: ["FAST", "MED", "SLOW"], 4: ["FAST", "MED", "MED", "SLOW"]} or \
        tiers[4] == ["FAST", "MED", "MED", "SLOW"]
    text_row = one(spark, measures.direction({"F": F.lit(0.1), "R": F.lit(1.26), "X": F.lit(None).cast("double")}))
    assert text_row[0] == "F:same  |  R:+1.3"


def test_wheel_loads_sum_to_weight(spark):
    w = measures.wheel_loads(*[F.lit(v) for v in (250.0, -8.0, 1.4, 0.65, 0.49)])
    f, r = one(spark, w["load_f"], w["load_r"])
    assert f > r and abs(f + r - 250 * 9.81) < 1e-6
    assert one(spark, measures.wheel_loads(*[F.lit(v) for v in (250.0, -30.0, 1.4, 0.65, 0.49)])["load_r"])[0] == 0.0


def test_hex_floats(spark):
    row = one(spark, *[hex_float(F.lit(h)) for h in ("3F800000", "3C800000", "C2C80000", "0", "00000001", "zz")])
    assert tuple(row) == (1.0, 1 / 64, -100.0, 0.0, 2.0 ** -149, 1.0)


def test_micros_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-03-31 02:30:00.123456' as ts")
    got = []
    for zone in ("UTC", "Europe/Berlin", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got.append(df.select(measures.micros(F.col("ts"))).first()[0])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert set(got) == {1711852200123456}
