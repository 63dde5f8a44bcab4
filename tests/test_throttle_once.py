"""The cooldown evaluates what makes its alerts once."""
import datetime as dt

from pyspark.sql import functions as F


def test_throttle_makes_its_alerts_once(spark):
    from hydrospark.operators.throttle import throttle
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(i):
        made.add(1)
        return i

    df = spark.createDataFrame([(i, i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=4 * i)) for i in range(90)],
                               "id long, k long, ts timestamp").withColumn("n", seen("id"))
    got = sorted(r["id"] for r in throttle(df, ["k"], 1200, order_cols=("ts", "id", "n")).collect())
    assert got == [i for i in range(90) if i // 3 % 2 == 0]  # every 12 minutes a key, two steps to 20
    assert made.value == 90
