"""Property test: the bucketed lag equals Spark's own lag on random data."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from wattle.operators.sequence import time_bucket, with_previous

T0 = dt.datetime(2026, 1, 1)

row = st.tuples(
    st.sampled_from([None, 1, 2, 3]),                         # key (NULL allowed)
    st.one_of(st.none(), st.integers(0, 20_000)),             # minutes (NULL allowed)
    st.one_of(st.none(), st.sampled_from([0.5, 1.0, 2.25])),  # value
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.lists(row, min_size=1, max_size=60),
       width=st.sampled_from([60, 3600, 86400, 10 ** 9]),
       target=st.sampled_from([None, 1, 3]),
       unique=st.booleans())
def test_with_previous_is_lag(spark, data, width, target, unique):
    seen, clean = set(), []
    for i, (k, m, v) in enumerate(data):
        if unique and (k, m) in seen:
            continue                  # the fast path requires a unique order per key
        seen.add((k, m))
        clean.append((k, None if m is None else T0 + dt.timedelta(minutes=m), i, v))
    df = spark.createDataFrame(clean, "k long, ts timestamp_ntz, id long, v double")
    order = ["ts"] if unique else ["ts", "id"]
    w = Window.partitionBy("k").orderBy(*order)
    want = rows(df.select("id", F.lag("v").over(w), F.lag("ts").over(w)))
    got = with_previous(df, ["k"], order, ["v"], time_bucket("ts", width),
                        order_is_unique=unique, target_rows_per_bucket=target)
    assert rows(got, "id", "prev_v", "prev_ts") == want
