from conftest import SF_SMALL, rows
from wattle.operators import audits, cleaning
from wattle.sources.fixtures import build_view
from wattle.sources.schemas import CONSUMPTION_SCHEMA
from wattle.streaming import audit_stream, clean_stream, read_stream, start


def test_stream_matches_batch(spark, tmp_path):
    raw = build_view(spark, SF_SMALL, "consumption_raw").select(*CONSUMPTION_SCHEMA.fieldNames())
    src = str(tmp_path / "incoming")
    raw.repartition(3).write.parquet(src)
    stream = read_stream(spark, src, CONSUMPTION_SCHEMA, max_files_per_trigger=1)

    q = start(clean_stream(stream, "consumption", "2026-03-02", "2026-03-09"), "wattle_clean",
              sink="memory", checkpoint=str(tmp_path / "ck1"))
    q.awaitTermination()
    want = cleaning.clean_consumption(cleaning.time_window(raw, "2026-03-02", "2026-03-09"))
    assert rows(spark.table("wattle_clean")) == rows(want.select(*spark.table("wattle_clean").columns))

    q2 = start(audit_stream(stream, audits.CONSUMPTION_RULES), "wattle_audit", sink="memory",
               output_mode="complete", checkpoint=str(tmp_path / "ck2"))
    q2.awaitTermination()
    assert rows(spark.table("wattle_audit")) == rows(audits.run_audits(raw, audits.CONSUMPTION_RULES))


def test_day_counts_stream_matches_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from wattle.operators import scenarios
    from wattle.plans import catalog
    from wattle.sources.schemas import SCENARIO_SCHEMA
    from wattle.streaming import day_counts_stream

    samples = catalog._scenario_input(spark, SF_SMALL)
    src = str(tmp_path / "samples")
    samples.orderBy("ts").coalesce(1).write.parquet(src)
    stream = read_stream(spark, src, SCENARIO_SCHEMA)
    q = start(day_counts_stream(stream), "wattle_days", sink="memory",
              checkpoint=str(tmp_path / "ck3"))
    q.awaitTermination()
    got = spark.table("wattle_days")
    last = samples.agg(F.max(F.to_date("ts"))).first()[0]
    want = scenarios.samples_per_day(scenarios.calendar_labels(samples)).filter(
        F.col("date") < F.lit(last))
    assert rows(got, "node", "date", "samples") == rows(want, "node", "date", "samples")
    assert got.filter("complete").count() == want.filter("samples = 96").count() > 0


def test_parquet_sink_restart_is_exactly_once(spark, tmp_path):
    from wattle.sources.schemas import VOLTAGE_SCHEMA
    raw = build_view(spark, SF_SMALL, "voltages_raw")
    src = str(tmp_path / "volts")
    raw.repartition(2).write.parquet(src)
    out, ck = str(tmp_path / "clean_volts"), str(tmp_path / "ck-volts")
    want = cleaning.clean_voltage(raw)
    for run in range(2):   # the second run resumes from the checkpoint: nothing new to write
        q = start(clean_stream(read_stream(spark, src, VOLTAGE_SCHEMA), "voltage"),
                  f"wattle_volts_{run}", path=out, checkpoint=ck)
        q.awaitTermination()
        got = spark.read.parquet(out)
        assert rows(got) == rows(want.select(*got.columns))


def test_power_stream_matches_batch_profiles(spark, tmp_path):
    """Cleaned interval readings as they arrive give the profile of the batch."""
    from wattle.operators import measures, power
    from wattle.sources.schemas import POWER_SCHEMA
    raw = build_view(spark, SF_SMALL, "power_raw").select(*POWER_SCHEMA.fieldNames()).where("MEDIDOR <= '1004'")
    src = str(tmp_path / "power")
    raw.repartition(3).write.parquet(src)
    out = str(tmp_path / "clean_power")
    q = start(clean_stream(read_stream(spark, src, POWER_SCHEMA, max_files_per_trigger=1), "power"), "wattle_power",
              path=out, checkpoint=str(tmp_path / "ck-power"))
    q.awaitTermination()

    def profile(clean):
        return rows(power.active_profile(measures.split(clean, "active")))

    assert profile(spark.read.parquet(out)) == profile(cleaning.clean_power(raw)) != []
