"""Sessions measured again only when their log changed."""

import re

import pytest
from pyspark.sql import functions as F

from parley.functions.events import complete
from parley.operators.primitives import primitives
from parley.plans import studies
from parley.plans.feature_store import FeatureStore
from workload.binding import price

ROWS = [(i, f"s{i % 12}", "USER_QUERY" if i % 3 else "RESPONSE.FINAL", 1000 + i, f"text {i}") for i in range(90)]


def log(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, session_id string, event_type string, s long, content string")
    return complete(df.withColumn("timestamp", F.timestamp_seconds("s")).drop("s"))


@pytest.fixture
def counted(spark):
    """A measure and the sessions it was asked for, run by run."""
    asked = []

    def measure(ev):
        asked.append(sorted(r.session_id for r in ev.select("session_id").distinct().collect()))
        return primitives(ev, price(spark)).select("session_id", "turn_count", "session_duration_ms")

    return measure, asked


def rows_of(df):
    return sorted(map(tuple, df.select("session_id", "turn_count", "session_duration_ms").collect()))


def test_store_follows_the_log(spark, tmp_path, counted):
    measure, asked = counted
    store = FeatureStore(spark, str(tmp_path), buckets=4)
    assert store.read() is None
    assert store.refresh(log(spark, ROWS[:40]), measure).version == 1
    assert rows_of(store.read()) == rows_of(primitives(log(spark, ROWS[:40]), price(spark)))
    # nothing new: the measure is not asked, no version is written
    assert store.refresh(log(spark, ROWS[:40]), measure).version is None and len(asked) == 1
    # two sessions grow, one comes, one goes
    later = [r for r in ROWS[:42] if r[1] != "s7"] + [(500, "new", "USER_QUERY", 5000, "x")]
    done = store.refresh(log(spark, later), measure)
    assert done.version == 2 and asked[1] == ["new", "s4", "s5"]
    assert {r.session_id: r.status for r in done.touched.collect()} == {"new": "added", "s4": "changed", "s5": "changed", "s7": "gone"}
    assert rows_of(store.read()) == rows_of(primitives(log(spark, later), price(spark)))
    # a part of the log leaves the other sessions alone
    store.refresh(log(spark, [r for r in ROWS if r[1] == "s4"]), measure, whole=False)
    assert asked[2] == ["s4"] and "new" in {r.session_id for r in store.read().collect()}
    before = rows_of(store.read())
    assert store.vacuum() == [1] or store.vacuum() == [] and rows_of(store.read()) == before
    assert rows_of(FeatureStore(spark, str(tmp_path), buckets=4).read()) == before
    assert FeatureStore(spark, str(tmp_path), "other lexicon", 4).read() is None


def test_a_lost_driver_leaves_the_old_state(spark, tmp_path, counted, monkeypatch):
    measure, asked = counted
    store = FeatureStore(spark, str(tmp_path), buckets=4)
    store.refresh(log(spark, ROWS[:40]), measure)
    before = rows_of(store.read())

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(FeatureStore, "_commit", lost)
        with pytest.raises(RuntimeError):
            store.refresh(log(spark, ROWS), measure)
    assert rows_of(store.read()) == before
    # the next update overwrites what was left behind
    assert store.refresh(log(spark, ROWS[:60]), measure).version == 2
    assert rows_of(store.read()) == rows_of(primitives(log(spark, ROWS[:60]), price(spark)))


def test_other_measures_need_another_signature(spark, tmp_path, counted):
    store = FeatureStore(spark, str(tmp_path))
    store.refresh(log(spark, ROWS[:20]), counted[0])
    with pytest.raises(ValueError):
        store.refresh(log(spark, ROWS), lambda ev: primitives(ev, price(spark)).select("session_id", "turn_count"))


def test_an_unchanged_log_is_read_for_its_fingerprint_alone(spark, tmp_path, counted):
    log(spark, ROWS).write.parquet(f"{tmp_path}/log")
    ev = spark.read.parquet(f"{tmp_path}/log")
    store = FeatureStore(spark, f"{tmp_path}/store", buckets=4)
    store.refresh(ev, counted[0])
    plan = store.compare(ev)._jdf.queryExecution().executedPlan().toString()
    assert sorted(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == ["event_id:bigint,session_id:string,timestamp:timestamp", "session_id:string,_fingerprint:string"]


def test_cohorts_from_a_store_equal_those_measured(spark, tmp_path, monkeypatch):
    s = spark.createDataFrame([(f"s{i}", f"s{i}", "t", "o", 1000 + i) for i in range(12)], "_id string, voice_session_id string, tenant string, assistant_origin_id string, at long")
    s = s.withColumn("start_time", F.timestamp_seconds("at")).withColumns({"assistant_id": F.lit("a"), "external_chat_session": F.lit(None).cast("string"),
                                                                            "chat_transport_provider": F.lit(None).cast("string")})
    study = {"study_type": "single", "tenant": "t", "assistant_origin_id": "o", "channel": "voice", "date_range": {"start": "1970-01-01 00:00:00", "end": "1970-01-02 00:00:00"}}
    lexicon = {"talk": {"keywords": ["text 1", "text 2"]}}
    ev, store = log(spark, ROWS), FeatureStore(spark, str(tmp_path), buckets=4)
    plain = studies.build_cohorts(s, ev, study, lexicon, price(spark))
    first = studies.build_cohorts(s, ev, study, lexicon, price(spark), store=store)
    monkeypatch.setattr(studies, "primitives", lambda *a, **k: pytest.fail("measured again"))
    again = studies.build_cohorts(s, ev, study, lexicon, price(spark), store=store)
    cols = sorted(plain.features.columns)
    want = sorted(map(str, plain.features.select(*cols).collect()))
    assert len(want) == 12 and all(sorted(map(str, c.features.select(*cols).collect())) == want for c in (first, again))
    assert sorted(map(str, again.text.select("session_id", "searchable_text").collect())) == sorted(map(str, plain.text.select("session_id", "searchable_text").collect()))
