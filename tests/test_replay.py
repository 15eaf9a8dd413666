import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import as_ntz
from tidemark.operators.joins import append_new, upsert
from tidemark.operators.periods import periods
from tidemark.plans import replay

V1, V2 = ("2025-01-31 23:59:59", "2025-02-28 23:59:59")

REQUESTS = [
    ("settled_early", "2025-01-05 09:00:00", "2025-01-06 09:00:00"),
    ("restated", "2025-01-20 09:00:00", "2025-02-10 09:00:00"),
    ("closed_on_cutoff", "2025-01-10 09:00:00", "2025-01-31 23:59:59"),
    ("closed_after_cutoff", "2025-01-10 09:00:00", "2025-02-01 00:00:00"),
    ("created_later", "2025-02-15 09:00:00", "2025-02-16 09:00:00"),
    ("never_closes", "2025-01-25 09:00:00", None),
]


@pytest.fixture(scope="module")
def valid(ntz):
    df = ntz(REQUESTS, "request_id string, created_at string, closed_at string", ["created_at", "closed_at"])
    for c in replay.ATTRIBUTES:
        df = df.withColumn(c, F.lit("x"))
    return df.cache()


def states(df):
    return {r.request_id: r.status_at_vintage for r in df.collect()}


def test_state_as_of_each_cutoff(valid):
    assert states(replay.state_as_of(valid, as_ntz(V1))) == {
        "settled_early": "Closed",
        "restated": "Open",
        "closed_on_cutoff": "Closed",
        "closed_after_cutoff": "Open",
        "never_closes": "Open",
    }
    assert states(replay.state_as_of(valid, as_ntz(V2))) == {
        **{r[0]: "Closed" for r in REQUESTS},
        "never_closes": "Open",
    }


def test_unseen_close_leaves_no_duration_and_no_watermark(valid):
    row = replay.state_as_of(valid, as_ntz(V1)).filter("request_id = 'restated'").first()
    assert row.closed_at is None and row.days_to_close_at_vintage is None
    assert str(row.source_updated_at) == "2025-01-20 09:00:00"


def test_batch_holds_new_and_restated_rows(valid):
    assert set(states(replay.vintage_batch(valid, as_ntz(V1)))) == {r[0] for r in REQUESTS} - {"created_later"}
    assert set(states(replay.vintage_batch(valid, as_ntz(V2), as_ntz(V1)))) == {
        "restated", "closed_after_cutoff", "created_later",
    }


def test_append_keeps_first_state_and_merge_the_last(valid):
    first = replay.vintage_batch(valid, as_ntz(V1))
    second = replay.vintage_batch(valid, as_ntz(V2), as_ntz(V1))
    appended, merged = append_new(first, second), upsert(first, second)
    a, m = states(appended), states(merged)
    assert set(a) == set(m) == {r[0] for r in REQUESTS}
    assert {k for k in a if m[k] == "Closed" and a[k] == "Open"} == {"restated", "closed_after_cutoff"}
    stats = replay.measure(appended, merged).first()
    assert stats.rows_disagreeing == stats.closures_missed_by_append == 2
    assert (stats.append_row_count, stats.merge_distinct_requests) == (6, 6)


def test_closed_form_equals_the_loop(spark, valid, params, store):
    spans = periods(spark, params)
    looped, *tables = replay.replay(valid, spans, store)
    closed_form = replay.drift(valid, spans, params)
    key = ["vintage_seq"]
    assert [tuple(r) for r in looped.orderBy(*key).collect()] == [
        tuple(r) for r in closed_form.select(looped.columns).orderBy(*key).collect()
    ]
    for stored, table in zip(
        tables, (replay.append_only_table(valid, spans, params), replay.merge_table(valid, spans, params))
    ):
        assert stored.count() == table.count()
        assert stored.exceptAll(table.select(stored.columns)).count() == 0


def test_figures_by_changes_equal_the_comparison_of_whole_tables(spark, valid, params, store):
    spans = periods(spark, params)
    by_changes, compared = replay.replay(valid, spans, store), replay.replay_compared(valid, spans, store)
    for a, b in zip(by_changes, compared):
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(a.columns).collect()), key=repr)


def test_all_runs_are_dealt_in_one_pass(spark, valid, params, store):
    """One stored table for all runs, and neither final table is a shuffle away from it."""
    _, *tables = replay.replay(valid, periods(spark, params), store)
    assert len(os.listdir(f"{store.root}/comparison")) == 1
    for table in tables:
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange" not in plan


def test_repeated_ids_are_measured_on_both_tables(spark, valid, params, store):
    twice = valid.unionByName(valid.filter("request_id = 'restated'"))
    spans = periods(spark, params)
    log = replay.replay(twice, spans, store).log.orderBy("vintage_seq").collect()
    assert log[0].append_row_count == 6 and log[0].append_distinct_requests == 5


def test_replay_of_no_rows(spark, valid, params, store):
    log, appended, merged = replay.replay(valid.filter("false"), periods(spark, params), store)
    assert {r.merge_row_count for r in log.collect()} == {0} and log.first().merge_avg_days_to_close is None
    assert appended.collect() == merged.collect() == []


def test_closed_form_equals_the_loop_on_rows_around_the_cutoffs(spark, ntz, params, store):
    """Creations and closes before the window, on, and just after cutoffs."""
    instants = [
        "2024-11-30 10:00:00", "2024-12-31 23:59:59", "2025-01-31 23:59:59", "2025-01-31 23:59:59.5",
        "2025-02-01 00:00:00", "2025-02-28 23:59:59", "2025-05-31 23:59:59.999", "2025-06-15 23:59:59",
        "2025-06-16 00:00:00",
    ]
    rows = [(f"{i}-{j}", a, b) for i, a in enumerate(instants) for j, b in enumerate([*instants, None]) if not b or b >= a]
    valid = ntz(rows, "request_id string, created_at string, closed_at string", ["created_at", "closed_at"])
    for c in replay.ATTRIBUTES:
        valid = valid.withColumn(c, F.lit("x"))
    spans = periods(spark, params)
    looped = replay.replay(valid, spans, store).log
    got = replay.drift(valid, spans, params).select(looped.columns)
    assert [tuple(r) for r in looped.orderBy("vintage_seq").collect()] == [
        tuple(r) for r in got.orderBy("vintage_seq").collect()
    ]


def test_closed_forms_refuse_repeated_ids(spark, valid):
    assert replay.require_unique_ids(valid) is valid
    with pytest.raises(ValueError, match="1 request ids repeat"):
        replay.require_unique_ids(valid.unionByName(valid.filter("request_id = 'restated'")))


def test_summary_errors(spark, valid, params):
    spans = periods(spark, params)
    rows = replay.drift_summary(replay.drift(valid, spans, params)).orderBy("vintage_seq").collect()
    assert rows[0].closures_missed_by_append == 0 and rows[0].share_of_closures_missed == 0.0
    assert rows[1].closures_missed_by_append == 2 and rows[1].share_of_closures_missed == 2 / 5
    assert all(r.row_count_gap == 0 for r in rows)
    worst = replay.worst_vintage(replay.drift_summary(replay.drift(valid, spans, params))).first()
    assert worst.vintage_seq == 2
