from pyspark.sql import functions as F

from tidemark.operators.latest import latest_per_key
from tidemark.plans import ledger, staging


def base(key, **more):
    row = {"unique_key": key, "created_date": "2025-02-01 08:00:00", "_ingested_at": "2025-03-01 00:00:00"}
    return {**row, **more}


def test_latest_row_of_each_key(landing_rows):
    log = landing_rows(
        base("a", _ingested_at="2025-03-01 00:00:00", status="1"),
        base("a", _ingested_at="2025-03-03 00:00:00", status="3"),
        base("a", _ingested_at="2025-03-02 00:00:00", status="2"),
        base("b", closed_date=None, status="open"),
        base("b", closed_date="2025-02-05 00:00:00", status="shut"),
        base("c", city="x"),
        base("c", city="y"),
        base(None, city="n1"),
        base(None, city="n2"),
        base(" 1"),
        base("1"),
    )
    rows = staging.current_rows(log).collect()
    by_key = {r.unique_key: r for r in rows}
    assert len(rows) == 6
    assert by_key["a"].status == "3"
    assert by_key["b"].status == "shut"
    assert by_key["c"].city == "y"
    assert by_key[None].city == "n2"

    trimmed = latest_per_key(log, F.trim("unique_key"), ["_ingested_at", "closed_date"], keep_null_keys=True)
    assert trimmed.count() == 6 and trimmed.filter("unique_key is null").count() == 2

    first = latest_per_key(log, "unique_key", ["_ingested_at", "closed_date"], newest=False)
    assert {r.unique_key: r.status for r in first.collect()}["a"] == "1"


def test_partial_limit_runs_before_the_shuffle(landing_rows):
    plan = staging.current_rows(landing_rows(base("a")))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_typing_and_flags(landing_rows, params):
    log = landing_rows(
        base("ok", agency=" nypd", latitude="40.4", longitude="-74.3", complaint_type="Noise"),
        base("out", latitude="41.01", longitude="-73.9", agency="X", complaint_type="Noise"),
        base("half", latitude="40.7d", longitude="-70", agency="X", complaint_type="Noise"),
        base("warn", due_date="2025-01-01 00:00:00"),
    )
    rows = {r.request_id: r for r in staging.stage(log, params).collect()}
    assert rows["ok"].agency_code == "NYPD" and not rows["ok"].dq_warn_coords_outside_nyc
    assert rows["out"].latitude is None and rows["out"].longitude is None and rows["out"].dq_warn_coords_outside_nyc
    assert rows["half"].latitude is None and rows["half"].longitude == -70.0
    w = rows["warn"]
    assert w.dq_warn_missing_agency and w.dq_warn_missing_complaint_type and w.dq_warn_due_before_created
    assert not any(r.is_quarantined for r in rows.values())


def test_watermark_is_the_latest_known_change(landing_rows, params):
    log = landing_rows(
        base("a", closed_date="2025-02-09 00:00:00", resolution_action_updated_date="2025-02-03 00:00:00"),
        base("b"),
    )
    rows = {r.request_id: str(r.source_updated_at) for r in staging.stage(log, params).collect()}
    assert rows == {"a": "2025-02-09 00:00:00", "b": "2025-02-01 08:00:00"}


def test_first_reason_claims_the_row_and_counts_tie_out(landing_rows, params):
    log = landing_rows(
        base("", created_date="nonsense"),
        base("late", closed_date="2025-01-01 00:00:00"),
        base("undated", created_date=None, closed_date="2025-01-01 00:00:00"),
        base("year", created_date="2025"),
        base("good"),
        base("good", _ingested_at="2025-03-09 00:00:00"),
    )
    staged = staging.stage(log, params)
    out, kept = staging.quarantined(staged), staging.valid(staged)
    assert {r.request_id: r.exclusion_reason for r in out.collect()} == {
        "": "missing_request_id",
        "late": "closed_before_created",
        "undated": "unparseable_or_missing_created_date",
        "year": "unparseable_or_missing_created_date",
    }
    rows = [tuple(r) for r in ledger.ledger(log, staged, out, kept).drop("description").collect()]
    assert rows == [
        (1, "landed_rows", 6, None),
        (2, "deduplicated_to_current_state", 5, -1),
        (3, "quarantined", 4, None),
        (4, "valid_for_fact", 1, -4),
        (5, "reconciliation_residual", 0, None),
        (10, "quarantine_reason: closed_before_created", 1, None),
        (10, "quarantine_reason: missing_request_id", 1, None),
        (10, "quarantine_reason: unparseable_or_missing_created_date", 2, None),
    ]
    assert ledger.duplicate_ingestions(log).first().duplicate_ingestions == 1
