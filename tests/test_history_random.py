"""Random histories against a plain Python account of the same rules."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scd2
from tidemark.operators.periods import periods


def expected_versions(rows, cutoffs, window_start):
    """Versions as (kind, number, owner, from, to) by walking the periods."""
    starts = [window_start - timedelta(seconds=1), *cutoffs[:-1]]
    seen = {}
    for kind, owner, at in rows:
        for i, (a, b) in enumerate(zip(starts, cutoffs)):
            if a < at <= b:
                seen.setdefault(kind, {}).setdefault(i, Counter())[owner] += 1
    out = []
    for kind, active in seen.items():
        versions = []
        for i in sorted(active):
            owner = min(active[i], key=lambda o: (-active[i][o], o))
            last = versions[-1] if versions else None
            if last and last["to"] == i - 1 and last["owner"] == owner:
                last["to"] = i
            else:
                versions.append({"owner": owner, "from": i, "to": i})
        for n, v in enumerate(versions, 1):
            final = v["to"] == len(cutoffs) - 1
            end = datetime(9999, 12, 31, 23, 59, 59) if final else cutoffs[v["to"]]
            out.append((kind, n, v["owner"], starts[v["from"]], end))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_versions_and_lookup(spark, params, seed):
    rng = random.Random(seed)
    spans = periods(spark, params)
    cutoffs = [r.vintage_cutoff_at for r in spans.orderBy("vintage_seq").collect()]
    edges = cutoffs + [c + timedelta(seconds=1) for c in cutoffs] + [params.window_start]
    rows = []
    for _ in range(120):
        at = rng.choice(edges) if rng.random() < 0.3 else datetime(2024, 12, 20) + timedelta(hours=rng.randrange(4300))
        rows.append((rng.choice("abcdefgh"), rng.choice("XYZ"), at))
    records = [(i, k, o, str(at)) for i, (k, o, at) in enumerate(rows)]
    df = spark.createDataFrame(records, "id int, kind string, owner string, at string")
    df = df.withColumn("at", F.col("at").cast("timestamp_ntz"))
    observed = scd2.observe(df, spans, params, ["kind"], "owner", "at")
    history = scd2.versions(observed, spans, ["kind"], "owning_owner", "version_key").cache()
    got = sorted(
        (r.kind, r.version_number, r.owning_owner, r.valid_from_at, r.valid_to_at) for r in history.collect()
    )
    want = expected_versions(rows, cutoffs, params.window_start)
    assert got == want
    assert scd2.overlapping(history, ["kind"]).count() == 0

    for bound in (params.broadcast_max_rows, 0):
        found = scd2.as_of_lookup(
            df, history, {"kind": F.col("kind")}, "at", "version_number", params.with_(broadcast_max_rows=bound)
        ).collect()
        assert len(found) == len(rows)
        for r in found:
            match = [n for k, n, _, a, b in want if k == r.kind and a < r["at"] <= b]
            assert [r.version_number] == (match or [None])
