"""SQL for every registered query, over the raw tables alone.

Each statement stands by itself: the named parts it needs are put in front of
it. The SQL says what a result is, by windows, scalar subqueries and plain
range conditions, and shares no plan with the DataFrame code.
"""

from __future__ import annotations

import re

from tidemark.catalog import queries as q
from tidemark.operators.snapshots import DATED, PROBE_FIELDS
from tidemark.plans import ledger as ledger_texts
from tidemark.plans.staging import WARN_FLAGS
from tidemark.sources.landing import LANDING_COLUMNS, SOURCE_COLUMNS
from tidemark.sources.tables import ORDER_PARAMS as P

BUILD = f"TIMESTAMP '{P.build_as_of}'"
OPEN_END = "TIMESTAMP '9999-12-31 23:59:59'"
WINDOW = P.maturity_window_days


def r6(expression: str) -> str:
    return f"floor(({expression}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


def secs(a: str, b: str) -> str:
    return f"date_diff('second', {a}, {b})"


def in_days(seconds: str) -> str:
    return f"(({seconds})::DOUBLE / 86400.0::DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif({b}, 0)::DOUBLE)"


def key_of(*parts: str) -> str:
    return "md5(" + " || '||' || ".join(f"coalesce(({p})::VARCHAR, '<<null>>')" for p in parts) + ")"


# Named parts: name -> (parts it reads, SQL).
PARTS: dict[str, tuple[list[str], str]] = {}

def content_of(*columns: str) -> str:
    """The same sum over hashes of whole rows as the query makes."""
    whole = ", ".join(f"coalesce({c}, '~')" for c in columns)
    return f"sum(('0x' || substr(md5(concat_ws('|', {whole})), 1, 12))::BIGINT)::BIGINT"


PARTS["landing"] = (
    [],
    f"""
    SELECT
      CASE WHEN l_discount = 0.1::DOUBLE AND l_tax = 0.08::DOUBLE AND l_quantity = 50 THEN '  '
           WHEN l_discount = 0.1::DOUBLE AND l_tax = 0.08::DOUBLE AND l_quantity = 49 THEN NULL
           ELSE l_orderkey::VARCHAR END AS unique_key,
      CASE WHEN o_totalprice < 2000 THEN 'not recorded'
           WHEN o_totalprice < 4000 THEN strftime(o_orderdate, '%Y')
           ELSE o_orderdate::VARCHAR END AS created_date,
      CASE WHEN l_linestatus = 'F' THEN l_shipdate::VARCHAR END AS closed_date,
      CASE WHEN c_acctbal < -900 THEN '' ELSE lower(c_mktsegment) END AS agency,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Department of ' || c_mktsegment
           WHEN '5-LOW' THEN NULL ELSE c_mktsegment || ' department' END AS agency_name,
      CASE WHEN p_size = 50 THEN '   ' ELSE p_type END AS complaint_type,
      CASE WHEN p_size <> 1 THEN p_brand END AS descriptor,
      l_returnflag AS location_type,
      CASE WHEN c_custkey % 50 = 49 THEN '' ELSE (c_custkey % 50)::VARCHAR END AS incident_zip,
      c_name AS incident_address, p_name AS street_name, l_returnflag AS address_type, ' ' || n_name AS city,
      CASE WHEN o_totalprice < 8000 THEN ' ' WHEN o_orderstatus = 'F' THEN 'Closed'
           WHEN o_orderstatus = 'O' THEN 'Open' ELSE 'In Progress' END AS status,
      (CASE WHEN o_totalprice > 495000 THEN o_orderdate - INTERVAL 1 DAY
            ELSE o_orderdate + INTERVAL 30 DAY END)::VARCHAR AS due_date,
      l_shipdate::VARCHAR AS resolution_action_updated_date,
      n_name AS community_board,
      CASE WHEN c_nationkey = 0 THEN 'Unspecified' ELSE lower(r_name) END AS borough,
      o_orderpriority AS open_data_channel_type,
      ((40300 + (o_custkey * 37) % 800) // 1000)::VARCHAR || '.'
        || lpad(((40300 + (o_custkey * 37) % 800) % 1000)::VARCHAR, 3, '0')
        || CASE WHEN c_acctbal > 9900 THEN 'd' ELSE '' END AS latitude,
      '-' || ((73600 + (o_custkey * 53) % 800) // 1000)::VARCHAR || '.'
        || lpad(((73600 + (o_custkey * 53) % 800) % 1000)::VARCHAR, 3, '0') AS longitude,
      (TIMESTAMP '2001-08-01 06:00:00' + to_days(l_linenumber::INTEGER))::VARCHAR AS _ingested_at
    FROM lineitem
    JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey
    JOIN part ON p_partkey = l_partkey
    """,
)

_rest = [c for c in LANDING_COLUMNS if c not in ("_ingested_at", "closed_date")]
NEWEST_FIRST = ", ".join(f"{c} DESC NULLS LAST" for c in ["_ingested_at", "closed_date", *_rest])

OLDEST_FIRST = NEWEST_FIRST.replace("DESC NULLS LAST", "ASC NULLS FIRST")


def newest(where: str = "TRUE") -> str:
    return (
        f"SELECT * FROM landing WHERE {where} "
        f"QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY {NEWEST_FIRST}) = 1"
    )


PARTS["newest"] = (["landing"], newest())


def text(column: str, name: str | None = None, wrap: str = "") -> str:
    inner = f"{wrap}({column})" if wrap else column
    return f"nullif(trim({inner}), '') AS {name or column}"


PARTS["staged"] = (
    ["newest"],
    f"""
    WITH t AS (
      SELECT trim(unique_key) AS request_id,
        try_cast(created_date AS TIMESTAMP) AS created_at, try_cast(closed_date AS TIMESTAMP) AS closed_at,
        try_cast(due_date AS TIMESTAMP) AS due_at,
        try_cast(resolution_action_updated_date AS TIMESTAMP) AS resolution_updated_at,
        try_cast(_ingested_at AS TIMESTAMP) AS ingested_at,
        {text("agency", "agency_code", "upper")}, {text("borough", wrap="upper")}, {text("status", "status_raw")},
        {", ".join(text(c) for c in (
            "agency_name", "complaint_type", "descriptor", "location_type", "community_board", "incident_zip",
            "incident_address", "street_name", "address_type", "city", "open_data_channel_type"))},
        try_cast(latitude AS DOUBLE) AS lat, try_cast(longitude AS DOUBLE) AS lon
      FROM newest
    ), f AS (
      SELECT *,
        coalesce(request_id, '') = '' AS dq_fatal_missing_request_id,
        created_at IS NULL AS dq_fatal_missing_created_at,
        CASE WHEN closed_at IS NULL THEN FALSE ELSE closed_at < created_at END AS dq_fatal_closed_before_created,
        lat IS NOT NULL AND lon IS NOT NULL AND
          (lat < {P.lat_bounds[0]}::DOUBLE OR lat > {P.lat_bounds[1]}::DOUBLE
           OR lon < {P.lon_bounds[0]}::DOUBLE OR lon > {P.lon_bounds[1]}::DOUBLE) AS dq_warn_coords_outside_nyc,
        complaint_type IS NULL AS dq_warn_missing_complaint_type,
        agency_code IS NULL AS dq_warn_missing_agency,
        CASE WHEN due_at IS NULL THEN FALSE ELSE due_at < created_at END AS dq_warn_due_before_created
      FROM t
    )
    SELECT * EXCLUDE (lat, lon),
      CASE WHEN NOT dq_warn_coords_outside_nyc THEN {r6("lat")} END AS latitude,
      CASE WHEN NOT dq_warn_coords_outside_nyc THEN {r6("lon")} END AS longitude,
      greatest(created_at, coalesce(resolution_updated_at, created_at), coalesce(closed_at, created_at))
        AS source_updated_at,
      (dq_fatal_missing_request_id OR dq_fatal_missing_created_at OR dq_fatal_closed_before_created) AS is_quarantined
    FROM f
    """,
)
PARTS["valid"] = (
    ["staged"],
    """SELECT * EXCLUDE (dq_fatal_missing_request_id, dq_fatal_missing_created_at,
       dq_fatal_closed_before_created, is_quarantined) FROM staged WHERE NOT is_quarantined""",
)
PARTS["excluded"] = (
    ["staged"],
    """SELECT request_id, created_at, closed_at, agency_code, complaint_type, status_raw, ingested_at,
       CASE WHEN dq_fatal_missing_request_id THEN 'missing_request_id'
            WHEN dq_fatal_missing_created_at THEN 'unparseable_or_missing_created_date'
            ELSE 'closed_before_created' END AS exclusion_reason,
       dq_fatal_missing_request_id, dq_fatal_missing_created_at, dq_fatal_closed_before_created
     FROM staged WHERE is_quarantined""",
)
PARTS["periods"] = (
    [],
    f"""
    WITH ends AS (
      SELECT last_day(m::DATE) AS d
      FROM generate_series(date_trunc('month', DATE '{P.vintage_first}')::TIMESTAMP,
                           date_trunc('month', {BUILD})::TIMESTAMP, INTERVAL 1 MONTH) AS g(m)
      WHERE last_day(m::DATE) <= {BUILD}::DATE
      UNION SELECT {BUILD}::DATE
    )
    SELECT d AS vintage_date,
      d::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 SECOND AS cutoff,
      row_number() OVER (ORDER BY d)::BIGINT AS seq,
      d = (SELECT max(d) FROM ends) AS is_final_vintage,
      coalesce(lag(d) OVER (ORDER BY d)::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 SECOND,
               TIMESTAMP '{P.window_start}' - INTERVAL 1 SECOND) AS opens_after
    FROM ends
    """,
)
PARTS["observed"] = (
    ["valid", "periods"],
    """
    SELECT vintage_date, seq AS vintage_seq, complaint_type, coalesce(descriptor, '<<none>>') AS descriptor,
      coalesce(agency_code, 'UNKNOWN') AS agency, count(*) AS n
    FROM valid JOIN periods ON created_at > opens_after AND created_at <= cutoff
    WHERE complaint_type IS NOT NULL GROUP BY ALL
    """,
)
PARTS["observations"] = (
    ["observed"],
    """
    SELECT vintage_date, vintage_seq, complaint_type, descriptor, agency AS owning_agency_code,
      (sum(n) OVER p)::BIGINT AS period_request_count,
      (count(*) OVER p)::BIGINT AS distinct_agencies_in_period
    FROM observed
    WINDOW p AS (PARTITION BY vintage_seq, complaint_type, descriptor)
    QUALIFY row_number() OVER (PARTITION BY vintage_seq, complaint_type, descriptor ORDER BY n DESC, agency) = 1
    """,
)
PARTS["history"] = (
    ["observations", "periods", "valid"],
    f"""
    WITH o AS (
      SELECT o.*, p.opens_after, p.cutoff,
        lag(vintage_seq) OVER w AS before_seq, lag(owning_agency_code) OVER w AS before_owner
      FROM observations o JOIN periods p ON p.seq = o.vintage_seq
      WINDOW w AS (PARTITION BY complaint_type, descriptor ORDER BY vintage_seq)
    ), v AS (
      SELECT *, sum(CASE WHEN before_seq + 1 = vintage_seq AND before_owner = owning_agency_code THEN 0 ELSE 1 END)
        OVER (PARTITION BY complaint_type, descriptor ORDER BY vintage_seq)::BIGINT AS version_number
      FROM o
    ), g AS (
      SELECT complaint_type, descriptor, version_number, any_value(owning_agency_code) AS owning_agency_code,
        min(vintage_date) AS valid_from_vintage_date, max(vintage_date) AS valid_to_vintage_date,
        min(opens_after) AS valid_from_at, max(cutoff) AS valid_to_at_inclusive,
        max(vintage_seq) = (SELECT max(seq) FROM periods) AS is_current,
        (max(vintage_seq) - min(vintage_seq) + 1)::BIGINT AS periods_covered,
        sum(period_request_count)::BIGINT AS request_count_in_version,
        max(distinct_agencies_in_period)::BIGINT AS max_distinct_agencies_in_a_period
      FROM v GROUP BY ALL
    )
    SELECT {key_of("complaint_type", "descriptor", "version_number")} AS complaint_type_key,
      complaint_type, descriptor, version_number, owning_agency_code, valid_from_vintage_date,
      valid_to_vintage_date, valid_from_at, valid_to_at_inclusive,
      CASE WHEN is_current THEN {OPEN_END} ELSE valid_to_at_inclusive END AS valid_to_at,
      is_current, periods_covered, request_count_in_version, max_distinct_agencies_in_a_period,
      FALSE AS is_unknown_member
    FROM g
    UNION ALL
    SELECT 'UNKNOWN', NULL, NULL, 0, 'UNKNOWN', TIMESTAMP '{P.window_start}'::DATE, DATE '9999-12-31',
      TIMESTAMP '1900-01-01', {OPEN_END}, {OPEN_END}, TRUE, 0,
      (SELECT count(*) FROM valid WHERE complaint_type IS NULL), 0, TRUE
    """,
)
PARTS["agencies"] = (
    ["valid"],
    """
    WITH o AS (
      SELECT agency_code, agency_name, count(*) AS n FROM valid WHERE agency_code IS NOT NULL GROUP BY ALL
    )
    SELECT agency_code AS agency_key, agency_code, agency_name,
      (SELECT sum(n) FROM o i WHERE i.agency_code = o.agency_code)::BIGINT AS request_count,
      (SELECT count(*) FROM o i WHERE i.agency_code = o.agency_code)::BIGINT AS distinct_names_seen,
      FALSE AS is_unknown_member
    FROM o
    QUALIFY row_number() OVER (PARTITION BY agency_code ORDER BY n DESC, agency_name ASC NULLS LAST) = 1
    UNION ALL
    SELECT 'UNKNOWN', NULL, 'Unknown or missing agency',
      (SELECT count(*) FROM valid WHERE agency_code IS NULL), 0, TRUE
    """,
)
_GEO = [f"coalesce({c}, 'UNKNOWN')" for c in ("borough", "community_board", "incident_zip")]
PARTS["places"] = (
    ["valid"],
    f"""
    SELECT {key_of(*_GEO)} AS geography_key, {_GEO[0]} AS borough, {_GEO[1]} AS community_board,
      {_GEO[2]} AS incident_zip, {_GEO[0]} IN ('UNKNOWN', 'Unspecified', 'UNSPECIFIED') AS is_borough_unknown,
      {_GEO[2]} = 'UNKNOWN' AS is_zip_unknown, count(*)::BIGINT AS request_count
    FROM valid GROUP BY ALL
    """,
)
PARTS["facts"] = (
    ["valid", "history"],
    f"""
    WITH j AS (
      SELECT v.*, coalesce(h.complaint_type_key, 'UNKNOWN') AS complaint_type_key,
        {secs("v.created_at", "v.closed_at")} AS to_close, {secs("v.created_at", BUILD)} AS to_build
      FROM valid v LEFT JOIN history h
        ON NOT h.is_unknown_member AND h.complaint_type = v.complaint_type
       AND h.descriptor = coalesce(v.descriptor, '<<none>>')
       AND v.created_at > h.valid_from_at AND v.created_at <= h.valid_to_at
    )
    SELECT request_id, created_at::DATE AS created_date_key, closed_at::DATE AS closed_date_key,
      coalesce(agency_code, 'UNKNOWN') AS agency_key, complaint_type_key, {key_of(*_GEO)} AS geography_key,
      created_at, closed_at, due_at, resolution_updated_at, ingested_at, source_updated_at,
      complaint_type, descriptor, status_raw, location_type, open_data_channel_type, latitude, longitude,
      closed_at IS NOT NULL AS is_closed, {r6(in_days("to_close"))} AS days_to_close,
      {r6(in_days("coalesce(to_close, to_build)"))} AS age_days,
      to_build >= {WINDOW} * 86400 AS is_mature_at_build,
      CASE WHEN to_close IS NOT NULL THEN to_close <= {P.sla_target_days} * 86400
           WHEN to_build > {P.sla_target_days} * 86400 THEN FALSE END AS is_within_target,
      {", ".join(WARN_FLAGS)}
    FROM j
    """,
)
# The fact with whole seconds, cohort and borough, as the marts read it.
PARTS["measured"] = (
    ["facts", "valid"],
    f"""
    SELECT f.*, date_trunc('month', f.created_at)::DATE AS cohort_month, {_GEO[0]} AS borough,
      {secs("f.created_at", "f.closed_at")} AS s
    FROM facts f JOIN (SELECT request_id, borough FROM valid) USING (request_id)
    """,
)
AGE = in_days(secs("(cohort_month + INTERVAL 1 MONTH - INTERVAL 1 SECOND)", BUILD))
IN_WINDOW = f"s <= {WINDOW} * 86400"
MEAN = in_days(ratio("sum(s)", "count(s)"))
WINDOW_MEAN = in_days(ratio(f"sum(s) FILTER ({IN_WINDOW})", f"count(*) FILTER ({IN_WINDOW})"))
WINDOW_RATE = ratio(f"count(*) FILTER ({IN_WINDOW})", "count(*)")
PARTS["months"] = (
    ["measured"],
    f"""
    SELECT cohort_month, agency_key, complaint_type_key, complaint_type, borough, is_cohort_mature,
      count(*)::BIGINT AS request_volume, count(s)::BIGINT AS closed_volume,
      {ratio("count(s)", "count(*)")} AS closure_rate,
      CASE WHEN is_cohort_mature THEN {WINDOW_RATE} END AS closure_rate_at_maturity,
      {MEAN} AS mean_days_to_close, {in_days("median(s)")} AS median_days_to_close,
      CASE WHEN is_cohort_mature THEN {WINDOW_MEAN} END AS mean_days_to_close_matured,
      CASE WHEN is_cohort_mature THEN 1.0::DOUBLE - {WINDOW_RATE} END AS unresolved_share_at_maturity,
      (count(*) - count(s))::BIGINT AS backlog_open_count,
      {ratio("count(*) FILTER (is_within_target)", "count(is_within_target)")} AS on_time_rate,
      count(is_within_target)::BIGINT AS on_time_denominator,
      count(*) FILTER (is_within_target)::BIGINT AS on_time_volume, sum(s)::BIGINT AS closed_seconds,
      count(*) FILTER ({IN_WINDOW})::BIGINT AS window_volume, (sum(s) FILTER ({IN_WINDOW}))::BIGINT AS window_seconds
    FROM (SELECT *, {AGE} >= {WINDOW} AS is_cohort_mature FROM measured)
    GROUP BY cohort_month, agency_key, complaint_type_key, complaint_type, borough, is_cohort_mature
    """,
)
PARTS["cohorts"] = (
    ["measured"],
    f"""
    WITH c AS (
      SELECT cohort_month, {AGE} AS age, {AGE} >= {WINDOW} AS mature, count(*) AS n, count(s) AS closed,
        {MEAN} AS naive, {in_days("median(s)")} AS naive_median, {WINDOW_MEAN} AS corrected,
        {in_days(f"median(s) FILTER ({IN_WINDOW})")} AS corrected_median, {WINDOW_RATE} AS rate
      FROM measured GROUP BY ALL
    )
    SELECT cohort_month, {r6("age")} AS cohort_age_days_at_build, mature AS is_cohort_mature,
      n::BIGINT AS cohort_size, closed::BIGINT AS closed_so_far, {r6(ratio("closed", "n"))} AS closure_rate_so_far,
      {r6("naive")} AS naive_mean_days_to_close, {r6("naive_median")} AS naive_median_days_to_close,
      CASE WHEN mature THEN {r6("corrected")} END AS matured_mean_days_to_close,
      CASE WHEN mature THEN {r6("corrected_median")} END AS matured_median_days_to_close,
      CASE WHEN mature THEN {r6("1.0::DOUBLE - rate")} END AS unresolved_share_at_maturity,
      CASE WHEN mature THEN {r6("corrected - naive")} END AS naive_understatement_days,
      CASE WHEN mature AND naive > 0 THEN {r6("(corrected - naive) / naive")} END AS naive_understatement_pct
    FROM c
    """,
)
PARTS["wide"] = (
    ["months", "agencies", "history"],
    """
    SELECT m.cohort_month, strftime(m.cohort_month, '%Y-%m') AS cohort_year_month,
      year(m.cohort_month)::BIGINT AS cohort_year, quarter(m.cohort_month)::BIGINT AS cohort_quarter,
      m.agency_key AS agency_code, a.agency_name, m.complaint_type, h.descriptor,
      h.owning_agency_code AS complaint_type_owning_agency, h.version_number AS complaint_type_version,
      h.is_current AS complaint_type_version_is_current, m.borough, m.is_cohort_mature,
      m.request_volume, m.closed_volume, m.on_time_denominator, m.backlog_open_count, m.closure_rate,
      m.closure_rate_at_maturity, m.mean_days_to_close, m.median_days_to_close, m.mean_days_to_close_matured,
      m.unresolved_share_at_maturity, m.on_time_rate,
      m.closed_seconds / 86400.0::DOUBLE AS days_to_close_total,
      CASE WHEN m.is_cohort_mature THEN m.window_seconds / 86400.0::DOUBLE END AS days_to_close_matured_total,
      CASE WHEN m.is_cohort_mature THEN m.window_volume::DOUBLE END AS closed_within_window_volume,
      CASE WHEN m.on_time_denominator > 0 THEN m.on_time_volume::DOUBLE END AS on_time_numerator,
      m.closed_seconds, CASE WHEN m.is_cohort_mature THEN m.window_seconds END AS matured_seconds
    FROM months m LEFT JOIN agencies a USING (agency_key) LEFT JOIN history h USING (complaint_type_key)
    """,
)
_ATTRS = "agency_code, complaint_type, descriptor, borough, community_board, incident_zip"


def state(source: str, known: str, loaded: str) -> str:
    """Columns both loads store, given the close that each row knows."""
    return f"""
    SELECT request_id, created_at, known AS closed_at,
      CASE WHEN known IS NULL THEN 'Open' ELSE 'Closed' END AS status_at_vintage,
      known IS NOT NULL AS is_closed_at_vintage,
      {in_days(secs("created_at", "known"))} AS days_to_close_at_vintage,
      greatest(created_at, coalesce(known, created_at)) AS source_updated_at,
      {_ATTRS}, loaded AS loaded_at_vintage
    FROM (SELECT *, {known} AS known, {loaded} AS loaded FROM {source})
    """


_AT = f"TIMESTAMP '{q.CUTOFF}'"
PARTS["as_of"] = (
    ["valid"],
    state(f"(SELECT * FROM valid WHERE created_at <= {_AT})", f"CASE WHEN closed_at <= {_AT} THEN closed_at END", _AT),
)
PARTS["seen"] = (
    ["valid", "periods"],
    """
    SELECT v.*, (SELECT min(cutoff) FROM periods WHERE v.created_at <= cutoff) AS first_cutoff,
      (SELECT min(cutoff) FROM periods WHERE v.closed_at <= cutoff) AS close_cutoff
    FROM valid v
    """,
)
PARTS["append_only"] = (
    ["seen"],
    state(
        "(SELECT * FROM seen WHERE first_cutoff IS NOT NULL)",
        "CASE WHEN closed_at <= first_cutoff THEN closed_at END",
        "first_cutoff",
    ),
)
PARTS["merged"] = (
    ["seen"],
    state(
        "(SELECT * FROM seen WHERE first_cutoff IS NOT NULL)",
        "CASE WHEN close_cutoff IS NOT NULL THEN closed_at END",
        "greatest(first_cutoff, coalesce(close_cutoff, first_cutoff))",
    ),
)
# Both tables at every vintage, row by row.
PARTS["drifted"] = (
    ["seen", "periods"],
    f"""
    WITH x AS (
      SELECT p.seq, p.vintage_date, request_id,
        closed_at <= first_cutoff AS a, closed_at <= p.cutoff AS m, {secs("created_at", "closed_at")} AS s
      FROM periods p LEFT JOIN seen ON first_cutoff <= p.cutoff
    )
    SELECT seq AS vintage_seq, vintage_date,
      count(request_id)::BIGINT AS append_row_count, count(DISTINCT request_id)::BIGINT AS append_distinct_requests,
      count(*) FILTER (a)::BIGINT AS append_closed_count,
      {in_days(ratio("sum(s) FILTER (a)", "count(*) FILTER (a)"))} AS append_avg_days_to_close,
      count(request_id)::BIGINT AS merge_row_count, count(DISTINCT request_id)::BIGINT AS merge_distinct_requests,
      count(*) FILTER (m)::BIGINT AS merge_closed_count,
      {in_days(ratio("sum(s) FILTER (m)", "count(*) FILTER (m)"))} AS merge_avg_days_to_close,
      count(*) FILTER (coalesce(a, FALSE) <> coalesce(m, FALSE))::BIGINT AS rows_disagreeing,
      count(*) FILTER (m AND NOT a)::BIGINT AS closures_missed_by_append
    FROM x GROUP BY ALL
    """,
)
_AR = ratio("append_closed_count", "append_row_count")
_MR = ratio("merge_closed_count", "merge_row_count")
PARTS["drift_errors"] = (
    ["drifted"],
    f"""
    SELECT vintage_seq, vintage_date, append_row_count, merge_row_count,
      merge_row_count - append_row_count AS row_count_gap, append_closed_count, merge_closed_count,
      merge_closed_count - append_closed_count AS closures_gap, closures_missed_by_append, rows_disagreeing,
      {r6(ratio("closures_missed_by_append", "merge_closed_count"))} AS share_of_closures_missed,
      {r6(_AR)} AS append_closure_rate, {r6(_MR)} AS merge_closure_rate, {r6(f"{_AR} - {_MR}")} AS closure_rate_error,
      {r6("append_avg_days_to_close")} AS append_avg_days_to_close,
      {r6("merge_avg_days_to_close")} AS merge_avg_days_to_close,
      {r6("append_avg_days_to_close - merge_avg_days_to_close")} AS avg_days_error,
      CASE WHEN merge_avg_days_to_close > 0 THEN
        {r6("(append_avg_days_to_close - merge_avg_days_to_close) / merge_avg_days_to_close")} END AS avg_days_error_pct
    FROM drifted
    """,
)
_PROBE_FIRST = ", ".join(
    f"{c} DESC NULLS LAST" for c in ["_ingested_at", "closed_date", *PROBE_FIELDS, "location_type"]
)


def probed(where: str = "TRUE") -> str:
    """The newest state of the probe's fields; those fields alone break ties."""
    return (
        f"SELECT * FROM landing WHERE {where} "
        f"QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY {_PROBE_FIRST}) = 1"
    )


PARTS["captured"] = (["landing"], probed(f"_ingested_at <= '{q.CAPTURED_UPTO}'"))
PARTS["rechecked"] = (
    ["landing"],
    f"SELECT * FROM ({probed()}) WHERE location_type IS DISTINCT FROM '{q.PURGED}'",
)


def changed_flag(f: str) -> str:
    return f"(b.unique_key IS NOT NULL AND a.{f} IS DISTINCT FROM b.{f})"


_CHANGED = ", ".join(f"CASE WHEN {changed_flag(f)} THEN '{f}' END" for f in PROBE_FIELDS)
PARTS["diffed"] = (
    ["captured", "rechecked"],
    f"""
    SELECT a.unique_key, b.unique_key IS NULL AS disappeared, concat_ws(',', {_CHANGED}) AS changed_fields,
      a.closed_date AS closed_before, b.closed_date AS closed_after,
      {", ".join(f"{changed_flag(f)} AS is_{f}" for f in PROBE_FIELDS)}
    FROM captured a LEFT JOIN rechecked b ON a.unique_key = b.unique_key
    WHERE a.unique_key IS NOT NULL
    """,
)


def rounded(part: str, floats: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{r6(c)} AS {c}' for c in floats)}) FROM {part}"


_STATE_FLOATS = ["days_to_close_at_vintage"]
_MONTH_FLOATS = [
    "closure_rate", "closure_rate_at_maturity", "mean_days_to_close", "median_days_to_close",
    "mean_days_to_close_matured", "unresolved_share_at_maturity", "on_time_rate",
]
_WIDE_FLOATS = [
    *_MONTH_FLOATS, "days_to_close_total", "days_to_close_matured_total", "closed_within_window_volume",
    "on_time_numerator",
]

# Query name -> (parts it reads, SQL).
FINAL: dict[str, tuple[list[str], str]] = {}


def final(name: str, parts: list[str], sql: str) -> None:
    FINAL[name] = (parts, sql)


final(
    "landing_profile", ["landing"],
    """SELECT 'slice' AS scope, substr(created_date, 1, 7) AS slice, count(*) AS row_count,
         count(DISTINCT unique_key) AS distinct_keys FROM landing GROUP BY ALL
       UNION ALL SELECT 'all', NULL, count(*), count(DISTINCT unique_key) FROM landing""",
)
final(
    "source_slice", ["landing"],
    """SELECT agency, count(*) AS row_count, count(DISTINCT unique_key) AS distinct_keys FROM landing
       WHERE created_date >= '1997-01-01 00:00:00' AND created_date < '1997-04-01 00:00:00'
         AND agency IN ('building', 'furniture') GROUP BY ALL""",
)
final(
    "source_aggregates", ["landing"],
    "SELECT count(*) AS row_count, max(created_date) AS max_created_date FROM landing",
)
final(
    "month_slices", ["landing"],
    f"""WITH m AS (SELECT m FROM generate_series(date_trunc('month', TIMESTAMP '{P.window_start}'),
          TIMESTAMP '{P.window_end}', INTERVAL 1 MONTH) AS g(m) WHERE m < TIMESTAMP '{P.window_end}')
       SELECT strftime(m, '%Y-%m') AS slice, greatest(m, TIMESTAMP '{P.window_start}') AS slice_start,
         least(m + INTERVAL 1 MONTH, TIMESTAMP '{P.window_end}') AS slice_end,
         (SELECT count(*) FROM landing WHERE substr(created_date, 1, 7) = strftime(m, '%Y-%m')) AS row_count FROM m""",
)
final(
    "manifest_tieout", ["landing"],
    f"""WITH m AS (
         SELECT slice, n + CASE WHEN slice = '{q.WRONG_SLICE}' THEN {q.EXTRA_ROWS} ELSE 0 END AS n FROM (
           SELECT CASE WHEN o_totalprice < 2000 THEN 'not rec' WHEN o_totalprice < 4000 THEN year(o_orderdate)::VARCHAR
                       ELSE strftime(o_orderdate, '%Y-%m') END AS slice, count(*) AS n
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
         WHERE slice <> '{q.MISSING_SLICE}' UNION ALL SELECT '{q.EXTRA_SLICE}', {q.EXTRA_ROWS}),
       l AS (SELECT substr(created_date, 1, 7) AS slice, count(*) AS n FROM landing GROUP BY 1)
       SELECT slice, coalesce(m.n, 0)::BIGINT AS manifest_rows, coalesce(l.n, 0)::BIGINT AS landed_rows,
         coalesce(m.n, 0) = coalesce(l.n, 0) AS ties_out FROM m FULL JOIN l USING (slice)""",
)
final(
    "landing_roundtrip", ["landing"],
    f"""SELECT substr(created_date, 1, 7) AS slice, '{q.ROUNDTRIP_STAMP}' AS _ingested_at, count(*) AS row_count,
         count(DISTINCT unique_key) AS distinct_keys, {content_of(*SOURCE_COLUMNS)} AS content FROM landing GROUP BY 1""",
)
final(
    "written_sample", ["newest"],
    f"""WITH s AS (SELECT substr(created_date, 1, 7) AS slice, count(*) AS n FROM newest GROUP BY 1),
       k AS (SELECT slice, least({q.SAMPLE_PER_MONTH}, ceil(n / greatest(n // {q.SAMPLE_PER_MONTH}, 1)))::BIGINT AS n FROM s)
       SELECT slice, n AS manifest_rows, n AS landed_rows, TRUE AS ties_out FROM k""",
)
final(
    "keyset_page", ["valid"],
    f"""SELECT created_at, request_id, agency_code, complaint_type FROM valid
       WHERE (created_at, request_id) > (TIMESTAMP '{q.PAGE_AFTER[0]}', '{q.PAGE_AFTER[1]}')
       ORDER BY created_at, request_id LIMIT {q.PAGE_ROWS}""",
)
final(
    "keyset_walk", ["valid"],
    f"""WITH r AS (
         SELECT *, (row_number() OVER (ORDER BY created_at, request_id) - 1) // {q.WALK_ROWS} + 1 AS page FROM valid)
       SELECT page::BIGINT AS page, count(*) AS page_rows, max(created_at) AS last_created_at,
         max_by(request_id, (created_at, request_id)) AS last_request_id, {content_of('request_id')} AS ids FROM r GROUP BY page""",
)
final(
    "distinct_sketches", ["landing"],
    """SELECT coalesce(substr(created_date, 1, 7), 'none') AS slice, count(*) AS row_count,
         count(DISTINCT unique_key) AS exact_keys, TRUE AS within_bound FROM landing GROUP BY 1
       UNION ALL SELECT 'all', count(*), count(DISTINCT unique_key), TRUE FROM landing""",
)
final(
    "systematic_sample", ["valid"],
    f"""WITH r AS (
         SELECT strftime(created_at, '%Y-%m') AS month, request_id, created_at, complaint_type,
           row_number() OVER (PARTITION BY strftime(created_at, '%Y-%m') ORDER BY request_id) - 1 AS i,
           greatest(count(*) OVER (PARTITION BY strftime(created_at, '%Y-%m')) // {q.SAMPLE_PER_MONTH}, 1) AS stride
         FROM valid)
       SELECT month, request_id, created_at, complaint_type FROM r WHERE i % stride = 0 AND i // stride < {q.SAMPLE_PER_MONTH}""",
)
final(
    "latest_per_key", ["newest"],
    """SELECT unique_key, _ingested_at, closed_date, status, complaint_type, descriptor, street_name FROM newest""",
)
final("typed_flags", ["staged"], "SELECT * FROM staged")
final("valid_requests", ["valid"], "SELECT * FROM valid")
final("quarantine_reasons", ["excluded"], "SELECT * FROM excluded")
_D = {step: f"{step} AS step, '{stage}' AS stage, '{text_}' AS description" for step, stage, text_ in ledger_texts.STAGES}
final(
    "dq_ledger", ["landing", "staged", "excluded", "valid"],
    f"""WITH c AS (SELECT (SELECT count(*) FROM landing) AS l, (SELECT count(*) FROM staged) AS s,
          (SELECT count(*) FROM excluded) AS e, (SELECT count(*) FROM valid) AS v)
       SELECT {_D[1]}, l AS row_count, NULL::BIGINT AS delta_from_previous FROM c
       UNION ALL SELECT {_D[2]}, s, s - l FROM c UNION ALL SELECT {_D[3]}, e, NULL FROM c
       UNION ALL SELECT {_D[4]}, v, v - s FROM c UNION ALL SELECT {_D[5]}, s - e - v, NULL FROM c
       UNION ALL SELECT 10, 'quarantine_reason: ' || exclusion_reason, '{ledger_texts.REASON_DESCRIPTION}',
         count(*), NULL FROM excluded GROUP BY exclusion_reason""",
)
final(
    "duplicate_ingestions", ["landing"],
    """SELECT count(*) AS landed_rows, count(DISTINCT coalesce(unique_key, '<none>')) AS distinct_keys,
         count(*) - count(DISTINCT coalesce(unique_key, '<none>')) AS duplicate_ingestions FROM landing""",
)
final(
    "vintage_dates", ["periods", "valid"],
    """SELECT vintage_date, cutoff AS vintage_cutoff_at, seq AS vintage_seq, is_final_vintage,
         (SELECT count(*) FROM valid WHERE created_at > opens_after AND created_at <= cutoff) AS created_in_period,
         (SELECT count(*) FROM valid WHERE closed_at > opens_after AND closed_at <= cutoff) AS closed_in_period
       FROM periods""",
)
final(
    "date_spine", ["facts"],
    f"""WITH d AS (SELECT t::DATE AS d FROM generate_series(
          date_trunc('year', TIMESTAMP '{P.window_start}') - INTERVAL 1 YEAR,
          date_trunc('year', TIMESTAMP '{P.window_end}') + INTERVAL 1 YEAR, INTERVAL 1 DAY) AS g(t))
       SELECT d AS date_key, d AS date_day, year(d) AS calendar_year, quarter(d) AS calendar_quarter,
         month(d) AS calendar_month, day(d) AS day_of_month, dayofweek(d) AS day_of_week, dayofyear(d) AS day_of_year,
         week(d) AS iso_week, strftime(d, '%Y-%m') AS year_month, monthname(d) AS month_name, dayname(d) AS day_name,
         date_trunc('month', d)::DATE AS month_start_date, date_trunc('quarter', d)::DATE AS quarter_start_date,
         date_trunc('year', d)::DATE AS year_start_date, date_trunc('week', d)::DATE AS week_start_date,
         dayofweek(d) IN (0, 6) AS is_weekend,
         d BETWEEN TIMESTAMP '{P.window_start}'::DATE AND TIMESTAMP '{P.window_end}'::DATE AS is_in_ingest_window,
         coalesce(n, 0) AS requests
       FROM d LEFT JOIN (SELECT created_date_key AS k, count(*) AS n FROM facts GROUP BY 1) ON k = d""",
)
final("type_observations", ["observations"], "SELECT * FROM observations")
final("dim_agency", ["agencies"], "SELECT * FROM agencies")
final("dim_geography", ["places"], "SELECT * FROM places")
final("scd2_dim", ["history"], "SELECT * FROM history")
final("fact", ["facts"], "SELECT * FROM facts")
final("agency_month", ["months"], rounded("months", _MONTH_FLOATS))
final("cohort_maturity", ["cohorts"], "SELECT * FROM cohorts ORDER BY cohort_month")
final("bi_wide", ["wide"], rounded("wide", _WIDE_FLOATS))
final("bi_export", *FINAL["bi_wide"])
final("bi_export_parquet", *FINAL["bi_wide"])
final(
    "bi_reaggregate", ["wide"],
    f"""SELECT cohort_year, agency_code, sum(request_volume)::BIGINT AS request_volume,
         sum(closed_volume)::BIGINT AS closed_volume, sum(backlog_open_count)::BIGINT AS backlog_open_count,
         {r6(ratio("sum(closed_volume)", "sum(request_volume)"))} AS closure_rate,
         {r6(in_days(ratio("sum(closed_seconds)", "sum(closed_volume)")))} AS mean_days,
         {r6(in_days(ratio("sum(matured_seconds)", "sum(closed_within_window_volume)")))} AS mean_days_matured,
         {r6(ratio("sum(on_time_numerator)", "sum(on_time_denominator)"))} AS on_time_rate
       FROM wide GROUP BY ALL""",
)
final(
    "top6_other", ["wide"],
    f"""WITH t AS (SELECT agency_code AS top FROM wide GROUP BY 1
         ORDER BY sum(request_volume) DESC, 1 NULLS LAST LIMIT {q.TOP_AGENCIES})
       SELECT cohort_month, CASE WHEN there THEN agency_code ELSE 'Other' END AS agency_code, there IS NULL AS is_other,
         sum(request_volume)::BIGINT AS request_volume
       FROM wide LEFT JOIN (SELECT top, TRUE AS there FROM t) ON top IS NOT DISTINCT FROM agency_code GROUP BY ALL""",
)
final("vintage_state", ["as_of"], rounded("as_of", _STATE_FLOATS))
final(
    "vintage_batch", ["as_of"],
    rounded("as_of", _STATE_FLOATS) + f" WHERE source_updated_at > TIMESTAMP '{q.PREVIOUS_CUTOFF}'",
)
final("append_only_table", ["append_only"], rounded("append_only", _STATE_FLOATS))
final("merge_table", ["merged"], rounded("merged", _STATE_FLOATS))
_RUNS = ", ".join(f"TIMESTAMP '{c}'" for c in q.RUNS)
PARTS["three_runs"] = (
    ["valid"],
    f"""SELECT * FROM (
      SELECT *, (SELECT min(c) FROM unnest([{_RUNS}]) u(c) WHERE created_at <= c) AS entered,
        (SELECT min(c) FROM unnest([{_RUNS}]) u(c) WHERE closed_at <= c) AS learned
      FROM valid) WHERE entered IS NOT NULL""",
)
PARTS["run_append"] = (["three_runs"], state("three_runs", "CASE WHEN closed_at <= entered THEN closed_at END", "entered"))
PARTS["run_merge"] = (
    ["three_runs"],
    state(
        "three_runs",
        "CASE WHEN learned IS NOT NULL THEN closed_at END",
        "greatest(entered, coalesce(learned, entered))",
    ),
)
for _name in ("incremental", "materialized"):
    final(f"{_name}_append", ["run_append"], rounded("run_append", _STATE_FLOATS))
    final(f"{_name}_merge", ["run_merge"], rounded("run_merge", _STATE_FLOATS))
final("materialized_stack", *FINAL["materialized_merge"])
final("replayed_append", *FINAL["append_only_table"])
final("replayed_merge", *FINAL["merge_table"])
final("as_of_carried", ["facts"], "SELECT request_id, complaint_type_key FROM facts")
final(
    "missed_closures", ["seen"],
    "SELECT request_id, closed_at FROM seen WHERE close_cutoff > first_cutoff",
)
final(
    "table_disagreement", ["drifted"],
    rounded(
        "(SELECT * EXCLUDE (vintage_seq, vintage_date) FROM drifted WHERE vintage_seq = (SELECT max(vintage_seq) FROM drifted))",
        ["append_avg_days_to_close", "merge_avg_days_to_close"],
    ),
)
final("high_water_mark", ["merged"], "SELECT max(source_updated_at) AS high_water_mark FROM merged")
final("drift_log", ["drifted"], rounded("drifted", ["append_avg_days_to_close", "merge_avg_days_to_close"]))
final("replay_loop", *FINAL["drift_log"])
final("drift_summary", ["drift_errors"], "SELECT * FROM drift_errors ORDER BY vintage_seq")
final(
    "drift_worst_vintage", ["drift_errors"],
    "SELECT * FROM drift_errors ORDER BY share_of_closures_missed DESC NULLS LAST, vintage_seq LIMIT 1",
)
final("drift_final_vintage", ["drift_errors"], "SELECT * FROM drift_errors ORDER BY vintage_seq DESC LIMIT 1")
final(
    "agency_performance", ["months", "agencies"],
    f"""SELECT agency_key, any_value(agency_name) AS agency_name, sum(request_volume)::BIGINT AS requests,
         sum(closed_volume)::BIGINT AS closed, {r6(ratio("sum(closed_volume)", "sum(request_volume)"))} AS closure_rate,
         {r6(in_days(ratio("sum(closed_seconds)", "sum(closed_volume)")))} AS mean_days_naive,
         {r6(in_days(ratio("sum(window_seconds) FILTER (is_cohort_mature)", "sum(window_volume) FILTER (is_cohort_mature)")))}
           AS mean_days_matured,
         sum(backlog_open_count)::BIGINT AS backlog
       FROM months LEFT JOIN agencies USING (agency_key) GROUP BY agency_key
       HAVING sum(request_volume) >= {q.MIN_VOLUME} ORDER BY requests DESC, agency_key LIMIT 15""",
)
final(
    "type_version_counts", ["history"],
    """SELECT count(*) FILTER (NOT is_unknown_member) AS versions, count(*) AS versions_with_unknown,
         count(DISTINCT (complaint_type, coalesce(descriptor, ''))) FILTER (NOT is_unknown_member) AS pairs,
         count(DISTINCT (complaint_type, coalesce(descriptor, '')))
           FILTER (NOT is_unknown_member AND version_number > 1) AS multi_version_pairs FROM history""",
)
final(
    "multi_version_pairs", ["history"],
    """SELECT complaint_type, descriptor, count(*) AS versions, min(valid_from_vintage_date) AS first_seen,
         max(valid_to_vintage_date) AS last_seen, count(DISTINCT owning_agency_code) AS distinct_owners
       FROM history WHERE NOT is_unknown_member GROUP BY ALL HAVING count(*) > 1
       ORDER BY versions DESC, complaint_type, descriptor LIMIT 20""",
)
final(
    "status_crosstab", ["facts"],
    f"""SELECT is_closed, status_raw = 'Closed' AS source_says_closed, count(*) AS requests,
         {r6(ratio("count(*)", "(SELECT count(*) FROM facts)"))} AS share FROM facts GROUP BY 1, 2""",
)
final(
    "status_disagreement", ["measured", "agencies"],
    f"""SELECT agency_code, count(*) AS disagreeing, {r6(MEAN)} AS mean_days,
         {r6(ratio("count(*)", "any_value(total)"))} AS share_of_agency
       FROM measured JOIN agencies USING (agency_key)
       JOIN (SELECT agency_key, count(*) AS total FROM facts GROUP BY 1) USING (agency_key)
       WHERE is_closed AND status_raw <> 'Closed' GROUP BY agency_code""",
)
_CODES = ", ".join(f"'{c}'" for c in q.DETAIL_CODES)
final(
    "status_detail", ["facts", "agencies"],
    f"""SELECT agency_code, status_raw, count(*) AS requests, count(*) FILTER (is_closed) AS with_close_timestamp
       FROM facts JOIN agencies USING (agency_key) WHERE agency_code IN ({_CODES}) GROUP BY 1, 2""",
)
final(
    "closure_rate_by_status", ["facts"],
    f"""SELECT count(*) AS requests, count(*) FILTER (status_raw = 'Closed') AS status_closed,
         {r6(ratio("count(*) FILTER (status_raw = 'Closed')", "count(*)"))} AS rate_by_status,
         {r6(ratio("count(*) FILTER (is_closed)", "count(*)"))} AS rate_by_timestamp
       FROM facts WHERE agency_key = '{q.ONE_AGENCY}'""",
)
_W = "s <= window_days * 86400"
final(
    "maturity_sensitivity", ["measured"],
    f"""WITH c AS (
         SELECT window_days, cohort_month, {in_days(ratio(f"sum(s) FILTER ({_W})", f"count(*) FILTER ({_W})"))} AS mean,
           1.0::DOUBLE - {ratio(f"count(*) FILTER ({_W})", "count(*)")} AS truncated
         FROM measured, (SELECT unnest({list(P.sensitivity_windows)})::BIGINT AS window_days)
         WHERE {AGE} >= window_days GROUP BY ALL
       ), w AS (
         SELECT window_days, count(*) AS n, min(cohort_month) AS f, max(cohort_month) AS l,
           arg_min(mean, cohort_month) AS fm, arg_max(mean, cohort_month) AS lm, max(truncated) AS t
         FROM c GROUP BY ALL)
       SELECT window_days, n AS mature_cohorts, CASE WHEN n >= 2 THEN f END AS first_cohort,
         CASE WHEN n >= 2 THEN l END AS last_cohort, CASE WHEN n >= 2 THEN {r6("fm")} END AS first_mean,
         CASE WHEN n >= 2 THEN {r6("lm")} END AS last_mean, CASE WHEN n >= 2 THEN {r6("t")} END AS worst_truncated,
         CASE WHEN n >= 2 THEN {r6("lm - fm")} END AS delta,
         CASE WHEN n < 2 THEN 'too few' WHEN lm > fm THEN 'slower' WHEN lm <= fm THEN 'faster' END AS direction
       FROM w""",
)
final(
    "flagged_but_kept", ["facts"],
    " UNION ALL ".join(
        f"SELECT '{f}' AS flag, count(*) FILTER ({f}) AS rows_flagged, count(*) AS fact_rows FROM facts" for f in WARN_FLAGS
    ),
)
final(
    "orphan_keys", ["landing", "facts"],
    """SELECT trim(unique_key) AS request_id, count(*) AS orphan_rows FROM landing
       WHERE unique_key IS NOT NULL AND trim(unique_key) NOT IN (SELECT request_id FROM facts) GROUP BY 1""",
)
final(
    "backlog_share", ["facts"],
    f"""WITH b AS (SELECT agency_key, count(*) FILTER (NOT is_closed) AS backlog FROM facts GROUP BY 1)
       SELECT agency_key, backlog, row_number() OVER w AS backlog_rank,
         {r6(ratio("backlog", "sum(backlog) OVER ()"))} AS share,
         {r6(ratio("sum(backlog) OVER w", "sum(backlog) OVER ()"))} AS cumulative_share
       FROM b WINDOW w AS (ORDER BY backlog DESC, agency_key ROWS UNBOUNDED PRECEDING)""",
)
final(
    "snapshot_diff", ["diffed"],
    "SELECT unique_key, disappeared, changed_fields, closed_before, closed_after FROM diffed",
)
final(
    "field_change_counts", ["diffed"],
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER (is_{f}) AS changed, count(*) AS sample_size, "
        f"{r6(ratio(f'count(*) FILTER (is_{f})', 'count(*)'))} AS changed_share FROM diffed"
        for f in PROBE_FIELDS
    ),
)
final("snapshot_recheck", *FINAL["field_change_counts"])
final("snapshot_diff_digests", *FINAL["snapshot_diff"])
final(
    "probe_summary", ["diffed"],
    f"""SELECT count(*) AS sample_size, count(*) FILTER (NOT disappeared) AS refetched,
         count(*) FILTER (disappeared) AS disappeared_from_source,
         count(*) FILTER (changed_fields <> '') AS requests_changed,
         {r6("100.0::DOUBLE * count(*) FILTER (changed_fields <> '') / greatest(count(*), 1)")} AS requests_changed_pct,
         {r6("3.0::DOUBLE / nullif(count(*), 0)")} AS zero_event_upper_bound FROM diffed""",
)
final(
    "probe_capture", ["newest"],
    f"""WITH t AS (SELECT *, try_cast(created_date AS TIMESTAMP) AS made FROM newest WHERE unique_key IS NOT NULL),
       m AS (SELECT date_trunc('month', max(made)) AS m FROM t)
       SELECT unique_key, {", ".join(PROBE_FIELDS)} FROM t, m WHERE made >= m - INTERVAL 1 MONTH AND made < m
       ORDER BY made, unique_key LIMIT {q.PROBE_ROWS}""",
)

_DATED = [f for f in PROBE_FIELDS if f in DATED]
_PLACED = [f for f in PROBE_FIELDS if f not in DATED]
final(
    "change_visibility", ["diffed", "landing"],
    " UNION ALL ".join(
        f"""SELECT {flag} AS replay_sees_it, coalesce(sum({" + ".join(f"is_{f}::BIGINT" for f in fields)}), 0)::BIGINT AS changes,
          count(*) FILTER ({" OR ".join(f"is_{f}" for f in fields)}) AS requests_touched,
          {r6(f"date_diff('second', TIMESTAMP '{q.CAPTURED_UPTO}', (SELECT max(_ingested_at)::TIMESTAMP FROM landing)) / 3600.0::DOUBLE")}
            AS gap_hours FROM diffed"""
        for flag, fields in (("TRUE", _DATED), ("FALSE", _PLACED))
    ),
)
final(
    "change_examples", ["diffed"],
    f"""SELECT unique_key, changed_fields FROM diffed WHERE changed_fields <> '' ORDER BY unique_key LIMIT {q.EXAMPLES}""",
)


def _nulls(table: str, part: str, *columns: str, severity: str = "error") -> list[str]:
    return [f"SELECT '{table}.{c}.not_null', '{severity}', count(*) FILTER ({c} IS NULL) FROM {part}" for c in columns]


def _repeats(table: str, part: str, column: str) -> list[str]:
    return [
        f"SELECT '{table}.{column}.unique', 'error', count(*) FROM "
        f"(SELECT {column} FROM {part} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
    ]


def _missing(key: str, part: str, column: str) -> list[str]:
    return [
        f"SELECT 'fct_service_request.{key}.relationships', 'error', count(*) FROM facts "
        f"WHERE {key} NOT IN (SELECT {column} FROM {part})"
    ]


_F = "fct_service_request"
_CHECKS = [
    *_nulls("stg_service_requests", "staged", "request_id", "source_updated_at"),
    *_nulls("stg_service_requests", "staged", "created_at", severity="warn"),
    *_repeats("stg_service_requests", "staged", "request_id"),
    *_nulls("int_requests_valid", "valid", "request_id", "created_at"),
    *_repeats("int_requests_valid", "valid", "request_id"),
    *_nulls("int_requests_quarantined", "excluded", "exclusion_reason"),
    """SELECT 'int_requests_quarantined.exclusion_reason.accepted_values', 'error', count(*) FROM excluded
       WHERE exclusion_reason NOT IN ('missing_request_id', 'unparseable_or_missing_created_date', 'closed_before_created')""",
    *_repeats("int_requests_quarantined", "excluded", "request_id"),
    *_nulls(
        _F, "facts", "request_id", "agency_key", "complaint_type_key", "geography_key", "created_date_key",
        "created_at", "is_closed",
    ),
    f"""SELECT '{_F}.coordinates_inside_box', 'error', count(*) FROM facts
        WHERE latitude IS NOT NULL AND longitude IS NOT NULL
          AND NOT (latitude BETWEEN 40.4 AND 41.0 AND longitude BETWEEN -74.3 AND -73.7)""",
    f"SELECT '{_F}.no_closed_before_created', 'error', count(*) FROM facts WHERE closed_at < created_at",
    f"SELECT '{_F}.no_negative_durations', 'error', count(*) FROM facts WHERE days_to_close < 0 OR age_days < 0",
    *_repeats(_F, "facts", "request_id"),
    *_missing("agency_key", "agencies", "agency_key"),
    *_missing("complaint_type_key", "history", "complaint_type_key"),
    *_missing("geography_key", "places", "geography_key"),
    *_missing("created_date_key", "days_", "date_key"),
    *_nulls("dim_agency", "agencies", "agency_key"), *_repeats("dim_agency", "agencies", "agency_key"),
    *_nulls("dim_geography", "places", "geography_key"), *_repeats("dim_geography", "places", "geography_key"),
    *_nulls("dim_date", "days_", "date_key"), *_repeats("dim_date", "days_", "date_key"),
    *_nulls("dim_complaint_type", "history", "complaint_type_key", "is_current", "valid_from_at", "valid_to_at"),
    *_repeats("dim_complaint_type", "history", "complaint_type_key"),
    """SELECT 'dim_complaint_type.at_most_one_current', 'error', count(*) FROM (SELECT 1 FROM history
       WHERE is_current AND NOT is_unknown_member GROUP BY complaint_type, descriptor HAVING count(*) > 1)""",
    """SELECT 'dim_complaint_type.retired_has_none_current', 'error', count(*) FROM history h
       WHERE is_current AND NOT is_unknown_member AND NOT EXISTS (SELECT 1 FROM observations o
         WHERE o.complaint_type = h.complaint_type AND o.descriptor = h.descriptor
           AND o.vintage_seq = (SELECT max(seq) FROM periods))""",
    """SELECT 'dim_complaint_type.versions_do_not_overlap', 'error', count(*) FROM (
         SELECT valid_from_at, lag(valid_to_at) OVER (PARTITION BY complaint_type, descriptor ORDER BY valid_from_at) AS p
         FROM history WHERE NOT is_unknown_member) WHERE valid_from_at < p""",
    f"""SELECT '{_F}.version_in_force_at_creation', 'error', count(*) FROM facts f WHERE EXISTS (
         SELECT 1 FROM history h WHERE h.complaint_type_key = f.complaint_type_key AND NOT h.is_unknown_member
         AND NOT (f.created_at > h.valid_from_at AND f.created_at <= h.valid_to_at))""",
    f"""SELECT '{_F}.rows_match_valid', 'error',
       abs((SELECT count(*) FROM facts) - (SELECT count(*) FROM valid))""",
    *_nulls("mart_agency_month", "months", "cohort_month", "request_volume"),
    """SELECT 'mart_agency_month.rates_within_bounds', 'error', count(*) FROM months
       WHERE closure_rate NOT BETWEEN 0 AND 1 OR closure_rate_at_maturity NOT BETWEEN 0 AND 1
         OR on_time_rate NOT BETWEEN 0 AND 1 OR unresolved_share_at_maturity NOT BETWEEN 0 AND 1""",
    """SELECT 'mart_agency_month.metric_parity', 'error', count(*) FROM surplus""",
    *_nulls("mart_cohort_maturity", "cohorts", "cohort_month"),
    *_repeats("mart_cohort_maturity", "cohorts", "cohort_month"),
    """SELECT 'dq_exclusion_ledger.residual_is_zero', 'error', abs((SELECT count(*) FROM staged)
       - (SELECT count(*) FROM excluded) - (SELECT count(*) FROM valid))""",
    *_nulls("fct_requests_merge", "merged", "request_id"), *_repeats("fct_requests_merge", "merged", "request_id"),
    *_nulls("comparison_drift_summary", "drifted", "vintage_seq"),
    *_repeats("comparison_drift_summary", "drifted", "vintage_seq"),
]
PARTS["days_"] = (
    [],
    f"""SELECT t::DATE AS date_key FROM generate_series(
          date_trunc('year', TIMESTAMP '{P.window_start}') - INTERVAL 1 YEAR,
          date_trunc('year', TIMESTAMP '{P.window_end}') + INTERVAL 1 YEAR, INTERVAL 1 DAY) AS g(t)""",
)
_READ = [
    "staged", "valid", "excluded", "facts", "agencies", "places", "history", "observations", "periods", "months",
    "cohorts", "merged", "drifted", "days_", "surplus",
]
# Measure columns of the mart that no metric describes: none in the sound build.
PARTS["surplus"] = ([], "SELECT name FROM (SELECT 'guess' AS name) WHERE FALSE")


def _checked(statements_: list[str]) -> str:
    return (
        "SELECT check_name, severity, failures::BIGINT AS failures FROM (\n"
        + "\nUNION ALL ".join(statements_)
        + "\n) AS t(check_name, severity, failures)"
    )


final("checks_summary", _READ, _checked(_CHECKS))


def _ends(digits: str) -> str:
    return f"coalesce(right(request_id, 2) = '{digits}', FALSE)"


# The tables of the build with the faults of ``faults.Spoilt``.
_SPOILT = {
    "staged": f"""SELECT * REPLACE (CASE WHEN NOT {_ends("12")} THEN source_updated_at END AS source_updated_at)
        FROM (FROM staged UNION ALL FROM staged WHERE {_ends("11")})""",
    "valid": """SELECT * EXCLUDE (dq_fatal_missing_request_id, dq_fatal_missing_created_at,
        dq_fatal_closed_before_created, is_quarantined) FROM bad_staged WHERE NOT is_quarantined""",
    "facts": f"""SELECT * REPLACE (
          CASE WHEN NOT {_ends("23")} THEN is_closed END AS is_closed,
          CASE WHEN {_ends("24")} THEN 'nowhere' ELSE agency_key END AS agency_key,
          CASE WHEN {_ends("25")} THEN 'nowhere' ELSE geography_key END AS geography_key,
          CASE WHEN {_ends("26")} THEN 'nowhere' ELSE complaint_type_key END AS complaint_type_key,
          CASE WHEN {_ends("27")} THEN DATE '2090-01-01' ELSE created_date_key END AS created_date_key,
          CASE WHEN {_ends("28")} THEN 1.0::DOUBLE ELSE latitude END AS latitude,
          CASE WHEN {_ends("29")} THEN created_at - INTERVAL 1 DAY ELSE closed_at END AS closed_at,
          CASE WHEN {_ends("30")} THEN -1.0::DOUBLE ELSE age_days END AS age_days,
          CASE WHEN {_ends("31")} THEN TIMESTAMP '1990-01-01' ELSE created_at END AS created_at)
        FROM (FROM facts UNION ALL FROM facts WHERE {_ends("22")}) WHERE NOT {_ends("21")}""",
    "excluded": f"""SELECT * REPLACE (CASE WHEN {_ends("41")} THEN 'because' WHEN NOT {_ends("42")} THEN exclusion_reason END
        AS exclusion_reason) FROM (FROM excluded UNION ALL FROM excluded WHERE {_ends("11")}) WHERE NOT {_ends("43")}""",
    "agencies": "FROM agencies UNION ALL FROM agencies WHERE agency_key LIKE 'B%'",
    "history": """FROM history UNION ALL SELECT * REPLACE (TRUE AS is_current, valid_from_at - INTERVAL 1 DAY AS valid_from_at,
          CASE WHEN version_number <> 2 THEN valid_to_at END AS valid_to_at)
        FROM history WHERE NOT is_unknown_member AND complaint_type_key SIMILAR TO '[0-3].*'""",
    "months": "SELECT * REPLACE (CASE WHEN agency_key LIKE 'M%' THEN 1.5::DOUBLE ELSE closure_rate END AS closure_rate) FROM months",
    "merged": f"FROM merged UNION ALL FROM merged WHERE {_ends('51')}",
    "surplus": "SELECT 'guess' AS name",
}
for _name, _sql in _SPOILT.items():
    PARTS[f"bad_{_name}"] = (["bad_staged" if _name == "valid" else _name], _sql)


def _spoilt(sql: str) -> str:
    for name in _SPOILT:
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 bad_{name}", sql)
    return sql


final(
    "checks_on_faults",
    [f"bad_{n}" if n in _SPOILT else n for n in _READ] + ["tieout"],
    _checked([*map(_spoilt, _CHECKS), "SELECT 'landing.manifest_ties_out', 'error', count(*) FILTER (NOT ties_out) FROM tieout"]),
)
final(
    "stream_manifest", ["landing"],
    f"""SELECT coalesce(substr(created_date, 1, 7), 'none') AS slice, count(*) AS rows, max(created_date) AS last_sort,
         max_by(unique_key, (created_date, unique_key)) AS last_key, TRUE AS complete, count(*) AS landed_rows,
         {content_of(*LANDING_COLUMNS)} AS content FROM landing GROUP BY 1""",
)
PARTS["tieout"] = FINAL["manifest_tieout"]
final(
    "stream_ingest", ["landing"],
    f"""SELECT substr(created_date, 1, 7) AS slice, count(*) AS row_count, count(DISTINCT _ingested_at) AS ingestions,
         {content_of(*LANDING_COLUMNS)} AS content FROM landing GROUP BY 1""",
)
final(
    "stream_append_only", ["landing"],
    f"SELECT * FROM landing QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY {OLDEST_FIRST}) = 1",
)
final("stream_merge", ["newest"], "SELECT * FROM newest")
final("stream_keyed_merge", *FINAL["stream_merge"])
final(
    "stream_changes", ["landing"],
    f"""WITH d AS (
         SELECT DISTINCT unique_key, 1 + (_ingested_at > '{q.DELIVERIES[0]}')::BIGINT + (_ingested_at > '{q.DELIVERIES[1]}')::BIGINT AS delivery
         FROM landing),
       c AS (
         SELECT *, CASE WHEN min(delivery) OVER (PARTITION BY unique_key) = delivery THEN 'new' ELSE 'restated' END AS change FROM d)
       SELECT delivery, change, count(*) AS requests, count(unique_key) AS with_key FROM c GROUP BY ALL""",
)
final(
    "event_durations", [],
    f"""WITH e AS (SELECT event_type, {secs("ts", "(date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 SECOND)")} AS s
         FROM events)
       SELECT event_type, count(*) AS events, sum(s)::BIGINT AS total_seconds, {r6(in_days("min(s)"))} AS shortest_days,
         {r6(in_days("max(s)"))} AS longest_days FROM e GROUP BY 1""",
)


def _needed(parts: list[str], found: list[str]) -> list[str]:
    """The parts and all they read, each after what it reads."""
    for name in parts:
        if name not in found:
            _needed(PARTS[name][0], found)
            found.append(name)
    return found


def statement(name: str) -> str:
    parts, sql = FINAL[name]
    names = _needed(parts, [])
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in names)
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql.lstrip()[5:]}"
    return f"WITH {ctes}\n{sql}"


def statements() -> dict[str, str]:
    return {name: statement(name) for name in FINAL}
