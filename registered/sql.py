"""Building blocks of the comparison SQL, written for DuckDB and independent of the Spark code."""

from __future__ import annotations

# Valid ranges and flatline thresholds in minutes of the five sensors.
SENSORS = {
    "discharge_pressure": (0, 16, 30),
    "air_flow_rate": (0, 600, 30),
    "power_consumption": (0, 350, 30),
    "motor_speed": (0, 4000, 60),
    "discharge_temp": (-10, 120, 60),
}
# Metric names and units.
UNITS = {
    "active_duration_hours": "h",
    "active_ratio_pct": "%",
    "average_pressure_bar": "bar",
    "peak_pressure_bar": "bar",
    "mean_specific_power_kw_per_m3h": "kW/(m3/h)",
    "cycle_count": "count",
    "total_flow_volume_m3": "m3",
}
DEVICE = "station_id, device_id"
HOUR_US = 3_600_000_000



def rounded(expression: str, digits: int = 6) -> str:
    """Rounding that both engines agree on.

    Means of few decimal values often end in an exact half, which engines round differently; a shift
    well below the last digit moves them off it. The Spark side adds the same.
    """
    return f"round({expression} + 3e-{digits + 2}, {digits})"


READINGS = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
readings AS (
  SELECT event_id, date_trunc('hour', ts) AS ts,
    concat('S', user_id % 3) AS station_id, concat('D', user_id % 6) AS device_id,
    CASE WHEN k < 3 THEN NULL WHEN k < 5 THEN 'bad' ELSE CAST(value / 8.0 AS VARCHAR) END AS raw_discharge_pressure,
    CASE WHEN event_type = 'signup' THEN '0.0' ELSE CAST(value * 4.0 AS VARCHAR) END AS raw_air_flow_rate,
    CAST(value * 2.0 + 5.0 AS VARCHAR) AS raw_power_consumption,
    CASE WHEN event_type IN ('error', 'signup') THEN '0' WHEN k % 2 = 0 THEN '1500'
      ELSE CAST(k * 41 AS VARCHAR) END AS raw_motor_speed,
    CAST(20 + (CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 21600) % 90 AS VARCHAR) AS raw_discharge_temp
  FROM ev)"""


def each(pattern: str, joiner: str = ", ") -> str:
    """One piece of SQL per sensor; ``{c}`` is the column, ``{lo}`` and ``{hi}`` its range."""
    return joiner.join(
        pattern.format(c=name, lo=low, hi=high, minutes=minutes)
        for name, (low, high, minutes) in SENSORS.items()
    )


NORMALIZED = f"""{READINGS},
typed AS (SELECT event_id, ts, {DEVICE}, {each("raw_{c}, try_cast(raw_{c} AS DOUBLE) AS num_{c}")} FROM readings),
norm AS (SELECT event_id, ts, {DEVICE}, {each("raw_{c}, num_{c}, CASE WHEN num_{c} BETWEEN {lo} AND {hi} THEN num_{c} END AS {c}")} FROM typed)"""

# One row per reading and sensor.
LONG = f"""long AS ({each("SELECT event_id, ts, " + DEVICE + ", '{c}' AS col, raw_{c} AS raw, num_{c} AS num, {c} AS value FROM norm", " UNION ALL ")})"""

# The most frequent positive step of each device; the shortest on ties.
EXPECTED = f"""steps AS (
  SELECT {DEVICE}, ts, lag(ts) OVER w AS ts_before, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS step
  FROM norm WINDOW w AS (PARTITION BY {DEVICE} ORDER BY ts, event_id)),
step_counts AS (SELECT {DEVICE}, step, count(*) AS n FROM steps WHERE step > 0 GROUP BY {DEVICE}, step),
expected AS (
  SELECT {DEVICE}, step AS expected_us FROM step_counts
  QUALIFY row_number() OVER (PARTITION BY {DEVICE} ORDER BY n DESC, step) = 1)"""

GAPS = f"""{EXPECTED},
gaps AS (
  SELECT {DEVICE}, ts_before AS gap_start, ts AS gap_end,
    greatest(CAST(round_even(step / expected_us, 0) AS BIGINT) - 1, 1) AS missing_intervals
  FROM steps JOIN expected USING ({DEVICE}) WHERE step > expected_us)"""

FLATLINES = f"""{LONG},
known AS (
  SELECT *, lag(value) OVER w AS value_before, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS step
  FROM long WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY {DEVICE}, col ORDER BY ts, event_id)),
known_counts AS (SELECT {DEVICE}, col, step, count(*) AS n FROM known WHERE step > 0 GROUP BY {DEVICE}, col, step),
known_expected AS (
  SELECT {DEVICE}, col, step AS expected_us FROM known_counts
  QUALIFY row_number() OVER (PARTITION BY {DEVICE}, col ORDER BY n DESC, step) = 1),
marked AS (
  SELECT known.*, CASE WHEN value_before IS NULL OR value <> value_before
      OR coalesce(known.step > 1.5 * expected_us, false) THEN 1 ELSE 0 END AS starts
  FROM known LEFT JOIN known_expected USING ({DEVICE}, col)),
islands AS (
  SELECT *, sum(starts) OVER (PARTITION BY {DEVICE}, col ORDER BY ts, event_id) AS island FROM marked),
stretches AS (
  SELECT {DEVICE}, col, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n, min(value) AS value
  FROM islands GROUP BY {DEVICE}, col, island),
flatlines AS (
  SELECT {DEVICE}, col, start_time, end_time,
    (epoch_us(end_time) - epoch_us(start_time)) / 60000000.0 AS duration_minutes, value
  FROM stretches
  WHERE n >= 2 AND (epoch_us(end_time) - epoch_us(start_time)) / 60000000.0
    >= CASE col {each("WHEN '{c}' THEN {minutes}", " ")} END)"""

_ORDER = f"PARTITION BY {DEVICE} ORDER BY ts, event_id"
CLEANED = {
    "drop": f"""clean AS (SELECT event_id, ts, {DEVICE}, {each("{c}")} FROM norm
  WHERE {each("{c} IS NOT NULL", " AND ")})""",
    "fill": f"""clean AS (SELECT event_id, ts, {DEVICE},
  {each("last_value({c} IGNORE NULLS) OVER w AS {c}")} FROM norm
  WINDOW w AS ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "interpolate": f"""around AS (SELECT event_id, ts, epoch_us(ts) AS t, {DEVICE}, {each("{c}")},
  {each("last_value({c} IGNORE NULLS) OVER b AS v0_{c}, last_value(CASE WHEN {c} IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER b AS t0_{c}")},
  {each("first_value({c} IGNORE NULLS) OVER a AS v1_{c}, first_value(CASE WHEN {c} IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER a AS t1_{c}")}
  FROM norm
  WINDOW b AS ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS ({_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
clean AS (SELECT event_id, ts, {DEVICE},
  {each("CASE WHEN {c} IS NOT NULL THEN {c} WHEN v0_{c} IS NULL THEN NULL WHEN v1_{c} IS NULL OR t1_{c} = t0_{c} THEN v0_{c} ELSE v0_{c} + (v1_{c} - v0_{c}) * (t - t0_{c}) / (t1_{c} - t0_{c}) END AS {c}")}
  FROM around)""",
}


def resampled(step_us: int, source: str = "clean", name: str = "bins") -> str:
    """Means per device and bin, bins counted from midnight of the device's first reading."""
    return f"""{name}_origin AS (
  SELECT {DEVICE}, epoch_us(date_trunc('day', min(ts))) AS origin FROM {source} GROUP BY {DEVICE}),
{name}_all AS (
  SELECT {DEVICE}, make_timestamp(origin + (epoch_us(ts) - origin) // {step_us} * {step_us}) AS ts,
    {each("avg({c}) AS {c}")}
  FROM {source} JOIN {name}_origin USING ({DEVICE}) GROUP BY ALL),
{name} AS (SELECT * FROM {name}_all WHERE coalesce({each("{c}")}) IS NOT NULL)"""


def metrics(
    step_us: int,
    frequency: str,
    strategy: str,
    *,
    bins: str = "bins",
    name: str = "metrics",
    rpm: float = 500,
    flow: float = 1,
    run: str = "0",
) -> str:
    """Seven metrics per device; ``run`` is an expression that tells runs apart, such as the day."""
    group = f"{DEVICE}, run"
    union = " UNION ALL ".join(
        f"SELECT {DEVICE}, '{metric}' AS metric_name, {metric} AS metric_value, '{unit}' AS unit, "
        f"window_start, window_end, '{frequency}' AS resample_frequency, "
        f"'{strategy}' AS missing_strategy FROM {name}_wide"
        for metric, unit in UNITS.items()
    )
    return f"""{name}_bins AS (
  SELECT *, {run} AS run, coalesce(motor_speed, 0) > {rpm} AS active FROM {bins}),
{name}_steps AS (
  SELECT *, lag(active) OVER w AS active_before, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS step
  FROM {name}_bins WINDOW w AS (PARTITION BY {group} ORDER BY ts)),
{name}_facts AS (
  SELECT {group}, min(ts) AS window_start, max(ts) AS window_end, count(*) AS n,
    count(*) FILTER (WHERE active) AS active_bins,
    count(*) FILTER (WHERE active AND active_before = false) AS starts,
    avg(discharge_pressure) AS pressure, max(discharge_pressure) AS peak,
    avg(power_consumption / air_flow_rate) FILTER (WHERE air_flow_rate > {flow}) AS power,
    sum(coalesce(air_flow_rate, 0)) AS flow,
    list_sort(list(step) FILTER (WHERE step > 0)) AS ds
  FROM {name}_steps GROUP BY {group}),
{name}_hours AS (
  SELECT *, coalesce(ds[len(ds) // 2 + 1], {step_us}) / {HOUR_US}.0 AS h FROM {name}_facts),
{name}_wide AS (
  SELECT {group}, window_start, window_end, n, h,
    active_bins * h AS active_duration_hours, active_bins * 100.0 / n AS active_ratio_pct,
    coalesce(pressure, 0.0) AS average_pressure_bar, coalesce(peak, 0.0) AS peak_pressure_bar,
    coalesce(power, 0.0) AS mean_specific_power_kw_per_m3h,
    CAST(starts AS DOUBLE) AS cycle_count, flow * h AS total_flow_volume_m3
  FROM {name}_hours),
{name} AS ({union})"""


def query(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n" + select.strip()


# Raw JSON events; text pieces as in the Spark view.
RAW_EVENTS = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, event_id % 50 AS c,
  concat('S', user_id % 3) AS s, concat('D', user_id % 6) AS d FROM events),
raw AS (SELECT event_id AS arrival_seq, CASE
  WHEN c = 0 THEN concat('{"event_id":"e', event_id, '","event_type":"sensor_reading","readings":{"discharge_pressure":1.0}}')
  WHEN c = 1 THEN concat('{"event_id":"e', event_id, '","event_type":"sensor_reading","timestamp":"', iso, '","station_id":"', s, '","device_id":"', d, '","readings":{"discharge_pressure":"not_a_number","air_flow_rate":[1,2,3]}}')
  WHEN c = 2 THEN concat('{"event_id":"e', event_id, '","garbage":"x"}')
  WHEN c = 3 THEN concat('{"event_id":"e', event_id, '","event_type":"sensor_reading","timestamp":"not-a-date","station_id":"', s, '","device_id":"', d, '","readings":{}}')
  WHEN c = 4 THEN concat('{"event_id":"e', event_id, '","event_type":"alarm","timestamp":"', iso, '","station_id":"', s, '","device_id":"', d, '"}')
  WHEN c = 5 THEN concat('{"event_id":', event_id, ',"event_type":"sensor_reading","timestamp":"', iso, '","station_id":"', s, '","device_id":"', d, '"}')
  ELSE concat('{"event_id":"e', CASE WHEN c = 7 THEN event_id - 1 ELSE event_id END, '","event_type":"sensor_reading","timestamp":"', iso, '","station_id":"', s, '","device_id":"', d, '","readings":{"discharge_pressure":', CAST(value / 8.0 AS VARCHAR), ',"air_flow_rate":', CAST(value * 4.0 AS VARCHAR), ',"motor_speed":', k * 40, '}}')
  END AS payload FROM ev)"""


def _text_fields(pattern: str, joiner: str) -> str:
    fields = ("event_id", "event_type", "timestamp", "station_id", "device_id")
    return joiner.join(pattern.format(f=field) for field in fields)


_STRING = "coalesce(json_type(payload, '$.{f}') = 'VARCHAR', false)"
PARSED = f"""{RAW_EVENTS},
checked AS (
  SELECT arrival_seq, payload,
    {_text_fields("json_extract_string(payload, '$.{f}') AS {f}", ", ")},
    concat_ws(', ', {_text_fields("CASE WHEN NOT " + _STRING + " THEN '{f}' END", ", ")}) AS faults,
    try_cast(CASE WHEN json_type(payload, '$.timestamp') = 'VARCHAR'
      THEN json_extract_string(payload, '$.timestamp') END AS TIMESTAMP) AS event_time
  FROM raw),
parsed AS (
  SELECT *, CASE WHEN faults <> '' THEN 'broken' WHEN event_type <> 'sensor_reading' THEN 'other_type'
    WHEN event_time IS NULL THEN 'no_time' ELSE 'good' END AS stage FROM checked),
firsts AS (
  SELECT event_id, min(arrival_seq) AS first_arrival FROM parsed WHERE stage = 'good' GROUP BY event_id),
outcomes AS (
  SELECT parsed.*, CASE WHEN stage = 'broken' THEN 'malformed_event'
    WHEN stage = 'other_type' THEN 'validation_error'
    WHEN arrival_seq > first_arrival THEN 'duplicate'
    WHEN stage = 'no_time' THEN 'validation_error' ELSE 'ok' END AS outcome
  FROM parsed LEFT JOIN firsts USING (event_id))"""

ACCEPTED = f"""{PARSED},
accepted AS (
  SELECT event_id, arrival_seq, station_id, device_id, event_time,
    {each("try_cast(json_extract_string(payload, '$.readings.{c}') AS DOUBLE) AS num_{c}")}
  FROM outcomes WHERE outcome = 'ok'),
accepted_long AS ({each("SELECT station_id, device_id, event_time, '{c}' AS metric_type, num_{c} AS value FROM accepted WHERE num_{c} BETWEEN {lo} AND {hi}", " UNION ALL ")})"""

AGGREGATES = f"""{ACCEPTED},
bucketed AS (
  SELECT *, 'hour' AS bucket, date_trunc('hour', event_time) AS bucket_start FROM accepted_long
  UNION ALL
  SELECT *, 'day' AS bucket, CAST(date_trunc('day', event_time) AS TIMESTAMP) AS bucket_start FROM accepted_long),
aggregates AS (
  SELECT station_id, device_id, metric_type, bucket, bucket_start, count(*) AS count, sum(value) AS total,
    min(value) AS min_value, max(value) AS max_value, sum(value) / count(*) AS avg,
    max(event_time) AS latest_timestamp
  FROM bucketed GROUP BY station_id, device_id, metric_type, bucket, bucket_start)"""
