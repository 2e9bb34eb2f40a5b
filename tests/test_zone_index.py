"""Zones in force at an instant, against brute force, for short, long and open-ended histories."""

import datetime as dt
import random

from pulseframe.operators import zones as Z

ZONES = ["UTC", "Asia/Kolkata", "America/New_York", "Not/AZone", None]
START = dt.datetime(2024, 1, 1)


def brute(points, geo, device):
    def entry(history, user, ts):
        known = [(at, n, tz, src) for n, (u, at, tz, src) in enumerate(history) if u == user and ts is not None and at <= ts]
        return max(known, key=lambda e: e[0]) if known else None

    ok = lambda tz: tz if tz in ZONES[:3] else None
    out = {}
    for user, i, ts in points:
        g, d = entry(geo, user, ts), entry(device, user, ts)
        out[i] = (ok(g[2]) if g and g[3] == "geocode" else None) or (ok(d[2]) if d else None)
    return out


def test_brute_force(spark):
    rng = random.Random(4)
    minutes = lambda n: START + dt.timedelta(minutes=n)
    history = lambda user, n, src: [
        (user, minutes(m), rng.choice(ZONES), rng.choice(src)) for m in rng.sample(range(200_000), n)]
    geo = history("long", 10_000, ["geocode", "seed_device_tz"]) + history("few", 3, ["geocode"]) + [("open", minutes(5), "Asia/Kolkata", "geocode")]
    device = history("long", 50, ["device"]) + history("few", 2, ["device"]) + [("dev", minutes(0), "America/New_York", "device")]
    points = [(u, f"{u}{k}", minutes(rng.randrange(-5_000, 900_000))) for u in ("long", "few", "open", "dev", "none") for k in range(120)]
    points += [("open", "at", minutes(5)), ("open", "just before", minutes(5) - dt.timedelta(microseconds=1)), ("open", "never", None), (None, "nobody", minutes(9))]
    df = spark.createDataFrame(points, "user_id string, id string, ts timestamp")
    schema = "user_id string, effective_at timestamp, tz string, src string"
    args = [spark.createDataFrame(h, schema) for h in (geo, device)]
    for width_s in (Z.STRETCH_S, 6 * 3_600):
        rows = Z.stamp_zone(df, *args, width_s=width_s).collect()
        assert len(rows) == len(points) and {r.id: r.timezone for r in rows} == brute(points, geo, device)


def test_no_time_in_a_join_and_no_rows_multiplied(spark):
    points = spark.range(50).selectExpr("'u' AS user_id", "timestamp_seconds(1704067200 + id * 3600) AS ts")
    history = spark.range(10_000).selectExpr("'u' AS user_id", "timestamp_seconds(1704067200 + id * 60) AS effective_at", "'UTC' AS tz", "'geocode' AS src")
    out = Z.stamp_zone(points, history, history.limit(0))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "<" not in joins[0].split("Join")[1] and out.count() == 50
