"""The governed session answers queries over its views and refuses everything else."""

import pytest

from pulseframe.plans import views as V


@pytest.fixture(scope="module")
def session(spark):
    spark.range(3).createOrReplaceGlobalTempView("g_secret")
    # another user's rows under names that this session has no views of, and a function of the catalog
    spark.sql("CREATE TABLE IF NOT EXISTS default.derived_sleep_daily USING parquet AS SELECT '8' AS user_id, 1 AS secret")
    rows = [("7", "w", 2.5), ("8", "x", 9.0)]
    schema = "user_id string, workout_uuid string, distance_km double"
    yield V.governed_session(spark, lambda s: {"derived_workouts": s.createDataFrame(rows, schema)}, "7", "UTC")
    spark.sql("DROP TABLE default.derived_sleep_daily")


@pytest.mark.parametrize("text", [
    "SELECT * FROM derived_sleep_daily", "SELECT * FROM derived_rollup_daily",
    "SELECT sum(distance_km) OVER w FROM derived_workouts WINDOW w AS (PARTITION BY (SELECT max(secret) FROM default.derived_sleep_daily))",
    "SELECT sum(distance_km) OVER w FROM derived_workouts WINDOW w AS (PARTITION BY (SELECT max(secret) FROM derived_sleep_daily))",
    "SELECT * FROM read_files('/tmp')", "SELECT * FROM spark_catalog.default.generate_series(1, 2)", "SELECT foreign_function(1)",
    "SELECT * FROM derived_workouts LATERAL VIEW foreign_table(user_id) t AS x", "SELECT * FROM sql_keywords()",
    "SELECT * FROM generate_series((SELECT max(t) FROM global_temp.g_secret), current_timestamp())",
    "SELECT * FROM explode((SELECT collect_list(secret) FROM default.derived_sleep_daily))",
    "SELECT * FROM derived_workouts, LATERAL (SELECT * FROM default.derived_sleep_daily)",
    "SELECT * FROM global_temp.g_secret", "SELECT * FROM default.t_secret", "SELECT * FROM t_secret", "SELECT * FROM parquet.`/tmp/x`",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.name')", "SELECT system.builtin.java_method('a', 'b')",
    "SELECT 1 c) UNION ALL SELECT * FROM (SELECT 2", "SELECT 1; SELECT 2", "SELECT * FROM range(5)", "DROP VIEW derived_workouts",
    "SET spark.sql.ansi.enabled = false", "SELECT TRANSFORM(user_id) USING 'cat' FROM derived_workouts",
    "SELECT * FROM derived_workouts WHERE distance_km IN (SELECT id FROM global_temp.g_secret)",
    "SELECT (SELECT max(id) FROM global_temp.g_secret) FROM derived_workouts",
    "SELECT * FROM (WITH t_secret AS (SELECT 1 a) SELECT * FROM t_secret) x JOIN t_secret ON true",
    "WITH a AS (SELECT * FROM global_temp.g_secret) SELECT * FROM a", "SELECT * FROM IDENTIFIER('global_temp.g_secret')",
    "SHOW TABLES", "TABLE t_secret", "SELECT * FROM derived_workouts WHERE EXISTS (SELECT 1 FROM t_secret)",
])
def test_refused(session, text):
    with pytest.raises((PermissionError, ValueError)):
        V.ask(session, text, "7", "UTC")


@pytest.mark.parametrize("text", [
    "SELECT * FROM derived_workouts WHERE user_id = :user_id",
    "WITH a AS (SELECT user_id, sum(distance_km) AS km FROM derived_workouts GROUP BY 1 HAVING sum(distance_km) > 1), b AS (SELECT * FROM a) SELECT b.km FROM b JOIN a USING (user_id) ORDER BY 1 LIMIT 5",
    "SELECT distance_km, rank() OVER (PARTITION BY user_id ORDER BY distance_km) AS r FROM derived_workouts w WHERE distance_km > (SELECT avg(distance_km) - 1 FROM derived_workouts)",
    "SELECT 1 AS a UNION ALL SELECT count(*) FROM Derived_Workouts WHERE :tz_name = 'UTC' HAVING count(*) > 5",
    "SELECT count(*) FROM generate_series(timestamp'2024-01-01', timestamp'2024-01-03') HAVING count(*) = 3",
    "SELECT count(*) FROM generate_series(timestamp'2024-01-01', timestamp'2024-01-02', INTERVAL 6 HOURS) AS s(t) JOIN derived_workouts ON true HAVING count(*) = 5",
    "SELECT x FROM derived_workouts LATERAL VIEW explode(array(user_id, workout_uuid)) t AS x WHERE x = :user_id",
    "SELECT u.value FROM derived_workouts w, LATERAL unnest(array(w.user_id, w.workout_uuid)) u WHERE u.value = 'w'",
    "SELECT count(x) FROM (SELECT explode(sequence(1, 3)) AS x) HAVING count(x) = 3",
    "SELECT sum(distance_km) OVER w FROM derived_workouts WINDOW w AS (PARTITION BY user_id ORDER BY workout_uuid)",
    "SELECT * FROM derived_workouts WHERE EXISTS (SELECT 1 FROM unnest(array('a')))",
])
def test_answered(session, text):
    assert len(V.ask(session, text, "7", "UTC").collect()) == 1


def test_only_for_its_user(session):
    with pytest.raises(PermissionError):
        V.ask(session, "SELECT * FROM derived_workouts", "8", "UTC")
