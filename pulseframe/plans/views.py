"""Governed query surface: user-scoped, zone-normalised views for ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseframe.operators.rollup import rebucket_tz
from pulseframe.session import configure

SCOPED = (
    "derived_sleep_daily", "derived_sleep_segments", "derived_workouts", "derived_workout_segments",
)
ROLLUPS = {"derived_rollup_hourly": "hour", "derived_rollup_daily": "day"}


def scope(df: DataFrame, user_id: str) -> DataFrame:
    """Rows of one user; the filter is on a stored column and reaches the scan."""
    return df.filter(F.col("user_id") == user_id)


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame], user_id: str, tz: str) -> None:
    """Temp views of the derived tables as one user may see them."""
    for name in SCOPED:
        if name in tables:
            scope(tables[name], user_id).createOrReplaceTempView(name)
    register_rollup_views(spark, tables, user_id, tz)


def register_rollup_views(
    spark: SparkSession, tables: Mapping[str, DataFrame], user_id: str, tz: str
) -> None:
    for name, unit in ROLLUPS.items():
        if name in tables:
            rebucket_tz(scope(tables[name], user_id), unit, tz).createOrReplaceTempView(name)


#: the setting that says whose views a session holds
GOVERNED_USER = "pulseframe.governed.user"
#: what a query may be made of, by the names of Spark's parsed plan; anything else is refused
_ALLOWED = {
    "Project", "Filter", "Join", "LateralJoin", "SubqueryAlias", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit",
    "Offset", "Distinct", "Union", "Except", "Intersect", "OneRowRelation", "LocalRelation", "UnresolvedInlineTable",
    "UnresolvedSubqueryColumnAliases", "WithWindowDefinition", "Window", "Pivot", "Unpivot", "UnresolvedRelation", "UnresolvedWith",
    "Generate", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases",
}
#: leaves of an analysed plan that hold no stored rows
_BARE = {"OneRowRelation", "LocalRelation", "CTERelationRef"}
_SUBQUERIES = ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")
#: functions that may stand for a table; the first two are defined in the session
TABLE_FUNCTIONS = {"generate_series", "unnest", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"}
_DEFINED = {
    "generate_series": "(first TIMESTAMP, last TIMESTAMP, step INTERVAL DAY TO SECOND DEFAULT INTERVAL 1 DAY) RETURNS TABLE (value TIMESTAMP) "
                       "RETURN SELECT explode(sequence(first, last, step)) AS value",
    "unnest": "(items ARRAY<STRING>) RETURNS TABLE (value STRING) RETURN SELECT explode(items) AS value",
}
#: functions that run code or look outside the rows
_REFUSED = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "version"}


def governed_session(
    spark: SparkSession, load: Callable[[SparkSession], Mapping[str, DataFrame]], user_id: str, tz: str
) -> SparkSession:
    """A session with the governed views of one user, to be used through :func:`ask`.

    ``load`` builds the derived tables in the session it is given. The session shares the
    catalog and the global views with others; ``ask`` sees to it that a text reaches none. Besides
    the built-in functions it has ``generate_series`` over instants and ``unnest`` over texts.
    """
    session = configure(spark.newSession())
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    session.conf.set(GOVERNED_USER, user_id)
    register_views(session, load(session), user_id, tz)
    for name, body in _DEFINED.items():
        session.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return session


def ask(session: SparkSession, sql: str, user_id: str, tz: str) -> DataFrame:
    """Run one ad-hoc query with the two binds ``:user_id`` and ``:tz_name``.

    The text is parsed on its own, so it must be one whole statement, and its plan may only hold
    query parts, views that the session itself has, built-in functions, the listed table functions
    and the text's own common table expressions. Once analysed, the plan is looked at again: every
    stored row in it must come through one of the session's views.
    """
    if session.conf.get(GOVERNED_USER, None) != user_id:
        raise PermissionError("the session holds the views of another user")
    try:
        plan = session._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise ValueError(f"not one whole query: {error}") from error
    catalog = session._jsparkSession.sessionState().catalog()
    views = {n for n in (*SCOPED, *ROLLUPS) if catalog.getTempView(n).isDefined()}
    built_in = {r.function.lower() for r in session.sql("SHOW SYSTEM FUNCTIONS").collect()}
    _Check(built_in).plan(plan, views)
    answer = session.sql(sql, args={"user_id": user_id, "tz_name": tz})
    _check_sources(answer._jdf.queryExecution().analyzed(), views)
    return answer


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class _Check:
    """Refuses a parsed plan that reaches for more than it may."""

    def __init__(self, built_in: set[str]):
        self.built_in = built_in - _REFUSED

    def plan(self, plan, known: set[str]) -> None:
        kind = _kind(plan)
        if kind not in _ALLOWED:
            raise PermissionError(f"not allowed in a query: {kind}")
        if kind == "UnresolvedRelation":
            name = [str(x) for x in _seq(plan.multipartIdentifier())]
            if len(name) != 1 or name[0].lower() not in known:
                raise PermissionError(f"not a governed view: {'.'.join(name)}")
        if kind == "UnresolvedTableValuedFunction":
            self.table_function([str(x).lower() for x in _seq(plan.name())])
        if kind == "UnresolvedWith":
            for entry in _seq(plan.cteRelations()):  # each sees those before it
                self.plan(entry._2(), known)
                known = known | {str(entry._1()).lower()}
            self.plan(plan.child(), known)
            return
        if kind == "WithWindowDefinition":  # the definitions are no children of the plan
            for definition in _seq(plan.windowDefinitions().values().toSeq()):
                self.expression(definition, known)
        for child in _seq(plan.children()):
            self.plan(child, known)
        for expression in _seq(plan.expressions()):
            self.expression(expression, known)

    def table_function(self, name: list[str]) -> None:
        if len(name) != 1 or name[0] not in TABLE_FUNCTIONS:
            raise PermissionError(f"function not allowed: {'.'.join(name)}")

    def expression(self, expression, known: set[str]) -> None:
        kind = _kind(expression)
        if kind == "UnresolvedFunction":
            name = [str(x).lower() for x in _seq(expression.nameParts())]
            if name[-1] not in self.built_in or name[:-1] not in ([], ["system", "builtin"], ["builtin"]):
                raise PermissionError(f"function not allowed: {'.'.join(name)}")
        if kind == "UnresolvedGenerator":
            self.table_function(str(expression.name().unquotedString()).lower().split("."))
        if kind.startswith("ExpressionWithUnresolvedIdentifier"):
            raise PermissionError("identifiers are written out")
        if kind in _SUBQUERIES:
            self.plan(expression.plan(), known)
        for child in _seq(expression.children()):
            self.expression(child, known)


def _check_sources(plan, views: set[str]) -> None:
    """Refuse an analysed plan that reads anything but the session's views."""
    kind = _kind(plan)
    if kind == "View" and plan.isTempView() and str(plan.desc().identifier().table()).lower() in views:
        return
    children = _seq(plan.children())
    if not children and kind not in _BARE:
        raise PermissionError(f"not a governed view: {kind}")
    for child in [*children, *(p for e in _seq(plan.expressions()) for p in _plans_in(e))]:
        _check_sources(child, views)


def _plans_in(expression) -> list:
    own = [expression.plan()] if _kind(expression) in _SUBQUERIES else []
    return own + [p for child in _seq(expression.children()) for p in _plans_in(child)]


def post_filter(df: DataFrame, condition: Column | str) -> DataFrame:
    """Condition on the aggregated result, with or without grouping."""
    return df.filter(condition)


def calendar_days(start: Column, end: Column) -> Column:
    """Generator: the days between two instants of a row, both included."""
    return F.explode(
        F.sequence(F.date_trunc("day", start), F.date_trunc("day", end), F.expr("interval 1 day"))
    )
