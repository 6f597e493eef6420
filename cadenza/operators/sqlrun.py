"""Plain SQL over a workspace's tables, each run in a session of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from cadenza.functions import compat
from cadenza.schema import RequestError
from cadenza.session import isolated

# A table's frame is built by the session that runs the query.
Tables = Mapping[str, Callable[[SparkSession], DataFrame]]


def require_query(spark: SparkSession, sql: str) -> None:
    """Refuse anything but a query: only a query can stand in a FROM clause."""
    try:
        plan = spark.sql(f"EXPLAIN SELECT * FROM (\n{sql}\n)").first()[0]
    except ParseException as error:
        raise RequestError(f"Only queries can be run: {error}") from error
    if plan.startswith("Error occurred"):
        raise RequestError(f"The query cannot be planned: {plan}")


# Functions that reach beyond the tables, into the JVM, the session or the files.
OUTSIDE = frozenset(
    "reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length "
    "current_user session_user user current_catalog current_database current_schema version read_files "
    "sql_keywords collations".split()
)


def _walk(node, a_plan, a_subquery):
    """A parsed plan's nodes and expressions, those of subqueries and named queries too."""
    yield node
    inner = [node.children()]
    if a_plan.isInstance(node):
        inner.append(node.expressions())
    for group in inner:
        for k in range(group.size()):
            yield from _walk(group.apply(k), a_plan, a_subquery)
    if a_subquery.isInstance(node):
        yield from _walk(node.plan(), a_plan, a_subquery)
    if node.getClass().getSimpleName() == "UnresolvedWith":
        named = node.cteRelations()
        for k in range(named.size()):
            yield from _walk(named.apply(k)._2(), a_plan, a_subquery)


@contextmanager
def _settings_of(spark: SparkSession) -> Iterator[None]:
    """Within, this thread parses by the settings of `spark`; afterwards by those it had before.

    A parser takes its settings from the thread's active session, not from the
    session it belongs to.
    """
    sessions = spark._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)
    try:
        yield
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
        else:
            sessions.clearActiveSession()


def require_inside(spark: SparkSession, sql: str, tables: Tables) -> None:
    """Refuse relations that are not in `tables` and functions that reach outside.

    Decided on the parsed plan, not on the text, so comments, quoting and case
    make no difference. A query's own named queries are relations too.
    """
    try:
        with _settings_of(spark):
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as error:
        raise RequestError(f"Only queries can be run: {error}") from error
    _refuse(spark, plan, {name.lower() for name in tables})


def require_plain(spark: SparkSession, expression: str) -> None:
    """Refuse an expression that calls a function that reaches outside, or holds a subquery on a table."""
    try:
        with _settings_of(spark):
            parsed = spark._jsparkSession.sessionState().sqlParser().parseExpression(expression)
    except ParseException as error:
        raise RequestError(f"'{expression}' cannot be read: {error}") from error
    _refuse(spark, parsed, set())


def _refuse(spark: SparkSession, plan, known: set[str]) -> None:
    named_class = spark._jvm.java.lang.Class.forName
    catalyst = "org.apache.spark.sql.catalyst"
    kinds = named_class(f"{catalyst}.plans.QueryPlan"), named_class(f"{catalyst}.expressions.PlanExpression")
    asked = []
    for node in _walk(plan, *kinds):
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            named = node.cteRelations()
            known |= {named.apply(k)._1().lower() for k in range(named.size())}
        elif kind == "UnresolvedRelation":
            asked.append(node.multipartIdentifier().mkString("."))
        elif kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            name = (node.nameParts() if kind == "UnresolvedFunction" else node.name()).last()
            if name.lower() in OUTSIDE:
                raise RequestError(f"Function '{name}' is not allowed")
    for name in asked:
        if name.lower() not in known:
            raise RequestError(f"Table '{name}' is not known")


# Aggregates that keep a sketch, a table of counts or a list per group,
# and distinct aggregates that pass over nulls.
HELD_BY_GROUP = frozenset(
    "approx_count_distinct approx_percentile percentile_approx percentile percentile_cont percentile_disc median mode "
    "collect_list collect_set array_agg approx_top_k histogram_numeric hll_sketch_agg".split()
)
NULLS_PASSED = frozenset(("count", "sum", "avg", "mean"))


def _functions(node, a_plan) -> Iterator:
    """The function calls among a parsed plan node's own expressions, those of subqueries left out."""
    for k in range(node.expressions().size()):
        for inner in _walk(node.expressions().apply(k), a_plan, a_plan):
            if inner.getClass().getSimpleName() == "UnresolvedFunction":
                yield inner


def beside_sketches(spark: SparkSession, sql: str) -> str:
    """The query with `FILTER (WHERE x IS NOT NULL)` on distinct aggregates of x that stand beside sketches.

    Nulls do not count in them, so the result is the same. Without a filter Spark
    groups by the key and x first and keeps each other aggregate's state for
    every pair of them; with one it keeps that state per key only.
    """
    named_class = spark._jvm.java.lang.Class.forName
    catalyst = "org.apache.spark.sql.catalyst"
    a_plan, a_subquery = named_class(f"{catalyst}.plans.QueryPlan"), named_class(f"{catalyst}.expressions.PlanExpression")
    with _settings_of(spark):
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    added: dict[int, str] = {}
    for node in _walk(plan, a_plan, a_subquery):
        if not a_plan.isInstance(node):
            continue
        called = [(f.nameParts().last().lower(), f) for f in _functions(node, a_plan)]
        if not any(compat.ALIASES.get(name, name) in HELD_BY_GROUP for name, _ in called):
            continue
        for name, call in called:
            if name not in NULLS_PASSED or not call.isDistinct() or call.filter().isDefined():
                continue
            places = [(o.startIndex(), o.stopIndex()) for o in (call.children().apply(k).origin() for k in range(call.children().size()))]
            ends = call.origin().stopIndex()
            if ends.isDefined() and sql[ends.get()] == ")" and all(a.isDefined() and z.isDefined() for a, z in places):
                tests = [f"({sql[a.get():z.get() + 1]}) IS NOT NULL" for a, z in places]
                added[ends.get() + 1] = f" FILTER (WHERE {' AND '.join(tests)})"
    for at in sorted(added, reverse=True):
        sql = sql[:at] + added[at] + sql[at:]
    return sql


def run_sql(spark: SparkSession, sql: str, tables: Tables) -> DataFrame:
    """Plan of a query over `tables`, whose frames are built in the new session.

    Temp views and functions of that session are seen by nobody else, so
    workspaces cannot meet. Only tables and functions whose names occur in the
    text are set up. Double quotes mark identifiers.
    """
    child = isolated(spark)
    child.conf.set("spark.sql.ansi.enabled", "true")
    child.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    child.conf.set("spark.sql.runSQLOnFiles", "false")
    said = sql.lower()
    compat.register(child, said)
    for name, build in tables.items():
        if name.lower() in said:
            build(child).createOrReplaceTempView(name)
    require_inside(child, sql, tables)
    require_query(child, sql)
    try:
        return child.sql(beside_sketches(child, sql))
    except AnalysisException as error:
        raise RequestError(str(error)) from error
