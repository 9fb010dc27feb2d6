"""Lookups, joins and unions of the tracker model. Each is one declarative plan; Catalyst picks the joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible_projects(projects: DataFrame, memberships: DataFrame, users: DataFrame, user_id: int) -> DataFrame:
    """All projects for an administrator, the assigned ones for others."""
    admin = users.where((F.col("id") == user_id) & (F.col("role") == "ADMIN")).select(F.lit(True).alias("is_admin")).limit(1)
    own = memberships.where(F.col("user_id") == user_id).select("project_id").distinct().withColumn("own", F.lit(True))
    flagged = projects.join(F.broadcast(admin), F.lit(True), "left")  # one row at most
    return flagged.join(own, F.col("id") == F.col("project_id"), "left").where("is_admin or own").select(projects.columns)


def members(users: DataFrame, memberships: DataFrame, project_id: int) -> DataFrame:
    return users.join(memberships.where(F.col("project_id") == project_id), F.col("id") == F.col("user_id")).select(*(users[c] for c in users.columns))


def members_semi(users: DataFrame, memberships: DataFrame, project_id: int) -> DataFrame:
    held = memberships.where(F.col("project_id") == project_id).select("user_id")
    return users.join(held, F.col("id") == F.col("user_id"), "left_semi")


def absent(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key isn't there yet, one for each key."""
    return incoming.dropDuplicates(keys).join(existing.select(keys).distinct(), keys, "left_anti")


def fan_out(users: DataFrame, memberships: DataFrame, project_id: int) -> DataFrame:
    """Assignments of every user to a new project, without those it has."""
    return absent(users.select(F.lit(project_id).cast(memberships.schema["project_id"].dataType).alias("project_id"), F.col("id").alias("user_id")), memberships, ["project_id", "user_id"])


def latest(df: DataFrame, by: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_rn = 1").drop("_rn")


def newest(df: DataFrame, by: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, numbered from 1 in ``rn``; Catalyst limits each group before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rn") <= n)


def approve_latest_draft(baselines: DataFrame, actor: int | None = None, now: Column | None = None) -> DataFrame:
    """Baselines after each project's latest draft has been approved; with an actor, who did it and when."""
    draft = baselines.where("status = 'DRAFT'").groupBy("project_id").agg(F.max("id").alias("draft_id"))
    out = baselines.join(draft, "project_id", "left")
    this = F.coalesce(F.col("id") == F.col("draft_id"), F.lit(False))
    if actor is not None:
        for name, value in (("approved_by", F.lit(actor).cast("long")), ("approved_at", F.current_timestamp() if now is None else now)):
            out = out.withColumn(name, F.when(this, value).otherwise(F.col(name) if name in baselines.columns else F.lit(None)))
    return out.withColumn("status", F.when(this, "APPROVED").otherwise(F.col("status"))).drop("draft_id")


def allowed(users: DataFrame, user_id: int, roles: list[str]) -> DataFrame:
    """(actor): the user, if it is active and in one of the roles; else no row."""
    active = F.coalesce(F.col("is_active"), F.lit(True)) if "is_active" in users.columns else F.lit(True)
    return users.where((F.col("id") == user_id) & F.col("role").isin(roles) & active).select(F.col("id").alias("actor")).limit(1)


def permissions(users: DataFrame, gates: dict[str, list[str]]) -> DataFrame:
    """(user_id, action) of everything that active users may do by their role."""
    active = F.coalesce(F.col("is_active"), F.lit(True)) if "is_active" in users.columns else F.lit(True)
    may = [F.when(F.col("role").isin(roles), F.lit(action)) for action, roles in gates.items()]
    return users.where(active).select(F.col("id").alias("user_id"), F.explode(F.array_compact(F.array(*may))).alias("action"))


def refused(attempts: DataFrame, users: DataFrame, gates: dict[str, list[str]]) -> DataFrame:
    """``attempts(user_id, action, ...)`` with ``error``: an unknown user, one that is not active, a role that may not, an action without a gate; null where it may go on."""
    active = F.coalesce(F.col("is_active"), F.lit(True)) if "is_active" in users.columns else F.lit(True)
    able = F.lit(False)
    for action, roles in gates.items():
        able = able | ((F.col("action") == action) & F.col("_role").isin(roles))
    known = users.select(F.col("id").alias("user_id"), F.col("role").alias("_role"), active.alias("_active"))
    error = F.when(F.col("_active").isNull(), "unknown user").when(~F.col("_active"), "inactive user").when(~F.coalesce(able, F.lit(False)), "not permitted")
    return attempts.join(known, "user_id", "left").select(*attempts.columns, error.alias("error"))


def move(rows: DataFrame, column: str, changes: DataFrame, steps: dict[str, list[str]], actor: DataFrame | None = None) -> DataFrame:
    """``rows(id, column, ...)`` after ``changes(id, to)``, one for each id at most, and ``moved``: whether it was made.

    A change is made where ``steps`` allows it from the row's state, and, if ``actor`` is given, only if that has a row.
    """
    able = F.lit(False)
    for begin, ends in steps.items():
        able = able | ((F.col(column) == begin) & F.col("to").isin(ends))
    out = rows.join(changes.select("id", "to"), "id", "left")
    if actor is not None:
        out = out.join(F.broadcast(actor.select(F.col("actor").alias("_actor"))), F.lit(True), "left")  # one row at most
        able = able & F.col("_actor").isNotNull()
    moved = F.coalesce(able, F.lit(False))
    return out.select(*(F.when(moved, F.col("to")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns), moved.alias("moved"))


def resolve(items: DataFrame, resolutions: DataFrame, actor: DataFrame, now: Column | None = None) -> DataFrame:
    """Tracker items after ``resolutions(id, project_id, resolution, status)`` by an actor: who resolved what, how and when.

    Resolutions of another project's items, or without an actor, change nothing.
    """
    by = resolutions.join(F.broadcast(actor), F.lit(True)).select("id", "project_id", F.col("resolution").alias("_how"), F.col("status").alias("_status"), F.col("actor").cast("long").alias("_by"))
    out = items.join(by, ["id", "project_id"], "left")
    new = {"resolution": F.col("_how"), "status": F.col("_status"), "resolved_by": F.col("_by"), "resolved_at": F.current_timestamp() if now is None else now}
    return out.select(*(F.when(F.col("_by").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in items.columns))


def next_version(baselines: DataFrame) -> DataFrame:
    """(project_id, version) that a new baseline of each project gets."""
    return baselines.groupBy("project_id").agg((F.max("version") + 1).alias("version"))


def nest(parents: DataFrame, key: str, **children: tuple[DataFrame, str, Column]) -> DataFrame:
    """Parents with an array for each child table, sorted; empty where there are none.

    A child is (table, its foreign key, what to collect). Children are gathered before the join, so they don't multiply.
    """
    out = parents
    for name, (child, foreign, value) in children.items():
        held = child.groupBy(F.col(foreign).alias(key)).agg(F.sort_array(F.collect_list(value)).alias(name))
        out = out.join(held, key, "left").withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))
    return out


def tracker_view(items: DataFrame, activities: DataFrame, requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Tracker items with the name of what they refer to, an activity or a request, and of their document."""
    a = activities.select(F.col("id").alias("a_id"), "activity_name")
    r = requests.select(F.col("id").alias("r_id"), "request_name")
    d = documents.select(F.col("id").alias("d_id"), "document_name")
    out = items.join(a, (F.col("item_type") == "ACTIVITY") & (F.col("reference_id") == F.col("a_id")), "left")
    out = out.join(r, (F.col("item_type") == "NEW_REQUEST") & (F.col("reference_id") == F.col("r_id")), "left")
    out = out.join(d, F.col("source_document_id") == F.col("d_id"), "left")
    name = F.when(F.col("item_type") == "ACTIVITY", F.col("activity_name")).otherwise(F.col("request_name"))
    return out.select(*items.columns, name.alias("item_name"), "document_name")


def orphans(child: DataFrame, key: Column, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose parent isn't there."""
    return child.join(parent.select(F.col(parent_key).alias("_pk")), key == F.col("_pk"), "left_anti")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
