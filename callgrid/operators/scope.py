"""Tenant, role and time predicates, applied next to the scan so that they reach it."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE_TENANT = ("QA_ANALYST", "COMPLIANCE_OFFICER", "ADMIN")


@dataclass(frozen=True)
class Scope:
    organisation_id: str
    user_id: str
    role: str
    team_ids: tuple[str, ...] = field(default=())


class Denied(PermissionError):
    """The role may not use the operator."""


def scoped(df: DataFrame, scope: Scope) -> DataFrame:
    """Rows of the tenant that the role may see: an agent's own, a leader's teams, or all."""
    df = df.filter(F.col("organisation_id") == scope.organisation_id)
    if scope.role == "AGENT":
        return df.filter(F.col("agent_id") == scope.user_id)
    if scope.role == "TEAM_LEADER":
        return df.filter(F.col("team_id").isin(*scope.team_ids)) if scope.team_ids else df.filter(F.lit(False))
    return df if scope.role in WHOLE_TENANT else df.filter(F.lit(False))


def require(scope: Scope, *roles: str) -> None:
    if scope.role not in roles:
        raise Denied(f"one of {', '.join(roles)} is needed")


def alive() -> Column:
    return F.col("tombstoned_at").isNull()


def between(column: str, start: datetime, end: datetime, max_days: int) -> Column:
    """start <= column < end, after a check that the times have a zone and the range is allowed."""
    if start.tzinfo is None or end.tzinfo is None:
        raise ValueError("times need a time zone")
    if not timedelta(0) < end - start <= timedelta(days=max_days):
        raise ValueError(f"the range must be positive and at most {max_days} days")
    at = [F.timestamp_micros(F.lit(int(t.timestamp() * 1_000_000))) for t in (start, end)]
    return (F.col(column).cast("timestamp") >= at[0]) & (F.col(column).cast("timestamp") < at[1])


def resolve_memberships(members: DataFrame) -> DataFrame:
    """Subjects whose active memberships name one tenant and one identity, an agent also one team:
    subject, organisation_id, user_id, role, team_ids."""
    active = members.filter("is_active")
    found = active.groupBy("subject").agg(
        F.countDistinct("organisation_id", "user_id", "role").alias("n"),
        F.min("organisation_id").alias("organisation_id"),
        F.min("user_id").alias("user_id"),
        F.min("role").alias("role"),
        F.array_sort(F.collect_set("team_id")).alias("team_ids"),
    )
    teams = F.size("team_ids")
    fits = F.when(F.col("role") == "AGENT", teams == 1).when(F.col("role") == "TEAM_LEADER", teams >= 1).otherwise(True)
    return found.filter((F.col("n") == 1) & fits).drop("n")
