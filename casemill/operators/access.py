"""Who may see which document: explicit denials, explicit permits, family grants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def document_decision(docs: DataFrame, principals: DataFrame, roles: DataFrame, grants: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(principal, doc_id, decision) for every principal and document: EXPLICIT_DENY, PERMIT or DEFAULT_DENY.

    docs: doc_id, family.  principals: principal.  roles: principal, role.  grants: role, family.
    exceptions: subject (a principal or a role), doc_id, effect (ALLOW or DENY), revoked.  A denial beats
    a permit; a permit or a granted family allows; else it is denied.  Principals are the asked ones, a
    batch, not the user base.
    """
    subjects = principals.select("principal", F.col("principal").alias("subject")).unionByName(roles.select("principal", F.col("role").alias("subject"))).distinct()
    rules = exceptions.where("not revoked").join(subjects, "subject").groupBy("principal", "doc_id").agg(F.max(F.col("effect") == "DENY").alias("deny"), F.max(F.col("effect") == "ALLOW").alias("allow"))
    families = roles.join(grants, "role").select("principal", "family").distinct().withColumn("granted", F.lit(True))
    every = docs.crossJoin(principals)  # the decision table itself: one row per pair asked for
    x = every.join(rules, ["principal", "doc_id"], "left").join(families, ["principal", "family"], "left")
    decision = F.when(F.col("deny"), "EXPLICIT_DENY").when(F.col("allow") | F.col("granted"), "PERMIT").otherwise("DEFAULT_DENY")
    return x.select("principal", "doc_id", decision.alias("decision"))


def authorized_documents(docs: DataFrame, principals: DataFrame, roles: DataFrame, grants: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(principal, doc_id) that may be seen, without a row for pairs that may not: granted families and permits, less denials."""
    subjects = principals.select("principal", F.col("principal").alias("subject")).unionByName(roles.select("principal", F.col("role").alias("subject"))).distinct()
    active = exceptions.where("not revoked").join(subjects, "subject")
    by_family = docs.join(roles.join(principals, "principal").join(grants, "role").select("principal", "family").distinct(), "family").select("principal", "doc_id")
    by_name = active.where("effect = 'ALLOW'").join(docs.select("doc_id"), "doc_id").select("principal", "doc_id")
    denied = active.where("effect = 'DENY'").select("principal", "doc_id")
    return by_family.unionByName(by_name).distinct().join(denied, ["principal", "doc_id"], "left_anti")


def effective_permissions(users: DataFrame, roles: DataFrame, permissions: DataFrame) -> DataFrame:
    """Distinct (principal, permission) of active roles."""
    return users.join(roles.where("active").select("role"), "role").join(permissions, "role").select("principal", "permission").distinct()


def upsert_exceptions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rules after an update: the last active one per subject and document stays active; earlier ones keep or get a revocation time."""
    both = existing.unionByName(new)
    by = Window.partitionBy("subject", "doc_id").orderBy(F.desc("at"), F.desc("rule_id"))
    x = both.withColumn("n", F.row_number().over(by)).withColumn("next_at", F.lag("at").over(by))
    return x.withColumn("revoked_at", F.when(F.col("n") > 1, F.coalesce("revoked_at", "next_at")).otherwise(F.col("revoked_at"))).drop("n", "next_at")
