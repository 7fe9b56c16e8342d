"""Row access: which datasets a user may read or export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dielens.functions.columns import ntz

# The permission each access mode needs.
MODE_PERMISSION = {"READ": "DATASET_READ", "EXPORT": "EXPORT_DATA"}


def authorized_datasets(user: str, mode: str, iam: dict[str, DataFrame], datasets: DataFrame, now: str) -> DataFrame:
    """Datasets in the scope of an unexpired grant of an active user whose role carries the permission.

    ``iam``: users, user_roles, role_permissions, grants.  Every dataset lists
    the scope keys it falls under, and an equi semi-join looks them up in the
    user's few grants.  Being an administrator opens nothing by itself.
    """
    person = iam["users"].where((F.col("user_code") == user) & (F.col("status") == "ACTIVE")).select("user_id")
    roles = iam["user_roles"].where("active").join(person, "user_id", "left_semi").select("user_id", "role_code")
    allowed = iam["role_permissions"].where(F.col("permission_code") == MODE_PERMISSION[mode])
    capable = roles.join(allowed.select("role_code"), "role_code", "left_semi")
    live = iam["grants"].where(
        (F.col("permission_mode") == mode) & (F.col("expires_at_utc").isNull() | (F.col("expires_at_utc") > ntz(now)))
    )
    own = live.join(capable.select("user_id").distinct(), "user_id", "left_semi")
    by_role = live.join(capable.select("role_code").distinct(), "role_code", "left_semi")
    scopes = own.select("scope_type", "scope_key").union(by_role.select("scope_type", "scope_key")).distinct()
    keys = {
        "GLOBAL": F.lit("*"),
        "PROJECT": F.col("project_code"),
        "PRODUCT": F.col("product_code"),
        "SUPPLIER": F.col("supplier_id").cast("string"),
        "OWNER": F.col("owner_user_id").cast("string"),
        "DEPARTMENT": F.col("department"),
    }
    listed = F.array(*[F.struct(F.lit(t).alias("scope_type"), k.alias("scope_key")) for t, k in keys.items()])
    in_scope = datasets.select("dataset_id", F.inline(listed)).join(scopes, ["scope_type", "scope_key"], "left_semi")
    return in_scope.select("dataset_id").distinct()


def denied_access_report(requests: DataFrame, authorized: DataFrame) -> DataFrame:
    """Requested objects outside the requester's scope."""
    return requests.join(authorized, ["user_code", "dataset_id"], "left_anti")
