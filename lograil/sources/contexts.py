"""Context tables: row validation and the three merge policies."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograil.functions.identity import record_sha256

# Which identifiers of a context must lie in the environment's namespace.
SCOPES = {"resources": {"resource_id": "file"}, "aliases": {"alias_user_id": "user", "canonical_user_id": "user"},
          "authorizations": {"user_id": "user", "device_id": "endpoint", "resource_id": "file"}}
KEYS = {"resources": ["resource_id"], "authorizations": ["authorization_id"]}


def context_error(kind: str, environment: str) -> Column:
    """First broken rule of a context row, else null."""
    checks = [F.when(F.trim(F.coalesce("provenance", F.lit(""))) == "", "provenance must be nonblank")]
    for name, scope in SCOPES[kind].items():
        prefix = f"{environment}:{scope}:"
        inside = F.col(name).startswith(prefix)
        if kind == "authorizations":
            inside = inside & (F.col(name) != prefix)
        checks.append(F.when(~F.coalesce(inside, F.lit(False)), F.lit(f"{name} is outside this environment")))
    if kind == "aliases":
        checks.append(F.when(F.col("alias_user_id") == F.col("canonical_user_id"), "alias must refer to a distinct account"))
    if kind == "authorizations":
        checks.append(F.when(F.col("effective_until").isNull(), "authorization needs an end"))
    checks.append(F.when(F.col("effective_from").isNull(), "interval needs a start"))
    checks.append(F.when(F.col("effective_until") <= F.col("effective_from"), "interval must increase"))
    return F.coalesce(*checks)


def validate_context(rows: DataFrame, kind: str, environment: str) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rows with `error`; authorization ids must also be unique."""
    checked = rows.withColumn("error", context_error(kind, environment))
    if kind == "authorizations":
        repeated = rows.groupBy("authorization_id").agg(F.count("*").alias("_n")).where("_n > 1")
        checked = (checked.join(repeated, "authorization_id", "left")
                   .withColumn("error", F.coalesce("error", F.when(F.col("_n").isNotNull(), "authorization id is not unique")))
                   .drop("_n"))
    return checked.where("error is null").drop("error"), checked.where("error is not null")


def merge_context(current: DataFrame, incoming: DataFrame, kind: str, order: str | None = None) -> DataFrame:
    """resources: upsert by key (greatest `order` wins inside incoming) · authorizations: replace those of
    the incoming datasets · aliases: insert unless the same content is already there."""
    if kind == "authorizations":
        replaced = incoming.select("dataset_id").distinct()
        return current.join(replaced, current["dataset_id"].eqNullSafe(replaced["dataset_id"]), "left_anti").unionByName(incoming)
    if kind == "aliases":
        columns = current.columns
        both = current.select(*columns).unionByName(incoming.select(*columns))
        # Equal content has one hash; keeping one row per hash is the insert-or-ignore.
        return both.withColumn("content_sha256", record_sha256(columns)).dropDuplicates(["content_sha256"]).drop("content_sha256")
    key = KEYS[kind]
    rest = [c for c in current.columns if c not in key]
    newest = incoming.groupBy(*key).agg(F.max_by(F.struct(*rest), order or "effective_from").alias("_new")).select(*key, "_new.*")
    return current.join(newest.select(*key), key, "left_anti").unionByName(newest)
