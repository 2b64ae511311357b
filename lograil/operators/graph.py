"""Typed directed provenance graph as two tables, nodes and edges."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograil.functions.identity import entity_id
from lograil.operators.history import completed
from lograil.operators.ordered import micros

# Entity kind of each identifier column.
KINDS = {"user_id": "user", "device_id": "endpoint", "app_id": "app", "resource_id": "file",
         "removable_device_id": "removable_device"}


def iso_utc(moment: str = "event_time") -> Column:
    """ISO 8601 with offset; the fraction appears only when there is one."""
    fraction = F.pmod(micros(moment), F.lit(1_000_000))
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(fraction == 0, "").otherwise(F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))),
                    F.lit("+00:00"))


def _address(environment: str, column: str) -> Column:
    # An address is context of one observation, not a lasting identity.
    return F.when(F.col(column).isNotNull() & completed(),
                  entity_id(environment, "ip", F.concat(F.col(column), F.lit("@"), iso_utc())))


def graph_nodes(events: DataFrame, environment: str) -> DataFrame:
    entries = [F.struct(F.col(c).alias("node_id"), F.lit(kind).alias("entity_type")) for c, kind in KINDS.items()]
    entries += [F.struct(_address(environment, c).alias("node_id"), F.lit("ip").alias("entity_type")) for c in ("src_ip", "dst_ip")]
    return events.select(F.inline(F.array(*entries))).where("node_id is not null").distinct()


def _edges(condition: Column, left: Column | str, right: Column | str, relation: str, status: str = "observed") -> Column:
    left = F.col(left) if isinstance(left, str) else left
    right = F.col(right) if isinstance(right, str) else right
    return F.when(condition & left.isNotNull() & right.isNotNull(), F.struct(
        left.alias("source"), right.alias("target"), F.lit(relation).alias("relation"), F.lit(status).alias("status")))


def graph_edges(events: DataFrame, environment: str, links: DataFrame | None = None) -> DataFrame:
    """One row per relation of a completed observation; the edge id hashes event, relation and ends."""
    action = F.col("action")
    copied = (action == "file_copy_to_usb") & (F.col("destination_type") == "removable_media") & (F.col("bytes_written") > 0)
    always = F.lit(True)
    relations = [
        _edges(action == "login_success", "user_id", "app_id", "authenticated_to"),
        _edges(action == "login_success", "user_id", "device_id", "session_on"),
        _edges(action == "file_read", "user_id", "resource_id", "read_file"),
        _edges(action == "file_read", "resource_id", "device_id", "local_file_on"),
        _edges(action == "usb_mount", "removable_device_id", "device_id", "mounted_on"),
        _edges(copied, "resource_id", "removable_device_id", "copied_to"),
        _edges(copied, "user_id", "device_id", "copy_on"),
        _edges(always, "device_id", _address(environment, "src_ip"), "connected_from"),
        _edges(always, "device_id", _address(environment, "dst_ip"), "connected_to")]
    facts = [F.col("event_id").cast("string").alias("event_id"), micros().alias("us"), "source_type",
             F.col("user_id").alias("actor"), F.col("device_id").alias("endpoint")]
    edges = events.where(completed()).select(*facts, F.inline(F.array_compact(F.array(*relations))))
    if links is not None:
        both = events.join(links.select("event_id", "original_user_id", "canonical_user_id"), "event_id")
        alias = F.array(_edges(always, "original_user_id", "canonical_user_id", "trusted_alias", "supported_inference"))
        edges = edges.unionByName(both.select(*facts, F.inline(F.array_compact(alias))))
    return edges.withColumn("edge_id", F.sha2(F.to_json(F.array("event_id", "relation", "source", "target")), 256))


def incident_graph(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each candidate's cited events."""
    cited = found.select("candidate_id", F.explode("selected").alias("event_id"))
    return edges.join(cited, "event_id")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).withColumn("edges", edges.agg(F.count("*")).scalar()).withColumn(
        "independent_events", edges.agg(F.count_distinct("event_id")).scalar())


def requirement_errors(found: DataFrame, events: DataFrame, edges: DataFrame) -> DataFrame:
    """Typed relations a candidate's stages need and the graph lacks."""
    need = lambda event, *relations: F.transform(F.array(*[F.lit(r) for r in relations]), lambda r: F.struct(
        F.col(event).cast("string").alias("event_id"), r.alias("relation")))
    required = F.concat(need("login_id", "authenticated_to", "session_on"), need("read_id", "read_file", "local_file_on"),
                        F.when(F.col("copy_id").isNotNull(), F.concat(
                            need("copy_id", "copied_to", "copy_on"), need("mount_id", "mounted_on"))).otherwise(
                                F.array().cast("array<struct<event_id:string,relation:string>>")))
    ends = {"authenticated_to": ("user_id", "app_id"), "session_on": ("user_id", "device_id"),
            "read_file": ("user_id", "resource_id"), "local_file_on": ("resource_id", "device_id"),
            "copied_to": ("resource_id", "removable_device_id"), "copy_on": ("user_id", "device_id"),
            "mounted_on": ("removable_device_id", "device_id")}
    end = lambda side: F.coalesce(*[F.when(F.col("relation") == r, F.col(pair[side])) for r, pair in ends.items()])
    asked = found.select("candidate_id", F.col("user_id").alias("actor"), F.col("device_id").alias("endpoint"), F.inline(required))
    facts = events.select(F.col("event_id").cast("string").alias("event_id"), micros().alias("us"), "user_id", "device_id",
                          "app_id", "resource_id", "removable_device_id")
    resolved = asked.join(facts, "event_id", "left").withColumn("source", end(0)).withColumn("target", end(1))
    return resolved.join(edges, ["event_id", "relation", "source", "target", "actor", "endpoint", "us"], "left_anti").select(
        "candidate_id", "relation", "event_id")


def graph_page(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """First `limit` nodes by id and the edges between them; nodes carry the total."""
    ids = nodes.select("node_id").distinct()
    page = ids.orderBy("node_id").limit(limit)
    inner = edges.join(page.withColumnRenamed("node_id", "source"), "source", "left_semi").join(
        page.withColumnRenamed("node_id", "target"), "target", "left_semi")
    total = ids.agg(F.count("*"))
    return page.withColumn("total_nodes", total.scalar()).withColumn("truncated", F.col("total_nodes") > limit), inner
