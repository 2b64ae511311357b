"""Evidence-linked technique mapping of detected episodes."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.operators.chain import stage_rows

# The two mapped techniques.
TECHNIQUES = {"T1005": ("Data from Local System", "collection"),
              "T1052.001": ("Exfiltration over USB", "exfiltration")}
# One suggestion per stage, and one for every candidate.
SUGGESTIONS = {
    "authentication": "Ask the owner of the account whether this login was theirs, and look at its other sessions",
    "collection": "Ask whoever owns the resource whether the account had a reason to read it",
    "transfer": "Find out whether somebody approved this copy to the medium",
}
PRESERVE = "Keep the cited records unchanged for later review"


def attack_map(found: DataFrame, events: DataFrame) -> DataFrame:
    """(technique, candidate, supporting observations) backed by the cited events."""
    facts = events.select(F.col("event_id").cast("string").alias("event_id"), "action", "destination_type")
    rows = stage_rows(found).select("candidate_id", "decision", "stage_id", "claim_status", "event_id").join(facts, "event_id")
    local = ((F.col("stage_id") == "collection") & (F.col("claim_status") == "supported_inference")
             & (F.col("action") == "file_read"))
    usb = ((F.col("stage_id") == "transfer") & (F.col("decision") == "incident")
           & (F.col("action") == "file_copy_to_usb") & (F.col("destination_type") == "removable_media"))
    return (rows.withColumn("technique_id", F.when(local, "T1005").when(usb, "T1052.001")).where("technique_id is not null")
            .groupBy("technique_id", "candidate_id").agg(F.count_distinct("event_id").alias("supporting_observations")))


def techniques(spark) -> DataFrame:
    return spark.createDataFrame([(i, name, tactic) for i, (name, tactic) in TECHNIQUES.items()],
                                 "technique_id string, technique_name string, tactic string")


def missing_support(mappings: DataFrame) -> DataFrame:
    """Techniques without any qualifying evidence."""
    return techniques(mappings.sparkSession).join(mappings, "technique_id", "left_anti")


def navigator_layer(mappings: DataFrame) -> DataFrame:
    """Layer entries: score is the supporting observations, at most 100."""
    support = mappings.groupBy("technique_id").agg(F.sum("supporting_observations").alias("support"))
    return support.select("technique_id", F.least("support", F.lit(100)).alias("score"), F.to_json(F.struct(
        F.col("technique_id").alias("techniqueID"), F.least("support", F.lit(100)).alias("score"),
        F.concat(F.col("support").cast("string"), F.lit(" supporting observations")).alias("comment"),
        F.lit(True).alias("enabled"))).alias("entry"))


def recommendations(found: DataFrame) -> DataFrame:
    """Suggestions per candidate with the evidence each cites."""
    texts = F.create_map(*[F.lit(x) for pair in SUGGESTIONS.items() for x in pair])
    staged = stage_rows(found).select("candidate_id", "stage_id", texts[F.col("stage_id")].alias("suggestion"),
                                      F.col("event_id").alias("evidence"))
    whole = found.select("candidate_id", F.lit("all").alias("stage_id"), F.lit(PRESERVE).alias("suggestion"),
                         F.array_join("selected", ",").alias("evidence"))
    return staged.unionByName(whole)
