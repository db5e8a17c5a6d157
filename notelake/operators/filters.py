"""Row filters and projections of notes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields that may leave the device, but for text and redacted, which depend on the scope; tags and schema go under their column names.
CLOUD_FIELDS = [
    "kind", "asset", "tag_text", "site", "scope", "category", "priority", "device_id", "origin_device", "author", "created_at", "updated_at", "rev",
    "status", "supersedes", "superseded_by", "relation", "schema_text", "expires_at", "review", "reviewed_by", "reviewed_at", "review_reason", "role",
]


def blank(c: Column) -> Column:
    """The column with '' as null: a missing text and an empty one are alike."""
    return F.nullif(c, F.lit(""))


def keyword(must: dict | None = None, must_not: dict | None = None) -> Column:
    """All of ``must`` hold and none of ``must_not``; a list means any of it; None, '' and [] set no condition; a null field never matches."""

    def one(field: str, value) -> Column:
        return F.coalesce(F.col(field).isin(*value) if isinstance(value, (list, tuple)) else F.col(field) == value, F.lit(False))

    out = F.lit(True)
    for field, value in (must or {}).items():
        if value not in (None, "", []):
            out = out & one(field, value)
    for field, value in (must_not or {}).items():
        if value not in (None, "", []):
            out = out & ~one(field, value)
    return out


def expired(now) -> Column:
    """Whether a note's time is up; ``now`` is a column or a timestamp text."""
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
    return F.coalesce(F.col("expires_at") <= at, F.lit(False))


def may_see(supervisor: bool = False, prefix: str = "") -> Column:
    """A note that waits for review is seen by supervisors, or by all if urgent."""
    pending = F.col(f"{prefix}review").eqNullSafe("pending")
    return F.lit(True) if supervisor else ~pending | (F.col(f"{prefix}priority") >= 2)


def shareable() -> Column:
    return (F.col("scope") != "private") & ~F.col("withdrawn") & (F.col("sync_state") != "private")


def in_site(site: str) -> Column:
    return F.col("site").isin(site, "global")


def outgoing_text() -> Column:
    """The masked text of a redacted note, or its text where there is none."""
    return F.when(F.col("scope") == "redacted", F.coalesce(blank(F.col("shared_text")), F.col("text"))).otherwise(F.col("text"))


def cloud_view(notes: DataFrame) -> DataFrame:
    return notes.select("memory_id", *CLOUD_FIELDS, outgoing_text().alias("text"), (F.col("scope") == "redacted").alias("redacted"))


def tombstone(notes: DataFrame, reason: Column | None = None) -> DataFrame:
    """A deletion marker for each note, a revision on."""
    return notes.select("memory_id", F.lit("deleted").alias("status"), F.lit("").alias("text"), (F.col("rev") + 1).alias("rev"), "device_id", "site", (reason if reason is not None else F.lit("deleted")).alias("tombstone"))


def schema_gate(notes: DataFrame, current: int = 1) -> DataFrame:
    """version and held (newer than known) for each note; a missing or unreadable version is 0 and is brought up to ``current``."""
    version = F.coalesce(F.col("schema_text").try_cast("int"), F.lit(0))
    return notes.select("memory_id", version.alias("version"), (version > current).alias("held"), F.greatest(version, F.lit(current)).alias("version_after"))


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row for each key by ``order``."""
    from pyspark.sql.window import Window

    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")
