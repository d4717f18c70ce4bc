"""Voice consent and retention of what depends on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions import times as TM
from recapflow.params import DEFAULTS, Params

DAY = 86400


def active(consents: DataFrame, now: Column, p: Params = DEFAULTS) -> DataFrame:
    """Speakers whose latest consent row is not revoked and not older than the limit (0: no limit)."""
    last = consents.groupBy("speaker_id").agg(F.max_by(F.struct("id", "granted_at", "revoked_at"), "id").alias("c")).select("speaker_id", "c.*")
    valid = last.where("revoked_at IS NULL")
    if p.consent_ttl_days <= 0:
        return valid
    return valid.where(TM.seconds_between(now, F.col("granted_at")) <= p.consent_ttl_days * DAY)


def grant(consents: DataFrame, grants: DataFrame, now: Column) -> DataFrame:
    """Append grants (id, channel_id, speaker_id, note, granted_by)."""
    rows = grants.withColumns({
        "granted_at": now, "revoked_at": F.lit(None).cast("timestamp"), "granted_by": F.coalesce("granted_by", F.lit("owner"))
    })
    return consents.unionByName(rows.select(*consents.columns))


def revoke(consents: DataFrame, embeddings: DataFrame, speakers: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(consents, embeddings) after revoking all open consents of ``speakers`` (speaker_id)."""
    gone = speakers.select("speaker_id").distinct()
    stamped = consents.join(gone.withColumn("__r", F.lit(True)), "speaker_id", "left").withColumn(
        "revoked_at", F.when(F.col("__r") & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))
    )
    return stamped.select(*consents.columns), embeddings.join(gone, "speaker_id", "left_anti")


def expired(stamp: Column, now: Column, hours: float) -> Column:
    """Older than ``hours``; an unreadable stamp counts as expired."""
    age = TM.seconds_between(now, TM.parse_iso(stamp))
    return F.coalesce(age > hours * TM.HOUR, F.lit(True))
