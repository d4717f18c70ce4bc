"""Channel configuration, streamer identity, content profile and landed live status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.params import DEFAULTS, Params
from recapflow.schemas import CHANNEL_CONFIG

# Point-of-view modes, content profiles, their evaluation focus, login format.
POV_MODES = ("participant", "observer")
PROFILES = ("roleplay", "gaming", "just_chatting")
DUPLICATE_THRESHOLD = {"roleplay": 0.10, "gaming": 0.10, "just_chatting": 0.15}
MIN_SPEAKERS = {"roleplay": 2, "gaming": 1, "just_chatting": 2}
LOGIN_PATTERN = "^[A-Za-z0-9_]{1,25}$"


def _lookup(values: dict, key: Column) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def channel_config(channels: DataFrame, out: str = "config") -> DataFrame:
    """Parse ``config_json``; unreadable or missing JSON gives a config with NULL fields."""
    parsed = F.from_json("config_json", CHANNEL_CONFIG)
    empty = F.from_json(F.lit("{}"), CHANNEL_CONFIG)
    return channels.withColumn(out, F.coalesce(parsed, empty))


def streamer(channels: DataFrame) -> DataFrame:
    """Streamer identity per channel: configured name, else login, else a fixed word."""
    st = F.col("config.streamer")
    given = st.isNotNull() & F.to_json(st).isNotNull() & (F.to_json(st) != "{}")
    return channel_config(channels).select(
        F.col("id").alias("channel_id"),
        F.coalesce(F.nullif(st["name"], F.lit("")), F.nullif("login", F.lit("")), F.lit("streamer")).alias("name"),
        st["entity_id"].alias("entity_id"),
        F.coalesce(st["aliases"], F.array().cast("array<string>")).alias("aliases"),
        F.coalesce(F.transform(st["characters"], lambda c: c["name"]), F.array().cast("array<string>")).alias("characters"),
        F.when(st["pov_mode"].isin(*POV_MODES), st["pov_mode"]).otherwise("participant").alias("pov_mode"),
        F.when(given, "config").otherwise("fallback").alias("source"),
    )


def is_streamer(entities: DataFrame, channels: DataFrame) -> DataFrame:
    """Entities with a flag for the configured streamer entity of their channel."""
    ids = streamer(channels).where("entity_id IS NOT NULL").select("channel_id", F.col("entity_id").alias("__streamer"))
    return (
        entities.join(ids, "channel_id", "left")
        .withColumn("is_streamer", F.coalesce(F.col("__streamer") == F.col("id"), F.lit(False)))
        .drop("__streamer")
    )


def profile(channels: DataFrame, p: Params = DEFAULTS, strict: bool = False) -> DataFrame:
    """Content profile of every channel with the profile whose hint applies (unknown: roleplay)."""
    chosen = F.coalesce(F.col("config.content_profile"), F.lit(p.content_profile))
    if strict:
        message = F.concat(F.lit("unknown content profile "), chosen)
        chosen = F.when(chosen.isin(*PROFILES), chosen).otherwise(F.raise_error(message))
    return channel_config(channels).select(
        F.col("id").alias("channel_id"), chosen.alias("profile"),
        F.when(chosen.isin(*PROFILES), chosen).otherwise("roleplay").alias("hint"),
    )


def focus(profiles: DataFrame) -> DataFrame:
    """Evaluation focus of a profile."""
    c = F.col("hint")
    return profiles.withColumn("duplicate_threshold", _lookup(DUPLICATE_THRESHOLD, c).cast("double")).withColumn(
        "min_speakers", _lookup(MIN_SPEAKERS, c).cast("int")
    )


def auto_channels(channels: DataFrame) -> DataFrame:
    """Channels whose config asks for automatic monitoring."""
    return channel_config(channels).where(F.coalesce("config.auto_monitor", F.lit(False))).drop("config")


def set_config(channels: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply (channel_id, auto_monitor, content_profile) edits to ``config_json``; NULL keeps a value. All other keys
    of the document stay as they are; an unreadable document counts as empty."""
    def put(doc: Column, key: str, value: Column) -> Column:
        rest = F.map_filter(doc, lambda k, _: k != key)
        return F.when(value.isNull(), doc).otherwise(F.map_concat(rest, F.create_map(F.lit(key), F.parse_json(value))))

    empty = F.create_map().cast("map<string,variant>")
    doc = F.coalesce(F.try_variant_get(F.try_parse_json("config_json"), "$", "map<string,variant>"), empty)
    profile = F.when(F.col("__profile").isNotNull(), F.regexp_replace(F.to_json(F.array("__profile")), r"^\[|\]$", ""))
    changes = edits.select(
        F.col("channel_id").alias("id"), F.col("auto_monitor").cast("string").alias("__auto"),
        F.col("content_profile").alias("__profile"), F.lit(True).alias("__edit"),
    )
    new = put(put(doc, "content_profile", profile), "auto_monitor", F.col("__auto"))
    return (
        channels.join(changes, "id", "left")
        .withColumn("config_json", F.when(F.col("__edit"), F.to_json(new)).otherwise(F.col("config_json")))
        .select(*channels.columns)
    )


def valid_login(c: Column) -> Column:
    return X.strip(c).rlike(LOGIN_PATTERN)


def new_channels(requests: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Accepted channel requests with the stored form of login and config.

    ``requests``: login, content_profile, auto_monitor."""
    chosen = F.coalesce(F.nullif("content_profile", F.lit("")), F.lit(p.content_profile))
    return requests.where(valid_login(F.col("login")) & chosen.isin(*PROFILES)).select(
        F.lower(X.strip(F.col("login"))).alias("login"),
        F.to_json(F.struct(chosen.alias("content_profile"), F.coalesce("auto_monitor", F.lit(False)).alias("auto_monitor"))).alias("config_json"),
    )


def stream_status(landed: DataFrame) -> DataFrame:
    """Channels that are live in a landed status snapshot: lower-cased login with stream id and labels."""
    return landed.where(F.col("type") == "live").select(
        F.lower("login").alias("login"), "stream_id", "title", "category"
    )
