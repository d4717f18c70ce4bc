"""Declared schemas of the state tables and of the nested documents."""

from __future__ import annotations

from pyspark.sql import types as T

# Table layouts. Every time stamp is a UTC TIMESTAMP, every flag a BOOLEAN.
TABLES: dict[str, str] = {
    "channels": "id BIGINT, login STRING, platform_user_id STRING, display_name STRING, notes STRING, "
    "config_json STRING, created_at TIMESTAMP",
    "sessions": "id BIGINT, channel_id BIGINT, platform_stream_id STRING, source STRING, title STRING, "
    "category STRING, meta_history ARRAY<STRUCT<at: TIMESTAMP, title: STRING, category: STRING>>, "
    "started_at TIMESTAMP, ended_at TIMESTAMP, status STRING, final_summary STRING, last_error STRING, "
    "last_error_at TIMESTAMP",
    "monitor_leases": "key STRING, session_id BIGINT, owner STRING, expires_at DOUBLE, stop_requested BOOLEAN",
    "speakers": "id BIGINT, channel_id BIGINT, name STRING, role STRING, confirmed BOOLEAN, "
    "speech_seconds DOUBLE, consent_note STRING, created_at TIMESTAMP",
    "speaker_embeddings": "id BIGINT, speaker_id BIGINT, embedding ARRAY<FLOAT>, dim INT, model STRING, "
    "seconds DOUBLE, source STRING, created_at TIMESTAMP",
    "windows": "id BIGINT, session_id BIGINT, t_start DOUBLE, t_end DOUBLE, status STRING, "
    "extraction_json STRING, window_summary STRING, model STRING, latency_ms BIGINT, tokens_in BIGINT, "
    "tokens_out BIGINT, cost_usd DOUBLE, created_at TIMESTAMP, boot_epoch BIGINT",
    "segments": "id BIGINT, session_id BIGINT, window_id BIGINT, t_start DOUBLE, t_end DOUBLE, "
    "wall_start TIMESTAMP, text STRING, words_json STRING, asr_model STRING, asr_conf DOUBLE, "
    "speaker_id BIGINT, speaker_conf DOUBLE, speaker_flags STRING",
    "segment_embeddings": "segment_id BIGINT, embedding ARRAY<FLOAT>, model STRING",
    "entities": "id BIGINT, channel_id BIGINT, type STRING, canonical_name STRING, description STRING, "
    "status STRING, merged_into BIGINT, needs_review BOOLEAN, voiced_by_speaker_id BIGINT, "
    "mention_count BIGINT, first_seen_session BIGINT, last_seen_at TIMESTAMP",
    "entity_aliases": "entity_id BIGINT, alias STRING, source STRING",
    "threads": "id BIGINT, channel_id BIGINT, title STRING, summary STRING, status STRING, "
    "importance INT, last_updated_at TIMESTAMP",
    "events": "id BIGINT, session_id BIGINT, window_id BIGINT, t_start DOUBLE, t_end DOUBLE, type STRING, "
    "description STRING, importance INT, thread_id BIGINT, streamer_role STRING",
    "event_participants": "event_id BIGINT, entity_id BIGINT",
    "attributions": "segment_id BIGINT, kind STRING, entity_id BIGINT, confidence DOUBLE, evidence STRING, "
    "method STRING",
    "summaries": "id BIGINT, session_id BIGINT, kind STRING, covers_t_start DOUBLE, covers_t_end DOUBLE, "
    "text STRING, model STRING, tokens_in BIGINT, tokens_out BIGINT, cost_usd DOUBLE, created_at TIMESTAMP, "
    "cache_key STRING",
    "summary_feedback": "id BIGINT, summary_id BIGINT, session_id BIGINT, kind STRING, vote STRING, "
    "created_at TIMESTAMP",
    "corrections": "id BIGINT, target_type STRING, target_id BIGINT, before_json STRING, after_json STRING, "
    "created_at TIMESTAMP",
    "ingest_gaps": "id BIGINT, session_id BIGINT, t_start DOUBLE, t_end DOUBLE, reason STRING, boot_epoch BIGINT",
    "plot_beats": "id BIGINT, session_id BIGINT, hour_index BIGINT, run_label STRING, wall_start TIMESTAMP, "
    "wall_end TIMESTAMP, t_start DOUBLE, t_end DOUBLE, headline STRING, context STRING, significance INT, "
    "status STRING, continues_beat_id BIGINT, prompt_version STRING, model STRING, tokens_in BIGINT, "
    "tokens_out BIGINT, cost_usd DOUBLE, created_at TIMESTAMP",
    "beat_runs": "session_id BIGINT, hour_index BIGINT, run_label STRING, status STRING, reason STRING, "
    "created_at TIMESTAMP",
    "beat_events": "beat_id BIGINT, event_id BIGINT",
    "consents": "id BIGINT, channel_id BIGINT, speaker_id BIGINT, note STRING, granted_by STRING, "
    "granted_at TIMESTAMP, revoked_at TIMESTAMP",
}

# Nested documents exchanged with models.
EXTRACTION = (
    "STRUCT<"
    "utterance_attributions: ARRAY<STRUCT<segment_id: BIGINT, kind: STRING, entity_ref: STRING, "
    "confidence: DOUBLE, evidence: STRING>>, "
    "entity_updates: ARRAY<STRUCT<ref: STRING, type: STRING, aliases_seen: ARRAY<STRING>, "
    "description_delta: STRING, confidence: DOUBLE>>, "
    "thread_updates: ARRAY<STRUCT<ref: STRING, status: STRING, delta: STRING, participants: ARRAY<STRING>, "
    "confidence: DOUBLE>>, "
    "events: ARRAY<STRUCT<t_start: DOUBLE, t_end: DOUBLE, type: STRING, description: STRING, "
    "confidence: DOUBLE, importance: INT, participants: ARRAY<STRING>, thread_ref: STRING, "
    "streamer_role: STRING>>, "
    "window_summary: STRING, open_questions: ARRAY<STRING>>"
)
GOLD = (
    "transcript STRING, events ARRAY<STRING>, entities ARRAY<STRING>, threads ARRAY<STRING>, "
    "summary_facts ARRAY<STRING>"
)
BEATS = "STRUCT<beats: ARRAY<STRUCT<headline: STRING, significance: INT, event_ids: ARRAY<BIGINT>>>>"
CHANNEL_CONFIG = (
    "STRUCT<content_profile: STRING, auto_monitor: BOOLEAN, streamer: STRUCT<name: STRING, entity_id: BIGINT, "
    "aliases: ARRAY<STRING>, characters: ARRAY<STRUCT<name: STRING, context: STRING>>, pov_mode: STRING>>"
)
ANSWERS = "MAP<STRING, STRUCT<score: STRING, confidence: STRING, noul: STRING, choice: STRING>>"


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])
