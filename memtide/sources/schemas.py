"""Schemas of the stored tables."""

from __future__ import annotations

LIFECYCLE = "struct<importance:double,access_count:bigint,last_accessed_at:timestamp_ntz,created_at:timestamp_ntz,content_hash:string,stale:boolean>"
MESSAGE = "struct<role:string,content:string,metadata:map<string,string>,timestamp:timestamp_ntz>"
MEMORY = f"pos bigint, text string, embedding array<double>, created_at timestamp_ntz, source {MESSAGE}, lifecycle {LIFECYCLE}, metadata map<string,string>"
PROTOTYPE = "proto_id int, vec array<double>, strength double, access_count bigint, created_step int, last_access_step int"
SKILL = "id string, type string, name string, trigger_pattern string, expansion string, template string, required_context array<string>, confidence double, usage_count int, failure_count int, version int, deprecated boolean, created_at string, last_used string"
EVENT = "event_id bigint, workspace string, tool string, command string, ok boolean"
LONGMEMEVAL = "question_id string, question_type string, question string, question_date string, answer string, answer_session_ids array<string>, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"
STORE_ITEM = "id bigint, text string, importance double, embedding array<double>"
ACCESS = "pos bigint, at timestamp_ntz, seq bigint"
COUNTER = "name string, value bigint"
EDGE = "prev string, next string, cnt bigint"
EXCHANGE = "struct<role:string,content:string>"
