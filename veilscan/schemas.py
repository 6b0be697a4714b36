"""Schemas of the library's tables."""

from __future__ import annotations

#: One file's text.
CHUNKS = "file_path string, content string, metadata map<string,string>"
#: A match that may become a finding; offsets count code points and are null for path rules.
CANDIDATE = "detector string, rule_name string, rule_idx int, entity_type string, category string, raw_value string, context string, confidence_score int, confidence double, severity string, requires_validation boolean, start int, end int"
FINDINGS = (
    "event_id string, timestamp timestamp, severity string, event_type string, source string, raw_extract string, vault_ref string, "
    "file_path string, detector string, entity_type string, masked_value string, context string, confidence double, line_number int, validated boolean"
)
ALERTS = (
    "event_id string, timestamp timestamp, severity string, event_type string, source string, raw_extract string, vault_ref string, "
    "honeytoken_path string, token_id string, token_type string, incident_type string, confidence double, process_name string, process_id int, "
    "username string, process_path string, attribution_source string"
)
HONEYTOKENS = "path string, token_id string, token_type string, deployed_at timestamp, content_hash string"
#: ``event_id`` is the watcher's own, null where it gives none.
FILE_EVENTS = "event_time timestamp, kind string, src_path string, dest_path string, is_directory boolean, event_id string"
SYSMON = "system_time timestamp, event_id int, target_filename string, command_line string, image string, process_id int, user string"
PROCESSES = "pid int, name string, exe string, username string, open_files array<string>"
