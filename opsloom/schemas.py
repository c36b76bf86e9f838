"""Fixed table schemas."""

from __future__ import annotations



LOG_ENTRY = ("timestamp timestamp, service_name string, host_ip string, host_name string, log_level string, message string, "
             "component string, thread_id string, request_id string, error_code string, duration_ms double, "
             "tags array<string>, metadata map<string,double>")
EMBEDDING_DOC = ("content string, title string, source_type string, source_id string, service_name string, hostname string, "
                 "log_file string, line_number bigint, log_level string, timestamp timestamp, category string, "
                 "tags array<string>, author string, metadata string, chunk_index int, chunk_size int, parent_id string, "
                 "vector array<float>")
FULLTEXT_DOC = ("content string, title string, source_type string, source_id string, service_name string, hostname string, "
                "log_file string, line_number bigint, log_level string, timestamp timestamp, category string, "
                "tags array<string>, author string, metadata string, keywords array<string>, entities array<string>")
WIKI = "id string, title string, content string, category string, tags array<string>, last_updated string, author string"
CHANGE = ("id string, title string, description string, author string, created_at string, merged_at string, branch string, "
          "target_branch string, files_changed array<string>, changes struct<additions:int,deletions:int>, "
          "labels array<string>, status string")
TICKET = ("id string, key string, title string, summary string, description string, type string, priority string, "
          "status string, assignee string, reporter string, created string, updated string, resolved string, "
          "components array<string>, labels array<string>, resolution string")
INCIDENT = ("incident_id string, title string, occurred_at timestamp, resolved_at timestamp, duration_minutes int, "
            "severity string, affected_services array<string>, affected_call_paths array<string>, "
            "symptoms struct<user_facing:string,monitoring_alerts:array<string>>, "
            "root_cause struct<primary:string,secondary:string>, analysis_steps array<string>, resolution string, "
            "lessons_learned array<string>, "
            "impact_metrics struct<requests_affected:bigint,revenue_impact_usd:bigint,customers_affected:bigint>")
SESSION = "session_id string, user_id string, created_at timestamp, active boolean, metadata string"
MESSAGE = ("message_id string, session_id string, message string, response string, message_type string, "
           "created_at timestamp, tokens_used int, processing_time double, metadata string")
METRIC_SAMPLE = "metric string, labels map<string,string>, ts timestamp, value double, le double"
