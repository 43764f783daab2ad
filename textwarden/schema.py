"""Declared schemas and dimensions."""

from __future__ import annotations

EXAMPLE = "text string, label string, category string, source string, original_category string, dataset string, agreement double, target string, fixed string, fix_reason string, annotator string"
FEEDBACK = "feedback_id string, tenant_id string, request_id string, input_hash string, input_length int, original_decision string, original_categories array<string>, original_confidence double, feedback_type string, corrected_category string, comment string, timestamp timestamp, reviewed boolean, included_in_training boolean, approved boolean, reviewed_at timestamp, reviewed_by string, trained_at timestamp"
LEARNED = "patterns array<struct<pattern:string,name:string,category:string,source_feedback:string,added_at:string>>, metadata struct<created:string,last_updated:string,total_patterns:int>"
RAW_COMMENT = "text string, subreddit string, score int, post_title string, source string, likes int, author string, video_id string, channel string, search_query string"
# Codes of the labelled set.
DECISIONS = {"ALLOW": 0, "WARN": 1, "BLOCK": 2}
CATEGORIES = ("safe", "harassment", "hate_speech", "sexual", "self_harm", "threat", "violence", "fraud_or_scam", "other")
# Actions, severities with rank, kinds of feedback.
ACTIONS = ("allow", "allow_with_warning", "redact", "block")
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
FEEDBACK_TYPES = ("correct", "false_positive", "false_negative", "category_correction")
CATEGORY_CODES = {"harassment": 0, "hate_speech": 1, "threat": 2, "violence": 3, "sexual": 4, "self_harm": 5, "fraud_or_scam": 6, "other": 7, "safe": 8}
# Typical decision of each severity.
SEVERITY_BANDS = {0: "ALLOW", 1: "ALLOW or WARN", 2: "WARN", 3: "BLOCK", 4: "BLOCK"}
