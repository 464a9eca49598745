"""Row types of the library's tables."""

from __future__ import annotations

# Names of the decisions, grounding passes and events.
DECISIONS = ("BLOCK", "REVIEW", "AUTO_ACCEPT")
PASSES = ("exact", "normalized", "failed")
EVENTS = ("extract", "edit", "certify", "run")

BLOCK = "doc_id long, ord int, page int, y0 double, size double, text string"
SECTION = "doc_id long, ord int, page int, y0 double, level int, title string, type string"
CELL = "doc_id long, engine string, page int, table_ix int, row int, col int, text string"
QUOTE = "struct<text:string,verify_pass:string,page:int,start:int,end:int>"
CANDIDATE = f"doc_id long, domain string, field string, value string, method string, is_model boolean, ord int, quote {QUOTE}"
FINDING = "doc_id long, kind string, severity string, domain string, message string, expected string, found string"
AUDIT = "record_id string, seq long, source_sha256 string, run_id string, event string, ts timestamp, domain string, field string, value string, prior_value string, decision string, confidence double, method string, model string, quote string, reviewer string"
LABEL = "study_id string, domain string, field string, label string, kind string"
