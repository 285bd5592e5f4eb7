"""Schemas of the tables that the operators work on, as DDL strings."""

VIDEOS = "pos int, video_id string, title string, url string, duration int, channel string, upload_date string, playlist_title string"
SNIPPETS = "video_id string, pos int, text string, start double, duration double"
TIER_ATTEMPTS = "video_id string, tier_ord int, tier string, enabled boolean, ok boolean, reason string, source string, language string"
CAPTION_TRACKS = "video_id string, pos int, language_code string, kind string, base_url string"
GLOSSARY = "entry_pos int, canonical string, aliases array<string>, reading string, category string"
NOUN_SHEET = "section_pos int, video_id string, title string, row_pos int, system_term string, user_correction string"
TOPICS = "batch int, pos int, topic_id string, label string, aliases array<string>, source_videos array<string>, duplication_count int, category string, summary string"
SEGMENTS = "video_id string, pos int, start_sec int, end_sec int, label string, summary string"
STEPS = "video_id string, pos int, start_sec int, end_sec int, label string, goal string, insight_ids array<string>"
VIDEO_RUNS = "video_id string, pos int, stage string, model string, cost decimal(18,6)"
NOTES = "folder string, filename string, unit string, content string"
FINDINGS = "iteration int, perspective string, severity string, target_scope string, target_video_id string, topic_ids array<string>, chapter_index int"
LLM_CALLS = "call_id string, attempt int, text string, model string, provider string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long, cost decimal(18,6), duration_ms long, stop_reason string"
STATS = "video_id string, channel string, title string, playlist_title string, transcript_source string, language string, retrieved_at timestamp, fallback_reason string, snippet_count long, error string"
