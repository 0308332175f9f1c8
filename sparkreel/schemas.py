"""Schemas of the tables the operators work on; missing columns of old files read as NULL."""

TRANSCRIPT_LINES = "video_id string, line_idx int, text string, start double, duration double"
CANDIDATES = ("video_id string, ord int, title string, start_index int, end_index int, start_time double, end_time double, "
              "reason string, shorts_title string, shorts_description string, shorts_tags array<string>, "
              "virality_score double, detailed_scores map<string,double>")
CLIP_ANALYTICS = ("clip_id string, video_id string, virality_score double, detailed_scores map<string,double>, platform string, "
                  "views bigint, likes bigint, comments bigint, shares bigint, watch_time double, retention double, upload_date date, "
                  "feedback string, published boolean, creator_selected boolean, creator_rejected boolean, experiment_id string, "
                  "variant_id string, scoring_version string, prompt_version string, weight_version string, title string, reason string, "
                  "shorts_title string, shorts_description string, shorts_tags array<string>, duration double, subtitle_style string, "
                  "creator_preset string, words_per_chunk double, reading_speed double, highlight_count bigint, render_time_ms bigint, "
                  "ass_event_count bigint, fallback_used boolean, subtitle_version string, face_position string, start_time double, "
                  "end_time double, start_index int, end_index int, upload_package string, emotion string, energy_level int, "
                  "music_description string, volume_pct int, music_source string, has_music boolean, youtube_video_id string, "
                  "youtube_url string, created_at timestamp")
SNAPSHOTS = "clip_id string, snapshot_time timestamp, views bigint, likes bigint, comments bigint, watch_time double, retention double"
TRANSCRIPT_METRICS = "video_id string, source string, failures array<string>, fallback_used boolean, duration double, created_at timestamp"
JOB_EVENTS = "job_id string, event_id bigint, ts timestamp, status string, progress int, message string"
CHANNEL_VIDEOS = "id string, title string, desc string, publish_date date"
MUSIC_LIBRARY = "path string, category string"
FRAME_TELEMETRY = ("clip_id string, frame bigint, has_face boolean, active boolean, face_cx double, crop_x bigint, crop_w bigint, "
                   "state string, switched boolean")
