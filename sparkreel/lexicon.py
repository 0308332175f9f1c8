"""Word lists, weights, limits and default texts that results depend on."""

# Scoring factors with their weight per experiment arm.
WEIGHTS_A = {
    "hook_strength": 0.20, "first_3_second_hook": 0.20, "curiosity_gap": 0.12,
    "emotional_intensity": 0.08, "controversy": 0.08, "surprise": 0.08,
    "actionability": 0.04, "storytelling": 0.06, "contrarian_viewpoint": 0.05,
    "emotional_tension": 0.04, "shareability": 0.05,
}
WEIGHTS_B = {
    "hook_strength": 0.25, "first_3_second_hook": 0.25, "curiosity_gap": 0.10,
    "emotional_intensity": 0.06, "controversy": 0.06, "surprise": 0.06,
    "actionability": 0.03, "storytelling": 0.05, "contrarian_viewpoint": 0.05,
    "emotional_tension": 0.04, "shareability": 0.05,
}
FACTORS = list(WEIGHTS_A)
ACTIVE_EXPERIMENT = "exp_virality_v1"
ARMS = {
    "A": ("A", "prompt_v1", "weight_v1_baseline", WEIGHTS_A),
    "B": ("B", "prompt_v1", "weight_v2_high_hook", WEIGHTS_B),
}
PERFORMANCE_METRICS = ["views", "retention", "shares"]
COMPOSITE_SHARE = {"views": 0.4, "retention": 0.4, "shares": 0.2}

# Words that move a score when they open the text.
OPENING_FILLERS = ["so", "actually", "basically", "literally", "then", "well", "okay", "and", "but"]
OPENING_STRONG = ["you", "why", "how", "never", "stop", "secrets", "don't", "this", "what", "here"]
OPENING_QUESTIONS = ["why", "how", "what", "is", "could", "will", "did", "can", "should", "would"]

# Phrases that move a score anywhere in the text (substring tests).
CONFLICT_PHRASES = ["versus", "against", "destroy", "ruin", "clash", "fight", "enemy", "betray",
                    "broken", "vs", "battle", "war"]
SURPRISE_PHRASES = ["suddenly", "shocking", "surprising", "unexpected", "unbelievable", "reveal",
                    "discovered", "jaw-dropping", "magic", "crazy"]
PREDICTION_PHRASES = ["will", "future", "prediction", "predict", "scenario", "someday", "going to",
                      "forecast", "foresee"]
MISTAKE_PHRASES = ["mistake", "error", "wrong", "fail", "fault", "blunder", "avoid", "trap",
                   "ruined", "stupid", "dumb"]
SECRET_PHRASES = ["secret", "hidden", "mystery", "truth", "conspiracy", "closed doors", "unknown",
                  "confession", "underground"]
NUMBER_PHRASES = ["%", "percent", "billion", "million"]

# Boundary words and hook words of transcript lines.
CONJUNCTIONS = ["and", "but", "so", "because", "then", "also", "well", "like", "yeah", "right",
                "okay", "now", "or"]
FILLERS = ["um", "uh"]
HOOK_WORDS = ["why", "how", "secret", "mistake", "million", "billion", "ai", "you", "never", "this",
              "people", "warning", "reveal", "discovered", "shocking", "unexpected", "one", "two",
              "three", "four", "five", "six", "seven", "eight", "nine", "ten", "first", "second",
              "third", "percent"]
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "to", "of", "in",
              "on", "at", "by", "this", "that", "it", "for", "with", "as"]
NON_VERBAL_TAGS = ["[music]", "(music)", "[laughter]", "(laughter)", "[applause]", "(applause)"]

# Subtitle word classes, protected word pairs and colours.
EMPHASIS_WORDS = ["money", "million", "billion", "ai", "startup", "success", "secret", "mistake",
                  "never", "always", "truth", "future", "business"]
QUESTION_WORDS = ["why", "how", "what", "who", "where", "when", "which", "whose", "whom"]
PROTECTED_PAIRS = ["sam altman", "new york", "artificial intelligence", "opena i", "open ai",
                   "$10 million", "10 million"]
COLOR_EMPHASIS = "&H001A9FFF&"
COLOR_NUMBER = "&H0073D52E&"
COLOR_QUESTION = "&H00E9EC10&"

# Music moods and their library category.
EMOTIONS = ["triumphant", "motivational", "tense", "melancholic", "energetic", "calm",
            "inspirational", "dramatic", "urgent", "uplifting"]
EMOTION_CATEGORY = {
    "triumphant": "uplifting", "uplifting": "uplifting", "energetic": "uplifting",
    "motivational": "inspirational", "inspirational": "inspirational", "calm": "calm",
    "tense": "dramatic", "dramatic": "dramatic", "urgent": "dramatic",
    "melancholic": "emotional", "emotional": "emotional",
}
DEFAULT_CATEGORY = "corporate"
DEFAULT_EMOTION = {"emotion": "motivational", "energy_level": 6,
                   "music_description": "uplifting background music", "volume_pct": 8,
                   "fade_in_secs": 1.0, "fade_out_secs": 2.0}
HINT_FRACTION = {"early": 0.20, "middle": 0.50, "late": 0.80}
SOUND_EFFECTS = ["impact", "whoosh", "ding", "swoosh"]
UNKNOWN_LICENSE = "Unknown (Locally Placed)"

# Transcript sources in fallback order (tier, name, counts as a fallback).
TRANSCRIPT_TIERS = [
    (0, "cache", False), (1, "youtube_transcript_api", False), (2, "youtube_transcript_api", False),
    (3, "yt_dlp_manual", True), (4, "yt_dlp_auto", True), (5, "faster_whisper", True),
]
KNOWN_SOURCES = ["youtube_transcript_api", "yt_dlp_manual", "yt_dlp_auto", "faster_whisper",
                 "cache", "unknown"]
FEEDBACK_VALUES = ["Great", "Good", "Average", "Poor"]

# Default texts of an upload package.
PACKAGE_DESCRIPTION = ("The Shocking truth about this! Discover new insights. Follow for more daily "
                       "insights that actually change how you think.")
PACKAGE_HASHTAGS = ["#shorts", "#viral", "#motivation", "#learning", "#insight", "#success",
                    "#growth", "#shortsfeed", "#shortscreator", "#trending", "#video", "#secrets",
                    "#truth", "#exposed", "#daily"]
PACKAGE_KEYWORDS = ["shorts", "viral", "video", "insights", "exposed", "truth", "secrets",
                    "learning", "growth", "motivation"]
PACKAGE_TITLES_TAIL = ["Why Nobody Tells You This...", "The Absolute Truth Exposed!"]
PACKAGE_TEXT_DEFAULTS = {
    "thumbnail_text": "TRUTH EXPOSED",
    "best_time_to_post": "Everyday at 5:00 PM EST",
    "target_audience": "General audience interested in learning.",
    "hook_analysis": "7/10. Decent hook that catches initial attention.",
    "category": "Education",
    "language": "English",
    "search_intent": "Informational",
}

# Texts explaining a disagreement between score and creator.
CAUSE_CONTROVERSY = ("High controversy rating. Creators often reject controversial clips to protect "
                     "brand safety and sponsor alignment.")
CAUSE_NARRATIVE = ("High storytelling score but low practical utility. Creator preferred highly "
                   "educational/actionable content instead of generic narrative.")
CAUSE_OVERVALUED = ("Heuristic overvalued the opening second hooks, but the actual clip content "
                    "lacked educational substance or brand alignment.")
CAUSE_UTILITY = ("High educational value. Creator selected this clip for its practical utility "
                 "despite a slow-building opening hook.")
CAUSE_SLOW_STORY = ("Slow-building personal narrative. Creator valued the deep storytelling arc "
                    "despite failing the initial hook speed heuristics.")
CAUSE_NICHE = ("Creator identified high niche relevance or audience-specific value that standard "
               "virality heuristics failed to register.")

# Durations in seconds.
MIN_CLIP, MAX_CLIP, DEFAULT_CLIP = 38.0, 58.0, 35.0
END_MARGIN = 0.4
