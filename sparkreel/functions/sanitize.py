"""Whitelists, clamps, defaults and derived keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkreel import lexicon as lx
from sparkreel.functions import text as tx


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def _json(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def sanitize_emotion(doc: Column) -> Column:
    """Mood record from model JSON: unknown or badly typed fields fall back to defaults."""
    parsed = F.try_parse_json(doc)

    def number(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
        numeric = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        return F.when(numeric, F.try_variant_get(parsed, f"$.{name}", "double"))

    def string(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
        return F.when(kind == "STRING", F.try_variant_get(parsed, f"$.{name}", "string"))

    base = lx.DEFAULT_EMOTION
    mood, words = string("emotion"), F.left(tx.strip(string("music_description")), F.lit(100))
    toward_zero = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")
    return F.struct(
        F.when(mood.isin(lx.EMOTIONS), mood).otherwise(base["emotion"]).alias("emotion"),
        F.coalesce(clamp(toward_zero(number("energy_level")), 1.0, 10.0).cast("int"),
                   F.lit(base["energy_level"])).alias("energy_level"),
        F.coalesce(F.nullif(words, F.lit("")), F.lit(base["music_description"])).alias("music_description"),
        F.coalesce(clamp(toward_zero(number("volume_pct")), 6.0, 10.0).cast("int"),
                   F.lit(base["volume_pct"])).alias("volume_pct"),
        F.coalesce(clamp(number("fade_in_secs"), 0.5, 2.0), F.lit(base["fade_in_secs"])).alias("fade_in_secs"),
        F.coalesce(clamp(number("fade_out_secs"), 1.0, 3.0), F.lit(base["fade_out_secs"])).alias("fade_out_secs"))


def emotion_category(emotion: Column) -> Column:
    pairs = [F.lit(v) for kv in lx.EMOTION_CATEGORY.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(emotion)), F.lit(lx.DEFAULT_CATEGORY))


def adaptive_gain(mean_db: Column) -> Column:
    return clamp(F.lit(-14.0) - mean_db, 0.0, 12.0)


MOMENT = "array<struct<timestamp_hint:string,word:string,effect_type:string>>"


def sanitize_moments(doc: Column) -> Column:
    """At most three moments with a valid hint and effect; the list may be wrapped in an object."""
    wrapped = [F.from_json(_json(doc, f"$.{key}"), MOMENT) for key in ("moments", "impacts", "items", "effects")]
    listed = F.coalesce(F.from_json(F.when(F.startswith(tx.strip(doc), F.lit("[")), doc), MOMENT), *wrapped)
    clean = lambda m: F.struct(
        F.when(m["timestamp_hint"].isin(list(lx.HINT_FRACTION)), m["timestamp_hint"]).otherwise("middle").alias("timestamp_hint"),
        F.left(tx.strip(F.coalesce(m["word"], F.lit(""))), F.lit(80)).alias("word"),
        F.when(m["effect_type"].isin(lx.SOUND_EFFECTS), m["effect_type"]).otherwise("impact").alias("effect_type"))
    return F.coalesce(F.transform(F.slice(listed, 1, 3), clean), F.from_json(F.lit("[]"), MOMENT))


def hint_seconds(hint: Column, duration: Column) -> Column:
    pairs = [F.lit(v) for kv in lx.HINT_FRACTION.items() for v in kv]
    at = duration * F.coalesce(F.try_element_at(F.create_map(*pairs), hint), F.lit(0.5))
    return F.greatest(F.lit(0.5), F.least(at, duration - 0.5))


def overlay_times(duration: Column, length: float = 2.5) -> Column:
    """One, two or three overlay starts by clip length that keep half a second from both ends."""
    shares = (F.when(duration < 15.0, F.array(F.lit(0.50)))
              .when(duration <= 30.0, F.array(F.lit(0.25), F.lit(0.75)))
              .otherwise(F.array(F.lit(0.15), F.lit(0.50), F.lit(0.85))))
    return F.filter(F.transform(shares, lambda s: duration * s),
                    lambda t: (t >= 0.5) & (t + F.lit(length) <= duration - 0.5))


def package_defaults(package: Column, hook: Column) -> Column:
    """Upload package whose empty or missing fields carry their default."""
    def listing(name: str, default: Column) -> Column:
        return F.when(F.size(package[name]) > 0, package[name]).otherwise(default).alias(name)

    titles = F.array(F.concat(F.lit("Secret Reveal: "), F.left(hook, F.lit(40))),
                     *[F.lit(t) for t in lx.PACKAGE_TITLES_TAIL])
    fields = [listing("titles", titles),
              F.coalesce(F.nullif(package["description"], F.lit("")), F.lit(lx.PACKAGE_DESCRIPTION)).alias("description"),
              listing("hashtags", tx.words_of(lx.PACKAGE_HASHTAGS)), listing("keywords", tx.words_of(lx.PACKAGE_KEYWORDS))]
    for name, value in lx.PACKAGE_TEXT_DEFAULTS.items():
        fields.append(F.coalesce(F.nullif(package[name], F.lit("")), F.lit(value)).alias(name))
    return F.struct(*fields)


def upload_snippet(clip_id: Column, package: Column, shorts_title: Column, shorts_description: Column,
                   shorts_tags: Column, direct: bool = False) -> Column:
    """Title, description and tags of an upload, at most 100 and 5000 characters."""
    none = F.array().cast("array<string>")
    hashtags = F.coalesce(package["hashtags"], none)
    packaged = F.concat(F.coalesce(package["description"], F.lit("")),
                        F.when(F.size(hashtags) > 0, F.concat(F.lit("\n\n"), F.array_join(hashtags, " "))).otherwise(""))
    title = F.coalesce(F.nullif(F.get(package["titles"], F.lit(0)), F.lit("")), F.nullif(shorts_title, F.lit("")),
                       F.concat(F.lit("Highlight Clip "), clip_id))
    description = F.coalesce(F.nullif(packaged, F.lit("")), F.nullif(shorts_description, F.lit("")),
                             F.lit("Check out this highlight clip!"))
    tags = F.when(F.size(hashtags) > 0, hashtags).otherwise(F.coalesce(shorts_tags, none))
    if direct:
        tags = F.when(F.exists(tags, lambda t: F.lower(t) == "shorts"), tags).otherwise(
            F.array_append(tags, F.lit("Shorts")))
    return F.struct(F.left(title, F.lit(100)).alias("title"), F.left(description, F.lit(5000)).alias("description"),
                    tags.alias("tags"))


def seo_title(title: Column, shorts_title: Column) -> Column:
    return F.coalesce(F.nullif(shorts_title, F.lit("")), F.concat(title, F.lit(" #shorts")))


def seo_description(reason: Column, shorts_description: Column) -> Column:
    text = F.concat(F.coalesce(reason, F.lit("Interesting peak point.")),
                    F.lit(" Subscribe for more awesome clips! #shorts #learning"))
    return F.coalesce(F.nullif(shorts_description, F.lit("")), text)


def seo_tags(title: Column, shorts_tags: Column) -> Column:
    """Given tags, else the first five longer title words plus ``shorts``."""
    long_words = F.filter(tx.word_runs(F.lower(F.coalesce(title, F.lit("")))), lambda w: F.length(w) > 3)
    first = F.slice(long_words, 1, 5)
    made = (F.when(F.size(long_words) == 0, tx.words_of(["shorts", "video", "highlights"]))
            .when(F.array_contains(first, F.lit("shorts")), first).otherwise(F.array_append(first, F.lit("shorts"))))
    return F.when(F.size(shorts_tags) > 0, shorts_tags).otherwise(made)


def clip_key(video_id: Column, title: Column, start: Column, end: Column) -> Column:
    """Eight hex digits that identify a clip."""
    text = F.concat_ws("_", video_id, title, F.format_string("%.2f", start), F.format_string("%.2f", end))
    return F.substring(F.sha2(text, 256), 1, 8)


def settings_key(video_id: Column, settings_json: Column) -> Column:
    """Stage key of a video under one group of settings (JSON with sorted keys)."""
    return F.concat_ws("_", video_id, F.substring(F.sha2(settings_json, 256), 1, 16))


def watch_hours(minutes: Column) -> Column:
    return tx.py_round(minutes / 60.0)


def retention_pct(average_secs: Column, duration: Column) -> Column:
    length = F.coalesce(F.nullif(duration, F.lit(0.0)), F.lit(30.0))
    return F.when(length > 0, F.least(F.lit(100.0), tx.py_round(average_secs / length * 100))).otherwise(F.lit(0.0))


def caption_margin(p90: Column) -> Column:
    """Margin and position name of captions below the face; LOW where no face was seen."""
    free = F.lit(1920.0) - clamp(p90 + 80, 1350.0, 1650.0)
    margin = F.when(p90.isNull() | (free < 375), 300).when(free < 525, 450).otherwise(600)
    return F.struct(margin.alias("margin_v"),
                    F.when(margin == 300, "LOW").when(margin == 450, "MID").otherwise("HIGH").alias("face_position"))
