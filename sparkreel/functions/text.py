"""Text and time-code expressions (Column in, Column out, all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkreel import lexicon as lx

# The JVM's \w and \b are ASCII-only, so word characters are spelled out.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[ \t\n\r\f\x0B]"
BLANKS = f"{SPACE}+"


def words_of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bind(c: Column, body) -> Column:
    """``body(c)`` with ``c`` evaluated once per row however often the body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def tokens(c: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(c, BLANKS), lambda w: w != "")


def spaced(c: Column) -> Column:
    """The text with one space for every run of blanks; what is one already is not touched."""
    return F.regexp_replace(c, rf"(?: {SPACE}|[\t\n\r\f\x0B]){SPACE}*+", " ")


def contains_any(c: Column, phrases: list[str]) -> Column:
    return F.exists(words_of(phrases), lambda p: F.contains(c, p))


def video_id(url: Column) -> Column:
    """The 11-character id inside watch, embed, shorts and short-link URLs, else NULL.

    What follows the site's name is taken apart: the last ``v`` parameter of a watch page, or the step after the kind of page.
    """
    after = lambda site: F.get(F.split(url, site.replace(".", "[.]"), 2), F.lit(1))
    page, short = after("youtube.com/"), after("youtu.be/")
    given = F.filter(F.split(F.get(F.split(page, "[?]", 2), F.lit(1)), "&"), lambda p: F.startswith(p, F.lit("v=")))
    named = (F.when(F.startswith(page, F.lit("watch?")), F.substring(F.try_element_at(given, F.lit(-1)), 3, 11))
             .when(F.startswith(page, F.lit("embed/")), F.substring(page, 7, 11)).when(F.startswith(page, F.lit("shorts/")), F.substring(page, 8, 11)))
    found = F.coalesce(named, F.substring(short, 1, 11))
    return F.when(found.rlike(r"^[\w-]{11}$"), found)


def parse_clock(clock: Column) -> Column:
    """``HH:MM:SS.mmm`` (or a comma) to seconds."""
    def part(n: int) -> Column:
        return F.regexp_extract(clock, r"(\d+):(\d{2}):(\d{2})[.,](\d{3})", n).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / F.lit(1000.0)


def parse_ass_clock(clock: Column) -> Column:
    """``H:MM:SS.cc`` to seconds; 0 where it is malformed."""
    pattern = r"^ *(\d+):(\d+):(\d+)(?:\.(\d+))? *$"
    def part(n: int) -> Column:
        return F.regexp_extract(clock, pattern, n).try_cast("int")
    value = part(1) * 3600 + part(2) * 60 + part(3) + F.coalesce(part(4), F.lit(0)) / F.lit(100.0)
    return F.coalesce(value, F.lit(0.0))


def format_ass_clock(seconds: Column) -> Column:
    """Seconds to ``H:MM:SS.cc``; negatives give 0, hundredths stop at 99."""
    t = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(t).cast("bigint")
    hundredths = F.least(F.rint((t - whole) * 100).cast("bigint"), F.lit(99).cast("bigint"))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat(F.floor(whole / 3600).cast("string"), F.lit(":"), two(F.floor(F.pmod(whole, F.lit(3600)) / 60)), F.lit(":"),
                    two(F.pmod(whole, F.lit(60))), F.lit("."), two(hundredths))


def ass_color(hex_color: Column) -> Column:
    """``#RRGGBB`` to the subtitle form ``&H00BBGGRR&``; anything else is white."""
    digits = F.regexp_replace(F.trim(hex_color), "^#+", "")
    return F.when(F.length(digits) == 6,
                  F.concat(F.lit("&H00"), F.substring(digits, 5, 2), F.substring(digits, 3, 2),
                           F.substring(digits, 1, 2), F.lit("&"))).otherwise(F.lit("&H00FFFFFF&"))


def is_non_verbal(text: Column) -> Column:
    """TRUE for noise: blank, too short, too few words, or one word above 70 % of all.

    A share above one half can only be held by the middle word of the sorted list, so one
    sort and one count decide it without a grouping step.
    """
    low = F.lower(text)
    kept = low
    for tag in lx.NON_VERBAL_TAGS:
        kept = F.replace(kept, F.lit(tag), F.lit(""))
    # A line number, or a span of two decimal times, in brackets.
    kept = F.regexp_replace(kept, r"\[(?:\d+|\d+[.]\d+ *- *\d+[.]\d+)\]", "")
    kept = F.regexp_replace(kept, NOT_WORD, "")
    bracketed = lambda w: F.startswith(w, F.lit("[")) & F.endswith(w, F.lit("]"))
    cleaned = F.filter(
        F.transform(F.filter(tokens(low), lambda w: ~bracketed(w)), lambda w: F.regexp_replace(w, NOT_WORD, "")),
        lambda w: w != "")
    def noisy(v: Column) -> Column:
        n = F.size(v["words"])
        middle = F.get(v["words"], F.floor(n / 2).cast("int"))
        loops = bind(middle, lambda m: F.size(F.filter(v["words"], lambda w: w == m)) / n > 0.7)
        return (v["kept"] < 10) | (n < 5) | loops

    facts = F.struct(F.array_sort(cleaned).alias("words"), F.length(kept).alias("kept"))
    return F.when(F.coalesce(strip(text), F.lit("")) == "", True).otherwise(bind(facts, noisy))


def lower_tokens(c: Column) -> Column:
    return F.array_distinct(tokens(F.lower(F.coalesce(c, F.lit("")))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two sets, 0 where either is empty."""
    def ratio(s: Column) -> Column:
        return F.when((s["a"] == 0) | (s["b"] == 0), F.lit(0.0)).otherwise(s["both"] / (s["a"] + s["b"] - s["both"]))

    sizes = F.struct(F.size(a).alias("a"), F.size(b).alias("b"), F.size(F.array_intersect(a, b)).alias("both"))
    return bind(sizes, ratio)


def jaccard_words(a: Column, b: Column) -> Column:
    return jaccard(lower_tokens(a), lower_tokens(b))


def word_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{WORD}+"), F.lit(0))


def word_set(text: Column) -> Column:
    """Distinct lower-case words without hashtags and stop words."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "#[a-zA-Z0-9_-]+", ""))
    return F.array_except(word_runs(plain), words_of(lx.STOP_WORDS))


def has_number(text: Column) -> Column:
    return text.rlike(rf"(?:^|{NOT_WORD})\p{{Nd}}+(?:$|{NOT_WORD})")


def is_hook(text: Column) -> Column:
    """A question, a standalone number, or a hook word."""
    whole = "|".join([r"\p{Nd}+", *lx.HOOK_WORDS])
    return F.lower(text).rlike(rf"[?]|(?<!{WORD})(?:{whole})(?!{WORD})")


def first_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(strip(text), f"^{WORD}+", 0))


def opens_cleanly(text: Column) -> Column:
    """Whether the first word is neither a conjunction nor a filler."""
    return ~F.lower(text).rlike(rf"\A{SPACE}*(?:{'|'.join([*lx.CONJUNCTIONS, *lx.FILLERS])})(?!{WORD})")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE[1:]}")


def ends_sentence(text: Column) -> Column:
    return text.rlike(rf"[.?!]{SPACE}*\z")


def headline(text: Column) -> Column:
    """The first sentence or line of a text, used as its title."""
    return F.regexp_extract(text, r"^[^.!?\n]*", 0)


def py_round(c: Column, digits: int = 2) -> Column:
    """Decimal rounding of the binary value, exact halves to the even digit (Spark's ``round`` works on the printed value)."""
    return F.bround(c * 10 ** digits) / 10 ** digits


def fixed2(c: Column) -> Column:
    """Two decimals; exact halves go to the even digit."""
    return F.format_string("%.2f", F.bround(c, 2))


def line_label(idx: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.lit("["), idx.cast("string"), F.lit("] ["), fixed2(start), F.lit(" - "), fixed2(end), F.lit("] "), F.replace(text, F.lit("\n"), F.lit(" ")))
