"""Subtitles: word timing, chunks, line breaks, events and their text.

Word times are computed per line. A clip is at most a minute long, so its words fit in one row: one
shuffle brings its lines together and every order-dependent step runs as an array expression inside it.
What is asked about a word (capitals, class, bare form) is worked out once per chunk, not once per event.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from sparkreel import lexicon as lx
from sparkreel.functions import text as tx
from sparkreel.operators.joins import words_in_clip
from sparkreel.operators.ordered import spoken_durations

DELAY = 0.05
#: Lines that stay together from the text to the clips; those of a block are compared with all clips of its time.
BLOCK_LINES = 256
PRIMARY, HIGHLIGHT = "#FFFFFF", "#FFD400"


def word_lines(lines: DataFrame, delay: float = DELAY) -> DataFrame:
    """(video_id, block, line_idx, line_start, line_end, share, delay, n, joined, ws): the words of each line and the seconds that each of them gets.

    Lines are shuffled once, by video and block of lines, as text: an array of words takes twice the bytes. ``joined`` has the ``n`` words
    with one blank between them.
    """
    joined = F.trim(tx.spaced(F.col("text")))
    cut = lines.select("video_id", "line_idx", "start", "duration", joined.alias("joined"))
    timed = spoken_durations(cut, BLOCK_LINES, "block").where("joined <> ''").withColumn("n", F.length("joined") - F.length(F.replace("joined", F.lit(" "))) + 1)
    return timed.select("video_id", "block", "line_idx", F.col("start").alias("line_start"), (F.col("start") + F.col("duration")).alias("line_end"),
                        (F.col("spoken") / F.col("n")).alias("share"), F.lit(delay).alias("delay"), "n", "joined", F.split("joined", " ").alias("ws"))


def word_timing(lines: DataFrame, delay: float = DELAY) -> DataFrame:
    """(video_id, line_idx, pos, word, start, end): each word an equal share of its line's spoken time."""
    words = word_lines(lines, delay).select("video_id", "line_idx", "line_start", "line_end", "share", "delay", F.posexplode("ws").alias("pos", "word"))
    return words.select("video_id", "line_idx", "pos", "word", "line_start", "line_end",
                        (F.col("line_start") + F.col("pos") * F.col("share") + F.col("delay")).alias("start"),
                        (F.col("line_start") + (F.col("pos") + 1) * F.col("share") + F.col("delay")).alias("end"))


def clip_words(clips: DataFrame, words: DataFrame) -> DataFrame:
    """Words of each clip; their line must overlap the clip too."""
    return words_in_clip(clips, words).where((F.col("line_start") < F.col("end_time")) & (F.col("line_end") > F.col("start_time")))


CLIP = ["video_id", "clip_id", "start_time", "end_time"]


def _lines_of(clips: DataFrame, words: DataFrame) -> DataFrame:
    """(clip columns, lines ARRAY<STRUCT>) of the clips that meet rows of ``word_lines``.

    The lines stay where ``word_lines`` dealt them, by video and block, and the clips go to the blocks whose times they overlap; only what
    clips of several blocks found in each is shuffled again.
    """
    times = words.groupBy("video_id", "block").agg(F.min("line_start").alias("start"), F.max("line_end").alias("end"))
    block = F.col("block")
    places = words_in_clip(clips, times).select(*CLIP, "block").withColumn(
        "split", F.min(block).over(Window.partitionBy(*CLIP)) < F.max(block).over(Window.partitionBy(*CLIP))).repartition("video_id", "block")
    # From the first word's start to the last one's end; its words leave no gap.
    spans = words.drop("ws").withColumns({"start": F.col("line_start") + F.col("delay"),
                                          "end": F.col("line_start") + F.col("n") * F.col("share") + F.col("delay")}).drop("n")
    # Joined by the very columns both sides are dealt by, else Spark deals them again; a block is small enough to be compared with all its clips.
    parts = places.join(spans, ["video_id", "block"]).where(
        (F.col("start") < F.col("end_time")) & (F.col("end") > F.col("start_time")) & (F.col("line_start") < F.col("end_time"))
        & (F.col("line_end") > F.col("start_time"))).groupBy(*CLIP, "split", "block").agg(
        F.collect_list(F.struct("line_idx", "line_start", "share", "delay", "joined")).alias("lines"))
    whole = parts.where("NOT split").select(*CLIP, "lines")
    return whole.unionByName(parts.where("split").groupBy(*CLIP).agg(F.flatten(F.collect_list("lines")).alias("lines")))


def _gathered(clips: DataFrame, words: DataFrame) -> DataFrame:
    """(clip columns, ws ARRAY<STRUCT<start, line_idx, pos, end, word>>) of the clips that have lines.

    Rows of ``word_lines`` travel as lines, an eighth of the rows, and become words inside their clip.
    """
    if "joined" not in words.columns:
        found = clip_words(clips, words).groupBy(*CLIP).agg(F.collect_list(F.struct("start", "line_idx", "pos", "end", "word")).alias("ws"))
        return found.withColumn("ws", F.sort_array("ws"))
    timed = F.expr("""sort_array(filter(flatten(transform(lines, l -> transform(split(l.joined, ' '), (w, p) -> named_struct(
        'start', l.line_start + p * l.share + l.delay, 'line_idx', l.line_idx, 'pos', p, 'end', l.line_start + (p + 1) * l.share + l.delay, 'word', w)))),
        x -> x.start < end_time AND x.end > start_time))""")
    return _lines_of(clips, words).select(*CLIP, timed.alias("ws"))


def _cuts(max_words: int, gap: float, longest: float, wpm: float) -> str:
    """First word positions of the chunks: a fold that restarts its state at every split."""
    split = f"""a.n = 0 OR a.n >= {max_words} OR a.punct OR w.start - a.prev > {gap}D OR w.end - a.first > {longest}D
        OR (a.n >= 2 AND (a.n + 1) / greatest(0.1D, w.end - a.first) * 60 > {wpm}D)"""
    return f"""aggregate(ws, named_struct('i', 0, 'n', 0, 'first', 0D, 'prev', 0D, 'punct', false, 'cuts', cast(array() AS array<int>)),
        (a, w) -> get(transform(array({split}), cut -> named_struct('i', a.i + 1, 'n', if(cut, 1, a.n + 1), 'first', if(cut, w.start, a.first),
            'prev', w.end, 'punct', rlike(w.word, '[.,?!;:]$'), 'cuts', if(cut, array_append(a.cuts, a.i), a.cuts))), 0), a -> a.cuts)"""


def _short_cuts(max_words: int = 3) -> str:
    """Chunk starts of the safe mode: three words, or up to a punctuation mark."""
    return f"""aggregate(sequence(0, size(ws) - 1), named_struct('n', 0, 'cuts', cast(array() AS array<int>)),
        (a, i) -> named_struct('n', if(a.n + 1 >= {max_words} OR rlike(get(ws, i).word, '[.?!,]$'), 0, a.n + 1),
            'cuts', if(a.n = 0, array_append(a.cuts, i), a.cuts)), a -> a.cuts)"""


def _timed(pause: float) -> str:
    """Screen times of the chunks: a fold that carries the previous chunk's end."""
    return f"""aggregate(transform(chunks, (c, i) -> named_struct('at', get(c, 0).start - start_time - 0.1D, 'nx', get(get(chunks, i + 1), 0).start - start_time,
            'ce', get(transform(array(named_struct('w', element_at(c, -1), 'nx', get(get(chunks, i + 1), 0).start - start_time)), k ->
              get(transform(array(named_struct('se', k.w.end - start_time, 'p', if(rlike(k.w.word, '[.?!]$'), {pause}D, 0D))), x ->
                if(k.nx IS NOT NULL, least(x.se + x.p, greatest(x.se, k.nx - 0.1D)), least(x.se + x.p, end_time - start_time))), 0)), 0))),
        cast(array() AS array<struct<s:double,e:double>>), (a, x) -> array_append(a, get(transform(array(greatest(0D, try_element_at(a, -1).e, x.at)), s ->
            named_struct('s', s, 'e', get(transform(array(if(x.ce - s < 0.3D, least(s + 0.3D, x.nx), x.ce)), e -> if(s >= e, s + 0.05D, e)), 0))), 0)))"""


def subtitle_chunks(clips: DataFrame, words: DataFrame, style: str = "kinetic", safe_mode: bool = False, max_words: int = 4,
                    gap: float = 0.35, longest: float = 3.0, wpm: float = 260.0, max_density: float = 600.0) -> DataFrame:
    """One row per chunk: its words, screen times and the clip's style and counts.

    ``words`` are rows of ``word_lines`` or, at eight times the rows, of ``word_timing``.
    ``style`` is classic, kinetic, karaoke or auto (by speaking rate). A clip with more than
    ``max_density`` events per minute falls back to classic.
    """
    rows = _gathered(clips, words).withColumn(
        "cuts", F.when(F.size("ws") > 0, F.expr(_short_cuts() if safe_mode else _cuts(max_words, gap, longest, wpm))))
    rows = rows.withColumn("chunks", F.expr("transform(cuts, (c, i) -> slice(ws, c + 1, coalesce(get(cuts, i + 1), size(ws)) - c))"))
    rows = rows.withColumn("times", F.expr(_timed(0.0 if safe_mode else 0.25)))
    length = F.col("end_time") - F.col("start_time")
    rate = F.when(length > 0, F.size("ws") / length * 60).otherwise(0.0)
    rows = rows.withColumns({"n_words": F.size("ws"), "n_chunks": F.size("chunks"), "reading_speed": rate})
    named = spoken_style(F.col("reading_speed")) if style == "auto" else F.lit("classic" if safe_mode else style)
    events = F.when(named == "classic", F.col("n_chunks")).otherwise(F.col("n_words"))
    dense = F.when(length > 0, events / (length / 60.0) > max_density).otherwise(False) if not safe_mode else F.lit(True)
    rows = rows.withColumns({"asked_style": named, "fallback_used": dense})
    rows = rows.withColumn("style", F.when(F.col("fallback_used"), "classic").otherwise(F.col("asked_style")))
    out = rows.select("video_id", "clip_id", "start_time", "end_time", "n_words", "n_chunks", "reading_speed", "asked_style", "style",
                      "fallback_used", F.posexplode(F.arrays_zip("chunks", "times")).alias("chunk", "c"))
    return out.select("*", F.col("c.chunks").alias("words"), F.col("c.times.s").alias("chunk_start"), F.col("c.times.e").alias("chunk_end")).drop("c")


def spoken_style(wpm: Column) -> Column:
    return F.when(wpm > 200, "karaoke").when(wpm < 130, "classic").otherwise("kinetic")


def bare_words() -> Column:
    """The words of a chunk in lower case, without their marks."""
    return F.transform(F.col("words.word"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_$]", "")))


def line_break(bare: str | None = None) -> Column:
    """Index of the word after which a chunk's text breaks, -1 for none: best balance, protected pairs stay together.

    ``bare`` names a column of ``bare_words``, where others need them too.
    """
    pairs = ", ".join(f"'{p}'" for p in lx.PROTECTED_PAIRS)
    # The second side's length follows from the first one's and the whole.
    score = """get(transform(array(length(array_join(slice(f.w, 1, i + 1), ' '))), a -> if(rlike(get(f.w, i), '[.,?!;:]$'), 100, 0)
        - abs(2 * a - f.whole + 1) * 2 - if(size(f.w) - i - 1 = 1, 50, 0) - greatest(a - 22, 0) * 5 - greatest(f.whole - a - 23, 0) * 5), 0)"""
    best = f"""array_max(transform(filter(sequence(0, size(f.w) - 2), i -> concat(get(f.bare, i), ' ', get(f.bare, i + 1)) NOT IN ({pairs})),
        i -> named_struct('score', {score}, 'back', -i)))"""
    whole = "length(array_join(words.word, ' '))"
    plain = bare or r"transform(words.word, w -> lower(regexp_replace(w, '[^\\p{L}\\p{N}_$]', '')))"
    facts = f"named_struct('w', words.word, 'whole', {whole}, 'bare', {plain})"
    short = f"size(words) <= 2 AND {whole} <= 18"
    return F.expr(f"CASE WHEN size(words) < 2 OR ({short}) THEN -1 ELSE coalesce(-get(transform(array({facts}), f -> {best}), 0).back, -1) END")


def word_class(word: Column, clean: Column | None = None) -> Column:
    clean = F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}_$]", "")) if clean is None else clean
    return (F.when(clean.isin(lx.EMPHASIS_WORDS), "emphasis").when(word.rlike("[0-9$]"), "number")
            .when(F.contains(word, F.lit("?")) | clean.isin(lx.QUESTION_WORDS), "question").otherwise("plain"))


def word_classes(bare: str | None = None) -> Column:
    """The class of every word of a chunk; inside an array function only ``bind`` spares a second evaluation."""
    if bare:
        return F.transform(F.col("words.word"), lambda w, i: tx.bind(F.get(F.col(bare), i), lambda c: word_class(w, c)))
    plain = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_$]", ""))
    return F.transform(F.col("words.word"), lambda w: tx.bind(plain(w), lambda c: word_class(w, c)))


def _word_facts(bare: str | None = None) -> dict[str, Column]:
    return {"caps": F.transform(F.col("words.word"), F.upper), "kinds": word_classes(bare)}


def class_color(kind: Column, highlight: str = HIGHLIGHT) -> Column:
    return (F.when(kind == "emphasis", lx.COLOR_EMPHASIS).when(kind == "number", lx.COLOR_NUMBER)
            .when(kind == "question", lx.COLOR_QUESTION).otherwise(tx.ass_color(F.lit(highlight))))


def subtitle_events(chunks: DataFrame) -> DataFrame:
    """(clip, chunk, active, event times, text): one event per word, or one per chunk in classic style."""
    # Of a chunk's words events need the starts only; where nothing else asks for the words, they end here.
    broken = chunks.withColumns({"_bare": bare_words(), "_starts": F.col("words.start")}).withColumns({"break_after": line_break("_bare"), **_word_facts("_bare")})
    span = F.when(F.col("style") == "classic", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("_starts") - 1))
    rows = broken.drop("_bare").withColumn("active", F.explode(span))
    at = lambda i: F.get("_starts", i) - F.col("start_time")
    classic, i = F.col("style") == "classic", F.col("active")
    begin = F.when(classic | (i == 0), F.col("chunk_start")).otherwise(F.greatest("chunk_start", at(i)))
    finish = F.when(classic | (i == F.size("_starts") - 1), F.col("chunk_end")).otherwise(F.least(F.col("chunk_end"), at(i + 1)))
    rows = rows.withColumns({"event_start": begin, "_end": finish})
    return rows.withColumn("event_end", F.when(classic | (F.col("_end") > F.col("event_start")), F.col("_end")).otherwise(
        F.col("event_start") + 0.05)).drop("_end", "_starts").withColumn("kind", F.get("kinds", i))


def render_event_text(events: DataFrame, primary: str = PRIMARY, highlight: str = HIGHLIGHT, pop_scale: float = 1.18,
                      pop_ms: int = 260) -> DataFrame:
    """Adds the subtitle line of every event: upper-case words, colour and animation tags, ``\\N`` at the break."""
    base, lit_ = tx.ass_color(F.lit(primary)), tx.ass_color(F.lit(highlight))
    peak, mid = int(100 * pop_scale), int(100 * (1.0 + (pop_scale - 1.0) * 0.44))
    pop = (r"\fscx100\fscy100\1a&H26&" + rf"\t(0,80,\fscx{peak}\fscy{peak}\1a&H00&)" + rf"\t(80,180,\fscx{mid}\fscy{mid})"
           + rf"\t(180,{pop_ms},\fscx100\fscy100)")
    fade = F.when((F.col("chunk") == 0) & (F.col("active") == 0), r"\fad(120,0)").otherwise("")
    if "kinds" not in events.columns:
        events = events.withColumns(_word_facts())
    caps, kinds, style = F.col("caps"), F.col("kinds"), F.col("style")
    at = F.when(style == "classic", 0).otherwise(F.col("active"))

    # Only the words up to the active one are marked.
    def coloured(word: Column, colour: Column) -> Column:
        return F.concat(F.lit(r"{\c"), colour, F.lit("}"), word, F.lit(r"{\c"), base, F.lit("}"))

    tint = lambda i: class_color(F.get(kinds, i), highlight)
    popping = F.concat(F.lit("{"), fade, F.lit(pop + r"\c"), tint(at), F.lit("}"), F.get(caps, at),
                       F.lit(r"{\fscx100\fscy100\c"), base, F.lit("}"))
    sung = F.transform(F.slice(caps, F.lit(1), at), lambda word, i: coloured(word, tint(i)))
    before = F.when(style == "karaoke", sung).otherwise(F.slice(caps, F.lit(1), at))
    mark = F.when(style == "classic", coloured(F.get(caps, at), lit_)).otherwise(popping)
    parts = F.concat(before, F.array(mark), F.slice(caps, at + 2, F.size(caps)))
    line = events.withColumn("_p", parts)
    after = F.col("break_after") + 1
    text = F.when(F.col("break_after") < 0, F.array_join("_p", " ")).otherwise(F.concat(
        F.array_join(F.slice("_p", F.lit(1), after), " "), F.lit(r"\N"), F.array_join(F.slice("_p", after + 1, F.size("_p")), " ")))
    dialogue = F.concat(F.lit("Dialogue: 0,"), tx.format_ass_clock(F.col("event_start")), F.lit(","),
                        tx.format_ass_clock(F.col("event_end")), F.lit(",Default,,0,0,0,,"), text)
    return line.withColumn("dialogue", dialogue).drop("_p", "caps", "kinds")


def subtitle_metrics(chunks: DataFrame) -> DataFrame:
    """Per clip: events, chunks, words per chunk, reading speed and word-class counts of the asked style."""
    chunks = chunks.withColumn("_kinds", F.when(F.col("asked_style") != "classic", word_classes()).otherwise(F.array().cast("array<string>")))
    many = lambda kind: F.sum(F.size(F.filter("_kinds", lambda k: k == kind)))
    facts = ["video_id", "clip_id", "n_words", "n_chunks", "reading_speed", "style", "fallback_used"]
    events = F.when(F.col("style") == "classic", F.col("n_chunks")).otherwise(F.col("n_words"))
    return chunks.groupBy(*facts).agg(many("plain").alias("highlight_count"), many("emphasis").alias("emphasis_count")).select(
        "video_id", "clip_id", events.cast("bigint").alias("ass_event_count"), "fallback_used", "highlight_count", "emphasis_count",
        F.round(F.col("n_words") / F.col("n_chunks"), 2).alias("words_per_chunk"), F.round("reading_speed", 2).alias("reading_speed"),
        F.col("style").alias("subtitle_style"))


def cooldown_select(events: DataFrame, rest: float = 8.0, margin: float = 2.0) -> DataFrame:
    """Emoji events picked in time order, each at least ``rest`` seconds after the end of the one picked before.

    Needs (clip_id, start, end, emoji, duration). Events of a clip are bounded by its length.
    """
    usable = events.where((F.col("emoji") != "") & (F.col("start") >= margin) & (F.col("end") <= F.col("duration") - margin))
    rows = usable.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "emoji"))).alias("all"))
    picked = F.expr(f"""aggregate(all, named_struct('last', -10D, 'out', cast(array() AS array<struct<start:double,end:double,emoji:string>>)),
        (a, x) -> if(x.start - a.last >= {rest}D, named_struct('last', x.end, 'out', array_append(a.out, x)), a), a -> a.out)""")
    return rows.select("clip_id", F.explode(picked).alias("p")).select("clip_id", "p.*")


def _lowest_paths(tracks: DataFrame, key: str, n: int) -> DataFrame:
    """Of each key the ``n`` lowest paths."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("path"))
    lowest = tracks.select(key, "path").distinct().withColumn("_place", place).where(F.col("_place") <= n)
    return lowest.groupBy(key).agg(F.array_sort(F.collect_list("path")).alias("tracks"))


def _choosing(memory: int, schema: StructType):
    """One track per clip, in the order of a job; only the job's last ``memory`` tracks are held."""
    kinds = [to_arrow_schema(schema).field(i) for i in range(3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, used = object(), deque(maxlen=memory)
        for batch in batches:
            names, chosen = batch.column("job_id").to_pylist(), []
            for name, tracks in zip(names, batch.column("tracks").to_pylist()):
                if name != job:
                    job, used = name, deque(maxlen=memory)
                track = next((t for t in tracks or [] if t not in used), tracks[0] if tracks else None)
                if track is not None:
                    used.append(track)
                chosen.append(track)
            yield pa.RecordBatch.from_arrays([batch.column("job_id"), batch.column("clip_id"), pa.array(chosen, pa.string())], schema=pa.schema(kinds))
    return run


def fifo_track_choice(clips: DataFrame, library: DataFrame, memory: int = 5) -> DataFrame:
    """The lowest track of the clip's category that is not among the last ``memory`` tracks of its job.

    Needs clips (job_id, seq, clip_id, category) and library (path, category); tracks of the library's root have an empty or no category.
    Where every track was used lately the choice starts over. A category without tracks takes those of ``default``, then those of the
    root, then any; a clip for which there is none at all keeps its row, with a NULL track. Of a category only its ``memory`` + 1 lowest
    tracks can ever be chosen, so a clip carries no more. A job's choices depend on each other: they run through one task, in the
    job's order, and hold ``memory`` tracks, however many clips it has.
    """
    folder = F.coalesce("category", F.lit(""))
    named = library.where("path IS NOT NULL").select("path", folder.alias("category"))
    tracks = _lowest_paths(named.where("category <> ''"), "category", memory + 1)
    tier = F.explode(F.array_compact(F.array(F.when(F.col("category") == "default", 0), F.when(F.col("category") == "", 1), F.lit(2))))
    rest = _lowest_paths(named.withColumn("tier", tier), "tier", memory + 1).agg(F.min_by("tracks", "tier").alias("t")).select("t").scalar()
    rows = clips.select("job_id", "seq", "clip_id", "category").join(tracks, "category", "left").withColumn("tracks", F.coalesce("tracks", rest))
    ordered = rows.select("job_id", "seq", "clip_id", "tracks").repartition("job_id").sortWithinPartitions("job_id", "seq", "clip_id")
    out = StructType([*clips.select("job_id", "clip_id").schema, StructField("track", StringType())])
    return ordered.mapInArrow(_choosing(memory, out), out)
