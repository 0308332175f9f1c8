"""Tokens of whole transcripts attributed to their lines or other sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkreel.llm.packing import encoder, vocabulary_file

RULES = ("first", "most")


def char_starts(raw: np.ndarray) -> np.ndarray:
    """Byte offset of each code point of UTF-8 bytes, and the length."""
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops, in code points, of the lines of a text without their line feeds."""
    sizes = np.array([len(line) for line in text.split("\n")], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    return starts, starts + sizes


def attributed(sizes: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token, -1 for none. Tokens follow each other with ``sizes`` bytes; sections are byte ranges.

    Every token is joined with the sections it touches. ``first``: the section that holds its first byte; ``most``: the one that holds
    most of its bytes. Between equals the section that starts first, then the first listed, has it.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    low, high = np.searchsorted(ends, starts, "right"), np.searchsorted(begins, stops, "left")
    touched = np.where(stops > starts, np.maximum(high - low, 0), 0)
    section = np.repeat(np.arange(len(starts)), touched)
    token = np.arange(touched.sum()) - np.repeat(np.cumsum(touched) - touched, touched) + np.repeat(low, touched)
    if rule == "first":
        worth = (begins[token] >= starts[section]) & (begins[token] < stops[section])
    else:
        worth = np.minimum(ends[token], stops[section]) - np.maximum(begins[token], starts[section])
    token, section, worth = token[worth > 0], section[worth > 0], worth[worth > 0]
    order = np.lexsort((section, starts[section], -worth.astype(np.int64), token))
    token, section = token[order], section[order]
    out = np.full(len(sizes), -1, np.int64)
    first = np.append(True, token[1:] != token[:-1])[:len(token)]
    out[token[first]] = section[first]
    return out


def token_counts(transcripts: DataFrame, rule: str = "first", vocabulary: str | None = None) -> DataFrame:
    """Token counts of every section of every transcript, each transcript being encoded once and whole.

    ``transcripts(video_id, transcript[, sections])``, where ``sections`` is ``array<struct<start int, stop int>>`` in code points, stop
    exclusive; without that column the lines of the transcript are its sections, as in ``transcript_lines``. Returns
    ``(video_id, section int, start int, stop int, n_tokens bigint)``: a row per section, in the order given and counted from 0, and a
    row with section -1 and NULL bounds for tokens that no section gets, such as line feeds.

    Tokens are byte ranges of the text, joined with the sections' byte ranges; a token that crosses a boundary goes to one section
    by ``rule`` (see ``attributed``), so the counts of a transcript add up to its tokens. Bounds outside the text are cut back to it;
    NULL or inverted sections get no tokens. A NULL transcript counts as empty; repeated rows are counted each.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = vocabulary or vocabulary_file()
    own = "sections" in transcripts.columns
    rows = transcripts.select("video_id", "transcript", *(["sections"] if own else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        widths = np.array([len(tokens.decode_single_token_bytes(k)) for k in range(tokens.n_vocab)], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, numbers, bounds, counts = [], [], [], []
                given = part.column("sections").to_pylist() if own else [None] * part.num_rows
                for i, (text, sections) in enumerate(zip(part.column("transcript").to_pylist(), given, strict=True)):
                    text = text or ""
                    if own:
                        pairs = [(s or {"start": None, "stop": None}) for s in sections or []]
                        starts = np.array([s["start"] if s["start"] is not None else 0 for s in pairs], np.int64)
                        stops = np.array([s["stop"] if s["stop"] is not None and s["start"] is not None else 0 for s in pairs], np.int64)
                    else:
                        starts, stops = line_sections(text)
                    places = char_starts(np.frombuffer(text.encode(), np.uint8))
                    clip = lambda x: places[np.clip(x, 0, len(places) - 1)]
                    ids = np.array(tokens.encode_ordinary(text), np.int64)
                    which = attributed(widths[ids], clip(starts), clip(stops), rule)
                    owner.append(np.full(len(starts) + 1, i))
                    numbers.append(np.arange(-1, len(starts)))
                    bounds.append(np.column_stack([np.append(-1, starts), np.append(-1, stops)]))
                    counts.append(np.bincount(which + 1, minlength=len(starts) + 1))
                owner, numbers, bounds, counts = map(np.concatenate, (owner, numbers, bounds, counts))
                none = numbers < 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("video_id").take(pa.array(owner)), pa.array(numbers, pa.int32()), pa.array(bounds[:, 0], pa.int32(), mask=none),
                     pa.array(bounds[:, 1], pa.int32(), mask=none), pa.array(counts, pa.int64())], ["video_id", "section", "start", "stop", "n_tokens"])

    return rows.mapInArrow(run, f"video_id {rows.schema['video_id'].dataType.simpleString()}, section int, start int, stop int, n_tokens bigint")
