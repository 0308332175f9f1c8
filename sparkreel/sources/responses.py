"""Model replies: find the JSON, repair it, take out the list of clips."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

CLIP = "struct<title:string,start_index:int,end_index:int,reason:string,virality_score:double>"


def find_json(reply: Column) -> Column:
    """The part of a reply that should be JSON: all of it, a fenced block, or the outermost brackets."""
    text = F.trim(F.regexp_replace(reply, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", ""))
    # Between the first two fence marks, without the name of the language.
    block = F.split(text, "`{3}", 3)
    inner = F.regexp_replace(F.get(block, F.lit(1)), r"^json|[ \t\n\r]+$", "")
    inner = F.regexp_replace(inner, r"^[ \t\n\r]+", "")
    bracketed = F.left(inner, F.lit(1)).isin("{", "[") & F.right(inner, F.lit(1)).isin("}", "]")
    fenced = F.when((F.size(block) == 3) & bracketed, inner).otherwise("")
    opened = F.regexp_extract(text, r"(?s)([\{\[].*)$", 1)
    closed = F.when(F.startswith(opened, F.lit("{")), F.regexp_extract(opened, r"(?s)^(\{.*\})", 1)).otherwise(
        F.regexp_extract(opened, r"(?s)^(\[.*\])", 1))
    return (F.when(F.try_parse_json(text).isNotNull(), text).when(fenced != "", fenced).when(closed != "", closed)
            .when(opened != "", opened).otherwise(text))


STRING_OR_MARK = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[{}\[\]]', re.S)


def mend(text: str) -> str:
    """Close what a truncated reply left open, escape raw line breaks in strings, drop trailing commas."""
    closers, pieces, last, unclosed = [], [], 0, False
    for m in STRING_OR_MARK.finditer(text):
        pieces.append(text[last:m.start()])
        token, last = m.group(), m.end()
        if token[0] == '"':
            unclosed = len(token) == 1 or not token.endswith('"') or re.search(r'(?<!\\)(?:\\\\)*\\"$', token) is not None
            token = token.replace("\r", "\\r").replace("\n", "\\n")
        elif token in "{[":
            closers.append("}" if token == "{" else "]")
        elif closers and closers[-1] == token:
            closers.pop()
        pieces.append(token)
    whole = re.sub(r",\s*([}\]])", r"\1", "".join(pieces) + text[last:])
    whole += '"' if unclosed else ""
    return re.sub(r",\s*$", "", whole) + "".join(reversed(closers))


@F.pandas_udf(StringType())
def mend_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(mend, na_action="ignore")


# Keeps the optimizer from copying the repair into filters above it.
mend_once = mend_batches.asNondeterministic()


def flag_responses(replies: DataFrame, reply: str = "response") -> DataFrame:
    """``replies`` with a ``json`` text column and a flag ``quarantined``, in one pass over them.

    Only the replies that don't parse after cutting are sent to the repair, the others send it a NULL. What does not parse even then
    keeps its repaired text as ``json`` and is flagged; a NULL reply is flagged too.
    """
    found = replies.withColumn("_found", find_json(F.col(reply)))
    parses = lambda c: F.try_parse_json(c).isNotNull()
    mended = found.withColumn("_mended", mend_once(F.when(~parses("_found"), F.col("_found"))))
    return mended.withColumn("json", F.coalesce("_mended", "_found")).withColumn("quarantined", ~F.coalesce(parses("json"), F.lit(False))).drop("_found", "_mended")


def read_responses(replies: DataFrame, reply: str = "response") -> tuple[DataFrame, DataFrame]:
    """(parsed with a ``json`` text column, quarantined). Where both are used, split ``flag_responses`` at the sink instead."""
    flagged = flag_responses(replies, reply)
    return flagged.where("NOT quarantined").drop("quarantined"), flagged.where("quarantined").drop("quarantined")


def listed_clips(doc: Column, element: str = CLIP) -> Column:
    """The clips of a JSON text as an array: a top-level list, the list under ``clips``, else the first list."""
    whole = F.from_json(F.when(F.startswith(F.ltrim(doc), F.lit("[")), doc), f"array<{element}>")
    named = F.from_json(F.get_json_object(doc, "$.clips"), f"array<{element}>")
    keys = F.json_object_keys(F.when(F.startswith(F.ltrim(doc), F.lit("{")), doc))
    values = F.from_json(F.when(F.startswith(F.ltrim(doc), F.lit("{")), doc), "map<string,string>")
    first = F.get(F.filter(F.transform(keys, lambda k: F.try_element_at(values, k)), lambda v: F.startswith(v, F.lit("["))), F.lit(0))
    return F.coalesce(whole, named, F.from_json(first, f"array<{element}>"))


def extract_list(parsed: DataFrame, key: str, element: str = CLIP) -> DataFrame:
    """One row per clip of the parsed JSON column ``json``, see ``listed_clips``."""
    return parsed.select(key, F.posexplode(listed_clips(F.col("json"), element)).alias("ord", "c")).select(key, "ord", "c.*")
