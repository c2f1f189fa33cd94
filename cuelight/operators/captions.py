"""Caption phrases and word timing from character alignments.

An alignment is one row with parallel arrays, so phrases and words come from
array expressions inside the row: no shuffle, and a long script stays one row's
work.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.text import squeeze
from ..plans.rows import computed
from ..plans.scan import following, last_known, next_known, ordered_scan, previous, running

# Phrase limits that results depend on.
MAX_WORDS = 4
MAX_CHARS = 28
MIN_PHRASE_SECONDS = 0.4
HARD_BREAKS = [".", "!", "?"]
SOFT_BREAKS = [",", ";", ":"]
START_TOLERANCE = 1e-6


# Every white-space character.
BLANKS = [chr(code) for code in range(0x3001) if chr(code).isspace()]


_PLACES = StructType([StructField(name, ArrayType(IntegerType())) for name in ("b", "e")])
_MARKS = re.escape("".join(BLANKS + HARD_BREAKS + SOFT_BREAKS))
_PIECES = re.compile(f"[^{_MARKS}]*[{_MARKS}]|[^{_MARKS}]+")


def spread_text(texts: DataFrame, seconds_per_char: float) -> DataFrame:
    """An even alignment of ``utterance_id, text``: a fixed time per character."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    step = float(seconds_per_char)
    times = lambda shift: F.transform("characters", lambda c, i: (i + shift) * F.lit(step))
    return texts.select("utterance_id", chars.alias("characters")).select(
        "utterance_id", "characters", times(0).alias("start_times"), times(1).alias("end_times")
    )


def _plain(characters: Column) -> Column:
    """The entries of ``characters`` as one text with one character for each, so places in it are places in the array."""
    return F.array_join(F.transform(characters, lambda c: F.when(F.length(c) == 1, c).otherwise("x")), "")


def _places_of(rows: Iterable[Iterable[tuple[int, int]]]) -> pd.DataFrame:
    """The (first, last) pairs of each row as two arrays of numbers of four bytes: a batch has many rows, and as Python
    objects a pair would take some thirty times as much."""
    flat = [np.fromiter((n for pair in row for n in pair), dtype="int32") for row in rows]
    return pd.DataFrame({"b": pd.Series([f[::2] for f in flat], dtype=object), "e": pd.Series([f[1::2] for f in flat], dtype=object)})


@pandas_udf(_PLACES)
def _word_spans(texts: pd.Series) -> pd.DataFrame:
    """First and last place, from 1, of every run without blanks."""
    return _places_of(((m.start() + 1, m.end()) for m in re.finditer(r"\S+", t)) for t in texts)


def with_words(alignments: DataFrame) -> DataFrame:
    """Add ``words``: array of (text, start, end), from the blanks around them."""
    rows = alignments.filter(F.size("characters") > 0)
    rows = computed(rows, {c: F.col(c) for c in ("characters", "start_times", "end_times")})
    rows = computed(rows, {"_span": _word_spans(_plain(F.col("characters")))})
    word = lambda s: F.struct(
        F.array_join(F.slice("characters", s["b"], s["e"] - s["b"] + 1), "").alias("text"),
        F.element_at("start_times", s["b"]).alias("start"), F.element_at("end_times", s["e"]).alias("end"),
    )
    return rows.withColumn("words", F.transform(F.arrays_zip("_span.b", "_span.e"), word)).drop("_span")


def extract_words(alignments: DataFrame) -> DataFrame:
    """``utterance_id, word_no, text, start, end``."""
    return with_words(alignments).select("utterance_id", F.posexplode("words").alias("word_no", "w")).select(
        "utterance_id", "word_no", "w.*"
    )


def phrase_spans(text: str, max_words: int, max_chars: int) -> list[tuple[int, int]]:
    """First and last place, from 1, of the phrases of a text, in one pass over its blanks and break marks. A phrase
    begins at something shown and can only end at one of these, or with the text."""
    spans, first, last, words, gap = [], 0, 0, 0, True
    for start, end in (m.span() for m in _PIECES.finditer(text)):
        mark = text[end - 1]
        blank = mark.isspace()
        shown = end - 1 if blank else end
        if shown > start:
            first, last = first or start + 1, shown
        if blank and first and (shown > start or not gap):
            words += 1
        full = words >= max_words or (first and last - first + 1 >= max_chars)
        if (mark in HARD_BREAKS or (mark in SOFT_BREAKS and words >= max(2, max_words - 1))
                or (blank and full) or end == len(text)):
            if first:
                spans.append((first, end))
            first, last, words, gap = 0, 0, 0, True
        else:
            gap = blank
    return spans


def _phrase_spans(text: Column, max_words: int, max_chars: int) -> Column:
    """``phrase_spans`` of every row, as two arrays."""
    @pandas_udf(_PLACES)
    def spans(texts: pd.Series) -> pd.DataFrame:
        return _places_of(phrase_spans(t, max_words, max_chars) for t in texts)

    return spans(text)


@pandas_udf(ArrayType(IntegerType()))
def _words_before(starts: pd.Series, bounds: pd.Series) -> pd.Series:
    """How many words start before each bound, by binary search in every row."""
    return pd.Series([np.searchsorted(s, b, side="left").astype("int32") for s, b in zip(starts, bounds)])


def phrase_alignments(
    alignments: DataFrame,
    max_words: int = MAX_WORDS,
    max_chars: int = MAX_CHARS,
    min_seconds: float = MIN_PHRASE_SECONDS,
) -> DataFrame:
    """Caption phrases with their words: ``utterance_id, phrase_no, text, start,
    end, words``.

    Phrases end at sentence marks, at commas once long enough, and at blanks when
    a limit is reached. Short ones are extended, none reaches into the next.
    """
    rows = with_words(alignments)
    rows = computed(rows, {"words": F.col("words"), "_spans": _phrase_spans(_plain(F.col("characters")), max_words, max_chars)})
    phrase = lambda s: F.struct(
        F.trim(F.regexp_replace(
            F.array_join(F.slice("characters", s["b"], s["e"] - s["b"] + 1), ""), r"(?U)^\s+|\s+$", "")).alias("text"),
        F.element_at("start_times", s["b"]).alias("start"), F.element_at("end_times", s["e"]).alias("end"),
    )
    spoken = F.filter(F.transform(F.arrays_zip("_spans.b", "_spans.e"), phrase), lambda p: p["text"].rlike(r"[\p{L}\p{N}]"))
    rows = computed(rows, {"_phrases": spoken})
    rows = computed(rows, {"_ends": _words_before(
        F.transform("words", lambda w: w["start"]), F.transform("_phrases", lambda p: p["start"] - START_TOLERANCE)
    )})
    shortest = F.lit(float(min_seconds))

    def timed(p: Column, i: Column) -> Column:
        after = F.try_element_at(F.col("_phrases"), i + 2)["start"]
        end = F.when(p["end"] - p["start"] < shortest, p["start"] + shortest).otherwise(p["end"])
        begin = F.when(i == 0, 0).otherwise(F.element_at("_ends", i + 1))
        stop = F.coalesce(F.try_element_at(F.col("_ends"), i + 2), F.size("words"))
        mine = F.slice("words", begin + 1, F.greatest(stop - begin, F.lit(0)))
        return F.struct(p["text"].alias("text"), p["start"].alias("start"),
                        F.least(end, after).alias("end"), mine.alias("words"))

    return rows.select(
        "utterance_id", F.posexplode(F.transform("_phrases", timed)).alias("phrase_no", "p")
    ).select("utterance_id", "phrase_no", "p.*")


def phrases_from_cues(cues: DataFrame) -> DataFrame:
    """Ready-timed cues as phrases: white space collapsed, empty ones dropped."""
    return cues.withColumn("text", squeeze(F.col("text"))).filter("text <> '' AND end > start")


def highlight_windows(phrases: DataFrame) -> DataFrame:
    """When each word of a phrase is lit: until the next word or the phrase's end."""
    rows = phrases.select("utterance_id", "phrase_no", F.col("end").alias("_stop"), "words",
                          F.posexplode("words").alias("word_no", "w"))
    following_start = F.try_element_at("words", F.col("word_no") + 2)["start"]
    return rows.select(
        "utterance_id", "phrase_no", "word_no", F.col("w.text").alias("text"), F.col("w.start").alias("start"),
        F.coalesce(following_start, F.col("_stop")).alias("end"),
    )


def split_words(texts: DataFrame) -> DataFrame:
    """``utterance_id, word_no, word, char_start, char_end, normal`` of plain texts:
    character positions are running lengths of words and gaps."""
    words = F.regexp_extract_all("text", F.lit(r"(\s*)(\S+)"), F.lit(0))
    return (
        texts.select("utterance_id", F.length("text").alias("text_length"), F.posexplode(words).alias("word_no", "_w"))
        .withColumn("word", F.regexp_replace("_w", r"^\s+", ""))
        .withColumn("_long", F.length("_w"))
        .drop("_w")
    )


def word_positions(words: DataFrame, **kwargs) -> DataFrame:
    """Add ``char_start, char_end`` to the rows of ``split_words``."""
    placed = ordered_scan(
        words, ["utterance_id"], ["word_no"], [running("char_end", "sum", F.col("_long"), inclusive=True)], **kwargs
    )
    return placed.withColumn("char_end", F.col("char_end").cast("int")).withColumn(
        "char_start", F.col("char_end") - F.length("word")
    ).drop("_long")


def assign_word_timings(words: DataFrame, **kwargs) -> DataFrame:
    """Give unaligned words (null ``start``) a point between their aligned neighbours."""
    filled = ordered_scan(
        words, ["utterance_id"], ["word_no"],
        [last_known("_before", F.col("end")), next_known("_after", F.col("start"))], **kwargs,
    )
    point = F.coalesce((F.col("_before") + F.col("_after")) / 2, "_before", "_after", F.lit(0.0))
    return filled.withColumns({
        "start": F.coalesce("start", point), "end": F.coalesce("end", point),
    }).drop("_before", "_after")


def character_times(words: DataFrame, **kwargs) -> DataFrame:
    """Times of every character of a text from its word timings.

    ``words``: ``utterance_id, word_no, char_start, char_end, start, end,
    text_length``. Words are made monotone and spread over their characters; gap
    characters divide the silence. Every word row also emits the gap before it,
    the last one the rest of the text. Returns ``utterance_id, pos, start, end``.
    """
    late = F.greatest("start", "end")
    scanned = ordered_scan(
        words, ["utterance_id"], ["word_no"],
        [running("_clock", "max", late), previous("_from", F.col("char_end")),
         following("_next", F.col("char_start"))], **kwargs,
    )
    clock = F.greatest(F.coalesce("_clock", F.lit(0.0)), F.lit(0.0))
    begin = F.greatest("start", clock)
    placed = scanned.select(
        "utterance_id", "char_start", "char_end", "text_length", clock.alias("before"),
        begin.alias("begin"), F.greatest("end", begin).alias("finish"),
        F.coalesce("_from", F.lit(0)).alias("gap_start"), F.col("_next").isNull().alias("is_last"),
    )
    size = F.col("char_end") - F.col("char_start")
    step = (F.col("finish") - F.col("begin")) / size
    inside = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.struct(
        (F.col("char_start") + k).alias("pos"), (F.col("begin") + step * k).alias("start"),
        (F.col("begin") + step * (k + 1)).alias("end")))
    run = F.col("char_start") - F.col("gap_start")
    share = (F.col("begin") - F.col("before")) / (run + 1)
    nothing = F.array().cast("array<struct<pos:int,start:double,end:double>>")
    gap = F.when(run > 0, F.transform(F.sequence(F.lit(1), F.greatest(run, F.lit(1))), lambda k: F.struct(
        (F.col("gap_start") + k - 1).alias("pos"), (F.col("before") + share * k).alias("start"),
        (F.col("before") + share * k).alias("end")))).otherwise(nothing)
    rest = F.col("text_length") - F.col("char_end")
    tail = F.when(F.col("is_last") & (rest > 0), F.transform(
        F.sequence(F.lit(0), F.greatest(rest, F.lit(1)) - 1), lambda k: F.struct(
            (F.col("char_end") + k).alias("pos"), F.col("finish").alias("start"), F.col("finish").alias("end"))
    )).otherwise(nothing)
    return placed.select("utterance_id", F.explode(F.concat(gap, inside, tail)).alias("c")).select("utterance_id", "c.*")
