"""Time stamps, cue text and other string handling, as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Patterns and limits that results depend on.
STAMP = r"(?:(\d{1,2}):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"
MARKUP = r"<[^>]+>|\{[^}]*\}"
HEX_COLOUR = r"^#(?:[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"
PAUSE = r"<break\s+time=\"(\d+(?:\.\d+)?)(ms|s)\"\s*/?>"
MAX_CUE_SECONDS = 30.0
VOICE_SETTING_ALIASES = {"similarity": "similarity_boost"}
# White space by its Unicode property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind (tabs, line ends, no-break and ideographic blanks) at either end."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def squeeze(text: Column) -> Column:
    """Collapse white space of any kind to single blanks and trim."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_cue(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, MARKUP, " "))


def compact(text: Column, length: int) -> Column:
    flat = squeeze(text)
    cut = F.concat(F.substring(flat, 1, length - 1), F.lit("…"))
    return F.when(F.length(flat) > length, cut).otherwise(flat)


def stamps(line: Column) -> Column:
    """All time stamps of a timing line, as text."""
    return F.regexp_extract_all(line, F.lit(f"({STAMP})"), F.lit(1))


def stamp_seconds(stamp: Column) -> Column:
    """``[H:]MM:SS,mmm`` to seconds; short millisecond fields are padded right."""
    part = lambda i: F.regexp_extract(stamp, STAMP, i)
    hours = F.when(part(1) == "", 0).otherwise(part(1).cast("int"))
    return (
        hours * 3600 + part(2).cast("int") * 60 + part(3).cast("int")
    ) + F.rpad(part(4), 3, "0").cast("int") / 1000.0


def parse_timestamp(text: Column) -> Column:
    """``SS``, ``MM:SS`` or ``HH:MM:SS`` to seconds; null when malformed."""
    parts = F.split(strip(text), ":")
    whole = lambda i: strip(parts[i]).try_cast("int")
    real = lambda i: strip(parts[i]).try_cast("double")
    return (
        F.when(F.size(parts) == 1, real(0))
        .when(F.size(parts) == 2, whole(0) * 60 + real(1))
        .when(F.size(parts) == 3, whole(0) * 3600 + whole(1) * 60 + real(2))
    )


def format_timestamp(t: Column) -> Column:
    """Seconds to ``M:SS.mmm`` or ``H:MM:SS.mmm``; negatives show as zero."""
    t = F.greatest(t, F.lit(0.0))
    hours = F.floor(t / 3600).cast("int")
    minutes = F.floor((t % 3600) / 60).cast("int")
    rest = t - hours * 3600 - minutes * 60
    return F.when(
        hours > 0, F.format_string("%d:%02d:%06.3f", hours, minutes, rest)
    ).otherwise(F.format_string("%d:%06.3f", minutes, rest))


def frame_rate(rate: Column) -> Column:
    """``num/den`` or a plain number to frames per second; 0 when unusable."""
    parts = F.split(rate, "/")
    ratio = F.when(
        F.size(parts) == 2,
        F.when(parts[1].try_cast("double") == 0, 0.0).otherwise(
            F.try_divide(parts[0].try_cast("double"), parts[1].try_cast("double"))
        ),
    )
    return F.coalesce(ratio, F.trim(rate).try_cast("double"), F.lit(0.0))


def is_hex_colour(text: Column) -> Column:
    return text.rlike(HEX_COLOUR)


def has_pause_markup(text: Column) -> Column:
    return text.rlike(PAUSE)


def normal_word(word: Column) -> Column:
    """The lower-case ``[a-z']`` form a speech aligner expects."""
    return F.regexp_replace(F.lower(word), r"[^a-z']", "")


def voice_settings(settings: Column) -> Column:
    """0..100 values brought to 0..1, limited, under canonical keys; the
    speaker-boost switch becomes 0 or 1."""
    unit = lambda v: F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1.0, v / 100.0).otherwise(v))
    )
    switch = lambda v: F.when(v != 0, 1.0).otherwise(0.0)
    values = F.transform_values(
        settings, lambda k, v: F.when(k == "use_speaker_boost", switch(v)).otherwise(unit(v))
    )

    def canonical(key: Column) -> Column:
        out = key
        for alias, name in VOICE_SETTING_ALIASES.items():
            out = F.when(key == alias, name).otherwise(out)
        return out

    return F.transform_keys(values, lambda k, v: canonical(k))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Composed letters and their base letters, from Unicode decomposition of every code point."""
    accented, plain = [], []
    for code in range(0xC0, sys.maxunicode + 1):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        base = parts[0]
        marks = parts[1:]
        if marks and base.isalpha() and all(unicodedata.combining(m) for m in marks):
            accented.append(letter)
            plain.append(base)
    return "".join(accented), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or marks behind it."""
    accented, plain = _accent_table()
    return F.regexp_replace(F.translate(F.lower(text), accented, plain), r"\p{M}+", "")


def folded_tokens(text: str) -> list[str]:
    """What ``tokens`` gives for a text at hand, such as a query's words."""
    parts = unicodedata.normalize("NFD", text.lower())
    bare = "".join(c for c in parts if not unicodedata.category(c).startswith("M"))
    bare = unicodedata.normalize("NFC", bare)
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in bare).split()


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    parts = F.split(fold(text), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: t != "")
