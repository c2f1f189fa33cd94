"""Caption phrases and word timing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import captions as cap
from ..plans import views
from . import query

_U = views.with_views("utterances")
_STEP = 0.0625  # exact in binary, so sums do not depend on their order


def alignments(spark, sf):
    return cap.spread_text(views.utterances(spark, sf), _STEP)


_CHARS = """, ch AS (SELECT utterance_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM v_utterances WHERE text <> ''),
b AS (SELECT *, c IN (' ', chr(10), chr(9), chr(13)) AS blank FROM ch)
"""
_WORDS = _CHARS + """, g AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY utterance_id ORDER BY i) AS grp FROM b),
wd AS (SELECT utterance_id, grp, string_agg(c, '' ORDER BY i) AS text, min(i) * CAST(0.0625 AS DOUBLE) AS s, (max(i) + 1) * CAST(0.0625 AS DOUBLE) AS e,
  min(i) AS c0, max(i) + 1 AS c1 FROM g WHERE NOT blank GROUP BY utterance_id, grp),
w AS (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY c0) - 1 AS n FROM wd)
"""


@query("caption_words", _U + _WORDS + 'SELECT utterance_id, CAST(n AS INTEGER) AS word_no, text, s AS "start", e AS "end" FROM w')
def caption_words(spark, sf):
    return cap.extract_words(alignments(spark, sf))


@query("alignment_characters", _U + _CHARS + 'SELECT utterance_id, CAST(i AS INTEGER) AS pos, c AS ch, i * CAST(0.0625 AS DOUBLE) AS "start", (i + 1) * CAST(0.0625 AS DOUBLE) AS "end" FROM ch')
def alignment_characters(spark, sf):
    from ..sources.files import alignment_characters as explode

    return explode(alignments(spark, sf))


_PHRASES = "WITH RECURSIVE " + views.SQL["utterances"] + _CHARS + """,
walk AS (
  SELECT utterance_id, CAST(-1 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS l, 0 AS words, TRUE AS gap,
         CAST(NULL AS BIGINT) AS out_f, CAST(NULL AS BIGINT) AS out_e FROM v_utterances WHERE text <> ''
  UNION ALL
  SELECT utterance_id, i, CASE WHEN stop THEN NULL ELSE f2 END, CASE WHEN stop THEN NULL ELSE l2 END,
         CASE WHEN stop THEN 0 ELSE w2 END, CASE WHEN stop THEN TRUE ELSE blank END,
         CASE WHEN stop THEN f2 END, CASE WHEN stop THEN i END
  FROM (SELECT *, c IN ('.', '!', '?') OR (c IN (',', ';', ':') AND w2 >= 3) OR (blank AND (w2 >= 4 OR coalesce(l2 - f2 + 1, 0) >= 28)) OR is_end AS stop
    FROM (SELECT w.utterance_id, b.i, b.c, b.blank, coalesce(w.f, CASE WHEN NOT b.blank THEN b.i END) AS f2,
        CASE WHEN b.blank THEN w.l ELSE b.i END AS l2,
        w.words + CASE WHEN b.blank AND NOT w.gap AND w.f IS NOT NULL THEN 1 ELSE 0 END AS w2,
        b.i = z.last_i AS is_end
      FROM walk w JOIN b ON b.utterance_id = w.utterance_id AND b.i = w.i + 1
      JOIN (SELECT utterance_id, length(text) - 1 AS last_i FROM v_utterances) z ON z.utterance_id = w.utterance_id) t1) t2),
sp AS (SELECT utterance_id, out_f, out_e FROM walk WHERE out_f IS NOT NULL),
tx AS (SELECT sp.utterance_id, out_f * CAST(0.0625 AS DOUBLE) AS s, (out_e + 1) * CAST(0.0625 AS DOUBLE) AS e,
  regexp_replace(substr(u.text, CAST(out_f + 1 AS BIGINT), CAST(out_e - out_f + 1 AS BIGINT)), '^\\s+|\\s+$', '', 'g') AS text
  FROM sp JOIN v_utterances u USING (utterance_id)),
ph AS (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY s) - 1 AS n,
  lead(s) OVER (PARTITION BY utterance_id ORDER BY s) AS nx FROM tx WHERE regexp_matches(text, '[\\p{L}\\p{N}]'))
"""
_PHRASE_OUT = """SELECT utterance_id, CAST(n AS INTEGER) AS phrase_no, text, s AS "start",
  least(CASE WHEN e - s < 0.4 THEN s + CAST(0.4 AS DOUBLE) ELSE e END, coalesce(nx, 1e18)) AS "end" FROM ph"""


@query("caption_phrases", _PHRASES + _PHRASE_OUT)
def caption_phrases(spark, sf):
    return cap.phrase_alignments(alignments(spark, sf)).select("utterance_id", "phrase_no", "text", "start", "end")


_ATTACHED = _PHRASES + _WORDS.replace(_CHARS, "") + """, wp AS (
  SELECT w.utterance_id, w.n AS wn, w.text, w.s, min(ph.n) AS pn FROM w JOIN ph ON ph.utterance_id = w.utterance_id AND w.s < coalesce(ph.nx, 1e18) - 1e-6 GROUP BY ALL),
pe AS (""" + _PHRASE_OUT + """)
"""


@query("phrase_words", _ATTACHED + """SELECT utterance_id, CAST(pn AS INTEGER) AS phrase_no, count(*) AS words, string_agg(text, ' ' ORDER BY wn) AS spoken FROM wp GROUP BY ALL""")
def phrase_words(spark, sf):
    p = cap.phrase_alignments(alignments(spark, sf))
    return p.filter(F.size("words") > 0).select(
        "utterance_id", "phrase_no", F.size("words").cast("bigint").alias("words"),
        F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("spoken"))


@query("highlight_windows", _ATTACHED + """SELECT wp.utterance_id, CAST(pn AS INTEGER) AS phrase_no,
  CAST(row_number() OVER (PARTITION BY wp.utterance_id, pn ORDER BY wn) - 1 AS INTEGER) AS word_no, wp.text, s AS "start",
  coalesce(lead(s) OVER (PARTITION BY wp.utterance_id, pn ORDER BY wn), pe."end") AS "end"
FROM wp JOIN pe ON pe.utterance_id = wp.utterance_id AND pe.phrase_no = pn""")
def highlight_windows(spark, sf):
    return cap.highlight_windows(cap.phrase_alignments(alignments(spark, sf)))


@query("cue_phrases", views.with_views("cues") + """ SELECT source_id, cue_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM v_cues
WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND cue_no % 3 <> 1""")
def cue_phrases(spark, sf):
    c = views.cues(spark, sf).withColumn("end", F.when(F.col("cue_no") % 3 == 1, F.col("start")).otherwise(F.col("end")))
    return cap.phrases_from_cues(c).select("source_id", "cue_no", "text")


@query("normal_words", _U + _WORDS + "SELECT utterance_id, CAST(n AS INTEGER) AS word_no, text AS word, CAST(c0 AS INTEGER) AS char_start, CAST(c1 AS INTEGER) AS char_end, regexp_replace(lower(text), '[^a-z'']', '', 'g') AS normal FROM w")
def normal_words(spark, sf):
    from ..functions.text import normal_word

    words = cap.word_positions(cap.split_words(views.utterances(spark, sf)))
    return words.select("utterance_id", "word_no", "word", "char_start", "char_end", normal_word(F.col("word")).alias("normal"))


_TIMED = _U + _WORDS + """, al AS (SELECT utterance_id, n, c0, c1, CASE WHEN n % 3 <> 1 THEN s END AS s, CASE WHEN n % 3 <> 1 THEN e + 0.125 END AS e FROM w),
fl AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY utterance_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
  first_value(s IGNORE NULLS) OVER (PARTITION BY utterance_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns FROM al),
tm AS (SELECT utterance_id, n, c0, c1, coalesce(s, (pe + ns) / 2, pe, ns, 0.0) AS s, coalesce(e, (pe + ns) / 2, pe, ns, 0.0) AS e FROM fl)
"""


def _timed(spark, sf):
    words = cap.word_positions(cap.split_words(views.utterances(spark, sf)))
    known = F.col("word_no") % 3 != 1
    return cap.assign_word_timings(words.withColumns({
        "start": F.when(known, F.col("char_start") * F.lit(_STEP)), "end": F.when(known, F.col("char_end") * F.lit(_STEP) + 0.125)
    }))


@query("word_timings", _TIMED + 'SELECT utterance_id, CAST(n AS INTEGER) AS word_no, s AS "start", e AS "end" FROM tm')
def word_timings(spark, sf):
    return _timed(spark, sf).select("utterance_id", "word_no", "start", "end")


@query("character_times", _TIMED + """, ck AS (SELECT *, greatest(0.0, coalesce(max(greatest(s, e)) OVER (PARTITION BY utterance_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS clock,
  coalesce(lag(c1) OVER (PARTITION BY utterance_id ORDER BY n), 0) AS g0, lead(c0) OVER (PARTITION BY utterance_id ORDER BY n) IS NULL AS fin FROM tm),
cl AS (SELECT k.*, greatest(s, clock) AS b, greatest(e, greatest(s, clock)) AS f, length(u.text) AS total FROM ck k JOIN v_utterances u USING (utterance_id)),
ct AS (
  SELECT utterance_id, c0 + k AS pos, b + (f - b) * k / (c1 - c0) AS s, b + (f - b) * (k + 1) / (c1 - c0) AS e FROM cl, unnest(range(0, c1 - c0)) t(k)
  UNION ALL SELECT utterance_id, g0 + k - 1, clock + (b - clock) * k / (c0 - g0 + 1), clock + (b - clock) * k / (c0 - g0 + 1) FROM cl, unnest(range(1, c0 - g0 + 1)) t(k)
  UNION ALL SELECT utterance_id, c1 + k, f, f FROM cl, unnest(range(0, total - c1)) t(k) WHERE fin)
SELECT utterance_id, CAST(pos AS INTEGER) AS pos, round(s, 6) AS "start", round(e, 6) AS "end" FROM ct""")
def character_times(spark, sf):
    c = cap.character_times(_timed(spark, sf))
    return c.select("utterance_id", "pos", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))
