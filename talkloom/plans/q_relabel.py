"""Queries of relabelled, rebuilt and aligned candidates, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import alignment as A
from talkloom.operators import infer as I
from talkloom.operators import relabel as R
from talkloom.plans.fixtures import oracle, view

CAND = ["video_id", "cand_no"]


def _q(fn):
    return lambda spark, d: fn(lambda name: view(spark, d, name))


def _half_timed(v):
    """Words of candidates, some without a start or an end."""
    start = F.when(F.col("word_no") % 11 != 5, F.col("start_ms"))
    end = F.when(F.col("word_no") % 11 != 7, F.col("end_ms"))
    return v("fx_cand_words").select(*CAND, "turn_no", "pos", "word", start.alias("start_ms"), end.alias("end_ms"))


def _relabelled(v):
    return R.apply_diarization(v("fx_cands"), v("fx_cand_turns"), _half_timed(v), v("fx_diar"))


def _edits(v):
    return v("fx_cands").select(*CAND, (F.col("start_ms") + 1500).alias("start_ms"), (F.col("end_ms") - 2000).alias("end_ms"))


def _sentences(v):
    text = F.when(F.col("turn_no") % 13 == 6, " ").otherwise(F.concat(F.lit(" x "), F.col("text")))
    return v("fx_cand_turns").select(*CAND, F.col("turn_no").alias("sent_no"), text.alias("text"), "start_ms", "end_ms", "speaker")


def _listed(v):
    """Candidates with their speakers, of which every third lists none."""
    return v("fx_cands").withColumn("speakers", F.when(F.col("cand_no") % 3 > 0, F.array(F.lit("SPEAKER_05"), F.col("speaker"))))


def _voices(v, preset: str, mixed: bool):
    met = R.speakers_met(_listed(v), v("fx_cand_turns"))
    gender = F.when(F.col("video_id") % 3 == 0, "female").when(F.col("video_id") % 3 == 1, "male").otherwise("unknown")
    genders = met.filter("speaker <> 'SPEAKER_00'").withColumn("gender", gender) if mixed else None
    return R.voice_plan(met, preset, {"male": ["m1", "m2"], "female": ["f1"]}, genders, 4)


def _bounded(v):
    """Candidates whose text or times leave only some of the ways to match."""
    kind = F.col("cand_no") % 5
    text = F.when(kind == 1, "zz").when(kind == 2, "").when(kind == 3, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")))).otherwise(F.col("text"))
    by = F.when(kind == 4, 10_000_000).otherwise(0)
    return v("fx_cands").select(*CAND, text.alias("text"), (F.col("start_ms") + by).alias("start_ms"), (F.col("end_ms") + by).alias("end_ms"))


def _heard(v):
    """Recognised words: every seventh in another spelling, every tenth in upper case with a mark."""
    n = F.col("word_no")
    word = F.when(n % 7 == 3, F.concat(F.lit("q"), F.substring("word", 2, 99))).when(n % 10 == 4, F.concat(F.upper("word"), F.lit("!"))).otherwise(F.col("word"))
    return v("fx_words").select("video_id", "word_no", word.alias("word"), "start_ms", "end_ms")


def _char_places(v):
    t = v("fx_turns").select("video_id", "turn_no", F.length("text").alias("n"))
    chars = t.select("video_id", "turn_no", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select("video_id", (F.col("turn_no") * 1_000_000 + F.col("k")).alias("i"))
    ranges = t.select("video_id", F.col("turn_no").alias("input_no"), (F.col("turn_no") * 1_000_000).alias("first"), (F.col("turn_no") * 1_000_000 + F.floor(F.col("n") * 2 / 3)).alias("stop"))
    return A.input_of_chars(chars, ranges)


def _trimmed(v):
    return v("fx_cands").select(*CAND, "text", "start_ms", "end_ms", ((F.col("video_id") + F.col("cand_no")) % 3).cast("int").alias("trim_first"), ((F.col("video_id") + 2 * F.col("cand_no")) % 4).cast("int").alias("trim_last"))


QUERIES = {
    "j5_apply_diarization": _q(_relabelled),
    "j5_candidate_speakers": _q(lambda v: R.candidate_speakers(_relabelled(v)).select(*CAND, F.array_join("speakers", ",").alias("speakers"))),
    "j12_match_boundaries": _q(lambda v: R.match_boundaries(_bounded(v), v("fx_segs").withColumnRenamed("seg_no", "sent_no"))),
    "j15_voice_plan": _q(lambda v: _voices(v, "mixed_duo", True)),
    "j15_voice_plan_preset": _q(lambda v: _voices(v, "female_duo", False)),
    "a6_speakers_met": _q(lambda v: R.speakers_met(_listed(v), v("fx_cand_turns"))),
    "j17_align_words": _q(lambda v: A.align_words(v("fx_words"), _heard(v))),
    "j19_input_of_chars": _q(_char_places),
    "r10_move_sentences": _q(lambda v: A.move_sentences(_trimmed(v), v("fx_cand_words").withColumn("pos", F.col("word_no")))),
    "r13_rebuild_sentences": _q(lambda v: R.rebuild_from_sentences(_edits(v), _sentences(v), v("fx_segs"), v("fx_seg_words"), v("fx_diar"))),
    "r13_rebuild_segments": _q(lambda v: R.rebuild_from_segments(_edits(v), v("fx_segs").withColumn("text_tr", F.when(F.col("seg_no") % 2 == 0, F.concat(F.lit("tr "), F.col("text")))), v("fx_diar"))),
    "m2_score_candidates": _q(lambda v: I.score_candidates(v("fx_cands"), I.lexical_scores).select(*CAND, *I.CRITERIA, "score", "tier")),
    "m2_corpus_scores": _q(lambda v: I.score_candidates(v("fx_cands")).select(*CAND, *I.CRITERIA, "tier")),
}

_NEAREST = """
  SELECT *, row_number() OVER (PARTITION BY video_id, KEYS ORDER BY o, g, iv_no) AS rn FROM (
    SELECT p.*, d.speaker AS at_speaker, d.iv_no, CASE WHEN t BETWEEN d.start_ms AND d.end_ms THEN 0 ELSE 1 END AS o,
      CASE WHEN t BETWEEN d.start_ms AND d.end_ms THEN 0 ELSE least(abs(t - d.start_ms), abs(t - d.end_ms)) END AS g
    FROM pt p JOIN FX_DIAR d ON p.video_id = d.video_id WITHIN) x
  WHERE g <= 500"""


def _nearest(keys: str, within: str) -> str:
    """SQL of the speaker at the middle t of each row of `pt`."""
    return _NEAREST.replace("FX_DIAR", "{fx_diar}").replace("KEYS", keys).replace("WITHIN", within)


_J5 = """
WITH pt AS (
  SELECT w.video_id, w.cand_no, w.turn_no, w.pos, w.word, s, e, c.start_ms AS c0, c.end_ms AS c1, coalesce((s + e) / 2, nullif(s, 0), e, 0) AS t
  FROM (SELECT *, CASE WHEN word_no % 11 <> 5 THEN start_ms END AS s, CASE WHEN word_no % 11 <> 7 THEN end_ms END AS e FROM {fx_cand_words}) w
  JOIN {fx_cands} c ON c.video_id = w.video_id AND c.cand_no = w.cand_no),
touched AS (
  SELECT DISTINCT c.video_id, c.cand_no FROM {fx_cands} c JOIN {fx_diar} d ON d.video_id = c.video_id AND d.start_ms < c.end_ms AND d.end_ms > c.start_ms),
near AS (NEAREST),
named AS (
  SELECT pt.*, t.text, t.start_ms AS t0, t.end_ms AS t1, touched.cand_no IS NOT NULL AS hit,
    CASE WHEN touched.cand_no IS NULL THEN t.speaker ELSE coalesce(near.at_speaker, t.speaker, 'SPEAKER_00') END AS sp
  FROM pt JOIN {fx_cand_turns} t USING (video_id, cand_no, turn_no)
  LEFT JOIN near ON near.video_id = pt.video_id AND near.cand_no = pt.cand_no AND near.turn_no = pt.turn_no AND near.pos = pt.pos AND near.rn = 1
  LEFT JOIN touched ON touched.video_id = pt.video_id AND touched.cand_no = pt.cand_no),
cut AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 OR (hit AND sp <> lag(sp) OVER w) OR (NOT hit AND turn_no <> lag(turn_no) OVER w) THEN 1 ELSE 0 END AS new
  FROM named WINDOW w AS (PARTITION BY video_id, cand_no ORDER BY turn_no, pos)),
run AS (SELECT *, CAST(sum(new) OVER (PARTITION BY video_id, cand_no ORDER BY turn_no, pos) AS BIGINT) AS k FROM cut),
made AS (
  SELECT video_id, cand_no, k AS turn_no, arg_min(sp, (turn_no, pos)) AS speaker,
    CASE WHEN bool_or(hit) THEN string_agg(trim(word), ' ' ORDER BY turn_no, pos) ELSE min(text) END AS text,
    CASE WHEN bool_or(hit) THEN arg_min(struct_pack(v := s), (turn_no, pos)).v ELSE min(t0) END AS start_ms,
    CASE WHEN bool_or(hit) THEN arg_max(struct_pack(v := coalesce(e, s)), (turn_no, pos)).v ELSE max(t1) END AS end_ms, count(*) AS n_words
  FROM run GROUP BY video_id, cand_no, k)
""".replace("NEAREST", _nearest("cand_no, turn_no, pos", "AND d.start_ms < p.c1 AND d.end_ms > p.c0"))
_MET = """
l AS (SELECT video_id, cand_no, 0 AS src, 0 AS k, 'SPEAKER_05' AS speaker FROM {fx_cands} WHERE cand_no % 3 > 0
  UNION ALL SELECT video_id, cand_no, 0, 1, speaker FROM {fx_cands} WHERE cand_no % 3 > 0
  UNION ALL SELECT video_id, cand_no, 1, turn_no, speaker FROM {fx_cand_turns}),
m AS (SELECT video_id, speaker, min((cand_no, src, k)) AS met FROM l GROUP BY ALL),
met AS (SELECT video_id, speaker, CAST(row_number() OVER (PARTITION BY video_id ORDER BY met, speaker) - 1 AS INTEGER) AS rank FROM m)"""
_VOICE = """
WITH {met},
more AS (SELECT video_id, 'SPEAKER_0' || i AS speaker, i FROM (SELECT DISTINCT video_id FROM met) x, range(4) r(i)
  WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.video_id = x.video_id AND met.speaker = 'SPEAKER_0' || i)),
a AS (SELECT video_id, speaker, 0 AS added, rank AS k FROM met UNION ALL SELECT video_id, speaker, 1, i FROM more),
b AS (SELECT video_id, speaker, row_number() OVER (PARTITION BY video_id ORDER BY added, k) - 1 AS rank, added FROM a),
c AS (SELECT video_id, speaker, rank, {kind} AS kind FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY video_id, kind ORDER BY rank) - 1 AS k FROM c),
e AS (SELECT video_id, speaker, rank, kind, CASE kind WHEN 'female' THEN 'f1' ELSE 'm' || (k % 2 + 1) END AS voice FROM d)
SELECT video_id, speaker, kind, voice FROM e UNION ALL SELECT video_id, '__default__', kind, voice FROM e WHERE rank = 0"""
_MIXED = """CASE WHEN added = 0 AND speaker <> 'SPEAKER_00' AND video_id % 3 = 0 THEN 'female'
    WHEN added = 0 AND speaker <> 'SPEAKER_00' AND video_id % 3 = 1 THEN 'male' ELSE (['male', 'female', 'male'])[least(rank, 2) + 1] END"""
_MERGED = """
x AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR sp <> lag(sp) OVER w THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY video_id, cand_no ORDER BY sent_no, k)),
y AS (SELECT *, CAST(sum(new) OVER (PARTITION BY video_id, cand_no ORDER BY sent_no, k) AS BIGINT) AS turn_no FROM x)
SELECT video_id, cand_no, turn_no, min(sp) AS speaker, string_agg(text, ' ' ORDER BY sent_no, k) AS text, string_agg(text_tr, ' ' ORDER BY sent_no, k) AS text_tr,
  arg_min(a, (sent_no, k)) AS start_ms, arg_max(b, (sent_no, k)) AS end_ms
FROM y GROUP BY video_id, cand_no, turn_no"""
_N = "len(list_filter(string_split_regex({}, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"
ORACLES = {k: oracle(v) for k, v in {
    "j5_apply_diarization": _J5 + "SELECT * FROM made",
    "j5_candidate_speakers": _J5 + "SELECT video_id, cand_no, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM made GROUP BY ALL",
    "j12_match_boundaries": """
WITH c AS (
  SELECT video_id, cand_no, cand_no % 5 AS kind, start_ms + CASE WHEN cand_no % 5 = 4 THEN 10000000 ELSE 0 END AS a,
    end_ms + CASE WHEN cand_no % 5 = 4 THEN 10000000 ELSE 0 END AS b,
    CASE cand_no % 5 WHEN 1 THEN 'zz' WHEN 2 THEN '' ELSE text END AS t
  FROM {fx_cands}),
p AS (
  SELECT c.*, s.seg_no, s.start_ms AS s, abs(s.start_ms - a) AS far, length(s.text) >= 2 AND t <> '' AS ok,
    starts_with(t, s.text) AS begins, suffix(t, s.text) AS ends
  FROM c JOIN {fx_segs} s USING (video_id)),
f AS (SELECT *, min(seg_no) FILTER (ok AND far < 10000 AND begins) OVER (PARTITION BY video_id, cand_no) AS f FROM p),
g AS (
  SELECT video_id, cand_no, min(f) AS f, max(seg_no) FILTER (ok AND ends AND s >= a - 1000 AND s <= b + 2000 AND seg_no >= coalesce(f, 0)) AS l,
    min(seg_no) FILTER (s >= a - 500 AND s < b + 500) AS tf, max(seg_no) FILTER (s >= a - 500 AND s < b + 500) AS tl, arg_min(seg_no, (far, seg_no)) AS near
  FROM f GROUP BY ALL)
SELECT video_id, cand_no, CASE WHEN f IS NOT NULL AND l IS NOT NULL THEN f ELSE coalesce(tf, near) END AS start_idx,
  CASE WHEN f IS NOT NULL AND l IS NOT NULL THEN l ELSE coalesce(tl, near) END AS end_idx
FROM g""",
    "j15_voice_plan": _VOICE.replace("{met}", _MET.strip()).replace("{kind}", _MIXED),
    "j15_voice_plan_preset": _VOICE.replace("{met}", _MET.strip()).replace("{kind}", "'female'"),
    "a6_speakers_met": f"WITH {_MET.strip()} SELECT * FROM met",
    "j19_input_of_chars": """
WITH t AS (SELECT video_id, turn_no, length(text) AS n FROM {fx_turns}), c AS (SELECT *, unnest(range(n)) AS k FROM t)
SELECT video_id, turn_no * 1000000 + k AS i, CASE WHEN k < n * 2 // 3 THEN turn_no END AS input_no FROM c""",
    "r10_move_sentences": f"""
WITH w AS (
  SELECT video_id, cand_no, list(struct_pack(w := word, s := start_ms, e := end_ms) ORDER BY word_no) AS ws FROM {{fx_cand_words}} GROUP BY ALL),
c AS (
  SELECT video_id, cand_no, text, start_ms, end_ms, ws, CAST((video_id + cand_no) % 3 AS INTEGER) AS tf, CAST((video_id + 2 * cand_no) % 4 AS INTEGER) AS tl,
    list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f]+([A-ZА-ЯЁ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> '') AS s
  FROM {{fx_cands}} LEFT JOIN w USING (video_id, cand_no)),
f AS (
  SELECT *, CASE WHEN tf > 0 AND lag(cand_no) OVER o IS NOT NULL AND len(s) > tf THEN tf ELSE 0 END AS f, lead(cand_no) OVER o IS NOT NULL AS more
  FROM c WINDOW o AS (PARTITION BY video_id ORDER BY cand_no)),
l AS (SELECT *, CASE WHEN tl > 0 AND more AND len(s) - f > tl THEN tl ELSE 0 END AS l FROM f),
h AS (SELECT *, s[:f] AS head, s[len(s) - l + 1:] AS tail, s[f + 1 : len(s) - l] AS body FROM l),
n AS (SELECT *, least({_N.format("array_to_string(head, ' ')")}, len(ws)) AS wf, {_N.format("array_to_string(tail, ' ')")} AS wt FROM h),
q AS (SELECT *, least(wt, len(ws) - wf) AS wl FROM n),
x AS (SELECT *, ws[:wf] AS whead, ws[len(ws) - wl + 1:] AS wtail, ws[wf + 1 : len(ws) - wl] AS wbody FROM q),
y AS (
  SELECT *, coalesce(lag(tail) OVER o, []) AS b, coalesce(lead(head) OVER o, []) AS a,
    list_concat(list_concat(coalesce(lag(wtail) OVER o, []), wbody), coalesce(lead(whead) OVER o, [])) AS wn
  FROM x WINDOW o AS (PARTITION BY video_id ORDER BY cand_no)),
z AS (SELECT *, f + l + len(a) + len(b) > 0 AS moved FROM y)
SELECT video_id, cand_no, CASE WHEN moved THEN array_to_string(list_concat(list_concat(b, body), a), ' ') ELSE text END AS text,
  CASE WHEN moved THEN coalesce(wn[1].s, start_ms) ELSE start_ms END AS start_ms, CASE WHEN moved THEN coalesce(wn[len(wn)].e, end_ms) ELSE end_ms END AS end_ms,
  CAST(len(wn) AS INTEGER) AS n_words, moved
FROM z""",
    "r13_rebuild_sentences": """
WITH sn AS (
  SELECT t.video_id, t.cand_no, t.turn_no AS sent_no, trim(' x ' || t.text) AS tr, t.text AS original, t.start_ms AS s0, t.end_ms AS s1, t.speaker AS ss,
    c.start_ms + 1500 AS c0, c.end_ms - 2000 AS c1
  FROM {fx_cand_turns} t JOIN {fx_cands} c USING (video_id, cand_no) WHERE t.turn_no % 13 <> 6),
pt AS (
  SELECT sn.*, w.word_no, w.word, w.start_ms, w.end_ms, w.speaker AS ws, (w.start_ms + w.end_ms) / 2 AS t
  FROM sn JOIN {fx_seg_words} w ON w.video_id = sn.video_id AND w.end_ms > s0 AND w.start_ms < s1 AND w.end_ms > c0 AND w.start_ms < c1),
near AS (NEAREST),
named AS (
  SELECT pt.*, coalesce(near.at_speaker, pt.ws) AS sp FROM pt
  LEFT JOIN near ON near.video_id = pt.video_id AND near.cand_no = pt.cand_no AND near.sent_no = pt.sent_no AND near.word_no = pt.word_no AND near.rn = 1),
cut AS (
  SELECT *, CASE WHEN sp <> lag(sp) OVER w THEN 1 ELSE 0 END AS new
  FROM named WINDOW w AS (PARTITION BY video_id, cand_no, sent_no ORDER BY start_ms, word_no)),
run AS (SELECT *, sum(new) OVER (PARTITION BY video_id, cand_no, sent_no ORDER BY start_ms, word_no) AS k FROM cut),
g AS (
  SELECT video_id, cand_no, sent_no, k, min(sp) AS sp, string_agg(word, ' ' ORDER BY start_ms, word_no) AS said, sum(end_ms - start_ms) AS d,
    min(start_ms) AS a, arg_max(end_ms, (start_ms, word_no)) AS b, min(tr) AS tr
  FROM run GROUP BY ALL),
h AS (
  SELECT *, string_split(tr, ' ') AS tk, count(*) OVER w AS runs, row_number() OVER (PARTITION BY video_id, cand_no, sent_no ORDER BY k) AS rn,
    greatest(1, CAST(round_even(len(string_split(tr, ' ')) * (CAST(d AS DOUBLE) / CAST(sum(d) OVER w AS DOUBLE)), 0) AS INTEGER)) AS n
  FROM g WINDOW w AS (PARTITION BY video_id, cand_no, sent_no)),
i AS (
  SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY video_id, cand_no, sent_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS skip
  FROM h),
j AS (SELECT *, array_to_string(tk[skip + 1 : CASE WHEN rn = runs THEN len(tk) ELSE skip + n END], ' ') AS part FROM i),
r AS (
  SELECT sn.video_id, sn.cand_no, sn.sent_no, coalesce(j.k, 0) AS k, coalesce(j.sp, sn.ss) AS sp, coalesce(j.said, sn.original) AS text,
    CASE WHEN j.runs > 1 AND part <> '' THEN part ELSE sn.tr END AS text_tr, coalesce(j.a, s0) AS a, coalesce(j.b, s1) AS b
  FROM sn LEFT JOIN j ON j.video_id = sn.video_id AND j.cand_no = sn.cand_no AND j.sent_no = sn.sent_no),
MERGED""".replace("MERGED", _MERGED).replace("NEAREST", _nearest("cand_no, sent_no, word_no", "")),
    "r13_rebuild_segments": """
WITH o AS (
  SELECT s.video_id, s.seg_no, arg_max(d.speaker, (least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms), -d.iv_no)) AS ds
  FROM {fx_segs} s JOIN {fx_diar} d ON d.video_id = s.video_id AND least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms) > 0 GROUP BY ALL),
r AS (
  SELECT c.video_id, c.cand_no, s.seg_no AS sent_no, 0 AS k, coalesce(ds, s.speaker) AS sp, CASE WHEN s.seg_no % 2 = 0 THEN 'tr ' ELSE '' END || s.text AS text,
    CASE WHEN s.seg_no % 2 = 0 THEN 'tr ' ELSE '' END || s.text AS text_tr, greatest(s.start_ms, c.start_ms + 1500) AS a, least(s.end_ms, c.end_ms - 2000) AS b
  FROM {fx_cands} c JOIN {fx_segs} s ON s.video_id = c.video_id AND s.end_ms > c.start_ms + 1500 AND s.start_ms < c.end_ms - 2000
  LEFT JOIN o ON o.video_id = s.video_id AND o.seg_no = s.seg_no),
MERGED""".replace("MERGED", _MERGED),
    "m2_corpus_scores": r"""
WITH p AS (
  SELECT video_id, cand_no, unnest(t) AS raw, unnest(range(len(t))) AS p
  FROM (SELECT *, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f]+'), lambda x: x <> '') AS t FROM {fx_cands})),
s AS (SELECT *, regexp_replace(trim(lower(raw)), '[.,!?;:—–\-…"''«»()]', '', 'g') AS w FROM p),
t AS (SELECT video_id, cand_no, w, count(*) AS k, count(*) FILTER (p < 12) AS o FROM s WHERE w <> '' GROUP BY ALL),
v AS (SELECT video_id, w, min(cand_no) AS first, count(*) AS held FROM t GROUP BY ALL),
f AS (SELECT w, sum(held) AS df FROM v GROUP BY w),
n AS (SELECT count(*) AS N FROM {fx_cands}),
r AS (
  SELECT t.*, first, held, CASE WHEN N > 1 THEN ln(N / df) / ln(N) ELSE 0 END AS r
  FROM t JOIN v USING (video_id, w) JOIN f USING (w), n),
g AS (
  SELECT video_id, cand_no, sum(k * r) / sum(k) AS spec, coalesce(sum(o * r) / nullif(sum(o), 0), 0) AS hook,
    coalesce(sum(r) FILTER (first = cand_no) / nullif(sum(r), 0), 0) AS nov, coalesce(sum(r) FILTER (held > 1) / nullif(sum(r), 0), 0) AS pers,
    sum(k) AS n, sum(k * length(w)) AS letters
  FROM r GROUP BY ALL),
m AS (SELECT avg(n) AS mn, sum(letters) / sum(n) AS ml FROM g),
c AS (
  SELECT video_id, cand_no, coalesce(text, '') AS text,
    round(coalesce(CASE WHEN regexp_matches(trim(coalesce(text, '')), '[.!?]$') THEN 0.5::DOUBLE ELSE 0 END + 0.5::DOUBLE * least(1, n / mn), 0), 6) AS completeness_arc,
    round(coalesce(nov, 0), 6) AS surprise_novelty, round(coalesce(hook, 0), 6) AS hook_quality, round(coalesce(pers, 0), 6) AS personal_connection,
    round(coalesce(spec, 0), 6) AS specificity_score, 0.5::DOUBLE AS actionability_score, round(coalesce(greatest(0, 1 - letters / n / ml / 2), 0), 6) AS clarity_simplicity
  FROM {fx_cands} LEFT JOIN g USING (video_id, cand_no), m),
x AS (
  SELECT *, round(least(completeness_arc * 0.3::DOUBLE + surprise_novelty * 0.15::DOUBLE + hook_quality * 0.15::DOUBLE + personal_connection * 0.1::DOUBLE
    + specificity_score * 0.1::DOUBLE + actionability_score * 0.1::DOUBLE + clarity_simplicity * 0.1::DOUBLE,
    CASE WHEN regexp_matches(trim(text), '^[a-zа-яё]') OR NOT regexp_matches(trim(text), '[.!?]$') THEN 0.25::DOUBLE ELSE 1 END), 9) AS score
  FROM c)
SELECT * EXCLUDE (text, score), CASE WHEN score >= 0.35 THEN 'strict' WHEN score >= 0.25 THEN 'extended' END AS tier FROM x""",
    "m2_score_candidates": """
WITH t AS (SELECT *, trim(text) AS x, list_filter(string_split_regex(trim(text), '[ \\t\\n\\r\\f]+'), lambda w: w <> '') AS ws FROM {fx_cands}),
n AS (SELECT *, len(ws) AS n, list_transform(ws, lambda w: regexp_replace(trim(lower(w)), '[.,!?;:—–\\-…"''«»()]', '', 'g')) AS lw FROM t),
c AS (
  SELECT video_id, cand_no, x,
    round(CASE WHEN regexp_matches(x, '[.!?]$') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + 0.5::DOUBLE * least(1.0::DOUBLE, n / 60::DOUBLE), 6) AS completeness_arc,
    round(least(1.0::DOUBLE, len(regexp_extract_all(x, '!')) * 10 / greatest(1, n)::DOUBLE), 6) AS surprise_novelty,
    round(least(1.0::DOUBLE, len(regexp_extract_all(x, '\\?')) * 10 / greatest(1, n)::DOUBLE), 6) AS hook_quality,
    round(least(1.0::DOUBLE, len(list_filter(lw, lambda w: w IN ('i', 'you', 'we', 'my', 'your', 'our'))) * 5 / greatest(1, n)::DOUBLE), 6) AS personal_connection,
    round(least(1.0::DOUBLE, len(regexp_extract_all(x, '[0-9]+')) * 5 / greatest(1, n)::DOUBLE), 6) AS specificity_score,
    round(least(1.0::DOUBLE, len(list_filter(lw, lambda w: w IN ('do', 'make', 'try', 'use', 'start', 'stop'))) * 10 / greatest(1, n)::DOUBLE), 6) AS actionability_score,
    round(1.0::DOUBLE - least(1.0::DOUBLE, greatest(0, length(x) - 6 * n) / 600::DOUBLE), 6) AS clarity_simplicity
  FROM n),
s AS (
  SELECT *, round(least(completeness_arc * 0.3::DOUBLE + surprise_novelty * 0.15::DOUBLE + hook_quality * 0.15::DOUBLE + personal_connection * 0.1::DOUBLE
      + specificity_score * 0.1::DOUBLE + actionability_score * 0.1::DOUBLE + clarity_simplicity * 0.1::DOUBLE,
    CASE WHEN regexp_matches(x, '^[a-zа-яё]') OR NOT regexp_matches(x, '[.!?]$') THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END), 9) AS score
  FROM c)
SELECT * EXCLUDE (x), CASE WHEN score >= 0.35 THEN 'strict' WHEN score >= 0.25 THEN 'extended' END AS tier FROM s""",
}.items()}
