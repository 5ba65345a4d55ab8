"""Queries of scene and clip focus and of box tracks, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import focus as C
from talkloom.operators import selection as L
from talkloom.operators.tracks import track_boxes
from talkloom.plans.fixtures import oracle, view


def _q(fn):
    return lambda spark, d: fn(lambda name: view(spark, d, name))


def _stats(v):
    return C.scene_stats(v("fx_boxes"), v("fx_scenes"))


def _speaking(v):
    """A speaker at the start of two scenes out of three."""
    n = F.col("video_id") + F.col("scene_no")
    return v("fx_scenes").withColumn("speaker", F.when(n % 3 == 0, "SPEAKER_00").when(n % 3 == 1, "SPEAKER_01"))


def _clips(v):
    return v("fx_boxes").withColumn("clip_no", F.floor(F.col("ts_ms") / 8000))


def _primary(v):
    """Turns of a clip's primary speaker: its first half, for two clips out of three."""
    clips = _clips(v).select("video_id", "clip_no").distinct().filter("(video_id + clip_no) % 3 > 0")
    return clips.select("video_id", "clip_no", (F.col("clip_no") * 8000).alias("start_ms"), (F.col("clip_no") * 8000 + 4000).alias("end_ms"))


def _tracks(v):
    """Boxes in four lanes of a frame, so that those of neighbouring frames overlap."""
    boxes = v("fx_boxes").withColumn("x", (F.col("box_no") % 4) * 480 + (F.col("box_no") % 7) * 4).withColumn("y", F.lit(100.0))
    boxes = boxes.withColumn("w", F.lit(60.0)).withColumn("h", F.lit(70.0)).withColumn("center_x", F.col("x") + 30).withColumn("x", F.col("x").cast("double"))
    return track_boxes(v("fx_boxes").select("video_id", "ts_ms"), boxes).withColumn("center_x", F.round("center_x", 6))


QUERIES = {
    "a14_scene_stats": _q(lambda v: _rounded(_stats(v))),
    "a15_scene_focus": _q(lambda v: C.scene_focus(v("fx_scenes"), C.scene_stats(L.filter_detections(v("fx_boxes")), v("fx_scenes")), _speaking(v))),
    "a15_scene_focus_unheard": _q(lambda v: C.scene_focus(v("fx_scenes"), _stats(v), None, 1900.0)),
    "a23_clip_focus": _q(lambda v: C.clip_focus(_clips(v), _primary(v))),
    "w17_track_boxes": _q(_tracks),
}


def _digits(column: str) -> int:
    """Places are parts of a frame, areas are thousands of pixels."""
    return 6 if "area" in column or column in ("ratio", "late_left", "late_right") else 12


def _rounded(df):
    return df.select(*[F.round(c, _digits(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


#: Scene statistics step by step, over boxes `bx`.
_STATS = """
f AS (
  SELECT c.video_id, c.scene_no, b.ts_ms, b.box_no, center_x / 1920::DOUBLE AS p, w, h, area, score,
    count(*) OVER fr AS n, row_number() OVER (PARTITION BY c.video_id, c.scene_no, ts_ms ORDER BY w * h DESC, box_no) AS k,
    dense_rank() OVER (PARTITION BY c.video_id, c.scene_no ORDER BY ts_ms) AS fno
  FROM {fx_scenes} c JOIN bx b ON b.video_id = c.video_id AND b.ts_ms >= c.start_ms AND b.ts_ms < c.end_ms
  WINDOW fr AS (PARTITION BY c.video_id, c.scene_no, ts_ms)),
g AS (SELECT *, min(p) OVER s AS l, max(p) OVER s AS r, max(fno) OVER s AS frames FROM f WINDOW s AS (PARTITION BY video_id, scene_no)),
h AS (
  SELECT *, coalesce(avg(p) FILTER (p < (l + r) / 2) OVER s, l) AS la, coalesce(avg(p) FILTER (p >= (l + r) / 2) OVER s, r) AS ra
  FROM g WINDOW s AS (PARTITION BY video_id, scene_no)),
i AS (SELECT *, p < (la + ra) / 2 AS lft, fno > greatest(1, floor(frames * 0.6::DOUBLE)) AS late FROM h),
m AS (
  SELECT video_id, scene_no, n, row_number() OVER (PARTITION BY video_id, scene_no ORDER BY count(*) DESC, n) AS o
  FROM i WHERE k = 1 GROUP BY video_id, scene_no, n),
st AS (
  SELECT i.video_id, i.scene_no, max(frames) AS n_frames, count(*) FILTER (i.n = 1) / max(frames) AS single_share, avg(p) FILTER (i.n = 1) AS single_at,
    coalesce(max(p) FILTER (i.n = 1) - min(p) FILTER (i.n = 1), 0) AS single_spread, avg(p) AS all_at, max(l) AS "left", max(r) AS "right", max(la) AS left_at,
    max(ra) AS right_at, avg(p) FILTER (i.n >= 2 AND k = 1) AS large_at, avg(p) FILTER (i.n >= 2 AND k = 2) AS small_at,
    coalesce(avg(score) FILTER (i.n >= 2 AND k = 1), 0) AS large_score, coalesce(avg(score) FILTER (i.n >= 2 AND k = 2), 0) AS small_score,
    CASE WHEN coalesce(avg(w * h) FILTER (i.n >= 2 AND k = 2), 0) > 0
      THEN avg(w * h) FILTER (i.n >= 2 AND k = 1) / avg(w * h) FILTER (i.n >= 2 AND k = 2) ELSE 999.0::DOUBLE END AS ratio,
    coalesce(avg(area) FILTER (lft), 0) AS left_area, coalesce(avg(area) FILTER (NOT lft), 0) AS right_area, coalesce(avg(area) FILTER (lft AND late), 0) AS late_left,
    coalesce(avg(area) FILTER (NOT lft AND late), 0) AS late_right, count(*) FILTER (late AND k = 1) AS n_late
  FROM i GROUP BY i.video_id, i.scene_no),
stats AS (SELECT st.*, m.n AS most FROM st JOIN m ON m.video_id = st.video_id AND m.scene_no = st.scene_no AND m.o = 1)"""
_ROUNDED = ["single_share", "single_at", "single_spread", "all_at", "left", "right", "left_at", "right_at", "large_at", "small_at", "large_score", "small_score"]
_ROUNDED += ["ratio", "left_area", "right_area", "late_left", "late_right"]
#: The cascade from statistics to the focus, and the last focus for scenes without faces.
_FOCUS = """
c AS (
  SELECT s.video_id, s.scene_no, most, SPEAKER AS speaker,
    CASE WHEN most = 1 THEN coalesce(single_at, all_at)
      WHEN ratio >= 2 AND large_at IS NOT NULL AND small_score > large_score * 1.3::DOUBLE AND small_score >= 0.55::DOUBLE THEN small_at
      WHEN ratio >= 2 AND large_at IS NOT NULL THEN large_at
      WHEN single_share >= 0.3::DOUBLE AND single_at IS NOT NULL AND single_spread < 0.2::DOUBLE THEN single_at
      WHEN ("right" - "left") * SCALED + 200 <= 1080 THEN (left_at + right_at) / 2
      WHEN SPEAKER IS NOT NULL THEN CASE WHEN contains(SPEAKER, '00') OR suffix(SPEAKER, '0') THEN left_at ELSE right_at END
      WHEN single_share >= 0.3::DOUBLE AND single_spread >= 0.2::DOUBLE THEN right_at
      WHEN n_late >= 2 AND ((late_left > 0 AND late_right = 0) OR late_left > 2 * late_right) THEN left_at
      WHEN n_late >= 2 AND ((late_right > 0 AND late_left = 0) OR late_right > 2 * late_left) THEN right_at
      WHEN left_area > 1.2::DOUBLE * right_area THEN left_at ELSE right_at END AS place
  FROM {fx_scenes} s LEFT JOIN stats USING (video_id, scene_no))
SELECT video_id, scene_no, round(coalesce(last_value(CASE WHEN most IS NOT NULL THEN greatest(0.2::DOUBLE, least(0.8::DOUBLE, place)) END IGNORE NULLS)
  OVER (PARTITION BY video_id ORDER BY scene_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.5::DOUBLE), 12) AS focus
FROM c"""
_SPEAKER = "CASE (video_id + scene_no) % 3 WHEN 0 THEN 'SPEAKER_00' WHEN 1 THEN 'SPEAKER_01' END"
_FIT = "bx AS (SELECT * FROM {fx_boxes} WHERE w >= 16 AND area >= 0.0005::DOUBLE * 1920 * 1080 AND score >= 0.5::DOUBLE)"
ORACLES = {k: oracle(v) for k, v in {
    "a14_scene_stats": f"WITH bx AS (SELECT * FROM {{fx_boxes}}),{_STATS} SELECT * REPLACE ({', '.join(f'round("{c}", {_digits(c)}) AS "{c}"' for c in _ROUNDED)}) FROM stats",
    "a15_scene_focus": f"WITH {_FIT},{_STATS},{_FOCUS}".replace("SPEAKER AS speaker", f"{_SPEAKER} AS speaker").replace("SPEAKER IS", f"{_SPEAKER} IS")
    .replace("contains(SPEAKER,", f"contains({_SPEAKER},").replace("suffix(SPEAKER,", f"suffix({_SPEAKER},").replace("SCALED", "3413.0::DOUBLE"),
    "a15_scene_focus_unheard": f"WITH bx AS (SELECT * FROM {{fx_boxes}}),{_STATS},{_FOCUS}".replace("SPEAKER", "CAST(NULL AS VARCHAR)").replace("SCALED", "1900.0::DOUBLE"),
    "a23_clip_focus": """
WITH b AS (
  SELECT *, ts_ms // 8000 AS clip_no, center_x / 1920::DOUBLE AS p, score * area AS wt, count(*) OVER (PARTITION BY video_id, ts_ms) AS n,
    row_number() OVER (PARTITION BY video_id, ts_ms ORDER BY area DESC, box_no) AS k
  FROM {fx_boxes}),
f AS (
  SELECT video_id, clip_no, ts_ms, max(n) AS n, min(p) AS lo, max(p) AS hi, sum(wt) AS wt, max(p) FILTER (k = 1) AS bp, max(wt) FILTER (k = 1) AS bw,
    max(area) FILTER (k = 1) AS ba, max(area) FILTER (k = 2) AS b2
  FROM b GROUP BY ALL),
g AS (SELECT *, n = 1 OR ba / greatest(b2, 1.0::DOUBLE) >= 3 AS alone, hi - lo < 0.4::DOUBLE AS close FROM f),
h AS (
  SELECT video_id, clip_no, ts_ms, lo, hi, CASE WHEN alone THEN bp END AS single, CASE WHEN alone THEN bp WHEN close THEN (lo + hi) / 2 END AS c,
    CASE WHEN alone THEN bw WHEN close THEN wt END AS w, NOT alone AND NOT close AS pair, (video_id + clip_no) % 3 > 0 AND ts_ms < clip_no * 8000 + 4000 AS said
  FROM g),
i AS (SELECT *, (min(single) OVER s + max(single) OVER s) / 2 AS mid FROM h WINDOW s AS (PARTITION BY video_id, clip_no)),
m AS (
  SELECT video_id, clip_no, count(*) FILTER (pair) AS pairs, count(single) AS singles, count(c) AS n, sum(c * w) / nullif(sum(w), 0) AS mean,
    avg(lo) FILTER (pair) AS pl, avg(hi) FILTER (pair) AS pr, avg(single) FILTER (single < mid) AS sl, avg(single) FILTER (single >= mid) AS sr,
    max(single) - min(single) AS span, avg(single) FILTER (said) AS prim
  FROM i GROUP BY ALL HAVING count(c) > 0),
t AS (
  SELECT *, CASE WHEN pairs > 0 AND (pairs >= 2 OR pairs / (pairs + singles) >= 0.3::DOUBLE) THEN pl WHEN pairs = 0 AND singles >= 3 AND span > 0.35::DOUBLE THEN sl END AS l,
    CASE WHEN pairs > 0 AND (pairs >= 2 OR pairs / (pairs + singles) >= 0.3::DOUBLE) THEN pr WHEN pairs = 0 AND singles >= 3 AND span > 0.35::DOUBLE THEN sr END AS r
  FROM m),
u AS (
  SELECT *, l IS NOT NULL AND r IS NOT NULL AS two, CASE WHEN abs(prim - l) < abs(prim - r) THEN l ELSE r END AS near,
    CASE WHEN n >= 2 AND mean IS NOT NULL THEN least(0.4::DOUBLE, n / 10) ELSE 0.0::DOUBLE END AS pull
  FROM t),
x AS (
  SELECT *, CASE WHEN two AND prim IS NOT NULL THEN (1 - pull) * near + pull * coalesce(mean, 0) WHEN two THEN coalesce(0.5::DOUBLE * (l + r) / 2 + 0.5::DOUBLE * mean, (l + r) / 2)
    WHEN mean < 0.15::DOUBLE OR mean > 0.85::DOUBLE THEN 0.5::DOUBLE ELSE mean END AS f
  FROM u)
SELECT video_id, clip_no, round(CASE WHEN f IS NOT NULL THEN greatest(0.2::DOUBLE, least(0.8::DOUBLE, f)) END, 12) AS focus,
  round(CASE WHEN two THEN l END, 12) AS left_at, round(CASE WHEN two THEN r END, 12) AS right_at
FROM x""",
    "w17_track_boxes": """
WITH RECURSIVE b AS (
  SELECT video_id, ts_ms, box_no, CAST(box_no % 4 * 480 + box_no % 7 * 4 AS DOUBLE) AS x, row_number() OVER w AS k,
    ts_ms IS DISTINCT FROM lag(ts_ms) OVER w AS first, ts_ms IS DISTINCT FROM lead(ts_ms) OVER w AS last
  FROM {fx_boxes} WINDOW w AS (PARTITION BY video_id ORDER BY ts_ms, box_no)),
-- A box a step. tracks: those not forgotten after it; taken: by a box of its frame; gone: what a frame's end predicts.
r(video_id, k, ts_ms, box_no, made, tracks, track_id, center_x, gone) AS (
  SELECT video_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, list_filter([{'n': 0::BIGINT, 'x': 0::DOUBLE, 'c': 0::DOUBLE, 'hits': 0, 'unseen': 0, 'no': 0::BIGINT, 'taken': false}], lambda t: false),
    0::BIGINT, 0::DOUBLE, list_filter([{'n': 0::BIGINT, 'c': 0::DOUBLE, 'no': 0::BIGINT}], lambda t: false)
  FROM (SELECT DISTINCT video_id FROM b)
  UNION ALL
  SELECT b.video_id, b.k, b.ts_ms, b.box_no, made + CASE WHEN own IS NULL THEN 1 ELSE 0 END,
    CASE WHEN b.last THEN list_filter(upd, lambda t: t.unseen <= 15) ELSE upd END,
    coalesce(own, made + 1), list_filter(upd, lambda t: t.n = coalesce(own, made + 1))[1].c,
    CASE WHEN b.last THEN list_transform(list_filter(upd, lambda t: t.unseen BETWEEN 1 AND 5 AND t.hits >= 3), lambda t: {'n': t.n, 'c': t.c, 'no': t.no})
      ELSE list_filter(gone, lambda t: false) END
  FROM r JOIN b ON b.video_id = r.video_id AND b.k = r.k + 1,
    LATERAL (SELECT CASE WHEN b.first THEN list_transform(r.tracks, lambda t: {'n': t.n, 'x': t.x, 'c': t.c, 'hits': t.hits, 'unseen': t.unseen + 1, 'no': t.no, 'taken': false})
      ELSE r.tracks END AS now) n,
    LATERAL (SELECT -list_max(list_filter(list_transform(list_filter(now, lambda t: NOT t.taken),
      lambda t: {'fit': greatest(0::DOUBLE, 60 - abs(t.x - b.x)) * 70 / (8400 - greatest(0::DOUBLE, 60 - abs(t.x - b.x)) * 70), 'm': -t.n}), lambda t: t.fit > 0.25::DOUBLE)).m AS own) o,
    LATERAL (SELECT CASE WHEN own IS NULL THEN list_append(now, {'n': made + 1, 'x': b.x, 'c': b.x + 30, 'hits': 1, 'unseen': 0, 'no': b.box_no, 'taken': true})
      ELSE list_transform(now, lambda t: CASE WHEN t.n = own
        THEN {'n': t.n, 'x': b.x, 'c': 0.3::DOUBLE * t.c + 0.7::DOUBLE * (b.x + 30), 'hits': t.hits + 1, 'unseen': 0, 'no': b.box_no, 'taken': true} ELSE t END) END AS upd) u)
SELECT video_id, ts_ms, box_no, track_id, round(center_x, 6) AS center_x, false AS predicted FROM r WHERE k > 0
UNION ALL
SELECT video_id, ts_ms, g.no, g.n, round(g.c, 6), true FROM (SELECT video_id, ts_ms, unnest(gone) AS g FROM r WHERE k > 0) y""",
}.items()}
