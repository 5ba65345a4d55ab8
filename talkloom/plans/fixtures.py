"""Input views that the registered queries derive from the given tables.

Each view is SQL that both Spark and the checking engine read; where the two need different words, a view has
one text for each. `{name}` stands for a table or another view. Times are whole milliseconds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "conversations", "events", "embeddings", "labels")

_PIECES = (
    """SELECT conv_id, turn, role, pos + 1 AS pos, word
        FROM (SELECT conv_id, turn, role, posexplode(split(text, '[ \\\\t\\\\n\\\\r\\\\f]+')) AS (pos, word) FROM {conversations})
        WHERE word <> ''""",
    """SELECT * FROM (
          SELECT conv_id, turn, role, unnest(range(1, len(p) + 1)) AS pos, unnest(p) AS word
          FROM (SELECT *, string_split_regex(text, '[ \\t\\n\\r\\f]+') AS p FROM {conversations}))
        WHERE word <> ''""",
)
_TEXT = ("array_join(transform(array_sort(collect_list(struct({k}, {v}))), x -> x.{v}), ' ')", "string_agg({v}, ' ' ORDER BY {k})")


def _both(sql: str, k: str, v: str) -> tuple[str, str]:
    return tuple(sql.replace("TEXT", t.replace("{k}", k).replace("{v}", v)) for t in _TEXT)


_CRITERIA = ", ".join(f"((video_id * 31 + cand_no * 17 + {k} * 13) % 101) / 100.0D AS c{k}" for k in range(7))
#: name -> SQL, or (Spark SQL, the other engine's SQL)
VIEWS: dict[str, str | tuple[str, str]] = {
    "fx_pieces": _PIECES,
    "fx_words": """
        SELECT video_id, turn_no, pos, word, speaker, CAST(s - d - p AS BIGINT) AS start_ms, CAST(s - p AS BIGINT) AS end_ms,
          CAST(row_number() OVER (PARTITION BY video_id ORDER BY turn_no, pos) AS BIGINT) AS word_no
        FROM (
          SELECT *, sum(d + p) OVER (PARTITION BY video_id ORDER BY turn_no, pos) AS s
          FROM (
            SELECT conv_id AS video_id, turn AS turn_no, CAST(pos AS BIGINT) AS pos, word,
              CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' ELSE 'SPEAKER_02' END AS speaker,
              CAST(60 * length(word) + 140 AS BIGINT) AS d,
              CAST(CASE WHEN right(word, 1) IN ('.', '!', '?', ';', ':') THEN 500 ELSE 40 END AS BIGINT) AS p
            FROM {fx_pieces}) a) b""",
    "fx_sent": """
        SELECT *, CAST(coalesce(sum(CASE WHEN right(word, 1) IN ('.', '!', '?') THEN 1 ELSE 0 END)
          OVER (PARTITION BY video_id, turn_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg
        FROM {fx_words}""",
    "fx_segs": _both(
        """
        SELECT CAST(row_number() OVER (PARTITION BY video_id ORDER BY turn_no, seg) - 1 AS BIGINT) AS seg_no, *
        FROM (
          SELECT video_id, turn_no, seg, min(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, TEXT AS text
          FROM {fx_sent} GROUP BY video_id, turn_no, seg) g""",
        "pos",
        "word",
    ),
    "fx_seg_words": """
        SELECT w.video_id, s.seg_no, w.pos, w.word_no, w.word, w.speaker, w.start_ms, w.end_ms
        FROM {fx_sent} w JOIN {fx_segs} s ON s.video_id = w.video_id AND s.turn_no = w.turn_no AND s.seg = w.seg""",
    "fx_turns": _both(
        """
        SELECT video_id, turn_no, min(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, TEXT AS text
        FROM {fx_words} GROUP BY video_id, turn_no""",
        "pos",
        "word",
    ),
    "fx_diar": """
        SELECT video_id, turn_no AS iv_no, CASE WHEN turn_no % 7 = 3 THEN 'SPEAKER_09' ELSE speaker END AS speaker, s AS start_ms, e AS end_ms
        FROM (
          SELECT video_id, turn_no, speaker, CAST(greatest(0, start_ms + (video_id * 37 + turn_no * 91) % 3000 - 1500) AS BIGINT) AS s,
            CAST(end_ms + (video_id * 53 + turn_no * 29) % 3000 - 1500 AS BIGINT) AS e
          FROM {fx_turns}) x
        WHERE e > s""",
    "fx_cands": _both(
        """
        SELECT CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_ms) - 1 AS BIGINT) AS cand_no, *
        FROM (
          SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(speaker) AS speaker, TEXT AS text
          FROM {fx_segs} GROUP BY video_id, CAST(floor(start_ms / 30000) AS BIGINT)) g""",
        "seg_no",
        "text",
    ),
    "fx_cand_turns": """
        SELECT s.video_id, c.cand_no, s.seg_no AS turn_no, s.speaker, s.text, s.start_ms, s.end_ms
        FROM {fx_segs} s JOIN {fx_cands} c
          ON c.video_id = s.video_id AND CAST(floor(c.start_ms / 30000) AS BIGINT) = CAST(floor(s.start_ms / 30000) AS BIGINT)""",
    "fx_cand_words": """
        SELECT w.video_id, t.cand_no, w.seg_no AS turn_no, w.pos, w.word_no, w.word, w.speaker, w.start_ms, w.end_ms
        FROM {fx_seg_words} w JOIN {fx_cand_turns} t ON t.video_id = w.video_id AND t.turn_no = w.seg_no""",
    "fx_scores": f"""
        SELECT *, {_CRITERIA}, (video_id * 7 + cand_no) % 11 = 0 AS needs_prev, (video_id * 5 + cand_no) % 13 = 0 AS needs_next,
          CASE (video_id + cand_no) % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS benefit
        FROM {{fx_cands}}""",
    "fx_over": tuple(
        f"""
        SELECT v.video_id, CAST(row_number() OVER (PARTITION BY v.video_id ORDER BY start_ms, end_ms) - 1 AS BIGINT) AS cand_no, start_ms, end_ms,
          CAST(((v.video_id * 31 + start_ms / 1000 * 17 + end_ms / 1000 * 13) % 101) / 100.0D AS DOUBLE) AS score
        FROM (
          SELECT video_id, k * 15000 AS start_ms, k * 15000 + w AS end_ms
          FROM (SELECT video_id, k, {widths} AS w FROM (SELECT video_id, {steps} AS k FROM (
            SELECT video_id, CAST(max(end_ms) AS BIGINT) AS stop FROM {{fx_words}} GROUP BY video_id) m WHERE stop > 0) s) t) v"""
        for steps, widths in (("explode(sequence(0L, (stop - 1) div 15000))", "explode(array(30000, 60000, 90000))"), ("unnest(range((stop - 1) // 15000 + 1))", "unnest([30000, 60000, 90000])"))
    ),
    "fx_texts": """
        SELECT video_id, seg_no, speaker, start_ms, end_ms,
          CASE seg_no % 9 WHEN 0 THEN concat('“', text, '” — ok…') WHEN 1 THEN concat('[excitedly] ', text, '?!')
            WHEN 2 THEN concat(' **', text, '** `x`... ') WHEN 3 THEN concat(text, ' haha Lol') WHEN 4 THEN concat('его иллюзия: ', text, '!')
            WHEN 5 THEN concat(text, ' I am on it; 7, 3, x 3 12') WHEN 6 THEN '' WHEN 7 THEN NULL ELSE text END AS text
        FROM {fx_segs}""",
    "fx_samples": """
        SELECT user_id AS series, CAST(event_id AS BIGINT) AS sample_no, CASE WHEN event_type = 'error' THEN NULL ELSE least(value / 400, 1.0D) END AS v
        FROM {events}""",
    # A frame a day, on a clock of seconds.
    "fx_boxes": (
        """
        SELECT user_id AS video_id, CAST(datediff(ts, DATE'2020-01-01') AS BIGINT) * 1000 AS ts_ms, CAST(event_id AS BIGINT) AS box_no,
          CAST(10 + event_id % 90 AS DOUBLE) AS w, (10 + event_id % 90) * 1.2D AS h, CAST((event_id * 37) % 1920 AS DOUBLE) AS center_x,
          (10 + event_id % 90) * (10 + event_id % 90) * 1.2D AS area, (event_id % 100) / 100.0D AS score
        FROM {events}""",
        """
        SELECT user_id AS video_id, CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS BIGINT) * 1000 AS ts_ms,
          CAST(event_id AS BIGINT) AS box_no, CAST(10 + event_id % 90 AS DOUBLE) AS w, (10 + event_id % 90) * 1.2::DOUBLE AS h,
          CAST((event_id * 37) % 1920 AS DOUBLE) AS center_x, (10 + event_id % 90) * (10 + event_id % 90) * 1.2::DOUBLE AS area,
          (event_id % 100) / 100.0::DOUBLE AS score
        FROM {events}""",
    ),
    "fx_scenes": """
        SELECT video_id, CAST(floor(ts_ms / 10000) AS BIGINT) AS scene_no, CAST(floor(ts_ms / 10000) AS BIGINT) * 10000 AS start_ms,
          CAST(floor(ts_ms / 10000) AS BIGINT) * 10000 + 10000 AS end_ms
        FROM {fx_boxes} GROUP BY video_id, CAST(floor(ts_ms / 10000) AS BIGINT)""",
}


def _parts(name: str, engine: int) -> str:
    sql = VIEWS[name]
    sql = sql if isinstance(sql, str) else sql[engine]
    return sql.replace("0D", "0") if engine else sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _parts(name, 0)
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))})


def oracle(sql: str) -> str:
    """SQL of the checking engine with its `{view}` names put before it as common table expressions."""
    need: dict[str, str] = {}

    def add(text: str) -> None:
        for n in re.findall(r"\{(\w+)\}", text):
            if n in VIEWS and n not in need:
                add(_parts(n, 1))
                need[n] = _parts(n, 1)

    add(sql)
    strip = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    body, head = strip(sql).strip(), ",\n".join(f"{n} AS ({strip(t)})" for n, t in need.items())
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
