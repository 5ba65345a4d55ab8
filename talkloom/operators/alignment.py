"""Expected words and characters against recognised ones, and sentences handed over between candidates."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.text import WORD_PUNCTUATION

#: Places of characters to a bucket.
BUCKET = 1000
_STRIP = str.maketrans("", "", WORD_PUNCTUATION)


def input_of_chars(chars: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds input_no: the first input whose range [first, stop) of character places holds i, null where none does.
    chars: video_id, i; ranges: video_id, input_no, first, stop. A character meets one row, the ranges of its bucket."""
    side = ranges.select("video_id", "input_no", F.col("first").alias("r0"), F.col("stop").alias("r1")).filter("r0 < r1")
    side = side.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("r0") / BUCKET), F.floor((F.col("r1") - 1) / BUCKET))))
    side = side.groupBy("video_id", "bucket").agg(F.collect_list(F.struct("input_no", "r0", "r1")).alias("ranges"))
    met = chars.withColumn("bucket", F.floor(F.col("i") / BUCKET)).join(side, ["video_id", "bucket"], "left")
    holds = F.filter("ranges", lambda r: (F.col("i") >= r["r0"]) & (F.col("i") < r["r1"]))
    return met.select(*chars.columns, F.array_min(F.transform(holds, lambda r: r["input_no"])).alias("input_no"))


def matches(expected: list[str], heard: list[str], window: int = 3, least: float = 0.6) -> dict[int, int]:
    """Places of expected words to places of heard ones: equal runs one to one, replaced runs from their start on as
    far as both go, and words that were not heard with the unused word most alike within `window` of the place, the
    first of equals, if they are alike enough."""
    norm = lambda words: [(w or "").lower().strip().translate(_STRIP) for w in words]
    a, b = norm(expected), norm(heard)
    found: dict[int, int] = {}
    for kind, a0, a1, b0, b1 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind in ("equal", "replace"):
            found |= dict(zip(range(a0, a1), range(b0, b1)))
        elif kind == "delete":
            used = set(found.values())
            for i in range(a0, a1):
                near = [(SequenceMatcher(None, a[i], b[j]).ratio(), -j) for j in range(max(0, b0 - window), min(len(b), b1 + window)) if j not in used]
                ratio, j = max(near, default=(0.0, 0))
                if ratio >= least:
                    found[i] = -j
                    used.add(-j)
    return found


def align_words(expected: DataFrame, recognised: DataFrame) -> DataFrame:
    """Expected words (video_id, turn_no, pos, word) with the times of the recognised words (video_id, word_no, word,
    start_ms, end_ms) they match over the whole recording; null times where none matches, to be filled by
    interpolate_words(). A recording's two word lists are one task: a match depends on all others."""
    schema = "video_id long, turn_no long, pos long, word string, start_ms long, end_ms long, heard string"

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(["turn_no", "pos"]), b.sort_values("word_no")
        found, heard = matches(a.word.tolist(), b.word.tolist()), b.to_dict("records")
        rows = []
        for i, (video, turn, pos, word) in enumerate(a[["video_id", "turn_no", "pos", "word"]].itertuples(index=False)):
            at = heard[found[i]] if i in found else {}
            rows.append((video, turn, pos, word, at.get("start_ms"), at.get("end_ms"), at.get("word")))
        out = pd.DataFrame(rows, columns=["video_id", "turn_no", "pos", "word", "start_ms", "end_ms", "heard"], dtype=object)
        return out

    left = expected.select("video_id", "turn_no", "pos", "word").groupBy("video_id")
    return left.cogroup(recognised.select("video_id", "word_no", "word", "start_ms", "end_ms").groupBy("video_id")).applyInPandas(run, schema)


def _sentences(text: Column) -> Column:
    """Sentences, cut after .!? and white space before a capital letter."""
    mark = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"([.!?])[ \t\n\r\f]+([A-ZА-ЯЁ])", "$1\u0001$2")
    return F.filter(F.transform(F.split(mark, "\u0001"), F.trim), lambda s: s != "")


def _n_words(sentences: Column) -> Column:
    return F.size(F.filter(F.split(F.array_join(sentences, " "), r"[ \t\n\r\f]+"), lambda w: w != ""))


def move_sentences(cands: DataFrame, words: DataFrame) -> DataFrame:
    """Sentences handed over between neighbours: a candidate (text, trim_first, trim_last) gives its first trim_first
    sentences to the one before and its last trim_last to the one after, if there is a neighbour and it has more
    than it gives (what it gives at its start counts as gone). As many words as the sentences hold go with them
    (words: cand_no, pos, word, start_ms, end_ms). Gives cand_no, text, start_ms and end_ms (from the words, where
    there are any), n_words and moved."""
    keys = ["video_id", "cand_no"]
    listed = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "word", "start_ms", "end_ms"))).alias("ws"))  # one candidate's
    none = F.expr("cast(array() as array<struct<pos:bigint,word:string,start_ms:bigint,end_ms:bigint>>)")
    rows = cands.select(*keys, "text", "start_ms", "end_ms", "trim_first", "trim_last").join(listed, keys, "left")
    rows = rows.withColumn("ws", F.coalesce("ws", none)).withColumn("s", _sentences(F.col("text")))
    order = Window.partitionBy("video_id").orderBy("cand_no")
    n = F.size("s")
    first = F.when((F.col("trim_first") > 0) & F.lag("cand_no").over(order).isNotNull() & (n > F.col("trim_first")), F.col("trim_first")).otherwise(0)
    rows = rows.withColumn("f", first.cast("int"))
    last = F.when((F.col("trim_last") > 0) & F.lead("cand_no").over(order).isNotNull() & (n - F.col("f") > F.col("trim_last")), F.col("trim_last")).otherwise(0)
    rows = rows.withColumn("l", last.cast("int"))
    head, tail = F.slice("s", F.lit(1), F.col("f")), F.slice("s", n - F.col("l") + 1, F.col("l"))
    rows = rows.withColumns({"head": head, "tail": tail, "s": F.slice("s", F.col("f") + 1, n - F.col("f") - F.col("l"))})
    size = F.size("ws")
    rows = rows.withColumn("wf", F.least(_n_words(F.col("head")), size))
    rows = rows.withColumn("wl", F.least(_n_words(F.col("tail")), size - F.col("wf")))
    whead, wtail = F.slice("ws", F.lit(1), F.col("wf")), F.slice("ws", size - F.col("wl") + 1, F.col("wl"))
    rows = rows.withColumns({"whead": whead, "wtail": wtail, "ws": F.slice("ws", F.col("wf") + 1, size - F.col("wf") - F.col("wl"))})
    no_text = F.expr("cast(array() as array<string>)")
    got = lambda c, other, empty: F.coalesce(other(c).over(order), empty)
    rows = rows.withColumns({"before": got("tail", F.lag, no_text), "after": got("head", F.lead, no_text), "wbefore": got("wtail", F.lag, none), "wafter": got("whead", F.lead, none)})
    rows = rows.withColumn("ws", F.concat("wbefore", "ws", "wafter"))
    moved = (F.col("f") + F.col("l") + F.size("before") + F.size("after")) > 0
    text = F.when(moved, F.array_join(F.concat("before", "s", "after"), " ")).otherwise(F.col("text"))
    start = F.when(moved, F.coalesce(F.get("ws", F.lit(0))["start_ms"], "start_ms")).otherwise(F.col("start_ms"))
    end = F.when(moved, F.coalesce(F.get("ws", F.size("ws") - 1)["end_ms"], "end_ms")).otherwise(F.col("end_ms"))
    return rows.select(*keys, text.alias("text"), start.alias("start_ms"), end.alias("end_ms"), F.size("ws").alias("n_words"), moved.alias("moved"))
