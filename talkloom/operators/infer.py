"""A user's batch function over rows, with the failures of a remote model in mind, and scores of candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.text import norm_word, words
from talkloom.operators.ranking import CRITERIA, highlight_score, parse_scores, tier

KEYS = ["video_id", "cand_no"]


def infer(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 12, tasks: int | None = None, errors: tuple[type[Exception], ...] = (TimeoutError, ConnectionError), text: str | None = None, chars: int = 4000) -> DataFrame:
    """fn over batches of `rows` rows and, where `text` names a column, of `chars` characters of it at most (a row at
    least); it gets and gives a pandas frame. A batch that fails by one of `errors` is halved down to single rows,
    which are tried once more; a row that fails again gives no row, so that missing_ids() names it. Other exceptions
    end the job. `tasks` is the number of calls at a time."""

    def attempt(batch: pd.DataFrame, again: bool = True) -> Iterator[pd.DataFrame]:
        try:
            yield fn(batch)
        except errors:
            if len(batch) > 1:
                half = len(batch) // 2
                yield from attempt(batch.iloc[:half].reset_index(drop=True))
                yield from attempt(batch.iloc[half:].reset_index(drop=True))
            elif again:
                yield from attempt(batch, False)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lo = 0
            sizes = frame[text].fillna("").str.len().tolist() if text else [0] * len(frame)
            while lo < len(frame):
                hi, total = lo + 1, sizes[lo]
                while hi < len(frame) and hi - lo < rows and total + sizes[hi] <= chars:
                    total += sizes[hi]
                    hi += 1
                yield from attempt(frame.iloc[lo:hi].reset_index(drop=True))
                lo = hi

    return (df.repartition(tasks) if tasks else df).mapInPandas(run, schema)


def lexical_scores(text: Column) -> dict[str, Column]:
    """Criteria from the look of a text alone, for tests: columns that need no other row."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = F.size(words(t))
    share = lambda c, of: F.least(F.lit(1.0), c / F.greatest(F.lit(1), of))
    marks = lambda p: F.regexp_count(t, F.lit(p))
    count = lambda *listed: F.size(F.filter(words(t), lambda w: norm_word(w).isin(*listed)))
    return {
        "completeness_arc": F.when(t.rlike("[.!?]$"), 0.5).otherwise(0.0) + 0.5 * share(n, F.lit(60)),
        "surprise_novelty": share(marks("!") * 10, n),
        "hook_quality": share(marks(r"\?") * 10, n),
        "personal_connection": share(count("i", "you", "we", "my", "your", "our") * 5, n),
        "specificity_score": share(marks("[0-9]+") * 5, n),
        "actionability_score": share(count("do", "make", "try", "use", "start", "stop") * 10, n),
        "clarity_simplicity": 1.0 - share(F.greatest(F.lit(0), F.char_length(t) - 6 * n), F.lit(600)),
    }


def corpus_scores(cands: DataFrame, opening: int = 12) -> DataFrame:
    """Adds the criteria as statistics of all candidates give them, where no model is at hand.

    A word's rarity is ln(N / its candidates) / ln(N), from 0 (said in each of the N candidates) to 1 (in one).
    specificity_score is the mean rarity of a candidate's words, hook_quality that of its first `opening` ones;
    surprise_novelty is the part of its distinct words, weighed by rarity, that no earlier candidate of the recording
    has, and personal_connection the part that others of the recording have as well; completeness_arc counts a closed end
    and its length against the mean one, half each; clarity_simplicity is 1 at no letters, a half at the mean length of
    words, 0 at twice that. No statistic speaks for actionability_score: 0.5, as of a reply without it.

    Words are counted with map-side combine before any shuffle; a word that all recordings hold meets them in the tasks
    that its recordings are spread over by AQE, or by a broadcast."""
    said = cands.select(*KEYS, F.posexplode(words(F.lower(F.coalesce("text", F.lit(""))))).alias("at", "raw")).select(*KEYS, "at", norm_word(F.col("raw")).alias("w")).filter("w <> ''")
    terms = said.groupBy(*KEYS, "w").agg(F.count("*").alias("k"), F.count_if(F.col("at") < opening).alias("k_open"))
    own = terms.groupBy("video_id", "w").agg(F.min("cand_no").alias("first"), F.count("*").alias("held"))
    corpus = own.groupBy("w").agg(F.sum("held").alias("df"))
    total = cands.agg(F.count("*").alias("N"))  # one row
    rarity = F.when(F.col("N") > 1, F.log(F.col("N") / F.col("df")) / F.log("N")).otherwise(0.0)
    # The distinct words of a recording go to the counts and come back; what its candidates say stays where it is.
    rated = own.join(corpus, "w").crossJoin(F.broadcast(total)).select("video_id", "w", "first", "held", rarity.alias("r"))
    known = terms.join(rated, ["video_id", "w"])
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    summed = known.groupBy(*KEYS).agg(
        ratio(F.sum(F.col("k") * F.col("r")), F.sum("k").cast("double")).alias("specificity_score"),
        ratio(F.sum(F.col("k_open") * F.col("r")), F.sum("k_open").cast("double")).alias("hook_quality"),
        ratio(F.sum(F.when(F.col("first") == F.col("cand_no"), F.col("r")).otherwise(0.0)), F.sum("r")).alias("surprise_novelty"),
        ratio(F.sum(F.when(F.col("held") > 1, F.col("r")).otherwise(0.0)), F.sum("r")).alias("personal_connection"),
        F.sum("k").alias("n"), F.sum(F.col("k") * F.char_length("w")).alias("letters"),
    )
    means = summed.agg(F.avg("n").alias("mean_n"), (F.sum("letters") / F.sum("n")).alias("mean_letters"))  # one row
    stats = summed.crossJoin(F.broadcast(means))
    stats = stats.withColumns({
        "long": 0.5 * F.least(F.lit(1.0), F.col("n") / F.col("mean_n")),
        "clarity_simplicity": F.greatest(F.lit(0.0), 1 - F.col("letters") / F.col("n") / F.col("mean_letters") / 2),
    })
    # As one column, so that the candidates' own names meet no other.
    rows = cands.join(stats.select(*KEYS, F.struct(*[c for c in stats.columns if c not in KEYS]).alias("_stats")), KEYS, "left")
    ends = F.when(F.trim(F.coalesce(F.col("text"), F.lit(""))).rlike("[.!?]$"), 0.5).otherwise(0.0)
    made = {"completeness_arc": ends + F.col("_stats.long"), "actionability_score": F.lit(0.5)}
    return rows.withColumns({c: F.round(F.coalesce(made[c] if c in made else F.col(f"_stats.{c}"), F.lit(0.0)), 6) for c in CRITERIA}).drop("_stats")


def score_candidates(cands: DataFrame, scorer: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """Adds the criteria, needs_previous_context, needs_next_context, score and tier. The criteria are corpus_scores(), or
    what `scorer` makes of the text as columns; a candidate that begins in lower case needs what is before it, one
    without a mark at its end what follows."""
    t = F.trim(F.coalesce("text", F.lit("")))
    made = scorer(F.col("text")) if scorer else None
    rows = cands.withColumns({c: F.round(made[c].cast("double"), 6) for c in CRITERIA}) if made else corpus_scores(cands)
    rows = rows.withColumns({"needs_previous_context": t.rlike("^[a-zа-яё]"), "needs_next_context": ~t.rlike("[.!?]$")})
    score = highlight_score({c: F.col(c) for c in CRITERIA}, F.col("needs_previous_context"), F.col("needs_next_context"))
    return rows.withColumn("score", score).withColumn("tier", tier(F.col("score")))


def score_with_model(cands: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], **how) -> DataFrame:
    """Scores from a model's JSON replies: model gets batches (video_id, cand_no, text) and gives video_id, cand_no and
    raw. Replies are read by parse_scores(), which has a default for whatever is missing; so have candidates without
    a reply. `how` goes to infer()."""
    replies = infer(cands.select(*KEYS, "text"), model, "video_id long, cand_no long, raw string", text="text", **how)
    rows = cands.join(replies, KEYS, "left").withColumn("s", parse_scores(F.coalesce("raw", F.lit("")))).drop("raw")
    score = highlight_score({c: F.col(f"s.{c}") for c in CRITERIA}, F.col("s.needs_previous_context"), F.col("s.needs_next_context"))
    return rows.select(*cands.columns, "s.*", score.alias("score")).withColumn("tier", tier(F.col("score")))
