"""Spaced repetition: the FSRS fold over review logs, queues and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The FSRS-5 weights and its forgetting curve.
W = [0.40255, 1.18385, 3.173, 15.69105, 7.1949, 0.5345, 1.4604, 0.0046, 1.54575, 0.1192, 1.01925, 1.9395, 0.11, 0.29605, 2.2698, 0.2315, 2.9898, 0.51655, 0.6621]
DECAY, FACTOR = -0.5, 19 / 81
DAY_HOUR = 4


def review_day(at) -> F.Column:
    """The logical day of an answer: it begins at four in the morning."""
    return F.to_date(F.col(at) - F.expr(f"interval {DAY_HOUR} hours"))


def _d(x: float) -> str:
    return f"{x!r}D"


def retrievability(elapsed: str, stability: str) -> str:
    """SQL for the chance of recall after ``elapsed`` days."""
    return f"pow(1 + {_d(FACTOR)} * greatest(0D, {elapsed}) / greatest({stability}, 0.01D), {_d(DECAY)})"


def init_stability(g: str) -> str:
    return f"greatest(element_at(array({', '.join(map(_d, W[:4]))}), {g}), 0.01D)"


def clamp_d(x: str) -> str:
    return f"least(10D, greatest(1D, {x}))"


def clamp_s(x: str) -> str:
    return f"least(36500D, greatest(0.01D, {x}))"


def raw_difficulty(g: str) -> str:
    return f"({_d(W[4])} - exp({_d(W[5])} * ({g} - 1)) + 1)"


def next_difficulty(d: str, g: str) -> str:
    return clamp_d(f"{_d(W[7])} * {raw_difficulty('4')} + (1 - {_d(W[7])}) * ({d} - {_d(W[6])} * ({g} - 3) * (10 - {d}) / 9)")


def next_stability(s: str, d: str, g: str, days: str) -> str:
    """SQL for the stability after an answer: the same day, forgotten, or recalled."""
    r = retrievability(days, s)
    same = f"{s} * exp({_d(W[17])} * ({g} - 3 + {_d(W[18])}))"
    forgot = f"least({_d(W[11])} * pow({d}, -{_d(W[12])}) * (pow({s} + 1, {_d(W[13])}) - 1) * exp({_d(W[14])} * (1 - {r})), {s} / exp({_d(W[17])} * {_d(W[18])}))"
    recalled = f"{s} * (1 + exp({_d(W[8])}) * (11 - {d}) * pow({s}, -{_d(W[9])}) * (exp({_d(W[10])} * (1 - {r})) - 1) * case {g} when 2 then {_d(W[15])} when 4 then {_d(W[16])} else 1D end)"
    return clamp_s(f"case when {days} < 1 then {same} when {g} = 1 then {forgot} else {recalled} end")


def interval(s: str, retention: float = 0.9, longest: int = 36500) -> str:
    """SQL for the days until recall falls to ``retention``."""
    return f"cast(least({longest}, greatest(1, floor({s} / {_d(FACTOR)} * (pow({_d(retention)}, {_d(1 / DECAY)}) - 1) + 0.5))) as int)"


def fsrs_fold(log: DataFrame) -> DataFrame:
    """(card_id, reps, lapses, stability, difficulty, due_in): each card's memory state after all its answers.

    The answers of a card are gathered (a card has few) and folded in order; fuzz is
    off.  A lapse is an Again after the first answer.
    """
    step = (
        "named_struct('n', a.n + 1, 'lapses', a.lapses + if(a.n > 0 and x.rating = 1, 1, 0), "
        f"'s', if(a.n = 0, {init_stability('x.rating')}, {next_stability('a.s', 'a.d', 'x.rating', '((unix_micros(x.at) - a.last) / 86400000000D)')}), "
        f"'d', if(a.n = 0, {clamp_d(raw_difficulty('x.rating'))}, {next_difficulty('a.d', 'x.rating')}), 'last', unix_micros(x.at))"
    )
    start = "named_struct('n', 0, 'lapses', 0, 's', 0D, 'd', 0D, 'last', 0L)"
    folded = log.groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "rating"))).alias("log")).withColumn("m", F.expr(f"aggregate(log, {start}, (a, x) -> {step})"))
    return folded.select("card_id", F.col("m.n").alias("reps"), F.col("m.lapses").alias("lapses"), F.round("m.s", 6).alias("stability"), F.round("m.d", 6).alias("difficulty"), F.expr(interval("m.s")).alias("due_in"))


def elapsed(log: DataFrame) -> DataFrame:
    """(card_id, seq, elapsed_days): days since the card's answer before, to three decimals."""
    before = F.lag("at").over(Window.partitionBy("card_id").orderBy("at", "seq"))
    days = (F.unix_micros("at") - F.unix_micros(before)) / 86400000000.0
    return log.select("card_id", "seq", F.round(days, 3).alias("elapsed_days"))


def streaks(log: DataFrame) -> DataFrame:
    """(card_id, first_day, last_day, days): runs of review days without a gap."""
    days = log.select("card_id", review_day("at").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("card_id").orderBy("day")))
    return (
        days.withColumn("island", island)
        .groupBy("card_id", "island")
        .agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))
        .drop("island")
    )


def review_stats(log: DataFrame, now: str) -> DataFrame:
    """One row: answers, cards, answers of today, and the share of other answers than Again in the last 30 days."""
    at = F.to_timestamp(F.lit(now))
    recent = (F.col("at") > at - F.expr("interval 30 days")) & (F.col("at") <= at)
    today = review_day("at") == F.to_date(at - F.expr(f"interval {DAY_HOUR} hours"))
    return log.agg(
        F.count("*").alias("answers"),
        F.countDistinct("card_id").alias("cards"),
        F.count_if(today).alias("today"),
        F.round(F.avg(F.when(recent, (F.col("rating") > 1).cast("double"))), 6).alias("retention"),
    )


def forecast(states: DataFrame, days: int = 7) -> DataFrame:
    """(day, due): cards due on each of the next days, overdue ones on the first; later ones are left out."""
    spark = states.sparkSession
    counted = states.select(F.greatest(F.lit(0), "due_in").alias("day")).where(F.col("day") < days).groupBy("day").agg(F.count("*").alias("due"))
    return spark.range(days).select(F.col("id").cast("int").alias("day")).join(counted, "day", "left").select("day", F.coalesce("due", F.lit(0)).cast("long").alias("due"))


def log_cap(log: DataFrame, cap: int = 5000) -> DataFrame:
    """The newest answers; the cap is the log's own."""
    return log.orderBy(F.desc("at"), F.desc("seq")).limit(cap)


def preview(states: DataFrame, days: float = 1.0) -> DataFrame:
    """(card_id, rating, stability, due_in): the four outcomes of an answer now, without a change of state."""
    each = states.select("card_id", "stability", "difficulty", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("rating"))
    grown = each.withColumn("s", F.expr(next_stability("stability", "difficulty", "rating", _d(days))))
    return grown.select("card_id", "rating", F.round("s", 6).alias("stability"), F.expr(interval("s")).alias("due_in"))


def undo_answer(log: DataFrame, undone: DataFrame) -> DataFrame:
    """The log without the answers (card_id, seq) that were taken back."""
    return log.join(undone.select("card_id", "seq"), ["card_id", "seq"], "left_anti")


def introduced(log: DataFrame, now: str) -> DataFrame:
    """One row: the cards whose first answer lies in the review day of ``now``; they use up the day's new cards."""
    today = F.to_date(F.to_timestamp(F.lit(now)) - F.expr(f"interval {DAY_HOUR} hours"))
    first = log.groupBy("card_id").agg(F.min("at").alias("at"))
    return first.agg(F.count_if(review_day("at") == today).alias("introduced"))
