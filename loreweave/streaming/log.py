"""The update log as a stream: state that follows the log, and counts that close with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import vault
from ..operators.review import DAY_HOUR


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """Last writer wins over a stream: one row of state a key.  Write it in update or complete mode."""
    return vault.latest(log, key, *order)


def daily_answers(log: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, answers, cards): answers (card_id, at) of each review day, and about how many cards they were for.

    Days begin at the review hour.  A day is given out, in append mode, once the watermark has passed its
    end; answers that come later than ``late`` are left out of it.
    """
    day = F.window("at", "1 day", startTime=f"{DAY_HOUR} hours")
    counted = log.withWatermark("at", late).groupBy(day.alias("w")).agg(F.count("*").alias("answers"), F.approx_count_distinct("card_id").alias("cards"))
    return counted.select(F.to_date("w.start").alias("day"), "answers", "cards")
