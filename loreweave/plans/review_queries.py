"""Queries of spaced repetition over the event log."""

from __future__ import annotations

from ..operators import review
from ..sources.tables import review_log

NOW = "2024-01-20 12:00:00"
FIRST_DAY = "2024-01-02 12:00:00"


def fsrs_schedule(spark, sf_dir):
    return review.fsrs_fold(review_log(spark, sf_dir))


def per_card_elapsed(spark, sf_dir):
    return review.elapsed(review_log(spark, sf_dir))


def streak(spark, sf_dir):
    return review.streaks(review_log(spark, sf_dir))


def review_stats(spark, sf_dir):
    return review.review_stats(review_log(spark, sf_dir), NOW)


def forecast7(spark, sf_dir):
    return review.forecast(fsrs_schedule(spark, sf_dir))


def log_cap(spark, sf_dir):
    return review.log_cap(review_log(spark, sf_dir).selectExpr("card_id", "at", "rating", "seq"))


def fsrs_preview(spark, sf_dir):
    return review.preview(fsrs_schedule(spark, sf_dir))


def undo_answer(spark, sf_dir):
    log = review_log(spark, sf_dir)
    return review.undo_answer(log, log.where("rating = 1"))


def introduced_today(spark, sf_dir):
    log = review_log(spark, sf_dir)
    return review.introduced(log, FIRST_DAY)


def _grown(stability: str, difficulty: str, rating: str, days: str) -> str:
    """The stability after an answer, written from the published formulas and weights, apart from the engine's own."""
    recall = f"pow(1 + 19.0::double / 81 * greatest(0, {days}) / greatest(0.01, {stability}), -0.5)"
    return f"""least(36500, greatest(0.01, case when {days} < 1 then {stability} * exp(0.51655 * ({rating} - 3 + 0.6621))
      when {rating} = 1 then least(1.9395 * pow({difficulty}, -0.11) * (pow({stability} + 1, 0.29605) - 1) * exp(2.2698 * (1 - {recall})), {stability} / exp(0.51655 * 0.6621))
      else {stability} * (1 + exp(1.54575) * (11 - {difficulty}) * pow({stability}, -0.1192) * (exp(1.01925 * (1 - {recall})) - 1) * case {rating} when 2 then 0.2315 when 4 then 2.9898 else 1 end) end))::double"""


#: At a recall of nine tenths a card is due after as many days as its stability has.
DUE = "least(36500, greatest(1, floor(s + 0.5)))::int"


LOG = """log as (select user_id as card_id, ts::timestamp as "at", case event_type when 'error' then 1 when 'view' then 2 when 'click' then 3 else 4 end::int as rating,
  event_id as seq from events)"""


def _fold() -> str:
    days = """(date_diff('microsecond', f."at", x."at") / 86400000000.0)::double"""
    harder = "least(10, greatest(1, 0.0046 * (7.1949 - exp(0.5345 * 3) + 1) + 0.9954 * (f.d - 1.4604 * (x.rating - 3) * (10 - f.d) / 9)))::double"
    return f"""o as (select *, row_number() over (partition by card_id order by "at", seq) k from log),
    f as (select card_id, k, "at", 0 lapses, (case rating when 1 then 0.40255 when 2 then 1.18385 when 3 then 3.173 else 15.69105 end)::double s, least(10, greatest(1, 7.1949 - exp(0.5345 * (rating - 1)) + 1))::double d from o where k = 1
      union all select x.card_id, x.k, x."at", f.lapses + (x.rating = 1)::int, {_grown('f.s', 'f.d', 'x.rating', days)}, {harder} from f join o x on x.card_id = f.card_id and x.k = f.k + 1),
    st as (select card_id, k::int reps, lapses::int lapses, s, d, {DUE} due_in from f qualify k = max(k) over (partition by card_id))"""


WITH = f"with recursive {LOG}"
QUERIES = {f.__name__: f for f in (fsrs_schedule, per_card_elapsed, streak, review_stats, forecast7, log_cap, fsrs_preview, undo_answer, introduced_today)}
SQL = {
    "fsrs_schedule": f"{WITH}, {_fold()} select card_id, reps, lapses, round(s, 6) stability, round(d, 6) difficulty, due_in from st",
    "per_card_elapsed": f"""{WITH} select card_id, seq, round(date_diff('microsecond', lag("at") over (partition by card_id order by "at", seq), "at") / 86400000000.0, 3) elapsed_days from log""",
    "streak": f"""{WITH}, d as (select distinct card_id, ("at" - interval 4 hour)::date d from log),
      i as (select *, d - (row_number() over (partition by card_id order by d))::int isl from d)
      select card_id, min(d) first_day, max(d) last_day, count(*) as days from i group by card_id, isl""",
    "review_stats": f"""{WITH} select count(*) answers, count(distinct card_id) cards, count(*) filter (("at" - interval 4 hour)::date = date '2024-01-20') today,
      round(avg(case when "at" > timestamp '{NOW}' - interval 30 day and "at" <= timestamp '{NOW}' then (rating > 1)::int::double end), 6) retention from log""",
    "forecast7": f"""{WITH}, {_fold()} select t.day::int as day, count(due_in) due from range(7) t(day) left join st on greatest(0, due_in) = t.day group by 1""",
    "log_cap": f"""{WITH} select * from log order by "at" desc, seq desc limit 5000""",
    "fsrs_preview": f"""{WITH}, {_fold()}, p as (select card_id, g rating, {_grown('round(s, 6)', 'round(d, 6)', 'g', '1.0::double')} s from st, (values (1), (2), (3), (4)) v(g))
      select card_id, rating, round(s, 6) stability, {DUE} due_in from p""",
    "introduced_today": f"""{WITH} select count(*) filter ((a - interval 4 hour)::date = date '2024-01-02') introduced from (select min("at") a from log group by card_id)""",
    "undo_answer": f"""{WITH} select card_id, seq, "at", rating from log where rating <> 1""",
}
