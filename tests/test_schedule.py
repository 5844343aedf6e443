"""The scheduler's fold against its stream and the literal cases; both are written apart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loreweave.operators import schedule
from loreweave.operators.schedule import Card, Options

T0 = dt.datetime(2026, 1, 5, 12)
LOG = "card_id string, at timestamp, seq int, rating int"


def fold(spark, ratings, options=Options(), gaps=None):
    """A card that is answered at its due times, or after the given gaps in days."""
    at, card, rows = T0, Card(created=int(T0.timestamp() * 1000), options=options), []
    ms = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    card.created = ms(T0)
    for i, r in enumerate(ratings):
        rows.append(("b1:1", at, i, r))
        card.answer("b1:1", r, ms(at))
        at = at + dt.timedelta(days=gaps[i]) if gaps else dt.datetime.fromtimestamp(card.due / 1000, dt.timezone.utc).replace(tzinfo=None)
    got = schedule.fold(spark.createDataFrame(rows, LOG), options).first()
    assert (got.state, got.step, got.scheduled_days, got.reps, got.lapses, got.leech, got.suspended) == (card.state, card.step, card.scheduled_days, card.reps, card.lapses, card.leech, card.suspended)
    assert abs(got.stability - card.stability) < 1e-5 and abs(got.difficulty - card.difficulty) < 1e-5
    assert ms(got.due) == card.due
    return got, (got.due - got["last"]).total_seconds()


@pytest.mark.parametrize("rating,state,wait", [(1, "learning", 60), (2, "learning", 330), (3, "learning", 600)])
def test_a_new_card_walks_its_steps(spark, rating, state, wait):
    got, seconds = fold(spark, [rating])
    assert (got.state, seconds) == (state, wait)


def test_a_new_card_that_is_easy_graduates(spark):
    got, seconds = fold(spark, [4])
    assert got.state == "review" and got.step is None and seconds >= 10 * 86400 and abs(got.stability - 15.69105) < 1e-6


def test_steps_lapses_and_leeches(spark):
    got, _ = fold(spark, [3, 3])
    assert got.state == "review" and got.scheduled_days >= 2 and abs(got.stability - 3.173 * 2.718281828 ** (0.51655 * 0.6621)) < 1e-4
    got, seconds = fold(spark, [3, 1])
    assert (got.state, got.step, seconds) == ("learning", 0, 60)
    got, seconds = fold(spark, [4, 1])
    assert (got.state, got.lapses, seconds) == ("relearning", 1, 600)
    assert fold(spark, [4, 1, 3])[0].state == "review"
    got, _ = fold(spark, [4, *[1, 3] * 4], Options(suspend=True))
    assert got.lapses == 4 and got.leech and got.suspended
    assert not fold(spark, [4, *[1, 3] * 3])[0].leech


def test_without_steps_or_fuzz(spark):
    for r in (1, 2, 3, 4):
        assert fold(spark, [r], Options(learning=(), relearning=()))[0].state == "review"
    got, _ = fold(spark, [4, 1], Options(relearning=(), fuzz=False))
    assert got.state == "review" and got.lapses == 1
    assert fold(spark, [3, 2], Options(learning=(5,)))[1] >= 5 * 60
    assert fold(spark, [4, 3, 3, 3], Options(longest=30))[0].scheduled_days <= 31


@pytest.mark.parametrize("seed", range(4))
def test_random_answers(spark, seed):
    rng = random.Random(seed)
    fold(spark, [rng.choice([1, 2, 3, 3, 4]) for _ in range(25)], Options(learning=rng.choice([(1, 10), (1, 5, 15), (3,)]), relearning=rng.choice([(10,), (5, 20), ()]), fuzz=rng.random() < 0.7), gaps=[rng.choice([0.001, 0.5, 1, 3.3, 20, 200]) for _ in range(25)])


def test_previews_are_in_order_and_come_true(spark):
    rows = [(f"c{k}", T0 - dt.timedelta(days=40), 0, 4) for k in range(20)] + [(f"c{k}", T0 - dt.timedelta(days=20), 1, 3) for k in range(10)] + [("n", T0 - dt.timedelta(days=1), 0, 3)]
    log = spark.createDataFrame(rows, LOG)
    cards = schedule.fold(log).join(log.groupBy("card_id").agg(F.min("at").alias("created_at")), "card_id")
    shown = schedule.previews(cards, str(T0)).collect()
    due = {(r.card_id, r.rating): r.due for r in shown}
    for k in range(20):
        assert due[f"c{k}", 1] < due[f"c{k}", 2] < due[f"c{k}", 3] < due[f"c{k}", 4]
    then = schedule.fold(log.unionByName(cards.select("card_id", F.lit(T0).alias("at"), F.lit(9).alias("seq"), F.lit(3).alias("rating")))).collect()
    assert {r.card_id: r.due for r in then} == {c: d for (c, r), d in due.items() if r == 3}


def test_a_stream_keeps_the_same_state(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"c{i % 7}", T0 + dt.timedelta(hours=7 * i), i, rng.choice([1, 2, 3, 3, 4])) for i in range(90)]
    for part in range(3):
        spark.createDataFrame(rows[30 * part : 30 * part + 30], LOG).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    made = []
    for part in range(3):  # a stream that is begun again goes on from its state
        spark.read.parquet(f"{tmp_path}/in/{part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/now")
        stream = spark.readStream.schema(LOG).parquet(f"{tmp_path}/now")
        keep = lambda df, i: made.append({r.card_id: r for r in df.collect()})
        schedule.streamed(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(200)
    last = {k: v for batch in made for k, v in batch.items()}
    folded = {r.card_id: r for r in schedule.fold(spark.createDataFrame(rows, LOG)).withColumn("due", F.unix_millis("due")).collect()}
    assert set(last) == set(folded)
    for k, r in folded.items():
        assert (r.state, r.step, r.due, r.reps, r.lapses, r.leech) == (last[k].state, last[k].step, last[k].due, last[k].reps, last[k].lapses, last[k].leech) and abs(r.stability - last[k].stability) < 1e-5
