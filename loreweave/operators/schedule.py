"""The whole scheduler: learning steps, lapses, leeches and seeded fuzz, as a fold over a log and as state that a stream keeps."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .review import DECAY, FACTOR, W, clamp_d, init_stability, interval, next_difficulty, next_stability, raw_difficulty

MINUTE, DAY = 60_000, 86_400_000
#: From how many days on intervals are spread, to how many, and by what share.
FUZZ = ((2.5, 7.0, 0.15), (7.0, 20.0, 0.1), (20.0, 1e9, 0.05))


@dataclass(frozen=True)
class Options:
    """Settings: steps in minutes, the longest interval in days, and what lapses do."""

    learning: tuple[float, ...] = (1, 10)
    relearning: tuple[float, ...] = (10,)
    retention: float = 0.9
    longest: int = 36500
    fuzz: bool = True
    leech_at: int = 4
    suspend: bool = False


#: A card's state as it is kept; times are milliseconds, ``step`` is null outside of steps.
STATE = (
    "state string, step int, stability double, difficulty double, due long, scheduled_days int, reps int, lapses int, last long, created long, leech boolean, suspended boolean"
)


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def fuzzed(days: str, rand: str, longest: int) -> str:
    """SQL for an interval spread by a number between 0 and 1."""
    delta = "1 + " + " + ".join(f"{share}D * greatest(0D, least({days}, {high}D) - {low}D)" for low, high, share in FUZZ)
    high = f"least(cast(floor({days} + v.delta + 0.5) as int), {longest})"
    low = f"least(greatest(2, cast(floor({days} - v.delta + 0.5) as int)), {high})"
    spread = _let(f"named_struct('delta', {delta})", "v", _let(f"named_struct('lo', {low}, 'hi', {high})", "b", f"cast(floor({rand} * (b.hi - b.lo + 1) + b.lo) as int)"))
    return f"if({days} < 2.5, {days}, {spread})"


def outcome(a: str, rating: str, at: str, card: str, o: Options) -> str:
    """SQL for the state after an answer at ``at`` (milliseconds) to a card in state ``a``."""
    elapsed = f"if({a}.last is null, 0D, greatest(0D, ({at} - {a}.last) / {DAY}D))"
    grown = f"transform(array(1, 2, 3, 4), g -> if({a}.state = 'new' or {a}.stability <= 0, {init_stability('g')}, {next_stability(f'{a}.stability', f'{a}.difficulty', 'g', 'e.days')}))"
    harder = f"if({a}.state = 'new' or {a}.stability <= 0, {clamp_d(raw_difficulty(rating))}, {next_difficulty(f'{a}.difficulty', rating)})"
    rand = scalars.seeded_random(f"concat({card}, '|', {a}.reps, '|', coalesce({a}.last, {a}.created))")
    spread = fuzzed("d", "e.rand", o.longest) if o.fuzz else "d"
    base = f"transform(transform(e.s, s -> {interval('s', o.retention, o.longest)}), d -> {spread})"
    steps = lambda values: "array(" + ", ".join(f"{float(v)}D" for v in values) + ")" if values else "cast(array() as array<double>)"
    # intervals by rating, in order: Hard below Good below Easy
    monotone = (
        f"case when {a}.state = 'review' or size(e.steps) = 0 then {_let('least(i[1], i[2])', 'h', _let('greatest(i[2], h + 1)', 'g', 'array(least(i[0], h), h, g, greatest(i[3], greatest(i[2], 0) + 1, g + 1))'))} "
        "else array(0, 0, i[2], greatest(i[3], i[2] + 1)) end"
    )
    stays = "named_struct('state', {}, 'step', {}, 'delay', cast(round({} * 60000D) as long), 'days', 0)"
    graduates = f"named_struct('state', 'review', 'step', cast(null as int), 'delay', d[{rating} - 1] * {DAY}L, 'days', d[{rating} - 1])"
    learn = f"if({a}.state = 'relearning', 'relearning', 'learning')"
    hard = f"case when e.cur = 0 and size(e.steps) > 1 then (e.steps[0] + e.steps[1]) / 2 when e.cur = 0 then least(e.steps[0] * 1.5D, e.steps[0] + 1440) else e.steps[e.cur] end"
    way = (
        f"case when {a}.state = 'review' and {rating} = 1 and {len(o.relearning)} > 0 then {stays.format(repr('relearning'), '0', steps(o.relearning[:1]) + '[0]')} "
        f"when {a}.state = 'review' or size(e.steps) = 0 then {graduates} when {rating} = 1 then {stays.format(learn, '0', 'e.steps[0]')} when {rating} = 2 then {stays.format(learn, 'e.cur', hard)} "
        f"when {rating} = 3 and e.cur + 1 < size(e.steps) then {stays.format(learn, 'e.cur + 1', 'e.steps[e.cur + 1]')} else {graduates} end"
    )
    own = f"if({a}.state = 'relearning', {steps(o.relearning)}, {steps(o.learning)})"
    lapse = f"if({a}.state = 'review' and {rating} = 1, 1, 0)"
    turned = f"({lapse} = 1 and {a}.lapses + 1 >= {o.leech_at})"
    made = (
        f"named_struct('state', w.state, 'step', w.step, 'stability', e.s[{rating} - 1], 'difficulty', {harder}, 'due', {at} + w.delay, 'scheduled_days', w.days, 'reps', {a}.reps + 1, "
        f"'lapses', {a}.lapses + {lapse}, 'last', {at}, 'created', {a}.created, 'leech', {a}.leech or {turned}, 'suspended', {a}.suspended or ({turned} and {str(o.suspend).lower()}))"
    )
    known = f"named_struct('days', {elapsed}, 'rand', {rand if o.fuzz else '0D'}, 'steps', {own}, 'cur', if({a}.state = 'new', 0, least(greatest(coalesce({a}.step, 0), 0), greatest(size({own}) - 1, 0))))"
    whole = f"named_struct('days', e.days, 'rand', e.rand, 'steps', e.steps, 'cur', e.cur, 's', {grown})"
    return _let(known, "e", _let(whole, "e", _let(base, "i", _let(monotone, "d", _let(way, "w", made)))))


def fold(log: DataFrame, options: Options = Options()) -> DataFrame:
    """(card_id, state, step, stability, difficulty, due, ...): each card after all its answers (card_id, at, seq, rating), in order.

    A card is new at its first answer unless ``log`` has ``created_at``.  A card's answers are few and are gathered.
    """
    created = F.min("created_at") if "created_at" in log.columns else F.min("at")
    each = log.groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "rating"))).alias("log"), F.unix_millis(created).alias("created"))
    fields = [f.split() for f in STATE.split(", ")]
    first = {"state": "'new'", "stability": "0D", "difficulty": "0D", "scheduled_days": "0", "reps": "0", "lapses": "0", "created": "created", "leech": "false", "suspended": "false", "due": "created"}
    start = "named_struct(" + ", ".join(f"'{n}', cast({first.get(n, 'null')} as {t})" for n, t in fields) + ")"
    step = outcome("a", "x.rating", "unix_millis(x.at)", "string(card_id)", options)
    done = each.withColumn("c", F.expr(f"aggregate(log, {start}, (a, x) -> {step})"))
    return done.select("card_id", "c.*").withColumns({"due": F.timestamp_millis("due"), "last": F.timestamp_millis("last"), "stability": F.round("stability", 6), "difficulty": F.round("difficulty", 6)}).drop("created")


def previews(cards: DataFrame, now: str, options: Options = Options()) -> DataFrame:
    """(card_id, rating, state, due): what each answer at ``now`` would do to cards as ``fold`` gives them, with ``created_at``."""
    kept = ", ".join(f"'{n}', {'unix_millis(created_at)' if n == 'created' else f'unix_millis({n})' if n in ('due', 'last') else n}" for n, _ in (f.split() for f in STATE.split(", ")))
    each = cards.withColumn("a", F.expr(f"named_struct({kept})")).select("card_id", "a", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("rating"))
    after = F.expr(outcome("a", "rating", f"unix_millis(timestamp'{now}')", "string(card_id)", options))
    return each.withColumn("w", after).select("card_id", "rating", "w.state", F.timestamp_millis("w.due").alias("due"))


# ------------------------------------------------------------------ the same, an answer at a time, for a stream's state


@dataclass
class Card:
    state: str = "new"
    step: int | None = None
    stability: float = 0.0
    difficulty: float = 0.0
    due: int = 0
    scheduled_days: int = 0
    reps: int = 0
    lapses: int = 0
    last: int | None = None
    created: int = 0
    leech: bool = False
    suspended: bool = False
    options: Options = field(default=Options(), repr=False)

    def memory(self, rating: int, days: float) -> tuple[float, float]:
        easy = lambda g: W[4] - math.exp(W[5] * (g - 1)) + 1
        if self.state == "new" or self.stability <= 0:
            return max(W[rating - 1], 0.01), min(10, max(1, easy(rating)))
        s, d = self.stability, self.difficulty
        recall = (1 + FACTOR * days / max(s, 0.01)) ** DECAY
        if days < 1:
            grown = s * math.exp(W[17] * (rating - 3 + W[18]))
        elif rating == 1:
            grown = min(W[11] * d ** -W[12] * ((s + 1) ** W[13] - 1) * math.exp(W[14] * (1 - recall)), s / math.exp(W[17] * W[18]))
        else:
            grown = s * (1 + math.exp(W[8]) * (11 - d) * s ** -W[9] * (math.exp(W[10] * (1 - recall)) - 1) * {2: W[15], 4: W[16]}.get(rating, 1))
        harder = W[7] * easy(4) + (1 - W[7]) * (d - W[6] * (rating - 3) * (10 - d) / 9)
        return min(36500, max(0.01, grown)), min(10, max(1, harder))

    def days(self, card: str, memory: list[tuple[float, float]]) -> list[int]:
        """The intervals of the four answers, spread, before they are put in order."""
        o, out = self.options, []
        h = 0x811C9DC5
        for c in f"{card}|{self.reps}|{self.last if self.last is not None else self.created}".encode():
            h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
        t = h + 0x6D2B79F5 & 0xFFFFFFFF
        t = (t ^ t >> 15) * (t | 1) & 0xFFFFFFFF
        t ^= t + (t ^ t >> 7) * (t | 61) & 0xFFFFFFFF
        rand = (t ^ t >> 14) / 2**32
        for s, _ in memory:
            days = min(o.longest, max(1, math.floor(s / FACTOR * (o.retention ** (1 / DECAY) - 1) + 0.5)))
            if o.fuzz and days >= 2.5:
                delta = 1 + sum(share * max(0.0, min(days, high) - low) for low, high, share in FUZZ)
                high = min(math.floor(days + delta + 0.5), o.longest)
                low = min(max(2, math.floor(days - delta + 0.5)), high)
                days = math.floor(rand * (high - low + 1) + low)
            out.append(days)
        return out

    def answer(self, card: str, rating: int, at: int) -> None:
        o, elapsed = self.options, max(0.0, (at - self.last) / DAY) if self.last is not None else 0.0
        memory = [self.memory(g, elapsed) for g in (1, 2, 3, 4)]
        again, hard, good, easy = self.days(card, memory)
        steps = o.relearning if self.state == "relearning" else o.learning
        now, step, delay, review = self.state, None, 0.0, self.state == "review"
        if review or not steps:
            hard = min(hard, good)
            good, easy = max(good, hard + 1), max(easy, good + 1)
            easy, again = max(easy, good + 1), min(again, hard)
        else:
            easy = max(easy, good + 1)
        if review and rating == 1 and o.relearning:
            now, step, delay = "relearning", 0, o.relearning[0]
        elif not review and steps:
            at_step = 0 if now == "new" else min(max(self.step or 0, 0), len(steps) - 1)
            learning = "relearning" if now == "relearning" else "learning"
            if rating == 1:
                now, step, delay = learning, 0, steps[0]
            elif rating == 2:
                delay = steps[at_step] if at_step else (steps[0] + steps[1]) / 2 if len(steps) > 1 else min(steps[0] * 1.5, steps[0] + 1440)
                now, step = learning, at_step
            elif rating == 3 and at_step + 1 < len(steps):
                now, step, delay = learning, at_step + 1, steps[at_step + 1]
        days = 0 if step is not None else (again, hard, good, easy)[rating - 1]
        if review and rating == 1:
            self.lapses += 1
            if self.lapses >= o.leech_at:
                self.leech, self.suspended = True, self.suspended or o.suspend
        (self.stability, self.difficulty), self.reps, self.last = memory[rating - 1], self.reps + 1, at
        self.state, self.step = (now, step) if step is not None else ("review", None)
        self.scheduled_days, self.due = days, at + (round(delay * MINUTE) if step is not None else days * DAY)


def streamed(log: DataFrame, options: Options = Options()) -> DataFrame:
    """The state of each card that a batch of a stream of answers (card_id string, at, seq, rating) has touched, in update mode.

    A batch's answers to a card are taken in order; answers that come in a later batch count after it.
    """
    names = [f.split()[0] for f in STATE.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        times = (rows["at"].astype("datetime64[ms]").astype("int64")).tolist()
        card = Card(**dict(zip(names, kept.get)), options=options) if kept.exists else Card(created=times[0], options=options)
        for at, rating in zip(times, rows["rating"].tolist()):
            card.answer(key[0], int(rating), at)
        now = {k: v for k, v in asdict(card).items() if k in names}
        kept.update(tuple(now[n] for n in names))
        yield pd.DataFrame([{"card_id": key[0], **now}]).astype({"step": "Int32", "last": "Int64"})

    return log.groupBy("card_id").applyInPandasWithState(step, f"card_id string, {STATE}", STATE, "update", "NoTimeout")
