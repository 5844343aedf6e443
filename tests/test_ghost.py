"""Tag suggestions on the literal cases, and against a plain reading on random texts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loreweave.functions.text import STOP_WORDS
from loreweave.operators import ghost, resolve

ABSTRACT = """Proximal Policy Optimization Algorithms.
We propose a new family of policy gradient methods for reinforcement learning, which alternate
between sampling data through interaction with the environment, and optimizing a "surrogate"
objective function using stochastic gradient ascent. Whereas standard policy gradient methods
perform one gradient update per data sample, we propose a novel objective function that enables
multiple epochs of minibatch updates. The new methods, which we call proximal policy optimization
(PPO), have some of the benefits of trust region policy optimization (TRPO), but they are much
simpler to implement, more general, and have better sample complexity (empirically). Our
experiments test PPO on a collection of benchmark tasks, including simulated robotic locomotion
and Atari game playing, and we show that PPO outperforms other online policy gradient methods,
and overall strikes a favorable balance between sample complexity, simplicity, and wall-time.
Unlike value-based RL, the policies are optimised directly."""
CONCEPTS = [
    ("Reinforcement Learning", 48, ["RL"]), ("Policy Gradient", 21, None), ("PPO", 6, None), ("Trust Region Methods", 3, None), ("Sample Efficiency", 4, None), ("Sample Complexity", 2, None),
    ("Robotics", 9, None), ("Atari", 5, None), ("Stochastic Gradient Descent", 11, None), ("Transformers", 30, None), ("Bayesian Inference", 14, None), ("Graph Neural Networks", 8, None),
    ("Learning", 60, None), ("Paper", 200, None), ("flashcard", 90, None), ("Value Function", 7, None), ("Optimisation", 12, None),
]
SCHEMA = "title string, count int, aliases array<string>"


def tags(spark, text, concepts, **kw):
    found = ghost.suggestions(spark.createDataFrame([(1, text)], "doc_id int, text string"), spark.createDataFrame(concepts, SCHEMA), **kw)
    return {r.tag: (r.score, r.rank) for r in found.collect()}


def test_an_abstract(spark):
    found = tags(spark, ABSTRACT, CONCEPTS)
    assert {"Policy Gradient", "Reinforcement Learning", "PPO"} <= {t for t, (_, r) in found.items() if r <= 4}
    assert {"Sample Complexity", "Atari"} <= set(found) and found.get("Learning", (0, 0))[0] < found["Atari"][0]
    assert not {"Transformers", "Bayesian Inference", "Graph Neural Networks", "Paper", "flashcard"} & set(found)
    assert all(0 < s < 1 for s, _ in found.values())
    by_rank = sorted(found.values(), key=lambda v: v[1])
    assert [s for s, _ in by_rank] == sorted((s for s, _ in by_rank), reverse=True)


def test_plurals_accents_typos_and_exclusions(spark):
    concepts = [("Neural Network", 3, None), ("Schrödinger Equation", 2, None), ("Optimisation", 2, None)]
    assert set(tags(spark, "Deep neural networks solve the schrodinger equation via optimization.", concepts)) == {"Neural Network", "Schrödinger Equation", "Optimisation"}
    assert tags(spark, "neural networks", concepts, exclude=("neural networks",)) == {}
    assert tags(spark, "", CONCEPTS) == {} and tags(spark, None, CONCEPTS) == {} and tags(spark, ABSTRACT, []) == {}


def plainly(text, concepts):
    """The same by a loop over forms, word by word."""
    fold = lambda w: w.lower()

    def one(w):
        if w in resolve.IRREGULAR:
            return resolve.IRREGULAR[w]
        if len(w) <= 3 or not w.endswith("s"):
            return w
        if w.endswith("ies") and len(w) > 4:
            return w[:-3] + "y"
        if re.search("(sses|(x|ch|sh|zz)es)$", w):
            return w[:-2]
        return w if re.search("(ss|us|is|ics)$", w) else w[:-1]

    cut = lambda t: re.findall(r"\w+", t)
    hay = [one(fold(w)) for w in cut(text)]
    forms, df = [], {}
    for title, count, aliases in concepts:
        words = set()
        for at, name in enumerate([title, *(aliases or [])]):
            tokens = [fold(w[:-1]) if re.fullmatch("[A-Z0-9]*[A-Z][A-Z0-9]*s", w) and len(w) > 2 else one(fold(w)) for w in cut(name)]
            acronym = re.sub("s$", "", name) if len(tokens) == 1 and re.fullmatch("[A-Z][A-Z0-9]{1,7}s?", name) else None
            forms.append((-len(tokens), title, at, tokens, acronym, count))
            words |= set(tokens)
        for w in words:
            df[w] = df.get(w, 0) + 1
    covered, best = [False] * len(hay), {}
    for _, title, _, tokens, acronym, count in sorted(forms, key=lambda f: f[:3]):
        if all(t in STOP_WORDS for t in tokens) or not acronym and len(tokens) == 1 and len(tokens[0]) < 3:
            continue
        n, quality = len(tokens), 1.0
        if acronym:
            occ = len(re.findall(rf"(?<!\w){acronym}s?(?!\w)", text))
        else:
            at = [i for i in range(len(hay) - n + 1) if hay[i : i + n] == tokens]
            occ = sum(not all(covered[i : i + n]) for i in at)
            if at and not occ:
                occ, quality = len(at), 0.3
            for i in at:
                covered[i : i + n] = [True] * n
            if not occ and n > 1:
                i, quality = 0, 0.6
                while i < len(hay):
                    if hay[i] in tokens and set(tokens) <= set(hay[i : i + n + 2]):
                        occ, i = occ + 1, i + n + 2
                    else:
                        i += 1
            initials = "".join(t[0] for t in tokens if t not in resolve.MINOR).upper()
            if occ and n > 1 and len(initials) > 1:
                occ += len(re.findall(rf"(?<!\w){initials}s?(?!\w)", text))
            if not occ and n == 1 and len(tokens[0]) >= 6:
                t = tokens[0]
                close = lambda w: any(w[:i] + w[i + 1 :] == t[:j] + t[j + 1 :] for i in range(len(w)) for j in {min(i, len(t) - 1)}) and len(w) == len(t) or any(w[:i] + w[i + 1 :] == t for i in range(len(w))) or any(t[:i] + t[i + 1 :] == w for i in range(len(t))) or any(w[:i] + w[i : i + 2][::-1] + w[i + 2 :] == t for i in range(len(w) - 1))
                if hit := next((w for w in hay if len(w) >= 6 and w != t and close(w)), None):
                    occ, quality = hay.count(hit), 0.5
        if occ:
            rare = sum(0 if t in STOP_WORDS else math.log(1 + len(concepts) / df[t]) for t in tokens) / n
            raw = (1 + math.log(occ)) * rare * (1 + 0.25 * (n - 1)) * (1 + 0.3 * math.log1p(count)) * quality
            best[title] = max(best.get(title, 0), raw)
    scored = sorted(((-round(r / (r + 2.5), 3), t) for t, r in best.items() if r / (r + 2.5) >= 0.25))[:8]
    return {t: (-s, i + 1) for i, (s, t) in enumerate(scored)}


@pytest.mark.parametrize("first_words", [1000, 1])
def test_equals_a_plain_reading(spark, monkeypatch, first_words):
    monkeypatch.setattr(ghost, "FIRST_WORDS", first_words)
    rng = random.Random(7)
    words = ["graph", "policy", "policies", "gradient", "kernel", "matrices", "matrix", "signals", "the", "of", "network", "neurals", "entropy", "entropi", "gradeint", "PG", "GKs", "tensor"]
    concepts, seen = [], set()
    while len(concepts) < 25:
        title = " ".join(rng.choice(words).title() for _ in range(rng.choice([1, 1, 2, 2, 3])))
        if title not in seen:
            seen.add(title)
            concepts.append((title, rng.randrange(40), rng.choice([None, [rng.choice(["PG", "GKs", "policy graphs", "kernel of gradient"])]])))
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    found = ghost.suggestions(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(concepts, SCHEMA)).collect()
    for i, text in texts:
        got = {r.tag: (r.score, r.rank) for r in found if r.doc_id == i}
        want = plainly(text, concepts)
        assert {t: r for t, (_, r) in got.items()} == {t: r for t, (_, r) in want.items()} and all(abs(got[t][0] - want[t][0]) < 2e-3 for t in want), text


def test_answers_are_merged(spark):
    texts = spark.createDataFrame([(1, ABSTRACT), (2, ABSTRACT)], "doc_id int, text string")
    concepts = spark.createDataFrame(CONCEPTS, SCHEMA)
    answer = 'Sure! ```json\n["policy gradients", "#Trust Region Methods", "Proximal Policy Optimization", "Paper"]\n```'
    own = ghost.suggestions(texts, concepts, most=16, exclude=("paper",))
    out = ghost.with_answers(own, spark.createDataFrame([(1, answer), (2, "no list")], "doc_id int, answer string"), concepts, most=10, exclude=("paper",)).collect()
    first = {r.tag: r for r in out if r.doc_id == 1}
    assert first["Policy Gradient"].origin == "both" and first["Trust Region Methods"].existing and not first["Proximal Policy Optimization"].existing
    assert first["Proximal Policy Optimization"].origin == "ai" and first["Proximal Policy Optimization"].score == 0.36 and "Paper" not in first
    assert {r.origin for r in out if r.doc_id == 2} == {"graph"}


@pytest.mark.parametrize("answer,expected", [('["a", "#b", "[[c]]", 3, {"tag": "d"}, "bad|x"]', ["a", "b", "c", "d"]), ("no json", []), ("[broken", []), ("[broken]", []), (None, []), ('say ["x"] end', ["x"])])
def test_tag_lists(spark, answer, expected):
    assert spark.createDataFrame([(answer,)], "answer string").select(F.expr(ghost.tag_list("answer"))).first()[0] == expected


@pytest.mark.parametrize(
    "name,expected",
    [("Neural-Networks", "neural network"), ("  Policies ", "policy"), ("Processes", "process"), ("Théorie des Graphes", "theorie des graphe"), ("MDPs", "mdp"), ("Analysis", "analysis"), ("matrices", "matrix"), ("boxes", "box"), ("bias", "bias"), ("Q-Learning", "q learning")],
)
def test_concept_names(spark, name, expected):
    assert spark.createDataFrame([(name,)], "n string").select(F.array_join(F.expr(resolve.concept_tokens("n")), " ")).first()[0] == expected


def test_a_text_is_made_once(spark):
    """Every kind of match reads the texts, but what makes them runs once a row."""
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return f"Policy Gradient {i} and RL"

    texts = spark.range(20).select("id", F.udf(text)("id").alias("text")).withColumnRenamed("id", "doc_id")
    concepts = spark.createDataFrame([("Policy Gradient", 3, ["PG"]), ("Reinforcement Learning", 2, [])], "title string, count int, aliases array<string>")
    assert {r.tag for r in ghost.suggestions(texts, concepts).collect()} >= {"Policy Gradient"}
    assert made.value == 20


def test_equal_texts_are_read_once(spark, monkeypatch):
    """Words are cut and matched for different texts, whatever the number of ids that have them."""
    sizes, held = [], ghost.held

    def counted(df):
        out = held(df)
        sizes.extend([out.count()] if "w" in out.columns else [])
        return out

    monkeypatch.setattr(ghost, "held", counted)
    texts = spark.range(200).selectExpr("id as doc_id", "if(id % 2 = 0, 'Policy Gradient and RL', 'on PPO alone') as text")
    found = ghost.suggestions(texts, spark.createDataFrame(CONCEPTS, SCHEMA)).collect()
    assert sizes == [2] and {r.doc_id for r in found} == set(range(200))


def test_repeated_rows_and_ids_with_several_texts(spark):
    """A row that comes twice counts once, capitals too; an id with several texts has the best of each tag, ranked anew."""
    concepts = spark.createDataFrame(CONCEPTS, SCHEMA)
    rows = [(1, "PPO and Policy Gradient"), (2, "PPO and Policy Gradient"), (2, "PPO and Policy Gradient"), (3, "PPO"), (3, "Policy Gradient, policy gradients"), (3, "PPO and PPO")]
    got = {}
    for r in ghost.suggestions(spark.createDataFrame(rows, "doc_id int, text string"), concepts).collect():
        got.setdefault(r.doc_id, {})[r.tag] = (r.score, r.rank)
    assert got[1] == got[2] and set(got[3]) == {"PPO", "Policy Gradient"}
    alone = {t: tags(spark, t, CONCEPTS) for t in ("Policy Gradient, policy gradients", "PPO and PPO")}
    assert got[3]["PPO"][0] == alone["PPO and PPO"]["PPO"][0] and got[3]["Policy Gradient"][0] == alone["Policy Gradient, policy gradients"]["Policy Gradient"][0]
    assert sorted(rank for _, rank in got[3].values()) == [1, 2]


def test_a_repeated_answer_counts_once(spark):
    """Equal rows are one answer; different answers of an id, and names that an answer repeats, still add up."""
    concepts = spark.createDataFrame(CONCEPTS, SCHEMA)
    own = spark.createDataFrame([(1, "PPO", 0.5), (2, "PPO", 0.5), (3, "PPO", 0.5), (3, "Atari", 0.4)], "doc_id int, tag string, score double")
    rows = [(1, '["PPO", "Nothing Known"]')] * 3 + [(2, '["PPO", "Nothing Known"]'), (4, '["PPO", "ppo"]'), (4, 'also ["PPO"]'), (5, None)]
    out = ghost.with_answers(own, spark.createDataFrame(rows, "doc_id int, answer string"), concepts).collect()
    got = {i: sorted((r.tag, r.score, r.origin, r.existing) for r in out if r.doc_id == i) for i in range(1, 6)}
    assert got[1] == got[2] == [("Nothing Known", 0.38, "ai", False), ("PPO", 0.7, "both", True)]
    assert got[3] == [("Atari", 0.4, "graph", True), ("PPO", 0.5, "graph", True)] and got[4] == [("PPO", 0.95, "both", True)] and not got[5]
