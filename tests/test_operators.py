"""Literal cases of the operators."""

from loreweave.operators import graph, search, vault


def test_boost_ranks_first(spark):
    docs = spark.createDataFrame([(1, "graph theory", 1.0), (2, "graph theory", 3.0), (3, None, 1.0)], "doc_id long, text string, boost double")
    assert [r.doc_id for r in search.bm25_search(docs, ["graph theory"]).orderBy("rank").collect()] == [2, 1]


def test_exchange_of_neighbours_is_one_edit(spark):
    docs = spark.createDataFrame([(1, "bellman equation", 1.0)], "doc_id long, text string, boost double")
    assert search.bm25_search(docs, ["bellmna "]).count() == 1


def test_unknown_word_cuts_the_score(spark):
    docs = spark.createDataFrame([(1, "alpha beta", 1.0)], "doc_id long, text string, boost double")
    whole, part = (search.bm25_search(docs, [q]).first().score for q in ("alpha ", "alpha zzzz "))
    assert abs(part - whole / 2) < 1e-6


def test_backlinks_leave_out_the_page_itself(spark):
    refs = spark.createDataFrame([(1, 0, "rl"), (2, 0, "rl"), (2, 1, "rl")], "page_id long, ord int, norm string")
    names = spark.createDataFrame([("rl", 1)], "norm string, page_id long")
    assert sorted((r.page_id, r.ord) for r in graph.backlinks(refs, names).collect()) == [(2, 0), (2, 1)]


def test_negated_filters_keep_nulls(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "en", "a b")], "id int, type string, text string")
    assert rows.where(~vault.of_type("en")).count() == 1
    assert rows.where(~vault.has_phrase("a b")).count() == 1


def test_concepts_that_may_be_one(spark):
    from loreweave.operators import resolve

    titles = [
        "Reinforcement Learning", "RL", "reinforcement-learning", "Markov Decision Process", "MDPs", "Neural Networks", "neural network", "Bayesian Optimisation",
        "Bayesian Optimization", "GPT-3", "GPT-4", "Deep Reinforcement Learning", "cat", "car", "Learning, Reinforcement",
    ]
    out = resolve.merge_candidates(spark.createDataFrame([(t,) for t in titles], "title string")).collect()
    found = {frozenset((r.a, r.b)): r.reason for r in out}
    pair = lambda a, b: found.get(frozenset((a, b)))
    assert pair("reinforcement-learning", "Reinforcement Learning") == "variant"
    assert pair("RL", "Reinforcement Learning") == "acronym"
    assert pair("MDPs", "Markov Decision Process") == "acronym"
    assert pair("Neural Networks", "neural network") == "variant"
    assert pair("Bayesian Optimization", "Bayesian Optimisation") == "typo"
    assert pair("Learning, Reinforcement", "Reinforcement Learning") == "word-order"
    assert not any({"GPT-3", "GPT-4"} == p or "cat" in p or "Deep Reinforcement Learning" in p for p in found)


def test_jaro_winkler_has_no_boost_threshold():
    from loreweave.operators.resolve import jaro_winkler

    assert round(jaro_winkler("abcdef", "abxyzw"), 4) == 0.6444


def test_memory_model_literals(spark):
    from loreweave.operators import review

    value = lambda sql: spark.sql(f"select {sql}").first()[0]
    assert len(review.W) == 19
    assert abs(value(review.retrievability("10D", "10D")) - 0.9) < 1e-6 and value(review.retrievability("0D", "10D")) == 1
    assert value(review.retrievability("20D", "10D")) < 0.9
    assert abs(value(review.init_stability("1")) - 0.40255) < 1e-9 and abs(value(review.init_stability("4")) - 15.69105) < 1e-9
    hard = [value(review.clamp_d(review.raw_difficulty(str(g)))) for g in (1, 2, 3, 4)]
    assert abs(hard[0] - 7.1949) < 1e-9 and hard == sorted(hard, reverse=True)
    assert [value(review.interval(f"{s}D")) for s in (0.01, 10.2, 10.6, 90000)] == [1, 10, 11, 36500]


def test_merge_candidates_equal_all_pairs(spark):
    """Blocking loses no pair that scores enough: the operator against itself over every pair of titles, two at a time."""
    import itertools

    from loreweave.operators import resolve

    titles = ["Neural Network", "Network, Neural", "NN", "GPT-3", "GPT-4"]
    show = lambda ts: {(frozenset((r.a, r.b)), r.reason) for r in resolve.merge_candidates(spark.createDataFrame([(t,) for t in ts], "title string")).collect()}
    alone = set().union(*(show(p) for p in itertools.combinations(titles, 2)))
    assert {p for p, _ in show(titles)} == {p for p, _ in alone}


def test_a_stored_index_gives_the_same_hits(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"alpha {'beta ' * (k % 3)} Gämma{k % 5} 1", 1.0) for k in range(30)], "doc_id long, text string, boost double")
    search.write_index(docs, str(tmp_path))
    asked = ["alpha bet", "gamma3 zzz"]
    hits = lambda df: sorted(map(tuple, df.collect()))
    assert hits(search.search_index(*search.read_index(spark, str(tmp_path)), asked)) == hits(search.bm25_search(docs, asked))


CONCEPTS = [
    "Reinforcement Learning", "RL", "reinforcement-learning", "Markov Decision Process", "MDPs", "Neural Networks", "neural network", "Bayesian Optimisation", "Bayesian Optimization", "GPT-3", "GPT-4",
    "Deep Reinforcement Learning", "cat", "car", "Learning, Reinforcement", "Variational Autoencoders", "Autoencoder variationl",
]


def test_concepts_that_may_be_the_same(spark):
    from loreweave.operators import resolve

    found = {(frozenset((r.a, r.b)), r.reason): r.score for r in resolve.merge_candidates(spark.createDataFrame([(t,) for t in CONCEPTS], "title string")).collect()}
    for a, b, reason in (
        ("reinforcement-learning", "Reinforcement Learning", "variant"), ("RL", "Reinforcement Learning", "acronym"), ("MDPs", "Markov Decision Process", "acronym"), ("Neural Networks", "neural network", "variant"),
        ("Bayesian Optimization", "Bayesian Optimisation", "typo"), ("Learning, Reinforcement", "Reinforcement Learning", "word-order"), ("Variational Autoencoders", "Autoencoder variationl", "similar"),
    ):
        assert (frozenset((a, b)), reason) in found, (a, b)
    pairs = {p for p, _ in found}
    assert not {frozenset(("GPT-3", "GPT-4")), frozenset(("cat", "car"))} & pairs and not any("Deep Reinforcement Learning" in p for p in pairs)
    assert found[frozenset(("Variational Autoencoders", "Autoencoder variationl")), "similar"] == 0.88


def test_words_in_common():
    from loreweave.operators.resolve import token_set_similarity

    assert token_set_similarity(["deep", "learning"], ["learning", "deep"]) == 1 and token_set_similarity([], ["a"]) == 0
    assert token_set_similarity(["a", "a"], ["a"]) == 0.5 and token_set_similarity(["network"], ["networks"]) == 1 and token_set_similarity(["cat"], ["car"]) == 0
