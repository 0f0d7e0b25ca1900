"""The counterfactual penalty covers beginnings and their counts."""

import pyarrow.parquet as pq
import pytest

from geomosaic.llm import toxicity

GROUPS = (("muslim", "hindu"),)


def gap(model):
    return abs(model.logit({"the", "muslim", "spoke"}) - model.logit({"the", "hindu", "spoke"}))


def test_beginnings_can_not_take_a_terms_weight():
    names = sorted(toxicity.features_of({"muslim"}) | toxicity.features_of({"hindu"}))
    rows = [([names.index(f) for f in sorted(toxicity.features_of({w}))], y, 1.0) for w, y in [("muslim", 1), ("hindu", 0)] for _ in range(200)]
    assert gap(toxicity.fit(rows, names, GROUPS, counterfactual=0.0)) > 4
    assert gap(toxicity.fit(rows, names, GROUPS, counterfactual=100.0)) < 0.05


def test_train_hands_over_the_words_beside_a_term(spark):
    texts = [f"the {'muslim' if i % 2 else 'hindu'} muslimah spoke n{chr(97 + i % 26)}{chr(97 + i // 26)} word" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    seen = {}
    fit, toxicity.fit = toxicity.fit, lambda *a, **k: seen.update(k) or fit(*a, **k)
    try:
        toxicity.train(spark, docs, labels, toxicity.fold(3) >= 0, GROUPS)
    finally:
        toxicity.fit = fit
    assert {frozenset(x) for x in seen["near"]} == {frozenset({"muslim", "muslimah"}), frozenset({"hindu", "muslimah"})}
    assert set(seen["frames"]) == {"muslim", "hindu", None}


@pytest.mark.parametrize("near", [None, [["muslim", "muslimah"], ["hindu", "muslimah"]]])
def test_rows_without_words_pass(near):
    assert toxicity.fit([([0], 1, 1.0), ([], 0, 1.0)], ["muslim"], GROUPS, near=near).weights.keys() == {"muslim"}


def test_the_penalty_closes_the_gap_on_the_corpus(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts = [t for t in pq.read_table(f"{d}/documents.parquet", columns=["text"])["text"].to_pylist() if t][:60]
    off, on = (toxicity.train(spark, docs, labels, toxicity.fold(3) != 1, counterfactual=c) for c in (0.0, 1.0))
    gaps = [toxicity.identity_gap(m, texts) for m in (off, on)]
    assert gaps[1] < 0.01 and gaps[0] > 3 * gaps[1], gaps


def test_neutral_mentions_of_an_attacked_group():
    """Insults that often name one group: without the penalty its neutral mention scores high."""
    names, rows, held = ["insult", "muslim", "hindu"], [], []
    for words, y, n in (({"insult", "muslim"}, 1, 60), ({"muslim"}, 1, 20), ({"insult"}, 1, 5), ({"hindu"}, 0, 60), (set(), 0, 60), ({"muslim"}, 0, 5)):
        rows += [([names.index(w) for w in sorted(words)], y, 1.0)] * n
        held += [sorted(words)] * n
    off, on = (toxicity.fit(rows, names, GROUPS, counterfactual=c, near=held) for c in (0.0, 1.0))
    assert off.score("a muslim spoke") > 0.7 > on.score("a muslim spoke")
    assert abs(on.score("a muslim spoke") - on.score("a hindu spoke")) < 0.1 < abs(off.score("a muslim spoke") - off.score("a hindu spoke"))
    assert on.score("insult") > toxicity.THRESHOLD
