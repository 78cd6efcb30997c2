"""Bounds of what workers remember, words that a weaker hash would confuse, ids that come again."""

import random

import numpy as np
import pytest

from inkveil.llm import near, toxic


def thue_morse(size: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(size))


def test_words_with_equal_polynomials_modulo_a_power_of_two_differ(spark):
    word = thue_morse(4096)
    other = word.translate(str.maketrans("ab", "ba"))
    assert near.Hasher().words(word)[0] != near.Hasher().words(other)[0]
    rows = near.near_duplicates(spark.createDataFrame([(1, word), (2, other), (3, word.upper())], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {1: 1, 2: 2, 3: 1}


def test_hashes_of_words_do_not_depend_on_their_place():
    hasher, chance = near.Hasher(), random.Random(1)
    words = ["".join(chance.choices("aBcé漢", k=chance.randrange(1, 12))) for _ in range(3000)]
    found = hasher.words(" ".join(words))
    assert np.array_equal(found, np.concatenate([near.Hasher().words(w) for w in words]))
    lower = [w.replace("B", "b") for w in words]
    assert len(set(found.tolist())) == len(set(lower))


@pytest.mark.parametrize("again", [[], [(1, "x y z u v w", "p"), (3, "other words that stand alone here", "q")]])
def test_one_row_of_each_group_stays(spark, again):
    rows = [(1, "x y z u v w", "p"), (2, "X y z u v w", "p"), (3, "other words that stand alone here", "q"), (None, "x y z u v w", "r"), (None, None, "r")]
    kept = near.keep_one(spark.createDataFrame(rows + again, "doc_id long, text string, near_again string")).collect()
    assert sorted((r["doc_id"] for r in kept if r["doc_id"] is not None)) == [1, 3]
    assert sum(r["doc_id"] is None for r in kept) == 2 and {r["near_again"] for r in kept} == {"p", "q", "r"}


def test_scorer_forgets_within_its_bound(monkeypatch):
    chance = random.Random(3)
    rows = [(i % 2, ["idiot" if i % 2 else "friend", *("".join(chance.choices("abcdefgh", k=6)) for _ in range(8))]) for i in range(400)]
    model = toxic.fit(rows)
    texts = [" ".join("".join(chance.choices("abcdefghi", k=7)) for _ in range(40)) + " idiot" * (i % 3 == 0) for i in range(120)] + ["", None]
    wanted = [*toxic.Scorer(model).scores(texts)]
    for name, value in (("TOGETHER", 700), ("PORTION", 13), ("REMEMBERED", 9000)):
        monkeypatch.setattr(toxic, name, value)
    scorer = toxic.Scorer(model)
    got = []
    for score in scorer.scores(texts):
        got.append(score)
        assert scorer.held <= 9000
    assert np.allclose(got, wanted)


def brute_force(sets: list[set]) -> dict[int, int]:
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return dict(enumerate(root))


@pytest.mark.parametrize("block, common", [(256, 3), (4, 1), (256, 10**6)])
def test_variants_of_one_text_are_not_compared_with_each_other(spark, monkeypatch, block, common):
    """Many texts around a much-copied one: those that are no links are few candidates, those that are links are found."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "COMMON", common, raising=False)
    monkeypatch.setattr(near, "COMMON_SHARE", 1, raising=False)
    chance = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    texts = [base, *(base[:k] for k in (149, 120, 114, 112, 90, 84, 70, 4, 3) if common != 3)]
    for i in range(140):
        text = list(base)
        for k in chance.sample(range(150), chance.choice((2, 3, 9, 10, 11))):
            text[k] = f"x{i}y{k}"
        texts += [text, [*text[:-3], f"z{i}"]] if i % 20 == 0 else [text]
    chance.shuffle(texts)
    asked, verified = [], near._verified
    monkeypatch.setattr(near, "_verified", lambda pairs, *tables: asked.append(pairs.count()) or verified(pairs, *tables))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    assert {r.doc_id: r.component_id for r in near.near_duplicates(docs).collect()} == brute_force(sets)
    if common == 3:
        assert asked[1] < 3 * len(texts)


def test_sets_that_may_link_share_a_value_of_their_prefixes(spark, monkeypatch):
    """Each linked pair of nodes in different components is a candidate, whatever is marked as common."""
    monkeypatch.setattr(near, "COMMON_SHARE", 2)
    chance = random.Random(8)
    texts = []
    for _ in range(30):
        text = [f"v{chance.randrange(60)}" for _ in range(chance.choice((1, 4, 6, 9, 30, 60)))]
        texts.append(text)
        for _ in range(4):
            near_it = list(text)
            near_it[chance.randrange(len(text))] = "new"
            texts.append(near_it[chance.randrange(3) :] or text)
    sets = [frozenset(tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))) for t in texts]
    linked = {(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(linked) > 50
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node long, text string")
    alone = spark.createDataFrame([(i, i, 1) for i in range(len(texts))], "node long, component long, weight long")
    assert linked <= {tuple(r) for r in near.across(alone, rows).collect()}
