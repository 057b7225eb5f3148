from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import subjects as S

TERMS = {"law": ["the appeal court", "legal privilege", "a consent order", "the tribunal", "contract clauses"], "sport": ["the marathon field", "penalty shoot-outs", "the league table", "injury reports", "home advantage"], "weather": ["snow depth", "the drought index", "river gauges", "a heat wave", "hurricane landfall"]}
FRAMES = ["Nobody expected {a} to matter more than {b}.", "No change in {a}; {b} slipped to 4.5.", "Our file on {a} grew to 12 pages, most of it about {b}.", "We still lack a clean reading of {a} around 5 May.", "Please compare {a} with last year's notes on {b}."]
FILLERS = ["Coffee was cold again this morning.", "Thanks to everyone who stayed late.", "The meeting ran over by 12 minutes."]
PASSING = "The room had last been booked for a talk on {a}."


def say(rng, subject, known=5):
    a, b = rng.sample(TERMS[subject][:known], 2)
    return rng.choice(FRAMES).format(a=a, b=b)


def corpus(spark, n=600, seed=1):
    """Documents with their true subjects; one term of each subject is in no example."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        chosen = rng.sample(list(TERMS), rng.choice([1, 1, 2]))
        counts = {s: (rng.randrange(1, 3) if len(chosen) == 1 and rng.random() < 0.3 else rng.randrange(3, 7)) for s in chosen}
        parts = []
        for s in chosen:
            parts += [say(rng, s) for _ in range(counts[s])]
            parts += [rng.choice(FILLERS)] * rng.randrange(3)
        if rng.random() < 0.3:
            parts.append(PASSING.format(a=rng.choice(TERMS[rng.choice(list(TERMS))])))
        rows.append((i, " ".join(parts), rng.choice(["a/x", "b/y", None]), rng.choice(["note", "chat"]), "clash"))
        truth[i] = {s for s, c in counts.items() if c >= 3 or len(chosen) == 1}
    rows += [(9000, None, "a", "note", ""), (9001, "", None, None, ""), (9002, "  \n", "a", "note", ""), (9003, "1,2,3\n4|5|6", "a", "table", ""), (9004, FILLERS[0], "a", "note", "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, doc_kind string, subject string"), truth


def examples(spark, seed=2):
    rng = random.Random(seed)
    rows = [(i, s, "en", " ".join(say(rng, s, 4) for _ in range(4))) for i in range(20) for s in TERMS]
    return spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)] + [(999, None, "en", "x"), (998, "law", "en", None)], "example_id bigint, subject string, lang string, text string")


def test_accuracy_on_known_documents(spark):
    docs, truth = corpus(spark)
    got: dict[int, set] = {}
    for r in S.label_subjects(docs, examples(spark)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == t for i, t in truth.items())
    assert right >= 0.97 * len(truth), right
    assert not set(got) & {9000, 9001, 9002, 9003, 9004}


def test_empty(spark):
    docs, _ = corpus(spark, 3)
    assert S.label_subjects(docs.where("false"), examples(spark)).count() == 0
    assert S.label_subjects(docs, examples(spark).where("false")).count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("It fell to 49.2. Filed next to it. Done (see page 4). Next one.", ["It fell to 49.2.", "Filed next to it.", "Done (see page 4).", "Next one."]),
        ("Am 5. April zum 103. Mal. Der Rest am 26.09. folgt.", ["Am 5. April zum 103. Mal.", "Der Rest am 26.09. folgt."]),
        ("* one thing\n* Two things\n\nA line that is\nwrapped here.", ["one thing", "Two things", "A line that is wrapped here."]),
        ("<p>One.</p>\n<p>Two.</p>", ["One.", "Two."]),
        (None, []), ("  ", []),
    ],
)
def test_sentences(text, want):
    assert S.sentences(text) == want


def test_beam_search_finds_the_best_combination():
    rng = np.random.default_rng(0)
    k, n = 4, 800
    x = rng.standard_normal((n, k, 3))
    y = (x[:, :, 0] > 0).astype(float)
    y[:, 3] = y[:, 2]  # told only by the label before or after it
    chains = S.train_chains(x, y, 2)
    right = (S.decode(chains, x[:200], width=16)[:, :3] == y[:200, :3]).all(axis=1).mean()
    assert right > 0.9
    assert (S.decode(chains[:1], x[:50], 16) == S.decode(chains[:1], x[:50], 4)).all()


def test_calibration_keeps_order_and_probability():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1000, 2, 2))
    y = (rng.random((1000, 2)) < 1 / (1 + np.exp(-2 * x[:, :, 0]))).astype(float)
    c = S.train_chains(x, y, 1)[0]
    s = c.order[0]
    p = c.probability(0, x[:, s], np.zeros((1000, 1, 0)))[:, 0]
    assert abs(p.mean() - y[:, s].mean()) < 0.05 and np.corrcoef(p, x[:, s, 0])[0, 1] > 0.9


def test_a_term_table_that_does_not_travel_gives_the_same(spark):
    docs, _ = corpus(spark, 200)
    repeated = docs.union(docs.limit(5))
    a, b = (sorted((r.doc_id, r.subject) for r in S.label_subjects(repeated, examples(spark), n).collect()) for n in (S.TRAVEL_TERMS, 0))
    assert a == b and len(a) > 200


def templates(rng, n=3000):
    """Documents of three subjects: 0 and 1 go together; chats (talk) treat 2; sources tell which."""
    both = rng.random(n) < 0.5
    hint = rng.random(n) < np.where(both, 0.2, 0.8)  # what the source tells
    counts = np.where(both[:, None], [3, 4, 0], [0, 0, 4])
    talk = np.where(both, rng.random(n) < 0.25, rng.random(n) < 0.75).astype(float)
    makeup = np.where(hint[:, None], [-1.0, -1.0, 0.8], [0.5, 0.5, -1.0])
    return counts.astype(float), np.full(n, 8.0), talk, makeup


def test_chain_source_and_structure_change_the_result(monkeypatch):
    """Where wording is often missing, each of them raises accuracy on documents not trained on."""
    monkeypatch.setattr(S, "HIDDEN", 0.7)
    rng = np.random.default_rng(4)
    told = [(s, np.eye(3)[s]) for s in range(3)]
    x, y = S.compose(told, templates(rng), 3, 3000, seed=1)
    chains = S.train_chains(x, y)
    x, y = S.compose(told, templates(rng), 3, 2000, seed=2)

    def right(chains, x):
        return (S.decode(chains, x) == y).all(axis=1).mean()

    whole = right(chains, x)
    for column in (-1, -2):  # the source's make-up; chats and threads
        mixed = x.copy()
        mixed[:, :, column] = x[rng.permutation(len(x)), :, column]
        assert right(chains, mixed) < whole - 0.003
    f = x.shape[2]
    cut = [S.Chain(c.order, [np.concatenate([w[:f], 0 * w[f:-1], w[-1:]]) for w in c.links], c.scales) for c in chains]
    assert right(cut, x) < whole - 0.003


def test_features_do_not_state_the_rule():
    x = S.features(np.array([[3.0, 0, 0], [2.0, 0, 0]]), np.array([5, 5]), np.zeros(2), np.zeros((2, 3)))
    assert x.shape == (2, 3, S.OWN + 1 + S.OTHERS + 1 + 3)
    assert x[0, 0, 3] == 1 and x[1, 0, 2] == 1 and x[0, 1, S.OWN + 1 + 3] == 1
