import random

import numpy as np

from metrolith.llm import toxicity


def corpus(n=900):
    r = random.Random(3)
    syllables = ["ba", "ko", "ri", "ten", "mu", "sol", "ver", "li", "na", "dor", "é", "ung"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(5, 150))]
        bad = r.random() < 0.15
        if bad:
            for _ in range(r.randint(2, 5)):
                w = r.choice(["idiot", "Scum", "moron!"]) if i % 2 else "grobi" + word()
                words.insert(r.randint(0, len(words)), w)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (5000, None, "x"), (5001, "", "x"), (None, "idiot scum", "x")], "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    c = toxicity.train(docs, known)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, c).collect()}
    truth = {i: y for i, _, y in labels}
    import zlib

    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    wrong = [i for i in held if got[i].predicted != truth[i]]
    assert len(held) > 150 and len(wrong) <= 2
    assert got[5000].score == got[5001].score < 0.1 and got[None].predicted == 1 and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in toxicity.keep_clean(docs, c).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 0}


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    import zlib

    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    scores = []
    for known in (labels, turned):
        c = toxicity.train(docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int"))
        scores.append(sorted((r.doc_id, r.score) for r in toxicity.score_documents(docs, c).collect()))
    assert scores[0] == scores[1]


def test_label_model_discounts_copies():
    r = np.random.default_rng(0)
    y = (r.random(3000) < 0.3).astype(int)
    noisy = lambda a, b: np.where(y == 1, r.random(3000) < a, r.random(3000) < b).astype(float)
    one = noisy(0.6, 0.2)
    votes = np.stack([noisy(0.8, 0.02), noisy(0.7, 0.05), one, one, one], 1)
    given = np.where(r.random(3000) < 0.2, y, -1)  # a fifth is labelled, as voters are found from labels
    model, q = toxicity.fit_label_model(votes, given)
    assert abs(model.on_toxic[0] - 0.8) < 0.15 and model.on_clean[0] < 0.1
    assert model.say[2] < 0.5 < model.say[0] and model.correlation[2, 3] > 0.8
    assert ((q > 0.5) == (y == 1))[given < 0].mean() > 0.85


def test_label_model_by_hand():
    """One round of the model against the formulas written out, on rows with and without labels."""
    r = np.random.default_rng(5)
    votes = (r.random((40, 3)) < 0.4).astype(float)
    given = np.array([1, 0, -1, -1] * 10)
    model, q = toxicity.fit_label_model(votes, given, 0.9, 1)
    start = [{1: 0.9, 0: 0.1}.get(g, 1 / (1 + np.exp(-1.0 if v.any() else 1.0))) for g, v in zip(given, votes)]
    p = sum(start)
    a = [(sum(s * v[j] for s, v in zip(start, votes)) + 0.2) / (p + 2) for j in range(3)]
    b = [(sum((1 - s) * v[j] for s, v in zip(start, votes)) + 0.02) / (40 - p + 2) for j in range(3)]
    rest = [[v[j] - s * a[j] - (1 - s) * b[j] for j in range(3)] for s, v in zip(start, votes)]
    dot = lambda i, j: sum(x[i] * x[j] for x in rest) / 40
    cor = [[0.0 if i == j else max(0.0, dot(i, j) / (dot(i, i) * dot(j, j)) ** 0.5) for j in range(3)] for i in range(3)]
    say = [1 / (1 + sum(c * c for c in row)) for row in cor]
    prior = min(0.5, (p + 1) / 44)
    for k in range(40):
        odds = np.log(prior / (1 - prior)) + {1: np.log(9.0), 0: -np.log(9.0)}.get(given[k], 0.0)
        odds += sum(say[j] * np.log(a[j] / b[j] if votes[k, j] else (1 - a[j]) / (1 - b[j])) for j in range(3))
        assert abs(q[k] - 1 / (1 + np.exp(-odds))) < 1e-9
    # Accuracies and correlations move what rows without a label get: a copy of a voter adds less than its own say.
    twice, q2 = toxicity.fit_label_model(np.hstack([votes, votes[:, :1]]), given, 0.9, 1)
    assert twice.say[0] < 0.6 * model.say[0] and not np.allclose(q2[given < 0], q[given < 0])


def test_unlabelled_rows_are_learned_from(spark):
    rows, labels = corpus(500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = spark.createDataFrame(labels[:250], "doc_id long, quality int, toxic int")
    both, only = toxicity.train(docs, few), toxicity.train(docs.where("doc_id < 250"), few)
    assert both.voters.names == only.voters.names
    assert not np.allclose(both.model.on_toxic, only.model.on_toxic) and not np.allclose(both.weights, only.weights)


def test_long_text(spark):
    rows, labels = corpus(300)
    c = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    long = "fine words " * 400_000
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(spark.createDataFrame([(1, long), (2, long + " idiot scum moron" * 20_000)], "doc_id long, text string"), c).collect()}
    assert got == {1: 0, 2: 1}


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "you stupid idiot, scum"), (2, "fine words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, toxicity.train(docs, none)).collect()}
    assert got == {1: 1, 2: 0}
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs.limit(0), none)).collect() == []
