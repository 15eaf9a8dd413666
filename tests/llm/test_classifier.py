import random
import zlib

import numpy as np

from tidemark.llm import classifier
from tidemark.llm.classifier import Network, laid_out, recurring


def good(rng):
    return "".join(rng.choices("abcdefgh", k=rng.randrange(2, 9)).__str__()[2:3] + "".join(rng.choices("aeiourst", k=rng.randrange(1, 8))) + " " for _ in range(rng.randrange(5, 200)))


def junk(rng):
    return rng.choice([lambda: good(rng).upper().replace(" ", "!! "), lambda: "".join((w + " ") * 9 for w in good(rng).split()[:30]), lambda: good(rng).replace(" ", "### ")])()


def test_recurring_and_layout():
    b, halves = laid_out([b"", b"ha ha ha ha ha ha", b"x" * 500])
    assert len(b) == halves.sum() * 128 and halves.tolist() == [1, 1, 5]
    flags = recurring(b)
    assert not flags[:128].any() and flags[128 + 10 : 128 + 17].all() and not flags[128 + 17 : 256].any()


def test_gradients_by_difference():
    rng = random.Random(0)
    texts = [good(rng).encode() for _ in range(3)] + [junk(rng).encode() for _ in range(3)]
    labels, weight = np.array([1, 1, 1, 0, 0, 0]), np.array([1, 2, 1, 1, 1, 3.0])
    net = Network(*[w.astype(np.float64) for w in Network.new(3).weights()])

    def loss():
        p = net.score(texts)
        return -(weight * np.where(labels == 1, np.log(p), np.log(1 - p))).sum() / len(texts)

    pick = np.random.default_rng(1)
    for w, g in zip(net.weights(), net.gradients(texts, labels, weight)):
        flat, slope = w.reshape(-1), np.asarray(g).reshape(-1)
        for i in pick.choice(np.flatnonzero(slope) if slope.any() else len(flat), 5):
            was, h = flat[i], 1e-5
            flat[i] = was + h
            up = loss()
            flat[i] = was - h
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * h) - slope[i]) < 1e-3 + 0.02 * abs(slope[i])


def test_score_does_not_depend_on_neighbours():
    rng = random.Random(5)
    net = Network.new(1)
    texts = [b"", b"a", "é".encode() * 3000, *[junk(rng).encode() for _ in range(20)], b"z" * 100_000]
    assert np.allclose(net.score(texts), [net.score([t])[0] for t in texts], atol=1e-5)


def test_held_out_accuracy(spark, make_docs):
    rng = random.Random(6)
    rows = [(i, (good if i % 3 else junk)(rng)) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    odd = [(None, "ok words"), (2000, None), (2000, None), (2001, ""), (2002, good(rng) * 300)]
    got = classifier.classify(make_docs(rows + odd), labels).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.95
    again = {r.doc_id: r.score for r in classifier.classify(make_docs(rows), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-3 for r in got if r.doc_id is not None and r.doc_id < 900)


def test_without_labels_and_empty(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in classifier.classify(make_docs([(1, "a"), (2, None)]), labels).collect()] == [0.5, 0.5]
    assert classifier.classify(make_docs([]), labels).collect() == []
