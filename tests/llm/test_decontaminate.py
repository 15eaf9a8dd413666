import random
import re

import pytest

from tidemark.llm import decontaminate as d

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [w.decode() for w in WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or "").encode())]


def brute(docs, items, length=10):
    phrases = set()
    for i, t in items:
        w = words(t)
        phrases |= {(i, tuple(w[k : k + length])) for k in range(max(1, len(w) - length + 1)) if w}
    for doc_id, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, p in phrases:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found.add(str(i))
        yield doc_id, len(w), len(hit), sorted(found)


@pytest.mark.parametrize("short", [False, True])
def test_against_brute_force(spark, make_docs, odd_rows, short):
    rng = random.Random(4)
    vocabulary = ["a1", "Bé", "c", "dd", "e", "ß", "g7"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(10, 30)))) for i in range(12)]
    items += [(20, items[0][1]), (21, ""), (22, None), (None, items[1][1]), (23, "e " * 14)]
    if short:
        items += [(30, "zeta"), (31, "of, the!"), (32, "Épée épée")]
    docs = [*odd_rows]
    for i in range(40):
        n = rng.randrange(0, 25)
        passage = items[rng.randrange(12)][1].split()
        docs.append((200 + i, " ".join(rng.choices(vocabulary, k=n)) + "; " + "-".join(passage[: rng.randrange(6, 30)]) + " " + "e " * rng.randrange(20)))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, phrase string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in d.decontaminate(make_docs(docs), bench).collect()), key=repr)
    want = sorted(brute(docs, [(i, t) for i, t in items if i is not None] + [("x", t) for i, t in items if i is None]), key=repr)
    want = sorted(((a, b, c, [i for i in items_ if i != "x"]) for a, b, c, items_ in want), key=repr)
    assert got == want
    assert sum(r[2] > 0 for r in got) > 10


def test_proximity(spark, make_docs):
    """A word more or less inside the phrase, or two words exchanged, is near but not exact."""
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = make_docs(
        [
            (1, "x one two three four five six seven eight nine ten y"),
            (2, "x one two three four extra five six seven eight nine ten y"),
            (3, "x one two four three five six seven eight nine ten y"),
            (4, "one two three four a b c d five six seven eight nine ten"),
            (5, "one two three four five six seven eight nine"),
        ]
    )
    phrases = d.phrases(bench)
    vocabulary = phrases.selectExpr("explode(words) AS term")
    for slop, near in ((0, [1]), (1, [1, 2, 3])):
        indexed = d.index(docs, vocabulary, 10, slop).cache()
        rows = {r.row: r.doc_id for r in indexed.collect()}
        found = d.matches(d.postings(indexed), phrases.select("phrase", "words"), slop).collect()
        assert sorted({rows[r.row] for r in found}) == near


def test_empty_tables(spark, make_docs, odd_rows):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and r["items"] == [] for r in d.decontaminate(make_docs(odd_rows), bench).collect())
    assert d.decontaminate(make_docs([]), bench).collect() == []
