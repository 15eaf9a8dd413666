import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import collocations

WORDS = ["the", "of", "Big", "apple", "Pie", "é", "ss", "x#", "new", "york", "　"]


def brute(rows, support, longest, limit):
    """All phrases by their definition."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang in f:
        c = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= support}
        ranked = []
        for p, a in c.items():
            score, k = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
            if not any(
                len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in c.items()
            ):
                ranked.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]], n[lang], k))
        for rank, (s, a, p, left, right, total, k) in enumerate(sorted(ranked)[:limit], 1):
            out.append((lang, rank, p.decode(), p.count(b" ") + 1, -a, left, right, total, k, -s))
    return sorted(out)


def texts(rng, n):
    rows = []
    for _ in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(40))]
        if rng.random() < 0.5:
            w += ["New", "york", "Big", "apple", "pie"]
        rows.append((rng.choice(["en", "de", None]), "".join(x + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "!?"]) for x in w)))
    return rows


@pytest.mark.parametrize("support, longest, flush", [(3, 5, 1 << 22), (6, 3, 50), (4, 5, 200), (2, 2, 1 << 22)])
def test_against_brute_force(spark, support, longest, flush):
    rows = texts(random.Random(support), 120)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = collocations.collocations(docs, 40, support, longest, flush).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, support, longest, 40)
    assert len(got) > 20


def test_odd_rows(make_docs, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 4000]
    got = collocations.collocations(make_docs(rows), 100, 4).collect()
    assert sorted(tuple(r) for r in got) == brute([(None, t) for _, t in rows], 4, 5, 100)


def test_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(collocations, "ROW_ENTRIES", 16)
    text = " ".join(f"the w{i}" for i in range(100))
    (chunk,) = collocations.encode(spark.createDataFrame([("en", text)], "lang string, text string")).collect()
    words, ids = pa.array(chunk.names), np.frombuffer(chunk.ids, "<i4")
    rows = [r for b in collocations.counted("en", words, ids, 0, None, True) for r in b.to_pylist()]
    assert [len(r["counts"]) for r in rows if r["next"]] == [16] * 6 + [5]
    assert sum(sum(r["counts"]) for r in rows if r["next"]) == 200
    assert sum(sum(r["counts"]) for r in rows if r["hashes"]) == 199


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BITS", 3)
    monkeypatch.setattr(collocations, "MOST_BITS", 3)
    rows = texts(random.Random(9), 80)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 30, 3).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3, 5, 30)


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    rows = [("en", "", w, big * 9, w, 1) for w in ("a", "b")] + [("en", "a", "b", big, "a b", 2)]
    found = spark.createDataFrame(rows, "lang string, prefix string, next string, f long, phrase string, words int")
    totals = spark.createDataFrame([("en", big * 18)], "lang string, n long")
    docs = spark.createDataFrame([], "lang string, text string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(collocations, "levels", lambda *a: (found, totals))
        (r,) = collocations.scored(docs).collect()
    assert r.score == 1000 * big * (big * 18) // (big * 9) ** 2


def test_empty_table(make_docs):
    got = collocations.collocations(make_docs([]))
    assert got.collect() == []
    assert got.columns == ["lang", "rank", "phrase", "words", "a", "l", "r", "n", "k", "score"]
