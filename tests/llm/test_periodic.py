import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import periodic
from tidemark.llm.queries import op13_periodic


def brute(w, times=4, least=6):
    """All runs by their definition: every period, every place."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)  # smaller periods come first
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def kept(w, found):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]


def periodic_words(rng, n):
    w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
    if n and rng.random() < 0.6:
        s, p = rng.randrange(n), rng.randrange(1, 9)
        w = [w[i] if i < s else w[min(s + (i - s) % p, n - 1)] for i in range(n)]
    return [f"w{x}" for x in w]


@pytest.mark.parametrize("times", [2, 3, 4])
def test_runs_against_brute_force(times):
    rng = random.Random(times)
    for _ in range(500):
        texts = [periodic_words(rng, rng.randrange(70)) for _ in range(rng.randrange(1, 6))]
        got = periodic._measure([" ".join(w).encode() for w in texts], times, 6)
        for w, (own, split, keep) in zip(texts, got):
            want = brute(w, times)
            assert [tuple(r) for r in own.tolist()] == want
            assert [x.decode() for x, k in zip(split, keep) if k] == kept(w, want)


def test_extensions_against_brute_force():
    rng = np.random.default_rng(4)
    for alphabet in (1, 2, 3, 30):
        for _ in range(20):
            n = int(rng.integers(2, 120))
            s = rng.integers(0, alphabet, n)
            if n > 20:
                s[n // 2 : n // 2 + 8] = s[:8]
            text = np.concatenate([[alphabet], s, [alphabet + 1]])
            rounds, last = periodic.recompress(text, alphabet)
            assert len(last) == 3
            p, q = (x.ravel() + 1 for x in np.meshgrid(np.arange(n), np.arange(n)))
            p, q = p[p != q], q[p != q]
            ahead = periodic.extensions(rounds, last, p, q)
            rounds, last = periodic.backwards(rounds, last)
            back = periodic.extensions(rounds, last, len(text) - p, len(text) - q)
            for a, b, x, y in zip(p.tolist(), q.tolist(), ahead.tolist(), back.tolist()):
                assert (text[a : a + x] == text[b : b + x]).all() and text[a + x] != text[b + x]
                assert (text[a - y : a] == text[b - y : b]).all() and text[a - y - 1] != text[b - y - 1]


def test_ties_and_exact_exponents():
    own = np.array([(5, 8, 2), (2, 12, 3), (9, 16, 4), (30, 4 * 10**6 + 1, 10**6)])
    assert periodic.strongest(own) == (30, 4 * 10**6 + 1, 10**6)
    assert periodic.strongest(own[:3]) == (2, 12, 3)
    assert periodic.strongest(own[:0]) is None


def test_long_texts_of_one_word_and_of_one_period():
    for w, q in ((["a"] * 60_000, 1), (["a", "b", "c"] * 20_000, 3)):
        ((own, _, keep),) = periodic._measure([" ".join(w).encode()], 4, 6)
        assert own.tolist() == [[0, len(w), q]] and keep.sum() == q


@pytest.mark.parametrize("batch_words", [1 << 19, 40])
def test_operator_on_odd_rows(make_docs, odd_rows, batch_words):
    rows = [*odd_rows, (900, "x y " * 9), (901, "p " + "q " * 5), (902, "q " * 6), (903, "é 　 " * 7)]
    got = periodic.find(make_docs(rows), batch_words=batch_words).collect()
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append([x.decode() for x in (t or "").encode().split()])
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    for d, split in texts.items():
        want = []
        for w in split:
            runs = brute(w) if len(w) < 1500 else None
            want.append((len(w), runs, None if runs is None else " ".join(kept(w, runs))))
        if all(x[1] is not None for x in want):
            assert sorted(found[d]) == sorted(want)
        else:
            assert sorted(x[0] for x in found[d]) == sorted(x[0] for x in want)
    assert len(got) == len(rows)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(periodic_words(rng, rng.randrange(120)))) for i in range(150)] + [(500, None), (501, ""), (None, "a " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op13_periodic(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    changed = 0
    for d, t in rows:
        w = (t or "").split()
        h = 1 if d is None else zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = brute(w)
        r = got[d]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(kept(w, runs)).encode()).hexdigest()
    assert changed > 5


def test_empty_table(make_docs):
    got = periodic.find(make_docs([]))
    assert got.collect() == [] and got.columns == ["doc_id", "n_words", "runs", "collapsed"]
