import math
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import ppm


def trained(rows):
    grams = [defaultdict(Counter) for _ in range(3)]
    words = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            words.update((t or "").encode().lower().split() + [b""])
            b = b"\xff\xff" + (t or "").encode() + b"\xff"
            for i in range(2, len(b)):
                for order in range(3):
                    grams[order][b[i - order : i]][b[i]] += 1
    return grams, words


def probability(grams, context, symbol):
    p, out = 1.0, set()
    for order in (2, 1, 0):
        seen = {s: n for s, n in grams[order].get(context[2 - order :], {}).items() if s not in out}
        if not seen:
            continue
        n, d = sum(seen.values()), len(seen) * (len(out) + len(seen) < 256)
        if symbol in seen:
            return p * seen[symbol] / (n + d)
        p *= d / (n + d)
        out |= seen.keys()
    return p / (256 - len(out))


@pytest.mark.parametrize("batch_bytes", [1 << 23, 1 << 11])
def test_against_brute_force(make_docs, odd_rows, batch_bytes):
    rows = [r for r in odd_rows if len(r[1] or "") < 2000]
    grams, words = trained(rows)
    n, v = sum(words.values()), len(words)
    got = ppm.score(make_docs(rows), batch_bytes).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(set)
    for d, t in rows:
        by_id[d].add(t or "")
    for r in got:
        assert r.train_tokens == n
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        fits = []
        for t in by_id[r.doc_id]:
            w = t.encode().lower().split() + [b""]
            b = b"\xff\xff" + t.encode() + b"\xff"
            score = sum(math.log10(probability(grams, b[i - 2 : i], b[i])) for i in range(2, len(b)))
            base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w)
            fits.append(
                (r.n_tokens, r.n_known) == (len(w), sum(words[x] > 0 for x in w))
                and math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-5)
            )
        assert any(fits)


def test_every_context_is_a_distribution():
    import numpy as np

    rng = np.random.default_rng(0)
    grams = np.zeros(ppm.GRAMS)
    np.add.at(grams, rng.integers(0, 1 << 20, 4000), 1)
    grams[65 * 65536 : 65 * 65536 + 256] = 3  # a context with all symbols
    seen = np.flatnonzero(grams)
    p = 10.0 ** ppm.code_lengths(seen, grams[seen]).reshape(65536, 256)[rng.integers(0, 65536, 500).tolist() + [0, 65 * 256]]
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_no_training_documents_and_empty_table(make_docs):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = ppm.score(make_docs([(held, "ab")])).collect()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0
    assert math.isclose(r.score, -3 * math.log10(256), rel_tol=1e-6)
    assert ppm.score(make_docs([])).collect() == []
