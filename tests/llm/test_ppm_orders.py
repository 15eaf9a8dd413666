import math
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import ppm


def is_held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def padded(text, order):
    return b"\xff" * order + (text or "").encode() + b"\xff"


def trained(rows, order):
    grams = [defaultdict(Counter) for _ in range(order + 1)]
    for d, t in rows:
        if not is_held(d):
            b = padded(t, order)
            for i in range(order, len(b)):
                for k in range(order + 1):
                    grams[k][b[i - k : i]][b[i]] += 1
    return grams


def probability(grams, context, symbol):
    p, out = 1.0, set()
    for k in range(len(grams) - 1, -1, -1):
        seen = {s: n for s, n in grams[k].get(context[len(context) - k :], {}).items() if s not in out}
        if not seen:
            continue
        n, d = sum(seen.values()), len(seen)
        if symbol in seen:
            return p * seen[symbol] / (n + d)
        p *= d / (n + d)
        out |= seen.keys()
    return p / (256 - len(out))


def expected(grams, text, order):
    b = padded(text, order)
    return sum(math.log10(probability(grams, b[i - order : i], b[i])) for i in range(order, len(b)))


@pytest.mark.parametrize("order,batch_bytes", [(3, 1 << 23), (5, 1 << 11), (6, 1 << 23)])
def test_longer_contexts_against_brute_force(make_docs, odd_rows, monkeypatch, order, batch_bytes):
    monkeypatch.setattr(ppm, "BLOCK", 1 << 9)
    monkeypatch.setattr(ppm, "HELD", 1 << 10)
    rows = [r for r in odd_rows if len(r[1] or "") < 1500]
    strange = next(i for i in range(1000, 1100) if is_held(i))
    rows.append((strange, "Zq alphaéé 中 beta0 the theZ"))  # escapes to every depth
    grams = trained(rows, order)
    got = ppm.score(make_docs(rows), batch_bytes, order).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d is None, d or 0) for d, _ in rows)
    by_id = defaultdict(list)
    for d, t in rows:
        by_id[d].append(expected(grams, t, order))
    for r in got:
        assert any(math.isclose(r.score, e, rel_tol=1e-5) for e in by_id[r.doc_id])


def test_the_query_uses_contexts_of_five_bytes(spark, make_docs, tmp_path):
    from tidemark.llm.queries import QUERIES

    held = next(i for i in range(100, 200) if is_held(i))
    free = [i for i in range(100) if not is_held(i)][:6]
    rows = [(i, f"{a}bcdef{a}") for i, a in zip(free, "xyzxyz")] + [(held, "xbcdefx")]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score for r in QUERIES["op10_ppm"](spark, str(tmp_path)).collect()}
    assert math.isclose(score[held], expected(trained(rows, 5), "xbcdefx", 5), rel_tol=1e-5)


def test_held_out_texts_are_predicted_better_by_longer_contexts(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    two, five = ({r.doc_id: r.score for r in ppm.score(docs, order=k).where("held_out").collect()} for k in (2, 5))
    assert sum(five.values()) > sum(two.values())


def test_longer_contexts_without_training_documents(make_docs):
    held = next(i for i in range(100) if is_held(i))
    (r,) = ppm.score(make_docs([(held, "ab")]), order=5).collect()
    assert math.isclose(r.score, -3 * math.log10(256), rel_tol=1e-6)
    assert ppm.score(make_docs([]), order=5).collect() == []
