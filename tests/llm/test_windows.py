"""The two searches for long repeats against brute force over all windows."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import substring, suffix, windows

WIDTH = 50


def covered(rows, units):
    """Per row the units and whether a window of a smaller document covers each."""
    first = {}
    for d, t in rows:
        u = units(t)
        for i in range(len(u) - WIDTH + 1) if d is not None else ():
            w = tuple(u[i : i + WIDTH])
            first[w] = min(first.get(w, d), d)
    for d, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for i in range(len(u) - WIDTH + 1) if d is not None else ():
            if first[tuple(u[i : i + WIDTH])] < d:
                gone[i : i + WIDTH] = [True] * WIDTH
        yield d, u, gone


@pytest.mark.parametrize("batch_bytes", [1 << 23, 1 << 10])
def test_words(make_docs, odd_rows, batch_bytes):
    rows = [(d, (t or "").encode()) for d, t in odd_rows]
    want = [
        (d, len(u), sum(g), b" ".join(w for w, x in zip(u, g) if not x)) for d, u, g in covered(rows, bytes.split)
    ]
    found = substring.dedup(make_docs(odd_rows), batch_bytes=batch_bytes).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    by_id = {d: t.split() for d, t in rows}
    spans = [(r.doc_id, s) for r in found for s in r.spans if s.source_doc is not None]
    assert spans
    for d, s in spans:  # the coordinates of the source hold the same words
        here, there = by_id[d], by_id[s.source_doc]
        assert here[s.start : s.start + s.n_words] == there[s.source_start : s.source_start + s.n_words]
        assert s.source_doc < d


@pytest.mark.parametrize("batch_bytes", [1 << 23, 1 << 10])
def test_bytes(make_docs, odd_rows, batch_bytes):
    rows = [(d, (t or "").encode()) for d, t in odd_rows]
    want = []
    for d, u, gone in covered(rows, bytes):
        runs = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        want.append((d, len(u), sum(gone), runs, hashlib.sha256(bytes(b for b, x in zip(u, gone) if not x)).hexdigest()))
    found = suffix.dedup(make_docs(odd_rows), digest=True, batch_bytes=batch_bytes).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept).decode()) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_bytes_over_several_levels(make_docs, odd_rows, monkeypatch):
    """With arrays of a few hundred suffixes a part scans and merges levels; the result is the same."""
    want = sorted(suffix.dedup(make_docs(odd_rows)).collect(), key=repr)
    answer, sizes = suffix._answer, []
    monkeypatch.setattr(suffix, "BATCH_SUFFIXES", 1 << 8)
    merged = suffix.Family.merged
    monkeypatch.setattr(suffix.Family, "merged", staticmethod(lambda a, b: sizes.append(len(a[0])) or merged(a, b)))
    texts = sorted({t.encode()[:400] for _, t in odd_rows if t and len(t.encode()) >= 60})
    payload = b"".join(
        (
            len(texts).to_bytes(4, "little"),
            np.array([len(t) for t in texts], "<u4").tobytes(),
            np.arange(len(texts), 0, -1).astype("<i8").tobytes(),
            *texts,
        )
    )
    asked = pa.table({"batch": pa.array([0], pa.int32()), "part": pa.array([0], pa.int32()), "payload": pa.array([payload], pa.binary())})
    bits = np.unpackbits(np.frombuffer(answer(asked).column("payload")[0].as_py(), np.uint8))
    low = {}
    for doc, t in zip(range(len(texts), 0, -1), texts):
        for i in range(len(t) - 49):
            low[t[i : i + 50]] = min(low.get(t[i : i + 50], doc), doc)
    expected = [low[t[i : i + 50]] < doc for doc, t in zip(range(len(texts), 0, -1), texts) for i in range(len(t) - 49)]
    assert bits[: len(expected)].astype(bool).tolist() == expected and any(expected) and sizes
    assert sorted(suffix.dedup(make_docs(odd_rows), batch_bytes=1 << 12).collect(), key=repr) == want


def test_rows_without_ids_spread_over_batches(make_docs):
    rows = [(None, f"row {i} of many") for i in range(400)] + [(7, f"text {i}") for i in range(400)]
    ex = windows.Exchange(make_docs(rows), batch_bytes=1 << 8)
    sizes = {r["batch"]: r["count"] for r in ex.batches.groupBy("batch").count().collect()}
    assert sum(sizes.values()) == 800 and len(sizes) > 20 and max(sizes.values()) < 100


def test_levels_stay_few():
    rng = np.random.default_rng(0)
    family, seen = suffix.Family(), {}
    for doc in rng.permutation(200).tolist():
        keys = rng.integers(0, 3000, 50).astype("S8")
        family.add(keys, np.full(50, doc))
        for k in keys.tolist():
            seen[k] = min(seen.get(k, doc), doc)
    keys = np.array(sorted(seen))
    assert family.smallest(keys).tolist() == [seen[k] for k in keys.tolist()]
    sizes = [len(k) for k, _ in family.levels]
    assert sum(sizes) == len(seen) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("dedup", [substring.dedup, suffix.dedup])
def test_empty_table(make_docs, dedup):
    assert dedup(make_docs([])).collect() == []
