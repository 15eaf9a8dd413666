import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    rng = random.Random(5)
    texts = ["", " ", "a b", " a  b ", "don't  we'll", "x\n y", "　 z  ", "end <|endoftext|> here", "é" * 300, " " * 3000 + "q"]
    texts += ["".join(chr(rng.choice([32, 32, 10, rng.randrange(128), rng.randrange(0x250)])) for _ in range(80)) for _ in range(400)]
    texts += ["".join(chr(c) for c in (rng.randrange(0x30000) for _ in range(40)) if not 0xD800 <= c < 0xE000) for _ in range(100)]
    encode = packing.Encoder(PATH)
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == ids(tokenizer, t)[:-1], t


def check(counts, size, **options):
    """The plan places each piece once, fills sequences from the left, without gaps; returns their number."""
    rows, made = packing.plan(np.array(counts), size, **options)
    placed, content = defaultdict(set), defaultdict(list)
    for length, a, b, first, per, offset in rows.tolist():
        for k in range(a, b):
            assert k not in placed[length]
            placed[length].add(k)
            content[first + (k - a) // per].append((offset + (k - a) % per * length, length))
    assert {x: len(s) for x, s in placed.items()} == {x: n for x, n in enumerate(counts) if n}
    assert sorted(content) == list(range(made))
    for items in content.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= size
    return made


def fewest(items, size):
    """The least number of sequences, by search."""
    best = len(items)

    def put(k, open_):
        nonlocal best
        if len(open_) >= best:
            return
        if k == len(items):
            best = len(open_)
            return
        for i in range(len(open_)):
            if open_[i] + items[k] <= size and open_[i] not in open_[:i]:
                put(k + 1, [*open_[:i], open_[i] + items[k], *open_[i + 1 :]])
        put(k + 1, [*open_, items[k]])

    put(0, [])
    return best


@pytest.mark.parametrize("small", [3, 5, 9])
@pytest.mark.parametrize("groups", [3, 50])
def test_plan_on_random_counts(small, groups):
    rng = random.Random(small * groups)
    for _ in range(60):
        size = rng.choice([5, 12, 40])
        counts = [0] + [rng.randrange(8) * (rng.random() < 0.6) for _ in range(size)]
        made = check(counts, size, small=small, groups=groups)
        assert made >= -(-sum(x * n for x, n in enumerate(counts)) // size)


def test_plan_is_near_the_fewest():
    rng = random.Random(2)
    for _ in range(60):
        items = sorted((rng.randrange(1, 21) for _ in range(9)), reverse=True)
        made = check(np.bincount(items, minlength=21).tolist(), 20)
        assert made <= fewest(items, 20) + 1


def test_plan_grows_with_lengths_and_not_with_pieces():
    rng = np.random.default_rng(1)
    counts = np.r_[0, rng.integers(1, 9, 2048)]
    least = int((counts * np.arange(2049)).sum()) / 2048
    rows, made = packing.plan(counts)
    many, large = packing.plan(counts * 10**9)
    assert len(many) < 8 * 2048
    assert made < 1.02 * least and large < 1.02 * least * 10**9


def test_groups_are_of_equal_cardinality():
    counts = np.zeros(101, dtype=np.int64)
    counts[40:101] = np.arange(61) + 5
    groups = packing.equal_groups(counts, 35, 7)
    sizes = [sum(b - a for _, a, b in g) for g in groups]
    assert len(groups) == 7 and sum(sizes) == counts.sum() and max(sizes) - min(sizes) <= 1
    assert all(g[0][0] >= max(x for x, _, _ in h) for g, h in zip(groups, groups[1:]))
    assert packing.equal_groups(np.zeros(9, dtype=np.int64), 3, 4) == []


@pytest.mark.parametrize("size", [2048, 16])
def test_whole_documents(make_docs, odd_rows, tokenizer, size):
    got = packing.pack(make_docs(odd_rows), PATH, size, keep_ids=True).collect()
    texts, found = defaultdict(list), defaultdict(list)
    for d, t in odd_rows:
        texts[d].append(t or "")
    for r in got:
        found[r.doc_id].append(r)
    content = defaultdict(list)
    for d, rows in found.items():
        want = []
        for t in texts[d]:
            own = ids(tokenizer, t)
            cuts = [0, *range((len(own) - 1) % size + 1, len(own) + 1, size)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want.append((k, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes()), own[a:b]))
        assert sorted((r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in rows) == sorted(want)
        for r in rows:
            content[r.sequence_id].append((r.offset, r.length))
    assert found.keys() == texts.keys()
    for items in content.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r.length for r in got)
    assert len(content) <= 1.1 * total / size + 1


def test_sequences_hold_the_ids(make_docs, odd_rows):
    packed = packing.pack(make_docs(odd_rows), PATH, 64, keep_ids=True).cache()
    found = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert found[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids
    assert sum(len(r.ids) for r in found.values()) == packed.groupBy().sum("length").first()[0]


def test_empty_table(make_docs):
    got = packing.pack(make_docs([]), PATH)
    assert got.collect() == []
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
