import random

import xxhash

from tidemark.llm import simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(fps, radius):
    """Smallest id reachable, by comparing all pairs."""
    label = dict.fromkeys(fps)
    for start in sorted(fps):
        if label[start] is None:
            todo = [start]
            while todo:
                x = todo.pop()
                label[x] = start
                todo += [y for y in fps if label[y] is None and (fps[x] ^ fps[y]).bit_count() <= radius]
    return label


def test_against_all_pairs(make_docs, odd_rows):
    rows = [(d, t) for d, t in odd_rows if d is not None]
    fps = {d: brute_fingerprint(t) for d, t in rows}
    label = classes(fps, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(make_docs(odd_rows)).collect()}
    missing = got.pop(None)
    assert missing is not None
    assert got == {d: (f"{f:016x}", label[d]) for d, f in fps.items()}
    assert simhash.near_duplicates(make_docs(odd_rows)).count() == len(odd_rows)


def test_links_of_chains_and_dense_groups(spark):
    """Random groups around centres, chains of single steps, and shards beyond their limit."""
    rng = random.Random(1)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            fp = centre
            for b in rng.sample(range(64), rng.randrange(7)):
                fp ^= 1 << b
            fps.add(fp)
    at = rng.getrandbits(64)
    for b in rng.sample(range(64), 40):
        at ^= 1 << b
        fps.add(at)
    ids = dict(enumerate(sorted(fps, key=lambda _: rng.random())))
    want = classes(ids, 4)
    nodes = spark.createDataFrame([(n, f - (1 << 64) if f >> 63 else f) for n, f in ids.items()], "node long, fp long")
    for limit in (8192, 16):
        edges = simhash.links(nodes, shard_limit=limit)
        got = {n: n for n in ids} | {r.node: r.component for r in simhash.components(edges).collect()}
        assert got == want


def test_tree_follows_only_needed_edges():
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps[:100]]
    tree, parent = simhash.BKTree(4), list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, f in enumerate(fps):
        for a, b in tree.add(f, n):
            assert (fps[a] ^ fps[b]).bit_count() <= 4
            parent[find(a)] = find(b)
    label = classes(dict(enumerate(fps)), 4)
    assert all((find(i) == find(j)) == (label[i] == label[j]) for i in range(0, 400, 7) for j in range(400))
    assert all((fps[i] ^ fps[c]).bit_count() == far for i, kids in enumerate(tree.children) for far, c in kids.items())


def test_rows_without_an_id_link_others_and_ids_may_repeat(make_docs):
    """A and C are only linked through B."""
    rng = random.Random(7)
    while True:
        words = [f"w{rng.randrange(500)}" for _ in range(120)]
        b = list(words)
        b[10] = "x"
        c = list(b)
        c[90] = "y"
        a, b, c = (" ".join(x) for x in (words, b, c))
        bits = [simhash.fingerprint(t.encode()) & (1 << 64) - 1 for t in (a, b, c)]
        far = lambda i, j: (bits[i] ^ bits[j]).bit_count()
        if far(0, 1) <= 4 and far(1, 2) <= 4 and far(0, 2) > 4:
            break
    got = simhash.near_duplicates(make_docs([(1, a), (None, b), (3, c), (None, "else " * 9)])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted([(1, 1), (None, 1), (3, 1), (None, None)], key=repr)

    x, y = ("one two three four " * 9, "nothing like the other text " * 9)
    got = simhash.near_duplicates(make_docs([(5, x), (5, y), (9, x), (8, y), (1, x), (2, y)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (5, 1), (5, 2), (8, 2), (9, 1)]


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []
