from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import mixing, quality_rules as rules


def repeated(words):
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    return len(hit)


def test_measurements(make_docs, odd_rows):
    rows = [*odd_rows, (50, "a b c d e f a b c d e g\n\nsame\nsame \nsame\n# $ * <>"), (51, "w " * 5), (52, "á b c d"), (53, "GO!! " * 30)]
    got = rules.judged(rules.ledger(make_docs(rows))).collect()
    want = []
    for d, t in rows:
        t = t or ""
        w = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        want.append((d, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated(w)))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (r.failures == 0) and not (r.kept and r.base_failed)
    assert {r.doc_id: r.failures & rules.BITS["exclamations"] for r in got}[53]


def test_policies_and_ablations(make_docs, odd_rows):
    docs = make_docs([*odd_rows, (60, "# " * 40 + "plain words follow here and there " + "% " * 9)])
    ledger = rules.ledger(docs).cache()
    masks = [r.failures for r in ledger.collect()]
    got = {r.rule: (r.rejects, r.rejects_alone) for r in rules.ablations(ledger).collect()}
    assert got == {
        name: (sum(bool(m & bit) for m in masks), sum(m == bit for m in masks)) for name, bit in rules.BITS.items()
    }
    lenient = rules.judged(ledger, rules.LENIENT)
    assert lenient.where("kept").count() >= rules.judged(ledger).where("kept").count()
    kept = rules.passing(docs)
    assert kept.columns == docs.columns
    assert kept.count() == rules.judged(ledger).where("kept").count()


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    wanted, limited = share * sum(sizes.values()), set()
    while True:
        left = wanted - sum(most * sizes[s] for s in limited)
        open_weight = sum(weight[s] for s in names if s not in limited)
        over = {s for s in names if s in limited or most * sizes[s] <= left * weight[s] / open_weight} if open_weight else limited
        if over == limited:
            return {s: most * sizes[s] if s in limited else left * weight[s] / open_weight for s in names}
        limited = over


def test_mix(make_docs):
    rows = [(i, "w " * (1 + i * 7 % 50), ["hot", "hot", "b", "é", None, "tiny"][i % 6] if i % 50 else "tiny2") for i in range(600)]
    rows += [(700, None, "empty"), (701, "", "empty"), (None, "a b", "b"), (5, "w " * 36, "tiny"), (5, "w " * 36, "tiny")]
    got = mixing.mix(make_docs(rows)).collect()
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        n = len((t or "").split())
        sizes[s] += n
        longest[s] = max(longest[s], n)
    target = brute_targets(sizes)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - target[r.source]) < 1e-6
    assert len(got) == len(rows)
    for s in sizes:
        assert target[s] - 3 * longest[s] - 1 <= taken[s] <= target[s] + 1e-6
    again = mixing.mix(make_docs(rows)).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)


def test_thresholds_nest(make_docs):
    sizes = mixing.sized(make_docs([(i, "w " * (i % 9), "s") for i in range(300)])).cache()
    at = []
    for budget in (0.0, 10.0, 333.0, 900.0, 1e9):
        b = sizes.select("source").distinct().withColumn("budget", F.lit(budget))
        limit = mixing.thresholds(sizes, b).first().threshold
        at.append(limit)
        inside = sizes.where(F.col("hash") < limit).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        total = sizes.agg(F.sum("size")).first()[0]
        assert inside <= budget and (inside + 9 > budget or inside == total)
    assert at == sorted(at)


def test_empty_tables(make_docs):
    empty = make_docs([])
    assert mixing.mix(empty).collect() == []
    assert rules.judged(rules.ledger(empty)).collect() == []
    assert rules.ablations(rules.ledger(empty)).count() == 0
    assert rules.passing(empty).collect() == []


def test_null_and_equal_ids_fill_their_targets(make_docs):
    for doc_id, text in ((None, None), (7, None), (None, "same words here now")):
        rows = [(doc_id, text or f"w{i} " * 20, s) for s in "abc" for i in range(100)]
        got = mixing.mix(make_docs(rows)).collect()
        taken, target = defaultdict(int), {}
        for r in got:
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert r.taken <= 2 * r.size
        assert len(got) == 300
        for s in "abc":
            assert target[s] - 2 * 20 <= taken[s] <= target[s], (doc_id, s)
