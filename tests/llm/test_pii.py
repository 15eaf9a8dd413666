import re

from tidemark.llm import pii, queries


def test_patterns():
    text = "é a.b@c-d.org, 10.0.0.255 and 10.0.0.256; 4111 1111 1111 1111 vs 4111-1111-1111-1112 +1 (706) 555-3138 +12 x"
    found = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.base_spans(text)]
    assert found == [
        ("email", "a.b@c-d.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (706) 555-3138"),
    ]
    # what fails is dropped, the search goes on behind it
    assert pii.base_spans("1.2.3.4.5.6.7.8") == [(0, 1, 7), (8, 1, 15)]
    assert pii.base_spans("999.1.1.1.1.1.1.1") == [(10, 1, 17)]
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")


def rows():
    out = [(i, f"Plain text number {i} from and about the weather of the day and more.") for i in range(60)]
    out += [(100 + i, f"note {i} says Zorblax wrote from a{i % 2}@mail.org about item {i} today") for i in range(8)]
    out += [(200 + i, "copy of one passage with Quux near x@y.org in it") for i in range(9)]
    out += [(300, "Zorblax alone, far from any address. Zorblax again"), (301, None), (302, ""), (None, "Zorblax t@u.org")]
    return out


def test_terms_that_disclose(make_docs):
    docs = make_docs(rows())
    terms = {(r.entity, r.term) for r in pii.disclosing(docs, pii.scan(docs), bits=1.0, posterior=0.3).collect()}
    assert ("email:a0@mail.org", "Zorblax") in terms
    assert not any(t in ("Quux", "the") for _, t in terms)  # copies of one passage are one surrounding
    found = {r.doc_id: r for r in pii.find_all(docs, bits=1.0, posterior=0.3).collect()}
    assert len(found) == len(rows())
    assert [s.kind for s in found[300].spans].count(4) == 2 and found[300].base == []
    assert [s.kind for s in found[301].spans] == []
    for d, t in rows():
        base = [(s.start, s.kind, s.end) for s in found[d].base]
        assert base == pii.base_spans(t or "")
        every = [(s.start, s.kind, s.end) for s in found[d].spans]
        assert set(base) <= set(every) and every == sorted(every)


def test_redact(make_docs):
    docs = make_docs([*rows(), (300, "Zorblax alone, far from any address. Zorblax again")])
    out = pii.redact(docs, bits=1.0, posterior=0.3)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[300].text == "<TERM> alone, far from any address. <TERM> again"
    assert got[300].n_chars == len(got[300].text)
    assert got[200].text == "copy of one passage with Quux near <EMAIL> in it"
    assert got[5].text == dict(rows())[5] and got[301].text is None
    assert not any(re.search("@", r.text or "") for r in got.values())


def test_long_text_and_empty_table(make_docs):
    long = "word " * 50_000 + "a@b.cd " + "1" * 5_000
    (r,) = pii.find_all(make_docs([(1, long)])).collect()
    assert [(s.start, s.kind) for s in r.spans] == [(250_000, 0)]
    assert pii.find_all(make_docs([])).collect() == []
    assert pii.redact(make_docs([])).collect() == []


def test_copies_count_once_on_both_sides(make_docs):
    """A thousandfold text that holds the term does not hide it, nor do copies of the surroundings."""
    plain = [(i, f"Plain text number {i} about the weather of day {i}.") for i in range(200)]
    near = [(300 + i, f"note {i * 7} says Zorblax wrote from z@mail.org twice about item {i} z@mail.org Zorblax") for i in range(5)]
    copies = [(1000 + i, "Zorblax alone, far from any address.") for i in range(300)]
    docs = make_docs([*plain, *near, *copies, *[(2000 + i, near[0][1]) for i in range(40)]])
    rows = pii.disclosing(docs, pii.scan(docs)).where("term = 'Zorblax'").collect()
    assert [(r.entity, r.n_with, r.n_docs, r.posterior) for r in rows] == [("email:z@mail.org", 5, 6, 5 / 6)]


def test_patterns_take_linear_time_and_match_as_written():
    import random
    import re
    import time

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("ab@@..1-_ 29é") for _ in range(rng.randrange(30)))
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in pii.base_spans(t) if s[1] < 2] == sorted(want), t
    assert pii.base_spans("x " + "1" * 5000 + ".1.1.1 y") == []
    assert pii.base_spans("x " + "0" * 5000 + "1.1.1.1 y") == [(2, 1, 5009)]
    began = time.process_time()
    for t in ("1" * 10**6, "a" * 10**6 + " b@c", "1." * 300_000, "a@" * 300_000):
        pii.base_spans(t)
    assert time.process_time() - began < 8


def test_terms_beyond_their_bound_change_nothing(spark, monkeypatch):
    """Counting stops at the bound of a term; the pairs and their figures are those of counting on."""
    import random

    rng = random.Random(3)
    rows = []
    for i in range(60):
        who = i % 6
        near = f"mister name{who} common writes from p{who}@x.org about w{rng.randrange(50)} and w{rng.randrange(50)}"
        rows.append((i, near if i % 2 else f"common words name{who} of w{rng.randrange(50)} here common"))
    docs = spark.createDataFrame(rows + [(100 + i, f"common talk number {i}") for i in range(40)], "doc_id long, text string").coalesce(2)

    def found():
        return sorted(tuple(r) for r in pii.disclosing(docs, pii.scan(docs), 2, 0.3, 0.5).collect())

    bounded = found()
    monkeypatch.setattr(pii, "_most", lambda pairs, posterior: __import__("numpy").full(pii.PLACES, 1 << 40))
    assert bounded == found() and bounded
    assert not any(r[1] == "common" for r in bounded)


def test_the_query_counts_spans_of_each_kind(make_docs, tmp_path, spark):
    """Kinds in any order and number: a span counts for its kind, not for its place in the list."""
    import hashlib

    rows = [
        (1, "4111 1111 1111 1111 then 10.0.0.1 and a@b.cd, +1 (706) 555-3138, x@y.zz"),
        (2, "10.0.0.1 and 10.0.0.2 and 10.0.0.3"), (3, "a@b.cd a@b.ce a@b.cf a@b.cg"), (4, None), (5, "é +1 (706) 555-3138"),
        (5, "10.0.0.1"), (None, "4111-1111-1111-1111"),
    ]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_pii(spark, str(tmp_path)).drop("spans").collect()
    want = []
    for d, t in rows:
        base = pii.base_spans(t or "")
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        want.append((d, *[sum(s[1] == k for s in base) for k in range(4)], digest))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
