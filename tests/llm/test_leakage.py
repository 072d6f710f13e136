import random

from arcweave.llm import leakage
from arcweave.llm.words import words


def brute(docs, items, run):
    out = set()
    for i, p in items:
        w = words(p)
        grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for d, t in docs:
            v = words(t)
            if any(tuple(v[k : k + run]) in grams for k in range(len(v) - run + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(make):
    rng = random.Random(5)
    vocab = ["a", "b", "Cé", "漢", "x1"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(3, 20)))) for i in range(12)]
    docs = [(d, ", ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for d in range(80)]
    docs += [(900, items[3][1].upper()), (901, "zz " + items[5][1] + " zz"), (901, "zz " + items[5][1] + " zz"), (902, ""), (903, None)]
    items += [(50, None), (51, ""), (3, "another text for the same item that is long enough to be found by itself")]
    for run in (4, 6):
        got = leakage.leaks(make(docs, "doc_id long, text string"), make(items, "item_id long, passage string"), run=run, limit=40).collect()
        got += []
        want = brute([d for d in docs if d[1]], items, run)
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert len(got) >= len(want)


def test_full_length_and_edges(make):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(1, " ".join(f"W{i}" for i in range(5, 17))), (2, " ".join(f"w{i}" for i in range(5, 16))), (3, " ".join(f"w{i}" for i in range(18, 30))), (4, " ".join(f"w{i}" for i in range(12)))]
    got = leakage.leaks(make(docs, "doc_id long, text string"), make([(7, passage)], "item_id long, passage string")).collect()
    assert sorted(map(tuple, got)) == [(1, 7), (3, 7), (4, 7)]
    none = make([], "item_id long, passage string")
    assert leakage.leaks(make(docs, "doc_id long, text string"), none).count() == 0


def test_long_passages_in_pieces(make):
    """A passage longer than a group is cut; a run over the cut is found."""
    w = [f"w{i}" for i in range(400)]
    docs = [(k, " ".join(w[k : k + 12])) for k in range(0, 388, 7)] + [(900, " ".join(w[3:14])), (901, " ".join(reversed(w)))]
    items = [(7, " ".join(w)), (8, " ".join(w[100:130])), (8, None)]
    got = leakage.leaks(make(docs, "doc_id long, text string"), make(items, "item_id long, passage string"), limit=100).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items[:2], 12) and len(got) == len(set(got))
    assert all(len(r.w) <= 25 for r in leakage.pieces(make(items, "item_id long, passage string"), size=25).collect())
