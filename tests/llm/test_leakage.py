import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import leakage as L
from ledgerlake.llm.leakage import ItemIndex, align, leaked_items, words

DOCS, ITEMS = "doc_id long, text string, item_id int, seed int", "item_id long, text string"


def coverage(doc, item, n=8):
    d, t = words(doc or ""), words(item)
    grams = {tuple(d[i : i + n]) for i in range(len(d) - n + 1)}
    hit = [False] * len(t)
    for i in range(len(t) - n + 1):
        if tuple(t[i : i + n]) in grams:
            hit[i : i + n] = [True] * n
    return sum(hit), len(t)


def plain_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@given(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(0, 4), max_size=15))
@settings(max_examples=200, deadline=None)
def test_alignment_matches_the_full_table(a, b):
    pairs = [(np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)) for x, y in ((a, b), (a[:3], b), (a, a), ([], b))]
    assert align(pairs, together=3).tolist() == [plain_align(x.tolist(), y.tolist()) for x, y in pairs]


def test_words_ignore_marks():
    want = "the lender repaid 2064814 of 7 5 percent".split()
    for text in ("The lender repaid $2,064,814 of 7.5 percent.", "THE <b>lender</b>\n repaid &nbsp;2064814 of 7 5 percent", "> the **lender** repaid 2,064,814 of 7.5 percent"):
        assert words(text) == want
    assert words("") == [] and words("lender's") == ["lenders"]


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], DOCS)
    out = leaked_items(d, spark.createDataFrame(items, ITEMS)).collect()
    return {(r.doc_id, r.item_id): (r.covered_words, r.item_words) for r in out}


def test_random_copies_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "RARE_DOCUMENTS", 3)
    monkeypatch.setattr(L, "OWN_ITEMS", 5)
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    intro = "answer the question that follows using only this passage"
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, (intro + " " if i % 2 else "") + text(rnd.randrange(5, 60))) for i in range(40)] + [(90, intro + " now"), (91, "too short"), (92, None), (93, "")]
    docs = []
    for k in range(120):
        parts = [text(rnd.randrange(0, 40))]
        for _ in range(rnd.randrange(3)):
            w = rnd.choice(items[:40])[1].split()
            a = rnd.randrange(len(w))
            parts += [" ".join(w[a : a + rnd.randrange(4, 40)]), text(rnd.randrange(0, 10))]
        if k % 4 == 0:
            parts.append(intro + " now")  # an item in a quarter of all documents: its n-grams are not rare
        docs.append((k, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, " ".join(i[1] for i in items[:40]) * 20)]
    got = run(spark, docs, items)
    want = {}
    for d, t in docs:
        for i, q in items:
            if q:
                n, size = coverage(t, q)
                if size and n * 3 > size:
                    want[d, i] = (n, size)
    assert {k: v for k, v in got.items() if v[0] * 3 > v[1]} == want
    assert {k[1] for k in want} >= {90}


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c d e f g h i")]) == {} == run(spark, [(1, "a b c d e f g h i")], [])


def test_items_in_several_blocks_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"v{i}x{k}" for k in range(12))) for i in range(9)]
    docs = [(i, items[i][1] + " tail") for i in range(9)]
    whole = run(spark, docs, items)
    monkeypatch.setattr(L, "BLOCK_CHARS", 150)
    assert run(spark, docs, items) == whole and len(whole) == 9


def test_markup_of_any_length_is_stripped(spark):
    item = " ".join(f"a{i}" for i in range(30))
    text = " ".join(f'a{i}<span class="{"c" * 2000}">' if i % 3 == 0 else f"a{i} &{'n' * 50};" for i in range(30))
    assert words(text) == item.split()
    assert run(spark, [(1, text)], [(1, item)]) == {(1, 1): (30, 30)}
    assert words("if a < 5 words and b > 3 then") == "if a 5 words and b 3 then".split()  # no tag


def test_every_seventh_word_changed_is_found(spark):
    item = [f"a{i}" for i in range(60)]
    edited = " ".join("zz" if i % 7 == 6 else w for i, w in enumerate(item))
    d = spark.createDataFrame([(1, f"x y {edited} z", 1, 2)], DOCS)
    (r,) = leaked_items(d, spark.createDataFrame([(1, " ".join(item))], ITEMS)).collect()
    assert (r.kind, r.covered_words, r.stretches) == ("edited", 0, 0) and r.alignment_share > 0.7


def edit(rnd, w, vocabulary):
    """A sixth of the words replaced, left out or added."""
    out = []
    for x in w:
        k = rnd.random()
        out += [] if k < 0.04 else [rnd.choice(vocabulary)] if k < 0.12 else [x, rnd.choice(vocabulary)] if k < 0.16 else [x]
    return out


def test_recall_of_edited_copies_and_no_strangers(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [(i, [rnd.choice(vocabulary) for _ in range(rnd.randrange(30, 120))]) for i in range(200)]
    docs = [(i, " ".join([*rnd.choices(vocabulary, k=50), *edit(rnd, w, vocabulary), *rnd.choices(vocabulary, k=50)])) for i, w in items]
    docs += [(1000 + i, " ".join(rnd.choices(vocabulary, k=150))) for i in range(200)]
    got = set(run(spark, docs, [(i, " ".join(w)) for i, w in items]))
    assert len({(i, i) for i, _ in items} & got) >= 0.9 * len(items) and all(a == b for a, b in got)


def test_pairs_do_not_depend_on_the_number_of_documents(spark):
    item = " ".join(f"a{i}" for i in range(40))
    few = [(1, f"x {item} y")]
    assert run(spark, few, [(1, item)]).keys() == {k for k in run(spark, [*few, *((100 + i, f"t{i} u v") for i in range(3000))], [(1, item)])}


def test_a_copy_in_most_documents_is_found(spark, monkeypatch):
    monkeypatch.setattr(L, "RARE_DOCUMENTS", 10)
    item = " ".join(f"a{i}" for i in range(40))
    assert len(run(spark, [(i, f"x{i} {item} y") for i in range(60)], [(1, item)])) == 60  # none of its seeds is rare


def test_index_of_a_whole_block_is_small():
    import resource

    rnd = random.Random(1)
    vocabulary = [f"term{i}" for i in range(50_000)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ix = ItemIndex.of((i, " ".join(rnd.choices(vocabulary, k=130))) for i in range(17_500))  # about 20 million characters
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    arrays = sum(getattr(ix, f).nbytes for f in ("ids", "at", "seed_codes", "post_at", "post_items", "need", "seed", "seed_at"))
    assert arrays < 120e6 and grown < 900, (arrays, grown)
