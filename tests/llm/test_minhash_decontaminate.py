"""Near-duplicates and decontamination against brute force."""

import random

import numpy as np
import pytest

from corpusloom.llm import components, decontaminate, minhash


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 5) for i, t in rows], "doc_id long, text string, n int, same string, id string, component_id int")


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, k))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


def mutated(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"m{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "ONE", "one two", "One  TWO", "one two three"]
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice((12, 60, 200)))]
        texts += [mutated(rng, base, rng.randint(0, len(base) // 10 + 1)) for _ in range(rng.choice((1, 4, 25)))]
        texts += [" ".join(base)] * rng.choice((0, 3))
    shared = " ".join(f"line{i}" for i in range(30))
    texts += [shared + " " + " ".join(f"u{k}x{i}" for i in range(40)) for k in range(20)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("words", [2, 5])
def test_components_are_exact(spark, words):
    rows = corpus(words)
    got = minhash.near_duplicates(docs(spark, rows), words, 80).collect()
    want = brute(rows, words)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    sizes = {i: len(shingles(t, words)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id]) for r in got)
    kept = minhash.near_dedup(docs(spark, rows), words, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, c in want.items() if i == c}) and kept.columns == docs(spark, []).columns


@pytest.mark.parametrize("limit", [("BLOCK_SHINGLES", 300), ("BLOCK_CLASSES", 9)])
def test_blocks_lose_nothing(spark, monkeypatch, limit):
    """With tiny blocks a group is dealt over many tasks, and the result is the same."""
    monkeypatch.setattr(minhash, *limit)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, mutated(rng, base, rng.randint(0, 7))) for i in range(80)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), 2, 80).collect()}
    assert got == brute(rows, 2)


def test_edges(spark):
    assert minhash.near_duplicates(docs(spark, []), 2, 80).collect() == []
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (9, "a b c"), (-3, "z")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows), 2, 80).collect()), key=str)
    assert got == sorted([(None, 2, None, None), (5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False), (-3, 1, -3, True)], key=str)
    assert sorted((r.doc_id for r in minhash.near_dedup(docs(spark, rows), 2, 80).collect()), key=str) == [-3, 5, 5, None]


def test_rows_of_one_document(spark):
    """Rows that share a doc_id are one document, so their texts' groups are one."""
    a, b, c = ("all of this is text number one", "quite another story of the second kind", "nothing here is like the rest")
    rows = [(0, b), (1, a), (1, b), (2, a), (3, c), (4, None), (4, c), (7, ""), (7, "")]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows), 2, 80).collect()}
    assert got == {(0, 6): (0, True), (1, 6): (0, False), (2, 6): (0, False), (3, 5): (3, True), (4, 0): (3, False), (4, 5): (3, False), (7, 0): (7, True)}
    assert sorted(r.doc_id for r in minhash.near_dedup(docs(spark, rows), 2, 80).collect()) == [0, 3, 7, 7]


def test_ends_agree_as_often_as_sets_are_alike():
    """Min-max hashing is unbiased: the share of equal ends is near the similarity."""
    rng = np.random.default_rng(0)
    m, shares = minhash.MinMax(), []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = x[:270], np.concatenate([x[30:270], x[270:]])  # 240 of 300
        shares.append(float((m.ends(a) == m.ends(b)).mean()))
    assert abs(np.mean(shares) - 0.8) < 0.02


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, None), (None, 1), (5, 5)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert got == {x: root(x) for x in up}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- decontamination -----------------------------------------------------------------------------------------------------------------

ITEMS = [
    (1, "Alice has 3 apples and gives Bob 2 of them , so how many apples does Alice have left over in the end ?"),
    (2, "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall tree"),
    (3, "short item"),
    (4, None),
]


def pairs(spark, texts, items=ITEMS):
    d = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, item int")
    b = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, kind string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, b).collect()}, d, b


def test_decontamination(spark):
    texts = [
        (0, "before words " + ITEMS[0][1] + " after words"),
        (1, "Carol has 7 apples and gives Dave 5 of them , so how many apples does Carol have left over in the end ?"),
        (2, "Carol has 7 apples and gives Dave 5 of them , so how many apples does Erin have left over in the end ?"),
        (3, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG WHILE SEVEN WISE OWLS WATCH FROM A TALL TREE"),
        (4, "the quick brown fox jumps over something else and then it goes on with other words for a while"),
        (5, "Short item!"),
        (6, "a short item in a text"),
        (7, None),
        (8, ""),
        (None, ITEMS[1][1]),
        (9, "x " * 3000 + ITEMS[1][1] + " y" * 3000),
        (9, "an innocent text of the same document id"),
    ]
    got, d, b = pairs(spark, texts)
    assert set(got) == {(0, 1), (1, 1), (3, 2), (5, 3), (None, 2), (9, 2)}
    assert got[0, 1].n_exact == got[0, 1].n_windows and got[1, 1].n_exact < got[1, 1].n_found
    kept = decontaminate.decontaminate(d, b)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 4, 6, 7, 8, None], key=str) and kept.columns == d.columns


def test_slots_agree_over_alignments_and_both_ways(spark):
    texts = [
        (0, "Carol has 7 apples and gives Dave 5 of them , so now please say how many apples does Carol have left over in the end ?"),  # words put in
        (1, "Carol has 7 apples and gives Dave 5 of them , so now please say how many apples does Erin have left over in the end ?"),  # Alice is Carol, then Erin
        (2, "Carol has 7 apples and gives Carol 5 of them , so how many apples does Carol have left over in the end ?"),  # Alice and Bob are both Carol
        (3, "Carol has 7 apples and gives Dave 5 of them , so how many apples does Erin have left over in the end ? " + "x " * 40 + "Finn has 8 apples and gives Gail 6 of them , so how many apples does Finn have left over in the end ?"),
        (4, "Alice has 7 apples and gives Dave 5 of them , so how many apples does Alice have left over in the end ?"),
    ]
    assert set(pairs(spark, texts, ITEMS[:1])[0]) == {(0, 1), (3, 1), (4, 1)}
    items = [(1, "Ann Lee , Bob Ray , Cy Fox and Dee Orr weigh 61 , 72 , 58 and 66 kg ; find the mean weight of Ann Lee and Bob Ray .")]
    texts = [
        (0, "Eve Poe , Flo Kim , Gus Law and Hal May weigh 50 , 81 , 77 and 93 kg ; find the mean weight of Eve Poe and Flo Kim ."),
        (1, "Eve Poe , Flo Kim , Gus Law and Hal May weigh 50 , 81 , 77 and 93 kg ; find then please the mean weight of Eve Poe and Flo Kim ."),
        (2, "Eve Poe , Flo Kim , Eve Poe and Flo Kim weigh 50 , 81 , 50 and 81 kg ; find the mean weight of Gus Law and Hal May ."),
    ]
    assert set(pairs(spark, texts, items)[0]) == {(0, 1), (1, 1)}


def test_decontamination_without_rows(spark):
    assert pairs(spark, [])[0] == {} and pairs(spark, [(1, "a b c d e f")], [])[0] == {}
    assert pairs(spark, [(1, "a b c d e f")], [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f")])[0].keys() == {(1, 7), (1, None)}


DENSE = "Ann Lee, Bob Ray, Cy Fox and Dee Orr weigh 61, 72, 58 and 66 kg; find the mean weight of all four."


def test_items_dense_in_placeholders(spark):
    items = [(1, DENSE), (2, "What Is The Sum Of 17 And 25 Minus 4 ?")]
    texts = [
        (0, "so: Eve Poe, Flo Kim, Gus Law and Hal May weigh 50, 81, 77 and 93 kg; find the mean weight of all four."),
        (1, "Eve Poe, Flo Kim, Gus Law and Hal May weigh 50, 81, 77 and 50 kg; they are all of one team."),
        (2, "Tell me : What Is The Sum Of 31 And 8 Minus 6 ?"),
        (3, "Tell me Why He Met The Men Of 31 And 8 Minus 6"),
    ]
    assert set(pairs(spark, texts, items)[0]) == {(0, 1), (2, 2)}


FARMER = "a farmer sells all of the eggs from the barn and then counts how many hens are left"
LONG = "every evening the old clockmaker counted eleven silver gears beneath a lantern shaped like a sleeping heron while rain fell on the roof"


def test_items_with_edits(spark):
    texts = [
        (0, "once " + FARMER.replace("counts", "tells") + " again"),
        (1, "once " + FARMER.replace("and then", "and only then") + " again"),
        (2, "some words , " + " ".join(LONG.split()[:15]) + " and nothing more of it"),
        (3, "some words , " + " ".join(LONG.split()[:9]) + " and nothing more of it"),
        (4, "a farmer sells all of the milk from the cows and then asks how many of them are left"),
    ]
    assert set(pairs(spark, texts, [(1, FARMER), (2, LONG)])[0]) == {(0, 1), (1, 1), (2, 2)}


def test_short_items_inside_texts(spark):
    items = [(1, "What is 7 + 5?"), (2, "今日は、雨です。"), (3, "Bo ate 3 pears"), (4, "owl")]
    texts = [(0, "We ask: what is 7 + 5? Say it."), (1, "What is 7 + 6?"), (2, "朝、今日は、雨です。明日は"), (3, "so Al ate 9 pears"), (4, "an owl."), (5, "owls and"), (6, "owl")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_found) for r in decontaminate.contaminated(d, b, short_inside=True).collect()}
    assert got == {k: (1, 1) for k in [(0, 1), (2, 2), (3, 3), (4, 4), (6, 4)]}
    assert [r.doc_id for r in decontaminate.decontaminate(d, b, short_inside=True).orderBy("doc_id").collect()] == [1, 5]
