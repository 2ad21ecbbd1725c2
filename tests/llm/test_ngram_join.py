import itertools
import random

import pytest

from weirflow.llm.ngram_join import join_report, ngram_join, stop_depth, thin


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """{doc_id: (class_id, class_size, links)} by comparing all pairs."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = {}
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= 0.8 * len(a | b):
            root[find(j)] = find(i)
            if a != b:
                near.setdefault(i, set()).add(b)
                near.setdefault(j, set()).add(a)
    out = []
    for i, (d, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        out.append((d, min((x for x in own if x is not None), default=None) if sets[i] else None, len(own) if sets[i] else 1, len(near.get(i, ()))))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(rng.choice([1, 2, 6])):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n "), (n + 3, rows[0][1]), (n + 3, rows[0][1]), (n + 4, rows[4][1].upper() + "  "), (0, "same id other text here now"), (None, "one two"), (n + 5, " one  two")]
    rows.append((n + 6, " ".join(rng.choice(words) for _ in range(30_000))))
    return rows


def test_stop_depth():
    assert stop_depth(0.8, 16, 8, 0.99) == 6 and stop_depth(0.8, 16, 8, 0.9999) < 5
    with pytest.raises(ValueError):
        stop_depth(0.1, 1, 8, 0.99)


@pytest.mark.parametrize("options", [{}, {"block_members": 2, "block_shingles": 100}])
def test_matches_brute_force(spark, options):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.id, r.class_id, r.class_size, r.links) for r in ngram_join(docs, **options).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_recall_over_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(((r.doc_id, r.class_id, r.class_size, r.links) for r in join_report(docs).collect()), key=repr)
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)


def test_thin_and_empty(spark):
    assert join_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(2, "a b c d e f", 1, "x"), (1, "A b c d e f", 2, "y"), (3, None, 3, "z"), (1, "A b c d e f", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, key string")
    assert sorted(tuple(r) for r in thin(docs).collect()) == [(1, "A b c d e f", 2, "y"), (3, None, 3, "z")]


def test_all_links_of_a_large_class(spark):
    """Copies at about the threshold, many of which share no trie node with each other."""
    rng = random.Random(11)
    base = ["w%d" % i for i in range(150)]
    rows = []
    for i in range(120):
        text = list(base)
        for at in rng.sample(range(150), 2):
            text[at] = f"x{i}y{at}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"block_members": 30}):
        got = [(r.id, r.class_id, r.class_size, r.links) for r in ngram_join(docs, **options).collect()]
        assert sorted(got, key=repr) == brute(rows)
