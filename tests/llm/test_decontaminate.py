import random

import pytest

import corpus_pipeline
from weirflow.llm.decontaminate import RATE, Matcher, bits, clean, leaks, myers, pieces, plain
from weirflow.llm.queries import queries


def nearest(pattern, text):
    """(distance, first end) over all substrings, by dynamic programming."""
    row = list(range(len(pattern) + 1))
    best = (len(pattern), 0)
    for j, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, (row[-1], j))
    return best


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "x", "yz", text[i] + "q"]) + text[i + 1 :]
    return text


def test_myers_and_matcher_match_brute_force():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(30)]
    matcher = Matcher(items)
    for trial in range(60):
        i, item = rng.choice(items)
        text = plain(" ".join(word() for _ in range(20)) + " " + edited(rng, item, rng.randrange(0, 9)) + " " + " ".join(word() for _ in range(20)))
        assert myers(bits(plain(item)), len(plain(item)), text, 0, len(text)) == nearest(plain(item), text)
        want = {j: d for j, t in items if (d := nearest(plain(t), text)[0]) <= int(len(plain(t)) * RATE)}
        got = matcher.find(text)
        assert {j: d for j, _, _, d in got} == want
        for j, start, end, d in got:
            p = plain(dict(items)[j])
            assert nearest(p, text[start:end])[0] == d and abs(end - start - len(p)) <= d


def test_pieces():
    assert pieces("abc") == [(0, "abc")]
    got = pieces("x" * 100)
    assert len(got) == 6 and sum(len(p) for _, p in got) == 100


def test_tables(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from the farm at night"
    docs = spark.createDataFrame(
        [(1, f"so {item.upper()}  ok", 5), (2, "clean text", 6), (3, None, 7), (4, "", 8), (5, item.replace("fox", "f0x").replace(" ", "\n"), 9), (5, item, 9), (6, "z" * 150_000 + item, 1)],
        "doc_id long, text string, item_id int",
    )
    items = spark.createDataFrame([(1, item), (2, ""), (3, None), (None, "clean text"), (4, "brown cow")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in leaks(docs, items).collect())
    assert got == [(1, 1, 0), (5, 1, 0), (5, 1, 1), (6, 1, 0)]
    assert sorted((r.doc_id, r.item_id, r.distance) for r in leaks(docs, items, block_chars=5).collect()) == got
    assert sorted(tuple(r) for r in clean(docs, items).collect()) == [(2, "clean text", 6), (3, None, 7), (4, "", 8)]
    assert clean(docs.limit(0), items).count() == 0 and clean(docs, items.limit(0)).count() == 7
    assert leaks(docs, items.limit(0)).columns == ["doc_id", "item_id", "start", "end", "distance"]


@pytest.mark.parametrize("block_chars", [1_000_000, 5])
def test_two_texts_of_one_id_and_a_null_id(spark, block_chars, tmp_path):
    a, b, c = "first passage under this id", "second and other passage here", "an item without any id at all"
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"{b} {a}"), (3, f"so {c}"), (4, "clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(7, a), (7, b), (7, b), (None, c), (None, "no such text in here")], "item_id long, text string")
    want = [(1, 7, 2), (2, 7, 0), (2, 7, len(b) + 1), (3, None, 3)]
    found = leaks(docs, items, block_chars=block_chars, unnamed=True).collect()
    assert sorted((r.doc_id, r.item_id, r.start) for r in found) == want
    assert [r.doc_id for r in clean(docs, items, block_chars=block_chars, unnamed=True).collect()] == [4]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((r.doc_id, r.item_id, r.start) for r in queries()["op10_decontamination"](spark, str(tmp_path)).collect()) == want
    assert [r.doc_id for r in corpus_pipeline.clean(spark, docs, str(tmp_path)).collect()] == [4]
