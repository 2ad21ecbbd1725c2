import hashlib
import zlib

import numpy as np
import pytest

from weirflow.llm import manifest

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, `rank` string"


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, f):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + f])) for i in range(0, len(levels[-1]), f)])
    return levels


def path(levels, i, f):
    out = []
    for level in levels[:-1]:
        run, at = level[i // f * f : i // f * f + f], i % f
        out.append((at, run[:at] + run[at + 1 :]))
        i //= f
    return out


def brute(rows, f=8):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]], f) for g in order}
    top = tree([trees[g][-1][0] for g in order], f)
    root, out = top[-1][0], []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            proof, x = path(trees[g], i, f) + path(top, k, f), leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                x = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for at, beside in proof:
                x = H("".join(beside[:at] + [x] + beside[at:]))
            out.append((r[0], leaf(r), trees[g][-1][0], root, H("".join("".join(b) for _, b in proof)), x, x == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("levels", "fanout"), [(n, f) for f in (2, 3, 8) for n in range(1, 6)])
def test_layout(levels, fanout):
    """Every address once; the top half first, then each lower subtree in one stretch, and so on inside."""
    depths = [manifest.address(d, np.arange(fanout**d), levels, fanout) for d in range(levels)]
    assert sorted(np.concatenate(depths)) == list(range(manifest.nodes_of(levels, fanout)))

    def laid(depth, number, own):
        if own == 1:
            return [int(depths[depth][number])]
        top = own // 2
        out = laid(depth, number, top)
        for child in range(fanout**top):
            out += laid(depth + top, number * fanout**top + child, own - top)
        return out

    assert laid(0, 0, levels) == list(range(manifest.nodes_of(levels, fanout)))


@pytest.mark.parametrize("count", [1, 2, 7, 8, 9, 64, 65, 100])
def test_block(count):
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(count)]
    height = manifest.levels_of(count, 8)
    block = manifest.Block.built(digests, height, 8)
    levels = tree([d.hex() for d in digests], 8)
    assert block.root().hex() == levels[-1][0]
    for i, (beside, shape) in enumerate(manifest.Block(count, height, 8, block.nodes.tobytes()).proofs()):
        want = path(levels, i, 8)
        assert beside.hex() == "".join("".join(b) for _, b in want) and list(shape) == [x for at, b in want for x in (at, len(b))]
        assert manifest.folded(digests[i], beside, shape) == block.root()


def rows_of(n, languages):
    return [(i * 7 % 5000 if i % 11 else None, f"s{i % 3}" if i % 5 else None, languages[i % len(languages)], i if i % 4 else None, f"Text É {i}" if i % 6 else None, "clash") for i in range(n)]


@pytest.mark.parametrize(("step", "n"), [(1, 1), (1, 70), (1, 700), (2, 700), (2, 64), (4, 700)])
def test_whole_and_many_blocks(spark, step, n):
    rows = rows_of(n, ["en", None, "de", "é", "", "en", "en", "en", "en", "en"])
    docs = spark.createDataFrame(rows + rows[:3], SCHEMA).repartition(5)
    made = manifest.manifest(docs, step=step)
    want = brute([r[:5] for r in rows + rows[:3]])
    assert made.root.hex() == want[0][3]
    got = sorted(((r.id, bytes(r.digest).hex(), bytes(r.top).hex(), hashlib.sha256(bytes(r.proof).hex().encode()).hexdigest()) for r in made.proofs().collect()), key=repr)
    assert got == sorted(((w[0], w[1], w[2], w[4]) for w in want), key=repr)
    if step == 1 and n == 700:
        assert len(made.levels) == 3
    made.close()


def test_report(spark):
    rows = rows_of(300, ["en", None, "de", "en", "fr", "ru", "xx", "yy", "zz", "aa", "en"]) + [(1, "s", "en", 5, "A" * 100_000, ""), (2, None, None, None, None, None), (3, "s", "lone", 1, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = manifest.report(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute([r[:5] for r in rows])
    assert 0 < got.where("not verified").count() < 150
    one = manifest.report(docs.where("lang = 'lone'")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == H("") and one.verified
    assert manifest.report(docs.limit(0)).count() == 0


def test_many_groups(spark):
    rows = [(i, "s", f"g{i % 150}", 1, "x", "") for i in range(400)]
    assert sorted(map(tuple, manifest.report(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute([r[:5] for r in rows])
