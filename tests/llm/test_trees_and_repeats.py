"""Prefix trie, Merkle manifest and substring dedup against brute force, on rows chosen to be awkward."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ringlore.llm import fm_index, manifest, prefix_trie, repeats
from ringlore.llm.common import new_path

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
words_of = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]

# --- prefix trie


def brute_trie(turns):
    own = {}
    for c, turn, role, text, *_ in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + x[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], set()).add(c)
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(r[: len(q)] == q and len(r) > len(q) for r in below) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(words_of(q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if paths[c] == p)))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), leaves, saved, sha(ends)))
    return out


TURNS = "conv_id long, turn long, role string, text string, path string, shard long"


def trie(spark, turns, **sizes):
    rows = spark.createDataFrame(turns, TURNS).repartition(3)
    got = prefix_trie.prefix_nodes(prefix_trie.rebuilt(prefix_trie.conversation_rows(rows)), **sizes)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def awkward_turns():
    r, turns = random.Random(5), []
    for c in range(90):
        for t in range(r.choice([0, 1, 1, 2, 3, 6])):
            turns.append((c, t, r.choice(["user", "assistant"]), r.choice(["a b", "c", "", None, "a  b\t c"]), "x", 1))
    # copies of one conversation, nulls, ties, a repeated row, no id, one far longer than the others
    turns += [(c, t, "user", f"turn {t}", "x", 1) for c in range(200, 240) for t in range(3)]
    turns += [(300, None, None, None, "x", 1), (300, 4, None, "z", "x", 1), (300, 4, "a", "y", "x", 1), (300, 4, "a", "y", "x", 1), (300, 4, "a", "x", "x", 1), (None, 0, "user", "lost", "x", 1)]
    return turns + [(400, t, "user", "long", "x", 1) for t in range(300)]


@pytest.mark.parametrize(("rows", "turns", "fan_in"), [(4096, 1 << 16, 64), (1, 1 << 16, 2), (3, 4, 2), (7, 50, 3)])
def test_trie(spark, rows, turns, fan_in):
    data = awkward_turns()
    if (rows, fan_in) != (4096, 64):
        data = [t for t in data if t[0] != 400] + [(400, t, "user", "long", "x", 1) for t in range(20)]
    assert trie(spark, data, shard_rows=rows, shard_turns=turns, fan_in=fan_in) == brute_trie(data)


def test_trie_of_hot_turns(spark):
    # all begin alike, half are the same throughout: one group over many shards
    data = [(c, t, "user", f"t{t}" if t < 2 or c % 2 else f"own {c}", "x", 1) for c in range(0, 2400, 7) for t in range(4)]
    assert trie(spark, data, shard_rows=10, fan_in=4) == brute_trie(data)


def test_trie_of_nothing(spark):
    assert trie(spark, []) == set()
    assert trie(spark, [(None, 0, "user", "x", "x", 1)]) == set()


def test_shard_with_only_the_root(spark):
    # conversation 1 keeps nothing: its base is absent and it has no turns after the first
    lone = next(c for c in range(1, 40) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 0)
    data = [(lone, 0, "user", "x", "x", 1)]
    assert trie(spark, data) == brute_trie(data) == {(lone, 0, None, 1, 0, 1, 0, sha(str(lone)))}


# --- Merkle manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, rank long, branch string, digest string"


def brute_proofs(rows, lowered=lambda text: text):
    cell = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    digest = lambda r, text: sha("".join(map(cell, (r[0], r[3], r[2], r[4], text))))
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, digest(r, r[1]), digest(r, lowered(r[1]))))
    tops, out = [], []

    def climb(nodes):
        paths, level = [[] for _ in nodes], [(h, [i]) for i, h in enumerate(nodes)]
        while len(level) > 1:
            above = []
            for a in range(0, len(level), 8):
                run = level[a : a + 8]
                for k, (_, below) in enumerate(run):
                    for i in below:
                        paths[i].append(("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1 :])))
                above.append((sha("".join(h for h, _ in run)), [i for _, b in run for i in b]))
            level = above
        return level[0][0], paths

    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        langs[name].sort()
        tops.append(climb([x[2] for x in langs[name]]))
    root, trunk = climb([t for t, _ in tops])
    for name, (subroot, paths), up in zip(names, tops, trunk):
        for (known, i, leaf, altered), path in zip(langs[name], paths):
            path = path + up
            h = altered
            for before, after in path:
                h = sha(before + h + after)
            out.append((i if known else None, leaf, subroot, root, sha("".join(a + b for a, b in path)), h))
    return sorted(out, key=repr)


def proofs(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    docs = docs.withColumn("altered", manifest.leaf_digest([F.lower("text") if f == "text" else F.col(f) for f in manifest.FIELDS]))
    path = new_path(spark, "test-merkle")
    manifest.write_manifest(docs, path, carry=("altered",))
    got = manifest.prove(spark, path)
    got = got.select("id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")), manifest.folded(F.col("carry_altered"), F.col("path")))
    return sorted(map(tuple, got.collect()), key=repr), path


def doc(i, text, lang, source="s", n=1):
    return (i, text, lang, source, n, "l", 1, "b", "d")


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 1, None: 1}, {"en": 8}, {"en": 9, "de": 1, "": 2}, {"en": 70, "fr": 65, None: 3, "é": 1, "z": 64}, {f"l{i}": 1 for i in range(20)}])
def test_merkle(spark, sizes):
    rows = [doc(k, f"Text {k} É\x00" if k % 3 else None, lang, None if k % 5 else "s", k if k % 2 else None) for lang, n in sizes.items() for k in range(n)]
    assert proofs(spark, rows)[0] == brute_proofs(rows, lambda t: t and t.lower())


def test_merkle_of_odd_rows(spark):
    # null ids, equal ids, repeated rows: 20 of them make equal runs, which the store holds once
    rows = [doc(None, "A", "en"), doc(None, "B", "en"), doc(3, "A", "en"), doc(3, "B", "en")] + [doc(7, "Same", "de")] * 20 + [doc(1, "x" * 200_000, None), doc(None, None, None, None, None)]
    got, path = proofs(spark, rows)
    assert got == brute_proofs(rows, lambda t: t and t.lower())
    records = spark.read.parquet(f"{path}/records")
    assert records.count() == records.select("digest").distinct().count()
    assert proofs(spark, [])[0] == []


def test_merkle_requests(spark):
    rows = [doc(k, f"T{k}", "en" if k % 4 else "de") for k in range(150)]
    everything, path = proofs(spark, rows)
    some = spark.createDataFrame([(0, 5), (1, 100), (1, 100), (1, 0), (9, 9)], "branch long, rank long")
    got = manifest.prove(spark, path, some)
    assert sorted(r.id for r in got.collect()) == sorted([20, 134, 1])
    assert {r.leaf for r in got.collect()} <= {x[1] for x in everything}


# --- substring dedup


def brute_repeats(rows, window):
    from xxhash import xxh64_intdigest

    def hashed(t):
        h = xxh64_intdigest(t.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    many = len({r[0] for r in rows}) < len(rows)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashed(rows[k][1] or "") if many else 0))
    seen, out = set(), []
    for k in order:
        words = words_of(rows[k][1])
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((rows[k][0], len(words), sum(gone), " ".join(kept)))
    return sorted(out, key=repr)


TEXTS = "doc_id long, text string, tie string, at long, copy boolean, anchor string, kept string"


def removed(spark, rows, **sizes):
    df = spark.createDataFrame([(i, t, "t", 1, True, "a", "k") for i, t in rows], TEXTS).repartition(3)
    return sorted(map(tuple, repeats.remove_repeats(df, **sizes).collect()), key=repr)


def awkward_texts(n=60, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    shared = [" ".join(word() for _ in range(r.choice([19, 20, 21, 40, 90]))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 4))]
        parts += [r.choice(shared) for _ in range(r.choice([0, 0, 1, 2]))]
        r.shuffle(parts)
        texts.append(r.choice([" ", "\n", "\t \r\n"]).join(parts))
    # periodic texts, one word over and over, copies, near copies, nothing
    texts += ["a " * 100, "a b " * 60, "x y z " * 30 + "end", " ".join("ab" for _ in range(20)), None, "", " \t\n", "one", "\x1c\x85 \xa0"]
    texts += texts[:6] + [texts[3].replace(" ", "  ", 5), (texts[5] or "") + " tail", " ".join([shared[0]] * 5)]
    return list(enumerate(texts))


@pytest.mark.parametrize("sizes", [{}, {"window": 3, "gram": 2}, {"window": 5, "gram": 5}, {"most_pieces": 2}, {"shard_words": 60}, {"window": 20, "gram": 1, "most_pieces": 1}])
def test_repeats(spark, sizes):
    rows = awkward_texts()
    assert removed(spark, rows, **sizes) == brute_repeats(rows, sizes.get("window", 20))


def test_repeats_of_odd_rows(spark):
    rows = awkward_texts(20)
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows += [(3, rows[5][1]), (3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, rows[6][1]), (None, "short"), (None, "short"), (500, long)]
    assert removed(spark, rows) == brute_repeats(rows, 20)
    assert removed(spark, []) == []


def test_repeats_of_a_hot_passage(spark):
    # a passage in every document, each time between other words: one anchor with as many different pieces as documents
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{' '.join(f'b{i}x{k}' for k in range(25))} {passage} {' '.join(f'e{i}x{k}' for k in range(25))}") for i in range(400)]
    want = brute_repeats(rows, 20)
    assert removed(spark, rows) == want and removed(spark, rows, most_pieces=50) == want
    assert sum(x[2] for x in want) == 30 * 399


def test_fm_index():
    r = random.Random(1)
    for case in range(40):
        window, kinds = r.choice([1, 2, 3, 5, 20]), r.choice([1, 2, 5, 50])
        pieces = [[b"%d" % r.randrange(kinds) for _ in range(r.randrange(window, window + 16))] for _ in range(r.randrange(1, 40))]
        pieces += pieces[:5] if case % 3 == 0 else []
        seen = set()
        for piece, again in zip(pieces, fm_index.repeated_windows(pieces, window)):
            assert len(again) == len(piece) - window + 1
            for i, x in enumerate(again):
                w = tuple(piece[i : i + window])
                assert x == (w in seen)
                seen.add(w)


def test_wavelet_rank_and_suffix_order():
    r = np.random.default_rng(3)
    for kinds in (1, 2, 3, 40, 300):
        values = np.minimum((r.pareto(0.8, 2000)).astype(np.int64), kinds - 1)
        tree = fm_index.WaveletTree(values, kinds)
        symbol, at = r.integers(0, kinds, 500), r.integers(0, 2001, 500)
        assert tree.rank(symbol, at).tolist() == [int((values[:a] == s).sum()) for s, a in zip(symbol, at)]
    text = np.array([2, 1, 2, 1, 0, 2, 1, 0, 0, 3, 0])
    gaps = np.cumsum(text == 0)
    suffixes = [[(0, int(gaps[j])) if text[j] == 0 else (1, int(text[j])) for j in range(i, len(text))] for i in range(len(text))]
    assert fm_index.suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: suffixes[i])


def test_matching_statistics():
    # words before the end of a window that also stand elsewhere: none, some, all
    pieces = [[b"a", b"b", b"c"], [b"x", b"b", b"c"], [b"y", b"y2", b"z"], [b"a", b"b", b"c"]]
    known = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for p in pieces for w in p))}
    symbols = np.array([s for p in pieces for s in [*(known[w] for w in p), 0]])
    matched, place = fm_index.FMIndex(symbols).matching(np.array([0, 4, 8, 12]), 3)
    assert matched.tolist() == [3, 2, 0, 3] and place[0] == place[3] >= 0 and place[1] == place[2] == -1
