"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

from ringlore.llm import minhash


def brute_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_links(sets):
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}


def brute_stay(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {find(i) for i in ids}


def corpus(seed=9):
    """Texts with edited copies on both sides of the threshold, a chain of copies of copies, short and empty ones."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    texts = [None, "", " ", "a", "A", "a b c", "a b c d", "a b c d e", "a b c d e f"]
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.randint(60, 400))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.randint(1, max(2, len(base) // 40))):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    base = [r.choice(words) for _ in range(300)]
    for _ in range(80):
        base[r.randrange(300)] = r.choice(words)
        texts.append(" ".join(base))
    r.shuffle(texts)
    return list(enumerate(texts))


def test_stage_finds_edited_copies(spark):
    import corpus_pipeline

    rows = corpus()
    sets = brute_sets(rows)
    links = brute_links(sets)
    assert len(links) > 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == brute_stay(sets, links)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.drop_near_duplicates(docs).count() == 0


def test_recall_of_bands_at_the_threshold():
    """Of pairs of similarity 0.8 nearly all share a key."""
    import numpy as np

    flips, odd = minhash._factors()
    r, met = np.random.default_rng(4), 0
    for _ in range(2000):
        x = r.integers(0, 1 << 64, 220, np.uint64)
        a, b = x[:200], np.concatenate([x[:178], x[200:]])
        assert 178 / 222 > 0.8 and len({*a.tolist()} & {*b.tolist()}) == 178
        b = np.concatenate([b, r.integers(0, 1 << 64, 2, np.uint64)])
        met += bool((minhash.band_keys(a, flips, odd) == minhash.band_keys(b, flips, odd)).any())
    assert met >= 1990


def test_fingerprints_bring_copies_together_before_the_bands(spark):
    """Texts that differ in one word of hundreds share a group by pivot tables whatever their bands are; others do not."""
    import numpy as np
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in r.integers(0, 5000, 900)) for _ in range(6)]
    docs = spark.createDataFrame([(2 * i + j, t + (" end" if j else "")) for i, t in enumerate(base) for j in (0, 1)], "doc_id long, text string")
    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    nodes = rows.mapInArrow(minhash._keys_task(5), "doc_id long, text_hash long, node long, size long, fp long, keys array<long>")
    keyed = minhash._print_keyed(nodes).join(nodes.select("node", "doc_id"), "node").collect()
    groups = {x.doc_id: x.key for x in keyed}
    assert len(groups) == 12 and len(set(groups.values())) == 6 and all(groups[2 * i] == groups[2 * i + 1] for i in range(6))
