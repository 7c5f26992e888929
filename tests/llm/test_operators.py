"""Each operator against brute force, on rows chosen to be awkward."""

import base64
import hashlib
import json
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ringlore.llm import ann, bpe, exact_dedup, packing, pii, quality, sharding, simhash, textcodes, token_store, tool_chat
from ringlore.llm.common import new_path, numbered, running_total
from ringlore.operators.graph import connected_components
from test_near_dedup import brute_links, brute_sets, brute_stay

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, size string, _id string, node int"
WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))
ODD = [None, "", " ", "\t\n ", "a", "a  b", "  lead", "trail  ", "don't  we 'll", "tab\tx\t y\n\n z", "é́ ́a b", "\x1c b\x85 y", "　 全角 字", "Σας ΣΑΣ İx", "<|endoftext|> x", "x" * 3000, "12.5 %%% !!"]


def rows_of(texts, first=0):
    return [(first + i, t, "en", "s", None if t is None else len(t), "r", "d", "9", "i", 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 9))) for _ in range(300)]
    texts = ODD + [" ".join(r.choice(words) for _ in range(r.randint(1, 900))) for _ in range(40)]
    rows = rows_of(texts + texts[20:30] + [texts[40].replace(" ", "\n", 3)])
    return spark.createDataFrame(rows + [rows[25], rows[25]] + [(None, "no id", None, None, None, None, None, None, None, None)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "drop"), [(WORD, True), (BYTE, False)])
def test_coder_equals_library(path, drop, plain):
    own, encode = textcodes.TextCoder(textcodes.LibraryEncoder(path), drop, limit=50), library(path)
    for start in range(0, len(plain), 7):  # several batches, so that the memo turns over
        texts = [t for _, t in plain[start : start + 7]]
        ids, at = own.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [encode(t) for t in texts]


def test_token_store(spark, docs, empty, plain):
    path, encode = new_path(spark, "t"), library(WORD)
    token_store.write_store(docs, WORD, path, fan=8)
    got = token_store.read_store(spark, path, fan=8).orderBy("start").collect()
    expected = sorted(((-1 if i is None else i), encode(t) + [1]) for i, t in plain)
    at = 0
    assert len(got) == len(expected)
    for r, (i, ids) in zip(got, expected):
        assert (-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        at += len(ids)
    assert sorted((r.n_tokens, bytes(r.ids)) for r in got) == sorted((len(x), np.array(x, "<u4").tobytes()) for _, x in expected)
    chunks, recipes, manifest = (spark.read.parquet(f"{path}/{t}") for t in ("chunks", "recipes", "manifest"))
    assert chunks.count() == chunks.select("digest").distinct().count()
    top = manifest.orderBy(F.desc("level")).collect()
    assert top[0].level > top[1].level and (top[0].at, top[0].documents, top[0].tokens) == (0, len(plain), at)
    swapped = chunks.withColumn("payload", F.first("payload").over(Window.orderBy("digest").rowsBetween(-(1 << 30), 1 << 30)))
    shortest = chunks.orderBy("n").limit(1).select("digest")
    damaged = [
        (swapped, recipes, manifest), (chunks.join(shortest, "digest", "left_anti"), recipes, manifest), (chunks, recipes.where("start > 0"), manifest),
        (chunks, recipes.withColumn("doc_id", F.col("doc_id") + 1), manifest), (chunks, recipes.withColumn("digests", F.slice("digests", 1, 1)), manifest),
        (chunks, recipes, manifest.where(f"level < {top[0].level}")), (chunks, recipes, manifest.withColumn("hash", F.when(F.col("level") == 0, F.unhex(F.lit("00"))).otherwise(F.col("hash")))),
    ]
    for tables in damaged:
        bad = new_path(spark, "t")
        for table, name in zip(tables, ("chunks", "recipes", "manifest")):
            table.write.parquet(f"{bad}/{name}")
        with pytest.raises(Exception, match="damaged"):
            token_store.read_store(spark, bad, fan=8).collect()
    none = new_path(spark, "t")
    token_store.write_store(empty, WORD, none)
    assert token_store.read_store(spark, none).count() == 0


def test_chunks_are_the_same_wherever_they_stand():
    r = np.random.default_rng(1)
    ids = r.integers(0, 40_000, 30_000).astype(np.uint32)
    moved = np.concatenate([r.integers(0, 40_000, 777).astype(np.uint32), ids])
    pieces = lambda x: {x[a:b].tobytes() for a, b in zip([0, *c], c)} if (c := token_store.cut_points(x, np.array([0, len(x)]))[0]) else set()
    both = pieces(ids) & pieces(moved)
    assert len(both) > 0.8 * len(pieces(ids))
    assert token_store.cut_points(np.zeros(0, np.uint32), np.array([0, 0])) == [[]]


def test_packing(docs, empty, plain):
    encode = library(BYTE)
    got = packing.pack_documents(docs, BYTE, size=64).collect()
    streams = sorted(tuple(encode(t) + [0]) for _, t in plain)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0) and len(r.ids) == 4 * r.length
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 64 and sum(f < 64 for f in fill.values()) <= docs.rdd.getNumPartitions()
    own = {}
    for r in got:
        own.setdefault(r.doc_id, {}).setdefault(r.start, []).append(np.frombuffer(r.ids, "<u4").tolist())
    for i, t in plain:
        ids, seen = encode(t) + [0], own[i]
        if sum(d == i for d, _ in plain) == 1:
            assert [x for s in sorted(seen) for x in seen[s][0]] == ids
    assert sum(r.length for r in got) == sum(map(len, streams))
    assert packing.pack_documents(empty, BYTE).count() == 0


def test_sum_of_squares_places_where_squares_grow_least():
    r, out, placed = random.Random(1), [], 0
    p = packing.SumOfSquares(50, out.append)
    for i in range(400):
        s = r.randint(1, 49)
        placed += s
        count = lambda h: p.count[h] if 0 < h < 50 else 0

        def change(h, s=s, count=count):
            after = {h: count(h) - (h > 0), h + s: count(h + s) + (h + s < 50)}
            return sum(after[x] ** 2 - count(x) ** 2 for x in after if 0 < x < 50)

        best = min(change(h) for h in range(0, 51 - s) if h == 0 or count(h) > 0)
        assert change(p.level_for(s)) == best
        p.place((i, 0, np.zeros(s, np.uint32), s))
    p.close()
    assert sum(len(x[2]) for w in out for x in w) == placed
    assert sum(sum(len(x[2]) for x in w) < 50 for w in out) <= 1


def test_exact_dedup(spark, docs, empty, plain):
    got = exact_dedup.exact_groups(docs, support=0.05).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    groups = {}
    for i, t in plain:
        groups.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append(i)
    assert len(got) == len(plain) and sum(r.kept for r in got) == len(groups)
    for r in got:
        g = groups[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == min((x for x in g if x is not None), default=None)
    kept = exact_dedup.drop_exact_duplicates(docs, support=0.05)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_pii(spark, docs, empty):
    texts = [
        "mail a.b+c@x-y.example.com, or z@@q.de @no a@b c@d.e.", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.4", "4111 1111-1111 1111 and 4111111111111112",
        "+1 (555) 010-9999 or +12 or +44 20 7946 0958.", "pay to IBAN GB82 WEST 1234 5698 7654 32 please", "card 378282246310005 here; 378282246310005", "call us 555-123-4567", "9" * 5000, "1." * 3000, "", None,
        "a" * 2000 + "@" + "b" * 2000 + ".c",
    ]
    out = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    digits = lambda s: re.sub("[^0-9]", "", s)
    for i, t in enumerate(texts):
        t = t or ""
        base = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        base += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))] if len(t) < 4000 or "." in t else []
        base += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        base += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
        assert [(s.kind, s.start, s.end) for s in out[i] if s.kind in pii.BASE] == base
    assert [s.kind for s in out[4]] == ["iban"] and [s.kind for s in out[5]] == ["short_card", "short_card"] and [s.kind for s in out[6]] == ["local_phone"]
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    clean = pii.redact_pii(spark.createDataFrame(rows_of(texts), SCHEMA))
    got = {r.doc_id: r for r in clean.collect()}
    assert got[4].text == "pay to IBAN <IBAN> please" and got[10].text is None and got[4].n_chars == len(got[4].text) and clean.columns == docs.columns
    assert pii.find_pii(empty).count() == 0 and pii.redact_pii(empty).count() == 0


def brute_prints(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(spark, docs, empty, plain):
    got = [r for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None]
    prints = {i: brute_prints(t) for i, t in plain if i is not None}
    assert all(r.fp % (1 << 64) == prints[r.doc_id] for r in got)
    part = brute_components(prints)
    assert all(r.component_id == part[r.doc_id] for r in got)
    assert simhash.near_duplicates(empty).count() == 0


def brute_pairs(prints):
    mask = (1 << 64) - 1
    return {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & mask).bit_count() <= 3}


def dense_prints(seed, n=150):
    r = random.Random(seed)
    base, prints = r.getrandbits(64), set()
    while len(prints) < n:
        x = base
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        prints.add(simhash._signed(x))
    # many that share two blocks and are far apart otherwise, with near ones here and there
    for _ in range(n):
        x = base & ((1 << 26) - 1) | r.getrandbits(38) << 26
        prints |= {simhash._signed(x), simhash._signed(x ^ 1 << r.randrange(64)), simhash._signed(x ^ 7 << r.randrange(62))}
    return prints | {simhash._signed(r.getrandbits(64)) for _ in range(50)}


@pytest.mark.parametrize("hot", [5, 40, 500])
def test_links_of_a_dense_cluster(spark, monkeypatch, hot):
    """Hot keys go through cells of the pivot table and the last keys, and no link is lost."""
    monkeypatch.setattr(simhash, "HOT", hot)
    prints = dense_prints(5)
    got = [(a.u, a.v) for a in simhash.linked_pairs(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(prints)


def test_pivot_table_discards(spark):
    """Of pairs that share two blocks and nothing else nearly all are discarded by the table, and no near one is."""
    prints = sorted(dense_prints(8, 60))
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long").withColumn("pivots", simhash._pivot_rows())
    left = {(a.u, a.v) for a in simhash._survivors(nodes.withColumn("key", F.lit(1)), nodes.withColumn("key", F.lit(1)), ["key"]).collect()}
    near = brute_pairs(prints)
    assert near <= left and len(left) - len(near) < 0.2 * (len(prints) * (len(prints) - 1) / 2 - len(near))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {a.node: a.root for a in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_sharding(spark, docs, empty, plain):
    got = sharding.shard_documents(docs, shards=7).collect()
    assert len(got) == len(plain)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len(t.encode()) + 16, zlib.crc32(t.encode())) for _, t in plain)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    same = spark.createDataFrame(rows_of(["same text here"] * 2000), SCHEMA)
    sizes = [r["n"] for r in sharding.shard_documents(same, shards=8).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.05 * min(sizes)
    path = new_path(spark, "shards")
    own = spark.createDataFrame(rows_of(["a", "b", None]), SCHEMA)
    sharding.write_shards(own, sharding.shard_documents(own, shards=2), path)
    assert spark.read.parquet(path).count() == 3
    assert sharding.shard_documents(empty).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((900, 16)).astype(np.float32)
    x[500:560] = x[0]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0] * 3, 1), (2080, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for a in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(a.query_id, []).append((a.vec_id, a.score))
    y, hits = x.astype(np.float64), 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        best = sorted(range(900), key=lambda i: (-round(s[i], 9), i))[:20]
        hits += len(set(best) & {i for i, _ in found})
        assert len(found) == 20 and all(abs(v - s[i]) < 1e-9 for i, v in found) and found == sorted(found, key=lambda t: (-t[1], t[0]))
    assert hits >= 0.9 * 20 * len(got)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(a.vec_id, a.rank) for a in ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(df.where("vec_id > 2000"), F.lit(True)).count() == 0
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0], 5), (0, [0.0, 2.0], 5), (1, [0.5, 0.5], 6), (1, [0.5, 0.4], 6), (2, [0.0, 1.0], 7)], "vec_id long, embedding array<float>, v int")
    assert [(a.query_id, a.vec_id) for a in ann.nearest(twice, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 2), (0, 1)]


def test_recall_of_learned_partitions(spark):
    """Rows far beyond the sample: on clustered vectors most parts are left out, and 0.9 of the true neighbours are found."""
    r = np.random.default_rng(6)
    centres = r.standard_normal((40, 24))
    x = (centres[r.integers(0, 40, 6000)] + 0.35 * r.standard_normal((6000, 24))).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for a in ann.nearest(df, F.col("vec_id") % 20 == 0, sample=1500).collect():
        got.setdefault(a.query_id, set()).add(a.vec_id)
    own = np.arange(0, 6000, 20)
    s = x[own] @ x.T
    s[np.arange(len(own)), own] = -np.inf
    best = np.argpartition(-s, 19, axis=1)[:, :20]
    assert np.mean([len(got[q] & set(b)) / 20 for q, b in zip(own.tolist(), best.tolist())]) >= 0.9
    router = ann.fit(x[r.permutation(6000)[:1500]], 20, 16)
    size = np.bincount(router.parts(x), minlength=router.b2.size)
    order, before = router.order(x[own])
    assert router.b2.size == 16 and (size[order] * (before < router.enough)).sum() <= 0.25 * len(own) * len(x)


def test_bpe(docs, empty, plain):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    expected = sorted((own.encode_ordinary(t), t.encode()) for _, t in plain)
    assert sorted((r.ids, bytes(r.decoded)) for r in bpe.decode_documents(encoded, RANKS).collect()) == expected
    assert sorted((r.ids, bytes(r.decoded)) for r in bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, and_decode=True).collect()) == expected
    assert bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_quality(spark, docs, empty):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(500)]
    good = [" ".join(r.choice(words) for _ in range(60)) for _ in range(240)]
    bad = [" ".join(r.choice(words).upper() + "!!" for _ in range(60)) for _ in range(120)]
    d = spark.createDataFrame(rows_of(good + bad), SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 240), 0) for i in range(360)] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels)
    out = {x.doc_id: x.score for x in quality.score_documents(d, model).collect()}
    held = [i for i in range(360) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {x.doc_id for x in d.where(quality.held_out()).collect()} == set(held)
    assert np.mean([(out[i] >= 0.7) == (i < 240) for i in held]) > 0.95
    assert {x.doc_id for x in quality.keep_good(d, model).collect()} == {i for i, s in out.items() if s >= 0.7}
    odd = [x.score for x in quality.score_documents(docs, model).collect()]
    assert len(odd) == docs.count() and all(0 <= s <= 1 for s in odd)
    assert quality.score_documents(empty, model).count() == 0
    none = quality.fit(d, labels.where("false"))
    assert quality.score_documents(d, none).where("score <> 0.5").count() == 0


def test_tool_chat(spark):
    calls = [
        (1, 0, "a", "f", '{"y":1,"x":"é"}', []), (1, 2, "b", "f", '{"x":""}', ["a", "gone"]), (1, 4, "c", "f", None, ["b", "a"]), (1, 6, "d", "g", "{}", []),
        (2, 0, "p", "f", '{"x":"q"}', ["q"]), (2, 1, "q", "f", '{"x":"q"}', ["p"]), (3, 5, "a", "f", '{"x":"late"}', None), (3, 1, "a", "f", '{"x":"first"}', None), (None, 0, "a", "f", "{}", []), (4, 0, None, "f", "{}", []),
    ]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    res = spark.createDataFrame([(1, "a", 1, "out"), (1, "a", 9, "later"), (3, "a", 2, None), (7, "z", 1, "orphan")], "conv_id long, call_id string, turn long, content string")
    schemas = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "string", "minLength": 1}}}}
    got = {(r.conv_id, r.call_id): r for r in tool_chat.link_calls(c, res, schemas).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "p"), (2, "q"), (3, "a")}
    assert got[1, "a"].line == '{"arguments":{"x":"é","y":1},"call_id":"a","name":"f","result":"out"}' and got[1, "a"].valid
    assert [got[1, k].level for k in "abcd"] == [0, 1, 2, 0] and [got[1, k].position for k in "adbc"] == [0, 1, 2, 3]
    assert got[1, "b"].problem == "$.x: too short" and got[1, "c"].problem == "arguments are no JSON" and got[1, "d"].problem == "unknown tool"
    assert got[2, "p"].level is None and got[2, "q"].problem == "circular dependency"
    assert json.loads(got[3, "a"].line)["arguments"] == {"x": "first"} and got[3, "a"].linked
    assert tool_chat.link_calls(c.where("false"), res, schemas).count() == 0


def test_numbering(spark):
    r = random.Random(1)
    rows = [(r.randrange(5), r.randrange(100), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    got = [(x.a, x.b, x.c) for x in sorted(numbered(df, ["a", "b", "c"], "n").collect(), key=lambda x: x.n)]
    assert got == sorted(rows)
    total, at = {x.c: x.t for x in running_total(df, ["b", "c"], "a", "t").collect()}, 0
    for a, _, c in sorted(rows, key=lambda x: (x[1], x[2])):
        assert total[c] == at
        at += a


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the given tables")
    rows, before = spark.read.parquet(f"{sf}/documents.parquet"), None
    columns = rows.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in rows.collect()}
        out = stage(spark, rows, sf)
        out.write.parquet(path := str(tmp_path / name))
        rows = spark.read.parquet(path)
        if name != "packing":
            assert rows.columns == columns
        after = {r.doc_id: r.text for r in rows.collect()} if name != "packing" else {}
        if name == "exact_dedup":
            least = {}
            for i in sorted(before):
                least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]), i)
            assert set(after) == set(least.values())
        if name == "near_dedup":
            sets = brute_sets(before.items())
            assert set(after) == brute_stay(sets, brute_links(sets))
        if name == "pii":
            assert set(after) == set(before) and all(t == before[i] or pii.base_spans(before[i]) for i, t in after.items()) and not any("@mail" in t for t in after.values())
    encode = library(BYTE)
    assert {r.doc_id: r.n for r in rows.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {i: len(encode(t)) + 1 for i, t in before.items()}


def test_support_stays_within_what_the_counters_take(spark):
    for rows in (0, 10, 10**9, 2 * 10**10, 10**13):
        assert 1e-4 <= exact_dedup.support_for(rows) <= 5e-4
    # a group that is not frequent is joined with its count, however large
    docs = spark.createDataFrame([(i, "same" if i % 2 else f"t{i // 4}") for i in range(4000)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, support=0.9).collect()}
    assert got == {i: (1, 2000, i == 1) if i % 2 else (i - i % 4, 2, i % 4 == 0) for i in range(4000)}


def test_arguments_that_are_no_json(spark):
    texts = {
        "surrogate": '{"text":"\\ud800","limit":30}', "pair": '{"text":"\\ud83d\\ude00","limit":30}', "deep": "[" * 200_000 + "]" * 200_000, "rather deep": "[" * 150 + "]" * 150,
        "nan": '{"text":"x","limit":NaN}', "infinite": '{"text":"x","limit":1e999}', "whole float": '{"text":"x","limit":30.0}', "true": '{"text":"x","limit":true}', "none": None,
    }
    calls = spark.createDataFrame([(1, i, k, "search", t, []) for i, (k, t) in enumerate(texts.items())], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {r.call_id: r for r in tool_chat.link_calls(calls, results, tool_chat.SCHEMAS).collect()}
    assert {k: r.problem for k, r in got.items()} == {
        "surrogate": "arguments hold a lone surrogate", "pair": None, "deep": "arguments are nested too deeply", "rather deep": "arguments are nested too deeply", "nan": "arguments are no JSON",
        "infinite": "arguments are no JSON", "whole float": None, "true": "$.limit: not of type integer", "none": "arguments are no JSON",
    }
    for k, r in got.items():
        assert json.loads(r.line, parse_constant=lambda _: 1 / 0)["arguments"] == (json.loads(texts[k]) if k in ("pair", "whole float", "true") else texts[k])


def test_enum_tells_true_from_one():
    schema = {"enum": [1, "a", [True]]}
    assert [tool_chat.first_problem(x, schema) is None for x in (1, 1.0, True, "a", [True], [1])] == [True, True, False, True, True, False]


def test_store_refuses_ids_that_do_not_fit(spark, docs):
    with pytest.raises(ValueError, match="too few"):
        token_store.write_store(docs, WORD, new_path(spark, "narrow"), width=1)
