"""Every registered query of the training-data operators, on the given tables, against a brute-force version of what it must return."""

import base64
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from test_near_dedup import brute_links, brute_sets, brute_stay

import corpus_pipeline
from ringlore.llm import pii, queries, sharding

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return {i: x or "" for i, x in zip(t["doc_id"], t["text"])}


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, texts):
    tok, at = library("word_bpe_49k.json"), 0
    got = {r.doc_id: r for r in run(spark, "op1_token_store")}
    assert set(got) == set(texts)
    for i in sorted(texts):
        ids = tok.encode(texts[i], add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op2(spark, texts):
    tok, fill, pieces = library("byte_bpe_50k.json"), {}, {}
    rows = run(spark, "op2_sum_of_squares_packing")
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
        pieces.setdefault(r.doc_id, []).append(r)
    assert max(fill.values()) <= 1024 and sum(fill.values()) / (1024 * len(fill)) > 0.95
    for i, text in texts.items():
        ids, at = tok.encode(text, add_special_tokens=False).ids + [0], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns) and got.count() > 0
    columns = sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def digits(s):
    return re.sub("[^0-9]", "", s)


def base_spans(t):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_op5(spark, texts):
    for r in run(spark, "op5_personal_data"):
        spans = base_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in spans) for kind in ("email", "ip", "card", "phone"))
        joined = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(r.spans.split(","))  | ({""} if not joined else set())


def test_op6(spark, texts):
    from test_operators import brute_components, brute_prints

    prints = {i: brute_prints(t) for i, t in texts.items()}
    part = brute_components(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op6_simhash_near_duplicates")} == {(i, f"{p:016x}", part[i]) for i, p in prints.items()}


def test_op7(spark, texts):
    rows, shards = run(spark, "op7_kd_tree_shards"), {}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    for r in sorted(rows, key=lambda r: r.doc_id):
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) <= set(range(40)) and all([r.slot for r in s] == list(range(len(s))) and {r.law for r in s} == {"bytes"} for s in shards.values())
    # a split is off its aim by one document at most, and a shard lies below six splits
    sizes = [sum(r.size for r in shards.get(s, [])) for s in range(40)]
    assert max(sizes) - sum(sizes) / 40 <= 6 * max(r.size for r in rows)


def plain_tree(rows, shards, first=0):
    """Shard of each row by a k-d tree in plain Python: the widest axis, cut where the bytes left of it come nearest to their share."""
    if shards == 1 or not rows:
        return {r["doc_id"]: first for r in rows}
    axes = sorted(c for c in rows[0] if c[0] == "c" and c[1:].isdigit())
    axis = max(axes, key=lambda c: max(r[c] for r in rows) - min(r[c] for r in rows))
    rows = sorted(rows, key=lambda r: (r[axis], r["tie"]))
    wanted, done, n = sum(r["size"] for r in rows) * (shards // 2) / shards, 0, 0
    while done + rows[n]["size"] < wanted:
        done, n = done + rows[n]["size"], n + 1
    n += done + rows[n]["size"] - wanted < wanted - done
    return plain_tree(rows[:n], shards // 2, first) | plain_tree(rows[n:], shards - shards // 2, first + shards // 2)


def test_op7_is_a_kd_tree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in sharding.metadata_rows(docs, ("lang", "source"), "doc_id", "text").collect()]
    want = plain_tree(rows, 40)
    got = {r.doc_id: r.shard for r in run(spark, "op7_kd_tree_shards")}
    assert sum(got[i] != want[i] for i in want) <= 0.01 * len(want) and got.keys() == want.keys()


def test_op8(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"], np.float64)
    got, hits, of = {}, 0, 0
    for r in sorted(run(spark, "op8_learned_partitions"), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q, rows in got.items():
        s = x @ x[ids == q][0]
        k = min(20, len(ids) - 1)
        best = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        assert [r.rank for r in rows] == list(range(1, k + 1)) and len({r.vec_id for r in rows}) == k
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in rows) and [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits, of = hits + len({int(ids[i]) for i in best} & {r.vec_id for r in rows}), of + k
    assert hits >= 0.9 * of


def test_op9(spark, texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = run(spark, "op9_byte_level_bpe")
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def area(score, label):
    """Chance that a row of label 1 scores higher than one of label 0, ties half."""
    a, b = score[label == 1][:, None], score[label == 0][None, :]
    return ((a > b) + 0.5 * (a == b)).mean()


def test_op10_on_rows_that_it_did_not_learn():
    """Held-out labels of a larger table: the score tells them apart, and so does the threshold."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (pq.read_table(f"{sf}/{t}.parquet").to_pandas() for t in ("documents", "labels"))
    from ringlore.llm import quality

    known = docs.merge(labels, on="doc_id").dropna(subset=["quality"])
    held = known.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    train, test = known[~held], known[held]
    model = quality.train(train.text.fillna("").tolist(), train.quality.to_numpy(np.int64))
    import pyarrow as pa

    score, label = quality.score(model, pa.array(test.text.fillna("").tolist())), test.quality.to_numpy()
    assert len(test) > 30 and 0 < label.mean() < 1
    assert area(score, label) >= 0.9 and ((score >= 0.7) == (label == 1)).mean() >= 0.85


def test_op10(spark, texts):
    rows = run(spark, "op10_quality_classifier")
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def pipeline_rows(spark, tmp_path, rows, schema, labels):
    """All stages over rows of one's own, each stage's table by name."""
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    docs, out = spark.createDataFrame(rows, schema), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(path := f"{tmp_path}/{name}")
        docs = out[name] = spark.read.parquet(path)
    return out


PIPELINE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, stays string, text_hash int"


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, ids given twice, long texts, columns whose names operators use."""
    good = " ".join(f"word{i % 97} is{i}" for i in range(300))
    texts = [good, good, good.replace("is7 ", "was7 "), "card 4111 1111 1111 1111 here " + " ".join(f"other{i}" for i in range(80)), None, "", "x" * 200_000, " ".join(f"far{i}" for i in range(60))]
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, "a", 2) for i, t in enumerate(texts)]
    rows += [rows[7], (None, texts[7] + " more", None, None, None, None, None, None), (None, good, None, None, None, None, None, None), (7, texts[7] + " words", "en", "s", 9, 1, "a", 2)]
    out = pipeline_rows(spark, tmp_path, rows, PIPELINE_SCHEMA, [])
    # nothing can be told apart without labels of both classes, so nothing is rejected
    kept = [r.text for r in out["quality"].collect()]
    assert sorted(map(str, kept)) == sorted(map(str, (r[1] for r in rows)))
    assert out["exact_dedup"].count() == 8 and {r.doc_id for r in out["exact_dedup"].collect()} >= {0, 2, 3, 6, 7}
    last = out["near_dedup"].collect()
    sets = brute_sets(enumerate(r.text for r in out["exact_dedup"].collect()))
    assert len(last) == len(brute_stay(sets, brute_links(sets))) and len({(r.doc_id, r.text) for r in last}) == len(last)
    assert {r.doc_id for r in last} >= {0, 3, 6}
    assert [r.text[:18] for r in out["pii"].collect() if r.doc_id == 3] == ["card <CARD> here o"]
    assert out["packing"].where("length < 1").count() == 0


def test_pipeline_on_no_rows(spark, tmp_path):
    assert all(t.count() == 0 for t in pipeline_rows(spark, tmp_path, [], PIPELINE_SCHEMA, []).values())
