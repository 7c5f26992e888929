"""The registered queries of these operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, manifest, packing, pii, prefix_trie, quality, repeats, sharding, simhash, token_store, tool_chat
from .common import new_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, null ids first. Null and empty texts are the end id alone; repeated rows are documents of their own; no documents give no rows."""
    path = new_path(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece. Null and empty texts are the end id alone; repeated rows are packed each; no documents give no pieces."""
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document. Null and empty texts are one group; a null id loses to every other; of repeated rows one is kept."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per call. Turns of a null conversation and calls without identifier are left out; what is wrong with a call is told in ``problem``."""
    calls, results = tool_chat.calls_of_conversations(_table(spark, sf_dir, "conversations"))
    return tool_chat.link_calls(calls, results, tool_chat.SCHEMAS)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document. Null and empty texts hold nothing; repeated rows are searched each."""
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in pii.BASE], F.sha2(pii.spans_text(base), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans")
    )


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document. Texts without words have fingerprint zero and are linked like others; a null id names a component only where it has no other."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document. A null text has 16 bytes; null metadata are a value of their own; fewer documents than shards leave shards empty."""
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 20 rows per query. Vectors that are null, zero, not finite or of another length take no part; of a repeated id the least vector counts."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document. Null and empty texts have no ids; repeated rows are encoded each."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, and_decode=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document. Null and empty texts score by the bias alone; repeated rows and null ids are scored by their text."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per node. Turns of a null conversation belong to none; a null turn comes first; repeated turns each count."""
    return prefix_trie.prefix_nodes(prefix_trie.rebuilt(prefix_trie.conversation_rows(_table(spark, sf_dir, "conversations"))))


def op12_merkle_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document. Nulls are leaves like others, rows of a null id are never tampered with, repeated rows each have a leaf."""
    docs = _table(spark, sf_dir, "documents")
    # what tampering makes of a row: its letters A-Z in lower case, where 3 divides the checksum of its id
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered).otherwise(F.col("text"))
    docs = docs.withColumn("altered", manifest.leaf_digest([tampered if f == "text" else F.col(f) for f in manifest.FIELDS]))
    path = new_path(spark, "merkle-store")
    manifest.write_manifest(docs, path, carry=("altered",))
    proved = manifest.prove(spark, path)
    proved = proved.withColumn("folded_root", manifest.folded(F.col("carry_altered"), F.col("path")))
    return proved.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op13_fm_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document. Null and empty texts have no words; repeated ids and rows as :func:`repeats.remove_repeats` says."""
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_store,
        op2_sum_of_squares_packing,
        op3_exact_dedup,
        op4_tool_call_linking,
        op5_personal_data,
        op6_simhash_near_duplicates,
        op7_kd_tree_shards,
        op8_learned_partitions,
        op9_byte_level_bpe,
        op10_quality_classifier,
        op11_prefix_trie,
        op12_merkle_descent,
        op13_fm_index_repeats,
    )
}

#: The unsigned crc32 of a column's decimal digits: a table-free loop over bytes and bits.
_CRC32 = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split({}::VARCHAR, ''), lambda c: ascii(c)),
    lambda x, b: list_reduce([xor(x, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)))"""

ORACLE_SQL = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op4_tool_call_linking": """
        WITH RECURSIVE calls AS (
            SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, text, length(text) AS n, text IS NOT NULL AND n < 200 AS short
            FROM conversations WHERE role = 'user'),
        levels AS (
            SELECT c.conv_id, c.turn, 0 AS level FROM calls c
            WHERE c.turn = 0 OR NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn // 2)
            UNION ALL
            SELECT c.conv_id, c.turn, l.level + 1 FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.turn // 2 = l.turn AND c.turn > 0 AND c.turn <> l.turn),
        joined AS (
            SELECT c.*, l.level, CASE WHEN short THEN 'search' ELSE 'summarise' END AS name, r.conv_id IS NOT NULL AS linked, r.text AS content,
                CASE WHEN n = 0 THEN '$.text: too short'
                     WHEN short AND n < 20 THEN '$.limit: below minimum'
                     WHEN NOT short AND n > 1500 THEN '$.limit: above maximum' END AS problem
            FROM calls c JOIN levels l USING (conv_id, turn)
            LEFT JOIN conversations r ON r.role = 'assistant' AND r.conv_id = c.conv_id AND r.turn = c.turn + 1)
        SELECT conv_id, call_id, turn, level, name, linked, problem IS NULL AS valid, problem,
            '{"arguments":{"limit":' || n || ',"text":' || to_json(text) || ',"turn":' || turn || '},"call_id":"' || call_id || '","name":"' || name
                || '","result":' || CASE WHEN linked THEN to_json(content) ELSE 'null' END || '}' AS line,
            row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, call_id) - 1 AS position
        FROM joined""",
    "op11_prefix_trie": f"""
        WITH own AS (
            SELECT conv_id, list(sha256(strlen(r) || ':' || r || t) ORDER BY turn NULLS FIRST, r, sha256(t)) AS turns,
                list(len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) ORDER BY turn NULLS FIRST, r, sha256(t)) AS words
            FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
        heads AS (SELECT *, {_CRC32.format("conv_id")} % 4 AS h FROM own),
        paths AS (
            SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns, coalesce(b.words[1:c.h], []) || c.words[c.h + 1:] AS words
            FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
        prefixes AS (SELECT conv_id, len(turns) AS own_depth, unnest(range(len(turns) + 1)) AS depth, turns, words FROM paths),
        nodes AS (
            SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN words[depth] ELSE 0 END) AS words,
                sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (own_depth = depth), '')) AS ends_sha256
            FROM prefixes GROUP BY turns[1:depth], depth),
        kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
        whole AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
        above AS (SELECT path[1:d] AS path, (n_children = 0)::INT AS leaf, (n_convs - 1) * words AS saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM whole)),
        sums AS (SELECT path, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY path)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM whole n JOIN sums USING (path) LEFT JOIN whole p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]""",
    "op12_merkle_descent": f"""
        WITH RECURSIVE fields AS (
            SELECT doc_id, lang, a, b, text, doc_id IS NOT NULL AND {_CRC32.format("coalesce(doc_id, 0)")} % 3 = 0 AS hit FROM (
                SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
                    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS b FROM documents)),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS branch FROM (
                SELECT doc_id, lang, sha256(a || b || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN hit
                    THEN sha256(a || b || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) ELSE leaf END AS altered FROM fields)),
        nodes AS (
            SELECT branch, 0 AS level, rank AS pos, leaf AS h, count(*) OVER (PARTITION BY branch) AS n FROM leaves
            UNION ALL
            SELECT branch, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY branch, level, pos // 8),
        trunk AS (
            SELECT 0 AS level, branch AS pos, h, count(*) OVER () AS n FROM nodes WHERE n = 1
            UNION ALL
            SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM trunk WHERE n > 1 GROUP BY level, pos // 8),
        siblings AS (
            SELECT a.branch, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
                coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
            FROM nodes a JOIN nodes b ON a.branch = b.branch AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL
            UNION ALL
            SELECT NULL, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), ''), coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '')
            FROM trunk a JOIN trunk b ON a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
        tops AS (SELECT branch, level AS height, h AS subroot FROM nodes WHERE n = 1),
        folds AS (
            SELECT row_number() OVER () AS id, doc_id, leaf, branch, rank AS pos, 0 AS level, altered AS h, '' AS proof, false AS up FROM leaves
            UNION ALL
            SELECT f.id, f.doc_id, f.leaf, f.branch, CASE WHEN s.pos IS NULL THEN f.branch ELSE f.pos // 8 END, CASE WHEN s.pos IS NULL THEN 0 ELSE f.level + 1 END,
                CASE WHEN s.pos IS NULL THEN f.h ELSE sha256(s.before || f.h || s.after) END, CASE WHEN s.pos IS NULL THEN f.proof ELSE f.proof || s.before || s.after END, f.up OR s.pos IS NULL
            FROM folds f LEFT JOIN siblings s ON s.branch IS NOT DISTINCT FROM CASE WHEN f.up THEN NULL ELSE f.branch END AND s.level = f.level AND s.pos = f.pos
            WHERE s.pos IS NOT NULL OR NOT f.up),
        ends AS (SELECT * FROM folds WHERE up QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1)
        SELECT e.doc_id, e.leaf, t.subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
        FROM ends e JOIN tops t ON t.branch = e.branch, (SELECT h FROM trunk WHERE n = 1) r""",
    "op13_fm_index_repeats": r"""
        WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
        each AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split),
        joined AS (SELECT *, i + 19 <= n AS whole, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM each),
        windows AS (SELECT *, whole AND row_number() OVER (PARTITION BY whole, win ORDER BY doc_id NULLS LAST, i) > 1 AS again FROM joined),
        covered AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM windows),
        kept AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
            FROM covered GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
        FROM split d LEFT JOIN kept k ON k.doc_id IS NOT DISTINCT FROM d.doc_id""",
}
