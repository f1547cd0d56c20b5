"""The queries op1 to op10 and the pipeline, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import licenses
from lodestar.llm.bpe import round_trip
from lodestar.llm.chat_format import CODES, CONTROL, MARKS, OTHER, format_conversations, unescape
from lodestar.llm.common import table
from lodestar.llm.decontaminate import contaminated, find_benchmark
from lodestar.llm.embedding_dedup import embedding_near_duplicates
from lodestar.llm.language_id import held_out, predict_languages, train_languages
from lodestar.llm.secret_scan import scan_secrets
from lodestar.llm.sharding import shard_documents
from lodestar.llm.simhash import simhash_near_duplicates
from lodestar.llm.token_counts import token_counts

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), MULTI_RANKS, keep=["doc_id"])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), dict.fromkeys(range(24), 1.0), dict.fromkeys(range(25), 1.0))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), BPE_RANKS, keep=["doc_id"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secret_spans")).alias("spans")
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_languages(docs, MULTI_RANKS)
    return predict_languages(docs.select("doc_id", "text"), model, keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.round("fit", 6).alias("fit")
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = round_trip(table(spark, sf_dir, "documents"), BPE_FILE, keep=["doc_id"])
    return made.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    made = format_conversations(rows.unionByName(hard))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars")
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(hit, F.col("n_words")).alias("contaminated")
    )


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("line_ids", ",").alias("line_ids"),
        F.array_join("licenses", ",").alias("licenses")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_embedding_dedup,
        op2_token_counts,
        op3_sharding,
        op4_secret_scan,
        op5_language_id,
        op6_bpe,
        op7_chat_format,
        op8_decontaminate,
        op9_simhash_dedup,
        op10_license_scan
    )
}

OP1_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e,
        label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
    FROM embeddings),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""


def _op7_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'" if "\n" not in s else " || chr(10) || ".join(
        "'" + p.replace("'", "''") + "'" for p in s.split("\n")
    )

    def escaped(x: str) -> str:
        for sign, code in CODES:
            x = f"replace({x}, {quote(sign)}, {quote(code)})"
        return x

    known = " ".join(f"WHEN {quote(name)} THEN {len(a) + len(b)}" for name, (a, b) in MARKS.items())
    return f"""
WITH t AS (
    SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number()
        OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, NULL, 0, 'user', '</s>[INST] ok [/INST]'), (-1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (
    SELECT *, CASE WHEN regexp_matches(text, {quote(CONTROL)}) THEN {escaped('text')} ELSE text END AS body,
        CASE role {known} ELSE {sum(map(len, OTHER))} + length({escaped('role')}) END + 1 AS marks FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(body) + marks)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id, lone
"""


OP8_SQL = r"""
WITH word AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS re, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper_,
    'abcdefghijklmnopqrstuvwxyz' AS lower_),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, upper_, lower_), re), []) AS w FROM documents, word),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, upper_, lower_), re) AS w FROM benchmark, word
    WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (
    SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS s
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
    FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, k, win.n FROM runs JOIN win ON win.n = runs.n AND win.s = runs.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits)
    GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


def _op10_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in licenses.dictionary().items()) + "}"
    # tokens of a text by its ends, normalised, and those that the dictionary knows
    ids = lambda ends: f"list_filter(list_transform(regexp_split_to_array(low, {quote(ends)}), lambda s: {known}[trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))]), lambda x: x IS NOT NULL)"
    spaced = lambda c: f"' ' || array_to_string({c}, ' ') || ' '"
    rules = ", ".join(
        f"CASE WHEN regexp_matches(sa, {quote(rule)}) OR regexp_matches(sb, {quote(rule)}) THEN {quote(name)} END" for name, rule in licenses.RULES
    )
    return f"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
s AS (SELECT doc_id, {ids(licenses.SENTENCE_END)} AS a, {ids(licenses.LINE_END)} AS b FROM d),
r AS (SELECT *, {spaced('a')} AS sa, {spaced('b')} AS sb FROM s)
SELECT doc_id, len(a)::BIGINT AS n_sentences, array_to_string(a, ',') AS sentence_ids, array_to_string(b, ',') AS line_ids,
    array_to_string(list_filter([{rules}], lambda x: x IS NOT NULL), ',') AS licenses
FROM r
"""


ORACLES: dict[str, str] = {
    "op1_embedding_dedup": OP1_SQL, "op7_chat_format": _op7_sql(), "op8_decontaminate": OP8_SQL, "op10_license_scan": _op10_sql()
}
