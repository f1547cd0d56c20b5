"""From documents to token ids: language, near-duplicates, benchmark passages, secrets, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the
last return the columns of ``docs``, whatever further columns there are. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.bpe import round_trip
from lodestar.llm.common import pick, set_checkpoint_dir, table
from lodestar.llm.decontaminate import drop_contaminated
from lodestar.llm.language_id import predict_languages, train_languages
from lodestar.llm.queries import BPE_FILE, BPE_RANKS, MULTI_RANKS
from lodestar.llm.secret_scan import redact_secrets
from lodestar.llm.simhash import keep_one_of_each
from lodestar.operators.graph import drop_checkpoint

#: A document whose best language has less than this share of the probability is rejected,
LEAST_SCORE = 0.5
#: and so is one whose log probability per byte is this far below what is usual in that language.
LEAST_FIT = -3.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (``und``), between languages, or unlike any that was learned.

    The model learns from the labelled rows of the table ``documents``. Null and empty texts go; null
    ids and repeated rows make no difference, each row is judged on its own.
    """
    model = train_languages(table(spark, sf_dir, "documents"), MULTI_RANKS)
    names = docs.columns
    flat = docs.toDF(*[f"x{i}" for i in range(len(names))])
    found = predict_languages(flat, model, text_col=f"x{names.index('text')}")
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & (F.col("fit") >= LEAST_FIT))
    return kept.select(*flat.columns).toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component: that of the smallest doc_id, of null id if all are such.

    SimHash fingerprints find the pairs, at up to 11 bits; they link at a similarity of 0.8 or more of
    their five-word shingles. Of rows of that id, repeated or with different texts, one stays, by hash.
    Texts of no words, null ones too, are near-duplicates of each other.
    """
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents contaminated by the table ``benchmark``; each row is judged on its own, null and empty texts stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts; no document goes. ``n_chars`` is counted anew where a text changed.

    Null and empty texts stay as they are; null ids and repeated rows make no difference.
    """
    names = docs.columns
    flat = docs.toDF(*[f"x{i}" for i in range(len(names))])
    text = f"x{names.index('text')}"
    made = redact_secrets(flat.withColumn("before", F.col(text)), BPE_RANKS, text_col=text)
    if "n_chars" in names:
        count = f"x{names.index('n_chars')}"
        made = made.withColumn(
            count, F.when(F.col(text) == F.col("before"), F.col(count)).otherwise(F.length(text)).cast(flat.schema[count].dataType)
        )
    return made.select(*flat.columns).toDF(*names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and whether they decode to the text.

    A null text is encoded as an empty one; a row for each row, of null or repeated ids too.
    """
    made = round_trip(pick(docs, doc_id="doc_id", text="text"), BPE_FILE)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens)
]

#: Fingerprints, components, trained languages and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table ``documents``, one after the other.

    What a stage keeps is checkpointed in the shared folder, so that it is made once, and a lost
    executor costs no more than its own stage; the checkpoint before it is removed.
    """
    set_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
        if before is not None:
            drop_checkpoint(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
