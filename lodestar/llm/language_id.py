"""Language identification by unigram pieces, with all segmentations of a word summed."""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import SharedFile, map_texts, per_process, pick
from lodestar.llm.trie import PieceTrie, bands, tiktoken_pieces

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Least probability that is taken from a pass in plain doubles; below it, a word is scored in logarithms.
SAFE = 1e-280
#: Numbers that a level of a trie may hold: nodes x lengths of pieces x languages.
LEVEL = 1 << 22
#: Characters of a word that training takes at a time. Prediction never cuts a word.
STRETCH = 64


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, in order; none if the text holds no letter (numerals such as '²' alone are none)."""
    found = WORD.findall(text.lower())
    if found and not any(c.isalpha() for w in found for c in w):
        return []
    return found


def stretches(word: str) -> list[bytes]:
    """What training counts of a word: all of it, or, of a longer one than STRETCH characters, its parts."""
    return [((" " if i == 0 else "") + word[i : i + STRETCH]).encode() for i in range(0, len(word), STRETCH)]


class UnigramLanguages:
    """Piece probabilities of each language over one vocabulary: ``probs`` is (pieces, languages).

    ``usual`` is a language's mean log probability per byte over the words it was trained on.
    """

    def __init__(self, trie: PieceTrie, languages: list[str], probs: np.ndarray, usual: np.ndarray | None = None):
        self.trie, self.languages = trie, languages
        self.probs = np.concatenate([probs, np.zeros((1, len(languages)))])  # the last row is for piece -1
        with np.errstate(divide="ignore"):
            self.logs = np.log(self.probs)
        self.usual = np.zeros(len(languages)) if usual is None else usual
        self.rows = max(16, LEVEL // (64 * max(1, len(languages))))

    def forward(self, words: list[bytes]) -> np.ndarray:
        """Log probability of distinct words in each language, summed over all segmentations.

        Words share tries by length and a prefix is scored once. Short words are scored in plain
        doubles; the longer ones, and those that come near the least double, in logarithms, so no word
        is too long or too rare. A word beyond all tries is a path of its own.
        """
        out = np.zeros((len(words), len(self.languages)))
        scored = np.zeros(len(words), dtype=bool)
        slow: list[int] = []
        for band in bands(words, self.rows, last=48):
            out[band] = self._plain([words[i] for i in band])
            scored[band] = True
            slow += [i for i, low in zip(band, (out[band] < SAFE).any(axis=1).tolist(), strict=True) if low]
        out[scored] = np.log(np.maximum(out[scored], SAFE))
        slow += np.nonzero(~scored)[0].tolist()
        rest = [words[i] for i in slow]
        done = np.zeros(len(rest), dtype=bool)
        for band in bands(rest, self.rows):
            at = [slow[k] for k in band]
            for _, _, now, ends, nodes in self._levels([rest[k] for k in band]):
                out[[at[e] for e in ends.tolist()]] = now[nodes]
            done[band] = True
        for k in np.nonzero(~done)[0].tolist():
            out[slow[k]] = self._path(rest[k])
        return out

    def _plain(self, words: list[bytes]) -> np.ndarray:
        """Probabilities of sorted, distinct words."""
        out = np.zeros((len(words), len(self.languages)))
        held = np.ones((1, 1, len(self.languages)))
        for parent, pieces, ends, nodes in self.trie.walk(words):
            w = pieces.shape[1]
            before = held[parent]
            now = (before[:, :w] * self.probs[pieces]).sum(axis=1)
            held = np.concatenate([now[:, None], before[:, :w]], axis=1)
            out[ends] = now[nodes]
        return out

    def _levels(self, words: list[bytes]):
        """Visit the trie of sorted, distinct words in logarithms, a level at a time.

        Yields the level's entries (node, bytes of the last piece less one, piece, node above), each
        entry's share of its node's probability, the nodes' log probabilities, the words that end and
        their nodes.
        """
        held, above = np.zeros((1, 1, len(self.languages))), np.zeros((1, 0), dtype=np.int64)
        for parent, pieces, ends, nodes in self.trie.walk(words):
            w = pieces.shape[1]
            above = np.concatenate([parent[:, None], above[parent]], axis=1)[:, :w]
            node, back = np.nonzero(pieces >= 0)
            piece = pieces[node, back]
            each = held[parent[node], back] + self.logs[piece]
            now = np.full((len(parent), len(self.languages)), -np.inf)
            share = np.zeros_like(each)
            if len(node):
                starts = np.nonzero(np.append(True, node[1:] != node[:-1]))[0]
                top = np.maximum.reduceat(each, starts, axis=0)
                top[~np.isfinite(top)] = 0.0
                sizes = np.diff(np.append(starts, len(node)))
                share = np.exp(each - np.repeat(top, sizes, axis=0))
                total = np.add.reduceat(share, starts, axis=0)
                with np.errstate(divide="ignore"):
                    now[node[starts]] = top + np.log(total)
                share /= np.maximum(np.repeat(total, sizes, axis=0), SAFE)
            held = np.concatenate([now[:, None], held[parent][:, :w]], axis=1)
            yield (node, back, piece, above[node, back]), share, now, ends, nodes

    def _path(self, word: bytes) -> np.ndarray:
        """Log probability of one word, without a table of its prefixes."""
        held = [np.zeros(len(self.languages))]  # of the prefixes that pieces may still begin after, the longest last
        for pieces in self.trie.pieces_ending(word):
            now = np.full(len(self.languages), -np.inf)
            if pieces:
                each = np.array([held[-n] + self.logs[p] for n, p in pieces])
                top = each.max(axis=0)
                top[~np.isfinite(top)] = 0.0
                with np.errstate(divide="ignore"):
                    now = top + np.log(np.exp(each - top).sum(axis=0))
            held = [*held[1 - self.trie.longest :], now] if self.trie.longest > 1 else [now]
        return held[-1]

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language, for ``counts`` (words, languages): one E step of EM."""
        used = np.zeros((len(self.probs), len(self.languages)))
        for band in bands(words, max(1, self.rows // 16)):
            levels = list(self._levels([words[i] for i in band]))
            flows = [np.zeros_like(now) for _, _, now, _, _ in levels]
            for depth in range(len(levels) - 1, -1, -1):
                (node, back, piece, up), share, _, ends, nodes = levels[depth]
                flows[depth][nodes] += counts[[band[e] for e in ends.tolist()]]
                flow = flows[depth][node] * share
                for k in range(len(self.languages)):
                    used[:, k] += np.bincount(piece, flow[:, k], len(used))
                for b in range(min(depth, int(back.max(initial=-1)) + 1)):
                    rows = np.nonzero(back == b)[0]
                    np.add.at(flows[depth - b - 1], up[rows], flow[rows])
        return used[:-1]

    @classmethod
    def train(
        cls, trie: PieceTrie, n_pieces: int, counts: dict[str, dict[bytes, int]], rounds: int = 3, smooth: float = 0.05
    ) -> UnigramLanguages:
        """Expectation maximisation from equal probabilities; ``counts`` has the words of each language."""
        languages = sorted(counts)
        model = cls(trie, languages, np.full((n_pieces, len(languages)), 1.0 / n_pieces))
        words = sorted({w for c in counts.values() for w in c})
        step = max(1, LEVEL // max(1, len(languages)))  # words whose counts are a table at a time

        def tables():
            for a in range(0, len(words), step):
                part = words[a : a + step]
                yield part, np.array([[counts[lang].get(w, 0) for lang in languages] for w in part], dtype=float).reshape(len(part), -1)

        for _ in range(rounds):
            used = sum((model.expected(part, table) for part, table in tables()), np.full((n_pieces, len(languages)), smooth))
            model = cls(trie, languages, used / used.sum(axis=0))
        logs = sizes = np.zeros(len(languages))
        for part, table in tables():
            logs = logs + (model.forward(part) * table).sum(axis=0)
            sizes = sizes + np.array([len(w) for w in part]) @ table
        model.usual = logs / np.maximum(sizes, 1)
        return model

    def __call__(self, texts: list) -> list[pa.Array]:
        if not self.languages:
            return [pa.array([UNDETERMINED] * len(texts)), pa.array([0.0] * len(texts)), pa.nulls(len(texts), pa.float64())]
        found = [words_of(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        codes, distinct = pd.factorize(np.array([w for f in found for w in f], dtype=object))
        raw = [(" " + w).encode() for w in distinct]
        of = self.forward(raw)
        total, length = np.zeros((len(texts), len(self.languages))), np.ones(len(texts))
        some = np.nonzero(sizes)[0]
        if len(some):
            starts = np.cumsum(sizes)[some] - sizes[some]
            total[some] = np.add.reduceat(of[codes], starts, axis=0)
            length[some] = np.add.reduceat(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))[codes], starts)
        best = total.argmax(axis=1)
        rows = np.arange(len(texts))
        fit = total[rows, best] / length - self.usual[best]
        share = np.exp(total - total.max(axis=1, keepdims=True))
        score = share[rows, best] / share.sum(axis=1)
        none = sizes == 0
        named = [UNDETERMINED if n else self.languages[b] for b, n in zip(best.tolist(), none.tolist(), strict=True)]
        return [pa.array(named), pa.array(np.where(none, 0.0, np.minimum(score, 1.0))), pa.array(fit, mask=none)]


def held_out(id_col: Column) -> Column:
    """True for the fold that training must not see: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def _count_words(batches):
    """Words of sampled rows: a row for each (lang, key, word), once however often the row is repeated in a task."""
    seen = set()
    for batch in batches:
        found: Counter = Counter()
        for lang, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (lang, key) not in seen:
                seen.add((lang, key))
                found.update((lang, key, s) for w in words_of(text) for s in stretches(w))
        columns = [pa.array([k[i] for k in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], names=["lang", "key", "word", "n"])


def sample_words(
    df: DataFrame, text_col: str, lang_col: str, id_col: str, per_language: int, max_chars: int, max_languages: int, max_words: int
) -> dict[str, dict[bytes, int]]:
    """Counts of the words of a bounded sample, by language.

    Of a language the ``per_language`` distinct rows of the least hash of (lang, id, text) are drawn
    among rows with a language, a letter in the text and an id outside the held-out fold. An estimate
    of a language's distinct rows gives the share of hashes that holds about half as many again, all of
    them if they are few, so nothing but keys of that share is ranked, and no language is lost.
    """
    rows = pick(df, id=id_col, lang=lang_col, text=text_col).withColumn("id", F.col("id").cast("string"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("text").isNotNull())
    first = F.when(F.length("text") > max_chars, F.substring("text", 1, max_chars)).otherwise(F.col("text"))
    rows = rows.select("lang", F.xxhash64("lang", "id", "text").alias("key"), first.alias("text")).where(F.col("text").rlike(r"\p{L}"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], 1.5 * (per_language + 50) / max(r["n"], 1))])[F.col("lang")]
    place = F.shiftrightunsigned("key", 11) / F.lit(float(2**53))
    near = rows.select("lang", "key", place.alias("place")).where(F.col("place") <= share).distinct()
    order = Window.partitionBy("lang").orderBy("place", "key")
    chosen = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select("lang", "key")
    # at most per_language x max_languages rows of a name and a number
    sample = rows.join(F.broadcast(chosen), ["lang", "key"], "left_semi").select("lang", "key", "text")
    each = sample.mapInArrow(
        _count_words, "lang string, key long, word binary, n long"
    ).groupBy("lang", "key", "word").agg(F.max("n").alias("n"))
    words = each.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    common = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    most = min(50_000, max(1, max_words // len(sizes)))
    found = words.withColumn("rank", F.row_number().over(common)).where(F.col("rank") <= most).select("lang", "word", "n").toArrow()
    counts: dict[str, dict[bytes, int]] = {}
    for lang, word, n in zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts.setdefault(lang, {})[word] = n
    return counts


def train_languages(
    df: DataFrame,
    vocabulary: str,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    per_language: int = 400,
    max_chars: int = 50_000,
    max_languages: int = 200,
    max_words: int = 2_000_000,
    rounds: int = 3
):
    """Fit piece probabilities; returns a factory of the model for the workers.

    The fit is on a bounded sample of labelled rows: at most ``per_language`` distinct rows of each
    language outside the held-out fold, of a longer text its first ``max_chars`` characters, of a
    longer word than 64 characters its stretches of as many; of their words the most frequent ones,
    50,000 a language and ``max_words`` in all at most. EM runs on the driver.

    Rows of null id, lang or text and texts without a letter are not drawn; repeated rows count once,
    rows of one id with different texts or languages are different rows. A language without a counted
    word is not in the model, and an empty table gives a model of no languages. Over ``max_languages``
    languages are an error. Other columns are ignored.
    """
    spark = df.sparkSession
    counts = sample_words(df, text_col, lang_col, id_col, per_language, max_chars, max_languages, max_words)
    languages = sorted(counts)
    file = SharedFile(spark, vocabulary)
    pieces = tiktoken_pieces(file.data)
    model = UnigramLanguages.train(PieceTrie(pieces), len(pieces), counts, rounds) if languages else None
    fitted = spark.sparkContext.broadcast((model.probs[:-1], model.usual) if model else (np.zeros((len(pieces), 0)), np.zeros(0)))
    key = (file.key, uuid.uuid4().hex)

    def make() -> UnigramLanguages:
        return per_process(("languages", *key), lambda: UnigramLanguages(PieceTrie(tiktoken_pieces(file.data)), languages, *fitted.value))

    return make


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())]


def predict_languages(df: DataFrame, model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``lang_pred``, ``score`` and ``fit`` for each whole text.

    ``score`` (0 to 1) is the posterior of the best language under equal priors. It tells languages of
    the model apart, not whether a text is in any: that shows in ``fit``, the text's log probability
    per byte in that language less the mean of the words it was learned from, about 0 for its own texts
    and far below for others.

    One pass, no shuffle, by a model of ``train_languages``. A null text or one with no letter is
    ``und`` with score 0 and fit null, as is every text if no language was learned. Rows, repeated or
    not, are scored on their own; of equal languages the first by name is given. An empty table gives
    no rows. All columns (or ``keep``) go through, but for those of the new names.
    """
    return map_texts(df, text_col, FIELDS, model, keep)
