"""Registered queries, whole, against brute force on the smallest tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from lodestar.llm.bpe import BytePairCodec
from lodestar.llm.queries import BPE_FILE, MULTI_RANKS, ORACLES, QUERIES
from lodestar.llm.simhash import simhash_links
from lodestar.llm.trie import tiktoken_pieces
from lodestar.operators.graph import connected_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def components_of(keys, linked):
    label = {k: k for k in keys}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        ra, rb = root(a), root(b)
        label[max(ra, rb)] = min(ra, rb)
    return {k: root(k) for k in keys}


def test_op1_of_planted_copies_equals_its_sql(spark, tmp_path):
    r = np.random.default_rng(8)
    base = r.normal(size=(20, 24))
    rows = [
        (i, [float(np.float32(x)) for x in base[i % 20] + r.normal(size=24) * (0, 0.1, 0.25, 0.4)[i % 4]], int(i % 3)) for i in range(240)
    ]
    rows += [(900 + i, rows[0][1], 0) for i in range(40)] + [(990, None, 1), (991, [0.0] * 24, 1), (992, rows[0][1], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, QUERIES["op1_embedding_dedup"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.execute(ORACLES["op1_embedding_dedup"]).fetchall())
    assert sum(x[1] > 0 for x in got) > 150 and max(x[1] for x in got) > 40 and len({x[2] for x in got}) > 20


def test_op2_equals_plain_dynamic_programming(spark, texts):
    pieces = tiktoken_pieces(open(MULTI_RANKS, "rb").read())
    rank = {p: i for i, p in reversed(list(enumerate(pieces)))}
    longest = max(map(len, rank))
    known = {}

    def tokens(word):
        if word not in known:
            w, best = word.encode(), [(0.0, 0)]
            for e in range(1, len(w) + 1):
                best.append(
                    max(
                        (
                            best[s][0] - math.log(rank[w[s:e]] + 100.0), best[s][1] - 1
                        ) for s in range(max(0, e - longest), e) if w[s:e] in rank
                    )
                )
            known[word] = -best[-1][1]
        return known[word]

    got = QUERIES["op2_token_counts"](spark, SF).collect()
    assert len(got) == len(texts)
    for x in got:
        words = re.findall(r" ?\w+| ?[^\w\s]+|\s+", texts[x["doc_id"]] or "")
        assert (x["n_pretokens"], x["n_tokens"]) == (len(words), sum(map(tokens, words)))


def test_long_pretokens_share_tries(spark):
    r = random.Random(2)
    words = ["".join(r.choice("ab-=") for _ in range(n)) for n in (49, 60, 97, 300, 1500, 1600, 5000)]
    from lodestar.llm.token_counts import UnigramCounter

    counter = UnigramCounter(tiktoken_pieces(open(MULTI_RANKS, "rb").read()))
    shared = [w + tail for w in words for tail in ("", "x", "xy")]
    found = counter([" ".join(shared)])
    parts = re.findall(r" ?\w+| ?[^\w\s]+|\s+", " ".join(shared))
    assert found[0][0].as_py() == len(parts) and found[1][0].as_py() == sum(counter.count_long(p.encode()) for p in parts)


def test_op3_equals_independent_hashing(spark, texts):
    """Spark's xxhash64 of (key, shard) is XXH64 of the bytes of each, the first's hash seeding the second."""
    got = QUERIES["op3_sharding"](spark, SF).collect()
    slots = defaultdict(list)
    for x in got:
        raw = (texts[x["doc_id"]] or "").encode()
        assert (x["size"], x["text_crc32"], x["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        seed = xxhash.xxh64_intdigest(str(x["doc_id"]).encode(), 42)
        draws = [-math.log(((xxhash.xxh64_intdigest(struct.pack("<i", s), seed) >> 11) + 0.5) / 2**53) for s in range(25)]
        assert (x["shard"], x["grown_shard"]) == (int(np.argmin(draws[:24])), int(np.argmin(draws)))
        slots[x["shard"]].append(x["slot"])
    assert len(got) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op6_equals_the_library(spark, texts):
    library = Tokenizer.from_file(BPE_FILE)
    library.no_truncation()
    library.no_padding()
    for x in QUERIES["op6_bpe"](spark, SF).collect():
        ids = library.encode(texts[x["doc_id"]] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == want


def test_vocabulary_files_with_other_settings_are_refused():
    raw = open(BPE_FILE, "rb").read()
    for old, new in (
        (b'"add_prefix_space":false', b'"add_prefix_space":true'),
        (b'"normalizer":null', b'"normalizer":{"type":"NFC"}'),
        (b'"lstrip":false', b'"lstrip":true'),
        (b'"byte_fallback":false', b'"byte_fallback":true')
    ):
        squeezed = re.sub(rb'": +', b'":', raw) if old not in raw else raw
        assert old in squeezed
        with pytest.raises(ValueError, match="unsupported"):
            BytePairCodec(squeezed.replace(old, new, 1))


def test_op9_equals_brute_force(spark, texts):
    def fingerprint(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))

    prints = {d: fingerprint(t) for d, t in texts.items()}
    ids = sorted(prints)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = components_of(ids, near)
    got = QUERIES["op9_simhash_dedup"](spark, SF).collect()
    assert {
        x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in got
    } == {d: (f"{prints[d]:016x}", want[d]) for d in ids} and len(got) == len(ids)
    assert any(a != want[a] for a in ids)


@pytest.mark.parametrize("bits", [1, 3, 5, 7, 9, 11])
def test_links_at_any_radius(spark, bits):
    r = random.Random(bits)
    prints = set()
    for _ in range(8):
        centre = r.getrandbits(64)
        prints |= {centre ^ sum(1 << k for k in r.sample(range(64), r.randrange(13))) for _ in range(30)}
    prints = sorted(prints)
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits]
    want = components_of(range(len(prints)), near)
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "node long, fp long")
    got = {x["node"]: x["component"] for x in connected_components(simhash_links(nodes, bits, tile_rows=16)).collect()}
    assert {i: got.get(i, i) for i in range(len(prints))} == want


def test_op7_rows_of_no_conversation_equal_its_sql(spark, tmp_path):
    rows = [
        (None, 0, "user", "a\\b"),
        (None, 0, "user", "a\\b"),
        (None, None, "assistant", None),
        (1, 0, "assistant", "x"),
        (1, 0, "assistant", "x"),
        (1, None, None, "<s>")
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, QUERIES["op7_chat_format"](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert got == sorted(con.execute(ORACLES["op7_chat_format"]).fetchall(), key=str) and len(got) == 5
