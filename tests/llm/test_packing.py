import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SMALL
from demandlens.llm import packing
from demandlens.llm.packing import best_fit, linear_groups, merge_ranks, pack, plan, text_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def documents(rows, capacity):
    """Pieces as the contract says, by the tokenizer alone."""
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    out = []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        first = len(ids) % capacity if len(ids) > capacity and len(ids) % capacity else min(len(ids), capacity)
        for piece, size in enumerate([first] + [capacity] * ((len(ids) - first) // capacity)):
            out.append((key, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at += size
        assert at == len(ids)
    return sorted(out, key=repr)


def check(found, capacity):
    placed = defaultdict(list)
    for r in found:
        placed[r.sequence_id].append((r.offset, r["length"]))
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_odd_documents(odd_docs, no_docs, capacity):
    found = pack(odd_docs, PATH, capacity).collect()
    want = documents([(r.doc_id, r.text) for r in odd_docs.collect()], capacity)
    assert sorted([(r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in found], key=repr) == want
    assert check(found, capacity) <= -(-sum(r["length"] for r in found) // capacity) + 1
    assert pack(no_docs, PATH, capacity).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "a b c <|endoftext|> d"), (2, "x y"), (3, "  double  spaces ")], "doc_id long, text string")
    found = pack(docs, PATH, 8, keep_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r["length"] for r in found)
    assert sorted((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in found) == documents(
        [(r.doc_id, r.text) for r in docs.collect()], 8
    )


def test_plans_place_every_piece_and_waste_little():
    rng = random.Random(8)
    for n in (0, 1, 7, 300, 20_000):
        counts = Counter(rng.choice((rng.randint(1, 1024), min(1024, int(rng.expovariate(1 / 150)) + 1))) for _ in range(n))
        shapes, used = plan(counts), Counter()
        for shape, k in shapes:
            assert k > 0 and sum(shape) <= 1024
            for length in shape:
                used[length] += k
        assert used == counts
        least = -(-sum(k * c for k, c in counts.items()) // 1024)
        plain = Counter()
        best_fit(plain, dict(counts))
        assert sum(k for _, k in shapes) <= max(least * 1.002 + 3, sum(plain.values()))


def test_groups_have_equal_cardinality():
    counts = {length: 10 for length in range(200, 1000)}
    groups = linear_groups(counts, 16)
    assert len(groups) == 16 and {n for _, n in groups} == {500} and groups[-1][0] == 999
    assert linear_groups({}, 4) == []


def test_both_engines_give_the_same_ids(spark):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    assert packing.PATTERN == public_tokenizers.PATTERN
    odd = [
        "", " ", "a  b   c ", "\n\n x\t\ty \r\n", "it's we'll I'D 'S", "x²³¼ªº µ×÷ÿſ", "soft\u00adhyphen — “q” ‚x… €5",
        "nbsp\u00a0x \u0085 \u2003 \u200b \x1c\x1f", "漢字 кириллица ελ हिन्दी 👩‍👩‍👧", "<|endoftext|> <|endoftext|>", " " * 3000 + "x", "ab" * 5000, "!" * 700,
    ]
    texts = odd + [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    fast = text_encoder(PATH)
    for text in texts:
        assert fast(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:80]
    assert sum(bool(packing.PLAIN.fullmatch(t)) for t in texts) > len(texts) / 2


def test_other_tokenizers_run_themselves(tmp_path):
    byte = {"type": "ByteLevel", "add_prefix_space": False}
    letters = {c: i for i, c in enumerate(packing.byte_characters())}
    spec = {"pre_tokenizer": byte, "model": {"type": "BPE", "vocab": {**letters, "ab": 256}, "merges": ["a b"]}}
    assert merge_ranks(spec)[b"ab"] == 256 and len(merge_ranks(spec)) == 257
    assert merge_ranks(spec | {"pre_tokenizer": None}) is None and merge_ranks(spec | {"normalizer": {"type": "NFC"}}) is None
    assert merge_ranks(spec | {"model": {**spec["model"], "vocab": {**letters, "ab": 300}}}) is None
    other = public_tokenizers.path("word_bpe_49k.json")
    ids = Tokenizer.from_file(other).encode("Some words, here", add_special_tokens=False).ids
    assert text_encoder(other)("Some words, here") == np.array(ids, "<u4").tobytes()


def test_configurations_are_filled_and_cost_next_to_nothing_against_best_fit():
    rng = np.random.default_rng(0)
    for lengths in (np.minimum(np.ceil(rng.lognormal(5.5, 1.0, 300_000)), 1024), rng.integers(1, 1025, 100_000)):
        counts = Counter(lengths.astype(int).tolist())
        shapes = plan(counts)
        plain = Counter()
        best_fit(plain, {n: c for n, c in counts.items() if n < 1024})
        assert sum(k for _, k in shapes) <= 1.0005 * (sum(plain.values()) + counts[1024])
        mixed = {shape: k for shape, k in shapes if len(shape) > 1}
        assert sum(k for shape, k in mixed.items() if sum(shape) == 1024) > 0.85 * sum(mixed.values())
