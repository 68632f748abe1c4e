import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidefold.llm.packing import CAPACITY, VOCABULARY, ChunkIds, Numbering, pack, packed_sequences
from tidefold.llm.patterns import Plan, enumerate_patterns, fit, plan_packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
ODD = [
    "", " ", "  a  b ", "a <|endoftext|> b<|endoftext|>c", "x\n y\t z \n", "a  b  c\x1c d\x1fe", "don't 'S I'm THEY'LL",
    "日本語 テキスト 🙂 é̀ é ́x", "a\x85 b\xa0c", "İstanbul Iı ẞ K Å ŉ ǅ Σας ΣΣ", "a é ñandu, ö. ſt µm ªb, ĳs œuvre!? x.y,",
    "<|startoftext|>", "word|> <| x<|endoftext|>$$$ a's' b_'d __ c''s'", "a,. b?! c;", "١٢ ½ x² ª 123 4a5", " a  b", "ABC,Def. GHI",
]


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def ids_of(chunk_ids, texts):
    return [np.frombuffer(ids, "<u4").tolist() for ids in chunk_ids.of_documents([t.encode() for t in texts])]


def test_ids_equal_the_tokenizer(documents):
    texts = ODD + [r["text"] or "" for r in documents.select("text").collect()]
    # Few known chunks, so that forgetting them is met as well.
    chunk_ids = ChunkIds(VOCABULARY, most=100)
    assert ids_of(chunk_ids, texts) == list(map(whole, texts))
    assert ids_of(chunk_ids, texts[::-1]) == list(map(whole, texts[::-1]))


def test_random_texts_equal_the_tokenizer():
    random.seed(6)
    pick = "ab Ab1 .,!'\n\t sS éßÉİK日\x1c<|>́\xa0$_&"
    texts = ["".join(random.choices(pick, k=random.randint(0, 40))) for _ in range(4_000)]
    assert ids_of(ChunkIds(VOCABULARY), texts) == list(map(whole, texts))


def check_plan(histogram, capacity):
    """Every document has a place of its own, and sequences are filled from 0 without a gap."""
    plan = plan_packing(histogram, capacity)
    held = {}
    for length in histogram:
        slots = sorted(s for s in plan.slots if s[0] == length)
        for (_, first, sequence, offset, each), after in zip(slots, [*slots[1:], (0, histogram[length])]):
            for rank in range(first, after[1]):
                turn, inside = divmod(rank - first, each)
                held.setdefault(sequence + turn, []).append((offset + inside * length, length))
    assert sum(map(len, held.values())) == sum(histogram.values())
    assert sorted(held) == list(range(plan.sequences))
    for pieces in held.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return plan


@pytest.mark.parametrize("capacity", [1, 7, 64, 500])
def test_plans_hold_every_document(capacity):
    rng = random.Random(capacity)
    for size in (0, 1, 3, 50, 2_000):
        check_plan(Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(size)), capacity)


def best_fit_alone(histogram, capacity):
    plan = Plan(capacity)
    for length in sorted(histogram, reverse=True):
        plan.best_fit(length, histogram[length])
    return plan.sequences


def test_plans_are_near_the_least():
    rng = random.Random(1)
    # Even lengths are hard (long ones abound); lengths like those of texts are not.
    even = Counter(rng.randint(1, 256) for _ in range(20_000))
    assert check_plan(even, 256).sequences <= 1.001 * best_fit_alone(even, 256)
    texts = Counter(min(256, 1 + int(rng.lognormvariate(4.3, 0.9))) for _ in range(20_000))
    assert check_plan(texts, 256).sequences <= -(-sum(n * c for n, c in texts.items()) // 256) + 2
    # Large counts, no more work.
    many = {n: c * 10**6 for n, c in texts.items()}
    assert plan_packing(many, 256).sequences <= best_fit_alone(many, 256)


def test_fit_repeats_patterns():
    lengths = np.array([2, 3, 5])
    patterns = enumerate_patterns(lengths, 10)
    assert {tuple(lengths[p[p >= 0]]) for p in patterns} >= {(5, 5), (5, 3, 2)}
    repeats = fit(patterns, np.array([40, 40, 60]), np.ones(3), steps=2_000)
    used = np.bincount(patterns[patterns >= 0], np.repeat(repeats, 3)[(patterns >= 0).ravel()], 3)
    assert (repeats >= 0).all() and np.allclose(used, [40, 40, 60], atol=0.5)


def test_numbering_runs_on():
    rng, number, seen = np.random.default_rng(2), Numbering(9), Counter()
    for _ in range(20):
        lengths = rng.integers(1, 10, rng.integers(0, 30))
        for length, nth in zip(lengths.tolist(), number(lengths).tolist()):
            assert nth == seen[length]
            seen[length] += 1


def check_pieces(rows, docs, capacity):
    want = Counter()
    for doc in docs:
        ids = [*whole(doc["text"]), 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[doc["doc_id"], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_pieces_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    rows = pack(docs).collect()
    sequences = check_pieces(rows, docs.collect(), CAPACITY)
    assert sequences == -(-sum(r["length"] for r in rows) // CAPACITY)


def test_hostile_rows(hostile, no_docs):
    check_pieces(pack(hostile).collect(), hostile.collect(), CAPACITY)
    check_pieces(pack(hostile, capacity=16).collect(), hostile.collect(), 16)
    assert pack(no_docs).count() == 0


def test_sequences_hold_the_ids(spark, hostile):
    pieces = pack(hostile, capacity=64, with_ids=True)
    sequences = {r["sequence_id"]: r for r in packed_sequences(pieces).collect()}
    for r in pieces.collect():
        assert sequences[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    assert sum(len(s["ids"]) for s in sequences.values()) == sum(len(whole(d["text"])) + 1 for d in hostile.collect())
