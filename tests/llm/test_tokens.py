import random

import public_tokenizers
from tokenizers import Tokenizer

from tidefold.llm.tokens import VOCABULARY, JsonPieces, PieceCounts, token_counts

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def whole(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False))


ODD = [
    "", " ", "  a  b ", "a <|endoftext|> b<|endoftext|>c", "x\n y\t z \n", "a  b  c\x1c d", " lead", "don't  'S I'm",
    "日本語 テキスト 🙂 é̀", "\n \n\n  x", "a\x85 b", " \x1f x", "a é ñandu, ö. ſt µm ªb, ĳs œuvre!? x.y, .. Ωmega Ǆ ß ÿ. Å, ﬁ",
    "<|endoftext|>", "a,. b?! c;", "١٢ ½ x² ª", " a  b",
]


def test_equals_the_tokenizer(documents):
    texts = ODD + [r["text"] for r in documents.select("text").collect()]
    # Few known terms, so that forgetting them is met as well.
    counts = PieceCounts(JsonPieces(VOCABULARY), most=100)
    assert counts.totals(texts) == list(map(whole, texts))
    assert counts.totals(texts[::-1]) == list(map(whole, texts[::-1]))


def test_random_texts_equal_the_tokenizer():
    random.seed(5)
    pick = "ab Ab1 .,!'\n\t  éß日\x1c<|>"
    texts = ["".join(random.choices(pick, k=random.randint(0, 40))) for _ in range(5_000)]
    assert PieceCounts(JsonPieces(VOCABULARY)).totals(texts) == list(map(whole, texts))


def test_hostile_rows(hostile, no_docs):
    got = sorted((tuple(r) for r in token_counts(hostile).collect()), key=repr)
    want = [
        (r["doc_id"], len((r["text"] or "").encode()), whole(r["text"]), whole(r["text"]) > 512)
        for r in hostile.select("doc_id", "text").collect()
    ]
    assert got == sorted(want, key=repr)
    assert token_counts(no_docs).count() == 0
