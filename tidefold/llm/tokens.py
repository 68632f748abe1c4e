"""Token counts of whole texts without their ids.

A text is cut where the tokenizer never merges across: before each space that
follows a character that is no white space. Such a run is the pre-token here. A
block of documents (cut by bytes, so memory is bounded) is reduced to the
frequency of each pre-token in each document; each distinct pre-token is given
to the tokenizer once; the piece counts are looked up by pre-token and summed by
frequency. Counts already made are kept for the worker's next blocks, up to
``KNOWN_TERMS``. No text leaves its task, so there is no shuffle, a frequent
pre-token is no hot key, and a lost executor costs its own tasks alone.

The tokenizer file is named, never copied: ``vocabulary`` is looked up among the
public files on each executor.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows and
null ids come out each; an empty table gives no rows; other columns are not
looked at. A text without any space is one pre-token.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import mul

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidefold.llm.common import whole_batches

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
BLOCK_BYTES = 8 << 20
KNOWN_TERMS = 400_000
# Marks that may follow a word; a run of them is one unit of merging.
MARKS = ".,;:!?"
SCHEMA = "doc_id long, n_bytes long, n_tokens long"

_UNSAFE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


class JsonPieces:
    """Piece counts by a tokenizer kept as .json."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        # The visible character that stands for each byte, as the tokenizer itself says.
        show = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.space = show(" ")[0][0]
        self.visible = {c: "".join(part for part, _ in show(c)) for c in map(chr, range(0xC0, 0x250)) if c.isalpha()}

    def of_texts(self, texts: list[str]) -> list[int]:
        return list(map(len, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)))

    def of_word(self, word: str) -> int:
        """Of a word of Latin letters with a space before it, which is one unit of merging."""
        shown = word if word.isascii() else "".join(self.visible.get(c, c) for c in word)
        return len(self.merge(self.space + shown))


def is_latin_word(text: str) -> bool:
    """Letters whose class no Unicode version has changed."""
    return text.isalpha() and (text.isascii() or (max(text) < "\u0250" and not set(text) & {"\xaa", "\xb5", "\xba"}))


def pre_tokens(text: str) -> tuple[str, list[str]]:
    """The first pre-token, and the others without the space that each begins with."""
    parts = text.split(" ") if not _UNSAFE.search(text) else _CUT.split(text)
    return parts[0], parts[1:]


class PieceCounts:
    """Pieces per pre-token, counted once while known."""

    def __init__(self, pieces: JsonPieces, most: int = KNOWN_TERMS):
        self.pieces, self.most = pieces, most
        self.known: dict[str, int] = {}
        self.marks: dict[str, int] = {}

    def learn(self, terms: Iterable[str]) -> None:
        """Count new pre-tokens; a mark after a word is a unit of its own."""
        known, others = self.known, []
        for term in terms:
            word = term.rstrip(MARKS)
            if not is_latin_word(word):
                others.append(term)
                continue
            if word not in known:
                known[word] = self.pieces.of_word(word)
            if len(word) < len(term):
                mark = term[len(word) :]
                if mark not in self.marks:
                    self.marks[mark] = self.pieces.of_texts([mark])[0]
                known[term] = known[word] + self.marks[mark]
        known.update(zip(others, self.pieces.of_texts([f" {term}" for term in others])))

    def totals(self, texts: Iterable[str | None]) -> list[int]:
        firsts, tables = [], []
        for text in texts:
            first, rest = pre_tokens(text or "")
            firsts.append(first)
            tables.append(Counter(rest))
        known = self.known
        self.learn({term for table in tables for term in table if term not in known})
        sums = [
            first + sum(map(mul, map(known.__getitem__, table), table.values()))
            for first, table in zip(self.pieces.of_texts(firsts), tables)
        ]
        if len(known) > self.most:
            known.clear()
        return sums


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(JsonPieces(vocabulary))
        for batch in whole_batches(batches, BLOCK_BYTES):
            text = batch.column("text")
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            total = pa.array(counts.totals(text.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), size, total], ["doc_id", "n_bytes", "n_tokens"]
            )

    counted = docs.select("doc_id", "text").mapInArrow(count, SCHEMA)
    return counted.withColumn("over_limit", counted["n_tokens"] > limit)
