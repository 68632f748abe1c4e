"""Packing of whole documents into token sequences of one capacity.

Three steps. (1) Tasks turn texts into ids and cut what is longer than the capacity;
every piece gets its number among those of its length in its task. (2) The histogram
of lengths, at most ``CAPACITY`` rows, is planned on the driver (``patterns``). (3) A
piece's rank among all of its length is its number plus the pieces of earlier tasks,
one running total per length and task; the plan says which ranks go where. So no
length, however frequent, is put in order in one place, and no text is shuffled.

The pieces are written before they are numbered further: a lost executor replays
tasks, never a plan over other numbers.

Ids: this tokenizer drops white space and merges nothing across it, so a text is the
ids of its chunks between ASCII white space, and a worker encodes each distinct chunk
once while it knows it (``KNOWN_CHUNKS`` at most). Words of Latin letters go straight
to the merge model. The tokenizer file is looked up among the public files on each executor.

Defined results: a null or empty text, or one of white space alone, is its end id
alone; repeated rows and null ids come out each; an empty table gives no rows; other
columns are not looked at. Very long texts are encoded whole, memory following the
longest.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import scratch_of, whole_batches
from tidefold.llm.patterns import Plan, plan_packing
from tidefold.llm.tokens import is_latin_word

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
BLOCK_BYTES = 8 << 20
KNOWN_CHUNKS = 1_200_000
# Marks behind a word; a run of them is one unit of merging. An apostrophe may begin another.
_MARKS = punctuation.replace("'", "").encode()
# Ranks of one length stay below this power of two.
_RANK_BITS = 48

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


class ChunkIds(dict):
    """Little-endian unsigned 32-bit ids of chunks without ASCII white space, filled as chunks are met."""

    def __init__(self, file: str, most: int = KNOWN_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.most = most
        self.words: dict[bytes, bytes] = {}
        # The visible characters that stand for a letter's bytes, as the tokenizer itself says.
        show = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.visible = {ord(c): "".join(part for part, _ in show(c)) for c in map(chr, range(0xC0, 0x250)) if c.isalpha()}

    def of_text(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_word(self, low: bytes) -> bytes:
        """Of Latin letters in lower case, which are one unit of merging."""
        ids = self.words.get(low)
        if ids is None:
            shown = low.decode()
            if not shown.isascii():
                shown = shown.translate(self.visible)
            four = self.four
            ids = self.words[low] = b"".join([four[token.id] for token in self.merge(shown)])
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        word = chunk.rstrip(_MARKS)
        # Of bytes, ASCII letters alone are letters.
        if word.isalpha():
            low = word.lower()
        else:
            text = word.decode()
            # The dotted capital I is two characters in lower case.
            low = text.lower().encode() if is_latin_word(text) and "İ" not in text else None
        if low is None:
            ids = self.of_text(chunk.decode())
        elif len(word) < len(chunk):
            ids = self.of_word(low) + self[chunk[len(word) :]]
        else:
            ids = self.of_word(low)
        self[chunk] = ids
        return ids

    def of_documents(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        for text in texts:
            yield b"".join(map(self.__getitem__, text.split())) if text else b""
            if len(self) > self.most:
                self.clear()
            if len(self.words) > self.most:
                self.words.clear()


@lru_cache(maxsize=1)
def worker_ids(file: str) -> ChunkIds:
    """One for all tasks of a worker: what one has met helps the next."""
    return ChunkIds(file)


class Numbering:
    """Running numbers per length."""

    def __init__(self, capacity: int):
        self.seen = np.zeros(capacity + 1, np.int64)

    def __call__(self, lengths: np.ndarray) -> np.ndarray:
        order = np.argsort(lengths, kind="stable")
        counts = np.bincount(lengths, minlength=len(self.seen))
        begin = np.cumsum(counts) - counts
        out = np.empty(len(lengths), np.int64)
        out[order] = np.arange(len(lengths)) - (begin - self.seen)[lengths[order]]
        self.seen += counts
        return out


def cut_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece, with ``task`` and its number ``nth`` among those of its length there; its ``ids`` if asked."""
    step = 4 * capacity
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_ids, number, task = worker_ids(vocabulary), Numbering(capacity), TaskContext.get().partitionId()
        for batch in whole_batches(batches, BLOCK_BYTES):
            rows, pieces, starts, parts = [], [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for row, ids in enumerate(chunk_ids.of_documents(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at // 4)
                    parts.append(ids[at : at + step])
            lengths = np.array([len(part) // 4 for part in parts], np.int64)
            columns = {
                "doc_id": batch.column("doc_id").cast(pa.int64()).take(pa.array(rows)),
                "piece": pa.array(pieces, pa.int32()),
                "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths),
                "ids_crc32": pa.array(list(map(zlib.crc32, parts)), pa.int64()),
                "task": pa.array(np.full(len(rows), task, np.int32)),
                "nth": pa.array(number(lengths)),
            }
            if with_ids:
                values = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
                bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE + ", ids array<int>" * with_ids)


def places(plan: Plan, length: str, rank: str) -> Column:
    """``sequence_id`` and ``offset`` of a piece by its length and its rank among those of that length."""
    slots = np.array(plan.slots, np.int64).reshape(-1, 5)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    keys = (slots[:, 0] << _RANK_BITS) + slots[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        size, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        _, first_rank, first, offset, each = slots[np.searchsorted(keys, (size << _RANK_BITS) + rank, side="right") - 1].T
        turn, inside = np.divmod(rank - first_rank, each)
        return pd.DataFrame({"sequence_id": first + turn, "offset": offset + inside * size})

    return place(length, rank)


def pack(
    docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False, scratch=None
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece; its ``ids`` if asked."""
    scratch = scratch or scratch_of(docs)
    pieces = scratch.save(cut_pieces(docs, vocabulary, capacity, with_ids), "pieces")
    tallies = scratch.save(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("rows")), "tallies")
    # At most a row per length.
    histogram = tallies.groupBy("length").agg(F.sum("rows").alias("rows")).collect()
    plan = plan_packing({row["length"]: row["rows"] for row in histogram}, capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = tallies.select("length", "task", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.withColumn("place", places(plan, "length", "rank"))
    columns = [c for c in pieces.columns if c not in ("task", "nth")]
    return placed.select(*columns, "place.sequence_id", "place.offset")


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, doc_ids, ids`` per sequence, from pieces with ids; a sequence holds ``capacity`` ids at most."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pieces.groupBy("sequence_id").agg(inside.alias("inside")).select(
        "sequence_id",
        F.col("inside.doc_id").alias("doc_ids"),
        F.flatten("inside.ids").alias("ids"),
    )
