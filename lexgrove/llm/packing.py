"""Harmonic packing: classes of reciprocal-capacity lengths, a fixed count of documents in each bin of a class.

A document of class k is over capacity / (k + 1) and up to capacity / k tokens long; k of them make a bin of their class, whole.
What a bin has left is filled from a small store of documents of the same worker: first with whole ones that fit, then with a
piece cut from one. A document longer than a sequence gives off whole sequences first. Each worker fills its bins on its
own; what it has left over at its end is laid end to end and cut at capacity, and at last at powers of two, which need no padding.
The sequence ids of a worker start at its partition number shifted left.

Ids come from the tokenizer file itself, by `tokenizers`; those of words that come again are kept. A text with one of the file's added
tokens, or with white space that a token of the file spans, is encoded as a whole.

Defined results: a null text counts as an empty one and gives the end id alone; texts of any length are packed
whole, bytes that aren't UTF-8 as U+FFFD; repeated rows are packed each; an empty table gives an empty result; other columns of the input are not
read; ids are of any atomic type, and a null one passes through.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.llm.common import let_go, slices, table, texts_in

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 2048
#: The bits of a sequence id below the number of the partition.
SEQUENCE_BITS = 36
#: Marks that a word may end with: those of ASCII that no contraction begins with.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
NEWLINES = re.compile(r"\n+")
#: The character that byte-level models have for each byte.
SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
HIDDEN = [b for b in range(256) if b not in SHOWN]
BYTES = [chr(b if b in SHOWN else 256 + HIDDEN.index(b)) for b in range(256)]
#: Bytes of texts that are encoded at once.
SLICE_BYTES = 1_000_000
#: Bytes of words and ids that a worker keeps, about.
MOST_KEPT = 150_000_000
#: Bytes of a kept word besides its own.
KEPT = 160


class Words(dict):
    """The ids of items of texts: a word stands for itself behind a space, an item that begins with a newline for itself as it is, and one that
    begins with a space for what follows that space, as it is. An item is kept from its second time on, as most come once.

    Words of letters, and marks behind a letter, are pieces of the file's pre-tokenizer, so they go to the file's model directly;
    other items go through the whole tokenizer."""

    def __init__(self, tokenizer: Tokenizer, most: int) -> None:
        super().__init__()
        self.tokenizer, self.model, self.most = tokenizer, tokenizer.model, most
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.size, self.seen = 0, bytearray(1 << 22)

    def __missing__(self, item: str) -> bytes:
        ids = self._made(item)
        place = hash(item) & (len(self.seen) - 1)
        if self.seen[place]:
            if self.size > self.most:
                self._forget()
            self[item] = ids
            self.size += KEPT + len(item) + len(ids)
        else:
            self.seen[place] = 1
        return ids

    def _made(self, item: str) -> bytes:
        core = item.rstrip(MARKS)
        if len(core) < len(item) and lettered(core[-1:]):
            return self[core] + self[" " + item[len(core) :]]
        text = item[1:] if item[:1] == " " else item if item[:1] == "\n" else " " + item
        if text[:1] == "\n":
            rest = text.lstrip("\n")
            if lettered(rest):  # the last newline is a piece of its own
                return self[" " + text[: -len(rest) - 1]] + self[" \n"] + self._letters(rest)
        elif lettered(text.removeprefix(" ")):
            return self._letters(text)
        return self.whole(text)

    def _letters(self, piece: str) -> bytes:
        """The ids of a piece, whose bytes the model knows as characters."""
        shown = piece.replace(" ", BYTES[0x20]) if piece.isascii() else "".join([BYTES[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""


class Encoder:
    """The ids of texts, as little-endian 32-bit numbers, as `tokenizers` gives them for the file.

    The file's pre-tokenizer never joins what stands before a space or a newline with what follows it, unless both are white space. So a text
    is cut before each space and each run of newlines, and what is between is encoded on its own, unless one of the file's tokens spans such a place."""

    def __init__(self, json_path: str | None = None, most: int = MOST_KEPT) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.known = most, Words(self.tokenizer, most)
        self.spanned = spanned(self.tokenizer)

    def __call__(self, text: str) -> bytes:
        if self.spanned is None or any(t in text for t in self.special) or any(t in text for t in self.spanned):
            return self.known.whole(text)
        head, *items = (NEWLINES.sub(r" \g<0>", text) if "\n\n" in text else text.replace("\n", " \n")).split(" ")
        return self.known[" " + head] + b"".join(map(self.known.__getitem__, items))


def lettered(word: str) -> bool:
    """Whether it has only letters, of those scripts in which all versions of Unicode agree about them."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0530")


def spanned(tokenizer: Tokenizer) -> list[str] | None:
    """The pairs of characters in a token whose second is a space or a newline, but for two newlines: texts with such a pair can't be cut there.
    None if no text can be cut, as the pre-tokenizer or the model is of another kind."""
    from tokenizers.models import BPE

    splits, model = tokenizer.pre_tokenizer and json.loads(tokenizer.pre_tokenizer.__getstate__()), tokenizer.model
    plain = splits and splits["type"] == "ByteLevel" and splits["use_regex"] and not splits["add_prefix_space"]
    if tokenizer.normalizer or tokenizer.truncation or tokenizer.padding or not plain or not isinstance(model, BPE) or model.dropout or model.unk_token or model.continuing_subword_prefix or model.end_of_word_suffix:
        return None
    found = set()
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if (BYTES[0x20] in token[1:] or BYTES[0x0A] in token[1:]) and set(token) <= set(BYTES):
            text = bytes(map(BYTES.index, token)).decode("utf-8", "replace")
            found |= {b if a == "\ufffd" else a + b for a, b in zip(text, text[1:], strict=False) if b in " \n"}
    return sorted(found - {"\n\n"})


@lru_cache(maxsize=2)
def encoder(json_path: str | None = None, most: int = MOST_KEPT) -> Encoder:
    """One for each worker, whose tasks follow each other."""
    return Encoder(json_path, most)


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """The largest k with length <= capacity / k."""
    return capacity // length


class Packer:
    """Fills the bins of one worker. A bin is open until it holds its class's count of documents."""

    def __init__(self, first_id: int, capacity: int = CAPACITY) -> None:
        self.next_id, self.capacity = first_id, capacity
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.store: list[tuple] = []  # (tokens, number, row, start, ids, tokens of the document), by tokens
        self.stored = self.turn = 0

    def add(self, row: tuple, ids: np.ndarray) -> Iterator[tuple]:
        start, n = 0, len(ids)
        while n - start >= self.capacity:
            yield from self._close([(row, start, ids[start : start + self.capacity], n)])
            start += self.capacity
        if start == n:
            return
        piece = (row, start, ids[start:], n)
        if self.stored < self.capacity:  # at least what any bin lacks
            self._keep(piece)
            return
        k = class_of(n - start, self.capacity)
        held = self.open[k]
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            yield from self._close(self._filled(held))

    def _keep(self, piece: tuple) -> None:
        self.turn += 1
        insort(self.store, (len(piece[2]), self.turn, *piece))
        self.stored += len(piece[2])

    def _take(self, at: int) -> tuple:
        _, _, row, start, ids, n = self.store.pop(at)
        self.stored -= len(ids)
        return row, start, ids, n

    def _filled(self, held: list[tuple]) -> list[tuple]:
        """The bin with its rest filled: whole documents of the store while one fits, then a piece of the longest."""
        room = self.capacity - sum(len(p[2]) for p in held)
        while room and self.store:
            at = bisect_right(self.store, room, key=lambda x: x[0]) - 1
            if at >= 0:
                held.append(self._take(at))
            else:
                row, start, ids, n = self._take(len(self.store) - 1)
                held.append((row, start, ids[:room], n))
                self._keep((row, start + room, ids[room:], n))
            room -= len(held[-1][2])
        return held

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for row, start, ids, n in pieces:
            yield (*row, start, len(ids), zlib.crc32(ids.tobytes()), n, self.next_id, offset)
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> Iterator[tuple]:
        """What is left, at most one bin of each class and the store: laid end to end and cut at capacity and then at powers of two."""
        left, line = [p for k in sorted(self.open) for p in self.open[k]] + [x[2:] for x in self.store], []
        rest = sum(len(p[2]) for p in left)
        room = self._room(rest)
        for row, start, ids, n in left:
            while len(ids):
                part = ids[:room]
                line.append((row, start, part, n))
                start, ids, room, rest = start + len(part), ids[len(part) :], room - len(part), rest - len(part)
                if not room:
                    yield from self._close(line)
                    line, room = [], self._room(rest)
        self.open.clear()
        self.store.clear()

    def _room(self, rest: int) -> int:
        return self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1) if rest else 0


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, json_path: str | None = None, most_kept: int = MOST_KEPT, lasting: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. No shuffle. most_kept: bytes of words
    that a worker keeps, which change no result. lasting: whether it keeps them, and the tokenizer, when a task has ended."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names)])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, most_kept)
        packer = Packer(TaskContext.get().partitionId() << SEQUENCE_BITS, capacity)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            ids, *numbers = zip(*rows, strict=True)
            return pa.record_batch([pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in numbers)], names=schema.names)

        kind = None
        for whole in batches:
            kind = whole.column(0).type
            for part in slices(whole, SLICE_BYTES):
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), texts_in(part.column(1)), strict=True):
                    rows += packer.add((doc,), np.frombuffer(encode(text) + end, "<u4"))
                if rows:
                    yield batch(rows)
        if rows := list(packer.finish()):
            yield batch(rows)
        if not lasting:
            del encode
            encoder.cache_clear()
            let_go()

    return source.mapInArrow(run, schema)


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
