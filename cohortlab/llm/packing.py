"""Packing of tokenised documents by shortest-pack-first over the length histogram.

Documents are tokenised once, where they are read; what travels afterwards is one short row a
piece.  A document is cut into pieces of the maximal length and a rest.  Lengths are placed
longest first, each on the pack that has the most room left, for whole bars of the histogram at
a time; the result is a list of patterns (lengths that share a sequence) with counts, whose size
depends on the maximal length and not on the number of documents.  Pieces then find their place
by rank: the i-th piece of a length takes the i-th place for that length.

Ranks are offsets of (length, bucket) groups plus a rank inside the group, so a length that a
third of all pieces have is not ranked in one task.

Defined cases: a null or empty text is the end token alone; null ids and repeated rows are
documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import materialize, partitions_for, rows_of, text_of

MAX_LENGTH = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k"
REMEMBERED = 150_000  # chunks of text whose ids a worker keeps
PIECES_PER_BUCKET = 50_000

_PIECE = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"
_GAP = re.compile(r"\s\s")
_LATIN_END = "\u0250"


class Encoder(dict):
    """Ids of the byte-level vocabulary, remembered for each stretch between single spaces.

    No token of the vocabulary's split rule reaches from a non-space to the space after it, so the
    stretches of a text can be encoded one by one.  Texts with runs of white space, and texts that
    spell the vocabulary's special token, go to the tokenizer as a whole.  As a dictionary it maps
    a stretch to the ids of the stretch after a space; at most 2 * REMEMBERED are kept, those used last.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.by_ranks = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.earlier: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if _GAP.search(text):
            return array("I", self.by_ranks.encode_ordinary(text)).tobytes()
        first, *rest = text.split(" ")
        head = array("I", self.by_ranks.encode_ordinary(first)).tobytes()
        return head + b"".join(map(self.__getitem__, rest))

    def __missing__(self, stretch: str) -> bytes:
        ids = self.earlier.pop(stretch, None)
        if ids is None:
            if stretch.isalpha() and max(stretch) < _LATIN_END:  # one token of the split rule
                found = self._word(stretch)
            else:
                found = self.by_ranks.encode_ordinary(" " + stretch)
            ids = array("I", found).tobytes()
        if len(stretch) < 64:
            self[stretch] = ids
            if len(self) > REMEMBERED:
                self.earlier = dict(self)
                self.clear()
        return ids

    def _word(self, word: str) -> list[int]:
        return self.by_ranks._core_bpe.encode_single_piece((" " + word).encode())


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def pieces(
    docs: DataFrame,
    max_length: int = MAX_LENGTH,
    vocabulary: str = VOCABULARY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Written table of the pieces of every document: place in the document, length and checksum."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), array("I", [END_ID]).tobytes()
        for batch in batches:
            out = []
            for doc_id, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode.ids(text) + end
                for at in range(0, len(ids), 4 * max_length):
                    piece = ids[at : at + 4 * max_length]
                    out.append((doc_id, row, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
            names = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"]
            arrays = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = rows_of(docs, id_col, row=F.monotonically_increasing_id(), text=text_of(docs, text_col))
    return materialize(rows.mapInArrow(cut, _PIECE), "pieces")


def shortest_pack_first(histogram: dict[int, int], max_length: int = MAX_LENGTH) -> list[tuple[int, list[int]]]:
    """(count, lengths) patterns that hold every length of the histogram as often as it occurs."""
    open_packs: dict[int, list[tuple[int, list[int]]]] = {}  # by room left
    rooms: list[int] = []
    full: list[tuple[int, list[int]]] = []

    def put(room: int, count: int, lengths: list[int]) -> None:
        if not room:
            full.append((count, lengths))
        elif room in open_packs:
            open_packs[room].append((count, lengths))
        else:
            open_packs[room] = [(count, lengths)]
            bisect.insort(rooms, room)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                put(max_length - length, left, [length])
                break
            room = rooms[-1]
            count, lengths = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
                rooms.pop()
            taken = min(left, count)
            if taken < count:
                put(room, count - taken, lengths)
            put(room - length, taken, [*lengths, length])
            left -= taken
    return full + [pack for room in rooms for pack in open_packs[room]]


class Places:
    """Sequence and offset of the i-th piece of a length."""

    def __init__(self, patterns: list[tuple[int, list[int]]]) -> None:
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        sequence = 0
        for count, lengths in patterns:
            offset = 0
            for length in lengths:
                by_length.setdefault(length, []).append((count, sequence, offset))
                offset += length
            sequence += count
        self.sequences = sequence
        self.base = np.zeros(max(by_length, default=0) + 1, dtype=np.int64)
        counts, self.first, self.offset = [], [], []
        total = 0
        for length in sorted(by_length):
            self.base[length] = total
            for count, first, offset in by_length[length]:
                counts.append(count)
                self.first.append(first)
                self.offset.append(offset)
                total += count
        self.ends = np.cumsum(np.array(counts, dtype=np.int64))
        self.first, self.offset = np.array(self.first, np.int64), np.array(self.offset, np.int64)
        self.starts = self.ends - np.array(counts, dtype=np.int64)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.base[length] + rank
        at = np.searchsorted(self.ends, place, "right")
        return self.first[at] + place - self.starts[at], self.offset[at]


def pack(cut: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """The pieces of a written ``pieces`` table with their sequence_id and offset."""
    buckets = partitions_for(cut.count(), PIECES_PER_BUCKET, int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("row", "start"), F.lit(buckets)).cast("int"))
    groups = materialize(keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(shortest_pack_first(histogram, max_length))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("row", "start")
    ranked = keyed.withColumn("nth", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch["length"].to_numpy(), batch["rank"].to_numpy())
            arrays = [*(batch[c] for c in columns), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, (F.col("nth") + F.col("before")).alias("rank")).mapInArrow(
        place, ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"])
    )


def pack_documents(docs: DataFrame, max_length: int = MAX_LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every piece of every document with its sequence and the place in it."""
    return pack(pieces(docs, max_length, vocabulary), max_length)
