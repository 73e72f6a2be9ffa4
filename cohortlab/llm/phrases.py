"""Phrase collocations by Rabin-Karp fingerprints.

Texts are cut into pieces at punctuation and line ends, pieces into words.  Prefix polynomials over the
bytes give each word a fingerprint, prefix polynomials over the word fingerprints give one to every
n-gram, all in numpy over whole batches.  A task combines equal fingerprints of about a million words
and deals them by range to buckets, packed as arrays: fingerprint, second (check) fingerprint, count
and a pointer to one occurrence.  A bucket adds up the counts.  A fingerprint with one check value is
one phrase; with several, texts have collided, and all its entries go on.  The texts at the pointers
are then fetched and counts are summed by text, so a collision never joins two phrases.  Only phrases
that reach ``min_count`` (and collided ones) are ever materialised.

An n-gram of three words or more is counted only if its first and its last n-1 words are frequent,
which their counts imply; a bitmap of at most ``BITMAP_BITS`` bits holds the frequent ones, and where it
is too small more n-grams are counted, with the same result.

Defined results: a null text is empty, a null language is ``und`` and counts with rows that say so.
Texts of any length are worked off in slices; phrases never cross pieces or texts.  Repeated rows
count each time.  Empty tables and texts without words give no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import drop_path, materialize, partitions_for, rows_of, scratch_path, text_of

MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
COVERED = 50  # percent of a phrase's occurrences that lie in one longer candidate
UNKNOWN = "und"
WORD = r"[^ \t.,;:!?\n-\r]+"

SLICE_BYTES = 1 << 20
FLUSH_WORDS = 1_000_000
BUCKET_WORDS = 400_000  # words of the corpus for each bucket
BITMAP_BITS = 1 << 28
SALTS = 32
EMIT_ROWS = 20_000

# Bytes by kind: 0 of a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_RANDOM = np.random.default_rng(20_231)
_BASES = tuple(int(b) | 1 for b in _RANDOM.integers(1 << 62, 1 << 63, 4, dtype=np.uint64))
_BYTES = _RANDOM.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_BLOB = "bucket int, n int, base long, size int, prints binary, checks binary, counts binary, rows binary, places binary"
_FOUND = "n int, count long, row long, place int, print long, checked boolean"


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, length: int) -> np.ndarray:
    """At least ``length`` of 1, base, base squared and so on, modulo 2^64."""
    if len(_tables.get(base, ())) < length:
        out = np.full(1 << max(10, (length - 1).bit_length()), base, np.uint64)
        out[0] = 1
        _tables[base] = np.cumprod(out)
    return _tables[base]


def _window(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """Polynomial fingerprints, modulo 2^64, of values[start:stop] for all spans, from prefix sums."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n + 1)[:n], out=prefix[1:])
    inverse = _powers(pow(base, -1, 1 << 64), n + 1)
    return (prefix[stops] - prefix[starts]) * inverse[starts]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Values spread over all 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4096)
def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of some consecutive texts: span in ``buffer``, text, piece, and place in the text."""

    def __init__(self, buffer: np.ndarray, offsets: np.ndarray) -> None:
        self.buffer = buffer = _LOWER[buffer]
        kind = _KIND[buffer]
        inside = np.zeros(len(buffer) + 2, bool)
        inside[1:-1] = kind == 0
        first = np.zeros(len(buffer) + 1, bool)
        first[offsets] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
        self.stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        breaks = np.cumsum(kind == 2)
        self.piece = breaks[self.starts] + self.text
        self.pieces = len(offsets) - 1 + (int(breaks[-1]) if len(breaks) else 0)
        heads = np.searchsorted(self.text, np.arange(len(offsets) - 1))
        self.place = np.arange(len(self.starts)) - heads[self.text]
        self.in_last = len(self.starts) - int(heads[-1])

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two fingerprints of each word."""
        first, second = (_window(_BYTES[i][self.buffer], self.starts, self.stops, _BASES[i]) for i in (0, 1))
        return _mixed(first), _mixed(second)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.zeros(0, np.uint8) if values is None else np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]


def _slices(values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, Words, bool]]:
    """Words by slices of about SLICE_BYTES, with the number of the slice's first text, the slice's first byte,
    and whether that text began in an earlier slice.  Only texts longer than a slice are cut, between words."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1, at + 1)
        low, high = int(offsets[at]), int(offsets[to])
        if high - low <= SLICE_BYTES:
            yield at, low, Words(values[low:high], offsets[at : to + 1] - low), False
        else:
            start = low
            while start < high:
                stop = min(start + SLICE_BYTES, high)
                while stop < high and not _KIND[values[stop]]:
                    gap = np.flatnonzero(_KIND[values[stop : stop + SLICE_BYTES]])
                    stop = min(stop + (int(gap[0]) if len(gap) else SLICE_BYTES), high)
                yield at, start, Words(values[start:stop], np.array([0, stop - start])), start > low
                start = stop
        at = to


class _Stream:
    """The words of a task's texts one after the other, given out in flushes that know the following words."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.piece = self.place = 0

    def add(self, rows: np.ndarray, languages: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for at, _, words, going_on in _slices(values, offsets):
            text = words.text + at
            piece = words.piece + (self.piece - going_on)  # the last text goes on in its last piece
            place = words.place + (self.place if going_on else 0)
            self.piece += words.pieces - going_on
            self.place = words.in_last + (self.place if going_on else 0)
            self.parts.append((*words.fingerprints(), rows[text], place, piece, languages[text]))
            self.size += len(text)
            if self.size >= FLUSH_WORDS:
                yield self.flush(False)

    def flush(self, last: bool) -> tuple:
        """How many of the held words begin n-grams, and the words; unless ``last`` the rest is kept for the next flush."""
        whole = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        n = len(whole[0])
        own = n if last else n - (self.longest - 1)
        self.parts, self.size = ([], 0) if last else ([tuple(c[own:] for c in whole)], n - own)
        return own, *whole


def _grams(n: int, first: np.ndarray, second: np.ndarray, piece: np.ndarray, language: np.ndarray, own: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beginnings of the n-grams that lie in one piece, and their two fingerprints."""
    at = np.arange(max(0, min(own, len(first) - n + 1)))
    at = at[piece[at + n - 1] == piece[at]]
    salt = language[at] + np.uint64(n)
    prints = _mixed(_window(first, at, at + n, _BASES[2]) + salt) & np.uint64((1 << bits) - 1)
    checks = _mixed(_window(second, at, at + n, _BASES[3]) + salt) >> np.uint64(32)
    return at, prints, checks


def _planes(values: np.ndarray) -> bytes:
    """The array's bytes, all lowest bytes first, so that equal high bytes compress."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _blobs(n: int, prints, checks, rows, places, buckets: int, bits: int) -> Iterator[tuple]:
    """One flush's combined n-grams, dealt to buckets by ranges of the fingerprint."""
    if not len(prints):
        return
    order = np.lexsort((checks, prints)) if bits < 64 else np.argsort(prints)
    prints, checks = prints[order], checks[order]
    if bits == 64:  # equal fingerprints with other checks are rare: sort only these
        again = np.flatnonzero((prints[1:] == prints[:-1]) & (checks[1:] != checks[:-1]))
        if len(again):
            inner = np.lexsort((checks, prints))
            order, prints, checks = order[inner], prints[inner], checks[inner]
    new = np.ones(len(prints), bool)
    new[1:] = (prints[1:] != prints[:-1]) | (checks[1:] != checks[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(prints))).astype(np.uint32)
    prints, checks, source = prints[heads], checks[heads].astype(np.uint32), order[heads]
    rows, places = rows[source], places[source]
    base = int(rows.min())
    width = -(-(1 << bits) // buckets)
    edges = np.array([min(width * i, (1 << bits) - 1) for i in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(prints, edges, "left").tolist(), len(prints)]
    for bucket, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a < b:
            steps = np.diff(prints[a:b], prepend=np.uint64(0))
            yield (
                bucket,
                n,
                base,
                b - a,
                _planes(steps),
                _planes(checks[a:b]),
                _planes(counts[a:b]),
                _planes((rows[a:b] - base).astype(np.uint64)),
                _planes(places[a:b].astype(np.uint32)),
            )


_BLOB_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
_BLOB_NAMES = [c.split()[0] for c in _BLOB.split(", ")]


def _count_task(sizes: tuple[int, ...], buckets: int, bits: int, bitmap) -> Callable:
    longest = max(sizes)

    def of(flushed: tuple) -> Iterator[pa.RecordBatch]:
        own, first, second, rows, places, piece, language = flushed
        out = []
        for n in sizes:
            at, prints, checks = _grams(n, first, second, piece, language, own, bits)
            if bitmap is not None and len(at):
                # an n-gram's parts begin at its first and at its second word
                parts, frequent, _ = _grams(n - 1, first, second, piece, language, len(first), bits)
                seen = np.zeros(len(first) + 1, bool)
                seen[parts] = _in_bitmap(bitmap.value, frequent)
                both = seen[at] & seen[at + 1]
                at, prints, checks = at[both], prints[both], checks[both]
            out += _blobs(n, prints, checks, rows[at], places[at], buckets, bits)
        for i in range(0, len(out), 256):
            columns = zip(*out[i : i + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOB_TYPES, strict=True)], names=_BLOB_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(longest)
        for batch in batches:
            languages = np.array([_language(x) for x in batch["lang"].to_pylist()], np.uint64)
            for flushed in stream.add(batch["row"].to_numpy(), languages, *_buffers(batch["text"])):
                yield from of(flushed)
        if stream.parts:
            yield from of(stream.flush(True))

    return run


def _in_bitmap(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    slot = prints & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _sum_task(min_count: int) -> Callable:
    """Frequent fingerprints of one bucket and n; a fingerprint of several texts gives all its entries."""

    def run(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        blobs = [c.to_pylist() for c in (table[x] for x in ("prints", "checks", "counts", "rows", "places"))]
        prints = np.concatenate([np.cumsum(_unplanes(b, np.uint64)) for b in blobs[0]])
        checks = np.concatenate([_unplanes(b, np.uint32) for b in blobs[1]])
        counts = np.concatenate([_unplanes(b, np.uint32) for b in blobs[2]]).astype(np.int64)
        bases = np.repeat(table["base"].to_numpy(), table["size"].to_numpy())
        rows = np.concatenate([_unplanes(b, np.uint64) for b in blobs[3]]).astype(np.int64) + bases
        places = np.concatenate([_unplanes(b, np.uint32) for b in blobs[4]]).astype(np.int32)
        order = np.argsort(prints, kind="stable")
        prints, checks, counts, rows, places = prints[order], checks[order], counts[order], rows[order], places[order]
        heads = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
        sums = np.add.reduceat(counts, heads)
        mixed = np.maximum.reduceat(checks, heads) != np.minimum.reduceat(checks, heads)
        frequent = sums >= min_count
        clean = np.flatnonzero(frequent & ~mixed)
        member = np.repeat(frequent & mixed, np.diff(np.append(heads, len(prints))))
        alike = np.flatnonzero(member)
        at = np.concatenate([heads[clean], alike])
        count = np.concatenate([sums[clean], counts[alike]])
        sure = np.concatenate([np.ones(len(clean), bool), np.zeros(len(alike), bool)])
        columns = [np.full(len(at), n, np.int32), count, rows[at], places[at], prints[at].view(np.int64), sure]
        return pa.table([pa.array(c) for c in columns], names=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def _frequent(texts: DataFrame, sizes: tuple[int, ...], words: int, min_count: int, bits: int, bitmap=None) -> DataFrame:
    """Written pointers of the frequent n-grams of the given sizes."""
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(partitions_for(words, BUCKET_WORDS, least), 1 << bits)
    blobs = texts.select("row", "lang", F.col("text").cast("binary").alias("text"))
    blobs = blobs.mapInArrow(_count_task(sizes, buckets, bits, bitmap), _BLOB)
    return materialize(blobs.groupBy("bucket", "n").applyInArrow(_sum_task(min_count), _FOUND), "frequent")


def _bitmap(found: DataFrame, n: int) -> np.ndarray:
    """Bits of the frequent n-grams' fingerprints, 16 for each as long as BITMAP_BITS allows."""
    prints = found.where(F.col("n") == n).select("print")
    size = 1 << min(BITMAP_BITS.bit_length() - 1, max(13, (16 * prints.count()).bit_length()))
    slot = F.col("print").bitwiseAND(size - 1)
    cell = F.shiftright(slot, 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    cells = prints.groupBy(cell.alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return out.view(np.uint8)


def _texts_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases at the pointers of each text."""
    names, types = ["lang", "n_words", "phrase", "count"], [pa.string(), pa.int32(), pa.string(), pa.int64()]
    for batch in batches:
        values, offsets = _buffers(batch["text"])
        found = [(words.starts + low, words.stops + low, words.text + at) for at, low, words, _ in _slices(values, offsets)]
        starts, stops, text = (np.concatenate(c) for c in zip(*found, strict=True))
        lists = batch["pointers"]
        pointers = lists.flatten()
        n, place, count = (pointers.field(c) for c in ("n", "place", "count"))
        owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        head = np.searchsorted(text, owner) + place.to_numpy()
        tail = head + n.to_numpy() - 1
        data = values.tobytes()
        spans = zip(starts[head].tolist(), stops[tail].tolist(), strict=True)
        # bytes.lower changes A-Z alone; inside a piece only blanks and tabs part words
        phrases = [b" ".join(data[a:b].lower().split()).decode() for a, b in spans]
        languages = batch["lang"].take(pa.array(owner))
        for i in range(0, len(phrases), EMIT_ROWS):
            columns = [languages[i : i + EMIT_ROWS], n[i : i + EMIT_ROWS], phrases[i : i + EMIT_ROWS], count[i : i + EMIT_ROWS]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _materialised(texts: DataFrame, found: DataFrame, min_count: int) -> DataFrame:
    """Written table of lang, n_words, phrase and f of every frequent n-gram, summed by its text."""
    pointers = found.groupBy("row").agg(F.collect_list(F.struct("n", "place", "count")).alias("pointers"))
    pointed = texts.select("row", "lang", F.col("text").cast("binary").alias("text")).join(pointers, "row")
    phrases = pointed.select("lang", "text", "pointers").mapInArrow(_texts_at, "lang string, n_words int, phrase string, count long")
    counted = phrases.groupBy("lang", "n_words", "phrase").agg(F.sum("count").alias("f"))
    return materialize(counted.where(F.col("f") >= min_count), "phrases")


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> tuple[DataFrame, str]:
    """Written row number, language, text and number of words of every row, and where they are written."""
    spark = docs.sparkSession
    path = scratch_path(spark, "texts")
    text = text_of(docs, text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(docs[lang_col].cast("string"), F.lit(UNKNOWN)).alias("lang"),
        text.alias("text"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def frequent_phrases(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    lang_col: str = "lang",
    text_col: str = "text",
    bits: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of one to ``max_words`` words (lang, n_words, phrase, f), and lang, n of all languages.

    ``bits`` shortens the fingerprints, for tests of collisions.
    """
    spark = docs.sparkSession
    texts, path = _texts(docs, lang_col, text_col)
    totals = materialize(texts.groupBy("lang").agg(F.sum("words").alias("n")), "totals")
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = _frequent(texts, tuple(range(1, min(2, max_words) + 1)), words, min_count, bits)
    last = found
    for n in range(3, max_words + 1):
        bitmap = spark.sparkContext.broadcast(_bitmap(last, n - 1))
        last = _frequent(texts, (n,), words, min_count, bits, bitmap)
        bitmap.unpersist()
        found = found.unionByName(last)
    phrases = _materialised(texts, found, min_count)
    drop_path(spark, path)
    return phrases, totals


def _part(first: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def collocations(
    docs: DataFrame,
    top: int = TOP,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    lang_col: str = "lang",
    text_col: str = "text",
    bits: int = 64,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of two words or more of each language.

    The score is floor(1000000 a^2 / (l r)) for the cut into l and r that gives the least; a phrase
    is left out if a longer candidate that holds it has at least half of its occurrences.
    """
    phrases, totals = frequent_phrases(docs, max_words, min_count, lang_col, text_col, bits)
    candidates = phrases.where("n_words > 1").withColumn("words", F.split("phrase", " ")).withColumnRenamed("f", "a")
    cuts = candidates.select("lang", "phrase", "n_words", "a", "words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "n_words", "a", "k", _part(1, F.col("k")).alias("w_left"), _part(F.col("k") + 1, F.col("n_words")).alias("w_right"))
    lefts = phrases.select("lang", F.col("phrase").alias("w_left"), F.col("f").alias("l"))
    rights = phrases.select("lang", F.col("phrase").alias("w_right"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of two need up to 38 digits
    cuts = cuts.join(lefts, ["lang", "w_left"]).join(rights, ["lang", "w_right"])
    cuts = cuts.withColumn("above", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("below", wide("l") * wide("r"))
    scored = cuts.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase", "n_words", "a")
    scored = scored.agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = candidates.where("n_words > 2").select("lang", "words", "n_words", F.col("a").alias("longer"))
    inside = inside.select("*", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("size"))
    inside = inside.select("lang", "words", "size", "longer", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)).alias("first"))
    covers = inside.groupBy("lang", _part(F.col("first"), F.col("size")).alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = scored.join(covers, ["lang", "phrase"], "left").where(
        f"longer is null or 100 * cast(longer as decimal(20,0)) < {COVERED} * cast(a as decimal(20,0))"
    )

    # the first of salted parts, then the first of these, so that no task sorts a language's phrases
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    part = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    rows = rows.withColumn("place", part).where(F.col("place") <= top).withColumn("rank", rank).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
