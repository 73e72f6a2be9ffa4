"""Hashed maximum-entropy language model with a class-factored softmax.

Words are hashes.  The OWN most frequent words have a class of their own, all others share
classes by their hash; a class is one of 32 groups times one of 32 members, so that

    P(word | history) = P(group | history) * P(member | group, history) * P(word | class).

The first two factors are softmaxes over the sum of weights of hashed features: the word before,
the word before that (skip), and both together; their biases are the logs of the class shares.
The last factor is the smoothed share of the word's count in its class, with one smoothing share
for unseen words, so the probabilities of a class sum to 1.

Counts come from all training documents.  Weights are trained in rounds: each round takes a third
of the training documents, every task sums what its features should and do predict, the sums
meet in blocks of weights, and the difference between the two moves the weights.  Weights have a
fixed size (a parameter) and travel to the tasks; word counts never do, but for the KEPT most
frequent words.  Rarer words are sent to their counts as (word, row, times) and come back summed by row.

Defined cases: null and empty texts are the end token alone; a null id counts as held out; repeated
rows are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm import textscan
from cohortlab.llm.common import materialize, partitions_for, rows_of, text_of

FOLDS = 10
ROUNDS = ((1, 2, 3), (4, 5, 6), (7, 8, 9))
SMOOTH = 0.1
WIDTH = 32
OWN = 512
KEPT = 1 << 18
BUCKETS = 1 << 14
BLOCKS = 64
STEP = 0.5
PRIOR = 2.0
TOKENS_PER_TASK = 4_000_000
LEAST_TASKS = 8
SLICE = 8_192  # tokens handled at once
SINGLY = 3  # values of a bucket that are added one by one

END = np.uint64(0x656E645F6F665F74)
START = np.uint64(0x73746172745F6F66)
_SALT = textscan.mix(np.arange(71, 75, dtype=np.uint64))
_ONES = np.ones(WIDTH, dtype=np.float32)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a batch with an end token after each text, each text's row, and the texts' lengths."""
    data, offsets = textscan.text_bytes(column)
    words, at = textscan.word_hashes(data, offsets)
    lengths = np.diff(at) + 1
    ends = np.cumsum(lengths) - 1
    tokens = np.empty(len(words) + len(lengths), dtype=np.uint64)
    is_word = np.ones(len(tokens), dtype=bool)
    is_word[ends] = False
    tokens[is_word], tokens[ends] = words, END
    return tokens, np.repeat(np.arange(len(lengths)), lengths), lengths


def _features(tokens: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Hashed features of the history of each token; histories do not reach into the text before."""
    starts = np.cumsum(lengths) - lengths
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = START
    earlier = np.empty_like(tokens)
    earlier[1:] = before[:-1]
    earlier[starts] = START
    with np.errstate(over="ignore"):
        return [
            textscan.mix(before + _SALT[0]),
            textscan.mix(earlier + _SALT[1]),
            textscan.mix(before * _SALT[2] + earlier + _SALT[2]),
        ]


class Classes:
    """Class of a word hash, and what is known of all classes."""

    def __init__(self, own: np.ndarray, totals: np.ndarray, kinds: np.ndarray) -> None:
        self.place = np.argsort(own, kind="stable")
        self.own = own[self.place]
        shares = (totals + SMOOTH * (kinds + 1)).reshape(WIDTH, WIDTH)
        self.log_total = np.log10(shares.ravel())
        self.group_bias = np.log(shares.sum(1) / shares.sum()).astype(np.float32)
        self.member_bias = np.log(shares / shares.sum(1, keepdims=True)).astype(np.float32)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return class_of(tokens, self.own, self.place)


def class_of(tokens: np.ndarray, own: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``own``: the sorted frequent words; ``place``: their classes."""
    out = OWN + ((tokens >> np.uint64(20)) % np.uint64(WIDTH * WIDTH - OWN)).astype(np.int64)
    if len(own):
        at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
        known = own[at] == tokens
        out[known] = place[at[known]]
    return out


class Model:
    """Weights of both softmaxes; rows are feature buckets."""

    def __init__(self, classes: Classes) -> None:
        self.classes = classes
        self.group = np.zeros((BUCKETS, WIDTH), dtype=np.float32)
        self.member = np.zeros((BUCKETS, WIDTH), dtype=np.float32)

    def buckets(self, features: list[np.ndarray], group: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Buckets of the features for the groups, and together with the group for its members."""
        mask = np.uint64(BUCKETS - 1)
        with np.errstate(over="ignore"):
            salt = (group.astype(np.uint64) + np.uint64(1)) * _SALT[3]
            inner = [((textscan.mix(f + salt)) & mask).astype(np.int64) for f in features]
        return [(f & mask).astype(np.int64) for f in features], inner

    @staticmethod
    def softmax(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
        x = weights.take(rows[0], axis=0, mode="clip")  # buckets are in bounds; clip spares the copy that raising needs
        x += bias
        for r in rows[1:]:
            x += weights.take(r, axis=0, mode="clip")
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x *= (1 / (x @ _ONES))[:, None]
        return x

    def both(self, tokens: np.ndarray, features: list[np.ndarray]):
        """Class, buckets and class distributions of tokens."""
        cls = self.classes.of(tokens)
        group, member = cls // WIDTH, cls % WIDTH
        outer, inner = self.buckets(features, group)
        p_group = self.softmax(self.group, outer, self.classes.group_bias)
        p_member = self.softmax(self.member, inner, self.classes.member_bias[group])
        return cls, ((group, outer, p_group), (member, inner, p_member))

    def log10_class(self, tokens: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
        """log10 of the class's probability, less that of the class's total."""
        cls, parts = self.both(tokens, features)
        at = np.arange(len(tokens))
        total = sum(np.log10(np.maximum(p[at, y], 1e-30).astype(np.float64)) for y, _, p in parts)
        return total - self.classes.log_total[cls]


def _sum_rows(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add each value to its row of ``out``: most buckets occur once or twice, the others' further values go as segments."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # buckets fit; such keys are sorted by radix
    ordered = rows[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    times = np.diff(np.r_[first, len(rows)])
    for k in range(SINGLY):
        at = first[times > k] + k
        out[ordered[at]] += values[order[at]]
    more = times > SINGLY
    if more.any():
        late = np.arange(len(rows)) - np.repeat(first, times) >= SINGLY
        left = times[more] - SINGLY
        out[ordered[first[more]]] += np.add.reduceat(values[order[late]], np.cumsum(left) - left, axis=0)


def _gradient(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS * WIDTH), dtype=np.float32)
        expected = np.zeros((2, BUCKETS, WIDTH), dtype=np.float32)
        any_rows = False
        for text in (batch["text"].slice(at, 2_000) for batch in batches for at in range(0, batch.num_rows, 2_000)):
            tokens, _, lengths = _tokens(text)
            features = _features(tokens, lengths)
            any_rows |= len(tokens) > 0
            for at in range(0, len(tokens), SLICE):
                part = slice(at, at + SLICE)
                _, levels = model.both(tokens[part], [f[part] for f in features])
                for level, (y, rows, p) in enumerate(levels):
                    for r in rows:
                        np.add.at(seen[level], r * WIDTH + y, np.float32(1))
                        _sum_rows(expected[level], r, p)
        if any_rows:
            both = np.stack([seen.reshape(2, BLOCKS, -1), expected.reshape(2, BLOCKS, -1)], axis=2)
            for level in range(2):
                payload = [both[level, b].tobytes() for b in range(BLOCKS)]
                numbers = [level * BLOCKS + b for b in range(BLOCKS)]
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(payload, pa.binary())], names=["block", "sums"])

    return sums


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, payload in zip(batch["block"].to_pylist(), batch["sums"].to_pylist(), strict=True):
            values = np.frombuffer(payload, dtype=np.float32).astype(np.float64)
            totals[block] = totals[block] + values if block in totals else values
    if totals:
        steps = []
        for values in totals.values():
            seen, expected = values.reshape(2, -1)
            steps.append((STEP * np.log1p((seen - expected) / (expected + PRIOR))).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(steps, pa.binary())], names=["block", "step"])


def train(rows: DataFrame, classes: Classes, n_tokens: int) -> Model:
    """Model after one pass over the training rows (fold, text), in rounds of folds."""
    model = Model(classes)
    for folds in ROUNDS:
        tasks = partitions_for(n_tokens / len(ROUNDS), TOKENS_PER_TASK, LEAST_TASKS)
        share = rows.where(F.col("fold").isin(list(folds))).select("text").coalesce(tasks)
        sums = share.mapInArrow(_gradient(model), "block int, sums binary")
        steps = sums.repartition("block").mapInArrow(_add_blocks, "block int, step binary").collect()
        for r in steps:  # as large as the model, whatever the input
            level, block = divmod(r["block"], BLOCKS)
            weights = (model.group, model.member)[level].reshape(BLOCKS, -1)
            weights[block] += np.frombuffer(r["step"], dtype=np.float32)
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            tokens, _, _ = _tokens(batch["text"].slice(at, 2_000))
            tokens.sort()
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
            yield _counts(tokens[first], np.diff(np.r_[first, len(tokens)]))


def _counts(words: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(times)], names=["word", "n"])


def word_counts(rows: DataFrame) -> DataFrame:
    """Written table of word and c over the training rows."""
    counted = rows.where("fold != 0").select("text").mapInArrow(_count, "word long, n long")
    return materialize(counted.groupBy("word").agg(F.sum("n").alias("c")), "counts")


def _classes(counts: DataFrame, frequent: list) -> Classes:
    own = np.array([r["word"] for r in frequent[:OWN]], dtype=np.int64).view(np.uint64)
    order = np.argsort(own, kind="stable")
    ranked, place = own[order], order

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, WIDTH * WIDTH), dtype=np.int64)
        for batch in batches:
            cls = class_of(batch["word"].to_numpy().view(np.uint64), ranked, place)
            totals[0] += np.bincount(cls, weights=batch["c"].to_numpy(), minlength=WIDTH * WIDTH).astype(np.int64)
            totals[1] += np.bincount(cls, minlength=WIDTH * WIDTH)
        some = np.flatnonzero(totals[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[0][some]), pa.array(totals[1][some])], names=["cls", "total", "kinds"])

    totals, kinds = np.zeros(WIDTH * WIDTH), np.zeros(WIDTH * WIDTH)
    found = counts.mapInArrow(classed, "cls long, total long, kinds long").groupBy("cls").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds"))
    for r in found.collect():
        totals[r["cls"]], kinds[r["cls"]] = r["total"], r["kinds"]
    return Classes(own, totals, kinds)


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, class_log double, word long, times long"


def _score(model: Model, words: np.ndarray, logs: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of documents (word null), then rows of their words outside the kept ones."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                tokens, owner, lengths = _tokens(batch["text"])
                features = _features(tokens, lengths)
                class_log = np.zeros(len(lengths))
                for at in range(0, len(tokens), SLICE):
                    part = slice(at, at + SLICE)
                    values = model.log10_class(tokens[part], [f[part] for f in features])
                    class_log += np.bincount(owner[part], weights=values, minlength=len(lengths))
                place = np.minimum(np.searchsorted(words, tokens), max(len(words) - 1, 0))
                kept = words[place] == tokens if len(words) else np.zeros(len(tokens), bool)
                known_log = np.bincount(owner[kept], weights=logs[place[kept]], minlength=len(lengths))
                n_known = np.bincount(owner[kept], minlength=len(lengths))
                rows, n = batch["row"].to_numpy(), batch.num_rows
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch["row"], batch["doc_id"], pa.array(batch["fold"].to_numpy() == 0), pa.array(lengths), pa.array(n_known),
                     pa.array(known_log), pa.array(class_log), none, none],
                    schema=_schema,
                )
                rare = np.stack([owner[~kept].astype(np.uint64), tokens[~kept]], axis=1)
                if len(rare):
                    order = np.lexsort((rare[:, 1], rare[:, 0]))
                    rare = rare[order]
                    first = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]).any(1)])
                    times = np.diff(np.r_[first, len(rare)])
                    m = len(first)
                    empty = [pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[rare[first, 0].astype(np.int64)]), *empty, pa.array(rare[first, 1].view(np.int64)), pa.array(times)], schema=_schema
                    )

    return score


_schema = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("known_log", pa.float64()),
        ("class_log", pa.float64()),
        ("word", pa.int64()),
        ("times", pa.int64()),
    ]
)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = rows_of(docs, id_col, fold=fold.cast("int"), text=text_of(docs, text_col))
    counts = word_counts(rows)
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = counts.orderBy(F.desc("c"), "word").limit(KEPT).collect()
    classes = _classes(counts, frequent)
    model = train(rows, classes, total)
    words = np.array([r["word"] for r in frequent], dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    logs = np.log10(np.array([r["c"] for r in frequent], dtype=np.float64) + SMOOTH)
    scored = materialize(
        rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_score(model, words[order], logs[order]), _SCORED), "scored"
    )
    rare = scored.where("word is not null").select("word", "row", "times").join(counts, "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("rare_log"),
    )
    log_total = float(np.log10(total + SMOOTH * (kinds + 1)))
    word_log = F.col("known_log") + F.coalesce("rare_log", F.lit(0.0))
    return scored.where("word is null").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (word_log - F.col("n_tokens") * log_total).alias("base_score"),
        (word_log + F.col("class_log")).alias("score"),
    )
