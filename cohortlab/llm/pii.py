"""Personal data by fixed forms and by bootstrapped contextual extraction, with DataFrame functions only.

Fixed forms (emails, IP addresses, card numbers, phone numbers) are the seeds.  Around every seed
and every identifier-like token (one with digits or an @) the words before and after it make lexical
patterns.  Tokens and patterns form a bipartite graph, and scores pass over it a fixed number of
times: a pattern is as good as the mean score of the distinct tokens it meets, smoothed by one
bad token; a token that is no seed is as good as a noisy-or of its patterns.  Tokens that a
pattern of high confidence meets, and that no fixed form covers, are further spans, of the
kind ``ctx_<kind>`` after the seeds that most of the pattern's tokens are.

A pattern that a third of all rows share is summed by partial aggregation; texts are not moved.
Expressions look at a text only if it has a digit, an @ or a +.  Repetitions are possessive, so
long runs neither backtrack nor exhaust the stack, and a form is tried only where a run begins.

Defined cases: a null text counts as empty and has no spans; rows are told apart by a hash of id
and text, so repeated rows get the same spans; null ids are allowed; an empty table gives an empty
result; other columns are ignored by ``find`` and passed through by ``mask``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import columns_of, drop_path, materialize, quoted, rows_of, scratch_path, text_of

KINDS = ("email", "ip", "card", "phone")
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![\p{L}0-9@._%+/-])[\p{L}._%+/-]*+[0-9@][\p{L}0-9@._%+/-]*+"
CONTEXT = 80  # characters looked at on either side
BLOCK = 256
ROUNDS = 3
MIN_CONFIDENCE = 0.8
MIN_SUPPORT = 5  # distinct seeds of a pattern

_SPAN = "array<struct<kind:string,start:int,stop:int>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _passes_luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -1 * i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        n = F.length(_digits(hit))
        return F.when(n.between(16, 19), _passes_luhn(_digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _matches(text: Column, form: str) -> Column:
    """(hit, start, stop, before, after) of the non-overlapping matches, from the parts between them."""
    parts, hits = F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), 0)
    none = F.array().cast("array<struct<hit:string,start:int,stop:int,before:string,after:string>>")
    sides = F.transform(
        parts,
        lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(CONTEXT)).alias("end"), F.left(p, F.lit(CONTEXT)).alias("begin")),
    )
    pairs = F.zip_with(
        F.transform(
            F.slice(sides, F.lit(1), F.size(hits)), lambda p: F.struct(p["n"].alias("n"), p["end"].alias("before"))
        ),
        F.zip_with(
            hits, F.slice(sides, F.lit(2), F.size(hits)), lambda h, p: F.struct(h.alias("hit"), p["begin"].alias("after"))
        ),
        lambda p, h: F.struct(p["n"].alias("n"), p["before"].alias("before"), h["hit"].alias("hit"), h["after"].alias("after")),
    )

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["n"]
        stop = begin + F.length(x["hit"])
        found = F.struct(
            x["hit"].alias("hit"), begin.alias("start"), stop.alias("stop"), x["before"].alias("before"), x["after"].alias("after")
        )
        return F.struct(stop.alias("at"), F.array_append(a["out"], found).alias("out"))

    def some(a: Column, block: Column) -> Column:
        """The next BLOCK matches; in blocks, since appending copies the array."""
        return F.aggregate(
            block,
            F.struct(a["at"].alias("at"), none.alias("out")),
            step,
            lambda b: F.struct(b["at"].alias("at"), F.concat(a["out"], b["out"]).alias("out")),
        )

    def positions(pairs: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(pairs) / BLOCK).cast("int")),
            lambda i: F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)),
        )
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), some, lambda a: a["out"])

    return F.get(F.transform(F.array(pairs), positions), F.lit(0))  # a list of one: pairs are made once


_GATES = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "ip": lambda text: text.rlike("[0-9]"),
    "card": lambda text: text.rlike("[0-9]"),
    "phone": lambda text: F.contains(text, F.lit("+")),
}


def base_spans(text: Column) -> Column:
    """Spans of the fixed forms, by kind as listed, then by start."""
    return F.concat(*(_spans_of(kind, text) for kind in KINDS))


def _spans_of(kind: str, text: Column) -> Column:
    matches = F.filter(_matches(text, FORMS[kind]), lambda m: _valid(kind, m["hit"]))
    spans = F.transform(
        matches, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"))
    )
    return F.when(_GATES[kind](text), spans).otherwise(F.array().cast(_SPAN))


def _candidates(text: Column, base: Column) -> Column:
    """Seeds, and identifier-like tokens outside them, with the patterns around them."""

    def words(side: Column) -> Column:
        return F.regexp_extract_all(F.lower(side), F.lit(r"\p{L}++"), 0)

    def patterns_of(sides: Column) -> Column:
        left = [F.coalesce(F.try_element_at(sides["before"], F.lit(i)), F.lit("")) for i in (-2, -1)]
        right = F.coalesce(F.try_element_at(sides["after"], F.lit(1)), F.lit(""))
        return F.array(F.concat_ws(" ", left[0], left[1]), F.concat_ws(" ", left[1], F.lit("_"), right))

    def described(m: Column, seed: Column) -> Column:
        sides = F.array(F.struct(words(m["before"]).alias("before"), words(m["after"]).alias("after")))
        return F.struct(
            m["hit"].alias("token"),
            m["start"].alias("start"),
            m["stop"].alias("stop"),
            F.get(F.transform(sides, patterns_of), F.lit(0)).alias("patterns"),
            seed.alias("seed"),
        )

    def free(m: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))

    def seeds(kind: str) -> Column:
        known = F.filter(_matches(text, FORMS[kind]), lambda m: _valid(kind, m["hit"]))
        return F.when(_GATES[kind](text), F.transform(known, lambda m: described(m, F.lit(kind)))).otherwise(none)

    none = F.array().cast("array<struct<token:string,start:int,stop:int,patterns:array<string>,seed:string>>")
    tokens = F.filter(
        _matches(text, CANDIDATE),
        lambda m: (F.length(m["hit"]) >= 4) & m["hit"].rlike("[0-9].*[0-9].*[0-9]|@") & free(m),
    )
    unknown = F.transform(tokens, lambda m: described(m, F.lit(None).cast("string")))
    return F.concat(unknown, *(seeds(kind) for kind in KINDS))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table of key, doc_id, base spans and candidates of every row."""
    text = text_of(docs, text_col)
    rows = rows_of(docs, id_col, w_text=text).withColumn("key", F.xxhash64("doc_id", "w_text"))
    rows = rows.withColumn("base", base_spans(F.col("w_text")))
    some = F.col("w_text").rlike("[0-9@]")
    rows = rows.withColumn("candidates", F.when(some, _candidates(F.col("w_text"), F.col("base")))).drop("w_text")
    path = scratch_path(docs.sparkSession, "personal")
    rows.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, confidence, support and kind of the patterns above the confidence asked for."""
    spark = found.sparkSession
    tokens = found.select(F.explode("candidates").alias("c")).select(
        F.lower("c.token").alias("token"), "c.seed", F.explode("c.patterns").alias("pattern")
    )
    # an edge for each distinct token of a pattern
    edges = tokens.where(F.col("pattern").rlike(r"^\S+ (_ )?\S+$")).groupBy("pattern", "token").agg(F.max("seed").alias("seed"))
    edge_path = scratch_path(spark, "edges")
    edges.write.parquet(edge_path)
    edges = spark.read.parquet(edge_path)
    scores, previous = None, None
    for _ in range(rounds):
        scored = edges.withColumn("score", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0))
        if scores is not None:
            scored = edges.join(scores, "token", "left").withColumn(
                "score", F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.coalesce("token_score", F.lit(0.0)))
            )
        judged = scored.groupBy("pattern").agg(
            (F.sum("score") / (F.count("*") + 1)).alias("confidence"),
            F.count("seed").alias("support"),
            F.mode("seed", deterministic=True).alias("kind"),
        )
        path = scratch_path(spark, "patterns")
        judged.where(F.col("support") >= MIN_SUPPORT).write.parquet(path)
        kept = spark.read.parquet(path)
        if previous:
            drop_path(spark, previous)
        previous = path
        miss = F.sum(F.log(1.0 - F.least(F.col("confidence"), F.lit(0.999999))))
        scores = edges.where("seed is null").join(kept, "pattern").groupBy("token").agg((1.0 - F.exp(miss)).alias("token_score"))
    return kept.where(F.col("confidence") >= MIN_CONFIDENCE)


def _discovered(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """Spans that accepted patterns add to a row (key, more); rows without any are left out."""
    tokens = found.select("key", F.explode("candidates").alias("c")).where("c.seed is null").distinct()
    met = tokens.select("key", "c.start", "c.stop", F.explode("c.patterns").alias("pattern")).join(
        accepted.select("pattern", "confidence", "kind"), "pattern"
    )
    best = met.groupBy("key", "start", "stop").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    span = F.struct(F.concat(F.lit("ctx_"), F.col("best.kind")).alias("kind"), "start", "stop")
    return best.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("more"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of the fixed forms, the digest of their spans, and all spans."""
    found = _found(docs, id_col, text_col)
    more = _discovered(found, patterns(found))
    none = F.array().cast(_SPAN)
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return (
        found.drop("candidates")
        .join(more, "key", "left")
        .select(
            "doc_id",
            *counts,
            F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
            _joined(F.concat(F.col("base"), F.coalesce("more", none))).alias("spans"),
        )
    )


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` (under ``row``) and the text with each span replaced by <kind>, overlapping spans by the first one's."""
    found = _found(docs, id_col, text_col)
    more = materialize(_discovered(found, patterns(found)), "more")  # its size tells Spark whether texts must move
    none = F.array().cast(_SPAN)
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), text_of(docs, text_col).alias("w_text"))
    rows = rows.withColumn("key", F.xxhash64(F.col(f"row.{quoted(id_col)}").cast("long"), "w_text")).join(more, "key", "left")
    spans = F.array_sort(
        F.concat(base_spans(F.col("w_text")), F.coalesce("more", none)),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["stop"] - a["stop"]),
    )

    def step(a: Column, s: Column) -> Column:
        between = F.substring(F.col("w_text"), a["at"] + 1, s["start"] - a["at"])
        put = F.struct(s["stop"].alias("at"), F.concat(a["out"], between, F.lit("<"), s["kind"], F.lit(">")).alias("out"))
        tail = F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["out"].alias("out"))  # of a span begun inside another
        return F.when(s["start"] >= a["at"], put).otherwise(tail)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda a: F.concat(a["out"], F.substring(F.col("w_text"), a["at"] + 1, F.length("w_text")))
    masked = F.when(F.size("w_spans") == 0, F.col("w_text")).otherwise(F.aggregate("w_spans", start, step, rest))
    return rows.withColumn("w_spans", spans).withColumn("masked_text", masked).select("row", "masked_text", F.col("w_spans").alias("spans"))
