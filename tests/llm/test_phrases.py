"""Collocations against a brute-force count."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohortlab.llm import phrases

SCHEMA = "doc_id long, text string, lang string, salt string, words int"


def counted(rows, longest):
    """Occurrences by (lang, phrase), and words by language."""
    found, totals = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    found[lang or "und", " ".join(words[i : i + n])] += 1
    return found, totals


def brute(rows, least=10, top=2000, longest=3):
    found, totals = counted(rows, longest)
    candidates = {k: a for k, a in found.items() if a >= least and " " in k[1]}
    covered = Counter()
    for (lang, phrase), a in candidates.items():
        words = phrase.split(" ")
        inner = {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 2, len(words) + 1)} - {phrase}
        for part in inner:
            covered[lang, part] = max(covered[lang, part], a)
    out = []
    for (lang, phrase), a in candidates.items():
        words = phrase.split(" ")
        cuts = []
        for k in range(1, len(words)):
            l, r = found[lang, " ".join(words[:k])], found[lang, " ".join(words[k:])]  # noqa: E741
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)  # noqa: E741
        if 100 * covered[lang, phrase] < 50 * a:
            out.append((lang, phrase, a, l, r, totals[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    ranked = []
    for row in out:
        ranks[row[0]] += 1
        if ranks[row[0]] <= top:
            ranked.append((row[0], ranks[row[0]], *row[1:]))
    return ranked


def made(n, seed):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "a", "straße", "日本", "x1", "É", "of"]
    rows = []
    for i in range(n):
        tokens = [rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\x0b", " "]) for _ in range(rng.randrange(40))]
        rows.append((i, "".join(tokens), rng.choice(["en", "de", None, "und"]), "s", 1))
    return rows


def result(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("bits", [64, 5])
def test_equals_brute_force_also_when_fingerprints_collide(spark, bits):
    rows = made(300, 3) + [(9, None, "en", "s", 1), (9, "", None, "s", 1), (9, " .;", "en", "s", 1), (None, "new york " * 30, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = result(phrases.collocations(docs, bits=bits))
    assert got == sorted(brute([(r[2], r[1]) for r in rows]))
    assert len(got) > 50


def test_longer_phrases_and_short_reports(spark):
    rows = made(300, 4)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = result(phrases.collocations(docs, top=7, max_words=4, min_count=5))
    assert got == sorted(brute([(r[2], r[1]) for r in rows], least=5, top=7, longest=4))


def test_long_text_long_word_and_no_rows(spark):
    text = ("alpha beta gamma " * 50 + "; ") * 1500 + "w" * 300_000
    docs = spark.createDataFrame([(1, text, "en", "s", 1)], SCHEMA)
    got = result(phrases.collocations(docs))
    assert got == sorted(brute([("en", text)]))
    assert phrases.collocations(docs.limit(0)).collect() == []
    assert phrases.collocations(docs.where("false").unionByName(spark.createDataFrame([(1, None, None, "s", 1)], SCHEMA))).collect() == []


@pytest.mark.parametrize("size,words", [(7, 4), (64, 23), (1 << 20, 10**6)])
def test_slices_and_flushes_lose_nothing(monkeypatch, size, words):
    """Counts of one task are those of the texts wherever slices and flushes end."""
    monkeypatch.setattr(phrases, "SLICE_BYTES", size)
    monkeypatch.setattr(phrases, "FLUSH_WORDS", words)
    rows = [(r[2] or "und", r[1]) for r in made(60, 5)] + [("en", ""), ("de", "x y z " * 80)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(rows))), pa.array([r[0] for r in rows]), pa.array([r[1].encode() for r in rows])], names=["row", "lang", "text"]
    )
    blobs = pa.Table.from_batches(phrases._count_task((1, 2, 3), 1, 64, None)(iter([batch])))
    found, _ = counted(rows, 3)
    texts = [r[1].encode() for r in rows]
    for n in (1, 2, 3):
        got = Counter()
        part = phrases._sum_task(1)(blobs.filter(pa.compute.equal(blobs["n"], n)))
        for row, place, count in zip(*(part[c].to_pylist() for c in ("row", "place", "count")), strict=True):
            every = phrases.Words(np.frombuffer(texts[row], np.uint8), np.array([0, len(texts[row])]))
            data = every.buffer.tobytes()
            words_at = zip(every.starts[place : place + n], every.stops[place : place + n], strict=True)
            got[rows[row][0], b" ".join(data[a:b] for a, b in words_at).decode()] += count
        assert got == {k: v for k, v in found.items() if k[1].count(" ") == n - 1}
