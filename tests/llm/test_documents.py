"""Operators on documents against brute force over a small table with the awkward cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlab.llm import licenses, maxent_lm, near_dedup, packing, pii, quality, setsketch, sharding, textscan

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
PROSE = " ".join(f"Word{i % 97} of line {i}." for i in range(60))
ROWS = [
    (1, None),
    (None, ""),
    (2, "a b"),
    (3, "A  b"),
    (4, PROSE),
    (4, PROSE),
    (5, PROSE + " and a little more"),
    (6, PROSE.upper() + "\nHome | About | Contact | Shop\n" + PROSE),
    (7, "mail a.b@c-d.example.com, call +1 (234) 555-6789 or 4111 1111 1111 1111 at 10.0.0.255 and 300.1.1.1"),
    (8, "1" * 20_000 + " x@y " + "é" * 5_000),
    (9, " ".join(f"w{i % 5_000}" for i in range(30_000))),
    (10, "again again again " * 40),
    (11, "Licensed under the Apache License, Version 2.0.\n" + "more words here " * 3),
    (None, PROSE),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 0.5) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string, score double").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def _words(text):
    return WORD.findall(text or "")


def test_empty_tables(empty):
    for result in (
        quality.judge(empty),
        near_dedup.near_dedup(empty),
        pii.find(empty),
        sharding.shard_by_bytes(empty),
        packing.pack_documents(empty),
        licenses.scan(empty),
        maxent_lm.score_documents(empty),
    ):
        assert result.count() == 0


def test_word_hashes_follow_the_words(docs):
    import pyarrow as pa

    texts = [t for _, t in ROWS]
    data, offsets = textscan.text_bytes(pa.array(texts))
    hashes, at = textscan.word_hashes(data, offsets)
    name = {}
    for k, text in enumerate(texts):
        words = _words((text or "").translate(LOWER))
        own = hashes[at[k] : at[k + 1]].tolist()
        assert len(own) == len(words)
        assert all(name.setdefault(h, w) == w for h, w in zip(own, words, strict=True))
    assert len(set(name.values())) == len(name)


def test_sketches_merge_and_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        both = rng.integers(0, 1 << 63, 4_000, dtype=np.uint64)
        n = int(4_000 * (1 - share) / 2)
        a, b = np.unique(both[: 4_000 - n]), np.unique(both[n:])
        x, y = setsketch.sketch(a), setsketch.sketch(b)
        assert (setsketch.merge(x, y) == setsketch.sketch(np.union1d(a, b))).all()
        got = setsketch.estimate(*(np.array([v]) for v in ((x > y).sum(), (x < y).sum(), float(len(a)), float(len(b)))), len(x))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(got[0] - true) < 5 * math.sqrt(true * (1 - true) / len(x))


def _components(rows):
    sets = []
    for _, text in rows:
        w = _words((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) and rows[i][0] is not None and rows[j][0] is not None:
                up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows) if d is not None}


@pytest.mark.parametrize("chunk", [near_dedup.CHUNK, 6])
def test_near_copies_match_brute_force_also_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    monkeypatch.setattr(near_dedup, "BUCKET", 4 * chunk)
    base = [f"t{i}" for i in range(200)]
    rows = list(ROWS)
    for k in range(40):
        copy = list(base)
        for e in range(k % 5):
            copy[(k * 37 + e * 41) % 200] = f"edit{k}-{e}"
        rows.append((100 + k, " ".join(copy)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    expected = _components(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == expected


def test_quality_figures_and_verdicts(docs):
    judged = quality.clean(docs).collect()
    for r in judged:
        text = r.row.text or ""
        words = _words(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    by_id = {r.row.doc_id: r for r in judged}
    assert by_id[4].kept and by_id[4].clean_text == PROSE
    assert "Home |" not in by_id[6].clean_text
    assert not by_id[10].kept and not by_id[1].kept


def test_quality_keeps_clean_texts_with_phrases_and_marks(spark):
    prose = PROSE.replace(".", "")
    bullets = "\n".join(f"* buy{i} fresh{i} milk{i} now{i}\n## part{i} of{i} the{i} list{i}\n> quoted{i} line{i} number{i} {i}" for i in range(30))
    money = "\n".join(f"Sales{i} rose {i}% to ${i} billion{i}, item{i} #{i} costs{i} $.{i} or{i} 7 % of{i} $ {i}." for i in range(30))
    clean = [
        prose + " as our privacy policy and the terms of use say " + " ".join(f"v{i}" for i in range(90)),
        prose + "\nPlease read the privacy policy before you send the form to the office in town.",
        bullets,
        money,
    ]
    junk = ["All rights reserved.", "Privacy Policy and Terms of Use", "We use cookies. Click here to accept all cookies", "De%%% que&&& a*** 5%%% b###", "a * b # c & d"]
    rows = [(i, text) for i, text in enumerate(clean)] + [(10, prose + "\n" + "\n".join(junk))]
    got = {r.row.doc_id: r for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in enumerate(clean):
        assert got[i].kept and got[i].clean_text == text
    assert got[10].clean_text == prose and got[10].n_lines_removed == len(junk)


def test_personal_data_matches_the_plain_forms(docs):
    forms = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for r in pii.mask(docs).collect():
        text = r.row.text or ""
        for kind, form in forms.items():
            hits = [m for m in re.finditer(form, text)]
            if kind == "ip":
                hits = [m for m in hits if all(int(p) < 256 for p in m[0].split("."))]
            if kind == "phone":
                hits = [m for m in hits if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
            assert [(s.start, s.stop) for s in r.spans if s.kind == kind] == [m.span() for m in hits]
        if r.row.doc_id == 7:
            assert r.masked_text == "mail <email>, call <phone> or <card> at <ip> and 300.1.1.1"
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert found[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[7].n_card == 1


def test_contexts_discover_what_the_forms_miss(spark):
    rows = [(i, f"please ring number +44 20 7946 0{i:03d} today") for i in range(30)]
    rows += [(100, "please ring number 020-7946-0958 today"), (101, "they sold 1234 chairs")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "ctx_phone:19:32"
    assert got[101] == ""


def test_masks_cover_overlapping_spans(spark):
    docs = spark.createDataFrame([(1, "call +123 45678 90x@y.example.com now")], "doc_id long, text string")
    assert pii.mask(docs).first().masked_text == "call <phone> now"


def test_shards_are_level_and_gapless(docs):
    rows = sharding.shard_by_bytes(docs, shards=4).collect()
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 1 for _, t in ROWS)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    crcs = Counter(zlib.crc32((t or "").encode()) for _, t in ROWS)
    assert Counter(r.text_crc32 for r in rows) == crcs


def test_many_records_make_level_shards(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 50)) for i in range(6_000)]
    placed = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    sizes = Counter()
    for r in placed:
        sizes[r.shard] += r.size
    assert len(placed) == len(rows) and len(sizes) == 16
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in placed)


def test_range_statistics_belong_to_the_last_bounds(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROUNDS", 1)
    monkeypatch.setattr(sharding, "OVERFULL", 1.0)
    table = sharding.records(spark.createDataFrame([(i, f"text {i} " * (i % 50)) for i in range(3_000)], "doc_id long, text string"))
    total = table.agg({"size": "sum"}).first()[0]
    parted, stats = sharding.ranged(table, total, 8)
    sums = defaultdict(lambda: [0, 0])
    for r in parted.collect():
        sums[r.part][0] += 1
        sums[r.part][1] += r.size
    assert {r["part"]: [r["rows"], r["bytes"]] for r in stats} == sums


def test_pieces_hold_every_id_once(docs):
    tokenizer = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    lengths = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    rows = packing.pack_documents(docs).collect()
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == lengths
    assert sum(r.length for r in rows) == sum(lengths)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.MAX_LENGTH
    by_id = {r.doc_id: r for r in rows if r.start == 0 and r.doc_id == 2}
    ids = tokenizer.encode("a b", add_special_tokens=False).ids + [0]
    assert by_id[2].ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


@pytest.mark.parametrize("text", ["", "  a", "a  b ", "a \nb\t\tc", "it's 日本 é\x85x", "x <|endoftext|> y", "a\x1c b 　c"])
def test_remembered_stretches_give_the_tokenizers_ids(text):
    encode = packing.encoder()
    plain = encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert encode.ids(text) == b"".join(i.to_bytes(4, "little") for i in plain)


def test_patterns_hold_the_histogram():
    histogram = {1024: 3, 900: 2, 500: 7, 130: 1, 124: 9, 3: 50}
    patterns = packing.shortest_pack_first(histogram)
    held = Counter()
    for count, lengths in patterns:
        assert sum(lengths) <= 1024
        for length in lengths:
            held[length] += count
    assert held == histogram


def test_notices_are_found_wherever_they_stand(spark):
    rows = []
    for k, notice in enumerate(licenses.TEMPLATES.values()):
        for j in range(4):
            before = " ".join(f"v{(i * 7 + k) % 83}" for i in range(29 + 13 * j))
            rows.append((k * 10 + j, f"{before} {notice} and then other words follow it"))
    rows += [(900, None), (None, ""), (901, "released under"), (902, " ".join(list(licenses.TEMPLATES.values())[8].split()[:20]))]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(k * 10 + j, name) for k, name in enumerate(licenses.TEMPLATES) for j in range(4)}


def test_common_licenses_are_told_apart(spark):
    free = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    texts = {
        "GPL notice": free.format(":", "General", ",", "3"),
        "GPL-2.0 notice": free.format(";", "General", ";", "2"),
        "LGPL-3.0 notice": free.format(":", "Lesser General", ",", "3"),
        "AGPL-3.0 notice": free.format(":", "Affero General", ",", "3"),
        "BSD-3-Clause": "Neither the name of Example Corp. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "ISC": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Unlicense": "This is free and unencumbered software released into the public domain.",
        "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
        "CC-BY-NC-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    }
    rows = [(i, f"{PROSE} {text} {PROSE}") for i, text in enumerate(texts.values())]
    rows.append((100, f"{texts['GPL notice']} {texts['LGPL-3.0 notice']}"))
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, name) for i, name in enumerate(texts)} | {(100, "GPL notice"), (100, "LGPL-3.0 notice")}


def test_base_scores_are_exact_and_the_model_predicts_held_out_text(spark, small, monkeypatch):
    monkeypatch.setattr(maxent_lm, "KEPT", 300)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: _words((r.text or "").translate(LOWER)) + [None] for r in docs.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    counts = Counter(w for d, ws in texts.items() if not held[d] for w in ws)
    total = sum(counts.values())
    scale = math.log10(total + 0.1 * (len(counts) + 1))
    base = score = 0.0
    for r in maxent_lm.score_documents(docs).collect():
        words = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), total)
        assert r.n_known == sum(w in counts for w in words)
        assert r.base_score == pytest.approx(sum(math.log10(counts[w] + 0.1) - scale for w in words))
        if r.held_out:
            base, score = base + r.base_score, score + r.score
    assert score > base


def test_pipeline_keeps_clean_documents_and_their_columns(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {4, 5, 6}
    single = stages["exact dedup"](spark, kept, "")
    assert single.columns == docs.columns
    texts = [(r.text or "").translate(LOWER) for r in single.collect()]
    assert len(texts) == len(set(texts)) == len({(r.text or "").translate(LOWER) for r in kept.collect()})
    near = stages["near dedup"](spark, single, "")
    masked = stages["personal data"](spark, near, "")
    assert masked.columns == docs.columns and masked.count() == near.count()
    packed = stages["packing"](spark, masked, "")
    assert packed.select("doc_id").distinct().count() == masked.count()


def test_stages_keep_odd_and_clashing_columns(spark, docs):
    """Names with dots and backticks, and names that the operators use themselves."""
    odd = {"a.b": 1, "c`d": 2, "row": 3, "kept": 4, "digest": 5, "key": 6, "stays0": 7, "content": 8, "node": 9, "w_text": 10}
    wide = docs.withColumns({k: F.lit(v) for k, v in odd.items()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide = stage(spark, wide, "")
        assert wide.columns == [*docs.columns, *odd], name
        rows = wide.collect()
        assert rows and all(tuple(r)[len(docs.columns) :] == tuple(odd.values()) for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, "").select("doc_id").distinct().count() == len(rows)
