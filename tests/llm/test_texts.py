"""Packing, mixing, suffix arrays, chunks, licenses, neighbours and the pipeline."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from muster.llm import chunks, licenses, mixing, neighbours, packing, queries, suffixes

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (None, "x y"), (3, "same text"), (3, "same text"), (4, "a b\r\n\tc d  "), (5, "long " * 9000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns(
        {"source": F.lit(None).cast("string"), "size": F.lit("clash"), "n": F.lit("clash"), "kept": F.lit(1)}
    )


def test_pieces_are_the_tokenizer_s(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.pack(spark, docs, shard_docs=60).toPandas()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    ids = {r.doc_id: [*coder.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect()}
    at = dict.fromkeys(ids, 0)
    for p in pieces.sort_values(["doc_id", "start"]).itertuples():
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids[p.doc_id]) and len(part) == p.length
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        at[p.doc_id] += p.length
    assert at == {i: len(x) for i, x in ids.items()}
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]]
        total = s.length.sum()
        assert total == 1024 or total & (total - 1) == 0


def test_encoder_at_odd_white_space():
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    texts = ["", " ", "\n\n b", "a  b\t\tc\n", "a \n b ", "it's  'tis", "<|endoftext|> é日本\x00\x1c x", "a　 　b", "\r\n\r\n"]
    encoder = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert [x.tolist() for x in encoder.encode(texts)] == [coder.encode(t, add_special_tokens=False).ids for t in texts]


def test_seed_gets_its_neighbour():
    rng = np.random.default_rng(0)
    tails = [rng.integers(100 * i, 100 * i + 90, 400).astype(np.uint16) for i in (1, 2, 3, 1, 2, 3)]
    made = packing.pack_shard(tails)
    first = {tuple(sorted({i for i, _, _ in s})) for s in made if sum(n for _, _, n in s) == 1024}
    assert any(set(pair) <= set(s) for s in first for pair in ((0, 3), (1, 4), (2, 5)))
    used = sorted((i, a + k) for s in made for i, a, n in s for k in range(n))
    assert used == [(i, k) for i in range(6) for k in range(400)]


def test_odd_rows_pack(spark, odd):
    pieces = packing.pack(spark, odd).toPandas()
    assert sorted(pieces[pieces.start == 0].doc_id.fillna(0)) == [0, 1, 2, 3, 3, 4, 5]
    assert packing.pack(spark, odd.limit(0)).count() == 0


def test_mix_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), s) for i in range(400) for s in [("a", "b", "c", None)[min(i % 10, 3)]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(spark, docs)
    sums = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("s"))
    sums = {r.source: r for r in sums.collect()}
    # By hand: weights 5, 2, 1, 5; repeat the rule until no source is above twice its size.
    size = {s: r.s for s, r in sums.items()}
    weight, left, target = {"a": 5, "b": 2, "c": 1, None: 5}, 1.5 * sum(size.values()), {}
    while True:
        free = {s: left * w / sum(weight[x] for x in size if x not in target) for s, w in weight.items() if s not in target}
        over = [s for s, t in free.items() if t > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
    target |= free
    assert {s: r.g for s, r in sums.items()} == pytest.approx(target)
    assert all(abs(r.t - r.g) <= 1 for r in sums.values())
    read = mixing.read_mix(docs, mixed)
    words = read.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("t"))
    assert {r.source: r.t for r in words.collect()} == {s: r.t for s, r in sums.items()}


def test_odd_rows_mix(spark, odd):
    rows = mixing.mix(spark, odd).collect()
    assert sum(r.n for r in rows) == len(ODD) and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(spark, odd.limit(0)).count() == 0


def plain_removal(texts, length=200):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("shard", [suffixes.SHARD, 4])
def test_suffix_arrays_against_all_strings(spark, monkeypatch, shard):
    monkeypatch.setattr(suffixes, "SHARD", shard)
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    shared, line = text(900), text(210)
    texts = [text(300) + shared[a : a + 260 + 10 * a % 300] + text(100) for a in range(0, 500, 31)]
    texts += [text(20) + line + text(30) for _ in range(12)]
    texts += ["ab" * 400, "a" * 700, text(199), "", None, texts[0], text(150) + "z" * 240 + text(9), shared]
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = suffixes.remove_repeats(spark, docs).collect()
    key = lambda r: (r[0] or -1, *r[1:])
    want = [(i if i % 9 else None, *x) for i, x in enumerate(plain_removal(texts))]
    assert sorted(map(key, [tuple(r) for r in got]), key=repr) == sorted(map(key, want), key=repr)


def test_suffix_arrays_empty(spark, odd):
    assert suffixes.remove_repeats(spark, odd.limit(0)).count() == 0
    rows = suffixes.remove_repeats(spark, odd).collect()
    assert len(rows) == len(ODD)
    assert [r.n_removed for r in rows if r.doc_id == 5] == [45000]


def test_chunks_resist_shifts():
    rng = np.random.default_rng(7)
    body = bytes(rng.integers(97, 123, 5000, np.uint8))
    cut = lambda t: {t[a:b] for e in chunks.cut_batch([t]) for a, b in zip([0, *e], e, strict=False)}
    one, other = cut(body), cut(body[:1000] + b"inserted" + body[1000:])
    assert len(one & other) > 0.9 * len(one)
    assert b"".join(body[a:b] for e in chunks.cut_batch([body]) for a, b in zip([0, *e], e, strict=False)) == body
    assert all(len(c) <= chunks.MOST for c in one)
    assert chunks.cut_batch([b"x" * 3, body])[1] == chunks.cut_batch([body])[0]


def test_chunk_dedup(spark, odd):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(n))
    passage = text(60)
    docs = [(10 + i, f"{text(80)} {passage} {text(80)}") for i in range(6)] + [(30 + i, text(150)) for i in range(6)]
    got = {r.doc_id: r for r in chunks.deduplicate(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[10 + i].n_repeated > 100 for i in range(6)) and all(got[30 + i].n_repeated == 0 for i in range(6))
    assert got[10].n_removed == 0 and all(got[10 + i].n_removed > 100 for i in range(1, 6))
    for i, t in docs:
        assert got[i].n_bytes == len(t) == got[i].n_removed + len(got[i].kept)
    rows = chunks.deduplicate(spark, odd).collect()
    assert len(rows) == len(ODD) and chunks.deduplicate(spark, odd.limit(0)).count() == 0


def plain_chunk_removal(docs):
    """(n_repeated, kept) by doc_id, chunk by chunk in order of doc_id."""
    raw = {i: t.encode() for i, t in sorted(docs)}
    parts = {i: [t[a:b] for e in chunks.cut_batch([t]) for a, b in zip([0, *e], e, strict=False)] for i, t in raw.items()}
    every = [c for p in parts.values() for c in p]
    seen, out = set(), {}
    for i, part in parts.items():
        kept = []
        for c in part:
            if c not in seen:
                kept.append(c)
            seen.add(c)
        out[i] = (sum(len(c) for c in part if every.count(c) > 1), b"".join(kept))
    return out


def test_every_repeated_chunk_goes(spark):
    rng = np.random.default_rng(10)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(n))
    short, line, passage = text(8), text(16), text(30)
    docs = [(1, short), (2, short), (3, "tiny"), (4, "tiny"), (5, line + text(40)), (6, line + text(40))]
    docs += [(10 + i, f"{text(20)} {passage} {text(20)} {passage}") for i in range(4)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_repeated, bytes(r.kept)) for r in chunks.deduplicate(spark, frame).collect()}
    assert got == plain_chunk_removal(docs)
    assert got[2] == (len(short), b"") and got[4] == (4, b"")


def test_license_notices(spark, odd):
    text = "lorem ipsum. Licensed under the Apache License, Version 2.0.\nmore words\n" + licenses.TEMPLATES["MIT"]
    near = licenses.TEMPLATES["MIT"].replace("free of charge", "at no charge") + " All rights reserved."
    docs = [(1, text), (2, near), (3, "the license of the artist"), (4, None), (5, ""), (1, text)]
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = sorted((r.doc_id, r.license, r.missing, r.added) for r in rows)
    assert found == [
        *[(1, "Apache-2.0 notice", 0, 0)] * 2,
        *[(1, "MIT", 0, 0)] * 2,
        (2, "All rights reserved", 0, 0),
        (2, "MIT", 2, 2),
    ]
    notice = next(r for r in rows if r.license == "Apache-2.0 notice")
    assert text[notice.start : notice.start + notice.length] == "Licensed under the Apache License, Version 2.0"
    assert licenses.scan(odd).count() == 0


def test_what_a_template_saves_decides(monkeypatch):
    """Two templates differ by less than either may: the one that saves more is confirmed."""
    known = licenses.templates(licenses.TEMPLATES)
    named = {t.name: t for t in known}
    for mine, other in (("GPL-3.0 header", "GPL-2.0 header"), ("AGPL-3.0 header", "LGPL-3.0 header"), ("BSD-3-Clause", "BSD-3-Clause")):
        text = "some words before it " + licenses.TEMPLATES[mine] + " and some after it"
        words = licenses._WORD.findall(text.lower())
        _, _, missing, added = licenses.differences(named[other].words, words)
        assert missing + added <= 0.1 * len(named[other].words)
        assert [x[0] for x in licenses.find_licenses(text, known)] == [mine]
    # Without compression the order of the templates would decide.
    monkeypatch.setattr(licenses, "saved", lambda block, known: [0] * len(known))
    wrong = [licenses.find_licenses(licenses.TEMPLATES[n], known)[0][0] == n for n in ("GPL-2.0 header", "AGPL-3.0 header", "GPL-3.0 header", "LGPL-3.0 header")]
    assert not all(wrong)


def plain_inexact(words, known, different=0.1):
    """Whether any run of words, of whatever length, has a template's wording but for a tenth."""
    out = set()
    for t in known:
        n, most = len(t.words), int(different * len(t.words))
        for a in range(len(words)):
            for m in range(max(1, n - most), n + most + 1):
                begin, end, missing, added = licenses.differences(t.words, words[a : a + m])
                if end > begin and missing + added <= most:
                    out.add(t.name)
    return out


def test_inexact_notices(spark):
    """Words dropped, changed or added at random, against a look at every run of words."""
    rng = np.random.default_rng(5)
    short = {n: licenses.TEMPLATES[n] for n in ("Unlicense", "GPL-3.0 notice", "MIT notice", "CC0-1.0 notice")}
    known, hits = licenses.templates(short), 0
    for _ in range(60):
        words = licenses._WORD.findall(list(short.values())[rng.integers(len(short))].lower())
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(len(words)))
            words[at : at + int(rng.integers(2))] = ["other"] * int(rng.integers(2))
        words = ["before", "it", *words, "after"]
        got = {x[0] for x in licenses.find_licenses(" ".join(words), known)}
        assert got == plain_inexact(words, known)
        hits += bool(got)
    assert 20 < hits < 60
    text = "This is free and software released into the public domain."
    rows = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.license, r.missing) for r in rows] == [("Unlicense", 1)]


def plain_notices(words, known):
    """All places where a template's words stand, the longest template first, none twice."""
    out, taken = [], set()
    for t in sorted(known, key=lambda t: -len(t.words)):
        n = len(t.words)
        for a in range(len(words) - n + 1):
            if words[a : a + n] == t.words and not taken & set(range(a, a + n)):
                taken |= set(range(a, a + n))
                out.append((t.name, a))
    return sorted(out, key=lambda x: x[1])


def test_notices_among_many():
    rng = np.random.default_rng(9)
    known = licenses.templates(licenses.TEMPLATES)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 5))
    names = list(licenses.TEMPLATES)
    for gap in (0, 1, 20, 60, 120):
        words = []
        while len(words) < 3000:
            name = names[rng.integers(len(names))]
            words += [word() if i % 40 else "license" for i in range(1, gap + 1)]
            words += licenses._WORD.findall(licenses.TEMPLATES[name].lower())
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        got = [(x[0], int(np.searchsorted(starts, x[2]))) for x in licenses.find_licenses(" ".join(words), known) if not x[4] + x[5]]
        assert got == plain_notices(words, known)
    copies = " ".join([licenses.TEMPLATES["MIT"]] * 40)
    assert [x[0] for x in licenses.find_licenses(copies, known)] == ["MIT"] * 40


def test_neighbours_against_all(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.toPandas()
    x, ids = np.array([np.asarray(v, float) for v in rows.embedding]), rows.vec_id.to_numpy()
    got = queries.QUERIES["op3_cross_polytope"](spark, "/root/testdata/sf0.01").toPandas()
    place, hits = {v: i for i, v in enumerate(ids)}, 0
    asked = ids[ids % 20 == 0]
    for q, g in got.groupby("query_id"):
        score = np.where(ids == q, -np.inf, x @ x[place[q]])
        best = ids[np.lexsort((ids, -score))[:20]]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and list(np.lexsort((g.vec_id, -g.score))) == list(range(20))
        assert g.score.to_numpy() == pytest.approx([score[place[v]] for v in g.vec_id], abs=1e-12)
        hits += len(set(best) & set(g.vec_id))
    assert set(got.query_id) == set(asked) and hits / (20 * len(asked)) >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("inf"), 1.0]), (6, [100.0, 1.0]), (None, [1.0, 1.0]), (7, [None, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.search(spark, frame).collect()}
    assert [got[0, i] for i in range(1, 5)] == [(6, 100.0), (20, 2.0), (1, 1.0), (2, 1.0)]
    assert (0, 5) not in got and got[20, 1] == (6, 200.0)
    assert neighbours.search(spark, frame.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "d", "spread"), [(15, 64, 0), (100, 64, 0), (1500, 64, 1), (1500, 256, 0)])
def test_neighbours_of_any_table(spark, n, d, spread):
    rng = np.random.default_rng(n + d)
    x = rng.normal(size=(n, d))
    x *= rng.lognormal(0, spread, (n, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(spark, frame).toPandas().groupby("query_id").vec_id.apply(set)
    hits = want = 0
    for q in range(0, n, 20):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(np.argsort(-score)[: min(20, n - 1)].tolist())
        assert len(got[q]) == len(best)
        hits, want = hits + len(best & got[q]), want + len(best)
    assert hits >= 0.95 * want


def test_neighbours_in_blocks_and_parts(spark, monkeypatch):
    """Blocks of rows and parts of queries change nothing."""
    x = np.random.default_rng(2).normal(size=(300, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, neighbours.search(spark, frame, k=5, every=10).collect()))
    assert len(want) == 150
    monkeypatch.setattr(neighbours, "ASKED", 4)
    assert sorted(map(tuple, neighbours.search(spark, frame, k=5, every=10).collect())) == want


def test_neighbours_measure_their_probes(spark, monkeypatch):
    """With few rows to a block, probes are measured and short queries scan."""
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(40, 256)), 25, 0) + 0.1 * rng.normal(size=(1000, 256))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(spark, frame, n_probes=1).toPandas().groupby("query_id").vec_id.apply(set)
    best = {q: set(np.argsort(-np.where(np.arange(1000) == q, -np.inf, x @ x[q]))[:20].tolist()) for q in range(0, 1000, 20)}
    assert all(len(got[q]) == 20 for q in best)
    assert sum(len(got[q] & best[q]) for q in best) >= 0.95 * 20 * len(best)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    kept = stages["simhash_near_dedup"](spark, clean, SF)
    assert clean.columns == kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(ids) == kept.count() and 0.8 * docs.count() < len(ids) < docs.count()
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} <= ids


def test_rows_without_ids_whose_text_hashes_clash(spark):
    """Texts of one 32-bit hash and no doc_id are rows of their own."""
    text = "array_join(transform(sequence(0, 10 + id % 7), i -> md5(concat(id, '-', i))), ' ')"
    clashes = spark.range(200_000).selectExpr(f"{text} as text").groupBy(F.hash("text")).agg(F.collect_list("text").alias("texts"))
    found = clashes.where("size(array_distinct(transform(texts, t -> length(t)))) > 1").select("texts").first()
    a, b = found.texts[:2]
    assert len(a) != len(b)
    docs = spark.createDataFrame([(None, a), (None, b), (1, b)], "doc_id long, text string")
    rows = {(r.doc_id, r.n_bytes): (r.n_removed, bytes(r.kept)) for r in suffixes.remove_repeats(spark, docs).collect()}
    assert rows == {(None, len(a)): (0, a.encode()), (None, len(b)): (len(b), b""), (1, len(b)): (len(b), b"")}
    rows = {(r.doc_id, r.n_bytes): (r.n_repeated, bytes(r.kept)) for r in chunks.deduplicate(spark, docs).collect()}
    assert rows == {(None, len(a)): (0, a.encode()), (None, len(b)): (len(b), b""), (1, len(b)): (len(b), b.encode())}
