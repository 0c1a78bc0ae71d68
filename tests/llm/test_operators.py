"""Corpus operators against brute force, and on odd tables."""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tracefold.llm")

from pyspark.sql import functions as F  # noqa: E402

from tracefold.llm import bpe, chat, components, decontaminate, hmm, license_scan, near_dup, packing, quality, token_files, toxicity, transducers, words, wrapper  # noqa: E402
from tracefold.session import ship  # noqa: E402

EXTRA = "class string, row string, g string, score string, kept string, labels string, bands string, a string, b string, key string, held_out string, leaked_doc_id string, dropped_doc_id string, norm string"
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again"),
    (1, "the quick brown fox jumps over the lazy dog again"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (None, "a text without an id " * 20),
    (None, "words of a row without an id that near copies " + " ".join(map(str, range(40)))),
    (9, "words of a row without an id that near copies " + " ".join(map(str, range(41)))),
    (5, "one two"),
    (6, "The Quick brown fox jumps over the lazy dog again"),
    (7, "very long text " * 30_000),
    (8, "É ß \x1c tabs\tand  spaces <|endoftext|> \n\n end "),
    (2, "the same id with another text for the second row"),
]


@pytest.fixture(scope="session")
def odd(spark):
    ship(spark)
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({x.split()[0]: F.lit("x") for x in EXTRA.split(", ")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labelled(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


def vocabulary():
    rng = random.Random(4)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(spark):
    """(rows, frame): near copies in chains, exact copies, and passages that many texts share."""
    ship(spark)
    rng, vocab, rows = random.Random(5), vocabulary(), []
    shared = " ".join(rng.choice(vocab) for _ in range(40))
    for _ in range(30):
        base = [rng.choice(vocab) for _ in range(rng.randint(4, 120))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            rows.append(" ".join(base))
            if rng.random() < 0.8:
                base = list(base)
                base[rng.randrange(len(base))] = rng.choice(vocab)
        rows.append(shared + " " + " ".join(rng.choice(vocab) for _ in range(30)))
    data = [(i, t) for i, t in enumerate(rows)]
    return data, spark.createDataFrame(data, "doc_id long, text string").repartition(5)


def ascii_words(text):
    return (text or "").encode().lower().split()


def shingles(text, width=5):
    w = ascii_words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


# --- words and tokens ---------------------------------------------------------


def test_word_hashes_tell_words(odd):
    import pyarrow as pa

    texts = [t for _, t in ODD]
    seen: dict = {}
    got = []
    for _, _, raw, offsets in words.text_blocks(pa.array(texts, pa.string()), 100):
        h, first = words.word_hashes(raw, offsets)
        got += [h[a:b].tolist() for a, b in zip(first, first[1:])]
    for text, hashes in zip(texts, got, strict=True):
        own = ascii_words(text)
        assert len(own) == len(hashes)
        for w, x in zip(own, hashes):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_chunked_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    rng, fresh = random.Random(1), Tokenizer.from_file(path)
    texts = [t or "" for _, t in ODD if len(t or "") < 1000]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\nplain words", "a <|endoftext| > b", "a\xa0b", "don't", "a\n", " a ", "\n\n", " "]
    for letters in ("ab é\n.,'s 1!", "ab é\n.,'s 1!\t\r\x0c\x1cßĂ中\xa0"):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    whole = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    for enc in (bpe.ChunkEncoder(path), bpe.ChunkEncoder(path, remembered=40, stretch=300)):
        for _ in range(2):  # the second time from what is remembered
            assert [np.frombuffer(x, dtype="<u4").tolist() for x in enc.encode(texts)] == whole
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in enc.encode([None, *texts], 7)] == [[7], *([*x, 7] for x in whole)]
    assert np.frombuffer(enc.encode(["a <|endoftext|> b"])[0], dtype="<u4").tolist() == [64, 220, 50256, 275]


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 25, 32])
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, size=n, dtype=np.uint64)
        raw = token_files.pack_bits(ids, bits)
        assert len(raw) == -(-n * bits // 8)
        assert token_files.unpack_bits(raw, n, bits).tolist() == ids.tolist()


def test_shard_random_access():
    import io

    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50257, size=n, dtype=np.uint32) for n in (0, 5, 9000, 1, 4096, 3)]
    for bits in (16, 17):
        raw = token_files.shard_bytes([3, None, 5, 6, 7, 8], np.concatenate(docs).astype("<u4"), np.array([len(d) for d in docs]), bits, block_ids=100)
        shard = token_files.ShardReader(io.BytesIO(raw))
        assert shard.doc_ids == [3, None, 5, 6, 7, 8]
        for k, d in enumerate(docs):
            assert shard.document(k).tolist() == d.tolist()
        assert shard.ids(4000, 4007).tolist() == np.concatenate(docs)[4000:4007].tolist()
    assert token_files.id_bits(50257) == 16 and token_files.id_bits(65537) == 17 and token_files.id_bits(2) == 1


def test_token_files(spark, odd, none, tmp_path):
    manifest = token_files.write_token_files(odd.repartition(3), f"file://{tmp_path}/t", shard_ids=50)
    manifest.write.parquet(f"{tmp_path}/m")
    got = token_files.read_token_files(spark.read.parquet(f"{tmp_path}/m")).collect()
    enc = bpe.encoder(bpe.default_vocabulary())
    rows = {}
    for doc_id, text in ODD:
        ids = enc._ids(text or "").tobytes() + b"\0\0\0\0"
        rows.setdefault(doc_id, []).append((len(ids) // 4, zlib.crc32(ids)))
    assert len(got) == len(ODD)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, *x) for i, v in rows.items() for x in v)
    at = 0
    order = sorted(got, key=lambda r: r.start)
    for r in order:
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in order if r.doc_id is not None]
    assert known == sorted(known) and order[0].doc_id is None
    empty = token_files.write_token_files(none, f"file://{tmp_path}/e")
    empty.write.parquet(f"{tmp_path}/me")
    assert token_files.read_token_files(spark.read.parquet(f"{tmp_path}/me")).count() == 0


def test_best_fit_by_hand():
    fit = packing.BestFit(10, open_bins=2)
    assert [fit.place(n) for n in (7, 6, 3, 4)] == [(0, 0), (1, 0), (0, 7), (1, 6)]
    fit = packing.BestFit(10, open_bins=1)
    assert [fit.place(n) for n in (4, 7, 6, 3)] == [(0, 0), (1, 0), (0, 4), (2, 0)]  # bin 1, the fullest, closed


def test_packing(odd, none):
    got = packing.pack_documents(odd, with_ids=True).collect()
    enc = bpe.encoder(bpe.default_vocabulary())
    want = Counter()
    for doc_id, text in ODD:
        ids = enc._ids(text or "").tolist() + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, a, b - a, np.array(ids[a:b], dtype="<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == want
    by = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids)
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(none).count() == 0


def test_packing_fills_the_sequences(spark, corpus):
    """Open bins of many partitions are packed into each other."""
    _, df = corpus
    got = packing.pack_documents(df.repartition(40), capacity=256).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= 1.1 * -(-sum(r.length for r in got) // 256)


# --- chat ---------------------------------------------------------------------


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi <turn> \\ </turn> <turn/>"),
        (1, 1, "user", None),
        (1, 2, "assistant", "\\<\\turn <\\/turn> é"),
        (1, 2, "assistant", "\\<\\turn <\\/turn> é"),
        (1, 3, "assis\ntant<\\nl", "x"),
        (2, 0, None, "y"),
        (None, None, "assistant", "\\"),
        (-7, 0, "user", r"\### Assistant: </turn> ok"),
        (-7, 1, "assistant", r"\### Assistant: </turn> ok"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).withColumn("turns", F.lit(2)).repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert set(got) == {1, 2, None, -7}
    for c, r in got.items():
        own = sorted([x for x in rows if x[0] == c], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss_text == "".join(x[3] or "" for x in own if x[2] == "assistant")
    merged = {r.conv_id: r.formatted.decode() for r in chat.format_conversations(df).select("conv_id", "formatted").collect()}
    assert merged[1].count("<turn>") == 3 and merged[1].count("<turn/>") == 2
    assert chat.digest(chat.read_back(chat.format_conversations(df.where("false")))).count() == 0


# --- near duplicates ----------------------------------------------------------


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = i if r not in least or least[r] is None else least[r] if i is None else min(i, least[r])
    return [(i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)]


def test_near_duplicates(corpus):
    rows, df = corpus
    got = {r.doc_id: r for r in near_dup.near_duplicates(df).collect()}
    want = brute_components(rows)
    assert len(got) == len(rows) and sum(i != c for i, _, c in want) > 20
    for i, n, c in want:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, i == c)


def test_near_duplicates_names_of_several_sets(corpus, odd):
    """With names of a few bits nearly every class is renamed by its full set's digest; the result stays."""
    rows, df = corpus
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, 3).collect()} == set(brute_components(rows))
    got = near_dup.near_duplicates(odd, 2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(ODD))


def test_join_groups_with_hot_keys(spark):
    rows = spark.createDataFrame([(k, 1 if k % 2 else (None if k % 14 == 0 else k)) for k in range(4000)], "x long, k long")
    groups = spark.createDataFrame([(k, k * 10) for k in range(0, 4000, 3)] + [(1, 10)], "k long, v long")
    got = [(r.x, r.v) for r in components.join_groups(rows, groups, "k").collect()]
    want = {k: k * 10 for k in range(0, 4000, 3)} | {1: 10}
    assert len(got) == 4000 and set(got) == {(r.x, want.get(r.k)) for r in rows.collect()}


def test_near_duplicates_odd(odd, none):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(ODD))
    assert near_dup.near_duplicates(none).count() == 0


def test_sequential_bounds():
    need = near_dup.least_matches()
    assert len(need) == near_dup.SIGNATURE // near_dup.BATCH and all(np.diff(need) > 0)
    # a pair of similarity 0.75 survives every batch almost surely
    rng = np.random.default_rng(3)
    hits = (rng.random((20_000, near_dup.SIGNATURE)) < 0.75).cumsum(axis=1)[:, near_dup.BATCH - 1 :: near_dup.BATCH]
    assert (hits < need).any(axis=1).mean() < 2e-3
    far = (rng.random((2000, near_dup.SIGNATURE)) < 0.4).cumsum(axis=1)[:, near_dup.BATCH - 1 :: near_dup.BATCH]
    assert (far < need).any(axis=1).mean() > 0.999


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (5, 5)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    out, _ = components.connected_components(spark.createDataFrame(pairs, "u long, v long"))
    assert {r.node: r.component for r in out.collect()} == {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long"))[0].count() == 0


# --- decontamination ----------------------------------------------------------


def test_decontamination(spark, odd, none):
    rng, vocab = random.Random(8), vocabulary()
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([3, 5, 8, 20, 20, 45, 60])] + [(90, None), (91, " "), (3, "another text with a repeated id here")]
    docs, want = [], set()
    for i in range(60):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 300))]
        if i % 2:
            k, text = items[rng.randrange(7)]
            cut = text.split()
            if i % 4 == 3 and len(cut) > 40:
                cut[len(cut) - 1] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = cut
            want.add((i, k))
        docs.append((i, " ".join(body).title()))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(df, bench).collect()}
    assert want <= set(got)
    for (i, k), r in got.items():  # every find holds by brute force
        w = ascii_words(docs[i][1])[r.first_word : r.first_word + r.n_words]
        ours, theirs = shingles(dict(items[:7]).get(k, "")), shingles(b" ".join(w).decode())
        assert len(ours & theirs) / len(ours | theirs) > 0.6 and r.similarity >= 0.75
    # however the items are cut into blocks, the finds and their similarities are the same
    split = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(df, bench, block_items=3).collect()}
    assert split.keys() == got.keys() and all(math.isclose(split[x], got[x].similarity) for x in got)
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == set(range(60)) - {i for i, _ in got}
    assert decontaminate.clean(df.withColumn("leaked_doc_id", F.lit(1)), bench).columns == ["doc_id", "text", "leaked_doc_id"]
    assert decontaminate.find_leaks(odd, bench).count() == 0
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench.where("false")).count() == 0


def test_decontamination_by_exhaustive_search(spark):
    """All windows against all items: nothing else is found, and 0.9 or more of what there is."""
    rng, vocab = random.Random(21), vocabulary()
    items = {k: [rng.choice(vocab) for _ in range(rng.choice([20, 30, 45]))] for k in range(8)}
    items[8] = items[0][:-4] + [rng.choice(vocab) for _ in range(4)]  # shares most shingles
    n = len(items)
    df = Counter(g for w in items.values() for g in shingles(" ".join(w)))
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    docs, want = [], {}
    for i in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        k = rng.randrange(n)
        cut = list(items[k])
        for _ in range(rng.randint(0, 3)):
            cut[rng.randrange(len(cut))] = rng.choice(vocab)
        at = rng.randrange(len(w) + 1)
        w[at:at] = cut
        docs.append((i, " ".join(w)))
        for k, item in items.items():
            ours, best = Counter({tuple(x.encode() for x in g): c for g, c in bag(item).items()}), 0.0
            for a in range(max(1, len(w) - len(item) + 1)):
                theirs = Counter({tuple(x.encode() for x in g): c for g, c in bag(w[a : a + len(item)]).items()})
                weight = lambda g: math.log(1 + n / df[g]) if df[g] else math.log(1 + n)
                union = sum(weight(g) * max(ours[g], theirs[g]) for g in ours.keys() | theirs.keys())
                best = max(best, sum(weight(g) * min(ours[g], theirs[g]) for g in ours.keys() & theirs.keys()) / union)
            if best >= 0.75:
                want[i, k] = best
    rows = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in rows}
    assert got.keys() <= want.keys() and len(got) >= 0.9 * len(want) > 50
    assert all(s <= want[x] + 1e-9 for x, s in got.items())


def test_bit_blocks_cover_the_radius():
    blocks = decontaminate.bit_blocks()
    assert sum(w for _, w in blocks) == 64 and len(blocks) * (decontaminate.PROBED + 1) > decontaminate.RADIUS
    items = [(k, f"w{k} " * 3 + "some words that follow it here") for k in range(50)]
    ix = decontaminate.Index(items)
    rng = random.Random(0)
    for k in range(50):
        f = int(ix.prints[k])
        for b in rng.sample(range(64), decontaminate.RADIUS):
            f ^= 1 << b
        assert k in ix.near(ix.sizes[k], f)


# --- quality rules ------------------------------------------------------------


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_quality_counts(odd, none, labelled):
    got = quality.score_quality(odd, labelled).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in got) == Counter((i, *brute_quality(t)) for i, t in ODD)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.score_quality(none, labelled).count() == 0
    assert quality.score_quality(odd, labelled.where("false")).where("ratio <> 0").count() == 0


def test_quality_ratio(spark):
    rng, vocab = random.Random(6), vocabulary()
    rows, good = [], set()
    for i in range(300):
        bad = i % 6 == 0
        rows.append((i, (" | " if bad else " ").join(rng.choice(vocab) for _ in range(rng.randint(80, 200)))))
        if not bad:
            good.add(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert {i for i, r in got.items() if r.kept} == good
    # the ratio by hand, over the same n-grams without hashing
    grams = {i: Counter(t.split() + list(zip(t.split(), t.split()[1:]))) for i, t in rows}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in good and i % 2 == 0:
            target.update(g)
    rate = sum(target.values()) / sum(raw.values())
    # grams that share a bucket differ by less than this
    for i, g in grams.items():
        ratio = sum(n * math.log((target[x] + quality.SHRINK) / (raw[x] * rate + quality.SHRINK)) for x, n in g.items()) / sum(g.values())
        assert abs(ratio - got[i].ratio) < 0.1 and (ratio < quality.THRESHOLD) == (got[i].ratio < quality.THRESHOLD)


def test_quality_tells_vocabularies(spark):
    """Texts of the same shape that differ in their words only."""
    rng, vocab, junk = random.Random(7), vocabulary(), ["".join(x) for x in zip("qrstuvwxyz" * 3, "zyxwvutsrq" * 3, "vwxyz" * 6)]
    rows = [(i, " ".join(rng.choice(junk if i % 5 == 0 else vocab) for _ in range(120))) for i in range(200)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 200, 2)]
    got = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id for r in got if r.kept} == {i for i in range(200) if i % 5}


# --- licenses -----------------------------------------------------------------


def brute_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        places += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    return len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


LICENSED = [
    "Licensed under the Apache License, Version 2.0.",
    "CC BY cc-by CC/BY 4.0 x cc by-nc 4.0",
    "All rights reserved all rights, reserved",
    "This work is licensed under the GNU General Public License, version 3. or: gnu GENERAL public license",
    "MIT License. Released under the MIT License.",
    "SPDX-License-Identifier: GPL-2.0-or-later",
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "licensed under some strange new license",
    "admit license cc byte",
    "under the PSF License Agreement",
]


def test_licenses(spark, odd, none):
    rows = [*ODD, *((100 + k, t) for k, t in enumerate(LICENSED)), (200, " ".join(LICENSED * 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("norm", F.lit("x")).withColumn("spans", F.lit("x"))
    got = license_scan.scan_licenses(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i, *brute_licenses(t)) for i, t in rows)
    by = {r.doc_id: r for r in got}
    assert by[100].labels == "apache-2.0"
    assert "cc-by-nc-4.0" in by[101].labels.split(",") and "cc-by-4.0" in by[101].labels.split(",")
    assert by[103].labels == "gpl,gpl-3"
    assert by[104].labels == "mit"
    assert by[105].labels == "gpl-2.0-or-later"
    assert by[107].labels == "unknown-license"
    assert by[108].labels == "" and by[108].score == 0 and by[109].labels == "psf"
    for r in got:
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.detections)
        for x in r.detections:  # nothing kept lies inside something of higher priority
            assert not any(y.first <= x.first and x.last <= y.last and y.priority > x.priority for y in r.detections)
    assert license_scan.scan_licenses(none).count() == 0


def test_license_intervals(spark):
    text = "we say: released under the mit license and it stays"
    r = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(d.first, d.last, d.label) for d in r.detections] == [(2, 6, "mit")]


# --- toxicity -----------------------------------------------------------------


def test_transducers_compose():
    a = transducers.Transducer(arcs={(0, "x"): (1, "y", 1.0), (1, "x"): (0, "x", 0.5)})
    b = transducers.Transducer(arcs={(0, "y"): (1, "z", 2.0), (1, "x"): (1, "w", 4.0)})
    c = transducers.compose(a, b, ["x", "y"])
    for s in (["x"], ["x", "x"], ["x", "x", "y", "x", "x"]):
        wa, mid = a.run(s)
        wb, out = b.run(mid)
        assert c.run(s) == (wa + wb, out)


def test_grammar_kinds():
    scorer = toxicity.Scorer(["idiot$", "idiots$", "scumm"], dict(toxicity.PRIOR))
    ev = lambda t: dict(scorer.read(t)[1])
    assert ev("You are an idiot.") == {"directed": 1}
    assert ev("An idiot came. Scummer!") == {"insult": 2}
    assert ev("You are not an idiot.") == {"denied": 1}
    assert ev('She said "you idiot" yesterday.') == {"reported": 1}
    assert ev("I will kill you") == {"threat": 1} and ev("you I will kill") == {"threat": 1} and ev("I will shoot you tonight") == {"threat": 1}
    assert ev("I will kill time") == {} and ev("I won't kill you") == {"denied": 1} and ev("they wrote: kill you. Then they say kill you") == {"threat": 1, "reported": 1}
    assert ev("idiots like you") == {"directed": 1} and ev("idiot, you!") == {"directed": 1} and ev("idiots. You") == {"insult": 1}
    assert ev("you idiot idiot scummer and so on") == {"directed": 1}  # one clause
    assert ev("idiotic idiotics") == {} and ev(None) == {} and ev("") == {}
    assert ev("one idiot\n" + "word " * 50_000 + "idiot") == {"insult": 2}
    assert scorer.read("idiot " + "word " * 50 + "idiot")[0] == 2 * toxicity.PRIOR["insult"]


def brute_kinds(symbols):
    """Clause kinds by looking around each cue, without transducers."""
    def clause_of(k):
        a, b = k, k
        while a and symbols[a - 1] != "end":
            a -= 1
        while b < len(symbols) and symbols[b] != "end":
            b += 1
        return a, b

    kinds, frame = {}, 0
    for k, x in enumerate(symbols):
        if x == "end":
            frame = 0 if frame == 1 else frame
        elif x == "quote":
            frame = {0: 0, 1: 2, 2: 0}[frame]
        elif x == "report":
            frame = frame or 1
        elif x in ("insult", "threat"):
            a, b = clause_of(k)
            near = range(max(a, k - 4), min(b, k + 5))
            aimed = any(symbols[j] == "target" for j in near)
            kind = "threat" if x == "threat" else "directed" if aimed else "insult"
            if x == "threat" and not aimed:
                continue
            if "negation" in symbols[max(a, k - 4) : k]:
                kind = "denied"
            kinds[k] = "reported" if frame else kind
    out, last, worst = Counter(), None, None
    for k in range(len(symbols)):
        if worst is not None and k not in kinds and (symbols[k] == "end" or k - last == 8):
            out[worst] += 1
            worst = None
        if k in kinds:
            order = toxicity.KINDS.index
            worst, last = kinds[k] if worst is None else min(worst, kinds[k], key=order), k
    return out


def test_grammar_by_brute_force():
    rng = random.Random(12)
    words_of = {"insult": "zorgul", "threat": "kill", "target": "you", "negation": "not", "report": "said", "quote": '"', "word": "tree", "end": "."}
    scorer = toxicity.Scorer(["zorgul"], dict(toxicity.PRIOR))
    for _ in range(3000):
        symbols = rng.choices(list(words_of), [3, 2, 3, 1, 1, 1, 9, 2], k=rng.randint(1, 30)) + ["end"]
        weight, found = scorer.read(" ".join(words_of[x] for x in symbols))
        want = brute_kinds(symbols)
        assert found == want, symbols
        assert math.isclose(weight, sum(n * toxicity.PRIOR[k] for k, n in want.items()), abs_tol=1e-9)


def test_near_copies_make_no_stems(spark):
    rng, vocab = random.Random(3), vocabulary()
    base = [rng.choice(vocab) for _ in range(60)] + ["plainword"] + [rng.choice(vocab) for _ in range(60)]
    rows, labels = [], []
    for i in range(300):
        w = list(base) if i < 100 else [rng.choice(vocab) for _ in range(60)]
        w[rng.randrange(50)] = rng.choice(vocab)
        if i % 10 == 0 and i >= 100:
            w[5] = "zorgul"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i < 100 or i % 10 == 0)))
    stems, _ = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any(x.startswith("zor") for x in stems) and not any("plainword".startswith(x.rstrip("$")) for x in stems)


def test_toxicity_learns_stems(spark, odd, none, labelled):
    rng, vocab = random.Random(9), vocabulary()
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zorgul", "zorguna", "qwibble"]) if i % 2 else "zorg" + rng.choice(["ab", "ed", "if", "og"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score_toxicity(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len(toxicity.score_toxicity(odd, model).collect()) == len(ODD)
    assert toxicity.score_toxicity(none, model).count() == 0
    assert toxicity.train(odd, labelled)[0] == ()
    assert toxicity.train(none, labelled.where("false")) == ((), tuple(toxicity.PRIOR.items()))


# --- language model -----------------------------------------------------------


def brute_forward(model, d):
    a = model.start * model.emit[d[0]]
    for s in d[1:]:
        a = (a @ model.move) * model.emit[s]
    return math.log(a.sum())


def brute_counts(model, docs):
    k = len(model.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
    for d in docs:
        n = len(d)
        al, be = np.zeros((n, k)), np.ones((n, k))
        al[0] = model.start * model.emit[d[0]]
        for t in range(1, n):
            al[t] = (al[t - 1] @ model.move) * model.emit[d[t]]
        for t in range(n - 2, -1, -1):
            be[t] = model.move @ (model.emit[d[t + 1]] * be[t + 1])
        p = al[-1].sum()
        g = al * be / p
        start += g[0]
        for t in range(n):
            emit[d[t]] += g[t]
            if t + 1 < n:
                move += al[t][:, None] * model.move * (model.emit[d[t + 1]] * be[t + 1])[None, :] / p
    return start, move, emit


def test_forward_and_counts():
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((7, 3)), 0))
    docs = [rng.integers(0, 7, size=n) for n in (1, 5, 2, 30, 1, 12)]
    for got, want in zip(hmm.expected_counts(model, docs), brute_counts(model, docs)):
        assert np.allclose(got, want)
    order = sorted(docs, key=len, reverse=True)
    assert np.allclose(hmm.forward(model, order), [brute_forward(model, d) for d in order])
    long = np.tile(docs[3], 2000)
    assert np.isfinite(hmm.forward(model, [long])[0])


def test_language_model(spark, corpus, odd, none):
    rows, df = corpus
    got = {r.doc_id: r for r in hmm.score_language(df, vocabulary_size=150).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in ascii_words(t)) + Counter({"END": len(train)})
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        tokens = [*ascii_words(t), "END"]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(c[w] > 0 for w in tokens), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert r.score < 0
    got = hmm.score_language(odd).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(ascii_words(t)) + 1) for i, t in ODD)
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert hmm.score_language(none).count() == 0


def test_rounds_raise_the_likelihood(spark):
    rng = random.Random(2)
    docs = [[(rng.randrange(6) + 6 * (k % 2)) if rng.random() < 0.9 else 12 for _ in range(rng.randint(5, 40))] + [13] for k in range(80)]
    encoded = spark.createDataFrame([(False, bytearray(np.array(d, dtype="<u2").tobytes())) for d in docs], "held_out boolean, symbols binary").repartition(3)
    unigram = np.bincount([x for d in docs for x in d], minlength=14) + 1.0
    model, curve = hmm.starting_model([], unigram / unigram.sum(), states=2, rounds=0), []
    model.emit = model.emit * np.random.default_rng(1).uniform(0.5, 1.5, model.emit.shape)
    model.emit /= model.emit.sum(axis=0)
    for _ in range(4):
        model, likelihood = hmm.baum_welch_round(encoded, model)
        curve.append(likelihood)
    assert curve == sorted(curve) and curve[-1] > curve[0]


def test_symbol_probabilities_sum_to_one():
    model = hmm.starting_model([np.array([0, 1, 2, 4]), np.array([3, 3, 4])], np.array([0.3, 0.2, 0.2, 0.2, 0.1]), states=2, rounds=2)
    total = sum(math.exp(hmm.forward(model, [np.array([a, b])])[0]) for a in range(5) for b in range(5))
    assert math.isclose(total, 1, rel_tol=1e-9)


# --- html ---------------------------------------------------------------------


def page(k, host, body):
    return f'<!DOCTYPE html><html><head><title>t{k}</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li>About</li></ul></nav><div class="ad">buy {k}</div><article><h1>Title {k}</h1>{body}<aside>side {k}</aside></article><section class="comments"><p>comment number {k} which is long, longer than the text</p></section><form><p>form {k}</p></form><footer>&copy; {host}</footer></body></html>'


def test_main_text(spark):
    rows, want = [], {}
    for k in range(12):
        host = "a.example" if k < 10 else f"h{k}.example"
        body = f"<p>First &amp; <b>bold</b>\n  part {k}<br>line<p>Same on every page.</p><ul><li>x{k}</ul>"
        rows.append((k, f"https://{host}/p/{k}?q", page(k, host, body)))
        want[k] = f"Title {k}\nFirst & bold part {k}\nline\nSame on every page.\nx{k}"
    cut = page(20, "a.example", "<p>kept text<p>cut he")
    rows += [(20, "http://A.example/20", cut[: cut.index("cut he") + 6] + "<di"), (21, None, None), (22, "http://a.example", ""), (23, None, "<p>no host</p>"), (0, rows[0][1], rows[0][2]), (24, "x", "plain text &lt;b&gt;")]
    want |= {20: "Title 20\nkept text\ncut he", 21: "", 22: "", 23: "no host", 24: "plain text <b>"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({x: F.lit("z") for x in ("host", "exemplar", "region", "text")}).repartition(3)
    got = wrapper.extract_main_text(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), r.page_id
    assert wrapper.extract_main_text(df.where("false")).count() == 0


def test_wrapper_finds_an_unnamed_region(spark):
    """Without telling names, the varying slot with the most text is the content."""
    def one(k):
        text = f"Story {k} tells of many things {k}. " * 5
        return f"<html><body><div class='top'>Site name</div><div class='x1'><p>{text}</p><p>Shared line.</p></div><div class='x2'>Impressum und Hinweise</div></body></html>"

    rows = [(k, f"http://plain.example/{k}", one(k)) for k in range(8)]
    for r in wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == (f"Story {r.page_id} tells of many things {r.page_id}. " * 5).strip() + "\nShared line."


@pytest.mark.parametrize("top", ["<html class='no-cookies'><body class='single has-sidebar'>", "<body class='sidebar'>", "<body id=nav><div class='layout with-sidebar'>", "<body><div class='sidebar-right'>", "<body><div class='widget'>"])
def test_wrapper_keeps_content_in_telling_names(spark, top):
    """A layout's name, or a part of a name, doesn't make the content boilerplate."""
    def one(k):
        inner = f"<div class='post-header'><h1>Title {k}</h1></div><p class='side-note'>Note {k}</p><p class=notice>Notice {k}</p><div class=header>Head {k}</div><p>{f'Story {k}. ' * 9}</p><div class=share>Share {k}</div>"
        return f"{top}<div class='cookie-banner'>Cookies {k}</div><article>{inner}</article><div id=comments><article>Comment {k}</article></div>"

    rows = [(k, f"http://{'named' if k < 6 else f'single{k}'}.example/{k}", one(k)) for k in range(8)]
    for r in wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        k = r.page_id
        assert r.text == f"Title {k}\nNote {k}\nNotice {k}\nHead {k}\n" + (f"Story {k}. " * 9).strip()


@pytest.mark.parametrize("tag", ["font", "div", "li><ul", "span", "section class=content"])
def test_wrapper_reads_deep_pages(spark, tag):
    """Elements that nest 10,000 deep, none of them closed."""
    body = lambda n: "".join(f"<{tag}>w{n}.{k} " for k in range(10_000)) + "</b><p>the end"
    rows = [(n, "http://deep.example/", f"<html><body>{body(n)}") for n in range(2)] + [(2, "http://alone.example/", f"<main>{body(2)}")]
    for r in wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text.split() == [f"w{r.page_id}.{k}" for k in range(10_000)] + ["the", "end"]


def test_wrapper_keeps_the_text_of_copies(spark):
    """A text that most pages of a host share is content, if these pages are copies."""
    def one(k, text):
        return f"<html><body><div class='top'>Site name</div><div class='x0'>Visit {k}</div><div class='x1'><p>{text}</p></div></body></html>"

    copied = ("The text of the copies goes on. " * 8).strip()
    rows = [(k, f"http://some.example/{k}", one(k, copied if k < 14 else f"Story {k}. " * 9)) for k in range(20)]
    rows += [(100 + k, f"http://all.example/{k}", one(k, copied)) for k in range(10)]
    for r in wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        want = copied if r.page_id < 14 or r.page_id >= 100 else (f"Story {r.page_id}. " * 9).strip()
        assert want in r.text.split("\n"), r.page_id
        assert r.page_id >= 100 or "Site name" not in r.text


@pytest.mark.parametrize("runs", [2, 200])
def test_wrapper_returns_all_runs(spark, runs):
    """Content straight under the body, in several runs of like siblings; template parts it, pages differ in their number."""
    def one(k):
        parts = [f"<h1>Title {k}</h1>"]
        for n in range(runs + k % 3):
            parts.append(f"<p>Text {k}.{n} begins.</p><p>Text {k}.{n} ends.</p><h2>Part {k}.{n}</h2><ul><li>Item {k}.{n}</ul><div class='z{n % 5}'>Row {k}.{n}</div>")
        return f"<html><body><nav>Menu</nav><div class='top'>Site name</div>{''.join(parts)}loose {k}<div class='end'>Impressum</div><footer>Foot</footer></body></html>"

    rows = [(k, f"http://runs.example/{k}", one(k)) for k in range(9)]
    for r in wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        k = r.page_id
        want = [f"Title {k}"]
        for n in range(runs + k % 3):
            want += [f"Text {k}.{n} begins.", f"Text {k}.{n} ends.", f"Part {k}.{n}", f"Item {k}.{n}", f"Row {k}.{n}"]
        assert r.text.split("\n") == [*want, f"loose {k}"]


def test_wrapper_returns_the_title_outside(spark):
    for inner in ("div class=content", "article"):
        rows = [(k, "http://title.example", f"<body><div>Site name</div><h1>Title {k}</h1><{inner}><p>{f'Story {k}. ' * 9}</{inner.split()[0]}></body>") for k in range(5)]
        for r in wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
            assert r.text == f"Title {r.page_id}\n" + (f"Story {r.page_id}. " * 9).strip()


def test_wrapper_tells_template_inside_by_counts(spark):
    """Neutral names on many hosts: a container that is the same on all pages goes, also inside the content; names alone keep it."""
    rows, want = [], {}
    for h in range(6):
        for k in range(9):
            i = 100 * h + k
            story = [f"Story {i} begins.", "A line that all pages share.", f"Story {i} ends."]
            inner = f"<div class='a{h}'><p>{story[0]}<p>{story[1]}</div><div class='b{h}'>Our house offers {h}</div><div class='c{h}'><p>{story[2]}</div>"
            tag = ("article", "div class=k", "section")[h % 3]
            rows.append((i, f"http://neutral{h}.example/{k}", f"<body><div class='z'>House {h}</div><{tag}>{inner}</{tag.split()[0]}><div class='y'>Rules of house {h}</div></body>"))
            want[i] = "\n".join(story)
    for r in wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == want[r.page_id]
    assert all(wrapper.extract(x, None, None, None) != want[i] for i, _, x in rows)


def test_matching_by_brute_force():
    from tracefold.llm import dom

    rng = random.Random(5)

    def tree(depth):
        kids = "".join(tree(depth - 1) for _ in range(rng.randint(0, 3))) if depth else "x"
        name = rng.choice(["div class=a", "div class=b", "section"])
        return f"<{name}>{kids}</{name.split()[0]}>"

    def largest(a, b):
        """Size of the largest common tree, over all ways to pair the children in order."""
        if a.key != b.key:
            return 0

        def forest(x, y):
            if not x or not y:
                return 0
            return max(forest(x[1:], y), forest(x, y[1:]), largest(x[0], y[0]) + forest(x[1:], y[1:]))

        return 1 + forest(a.children, b.children)

    for _ in range(60):
        a, b = (dom.shape(dom.parse(f"<body>{tree(3)}{tree(2)}</body>")) for _ in range(2))
        size, pairs = dom.match(a, b)
        assert size == largest(a, b) == len(pairs) and all(x.key == y.key for x, y in pairs)


def test_tree_matching():
    from tracefold.llm import dom

    a, b = (dom.shape(dom.parse(x)) for x in ("<body><nav></nav><div class=a><p>1<p>2</div><footer></footer></body>", "<body><div class=a><p>1</div><aside></aside><footer></footer></body>"))
    size, pairs = dom.match(a, b)
    assert size == 5 and [x.key for x, _ in pairs][1:3] == ["body|", "footer|"]
    assert html.unescape("&amp;") == "&"


def test_tree_matching_of_many_children(monkeypatch):
    """Above LISTED_PAIRS the matching is the same, pair by pair."""
    from tracefold.llm import dom

    rng = random.Random(9)

    def body(n, names):
        kids = []
        for k in range(n):
            name = rng.choice(names)
            inner = "".join(f"<div class={rng.choice('xyz')}>t</div>" for _ in range(rng.randint(0, 3)))
            kids.append(f"<div class={name}>{inner}</div>" if k % 2 else f"<section class={name}>{inner}</section>")
        return dom.shape(dom.parse(f"<body>{''.join(kids)}</body>"))

    for n, m, names in ((40, 60, "abc"), (1, 30, "ab"), (30, 1, "ab"), (17, 17, "a"), (50, 50, "abcdefghijklmnop")):
        a, b = body(n, names), body(m, names)
        monkeypatch.setattr(dom, "LISTED_PAIRS", 1 << 40)
        size, pairs = dom.match(a, b)
        monkeypatch.setattr(dom, "LISTED_PAIRS", 0)
        again, rows = dom.match(a, b)
        assert again == size == len(pairs) == len(rows)
        assert [(id(x), id(y)) for x, y in rows] == [(id(x), id(y)) for x, y in pairs]
    monkeypatch.undo()
    a, b = body(420, "abcdefgh"), body(400, "abcdefgh")
    monkeypatch.setattr(dom, "LISTED_PAIRS", 1 << 40)
    size = dom.match(a, b)[0]
    monkeypatch.undo()
    assert dom.match(a, b)[0] == size == len(dom.match(a, b)[1])


def test_vocabulary_is_filled_at_any_count(spark):
    """Words of one count, and counts past 2**20: the most frequent are chosen, ties by hash, never none."""
    big = [(k, (1 << 21) + k % 2) for k in range(5)]
    assert len(hmm.choose_vocabulary(spark.createDataFrame(big, "word long, count long"), 3)) == 3
    assert {w for w, _ in hmm.choose_vocabulary(spark.createDataFrame(big, "word long, count long"), 2)} == {1, 3}
    tied = spark.range(5000).select(F.col("id").alias("word"), F.lit(1).cast("long").alias("count"))
    some = hmm.choose_vocabulary(tied.unionByName(spark.createDataFrame([(None, 99), (9000, 7), (9001, 3)], "word long, count long")), 40)
    assert len(some) == len(set(some)) == 40 and {(9000, 7), (9001, 3)} <= set(some)
    assert set(some) == set(hmm.choose_vocabulary(tied.repartition(7).unionByName(spark.createDataFrame([(9001, 3), (9000, 7)], "word long, count long")), 40))
    assert len(hmm.choose_vocabulary(tied, 5000)) == len(hmm.choose_vocabulary(tied, 9000)) == 5000
    assert hmm.choose_vocabulary(tied.where("false"), 10) == []
