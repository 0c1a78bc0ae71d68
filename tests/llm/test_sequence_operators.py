"""Conversation repair, fill-in-middle, language identification and running totals against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tracefold.llm")

from pyspark.sql import functions as F  # noqa: E402

from tests.llm.test_operators import none, odd  # noqa: E402, F401
from tracefold.llm import catalog, chat, decontaminate, fim, langid, license_rules, license_scan, repair, scans  # noqa: E402
from tracefold.session import ship  # noqa: E402

# --- conversation structure repair ----------------------------------------------


def brute_faults(rows):
    """(role, text, fault) of a conversation's rows in order."""
    out, seen = [], set()
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        end = text.rstrip(repair.SPACE)
        fault = "b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute_repair(rows):
    """(cost, audit, repaired text) by trying all edits, with at most three inserted turns."""
    found = []

    def go(k, cost, audit, said, inserted):
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in said)):
            found.append((cost, audit, "\n".join(f"{r}:{t}" for r, t in said)))
        if inserted < 3:
            for name in ("user", "assistant"):
                go(k, cost + 5, audit + "I", [*said, (name, "")], inserted + 1)
        if k < len(rows):
            role, text, fault = rows[k]
            go(k + 1, cost + 2, audit + "D", said, inserted)
            if fault not in ("b", "d"):
                more = 5 if fault == "t" else 0
                go(k + 1, cost + more, audit + "K", [*said, (role, text)], inserted)
                for name in ("user", "assistant"):
                    go(k + 1, cost + more + 1, audit + "R", [*said, (name, text)], inserted)

    go(0, 0, "", [], 0)
    return min(found)


def conversations(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", " ", "", "sys"]
    texts = ["a b.", "c!", "d", "e? \n", "", " ", "f.", "g.", "very\nlong text. " * 50]
    for conv in range(n):
        turn = rng.randint(-2, 3)
        rows = []
        for _ in range(rng.randint(0, 4)):
            turn += rng.choice([0, 1, 1, 1, 3])
            rows.append((turn if rng.random() > 0.1 else None, rng.choice(roles[: rng.choice([2, 5, 9])]), rng.choice(texts)))
        yield conv, rows


def summaries(df):
    return {r.conv_id: r for r in df.where("place is null").collect()}


def test_repair_equals_brute_force(spark):
    ship(spark)
    given = dict(conversations(3, 120))
    rows = [(c, *r) for c, rs in given.items() for r in rs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = repair.repair_conversations(df.withColumn("fault", F.lit("x")).withColumn("copies", F.lit("x")))
    got, edits = summaries(out), out.where("place is not null").collect()
    assert set(got) == {c for c, rs in given.items() if rs}
    for conv, rs in given.items():
        if not rs:
            continue
        faults = brute_faults(rs)
        cost, audit, text = brute_repair(faults)
        r = got[conv]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), (conv, rs)
        own = sorted((e.place, e.edit, e.role, e.text) for e in edits if e.conv_id == conv)
        assert "".join(e[1] for e in own) == audit and [e[0] for e in own] == list(range(len(audit)))
        assert "\n".join(f"{e[2]}:{e[3]}" for e in own if e[1] != "D") == text
        turns = [t for t, _, _ in rs if t is not None]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        count = Counter(f for _, _, f in faults)
        assert (r.blank, r.duplicate, r.truncated) == (count["b"], count["d"], count["t"])
        assert r.illegal == sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))


def test_repair_of_odd_tables(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(None, None, None, None), (None, 1, "user", "x."), (5, 0, "user", "hi."), (5, 1, "assistant", "yo."), (6, (1 << 63) - 1, "user", "q."), (6, -(1 << 63), "user", "p."), *[(7, 3, "user", "again.")] * 400]
    got = summaries(repair.repair_conversations(spark.createDataFrame(rows, kind), keep_edits=False))
    assert got[None].audit == "DRR"[:1] + got[None].audit[1:] and got[None].blank == 1 and got[None].gaps == 0
    assert (got[5].cost, got[5].audit) == (0, "KK")
    assert got[6].gaps == (1 << 63) - 1 and got[6].audit == "KR"
    assert (got[7].duplicate, got[7].illegal, got[7].audit, got[7].cost) == (399, 399, "D" * 400, 800)
    assert repair.repair_conversations(spark.createDataFrame([], kind)).count() == 0
    all_ = repair.with_all(repair.repair_conversations(spark.createDataFrame(rows, kind).where("conv_id = 5"), False), spark.createDataFrame(rows, kind)).collect()
    assert {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in all_}[7] == (0, "", hashlib.sha256(b"").hexdigest()) and len(all_) == 4


def test_long_conversations_stream(spark):
    rows = [(0, k, ("user", "assistant")[k % 2] if k % 7 else "user", f"text {k}" + "." * (k % 11 != 3)) for k in range(30_000)]
    out = summaries(repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), keep_edits=False))[0]
    column, audit = repair.predict({"turns": (0, "")}), ""
    for _, k, role, text in rows[:600]:
        column = repair.scan(column, role[0], "" if text.endswith(".") else "t")
    audit = repair.complete(column)[1]
    assert out.audit[:500] == audit[:500] and len(out.audit) >= 30_000


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        d = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, *range(60)) for t in (None, 0, 1) for r, x in (("system", "a.b!"), (None, None))]
    got = repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(brute_damage(rows))


# --- fill-in-middle ---------------------------------------------------------------


def brute_fim(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = "".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return (doc_id, len(lines), "plain", None, None, text)
    if h[3] % 100 < 50:
        return (doc_id, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim_equals_brute_force(spark, odd):  # noqa: F811
    rng = random.Random(5)
    parts = ["", "\n", "a", "é", "𝒳y", "<P", "<", "<S>", "line of words", " ", "\r", "x" * 300, "\n\n"]
    docs = [(k, "".join(rng.choice(parts) + rng.choice(["\n", "", "\n"]) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    docs += [(1000 + k, "the same\ntext\nin many\nplaces") for k in range(300)] + [(2000, "line\n" * 40_000), (2001, "x" * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("digest", "ends", "n", "form", "parts", "part", "chars", "count")})
    rows = df.unionByName(odd.select("doc_id", "text"), allowMissingColumns=True)
    given = [(r.doc_id, r.text) for r in rows.collect()]
    want = Counter(brute_fim(*x) for x in given)
    for hot in (fim.HOT_ROWS, 50):
        made = fim.fill_in_middle(rows, hot_rows=hot)
        assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()) == want
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = Counter((r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.digests(made).collect())
    assert got == Counter((d, sha(brute_fim(d, t)[5]), sha(t or "")) for d, t in given)


def test_elias_fano_entries(spark):
    rng = np.random.default_rng(2)
    lists = [np.zeros(1, dtype=np.int64), np.arange(200), np.array([0, 1, 1 << 40]), np.cumsum(rng.integers(1, 4000, 700))] + [np.sort(rng.integers(0, 1 << int(rng.integers(1, 30)), int(rng.integers(1, 300)))) for _ in range(30)]
    rows = [(k, j, int(v), *[x if isinstance(x, int) else x.tolist() for x in fim.elias_fano(o)]) for k, o in enumerate(lists) for j, v in enumerate(o)]
    df = spark.createDataFrame(rows, "k int, j int, v long, bits int, low array<long>, high array<long>, ranks array<int>")
    found = df.select("v", fim.entry(F.struct("bits", "low", "high", "ranks"), F.col("j")).alias("got"))
    assert found.where("v <> got or got is null").count() == 0


def test_fim_empty_table(spark, none):  # noqa: F811
    assert fim.digests(fim.fill_in_middle(none)).count() == 0


# --- language identification --------------------------------------------------------


def brute_fit(p, n, rounds):
    """One document's proportions by the textbook loop."""
    share = [1 / len(p[0])] * len(p[0])
    for _ in range(rounds):
        sums = [0.0] * len(share)
        for row, count in zip(p, n):
            mixed = sum(x * s for x, s in zip(row, share))
            for j, x in enumerate(row):
                sums[j] += count * x * share[j] / mixed
        share = [x / sum(n) for x in sums]
    return share, sum(c * math.log(sum(x * s for x, s in zip(row, share))) for row, c in zip(p, n))


def tongue(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


LETTERS = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "mnopéèà", "dd": "qrstuvwñ"}


def spoken(seed, n):
    rng = random.Random(seed)
    docs = [(k, tongue(rng, LETTERS[x], rng.randint(3, 60)), x) for k, x in enumerate(rng.choices(sorted(LETTERS), k=n))]
    return docs, rng


def test_mixture_fit_equals_the_loop():
    rng = np.random.default_rng(1)
    sizes = [1, 5, 40, 2]
    p, n = rng.random((sum(sizes), 4)) + 1e-3, rng.integers(1, 9, sum(sizes)).astype(float)
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    share, likelihood = langid.fit(p, n, first, np.ones((4, 4)), rounds=7)
    for k, (a, size) in enumerate(zip(first, sizes)):
        want, ll = brute_fit(p[a : a + size].tolist(), n[a : a + size].tolist(), 7)
        assert np.allclose(share[k], want) and np.isclose(likelihood[k], ll)
    only, _ = langid.fit(p, n, first, np.tile([0.0, 1, 0, 0], (4, 1)))
    assert np.allclose(only, [[0, 1, 0, 0]] * 4)


def test_languages_are_found(spark):
    ship(spark)
    docs, rng = spoken(8, 900)
    mixed = [(5000 + k, tongue(rng, LETTERS["aa"], 60) + ". " + tongue(rng, LETTERS["dd"], 25), None) for k in range(20)]
    odd_ = [(6000, None, "aa"), (6001, "", "bb"), (6002, "12 34 !? 😀", "aa"), (None, tongue(rng, LETTERS["bb"], 30), None), (6003, tongue(rng, LETTERS["cc"], 30_000), None), (6004, "😀 ß", None)]
    df = spark.createDataFrame(docs + mixed + odd_, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("letters", "score", "bucket", "n", "held_out")}).repartition(4)
    model = langid.train(df)
    want = np.zeros((langid.BUCKETS, 4), dtype=np.int64)
    for d, t, x in docs + odd_:
        if t and x and zlib.crc32(str(d).encode()) % 5:
            raw = np.frombuffer(t.encode(), dtype=np.uint8)
            np.add.at(want[:, sorted(LETTERS).index(x)], langid.tokens(raw, np.array([0, len(raw)]))[0], 1)
    assert model.languages == sorted(LETTERS) and np.array_equal(model.logs, langid.Model(model.languages, want).logs)
    rows = langid.identify(df, model).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) + len(mixed) + len(odd_) and all(0 <= r.score <= 1 for r in rows)
    held = [(d, x) for d, _, x in docs if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, _ in held} == {r.doc_id for r in rows if r.held_out and r.doc_id < 5000}
    assert sum(got[d].lang_pred == x for d, x in held) > 0.98 * len(held) > 100
    for d, _, _ in mixed:
        shares = dict(x.split(":") for x in got[d].languages.split(","))
        assert set(shares) == {"aa", "dd"} and abs(float(shares["dd"]) - 0.3) < 0.12 and got[d].lang_pred == "aa"
    assert [(got[d].lang_pred, got[d].score) for d in (6000, 6001, 6002)] == [("und", 0.0)] * 3
    assert got[None].lang_pred == "bb" and got[6003].lang_pred == "cc" and got[6004].lang_pred != "und"
    assert not got[None].held_out


def test_languages_without_training(spark, none, odd):  # noqa: F811
    ship(spark)
    empty = langid.train(none.withColumn("lang", F.lit("en")))
    assert empty.languages == [] and langid.identify(none, empty).count() == 0
    assert {(r.lang_pred, r.score, r.languages) for r in langid.identify(odd, empty).collect()} == {("und", 0.0, "")}
    with pytest.raises(ValueError, match="values of lang"):
        langid.train(spark.range(700).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.col("id").cast("string").alias("lang")))


def test_registered():
    assert {"op11_structure_repair", "op12_fill_in_middle", "op13_language_id"} <= set(catalog.queries())


# --- running totals, and what rests on them -------------------------------------------


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(k, [rng.randint(0, 9) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 3, 4, 5, 10, 17, 100, 5000])] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, x array<int>")
    got = {r.k: r.t for r in df.select("k", scans.totals_before(F.col("x")).alias("t")).collect()}
    for k, x in rows:
        assert got[k] == [sum(x[:i]) for i in range(len(x or []))]
    cut = df.where("size(x) > 0").select("x", scans.pieces(F.col("x")).alias("p")).collect()
    assert all(sum(r.p, []) == r.x and max(map(len, r.p)) <= math.isqrt(len(r.x)) + 1 for r in cut)


def test_long_conversation_is_formatted(spark):
    n = 20_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é <turn/> "), F.col("id").cast("string")).alias("text"))
    r = chat.digest(chat.read_back(chat.format_conversations(turns))).collect()[0]
    loss = "".join(f"é <turn/> {k}" for k in range(n) if k % 3)
    assert r.n_turns == n and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def brute_detections(text):
    """Matches of all rules whose keyword is in the text, and which of them stand, by comparing all pairs."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    inner = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ", low)
    norm = " " + inner.strip(" ") + " "
    spans = set()
    for label, priority, keyword, pattern in license_rules.rules():
        if keyword in norm:
            for m in re.finditer(pattern, norm):
                first = len(norm[: m.start()].split())
                if m[0].strip():
                    spans.add((first, first + len(m[0].split()) - 1, priority, label))

    def inside(x, y):
        within = y[0] <= x[0] and x[1] <= y[1]
        longer, same = y[1] - y[0] > x[1] - x[0], y[:2] == x[:2]
        return within and (y[2] > x[2] or (y[2] == x[2] and (longer or (same and y[3] < x[3]))))

    return sorted(x for x in spans if not any(inside(x, y) for y in spans))


def test_license_detections_equal_all_pairs(spark):
    rng = random.Random(12)
    wordings = [text for _, _, _, text in license_rules.PLAIN] + [f"{name} version {v}" for _, _, names, versions in license_rules.VERSIONED for name in names for v in versions]
    wordings += ["Licensed under the", "released under", "any later version", "SPDX-License-Identifier: MIT", "CC BY-SA 4.0", "cc by", "All rights reserved", "word", "other words", "license", "Copyright 2020"]
    docs = [(k, ". ".join(rng.choice(wordings).replace("~", "some words").replace("{year}", "1999") for _ in range(rng.choice([1, 3, 10, 60])))) for k in range(80)] + [(900, None), (901, "")]
    got = {r.doc_id: [tuple(x) for x in r.detections] for r in license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    for k, text in docs:
        assert got[k] == brute_detections(text or ""), (k, text)


def test_many_license_hits_in_one_text(spark):
    n = 6000
    text = ". ".join(f"Licensed under the MIT License {k} and GNU General Public License version 2" for k in range(n))
    r = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(r.detections) == 2 * n and r.labels == "gpl,gpl-2,mit" and r.n_base == n


def test_decontamination_in_blocks_by_length(spark, monkeypatch):
    rng = random.Random(13)
    words_ = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    items = [(k, " ".join(rng.choice(words_) for _ in range(40))) for k in range(30)]
    docs = [(k, " ".join([rng.choice(words_) for _ in range(50)] + (items[k % 30][1].split() if k % 2 else []))) for k in range(60)]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    whole = rows()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1500)
    assert rows() == whole and {r[0] for r in whole} >= {k for k in range(60) if k % 2}
