"""PII, quality, licences, decontamination, language model and mixing against brute force."""

import hashlib
import math
import pickle
import random
import re
from pathlib import Path
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import decontamination, lattice_lm, license_scan, license_texts, mixing, pii, quality_cnn, quality_rules
from lexloom.session import apply_settings

from .conftest import SCHEMA, by_id

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base(x):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(s, e, k) for s, _, k, e in sorted(out)]


def test_base_spans_of_random_strings():
    rng = random.Random(2)
    for _ in range(3000):
        x = "".join(rng.choice("a1@.-+ 5é(") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(x) == _base(x), x
    for x in ("1.2.3.4.5.6.7.8", "a@b.c_x@d.e", "x@y", "999.1.1.1", "0001.2.3.4", "4111-1111 1111 1111", "+1 212.555.0100", "1" * 5000):
        assert pii.base_spans(x) == _base(x), x


def test_op1(docs, rows, no_docs):
    out = pii.op1(docs)
    want = []
    for r in rows:
        spans = _base(r[1] or "")
        kinds = [k for *_, k in spans]
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
        want.append((r[0], *(kinds.count(k) for k in pii.BASE_KINDS), digest))
    got = by_id(out, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == sorted(want, key=lambda r: (r[0] is None, repr(r)))
    assert pii.op1(no_docs).collect() == []


def test_trees_find_secrets_and_leave_words_alone(spark):
    rng = random.Random(9)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(600):
        words = [rng.choice(["alpha", "beta", "gammadeltaepsilon", "a2", "room12", "x=y", "version-2024-build"]) for _ in range(30)]
        if i % 3 == 0:
            words[5] = f"password={hexa(18)}"
        if i % 5 == 0:
            words[9] = f"u{i}@mail.example.com"
        rows.append((i, " ".join(words), "en", "s", 1, "", "", ""))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = pii.fit(docs)
    out = {r["doc_id"]: r for r in pii.detect(docs, model).collect()}
    secrets = sum("secret" in out[i]["spans"] for i in range(0, 600, 3))
    assert secrets >= 190
    assert sum("secret" in out[i]["spans"] for i in range(600) if i % 3) == 0
    assert all(out[i]["n_email"] == (i % 5 == 0) for i in range(600))
    clean = {r["doc_id"]: r for r in pii.redacted(docs, model).collect()}
    assert "<EMAIL>" in clean[5]["text"] and "@" not in clean[5]["text"]
    assert clean[1]["text"] == rows[1][1] and clean[5]["n_chars"] == len(clean[5]["text"])


def test_masking_overlaps_and_nulls(docs):
    assert pii.masked("0123456789", [(1, 3, "email"), (2, 5, "card"), (7, 8, "ip")]) == "0<EMAIL>56<IP>89"
    out = pii.redacted(docs, None)
    assert out.columns == docs.columns
    assert {r["text"] for r in out.where("doc_id = 1").collect()} == {None}
    (row,) = out.where("doc_id = 17").collect()
    assert row["text"] == "mail <EMAIL> or <IP>, card <CARD>, tel <PHONE>"


# --- quality rules --------------------------------------------------------------


def _rules(x):
    w = WORD.findall(x)
    seen, dup = set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_op4(spark, docs, rows, no_docs):
    apply_settings(spark)
    out = quality_rules.op4(docs)
    got = by_id(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((r[0], *_rules(r[1] or "")) for r in rows), key=lambda r: (r[0] is None, repr(r)))
    assert all(not r["kept"] for r in out.where("base_failed").collect())
    assert quality_rules.op4(no_docs).collect() == []


def test_ratio_rejects_what_the_trusted_part_lacks(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice(["sun", "moon", "star", "sky", "rain", "wind", "tree", "leaf"]) + str(rng.randint(0, 40)) for _ in range(80)) for _ in range(60)]
    junk = [" ".join(w + "***" for w in t.split()) for t in clean[:15]]
    rows = [(i, t, "en", "s", 0, "", "", "") for i, t in enumerate(clean + junk)]
    out = quality_rules.op4(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"] for r in out if r["kept"]} == set(range(60))


# --- quality classifier ---------------------------------------------------------


def _labelled(spark):
    rng = random.Random(4)
    text = lambda good: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) + ("" if good else "$$$") for _ in range(60))
    rows = [(i, text(i % 4 != 0), "en", "s", 1, "x", "y", "z") for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(500)], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(rows, SCHEMA), labels


def test_op10_learns_and_is_judged_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    out = quality_cnn.op10(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert len(held) > 60 and sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_op10_odd_rows(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(7, 1, 0), (14, 0, 0), (None, 1, 0), (8, None, 0), (16, 0, 1)], "doc_id long, quality int, toxic int")
    out = quality_cnn.op10(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (7, 8, 200, 201)}) == 1
    assert quality_cnn.op10(no_docs, labels).collect() == []
    assert quality_cnn.op10(docs, labels.where("false")).count() == len(rows)
    passed = quality_cnn.classify(docs, quality_cnn.fit(docs, labels))
    assert [c for c in passed.columns if c not in ("score", "predicted")] == [c for c in docs.columns if c != "score"]


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 480, 5000):
        s = quality_cnn.chunk_starts(n)
        covered = {i for a in s for i in range(a, min(a + quality_cnn.CHUNK, n))}
        assert covered == set(range(n))


# --- licences -------------------------------------------------------------------


def test_licences(spark):
    mit = license_texts.FULL_TEXTS["MIT"]
    british = "Copyright (c) 2020 A. Person\n\n" + mit.replace("\n\n", "\n").replace("sublicense", "sublicence").upper()
    rows = [
        (1, mit), (2, british), (3, mit + " extra"), (4, "Some text\nLicensed under the Apache Licence, version 2.0\nmore"),
        (5, None), (6, ""), (7, "MIT License\n\n" + mit), (8, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (1, mit),
        (9, license_texts.FULL_TEXTS["BSD-3-Clause"] + "\nAll rights reserved."),
    ]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, digest string")
    got = {r["doc_id"]: (r["license_id"], r["line_licenses"]) for r in license_scan.scanned(docs).collect()}
    assert [got[i][0] for i in range(1, 10)] == ["MIT", "MIT", None, None, None, None, "MIT", None, "BSD-3-Clause"]
    assert got[4][1] == "Apache-2.0" and got[8][1] == "CC-BY-NC-4.0,MIT" and got[3][1] == ""
    assert license_scan.op6(docs).count() == len(rows)
    assert license_scan.op6(docs.where("false")).collect() == []


# --- decontamination ------------------------------------------------------------


def test_leaks(spark, docs):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(4000)]
    item = lambda n: " ".join(rng.sample(vocab, n))
    items = [item(n) for n in (14, 30, 30, 59, 3, 300)]
    bench = spark.createDataFrame([*enumerate(items), (6, None), (7, ""), (8, items[0])], "item_id long, text string")
    one = items[3].split()
    one[30] = "other"
    rows = [
        (1, f"{item(50)} {items[0].upper()} {item(20)}"), (2, item(200)), (3, items[1].replace(" ", ",\n")), (4, f"{item(9)} {' '.join(one)}"),
        (5, " ".join(items[2].split()[:15]) + " " + item(40)), (6, f"pre {items[4]} post"), (7, items[5] + " " + items[5]), (8, None), (9, ""), (1, items[0]),
    ]
    mine = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id long")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.op7(mine, bench).collect())
    assert got == [(1, 0), (1, 0), (1, 8), (1, 8), (3, 1), (4, 3), (6, 4), (7, 5)]
    sliced = sorted((r["doc_id"], r["item_id"]) for r in decontamination.leaks(mine, bench, slice_bytes=300).collect())
    assert sliced == got
    clean = decontamination.decontaminated(mine, bench)
    assert clean.columns == mine.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 5, 8, 9]
    assert decontamination.op7(docs, bench.where("false")).collect() == []
    assert decontamination.op7(mine.where("false"), bench).collect() == []


def test_near_leaks_against_brute_force(spark):
    """Every document that has a window of the item's size with similarity 0.85 or more is found; none below 0.8."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    items = [rng.sample(vocab, n) for n in (20, 40, 60, 90)]
    rows, sure, never = [], set(), set()
    for i in range(200):
        j = i % 4
        rate = (0, 0.01, 0.02, 0.05, 0.2)[i % 5]
        words = [w if rng.random() > rate else rng.choice(vocab) for w in items[j]]
        pad = rng.sample(vocab, 10)
        text = pad[:5] + words + pad[5:]
        rows.append((i, " ".join(text)))
        n = len(items[j])
        want = Counter({tuple(items[j][k : k + 5]): sum(map(len, items[j][k : k + 5])) for k in range(n - 4)})
        best = 0.0
        for s in range(len(text) - n + 1):
            mine = Counter({tuple(text[s + k : s + k + 5]): sum(map(len, text[s + k : s + k + 5])) for k in range(n - 4)})
            best = max(best, sum((mine & want).values()) / sum((mine | want).values()))
        if best >= 0.85:
            sure.add((i, j))
        if best < 0.8:
            never.add((i, j))
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.op7(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert sure <= got and not never & got and len(sure) > 50 and len(never) > 20


def test_all_windows_and_short_rows_against_brute_force(spark):
    """From 0.8 on every pair is found, also in rows with fewer words than the item."""
    rng = random.Random(31)
    vocab = [f"{'x' * rng.randint(0, 9)}{i}" for i in range(3000)]
    items = [rng.sample(vocab, n) for n in (14, 20, 40, 60)]
    rows = [(0, " ".join(items[2][1:])), (1, " ".join(items[0][:-1]))]
    for i in range(2, 400):
        words = list(items[i % 4])
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        pad = rng.sample(vocab, 4) if i % 3 else []
        rows.append((i, " ".join(pad + words[rng.randint(0, 3) :])))
    weigh = lambda t: Counter({x: c * sum(map(len, x)) for x, c in Counter(tuple(t[k : k + 5]) for k in range(len(t) - 4)).items()})
    want = set()
    for i, text in rows:
        for j, item in enumerate(items):
            t, b = text.split(), weigh(item)
            for s in range(max(1, len(t) - len(item) + 1)):
                a = weigh(t[s : s + len(item)])
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    want.add((i, j))
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string")
    mine = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.op7(mine, bench).collect()} == want and {(0, 2), (1, 0)} <= want
    assert {r["doc_id"] for r in decontamination.decontaminated(mine, bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}


# --- language model -------------------------------------------------------------


@pytest.mark.parametrize("head", [0, 5, 1 << 17])
def test_op8(spark, docs, rows, head):
    texts = [[w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(r[1] or "")] for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    c, ends = Counter(), 0
    for t, h in zip(texts, held, strict=True):
        if not h:
            c.update(t)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    sp = lattice_lm._processor(lattice_lm.VOCABULARY)
    pieces = Counter()
    for w, k in c.items():
        for i in sp.encode(w):
            pieces[i] += k
    model, end = lattice_lm.lattice(pieces, ends)
    marginal = {w: model.one(w.encode()) / math.log(10) for t in texts for w in t}
    want = []
    for r, t, h in zip(rows, texts, held, strict=True):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t) + math.log10((ends + 1) / (n + v + 1))
        want.append((r[0], h, len(t) + 1, sum(c[w] > 0 for w in t) + 1, n, round(base, 6), round(sum(marginal[w] for w in t) + end, 6)))
    out = lattice_lm.scored(docs, head=head).withColumn("b", F.round("base_score", 6)).withColumn("s", F.round("score", 6))
    got = by_id(out, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "b", "s")
    for a, b in zip(got, sorted(want, key=lambda r: (r[0] is None, repr(r))), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-5)


def test_lattice_sums_all_segmentations():
    logs = {b: math.log(p) for b, p in ((b" ", 0.1), (b"a", 0.2), (b"b", 0.3), (b"ab", 0.15), (b" a", 0.05))}
    model = lattice_lm.Lattice(logs)
    want = 0.1 * 0.2 * 0.3 + 0.1 * 0.15 + 0.05 * 0.3
    assert model.log10([b"ab", b"a"])[0] == pytest.approx(math.log10(want))
    assert model.one(b"ab") == pytest.approx(math.log(want))


def test_op8_empty(no_docs):
    assert lattice_lm.op8(no_docs).collect() == []


# --- mixing ---------------------------------------------------------------------


def _targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, fixed, free = sum(sizes.values()), {}, set(order)
    while True:
        level = (total - sum(fixed.values())) / max(sum(w[s] for s in free), 1)
        over = [s for s in free if w[s] * level > 3 * sizes[s]]
        if not over:
            return {**fixed, **{s: w[s] * level for s in free}}
        for s in over:
            fixed[s] = 3 * sizes[s]
            free.discard(s)


@pytest.mark.parametrize("bucket_rows", [1, 2000])
def test_mixing(spark, docs, rows, bucket_rows):
    apply_settings(spark)
    keys = mixing.sampling_keys(docs)
    out = mixing.allot(keys, bucket_rows=bucket_rows).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = _targets(sizes)
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] >= r["epochs"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.allot(mixing.sampling_keys(docs.repartition(7))).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in again) == sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in out)


def test_mixing_without_words(spark, no_docs):
    assert mixing.op2(no_docs).collect() == []
    rows = [(1, None, "en", "a", 0, "", "", ""), (2, "", "en", None, 0, "", "", "")]
    out = mixing.op2(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in out] == [(0, 0.0, 0)] * 2


def test_better_documents_come_first_more_often(spark):
    rows = [(i, ("word " if i % 2 else "w### ") * 50, "en", "big", 0, "", "", "") for i in range(600)] + [(1000, "tiny text", "en", "z", 0, "", "", "")]
    out = mixing.mixed(spark.createDataFrame(rows, SCHEMA), weights=(1, 3)).collect()
    good = sum(r["taken"] for r in out if r["doc_id"] % 2 and r["source"] == "big")
    bad = sum(r["taken"] for r in out if not r["doc_id"] % 2 and r["source"] == "big")
    assert good >= bad


def test_trust_is_judged_over_all_words(spark):
    rng = random.Random(14)
    vocab = [f"w{i}" for i in range(5000)]
    start, unit = rng.sample(vocab, 200), rng.sample(vocab, 250)
    texts = [start, start + ["again"] * 2000, start + unit * 20, unit[:10] * 12 + rng.sample(vocab, 4000), rng.sample(vocab, 50), []]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = docs.select("doc_id", quality_rules.trusted(F.col("text"), quality_rules.word_hashes(F.col("text"))).alias("good"))
    assert dict(out.collect()) == {0: True, 1: False, 2: False, 3: True, 4: True, 5: False}


def test_licences_of_all_notices_whole_texts_and_an_own_table(spark):
    folder = Path(license_scan.__file__).parent / "licences"
    whole = {i: (name, (folder / f"{file}.txt").read_text("utf-8")) for i, (name, file) in enumerate(license_texts.WHOLE_TEXTS.items())}
    bsd = license_texts.FULL_TEXTS["BSD-3-Clause"].replace(" copyright", "\ncopyright").replace(" COPYRIGHT", "\nCOPYRIGHT")
    rows = [(i, t) for i, (_, t) in whole.items()]
    rows += [(50, "some text\nReleased under CC BY 4.0.\nmore"), (51, "a\nDistributed under the CC0 1.0.\nb"), (52, "Released under MIT."), (53, f"Copyright 2020 A. Person\n{bsd}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["line_licenses"]) for r in license_scan.scanned(docs).collect()}
    assert all(got[i][0] == name for i, (name, _) in whole.items())
    assert got[50] == (None, "CC-BY-4.0") and got[51] == (None, "CC0-1.0") and got[52] == ("MIT", "MIT") and got[53][0] == "BSD-3-Clause"
    digest = hashlib.sha256(license_scan.canonical_text("Ours alone").encode()).hexdigest()
    own = spark.createDataFrame([(digest, "Own-1.0")], "digest string, license_id string")
    mine = spark.createDataFrame([(1, "x\nOURS, alone!"), (2, "Released under MIT.")], "doc_id long, text string")
    assert by_id(license_scan.scanned(mine, own), "doc_id", "license_id", "line_licenses") == [(1, None, "Own-1.0"), (2, None, "")]


@pytest.mark.parametrize("ids", [[None] * 4, [7] * 4, [7, None, 1, 2]])
def test_samples_do_not_depend_on_how_often_an_id_repeats(spark, ids):
    """All documents under one id, or under none, still teach both models, and copies do not fill the sample."""
    texts = [f"key token=Zk{i}9fQ7xLmPw{i}Tb{i}4 and call 415-555-0{i:03d} or mail a{i}@b.org" for i in range(100)]
    rows = [(ids[i % 4], t) for i, t in enumerate(texts)] + [(ids[0], texts[0])] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = pii.fit(df, 50)
    assert got is None or got["trees"]
    seen = []
    real = pii.train
    pii.train = lambda x, y, held: seen.append(len(y)) or real(x, y, held)
    try:
        pii.fit(df, 50)
        pii.fit(df, 10**6)
    finally:
        pii.train = real
    assert 0 < seen[0] < seen[1]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(sorted({i for i in ids if i is not None}))], "doc_id long, quality int")
    assert quality_cnn.fit(df, labels)


def test_many_secrets_in_one_text_take_linear_time():
    import time

    taken, model = time.time(), {"threshold": dict.fromkeys(pii.ADDED_KINDS, 0.0)}
    real, pii.probabilities = pii.probabilities, lambda m, x: np.linspace(0, 1, len(x))
    try:
        text = " ".join(f"token=Zk{i}9fQ7xLmPw{i}Tb4" for i in range(20_000))
        spans = pii.added_spans(model, text, [])
    finally:
        pii.probabilities = real
    assert len(spans) >= 20_000 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and time.time() - taken < 60


def test_measured_replaces_columns_with_its_own_names(spark):
    df = spark.createDataFrame([(1, "a b c", 9, "x")], "doc_id long, text string, n_words int, KEPT string")
    row = quality_rules.measured(df, [0.0] * quality_rules.BUCKETS).collect()[0]
    assert row["n_words"] == 3 and row["kept"] is False


def test_licence_table_with_repeated_and_missing_digests(spark):
    digest = hashlib.sha256(license_scan.canonical_text("Our own words").encode()).hexdigest()
    table = spark.createDataFrame([(digest, "B"), (digest, "A"), (None, "C"), (digest[::-1], None)], "digest string, license_id string")
    docs = spark.createDataFrame([(1, "our OWN, words!"), (2, "Copyright 2020 x\nother"), (3, None)], "doc_id long, text string")
    got = license_scan.scanned(docs, table).orderBy("doc_id").collect()
    assert [(r["license_id"], r["n_license_lines"], r["line_licenses"]) for r in got] == [("A", 1, "A"), (None, 0, ""), (None, 0, "")]
    assert [r["license_id"] for r in license_scan.scanned(docs, table.where("false")).collect()] == [None] * 3


def test_too_many_licences_are_refused(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "MOST", 2)
    table = spark.createDataFrame([(str(i), "A") for i in range(3)], "digest string, license_id string")
    with pytest.raises(ValueError):
        license_scan.scanned(spark.createDataFrame([(1, "x")], "doc_id long, text string"), table)


@pytest.mark.parametrize("n_keys", [1, 40, 5000])
def test_values_within_the_radius_are_all_found(n_keys):
    rng = np.random.default_rng(n_keys)
    keys = np.unique(rng.integers(0, 1 << 16, n_keys).astype(np.uint64))
    values = np.unique(rng.integers(0, 1 << 16, 1500).astype(np.uint64))
    v, k = decontamination._close_values(values, keys)
    want = np.argwhere(np.bitwise_count(values[:, None] ^ keys[None]) <= decontamination.BLOCK_RADIUS)
    assert sorted(zip(v.tolist(), k.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_index_of_many_items_stays_small():
    rng = random.Random(3)
    texts = [" ".join(str(rng.random())[2:9] for _ in range(13)) for _ in range(4000)]
    index = decontamination.Index(list(range(4000)), texts)
    assert len(pickle.dumps(index)) < 20 * sum(map(len, texts))
    assert [j for _, j, *_ in index.matches(pa.array(texts[:50]))] == list(range(50))
