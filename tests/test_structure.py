import bisect
import random
import re

from pyspark.sql import functions as F

from lexloom.functions import constants as K
from lexloom.functions.blocked import asof_join, carry, dense_index, running_sum
from lexloom.operators import hierarchy as H
from lexloom.operators import structure as L

TEXT = (
    "Preamble\nPART I General\nCHAPTER II\nOF THINGS\n\n1. Short title and extent.\nThis Act may be called é thing.\n"
    "2. Definitions –\n\nIn this Act, (a) foo.\nCHAPTER III: Other matters\n3. What are not inventions.\n\nBody.\n"
    "Rule 7. Do it\nRegulation 8\n\nNext title\nArticle 14A: Equality\n3. Repeated heading here.\ntail\n"
)


def test_plain_patterns_match_finditer(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    got = {(r.label, r.start_char, r.end_char, r.g1, r.g2) for r in L.find_spans(docs, L._plain_patterns()).collect()}
    want = set()
    for t, p in K.PLAIN_PATTERNS:
        flags = re.M if t == "section" else re.I | re.M
        want |= {(t, m.start(), m.end(), m.group(1), m.group(2)) for m in re.finditer(p, TEXT, flags)}
    assert got == want and len(want) >= 8


def test_legacy_sections_take_the_chapter_before(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    got = [(r.section_number, r.start_char, r.end_char, r.chapter_ref) for r in L.detect_sections_legacy(docs).orderBy("start_char").collect()]
    chap = {m.group(1): m for m in re.finditer(K.LEGACY_CHAPTER, TEXT)}
    sec = {m.group(1): m for m in re.finditer(K.LEGACY_SECTION, TEXT)}
    ms = sorted(sec.values(), key=lambda m: m.start())
    want = []
    for i, m in enumerate(ms):
        before = [c for c in sorted(chap.values(), key=lambda c: c.start()) if c.start() <= m.start()]
        label = f"{before[-1].group(1).strip()}: {before[-1].group(2).strip()}" if before else None
        want.append((m.group(1), m.start(), ms[i + 1].start() if i + 1 < len(ms) else len(TEXT), label))
    assert got == want and want


def test_heading_block_scores_and_slices(spark):
    text = "".join(f"\n<<<HEADING>>>{h}<<<END_HEADING>>>\nbody of {h} here\n" for h in
                   ("CHAPTER I INTRO", "1. First title.", "2. Second title", "CHAPTER II", "Rule 5: x"))
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string")
    c = L.detect_candidates(docs)
    rows = c.orderBy("start_char").collect()
    assert [(r.node_type, r.number, r.title) for r in rows] == [
        ("chapter", "I", "INTRO"), ("section", "1", "First title"), ("section", "2", "Second title"),
        ("chapter", "II", None), ("rule", "5", "x")]
    assert [round(r.confidence, 2) for r in rows] == [0.8, 0.8, 1.0, 0.8, 0.8]
    cut = H.slice_text(c, docs).orderBy("start_char").collect()
    assert "".join(r.original_text for r in cut) == text[rows[0].start_char:]
    assert cut[1].text == "1. First title.\nbody of 1. First title. here"
    small = L.slice_spans(c, docs, "t", size=7).orderBy("start_char").collect()
    assert [r.t for r in small] == [r.original_text for r in cut]


def test_validation_normalises_and_rejects(spark):
    text = "ﬁrst line of text\nmore words"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = [(1, "section", "1", "t", 0, 17, 0.9), (1, "section", "2", "t", 18, 22, 0.9), (1, "section", "3", "repealed", 18, 28, 0.5),
            (1, "rule", "4", "t", 0, 28, 0.5)]
    c = spark.createDataFrame(rows, "doc_id long, node_type string, number string, title string, start_char long, end_char long, confidence double")
    got = {r.number: r.outcome for r in L.validate(c, docs).collect()}
    assert got == {"1": "accepted", "2": "too_short", "3": "accepted", "4": "low_confidence"}


def _stack(nodes):
    out, stack = [], []
    for ix, (kind, number, title, hint) in enumerate(nodes):
        rank = K.NODE_RANK.get(kind, K.DEFAULT_RANK)
        prefix = None
        if number:
            m = re.match(r"^(\d+[A-Z]?)\(", number) or re.match(r"^(\d+)\.\d", number)
            prefix = m.group(1) if m else None
        parent = next((a for a in reversed(stack) if prefix and a[2] == prefix), None)
        parent = parent or next((a for a in reversed(stack) if a[1] < rank), None)
        if parent is None and hint:
            parent = next((a for a in reversed(stack) if (a[3] and hint.upper() in a[3].upper()) or (a[2] and hint.upper() in a[2].upper())), None)
        out.append(parent[0] if parent else None)
        while stack and stack[-1][1] >= rank:
            stack.pop()
        stack.append((ix, rank, number, title))
    return out


def test_hierarchy_equals_a_stack(spark):
    rnd = random.Random(3)
    kinds = list(K.NODE_RANK) + ["odd"]
    rows, want = [], {}
    for doc in range(40):
        nodes = []
        for i in range(30):
            number = rnd.choice([None, str(rnd.randint(1, 5)), f"{rnd.randint(1, 5)}(a)", f"{rnd.randint(1, 5)}.1", f"{rnd.randint(1, 3)}A(b)"])
            nodes.append((rnd.choice(kinds), number, rnd.choice([None, "CHAPTER II x", "y"]), rnd.choice([None, None, "chapter ii", "3"])))
        for i, p in enumerate(_stack(nodes)):
            want[(doc, i)] = p
        rows += [(doc, k, n, t, i, i + 1, h) for i, (k, n, t, h) in enumerate(nodes)]
    c = spark.createDataFrame(rows, "doc_id long, node_type string, number string, title string, start_char long, end_char long, parent_hint string")
    tree = H.build_hierarchy(c)
    got = {(r.doc_id, r.node_ix): r.parent_ix for r in tree.collect()}
    assert got == want
    paths = {(r.doc_id, r.node_ix): [s.ix for s in r.path] for r in H.tree_paths(tree, levels=32).collect()}
    for (doc, ix), parent in want.items():
        assert paths[(doc, ix)] == (paths[(doc, parent)] if parent is not None else []) + [ix]


def test_blocked_windows_equal_plain_ones(spark):
    rnd = random.Random(1)
    rows = [(k, p, rnd.choice([None, rnd.randint(0, 9)])) for k in range(3) for p in rnd.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "k long, p long, v long")
    for after in (False, True):
        for inclusive in (False, True):
            a = carry(df, ["k"], "p", {"o": F.col("v")}, after=after, inclusive=inclusive)
            b = carry(df, ["k"], "p", {"o": F.col("v")}, after=after, inclusive=inclusive, block=7)
            assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    for fn in (lambda bl: running_sum(df, ["k"], "p", F.coalesce("v", F.lit(0)), "o", block=bl), lambda bl: dense_index(df, ["k"], "p", "o", block=bl)):
        assert sorted(map(tuple, fn(None).collect()), key=str) == sorted(map(tuple, fn(7).collect()), key=str)


def test_asof_join_equals_bisect(spark):
    pages = sorted(random.Random(2).sample(range(100), 12))
    ev = spark.createDataFrame([(1, p, f"L{p}") for p in pages], "doc_id long, page long, label string")
    pr = spark.createDataFrame([(1, q) for q in range(110)], "doc_id long, q long")
    for block in (None, 8):
        got = {r.q: r.label for r in asof_join(pr, ev, ["doc_id"], "q", "page", ["label"], block=block).collect()}
        for q in range(110):
            i = bisect.bisect_right(pages, q) - 1
            assert got[q] == (f"L{pages[i]}" if i >= 0 else None)


def test_heads_are_looked_up_by_one_scan():
    rnd = random.Random(3)
    for _ in range(200):
        source = "".join(rnd.choices("ab ", k=rnd.randrange(60)))
        heads = ["".join(rnd.choices("ab ", k=rnd.randrange(1, 7))) for _ in range(12)]
        assert L.heads_found(heads, source, near=rnd.choice((0, 2, 50))) == [h in source for h in heads]


def test_validate_against_another_source(spark):
    text = "1. Scope\nThis Act applies to all drugs.\n2. Terms\nA \ufb01ne  word\u00a0here is long.\n3. End\nOmitted.\n"
    docs = spark.createDataFrame([("d", text), ("n", None)], "doc_id string, text string")
    spans = [("d", 0, 39, 0.9, "Scope"), ("d", 39, 75, 0.9, "Terms"), ("d", 75, 91, 0.5, "End"), ("d", 39, 45, 0.9, "x"), ("d", 0, 39, 0.5, None),
             ("d", None, 4, 0.9, "t"), ("n", 0, 5, 0.9, "t")]
    cands = spark.createDataFrame(spans, "doc_id string, start_char int, end_char int, confidence double, title string")

    def told(source=None):
        got = L.validate(cands, docs, source).collect()
        return sorted(((r.doc_id, -1 if r.start_char is None else r.start_char, r.confidence, r.title or "", r.outcome) for r in got))

    want = {("d", 0, 0.5, "", "low_confidence"), ("d", 39, 0.9, "x", "too_short"), ("d", -1, 0.9, "t", "not_in_source"), ("n", 0, 0.9, "t", "not_in_source")}
    every = want | {("d", 0, 0.9, "Scope", "accepted"), ("d", 39, 0.9, "Terms", "accepted"), ("d", 75, 0.5, "End", "accepted")}
    assert set(told()) == every
    other = spark.createDataFrame([("d", "2.   Terms A fine word here is long. 3. End Omitted.")], "doc_id string, text string")
    assert set(told(other)) == {(*r[:4], "not_in_source") if r[3] == "Scope" else r for r in every}
