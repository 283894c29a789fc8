import random

from pyspark.sql import functions as F

from lexloom.operators import chunking as C


def _pack(text, size):
    if len(text) <= size:
        return [(text, False)]
    out, cur, n = [], [], 0
    for para in (p.strip() for p in text.split("\n\n")):
        if not para:
            continue
        if len(para) > size:
            if cur:
                out.append(("\n\n".join(cur), False))
                cur, n = [], 0
            out.append((para, True))
        elif n + len(para) + 2 > size and cur:
            out.append(("\n\n".join(cur), False))
            cur, n = [para], len(para)
        else:
            cur.append(para)
            n += len(para) + 2
    if cur:
        out.append(("\n\n".join(cur), False))
    return out or [(text, False)]


def test_pack_paragraphs_equals_loop(spark):
    rnd = random.Random(5)
    texts = ["\n\n".join("w" * rnd.randint(0, 60) for _ in range(rnd.randint(1, 12))) for _ in range(80)] + ["", "\n\n" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in df.select("i", "t", C.pack_paragraphs(F.col("t"), 50).alias("p")).collect():
        assert [(x.text, x.oversize) for x in r.p] == _pack(r.t, 50)


def test_windows_cover_the_text_and_keep_the_size():
    rnd = random.Random(6)
    words = ["lorem", "ipsum;", "dolor.", "(a)", "sit\n"]
    text = " ".join(rnd.choice(words) for _ in range(400))
    got = list(C._split(text, 100, 20, ["\n\n", "\n", ";", r"\.", " "]))
    assert max(map(len, got)) <= 100
    at = 0
    for w in got:  # windows follow each other and leave no gap
        pos = text.find(w, max(0, at - 100))
        assert 0 <= pos <= at
        at = pos + len(w)
    assert at == len(text)
    # the default "." matches any character, so texts without spaces fall into fixed windows
    fixed = list(C._split("x" * 250, 100, 20, ["\n\n", ".", " "]))
    assert [len(w) for w in fixed] == [100, 100, 90]


def test_split_nodes_numbers_chunks(spark):
    text = "short one\n\n" + "y" * 130 + "\n\nlast one"
    df = spark.createDataFrame([(1, 0, "section", "3", text, "S"), (1, 1, "rule", None, "tiny", "S")],
                               "doc_id long, node_ix long, node_type string, number string, text string, source_id string")
    out = C.number_chunks(C.split_nodes(df.withColumn("chunkable_ix", F.col("node_ix")), size=60, overlap=10)).orderBy("node_ix", "chunk_index").collect()
    assert [r.chunk_id for r in out] == ["S_section_3_c0", "S_section_3_c1", "S_section_3_c2", "S_section_3_c3", "S_section_3_c4", "S_rule_1_c0"]
    assert out[0].split_text == "short one" and out[4].split_text == "last one"
    assert {r.total_chunks_in_section for r in out if r.node_ix == 0} == {5}


def test_context_is_generated_once_per_key(spark):
    rows = [(1, "p", "t", "fb1"), (2, " p ", "t ", "fb1"), (3, "p", "u", "fb2")]
    chunks = spark.createDataFrame(rows, "i long, parent_context string, split_text string, fallback_context string")
    empty = spark.createDataFrame([], "key string, context string")
    seen = []

    def generator(df):
        seen.append(df.count())
        return df.select("key", F.when(F.contains("prompt", F.lit("u")), F.lit("made")).alias("context"))

    found, fresh = C.context_lookup(chunks, empty, generator)
    assert seen == [2] and fresh.count() == 2
    again, none = C.context_lookup(chunks, fresh, generator)
    assert none.count() == 0 and {r.i: r.generated_context for r in again.collect()} == {r.i: r.generated_context for r in found.collect()}
