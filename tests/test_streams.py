
from lexloom.sources import manifest as M
from lexloom.sources import memory, store
from lexloom.streaming.ingest_stream import Ingestion, ingest_stream, latest_points
from lexloom.streaming.turn_log import turn_log


def _manifest(spark, ids):
    raw = spark.createDataFrame([(i, f"Title {i}", "col") for i in ids], "source_id_external string, title string, collection_name string")
    return M.typed_manifest(raw)


def test_ingest_stream_adds_new_files_once(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    src.mkdir()
    (src / "A-1.txt").write_text("alpha text. " * 200)
    m = _manifest(spark, ["A-1", "A-2"])
    ingest_stream(spark, str(src), m, out, cp).awaitTermination()
    first = {r.chunk_id: r.point_id for r in latest_points(spark, out).collect()}
    assert first and all(c.startswith("A-1_Secsec_0_c") for c in first)
    (src / "A-2.txt").write_text("beta text. " * 50)
    (src / "sub").mkdir()
    ingest_stream(spark, str(src), m, out, cp).awaitTermination()
    rows = latest_points(spark, out).collect()
    assert {r.source_id for r in rows} == {"A-1", "A-2"} and len({r.point_id for r in rows}) == len(rows)
    assert {r.chunk_id: r.point_id for r in rows if r.source_id == "A-1"} == first


def test_names_and_versions_of_files(spark, tmp_path):
    """Blanks and plus signs, one name in two folders, a repeated batch, and a changed file."""
    src, out = tmp_path / "in put", str(tmp_path / "store")
    for folder in ("x", "y"):
        (src / folder).mkdir(parents=True)
        (src / folder / "same.txt").write_text(f"text of {folder}. " * 30)
    (src / "a+b.txt").write_text("plus. " * 30)
    (src / "a b.txt").write_text("blank. " * 300)
    names = ["x/same", "y/same", "a+b", "a b"]
    m = _manifest(spark, names)
    ingest_stream(spark, str(src), m, out, str(tmp_path / "cp")).awaitTermination()
    first = {r.point_id: r.source_id for r in latest_points(spark, out).collect()}
    assert set(first.values()) == set(names)
    again = spark.createDataFrame([("a b", "changed. " * 10, "2030-01-01 00:00:00"), ("a b", "older. ", "2029-01-01 00:00:00")], "doc_id string, text string, modified string")
    kept = Ingestion(spark, m, out)
    kept(again, 7)  # known already: skipped
    assert {r.point_id for r in kept.chunks().collect()} == set(first)
    new = Ingestion(spark, m, out, replace=True)
    for _ in range(2):  # the same batch twice
        new(again, 8)
    now = new.chunks().collect()
    text = {r.source_id: r.page_content for r in now if r.source_id == "a b"}
    assert len(text) == 1 and "changed." in text["a b"] and sum(r.source_id == "a b" for r in now) == 1
    assert {r.point_id for r in now if r.source_id != "a b"} == {p for p, i in first.items() if i != "a b"}


def test_store_writes_its_own_rows_and_survives_crashes(spark, tmp_path, monkeypatch):
    s = store.ChunkStore(spark, str(tmp_path / "s"))
    frame = lambda rows: spark.createDataFrame([(p, "src", "col", v) for p, v in rows], "point_id string, source_id string, collection_name string, v long")
    assert s.read() is None and s.newest() is None
    s.append(frame([("a", 1), ("b", 1), ("c", 1)]), 0)
    s.append(frame([("b", 2), ("d", 2)]), 1)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "s" / "rows" / "ingest_batch=0").iterdir()}
    s.append(frame([("d", 3)]), 2)
    s.append(frame([("d", 3)]), 2)
    assert files == {f: f.stat().st_mtime_ns for f in (tmp_path / "s" / "rows" / "ingest_batch=0").iterdir()}
    want = {"a": 1, "b": 2, "c": 1, "d": 3}
    now = lambda: {r.point_id: r.v for r in s.read().collect()}
    assert now() == want and s.read().count() == 4
    frame([("a", 99)]).write.parquet(str(tmp_path / "s" / "rows" / "ingest_batch=6"))  # rows without their index
    assert now() == want
    with monkeypatch.context() as m:
        m.setattr(s, "_drop", lambda *a: None)  # a crash before the old batches go
        s.compact()
        assert now() == want and s.read().count() == 4
    s.compact()
    s.append(frame([("a", 5)]), 3)
    s.compact()
    assert s.committed() == [7] and now() == want | {"a": 5}


def test_turn_log_drops_repeats(spark, tmp_path):
    rows = [("s", 1, "2024-01-01 00:00:00", "a"), ("s", 1, "2024-01-01 00:00:01", "a"), ("s", 2, "2024-01-01 00:00:02", "b")]
    spark.createDataFrame(rows, "session_id string, turn_index long, ts string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, turn_index long, ts string, text string").parquet(str(tmp_path / "in"))
    q = (turn_log(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
         .option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.turn_index for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_readers(spark, tmp_path):
    d = tmp_path / "data" / "abs"
    d.mkdir(parents=True)
    (d / "X.pdf").write_bytes(b"pdf")
    (tmp_path / "t.txt").write_text("one\ntwo")
    listing = M.file_listing(spark, str(tmp_path), str(tmp_path))
    assert "data/abs/X.pdf" in {r.file for r in listing.collect()}
    m = spark.createDataFrame([("X", "pdfs/none.pdf")], "source_id string, path string")
    assert M.resolve_paths(m, listing).first().resolved_path == "data/abs/X.pdf"
    assert M.read_text_docs(spark, str(tmp_path / "t.txt")).first().text == "one\ntwo"


def test_upsert_and_memory(spark):
    old = store.unique_ids(spark.createDataFrame([("a", 0, 1), ("a", 1, 2)], "chunk_id string, position long, v long"))
    assert sorted(r.chunk_id for r in old.collect()) == ["a", "a_dup1"]
    new = store.write_chunks(spark.createDataFrame([("a", 0, 9)], "chunk_id string, position long, v long"), old)
    assert {r.chunk_id: r.v for r in new.collect()} == {"a": 9, "a_dup1": 2}
    turns = spark.createDataFrame([("s", 1), ("s", 2)], "session_id string, turn_index int")
    fresh = spark.createDataFrame([("s", 10), ("s", 5), ("t", 7)], "session_id string, ts long")
    got = {(r.session_id, r.ts): r.turn_index for r in memory.append_turn(turns, fresh, block=3).collect()}
    assert got == {("s", 5): 3, ("s", 10): 4, ("t", 7): 1}
    f = spark.createDataFrame([("s", {"a": "1", "b": "1"}, 1)], "session_id string, facts map<string,string>, seq long")
    g = spark.createDataFrame([("s", {"b": "2"}, 2)], "session_id string, facts map<string,string>, seq long")
    assert memory.save_facts(f, g).first().facts == {"a": "1", "b": "2"}
    assert memory.clear_session(turns, spark.createDataFrame([("s",)], "session_id string")).count() == 0


def test_a_batch_is_written_without_a_copy(spark, tmp_path, monkeypatch):
    def copied(df):
        raise AssertionError("the chunks were written twice")

    once = _manifest(spark, ["a", "b"])
    twice = once.unionByName(once.where("source_id = 'b'"))
    docs = spark.createDataFrame([("a", "old text", 1), ("a", "new text", 2), ("b", "one", 5), ("b", "one", 5), ("c", "word " * 300, 1)], "doc_id string, text string, modified long")
    for name, manifest in (("once", once), ("twice", twice)):
        load = Ingestion(spark, manifest, str(tmp_path / name))
        with monkeypatch.context() as m:
            if name == "once":
                m.setattr("lexloom.streaming.ingest_stream.checkpointed", copied)
            load(docs, 0)
        found = load.chunks().collect()
        texts = sorted((r.source_id, r.split_text) for r in found if r.source_id != "c")
        assert ("a", "new text") in texts and ("a", "old text") not in texts
        assert len({r.point_id for r in found}) == len(found) and len({r.chunk_id for r in found}) == len(found)
        assert name == "twice" or texts == [("a", "new text"), ("b", "one")]
