import re
import shutil
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tidewatch.llm import exact_dedup, langid, quality, stages, warc  # noqa: E402
from tidewatch.llm.components import Forest  # noqa: E402

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, tw_id string, keep_id string, score string, kept string, part int"


def rows(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s", None, "a", "b", "c", "d", 1) for i, t in texts], DOCUMENTS)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda i: (i is None, i))


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def near_copies(documents):
    """Ids that go: all but the smallest of each group that links of 0.8 or more make, by comparing all pairs."""
    documents = sorted(documents)
    sets, forest = [shingles(t) for _, t in documents], Forest(len(documents))
    for j, b in enumerate(sets):
        for i in range(j):
            a = sets[i]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                forest.join(i, j)
    return {documents[i][0] for i in range(len(documents)) if forest.root(i) != i}


def test_run_equals_brute_force(spark, tmp_path):
    for name in ("documents", "labels"):
        shutil.copy(f"/root/testdata/sf0.01/{name}.parquet", tmp_path)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    learn = ~langid.held_out()
    net = quality.fit(docs.where(learn), labels.where(learn))
    kept = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    kept = [r for r in kept if net.chance(np.array([quality.measures(r[1] or "")]))[0] >= quality.THRESHOLD]
    told = spark.createDataFrame(kept, "doc_id long, text string, lang string, source string")
    scorer = langid.Scorer(langid.fit(told.where(learn), langid.default_vocabulary()))
    kept = [r for r, (lang, chance) in zip(kept, scorer.scores([r[1] or "" for r in kept]), strict=True) if lang != "und" and chance >= stages.SURE]
    first = {}
    for r in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    kept = [*first.values()]
    gone = near_copies([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if r[0] not in gone]
    assert len(gone) >= 3 and len(kept) > 300
    words, load, sources = Counter(), Counter(), set()
    source = {r[0]: r[3] for r in kept}
    for r in sorted(found, key=lambda r: (r.bin_id, r.bin_offset)):
        words[r.doc_id] += r.n_words
        assert r.bin_offset == load[r.bin_id]
        load[r.bin_id] += r.n_words
        assert source[r.doc_id] is None or (r.bin_id, source[r.doc_id]) not in sources
        sources.add((r.bin_id, source[r.doc_id]))
    assert dict(words) == {r[0]: len((r[1] or "").encode().split()) for r in kept} and max(load.values()) <= 2048
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "exact_dedup", "near_dedup", "packing"]


def test_exact_stage_leaves_one_row_of_each_text(spark):
    table = rows(spark, (1, "same text"), (1, "same text"), (2, "same  text"), (3, None), (3, ""), (None, "same\ttext"), (None, "other"), (None, "other"), (5, "é" * 50_000), (6, "é" * 50_000), (7, "alone"))
    out = stages.drop_copies(spark, table, "")
    assert out.columns == table.columns and ids(out) == [1, 3, 5, 7, None]
    assert stages.drop_copies(spark, table.limit(0), "").count() == 0
    hot = rows(spark, *((i, "hot") for i in range(300)), *((0, "hot") for _ in range(300)))
    assert ids(stages.drop_copies(spark, hot, "")) == [0]
    marked = exact_dedup.exact_dedup(table)
    assert Counter(r.text_sha256 for r in marked.collect() if r.kept).most_common(1)[0][1] == 1


def test_near_stage_leaves_one_row_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(60))
    table = rows(spark, (1, base), (1, base), (2, base + " x"), (2, base + " y"), (None, base + " z"), (4, "a b c"), (5, None), (5, None), (6, ""), (7, "a b c d e f g " * 3000), (8, "A b c"))
    out = stages.drop_near_copies(spark, table, "")
    assert out.columns == table.columns and ids(out) == [1, 4, 5, 6, 7]
    assert stages.drop_near_copies(spark, table.limit(0), "").count() == 0


def test_learning_stages_on_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = rows(spark, (1, "the cat"), (1, "the cat"), (None, None), (2, ""), (3, "123"))
    assert stages.keep_good(spark, table, str(tmp_path)).columns == table.columns
    assert stages.keep_good(spark, table.limit(0), str(tmp_path)).count() == 0
    assert ids(stages.keep_known_language(spark, table, "")) == [1, 1] and stages.keep_known_language(spark, table.limit(0), "").count() == 0
    assert stages.pack_documents(spark, table, "").count() == 5 and stages.pack_documents(spark, table.limit(0), "").count() == 0


def test_warc_of_repeated_ids_bytes_and_other_records(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "aa", "x"), (1, "v", "bbbb", "x"), (2, "w", "bbbb", "x"), (3, None, "aa", "x"), (3, None, "aa", "x")], "page_id long, url string, html string, size string")
    path = str(tmp_path / "a")
    warc.write(warc.resolve(table), path)
    found = warc.with_originals(warc.read(spark, path, payloads=False), ["payload_bytes"]).select("id", "payload_bytes", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, 2, "response", None), (1, 4, "response", None), (2, 4, "revisit", 1), (3, 2, "revisit", 1), (3, 2, "revisit", 1)], key=str)
    # payloads that are no text, through deduplicate
    raw = spark.createDataFrame([(1, "u", bytearray(b"\xff\xfe\r\n\r\n\x00")), (2, "u", bytearray(b"\xff\xfe\r\n\r\n\x00")), (3, "u", bytearray(b"\x80" * 70_000)), (4, "u", None)], "page_id long, url string, html binary")
    first, second = str(tmp_path / "b"), str(tmp_path / "c")
    warc.write(warc.resolve(raw), first)
    warc.deduplicate(spark, first, second)
    records = {r.id: r for r in warc.with_originals(warc.read(spark, second), ["payload", "payload_bytes"]).collect()}
    assert {i: bytes(r.payload) for i, r in records.items()} == {1: b"\xff\xfe\r\n\r\n\x00", 2: b"\xff\xfe\r\n\r\n\x00", 3: b"\x80" * 70_000, 4: b""}
    assert records[2].record_type == "revisit" and records[2].refers_to == 1
    # records of other kinds and without a digest
    v = warc.VERSION.removesuffix("\r\n")
    block = "HTTP/1.1 200 OK\r\n\r\nhi"
    archive = f"{v}\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\na\nb\r\n\r\n{v}\r\nwarc-type: response\r\nContent-Type: application/http; msgtype=response\r\nWARC-Record-ID: <urn:uuid:x>\r\nWARC-Target-URI: http://a/b:c\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n{v}\r\nWARC-Type: request\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.warc").write_bytes(archive.encode())
    one = warc.read(spark, str(tmp_path / "d"), id_type="string").collect()
    assert [(r.id, r.url, r.record_type, r.payload_bytes, bytes(r.payload)) for r in one] == [("urn:uuid:x", "http://a/b:c", "response", 2, b"hi")]
    warc.write(warc.resolve(table.limit(0)), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_learning_stages_hand_a_text_over_once(spark):
    docs = spark.createDataFrame([("a", 1, 0.5)], "text string, doc_id long, score double")
    given = stages._apart(docs)
    assert given.columns == ["tw_rest", "text"] and given.schema["tw_rest"].dataType.names == ["doc_id", "score"]
    assert stages._put_back(given.selectExpr("*", "1.0 as score"), docs.columns).collect() == docs.collect()
