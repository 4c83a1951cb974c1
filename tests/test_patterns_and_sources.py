import os

import pytest
from pyspark.sql import functions as F

from seqloom.operators import graph as K
from seqloom.operators import notes as N
from seqloom.operators import patterns as P
from seqloom.operators import projection as R
from seqloom.sources import files, jams, sinks

FIX = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")


@pytest.fixture(scope="module")
def bricks(spark):
    return P.parse_grammar(files.read_grammar(spark, f"{FIX}/bricks.txt")).cache()


def test_grammar(bricks):
    rows = {(r["name"], r.variant): r for r in bricks.collect()}
    assert set(rows) == {("Turn", "short"), ("Turn", "long"), ("Close", None), ("Song", None)}
    song = rows["Song", None]
    assert (song.mode, song.block_type, song.block_key) == ("Major", "Form", "C")
    assert [tuple(c) for c in song.components] == [("chord", None, "C", "4"), ("brick", "Turn", "C", "2"), ("brick", "Turn", "C", "2")]
    assert tuple(rows["Close", None].components[0]) == ("chord", None, "C(add9)", "2")


def test_expansion(bricks):
    got = {(r["name"], ",".join(r.choices)): [c.value for c in r.components] for r in P.expand_bricks(bricks).collect()}
    short, long = ["Dm7", "G7"], ["Am7", "C(add9)"]
    assert {k: v for k, v in got.items() if k[0] == "Song"} == {
        ("Song", "Turn/short,Turn/short"): ["C", *short, *short],
        ("Song", "Turn/short,Turn/long,Close/"): ["C", *short, *long],
        ("Song", "Turn/long,Close/,Turn/short"): ["C", *long, *short],
        ("Song", "Turn/long,Close/,Turn/long,Close/"): ["C", *long, *long]}
    assert len(got) == 4 + 2 + 1


def test_cycle(spark):
    loop = spark.createDataFrame([("A", None, [("brick", "B", "C", "1")]), ("B", None, [("brick", "A", "C", "1")])],
                                 f"name string, variant string, components array<{P.COMPONENT}>")
    with pytest.raises(Exception, match="cycle"):
        P.expand_bricks(loop)


def test_known_series(spark):
    rows = spark.createDataFrame([
        ("x", 0, "D:min", "1", "C"), ("x", 1, "G:maj", "*", "C"), ("x", 2, "C:maj", "2", "C"), ("one", 0, "C:maj", "4", "C")],
        "label string, ord int, chord string, duration string, key string")
    seq = P.known_sequences(rows)
    assert [tuple(r) for r in P.known_series(seq, "profile").collect()] == [("x", 3, [8, 5, 0, 0])]
    assert P.known_series(seq, "offset").first().ts[0] == 8


def test_coverage(spark):
    known = spark.createDataFrame([("k1", 2, [0, 5, 5]), ("k2", 2, [9, 0, 9]), ("k3", 3, [7, 7, 1])], "label string, n_chords int, ts array<int>")
    segs = spark.createDataFrame([(1, [0, 0, 5, 5]), (2, [7, 1, 1])], "id int, ts array<int>")
    rows = {r.n_chords: r for r in P.coverage(segs, known).collect()}
    assert (rows[2].n_patterns, rows[2].n_covered, rows[2].coverage) == (2, 1, 0.5)
    assert (rows[3].n_covered, rows[3].coverage) == (1, 1.0)


@pytest.fixture(scope="module")
def docs(spark):
    return jams.read_documents(spark, f"{FIX}/docs/*.json").cache()


def test_documents(docs):
    rows = {r.track: r for r in docs.collect()}
    assert rows["a_1"].title == "A first one" and rows["a_1"].artists == ["X", "Y"] and rows["a_1"].genre == "jazz"
    assert rows["a_2"].artists == ["Z"] and rows["a_2"].genre is None
    assert rows["broken"]._corrupt_record is not None and rows["broken"].title is None


def test_selection_and_metadata(spark, docs):
    picked = jams.select_documents(docs, files.read_selection(spark, f"{FIX}/selection.txt"))
    assert [r.track for r in picked.collect()] == ["a_1"]
    meta = files.read_metadata(spark, f"{FIX}/meta.csv")
    rows = {r.track: r for r in files.with_metadata(docs.select("track"), meta).collect()}
    assert rows["a_1"].genre == "jazz" and rows["a_2"].artist is None and rows["broken"].title is None
    with pytest.raises(Exception, match="no metadata for broken"):
        files.with_metadata(docs.select("track"), meta, strict=True).collect()


def test_progressions(docs):
    with pytest.warns(UserWarning, match="1 documents could not be read"):
        seq = jams.progressions(docs)
    rows = seq.df.orderBy("track", "pos").collect()
    assert [(r.track, r.pos, r.chord, r.key) for r in rows] == [
        ("a_1", 0, "N", "C:major"), ("a_1", 1, "C:maj", "C:major"), ("a_1", 2, "G:7", "Am"), ("a_1", 3, "A:min", "Am"),
        ("a_1", 4, "C:maj", "Am"), ("a_2", 0, "D:min", "N")]
    events = seq.df.withColumn("v", R.profile_value())
    spans = R.spans(events, "track", ("v",))
    # G:7 at 2.4 and A:min at 2.45 share a tick: the earlier lasts none
    assert [(r.chord, r.t0, r.t1) for r in spans.filter("track = 'a_1'").orderBy("t0").collect()] == [
        ("N", 0, 1), ("C:maj", 1, 2), ("A:min", 2, 4), ("C:maj", 4, 9)]


def test_series_of_documents(docs):
    events = jams.progressions(docs).df.withColumn("v", R.profile_value())
    ticks = R.ticks(R.spans(events, "track", ("v",))).groupBy("track").count()
    # a_1 lasts from 0 to 9 seconds, a_2 from 0.5 to 2: onsets and ends round half up
    assert {r.track: r["count"] for r in ticks.collect()} == {"a_1": 9, "a_2": 1}


def test_unwrap(docs):
    rows = {r.record: r for r in jams.unwrap_annotations(docs).collect()}
    assert set(rows) == {"a_1_0", "a_1_2", "a_2_0"}
    assert rows["a_1_2"].keys[0].value == "C:major" and rows["a_2_0"]["keys"] is None


def test_spans_from_onsets(docs):
    rows = jams.spans_from_onsets(jams.observations(docs, jams.CHORD_NAMESPACES)).orderBy("track", "ord").collect()
    assert [r.t_end for r in rows] == [1.0, 2.4, 2.45, 4.0, 9.0, 2.0]


def test_files(spark):
    rows = {r.name: r for r in files.list_files(spark, f"{FIX}/docs").collect()}
    assert rows["a_1.json"].stem == "a_1" and rows["a_1.json"].n_bytes > 100


def test_roundtrips(spark, bricks, tmp_path):
    sinks.write_bricks(bricks, str(tmp_path / "b"))
    assert files.read_bricks(spark, str(tmp_path / "b")).count() == 4
    edges = spark.createDataFrame([(1, 2, 0.5, "sim")], "source long, target long, distance double, type string")
    sinks.write_edges(edges, str(tmp_path / "e"))
    assert [tuple(r) for r in files.read_edges(spark, str(tmp_path / "e")).collect()] == [(1, 2, 0.5, "sim")]
    segs = spark.createDataFrame([("uniform", "n%3", "a", 0)], "method string, params string, track string, seg_ord int")
    sinks.write_segments(segs, str(tmp_path / "s"), "method", "params")
    assert os.path.isdir(tmp_path / "s" / "method=uniform")
    sinks.write_table(segs, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_ntriples(spark, tmp_path):
    t = spark.createDataFrame([
        ("urn:seqloom:track/1", "type", "MusicalWork", "uri"), ("urn:seqloom:track/1", "hasTitle", 'a "b"\\', "string"),
        ("urn:seqloom:segment/1$C D", "hasOrder", "0", "integer"), ("urn:seqloom:pattern/1", "label", "0_1", "string"),
        ("urn:seqloom:track/1", "containsSegment", "urn:seqloom:segment/1$C D", "uri")], "s string, p string, o string, dtype string")
    sinks.write_ntriples(t, str(tmp_path / "nt"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "nt")).collect()}
    xsd = "http://www.w3.org/2001/XMLSchema#"
    assert lines == {
        "<urn:seqloom:track/1> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:seqloom:class/MusicalWork> .",
        f'<urn:seqloom:track/1> <urn:seqloom:hasTitle> "a \\"b\\"\\\\"^^<{xsd}string> .',
        f'<urn:seqloom:segment/1$C%20D> <urn:seqloom:hasOrder> "0"^^<{xsd}integer> .',
        f'<urn:seqloom:pattern/1> <http://www.w3.org/2000/01/rdf-schema#label> "0_1"^^<{xsd}string> .',
        "<urn:seqloom:track/1> <urn:seqloom:containsSegment> <urn:seqloom:segment/1$C%20D> ."}


def test_dense_ids(spark):
    df = spark.range(200).selectExpr("id % 7 as a", "id as b").repartition(5)
    rows = K.dense_ids(df, ("a", "b"), "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(200)) and [(r.a, r.b) for r in rows] == sorted((r.a, r.b) for r in rows)


def test_notes_shift(spark):
    df = spark.createDataFrame([("a", 3, 4), ("a", 4, 6)], "track string, t0 int, t1 int")
    assert sorted((r.t0, r.t1) for r in N.shift_to_zero(df, "track").collect()) == [(0, 1), (1, 3)]


def test_long_bricks_and_chains_are_whole(spark):
    text = "defbrick Long major Type C\n" + "\n".join("chord C7 1" for _ in range(10_500))
    got = P.parse_grammar(spark.createDataFrame([(text,)], "value string")).first()
    assert got.name == "Long" and len(got.components) == 10_500
    chain = [(f"B{i}", None, [("brick", f"B{i + 1}", "C", "1")]) for i in range(20)]
    chain.append(("B20", None, [("chord", None, "C", "1")]))
    bricks = spark.createDataFrame(chain, f"name string, variant string, components array<{P.COMPONENT}>")
    found = {r.name: [c.value for c in r.components] for r in P.expand_bricks(bricks).collect()}
    assert found == {f"B{i}": ["C"] for i in range(21)}


def test_distinct_names_keep_distinct_iris(spark):
    rows = [(f"urn:x/{c}", "p", "o", "string") for c in ("a b", "a<b", "a%20b", "a\rb")]
    lines = [r.value for r in sinks.ntriples(spark.createDataFrame(rows, "s string, p string, o string, dtype string")).collect()]
    assert len(set(lines)) == 4 and all("\r" not in x for x in lines)
