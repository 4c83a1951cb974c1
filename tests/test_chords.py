from seqloom.functions import chords as C


def distances(spark, rows):
    """Distances of (chord, key, reference chord, reference key) labels."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, ka string, b string, kb string")
    m = df.select("i", C.chord_masks("a").alias("y"), C.key_info("ka").alias("ky"),
                  C.chord_masks("b").alias("x"), C.key_info("kb").alias("kx"))
    d = m.select("i", C.tps_distance("y", "ky", "x", "kx").alias("d"))
    return [r.d for r in d.orderBy("i").collect()]


def test_published_distances_from_the_tonic(spark):
    k = "C:major"
    degrees = ["C:maj", "G:maj", "F:maj", "D:min", "A:min", "E:min", "B:dim"]
    assert distances(spark, [(c, k, "C:maj", k) for c in degrees]) == [0, 5, 5, 8, 7, 7, 8]


def test_silence(spark):
    k = "C:major"
    assert distances(spark, [("N", k, "C:maj", k), ("C:maj", k, "N", k), ("N", k, "N", k), ("N", k, "", k),
                             ("C:maj", "N", "C:maj", k), ("G:maj", "N", "C:maj", "N")]) == [13, 13, 0, 0, 13, 5]


def test_transposition_keeps_the_distance(spark):
    names = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]
    rows = [(f"{names[(2 + t) % 12]}:min7", f"{names[t % 12]}:major", f"{names[(9 + t) % 12]}:min", f"{names[(9 + t) % 12]}:minor")
            for t in range(12)]
    assert len(set(distances(spark, rows))) == 1


def masks(spark, *labels):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, l string")
    return [r.m for r in df.select("i", C.chord_masks("l").alias("m")).orderBy("i").collect()]


def tones(m):
    return [p for p in range(12) if m.chord_mask >> p & 1]


def test_labels(spark):
    got = masks(spark, "C", "Bb:min7", "F#:dim", "C:min(b7)", "C:maj7(*5)", "D:(1,5)", "A:min/b3", "G:sus4(b7,9)", "X", "")
    assert [m and m.root for m in got] == [0, 10, 6, 0, 0, 2, 9, 7, None, None]
    assert [tones(m) for m in got if m] == [
        [0, 4, 7], [1, 5, 8, 10], [0, 6, 9], [0, 3, 7, 10], [0, 4, 11], [2, 9], [0, 4, 9], [0, 2, 5, 7, 9]]


def test_keys(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(["C", "Dm", "C:major", "E:minor", "N", "F#:minor"])], "i int, k string")
    rows = df.select("i", C.key_info("k").alias("x")).withColumn("t", C.tonic_chord("x")).orderBy("i").collect()
    assert [r.x and (r.x.tonic, r.x.minor, r.x.scale) for r in rows] == [
        (0, False, 0), (2, True, 5), (0, False, 0), (4, True, 7), None, (6, True, 9)]
    assert [r.t for r in rows] == ["C:maj", "D:min", "C:maj", "E:min", "N", "F#:min"]


def test_pitches(spark):
    df = spark.createDataFrame([("A:min",)], "l string").select(C.chord_masks("l").alias("m")).select(C.chord_pitches("m").alias("p"))
    assert df.first().p == [69, 72, 76]
