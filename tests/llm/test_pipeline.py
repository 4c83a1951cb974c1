"""The corpus pipeline: each stage against a plain version on a small table with nulls, copies and repeated rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import LONG, ids_of, water

import corpus_pipeline as cp
from seqloom.llm import mixing, near_text, packing, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "lo", "mi", "tor", "sun") for b in ("ra", "ken", "dle", "vo", "st")]


def corpus():
    rnd = random.Random(7)
    prose = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."
    texts = {i: prose(rnd.randrange(40, 200)) for i in range(60)}
    texts |= {100 + i: " ".join([f"JUNK{i % 5}!!"] * 40) for i in range(40)}
    texts |= {200: texts[3], 201: texts[3], 202: texts[4] + " ", 203: texts[5].upper(), 204: prose(3000), 205: LONG,
              300: None, 301: "", 302: " \n"}
    rows = [(i, t, "en", ("a", "b", None)[i % 3], None if t is None else len(t)) for i, t in texts.items()]
    return rows + [rows[7], (None, prose(50), None, "a", 0)]


ROWS = corpus()
LABELS = [(i, 1, 0) for i in range(0, 60, 2)] + [(i, 0, 0) for i in range(100, 140, 2)] + [(None, 1, 0), (1, None, 0), (999, 0, 1)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with the tables, whose documents have columns with clashing names, too."""
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as size", "0.5 as score", "'x' as h", "'y' as _score")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def rows_of(df):
    assert df.columns == list(cp.COLUMNS)
    return Counter(map(tuple, df.collect()))


def plain_quality(rows):
    """Rows for which the votes of the 15 most similar labelled rows are for label 1."""
    known = {i: y for i, y, _ in LABELS if i is not None and y is not None}
    learned = [(quality.terms(r[1]), known[r[0]]) for r in rows if r[0] in known]
    space = quality.Space(np.stack([x for x, _ in learned]), np.array([y for _, y in learned]))
    kept = []
    for r in rows:
        v = space._unit((quality.terms(r[1])[None] * space.weights - space.centre) @ space.axes)[0]
        near = sorted(((float(v @ x), float(y)) for x, y in zip(space.vectors, space.labels)), reverse=True)[:15]
        share = sum((max(s, 0) ** 4 + 1e-9) * y for s, y in near) / sum(max(s, 0) ** 4 + 1e-9 for s, _ in near)
        assert abs(share - 0.5) > 1e-4
        if share >= 0.5:
            kept.append(r)
    return kept


def plain_near_duplicates(rows):
    """Of linked rows the one with the smallest id; rows without an id stay."""
    fps = [simhash.fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= 2 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    kept = {r[0]: r for g, r in zip(group, rows) if r[0] is not None and r[0] == least[g]}
    return [*kept.values(), *[r for r in rows if r[0] is None]]


def plain_mix(spark, rows):
    """The runs of words that `mixing.mix` takes, cut out of the texts one by one."""
    df = spark.createDataFrame(rows, SCHEMA)
    texts = {r.h: tuple(r)[1:] for r in df.select(F.xxhash64(*cp.COLUMNS).alias("h"), *cp.COLUMNS).collect()}
    held, taken = mixing.mix(df, identity=cp.COLUMNS)
    of = {(r.source, r.cell, r.row_no): texts[r.row_hash] for r in held.collect()}
    runs = defaultdict(list)
    for r in taken.collect():
        runs[r.source, r.cell, r.row_no, r.round].append((r.doc_start, r.length))
    out = []
    for key, some in runs.items():
        i, text, lang, source, _ = of[key[:3]]
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        if sum(n for _, n in some) < len(found):
            text = " ".join(w for s, n in sorted(some) for w in found[s:s + n])
        out.append((i, text, lang, source, len(text)))
    return out


def plain_pieces(rows):
    out = Counter()
    for i, text, *_ in rows:
        data = ids_of(text, 1)
        n, at = len(data) // 4, 0
        sizes = [2048] * (n // 2048) + (packing.uneven(n % 2048, 3) if n % 2048 else [])
        for size in sizes:
            out[i, at, size, zlib.crc32(data[4 * at:4 * (at + size)]), n] += 1
            at += size
    return out


def test_rejects_go_and_clean_documents_stay(spark, docs, tables):
    got = rows_of(cp.keep_quality(spark, docs, tables))
    assert got == Counter(plain_quality(ROWS))
    ids = {r[0] for r in got}
    assert ids >= set(range(60)) and not ids & set(range(100, 140))


def test_one_document_of_each_group_stays(spark, docs, tables):
    got = rows_of(cp.drop_near_duplicates(spark, docs, tables))
    assert got == Counter(plain_near_duplicates(ROWS))
    ids = {r[0] for r in got}
    assert ids >= {3, 4, 5, 7, 300, None} and not ids & {200, 201, 202, 203, 301, 302}


def test_near_duplicates_are_decided_by_row(spark):
    """An id with several texts keeps them, a text under several ids stays once, copies without an id go."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (1, c), (2, c), (None, "nobody's words"), (None, "nobody's words"), (None, b)]
    got = cp.drop_near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA), "")
    assert rows_of(got) == Counter((i, t, "en", "s", 1) for i, t in [(1, a), (1, b), (1, c), (None, "nobody's words")])


def edited():
    """A long group of edited copies, pairs of texts around the limit, and texts that share a frequent passage."""
    rnd = random.Random(11)
    prose = lambda n: [rnd.choice(WORDS) + str(rnd.randrange(9)) for _ in range(n)]
    base, passage, texts = prose(120), prose(60), []
    for _ in range(90):
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        texts.append(w)
    for n in (1, 3, 6, 30, 100, 400):
        w = prose(n)
        texts.append(w)
        for k in (1, 2, 4, 9, 16):
            texts.append([rnd.choice(WORDS) if rnd.random() < k / 200 else x for x in w])
    texts += [passage + prose(k % 40) for k in range(80)] + [prose(50) for _ in range(20)]
    return [(i, " ".join(w), "en", "a", 1) for i, w in enumerate(texts)]


def shingle_sets(rows):
    out = []
    for r in rows:
        w = r[1].lower().split()
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    return out


@pytest.mark.parametrize("full", [2, 64])
def test_edited_copies_go(spark, full):
    """Components equal those of all pairs with a shingle similarity of 0.8, of which SimHash links a part."""
    rows = edited()
    sets, group, far = shingle_sets(rows), list(range(len(rows))), 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                far += (simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[j][1])).bit_count() > 2
                if group[i] != group[j]:
                    group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(r[0] for r, h in zip(rows, group) if h == g) for g in group}
    texts = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id v", "text").dropDuplicates(["text"])
    links = near_text.near_links(texts, full).collect()
    assert far > 100 and all(5 * len(sets[r.a] & sets[r.b]) >= 4 * len(sets[r.a] | sets[r.b]) for r in links)
    same = {r[0]: r[0] for r in rows}
    for r in links:
        x, y = same[r.a], same[r.b]
        same = {k: y if v == x else v for k, v in same.items()}
    kept = texts.select("v").collect()
    assert {(x.v, y.v) for x in kept for y in kept if same[x.v] == same[y.v]} == \
           {(x.v, y.v) for x in kept for y in kept if group[x.v] == group[y.v]}
    if full == near_text.FULL:
        got = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
        assert {r.doc_id for r in got} == set(least.values())


def test_mix_cuts_the_words_taken(spark, docs, tables):
    got = rows_of(cp.mix_sources(spark, docs, tables))
    assert got == Counter(plain_mix(spark, ROWS))
    sizes, per, taken, most = Counter(), Counter(), Counter(), Counter()
    for i, text, _, source, _ in ROWS:
        sizes[source] += len((text or "").split())
        most[i] += 2 * len((text or "").split())
    for (i, text, _, source, _), n in got.items():
        taken[source] += n * len(text.split())
        per[i] += n * len(text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert all(abs(taken[s] - goal[s]) <= 2 * mixing.BLOCK for s in sizes) and all(per[i] <= most[i] for i in per)


def test_run_equals_the_plain_stages(spark, tables):
    got = cp.run(spark, tables).collect()
    want = plain_pieces(plain_mix(spark, plain_near_duplicates(plain_quality(ROWS))))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for some in by.values():
        ends = np.cumsum([n for _, n in sorted(some)])
        assert [at for at, _ in sorted(some)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_links_by_fingerprints_first(spark, monkeypatch):
    """The stage asks the operator of op2 for links; its pairs connect all fingerprints at most two bits apart."""
    rows, asked, own = edited(), [], simhash.near_links
    monkeypatch.setattr(near_text.simhash, "near_links", lambda fps, **k: asked.append(1) or own(fps, **k))
    texts = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id v", "text")
    same = {r[0]: r[0] for r in rows}
    for r in near_text.fingerprint_pairs(texts).collect():
        x, y = same[r.a], same[r.b]
        same = {k: y if v == x else v for k, v in same.items()}
    fps = {r[0]: simhash.fingerprint(r[1]) for r in rows}
    close = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 2]
    assert close and asked and all(same[i] == same[j] for i, j in close)
    asked.clear()
    cp.drop_near_duplicates(spark, spark.createDataFrame(rows[:5], SCHEMA), "").collect()
    assert asked


def test_near_dedup_sends_few_texts_at_once(spark, monkeypatch):
    """Arrow batches of whole texts stay small in the stage, and the session's own limit is as before after it."""
    from seqloom.llm import near_text
    from seqloom.llm.common import TEXT_ROWS, text_batches

    name, seen, links = "spark.sql.execution.arrow.maxRecordsPerBatch", [], near_text.near_links

    def watched(texts):
        seen.append(int(spark.conf.get(name)))
        return links(texts)

    monkeypatch.setattr(near_text, "near_links", watched)
    before = spark.conf.get(name)
    assert int(before) > TEXT_ROWS
    near_text.class_components(spark.createDataFrame([("a b c",), ("a b c",), ("d",)], "text string")).collect()
    assert seen == [TEXT_ROWS] and spark.conf.get(name) == before
    with text_batches(spark, 7):
        with text_batches(spark):
            assert spark.conf.get(name) == "7"  # a smaller limit holds
        rows = spark.range(0, 100, 1, 1).mapInArrow(lambda bs: (b.slice(0, 1) for b in bs), "id long").count()
    assert rows == 15 and spark.conf.get(name) == before


def test_shingles_of_all_texts_are_counted(spark):
    """A passage that a few of many texts share is known to be frequent: no text is left out of the count."""
    rnd = random.Random(23)
    name = lambda: "".join(rnd.choices("abcdefgh", k=9))
    passage = " ".join(name() for _ in range(8))
    rows = [(v, " ".join(name() for _ in range(6)) + (f" {passage}" if v < 5 else "")) for v in range(1, 401)]
    texts = spark.createDataFrame(rows, "v long, text string").repartition(5)
    levels = near_text.frequent_shingles(texts)
    bucket = lambda t: (near_text.shingles(t) >> np.uint64(64 - near_text.BUCKET_BITS)).tolist()
    want = defaultdict(Counter)
    for _, t in rows:
        for s in near_text.shingles(t).tolist():
            want[s >> (64 - near_text.BUCKET_BITS)][s] += 1
    frequent = {b: int(8 * np.log2(max(c.values()))) for b, c in want.items() if max(c.values()) >= near_text.FREQUENT}
    assert set(bucket(passage)) <= set(frequent)
    assert {int(b): int(levels[b]) for b in np.flatnonzero(levels)} == frequent
    # the passage comes last in the order, so no prefix holds it
    held = {r.token for r in near_text.prefixes(texts).where("v < 5").collect()}
    assert not held & set(near_text.shingles(passage).view(np.int64).tolist())


def test_a_large_corpus_is_counted_whole(spark):
    """The old count took one text of several as soon as there were 20,000; the shingles of every text count."""
    rows = spark.range(20_000).selectExpr("id as v", "if(id % 2 = 1 and id < 7, 'one two three four five', cast(id as string)) as text")
    levels = near_text.frequent_shingles(rows)
    at = int(near_text.shingles("one two three four five")[0] >> np.uint64(64 - near_text.BUCKET_BITS))
    assert levels[at] == int(8 * np.log2(3))
