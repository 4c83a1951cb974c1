"""Each operator against a plain version on small tables with nulls, empty texts, ties and repeated rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm import ann, bm25, elias_fano, html_text, lm, mixing, packing, quality, sharding, simhash, token_store
from seqloom.llm.components import components
from seqloom.llm.tokens import TextEncoder, default_tokenizer

LONG = " ".join(f"word{i % 97} and{i % 13}," for i in range(6000))
BASE = ("the quick brown fox jumps over the lazy dog while seven wizards quietly mix boxes of liquor and jam under the "
        "old bridge near a river that never freezes even when winter storms arrive early from the northern mountains")
TEXTS = [None, "", "   ", "one", "one", "Two words", "a b c", "A B C", BASE, BASE, BASE + " today", "x" * 300,
         "tabs\tand\nlines \n here", "Ünïcode é è ê, 日本 語", LONG, "the the the the", BASE.upper()]
SCHEMA = "doc_id long, text string, source string, size int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "a", "b"][i % 3], 1, 0.5) for i, t in enumerate(TEXTS)]
    rows += [(5, "Two words", "b", 1, 0.5), (None, "no id here", "a", 1, 0.5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text, end):
    tok = Tokenizer.from_file(default_tokenizer())
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4").tobytes()


def test_pieces_give_the_ids_of_whole_texts():
    texts = [*TEXTS, " x ", "a \n b", "<|endoftext|> a", "don't we'll", "a  b", "  b", "w, 'tis ..."]
    assert TextEncoder(default_tokenizer(), limit=3).encode(texts, b"") == [ids_of(t, 0)[:-4] for t in texts]


def test_code_lengths_are_optimal_under_the_limit():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34])
    free, tight = token_store.code_lengths(counts, 16), token_store.code_lengths(counts, 4)
    for lengths, limit in ((free, 16), (tight, 4)):
        assert lengths.max() <= limit and sum(2.0 ** -n for n in lengths) == 1
    assert (counts * free).sum() < (counts * tight).sum() <= (counts * 4).sum()
    assert token_store.code_lengths(np.array([7])).tolist() == [1]
    with pytest.raises(ValueError):
        token_store.code_lengths(np.ones(17), 4)


def test_store_round_trip(spark, docs, empty):
    got = token_store.op1_token_huffman(spark, docs).collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expected = 0, []
    for i, t in rows:
        data = ids_of(t, 0)
        expected.append((i, start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert token_store.op1_token_huffman(spark, empty).count() == 0


def test_simhash_components(spark, docs, empty):
    got = simhash.op2_simhash_segments(spark, docs).collect()
    assert len(got) == len(TEXTS) + 2
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    fps = {r.doc_id: int(r.fingerprint, 16) for r in got if r.doc_id is not None}
    for (i, fp), c in by.items():
        if i is not None:
            assert int(fp, 16) == simhash.fingerprint(TEXTS[i])
            near = {j for j in fps if (fps[j] ^ fps[i]).bit_count() <= 2}
            assert c <= min(near) and all(by[j, f"{fps[j]:016x}"] == c for j in near)
    assert by[0, "0" * 16] == by[1, "0" * 16] == by[2, "0" * 16] == 0
    assert by[8, f"{fps[8]:016x}"] == by[16, f"{fps[16]:016x}"]
    assert simhash.op2_simhash_segments(spark, empty).count() == 0


@pytest.mark.parametrize("full", [64, 2])
def test_links_in_full_cells_give_the_same_components(spark, full):
    rng = np.random.default_rng(3)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(25):
            flips = rng.integers(0, 64, 2)
            fps.add(centre ^ (1 << int(flips[0])) ^ (1 << int(flips[1])))
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), full)
    got = {r.v: r.root for r in components(links).collect()}
    root = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert {x: got.get(x, x) for x in fps} == root


def plain_bm25(rows, query, k):
    held = [(i, Counter((t or "").lower().split())) for i, t in rows if i is not None]
    average = max(1, sum(sum(c.values()) for _, c in held)) / len(held)
    out = []
    for i, c in held:
        s = 0.0
        for term, n in Counter((query or "").lower().split()).items():
            df = sum(term in x for _, x in held)
            if c[term]:
                length = bm25.K1 * (1 - bm25.B + bm25.B * sum(c.values()) / average)
                s += n * math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * c[term] * (bm25.K1 + 1) / (c[term] + length)
        if s:
            out.append((i, round(s, 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:k]


def test_bm25_equals_scoring_everything(spark, docs, empty):
    queries = [(1, "the quick fox"), (2, "one"), (3, None), (4, "absent"), (5, "two WORDS two"), (6, BASE)]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = bm25.search(bm25.build_index(docs), asked, 4).orderBy("query_id", "rank").collect()
    for q, text in queries:
        assert [(r.doc_id, round(r.score, 6)) for r in found if r.query_id == q] == plain_bm25(rows, text, 4)
    assert bm25.search(bm25.build_index(empty), asked, 4).count() == 0


def test_bm25_opens_few_blocks():
    rng = np.random.default_rng(1)
    lengths = np.full(64 * 200, 50)
    rare, common = np.array([5, 700, 9000]), np.sort(rng.permutation(len(lengths))[:4000])
    lists = [(6.0, bm25.Postings(rare, np.ones(3), lengths, 50.0)),
             (0.1, bm25.Postings(common, np.ones(4000), lengths, 50.0))]
    docs, _, scored = bm25.top_k(lists, np.arange(len(lengths)), lengths, 50.0, 3)
    assert sorted(docs.tolist()) == rare.tolist() and scored < 1000


def test_shards(spark, docs, empty):
    got = sharding.assign(docs, shards=4).collect()
    assert len(got) == len(TEXTS) + 2
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for r in got:
        if r.doc_id is not None:
            data = (TEXTS[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    assert sharding.assign(empty).count() == 0


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 5}") for i in range(400)] + [(i, f"alone {i}") for i in range(400, 1000)]
    cut = sharding.cut_links(sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 8)).first()
    assert cut.linked == 400 and cut.cut <= 7 * 4 + 12


@pytest.mark.parametrize("copies", [2, 50, 1000, 4000])
def test_copies_of_a_text_stay_together_up_to_the_quota(spark, copies):
    alone = spark.range(30_000 - copies).selectExpr("id + 10000 AS doc_id", "concat('alone ', id) AS text")
    docs = alone.unionByName(spark.range(copies).selectExpr("id AS doc_id", "'the same' AS text"))
    got = sharding.assign(docs, 6)
    cut = sharding.cut_links(got).first()
    assert cut.linked == copies and cut.cut == 0
    counts = Counter(r.shard for r in got.select("shard").collect())
    assert set(counts.values()) == {5000} and got.select("shard", "slot").distinct().count() == 30_000


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(700, x[20].tolist()), (720, None), (740, [0.0] * 8), (760, [float("nan")] * 8), (None, x[0].tolist())]
    got = ann.op5_learned_partitions(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    ids = np.array([r[0] for r in rows[:601]])
    x = np.array([r[1] for r in rows[:601]])
    hits = 0
    for q in (i for i in ids if i % 20 == 0):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        scores = x @ x[ids == q][0]
        assert [r.rank for r in mine] == list(range(1, 21)) and q not in [r.vec_id for r in mine]
        assert all(abs(r.score - scores[ids == r.vec_id][0]) < 1e-12 for r in mine)
        scores[ids == q] = -np.inf
        hits += len({r.vec_id for r in mine} & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
    assert {r.query_id for r in got} == {int(i) for i in ids if i % 20 == 0}
    assert hits >= 0.9 * len(got)
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.op5_learned_partitions(spark, none).count() == 0


def test_packing(spark, docs, empty):
    got = packing.op6_pack_differencing(spark, docs).collect()
    ends = Counter()
    for r in got:
        text = "no id here" if r.doc_id is None else TEXTS[r.doc_id]
        data = ids_of(text, 1)
        assert r.doc_tokens == len(data) // 4
        assert zlib.crc32(data[4 * r.start: 4 * (r.start + r.length)]) == r.ids_crc32
        ends[r.doc_id] += r.length
    assert all(n == len(ids_of("no id here" if i is None else TEXTS[i], 1)) // 4 * (2 if i == 5 else 1)
               for i, n in ends.items())
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.op6_pack_differencing(spark, empty).count() == 0


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(4).integers(1, 900, 400).tolist()
    sets = packing.near_equal(sizes, 2048)
    assert sorted(i for s in sets for i in s) == list(range(400))
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert max(sums) <= 2048 and len(sets) * 2048 <= 1.03 * sum(sizes)


def test_elias_fano_finds_each_value():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    for own in (values, values[:1], values[:0], np.arange(300, dtype=np.uint64)):
        seq = elias_fano.Sequence(elias_fano.Sequence.build("x", own), "x")
        assert seq.index(own).tolist() == list(range(len(own)))
        assert (seq.index(rng.integers(1 << 62, 1 << 63, 50).astype(np.uint64) | np.uint64(1 << 63)) == -1).all()
    sizes = np.array([0, 3, 0, 70, 1, 0])
    lo, hi = elias_fano.Pointers(elias_fano.Pointers.build("p", sizes), "p").span(np.arange(6))
    assert (hi - lo).tolist() == sizes.tolist() and lo.tolist() == [0, 0, 3, 3, 73, 74]


def test_language_model(spark, docs, empty):
    got = lm.op7_elias_fano_ngrams(spark, docs).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in docs.collect()]
    kept = [w for i, w in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c, pairs = Counter(x for w in kept for x in w), Counter(p for w in kept for p in zip([b" ", *w], w))
    context, kinds = Counter(), Counter()
    for (u, _), k in pairs.items():
        context[u] += k
        kinds[u] += 1
    n, v = sum(c.values()), len(c)
    for r in got:
        w = next(w for i, w in rows if i == r.doc_id)
        p1 = [(c[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        p2 = [p if not context[u] else (max(pairs[u, x] - 0.75, 0) + 0.75 * kinds[u] * p) / context[u]
              for u, x, p in zip([b" ", *w], w, p1)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(map(math.log10, p1))) < 1e-6
        assert abs(r.score - sum(map(math.log10, p2))) < 2e-4 * len(w)
    assert len(got) == len(rows) and lm.op7_elias_fano_ngrams(spark, empty).count() == 0


def test_quality_learns_from_labels(spark, docs, empty):
    good = [(i, " ".join(f"w{(i * 7 + k * k) % 91}" for k in range(60)).capitalize() + ".") for i in range(300)]
    bad = [(1000 + i, " ".join([f"JUNK{i % 5}!!"] * 40)) for i in range(300)]
    rows = spark.createDataFrame(good + bad + [(5000, None), (5001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (7, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.op8_quality_neighbours(spark, rows, labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    assert held and all(r.predicted == (r.doc_id < 1000) for r in held)
    assert quality.op8_quality_neighbours(spark, empty, labels).count() == 0
    assert {r.score for r in quality.op8_quality_neighbours(spark, rows, labels.limit(0)).collect()} == {0.5}


def water(sizes, weights):
    cap, total, done = {k: 2 * v for k, v in sizes.items()}, 1.5 * sum(sizes.values()), {}
    while True:
        live = [k for k in sizes if k not in done]
        level = (total - sum(done.values())) / (sum(weights[k] for k in live) or 1)
        over = [k for k in live if level * weights[k] > cap[k]]
        if not over:
            return done | {k: level * weights[k] for k in live}
        done |= {k: cap[k] for k in over}


def test_mixing(spark, docs, empty):
    got = mixing.op9_mix_blocks(spark, docs).collect()
    rows = docs.collect()
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, size(r.text)) for r in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        source = next(x for x in order if sizes[x] == r.source_size)
        assert abs(r.target - goal[source]) < 1e-6
        taken[source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 2 * mixing.BLOCK for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.op9_mix_blocks(spark, docs).collect()))
    assert mixing.op9_mix_blocks(spark, empty).count() == 0


def test_permutations_and_primes(spark):
    assert all(all(p % d for d in range(2, int(p ** 0.5) + 1)) for p in mixing.PRIMES)
    for n in (1, 2, 97, 1000):
        k = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n), F.lit(n * 31)).alias("k"))
        assert sorted(r.k for r in k.collect()) == list(range(n))


def test_permutations_of_more_blocks_than_a_product_of_longs_holds(spark):
    for n in ((1 << 40) - 3, 3 * mixing.PRIMES[0], 7 * mixing.PRIMES[3]):
        at = [0, 1, 2, (1 << 20) - 1, 1 << 20, n // 2, n - 2, n - 1]
        for seed in range(8):
            rows = spark.createDataFrame([(k,) for k in at], "k long").select(
                "k", mixing._permuted(F.col("k"), F.lit(n).cast("long"), F.lit(seed)).alias("p")).collect()
            moved = {r.k: r.p for r in rows}
            step = (moved[1] - moved[0]) % n
            assert math.gcd(step, n) == 1
            assert all(moved[k] == (moved[0] + step * k) % n for k in at)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href=x>Home</a>
</nav><div class="ad">Buy now</div><div class="cookie-notice">We use cookies</div><form><input>Send</form>
<article><h1>Head &amp; more</h1><p><b>First   line
goes on.<br><p>Short.<p>Last &lt;one&gt; of many words that make up a paragraph</article>
<div class="comments"><p>I disagree with all of that, and at some length too, as readers do.</p></div>
<footer>&copy; x</footer>"""


def test_main_text(spark):
    want = "Head & more\nFirst line goes on.\nShort.\nLast <one> of many words that make up a paragraph"
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (4, "w", "plain text", "x"), (4, "w", "plain text", "x")]
    got = html_text.op10_html_ratio(spark, spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert [(r.page_id, r.text, r.n_chars) for r in got.collect()] == [
        (1, want, len(want)), (2, "", 0), (None, "", 0), (4, "plain text", 10), (4, "plain text", 10)]
    body = "<div id=main><div>" + "".join(f"<p>Paragraph {i} with a number of words in it.</p>" for i in range(5)) + "</div></div>"
    assert html_text.main_text(f"<body><ul class=menu><li>A<li>B</ul>{body}<aside>See also</aside>").count("\n") == 4
    assert html_text.main_text("<p>" * 3000 + "deep") == "deep"
