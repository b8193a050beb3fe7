"""The corpus operators against brute force, and on odd tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import components, exact_dedup, html_text, media_avi, packing, pieces, quality_mil, queries, simhash, substrings, token_counts, toxicity_pu

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest binary, fp long, spans string, crc long, key string, n int, fingerprint string, _id long, kept boolean"
LONG = " ".join(f"w{k * k % 977}" for k in range(60_000))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), b"x", 1, "s", 2, "k", 3, "f", 4, True) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "same words here"), (5, "same  words here"), (5, "same  words here"), (None, "alone é"), (None, None), (7, LONG), (8, LONG + " "), (9, "<|endoftext|> \x1c  x y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("options", [{}, {"digest_bytes": 1, "memtable_bytes": 50_000, "buckets": 7}])
def test_exact_dedup(spark, docs, rows, options):
    """Also with digests of one byte, where nearly all texts collide and only the byte check tells them apart."""
    want = exact_brute(rows)
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t) for i, t in rows}
    for r in exact_dedup.exact_dedup(docs, **options).collect():
        assert (r.keep_id, r.group_size) == want[norm[r.doc_id]] and r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def test_exact_dedup_odd(spark):
    out = sorted((r.doc_id is None, r.doc_id or 0, -1 if r.keep_id is None else r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, ODD)).collect())
    assert out == [(False, 1, 3, 4, False), (False, 2, 3, 4, False), (False, 3, 3, 4, True), (False, 4, 5, 3, False), (False, 5, 5, 3, True), (False, 5, 5, 3, True), (False, 7, 8, 2, False), (False, 8, 8, 2, True), (False, 9, 9, 1, True), (True, 0, -1, 1, True), (True, 0, 3, 4, False)]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    kept = exact_dedup.deduplicated(frame(spark, ODD))
    assert kept.columns == frame(spark, []).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 5, 8, 9]  # a copy without id goes as any other


def test_exact_dedup_of_null_and_shared_ids(spark):
    data = [(1, "t"), (None, "t"), (None, "other"), (None, "o ther"), (5, "u"), (5, "u"), (5, "v"), (6, "v"), (7, "w"), (7, "t ")]
    out = exact_dedup.deduplicated(frame(spark, data))
    assert out.schema == frame(spark, []).schema
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "o ther"), (5, "u"), (5, "v"), (7, "t "), (7, "w")]
    assert exact_dedup.deduplicated(frame(spark, [])).count() == 0


def test_exact_dedup_shuffles_texts_of_hits_alone(spark, docs):
    """What passes the filter is what several runs hold, and few others; a filter out of room loses nothing."""
    some = docs.select("doc_id", "text").repartition(3)
    index, light = exact_dedup.build_index(some, memtable_bytes=200_000)
    digests = [bytes(r.digest) for r in index.select("digest").distinct().collect()]
    for most in (1 << 20, 64 * 8):
        filters = [exact_dedup.Bloom(bits=b) for b in exact_dedup.hit_filter(spark.createDataFrame([(d,) for d in digests[:40]], "digest binary"), 64, most)]
        passed = {d for d in digests if d in filters[zlib.crc32(d) % 64]}
        assert set(digests[:40]) <= passed and (most < 1 << 20 or len(passed) < 40 + len(digests) // 10)
    assert light.count() == docs.count() and index.agg(F.sum("group_size")).first()[0] == docs.count()


def fp_brute(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def comp_brute(fps, ids, radius=3):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.array(ids)
    while True:
        new = np.array([label[near[k]].min() for k in range(len(fps))])
        if (new == label).all():
            return label.tolist()
        label = new


def test_simhash(spark, docs, rows):
    out = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = np.array([int(f, 16) for _, f, _ in out], np.uint64)
    assert [int(x) for x in fps[:40]] == [fp_brute(t) for _, t in rows[:40]]
    assert [c for *_, c in out] == comp_brute(fps, [i for i, _ in rows])


@pytest.mark.parametrize("seed", range(3))
def test_links_of_dense_and_sparse_fingerprints(spark, seed):
    """Clusters of near fingerprints, hot values and far ones; every partitioning finds all components."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, 30, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False))) for _ in range(400)]
    fps = np.unique(np.array([base[r.integers(0, 3 if k % 3 == 0 else 30)] ^ f for k, f in enumerate(flips)], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for size, hot in ((8, 1 << 18), (4096, 1 << 18), (4096, 3)):
        roots = {row.node: row.root for row in components.components(simhash.near_links(df, sample_size=size, hot=hot)).collect()}
        label = comp_brute(fps, list(range(len(fps))))
        groups = defaultdict(set)
        for k, x in enumerate(fps.view(np.int64).tolist()):
            groups[label[k]].add(roots.get(x, x))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_forest_of_large_buckets():
    """The lookup by balls in a sorted set finds what comparing all does."""
    r = np.random.default_rng(5)
    fps = np.unique(np.array([int(x) ^ int(y) for x in r.integers(0, 2**63, 4) for y in r.integers(0, 2**12, 40)], np.uint64))
    parts = []
    for rest in (0, 10_000):
        label = list(range(len(fps)))
        at = {int(x): k for k, x in enumerate(fps)}
        for a, b in simhash._forest(fps, fps[:0], 2, rest):
            old, new = label[at[b]], label[at[a]]
            label = [new if x == old else x for x in label]
        parts.append(Counter(label).values())
    assert sorted(parts[0]) == sorted(parts[1])


def test_forest_of_a_hot_bucket():
    """150 000 distinct fingerprints under one key, with planted neighbours, take seconds, not a lookup of a ball each."""
    import time

    r = np.random.default_rng(6)
    base = np.unique(r.integers(0, 2**48, 120_000, dtype=np.uint64))
    near = base[:30_000] ^ np.array([sum(1 << int(b) for b in r.choice(48, 3, replace=False)) for _ in range(30_000)], np.uint64)
    began = time.perf_counter()
    edges = simhash._forest(base, near, 3, 2048)
    assert time.perf_counter() - began < 60
    met = {frozenset(e) for e in edges}
    # a planted pair is linked, alone or by others it is near to
    assert sum(frozenset((int(a), int(b))) in met for a, b in zip(base, near, strict=False)) > 29_900


def test_thresholds_fill_the_pigeonhole():
    sample = np.random.default_rng(1).integers(0, 2**63, 512, dtype=np.uint64)
    for total in (10, 10**6, 10**9, 3 * 10**10):
        plan = simhash.plan_partitions(sample, total)
        m = next(m for m in range(2, 5) if sorted(map(len, simhash.grouped_bits(sample, m)))[-1] == max(len(b) for b, _ in plan))
        assert sum(t for _, t in plan) - (m - len(plan)) == 3 - m + 1
    assert simhash.allocate([[0, 1, 9], [0, 5, 6], [0, 2, 3]], 0)[0] == min(a + b + c for i, a in enumerate([0, 1, 9]) for j, b in enumerate([0, 5, 6]) for k, c in enumerate([0, 2, 3]) if i + j + k - 3 == 0)


def test_simhash_odd(spark):
    out = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, ODD)).collect()}
    zero = "0" * 16
    assert {(1, zero, 1), (2, zero, 1), (3, zero, 1), (None, zero, 1)} <= out
    assert {c for i, _, c in out if i in (4, 5)} == {4} and {c for i, _, c in out if i in (7, 8)} == {7}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.one_of_each(frame(spark, ODD)).columns == frame(spark, []).columns


def test_simhash_one_of_each_of_null_and_repeated_ids(spark):
    t, u, v, w = (" ".join(f"{c}{k}" for k in range(50)) for c in "tuvw")
    data = [(1, t), (None, t), (None, u), (None, u), (None, f"{u} "), (5, v), (5, w), (5, v), (6, w), (None, None), (None, ""), (9, "")]
    out = simhash.one_of_each(frame(spark, data))
    assert out.schema == frame(spark, []).schema
    assert Counter(map(tuple, out.select("doc_id", "text").collect())) == Counter([(1, t), (None, f"{u} "), (5, v), (5, w), (9, "")])
    assert [r.text for r in simhash.one_of_each(frame(spark, [(1, t), (2, t), (3, u)])).orderBy("doc_id").collect()] == [t, u]
    assert simhash.one_of_each(frame(spark, [])).count() == 0


def test_suffix_automaton():
    r = np.random.default_rng(2)
    for _ in range(60):
        size = int(r.integers(1, 5))
        seqs = [list(r.choice(list("abc"), r.integers(1, 14))) for _ in range(r.integers(1, 5))]
        auto = substrings.SuffixAutomaton()
        for s in seqs:
            auto.add(s, 2)
        auto.finish()
        for s in seqs:
            for at, n in auto.occurrences(s, size):
                assert n == 2 * sum(x[j : j + size] == s[at : at + size] for x in seqs for j in range(len(x)))


@pytest.mark.parametrize("options", [{}, {"shard_words": 60}, {"size": 5}, {"size": 5, "shard_words": 30}])
def test_substrings(spark, docs, rows, options):
    out = sorted(map(tuple, substrings.digests(substrings.remove_repeats(docs, **options)).collect()))
    assert [x[1:] for x in out] == substrings.brute_force([t for _, t in rows], options.get("size", 35))


def test_substrings_odd(spark):
    und = "Und " * 300
    odd = [*ODD, (20, und), (21, " ".join(f"x{k}" for k in range(34))), (22, " ".join(f"x{k}" for k in range(34)))]
    out = sorted(map(tuple, substrings.digests(substrings.remove_repeats(frame(spark, odd))).collect()), key=repr)
    want = substrings.brute_force([t for _, t in odd])
    assert out == sorted([(i, *w) for (i, _), w in zip(odd, want, strict=True)], key=repr)
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    left = substrings.without_repeats(frame(spark, odd))
    assert left.columns == frame(spark, []).columns
    assert {r.doc_id: (r.text, r.n_chars) for r in left.collect()}[20] == ("", 0)


def packing_checks(out, rows):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    bpe = packing.ByteBpe(*packing.default_tokenizer())
    for i, t in rows:
        ids = bpe.whole.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in own] == [(k, sum(x.length for x in own[:k])) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        assert len(own) == 1 or all(r.length == 2048 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_sequence), sum(r.length for r in out)


def test_packing(spark, docs, rows):
    n, tokens = packing_checks(packing.best_fit_packing(docs).collect(), rows)
    assert n <= 1.02 * -(-tokens // 2048) + 1


def test_packing_odd(spark):
    odd = list(dict.fromkeys(x for x in ODD if x[0] is not None))
    packing_checks(packing.best_fit_packing(frame(spark, odd)).collect(), odd)
    assert packing.best_fit_packing(frame(spark, ODD)).count() > len(ODD)
    assert packing.best_fit_packing(frame(spark, [])).count() == 0
    packed = packing.best_fit_packing(frame(spark, odd), keep_ids=True)
    assert sorted(len(r.ids) for r in packing.sequences(packed).collect())[-1] == 2048
    tiny = packing.best_fit_packing(frame(spark, odd), capacity=7).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert tiny.agg(F.max("n")).first()[0] == 7


def test_plan_is_near_the_bound_and_uses_all():
    r = np.random.default_rng(0)
    for high in (60, 700, 2047):
        counts = np.bincount(r.integers(1, high + 1, 4000), minlength=2049)
        plan = packing.plan(counts)
        used = np.zeros(2049, int)
        for pattern, times in plan:
            assert sum(n * k for n, k in pattern) <= 2048
            for n, k in pattern:
                used[n] += k * times
        assert (used == counts).all()
        assert sum(t for _, t in plan) <= 1.02 * -(-int((np.arange(2049) * counts).sum()) // 2048) + 1
        assert any(len(p) >= 2 and sum(n * k for n, k in p) == 2048 for p, _ in plan)


def test_sum_index_against_brute_force():
    """What the index finds for a gap, one, two or three lengths, is there exactly when there is such a combination."""
    from itertools import combinations_with_replacement

    r = np.random.default_rng(3)
    for _ in range(60):
        cap = int(r.integers(8, 40))
        free = np.bincount(r.integers(1, cap, r.integers(1, 14)), minlength=cap + 1).astype(np.int64)
        index = packing.SumIndex(free, cap)
        for lead in np.flatnonzero(free).tolist():
            left = Counter({n: int(c) for n, c in enumerate(free) if c}) - Counter([lead])
            for k in (1, 2, 3):
                want = any(sum(x) == cap - lead and not Counter(x) - left for x in combinations_with_replacement(sorted(left), k))
                found = index.complement(lead, k)
                assert (found is not None) == want
                assert found is None or (sum(found) == cap - lead and len(found) == k and not Counter(found) - left)


def test_plan_takes_pairs_and_triples_and_meets_the_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = np.zeros(2049, np.int64)
    for row in packing.pieces(docs).groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    made = packing.plan(counts)
    assert sum(m for _, m in made) == -(-int((counts * np.arange(2049)).sum()) // 2048)
    exact = Counter()
    free = counts.copy()
    for pattern, times in packing.exact_fillings(free, 2048):
        assert sum(n * k for n, k in pattern) == 2048
        exact[sum(k for _, k in pattern)] += times
    assert min(exact[k] for k in (2, 3, 4)) > 0 and (free >= 0).all()


def test_quality(spark):
    big = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = quality_mil.train(d, labels)
    out = quality_mil.score(d, model).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert ((held.predicted == held.quality).mean()) > 0.95
    odd = quality_mil.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd) and len({r.score for r in odd if r.doc_id in (1, 2, 3)}) == 1
    assert quality_mil.score(frame(spark, []), model).count() == 0
    assert quality_mil.train(d, labels.filter("false")).forward(*map(np.asarray, quality_mil.passages([b""])))["y"].shape == (1,)


def test_attention_gradients():
    r = np.random.default_rng(0)
    X, bags, y = r.normal(size=(7, 4)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    model = quality_mil.GatedAttention(4, 5, 3)
    weight = np.full(3, 1 / 3)
    loss = lambda: -(weight * (y * np.log(p := model.forward(X, bags)["y"]) + (1 - y) * np.log(1 - p))).sum()
    for k, g in model.gradients(model.forward(X, bags), bags, y, weight).items():
        flat = model.p[k].reshape(-1)
        old = flat[0]
        flat[0] = old + 1e-6
        up = loss()
        flat[0] = old - 1e-6
        down = loss()
        flat[0] = old
        assert g.reshape(-1)[0] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_toxicity(spark):
    """Planted insults in two languages, one of them by compound words, in a third of the toxic documents each."""
    r = np.random.default_rng(4)
    words = [f"word{k}" for k in range(300)]
    text = lambda extra=(): " ".join([*r.choice(words, 60), *extra])
    bad = lambda k: ("grumble.",) if k % 2 else (f"snarl{words[k % 300]}",)
    data = [(k, text(bad(k) * 2), 1) if k % 8 == 0 or k % 8 == 3 else (k, text(), 0) for k in range(1200)]
    d, labels = frame(spark, [(k, t) for k, t, _ in data]), spark.createDataFrame([(k, y) for k, _, y in data], "doc_id long, toxic int")
    model = toxicity_pu.train(d, labels)
    out = toxicity_pu.score(d, model).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert 0.3 < held.shape[0] / out.shape[0] < 0.37
    assert (held[held.toxic == 1].predicted == 1).mean() > 0.95 and (held[held.toxic == 0].predicted == 0).mean() > 0.99
    odd = toxicity_pu.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= x.score < 0.7 for x in odd)
    assert toxicity_pu.clean(d, model).columns == d.columns
    assert toxicity_pu.score(frame(spark, []), toxicity_pu.train(d, labels.filter("false"))).count() == 0


def test_risk_is_not_driven_negative():
    r = np.random.default_rng(1)
    P, U = (r.random((30, 50)) < 0.3).astype(np.float32), (r.random((200, 50)) < 0.3).astype(np.float32)
    model = toxicity_pu.PositiveUnlabelled([str(k) for k in range(50)], 0.2).fit(P, U)
    fp, fu = P @ model.weights + model.bias, U @ model.weights + model.bias
    assert np.logaddexp(0, fu).mean() - 0.2 * np.logaddexp(0, fp).mean() > -0.05


def test_html_of_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    import html

    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 :].split("</article>")[0]
        blocks = [re.sub(r"<[^>]*>", "", x) for x in re.split(r"</?p>|</?h1>|<br>", body)]
        assert got[r.page_id] == " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


PAGES = {
    "<p>One.</p>": "One.", "": "", None: "", "plain &lt;text&gt;": "plain <text>", "<div><p>cut off <b": "cut off",
    "<body><nav>a b</nav><div class='content'><h1>T</h1><p>Long enough, a text; yes. And more of it.</p><p>So.</p></div><div id='comments'><p>I think, so. Very much, indeed, yes.</p></div></body>": "T Long enough, a text; yes. And more of it. So.",
    "<article><header><h1>T</h1></header><p>A<br>b &amp; c\n d</p><aside>x</aside><form>f</form><script>var a='</p>'</script><div class='ad-box'>buy</div><p>e</article><footer>f</footer>": "T A b & c d e",
    "<main><p>a <i>b</i>c</p></main><div class=cookie-notice>We use cookies, of course, to make this better. Yes.</div>": "a bc",
    "<ul><li>one, two. three<li>four, five. six</ul>": "one, two. three four, five. six",
    "<div class='page with-sidebar'><div class='post'><p>Long enough, a text; yes. And more.</p></div><div class='left sidebar'><p>Hot, hot, hot. Read this now, please, all.</p></div></div>": "Long enough, a text; yes. And more.",
    "<article><div class='article-header'><h1>T</h1></div><p>A, b.</p><section class='userComments'><p>No, never.</p></section></article>": "T A, b.",
    "<table><tr><td>a, b. c<td>d, e. f</table>": "a, b. c d, e. f",
}


def test_html_shapes(spark):
    df = spark.createDataFrame([(k, None, p, "x") for k, p in enumerate(PAGES)], "page_id long, url string, html string, text string")
    out = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert out == {k: (t, len(t)) for k, t in enumerate(PAGES.values())}


def test_html_hidden_by_attribute_names():
    shown = ["style='overflow:hidden'", 'class="overflow-hidden"', 'aria-hidden="false"', "title='hidden gems'", "data-state=hidden", "data-hidden", "data-id='comments'", "style='display:none; display:block'", "hidden=until-found"]
    for a in shown:
        assert html_text.main_text(f"<body {a}><article {a}><p {a}>One, two.</p><p><a href='/hidden-gems'>Three.</a></p></article></body>") == "One, two. Three.", a
    for a in ("hidden", "HIDDEN=''", 'class="x" hidden="hidden"', "aria-hidden=true", 'aria-hidden="TRUE"', "style='color:red; display : none'", 'style="display:none!important"'):
        assert html_text.main_text(f"<article><p>One, two.</p><p {a}>Three.</p></article>") == "One, two.", a
    assert html_text.main_text("<body style='display:none'><p>One, two.</p></body>") == "One, two."


def test_html_names_and_ends_of_skipped_elements():
    shapes = {
        "<svg-icon></svg-icon>": "", "<math-field></math-field>": "", "<title-bar></title-bar>": "", "<script-x>c</script-x>": "c", "<svg viewBox='0 0 1 1'/>": "", '<svg alt="a>b" />': "", "<math/>": "",
        "<svg><title/><path d='M0'/></svg>": "", "<svg><svg><text>in</text></svg><text>out</text></svg>": "", "<svg><foreignObject><div>in</svg>": "", "<svg><style>a{}</style><script href='x'/></svg>": "",
        "<math><mi>x</mi><mo>=</mo><mn>1</mn></math>": "x=1", "<object data=x><param name=a><b>instead</b></object>": "instead", "<script>var a='<b>'</script >": "", "<style>p{}</style/>": "", "<script src=x />var a</script>": "", "<template>t</template>": "",
    }
    for x, shown in shapes.items():
        assert html_text.main_text(f"<article><p>One, two. {x}</p><p>Three.</p></article>").split() == f"One, two. {shown} Three.".split(), x
    assert html_text.main_text("<article><svg><path d=M0><p>One, two.</p></article>") == "One, two."


def test_html_outside_the_largest_block():
    long = "Long enough, a text; yes. And more of it, here. " * 12
    lead, part = "A lead, of some words; it says what follows. " * 2, "Another part, as long as this; it is. " * 3
    post = f"<div class=post><h1>T</h1><div class=lead>{lead}</div><div class=entry-content>{long}</div></div>"
    assert html_text.main_text(f"<body>{post}</body>").split() == f"T {lead} {long}".split()
    parts = f"<div class=a><p>{long}</p><p>{long}</p></div><h2>So</h2><div class=b><p>{part}</p><ul><li>x</li></ul></div>"
    links = "<div><ul><li><a href=/>Home</a></li><li><a href=/b>All</a></li></ul></div>"
    assert html_text.main_text(f"<body>{links}<div class=post>{parts}</div>{links}</body>").split() == f"{long} {long} So {part} x".split()


def test_html_ends_and_names_that_lose_no_text():
    for page, want in {
        "<article><p>One, two.</p><select><option>x<option>y</select><p>After.</p></article>": "One, two. After.",
        "<article><p>One.</p><button><div>x</div></button><p>After.</p></article>": "One. After.",
        "<article><p class='social-science'>A, b.</p><p id='menu-of-the-day'>C.</p><label>D</label></article>": "A, b. C. D",
        "<p>a <b>b<p>c</b> d": "a b c d", "<table><tr><td>a<table><tr><td>b</table>c</table>": "a b c",
    }.items():
        assert html_text.main_text(page) == want, page


def test_html_ratios_select(monkeypatch):
    """On a page without telling names the scores decide; in an article, link lists and named boilerplate go, headings stay."""
    long, short = "Long enough, a text; yes. And more of it, here. " * 9, "Home of it all "
    bare = f"<body><div><div><span>{short}</span></div><div><span>{short}</span></div><div><span>x</span></div></div><section><p>{long}</p><p>{long}</p></section></body>"
    listed = f"<article><h2>So</h2><p>{long}</p><ul>{'<li><a href=/>More of this</a>' * 9}</ul><p>{long} <a href=/>In it</a></p><ol>{'<li>item' * 9}</ol><div class=related-posts>{'<p>See x' * 4}</div></article>"
    named = f"<body><div class=widget><p>{long}</p><p>{long}</p></div><section>{'<div>x</div>' * 20}</section></body>"
    texts = [" ".join(html_text.main_text(p).split()) for p in (bare, listed, named)]
    want = [f"{long} {long}", f"So {long} {long} In it {'item ' * 9}", f"{long} {long}"]
    assert texts[:2] == [" ".join(w.split()) for w in want[:2]] and texts[2].startswith(" ".join(want[2].split()))
    monkeypatch.setattr(html_text.Page, "scores", lambda self, radius=2: np.array([float(bool(t.strip())) for t in self.text]))
    assert all(" ".join(html_text.main_text(p).split()) != t for p, t in zip((bare, listed), texts, strict=False))


def test_html_names_of_boilerplate():
    for name in ("ad", "ad-slot-1", "adsbygoogle", "related-stories", "share_this", "socialIcons", "site-header", "commentList", "comments-area", "cookie-notice", "newsletter-signup-form", "sidebar left", "follow-us", "fb-comments"):
        assert html_text.named_so({"class": name}, False), name
    for name in ("social-science", "menu-of-the-day", "with-sidebar", "no-comments", "overflow-hidden", "headline", "advent", "post content", "notice-of-intent"):
        assert not html_text.named_so({"class": name}, False), name
    assert html_text.named_so({"id": "header"}, False) and not html_text.named_so({"id": "article-header"}, True)


def test_html_deep_pages_take_linear_time():
    import time

    took = []
    for n in (5_000, 40_000):
        began = time.perf_counter()
        assert html_text.main_text("<div> <span>" * n + "text, here." + "</b></i>" * n) == "text, here."
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * max(took[0], 0.02)


def test_media(spark):
    stored = media_avi.stored(frame(spark, ODD))
    out = media_avi.digests(stored).collect()
    assert len(out) == len(ODD)
    want = Counter()
    for i, t in ODD:
        p = media_avi.padded((t or "").encode())
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    assert media_avi.stored(frame(spark, [])).count() == 0
    found = media_avi.clips(stored.unionByName(spark.createDataFrame([(99, 0, None)], stored.schema))).collect()
    assert all(r.clips is None if r.doc_id == 99 else r.clips[0].start_ms == 0 for r in found)


def test_media_frames_by_the_general_decoder():
    payload = media_avi.padded(bytes(range(256)) * 9)
    avi = media_avi.encode_avi(payload)
    fps, places = media_avi.parse_avi(avi)
    assert fps == 24 and len(places) == len(payload) // 576
    slow = b"".join(media_avi.decode_jpeg(avi[o : o + s]).tobytes() for o, s in places)
    assert slow == payload == media_avi.read_frames(avi)[1].tobytes()
    bare = avi[: avi.index(b"idx1")]
    assert media_avi.parse_avi(bare)[1] == places
    with pytest.raises(ValueError, match="not an AVI"):
        media_avi.parse_avi(b"RIFX" + avi[4:])


def colour_jpeg(luma):
    """A baseline JPEG with 2x2 sampling of the first of three components, flat blocks of the given brightness."""
    rows, cols = luma.shape
    head = b"\xff\xd8" + media_avi._segment(media_avi.DQT, bytes([0, 8] + [1] * 63) + bytes([1, 8] + [1] * 63))
    head += media_avi._segment(media_avi.SOF0, bytes([8]) + (rows * 8).to_bytes(2, "big") + (cols * 8).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    head += media_avi._segment(media_avi.DHT, media_avi._table(0x00, media_avi.DC_LENGTHS) + media_avi._table(0x10, media_avi.AC_LENGTHS)) + media_avi._segment(media_avi.SOS, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    code = {sym: f"{c:0{n}b}" for (n, c), sym in media_avi._codes([len(media_avi.DC_LENGTHS.get(n, [])) for n in range(1, 17)], [x for n in sorted(media_avi.DC_LENGTHS) for x in media_avi.DC_LENGTHS[n]]).items()}
    bits, last = "", 128

    def block(d):
        cat = abs(d).bit_length()
        return code[cat] + (f"{d if d > 0 else d + (1 << cat) - 1:0{cat}b}" if cat else "") + "0"

    for y in range(0, rows, 2):
        for x in range(0, cols, 2):
            for k in range(4):
                now = int(luma[y + k // 2, x + k % 2])
                bits, last = bits + block(now - last), now
            bits += block(0) + block(0)
    bits += "1" * (-len(bits) % 8)
    return head + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def test_media_of_other_makers(spark):
    """Frames in colour, and files that are cut, empty or no AVI at all."""
    r = np.random.default_rng(2)
    luma = r.integers(60, 190, (4, 6)).astype(np.uint8)
    jpeg = colour_jpeg(luma)
    assert (media_avi.decode_jpeg(jpeg) == luma).all()
    payload = media_avi.padded(b"abc" * 400)
    avi = media_avi.encode_avi(payload)
    fps, places = media_avi.parse_avi(avi)
    frames = [jpeg + b"\0" * (len(jpeg) % 2), colour_jpeg(255 - luma)]
    movi = b"movi" + b"".join(media_avi._chunk(b"00dc", f) for f in frames)
    other = b"RIFF" + (4).to_bytes(4, "little") + b"AVI " + media_avi._chunk(b"LIST", movi)
    assert [f.tolist() for f in media_avi.read_frames(other)[1]] == [luma.tolist(), (255 - luma).tolist()]
    broken = [b"", b"RIFF", b"no video", avi[: places[1][0] + 40], other[:-30], avi[:12] + b"\0" * 50, avi[: places[0][0]] + b"\xff" * 60 + avi[places[0][0] + 60 :]]
    media = spark.createDataFrame([(0, 3, avi), (1, 3, other), (2, 3, None), *((10 + k, 3, b) for k, b in enumerate(broken))], "doc_id long, n_bytes long, media binary")
    found = {r.doc_id: r for r in media_avi.clips(media).collect()}
    assert found[0].clips and found[1].clips and found[2].clips is None and found[2].problem is None
    assert all(found[10 + k].clips is None and found[10 + k].problem for k in range(len(broken)))
    rows = media_avi.clip_rows(media).collect()
    assert {r.doc_id for r in rows} == set(found) and all((r.clip is None) == (found[r.doc_id].clips is None) for r in rows)
    digests = {r.doc_id: r for r in media_avi.digests(media).collect()}
    assert digests[0].payload_sha256 == hashlib.sha256(payload).hexdigest() and digests[12].payload_sha256 is None and digests[12].media_bytes == len(b"no video")


def test_shots():
    dark, light = np.full((24, 24), 10, np.uint8), np.full((24, 24), 240, np.uint8)
    frames = np.stack([dark] * 12 + [light] * 12 + [dark] * 6)
    assert media_avi.detect_shots(frames) == media_avi.detect_shots(list(frames)) == [(0, 11), (12, 23), (24, 29)]
    assert media_avi.timed([(0, 11)], 24) == [{"clip": 0, "first_frame": 0, "last_frame": 11, "start_ms": 0, "end_ms": 500}]


def test_shots_at_the_first_frame():
    dark, light, grey = (np.full((24, 24), v, np.uint8) for v in (10, 240, 120))
    half = dark.copy()
    half[:8] = 120
    for frames, want in (([dark, light], 2), ([dark, dark], 1), ([dark, half], 1), ([dark, *[light] * 9], 2), ([dark, *[half] * 9], 2), ([dark, light, grey, dark], 2), ([dark, half] * 5, 1)):
        shots = media_avi.detect_shots(np.stack(frames))
        assert shots == media_avi.detect_shots(frames) and len(shots) == want and (want == 1 or shots[0] == (0, 0)), (len(frames), shots)
    avi = media_avi.encode_avi(media_avi.padded(b"a" * 577))
    assert len(media_avi.detect_shots(media_avi.read_frames(avi)[1])) == 2


def test_token_rollup(spark, docs, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(lambda: [0, 0])
    for r in docs.collect():
        own = want[r.source, r.lang]
        own[0] += 1
        own[1] += len(library.encode(r.text, add_special_tokens=False).ids)
    assert {(r.source, r.lang): [r.docs, r.tokens] for r in queries.op6_token_rollup(spark, SF).collect()} == dict(want)


def test_rollup_batches(spark, tmp_path):
    row = lambda op, n, old=None, source="a": (source, "en", "v1", op, n, old)
    kind = "source string, lang string, version string, op string, tokens long, old_tokens long"
    store = token_counts.Rollup(spark, str(tmp_path))
    assert store.totals().count() == 0
    assert store.commit("one", spark.createDataFrame([row("insert", 10), row("insert", 5), row("insert", 7, source=None), row("insert", None)], kind))
    assert not store.commit("one", spark.createDataFrame([row("insert", 10)], kind))
    assert store.commit("two", spark.createDataFrame([row("delete", 5), row("revise", 12, 10), row("delete", 7, source=None)], kind))
    for _ in range(2):
        assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v1", 2, 12)]
        store.compact()
        assert not store.commit("two", spark.createDataFrame([row("insert", 10)], kind))
    store.commit("three", spark.createDataFrame([row("insert", 1)], kind))
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v1", 3, 13)]
    with pytest.raises(Exception, match="unknown op"):
        store.commit("bad", spark.createDataFrame([row("upsert", 1)], kind))
    assert "bad" not in store._done("deltas")
    assert token_counts.counted(frame(spark, ODD)).filter("tokens = 0").count() == 3
    assert token_counts.counted(frame(spark, [])).count() == 0


def test_rollup_race_and_failed_attempts(spark, tmp_path, monkeypatch):
    """A batch that is committed during a compaction counts once; what failed attempts leave behind counts not at all."""
    kind = "source string, lang string, version string, op string, tokens long, old_tokens long"
    of = lambda n: spark.createDataFrame([("a", "en", "v", "insert", n, None)], kind)
    store, late = token_counts.Rollup(spark, str(tmp_path)), token_counts.Rollup(spark, str(tmp_path))
    assert store.commit("../_one/ä b", of(1)) and not store.commit("../_one/ä b", of(1)) and store.commit("_two", of(2))
    sums = token_counts.Rollup._sums

    def meanwhile(self, deltas):
        if self is store:
            late.commit("late", of(40))
        return sums(self, deltas)

    monkeypatch.setattr(token_counts.Rollup, "_sums", meanwhile)
    store.compact()
    total = lambda: [(r.docs, r.tokens) for r in late.totals().collect()]
    assert total() == [(3, 43)] and late._done("deltas") == ["late"]
    monkeypatch.undo()
    # an attempt that failed while it wrote; a compaction that stopped before its base, and one before it dropped its deltas
    of(1000).select("source", "lang", "version").write.parquet(late._folder("cut off"))
    (tmp_path / "deltas" / "b-cut%20off" / "_SUCCESS").unlink()
    spark.createDataFrame([("late",)], "batch string").write.parquet(f"{tmp_path}/held/000000002")
    assert total() == [(3, 43)] and late.commit("cut off", of(5)) and total() == [(4, 48)]
    before = late._done("deltas")
    monkeypatch.setattr(late, "_folder", lambda batch: (_ for _ in ()).throw(OSError("stopped")) if late._done("base")[-1] == "000000002" else token_counts.Rollup._folder(late, batch))
    with pytest.raises(OSError, match="stopped"):
        late.compact()
    monkeypatch.undo()
    assert total() == [(4, 48)] and late._done("deltas") == before
    late.compact()
    late.compact()
    assert total() == [(4, 48)] and late._done("deltas") == [] and not late.commit("_two", of(2)) and not late.commit("cut off", of(5))


def test_scratch_folder_must_be_shared(spark):
    from unittest.mock import MagicMock

    from tidewright.llm import common

    cluster = MagicMock()
    cluster.conf.get.return_value = None
    cluster.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    cluster.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_dir(cluster)
    cluster.conf.get.return_value = "/shared"
    assert common.scratch_dir(cluster) == "/shared"
    # what was written since a mark goes, but for the last
    mark = common.saved_so_far()
    tables = [common.saved(spark.range(k + 1), "x") for k in range(3)]
    common.drop_saved(spark, mark, last=False)
    assert tables[2].count() == 3 and common.saved_so_far() == mark + 1
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound|no such file"):
        spark.read.parquet(tables[0].inputFiles()[0] if tables[0].inputFiles() else "/none").count()


def test_sample_is_bounded(spark):
    from tidewright.llm import labelled

    picked = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, y int")
    d = frame(spark, [(k, f"t{k}") for k in range(30)] + [(3, "t3")] * 20 + [(4, "x" * 99), (None, "t")])
    out = labelled.sampled(d, picked, 40, longest=50)
    assert [t for t, _ in out] == [f"t{k}" for k in range(30)] and len(labelled.sampled(d, picked, 7, longest=50)) == 7


def test_scores_against_plain_loops(spark):
    """Both classifiers' scores from their parameters, a document, a passage and a word at a time."""
    big = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    some = d.filter("doc_id < 60").select("doc_id", "text").collect() + [(900001, None), (900002, "")]
    model, toxic = quality_mil.train(d, labels), toxicity_pu.train(d, labels)
    few = frame(spark, [(r[0], r[1]) for r in some])
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    p = model.p
    got = {r.doc_id: r.score for r in quality_mil.score(few, model).collect()}
    for i, text in some:
        words = (text or "").encode().split()
        bags = [words[k : k + quality_mil.PASSAGE] for k in range(0, len(words), quality_mil.PASSAGE)] or [[]]
        hs, ss = [], []
        for bag in bags:
            body, n, x = b"".join(bag), max(1, len(bag)), []
            for c in quality_mil.CLASSES:
                x.append(sum(b in c for b in body) / max(1, len(body)))
            x += [sum(a == b for a, b in zip(bag, bag[1:], strict=False)) / n, len(set(bag)) / n, np.log1p(len(body) / n), sum(len(w) ** 2 for w in bag) / max(1, len(body)) / 16, sum(len(w) == 1 for w in bag) / n, np.log1p(len(bag)) / 4]
            if not bag:
                x = [0.0] * quality_mil.N_FEATURES
            h = np.tanh((np.array(x) - model.mean) / model.scale @ p["E"] + p["e"])
            hs.append(h)
            ss.append(np.exp((np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"]))
        z = sum(s * h for s, h in zip(ss, hs, strict=True)) / sum(ss)
        assert got[i] == pytest.approx(float(sigmoid(z @ p["c"] + p["d"][0])), abs=1e-4)
    got = {r.doc_id: r.score for r in toxicity_pu.score(few, toxic).collect()}
    for i, text in some:
        have = set()
        for w in (text or "").lower().split():
            w = w.strip(toxicity_pu.STRIPPED)
            have |= {w[:n] for n in range(3, 9) if len(w) > n} | {w + "$"}
        total = sum(w for f, w in zip(toxic.index, toxic.weights, strict=True) if f in have) + toxic.bias
        assert got[i] == pytest.approx(float(sigmoid(total)), abs=1e-9)


def test_attention_finds_the_passage_that_decides():
    """One passage in ten tells the label: attention picks it out, and beats the mean of all passages."""
    r = np.random.default_rng(11)
    bags = np.full(600, 10)
    X, y = r.normal(size=(6000, 6)), np.arange(600) % 2
    at = np.arange(600) * 10 + r.integers(0, 10, 600)
    X[at, 0] += 6  # stands out, whatever the label
    X[at, 1] = np.where(y == 1, 2.0, -2.0) + 0.3 * r.normal(size=600)
    X[:, 2] = r.normal(size=6000) * 3
    others = np.ones(6000, bool)
    others[at] = False
    X[others, 1] *= 2
    train, held = slice(0, 4000), slice(4000, 6000)
    model = quality_mil.GatedAttention(6).fit(X[train], bags[:400], y[:400].astype(float))
    found = model.forward(X[held], bags[400:])
    right = ((found["y"] >= 0.5) == (y[400:] == 1)).mean()
    assert right > 0.95 and found["a"].reshape(200, 10).argmax(1).tolist() == (at[400:] % 10).tolist()
    uniform = model.p | {"w": np.zeros_like(model.p["w"])}
    model.p = uniform
    assert ((model.forward(X[held], bags[400:])["y"] >= 0.5) == (y[400:] == 1)).mean() < right - 0.05


def test_substring_tells_texts_of_one_crc_apart(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(40)).encode() + b" " for c in "pq")
    met = {zlib.crc32(w, zlib.crc32(one)): w for w in (hashlib.md5(b"1%d" % k).hexdigest()[:9].encode() for k in range(300_000))}
    tail = next(w for w in (hashlib.md5(b"2%d" % k).hexdigest()[:9].encode() for k in range(2_000_000)) if zlib.crc32(w, zlib.crc32(two)) in met)
    a, b = (one + met[zlib.crc32(two + tail)]).decode(), (two + tail).decode()
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode()) and a != b
    data = [(None, a), (None, b), (7, one.decode() + "x")]
    out = substrings.digests(substrings.remove_repeats(frame(spark, data))).collect()
    assert Counter(tuple(r)[1:] for r in out) == Counter(substrings.brute_force([t for _, t in data]))
    assert b in {r.text for r in substrings.without_repeats(frame(spark, data)).collect()}
    texts = ["é" * n + "ab"[: n % 3] for n in range(90)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *substrings.checked(F.col("t"))).collect()
    assert all(tuple(r)[1:] == substrings.checks(r[0].encode()) for r in got)


def test_sentencepiece(spark, docs, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for giant, chunk in ((1 << 20, 1 << 18), (2000, 500)):
        out = {r.doc_id: (r.n_pieces, r.ids_crc32, r.restored) for r in pieces.encode(docs, giant=giant, chunk=chunk).collect()}
        for i, t in rows:
            ids = model.encode(t)
            assert out[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    back = pieces.decode(pieces.encode_chunks(docs, giant=2000, chunk=500, keep_ids=True))
    assert sorted(map(tuple, back.collect())) == rows
    odd = pieces.encode(frame(spark, ODD), giant=5000, chunk=1000).collect()
    assert len(odd) == len(ODD) and {(r.n_pieces, r.ids_crc32) for r in odd if r.doc_id in (1, 2)} == {(0, 0)}
    assert pieces.encode(frame(spark, [])).count() == 0


def test_sentencepiece_returns_rows_that_repeat(spark):
    giant, other = " ".join(f"w{k % 97}" for k in range(900)), " ".join(f"v{k % 89}" for k in range(900))
    data = [(1, giant)] * 3 + [(1, other), (2, giant), (None, giant), (None, giant), (None, other), (3, "so small"), (3, "so small"), (None, ""), (None, "")]
    d = frame(spark, data)
    whole = pieces.encode(d).collect()
    cut = pieces.encode(d, giant=1000, chunk=300).collect()
    assert len(cut) == len(data) and Counter(map(tuple, cut)) == Counter(map(tuple, whole))
    for size in (1000, 1 << 20):
        back = pieces.decode(pieces.encode_chunks(d, giant=size, chunk=300, keep_ids=True))
        assert Counter(map(tuple, back.collect())) == Counter(data)


def test_bpe_scan_equals_the_library(spark):
    """Cut anywhere: marks and runs of spaces, bytes, texts without any space; each row comes out."""
    r = np.random.default_rng(8)
    lattice = pieces.BpeLattice(pieces.BpePieces(pieces.default_model()))
    some = ["a", "the", "in", "ing", " ", "  ", "   ", "▁", "漢", "字", "\n", "é", "12", "====", "ation", "re", "<s>", "　", "\x00", "😀", "for", "(", "'s"]
    data = ["▁ 漢", "x ▁▁ y", " ", "▁"] + ["".join(r.choice(some, r.integers(0, 90))) for _ in range(800)]
    ids = lambda t: np.array(lattice.words.model.encode(t), "<u4").tobytes()
    for t in data:
        assert lattice.words.ids(t) == ids(t), t
        parts = pieces.chunks(pieces.normalised(t), int(r.integers(17, 40)), lattice.reach)
        matrices = [lattice.transfer(*p) for p in parts]
        states = pieces.boundary_states(matrices) if parts else []
        assert b"".join(lattice.trace(*p, i, j) for p, i, j in zip(parts, states[:-1], states[1:], strict=True)) == ids(t), t
    x, y, z = matrices[:3] if len(matrices) > 2 else [lattice.transfer(*p) for p in pieces.chunks(pieces.normalised("the thing in there " * 9), 30, lattice.reach)[:3]]
    assert pieces.combine(pieces.combine(x, y), z) == pieces.combine(x, pieces.combine(y, z))
    wide = "".join(r.choice(list("漢字的是不了人我在有他"), 3000))
    data = [(k, t) for k, t in enumerate([*data[:60], wide, wide])] + [(None, wide), (None, data[9])]
    want = Counter((i, len(ids(t)) // 4, zlib.crc32(ids(t)), "▁" not in t) for i, t in data)
    for giant in (40, 1 << 15):
        assert Counter(map(tuple, pieces.encode(frame(spark, data), giant=giant, chunk=25).collect())) == want
    plain = [(i, t) for i, t in data if "▁" not in t]
    back = pieces.decode(pieces.encode_chunks(frame(spark, plain), giant=40, chunk=25, keep_ids=True))
    assert Counter(map(tuple, back.collect())) == Counter(plain)


def test_max_plus_scan_equals_one_pass():
    r = np.random.default_rng(3)
    for _ in range(40):
        vocab = {"".join(r.choice(list("abc"), r.integers(1, 5))): -float(r.random() * 5) - 0.1 for _ in range(12)}
        model = pieces.Unigram(vocab)
        text = "".join(r.choice(list("abcd"), r.integers(0, 40)))
        score = lambda ps: sum(vocab.get(p, model.unknown) for p in ps)  # noqa: E731, B023
        best = [0.0] + [-np.inf] * len(text)
        for at in range(len(text)):
            for n, s in model.edges(text, at):
                best[at + n] = max(best[at + n], best[at] + s)
        for chunk in (1, 2, 3, 7, None):
            found = model.encode(text, chunk)
            assert "".join(found) == text and score(found) == pytest.approx(best[-1])
    x, y, z = (np.random.default_rng(k).normal(size=(4, 4)) for k in range(3))
    assert np.allclose(pieces.Unigram.combine(pieces.Unigram.combine(x, y), z), pieces.Unigram.combine(x, pieces.Unigram.combine(y, z)))


def test_crc_joins():
    a, b = b"hello", b"world" * 50
    assert pieces.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert pieces.crc_joined(0, zlib.crc32(b), len(b)) == zlib.crc32(b) and pieces.crc_joined(zlib.crc32(a), 0, 0) == zlib.crc32(a)
