"""Ordered packing, the divergence audit and the prefix trie against brute force and on odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewright.llm import divergence, ordered_packing, prefix_trie, queries, token_counts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids binary, start int, length string, sequence_id int, offset string"
LONG = " ".join(f"Word{k * k % 977}" + "." * (k % 19 == 0) for k in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Same words. Here!"), (5, "Same words. Here!"), (5, "Same words. Here!"), (None, "Alone é"), (None, None), (7, LONG), (8, "x" * 30_000), (9, "<|endoftext|> \x1c  x\ny İΣ")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), b"x", 1, "s", 2, "o") for i, t in rows], SCHEMA)


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(ordered_packing.default_tokenizer())
    return [np.array([*e.ids, 1], "<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packing(out, docs, capacity=2048):
    """All ids once, windows gapless, within capacity, in order of the documents (a list of (id, text))."""
    ids = library_ids([t for _, t in docs])
    stream, lengths = b"".join(ids), [len(x) // 4 for x in ids]
    rows = sorted(out, key=lambda r: (r.sequence_id, r.offset))
    at, seen = 0, {}
    for k, r in enumerate(rows):
        new = k == 0 or rows[k - 1].sequence_id != r.sequence_id
        assert r.offset == (0 if new else rows[k - 1].offset + rows[k - 1].length) and r.offset + r.length <= capacity
        assert r.ids_crc32 == zlib.crc32(stream[4 * at : 4 * (at + r.length)])
        seen.setdefault(r.sequence_id, 0)
        seen[r.sequence_id] += r.length
        at += r.length
    assert at == sum(lengths)
    pieces = iter(rows)
    for (doc, _), n in zip(docs, lengths, strict=True):
        got = 0
        while got < n:
            r = next(pieces)
            assert (r.doc_id, r.start, r.doc_tokens) == (doc, got, n)
            got += r.length
    return list(seen.values())


def test_word_ids_are_the_librarys(spark):
    bpe = ordered_packing.WordBpe(ordered_packing.default_tokenizer(), keep=300)
    r = np.random.default_rng(3)
    letters = list("aabcdeéüßñ.,'’!?12³½<|>sStTreRElLΣσİ\x1c\x00 ́一二ABC_-\t\r\n  ")
    texts = ["".join(r.choice(letters, r.integers(0, 40))) for _ in range(3000)] + [t for _, t in ODD if t]
    want = library_ids(texts)
    for most in (1 << 20, 200, 7):
        got = [ids for k in range(0, len(texts), 64) for ids, *_ in bpe.documents(texts[k : k + 64], most)]
        assert [g + (1).to_bytes(4, "little") for g in got] == want


def test_packing_keeps_all_ids_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    want = [(r.doc_id, r.text) for r in docs.collect()]
    sums = check_packing(ordered_packing.pack_in_order(docs).collect(), want)
    pad = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sums)
    assert pad < 0.02 * sum(sums)
    got = ordered_packing.padding(ordered_packing.pack_in_order(docs)).first()
    assert (got.sequences, got.tokens, got.padding) == (len(sums), sum(sums), pad)
    assert queries.op11_ordered_packing(spark, SF).agg({"length": "sum"}).first()[0] == sum(sums)


@pytest.mark.parametrize(("capacity", "settle"), [(2048, 1 << 15), (64, 1), (100, 50)])
def test_packing_of_odd_rows(spark, capacity, settle):
    out = ordered_packing.pack_in_order(frame(spark, ODD).coalesce(1), capacity=capacity, settle=settle, keep_ids=True)
    rows = out.collect()
    check_packing(rows, ODD, capacity)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert ordered_packing.pack_in_order(frame(spark, []), capacity=capacity).count() == 0


def test_packing_in_a_given_order(spark):
    rows = [(k * 37 % 101, f"Text {k}. More of it.") for k in range(101)]
    out = ordered_packing.pack_in_order(frame(spark, rows).repartition(3), order_by=["doc_id"], capacity=32).collect()
    check_packing(out, sorted(rows), 32)


@pytest.mark.parametrize("capacity", [16, 40, 64])
def test_cuts_cost_the_least(capacity):
    """Against a programme that tries every window; with windows settled early or late, the same cuts."""
    r = np.random.default_rng(capacity)
    for _ in range(30):
        places, costs, base = [], [], 0
        for _ in range(r.integers(1, 25)):
            n = int(r.integers(1, 90))
            at, cost = ordered_packing.cuts(n, np.unique(r.integers(0, n + 1, r.integers(0, 6))), max(1, capacity // 8), 8, 64)
            places += (at + base).tolist()
            costs += cost.tolist()
            base += n
        def pad(n):
            return 0 if n & (n - 1) == 0 else capacity - n
        where, least = [0, *places], [0]
        for j in range(1, len(where)):
            least.append(min(least[i] + pad(where[j] - where[i]) for i in range(j) if where[j] - where[i] <= capacity) + 1 + costs[j - 1])
        found = []
        for every in (1, 7, 10_000):
            cutter, ends = ordered_packing.Cutter(capacity), []
            for k in range(0, len(places), every):
                cutter.extend(np.array(places[k : k + every]), np.array(costs[k : k + every]))
                ends += cutter.settled()
            ends += cutter.finish()
            own = dict(zip(places, costs, strict=True))
            assert sum(pad(b - a) + 1 + own[b] for a, b in zip([0, *ends], ends, strict=False)) == least[-1]
            found.append(ends)
        assert found[0] == found[1] == found[2]


def audit_brute(rows, least=30, top=50):
    """rows: (lang, source, text)."""
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(w for x, _, ws in docs if x == lang for w in set(ws))
        kept = [w for w, n in df.items() if n >= least]
        counts = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, ws in docs:
            if x == lang:
                counts[s].update(ws)
        whole = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 5) // total for w in kept}

        q, p = shares(whole), {s: shares(c) for s, c in counts.items()}
        for s, c in counts.items():
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in p if o != s)
            terms = sorted((q[w] - p[s][w], w.encode()) for w in kept if c[w] > 0 and p[s][w] > q[w])[:top]
            out += [(lang, s, part, i.decode(), -v, k) for part, x in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(x, 1)]
    return sorted(out)


AUDIT = "text string, lang string, source string, n int, docs int, term string, doc_id long, p long, block int"


def audit_frame(spark, rows):
    return spark.createDataFrame([(t, lang, s, 1, 2, "x", 3, 4, 5) for lang, s, t in rows], AUDIT)


@pytest.mark.parametrize("options", [{}, {"rows": 1, "width": 3}, {"rows": 4, "width": 16}])
def test_audit(spark, options):
    """Also with strips of few sources and tiles of few terms."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = audit_brute([(r.lang, r.source, r.text) for r in docs.collect()], 8, 5)
    assert sorted(map(tuple, divergence.audit(docs, least_docs=8, top=5, **options).collect())) == want and {w[2] for w in want} == {"pair", "term"}


def test_audit_of_odd_rows(spark):
    data = [(None, None, None), ("en", None, ""), ("en", "b", "Éa b-b É \x00a"), ("en", "b", "Éa b-b É \x00a"), ("en", "a", "word " * 300_000 + "Z"), ("en", "only", "1 2 3"), ("de", "s", "ein"), ("de", "t", "ein zwei zwei"), ("", "s", "x")]
    for options in ({"least_docs": 1}, {"least_docs": 2, "rows": 1, "width": 1}, {"least_docs": 30}):
        got = divergence.audit(audit_frame(spark, data), top=3, **options).collect()
        assert sorted(map(tuple, got)) == audit_brute(data, options["least_docs"], 3)
    assert divergence.audit(audit_frame(spark, [])).count() == 0
    assert [divergence.term_counts(audit_frame(spark, data), most=k).agg({"n": "sum"}).first()[0] for k in (1, 400_000)] == [300_016, 300_016]


def test_k2_tree_sums():
    r = np.random.default_rng(1)
    for ra, rb, cols, share in ((5, 3, 40, 0.1), (1, 9, 8, 0.9), (4, 4, 64, 0.0), (7, 7, 33, 0.3)):
        for same in (False, True) if ra == rb else (False,):
            m = [np.where(r.random((n, cols)) < share, r.integers(1, 1000, (n, cols)), 0) for n in (ra, rb)]
            m[1] = m[0] if same else m[1]
            zero = [r.integers(1, 1000, n) for n in (ra, rb)]
            zero[1] = zero[0] if same else zero[1]
            height = int(max(cols, ra, rb) - 1).bit_length()
            trees = [divergence.K2Tree(*np.nonzero(x), x[np.nonzero(x)], height) for x in m]
            sums, seen = divergence.joint_sums(*trees, *zero, same, most=7)
            for g in range(ra):
                for h in range(rb):
                    on = (m[0][g] > 0) | (m[1][h] > 0)
                    off = np.abs(np.where(m[0][g] > 0, m[0][g], zero[0][g]) - np.where(m[1][h] > 0, m[1][h], zero[1][h]))
                    assert (sums[g, h], seen[g, h]) == ((off[on].sum(), on.sum()) if not same or g < h else (0, 0))


TURNS = "conv_id long, turn long, role string, text string, path int, words string, kind int, key string"


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", 2, "k") for r in rows], TURNS)


def trie_brute(rows):
    """rows: (conv_id, turn, role, text), no two turns of a conversation alike in number unless they are repeats."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:])
    members = defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_trie(spark):
    convs = spark.read.parquet(f"{SF}/conversations.parquet")
    want = trie_brute([(r.conv_id, r.turn, r.role, r.text) for r in convs.collect()])
    assert trie_rows(queries.op13_prefix_trie(spark, SF)) == want and len(want) > 50


@pytest.mark.parametrize("shard", [1 << 20, 40, 7])
def test_trie_of_odd_rows(spark, shard):
    """Many conversations alike, one long, nulls, repeats; with nodes over many shards."""
    rows = [(c, k, "user" if k % 2 else None, f"turn {k} of  {c % 3 if k > 2 else 0}") for c in range(0, 90) for k in range(1 + c % 5)]
    rows += [(1000 + c, k, "user", f"same {k}") for c in range(0, 400, 20) for k in range(4)]
    rows += [(501, k, "a", str(k % 3)) for k in range(200)] + [(None, 1, "a", "b"), (None, None, None, None), (-7, 1, None, None), (-20, None, "x", ""), (-20, 1, "x", "y z")]
    rows += [(77, 9, "twice", "t"), (77, 9, "twice", "t"), (78, 3, "long", "w " * 50_000), (2007, 1, "", "")]
    assert trie_rows(prefix_trie.prefix_trie(turn_frame(spark, rows), turns_a_shard=shard)) == trie_brute(rows)


def test_trie_of_few_rows(spark):
    assert prefix_trie.prefix_trie(turn_frame(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(turn_frame(spark, [(None, 1, "a", "b")])).count() == 0
    for rows in ([(3, 1, "a", "b")], [(2, 1, None, None), (1, 1, None, None)], [(20, 1, "a", "b"), (21, 1, "c", "d"), (22, 1, "c", "d")]):
        assert trie_rows(prefix_trie.prefix_trie(turn_frame(spark, rows))) == trie_brute(rows)


@pytest.mark.parametrize("width", [1, 3, 64])
def test_matrix_blocks_sort_alike(width):
    r = np.random.default_rng(width)
    lengths = r.integers(0, 9, 200)
    digests = r.integers(0, 3, (int(lengths.sum()), 2)).astype(np.uint64)
    m, last = prefix_trie.Matrix(lengths, digests, width), r.permutation(200)
    seqs = [tuple(map(tuple, digests[a : a + n].tolist())) for a, n in zip(m.first.tolist(), lengths.tolist(), strict=True)]
    order = m.sort(last)
    assert order.tolist() == sorted(range(200), key=lambda k: (seqs[k], last[k]))
    alike = [next((d for d in range(9) if seqs[a][: d + 1] != seqs[b][: d + 1] or d == len(seqs[a])), 0) for a, b in zip(order, order[1:], strict=False)]
    assert m.shared(order).tolist() == [-1, *alike]


def test_rollup_history_stays_small(spark, tmp_path):
    """Many compactions: few folders of bases and names are left, and every batch is still known."""
    store = token_counts.Rollup(spark, str(tmp_path), most=3, buckets=4)
    one = spark.createDataFrame([("s", "en", "v", "insert", 2, None)], "source string, lang string, version string, op string, tokens long, old_tokens long")
    for k in range(9):
        assert store.commit(f"batch {k}", one)
        store.compact()
        assert not store.commit(f"batch {k // 2}", one)
    assert [(r.docs, r.tokens) for r in store.totals().collect()] == [(9, 18)]
    assert len(store._done("base")) == 2 and len(store._names()) <= 4
    assert store._held([f"batch {k}" for k in range(12)]) == {f"batch {k}" for k in range(9)}
