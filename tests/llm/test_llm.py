"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats and no rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import ann, chat, decontaminate, jaccard, lattice, mixing, quality, sharding, toxicity, wavelet
from lacuna.llm.components import components
from lacuna.llm.queries import tokenizer_file

WORDS = "the of and oak river stone light under over green winter song market harbour quiet letter".split()


def prose(n: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.integers(0, 40)}" for _ in range(n))


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


BASE = prose(120, 1)
NEAR = " ".join(BASE.split()[:-2] + ["changed", "end"])
TEXTS = [BASE, NEAR, BASE, None, "", "   \n\t", "word", "Word", prose(3, 2), prose(5000, 3), prose(60, 4), prose(60, 4) + " tail", "ÉCLAIR éclair <|endoftext|> it's 12,5 a.b", "x" * 30000, BASE.upper()]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en", None if i == 4 else f"s{i % 3}", "clash") for i, t in enumerate(TEXTS)] + [(0, BASE, "en", "s0", "clash"), (None, "no id here", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, score string")


def test_wavelet_matrix_answers_as_the_list_does():
    rng = np.random.default_rng(1)
    for n, a in ((0, 1), (1, 1), (300, 5), (150_000, 900)):
        x = rng.integers(0, a, n).astype(np.uint32) * 3
        m = wavelet.WaveletMatrix(wavelet.encode_matrix(x))
        assert (m.decode() == x).all()
        for i in rng.integers(0, max(n, 1), 15) if n else []:
            i, t = int(i), int(x[i])
            k = m.rank(t, i)
            assert (m.access(i), k, m.count(t), m.select(t, k)) == (t, (x[:i] == t).sum(), (x == t).sum(), i)
        assert m.select(1, 0) == -1 and m.rank(1, n) == 0


def test_token_files_round_trip(spark, documents, nothing, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_file())
    for df, seg in ((documents, 500), (nothing, 500)):
        path = f"file://{tmp_path}/t{df.count()}"
        wavelet.write_tokens(df, path, tokenizer_file(), segment_tokens=seg)
        got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.read_documents(spark, path).collect())
        want, at = [], 0
        for i, t in sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert got == want


def test_token_files_answer_counts_places_and_tokens(spark, documents, nothing, tmp_path):
    path = f"file://{tmp_path}/t"
    wavelet.write_tokens(documents, path, tokenizer_file(), segment_tokens=300, most_tied=1)
    rows = [r for r in spark.read.parquet(path).orderBy("shard", "segment").collect()]
    ids = np.concatenate([wavelet.WaveletMatrix(r["matrix"]).decode() for r in rows]).astype(int)
    assert [r["doc_id"] for r in wavelet.read_documents(spark, path).orderBy("start").collect()] == sorted((r["doc_id"] for r in documents.collect()), key=lambda i: (i is not None, i))
    asked = [1, int(ids[0]), int(ids[len(ids) // 2]), 48_999]
    assert {r["token"]: r["n"] for r in wavelet.count_tokens(spark, path, asked).collect()} == {t: int((ids == t).sum()) for t in asked}
    assert sorted((r["token"], r["at"]) for r in wavelet.find_tokens(spark, path, asked).collect()) == sorted((t, int(i)) for t in set(asked) for i in np.flatnonzero(ids == t))
    at = [0, 5, len(ids) - 1, len(ids) // 3, 5, len(ids), -1]
    got = {r["at"]: r["token"] for r in wavelet.tokens_at(spark, path, spark.createDataFrame([(i,) for i in at], "at long"), page=64).collect()}
    assert got == {i: int(ids[i]) for i in set(at) if 0 <= i < len(ids)}
    with pytest.raises(TypeError):
        wavelet.write_tokens(documents.withColumn("doc_id", F.lit("a")), path + "x", tokenizer_file())


def test_encoding_by_word_equals_encoding_whole_texts():
    texts = pa.array([t or "" for t in TEXTS] + ["don't. 'tis, x'.", "ǅ. İstanbul.,! naïve…", "<|ENDOFTEXT|> A.,", "a\x0bb\x0cc\x1cd"])
    for some in (texts, texts.slice(0, 11)):
        a = wavelet.encode_texts(some, tokenizer_file(), 1)
        b = wavelet.encode_texts(some, tokenizer_file(), 1, by_word=False)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_marks_after_letters_that_the_normalizer_takes_apart():
    ends = ["\u0130", "\u09b9\u09df", "\u095e", "\ufb2a", "\u0f43", "\u03a3", "\u1100\u1161", "e\u0301"]
    texts = pa.array([f"{e}. x{e}?! {e},;y{e}: {e}" for e in ends] + [" ".join(f"a{chr(c)}." for c in range(128, 0x30000) if chr(c).isalpha())])
    a = wavelet.encode_texts(texts, tokenizer_file(), 1)
    b = wavelet.encode_texts(texts, tokenizer_file(), 1, by_word=False)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_decontamination_against_brute_force(spark, documents, nothing):
    items = [(1, " ".join(BASE.split()[10:40]).title()), (2, "word"), (3, None), (4, "..."), (5, prose(20, 9)), (10, " ".join(BASE.split()[12:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))

    want = {}
    for r in documents.collect():
        w, hit, found = words(r["text"]), set(), set()
        for i, t in items:
            own = words(t)
            n = min(len(own), 13)
            for k in range(len(own) - n + 1 if own else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == own[k : k + n]:
                        hit |= set(range(j, j + n))
                        found.add(i)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want[r["doc_id"]] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    for block in (400_000, 7):
        out = decontaminate.decontaminate(documents, bench, block_windows=block)
        got = out.collect()
        assert len(got) == documents.count() and "score" in out.columns
        assert all((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want[r["doc_id"]] for r in got)
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert decontaminate.decontaminate(documents, bench.limit(0)).where("n_hit > 0").count() == 0


def linked(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = blank_words(t)
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, min(len(w), 1)))))
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in sets:
        for b in sets:
            if a < b and any(x & y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sets, {i: root(i) for i in sets}


@pytest.mark.parametrize(("light", "often"), [(24, 64), (1, 2)])
def test_jaccard_groups_against_brute_force(spark, documents, nothing, light, often):
    more = [(100 + i, " ".join(w for j, w in enumerate(BASE.split()) if j not in (i, i + 5)), "en", "s", "") for i in range(8)]
    df = documents.unionByName(spark.createDataFrame(more, documents.schema))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    sets, root = linked([r for r in rows if r[0] is not None], 4, 85)
    got = jaccard.jaccard_groups(df, 4, 85, often=often, light=light).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == root[r["doc_id"]] and r["n_shingles"] in [len(s) for s in sets[r["doc_id"]]]
    assert jaccard.jaccard_groups(nothing).count() == 0


def test_set_trie_finds_what_comparing_all_finds():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(80)]
    trie = jaccard.SetTrie(sets)
    for a in sets:
        want = {i for i, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b))}
        assert set(trie.similar(a, 60)) == want


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(10, 41)} == {10} and {got[i] for i in range(100, 140)} == {100} and 7 not in got


def test_lattice_sums_all_segmentations():
    pieces, p = [b" ", b"a", b"b", b"ab", b" a", b"ba", b" ab"], np.array([0.1, 0.2, 0.1, 0.2, 0.1, 0.2, 0.1])

    def brute(s):
        return 1.0 if not s else sum(q * brute(s[len(x) :]) for x, q in zip(pieces, p, strict=True) if s.startswith(x))

    words = [b"a", b"ab", b"abba", b"bab", b"aabbab"]
    out, used = lattice.Lattice(pieces, np.log(p)).run(words, np.ones(5))
    assert np.allclose(np.exp(out), [brute(b" " + w) for w in words]) and used.sum() > 0


def test_lattice_of_long_words_goes_by_stretches():
    rng = np.random.default_rng(2)
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"abba", b"bbbab"]
    p = rng.dirichlet(np.ones(len(pieces)))
    words = [bytes(rng.choice(list(b"ab"), n).tolist()) for n in (1, 5, 40, 41, 95)]
    trie, n = lattice.Lattice(pieces, np.log(p)), np.arange(1.0, 6.0)
    (a, x), (b, y) = trie.run(words, n), trie.run(words, n, long=7)
    assert np.allclose(a, b) and np.allclose(x, y) and np.allclose(trie.run(words, long=11)[0], a)


def test_start_weights_alone_score_texts(spark, documents):
    got = lattice.score_texts(documents, tokenizer_file("piece_bpe_32k.model"), rounds=0)
    assert got.count() == documents.count() and got.where("score IS NULL OR score >= 0").count() == 0


@pytest.mark.parametrize("common", [200_000, 3, 0])
def test_lm_scores_against_brute_force(spark, documents, nothing, common):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    tokens = [(i, [*blank_words(t), None]) for i, t in rows]
    count = Counter(w for i, t in tokens for w in t if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1)
    total = sum(count.values())
    want = sorted((i is not None, i or 0, len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in t), 6)) for i, t in tokens)
    got = lattice.score_texts(documents, tokenizer_file("piece_bpe_32k.model"), rounds=1, most_common=common).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == total and math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    if common == 3:
        assert lattice.score_texts(nothing, tokenizer_file("piece_bpe_32k.model"), rounds=1).count() == 0


def best_capacity(sizes, k):
    lo, hi = -(-sum(sizes) // k), sum(sizes)
    while lo < hi:
        mid, at, used = (lo + hi) // 2, 0, 1
        for s in sizes:
            if s > mid:
                used = k + 1
            at, used = (at + s, used) if at + s <= mid else (s, used + 1)
        lo, hi = (lo, mid) if used <= k else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("fineness", [2048, 3])
def test_shards_are_minimax(spark, documents, nothing, fineness, monkeypatch):
    if fineness == 3:
        whole = sharding.minimax_cuts
        monkeypatch.setattr(sharding, "minimax_cuts", lambda *a: whole(*a, fineness=3))
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.md5(text).alias("g"))
    got = sharding.shard_by_bytes(rows, 4, F.col("g")).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r["g"]].append(r)
    assert all(len({r["shard"] for r in g}) == 1 for g in groups.values()) and len(got) == documents.count()
    order = sorted(groups.values(), key=lambda g: (min(-1 if r["doc_id"] is None else r["doc_id"] for r in g), g[0]["g"]))
    sizes = [sum(r["size"] for r in g) for g in order]
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) == best_capacity(sizes, 4)
    for s in load:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    empty = nothing.select("doc_id", F.lit(1).cast("long").alias("size"), F.md5("text").alias("g"))
    assert sharding.shard_by_bytes(empty, 4, F.col("g")).count() == 0


@pytest.mark.parametrize("fineness", [2048, 3])
def test_cuts_of_uneven_sizes(spark, fineness):
    rng = np.random.default_rng(2)
    n = 3000 if fineness == 2048 else 200
    giant = rng.integers(1, 300, n)
    giant[n // 3] = giant.sum()
    for sizes in (giant, np.ceil(rng.lognormal(3, 2.5, n)).astype(np.int64), np.full(n, 7), np.array([5])):
        start = np.cumsum(sizes) - sizes
        groups = spark.createDataFrame([(int(a), int(b)) for a, b in zip(start, sizes, strict=True)], "start long, size long")
        capacity, cuts = sharding.minimax_cuts(groups, 6, fineness=fineness)
        assert capacity == best_capacity(sizes.tolist(), 6) and cuts[-1] == sizes.sum()
        assert set(cuts) <= {0, *(start + sizes).tolist()} and max(np.diff([0, *cuts])) == capacity


def test_shards_of_clashing_columns_and_a_hot_group(spark):
    rows = [(i, 5, "hot" if i % 3 else f"g{i}", i, f"mine{i}", -1, i) for i in range(300)] + [(None, 5, "hot", 0, "mine", -1, 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, size long, g string, start long, `group` string, shard int, part long")
    got = sharding.shard_by_bytes(df, 4, F.col("g")).collect()
    assert len(got) == 302 and all(r["group"] in (f"mine{r['doc_id']}", "mine") and r["part"] == (r["doc_id"] or 0) for r in got)
    assert len({r["shard"] for r in got if r["g"] == "hot"}) == 1
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_mix_meets_targets(spark, documents, nothing):
    rows = documents.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.mix(rows).collect()
    assert len(got) == documents.count() and sum(r["size"] for r in got) == sum(len(blank_words(r["text"])) for r in documents.collect())
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    assert sum({s: g[0]["target"] for s, g in by.items()}.values()) == pytest.approx(sum(r["size"] for r in got))
    for g in by.values():
        assert abs(sum(r["taken"] for r in g) - g[0]["target"]) <= max(r["size"] for r in g) and all(r["taken"] <= 3 * r["size"] for r in g)
        assert g[0]["target"] <= 3 * g[0]["source_size"] + 1e-9
    again = mixing.mix(rows.repartition(2)).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in again) == sorted((str(r["doc_id"]), r["taken"]) for r in got)
    many = Counter(r["doc_id"] for r in mixing.mixed(documents).collect())
    for r in got:
        if r["size"] and r["doc_id"] != 0:
            assert many[r["doc_id"]] == r["taken"] // r["size"]
    assert mixing.mix(rows.limit(0)).count() == 0 and mixing.mixed(nothing).count() == 0


def test_mixed_cuts_among_rows_without_ids(spark):
    for own in (lambda i: f"w{i} " * 10, lambda i: "same " * 10, lambda i: f"w{i // 50} " * 10):
        rows = [(None, own(i), "a") for i in range(100)] + [(i, "x " * 7, "b") for i in range(30)] + [(None, "", "b"), (None, None, None), (None, "y", None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
        for weights, share in (((1, 1, 1), 0.3), ((5, 1, 1), 0.7), ((5, 2, 1), 1.4)):
            want = Counter({r["source"]: r["n"] for r in mixing.mix(sizes, weights, share).groupBy("source").agg(F.sum("taken").alias("n")).collect()})
            got = Counter()
            for r in mixing.mixed(docs, weights, share).collect():
                got[r["source"]] += len(blank_words(r["text"]))
            assert {s: n for s, n in got.items() if n} == {s: n for s, n in want.items() if n}


def test_quality_learns_and_holds_out(spark, nothing):
    rows = [(i, prose(40, i) if i % 4 else " ".join(w.upper() + "!!" for w in prose(40, i).split())) for i in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 4 > 0) for i in held]) > 0.97
    flat = quality.fit(docs, labels.limit(0))
    assert quality.score(docs.withColumn("score", F.lit("old")), flat).where("score = 0.5").count() == len(rows)
    assert quality.score(nothing, flat).count() == 0


def test_toxicity_finds_words_and_spans(spark, nothing):
    rows = [(i, prose(30, i) + (" Écoute vilefoo, you dumbbar! " if i % 5 == 0 else " ") + prose(30, i + 5000)) for i in range(600)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    field = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.tag(docs, field).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i]["score"] >= 0.7) == (i % 5 == 0) for i in held]) > 0.97
    marked = {r["text"][s["start"] : s["end"]] for r in got.values() for s in r["spans"]}
    assert {"vilefoo", "dumbbar"} <= marked
    flat = toxicity.fit(docs, labels.limit(0))
    assert toxicity.tag(docs, flat).count() == len(rows) and toxicity.tag(nothing, field).count() == 0


def test_toxic_words_are_not_crowded_out_by_frequent_ones(spark):
    rng, many = np.random.default_rng(8), 205_000
    often = [f"w{i}" for i in range(many)]

    def texts(times: int) -> list[str]:
        line = [often[i] for _ in range(times) for i in rng.permutation(many)]
        return [" ".join(line[i : i + 5000]) for i in range(0, len(line), 5000)]

    bad = texts(5)
    for i in range(4):
        bad[i] += " vilefoo"
    rows = [(t, 1) for t in bad] + [(t, 0) for t in texts(10)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    field = toxicity.fit(docs, labels, held=3, strength=-1.0)
    w = toxicity.W.words(pa.array(["vilefoo"]), 0, 1, toxicity.W.ALNUM_WORDS)
    assert field.words.keys.tolist() == w.hashes().tolist() and len(field.odds) == 1


def test_gradient_of_the_field_and_its_likelihood():
    rng, odds, n = np.random.default_rng(1), np.array([1.0, 2.0, 3.0]), 7
    lists = {c: [] for c in ("k", "before", "after", "shape", "affix")}
    for _ in range(n):
        m = int(rng.integers(1, 6))
        k = np.where(rng.random(m) < 0.4, rng.integers(0, 3, m), -1)
        own = {"k": k, "before": np.append(k[1:] >= 0, False), "after": np.insert(k[:-1] >= 0, 0, False), "shape": rng.integers(0, toxicity.LOOKS, m), "affix": rng.integers(0, toxicity.LOOKS, m)}
        for c in lists:
            lists[c].append(own[c].astype(int).tolist())
    runs = toxicity.Runs.of(lists, rng.integers(0, 2, n))
    w = toxicity.Weights(rng.normal(size=3), rng.normal(size=toxicity.LOOKS) * 0.3, rng.normal(size=4), rng.normal(size=(2, 2)))
    log_p, grads = toxicity.likelihood(runs, odds, w)
    brute = 0.0
    for i in range(n):
        m = int(runs.live[i].sum())
        e = [w.evidence(odds, *(np.array([v[i, j]]) for v in (runs.k, runs.before, runs.after, runs.shape, runs.affix)))[0] if runs.k[i, j] >= 0 or runs.before[i, j] or runs.after[i, j] else w.shared[0] for j in range(m)]
        weight = lambda s: sum(w.step[a, b] for a, b in zip([0, *s], s, strict=False)) + sum(x for x, b in zip(e, s, strict=True) if b)  # noqa: B023, E731
        brute += weight(runs.tag[i, :m].tolist()) - math.log(sum(math.exp(weight([(c >> j) & 1 for j in range(m)])) for c in range(2**m)))
    assert log_p == pytest.approx(brute)
    for x, g in zip(w.parts(), grads, strict=True):
        for i in np.ndindex(x.shape):
            old = x[i]
            up, down = (toxicity.likelihood(runs, odds, w)[0] for x[i] in (old + 1e-5, old - 1e-5))
            x[i] = old
            assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_columns_of_any_name_pass_through(spark):
    names = ["_quality", "_score", "_spans", "_hit", "_items", "_n_words", "_n_hit", "h", "y", "row", "key", "_key", "_start", "_n", "target", "n_words"]
    rows = [(i, f"{prose(20, i)} {'vilefoo' if i % 2 else ''}", f"s{i % 2}", *[f"{c}{i}" for c in names]) for i in range(40)] + [(None, None, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, source string", *[f"`{c}` string" for c in names]]))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(20, 3))], "item_id long, text string")

    def same(out, new=()):
        kept = [c for c in docs.columns if c not in new]
        assert sorted(map(str, out.select(*kept).collect())) == sorted(map(str, docs.select(*kept).collect()))

    same(quality.score(docs, quality.fit(docs, labels)))
    same(toxicity.tag(docs, toxicity.fit(docs, labels)))
    out = decontaminate.decontaminate(docs, bench)
    same(out, ("n_words",))
    assert [r["doc_id"] for r in out.where("contaminated").collect()] == [3]
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    same(mixing.mix(sized), ("target",))
    own = {str(r) for r in docs.collect()}
    assert all(str(r) in own for r in mixing.mixed(docs).collect())


def test_field_marginals_equal_enumeration():
    words = toxicity.W.Found(np.array([5, 9], np.uint64))
    f = toxicity.Field(words, np.array([1.0, 2.0]), np.array([0.5, -0.3]), np.array([-1.0, 0.7, 0.2, 0.1]), np.array([[0.0, -0.8], [0.3, -0.1]]), (1.0, 0.0))
    place, k = np.array([1, 2, 5]), np.array([0, -1, 1])
    e = f.evidence(k, np.array([0, 0, 0]), np.array([0, 1, 0]))
    each = np.full(7, f.shared[0])
    each[place] = e
    total, toxic = 0.0, np.zeros(7)
    for code in range(2**7):
        s = [(code >> i) & 1 for i in range(7)]
        w = math.exp(sum(f.step[a, b] for a, b in zip([0, *s], s, strict=False)) + sum(x for x, b in zip(each, s, strict=True) if b))
        total += w
        toxic += w * np.array(s)
    got = f.marginals(np.zeros(3, np.int64), place, e, np.array([7]))
    assert np.allclose(got, (toxic / total)[place])


def test_chat_round_trip_and_windows(spark):
    for t in ["<s>", "<\\s>", "<\\\\/s> [INST] x [\\/INST]", "<<SYS>> <<</SYS>>", "<</s>", "[ROLE][[/ROLE]", "a<", "\\", "", " x "]:
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)
        for r in ("user", "assistant", "system", "tool[", "x</s>", ""):
            assert list(chat.parsed(chat.formatted(r, t)[0] * 2)) == [(r, t)] * 2
    rows = [(1, 0, "system", "be kind"), *[(1, i, "user" if i % 2 else "assistant", f"{prose(12, i)} </s>") for i in range(1, 30)], (2, 0, None, None), (2, 0, None, None), (2, 1, "assistant", prose(300, 7)), (None, 5, "user", "hi"), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")
    for budget, history in ((64, 20), (10_000, 0), (5, 5)):
        w = chat.chat_windows(df, budget, history)
        got = {r["conv_id"]: r for r in chat.digests(w).collect()}
        for c in {r[0] for r in rows}:
            own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
            said = "".join(t for _, r, t in own if r == "assistant")
            assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
            assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert all(r["n_tokens"] <= budget or r["n_new"] == 1 for r in w.collect())
        if budget == 64:
            assert all("be kind" in r["text"] for r in w.where("conv_id = 1").collect()) and w.where("n_repeated > 1").count()
    assert chat.digests(chat.chat_windows(df.limit(0))).count() == 0


def test_nearest_on_odd_vectors_and_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 24)).astype(np.float32)
    x[400:900] = x[400]
    odd = [(3000, None), (3020, [0.0] * 24), (3040, [float("nan")] * 24), (3060, [1.0, None] + [0.0] * 22), (3080, [1.0]), (None, [1.0] * 24)]
    same = [(40, [9.0] * 24), (41, [-9.0] * 24), (40, [float(v) for v in x[40]])]  # ids and vectors that repeat
    rows = [(i, [float(v) for v in x[i]]) for i in range(2000)] + same
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for kind in ("float", "double"):
        df = spark.createDataFrame([(*r, "clash", 1) for r in rows + odd], f"vec_id long, embedding array<{kind}>, row string, segment int")
        exact = m.astype(np.float32).astype(np.float64) if kind == "float" else m + 0
        for block, size in ((20_000, 8192), (37, 500)):
            hits = total = 0
            got = defaultdict(list)
            for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=10, block=block, segment_size=size).collect():
                got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
            assert set(got) == {int(i) for i in ids if i % 20 == 0}
            for q, found in got.items():
                own = np.flatnonzero(ids == q)
                assert sorted(r for r, _, _ in found) == sorted(list(range(1, 11)) * len(own))
                want = []
                for at in own:
                    s = (exact * exact[at]).sum(axis=1)
                    want += [round(float(s[i]), 9) for i in np.lexsort((ids, -s)) if i != at][:10]
                mine = [round(v, 9) for _, _, v in found]
                hits += sum((Counter(mine) & Counter(want)).values())
                total += len(want)
                for _, i, v in found:
                    assert min(abs(v - float(a @ b)) for a in exact[own] for b in exact[ids == i]) < 1e-9
            assert hits / total >= 0.9
        assert ann.nearest(df.limit(0), F.lit(True)).count() == 0 and ann.nearest(df, F.lit(False)).count() == 0


def test_forest_compares_few_rows_and_finds_most():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4096, 64)).astype(np.float32)
    sides = ann.planes(128, 64, 7)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    forest = ann.Forest.over(x, sides)
    q = x[::100]
    strings = ann._strings(q, np.zeros(len(q)), sides)
    hits, marked = 0, []
    for i, votes in enumerate(forest.votes(strings, 128 * 4096 // 16)):
        rows = ann.chosen(votes, 3 * 4096 // 10)
        marked.append(len(rows) / 4096)
        hits += len(set(rows.tolist()) & set(np.argsort(-(x @ q[i]))[:20].tolist()))
    assert max(marked) <= 0.3 and hits / (20 * len(q)) >= 0.9
    broken = ann.Forest(forest.keys, rng.permuted(forest.order, axis=1))  # the same strings, but of other rows
    lost = sum(len(set(ann.chosen(v, 3 * 4096 // 10).tolist()) & set(np.argsort(-(x @ q[i]))[:20].tolist())) for i, v in enumerate(broken.votes(strings, 128 * 4096 // 16)))
    assert lost / (20 * len(q)) < 0.45
    assert ann.chosen(np.array([3, 3, 3, 1]), 2).tolist() == [0, 1, 2] and ann.chosen(np.array([0, 2, 1, 0]), 2).tolist() == [1, 2]
    assert ann.chosen(np.array([5, 1, 1, 1]), 2, 3).tolist() == [0, 1, 2, 3]


def test_pipeline_keeps_columns_and_decides(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        docs = corpus_pipeline.written(out, "test")
        seen.append(docs.count())
    assert seen[1] < seen[0] and seen[2] <= seen[1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert last.count() == seen[-1] and last.agg(F.max(F.col("start") + F.col("n_tokens")) == F.sum("n_tokens")).first()[0]


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    def text(i):
        words = prose(30 + i % 17, i).split()
        return " ".join(w.upper() + "!!" for w in words) if i % 4 == 0 else " ".join(words)

    item = prose(40, 900)
    rows = [(i, text(i), f"s{i % 3}" if i % 11 else None, f"x{i}") for i in range(120)]
    rows += [(200 + i, text(4 * i + 1) + " tail", "s1", "near") for i in range(12)] + [(300, text(1), "s2", "copy"), (5, text(5), "s2", "x5")]
    rows += [(400 + i, f"{prose(10, 950 + i)} {' '.join(item.split()[i : i + 15])}", "s0", "bench") for i in range(5)]
    rows += [(500, None, "s0", "null"), (501, "", "s1", "empty"), (None, prose(50, 77), "s1", "no id"), (502, prose(9000, 78), "s2", "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")  # copies: a name that mixing uses too
    at = f"file://{tmp_path}/in"
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")

    scored = quality.score(docs, quality.fit(docs, labels), "s").collect()
    kept = [tuple(r)[:4] for r in scored if r["s"] >= 0.3]
    assert 60 < len(kept) < len(rows)
    _, root = linked([r[:2] for r in kept if r[0] is not None], 5, 80)
    kept = list({r[0]: r for r in kept if r[0] is not None and root[r[0]] == r[0]}.values()) + [r for r in kept if r[0] is None]
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(item))
    windows = {tuple(own[i : i + 13]) for i in range(len(own) - 12)}

    def clean(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        hit = {k for j in range(len(w) - 12) if tuple(w[j : j + 13]) in windows for k in range(j, j + 13)}
        return not (hit and 20 * len(hit) >= len(w))

    kept = [r for r in kept if clean(r[1])]
    size = {s: sum(len(blank_words(r[1])) for r in kept if r[2] == s) for s in {r[2] for r in kept}}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}
    open_, rest = set(order), float(sum(size.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * size[s]}
        for s in full or open_:
            target[s] = 3.0 * size[s] if full else level * weight[s]
            rest -= target[s]
        open_ -= full or set(open_)
    tk, want = Tokenizer.from_file(tokenizer_file()), Counter()
    for s in order:
        line = sorted((r for r in kept if r[2] == s), key=lambda r: (hashlib.md5(f"17:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0))
        epochs, start, last, n = int(target[s] // size[s]), 0, -1, []
        for i, r in enumerate(line):
            n.append(len(blank_words(r[1])))
            if n[i] and epochs < 3 and target[s] - epochs * size[s] - start >= n[i] / 2:
                last = i
            start += n[i]
        for i, r in enumerate(line):
            ids = np.array(tk.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
            want[r[0], len(ids), zlib.crc32(ids.tobytes())] += epochs + (i <= last)
    got = corpus_pipeline.run(spark, at).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == +want
    ends = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + b == c for (a, b), (c, _) in zip(ends[:-1], ends[1:], strict=True))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), at).count() == 0


def test_queries_on_the_smallest_tables(spark):
    import os

    import duckdb

    from lacuna.llm import queries

    at = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for f in os.listdir(at):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{at}/{f}'")
    n = {t: c.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("documents", "conversations")}
    for name, query in queries.queries().items():
        got = query(spark, at).toPandas()
        assert len(got) and got.columns.is_unique, name
        if name in queries.oracle_sql():
            want = c.execute(queries.oracle_sql()[name]).df()
            assert len(got) == len(want)
            first = "doc_id" if "doc_id" in got else got.columns[0]
            keys = [first, *[k for k in got.columns if k != first]]
            a, b = (df[keys].sort_values(keys).reset_index(drop=True) for df in (got, want))
            assert ((a == b) | (a.isna() & b.isna())).all().all()
        if name not in ("op3_nearest", "op5_chat", "op12_spelling_variants", "op13_conversation_trie"):
            assert len(got) == n["documents"], name
        if "held_out" in got and "predicted" in got:
            folds, held = (5, 0) if name == "op4_quality" else (3, 1)
            assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(int(i)).encode()) % folds == held)).all()
            assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= (0.3 if name == "op4_quality" else 0.7))).all()
        if name == "op5_chat":
            one = got[got["conv_id"] == -1].iloc[0]
            said = "</s>[INST] ok [/INST]"
            assert one["n_turns"] == 2 and one["loss_chars"] == len(said) and one["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        if name == "op8_sharding":
            assert set(got["law"]) == {"bytes"} and all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
