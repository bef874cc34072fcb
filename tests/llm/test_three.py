"""Sanitisation, spelling variants and the conversation trie against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from lacuna.llm import sanitise, turntrie, variants
from lacuna.llm.queries import queries

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    own = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(own)) % 10 == 0


def base(text):
    out = []
    for kind, form in PII.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def odd_texts(n, seed):
    rng = np.random.default_rng(seed)
    bits = ["a.b@c.de", "x@y", "x@y.z_q@r.s", "é@ü.x", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4012888888881881", "40128888 88881881 9", "+1 (456) 555-2186", "+12", "++4912345678.", "+", "@", ".", "-", " ", "\n", "7", "99", "word", "Ünï", "😀", "@@a@b.c-d.e", "%+-@-.-"]
    return ["".join(rng.choice(bits) + rng.choice(["", " ", "", "\n"]) for _ in range(rng.integers(1, 14))) for _ in range(n)]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    texts = [None, "", " ", *odd_texts(600, 3), "9" * 4000, "a" * 5000 + "@", "1." * 3000, "a@" + "b." * 4000 + "c", "+" + "1 " * 3000, "x 4111 1111 1111 1111\n" * 400]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "q@w.er", "x", "y"), (3, texts[3], "x", "y")], "doc_id long, text string, spans string, key string")
    out = sanitise.private_data(docs)
    assert out.count() == len(texts) + 2
    got = sanitise.digests(out, "spans_").toPandas()
    for r in got.itertuples():
        text = "q@w.er" if math.isnan(r.doc_id) else texts[int(r.doc_id)]
        want = base(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in PII]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.spans.startswith(said)
    none = docs.limit(0)
    assert sanitise.digests(sanitise.private_data(none), "spans_").count() == 0


def told(texts, support, share, reach=300):
    """Terms that disclose too much, and whether their class does too, by loops."""
    word = r"[^\W_]+"

    def terms(t):
        own = {w for w in re.findall(word, t.lower()) if len(w) >= 3}
        return own | {w[:3] + "*" for w in own if len(w) > 4}

    n_e, n_t, n_et, kinds, shown = Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set)
    lines = [line for t in texts for line in (t or "").split("\n")]
    for line in lines:
        n_t.update(terms(line))
    for t in texts:
        spans = base(t)
        for kind in PII:
            own = [s for s in spans if s[0] == kind]
            for _, a, b in own:
                value = t[a:b].lower() if kind == "email" else t[a:b] if kind == "ip" else re.sub("[^0-9]", "", t[a:b])
                left, right = t[:a].split("\n")[-1], t[b:].split("\n")[0]
                assert len(left) < reach and len(right) < reach
                e, context = (kind, value), (left, right)
                n_e[e] += 1
                shown[e].add(context)
                for w in terms(left + " \n " + right):
                    n_et[e, w] += 1
                    kinds[e, w].add(context)
    n, out = len(lines), {}
    tells = {}
    for (e, w), c in n_et.items():
        if len(kinds[e, w]) >= support:
            tells[e, w] = math.log2(n * min(c, n_t[w]) / (n_e[e] * n_t[w])) / max(math.log2(n / n_e[e]), 1e-9) >= share
    for (e, w), bad in tells.items():
        if bad and not w.endswith("*"):
            out[w] = out.get(w, False) or len(w) <= 4 or tells.get((e, w[:3] + "*"), True)
    return out


def test_terms_that_give_an_entity_away_go(spark):
    rng = np.random.default_rng(5)
    words = [f"w{x}{y}ord" for x in "abcdefgh" for y in "klmnopq"]
    prose = lambda n: " ".join(rng.choice(words, n))
    texts = [f"{prose(8)}\n{prose(6)} {prose(3)}" for _ in range(300)]
    for i in range(5):
        texts.append(f"{prose(5)}\nthe Zorblatt of {prose(2)} wrote from ann@corp.example.com to {prose(3)} for teaming{'abcde'[i]}\n{prose(4)}")
        texts.append(f"{prose(3)} call +1 (456) 555-2186 for {prose(2)} and wardrobe {prose(1)}")
    texts += ["a wardrobed war", "warfare warbler warmth"] * 6  # the class of wardrobe says little
    texts += ["only Zorblatt here, zorblatt", "once lone@corp.example.com with unheard things", None, ""]
    texts += ["copy copied@corp.example.com unseen elsewhere"] * 40
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = told(texts, 3, 0.95)
    assert "zorblatt" in want and "unseen" not in want and want["zorblatt"]
    base_ = sanitise.base_spans(docs)
    got = {r.term: r.removed for r in sanitise.disclosures(docs, base_).collect()}
    assert got == want
    found = sanitise.sanitised(sanitise.private_data(docs)).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        terms = [("term", m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t or "") if m[0].lower() in want and not any(a < m.end() and m.start() < b for _, a, b in base(t))]
        all_ = base(t) + terms
        assert [(s.kind, s.start, s.end) for s in found.spans[i]] == all_
        out, at = "", 0
        for kind, a, b in sorted(all_, key=lambda s: s[1:]):
            label = f"[{kind}]" if kind != "term" or want[t[a:b].lower()] else t[a : a + 3].lower() + "*"
            out, at = out + (t or "")[at:a] + label, b
        assert found.sanitised[i] == out + (t or "")[at:]
    assert found.sanitised[len(texts) - 1] == "copy [email] unseen elsewhere"


def edits(word, letters):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cut if b} | {a + c + b for a, b in cut for c in letters} | {a + c + b[1:] for a, b in cut if b for c in letters}) - {word}


def test_automaton_numbers_words_and_finds_those_one_edit_away():
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 9))) for _ in range(900)} | {"a" * 300})
    a = variants.Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words))) and a.number("zz") == a.number("") == -1
    for w in [*words[::7], "a" * 300, "abcabc"]:
        for fixed in (0, len(w) // 2, len(w)):
            near = {x for x in edits(w, "abé") & set(words) if x[:fixed] == w[:fixed]}
            assert {words[i] for i in a.near(w, fixed)} == near
    small = variants.Automaton(["".join(p) for p in itertools.product("ab", repeat=10)])
    assert len({id(e) for e in small.edges if e}) == 10  # one state a letter, though there are 1,024 words


def brute_variants(docs, least=6, often=5, times=5, slips=199):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % slips == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= often}
    letters, out = {c for w in n for c in w}, {}
    for w, c in n.items():
        near = edits(w, letters) & n.keys()
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= times * c else None, c, len(near), n[best] if best and n[best] >= times * c else None)

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return {w: (v[0], root(w), *v[1:]) for w, v in out.items()}


@pytest.mark.parametrize(("most", "slips"), [(20_000, 199), (12, 7), (3, 0)])
def test_spelling_variants_are_those_of_all_pairs(spark, most, slips):
    rng = np.random.default_rng(11)
    stem = ["harbour", "letters", "mélange", "Éclairs", "quietly", "prefixed", "prefixes", "aaaaaaaa", "banana", "ananas", "x" * 40]
    docs = [(None, "Harbour harbor"), (1, None), (2, ""), (2, "short word"), *[(100 + i, "chainaa " * 60 + "chainab " * 9 + "chainbb") for i in range(6)]]
    for i in range(60):
        own = []
        for _ in range(160):
            w = str(rng.choice(stem))
            if rng.random() < 0.5:
                at, c = int(rng.integers(0, len(w))), str(rng.choice(list("abeé")))
                w = [w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]][rng.integers(0, 3)]
            own.append(w.title() if rng.random() < 0.1 else w)
        docs.append((i, "".join(w + str(rng.choice([" ", ", ", "1", "\n"])) for w in own)))
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(df, slips=slips, most=most).collect()}
    want = brute_variants(docs, slips=slips or 10**12)
    assert got == want and any(v[1] not in (w, v[0]) for w, v in want.items())
    assert variants.spelling_variants(df.limit(0)).count() == 0


def test_long_texts_are_counted_in_stretches():
    text = "abcdefg hijklmn " * 30 + "q" * 100
    for most in (1, 5, 16, 1000):
        assert "".join(variants._stretches(text, most)) == text
        parts = [w for p in variants._stretches(text, most) for w in re.findall("[a-z]+", p)]
        assert parts == re.findall("[a-z]+", text)


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [v[2:] for v in sorted(vs)] for c, vs in own.items()}
    full = {}
    for c, vs in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = turns.get(c - c % 100, [])[:h] + vs[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
        ends[tuple(full[c])].append(c)
    out = set()
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = sum(1 for q in under if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in under))
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in under)
        out.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids), leaves, saved, hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bucket", [400_000, 60, 9])
def test_trie_nodes_are_those_of_all_prefixes(spark, bucket):
    rng = np.random.default_rng(bucket)
    rows = []
    for c in [*range(0, 40), *range(100, 230), *range(395, 440)]:
        for t in range(int(rng.integers(0, 9))):
            rows.append((c, t, str(rng.choice(["user", "assistant"])), str(rng.choice(["hi", "hi", "né 😀", "", "ok then"]))))
    rows += [(500 + i, t, "user", "the same") for i in range(60) for t in range(3)]
    rows += [(700, None, None, None), (700, 1, "user", None), (None, 1, "user", "lost"), (701, 5, "user", "late"), (701, None, "user", "first"), (702, 1, "u", "x" * 3000)]
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth int, turns string").repartition(5)
    seq = turntrie.rebuilt(turntrie.turn_sequences(df))
    got = turntrie.prefix_trie(seq, bucket_turns=bucket, run_turns=max(bucket // 2, 5)).collect()
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    mine = [tuple(r[n] for n in names) for r in got]
    assert len(mine) == len(set(mine)) and set(mine) == brute_trie(rows)
    assert turntrie.prefix_trie(turntrie.rebuilt(turntrie.turn_sequences(df.limit(0)))).count() == 0


def test_merge_keeps_order_and_what_neighbours_share():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3, 5, 8, 13):
        keys = [b"".join(bytes([int(x)]) * 16 for x in rng.integers(0, 3, rng.integers(0, 7))) for _ in range(200)]
        rows, runs = [(key, int(rng.integers(0, 50))) for key in keys], []
        for i in range(k):
            own = sorted(rows[i::k])
            shared = [0] + [turntrie.shared_turns(a[0], b[0]) for a, b in zip(own[:-1], own[1:], strict=True)]
            runs.append(turntrie.Run([r[1] for r in own], [len(r[0]) // 16 for r in own], shared, b"".join(r[0][s * 16 :] for r, s in zip(own, shared, strict=True)), np.zeros(999, np.int64)))
        got = list(turntrie.merged(runs))
        assert [g[:2] for g in got] == sorted(rows)
        assert [g[3] for g in got[1:]] == [turntrie.shared_turns(a[0], b[0]) for a, b in zip(got[:-1], got[1:], strict=True)]


def test_the_queries_over_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = queries()["op11_private_data"](spark, sf).toPandas().set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base(t))
        assert got.base_sha256[d] == hashlib.sha256(said.encode()).hexdigest()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries()["op12_spelling_variants"](spark, sf).collect()}
    assert out == brute_variants(list(zip(docs.doc_id, docs.text, strict=True)))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    nodes = queries()["op13_conversation_trie"](spark, sf)
    assert {tuple(r) for r in nodes.collect()} == brute_trie(rows)


def test_op11_runs_no_python_in_tasks(spark):
    docs = spark.createDataFrame([(1, "see a@b.cd")], "doc_id long, text string")
    plan = sanitise.digests(sanitise.private_data(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
