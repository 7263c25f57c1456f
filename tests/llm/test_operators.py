"""Each operator against a brute-force version on small tables with nulls, empty, short, equal and long texts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import additive_ann, common, exact_dedup, kneser_ney, language, mixing, near_dedup, packing, pii, suffix_dedup, url_filter

WORD = re.compile(common.WORD)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def made(n=160, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdeé"), rng.integers(2, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary, 30))
    out = []
    for k in range(n):
        words = list(rng.choice(vocabulary, rng.integers(1, 90)))
        if k % 5 == 1 and out[-1]:
            words = out[-1].split()
            for _ in range(1 + k % 3):
                words[rng.integers(len(words))] = "Changed"
        text = " ".join(words)
        out.append(text + "\n" + passage if k % 7 == 0 else out[k // 2] if k % 11 == 10 else text)
    out += [None, "", "   ", "one", "one two", "one two", "Tab\tand\nlines", "ab " * 3000, "x" * 49, "x" * 50, "y" * 120, "x" * 50]
    return [(3 * k + 1, t, ["en", "fr", None][k % 3], [None, "b", "a", "ä"][k % 4]) for k, t in enumerate(out)]


DOCS = made()


@pytest.fixture(scope="module")
def docs(spark):
    """Over several partitions, with a column more, and names that operators use inside."""
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    return df.withColumn("n", F.lit(1)).withColumn("region", F.lit("x")).withColumn("class", F.lit("y")).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def brute_groups(words, percent):
    sets = {}
    for d, t, *_ in DOCS:
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize("words", [4, 5])
def test_near_dedup(docs, words):
    assert result(near_dedup.near_groups(docs, words)) == brute_groups(words, 80)


def test_near_dedup_large_group(spark):
    """Many near copies of one text, most of them linked only through others."""
    rng, base = np.random.default_rng(1), [f"w{k}" for k in range(120)]
    rows = []
    for k in range(300):
        words = list(base)
        for at in rng.choice(120, 3, replace=False):
            words[at] = f"new{k}x{at}"
        rows.append((k, " ".join(words)))
    got = result(near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    sets = {d: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for d, t in rows}
    root = {d: d for d in sets}
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    assert {d: v[1] for d, v in got.items()} == root


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60) if k % 20 != 19] + [(100, 7), (200, 201), (201, 200), (5, 5)]
    got = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).distinct().collect())
    assert all(got[k] == k // 20 * 20 for k in range(60)) and got[100] == 0 and got[201] == 200


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(DOCS)
    sizes, sums, largest = Counter(), Counter(), Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(dict((d[0], d[1]) for d in DOCS)[r["doc_id"]] or "")) and r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        sums[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(sums[r["source"]] - r["target"]) <= largest[r["source"]] / 2 + 1e-6 and r["source_size"] == sizes[r["source"]] for r in rows)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, "d": 5}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df, [3, 1, 2], 1.5, 2.0).collect()}
    weights, want, left = dict(zip(sizes, [3, 1, 2, 3])), {}, 1.5 * sum(sizes.values())
    while True:
        free = {s: left * w / sum(x for y, x in weights.items() if y not in want) for s, w in weights.items() if s not in want}
        over = [s for s, t in free.items() if t > 2 * sizes[s]]
        if not over:
            want |= free
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(want.values())
    assert got == pytest.approx(want)


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, length=64).collect()
    want = {}
    for d, text, *_ in DOCS:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            want[d, k] = (at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        upto = 0
        for at, n in sorted(parts):
            assert at == upto
            upto += n
        assert upto <= 64
    assert len(sequences) <= 1.03 * sum(n for _, n, _ in want.values()) / 64


def test_tokens_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    odd = ["It's İstanbul ΣΑΣ", "áé ½²x 12345", "x<|endoftext|>y", " a\u0085b\x1cc", "don't WE'LL 'S '", "日本語 text", "Ünïcode_ÀÉ—dash…"]
    rng = np.random.default_rng(0)
    odd += ["", "'", "''s", "'sam 'rea 'v've''ll 'lx", "x.'s '", "Ⱥb ȺȾ", "'é 'ré", "\u00a0 \u0085"]
    odd += ["".join(rng.choice(list("ab'stmdrevll'' .3é½\n-ÀΣ"), rng.integers(0, 40))) for _ in range(400)]
    want = [e.ids for e in t.encode_batch(odd, add_special_tokens=False)]
    for block in ([odd], [[o] for o in odd], [odd]):  # many texts, single ones, and words that are remembered
        assert [ids[x:y].tolist() for texts in block for ids, at in [own.encode(texts)] for x, y in zip(at[:-1], at[1:])] == want


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(33, np.int64)
    np.add.at(counts, rng.integers(1, 33, 500), rng.integers(0, 8, 500))
    made_ = packing.plan(counts)
    used = np.zeros_like(counts)
    for parts, times in made_:
        assert sum(parts) <= 32 and times > 0
        np.add.at(used, list(parts), times)
    assert (used == counts).all()
    gaps = []  # first fit, longest first
    for l in np.repeat(np.arange(33), counts)[::-1].tolist():
        at = next((k for k, g in enumerate(gaps) if g >= l), None)
        if at is None:
            gaps.append(32 - l)
        else:
            gaps[at] -= l
    assert sum(n for _, n in made_) <= 1.01 * len(gaps)


def brute_spans(rows, length):
    first = {}
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, int)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] != d:
                gone[k + 1 : k + length + 1] = 1
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out[d] = (len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [50, 20])
def test_suffix_dedup(docs, length):
    got = result(suffix_dedup.repeated_spans(docs, length).drop("spans"))
    assert got == brute_spans([r[:2] for r in DOCS], length)


def test_suffix_dedup_periods(spark):
    rng = np.random.default_rng(0)
    rows = [(k, "".join(rng.choice(list("ab"), 3)) * int(rng.integers(10, 60)) + "".join(rng.choice(list("abc"), 30))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(suffix_dedup.repeated_spans(df).drop("spans")) == brute_spans(rows, 50)


@pytest.mark.parametrize("length", [50, 20])
def test_prefix_doubling(docs, length):
    """The doubling over every position gives what the query's way gives; positions leave with every round."""
    sizes = []
    got = result(suffix_dedup.doubled_spans(docs, length, sizes).drop("spans"))
    assert got == brute_spans([r[:2] for r in DOCS], length)
    assert [w for w, *_ in sizes] == ([8, 16, 32, 50] if length == 50 else [8, 16, 20]) and sizes == sorted(sizes, key=lambda x: -x[1])


def test_packed_keys():
    for keys in ([], [1 << 63], [0, 1 << 16, 1 << 40, 1 << 62, (1 << 62) + (1 << 16), (1 << 64) - (1 << 16)]):
        k = np.array(keys, np.uint64)
        assert (suffix_dedup._unpack_keys(suffix_dedup._pack_keys(k)) == k).all()


def test_lm(docs):
    held_out = common.crc_mod("doc_id", 5) == 1
    got = {r["doc_id"]: r for r in kneser_ney.score_texts(docs, held_out).collect()}
    tokens = {d: WORD.findall(lower(t)) + [None] for d, t, *_ in DOCS}
    train = [t for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    seen = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["<s>", *t[:-1]], t))
    total, n, v = Counter(), sum(seen.values()), len(seen)
    follow, contexts = defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, b), c in pairs.items():
        total[a] += c
        follow[a][min(c, 3) - 1] += 1
        contexts[b] += 1
    rare = lambda c: kneser_ney.discounts(*(sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)))
    high, low = rare(pairs), rare(contexts)
    left = sum(low[min(x, 3)] for x in contexts.values()) / len(pairs)

    def p(a, b):
        base = max(contexts[b] - low[min(contexts[b], 3)], 0) / len(pairs) + left / (v + 1)
        if not total[a]:
            return base
        c = pairs[a, b]
        return max(c - high[min(c, 3)], 0) / total[a] + sum(x * y for x, y in zip(high[1:], follow[a])) / total[a] * base

    assert sum(p("<s>", w) for w in seen) + p("<s>", "unseen word") == pytest.approx(1)
    for d, t in tokens.items():
        r = got[d]["lm"]
        assert (r["n_tokens"], r["n_known"], got[d]["train_tokens"]) == (len(t), sum(seen[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t[:-1]], t)))


def test_pii_patterns(spark):
    texts = [
        "mail a.b@c.example.com, or x@y@z.de", "at 10.0.0.1 and 999.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111, not 4111 1111 1111 1112",
        "+1 (212) 555-0100 or +49-30-1234567.", "nothing here", "", None, "é" * 70 + " +1 555 123 4567 " + "ü" * 70,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(df, None).collect()}
    assert [got[k]["n_email"] for k in range(4)] == [2, 0, 0, 0]
    assert [got[k]["n_ip"] for k in range(4)] == [0, 2, 0, 0]
    assert [got[k]["n_card"] for k in range(4)] == [0, 0, 1, 0]
    assert [got[k]["n_phone"] for k in range(4)] == [0, 0, 0, 2]
    assert got[7]["spans"] == "phone:71:86" and got[6]["spans"] == "" and got[5]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_pii_gradient():
    rng, t = np.random.default_rng(0), pii.Tagger(embed=3, hidden=4)
    chars, tags = rng.integers(0, 97, (3, pii.WINDOW)), rng.integers(0, pii.TAGS, (3, pii.WINDOW))
    _, grad = t.gradient(chars, tags)
    for k in t.p:
        at = (int(chars[0, 0]), 1) if k == "E" else tuple(0 for _ in t.p[k].shape)
        old = t.p[k][at]
        t.p[k][at] = old + 1e-5
        up = t.gradient(chars, tags)[0]
        t.p[k][at] = old - 1e-5
        down = t.gradient(chars, tags)[0]
        t.p[k][at] = old
        assert (up - down) / 2e-5 == pytest.approx(grad[k][at], abs=1e-4)


def test_pii_learns(spark):
    """Held-out spans are found again by the tagger alone, across the edges of windows."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    kinds = [lambda: f"{word()}@{word()}.com", lambda: ".".join(map(str, rng.integers(0, 255, 4))), lambda: f"+1 (555) 555-{rng.integers(1000, 9999)}", lambda: f"part {rng.integers(10, 99)}"]
    texts = [" ".join(x for k in range(12) for x in (word(), word(), kinds[int(rng.integers(4))]())) for _ in range(260)]
    tagger = pii.train(spark.createDataFrame([(t,) for t in texts[:220]], "text string"))
    hit = total = 0
    for text in texts[220:]:
        starts = pii.windows(text)
        found = {(s, k, e) for s, k, e, _ in pii.reconcile(len(text), starts, *tagger.decode(np.array([pii.characters(text, s) for s in starts])))}
        want = set(pii.patterns(text))
        hit, total = hit + len(found & want), total + len(found | want)
    assert hit / total > 0.85


def contract_spans(text):
    """The four expressions of the contract, as they stand there."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x) % 9 or (2 * x and 9) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15])


def test_pii_base_spans(spark, docs):
    """base_sha256 and the counts against the contract's expressions, on whole texts: real ones, and dense, odd and very long ones."""
    rng = np.random.default_rng(8)
    odd = ["".join(rng.choice(list("0123456789.+- ()@ab%é"), rng.integers(0, 300))) for _ in range(150)]
    odd += ["4111 1111 1111 1111 " * 30, "1.2.3.4" * 50, "a@b.c" * 40, "x " * 60_000 + "me@example.com " + "y" * 100_000 + " 10.1.2.3", "", None]
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts = odd + real
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in pii.find(df, None).collect():
        want = contract_spans(texts[r["doc_id"]] or "")
        assert r["spans"] == pii._joined(want) and r["base_sha256"] == hashlib.sha256(pii._joined(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in want) for n in range(4)]


def test_pii_adds_spans(spark):
    """Personal data in forms that no pattern matches is added in texts not trained on, and little else; pattern spans stay."""
    train = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tagger = pii.train(train)
    rng = np.random.default_rng(77)
    words = [w for r in train.collect() for w in (r["text"] or "").split() if w.isalpha() and w.lower() != "at"][:4000]
    texts, want = [], []
    for _ in range(150):
        text, spans = "", []
        for _ in range(4):
            text += " ".join(rng.choice(words, int(rng.integers(8, 50)))) + " "
            kind = int(rng.integers(4))
            form = pii.forms(kind, rng)
            spans.append((len(text), kind, len(text) + len(form)))
            text += form + " "
        texts.append(text + "at the end")
        want.append(set(spans))
    base = [pii.patterns(t) for t in texts]
    added = pii._added(tagger, texts, base, pii.SURE)
    novel = [w - set(b) for w, b in zip(want, base)]
    hit = sum(len(set(a) & n) for a, n in zip(added, novel))
    assert hit / sum(map(len, added)) > 0.9 and hit / sum(map(len, novel)) > 0.6
    plain = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.find(plain, tagger).collect():
        spans = sorted(base[r["doc_id"]] + added[r["doc_id"]])
        assert r["spans"] == pii._joined(spans) and r["n_added"] == len(added[r["doc_id"]])
    # decoding every window gives the same spans
    every = pii._Windows.hot
    pii._Windows.hot = lambda w: np.arange(len(w.of))
    try:
        assert pii._added(tagger, texts + ["", "z" * 5000, "7" * 700], [*base, [], [], []], 0.5) == (whole := pii._added(tagger, texts + ["", "z" * 5000, "7" * 700], [*base, [], [], []], 0.5))
    finally:
        pii._Windows.hot = every
    assert pii._added(tagger, texts + ["", "z" * 5000, "7" * 700], [*base, [], [], []], 0.5) == whole


def test_added_spans_hold_what_their_kind_needs():
    for span, kind, holds in [("4111.1111.1111.1111", 2, True), ("4111.1111.1111.1112", 2, False), ("at at at at", 0, False), ("me at home dot org", 0, True), ("me@home", 0, False), ("1 2 3", 1, False), ("555-123-4567", 3, True), ("4" * 25, 2, False)]:
        assert pii._holds(span, kind) is holds
    rng = np.random.default_rng(1)
    assert all(pii._holds(pii.forms(k % 4, rng), k % 4) for k in range(400))


def test_urls(spark):
    rows = [
        (1, "https://WWW.Example.com/en/12?x"), (2, "http://example.com/en/"), (3, "http://a.example.com/en/9#f"), (4, "http://b.net/es/1"), (5, "http://b.net/en/1"), (6, None),
        (7, "no scheme"), (8, "http://x.com"), (9, "http://mynet/es/1"), (10, "https://c.org?q=/es/"), (11, "http://x.com/a"), (12, "http://b.net/fr/http://com/"),
    ]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows)
    assert [got[k]["rule"] for k in range(1, 13)] == ["www.example.com/en/", "example.com/en/", "example.com/en/", "net/es/", None, None, None, None, None, None, "com/", "net/fr/"]
    assert (got[1]["host"], got[1]["path"]) == ("www.example.com", "/en/12") and (got[6]["host"], got[7]["path"], got[10]["path"]) == ("", "", "")
    assert got[5]["verdict"] == "allow" and got[3]["verdict"] == "block"


def test_url_templates(spark):
    """Variable segments become wildcards, and a template of mostly rejected urls rejects the rest of its urls."""
    rows = [(k, f"http://h.org/spam/u{chr(97 + k % 26)}{chr(97 + k // 26)}/{k}", 1 if k < 60 else None) for k in range(80)]
    rows += [(100 + k, f"http://h.org/news/{k}", 0 if k < 60 else None) for k in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, rules=(), label=F.col("bad")).collect()}
    assert got[79]["template"] == "/spam/*/#" and got[79]["verdict"] == "block" and got[179]["verdict"] == "allow"


def brute_tree(rows, share=0.02, support=5, z=2.0, prior=2.0):
    """rows (host, shape, label) to {(host, shape): (template, purity, labels)}, by recursion over nodes."""
    overall = (sum(x == 1 for *_, x in rows) + 1) / (sum(x is not None for *_, x in rows) + 2)
    hosts, template_of, over = defaultdict(list), {}, {}
    for h, shape, x in rows:
        hosts[h].append(([s for s in shape.split("/") if s], shape, x))
    bad, known = lambda us: sum(x == 1 for *_, x in us), lambda us: sum(x is not None for *_, x in us)
    purity = lambda us, above: (bad(us) + prior * above) / (known(us) + prior)

    def visit(h, template, us, above, k):
        p = purity(us, above)
        children = defaultdict(list)
        for u in us:
            if len(u[0]) <= k or len(us) < support:
                name = template + "/*" * (len(u[0]) - k)
                template_of[h, u[1]] = name
                over[h, name] = min(over.get((h, name), 9), p if len(u[0]) > k else above)
            else:
                children[u[0][k]].append(u)
        stay = {s: c for s, c in children.items() if len(c) >= max(support, share * len(us))}
        pool = sum(map(known, stay.values())) + 2
        q = (sum(map(bad, stay.values())) + 1) / pool
        into = defaultdict(list)
        for s, c in children.items():
            alike = s in stay and len(stay) > 1 and known(c) and abs((bad(c) + 1) / (known(c) + 2) - q) <= z * math.sqrt(q * (1 - q) * (1 / (known(c) + 2) + 1 / pool))
            into["+" if alike else s if s in stay else "*"] += c
        for name, c in into.items():
            visit(h, f"{template}/{name}", c, p, k + 1)

    for h, us in hosts.items():
        visit(h, "", us, overall, 0)
    of_template = defaultdict(list)
    for h, shape, x in rows:
        of_template[h, template_of[h, shape]].append((x,))
    return {(h, shape): (t, purity(of_template[h, t], over[h, t]), known(of_template[h, t])) for (h, shape), t in template_of.items()}


HOST, PATH = r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)", r"regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
URL_SQL = f"""
with r(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u as (select page_id, translate(coalesce({HOST}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce({PATH}, '') as path from pages)
select page_id, host, path, (select arg_max(h || p, length(h || p)) from r where (host = h or host like '%.' || h) and starts_with(path, p)) as rule,
       (select arg_max(verdict, length(h || p)) from r where (host = h or host like '%.' || h) and starts_with(path, p)) as ruled
from u
"""


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_urls_on_pages(spark, sf):
    """Whole tables: host, path and rule against SQL, templates and verdicts against the recursion."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '/root/testdata/{sf}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.sql(URL_SQL).fetchall()}
    got = {r["page_id"]: r for r in url_filter.op7_url_filter(spark, f"/root/testdata/{sf}").collect()}
    assert {k: (r["host"], r["path"], r["rule"]) for k, r in got.items()} == {k: v[:3] for k, v in want.items()}
    shape = lambda path: re.sub("[0-9]+", "#", path)
    tree = brute_tree([(h, shape(p), None if ruled is None else int(ruled == "block")) for h, p, _, ruled in want.values()])
    for k, (h, p, _, ruled) in want.items():
        template, purity, labels = tree[h, shape(p)]
        assert got[k]["template"] == template and got[k]["purity"] == pytest.approx(purity)
        assert got[k]["verdict"] == (ruled or ("block" if purity >= 0.9 and labels >= url_filter.EVIDENCE else "allow"))
    if sf == "sf0.1":
        n = {(r["bad"], r["verdict"]): r["n"] for r in url_filter.held_out(spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")).collect()}
        blocked, bad = n.get((1, "block"), 0), n.get((1, "block"), 0) + n.get((1, "allow"), 0)
        assert blocked >= 0.9 * (blocked + n.get((0, "block"), 0)) and blocked >= 0.5 * bad > 0


def test_urls_without_labels_are_kept(spark):
    """A host whose only labels are bad ones keeps the templates that have none, or fewer than are asked for."""
    rows = [(k, f"http://h.net/bad/{k}", 1) for k in range(60)] + [(100 + k, f"http://h.net/new/{k}", None) for k in range(20)] + [(200 + k, f"http://h.net/few/{k}", 1 if k < 4 else None) for k in range(20)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, bad int"), rules=(), label=F.col("bad")).collect()
    assert {(r["page_id"] // 100, r["verdict"]) for r in got} == {(0, "block"), (1, "allow"), (2, "allow")}


def test_url_tree_random(spark):
    """Deep, hot, null, repeated and unlabelled urls against the recursion."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(900):
        host = "hot.org" if k % 3 else f"h{k % 7}.org"
        path = "/".join(str(rng.choice(["a", "b", "c", "d", str(k), f"s{k}"], p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1])) for _ in range(int(rng.integers(0, 9))))
        rows.append((k // 2, f"http://{host}/{path}", [None, 0, 1, 1 if "/a/" in path else 0][int(rng.integers(4))]))
    rows += [(None, None, None), (7, "", 1), (7, "", 1), (7, "x", None), (2000, "http://hot.org/" + "a/" * 60, None)] + [(3000 + k, "http://deep.org/" + "q/" * 12 + str(k), 1) for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int").withColumn("host", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    got = url_filter.judge_urls(df, rules=(), label=F.col("bad")).collect()
    parts = [re.match(r"(?s).*?://([^/]*)(.*)", u or "") for _, u, _ in rows]
    keys = [(m[1], re.sub("[0-9]+", "#", m[2])) if m else ("", "") for m in parts]
    tree = brute_tree([(*key, x) for key, (_, _, x) in zip(keys, rows)])
    want = Counter((i, *key, tree[key][0], round(tree[key][1], 9)) for key, (i, _, _) in zip(keys, rows))
    assert Counter((r["page_id"], r["host"], re.sub("[0-9]+", "#", r["path"]), r["template"], round(r["purity"], 9)) for r in got) == want
    assert any(r["template"].count("q") == 12 for r in got)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_ann(spark, metric):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x[100:160] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0, 2.0]), (1080, [None] * 16)]
    got = defaultdict(list)
    for r in additive_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, metric=metric).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q] if metric == "ip" else -((x - x[q]) ** 2).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -np.round(s, 9)))[:20]
        hit += len(set(want) & {v for _, v, _ in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21)) and all(sc == pytest.approx(s[v], abs=1e-6) for _, v, sc in found)
    assert hit / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_ann_on_rows_without_structure(spark, metric):
    """Many dimensions, near copies, norms far apart and one large component: none of the nearest is missed."""
    rng = np.random.default_rng(5)
    plain, near = rng.normal(size=(3000, 96)), rng.normal(size=96) + 1e-3 * rng.normal(size=(1500, 96))
    spread, offset = rng.normal(size=(1000, 96)) * 10 ** rng.uniform(-3, 0, (1000, 1)), 0.1 * rng.normal(size=(500, 96))
    offset[:, 0] += 5
    x = np.concatenate([plain, near, spread, offset])[rng.permutation(6000)]
    got = defaultdict(set)
    for r in additive_ann.search(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, metric=metric).collect():
        got[r["query_id"]].add(r["vec_id"])
    for q in range(0, 6000, 20):
        s = x @ x[q] if metric == "ip" else -((x - x[q]) ** 2).sum(axis=1)
        s[q] = -np.inf
        assert got[q] == set(np.lexsort((np.arange(6000), -s))[:20].tolist())


def test_ann_deep_and_repeated(spark):
    """More neighbours than a block's least depth, and rows that repeat an id: only a query's own row is no candidate."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    ids = [*range(396), 0, 20, 20, 5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").withColumn("row", F.lit("x")).withColumn("block", F.lit(1)).repartition(3)
    got = defaultdict(list)
    for r in additive_ann.search(df, F.col("vec_id") % 20 == 0, top=100).collect():
        got[r["query_id"], r["rank"]].append((r["score"], r["vec_id"]))
    scores, hit, total = x.astype(float) @ x.astype(float).T, 0, 0
    for q in set(ids):
        if q % 20 == 0:
            rows = [k for k, i in enumerate(ids) if i == q]
            want = sorted(sorted(((-scores[k, m], ids[m]) for m in range(400) if m != k))[:100] for k in rows)
            found = [got[q, n] for n in range(1, 101)]
            assert all(len(f) == len(rows) for f in found)
            hit += sum(len(set(f[1] for f in fs) & {w[n][1] for w in want}) > 0 for n, fs in enumerate(found))
            total += 100
    assert hit >= 0.9 * total


def test_shards_in_a_store(monkeypatch, tmp_path):
    """Arrays in a folder that can't be mapped are read by shard, as many at a time as are kept."""
    from pyarrow import fs

    from offerlens.llm import arrays

    monkeypatch.setattr(arrays, "_local", lambda folder: None)
    monkeypatch.setattr(arrays, "_remote", lambda folder: (fs.LocalFileSystem(), folder))
    monkeypatch.setattr(arrays, "KEPT", 3)
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    of = arrays.shard_of(keys, 9)
    for k in range(8):
        arrays.put(str(tmp_path), k, key=keys[of == k], n=(keys[of == k] % np.uint64(1000)).astype(np.uint32 if k % 2 else np.int64))
    held, n = arrays.Shards(str(tmp_path), 9, ("key", "n")).lookup(np.concatenate([keys[::-1], keys + np.uint64(1)]), "n")
    assert held[:500].tolist() == (of[::-1] < 8).tolist() and not held[500:].any()
    assert n[:500].tolist() == np.where(of[::-1] < 8, keys[::-1] % np.uint64(1000), 0).tolist()


def test_language_finds_more_than_three(spark):
    words = {"a": "abba bacca cabab acbac ", "d": "deffe edfed feded dfefd ", "g": "ghiig ighhi hgihg gihig ", "j": "jkllk lkjjl kljkj jlkjl ", "m": "mnoon onmmo nmono mnomn "}
    model = language.Mixture(*language.train(spark.createDataFrame([(w * 40, k) for k, w in words.items()], "text string, lang string")))
    texts = spark.createDataFrame([("".join(words[k] * 60 for k in some),) for some in ("adgjm", "adgj", "a")] + [("12",), (None,)], "text string")
    rows = [r["language"] for r in language.identify(texts, model).collect()]
    assert [r["languages"] for r in rows[:3]] == [5, 4, 1]
    assert [[p["lang"] for p in r["proportions"]] for r in rows] == [list("adgjm"), list("adgj"), ["a"], [], []]
    assert all(abs(p["share"] - 1 / len(r["proportions"])) < 0.02 for r in rows for p in r["proportions"])
    assert all(abs(sum(p["share"] for p in r["proportions"]) - 1) < 1e-9 and abs(max(p["share"] for p in r["proportions"]) - r["score"]) < 1e-9 for r in rows[:3])


def brute_mixture(model, text):
    """Shares by language, and how many are chosen: EM on the list of a text's trigrams, one text at a time."""
    data = np.frombuffer(text.encode(), np.uint8)
    cells = [int(c) for c in language._cells(data) if c >= 0]
    lik, n, share = model.lik.T[cells], len(cells), np.full(len(model.langs), 1 / len(model.langs))

    def em(share, rounds):
        for _ in range(rounds):
            part = lik * share
            share = (part / part.sum(axis=1, keepdims=True)).sum(axis=0) / n
        return share, np.log((lik * share).sum(axis=1)).sum()

    share, _ = em(share, model.rounds)
    order, best = np.argsort(-share, kind="stable"), (-np.inf, None, 0)
    for k in range(1, len(model.langs) + 1):
        start = np.zeros(len(share))
        start[order[:k]] = share[order[:k]] + 1e-9
        fitted, ll = em(start / start.sum(), 4 if k > 1 else 0)
        best = max(best, (ll - model.penalty * (k - 1) * np.log(n + 1), tuple(fitted), k), key=lambda b: b[0])
    return np.array(best[1]), best[2]


def test_language_against_em(spark):
    """Held-out accuracy on whole documents, and every share against a plain EM; among the texts, very long ones and mixtures."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    model = language.Mixture(*language.train(spark.createDataFrame([(r["text"], r["lang"]) for r in train], "text string, lang string")))
    by_lang = {r["lang"]: r["text"] for r in train if r["text"]}
    texts = [r["text"] for r in rows if r["text"]] + ["".join(by_lang.values()), max(by_lang.values(), key=len) * 40]
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3), model).collect()
    for r in got:
        share, size = brute_mixture(model, texts[r["k"]])
        assert r["language"]["languages"] == size and r["language"]["lang_pred"] == model.langs[int(share.argmax())]
        assert [p["share"] for p in r["language"]["proportions"]] == pytest.approx(share[share > 0].tolist(), abs=1e-6)
    held = language.op9_language_id(spark, "/root/testdata/sf0.001").filter("held_out").join(docs, "doc_id").filter("lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) > 0


def test_language_of_short_and_strange_texts(spark):
    """One letter has the commonest language; a script that training lacks has no score; without languages all is unknown."""
    model = language.Mixture(*language.train(spark.createDataFrame([("the cat and the dog", "en")] * 3 + [("aé le chat", "de"), (None, "xx"), ("x", None)], "text string, lang string")))
    texts = ["I", "ok", "日本", "日本語の文章です", "the 日本", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("language", F.lit(1)).withColumn("lang", F.lit(2))
    got = [r["language"] for r in language.identify(df, model).collect()]
    assert [r["lang_pred"] for r in got[:2]] == ["en", "en"] and [r["score"] for r in got[:2]] == [0.75, 0.75] and got[0]["languages"] == 0
    assert got[2]["score"] == got[3]["score"] == 0 and 0 < got[4]["score"] < 0.7 and got[5]["score"] > 0
    none = language.Mixture(*language.train(spark.createDataFrame([("the cat", None), (None, "en")], "text string, lang string")))
    assert {(r["language"]["lang_pred"], r["language"]["score"]) for r in language.identify(df, none).collect()} == {("und", 0.0)}


def test_language(docs, spark):
    model = language.Mixture(*language.train(spark.createDataFrame([("the cat and the dog with that thing " * 5, "en"), ("le chat et le chien avec une chose " * 5, "fr")] * 3, "text string, lang string")))
    texts = [("the thing with the dog and that cat", "en"), ("une chose avec le chien et le chat", "fr"), ("12 34", "und"), ("", "und"), (None, "und"), ("ß", None)]
    rows = language.identify(spark.createDataFrame(texts, "text string, want string"), model).collect()
    assert all(r["language"]["lang_pred"] == r["want"] for r in rows if r["want"]) and all(0 <= r["language"]["score"] <= 1 for r in rows)
    both = language.identify(spark.createDataFrame([("the cat and the dog with that thing " * 20 + "le chat et le chien avec une chose " * 12,)], "text string"), model).first()
    assert both["language"]["languages"] == 2 and 0.5 < both["language"]["score"] < 0.8


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, keep):
    groups = defaultdict(list)
    for d, t, *_ in DOCS:
        groups[t or ""].append(d)
    best = max if keep == "largest" else min
    want = {d: (best(ds), len(ds), d == best(ds), hashlib.sha256(t.encode()).hexdigest()) for t, ds in groups.items() for d in ds}
    assert result(exact_dedup.exact_groups(docs, F.col("text"), keep=keep)) == want


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup_of_tasks_of_many_batches(spark, monkeypatch, keep):
    """A task gets its runs in batches of 10,000 rows or fewer; texts of one group meet across them, whatever their number."""
    monkeypatch.setattr(common, "shuffle_partitions", lambda spark: 2)
    ids = [d * 37 % 1000 for d in range(1000)]
    df = spark.createDataFrame([(d, f"t{d % 7}" if d % 3 else f"lone {d}") for d in ids], "doc_id long, text string").repartition(3)
    groups = defaultdict(list)
    for d in ids:
        groups[f"t{d % 7}" if d % 3 else f"lone {d}"].append(d)
    best = max if keep == "largest" else min
    want = {d: (best(ds), len(ds), d == best(ds), hashlib.sha256(t.encode()).hexdigest()) for t, ds in groups.items() for d in ds}
    for rows in ("1", "4", "150"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = result(exact_dedup.exact_groups(df, F.col("text"), keep=keep, fan_in=2))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want


def test_exact_dedup_spreads_rows_of_one_id(spark, monkeypatch):
    """Leaves are chosen by id and place: rows without an id lie in all of them."""
    seen = []
    kept = common.checkpointed
    monkeypatch.setattr(common, "checkpointed", lambda df: seen.append(kept(df)) or seen[-1])
    df = spark.createDataFrame([(None, f"t{k % 50}") for k in range(400)], "doc_id long, text string").repartition(2)
    got = exact_dedup.exact_groups(df, F.col("text")).collect()
    assert len(got) == 400 and all(r.keep_id is None and r.group_size == 8 and r.kept for r in got)
    assert seen[0].select("leaf").distinct().count() == common.shuffle_partitions(spark)


def test_clashing_columns_and_long_texts(spark):
    """Columns named like those that operators use or give, null in every column, ties, repeated rows and a very long text change no answer."""
    import public_tokenizers

    long = " ".join(f"w{k % 5000} x{k * k % 977}" for k in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, "short text of six words here"), (3, "short text of six words here"), (4, None), (5, ""), (None, "lone text without an id at all")]
    plain = spark.createDataFrame([(*r, None, None if r[0] == 5 else "en") for r in rows], "doc_id long, text string, source string, lang string").repartition(3)
    names = ["lm", "perplexity", "train_tokens", "language", "h", "row", "class", "n", "size", "copies", "shard", "b", "salt", "_salt", "digest", "leaf", "component_id"]
    full = plain.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    path = public_tokenizers.path("word_bpe_49k.json")
    model = language.Mixture(*language.train(plain))
    ways = [
        lambda d: near_dedup.near_groups(d), lambda d: mixing.mix(d), lambda d: packing.pack(d, path), lambda d: suffix_dedup.repeated_spans(d), lambda d: pii.find(d, None),
        lambda d: kneser_ney.score_texts(d, F.col("doc_id") == 3).select("doc_id", "lm", "perplexity", "train_tokens"),
        lambda d: language.identify(d, model).select("doc_id", "language"), lambda d: exact_dedup.exact_groups(d, F.col("text")),
    ]
    for way in ways:
        want, got = way(plain).collect(), way(full).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
        assert len({r["doc_id"] for r in got}) == 6 and len(got) >= len(rows)
    near = {r["doc_id"]: r for r in near_dedup.near_groups(full).collect()}
    assert (near[2]["component_id"], near[1]["component_id"], near[4]["n_shingles"]) == (1, 1, 0)
    spans = {r["doc_id"]: r for r in suffix_dedup.repeated_spans(full).collect()}
    assert spans[2]["n_removed"] == len(long) and spans[1]["n_removed"] == 0
    scored = {r["doc_id"]: r["lm"] for r in kneser_ney.score_texts(full, F.lit(False)).collect()}
    assert scored[1]["n_tokens"] == 120_001 and scored[5]["n_tokens"] == 1


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "z"), (9, "z")], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df, F.col("text")).collect()) == [(0, 7, 4, False)] * 2 + [(7, 7, 4, True)] * 2 + [(9, 9, 2, True)] * 2
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in near_dedup.near_groups(df).collect()) == [(0, 7)] * 2 + [(7, 7)] * 2 + [(9, 9)] * 2
    assert mixing.mix(df).count() == 6 and suffix_dedup.repeated_spans(df).count() == 6


def test_empty_tables(empty, spark):
    import public_tokenizers

    assert near_dedup.near_groups(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert suffix_dedup.repeated_spans(empty).count() == 0
    assert kneser_ney.score_texts(empty, F.lit(False)).count() == 0
    assert pii.find(empty, pii.train(empty)).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert additive_ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0
    assert language.identify(empty, language.Mixture(*language.train(empty))).count() == 0
    assert exact_dedup.exact_groups(empty, F.col("text")).count() == 0


def test_one_shard_a_task(spark):
    rows = spark.range(5000).withColumn("shard", (F.col("id") % 1024).cast("int")).repartition(3)
    spread = rows.repartitionById(1024, F.col("shard"))
    tasks = spread.select("shard", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == 1024 and all(r.shard == r.task for r in tasks)
    grouped = common.by_shard(rows, 1024).applyInArrow(lambda t: t.slice(0, 1).select(["shard"]), "shard int")
    assert sorted(r.shard for r in grouped.collect()) == list(range(1024))
