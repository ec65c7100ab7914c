"""The training-data operators against brute force, libraries and planted cases, with their edge cases."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from playmill.llm import lines, near, onebit, packing, pieces, quality, sharding, toxicity, urls, voronoi
from playmill.llm.queries import URL_RULES, tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Words of white space, odd marks, other scripts, spaces in runs, the space mark itself, special strings.
ODD = [None, "", " ", "  a  b ", "x▁y ▁▁", "naïve café\n\n  über-straße", "日本語 テキスト", "\u0000\u0001\t\r\n", "á é", "<s> </s> <|endoftext|>x", "don't CAN'T 'sup 12,345.67 …—", "😀 emoji 👨‍👩‍👧", "word " * 3000, "İstanbul ΣΑΣ ß ﬁ", "</w> a</w>b", " nbsp em\u0085nel\x1cfs"]


def docs_of(spark, texts, extra=True):
    df = spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate(texts)], DOCS)
    return df.withColumn("score", F.lit(1)).withColumn("component_id", F.lit("x")) if extra else df


@pytest.fixture(scope="module")
def some_texts():
    rng = np.random.default_rng(3)
    stems = ["the", "of", "ra", "tion", "er", "in", "ness", "un", "able", "st", "re", "ly"]
    words = ["".join(rng.choice(stems, rng.integers(1, 4))) for _ in range(900)]
    return [" ".join(rng.choice(words, rng.integers(20, 120))).capitalize() + "." for _ in range(60)]


def test_pieces(spark, some_texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    texts = ODD + some_texts
    got = {r.doc_id: r for r in pieces.encode_texts(docs_of(spark, texts), tokenizer_file("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert list(got[i].ids) == ids, repr(t)
        assert got[i].decoded == lib.decode(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[i].n_tokens == len(ids)
    assert pieces.encode_texts(docs_of(spark, texts).limit(0), tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_packing(spark, some_texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    texts = ODD + some_texts + ["long text here " * 4000]
    rows = packing.pack_documents(docs_of(spark, texts), tokenizer_file("word_bpe_49k.json")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32, repr(t)
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 4096) + 1
    assert packing.pack_documents(docs_of(spark, ODD).limit(0), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_patterns_hold_all_items():
    rng = np.random.default_rng(1)
    for _ in range(5):
        demand = {int(w): int(n) for w, n in zip(rng.integers(1, 24, 20), rng.integers(1, 500, 20))}
        patterns = packing.solve_patterns(demand, 64)
        classes = sorted(demand)
        held = sum(p.counts * p.times for p in patterns)
        assert list(held) == [demand[c] for c in classes]
        assert all((p.counts * np.array(classes)).sum() <= 64 for p in patterns)
        assert sum(p.times for p in patterns) <= 1.02 * sum(c * n for c, n in demand.items()) / 64 + len(classes)


def test_sharding(spark):
    df = docs_of(spark, [None, "", "é"] + [f"t{i}" for i in range(3000)])
    rows = sharding.shard_documents(df.unionByName(df.limit(1))).collect()
    assert len(rows) == 3004
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows) and any(r.grown_shard == 8 for r in rows)
    assert {r.doc_id: r.size for r in rows}[0] == 1 and {r.doc_id: r.size for r in rows}[2] == 3
    tree = sharding.balanced_tree(8)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in tree]
    both = df.select(sharding.shard_column(F.col("doc_id"), tree).alias("a"), sharding.shard_column(F.col("doc_id"), heavier).alias("b")).collect()
    place = {x.shard: (x.region, x.rack) for x in tree}
    moved = [r for r in both if r.a != r.b]
    assert moved and all(place[r.b][0] == place[5][0] for r in moved)
    assert sharding.shard_documents(df.limit(0)).count() == 0


def exact_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else {(x,) for x in w})
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_texts(some_texts, copies=40):
    rng = np.random.default_rng(5)
    out = list(some_texts) + [None, "", "  ", "one", "ONE", "two words", "Two  words\n"]
    for base in some_texts[:6]:
        words = base.split()
        for _ in range(copies):
            w = list(words)
            for k in rng.integers(0, len(w), int(rng.integers(0, max(2, len(w) // 7)))):
                w[k] = f"z{rng.integers(1000)}"
            out.append(" ".join(w))
    return out + out[:10]


@pytest.mark.parametrize("block", [400_000, 3000])
def test_near_duplicates(spark, some_texts, block):
    texts = near_texts(some_texts)
    comp, sizes = exact_components(texts)
    got = {r.doc_id: r for r in near.near_duplicates(docs_of(spark, texts), near.NearSettings(block=block)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (comp[i] == i) for i in got)


def test_near_duplicates_edges(spark):
    df = docs_of(spark, ["a b c", "a b c"])
    twice = df.unionByName(df)
    assert sorted(r.component_id for r in near.near_duplicates(twice).collect()) == [0, 0, 0, 0]
    assert near.near_duplicates(df.limit(0)).count() == 0
    assert [r.component_id for r in near.near_duplicates(docs_of(spark, [None, ""])).orderBy("doc_id").collect()] == [0, 1]


def test_odd_sketch_estimates(spark, some_texts):
    texts = [some_texts[0], some_texts[0] + " tail words", some_texts[1]]
    s = near.NearSettings()
    sig = near.signatures(docs_of(spark, texts), s).select("doc_id", "sketch")
    pairs = sig.select(F.col("doc_id").alias("u"), F.col("sketch").alias("sketch_u")).crossJoin(sig.select(F.col("doc_id").alias("v"), F.col("sketch").alias("sketch_v")))
    got = {(r.u, r.v): r.e for r in pairs.select("u", "v", near._estimate(s.bands * s.rows).alias("e")).collect()}
    assert got[0, 0] == 1.0 and got[0, 1] > 0.85 and got[0, 2] < 0.5


def test_lines(spark):
    long = "This passage of some length, more than ten words in all, is repeated in several places."
    texts = [f"Alpha one.\n{long}\nOmega one.", f"Beta starts here. {long} Then it ends.", "All rights reserved.", "Clean text.\nAll rights reserved.", None, "", long, f"{long}\n{long}"]
    df = docs_of(spark, texts)
    got = {r.doc_id: r for r in lines.remove_repeats(df).collect()}
    assert got[0].text == texts[0] and not got[0].removed
    assert got[1].text == "Beta starts here. Then it ends." and texts[1][got[1].removed[0].start : got[1].removed[0].end].strip() == long
    assert got[3].text == texts[3] and got[4].text is None and got[5].text == ""
    assert got[6].text == "" and got[7].text.strip() == ""
    assert got[0].score == 1 and lines.remove_repeats(df).columns == [*df.columns, "removed"]
    hot = {r.doc_id: r.text for r in lines.remove_repeats(df.unionByName(df)).collect()}
    assert hot[0] == texts[0] and lines.remove_repeats(df.limit(0)).count() == 0


def test_lines_hot_digests_agree(spark, some_texts):
    df = docs_of(spark, [f"{some_texts[i % 3]}\n{some_texts[i]}" for i in range(50)])
    few, many = ({r.doc_id: sorted(r[1]) for r in lines.repeated_units(df, hot_share=h).collect()} for h in (1, 10_000))
    assert few == many


def test_lines_inside_long_sentences(spark):
    rng = np.random.default_rng(6)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    runs = [words(50) for _ in range(20)]
    texts = [" ".join(words(20) + r + words(20)) for r in runs + runs]
    got = {r.doc_id: r for r in lines.remove_repeats(docs_of(spark, texts)).collect()}
    windows = lambda text: {tuple(text.split()[i : i + 50]) for i in range(len(text.split()) - 49)}
    for i, r in enumerate(runs):
        assert got[i].text == texts[i]
        assert got[i + 20].text != texts[i + 20] and tuple(r) not in windows(got[i + 20].text)
        assert all(set(texts[i + 20][x.start : x.end].split()) <= set(r) for x in got[i + 20].removed)


def test_voronoi(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((300, 8)) + 4 * rng.standard_normal((1, 8)), rng.standard_normal((300, 8)), np.tile(rng.standard_normal(8), (60, 1))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))] + [(700, None), (750, [1.0, None] + [0.0] * 6), (800, [float("nan")] * 8), (850, [1.0]), (None, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = {}
    for r in voronoi.voronoi_top_k(df.unionByName(df.limit(40)), 5, 50, data_rows=100, query_rows=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    z = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    assert sorted(got) == list(range(0, 660, 50))
    for q in got:
        s = z @ z[q]
        want = sorted((-int(s[i]), i) for i in range(len(z)) if i != q)[:5]
        assert [got[q][k + 1] for k in range(5)] == [(i, -s) for s, i in want]
    assert voronoi.voronoi_top_k(df.limit(0), 5, 50).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in voronoi.voronoi_top_k(few, 5, 50).collect()] == [(0, 1, 1, 256 * 128)]


def test_one_bit(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((1200, 32)), np.tile(rng.standard_normal(32), (100, 1))]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1300, None), (1400, [0.0] * 32), (1500, [float("inf")] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in onebit.one_bit_neighbours(df, 10, 100, data_rows=300).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    d, hit = x.astype(float), 0
    assert sorted(got) == list(range(0, 1300, 100))
    for q, found in got.items():
        dist = np.sqrt(((d - d[q]) ** 2).sum(axis=1))
        want = [i for _, i in sorted((dist[i], i) for i in range(len(d)) if i != q)[:10]]
        hit += len(set(want) & {v for _, v, _ in found})
        assert all(abs(s - dist[v]) < 1e-12 for _, v, s in found) and [k for k, _, _ in sorted(found)] == list(range(1, 11))
    assert hit >= 0.9 * 10 * len(got)
    assert onebit.one_bit_neighbours(df.limit(0), 10, 100).count() == 0


def test_urls(spark):
    link = lambda h: f'<a class=x href="https://{h}/p?q=1">x</a>'
    rows = [
        (0, "http://WWW.Example.NET/en/1?x", None), (1, "https://x.example.net/fr/2#t", ""), (2, "https://a.example.com/de/5", None), (3, "https://b.org/fr/1", link("good.edu")),
        (4, None, None), (5, "nothing", None), (6, "ftp://good.edu", None), (7, "http://bad.net/x", None), (8, "http://pointer.edu/x", link("bad.net") + link("BAD2.net")), (9, "http://bad2.net", link("bad.net")), (10, "http://other.edu/", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(9))
    got = {r.page_id: r for r in urls.judge_urls(df, URL_RULES, threshold=0.4).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[1].rule, got[1].verdict, got[2].rule, got[3].rule) == ("net/", "block", "example.com/de/", "org/fr/")
    assert (got[4].host, got[4].path, got[4].verdict, got[5].host) == ("", "", "allow", "")
    assert got[6].trust > 0 and got[6].verdict == "allow" and got[10].verdict == "allow"
    assert got[8].rule is None and got[8].verdict == "block"
    assert got[9].path == "" and got[9].rule is None
    assert urls.judge_urls(df.limit(0), URL_RULES).count() == 0


@pytest.mark.parametrize("n", [1, 2, 40])
def test_urls_blocked_whatever_the_in_degree(spark, n):
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    rows = [(0, "http://bad.net/x", None), (1, "http://mixed.edu/", link("bad.net", "a.edu", "b.edu", "c.edu", "d.edu")), (2, "http://other.edu/", link("a.edu"))]
    df = spark.createDataFrame(rows[: 1 if n == 1 else 3] + [(10 + i, f"http://p{i}.edu/", link("bad.net")) for i in range(n)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge_urls(df, URL_RULES).collect()}
    assert all(got[10 + i].verdict == "block" and got[10 + i].rule is None and got[10 + i].distrust > 0 for i in range(n))
    assert n == 1 or got[1].verdict == got[2].verdict == "allow"


def toxic_set(some_texts):
    bad = ["scumbag", "scumbags", "scumball", "dolt", "doltish", "dolts"]
    texts = [f"{t} {bad[i % 6]} {t[:40]} {bad[(i + 1) % 6]}." if i % 3 == 0 else t for i, t in enumerate(some_texts * 3)]
    return texts, [int(i % 3 == 0) for i in range(len(texts))]


def test_toxicity(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    texts, y = toxic_set([" ".join(rng.choice(words, 40)) for _ in range(120)])
    texts += [None, "", "   ", "scumbag"]
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, labels)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(df, model).collect()}
    assert np.mean([got[i].predicted == y[i] for i in range(len(y))]) > 0.97
    n = len(y)
    assert got[n].predicted == got[n + 1].predicted == got[n + 2].predicted == 0 and got[n + 3].predicted == 1
    assert [texts[n + 3][s.start : s.end] for s in got[n + 3].spans] == ["scumbag"]
    assert toxicity.toxicity_scores(df.limit(0), model).count() == 0
    none = toxicity.fit_toxicity(df, labels.limit(0))
    assert {r.score for r in toxicity.toxicity_scores(df, none).collect()} == {0.0}


def test_labelled_sample_keeps_all_whole_texts(spark):
    header = "A licence line that stands before every text of this source and has over eighty characters. "
    texts = [f"{header}text {i // 2}" for i in range(40)]
    labels = spark.createDataFrame([(i, i % 4 // 2 if i < 36 else i % 2) for i in range(40)], "doc_id long, toxic int")
    df = docs_of(spark, texts)
    df = df.unionByName(df).unionByName(df.where("doc_id = 0"))
    got, y, totals = toxicity.labelled_sample(df, labels, "toxic", F.lit(False), {1: 100, 0: 100}, 1000)
    assert sorted(zip(got, y)) == sorted({(texts[r.doc_id], r.toxic) for r in labels.collect()}) and len(got) == 22
    assert totals == {0: 20, 1: 20}
    few, y, _ = toxicity.labelled_sample(df, labels, "toxic", F.lit(False), {1: 5, 0: 7}, 1000)
    assert len(set(zip(few, y))) == 12 and sum(y) == 5


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    chain = toxicity.TokenChain(stay=np.array([[1.0, 0.3], [0.5, 2.0]]), constant=None)
    lengths = np.array([0, 1, 5, 300, 128, 129, 0, 700])
    u = rng.normal(-1, 2, lengths.sum())
    got, at = chain.marginals(u, lengths), 0
    for n in lengths:
        w = np.stack([np.ones(n), np.exp(u[at : at + n])], axis=1)
        a, b = np.zeros((n, 2)), np.ones((n, 2))
        v = np.array([1.0, 0.0])
        for t in range(n):
            v = (v @ chain.stay) * w[t]
            v /= v.sum()
            a[t] = v
        for t in range(n - 2, -1, -1):
            b[t] = chain.stay @ (w[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        if n:
            odds = np.log(a[:, 1] * b[:, 1]) - np.log(a[:, 0] * b[:, 0])
            assert np.allclose(odds, got[at : at + n], atol=1e-8)
        at += n


def test_quality(spark, some_texts):
    texts = [t.upper().replace(" ", "!! ") if i % 4 == 0 else t for i, t in enumerate(some_texts * 4)] + [None, "", "\n \n"]
    y = [int(i % 4 != 0) for i in range(len(texts) - 3)]
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality.fit_quality(df, labels)
    got = {r.doc_id: r for r in quality.quality_scores(df, model).collect()}
    assert np.mean([got[i].predicted == y[i] for i in range(len(y))]) > 0.97 and len(got) == len(texts)
    stats = quality.with_stats(df).select("__stats.*").toPandas()[quality.STATS].to_numpy()
    assert np.allclose(sorted(model.apply(stats)), sorted(r.score for r in got.values()))
    assert quality.quality_scores(df.limit(0), model).count() == 0
    assert quality.fit_quality(df, labels.limit(0)).rules == []
