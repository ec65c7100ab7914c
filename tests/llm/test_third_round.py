"""Chat formatting, whitening and the Merkle manifest against plain versions, with their edge cases."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from playmill.llm import chat, common, merkle, urls, whitening

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()

TURNS = "conv_id long, turn long, role string, text string"
ODD_TEXTS = ["\\### Assistant: </turn> ok", "", None, "\\", "\\\\</turn>\n", "### : ### ", "</turn", "</turn></turn>", "a: b:: c:", "#\\## <\\/turn>", "日本語 😀\n\n", "x" * 50_000]


def conversations(spark):
    rows = [(1, i, ("user", "assistant", "system", "a: b</turn>", None)[i % 5], t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(2, 0, "user", "only asks")] + [(3, None, "user", "first"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (3, 0, "Assistant", "y"), (3, 5, "user", "tail")]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "r")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i} </turn>") for i in range(150)]  # most of all rows
    return spark.createDataFrame(rows, TURNS).withColumn("block", F.lit("x")).withColumn("head", F.lit(1)), rows


def in_order(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


@pytest.mark.parametrize("block", [64, 7, 1])
def test_chat_is_read_back(spark, block):
    df, rows = conversations(spark)
    examples = chat.chat_examples(df.repartition(5), block).cache()
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    want = in_order(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == H(*[f"{r}\n{t}\n" for r, t in turns])
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), H(loss))
    assert sum(len(r.text) for r in examples.collect()) == sum(r.formatted_chars for r in got.values())
    assert max(r.text.count(chat.CLOSE) for r in examples.collect()) <= block


def test_whole_examples_hold_every_turn_before_the_reply(spark):
    df, rows = conversations(spark)
    found = [r for r in chat.whole_examples(chat.chat_examples(df, 7)).collect() if r.conv_id == 4]
    write = lambda i: f"### {('user', 'assistant')[i % 2]}: turn {i} <\\/turn></turn>\n"
    replies = {r.text: r.text[r.loss_start : r.loss_end] for r in found if r.loss_end > r.loss_start}
    assert replies == {"".join(map(write, range(i + 1))): f"turn {i} <\\/turn>" for i in range(1, 150, 2)}


def test_the_chat_query_writes_out_every_context(spark, tmp_path, monkeypatch):
    """A reply behind more than 64 turns was an example of its own block only."""
    import duckdb

    from playmill.llm import queries

    df, rows = conversations(spark)
    more = [(None, i, ("user", "assistant")[i % 2], f"n {i}") for i in range(2, 140)]
    df.select("conv_id", "turn", "role", "text").union(spark.createDataFrame(more, TURNS)).write.parquet(str(tmp_path / "conversations.parquet"))
    seen, read_back = [], chat.read_back
    monkeypatch.setattr(chat, "read_back", lambda examples: seen.append(examples) or read_back(examples))
    got = queries.op11_chat_formatting(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op11_chat_formatting"])
    names = [d[0] for d in want.description]
    assert sorted(map(str, got.select(*names).collect())) == sorted(str(spark.createDataFrame([r], got.select(*names).schema).first()) for r in want.fetchall())
    texts = {}
    for r in seen[0].collect():
        texts.setdefault(r.conv_id, []).append((r.text.count(chat.CLOSE + "\n"), r.text[r.loss_start : r.loss_end]))
    for conv, turns in in_order(rows + more).items():
        plain = lambda t: t.replace("\\", "\\\\").replace("### ", "#\\## ").replace(": ", ":\\ ").replace("</turn>", "<\\/turn>")
        replies = [(i + 1, plain(t)) for i, (role, t) in enumerate(turns) if role == "assistant"]
        tail = [(len(turns), "")] if turns[-1][0] != "assistant" else []
        closing = [(n, "") for n in range(64, len(turns), 64) if turns[n - 1][0] != "assistant"]
        assert sorted(texts[conv]) == sorted(replies + tail + closing)


def test_chat_cases(spark):
    df, _ = conversations(spark)
    assert chat.read_back(chat.chat_examples(df.limit(0))).count() == 0
    twice = chat.read_back(chat.chat_examples(df.where("conv_id = 2").union(df.where("conv_id = 2")))).first()
    assert twice.n_turns == 2 and twice.loss_chars == 0
    plan = chat.read_back(chat.chat_examples(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_whitening(x, k=16):
    x = np.unique(x, axis=0)
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    return len(x), x.sum(axis=0), values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("x")).withColumn("x", F.lit(1))


@pytest.mark.parametrize("kind", ["flat", "gap"])
def test_whitening(spark, kind):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(400, 40)).astype(np.float32)
    if kind == "gap":  # sixteen strong directions: the range finder ends without the full dimension
        m = (rng.normal(size=(400, 16)) * np.geomspace(300, 60, 16)) @ np.linalg.qr(rng.normal(size=(40, 16)))[0].T + 1e-3 * m
        m = m.astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(m)] + [(1000 + i, [float(v) for v in m[0]]) for i in range(200)]
    rows += [(-1, None), (-2, []), (-3, [None] + [0.0] * 39), (-4, [float("nan")] * 40), (-5, [float("inf")] * 40), (-6, [1.0] * 39), (None, [float(v) for v in m[1]])]
    df = vectors_of(spark, rows)
    model = whitening.fit_whitening(whitening.integer_vectors(df))
    if kind == "gap":
        model = whitening.fit_whitening(whitening.integer_vectors(df), tolerance=1e-11, passes=8)
        assert model.directions == 24
    else:
        assert model.directions == 40
    x = np.floor(64 * m.astype(np.float64)).astype(np.int64) + 1_000_000
    n, sums, values, vectors, trace = plain_whitening(x)
    got = whitening.whiten(whitening.integer_vectors(df), model).collect()
    assert len(got) == 601 * 16 and {r.n for r in got} == {n} == {400}
    by = {(r.vec_id, r.component): r for r in got}
    assert (None, 1) in by and (1000, 3) in by
    white = (x - sums / n) @ vectors / np.sqrt(values)
    for j in range(16):
        mine = np.array([by[i, j + 1].whitened for i in range(400)])
        sign = np.sign(mine @ white[:, j])
        assert np.abs(sign * mine - white[:, j]).max() < 1e-6
        assert abs(by[0, j + 1].explained / (values[j] / trace) - 1) < 1e-9
    assert by[0, 1].deviation == sum(int(v) ** 2 for v in n * x[0] - sums) and max(r.identity_error for r in got) < 1e-8
    assert by[1000, 5].whitened == by[0, 5].whitened


def test_whitening_cases(spark):
    df = vectors_of(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [0.5, 1.0])])
    assert whitening.whiten_embeddings(df.limit(0)).count() == 0
    assert whitening.whiten_embeddings(df).count() == 0  # no variance, no component
    line = vectors_of(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])
    rows = whitening.whiten_embeddings(line).collect()
    assert len(rows) == 5 and all(r.component == 1 and abs(r.explained - 1) < 1e-9 for r in rows)
    wide = whitening.whiten_embeddings(vectors_of(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])])).collect()
    assert len(wide) >= 3 and {r.deviation for r in wide if r.vec_id == 1} == {None}
    x, n = np.array([[2**53, 1], [0, 0]]), 3
    assert whitening.deviations(x, n, [2**53, 1]) == [None, None]
    assert whitening.deviations(np.array([[10**8, 7]]), 10, [5, 6]) == [(10**9 - 5) ** 2 + 64**2]


def plain_tree(nodes):
    """Root and the proofs (siblings, place) of every node."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 3 * 3 : k // 3 * 3 + 3]
            proofs[i].append((run[: k % 3], run[k % 3 + 1 :]))
        at, level = [k // 3 for k in at], [H(*level[j : j + 3]) for j in range(0, len(level), 3)]
    return level[0], proofs


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H(*map(field, (r[0], r[3], r[2], r[4], t)))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names]
    root, above = plain_tree([t[0] for t in trees])
    out = []
    for s, (subroot, proofs), up in zip(names, trees, above):
        for (_, _, own, r), proof in zip(sorted(groups[s], key=lambda x: x[:3]), proofs):
            way = proof + up
            shown = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                shown = leaf(r, r[1].replace("\n", ""))
            for left, right in way:
                shown = H(*left, shown, *right)
            out.append((r[0], own, subroot, root, H(*[x for a, b in way for x in a + b]), shown, shown == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rows = [(i, f"text {i}\nmore" if i % 3 else f"plain {i}", "en" if i % 4 else None, "hot", i if i % 5 else None) for i in range(150)]
    rows += [(5, "one and the same\n", "en", "same", 17)] * 90  # repeated rows of one doc_id
    rows += [(7, "b", "en", "same", 1), (7, "a\n", "en", "same", 1), (None, "no id\n", "en", "same", 1)]
    rows += [(900, "", "en", None, 0), (901, None, None, None, None), (902, "é\n" * 30_000, "en", None, 60_000), (-4, "lone\n", "en", "", 1), (903, "x", "en", "ümlaut", 1)]
    return rows + [(1000 + i, "t\n", "en", f"src{i}", 2) for i in range(20)]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(spark, levels):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("grp", F.lit(None).cast("string")).repartition(7)
    got = merkle.document_manifest(df, levels=levels, with_proof=True).collect()
    assert sorted([tuple(r)[:7] for r in got], key=repr) == plain_manifest(rows)
    for r in got:
        assert merkle.fold(r.leaf.encode(), r.proof, r.steps).decode() == r.root
        assert hashlib.sha256(r.proof).hexdigest() == r.proof_sha256
    assert {r.verified for r in got} == {True, False}


def test_manifest_cases(spark):
    one = spark.createDataFrame([(3, "x", None, None, None)], DOCS)
    r = merkle.document_manifest(one, with_proof=True).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == H() and r.verified and r.proof == r.steps == b""
    assert merkle.document_manifest(one.limit(0)).count() == 0


def test_range_rank_splits_equal_rows(spark):
    df = common.materialize(spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("v")), "rows")
    got = common.range_rank(df, "g", ["v"], 16)
    rows = got.collect()
    for g in {r.g for r in rows}:
        own = sorted((r.rank, r.v) for r in rows if r.g == g)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own)
        assert {r.members for r in rows if r.g == g} == {len(own)}
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 1500


def test_patterns_end_near_a_lower_bound(caplog):
    from playmill.llm import packing

    rng = np.random.default_rng(0)
    for lengths, room in ((np.clip(rng.lognormal(4.5, 1.0, 400_000).astype(int), 1, 511), 512), (rng.integers(100, 250, 20_000), 512)):
        demand = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
        patterns = packing.solve_patterns(demand, room)
        classes = np.array(sorted(demand))
        assert list(sum(p.counts * p.times for p in patterns)) == [demand[c] for c in classes]
        assert all((p.counts * classes).sum() <= room for p in patterns)
        assert sum(p.times for p in patterns) <= 1.005 * lengths.sum() / room + 1
    assert "left after" not in caplog.text


def test_first_fit_basis_is_feasible():
    from playmill.llm import packing

    rng = np.random.default_rng(2)
    for m in (1, 2, 7, 60):
        classes = np.sort(rng.choice(np.arange(1, 65), m, replace=False)).astype(np.int64)
        need = rng.integers(1, 9, m).astype(float)
        x = np.linalg.solve(packing._first_fit_basis(need, classes, 64 // classes, 64), need)
        assert x.min() > -1e-9


def test_caches_are_bounded_in_characters():
    cache = common.Remembered(limit=1000, chars=5000)
    long = "x" * 100_000
    got = cache.fill({long, "a"}, lambda new: [len(k) for k in new])
    assert got[long] == 100_000 and got["a"] == 1
    again = cache.fill({"b"}, lambda new: [len(k) for k in new])
    assert long not in again and {"a", "b"} <= again.keys()  # the long text is gone, the short ones are not
    for i in range(300):
        cache.fill({f"{i:060d}{k}" for k in range(10)}, lambda new: [0 for _ in new])
        assert sum(map(len, cache.young)) + sum(map(len, cache.old)) <= 2 * (5000 + 100_000 + 700)
    assert sum(map(len, cache.young)) <= 5700 and cache.fill({"z"}, lambda new: ["v"])["z"] == "v"


def test_pieces_of_texts_without_spaces_are_not_kept():
    import sentencepiece

    from playmill.llm import pieces
    from playmill.llm.queries import tokenizer_file

    rng = np.random.default_rng(3)
    codec = pieces.PieceCodec(tokenizer_file("piece_bpe_32k.model"))
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    for _ in range(20):
        texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 2000))) for _ in range(10)]
        for text, (n, ids, decoded) in zip(texts, codec.encode_batch(texts)):
            assert ids == ",".join(map(str, lib.encode(text))) and decoded == text and n == ids.count(",") + 1
    codec.encode_batch(["end"])
    assert not [w for w in codec.words.young if len(w) > 64]


# 5: a hub among the hosts


def test_hub_edges_are_dealt_to_salts(spark):
    pairs = [("hub.x", f"h{i}.x", 1 + i % 3) for i in range(3000)] + [(f"h{i}.x", f"h{(i * 7 + 1) % 3000}.x", 1) for i in range(3000)] + [(f"h{i}.x", "hub.x", 2) for i in range(3000)]
    links = spark.createDataFrame(pairs, "src string, dst string, links long")
    for a, b in (("src", "dst"), ("dst", "src")):
        edges, hubs = urls.weighted_edges(links, a, b)
        assert [r.hub for r in hubs.collect()] == ["hub.x"]
        rows = edges.collect()
        assert len(rows) == len(pairs) and {r.salt for r in rows if r.src != "hub.x"} == {0}
        parts = {}
        for r in rows:
            if r.src == "hub.x":
                parts[r.salt] = parts.get(r.salt, 0) + 1
        assert len(parts) == 32 and max(parts.values()) < 200 and sum(parts.values()) == 3000
        sent, weights = {}, {}
        for p in pairs:
            s, t = (p[0], p[1]) if a == "src" else (p[1], p[0])
            sent[s] = sent.get(s, 0) + p[2]
            weights[s, t] = weights.get((s, t), 0) + p[2]
        want = {"h1.x": 0.15, "hub.x": 0.15}
        for _ in range(3):
            out = {"h1.x": 0.15, "hub.x": 0.15}
            for (s, t), w in weights.items():
                if s in want:
                    out[t] = out.get(t, 0.0) + 0.85 * want[s] * w / sent[s]
            want = out
        seeds = spark.createDataFrame([("h1.x", 1.0), ("hub.x", 1.0)], "host string, mass double")
        got = {r.host: r.score for r in urls.propagate(seeds, edges, hubs, 0.85, 3, every=2).collect()}
        assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-12 for h in want)
