"""The corpus operators against brute force on small fixtures, and their edge cases."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import common, components, licenses, minhash, mixing, piece_codec, quality, queries, subspace_join, suffix_radix, token_counts, warc, word_graph

DOC = "doc_id long, text string, source string, kept string, n_words string, th string, spans string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, (sources or {}).get(i, f"s{(i or 0) % 3}"), "x", "y", "z", "w") for i, t in texts]
    return spark.createDataFrame(rows, DOC)


def corpus(seed=1, n=60):
    """Random texts with shared passages, copies, near copies, and odd cases."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeéß😀") for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    passage = [rnd.choice(vocab) for _ in range(70)]
    texts = []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 160))]
        if i % 4 == 0:
            at = rnd.randint(0, len(w))
            w = w[:at] + passage[rnd.randint(0, 8) :] + w[at:]
        if i % 5 == 0 and texts and texts[-1][1]:
            w = texts[-1][1].split()
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        texts.append((i, rnd.choice([" ", "\n", "\t "]).join(w)))
    texts += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "a" * 700), (n + 4, "ab " * 300), (n + 5, texts[3][1]), (n + 6, texts[3][1]), (n + 7, "word"), (n + 8, "Word"), (n + 9, "x y\x1cz " * 60), (n + 10, "x y\x1cz " * 60)]
    rnd.shuffle(texts)
    return texts


def rows(df):
    return [r.asDict() for r in df.collect()]


def by_id(df, key="doc_id"):
    found = rows(df)
    assert len({r[key] for r in found}) == len(found)
    return {r[key]: r for r in found}


def plain_components(ids, links):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


EMPTY = "doc_id long, text string, source string"


@pytest.mark.parametrize("operator", [word_graph.remove_passages, suffix_radix.remove_repeats, suffix_radix.removed_documents, minhash.near_duplicates, quality.judge, licenses.scan_licenses, lambda d: mixing.Mix(d).report(), lambda d: mixing.Mix(d).documents(), lambda d: piece_codec.code(d, queries.vocabulary("piece_bpe_32k.model")), lambda d: token_counts.count_tokens(d, queries.vocabulary("word_bpe_49k.json"))])
def test_empty_null_and_repeated_rows(spark, operator):
    assert operator(spark.createDataFrame([], EMPTY)).count() == 0
    long = " ".join(f"w{i % 211}" for i in range(4000))
    d = spark.createDataFrame([(None, "a b c", None), (None, None, None), (1, None, None), (2, "", "s"), (3, long, "s"), (3, long, "s"), (4, long, None)], EMPTY)
    n = operator(d).count()
    assert n == 7 or (n <= 7 and "text" in operator(d).columns)


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(1000, i) for i in range(2000, 2100)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links + [(7, None)], "a long, b long")).collect()}
    linked = [p for p in links if p[0] != p[1]]
    want = plain_components({x for p in linked for x in p}, linked)
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_component_rounds_take_few_jobs(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000, i) for i in range(2000, 2300)], "a long, b long").repartition(8)
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    began = jobs()
    tree = components.components(links)
    assert jobs() - began <= 9 and tree.where("component IN (0, 1000)").count() == 702
    began = jobs()
    tree.collect()
    assert jobs() - began == 1  # the result is a table that is read, nothing is dealt anew


def test_component_rounds_without_local_help(spark, monkeypatch):
    monkeypatch.setattr(components, "_forest", lambda batches: batches)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain_components({x for p in links for x in p}, links)


@pytest.fixture
def uncoalesced(spark):
    """Shuffles keep all their tasks, as on tables of many partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("last", [0, 40, 1000])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, last):
    monkeypatch.setattr(components, "LAST_LINKS", last)
    monkeypatch.setattr(components, "_forest", lambda batches: batches)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(119, 100), (7, 7)]
    got = rows(components.components(spark.createDataFrame(links, "a long, b long").repartition(5)))
    want = plain_components({x for p in links for x in p}, links)
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_no_round(spark, monkeypatch, uncoalesced):
    """Rounds over some thousand links were most of op4's tasks on check_h."""
    monkeypatch.setattr(components, "_round", None)
    links = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long").repartition(8)
    assert components.components(links).where("component = 0").count() == 401


def test_warc_round_trip(spark):
    pages = [(5, "http://a/ü x", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "u", None), (7, "u", ""), (1, "u", "z" * 300_000), (None, "u", "<p>é</p>"), (3, "u\r\nX: y", "once"), (3, "u", "once")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in rows(warc.round_trip(spark, df))), key=str)
    digest = lambda s: warc.payload_digest((s or "").encode())
    first = {5: 2, 9: 7}
    want = sorted(((p, len((h or "").encode()), "revisit" if p in first else "response", first.get(p), digest(h)) for p, _, h in pages), key=str)
    assert got == want
    assert {r["record_type"] for r in rows(warc.round_trip(spark, df, least=10**9))} == {"response"}
    assert warc.round_trip(spark, df.limit(0)).count() == 0
    assert warc.payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_warc_zip64_directory(tmp_path, monkeypatch):
    import zipfile

    from pyarrow import fs

    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one", b"1" * 50)
        z.writestr("two", b"2" * 60)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a.zip")) as f:
        found = warc.members(f)
        assert f.read_at(found["two"][2], found["two"][1]) == b"2" * 60 and found["one"][2] == 50


def plain_passages(texts, size):
    words = {i: WORDS.findall(t or "") for i, t in texts}
    first = {}
    for i, w in sorted(words.items()):
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(k, k + size)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("size, together, local, batch, stretch", [(50, 8192, 32, 100_000, 1 << 19), (7, 512, 32, 200, 1 << 19), (7, 3, 1, 100, 40), (2, 8192, 4, 500, 64)])
def test_passages(spark, monkeypatch, size, together, local, batch, stretch):
    for name, value in (("TOGETHER", together), ("LOCAL", local), ("BATCH_ROWS", batch), ("STRETCH", stretch)):
        monkeypatch.setattr(word_graph, name, value)
    texts = corpus(3)
    got = by_id(word_graph.remove_passages(docs_of(spark, texts).repartition(3), size))
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == plain_passages(texts, size)


def test_passages_of_long_texts(spark):
    rnd = random.Random(8)
    long = [f"w{rnd.randrange(5000)}" for _ in range(60_000)]
    texts = [(1, " ".join(long)), (2, "x " + " ".join(long[100:]) + " y"), (3, "same " * 30_000), (4, "same " * 30_000), (5, " ".join(long[:30_000] + ["other"] + long[30_001:]))]
    got = by_id(word_graph.remove_passages(docs_of(spark, texts).repartition(5)))
    assert {i: r["n_removed"] for i, r in got.items()} == {1: 0, 2: 59_900, 3: 0, 4: 30_000, 5: 59_999}
    assert got[5]["kept"] == "other" and got[2]["kept"] == "x y"


@pytest.mark.parametrize("source", ["one", "each", "mixed"])
def test_paths_between_branches(spark, source):
    rnd = random.Random(2)
    chain = [(k, k + 1, 2) for k in range(70)]  # begin, end, more: one path of 70 edges
    edges = [*chain, (100, 101, 0), (101, 102, 1), (101, 103, 1), (200, 201, 0), (201, 202, 3), (202, 200, 0), (300, 300, 0)]
    place = {"one": lambda i: (1, 3 * i), "each": lambda i: (i, 0), "mixed": lambda i: (rnd.randrange(4), 3 * i)}[source]
    rows_ = [(1000 + i, *e, sid, 5, at) for i, e in enumerate(edges) for sid, at in [place(i)]] * 2
    df = spark.createDataFrame(rows_, "edge long, begin long, end long, more long, sid long, sth long, at long")
    got = {r["edge"]: (r["path"], r["hops"], r["offset"]) for r in word_graph.paths(df).collect()}
    assert {k: v for k, v in got.items() if k < 1073 or k == 1076} == {1000 + i: (1000, i, 3 * i) for i in range(70)} | {k: (k, 0, 0) for k in (1070, 1071, 1072, 1076)}
    assert set(got) == set(range(1000, 1077)) and all(1073 <= got[k][0] <= 1075 for k in (1073, 1074, 1075))
    assert word_graph.paths(df.limit(0)).count() == 0


def test_runs_of_keys():
    rnd = random.Random(4)
    keys = sorted(rnd.choices(range(40), k=500) + [7] * 300 + [20] * 200)
    cut = sorted(rnd.sample(range(1000), 30))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(range(a, b), pa.int64())], ["k", "i"]) for a, b in zip([0, *cut], [*cut, 1000])]
    seen, done = [], set()
    for (k, i), long, given in common.key_runs(iter(batches), 100):
        assert long or not (set(k) & done)
        assert not long or len(set(k)) == 1 and given == sum(x == k[0] for x in keys[: i[0]])
        done |= set(k)
        seen += i.tolist()
    assert seen == list(range(1000))


def test_shared_folder(spark):
    from pathlib import Path
    from types import SimpleNamespace

    df = common.written(spark.range(5), "x")
    folder = Path(df._written_at.removeprefix("file://"))
    assert df.count() == 5 and df._written_at.startswith("file:///") and folder.is_dir()
    common.forget(df, spark.range(1))
    assert not folder.exists()
    assert common.qualified(spark, "/checkpoints/job") == "file:///checkpoints/job"
    elsewhere = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(elsewhere, "x")


def plain_repeats(texts, size):
    raw = {i: (t or "").encode() for i, t in texts}
    seen, out = set(), {}
    for i in sorted(raw):
        b, gone = raw[i], set()
        for k in range(len(b) - size + 1):
            s = b[k : k + size]
            if s in seen:
                gone.update(range(k, k + size))
            seen.add(s)
        kept = bytes(c for j, c in enumerate(b) if j not in gone)
        spans = sum(1 for j in gone if j - 1 not in gone)
        out[i] = (len(b), len(gone), spans, kept)
    return out


@pytest.mark.parametrize("size, together, local, stretch", [(100, 8192, 32, 1 << 21), (20, 512, 32, 1 << 21), (20, 3, 32, 300), (5, 8192, 2, 64), (12, 2, 2, 1 << 21)])
def test_repeated_bytes(spark, monkeypatch, size, together, local, stretch):
    # in local mode Python workers are forked with the values set here
    for name, value in (("TOGETHER", together), ("LOCAL", local), ("STRETCH", stretch)):
        monkeypatch.setattr(suffix_radix, name, value)
    texts = corpus(4)
    got = by_id(suffix_radix.remove_repeats(docs_of(spark, texts), size))
    assert {i: (r["_n_bytes"], r["_n_removed"], r["_n_spans"], bytes(r["_kept"])) for i, r in got.items()} == plain_repeats(texts, size)


def test_repeated_bytes_beyond_4096_windows(spark):
    long = "".join(random.Random(5).choices("abcde", k=9000))
    texts = [(1, "x" * 25_000), (2, long + "1"), (3, "2" + long), (4, long[1:])]
    got = by_id(suffix_radix.remove_repeats(docs_of(spark, texts), 7000))
    assert {i: r["_n_removed"] for i, r in got.items()} == {1: 24_999, 2: 0, 3: 9000, 4: 8999}
    got = by_id(suffix_radix.remove_repeats(docs_of(spark, texts[:1]), 15_000))
    assert got[1]["_n_removed"] == 24_999 and bytes(got[1]["_kept"]) == b"x"


def test_repeated_bytes_keep_clashing_columns(spark):
    d = docs_of(spark, [(1, "ab" * 80), (2, "ab" * 80)]).withColumns({c: F.lit(c) for c in ("id", "start", "end", "bytes", "spans", "_n_bytes", "_kept", "_spans", "_id")})
    got = by_id(suffix_radix.remove_repeats(d))
    assert got[2]["_n_removed"] == 160 and got[2]["id"] == "id" and got[2]["_spans"] == "_spans"
    assert {r["start"] for r in rows(suffix_radix.removed_documents(d))} == {"start"}


def test_radix_passes():
    rnd = random.Random(3)
    raw = bytes(rnd.choices(b"ab", k=4000))
    for size in (3, 8, 11, 16):
        start = np.arange(len(raw) - size + 1)
        live, bucket = suffix_radix.radix_repeats(raw, start, np.zeros(len(start), np.int64), size)
        groups = {}
        for s in start:
            groups.setdefault(raw[s : s + size], []).append(s)
        want = sorted(sorted(g) for g in groups.values() if len(g) > 1)
        got = {}
        for s, b in zip(live, bucket):
            got.setdefault(b, []).append(s)
        assert sorted(sorted(g) for g in got.values()) == want


def test_long_texts_in_stretches():
    x = bytes(np.random.default_rng(1).integers(0, 3, 3000).astype(np.uint8))
    seen = []
    for pieces in ([x], [x[a : a + 257 + 19] for a in range(0, 3000 - 19, 257)]):
        piece, name, low, more = suffix_radix.regions(pieces, 20, 8)
        at = 257 * piece if len(pieces) > 1 else 0
        seen.append([(int(n), s) for n, a, m in zip(name, low + at, more) for s in range(a, a + m + 1)])
    assert [s for _, s in seen[0]] == list(range(3000 - 19)) and seen[0] == seen[1]


def test_cut_texts_stay_texts(spark):
    s = "é" * 120
    got = {r["doc_id"]: r["text"] for r in rows(suffix_radix.removed_documents(docs_of(spark, [(1, "a" + s), (2, s), (3, "b" + s + "c" * 3)])))}
    assert got[3].startswith("b") and got[3].endswith("ccc") and set(got[2]) <= {"é"}


def shingles(text, size):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def plain_near(texts, size):
    sets = {i: shingles(t, size) for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = plain_components(sets, links)
    return {i: (len(s), least[i], least[i] == i) for i, s in sets.items()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    texts = corpus(5, 90)
    got = by_id(minhash.near_duplicates(docs_of(spark, texts), size))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == plain_near(texts, size)


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """A group whose copies are like their source but not like each other, in buckets of many blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "EARLY_PAIRS", 1)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(70):
        w = base[:]
        for k in rnd.sample(range(120), 6):
            w[k] = f"x{i}-{k}"
        texts.append((i + 1, " ".join(w)))
    texts.append((200, " ".join(base)))
    got = by_id(minhash.near_duplicates(docs_of(spark, texts), 2))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == plain_near(texts, 2)


def test_near_duplicates_write_few_tables(spark, monkeypatch, uncoalesced):
    """Buckets of many blocks that stay open for both rounds, and rows that repeat an id or have none."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "EARLY_PAIRS", 0)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    near = [" ".join(f"x{i}-{k}" if k in odd else w for k, w in enumerate(base)) for i, odd in enumerate(rnd.sample(range(120), 5) for _ in range(40))]
    texts = [*enumerate(near, 10), (60, " ".join(base)), (60, " ".join(base)), (60, near[0]), (5, "q r s"), (5, "q r s"), (4, "q r s t"), (4, None), (None, "q r s"), (None, ""), (3, "")]
    tables = []
    for module in (minhash, components):
        monkeypatch.setattr(module, "written", lambda df, purpose: tables.append(purpose) or common.written(df, purpose))
    got = rows(minhash.near_duplicates(docs_of(spark, texts), 2))
    plain = [(i, t) for i, t in texts if i and i not in (60, 4, 5)]
    want = {i: c for i, (_, c, _) in plain_near([*plain, (60, " ".join(base))], 2).items()} | {5: 5, 4: 4, None: None}
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in texts)
    assert all((r["component_id"], r["kept"]) == (want[r["doc_id"]], r["doc_id"] in (None, want[r["doc_id"]])) for r in got)
    assert all(r["n_shingles"] == len(shingles(t, 2)) for r, (_, t) in zip(sorted(got, key=lambda r: (r["doc_id"] or 0, r["n_shingles"])), sorted(texts, key=lambda x: (x[0] or 0, len(shingles(x[1], 2))))))
    assert tables.count("pairs") == 2 and len(tables) <= 14, tables


@pytest.mark.parametrize("blocks", [1, 2])
def test_cross_pairs_compare_no_pair_within_the_largest_component(monkeypatch, blocks):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 300 - d], rng.integers(0, 2**63, d, dtype=np.uint64)])) for d in rng.integers(0, 60, 80)]
    n, c = np.array([len(x) for x in sets]), np.where(np.arange(80) % 10 < 8, 1, np.arange(80) % 4 + 5)
    sketch = np.stack([np.frombuffer(minhash.wide_sketch(x).tobytes(), np.uint64) for x in sets])
    block = rng.permutation(80) % blocks
    compared, odds = [], minhash.wide_odds
    monkeypatch.setattr(minhash, "wide_odds", lambda x, y: compared.append(len(x) * len(y)) or odds(x, y))
    a, b, odd = minhash.cross_pairs(n, sketch, c, block == 0 if blocks > 1 else None, 0.8)
    every = odds(sketch, sketch)
    hit = (np.minimum(n[:, None], n) >= 0.8 * np.maximum(n[:, None], n) - 1e-9) & (every <= minhash.wide_limits(n[:, None] + n, 0.8)) & (c[:, None] != c)
    want = {(i, j) for i, j in np.argwhere(np.triu(hit, 1)).tolist() if blocks == 1 or block[i] != block[j]}
    got = [tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert (odd == every[a, b]).all()
    assert sum(compared) <= 16 * 80  # 16 rows are outside; all rows met all others, 6,400 pairs, before


def test_odd_sketch_estimates():
    rng = np.random.default_rng(3)
    for share in (0.8, 0.9, 0.95):
        off = []
        for _ in range(60):
            n = int(1000 * 2 * share / (1 + share))
            x = rng.integers(0, 2**63, 2000, dtype=np.uint64)
            a, b = x[:1000], np.concatenate([x[:n], x[1000 : 2000 - n]])
            s = [np.frombuffer(minhash.odd_sketch(minhash.samples(np.unique(v))).tobytes(), np.uint64)[None] for v in (a, b)]
            off.append(minhash.estimate(*s)[0, 0] - share)
        assert abs(np.mean(off)) < 0.02 and max(map(abs, off)) < minhash.MARGIN


def test_quality_measures(spark):
    texts = corpus(6) + [(900, "the of and " * 30 + "\n#&\n#&\nx"), (901, "a b c a b c d")]
    got = by_id(quality.judge(docs_of(spark, texts)))
    for i, t in texts:
        w, lines = WORDS.findall(t or ""), [x for x in (t or "").split("\n") if WORDS.search(x)]
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep)), i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (r["kept"] and r["base_failed"])


ODD = ["", "  a  b", "ΣΑΣ", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "\x1c x\x1fy᠎z​", "İstanbul", "don't I'LL we've", "é ①Ⅷ½ ２３", "日本語 텍스트 😀😀", "\x00\x01a", "a" * 300, "!!!???..." * 50, "a b　c\u0085d", "▁▁ a ▁b", "   lead", "trail   ", "\n\n\t x\ty", "a     b      c                 d", "\r\nq", "ﬁ ℌ ſ ẞ", "<s></s><unk><0x41>"]


def odd_texts(seed):
    rnd = random.Random(seed)
    letters = "ab Σσς é\n\t ▁1.,'-<|>日😀   tion the"
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(500)]


def test_token_counts_of_all_letters():
    """Every code point in a word of its own and between letters, as the library counts it."""
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), token_counts.WordCounter(open(path, encoding="utf-8").read())
    for low in range(0, 0x110000, 0x4000):
        texts = [f"{chr(c)} a{chr(c)}B {chr(c)}{chr(c)}'S" for c in range(low, low + 0x4000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 32 < 2)]
        for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert counter.count(t) == len(e.ids), hex(ord(t[0]))


def test_token_counts_of_other_tokenizers():
    import json

    path = queries.vocabulary("word_bpe_49k.json")
    for change in (lambda c: c["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex="x+"), lambda c: c["added_tokens"][0].update(lstrip=True), lambda c: c["model"].update(ignore_merges=True), lambda c: c["normalizer"]["normalizers"].pop()):
        config = json.load(open(path, encoding="utf-8"))
        change(config)
        with pytest.raises(ValueError, match="another build"):
            token_counts.WordCounter(json.dumps(config))


def test_counts_and_pieces_of_long_texts(spark):
    """Texts of a megabyte: one word, one letter, many short words, letters without a piece."""
    import sentencepiece
    from tokenizers import Tokenizer

    json_path, model_path = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("piece_bpe_32k.model")
    rnd = random.Random(7)
    texts = [(1, "".join(rnd.choices("abcdefgh", k=40_000))), (2, " ".join("".join(rnd.choices("etaoins", k=3)) for _ in range(300_000))), (3, "😀一" * 30_000), (4, " " * 50_000 + "x"), (5, "a" * 30_000)]
    counted = by_id(token_counts.count_tokens(docs_of(spark, texts), json_path))
    coded = by_id(piece_codec.code(docs_of(spark, texts), model_path))
    library, pieces = Tokenizer.from_file(json_path), sentencepiece.SentencePieceProcessor(model_file=model_path)
    for i, t in texts:
        assert counted[i]["n_tokens"] == len(library.encode(t, add_special_tokens=False).ids)
        ids = pieces.encode(t, add_bos=True, add_eos=True)
        assert coded[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and coded[i]["decoded_sha256"] == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = list(enumerate(odd_texts(1))) + [(9000 + i, t) for i, t in corpus(7)]
    got = by_id(token_counts.count_tokens(docs_of(spark, texts), path, limit=20))
    for i, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 20), t


def test_pieces_that_may_follow():
    """Adjacent pieces judged at their border, and by merging their whole joined text."""
    codec = piece_codec.PieceCodec(open(queries.vocabulary("piece_bpe_32k.model"), "rb").read())
    rnd = random.Random(5)
    whole = [p for p in codec.id if codec.merged(p) == [p] and not any(t in p for t in codec.tied)]
    pairs = [(rnd.choice(whole), rnd.choice(whole).lstrip(piece_codec.SPACE) or "a") for _ in range(20_000)]
    for p in rnd.sample(whole, 6000):  # the two halves of a piece, and of two pieces
        at, more = rnd.randint(1, len(p)), rnd.choice(whole).lstrip(piece_codec.SPACE)
        pairs.append((p[:at], p[at:] + more[: rnd.randint(0, 3)]))
    known, said = set(whole), Counter()
    for left, right in pairs:
        if left in known and right in known and not any(t in left + right for t in codec.tied):
            want = codec.merged(left + right) == [left, right]
            assert codec.remerged(left, right) == want, (left, right)
            said[want] += 1
    assert said[True] > 1000 and said[False] > 1000


def test_piece_codec(spark):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = list(enumerate(odd_texts(2))) + [(9000 + i, t) for i, t in corpus(8)]
    got = by_id(piece_codec.code(docs_of(spark, texts), path, keep=("ids", "decoded")))
    for i, t in texts:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        r = got[i]
        assert list(r["ids"]) == ids and r["decoded"] == library.decode(ids) and r["n_tokens"] == len(ids), t
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_licenses(spark):
    mit, apache = dict(licenses.TEMPLATES[3:4])["MIT"], licenses.TEMPLATES[6][1]
    wrapped = "\n".join(re.findall(r".{1,70}(?:\s|$)", mit.replace("merge, publish", "publish")))
    texts = [(1, "Thtion eros.\nReleased under the MIT License.\nMore words."), (2, "no such thing"), (3, "Intro of ours.\n\n" + wrapped + "\n\nOther text entirely."), (4, "// " + apache), (5, "This license is nothing known to anyone at all."), (6, "Licensed under CC BY-NC 4.0."), (7, "All rights reserved.\nReleased under the MIT License."), (8, None), (9, "")]
    got = {i: r["licenses"] for i, r in by_id(licenses.scan_licenses(docs_of(spark, texts))).items()}
    assert got == {1: ["MIT"], 2: [], 3: ["MIT"], 4: ["Apache-2.0"], 5: [], 6: ["CC-BY-NC-4.0"], 7: ["MIT", "Proprietary"], 8: [], 9: []}
    scanner = licenses.Scanner()
    for k, (name, wording) in enumerate(licenses.TEMPLATES):  # brute force: the template with the fewest differences
        words = licenses.license_words(wording)
        assert scanner.scan(wording)[1][0][0] == name and scanner.differences(words, k) == (0, 0)


@pytest.mark.parametrize("n_words", [0, 100, 1000, 5000])
def test_licenses_in_long_lines(n_words):
    """A notice within a line of any length is found, at its own savings; so are many in one line."""
    rnd, scanner = random.Random(n_words), licenses.Scanner()
    prose = lambda n: " ".join(rnd.choice(["lorem", "of", "the", "software", "ipsum", "is", "in", "dolor"]) + rnd.choice(["", "t", "n"]) for _ in range(n))
    for name, wording in [(n, " ".join(w.split())) for n, w in licenses.TEMPLATES]:
        alone = scanner.scan(wording)[1]
        assert scanner.scan(f"{prose(n_words)} {wording} {prose(n_words // 2)}") == (1, alone) and alone[0][0] == name
        if len(licenses.license_words(wording)) > 25:  # one word missing, one foreign
            changed = wording.split(" ")
            changed[12] = "zzz"
            assert [f[0] for f in scanner.scan(f"{prose(n_words)} {' '.join(changed)} {prose(n_words // 2)}")[1]] == [name]
    many = " ".join(w + " " + prose(7) for _, w in licenses.TEMPLATES * 2)
    assert Counter(f[0] for f in scanner.scan(many)[1]) == Counter(n for n, _ in licenses.TEMPLATES * 2)
    for name, wording in licenses.TEMPLATES[:19]:  # copies that follow each other, a word changed in each
        if len(licenses.license_words(wording)) > 25:
            copies = [wording.split(" ") for _ in range(3)]
            for i, copy in enumerate(copies):
                copy[12 + 3 * i] = "zzz"
            assert [f[0] for f in scanner.scan(" ".join(w for copy in copies for w in copy))[1]] == [name] * 3
    assert scanner.scan("All rights reserved. " * 40) == (1, scanner.scan("All rights reserved.")[1] * 40)


class PlainScanner(licenses.Scanner):
    """Looks for every template at every place."""

    def places(self, words):
        for k, wording in enumerate(self.words):
            moved = sum(self.slack(k))
            for begin in range(-moved, len(words)):
                if begin + moved + len(wording) > 0:
                    yield k, max(0, begin), min(len(words), begin + moved + len(wording))


def test_licenses_in_random_blocks():
    rnd = random.Random(12)
    templates = tuple(t for t in licenses.TEMPLATES if len(licenses.license_words(t[1])) < 60)[:24]
    fast, plain = licenses.Scanner(templates), PlainScanner(templates)
    common_words = sorted(fast.vocabulary) + ["river", "copyright", "paper", "license"]
    for _ in range(60):
        lines = []
        for _ in range(rnd.randint(1, 5)):
            words = rnd.choice(templates)[1].split()
            for _ in range(min(rnd.choice([0, 0, 1, 2, 4]), len(words) - 1)):
                at = rnd.randrange(len(words))
                words[at : at + rnd.randint(0, 1)] = [rnd.choice(common_words)] * rnd.randint(0, 1)
            extra = " ".join(rnd.choices(common_words, k=rnd.choice([0, 0, 3, 12])))
            lines.append(" ".join(rnd.sample([extra, " ".join(words)], 2)))
        text = "\n".join(lines)
        n, found = fast.scan(text)
        m, want = plain.scan(text)
        assert (n, sorted(f[0] for f in found)) == (m, sorted(f[0] for f in want)), text


def test_licenses_in_long_blocks():
    """Thousands of notices one after another, and ties: templates that save alike are told by length, then by place."""
    scanner = licenses.Scanner()
    n, found = scanner.scan("Released under the MIT License.\n" * 3000)
    assert n == 1 and [f[0] for f in found] == ["MIT"] * 3000
    tied = licenses.Scanner((("B", "released under the license of many words"), ("A", "released under the license of many words")))
    assert [f[0] for f in tied.scan("Released under the license of many words")[1]] == ["B"]
    assert scanner.scan("license " * 20_000)[1] == []


def test_licenses_of_other_names():
    """Neighbours that differ by a telling word are not given the template's name."""
    scanner, wordings = licenses.Scanner(), dict(licenses.TEMPLATES[:19])
    names = lambda text: {f[0] for f in scanner.scan(text)[1]}
    gpl3, bsd2, mit, isc = wordings["GPL-3.0"], wordings["BSD-2-Clause"], licenses.TEMPLATES[3][1], wordings["ISC"]
    gpl2 = gpl3.replace(": you can", "; you can").replace("either version 3", "either version 2")
    lgpl, agpl = (gpl3.replace("GNU General", f"GNU {x} General") for x in ("Lesser", "Affero"))
    third = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    bsd3 = bsd2.replace("THIS SOFTWARE IS", third + "THIS SOFTWARE IS")
    assert "GPL-3.0" not in names(gpl2) | names(lgpl) | names(agpl) | names(gpl3.replace("GNU General", "GNU Library General")) and "BSD-2-Clause" not in names(bsd3)
    creative = "This work is licensed under a Creative Commons Attribution{} {} International License."
    for kind, version in (("-ShareAlike", "4.0"), ("-NoDerivatives", "4.0"), ("-NonCommercial-ShareAlike", "4.0"), ("", "3.0"), ("-NonCommercial", "3.0")):
        assert not {"CC-BY-4.0", "CC-BY-NC-4.0"} & names(creative.format(kind, version))
    assert names(creative.format("", "4.0")) == {"CC-BY-4.0"} and names(creative.format("-NonCommercial", "4.0")) == {"CC-BY-NC-4.0"}
    assert "MIT" not in names(mit.replace("THE SOFTWARE IS PROVIDED", "The Software shall be used for Good, not Evil. THE SOFTWARE IS PROVIDED", 1))
    assert "ISC" not in names(isc.replace("any purpose", "any non-commercial purpose"))
    # Words that tell nothing may differ: labels of clauses, names of holders.
    labelled = bsd2.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in").replace("BY THE COPYRIGHT HOLDERS", "BY THE APACHE GROUP")
    assert names(labelled) == {"BSD-2-Clause"} and names(gpl3.replace("This program is free software", "Foo is free software")) == {"GPL-3.0"}


def test_licenses_of_all_names():
    """Every wording has its own name and no other, whole texts as files hold them too."""
    scanner = licenses.Scanner()
    names = lambda text: {f[0] for f in scanner.scan(text)[1]}
    assert {"BSD-3-Clause", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "GPL-2.0", "Apache-2.0", "GPL-3.0"} <= {n for n, _ in licenses.TEMPLATES}
    for name, wording in licenses.TEMPLATES:
        assert names(wording) == {name} == names("\n".join(f" * {x}" for x in wording.split("\n")))
        if len(licenses.license_words(wording)) > 60:  # as a comment block, with rulers between its lines
            assert names("\n * ------\n".join(f" * {x}" for x in re.findall(r"(?s).{1,70}(?:\s|$)", wording))) == {name}
    gpl2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    assert names(gpl2 + " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.") == {"GPL-2.0"}


@pytest.mark.parametrize("cell_rows, tile, pairs", [(16_384, 4096, 1 << 16), (5, 3, 7), (2, 64, 1 << 16)])
def test_near_vectors(spark, monkeypatch, cell_rows, tile, pairs):
    for name, value in (("CELL_ROWS", cell_rows), ("TILE", tile), ("PAIRS", pairs)):
        monkeypatch.setattr(subspace_join, name, value)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 24))
    vectors = [(i, v.astype(float).tolist(), i % 2) for i, v in enumerate(base)]
    vectors += [(100 + i, (base[i % 40] + rng.standard_normal(24) * s).tolist(), i % 2) for i, s in enumerate(np.tile([0.02, 0.12, 0.2, 0.25], 30))]
    vectors += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, [None] * 24, 1), (304, base[0].tolist(), None), (305, base[0].tolist(), 0), (306, (base[0] * 2).tolist(), 0), (307, [], 0), (308, base[0][:8].tolist(), 0), (309, [1e300] * 24, 0), (310, [1.0] * 24, 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").withColumn("unit", F.lit("clash"))
    good = {i: (np.array(v), y) for i, v, y in vectors if v and None not in v and y is not None and np.isfinite(v).all() and np.any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, (v, _) in good.items()}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    least, n = plain_components([v[0] for v in vectors], links), Counter(x for p in links for x in p)
    got = by_id(subspace_join.near_vectors(df), "vec_id")
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {v[0]: (n[v[0]], least[v[0]], least[v[0]] == v[0]) for v in vectors}
    assert subspace_join.near_vectors(df.limit(0)).count() == 0


def test_dense_groups_of_vectors(spark):
    """Copies of one vector, some closer than others: rows that meet, not pairs, come out of the join."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal(32)
    vectors = [(i, (base + rng.standard_normal(32) * rng.choice([0.02, 0.1, 0.14])).tolist(), 0) for i in range(400)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    unit = np.array([v for _, v, _ in vectors])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.98
    got = by_id(subspace_join.near_vectors(df), "vec_id")
    assert [got[i]["n_links"] for i in range(400)] == (near.sum(1) - 1).tolist()
    least = plain_components(range(400), [tuple(p) for p in np.argwhere(np.triu(near, 1)).tolist()])
    assert {i: r["component_id"] for i, r in got.items()} == least
    heads = subspace_join.prepared(df).withColumn("size", F.lit(1).cast("long"))
    assert subspace_join.joined(heads, 0.98).count() < near.sum() / 4


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200, Fraction(500, 3), Fraction(250, 3)]
    assert mixing.targets([0, 10], [5, 2]) == [0, 15]
    assert mixing.targets([], []) == []


def test_permutations_are_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 5, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_mix(spark):
    texts = [(i, " ".join(["w"] * (i % 400))) for i in range(600)]
    sources = {i: None if i % 10 == 0 else "ab"[i % 10 > 3] for i, _ in texts}
    d = docs_of(spark, texts, sources)
    mix = mixing.Mix(d, block_words=16)
    got = by_id(mix.report())
    assert [(r["source"]) for r in mix.sources.orderBy("src").collect()] == ["a", "b", None]
    for s in ("a", "b", None):
        mine = [r for r in got.values() if r["source"] == s]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) < 0.01 * mine[0]["target"] + 32
    assert all(r["size"] == i % 400 and 0 <= r["taken"] <= 2 * r["size"] for i, r in got.items())
    assert by_id(mixing.Mix(d.repartition(7), block_words=16).report()) == got
    made = by_id(mix.documents())
    assert {i: len(r["text"].split()) for i, r in made.items()} == {i: r["taken"] for i, r in got.items() if r["taken"]}
    slots = rows(mix.slots())
    assert Counter(r["src"] for r in slots) == dict(enumerate(mix.quotas))
    for src, quota in enumerate(mix.quotas):
        assert Counter(r["shard"] for r in slots if r["src"] == src) == Counter(dict(enumerate(mixing.shard_counts(quota, mix.shards, 0, src).tolist())))


def plain_permuted(i, n, key):
    """The permutation one index at a time, in whole numbers."""
    bits = max(2, (max(n, 2)).bit_length())
    half = (bits + 1) // 2
    while True:
        left, right = i >> half, i & ((1 << half) - 1)
        for step in range(6):
            z = right ^ (key + step * 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
            left, right = right, left ^ ((z ^ z >> 31) & ((1 << half) - 1))
        i = left << half | right
        if i < n:
            return i


def test_mix_word_by_word(spark, monkeypatch):
    """What each row gives, from the rows' order, slots and permutations, one word at a time."""
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rnd = random.Random(6)
    texts = [(i, " \n".join(f"w{i}x{j}" for j in range(rnd.choice([0, 1, 5, 40, 300])))) for i in range(60)] + [(60, None), (60, None), (61, "a b c"), (61, "a b c"), (None, "d e"), (None, "d e"), (None, None)]
    sources = {i: rnd.choice("abc") if i % 9 else None for i, _ in texts if i is not None} | {None: "b"}
    d = docs_of(spark, texts, sources).withColumn("source", F.when(F.col("doc_id").isNull(), "b").otherwise(F.col("source")))
    mix = mixing.Mix(d, block_words=16, seed=3)
    got = Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in rows(mix.report()))
    order = {(r["id0"], r["th"]): r["b"] for r in mix.sized.select("id0", "th", F.pmod(F.xxhash64("id0", "th"), F.lit(max(64, len(texts) // 4000))).alias("b")).collect()}
    names = {r["src"]: r["source"] for r in mix.sources.collect()}
    want = Counter()
    for src, name in names.items():
        mine = [r for r in mix.sized.collect() if r["source"] == name]
        mine.sort(key=lambda r: (order[r["id0"], r["th"]], r["id0"], r["size"], r["th"] is not None, r["th"] or 0, r["k"]))
        words = [n for n, r in enumerate(mine) for _ in range(r["size"])]
        blocks = -(-len(words) // 16)
        taken = Counter()
        for slot in range(mix.quotas[src]):
            at = plain_permuted(slot % blocks, blocks, ((src << 32) + slot // blocks + 3 * 0xD6E8FEB86659FD93) % 2**64)
            taken.update(words[16 * at : 16 * at + 16])
        want.update((r["doc_id"], name, r["size"], taken[n]) for n, r in enumerate(mine))
        assert abs(sum(taken.values()) - mix.targets[src]) <= 32
    assert got == want
    made = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in rows(mix.documents()))
    assert made == Counter({(i, s, n): c for (i, s, _, n), c in want.items() if n})


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(11)
    stop = ["the", "of", "and", "to", "in"]
    texts = []
    for i in range(40):
        w = [rnd.choice(stop) if rnd.random() < 0.3 else "".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
        texts.append((i, " ".join(w)))
    texts += [(50, texts[0][1]), (51, texts[1][1] + " more"), (52, "too short"), (53, "### ||| " * 60), (54, texts[2][1][:300] + " " + texts[30][1][400:])]
    d = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, d, "")
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == set(range(40)) | {50, 51, 54}
    near = stages["near duplicates"](spark, kept, "")
    want = {i for i, r in plain_near([(r["doc_id"], r["text"]) for r in kept.collect()], 5).items() if r[2]}
    assert near.columns == d.columns and {r["doc_id"] for r in near.collect()} == want == set(range(40)) | {54}
    cut = stages["repeated strings"](spark, near, "")
    plain = plain_repeats([(r["doc_id"], r["text"]) for r in near.collect()], 100)
    assert cut.columns == d.columns and {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()} == {i: (p[3].decode(), len(p[3])) for i, p in plain.items()}
    mixed = stages["mixing"](spark, cut, "")
    assert mixed.columns == d.columns and mixed.count()
    codec = piece_codec.PieceCodec(open(queries.vocabulary("piece_bpe_32k.model"), "rb").read())
    last = by_id(corpus_pipeline.run(spark, str(tmp_path)))
    assert {i: r["n_tokens"] for i, r in last.items()} == {r["doc_id"]: len(codec.encode(r["text"])) for r in mixed.collect()}
