import collections
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrove.llm import mixing, nndescent, packing, simhash, warc
from lexigrove.llm.shared import components, local_components


def roots_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(k) for k in range(n)]


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(400, 460)] + [(460, k) for k in range(461, 600)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots_of(600, links)
    assert found == {k: want[k] for k in {x for p in links if p[0] != p[1] for x in p}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert local_components(4, np.array([1, 3]), np.array([3, 2])).tolist() == [0, 1, 1, 1]


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def near(spark):
    rng = np.random.default_rng(7)
    words = np.array(["".join(rng.choice(list("abcdefg"), 4)) for _ in range(300)])
    base = [" ".join(rng.choice(words, 200)) for _ in range(12)]
    texts = [None, "", "...", "One  two", "one\ttwo", "ONE TWO THREE four " * 3000]
    for b in base:
        texts.append(b)
        for _ in range(14):
            parts = b.split(" ")
            for _ in range(int(rng.integers(0, 3))):
                parts[int(rng.integers(0, 200))] = str(rng.choice(words))
            texts.append(" ".join(parts))
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)]
    return texts, spark.createDataFrame(rows + [rows[8]] + [(None, texts[7], 1, "x")], "doc_id long, text string, fingerprint int, rep string")


@pytest.mark.parametrize("bucket", [1024, 4])
def test_simhash_against_brute_force(near, bucket):
    texts, docs = near
    rows = simhash.near_duplicates(docs, bucket=bucket).collect()
    prints = [fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = roots_of(len(texts), links)
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])
    assert len(links) > 200


def test_rows_without_ids_link_others(spark, monkeypatch):
    """A fingerprint that only rows without an id have joins two documents that are not linked directly."""
    prints = {"a": 0b0, "b": 0b111, "c": 0b111111, "d": 1 << 40 | 0xFFFF, "e": 1 << 63}
    rows = [(7, "a"), (None, "b"), (5, "c"), (None, "d"), (None, "d"), (9, "e"), (None, "e")]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    given = spark.createDataFrame([(d, signed(prints[t])) for d, t in rows], "doc_id long, fingerprint long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: given)
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["fingerprint"], r["component_id"] or -1) for r in out) == sorted((f"{prints[t]:016x}", {"a": 5, "b": 5, "c": 5, "d": -1, "e": 5}[t]) for _, t in rows)


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def jaccard_links(texts):
    sets = [shingle_set(t) for t in texts]
    return [(a, b) for a in range(len(texts)) for b in range(a) if (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0) >= 0.8]


@pytest.fixture(scope="module")
def copies():
    """Texts of 4 to 400 words with copies that change some words, or share a long passage only."""
    rng = np.random.default_rng(11)
    words = np.array(["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(2000)])
    passage = " ".join(rng.choice(words, 120))
    texts = [None, "", " ", "One two", "one  TWO", "one two three four five six seven eight nine ten", "one two three four five six seven eight nine"]
    for n in (4, 9, 12, 40, 40, 120, 120, 200, 400):
        base = rng.choice(words, n)
        texts.append(" ".join(base))
        texts.append(passage + " " + " ".join(rng.choice(words, 80)))
        for _ in range(16):
            parts = base.copy()
            for k in rng.integers(0, n, int(rng.integers(0, 1 + n // 25 + 1))):
                parts[k] = rng.choice(words)
            texts.append(" ".join(parts[: n - int(rng.integers(0, 1 + n // 20))]))
    return texts


@pytest.mark.parametrize(("fill", "chunk", "least"), [(512, 512, 1.0), (512, 8, 1.0), (8, 16, 0.98)])
def test_similar_documents_against_brute_force(spark, monkeypatch, copies, fill, chunk, least):
    monkeypatch.setattr(simhash, "FILL", fill)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "BUCKET", 2 * fill)
    links = jaccard_links(copies)
    want = roots_of(len(copies), links)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(copies)] + [(None, copies[9], "x"), (9, copies[9], "x"), (9, "another text of that id", "x")], "doc_id long, text string, root string")
    out = simhash.similar_documents(docs).collect()
    assert len(out) == len(copies) + 2 and len(links) > 200
    found = collections.defaultdict(set)
    for r in out:
        found[r["doc_id"]].add(r["component_id"])
    right = sum(found[k] == {want[k]} for k in range(len(copies)) if k != 9)
    assert found[9] == {want[9], 9} and right >= least * (len(copies) - 1)
    assert all(want[c] == want[k] for k in found for c in found[k])
    assert len({r["root"] for r in out}) == len({(r["root"], r["component_id"]) for r in out})


def test_similar_documents_of_nothing(spark):
    assert simhash.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_simhash_on_the_jvm(spark):
    """The shingle hash is the engine's own xxhash64."""
    found = spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0]
    assert found & (2**64 - 1) == simhash.shingle_hashes("A b é")[0]


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "CHUNK", 32)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    vectors = [list(map(float, c + rng.normal(size=16) * s)) for c in centres for s in [0.05] * 40 + [0.3] * 20] + [list(map(float, rng.normal(size=16))) for _ in range(300)]
    vectors += [vectors[3], vectors[3], [0.0] * 16, None, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 0.0], [2.0, 0.0], [1e200, 0.0]]
    rows = [(k, v, "label") for k, v in enumerate(vectors)]
    recalls = []
    df = spark.createDataFrame([*rows, (None, vectors[3], "x")], "vec_id long, embedding array<double>, rep string")
    out = nndescent.near_duplicates(df, block=64, report=lambda turn, recall: recalls.append(recall)).collect()
    assert recalls[-1] >= 0.95 and len(out) == len(rows) + 1
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]

    def cosine(a, b):
        a, b = (np.array(x) / np.abs(x).max() for x in (a, b))
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    links = [(a, b) for a in range(len(vectors)) for b in range(a) if ok[a] and ok[b] and len(vectors[a]) == len(vectors[b]) and cosine(vectors[a], vectors[b]) >= 0.9]
    degree = collections.Counter(x for p in links for x in p)
    want = roots_of(len(vectors), links)
    right = sum((r["n_links"], r["component_id"], r["kept"]) == (degree[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"]) for r in out if r["vec_id"] is not None)
    assert right / len(vectors) > 0.97
    assert {(r["n_links"], r["kept"]) for r in out if r["vec_id"] is None} == {(0, False)}
    assert nndescent.near_duplicates(df.limit(0)).count() == 0


def test_all_pairs_of_a_hot_block_meet(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "CHUNK", 8)
    rng = np.random.default_rng(5)
    classes = spark.createDataFrame([(k, list(map(float, rng.normal(size=4)))) for k in range(60)], "rep long, embedding array<double>")
    tasks = collections.defaultdict(set)
    for r in nndescent.block_tasks(classes, 1, 0, 0).collect():
        tasks[r["task"]].add(r["rep"])
    met = {(a, b) for t in tasks.values() for a in t for b in t if a < b}
    assert len(met) == 60 * 59 // 2 and len(tasks) > 1 and max(map(len, tasks.values())) < 60


def test_audit_counts_links_between_small_groups(spark):
    """Neither copies nor a clique hide that every link of the pairs is lost."""
    rng = np.random.default_rng(6)
    clique = [np.eye(32)[0] + rng.normal(size=32) * 0.01 for _ in range(100)]
    pairs = [x for k in range(1, 31) for x in (np.eye(32)[k], np.eye(32)[k] + np.eye(32)[31] * 0.3)]
    rows = [(k, 5000 if k == 0 else 1, list(map(float, v))) for k, v in enumerate(clique + pairs)]
    classes = spark.createDataFrame(rows, "rep long, copies long, embedding array<double>")
    graph = spark.createDataFrame([(k, c, 5098 if 0 < k < 100 else 5098 if k == 0 else 0) for k, c, _ in rows], "rep long, copies long, links long")
    assert nndescent.audit(classes, graph, 0.9) == pytest.approx(100 / 160)


def test_descent_finds_what_blocks_miss(spark, monkeypatch):
    """A chain of vectors, each linked to the next ones: one table of small blocks finds part, and rounds through neighbours find the rest."""
    rng = np.random.default_rng(9)
    a, b = np.linalg.qr(rng.normal(size=(24, 2)))[0].T
    vectors = []
    for k in range(300):
        angle = 2 * np.pi * k / 300
        vectors.append(np.cos(angle) * a + np.sin(angle) * b)
    classes = spark.createDataFrame([(k, 1, list(map(float, v))) for k, v in enumerate(vectors)], "rep long, copies long, embedding array<double>").cache()
    found = nndescent.compare_tasks(nndescent.block_tasks(classes, 2, 5, 0), nndescent.OFFERS, 0.9).cache()
    start = nndescent.best_lists(found, 8).cache()
    lists, _ = nndescent.descend(classes, start, found.where("sim > 1.5").select("a", "b"), 8, 0.9)
    rows = np.array(vectors)
    true = np.sort(rows @ rows.T - 2 * np.eye(300), axis=1)[:, -8:]
    share = lambda df: sum(r["sim"] >= true[r["a"], 0] - 1e-9 for r in df.collect()) / true.size
    assert share(start) < 0.9 < 0.97 < share(lists)


def test_embeddings_beyond_the_rounds_are_exact(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "TURNS", 1)
    monkeypatch.setattr(nndescent, "FLOOR", 0.9)
    monkeypatch.setattr(nndescent, "CHUNK", 64)
    rng = np.random.default_rng(8)
    vectors = []
    for _ in range(150):
        a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        vectors += [a, 0.92 * a + math.sqrt(1 - 0.92**2) * b]
    df = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    recalls = []
    out = nndescent.near_duplicates(df, neighbours=1, tables=1, block=1, report=lambda turn, recall: recalls.append(recall)).collect()
    assert recalls[0] < 0.95 and recalls[1:] == [1.0]
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == {k: (1, k - k % 2) for k in range(300)}


PAGES = [(5, "http://a/", "<p>one</p>"), (3, None, "<p>one</p>"), (9, "http://b/\r\nX: y", ""), (4, "u", None), (7, "u", "é" * 70_000), (8, "u", "x"), (None, "u", "x"), (8, "u", "x")]


def test_warc_round_trip(spark, tmp_path):
    rows = [(*p, "c") for p in PAGES + [(100 + k, "u", f"<html><body>shared head and foot {k}</body></html>") for k in range(60)]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    dictionary = warc.train_dictionary(pages)
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(warc.mark_revisits(pages), folder, dictionary, file_bytes=2000)
    assert manifest.count() > 2 and not list((tmp_path / "warc").glob("*.part"))
    first = next((tmp_path / "warc").glob("*.zst")).read_bytes()
    assert dictionary and first[:4] == warc.MAGIC and first[8 : 8 + len(dictionary)] == dictionary
    out = warc.read_archives(manifest, folder).collect()
    assert len(out) == len(rows)
    smallest = {}
    for page, _, html, _ in rows:
        key = html or ""
        smallest[key] = min(smallest.get(key, 2**62), page if page is not None else 2**62)
    texts = {p: h or "" for p, _, h, _ in rows}
    for r in out:
        text = texts[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()), warc.digest_of(text.encode()))
        response = smallest[text] == r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if response else ("revisit", smallest[text]))
        assert r["payload"] == (text.encode() if response else None)


@pytest.mark.parametrize("html", [[None], ["", "x"], ["<p>one</p>"] * 3, ["long " * 9000]])
def test_warc_of_few_pages_has_a_dictionary(spark, tmp_path, html):
    pages = spark.createDataFrame([(k, "u", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    manifest, folder = warc.archive_pages(pages, f"file://{tmp_path}/few")
    assert all(p.read_bytes()[:4] == warc.MAGIC for p in (tmp_path / "few").glob("*.zst"))
    assert {r["page_id"] for r in warc.read_archives(manifest, folder).collect()} == set(range(len(html)))


def test_warc_is_read_by_many_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>" * 20) for k in range(400)], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.mark_revisits(pages), f"file://{tmp_path}/many", warc.train_dictionary(pages), file_bytes=2000)
    tasks = warc.read_archives(manifest, f"file://{tmp_path}/many").select(F.spark_partition_id().alias("p")).distinct().count()
    assert manifest.count() > 8 and tasks >= 6


def test_warc_of_nothing(spark):
    manifest, folder = warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(manifest, folder).count() == 0


def test_raking():
    cells = [("a", "x", 60.0), ("a", "y", 20.0), ("b", "x", 15.0), ("b", "y", 5.0)]
    weights = mixing.rake(cells, [{"a": 0.5, "b": 0.5}, {"x": 0.6, "y": 0.4}])
    assert [sum(w for c, w in zip(cells, weights, strict=True) if c[d] == k) for d, k in ((0, "a"), (1, "x"))] == pytest.approx([0.5, 0.6])
    # margins keep the cross ratio of the table
    assert weights[0] * weights[3] / weights[1] / weights[2] == pytest.approx(60 * 5 / 20 / 15)
    assert mixing.full_targets({"a": 3.0, "b": 1.0, "c": 0.0}, {"a": 0.5, "z": 0.3}) == pytest.approx({"a": 0.5, "b": 0.5, "c": 0.0})
    assert mixing.full_targets({"a": 9.0, "b": 1.0}, 0.5) == pytest.approx({"a": 0.75, "b": 0.25})


def test_mixture(spark):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(["w"] * int(rng.integers(5, 40))), "big" if rng.random() < 0.8 else "small", "en" if rng.random() < 0.7 else "fr", "t") for k in range(6000)]
    docs = spark.createDataFrame([*rows, (6000, None, None, None, None), (6001, "", "big", None, "t")], "doc_id long, text string, source string, lang string, probability string")
    targets = {"source": {"big": 0.5, "small": 0.5}, "lang": 1.0}
    few, many = mixing.mix(docs, targets, 0.3), mixing.mix(docs, targets, 0.3, driver_cells=2)
    ids = lambda d: {r["doc_id"] for r in d.collect()}
    assert ids(few) == ids(many)
    share = few.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    total = sum(r["n"] for r in share)
    assert all(abs(r["n"] / total - 0.5) < 0.05 for r in share)
    assert 0.2 < total / sum(len(r[1].split()) for r in rows) < 0.4
    assert few.columns[:5] == docs.columns and mixing.mix(docs.limit(0), targets, 0.3).count() == 0


@pytest.mark.parametrize("driver_cells", [mixing.DRIVER_CELLS, 2])
def test_mixture_with_a_rare_label(spark, driver_cells):
    """A label with few tokens is kept whole and does not lower the rate of the others: the budget is met."""
    rows = [(k, "w " * 50, f"src{k % 4}", "en" if k % 3 else "fr") for k in range(4000)] + [(4000, "w " * 50, "rare", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": 0.5, "lang": 0.8}
    slim = docs.select("source", "lang", F.lit(50).cast("long").alias("n_tokens"))
    cells, few = mixing.calibrate(slim, targets, 0.5, driver_cells)
    cells = cells.collect()
    assert few == (driver_cells > 2)
    assert sum(c["tokens"] * c["probability"] for c in cells) == pytest.approx(0.5 * 4001 * 50)
    assert [(c["source"], c["shortfall"] > 0) for c in cells if c["probability"] == 1] == [("rare", True)]
    kept = mixing.mix(docs, targets, 0.5, driver_cells=driver_cells)
    assert 0.45 < kept.count() / len(rows) < 0.55 and kept.where("source = 'rare'").count() == 1


def test_rows_without_ids_are_drawn_by_their_texts(spark):
    docs = spark.createDataFrame([(None, f"w {k} " * 30, "a", "en") for k in range(400)] * 2, "doc_id long, text string, source string, lang string")
    kept = mixing.mix(docs, {"source": 0.5, "lang": 1.0}, 0.5)
    counts = collections.Counter(r["text"] for r in kept.collect())
    assert set(counts.values()) == {2} and 120 < len(counts) < 280


def test_sampling_follows_the_formula(spark):
    """What is kept is what hashes below a cell's probability, worked out here from the cells alone."""
    rows = [(k, "w " * (1 + k % 7), "abc"[k % 3 if k % 5 else 0], "en" if k % 4 else "fr", "t") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets, budget = {"source": {"a": 0.2, "b": 0.4, "c": 0.4}, "lang": {"fr": 0.5, "en": 0.5}, "topic": 1.0}, 0.3
    tokens = collections.Counter()
    for _, t, *cell in rows:
        tokens[tuple(cell)] += len(t.split())
    total = sum(tokens.values())
    weight = {c: n / total for c, n in tokens.items()}
    for _ in range(200):
        for d, goal in ((0, targets["source"]), (1, targets["lang"])):
            sums = collections.Counter()
            for c, w in weight.items():
                sums[c[d]] += w
            weight = {c: w * goal[c[d]] / sums[c[d]] for c, w in weight.items()}
    chance = {c: w * budget * total / tokens[c] for c, w in weight.items()}
    assert max(chance.values()) < 1
    draws = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.uniform(F.col("doc_id"), F.col("text")).alias("u")).collect()}
    unsure = [k for k, _, *c in rows if abs(draws[k] - chance[tuple(c)]) < 1e-5]
    want = {k for k, _, *c in rows if draws[k] < chance[tuple(c)]} - set(unsure)
    assert {r["doc_id"] for r in mixing.mix(docs, targets, budget).collect()} - set(unsure) == want and len(unsure) < 3


def test_topics_are_shares_of_the_whole_text(spark):
    texts = [("prose " * 60 + "12 34", "prose"), ("1234 5678 " * 20 + "words", "numeric"), ("A B C D E F NASA " + "lower case words " * 50, "prose"), ("LOUD WORDS ONLY " * 5, "shouted"), ("|a|b|c|d|e|f|", "table"), ("|a|b|c|d|e|f|" + "long prose follows " * 60, "prose"), ("### x $$$ y %%%", "markup"), (None, "prose"), ("", "prose")]
    found = spark.createDataFrame(texts, "text string, want string").select("want", mixing.topic_of(F.col("text")).alias("topic")).collect()
    assert [r["topic"] for r in found] == [r["want"] for r in found]


def test_pipeline_stages(spark, near, tmp_path):
    texts, _ = near
    rows = [(k, t, "en" if k % 2 else None, f"src{k % 3}", len(t or ""), 0.5) for k, t in enumerate(texts[:60])]
    rows += [(900, "12 34", "en", "src1", 5, 0.1), (901, "here token = \"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde\" ok words and more", "en", None, None, None), (None, "some text without an id", None, None, 1, None)]
    docs = spark.createDataFrame([*rows, rows[10]], "doc_id long, text string, lang string, source string, n_chars long, score double")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, None)
        if name != "packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in docs.collect()})
        if name == "secrets":
            assert docs.where("text like '%2abc3ff2%'").count() == 0 and docs.where("doc_id = 901 and text like '%[SECRET]%'").count() == 1
    language, dedup, secrets, mixture, pieces = kept
    assert language == {r[0] for r in rows if r[0] != 900 and any(c.isalpha() for c in r[1] or "")}
    order = sorted(d for d in language if d is not None)
    texts_of = {d: t for d, t, *_ in rows}
    roots = roots_of(len(order), jaccard_links([texts_of[d] for d in order]))
    assert dedup == {order[k] for k, r in enumerate(roots) if k == r} | {None} and secrets == dedup and mixture <= secrets and pieces == mixture


def test_near_dedup_keeps_one_row_of_a_group(spark):
    same = " ".join(f"w{k}" for k in range(60))
    rows = [(5, same, "b"), (5, same, "a"), (5, same + " end", "a"), (5, "quite another text", "c"), (3, "some text", "z"), (8, same.upper(), "d"), (None, same, "e"), (None, same, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string")
    out = corpus_pipeline.near_dedup(spark, docs, None)
    assert out.columns == docs.columns
    kept = collections.Counter((r["doc_id"], (r["text"] or "").startswith("w0")) for r in out.collect())
    assert kept == {(5, True): 1, (5, False): 1, (3, False): 1, (None, True): 2}


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, None).count() == 0
    assert packing.WINDOW == 2048
