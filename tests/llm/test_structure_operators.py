"""Vectors, fingerprints, shards, packing, components and the pipeline: against brute force and on awkward rows."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bit_slices, histogram_sort, lattice_dedup, mixture_packing, simhash_tiles
from millrace.operators.components import components

WORDS = public_tokenizers.path("word_bpe_49k.json")


def groups(near):
    label = np.arange(len(near))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    found = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 160)} == {100} and found[201] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_steps_of_components_follow_edges_not_partitions(spark, monkeypatch):
    """A step of few edges must not make a task and a file for each partition of a shuffle."""
    from millrace.operators import components as module

    made, original = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: made.append((name, original(df, name))) or made[-1][1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 3000, 2)] + [(0, i) for i in range(2, 3000, 2)], "a bigint, b bigint")
    cores = spark.sparkContext.defaultParallelism
    settings = {"spark.sql.shuffle.partitions": str(cores * 6), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert {r["component"] for r in components(edges).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"minima", "large", "roots", "edges"} <= {name for name, _ in made}
    assert all(len(df.inputFiles()) <= cores for _, df in made[1:])


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows = [list(map(float, v / np.linalg.norm(v))) for v in rng.standard_normal((250, 16))]
    for base in range(30):
        step = rng.standard_normal(16)
        rows.append(list(map(float, np.array(rows[base]) + 0.06 * step)))
    rows += [rows[0], rows[0]] + [list(map(float, np.array(rows[5]) + 0.01 * rng.standard_normal(16))) for _ in range(40)]
    return rows


def test_lattice_points_are_nearest():
    x = np.random.default_rng(1).normal(size=(200, 8)) * 2
    found = lattice_dedup.decode(x)
    assert (found * 2 == np.rint(found * 2)).all() and (found.sum(axis=1) % 2 == 0).all()
    assert (((x[:, None] - (found[:, None] + lattice_dedup.MINIMAL)) ** 2).sum(axis=2) >= ((x - found) ** 2).sum(axis=1)[:, None] - 1e-9).all()
    assert len(lattice_dedup.MINIMAL) == 240


def test_link_vectors(spark):
    rows = vectors()
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0]]
    ids = list(range(1, len(rows) + 1))
    df = spark.createDataFrame([*zip(ids, rows, strict=True), *((1000 + i, x) for i, x in enumerate(odd)), (None, rows[1])], "vec_id bigint, embedding array<double>").withColumn("key", F.lit("x"))
    x = np.array([*rows, rows[1]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    label = groups(near)
    for tile_rows in (4096, 16):
        found = lattice_dedup.link_vectors(df, tile_rows=tile_rows).collect()
        assert len(found) == df.count()
        by_id = {r["vec_id"]: r for r in found}
        for i, row_id in enumerate(ids):
            assert by_id[row_id]["n_links"] == near[i].sum() - 1
            assert by_id[row_id]["component_id"] == ids[label[i]] and by_id[row_id]["kept"] == (label[i] == i)
        for i in range(len(odd)):
            assert tuple(by_id[1000 + i])[1:] == (0, 1000 + i, True)
    assert lattice_dedup.link_vectors(df.limit(0)).count() == 0


def test_link_recall_at_the_threshold(spark):
    """Pairs of 64 dimensions with cosines just above the threshold, measured against brute force."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((400, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.951, 0.96, (400, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = lattice_dedup.link_vectors(df).agg(F.sum("n_links")).first()[0] / 2
    assert found >= 0.97 * 400


def test_top_products(spark):
    rows = [[round(v, 2) for v in r] for r in vectors(9)] + [None, [float("inf")] * 16, [None] * 16]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    good = {i: np.floor(np.array(r) * 1024).astype(int) for i, r in enumerate(rows) if r and r[0] is not None and np.isfinite(r[0])}
    for block in (8192, 70):
        found = bit_slices.top_products(df, F.col("vec_id") % 20 == 0, 10, index_rows=block, query_rows=4)
        got = {}
        for r in found.collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        for q in [i for i in good if i % 20 == 0]:
            best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:10]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    # A repeated row is a candidate each time, and one query.
    twice = df.union(df.where("vec_id in (0, 20, 21)"))
    for r in bit_slices.top_products(twice, F.col("vec_id") == 20, 5, index_rows=70).collect():
        best = sorted((-int(good[20] @ v), i) for i, v in good.items() if i != 20 for _ in range(1 + (i in (0, 21))))[:5]
        assert (-r["score"], r["vec_id"]) == best[r["rank"] - 1]
    few = df.where("vec_id in (0, 3, 4)")
    assert bit_slices.top_products(few, F.col("vec_id") == 0).count() == 2
    assert bit_slices.top_products(df.limit(0), F.col("vec_id") == 0).count() == 0


def brute_print(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, hard_docs, no_docs):
    base = [f"w{i % 97} v{i % 89} u{i % 83}" for i in range(120)]
    rows = [(1000 + k, " ".join(base[:k] + ["zz"] + base[k + 1 :])) for k in range(40)] + [(2000 + k, f"some other text {k} " * 5) for k in range(40)]
    docs = hard_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id bigint, text string"))
    all_ = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    f = np.array([x[1] for x in all_], np.uint64)
    label = groups(np.bitwise_count(f[:, None] ^ f) <= 4)
    least = {g: min(i for (i, _), x in zip(all_, label, strict=True) if x == g and i is not None or x == g and i is None and False) if any(i is not None for (i, _), x in zip(all_, label, strict=True) if x == g) else None for g in set(label)}
    want = Counter((i, f"{p:016x}", least[g]) for (i, p), g in zip(all_, label, strict=True))
    prints = simhash_tiles.near_duplicates(docs)
    assert Counter(map(tuple, prints.collect())) == want
    small = simhash_tiles.fingerprints(docs, "text", 4, 1, ["doc_id"])
    tiled = dict(simhash_tiles.similar_groups(small, "doc_id", 4, tile_rows=8).collect())
    assert {tiled[p.to_bytes(8, "big")] for _, p in all_} == set(least.values())
    assert simhash_tiles.near_duplicates(no_docs).count() == 0


def test_simhash_stage_keeps_one(spark, hard_docs):
    words = [f"word{i * 7919 % 1000}" for i in range(400)]
    near = [(500 + k, " ".join(words[: 10 * k] + [f"new{k}"] + words[10 * k + 1 :]), "en", "a", "n") for k in range(12)]
    docs = hard_docs.union(spark.createDataFrame(near, hard_docs.schema))
    kept = simhash_tiles.deduplicate(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    assert 500 in ids and not any(501 <= i <= 511 for i in ids if i) and 100 in ids and 101 not in ids and 2 in ids and 3 not in ids


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_brute_force(rows):
    """The ids that stay of (id, text) by exact Jaccard similarity of all pairs."""
    sets = [shingles(t) for _, t in rows]
    size = np.array([len(s) for s in sets])
    number = {x: k for k, x in enumerate({x for s in sets for x in s})}
    cells = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        cells[i, [number[x] for x in s]] = 1
    common = np.rint(cells @ cells.T)
    near = (5 * common >= 4 * (size[:, None] + size - common)) | ((size[:, None] == 0) & (size == 0))
    label = groups(near)
    return {min((rows[j][0] for j in np.flatnonzero(label == g))) for g in set(label)}


def pairs_at(rng, similarity, n, length):
    """``n`` pairs of texts of ``length`` shingles, the second with its end replaced so that they have the similarity."""
    out = []
    for _ in range(n):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, length + 4)]
        swapped = int(length * (1 - similarity) / (1 + similarity))
        out.append((" ".join(words), " ".join(words[: len(words) - swapped] + [f"v{x}" for x in rng.integers(0, 1 << 40, swapped)])))
    return out


def test_stage_recall_and_precision(spark):
    """Pairs at and above the threshold are found, pairs below it stay, in numbers measured against brute force."""
    rng = np.random.default_rng(8)
    made = [(s, pair) for s in (0.6, 0.7, 0.78, 0.8, 0.85, 0.9) for length in (90, 360) for pair in pairs_at(rng, s, 60, length)]
    rows = [(2 * k + side, pair[side]) for k, (_, pair) in enumerate(made) for side in (0, 1)]
    got = {r[0] for r in simhash_tiles.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id").collect()}
    for low in (0.6, 0.7, 0.78, 0.8, 0.85, 0.9):
        exact = [(2 * k + 1, jaccard(*map(shingles, pair)) >= 0.8) for k, (s, pair) in enumerate(made) if s == low]
        assert {near for _, near in exact} == {low >= 0.8}
        gone = sum(i not in got for i, _ in exact)
        assert gone >= 0.99 * len(exact) if low >= 0.8 else gone == 0, (low, gone)


def test_stage_against_brute_force(spark, monkeypatch):
    """Pairs on both sides of 0.8, chains, short and repetitive texts, and crowds of several tiles."""
    rng = np.random.default_rng(9)
    texts = [t for s in (0.5, 0.75, 0.79, 0.81, 0.86) for pair in pairs_at(rng, s, 12, 200) for t in pair]
    base = [f"c{i}" for i in range(300)]
    texts += [" ".join(base[5 * k : 150 + 5 * k]) for k in range(20)]
    texts += [" ".join(base[40 * k : 150 + 40 * k]) for k in range(4)]
    texts += [" ".join([*base[:k], f"n{k}", *base[k + 1 :]]) for k in range(0, 300, 5)]
    texts += ["one two three", "One two  three", "one two four", "", None, "same " * 50 + " ".join(base[:30]), "same " * 900 + " ".join(base[:30]), "same " * 900 + "other words at the end of it"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = kept_by_brute_force(rows)
    for tile_rows in (256, 6):
        monkeypatch.setattr(simhash_tiles, "CROWD_ROWS", tile_rows)
        assert {r[0] for r in simhash_tiles.deduplicate(df).select("doc_id").collect()} == want


def family(n, start=0):
    """Fingerprints within two bits of each other: one bit of 64 on top of a common word, and pairs of bits."""
    bits = [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    return [(start + k, bytearray((0x0F0F0F0F0F0F0F0F ^ b).to_bytes(8, "big"))) for k, b in enumerate(bits[:n])]


def test_links_grow_with_a_family_not_with_its_square(spark, monkeypatch):
    counts = []
    original = simhash_tiles.components
    monkeypatch.setattr(simhash_tiles, "components", lambda links: original(counts.append(links.count()) or links))
    for n in (400, 800, 1600):
        prints = spark.createDataFrame(family(n), "item bigint, fp binary")
        found = {r["component"] for r in simhash_tiles.similar_groups(prints, "item", 4, tile_rows=32).collect()}
        assert found == {0}
    assert counts[1] <= 2.5 * counts[0] and counts[2] <= 2.5 * counts[1] and counts[2] < 3 * 1600, counts


def test_tiles_follow_rows_not_partitions(spark, monkeypatch):
    """A tile is sent once for each block, so few rows in many partitions must not make many tiles."""
    rng = np.random.default_rng(5)
    words = np.unique(rng.integers(0, 2**63, 2500, dtype=np.uint64))
    near = words[:600] ^ (np.uint64(1) << rng.integers(0, 63, 600).astype(np.uint64)) ^ np.uint64(1 << 63)
    fps = np.unique(np.concatenate([words, near]))
    label = groups(np.bitwise_count(fps[:, None] ^ fps) <= 4)
    least = {g: int(np.flatnonzero(label == g)[0]) for g in set(label)}
    rows = [(i, bytearray(int(f).to_bytes(8, "big"))) for i, f in enumerate(fps)]
    made, original = {}, simhash_tiles.written
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        for tile_rows, tiles in ((simhash_tiles.TILE_ROWS, 3), (40, 80)):
            made.clear()
            monkeypatch.setattr(simhash_tiles, "written", lambda df, name: made.setdefault(name, original(df, name)))
            found = simhash_tiles.similar_groups(spark.createDataFrame(rows, "item bigint, fp binary"), "item", 4, tile_rows=tile_rows)
            got = {int.from_bytes(r["fp"], "big"): r["component"] for r in found.collect()}
            assert got == {int(f): least[g] for f, g in zip(fps, label, strict=True)}
            assert made["tiles"].count() <= tiles
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_stage_keeps_columns_of_any_name(spark, hard_docs, no_docs):
    names = ["row", "_row", "digest", "bands", "node", "rank"]
    docs = hard_docs.select("*", *[F.lit(n).alias(n) for n in names])
    kept = simhash_tiles.deduplicate(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.select(*names).collect()} == {tuple(names)}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in simhash_tiles.deduplicate(hard_docs).collect()}
    assert simhash_tiles.deduplicate(no_docs).count() == 0


def test_histogram_sort(spark, hard_docs, no_docs):
    found = histogram_sort.shard_documents(hard_docs).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in hard_docs.collect()}
    assert len(found) == hard_docs.count()
    slots = {}
    for r in found:
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert histogram_sort.shard_documents(no_docs).count() == 0


def test_histogram_sort_is_even_and_sorted(spark):
    rows = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(1000)) * F.when(F.col("id") % 3 == 0, 0).otherwise(1) * 2**40 + F.col("id")).alias("k"), (F.col("id") % 50 + 1).alias("w"))
    sorted_ = histogram_sort.histogram_sort(rows, F.col("k"), F.col("w"), 8).collect()
    totals = Counter()
    for r in sorted_:
        totals[r["shard"]] += r["w"]
    assert max(totals.values()) < 1.01 * sum(totals.values()) / 8
    keys = [r["k"] for r in sorted(sorted_, key=lambda r: (r["shard"], r["slot"]))]
    assert keys == sorted(keys)


def check_packing(rows, ids, window=4096):
    cover, sequences = Counter(), {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["length"] > 0 and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        cover[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["source"]))
    for number, pieces in sequences.items():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or number == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    return cover, sequences


def test_packing(spark, hard_docs, no_docs):
    from tokenizers import Tokenizer

    peer = Tokenizer.from_file(WORDS)
    rows = hard_docs.collect()
    ids = {r["doc_id"]: [*peer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in rows}
    copies = Counter(r["doc_id"] for r in rows)
    for weights in (None, {"a": 1.0, "b": 3.0}):
        packed = mixture_packing.pack(hard_docs, WORDS, weights).collect()
        cover, sequences = check_packing(packed, ids)
        assert all(cover[i] == len(x) * copies[i] for i, x in ids.items())
    first = Counter()
    for _, length, source in sequences[0]:
        first[source] += length
    assert abs(first["b"] - 3 * first["a"]) < 8 and set(first) <= {"a", "b"}
    assert mixture_packing.pack(no_docs, WORDS).count() == 0


def test_pieces_come_in_batches_of_few_documents():
    """A task must not hold the pieces of a whole Arrow batch."""
    import pyarrow as pa

    size, count = 700, 3000
    ids = [np.arange(i, i + size, dtype="<u4").tobytes() for i in range(count)]
    columns = {"item": range(count), "queue": ["is a"] * count, "local": [i * size for i in range(count)], "base": [0] * count, "ids": ids}
    rounds = mixture_packing.Rounds({"is a": size * count}, None, 4096)
    batches = [*mixture_packing._pieces(rounds, 4096, True)([pa.RecordBatch.from_pydict(columns)])]
    assert max(len(set(b.column("item").to_pylist())) for b in batches) <= 256
    found = {}
    for row in pa.Table.from_batches(batches).to_pylist():
        found[row["item"]] = found.get(row["item"], b"") + row["ids"]
    assert [found[i] for i in range(count)] == ids


def test_rounds_serve_every_token_once():
    totals = {"is a": 1000, "is b": 37, "is c": 5003, "none": 1}
    for weights in (None, {"is a": 2.0, "is b": 1.0}):
        rounds = mixture_packing.Rounds(totals, weights, 64)
        taken = [None] * sum(totals.values())
        for k, name in enumerate(rounds.names):
            for token in range(totals[name]):
                r = rounds.find(k, token)
                before, after, begins = rounds.round(r)
                assert before[k] <= token < after[k]
                taken[begins[k] + token - before[k]] = name
        assert None not in taken


def test_pipeline(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows.count()
        rows = stage(spark, rows, data_dir)
        assert rows.columns == docs.columns and 0.5 * before < rows.count() <= before, name
    packed = corpus_pipeline.run(spark, data_dir)
    assert packed.agg(F.sum("length")).first()[0] > 0
    assert packed.select("doc_id").distinct().count() == rows.count()


def test_pipeline_against_brute_force(spark, data_dir):
    """The kept ids of the near-duplicates stage, and the rows of run(), which hold the whole of every kept document."""
    from tokenizers import Tokenizer

    rows = spark.read.parquet(f"{data_dir}/documents.parquet")
    for stage in (corpus_pipeline.language, corpus_pipeline.toxicity):
        rows = stage(spark, rows, data_dir)
    texts = {r["doc_id"]: r["text"] for r in rows.select("doc_id", "text").collect()}
    assert len(texts) == rows.count()
    want = kept_by_brute_force(list(texts.items()))
    stayed = corpus_pipeline.near_duplicates(spark, rows, data_dir).select("doc_id").collect()
    assert len(stayed) == len(want) < len(texts) and {r[0] for r in stayed} == want
    peer = Tokenizer.from_file(WORDS)
    ids = {i: [*peer.encode(texts[i] or "", add_special_tokens=False).ids, 2] for i in want}
    cover, _ = check_packing(corpus_pipeline.run(spark, data_dir).collect(), ids)
    assert cover == {i: len(x) for i, x in ids.items()}


def test_crowds_come_from_all_pairs_of_tiles(spark):
    """Fingerprints of 256 bits within the radius fall into one crowd, whatever else their sets share."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, (40, 4), dtype=np.uint64)
    near = words.copy()
    near[:20, 0] ^= np.uint64((1 << 21) - 1)
    near[:20, 1] ^= np.uint64((1 << 43) - 1)
    near[20:, 1:] ^= np.uint64((1 << 22) - 1)
    rows = [(i, bytearray(w.byteswap().tobytes())) for i, w in enumerate(np.concatenate([words, near]))]
    found = simhash_tiles.crowds(spark.createDataFrame(rows, "node bigint, fp binary")).collect()
    assert sorted((r.node, r.crowd, r.n) for r in found) == sorted((i, i % 40, 2) for i in [*range(20), *range(40, 60)])


def test_stage_makes_files_and_workers_by_rows_not_partitions(spark, monkeypatch):
    """A table of few rows must not make a file for each partition of a shuffle, nor a stage run two steps in Python, each
    with workers of its own in an executor's memory."""
    from millrace.operators import components as module

    made, chained, original, mapped = [], [], simhash_tiles.written, simhash_tiles.arrow_map
    keep = lambda df, name: made.append((name, original(df, name))) or made[-1][1]

    def once(df, function, schema):
        for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
            if "MapInArrow" in line:
                chained.append(function.__qualname__)
            if any(x in line for x in ("MapInArrow", "Aggregate", "Join", "RepartitionByExpression")):
                break
        return mapped(df, function, schema)

    monkeypatch.setattr(simhash_tiles, "written", keep)
    monkeypatch.setattr(module, "written", keep)
    monkeypatch.setattr(simhash_tiles, "arrow_map", once)
    base = [f"w{i}" for i in range(200)]
    family = [" ".join([*base[:k], f"new{k % 150}", *base[k + 1 :]]) for k in range(200)] + [" ".join([*base, f"end{k}"]) for k in range(400)]
    lone = [" ".join(f"x{n}y{i}" for i in range(30)) for n in range(600)]
    docs = spark.createDataFrame(list(enumerate(family + lone)), "doc_id bigint, text string")
    cores = spark.sparkContext.defaultParallelism
    settings = {"spark.sql.shuffle.partitions": str(cores * 6), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        kept = sorted(r["doc_id"] for r in simhash_tiles.deduplicate(docs).select("doc_id").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert kept == [0, *range(600, 1200)]
    assert not chained
    assert {"sets", "placed", "members", "star", "stars", "crowds", "edges"} <= {name for name, _ in made}
    files = {(n, name): len(df.inputFiles()) for n, (name, df) in enumerate(made)}
    assert all(count <= cores * (simhash_tiles.STARS if name == "stars" else 1) for (_, name), count in files.items()), files
