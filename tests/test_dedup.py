import random

import brute
import pytest
from pyspark.sql import functions as F

from millrace import operators as ops
from millrace.operators import greedy, neardup
from millrace.operators.greedy import keyed, removals, resolve
from millrace.scratch import written

WORDS = [f"w{i}" for i in range(40)] + ["Straße", "é", "日本"]


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, blanks and nulls."""
    rng = random.Random(3)
    made = ["", None, "   ", "one", "One"]
    while len(made) < 150:
        if rng.random() < 0.6 and len(made) > 20:
            words = (rng.choice(made) or "x").split()
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                words.insert(rng.randrange(len(words) + 1), rng.choice(WORDS))
            made.append(" ".join(words))
        else:
            made.append(" ".join(rng.choice(WORDS) for _ in range(rng.choice([2, 20, 60, 200]))))
    return made


def kept(df):
    return sorted(r.id for r in df.select("id").collect())


def test_reference_texts(spark):
    fox = "The quick brown fox jumps over the lazy dog"
    df = spark.createDataFrame([(fox,), (fox,), (fox.lower(),), ("Something completely different",)], "text string")
    assert ops.dedup_exact(df).count() == 3
    numbered = df.withColumn("id", F.monotonically_increasing_id())
    assert ops.simhash_deduplicate(numbered, "text", 5).count() == 2


def test_exact(spark):
    rows = [(1, "a", None, {"x": 1}), (2, "a", None, {"x": 1}), (3, "b", 1, {"x": 2}), (4, "b", 2, {"x": 2})]
    df = spark.createDataFrame(rows, "id int, k string, n int, m map<string,int>")
    assert ops.dedup_exact(df.drop("id")).count() == 3
    assert kept(ops.dedup_exact(df, "k", "id")) == [1, 3]
    assert kept(ops.dedup_exact(df, ["k", "n"], "id")) == [1, 3, 4]
    assert kept(ops.dedup_exact(df, ["m"], [ "id"])) == [1, 3]
    assert kept(ops.dedup_hash(df, "k", "id")) == [1, 3]
    with pytest.raises(ValueError, match="order_by"):
        ops.dedup_exact(df, ["k"])


def test_first_rows_are_limited_before_the_shuffle(items, capsys):
    ops.dedup_exact(items(10), "category", "id").explain()
    plan = capsys.readouterr().out
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_fingerprints(texts, column, corpus, monkeypatch):
    df = texts(corpus)
    assert column(ops.simhash(df, "t"), "simhash") == [brute.simhash(t) for t in corpus]
    assert column(ops.simhash(df, "t", "word"), "simhash") == [brute.simhash(t, True) for t in corpus]
    assert column(ops.minhash(df, "t"), "minhash") == [brute.minhash(t) for t in corpus]


@pytest.mark.parametrize("threshold", [0, 3, 9])
def test_simhash_deduplicate(texts, corpus, threshold):
    sketches = [brute.simhash(t) for t in corpus]
    expected = brute.greedy(sketches, lambda a, b: brute.differing_bits(a, b) <= threshold)
    result = ops.simhash_deduplicate(texts(corpus).repartition(5), "t", threshold)
    assert kept(result) == expected
    assert kept(ops.simhash_deduplicate(result, "t", threshold)) == expected


def test_minhash_deduplicate(texts, corpus):
    sketches = [brute.minhash(t) for t in corpus]
    expected = brute.greedy(sketches, lambda a, b: brute.agreement(a, b) / 64 >= 0.85)
    assert kept(ops.minhash_deduplicate(texts(corpus), "t", 0.85)) == expected


def test_fuzzy(texts, corpus):
    both = [(brute.minhash(t), brute.bigrams(t)) for t in corpus]
    expected = brute.greedy(
        both, lambda a, b: brute.agreement(a[0], b[0]) / 64 >= 0.7 and brute.jaccard(a[1], b[1]) >= 0.7
    )
    assert kept(ops.dedup_fuzzy(texts(corpus), "t", 0.7)) == expected


def test_pairs(texts, corpus):
    for make, sketch, similar in (
        (lambda d: ops.near_dup_pairs(d, "t", 3), brute.simhash, lambda a, b: brute.differing_bits(a, b) <= 3),
        (lambda d: ops.minhash_pairs(d, "t", 0.8), lambda t: tuple(brute.minhash(t)), lambda a, b: brute.agreement(a, b) / 64 >= 0.8),
    ):
        groups = {}
        for i, text in enumerate(corpus):
            groups.setdefault(sketch(text), []).append(i)
        nodes = sorted((ids[0], len(ids), value) for value, ids in groups.items())
        stay = brute.greedy([n[2] for n in nodes], similar)
        expected = set()
        for i in set(range(len(nodes))) - set(stay):
            a = nodes[next(k for k in stay if similar(nodes[k][2], nodes[i][2]))]
            expected.add((a[0], nodes[i][0], a[1], nodes[i][1]))
        rows = make(texts(corpus)).select("id_a", "id_b", "copies_a", "copies_b").collect()
        assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected


def test_several_order_columns(spark):
    df = spark.createDataFrame([(1, 2, "a b c"), (1, 1, "a b c"), (0, 9, "x")], "g int, n int, t string")
    result = ops.simhash_deduplicate(df, "t", 3, ["g", "n"])
    assert {(r.g, r.n) for r in result.collect()} == {(1, 1), (0, 9)}
    assert ops.near_dup_pairs(df, "t", 9, "g,n").columns[:4] == ["g_a", "n_a", "g_b", "n_b"]


def test_chain_is_not_a_component(spark):
    # a~b, b~c, not a~c: c stays, because b does not.
    nodes = spark.createDataFrame([(1, 0b0), (2, 0b111), (3, 0b111111)], "o int, sketch bigint")
    assert {r.o for r in resolve(nodes, neardup.simhash_sketch(3)).collect()} == {2}


def crowd(kind):
    """Fingerprints of which a large part shares a band, or lies close together."""
    rng = random.Random(11)
    base, made = rng.getrandbits(64), []
    while len(made) < 400:
        roll = rng.random()
        if kind == "close" and roll < 0.5:
            value = base
            for bit in rng.sample(range(64), rng.choice([1, 2, 3])):
                value ^= 1 << bit
        elif kind == "band" and roll < 0.6:
            value = (base & 0xFFFF) | (rng.getrandbits(48) << 16)
        elif made and roll < 0.85:
            value = rng.choice(made) ^ (1 << rng.randrange(64))
        else:
            value = rng.getrandbits(64)
        made.append(value)
    return list(dict.fromkeys(brute.signed(v) for v in made))


@pytest.mark.parametrize("kind", ["close", "band"])
def test_crowded_buckets(spark, kind):
    values = crowd(kind)
    nodes = spark.createDataFrame(list(enumerate(values)), "o bigint, sketch bigint")
    near = lambda a, b: brute.differing_bits(a, b) <= 3
    expected = brute.greedy(values, near)
    sketch = neardup.simhash_sketch(3, bucket_rows=60)
    gone = sorted(set(range(len(values))) - set(expected))
    assert sorted(r.o for r in resolve(nodes, sketch).collect()) == gone
    found = {(r.o_a, r.o_b, r.measure) for r in removals(nodes, sketch, []).collect()}
    removers = {b: next(a for a in expected if near(values[a], values[b])) for b in gone}
    assert found == {(a, b, brute.differing_bits(values[a], values[b])) for b, a in removers.items()}


def test_tight_family(spark):
    # 5,000 fingerprints within 3 bits of one: the rows per node stay those of its keys, whatever the crowd.
    rng = random.Random(5)
    base, values = rng.getrandbits(64), {}
    while len(values) < 5000:
        value = base
        for bit in rng.sample(range(64), 3):
            value ^= 1 << bit
        values[brute.signed(value)] = None
    values = list(values)
    nodes = spark.createDataFrame(list(enumerate(values)), "o bigint, sketch bigint")
    sketch = neardup.simhash_sketch(3)
    assert keyed(nodes, sketch).count() == 10 * len(values)
    expected = brute.greedy(values, lambda a, b: brute.differing_bits(a, b) <= 3)
    gone = [r.o for r in resolve(nodes, sketch).collect()]
    assert len(gone) == len(set(gone)) and sorted(set(range(len(values))) - set(gone)) == expected


def test_null_order_keys_stay(spark):
    df = spark.createDataFrame([(1, "a b c"), (None, "a b c"), (2, "a b c"), (None, "x y z")], "id int, t string")
    for result in (ops.simhash_deduplicate(df, "t"), ops.minhash_deduplicate(df, "t"), ops.dedup_fuzzy(df, "t")):
        assert sorted((r.id or 0) for r in result.collect()) == [0, 0, 1]


def test_crowded_minhash(spark):
    rng = random.Random(2)
    base, signatures = [rng.getrandbits(32) for _ in range(64)], []
    for i in range(150):
        value = list(base) if i % 3 else [rng.getrandbits(32) for _ in range(64)]
        for place in rng.sample(range(64), rng.choice([2, 5, 12])):
            value[place] = rng.getrandbits(32)
        signatures.append(value)
    nodes = spark.createDataFrame(list(enumerate(signatures)), "o bigint, sketch array<bigint>")
    expected = brute.greedy(signatures, lambda a, b: brute.agreement(a, b) >= 55)
    sketch = neardup.minhash_sketch(0.85, bucket_rows=30)
    gone = {r.o for r in resolve(nodes, sketch).collect()}
    assert sorted(set(range(len(signatures))) - gone) == expected


def test_bounds():
    with pytest.raises(ValueError):
        neardup.minhash_sketch(0.3)
    with pytest.raises(ValueError):
        neardup.simhash_sketch(-1)
    with pytest.raises(ValueError, match="64 keys"):
        neardup.simhash_sketch(10)
    assert neardup.needed_agreement(0.85, 64) == 55


def _walks(count, length, seed=5):
    """Chains of fingerprints: each differs in two bits from the one before."""
    rng = random.Random(seed)
    values = []
    for _ in range(count):
        value = rng.getrandbits(64)
        for _ in range(length):
            values.append(value)
            value ^= sum(1 << b for b in rng.sample(range(64), 2))
    return values


@pytest.mark.parametrize("pass_edges", [1 << 20, 2500])
def test_long_chains_settle_in_a_number_of_steps_that_does_not_grow(spark, monkeypatch, pass_edges):
    monkeypatch.setattr(greedy, "PASS_EDGES", pass_edges)
    steps = []
    monkeypatch.setattr(greedy, "written", lambda df, name: written(steps.append(name) or df, name))
    taken = []
    for count, length in ((16, 250), (2, 2000)):
        values = _walks(count, length)
        nodes = spark.createDataFrame(list(enumerate(map(brute.signed, values))), "o bigint, sketch bigint")
        steps.clear()
        gone = {r.o for r in resolve(nodes, neardup.simhash_sketch(3)).collect()}
        taken.append(len(steps))
        kept = []
        for i, v in enumerate(values):
            if not any((v ^ values[j]).bit_count() <= 3 for j in kept):
                kept.append(i)
        assert gone == set(range(len(values))) - set(kept)
    assert taken[1] <= taken[0] + 4, taken


def test_unlike_rows_of_one_key_meet_in_tiles(spark, monkeypatch):
    """All share the bits of the first key and differ elsewhere: no task gets more than two tiles of their bucket."""
    rng, sketch = random.Random(9), neardup.simhash_sketch(3, bucket_rows=250)
    base, free = rng.getrandbits(64), (1 << 39) - 1
    values = [(base & ~(free << 25)) | (rng.getrandbits(39) << 25) for _ in range(4000)]
    values[3000] = values[10] ^ (1 << 40)
    values[3500] = values[3000] ^ (3 << 50)
    nodes = spark.createDataFrame(list(enumerate(map(brute.signed, values))), "o bigint, sketch bigint")
    sizes = []
    original = greedy._all_pairs

    def watched(members, sketch):
        sizes.append(members.groupBy("bucket", "tile").count().agg(F.max("count")).first()[0])
        return original(members, sketch)

    monkeypatch.setattr(greedy, "_all_pairs", watched)
    found = {(r.o_a, r.o_b, r.measure) for r in removals(nodes, sketch, []).collect()}
    assert sizes and max(sizes) < 2 * 250
    kept, expected = [], set()
    for i, v in enumerate(values):
        first = next((j for j in kept if (v ^ values[j]).bit_count() <= 3), None)
        if first is None:
            kept.append(i)
        else:
            expected.add((first, i, (v ^ values[first]).bit_count()))
    assert found == expected and (10, 3000, 1) in found
