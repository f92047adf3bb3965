"""Spelling variants, conversation repair, positive-unlabelled quality: against brute force and on awkward rows."""

import hashlib
import random
import re
import sys
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import conversation_repair, pivotal_grams, positive_unlabelled
from millrace.llm.common import held_out
from millrace.llm.queries import _slips, damaged

# ---------------------------------------------------------------- spelling variants


def one_edit(a, b):
    """Whether b comes from a by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def found_variants(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("letters, lengths, seed", [("ab", (5, 9), 1), ("abcdé", (5, 7), 2), ("aß", (4, 6), 3), ("abcdefghijklmnop", (8, 14), 4)])
def test_variants_equal_brute_force(spark, letters, lengths, seed):
    rng = random.Random(seed)
    words = set()
    while len(words) < 150:
        base = "".join(rng.choice(letters) for _ in range(rng.randint(*lengths)))
        words.add(base)
        for _ in range(3):
            at, kind = rng.randrange(len(base)), rng.randrange(3)
            other = base[:at] + ("" if kind == 0 else rng.choice(letters)) + base[at + (kind < 2) :]
            if len(other) >= lengths[0]:
                words.add(other)
    counts = {w: rng.choice([3, 4, 6, 9, 20, 40]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert found_variants(pivotal_grams.variants(df)) == brute_variants(counts)


def test_chain_of_forms_ends_at_its_root(spark):
    chain = ["a" * (5 + i) for i in range(14)]
    counts = {w: 3 * 2**i for i, w in enumerate(chain)}
    found = found_variants(pivotal_grams.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")))
    assert found == brute_variants(counts) and {r[2] for r in found} == {chain[-1]}


def test_pivots_are_the_lightest_pair_apart():
    rng = random.Random(7)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        weights = [rng.randint(1, 9) for _ in places]
        pairs = [(weights[i] + weights[j], places[i], places[j]) for i, j in combinations(range(len(places)), 2) if places[j] - places[i] >= 2]
        a, b = pivotal_grams.pivots(places, weights)
        assert b - a >= 2 and weights[places.index(a)] + weights[places.index(b)] == min(pairs)[0]


def test_words_are_counted_over_whole_texts(spark, hard_docs, no_docs):
    import zlib

    def expected(rows, alter):
        counts = Counter()
        for r in rows:
            for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")):
                h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
                if alter and h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
        return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}

    extra = spark.createDataFrame([(i, f"Wort{'ähnlich' * (i % 3)} ÉTAT état naïve×word x1abcdeX " * 7) for i in range(400)], "doc_id bigint, text string")
    docs = hard_docs.select("doc_id", "text").union(extra)
    rows = docs.collect()
    for alter in (None, _slips):
        found = {r["word"]: r["n"] for r in pivotal_grams.count_words(docs, alter=alter).collect()}
        assert found == expected(rows, alter)
    # The columns of the result clash with none of the input, and a word of 50,000 letters is a word.
    assert found_variants(pivotal_grams.spelling_variants(docs.withColumn("word", F.lit(1)).withColumn("n", F.lit(2)))) == brute_variants(expected(rows, None))
    long = spark.createDataFrame([(i, "x" * 50_000 + " " + "x" * 50_001) for i in range(3)], "doc_id bigint, text string")
    assert {(r[4], r[1]) for r in found_variants(pivotal_grams.spelling_variants(long))} == {(1, None)}
    assert pivotal_grams.spelling_variants(no_docs).count() == 0
    with pytest.raises(ValueError):
        pivotal_grams.spelling_variants(docs, min_length=3)


# ---------------------------------------------------------------- conversation repair


def brute_repair(rows):
    """The report of one conversation from its rows (turn, role, text) in order: all edits tried, cheapest first."""
    space, seen, kinds = " \t\n\x0b\x0c\r", set(), []
    for _, role, text in rows:
        body = text.strip(space)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))

    def walk(i, last):
        if i == len(rows):
            ends = [(0, "", ())] if last in ("", "a") else []
            if last == "u":
                ends.append((2, "I", ("assistant:",)))
            if last == "s":
                ends.append((4, "II", ("user:", "assistant:")))
            return min(ends)
        return min(options(i, last, 0))

    cache = {}

    def options(i, last, inserts):
        key = (i, last, inserts)
        if key in cache:
            return cache[key]
        _, role, text = rows[i]
        out = []
        due = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]

        def then(cost, letter, line, state):
            c, a, r = walk(i + 1, state)
            out.append((cost + c, letter + a, line + r))

        then(3, "D", (), last)
        if kinds[i] not in ("blank", "duplicate"):
            cut = kinds[i] == "truncated"
            if role[:1] == due or (role[:1] == "s" and last == ""):
                then(cut, "K", (f"{role}:{text}",), role[:1])
            then(2 + cut, "R", (f"{name}:{text}",), due)
        if inserts < 3:
            c, a, r = min(options(i, due, inserts + 1))
            out.append((2 + c, "I" + a, (f"{name}:",) + r))
        cache[key] = out
        return out

    cost, audit, lines = walk(0, "") if rows else (0, "", ())
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def random_rows(rng, n, start=0):
    texts = ["Yes.", "No!", "So", "", " \t", "Why? ", "Maybe.\x0b", "Ünï?", "a:b\nc."]
    turn, rows = start, []
    for _ in range(n):
        turn += rng.choice([1, 1, 1, 2])
        rows.append((turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "umpire"]), rng.choice(texts) + rng.choice(["", str(turn % 40) + "."])))
    return rows


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def reports(df):
    return {r["conv_id"]: tuple(r[c] for c in REPORT) for r in df.collect()}


def test_tight_edits_do_not_depend_on_checkpoints():
    rng = random.Random(3)
    for _ in range(200):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 10]) for _ in range(rng.randint(0, 40)))
        vectors = [conversation_repair.END]
        for code in reversed(codes):
            vectors.append(conversation_repair._before(code, vectors[-1]))
        whole = conversation_repair.tight_edits(codes, 0, conversation_repair.END, True)
        assert whole[1] == vectors[-1][0]
        cut = rng.randint(0, len(codes))
        head = conversation_repair.tight_edits(codes[:cut], 0, vectors[len(codes) - cut], False)
        tail = conversation_repair.tight_edits(codes[cut:], head[2], conversation_repair.END, True)
        assert "".join(e[0] for e in head[0] + tail[0]) == "".join(e[0] for e in whole[0]) and head[1] + tail[1] == whole[1]


@pytest.mark.parametrize("block_rows", [4096, 5])
def test_audit_equals_brute_force(spark, monkeypatch, block_rows):
    rng = random.Random(11)
    talks = {i: random_rows(rng, rng.randint(1, 9)) for i in range(60)}
    talks[1000] = random_rows(rng, 200)
    talks[None] = random_rows(rng, 7)
    rows = [(c, *r) for c, rs in talks.items() for r in rs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", block_rows)
    # Blocks are cut in workers, which get the module's function with the bound it has here.
    found = reports(conversation_repair.audit(df.withColumn("key", F.lit("x")).withColumn("part", F.lit(1))))
    assert found == {c: brute_repair(rs) for c, rs in talks.items()}


def test_long_conversation_in_many_blocks(spark):
    """Over 4,096 rows and several partitions, with texts that come again in other blocks."""
    rng = random.Random(5)
    rows = random_rows(rng, 9_000)
    rows = [(t, r, x if i % 7 else f"The same {i % 5}.") for i, (t, r, x) in enumerate(rows)]
    other = {c: random_rows(rng, 4) for c in ("a", "zz")}
    data = [("m", *r) for r in rows] + [(c, *r) for c, rs in other.items() for r in rs]
    df = spark.createDataFrame(data, "conv_id string, turn bigint, role string, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = reports(conversation_repair.audit(df))
        edits = conversation_repair.repair(df).where("conv_id = 'm'").orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    small = {c: brute_repair(rs) for c, rs in other.items()}
    assert {c: found[c] for c in other} == small
    # The long one is compared with one walk over all rows at once.
    seen, codes = set(), bytearray()
    for _, role, text in rows:
        body = text.strip(conversation_repair.SPACES)
        code = conversation_repair.STATES.get(role[:1], 0)
        codes.append(code | 8 if not body or (role, text) in seen else code | 4 if body[-1] not in ".!?" else code)
        seen.add((role, text))
    whole, cost, _ = conversation_repair.tight_edits(bytes(codes), 0, conversation_repair.END, True)
    assert found["m"][5:7] == (cost, "".join(e[0] for e in whole)) == (cost, "".join(r["edit"] for r in edits))
    text = "\n".join(f"{r['role']}:{r['text']}" for r in edits if r["edit"] != "D")
    assert hashlib.sha256(text.encode()).hexdigest() == found["m"][7]
    initials = "".join(r["role"][0] for r in edits if r["edit"] != "D")
    assert re.fullmatch("(s?(ua)+)?", initials)


def test_hard_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, edits string"
    rows = [
        (1, None, None, None, "x"), (1, None, "user", "Hi.", "x"), (1, 2, "user", "Hi.", "x"), (1, 5, "assistant", "w " * 400_000, "x"),
        (2, None, "user", "Alone.", None), (3, 1, "", "No role", None), (None, 3, "system", "S.", None),
    ]
    df = spark.createDataFrame(rows, schema)
    found = reports(conversation_repair.audit(df))
    talks = {}
    for c, t, role, text, _ in rows:
        talks.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    assert found == {c: brute_repair(rs) for c, rs in talks.items()}
    same = reports(conversation_repair.audit(df.union(df).where("conv_id = 2")))
    assert same[2][:6] == (0, 0, 1, 0, 1, 5)
    assert conversation_repair.audit(df.limit(0)).count() == 0 and conversation_repair.repair(df.limit(0)).count() == 0
    gone = reports(conversation_repair.audit(df.where("conv_id = 3"), all_rows=df))
    assert gone[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and len(gone) == 4


def test_damage_follows_the_crc(spark):
    import zlib

    rows = [(c, t, "assistant", f"One. Two! {c}") for c in range(30) for t in range(5)] + [(None, None, None, None)]
    found = Counter((r["conv_id"], r["turn"], r["role"], r["text"]) for r in damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect())
    expected = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            expected[c, t, "user" if kind == 4 else role, text] += 2 if kind == 3 else 1
    assert found == expected


# ---------------------------------------------------------------- positive-unlabelled quality


def invented(rng, good):
    words = [rng.choice(["the", "cat", "sat", "warm", "house", "over", "garden", "quiet"]) for _ in range(rng.randint(20, 80))]
    if good:
        return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)
    return " ".join(w.upper() + rng.choice(["$$$", "!!", " |"]) for w in words)


def test_quality_of_invented_texts(spark):
    rng = random.Random(1)
    truth = {i: rng.random() < 0.7 for i in range(3000)}
    rows = [(i, invented(rng, good)) for i, good in truth.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    trusted = docs.where(F.col("doc_id").isin([i for i in range(600) if truth[i]]))
    model = positive_unlabelled.fit(trusted, docs)
    assert abs(model.prior - 0.7) < 0.06
    found = {r["doc_id"]: r for r in positive_unlabelled.score(docs, model).collect()}
    assert sum(found[i]["predicted"] == truth[i] for i in range(600, 3000)) / 2400 > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())


def test_risk_is_the_one_of_the_rows(spark):
    """Sums, gradients and curvature over tiles equal those of plain numpy over all rows."""
    rng = np.random.default_rng(2)
    rows, kinds = rng.random((500, len(positive_unlabelled.FEATURES))), rng.random(500) < 0.4
    tiles = spark.createDataFrame([(bool(k), 0, bytearray(rows[kinds == k][at::3].tobytes())) for k in (True, False) for at in range(3)], "positive boolean, half int, tile binary")
    model, weights = (rows.mean(axis=0), rows.std(axis=0)), rng.normal(size=rows.shape[1] + 1)
    for kind, (as_negative, as_positive, slope_n, slope_p, bend) in zip((False, True), positive_unlabelled._pass(tiles, model, weights), strict=True):
        x = np.hstack([(rows[kinds == kind] - model[0]) / model[1], np.ones((np.sum(kinds == kind), 1))])
        z = x @ weights
        s = 1 / (1 + np.exp(-z))
        assert np.allclose(as_negative, np.log1p(np.exp(z)).mean()) and np.allclose(as_positive, np.log1p(np.exp(-z)).mean())
        assert np.allclose(slope_n, (s[:, None] * x).mean(axis=0)) and np.allclose(slope_p, ((s - 1)[:, None] * x).mean(axis=0))
        assert np.allclose(bend, (x.T * (s * (1 - s))) @ x / len(x))


def test_risk_never_follows_a_negative_estimate(spark):
    """With a prior that is too high the unbiased risk falls below zero; the non-negative one must not."""
    rng = np.random.default_rng(3)
    width = len(positive_unlabelled.FEATURES)
    good, bad = rng.normal(1, 0.3, (300, width)), rng.normal(-1, 0.3, (300, width))
    tiles = spark.createDataFrame([(True, 0, bytearray(good[:150].tobytes())), (False, 0, bytearray(np.vstack([good[150:], bad]).tobytes()))], "positive boolean, half int, tile binary")
    model = np.zeros(width), np.ones(width)
    weights = positive_unlabelled._minimised(tiles, model, 0.9)
    (as_n_u, *_), (as_n_p, as_p_p, *_) = positive_unlabelled._pass(tiles, model, weights)
    assert 0.9 * as_p_p + max(0.0, as_n_u - 0.9 * as_n_p) < np.log(2) and np.isfinite(weights).all()


def test_quality_of_hard_rows(spark, hard_docs, no_docs):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, invented(rng, i % 3 > 0)) for i in range(300)], "doc_id bigint, text string")
    model = positive_unlabelled.fit(docs.where("doc_id % 3 > 0 and doc_id < 150"), docs.union(hard_docs.select("doc_id", "text")))
    clashing = hard_docs.withColumn("_item", F.lit(1)).withColumn("predicted", F.lit("x"))
    found = positive_unlabelled.score(clashing, model).collect()
    assert len(found) == hard_docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert positive_unlabelled.score(no_docs, model).count() == 0
    nothing = positive_unlabelled.fit(no_docs, docs)
    assert {r["score"] for r in positive_unlabelled.score(docs, nothing).collect()} == {0.0}
    assert positive_unlabelled.fit(docs, no_docs).constant == 1.0 and positive_unlabelled.fit(no_docs, no_docs).constant == 0.0


def test_quality_held_out_accuracy(spark, data_dir):
    from millrace.llm.queries import op13_positive_unlabelled

    base = data_dir.replace("sf0.001", "sf0.01")
    scored = op13_positive_unlabelled(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in scored) / len(scored) > 0.95
    assert spark.read.parquet(f"{base}/documents.parquet").where(held_out("doc_id", 5, 0)).count() > len(scored)
