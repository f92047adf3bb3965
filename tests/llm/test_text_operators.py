"""Language, toxicity, language model, BPE, notices: against brute force and on awkward rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from millrace.llm import boosted_toxicity, context_tree, duckdb_bpe, notice_search, segment_language
from millrace.llm.common import held_out

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def kt(bits):
    p, a, b = 1.0, 0, 0
    for bit in bits:
        p *= ((b if bit else a) + 0.5) / (a + b + 1)
        a, b = a + (1 - bit), b + bit
    return p


def brute_ctw(train, text, depth):
    """The weighted probability of text after train, by the recursion over whole sequences of digits."""

    def steps(data):
        out = []
        for value in data:
            row = b"\xff" * depth + value + b"\xff"
            for i in range(depth, len(row)):
                for j in range(8):
                    out.append((row[i - depth : i], (1 << j) | (row[i] >> (8 - j)), row[i] >> (7 - j) & 1))
        return out

    def weighted(rows, context):
        own = kt([bit for _, bit in rows])
        if len(context) == depth:
            return own
        children = {}
        for full, bit in rows:
            children.setdefault(full[depth - len(context) - 1 :], []).append((full, bit))
        below = math.prod(weighted(r, c) for c, r in children.items())
        return (own + below) / 2

    def whole(data):
        nodes = {}
        for context, node, bit in steps(data):
            nodes.setdefault(node, []).append((context, bit))
        return {n: weighted(rows, b"") for n, rows in nodes.items()}

    # One byte at a time after the training texts, as the model is not updated while it scores.
    total, row = 0.0, b"\xff" * depth + text + b"\xff"
    base = steps(train)
    for i in range(depth, len(row)):
        for j in range(8):
            node, bit = (1 << j) | (row[i] >> (8 - j)), row[i] >> (7 - j) & 1
            rows = [(c, b) for c, n, b in base if n == node]
            before = weighted(rows, b"") if rows else 1.0
            total += math.log10(weighted([*rows, (row[i - depth : i], bit)], b"") / before)
    return total


def test_context_tree_matches_recursion(spark):
    train = [b"abab", b"abba"]
    docs = spark.createDataFrame([(1, "abab", False), (2, "abba", False), (3, "aba", True), (4, "", True), (5, "qé", True)], "doc_id bigint, text string, held boolean")
    for bounds in ((1 << 17, 1 << 21), (2, 3)):
        found = context_tree.score(docs, F.col("held"), depth=2, held_words=bounds[0], held_grams=bounds[1])
        for row in found.collect():
            text = {1: "abab", 2: "abba", 3: "aba", 4: "", 5: "qé"}[row["doc_id"]]
            assert abs(row["score"] - brute_ctw(train, text.encode(), 2)) < 1e-6


def test_context_tree_places():
    """Byte strings are found by hashing, colliding ones too; halving sorted keys cost most of the scoring."""
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 3000):
        keys = np.unique(np.concatenate([rng.integers(0, 2**47, n), np.arange(n)])).astype(np.int64)
        asked = rng.permutation(np.concatenate([keys, keys + 1, rng.integers(0, 2**47, 500)]))
        known = {k: i for i, k in enumerate(keys.tolist())}
        assert context_tree.Places(keys).find(asked).tolist() == [known.get(q, -1) for q in asked.tolist()]


def test_context_tree_base_and_hard_rows(hard_docs, no_docs):
    rows = hard_docs.collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 1 for r in rows}
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), ""]
    counts = Counter(w for r in rows if not held[r["doc_id"]] for w in tokens(r["text"]))
    total, distinct = sum(counts.values()), len(counts)
    texts = {r["doc_id"]: r["text"] for r in rows}
    found = context_tree.score(hard_docs, held_out("doc_id", 5, 1), held_words=4, held_grams=64).collect()
    assert len(found) == len(rows)
    for r in found:
        words = tokens(texts[r["doc_id"]])
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    assert context_tree.score(no_docs, held_out("doc_id", 5, 1)).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab"]
    lattice = segment_language.Lattice(pieces)
    chances = np.vstack([np.array([[0.1], [0.2], [0.15], [0.1], [0.25], [0.05], [0.15]]), [[segment_language.STRAY]], [[0.0]]])

    def brute(word):
        word, total = "▁" + word, 0.0
        for k in range(len(word)):
            for cuts in combinations(range(1, len(word)), k):
                parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)), strict=True)]
                p = 1.0
                for part in parts:
                    p *= chances[pieces.index(part), 0] if part in pieces else segment_language.STRAY if len(part) == 1 else 0.0
                total += p
        return math.log(total)

    words = ["a", "ab", "abba", "bab", "zab", "ababab"]
    assert np.allclose(segment_language.word_scores(lattice, chances, words)[:, 0], [brute(w) for w in words])
    # Long words are rescaled on the way.
    long = segment_language.word_scores(lattice, chances, ["ab" * 400])[0, 0]
    assert abs(long - 400 * (segment_language.word_scores(lattice, chances, ["ab" * 41])[0, 0] - segment_language.word_scores(lattice, chances, ["ab" * 40])[0, 0])) < 3


def test_language_held_out_accuracy(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    model = segment_language.fit(docs.where(~held_out("doc_id", 4, 2)), PIECES)
    found = segment_language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out("doc_id", 4, 2))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert segment_language.accept(docs, model).count() > 0.97 * docs.count()


def test_language_hard_rows(hard_docs, no_docs):
    model = segment_language.fit(hard_docs, PIECES)
    found = {r["doc_id"]: r for r in segment_language.identify(hard_docs, model).collect()}
    assert len(found) == len({r["doc_id"] for r in hard_docs.collect()})
    assert found[2]["lang_pred"] == found[3]["lang_pred"] == "und" and found[2]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert segment_language.fit(no_docs, PIECES) is None
    assert segment_language.identify(hard_docs, None).where("lang_pred <> 'und'").count() == 0
    assert segment_language.accept(no_docs, model).columns == hard_docs.columns


def test_words_are_letters_and_marks():
    assert segment_language.words_of("½ ² Ⅷ ① 12 _ हिन्दी Ünï_x1 e\u0301te \u0301 ªµ") == ["हिन्दी", "ünï", "x", "e\u0301te", "ªµ"]
    assert segment_language.words_of("½² 1") == []


def test_expected_uses_cover_words_of_every_length():
    """The uses of all pieces of a word, times their lengths, are its length; short words equal the sum over segmentations."""
    import pyarrow as pa

    pieces = ["▁", "▁a", "a", "ab", "aba", "b", "ba", "abababababababababab"]
    lattice = segment_language.Lattice(pieces)
    rng = np.random.default_rng(1)
    chances = segment_language._chances(rng.random((len(pieces) + 1, 1)))
    for word in ("ab", "abcab", "ab" * 100, "abx" * 400, "a" * 5000):
        step = segment_language._expect(lattice, chances, {"l": 0})
        (found,) = step([pa.RecordBatch.from_pydict({"lang": ["l"], "word": [word], "n": [3]})])
        uses = dict(zip(found["piece"].to_pylist(), found["uses"].to_pylist(), strict=True))
        size = sum(u * (len(pieces[p]) if p < len(pieces) else 1) for p, u in uses.items())
        assert math.isclose(size, 3 * (len(word) + 1), rel_tol=1e-6)
    expected, total = Counter(), 0.0
    for cuts in range(2 ** len("abab")):
        text, parts, at = "▁abab", [], 0
        for i in range(1, len(text) + 1):
            if i == len(text) or cuts >> (i - 1) & 1:
                parts.append(text[at:i])
                at = i
        if all(p in pieces for p in parts):
            chance = math.prod(chances[pieces.index(p), 0] for p in parts)
            total += chance
            for p in parts:
                expected[pieces.index(p)] += chance
    (found,) = segment_language._expect(lattice, chances, {"l": 0})([pa.RecordBatch.from_pydict({"lang": ["l"], "word": ["abab"], "n": [1]})])
    for p, u in zip(found["piece"].to_pylist(), found["uses"].to_pylist(), strict=True):
        assert math.isclose(u, expected[p] / total, rel_tol=1e-9)


def test_a_rare_language_is_learned(spark):
    rows = [(i, f"the weather is fine today in town number {i} and the people walk", "en") for i in range(10_000)]
    rows += [(10_000, "यह एक हिन्दी वाक्य है और इसमें कई शब्द हैं", "hi"), (10_001, "½ ② 7", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = segment_language.fit(docs, PIECES, documents=300)
    assert model.languages == ["en", "hi"]
    found = {r["doc_id"]: r["lang_pred"] for r in segment_language.identify(docs.where("doc_id > 9990"), model).collect()}
    assert found[10_000] == "hi" and found[10_001] == "und" and found[9_999] == "en"


def test_toxicity_held_out(spark):
    clean = ["the weather is fine today", "we walk to the park", "a good book about trees", "she reads to the child"]
    rows = []
    for i in range(600):
        text = clean[i % 4] + f" number {i} " + clean[(i * 7 + 1) % 4]
        toxic = int(i % 3 == 0)
        rows.append((i, text.replace(" the ", " the moron ", 1) + (" you idiot you scum" if toxic else "") if toxic else text, toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = boosted_toxicity.fit(docs.where("doc_id % 5 <> 0"))
    found = boosted_toxicity.score(docs, model).join(docs, "doc_id").where("doc_id % 5 = 0")
    assert found.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.95
    assert boosted_toxicity.accept(docs.drop("toxic"), model).count() in range(380, 421)


def test_toxicity_hard_rows(spark, hard_docs, no_docs):
    none = boosted_toxicity.fit(no_docs.withColumn("toxic", F.lit(1)))
    assert {tuple(r[1:]) for r in boosted_toxicity.score(hard_docs, none).collect()} == {(0.0, 0)}
    assert boosted_toxicity.accept(hard_docs, none).columns == hard_docs.columns
    walks = [" ".join(["walk", str(i), "in", "the", "park"] * (1 + i % 7)) for i in range(400)]
    rows = [(i, walk + (" you idiot you scum" if i % 3 == 0 else ""), int(i % 3 == 0)) for i, walk in enumerate(walks)]
    fitted = boosted_toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"))
    assert fitted.trees is not None
    names = ["_score", "_features", "_f_words", "_even", "_chances", "c0", "_text", "score"]
    clashing = hard_docs.select("*", *[F.lit(n).alias(n) for n in names])
    kept = boosted_toxicity.accept(clashing, fitted)
    scores = boosted_toxicity.score(clashing, fitted).collect()
    assert kept.columns == clashing.columns and kept.count() == sum(r["score"] < 0.5 for r in scores) > 0
    assert {tuple(r) for r in kept.select(*names).collect()} == {tuple(names)}
    assert len(scores) == hard_docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert boosted_toxicity.accept(no_docs, fitted).count() == 0
    values = boosted_toxicity.features("YOU id1ot!!! you idiot", {"idiot": 5.0})
    named = dict(zip(boosted_toxicity.FEATURES, values, strict=True))
    assert named["disguised"] > 0 and named["near_you"] > 0 and named["shouted"] > 0
    assert boosted_toxicity.features("", {}) == [0.0] * len(boosted_toxicity.FEATURES)


def test_bpe_matches_tiktoken(hard_docs, no_docs):
    import tiktoken

    with open(BYTES, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    peer = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in hard_docs.collect()}
    digests = duckdb_bpe.digests(hard_docs, BYTES, public_tokenizers.PATTERN).collect()
    assert len(digests) == hard_docs.count()
    for r in digests:
        ids = peer.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    encoded = duckdb_bpe.encode(hard_docs, BYTES, public_tokenizers.PATTERN)
    for r in duckdb_bpe.decode(encoded, BYTES).collect():
        assert r["decoded"].decode() == texts[r["doc_id"]]
    assert duckdb_bpe.digests(no_docs, BYTES, public_tokenizers.PATTERN).count() == 0


def test_notices(spark, hard_docs, no_docs):
    texts = [
        "Licensed under the Apache Licence, Version 2.0.", "All  Rights--Reserved. all rights reserved", "cc by cc by", "released under the mti license",
        "nothing of the kind", "GNU General Public License",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in notice_search.scan_notices(docs).collect()}
    assert found[0]["labels"] == "apache" and found[0]["n_base"] == 0 and found[0]["score"] < 1 and found[0]["spans"][0]["first_word"] == 0
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"], found[1]["base_labels"]) == (2, 0, 3, "reserved")
    assert (found[2]["n_base"], found[2]["last_word"]) == (2, 2)
    assert found[3]["labels"] == "mit" and found[3]["spans"][0]["edits"] in (1, 2)
    assert (found[4]["labels"], found[4]["score"], found[4]["first_word"]) == ("", 0.0, None)
    assert found[5]["base_labels"] == "gpl"
    hard = {r["doc_id"]: r for r in notice_search.scan_notices(hard_docs).collect()}
    assert hard[2]["n_words"] == hard[3]["n_words"] == 0 and hard[None]["base_labels"] == "reserved" and hard[4]["n_words"] == 30_000
    assert notice_search.scan_notices(no_docs).count() == 0


def test_notices_equal_a_plain_search(spark):
    """Base phrases by a plain walk over the words of random texts."""
    import random

    rng = random.Random(12)
    pool = ["cc", "by", "CC", "By", "general", "public", "license", "GENERAL", "all", "rights", "reserved", "Reserved", "x1", "é", "MIT", "licensed", "under", "the"]
    gaps = [" ", "  ", "-", ", ", "\n", "/", "_", ".", " _ "]
    texts = ["".join(rng.choice(pool) + rng.choice(gaps) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    found = {r["doc_id"]: r for r in notice_search.scan_notices(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(at, label) for phrase, label in phrases.items() for at in range(len(words)) if tuple(words[at : at + len(phrase)]) == phrase]
        r, starts, labels = found[i], [at for at, _ in places], sorted({label for _, label in places})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(labels)), text
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert set(labels) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_toxicity_features_equal_a_plain_count():
    import random

    rng, lexicon = random.Random(3), {"moron": 5.0, "scum": 2.5, "idiot": 4.0}
    pool = ["the", "You", "your", "MORON", "scum", "id1ot", "$cum", "idiot", "walk!!", "aaa", "42", "über", "ÄÖ"]
    named = lambda t: dict(zip(boosted_toxicity.FEATURES, boosted_toxicity.features(t, lexicon), strict=True))
    for _ in range(300):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))
        words = re.findall(r"[^\W\d_]+", text.lower())
        n, got = max(len(words), 1), named(text)
        hits = [i for i, w in enumerate(words) if w in lexicon]
        you = [i for i, w in enumerate(words) if w in ("you", "your")]
        assert math.isclose(got["words"], math.log(1 + n)) and math.isclose(got["lexicon"], sum(lexicon[words[i]] for i in hits) / n)
        assert math.isclose(got["near_you"], sum(any(abs(i - y) <= 5 for y in you) for i in hits) / n)
        assert math.isclose(got["you"], len(you) / n) and math.isclose(got["exclaims"], text.count("!") / len(text))
        assert math.isclose(got["capitals"], sum(c.isupper() for c in text) / len(text)) and math.isclose(got["digits"], sum(c.isdigit() for c in text) / len(text))
        disguised = sum({"id1ot": 4.0, "$cum": 2.5}.get(t, 0.0) for t in text.split())
        assert math.isclose(got["disguised"], disguised / n)


def test_every_edit_within_the_bound_is_found():
    search = notice_search.NoticeSearch({"x": ["released under the mit license"]})
    notice, edits = search.notices[0][1:]
    assert edits == 2
    for i in range(0, len(notice), 3):
        for j in range(i + 1, len(notice), 4):
            text = list(notice)
            text[i], text[j] = "q", ""
            assert search.spans(" some words " + "".join(text) + " more words ")
