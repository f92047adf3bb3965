import re
import unicodedata

import brute
import pytest
from pyspark.sql import functions as F

from millrace import operators as ops
from millrace.functions.regex import NotInJava, to_java_pattern, to_java_replacement
from millrace.functions.text import DIGIT_BODY, JAVA_SPACE_BODY, SPACE_CHARS, WORD_BODY, is_blank
from millrace.queries.text import t14_unit

SAMPLES = [
    "  HÉLLO WORLD  ",
    "",
    None,
    "   ",
    "\x85a\xa0b\x1cc d　",
    "école ﬁn Ａ１ 각 ß İ ΟΔΟΣ",
    "tab\tline\nnext\r\nlast",
    "price $5, x1 y22;z333!  Really?No.",
    "<p class='x'>a &amp; b</p> <> &é; <unclosed",
    "snake_case ²½ ‿ x́y",
]


def test_operators_in_a_row(texts, column):
    rows = texts([" \tÇa\u00a0va? ", "STRASSE straße", None, "e\u0301te\u0301"])
    assert column(ops.lowercase(rows, "t"), "t") == [" \tça\u00a0va? ", "strasse straße", None, "e\u0301te\u0301"]
    bare = ops.strip_whitespace(rows, "t")
    assert column(bare, "t")[0] == "Ça\u00a0va?"
    assert column(ops.unicode_normalize(bare, "t", "NFC"), "t")[3] == "été"
    assert column(ops.regex_replace(bare, "t", r"[aeiou]", "-"), "t")[1] == "STRASSE str-ß-"


def test_case_and_space_follow_python(texts, column):
    df = texts(SAMPLES)
    for operator, rule in (
        (ops.lowercase, str.lower),
        (ops.uppercase, str.upper),
        (ops.strip_whitespace, str.strip),
        (lambda d, c: ops.strip_whitespace(d, c, collapse=True), lambda s: re.sub(r"\s+", " ", s.strip())),
        (ops.strip_html, lambda s: re.sub(r"&\w+;", "", re.sub(r"<[^>]+>", "", s))),
        (ops.strip_tags, lambda s: re.sub(r"<[^>]*>", "", s)),
        (ops.normalize, lambda s: re.sub(r"\s+", " ", s.lower().strip())),
    ):
        assert column(operator(df, "t"), "t") == [None if s is None else rule(s) for s in SAMPLES]


def test_classes_equal_pythons_for_every_character(spark):
    points = spark.range(0x110000).where("id < 55296 or id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    for body, pattern in ((JAVA_SPACE_BODY, r"\s"), (WORD_BODY, r"\w"), (DIGIT_BODY, r"\d")):
        known = points.where(~F.col("c").rlike(r"\p{Cn}"))  # The JVM's Unicode table may be older than Python's.
        java = {r.id for r in points.where(F.col("c").rlike(f"(?U)[{body}]")).select("id").collect()}
        python = {i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF and re.match(pattern, chr(i))}
        assert java <= python
        missing = spark.createDataFrame([(i,) for i in python - java], "id bigint")
        assert known.join(missing, "id").isEmpty()
    assert {ord(c) for c in SPACE_CHARS} == {i for i in range(0x110000) if chr(i).isspace()}


def test_unicode_forms(texts, column):
    df = texts(SAMPLES)
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        expected = [None if s is None else unicodedata.normalize(form, s) for s in SAMPLES]
        assert column(ops.unicode_normalize(df, "t", form), "t") == expected
    with pytest.raises(ValueError):
        ops.unicode_normalize(df, "t", "NFX")


PATTERNS = [
    (r"\s+", " "),
    (r"\s*([.,?!])\s*", r"\1 "),
    (r"\b\w", "*"),
    (r"\B\w", "-"),
    (r"(?P<n>\d+)", r"<\g<n>>"),
    (r"(\w)(\d)", r"\2\g<1>0$"),
    (r"[^\w\s]", ""),
    (r"(?i)real", "R"),
    (r"x*", "-"),
    (r"[[a-c]]?", "q"),
    (r"l{,2}e", "E"),
    (r"^.|.$", "#"),
    (r"(?m)^.", "#"),
    (r"(?s)t.*z?", "|"),
    (r"\D+\Z", "z"),
    (r"(?P<a_b>o)", r"\g<a_b>!"),
    (r"[^\S\n]+", "_"),
    (r"(a)?(?(1)b|c)", "k"),
]


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_regex_replace_follows_python(texts, column):
    df = texts(SAMPLES)
    for pattern, replacement in PATTERNS:
        expected = [None if s is None else re.sub(pattern, replacement, s) for s in SAMPLES]
        assert column(ops.regex_replace(df, "t", pattern, replacement), "t") == expected, pattern
        assert column(ops.regex_replace(df, "t", pattern, replacement, engine="python"), "t") == expected


def test_regex_that_java_cannot_express():
    for pattern in (r"[^\S\n]", r"(a)?(?(1)b|c)", r"(?x)a b", r"(?P<a_b>x)"):
        with pytest.raises(NotInJava):
            to_java_pattern(pattern)
    with pytest.raises(re.error):
        to_java_pattern("(")
    with pytest.raises(ValueError):
        to_java_replacement("a", r"\1")


def test_tokens(texts, column):
    df = texts(SAMPLES)
    assert column(ops.tokenize(df, "t"), "t_tokens") == [None if s is None else s.split() for s in SAMPLES]
    expected = [None if s is None else [p.strip() for p in re.split(r"[.!?]+", s) if p.strip()] for s in SAMPLES]
    assert column(ops.tokenize(df, "t", "sentence"), "t_tokens") == expected


def test_chunks(texts):
    values = [None, "", "  "] + [" ".join(f"w{i}" for i in range(n)) for n in (1, 4, 5, 6, 9, 10, 11, 23)]
    df = texts(values)
    for size, overlap in ((5, 2), (5, 0), (5, 4), (5, 5), (3, 9), (1, 0), (500, 50)):
        rows = ops.chunk_text(df, "t", size, overlap).orderBy("id", "chunk_index").collect()
        for i, text in enumerate(values):
            own = [r for r in rows if r.id == i]
            assert [r.chunk_text for r in own] == brute.chunks(text, size, overlap), (size, overlap, text)
            assert [r.chunk_index for r in own] == list(range(len(own)))
            assert all(r.source_row_id == i and r.t == text for r in own)
    assert "t" not in ops.chunk_text(df, "t", keep_text=False).columns
    named = {(r.id, r.source_row_id) for r in ops.chunk_text(df, "t", 3, 1, id_column=None).collect()}
    assert len(named) == len({i for i, _ in named}) == len({d for _, d in named}) and all(len(d) == 64 for _, d in named)


def test_language(texts, column):
    df = texts(["The end", "nada", None, "x\xa0YOU", "their"])
    assert column(ops.detect_lang(df, "t"), "lang") == ["en", "other", None, "en", "other"]
    assert column(ops.language_filter(df, "t", "en"), "id") == [0, 3]
    assert column(ops.language_filter(df, "t", "fr"), "id") == [1, 4]


def test_sentiment_and_vectors(spark, texts, column):
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -3.0)], "word string, weight double")
    df = texts(["Good good", "bad", "none", None])
    scores = column(ops.sentiment(df, "t", lexicon, "id"), "sentiment")
    assert scores == pytest.approx([4 / 31**0.5, -3 / 24**0.5, 0, 0])
    vectors = column(ops.embed_text(df, "t", 16), "embedding")
    assert [len(v) for v in vectors] == [16] * 4
    assert [round(sum(x * x for x in v), 5) for v in vectors] == [1, 1, 1, 0]
    custom = F.pandas_udf(lambda s: s.map(lambda t: [1.0]), "array<float>")
    assert column(ops.embed_text(df, "t", encoder=custom), "embedding") == [[1.0]] * 4


def test_blank_and_hash(texts, column):
    df = texts(SAMPLES)
    assert column(df.select("id", is_blank(F.col("t")).alias("b")), "b") == [s is None or not s.strip() for s in SAMPLES]
    assert len(column(ops.hash_key(df, "t"), "hash_key")[0]) == 64
    assert len(column(ops.hash_key(df, "t", "xxhash64"), "hash_key")[0]) == 16


def test_missing_columns(texts):
    with pytest.raises(TypeError):
        ops.lowercase("not a frame", "a")
    with pytest.raises(ValueError, match="No such column: 'nope'"):
        ops.lowercase(texts(["a"]), "nope")
    with pytest.raises(ValueError, match="No such column: 'x', 'y'"):
        ops.select_columns(texts(["a"]), ["x", "y"])


def test_unit_vectors_are_measured_once(spark, tmp_path):
    """The length of a vector is a column before its components become rows."""
    rows = [(1, "a b a"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = t14_unit(spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("aggregate(")
    assert sorted(abs(r.value) for r in made.collect()) == [1, 2]
