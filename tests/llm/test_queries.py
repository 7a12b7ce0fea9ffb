"""Queries against their SQL twins, and every operator on odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.check import compare, connect
from tidemark.llm import (
    chat,
    convnet,
    decontaminate,
    jaccard,
    langid,
    linededup,
    packing,
    quality,
    ranked,
    secrets,
    tokencount,
    urlfilter,
)
from tidemark.llm.queries import QUERIES, SQL, tokenizer_file

BPE, UNIGRAM = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that the operators use themselves
        *[T.StructField(n, T.StringType()) for n in ("id", "key", "body", "row", "node", "kept", "words", "frequent")],
    ]
)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), SQL[name]) is None


def odd_rows():
    rest = ["x"] * 8
    long = " ".join(f"w{i % 977}" for i in range(40_000)) + "\n" + "a" * 100_000
    rows = [
        (1, None, None, None),
        (2, "", "en", "s"),
        (3, " \n\t\n ", "en", "s"),
        (None, "no id here at all\nsecond line\nthird line", None, "s"),
        (4, "same text twice\nsecond line of it\nthird line of it", "en", None),
        (4, "same text twice\nsecond line of it\nthird line of it", "en", None),
        (5, "same text twice\nsecond line of it\nthird line of it", "de", "t"),
        (6, long, "en", "s"),
        (7, "☃ é 日本 \U0001f600 'tis password = 'hunter22'", "fr", "s"),
    ]
    return [(*r, *rest) for r in rows]


OPERATORS = {
    "languages": lambda d, b: langid.predict_languages(
        d, langid.fit_languages(d, langid.LanguageRule(steps=2, batch=8)), langid.LanguageRule()
    ),
    "judge": lambda d, b: quality.judge(d),
    "clean": lambda d, b: quality.clean(d),
    "secrets": lambda d, b: secrets.scan_secrets(d),
    "pack": lambda d, b: packing.pack(d, BPE),
    "lines": lambda d, b: linededup.dedup_lines(d),
    "jaccard": lambda d, b: jaccard.jaccard_join(d),
    "one of each": lambda d, b: jaccard.one_of_each(d),
    "tokens": lambda d, b: tokencount.count_tokens(d, UNIGRAM),
    "leaks": lambda d, b: decontaminate.leaks(d, b),
    "decontaminate": lambda d, b: decontaminate.decontaminate(d, b),
    "search": lambda d, b: ranked.search_documents(d, b),
    "quality": lambda d, b: convnet.score_quality(
        d,
        convnet.fit_quality(
            d, d.selectExpr("doc_id", "int(doc_id > 4) as quality"), convnet.QualityRule(steps=2, batch=8)
        ),
    ),
}


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    docs = spark.createDataFrame([], DOCS)
    assert OPERATORS[name](docs, bench(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    items = bench(spark, [(1, None), (2, ""), (None, " ".join(f"w{i}" for i in range(100, 140)))])
    out = OPERATORS[name](docs, items)
    rows = out.collect()
    ids = sorted(str(r.doc_id) for r in rows)
    every = sorted(str(r[0]) for r in odd_rows())
    if name in ("languages", "judge", "secrets", "lines", "jaccard", "tokens", "quality"):
        assert ids == every
    if name in ("clean", "lines", "one of each", "decontaminate"):
        assert out.columns == docs.columns
    if name == "search":
        assert [(r.item_id, r["rank"], r.doc_id) for r in rows] == [(None, 1, 6)]
    if name == "quality":
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "one of each":
        assert ids == sorted(["1", "2", "3", "4", "6", "7", "None"])
    if name == "jaccard":
        found = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
        assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 7, 4)} <= found
    if name == "pack":
        assert {(r.doc_id, r.doc_tokens) for r in rows if r.doc_id in (1, 2)} == {(1, 1), (2, 1)}
    if name == "languages":
        assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    if name == "leaks":
        assert {r.doc_id for r in rows} == {6} and {r.item_id for r in rows} == {None}
    if name == "decontaminate":
        assert "6" not in ids and len(ids) == len(every) - 1
    if name == "lines":
        text = {(r.doc_id, r.text) for r in rows}
        assert (5, "") in text and (4, odd_rows()[4][1]) in text and (1, None) in text


def test_odd_urls(spark):
    pages = spark.createDataFrame(
        [
            (1, None),
            (2, ""),
            (3, "no scheme/at/all"),
            (4, "http://A.EXAMPLE.org/es/x?q=1"),
            (5, "http://example.org?q=://"),
            (6, "http://fakeexample.org/es/"),
            (7, "https://x.com/de/1#z"),
            (None, "https://com/fr/"),
            (7, "https://x.com/de/1#z"),
            (8, "http://spammy.net/" + "a" * 50_000),
        ],
        "page_id long, url string",
    )
    got = sorted((str(r.page_id), r.host, r.path[:9], r.rule, r.verdict) for r in urlfilter.judge_urls(pages).collect())
    assert got == sorted(
        [
            ("1", "", "", None, "allow"),
            ("2", "", "", None, "allow"),
            ("3", "", "", None, "allow"),
            ("4", "a.example.org", "/es/x", "example.org/es/", "block"),
            ("5", "example.org", "", None, "allow"),
            ("6", "fakeexample.org", "/es/", "org/", "allow"),
            ("7", "x.com", "/de/1", "com/de/", "block"),
            ("7", "x.com", "/de/1", "com/de/", "block"),
            ("8", "spammy.net", "/aaaaaaaa", None, "block"),
            ("None", "com", "/fr/", "com/fr/", "allow"),
        ]
    )
    assert urlfilter.judge_urls(pages.limit(0)).collect() == []


def test_odd_chats(spark):
    turns = spark.createDataFrame(
        [
            (1, 0, "user", None),
            (1, 1, "assistant", "</s>\\ <s> [INST] \\\\[/ROLE]"),
            (2, 1, "assistant", "first"),
            (2, 0, "user", "said"),
            (2, 1, "assistant", "first"),
            (3, None, None, "x"),
            (4, 0, "to[/ROLE]ol", "[/TURN]"),
            (None, 5, "user", "lost"),
            (None, 5, "user", "lost"),
        ],
        "conv_id long, turn long, role string, text string",
    )
    out = chat.format_chats(turns).withColumn("read", chat.parse_turns(F.col("formatted")))
    rows = sorted(out.collect(), key=lambda r: str(r.conv_id))
    read = [[(t.role, t.text) for t in r.read] for r in rows]
    assert read == [
        [("user", ""), ("assistant", "</s>\\ <s> [INST] \\\\[/ROLE]")],
        [("user", "said"), ("assistant", "first"), ("assistant", "first")],
        [("", "x")],
        [("to[/ROLE]ol", "[/TURN]")],
        [("user", "lost")],
        [("user", "lost")],
    ]
    assert [(r.valid, r.bad_turn) for r in rows] == [(True, None), (False, 2), (False, 0), (False, 0), (False, 1), (False, 1)]
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_templated_host(spark):
    """Pages that share only a block are depleted documents; exact copies do not deplete themselves."""
    rng = random.Random(3)
    word = lambda low, high: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(low, high)))
    block = "\n".join(" ".join(word(4, 14 if k < 9 else 6) for _ in range(10)) for k in range(10))
    number = lambda k: " ".join(str(rng.randrange(10**6)) for _ in range(k))
    short = lambda k: " ".join(word(3, 6) for _ in range(k))
    rows = [(i, f"{block}\n{number(150)}", "numbers") for i in range(60)]
    rows += [(i, f"{short(15)}\n{block}\n{number(30)}", "short") for i in range(100, 160)]
    page = "\n".join(" ".join(word(4, 14) for _ in range(10)) for _ in range(20))
    rows += [(i, page, "copies") for i in range(200, 260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert [i for i in found if i < 200 and found[i].kept] == []
    assert [i for i in found if 200 <= i and (not found[i].kept or found[i].removed_chars)] == []
    left = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert set(left) == set(range(200, 260)) and left[200] == page


def test_line_limit_at_any_host_size(spark):
    """A line goes from the same number of texts on, on a small host and on a large one."""
    block = " ".join(f"menu{chr(97 + k)}" for k in range(22))
    own = lambda i: " ".join(f"own{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{chr(97 + k)}" for k in range(25))
    rows = [(i, f"{block}\n{own(i)}", "small") for i in range(25)]
    rows += [(1000 + i, f"{block}\n{own(i)}" if i < 25 else own(i), "large") for i in range(12_600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hit = {r.doc_id for r in quality.judge(docs).filter("removed_chars > 0").collect()}
    assert hit == set(range(25)) | set(range(1000, 1025))


def test_seam_is_no_text(spark):
    pages = spark.createDataFrame(
        [(1, "http://evil.com/a.org\x01/b", "x"), (2, "http://evil.net/x.example.org\x01/es/", "y"), (3, "http://a.com/de/\x01", "z")],
        "page_id long, url string, rule string",
    )
    assert {r.page_id: r.rule for r in urlfilter.judge_urls(pages).collect()} == {1: None, 2: None, 3: "com/de/"}


def test_one_mark_is_one_character():
    automaton = urlfilter.ShiftAnd(["a?c", "*?", "?"])
    texts = [x.encode() for x in ("a\u00e9c", "ac", "\u65e5", "", "\u00e9\u00e9")]
    hit = automaton.matches(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert hit.tolist() == [
        [True, True, False], [False, True, False], [False, True, True], [False, False, False], [False, True, False]
    ]


def test_texts_that_share_an_id(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"), (2, "alpha beta gamma delta epsilon zeta"),
            (2, "only here is this text found"), (2, "only here is this text found"), (3, "few"), (None, "few")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(map(str, (tuple(r) for r in jaccard.one_of_each(docs).collect())))
    assert left == sorted(map(str, [rows[0], rows[1], rows[3], rows[5], rows[6]]))
    tiny = docs.filter("text = 'few'").coalesce(1)
    assert {r.n_shingles for r in jaccard.jaccard_join(tiny).collect()} == {1}


def test_short_items(spark):
    docs = spark.createDataFrame(
        [(1, "so: What is the capital of France? Paris."), (2, "the capital of france is not paris"), (3, "paris")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, "what is the capital of france paris"), (2, "Paris")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.n_words) for r in decontaminate.leaks(docs, items).collect()] == [(1, 1, 7)]
    small = decontaminate.SeedRule(block_bytes=20)
    assert [r.doc_id for r in decontaminate.leaks(docs, items, small).collect()] == [1]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items, small).collect()) == [2, 3]


def test_many_secrets_in_one_text(spark):
    lines = [f"token = {'a' * (6 + i % 5)}{i}" for i in range(3000)]
    found = secrets.scan_secrets(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first()
    at = 0
    for line, span in zip(lines, found.base):
        assert (span.start, span.stop) == (at, at + len(line))
        at += len(line) + 1
    assert found.n_assign == 3000
