"""Column functions on literals."""

import math

import pytest
from pyspark.sql import functions as F

from textpulse.functions import engagement, names, tokens, vectors, wiki
from textpulse.functions.stem import with_stem


def one(spark, value, column, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value,expected", [(0, 0), (1, 1), (-3, 1), (10, 2), (100, 3), (101, 4), (None, None)])
def test_count_class(spark, value, expected):
    assert one(spark, value, engagement.count_class("v"), "v int") == expected


@pytest.mark.parametrize("value,expected", [(0.0, 0), (0.01, 1), (0.1, 2), (0.5, 3), (0.51, 4), (None, None)])
def test_share_class(spark, value, expected):
    assert one(spark, value, engagement.share_class("v"), "v double") == expected


@pytest.mark.parametrize("value,expected", [(0, -1.0), (1, 0.0), (100, 2.0), (None, None)])
def test_log_count(spark, value, expected):
    assert one(spark, value, engagement.log_count("v"), "v int") == expected


def test_log_count_below_zero(spark):
    assert math.isnan(one(spark, -1, engagement.log_count("v"), "v int"))


KEYWORDS = [
    ("['Harbours', 'Quill, Oona B', 'Tarn, Ivo']", ["Harbours", "Quill, Oona B", "Tarn, Ivo"]),
    ("['Client''s', 'B']", ["Clients", "B"]),
    ("['A', \"it's\", 'B']", ["A, \"its\", B"]),
    ("[]", [""]),
    ("['A', '']", ["A", ""]),
    (None, None),
]


@pytest.mark.parametrize("text,expected", KEYWORDS)
def test_keywords(spark, text, expected):
    assert one(spark, text, names.parse_keywords("v")) == expected


BYLINES = [
    ("By OONA QUILL, IVO TARN and MAB ELDER", ["OONA QUILL", "IVO TARN", "MAB ELDER"]),
    ("By A, B, and C", ["A", "B", "", "C"]),
    ("A,,", ["A"]),
    ("A, ", ["A", ""]),
    ("", [""]),
    (",", []),
    ("Standby By A", ["Standby By A"]),
]


@pytest.mark.parametrize("text,expected", BYLINES)
def test_byline(spark, text, expected):
    assert one(spark, text, names.parse_byline("v")) == expected


def test_words_and_lemmas(spark):
    text = "Boats May Sail a Sea 250 Leagues. Yet Who Rows? It’s Windy. Über_x"
    assert one(spark, text, tokens.words("v"))[:4] == ["Boats", "May", "Sail", "a"]
    kept = one(spark, text, tokens.keep_lemmas(tokens.words("v"), ["boats", "yet", "May"]))
    # Stop words are compared before lower-casing: "Boats" and "Yet" stay, "May" goes.
    assert kept == ["boats", "sail", "sea", "250", "leagues", "yet", "who", "rows", "windy", "über_x"]
    letters = one(spark, text, tokens.keep_lemmas(tokens.words("v"), None, letters_only=True))
    assert "250" not in letters and "über_x" not in letters and "windy" in letters


@pytest.mark.parametrize("text,expected", [("abc", True), ("", True), ("é", True), ("a1", False), ("a b", False)])
def test_only_letters(spark, text, expected):
    assert one(spark, text, tokens.only_letters("v")) is expected


def test_sentences(spark):
    text = "Mab sails to Ness-Port, she knows the way. Yet Ivo stays... !\n"
    assert one(spark, text, F.size(tokens.sentences("v"))) == 2


@pytest.mark.parametrize(
    "listed,expected",
    [
        (["b", "a", "b"], [("a", 1), ("b", 2)]),
        (["x"], [("x", 1)]),
        (["c", "c", "c"], [("c", 3)]),
        ([], []),
    ],
)
def test_term_runs(spark, listed, expected):
    df = spark.createDataFrame([(listed,)], "v array<string>").withColumn("s", F.sort_array("v"))
    assert [tuple(r) for r in df.select(tokens.term_runs("s").alias("x")).first()["x"]] == expected


STEMS = {
    "caresses": "caress", "flies": "fli", "dies": "die", "ponies": "poni", "ties": "tie", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "died": "die", "cried": "cri", "plastered": "plaster", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
    "sky": "sky", "enjoy": "enjoy", "by": "by", "relational": "relat", "conditional": "condit", "rational": "ration",
    "valenci": "valenc", "digitizer": "digit", "radically": "radic", "differently": "differ", "vileli": "vile",
    "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
    "airliner": "airlin", "adjustable": "adjust", "defensible": "defens", "replacement": "replac",
    "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "geology": "geolog", "dying": "die",
    "News": "news", "succeed": "succeed", "ab": "ab", "multiplying": "multipli",
}


def test_stems(spark):
    df = with_stem(spark.createDataFrame([(w,) for w in STEMS], "w string"), "w", "s")
    assert {r["w"]: r["s"] for r in df.collect()} == STEMS


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    row = df.select(
        vectors.unit("a").alias("u"), vectors.unit("z").alias("uz"), vectors.cosine("a", "a").alias("c"),
        vectors.cosine("a", "z").alias("cz"), vectors.add("a", "a").alias("s"), vectors.scale(0.5, "a").alias("h"),
        vectors.squared_distance("a", "z").alias("d"),
    ).first()
    assert row["u"] == [0.6, 0.8] and row["uz"] == [None, None] and row["c"] == 1.0 and row["cz"] is None
    assert row["s"] == [6.0, 8.0] and row["h"] == [1.5, 2.0] and row["d"] == 25.0


# --- wiki ----------------------------------------------------------------------------------------


def page(text=None, title="T", ns="<ns>0</ns>"):
    body = "" if text is None else f'<text xml:space="preserve">{text}</text>'
    return f"<page><title>{title}</title>{ns}<id>12</id><revision><id>99</id>{body}</revision></page>"


PAGES = [
    (page("plain"), {"is_article": True, "is_redirect": False, "is_empty": False, "page_id": "12", "markup": "plain"}),
    (page("#REDIRECT [[A]]"), {"is_redirect": True}),
    (page("#redirect [[A]]"), {"is_redirect": True}),
    (page("#Redirect [[A]]"), {"is_redirect": False}),
    (page(" #REDIRECT [[A]]"), {"is_redirect": False}),
    (page("x {{Disambig}}"), {"is_disambiguation": True}),
    (page("x {{disambiguation page}}"), {"is_disambiguation": False}),
    (page("x", ns="<ns>4</ns>"), {"is_article": False}),
    (page("x", ns=""), {"is_article": True}),
    (page("{{bio-stub}}"), {"is_stub": True}),
    (page("x", title="stub}}"), {"is_stub": False}),
    (page("x", title="Wikipedia:Stub"), {"is_stub": True}),
    (page("x", title="A &amp; B"), {"title": "A & B"}),
    (page(None), {"is_empty": True, "is_redirect": False, "markup": None}),
]


@pytest.mark.parametrize("xml,expected", PAGES)
def test_page_fields(spark, xml, expected):
    df = spark.createDataFrame([(xml,)], "xml string")
    row = df.select(*[c.alias(n) for n, c in wiki.page_fields("xml").items()]).first()
    assert {k: row[k] for k in expected} == expected


def test_links(spark):
    found = one(spark, "[[X|y]] [[File:q]] [[Z#s]] [[#t]] [[]] [[A|b|c]] [[M#n|o]] [[un\nder]] [[open", wiki.links("v"))
    assert [(r["anchor"], r["target"]) for r in found] == [
        ("y", "X"), ("Z", "Z"), ("b|c", "A"), ("o", "M"), ("un\nder", "un\nder"),
    ]


@pytest.mark.parametrize(
    "text,expected", [("a [[de:Haus]] [[de:Dorf]]", "Haus"), ("[[de:Ha\nus]]", None), ("[[de:]]", None), ("[[fr:x]]", None)]
)
def test_language_link(spark, text, expected):
    assert one(spark, text, wiki.language_link("v", "de")) == expected


def test_plain_text(spark):
    markup = (
        "'''Bold''' [[a|b]] [[c]] [[de:Haus]] {{box}} &lt;ref&gt;r&lt;/ref&gt;&lt;!-- http://q --&gt;http://x.y/z "
        "&amp;amp; &lt;b&gt;t&lt;/b&gt;\n== Head ==\n* item"
    )
    df = spark.createDataFrame([("T", markup)], "t string, m string")
    text = df.select(wiki.plain_text("t", "m").alias("x")).first()["x"]
    assert text.split("\n")[0] == "T"
    assert text.split() == ["T", "Bold", "b", "c", "&", "t", "Head", "item"]
    assert one(spark, " a \n\n\t\nb", wiki.paragraphs("v")) == ["a", "b"]
