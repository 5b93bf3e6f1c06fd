import pytest
from pyspark.sql import functions as F

from siftwell.functions import masks as M
from siftwell.functions import text as T
from siftwell.functions.style import STYLE_COLUMNS, add_style, gate_by_script
from siftwell.operators.censor import censor, extract_variables, glyph_inventory, mask_listed_names

CASES = {
    "see http://x.example/ab": "see  LINK19ENDVAR",
    "x:https://a.com/q www.abc": "x: LINK15ENDVAR    LINK7ENDVAR",
    "1800-123-456": "PHONENUMBER1ENDVAR",
    "*1234": "PHONENUMBER2ENDVAR",
    "03-1234567": "PHONENUMBER3ENDVAR",
    "(052-1234567),": "( PHONENUMBER4ENDVAR  ),",
    "+972521234567": "PHONENUMBER5ENDVAR",
    "@972521234567": "PHONENUMBER@ENDVAR",
    "id 1234 stays": "id 1234 stays",
    "me@x.example": "EMAILENDVAR",
    "me@shop.co.il": "EMAILENDVAR",
    "go to shop.co.il now": "go to  LINK10ENDVAR   now",
    "a😀b": "a EMOJI😀ENDVAR b",
    "l1\r\nl2\n\nl3\n": "l1 ENTERNEWLINEENDVAR  l2 ENTERNEWLINEENDVAR   ENTERNEWLINEENDVAR  l3",
    "plain   text": "plain   text",
}


@pytest.fixture(scope="module")
def censored(spark):
    rows = [(i, t) for i, t in enumerate(CASES)]
    return censor(spark.createDataFrame(rows, "msg_id bigint, text string"))


def test_censor_cases(censored):
    got = [r.text for r in censored.orderBy("msg_id").collect()]
    assert got == list(CASES.values())


def test_censor_is_idempotent(censored):
    again = censor(censored.withColumn("before", F.col("text")))
    assert again.where("text <> before").count() == 0


def test_extraction(censored):
    rows = {(r.msg_id, r.kind, r.payload, r.pos) for r in extract_variables(censored).collect()}
    assert {(0, "LINK", "19", 1), (1, "LINK", "15", 1), (7, "PHONENUMBER", "@", 0), (12, "EMOJI", "😀", 1)} <= rows


def test_names_are_replaced_alike(frame):
    df = frame([(0, "שלום גיל, וגיל גילה"), (1, "גיל!")], "msg_id bigint, text string")
    out = [r.text for r in df.select(M.mask_names(F.col("text"), ["גיל"], ["נעם"]).alias("text")).collect()]
    assert out == ["שלום נעם, ונעם גילה", "נעם!"]


def test_names_from_a_table(frame):
    """Equal to the names as settings, also for repeated texts, nulls, markers, and names that are not in use."""
    texts = ["שלום גיל, וגיל גילה", "גיל!", "גיל!", None, "", "nobody here", "ודן דן  ודן\nגיל", "LINK5ENDVAR דן"]
    df = frame([(None if i == 1 else i, t, "k") for i, t in enumerate(texts)], "msg_id bigint, text string, _key string")
    listed = ["גיל", "דן", "ודן"]
    names = frame([(n,) for n in [*listed, None, "", "דן", *(f"שם{i}" for i in range(3000))]], "name string")
    want = [r.text for r in df.select(M.mask_names(F.col("text"), listed, ["נעם", "טל"]).alias("text")).collect()]
    got = mask_listed_names(df, names, ["נעם", "טל"]).select("text").collect()
    assert sorted(map(str, want)) == sorted(str(r.text) for r in got) and "גיל!" not in want
    both = [censor(df.drop("_key"), names=n, pool=["נעם"]).select("text").collect() for n in (names, listed)]
    assert sorted(map(str, both[0])) == sorted(map(str, both[1]))
    assert mask_listed_names(df.limit(0), names).count() == 0 and mask_listed_names(df, names.limit(0)).count() == len(texts)


def test_scalars(frame):
    df = frame([("a ,  שלום!\tעולם ב",)], "text string")
    row = df.select(
        T.script_only(F.col("text")).alias("only"), T.signs(F.col("text")).alias("signs"),
        T.is_ascii(F.col("text")).alias("ascii"), T.has_script(F.col("text")).alias("hebrew"),
    ).first()
    assert (row.only, row.signs, row.ascii, row.hebrew) == ("שלוםעולם ב", ",!", False, True)


def test_mean_positive(frame):
    df = frame([(1, 0.0), (1, 2.0), (1, 4.0), (2, 0.0)], "g int, x double")
    assert {r.g: r.m for r in df.groupBy("g").agg(T.mean_positive(F.col("x")).alias("m")).collect()} == {1: 3.0, 2: 0.0}


def test_blank_lines(frame):
    df = frame([("a\r\n\r\n\r\nb\n\nc\nd",)], "text string")
    assert df.select(T.squeeze_blank_lines(F.col("text"))).first()[0] == "a\r\n\r\nb\nc\nd"


def test_style(frame):
    text = "נושא MAILSUBJECTENDVAR  שלום, Dan 12! ENTERNEWLINEENDVAR  ENTERNEWLINEENDVAR  LINK20ENDVAR PHONENUMBER3ENDVAR EMOJI😀ENDVAR"
    row = add_style(frame([(1, text)], "msg_id bigint, text string")).first()
    assert row.n_words == 4 + 1 + 1
    assert row.n_letters == 4 + 5 + 3 + 3 + 1
    assert (row.n_links, row.link_length, row.phone_3, row.n_emoji) == (1, 20.0, 1, 1)
    assert row.link_place == pytest.approx(7 / 10)
    assert (row.longest_word, row.n_signs, row.n_punctuation, row.n_digits) == (5, 2, 2, 2)
    assert row.script_share == pytest.approx(8 / 11)
    assert row.script_ratio == pytest.approx(8 / 3)
    assert row.n_sentences == 2  # the second break follows a break


def test_no_script_is_a_zero_vector(frame):
    styled = add_style(frame([(1, "hello 123")], "msg_id bigint, text string"))
    assert not any(gate_by_script(styled, STYLE_COLUMNS).select(*STYLE_COLUMNS).first())


def test_glyph_inventory(frame):
    out = glyph_inventory(frame([("😀a😀©",)], "text string"))
    assert {r.glyph: r.n for r in out.collect()} == {"😀": 2, "©": 1}
