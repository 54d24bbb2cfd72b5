"""Column-name rules, numbers and text expressions."""

import pytest
from pyspark.sql import functions as F

from sedge.functions import columns, numbers, text


def test_exact_name_beats_unit_name():
    assert columns.match_columns(["Temperature (°C)", "temp"], ["temperature", "temp"]) == ["temp", "Temperature (°C)"]
    assert columns.pick_column(["Stiring", "y_pred"], ["stirring", "Stiring"]) == "Stiring"
    assert columns.pick_column(["x"], ["absent"]) is None


def test_one_letter_candidates_match_only_exactly():
    assert columns.match_columns(["T (K)"], ["t", "T"]) == []
    assert columns.match_columns(["T"], ["t", "T"]) == ["T"]


def test_plain_name_strips_unit_and_case():
    assert columns.plain_name("Temperature (°C)") == "temperature"
    assert columns.plain_name(" Pressure (bar) ") == "pressure"
    assert columns.plain_name("time_s") == "time_s"


def test_roles_split_off_the_clock():
    found = columns.resolve_roles(["Time (min)", "Temperature (°C)", "Stiring", "Pressure (bar)"],
                                  ["time", "temperature", "stirring"], "pressure")
    assert found == (["Temperature (°C)", "Stiring"], "Pressure (bar)", "Time (min)")
    assert columns.resolve_roles(["time_s", "y"], ["time"], "y") == (["time_s"], "y", None)
    both = ["Time", "time_s", "y"]
    assert columns.resolve_roles(both, ["Time", "time_s"], "y") == (["time_s"], "y", None)
    assert columns.resolve_roles(both, ["time_s", "Time"], "y") == (["time_s"], "y", "Time")
    with pytest.raises(ValueError):
        columns.resolve_roles(["a"], ["humidity"], "a")


def test_scenario_variables():
    assert columns.scenario_variables(["time_s", "Temperature (°C)", "Stiring"]) == ["time_s", "Temperature (°C)", "Stiring"]
    assert columns.scenario_variables(["unrelated"]) == []


def test_header_slug():
    assert columns.header_slug(" Extra Col #1 ") == "extra_col_1"
    assert columns.header_slug("éé") == "unnamed"


@pytest.mark.parametrize(
    "raw, number",
    [("10,5", 10.5), (" 7 ", 7.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("1d", None), ("1f", None),
     ("1.234,5", None), ("0x10", None), ("", None), (None, None), ("-2,5e-1", -0.25), ("nan", None)],
)
def test_to_number(spark, raw, number):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(numbers.to_number("x")).first()[0] == number


@pytest.mark.parametrize(
    "raw, seconds",
    [("00:00:15", 15.0), ("25:00:00", 90000.0), ("-00:00:05", -5.0), ("0:01:02.5", 62.5), ("12:34", None), ("900", None), ("x", None)],
)
def test_clock_seconds(spark, raw, seconds):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(numbers.clock_seconds("x")).first()[0] == seconds


def test_clock_minute_form(spark):
    df = spark.createDataFrame([("12:34",), ("01:00:00",), ("-1:30",)], "x string")
    assert [r[0] for r in df.select(numbers.clock_seconds("x", True)).collect()] == [754.0, 3600.0, -90.0]


def test_title_key_keeps_accents(spark):
    df = spark.createDataFrame([("  L'Économie — circulaire!",), ("a_b-c²",), ("!!!",)], "x string")
    assert [r[0] for r in df.select(text.title_key("x")).collect()] == ["l économie circulaire", "a_b c²", ""]


def test_split_codes(spark):
    df = spark.createDataFrame([("cost; policy ;\t Data\n; ",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(text.split_codes("x")).collect()] == [["cost", "policy", "data"], [], []]


def test_without_markup(spark):
    df = spark.createDataFrame([("<b>Circular</b>   solutions <br/>\n",), (None,)], "x string")
    assert [r[0] for r in df.select(text.without_markup("x")).collect()] == ["Circular solutions", ""]


def test_paper_text(spark):
    df = spark.createDataFrame([("T", "A"), ("Only title", None)], "t string, a string")
    assert [r[0] for r in df.select(text.paper_text("t", "a")).collect()] == ["T. A", "Only title."]
    assert df.select(text.paper_text("t")).first()[0] == "T."


def test_whole_words(spark):
    df = spark.createDataFrame(
        [("biofuels only",), ("a fuel.",), ("éfuel",), ("fuel_cell",), ("bio-based goods",), ("c++ code",), ("it's",)], "x string"
    )
    hit = lambda t: [r[0] for r in df.select(text.has_term("x", t)).collect()]
    # An accented letter is no ASCII word character, so a boundary lies before "fuel".
    assert hit("fuel") == [False, True, True, False, False, False, False]
    assert hit("bio-based")[4] and not hit("based goods!")[4]
    # A term that ends in a sign needs a word character behind it.
    assert hit("c++") == [False] * 7
    assert hit("it's")[6]


def test_keywords(spark):
    assert text.normal_keywords([" Soil ", "soil", "a", "circular   economy", None]) == ["soil", "circular economy"]
    df = spark.createDataFrame([(" Soil ",), ("a",), ("circular \n economy",)], "x string")
    assert [r[0] for r in df.select(text.normal_keyword("x")).collect()] == ["soil", None, "circular economy"]


def test_terms_keep_stopwords_as_barriers(spark):
    df = spark.createDataFrame(
        [("The circular economy of carbon capture 2030 -- bio-based- a1 xy soil",), (None,), ("soil",)], "x string"
    )
    out = df.select(text.blank_stopwords(text.words("x")).alias("k")).select(text.terms_of(F.col("k")))
    first, none, one = [r[0] for r in out.collect()]
    # "the" blocks; "of", "2030", "a1" and "xy" go before stopwords and leave their neighbours adjacent.
    assert first == [
        "circular", "economy", "carbon", "capture", "bio-based", "soil",
        "circular economy", "economy carbon", "carbon capture", "capture bio-based", "bio-based soil",
    ]
    assert none == [] and one == ["soil"]


def test_words_by_brute_force(spark):
    """The one pattern against splitting, stripping and filtering in plain steps."""
    import random
    import re

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1-é É.0 \n") for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["2030-", "-12-a-", "a--b", "--", "1-2", "12-3-", "-007", "x-1-"]

    def plain(t):
        parts = (w.strip("-") for w in re.sub(r"[^a-zà-ÿ0-9\s-]", " ", t.lower()).split())
        return [w for w in parts if len(w) >= 3 and not re.fullmatch(r"[0-9]+", w)]

    df = spark.createDataFrame([(t,) for t in texts], "x string").coalesce(1)
    assert [r[0] for r in df.select(text.words("x")).collect()] == [plain(t) for t in texts]
