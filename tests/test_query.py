import pytest

from tagloom.functions.text import glob_pattern, wildcard_pattern
from tagloom.operators.search import SearchSpec, first_of_file, matching, ordered
from tagloom.plans.query import Range, append_tag, number_range, parse, replace_word, tag_list
from tagloom.sources.posts import conform


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, "g", 10, "a b c++", "https://www.pixiv.net/artworks/12", "m1", 100, 50, "2024-02-29"),
        (2, "s", 20, "a  :) (series)", "//x/1", "m1", 50, 100, "2024-01-31T12:00:00"),
        (3, None, None, None, None, None, 50, 50, None),
        (4, "e", 30, "ab a.b or", "ftp://y", None, 70, 70, "2024-01-31"),
        (5, "q", 5, "A date:x", "https://z/artworks/9", "m2", 1, 2, "2023-12-31"),
    ]
    return conform(spark.createDataFrame(data, "id long, rating string, score long, tag_string string, file_url string, md5 string, image_width long, image_height long, created_at string"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a", [1, 2]),
        ("-a", [3, 4, 5]),
        ("c++", [1]),
        (":)", [2]),
        ("a.b", [4]),
        ("a*", [1, 2, 4]),
        ("*b", [1, 4]),
        ("-a*", [3, 5]),
        ("(ser*", [2]),
        ("score:..", [1, 2, 3, 4, 5]),
        ("score:10..", [1, 2, 4]),
        ("score:..10", [1, 5]),
        ("score:10..20..5", [1, 2]),
        ("-score:>10", [1, 5]),
        ("rating:general,e", [1, 4]),
        ("-rating:g", [2, 4, 5]),
        ("source:none", [3]),
        ("-source:none", [1, 2, 4, 5]),
        ("source:http", [1, 5]),
        ("-source:http", [2, 4]),
        ("source:*z/*", [5]),
        ('source:"y"', [4]),
        ("pixiv:any", [1]),
        ("pixiv:10..20", [1]),
        ("-pixiv:12", []),
        ("date:x", [5]),
        ("a OR ab", [1, 2, 4]),
        ("a or ab or c++", [1]),
        ("or a", [1, 2]),
        ("a or", [1, 2]),
        ("b or or a", [1]),
        ("", [1, 2, 3, 4, 5]),
    ],
)
def test_terms(rows, text, expected):
    assert ids(matching(rows, SearchSpec(text))) == expected


def test_a_clause_of_three_or_words(rows):
    """"b or or a" is (b or the tag "or") and a."""
    assert ids(matching(rows, SearchSpec("b or or"))) == [1, 4]


def test_condition_and_negation_part_the_rows(rows):
    for text in ("score:>10", "rating:g", "a", "a*"):
        there, gone = ids(matching(rows, SearchSpec(text))), ids(matching(rows, SearchSpec("-" + text)))
        assert not set(there) & set(gone)


def test_bad_number():
    with pytest.raises(ValueError):
        parse("score:abc")
    assert number_range(">=5") == Range(5) and number_range("<5") == Range(high=4)


def test_order():
    assert parse("a order:id -order:SCORE_asc order:foo").order == ("score", False)
    assert parse("a order:foo").order is None
    assert SearchSpec("order:random").order() == ("random", False)
    assert SearchSpec("x", sort="Date", descending=False).order() == ("created_at", False)


def test_sort_puts_nulls_first(rows):
    assert [r["id"] for r in ordered(rows, "score", True).collect()] == [3, 4, 2, 1, 5]
    assert [r["id"] for r in ordered(rows, "score", False).collect()] == [3, 5, 1, 2, 4]


def test_filters(rows):
    assert ids(matching(rows, SearchSpec(date_from="2024-01-01", date_to="2024-01-31"))) == [4]
    assert ids(matching(rows, SearchSpec(orientation="Square"))) == [3, 4]
    assert ids(matching(rows, SearchSpec(orientation="Any", min_score=20))) == [2, 4]


def test_first_of_file(rows):
    assert ids(first_of_file(rows)) == [1, 3, 5]


def test_conform(spark):
    df = conform(spark.createDataFrame([("12.5", 7, "x")], "id string, score int, other string"))
    row = df.first()
    assert len(df.columns) == 16 and row["id"] is None and row["score"] == 7 and row["md5"] is None


def test_text_helpers():
    assert tag_list("A, b\n-c a") == ["a", "b", "-c"]
    assert replace_word("foo -ba rest", 7, "bar") == "foo -bar  rest"
    assert append_tag(" a ", "b") == "a b " and append_tag("", "b") == "b "
    assert wildcard_pattern("a.b*", ".*") == r"a\.b.*"
    assert glob_pattern("a?[!x]*") == r"^a(?s:.)[^x](?s:.*)$"
