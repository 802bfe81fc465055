from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkseek.operators.fuzzy import corrected_query, osa
from sparkseek.plans.query import MAX_LONG, parse_dates, parse_number, parse_query, parse_range
from sparkseek.plans.request import SearchRequest

UTC = ZoneInfo("UTC")
NOW = datetime(2024, 3, 5, 13, tzinfo=UTC)


def ms(*day):
    return int(datetime(*day, tzinfo=UTC).timestamp() * 1000)


def test_words_phrases_and_exclusions():
    p = parse_query('Invoice "Two Words" -draft -"old one" http://x.io/A -ext:png foo:Bar "" unclosed:"a b')
    assert p.terms == ["invoice", "two words", "http://x.io/a", "foo:bar", "unclosed:a b"]
    assert p.excludes == ["draft", "old one", "ext:png"] and not p.filters


def test_filters_and_their_echo():
    p = parse_query('in:Work tag:"To Do" ext:.PNG;jpg,|gif size:>1mb width:100-200 is:pinned is:portrait color:grey has:url path:a\\B sort:biggest', NOW)
    assert (p.folders, p.tags, p.exts, p.size, p.width) == (["work"], ["to do"], ["png", "jpg", "gif"], ((1 << 20) + 1, MAX_LONG), (100, 201))
    assert p.pinned and p.orientation == "portrait" and p.colors == ["gray"] and p.has == ["url"] and p.paths == ["a/b"] and p.sort == "largest"
    assert [f.label for f in p.filters] == ["In “Work”", "Tag: To Do", "Type: png, jpg, gif", "Size >1mb", "Width 100-200 px", "Pinned", "Portrait", "Color: gray", "Has url", "Path has “a\\B”", "Sorted by largest"]


def test_bad_values_stay_terms():
    assert parse_query("color:mauve size:x is:round date:never sort:best date:2024-13", NOW).terms == ["color:mauve", "size:x", "is:round", "date:never", "date:2024-13"]


def test_later_dates_override_one_bound():
    p = parse_query("date:2024 before:2024-03 after:yesterday", NOW)
    assert (p.since, p.until) == (ms(2024, 3, 4), ms(2024, 3, 1)) and len(p.filters) == 3


@pytest.mark.parametrize(
    "text, start, end, label",
    [
        ("today", (2024, 3, 5), (2024, 3, 6), "Today"),
        ("week", (2024, 2, 28), (2024, 3, 6), "Last 7 days"),
        ("year", (2023, 3, 7), (2024, 3, 6), "Last 12 months"),
        ("dec", (2023, 12, 1), (2024, 1, 1), "December 2023"),
        ("march", (2024, 3, 1), (2024, 4, 1), "March 2024"),
        ("2024-2-29", (2024, 2, 29), (2024, 3, 1), "2024-02-29"),
        ("2023-12", (2023, 12, 1), (2024, 1, 1), "December 2023"),
    ],
)
def test_dates(text, start, end, label):
    assert parse_dates(text, NOW) == (ms(*start), ms(*end), label)


def test_ranges():
    assert parse_range("tiny", True) == (0, 10240) and parse_range("tiny", False) is None
    assert parse_range("<=5", False) == (0, 6) and parse_range("1..3kb", True) == (1, 3073) and parse_range("5-", False) is None
    assert parse_number("1.5kb", True) == 1536 and parse_number("-1", True) is None and parse_number("2kb", False) is None and parse_number("0.5", False) == 1


@given(st.integers(0, 10**9), st.integers(0, 10**9))
def test_ranges_read_back(a, b):
    assert parse_range(f"{a}..{b}", False) == (a, b + 1) == parse_range(f"{a}-{b}", False)
    assert parse_range(f">{a}", False) == (a + 1, MAX_LONG) and parse_range(f"<{a}", True) == (0, a)


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_osa_is_a_symmetric_bound(a, b):
    d = osa(a, b)
    assert d == osa(b, a) and abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and (d == 0) == (a == b)


def test_osa_counts_swaps_once():
    assert osa("reciept", "receipt") == 1 and osa("ca", "abc") == 3 and osa("teh", "the") == 1


def test_corrections_keep_the_rest_of_the_query():
    assert corrected_query("Invioce ext:png invioce", [("invioce", "invoice")]) == "invoice ext:png invioce"


def test_requests():
    assert SearchRequest(limit=0).page == 1 and SearchRequest(limit=9999).page == 500 and SearchRequest().page == 200
    assert SearchRequest(mode="odd").lane == "all" and SearchRequest(q="  A b ").feedback_key == "a b"
