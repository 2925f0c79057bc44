"""Functions of one text: forms of citations, styles, reference lists and entries. All names are invented."""

import pytest

from marginalia.functions import numeric, reference_fields, reference_list


def test_names_as_keys():
    assert reference_fields.normalize_name("Łø-Straße") == "lostrasse"


@pytest.mark.parametrize(
    ("text", "expected"), [("1,3-5,7", [1, 3, 4, 5, 7]), ("1,123", [1123]), ("5-3", []), ("2–4", [2, 3, 4]), ("", []), ("1-500", list(range(1, 101)))]
)
def test_number_ranges(text, expected):
    assert numeric.expand_range(text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("seen [1, 3-5] and [7]", [[1, 3, 4, 5], [7]]),
        ("Table [3] and [0] and [1999]", []),
        ("the method.12,13 works", [[12, 13]]),
        ("raised¹,² here", [[1, 2]]),
        ("by us (3) also (4-6) but n = (5), (2020) and p (7)", [[3], [4, 5, 6]]),
        ("the COVID-1914,27 cases", [[14, 27]]),
        ("see mail a@host1.com or http://x.org/a1", []),
    ],
)
def test_numeric_family(text, expected):
    assert [c.citation_numbers for c in numeric.detect(text)] == expected


def test_glued_digits_deep_in_a_long_address():
    assert numeric.detect("see www.host" + "/part" * 1000 + "/end7/" + "part/" * 1000 + " here") == []
    assert numeric.detect("see " + "part/" * 1000 + "end7/" + "part/" * 1000 + "host.org here") == []
    assert [c.citation_numbers for c in numeric.detect("see www.host.org/a1 and results7 here")] == [[7]]


def test_numeric_family_stops_at_the_list():
    text = "one [1] two [2]\nReferences\n[1] Smith"
    assert len(numeric.detect(text, text.index("\nReferences"))) == 2


APA = (
    "Text (Adams & Brown, 2001) and (Clark, 2003).\n\nReferences\n\nAdams, B. C., & Brown, D. (2001). A study of things. Journal of Stuff, 12(3), 45-67.\n"
    "Clark, E. (2003). Another study. Journal of Things, 1(2), 3-4. https://doi.org/10.1000/x1\nDavis, F., Evans, G., & Foster, H. (2010a). More. Big Review, 5(1), 9-19.\n"
)
VANCOUVER = (
    "Seen [1] and [2,3] and [2].\n\nReferences\n1. Adams BC, Brown D. Study of things. J Stuff. 2001;12(3):45-67.\n2. Clark E. Another study. J Things. 2003;1(2):3-4.\n"
    "3. Davis F, Evans G. More on this. Big Rev. 2010;5(1):9-19.\n"
)


def test_sections_end_where_other_matter_begins():
    found = reference_list.section(APA + "\nAppendix\nsome prose that is not an entry\n")
    assert found.endswith("9-19.") and reference_list.section_start(APA) == APA.index("\n\nReferences")
    assert reference_list.section("no list here") is None


def test_references_of_a_text():
    refs = reference_fields.parse_references(APA, "apa")
    assert [[a.last_name for a in r.authors] for r in refs] == [["Adams", "Brown"], ["Clark"], ["Davis", "Evans", "Foster"]]
    assert [(r.year, r.year_suffix, r.volume, r.issue, r.pages) for r in refs] == [("2001", None, "12", "3", "45-67"), ("2003", None, "1", "2", "3-4"), ("2010", "a", "5", "1", "9-19")]
    assert refs[1].doi == "10.1000/x1" and [r.list_number for r in reference_fields.parse_references(VANCOUVER, "vancouver")] == [1, 2, 3]


@pytest.mark.parametrize(
    ("kind", "entry", "names", "year", "title"),
    [
        ("ieee", '[3] J. A. Smith, B. Lee, and C. Ng, "Title of it," IEEE Trans., vol. 4, no. 2, pp. 1-9, 2015.', ["Smith", "Lee", "Ng"], "2015", "Title of it,"),
        ("nature", "4. Smith, J., Lee, B. & Ng, C. Title of this thing. Nature 33, 44-55 (2010).", ["Smith", "Lee", "Ng"], "2010", "Title of this thing"),
        ("aom", "Smith, J. A., & Lee, B. 2003. Title of the paper. Academy Journal, 12(3): 44-55.", ["Smith", "Lee"], "2003", "Title of the paper."),
        ("asa", 'Smith, Jane B., and John Lee. 2003. "Title of a paper". American Review 12(3):44-55.', ["Smith", "Lee"], "2003", "Title of a paper"),
        ("apa", "World Health Organization. (2019). Report on stuff. Geneva.", ["World Health Organization."], "2019", "Report on stuff."),
        ("apa", "Smith, J., Jr., & Lee, K. (in press). Title here. Big Journal.", ["Smith", "Lee"], "in press", "Title here."),
    ],
)
def test_entries(kind, entry, names, year, title):
    ref = reference_fields.parse_entry(entry, kind)
    assert ([a.last_name for a in ref.authors], ref.year, ref.title) == (names, year, title)


@pytest.mark.parametrize(
    ("split", "entries"),
    [
        (reference_list.split_apa, ["Adams, B. (2001). A long study of many things. Journal of Stuff, 12(3), 45-67.", "Clark, E., & Lee, K. (2003). Another long study of things. Journal, 1(2), 3-4."]),
        (reference_list.split_harvard, ["Adams B (2001) A long study of many things and more. Journal of Stuff 12(3): 45-67.", "Clark E and Lee K (2003) Another long study of things. Journal 1(2): 3-4."]),
        (reference_list.split_aom, ["Adams, B. 2001. A long study of many things and more. Journal of Stuff, 12(3): 45-67.", "Clark, E. 2003. Another long study of things. Journal, 1(2): 3-4."]),
    ],
)
def test_run_on_entries(split, entries):
    assert split(" ".join(entries)) == entries
    assert split(entries[0]) == [entries[0]]
