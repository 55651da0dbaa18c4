"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import addresses, html, names, phones, text, urls


def values(spark, cases, f):
    rows = spark.createDataFrame([(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)], "i long, " + ", ".join(f"x{j} string" for j in range(len(cases[0]) if isinstance(cases[0], tuple) else 1)))
    columns = [F.col(c) for c in rows.columns[1:]]
    return [r[0] for r in rows.orderBy("i").select(f(*columns)).collect()]


def check(spark, f, cases):
    assert values(spark, list(cases), f) == list(cases.values())


def test_streets_and_units():
    assert addresses.street_and_unit("123 Main St, Suite 200") == ("123 main street", "suite 200")
    assert addresses.street_and_unit("2800 L St #500") == ("2800 l street", "suite 500")
    assert addresses.street_and_unit("123 N. Oak Ave") == ("123 north oak avenue", "")
    assert addresses.street_and_unit("St Mary Rd") == ("saint mary road", "")
    assert addresses.street_and_unit("123 North Road") == ("123 north road", "")
    assert addresses.street_and_unit("1 Elm Fl 2") == ("1 elm", "floor 2")
    assert addresses.street_and_unit(None) == ("", "")
    same = {addresses.unit_of(addresses._tokens(x)) for x in ("Ste. 360", "SUITE #360", "Suite 360, 3rd Floor", "3rd floor, suite 360", "360", "#360")}
    assert same == {"suite 360"}
    assert addresses.unit_of(addresses._tokens("Building A, Suite 360")) == addresses.unit_of(addresses._tokens("Suite 360, Bldg A")) == "bldg a suite 360"
    assert addresses.unit_of(addresses._tokens("3rd Floor")) == "floor 3"


def test_phones(spark):
    check(spark, phones.strict, {"(916) 431-0860 ext. 4": "9164310860", "1-916-431-0860": "9164310860", "916 431 0860 x4": "9164310860", "911-431-0860": "", "116 431 0860": "", "916-911-0860": "", "12345": "", "": "", "fax 9164310860": "9164310860"})
    check(spark, phones.loose, {"+1 (916) 431-0860": "9164310860", "12345": "12345", "": ""})
    check(spark, phones.exact, {"1 916 431 0860": "9164310860", "916 431 0860 4": "", "": ""})
    check(spark, phones.displayed, {"9164310860": "(916) 431-0860", "19164310860": "+1 (916) 431-0860", "12": "12", "": "—"})


def test_domains(spark):
    check(spark, urls.registrable, {"https://www.practice.co.uk/a": "practice.co.uk", "co.uk": "", "a.b.example.com:80": "example.com", "user@www.x.org": "x.org", "localhost": "", "": "", "HTTP://WWW.Clinic.k12.ca.us": "clinic.k12.ca.us"})
    check(spark, urls.hostname, {"https://www.a.com:8080/x": "a.com", "a.com": "a.com", "": ""})
    check(spark, urls.canonical, {"www.a.com/x/?utm=1#t": "https://www.a.com/x", "N/A": "", "http://a.com": "http://a.com", "https%3A%2F%2Fa.com%2Fb+c": "https://a.com/b+c", "": "", "https://": ""})
    check(spark, urls.quoted, {"a b/ü": "a%20b%2F%C3%BC"})


def test_states_zips_addresses(spark):
    check(spark, addresses.state_code, {"california": "CA", "ca": "CA", " New York ": "NY", "Ontario": "ONTARIO", "": ""})
    check(spark, addresses.zip5, {"94110-1234": "94110", "9411": "", "": ""})
    got = values(spark, ["123 Oak Ave, Suite 5, Miami, FL 33101", "Miami, Texas", "nowhere", "", "1 Elm, Town, 12"], addresses.parsed)
    assert [tuple(x) for x in got] == [("123 Oak Ave, Suite 5", "Miami", "FL", "33101"), ("", "Miami", "Texas", ""), ("", "", "", ""), ("", "", "", ""), ("1 Elm", "", "", "")]


def test_names(spark):
    check(spark, names.practice, {"Valley OBGYN, PLLC": "valley obgyn", "The Café & Co.": "café", "": ""})
    check(spark, names.loose, {"O'Neil  Smith": "o neil smith"})
    check(spark, lambda a, b: names.agree(a, b), {("Kaiser", "Kaiser Permanente"): True, ("Park Dermatology", "Park Endocrinology"): False, ("Park Derm Sun", "Sun Derm"): True, ("", "x"): False})
    check(spark, names.is_organization, {"Sutter Medical Foundation": True, "Jane Smith, MD": False})
    check(spark, names.from_domain, {"suttermedicalfoundation.org": "Sutter Medical Foundation", "smgdocs.com": "", "": "", "longlabel.com": "Longlabel"})
    check(spark, lambda a, b: names.specialty(a, b), {("Women's health clinic", ""): "OBGYN", ("", "Bay Urology"): "Urology", ("pain-management", ""): "Pain-Management", ("", ""): "Unknown", ("Dentist", "Cardiology Group"): "Cardiology"})
    check(spark, names.provider_list, {"A B|C": ["A B", "C"], "Jane Smith, MD, Bob Jones": ["Jane Smith, MD", "Bob Jones"], "": []})
    check(spark, lambda x: F.to_json(names.name_and_credentials(x)), {"Jane Smith, MD": '{"name":"Jane Smith","credentials":["MD"]}', "Bob": '{"name":"Bob","credentials":[]}'})
    check(spark, lambda n, t: names.with_prefix(n, t), {("Jane", "MD, FACOG"): "Dr. Jane", ("Dr. Bob", "MD"): "Dr. Bob", ("Ann", "RN"): "Ann"})
    assert values(spark, [("tide", "diet"), ("diet", "tide"), ("", "x")], names.likeness) == [0.25, 0.5, 0.0]
    check(spark, lambda x: names.specialty_fits(x, "psychiatry, ENT"), {"Psychiatrist": True, "urgent care": False, "ent surgeon": True, "": False})


def test_texts(spark):
    check(spark, text.csv_safe, {"=1+1": "'=1+1", "-x": "'-x", "a": "a", "\tq": "'\tq"})
    check(spark, text.titled, {"o'neil-smith": "O'Neil-Smith"})
    check(spark, lambda a, b: text.anchored(a, b), {("Cash  PAY", "we take cash\npay here"): True, ("", "x"): False, ("a", ""): False})
    assert values(spark, ["word " * 60], text.truncated)[0].endswith("word…")
    check(spark, text.safe_id, {"a/b c": "a_b_c"})
    check(spark, text.strip, {"  a \n": "a"})


def test_html(spark):
    page = "<html><head><title>T</title><script>x()</script></head><body><nav>menu</nav><p>Hello <b>you</b></p><img alt='A' src='/i/p.png?x'></body></html>"
    assert html.visible(page) == "Hello\nyou\n[image: A | p.png]"
    check(spark, html.is_challenge, {"<p>Just a Moment...</p>": True, "<p>Hi</p>": False})
    check(spark, lambda x: F.to_json(html.links(x)), {'<a class="k" href="/a">Our <b>Team</b></a>': '[{"href":"/a","text":"our team"}]'})


@pytest.mark.parametrize("status, asked, reached, want", [(200, "https://a.com/x", "https://www.a.com/x", "OK"), (404, "https://a.com", "https://a.com", "DEAD"), (200, "https://a.com/x", "https://b.com/x", "FLAG"), (200, "https://a.com/x", "https://a.com/", "FLAG"), (None, "https://a.com", "", "DEAD")])
def test_links(spark, status, asked, reached, want):
    row = spark.createDataFrame([(status, asked, reached)], "s int, a string, r string")
    assert row.select(urls.link_verdict(F.col("s"), F.col("a"), F.col("r"))).first()[0] == want
