"""Each rule on texts it must and must not match."""

import pytest

from inkveil.operators.rules import bounded_organization_rule, rules_named

POSITIVE = {
    "email": [
        ("Mail to jo@site.org now", "jo@site.org"), ("see a.b-c@my-site.co.uk", "a.b-c@my-site.co.uk"),
        ("to help+desk@firm.in please", "help+desk@firm.in"), ("x9.y@sub.host.com.", "x9.y@sub.host.com"),
    ],
    "phone_india": [
        ("Tel + 91 20 31112222;", "+ 91 20 31112222"), ("ring +91-22-6100 7200", "+91-22-6100 7200"),
        ("091 9812345678", "091 9812345678"), ("91-9812345678 here", "91-9812345678"),
    ],
    "phone_std": [("dial 022-61234567", "022-61234567"), ("0231 123456 ok", "0231 123456")],
    "phone_mobile": [("mobile 9812345678.", "9812345678"), ("x6000000000y", "6000000000")],
    "phone_toll_free": [("free 1800-222-3333", "1800-222-3333"), ("1800222333 now", "1800222333")],
    "phone_international": [("US +1-212-555-0142", "+1-212-555-0142"), ("+44 (20) 7946 0958", "+44 (20) 7946 0958")],
    "phone_us": [("(212) 555-0142!", "(212) 555-0142"), ("212.555.0142", "212.555.0142")],
    "ssn": [("id 321-54-9876.", "321-54-9876"), ("912-34-5678", "912-34-5678")],
    "credit_card": [
        ("pay 4012 8888 8888 1881", "4012 8888 8888 1881"), ("5105105105105100 ok", "5105105105105100"),
        ("amex 371449635398431", "371449635398431"), ("zeros 0000-0000-0000-0000", "0000-0000-0000-0000"),
    ],
    "ip_address": [("at 172.20.3.4.", "172.20.3.4"), ("1.1.1.1", "1.1.1.1"), ("010.001.000.255 x", "010.001.000.255")],
    "birth_date": [
        ("Date of birth: 03/04/1971", "03/04/1971"), ("DOB 1971-04-03", "1971-04-03"),
        ("was born on April 3, 1971", "April 3, 1971"), ("aged, 3 Apr 1971", "3 Apr 1971"),
        ("Birth date 03-Apr-1971", "03-Apr-1971"), ("age:42 since 3.4.1971", "3.4.1971"),
        ("Date of incorporation 12/12/2001", "12/12/2001"),
    ],
    "organization": [
        ("1 Northwind Traders Private Limited x", "Northwind Traders Private Limited"),
        ("2 Acorn Pvt. Ltd. x", "Acorn Pvt. Ltd."), ("3 Fern & Moss LLP", "Moss LLP"),
        ("4 Blue Sky Technologies", "Blue Sky Technologies"), ("5 Contoso Corp. x", "Contoso Corp."),
        ("6 Harbor Group", "Harbor Group"), ("7 Quill Inc", "Quill Inc"),
    ],
    "pin_code": [("PIN Code: 560001.", "PIN Code: 560001"), ("area 560001 x", "560001"), ("postal-560001", "postal-560001")],
    "street": [
        ("Plot No. 7, Mill Estate.", "Plot No. 7, Mill Estate"), ("Survey No. 12/3", "Survey No. 12/3"),
        ("3rd Floor", "3rd Floor"), ("Flat 9B", "Flat 9B"), ("- C Wing", "C Wing"), ("; Sector-21", "Sector-21"),
        (", Canal Road!", "Canal Road"), ("household goods", "household"),
    ],
    "person_contact": [("Contact Person: Lena Marsh, Secretary", "Lena Marsh")],
    "person_label": [("Name: Ravi Kumar Das; x", "Ravi Kumar Das"), ("promoter: Ines Costa.", "Ines Costa")],
    "person_designation": [("Lena Marsh Company Secretary", "Lena Marsh"), ("Omar Haddad Managing Director", "Omar Haddad")],
}
NEGATIVE = {
    "email": ["visit www.site.org", "ratio 3@5"],
    "phone_india": ["grew by 91%", "Section 91 of the Act"],
    "phone_std": ["022-12", "page 02 of 300"],
    "phone_mobile": ["12345678901", "98123456789", "5812345678"],
    "phone_toll_free": ["in 1800 there", "18002 223 333"],
    "phone_international": ["+5 points", "+1-2-3"],
    "phone_us": ["9212-555-0142", "212-555-01423"],
    "ssn": ["000-12-3456", "666-12-3456", "123-00-4567", "123-45-0000", "1123-45-6789"],
    "credit_card": ["4012 8888 8888 1882", "1234567890", "12,34,56,789", "3714 496353 98431"],
    "ip_address": ["256.1.2.3", "1.2.3", "a.b.c.d", "version 3.14.159", "1.2.3.4567"],
    "birth_date": ["meeting on 03/04/2021", "closes 30 September 2024", "age: 42 from 3/4/1971", "date of birth" + " -" * 65 + " 03/04/1971"],
    "organization": ["revenue was 12,345", "see Schedule III", "limited offer"],
    "pin_code": ["012345", "1234567", "pin 012345"],
    "street": ["growth of 20%", "version 3.14", "Q3 results"],
    "person_contact": ["Contact Person: The Director", "Contact Person:Lena Marsh"],
    "person_label": ["Name: Managing Director", "Name: Cher"],
    "person_designation": ["Our Chief Company Secretary"],
}


@pytest.fixture(scope="module")
def matches(spark):
    from pyspark.sql import functions as F

    from inkveil.operators.rules import spans_of

    def run(rule, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        done = rows.select("i", "text", F.expr(spans_of("text", [rule])).alias("s")).orderBy("i").collect()
        for r in done:
            for s in r.s:
                assert r.text[s.start : s.end] == s.original_text
        return [[s.original_text for s in r.s] for r in done]

    return run


@pytest.mark.parametrize("name", POSITIVE)
def test_rule(matches, name):
    rule = rules_named(name)[0]
    good, bad = POSITIVE[name], NEGATIVE[name]
    found = matches(rule, [t for t, _ in good] + bad)
    assert [f[:1] for f in found[: len(good)]] == [[v] for _, v in good]
    assert found[len(good) :] == [[] for _ in bad]


def test_gates_never_hide_a_match(matches):
    """Upper, lower and mixed case, and letters only a regex folds."""
    texts = ["x quill lımıted", "x QUILL LİMİTED", "x quill ſolutions", "x QuiLL lImItEd", "x quill SERVICES"]
    import dataclasses

    rule = rules_named("organization")[0]
    open_rule = dataclasses.replace(rule, any_of=(), gate="")
    assert matches(rule, texts) == matches(open_rule, texts)


def test_card_guard_quirk(matches):
    """The digit guards bind to the outer alternatives only."""
    card = rules_named("credit_card")[0]
    import dataclasses

    plain = dataclasses.replace(card, validate="")
    assert matches(plain, ["12345678901234567890"]) == [["2345678901234567890"]]
    assert matches(plain, ["99 4012 8888 8888 1881"]) == [["4012 8888 8888 1881"]]


def test_bounded_organization(matches):
    loose, strict = rules_named("organization")[0], bounded_organization_rule()
    texts = ["Revenue increased", "Quill Inc. filed"]
    assert matches(loose, texts) == [["Revenue inc"], ["Quill Inc."]]
    assert matches(strict, texts) == [[], ["Quill Inc."]]


def test_offsets_after_accents_and_emoji(matches):
    rule = rules_named("email")[0]
    assert matches(rule, ["😀 né 😀 à a@b.co puis c@d.org", "￿ a@b.co ￿ c@d.org"]) == [["a@b.co", "c@d.org"]] * 2


def test_unicode_word_boundary(matches):
    assert matches(rules_named("ip_address")[0], ["é1.2.3.4", "é 1.2.3.4"]) == [[], ["1.2.3.4"]]
