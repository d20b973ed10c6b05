import pytest

import random
import time

from leadloom.llm import pii


def found(text):
    return [(k, text[a:b]) for a, b, k in pii.detect(text)]


@pytest.mark.parametrize("text,want", [
    ("Write to Jo.Doe+x@Mail.Site.Example for a quote", [("EMAIL", "Jo.Doe+x@Mail.Site.Example")]),
    ("mailto:info@site.test or info (at) site (dot) test", [("EMAIL", "info@site.test"), ("EMAIL", "info (at) site (dot) test")]),
    ("jo dot doe at site dot example answers", [("EMAIL", "jo dot doe at site dot example")]),
    ("jo＠site.example", [("EMAIL", "jo＠site.example")]),
    ("Logo file: header@2x.png, meet us @ the fair, follow @shop", []),
    ("Call +91 (570) 338 7856 after six", [("PHONE", "+91 (570) 338 7856")]),
    ("tel:05714299394, 57128‑17251", [("PHONE", "05714299394"), ("PHONE", "57128‑17251")]),
    ("WhatsApp 575-390-6100, ext. 12.", [("PHONE", "575-390-6100")]),
    ("fax five seven zero three three eight seven eight five six", [("PHONE", "five seven zero three three eight seven eight five six")]),
    ("Order #20230418-5521, SKU 4481-2207-91, batch 5000 1234 2231 00, version 10.4.22.1, grid ref 555 120 / 884 310, ISO 9001-2015", []),
    ("SSN 939-02-3315 and passport N5119864", [("ID_NUMBER", "939-02-3315"), ("ID_NUMBER", "N5119864")]),
    ("Company tax no. 99QQXZZ0001X1Z9. Invoice INV-2023-00418", []),
    ("Deliveries go to House No. 129, Teal Road (back door)", [("ADDRESS", "House No. 129, Teal Road")]),
    ("at Flat 4, 153 Peskigick rd. or Calle Ditovin 33C or Pitunickstraße 38", [("ADDRESS", "Flat 4, 153 Peskigick rd"), ("ADDRESS", "Calle Ditovin 33C"), ("ADDRESS", "Pitunickstraße 38")]),
    ("Old Market Walk is nice. May Court opens. 14 road bikes and 3 lane markers in store. Room 14.", []),
    ("Dr. Ana M. Smith-Jones sees patients", [("NAME", "Ana M. Smith-Jones")]),
    ("Leave the keys at A. O'Brien's desk", [("NAME", "A. O'Brien")]),
    ("Ask for the blue option if you need help. Ask for Lee, Ann at the desk", [("NAME", "Lee, Ann")]),
    ("Harrow & Sons Bakery is our neighbour", []),
    ("", []),
])
def test_detect(text, want):
    assert found(text) == want


def test_offsets_survive_invisible_characters():
    t = "Mail jo​hn@si​te.example now"
    assert found(t) == [("EMAIL", "jo​hn@si​te.example")]
    assert pii.redact(t) == "Mail [EMAIL] now"


def test_long_text_is_read_whole():
    t = "word " * 200_000 + "Call 575-390-6100"
    assert found(t) == [("PHONE", "575-390-6100")]


def test_tables(spark):
    pages = spark.createDataFrame([(1, "Call 575-390-6100 or 575-390-6100", "x"), (1, "Call 575-390-6100 or 575-390-6100", "x"), (2, None, "x"), (3, "", "x")], "page_no bigint, extracted_text string, row_no string")
    contacts = spark.createDataFrame([(1, "Signed: Ana Smith")], "contact_no bigint, context string")
    got = sorted(tuple(r) for r in pii.personal_details(pages, contacts).collect())
    assert got == [("crawl_page.extracted_text", 1, "PHONE", "575-390-6100"), ("extracted_contact.context", 1, "NAME", "Ana Smith")]
    texts = {(r["field_name"], r["row_no"]): r["text"] for r in pii.redacted_texts(pages, contacts).collect()}
    assert len(texts) == 4 and texts["crawl_page.extracted_text", 2] is None and texts["extracted_contact.context", 1] == "Signed: [NAME]"
    assert pii.personal_details(pages.limit(0), contacts.limit(0)).count() == 0


def kinds(text):
    return [(k, text[a:b]) for a, b, k in pii.detect(text)]


def test_second_transducer_undoes_mixed_disguises():
    """Brackets, bare words and plain forms in one address; words, figures and doubles in one number; exact source spans."""
    for mail in ("joe [at] acme dot com", "joe (at) acme.com", "j.doe at mail dot acme dot co dot uk", "joe.b＠acme.example", "joe @ acme[.]com"):
        assert kinds(f"Questions? {mail}, please.") == [("EMAIL", mail)]
    for number in ("five seven 8 405 24 89 one", "nine eight, double seven 6 5 4 3 2 1", "triple four five six seven eight nine oh", "five seven eight four zero five two four eight nine"):
        assert kinds(f"call {number} today") == [("PHONE", number)]
    assert kinds("passport number: five one three six 2 two 7 zero nine.") == [("ID_NUMBER", "five one three six 2 two 7 zero nine")]
    assert kinds("see offers at acme.com or at the desk dot com") == [] and kinds("write to joe at acme.com now") == [("EMAIL", "joe at acme.com")]
    assert kinds("one or two of the three boats, four of five seats") == []
    assert pii.redact("Mail joe [at] acme dot com or ring five seven 8 405 24 89 one!") == "Mail [EMAIL] or ring [PHONE]!"


def test_names_without_cue():
    """Sentences without any of the cue phrases; trades, streets and places with a given name are none."""
    rng = random.Random(4)
    families = ["Lopez", "Bianchi", "Okafor", "O'Neill", "Schneider-Voss", "Tanaka", "Haddad", "Novak"]
    plain = ["Yesterday {a} met {b} at the market.", "Please send the invoice to {a} before noon, {b} said.", "The prize went to {a}; {b} came second.", "When {a} retired, {b} took over the kitchen."]
    found = total = 0
    for _ in range(200):
        a, b = (f"{rng.choice(pii.GIVEN)} {rng.choice(families)}" for _ in range(2))
        got = [v for k, v in kinds(rng.choice(plain).format(a=a, b=b)) if k == "NAME"]
        found, total = found + len({a, b} & set(got)), total + len({a, b})
    assert found >= 0.9 * total
    for text in ("Maria Lopez Bakery is open.", "Turn into Victoria Park Road.", "Laura & Maria Lopez & Sons", "We sell Oscar Hotel vouchers."):
        assert not kinds(text), text


def test_many_details_in_one_long_text():
    """No detail is compared with all others: 20,000 of them take seconds."""
    text = " ".join(f"mail a{i}@b.example or +91 57{i % 1000:03d} {10000 + i % 90000}." for i in range(10_000))
    began = time.time()
    assert len(pii.detect(text)) == 20_000 and time.time() - began < 20
