from __future__ import annotations

import re

import pytest

from basketlens.llm import surrogates as p
from basketlens.llm.surrogates import assigned, detect, luhn, rendered, surrogate, surrogates


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_entities_are_found():
    text = "mail a.b@x.example.com or +1 (614) 555-8001, 1.2.3.4, 4111 1111 1111 1111, 123-45-6789, Frau Anna Keller kam"
    assert [(k, text[a:b]) for a, b, k, _ in detect(text)] == [
        ("email", "a.b@x.example.com"), ("phone", "+1 (614) 555-8001"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"),
        ("ssn", "123-45-6789"), ("name", "Anna Keller"),
    ]
    assert detect("version 3, 12 of 400; nothing here. The Mrs of it") == []


def test_coreference_and_distinctness_over_the_table(spark):
    texts = [f"call +1 (614) 555-{i:04d} or +1 614 555 {i:04d} at u{i}@mail.example.com from 10.0.{i}.7" for i in range(200)]
    got = {r.doc_id: r.text for r in surrogates(frame(spark, *texts).repartition(7)).collect()}
    seen = set()
    for i, text in got.items():
        m = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4}) at (\S+@\S+\.com) from ([\d.]+)", text)
        assert m and m.group(1, 2, 3) == m.group(4, 5, 6)
        seen |= {m.group(1, 2, 3), m[7], m[8]}
        assert f"u{i}@mail" not in text and f"10.0.{i}.7" not in text
    assert len(seen) == 600


def test_collisions_are_drawn_again(spark):
    # More people than the lists have names for: all get different ones.
    rows = [("name", f"given{i} family", "f") for i in range(700)]
    out = assigned(spark.createDataFrame(rows, "kind string, value string, gender string")).collect()
    names = [r.surrogate.lower() for r in out]
    assert len(out) == 700 and len(set(names)) == 700


def test_a_surrogate_is_never_a_value_of_the_data(spark):
    first = surrogate("ip", "1.2.3.4", "", 0)
    rows = [("ip", "1.2.3.4", ""), ("ip", first, "")]
    out = {r.value: r.surrogate for r in assigned(spark.createDataFrame(rows, "kind string, value string, gender string")).collect()}
    assert not set(out) & set(out.values())


def test_types_and_formats_stay():
    card = "4111111111111111"
    assert luhn(card) == 0 and luhn(surrogate("card", card, "", 0)) == 0 and luhn(surrogate("card", "4111111111111112", "", 0)) != 0
    assert rendered("phone", "+1 (614) 555-8001", "19998887777") == "+1 (999) 888-7777"
    given = surrogate("name", "maria lopez", "f", 0).split()
    assert given[0] in p.GIVEN["latin", "f"].split() and len(given) == 2
    assert surrogate("name", "иван петров", "m", 0).split()[0] in p.GIVEN["cyrillic", "m"].split()
    assert surrogate("email", "a.b@x.com", "", 0).endswith(".com")
    assert surrogate("ip", "1.2.3.4", "", 0, b"k") == surrogate("ip", "1.2.3.4", "", 0, b"k") != surrogate("ip", "1.2.3.4", "", 0, b"l")


def test_documents_keep_all_else(documents):
    before = {r.doc_id: r.text for r in documents.collect()}
    rows = surrogates(documents).collect()
    assert sorted(r.doc_id for r in rows) == sorted(before)
    assert sum(r.n_entities for r in rows)
    for r in rows:
        spans = detect(before[r.doc_id])
        assert r.n_entities == len(spans)
        if not spans:
            assert r.text == before[r.doc_id]
        elif len(r.text) == len(before[r.doc_id]):
            inside = {i for a, b, _, _ in spans for i in range(a, b)}
            assert all(x == y for i, (x, y) in enumerate(zip(before[r.doc_id], r.text)) if i not in inside)


@pytest.mark.parametrize("text", [None, "", " "])
def test_texts_without_entities(spark, text):
    row = surrogates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.text == text and row.n_entities == 0


def test_odd_rows(odd, none):
    got = surrogates(odd).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, ((r.doc_id, r.text) for r in odd.collect())))
    assert surrogates(none).collect() == []


def replaced(spark, text, key=b"k"):
    return surrogates(frame(spark, text), key=key).first().text


def test_a_name_and_its_surname_are_one_person(spark):
    text = replaced(spark, "Mr John Smith came. Mr Smith said so; John Smith left, Mrs Anna-Lena von Berg stayed. Mr Brown too.")
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. Mr (\w+) said so; (\w+) (\w+) left, Mrs (\w+) von (\w+) stayed\. Mr (\w+) too\.", text)
    assert m and m[2] == m[3] == m[5] and m[1] == m[4] and m[1] in p.GIVEN["latin", "m"].split()
    assert m[6] in p.GIVEN["latin", "f"].split() and "Smith" not in text and "Berg" not in text and "Brown" not in text


def test_two_bearers_of_a_surname_are_not_mixed_up():
    spans = p._entities("Mr John Smith and Mr Paul Smith. Mr Smith.")
    assert [v for *_, v in spans] == ["john smith", "paul smith", "smith"]


@pytest.mark.parametrize("name, script", [
    ("Γιώργος Παπαδόπουλος", "greek"), ("王小明", "han"), ("محمد علي", "arabic"), ("דוד כהן", "hebrew"), ("ヤマダ タロウ", "kana"),
    ("김민수", "hangul"), ("राम कुमार", "devanagari"), ("Иван Петров", "cyrillic"), ("Zoë Ångström", "latin"),
])
def test_names_keep_their_script(spark, name, script):
    assert p.script_of(name) == script
    text = replaced(spark, f"Mr {name} was here")
    new = re.fullmatch("Mr (.+) was here", text)[1]
    assert new != name and p.script_of(new) == script and len(new.split()) == len(name.split())


def test_addresses_accounts_and_plain_numbers(spark):
    import ipaddress

    text = replaced(spark, "from 2001:db8::8a2e:370:7334 pay DE89 3704 0044 0532 0130 00, tel: 6145558001, code 6145558001, 12:30:45 at ::1")
    m = re.fullmatch(r"from (\S+) pay (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d), tel: (\d{10}), code 6145558001, 12:30:45 at ::1", text)
    assert m and ipaddress.IPv6Address(m[1]) and m[1] != "2001:db8::8a2e:370:7334" and m[3] != "6145558001"
    assert p.checked(m[2].replace(" ", "")) == 1 and m[2] != "DE89 3704 0044 0532 0130 00"
    assert detect("XY12 ABCD 7890 EFGH is no account, a::b::c no address") == []


def test_the_key_is_the_callers(spark):
    text = "Mr John Smith, a.b@mail.example.com"
    assert replaced(spark, text, b"one") == replaced(spark, text, b"one") != replaced(spark, text, b"two")
    spark.conf.set(p.KEY_SETTING, "one")
    try:
        assert surrogates(frame(spark, text)).first().text == replaced(spark, text, b"one")
    finally:
        spark.conf.unset(p.KEY_SETTING)
    own = surrogates(frame(spark, text)).first().text
    assert own == surrogates(frame(spark, text)).first().text


def test_whole_table_equals_the_plain_version(spark):
    """Entities one by one: every mention of a value gets the value's surrogate, and all else stays."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in documents.collect()}
    after = {r.doc_id: r.text for r in surrogates(documents, key=b"k").collect()}
    entities = {}
    for text in before.values():
        for *_, kind, gender, value in p._entities(text or ""):
            entities[kind, value] = max(gender, entities.get((kind, value), ""))
    table = spark.createDataFrame([(k, v, g) for (k, v), g in entities.items()], "kind string, value string, gender string")
    drawn = {(r.kind, r.value): r.surrogate for r in assigned(table, b"k").collect()}
    assert len(entities) > 50 and len({(k, v.lower()) for (k, _), v in drawn.items()}) == len(drawn)
    assert not {(k, v.lower()) for (k, _), v in drawn.items()} & set(drawn)
    for doc_id, text in before.items():
        pieces, at = [], 0
        for start, end, kind, _, value in p._entities(text or ""):
            pieces += [text[at:start], rendered(kind, text[start:end], drawn[kind, value])]
            at = end
        assert after[doc_id] == (text if text is None else "".join([*pieces, text[at:]]))
