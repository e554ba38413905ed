import hashlib
import random
import re

import pytest
import regex

from tallyspark.llm import pii

TEXTS = [
    "Mail bo.b@mail.example.com or BO.B@MAIL.EXAMPLE.COM, never bob@mail.example.com.",
    "Call +1 (383) 555-8961, (383) 555-8961 or 383-555-8961 from 10.20.30.40.",
    "Card 4670349892180623 and 4670 3498 9218 0623, valid 4111111111111111.",
    "SSN 123-45-6789. Mr. John Smith met Mrs. Jane Smith; Frau Müller and Dr. Müller did not. Господин Иван Петров.",
    "Version 1.2.3 of 2024-01-02, 12345 items, room 10.5, a@b, 999.999.999.999, order 123456789.",
    None,
    "",
]


@pytest.fixture(scope="module")
def both(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x")], "doc_id long, text string, pieces string")
    out = pii.replace(df, key="k")
    assert out.columns == df.columns
    return df, {r.doc_id: r.text for r in out.collect()}


def test_no_entity_is_left(both):
    df, out = both
    for r in pii.entities(df).collect():
        if r.kind.split(":")[0] not in ("given", "surname"):
            assert r.raw not in out[r.doc_id], r
    assert "Smith" not in out[3] and "Петров" not in out[3] and "Müller" not in out[3]


def test_others_stay(both):
    _, out = both
    assert out[4] == TEXTS[4] and out[5] is None and out[6] == ""


def test_format_and_coreference(both):
    _, out = both
    a, b, c = re.findall(r"[\w.]+@[\w.]+\w", out[0])
    assert a == b.lower() and b.isupper() and c != a and re.fullmatch(r"[a-z]{2}\.[a-z]@[a-z]{4}\.[a-z]{7}\.com", a)
    assert a.split("@")[1] == c.split("@")[1]
    m = re.search(r"\+1 \((\d{3})\) (555)-(\d{4}), \((\d{3})\) (555)-(\d{4}) or (\d{3})-(555)-(\d{4}) from (24\d|25[0-4])\.", out[1])
    assert m and m.groups()[:3] == m.groups()[3:6] == m.groups()[6:9]
    x, y, z = re.search(r"Card (\d{16}) and ((?:\d{4} ){3}\d{4}), valid (\d{16})", out[2]).groups()
    assert x == y.replace(" ", "") and x[0] == "4"
    assert sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(z))) % 10 == 0
    m = re.search(r"Mr\. (\S+) (\S+) met Mrs\. (\S+) (\S+); Frau (\S+) and Dr\. (\S+) did not. Господин ([А-Яа-яё]+) ([А-Яа-яё]+)\.", out[3])
    assert m and m[2] == m[4] and m[5] == m[6] != m[2]
    assert m[1] in pii.GIVEN["latin", "m"] and m[3] in pii.GIVEN["latin", "f"] and m[7] in pii.GIVEN["cyrillic", "m"]


def test_many_entities_stay_distinct(spark):
    rows = [(i, f"x{i % 10}@a.com 10.0.{i // 250}.{i % 250} Mr. Adam{chr(97 + i % 26)} Zed{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    was = pii.entities(df).select("kind", "canon").distinct().groupBy("kind").count().collect()
    now = pii.entities(pii.replace(df)).select("kind", "canon").distinct().groupBy("kind").count().collect()
    old, new = {r.kind: r["count"] for r in was}, {r.kind: r["count"] for r in now}
    assert old["email"] == new["email"] == 10 and old["ip"] == new["ip"] == 900 and old["surname:latin"] == new["surname:latin"]


def test_query_and_empty(spark, odd, empty, tables):
    assert pii.op5_pii_surrogates(spark, tables(odd)).count() == odd.count()
    assert pii.replace(empty).count() == 0


def test_short_numbers_that_use_up_their_form(spark):
    """More numbers of five digits than there are surrogates with the same country code: still one each, none a real one."""
    numbers = [f"+1 {i // 100:02d} {i % 100:02d}" for i in range(130)]
    docs = spark.createDataFrame([(i, f"call {n} now") for i, n in enumerate(numbers)], "doc_id long, text string")
    out = [r.text for r in pii.replace(docs, "k").collect()]
    assert len(set(out)) == 130 and not set(out) & {f"call {n} now" for n in numbers}


def test_key_of_the_session(spark):
    docs = spark.createDataFrame([(1, "mail jo.doe@host.example")], "doc_id long, text string")
    plain = pii.replace(docs).first().text
    spark.conf.set(pii.KEY_SETTING, "another")
    try:
        assert pii.replace(docs).first().text == pii.replace(docs, "another").first().text != plain
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_mentions_against_plain_patterns(spark, odd):
    """What is found, held against another regex engine on texts put together from parts of entities."""
    rnd = random.Random(12)
    parts = "jo.doe @ host.example .com +1 383 555 8961 (383) - . 10.20 255 .30 4670 3498 9218 0623 123-45-6789 Mr. Dr Frau Müller Smith Господин Петров , ; x é".split() + [" ", " ", ""]
    rows = [(i, "".join(rnd.choice(parts) + rnd.choice(["", " ", "-", "."]) for _ in range(rnd.randint(1, 25)))) for i in range(800)] + [(900 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    java = lambda p: regex.compile(p.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}").replace(r"\d", "[0-9]").replace(r"\D", "[^0-9]").replace("[[0-9]", "[0-9").replace("[0-9]\\-", "0-9\\-"), regex.V0)
    both = {True: java(pii.ANY), False: java(pii.NO_EMAIL)}
    for r in pii.with_mentions(df.where("text IS NOT NULL")).collect():
        want = [m.group() for m in both["@" in r.text].finditer(r.text)]
        assert (r.mentions or []) == want, r.text


def test_names_of_any_length(spark):
    long = "B" + "a" * 80
    docs = spark.createDataFrame([(1, f"Mr. John {long} met Mrs. Ana Maria Garcia Lopez Perez Ruiz today")], "doc_id long, text string")
    out = pii.replace(docs, "k").first().text
    assert re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. \w+( \w+){5} today", out)
    assert not set(out.split()) & {"John", "Ana", "Maria", "Garcia", "Lopez", "Perez", "Ruiz"} and "aaaa" not in out


def test_more_given_names_than_the_lists_hold(spark):
    """Still one word each, all distinct, none a real one, and women's names end as such."""
    names = [f"{chr(65 + i % 26)}{chr(97 + i // 26)}nn{chr(97 + i % 7)}" for i in range(400)]
    docs = spark.createDataFrame([(i, f"Mrs. {n} Miller came.") for i, n in enumerate(names)], "doc_id long, text string")
    out = [re.fullmatch(r"Mrs\. (\w+) (\w+) came\.", r.text).groups() for r in pii.replace(docs, "k").collect()]
    given = {g for g, _ in out}
    assert len(given) == len(set(names)) and len({s for _, s in out}) == 1 and not given & set(names)
    assert all(g in pii.GIVEN["latin", "f"] or g.endswith("a") for g in given)


def test_domains_stay_distinct_and_are_not_real(spark):
    """More domains of one letter than there are letters."""
    hosts = [f"{chr(97 + i)}.org" for i in range(26)] + [f"{chr(97 + i)}{chr(97 + j)}.org" for i in range(6) for j in range(6)]
    docs = spark.createDataFrame([(i, f"to me@{h} and you@{h}") for i, h in enumerate(hosts)], "doc_id long, text string")
    out = [re.fullmatch(r"to (\w+)@(\S+) and (\w+)@(\S+)", r.text).groups() for r in pii.replace(docs, "k").collect()]
    assert all(a == b for _, a, _, b in out) and all(a.endswith(".org") for _, a, _, _ in out)
    assert len({a for _, a, _, _ in out}) == len(hosts) and not {a for _, a, _, _ in out} & set(hosts)


def test_a_session_without_a_key_draws_its_own(spark):
    docs = spark.createDataFrame([(1, "mail jo.doe@host.example")], "doc_id long, text string")
    had = spark.conf.get(pii.KEY_SETTING, None)
    spark.conf.unset(pii.KEY_SETTING)
    try:
        first = pii.replace(docs).first().text
        assert pii.replace(docs).first().text == first and len(pii.session_key(spark)) == 64
    finally:
        spark.conf.set(pii.KEY_SETTING, had) if had else spark.conf.unset(pii.KEY_SETTING)


def plain_stream(key, attempt, *parts):
    return hashlib.sha512("\u0001".join([key, *parts, str(attempt)]).encode()).hexdigest()


def plain_like(word, stream):
    out = []
    for i, c in enumerate(word):
        at = int(stream[i % 64 * 2 : i % 64 * 2 + 2], 16)
        out.append("0123456789"[at % 10] if c.isdigit() else pii.LOWER[at % 26] if c.isalpha() else c)
    return "".join(out)


def plain_surrogates(found, key):
    """Drawing and collisions of addresses, domains, IPv4 and security numbers, by plain loops."""

    def draw(entities, make):
        taken, out, pending, attempt = {c for c, _ in entities}, {}, sorted(entities), 0
        while pending:
            drawn, left, new = set(), [], {}
            for canon, host in pending:
                s = make(canon, host, attempt)
                if s in taken or s in drawn:
                    left.append((canon, host))
                else:
                    new[canon] = s
                drawn.add(s)
            out |= new
            taken |= set(new.values())
            pending, attempt = left, attempt + 1
        return out

    more = lambda s, attempt: plain_like("a" * 6, s[::-1]) if attempt > 2 else ""
    n = lambda s, i: int(s[12 * i : 12 * i + 12], 16)

    def domain(canon, _, attempt):
        *labels, top = canon.split(".")
        return ".".join(plain_like(w, plain_stream(key, attempt, "domain", w)) for w in labels) + more(plain_stream(key, attempt, "domain", canon), attempt) + "." + top

    def email(canon, host, attempt):
        s = plain_stream(key, attempt, "email", canon)
        return plain_like(canon.split("@")[0], s) + more(s, attempt) + "@" + host

    def ip(canon, _, attempt):
        s = plain_stream(key, attempt, "ip", canon)
        return f"{n(s, 0) % 15 + 240}.{n(s, 1) % 256}.{n(s, 2) % 256}.{n(s, 3) % 256}"

    def ssn(canon, _, attempt):
        s = plain_stream(key, attempt, "ssn", canon)
        return f"{900 + n(s, 0) % 100}-{n(s, 1) % 99 + 1:02d}-{n(s, 2) % 9999 + 1:04d}"

    hosts = draw({(c.split("@")[1], None) for k, c in found if k == "email"}, domain)
    out = {("email", c): s for c, s in draw({(c, hosts[c.split("@")[1]]) for k, c in found if k == "email"}, email).items()}
    for kind, make in (("ip", ip), ("ssn", ssn)):
        out |= {(kind, c): s for c, s in draw({(c, None) for k, c in found if k == kind}, make).items()}
    return out


def test_drawing_against_plain_loops(spark):
    rnd = random.Random(9)
    rows = [(i, f"{rnd.choice('ab')}{rnd.choice(['', '.x', '9'])}@{rnd.choice('abcdefghijklmnopqrstuvw')}{rnd.choice(['', '.b'])}.net or 10.0.{rnd.randrange(3)}.{i % 256} and {rnd.randint(1, 5) + 100}-{rnd.randint(10, 20)}-{rnd.randint(1000, 1040)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.entities(df).select("kind", "canon").distinct()
    got = {(r.kind, r.canon): r.surrogate for r in pii.dictionary(found, "k").collect()}
    assert got == plain_surrogates({(r.kind, r.canon) for r in found.collect()}, "k")
