"""Personal data replaced by surrogates, with DataFrame functions only.

Texts are cut into pieces: plain text and entities (e-mail addresses, phone numbers, IPv4 addresses, payment cards, US social
security numbers, names after a form of address). Every distinct entity gets one surrogate, drawn with a secret key from
SHA-2, of the same type: e-mail local parts keep their pattern of letters, digits and signs; domains are entities of their
own, which get other labels of the same pattern, and none that the corpus has;
phone numbers keep country code, punctuation and the exchange 555 if they had it; cards keep their first digit and length
and, where it held, a valid check digit; addresses lie in the reserved block 240.0.0.0/4; given names keep gender and
script, surnames the script. Mentions are rendered in the format and case they had, so variants of one
entity stay variants of one surrogate. Names that are used up are made of syllables, with the ending of the gender.

A surrogate is accepted only if no other entity has it and it isn't itself an entity of the corpus; the losers draw again,
round by round, until none is left; where a type's form is used up, later rounds draw longer ones. Only entities and the texts that hold some are shuffled.

Defined cases: null and empty texts come back as they are; texts without entities are unchanged; rows that repeat are
changed alike; a hot entity is one row of the dictionary, broadcast to its mentions; an empty table gives no rows; other
columns are kept by replace() and ignored by the query.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, join_groups, read

KEY_SETTING = "spark.tallyspark.surrogate.key"  # the secret key; without it each session draws one of its own
ROUNDS = 64  # of drawing; from the 24th on every type has room without end, so this is never near
MORE = 4  # digits that a phone number gets when all of its length are taken

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}](?:[\p{L}\p{N}._%+\-]{0,62}[\p{L}\p{N}_%+\-])?@[\p{L}\p{N}](?:[\p{L}\p{N}\-]{0,62})?(?:\.[\p{L}\p{N}\-]{1,63}){0,6}\.\p{L}{2,24}"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
CARD = r"(?<![\d\-])(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{15,16})(?![\d\-])"
SSN = r"(?<![\d\-])(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\d\-])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d\-.])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])"
#: Forms of address by gender, in English, German, French, Spanish and Russian; fixed values.
MALE = "Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|Господин"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Госпожа"
OPEN = "Dr|Prof|Professor|Доктор"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{MALE}|{FEMALE}|{OPEN})\.?[ ]\p{{Lu}}\p{{L}}+(?:[ \-]\p{{Lu}}\p{{L}}+){{0,15}}"
#: Each part starts with a look at one character, so that most places in a text are left at once.
NUMBERS = rf"(?=[\d+(])(?:{IPV4}|{SSN}|{CARD}|{PHONE})"
TITLED = rf"(?=[MSHFDPГД]){NAME}"
ANY = f"{EMAIL}|{NUMBERS}|{TITLED}"
NO_EMAIL = f"{NUMBERS}|{TITLED}"
#: What a text must have for any of these: a cheap test before the patterns.
MAYBE = rf"[@0-9]|(?=[MSHFDPГД])(?:{MALE}|{FEMALE}|{OPEN})\.?[ ]\p{{Lu}}"

#: Surrogate given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Albert Bruno Carl Daniel David Emil Felix Gabriel Hugo Ivan Jonas Julian Leon Lucas Martin Max Nico Oscar Paul Robert Samuel Simon Thomas Victor".split(),
    ("latin", "f"): "Alice Anna Bella Clara Diana Elena Emma Eva Flora Gloria Helena Ida Julia Laura Lena Lucia Maria Nina Olivia Paula Rosa Sara Sofia Vera Victoria".split(),
    ("latin", "x"): "Alex Andrea Ariel Charlie Dominique Eli Jamie Jordan Kim Lou Morgan Noa Robin Sam Sascha Taylor".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Денис Егор Иван Лев Максим Олег Павел Роман Семён Тимур Фёдор Юрий".split(),
    ("cyrillic", "f"): "Алина Анна Вера Галина Дарья Елена Зоя Инна Лариса Мария Нина Ольга Полина Рита София Юлия".split(),
    ("cyrillic", "x"): "Саша Женя Валя Слава Шура Паша Тоня Вася".split(),
}
SYLLABLES = {"latin": "ba bel bor da del dor fa fel for ga gen gor ka kel kor la len lor ma mel mor ra ren ros ta tel tor va".split(), "cyrillic": "ба бел бор да дел дор ка кел кор ла лен лор ма мел мор ра рен рос та тел тор ва".split()}
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum; the last digit counts once."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _piece(kind, canon, raw) -> Column:
    return F.struct(F.lit(kind).cast("string").alias("kind") if not isinstance(kind, Column) else kind.alias("kind"), canon.alias("canon"), raw.alias("raw"))


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _entity(m: Column) -> Column:
    """The pieces of one mention: kind (null for plain text), canonical form, text."""
    none = F.lit(None).cast("string")
    title = F.regexp_extract(m, rf"^(?:{MALE}|{FEMALE}|{OPEN})\.?[ ]", 0)
    gender = F.when(title.rlike(rf"^(?:{MALE})\.?[ ]$"), "m").when(title.rlike(rf"^(?:{FEMALE})\.?[ ]$"), "f").otherwise("x")
    rest = F.split(F.substring(m, F.char_length(title) + 1, F.char_length(m)), "(?<=[ \\-])|(?=[ \\-])")
    words = F.transform(
        rest,
        lambda w, i: F.when(w.isin(" ", "-"), _piece(None, none, w)).otherwise(
            _piece(F.when(i == F.size(rest) - 1, F.concat(F.lit("surname:"), _script(w))).otherwise(F.concat(F.lit("given:"), _script(w), F.lit(":"), gender)), F.lower(w), w)
        ),
    )
    simple = F.when(m.contains("@"), _piece("email", F.lower(m), m))
    simple = simple.when(m.rlike(f"^(?:{IPV4})$"), _piece("ip", m, m))
    simple = simple.when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _piece("ssn", m, m))
    simple = simple.when(m.rlike(f"^(?:{CARD})$"), _piece("card", _digits(m), m))
    phone = _digits(m)
    phone = F.when((F.char_length(phone) == 10) & ~m.startswith("+"), F.concat(F.lit("1"), phone)).otherwise(phone)
    simple = simple.otherwise(_piece("phone", phone, m))
    return F.when(title == "", F.array(simple)).otherwise(F.concat(F.array(_piece(None, none, title)), words))


def with_mentions(texts: DataFrame) -> DataFrame:
    """Adds `mentions`, null where a text has none. The e-mail pattern is only tried where there is an @."""
    at = F.col("text").contains("@")
    found = F.when(at, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(NO_EMAIL), F.lit(0)))
    found = F.when(at | F.col("text").rlike(MAYBE), found)
    return texts.withColumn("mentions", F.when(F.size(found) > 0, found))


def pieces() -> Column:
    """The pieces of `text`, which has `mentions`."""
    gaps = F.when(F.col("text").contains("@"), F.split("text", ANY, -1)).otherwise(F.split("text", NO_EMAIL, -1))
    none = F.lit(None).cast("string")
    both = F.zip_with(gaps, "mentions", lambda g, m: F.when(m.isNull(), F.array(_piece(None, none, g))).otherwise(F.concat(F.array(_piece(None, none, g)), _entity(m))))
    return F.flatten(both)


def _stream(key: str, attempt: Column, *parts: Column) -> Column:
    """128 hexadecimal digits from the key, the parts and the attempt."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *parts, attempt.cast("string")), 512)


def _number(stream: Column, place: int) -> Column:
    """A whole number below 2^48 from 12 hexadecimal digits of the stream."""
    return F.conv(F.substring(stream, 1 + 12 * place, 12), 16, 10).cast("long")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _like(word: Column, stream: Column) -> Column:
    """A word of the same pattern: letters for letters of the same script, digits for digits, other signs kept."""
    at = lambda i: F.conv(F.substring(stream, (i % 64 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    pick = lambda alphabet, i: F.substring(F.lit(alphabet), at(i) % len(alphabet) + 1, F.lit(1))
    each = lambda c, i: F.when(c.rlike(r"\d"), pick("0123456789", i)).when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя", i)).when(c.rlike(r"\p{L}"), pick(LOWER, i)).otherwise(c)
    return F.array_join(F.transform(F.split(word, ""), each), "")


def _syllables(script: str, s: Column, many: Column) -> Column:
    """A name of so many syllables, up to nine."""
    names = [_pick(SYLLABLES[script], _number(s, i)) for i in range(9)]
    return F.array_join(F.slice(F.array(*names), F.lit(1), F.least(many, F.lit(9)).cast("int")), "")


def _surname(script: str, s: Column, attempt: Column) -> Column:
    return _syllables(script, s, 3 + F.floor(attempt / 4))


#: Endings of given names that are made up, by script and gender.
ENDINGS = {("latin", "m"): "o", ("latin", "f"): "a", ("latin", "x"): "i", ("cyrillic", "m"): "ан", ("cyrillic", "f"): "а", ("cyrillic", "x"): "и"}


def surrogate(kind: Column, canon: Column, host: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate that an entity draws at an attempt. host: the surrogate of an address' domain."""
    s = _stream(key, attempt, kind, canon)
    n = [_number(s, i) for i in range(8)]
    letters = lambda k: F.when(attempt > 2, _like(F.lit("a" * k), F.reverse(s))).otherwise("")
    email = F.concat(_like(F.substring_index(canon, "@", 1), s), letters(6), F.lit("@"), host)
    # a label stands for the same label in every domain, unless that gives a domain that is taken
    labels = F.split(F.regexp_replace(canon, r"\.[^.]+$", ""), r"\.")
    domain = F.concat(F.array_join(F.transform(labels, lambda w: _like(w, _stream(key, attempt, F.lit("domain"), w))), "."), letters(6), F.lit("."), F.substring_index(canon, ".", -1))
    digits = lambda x, size: F.lpad((x % F.pow(F.lit(10), size).cast("long")).cast("string"), size, "0")
    # reserved blocks first, then all of the form, then with digits behind it
    beyond = F.when(attempt < 24, "").otherwise(F.concat(F.lit("-"), digits(n[5], F.lit(12))))
    ip = F.concat(F.concat_ws(".", F.when(attempt < 12, n[0] % 15 + 240).otherwise(n[0] % 255 + 1), n[1] % 256, n[2] % 256, n[3] % 256), beyond)
    area = F.when(attempt < 12, 900 + n[0] % 100).otherwise(n[0] % 999 + 1)
    ssn = F.concat(F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((n[1] % 99 + 1).cast("string"), 2, "0"), F.lpad((n[2] % 9999 + 1).cast("string"), 4, "0")), beyond)
    size = F.char_length(canon)
    body = F.concat(F.substring(canon, 1, 1), F.substring(F.concat(digits(n[0], F.lit(10)), digits(n[1], F.lit(10))), F.lit(1), size - 2))
    check = ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.concat(body, F.when(_luhn_sum(canon) % 10 == 0, check).otherwise(digits(n[2], F.lit(1))))
    north = F.concat(F.lit("1"), (200 + n[0] % 800).cast("string"), F.when((F.substring(canon, 5, 3) == "555") & (attempt < 8), "555").otherwise((200 + n[1] % 800).cast("string")), digits(n[2], F.lit(4)))
    # short numbers have few free digits: later attempts free the country code too, the last ones add MORE digits
    keep = F.when(attempt < 8, 3).when(attempt < 16, 1).otherwise(0)
    abroad = F.concat(F.substring(canon, F.lit(1), keep), F.substring(F.concat(digits(n[0], F.lit(10)), digits(n[1], F.lit(10))), F.lit(1), size - keep), F.when(attempt >= 24, digits(n[2], F.lit(MORE))).otherwise(""))
    out = F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "ip", ip).when(kind == "ssn", ssn).when(kind == "card", card)
    out = out.when(kind == "phone", F.when((size == 11) & canon.startswith("1"), north).otherwise(abroad))
    for script in SYLLABLES:
        out = out.when(kind == f"surname:{script}", _surname(script, s, attempt))
        for g in "mfx":
            made = F.concat(_syllables(script, s, 1 + F.floor(attempt / 4)), F.lit(ENDINGS[script, g]))
            out = out.when(kind == f"given:{script}:{g}", F.when(attempt < 5, F.lower(_pick(GIVEN[script, g], n[0]))).otherwise(made))
    return out


def _render(kind: Column, raw: Column, to: Column) -> Column:
    """The surrogate in the format and case of the mention."""
    have = F.char_length(_digits(raw))
    more = F.when(F.char_length(to) >= have + MORE, F.right(to, F.lit(MORE))).otherwise("")
    tail = F.substring(to, F.char_length(to) - F.char_length(more) - have + 1, have)
    chars = F.split(raw, "")
    filled = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("i"), F.lit("").alias("s")),
        lambda a, c: F.when(c.rlike(r"\d"), F.struct((a["i"] + 1).alias("i"), F.concat(a["s"], F.substring(tail, a["i"] + 1, F.lit(1))).alias("s"))).otherwise(F.struct(a["i"].alias("i"), F.concat(a["s"], c).alias("s"))),
        lambda a: a["s"],
    )
    is_name = kind.startswith("given") | kind.startswith("surname")
    cased = F.when((F.upper(raw) == raw) & (F.char_length(raw) > 1), F.upper(to)).when(is_name, F.initcap(to)).otherwise(to)
    return F.when(kind == "phone", F.concat(filled, more)).when(kind == "card", filled).otherwise(cased)


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate for distinct entities (kind, canon, host); no surrogate is shared or a real entity of its type."""
    family = F.substring_index("kind", ":", 1)
    entities = durable(entities.withColumn("attempt", F.lit(0)))  # a column, so that every round runs the same compiled code
    real, pending, done = entities.select(family.alias("family"), F.col("canon").alias("taken")).distinct(), entities, []
    for _ in range(ROUNDS):
        drawn = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("host"), F.col("attempt"), key)).withColumn("family", family)
        mine = F.row_number().over(Window.partitionBy("family", "surrogate").orderBy("kind", "canon"))
        clash = real.select("family", F.col("taken").alias("surrogate"), F.lit(True).alias("clash"))
        drawn = drawn.withColumn("mine", mine).join(clash, ["family", "surrogate"], "left")
        drawn = durable(drawn.select("kind", "canon", "host", "attempt", "surrogate", "family", ((F.col("mine") == 1) & F.col("clash").isNull()).alias("good")))
        done.append(drawn.where("good").select("kind", "canon", "surrogate"))
        pending = drawn.where("NOT good").select("kind", "canon", "host", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done)
        real = durable(real.unionByName(drawn.where("good").select("family", F.col("surrogate").alias("taken"))))
    raise RuntimeError("some entities found no free surrogate")


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate for distinct entities (kind, canon). Domains come first: they are entities too, which addresses share."""
    none = F.lit(None).cast("string").alias("host")
    domain = F.substring_index("canon", "@", -1)
    mails = durable(entities.where("kind = 'email'").select("kind", "canon", domain.alias("domain")))
    domains = durable(mails.groupBy("domain").agg(F.count("*").alias("many")))
    hosts = _drawn(domains.select(F.lit("domain").alias("kind"), F.col("domain").alias("canon"), none), key)
    hosts = durable(domains.join(hosts.select(F.col("canon").alias("domain"), F.col("surrogate").alias("host")), "domain"))
    return _drawn(entities.where("kind <> 'email'").select("kind", "canon", none).unionByName(join_groups(mails, hosts, ["domain"], "many").select("kind", "canon", "host")), key)


def session_key(spark: SparkSession) -> str:
    """The key that the session names; where it names none, one is drawn and kept for the session, so that no known key is ever used."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def replace(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The documents with every entity replaced, all columns as they were. Without a key it is the session's."""
    key = key or session_key(docs.sparkSession)
    columns = docs.columns
    mine = ["_row_id", "_row_hash", "_pieces", "_done"]
    split = with_mentions(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("doc_id").alias("_row_id"), F.col("text").cast("string").alias("text")))
    plain = split.where(F.col("mentions").isNull()).select("row.*")
    holds = split.where(F.col("mentions").isNotNull()).select("row", "_row_id", F.unhex(F.sha2("text", 256)).alias("_row_hash"), pieces().alias("_pieces"))
    holds = durable(holds)
    mention = holds.select(*mine[:2], F.posexplode("_pieces").alias("i", "p")).where("p.kind IS NOT NULL").select(*mine[:2], "i", "p.kind", "p.canon", "p.raw")
    counted = durable(mention.groupBy("kind", "canon").agg(F.count("*").alias("many")))
    names = durable(dictionary(counted.select("kind", "canon"), key).join(counted, ["kind", "canon"]))
    told = join_groups(mention, names, ["kind", "canon"], "many").select(*mine[:2], F.struct("i", _render(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("s")).alias("e"))
    told = told.groupBy(*mine[:2]).agg(F.map_from_entries(F.collect_set("e")).alias("_done"))
    rebuilt = F.array_join(F.transform("_pieces", lambda p, i: F.coalesce(F.element_at("_done", i), p["raw"])), "")
    on = holds["_row_id"].eqNullSafe(told["_row_id"]) & (holds["_row_hash"] == told["_row_hash"])
    changed = holds.join(told, on).select("row", rebuilt.alias("_text")).select(F.col("row").withField("text", F.col("_text")).alias("row")).select("row.*")
    return plain.unionByName(changed).select(*(F.col(f"`{c}`") for c in columns))


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, kind, canon, raw of every mention."""
    found = with_mentions(docs.select("doc_id", F.col("text").cast("string").alias("text"))).where(F.col("mentions").isNotNull()).withColumn("pieces", pieces())
    return found.select("doc_id", F.explode("pieces").alias("p")).where("p.kind IS NOT NULL").select("doc_id", "p.kind", "p.canon", "p.raw")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("was"))
    return replace(docs).select("doc_id", "text", (~F.col("text").eqNullSafe(F.col("was"))).alias("changed"))
