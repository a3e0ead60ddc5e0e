"""Surrogates against a plain Python version, and the collision check on a tiny pool."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import pii
from loomgraph.plans.workspace import Workspace

ROWS = [
    (1, "Mr. John Smith met Mrs. Anna SMITH and Mr. Smith. Call +1 (212) 555-0199 or 212-555-0199, a@b.co A@B.CO"),
    (2, "господин Иванов и госпожа Иванова; card 4111 1111 1111 1111 / 4111111111111111 / 4111-1111-1111-1112; ssn 123-45-6789 ip 8.8.8.8. v1.2.3.4.5"),
    (3, None), (4, ""), (None, "x@y.org"), (5, "ends with 8.8.8.8"), (5, "ends with 8.8.8.8"), (6, "no data 2024 here " * 9000 + "z@q.net"), (7, "9876543210123456 12:30 3.14"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "m", "e", "d", 3) for r in rows], "doc_id long, text string, m string, entity string, _doc0 string, `a.b` int")


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def digits(key, attempt, secret):
    h = hashlib.sha256(f"{secret}\x1f{key}\x1f{attempt}\x1f{secret}".encode()).hexdigest()
    return h, h.translate(str.maketrans("abcdef", "012345"))


def test_replacement(spark):
    docs = frame(spark)
    out = pii.replace_personal_data(docs, "k", count_col="n")
    assert out.columns == [*docs.columns, "n"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    first = re.match(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+) and Mr\. (\w+)\. Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3}-\d{3}-\d{4}), (\S+) (\S+)$", by[1]["text"])
    assert first, by[1]["text"]
    assert first[2] == first[5] and first[4].isupper() and first[11] == first[10].upper()
    assert not {"john", "smith", "anna"} & set(by[1]["text"].lower().split()) and "a@b.co" not in by[1]["text"]
    _, d = digits("phone\x1f1-2125550199", 0, "k")
    assert first[6] + first[7] + first[8] == d[0].translate(str.maketrans("01", "23")) + d[1:10]
    second = by[2]["text"]
    cards = re.findall(r"card (\d{4}) (\d{4}) (\d{4}) (\d{4}) / (\d{16}) / (\S+);", second)[0]
    assert "".join(cards[:4]) == cards[4] and luhn(cards[4]) and cards[4][0] == "4"
    assert cards[5] == "4111-1111-1111-1112"  # no valid card
    assert re.search(r"господин \w+ов и госпожа \w+ова;", second) and "8.8.8.8" not in second and second.endswith(" v1.2.3.4.5")
    assert re.search(r"ssn 9\d\d-\d\d-\d{4} ip", second)
    h, _ = digits("ip\x1f8.8.8.8", 0, "k")
    want = [int(h[4 * i : 4 * i + 4], 16) for i in range(4)]
    ip = f"{want[0] % 223 + 1}.{want[1] % 256}.{want[2] % 256}.{want[3] % 254 + 1}"
    assert f"ip {ip}." in second and by[5]["text"] == f"ends with {ip}"
    assert by[3]["text"] is None and by[3]["n"] == 0 and by[4]["text"] == "" and "x@y.org" not in by[None]["text"]
    assert by[6]["text"].startswith("no data 2024 here ") and "z@q.net" not in by[6]["text"] and by[7]["text"] == ROWS[-1][1]
    assert pii.replace_personal_data(frame(spark, [])  , "k").isEmpty()


def test_other_key_other_surrogates(spark):
    a, b = (pii.replace_personal_data(frame(spark, ROWS[:1]), k).first()["text"] for k in ("k", "l"))
    assert a != b


@pytest.mark.parametrize("pool", [40, 60])
def test_collisions_are_resolved(spark, monkeypatch, pool):
    monkeypatch.setattr(pii, "surrogate", lambda k, a, s: F.concat(F.lit("s"), F.pmod(F.xxhash64(F.concat(k, a.cast("string"))), F.lit(pool)).cast("string")))
    names = [f"surname-latin\x1f{x}" for x in [f"s{i}" for i in range(5)] + [f"n{i}" for i in range(20)]]
    keys = spark.createDataFrame([(n,) for n in names], "entity string")
    again = pii.settled_attempts(keys, "k", Workspace(spark, "t"))
    final = keys.join(again, "entity", "left").select(pii.surrogate(F.col("entity"), F.coalesce("attempt", F.lit(0)), "k").alias("s"))
    found = [r["s"] for r in final.collect()]
    assert len(set(found)) == len(names) and not set(found) & {f"s{i}" for i in range(5)}


def test_whole_entities(spark):
    texts = [
        "Señora Ana García López y Señora López", "Mr John Paul Smith and Mr. Smith", "Herr Dr. Karl von der Heide", "Mrs van Dyke", "Mr John F. Kennedy Mrs Mary Kennedy",
        "max@münchen.de", "иван@почта.пример.рф", "a@a.b.c.d.e.f.g.h.i.j.example.com",
        "+33 1 23 45 67 89", "+49 30/1234 5678 90", "+44 (0)20 7946 0958", "+1 212 555 0199 2024",
    ]
    out = [r["text"] for r in pii.replace_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    name = r"[A-Z][a-z]+"
    for text, pattern in zip(out, [
        rf"Señora {name} {name} ({name}) y Señora \1", rf"Mr {name} {name} ({name}) and Mr\. \1", rf"Herr Dr\. {name} von der {name}", rf"Mrs van {name}", rf"Mr {name} {name} {name} Mrs {name} {name}",
        r"\S+@m[0-9a-f]{8}\.example\.org", r"\S+@m[0-9a-f]{8}\.example\.org", r"\S+@m[0-9a-f]{8}\.example\.com",
        r"\+33 \d \d\d \d\d \d\d \d\d", r"\+49 \d\d/\d{4} \d{4} \d\d", r"\+44 \(\d\)\d\d \d{4} \d{4}", r"\+1 \d{3} \d{3} \d{4} 2024",
    ]):
        assert re.fullmatch(pattern, text), text
    real = "Ana García López John Paul Smith Karl Heide Dyke F. Kennedy Mary max иван 1 23 45 67 89".split()
    assert not [w for w in real if any(re.search(rf"(?<![\w+]){re.escape(w)}(?!\w)", t) for t in out[:8])] and all(a != b for a, b in zip(out, texts))


def test_more_entities_than_short_names(spark):
    """A given name has 102,400 surrogates at the first attempt, and more with each further one."""
    keys = spark.range(7000).select(F.concat(F.lit("given-latin\x1fq"), F.col("id").cast("string")).alias("entity"))
    again = pii.settled_attempts(keys, "k", Workspace(spark, "t"))
    final = keys.join(again, "entity", "left").select(pii.surrogate(F.col("entity"), F.coalesce("attempt", F.lit(0)), "k").alias("s"), "attempt")
    assert final.select("s").distinct().count() == 7000 and final.where("not s rlike '^([a-z][aeiou])+[a-z]$'").isEmpty()
    assert not final.where("attempt > 0").isEmpty()


def test_people_keep_one_name_each(spark, monkeypatch):
    """A corpus of known people, mentioned in all forms: every name has one surrogate, no two have the same, none is real."""
    monkeypatch.setattr(pii, "_CONSONANTS", "bcdfbcdfbcdfbcdf")  # few names, so that many collide
    rng = random.Random(8)
    people = []
    for i in range(120):
        sex = "mf"[i % 2]
        given = rng.choice([x for x in (pii.GIVEN_MALE if sex == "m" else pii.GIVEN_FEMALE) if x.isascii() and x not in pii.WORDS]).capitalize()
        people.append((sex, given, "".join(rng.choice(["ko", "mal", "ster", "bran", "lo", "wick", "han", "der"]) for _ in range(3)).capitalize()))
    people += [("m", "Иван", f"{x}ов") for x in ("Петр", "Сидор", "Кузнец")] + [("f", "Анна", f"{x}ова") for x in ("Петр", "Орл")]
    rows, truth = [], []
    for n in range(900):
        sex, given, family = rng.choice(people)
        form = rng.choice(["{h} {g} {f}", "{h} {f}", "Dr. {f}", "Prof. {g} {f}", "{g} {f}", "Dr {g} {F}"])
        cyrillic = not given.isascii()
        h = rng.choice((["господин"] if sex == "m" else ["госпожа"]) if cyrillic else ["Mr.", "Herr", "Señor"] if sex == "m" else ["Mrs.", "Frau", "Ms"])
        form = form.replace("Dr.", "Доктор").replace("Dr", "Доктор").replace("Prof.", "доктор") if cyrillic else form
        rows.append((n, "we met " + form.format(h=h, g=given, f=family, F=family.upper()) + "."))
        truth.append((form, given.lower(), family.lower()))
    out = [r["text"] for r in pii.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    names, real = {}, {x for _, g, f in truth for x in (g, f)}
    for (form, given, family), text in zip(truth, out):
        words = text.rstrip(".").lower().split()
        assert not {given, family} & set(words), (form, given, family, text)
        names.setdefault(("f", family), set()).add(words[-1])
        if "{g}" in form:
            names.setdefault(("g", given), set()).add(words[-2])
    assert all(len(v) == 1 for v in names.values()), {k: v for k, v in names.items() if len(v) > 1}
    for kind in "gf":
        used = [next(iter(v)) for k, v in names.items() if k[0] == kind]
        assert len(set(used)) == len(used) and not set(used) & real


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def test_accounts_and_addresses(spark):
    texts = [
        "IBAN DE89 3704 0044 0532 0130 00, again DE89370400440532013000", "GB29NWBK60161331926819", "not one: DE88370400440532013000 AB12CDEFGHIJKLMN", "2001:DB8:0:0:8:800:200C:417A and 2001:db8::8:800:200c:417a.",
        "fe80::1 std::cout a::b 12:30:45 ::1", "Alice Johnson and Alice wrote to Mark Twain; Charles de Gaulle",
    ]
    out = [r["text"] for r in pii.replace_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    spaced, plain = re.fullmatch(r"IBAN (DE\d\d(?: \d{4}){4} \d\d), again (DE\d{20})", out[0]).groups()
    assert spaced.replace(" ", "") == plain != "DE89370400440532013000" and mod97(plain[4:] + plain[:4]) == 1
    assert re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", out[1]) and out[1] != texts[1] and mod97(out[1][4:] + out[1][:4]) == 1
    assert out[2] == texts[2]
    a, b = re.fullmatch(r"(2001:DB8(?::[0-9A-F]{1,4}){6}) and (2001:db8(?::[0-9a-f]{1,4}){6})\.", out[3]).groups()
    assert a.lower() == b != "2001:db8:0:0:8:800:200c:417a"
    assert re.fullmatch(r"2001:db8(:[0-9a-f]{1,4}){6} std::cout a::b 12:30:45 ::1", out[4])
    assert re.fullmatch(r"[A-Z][a-z]+a [A-Z][a-z]+ and Alice wrote to Mark Twain; [A-Z][a-z]+ de [A-Z][a-z]+", out[5]) and "Johnson" not in out[5] and "Gaulle" not in out[5]


def test_lookup_path(spark, monkeypatch):
    """With attempts above 0, all mentions still agree and differ from others'."""
    real = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda k, a, s: F.when((a == 0) & k.startswith("ip"), "1.1.1.1").otherwise(real(k, a, s)))
    docs = spark.createDataFrame([(1, "8.8.8.8 and 9.9.9.9"), (2, "9.9.9.9"), (None, "8.8.8.8"), (3, "none")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.replace_personal_data(docs, "k").collect()}
    one, two = out[1].split(" and ")
    assert one != two and out[2] == two and out[None] == one and out[3] == "none" and "1.1.1.1" in (one, two)
