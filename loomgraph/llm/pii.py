"""Surrogates for personal data, in DataFrame expressions only.

Entities are found by pattern: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards and bank
accounts (IBAN; both with a valid checksum), social security numbers, and names: after one or more honorifics, or
from a given name of a list on if a capitalised word follows. A name is all capitalised words and initials that
follow, with particles between them: the first word is the given name if another comes after it, all others are
surnames, each an entity of its own; particles stay. Domains may be in any script. International numbers have 8 to
15 digits in any groups, those after +1 have 11.

An entity has a kind and a normal form (case and punctuation do not count), and its surrogate is made from a
keyed digest of both and an attempt number, so that all mentions of an entity, in any document, agree without any
lookup. Honorifics and gender are no part of an entity: Mr Smith, Dr Smith and Mrs Smith get one surname.
Surrogates fit their kind: digits replace digits in the mention's own punctuation, cards keep issuer digit and
checksum validity, accounts country and valid check digits, addresses shape and script, names script, capitals and
the honorific. Gender shows in endings: of given names by the honorific or else the lists, of Cyrillic surnames by
the surname's own ending.

Collision check: the distinct entities' surrogates are compared with each other (all surnames of a script are one
space, all given names another) and, with every ending they may take, with all real entities of their kind.
Whoever shares one takes a further attempt, until all differ. Names and local parts of addresses grow with each
attempt, so no number of entities exhausts them; numbers keep their length, and have about as many surrogates as
there are real ones. Only entities with an attempt above 0 need a lookup, which reaches the documents as a small
map; as long as there is none, texts are rewritten where they are read, without a shuffle.

Null texts stay null, empty ones empty, texts without entities as they are; an empty table gives no rows. Repeated
rows get equal results, whatever their ids, which are not used; all other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.plans.workspace import Workspace

ATTEMPTS = 100
#: The most syllables that attempts add to a name: as many as the digest has digits for.
SYLLABLES = 28
#: Lookups of up to this number of texts go to every task.
BROADCAST_TEXTS = 10_000

# Honorifics by gender, and given names whose gender settles a neutral honorific.
MALE = "Mr|Mister|Herr|Monsieur|Señor|Sr|Signor|Господин|господин".split("|")
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Signora|Госпожа|госпожа".split("|")
NEUTRAL = "Dr|Prof|Professor|Доктор|доктор".split("|")
GIVEN_FEMALE = (
    "anna maria mary jane susan linda emma olivia julia laura sarah lisa marie claire sophie camille carmen lucia elena ana isabel petra sabine ursula monika alice "
    "jennifer jessica karen nancy margaret sandra emily michelle amanda melissa deborah stephanie rebecca helen charlotte nathalie céline chloé inès "
    "beatriz heike birgit katharina giulia chiara fatima aisha priya анна мария елена ольга наталья татьяна ирина екатерина"
).split()
GIVEN_MALE = (
    "john james robert michael david peter paul thomas mark hans karl jürgen klaus pierre jean louis michel luc josé juan carlos luis miguel pedro william richard joseph "
    "charles christopher daniel matthew anthony steven andrew kenneth kevin brian george edward ronald timothy jason jeffrey eric stephen jonathan benjamin samuel alexander "
    "wolfgang dieter stefan andreas jacques françois philippe antoine javier fernando diego pablo giovanni giuseppe mohammed ahmed raj иван пётр алексей дмитрий сергей андрей михаил николай"
).split()
#: Given names that are common words: they need an honorific.
WORDS = frozenset("mark jean".split())

_HONORIFIC = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=lambda x: (-len(x), x)))
_FIRST = "".join(sorted({x[0] for x in MALE + FEMALE + NEUTRAL}))
_HONORIFICS = rf"(?:(?:{_HONORIFIC})\.?[ ])+"
_CAPITALISED = sorted(x[0].upper() + x[1:] for x in set(GIVEN_FEMALE + GIVEN_MALE) - WORDS)
_GIVEN = "|".join(rf"{c}(?:{'|'.join(x[1:] for x in _CAPITALISED if x[0] == c)})" for c in sorted({x[0] for x in _CAPITALISED}))
_GIVEN = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}._@'’-])(?:{_GIVEN})"
PARTICLES = "de|del|della|di|da|do|dos|das|du|des|la|las|le|les|los|van|von|vom|zu|zum|zur|der|den|dem|het|ten|ter|af|av|el|al|bin|ibn|y".split("|")
_PARTICLE = rf"(?:{'|'.join(PARTICLES)})[ ]"
# A word or an initial; another honorific with a name begins a name of its own.
_WORD = rf"(?!(?:{_HONORIFIC})\.?[ ]\p{{Lu}})\p{{Lu}}(?:[\p{{L}}\p{{M}}'’-]++|\.(?=[ ]\p{{Lu}}))"
_LABEL = r"[\p{L}\p{M}\p{N}-]{1,63}+"
_TOP = r"(?:xn--[A-Za-z0-9-]{2,59}|\p{IsLatin}[\p{IsLatin}\p{M}]{1,62}|[\p{L}\p{M}&&\P{IsLatin}]{2,63})"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:" + _LABEL + r"\.){1,127}" + _TOP,
    "phone": r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[2-9](?:(?:[ ./-]|[ .-]?\(|\)[ ./-]?)?[0-9]){7,14}(?![0-9])|\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "card": r"(?<![0-9A-Za-z])[2-6][0-9]{3}(?:[ -][0-9]{4}){3}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[2-6][0-9]{12,18}(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:]|\.[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![0-9A-Za-z])",
    "name": rf"(?=[{_FIRST}])(?<!\p{{L}}){_HONORIFICS}(?:{_PARTICLE})*+{_WORD}(?:[ ](?:{_PARTICLE})*+{_WORD})*+",
    "person": rf"{_GIVEN}(?:[ ](?:{_PARTICLE})*+{_WORD})++",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must hold to have any entity; cheap to test.
HINT = rf"[0-9@]|{_GIVEN} (?:{_PARTICLE})*\p{{Lu}}|(?=[{_FIRST}])(?:{_HONORIFIC})\.? (?:{_PARTICLE})*\p{{Lu}}"

_HEX = "0123456789abcdef"
_CONSONANTS, _VOWELS = "bcdfghklmnprstvz", "aeiouaeioaeiuaeo"
_CYRILLIC_CONSONANTS, _CYRILLIC_VOWELS = "бвдфгхклмнпрстжз", "аеиоуаеиоаеиуаео"
_SEPARATOR = "\x1f"


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def kind_of(mention: Column) -> Column:
    digits = F.length(F.regexp_replace(mention, "[^0-9]", ""))
    return (
        F.when(F.instr(mention, "@") > 0, "email")
        .when(_has(mention, "^[0-9A-Fa-f]+:[0-9A-Fa-f:]+$"), "ipv6")
        .when(_has(mention, "^[A-Z]{2}[0-9]{2}"), "iban")
        .when(~_has(mention, "^[0-9+(]"), "name")
        .when(_has(mention, r"^[0-9]+(?:\.[0-9]+){3}$"), "ip")
        .when(_has(mention, r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(_has(mention, r"^[0-9]") & (digits > 12), "card")
        .otherwise("phone")
    )


def _gender(honorifics: Column, given: Column) -> Column:
    any_of = lambda words: rf"(?:^| )(?:{'|'.join(words)})\.? "
    return (
        F.when(_has(honorifics, any_of(MALE)), "m").when(_has(honorifics, any_of(FEMALE)), "f")
        .when(F.lower(given).isin(*GIVEN_MALE), "m").when(F.lower(given).isin(*GIVEN_FEMALE), "f").otherwise("u")
    )


def _name_parts(mention: Column) -> tuple[Column, Column]:
    """The honorifics, with the space after them, and the words of the name."""
    honorifics = F.regexp_extract(mention, f"^{_HONORIFICS}", 0)
    return honorifics, F.split(F.substring(mention, F.length(honorifics) + 1, F.length(mention)), " ")


def _script(word: Column) -> Column:
    return F.when(_has(word, r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _key(kind: Column | str, norm: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(_SEPARATOR), norm)


def entity_keys(mention: Column) -> Column:
    """The entities in a mention: kind and normal form, joined. A name has one for each word that is no particle."""
    return F.filter(_keys(mention), lambda k: k.isNotNull())


def _keys(mention: Column) -> Column:
    """The entities in a mention; those of a name stand at the places of its words, with nulls for particles."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    country = F.regexp_extract(mention, r"^\+([0-9]{1,3}?)(?=[ .(-])", 1)
    honorifics, words = _name_parts(mention)
    named = F.transform(
        words,
        lambda w, i: F.when(~w.isin(*PARTICLES), _key(F.concat_ws("-", F.when((i == 0) & (F.size(words) > 1), "given").otherwise("surname"), _script(w)), F.lower(w))),
    )
    account = F.regexp_replace(mention, " ", "")
    kind = kind_of(mention)
    return (
        F.when(kind == "name", named)
        .when(kind == "email", F.array(_key("email", F.lower(mention))))
        .when(kind == "ip", F.array(_key("ip", mention)))
        .when(kind == "ipv6", F.array(_key("ipv6", _groups(mention))))
        .when(kind == "iban", F.when(_mod97(F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))) == 1, F.array(_key("iban", account))).otherwise(F.array().cast("array<string>")))
        .when(kind == "phone", F.array(_key("phone", F.concat(country, F.lit("-"), F.substring(digits, F.length(country) + 1, F.length(digits))))))
        .when((kind == "card") & (_luhn_sum(digits, 1) % 10 != 0), F.array().cast("array<string>"))  # a number, but no card
        .otherwise(F.array(_key(kind, digits)))
    )


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The sum of the digits from the right, every other one doubled (with its digits added up)."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == doubled, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int")),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of digits and letters, a letter counting as the number from 10 to 35 it stands for."""
    return F.aggregate(
        F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(_has(c, "[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    )


def _groups(address: Column) -> Column:
    """The eight groups of an IPv6 address, in lower case, without leading zeros."""
    sides = F.split(F.lower(address), "::")
    left, right = (F.filter(F.split(F.coalesce(F.try_element_at(sides, F.lit(i)), F.lit("")), ":"), lambda g: g != "") for i in (1, 2))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def surrogate(key: Column, attempt: Column, secret: str) -> Column:
    """The surrogate's normal form for an entity key; names are without their endings."""
    parts = F.split(key, _SEPARATOR)
    kind, norm = F.element_at(parts, 1), F.element_at(parts, 2)
    h = F.sha2(F.concat(F.lit(secret + _SEPARATOR), key, F.lit(_SEPARATOR), attempt.cast("string"), F.lit(_SEPARATOR + secret)), 256)
    digit = F.translate(h, "abcdef", "012345")
    byte = lambda k: F.conv(F.substring(h, 4 * k + 1, 4), 16, 10).cast("int")
    text = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in c))

    country = F.element_at(F.split(norm, "-"), 1)
    rest = F.length(F.element_at(F.split(norm, "-"), 2))
    phone = text(country, "-", F.translate(F.substring(digit, 1, 1), "01", "23"), F.substring(digit, F.lit(2), rest - 1))
    ip = text(byte(0) % 223 + 1, ".", byte(1) % 256, ".", byte(2) % 256, ".", byte(3) % 254 + 1)
    ssn = text("9", F.substring(digit, 1, 8))

    body = text(F.substring(norm, 1, 1), F.substring(digit, F.lit(1), F.length(norm) - 2))
    check = (10 - _luhn_sum(body, 0) % 10) % 10
    valid = _luhn_sum(norm, 1) % 10 == 0
    card = text(body, F.when(valid, check).otherwise((check + 1 + F.substring(digit, 40, 1).cast("int") % 9) % 10))

    local = F.regexp_extract(norm, "^(.*)@", 1)
    at = lambda s, i: F.substring(s, i % 64 + 1, F.lit(1))
    latin, cyrillic = F.translate(h, _HEX, _CONSONANTS), F.translate(h, _HEX, _CYRILLIC_CONSONANTS)
    written = F.array_join(
        F.transform(
            F.split(local, ""),
            lambda c, i: F.when(_has(c, "[0-9]"), at(digit, i)).when(_has(c, "[._%+-]"), c).when(_has(c, r"\p{IsCyrillic}"), at(cyrillic, i)).otherwise(at(latin, i)),
        ),
        "",
    )
    filler = F.substring(F.reverse(latin), F.lit(1), F.greatest(F.lit(0), 8 - F.length(local)) + attempt)
    domain = F.regexp_extract(norm, "@(.*)$", 1)
    host = F.substring(F.sha2(text(secret, _SEPARATOR, "domain", _SEPARATOR, domain), 256), 1, 8)
    top = F.regexp_extract(domain, r"\.(com|org|net)$", 1)
    email = text(written, filler, "@m", host, ".example.", F.when(top == "", "org").otherwise(top))

    def word(pattern: str, consonants: str, vowels: str) -> Column:
        letter = lambda p, i: F.translate(F.substring(h, i, F.lit(1)), _HEX, consonants if p == "c" else vowels)
        more = F.transform(F.sequence(F.lit(1), F.least(attempt, F.lit(SYLLABLES))), lambda i: F.concat(letter("c", 2 * i + 6), letter("v", 2 * i + 7)))
        longer = F.when(attempt > 0, F.array_join(more, "")).otherwise("")
        return F.concat(longer, *(letter(p, F.lit(i + 1)) for i, p in enumerate(pattern)))

    ipv6 = text("2001:db8", *(x for i in range(6) for x in (":", F.regexp_replace(F.substring(h, 4 * i + 1, 4), "^0+(?=.)", ""))))
    body = F.array_join(F.transform(F.split(F.substring(norm, F.lit(5), F.length(norm)), ""), lambda c, i: F.when(_has(c, "[0-9]"), at(digit, i)).otherwise(F.upper(at(latin, i)))), "")
    country = F.substring(norm, 1, 2)
    iban = text(country, F.lpad((98 - _mod97(text(body, country, "00"))).cast("string"), 2, "0"), body)

    out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "ipv6", ipv6).when(kind == "iban", iban)
    for name, pattern in (("given-latin", "cvcvc"), ("given-cyrillic", "cvcvc"), ("surname-latin", "cvcvcvc"), ("surname-cyrillic", "cvcvc")):
        out = out.when(kind == name, word(pattern, *((_CYRILLIC_CONSONANTS, _CYRILLIC_VOWELS) if name.endswith("cyrillic") else (_CONSONANTS, _VOWELS))))
    return out


#: Endings by kind: of given names for f, m and u, of Cyrillic surnames for those that end in а or я, in another vowel, and others.
ENDINGS = {"given-latin": ("a", "", "e"), "given-cyrillic": ("а", "", "е"), "surname-cyrillic": ("ова", "ко", "ов")}


def endings(key: Column) -> Column:
    """All endings that a surrogate of this entity may take."""
    kind = F.element_at(F.split(key, _SEPARATOR), 1)
    out = F.array(F.lit(""))
    for name, ends in ENDINGS.items():
        out = F.when(kind == name, F.array(*map(F.lit, ends))).otherwise(out)
    return out


def _ending(key: Column, gender: Column) -> Column:
    parts = F.split(key, _SEPARATOR)
    kind, norm = F.element_at(parts, 1), F.element_at(parts, 2)
    out = F.lit("")
    for name, ends in ENDINGS.items():
        first, second = (_has(norm, "[ая]$"), _has(norm, "[оеиуюыэё]$")) if name.startswith("surname") else (gender == "f", gender == "m")
        out = F.when(kind == name, F.when(first, ends[0]).when(second, ends[1]).otherwise(ends[2])).otherwise(out)
    return out


def _cased(surrogate_word: Column, original: Column) -> Column:
    return F.when((original == F.upper(original)) & (original != F.lower(original)) & ~_has(original, r"^.\.?$"), F.upper(surrogate_word)).otherwise(surrogate_word)


def render(mention: Column, surrogates: Column) -> Column:
    """The mention with the surrogates of its entities, in the order of _keys, in place of them."""
    first = F.try_element_at(surrogates, F.lit(1))
    digits = F.regexp_replace(first, "[^0-9]", "")
    chars = F.split(mention, "")
    # The n-th digit of the mention becomes the n-th of the surrogate.
    replaced = F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(
                _has(c, "[0-9]"), F.substring(digits, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))
            ).otherwise(c),
        ),
        "",
    )
    honorifics, words = _name_parts(mention)
    named = F.concat(honorifics, F.array_join(F.zip_with(words, surrogates, lambda w, x: F.when(x.isNull(), w).otherwise(_cased(F.initcap(x), w))), " "))
    kind = kind_of(mention)
    account = F.array_join(
        F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(first, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), " ", "")), F.lit(1)))), ""
    )
    return F.when(F.size(surrogates) == 0, mention).when(kind == "ipv6", _cased(first, mention)).when(kind == "iban", account).when(kind == "name", named).when(kind == "email", _cased(first, mention)).when(kind == "ip", first).otherwise(replaced)


def mentions(text: Column) -> Column:
    """All mentions in order; an empty array for null texts."""
    return F.when(text.rlike(HINT), _all(text)).otherwise(F.array().cast("array<string>"))


def _all(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def settled_attempts(keys: DataFrame, secret: str, work: Workspace) -> DataFrame:
    """(entity, attempt) of the entities whose first surrogate is taken; ``keys`` has distinct entities."""
    made = lambda df: df.withColumn("s", _key(F.element_at(F.split("entity", _SEPARATOR), 1), surrogate(F.col("entity"), F.col("attempt"), secret)))
    table = work.save(made(keys.withColumn("attempt", F.lit(0))).withColumn("settled", F.lit(False)))
    real = keys.select(F.col("entity").alias("form"))
    for _ in range(ATTEMPTS):
        # One of those that share a surrogate keeps it, a settled one if there is one; nobody keeps a real one.
        holder = table.groupBy("s").agg(F.min(F.struct(~F.col("settled"), "entity"))["entity"].alias("holder"))
        forms = table.where("not settled").select("entity", F.explode(F.transform(endings(F.col("entity")), lambda e: F.concat("s", e))).alias("form"))
        taken = forms.join(real, "form", "left_semi").select("entity").distinct().withColumn("taken", F.lit(True))
        judged = table.join(holder, "s").join(taken, "entity", "left")
        judged = judged.withColumn("settled", (F.col("holder") == F.col("entity")) & F.col("taken").isNull())
        following = work.save(judged.select("entity", "attempt", "s", "settled"))
        work.drop(table)
        table = following
        if table.where("not settled").isEmpty():
            return table.where("attempt > 0").select("entity", "attempt")
        table = made(table.select("entity", (F.col("attempt") + F.when(F.col("settled"), 0).otherwise(1)).alias("attempt"), "settled"))
        table = work.save(table.select("entity", "attempt", "s", "settled"))
    raise RuntimeError("the surrogates of some kind are exhausted")


def replace_personal_data(docs: DataFrame, secret: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """All columns of ``docs``, the text rewritten; ``count_col`` names an added count of mentions."""
    work = Workspace(docs.sparkSession, "pii")
    names = {c.lower() for c in docs.columns}
    body, tries = (next(n for n in (f"_{x}{i}" for i in range(len(names) + 1)) if n not in names) for x in ("body", "tries"))
    text = F.col(f"`{text_col}`")
    found = docs.select(F.explode(mentions(text)).alias("m")).select(F.explode(entity_keys(F.col("m"))).alias("entity"))
    keys = work.save(found.distinct())
    again = work.save(settled_attempts(keys, secret, work))
    if again.isEmpty():
        attempts = F.create_map().cast("map<string,int>")
        rows = docs
    else:
        # By the text, so that copies share a row, and rows without an id are as many groups as they have texts.
        of_text = work.save(
            docs.select(F.sha2(text, 256).alias(body), F.explode(F.array_distinct(F.flatten(F.transform(mentions(text), entity_keys)))).alias("entity"))
            .join(again, "entity").groupBy(body).agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias(tries))
        )
        few = of_text.count() <= BROADCAST_TEXTS
        rows = docs.withColumn(body, F.sha2(text, 256)).join(F.broadcast(of_text) if few else of_text, body, "left")
        attempts = F.coalesce(F.col(tries), F.create_map().cast("map<string,int>"))
    gaps = F.split(text, ANY, -1)

    def one(m: Column) -> Column:
        honorifics, words = _name_parts(m)
        gender = _gender(honorifics, F.element_at(words, 1))
        made = lambda k: F.concat(surrogate(k, F.coalesce(F.try_element_at(attempts, k), F.lit(0)), secret), _ending(k, gender))
        return render(m, F.transform(_keys(m), made))

    filled = F.concat(F.transform(_all(text), one), F.array(F.lit("")))
    written = F.array_join(F.zip_with(gaps, filled, lambda g, r: F.concat(g, r)), "")
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {text_col: F.when(text.rlike(HINT), written).otherwise(text).alias(text_col)}
    number = F.size(F.filter(_all(text), lambda m: F.size(entity_keys(m)) > 0))
    extra = [F.when(text.rlike(HINT), number).otherwise(0).cast("long").alias(count_col)] if count_col else []
    return rows.select(*out.values(), *extra)
