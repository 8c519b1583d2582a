"""Personal data and secrets replaced by keyed surrogates, with DataFrame functions only.

Mentions are found by pattern, reduced to entities (one canonical form each), and every
distinct entity gets a surrogate of the same kind, script, gender and format from a keyed
hash. Surrogates that meet each other or a real entity are drawn again until none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.session import materialise

#: Titles by the gender they state.
TITLES = {"m": ["Mr", "Mister", "Sir", "Herr", "Señor", "Monsieur", "Господин"],
          "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "Госпожа"],
          "u": ["Dr", "Prof", "Professor"]}
#: Given names by gender and script, to recognise.
GIVEN = {
    ("f", "latin"): ["Alice", "Anna", "Barbara", "Carla", "Carmen", "Clara", "Diana", "Elena", "Emma", "Eva", "Greta",
                     "Hanna", "Ida", "Irene", "Julia", "Laura", "Lucia", "Maria", "Marta", "Nina", "Olga", "Paula",
                     "Sarah", "Sofia"],
    ("m", "latin"): ["Adam", "Albert", "Anton", "Bruno", "Carlos", "Daniel", "David", "Diego", "Emil", "Felix", "George",
                     "Henry", "Hugo", "Jacob", "James", "John", "Karl", "Louis", "Martin", "Oscar", "Paul", "Peter",
                     "Robert", "Thomas"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Денис", "Иван", "Кирилл", "Михаил", "Олег", "Павел", "Сергей"],
}
#: Parts that surrogate given names are made of, by script and gender: first and second syllable, ending. There are
#: thousands of each kind, none chosen from the names that are looked for.
SYLLABLES = {"latin": [c + v for c in "BDFGKLMNPRSTVZ" for v in "aeiou"],
             "cyrillic": [c + v for c in "БВГДЗКЛМНПРСТФ" for v in "аеиоу"]}
ENDINGS = {("f", "latin"): ["la", "na", "ria", "sa", "tha", "vina", "bella", "dra"],
           ("m", "latin"): ["n", "r", "rd", "lo", "mus", "ton", "rik", "s"],
           ("f", "cyrillic"): ["ла", "на", "рия", "са", "ра", "вина"],
           ("m", "cyrillic"): ["н", "р", "слав", "мир", "тон", "рил"]}
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_ALL_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
#: One word of a name, without a closing 's; never a title. Possessive, so long runs of letters need no stack.
_NAME = rf"(?!(?:{_TITLE})(?!\p{{L}}))\p{{Lu}}(?:\p{{L}}++|['’-](?!s(?!\p{{L}}))\p{{L}}++)++"
#: Further words of a name, single letters between them.
_MORE = rf"(?:(?: \p{{Lu}}(?!\p{{L}})\.?)*+ {_NAME})"
_RUN = rf"(?:\p{{Lu}}\.? )*+{_NAME}{_MORE}*+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: What tokens of well-known services begin with.
_TOKEN = r"AKIA|gh[pousr]_|github_pat_|xox[abprs]-|sk-"
#: Kinds in the order in which they are tried; each pattern matches a whole mention, that of names a run of words, each
#: of which is a mention.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": r"(?<=(?i:password|passwd|token|secret|api[_-]?key)[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?)[A-Za-z0-9_+/=~.-]{7,}[A-Za-z0-9_+/=~-]"
              r"|(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
              r"|(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{30,}+|github_pat_[A-Za-z0-9_]{22,}+|xox[abprs]-[A-Za-z0-9-]{10,}+"
              r"|sk-[A-Za-z0-9_-]{20,}+)"
              r"|(?<=-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)[A-Za-z0-9+/=\s]{40,}+(?=-----END)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?<!(?i:\bv|version|release|build)[ ]?){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
          rf"|(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{{0,39}}[0-9])(?:(?:{_HEX}:){{7}}{_HEX}"
          rf"|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "phone": r"\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
             r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
             r"|(?<![0-9.,+-])0[0-9]{2,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9]|[ -][0-9])"
             r"|(?<![0-9])\([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": rf"(?=\p{{Lu}})(?:(?<=(?<!\p{{L}})(?:{_TITLE})\.? ){_RUN}|(?<!\p{{L}})(?:{_ALL_GIVEN}){_MORE}++)",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A cheap sign that a text may hold a mention at all: every text that a pattern of KINDS matches has it.
_SIGN = rf"[0-9@]|{_TOKEN}|PRIVATE KEY-----|(?i:password|passwd|token|secret|api[_-]?key)|(?<!\p{{L}})(?:{_TITLE}|{_ALL_GIVEN})(?!\p{{L}})"
#: Letters and digits that replace one another: name of the script, first and last code point of a run.
RUNS = [("digit", 0x30, 0x39), ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("cyrillic", 0x410, 0x42F),
        ("cyrillic", 0x430, 0x44F), ("greek", 0x391, 0x3A1), ("greek", 0x3B1, 0x3C1), ("hebrew", 0x5D0, 0x5EA),
        ("arabic", 0x641, 0x64A), ("devanagari", 0x915, 0x939), ("hiragana", 0x3042, 0x3082), ("katakana", 0x30A2, 0x30E2),
        ("han", 0x4E00, 0x9FA5), ("hangul", 0xAC00, 0xD7A3)]


#: The form of a card number.
_CARD = r"^[0-9]{4}([ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}$"


def _kind(mention: Column) -> Column:
    """The kind of a mention by its own form (patterns that look around are told by exclusion)."""
    found = F.when(mention.contains("@"), "email")
    found = found.when(mention.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]+$"), "ip")
    found = found.when(mention.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    found = found.when(mention.rlike(r"^[+(]|^0[0-9]{2,4}[ -][0-9 -]+$|^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), "phone")
    found = found.when(mention.rlike(_CARD), "card")
    found = found.when(mention.rlike(r"^[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4} ?[A-Z0-9]{4}"), "iban")
    found = found.when(mention.rlike(rf"^(?:{_TOKEN})"), "secret")
    return found.when(mention.rlike(rf"^{_NAME}$") & ~mention.rlike(r"[0-9]"), "name").otherwise("secret")


def _canonical(kind: Column, mention: Column) -> Column:
    """Spellings of one entity fall together: case of addresses, separators of numbers."""
    return F.when(kind == "email", F.lower(mention)).when(
        kind.isin("phone", "card", "ssn", "iban"), F.regexp_replace(mention, r"[^A-Za-z0-9]", "")).when(
        (kind == "ip") & mention.contains(":"), F.lower(mention)).otherwise(mention)


def _drawn(seed: Column, place: Column, size: Column) -> Column:
    return F.pmod(F.xxhash64(seed, place), size.cast("bigint"))


def _letters(value: Column, seed: Column) -> Column:
    """Each letter or digit replaced by one of its own run; vowels stay vowels; other characters stay."""
    def one(c: Column, i: Column) -> Column:
        code = F.unicode(c) if hasattr(F, "unicode") else F.ascii(c)
        out = F.when(c.rlike("[aeiou]"), F.substr(F.lit("aeiou"), (_drawn(seed, i, F.lit(5)) + 1).cast("int"), F.lit(1)))
        out = out.when(c.rlike("[AEIOU]"), F.substr(F.lit("AEIOU"), (_drawn(seed, i, F.lit(5)) + 1).cast("int"), F.lit(1)))
        for lower, upper in (("bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ"),):
            for own in (lower, upper):
                out = out.when(c.rlike(f"[{own}]"), F.substr(
                    F.lit(own), (_drawn(seed, i, F.lit(len(own))) + 1).cast("int"), F.lit(1)))
        out = out.when(c.rlike("[0-9]"), _drawn(seed, i, F.lit(10)).cast("string"))
        for _, first, last in RUNS[3:]:
            out = out.when((code >= first) & (code <= last), _code_text(first + _drawn(seed, i, F.lit(last - first + 1))))
        lower = F.lower(c) == c
        accented = c.rlike(r"\p{IsLatin}")
        return out.when(accented, F.when(lower, F.char(F.lit(97) + _drawn(seed, i, F.lit(26)))).otherwise(
            F.char(F.lit(65) + _drawn(seed, i, F.lit(26))))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _code_text(code: Column) -> Column:
    """The character of a code point, by its UTF-16 form."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 4, "0")), "UTF-16BE")


def _luhn(digits: Column) -> Column:
    """The check digit that makes ``digits`` followed by it a valid card number."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(
        i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return ((10 - F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def _is_mention(match: Column) -> Column:
    """Whether what has the form of a card number also has its check digit; true of other forms."""
    digits = F.regexp_replace(match, "[ -]", "")
    return F.when(match.rlike(_CARD), F.substring(digits, -1, 1) == _luhn(
        F.substr(digits, F.lit(1), F.length(digits) - 1))).otherwise(True)


def _groups(value: Column, seed: Column) -> Column:
    """Another hexadecimal digit for each, none of them zero where a group begins."""
    def one(c: Column, i: Column) -> Column:
        return F.when(c == ":", c).otherwise(F.substr(
            F.lit("123456789abcdef"), (_drawn(seed, i, F.lit(15)) + 1).cast("int"), F.lit(1)))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _given(seed: Column, value: Column) -> Column:
    """A given name of the same gender and script, made of syllables; null when the value is no known given name."""
    def part(place: int, choices: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, choices)), (_drawn(seed, F.lit(place), F.lit(len(choices))) + 1).cast("int"))

    out = F.lit(None).cast("string")
    for (gender, script), names in GIVEN.items():
        made = F.concat(part(0, SYLLABLES[script]), F.lower(part(1, SYLLABLES[script])), part(2, ENDINGS[gender, script]))
        out = F.when(value.isin(names), made).otherwise(out)
    return out


def _octets(value: Column, seed: Column, attempt: Column) -> Column:
    """Four numbers of as many digits each (after eight draws, of any)."""
    def one(x: Column, i: Column) -> Column:
        least = F.when(attempt >= 8, 1).when(F.length(x) == 1, 1).when(F.length(x) == 2, 10).otherwise(100)
        size = F.when(attempt >= 8, 254).when(F.length(x) == 1, 9).when(F.length(x) == 2, 90).otherwise(155)
        return (least + _drawn(seed, i, size)).cast("string")

    return F.array_join(F.transform(F.split(value, r"\."), one), ".")


def _surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """What stands for an entity at a given draw: a function of the key, the kind, the entity and the draw."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")), 256)
    mixed = _letters(value, seed)
    head = F.substring(mixed, 1, 1)
    first = F.substring(value, 1, 1)
    number = F.concat(first, F.substr(mixed, F.lit(2), F.length(value) - 2))
    domain = F.concat(F.regexp_extract(mixed, r"^(.*)\.[^.]*$", 1), F.lit("."), F.regexp_extract(value, r"([^.]*)$", 1))
    phone = F.concat(first, F.when(F.substring(mixed, 2, 1) == "0", "7").otherwise(F.substring(mixed, 2, 1)),
                     F.substr(mixed, F.lit(3), F.length(value)))
    # as many hexadecimal digits as asked for
    more = F.transform(F.sequence(F.lit(2), F.ceil(F.length(value) / 64).cast("int") + 2),
                       lambda i: F.sha2(F.concat(seed, i.cast("string")), 256))
    mark = F.regexp_extract(value, rf"^(?:{_TOKEN})", 0)
    given = _given(seed, value)
    name = F.when(given.isNotNull(), given).when(
        value.rlike(r"^\p{IsCyrillic}") & value.rlike("(ова|ева|ина|ая)$"),
        F.concat(F.substr(mixed, F.lit(1), F.length(value) - 3), F.substr(value, F.length(value) - 2, F.lit(3)))).otherwise(mixed)
    return (F.when(kind == "email", domain).when(kind == "ip", F.when(
                value.contains(":"), _groups(value, seed)).otherwise(_octets(value, seed, attempt)))
            .when(kind == "card", F.concat(number, _luhn(number))).when(kind == "phone", phone)
            .when(kind == "iban", F.concat(F.substring(value, 1, 2), F.substr(mixed, F.lit(3), F.length(value))))
            .when(kind == "name", name).when((kind == "secret") & (mark != ""), F.concat(
                mark, F.substr(mixed, F.length(mark) + 1, F.length(value))))
            .when((kind == "secret") & value.rlike("^[0-9a-f]+$"), F.substr(
                F.concat(seed, F.array_join(more, "")), F.lit(1), F.length(value)))
            .when(kind == "ssn", F.concat(F.lit("9"), F.substr(mixed, F.lit(2), F.length(value))))
            .otherwise(F.concat(head, F.substr(mixed, F.lit(2), F.length(value)))))


def _in_format(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate with the separators and the letter case of the mention."""
    def one(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), r"[^A-Za-z0-9]", ""))
        return F.when(c.rlike("[A-Za-z0-9]"), F.substr(surrogate, before, F.lit(1))).otherwise(c)

    spaced = F.array_join(F.transform(F.split(mention, ""), one), "")
    upper = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spaced).when(
        (kind == "email") & upper, F.upper(surrogate)).otherwise(surrogate)


def entity_surrogates(entities: DataFrame, key: str, most_rounds: int = 64) -> DataFrame:
    """``kind, value, surrogate, attempt`` for distinct entities (``kind, value``).

    Surrogates are distinct within a kind and none is an entity of that kind. Of entities that meet, the least keeps
    the draw; the others, and those that meet an entity, draw again. After ``most_rounds`` the rest get a suffix from
    their hash, which gives up the format for distinctness.
    """
    now = materialise(entities.distinct().withColumn("attempt", F.lit(0)).withColumn(
        "surrogate", _surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)), "pii-surrogates")
    for round_ in range(most_rounds + 1):
        first = now.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"), F.count("*").alias("n"))
        real = now.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        clash = first.join(real, ["kind", "surrogate"], "left").where("n > 1 or real")
        if clash.isEmpty():
            break
        marked = now.join(clash.select("kind", "surrogate", "owner", "real"), ["kind", "surrogate"], "left")
        again = F.col("owner").isNotNull() & (F.coalesce("real", F.lit(False)) | (F.col("owner") != F.col("value")))
        redrawn = _surrogate(F.col("kind"), F.col("value"), F.col("attempt") + 1, key)
        if round_ >= most_rounds - 1:
            redrawn = F.concat("surrogate", F.substring(F.sha2(F.concat(F.lit(key), "kind", "value"), 256), 1, 12))
        now = materialise(marked.select(
            "kind", "value", F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"),
            F.when(again, redrawn).otherwise(F.col("surrogate")).alias("surrogate")), "pii-surrogates")
    return now


def _words(match: Column) -> Column:
    """The mentions of a match: the words of a run of names, any other match as it is."""
    return F.when(match.contains(" ") & match.rlike(rf"^{_RUN}$"), F.filter(
        F.split(match, " "), lambda w: w.rlike(rf"^{_NAME}$"))).otherwise(F.array(match))


def _instead(match: Column, instead: Column) -> Column:
    """A match with its mentions replaced; single letters within a run of names stay."""
    return F.coalesce(F.element_at(instead, match), F.array_join(F.transform(
        F.split(match, " "), lambda w: F.coalesce(F.element_at(instead, w), w)), " "))


def _pieces(word: Column, names: Column) -> Column:
    """A capitalised word whole if it is one of ``names``, else what lies between its hyphens and apostrophes, and these."""
    return F.when(F.map_contains_key(names, word) | ~word.rlike("['’-]"), F.array(word)).otherwise(
        F.regexp_extract_all(word, F.lit(r"\p{L}+|\P{L}"), F.lit(0)))


def _later(part: Column, names: Column) -> Column:
    """``said, n`` of a text between matches: bare words that are one of ``names`` replaced, and how many they are."""
    bare = rf"(?<!\p{{L}}){_NAME}"
    words = F.transform(F.regexp_extract_all(part, F.lit(bare), F.lit(0)), lambda w: _pieces(w, names))
    said = F.transform(words, lambda ps: F.array_join(F.transform(ps, lambda p: F.coalesce(F.element_at(names, p), p)), ""))
    n = F.size(F.filter(F.flatten(words), lambda p: F.map_contains_key(names, p)))
    return F.struct(_woven(F.split(part, bare, -1), said).alias("said"), n.alias("n"))


def _woven(parts: Column, between: Column) -> Column:
    """Part, what stands between, part, ...: one more part than there is between."""
    return F.array_join(F.transform(F.arrays_zip(parts.alias("part"), F.concat(between, F.array(F.lit(""))).alias("said")),
                                    lambda z: F.concat(z["part"], z["said"])), "")


def replace_personal_data(docs: DataFrame, key: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``id, text`` with surrogates, ``n_mentions, n_entities, kinds``.

    ``kinds`` lists the kinds found, sorted. The same entity has the same surrogate in all texts, different ones
    different surrogates; a surname alone and after a given name agree. After a title or a listed given name all
    capitalised words that follow are names, and a name of a text is replaced wherever it stands as a word in that text.
    A null text stays null without mentions; texts
    without mentions are unchanged. Repeated rows and equal texts are replaced alike; an empty table gives no rows;
    further columns are not read. Originals of mentions appear in
    no output column; the README lists names that are not found.
    """
    body = F.col(text).cast("string")
    found = F.when(body.rlike(_SIGN), F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))
    tagged = docs.select(F.col(id).alias("id"), body.alias("body"), F.coalesce(
        found, F.array().cast("array<string>")).alias("found"))
    tagged = materialise(tagged.withColumn("said", F.filter(
        F.flatten(F.transform("found", _words)), _is_mention)), "pii-found")
    spread = F.size("said") > 0
    row = F.md5(F.concat_ws("\x1f", F.col("id").cast("string"), "body"))
    mentions = tagged.where(spread).select(row.alias("row"), F.explode(F.array_distinct("said")).alias("mention"))
    kind = _kind(F.col("mention"))
    known = materialise(mentions.select("mention").distinct().withColumn("kind", kind).withColumn(
        "value", _canonical(F.col("kind"), F.col("mention"))), "pii-mentions")
    stands = entity_surrogates(known.select("kind", "value"), key)
    replaced = known.join(stands, ["kind", "value"]).select(
        "mention", "kind", "value", _in_format(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("instead"))
    own = mentions.join(replaced, "mention").groupBy("row").agg(
        F.map_from_entries(F.collect_set(F.struct("mention", "instead"))).alias("instead"),
        F.map_from_entries(F.collect_set(F.when(F.col("kind") == "name", F.struct("mention", "instead")))).alias("names"),
        F.count_distinct("kind", "value").alias("n_entities"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    # part, surrogate, part, ... ; the patterns run once over a text here, that of bare names over texts that hold a name
    parts = F.split("body", ANY, -1)
    later = F.when(F.size("names") > 0, F.transform(parts, lambda p: _later(p, F.col("names")))).otherwise(
        F.transform(parts, lambda p: F.struct(p.alias("said"), F.lit(0).alias("n"))))
    shown = F.transform("found", lambda m: _instead(m, F.col("instead")))
    n_found = F.size("said")
    n_later = F.aggregate("later.n", F.lit(0), lambda a, x: a + x)
    changed = tagged.where(spread).withColumn("row", row).join(own, "row").withColumn("later", later).select(
        "id", _woven(F.col("later.said"), shown).alias("text"), (n_found + n_later).cast("long").alias("n_mentions"),
        "n_entities", "kinds")
    same = tagged.where(~spread).select(
        "id", F.col("body").alias("text"), F.lit(0).cast("long").alias("n_mentions"),
        F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return same.union(changed).select(F.col("id").alias(id), F.col("text"), "n_mentions", "n_entities", "kinds")
