"""Surrogates for personal data, in DataFrame functions only.

Detected are e-mail addresses, IPv4 addresses, card, phone, social security and IBAN numbers, secrets (access keys, values of
`password=` and `token = "..."` in any case and of any length) and persons named behind a title (in its usual case or all
upper), with any number of given names and with particles. In a text that names a person so, every other mention of one of
the names is found too, with a title or without. A match is taken apart into values of a kind: an address into its local part
and its domain, a person into title, given names and surname. Each value is replaced by a function of a secret key, its kind and
itself, so equal values have equal surrogates everywhere (Mr John Doe, Mr Doe and DOE share a surname). Surrogates keep the
format: letters stay letters of the same script and case, digits digits, separators, hyphens and apostrophes where they are;
addresses stay in range, a card keeps its first digit and whether its check digit is right, an IBAN its country and whether
its check digits are right, a given name follows the title's gender.

Distinctness is checked over the whole corpus: a surrogate may not equal a value of its kind that occurs, nor the surrogate of
another value; of values that collide the smallest keeps its surrogate and the others try again with the next attempt number.
A name has a syllable more at each attempt, other values have more characters from the fifth on, so the space of surrogates
grows with the values that have to share it.

Values are extracted once, for each distinct text that has any. Texts without a match are never shuffled; the others meet their
surrogates by a hash of the text. A value or text that a good part of all rows hold is spread over tasks (`salted_join`).

The key: the argument, else the session's `spark.millrace.surrogates.key`, else a random one that is drawn for the session.

Defined cases: null text stays null; a text without a match stays as it is; all other columns are kept as they are, whatever
their names; an empty table gives one; rows with equal text are rewritten alike; where there is a column `_n_values` already, the count's name
gets a further underscore in front.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, fresh_names, salted_join, written

KEY_SETTING = "spark.millrace.surrogates.key"
#: The key of the query over the test tables, whose rows must be the same in every run. Not for other data.
QUERY_KEY = "test tables"
#: Titles that tell a person's gender, and titles that don't (fixed values).
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Signor", "Sir", "господин", "κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Signora", "госпожа", "κυρία"]
NEUTRAL = ["Dr", "Prof", "Professor", "Doctor", "Mx", "Dra", "Docteur", "CEO", "CFO", "CTO", "President", "доктор", "профессор"]
#: Lower-case words inside a surname (fixed values).
PARTICLES = ["van", "von", "de", "der", "den", "del", "della", "di", "da", "dos", "la", "le", "ter", "zu", "bin", "al"]
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
TITLES = sorted({t for x in MALE + FEMALE + NEUTRAL for t in (x, x.upper())}, key=lambda t: (-len(t), t))
_NAME = r"(?=\p{Lu}['’]?\p{L})\p{Lu}\p{L}*+(?:[-'’](?=\p{Lu}|\p{L}{3})\p{L}++){0,5}"
_MORE = rf"(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_NAME})"
_TITLE = rf"(?<!\p{{L}})(?:{'|'.join(TITLES)})\.? "
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PARTS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}(?![A-Za-z0-9-])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "card": r"(?<![\d])(?:\d{13,16}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\d])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=(?i:password)=)[^\s\"',;]{4,}+|(?<=(?i:token) = \")[0-9A-Za-z_.-]{8,}+",
    "person": rf"{_TITLE}{_NAME}{_MORE}{{0,5}}",
}
PATTERN = "|".join(PARTS.values())
PERSON = PARTS["person"]
#: For texts that name a person: each capitalised word (group 1) is a candidate mention.
WITH_WORDS = rf"{PATTERN}|(?<![\p{{L}}'’-])({_NAME})"
NAMES = ["given_f", "given_m", "given", "surname"]


def _same(text: Column, pattern: str) -> Column:
    return text.rlike(rf"^(?:{pattern})$")


def _piece(kind: str | Column, raw: Column, value: Column | None = None) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (raw if value is None else value).alias("value"), raw.alias("raw"))


def values_of(match: Column, is_word: Column | None = None) -> Column:
    """A match as an array of (kind, value, raw): values are what is replaced, raw is how they stand here. Kind `keep` stays as it
    is, `word` may be a mention of a name that the text gives a person."""
    if is_word is not None:
        return F.when(is_word, F.array(_piece("word", match, F.lower(match)))).otherwise(values_of(match))
    title = F.regexp_extract(match, f"^{_TITLE}", 0)
    bare = F.lower(F.regexp_replace(title, r"[. ]", ""))
    gender = F.when(bare.isin([t.lower() for t in FEMALE]), "given_f").when(bare.isin([t.lower() for t in MALE]), "given_m").otherwise("given")
    words = F.split(F.substr(match, F.length(title) + 1), " ", -1)

    def named(word: Column, i: Column) -> Column:
        particle = ~word.rlike(r"^\p{Lu}")
        kind = F.when(particle, "keep").when(i == F.size(words) - 1, "surname").otherwise(gender)
        one = _piece(kind, word, F.when(particle, word).otherwise(F.lower(word)))
        return F.when(i == 0, F.array(one)).otherwise(F.array(_piece("keep", F.lit(" ")), one))

    person = F.concat(F.array(_piece("keep", title)), F.flatten(F.transform(words, named)))
    local, domain = F.lower(F.substring_index(match, "@", 1)), F.lower(F.substring_index(match, "@", -1))
    out = F.when(F.length(title) > 0, person).when(_same(match, PARTS["email"]), F.array(_piece("local", local), _piece("keep", F.lit("@")), _piece("domain", domain)))
    for kind in ("ip", "card", "ssn", "phone", "iban"):
        # context is cut off from the match, so only the shape is asked for here
        out = out.when(_same(match, PARTS[kind]), F.array(_piece(kind, match)))
    return out.otherwise(F.array(_piece("secret", match)))


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """128 hexadecimal digits that depend on all four."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), value)
    return F.concat(F.sha2(F.concat(seed, F.lit("\x1f1")), 256), F.sha2(F.concat(seed, F.lit("\x1f2")), 256))


def _draw(stream: Column, i: Column) -> Column:
    """A number from 0 to 65535, of the i-th place of the stream."""
    return F.conv(F.substr(stream, F.pmod(i * 4, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int")


def _pick(letters: str, number: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(number, F.lit(len(letters))) + 1, F.lit(1))


def _characters(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), 0)


def _shaped(value: Column, stream: Column, attempt: Column) -> Column:
    """Letters for letters of the same script and case, digits for digits."""

    def one(c: Column, i: Column) -> Column:
        n = _draw(stream, i)
        out = F.when(c.rlike("^[0-9]$"), _pick("0123456789", n)).when(c.rlike("^[a-z]$"), _pick(LATIN, n)).when(c.rlike("^[A-Z]$"), _pick(LATIN.upper(), n))
        for script, letters in ((r"\p{IsCyrillic}", CYRILLIC), (r"\p{IsGreek}", GREEK), (r"\p{IsLatin}", LATIN)):
            out = out.when(c.rlike(rf"^{script}$"), F.when(c.rlike(r"^\p{Lu}$"), _pick(letters.upper(), n)).otherwise(_pick(letters, n)))
        return out.otherwise(c)

    extra = F.when(attempt >= 4, F.substr(stream, F.lit(100), F.least(attempt - 3, F.lit(28)))).otherwise(F.lit(""))
    return F.concat(F.array_join(F.transform(_characters(value), one), ""), extra)


def _domain(value: Column, stream: Column, attempt: Column) -> Column:
    """All labels but the last are shaped anew."""
    last = F.substring_index(value, ".", -1)
    return F.concat(_shaped(F.substr(value, F.lit(1), F.length(value) - F.length(last) - 1), stream, attempt), F.lit("."), last)


def _ip(value: Column, stream: Column, attempt: Column) -> Column:
    def octet(c: Column, i: Column) -> Column:
        n, size = _draw(stream, i), F.length(c)
        free = F.when(attempt >= 4, F.pmod(n, F.lit(256))).when(size == 1, F.pmod(n, F.lit(9)) + 1).when(size == 2, F.pmod(n, F.lit(90)) + 10).otherwise(F.pmod(n, F.lit(124)) + 100)
        return free.cast("string")

    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled."""
    backwards = F.regexp_extract_all(F.reverse(digits), F.lit("."), 0)
    weighted = F.transform(backwards, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(weighted, F.lit(0), lambda a, x: a + x)


def _card(value: Column, stream: Column, attempt: Column) -> Column:
    plain = F.regexp_replace(value, "[^0-9]", "")
    fresh = _shaped(value, stream, F.lit(0))
    head = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(fresh, F.lit(2), F.length(fresh) - 2))
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(F.regexp_replace(head, "[^0-9]", ""), F.lit("0"))), F.lit(10)), F.lit(10))
    right = F.pmod(_luhn(plain), F.lit(10)) == 0
    last = F.when(right, check).otherwise(F.pmod(check + 1 + F.pmod(_draw(stream, F.lit(30)), F.lit(9)), F.lit(10)))
    return F.concat(head, last.cast("string"))


def _mod97(iban: Column) -> Column:
    """Remainder of an IBAN without blanks, its first four characters moved behind, letters counting from 10."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    number = F.transform(_characters(moved), lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(number, F.lit(0), lambda a, x: F.pmod(a * F.when(x > 9, 100).otherwise(10) + x, F.lit(97)))


def _iban(value: Column, stream: Column, attempt: Column) -> Column:
    """The country stays; check digits are right or wrong as they were."""
    land, rest = F.substr(value, F.lit(1), F.lit(2)), _shaped(F.substr(value, F.lit(5)), stream, F.lit(0))
    plain = F.regexp_replace(value, " ", "")
    right = F.lit(98) - _mod97(F.concat(land, F.lit("00"), F.regexp_replace(rest, " ", "")))
    off = F.pmod(right - 2 + 1 + F.pmod(_draw(stream, F.lit(30)), F.lit(96)), F.lit(97)) + 2
    return F.concat(land, F.lpad(F.when(_mod97(plain) == 1, right).otherwise(off).cast("string"), 2, "0"), rest)


def _phone(value: Column, stream: Column, attempt: Column) -> Column:
    """The country code stays, and an exchange of 555 where numbers suffice."""
    code = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substr(value, F.length(code) + 1)
    fresh = _shaped(rest, stream, F.lit(0))
    lead = F.instr(F.translate(fresh, "0123456789", "dddddddddd"), "d")
    fresh = F.concat(F.substr(fresh, F.lit(1), lead - 1), (F.pmod(_draw(stream, F.lit(30)), F.lit(8)) + 2).cast("string"), F.substr(fresh, lead + 1))
    at = F.instr(rest, "555")
    held = F.concat(F.substr(fresh, F.lit(1), at - 1), F.lit("555"), F.substr(fresh, at + 3))
    return F.concat(code, F.when((at > 3) & (attempt < 4), held).otherwise(fresh))


#: Syllables are each of the first letters with each of the second; endings for women, men, either, and families.
_SYLLABLES = {
    LATIN: ("bcdfgklmnprstvwz", "aeiou", ["na", "ra", "lia", "sia"], ["ton", "ric", "bert", "mon"], ["lin", "ren", "mel", "noel"], ["mann", "field", "ley", "ner"]),
    CYRILLIC: ("бвгджзклмнпрстфх", "аеиоу", ["на", "ра", "лия", "ся"], ["тон", "рик", "мир", "слав"], ["ким", "лен", "мин", "рен"], ["енко", "ский", "ник", "чук"]),
    GREEK: ("βγδζθκλμνπρστφχψ", "αεηιο", ["να", "ρα", "λια", "σια"], ["τας", "ρης", "μος", "νος"], ["λιν", "ρεν", "μελ", "νοε"], ["ίδης", "άκης", "όπουλος", "έας"]),
}


def _one_of(words: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.pmod(number, F.lit(len(words))) + 1)


def _name_in(letters: str, kind: Column, stream: Column, attempt: Column, part: Column) -> Column:
    first, second, female, male, either, family = _SYLLABLES[letters]
    syllables = F.transform(F.sequence(F.lit(1), F.lit(3) + attempt), lambda i: F.concat(_pick(first, _draw(stream, 2 * i + 2 + 11 * part)), _pick(second, _draw(stream, 2 * i + 3 + 11 * part))))
    n = _draw(stream, 11 * part + 1)
    ending = F.when(kind == "given_f", _one_of(female, n)).when(kind == "given_m", _one_of(male, n)).when(kind == "given", _one_of(either, n)).otherwise(_one_of(family, n))
    return F.concat(F.array_join(syllables, ""), ending)


def _name(kind: Column, value: Column, stream: Column, attempt: Column) -> Column:
    """Lower-case: a name for each part between hyphens and apostrophes, a letter for a single letter."""
    letters = F.when(value.rlike(r"\p{IsCyrillic}"), 1).when(value.rlike(r"\p{IsGreek}"), 2).otherwise(0)

    def part(p: Column, i: Column) -> Column:
        whole = F.when(letters == 1, _name_in(CYRILLIC, kind, stream, attempt, i)).when(letters == 2, _name_in(GREEK, kind, stream, attempt, i)).otherwise(_name_in(LATIN, kind, stream, attempt, i))
        return F.when(~p.rlike(r"^\p{L}"), p).when(F.length(p) == 1, _shaped(p, F.substr(stream, i + 1), F.lit(0))).otherwise(whole)

    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(r"\p{L}+|[^\p{L}]+"), 0), part), "")


def _cased(name: Column, raw: Column) -> Column:
    """All upper where the name stands so, else a capital in front of each part."""
    parts = F.regexp_extract_all(name, F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.when(F.upper(raw) == raw, F.upper(name)).otherwise(F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.substr(p, F.lit(2)))), ""))


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    stream = _stream(key, kind, value, attempt)
    fixed = F.when(value.startswith("AKIA"), F.concat(F.lit("AKIA"), _shaped(F.substr(value, F.lit(5)), stream, F.lit(0)))).otherwise(_shaped(value, stream, attempt))
    return (
        F.when(kind == "domain", _domain(value, stream, attempt)).when(kind == "ip", _ip(value, stream, attempt)).when(kind == "card", _card(value, stream, attempt))
        .when(kind == "phone", _phone(value, stream, attempt)).when(kind == "iban", _iban(value, stream, attempt)).when(kind == "secret", fixed)
        .when(kind.isin(NAMES), _name(kind, value, stream, attempt)).otherwise(_shaped(value, stream, attempt))
    )


def session_key(spark: SparkSession) -> str:
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def _holds(text: str, words: list[str]) -> Column:
    """Whether one of the words stands in the text, by plain search."""
    return F.exists(F.split(F.lit("|".join(words)), r"\|", -1), lambda w: F.contains(F.col(text), w))


def _may_match(text: str) -> Column:
    """False only for texts without any match: each pattern needs a digit, an @, or one of these words. Far cheaper than the patterns."""
    return F.col(text).rlike("[0-9@]") | _holds(text, ["AKIA", *TITLES]) | F.col(text).rlike(r'(?i:password)=|(?i:token) = "')


def _names_person(text: str) -> Column:
    return _holds(text, [t + end for t in TITLES for end in (" ", ". ")]) & F.col(text).rlike(PERSON)


def _parts(text: str) -> Column:
    """All matches, taken apart; candidate words too where a person is named."""
    match, word = (F.regexp_extract_all(F.col(text), F.lit(WITH_WORDS), k) for k in range(2))
    with_words = F.zip_with(match, word, lambda m, w: values_of(m, w != ""))
    return F.when(_names_person(text), with_words).otherwise(F.transform(F.regexp_extract_all(F.col(text), F.lit(PATTERN), 0), lambda m: values_of(m)))


def _rest(text: str) -> Column:
    """What stands between the matches."""
    return F.when(_names_person(text), F.split(F.col(text), WITH_WORDS, -1)).otherwise(F.split(F.col(text), PATTERN, -1))


def _text_key(text: str) -> list[Column]:
    return [F.xxhash64(F.lit(k + 1), F.col(text)).alias(f"k{k}") for k in range(2)]


_KEY = ["k0", "k1"]


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k0, k1, rows, i, j, kind, value, raw): the parts of the matches of each distinct text that has any, in order. Mentions of a name
    have the kind of that name, the surname's first; other candidate words are kept."""
    texts = docs.where(_may_match(text)).select(*_text_key(text), _parts(text).alias("parts")).where(F.size("parts") > 0)
    distinct = texts.groupBy(*_KEY).agg(F.count("*").alias("rows"), F.first("parts").alias("parts"))
    parts = distinct.select(*_KEY, "rows", F.posexplode("parts").alias("i", "part")).select(*_KEY, "rows", "i", F.posexplode("part").alias("j", "p")).select(*_KEY, "rows", "i", "j", "p.*")
    return parts


def _with_mentions(parts: DataFrame) -> DataFrame:
    """The kind of candidate words, joined on text and name, so that a long text is not gathered."""
    rank = F.when(F.col("kind") == "surname", 0).when(F.col("kind").isin(NAMES), 1)
    named = parts.where(F.col("kind").isin(NAMES)).groupBy(*_KEY, "value").agg(F.min(F.struct(rank.alias("r"), "kind"))["kind"].alias("known"))
    words = parts.where("kind = 'word'").join(named, [*_KEY, "value"], "left").select(*_KEY, "rows", "i", "j", F.coalesce("known", F.lit("keep")).alias("kind"), "value", "raw")
    return parts.where("kind <> 'word'").unionByName(words)


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every (kind, value) of the corpus once."""
    return occurrences(docs, text).where(~F.col("kind").isin("keep", "word")).select("kind", "value").distinct()


def attempts(values: DataFrame, key: str | None = None) -> DataFrame:
    """(kind, value, attempt, surrogate) with distinct surrogates, none of which is a value that occurs."""
    key = key or session_key(values.sparkSession)
    with Scratch(values.sparkSession, "attempts") as tmp:
        values = tmp.written(values, "values")
        done, left, attempt = None, values, 0
        while True:
            tried = tmp.written(left.select("kind", "value", surrogate(key, F.col("kind"), F.col("value"), F.lit(attempt)).alias("surrogate")), "tried")
            taken = values.select("kind", F.col("value").alias("surrogate"))
            if done is not None:
                taken = taken.unionByName(done.select("kind", "surrogate"))
            first = tried.join(taken, ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
            accepted = tmp.written(first.select("kind", "value", F.lit(attempt).alias("attempt"), "surrogate"), "accepted")
            done = accepted if done is None else done.unionByName(accepted)
            left = tmp.written(tried.select("kind", "value").join(accepted, ["kind", "value"], "left_anti"), "left")
            if left.isEmpty():
                return written(done, "surrogates")
            attempt += 1


def _rewritings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k0, k1, n, fresh, n_values): for each distinct text with matches, in how many rows it stands, what its matches become, and the number
    of values replaced."""
    with Scratch(docs.sparkSession, "surrogates") as tmp:
        parts = tmp.written(_with_mentions(tmp.written(occurrences(docs, text), "parts")), "occurrences")
        own, kept = parts.where("kind <> 'keep'"), parts.where("kind = 'keep'").withColumn("surrogate", F.col("raw"))
        values = tmp.written(own.groupBy("kind", "value").agg(F.count("*").alias("n")), "values")
        found = attempts(values.select("kind", "value"), key).join(values, ["kind", "value"]).select("kind", "value", "surrogate", "n")
        met = salted_join(own, found, ["kind", "value"], [*_KEY, "i", "j"], own.count())
        cased = met.withColumn("surrogate", F.when(F.col("kind").isin(NAMES), _cased(F.col("surrogate"), F.col("raw"))).otherwise(F.col("surrogate")))
        columns = [*_KEY, "rows", "i", "j", "kind", "surrogate"]
        pieces = cased.select(*columns).unionByName(kept.select(*columns)).repartition(*_KEY)
        matched = pieces.groupBy(*_KEY, "i").agg(F.first("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("j", "surrogate"))).alias("s"), F.sum((F.col("kind") != "keep").cast("long")).alias("n"))
        whole = matched.select(*_KEY, "rows", "i", F.array_join("s.surrogate", "").alias("s"), "n").groupBy(*_KEY).agg(
            F.first("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("all"), F.sum("n").alias("n_values")
        )
        return written(whole.select(*_KEY, F.col("rows").alias("n"), F.col("all.s").alias("fresh"), "n_values"), "rewritings")


def replaced(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """docs with surrogates in the text, and _n_values, the number of values replaced."""
    names, plain = docs.columns, docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = f"c{names.index(text)}"
    fresh = _rewritings(plain, key or session_key(docs.sparkSession), own)
    some = F.coalesce(_may_match(own) & F.col(own).rlike(PATTERN), F.lit(False))
    without = plain.where(~some).withColumn("n_values", F.lit(0).cast("long"))
    hashable = [f.name for f in plain.schema if f.dataType.typeName() not in ("map", "variant") and f.name != own] or [own]
    touched = salted_join(plain.where(some).select("*", *_text_key(own)), fresh, _KEY, hashable, fresh.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    joined = F.array_join(F.zip_with(_rest(own), "fresh", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = touched.select(*[joined.alias(own) if c == own else F.col(c) for c in plain.columns], "n_values")
    return without.unionByName(done).toDF(*names, *fresh_names(["_n_values"], names))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return replaced(docs, spark.conf.get(KEY_SETTING, None) or QUERY_KEY).select("doc_id", F.col("_n_values").alias("n_values"), "text")
