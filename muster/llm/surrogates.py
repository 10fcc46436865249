"""Personal data replaced by keyed surrogates; DataFrame functions only.

Entities are found by patterns. Each distinct entity gets one surrogate, drawn from a SHA-256
of key, type, entity and attempt, so that it is the same wherever the entity occurs. Draws
keep the type's form: length, punctuation, letter case, digits as digits, a card's issuer
digit and check digit, an address's octet range, a name's gender and script. The table of
surrogates is checked: where two entities drew one surrogate, or a draw is itself an entity
of the corpus, the entity draws again, until all are distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.common import written

KEY = "surrogates-1"

# Given names by gender and script, for detection and for replacement.
NAMES = {
    ("female", "latin"): "Alice Anna Clara Emily Emma Grace Hannah Helen Julia Laura Linda Maria Martha Nancy Olivia Rachel Rebecca Sarah Sofia Susan".split(),
    ("male", "latin"): "Adam Andrew Brian Carl Daniel David Edward Frank George Henry James John Kevin Martin Michael Oliver Peter Robert Thomas William".split(),
    ("female", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("male", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий".split(),
}
# Syllables that lengthen a name on a second draw.
_ENDS = {
    ("female", "latin"): "bea dia ela fina gia lena mira nella rosa sina tana via".split(),
    ("male", "latin"): "bert dor fred gar len mar nard ric son tor vin win".split(),
    ("female", "cyrillic"): "бела вина дина ена жана зина лина мила ника рина сана тина".split(),
    ("male", "cyrillic"): "бор вад гор дан ен зар лав мир ник рад слав тан".split(),
}
_SURNAME = {"latin": r"(?: [A-Z][a-z]{2,}\b)?", "cyrillic": r"(?: [А-Я][а-я]{2,})?"}

#: Key and sign in front of a secret: any case, white space around `=`; after `:` only quoted values.
_SECRET = r"(?i:password|passwd|passphrase|pwd|secret(?:[_-](?:access[_-])?key)?|token|(?:api|access|private)[_-]?key)[\"']?\s{0,8}(?:=|:(?=\s{0,8}[\"']))\s{0,8}"
_H = "[0-9A-Fa-f]{1,4}"
#: Patterns by type; the first that matches at a place wins. All are linear: no nested repeats.
#: A secret goes to its closing quote on the same line or, if there is none, to white space; of
#: what then ends it, punctuation of the sentence is left. A quote that follows white space or
#: stands before a word opens another phrase and closes nothing.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "secret": _SECRET + r"(?:\"[^\"\r\n]*[^\"\s]\"(?!\w)|'[^'\r\n]*[^'\s]'(?!\w)|\S*[^\s\"',.;:)\]}>])",
    "access_key": r"\bAKIA[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ipv6": rf"(?<![\w:.])(?:(?:{_H}:){{7}}{_H}|(?:{_H}(?::{_H}){{0,6}})?::{_H}(?::{_H}){{0,6}}|{_H}(?::{_H}){{1,6}}::)(?![\w:]|\.\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.]?\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}|(?<![\d+.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:(?:[3-6]\d{3}|2[2-7]\d{2})(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3[47]\d{2}[ -]\d{6}[ -]\d{5})(?!\d)",
} | {f"{gender}_{script}": rf"(?<![\p{{L}}])(?:{'|'.join(names)}){_SURNAME[script]}(?![\p{{L}}])" for (gender, script), names in NAMES.items()}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind(entity: Column) -> Column:
    """The type of a found entity: the first whose pattern matches all of it."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        found = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(found)
    return found


def entities(text: Column) -> Column:
    """All entities of a text, in order, repeats included."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_ANY), F.lit(0))


def _noise(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def _draw(noise: Column, place: Column, below: int) -> Column:
    """The number below `below` that 28 bits of noise name; place: 0 to 8."""
    return F.conv(F.substring(noise, place * 7 + 1, F.lit(7)), 16, 10).cast("long") % below


def _redraw(entity: Column, key: str, attempt: Column, keep: Column, bare: Column | None = None) -> Column:
    """Each letter and digit after the first `keep` characters drawn anew in its own class.

    Other scripts' are drawn as Latin ones; where `bare` holds, other characters that are not
    white space or quotes are drawn as small letters.
    """

    def each(c: Column, i: Column) -> Column:
        noise = _noise(key, entity, attempt.cast("string"), i.cast("string"))

        def one(of: str) -> Column:
            return F.substring(F.lit(of), (_draw(noise, F.lit(0), len(of)) + 1).cast("int"), F.lit(1))

        small = c.rlike(r"[\p{L}\p{N}]")
        if bare is not None:
            small = small | (bare & ~c.rlike("[\\s\"']"))
        return (
            F.when(i < keep, c)
            .when(c.rlike(r"[A-Z\p{Lu}]"), one("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike("[0-9]"), one("0123456789"))
            .when(small, one("abcdefghijklmnopqrstuvwxyz"))
            .otherwise(c)
        )

    return F.array_join(F.transform(_characters(entity), each), "")


#: Attempts after which draws that may have too small a space grow by a character each.
SAME_LENGTH = 3


def _more(entity: Column, key: str, attempt: Column, of: str) -> Column:
    """What later attempts add: a character for each after SAME_LENGTH, at most 16."""
    noise = F.translate(_noise(key, entity, attempt.cast("string"), F.lit("more")), "0123456789abcdef", of)
    return F.substring(noise, F.lit(1), F.greatest(F.lit(0), F.least(attempt - SAME_LENGTH, F.lit(16))).cast("int"))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(number: Column) -> Column:
    """Sum of a digit string by the check-digit rule; a multiple of 10 if it is valid."""

    def worth(d: Column, i: Column) -> Column:
        twice = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    digits = F.reverse(_characters(F.regexp_replace(number, r"\D", "")))
    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, x: a + x)


def _iban(drawn: Column) -> Column:
    """An account number with its two check digits (modulo 97) set right."""

    def add(rest: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return (F.when(digit, rest * 10 + c.cast("int")).otherwise(rest * 100 + F.ascii(c) - 55) % 97).cast("int")

    moved = F.concat(F.regexp_replace(F.substring(drawn, F.lit(5), F.length(drawn)), " ", ""), F.substring(drawn, 1, 2), F.lit("00"))
    check = 98 - F.aggregate(_characters(moved), F.lit(0), add)
    return F.concat(F.substring(drawn, 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substring(drawn, F.lit(5), F.length(drawn)))


def _syllables(noise: Column, ends: Column, first: int, n: Column) -> Column:
    """So many syllables, at most 8."""
    places = F.slice(F.sequence(F.lit(first), F.lit(first + 7)), F.lit(1), n)
    drawn = F.transform(places, lambda i: F.element_at(ends, (_draw(noise, i, 12) + 1).cast("int")))
    return F.array_join(drawn, "")


def _person(entity: Column, key: str, attempt: Column, names: list[str], ends: list[str]) -> Column:
    """A name of the same gender and script: the given name and the surname each have their own draw."""
    ends = F.array(*map(F.lit, ends))
    words = F.split(entity, " ")
    noise = lambda word: _noise(key, word, attempt.cast("string"))
    first = noise(words[0])
    given = F.element_at(F.array(*map(F.lit, names)), (_draw(first, F.lit(0), len(names)) + 1).cast("int"))
    given = F.concat(given, _syllables(first, ends, 1, F.least(attempt, F.lit(7))))
    surname = F.initcap(_syllables(noise(words[1]), ends, 0, F.lit(3) + F.least(attempt, F.lit(5))))
    return F.when(F.size(words) > 1, F.concat(given, F.lit(" "), surname)).otherwise(given)


def surrogate(entity: Column, type_: Column, attempt: Column, key: str = KEY) -> Column:
    """The draw of one attempt (0, 1, ...) for an entity of a type."""

    def after(prefix: str) -> Column:
        return _redraw(entity, key, attempt, F.length(F.regexp_extract(entity, prefix, 0)))

    letters, digits = (_more(entity, key, attempt, of) for of in ("abcdefghijklmnop", "0123456789012345"))
    # A secret without a letter or digit is drawn whole; what lengthens one stays within its quotes.
    value = F.regexp_replace(entity, f"^{_SECRET}", "")
    bare = ~value.rlike(r"[\p{L}\p{N}]")
    secret = _redraw(entity, key, attempt, F.length(entity) - F.length(value), bare)
    quote = F.regexp_extract(secret, "[\"']$", 0)
    secret = F.concat(F.regexp_replace(secret, "[\"']$", ""), letters, quote)

    noise = _noise(key, entity, attempt.cast("string"))
    octets = [_draw(noise, F.lit(i), 223 if i == 0 else 254) + 1 for i in range(4)]
    body = F.regexp_replace(after("^(?:3[47]|2[2-7]|.)"), r"\d$", "")  # of the same issuer
    check = (10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10
    name, host = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    by_host = F.concat_ws(":", attempt.cast("string"), host)
    # One domain has one surrogate at an attempt; what follows the last dot stays.
    top = F.concat(F.lit("."), F.substring_index(host, ".", -1))
    domain = F.regexp_replace(host, r"\.[A-Za-z]+$", "")
    out = (
        F.when(type_ == "email", F.concat(_redraw(name, key, by_host, F.lit(0)), letters, F.lit("@"), _redraw(domain, key, attempt, F.lit(0)), top))
        .when(type_ == "secret", secret)
        .when(type_ == "access_key", after("^AKIA"))
        .when(type_ == "ip", F.concat_ws(".", *(o.cast("string") for o in octets)))
        .when(type_ == "phone", F.concat(after(r"^\+\d{1,3}"), digits))
        .when(type_ == "iban", _iban(after("^[A-Z]{2}")))
        .when(type_ == "ipv6", F.concat_ws(":", *(F.substring(noise, 4 * i + 1, 4) for i in range(8))))
        .when(type_ == "card", F.concat(body, check.cast("string")))
    )
    for (gender, script), names in NAMES.items():
        person = _person(entity, key, attempt, names, _ENDS[gender, script])
        out = out.when(type_ == f"{gender}_{script}", person)
    return out.otherwise(_redraw(entity, key, attempt, F.lit(0)))


def surrogates(spark: SparkSession, found: DataFrame, key: str = KEY) -> DataFrame:
    """(entity, type, attempt, surrogate) for found(entity), distinct and not null.

    No two entities share a surrogate and no surrogate is an entity. Of those that draw the
    same, the one of the earlier attempt keeps it, then the smaller entity; the others draw
    again. Rounds go on until nothing clashes; later draws have a larger space (names get
    longer), so a few rounds do.
    """
    attempt, drawn = F.col("attempt"), F.struct("attempt", "entity")
    now = found.select("entity", kind(F.col("entity")).alias("type"), F.lit(0).alias("attempt"))
    while True:
        now = now.withColumn("surrogate", surrogate(F.col("entity"), F.col("type"), attempt, key))
        now = written(spark, now, "surrogates")
        first = now.groupBy("surrogate").agg(F.min(drawn).alias("first"), F.count("*").alias("n"))
        shared = first.where("n > 1").select("surrogate", F.col("first.entity").alias("owner"))
        real = now.select(F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        judged = now.join(shared.hint("rebalance"), "surrogate", "left").join(real, "surrogate", "left")
        again = F.coalesce("real", F.lit(False)) | F.coalesce(F.col("owner") != F.col("entity"), F.lit(False))
        judged = written(spark, judged.select("entity", "type", "attempt", "surrogate", again.alias("again")), "judged")
        if judged.where("again").isEmpty():
            return judged.drop("again")
        now = judged.select("entity", "type", (attempt + F.col("again").cast("int")).alias("attempt"))


def replace_entities(spark: SparkSession, docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with each entity in `text` replaced, and a column n_entities (a long).

    One surrogate stands for one entity in all documents. Texts without entities, null and
    empty ones stay as they are, with n_entities 0. Repeated rows are replaced alike. Other
    columns stay; one of docs called n_entities is replaced. A text of any length is searched
    whole, and rewritten by one task. No rows give no rows.

    Texts are known by two hashes, 96 bits in all, so that copies are worked on once and a
    row needs no id. An entity in very many documents is one row in the table of surrogates,
    and a skewed join key like any other elsewhere.
    """
    one, two = F.xxhash64("text").alias("_one"), F.hash("text").alias("_two")
    places = docs.where("text is not null").select(one, two, F.posexplode(entities(F.col("text"))).alias("place", "entity"))
    places = written(spark, places.distinct(), "places")
    table = surrogates(spark, places.select("entity").distinct(), key)
    in_order = F.sort_array(F.collect_list(F.struct("place", "surrogate")))
    changes = places.join(table.select("entity", "surrogate"), "entity").groupBy("_one", "_two")
    changes = written(spark, changes.agg(in_order.getField("surrogate").alias("_new")), "changes")
    rows = docs.drop("n_entities").withColumns({"_one": F.xxhash64("text"), "_two": F.hash("text")})
    rows = rows.join(changes.hint("merge"), ["_one", "_two"], "left")  # one plan at every size
    parts = F.split("text", _ANY, -1)
    joined = F.zip_with(parts, F.concat(F.col("_new"), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    text = F.when(F.col("_new").isNull(), F.col("text")).otherwise(F.array_join(joined, ""))
    count = F.when(F.col("_new").isNull(), F.lit(0)).otherwise(F.size("_new")).cast("long")
    return rows.withColumns({"text": text, "n_entities": count}).select(*docs.drop("n_entities").columns, "n_entities")
