"""Personal data replaced by keyed surrogates.

Detected entities get replacements of their own type that keep their form: a
card number keeps its length and has a valid check digit, a phone number keeps
its country code and punctuation, a person's name its gender, script and case.
A surrogate depends on the key and on the entity alone, however it is written
(case, punctuation), so an entity has one surrogate in all documents
(coreference), without a table that tasks share.  A person is found by a title;
the whole name and the family name are then replaced throughout the document.
A family name has one surrogate of its own, so "Dr. Anna Miller" and "Miller"
still go together.

Distinct entities must get distinct surrogates.  Where the form allows it, the
surrogate is a keyed permutation of the values of that form (Feistel rounds over
its digits and letters), which cannot collide.  Names come from lists and
syllables, which can: all distinct names of all documents are checked, first
family names, then whole names, and those that would share a surrogate get the
next one that is free, with more syllables after every few attempts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.common import slices
from spendloom.session import write_shared

#: Given names by script and gender, and family names by script.
GIVEN = {
    ("latin", "f"): ("Anna", "Clara", "Elena", "Julia", "Laura", "Marie", "Nina", "Olivia", "Paula", "Sophia"),
    ("latin", "m"): ("Adam", "Daniel", "Felix", "Jonas", "Lucas", "Martin", "Oscar", "Paul", "Simon", "Victor"),
    ("cyrillic", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
    ("cyrillic", "m"): ("Андрей", "Виктор", "Иван", "Лев", "Михаил", "Павел", "Роман", "Фёдор"),
    ("greek", "f"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Πέτρος", "Σπύρος"),
}
FAMILY_ENDS = {"latin": ("man", "ton", "berg", "field", "wood", "dale"), "cyrillic": ("ов", "ин", "енко"), "greek": ("ίδης", "άκης")}
FAMILY_STARTS = {
    "latin": ("Al", "Ber", "Cal", "Dor", "El", "Far", "Gil", "Har", "Kel", "Lin", "Mar", "Nor", "Pel", "Ros", "Sel", "Tor", "Wal"),
    "cyrillic": ("Бел", "Вол", "Гор", "Дар", "Лар", "Мор", "Сар", "Тол"),
    "greek": ("Αλεξ", "Δημ", "Μαρκ", "Νικολ", "Παυλ", "Στεφ"),
}
MIDDLES = {
    "latin": tuple(c + v for c in "bdklmnrstv" for v in "aeiou"),
    "cyrillic": tuple(c + v for c in "бвдклмнрст" for v in "аеиоу"),
    "greek": tuple(c + v for c in "βδκλμνρστ" for v in "αειου"),
}
#: Attempts at a name before it gets one more syllable, so that a free one always exists.
ATTEMPTS = 4
#: Titles that announce a person, with the gender they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "", "Prof": "",
}
_LETTER = r"[^\W\d_]"
_NAME = rf"(?-i:[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫЀ-Я]){_LETTER}+"
_KEY_WORD = r"(?i:passwords?|passwd|passphrase|pwd|secret|token|api[_-]?key|(?:secret|access|private|auth|client)[_-]?key)"
#: Between an equals sign or a colon and prose stands no letter-only word: there, a value needs a digit and six characters.
_SECRET = (
    rf"{_KEY_WORD}=(?P<plain>[^\s\"']+)"
    rf"|{_KEY_WORD}[\"']?[ \t]*[=:][ \t]*(?:\"(?P<double>[^\s\"]+)\"|'(?P<single>[^\s']+)')"
    rf"|{_KEY_WORD}[ \t]*[=:][ \t]*(?P<told>(?=[^\s\"'()\[\]]*\d)[^\s\"'()\[\],;]{{6,}})"
    r"|\b[Bb]earer (?P<bearer>(?=[\w.~+/-]*\d)[\w.~+/-]{8,}=*)"
)
_KINDS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}\b",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "secret": _SECRET,
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-])"
    r"|(?<![\w.])\(\d{3}\) ?\d{3}-\d{4}(?![\w-])|(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "person": rf"(?<=\b)(?:{'|'.join(TITLES)})\.? (?:{_NAME})(?: {_NAME}){{0,2}}",
}
_VALUES = ("plain", "double", "single", "told", "bearer")
_ENTITY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _KINDS.items()))
_NO_SECRET = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _KINDS.items() if kind != "secret"))
#: No entity is without one of these.
_SIGN = re.compile(rf"\d|@|AKIA|ASIA|\b(?:{'|'.join(TITLES)})\b")
#: No secret is without one of these, in lower case.
_SECRET_SIGNS = ("passw", "passphrase", "pwd", "secret", "token", "key", "bearer")
_WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)")


def entities(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of each entity of a text, from left to right, without overlaps."""
    lower = text.lower()
    secret = any(sign in lower for sign in _SECRET_SIGNS)
    if not secret and not _SIGN.search(text):
        return []
    found = []
    for m in (_ENTITY if secret else _NO_SECRET).finditer(text):
        if m.lastgroup == "secret":
            found.append(("secret", *next(m.span(g) for g in _VALUES if m[g] is not None)))
        elif m.lastgroup != "card" or luhn_valid(m.group()):
            found.append((m.lastgroup, m.start(), m.end()))
    names = {person(split_title(text[start:end])[1]) for kind, start, end in found if kind == "person"}
    return _with_mentions(text, found, names | {name.split()[-1] for name in names}) if names else found


def _with_mentions(text: str, found: list[tuple[str, int, int]], names: set[str]) -> list[tuple[str, int, int]]:
    """The entities and, between them, the longest runs of one to three capitalised words that are ``names``."""
    words, out, at = [m.span() for m in _WORD.finditer(text)], [], 0
    for entity in [*found, ("", len(text), len(text))]:
        while at < len(words) and words[at][0] < entity[1]:
            start = words[at][0]
            ends = [(end, n) for n, (_, end) in enumerate(words[at : at + 3], 1) if end <= entity[1]]
            end, n = next(((e, n) for e, n in reversed(ends) if person(text[start:e]) in names), (start, 1))
            if end > start:
                out.append(("person", start, end))
            at += n
        while at < len(words) and words[at][0] < entity[2]:
            at += 1
        out.append(entity)
    return out[:-1]


def split_title(value: str) -> tuple[str, str]:
    """Title and name; the title of a mention without one is empty."""
    first, *rest = value.split(None, 1)
    return (first, rest[0]) if rest and first.rstrip(".") in TITLES else ("", value)


def genders(text: str, found: list[tuple[str, int, int]]) -> dict[str, str]:
    """The genders that a text's titles tell of its persons."""
    told: dict[str, str] = {}
    for kind, start, end in found:
        if kind == "person":
            title, name = split_title(text[start:end])
            told[person(name)] = told.get(person(name)) or TITLES.get(title.rstrip("."), "")
    return told


def luhn_valid(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    return 13 <= len(digits) <= 19 and _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: list[int]) -> int:
    odd, even = digits[-1::-2], digits[-2::-2]
    return sum(odd) + sum(2 * d - 9 * (d > 4) for d in even)


class Surrogates:
    """Keyed replacements; ``tries`` has the number of the try for names that collide at their first."""

    def __init__(self, key: bytes, tries: dict[str, int] | None = None) -> None:
        self._key, self._tries, self._memory = key, tries or {}, {}

    def of(self, kind: str, value: str, gender: str = "") -> str:
        """The replacement; ``gender`` is that of a person whose title does not tell it."""
        found = self._memory.get((kind, value, gender))
        if found is None:
            if len(self._memory) > 50_000:
                self._memory.clear()
            if kind == "person":
                title, name = split_title(value)
                told = gender or TITLES.get(title.rstrip("."), "")
                found = f"{title} {self.name(name, told)}".lstrip()
            else:
                found = _REPLACE[kind](self, value)
            self._memory[kind, value, gender] = found
        return found

    def stream(self, n: int, *parts: object) -> bytes:
        """n keyed bytes that depend on the parts."""
        message = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
        return hashlib.shake_256(len(self._key).to_bytes(4, "big") + self._key + message).digest(n)

    def permute(self, kind: str, text: str, fixed: int = 0, alphabet: str = "") -> str:
        """A keyed permutation of the texts that have the form of this one.

        The form is the first ``fixed`` characters, all characters that are no
        ASCII digit or letter, and the classes of the others (one ``alphabet``
        for all, if given).  Eight Feistel rounds between the even and the odd
        changeable places.
        """
        places = [i for i, c in enumerate(text) if i >= fixed and _class(c)]
        changeable = set(places)
        form = "".join((alphabet or _class(c))[-1] + "*" if i in changeable else c for i, c in enumerate(text))
        letters, halves = list(text), (places[::2], places[1::2])
        for turn in range(8):
            to, by = halves[turn % 2], halves[1 - turn % 2]
            shifts = self.stream(2 * len(to), kind, form, turn, "".join(letters[i] for i in by))
            for i, high, low in zip(to, shifts[::2], shifts[1::2]):
                own = alphabet or _class(letters[i])
                letters[i] = own[(own.index(letters[i]) + 256 * high + low) % len(own)]
        return "".join(letters)

    def name(self, name: str, gender: str, attempt: int | None = None) -> str:
        """The surrogate of a person's name; an untold gender is drawn with the key.

        The family name is drawn by itself, the given names by the whole name.
        ``attempt`` is that of the whole name, by default as the tries say.
        """
        script, whole, (*given, family) = _script(name), person(name), name.split()
        attempt = self._tries.get(whole, 0) if attempt is None else attempt
        own = self._family(script, family, self._tries.get(family.lower(), 0) if given else attempt)
        more = attempt // ATTEMPTS * bool(given)
        drawn = self.stream(len(given) + more, "given", attempt, whole)
        gender = gender or "fm"[self.stream(1, "gender", whole)[0] % 2]
        found = []
        for word, d in zip(given, drawn):
            free = [g for g in GIVEN[script, gender] if g.lower() != word.lower()]
            found.append(free[d % len(free)])
        if more:
            found[-1] += "".join(MIDDLES[script][d % len(MIDDLES[script])] for d in drawn[len(given) :])
        return " ".join(f.upper() if w.isupper() and len(w) > 1 else f for f, w in zip([*found, own], [*given, family]))

    def _family(self, script: str, family: str, attempt: int) -> str:
        starts, ends, middles = FAMILY_STARTS[script], FAMILY_ENDS[script], MIDDLES[script]
        first, last, *rest = self.stream(4 + attempt // ATTEMPTS, "family", attempt, family.lower())
        return starts[first % len(starts)] + "".join(middles[d % len(middles)] for d in rest) + ends[last % len(ends)]

    def _email(self, value: str) -> str:
        dot = value.rindex(".")
        return _like(value, self.permute("email", value[:dot].lower()) + value[dot:])

    def _ip(self, value: str) -> str:
        usual = _usual_ip(value)
        at = int.from_bytes(bytes(map(int, value.split("."))), "big")
        while True:
            left, right = at >> 16, at & 0xFFFF
            for turn in range(8):
                left, right = right, left ^ int.from_bytes(self.stream(2, "ip", turn, right), "big")
            at = left << 16 | right
            found = ".".join(map(str, at.to_bytes(4, "big")))
            if _usual_ip(found) == usual:  # walking on within the kind keeps it one to one
                return found

    def _card(self, value: str) -> str:
        """The first digit stays; the check digit is set anew."""
        digits = re.sub(r"\D", "", value)
        found = self.permute("card", digits[:-1], 1)
        return _like(value, found + str(-_luhn_sum([*map(int, found), 0]) % 10))

    def _iban(self, value: str) -> str:
        """The country stays; the check digits are set anew."""
        plain = value.replace(" ", "")
        rest = self.permute("iban" + plain[:2], plain[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in rest + plain[:2] + "00")) % 97
        return _like(value, f"{plain[:2]}{check:02d}{rest}")

    def _secret(self, value: str) -> str:
        return self.permute("secret", value, alphabet="0123456789abcdef" if re.fullmatch("[0-9a-f]+", value) else "")

    def _phone(self, value: str) -> str:
        """The country code stays."""
        code = re.match(r"\+(\d{1,3})(?=\D)", value)
        digits = re.sub(r"\D", "", value)
        return _like(value, self.permute("phone" + "+" * bool(code), digits, len(code[1]) if code else 0))


_REPLACE = {
    "email": Surrogates._email,
    "key": lambda s, value: s.permute("key", value, 4),
    "secret": Surrogates._secret,
    "ip": Surrogates._ip,
    "card": Surrogates._card,
    "ssn": lambda s, value: s.permute("ssn", value),
    "iban": Surrogates._iban,
    "phone": Surrogates._phone,
}


def _like(shape: str, found: str) -> str:
    """``found`` with the case of ``shape`` and its characters that are no ASCII digit or letter."""
    letters = iter(c for c in found if _class(c))
    return "".join((next(letters).upper() if c.isupper() else next(letters)) if _class(c) else c for c in shape)


def _usual_ip(value: str) -> bool:
    first, *_, last = value.split(".")
    return first not in ("0", "255") and last not in ("0", "255")


def _class(c: str) -> str:
    if "0" <= c <= "9":
        return "0123456789"
    if "a" <= c <= "z":
        return "abcdefghijklmnopqrstuvwxyz"
    if "A" <= c <= "Z":
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return ""


def _script(name: str) -> str:
    c = name[:1]
    return "cyrillic" if "\u0400" <= c <= "\u04ff" else "greek" if "\u0370" <= c <= "\u03ff" else "latin"


def person(name: str) -> str:
    return " ".join(name.split()).lower()


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and the entities (kind, start, end) of the text as it was."""
    found = entities(text)
    told = genders(text, found)
    parts, at = [], 0
    for kind, start, end in found:
        value = text[start:end]
        gender = told[person(split_title(value)[1])] if kind == "person" else ""
        parts += text[at:start], surrogates.of(kind, value, gender)
        at = end
    return "".join(parts) + text[at:], found


def replace_personal_data(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and a column pii of the entities found.

    pii is an array of (kind, start, end), in code points of the text as it was.
    A null text stays null, with an empty array; texts without entities stay as
    they are.  Repeated rows are treated alike; an empty table stays empty.  A
    column pii of ``docs`` is replaced; columns of any other names are kept.
    """
    tries = write_shared(name_tries(docs, key, text_col), "tries")
    out = "struct<text string, pii array<struct<kind string, start int, end int>>>"

    @F.arrow_udf(out)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        surrogates = Surrogates(key)
        for texts, known in batches:
            done = []
            for part in slices(pa.record_batch([texts, known], ["text", "tries"]), "text"):
                found = []
                for text, tries in zip(part.column("text").to_pylist(), part.column("tries").to_pylist()):
                    own = Surrogates(key, dict(tries)) if tries else surrogates
                    new, spans = (None, []) if text is None else replace(text, own)
                    found.append({"text": new, "pii": [dict(zip(("kind", "start", "end"), s)) for s in spans]})
                done.append(pa.array(found, _ARROW))
            yield pa.concat_arrays(done) if done else pa.array([], _ARROW)

    none = F.lit(None).cast("map<string,int>")
    names = [c for c in docs.columns if c != "pii"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    text = F.col("doc").getField(text_col)
    if tries.isEmpty():  # no two names share a surrogate
        rows = rows.select("doc", run(text, none).alias("done"))
    else:
        rows = rows.withColumn("_row", F.xxhash64(text)).join(tries, "_row", "left").select("doc", run(text, F.col("_tries")).alias("done"))
    kept = [F.col("done.text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in names]
    return rows.select(*kept, F.col("done.pii").alias("pii"))


_ARROW = pa.struct([("text", pa.string()), ("pii", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


def name_tries(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """For texts (by hash) with names that collide: the attempts those names take (_row, _tries).

    Every distinct family name is drawn over all documents, then every distinct
    whole name with the family name it got.
    """

    @F.arrow_udf("array<struct<name string, gender string>>")
    def names(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts.to_pylist():
            spans = entities(text or "")
            told = genders(text or "", spans)
            values = {split_title(text[s:e])[1] for kind, s, e in spans if kind == "person"}
            found.append([{"name": n, "gender": told[person(n)]} for n in sorted(values)])
        return pa.array(found, pa.list_(pa.struct([("name", pa.string()), ("gender", pa.string())])))

    titled = docs.filter(F.col(text_col).rlike(rf"\b({'|'.join(TITLES)})\b"))
    found = titled.select(F.xxhash64(text_col).alias("_row"), F.explode(names(F.col(text_col))).alias("p"))
    family = F.element_at(F.split("p.name", r"\s+"), -1)
    found = found.select("_row", F.lower("p.name").alias("person"), F.lower(family).alias("family"), "p.name", "p.gender")
    found = write_shared(found.distinct(), "names")
    families = found.groupBy(F.col("family").alias("person")).agg(F.min(F.element_at(F.split("name", r"\s+"), -1)).alias("name"))
    families = _settle(families.withColumns({"gender": F.lit(""), "of_family": F.lit(0)}), key)
    # A name with two genders draws two surrogates; each must be free.
    whole = found.filter("person <> family").groupBy("person", "gender", "family").agg(F.min("name").alias("name"))
    whole = whole.join(families.select(F.col("person").alias("family"), F.col("attempt").alias("of_family")), "family", "left")
    whole = _settle(whole.drop("family").fillna(0, ["of_family"]), key)
    used = found.select("_row", "person").union(found.select("_row", "family")).distinct()
    rows = used.join(families.union(whole), "person")
    return rows.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("person", "attempt"))).alias("_tries"))


def _settle(people: DataFrame, key: bytes) -> DataFrame:
    """The attempts (person, attempt) of the people who do not keep their first surrogate.

    Of the names that draw the same one, the first in order keeps it and the
    others draw again, until no two are the same; a name that holds its
    surrogate never gives it up.
    """

    @F.arrow_udf("string")
    def draw(name: pa.Array, gender: pa.Array, attempt: pa.Array, of_family: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (name, gender, attempt, of_family)))
        found = [Surrogates(key, {n.split()[-1].lower(): f}).name(n, g, a) for n, g, a, f in rows]
        return pa.array([person(f) for f in found], pa.string())

    people = people.withColumn("attempt", F.lit(0))
    while True:
        people = write_shared(people.withColumn("surrogate", draw("name", "gender", "attempt", "of_family")), "people")
        holder = people.groupBy("surrogate").agg(F.min(F.struct("attempt", "person")).alias("first"))
        lost = people.join(holder, "surrogate").withColumn("lost", F.col("person") != F.col("first.person"))
        if lost.filter("lost").isEmpty():
            return people.filter("attempt > 0").groupBy("person").agg(F.max("attempt").alias("attempt"))
        again = lost.groupBy("person").agg(F.max("lost").alias("lost"))
        people = people.join(again, "person").withColumn("attempt", F.col("attempt") + F.col("lost").cast("int")).drop("lost", "surrogate")
