"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent.

Every entity is replaced by a made-up one of its type. The same entity has the same surrogate
wherever it stands and however it is written: its canonical form has neither capitals nor, in
numbers, separators (those of addresses and names carry meaning and stay). A name is one entity
whatever title goes before it: where the corpus tells its gender, all its places get a name of that
gender. A keyed hash of the form chooses a new form, which is then laid into the format of each
spelling. Letters keep their case, script and whether they are vowels, digits stay digits; an
address keeps its last domain, a phone number its country code, a card number a valid check digit
if it had one; an IP address stays one. Given names of known gender come from lists in the name's script,
later attempts from syllables with an ending of the gender.

A name that stands in a text with a title or a known given name is replaced wherever it stands in that
text, with the same surrogate.

Collisions: all distinct entities of the corpus are compared by form. Of entities with one new
form the smallest keeps it, the others, and those whose new form is a real entity, are hashed
anew with the next attempt, until none is left. From the third later attempt on new forms grow
by one letter, syllable or digit each time (IP addresses: from the ninth on, octets up to 999), so that no
kind runs out of values.

Each text is searched once. Texts with a sign of an entity are written with what was found in them;
those that hold a name, or an entity of a later attempt, meet the few forms they need in a join on a
row number, by the same plan at every size; all other texts are shuffled nowhere.

All of it is DataFrame functions. A NULL text stays NULL; a text without entities stays as it
is; rows stay one to one; other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import written
from . import common

# Titles that go before a name, by gender.
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа")
NEUTRAL_TITLES = ("Dr", "Prof", "Доктор")

# Given names, by gender and script.
MALE_NAMES = ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul")
FEMALE_NAMES = ("Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula")
MALE_CYRILLIC = ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Илья")
FEMALE_CYRILLIC = ("Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Инна", "Лидия")

MALE_GREEK = ("Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Λεωνίδας", "Νίκος", "Πέτρος", "Στέφανος")
FEMALE_GREEK = ("Αγγελική", "Βασιλική", "Δέσποινα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρίνα", "Σοφία")

# Syllables of further given names by script (Latin, Cyrillic, Greek), and their endings by gender.
SYLLABLES = (
    ("Al Be Cor Da El Fa Gi Han Is Jo Ka Li Mar Ne Or Pe Ro Sa Te Vi".split(), "ba de li mo na ri ro si ta ve".split()),
    ("Ан Бо Ве Га Да Ель Жи За Ив Ка Ла Ма Ни Оль Па Ро Са Та Фе Ян".split(), "ба ве ди ла ми на ре си та ву".split()),
    ("Αν Βα Γε Δη Ελ Ζη Θε Κα Λε Μα Νι Ορ Πα Ρο Στ Τη Φι Χα".split(), "βα δη λι μο να ρι ρο σι τα".split()),
)
ENDINGS = {
    "male": ("n no rd rt s ck".split(), "н р с м й д".split(), "ος ης ας ων".split()),
    "female": ("na la ria sa ta ra".split(), "на ла рья са та ра".split(), "να λα ρία τη".split()),
}

# Frequent given names, by which a name is known that has no title before it.
KNOWN_MALE = (
    "John", "James", "Robert", "Michael", "William", "Thomas", "Peter", "Daniel", "George", "Hans", "Klaus", "Jürgen",
    "Pierre", "Jean", "Luis", "Carlos", "José", "Juan", "Antonio", "Miguel", "Сергей", "Дмитрий", "Александр",
)
KNOWN_FEMALE = (
    "Mary", "Anna", "Elizabeth", "Jennifer", "Linda", "Susan", "Sarah", "Emma", "Sophie", "Ursula", "Monika", "Sabine",
    "Marie", "Camille", "Carmen", "Lucía", "Isabel", "Ana", "Ольга", "Мария", "Наталья", "Татьяна",
)

# Letters that replace letters, by script and kind.
LETTERS = (
    ("aeiou", "aeiou"),
    ("bcdfghjklmnpqrstvwxyz", "bcdfghjklmnpqrstvwxyz"),
    ("àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "äåéêîóöúü"),
    ("āăąēĕėęěīĭįıōŏőūŭůűųŷǎǐǒǔ", "āęěīōūůű"),
    ("çñßšžćčłńśźżřťďňľĺŕğşșțţģķļņđðþħĥĝĉĵŝŵ", "çñšžčłřťďňğş"),
    ("аеёиоуыэюяіїєў", "аеиоуыэюя"),
    ("бвгджзйклмнпрстфхцчшщъьґђјљњћџ", "бвгджзклмнпрстфхцчш"),
    ("αεηιουωάέήίόύώ", "αεηιουω"),
    ("βγδζθκλμνξπρστφχψς", "βγδζθκλμνξπρστφχψ"),
)
# Letters by script, for scripts without vowels and capitals of the same kind; the last is for all others.
SCRIPTS = (
    ("Armenian", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօ"),
    ("Georgian", "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ"),
    ("Hebrew", "אבגדהוזחטיכלמנסעפצקרשת"),
    ("Arabic", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    ("Devanagari", "कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह"),
    ("Thai", "กขคงจชซดตถทนบปผพฟมยรลวสหอ"),
    ("Hiragana", "あいうえおかきくけこさしすせそたちつてとなにぬねのまみむめも"),
    ("Katakana", "アイウエオカキクケコサシスセソタチツテトナニヌネノマミムメモ"),
    ("Hangul", "가나다라마바사아자차카타파하고노도로모보소오조호구누두루무부수우주"),
    ("Han", "的一是在不了有和人这中大为上个国我以要他"),
    ("Cyrillic", "бвгджзклмнпрст"),
    ("Greek", "βγδζθκλμνξπρστ"),
    (None, "lmnrst"),
)

KEY = "surrogates"
#: Attempts after which forms grow, and IP addresses leave their range.
FIXED, IN_RANGE = 2, 8
OTHER = "other"

# Country calling codes of one and two digits; all others have three.
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_NAMED = ("male", "female", "given", "family")
_LISTED = ("IsLatin", "IsCyrillic", "IsGreek")

_TITLES = "|".join((*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES))
# a name of any length; not what makes it a genitive. What goes before another match has to have an end.
_LETTER = r"(?:[\p{L}\p{M}]|['’-](?!s(?!\p{L}))(?=\p{L}))"
_NAME = rf"(?!(?:{_TITLES})[. ])\p{{Lu}}{_LETTER}++"
_BEHIND = r"\p{Lu}[\p{L}\p{M}'’-]{1,30}"
_TITLE = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.?[ ]"

_KNOWN = "|".join((*MALE_NAMES, *FEMALE_NAMES, *MALE_CYRILLIC, *FEMALE_CYRILLIC, *KNOWN_MALE, *KNOWN_FEMALE))
_GIVEN = rf"(?<![\p{{L}}\p{{N}}])(?:{_KNOWN})"

# What is found, most specific first; each begins where no letter or digit goes before.
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"),
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("token", r"[0-9a-f]{32,}+(?![\p{L}\p{N}])|[0-9A-F]{32,}+(?![\p{L}\p{N}])|AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])"),
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|\d{3}-\d{3}-\d{4}(?![\d-])|0\d{1,3}(?:[ .-]\d{2,4}){2,4}(?![\d-])"),
    ("ssn", r"\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip", r"(?:\d{1,3}\.){3}\d{1,3}(?![\d])"),
    ("card", r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?!\d)|\d{13,19}(?!\d)"),
)
_ANY = (
    r"(?<![\p{L}\p{N}])(?:" + "|".join(p.replace("([ -])", "[ -]").replace(r"\1", "[ -]") for _, p in KINDS) + ")"
    # cheap conditions first: few capitals stand after a letter or a title's dot
    rf"|(?=\p{{Lu}})(?<=[\p{{L}}.][ ])(?<={_TITLE}){_NAME}|(?=\p{{Lu}})(?<=\p{{L}}[ ])(?<={_TITLE}{_BEHIND}[ ]){_NAME}"
    rf"|(?=\p{{Lu}}){_GIVEN}(?=[ ]{_NAME})|(?=\p{{Lu}})(?<=\p{{L}}[ ])(?<={_GIVEN}[ ]){_NAME}"
)

# What every text with an entity has: a digit, an at sign, a long or marked token, or a title or given
# name before a capital. Few texts have any of it, and only these meet the costly pattern.
_SIGNS = rf"[0-9@]|AKIA|[a-f]{{32}}|[A-F]{{32}}|(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLES})\.?|{_KNOWN})[ ]\p{{Lu}}"


def _kind(value: Column, before: Column, after: Column, more: Column) -> Column:
    """The type of a match, from itself and what stands around it."""
    titled = lambda titles: before.rlike(rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(titles)})\.?[ ]$")
    letter = value.rlike(r"^\p{L}")
    given = more & (after == " ")
    kind = F.when(~letter | value.rlike(r"[0-9@]"), _by_pattern(value))
    kind = kind.when(given & titled(MALE_TITLES), "male").when(given & titled(FEMALE_TITLES), "female")
    kind = kind.when(given & value.isin(*MALE_NAMES, *MALE_CYRILLIC, *KNOWN_MALE), "male")
    kind = kind.when(given & value.isin(*FEMALE_NAMES, *FEMALE_CYRILLIC, *KNOWN_FEMALE), "female")
    return kind.when(given & titled(NEUTRAL_TITLES), "given").otherwise("family")


def _by_pattern(value: Column) -> Column:
    kind = F.lit(OTHER)
    for name, pattern in reversed(KINDS):
        kind = F.when(value.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def entities(text: Column) -> Column:
    """Array of ``gap, value, kind``: each entity with the text before it, in order; NULL for a text without any.

    The last part is the rest of the text. To be called on a column that is held: the parts name it twice.
    """
    found = F.regexp_extract_all(text, F.lit(_ANY), 0)
    return F.struct(found.alias("values"), F.when(F.size(found) > 0, F.split(text, _ANY, -1)).alias("gaps"))


def _parts(held: Column) -> Column:
    values, gaps = held["values"], held["gaps"]
    more = lambda i: i < F.size(values)
    parts = F.transform(
        F.sequence(F.lit(0), F.size(values)),
        lambda i: F.struct(
            F.get(gaps, i).alias("gap"),
            F.get(values, i).alias("value"),
            F.when(more(i), _kind(F.get(values, i), F.get(gaps, i), F.get(gaps, i + 1), more(i + 1))).alias("kind"),
        ),
    )
    return F.when(F.size(values) > 0, parts)


def canonical(kind: Column, value: Column) -> Column:
    """What is the same entity however it is written: lower case, and no separators but those that carry meaning."""
    bare = F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
    name = F.regexp_replace(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}'’-]|['’-]+$", ""), "’", "'")
    form = F.when(kind.isin("phone", "iban", "card", "ssn", OTHER), bare).when(kind.isin(*_NAMED), name).otherwise(F.lower(value))
    # a number with its country's code is not the local number of the same digits
    return F.when((kind == "phone") & value.startswith("+"), F.concat(F.lit("+"), form)).otherwise(form)


def digest(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, form, attempt.cast("string")), 512)


def surrogate(kind: Column, form: Column, attempt: Column, digest: Column) -> Column:
    """A made-up canonical form of the kind, chosen by the digest."""
    byte = lambda k: F.conv(F.substring(digest, F.pmod(k, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda letters, k: F.substring(F.lit(letters), F.pmod(byte(k), F.lit(len(letters))) + 1, F.lit(1))

    # what stays: an address' last domain, a number's country code
    kept = F.when(kind == "email", F.regexp_extract(form, r"(\.[a-z]{2,24})$", 1)).otherwise(F.lit(""))
    ahead = F.when(kind == "phone", F.regexp_extract(form, _COUNTRY, 0)).when(
        kind == "iban", F.substring(form, 1, 2)
    ).otherwise(F.lit(""))
    middle = F.substring(form, F.length(ahead) + 1, F.length(form) - F.length(ahead) - F.length(kept))

    def replaced(c: Column, k: Column) -> Column:
        new = F.when(c.rlike("[0-9]"), F.pmod(byte(k), F.lit(10)).cast("string"))
        new = new.when((kind == "token") & c.between("a", "f"), pick("abcdef", k))
        for letters, others in LETTERS:
            new = new.when(F.instr(F.lit(letters), c) > 0, pick(others, k))
        for script, letters in SCRIPTS:
            new = new.when(c.rlike(rf"\p{{Is{script}}}" if script else r"\p{L}") & c.rlike(r"\p{L}"), pick(letters, k))
        return new.otherwise(c)

    def more(letters: str) -> Column:
        # one more for each attempt after the first few, from the digest's end
        n = F.greatest(attempt - FIXED, F.lit(0))
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda j: F.when(j > 0, pick(letters, -j)).otherwise("")), "")

    spelled = F.when(F.length(middle) > 0, F.array_join(F.transform(F.split(middle, ""), replaced), "")).otherwise(F.lit(""))
    spelled = F.concat(ahead, spelled, kept)
    number = lambda k: F.conv(F.substring(digest, k * 4 - 3, F.lit(4)), 16, 10).cast("int")
    octet = lambda k: F.when(attempt > IN_RANGE, F.pmod(number(k), F.lit(1000))).otherwise(F.pmod(number(k), F.lit(254)) + 1)
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), octet).cast("array<string>"), ".")
    vowels = F.when(form.rlike(r"\p{IsCyrillic}"), more("аеиоу")).when(form.rlike(r"\p{IsGreek}"), more("αειου")).otherwise(more("aeiou"))

    def given(gender: str, names: tuple[tuple[str, ...], ...]) -> Column:
        """A listed name at first, then one of syllables, more of them with each attempt; by script."""
        name = None
        grown = F.sequence(F.lit(1), F.greatest(attempt - FIXED, F.lit(0)) + 1)
        for script, listed, (heads, middles), endings in zip(_LISTED, names, SYLLABLES, ENDINGS[gender]):
            made = F.concat(
                _from(heads, byte(F.lit(2))), F.array_join(F.transform(grown, lambda j: _from(middles, byte(j + 2))), ""), _from(endings, byte(F.lit(1)))
            )
            own = F.when(attempt == 0, _from(listed, byte(F.lit(1)))).otherwise(made)
            is_script = form.rlike(rf"^[\p{{{script}}}\p{{M}}'’-]+$")
            name = F.when(is_script, F.lower(own)) if name is None else name.when(is_script, F.lower(own))
        return name.otherwise(F.concat(spelled, vowels))

    male = given("male", (MALE_NAMES, MALE_CYRILLIC, MALE_GREEK))
    female = given("female", (FEMALE_NAMES, FEMALE_CYRILLIC, FEMALE_GREEK))
    new = F.when(kind == "male", male).when(kind == "female", female).when(kind == "ip", octets)
    new = new.when(kind.isin("family", "given"), F.concat(spelled, vowels))
    new = new.when(kind == "email", F.concat(more("bcdfghjklmnpqrstvwxyz"), spelled))
    new = new.when(kind == "token", F.concat(spelled, more("abcdef")))
    grown = F.concat(spelled, more("0123456789"))
    return new.when(kind == "card", _checked(form, grown)).otherwise(grown)


def laid(kind: Column, value: Column, attempt: Column, made: Column, letters: Column) -> Column:
    """The new form ``made``, whose letters and digits are ``letters``, in the format of ``value``."""
    alike = lambda c, new: F.when(c == F.lower(c), new).otherwise(F.upper(new))
    tail = F.regexp_extract(value, r"[^\p{L}\p{N}]*$", 0)
    body = F.split(F.substring(value, F.lit(1), F.length(value) - F.length(tail)), "")
    held = F.size(F.filter(body, lambda c: c.rlike(r"[\p{L}\p{N}]")))
    spare = F.greatest(F.size(letters) - held, F.lit(0))
    # what has grown stands before an address, else at the end, in the case of the last letter
    grown = lambda start: F.array_join(F.slice(letters, start, spare), "")
    front = F.when(kind == "email", grown(F.lit(1))).otherwise(F.lit(""))
    back = F.when(kind == "email", F.lit("")).otherwise(alike(F.element_at(body, -1), grown(F.size(letters) - spare + 1)))
    begin = F.struct(F.lit("").alias("text"), F.when(kind == "email", spare).otherwise(F.lit(0)).alias("n"))

    def step(done: Column, c: Column) -> Column:
        own = c.rlike(r"[\p{L}\p{N}]")
        new = F.when(own, alike(c, F.get(letters, done["n"]))).otherwise(c)
        return F.struct(F.concat(done["text"], new).alias("text"), (done["n"] + own.cast("int")).alias("n"))

    spelled = F.concat(front, F.aggregate(body, begin, step, lambda done: done["text"]), back, tail)
    # a whole name: only whether it is all in capitals is kept
    whole = kind.isin("male", "female") & F.lower(value).rlike("^(?:" + "|".join(rf"[\p{{{s}}}\p{{M}}'’-]+" for s in _LISTED) + ")$")
    return F.when(whole & (value == F.upper(value)), F.upper(made)).when(whole, F.initcap(made)).when(kind == "ip", made).otherwise(spelled)


def _from(names, chosen: Column) -> Column:
    return F.get(F.split(F.lit("|".join(names)), r"\|"), F.pmod(chosen, F.lit(len(names))))


def _luhn(number: Column) -> Column:
    """The sum over a number's digits that the last digit makes a multiple of ten."""
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))
    own = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0))
    return F.aggregate(F.transform(digits, own), F.lit(0), lambda a, b: a + b)


def _checked(value: Column, new: Column) -> Column:
    """``new`` with a check digit that is right if that of ``value`` is."""
    bare = F.concat(F.substring(new, F.lit(1), F.length(new) - 1), F.lit("0"))
    digit = F.pmod(10 - _luhn(bare) % 10, F.lit(10)).cast("string")
    return F.when(_luhn(value) % 10 == 0, F.concat(F.substring(new, F.lit(1), F.length(new) - 1), digit)).otherwise(new)


def _type(kind: Column) -> Column:
    return F.when(kind.isin(*_NAMED), "name").otherwise(kind)


def resolved(found: DataFrame, key: str) -> DataFrame:
    """``type, form, kind, attempt`` of the distinct entities of ``found(kind, form)``.

    A name is male or female where the corpus says one of both, else what is most specific. Ends when all new
    forms differ from each other and from all entities.
    """
    kinds = found.groupBy(_type(F.col("kind")).alias("type"), "form").agg(F.collect_set("kind").alias("kinds"))
    has = lambda kind: F.array_contains("kinds", kind)
    kind = F.when(F.col("type") != "name", F.col("kinds")[0]).when(has("male") & ~has("female"), "male")
    kind = kind.when(has("female") & ~has("male"), "female").when(has("given") | has("male"), "given").otherwise("family")
    known = written(kinds.select("type", "form", kind.alias("kind")), "entities")
    # forms that are not to be had: the entities themselves, then what each round settles
    barred = known.select("type", F.col("form").alias("made"))
    pending, done, attempt = known, None, 0
    while True:
        now = F.lit(attempt)
        drawn = pending.withColumn("digest", digest(F.col("type"), F.col("form"), now, key))
        drawn = drawn.select("kind", "type", "form", surrogate(F.col("kind"), F.col("form"), now, F.col("digest")).alias("made"))
        drawn = written(drawn, "surrogates")
        keeper = drawn.groupBy("type", "made").agg(F.min("form").alias("keeper"), F.count("*").alias("n"))
        crowded = keeper.where("n > 1").select("type", "made", "keeper")
        taken = barred.join(drawn.select("type", "made").distinct(), ["type", "made"], "left_semi").select("type", "made", F.lit(True).alias("taken"))
        judged = drawn.join(crowded, ["type", "made"], "left").join(taken.distinct(), ["type", "made"], "left")
        clash = F.coalesce("taken", F.lit(False)) | (F.col("keeper").isNotNull() & (F.col("keeper") != F.col("form")))
        judged = written(judged.select(*drawn.columns, clash.alias("clash")), "judged")
        settled, pending = judged.where("NOT clash"), judged.where("clash").select("kind", "type", "form")
        barred = barred.unionByName(settled.select("type", "made"))
        own = settled.select("type", "form", "kind", now.alias("attempt"))
        done = own if done is None else done.unionByName(own)
        if pending.isEmpty():
            return done
        attempt += 1


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``_n_entities``."""
    # names of our own that no column of the table bears
    own = "_pii"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    row, held, known = f"{own}_row", f"{own}_held", f"{own}_known"
    signs = F.coalesce(F.col("text").rlike(_SIGNS), F.lit(False))
    # the search is a step of its own, since what follows names its result more than once
    searched = docs.where(signs).withColumn(held, entities(F.col("text")))
    searched = searched.withColumn(held, F.when(F.size(F.col(held)["values"]) > 0, F.col(held)))
    searched = written(searched.withColumn(row, F.monotonically_increasing_id()), "searched")
    with_parts = searched.where(F.col(held).isNotNull()).withColumn(held, _parts(F.col(held)))

    each = with_parts.select(F.col(row).alias("row"), F.explode(held).alias("p")).where("p.value IS NOT NULL")
    each = each.select("row", F.col("p.kind").alias("kind"), canonical(F.col("p.kind"), F.col("p.value")).alias("form"))
    each = written(each.distinct(), "found")
    settled = written(resolved(each.select("kind", "form"), key), "settled")
    # what a text has to be told: the gender of its names, and later attempts
    told = settled.where("type = 'name' OR attempt > 0")
    of = each.select("row", _type(F.col("kind")).alias("type"), "form").distinct().join(told, ["type", "form"])
    of = of.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "type", "form"), F.struct("kind", "attempt")))).alias(known))
    # the same plan at every size: rows with an entity meet their forms by row number
    joined = with_parts.join(of.withColumnRenamed("row", row).hint("merge"), row, "left")

    # each step is a field of its own for the next one's lambdas, which evaluate what they hold for each element
    keep = lambda p, *more: F.struct(*[p[c].alias(c) for c in ("gap", "value", "kind")], *more)
    steps = F.transform(held, lambda p: keep(p, canonical(p["kind"], p["value"]).alias("form")))
    steps = F.transform(steps, lambda p: F.struct(
        p["gap"].alias("gap"), p["value"].alias("value"), p["kind"].alias("kind"), p["form"].alias("form"),
        F.try_element_at(F.col(known), F.concat_ws("|", _type(p["kind"]), p["form"])).alias("as"),
    ))
    steps = F.transform(steps, lambda p: F.struct(
        p["gap"].alias("gap"), p["value"].alias("value"), _type(p["kind"]).alias("type"), F.coalesce(p["as"]["kind"], p["kind"]).alias("kind"),
        p["form"].alias("form"), F.coalesce(p["as"]["attempt"], F.lit(0)).alias("attempt"),
    ))
    keep = lambda p, *more: F.struct(*[p[c].alias(c) for c in ("gap", "value", "type", "kind", "attempt")], *more)
    steps = F.transform(steps, lambda p: keep(p, p["form"].alias("form"), digest(p["type"], p["form"], p["attempt"], key).alias("digest")))
    steps = F.transform(steps, lambda p: keep(p, surrogate(p["kind"], p["form"], p["attempt"], p["digest"]).alias("made")))
    steps = F.transform(steps, lambda p: keep(
        p, p["made"].alias("made"), F.split(F.regexp_replace(p["made"], r"[^\p{L}\p{N}]", ""), "").alias("letters")
    ))
    steps = F.transform(steps, lambda p: F.struct(
        p["gap"].alias("gap"), p["value"].alias("value"), p["type"].alias("type"),
        F.when(p["value"].isNull(), "").otherwise(laid(p["kind"], p["value"], p["attempt"], p["made"], p["letters"])).alias("new"),
    ))
    made = f"{own}_made"
    joined = joined.withColumn(made, steps)
    # names wherever they stand: a surrogate is no entity of the corpus, so none is replaced twice
    names = F.array_distinct(F.transform(F.filter(made, lambda p: p["type"] == "name"), lambda p: F.struct(p["value"].alias("value"), p["new"].alias("new"))))
    spellings = F.concat(names, F.transform(names, lambda n: F.struct(F.upper(n["value"]).alias("value"), F.upper(n["new"]).alias("new"))))
    joined = joined.withColumn(known, F.array_distinct(spellings))
    alone = lambda n: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), n["value"], F.lit(r"(?![\p{L}\p{N}])"))
    unnamed = lambda gap: F.aggregate(F.col(known), gap, lambda text, n: F.regexp_replace(text, alone(n), n["new"]))
    text = F.array_join(F.transform(made, lambda p: F.concat(unnamed(p["gap"]), p["new"])), "")

    def out(df: DataFrame, text: Column, count: Column) -> DataFrame:
        columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "_n_entities"]
        return df.select(*columns, count.cast("long").alias("_n_entities"))

    rewritten = out(joined, text, F.size(made) - 1)
    bare = out(searched.where(F.col(held).isNull()), F.col("text"), F.lit(0))
    plain = out(docs.where(~signs), F.col("text"), F.lit(0))
    return rewritten.unionByName(bare).unionByName(plain)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text with surrogates for its personal data."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs).select("doc_id", "text", F.col("_n_entities").alias("n_entities"))
