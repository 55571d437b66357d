"""Surrogates for personal data, in DataFrame operations only.

Detected entities get keyed replacements of their own type and format: the same entity the same one everywhere, however
it is written, different entities different ones. Digits become digits, letters letters of their case, check digits stay
valid, addresses stay addresses, names become names of the same gender and script. A name is replaced word by word, so
that "Mr Smith" and "Mr John Smith" keep their surname in common. Surrogates that two entities share, or that are an
entity of the corpus themselves, are drawn anew until none is left."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import cut, steady, unused

#: Setting that has the deployment's secret key. Without it each driver draws a key of its own, which nobody can rebuild.
KEY_SETTING = "spark.linework.pii.key"
_drawn_key = secrets.token_hex(32)
#: Draws in a row that may place no surrogate before the shape counts as used up (more cards than there are numbers).
IDLE_DRAWS = 50

# Patterns of the entities, first match wins, and names by gender and script.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<=(?i:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_+/=-]{6,}|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})|\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,64}\b"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9](?:[ .()-]{0,2}[0-9]){7,13}(?![0-9])"
SSN = r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
FEMALE_LATIN = ["Anna", "Clara", "Elena", "Emma", "Julia", "Laura", "Maria", "Nina", "Olivia", "Sophie"]
MALE_LATIN = ["Adam", "Daniel", "David", "Felix", "Jonas", "Lucas", "Martin", "Oscar", "Paul", "Thomas"]
SURNAMES_LATIN = ["Alder", "Bergmann", "Castell", "Dorval", "Eriksen", "Farrow", "Garrido", "Holm", "Irving", "Jansen", "Keller", "Lindqvist", "Moreau", "Novak", "Ortega", "Pryce", "Quint", "Rossi", "Sander", "Tanner"]
FEMALE_CYRILLIC = ["Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга"]
MALE_CYRILLIC = ["Антон", "Борис", "Иван", "Олег", "Павел", "Юрий"]
SURNAMES_CYRILLIC = ["Белов", "Волков", "Громов", "Данилов", "Зимин", "Крылов", "Лебедев", "Морозов"]
# by consonant and vowel: what a redrawn surname gets more of
SYLLABLES_LATIN = [c + v for c in "bdfghklmnprstvwz" for v in "aeio"]
SYLLABLES_CYRILLIC = [c + v for c in "бвгдзклмнпрстфхш" for v in "аеио"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Г-жа"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н"]
TITLES = "|".join([*FEMALE_TITLES, *MALE_TITLES])
# words of a name may have capitals inside; initials count; at most three words, as capitals also begin other words
WORD = r"\p{Lu}(?:\.|[\p{L}'’-]*\p{Ll}[\p{L}'’-]*)"
NAME = rf"\b(?:{TITLES})\.? {WORD}(?: {WORD}){{0,2}}"

TYPES = [("email", EMAIL), ("secret", SECRET), ("iban", IBAN), ("ipv4", IPV4), ("phone", PHONE), ("ssn", SSN), ("card", CARD), ("name", NAME)]
PATTERN = "|".join(p for _, p in TYPES)
#: A text without any of these has no entity.
HINT = rf"[0-9@]|(?i:token|secret|passw|pwd|key)|\bgh[pousr]_|\bsk-|\b(?:{TITLES})\b"
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def type_of(raw: Column) -> Column:
    """Of a match of PATTERN: which alternative it is."""
    whole = {"email": r"^[^@\s]+@[^@\s]+$", "ipv4": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$", "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "card": r"^[0-9](?:[ -]?[0-9]){12,18}$", "phone": r"^[+(0-9][0-9 .()+-]+$", "name": rf"^(?:{TITLES})\.? \p{{Lu}}", "iban": rf"^{IBAN}$"}
    out = F.lit("secret")
    for name in ("iban", "name", "phone", "card", "ssn", "ipv4", "email"):
        out = F.when(raw.rlike(whole[name]), name).otherwise(out)
    return out


def canonical(raw: Column, kind: Column) -> Column:
    """What all spellings of one entity have in common."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    bare = F.lower(F.regexp_replace(raw, rf"^(?:{TITLES})\.? ", ""))
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "email", F.lower(raw)).when(kind == "iban", F.regexp_replace(raw, " ", "")).when(kind == "name", bare).when(kind.isin("surname", "forename"), F.lower(raw)).otherwise(raw)


def signs_of(text: Column) -> Column:
    return F.filter(F.split(text, "(?!^)"), lambda c: c != "")


def number(bits: Column, i: Column) -> Column:
    """0 to 255 from the hash, for sign i (from 0); long entities go round."""
    at = F.pmod(i, F.lit(64)) * 2
    return F.conv(F.substring(bits, at + 1, F.lit(2)), 16, 10).cast("int")


def luhn(digits: Column) -> Column:
    """Check sum of a string of digits, 0 if it is valid."""
    own = F.transform(F.reverse(signs_of(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + (c.cast("int") >= 5).cast("int")))
    return F.pmod(F.aggregate(own, F.lit(0), lambda a, x: a + x), F.lit(10))


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or _drawn_key


def surrogate(canon: Column, kind: Column, draw: int, key: str, gender: Column | None = None) -> Column:
    """The canonical surrogate of a canonical entity: keyed, and of the same type and shape."""
    bits = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, F.lit(str(draw))), 512)
    signs = signs_of(canon)
    hexes = (kind == "secret") & canon.rlike("^[0-9a-f]+$")
    tail = F.when(kind == "email", F.char_length(F.regexp_extract(canon, r"\.[a-z]+$", 0))).otherwise(0)  # the top domain stays
    head = F.when(kind == "iban", 2).when((kind == "phone") & (F.char_length(canon) > 10), F.char_length(canon) - 10).otherwise(0)  # so do country codes
    pick = lambda letters, n: F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))

    def sign(c: Column, i: Column) -> Column:
        n = number(bits, i)
        new = F.when(hexes, pick("0123456789abcdef", n)).when(c.rlike("[0-9]"), F.when((i == head) & kind.isin("phone", "card", "ssn"), pick("23456789", n)).otherwise(pick(DIGITS, n))).when(c.rlike("[a-z]"), pick(LOWER, n)).when(c.rlike("[A-Z]"), pick(LOWER.upper(), n)).otherwise(c)
        return F.when((i < head) | (i >= F.size(signs) - tail), c).otherwise(new)

    shaped = F.array_join(F.transform(signs, sign), "")
    body = F.left(shaped, F.char_length(shaped) - 1)
    check = F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(luhn(canon) == 0, F.concat(body, check)).otherwise(shaped)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(number(bits, i), F.lit(254)) + 1).cast("string")), ".")
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    female = F.lit(False) if gender is None else gender
    choose = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))) + 1)
    wide = lambda at: F.conv(F.substring(bits, at, 6), 16, 10).cast("int")
    last = F.when(cyrillic, choose(SURNAMES_CYRILLIC, wide(1))).otherwise(choose(SURNAMES_LATIN, wide(1)))
    # a list of names is short: more syllables, from the hash, keep different people apart
    more = F.when(cyrillic, choose(["ский", "ин", "ев", "ко"], wide(7))).otherwise(F.concat(choose(["", "ton", "ley", "mark", "stad", "berg", "court", "well"], wide(7)), choose(["", "son", "sen", "er", "ard", "is", "ovan", "ell"], wide(13))))
    # each draw has 64 times the names of the one before, so what does not fit into one finds room in the next
    grown = lambda values: F.concat(*[choose(values, wide(25 + 6 * j)) for j in range(min(draw, 16))])
    syllables = F.when(cyrillic, grown(SYLLABLES_CYRILLIC)).otherwise(grown(SYLLABLES_LATIN)) if draw else F.lit("")
    first = F.when(female & cyrillic, choose(FEMALE_CYRILLIC, wide(19))).when(cyrillic, choose(MALE_CYRILLIC, wide(19))).when(female, choose(FEMALE_LATIN, wide(19))).otherwise(choose(MALE_LATIN, wide(19)))
    out = F.when(kind == "ipv4", octets).when(kind == "card", card).when(kind == "surname", F.concat(last, syllables, more))
    out = out.when(kind == "forename", F.concat(first, syllables))
    # short addresses and secrets run out of letters: later draws are longer
    longer = F.translate(F.substring(bits, 100, min(max(draw - 3, 0), 24)), DIGITS + "abcdef", LOWER[:16])
    return out.when(kind == "email", F.concat(longer, shaped)).when((kind == "secret") & ~hexes, F.concat(shaped, longer)).otherwise(shaped)


def formatted(raw: Column, kind: Column, new: Column) -> Column:
    """The surrogate in the format of one mention: its separators, its title, its upper case."""
    signs = signs_of(raw)
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    grouped = F.aggregate(signs, start, lambda a, c: F.when(c.rlike("[0-9A-Z]"), F.struct(F.concat(a["s"], F.substring(new, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))))["s"]
    cased = F.array_join(F.zip_with(signs, signs_of(new), lambda c, n: F.when(c.rlike("[A-Z]"), F.upper(n)).otherwise(F.coalesce(n, F.lit("")))), "")
    return F.when(kind.isin("phone", "card", "ssn", "iban"), grouped).when(kind == "email", cased).otherwise(new)


def female_title(raw: Column) -> Column:
    return raw.rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})\.? ")


def words_of(name: Column) -> Column:
    """Of a canonical name: its words, the last one a surname, as (kind, canon)."""
    words = F.split(name, " ")
    return F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, "surname").otherwise("forename").alias("kind"), w.alias("canon")))


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """entities: kind, canon, female, one row an entity: (kind, canon, new, norm), new without clashes.

    A surrogate clashes if a different entity of its kind has it too (of those the smallest keeps it) or if it is an
    entity of the corpus. What clashes is drawn again, against all that stands, however often that takes."""
    taken = entities.select("kind", F.col("canon").alias("norm"))
    drawing, done, draw, idle = entities, None, 0, 0
    while True:
        now = drawing.withColumn("new", surrogate(F.col("canon"), F.col("kind"), draw, key, F.col("female")))
        now = cut(now.withColumn("norm", canonical(F.col("new"), F.col("kind"))), "drawn")
        first = now.groupBy("kind", "norm").agg(F.min("canon").alias("canon"))
        fine = now.join(first, ["kind", "norm", "canon"], "left_semi").join(taken, ["kind", "norm"], "left_anti")
        if done is not None:
            fine = fine.join(done, ["kind", "norm"], "left_anti")
        fine = cut(fine.select("kind", "canon", "new", "norm"), "fine")
        drawing = cut(now.join(fine, ["kind", "canon"], "left_anti").select("kind", "canon", "female"), "left")
        idle = idle + 1 if fine.isEmpty() else 0
        # one table however many draws there are: plans must not grow with them
        done = fine if done is None else done if idle else cut(done.unionAll(fine), "done")
        if drawing.isEmpty():
            return done
        if idle > IDLE_DRAWS:
            raise ValueError("a kind of entity has more members than surrogates of its shape")
        draw += 1


def surrogates(entities: DataFrame, key: str | None = None) -> DataFrame:
    """entities: kind, canon, female, one row an entity: (kind, canon, new), new without clashes. Names are put together
    from the surrogates of their words, so equal words stay equal and different names stay different."""
    key = key or key_of(entities.sparkSession)
    names = entities.where("kind = 'name'").select("kind", "canon", "female", F.posexplode(words_of(F.col("canon"))).alias("pos", "w"))
    words = names.select("w.kind", "w.canon", "female").groupBy("kind", "canon").agg(F.max("female").alias("female"))
    of = drawn(cut(entities.where("kind <> 'name'").select("kind", "canon", "female").unionAll(words), "words"), key)
    made = names.join(of.select(F.col("kind").alias("wk"), F.col("canon").alias("wc"), "new").hint("merge"), (F.col("w.kind") == F.col("wk")) & (F.col("w.canon") == F.col("wc")))
    whole = made.groupBy("kind", "canon").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]), " ").alias("new"))
    return of.where("kind not in ('surname', 'forename')").select("kind", "canon", "new").unionAll(whole)


def pseudonymise(docs: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with the entities of text_col replaced, and entities_ (long), how many mentions there were.

    Texts without an entity, null and empty ones stay as they are; very long ones are read whole; an empty table gives an
    empty one; columns keep their names. Repeated rows and repeated mentions get the same surrogates. Names need a title
    before them, which tells the gender; the same name with titles of both genders is taken as female. The key is given,
    or the setting KEY_SETTING, or one that this driver draws."""
    docs = steady(docs)
    row, own, n = unused(docs, "row", "own", "entities_")
    told = docs.withColumn(row, F.monotonically_increasing_id())
    raw = told.where(F.col(text_col).rlike(HINT)).select(F.col(row).alias("row"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0))).alias("pos", "raw"))
    typed = cut(raw.withColumn("kind", type_of(F.col("raw"))), "typed")
    # names by word, in place of the whole: the words' surrogates are what all names that share them have in common
    whole = typed.select("row", "pos", "raw", "kind", canonical(F.col("raw"), F.col("kind")).alias("canon"), ((F.col("kind") == "name") & female_title(F.col("raw"))).alias("female"))
    parts = F.when(F.col("kind") == "name", words_of(F.col("canon"))).otherwise(F.array(F.struct(F.col("kind").alias("kind"), F.col("canon").alias("canon"))))
    mentions = cut(whole.select("row", "pos", "raw", "female", F.posexplode(parts).alias("part", "w")).select("row", "pos", "part", "raw", "female", "w.kind", "w.canon"), "mentions")
    entities = cut(mentions.groupBy("kind", "canon").agg(F.max("female").alias("female")), "entities")
    of = drawn(entities, key or key_of(docs.sparkSession)).select("kind", "canon", "new")
    # one plan at every size; an entity that many texts have is split by the skew join
    placed = mentions.join(of.hint("merge"), ["kind", "canon"]).select("row", "pos", "part", "raw", "kind", formatted(F.col("raw"), F.col("kind"), F.col("new")).alias("new"))
    title = F.when((F.col("kind").isin("surname", "forename")) & (F.col("part") == 0), F.regexp_extract("raw", rf"^(?:{TITLES})\.? ", 0)).otherwise("")
    of_part = placed.select("row", "pos", F.struct("part", F.concat(title, "new").alias("new")).alias("x")).repartition("row")
    joined = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["new"])
    of_mention = of_part.groupBy("row", "pos").agg(F.array_join(joined("x"), " ").alias("new"))
    of_row = of_mention.groupBy("row").agg(joined(F.struct("pos", "new")).alias("new"))
    of_row = cut(of_row.select(F.col("row").alias(f"{row}_"), F.col("new").alias(own)), "replacements")
    both = told.join(of_row.hint("merge"), F.col(row) == F.col(f"{row}_"), "left")
    pieces = F.split(F.col(text_col), PATTERN, -1)
    text = F.array_join(F.flatten(F.zip_with(pieces, F.col(own), lambda p, r: F.array(p, F.coalesce(r, F.lit(""))))), "")
    return both.select(*[F.when(F.col(own).isNotNull(), text).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns], F.coalesce(F.size(F.col(own)), F.lit(0)).cast("long").alias(n))
