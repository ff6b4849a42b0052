"""Personal data: detected entities get keyed, type-consistent surrogates, in DataFrame operations only.

One pattern finds all entities of a text. Each distinct entity (numbers by their digits, e-mail addresses and
names without regard to case, so that spellings of one entity stay one) gets a surrogate from a keyed digest:
digits for digits, letters for letters of the same case and script, the same length and punctuation, a valid
check digit where the original had one, an address of the same kind, a name of the gender its title tells.
Surrogates that meet, or that are a real entity of the corpus, of whatever kind, are drawn again until all are
distinct; names and addresses grow longer with the draws, so that drawing ends. A name that a title gives away is
replaced wherever its text repeats it, whole or by its last word, and names that share a last word keep sharing one.
Prefixes of secrets stay, check digits of cards and IBANs are made to fit where the original's did.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Entity types and patterns, in order of precedence.
TITLES_F, TITLES_M = "Mrs|Ms|Miss|Frau|Madame|Señora|Sra|Госпожа", "Mr|Herr|Monsieur|Señor|Sr|Господин"
PATTERNS = {
    "EMAIL": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
    "IP": "(?<![0-9.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?![0-9])",
    "PHONE": "(?<![0-9A-Za-z])\\+?[0-9]{1,3}[ .-]?\\([0-9]{2,4}\\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "SSN": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "CARD": "(?<![0-9A-Za-z])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "IBAN": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "SECRET": "(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|(?:sk|ghp|AKIA|xox[bp])[-_A-Za-z0-9]{12,})(?![A-Za-z0-9])",
    "NAME": f"(?<=\\b(?:{TITLES_F}|{TITLES_M})\\.? )\\p{{Lu}}[\\p{{L}}'-]+(?: \\p{{Lu}}[\\p{{L}}'-]+)?",
}
FIND = "|".join(PATTERNS.values())
#: A text without these has no entity: three digits or hexadecimal runs, an at sign, a title.
QUICK = f"[0-9][0-9. ()-]*[0-9]|[0-9a-f]{{32}}|@|(?:sk|ghp|AKIA|xox[bp])[-_A-Za-z0-9]{{12}}|\\b(?:{TITLES_F}|{TITLES_M})\\b"
#: The beginnings that tell what a secret is for.
PREFIX = "^(?:sk|ghp|AKIA|xox[bp])[-_]?"
#: Draws after which a made-up address or given name grows by a letter or syllable.
DRAWS = 8
#: Parts of made-up names by script and gender.
GIVEN = {"LF": "Ada Berta Clara Dora Edith Flora Greta Hanna".split(), "LM": "Albert Bruno Carl David Emil Frank Georg Henry".split(), "CF": "Анна Вера Дина Елена Зоя Инна Лидия Мария".split(), "CM": "Антон Борис Глеб Денис Егор Иван Лев Марк".split()}
SYLLABLES = {"L": "ba de fi go ku la me ni po ra so tu va wen zi lor".split(), "C": "ба де фи го ку ла ме ни по ра со ту ва вен зи лор".split()}


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _byte(h: Column, i: Column | int) -> Column:
    at = (F.pmod(i if isinstance(i, Column) else F.lit(i), F.lit(64)) * 2 + 1).cast("int")
    return F.conv(F.substring(h, at, 2), 16, 10).cast("int")


def kind_of(entity: Column) -> Column:
    out = F
    for name, p in PATTERNS.items():
        if name != "NAME":
            out = out.when(entity.rlike(f"^(?:{p})$"), name)
    return out.otherwise("NAME")


def canonical(kind: Column, entity: Column) -> Column:
    """Digits of numbers, lower case of addresses and names."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return F.when(kind.isin("PHONE", "SSN", "CARD"), digits).when(kind.isin("EMAIL", "NAME"), F.lower(entity)).when(kind == "IBAN", F.replace(entity, F.lit(" "), F.lit(""))).otherwise(entity)


def luhn(digits: Column) -> Column:
    """Sum modulo 10 of the card check: every second digit from the right is doubled."""
    part = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).when(i % 2 == 0, c.try_cast("int")).otherwise((c.try_cast("int") * 2 % 10) + F.floor(c.try_cast("int") / 5).cast("int")))
    return F.pmod(F.aggregate(part, F.lit(0), lambda a, x: a + x), F.lit(10))


def iban97(text: Column) -> Column:
    """The number that letters (A is 10) and digits spell, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.array_remove(F.split(text, ""), ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def surrogate(kind: Column, canon: Column, gender: Column, key: str, attempt: Column, family_made: Column) -> Column:
    """The canonical form of the surrogate: a function of the key, the entity and the attempt alone, and for a name of
    two words of the surrogate of its last one (family_made)."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 512)
    chars = F.array_remove(F.split(canon, ""), "")
    keep_from = F.when(kind == "EMAIL", F.length(canon) - F.length(F.substring_index(canon, ".", -1))).otherwise(F.length(canon))
    prefix = F.when(kind == "IBAN", 2).when(kind == "SECRET", F.length(F.regexp_extract(canon, PREFIX, 0))).otherwise(0)
    hexed = (kind == "SECRET") & canon.rlike("^[0-9a-f]+$")
    letters = "abcdefghijklmnopqrstuvwxyz"

    def char(c: Column, i: Column) -> Column:
        b = _byte(h, i)
        low = F.substring(F.lit(letters), F.when(hexed, F.pmod(b, F.lit(6))).otherwise(F.pmod(b, F.lit(26))) + 1, F.lit(1))
        return (
            F.when((i >= keep_from) | (i < prefix), c)
            .when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string"))
            .when(c.rlike("[a-z]"), low)
            .when(c.rlike("[A-Z]"), F.upper(low))
            .otherwise(c)
        )

    plain = F.array_join(F.transform(chars, char), "")
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    # the last digit that makes the check sum 0
    fixed = F.concat(body, F.pmod(F.lit(10) - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    rest = F.substring(plain, F.lit(5), F.length(plain))
    check = F.lpad((F.lit(98) - iban97(F.concat(rest, F.substring(canon, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(F.substring(canon, 1, 2), check, rest)
    turned = F.concat(F.substring(canon, F.lit(5), F.length(canon)), F.substring(canon, 1, 4))
    more = F.floor(attempt / DRAWS).cast("int")
    # an address grows by letters of its own digest
    longer = F.concat(F.translate(F.substring(F.sha2(h, 256), F.lit(1), more), "0123456789", "ghijklmnop"), plain)
    card = F.when((kind == "CARD") & (luhn(canon) == 0), fixed).when((kind == "IBAN") & (iban97(turned) == 1), iban).when(kind == "EMAIL", longer).otherwise(plain)
    ip = F.concat_ws(".", *[(F.pmod(_byte(h, i), F.lit(254)) + 1).cast("string") for i in range(4)])
    cyr = canon.rlike("\\p{IsCyrillic}")
    n = [_byte(h, i) for i in range(8)]
    given = F.when(cyr & (gender == "F"), _pick(GIVEN["CF"], n[0])).when(cyr, _pick(GIVEN["CM"], n[0])).when(gender == "F", _pick(GIVEN["LF"], n[0])).otherwise(_pick(GIVEN["LM"], n[0]))
    family = F.initcap(F.when(cyr, F.concat(*[_pick(SYLLABLES["C"], x) for x in n[1:6]])).otherwise(F.concat(*[_pick(SYLLABLES["L"], x) for x in n[1:6]])))
    tail = lambda s: F.array_join(F.transform(F.sequence(F.lit(1), more), lambda i: F.when(i <= more, _pick(SYLLABLES[s], _byte(h, i + 8))).otherwise("")), "")
    grown = F.when(more == 0, "").when(cyr, tail("C")).otherwise(tail("L"))
    name = F.when(F.contains(canon, F.lit(" ")), F.concat_ws(" ", F.concat(given, grown), family_made)).otherwise(F.concat(family, grown))
    return F.when(kind == "IP", ip).when(kind == "NAME", name).otherwise(card)


def rendered(kind: Column, entity: Column, made: Column) -> Column:
    """The surrogate in the entity's own format: its separators and its upper case."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    spaced = kind.isin("PHONE", "SSN", "CARD", "IBAN")

    def add(acc: Column, c: Column) -> Column:
        own = F.substring(made, acc["n"] + 1, F.lit(1))
        skip = F.when(kind == "IBAN", c == " ").otherwise(~c.rlike("[0-9]"))
        return F.when(spaced & skip, F.struct(F.concat(acc["s"], c).alias("s"), acc["n"].alias("n"))).otherwise(F.struct(F.concat(acc["s"], F.when(c.rlike("[A-Z]"), F.upper(own)).otherwise(own)).alias("s"), (acc["n"] + 1).alias("n")))

    shaped = F.aggregate(F.array_remove(F.split(entity, ""), ""), start, add, lambda a: a["s"])
    return F.when(kind.isin("IP", "NAME"), made).otherwise(shaped)


def _drawn(entities: DataFrame, real: DataFrame, others: DataFrame | None, key: str) -> DataFrame:
    """kind, canon, made: one surrogate for each of entities (kind, canon, gender, family_made), distinct among them and
    from the canonical forms of all real entities and of others (form)."""
    taken = real.select(F.col("canon").alias("form"))
    taken = stored((taken if others is None else taken.unionByName(others)).distinct().withColumn("taken", F.lit(True)), "taken")
    now = entities.withColumn("attempt", F.lit(0))
    while True:
        made = now.withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.coalesce("gender", F.lit("M")), key, F.col("attempt"), F.col("family_made")))
        made = made.withColumn("form", canonical(F.col("kind"), F.col("made")))
        w = Window.partitionBy("form").orderBy("attempt", "kind", "canon")
        out = stored(made.join(taken, "form", "left").withColumn("turn", F.row_number().over(w)), "surrogates")
        bad = F.col("taken").isNotNull() | (F.col("turn") > 1)
        if out.where(bad).isEmpty():
            return out.select("kind", "canon", "made", "form")
        now = out.select("kind", "canon", "gender", "family_made", (F.col("attempt") + F.when(bad, 1).otherwise(0)).alias("attempt"))


def last_word(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, made: one distinct surrogate for each canonical entity, none of them a real one, of whatever kind; and
    for the last word of each name of two words, which its surrogate ends with."""
    double = (F.col("kind") == "NAME") & F.contains("canon", F.lit(" "))
    rows = entities.select("kind", "canon", "gender")
    rows = rows.unionByName(rows.where(double).select("kind", last_word(F.col("canon")).alias("canon"), F.lit(None).cast("string").alias("gender")))
    real = stored(rows.groupBy("kind", "canon").agg(F.min("gender").alias("gender")), "entities")
    single = _drawn(real.where(~double).withColumn("family_made", F.lit(None).cast("string")), real, None, key)
    family = single.where("kind = 'NAME'").select(F.col("canon").alias("last"), F.col("made").alias("family_made"))
    names = real.where(double).join(family, last_word(F.col("canon")) == F.col("last")).drop("last")
    return single.unionByName(_drawn(names, real, single.select("form"), key)).drop("form")


def _text_key(text: Column) -> Column:
    """Tells texts apart: rows of one text share its entities, so no id, and no lack of one, gathers many texts."""
    return F.concat_ws("-", F.xxhash64(text).cast("string"), F.char_length(text).cast("string"))


def found(docs: DataFrame) -> DataFrame:
    """key, entity, kind, gender of the distinct entities of each text."""
    hit = docs.where(F.col("text").rlike(QUICK))
    all_of = F.regexp_extract_all("text", F.lit(FIND), F.lit(0))
    female = F.regexp_extract_all("text", F.lit(f"(?<=\\b(?:{TITLES_F})\\.? )\\p{{Lu}}[\\p{{L}}'-]+(?: \\p{{Lu}}[\\p{{L}}'-]+)?"), F.lit(0))
    out = hit.select(_text_key(F.col("text")).alias("key"), F.explode(F.array_distinct(all_of)).alias("entity"), F.when(F.col("text").rlike(f"\\b(?:{TITLES_F})\\b"), female).alias("female"))
    return out.select("key", "entity", kind_of(F.col("entity")).alias("kind"), F.when(F.array_contains("female", F.col("entity")), "F").otherwise("M").alias("gender"))


def anonymised(docs: DataFrame, key: str = "docketlab") -> DataFrame:
    """docs with text replaced, and n_entities (occurrences replaced; a column of that name that the caller has gives way).

    Null texts stay null; texts without entities are passed through and never shuffle. One key gives one mapping over
    the whole table, whatever rows share an id or have none. Later mentions of a name that a title gave away in the
    same text are replaced too. All other columns pass through, whatever their names: they travel as one.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))
    seen = stored(found(keyed.select("text")).distinct().withColumn("canon", canonical(F.col("kind"), F.col("entity"))), "found")
    made = stored(surrogates(seen, key), "made")
    forms = stored(seen.select("kind", "canon", "entity").distinct().join(made, ["kind", "canon"]).select("kind", "entity", rendered(F.col("kind"), F.col("entity"), F.col("made")).alias("made")), "forms")
    per = seen.select("key", "kind", "entity").distinct().join(forms, ["kind", "entity"])
    # the last words of names of two, as later mentions; a name of its own right goes before
    last = per.where((F.col("kind") == "NAME") & F.contains("entity", F.lit(" "))).select("key", "kind", last_word(F.col("entity")).alias("entity"), last_word(F.col("made")).alias("made"))
    per = per.unionByName(last).groupBy("key", "entity").agg(F.min("kind").alias("kind"), F.min("made").alias("made"))
    quoted = F.collect_list(F.when(F.col("kind") == "NAME", F.struct((-F.length("entity")).alias("n"), F.concat(F.lit("\\Q"), "entity", F.lit("\\E")).alias("q"))))
    per = per.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("entity", "made"))).alias("map"), F.array_join(F.transform(F.array_sort(quoted), lambda x: x["q"]), "|").alias("again"))
    own = lambda text: [text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    quick = F.coalesce(F.col("text").rlike(QUICK), F.lit(False))
    plain = keyed.where(~quick).select(*own(F.col("text")), F.lit(0).cast("long").alias("n_entities"))
    rest = keyed.where(quick).withColumn("key", _text_key(F.col("text"))).join(per, "key", "left")
    mention = F.when(F.coalesce("again", F.lit("")) != "", F.concat(F.lit(FIND + "|(?<![\\p{L}\\p{N}])(?:"), "again", F.lit(")(?![\\p{L}\\p{N}])"))).otherwise(FIND)
    rest = rest.withColumn("find", mention)
    found_here, parts = F.regexp_extract_all("text", F.col("find"), F.lit(0)), F.split("text", F.col("find"), -1)
    mapped = F.transform(found_here, lambda e: F.coalesce(F.try_element_at("map", e), e))
    joined = F.array_join(F.zip_with(parts, mapped, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return plain.unionByName(rest.select(*own(F.when(F.col("map").isNull(), F.col("text")).otherwise(joined)), F.when(F.col("map").isNull(), 0).otherwise(F.size(found_here)).cast("long").alias("n_entities")))
