"""Surrogates for personal data, with SQL functions only.

E-mail addresses, phone and card numbers, IP addresses, IBANs, national ids and names are found by one expression and
replaced by surrogates of the same kind, gender, script and format. A surrogate is drawn from a keyed hash of the
entity's canonical form (digits of a number, lower case of a word), so every mention of an entity, in whatever format
and document, gets the same one (coreference). The drawn canonical forms are checked: two entities that drew one
surrogate, or an entity whose surrogate is a real entity of the corpus, draw again with the next attempt, all but the
first of them, until none is left (distinctness). Card numbers and IBANs with valid check digits keep valid ones.

A name begins with a title or a common given name and takes in initials, particles and up to four capitalised words. Its
words are entities of their own: the last is a surname, those before it (and a common given name) are given names. So
"Mrs. Anna Schmidt", "Frau Schmidt" and "Dr. Schmidt" share a surname, and where a text names someone, later mentions of
any of these words in it are replaced too. A given name has one gender in the whole corpus: that of the list, else of a
title it was met with, else male. Names that no title or common given name introduces are not found. Initials change
with the key but may coincide.

The table of distinct entities is spread by hash over partitions that grow with its rows; a value that occurs in a third
of all rows is summed before that and meets its surrogate in a join that Spark can split. Only texts that hold an entity
cross the network. Texts are searched once to find entities and once to replace them, whole, at any length.

Null texts stay null, empty ones empty. Texts without entities pass unchanged, as do other columns; a column named
n_entities is replaced by the output. Repeated rows get equal results. The key is a secret of the caller: another key
gives other surrogates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_MALE = r"Mr|Sir|Herrn?|Señor|Sr|Monsieur|Don|Г-н|Господин"
_FEMALE = r"Mrs|Ms|Miss|Mme|Mlle|Madame|Frau|Señora|Sra|Srta|Doña|Г-жа|Госпожа"
_TITLE = rf"(?:{_MALE}|{_FEMALE}|Dr|Prof)"
#: Common given names by gender: they introduce a name without a title, and are drawn as surrogates.
_FIRST = {
    "m": "James Peter Tomas Andrew Victor Martin Oscar Hugo Felix Simon Edgar Louis Bruno Karl Anton Paul Robert Michael David Thomas Daniel Mark Stephen Kevin Brian George Edward Ronald Jason Eric Frank Scott Henry Walter Arthur Albert Carlos Juan Luis Diego Pablo Javier Hans Klaus Jürgen Wolfgang Stefan Uwe Pierre Jean Michel François Antoine Olivier Bob Tom Jack William Richard Charles Joseph John",
    "f": "Anna Clara Marie Laura Helen Sofia Emma Julia Nora Irene Alice Rosa Diana Vera Ida Lena Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Betty Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Maria Carmen Lucia Isabel Elena Petra Monika Sabine Ursula Heike Camille Sophie Chloé Claire Hélène Juliette Olga Katharina Margaret",
}
_WORD, _INITIAL, _PARTICLE = r"\p{Lu}[\p{L}'’-]+", r"\p{Lu}\.\x20?", r"(?:von|van|de|der|den|del|della|di|da|dos|du|la|le|ter|zu|bin|al)\x20"
_PERSON = rf"(?:{_INITIAL}|{_PARTICLE})*{_WORD}(?:\x20(?:{_INITIAL}|{_PARTICLE})*{_WORD}){{0,3}}"
_GIVEN = rf"(?=\p{{Lu}})(?:{'|'.join(' '.join(_FIRST.values()).split())})\x20"
_NAME = rf"\b{_TITLE}\.?\x20{_PERSON}|(?<![\p{{L}}\p{{N}}]){_GIVEN}(?:{_INITIAL}|{_PARTICLE})*{_WORD}(?:\x20(?:{_INITIAL}|{_PARTICLE})*{_WORD}){{0,2}}"
_PATTERNS = [
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"),
    ("iban", r"\b[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    ("phone", r"(?<!\w)\+\d{1,3}[\x20.-]?\(?\d{1,4}\)?(?:[\x20.-]?\d{2,4}){2,4}(?!\d)|(?<!\w)\(\d{3}\)\x20?\d{3}[.-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w.])\d{4}(?:[\x20-]\d{4}){2}[\x20-]\d{1,7}(?!\w)|(?<![\w.])\d{13,19}(?!\w)"),
    ("name", _NAME),
]
PATTERN = "|".join(f"(?:{p})" for _, p in _PATTERNS)
#: In texts that name someone, any further capitalised word may be one of the names.
_WIDER = rf"{PATTERN}|(?<![\p{{L}}\p{{N}}]){_WORD}"
#: Cheap, and found in every text that holds an entity: only such texts are searched by PATTERN.
_NAMED = rf"\b{_TITLE}\.?\x20\p{{Lu}}|\p{{Lu}}(?<=(?:\A|[^\p{{L}}\p{{N}}]).)\p{{Ll}}+\x20(?:(?:{_PARTICLE})*\p{{Lu}})"
_HINT = rf"[@\d]|{_NAMED}"
_LATIN = ("aeiouy", "bcdfghjklmnpqrstvwxz")
_ACCENT = "àáâäãåæçèéêëìíîïñòóôöõøùúûüýß"
_CYRILLIC, _GREEK = "абвгдежзиклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"
#: Set round entities while they are replaced; texts that hold it themselves take another way.
_FENCE = "\ue000"
_ROWS_EACH = 2000


def _kind(e: Column) -> Column:
    out = F.lit("name")
    for k, p in reversed(_PATTERNS[:-1]):
        out = F.when(e.rlike(rf"\A(?:{p})\z"), k).otherwise(out)
    return out


def _title(e: Column) -> Column:
    return F.regexp_extract(e, rf"\A({_TITLE}\.?\x20)", 1)


def _canonical(e: Column, kind: Column) -> Column:
    """What mentions of one entity share."""
    digits = F.regexp_replace(e, r"\D", "")
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", F.upper(F.regexp_replace(e, " ", ""))).otherwise(F.lower(e))


def _byte(stream: Column, i: Column | int) -> Column:
    """The i-th of 64 bytes of a hash in hexadecimal, as a number; further ones go round with the position mixed in."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(stream, (i % 64 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + F.floor(i / 64).cast("int") * 7


def _hashed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256), F.lit(key)), 512)


def _reshaped(canon: Column, stream: Column, keep: Column) -> Column:
    """Each character becomes one of its class and script; the first `keep` characters and marks stay."""

    def one(c: Column, i: Column) -> Column:
        r = _byte(stream, i)
        low, out = F.lower(c), c
        for alphabet in (_GREEK, _CYRILLIC, _ACCENT, *_LATIN):
            letter = F.substring(F.lit(alphabet), r % len(alphabet) + 1, F.lit(1))
            out = F.when(F.instr(F.lit(alphabet), low) > 0, F.when(low != c, F.upper(letter)).otherwise(letter)).otherwise(out)
        out = F.when(c.rlike(r"\d"), F.pmod(r, F.lit(10)).cast("string")).otherwise(out)
        return F.when(i < keep, c).otherwise(out)

    return F.array_join(F.transform(F.split(canon, ""), lambda c, i: one(c, i)), "")


def _luhn(digits: Column) -> Column:
    """The sum of a number's digits in Luhn's weights."""
    d = F.reverse(F.split(digits, ""))
    return F.aggregate(F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10)), F.lit(0), lambda a, x: a + x)


def _mod97(iban: Column) -> Column:
    """The remainder that a valid IBAN leaves as 1: letters are two digits, the first four characters go last."""
    chars = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), "")
    step = lambda a, c: F.when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(chars, F.lit(0), step)


def _with_drawn(df: DataFrame, key: str) -> DataFrame:
    """df (kind, canon, gender, attempt) with new, the canonical form of the surrogate; the hashes are made once a row."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    host = F.substring(canon, F.instr(canon, "@") + 1, F.length(canon))
    top = F.regexp_extract(host, r"(\.[^.]+)\z", 1)
    name = F.substring(host, F.lit(1), F.length(host) - F.length(top))
    hashed = df.select("*", _hashed(key, kind, canon, attempt.cast("string")).alias("_s"), F.when(kind == "email", _hashed(key, F.lit("host"), name)).alias("_hs"))
    s = F.col("_s")
    number = _reshaped(canon, s, F.when(kind == "phone", F.greatest(F.length(canon) - 10, F.lit(0))).when(kind == "iban", F.lit(2)).otherwise(F.lit(0)))
    # the reshaped form is a column of its own, as it is read several times
    shaped = hashed.select("*", F.when(kind.isin("phone", "ssn", "card", "iban", "surname", "given"), number).alias("_r"))
    r = F.col("_r")
    body = F.substring(r, F.lit(1), F.length(r) - 1)
    card = F.when(_luhn(canon) % 10 == 0, F.concat(body, F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))).otherwise(r)
    bare = F.concat(F.substring(r, 1, 2), F.lit("00"), F.substring(r, F.lit(5), F.length(r)))
    iban = F.when(_mod97(canon) == 1, F.concat(F.substring(r, 1, 2), F.lpad((F.lit(98) - _mod97(bare)).cast("string"), 2, "0"), F.substring(r, F.lit(5), F.length(r)))).otherwise(r)
    ip = F.concat_ws(".", *[(_byte(s, i) % 254 + 1).cast("string") for i in range(4)])
    # an address keeps its top-level domain; its host is drawn for the host alone, so hosts stay together;
    # a drawn address of few letters is lengthened by further attempts, so short ones don't run out
    more = F.when(attempt > 3, F.concat(F.lit("."), F.lower(F.conv(attempt.cast("string"), 10, 36)))).otherwise("")
    local = F.substring(canon, F.lit(1), F.instr(canon, "@") - 1)
    email = F.concat(_reshaped(local, s, F.lit(0)), more, F.lit("@"), _reshaped(name, F.col("_hs"), F.lit(0)), top)
    pick = lambda at: F.when(F.col("gender") == "f", F.get(F.split(F.lit(_FIRST["f"]), " "), _byte(s, at) % len(_FIRST["f"].split()))).otherwise(F.get(F.split(F.lit(_FIRST["m"]), " "), _byte(s, at) % len(_FIRST["m"].split())))
    # given names in Latin letters come from the list, two of them when one is taken, then with letters added
    suffix = F.when(attempt > 9, F.translate(attempt.cast("string"), "0123456789", "abcdefghij")).otherwise("")
    given = F.when(canon.rlike(r"\A[\p{IsLatin}'’-]+\z"), F.lower(F.concat(pick(63), F.when(attempt > 3, F.concat(F.lit("-"), pick(62))).otherwise(""), suffix))).otherwise(F.concat(r, suffix))
    new = F.when(kind == "ip", ip).when(kind == "email", email).when(kind == "card", card).when(kind == "iban", iban).when(kind == "given", given)
    new = new.when(kind == "surname", F.concat(r, F.when(attempt > 3, F.translate(attempt.cast("string"), "0123456789", "abcdefghij")).otherwise(""))).otherwise(r)
    return shaped.select(*df.columns, new.alias("new"))


def _formatted(e: Column, kind: Column, new: Column) -> Column:
    """The surrogate in the format of the mention: separators and letter case."""
    spread = F.aggregate(
        F.split(e, ""),
        F.struct(F.lit(1).alias("i"), F.lit("").alias("o")),
        lambda a, c: F.when(c.rlike(r"[\p{L}\d]"), F.struct((a["i"] + 1).alias("i"), F.concat(a["o"], F.substring(new, a["i"], F.lit(1))).alias("o"))).otherwise(F.struct(a["i"].alias("i"), F.concat(a["o"], c).alias("o"))),
        lambda a: a["o"],
    )
    mail = F.when((F.upper(e) == e) & e.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spread).when(kind == "email", mail).otherwise(new)


def _cased(word: Column, new: Column) -> Column:
    """A drawn word in the letter case of the word that it stands for."""
    proper = F.array_join(F.transform(F.split(new, "-"), F.initcap), "-")
    return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(new)).otherwise(proper)


def entities(docs: DataFrame) -> DataFrame:
    """_id, _th, mention: the distinct mentions of each text."""
    return docs.where(F.col("text").rlike(_HINT)).select(*common.row_key("doc_id", "text"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))).alias("mention"))


def _words(names: DataFrame) -> DataFrame:
    """(mention, at, token, kind, canon, hint) of names: kind given or surname, null for initials and particles."""
    bare = F.regexp_replace("mention", rf"\A{_TITLE}\.?\x20", "")
    female, male = F.col("mention").rlike(rf"\A(?:{_FEMALE})\b"), F.col("mention").rlike(rf"\A(?:{_MALE})\b")
    listed = {g: F.array(*[F.lit(x.lower()) for x in names.split()]) for g, names in _FIRST.items()}
    split = names.select("mention", F.split(bare, " ").alias("_ts"), F.when(female, "f").when(male, "m").alias("_g"))
    is_word = lambda t: t.rlike(rf"\A{_WORD}\z")
    split = split.select("mention", "_g", F.size(F.filter("_ts", is_word)).alias("_n"), F.array_max(F.transform("_ts", lambda t, i: F.when(is_word(t), i))).alias("_last"), F.posexplode("_ts").alias("at", "token"))
    low, token = F.lower("token"), F.col("token")
    f, m = F.array_contains(listed["f"], low), F.array_contains(listed["m"], low)
    kind = F.when(~is_word(token), None).when((F.col("at") < F.col("_last")) | (F.col("_n") == 1) & (f | m), "given").otherwise("surname")
    return split.select("mention", "at", "token", kind.alias("kind"), low.alias("canon"), F.when(f, "f").when(m, "m").alias("listed"), F.col("_g").alias("hint"))


def _held(real: DataFrame, key: str, max_rounds: int) -> DataFrame:
    """(kind, canon, new): distinct entities have distinct surrogates that are no real entities."""
    n = real.count()
    real = common.cut(real.repartition(max(1, min(4096, -(-n // _ROWS_EACH) * 4)), "kind", "canon")) if n > _ROWS_EACH else real
    held = common.cut(_with_drawn(real.withColumn("attempt", F.lit(0)), key))
    for _ in range(max_rounds):
        lead = held.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "canon")).alias("first"))
        taken = lead.join(real.select("kind", F.col("canon").alias("new"), F.lit(True).alias("is_real")), ["kind", "new"], "left").where("n > 1 or is_real")
        clash = common.cut(held.join(taken.select("kind", "new", "first", "is_real"), ["kind", "new"]).where(F.coalesce("is_real", F.lit(False)) | (F.struct("attempt", "canon") != F.col("first"))).select("kind", "canon", "gender", (F.col("attempt") + 1).alias("attempt")))
        if clash.isEmpty():
            return held.select("kind", "canon", "new")
        held = common.cut(held.join(clash.select("kind", "canon"), ["kind", "canon"], "left_anti").unionByName(_with_drawn(clash, key)))
    raise RuntimeError(f"surrogates still collide after {max_rounds} rounds")


def surrogate_tables(mentions: DataFrame, key: str, max_rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """(mention, surrogate) for each distinct mention, and (mention, word, surrogate) for the words of names, in lower case."""
    known = common.cut(mentions.select("mention").distinct().withColumn("kind", _kind(F.col("mention"))))
    plain = known.where("kind <> 'name'").withColumn("canon", _canonical(F.col("mention"), F.col("kind")))
    words = common.cut(_words(known.where("kind = 'name'").select("mention")))
    gender = F.when(F.col("kind") == "given", F.coalesce(F.max("listed"), F.min("hint"), F.lit("m"))).alias("gender")
    real = plain.select("kind", "canon").distinct().withColumn("gender", F.lit(None).cast("string")).union(words.where("kind is not null").groupBy("kind", "canon").agg(gender))
    held = _held(common.cut(real), key, max_rounds)
    numbers = plain.join(held, ["kind", "canon"]).select("mention", _formatted(F.col("mention"), F.col("kind"), F.col("new")).alias("surrogate"))
    drawn = words.join(held, ["kind", "canon"], "left").withColumn("_s", F.when(F.col("canon").rlike(r"\p{L}\."), _hashed(key, F.lit("initial"), F.col("canon"))))
    token = F.when(F.col("new").isNotNull(), _cased(F.col("token"), F.col("new"))).when(F.col("_s").isNotNull(), _reshaped(F.col("token"), F.col("_s"), F.lit(0))).otherwise(F.col("token"))
    ordered = drawn.select("mention", "at", token.alias("t")).groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("ts"))
    names = ordered.select("mention", F.concat(_title(F.col("mention")), F.array_join(F.transform("ts", lambda x: x["t"]), " ")).alias("surrogate"))
    return numbers.union(names), drawn.where("new is not null").select("mention", F.col("canon").alias("word"), F.col("new").alias("surrogate"))


def surrogate_table(mentions: DataFrame, key: str, max_rounds: int = 50) -> DataFrame:
    return surrogate_tables(mentions, key, max_rounds)[0]


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with the entities of text replaced, and n_entities (mentions replaced) added."""
    whole = docs.select("text", *common.row_key("doc_id", "text"), common.boxed(docs, "text", "n_entities"))
    found = common.cut(entities(docs.select("doc_id", "text")))
    table, words = (common.cut(x) for x in surrogate_tables(found, key))
    pairs = found.join(table, "mention").select("_id", "_th", F.struct("mention", "surrogate").alias("e"), F.lit(None).cast("struct<mention:string,surrogate:string>").alias("w"))
    named = found.join(words, "mention").groupBy("_id", "_th", "word").agg(F.max("surrogate").alias("surrogate"))
    pairs = pairs.union(named.select("_id", "_th", F.lit(None), F.struct(F.col("word").alias("mention"), "surrogate")))
    maps = pairs.groupBy("_id", "_th").agg(F.map_from_entries(F.collect_set("e")).alias("_map"), F.map_from_entries(F.collect_set("w")).alias("_names"))
    hinted = F.coalesce(F.col("text").rlike(_HINT), F.lit(False))
    told = whole.where(hinted).join(maps, ["_id", "_th"], "left")

    def parts(pattern: str) -> Column:
        """Gaps and mentions by turns, from one search of the text."""
        t = F.col("text")
        gaps, at = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        slow = F.flatten(F.zip_with(gaps, at, lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m))))
        return F.when(F.instr(t, _FENCE) > 0, slow).otherwise(F.split(F.regexp_replace(t, rf"(?:{pattern})", f"{_FENCE}$0{_FENCE}"), _FENCE, -1))

    some = F.col("_map").isNotNull()
    told = told.withColumn("_parts", F.when(some & (F.size("_names") > 0), parts(_WIDER)).when(some, parts(PATTERN)))

    def swapped(x: Column, i: Column) -> Column:
        name = F.element_at("_names", F.lower(x))
        return F.when(i % 2 == 0, None).otherwise(F.coalesce(F.element_at("_map", x), F.when(name.isNotNull(), _cased(x, name))))

    told = told.withColumn("_new", F.transform("_parts", swapped))
    text = F.when(some, F.array_join(F.zip_with("_parts", "_new", lambda p, n: F.coalesce(n, p)), "")).otherwise(F.col("text"))
    count = F.coalesce(F.size(F.filter("_new", lambda x: x.isNotNull())), F.lit(0)).cast("long").alias("n_entities")
    new = told.select(*common.unboxed(docs, "n_entities", text=text), count)
    rest = whole.where(~hinted).select(*common.unboxed(docs, "n_entities", text=F.col("text")), F.lit(0).cast("long").alias("n_entities"))
    return new.unionByName(rest)
