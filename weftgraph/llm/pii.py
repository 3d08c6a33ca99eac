"""PII surrogates: every detected entity gets a keyed, type-consistent replacement. DataFrame functions only.

Entities: e-mail addresses, IPv4 addresses, card numbers, phone numbers, national numbers (3-2-4 digits), and names
behind an honorific. Mentions of one entity share a canonical form (letters lowered, or digits alone), so they get one
surrogate however they are written, and each mention is rendered in its own format: separators, digit grouping, country
code, honorific. Card numbers keep their length and whether their check digit holds. Names keep gender (from the
honorific) and script (Latin or Cyrillic); given and family names are entities of their own, so "Ms X Y" and "Ms Y" agree.

Surrogates are functions of (key, type, canonical form, attempt). A collision check over the distinct entities, never
over the texts, finds surrogates that two entities share or that are real entities of the input; those entities alone
try again. So different entities stay different and none of the output's entities is one of the input's. A phone
number's country code is the longest that one of its mentions sets off. Phone and national numbers that tries don't
settle are dealt the unused values of their format; only where it has fewer of those than entities do the others get
another real entity's value.

Only rows with an entity are taken apart. A hot entity is one row of the surrogate table; mentions are pre-aggregated
before the distinct entities are shuffled, and AQE can split the mentions in the join back.

Edge cases: a null text stays null with no entities; repeated rows each get their row; an empty table gives an empty
result; very long texts are taken apart whole; the marks U+0001 and U+0002 within a text become U+FFFD if the row has an entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

# Patterns in order of precedence at one position.
_HONORIFIC = r"(?:Mrs|Mr|Ms|Miss|Dr|Herr|Frau|Señora|Señor|Monsieur|Madame|Mme|Г-жа|Г-н)\.?"
_NAME = r"\p{Lu}[\p{Ll}'’-]+"
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "name": rf"(?<![\p{{L}}]){_HONORIFIC} {_NAME}(?: {_NAME})?",
}
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Señora|Madame|Mme|Г-жа)"
MALE = r"^(?:Mr|Herr|Señor|Monsieur|Г-н)"
# Syllables that surrogate names are made of, by script, and endings by gender.
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe fi fo ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to", "cyrillic": "ба бе би бо да де ди до ва ве ви во ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то"}
ENDINGS = {("latin", "given", "f"): "na", ("latin", "given", "m"): "ton", ("latin", "given", "x"): "ley", ("cyrillic", "given", "f"): "на", ("cyrillic", "given", "m"): "слав", ("cyrillic", "given", "x"): "ль", ("latin", "family", "f"): "well", ("latin", "family", "m"): "well", ("latin", "family", "x"): "well", ("cyrillic", "family", "f"): "ова", ("cyrillic", "family", "m"): "ов", ("cyrillic", "family", "x"): "ко"}

MAX_TRIES = 40
#: Tries after which phone and national numbers are dealt the unused values of their formats.
DIGIT_TRIES = 6
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_SEGMENT = "array<struct<type:string,raw:string,gender:string>>"


def _type_of(raw: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        anchored = PATTERNS[kind] if kind != "phone" else PATTERNS[kind]
        out = F.when(F.rlike(raw, F.lit(rf"^(?:{anchored})$")), kind).otherwise(out)
    return out


def _segment(kind: Column, raw: Column, gender: Column) -> Column:
    return F.struct(kind.alias("type"), raw.alias("raw"), gender.alias("gender"))


def _segments(piece: Column) -> Column:
    """A piece is an entity up to the closing mark, then plain text."""
    none = F.lit(None).cast("string")
    raw, rest = F.substring_index(piece, "\x02", 1), F.substring_index(piece, "\x02", -1)
    kind = _type_of(raw)
    gender = F.when(F.rlike(raw, F.lit(FEMALE)), "f").when(F.rlike(raw, F.lit(MALE)), "m").otherwise("x")
    words = F.split(raw, " ")
    family = F.element_at(words, -1)
    given = F.when(F.size(words) > 2, F.element_at(words, 2))
    named = F.concat(
        F.array(_segment(none, F.concat(F.element_at(words, 1), F.lit(" ")), none)),
        F.when(given.isNotNull(), F.array(_segment(F.lit("given"), given, gender), _segment(none, F.lit(" "), none))).otherwise(F.array().cast(_SEGMENT)),
        F.array(_segment(F.lit("family"), family, gender)),
    )
    return F.concat(F.when(kind == "name", named).otherwise(F.array(_segment(kind, raw, none))), F.array(_segment(none, rest, none)))


def canonical(kind: Column, raw: Column) -> Column:
    return F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(raw, "[^0-9]", "")).otherwise(F.lower(raw))


def _hex(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def _digits(key: str, n: Column, *parts: Column) -> Column:
    """At least 28 keyed decimal digits, cut to n."""
    h = _hex(key, *parts)
    piece = lambda a: F.lpad(F.conv(F.substring(h, a, 14), 16, 10), 17, "0").substr(F.lit(4), F.lit(14))
    return F.substring(F.concat(piece(1), piece(15), piece(29)), F.lit(1), n)


def _digit_at(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1)).cast("int")


def luhn(digits: Column) -> Column:
    """The sum that a valid card number has divisible by ten."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), n)
    return F.aggregate(at, F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, F.when(_digit_at(digits, i) > 4, _digit_at(digits, i) * 2 - 9).otherwise(_digit_at(digits, i) * 2)).otherwise(_digit_at(digits, i)))


def _name(key: str, script: str, kind: str, gender: str, canon: Column, tries: Column) -> Column:
    h = _hex(key, F.lit(kind), canon, tries)
    pool = SYLLABLES[script].split()
    table = F.array(*[F.lit(s) for s in pool])
    syllable = lambda k: F.element_at(table, (F.pmod(F.conv(F.substring(h, 1 + 4 * k, 4), 16, 10).cast("int"), F.lit(len(pool))) + 1).cast("int"))
    count = 2 + F.least(tries, F.lit(4))
    stem = F.concat(*[F.when(F.lit(k) < count, syllable(k)).otherwise("") for k in range(6)])
    return F.concat(stem, F.lit(ENDINGS[script, kind, gender]))


def surrogate(key: str, kind: Column, canon: Column, gender: Column, tries: Column) -> Column:
    """The canonical form of the surrogate."""
    t = tries.cast("string")
    local = F.concat(F.lit("user"), F.substring(_hex(key, F.lit("email"), F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1), t), 1, 12))
    domain = F.concat(F.lit("mail-"), F.substring(_hex(key, F.lit("domain"), F.substring_index(canon, "@", -1)), 1, 10), F.lit(".example"))
    h = _hex(key, F.lit("ip"), canon, t)
    octet = lambda k: (F.pmod(F.conv(F.substring(h, 1 + 4 * k, 4), 16, 10).cast("int"), F.lit(254)) + 1).cast("string")
    n = F.length(canon)
    plain = _digits(key, n, kind, canon, t)
    body = F.concat(F.lit("4"), _digits(key, n - 2, kind, canon, t))
    check = F.pmod(10 - F.pmod(luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    last = F.when(luhn(canon) % 10 == 0, check).otherwise(F.pmod(check + 1 + F.pmod(F.conv(F.substring(_hex(key, canon, t), 1, 4), 16, 10).cast("int"), F.lit(9)), F.lit(10)))
    script = lambda s: F.rlike(canon, F.lit(r"\p{IsCyrillic}")) if s == "cyrillic" else ~F.rlike(canon, F.lit(r"\p{IsCyrillic}"))
    name = F.lit(None).cast("string")
    for (s, k, g) in ENDINGS:
        name = F.when((kind == k) & (gender == g) & script(s), _name(key, s, k, g, canon, tries)).otherwise(name)
    return F.when(kind == "email", F.concat(local, F.lit("@"), domain)).when(kind == "ip", F.concat_ws(".", *[octet(k) for k in range(4)])).when(kind == "card", F.concat(body, last.cast("string"))).when(kind.isin("phone", "ssn"), plain).otherwise(name)


def _code(kind: Column, raw: Column) -> Column:
    """How many leading digits of a mention are a country code, which stays."""
    return F.when((kind == "phone") & F.startswith(raw, F.lit("+")), F.length(F.regexp_extract(raw, r"^\+([0-9]{1,3})(?![0-9])", 1))).otherwise(0)


def rendered(kind: Column, raw: Column, sub: Column) -> Column:
    """The surrogate in the mention's own format."""
    chars = F.split(raw, "")
    step = lambda a, c: F.struct((a["i"] + F.rlike(c, F.lit("^[0-9]$")).cast("int")).alias("i"), F.concat(a["s"], F.when(F.rlike(c, F.lit("^[0-9]$")), F.substring(sub, a["i"] + 1, F.lit(1))).otherwise(c)).alias("s"))
    digits = F.aggregate(chars, F.struct(F.lit(0).alias("i"), F.lit("").alias("s")), step, lambda a: a["s"])
    cased = F.when(raw == F.upper(raw), F.upper(sub)).otherwise(F.initcap(sub))
    return F.when(kind.isin("card", "phone", "ssn"), digits).when(kind.isin("given", "family"), cased).otherwise(sub)


_FORMAT = ["type", "code", "n"]


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` numbered from 0 by column ``o`` within their format, over all tasks."""
    s = materialise(rows.repartitionByRange(*_FORMAT, "o").sortWithinPartitions(*_FORMAT, "o").withColumn("__i", F.monotonically_increasing_id()), "pii-ranked")
    s = s.withColumn("__p", F.shiftright("__i", 33))
    sizes = s.groupBy(*_FORMAT, "__p").agg(F.count("*").alias("__c"), F.min("__i").alias("__lo"))
    before = F.sum("__c").over(Window.partitionBy(*_FORMAT).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*_FORMAT, "__p", "__lo", F.coalesce(before, F.lit(0)).alias("__b"))
    return s.join(sizes, [*_FORMAT, "__p"]).withColumn("rank", F.col("__i") - F.col("__lo") + F.col("__b")).drop("o", "__i", "__p", "__lo", "__b")


def _dealt(left: DataFrame, entities: DataFrame, done: DataFrame, key: str, code: int) -> DataFrame:
    """``type, canon, sub`` of the digit entities that tries left: the unused values of their formats, dealt in keyed order.

    A format is a length and a country code of ``code`` digits. Its values are listed, which is in proportion to the
    entities, as tries only fail where most values are used. Entities beyond the unused values get real ones, never
    their own: as many values as entities there always are.
    """
    order = lambda c: _hex(key, F.lit("deal"), F.col(c))
    left = left.select("type", "canon", F.substring("canon", 1, code).alias("code"), F.length("canon").alias("n"))
    # values in parts of at most 10 000, so that no array is long
    many, few = F.greatest(F.col("n") - code - 4, F.lit(0)), F.least(F.col("n") - code, F.lit(4))
    upto = lambda w: F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(10), w).cast("long") - 1))
    values = left.select(*_FORMAT).distinct().withColumn("hi", upto(many)).withColumn("lo", upto(few))
    number = F.lpad((F.col("hi") * F.pow(F.lit(10), few).cast("long") + F.col("lo")).cast("string"), F.col("n") - code, F.lit("0"))
    values = values.select(*_FORMAT, F.concat("code", number).alias("sub"))
    values = materialise(values.join(done.select("type", "sub"), ["type", "sub"], "left_anti"), "pii-values")
    unused = values.join(entities.select("type", F.col("canon").alias("sub")), ["type", "sub"], "left_anti")
    first = _ranked(left.withColumn("o", order("canon"))).join(_ranked(unused.withColumn("o", order("sub"))), [*_FORMAT, "rank"])
    first = materialise(first.select("type", "canon", "sub"), "pii-dealt")
    rest = materialise(left.join(first, ["type", "canon"], "left_anti"), "pii-rest")
    if rest.isEmpty():
        return first
    # own values come first on both sides and in one order, so that the next value is never an entity's own
    values = values.join(first.select("type", "sub"), ["type", "sub"], "left_anti")
    own = rest.select("type", F.col("canon").alias("sub"), F.lit(True).alias("own"))
    values = values.join(own, ["type", "sub"], "left").withColumn("o", F.struct(F.col("own").isNull().alias("x"), order("sub").alias("y"))).drop("own")
    values = materialise(values, "pii-open")
    sizes = values.groupBy(*_FORMAT).agg(F.count("*").alias("size"))
    there = values.select("type", F.col("sub").alias("canon"), F.lit(True).alias("there"))
    rest = rest.join(there, ["type", "canon"], "left").withColumn("o", F.struct(F.col("there").isNull().alias("x"), order("canon").alias("y"))).drop("there")
    rest = _ranked(rest).join(sizes, _FORMAT).withColumn("rank", F.pmod(F.col("rank") + 1, F.col("size")))
    return first.unionByName(rest.join(_ranked(values), [*_FORMAT, "rank"]).select("type", "canon", "sub"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``type, canon, sub`` for distinct ``type, canon, gender``: tries again until no two share a surrogate.

    ``keep``, where there is such a column, is the length of a phone's country code, which the surrogate begins with.
    """
    if "keep" not in entities.columns:
        entities = entities.withColumn("keep", F.lit(0))
    done = None
    # long codes first: they have the fewest values, which formats with a shorter code or none could use as well
    for code in sorted((r["keep"] for r in entities.select("keep").distinct().collect()), reverse=True) or [0]:
        todo = entities.where(F.col("keep") == code).withColumn("tries", F.lit(0))
        for attempt in range(1, MAX_TRIES + 1):
            new = surrogate(key, F.col("type"), F.col("canon"), F.col("gender"), F.col("tries"))
            cand = materialise(todo.withColumn("sub", F.concat(F.substring("canon", 1, code), F.substring(new, code + 1, 1 << 30)) if code else new), "pii-try")
            # the first by its canonical form keeps a shared surrogate; taken ones and real entities are out
            first = cand.groupBy("type", "sub").agg(F.min("canon").alias("__first"))
            real = entities.select("type", F.col("canon").alias("sub"))
            if done is not None:
                real = real.unionByName(done.select("type", "sub"))
            judged = cand.join(first, ["type", "sub"]).join(real.distinct().withColumn("__bad", F.lit(True)), ["type", "sub"], "left")
            judged = materialise(judged.withColumn("ok", (F.col("canon") == F.col("__first")) & F.col("__bad").isNull()).select("type", "canon", "gender", "tries", "sub", "ok"), "pii-judged")
            good = judged.where("ok").select("type", "canon", "sub")
            done = good if done is None else done.unionByName(good)
            todo = judged.where("not ok").select("type", "canon", "gender", (F.col("tries") + 1).alias("tries"))
            if attempt == DIGIT_TRIES:
                left = todo.where(F.col("type").isin("phone", "ssn"))
                if not left.isEmpty():
                    done = done.unionByName(materialise(_dealt(left, entities, done, key, code), "pii-exact"))
                    todo = todo.where(~F.col("type").isin("phone", "ssn"))
            if todo.isEmpty():
                break
        else:
            raise RuntimeError("surrogates still collide: a type's format has too few values for its entities")
    return done


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced, and ``__pii_n`` (entities replaced) and ``__pii_types`` (their types, sorted)."""
    text = F.col(text_col)
    # cheap: any entity has an @, two digits or an honorific's capital
    has = F.coalesce(F.rlike(text, F.lit(rf"@|[0-9][0-9. )-]*[0-9]|{_HONORIFIC} ")) & F.rlike(text, F.lit(_ANY)), F.lit(False))
    marked = F.regexp_replace(F.translate(text, "\x01\x02", "��"), f"({_ANY})", "\x01$1\x02")
    pieces = F.split(marked, "\x01", -1)
    first = F.array(_segment(F.lit(None).cast("string"), F.element_at(pieces, 1), F.lit(None).cast("string")))
    whole = F.concat(first, F.flatten(F.transform(F.slice(pieces, 2, F.size(pieces)), _segments)))
    # written once, with segments or the text, so that the expressions above run once a row; a struct, so that no name clashes
    split = docs.select("*", F.when(has, whole).alias("__pii_seg"))
    kept = [F.when(F.col("__pii_seg").isNull(), text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    split = split.select(F.struct(*kept).alias("__row"), F.col("__pii_seg").alias("__seg"), F.monotonically_increasing_id().alias("__rid"))
    split = materialise(split, "pii-rows")
    found = split.where("__seg is not null")
    mentions = found.select("__rid", F.posexplode("__seg").alias("__pos", "__s")).where("__s.type is not null")
    mentions = mentions.select("__rid", "__pos", F.col("__s.type").alias("type"), F.col("__s.raw").alias("raw"), F.coalesce("__s.gender", F.lit("x")).alias("gender")).withColumn("canon", canonical(F.col("type"), F.col("raw")))
    mentions = materialise(mentions, "pii-mentions")
    # a name met with and without a clear honorific takes the clear one, a phone its longest country code
    entities = materialise(mentions.groupBy("type", "canon").agg(F.min(F.when(F.col("gender") != "x", F.col("gender"))).alias("g"), F.max(_code(F.col("type"), F.col("raw"))).alias("keep")).select("type", "canon", F.coalesce("g", F.lit("x")).alias("gender"), "keep"), "pii-entities")
    subs = materialise(surrogates(entities, key), "pii-subs")
    new = mentions.join(subs, ["type", "canon"]).select("__rid", "__pos", "type", rendered(F.col("type"), F.col("raw"), F.col("sub")).alias("new"))
    by_row = new.groupBy("__rid").agg(F.collect_list(F.struct(F.col("__pos").alias("i"), F.col("new").alias("s"))).alias("__new"), F.count("*").cast("long").alias("__pii_n"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("__pii_types"))
    plain = F.filter(F.transform("__seg", lambda s, i: F.when(s["type"].isNull(), F.struct(i.alias("i"), s["raw"].alias("s")))), lambda x: x.isNotNull())
    joined = F.array_join(F.transform(F.sort_array(F.concat(plain, "__new")), lambda x: x["s"]), "")
    row = lambda new: [(new if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns]
    changed = found.join(by_row, "__rid").select(*row(joined), "__pii_n", "__pii_types")
    rest = split.where("__seg is null").select(*row(F.col("__row").getField(text_col)), F.lit(0).cast("long").alias("__pii_n"), F.lit("").alias("__pii_types"))
    return changed.unionByName(rest)
