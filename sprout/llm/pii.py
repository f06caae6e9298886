"""PII surrogate generation with DataFrame functions only.

Entities (e-mail addresses, phone numbers, card and id numbers, social security
numbers, IPv4 addresses, names) are found by one regular expression, normalised
(coreferent mentions get one form) and replaced by keyed surrogates of the same type:
digits stay digits in the mention's own format, letters keep case, addresses stay valid
addresses, card numbers that pass the Luhn check still do, names keep gender and script.

Names are detected after an honorific (one or two words; capitals, or a script without
case). Every mention of a detected word in the same text is then a name as well, bare or
in full, in any case. A name's word has one surrogate whatever stands before it; its
gender is what the honorifics before it as a given name agree on, else neutral.

A surrogate is a function of the secret key, the type, the normalised entity and an
attempt number. Collision checks run over all entities of the corpus: of several that
drew one surrogate the smallest keeps it, a surrogate that is itself an entity of the
corpus is refused, and the others draw again. After ``NARROW`` refused draws a form
widens with every further one (more letters in a name or before an address's local part,
more digits, a port behind an IP address), so short forms can't run out and draws end.

A text is searched once; its gaps and mentions are stored, and only texts with a hint of
an entity are shuffled, the others pass by. Null and empty texts are unchanged, texts of
any length are searched whole. Rows that repeat a document get the same result each.
Other columns pass through unchanged (``n_chars`` follows the text where the table has
it), whatever their names; an own ``n_entities`` column gives way to the report's. An
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, store

KEY = "sprout-demonstration-key"
#: Honorifics before a name, by gender (n: not told).
HONORIFICS = {"m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Sir", "господин", "κύριος"),
              "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "κυρία"),
              "n": ("Dr", "Prof")}


def spelled(titles: tuple[str, ...]) -> str:
    """Honorifics as listed and in capitals."""
    return "|".join(dict.fromkeys(x for t in titles for x in (t, t.upper())))


ANY_TITLE = spelled(tuple(t for g in HONORIFICS.values() for t in g))
TITLE = rf"(?<!\p{{L}})(?:{ANY_TITLE})\.?"
#: Parts after an apostrophe or a hyphen have two letters at least, so a possessive s is no part.
NAME = r"(?:\p{Lu}(?:\p{L}+|['’]\p{L}{2,})(?:['’-]\p{L}{2,})*+|\p{Lo}{1,4})"
#: What must not be around a bare mention; scripts without case have no spaces to go by.
BEFORE, BEHIND = r"(?<![\p{Lu}\p{Ll}\p{N}_])", r"(?![\p{Lu}\p{Ll}\p{N}_])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|(?<![0-9])[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|\+[0-9]{8,15}(?![0-9])"
NUMBER = r"(?<![0-9A-Za-z.,_-])[0-9](?:[ -]?[0-9]){8,18}(?![0-9A-Za-z_])"
CARD = r"(?<![0-9A-Za-z.,_-])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9]|[A-Za-z_])"
ENTITY = "|".join([EMAIL, IBAN, IPV4, SSN, CARD, PHONE, NUMBER])
TITLED = rf"{TITLE} (?:\p{{Lu}}|\p{{Lo}})"
TITLED_NAME = rf"{TITLE} ({NAME})(?: ({NAME}))?"
#: Syllables of surrogate names by script, and endings by gender.
SYLLABLES = {
    "latin": "ba,de,fi,go,lu,ma,ne,ri,so,ta,ve,jo,ka,li,mo,na,pe,ra,si,to".split(","),
    "cyrillic": "ба,де,фи,го,лу,ма,не,ри,со,та,ве,до,ка,ли,мо,на,пе,ра,си,то".split(","),
    "greek": "βα,δε,φι,γο,λυ,μα,νε,ρι,σο,τα,βε,δο,κα,λι,μο,να,πε,ρα,σι,το".split(","),
    "han": "安,白,成,达,方,广,和,江,康,林,明,宁,平,清,山,天,文,星,永,志".split(","),
    "hangul": "가,나,다,라,마,바,사,아,자,하".split(","),
    "kana": "か,き,さ,た,な,は,ま,や,ら,わ".split(","),
    "arabic": "با,دا,سا,كا,لا,ما,نا,را,فا,ها".split(","),
    "hebrew": "בא,דא,גא,לא,מא,נא,רא,סא,טא,שא".split(","),
    "devanagari": "क,ग,ज,त,द,न,प,म,र,ल".split(","),
}
ENDINGS = {"latin": {"m": "n", "f": "lia", "n": "s"}, "cyrillic": {"m": "н", "f": "лия", "n": "с"},
           "greek": {"m": "ς", "f": "λια", "n": "ς"}}
SCRIPTS = {"cyrillic": "IsCyrillic", "greek": "IsGreek", "han": "IsHan", "hangul": "IsHangul", "kana": "IsHiragana}\\p{IsKatakana",
           "arabic": "IsArabic", "hebrew": "IsHebrew", "devanagari": "IsDevanagari"}
NARROW = 4
#: Marks around mentions in a searched text, and how a text's own such characters are written meanwhile.
MARK, ESCAPE = "\x01", "\x02"


def hinted(text: Column) -> Column:
    """Whether a text can hold an entity at all: a digit, an at sign, or an honorific before a name."""
    return F.coalesce(text.rlike("[0-9@]") | titled(text), F.lit(False))


def titled(text: Column) -> Column:
    """An honorific before a name; the plain searches come first, the pattern runs only where one hits."""
    titles = sorted({x for g in HONORIFICS.values() for t in g for x in (t, t.upper())})
    stems = [t for t in titles if not any(t != u and u in t for u in titles)]
    return F.coalesce(reduce(lambda a, b: a | b, (text.contains(t) for t in stems)) & text.rlike(TITLED), F.lit(False))


def names_in(text: Column) -> Column:
    """The words of a text's titled names, lower-case, the longest first."""
    words = F.concat(*[F.regexp_extract_all(text, F.lit(TITLED_NAME), F.lit(k)) for k in (1, 2)])
    own = F.array_distinct(F.filter(F.transform(words, F.lower), lambda w: w != ""))
    return F.transform(F.array_sort(F.transform(own, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])


def search(names: Column) -> Column:
    """The pattern of a text's entities: numbers and addresses, and its own names in any case."""
    bare = F.concat(F.lit(f"(?iu:{BEFORE}(?:"), F.array_join(names, "|"), F.lit(f"){BEHIND})"))
    return F.when(F.size(names) > 0, F.concat(F.lit(ENTITY + "|"), bare)).otherwise(F.lit(ENTITY))


def escaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(MARK), F.lit(ESCAPE + "a"))
    return F.when(text.contains(MARK) | text.contains(ESCAPE), out).otherwise(text)


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit(ESCAPE + "a"), F.lit(MARK)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))
    return F.when(text.contains(ESCAPE), out).otherwise(text)


def script_of(word: Column) -> Column:
    out = F.lit("latin")
    for script, block in SCRIPTS.items():
        out = F.when(word.rlike(rf"[\p{{{block}}}]"), script).otherwise(out)
    return out


def kind_of(raw: Column) -> Column:
    """Type of a mention."""
    return (F.when(raw.contains("@"), "email").when(raw.rlike(f"^{IPV4}$"), "ip").when(raw.rlike(f"^{SSN}$"), "ssn")
            .when(raw.rlike("^[A-Z]{2}[0-9]{2}"), "iban").when(raw.rlike(r"^\p{L}"), "name")
            .when(raw.rlike(r"^[0-9](?:[ -]?[0-9]){12,18}$"), "card")
            .when(raw.startswith("+"), "phone").otherwise("number"))


def gender_of(kind: Column, before: Column, after: Column, following: Column) -> Column:
    """What an honorific says of a given name: one that another name's word follows."""
    ends = lambda g: before.rlike(rf"(?<!\p{{L}})(?:{spelled(HONORIFICS[g])})\.? $")
    given = (kind == "name") & (after == " ") & following.rlike(r"^\p{L}")
    return F.when(given & ends("m"), "m").when(given & ends("f"), "f")


def normal(kind: Column, raw: Column) -> Column:
    """One form of all mentions of an entity."""
    return (F.when(kind.isin("email", "name"), F.lower(raw)).when(kind == "ip", raw)
            .when(kind == "iban", F.replace(raw, F.lit(" "))).otherwise(F.regexp_replace(raw, "[^0-9]", "")))


def draw(digest: Column, i: Column, n: int) -> Column:
    """A number below ``n`` for position ``i`` (from 0) out of the hex digest."""
    return F.conv(F.substring(digest, (i * 4) % 124 + 1, F.lit(4)), 16, 10).cast("int") % n


def pick(digest: Column, i: Column, choices: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), draw(digest, i, len(choices)) + 1)


def luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Luhn sum, doubling every other digit from the right starting at ``doubled_from`` (0 or 1)."""
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == doubled_from, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i))


def surrogate(kind: Column, norm: Column, gender: Column, attempt: int, key: str) -> Column:
    """Keyed surrogate in normal form: of the same length, but for names and widened forms."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, F.lit(str(attempt))), 512)
    at = F.sequence(F.lit(0), F.length(norm) - 1)
    char = lambda i: F.substring(norm, i + 1, F.lit(1))
    digit = lambda i: draw(digest, i, 10).cast("string")
    alpha = lambda i, low: F.char(draw(digest, i, 26) + ord(low))

    def email(i: Column) -> Column:
        c, fixed = char(i), i >= F.length(norm) - F.length(F.substring_index(norm, ".", -1))
        return F.when(fixed, c).when(c.rlike("[0-9]"), digit(i)).when(c.rlike("[a-z]"), alpha(i, "a")).otherwise(c)

    def account(i: Column) -> Column:
        c = char(i)
        return F.when(i < 2, c).when(c.rlike("[0-9]"), digit(i)).otherwise(alpha(i, "A"))

    plain = F.array_join(F.transform(at, lambda i: F.when(i == 0, (draw(digest, i, 9) + 1).cast("string")).otherwise(digit(i))), "")
    body = F.substring(F.concat(F.substring(norm, 1, 1), F.substring(plain, 2, 1 << 20)), F.lit(1), F.length(norm) - 1)
    check = ((10 - luhn_sum(body, 0) % 10) % 10).cast("string")
    last = F.when(luhn_sum(norm, 1) % 10 == 0, check).otherwise(F.substring(plain, -1, 1))
    ssn = F.concat((draw(digest, F.lit(0), 6) + 1).cast("string"), F.substring(plain, 2, 1 << 20))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (draw(digest, i, 254) + 1).cast("string")), ".")
    names = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        count = 4 + attempt if script in ENDINGS else 2 + attempt  # more room with each attempt
        stem = F.concat(*(pick(digest, F.lit(i), syllables) for i in range(count)))
        if script in ENDINGS:
            stem = F.concat(stem, reduce(lambda e, g: F.when(gender == g, ENDINGS[script][g]).otherwise(e), "mf", F.lit("")))
        names = F.when(script_of(norm) == script, stem).otherwise(names)
    made = (F.when(kind == "email", F.array_join(F.transform(at, email), "")).when(kind == "ip", ip).when(kind == "ssn", ssn)
            .when(kind == "iban", F.array_join(F.transform(at, account), "")).when(kind == "card", F.concat(body, last))
            .when(kind == "phone", F.concat(F.substring(norm, 1, 1), F.substring(plain, 2, 1 << 20)))
            .when(kind == "number", plain).otherwise(names))
    if attempt < NARROW:
        return made
    # another digest than the one whose positions the form uses
    spare = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("wider"), kind, norm, F.lit(str(attempt))), 512)
    more = F.sequence(F.lit(0), F.lit(attempt - NARROW))
    digits = F.array_join(F.transform(more, lambda i: draw(spare, i, 10).cast("string")), "")
    letters = F.array_join(F.transform(more, lambda i: F.char(draw(spare, i, 26) + ord("a"))), "")
    port = (draw(spare, F.lit(0), 60_000) + 1024).cast("string")
    return (F.when(kind == "email", F.concat(letters, made)).when(kind == "ip", F.concat(made, F.lit(":"), port))
            .when(kind == "name", made).otherwise(F.concat(made, digits)))


def dressed(kind: Column, raw: Column, made: Column) -> Column:
    """A surrogate in the format of one mention: its separators, its case."""
    at = F.sequence(F.lit(1), F.length(raw))
    char = lambda i: F.substring(raw, i, F.lit(1))
    # the k-th digit (or letter) of the mention takes the k-th of the surrogate
    slots = F.when(kind == "iban", "[^A-Z0-9]").otherwise("[^0-9]")
    filled = F.array_join(F.transform(at, lambda i: F.when(
        char(i).rlike("[A-Z0-9]"), F.substring(made, F.length(F.regexp_replace(F.substring(raw, F.lit(1), i), slots, F.lit(""))), F.lit(1)))
        .otherwise(char(i))), "")
    slots_used = F.length(F.regexp_replace(raw, slots, F.lit("")))
    filled = F.concat(filled, F.substring(made, slots_used + 1, F.lit(1 << 20)))  # what a widened form has more
    wider = F.length(made) - F.length(raw)
    cased = F.concat(F.substring(made, F.lit(1), wider), F.array_join(F.transform(at, lambda i: F.when(
        char(i).rlike("[A-Z]"), F.upper(F.substring(made, wider + i, F.lit(1)))).otherwise(F.substring(made, wider + i, F.lit(1)))), ""))
    shout = (F.length(raw) > 1) & (raw == F.upper(raw)) & (raw != F.lower(raw))
    name = F.when(shout, F.upper(made)).when(raw == F.lower(raw), made).otherwise(F.initcap(made))
    return F.when(kind == "email", cased).when(kind == "ip", made).when(kind == "name", name).otherwise(filled)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, made): distinct surrogates for distinct entities, drawn until no two collide."""
    spark = entities.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # rows are few but dear: dealt by number, not by bytes
    family = F.when(F.col("kind").isin("email", "ip", "iban", "name"), F.col("kind")).otherwise("digits")
    told = F.collect_set("gender")  # of two letters at most
    everyone, _ = store(entities.groupBy("kind", "norm").agg(told.alias("told")).select(
        "kind", "norm", F.when(F.size("told") == 1, F.element_at("told", 1)).otherwise("n").alias("gender"), family.alias("family")), "pii-entities")
    real = everyone.select(F.col("family"), F.col("norm").alias("made")).distinct()
    pending, done, attempt, gone = everyone, None, 0, []
    while True:
        dealt = pending.repartition(parts, "kind", "norm")
        drawn = dealt.withColumn("made", surrogate(F.col("kind"), F.col("norm"), F.col("gender"), attempt, key))
        taken = real if done is None else real.unionByName(done.select("family", "made"))
        winners = (drawn.join(taken, ["family", "made"], "left_anti").groupBy("family", "made")
                   .agg(F.min(F.struct("norm", "kind")).alias("w")).select("family", "made", "w.norm", "w.kind"))
        won, path = store(winners if done is None else done.unionByName(winners), "pii-surrogates")
        rest, left = store(pending.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"), "pii-pending")
        discard(spark, *gone)
        done, pending, gone, attempt = won, rest, [path, left], attempt + 1
        if rest.isEmpty():
            return done.select("kind", "norm", "made")


def pseudonymise(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text",
                 report: bool = True) -> DataFrame:
    """All columns of ``docs`` with entities replaced; ``report`` adds n_entities."""
    # the table's own columns travel as one, so no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"),
                       F.struct(F.xxhash64(id_col, text_col).alias("a"), F.xxhash64(F.lit(1), text_col, id_col).alias("b")).alias("hash"), hinted(F.col(text_col)).alias("hint"))
    plain = F.array().cast("array<string>")
    own = rows.where("hint").withColumn("names", F.when(titled(F.col("text")), names_in(F.col("text"))).otherwise(plain))
    marked = F.regexp_replace(escaped(F.col("text")), search(F.col("names")), F.lit(f"{MARK}$0{MARK}"))
    cut, _ = store(own.select("row", "hash", F.split(marked, MARK, -1).alias("parts")), "pii-parts")  # gap, mention, gap, ...
    near = lambda i: F.coalesce(F.try_element_at("parts", i), F.lit(""))
    each = F.transform(F.sequence(F.lit(2), F.size("parts") - 1, F.lit(2)), lambda i: F.struct(
        i.alias("at"), F.element_at("parts", i).alias("raw"), near(i - 1).alias("before"), near(i + 1).alias("after"), near(i + 2).alias("following")))
    found = cut.where(F.size("parts") > 1).select("hash", F.explode(each).alias("m")).select("hash", "m.*").withColumn("kind", kind_of(F.col("raw")))
    before = F.substring_index(F.col("before"), "\n", -1)
    mentions, _ = store(found.select("hash", "at", "raw", "kind", normal(F.col("kind"), F.col("raw")).alias("norm"),
                                     gender_of(F.col("kind"), before, F.col("after"), F.col("following")).alias("gender")).distinct(), "pii-mentions")
    made = assign(mentions, key)
    replaced = (mentions.join(made, ["kind", "norm"])
                .groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("at", dressed(F.col("kind"), F.col("raw"), F.col("made")).alias("to")))).alias("to")))
    woven = F.array_join(F.transform("parts", lambda part, i: F.when(i % 2 == 1, F.element_at("to", F.floor(i / 2).cast("int") + 1)["to"])
                                     .otherwise(part)), "")
    joined = cut.join(replaced, "hash", "left").select("row", F.when(F.col("to").isNull(), F.col(f"row.`{text_col}`")).otherwise(unescaped(woven)).alias("new"),
                                                       F.coalesce(F.size("to"), F.lit(0)).alias("n"))
    every = joined.unionByName(rows.where("NOT hint").select("row", F.col("text").alias("new"), F.lit(0).alias("n")))
    return every.select(*[F.col("new").alias(c) if c == text_col
                          else F.char_length("new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
                          else F.col(f"row.`{c}`").alias(c) for c in docs.columns if not (report and c == "n_entities")],
                        *[F.col("n").alias("n_entities")] * report)
