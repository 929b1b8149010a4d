"""Surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail addresses, assigned secrets, access keys, IP addresses (4 and 6), bank account (IBAN) and card numbers with
valid check digits, social security and phone numbers, and names after a title. In a text with such a name the same words are
names wherever they stand ("Ms Anna Weber ... Weber left"). A mention is reduced to entities: the digits of a number (of a phone
the last ten at most, without a country code, so that national and international forms meet), the lower-cased address, each word of a name. A surrogate is drawn
from a keyed SHA-256 of type and entity, so one entity has one surrogate everywhere (coreference), and it keeps the type: same
shape character by character, valid octets, valid check digits, the name's script. The ending of a name's surrogate is chosen for the
entity, from all its mentions: a surname's, or a first name's that fits the titles' gender where they agree. Mentions get the
surrogate in their own format: separators, brackets, country codes and capitals stay.

Collisions: where two entities of a type draw one surrogate, or a surrogate equals a real entity of that type, all but one
draw again with the next nonce, until none is left, so distinct entities stay distinct. After every WIDEN rounds the surrogates
drawn get one more character (a syllable in names), so a short format that is used up doesn't fail: it is left.

Texts of any kind take time in proportion to their length: all repetitions in the pattern are bounded, or of single characters, and
a run of characters is tried from its start only.

Scale: distinct mentions and entities are counted before their shuffles; a text is shuffled once, to meet its replacements by
(doc_id, hash of text), at every size alike. A mention that a third of all texts hold is a plain equi-join, which adaptive
execution splits.

Cases: null text stays null; texts without a mention come back as they are; null doc_id and repeated rows are treated like any
other row; an empty table gives no rows; other columns of the input pass through, an input column named pii_count is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, table

#: Titles by gender, and surrogate syllables and endings by script.
MALE_TITLES = "Mr Herr Monsieur Señor Господин"
FEMALE_TITLES = "Mrs Ms Miss Frau Fräulein Madame Mademoiselle Señora Señorita Госпожа"
OTHER_TITLES = "Dr Prof"
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no ra re", "cyrillic": "ба бе би бо да де ди до фа фе га го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре"}
ENDINGS = {"latin": {"first_f": "na", "first_m": "ron", "first": "lin", "last": "rens"}, "cyrillic": {"first_f": "на", "first_m": "рон", "first": "лин", "last": "ренко"}}

_TITLES = "|".join(f"{MALE_TITLES} {FEMALE_TITLES} {OTHER_TITLES}".split())
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SECRET = r"[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy]"
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,30}[A-Za-z]{2,63}"
SECRET = rf"\b(?:{_SECRET})\s{{0,2}}[=:]\s{{0,2}}[\"']?[A-Za-z0-9_/+-]{{8,}}"
ACCESS_KEY = r"\bAKIA[0-9A-Z]{16}\b"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{{0,39}}[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: (?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){1,6}(?: [0-9]{1,3})?)\b"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[2-6][0-9]{3}(?: [0-9]{4}){3}|[2-6][0-9]{3}(?:-[0-9]{4}){3}|3[0-9]{3} [0-9]{6} [0-9]{5}|3[0-9]{3}-[0-9]{6}-[0-9]{5}|[2-6][0-9]{12,18})(?![0-9])"
PHONE = (
    r"(?<![0-9+])(?:(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})|\([0-9]{2,4}\)|[0-9]{3}(?=[.-]))[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|\+[0-9](?:[ .-]?\(?[0-9]\)?){9,14}(?![0-9]))"
)
_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}{1,40}+(?:['’-]?\p{Lu}\p{Ll}{1,40}+){0,3}"
NAME = rf"\b(?:{_TITLES})\.? {_WORD}(?:[ -]{_WORD})?"
#: A word that may be a name; it is one in a text that has it after a title.
BARE = rf"(?<!\p{{L}}){_WORD}"
KINDS = {"email": EMAIL, "secret": SECRET, "key": ACCESS_KEY, "ip": IP, "ip6": IP6, "iban": IBAN, "ssn": SSN, "card": CARD, "phone": PHONE, "name": NAME}
PATTERN = "|".join(KINDS.values())
WITH_BARE = f"{PATTERN}|{BARE}"
NUMBERS = ["card", "ssn", "phone"]
#: Rounds of drawing after which surrogates get one more character.
WIDEN = 12


#: Every mention but a key or a name holds one of these, or a colon after a secret's name.
SIGNS = r"[0-9@=]|[nNtTdDyY]\s{0,2}:"


def _has_title(text: Column) -> Column:
    may = F.lit(False)
    for title in f"{MALE_TITLES} {FEMALE_TITLES} {OTHER_TITLES}".split():
        may = may | text.contains(title)
    return may


def _names_someone(text: Column) -> Column:
    return _has_title(text) & text.rlike(NAME)


def mentions(text: Column) -> Column:
    """All mentions in order. Texts without any sign of one, most as a rule, are spared the whole pattern."""
    may = text.rlike(SIGNS) | text.contains("AKIA")
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(_names_someone(text), found(WITH_BARE)).when(may, found(PATTERN)).when(text.isNotNull(), F.array().cast("array<string>"))


def _between(text: Column) -> Column:
    """What stands before, between and after the mentions."""
    return F.when(_names_someone(text), F.split(text, WITH_BARE, -1)).otherwise(F.split(text, PATTERN, -1))


def _kind(m: Column) -> Column:
    out = F.lit("bare")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _parts(m: Column, kind: Column) -> Column:
    """A mention as an array of (type, entity, raw, role): raw texts join to the mention; type is null where a part stays."""
    none = F.lit(None)

    def part(type_: Column, entity: Column, raw: Column, role: Column = none) -> Column:
        return F.struct(*[c.cast("string").alias(n) for n, c in (("type", type_), ("entity", entity), ("raw", raw), ("role", role))])

    prefix = F.regexp_extract(m, rf"^((?:{_SECRET})\s{{0,2}}[=:]\s{{0,2}}[\"']?)", 1)
    value = F.substring(m, F.length(prefix) + 1, F.length(m))
    title = F.regexp_extract(m, rf"^((?:{_TITLES})\.? )", 1)
    # a hyphen before a second word is a gap; within a word it is part of it
    words = F.regexp_extract_all(F.substring(m, F.length(title) + 1, F.length(m)), F.lit(r" ?[^ ]+"), F.lit(0))
    bare = F.regexp_replace(title, r"\.? $", "")
    first = F.when(bare.isin(MALE_TITLES.split()), "first_m").when(bare.isin(FEMALE_TITLES.split()), "first_f").otherwise("first")
    gap = lambda w: F.regexp_extract(w, r"^( ?)", 1)
    name = lambda w: F.ltrim(w)
    role = lambda i: F.when(i == F.size(words) - 1, F.lit("last")).otherwise(first)
    of_name = F.flatten(F.transform(words, lambda w, i: F.array(part(none, none, gap(w)), part(F.lit("name"), F.lower(name(w)), name(w), role(i)))))
    return (
        F.when(kind == "name", F.concat(F.array(part(none, none, title)), of_name))
        .when(kind == "bare", F.array(part(F.lit("name"), F.lower(m), m)))
        .when(kind == "secret", F.array(part(none, none, prefix), part(kind, value, value)))
        .when(kind == "email", F.array(part(kind, F.lower(m), m)))
        .when(kind == "phone", F.array(part(kind, F.right(_digits(F.regexp_replace(m, r"^\+[0-9]{1,3}(?=[ .(-])", "")), F.lit(10)), m)))
        .when(kind.isin(NUMBERS), F.array(part(kind, _digits(m), m)))
        .when(kind == "ip6", F.array(part(kind, F.lower(m), m)))
        .when(kind == "iban", F.array(part(kind, F.regexp_replace(m, " ", ""), m)))
        .otherwise(F.array(part(kind, m, m)))
    )


def _byte(stream: Column, i: Column) -> Column:
    """The i-th (from 0) keyed byte."""
    return F.conv(F.substr(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _char(c: Column, b: Column, hexadecimal: Column) -> Column:
    """A character of the same class."""
    letters = F.when(hexadecimal, F.lit(6)).otherwise(F.lit(26))
    return (
        F.when(c.rlike("[0-9]"), F.char(F.lit(48) + b % 10))
        .when(c.rlike("[a-z]"), F.char(F.lit(97) + b % letters))
        .when(c.rlike("[A-Z]"), F.char(F.lit(65) + b % letters))
        .otherwise(c)
    )


def _let(value: Column, then) -> Column:
    """then(value), with ``value`` evaluated once: within the lambdas of array functions it would be evaluated for every element."""
    return F.get(F.transform(F.array(value), then), 0)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _alike(s: Column, stream: Column, offset: int = 0) -> Column:
    new = lambda hexadecimal: F.transform(_chars(s), lambda c, i: _char(c, _byte(stream, i + offset), hexadecimal))
    return F.array_join(_let(s.rlike("^[0-9a-fA-F]+$"), new), "")


def _luhn(s: Column) -> Column:
    """Sum of a digit string, every second digit from the right but one doubled."""
    digits = F.filter(F.split(F.reverse(s), ""), lambda c: c != "")
    worth = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x)


def _mod97(s: Column) -> Column:
    """An account number's remainder, letters counting from 10."""
    chars = _chars(s)
    digit = lambda c: c.rlike("[0-9]")
    value = F.transform(chars, lambda c: F.when(digit(c), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97))


def valid(mention: Column, kind: Column) -> Column:
    """Whether a card or account number's check digits fit; true for other kinds."""
    iban = F.regexp_replace(mention, " ", "")
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.when(kind == "card", _luhn(_digits(mention)) % 10 == 0).when(kind == "iban", _mod97(moved) == 1).otherwise(True)


def surrogate(kind: Column, entity: Column, nonce: Column, role: Column, key: str) -> Column:
    message = F.concat_ws("\u0001", kind, nonce.cast("string"), entity)
    draw = lambda salt: F.sha2(F.concat(F.lit(key + salt), F.sha2(F.concat(F.lit(key + salt), message).cast("binary"), 256)).cast("binary"), 256)
    return _let(F.concat(draw("\u0001"), draw("\u0002")), lambda stream: _drawn(kind, entity, nonce, role, stream))


def _drawn(kind: Column, entity: Column, nonce: Column, role: Column, stream: Column) -> Column:
    """The surrogate that a keyed stream of bytes gives."""
    b = lambda i: _byte(stream, F.lit(i))
    more = F.floor(nonce / WIDEN).cast("int")
    wider = lambda one: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), more), lambda i: i < more), lambda i: one(_byte(stream, i + 40))), "")
    digits = wider(lambda x: (x % 10).cast("string"))
    user, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    email = F.concat(_alike(user, stream), wider(lambda x: F.char(F.lit(97) + x % 26)), F.lit("@"), _alike(host, stream, 32), F.lit("."), top)
    ip = F.concat(F.concat_ws(".", *[(b(i) % 254 + 1).cast("string") for i in range(4)]), digits)
    body = F.concat(F.substring(entity, 1, 1), F.substring(_alike(entity, stream), F.lit(2), F.length(entity) - 2), digits)
    check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    account = F.concat(_alike(F.substring(entity, F.lit(5), F.length(entity)), stream), digits)
    country = F.substring(entity, 1, 2)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)

    def person(script: str) -> Column:
        syllables = F.array(*[F.lit(s) for s in SYLLABLES[script].split()])
        ending = F.lit("")
        for k, v in ENDINGS[script].items():
            ending = F.when(role == k, v).otherwise(ending)
        pick = lambda x: F.get(syllables, x % F.size(syllables))
        return F.concat(*[pick(b(i)) for i in range(5)], wider(pick), ending)

    names = F.when(entity.rlike(r"\p{IsCyrillic}"), person("cyrillic")).otherwise(person("latin"))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", F.concat(body, check))
        .when(kind == "iban", iban)
        .when(kind == "key", F.concat(F.lit("AKIA"), _alike(F.substring(entity, F.lit(5), F.length(entity)), stream), digits))
        .when(kind == "name", names)
        .when(kind == "ip6", F.concat(_hexadecimal(entity, stream), digits))
        .otherwise(F.concat(_alike(entity, stream), digits))
    )


def _hexadecimal(s: Column, stream: Column) -> Column:
    chars = _chars(s)
    return F.array_join(F.transform(chars, lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex((_byte(stream, i) % 15 + 1).cast("long"))))), "")


def assign(spark: SparkSession, entities: DataFrame, key: str) -> DataFrame:
    """entities: type, entity (distinct), role. With surrogate and nonce: distinct surrogates, none a real entity of its type."""
    own = ["type", "entity", "role"]
    drawn = lambda df: df.withColumn("surrogate", surrogate(F.col("type"), F.col("entity"), F.col("nonce"), F.col("role"), key))
    now = stage(spark, drawn(entities.select(*own).withColumn("nonce", F.lit(0))), "pii-draw")
    real = entities.select(F.col("type").alias("_t"), F.col("entity").alias("_e"), F.lit(True).alias("_real"))
    order = Window.partitionBy("type", "surrogate").orderBy("nonce", "entity")
    while True:  # wider surrogates leave any format that is used up
        checked = now.withColumn("_n", F.row_number().over(order)).join(real, (F.col("type") == F.col("_t")) & (F.col("surrogate") == F.col("_e")), "left")
        bad = F.coalesce(F.col("_real"), F.lit(False)) | (F.col("_n") > 1)
        checked = stage(spark, checked.select(*own, "nonce", "surrogate", bad.alias("_bad")), "pii-checked")
        if not checked.filter("_bad").take(1):
            return checked.drop("_bad")
        again = drawn(checked.filter("_bad").select(*own, (F.col("nonce") + 1).alias("nonce")))
        now = stage(spark, checked.filter("NOT _bad").drop("_bad").unionByName(again), "pii-draw")


def _fill(raw: Column, new: Column, places: str) -> Column:
    """``raw`` with its characters of the class ``places`` replaced by those of ``new``, from the right; what is left over of either stays."""
    own = F.regexp_replace(raw, f"[^{places}]", "")
    full = F.concat(F.substring(own, F.lit(1), F.greatest(F.length(own) - F.length(new), F.lit(0))), new)

    def put(full: Column) -> Column:
        def step(a: Column, c: Column) -> Column:
            mine = c.rlike(f"[{places}]")
            return F.struct(F.concat(a["s"], F.when(mine, F.substr(full, a["i"], F.lit(1))).otherwise(c)).alias("s"), (a["i"] + mine.cast("int")).alias("i"))

        done = F.aggregate(_chars(raw), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), step)
        return _let(done, lambda d: F.concat(d["s"], F.substring(full, d["i"], F.length(full))))

    return _let(full, put)


def _render(kind: Column, raw: Column, new: Column) -> Column:
    """The surrogate in the mention's own format."""
    cased = F.when((F.upper(raw) == raw) & (F.lower(raw) != raw), F.upper(new)).when(kind == "name", F.initcap(new)).otherwise(new)
    return (
        F.when(kind.isNull(), raw)
        .when(kind.isin(NUMBERS), _fill(raw, new, "0-9"))
        .when(kind == "iban", _fill(raw, new, "0-9A-Z"))
        .when(kind.isin("email", "name", "ip6"), cased)
        .otherwise(new)
    )


def _entities(parts: DataFrame) -> DataFrame:
    """type, entity, role: of all roles a name is met in, a first name's with the gender that its titles agree on comes before a surname's."""
    met = lambda role: F.max(F.coalesce(F.col("role") == role, F.lit(False)))
    rows = parts.filter("type IS NOT NULL").groupBy("type", "entity").agg(met("first_f").alias("f"), met("first_m").alias("m"), met("first").alias("n"))
    role = F.when(F.col("f") & ~F.col("m"), "first_f").when(F.col("m") & ~F.col("f"), "first_m").when(F.col("f") | F.col("n"), "first").otherwise("last")
    return rows.select("type", "entity", F.when(F.col("type") == "name", role).alias("role"))


def pseudonymise(spark: SparkSession, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with mentions replaced in column ``text``, and pii_count, the number of mentions replaced in it."""
    # the input's columns travel in one struct, so that their names can't clash with the ones used here
    docs = docs.drop("pii_count")
    body = F.col(f"doc.{text}")
    rows = docs.select(F.struct(*docs.columns).alias("doc")).withColumns({"_i": F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")), "_h": F.xxhash64(body)})
    found = stage(spark, rows.select(F.col("_i").alias("i"), F.col("_h").alias("h"), F.posexplode(mentions(body)).alias("at", "mention")), "pii-mentions")
    kinds = found.select("mention").distinct().withColumn("kind", _kind(F.col("mention"))).filter(valid(F.col("mention"), F.col("kind")))
    parts = kinds.select("mention", "kind", F.posexplode(_parts(F.col("mention"), F.col("kind"))).alias("k", "p"))
    parts = stage(spark, parts.select("mention", "kind", "k", "p.type", "p.entity", "p.raw", "p.role"), "pii-parts")
    known = assign(spark, _entities(parts.filter("kind <> 'bare'")), key)
    drawn = parts.join(known.select("type", "entity", "surrogate"), ["type", "entity"], "left").filter("kind <> 'bare' OR surrogate IS NOT NULL")
    whole = drawn.groupBy("mention", "kind").agg(
        F.array_sort(F.collect_list(F.struct("k", _render(F.col("type"), F.col("raw"), F.col("surrogate")).alias("s")))).alias("a"),
        F.max(F.when(F.col("kind") == "bare", F.col("entity"))).alias("word"),
    )
    changed = stage(spark, whole.select(F.col("mention").alias("_m"), "word", F.array_join(F.transform("a", lambda x: x["s"]), "").alias("new")), "pii-new")
    # a bare word counts only in a text that has it after a title
    titled = parts.filter("kind = 'name' AND type = 'name'").select(F.col("mention").alias("_m"), F.col("entity").alias("_w"))
    titled = found.join(titled, F.col("mention") == F.col("_m")).select(F.col("i").alias("_i"), F.col("h").alias("_h"), "_w").distinct()
    met = found.join(changed, F.col("mention") == F.col("_m"), "left")
    here = (F.col("i") == F.col("_i")) & (F.col("h") == F.col("_h")) & (F.col("word") == F.col("_w"))
    met = met.join(titled, here, "left").withColumn("hit", F.col("new").isNotNull() & (F.col("word").isNull() | F.col("_w").isNotNull()))
    put = F.struct("at", F.when(F.col("hit"), F.col("new")).otherwise(F.col("mention")).alias("s"), F.col("hit").cast("int").alias("hit"))
    swaps = met.groupBy("i", "h").agg(F.array_sort(F.collect_set(put)).alias("_put"), F.max("hit").alias("_any")).filter("_any").drop("_any")
    swaps = stage(spark, swaps, "pii-swaps")
    joined = rows.join(swaps.hint("merge"), (F.col("_i") == F.col("i")) & (F.col("_h") == F.col("h")), "left")
    put = F.concat(F.transform("_put", lambda x: x["s"]), F.array(F.lit("")))
    new = F.array_join(F.flatten(F.zip_with(_between(body), put, lambda a, b: F.array(a, b))), "")
    same = F.col("_put").isNull()
    return joined.select(
        *[(F.when(same, body).otherwise(new).alias(c) if c == text else F.col(f"doc.`{c}`")) for c in docs.columns],
        F.when(same, 0).otherwise(F.size(F.filter("_put", lambda x: x["hit"] == 1))).alias("pii_count"),
    )


#: The query's key. A deployment passes its own secret.
DEMO_KEY = "skuforge surrogate key"


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, pii_count."""
    return pseudonymise(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
