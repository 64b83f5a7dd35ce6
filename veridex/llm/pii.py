"""Operator 9: PII is replaced by surrogates, in DataFrame functions only.

Cheap triggers tell the texts that may have entities, then one expression finds those of all types. Runs have no length
bounds. Each entity gets a surrogate that HMAC-SHA-512 draws from its type and its canonical form (e-mail addresses, IPv6
addresses and hex secrets in lower case, numbers without their separators): the same entity has the same surrogate
wherever and however it is written, and the surrogate is written as the occurrence is: its separators, its case, its number
of digits; a name keeps its script. Card numbers and IBANs need no right check digits to be found (a mistyped one is
private, too), but where the original's are right, the surrogate's are. An IPv6 address that is shortened in two ways is two.

Names are found after a title and replaced part by part, so 'Dr Anna Weber', 'Ms Weber' and, in a document that has one of
them, 'Weber' alone share their surrogates. All words of a name but the last are given names, and a word that is one anywhere
is one everywhere; it keeps the gender that the titles before it tell, unless they disagree. Particles stay as they are.
Initials become letters, which are not compared. A name of a document that is an ordinary word, too, is replaced as that.

Surrogates of all distinct entities
are compared over the whole corpus: where two entities drew the same one, or one drew what is itself an entity
of the corpus, all but the first draw again, until all differ.

Texts without entities stay as they are; null stays null, empty stays empty, an empty table gives an empty one. Very long
texts are taken whole. Repeated rows are replaced alike. Where two matches tie, the kind that is first in KINDS counts. All
other columns are carried, whatever they are called. The key is a parameter without a default: whoever has it can draw the same surrogates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm.common import discard, saved, spread, table

#: The key of the registered queries where the session has none in KEY_CONF: for tests and shows, not for private data.
DEMO_KEY, KEY_CONF = "veridex demonstration key", "spark.veridex.pii.key"
#: Rounds of draws after which a kind counts as having too few surrogates.
MAX_DRAWS = 64
_UPPER_HEX = "^[0-9]*[A-F][0-9A-F]*$"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Doña|госпожа"
_MALE = r"Mr|Herr|Monsieur|Señor|Sr|Don|господин"
_NEITHER = "Dr|Prof"
_SPACE = r"[ \u00a0]"
_END = r"(?![\p{L}\p{M}\p{N}_])"
_TITLE = rf"(?:{_FEMALE}|{_MALE}|{_NEITHER}){_END}"
#: A word of a name: capitals and apostrophes within, but no 's or the like at the end. Runs are possessive: nothing is tried twice.
_PART = r"\p{Lu}(?:['’]\p{Lu})?+[\p{L}\p{M}]++(?:['’](?!(?:s|ll|d|re|ve)(?![\p{L}\p{M}]))[\p{L}\p{M}]++)*+"
_INITIALS = rf"(?:\p{{Lu}}(?:\.{_SPACE}?|{_SPACE}))*+"
_PARTICLES = rf"(?:(?:von|van|der|den|de|la|las|los|del|della|di|da|dos|das|du|le|zu|zum|zur|ter|ten|bin|ibn|y){_SPACE}|[dl]['’]|al-|el-)*+"
_NAME = rf"(?!{_TITLE}){_PARTICLES}{_INITIALS}{_PART}(?:(?:{_SPACE}{_PARTICLES}|-)(?!{_TITLE}){_INITIALS}{_PART})*+"
_GAP = r"\.?[\s\u00a0]{1,2}"
_LABELS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key")
_HEX4 = "[0-9A-Fa-f]{1,4}"


def _titled(first: str, titles: str) -> str:
    """A title of the kind and those after it; only places with one of the letters `first` are looked at closely."""
    return rf"(?=[{first}])(?<![\p{{L}}\p{{M}}\p{{N}}_])(?:{titles}){_GAP}(?:(?:{_NEITHER}){_GAP})*+(?=\p{{L}}|['’])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Characters of the canonical form are all but those that match this.
    core: str = ""
    #: What stands before it and is kept.
    before: str = ""


#: In order of precedence where two begin at the same place. Each begins with a check of one character that most places fail.
KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9])[A-Za-z0-9.-]*\.[A-Za-z]{2,}+(?![A-Za-z0-9])"),
    Kind("key", r"(?=[Aeg])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{20,}+|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)"),
    Kind("secret", r"[A-Za-z0-9+/_=.-]{7,}[A-Za-z0-9+/_-]", before=r"""(?=[pstaPSTA])(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?\s{0,4}[=:]\s{0,4}["']?"""),
    Kind("ipv4", rf"(?=[0-9])(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"),
    Kind("ipv6", rf"(?=[0-9A-Fa-f])(?<![\w.:])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?=[0-9a-fA-F:]*[0-9])(?=(?:[0-9a-fA-F]*:){{3}}){_HEX4}(?::{_HEX4}){{0,5}}::{_HEX4}(?::{_HEX4}){{0,5}})(?![\w:])"),
    Kind("ssn", r"(?=[0-9])(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", r"[^0-9]"),
    Kind("iban", r"(?=[A-Z])(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", r"[^0-9A-Z]"),
    Kind("card", r"(?=[0-9])(?<![\w.+-])(?:\d{4}[ -]?){3}\d{1,7}(?![\w-])", r"[^0-9]"),
    Kind("phone", r"(?=[0-9+(])(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))", r"[^0-9]"),
    Kind("woman", _NAME, before=_titled("MFSDг", _FEMALE)),
    Kind("man", _NAME, before=_titled("MHSDг", _MALE)),
    Kind("person", _NAME, before=_titled("DP", _NEITHER)),
)
#: Every second group is an entity; that before it is kept.
PATTERN = "|".join(f"({k.before})({k.pattern})" for k in KINDS)


def suspect(text: Column) -> Column:
    """Whether PATTERN may match: a part of each of its alternatives is there. Most texts are told by this one alone."""
    low = F.lower(text)
    has = lambda x, *words: reduce(or_, (F.contains(x, F.lit(w)) for w in words))
    return (
        has(text, "@") | text.rlike(r"[0-9][0-9 .()-]{5}") | text.rlike(r":[0-9A-Fa-f:]") & text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f:]") | text.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")
        | has(text, "AKIA", "ASIA", "eyJ", "ghp_", "gho_", "ghu_", "ghs_", "ghr_") | has(text, "=", ":") & has(low, *_LABELS)
        | text.rlike(rf"(?=[MFSDHPг])(?:{_FEMALE}|{_MALE}|{_NEITHER}){_GAP}")
    )


#: Kinds of the words of names; a mention has no title, its kind is that of the same word after one.
_GIVENS = ("woman", "man", "person")
_NAMES = (*_GIVENS, "name", "mention")
_ALL = (*(k.name for k in KINDS), "name", "mention", "initial")
_MARK, _FIELD = "\x1e", "\x1f"
#: Marks that the text itself has.
_ESCAPES = (("\x1c", "\x1c\x0e"), (_MARK, "\x1c\x0f"), (_FIELD, "\x1c\x10"))
_GIVEN = {
    ("woman", "latin"): "Anna Clara Elena Greta Helena Irene Julia Laura Maria Nora Paula Rosa Sofia Teresa Vera Yvonne",
    ("man", "latin"): "Adam Bruno Carl Daniel Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Oscar Paul Simon",
    ("person", "latin"): "Alex Andrea Chris Dominique Eden Florin Gale Jean Kim Luca Morgan Noa Robin Sam Toni Val",
    ("woman", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Полина Раиса Софья Тамара Юлия",
    ("man", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Юрий",
    ("person", "cyrillic"): "Саша Женя Валя Слава Шура Паша Тоня Миша Катя Коля Лёша Дима Света Рита Гена Вова",
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa po ra re ro sa so ta",
    "cyrillic": "ба бе бо да де до фа фе га го ха хе ка ке ко ла ле ло ма ме мо на не но па по ра ре ро са со та",
}


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f's lambdas refer to it."""
    return F.transform(F.array(x), f)[0]


def _entity(kind: Column, value: Column) -> Column:
    """Struct (kind, value, canon)."""
    canon = value
    for k in KINDS:
        if k.core:
            canon = F.when(kind == k.name, F.regexp_replace(value, k.core, "")).otherwise(canon)
    canon = F.when(kind.isin(*_NAMES, "initial"), F.lower(F.translate(value, "’", "'"))).otherwise(canon)
    lower = kind.isin("email", "ipv6") | (kind == "secret") & value.rlike(_UPPER_HEX)
    return F.struct(kind.alias("kind"), value.alias("value"), F.when(lower, F.lower(value)).otherwise(canon).alias("canon"))


def _marks(groups: dict[str, int]) -> str:
    """A replacement that puts marks around a match, and the groups of a pattern into the fields of their kinds."""
    return _MARK + _FIELD.join(f"${groups[k]}" if k in groups else "" for k in _ALL) + _MARK


def _kind(piece: Column) -> Column:
    return F.array(*(F.lit(k) for k in _ALL))[F.length(F.regexp_extract(piece, f"^{_FIELD}*", 0))]


def _value(piece: Column) -> Column:
    return F.translate(piece, _FIELD, "")


def _is_name(piece: Column, i: Column) -> Column:
    return (i % 2 == 1) & _kind(piece).isin(*_GIVENS)


def _named(pieces: Column) -> Column:
    """The text of pieces, with marks around each word of its names, wherever it stands."""
    parts = F.array_distinct(F.regexp_extract_all(F.array_join(F.transform(F.filter(pieces, _is_name), _value), " "), F.lit(_PART), 0))
    forms = F.array_distinct(F.concat(parts, F.transform(parts, F.upper), F.transform(parts, lambda p: F.initcap(F.lower(p)))))
    word = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}_])(?=\p{Lu})(?:"), F.regexp_replace(F.array_join(forms, "|"), "['’]", "['’]"), F.lit(rf"){_END}"))

    def marked(p: Column, word: Column) -> Callable[[Column, Column], Column]:
        def split(x: Column, i: Column) -> Column:
            words = F.lit(None).cast("string")
            for k in _GIVENS:
                pattern = rf"({_PART})(?=.*{_SPACE})|({_PART})|(\p{{Lu}})"
                words = F.when(_kind(x) == k, F.regexp_replace(_value(x), pattern, _marks({k: 1, "name": 2, "initial": 3}))).otherwise(words)
            return F.when(i % 2 == 0, F.regexp_replace(x, word, F.lit(_marks({"mention": 0})))).otherwise(F.coalesce(words, F.concat(F.lit(_MARK), x, F.lit(_MARK))))

        return split

    both = F.struct(pieces.alias("p"), word.alias("w"))
    return _once(both, lambda b: F.array_join(F.transform(b["p"], marked(b["p"], b["w"])), ""))


def marked(text: Column) -> Column:
    """text with marks around its entities, which are in the fields of their kinds; null if it has none."""
    return F.when(suspect(text), _marked(text))


def _marked(text: Column) -> Column:
    for a, b in _ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    kept = "".join(f"${2 * i + 1}" for i in range(len(KINDS)))
    found = F.regexp_replace(text, PATTERN, kept + _marks({k.name: 2 * i + 2 for i, k in enumerate(KINDS)}))
    named = lambda p: F.when(F.exists(F.transform(p, _is_name), lambda x: x), _named(p)).otherwise(F.array_join(p, _MARK))
    return _once(found, lambda m: F.when(m.contains(_MARK), _once(F.split(m, _MARK, -1), named)))


def _class(kind: Column) -> Column:
    """What the surrogates of a kind are compared with."""
    return F.when(kind.isin(*_NAMES), "name").otherwise(kind)


def _hmac(message: Column, key: str) -> Column:
    """HMAC-SHA-512 in hex."""
    k = key.encode()
    k = (hashlib.sha512(k).digest() if len(k) > 128 else k).ljust(128, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 512))), 512)


def _digest(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Hex digits of 128 bytes that depend on the key, the kind, the canonical form and how often was drawn."""
    return F.concat(*(_hmac(F.concat_ws(_FIELD, kind, attempt.cast("string"), F.lit(n), canon), key) for n in "01"))


def _byte(digest: Column, i: Column | int) -> Column:
    return F.conv(F.substring(digest, (F.lit(i) if isinstance(i, int) else i) % 128 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(words: str, n: Column) -> Column:
    return F.array(*(F.lit(w) for w in words.split()))[n % len(words.split())]


def _alike(value: Column, digest: Column, since: int = 0) -> Column:
    """value with each digit and each letter a-z, A-Z drawn anew, all else kept."""
    out = F.transform(F.split(value, ""), lambda c, i: F.when(c.between("0", "9"), F.substring(F.lit("0123456789"), _byte(digest, i + since) % 10 + 1, F.lit(1)))
                      .when(c.between("a", "z"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _byte(digest, i + since) % 26 + 1, F.lit(1)))
                      .when(c.between("A", "Z"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _byte(digest, i + since) % 26 + 1, F.lit(1))).otherwise(c))
    return F.array_join(out, "")


def drawn(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the surrogate."""
    return _once(_digest(kind, canon, attempt, key), lambda d: _drawn(kind, canon, attempt, d))


def _luhn(digits: Column) -> Column:
    """The sum of digits modulo 10, every second one from the right doubled: 0 if the last one is right."""
    def weighed(c: Column, i: Column) -> Column:
        n = F.coalesce(c.try_cast("int"), F.lit(0)) * (i % 2 + 1)
        return n - F.when(n > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weighed), F.lit(0), lambda a, n: a + n) % 10


def _mod97(letters: Column) -> Column:
    """Letters and digits as one number, A = 10 to Z = 35, modulo 97."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.between("A", "Z"), a * 100 + F.ascii(c) - 55).otherwise(a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)


def _card(canon: Column, made: Column) -> Column:
    """made, with a right last digit if canon has one."""
    body = F.substring(made, F.lit(1), F.length(made) - 1)
    return F.when(_luhn(canon) == 0, F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))).otherwise(made)


def _iban(canon: Column, made: Column) -> Column:
    """made, with right check digits if canon has them."""
    turned = lambda x: F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))
    country, rest = F.substring(canon, 1, 2), F.substring(made, F.lit(5), F.length(made))
    right = F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(_mod97(turned(canon)) == 1, F.concat(country, right, rest)).otherwise(made)


def _drawn(kind: Column, canon: Column, attempt: Column, d: Column) -> Column:
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    # At least ten drawn characters; labels in front of the last two are kept in number; example.* belongs to no one.
    tail = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _byte(d, i + 100) % 26 + 1, F.lit(1))), "")
    made = _alike(local, d)
    padded = F.concat(made, F.substring(tail, F.lit(1), F.greatest(F.lit(0), 10 - F.length(made))))
    labels = F.size(F.split(domain, r"\."))
    front = F.when(labels > 2, F.concat(_alike(F.substring_index(domain, ".", 1), d, 64), F.lit("."))).otherwise(F.lit(""))
    email = F.concat(padded, F.lit("@"), front, F.lit("example."), F.when(F.substring_index(domain, ".", -1).isin("com", "net", "org"), F.substring_index(domain, ".", -1)).otherwise(F.lit("org")))
    prefix = F.when(canon.startswith("AKIA") | canon.startswith("ASIA"), 4).when(canon.startswith("gh"), 4).when(canon.startswith("eyJ"), 3).otherwise(0)
    key_like = F.concat(F.substring(canon, F.lit(1), prefix), _alike(F.substring(canon, prefix + 1, F.length(canon)), d))
    # Addresses that are reserved, and after many draws any others; documentation addresses of IPv6.
    ip = F.concat_ws(".", F.when(attempt < 16, 240 + _byte(d, 0) % 15).otherwise(1 + _byte(d, 0) % 254).cast("string"), *(_byte(d, i).cast("string") for i in (1, 2, 3)))
    ip6 = F.concat_ws(":", F.lit("2001:db8"), *(F.substring(d, F.lit(4 * i + 1), F.lit(4)) for i in range(6)))
    iban = _once(F.concat(F.substring(canon, 1, 2), _alike(F.substring(canon, F.lit(3), F.length(canon)), d)), lambda made: _iban(canon, made))
    card = _once(F.concat(F.substring(canon, 1, 1), _alike(F.substring(canon, F.lit(2), F.length(canon)), d)), lambda made: _card(canon, made))
    phone = F.when(F.length(canon) > 10, F.concat(F.substring(canon, F.lit(1), F.length(canon) - 10), _alike(F.substring(canon, F.length(canon) - 9, F.lit(10)), d))).otherwise(_alike(canon, d))
    script = F.when(canon.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    names = F.lit(None).cast("string")
    for s in ("latin", "cyrillic"):
        # Lists are short: who draws again gets a longer name, so there are always enough.
        syllables = lambda n, s=s: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(_SYLLABLES[s], _byte(d, i + 8))), "")
        names = F.when((kind == "name") & (script == s), syllables(5 + F.floor(attempt / 4).cast("int"))).otherwise(names)
        names = F.when((kind == "initial") & (script == s), _pick(" ".join(sorted({x[0] for x in _SYLLABLES[s].split()})), _byte(d, 0))).otherwise(names)
        for who in _GIVENS:
            given = F.concat(F.lower(_pick(_GIVEN[who, s], _byte(d, 8))), F.when(attempt > 0, syllables(3 + F.floor(attempt / 4).cast("int"))).otherwise(""))
            names = F.when((kind == who) & (script == s), given).otherwise(names)
    return (
        F.when(kind == "email", email).when(kind == "key", key_like).when((kind == "secret") & canon.rlike("^[0-9a-f]{1,256}$"), F.substring(d, F.lit(1), F.length(canon))).when(kind == "secret", _alike(canon, d)).when(kind == "ipv4", ip).when(kind == "ipv6", ip6).when(kind == "iban", iban)
        .when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", _alike(canon, d)).otherwise(names)
    )


def written(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate as the occurrence is written: its separators; an address or a name in capitals stays in capitals."""
    numbers = kind.isin("ssn", "card", "phone", "iban")
    # The n-th letter or digit of the value becomes the n-th of the surrogate; n is counted in what precedes it.
    placed = F.struct(value.alias("v"), surrogate.alias("s"))
    spaced = _once(placed, lambda p: F.array_join(F.transform(F.split(p["v"], ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(p["s"], F.length(F.regexp_replace(F.substring(p["v"], F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c)), ""))
    capitals = (F.length(value) > 1) & (value == F.upper(value))
    return F.when(kind.isin(*_NAMES, "initial"), F.when(capitals, F.upper(surrogate)).otherwise(F.initcap(surrogate))).when(numbers, spaced).when(kind.isin("email", "ipv6") & (value == F.upper(value)) | (kind == "secret") & value.rlike(_UPPER_HEX), F.upper(surrogate)).otherwise(surrogate)


def redrawn(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities that have to draw again, for distinct entities (kind, canon)."""
    state = found.withColumn("attempt", F.lit(0))
    old: list[DataFrame] = []
    for _ in range(MAX_DRAWS):
        now = saved(state.withColumn("surrogate", drawn(F.col("kind"), F.col("canon"), F.col("attempt"), key)).withColumn("class", _class(F.col("kind"))), "surrogates")
        first = now.groupBy("class", "surrogate").agg(F.min("canon").alias("first"), F.count("*").alias("n"))
        twice = now.join(first.where("n > 1"), ["class", "surrogate"]).where("canon <> first").select("kind", "canon")
        real = now.join(now.selectExpr("class", "canon AS surrogate"), ["class", "surrogate"], "left_semi").select("kind", "canon")
        again = saved(twice.unionAll(real).distinct().withColumn("again", F.lit(1)), "again")
        discard(*old)
        if again.isEmpty():
            return now.where("attempt > 0").select("kind", "canon", "attempt")
        state, old = now.join(again, ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), [now, again]
    kinds = sorted(r[0] for r in again.select("kind").distinct().collect())  # one row a kind
    raise ValueError(f"after {MAX_DRAWS} draws there are still equal surrogates of {', '.join(kinds)}")


def replaced(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with surrogates in its text; count_col: a further column with the number of entities."""
    names = docs.columns
    text = F.col(f"`{text_col}`")
    packed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), marked(text).alias("m"), F.monotonically_increasing_id().alias("rid"))
    packed = saved(packed, "marked")
    # Gaps and entities by turns.
    pieces = F.split("m", _MARK, -1)
    gaps, found = F.filter(pieces, lambda x, i: i % 2 == 0), F.transform(F.filter(pieces, lambda x, i: i % 2 == 1), lambda x: _entity(_kind(x), _value(x)))
    hits = packed.where("m IS NOT NULL").withColumn("gaps", gaps).withColumn("found", found)
    each = hits.select("rid", F.explode("found").alias("e")).select("rid", _class(F.col("e.kind")).alias("class"), "e.kind", "e.canon").where("kind <> 'initial'")
    told = [F.max(F.col("kind") == k).alias(k) for k in _GIVENS]
    kind = F.when(F.col("class") != "name", F.col("class")).when(~F.col("woman") & ~F.col("man") & ~F.col("person"), "name")
    kind = kind.when(F.col("woman") & ~F.col("man"), "woman").when(F.col("man") & ~F.col("woman"), "man").otherwise("person")
    known = saved(each.groupBy("class", "canon").agg(*told).select("class", "canon", kind.alias("kind")), "entities")
    again = redrawn(known.select("kind", "canon"), key)
    known = known.join(again, ["kind", "canon"], "left").where("class = 'name' OR attempt > 0").select("class", "canon", F.struct("kind", F.coalesce("attempt", F.lit(0)).alias("attempt")).alias("as"))
    tried = each.select("rid", "class", "canon").distinct().join(known, ["class", "canon"]).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(_FIELD, "class", "canon"), "as"))).alias("tried"))

    def new(e: Column) -> Column:
        def drawn_as(a: Column) -> Column:
            as_kind = F.coalesce(a["kind"], e["kind"])
            return written(as_kind, e["value"], drawn(as_kind, e["canon"], F.coalesce(a["attempt"], F.lit(0)), key))

        return _once(F.try_element_at(F.col("tried"), F.concat_ws(_FIELD, _class(e["kind"]), e["canon"])), drawn_as)

    joined = F.array_join(F.flatten(F.zip_with("gaps", F.transform("found", new), lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    for a, b in reversed(_ESCAPES):
        joined = F.replace(joined, F.lit(b), F.lit(a))
    columns = [f"c{i}" for i in range(len(names))]
    at = columns[names.index(text_col)]
    changed = hits.join(tried, "rid", "left").select(*(joined.alias(c) if c == at else c for c in columns), F.size("found").alias("n"))
    out = changed.unionAll(packed.where("m IS NULL").select(*columns, F.lit(0).alias("n")))
    return out.select(*(F.col(c).alias(name) for c, name in zip(columns, names)), *([F.col("n").alias(count_col)] if count_col else []))


def session_key(spark: SparkSession) -> str:
    """The key that the session has in KEY_CONF, else the one for shows."""
    return spark.conf.get(KEY_CONF, None) or DEMO_KEY


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), session_key(spark), count_col="n_entities")
