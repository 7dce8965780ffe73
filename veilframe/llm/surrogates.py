"""Surrogates for personal data: keyed replacements of the same type and format.

Detected values get a replacement that depends on a secret key and the value alone, so the same value has the same one
everywhere (coreference): a given name or surname stays one name whatever stands before it, and also where nothing does,
in a text that names it with a title elsewhere; a phone number stays one number with and without country code, a mail domain
one domain. Replacements look alike: digits for digits, letters for letters of the same case and script, card numbers pass or
fail the Luhn test as before, IBANs have right check digits, private addresses stay private, names keep script, capitals and
gender. The gender of a name is that of its titles in the corpus; with titles of both it is neutral.

Over the whole corpus replacements are checked: two values never share one, and none is a value that occurs. Whoever
fails is drawn again. Values are grouped and joined by type and value; nothing is gathered in one place.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, stacked

MAX_ROUNDS = 50
# From so many draws on the space of replacements grows.
WIDER = 3

# Titles that go before names, by gender.
MALE = "Mr Herr Señor Sr Monsieur Don Господин Mister السيد"
FEMALE = "Mrs Ms Miss Frau Señora Sra Señorita Madame Mme Mlle Doña Госпожа السيدة"
NEUTRAL = "Dr Prof Доктор"
_GENDER = {t: g for g, ts in (("m", MALE), ("f", FEMALE), ("n", NEUTRAL)) for t in ts.split()}
_TITLES = "|".join(sorted(_GENDER, key=len, reverse=True))
_NAMES = "Name|Nom|Nombre|Имя|الاسم"
_SECRETS = r"password|passwd|pwd|secret|token|api[_-]?key"
# Titles that go after Chinese names, by gender, and frequent surnames.
_AFTER = {"先生": "m", "女士": "f", "小姐": "f", "教授": "n", "博士": "n"}
_FAMILIES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕"
_LABEL_HAN = "姓名"
# Calling codes of two digits; those that begin with 1 or 7 have one, all others three.
_TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

# In the order of precedence; what overlaps an earlier find is left out. Repeats are bounded or possessive, so searches are linear.
PATTERNS = {
    # The whole value: up to the closing quote, or else up to white space or a delimiter. Possessive, so linear.
    "secret": re.compile(
        rf"(?i:{_SECRETS})[\"']?[ \t]{{0,3}}[=:][ \t]{{0,3}}"
        r"(?:\"((?:[^\"\\\n]|\\.){8,}+)\"|'((?:[^'\\\n]|\\.){8,}+)'|[\"']?([^\s\"'`<>,;&]{8,}+))"
    ),
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ip": re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])"),
    # Tried at colons, of which texts have few; what it finds is parsed as an address.
    "ipv6": re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.[0-9])"),
    "card": re.compile(r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "phone": re.compile(
        r"(?<![\w+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}"
        r"|\+[0-9](?:[ .()-]{0,2}[0-9]){7,14})(?!\w)"
    ),
    "name": re.compile(rf"(?<!\w)(?:({_TITLES})\.?|(?:{_NAMES}) ?:)(?= [^\W\d_])"),
}
_NAME_WORD = re.compile(r" ([^\W\d_][\w'’-]{1,40})")
_ANY_WORD = re.compile(r"(?<!\w)[^\W\d_][\w'’-]{1,40}")
# The surname 谢 also ends words of thanks, such as 感谢.
_HAN_NAME = re.compile(rf"{_LABEL_HAN}[:：] ?([一-鿿]{{2,4}})|((?:(?<![感多答致])|(?!谢))[{_FAMILIES}][一-鿿]{{1,2}}?)(?=({'|'.join(_AFTER)}))")
# A text with a value matches this; Spark tests it before any Python runs.
POSSIBLE = rf"[0-9@]|::|(?:{_TITLES}|{_NAMES}|{'|'.join(_AFTER)}|{_LABEL_HAN})|(?i:{_SECRETS})"

_LATIN = ("ba be bo da de do fa fe ga go ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti to va ve vi", "l n r s", "a ia ina", "o an us", "e en is")
_CYRILLIC = ("ба бе бо да де до га го ка ке ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се та те ти то ва ве ви", "л н р с", "а ия ина", "о ан ус", "е ен ис")
_GREEK = ("βα βε βο δα δε δο γα γο κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε τα τε τι το", "λ ν ρ μ", "α ια ινα", "ο αν ος", "ε εν ις")
_ARMENIAN = ("բա բե բո դա դե դո գա գո կա կե կո լա լե լի լո մա մե մի մո նա նե նի նո պա պե րա րե րի րո սա սե տա տե տի տո", "լ ն ր մ", "ա իա ինա", "ո ան ուս", "ե են իս")
_ARABIC = ("با بو دا دو را رو سا سو فا فو كا كو لا لو ما مو نا نو تا تو", "ل ن ر م", "اء ة ى", "د ق ح", "ي ين ان")
_HAN_GIVEN = {"m": "伟强军磊勇杰涛超明刚平辉鹏华飞鑫波斌宇浩", "f": "芳娜敏静丽艳娟霞秀玲桂英慧红梅莉燕雪琳倩", "": "文安宁晨乐思清和青云星海林佳嘉瑞天子一立"}
_SCRIPTS = (("[\u0600-\u06ff]", _ARABIC), ("[Ѐ-ӿ]", _CYRILLIC), ("[Ͱ-Ͽἀ-῿]", _GREEK), ("[԰-֏]", _ARMENIAN))


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    type: str
    value: str
    gender: str = ""


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> int:
    """Luhn sum modulo 10; 0 for a valid number."""
    doubled = (sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return sum(doubled) % 10


def _iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def national(found: str) -> str:
    """Digits of a telephone number without country code and leading zeros, so that both ways of writing it agree."""
    digits = _digits(found)
    abroad = found.startswith("+") or digits.startswith("00")
    rest = digits.removeprefix("00") if not found.startswith("+") else digits
    if abroad:
        rest = rest[1 if rest[:1] in ("1", "7") else 2 if rest[:2] in _TWO_DIGITS else 3 :]
    elif len(rest) == 11 and rest[0] == "1":
        rest = rest[1:]
    return rest.lstrip("0") or digits


def _ipv6(found: str) -> str | None:
    """The address in lower case; None for what only looks like one, such as a time or a name with colons."""
    try:
        ipaddress.IPv6Address(found)
    except ValueError:
        return None
    groups = [g for g in found.split(":") if g]
    return found.lower() if len(groups) > 2 and any(c.isdigit() for c in found) else None


def _bare(word: str) -> str:
    return word.rstrip("'’-").removesuffix("'s").removesuffix("’s")


def _value(kind: str, found: str) -> str | None:
    """What two ways of writing a value have in common; None where it is no such value."""
    if kind == "email":
        return found.rstrip("-").lower()
    if kind == "ip":
        return None if any(int(x) > 255 for x in found.split(".")) else found
    if kind == "ipv6":
        return _ipv6(found)
    if kind == "iban":
        value = found.replace(" ", "")
        return value if 15 <= len(value) <= 34 and _iban_check(value[:2], value[4:]) == value[2:4] else None
    if kind in ("card", "ssn"):
        return _digits(found)
    if kind == "phone":
        return national(found) if 9 <= len(_digits(found)) <= 15 else None
    return found


def detect(text: str) -> list[Mention]:
    """Values in a text by position, none overlapping.

    A name is a run of up to three capitalized words behind a title or "Name:", each a value of its own and the last a surname;
    in Arabic, which has no capitals, one word; in Chinese, characters behind the label, or a frequent surname and one or two
    more before a title. Words found so are names wherever the text has them with a capital, also where they mean
    something else. Ten digits in a row are no telephone number without a +. Takes time linear in the text but for sorting.
    """
    taken: list[Mention] = []
    starts: list[int] = []
    ends: list[int] = []

    def free(a: int, b: int) -> bool:
        at = bisect_right(starts, a)
        return (at == 0 or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at])

    def keep(found: list[tuple[int, int]]) -> None:
        spans = sorted([*zip(starts, ends), *found])
        starts[:], ends[:] = [a for a, _ in spans], [b for _, b in spans]

    for kind, pattern in PATTERNS.items():
        spans: list[tuple[int, int]] = []
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex) if kind == "secret" else m.span()
            if kind == "secret" and m.lastindex == 3:
                b = a + len(text[a:b].rstrip(".:)]}"))  # of the sentence around it
                if b - a < 8:
                    continue
            if not free(a, b) or spans and a < spans[-1][1]:
                continue
            if kind == "name":
                words = []
                while len(words) < 3 and (w := _NAME_WORD.match(text, b)) and not w[1][0].islower() and w[1] not in _GENDER and free(*w.span(1)):
                    words.append((w.start(1), _bare(w[1])))
                    b = w.end()
                    if not w[1][0].isupper():
                        break
                gender = _GENDER.get(m[1], "n").replace("n", "")
                for at, w in words:
                    taken.append(Mention(at, at + len(w), *(("surname", w.lower()) if at == words[-1][0] else ("given", w.lower(), gender))))
                if words:
                    spans.append((a, b))
                continue
            value = _value(kind, text[a:b])
            if value is None:
                continue
            if kind == "email":
                b = a + len(value)
            spans.append((a, b))
            taken.append(Mention(a, b, kind, value))
        keep(spans)
    names = {m.value: m.type for m in reversed(taken) if m.type in ("given", "surname")}
    again = []
    for m in _ANY_WORD.finditer(text) if names else ():
        word = _bare(m[0])
        if word.lower() in names and not word[0].islower() and free(m.start(), m.start() + len(word)):
            again.append(Mention(m.start(), m.start() + len(word), names[word.lower()], word.lower()))
    keep([(m.start, m.end) for m in again])
    for m in _HAN_NAME.finditer(text):
        a, b = m.span(1 if m[1] else 2)
        if free(a, b):
            again.append(Mention(a, b, "han_name", text[a:b], _AFTER.get(m[3], "n").replace("n", "")))
    return sorted(taken + again, key=lambda x: x.start)


class Stream:
    """Numbers that follow from a key and a value."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.name, self.block, self.left = key, "\0".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            self.left = hmac.new(self.key, self.block.to_bytes(4, "big") + self.name, hashlib.sha256).digest()
            self.block += 1
        number, self.left = int.from_bytes(self.left[:8], "big"), self.left[8:]
        return number % n

    def alike(self, text: str, digits: str = "0123456789") -> str:
        out = []
        for c in text:
            kinds = (digits if c in digits else "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
            kind = next((k for k in kinds if c in k), c)
            out.append(kind[self.below(len(kind))])
        return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0, domain: str | None = None, gender: str | None = "") -> str:
    """Replacement of a value, in the value's own form; of an e-mail with the given new domain, if any; of a name by gender."""
    s = Stream(key, kind, value, attempt)
    more = "a" * max(0, attempt - WIDER + 1)
    if kind == "domain":
        *labels, top = value.split(".")
        return f"{Stream(key, 'domain', *labels, *[attempt] * (attempt > 0)).alike('.'.join(labels) + more)}.{top}"
    if kind == "email":
        local, old = value.split("@")
        return f"{s.alike(local + more)}@{domain or surrogate(key, 'domain', old)}"
    if kind == "secret":
        for hexadecimal in ("0123456789abcdef", "0123456789ABCDEF"):
            if set(value) <= set(hexadecimal):
                return "".join(hexadecimal[s.below(16)] for _ in value)
        # Letters that alike() leaves become Latin ones; after some draws signs become letters too, and more are added.
        plain = "".join(c if c.isascii() and (c.isalnum() or attempt < WIDER) else "A" if c.isupper() else "a" for c in value)
        return s.alike(plain + "a" * max(0, attempt - WIDER))
    if kind == "iban":
        account = s.alike(value[4:])
        return value[:2] + _iban_check(value[:2], account) + account
    if kind == "ip":
        parts = [int(x) for x in value.split(".")]
        kept = 1 if parts[0] in (10, 127) else 2 if parts[:2] == [192, 168] or parts[0] == 172 and 16 <= parts[1] < 32 else 0
        if attempt >= WIDER:
            if kept == 2 and attempt >= 4 * WIDER:  # other private ranges: the own one may be full
                return ".".join(["10", *(str(s.below(256)) for _ in range(3))])
            return ".".join([*value.split(".")[:kept], *(str((1 if not kept and k == 0 else 0) + s.below(223 if not kept and k == 0 else 256)) for k in range(4 - kept))])
        bounds = {1: (0, 9), 2: (10, 99), 3: (100, 254)}
        new = [str(lo + s.below(hi - lo + 1)) for lo, hi in (bounds[len(x)] for x in value.split(".")[kept:])]
        return ".".join([*value.split(".")[:kept], *new])
    if kind == "card":
        new = value[0] + s.alike(value[1:-1])
        return next(new + d for d in "0123456789" if luhn(new + d) == luhn(value))
    if kind == "ssn":
        return f"{1 + s.below(665):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}"
    if kind == "phone":
        return str(2 + s.below(8)) + s.alike(value[1:])
    if kind == "ipv6":
        # Groups keep their lengths, so "::" stays where it is; local prefixes stay.
        kept = value[:1] == "f" and re.match(r"fe[89ab][0-9a-f]:|f[cd][0-9a-f]{2}:", value)
        head = kept[0] if kept else ""
        body = [g and "123456789abcdef"[s.below(15)] + "".join("0123456789abcdef"[s.below(16)] for _ in g[1:]) for g in value[len(head) :].split(":")]
        if attempt >= WIDER:  # short groups become full ones
            body = [g and f"{g}{s.below(1 << 16):04x}"[-4:].replace("0000", "0001") for g in body]
        return head + ":".join(body)
    if kind == "han_name":
        given = _HAN_GIVEN[gender or ""]
        return _FAMILIES[s.below(len(_FAMILIES))] + "".join(given[s.below(len(given))] for _ in range(len(value) - 1 + attempt // WIDER))
    syllables, middle, female, male, neutral = next((x for script, x in _SCRIPTS if re.search(script, value)), _LATIN)
    ending = {"f": female, "m": male}.get(gender or "", neutral) if kind == "given" else neutral
    # More attempts make longer names, so there is always one left.
    stem = [syllables.split()[s.below(len(syllables.split()))] for _ in range(2 + s.below(2) + attempt // 2)]
    return "".join(stem) + middle.split()[s.below(4)] + ending.split()[s.below(len(ending.split()))]


def dressed(found: str, kind: str, new: str) -> str:
    """The replacement as the found text is written: separators, capitals."""
    if kind in ("phone", "card", "ssn", "iban"):
        # Of a telephone number the last digits are the value; country code and leading zero stay.
        kept = sum(c.isalnum() for c in found) - len(new)
        letters = iter([c for c in found if c.isalnum()][:kept] + list(new))
        return "".join(next(letters) if c.isalnum() else c for c in found)
    if kind == "ipv6":
        return new.upper() if found.isupper() else new
    if kind == "email":
        parts = zip(found.split("@"), new.split("@"))  # either part may have become longer
        return "@".join("".join(n.upper() if f.isupper() else n for f, n in zip(old.ljust(len(x)), x)) for old, x in parts)
    if kind in ("given", "surname"):
        return new.upper() if found.isupper() and len(found) > 1 else new.capitalize()
    return new


def replaced(text: str, found: Sequence[tuple[int, int, str, str]]) -> str:
    """Text with (start, end, type, replacement) put in."""
    out, at = [], 0
    for start, end, kind, new in sorted(found):
        out += text[at:start], dressed(text[start:end], kind, new)
        at = end
    return "".join([*out, text[at:]])


def surrogate_table(values: DataFrame, key: bytes) -> DataFrame:
    """``type``, ``value`` and ``surrogate`` of values, without collisions; mail domains are drawn first, as values.

    Values may have a ``gender`` ('m', 'f' or ''), and may come once with each. No values give no rows.
    """
    if "gender" not in values.columns:
        values = values.withColumn("gender", F.lit(""))
    of = {g: F.max(F.col("gender") == g) for g in "mf"}
    either = F.when(of["m"] & ~of["f"], "m").when(of["f"] & ~of["m"], "f").otherwise("")
    values = materialize(values.groupBy("type", "value").agg(either.alias("gender")), "values-with-gender")
    domain = F.when(F.col("type") == "email", F.substring_index("value", "@", -1))
    domains = values.select(F.lit("domain").alias("type"), domain.alias("value"), F.lit(None).cast("string").alias("domain"), F.lit("").alias("gender"))
    new = _drawn(domains.where("value IS NOT NULL").distinct(), key).select(F.col("value").alias("old"), F.col("surrogate").alias("domain"))
    with_domain = values.select("type", "value", "gender", domain.alias("old")).join(new, "old", "left").select("type", "value", "domain", "gender")
    return _drawn(materialize(with_domain, "values-with-domains"), key)


def _drawn(values: DataFrame, key: bytes) -> DataFrame:
    """A value (``type``, ``value``, ``domain``, ``gender``) is drawn again while its surrogate is a value of the corpus or another has it.

    Of several that draw the same, the one with the fewest draws keeps it, then the least; later draws are wider, see ``surrogate``."""

    @F.pandas_udf("string")
    def drawn(kinds: pd.Series, texts: pd.Series, attempts: pd.Series, domains: pd.Series, genders: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, *x) for x in zip(kinds, texts, attempts, domains, genders)], dtype="object")

    state = values.select("type", "value", "domain", "gender", F.lit(0).alias("attempt"))
    real = values.select("type", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
    for _ in range(MAX_ROUNDS):
        state = materialize(state.withColumn("surrogate", drawn("type", "value", "attempt", "domain", "gender")), "surrogates")
        first = state.groupBy("type", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("first"))
        checked = state.join(first, ["type", "surrogate"]).join(real, ["type", "surrogate"], "left")
        lost = checked.withColumn("lost", F.col("real").isNotNull() | (F.col("value") != F.col("first.value")))
        if lost.where("lost").limit(1).count() == 0:
            return state.drop("attempt", "domain", "gender")
        state = lost.select("type", "value", "domain", "gender", (F.col("attempt") + F.col("lost").cast("int")).alias("attempt"))
    raise RuntimeError(f"values and surrogates still collide after {MAX_ROUNDS} draws")


def with_surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the text with all values replaced, and ``n_replaced``, of every row.

    Texts that are null or empty or hold no value stay as they are, an empty table gives an empty one. Rows stay, repeated ones
    and null ids included; equal values get equal replacements, so repeated rows stay equal. Texts of any length are searched
    whole. ``key`` decides the replacements; without it they can't be traced back.
    """

    @F.pandas_udf("array<struct<start:int,end:int,type:string,value:string,gender:string>>")
    def mentions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[vars(m) for m in detect(t)] for t in texts])

    @F.pandas_udf("string")
    def put(texts: pd.Series, found: pd.Series) -> pd.Series:
        rows = [replaced(t, [(m["start"], m["end"], m["type"], m["surrogate"]) for m in f]) for t, f in zip(texts, found)]
        return pd.Series(rows, dtype="object")

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    possible = F.coalesce(F.rlike("text", F.lit(POSSIBLE)), F.lit(False))
    # Written once, so that rows keep their numbers and texts are searched once.
    some = slim.where(possible).select("id", "text", F.monotonically_increasing_id().alias("row"), mentions("text").alias("found"))
    some = materialize(some, "texts-with-values")
    each = some.select("row", F.inline("found"))
    table = surrogate_table(each.select("type", "value", "gender"), key)
    by_row = each.join(table, ["type", "value"]).groupBy("row").agg(F.collect_list(F.struct("start", "end", "type", "surrogate")).alias("new"))
    hit = some.where("size(found) > 0").join(by_row, "row").select("id", put("text", "new").alias("text"), F.size("new").cast("bigint").alias("n_replaced"))
    plain = some.where("size(found) = 0").select("id", "text", F.lit(0).cast("bigint").alias("n_replaced"))
    rest = slim.where(~possible).select("id", "text", F.lit(0).cast("bigint").alias("n_replaced"))
    return stacked(rest, plain, hit).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_replaced")
