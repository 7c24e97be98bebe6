"""Surrogates for personal data: keyed, type-consistent replacements.

A surrogate is made by a keyed permutation of the strings of the original's own format: the same kind,
the same punctuation, and for each letter or digit one of the same script and case. A permutation keeps
distinct entities distinct and gives an entity the same surrogate wherever it occurs, without a table;
it is conjugate to a shift, so nothing maps to itself. Given names are permuted within the names of
their script and gender.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import as_before

#: Alphabets by script and case, given names by script and gender, forms of address by gender.
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöùúûüý",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Carmen Claire Elena Emma Eva Grace Hannah Helen Ines Jane Julia Laura Lucy Maria Marie Martha Monika Nina Paula Petra Rosa Ruth Sarah Sofia Susan Teresa Ursula".split(),
    ("latin", "m"): "Adam Albert Andrew Anton Carlos Charles Daniel David Edward Felix George Hans Henry Hugo Jacques James John Jorge Karl Louis Luis Martin Miguel Otto Paul Peter Pierre Robert Thomas Walter".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Софья Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Иван Михаил Николай Олег Павел Сергей".split(),
    ("greek", "f"): "Άννα Βασιλική Ειρήνη Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Ιωάννης Κώστας Νίκος Πέτρος".split(),
}
ADDRESS = {"f": "Mrs Ms Miss Mme Madame Frau Señora Sra г-жа Κυρία MRS MADAME FRAU SEÑORA".split(), "m": "Mr Monsieur Herr Señor Sr г-н Κύριος MR MONSIEUR HERR SEÑOR".split(), "": "Dr Prof PROF".split()}
#: Country calling codes of one and two digits; all others have three.
CALLING = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

CLASS = {c: a for a in ALPHABETS for c in a}
GENDER = {word: g for g, ws in ADDRESS.items() for word in ws}
NAMES = {name: group for group, names in GIVEN.items() for name in names}
#: Words that begin a sentence after an initial rather than go on with the name.
STARTERS = set("A After And As At But By For From He Her His I If In It My No On Our She So That The Then They This To We What When You Aber Als Auch Da Dann Das Der Die Ein Eine Er Es Ich Im In Sie Und Wenn Wir Après Ce Elle En Et Il Je La Le Les Mais Nous On Puis Un Une Vous Cuando Después El Ella En Es Este Los Luego Las Mi No Pero Por Su Un Una Y Yo".split())

EMAIL = re.compile(r"[\w.+-]*\w@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_SEP = r"[ ./-]?"
#: Phones: North American after +1, any international form, national forms with a leading zero, North
#: American and Spanish ones without. Dates, social-security numbers and card groups are no national forms.
_PHONES = (
    r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    rf"(?<!\w)\+(?!\d{{1,3}}\.\d{{1,8}}(?!\d|\.\d))[1-9](?:{_SEP}\(?\d\)?){{6,14}}(?!\d|\.\d)",
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\d|\.\d)",
    r"(?<![\d)])\(\d{3}\) ?\d{3}[ .-]?\d{4}(?!\d)",
    rf"(?<![\w)])\(0\d{{1,4}}\)(?:{_SEP}\d){{5,9}}(?!\w|\.\d)",
    rf"(?<![\w.,+/-])(?!\d\d?[./-]\d\d[./-]\d{{4}}(?!\d)|\d{{3}}-\d{{2}}-\d{{4}}(?!\d)|\d{{4}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d|\d{{13}})0(?:0[1-9](?:{_SEP}\d){{8,13}}|[1-9](?:{_SEP}\d){{7,10}})(?!\w|\.\d)",
    r"(?<![\d.-])(?:1[ .-])?\d{3}(?:[-.]\d{3}[-.]| \d{3}[ -])\d{4}(?![\d-])",
    r"(?<![\w.,+/-])(?<!\d )[6-9]\d{2}(?P<cut>[ -])(?:\d{3}(?P=cut)\d{3}|\d{2}(?P=cut)\d{2}(?P=cut)\d{2})(?![\w-]|\.\d| \d)",
)
NUMBER = re.compile(
    rf"(?P<phone>{'|'.join(_PHONES)})"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.-])\d{4}(?P<gap>[ -])(?:\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{6}(?P=gap)\d{4,5})(?!\d)|(?<![\d.\w])\d{13,19}(?![\d\w]))"
)
#: IPv6 addresses: eight groups, or fewer around one double colon; checked when found.
IPV6 = re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\d)")
#: International bank account numbers, together or in groups of four; their check digits must be right.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
SECRET = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9+/_-]{8,})")
KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<key>[A-Z2-7]{16}|[A-Z0-9]{16})(?![A-Za-z0-9])")
_UPPER = f"[{''.join(c for c in map(chr, range(0x41, 0x590)) if c.isupper())}]"
_LETTER = r"[^\W\d_]"
_ADDRESS = "|".join(map(re.escape, GENDER))
#: A part of a name: hyphens, inner capitals and apostrophes before one; or an initial.
PART = re.compile(rf"(?!(?:{_ADDRESS})(?!\w))(?:{_UPPER}(?:{_LETTER}*(?:-{_LETTER}+|['’]{_UPPER}{_LETTER}+)+|{_LETTER}+)|{_UPPER}(?=\.))")
_PARTICLE = r"(?:van|von|der|den|de|del|della|di|da|dos|das|la|le|du|zu|ter|bin|y)[ \t]+"
_CUE = r"[Nn]ame(?: is| ist|:)|[Nn]ombre es|[Mm]e llamo|[Nn]om est|m['’]appelle"
NAME = re.compile(rf"(?<!\w)(?:(?P<address>{_ADDRESS})\.?|{_CUE})[ \t]+(?P<names>(?:{_PARTICLE}){{0,3}}{PART.pattern}(?:(?:(?<=[ .]{_UPPER})\.[ \t]*|[ \t]+)(?:{_PARTICLE}){{0,3}}{PART.pattern}){{0,4}})")


#: What a text must hold for the costlier patterns to be worth a try.
DIGITS = re.compile(r"\d[\d).-]")
_HELD = (*GENDER, "ame is", "ame:", "ombre es", "e llamo", "om est", "appelle")
HINTS = tuple(sorted(w for w in _HELD if not any(w != v and v in w for v in _HELD)))


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str | None:
    """The characters that ``c`` may become: its listed alphabet, else the letters of its row of 128 code points that
    are of its category and in no listed alphabet; None for what is no letter or digit."""
    if c in CLASS or not c.isalpha():
        return CLASS.get(c)
    row, kind = ord(c) & ~127, unicodedata.category(c)
    return "".join(x for x in map(chr, range(row, row + 128)) if unicodedata.category(x) == kind and x not in CLASS)


def titled(name: str) -> str:
    """A name with a capital first letter and the others small, as far as a letter has the other case as one letter."""
    small = "".join(c.lower() if len(c.lower()) == 1 else c for c in name[1:])
    return (name[:1].upper() if len(name[:1].upper()) == 1 else name[:1]) + small


class Cipher:
    """Keyed permutations of the whole numbers below any n."""

    ROUNDS = 8

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is required")
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, tweak: bytes, turn: int, half: int, bits: int) -> int:
        h = hashlib.blake2b(tweak + bytes([turn]) + half.to_bytes((bits + 7) // 8, "big"), key=self.key, digest_size=max(1, min(64, (bits + 7) // 8)))
        return int.from_bytes(h.digest(), "big") & ((1 << bits) - 1) if bits <= 512 else int.from_bytes(hashlib.shake_256(h.digest()).digest((bits + 7) // 8), "big") & ((1 << bits) - 1)

    def _feistel(self, x: int, n: int, tweak: bytes, turns) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:  # walk the cycle until the value is below n
            left, right = x >> bits, x & mask
            if turns.step > 0:
                for t in turns:
                    left, right = right, left ^ self._f(tweak, t, right, bits)
            else:
                for t in turns:
                    left, right = right ^ self._f(tweak, t, left, bits), left
            x = left << bits | right
            if x < n:
                return x

    def derange(self, x: int, n: int, tweak: bytes) -> int:
        """A permutation of range(n) without fixed points, for n over 1."""
        y = (self._feistel(x, n, tweak, range(self.ROUNDS)) + 1) % n
        return self._feistel(y, n, tweak, range(self.ROUNDS - 1, -1, -1))

    def string(self, s: str, kind: str, alphabets: list[str | None] | None = None) -> str:
        """A string of the same shape: each character of a known alphabet becomes one of that alphabet."""
        sets = [alphabet(c) for c in s] if alphabets is None else alphabets
        x, n = 0, 1
        for c, a in zip(s, sets):
            if a:
                x, n = x * len(a) + a.index(c), n * len(a)
        if n < 2:
            return s
        shape = "".join(c if not a else chr(0xE000 + len(a) % 997) + a[0] for c, a in zip(s, sets))
        y, out = self.derange(x, n, f"{kind}|{shape}".encode("utf-8", "replace")), []
        for c, a in zip(reversed(s), reversed(sets)):
            if a:
                y, k = divmod(y, len(a))
                c = a[k]
            out.append(c)
        return "".join(reversed(out))


@dataclass(frozen=True)
class Entity:
    """A span of a text, its kind, and the canonical form that says which spans are the same entity."""

    start: int
    end: int
    kind: str
    canonical: str


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(compact: str) -> int:
    """The remainder of an account number with its first four characters last, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def _is_ipv6(s: str) -> bool:
    """Whether a find of IPV6 is an address of three groups at least with a digit, not a time or a path of names."""
    groups = [g for g in s.split(":") if g]
    return 3 <= len(groups) <= 8 and ("::" in s) != (len(groups) == 8) and any(c.isdigit() for c in s)


def _phone_canonical(form: str) -> str:
    """Digits that are the same however a number is written: international ones without + or 00, North
    American ones with their 1; after ~ what belongs to no known country."""
    digits = re.sub(r"\D", "", form)
    if form.lstrip().startswith("+"):
        return digits
    if digits.startswith("00"):
        return digits[2:]
    if digits[0] == "0" or len(digits) == 11 and digits[0] == "1":
        return digits
    return "1" + digits if len(digits) == 10 else "~" + digits


def detect(text: str) -> list[Entity]:
    """Entities of a text, leftmost first, none inside another. Empty text has none.

    A name that an address or a cue told of is an entity wherever its parts stand in the text as words.
    """
    found: list[Entity] = []
    if "@" in text:
        found += [Entity(*m.span(), "email", m.group().lower()) for m in EMAIL.finditer(text)]
    if DIGITS.search(text):
        for m in NUMBER.finditer(text):
            kind = next(k for k in ("phone", "ip", "ssn", "card") if m.group(k))
            found.append(Entity(*m.span(), kind, m.group() if kind == "ip" else _phone_canonical(m.group()) if kind == "phone" else re.sub(r"\D", "", m.group())))
        found += [Entity(*m.span(), "iban", c) for m in IBAN.finditer(text) if _mod97(c := m.group().replace(" ", "")) == 1]
    if text.count(":") > 1:
        found += [Entity(*m.span(), "ipv6", m.group().lower()) for m in IPV6.finditer(text) if _is_ipv6(m.group())]
    if "=" in text or ":" in text:
        found += [Entity(*m.span("secret"), "secret", m.group("secret")) for m in SECRET.finditer(text)]
    if "AKIA" in text or "ASIA" in text:
        found += [Entity(*m.span("key"), "key", m.group("key")) for m in KEY.finditer(text)]
    names: set[str] = set()
    for m in NAME.finditer(text) if any(h in text for h in HINTS) else ():
        initial = False
        for part in PART.finditer(text, m.start("names"), m.end("names")):
            if initial and part.group() in STARTERS:
                break
            initial = len(part.group()) == 1
            found.append(_name(part.group(), *part.span()))
            names.add(part.group())
    # a part that the text also has as a common word, in lower case, is a name after its cue alone
    names = {n for n in names if len(n) > 1 and not re.search(rf"(?<!\w){re.escape(n.lower())}(?!\w)", text)}
    names |= {n.upper() for n in names}
    if names:
        again = re.compile(rf"(?<![\w-])(?:{'|'.join(map(re.escape, sorted(names, key=lambda n: (-len(n), n))))})(?![\w-])")
        found += [_name(m.group(), *m.span()) for m in again.finditer(text)]
    kept: list[Entity] = []
    order = {"email": 0, "secret": 1, "key": 2, "iban": 3, "ipv6": 4}
    for e in sorted(found, key=lambda e: (e.start, order.get(e.kind, 5), -e.end)):
        if not kept or e.start >= kept[-1].end:
            kept.append(e)
    return kept


def _name(form: str, start: int, end: int) -> Entity:
    """All forms of a name that differ in case are one entity."""
    name = titled(form)
    return Entity(start, end, "given" if name in NAMES else "family", name)


def _ip(canonical: str, cipher: Cipher) -> str:
    x = 0
    for octet in canonical.split("."):
        x = x << 8 | int(octet)
    y = cipher.derange(x, 1 << 32, b"ip")
    return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))


def _given(name: str, cipher: Cipher) -> str:
    group = NAMES[name]
    names = GIVEN[group]
    return names[cipher.derange(names.index(name), len(names), f"given|{group}".encode())]


def _family(name: str, cipher: Cipher) -> str:
    """A name of the same letters' alphabets that is no listed given name. The permutation is one cycle, so walking
    on past listed names stays a permutation without fixed points of the others."""
    out = cipher.string(name, "family")
    while out in NAMES:
        out = cipher.string(out, "family")
    if out != name:
        return out
    # no alphabet covers it
    return cipher.string("".join(chr(97 + int(c, 16)) for c in hashlib.blake2b(name.encode(), key=cipher.key, digest_size=6).hexdigest()), "masked").title()


def _card(digits: str, cipher: Cipher) -> str:
    head = cipher.string(digits[:-1], "card")
    return head + str((_luhn(head) + int(digits[-1]) - _luhn(digits[:-1])) % 10)


def _hex(s: str, cipher: Cipher, kind: str) -> str:
    if re.fullmatch(r"[0-9a-f]+", s) or re.fullmatch(r"[0-9A-F]+", s):
        digits = "0123456789abcdef" if s == s.lower() else "0123456789ABCDEF"
        return cipher.string(s, kind + "hex", [digits] * len(s))
    return cipher.string(s, kind)


def _key(s: str, cipher: Cipher) -> str:
    return cipher.string(s, "key", ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" if re.fullmatch("[A-Z2-7]+", s) else "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"] * len(s))


def _email(s: str, cipher: Cipher) -> str:
    stem, _, top = s.rpartition(".")
    return f"{cipher.string(stem, 'email|' + top)}.{top}"


#: Digits that an area code or an exchange of a North American number, or any number after its prefix, begins with.
_TWO_UP, _ONE_UP, _ANY = "23456789", "123456789", "0123456789"


def _phone(digits: str, cipher: Cipher) -> str:
    """A number of the same plan: the country code or the leading zero stays, and a digit that a plan wants
    above 1 or above 0 stays so, if it was."""
    if digits[0] in "0~":
        code = 2 if digits[0] == "~" else 1
    else:
        code = 1 if digits[0] in CALLING else 2 if digits[:2] in CALLING else 3
    sets: list[str | None] = [None] * code + [_ANY] * (len(digits) - code)
    for at in (1, 4) if digits[0] == "1" and len(digits) == 11 else (code,):
        if at < len(digits):
            sets[at] = next((a for a in ((_TWO_UP, _ONE_UP) if digits[0] == "1" else (_ONE_UP,)) if digits[at] in a), _ANY)
    return cipher.string(digits, "phone", sets)


def _iban(s: str, cipher: Cipher) -> str:
    """An account of the same country and shape with right check digits."""
    rest = cipher.string(s[4:], "iban|" + s[:2], [_ANY if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in s[4:]])
    return f"{s[:2]}{98 - _mod97(s[:2] + '00' + rest):02d}{rest}"


def _ipv6(s: str, cipher: Cipher) -> str:
    """An address of the same groups; their first digits stay above 0, if they were."""
    first = lambda i: i == 0 or s[i - 1] == ":"
    return cipher.string(s, "ipv6", [None if c == ":" else "123456789abcdef" if first(i) and c != "0" else "0123456789abcdef" for i, c in enumerate(s)])


MAKERS: dict[str, Callable[[str, Cipher], str]] = {
    "email": _email,
    "phone": _phone,
    "ip": _ip,
    "ipv6": _ipv6,
    "iban": _iban,
    "ssn": lambda s, c: c.string(s, "ssn"),
    "card": _card,
    "secret": lambda s, c: _hex(s, c, "secret"),
    "key": _key,
    "given": _given,
    "family": _family,
}


def surrogate(kind: str, canonical: str, cipher: Cipher) -> str:
    """The canonical surrogate of an entity's canonical form."""
    return MAKERS[kind](canonical, cipher)


def _fit(form: str, canonical: str, kind: str) -> str:
    """A canonical surrogate in the format of the occurrence ``form``."""
    if kind == "phone":
        n, canonical = sum(c.isdigit() for c in form), canonical.removeprefix("~")
        canonical = "00" + canonical if n == len(canonical) + 2 else canonical[len(canonical) - n :]
    if kind in ("phone", "ssn", "card"):
        digits = iter(canonical)
        return "".join(next(digits) if c.isdigit() else c for c in form)
    if kind == "iban":
        chars = iter(canonical)
        return "".join(c if c == " " else next(chars) for c in form)
    if kind == "given" or kind == "family" and len(form) != len(canonical):
        return canonical.upper() if form.isupper() and len(form) > 1 else canonical
    if kind in ("email", "ipv6", "family"):  # the case of each letter is the form's
        return "".join(u if f != f.lower() and len(u := c.upper()) == 1 else c.lower() if kind == "family" and len(c.lower()) == 1 else c for f, c in zip(form, canonical, strict=True))
    return canonical


def rewrite(text: str, cipher: Cipher, cache: dict | None = None) -> tuple[str, list[Entity]]:
    """The text with its entities replaced, and the entities."""
    found = detect(text)
    if not found:
        return text, found
    out, at = [], 0
    cache = {} if cache is None else cache
    for e in found:
        new = cache.get((e.kind, e.canonical))
        if new is None:
            if len(cache) > 100_000:
                cache.clear()
            new = cache[e.kind, e.canonical] = surrogate(e.kind, e.canonical, cipher)
        out += [text[at : e.start], _fit(text[e.start : e.end], new, e.kind)]
        at = e.end
    return "".join(out) + text[at:], found


def _decoded(cell) -> str | None:
    return None if cell is None else bytes(cell).decode("utf-8", "replace")


def entities(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Distinct (kind, original, surrogate) of all texts, in canonical forms."""

    def find(batches):
        cipher = Cipher(key)
        for b in batches:
            pairs = {(e.kind, e.canonical) for cell in b["data"] if cell is not None for e in detect(_decoded(cell))}
            rows = [(k, c, surrogate(k, c, cipher)) for k, c in sorted(pairs)]
            yield pd.DataFrame(rows, columns=["kind", "original", "surrogate"])

    return docs.select(F.col(text).cast("binary").alias("data")).mapInPandas(find, "kind string, original string, surrogate string").distinct()


def collisions(found: DataFrame) -> DataFrame:
    """Rows (kind, surrogate, n) that break distinctness: several originals share a surrogate, or one is its own."""
    # given and family names share one space, whatever their case
    named = F.col("kind").isin("given", "family")
    one = found.select(F.when(named, "name").otherwise(F.col("kind")).alias("kind"), *[F.when(named, F.lower(c)).otherwise(F.col(c)).alias(c) for c in ("original", "surrogate")])
    return one.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("original") == F.col("surrogate")).cast("int")).alias("same")).where("n > 1 OR same = 1").select("kind", "surrogate", "n")


def check_collisions(docs: DataFrame, key: bytes, text: str = "text") -> None:
    """Raise if surrogates over all of ``docs`` are not distinct; only counts reach the driver."""
    bad = collisions(entities(docs, key, text)).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} surrogates collide; use another key")


def replace_entities(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_entities, kinds): every whole text with its personal data replaced.

    ``kinds`` lists the kinds found, with their counts, as ``kind=count`` in order of kind. A null
    text stays null without entities; texts without entities are unchanged; repeated rows stay; null
    doc_ids pass through; an empty table gives an empty one; other columns are not read, whatever their
    names. Very long texts are read whole, one at a time. Entities are e-mail addresses, phone numbers,
    IPv4 and IPv6 addresses, card, bank account and social-security numbers, access keys, assigned secrets,
    and names after a form of address or a cue as "name is", with all later and earlier mentions of their
    parts in the text. No shuffle.
    """

    def replace(batches):
        cipher, cache = Cipher(key), {}
        for b in batches:
            texts, counts, kinds = [], [], []
            for cell in b["data"]:
                new, found = rewrite(_decoded(cell), cipher, cache) if cell is not None else (None, [])
                n: dict[str, int] = {}
                for e in found:
                    n[e.kind] = n.get(e.kind, 0) + 1
                texts.append(new), counts.append(len(found)), kinds.append(",".join(f"{k}={n[k]}" for k in sorted(n)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts, "n_entities": counts, "kinds": kinds})

    done = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("binary").alias("data")).mapInPandas(replace, "doc_id string, text string, n_entities long, kinds string")
    return as_before(done, {"doc_id": docs.schema[doc_id].dataType})


def with_surrogates(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with its text column rewritten, all other columns kept; null texts stay null."""

    @F.pandas_udf("string")
    def new(column: pd.Series) -> pd.Series:
        cipher, cache = Cipher(key), {}
        return pd.Series([rewrite(_decoded(x), cipher, cache)[0] if x is not None else None for x in column], dtype="object")

    return docs.select(*[new(F.col(f"`{c}`").cast("binary")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
