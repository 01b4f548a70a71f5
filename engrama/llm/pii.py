"""PII surrogates: personal data and secrets give way to keyed stand-ins of the same type.

Detected: e-mail addresses, IPv4 and IPv6 addresses, phone numbers, payment card numbers,
IBANs, US social security numbers, tokens and other secrets, and names: after a form of
address, after a phrase such as "my name is", before an e-mail address in brackets, as the
document's e-mail addresses spell them (jane.doe@, then "Jane Doe"), a usual given name with
the word after it, and all other mentions, in title or upper case, of the parts of such a
name in the same document ("MR JOHN SMITH", then "Smith"). A number before it ("50 Mark") makes
a mention no name. Parts that only a usual given name tells of may be ordinary words: where the
document has one in lower case, or after an article or a number, it is replaced only next to
another part of a name.

What is replaced is resolved to *entities* first (`resolve`): a phone number is its
national digits, however they are grouped and with or without the country; a name is its
parts, whatever their case; an e-mail address is its local part and its domain. An
entity's surrogate is drawn from a generator keyed by the entity alone, so it is the same
in all documents, and laid into each mention's own format: digit groups, letter case,
country, check digits, kind of network, script, length class and ending of a name (the
ending of a usual given name says its gender).

Collisions are checked over the whole corpus: one pass collects the distinct entities,
one aggregation finds surrogates that two entities drew or that equal a real entity. The
later ones (by entity) draw again, until none is left; a format that gives no free value
in WIDEN draws gets longer, so this ends. The few entities that drew more than once are
joined back; a second pass rewrites the texts and needs no lookup for all others. Texts
are not shuffled while those few are few enough to broadcast (BROADCAST_ROWS).

The key comes from the caller or the setting KEY_SETTING; there is no default, since who
knows the key can tell which surrogate belongs to a guessed entity.

Not detected: names with neither of those signs anywhere in the document, names in scripts
without capitals, initials (they stay), other spellings of a part ("Kellers", nicknames).

Defined cases: a null text stays null; an empty text stays empty; equal rows get equal
results; very long texts are processed whole; extra columns are ignored by `replace`.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored

KEY_SETTING = "engrama.pii.key"
#: After so many draws without a free value a format gets longer.
WIDEN = 8
#: Tables of up to so many rows are one file and broadcast, larger ones are joined by a shuffle in SALTS parts.
BROADCAST_ROWS, SALTS = 200_000, 32

# Forms of address, phrases before a name, words between the parts of a name.
_ADDRESS = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Lady|Herrn|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señora|Señor|Sra|Sr|Doña|Don|Signora|Signor"
_CUES = ("y name is ", "Name: ", " name: ", "igned, ", "igned ", "uthor: ", "ch heiße ", "ein Name ist ", "e m'appelle ", "on nom est ", "e llamo ", "i nombre es ", "i chiamo ", "еня зовут ")  # some without the first letter, which may be of either case
# Words that a common noun, not a name, stands after; words that make the next one part of a name all the same.
_ARTICLES = frozenset("the a an this that these those der die das den dem des ein eine einen einem einer dieser diese dieses diesen kein keine einige viele manche im am zum zur vom beim la les un une ce cette ces el los las una unos unas il gli uno".split())
_BEFORE_ARTICLE = frozenset("von van de zu".split())
# What a phone number is called.
_PHONES = "telephone|telefono|telefon|teléfono|téléphone|tel|tél|phone|mobile|mobil|cell|handy|fax|móvil|movil|portable|rufnummer|телефон|тел"
_LINKS = "von|van|der|den|de|da|di|du|la|le|del|dos|zu"
# Usual given names, by gender.
FEMALE = frozenset(
    "Anna Maria Emma Olivia Sophia Mia Emily Sarah Laura Julia Lisa Katharina Sabine Claudia Petra Monika Ursula Heike Marie Camille Chloé Léa Manon Juliette Sylvie Isabelle Nathalie Carmen Lucía"
    " Sofía Elena Isabel Pilar Ana Cristina Giulia Chiara Francesca Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Nancy Margaret Ольга Анна Елена Мария Наталья Татьяна".split()
)
MALE = frozenset(
    "John James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew George Peter Hans Klaus Wolfgang Jürgen Stefan Andreas Lukas Jonas Felix"
    " Pierre Jean Michel Philippe Louis Nicolas Antoine José Juan Carlos Luis Miguel Javier Pedro Diego Marco Luca Giovanni Giuseppe Иван Пётр Сергей Алексей Дмитрий Владимир".split()
)
_GIVEN = {n.casefold(): g for g, names in (("f", FEMALE), ("m", MALE)) for n in names}

_UPPER, _LETTER = "A-ZÀ-ÖØ-ÞΑ-ΩА-Я", "A-Za-zÀ-ÖØ-öø-ÿΆ-ώА-яЁё"
_PART = rf"[{_UPPER}][{_LETTER}'’\-]*[{_LETTER}]"
_INITIAL = rf"(?:[{_UPPER}]\. ?)*"
_TITLE = rf"(?:{_ADDRESS}|{'|'.join(a.upper() for a in _ADDRESS.split('|'))})"
_REST = rf"(?:(?! {_TITLE}\b) {_INITIAL}(?:(?:{_LINKS}) )*{_PART}){{0,2}}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_ALPHA = "A-Za-zÀ-ɏͰ-ϿЀ-ӿ"
_EMAIL, _LABEL = _ALPHA + "0-9_%+\\-", _ALPHA + "0-9\\-"
#: Patterns for the neighbourhood of digits and of the characters @ : =, in order of precedence.
DETECTORS = (
    ("email", re.compile(rf"(?<![{_EMAIL}.])[{_EMAIL}](?:[{_EMAIL}.]*[{_EMAIL}])?@[{_LABEL}]+(?:\.[{_LABEL}]+)*\.(?:xn--[A-Za-z0-9\-]+|[{_ALPHA}]{{2,}})")),
    ("secret", re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_\- ]?key|access[_\- ]?key)\b\s*[:=]\s*[\"']?([A-Za-z0-9+/_\-]{8,}={0,2})")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:]|\.[0-9])")),
    ("ip", re.compile(rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])")),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{1,7}|[0-9]{13,19})(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}|[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4})|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5})(?![0-9])")),
    # with the trunk prefix: +49 (0)171 1234567, 0049 171 1234567, 0171 1234567, 030/1234567, 01 23 45 67 89
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3} ?\(0\) ?[0-9]{2,4}|00[1-9][0-9]{0,2}[ /.\-][0-9]{2,4})(?:[ /.\-]{1,3}[0-9]{2,8}){1,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.,/\-])(?:0[1-9][0-9]{1,4}(?: ?[/\-] ?| )[0-9]{2,8}(?:[ /\-][0-9]{2,5}){0,3}|0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4}))(?![0-9]|[.,][0-9])")),
    ("phone", re.compile(rf"(?i)(?<!\w)(?:{_PHONES})\b\.?(?: ?(?:no|nr|number|nummer|numéro|número)\b\.?)?\s{{0,3}}[:.]?\s{{0,3}}(\(?\+?[0-9][0-9 ()/.\-]{{5,20}}[0-9])(?![0-9])")),
)
_HINT = re.compile("[0-9@:=]+")
#: How far around a hint patterns look, beyond the next white space.
REACH = 48
_SPACE = re.compile(r"\s")
# no \b in front: what stands before is looked at afterwards, so the engine can skip by first letters
_ADDRESSED = re.compile(rf"{_TITLE}\.? {_INITIAL}((?:(?:{_LINKS}) )*{_PART}{_REST})")
_CUED = re.compile(rf"{_INITIAL}({_PART}{_REST})")
_PAIR = re.compile(rf"[{_UPPER}][{_LETTER}]+(?= {_INITIAL}(?:(?:{_LINKS}) )*[{_UPPER}][{_LETTER}])")
_AFTER = re.compile(rf"(?! {_TITLE}\b) {_INITIAL}(?:(?:{_LINKS}) )*{_PART}")
_BRACKETED = re.compile(rf"(?<![{_LETTER}])({_PART}{_REST}) ?[<(](?=[^<>()\s]{{1,100}}@)")
_LETTERS, _TOKEN = re.compile(rf"[{_ALPHA}]+"), re.compile(r"\w+")
_PIECE = re.compile(rf"[{_UPPER}][{_LETTER}'’]+")
KINDS = ("email", "secret", "card", "phone", "ip", "name", "iban", "ssn")


# -- mentions


def _valid(kind: str, text: str) -> bool:
    if kind == "iban":
        return _mod97(re.sub(" ", "", text)) == 1
    if kind == "ip" and ":" in text:
        try:
            return len(text) > 5 and ipaddress.IPv6Address(text).packed[:2] != b"\0\0"
        except ValueError:
            return False
    if kind == "phone":
        return (8 if text.startswith("0") else 7) <= len(_digits(text)) <= 15
    return not (kind == "ip" and text.startswith(("0.", "127.", "255.255.255.255")))  # no one's address


def _windows(text: str) -> list[tuple[int, int]]:
    """Apart and ascending (start, end) around the hints, up to white space."""
    near: list[list[int]] = []
    for m in _HINT.finditer(text):
        lo, hi = m.start() - REACH, m.end() + REACH
        if near and lo <= near[-1][1]:
            near[-1][1] = hi
        else:
            near.append([max(0, lo), hi])
    out: list[list[int]] = []
    for lo, hi in near:
        before = out[-1][1] if out else 0
        if hi <= before:
            continue
        gap = _SPACE.search(text, hi)
        lo = max(text.rfind(" ", before, lo), text.rfind("\n", before, lo), before)
        hi = gap.start() if gap else len(text)
        if out and lo <= before:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _insert(taken: list[tuple[int, int, str]], start: int, end: int, kind: str) -> None:
    at = bisect(taken, (start, end, ""))
    if not (at and taken[at - 1][1] > start) and not (at < len(taken) and taken[at][0] < end):
        taken.insert(at, (start, end, kind))


def _names(text: str, mails: list[str]) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether more than a usual given name tells of it). mails: the document's e-mail addresses."""
    for m in _ADDRESSED.finditer(text):
        if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")):
            yield *m.span(1), True
    for cue in _CUES:
        at = text.find(cue)
        while at >= 0:
            if m := _CUED.match(text, at + len(cue)):
                yield *m.span(1), True
            at = text.find(cue, at + len(cue))
    if mails:
        for m in _BRACKETED.finditer(text):
            yield *m.span(1), True
        locals_ = [_LETTERS.findall(mail.rpartition("@")[0].casefold()) for mail in mails]
        spelt = {(x, y) for words in locals_ for x, y in zip(words, words[1:], strict=False) if len(x) > 1 < len(y)}
        if spelt:
            words = list(_PIECE.finditer(text))
            for m, n in zip(words, words[1:], strict=False):
                if n.start() == m.end() + 1 and text[m.end()] == " " and (m[0].casefold(), _bare(n[0]).casefold()) in spelt:
                    yield m.start(), n.start() + len(_bare(n[0])), True
    for m in _PAIR.finditer(text):
        if m[0].casefold() in _GIVEN and not (m.start() and text[m.start() - 1].isalnum()) and (rest := _AFTER.match(text, m.end())):
            yield m.start(), rest.end(), False


def _ordinary(text: str, parts_of: set[str]) -> set[str]:
    """Those of the parts that the text uses as words: in lower case, or after an article or a number."""
    out, before, last = set(), "", ""
    for m in _TOKEN.finditer(text):
        word = m[0]
        if (low := word.casefold()) in parts_of and (word.islower() or last.isdigit() or (last.casefold() in _ARTICLES and before.casefold() not in _BEFORE_ARTICLE)):
            out.add(low)
        before, last = last, word
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the mentions in a text, ascending and apart; an earlier detector wins."""
    taken: list[tuple[int, int, str]] = []
    windows = _windows(text)
    for kind, pattern in DETECTORS if windows else ():
        group = 1 if pattern.groups else 0
        for lo, hi in windows:
            for m in pattern.finditer(text, lo, hi):
                if _valid(kind, m[group]):
                    _insert(taken, *m.span(group), kind)
    known: dict[str, bool] = {}  # part -> whether more than a usual given name tells of it
    mails = [text[a:b] for a, b, kind in taken if kind == "email"]
    for a, b, sure in _names(text, mails):
        if mine := parts(text[a:b]):
            _insert(taken, a, b, "name")
            for x, y in mine:
                part = text[a + x : a + y].casefold()
                known[part] = known.get(part, False) or sure
    if known:
        doubtful = {part for part, sure in known.items() if not sure}
        doubtful = _ordinary(text, doubtful) if doubtful else doubtful
        run: list = []  # neighbouring known parts are one mention: start, end, whether it is one
        for m in _PIECE.finditer(text):
            bare = _bare(m[0])
            if bare.casefold() not in known or (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")) or text[m.end() : m.end() + 1].isalnum():
                continue
            if run and m.start() == run[1] + 1 and text[run[1]] in " -":
                run[1:] = [m.start() + len(bare), True]
                continue
            if run and run[2]:
                _insert(taken, *run[:2], "name")
            counted = m.start() > 1 and text[m.start() - 1].isspace() and text[m.start() - 2].isdigit()
            run = [m.start(), m.start() + len(bare), bare.casefold() not in doubtful and not counted]
        if run and run[2]:
            _insert(taken, *run[:2], "name")
    return taken


def _bare(part: str) -> str:
    """Without a genitive's apostrophe."""
    return re.sub(r"(?<=.)['’]s?$", "", part)


def parts(name: str) -> list[tuple[int, int]]:
    """(start, end) of the parts of a name that are replaced: not initials, links and single letters."""
    return [(m.start(), m.start() + len(_bare(m[0]))) for m in _PIECE.finditer(name) if len(_bare(m[0])) > 1 and name[m.end() : m.end() + 1] != "."]


# -- entities


def _country(digits: str) -> int:
    """How many of the digits after a + are the country's: the public numbering plan's zones."""
    if digits[0] in "17":
        return 1
    two = {"20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", *map(str, range(43, 50)), *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98"}
    return 2 if digits[:2] in two else 3


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _national(text: str) -> tuple[int, str]:
    """(digits of the country and the trunk prefix, digits after them) of a phone number."""
    digits, head = _digits(text), 0
    if text.lstrip("(").startswith("+"):
        head = _country(digits)
    elif digits.startswith("00"):
        head = 2 + _country(digits[2:])
    return (head + 1, digits[head + 1 :]) if digits[head : head + 1] == "0" else (head, digits[head:])


def entities(kind: str, text: str) -> list[tuple[str, str]]:
    """The (kind, entity) that a mention is made of; kinds of e-mail are local and domain."""
    if kind == "email":
        local, _, domain = text.lower().rpartition("@")
        return [("local", local), ("domain", domain)]
    if kind == "name":
        return [("name", text[a:b].casefold()) for a, b in parts(text)]
    if kind == "phone":
        return [("phone", _national(text)[1])]
    if kind == "card":
        return [("card", _digits(text))]
    if kind == "iban":
        return [("iban", text.replace(" ", ""))]
    if kind == "ip":
        return [("ip", str(ipaddress.ip_address(text)))]
    return [(kind, text)]


# -- draws


def _luhn(digits: str) -> int:
    """The check digit for these digits."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _source(key: bytes, kind: str, entity: str, attempt: int) -> Callable[[int], int]:
    """below(n): the next keyed draw of range(n) for an entity."""
    seed, at = f"{kind}|{attempt}|{entity}".encode("utf-8", "surrogatepass"), 0

    def below(n: int) -> int:
        nonlocal at
        at += 1
        return int.from_bytes(hashlib.blake2b(seed + b"|%d" % at, key=key, digest_size=32).digest(), "big") % n

    return below


# Sounds of made-up words, by script: openings, vowels, closings.
_SOUNDS = {
    "latin": ("b c d f g h j k l m n p r s t v w z br cr dr fr gr tr bl cl fl gl pl st sh th ch".split(), "a e i o u ai ea ia io ou".split(), ["", "", "l", "m", "n", "r", "s", "t", "nd", "rt"]),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х ц ч ш бр вл гр др кр пр ст тр".split(), "а е и о у ю я".split(), ["", "", "в", "к", "л", "м", "н", "р", "с", "т"]),
    "greek": ("β γ δ θ κ λ μ ν ξ π ρ σ τ φ χ ψ στ τρ πρ κρ".split(), "α ε η ι ο υ ω".split(), ["", "", "λ", "μ", "ν", "ρ", "σ"]),
}
# Endings that say gender or case; longer ones first.
_ENDINGS = {"latin": (), "cyrillic": ("ская", "ский", "ова", "ева", "ина", "ов", "ев", "ин", "ая", "ий"), "greek": ("ος", "ης", "ας")}
_GIVEN_ENDINGS = {"f": ("a", "ia", "ina"), "m": ("o", "io", "us"), "fc": ("а", "ия", "ина"), "mc": ("ий", "ан", "ор")}


def script(text: str) -> str:
    c = next((c for c in text if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _sounds(below: Callable[[int], int], n: int, of: str = "latin") -> str:
    opening, vowel, closing = _SOUNDS[of]
    return "".join(opening[below(len(opening))] + vowel[below(len(vowel))] + (closing[below(len(closing))]) for _ in range(n))


def _name(entity: str, below: Callable[[int], int], extra: int) -> str:
    of, n = script(entity), 1 + (len(entity) > 6) + (len(entity) > 10) + extra
    gender = _GIVEN.get(entity)
    if gender and of != "greek":
        endings = _GIVEN_ENDINGS[gender + ("c" if of == "cyrillic" else "")]
        end = endings[below(len(endings))]
    else:
        end = next((e for e in _ENDINGS[of] if entity.endswith(e) and len(entity) > len(e) + 1), entity[-1])
    opening, vowel, _ = _SOUNDS[of]
    stem = _sounds(below, n, of) + opening[below(len(opening))]
    if end[0] not in "".join(vowel):
        stem += vowel[below(len(vowel))]
    return stem + end


def _shaped(text: str, below: Callable[[int], int]) -> str:
    """A letter for each letter of the same case, a digit for each digit; others stay."""
    out = []
    for c in text:
        base = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else ""
        out.append(chr(ord(base) + below(10 if base == "0" else 26)) if base else c)
    return "".join(out)


def _words(text: str, below: Callable[[int], int], extra: int) -> str:
    """Made-up words for the letter runs of an address's part, digits for its digits."""
    word = lambda m: _sounds(below, 1 + (len(m[0]) > 3) + (len(m[0]) > 7) + extra, script(m[0])) if m[0][0].isalpha() else "".join(str(below(10)) for _ in range(len(m[0]) + extra))
    new, n = re.subn(r"[^\W\d_]+|[0-9]+", word, text)
    return new if n else new + _sounds(below, 1 + extra)


def _network(address: ipaddress.IPv4Address) -> str:
    """The kind of network that a surrogate must share."""
    for net in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "224.0.0.0/4", "240.0.0.0/4"):
        if address in ipaddress.ip_network(net):
            return net
    return "0.0.0.0/0"


def candidate(kind: str, entity: str, attempt: int, key: bytes) -> str:
    """The attempt-th surrogate of an entity, in the form of entities."""
    below, extra = _source(key, kind, entity, attempt), attempt // WIDEN
    if kind == "name":
        return _name(entity, below, extra)
    if kind == "local":
        return _words(entity, below, extra)
    if kind == "domain":
        head, dot, top = entity.rpartition(".")
        return _words(head, below, extra) + dot + top
    if kind == "ip":
        address = ipaddress.ip_address(entity)
        if address.version == 6:
            return str(ipaddress.IPv6Address(address.packed[:2] + below(1 << 112).to_bytes(14, "big")))
        net = ipaddress.ip_network(_network(address))
        if extra and net.is_private:
            net = ipaddress.ip_network("10.0.0.0/8")
        if extra > 1:  # no such IPv4 address is free
            return str(ipaddress.IPv6Address(b"\xfd\0" + below(1 << 112).to_bytes(14, "big")))
        while True:
            new = net[below(net.num_addresses)]
            if net.prefixlen or (1 <= new.packed[0] < 224 and new.packed[0] != 127 and _network(new) == "0.0.0.0/0"):
                return str(new)
    if kind == "card":
        n = min(19, len(entity) + extra)
        body = entity[0] + "".join(str(below(10)) for _ in range(n - 2))
        check = _luhn(body)
        return body + str(check if _luhn(entity[:-1]) == int(entity[-1]) else (check + 1 + below(9)) % 10)
    if kind == "iban":
        bank = "".join(str(below(10)) if c.isdigit() else chr(65 + below(26)) for c in entity[4:]) + "0" * extra
        return f"{entity[:2]}{98 - _mod97(entity[:2] + '00' + bank):02d}{bank}"
    if kind == "ssn":
        area = 1 + below(898)
        return f"{area if area < 666 else area + 1:03d}-{1 + below(99):02d}-{1 + below(9999):04d}" + "".join(str(below(10)) for _ in range(extra))
    if kind == "phone":
        return "".join(str(below(10)) for _ in range(len(entity) + extra))
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", entity):
        digits = "0123456789ABCDEF" if entity.upper() == entity else "0123456789abcdef"
        return "".join(digits[below(16)] for _ in range(len(entity) + extra))
    head = re.match("AKIA|gh[pousr]_|sk-|", entity)[0]
    return head + _shaped(entity[len(head) :] + "a" * extra, below)


def _like(word: str, model: str) -> str:
    """A word in the letter case of the model."""
    return word.upper() if model.isupper() else word[:1].upper() + word[1:] if model[:1].isupper() else word


def _fill(text: str, digits: str, skip: int = 0) -> str:
    """The text with its digits after the first `skip` replaced; more digits go to the end."""
    at, out = -skip, []
    for c in text:
        if c in "0123456789":
            c, at = digits[at] if at >= 0 else c, at + 1
        out.append(c)
    return "".join(out) + digits[max(at, 0) :]


def render(kind: str, text: str, new: Callable[[str, str], str]) -> str:
    """A mention with the surrogates of its entities, new(kind, entity), in its own format."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        a, b = (new(k, e) for k, e in entities(kind, text))
        return _like(a, local) + "@" + (b.upper() if domain.isupper() else b)
    if kind == "name":
        out, at = [], 0
        for a, b in parts(text):
            out += [text[at:a], _like(new("name", text[a:b].casefold()), text[a:b])]
            at = b
        return "".join([*out, text[at:]])
    (k, e), *_ = entities(kind, text)
    if kind == "phone":
        return _fill(text, new(k, e), _national(text)[0])
    if kind == "card":
        return _fill(text, new(k, e))
    if kind == "iban":
        it = iter(new(k, e))
        return "".join(c if c == " " else next(it) for c in text) + "".join(it)
    return new(k, e)


def rewrite(text: str | None, key: bytes, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str | None, dict[str, int]]:
    """The text with surrogates, and how many mentions of each kind it had. attempts: entities whose first draw is not free."""
    counts = dict.fromkeys(KINDS, 0)
    if not text:
        return text, counts
    drawn: dict[tuple[str, str], str] = {}

    def new(kind: str, entity: str) -> str:
        if (kind, entity) not in drawn:
            drawn[kind, entity] = candidate(kind, entity, (attempts or {}).get((kind, entity), 0), key)
        return drawn[kind, entity]

    out, at = [], 0
    for a, b, kind in find(text):
        out += [text[at:a], render(kind, text[a:b], new)]
        counts[kind] += 1
        at = b
    return "".join([*out, text[at:]]), counts


def resolve_locally(found: set[tuple[str, str]], key: bytes) -> dict[tuple[str, str], int]:
    """`resolve` in plain Python, for small sets: the draw that each entity keeps."""
    kept, taken, open_, n = {}, set(found), sorted(found), 0
    while open_:
        drawn = [(e, (e[0], candidate(*e, n, key))) for e in open_]
        open_ = []
        for e, value in drawn:
            if value in taken:
                open_.append(e)
            else:
                taken.add(value)
                kept[e] = n
        n += 1
    return kept


def surrogates(mentioned: list[tuple[str, str]], key: bytes) -> dict[tuple[str, str], str]:
    """The surrogate of each (kind, mention) of a small set."""
    kept = resolve_locally({e for kind, text in mentioned for e in entities(kind, text)}, key)
    return {(kind, text): render(kind, text, lambda k, e: candidate(k, e, kept[k, e], key)) for kind, text in mentioned}


# -- over a corpus


def _key(docs: DataFrame, key: str | None) -> bytes:
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"give a secret key, or set {KEY_SETTING}")
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


def mentions(docs: DataFrame) -> DataFrame:
    """(text_key, kind, entity): the distinct entities of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds, found = [], [], []
            for t, k in zip(batch.column("text"), batch.column("text_key").to_pylist(), strict=True):
                text = t.as_py()
                for kind, entity in sorted({e for a, b, kind in find(text) for e in entities(kind, text[a:b])}):
                    keys.append(k)
                    kinds.append(kind)
                    found.append(entity)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(found, pa.string())], names=["text_key", "kind", "entity"])

    texts = docs.where(F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    return texts.mapInArrow(run, "text_key long, kind string, entity string")


def _drawn(found: DataFrame, attempt: int, secret: bytes) -> DataFrame:
    """(kind, entity, value) with the attempt-th surrogate of each (kind, entity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names = batch.column("kind").to_pylist(), batch.column("entity").to_pylist()
            values = [candidate(k, e, attempt, secret) for k, e in zip(kinds, names, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("entity"), pa.array(values, pa.string())], names=["kind", "entity", "value"])

    return found.select("kind", "entity").mapInArrow(run, "kind string, entity string, value string")


def _stored(df: DataFrame, tag: str) -> tuple[Stored, int]:
    """df in the shared folder, and its rows.

    A small table is one file, whatever the number of its partitions: where Hadoop's native
    library is missing, an executor starts a process for each file that it creates, and that
    process has all of the executor's memory until it is under way.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        rows = held.count()
        return Stored(held.coalesce(1) if rows <= BROADCAST_ROWS else held, tag), rows
    finally:
        held.unpersist()


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def resolve(found: DataFrame, secret: bytes) -> tuple[DataFrame, DataFrame | None]:
    """From distinct (kind, entity): all first draws (kind, entity, value), and (kind, entity, attempt, value) of those that draw again, None if there are none.

    A value is free if no entity bears it and no earlier draw took it; of entities that
    draw the same value at once, the least keeps it.
    """
    first = _stored(_drawn(found, 0, secret), "pii-draws")[0].df
    taken = first.select("kind", F.col("entity").alias("value"), F.lit(None).cast("string").alias("entity")).unionByName(first.select("kind", "value", "entity"))
    at_once = taken.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("entity").isNull(), 1)).alias("real"), F.min("entity").alias("keeps")).where("n > 1")
    lost, rows = _stored(_losers(first, at_once), "pii-lost")
    attempt, again = 0, None
    while rows:
        attempt += 1
        new = _stored(_drawn(lost.df, attempt, secret), "pii-draws")[0].df
        values = new.select("kind", "value").distinct()
        held = taken.select("kind", "value").join(_small(values, rows), ["kind", "value"], "left_semi").distinct().withColumn("real", F.lit(1).cast("long"))
        least = new.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("keeps"))
        at_once = least.join(held, ["kind", "value"], "left").select("kind", "value", F.coalesce("real", F.lit(0)).alias("real"), "n", "keeps").where("real > 0 or n > 1")
        left, open_ = _stored(_losers(new, at_once), "pii-lost")
        stay = new.join(left.df, ["kind", "entity"], "left_anti").withColumn("attempt", F.lit(attempt))
        again = _stored(stay if again is None else again.unionByName(stay), "pii-again")[0].df
        taken = taken.unionByName(new.select("kind", "value", "entity"))
        lost.drop()
        lost, rows = left, open_
    return first, again


def _losers(drawn: DataFrame, at_once: DataFrame) -> DataFrame:
    """(kind, entity) whose drawn value is a real entity's, or kept by another entity."""
    return drawn.join(at_once, ["kind", "value"]).where((F.col("real") > 0) | (F.col("entity") != F.col("keeps"))).select("kind", "entity")


def assignments(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(kind, entity, surrogate) of each distinct entity of the corpus."""
    first, again = resolve(mentions(docs).select("kind", "entity").distinct(), _key(docs, key))
    if again is None:
        return first.withColumnRenamed("value", "surrogate")
    return first.join(again, ["kind", "entity"], "left_anti").unionByName(again.select("kind", "entity", "value")).withColumnRenamed("value", "surrogate")


def replace(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text (with surrogates), n_entities and the mentions of each kind, for each row of docs."""
    secret = _key(docs, key)
    found = _stored(mentions(docs), "pii-mentions")[0].df
    _, again = resolve(found.select("kind", "entity").distinct(), secret)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    none = F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>").alias("again")
    if again is None:
        return _rewritten(rows.select("doc_id", "text", none), secret)
    mine = found.join(_small(again, again.count()), ["kind", "entity"]).groupBy("text_key").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("again"))
    mine, n = _stored(mine, "pii-texts")
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    if n <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(mine.df), "text_key", "left")
    else:  # copies of one text are many rows of one key
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = rows.join(mine.df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["text_key", "salt"], "left")
    return _rewritten(joined.select("doc_id", "text", "again"), secret)


def _rewritten(rows: DataFrame, secret: bytes) -> DataFrame:
    names = ["n_entities", *[f"n_{k}" for k in KINDS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                attempts = [{(x["kind"], x["entity"]): x["attempt"] for x in a.as_py() or ()} for a in part.column("again")]
                done = [rewrite(t.as_py(), secret, a) for t, a in zip(part.column("text"), attempts, strict=True)]
                counts = [[sum(c.values()) for _, c in done], *[[c[k] for _, c in done] for k in KINDS]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([t for t, _ in done], pa.string()), *[pa.array(c, pa.int64()) for c in counts]], names=["doc_id", "text", *names])

    return rows.mapInArrow(run, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))


def audit(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(kind, surrogate, n): surrogates that stand for more than one entity, or for one and are borne by an entity; none are expected."""
    pairs = _stored(assignments(docs, key), "pii-pairs")[0].df
    borne = pairs.select("kind", F.col("entity").alias("surrogate"))
    return pairs.select("kind", "surrogate").unionByName(borne.join(pairs.select("kind", "surrogate"), ["kind", "surrogate"], "left_semi")).groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
