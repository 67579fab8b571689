"""Rows for rules that ordinary tables do not exercise; the queries read them beside their tables.

Texts are drawn from the grammar of the rules by a seeded generator, which also says what must be found in each and what
must not.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

LETTERS, DIGITS = "ABCDEFGHJKLMNPRSTUVWXYZ", "0123456789"
FILLER = "de stoep lag vol bladeren en niemand veegde|het regende tegen de ruit|boven klonk muziek|een fiets stond tegen de muur|later werd het stil op het plein|wie dit leest weet genoeg".split("|")


def _numbers(rnd: random.Random, n: int) -> str:
    return rnd.choice("123456789") + "".join(rnd.choice(DIGITS) for _ in range(n - 1))


def citizen_number(rnd: random.Random) -> str:
    """Nine digits that pass the eleven-test: weights 9 to 2 and -1."""
    while True:
        head = _numbers(rnd, 8)
        check = sum(int(d) * w for d, w in zip(head, range(9, 1, -1), strict=True)) % 11
        if check < 10:
            return head + str(check)


def card_number(rnd: random.Random) -> str:
    """Sixteen digits that pass the Luhn test."""
    head = "5" + _numbers(rnd, 14)
    total = sum(2 * int(d) - 9 * (int(d) > 4) if k % 2 == 0 else int(d) for k, d in enumerate(head))
    return head + str(-total % 10)


def account_number(rnd: random.Random) -> str:
    """A Dutch account number whose remainder by 97 is 1."""
    bank, number = "".join(rnd.choice(LETTERS) for _ in range(4)), _numbers(rnd, 10)
    as_digits = "".join(str(int(c, 36)) for c in bank + number + "NL00")
    return f"NL{98 - int(as_digits) % 97:02d}{bank}{number}"


def _changed(rnd: random.Random, number: str) -> str:
    """The number with its last digit changed, so that its check fails."""
    return number[:-1] + str((int(number[-1]) + rnd.randrange(1, 9)) % 10)


def _name(rnd: random.Random) -> str:
    part = lambda: rnd.choice(LETTERS) + "".join(rnd.choice("aeiou") + rnd.choice("lmnrst") for _ in range(rnd.randrange(2, 4)))
    return f"{part()} {rnd.choice(('', 'van ', 'de ', 'van der '))}{part()}"


def _word(rnd: random.Random) -> str:
    return "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeou") for _ in range(rnd.randrange(2, 5)))


@dataclass
class Sample:
    text: str
    #: (type, value) that a scan lists, and values that it must not list.
    wanted: list[tuple[str, str]] = field(default_factory=list)
    unwanted: list[str] = field(default_factory=list)


def _statements(rnd: random.Random) -> dict[str, tuple[str, list[tuple[str, str]], list[str]]]:
    """For each kind a line, what it says and what it only seems to say."""
    bsn, card, iban = citizen_number(rnd), card_number(rnd), account_number(rnd)
    dotted = rnd.choice((" ", ".", "-")).join((bsn[:3], bsn[3:6], bsn[6:]))
    other, longer, (before, after) = citizen_number(rnd), citizen_number(rnd), rnd.choice((("", ";"), ("(", ")"), ("", ","), ("nr:", "")))
    no_bsn, no_card = _changed(rnd, citizen_number(rnd)), _changed(rnd, card_number(rnd))
    mail = f"{_word(rnd)}.{_word(rnd)}@{_word(rnd)}.{rnd.choice(('nl', 'org', 'eu'))}"
    phone = rnd.choice(("06", "+316", "0031 6 ", "06-")) + _numbers(rnd, 8)
    post = f"{_numbers(rnd, 4)} {rnd.choice(LETTERS)}{rnd.choice(LETTERS)}"
    born = f"{rnd.randrange(10, 29)}-{rnd.randrange(10, 13)}-{rnd.randrange(1930, 2015)}"
    passport = rnd.choice(LETTERS) + rnd.choice(LETTERS) + _numbers(rnd, 7)
    big, pupil, plate = _numbers(rnd, 11), _numbers(rnd, 7), f"{rnd.choice(LETTERS)}{rnd.choice(LETTERS)}-{_numbers(rnd, 2)}-{_numbers(rnd, 2)}"
    ip, key, name = ".".join(str(rnd.randrange(20, 120)) for _ in range(4)), "".join(rnd.choice(LETTERS.lower() + DIGITS) for _ in range(20)), _name(rnd)
    return {
        "dotted": (f"opgegeven is {dotted} aan het loket", [("bsn", dotted)], []),
        "bsn": (f"achter slot ligt {before}{other}{after} en wie zoekt vindt", [("bsn", other)], []),
        "no_bsn": (f"volgnummer {no_bsn} telt niet", [], [no_bsn]),
        "long": (f"code {longer}{_numbers(rnd, 9)} is te lang", [], [longer]),
        "card": (f"betaald met {card} aan de kassa", [("betaalkaart", card)], []),
        "no_card": (f"bestelling {no_card} is onderweg", [], [no_card]),
        "iban": (f"overmaken naar {iban} kan ook", [("iban", iban)], []),
        "mail": (f"schrijf {mail} of kom langs", [("email", mail)], []),
        "phone": (f"bereikbaar op {phone} na achten", [("telefoon", phone)], []),
        "post": (f"ergens in {post} aan het water", [("postcode", post)], []),
        "born": (f"geboren op {born} in de winter", [("geboortedatum", born)], []),
        "passport": (f"het paspoort {passport} is verlopen", [("paspoortnummer", passport)], []),
        "big": (f"de BIG-registratie {big} staat vast", [("big", big)], []),
        "pupil": (f"dossiernummer {pupil} ligt klaar", [("leerlingnummer", pupil)], []),
        "plate": (f"voor de deur stond {plate} geparkeerd", [("kenteken", plate)], []),
        "ip": (f"aangemeld vanaf {ip} gisteren", [("ipadres", ip)], []),
        "no_ip": ("de klok loopt op 127.0.0.1 en 1.1.1.1", [], ["127.0.0.1", "1.1.1.1"]),
        "secret": (f"token: {key}", [("geheim", f"token: {key}")], []),
        "name": (f"mevrouw {name} belde terug", [("naam", name)], []),
    }


def drawn(n: int = 48, seed: int = 11) -> list[Sample]:
    """n texts of one to five lines between filler, each line far enough from the next that its words do not serve another."""
    rnd, out = random.Random(seed), []
    for _ in range(n):
        found, lines = Sample(""), []
        said = _statements(rnd)
        for kind in rnd.sample(sorted(said), rnd.randrange(1, 6)):
            line, wanted, unwanted = said[kind]
            lines += [line, *rnd.sample(FILLER, 5)]
            found.wanted += wanted
            found.unwanted += unwanted
        found.text = "\n".join(lines)
        listed = {value for _, value in found.wanted}
        found.unwanted = [v for v in found.unwanted if not any(v in x for x in listed)]
        out.append(found)
    return out


DRAWN = drawn()
TEXTS = (
    *((90000100 + k, s.text) for k, s in enumerate(DRAWN)),
    (90000200, " ".join(f"{_word(random.Random(k))}{k}@{_word(random.Random(-k))}.eu" for k in range(60))),
    (90000015, "paspoort NW1234567 en rijbewijs; BIG-nummer 19012345678; studentnummer 1234567 van student Piet van den Berg"),
    (90000016, "kenteken AB-12-34 en 12-ABC-3, adres 192.168.1.20 maar niet 127.0.0.1 of 1.1.1.1"),
    (90000017, "DigiD staat hier met gebruikersnaam en meer. Betaalkaart 5500 0055 5555 5559; niet 5500005555555558."),
    (90000018, "de kerk, het vakbondslidmaatschap, seksuele voorkeur, een strafblad, vingerafdruk, afkomst en geloofsovertuiging"),
    (90000019, "geb. 2009-03-14, leeftijd 12; GB82WEST12345698765432; +31 6 12345678; 0612345678 en 0201234567"),
    (90000020, ""),
    (90000021, "nummer 206451399 telt niet mee, 206.451.386 wel; nummer 1234567890123456 is geen kaart"),
)
#: Chunks of texts with what a model said of them: id, chunk_no, n_chunks, chunk, content, error.
REPLIES = (
    (1, 1, 2, "Inschrijving voor Noor Verhoeven, klas 2B.", '```json\n{"bevindingen":[{"type":"naam","label":"Naam van een kind","ernst":"middel","fragment":"Noor Verhoeven","toelichting":"direct identificerend","zekerheid":"hoog"},{"type":"gezondheid","label":"Bedacht","ernst":"hoog","fragment":"komt nergens voor"}],"samenvatting":"inschrijving van een kind"}\n```', None),
    (1, 2, 2, "Tweede deel met  veel\nwit en Sanne Bakker.", '<think>even kijken {</think>{"bevindingen":[{"type":"NAAM","fragment":"veel wit en","ernst":"ernstig"}],"samenvatting":"tweede"}', None),
    (2, 1, 3, "Neutrale tekst.", '{"bevindingen":[],"samenvatting":""}', None),
    (2, 2, 3, "Nog een deel.", None, "HTTP 500 van het model"),
    (2, 3, 3, "Deel met Sanne Bakker.", '{"bevindingen":[{"type":"naam","fragment":"Sanne Bakker","ernst":"hoog"}],"samenvatting":"te laat"}', None),
    (3, 1, 1, "Geen JSON.", "Ik weet het niet.", None),
)
#: What the queries make of a row's key k: an item of a list by k modulo its length, k having been divided first. Files from pages,
#: videos from parts.
FILE_KINDS = ("txt", "PNG", "docx", "pdf", "mkv", "md", "csv", "rtf", "onbekend", "html", "heic", "odp")
VIDEO = {
    "width": (1, (1920, 1280, 3840, 720, 320, 641, 96, 1439)), "height": (3, (1080, 720, 2160, 576, 240, 361, 48)), "sar": (1, (1.0, 1.0666666666666667, 0.5, 2.0)), "scale": (2, (1.0, 2.0, 0.5)),
    "corner": (1, ("linksboven", "rechtsboven", "linksonder", "rechtsonder")), "container": (1, ("mp4", "webm", "mov", "mkv", "m4v")),
    "codecs": (2, ("aac,mp3", "opus", "pcm_s16le", "flac", "opus,aac", "vorbis", "alac")), "space": (1, ("bt709", "", "smpte170m", "bt2020nc", "unknown", "bt470bg")), "crf": (1, (None, 25, 20)),
}
