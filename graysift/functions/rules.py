"""The rule catalogue: what is looked for, how severe it is, and the words that must or may stand near.

Patterns are Java regular expressions in Unicode mode (?U), so letters with accents are word characters.
"""

from __future__ import annotations

from dataclasses import dataclass

NONE, LOW, MEDIUM, HIGH, UNKNOWN = "geen", "laag", "middel", "hoog", "onbekend"
RANK = {NONE: 0, LOW: 1, MEDIUM: 2, HIGH: 3}


@dataclass(frozen=True)
class Rule:
    type: str
    label: str
    severity: str
    category: str
    note: str
    pattern: str
    #: A cheap pattern that any text with a match holds; texts without it are passed over.
    guard: str
    context: str | None = None


# Patterns, labels, severities, notes and word lists of the rules.
RULES = (
    Rule("bsn", "Burgerservicenummer", HIGH, "identificatie", "Nationaal identificatienummer — art. 87 AVG / art. 46 UAVG: alleen bij wettelijke grondslag.",
         r"(?U)(?<!\d)(?<!\d[ .\-])(\d{9}|\d{3}[ .\-]\d{3}[ .\-]\d{3})(?!\d)(?![ .\-]\d)", r"(?U)\d{3}[ .\-]?\d{3}[ .\-]?\d{3}"),
    Rule("iban", "Bankrekeningnummer (IBAN)", MEDIUM, "financieel", "Financieel persoonsgegeven — art. 4 lid 1 AVG.",
         r"(?U)\b[A-Z]{2}\d{2} ?(?:[A-Z0-9]{4} ?){2,7}[A-Z0-9]{1,4}\b", r"(?U)[A-Z]{2}\d{2}"),
    Rule("betaalkaart", "Betaalkaartnummer", HIGH, "financieel", "Betaalgegeven — hoort niet in analysemateriaal (art. 32 AVG, PCI-DSS).",
         r"(?U)\b(?:\d[ \-]?){12,18}\d\b", r"(?U)\d[ \-]?\d[ \-]?\d[ \-]?\d[ \-]?\d[ \-]?\d"),
    Rule("email", "E-mailadres", MEDIUM, "contact", "Direct identificerend contactgegeven — art. 4 lid 1 AVG.",
         r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}\b", "@"),
    Rule("telefoon", "Telefoonnummer", MEDIUM, "contact", "Direct identificerend contactgegeven — art. 4 lid 1 AVG.",
         r"(?U)(?<!\w)(?<!\d\.)(?:(?:\+31|0031)[ \-]?\(?0?\)?[ \-]?[1-9](?:[ \-]?\d){8}|0[1-9](?:[ \-]?\d){8})(?!\w)(?!\.\d)", r"(?U)(?:\d[ \-]?){7}\d"),
    Rule("postcode", "Postcode (NL)", MEDIUM, "contact", "Met huisnummer herleidbaar tot één adres — art. 4 lid 1 AVG.",
         r"(?U)\b[1-9]\d{3} ?[A-Za-z]{2}\b", r"(?U)\d{4} ?[A-Za-z]{2}"),
    Rule("geboortedatum", "Geboortedatum", MEDIUM, "identificatie", "In combinatie met een naam direct identificerend — art. 4 lid 1 AVG.",
         r"(?U)\b(?:(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)\d{2}|(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))\b",
         r"(?U)\d[-/.]\d", r"(?iU)\b(geb(?:oren|\.|oortedatum)?|geboortejaar|dob|birth|leeftijd)\b"),
    Rule("paspoortnummer", "Paspoort- of ID-kaartnummer", HIGH, "identificatie", "Identiteitsdocument — nummer of kopie is vrijwel nooit nodig voor analyse.",
         r"(?U)\b[A-Z]{2}[A-Z0-9]{6}\d\b", r"(?U)[A-Z]{2}[A-Z0-9]{6}\d", r"(?iU)\b(paspoort|passport|id-?kaart|identiteitsbewijs|documentnummer|rijbewijs)\b"),
    Rule("big", "BIG-nummer (zorgverlener)", MEDIUM, "identificatie", "Beroepsregistratienummer, herleidbaar tot één persoon.",
         r"(?U)\b\d{11}\b", r"(?U)\d{11}", r"(?iU)\bbig[- ]?(nummer|nr|registratie)?\b"),
    Rule("leerlingnummer", "Leerling-, student- of medewerkernummer", MEDIUM, "identificatie", "Pseudo-identificator: binnen de organisatie herleidbaar tot één persoon.",
         r"(?U)\b\d{6,10}\b", r"(?U)\d{6}", r"(?iU)\b(leerling|student|deelnemer|cursist|medewerker|personeels|dossier|pgn|onderwijs)[- ]?(nummer|nr|id)\b"),
    Rule("kenteken", "Kenteken", LOW, "identificatie", "Indirect identificerend via het RDW-register.",
         r"(?U)\b(?:[A-Z]{2}-\d{2}-\d{2}|\d{2}-[A-Z]{2}-\d{2}|\d{2}-\d{2}-[A-Z]{2}|[A-Z]{2}-\d{2}-[A-Z]{2}|[A-Z]{2}-[A-Z]{2}-\d{2}|\d{2}-[A-Z]{2}-[A-Z]{2}|\d{2}-[A-Z]{3}-\d|\d-[A-Z]{3}-\d{2}|[A-Z]{2}-\d{3}-[A-Z]|[A-Z]-\d{3}-[A-Z]{2})\b",
         r"(?U)\d-[A-Z]|[A-Z]-\d"),
    Rule("ipadres", "IP-adres", LOW, "technisch", "Online identificator — art. 4 lid 1 AVG (HvJ EU, Breyer).",
         r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", r"(?U)\d\.\d+\.\d"),
    Rule("geheim", "Wachtwoord, sleutel of token", HIGH, "geheim", "Geen persoonsgegeven, wél een direct beveiligingsrisico — art. 32 AVG.",
         r"(?iU)(?:\b(?:wachtwoord|password|passwd|pwd|geheim|secret|api[_-]?key|token|bearer)\b\s*[:=]\s*\S{4,}|\bsk-[A-Za-z0-9]{16,}|\bghp_[A-Za-z0-9]{20,}|\batk_[A-Za-z0-9]{16,}|\bAKIA[A-Z0-9]{16}\b)",
         r"(?iU)[:=]|sk-|ghp_|atk_|AKIA"),
    Rule("digid", "DigiD-gegevens", HIGH, "geheim", "Inloggegevens van de overheid — nooit delen.",
         r"(?iU)\bdigid\b[^\n]{0,40}?(?:gebruikersnaam|wachtwoord|code|inlog)", r"(?iU)digid"),
)
#: Special categories: one finding for each, which lists the words found.
SPECIAL_NOTE = "Bijzondere categorie — art. 9 AVG: verwerking verboden, tenzij een uitzondering geldt."
SPECIAL = (
    ("gezondheid", "Gezondheidsgegevens", r"(?iU)\b(diagnose|ziektebeeld|medicatie|medicijn(?:en)?|recept|huisarts|specialist|psycholoog|psychiater|therapie|behandelplan|ggz|autisme|adhd|add|dyslexie|dyscalculie|depressie|burn-?out|zwanger(?:schap)?|ziekmelding|ziekteverzuim|verzuimdossier|arbo(?:arts|dienst)|revalidatie|allergie|diabetes|kanker|epilepsie|handicap|beperking|rolstoel)\b"),
    ("etniciteit", "Etniciteit, ras of nationaliteit", r"(?iU)\b(etniciteit|afkomst|ras|nationaliteit|migratieachtergrond|allochtoon|autochtoon|asielzoeker|vluchteling|statushouder|geboorteland|moedertaal|inburgering)\b"),
    ("religie", "Religieuze of levensbeschouwelijke overtuiging", r"(?iU)\b(religie|geloof(?:sovertuiging)?|kerk(?:elijk|genootschap)?|moskee|synagoge|islamitisch|christelijk|katholiek|protestants|joods|hindoe|boeddhis(?:t|tisch)|athe[ïi]st|levensbeschouwing|ramadan|gebedsruimte)\b"),
    ("politiek", "Politieke opvatting of vakbondslidmaatschap", r"(?iU)\b(politieke (?:voorkeur|partij|opvatting)|stemgedrag|vakbond(?:slidmaatschap)?|fnv|cnv|aob|ondernemingsraad|stakingsactie)\b"),
    ("seksueel", "Seksuele geaardheid of seksleven", r"(?iU)\b(seksuele (?:geaardheid|voorkeur|ori[ëe]ntatie)|homoseksueel|lesbisch|biseksueel|transgender|non-?binair|lhbti\+?|coming-?out|genderidentiteit)\b"),
    ("strafrechtelijk", "Strafrechtelijke gegevens", r"(?iU)\b(strafblad|justitieel|veroordeling|verdachte|aangifte|politierapport|proces-?verbaal|reclassering|detentie|taakstraf|vog)\b"),
    ("biometrie", "Biometrische gegevens", r"(?iU)\b(vingerafdruk|irisscan|gezichtsherkenning|stemafdruk|biometri(?:e|sch)|dna-?profiel)\b"),
)
NAME = Rule(
    "naam", "Mogelijke persoonsnaam", MEDIUM, "identificatie", "Direct identificerend — art. 4 lid 1 AVG.",
    r"(?U)\b[A-Z][a-zà-ÿ]{2,}(?:\s+(?:van der|van den|van de|van 't|van|de|den|der|ter|te|op de|in 't|'t|el|al|bin|ben|di|da|dos|von|le|la))?\s+[A-Z][a-zà-ÿ]{2,}\b",
    r"(?U)[A-Z][a-zà-ÿ]{2,}(?:\s+[a-z' ]{2,7})?\s+[A-Z][a-zà-ÿ]{2}",
    r"(?iU)\b(naam|dhr|mevr|mw|heer|mevrouw|geachte|beste|ondergetekende|leerling|student|deelnemer|medewerker|docent|cli[eë]nt|pati[ëe]nt|contactpersoon|t\.a\.v\.)\b",
)
#: Findings of one type in a text, words of one special category, names that are looked at.
MAX_PER_TYPE, MAX_TERMS, MAX_NAMES = 25, 10, 15
#: Types of plain numbers, which give way to a finding of another type over the same digits.
GENERIC = ("leerlingnummer", "big", "betaalkaart")
#: Types that point at a person.
IDENTIFYING = ("bsn", "email", "telefoon", "postcode", "geboortedatum", "paspoortnummer", "big", "leerlingnummer", "iban", "betaalkaart", "digid", "kenteken", "naam", "adres", "contact", "identificatie")
TOPIC_SUFFIX = " (onderwerp)"
TOPIC_NOTE = "Gevoelig onderwerp, maar er is niemand identificeerbaar in dit bestand. Let op combinaties met andere bronnen."
ADVICE = {
    NONE: "Geen persoonsgegevens gevonden — uploaden kan.",
    LOW: "Alleen licht identificerende gegevens — meestal geen bezwaar, controleer de bevindingen.",
    MEDIUM: "Persoonsgegevens gevonden — verwijder of anonimiseer ze vóór het uploaden.",
    HIGH: "Gevoelige gegevens gevonden — niet uploaden zonder deze eerst te verwijderen.",
    UNKNOWN: "Dit bestand kon niet gelezen worden — controleer de inhoud handmatig.",
}
#: Sentences of reports; %s stands for numbers and names.
SAID = {
    "more": "%s: nog %s andere unieke treffer(s) gevonden; alleen de eerste %s staan in het rapport.",
    "cut": "Bestand is groter dan de leeslimiet; alleen het eerste deel is gescand.",
    "clean": "Alle bestanden blijven onder de drempel — uploaden kan.",
    "blocked": '%s van %s bestand(en) haalt de drempel "%s" of hoger. Schoon die eerst op.',
    "unread": " %s bestand(en) kon de scanner niet lezen — controleer die zelf.",
    "no_json": "het model gaf geen bruikbare JSON terug",
    "chunks": "Tekst opgeknipt in %s stukken; alleen de eerste %s zijn met AI beoordeeld (--max-stukken verhoogt dit).",
    "failed": "AI-analyse van deel %s/%s mislukt: %s",
    "read": "Kon dit bestand niet lezen: %s",
    "unpack": "Kon dit bestand niet uitpakken: %s",
    "large": "archief te groot om betrouwbaar te lezen",
    "empty": "geen leesbare documentonderdelen in het archief",
    "no_model": "de server draait maar heeft geen model geladen",
    "other_model": 'Model "%s" staat niet in de lijst. Beschikbaar: %s',
}
