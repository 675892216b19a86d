"""Personal data inside free text (problem 9): finding it and putting typed placeholders in its place.

Numbers are found by their formats and validated by what stands around them; names by a model of name
parts learned from the name table (its entries, and beginnings and endings that combine freely in
it), by forms of address, roles and register entries, and by the names a text has given in full
before. Placeholders keep equal values linked across documents: the letters and digits of phone and
identity numbers go through a keyed Feistel permutation within their format, whatever the signs between
them and, for phone numbers, whether a country code or a trunk zero stands before; other values carry
a keyed tag of 128 bits. The pseudonyms can't be turned back without the key.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklode.runtime import spread

#: Name parts beyond this many aren't sent to the workers (the table is a fixed lexicon).
MOST_PARTS = 1_000_000
#: Rows looked at together.
SLICE = 500

# ---- fixed values: words and formats of the three languages ----
TITLES = "Mr Mrs Ms Miss Dr Capt Captain Prof Judge Justice Herr Herrn Frau Richter Richterin Kapitän Mme Mlle Me Maître".split()
PARTICLES = r"(?:van der|van den|van|von der|von|zu|de la|de|du|den|del|di|da|dos|al|el|ibn|bin|ter|ten)"
STOP = set(
    "Headnote Leitsatz Sommaire Before Composition Case Page Seite Audience Urteil Aktenzeichen Exhibit Container High Court County Harbour Tribunal Landgericht "
    "Amtsgericht Oberlandesgericht Cour Corrected Berichtigte Version Order Anlage Judge The This That On It At We There Counsel Having For In Notice Service If When After And "
    "Der Die Das Nach Entgegen Unstreitig Zutreffend Hierbei Im In Le La Les Il Attendu Considérant Mr Mrs Ms Dr Capt Herr Frau Richter Richterin Mme Me ORDER BETWEEN".split()
)
LEGAL = r"(?:Ltd|Limited|plc|PLC|LLP|LLC|Inc|Corp|GmbH|AG|KG|KGaA|OHG|SE|SA|SAS|SARL|SNC|NV|BV)"
FIRM = re.compile(rf"(?:[ -](?:[A-ZÀ-Þ][\w.-]*|&|et|und|and|de|of)){{0,4}}[ -]{LEGAL}\b")
STREET_EN = "Row|Close|Road|Hill|Avenue|Court|Street|Lane|Way|Drive|Square|Terrace|Gardens|Place|Crescent|Walk|Quay|Parade|Mews|Rise|Grove"
STREET_DE = "straße|strasse|str\\.|weg|gasse|allee|platz|ufer|damm|ring|markt|steig|chaussee|hof|graben|wall"
STREET_FR = "rue|avenue|boulevard|place|chemin|impasse|quai|allée|route|square|passage|cours|ruelle|sentier"
TOWN = r"[A-ZÀ-Þ][\w'’-]+(?: (?:am|an der|im|bei|sur|de|la|le|of) [A-ZÀ-Þ][\w'’-]+| [A-ZÀ-Þ][\w'’-]+)?"
ADDRESS = {
    "en": re.compile(rf"\d{{1,4}}[A-Z]?,? (?:[A-ZÀ-Þ][\w'’-]*\.? ){{1,3}}(?:{STREET_EN})\b(?:, (?:Flat|Unit|Apt\.?|Apartment|Suite) \d+[A-Z]?)?(?:, {TOWN}(?: \d{{5}})?| ?, \d{{5}} {TOWN})?"),
    "de": re.compile(rf"(?:\b[A-ZÄÖÜ][\wäöüß-]*(?:{STREET_DE})|\b(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Obere|Oberer|Untere|Unterer|Alte|Alter|Neue|Neuer|Hohe|Hoher|Kleine|Große)(?: [A-ZÄÖÜ][\wäöüß-]+){{1,2}}|\b[A-ZÄÖÜ][\wäöüß-]+ (?:Straße|Str\.|Weg|Gasse|Allee|Platz|Ufer|Damm|Ring|Markt)) \d{{1,4}}(?: ?[a-z])?\b(?:, (?:Whg\.|Wohnung|App\.) ?\d+)?(?:, (?:\d{{5}} )?{TOWN})?"),
    "fr": re.compile(rf"\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:{STREET_FR}) (?:[\w'’-]+ ){{0,4}}?[\w'’-]*[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)*(?:, (?:appartement|appt\.?|bât\.) ?\w+)?(?:, (?:\d{{5}} )?{TOWN})?"),
}
UNIT = re.compile(r"\b(?:Unit|Flat|Apt\.?|Apartment|Suite) \d+[A-Z]?, $")
NO_STREET = ("Liegeplatz",)
ID_BEFORE = re.compile(
    r"(?:national ID|identity (?:card )?(?:number|no\.?)|ID (?:card )?(?:number|no\.?)|passport (?:number|no\.?)|tax (?:ID|number|no\.?)|social (?:insurance|security) (?:number|no\.?)|personal (?:number|no\.?)|national insurance (?:number|no\.?)"
    r"|Personalausweis(?:nummer| Nr\.)|Ausweis(?:nummer| Nr\.)|Reisepass(?:nummer| Nr\.)|Pass(?:nummer| Nr\.)|Steuer-ID|Steuer(?:identifikations)?nummer|Sozialversicherungsnummer|Rentenversicherungsnummer|Personen(?:nummer|kennziffer)|Personalnummer"
    r"|carte d['’]identité (?:n°|numéro)|passeport (?:n°|numéro)|numéro (?:fiscal|de sécurité sociale|personnel|d['’]identité|de passeport|national)|n° (?:fiscal|de sécurité sociale|personnel))(?: (?:was|is|lautet|est))?[ :]*$"
)
ID_AFTER = re.compile(r" ?\((?:personal number|identity number|national ID|tax ID|passport(?: no\.)?|social (?:insurance|security) number|Personalausweisnummer|Personennummer|Steuer-ID|Reisepassnummer|Sozialversicherungsnummer|numéro personnel|numéro fiscal|numéro de sécurité sociale|carte d['’]identité|passeport)\)")
NUMBER = re.compile(r"\d(?:[ ./–-]?[\d()]| \(|\) ?){4,20}(?:[ -]?[A-Z]\b)?(?!\w)")
NUMBER_LEAD = re.compile(r"(?<![\w.+/(@–-])(?:[A-Z]{1,2} ?|\+ ?|\()$")
ID_FORM = re.compile(r"[A-Z]{2}(?: \d\d){3} [A-Z]|[A-Z]\d{7}[A-Z]|\d\.\d{3}\.\d{3}-[A-Z]|\d{6}-\d{4}|\d{3}-\d\d-\d{4}|\d\d(?: \d{3}){3}|\d{9,12}|[A-Z]{1,2} ?\d{6,10}[A-Z]?")
PHONE_FORM = re.compile(
    r"\+\d{1,3}[ .-]?(?:\(0\) ?)?\d(?:[ .–-]?\d){5,11}|00\d{2,3}(?:[ .-]\d{2,4}){2,4}|\(0\d{1,4}\) ?\d{3,4}(?:[ -]\d{2,4})?|0\d{1,4}/\d{5,9}|0\d{1,3}[–-]\d{3}[–-]\d{3,5}|0\d{1,2}(?: \d\d){4}|\d{3}[-–]\d{4}"
)
PHONE_LEAD = re.compile(r"(?:\+\d{1,3}[ .-]?(?:\(0\) ?)?|00\d{2,3}[ .-]|\(0|0)?")
PHONE_LOCAL = re.compile(r"\d{3}[-–]\d{4}")
PHONE_NEAR = re.compile(r"(?:[Tt]el(?:ephone|efon)?\.?|[Tt]él(?:éphone)?\.?|[Ff]ax|[Mm]obil\w*|[Pp]hone|[Rr]ufnummer|[Nn]umber|numéro|rang|called|Anruf von|joignable au|appelée? au|reached (?:by telephone )?(?:at|on))[ :]*(?:at |on |au |unter |der )?$")
NO_NUMBER = re.compile(r"(?:ref\.|order no\.|no\.|Container|lading|Auftragsnummer|Aktenzeichen|référence|conteneur|Rechnung Nr\.|facture n°|Anlage|pièce|connaissement|Konnossement|commande)[ :]*$")
AT = re.compile(r" ?(?:@|\(at\)|\[at\]|\{at\}|\(arobase\)) ?")
LOCAL_PART = re.compile(r"[A-Za-z0-9À-ÿ_](?:[\w.+-]|(?: ?[(\[]dot[)\]] ?))*$")
DOMAIN = re.compile(r"[\w-]+(?:(?:\.| ?[(\[](?:dot|Punkt|point)[)\]] ?)[\w-]+)*(?:\.| ?[(\[](?:dot|Punkt|point)[)\]] ?)[A-Za-z]{2,}(?![\w@])")
WORD = re.compile(r"[A-ZÀ-ÖØ-ÞĀ-Ž][\w'’\u0300-\u036f-]*")
PARTICLE_END = re.compile(rf"(?:^| )({PARTICLES} )$")
INITIAL_END = re.compile(r"(?<![\w.])[A-Z]\. $")
CLUSTER = re.compile(r"[\x00-\x7f]+(?![\u0300-\u036f])|.[\u0300-\u036f]*", re.S)
INSIDE = re.compile(r"[\w@+.'’\u0300-\u036f-]")
WORD_BEFORE = re.compile(r"(?<![\w@+.'’-])([A-ZÀ-ÖØ-ÞĀ-Ž][\w'’\u0300-\u036f-]{2,}) $")
BETWEEN = re.compile(r"(?<![\w@+.'’-])([A-ZÀ-Þ][\w'’-]+(?: [A-Z]\.)*) (?:van der|van den|van|von der) ([A-ZÀ-Þ][\w'’-]*\w)")
BORN = re.compile(rf"\b(?:née|né|geb\.|geborene[rn]?) ((?:{PARTICLES} )?(?:[ae]l-)?[A-ZÀ-Þ][\w'’\u0300-\u036f-]*[\w\u0300-\u036f])")
LISTED = re.compile(rf"(?:register lists|entry reads:|eingetragen:|registre mentionne) ((?:{PARTICLES} |[A-Z]{{2,3}} )*(?:[ae]l-|AL-)?[A-ZÀ-Þ][\w'’\u0300-\u036f-]+(?:,? [A-ZÀ-Þ][\w'’\u0300-\u036f-]+)?(?: [A-Z]\.)?)(?=[,;])")
GAP = re.compile(rf"\.? (?:{PARTICLES} )?")
PARTIES = [
    re.compile(r"BETWEEN: ([^()]{3,60}?) \(claimant\)"),
    re.compile(r"\(claimant\) and ([^()]{3,60}?) \(respondent\)"),
    re.compile(r"ENTRE : ([^,]{3,60}?), demande"),
    re.compile(r"ET : ([^,]{3,60}?), défende"),
    re.compile(r"In dem Rechtsstreit ([^,]{3,60}?), Kläger"),
    re.compile(r"gegen ([^,]{3,60}?), Beklagte"),
]


def language(flat: str) -> str:
    """en, de or fr, by function words of the text itself."""
    n = {"en": flat.count(" the ") + flat.count(" of "), "de": flat.count(" der ") + flat.count(" die ") + flat.count(" das "), "fr": flat.count(" le ") + flat.count(" la ") + flat.count(" que ")}
    return max(n, key=n.get)


class NameParts:
    """What the name table teaches: its entries, and beginnings and endings that combine in it."""

    def __init__(self, parts: list[tuple[str, str]], least: int = 3):
        self.table = {unicodedata.normalize("NFC", p).lower(): k[0] for p, k in parts if p and k}
        self.free: dict[str, tuple[set, set]] = {}
        for kind in {k for _, k in parts if k}:
            words = {p.lower() for p, k in parts if p and k == kind and p.isalpha()}
            heads, tails = defaultdict(set), defaultdict(set)
            for w in words:
                for i in range(2, len(w)):
                    heads[w[:i]].add(w[i:])
                    tails[w[i:]].add(w[:i])
            h, t = set(heads), set(tails)
            for _ in range(3):  # each side keeps what combines with enough of the other
                h = {x for x in h if len(heads[x] & t) >= least}
                t = {x for x in t if len(tails[x] & h) >= least}
            self.free[kind[0]] = (h, t)
        self.kinds: dict[str, str] = {}

    def kind(self, word: str) -> str:
        """G or F: built like a given or family name; g or f: only listed; T: title; I: initial; else U."""
        got = self.kinds.get(word)
        if got is None:
            got = self._kind(word)
            if len(self.kinds) > 500_000:
                self.kinds.clear()
            self.kinds[word] = got
        return got

    def _kind(self, word: str) -> str:
        if word in TITLES:
            return "T"
        if len(word) == 1:
            return "I"
        if not word.strip("X") or any(c.isdigit() for c in word):
            return "S"
        w = unicodedata.normalize("NFC", word).lower()
        if len(word) > 3 and w.isalpha():
            for k, (h, t) in self.free.items():
                if any(w[:i] in h and w[i:] in t for i in range(2, len(w))):
                    return k.upper()
        return self.table.get(w, "U")


class Finder:
    """Finds personal data in one text after the other."""

    def __init__(self, parts: list[tuple[str, str]]):
        self.names = NameParts(parts)

    def find(self, flat: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in a text whose runs of blanks are one blank; spans don't overlap."""
        if flat.isascii() or unicodedata.is_normalized("NFC", flat):
            return self._find(flat)
        # decomposed letters: looked at composed, placed in the text as written
        composed, at = [], []
        for m in CLUSTER.finditer(flat):
            c = unicodedata.normalize("NFC", m.group())
            composed.append(c)
            at += range(m.start(), m.end()) if len(c) == len(m.group()) else [m.start()] * len(c)
        at.append(len(flat))
        return [(at[a], at[z], kind) for a, z, kind in self._find("".join(composed))]

    def _find(self, flat: str) -> list[tuple[int, int, str]]:
        lang = language(flat)
        taken: list[tuple[int, int, str]] = []
        for a, z in self._mail(flat):
            taken.append((a, z, "EMAIL"))
        for a, z, kind in self._numbers(flat):
            taken.append((a, z, kind))
        for m in ADDRESS[lang].finditer(flat):
            a = m.start()
            if lang != "de" and a and (flat[a - 1].isalnum() or flat[a - 1] in ".-/"):
                continue
            if m.group().startswith(NO_STREET):
                continue
            if lang == "en" and (unit := UNIT.search(flat, max(0, a - 18), a)):
                a = unit.start()
            taken.append((a, m.end(), "ADDRESS"))
        for a, z in self._people(flat, lang):
            taken.append((a, z, "NAME"))
        rank = {"EMAIL": 0, "ADDRESS": 1, "IDNUM": 2, "PHONE": 3, "NAME": 4}
        out: list[tuple[int, int, str]] = []
        end = -1
        for a, z, kind in sorted(taken, key=lambda s: (s[0], rank[s[2]])):
            if a >= end:
                out.append((a, z, kind))
                end = z
        return out

    def _mail(self, flat):
        if "@" not in flat and "at)" not in flat and "at]" not in flat and "(arobase)" not in flat:
            return
        for m in AT.finditer(flat):
            right = DOMAIN.match(flat, m.end())
            if not right:
                continue
            left = LOCAL_PART.search(flat, max(0, m.start() - 80), m.start())
            if left and not left.group().replace(".", "").isdigit():
                a = left.start()
                if flat.startswith("mailto:", a):
                    a += 7
                yield a, right.end()

    def _numbers(self, flat):
        for m in NUMBER.finditer(flat):
            a, z = m.span()
            if a and not flat[a - 1].isspace() or a > 1 and flat[a - 2].isupper():
                lead = NUMBER_LEAD.search(flat, max(0, a - 4), a)
                if lead:
                    a = lead.start()
                elif not flat[a - 1].isspace() and flat[a - 1] not in ",;:[<«„":
                    continue
            before = flat[max(0, a - 44) : a]
            s = flat[a:z]
            form = ID_FORM.match(s)
            if form and (ID_BEFORE.search(before) or ID_AFTER.match(flat, a + form.end())):
                yield a, a + form.end(), "IDNUM"
                continue
            form = PHONE_FORM.match(s)
            if not form or form.end() < len(s.rstrip(" )")):
                tail = s[: form.end()] if form else ""
                if not tail or s[form.end()].isdigit():
                    continue
            if NO_NUMBER.search(before):
                continue
            if PHONE_LOCAL.fullmatch(form.group()) and not PHONE_NEAR.search(before) and not flat.startswith(" (mobile)", a + form.end()):
                continue
            yield a, a + form.end(), "PHONE"

    def _people(self, flat, lang):
        kind_of, kinds_get = self.names.kind, self.names.kinds.get
        words: list[list] = []
        last = -99
        for m in WORD.finditer(flat):
            w = m.group()
            k = kinds_get(w) or kind_of(w)
            if k == "U" and m.start() - last > 12 and w[-2:] not in ("'s", "’s") or k == "S":
                continue
            a, z = m.span()
            if z - a > 2 and w[-2] in "'’" and w[-1] == "s":
                w = w[:-2]
                z -= 2
                k = kinds_get(w) or kind_of(w)
                if k == "S" or k == "U" and a - last > 12:
                    continue
            if a and INSIDE.match(flat, a - 1):
                if flat[a - 3 : a] not in ("al-", "el-") or a > 3 and INSIDE.match(flat, a - 4):
                    continue
                a -= 3
                w = flat[a:z]
                k = kind_of(w)
            if k == "I":
                if lang == "fr" and w == "M" and flat.startswith(". ", z):
                    k = "T"
                elif not flat.startswith(".", z):
                    continue
            if flat.startswith("@", z):
                continue
            # an unknown word right before a family name (or an initial and one), unless it is an ordinary word
            if k in "FfI" and a - last > 1 and (lead := WORD_BEFORE.search(flat, max(0, a - 40), a)):
                before = lead.group(1)
                if lead.start() >= last and before not in STOP and kind_of(before) == "U" and f" {before.lower()} " not in flat:
                    words.append([lead.start(), lead.end(1), before, "P"])
            words.append([a, z, w, k])
            last = z
        spans: list[tuple[int, int, list[str], bool]] = []  # start, end, words, certain
        n, i = len(words), 0
        while i < n:
            titled = words[i][3] == "T"
            j = i + 1 if titled else i
            if titled and not (j < n and GAP.fullmatch(flat, words[i][1], words[j][0])):
                i += 1
                continue
            if titled and words[j][3] == "T":
                i = j
                continue
            start = words[j][0]
            if titled:  # a particle after the title belongs to the name
                start = words[i][1] + (2 if flat[words[i][1]] == "." else 1)
            unknown = 2 if titled else 0
            run: list[int] = []
            while j < n:
                a, z, w, k = words[j]
                if k == "U" and not run and not titled and w not in STOP and len(w) > 2 and j + 1 < n and words[j + 1][3] in "FfI" and GAP.fullmatch(flat, z, words[j + 1][0]) and flat[z] == " " and f" {w.lower()} " not in flat:
                    k = words[j][3] = "P"
                if run and not GAP.fullmatch(flat, words[run[-1]][1], a):
                    break
                if run and words[run[-1]][3] != "I" and flat[words[run[-1]][1]] == ".":
                    break
                if k == "T" or k == "U" and (w in STOP or not unknown or any(c.isdigit() for c in w)):
                    break
                if k == "P" and run:
                    break
                if k == "U":
                    unknown -= 1
                elif k in "Gg" and unknown < 1:
                    unknown = 1
                run.append(j)
                j += 1
            while run and words[run[-1]][3] == "I":
                run.pop()
            if not run or all(words[r][3] == "I" for r in run):
                i += 1
                continue
            end = words[run[-1]][1]
            kinds = "".join(words[r][3] for r in run)
            i = run[-1] + 1
            if kinds[0] == "P" and not any(k in "Ff" for k in kinds):
                continue
            certain = titled or len(run) > 1 and any(k in "GFgf" for k in kinds)
            if not certain and not any(k in "GF" for k in kinds):
                continue
            spans.append((start, end, [words[r][2] for r in run if words[r][3] != "I"], certain))
        for p in PARTIES:
            for m in p.finditer(flat):
                t = m.group(1)
                if not re.search(rf"\b{LEGAL}\b|&|\d|withheld|REDACTED|Commissioner", t) and " " in t and all(x[0].isupper() or re.fullmatch(PARTICLES, x) for x in t.split()) and not all(len(x.strip(".")) < 2 for x in t.split()) and "XX" not in t and "N.N" not in t:
                    spans.append((m.start(1), m.end(1), [x for x in t.split() if len(x) > 2 and x[0].isupper()], True))
        for p, marks in ((BORN, ("née ", "né ", "geb. ", "geborene")), (LISTED, ("register lists", "entry reads", "eingetragen:", "registre mentionne"))):
            for m in p.finditer(flat) if any(x in flat for x in marks) else ():
                t = m.group(1)
                if "XX" not in t and not flat.startswith(".", m.end(1)):
                    spans.append((m.start(1), m.end(1), [x for x in re.split(r",? ", t) if len(x) > 2 and x[0].isupper()], True))
        if " van " in flat or " von der " in flat:
            for m in BETWEEN.finditer(flat):
                if not set(m.group(1).split()) & STOP and "XX" not in m.group():
                    spans.append((m.start(), m.end(), [m.group(1).split()[0], m.group(2)], True))
        spans = [s for s in spans if not self._no_person(flat, s[0], s[1])]
        # names given in full before, now alone
        known = {}
        for a, z, ws, certain in spans:
            if certain:
                full = flat[a:z]
                for w in ws:
                    if full.endswith(w) and w not in TITLES:
                        p = PARTICLE_END.search(full[: -len(w)])
                        known.setdefault(w, p.group(1) if p else "")
                        if w.isupper():
                            known.setdefault(w[:1] + w[1:].lower(), p.group(1) if p else "")
        for w, lead in known.items():
            if kind_of(w) in "GF":
                continue  # found wherever it stands
            a = flat.find(lead + w)
            while a >= 0:
                z = a + len(lead) + len(w)
                alone = not (a and INSIDE.match(flat, a - 1)) and not (z < len(flat) and (flat[z].isalnum() or flat[z] in "_-@" or "\u0300" <= flat[z] <= "\u036f"))
                season = flat[max(0, a - 3) : a].lower() in ("im ", "in ")
                if alone and (i := INITIAL_END.search(flat, max(0, a - 3), a)) and not (lang == "fr" and i.group() == "M. "):
                    a = i.start()
                if alone and not season and not flat[z : z + 2].strip()[:1].isdigit() and not self._no_person(flat, a, z):
                    spans.append((a, z, [w], True))
                a = flat.find(lead + w, z)
        out = []
        for a, z, *_ in sorted(spans, key=lambda s: (s[0], -s[1])):
            if not out or a >= out[-1][1]:
                out.append((a, z))
        return out

    @staticmethod
    def _no_person(flat, a, z) -> bool:
        """Firms, cited cases and places."""
        if FIRM.match(flat, z) or flat.startswith((" v ", " v. "), z) or flat.startswith((" Mills", " Division"), z):
            return True
        before = flat[max(0, a - 14) : a]
        return before.endswith((" Re ", "(Re ", " v ", " v. ", "MV ", "In re ")) or before.startswith("Re ") and len(before) == 3


# ---- keyed pseudonyms ----


def _round(key: bytes, tag: str, n: int, value: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tag}|{n}|{value}".encode(), key=key, digest_size=8).digest(), "big")


def permute_number(value: int, size: int, key: bytes, tag: str = "", rounds: int = 8, back: bool = False) -> int:
    """Keyed permutation of 0 … size - 1: an alternating Feistel network over two near-equal factors,
    walked until the result lies inside."""
    if size <= 1:
        return value
    a = int(size**0.5) + 1
    b = -(-size // a)
    while True:
        x, y = divmod(value, b)
        for r in reversed(range(rounds)) if back else range(rounds):
            sign = -1 if back else 1
            if r % 2:
                x = (x + sign * _round(key, tag, r, y)) % a
            else:
                y = (y + sign * _round(key, tag, r, x)) % b
        value = x * b + y
        if value < size:
            return value


def permute_text(s: str, key: bytes, tag: str = "", back: bool = False) -> str:
    """The same format with other digits and letters: digits stay digits, capitals capitals, signs
    stay. A one-to-one map for each sequence of digits and letters and a key; signs don't matter, so a
    number written with other blanks or hyphens gets the same digits."""
    shape = [10 if c.isdigit() and c.isascii() else 26 if "A" <= c <= "Z" or "a" <= c <= "z" else 0 for c in s]
    value, size = 0, 1
    for c, n in zip(s, shape):
        if n:
            value = value * n + (int(c) if n == 10 else ord(c.upper()) - 65)
            size *= n
    value = permute_number(value, size, key, tag + "".join("9" if n == 10 else "A" for n in shape if n), back=back)
    out = []
    for c, n in zip(reversed(s), reversed(shape)):
        if n:
            value, d = divmod(value, n)
            out.append(str(d) if n == 10 else chr((97 if c.islower() else 65) + d))
        else:
            out.append(c)
    return "".join(reversed(out))


def permute_phone(s: str, key: bytes, back: bool = False) -> str:
    """A phone number with another national number; country code and trunk zero stay, so forms with and
    without them stay linked."""
    lead = PHONE_LEAD.match(s).end()
    return s[:lead] + permute_text(s[lead:], key, "PHONE", back)


def permute_date(d: dt.date, key: bytes, first: dt.date = dt.date(1900, 1, 1), days: int = 73_000, back: bool = False) -> dt.date:
    """Another valid date of the same range of days, one to one; dates outside the range stay."""
    n = (d - first).days
    return first + dt.timedelta(permute_number(n, days, key, "date", back=back)) if 0 <= n < days else d


def placeholder(kind: str, surface: str, key: bytes) -> str:
    if kind == "PHONE":
        return f"[PHONE:{permute_phone(surface, key)}]"
    if kind == "IDNUM":
        return f"[IDNUM:{permute_text(surface, key, kind)}]"
    return f"[{kind}:{hashlib.blake2b(surface.lower().encode(), key=key, digest_size=16).hexdigest()}]"


# ---- operators ----

_made: dict = {}


def flatten(text: str) -> str:
    """Each run of blanks, tabs and line breaks as one blank."""
    t = text.replace("\r", " ").replace("\n", " ").replace("\t", " ")
    while "  " in t:
        t = t.replace("  ", " ")
    return t


def _finder(parts) -> Finder:
    key = hash(parts)
    if key not in _made:
        _made.clear()
        _made[key] = Finder(list(parts))
    return _made[key]


def _parts(name_parts: DataFrame) -> tuple:
    rows = name_parts.select("name_part", "kind").dropna().distinct().limit(MOST_PARTS + 1).collect()
    if len(rows) > MOST_PARTS:
        raise ValueError("the name table is too large to send to the workers")
    return tuple(sorted((r[0], r[1]) for r in rows))


def found(docs: DataFrame, name_parts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, surface): one row for each distinct personal datum of a text.

    kind is EMAIL, PHONE, IDNUM, ADDRESS or NAME; surface is the datum as written with each run of
    blanks and line breaks as one blank. Masked data, initials alone, firms, places and cited cases
    aren't found. Null and empty texts give no rows; other columns are ignored. Every text is looked
    at as a whole.
    """
    parts = _parts(name_parts)

    def run(batches):
        find = _finder(parts).find
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                ids, kinds, surfaces = [], [], []
                for i, t in zip(batch.column(0).slice(at, SLICE).to_pylist(), batch.column(1).slice(at, SLICE).to_pylist()):
                    if t:
                        flat = flatten(t)
                        for k, s in {(k, flat[a:z]) for a, z, k in find(flat)}:
                            ids.append(i), kinds.append(k), surfaces.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(kinds, pa.string()), pa.array(surfaces, pa.string())], names=["doc_id", "kind", "surface"])

    t = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, kind string, surface string")


def redacted(docs: DataFrame, name_parts: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_found): each text with its personal data replaced by typed placeholders.

    Everything else stays as it was, line breaks included. Equal data get equal placeholders in all
    documents under one `key`. Null texts stay null, with n_found 0.
    """
    parts, secret = _parts(name_parts), hashlib.blake2b(key.encode(), digest_size=32).digest()

    def run(batches):
        find = _finder(parts).find
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                texts, counts = [], []
                for t in batch.column(1).slice(at, SLICE).to_pylist():
                    spans = []
                    if t:
                        flat = flatten(t)
                        spans = find(flat)
                    if spans:
                        # place of each kept character in the text as written
                        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                        blank = (c == 32) | (c == 9) | (c == 13) | (c == 10)
                        place = np.flatnonzero(~(blank & np.concatenate([[False], blank[:-1]])))
                        out, end = [], 0
                        for a, z, k in spans:
                            out += [t[end : place[a]], placeholder(k, flat[a:z], secret)]
                            end = int(place[z - 1]) + 1
                        t = "".join([*out, t[end:]])
                    texts.append(t), counts.append(len(spans))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, SLICE), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_found"])

    t = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, text string, n_found int")
