"""Composed texts with personal data, from which the trees of ``pii`` are trained.

Nothing here is a sentence: what surrounds a datum is drawn word by word, from
function words, words of a public vocabulary and invented words, in six languages,
with or without a word that announces the datum. Decoys are drawn the same way from
forms that a generator takes for a datum: places, firms, headings, numbers of
orders, dates, prices, versions.
"""

from __future__ import annotations

import random

from .quality import COMMON_WORDS, MORE_WORDS

#: Frequent given names of six languages.
GIVEN = (
    "james john robert michael william david richard joseph thomas charles daniel matthew mark paul steven andrew george kevin brian edward mary patricia jennifer linda elizabeth susan jessica sarah karen nancy margaret lisa emily emma olivia grace helen alice hannah rachel "
    "peter hans klaus jürgen wolfgang stefan andreas uwe lukas felix moritz ursula monika sabine petra claudia birgit heike anja katrin julia lena greta "
    "jean pierre michel philippe alain nicolas julien antoine françois luc marie nathalie isabelle sylvie catherine camille chloé manon claire élodie "
    "josé antonio juan francisco javier carlos miguel alejandro luis pablo carmen ana isabel dolores pilar lucía elena sofía marta raquel "
    "joão pedro tiago rui paulo nuno bruno manuel joaquim rafael maria inês beatriz mariana catarina teresa fernanda luísa rita sónia "
    "jan kees pieter johan willem hendrik sander joost maarten dirk anna johanna anneke marieke femke lotte sanne ingrid saskia mieke "
    "ivan olga natalia dmitri ali fatima ahmed mohammed yusuf aisha leila omar priya raj wei mei chen kenji yuki amina noah liam oscar leo max tom sam ben eva mia nora ida lars sven erik astrid karin"
)
#: Ends of family names, and words beside a capitalised word that make it a place, a firm or a date.
SURNAME_ENDS = "son sen sson mann berg stein bach feld hoff hofer meier meyer müller schmidt bauer ner ler ez az oz ado ini ski sky wicz vic ova ov ev ko yan ian ley ton ham ford wood stone worth well field brook land by quist holm strom dahl gaard sma stra inga eau ard ault ier aud oux eira ães inho ães ães tree lock wick shaw more".split()
PLACES = (
    "street road avenue lane square park bridge river lake bay beach island islands harbor harbour port mountain hill valley city town village county state university college school museum hotel hospital church station airport market theatre theater stadium center centre garden gardens festival street north south east west new old san santa saint st los las upper lower great "
    "ltd inc corp llc gmbh ag company group bank club team united band records press times post news airlines league cup award prize day night morning week "
    "straße platz bahnhof stadt berg bad deutsche rue avenue gare ville côte calle plaza ciudad río praia rua cidade straat plein gracht kerk"
).split()
CALENDAR = "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday english french german spanish portuguese dutch american european british italian christmas easter januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag".split()

_SYLL = "an ar bel bri cor dar del dor el en er fal fen gar gri hal han il in jor kal ken lar lin lo mar mel mi nad nor o os pel per ra ren ro sa sel sil ta tel tor ul va vel vin wal win ya yor sch ch th gu pra stra kle bo du fi he ju ku ne pi qua ri so ti ve zo".split()
_CITIES = "London Paris Berlin Madrid Lisboa Amsterdam Hamburg Lyon Porto Sevilla Boston Chicago Texas Bremen Toulouse Utrecht Valencia Braga Dublin Oslo".split()


def digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def fill(r: random.Random, form: str) -> str:
    """A form with % for a digit and ? for a capital letter."""
    return "".join(r.choice("0123456789") if c == "%" else r.choice("ABCDEFGHJKLMNPRSTUWXYZ") if c == "?" else c for c in form)


class Words:
    """Draws words of a language: function words, words of a vocabulary, invented ones."""

    def __init__(self, r: random.Random, common: list[str]):
        self.r, self.common = r, common
        self.function = {k: v.split() for k, v in COMMON_WORDS.items()}
        self.given = GIVEN.split()

    def invented(self, least: int = 1) -> str:
        return "".join(self.r.choice(_SYLL) for _ in range(self.r.choice((least, 2, 2, 3))))

    def one(self, lang: str) -> str:
        k = self.r.random()
        if k < 0.5:
            return self.r.choice(self.function[lang])
        w = self.r.choice(self.common) if self.common and k < 0.88 else self.invented()
        return w.capitalize() if lang == "de" and self.r.random() < 0.4 else w

    def some(self, lang: str, n: int) -> list[str]:
        """Words in a row; capitalised ones hardly ever stand side by side."""
        out: list[str] = []
        for _ in range(n):
            w = self.one(lang)
            out.append(w.lower() if out and out[-1][0].isupper() and self.r.random() < 0.9 else w)
        return out

    def proper(self) -> str:
        """A capitalised word of any kind."""
        k = self.r.random()
        return (self.r.choice(_CITIES) if k < 0.2 else self.r.choice(self.common) if self.common and k < 0.9 else self.invented()).capitalize()

    def content(self) -> str:
        return self.r.choice(self.common) if self.common and self.r.random() < 0.93 else self.invented()

    def first(self) -> str:
        return (self.r.choice(self.given) if self.r.random() < 0.65 else self.invented(2) + self.r.choice(("", "", "a", "o", "e"))).capitalize()

    def last(self) -> str:
        k = self.r.random()
        stem = self.r.choice(self.common) if k > 0.92 and self.common else self.invented(1 if k < 0.25 else 2)
        return (stem + (self.r.choice(SURNAME_ENDS) if k < 0.25 else "")).capitalize()

    def name(self) -> str:
        r, f, l = self.r, self.first(), self.last()
        if r.random() < 0.15:
            l += f"-{self.last()}"
        if r.random() < 0.05:
            f += f"-{self.first()}"
        k = r.random()
        s = f"{f} {r.choice('ABCDEFGHJKLMNPRSTW')}. {l}" if k < 0.15 else f"{l}, {f}" if k < 0.3 else f"{l}, {f} {r.choice('ABCDEFGHJKLMNPRSTW')}." if k < 0.33 else f"{f} {l}"
        return s.upper() if r.random() < 0.07 and "-" not in s else s

    def email(self) -> tuple[str, bool]:
        """An address, and whether only an announcing word tells it from plain words."""
        r, f, l = self.r, self.invented(), self.invented()
        local = r.choice((f"{f}.{l}", f"{f[0]}{l}", f"{l}_{digits(r, 2)}", f"{f}+{self.invented()}", f"{f}{digits(r, r.choice((1, 2, 3)))}", f"{f}_{l}", f"{l}-{f}", f, f"{f[0]}.{l}", r.choice(self.given)))
        host = [*r.choice((["mail"], ["post"], ["web", "mail"], [self.invented()], ["uni", self.invented()])), r.choice("example test com org net de fr es pt nl co.uk info eu".split())]
        at, dot = r.choice((("@", "."),) * 7 + ((" @ ", "."), (" [at] ", " [dot] "), (" (at) ", "."), (" (at) ", " (dot) "), (" at ", " dot "), (" at ", "."), (" at ", "."), ("[at]", "[dot]"), ("[at]", "."), ("(at)", "."), ("{at}", "{dot}"), (" {at} ", " {dot} "), (" {at} ", "."), (" (at) ", " dot ")))
        bare = (at, dot) == (" at ", ".") and local.isalpha()
        s = local + at + dot.join(host)
        k = r.random()
        return (s.upper() if k < 0.1 else local.title() + at.upper() + dot.upper().join(host) if k < 0.2 else s), bare

    def phone(self) -> str:
        r = self.r
        cc = r.choice(("1", "44", "49", "33", "34", "351", "31", "39", "41", str(r.randrange(20, 999))))
        return fill(r, r.choice((
            f"+{cc} %% %%%% %%%%", f"+{cc}-%%%-%%%%-%%%", "+1 (%%%) %%%-%%%%", "(%%%) %%%-%%%%", "%%%-%%%%", "%%%-%%%-%%%%", "1-%%%-%%%-%%%%", "0%%%% %%%%%%", "0%% %%%%%%%%", "0%%%/%%%%%%%", "0%% / %%%%%%%", "0%%%% %%%%%", "0%%% %%%%%%%%",
            "0% %% %% %% %%", f"+{cc}%%%%%%%%%", "+1%%%%%%%%%%", f"+{cc} %% %%%%% %%%", f"+{cc} %%% %%%%%%%", f"+{cc} %%% %%% %%%", f"+{cc} (0) %% %%%%%%", "0%%-%%%-%%%%", "0%%.%%%.%%%%", "0%%%-%%%%%%%", "06 %%%%%%%%", "06-%%%%%%%%", "0%%%%%%%%%", f"+{cc} % %% %% %% %%", "9%% %%% %%%", "6%% %% %% %%", "%%%.%%%.%%%%",
        )))

    def id_number(self) -> tuple[str, bool]:
        """A number, and whether only its label tells it from others."""
        form = self.r.choice(("%%%-%%-%%%%", "%%% %% %%%%", "??%%%%%%?", "?? %% %% %% ?", "%%%%%%%%-?", "%%%%%%%%?", "?%%%%%%%%", "??%%%%%%%", "?%%%%%%%", "%%%%%%%%%", "?%%%%%%%?", "%%%%%%%%", "?%%%%%%%?", "%% %%% %%% %%%", "%%%%%%%%%%%", "?%%??%%%%"))
        return fill(self.r, form), form not in ("%%%-%%-%%%%", "??%%%%%%?", "?? %% %% %% ?", "%%%%%%%%-?")

    def address(self) -> str:
        r = self.r
        no = str(r.randrange(1, 400)) + (r.choice("abcAB") if r.random() < 0.3 else "")
        word = self.last if r.random() < 0.7 else self.proper
        k = r.random()
        if k < 0.45:
            s = f"{no} {word()} {r.choice('Street Road Rd Lane Avenue Ave Court Drive Close St Terrace Place Way'.split())}"
        elif k < 0.62:
            s = f"{word()}{r.choice('straße strasse weg allee gasse platz ring ufer straat laan plein gracht kade'.split())} {no}"
        elif k < 0.82:
            s = f"{no}{r.choice(('', '', ' bis', ','))} {r.choice('rue avenue boulevard place chemin impasse quai'.split())} {r.choice(('de la ', 'du ', 'des ', 'de ', ''))}{' '.join(word() for _ in range(r.choice((1, 1, 2))))}"
        else:
            s = f"{r.choice('calle Calle avenida Avenida rua Rua travessa paseo Paseo plaza'.split())} {r.choice(('de la ', 'del ', 'da ', 'dos ', 'de ', '', ''))}{' '.join(word() for _ in range(r.choice((1, 1, 2))))}{r.choice((' ', ', '))}{no}"
        return s.lower() if r.random() < 0.2 else s

    # ---- forms that are no personal data --------------------------------------

    def heading(self, lang: str, n: int) -> str:
        words = [self.r.choice(self.function[lang]) if self.r.random() < 0.4 else self.content() for _ in range(n)]
        return " ".join(w.upper() for w in words) if self.r.random() < 0.4 else " ".join(w.capitalize() for w in words)

    def no_name(self, lang: str) -> str:
        """Capitalised words that name no person."""
        r, p, place = self.r, self.proper(), self.r.choice(PLACES).capitalize()
        article = r.choice({"en": ["the", "a", "our", "this", "every"], "de": ["der", "die", "das", "im", "eine"], "fr": ["le", "la", "une", "les"], "es": ["el", "la", "una", "los"], "pt": ["o", "a", "um", "os"], "nl": ["de", "het", "een"]}[lang])
        start = r.choice(self.function[lang] if r.random() < 0.5 else MORE_WORDS.split()).capitalize()
        return r.choice((
            lambda: f"{article} {p} {self.proper()}{r.choice(('s', '', ''))}", lambda: f"{article} {p} {place}", lambda: f"{p} {place}", lambda: f"{place} {p}", lambda: f"{start} {self.first()} {self.one(lang)}", lambda: f"{start} {p} {self.one(lang)}", lambda: f"{start} {self.invented().capitalize()}{r.choice(('i', 's', 'er', ''))} {self.one(lang)}", lambda: f"{article.capitalize()} {p} {self.one(lang)}",
            lambda: f"{self.first()} {self.one(lang).lower()} {self.first()}", lambda: f"{self.first()}, {self.first()} {r.choice(('and', 'und', 'et', 'y', 'e', 'en'))} {self.first()}", lambda: f"{r.choice(CALENDAR).capitalize()} {p}", lambda: f"{p} {r.choice(CALENDAR).capitalize()}", lambda: f"{r.choice(_CITIES)}, {r.choice(_CITIES)}", lambda: f"{r.choice(_CITIES)} {self.content().capitalize()}",
            lambda: self.heading(lang, r.randrange(2, 6)), lambda: f"{self.one(lang).capitalize()}. {start} {self.one(lang)}", lambda: f"{start}: {p} {self.one(lang)}", lambda: self.first(), lambda: f"@{self.first()} {p}", lambda: f"#{p} {start} {self.one(lang)}", lambda: f"{p} {p}{r.choice(('ers', 's', 'e'))}", lambda: f"{article} {p} {self.first()} {place}",
            lambda: f"{self.content().capitalize()} {self.content().capitalize()}", lambda: f"{self.content()} {self.content()}".upper(), lambda: f"{self.content()} {self.invented()}".upper(),
        ))()

    def no_number(self, lang: str) -> str:
        """Numbers of other things, with or without a word that says so."""
        r, w = self.r, lambda: self.one(lang)
        n = r.choice((6, 7, 8, 8, 9, 9, 10, 10, 11, 12))
        label = r.choice("order invoice ticket parcel tracking item model serial build part Bestellung Rechnung Auftrag commande facture pedido factura encomenda fatura bestelling factuur Sendung ref".split())
        mark = r.choice((" ", " # ", " no. ", " #", ": ", " number "))
        return fill(r, r.choice((
            f"{label}{mark}{'%' * n}", f"{label}{mark}??{'%' * r.choice((6, 8, 9))}", f"{label}{mark}??%%%%%%%%%", f"{w()} ??%%%%%%%%% {w()}", f"{label}{mark}%%%-%%%%%%%", f"{r.choice(('isbn', 'ISBN', 'ISBN:'))} 97%-%-%%%%%-%%%-%", "isbn 97%-%-%%%%%%-%%-%", "ISBN 97%%%%%%%%%%%", f"%%.%%.20%% {w()}", "20%%-%%-%%", f"{w()} 19%%-20%%",
            f"19%% {w()} 20%%", "%%:%%", f"%,%%%.%% {w()}", "%%.%%%,%% €", "$%,%%%,%%%", f"version %.%%.% {w()}", "v%.%.%%", f"%%-%% {w()} %%-%%", f"{w()} %-% {w()} %%", f"%% {w()} %%% {w()} %%%%", f"% {w()} {r.choice(('street', 'roads', 'way', 'place', 'hill'))} {w()}", f"%% {w()} {w()} {r.choice(('row', 'place', 'way', 'close', 'drive', 'court', 'lane'))}",
            f"page %%% {w()}", f"{w()} %%%% {w()}", "%%%%%%%%%%", f"{w()} %%,%%%,%%% {w()}", f"%%/%%/20%% {w()}", f"%%° %%' {w()}", f"{w()} %.%%%.%%%", f"?%% {w()}", f"{w()} %%{r.choice(('min', 'kg', 'km', 'h', 'th', 'pm', 'x'))}", f"flight ??%%%% {w()}", "192.168.%.%%", f"%%%% %%%% {w()}", f"room %%% {w()}", f"platz % {w()}", f"le %% rue {w()}",
        )))

    def no_address(self, lang: str) -> str:
        """Words beside "at" and a dot that are no address."""
        r, w = self.r, self.one(lang)
        host = r.choice((self.invented(), "example", "links", "www.example", "shop.example", f"{self.invented()}.{self.invented()}"))
        end = r.choice("com org net example test de".split())
        head = r.choice("look meeting was home met laughed stay sale posted works sold order sign shop buy read see register watch listen".split())
        return r.choice((f"{head} at {host}.{end} {w}", f"{head} {w} at {host}.{end}", f"{head} at {w}.{self.one(lang)} {w}", f"{head} at {self.proper()}.{self.one(lang)} {w}", f"{head} at {host} dot {w}", f"{w} at www.{host}.{end}", f"{w} at {w}.{w}"))


#: Words after which, or before which, a datum of a type often stands; titles of persons.
ANNOUNCE = {
    "name": "name is|my name is|is called|called|named|name:|met|spoke to|ask|ask for|contact|dear|hello|signed|signed,|regards|thanks,|by|from|with|author|Mr.|Mrs.|Ms|Dr.|Prof.|Herr|Frau|Monsieur|Mme|señor|señora|Sr.|Sra.|dhr.|mevrouw|cc|an|von|mit|par|avec|de|por|com|van|door|is|am|heiße|heißt|appelle|llamo|chamo|heet|attn",
    "phone": "call|tel|Tel.|tel:|phone|phone:|text|whatsapp|fax|mobile|cell|ring|Telefon|Handy|Telefonnummer|unter|Nummer|appelez|téléphone|au|numéro|llama al|teléfono|móvil|número|ligue|telefone|telemóvel|para|bel|telefoon|nummer|on|at|number|reach me at",
    "id_number": "ssn|SSN|ssn:|passport|passport no.|passport number|social security number|national insurance no|national insurance number|national id|id number|identity card|my id is|id:|tax id|license|driving licence|Reisepass|Passnummer|Personalausweis|Ausweis|Ausweisnummer|Steuernummer|Steuer-ID|Sozialversicherungsnummer|Führerschein|passeport|passeport n°|numéro de sécurité sociale|carte d'identité|numéro fiscal|permis|DNI|dni|NIE|NIF|pasaporte|número de identidad|cédula|seguridad social|cartão de cidadão|passaporte|CPF|contribuinte|número fiscal|BSN|bsn|paspoort|paspoortnummer|burgerservicenummer|rijbewijs|identiteitskaart",
    "address": "at|lives at|live at|address|address:|visit|to|off at|house at|moved to|wohnt|wohnt in der|Adresse:|in der|habite|au|adresse|adresse :|vive en|en|dirección|mora na|na|morada|woont op|aan de|adres|op|send it to|deliver to|near|von",
    "email": "mail|email|e-mail|write to|reach|contact|contact:|send it to|at|an|E-Mail|à|écrivez à|adresse|correo|escribe a|para|escreva para|naar|stuur het naar|via|mailto:",
}
AFTER_ID = ("as my national id", "as passport number", "is my ssn", "is my passport", "als Ausweisnummer", "as my id", "is the id number", "as tax id")
#: What stands before or after a phone number without being part of it.
HEADS = "%%.%%.20%%|20%%-%%-%%|at %%:%%|in 20%%|flat %%|room %%%|% x|%%".split("|")
TAILS = "%nd floor|%th floor|%pm|%am|%x a day|%%h|24h|%rd|%% times|% of us|20%%-%%-%%|20%%-%%-%% at %%:%%|%%.%%.20%%|%%/%%/20%%|%%:%%|%% w|%%% w|% w w|20%%|%%min|%kg".split("|")


def compose(n: int, seed: int = 5, common: list[str] | None = None, names_only: bool = False) -> list[tuple[str, set[tuple[str, str]]]]:
    """(text, {(type, datum)}) of ``n`` composed texts; ``common`` are lower-case words of a vocabulary.

    With ``names_only`` names and what looks like names are all that the texts hold.
    """
    r = random.Random(seed)
    w = Words(r, common or [])
    types, langs = list(ANNOUNCE), list(COMMON_WORDS)
    out = []
    for _ in range(n):
        parts, gold, lang = [], set(), r.choice(langs)
        plain = r.random() < 0.12  # a heading: no datum, every word capitalised
        for _ in range(r.choice((1, 1, 2, 3, 4))):
            left, right, k = w.some(lang, r.choice((0, 1, 2, 3, 5, 7))), w.some(lang, r.choice((0, 1, 2, 4, 6))), r.random()
            glue = " "
            if plain:
                core = w.one(lang)
            elif k < 0.45:
                t = "name" if names_only else r.choice([*types, "name", "name"])
                only_announced = False
                if t in ("email", "id_number"):
                    core, only_announced = w.email() if t == "email" else w.id_number()
                else:
                    core = {"name": w.name, "phone": w.phone, "address": w.address}[t]()
                gold.add((t, core))
                k = r.random()
                if only_announced or k < 0.55:
                    left = [*left, r.choice(ANNOUNCE[t].split("|"))] + (w.some(lang, 1) if r.random() < 0.12 and not only_announced else [])
                    if t == "id_number" and r.random() < 0.12:
                        left, right = left[:-1], [r.choice(AFTER_ID), *right]
                elif t == "name" and left and k < 0.8:
                    left[-1] += r.choice((",", ":", ".", " -", " und", " and", " et", " y", " e", " en"))
                if t == "phone" and r.random() < 0.25:
                    beside = lambda forms: [x if x != "w" else w.one(lang) for x in fill(r, r.choice(forms)).split(" ")]
                    left, right = (left + beside(HEADS) if r.random() < 0.25 else left), (beside(TAILS) + right if r.random() < 0.75 else right)
                elif right and r.random() < 0.3:
                    glue = r.choice((", ", ". ", "! ", " - ", ") ", "; ", "'s ")) if t == "name" else r.choice((", ", ". ", "! ", " - ", ") ", "; ", "? "))
                if t == "email" and r.random() < 0.08:
                    core_shown = f"<{core}>"
                    parts.append(" ".join([*left, core_shown, *right]))
                    continue
            elif k < (0.86 if names_only else 0.66):
                core = w.no_name(lang)
            elif k < 0.86:
                core = w.no_number(lang)
            elif k < 0.91:
                core = w.no_address(lang)
            else:
                core = w.one(lang)
            s = glue.join([" ".join([*left, core]), " ".join(right)]) if right else " ".join([*left, core])
            if r.random() < 0.5 and left:
                s = s[:1].upper() + s[1:]
            parts.append(s + r.choice((".", ".", "!", "", "!!", "...", "?")))
        text = r.choice((" ", " ", " ", "\n", " | ", " - ", " ; ")).join(parts)
        if plain:
            text = text.title() if r.random() < 0.6 else text.upper()
        out.append((text, gold))
    return out
