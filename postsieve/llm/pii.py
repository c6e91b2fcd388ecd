"""Personal information inside free text.

High-recall generators propose spans of five types, which may overlap; boosted
trees score each span by its format and its context; a threshold per type,
calibrated on held-out examples, selects; of overlapping selections the best one
stays. The rest of the text is untouched. Numbers that touch a phone number are
told from it by the trees: every run of its digit groups is a candidate.

The trees are trained in place on TRAIN_TEXTS texts composed word by word
(``pii_texts``) with a fixed seed, so no row of the corpus is needed and every worker
gets the same model. What they know of language is general: lists of given names,
ends of family names, announcing words, and the vocabularies of public tokenizers,
in which common words stand in lower case and proper names only capitalised
(without their files those features are absent, in training as in use).

Defined cases: null texts stay null and hold nothing; empty texts stay empty;
first names alone, handles, places, order and version numbers, ISBNs, scores,
times and prices are not selected; equal scores go to the earlier, then the
longer span; texts are read whole; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pii_texts
from .boost import Boosted
from .encode import TOKENIZERS
from .quality import COMMON_WORDS, MORE_WORDS

TYPES = ("email", "phone", "id_number", "address", "name")
TRAIN_TEXTS = 8000
TRAIN_NAMES = 9000  # more texts for names, the hardest type
VOCABULARIES = tuple(f"{TOKENIZERS}/{f}" for f in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"))
MAX_DESCRIBED = 10_000  # candidates described at once, bounds the memory of a long text
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

#: Words that rule out a type, titles, and street words.
DECOY_CUES = "order tracking version isbn room page section paid scores score floor posted from invoice item model build chapter track flight ticket serial edition part level release shipped match years since cost price total parcel ref bestellung rechnung auftrag sendung commande facture pedido factura encomenda fatura bestelling factuur"
TITLES = "mr mrs ms miss dr prof herr herrn frau m mme mlle monsieur madame sr sra srta dhr mevr mevrouw meneer mw señor señora senhor senhora don doña dona sir madam"
STREETS = "street st road rd lane ln avenue ave court ct drive close crescent square way terrace boulevard blvd place row hill"
STREET_ENDS = "straße strasse str weg allee gasse platz ring damm ufer straat laan plein kade gracht"
STREET_STARTS = "rue avenue boulevard place chemin allée impasse quai calle avenida paseo plaza carrer rua travessa praça"
PARTICLES = "de du des la le les l' d' del los las da do das dos el e y et"

_FUNCTION = {w for ws in (*COMMON_WORDS.values(), MORE_WORDS) for w in ws.split()}
_CUE = {k: {w for w in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", v.lower()) if w not in _FUNCTION} for k, v in pii_texts.ANNOUNCE.items()}
_CUE["decoy"] = set(DECOY_CUES.split())
_TITLE = set(TITLES.split())
_ARTICLE = set("the a an this that our their these those der die das ein eine le la les un une el los las o os as um uma de het een".split())

#: Words before an address, ends of host names, and words that stand before "at" and a place.
_MAIL_CUE = set("mail email e-mail mailto write reach contact send address mailadresse correo courriel schreiben écrivez escribe escreva adresse naar an".split())
_DOMAIN = set("com org net edu gov info io eu example test de fr es pt nl uk us at be br ch ca au it mx ar".split())
_AT_HEADS = set("look meeting met meet arrived stay stayed seen works worked party laughed shouted sale lunch dinner here there them him them sold posted login back still".split())

_CAP = r"[A-ZÀ-ÖØ-Þ](?:['’][A-Z])?[a-zß-öø-ÿ]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?"
_UP = r"[A-ZÀ-ÖØ-Þ]{2,}(?:-[A-ZÀ-ÖØ-Þ]{2,})?"
_AT = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
EMAIL = re.compile(rf"(?<![\w@.+-])[a-z0-9][\w.+-]*{_AT}(?P<host>[a-z0-9][\w-]*)(?:{_DOT}[a-z0-9][\w-]*)+", re.I)
MAYBE_EMAIL = re.compile(rf"{_AT}[a-z0-9][\w-]*{_DOT}[a-z0-9]", re.I)  # a part of EMAIL
PHONE = re.compile(r"(?<![\w.,:/+#-])(?:\+\d++|\(\+?\d{1,5}\)|\d++)")
PHONE_GROUP = re.compile(r"(?:[ .\-/]\(?|\()\d++\)?")
PHONE_GROUPS = 7
ID = re.compile(r"(?<![\w.,:/+#-])(?:[A-Z]{1,3}[ -]?)?\d(?:[ -]?\d){4,13}(?:[ -]?[A-Z]{1,2})?(?![\w-])")
ADDRESS = (
    re.compile(rf"(?<![\w.,:/+#-])\d{{1,4}}[a-z]?,? (?:[^\W\d_]+[ -]){{1,3}}?(?:{'|'.join(STREETS.split())})\b", re.I),
    re.compile(rf"(?<![\w.,:/+#-])\d{{1,4}}(?: ?(?:bis|ter|[a-z])\b)?,? (?:{'|'.join(STREET_STARTS.split())})\b(?: (?:{'|'.join(PARTICLES.replace(chr(39), '').split())})\b| [dl]['’])*(?: ?[^\W\d_]+){{1,3}}", re.I),
    re.compile(rf"\b[^\W\d_]{{2,}}(?:-[^\W\d_]+)*-?(?:{'|'.join(STREET_ENDS.split())})\.? \d{{1,4}}(?: ?[a-z]\b)?", re.I),
    re.compile(rf"\b[A-ZÀ-Þ][^\W\d_]+ (?:{'|'.join(w.capitalize() for w in STREET_ENDS.split())})\.? \d{{1,4}}(?: ?[a-zA-Z]\b)?"),
    re.compile(rf"\b(?:{'|'.join(STREET_STARTS.split())})(?: [^\W\d_]+){{1,4}},? \d{{1,4}}(?: ?[a-z]\b)?", re.I),
)
NAME = re.compile(rf"\b(?:{_CAP},? {_CAP}|{_CAP}(?:,)? [A-ZÀ-Þ]\. {_CAP}|{_CAP}, {_CAP} [A-ZÀ-Þ]\.|{_UP},? (?:[A-ZÀ-Þ]\. )?{_UP})(?![\w-])")
_DIGIT = re.compile(r"\d")
_AT_WORD = re.compile(r"at[\s\])}]", re.I)
_WORD_CHAR = re.compile(r"\w")
_GROUPS_LEFT = re.compile(r"(?:\+?\(?\d+\)?[ .\-/]\(?)+$")
_GROUPS_RIGHT = re.compile(r"(?:(?:[ .\-/]\(?|\()\d+\)?)+")
_COUNTED = re.compile(r" (?:\d+(?::\d|[^\W\d])|\d{4}-\d\d-\d\d\b|\d\d?[./]\d\d?[./]\d{4}\b)")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_START = re.compile(r"(?:^|[.!?:;|>\n\r]|--|\s/|\s-)\s*[\"'“‘(\[]*$")


def propose(text: str) -> list[tuple[int, int, int]]:
    """(type, start, end) of every candidate; spans may overlap."""
    out = []
    if ("@" in text or _AT_WORD.search(text)) and MAYBE_EMAIL.search(text):
        at = 0
        while m := EMAIL.search(text, at):
            out.append((0, m.start(), m.end()))
            at = m.start("host")  # a plain word and "at" may stand before an address
    if _DIGIT.search(text):
        for m in PHONE.finditer(text):  # groups may belong to the next word or number: every run of them is proposed
            s, e, n = m.start(), m.start(), 0
            for _ in range(PHONE_GROUPS):
                n += sum(c.isdigit() for c in m.group())
                e = m.end()
                if n >= 6 and not _WORD_CHAR.match(text, e):
                    out.append((1, s, e))
                if not (m := PHONE_GROUP.match(text, e)):
                    break
        for m in ID.finditer(text):
            s, label = m.start(), m.group().split(" ")[0]
            out.append((2, s + len(label) + 1 if label.lower() in _CUE["id_number"] else s, m.end()))
        for k, p in enumerate(ADDRESS):
            for m in p.finditer(text):
                s, e = m.span()
                out.append((3, s, e))
                if k == 1:  # the name of the street may be shorter than three words
                    while text.rfind(" ", s, e) > s:
                        e = text.rfind(" ", s, e)
                        if len(text[s:e].split()) < 3:
                            break
                        out.append((3, s, e))
    at = 0
    while m := NAME.search(text, at):
        out.append((4, m.start(), m.end()))
        at = text.find(" ", m.start()) + 1  # the second word may begin the next candidate
    return out


def _context(words: list[str], cue: set[str]) -> float:
    """Distance of the nearest cue word, 9 if none is near."""
    for d, w in enumerate(words):
        if w in cue:
            return float(d)
    return 9.0


def _beside(span: str, left: str, right: str) -> list[float]:
    """Digit groups that touch a phone candidate: they may be the rest of it or another number."""
    l, r = _GROUPS_LEFT.search(left), _GROUPS_RIGHT.match(right)
    before, after = re.findall(r"\d+", l.group()) if l else [], re.findall(r"\d+", r.group()) if r else []
    inner = re.findall(r"[ .\-/(]+", span[1:])
    return [
        float(sum(map(len, before))),
        float(len(before)),
        float(bool(l) and l.group()[0] in "+0("),
        float(sum(map(len, after))),
        float(len(after)),
        float(len(after[0])) if after else 0.0,
        float(bool(_COUNTED.match(right))),
        float(bool(inner) and right[:1] == inner[-1][:1]),
        float(len(set(inner))),
    ]


def _address_form(span: str, before: list[str]) -> list[float]:
    """What tells a written address from a word, "at" and words joined by a dot."""
    low = span.lower()
    local = re.match(r"[\w.+-]*", low).group()
    return [
        _context(before, _MAIL_CUE),
        float(low.replace("]", " ").replace(")", " ").replace("}", " ").replace(".", " ").split()[-1] in _DOMAIN),
        float(local in _FUNCTION or local in _AT_HEADS),
        float(bool(re.match(r"[\w.+-]*\sat\s", low))),
    ]


class Lexicon:
    """What is known of single words: common ones, proper ones, given names."""

    def __init__(self, paths: tuple[str, ...] = VOCABULARIES):
        tokens = {t for p in paths if Path(p).exists() for line in open(p, "rb") if (t := base64.b64decode(line.split()[0]).decode("utf-8", "ignore")) and t[0] == " "}
        words = {t[1:] for t in tokens if len(t) > 3 and t[1:].isalpha()}
        self.common = {w for w in words if w.islower()}
        self.proper = {w.lower() for w in words if w.istitle()} - self.common
        self.given = {_bare(w) for w in pii_texts.GIVEN.split()}

    def plain(self) -> list[str]:
        """Common words in Latin letters, sorted."""
        return sorted(w for w in self.common if len(w) > 3 and re.fullmatch("[a-zß-öø-ÿœ]+", w))

    def __call__(self, word: str) -> tuple[float, ...]:
        return _word_form(self, word)


def _bare(word: str) -> str:
    """Lower case without accents."""
    return word.lower() if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


_PLACE, _DATED, _ENDS = set(pii_texts.PLACES), set(pii_texts.CALENDAR), tuple(sorted(set(pii_texts.SURNAME_ENDS)))


@lru_cache(maxsize=100_000)
def _word_form(lexicon: Lexicon, word: str) -> tuple[float, ...]:
    low = word.lower()
    parts = re.split("[-'’]", low)
    return (
        float(_bare(parts[0]) in lexicon.given),
        float(low in lexicon.common or low in _FUNCTION),
        float(low in lexicon.proper),
        float(low in _FUNCTION),
        float(low.endswith(_ENDS)),
        float(low in _PLACE or low.rstrip("s") in _PLACE),
        float(low in _DATED),
        float(len(low)),
    )


def _name_form(words: list[str], before: list[str], after: list[str], left: str, right: str, lexicon: Lexicon) -> list[float]:
    """What tells a person's name from other capitalised words: the words, their neighbours, the capitals around."""
    near = _WORD.findall(left)[-5:] + _WORD.findall(right)[:4]
    last = left.rstrip(" \"'“‘(")[-1:]
    none = (0.0,) * 8
    return [
        *lexicon(words[0]),
        *lexicon(words[-1]),
        *(lexicon(before[0])[:7] if before and last.isalnum() else none[:7]),
        *(lexicon(after[0])[:7] if after and right[:1] == " " else none[:7]),
        float(sum(w[:1].isupper() for w in near) / len(near)) if near else 0.0,
        float(sum(w.isupper() and len(w) > 1 for w in near)),
        float(last in ",;"),
        float(last in ":-"),
        float(right[:2] in ("'s", "’s")),
        float(right[:1] in ",;:"),
        float(right[:1] in ".!?"),
        float(not right.strip()),
        float(left.rstrip()[-1:] in "@#" or left[-1:] in "@#&"),
        float(any(lexicon(w)[0] for w in re.findall(r"[A-ZÀ-Þ][^\W\d_]+", right[:16]))),
    ]


def _street_form(words: list[str], lexicon: Lexicon) -> list[float]:
    inner = [lexicon(w) for w in words if not w[0].isdigit()]
    low = [w.lower() for w in words]
    return [
        float(sum(x[1] for x in inner)),
        float(sum(x[3] for x in inner)),
        float(len(inner)),
        float(low[-1] in ("way", "place", "row", "hill", "close", "drive", "court", "square", "crescent", "st")),
        float(sum(w[:1].isupper() for w in words)),
    ]


def describe(text: str, cand: tuple[int, int, int], caps: float, lexicon: Lexicon) -> list[float]:
    """Format and context features of a candidate."""
    kind, s, e = cand
    span, left, right = text[s:e], text[max(0, s - 48) : s], text[e : e + 36]
    before = [w.lower() for w in _WORD.findall(left)][::-1][:6]
    after = [w.lower() for w in _WORD.findall(right)][:4]
    digits = re.findall(r"\d+", span)
    words = _WORD.findall(span)
    letters = sum(c.isalpha() for c in span)
    starts = bool(_START.search(left))
    first = text[e : e + 1]
    tail = words[-1] if words else ""
    return [
        caps,
        *(_context(before, _CUE[k]) for k in ("name", "phone", "id_number", "address", "email", "decoy")),
        *(_context(after, _CUE[k]) for k in ("id_number", "decoy")),
        float(starts),
        float(bool(before) and before[0] in _ARTICLE and not starts),
        float(bool(before) and before[0] in _TITLE),
        float(sum(map(len, digits))),
        float(len(digits)),
        float(max(map(len, digits), default=0)),
        float(len(digits[0])) if digits else 0.0,
        float(len(digits[-1])) if digits else 0.0,
        float(span[0] == "+"),
        float("(" in span),
        float(span[0] == "0"),
        float(letters),
        float(span.count("-")),
        float(span.count(" ")),
        float(bool(re.search(r"\b[A-Z]\.", span))),
        float("," in span),
        float(span.isupper()),
        float(len(words)),
        float(sum(w.lower() in _FUNCTION for w in words)),
        float(sum(w[:1].isupper() for w in words)),
        float(span[0].isdigit()),
        float(tail[:1].isupper()),
        float(bool(after) and (after[0] in _FUNCTION or not first.isspace())),
        float(bool(re.match(r"[ -]?[A-ZÀ-Þ][a-zß-ÿ]", right))),
        float(bool(re.search(r"[A-ZÀ-Þ][a-zß-ÿ]+ $", left)) and not starts),
        float("@" in span),
        float("[" in span or "(" in span or "{" in span),
        float(bool(re.search(r"\sdot\s", span, re.I))),
        float(bool(re.match(r"[\w.+-]*[\d._+-]", span))),
        float(span[:3] in ("978", "979")),
        float(words[0].lower() in _TITLE | _ARTICLE | _CUE["name"] if words else 0),
        float(bool(re.match(r"\s*(?:\w+\s+){0,2}(?:who|when|and i|and works|moved|lives)\b", right, re.I))),
        *(_beside(span, left, right) if kind == 1 else ()),
        *(_address_form(span, before) if kind == 0 else ()),
        *(_street_form(words, lexicon) if kind == 3 else ()),
        *(_name_form(words, before, after, left, right, lexicon) if kind == 4 else ()),
    ]


def caps_share(text: str) -> float:
    words = _WORD.findall(text)
    return sum(w[:1].isupper() for w in words) / len(words) if words else 0.0


class Model:
    """One boosted classifier and one threshold per type."""

    def __init__(self, texts: int = TRAIN_TEXTS, names: int = TRAIN_NAMES, vocabularies: tuple[str, ...] = VOCABULARIES) -> None:
        self.lexicon, partial = Lexicon(vocabularies), Lexicon(vocabularies)
        partial.given = set(sorted(partial.given)[::2])  # half of the given names stay unknown in training, as most are in use
        rows: list[list[tuple[list[float], bool]]] = [[] for _ in TYPES]
        plain = self.lexicon.plain()
        for text, gold in [*pii_texts.compose(texts, common=plain), *pii_texts.compose(names, seed=6, common=plain, names_only=True)]:
            caps = caps_share(text)
            for c in propose(text):
                rows[c[0]].append((describe(text, c, caps, partial), (TYPES[c[0]], text[c[1] : c[2]]) in gold))
        self.trees, self.cut = [], []
        for kind in rows:
            x, y = np.array([f for f, _ in kind]), np.array([g for _, g in kind], dtype=float)
            held = np.arange(len(y)) % 4 == 0
            b = Boosted(rounds=120, rate=0.15).fit(x[~held], y[~held])
            self.trees.append(b)
            self.cut.append(self._calibrate(b.score(x[held]), y[held]))

    @staticmethod
    def _calibrate(score: np.ndarray, y: np.ndarray) -> float:
        """Log-odds above which the held-out F1 is best, in the middle of the gap."""
        order = np.argsort(-score)
        tp = np.cumsum(y[order])
        f1 = 2 * tp / (np.arange(1, len(y) + 1) + y.sum())
        k = int(f1.argmax())
        s = score[order]
        return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) - 1e-9

    def select(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """(type, start, end, log-odds) of the selected spans of each text, by start."""
        cands = [(i, c) for i, t in enumerate(texts) if t for c in propose(t)]
        caps: dict[int, float] = {}
        by_type: list[list[tuple[int, tuple[int, int, int]]]] = [[] for _ in TYPES]
        for i, c in cands:
            by_type[c[0]].append((i, c))
        chosen: dict[int, list[tuple[float, int, int, int]]] = {}
        for k, own in enumerate(by_type):
            for at in range(0, len(own), MAX_DESCRIBED):
                part = own[at : at + MAX_DESCRIBED]
                x = np.array([describe(texts[i], c, caps[i] if i in caps else caps.setdefault(i, caps_share(texts[i])), self.lexicon) for i, c in part])
                score = self.trees[k].score(x) - self.cut[k]
                for (i, c), s in zip(part, score):
                    if s > 0:
                        chosen.setdefault(i, []).append((-round(float(s), 6), c[1], -c[2], k))
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        for i, spans in chosen.items():
            starts: list[int] = []
            kept = out[i]  # by start
            for s, a, e, k in sorted(spans):
                at = bisect.bisect(starts, a)
                if (not at or kept[at - 1][2] <= a) and (at == len(kept) or -e <= starts[at]):
                    starts.insert(at, a)
                    kept.insert(at, (k, a, -e, -s))
        return out


def redact(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    out, at = [], 0
    for k, s, e, _ in spans:
        out += (text[at:s], PLACEHOLDER[TYPES[k]])
        at = e
    return "".join(out) + text[at:]


def find(rows: DataFrame, model: Model) -> DataFrame:
    """(id, pii_type, pii): each datum of each text once, as written."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            hits = [(i, *x) for i, spans in enumerate(shared.value.select(texts)) for x in sorted({(TYPES[k], texts[i][s:e]) for k, s, e, _ in spans})]
            at = pa.array([h[0] for h in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([h[1] for h in hits], pa.string()), pa.array([h[2] for h in hits], pa.string())], ["id", "pii_type", "pii"])

    return rows.select("id", "text").mapInArrow(op, f"id {dict(rows.dtypes)['id']}, pii_type string, pii string")


def redacted(rows: DataFrame, model: Model) -> DataFrame:
    """(id, text, n_pii): every text with its data replaced by typed placeholders."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            spans = shared.value.select(texts)
            clean = [t if t is None else redact(t, s) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clean, pa.string()), pa.array([len(s) for s in spans], pa.int32())], ["id", "text", "n_pii"])

    return rows.select("id", "text").mapInArrow(op, f"id {dict(rows.dtypes)['id']}, text string, n_pii int")
