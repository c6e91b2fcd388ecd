"""Visually identical text with different characters.

Every token of a text is taken through a trie of the spellings of the corpus by a
weighted edit automaton: reading a character as the same one, as a letter it looks
like, as its width form or ligature, or as nothing where it is invisible costs
nothing; reading a letter as its second look (a palochka as capital i) costs
SECOND; every other edit is out of reach, since case, accents, digits, punctuation
and words do change the look. Several states may be live at once. The cheapest
spelling is the canonical one. Tokens without a spelling, and what stands between
tokens, are normalised by the table of looks.

The spelling of a leaf is the commonest of the corpus without mixed scripts, so a
token of another script keeps its own script when the corpus writes it so (a
Russian word with one Latin letter becomes Russian again). Texts that look the same
are those of equal canonical text (``same_look``).

Bounds: the trie holds the spellings of the looks that some token of the corpus is
written unlike (by other letters, or where it has a letter of two looks); more than
MAX_RESPELLED of them are an error. Looks with one plain spelling need no leaf: the
table gives that spelling.

Defined cases: null texts stay null and match nothing; empty texts stay empty and
match nothing; byte-equal texts are no pair of ``same_look``; texts of any
length are read whole; equal costs are decided for the commoner, then the smaller
spelling; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_RESPELLED = 2_000_000
SECOND = 1  # cost of the second look of a letter

#: Letters of other scripts that look like a Latin letter, written as pairs.
LOOKALIKE = dict(
    pair.split("=")
    for pair in (
        "а=a е=e о=o р=p с=c у=y х=x і=i ѕ=s ј=j һ=h ԁ=d ԛ=q ԝ=w ѵ=v ӏ=l ԍ=G ѡ=w "
        "А=A В=B Е=E К=K М=M Н=H О=O Р=P С=C Т=T У=Y Х=X І=I Ѕ=S Ј=J Ԁ=D Ԛ=Q Ԝ=W Ѵ=V Ӏ=I Ү=Y Ζ=Z "
        "ο=o ν=v α=a ρ=p ι=i υ=u γ=y ϲ=c ϳ=j χ=x "
        "Α=A Β=B Ε=E Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X Ϲ=C "
        "օ=o ս=u հ=h ո=n ց=g զ=q յ=j Օ=O Տ=S Ս=U ɑ=a ɡ=g ɩ=i ʋ=v ᴏ=o ꜱ=s ⅰ=i ⅴ=v ⅹ=x ⅼ=l ⅽ=c ⅾ=d ⅿ=m"
    ).split()
)
#: Letters of other scripts that also look like a second Latin letter.
SECOND_LOOK = dict(pair.split("=") for pair in "ӏ=I Ӏ=l І=l Ι=l ⅼ=I υ=v ν=u".split())
#: Invisible characters outside category Cf.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"
TOKEN = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}\p{Cf}͏︀-️]*+")


def _ignorable(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef" or c in INVISIBLE


@lru_cache(maxsize=65536)
def fold_char(c: str) -> str:
    """What the table makes of one character: ignorables vanish, spaces, width forms, ligatures and look-alikes unify."""
    if c.isascii():
        return c
    if _ignorable(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    how = unicodedata.decomposition(c)
    if how.startswith(("<wide>", "<narrow>")) or "ﬀ" <= c <= "ﬆ":
        return "".join(map(fold_char, unicodedata.normalize("NFKC", c)))
    return LOOKALIKE.get(c, c)


def skeleton(text: str) -> str:
    """Table form: equal for texts that look the same. Accents are folded apart from their letters, then composed again."""
    if text.isascii():
        return text
    once = "".join(map(fold_char, unicodedata.normalize("NFD", text)))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", once))


def _decomposed(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFD", s)


class Trie:
    """Spellings by their look, each leaf with its canonical spelling and its count."""

    def __init__(self, counts: dict[str, int]):
        best: dict[str, tuple[int, str]] = {}
        for word, n in counts.items():
            key = _decomposed(skeleton(word))
            if key not in best or (-n, word) < best[key]:
                best[key] = (-n, word)
        self.root: dict = {}
        for key, leaf in best.items():
            node = self.root
            for c in key:
                node = node.setdefault(c, {})
            node[""] = leaf

    def match(self, token: str) -> str | None:
        """Canonical spelling at the least cost, None if no spelling is in reach."""
        live: list[tuple[int, dict]] = [(0, self.root)]
        for c in _decomposed(token):
            ways = [(0, _decomposed(fold_char(c)))]  # an ignorable is read as nothing and leaves the states as they are
            if c in SECOND_LOOK:
                ways.append((SECOND, SECOND_LOOK[c]))
            after = []
            for cost, node in live:
                for more, letters in ways:
                    at = node
                    for x in letters:
                        at = at.get(x)
                        if at is None:
                            break
                    else:
                        after.append((cost + more, at))
            # the tree shape keeps states apart: two of them never meet
            live = after
            if not live:
                return None
        ends = [(cost, *node[""]) for cost, node in live if "" in node]
        return min(ends)[2] if ends else None


class Normaliser:
    def __init__(self, counts: dict[str, int], memo: int = 500_000):
        self.trie = Trie(counts)
        self.memo: dict[str, str] = {}
        self.most = memo

    def token(self, token: str) -> str:
        known = self.memo.get(token)
        if known is None:
            known = self.trie.match(token)
            if known is None:
                known = skeleton(token)
            if len(self.memo) < self.most:
                self.memo[token] = known
        return known

    def text(self, text: str | None) -> str | None:
        if text is None or not self.trie.root and text.isascii():
            return text
        out, at, plain = [], 0, text.isascii()
        for m in TOKEN.finditer(text):
            gap = text[at : m.start()]
            out += (gap if plain else skeleton(gap), self.token(m.group()))
            at = m.end()
        out.append(text[at:] if plain else skeleton(text[at:]))
        s = "".join(out)
        return s if s.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", s))


def merged_look(look: str) -> str:
    """Key that a look shares with those in reach of a second look."""
    return look.translate(_MERGED)


_MERGED = str.maketrans({max(y, LOOKALIKE[x]): min(y, LOOKALIKE[x]) for x, y in SECOND_LOOK.items()})


def vocabulary(texts: DataFrame) -> dict[str, int]:
    """Counts of the spellings that the trie needs, over all rows of (text).

    Distinct words are counted in the JVM and classed by their look; only classes in
    which some word is not its own look, or has a letter of two looks, are gathered.
    Of their spellings those without width forms, ignorables or mixed scripts count.
    """
    words = texts.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}\p{M}\p{Cf}\x{034F}\x{FE00}-\x{FE0F}]*+)"), 1)).alias("w"))
    mixed = F.col("w").rlike(r"\p{IsLatin}") & F.col("w").rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}]")
    clean = ~F.col("w").rlike(r"[\x{FF00}-\x{FFEF}\x{FB00}-\x{FB06}\p{Cf}\x{034F}\x{FE00}-\x{FE0F}]") & ~mixed
    two = "".join(SECOND_LOOK)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(0).to_pylist()
            looks = [skeleton(x) for x in w]
            forms = [x if x.isascii() else unicodedata.normalize("NFC", x) for x in w]
            odd = [f != k or not f.isascii() and any(c in two for c in f) for f, k in zip(forms, looks)]
            yield pa.RecordBatch.from_arrays([pa.array([merged_look(k) for k in looks], pa.string()), pa.array(forms, pa.string()), b.column(1), b.column(2), pa.array(odd, pa.bool_())], ["class", "w", "n", "clean", "odd"])

    n = words.groupBy("w").agg(F.count("*").alias("n")).withColumn("clean", clean).mapInArrow(op, "class string, w string, n bigint, clean boolean, odd boolean")
    n = cut_lineage(n.groupBy("class", "w").agg(F.sum("n").alias("n"), F.bool_or("clean").alias("clean"), F.bool_or("odd").alias("odd")))
    needed = n.where("odd").select("class").distinct()
    rows = n.where("clean").join(needed, "class", "left_semi").select("w", "n").limit(MAX_RESPELLED + 1).collect()
    if len(rows) > MAX_RESPELLED:
        raise ValueError(f"more than {MAX_RESPELLED} spellings in the trie")
    return {r[0]: r[1] for r in rows}


def normalise(rows: DataFrame, key: str, counts: dict[str, int]) -> DataFrame:
    """(key, text): the canonical text of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Normaliser(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n.text(t) for t in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return rows.select(key, "text").mapInArrow(op, f"`{key}` {dict(rows.dtypes)[key]}, text string")


def look_keys(rows: DataFrame, key: str, counts: dict[str, int]) -> DataFrame:
    """(key, look, raw): 128-bit digests of the canonical text and of the bytes of a text; null and empty texts are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        n, digest = Normaliser(shared.value), lambda s: xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))
        for b in batches:
            texts = b.column(1).to_pylist()
            raw = [digest(t) for t in texts]
            look = [r if (c := n.text(t)) == t else digest(c) for t, r in zip(texts, raw)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(look, pa.binary()), pa.array(raw, pa.binary())], [key, "look", "raw"])

    return rows.select(key, "text").where("text <> ''").mapInArrow(op, f"`{key}` {dict(rows.dtypes)[key]}, look binary, raw binary")


def same_look(left: DataFrame, lkey: str, right: DataFrame, rkey: str, counts: dict[str, int] | None = None) -> DataFrame:
    """(lkey, rkey): all pairs of a left and a right row whose texts look the same and are not the same string.

    Byte-equal texts are one row before they meet: a look is written in few ways, so
    what is paired are ways, and only pairs of different ways are expanded to rows.
    """
    counts = vocabulary(left.select("text").unionByName(right.select("text"))) if counts is None else counts
    a, b = (cut_lineage(look_keys(d, k, counts)) for d, k in ((left, lkey), (right, rkey)))
    ways = a.select("look", "raw").distinct().join(b.select("look", F.col("raw").alias("other")).distinct(), "look").where("raw <> other")
    return ways.select("raw", "other").join(a.select(lkey, "raw"), "raw").join(b.select(rkey, F.col("raw").alias("other")), "other").select(lkey, rkey)
