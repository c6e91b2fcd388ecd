"""Language of documents and of the segments of code-switched documents.

A linear-chain conditional random field over words: emission features are the
word, its affixes, its character n-grams and its membership in lists of function
words; transitions are learned. Forward-backward gives every word a marginal per
language; runs of words are segments, and a segment's confidence is the mean
marginal of its language.

Training: at most TRAIN_PER_LABEL rows per declared label, taken by a hash of the
row's id over the whole table, so the sample is bounded and spread. Rows whose
function words contradict the label are left out (labels are unreliable); texts
are joined across languages to learn transitions, and words of other languages
are strewn in so that a borrowed word does not switch.

Defined cases: links, handles, tags, numbers and emoji are no words; a text
without words (null, empty, blank, only emoji or links) has no segment; runs
of fewer than MIN_SEGMENT words of two or more letters, or with a lower confidence
than MIN_CONFIDENCE, join their neighbour, unless they have SHORT_SEGMENT words of
any length, two of them no single letters, and SHORT_CONFIDENCE; a
text of only such runs is one segment of the language with the highest total;
equal totals go to the first language of LANGUAGES; texts are read whole; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import COMMON_WORDS

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl")
TRAIN_PER_LABEL = 400
TRAIN_WORDS = 200  # longer texts are trained on in parts
LIST_SEQUENCES = 120  # per language, composed of its function words
MIN_SEGMENT, MIN_CONFIDENCE = 4, 0.5
SHORT_SEGMENT, SHORT_CONFIDENCE = 3, 0.9  # words of any length
DIMS = 1 << 16
EPOCHS, RATE, DECAY = 8, 0.12, 1e-5
GROUP = 1024  # texts decoded together
MEMO_WORDS = 300_000

_SKIP_OR_WORD = re.compile(r"(?:https?://|www\.)\S+|(?<![\w.+-])[\w.+-]++@[\w-]+\.[\w.-]+|[@#]\w+|([^\W\d_]+(?:['’][^\W\d_]+)*)", re.I)
_LISTS = {w: [i for i, lang in enumerate(LANGUAGES) if w in COMMON_WORDS[lang].split()] for ws in COMMON_WORDS.values() for w in ws.split()}


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return [w for w in _SKIP_OR_WORD.findall(text.lower()) if w]


def _slot(s: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(s) & (DIMS - 1)


def features(word: str) -> list[int]:
    w = f"^{word}$"
    out = [f"w:{word}"]
    out += [f"p:{word[:n]}" for n in (1, 2, 3)] + [f"s:{word[-n:]}" for n in (1, 2, 3, 4)]
    out += [f"g:{w[i : i + n]}" for n in (2, 3) for i in range(len(w) - n + 1)]
    out += [f"l:{i}" for i in _LISTS.get(word, ())]
    return [_slot(x) for x in out]


class Crf:
    def __init__(self) -> None:
        n = len(LANGUAGES)
        self.weights = np.zeros((DIMS, n), dtype=np.float32)
        self.start = np.zeros(n, dtype=np.float32)
        self.move = np.eye(n, dtype=np.float32) * 3

    def emit(self, word: str) -> np.ndarray:
        f = features(word)
        return self.weights[f].sum(axis=0) / len(f) ** 0.5

    def marginals(self, emit: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(B, T, L) marginals of padded emissions, expected transitions (L, L) and starts (L)."""
        b, t, n = emit.shape
        e = np.exp(emit - emit.max(axis=2, keepdims=True))
        a = np.exp(self.move - self.move.max())
        fwd, bwd, scale = np.empty_like(e), np.ones_like(e), np.ones((b, t), dtype=np.float32)
        live = np.arange(t)[None, :] < lengths[:, None]
        x = e[:, 0] * np.exp(self.start - self.start.max())
        for i in range(t):
            if i:
                x = (x @ a) * e[:, i]
                x = np.where(live[:, i, None], x, fwd[:, i - 1])
            s = x.sum(axis=1)
            x = x / s[:, None]
            fwd[:, i], scale[:, i] = x, s
        for i in range(t - 2, -1, -1):
            y = (e[:, i + 1] * bwd[:, i + 1]) @ a.T
            y /= y.sum(axis=1, keepdims=True)
            bwd[:, i] = np.where(live[:, i + 1, None], y, 1.0)
        m = fwd * bwd
        m /= m.sum(axis=2, keepdims=True)
        return m, fwd, e * bwd

    def expected_moves(self, fwd: np.ndarray, ahead: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        a = np.exp(self.move - self.move.max())
        out = np.zeros_like(self.move)
        for i in range(fwd.shape[1] - 1):
            rows = lengths > i + 1
            if not rows.any():
                break
            p = fwd[rows, i][:, :, None] * a[None] * ahead[rows, i + 1][:, None, :]
            out += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return out


def _vote(words: list[str]) -> int | None:
    score = [0] * len(LANGUAGES)
    for w in words:
        for i in _LISTS.get(w, ()):
            score[i] += 1
    best = max(score)
    return score.index(best) if best and score.count(best) == 1 else None


def training_sequences(sample: list[tuple[str, str]], seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Labelled word sequences out of (text, label) rows whose sentences agree with the label."""
    pure: dict[int, list[list[str]]] = {}
    for text, label in sample:
        y = LANGUAGES.index(label)
        votes = {_vote(words_of(s)) for s in re.split(r"[.!?\n]+| -- | / | \| ", text)} - {None}
        if votes == {y}:
            ws = words_of(text)
            pure.setdefault(y, []).extend(ws[i : i + TRAIN_WORDS] for i in range(0, len(ws), TRAIN_WORDS))
    rng = random.Random(seed)
    for y in pure:  # function words alone, so that their lists weigh beyond the words of the sample
        common = COMMON_WORDS[LANGUAGES[y]].split()
        pure[y] += [rng.choices(common, k=rng.randrange(4, 12)) for _ in range(LIST_SEQUENCES)]
    own: dict[int, list[str]] = {y: [w for ws in seqs for w in ws] for y, seqs in pure.items()}
    out = []
    for y, seqs in pure.items():
        for ws in seqs:
            ws = list(ws)
            tags = [y] * len(ws)
            kind = rng.random()
            other = rng.choice([z for z in pure if z != y] or [y])
            if kind < 0.35:  # a second language follows or comes first
                more = rng.choice(pure[other])
                cut, start = ws[: max(4, len(ws) // 2)], more[:14]
                ws, tags = (cut + start, [y] * len(cut) + [other] * len(start)) if rng.random() < 0.5 else (start + cut, [other] * len(start) + [y] * len(cut))
            elif kind < 0.55:  # a borrowed word or two
                for _ in range(rng.choice((1, 2))):
                    ws.insert(rng.randrange(len(ws) + 1), rng.choice(own[other]))
                tags = [y] * len(ws)
            out.append((ws, tags))
    rng.shuffle(out)
    return out


def train(sample: list[tuple[str, str]], epochs: int = EPOCHS) -> Crf:
    crf, seqs = Crf(), training_sequences(sample)
    n = len(LANGUAGES)
    vocab: dict[str, int] = {}
    for ws, _ in seqs:
        for w in ws:
            vocab.setdefault(w, len(vocab))
    feats = [features(w) for w in vocab]
    flat = np.array([f for fs in feats for f in fs], dtype=np.int64)
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    damp = np.array([len(f) ** -0.5 for f in feats], dtype=np.float32)
    used, back = np.unique(flat, return_inverse=True)
    second = np.full((len(used), n), 1e-6, dtype=np.float32)
    s_move, s_start = np.full((n, n), 1e-3, dtype=np.float32), np.full(n, 1e-3, dtype=np.float32)
    w = np.zeros((len(used), n), dtype=np.float32)
    seqs.sort(key=lambda s: len(s[0]))
    groups = [seqs[i : i + 128] for i in range(0, len(seqs), 128)]
    rng = random.Random(11)
    for _ in range(epochs if seqs else 0):
        rng.shuffle(groups)
        for g in groups:
            per_word = np.zeros((len(feats), n), dtype=np.float32)
            np.add.at(per_word, owner, w[back])
            per_word *= damp[:, None]
            lengths = np.array([len(s[0]) for s in g])
            ids, tags = np.zeros((len(g), lengths.max()), dtype=np.int64), np.zeros((len(g), lengths.max()), dtype=np.int64)
            for i, (ws, ts) in enumerate(g):
                ids[i, : len(ws)] = [vocab[x] for x in ws]
                tags[i, : len(ts)] = ts
            m, fwd, ahead = crf.marginals(per_word[ids], lengths)
            live = np.arange(ids.shape[1])[None, :] < lengths[:, None]
            err = (np.eye(n, dtype=np.float32)[tags] - m) * live[:, :, None]
            g_word = np.zeros_like(per_word)
            np.add.at(g_word, ids[live], err[live])
            g_word *= damp[:, None]
            g_w = np.zeros_like(w)
            np.add.at(g_w, back, g_word[owner])
            g_w = g_w / len(g) - DECAY * w
            second += g_w * g_w
            w += RATE * g_w / np.sqrt(second)
            seen = np.zeros((n, n), dtype=np.float32)
            np.add.at(seen, (tags[:, :-1][live[:, 1:]], tags[:, 1:][live[:, 1:]]), 1)
            g_move = (seen - crf.expected_moves(fwd, ahead, lengths)) / len(g)
            s_move += g_move * g_move
            crf.move += RATE * g_move / np.sqrt(s_move)
            g_start = (np.eye(n, dtype=np.float32)[tags[:, 0]] - m[:, 0]).mean(axis=0)
            s_start += g_start * g_start
            crf.start += RATE * g_start / np.sqrt(s_start)
    crf.weights[used] = w
    return crf


class Decoder:
    def __init__(self, crf: Crf):
        self.crf = crf
        self.row: dict[str, int] = {}
        self.table = np.empty((1024, len(LANGUAGES)), dtype=np.float32)
        self.letters = np.empty(1024, dtype=bool)

    def _rows(self, words: list[str]) -> list[int]:
        row, out = self.row, []
        for w in words:
            i = row.get(w)
            if i is None:
                i = row[w] = len(row)
                if i >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                    self.letters = np.concatenate([self.letters, np.empty_like(self.letters)])
                self.table[i], self.letters[i] = self.crf.emit(w), len(w) > 1
            out.append(i)
        return out

    def batch(self, texts: list[str | None]) -> list[list[tuple[str, float, int]]]:
        """Segments (language, confidence, words) of each text, in order."""
        if len(self.row) > MEMO_WORDS:
            self.row.clear()
        ids = [self._rows(words_of(t)) for t in texts]
        out: list[list[tuple[str, float, int]]] = [[] for _ in texts]
        order = sorted((i for i, x in enumerate(ids) if x), key=lambda i: len(ids[i]))
        at = 0
        while at < len(order):
            # groups of similar length, smaller for long texts, so that the padded cells stay bounded
            take = order[at : at + max(1, min(GROUP, 400_000 // len(ids[order[at]])))]
            while len(take) > 1 and len(take) * len(ids[take[-1]]) > 1_000_000:
                take = take[: len(take) // 2]
            at += len(take)
            lengths = np.array([len(ids[i]) for i in take])
            pad = np.zeros((len(take), lengths[-1]), dtype=np.int64)
            for k, i in enumerate(take):
                pad[k, : lengths[k]] = ids[i]
            m, _, _ = self.crf.marginals(self.table[pad], lengths)
            best = m.argmax(axis=2)
            same = (best == best[:, :1]) | (np.arange(lengths[-1])[None, :] >= lengths[:, None])
            whole = same.all(axis=1)
            for k, i in enumerate(take):
                n = lengths[k]
                if whole[k]:
                    y = best[k, 0]
                    out[i] = [(LANGUAGES[y], float(m[k, :n, y].mean()), int(n))]
                else:
                    out[i] = self._segments(best[k, :n], m[k, :n], self.letters[pad[k, :n]])
        return out

    @staticmethod
    def _segments(best: np.ndarray, m: np.ndarray, letters: np.ndarray) -> list[tuple[str, float, int]]:
        cuts = np.flatnonzero(np.diff(best)) + 1
        runs = [[int(best[a]), int(a), int(b), int(letters[a:b].sum())] for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(best)])]
        sure = [float(m[a:b, y].mean()) for y, a, b, _ in runs]
        kept = [r for r, p in zip(runs, sure) if p >= MIN_CONFIDENCE and r[3] >= MIN_SEGMENT or p >= SHORT_CONFIDENCE and r[2] - r[1] >= SHORT_SEGMENT and r[3] > 1]
        if not kept:
            y = int(m.sum(axis=0).argmax())
            return [(LANGUAGES[y], float(m[:, y].mean()), len(best))]
        merged = [kept[0]]
        for r in kept[1:]:
            if r[0] == merged[-1][0]:
                merged[-1][2] = r[2]
            else:
                merged.append(r)
        # short runs between two segments go to the earlier one, those at the ends to their neighbour
        bounds = [0, *(r[1] for r in merged[1:]), len(best)]
        return [(LANGUAGES[r[0]], float(m[a:b, r[0]].mean()), b - a) for r, a, b in zip(merged, bounds, bounds[1:])]


def declared(lang: Column) -> Column:
    """Primary language of a label: lower case, without region; null if missing, und or xx."""
    primary = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]+)", 1))
    return F.when(primary.isin("", "und", "xx"), None).otherwise(primary)


def training_sample(rows: DataFrame, per_label: int = TRAIN_PER_LABEL) -> list[tuple[str, str]]:
    """At most about ``per_label`` rows (id, text, lang) per declared label, by a hash of the id."""
    r = rows.select("id", "text", declared(F.col("lang")).alias("label")).where(F.col("label").isin(*LANGUAGES) & F.col("text").rlike(r"\p{L}"))
    n = {x[0]: x[1] for x in r.groupBy("label").count().collect()}
    if not n:
        return []
    space = 1 << 30
    below = F.create_map(*[F.lit(v) for k, c in sorted(n.items()) for v in (k, min(space, space * per_label // c))])
    picked = r.where(F.pmod(F.xxhash64("id"), F.lit(space)) < below[F.col("label")]).select("id", "text", "label")
    # the hash keeps about per_label rows of each label; the limit is a bound for hostile ids
    got = picked.orderBy(F.xxhash64("id"), "id").limit(4 * per_label * len(LANGUAGES)).collect()
    return [(x[1], x[2]) for x in sorted(got, key=lambda x: (x[2], x[1]))]


def segments(rows: DataFrame, crf: Crf) -> DataFrame:
    """(id, lang, seg_no, language, confidence, n_words, n_segments): one row per segment of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(crf)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(shared.value)
        for b in batches:
            found = d.batch(b.column(1).to_pylist())
            n = np.array([len(x) for x in found])
            at = pa.array(np.repeat(np.arange(len(found)), n))
            flat = [s for x in found for s in x]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(at),
                    b.column(2).take(at),
                    pa.array([k + 1 for c in n for k in range(c)], pa.int32()),
                    pa.array([s[0] for s in flat], pa.string()),
                    pa.array([round(s[1], 4) for s in flat], pa.float64()),
                    pa.array([s[2] for s in flat], pa.int32()),
                    pa.array(np.repeat(n, n), pa.int32()),
                ],
                ["id", "lang", "seg_no", "language", "confidence", "n_words", "n_segments"],
            )

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "text", "lang").mapInArrow(op, f"id {kind}, lang string, seg_no int, language string, confidence double, n_words int, n_segments int")


def mislabelled(segs: DataFrame) -> DataFrame:
    """Segments of rows whose label is missing or wrong, or that mix languages."""
    label = declared(F.col("lang"))
    return segs.where((F.col("n_segments") > 1) | label.isNull() | (label != F.col("language")))
