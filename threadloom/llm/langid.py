"""Problem 6: the language of each text and of each segment of a mixed text.

Averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in
numpy on a bounded sample of labelled documents (wrong labels are outvoted and dropped in a
second round), with a temperature and a rejection threshold set on held-out sentences. Since the mean of embeddings goes
through a linear layer, both fold into one table of scores a subword, and a batch of texts is
scored as one array of code points: classes, sentence bounds, subword hashes and sums without a loop over
texts. Only texts with more than one language are segmented one by one.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.textfns import strip
from threadloom.llm.lookalike import LOOK_ALIKES
from threadloom.session import written

LANGUAGES = ("en", "zh", "de", "fr", "es", "pt", "ja", "ru")
#: Codes and names of the languages in labels.
NAMES = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "inglês", "英語", "英文"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文", "汉语", "漢語", "chinesisch", "chinois", "zh-hant", "zh-hans"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "spanisch"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugiesisch"),
    "ja": ("ja", "jpn", "jp", "japanese", "日本語", "japanisch"),
    "ru": ("ru", "rus", "russian", "русский", "russisch"),
}
BUCKET_BITS, WIDTH = 15, 16
REJECTED, MOST_REJECTION = 0.01, 0.7  # the threshold under which this share of right held-out sentences falls, and the highest it may be
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 150, 4000  # training: at most about so many documents a language, so many characters of each
CHUNK_CHARS = 300_000
MIN_LETTERS, SEGMENT_LETTERS = 8, 20  # fewer letters name no language, or no language of a segment (three times as many without a full stop: titles, items of lists)
RESULT = "main string, confidence double, letters array<int>, weights array<double>, segments array<struct<lang:string,confidence:double>>"

#: Code, logs, markup with its fixed words, identifiers and addresses have no language; a blank line ends a paragraph.
_NOISE = (
    r"(?s)```.*?(?:```|\z)|`[^`\n]*`"
    r"|(?m:^[ \t]*(?:#+[ \t]*Message \d+|[-*] (?:id|source|created_at|updated_at|message_count|account|lang|language|title)\b:[^\n]*|\*\*[^*\n]{1,20}:\*\*|\|[^\n]*\||-{3,}|={3,}|\d{2}:\d{2}:\d{2}[^\n]*|\[?\d{4}-\d\d-\d\d[T ][^\n]*)[ \t]*$)"
    r"|(?m:^[ \t]*\[(?i:user|assistant|system|tool|human)\])|(?m:^(?i:user|assistant|system|tool|human): )"
    r"|\{[^{}\n]*\}|\[?https?://\S+|(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++[@＠][^\s,;、。，]+|(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9.\-]+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9\-]+)*|(?<![A-Za-z0-9+/=_\-])[A-Za-z0-9+/=_\-]{36,}|\(?(?:no\.|[A-Z]{2}-) ?\d{5,}\)?|\b[0-9a-f]{10,}\b"
)
_SEPARATOR, _PARAGRAPH = 0x0, 0x2029
_OTHER, _LATIN, _CYRILLIC, _LIKE, _HAN, _KANA, _FOREIGN, _LINE, _STOP, _WIDE_STOP, _BLANK = range(11)


#: Any noise shows one of these signs or matches a short expression; texts without are spared the longer one.
_NOISE_SIGNS = ("`", "#", "*", "|", "{", "@", "＠", "[", "===", "---", "://", "(at", "( at", "\n- ", "\n\t- ", "ser: ", "SER: ", "ssistant: ", "SSISTANT: ", "ystem: ", "YSTEM: ", "ool: ", "OOL: ", "uman: ", "UMAN: ")
#: Short expressions for the rest, each behind a sign that it needs.
_NOISE_FORMS = (("- ", r"^[ \t]*- |\n[ \t]+- "), (":", r"\d\d:\d\d:\d\d"), ("-", r"\d{4}-\d\d-\d\d[T ]"), (None, r"\d{5}"), (None, r"[0-9a-f]{10}"), (None, r"[A-Za-z0-9+/=_\-]{36}"))
_UNSEEN = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{AD}\x{0}]"


def cleaned(text: Column) -> Column:
    """Lower-case text without what has no language; paragraphs end in U+2029."""
    noisy = reduce(lambda found, sign: found | text.contains(sign), _NOISE_SIGNS, F.lit(False))
    noisy = reduce(lambda found, form: found | (text.rlike(form[1]) if form[0] is None else text.contains(form[0]) & text.rlike(form[1])), _NOISE_FORMS, noisy)
    bare = F.when(noisy, F.regexp_replace(text, _NOISE, "\n")).otherwise(text)
    shown = F.when(text.rlike(_UNSEEN), F.regexp_replace(bare, _UNSEEN, "")).otherwise(bare)
    return F.lower(F.when(text.contains("\n") | text.contains("`"), F.regexp_replace(shown, r"\n[ \t\r\x{A0}\x{3000}]*\n\s*", "\u2029")).otherwise(shown))


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point of the basic plane: its class, its plain form and the Latin letter it looks like."""
    kind = np.full(0x10000, _OTHER, np.uint8)
    plain = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        wide = unicodedata.decomposition(c)
        if wide.startswith(("<wide>", "<narrow>", "<compat>")) and len(wide.split()) == 2:
            plain[i] = ord(chr(int(wide.split()[1], 16)).lower())
            c = chr(plain[i])
        if not unicodedata.category(c).startswith("L"):
            continue
        o = ord(c)
        if o < 0x250 or 0x1E00 <= o < 0x1F00:
            kind[i] = _LATIN
        elif 0x400 <= o < 0x530:
            kind[i] = _CYRILLIC
        elif 0x3040 <= o < 0x3100 or 0x31F0 <= o < 0x3200:
            kind[i] = _KANA
        elif 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00:
            kind[i] = _HAN
        else:
            kind[i] = _FOREIGN
    like = plain.copy()
    for c, latin in LOOK_ALIKES.items():
        kind[ord(c)], like[ord(c)] = _LIKE, ord(latin.lower())
    kind[0x30FC] = _KANA
    for c in "\n \0":
        kind[ord(c)] = _LINE
    for c in ".!?…":
        kind[ord(c)] = _STOP
    for c in "。！？":
        kind[ord(c)] = _WIDE_STOP
    for c in " \t\r 　  ":
        kind[ord(c)] = _BLANK
    return kind, plain, like


def _code_points(texts: list[str]) -> np.ndarray:
    joined = "\0".join(unicodedata.normalize("NFC", t) for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(points < 0x10000, points, 0xFFFD)


@dataclass
class Sentences:
    text: np.ndarray  # index of the text
    paragraph: np.ndarray  # running number of the paragraph
    letters: np.ndarray
    ended: np.ndarray  # whether a full stop or the like ends it; titles and items have none
    starts: np.ndarray  # first subword position
    hashes: np.ndarray  # (positions, 3), -1 where there is none


def sentences_of(texts: list[str]) -> Sentences:
    """Sentences of cleaned texts and the hashes of their subwords of one to three letters."""
    kind_of, plain_of, like_of = _tables()
    points = _code_points(texts)
    kind = kind_of[points]
    n = len(points)
    after = np.append(kind[1:], _LINE)
    ends = (kind == _LINE) | (kind == _WIDE_STOP) | ((kind == _STOP) & ((after == _BLANK) | (after == _LINE)))
    number = np.append(0, np.cumsum(ends)[:-1])
    count = int(number[-1]) + 1 if n else 0
    per = {k: np.bincount(number[kind == k], minlength=count) for k in (_LATIN, _CYRILLIC, _LIKE, _HAN, _KANA, _FOREIGN)}
    # look-alikes belong to the script that their sentence is surely written in
    russian = per[_CYRILLIC] > per[_LATIN]
    eastern = (per[_HAN] + per[_KANA]) * 3 >= per[_LATIN]
    eastern &= per[_HAN] + per[_KANA] > 0
    plain = plain_of[points]
    is_like = kind == _LIKE
    plain[is_like] = np.where(russian[number[is_like]], plain[is_like], like_of[points[is_like]])
    letter = (kind == _LATIN) | (kind == _CYRILLIC) | is_like | (kind == _HAN) | (kind == _KANA) | (kind == _FOREIGN)
    letter &= ~(eastern[number] & ((kind == _LATIN) | is_like))  # names in Latin letters inside Eastern text
    c0 = np.where(letter, plain, 32).astype(np.uint64)
    c1, c2 = np.append(c0[1:], 32).astype(np.uint64), np.append(c0[2:], (32, 32)).astype(np.uint64)[:n]
    cross = ends
    c1[cross] = 32
    c2[cross | np.append(cross[1:], True)] = 32
    shift = np.uint64(64 - BUCKET_BITS)
    m = np.uint64(0x9E3779B97F4A7C15)
    one, two = (c0 + np.uint64(1)) * m, ((c0 << np.uint64(16)) + c1 + np.uint64(7919)) * m
    three = ((c0 << np.uint64(32)) + (c1 << np.uint64(16)) + c2 + np.uint64(104729)) * m
    hashes = np.stack([one >> shift, two >> shift, three >> shift], axis=1).astype(np.int32)
    on = c0 != 32
    hashes[~on, 0] = -1
    hashes[~on & (c1 == 32), 1] = -1
    hashes[~on & (c1 == 32), 2] = -1
    hashes[c1 == 32, 2] = -1
    text = np.append(0, np.cumsum(points == _SEPARATOR)[:-1])
    paragraph = np.append(0, np.cumsum((points == _SEPARATOR) | (points == _PARAGRAPH))[:-1])
    starts = np.flatnonzero(np.append(True, ends[:-1])) if n else np.array([], np.int64)
    letters = np.bincount(number[letter], minlength=count)
    # an Eastern letter says as much as two of an alphabet
    letters = letters + np.bincount(number[letter & ((kind == _HAN) | (kind == _KANA))], minlength=count)
    stops = np.flatnonzero(ends)
    ended = np.isin(kind[stops], (_STOP, _WIDE_STOP))
    return Sentences(text[starts], paragraph[starts], letters, np.append(ended, False)[: len(starts)], starts, hashes)


@dataclass
class Model:
    scores: np.ndarray  # (buckets + 1, languages); the last row is nothing
    bias: np.ndarray
    temperature: float
    least: float  # confidence under which a sentence is rejected

    def confidences(self, s: Sentences) -> np.ndarray:
        """(sentences, languages)"""
        at = self.scores[s.hashes[:, 0]] + self.scores[s.hashes[:, 1]] + self.scores[s.hashes[:, 2]]
        if not len(s.starts):
            return np.zeros((0, len(LANGUAGES)), np.float32)
        sums = np.add.reduceat(at, s.starts, axis=0)
        counts = np.maximum(1, np.add.reduceat((s.hashes >= 0).sum(axis=1), s.starts))
        return _softmax((sums / counts[:, None] + self.bias) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _trusted(pieces: list[np.ndarray], y: np.ndarray, doc: np.ndarray, n: int, epochs: int, random: np.random.Generator) -> np.ndarray:
    """Sentences whose labels hold. Labels of documents are sometimes wrong, so each half of them is judged by a model of the other half.

    Documents that it reads as another language go, and sentences that it surely does, unless that were most of a language.
    """
    said = np.zeros((len(y), len(LANGUAGES)))
    half = random.permutation(n)[doc] % 2
    for part in (0, 1):
        other = half != part
        logits = _settled(pieces, y, other, epochs, random)[2] if other.any() else np.zeros_like(said)
        said[~other] = _softmax(logits[~other])
    sums = np.stack([np.bincount(doc, said[:, k], n) for k in range(len(LANGUAGES))], axis=1)[doc]
    trusted = sums.argmax(axis=1) == y
    trusted &= np.where(said.max(axis=1) > 0.8, said[np.arange(len(y)), y], 1.0) > 0.2
    for language in range(len(LANGUAGES)):
        own = y == language
        if own.any() and trusted[own].mean() < 0.4:
            trusted[own] = True
    return trusted


def _settled(pieces: list[np.ndarray], y: np.ndarray, keep: np.ndarray, epochs: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, bias and logits of the step size that fits the kept rows best; a smaller one is tried only where the first doesn't settle."""
    best: tuple[float, tuple] | None = None
    for rate in (1.0, 0.4, 2.0):
        found = _descended(pieces, y, keep, epochs, rate, random)
        share = np.bincount(y[keep], minlength=len(LANGUAGES))
        right = np.bincount(y[keep], (found[2][keep].argmax(axis=1) == y[keep]).astype(float), len(LANGUAGES))
        least = float((right[share > 0] / share[share > 0]).min()) if share.any() else 1.0
        if best is None or least > best[0]:
            best = (least, found)
        if least > 0.6:
            break
    return best[1]


def _descended(pieces: list[np.ndarray], y: np.ndarray, keep: np.ndarray, epochs: int, rate: float, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One run of averaged stochastic gradient descent; the later half of the epochs is averaged."""
    embed = (random.standard_normal((2**BUCKET_BITS, WIDTH)) * 0.1).astype(np.float32)
    weights = (random.standard_normal((WIDTH, len(LANGUAGES))) * 0.3).astype(np.float32)
    bias = np.zeros(len(LANGUAGES), np.float32)
    share = np.bincount(y[keep], minlength=len(LANGUAGES))
    balance = share.sum() / np.maximum(1, share) / max(1, (share > 0).sum())
    rows = np.flatnonzero(keep)
    table, shift, averaged = np.zeros((2**BUCKET_BITS, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32), 0
    for epoch in range(epochs):
        random.shuffle(rows)
        step = rate * (1 - epoch / (epochs + 1))
        for b in range(0, len(rows), 64):
            batch = rows[b : b + 64]
            lengths = np.array([len(pieces[i]) for i in batch])
            ids = np.concatenate([pieces[i] for i in batch])
            starts = np.append(0, np.cumsum(lengths)[:-1])
            mean = np.add.reduceat(embed[ids], starts, axis=0) / lengths[:, None]
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(batch)), y[batch]] -= 1
            error *= (np.minimum(balance, 3.0)[y[batch]] / len(batch))[:, None]
            back = (error @ weights.T) / lengths[:, None]
            weights -= step * (mean.T @ error)
            bias -= 0.1 * step * error.sum(axis=0)
            np.subtract.at(embed, ids, (step * 400 * np.repeat(back, lengths, axis=0)).astype(np.float32))
        if epoch >= epochs // 2:
            table += embed @ weights
            shift += bias
            averaged += 1
    scores = np.vstack([table / averaged, np.zeros((1, len(LANGUAGES)))]).astype(np.float32)
    shift = shift / averaged
    return scores, shift, np.array([scores[p].mean(axis=0) + shift for p in pieces])


def train(texts: list[str], labels: list[int], epochs: int = 6, seed: int = 11) -> Model:
    """Fit on sentences of cleaned texts with the languages of their documents (indices into LANGUAGES)."""
    random = np.random.default_rng(seed)
    pieces, owners, sources = [], [], []
    for start in range(0, len(texts), 200):
        s = sentences_of(texts[start : start + 200])
        bounds = np.append(s.starts, len(s.hashes))
        for i in np.flatnonzero(s.letters >= MIN_LETTERS):
            h = s.hashes[bounds[i] : bounds[i + 1]].ravel()
            pieces.append(np.unique(h[h >= 0]))
            owners.append(labels[start + s.text[i]])
            sources.append(start + s.text[i])
    y, doc = np.array(owners, np.int64), np.array(sources, np.int64)
    if not len(y):
        return Model(np.zeros((2**BUCKET_BITS + 1, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32), 1.0, 2.0)
    held = random.random(len(texts))[doc] < 0.1
    sure = _trusted(pieces, y, doc, len(texts), epochs, random)
    keep = ~held & sure
    scores, bias, logits = _settled(pieces, y, keep if keep.any() else sure, epochs, random)
    test = held & sure if (held & sure).any() else keep
    grid = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4)
    losses = [-np.log(_softmax(logits[test] / t)[np.arange(test.sum()), y[test]] + 1e-9).mean() for t in grid]
    temperature = grid[int(np.argmin(losses))]
    p = _softmax(logits[test] / temperature)
    right = p.argmax(axis=1) == y[test]
    least = float(np.clip(np.quantile(p.max(axis=1)[right], REJECTED), 2 / len(LANGUAGES), MOST_REJECTION)) if right.any() else 0.5
    return Model(scores, bias.astype(np.float32), float(temperature), least)


def _segments(langs: list[int], paragraphs: list[int], confidences: list[float]) -> list[tuple[int, float]]:
    """(language, confidence) of the segments of one text; -1 marks sentences that name no language.

    A run of sentences in one language counts if it has two or fills a paragraph; others join what is around them.
    """
    named = [i for i, x in enumerate(langs) if x >= 0]
    runs: list[list] = []  # language, sentence numbers
    for i in named:
        if runs and runs[-1][0] == langs[i]:
            runs[-1][1].append(i)
        else:
            runs.append([langs[i], [i]])
    size: dict[int, int] = {}
    for i in named:
        size[paragraphs[i]] = size.get(paragraphs[i], 0) + 1

    def counts(run: list) -> bool:
        return len(run[1]) >= 2 or size[paragraphs[run[1][0]]] == 1

    solid: list[list] = []
    for run in (r for r in runs if counts(r)):
        if solid and solid[-1][0] == run[0]:
            solid[-1][1] += run[1]
        else:
            solid.append([run[0], list(run[1])])
    return [(r[0], float(np.mean([confidences[i] for i in r[1]]))) for r in solid]


def analysed(texts: pd.Series, model: Model) -> pd.DataFrame:
    """Main language with its confidence, letters a language and segments (at least two, else none) of cleaned texts."""
    n = len(texts)
    letters = np.zeros((n, len(LANGUAGES)), np.int64)
    weight = np.zeros((n, len(LANGUAGES)), np.float64)  # letters by the probability of each language
    segments: list[list] = [[] for _ in range(n)]
    values = texts.fillna("").tolist()
    start = 0
    while start < n:
        stop, size = start + 1, len(values[start])
        while stop < n and size + len(values[stop]) < CHUNK_CHARS:
            size += len(values[stop])
            stop += 1
        s = sentences_of(values[start:stop])
        p = model.confidences(s)
        lang, top = p.argmax(axis=1), p.max(axis=1)
        named = (s.letters >= MIN_LETTERS) & (top >= model.least)
        rows = start + s.text
        np.add.at(letters, (rows[named], lang[named]), s.letters[named])
        np.add.at(weight, rows[named], s.letters[named, None] * p[named])
        lang = np.where(named & (s.letters >= np.where(s.ended, SEGMENT_LETTERS, 3 * SEGMENT_LETTERS)), lang, -1)
        several = np.zeros((stop - start, len(LANGUAGES)), bool)
        several[s.text[lang >= 0], lang[lang >= 0]] = True
        mixed = np.flatnonzero(several.sum(axis=1) > 1)
        bounds = np.searchsorted(s.text, np.append(mixed, 0))
        for k, t in enumerate(mixed):
            a, b = bounds[k], np.searchsorted(s.text, t, side="right")
            found = _segments(lang[a:b].tolist(), s.paragraph[a:b].tolist(), top[a:b].tolist())
            if len(found) > 1:
                segments[start + t] = [{"lang": LANGUAGES[x], "confidence": c} for x, c in found]
        start = stop
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    at = np.arange(n)
    sure = np.where(total > 0, weight[at, best] / np.maximum(1, total), 0.0)
    main = np.where(total > 0, np.array(LANGUAGES, dtype=object)[best], None)
    return pd.DataFrame({"main": main, "confidence": sure, "letters": list(letters.astype(np.int32)), "weights": list(weight), "segments": segments})


def language_column(model: Model, text: Column) -> Column:
    """A struct (``RESULT``) of each text."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return analysed(texts, model)

    return run(cleaned(text))


def label_language(label: Column) -> Column:
    """The language that a label names in any spelling, null for none of them or no language; 'other' for another code."""
    spelled = F.lower(F.trim(label))
    names = F.create_map(*[F.lit(x) for code, all_ in NAMES.items() for name in all_ for x in (name, code)])
    stem = F.regexp_extract(spelled, r"^([^-_ (]*)", 1)
    return F.coalesce(F.try_element_at(names, spelled), F.try_element_at(names, stem))


def fitted(documents: DataFrame) -> Model:
    """A model fitted on at most about ``SAMPLE_PER_LANGUAGE`` labelled documents a language, picked by a hash of their key."""
    labelled = documents.select("doc_id", "text", label_language(F.col("lang")).alias("said")).where("said is not null and text is not null")
    counts = {r["said"]: r["n"] for r in labelled.groupBy("said").agg(F.count("*").alias("n")).collect()}
    ticket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE_PER_LANGUAGE / n))]) if counts else None
    if share is None:
        return train([], [])
    sample = labelled.where(ticket < F.element_at(share, F.col("said"))).select(
        "doc_id", F.substring(cleaned(F.col("text")), 1, SAMPLE_CHARS).alias("text"), "said"
    )
    rows = sorted(sample.collect(), key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [LANGUAGES.index(r["said"]) for r in rows])


def analysed_messages(messages: DataFrame, model: Model) -> DataFrame:
    """(row_id, conversation_id, by_user, main, confidence, letters, segments) of each message."""
    speaker = F.lower(strip(F.col("role")))
    rows = messages.select(
        "row_id", "conversation_id", F.coalesce(speaker.isin("user", "human"), F.lit(False)).alias("by_user"), language_column(model, F.col("content")).alias("r")
    )
    return rows.select("row_id", "conversation_id", "by_user", "r.*")


def conversation_languages(analysed_rows: DataFrame) -> DataFrame:
    """(conversation_id, lang, confidence): what most of the users' text of each conversation is in, and the mean probability of that, by letters."""
    sums = [F.sum(F.when(F.col("by_user"), F.col(c)[i]).otherwise(0)).alias(f"{k}{i}") for k, c in (("n", "letters"), ("w", "weights")) for i in range(len(LANGUAGES))]
    totals = analysed_rows.where("conversation_id is not null").groupBy("conversation_id").agg(*sums)
    best = F.array_max(F.array(*[F.struct(F.col(f"n{i}").alias("n"), F.lit(-i).alias("order"), F.lit(x).alias("lang"), F.col(f"w{i}").alias("w")) for i, x in enumerate(LANGUAGES)]))
    every = sum((F.col(f"n{i}") for i in range(len(LANGUAGES))), F.lit(0))
    return totals.select("conversation_id", best.alias("best"), every.alias("every")).where("every > 0").select(
        "conversation_id", F.col("best.lang").alias("lang"), (F.col("best.w") / F.col("every")).alias("confidence")
    )


def language_cases(documents: DataFrame, messages: DataFrame, records: DataFrame, model: Model | None = None) -> DataFrame:
    """(place, record_key, segment_no, lang, confidence).

    ``segment_no`` 0: labels that are absent, name no language or a wrong one, of documents in one language and of analyses (schema
    default, status ok) of conversations. From 1: the segments of documents and messages in several languages. Null, blank and
    wordless texts give no row. A label in any spelling of the right language gives none.
    """
    model = model or fitted(documents)
    docs = written(
        documents.select("doc_id", F.col("lang").alias("label"), language_column(model, F.col("text")).alias("r")).select("doc_id", "label", "r.*"), "document-languages"
    )
    said = written(analysed_messages(messages, model), "message-languages")

    def segments(rows: DataFrame, place: str, key: str) -> DataFrame:
        parts = rows.select(F.lit(place).alias("place"), F.col(key).cast("string").alias("record_key"), F.posexplode("segments").alias("at", "s"))
        return parts.select("place", "record_key", (F.col("at") + 1).cast("bigint").alias("segment_no"), F.col("s.lang").alias("lang"), F.col("s.confidence").alias("confidence"))

    def labels(rows: DataFrame, place: str, key: str, label: str, lang: str) -> DataFrame:
        wrong = F.coalesce(label_language(F.col(label)) != F.col(lang), F.lit(True))
        return rows.where(F.col(lang).isNotNull() & wrong).select(
            F.lit(place).alias("place"), F.col(key).cast("string").alias("record_key"), F.lit(0).cast("bigint").alias("segment_no"), F.col(lang).alias("lang"), "confidence"
        )

    one = docs.where(F.size("segments") == 0)
    checked = records.where("analysis_schema = 'default' and status = 'ok'").select("analysis_no", F.col("id").alias("conversation_id"), "language")
    talks = checked.join(conversation_languages(said), "conversation_id")
    return (
        labels(one, "document", "doc_id", "label", "main")
        .unionByName(labels(talks, "analysis", "analysis_no", "language", "lang"))
        .unionByName(segments(docs, "document", "doc_id"))
        .unionByName(segments(said, "message", "row_id"))
    )
