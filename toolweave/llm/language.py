"""Languages of documents and of segments of mixed ones (problem 6).

Script ranges narrow the candidates of a word: kana is Japanese, Cyrillic Russian, ideographs Chinese or
Japanese, Latin one of the Latin-script languages. Words carry a score per language, learned from a
bounded sample of labelled rows that is first segmented with a short list of function words, so that
wrong labels and mixed texts don't spoil the counts. A Viterbi pass over the words with a penalty for
every change of language, lower after the end of a sentence or line, labels the spans. Names, codes and
identifiers are in no vocabulary; they score alike in every language and stay with what surrounds them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["en", "es", "pt", "fr", "de", "ru", "zh", "ja"]
#: Rows of each table that the word scores are learned from; picked by hash over the whole table.
SAMPLE_ROWS = 40_000
LEAST_LETTERS = 12
#: Words whose scores a task keeps before it starts anew.
MOST_WORDS = 500_000
SWITCH_INSIDE, SWITCH_AFTER_END = 18.0, 9.0
CLIP = 5.0

# Common function words of each language written in Latin letters.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as at be this have from or by not but what all were when we there can an your which their if will each about how up out them then these so some her would make like him into has look two more go see no way could my than been call who its now find did get come made may part with please does during before after between until",
    "es": "el la los las de del y en que es un una por con para como su se al lo más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante uno ni contra otros ese eso ante ellos esto antes algunos qué unos yo otro otras otra él tanto esa estos mucho cuál puede puedes están cada usted mi",
    "pt": "o a os as de do da dos das e em que é um uma por com para como seu sua se ao mais mas já ou este porque esta entre quando muito sem sobre também até há onde quem desde todo nos durante nem contra outros esse isso ele ela eles isto antes alguns foi são não na no nas pelo pela você num numa está foram às meu minha ainda cada qual",
    "fr": "le la les de des du et en que est un une pour avec dans ce qui sur au aux par plus pas se son sa ses ne il elle nous vous ils elles je tu mais ou où donc car si leur leurs été être avoir fait cette ces mon ma mes ton votre notre sont sans sous entre après avant quand comme tout tous très bien encore peut chez selon c'est d'une j'ai n'est qu'il",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich du wir ihr kann können bitte welche warum wann wo wer gibt unter gegen vom alle",
}
#: Codes and English names of the languages, and words for "not known".
CODES = {
    "en": "en eng english", "es": "es spa esp spanish castilian", "pt": "pt por portuguese", "fr": "fr fra fre french",
    "de": "de deu ger german", "ru": "ru rus russian", "zh": "zh zho chi cmn chinese mandarin", "ja": "ja jpn jp japanese",
}
_CODE = {word: code for code, words in CODES.items() for word in words.split()}

_CJK = "々-〇぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
_TOKEN = re.compile(
    rf"[A-Za-z0-9]*_[A-Za-z0-9_]*|[A-Z]+-\d+|[A-Za-zÀ-ɏ]+(?:['’][A-Za-zÀ-ɏ]+)?|[Ѐ-ӿ]+|[{_CJK}]+|[.!?。！？\n/|;]"
)
_KANA = re.compile("[぀-ヿｦ-ﾟ]")
_ENDS = frozenset(".!?。！？\n/|;")
_EN, _RU, _ZH, _JA = (LANGUAGES.index(x) for x in ("en", "ru", "zh", "ja"))
_LATIN = [LANGUAGES.index(x) for x in FUNCTION_WORDS]


def declared_code(label: Column) -> Column:
    """The language a label names: a code, a code with region, an English name; else null."""
    head = F.lower(F.trim(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)", 1)))
    words = F.create_map(*[F.lit(x) for pair in _CODE.items() for x in pair])
    return F.try_element_at(words, head)


class Scores:
    """Score rows of tokens. Row 0 is neutral; words get theirs from ``words``, other scripts by rule."""

    def __init__(self, words: dict[str, list[float]], han: dict[str, float]):
        self.words, self.han = words, han
        self.rows: list[list[float]] = [[0.0] * len(LANGUAGES)]
        self.at: dict[str, int] = {}
        self.letters: list[int] = [0]
        self.ends: list[bool] = [False]
        self.table = None

    def number(self, token: str) -> int:
        k = self.at.get(token)
        if k is None:
            k = self.at[token] = len(self.rows)
            self.rows.append(self._score(token))
            self.letters.append(0 if token in _ENDS else sum(map(str.isalpha, token)))
            self.ends.append(token in _ENDS)
            self.table = None
        return k

    def _score(self, token: str) -> list[float]:
        first = token[0]
        if first in _ENDS or "_" in token or "-" in token:
            return self.rows[0]
        row = [-CLIP] * len(LANGUAGES)
        if "Ѐ" <= first <= "ӿ":
            row[_RU] = 0.0
            return row
        if first >= "　":
            kana = len(_KANA.findall(token))
            weight = sum(self.han.get(c, 0.0) for c in token)
            # Kana settles it; without, ideographs lean by their own use in the two languages.
            row[_ZH], row[_JA] = (-min(2 * CLIP, 3.0 * kana), 0.0) if kana else (min(0.0, max(-CLIP, weight)), min(0.0, max(-CLIP, -weight)))
            return [2 * x if i not in (_ZH, _JA) else x for i, x in enumerate(row)]
        return self.words.get(token.lower().replace("’", "'"), self.rows[0])

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.table is None:
            self.table = np.array(self.rows, dtype=np.float32), np.array(self.letters, dtype=np.int64), np.array(self.ends)
        return self.table


def viterbi(score: np.ndarray, lengths: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """State of each token. Texts lie one after the other; all are stepped through at once."""
    states = score.shape[1]
    start = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    back = np.zeros(score.shape, dtype=np.int8)
    path = np.zeros(len(score), dtype=np.int8)
    own = np.arange(states, dtype=np.int8)
    last = np.zeros((len(lengths), states), dtype=np.float32)
    steps = int(lengths.max()) if len(lengths) else 0
    active = [int(np.searchsorted(-sorted_lengths, -t, side="left")) for t in range(steps)]
    for t in range(steps):
        rows = start[order[: active[t]]] + t
        if t == 0:
            last[: active[t]] = score[rows]
            continue
        now = last[: active[t]]
        best = now.argmax(axis=1)
        change = now[np.arange(len(now)), best] - penalty[rows]
        stay = now >= change[:, None]
        back[rows] = np.where(stay, own[None, :], best[:, None].astype(np.int8))
        last[: active[t]] = np.where(stay, now, change[:, None]) + score[rows]
    state = last.argmax(axis=1).astype(np.int8)
    for t in range(steps - 1, -1, -1):
        rows = start[order[: active[t]]] + t
        path[rows] = state[: active[t]]
        state[: active[t]] = back[rows, state[: active[t]]] if t else state[: active[t]]
    return path


def segment(scores: Scores, texts: list[str], hints: list[str | None]) -> tuple[np.ndarray, ...]:
    """(text number, language, confidence, first token, tokens) of each segment, and tokens and letters of the texts."""
    number = scores.number
    known = scores.at
    flat: list[int] = []
    lengths = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        tokens = _TOKEN.findall(text)
        try:
            flat.extend([known[t] for t in tokens])
        except KeyError:
            flat.extend([number(t) for t in tokens])
        lengths[i] = len(tokens)
    table, letters, ends = scores.arrays()
    code = np.array(flat, dtype=np.int64)
    score = table[code]
    text = np.repeat(np.arange(len(texts)), lengths)
    start = np.cumsum(lengths) - lengths
    some = lengths > 0
    # The declared language breaks ties only.
    hint = np.array([LANGUAGES.index(h) if h in LANGUAGES else -1 for h in hints], dtype=np.int64)
    use = some & (hint >= 0)
    score[start[use], hint[use]] += 0.1
    before = np.concatenate(([False], ends[code][:-1])) if len(code) else np.zeros(0, dtype=bool)
    path = viterbi(score, lengths, np.where(before, SWITCH_AFTER_END, SWITCH_INSIDE).astype(np.float32))
    total = np.bincount(text, weights=letters[code], minlength=len(texts)) if len(code) else np.zeros(len(texts))
    first = np.zeros(len(code), dtype=bool)
    if len(code):
        first[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
        first[0] = True
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(code)))
    sums = np.add.reduceat(score, at, axis=0) if len(at) else np.zeros((0, len(LANGUAGES)), dtype=np.float32)
    chosen = path[at]
    mine = sums[np.arange(len(at)), chosen]
    sums[np.arange(len(at)), chosen] = -np.inf
    margin = mine - sums.max(axis=1) if len(at) else mine
    confidence = 1 / (1 + np.exp(-np.clip(margin, -30, 30).astype(np.float64)))
    return text[at], chosen, confidence, at - start[text[at]], size, total


def seed_scores() -> Scores:
    """Scores by the function words alone: a word of k languages speaks against all others."""
    words: dict[str, list[float]] = {}
    for lang, listed in FUNCTION_WORDS.items():
        for w in listed.split():
            words.setdefault(w, [-2.0] * len(LANGUAGES))[LANGUAGES.index(lang)] = 0.0
    return Scores(words, {})


def learn(samples: list[tuple[DataFrame, str, str]], rows: int = SAMPLE_ROWS, least: int = 4) -> dict:
    """Word and ideograph scores from (table, text column, label column) samples.

    At most about ``rows`` rows of each table are used, those of the lowest hashes of their texts, so the
    sample is spread over the whole table; tables below the bound are used whole. A segment counts for the
    language the seed gives it if the row's label agrees or is missing. Words seen in fewer than ``least``
    texts are left out: names and codes.
    """
    counted = None
    for df, text, label in samples:
        labelled = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), declared_code(F.col(label)).alias("label"))
        share = max(1, -(-df.count() // rows))
        part = labelled.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).mapInArrow(_count, "lang string, word string, n bigint")
        counted = part if counted is None else counted.unionByName(part)
    found = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    words: dict[str, list[float]] = {}
    by: dict[str, dict[str, float]] = {}
    for lang, word, n in found.itertuples(index=False):
        by.setdefault(word, {})[lang] = float(n)
    for lang, listed in FUNCTION_WORDS.items():
        for word in listed.split():
            by.setdefault(word, {})[lang] = by.get(word, {}).get(lang, 0.0) + 3.0
    ideographs = {w for w in by if w[:1] >= "　"}
    size = {lang: sum(c.get(lang, 0.0) for w, c in by.items() if w not in ideographs) for lang in FUNCTION_WORDS}
    whole = max(1.0, sum(size.values()))
    glyphs = {lang: 1.0 + sum(by[w].get(lang, 0.0) for w in ideographs) for lang in ("zh", "ja")}
    words: dict[str, list[float]] = {}
    han: dict[str, float] = {}
    for word, counts in by.items():
        if word in ideographs:
            z, j = ((counts.get(x, 0.0) + 0.5) / glyphs[x] for x in ("zh", "ja"))
            han[word] = float(np.clip(np.log(z / j), -2, 2))
            continue
        # How much more often than by chance the word stands in each Latin-script language. A rare word, or
        # a name that stands in all of them alike, stays close to neutral, for the other scripts' languages
        # too: they have the worst of these scores.
        total = sum(counts.values())
        row = np.log([(counts.get(x, 0.0) + 1.0) / (total * size[x] / whole + 1.0) for x in FUNCTION_WORDS])
        row = np.maximum(row - row.max(), -CLIP)
        own = dict(zip(FUNCTION_WORDS, row.tolist(), strict=True))
        words[word] = [own.get(x, float(row.min())) for x in LANGUAGES]
    return {"words": words, "han": han}


def _count(batches):
    scores = seed_scores()
    for batch in batches:
        raw, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        text, lang, _, first, size, _ = segment(scores, raw, labels)
        seen: dict[tuple[str, str], int] = {}
        for t, s, f, n in zip(text.tolist(), lang.tolist(), first.tolist(), size.tolist(), strict=True):
            name = LANGUAGES[s]
            if labels[t] not in (None, name):
                continue
            tokens = set(_TOKEN.findall(raw[t])[f : f + n])
            plain = {x.lower().replace("’", "'") for x in tokens if x[0] not in _ENDS and "_" not in x and "-" not in x and x[0] < "Ѐ"} if name in FUNCTION_WORDS else set()
            glyphs = {c for x in tokens if x[0] >= "　" for c in x if not _KANA.match(c)} if name in ("zh", "ja") else set()
            for x in plain | glyphs:
                seen[name, x] = seen.get((name, x), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])


def segments(df: DataFrame, keys: list[str], text: str, label: str, model: dict) -> DataFrame:
    """(keys, seg, lang, confidence, declared, n_seg, start, end) of every segment of every text.

    Texts that are null or have fewer than 12 letters take no part. ``declared`` is the code the label
    names, null if it names none; start and end are the tokens' numbers. Repeated rows repeat.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    held: list[Scores] = []
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"), declared_code(F.col(label)).alias("declared"))
    wide = len(keys)

    def run(batches):
        for batch in batches:
            if not held or len(held[0].at) > MOST_WORDS:
                held[:] = [Scores(sent.value["words"], sent.value["han"])]
            owner, lang, confidence, first, size, letters = segment(held[0], batch.column(wide).to_pylist(), batch.column(wide + 1).to_pylist())
            ok = letters[owner] >= LEAST_LETTERS
            owner, lang, confidence, first, size = owner[ok], lang[ok], confidence[ok], first[ok], size[ok]
            head = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, dtype=bool)
            at = np.flatnonzero(head)
            counts = np.diff(np.append(at, len(owner)))
            seg = np.arange(len(owner)) - np.repeat(at, counts)
            take = pa.array(owner)
            names = pa.DictionaryArray.from_arrays(pa.array(lang), pa.array(LANGUAGES)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in range(wide)), pa.array(seg, pa.int32()), names, pa.array(confidence), batch.column(wide + 1).take(take), pa.array(np.repeat(counts, counts), pa.int32()), pa.array(first, pa.int32()), pa.array(first + size, pa.int32())],
                names=[*keys, "seg", "lang", "confidence", "declared", "n_seg", "start", "end"],
            )

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(run, f"{kinds}seg int, lang string, confidence double, declared string, n_seg int, start int, end int")
