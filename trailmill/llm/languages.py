"""Missing or wrong document language labels (problem 8).

A multilingual mixture: every sentence of a document has a likelihood under each language's character n-gram model;
expectation-maximisation estimates the document's language proportions from them, and the set of languages is selected
by penalised likelihood: a language stays only if leaving it out costs more than `PENALTY` (nats). Stretches of
sentences that the mixture gives to one language are the segments.

Models are hashed n-grams (n = 2, 3) of lower-case text without accents on Latin letters, trained here on about
`TRAIN_DOCS` labelled documents, a sample by hash of the id. As labels are partly wrong, each round trains on the
sentences that the models of the round before give to the language.

What counts as prose: code fences, log lines, traces, headings, quoted messages of at most QUOTE characters, inline code,
paths, identifiers and markup are blanked; a sentence ends with a full stop, question or exclamation mark and has at
least three words, or four Chinese or Japanese characters.

Defined cases: null and empty texts, and texts without prose, hold no language and get empty lists; null, empty and
unknown labels name none; without any usable label in the table no language can be trained, and nothing is found;
repeated texts are texts; further columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import map_arrow, spread

#: The languages, with their three-letter codes and English names.
LANGUAGES = {
    "en": ("eng", "english"), "zh": ("zho", "chi", "cmn", "chinese", "mandarin"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish", "castilian"), "pt": ("por", "portuguese"), "ru": ("rus", "russian"), "ja": ("jpn", "japanese"),
}
CODES = tuple(LANGUAGES)
_NAMES = {n: code for code, names in LANGUAGES.items() for n in (code, *names)}

TRAIN_DOCS = 4_000
TRAIN_CHARS = 20_000
ROUNDS = 3
BITS = 16
PENALTY = 6.0
SURE = 25.0
QUOTE = 100
#: Sentences of which a document must have so many to hold a language.
LEAST = 2


def label(name: str | None) -> str | None:
    """The two-letter code that a label names: by any letter case, with a region or script, three letters, or in English."""
    if not name:
        return None
    return _NAMES.get(re.split(r"[-_\s(]", name.strip().lower(), maxsplit=1)[0])


def _blank(m: re.Match) -> str:
    """Marks of the same length that are no letters, no white space and end no sentence."""
    return "\1" * len(m[0]) if "\n" not in m[0] else re.sub(r"[^\n]", "\1", m[0])


_ENTITY = re.compile(r"&(?:#\d{1,6}|#x[0-9a-fA-F]{1,6}|[A-Za-z]{2,8}\d?);")
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_LINES = re.compile(
    r"^(?:[ \t]*#{1,6}[ \t].*|.*[=\-]{4,}.*|\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d.*|\[?\d\d:\d\d:\d\d.*|Traceback \(.*|[ \t]+(?:File \"|at ).*|(?:diff --git|index |@@ |\+\+\+ |--- ).*|</?\w+>.*|\$ .*)$", re.M
)
_INLINE = re.compile(
    r"`[^`\n]*`|</?[A-Za-z][^>\n]{0,80}>|https?://[^\s。]+|(?a:(?<![\w.~/-])[\w.~-]*/[\w./~-]*\w|\b[A-Za-z\d]*_\w+|\b\w+\.\w{1,4}\b(?=[\s,;:)]|$)|\b[A-Za-z]+\d+\b|\b[a-z]+[A-Z]\w*|\b(?:[A-Z][a-z0-9]+){2,}\b)"
)
_SPAN = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(rf"\"[^\"\n]{{0,{QUOTE}}}\"|“[^”\n]{{0,{QUOTE}}}”|«[^»\n]{{0,{QUOTE}}}»|「[^」\n]{{0,{QUOTE}}}」|『[^』\n]{{0,{QUOTE}}}』|„[^“”\n]{{0,{QUOTE}}}[“”]")
_WRAP = re.compile(r"\n(?<=[^\W\d_]\n)(?=[a-zà-ÿа-яё])(?![A-Za-z_]+:)")
_STOP = re.compile(r"[.!?…。！？](?:(?<=[。！？])|(?=[\s\"'»”)\]]|$))")
_MARKS = re.compile(r"[`/_<]")
_LEAD = re.compile(r"[\s>*+\-•\d.)(\"'»”\]]*(?:[A-Za-z_]+:[ \t])?")
_EAST = "぀-ヿ㐀-䶿一-鿿"
_PROSE = re.compile(rf"(?:[{_EAST}][^{_EAST}]*+){{4}}|(?<![^\W\d_])(?:[^\W\d_]++[\W\d_]++){{3}}")


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(from, to, sentence) of the prose of a text; offsets are those of the text."""
    t = text.replace("\r", " ")
    if "&" in t:
        t = _ENTITY.sub(lambda m: (u := html.unescape(m[0]))[:1].ljust(len(m[0]), "\0") if len(html.unescape(m[0])) == 1 else m[0], t)
    if "```" in t or "~~~" in t:
        t = _FENCE.sub(_blank, t)
    t = _LINES.sub(_blank, t)
    t = _SPAN.sub(_blank, t)
    t = _QUOTED.sub(_blank, t)
    t = _WRAP.sub(" ", t)
    out, start = [], 0
    for m in _STOP.finditer(t):
        stop = m.end()
        start = max(start, t.rfind("\n", start, stop) + 1)  # what a line leaves without an end is no sentence
        if stop - start > 3:
            lead = _LEAD.match(t, start, stop).end()
            s = t[lead:stop]
            if "\0" in s:
                s = s.replace("\0", "")
            if _MARKS.search(s):
                s = _INLINE.sub(" ", s)
            if _PROSE.search(s):
                out.append((lead, stop, s.lower()))
        start = stop
    return out


def _fold_table() -> np.ndarray:
    """Code point -> symbol: Latin letters lose their accents; what is no letter becomes one space."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x20, 0x30000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(unicodedata.normalize("NFD", ch)[0]) if c < 0x250 else c
    return table


_FOLD: list[np.ndarray] = []


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of every n-gram, and the number of the text that it is in, ascending."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    joined = np.frombuffer(" ".join(texts).encode("utf-32-le", "replace"), np.uint32)
    symbols = _FOLD[0][joined]
    sizes = np.array([len(t) + 1 for t in texts])
    sizes[-1] -= 1
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = np.concatenate(([True], (symbols[1:] != 0) | (symbols[:-1] != 0)))  # runs of other signs count as one
    symbols, owner = symbols[keep].astype(np.uint64), owner[keep]
    shift = np.uint64(64 - BITS)
    two = (symbols[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ symbols[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
    three = (two[:-1] ^ symbols[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    own2, own3 = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    return [((two >> shift)[own2].astype(np.int64), owner[:-1][own2]), ((three >> shift)[own3].astype(np.int64), owner[:-2][own3])]


def likelihoods(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Log-likelihood of every text under every language."""
    out = np.zeros((len(texts), model.shape[1]), np.float32)
    for low in range(0, len(texts), 1_000):
        part = texts[low : low + 1_000]
        for grams, owner in features(part):
            if len(grams):
                first = np.concatenate(([0], np.nonzero(np.diff(owner))[0] + 1))
                out[low + owner[first]] += np.add.reduceat(model[grams], first, 0)
    return out


def fit(texts: list[str], langs: list[str], rounds: int = ROUNDS) -> tuple[np.ndarray, tuple[str, ...]]:
    """(log-probability of each bucket by language, languages) from sentences with partly wrong labels."""
    codes = tuple(c for c in CODES if c in set(langs))
    if not codes:
        return np.zeros((1 << BITS, 0), np.float32), ()
    grams, owner = (np.concatenate(x) for x in zip(*features(texts)))
    now = np.array([codes.index(x) for x in langs])
    for r in range(rounds):
        counts = np.stack([np.bincount(grams[now[owner] == k], minlength=1 << BITS) for k in range(len(codes))], 1)
        model = np.log((counts + 0.3) / (counts.sum(0) + 0.3 * (1 << BITS))).astype(np.float32)
        if r < rounds - 1:
            now = likelihoods(texts, model).argmax(1)
    return model, codes


def train(documents: DataFrame, key: str = "doc_id", docs: int = TRAIN_DOCS) -> tuple[np.ndarray, tuple[str, ...]]:
    """Models from about `docs` documents (chosen by hash of the id) of at most TRAIN_CHARS characters with a label."""
    rows = documents.where("text IS NOT NULL AND lang IS NOT NULL").select(key, "text", "lang")
    span = 1 << 30
    chosen = rows.where((F.pmod(F.xxhash64(F.lit(11), key), F.lit(span)) < int(span * min(1.0, docs / max(1, documents.count())))) & (F.length("text") <= TRAIN_CHARS))
    texts, langs = [], []
    for row in chosen.select("text", "lang").limit(2 * docs).collect():
        if code := label(row.lang):
            for _, _, s in sentences(row.text):
                texts.append(s)
                langs.append(code)
    return fit(texts, langs) if texts else (np.zeros((1 << BITS, 0), np.float32), ())


def mixtures(logs: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(proportions by document, posteriors by sentence) of the selected languages.

    `logs`: log-likelihood of each sentence by language; `doc`: the sentence's document, ascending. Where all sentences
    of a document prefer one language by SURE nats, no other could pass the penalty, and the estimate is that language.
    """
    top = np.partition(logs, -2, 1)[:, -2:] if logs.shape[1] > 1 else np.stack([logs[:, 0] - SURE, logs[:, 0]], 1)
    best = logs.argmax(1)
    plain = np.ones(n_docs, bool)
    plain[doc[top[:, 1] - top[:, 0] < SURE]] = False
    plain[doc[1:][(doc[1:] == doc[:-1]) & (best[1:] != best[:-1])]] = False
    share, post = np.zeros((n_docs, logs.shape[1])), np.zeros(logs.shape)
    post[np.arange(len(doc)), best] = 1
    share[doc, best] = 1
    mixed = np.nonzero(~plain)[0]
    if len(mixed):
        some = ~plain[doc]
        share[mixed], post[some] = _mixtures(logs[some].astype(float), np.searchsorted(mixed, doc[some]), len(mixed), penalty)
    return share, post


def _mixtures(logs: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    k = logs.shape[1]
    starts = np.searchsorted(doc, np.arange(n_docs))
    size = np.bincount(doc, minlength=n_docs)
    filled = size > 0
    rel = np.exp(np.clip(logs - logs.max(1, keepdims=True), -600, 0))

    def total(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n_docs, *x.shape[1:]))
        if len(x):
            out[filled] = np.add.reduceat(x, starts[filled], 0)
        return out

    def maximise(share: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            post = share[doc] * rel
            post /= post.sum(1, keepdims=True) + 1e-300
            share = total(post) / np.maximum(size, 1)[:, None]
        return share

    share = maximise(np.full((n_docs, k), 1.0 / k), 12)
    for _ in range(k - 1):
        mass = share[doc] * rel
        whole = mass.sum(1, keepdims=True)
        # What it costs to leave a language out, the others keeping their proportions to each other.
        rest = np.clip(1 - share[doc], 1e-12, None)
        loss = total(np.log(whole + 1e-300) - np.log(np.clip(whole - mass, 0, None) / rest + 1e-300))
        loss[share <= 0] = np.inf
        weakest = loss.argmin(1)
        at = np.arange(n_docs)
        drop = filled & (loss[at, weakest] < penalty) & ((share > 0).sum(1) > 1)
        if not drop.any():
            break
        share[at[drop], weakest[drop]] = 0
        share /= share.sum(1, keepdims=True) + 1e-300
        share = maximise(share, 4)
    post = share[doc] * rel
    post /= post.sum(1, keepdims=True) + 1e-300
    return share, post


_OUT = pa.struct([("lang", pa.string()), ("sentences", pa.int32()), ("share", pa.float64()), ("confidence", pa.float64())])
_SEGMENT = pa.struct([("char_from", pa.int64()), ("char_to", pa.int64()), ("lang", pa.string()), ("sentences", pa.int32()), ("confidence", pa.float64())])


def _lists(owner: np.ndarray, n: int, fields: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """A list of structs for each of n rows; `owner` is the row of each struct, ascending."""
    ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, fields=list(kind)))


def _identify(model, codes: tuple[str, ...], penalty: float):
    names = np.array(codes, object)

    def one(ids: pa.Array, texts: list, labels: list) -> pa.RecordBatch:
        found, doc, low, high = [], [], [], []
        for d, t in enumerate(texts):
            for a, b, s in sentences(t) if t else ():
                found.append(s)
                doc.append(d)
                low.append(a)
                high.append(b)
        owner, k = np.array(doc if codes else [], np.int64), max(1, len(codes))
        if len(owner):
            share, post = mixtures(likelihoods(found, model.value), owner, len(texts), penalty)
            best, sure = post.argmax(1), post.max(1)
        else:
            share, best, sure = np.zeros((len(texts), k)), np.zeros(0, np.int64), np.zeros(0)
        both = owner * k + best
        count, total = np.bincount(both, minlength=len(texts) * k), np.bincount(both, sure, len(texts) * k)
        held = np.nonzero(count)[0]
        langs = [pa.array(names[held % k], pa.string()), pa.array(count[held], pa.int32()), pa.array(share.ravel()[held]), pa.array(total[held] / count[held])]
        first = np.nonzero(np.concatenate(([True], both[1:] != both[:-1])))[0] if len(both) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(both)))
        spans = [
            pa.array(np.array(low, np.int64)[first]), pa.array(np.array(high, np.int64)[first + size - 1]), pa.array(names[best[first]], pa.string()),
            pa.array(size, pa.int32()), pa.array(np.add.reduceat(sure, first) / size if len(first) else sure),
        ]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([label(x) for x in labels], pa.string()), _lists(held // k, len(texts), langs, _OUT), _lists(owner[first], len(texts), spans, _SEGMENT)],
            names=["id", "label", "langs", "segments"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield one(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist())

    return run


def identify(documents: DataFrame, key: str = "doc_id", penalty: float = PENALTY, docs: int = TRAIN_DOCS) -> DataFrame:
    """(key, label, langs, segments): the code the delivered label names, every language with its number of sentences,
    share and confidence, and the stretches of text in one language with theirs."""
    trained, codes = train(documents, key, docs)
    model = documents.sparkSession.sparkContext.broadcast(trained)
    kind = dict(documents.dtypes)[key]
    schema = (
        f"id {kind}, label string, langs array<struct<lang string, sentences int, share double, confidence double>>, "
        "segments array<struct<char_from bigint, char_to bigint, lang string, sentences int, confidence double>>"
    )
    return map_arrow(spread(documents.select(key, "text", "lang"), key), _identify(model, codes, penalty), schema).withColumnRenamed("id", key)


def cases(identified: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang): the languages of documents that hold several, or one that their label does not name."""
    held = F.filter("langs", lambda x: x["sentences"] >= LEAST)
    rows = identified.select(key, "label", held.alias("held"))
    wrong = (F.size("held") > 1) | ((F.size("held") == 1) & ~F.col("held")[0]["lang"].eqNullSafe(F.col("label")))
    return rows.where(wrong).select(key, F.explode("held.lang").alias("lang"))
