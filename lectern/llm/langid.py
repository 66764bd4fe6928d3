"""Problem 9: languages of documents and of their segments.

Nearest centroid: a sentence unit is a TF-IDF vector of hashed character
n-grams (three letters and whole words in alphabets, one sign in scripts whose
signs tell more), normalised and compared by cosine with several clustered centroids per language.
A unit too far from all centroids, or not far enough nearer to one language than
to another, is rejected and joins its neighbours.

The centroids are fitted on a bounded sample of the labelled rows:
``SAMPLE_DOCS`` documents and ``SAMPLE_CHARS`` characters of each label, chosen
by a hash of the id, whole texts.  Labels are noisy and documents mixed, so what
is clustered is each document's own sentences only: those that the centroid of
its label claims, and no document whose label another language claims.  Clusters
start far apart (k-means++), from several fixed starts, and the run of least
loss is kept.  How far a unit must lead is measured for each pair of languages on
documents held out of the fit, in the places where a rival claims a few sentences
of a document that is otherwise of one language.  A short public text per
language keeps every language known where a sample has none.

Defined results: NULL, empty and letterless texts have no language; a document
without any accepted unit keeps a valid label, else gets its nearest language;
ties go to the language first in ``LANGS``; a document's confidence is the share
of its letters that its language claims, times their mean lead over the nearest
rival as a share of the cosine, 0 where no unit was accepted; another language
counts as mixed in only with a whole sentence, that is with a stop mark.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.arrowio import map_texts, str_col
from lectern.llm.units import unit_arrays, units_of

LANGS = ("en", "zh", "fr", "de", "es", "pt", "ru", "ja", "hi")
SAMPLE_DOCS = 160
SAMPLE_CHARS = 160_000
#: Centroids of a language at most, one for each ``CLUSTER_DOCS`` documents, and
#: starts of which the best is kept.
CLUSTERS, CLUSTER_DOCS, STARTS = 3, 20, 6
BITS = 16
#: Least cosine with the nearest centroid, least lead over another language's,
#: and least letters (signs count three) of a unit that speaks for itself.
MIN_COSINE, MIN_LEAD, MIN_LETTERS = 0.10, 0.04, 12
#: Least lead of a sentence that its document's language is learned from.
OWN_LEAD = 0.1
#: A pair's lead is raised, up to ``MOST_LEAD``, where a rival claims more than
#: ``MISTAKES`` of the sentences of held-out documents of which all rivals claim
#: less than ``FOREIGN`` of the letters.
MOST_LEAD, FOREIGN, MISTAKES = 0.10, 0.08, 0.001
#: Characters judged at a time.
STEP = 600_000
#: Characters that a unit has to keep without its quoted phrases.
MIN_SIGNS = 6

#: Universal Declaration of Human Rights, article 1.
SEEDS = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
}


#: Hosts, addresses and file names say nothing of a unit's language.
_ADDRESS = re.compile(r"[A-Za-z0-9:/@_.~#?=&%+-]*[A-Za-z0-9][./@_][A-Za-z0-9][A-Za-z0-9:/@_.~#?=&%+-]*")


_ENCLOSING, _STOPS = "”“»«」』›\"＂〞〟’')）]］】 \u00a0\u202f", frozenset(".!?。！？।॥．｡…")


#: A short phrase in quotation marks that isn't speech: no stop or comma in it,
#: none behind it.
_PHRASE = re.compile(r"(?:“[^“”.!?,;:…。！？，\n]{1,48}”|«[^«».!?,;:…\n]{1,48}»|„[^„“”.!?,;:…\n]{1,48}[“”])(?!\s?[,—–-])")


def _sentences(parts: list[str]) -> np.ndarray:
    """Which units end with a stop mark; headings and verse don't."""
    return np.fromiter((p.rstrip(_ENCLOSING)[-1:] in _STOPS for p in parts), dtype=bool, count=len(parts))


def _own_words(part: str) -> str:
    """A unit without addresses and quoted phrases, unless little is left."""
    if part.find(".", 0, -1) >= 0 or "/" in part or "@" in part or "_" in part:
        part = _ADDRESS.sub(" ", part)
    if "“" in part or "«" in part or "„" in part:
        rest = _PHRASE.sub(" ", part)
        if len(rest) != len(part) and sum(map(str.isalpha, rest)) >= MIN_SIGNS:
            return rest
    return part


def label_code(label: str | None) -> str | None:
    """The language of a label as delivered, or None."""
    code = re.split(r"[-_]", (label or "").strip().lower())[0]
    return code if code in LANGS else None


def label_code_col(col: F.Column) -> F.Column:
    code = F.split(F.lower(F.regexp_replace(F.trim(col), r"^[\s 　]+|[\s 　]+$", "")), "[-_]")[0]
    return F.when(code.isin(*LANGS), code)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower) by code: 0 no letter, 1 letter of an alphabet, 2 sign."""
    kind = np.zeros(0x110000, dtype=np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x30000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LM":
            kind[c] = 1
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    for a, b in ((0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7B0), (0xF900, 0xFB00), (0x20000, 0x30000)):
        kind[a:b] = np.where(kind[a:b] == 1, 2, 0)
    lower[kind == 0] = 32
    return kind, lower


_PLACES = np.asarray([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(40)], dtype=np.uint64)


def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part << BITS | feature) of every n-gram, sorted, and each part's letters
    and signs."""
    kinds, lower = _tables()
    n = len(parts)
    lens = np.fromiter((len(p) + 2 for p in parts), dtype=np.int64, count=n)
    raw = np.frombuffer((" " + "  ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if n else np.zeros(0, np.uint32)
    who = np.repeat(np.arange(n), lens)
    kind = kinds[raw]
    low = lower[raw].astype(np.uint64)
    letters = np.bincount(who[kind == 1], minlength=n)
    signs = np.bincount(who[kind == 2], minlength=n)
    m = np.uint64(0x9E3779B97F4A7C15)
    one = np.flatnonzero(kind == 2)
    h1 = (low[one] * m) >> np.uint64(64 - BITS)
    mid = np.flatnonzero(kind == 1)
    h3 = ((low[mid - 1] * np.uint64(0x9E3779B1) + low[mid]) * np.uint64(0x85EBCA6B) + low[mid + 1]) * m >> np.uint64(64 - BITS)
    # Whole words of alphabets: their letters weighted by place.
    first = mid[kind[mid - 1] != 1]
    if len(first):
        place = np.arange(len(mid)) - np.repeat(np.searchsorted(mid, first), np.diff(np.append(np.searchsorted(mid, first), len(mid))))
        word = np.add.reduceat(low[mid] * _PLACES[np.minimum(place, len(_PLACES) - 1)], np.searchsorted(mid, first))
        hw = (word ^ (word >> np.uint64(31))) * m >> np.uint64(64 - BITS)
    else:
        hw = np.zeros(0, np.uint64)
    key = np.concatenate(((who[one] << BITS) | h1.astype(np.int64), (who[mid] << BITS) | h3.astype(np.int64), (who[first] << BITS) | hw.astype(np.int64)))
    key.sort()
    return key, letters, signs


class Model:
    """Centroids of all languages, ``weights[feature, centroid]``, and the least
    ``leads[claimed, rival]``."""

    def __init__(self, idf: np.ndarray, weights: np.ndarray, langs: np.ndarray, leads: np.ndarray | None = None) -> None:
        self.idf, self.weights, self.langs = idf, weights, langs
        self.starts = np.flatnonzero(np.diff(langs, prepend=-1))
        self.known = langs[self.starts]
        self.leads = np.full((len(LANGS), len(LANGS)), MIN_LEAD) if leads is None else leads

    def cosines(self, key: np.ndarray, n: int) -> np.ndarray:
        """[owner, language]: cosine with the nearest centroid of each."""
        out = np.zeros((n, len(LANGS)), dtype=np.float32)
        if not len(key):
            return out
        first = np.flatnonzero(np.diff(key, prepend=-1))
        tf = np.diff(np.append(first, len(key))).astype(np.float32)
        key = key[first]
        f = key & ((1 << BITS) - 1)
        who = key >> BITS
        w = (1 + np.log(tf)) * self.idf[f]
        at = np.flatnonzero(np.diff(who, prepend=-1))
        norm = np.sqrt(np.add.reduceat(w * w, at))
        dots = np.add.reduceat(self.weights[f] * w[:, None], at, axis=0) / np.maximum(norm, 1e-9)[:, None]
        best = np.maximum.reduceat(dots, self.starts, axis=1)
        out[np.ix_(who[at], self.known)] = best
        return out

    def decided(self, cos: np.ndarray, size: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language or -1, cosine, lead, nearest language, its rival) of units,
        ``size`` their letters and signs."""
        own = np.arange(len(cos))
        best = cos.argmax(1)
        top = cos[own, best]
        rest = cos.copy()
        rest[own, best] = -1
        rival = rest.argmax(1)
        lead = top - rest[own, rival]
        ok = (top >= MIN_COSINE) & (lead >= self.leads[best, rival]) & (size + 2 * signs >= MIN_LETTERS)
        return np.where(ok, best, -1), top, lead, best, rival


def _weighted(key: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, feature, weight) of sorted keys; each owner's vector has length 1."""
    first = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(np.append(first, len(key)))
    f = key[first]
    who, f = f >> BITS, f & ((1 << BITS) - 1)
    w = (1 + np.log(tf)) * idf[f]
    norm = np.sqrt(np.bincount(who, weights=w * w, minlength=n))
    return who, f, (w / np.maximum(norm[who], 1e-9)).astype(np.float32)


def _clustered(own: np.ndarray, gram: np.ndarray, m: int, starts: int = STARTS) -> np.ndarray:
    """Centroids of rows of length 1 (``gram``: their products): spherical k-means
    from far-apart starts, the run of least loss."""
    if m < 2:
        return _unit(own.sum(0))[None]
    # The products are all the runs need: a centroid is a sum of rows.
    best, least = None, np.inf
    for seed in range(starts):
        rng = np.random.default_rng(seed)
        first = [int(rng.integers(len(own)))]
        while len(first) < m:
            far = np.maximum(1 - gram[:, first].max(1), 0) + 1e-9
            first.append(int(rng.choice(len(own), p=far / far.sum())))
        cos = gram[:, first]
        for _ in range(12):
            near = cos.argmax(1)
            member = (near[:, None] == np.arange(m)).astype(np.float32)
            sums = gram @ member
            cos = sums / np.sqrt(np.maximum((member * sums).sum(0), 1e-9))
        near, loss = cos.argmax(1), float((1 - cos.max(1)).sum())
        if loss < least:
            best, least = near, loss
    # A cluster of hardly any rows is noise.
    size = np.bincount(best, minlength=m)
    return np.stack([_unit(own[best == j].sum(0)) for j in range(m) if size[j] >= max(2, len(own) // (8 * m))])


def fit(rows: list[tuple[str, str]], clusters: int = CLUSTERS, lead: float | None = None) -> Model:
    """Fit centroids on (label, text) rows; the labels may be wrong in part and
    the texts mixed.  Every fifth row measures the leads only; with ``lead`` none
    does, and all pairs of languages have that one (for rows put together of
    parts that may each have a wrong label)."""
    rows = [*SEEDS.items(), *(r for r in rows if r[1] and r[1].strip())]
    texts = [t for _, t in rows]
    y = np.asarray([LANGS.index(c) for c, _ in rows])
    who, start, end = unit_arrays(texts)
    parts = [_own_words(texts[i][a:b]) for i, a, b in zip(who.tolist(), start.tolist(), end.tolist())]
    key, letters, signs = features(parts)
    size = letters + signs
    part, feature = key >> BITS, key & ((1 << BITS) - 1)
    n = len(rows)
    held = (np.arange(n) % 5 == 4) & (np.arange(n) >= len(SEEDS))
    doc_key = np.sort(who[part] << BITS | feature)
    df = np.bincount(doc_key[np.diff(doc_key, prepend=-1) > 0] & ((1 << BITS) - 1), minlength=1 << BITS)
    idf = (np.log((1 + n) / (1 + df)) + 0.3).astype(np.float32)

    def single(keep: np.ndarray, rows_of: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Model:
        """One centroid a language."""
        owner, f, w = rows_of
        sums = np.bincount(y[owner] << BITS | f, weights=w * keep[owner], minlength=len(LANGS) << BITS).reshape(len(LANGS), -1)
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        return Model(idf, np.ascontiguousarray(c.T.astype(np.float32)), np.arange(len(LANGS)))

    def judged(model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Each part's language, and the share of its letters that a document's
        label claims."""
        cos = _cosines(model, key, part, len(parts))
        lang, _, lead, *_ = model.decided(cos, size, signs)
        claimed = np.bincount(who, weights=np.where(lang == y[who], size, 0), minlength=n)
        return np.where(lead >= OWN_LEAD, lang, -1), claimed / np.maximum(np.bincount(who, weights=np.where(lang >= 0, size, 0), minlength=n), 1)

    x = _weighted(doc_key, n, idf)
    keep = np.bincount(who, weights=size, minlength=n) > 0
    for _ in range(3):  # rows put aside that another language claims
        cos = single(keep, x).cosines(doc_key, n)
        keep = (cos.argmax(1) == y) & (np.bincount(who, weights=size, minlength=n) > 0)
        keep[: len(SEEDS)] = True
    for _ in range(2):  # each document without its sentences in other languages
        lang, share = judged(single(keep, x))
        own = (lang == y[who]) | (who < len(SEEDS))
        x = _weighted(np.sort((who[part] << BITS | feature)[own[part]]), n, idf)
        keep = (share > 0.5) & (np.bincount(who[own], minlength=n) > 0)
        keep[: len(SEEDS)] = True

    def clustered(*uses: np.ndarray) -> list[Model]:
        """A model of each choice of rows; one language's rows at a time are dense."""
        cents: list[list] = [[] for _ in uses]
        langs: list[list] = [[] for _ in uses]
        owner, f, w = x
        for k in range(len(LANGS)):
            rows_of = np.flatnonzero(y == k)
            place = np.full(n, -1)
            place[rows_of] = np.arange(len(rows_of))
            mine = np.flatnonzero(place[owner] >= 0)
            dense = np.zeros((len(rows_of), 1 << BITS), dtype=np.float32)
            dense[place[owner[mine]], f[mine]] = w[mine]
            gram = dense @ dense.T
            for use, c, lang in zip(uses, cents, langs):
                i = np.flatnonzero(use[rows_of])
                got = _clustered(dense[i], gram[np.ix_(i, i)], min(clusters, max(1, len(i) // CLUSTER_DOCS)))
                c += [*got]
                lang += [k] * len(got)
        return [Model(idf, np.ascontiguousarray(np.stack(c).T), np.asarray(lang)) for c, lang in zip(cents, langs)]

    if lead is not None:
        (whole,) = clustered(keep)
        return Model(idf, whole.weights, whole.langs, np.full((len(LANGS), len(LANGS)), lead))
    # What rivals reach in held-out documents that are otherwise of one language.
    trial, whole = clustered(keep & ~held, keep)
    cos = _cosines(trial, key, part, len(parts))
    lang, _, led, *_ = trial.decided(cos, size, signs)
    share = judged(trial)[1]
    pure = held[who] & (share[who] > 1 - FOREIGN) & _sentences(parts)
    leads = np.full((len(LANGS), len(LANGS)), MIN_LEAD)
    for a in range(len(LANGS)):
        for b in range(len(LANGS)):
            own = pure & (y[who] == b)
            wrong = np.sort(led[own & (lang == a)])[::-1] if a != b else []
            most = int(MISTAKES * own.sum())
            if len(wrong) > most:
                leads[a, b] = min(MOST_LEAD, max(MIN_LEAD, float(wrong[most]) + 0.005))
    return Model(idf, whole.weights, whole.langs, leads)


def _cosines(model: Model, key: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
    """``Model.cosines`` of sorted keys, some features at a time."""
    out = np.zeros((n, len(LANGS)), dtype=np.float32)
    at = 0
    while at < len(key):
        end = min(at + STEP, len(key))
        end = len(key) if end == len(key) else int(np.searchsorted(part, part[end]))
        end = end if end > at else int(np.searchsorted(part, part[at], "right"))
        first = int(part[at])
        last = int(part[end - 1]) + 1
        out[first:last] = model.cosines(key[at:end] - (first << BITS), last - first)
        at = end
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), 1e-9)


def sample(docs: DataFrame, per_label: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most ``per_label`` whole documents and about ``chars`` characters of
    each label, by a hash of the id.  The counts read the label column only."""
    coded = docs.select("doc_id", "text", label_code_col(F.col("lang")).alias("code")).where("code is not null and doc_id is not null")
    counts = {r.code: r["count"] for r in coded.groupBy("code").count().collect()}
    if not counts:
        return []
    span = 1 << 30
    share = F.create_map(*(F.lit(v) for c, n in counts.items() for v in (c, int(span * min(1.0, 1.3 * per_label / n)))))
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    some = coded.where((mark < share[F.col("code")]) & (F.length("text") < chars)).select("doc_id", "code", mark.alias("mark"), F.length("text").alias("n"), "text")
    # About 1.3 * per_label rows a label are left: their running sums are small.
    w = Window.partitionBy("code").orderBy("mark", "doc_id")
    bounded = some.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("place", F.row_number().over(w))
    got = bounded.where((F.col("before") < chars) & (F.col("place") <= per_label)).select("code", "mark", "doc_id", "text").collect()
    return [(r.code, r.text) for r in sorted(got, key=lambda r: (r.mark, r.doc_id))]


def _judged(model: Model, texts: list[str]) -> tuple[list[list[tuple[int, int]]], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units of each text, then of all units: letters, language or -1, cosine,
    lead, nearest language, is it a whole sentence)."""
    owners = units_of(texts)
    parts = [_own_words(t[a:b]) for t, own in zip(texts, owners) for a, b in own]
    n = len(parts)
    cos, letters, signs = np.zeros((n, len(LANGS)), dtype=np.float32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    at = 0
    while at < n:  # so many units at a time that their n-grams stay small
        end, size = at + 1, len(parts[at])
        while end < n and size < STEP:
            size += len(parts[end])
            end += 1
        key, letters[at:end], signs[at:end] = features(parts[at:end])
        cos[at:end] = model.cosines(key, end - at)
        at = end
    lang, top, lead, best, _ = model.decided(cos, letters + signs, signs)
    return owners, letters + signs, lang, top, lead, best, _sentences(parts)


def unit_languages(model: Model, texts: list[str]) -> list[list[tuple[int, int, int, int, float, float, int]]]:
    """Per text: (start, end, letters, language or -1, cosine, lead, nearest
    language) of its units."""
    owners, *cols, _ = _judged(model, texts)
    rows = list(zip(*(c.tolist() for c in cols)))
    out, i = [], 0
    for own in owners:
        out.append([(a, b, *rows[i + j]) for j, (a, b) in enumerate(own)])
        i += len(own)
    return out


def _cases(model: Model, ids: list, texts: list, labels: list) -> dict[str, list]:
    owners, n, lang, _, _, near, whole = _judged(model, [t or "" for t in texts])
    k = len(LANGS)
    doc = np.repeat(np.arange(len(texts)), [len(o) for o in owners])
    ok = lang >= 0
    letters = np.bincount(doc[ok] * k + lang[ok], weights=n[ok], minlength=len(texts) * k).reshape(-1, k)
    # Another language must hold a whole sentence: a heading alone tells too little.
    told = np.bincount(doc[ok] * k + lang[ok], weights=whole[ok], minlength=len(texts) * k).reshape(-1, k) > 0
    loose = np.bincount(doc * k + near, weights=n, minlength=len(texts) * k).reshape(-1, k)
    out: dict[str, list] = {"doc_id": [], "case_kind": [], "lang": []}
    for i, label, sure, any_, spoken in zip(ids, labels, letters, loose, told):
        if i is None or not any_.any():
            continue
        code = label_code(label)
        if sure.any():
            own = LANGS[int(sure.argmax())]
        else:
            own = code or LANGS[int(any_.argmax())]
        found = [("label", own)] if code != own else []
        spoken[LANGS.index(own)] = True
        if spoken.sum() > 1:
            found += [("mixed", LANGS[j]) for j in np.flatnonzero(spoken)]
        for kind, c in found:
            out["doc_id"].append(i)
            out["case_kind"].append(kind)
            out["lang"].append(c)
    return out


def language_cases(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, case_kind, lang) of wrong or missing labels and mixed documents."""
    model = model or fit(sample(docs))

    def fn(b: pa.RecordBatch) -> dict[str, list]:
        return _cases(model, str_col(b, "doc_id"), str_col(b, "text"), str_col(b, "lang"))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    return map_texts(rows, fn, "doc_id bigint, case_kind string, lang string", ["text"]).distinct()


def language_segments(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos, lang, confidence) of every stretch of one
    language; a document of one language is one stretch.  The confidence is the
    mean lead over the nearest other language, by letters, as a share of the
    cosine."""
    model = model or fit(sample(docs))

    def fn(b: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": [], "start_pos": [], "end_pos": [], "lang": [], "confidence": []}
        texts = [t or "" for t in str_col(b, "text")]
        for i, units in zip(str_col(b, "doc_id"), unit_languages(model, texts)):
            runs: list[list] = []
            for a, e, n, lang, top, lead, near in units:
                if lang < 0 and runs:
                    runs[-1][1] = e
                elif runs and runs[-1][2] in (lang, -1):
                    runs[-1][1:3] = [e, lang]
                    runs[-1][3] += n
                    runs[-1][4] += n * lead / max(top, 1e-9)
                elif n:
                    runs.append([a, e, lang, n, n * lead / max(top, 1e-9), near])
            for a, e, lang, n, sure, near in runs:
                out["doc_id"].append(i)
                out["start_pos"].append(a)
                out["end_pos"].append(e)
                out["lang"].append(LANGS[lang if lang >= 0 else near])
                out["confidence"].append(round(min(1.0, sure / max(n, 1)), 4) if lang >= 0 else 0.0)
        return out

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    return map_texts(rows, fn, "doc_id bigint, start_pos int, end_pos int, lang string, confidence double", ["text"])


def document_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang, confidence) of every document with letters."""
    model = model or fit(sample(docs))

    def fn(b: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": [], "lang": [], "confidence": []}
        texts = [t or "" for t in str_col(b, "text")]
        for i, label, units in zip(str_col(b, "doc_id"), str_col(b, "lang"), unit_languages(model, texts)):
            sure, loose, weight = [0] * len(LANGS), [0] * len(LANGS), [0.0] * len(LANGS)
            for _, _, n, lang, top, lead, near in units:
                loose[near] += n
                if lang >= 0:
                    sure[lang] += n
                    weight[lang] += n * min(1.0, lead / max(top, 1e-9))
            if i is None or not any(loose):
                continue
            own = max(range(len(LANGS)), key=lambda k: (sure[k], -k))
            code = LANGS[own] if sure[own] else label_code(label) or LANGS[max(range(len(LANGS)), key=lambda k: (loose[k], -k))]
            out["doc_id"].append(i)
            out["lang"].append(code)
            out["confidence"].append(round(weight[own] / sum(loose), 4) if sure[own] else 0.0)
        return out

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    return map_texts(rows, fn, "doc_id bigint, lang string, confidence double", ["text"]).dropDuplicates(["doc_id"])
