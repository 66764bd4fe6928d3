"""Problem 6: broken prompt and response pairs.

For each defect several noisy labelling functions vote on a pair.  The votes of
one defect are a pattern of bits; a label model (a class and, per function, its
rate of firing with and without the defect) is fitted by expectation-maximisation
to the counts of all patterns, of which there are at most 2^5 a defect whatever
the size of the data, and turns every pattern into a posterior.  A pair keeps
every defect whose posterior exceeds that defect's cutoff; p6_found gives the first
in order.  ``CUTOFFS`` are validated by ``cutoff_report``: the tests plant each
defect into held-out sound pairs of several languages, and the cutoffs lie where
precision and recall on these are best.

Texts are read once, by one Python pass that leaves a slim row per segment; jobs
are joined to the slim rows.  Only completed segments with a result send their
texts to it.  Length statistics are medians over all pairs of a language pair,
drawn towards the ratio expected of the two scripts the fewer pairs there are.
Defined results: pairs that aren't completed have no defect but a refusal in a
failed pair's error; a NULL or empty source is never a copy; a source of names,
figures and filler only may be repeated; repeated rows count once; a result in an
unknown language is in no wrong one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.arrowio import cut, map_texts, stored, str_col
from lectern.llm.langid import LANGS, MIN_LETTERS, Model, fit, unit_languages
from lectern.llm.look import INVISIBLE

DEFECTS = ("empty_answer", "refusal", "copies_source", "wrong_language", "truncated")
#: Least posterior of each defect.
CUTOFFS = {"empty_answer": 0.5, "refusal": 0.5, "copies_source": 0.5, "wrong_language": 0.5, "truncated": 0.5}
#: Rows of results that the language model is fitted on, at most, and characters of
#: each target language.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 160_000
#: Lead of a unit's language over any other.
LEAD = 0.03
#: Length of a text in a script of dense signs, against alphabets.
DENSE = {"zh": 0.32, "ja": 0.45}
#: Pairs that the expected ratio of lengths weighs as much as.
EXPECTED_PAIRS = 20

_QUOTED = re.compile(r"“[^“”\n]*”|«[^«»\n]*»|„[^„“”\n]*[“”]|「[^「」\n]*」|『[^『』\n]*』|\"[^\"\n]*\"|[“«„「『][^”»」』]*\Z")
#: How a model speaks when it declines, in ten languages.
_DECLINES = re.compile(
    r"(?i)\b(?:I|we)\s+(?:(?:really\s+|just\s+|simply\s+)?(?:can(?:no|['’])?t|cannot|won['’]t|will not|am unable|are unable|am not able|are not able|am not allowed|must decline|have to decline|need to decline|decline|refuse)\b)"
    r"|\bich\s+(?:kann|darf|muss|werde|möchte|bin)\b[^.!?\n]*\b(?:nicht|ablehnen|kein\w*|außerstande)\b|\b(?:kann|darf|muss)\s+ich\b[^.!?\n]*\b(?:nicht|ablehnen|kein\w*)\b"
    r"|\bje\s+(?:ne\s+(?:peux|puis|suis)\b|dois\s+(?:refuser|décliner)|refuse|décline)|\bil\s+m['’]est\s+impossible"
    r"|\b(?:no\s+puedo|no\s+me\s+es\s+posible|debo\s+(?:rechazar|declinar)|tengo\s+que\s+(?:rechazar|declinar)|no\s+estoy\s+(?:autorizad|en\s+condiciones))"
    r"|\b(?:não\s+posso|não\s+consigo|devo\s+recusar)|\bя\s+не\s+(?:могу|в состоянии)|вынужден\w*\s+отказать"
    r"|(?:无法|不能|没有办法|没办法|不便|不可以|拒绝|不得)(?:\w{0,8})(?:翻译|处理|提供|协助|回答|完成|继续)|(?:翻訳|お手伝い|対応)\w{0,6}(?:できません|しかねます)|मैं[^।\n]*(?:नहीं कर सकता|असमर्थ)"
)
_TASK = re.compile(
    r"(?i)\b(?:translat\w*|passage|excerpt|text|content|request|rendering|material)\b|\b(?:übersetz\w*|abschnitt|text|inhalt\w*|anfrage|passage)\b|\b(?:tradu\w+|passage|texte|contenu|extrait|demande)\b"
    r"|\b(?:traduc\w*|traduz\w*|pasaje|texto|contenido|fragmento|solicitud|trecho|conteúdo)\b|перев\w+|текст\w*|отрыв\w+|翻译|译文|文本|文字|内容|段落|片段|翻訳|文章|अनुवाद|पाठ"
)
_SORRY = re.compile(
    r"(?i)\b(?:sorry|apologi[sz]e|apologies|unfortunately|regret|as an? (?:ai|language model|assistant))\b|\b(?:leider|tut mir leid|entschuldig\w*|bedau\w+|als (?:ki|sprachmodell))\b|\b(?:désolée?|m['’]excuse|malheureusement|regrett\w+|en tant que)\b"
    r"|\b(?:lo siento|lamentablemente|disculp\w*|perdón|lamento|como modelo)\b|\b(?:desculp\w*|infelizmente|lamento)\b|к сожалению|извините|простите|抱歉|对不起|很遗憾|恕我|作为(?:\w{0,2})语言模型|作为(?:AI|人工智能)|申し訳|残念|क्षमा|खेद"
)
_REASON = re.compile(
    r"(?i)guideline|polic(?:y|ies)|protected|copyright|different text|another text|anything else|richtlinie|geschützt|anderen text|urheber|consignes|protégé|autre texte|normas|directrices|protegido|otro texto|derechos|diretrizes|outro texto|правил\w*|авторск|规定|准则|政策|受限|版权|保护|换一段|其他需要|ガイドライン|著作権"
)
_LABEL = re.compile(r"^\s*[^\s:：][^\n:：]{0,22}[:：]\s*")
_STOP_END = re.compile(r"[.!?。！？…।॥][”“»«」』\"’')）\]\s]*\Z")
_ANY_STOP = re.compile(r"[.!?。！？,，;；।、]")
_NOTE = re.compile(r"^[\[（(【].*[\]）)】]$", re.S)
_WORD = re.compile(r"[^\W\d_]+")


_FOLD = re.compile(r"[\W_]+")
_RUN = re.compile(r"\S{61,}")


def folded(text: str) -> str:
    """Letters and figures only, in one case."""
    return _FOLD.sub("", text.casefold())


def filler(text: str) -> bool:
    """No prose: without any stop or comma, and unbroken for longer than any word
    is, or mostly the same words again."""
    if _ANY_STOP.search(text):
        return False
    if _RUN.search(text):
        return True
    words = text.lower().split()
    return len(words) >= 12 and 2 * len(set(words)) <= len(words)


def only_names(text: str) -> bool:
    """Names and figures (every word capitalised, no stop mark), or filler."""
    upper = True
    for m in _WORD.finditer(text):
        if not m[0][0].isupper():
            upper = False
            break
    return upper and (not _STOP_END.search(text) or not _WORD.search(text)) or filler(text)


#: What must stand in a text for the refusal patterns to be tried.
_STEMS = ("can't", "cannot", "can not", "can’t", "cant", "won't", "won’t", "will not", "unable", "am not", "are not", "decline", "refuse", "nicht", "ablehn", "kein", "außerstande", "peux", "puis", "suis", "refus", "déclin", "impossible",
          "puedo", "posible", "rechaz", "declin", "estoy", "posso", "consigo", "recus", "могу", "состоян", "отказ", "无法", "不能", "没有办法", "没办法", "不便", "不可以", "拒绝", "不得", "できません", "しかねます", "नहीं", "असमर्थ")
_SORRY_STEMS = ("sorry", "apolog", "unfortunately", "regret", "as a", "leider", "leid", "entschuldig", "bedau", "als ki", "als sprach", "désol", "excuse", "malheureusement", "en tant", "siento", "lamento", "lamentable", "disculp", "perdón",
                "como modelo", "desculp", "infelizmente", "сожалению", "извините", "простите", "抱歉", "对不起", "很遗憾", "恕我", "作为", "申し訳", "残念", "क्षमा", "खेद")
_REASON_STEMS = ("guideline", "polic", "protected", "copyright", "another text", "different text", "anything else", "richtlinie", "geschützt", "anderen text", "urheber", "consignes", "protégé", "autre texte", "normas", "directrices", "protegido",
                 "otro texto", "derechos", "diretrizes", "outro texto", "правил", "авторск", "规定", "准则", "政策", "受限", "版权", "保护", "换一段", "其他需要", "ガイドライン", "著作権")


def _refusal_bits(text: str) -> int:
    low = text.lower()
    may_d, may_s, may_r = (any(k in low for k in keys) for keys in (_STEMS, _SORRY_STEMS, _REASON_STEMS))
    if not (may_d or may_s or may_r):
        return 0
    said = _QUOTED.sub(" ", text)
    d = _DECLINES.search(said) if may_d else None
    sorry = _SORRY.search(said) if may_s else None
    reason = _REASON.search(said) if may_r else None
    if not (d or sorry or reason):
        return 0
    task = near = False
    if d:
        a = max(said.rfind("\n", 0, d.start()), said.rfind(". ", 0, d.start()), 0)
        b = said.find("\n", d.end())
        part = said[a : b if b >= 0 else len(said)]
        task = bool(_TASK.search(part))
        near = bool(_SORRY.search(part))
    return bool(d) | task << 1 | bool(sorry) << 2 | bool(reason) << 3 | near << 4


#: Words of closed classes by which close languages differ.
FUNCTION_WORDS = {
    "en": frozenset("the a and of to was in his her with that had at from but not he she it they".split()),
    "fr": frozenset("le la les de à et des une du dans était il elle qui que sur avec pas au mais".split()),
    "de": frozenset("der die das und den ein eine war nicht mit auf im er sie dem von zu aber".split()),
    "es": frozenset("el la los las de a una y en con que su por del pero no se al fue era".split()),
    "pt": frozenset("o a os as de um uma e em com não seu por do da mas no na ao".split()),
}
_LANGS_OF = {w: tuple(LANGS.index(c) for c in FUNCTION_WORDS if w in FUNCTION_WORDS[c]) for ws in FUNCTION_WORDS.values() for w in ws}
_SCRIPTS = {1: ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250)), 2: ((0x3400, 0xA000),), 3: ((0x3040, 0x3100),), 4: ((0x400, 0x500),), 5: ((0x900, 0x980),)}
_SCRIPT_OF = np.zeros(0x110000, dtype=np.uint8)
for _k, _ranges in _SCRIPTS.items():
    for _a, _b in _ranges:
        _SCRIPT_OF[_a:_b] = _k


def _scripts(text: str) -> list[int]:
    """Letters of each language's script; Chinese signs beside kana are Japanese."""
    n = np.bincount(_SCRIPT_OF[_codes(text)], minlength=6).tolist()
    own = {"zh": 0 if n[3] else n[2], "ja": n[2] + n[3], "ru": n[4], "hi": n[5]}
    return [own.get(c, n[1]) for c in LANGS]


def _small_words(text: str) -> list[int]:
    out = [0] * len(LANGS)
    for w in text.lower().split():
        for k in _LANGS_OF.get(w, ()):
            out[k] += 1
    return out


_VOTES = (
    "id bigint, job_id bigint, status string, empty_bits int, refusal int, copy_bits int, same boolean, sl string, rl string, "
    "letters array<int>, scripts array<int>, words array<int>, ls int, lr int, n int, m int, no_stop boolean, broken boolean"
)


def _grams(codes: np.ndarray) -> np.ndarray:
    """Distinct runs of four characters, as sorted numbers."""
    if len(codes) < 4:
        return codes.astype(np.uint64).sum(keepdims=True)
    c = codes.astype(np.uint64)
    return np.unique(((c[:-3] << np.uint64(42)) ^ (c[1:-2] << np.uint64(28)) ^ (c[2:-1] << np.uint64(14)) ^ c[3:]))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _repeated(source: str, result: str) -> bool:
    """Whether nearly all of the source's runs of characters stand in the result."""
    if not source:
        return False
    own = _grams(_codes(source))
    return np.isin(own, _grams(_codes(result)), assume_unique=True).sum() >= 0.85 * len(own)


def _read(model: Model, b: pa.RecordBatch, prepare: Callable | None) -> dict[str, list]:
    """Slim rows of votes, with the columns of ``prepare`` (units and words of both
    sides) where given."""
    rows = [dict(zip(b.schema.names, r)) for r in zip(*(str_col(b, c) for c in b.schema.names))]
    src = [r["source_text"] or "" for r in rows]
    res = [r["result_text"] or "" for r in rows]
    # Languages only where both sides are there.
    both = [i for i in range(len(rows)) if res[i].strip() and src[i].strip()]
    units = unit_languages(model, [src[i] for i in both] + [res[i] for i in both])
    su, ru = dict(zip(both, units)), dict(zip(both, units[len(both) :]))
    out: dict[str, list] = {c.split()[0]: [] for c in _VOTES.split(", ")}
    more: dict[str, list] = {}
    for i, r in enumerate(rows):
        if r["id"] is None:
            continue
        s, t, done = src[i], res[i], r["status"] == "completed"
        said = t if done else r["error_message"] or ""
        ft = folded(t)
        plain = INVISIBLE.sub("", t).strip() if len(set(ft)) < 7 else ft  # more is never empty
        row = {
            "id": r["id"], "job_id": r["job_id"], "status": r["status"], "refusal": _refusal_bits(said),
            "empty_bits": (not ft) | (len(plain) <= 6) << 1 | (len(set(plain)) < 2) << 2 if done else 0,
            "copy_bits": 0, "same": False, "sl": None, "rl": None, "letters": None, "scripts": None, "words": None, "ls": 0, "lr": 0, "n": 0, "m": 0, "no_stop": False, "broken": False,
        }
        if i in su:
            fs = folded(s)
            fb = folded(t[m.end() :]) if (m := _LABEL.match(t)) else ft
            own = [folded(s[a:e]) for a, e, *_ in su[i]]
            forms = set(own)
            kept, made = [], set()
            for j, u in enumerate(ru[i]):
                p = t[u[0] : u[1]]
                f = folded(p)
                if not j and f not in forms:  # a label may stand before the first
                    f = next((g for g in forms if len(g) > 5 and f.endswith(g) and len(f) - len(g) <= 24), f)
                made.add(f)
                if f and f not in forms and not _NOTE.match(p):
                    kept.append(u)
            rest = [(u, f) for u, f in zip(su[i], own) if f not in made]
            score = [[0] * len(LANGS), [0] * len(LANGS)]
            for k, of in ((0, [u for u, _ in rest] or su[i]), (1, kept)):
                for u in of:
                    if u[3] >= 0:
                        score[k][u[3]] += u[2]
            names = only_names(s) or not rest and all(only_names(s[u[0] : u[1]]) for u in su[i])
            row["same"] = names
            if fs and not names:
                contained = len(fs) >= 8 and (fs in ft or (ft in fs and len(ft) > 0.5 * len(fs)))
                # What isn't found again as a whole unit, filler aside.
                row["copy_bits"] = (fs in (ft, fb)) | contained << 1 | (not rest) << 2 | _repeated("".join(f for _, f in rest) or fs, fb) << 3
            top = lambda x: LANGS[x.index(max(x))] if any(x) else None
            row["sl"], row["rl"] = top(score[0]), top(score[1])
            row["letters"] = score[1]
            # Other evidence of the result's language: its letters and its small words.
            body = " ".join(t[u[0] : u[1]] for u in kept)
            row["scripts"], row["words"] = _scripts(body), _small_words(body)
            row["ls"] = sum(u[1] - u[0] for u, _ in rest)
            row["lr"] = sum(u[1] - u[0] for u in kept)
            row["n"], row["m"] = len(rest), len(kept)
            last = s[su[i][-1][0] : su[i][-1][1]] if su[i] else ""
            lines = [x for x in s.replace("\r\n", "\n").split("\n") if x.strip()]
            bare = sum(not _STOP_END.search(x) and not filler(x) for x in lines[1:-1])
            quoted = bool(re.search(r"[”“»«」』\"]\s*\Z", last))
            stops = bool(_STOP_END.search(last)) and not (quoted and bare)
            row["no_stop"] = stops and not _STOP_END.search(t)
            row["broken"] = bool(re.search(r"[^\W\d_]\s*\Z", t)) and stops
        for k, v in row.items():
            out[k].append(v)
        if prepare:
            for k, v in prepare(s, t, [u[:2] for u in su.get(i, [])], [u[:2] for u in ru.get(i, [])]).items():
                more.setdefault(k, []).append(v)
    return out | more


# --- the label model ---------------------------------------------------------
#: Per defect: prior share, and per function (rate with, rate without).
#: empty_answer: no letter or figure; six characters at most; no two different ones.
PRIORS: dict[str, tuple[float, list[tuple[float, float]]]] = {
    "empty_answer": (0.03, [(0.99, 0.0001), (0.95, 0.005), (0.9, 0.002)]),
    "refusal": (0.03, [(0.97, 0.01), (0.95, 0.004), (0.7, 0.01), (0.5, 0.003), (0.6, 0.002)]),
    "copies_source": (0.03, [(0.85, 0.002), (0.9, 0.004), (0.9, 0.004), (0.95, 0.004), (0.97, 0.01)]),
    "wrong_language": (0.03, [(0.97, 0.003), (0.6, 0.004), (0.6, 0.006), (0.03, 0.5)]),
    "truncated": (0.03, [(0.85, 0.004), (0.85, 0.004), (0.35, 0.002), (0.3, 0.02)]),
}


def label_model(defect: str, patterns: dict[int, int], rounds: int = 25, anchor: float = 30.0) -> dict[int, float]:
    """Posterior of the defect for every pattern of votes (bits), by EM over the
    patterns' counts; ``anchor`` pseudo-counts hold the rates near the priors."""
    share, rates = PRIORS[defect]
    k = len(rates)
    pats = sorted(patterns)
    v = np.asarray([[p >> j & 1 for j in range(k)] for p in pats], dtype=float).reshape(len(pats), k)
    n = np.asarray([patterns[p] for p in pats], dtype=float)
    a0, b0 = np.asarray([r[0] for r in rates]), np.asarray([r[1] for r in rates])
    a, b, pi = a0.copy(), b0.copy(), share
    post = np.zeros(len(pats))
    for _ in range(rounds):
        la = np.log(pi) + v @ np.log(a) + (1 - v) @ np.log(1 - a)
        lb = np.log(1 - pi) + v @ np.log(b) + (1 - v) @ np.log(1 - b)
        post = 1 / (1 + np.exp(np.clip(lb - la, -60, 60)))
        w1, w0 = n * post, n * (1 - post)
        pi = (w1.sum() + anchor * share) / (n.sum() + anchor)
        a = np.clip((w1 @ v + anchor * a0) / (w1.sum() + anchor), 0.02, 0.995)
        b = np.clip((w0 @ v + 10 * anchor * b0) / (w0.sum() + 10 * anchor), 1e-5, 0.95)
    return dict(zip(pats, post.tolist()))


def _bits(*conditions: Column) -> Column:
    total = F.lit(0)
    for j, c in enumerate(conditions):
        total = total + F.when(c, F.lit(1 << j)).otherwise(F.lit(0))
    return total


def targets_of(jobs: DataFrame) -> DataFrame:
    """(job_id, target_lang) of translate jobs, one row each."""
    return (
        jobs.where("kind = 'translate'")
        .select(F.col("id").alias("job_id"), F.lower(F.trim(F.get_json_object("options", "$.target_lang"))).alias("target_lang"))
        .where("job_id is not null").dropDuplicates(["job_id"])
    )


def result_model(segments: DataFrame, targets: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Language model fitted on a bounded sample of results, whole texts chosen by a
    hash of the id and labelled with the target language of their jobs (noisy: some
    are copies or in a wrong one)."""
    done = segments.where("status = 'completed' and length(result_text) > 0 and id is not null")
    n = done.select("id").count()
    span = 1 << 30
    mark = F.pmod(F.xxhash64("id"), F.lit(span))
    part = done.where((mark < int(span * min(1.0, rows / max(n, 1)))) & (F.length("result_text") < chars)).select("id", "job_id", "result_text", mark.alias("mark"))
    part = part.join(targets, "job_id").where(F.col("target_lang").isin(*LANGS)).dropDuplicates(["id"])
    # About ``rows`` rows are left: their running sums are small.
    w = Window.partitionBy("target_lang").orderBy("mark", "id").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("before", F.coalesce(F.sum(F.length("result_text")).over(w), F.lit(0))).where(F.col("before") < chars)
    pools: dict[str, list[str]] = {}
    for r in sorted(part.select("id", "mark", "target_lang", "result_text").collect(), key=lambda r: (r.mark, r.id)):
        pools.setdefault(r.target_lang, []).append(r.result_text)
    docs = [(c, "\n".join(ts[i : i + 6])) for c, ts in pools.items() for i in range(0, len(ts), 6)]
    return fit(docs, lead=LEAD)


def read_pairs(segments: DataFrame, model: Model, prepare: Callable | None = None, columns: str = "") -> DataFrame:
    """One slim row a segment, read by one pass over the texts and written to the
    shared folder; with the ``columns`` of ``prepare`` where given."""
    c = F.col
    done = c("status") == "completed"
    rows = segments.where(done | (c("status") == "failed")).select(
        "id", "job_id", "status", F.when(done & c("result_text").isNotNull(), c("source_text")).alias("source_text"), F.when(done, c("result_text")).alias("result_text"),
        F.when(~done, c("error_message")).alias("error_message"),
    )
    schema = _VOTES + (", " + columns if columns else "")
    path = stored(map_texts(rows, lambda b: _read(model, b, prepare), schema, ["source_text", "result_text"]))
    return segments.sparkSession.read.schema(schema).parquet(path)


def pair_votes(segments: DataFrame, jobs: DataFrame, model: Model | None = None) -> DataFrame:
    """Votes (one column of bits per defect) of every segment of a translate job.

    ``segments``: id, job_id, status, source_text, result_text, error_message;
    ``jobs``: id, kind, options (JSON with "target_lang").
    """
    targets = targets_of(jobs)
    segments = segments.select("id", "job_id", "status", "source_text", "result_text", "error_message")
    return votes_of(read_pairs(segments, model or result_model(segments, targets)), targets)


def votes_of(read: DataFrame, targets: DataFrame) -> DataFrame:
    """Votes of the rows that were read, cut from lineage."""
    slim = cut(read.select(*(c.split()[0] for c in _VOTES.split(", "))).join(targets, "job_id").dropDuplicates(["id"]))
    c = F.col
    ratio = c("lr") / c("ls")
    usual = slim.where("status = 'completed' and ls > 20 and rl = target_lang").groupBy("sl", "target_lang").agg(F.percentile_approx(ratio, 0.5, 1000).alias("usual"), F.count("*").alias("pairs"))
    usual = usual.select(c("sl").alias("usual_sl"), c("target_lang").alias("usual_tl"), "usual", "pairs")
    slim = slim.join(F.broadcast(usual), c("sl").eqNullSafe(c("usual_sl")) & (c("target_lang") == c("usual_tl")), "left")  # at most one row a pair of languages
    # A source in no known language is names and filler, which keep their length.
    dense = F.create_map(*(F.lit(x) for kv in DENSE.items() for x in kv))
    expected = F.when(c("sl").isNull(), 1.0).otherwise(F.coalesce(dense[c("target_lang")], F.lit(1.0)) / F.coalesce(dense[c("sl")], F.lit(1.0)))
    known = F.coalesce("pairs", F.lit(0))
    rel = F.when(c("ls") > 0, ratio / F.exp((known * F.log(F.coalesce("usual", F.lit(1.0))) + EXPECTED_PAIRS * F.log(expected)) / (known + EXPECTED_PAIRS)))
    at = F.array_position(F.array(*(F.lit(x) for x in LANGS)), c("target_lang")).cast("int")
    of_target = lambda x: F.when(c(x).isNotNull() & (at > 0), F.element_at(c(x), at)).otherwise(0)
    letters = F.greatest(F.array_max("scripts"), F.lit(0))
    place = F.array_position(F.array(*(F.lit(x) for x in LANGS)), c("rl")).cast("int")
    of_result = F.when(c("words").isNotNull() & (place > 0) & (c("rl") != c("target_lang")), F.element_at("words", place)).otherwise(0)
    completed = c("status") == "completed"
    return slim.select(
        "id", "status", "target_lang", "sl", "rl", c("empty_bits").alias("empty_answer"), "refusal",
        F.when(completed & ~c("same"), c("copy_bits") + F.when((c("copy_bits") > 0) & ~c("target_lang").eqNullSafe(c("sl")), F.lit(16)).otherwise(0)).otherwise(0).alias("copies_source"),
        # By units, by script, and by small words, for and against.
        F.when(completed, _bits(c("rl") != c("target_lang"), (letters >= MIN_LETTERS) & (of_target("scripts") < 0.5 * letters), (F.array_max("words") >= 2) & (2 * of_target("words") < F.array_max("words")), of_target("words") > of_result)).otherwise(0).alias("wrong_language"),
        F.when(completed, _bits(c("no_stop"), (c("n") >= 3) & (c("m") >= 1) & (rel < 0.49), c("broken") & c("no_stop") & (rel < 0.9), (c("n") >= 3) & (c("m") >= 1) & (2 * c("m") < c("n")) & (rel < 0.6))).otherwise(0).alias("truncated"),
    )


def posteriors(votes: DataFrame) -> dict[str, dict[int, float]]:
    """Per defect the posterior of each pattern of votes."""
    long = votes.select(F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("votes")) for d in DEFECTS))).alias("x")).select("x.*")
    counts: dict[str, dict[int, int]] = {d: {} for d in DEFECTS}
    for r in long.groupBy("defect", "votes").count().collect():  # at most 2^5 rows a defect
        counts[r.defect][r.votes] = r["count"]
    return {d: label_model(d, n) if n else {} for d, n in counts.items()}


def defects(votes: DataFrame, cutoffs: dict[str, float] = CUTOFFS) -> DataFrame:
    """(id, status, defect, posterior) of every defect above its cutoff."""
    got = []
    for d, post in posteriors(votes).items():
        found = {p: q for p, q in post.items() if q > cutoffs[d] and p}
        if found:
            table = F.create_map(*(F.lit(x) for kv in sorted(found.items()) for x in kv))
            got.append(F.when(F.col(d).isin(*found), F.struct(F.lit(d).alias("defect"), table[F.col(d)].alias("posterior"))))
    kind = "array<struct<defect:string,posterior:double>>"
    every = F.filter(F.array(*got).cast(kind), lambda x: x.isNotNull())
    return votes.select("id", "status", F.explode(every).alias("x")).select("id", "status", "x.defect", "x.posterior")


def first_defect(votes: DataFrame) -> DataFrame:
    """(segment_id, defect): the first defect that applies."""
    rank = F.array_position(F.array(*(F.lit(d) for d in DEFECTS)), F.col("defect"))
    return defects(votes).groupBy(F.col("id").alias("segment_id")).agg(F.min_by("defect", rank).alias("defect"))


def cutoff_report(votes: DataFrame, truth: DataFrame, cutoffs: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """(defect, cutoff, recall, precision) on rows of known defects.

    ``truth``: id, defect (NULL for sound ones), one row each; a row of another
    defect counts for none but its own."""
    own = votes.join(truth.withColumnRenamed("defect", "true_defect"), "id")
    rows = []
    for d, post in posteriors(votes).items():
        table = F.create_map(*(F.lit(x) for kv in sorted((post or {0: 0.0}).items()) for x in kv))
        q = F.coalesce(table[F.col(d)], F.lit(0.0))
        rows += [own.where(F.col("true_defect").isNull() | (F.col("true_defect") == d)).select(F.lit(d).alias("defect"), F.lit(c).alias("cutoff"), (q > c).alias("found"), F.col("true_defect").isNotNull().alias("true")) for c in cutoffs]
    long = rows[0]
    for r in rows[1:]:
        long = long.unionByName(r)
    hit = F.count_if(F.col("found") & F.col("true"))
    return long.groupBy("defect", "cutoff").agg((hit / F.nullif(F.count_if("true"), F.lit(0))).alias("recall"), (hit / F.nullif(F.count_if("found"), F.lit(0))).alias("precision"))
