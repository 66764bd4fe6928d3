import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import align, pairs
from lectern.llm.langid import fit
from lectern.llm.pairs import PRIORS, _refusal_bits, cutoff_report, defects, first_defect, label_model, only_names, pair_votes

WHO = [("Tom", "汤姆"), ("Anna", "安娜"), ("Kolvane", "科尔万"), ("Orrin", "奥林"), ("Velkar", "维尔卡")]
DID = [("sold", "卖掉了"), ("found", "找到了"), ("painted", "漆好了"), ("stole", "偷走了"), ("forgot", "忘记了")]
WHAT = [("the green coat", "绿色的外套"), ("a torn map", "一张破地图"), ("the silver key", "银钥匙"), ("a clay cup", "一只陶杯"), ("the long rope", "长绳")]
WHERE = [("at the harbour", "在港口"), ("in the attic", "在阁楼里"), ("behind the mill", "在磨坊后面"), ("on the roof", "在屋顶上")]


def _pair(r):
    a, b, c, d = (r.choice(x) for x in (WHO, DID, WHAT, WHERE))
    return f"{a[0]} {b[0]} {c[0]} {d[0]}.", f"{a[1]}{d[1]}{b[1]}{c[1]}。"


def _sound(r, n):
    p = [_pair(r) for _ in range(n)]
    return " ".join(x for x, _ in p), "".join(y for _, y in p)


@pytest.mark.parametrize(
    ("text", "refused"),
    [
        ("I'm sorry, but I can't translate this passage.", True), ("Chapter one.\n\nI am not able to assist with this text.", True), ("抱歉，我无法翻译这段内容。", True),
        ("Leider muss ich sagen: ich darf diesen Text nicht bearbeiten.", True), ("Lo siento, no puedo traducir este pasaje.", True), ("Je dois décliner cette demande de traduction.", True),
        ("“I'm sorry, I can't help you with that,” said Orrin.", False), ("“I refuse to read this letter aloud,” said Greloth.", False), ("“I refuse to re", False),
        ("sorry, the service is restarting", False), ("HTTP 401: key rejected", False), ("", False), ("我拒绝把这封信念出来", False),
    ],
)
def test_refusal_votes(text, refused):
    bits = _refusal_bits(text)
    post = label_model("refusal", {0: 1000, bits: 5})[bits]
    assert (bits != 0 and post > pairs.CUTOFFS["refusal"]) == refused


def test_names():
    assert only_names("Zennor Ilverton 8679") and only_names("1234") and only_names("velkar " * 60)
    assert not only_names("The End came.") and not only_names("他走了。")


def test_label_model_learns_rates():
    r = random.Random(4)
    counts: dict[int, int] = {}
    truth: dict[int, list[int]] = {}
    for _ in range(20_000):
        y = r.random() < 0.08
        p = sum((r.random() < (0.9 if y else 0.01)) << j for j in range(3))
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, [0, 0])[y] += 1
    post = label_model("wrong_language", counts)
    for p, (no, yes) in truth.items():
        if no + yes > 200:
            assert abs(post[p] - yes / (no + yes)) < 0.05
    assert label_model("truncated", {}) == {}
    assert set(PRIORS) == set(pairs.DEFECTS) == set(pairs.CUTOFFS)


def test_planted_defects(spark):
    """Cutoffs hold: planted defects come out, sound pairs don't."""
    r = random.Random(9)
    seg, want = [], {}
    for i in range(1, 401):
        src, res = _sound(r, 6)
        status, error = "completed", None
        kind = i % 25
        if kind == 1:
            res, want[i] = r.choice([None, "", " ​ ", "…"]), "empty_answer"
        elif kind == 2:
            res, want[i] = res[:20] + "。\n\n抱歉，我无法翻译这段内容。", "refusal"
        elif kind == 3:
            res, want[i] = r.choice([src.upper(), "Translation: " + src, src[:-1] + "…"]), "copies_source"
        elif kind == 4:
            res, want[i] = "Der alte Mann verkaufte den grünen Mantel am Hafen. Anna fand eine zerrissene Karte auf dem Dach. Niemand bemerkte es. Sie lachte noch lange. Er vergaß das Seil. Es regnete.", "wrong_language"
        elif kind == 5:
            res, want[i] = res[: len(res) // 2 - 3], "truncated"
        elif kind == 6:
            res, want[i] = "".join(res.partition("。")[:2]), "truncated"
        elif kind == 7:
            res, status, error = None, "failed", r.choice(["HTTP 503", "sorry, the service is restarting"])
        elif kind == 8:
            res, status, error = None, "failed", "model answered: I can't translate this passage."
            want[i] = "refusal"
        elif kind == 9:
            src = res = "Zennor Ilverton 86"
        elif kind == 10:
            error = "I can't translate this passage."  # left from an earlier try
        elif kind == 11:
            res = None
            status = "pending"
        elif kind == 12:  # a single sentence left out
            res = "。".join(res.split("。")[1:])
        seg.append((i, 1 + i % 3, status, src, res, error))
    seg += [seg[0], (None, 1, "completed", "a", "b", None), (900, 9, "completed", "a b.", "", None), (901, 1, "failed", None, None, None), (902, 1, "completed", None, "他走了。", None)]
    jobs = [(1, "translate", '{"target_lang":"zh"}'), (2, "translate", '{"target_lang":"zh"}'), (3, "translate", '{"target_lang": "zh"}'), (1, "translate", '{"target_lang":"zh"}'), (9, "tts", "{}"), (10, "translate", None)]
    s = spark.createDataFrame(seg, "id bigint, job_id bigint, status string, source_text string, result_text string, error_message string").withColumn("kind", F.lit("clash")).withColumn("defect", F.lit(1))
    j = spark.createDataFrame(jobs, "id bigint, kind string, options string").withColumn("status", F.lit("clash"))
    german = "Der alte Mann verkaufte den Mantel am Hafen. Anna fand die Karte auf dem Dach. Niemand bemerkte es, und er lachte noch lange, denn es regnete."
    rows = [(c, _sound(r, 6)[k]) for c, k in (("en", 0), ("zh", 1)) for _ in range(30)] + [("de", german)] * 30
    votes = pair_votes(s, j, fit(rows)).cache()
    got = {x.segment_id: x.defect for x in first_defect(votes).collect()}
    assert got == want
    every = defects(votes).groupBy("id").count().where("count > 1").count()
    assert every > 0  # copies are in a wrong language as well
    assert first_defect(pair_votes(s.limit(0), j)).count() == 0
    assert first_defect(pair_votes(s.limit(3), j.limit(0))).count() == 0


GERMAN = [("Tom", "Tom"), ("Anna", "Anna"), ("Orrin", "Orrin")], [("verkaufte", "sold"), ("fand", "found"), ("versteckte", "hid")], [("den grünen Mantel", "the green coat"), ("eine alte Karte", "an old map"), ("den silbernen Schlüssel", "the silver key")], [("am Hafen", "at the harbour"), ("auf dem Dach", "on the roof"), ("hinter der Mühle", "behind the mill")]


def _german(r, n):
    out = []
    for _ in range(n):
        a, v, o, w = (r.choice(x) for x in GERMAN)
        out.append((f"{a[0]} {v[0]} {o[0]} {w[0]}.", f"{a[1]} {v[1]} {o[1]} {w[1]}."))
    return " ".join(x for x, _ in out), " ".join(y for _, y in out)


def test_cutoffs_are_validated_for_each_defect(spark):
    """Defects planted into held-out sound pairs of four pairs of languages: at its
    cutoff each defect has the best harmonic mean of recall and precision."""
    r = random.Random(77)
    refusals = {"zh": "很抱歉，我不能翻译这段文字。", "en": "Sorry, I cannot translate this excerpt.", "de": "Leider kann ich diesen Text nicht übersetzen."}
    make = {("en", "zh"): lambda: _sound(r, 6), ("zh", "en"): lambda: _sound(r, 6)[::-1], ("de", "en"): lambda: _german(r, 6), ("en", "de"): lambda: _german(r, 6)[::-1]}
    jobs = [(k, "translate", f'{{"target_lang":"{tl}"}}') for k, (_, tl) in enumerate(make, 1)]
    seg, truth = [], []
    for i in range(1, 801):
        job = 1 + i % 4
        (_, tl), pair = list(make.items())[job - 1]
        src, res = pair()
        defect = [None, None, None, *pairs.DEFECTS][i // 4 % 8]
        if defect == "empty_answer":
            res = r.choice(["", "…", "---", None])
        elif defect == "refusal":
            res = r.choice([refusals[tl], res[: len(res) // 3] + "\n\n" + refusals[tl]])
        elif defect == "copies_source":
            res = r.choice([src, src.upper(), "Text: " + src])
        elif defect == "wrong_language":
            res = _german(r, 6)[0] if tl != "de" else _sound(r, 6)[1]
        elif defect == "truncated":
            res = res[: len(res) // 3 - 2]
        seg.append((i, job, "completed", src, res, None))
        truth.append((i, defect))
    s = spark.createDataFrame(seg, "id bigint, job_id bigint, status string, source_text string, result_text string, error_message string")
    j = spark.createDataFrame(jobs, "id bigint, kind string, options string")
    train = [("en", _sound(r, 6)[0]) for _ in range(25)] + [("zh", _sound(r, 6)[1]) for _ in range(25)] + [("de", _german(r, 6)[0]) for _ in range(25)] + [("en", _german(r, 6)[1]) for _ in range(25)]
    votes = pair_votes(s, j, fit(train, lead=pairs.LEAD))
    report = {(x.defect, x.cutoff): (x.recall, x.precision) for x in cutoff_report(votes, spark.createDataFrame(truth, "id bigint, defect string")).collect()}
    f = lambda v: 0.0 if not v[0] or not v[1] else 2 * v[0] * v[1] / (v[0] + v[1])
    for d in pairs.DEFECTS:
        own = {c: f(v) for (e, c), v in report.items() if e == d}
        assert own[pairs.CUTOFFS[d]] >= max(own.values()) - 1e-9 and own[pairs.CUTOFFS[d]] > 0.97, (d, own)


def test_filler_and_names_by_content():
    assert pairs.filler("velkar " * 60) and pairs.filler("x" * 61) and pairs.filler("~=" * 40) and not pairs.filler("one two three")
    verse = "तीन दिन बाद थके दूत ने बंदरगाह पर नीली लालटेन बेची\n" * 1 + "सुबह होते ही घड़ीसाज़ ने द्वीप पर चाबी खो दी और लौट आया"
    assert not pairs.filler(verse) and not only_names(verse)
    assert only_names("Zennor " * 9 + "Ilverton Maskell Orrin " * 10) and not pairs.filler("a, " * 100)


def test_lengths_of_rare_language_pairs(spark):
    """One pair of two languages is measured by what their scripts let expect."""
    german = [
        "Der alte Mann verkaufte den grünen Mantel am Hafen.", "Anna fand eine zerrissene Karte auf dem Dach.", "Niemand bemerkte es, und er lachte noch lange.",
        "Sie vergaß das lange Seil hinter der Mühle.", "Im Keller stand eine alte Truhe aus Eichenholz.", "Am Abend begann es in den Bergen zu regnen.",
    ]
    chinese = ["老人在港口卖掉了绿色的外套。", "安娜在屋顶上找到了一张破地图。", "谁也没有发觉，他笑了很久。", "她把长绳忘在磨坊后面。", "地窖里有一只旧木箱。", "傍晚山里开始下雨。"]
    seg = [
        (1, 1, "completed", " ".join(german), "".join(chinese), None),
        (2, 2, "completed", "".join(chinese), " ".join(german[:2]), None),
        (3, 2, "completed", "".join(chinese), " ".join(german), None),
    ]
    s = spark.createDataFrame(seg, "id bigint, job_id bigint, status string, source_text string, result_text string, error_message string")
    j = spark.createDataFrame([(1, "translate", '{"target_lang":"zh"}'), (2, "translate", '{"target_lang":"de"}')], "id bigint, kind string, options string")
    r = random.Random(3)
    model = fit([(c, _sound(r, 6)[k]) for c, k in (("en", 0), ("zh", 1)) for _ in range(30)] + [("de", " ".join(german)), ("zh", "".join(chinese))] * 30)
    short = {x.id: x.truncated >> 1 & 1 for x in pair_votes(s, j, model).collect()}
    assert short == {1: 0, 2: 1, 3: 0}


def test_alignment(spark):
    r = random.Random(11)
    rows, want = [], {}
    for i in range(1, 301):
        p = [_pair(r) for _ in range(5)]
        src, tgt = [x for x, _ in p], [y for _, y in p]
        link = {(k, k) for k in range(5)}
        if i % 4 == 1:  # left out
            del tgt[2]
            link = {(k, k - (k > 2)) for k in range(5) if k != 2}
        elif i % 4 == 2:  # merged
            tgt[1:3] = [tgt[1][:-1] + "，而" + tgt[2]]
            link = {(0, 0), (1, 1), (2, 1), (3, 2), (4, 3)}
        elif i % 4 == 3:  # moved
            tgt = [*tgt[1:], tgt[0]]
            link = {(k, (k - 1) % 5) for k in range(5)}
        if i % 10 == 0:
            tgt.append("[译注：地名为虚构。]")
        a = [sum(len(x) + 1 for x in src[:k]) for k in range(5)]
        b = [sum(map(len, tgt[:k])) for k in range(len(tgt))]
        # Equal sentences of one text can't be told apart.
        if len(set(src)) == 5:
            want[i] = {(a[x], b[y]) for x, y in link}
        rows.append((i, " ".join(src), "".join(tgt)))
    rows += [rows[0], (900, None, "a"), (901, "", "b"), (None, "a", "b"), (902, "Zennor 12", "Zennor 12")]
    seg = spark.createDataFrame(rows, "id bigint, source_text string, result_text string").withColumn("sl", F.lit("clash"))
    sound = spark.createDataFrame([(i, "en", "zh") for i in (*range(1, 301), 900, 901, 902)], "id bigint, sl string, target_lang string")
    got: dict[int, set] = {}
    for x in align.aligned_units(seg.drop("sl"), sound).collect():
        assert (x.src_start, x.tgt_start) not in got.setdefault(x.segment_id, set())
        got[x.segment_id].add((x.src_start, x.tgt_start))
    hit = sum(len(got.get(i, set()) & w) for i, w in want.items())
    assert hit / sum(map(len, want.values())) > 0.97
    assert hit / sum(len(got.get(i, set())) for i in want) > 0.97
    assert got[902] == {(0, 0)} and 900 not in got and 901 not in got
    assert align.aligned_units(seg.drop("sl").limit(0), sound).count() == 0


def test_length_alignment():
    assert [(i, j) for i, j, _ in align.by_length([10, 50, 12], [11, 48, 12])] == [(0, 0), (1, 1), (2, 2)]
    assert [(i, j) for i, j, _ in align.by_length([60, 30, 30, 61], [60, 61, 60])] == [(0, 0), (3, 2)]
    assert align.by_length([], [3]) == []


def test_alignment_does_not_depend_on_table_size(spark):
    """A table given forty times over trains the same lexicon and gives the same pairs."""
    r = random.Random(21)
    rows = []
    for i in range(40):
        p = [_pair(r) for _ in range(3)]
        tgt = [y for _, y in p]
        if i % 4 == 0:  # rendered in part, the rest in signs that stand nowhere else
            tgt[1] = tgt[1][: len(tgt[1]) // 2] + "".join(chr(0x5200 + r.randrange(3000)) for _ in range(6)) + "。"
        rows.append((i, " ".join(x for x, _ in p), "".join(tgt)))
    found = []
    for times in (1, 40):
        data = [(i + 1000 * k, s, t) for k in range(times) for i, s, t in rows]
        seg = spark.createDataFrame(data, "id bigint, source_text string, result_text string")
        got = align.aligned_units(seg, seg.select("id", F.lit("en").alias("sl"), F.lit("zh").alias("target_lang"))).where("segment_id < 1000").collect()
        found.append({(x.segment_id, x.src_start, x.tgt_start) for x in got})
    assert len(found[0]) > 100
    assert found[0] == found[1]


def test_part_of_the_fourth_best_unit():
    """Units without counterpart don't use up the search for a part's whole."""
    near = [(0.9 - k / 10, k) for k in range(5)]
    explains = [{6: 1.0}] + [{} for _ in range(6)] + [{7: 1.0}]  # own words: 6 and 7 of unit 3
    places = [[2 * k, 2 * k + 1] for k in range(5)]
    assert align._whole(near, {3: [0]}, explains, 7, places, 0.5, 0.12) == 3
    assert align._whole(near, {3: [0]}, explains, 7, places, 0.7, 0.12) is None


def test_bands_grow_until_the_path_is_clear():
    """Merges and moves far from the diagonal, beyond any fixed band."""
    a = [40] * 80 + [90, 31, 77, 52] * 30
    b = [80] * 40 + a[80:]
    got = [(i, j) for i, j, _ in align.by_length(a, b)]
    assert {(80 + k, 40 + k) for k in range(120)} <= set(got)
    assert align.by_length([20, 20, 40], [40, 20, 20]) == [] or all(i != j or c < 3 for i, j, c in align.by_length([20, 20, 40], [40, 20, 20]))
    lex = align.Lexicon(np.zeros(0, np.int64), np.zeros(0))
    src = [f"Word{k} stone{k} river{k} lamp{k}." for k in range(200)]
    tgt = [" ".join((src[2 * k][:-1] + " and " + src[2 * k + 1]).split()) for k in range(80)] + src[160:]
    s, t = " ".join(src), " ".join(tgt)
    row = align.prepared(s, t, align.units_of([s])[0], align.units_of([t])[0])
    got = set(align.realign(lex, row))
    assert {(160 + k, 80 + k) for k in range(40)} <= got and {(2 * k + d, k) for k in range(80) for d in (0, 1)} <= got


def test_long_texts_need_no_matrix():
    lex = align.Lexicon(np.zeros(0, np.int64), np.zeros(0))
    s = " ".join(f"Word{k} stone{k} river{k} lamp{k}." for k in range(5000))
    row = align.prepared(s, s, *([align.units_of([s])[0]] * 2))
    assert align.realign(lex, row) == [(k, k) for k in range(5000)]


def _row(src, tgt):
    s, t = " ".join(src), " ".join(tgt)
    return align.prepared(s, t, align.units_of([s])[0], align.units_of([t])[0])


def _letters(k):
    return "".join("abcdefghij"[int(c)] for c in f"{k:03d}")


def test_moved_unit_of_words_that_stand_everywhere():
    """First to last among 300 units: each of its words stands in 75 others."""
    common = ["red", "green", "blue", "grey"]
    rest = [f"{common[k % 4].title()} item{_letters(k)} thing{_letters(k)} stone{_letters(k)}." for k in range(299)]
    first = "Red green blue grey."
    got = align.realign(align.NO_WORDS, _row([first, *rest], [*rest, first]))
    assert got == sorted([(0, 299), *((k + 1, k) for k in range(299))])


def test_part_of_a_far_unit_of_words_that_stand_everywhere():
    """Its other half stands where its counterpart does."""
    common = ["Red", "green", "blue", "grey"]
    rest = [f"{common[k % 4].title()} item{_letters(k)} thing{_letters(k)} stone{_letters(k)}." for k in range(299)]
    src = ["Lamp river cloud red green blue grey.", *rest]
    got = align.realign(align.NO_WORDS, _row(src, ["Lamp river cloud.", *rest, "Red green blue grey."]))
    assert {(0, 0), (0, 300)} <= set(got) and len(got) == 301


@pytest.mark.parametrize("seed", range(12))
def test_long_texts_are_aligned_as_short_ones(monkeypatch, seed):
    """All pairs held at once or by unit: the same means, bit by bit, and the same pairs."""
    r = random.Random(seed)
    words = [f"word{_letters(k)}" for k in range(30 + 20 * (seed % 4))]
    lex = align.Lexicon(np.asarray([align.word_id(r.choice(words)) << align.BITS | align.word_id(r.choice(words)) for _ in range(60)]), np.asarray([r.random() for _ in range(60)]))
    src = [" ".join(r.choice(words) for _ in range(r.randint(1, 9))).capitalize() + "." for _ in range(90 + seed)]
    tgt = [" ".join(sorted(x[:-1].lower().split(), key=lambda _: r.random())).capitalize() + "." if r.random() < 0.8 else r.choice(src) for x in src]
    for _ in range(seed):
        k = r.randrange(len(tgt) - 9)
        tgt[k : k + 2] = [tgt[k][:-1] + " " + tgt[k + 1].lower()]
        src.insert(r.randrange(len(src)), r.choice(tgt))
        block = [tgt.pop(r.randrange(len(tgt))) for _ in range(r.randint(1, 9))]
        tgt += block
    row = _row(src, tgt)
    monkeypatch.setattr(align, "WHOLE", 1 << 30)
    short, pairs = align._Shared(lex, row), align.realign(lex, row)
    places = list(range(short.m))
    rows = align._Rows(short, places)
    for i in range(short.n):
        assert rows.t(i).tolist() == [short.t_mean.get((i, j), 0.0) for j in places]
        assert rows.s(i).tolist() == [short.s_mean.get((i, j), 0.0) for j in places]
    near = lambda d, width: {k: v for k, v in d.items() if abs(k[1] - k[0] * short.m // short.n) <= width}
    monkeypatch.setattr(align, "WHOLE", 0)
    long = align._Shared(lex, row)
    for width in (3, 40):
        long.fill(width)
        assert long.t_mean == near(short.t_mean, width) and long.s_mean == near(short.s_mean, width)
    monkeypatch.setattr(align, "_LISTED", 2)
    monkeypatch.setattr(align, "_PARTS", 7)
    assert align.realign(lex, row) == pairs


def test_beads_by_length():
    """A first unit moved to the end shifts all beads; unit counts may differ much."""
    a = [30, 48, 33, 50, 29, 47, 34, 51, 31, 49, 35, 52]
    assert [(i, j) for i, j, _ in align.by_length(a, a[1:] + a[:1])][:10] == [(k + 1, k) for k in range(10)]
    src = "Tom sold the coat at the harbour. Anna found a torn map in the attic today. Orrin ran."
    tgt = "Tom sold the coat at the harbour. Anna found a torn map in the attic today. " + "Orrin. Velkar. Tom. "
    got = align.prepared(src, tgt, *(align.units_of([x])[0] for x in (src, tgt)))
    assert len(got["s_start"]) == 3 and len(got["t_start"]) == 5
    assert (0, 0) in set(zip(got["bead_s"], got["bead_t"]))
