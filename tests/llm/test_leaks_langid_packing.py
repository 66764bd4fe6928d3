import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import langid, leaks, packing
from lectern.llm.leaks import aligned, bands, index_of, leaked_items

WORDS = "amber basin candle drift ember fallow garnet hollow ivory jasper kettle lantern meadow nectar orchard pepper quarry ribbon saddle timber umbel velvet willow yarrow zephyr".split()


def _sentence(r, n=9):
    return (" ".join(r.choice(WORDS) for _ in range(n))).capitalize() + "."


def _held(sentence, text):
    """Brute force over words: in order, one put in or changed at most."""
    fold = lambda t: [w for w in (re.sub(r"\W", "", x).casefold() for x in t.split()) if w]
    s, d = fold(sentence), fold(text)
    n = len(s)
    for i in range(len(d)):
        w = d[i : i + n]
        if len(w) == n and sum(a != b for a, b in zip(s, w)) <= 1 and (n > 1 or s == w):
            return True
        w = d[i : i + n + 1]
        if len(w) == n + 1 and any(s == w[:k] + w[k + 1 :] for k in range(1, n)):
            return True
    return False


def test_against_brute_force(spark):
    r = random.Random(5)
    items = [(i, " ".join(_sentence(r, r.randint(4, 12)) for _ in range(r.randint(3, 7)))) for i in range(12)]
    docs = []
    for d in range(150):
        parts = [_sentence(r) for _ in range(r.randint(0, 6))]
        for s in re.findall(r"[^.]+\.", r.choice(items)[1])[: r.randint(0, 7)]:
            w = s.split()
            kind = r.random()
            if kind < 0.3:
                w[r.randrange(len(w))] = "changed"
            elif kind < 0.5:
                w.insert(r.randrange(1, len(w)), "added")
            elif kind < 0.6:
                w[0:2] = ["two", "words"]
            parts.insert(r.randint(0, len(parts)), " ".join(w).upper() if kind > 0.8 else "  ".join(w))
        docs.append((d, "\n".join(parts)))
    want = set()
    for d, t in docs:
        for i, text in items:
            ss = re.findall(r"[^.]+\.", text)
            if sum(_held(s, t) for s in ss) * 2 >= len(ss):
                want.add((d, i))
    assert want
    df = spark.createDataFrame([*docs, docs[0], (900, None), (901, "")], "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    it = spark.createDataFrame([*items, items[0], (99, None), (98, "")], "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    for chars in (10**6, 400):  # one block, several blocks
        assert {(x.doc_id, x.item_id) for x in leaked_items(df, it, chars).collect()} == want
    assert leaked_items(df.limit(0), it).count() == 0 and leaked_items(df, it.limit(0)).count() == 0


def test_long_texts_are_read_whole(monkeypatch):
    r = random.Random(8)
    item = " ".join(_sentence(r) for _ in range(6))
    ix = index_of([(1, item)])
    texts = [" ".join(_sentence(r) for _ in range(400)) + " " + item + " " + _sentence(r), "x" * 5000, None, item]
    want = sorted(leaks.leaks(ix, texts))
    assert want == [(0, 1), (3, 1)]
    whole = leaks.fold(texts)
    monkeypatch.setattr(leaks, "_STEP", 700)  # the item lies across many steps
    assert sorted(leaks.leaks(ix, texts)) == want
    assert all((a == b).all() for a, b in zip(whole, leaks.fold(texts)))
    monkeypatch.setattr(langid, "STEP", 50)
    m = langid.fit([])
    assert [len(u) for u in langid.unit_languages(m, [SAMPLE["en"] * 50, "", SAMPLE["zh"]])][1:] == [0, 2]


def test_han_and_width():
    item = "老船夫在屋顶上买了盐和绳子。昆林在港口找到了小镜子。"
    ix = index_of([(7, item)])
    said = lambda *t: sorted(leaks.leaks(ix, list(t)))
    assert said("前文。昆林在港口，找到了小 镜子！后文", "昆林在港口又找到了小镜子", "昆林在港湾找到了小镜子", "昆林在港湾里找到了小镜子", "", None) == [(0, 7), (1, 7), (2, 7)]
    assert leaks.leaks(index_of([(1, "Go.")]), ["we go home", "no"]) == [(0, 1)]


def test_bound_of_the_lemma():
    """Every held sentence of a bound keeps a band, whatever word is edited."""
    r = random.Random(3)
    for _ in range(60):
        words = [r.choice(WORDS) for _ in range(r.randint(4, 12))]
        ix = index_of([(1, " ".join(words).capitalize() + ".")])
        k = r.randrange(len(words))
        for w in (words[:k] + [r.choice(["x", "extraordinarily" * r.randint(1, 6)])] + words[k + 1 :], words[:k] + ["y" * r.randint(1, 90)] + words[k:]):
            if w[0] != words[0] and len(w) > len(words):
                continue
            text = "Zz. " + " ".join(w) + " zz."
            codes, starts, off = leaks.fold([text])
            if len(ix.weak) == 0:
                assert len(bands(ix, codes, starts, off)[0]) > 0, (words, w)
            assert leaks.leaks(ix, [text]) == [(0, 1)], (words, w)


def test_short_sentences_and_two_words():
    ix = index_of([(1, "I go. He ran home at last through the orchard gate. Oh."), (2, "No."), (3, "He left.")])
    assert sorted(leaks.leaks(ix, ["Well, I go now. Oh. He sat.", "No, he left", "we left", "he came", ""])) == [(0, 1), (0, 3), (1, 2), (1, 3), (2, 3), (3, 3)]


def test_many_items_in_blocks(spark):
    r = random.Random(12)
    items = [(i, " ".join(_sentence(r) for _ in range(4))) for i in range(20_000)]
    docs = [(d, _sentence(r) + " " + items[d * 90][1] + " " + _sentence(r)) for d in range(200)] + [(900, "nothing"), (901, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string").repartition(4)
    got = {(x.doc_id, x.item_id) for x in leaked_items(df, it, 1_500_000).collect()}
    assert got == {(d, d * 90) for d in range(200)}


SAMPLE = {
    "en": "The old ferryman counted the crates at the harbour and nobody noticed the torn map. She walked to the mill because the road was closed.",
    "de": "Der alte Fährmann zählte die Kisten am Hafen und niemand bemerkte die zerrissene Karte. Sie ging zur Mühle, denn die Straße war gesperrt.",
    "fr": "Le vieux passeur compta les caisses au port et personne ne remarqua la carte déchirée. Elle alla au moulin, car la route était fermée.",
    "zh": "老船夫在港口数了木箱，可是谁也没有发觉那张破地图。她走到磨坊，因为道路已经封了。",
    "ru": "Старый паромщик насчитал ящики в порту, и никто не заметил рваной карты. Она пошла на мельницу, потому что дорога была закрыта.",
}


@pytest.fixture(scope="module")
def model():
    rows = [(c, t) for c, t in SAMPLE.items() for _ in range(12)]
    rows += [("en", SAMPLE["de"])] * 3  # wrong labels
    return langid.fit(rows)


def test_units_languages(model):
    for c, t in SAMPLE.items():
        assert [langid.LANGS[u[3]] for u in langid.unit_languages(model, [t])[0]] == [c] * 2
    assert langid.unit_languages(model, [""]) == [[]]
    assert [u[3] for u in langid.unit_languages(model, ["Zennor.\nwww.books.example\n12 34"])[0]] == [-1, -1, -1]


def test_labels():
    assert [langid.label_code(x) for x in ("en", " EN ", "en-GB", "pt_BR", "und", "", None, "english")] == ["en", "en", "en", "pt", None, None, None, None]


def test_language_cases(spark, model):
    mixed = SAMPLE["en"] + " " + SAMPLE["zh"]
    rows = [(1, SAMPLE["en"], "en"), (2, SAMPLE["en"], "DE"), (3, SAMPLE["fr"], None), (4, mixed, "en"), (5, None, None), (6, "", None), (7, "123 !!", None), (8, "Zennor", "fr"), (2, SAMPLE["en"], "DE"), (None, SAMPLE["en"], None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("case_kind", F.lit(0))
    got = {(r.doc_id, r.case_kind, r.lang) for r in langid.language_cases(df, model).collect()}
    assert got == {(2, "label", "en"), (3, "label", "fr"), (4, "mixed", "en"), (4, "mixed", "zh")}
    seg = langid.language_segments(df.where("doc_id = 4"), model).orderBy("start_pos").collect()
    assert [s.lang for s in seg] == ["en", "zh"] and seg[0].start_pos == 0 and seg[1].end_pos == len(mixed) and all(0 < s.confidence <= 1 for s in seg)
    assert langid.language_cases(df.limit(0), model).count() == 0
    assert langid.language_cases(df.limit(0)).count() == 0


def test_held_out_accuracy(model):
    r = random.Random(1)
    texts = [(c, " ".join(r.sample(re.findall(r"[\w'’]+", t), 8))) for c, t in SAMPLE.items() if c != "zh" for _ in range(40)]
    got = langid.unit_languages(model, [t for _, t in texts])
    assert np.mean([langid.LANGS[u[0][6]] == c for (c, _), u in zip(texts, got)]) > 0.95


def test_assign():
    r = random.Random(2)
    for sizes in ([], [5], [2048] * 3, [1025] * 4, [1] * 5000, [r.randint(1, 2048) for _ in range(3000)], [700] * 999):
        sizes = sorted(sizes, reverse=True)
        where = packing.assign(sizes)
        load: dict[int, int] = {}
        for n, k in zip(sizes, where):
            load[k] = load.get(k, 0) + n
        assert all(v <= 2048 for v in load.values())
        alone: dict[int, int] = {}
        for n, k in zip(sizes, packing.assign(sizes, tight_below=0)):
            alone[k] = alone.get(k, 0) + n
        assert all(v <= 2048 for v in alone.values()) and len(load) <= len(alone) <= 1.05 * len(load) + 1
        if len(sizes) == 3000:
            assert len(load) <= 1.01 * -(-sum(sizes) // 2048)


def test_cost_alone_decides_the_sequence():
    """Each item goes to the cheapest sequence that has room, the first of equal ones."""
    r = random.Random(6)
    sizes = sorted((r.randint(1, 900) for _ in range(400)), reverse=True)
    got = packing.assign(sizes, tight_below=0)
    opened = -(-sum(sizes) // 2048)
    room, spent = [2048] * opened, [0.0] * opened
    for n, k in zip(sizes, got):
        fits = [j for j in range(len(room)) if room[j] >= n]
        if not fits:
            room.append(2048)
            spent.append(0.0)
            fits = [len(room) - 1]
        assert spent[k] <= min(spent[j] for j in fits) + 1e-9
        room[k] -= n
        spent[k] += packing.cost(n)


def test_pack(spark):
    rows = [(i, 1 + (i * 37) % 900) for i in range(1000)] + [(5000, 5000), (5001, 4096), (5002, 0), (5003, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    got = packing.pack(df, group_docs=300).toPandas()
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {i: n for i, n in rows if n}
    assert got.groupby("container").n_tokens.sum().max() <= 2048
    assert got.groupby("doc_id").size()[lambda s: s > 1].to_dict() == {5000: 3, 5001: 2}
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.packing_report(packing.pack(df)).first().used > 0.98


PARTS = {
    "es": ("El capitán|La vecina|Mi hermano|El panadero|Una niña", "vendió|encontró|escondió|pintó|rompió", "el abrigo verde|una llave vieja|la cuerda larga|un mapa roto|las cajas", "en el puerto|detrás del molino|bajo el puente|en la bodega|antes de la tormenta"),
    "pt": ("O capitão|A vizinha|Meu irmão|O padeiro|Uma menina", "vendeu|encontrou|escondeu|pintou|quebrou", "o casaco verde|uma chave velha|a corda comprida|um mapa rasgado|as caixas", "no porto|atrás do moinho|sob a ponte|na adega|antes da tempestade"),
    "zh": ("船长|邻居|我哥哥|面包师|小女孩", "卖掉了|找到了|藏起了|漆好了|打破了", "绿色的外套|一把旧钥匙|长绳|破地图|木箱", "在港口|在磨坊后面|在桥下|在地窖里|在暴风雨之前"),
    "ja": ("船長は|隣人は|兄は|パン屋は|少女は", "売った|見つけた|隠した|塗った|壊した", "緑の外套を|古い鍵を|長い縄を|破れた地図を|木箱を", "港で|水車小屋の裏で|橋の下で|地下室で|嵐の前に"),
    "en": ("The captain|The neighbour|My brother|The baker|A girl", "sold|found|hid|painted|broke", "the green coat|an old key|the long rope|a torn map|the crates", "at the harbour|behind the mill|under the bridge|in the cellar|before the storm"),
}


def _said(r, c):
    a, v, o, w = (r.choice(x.split("|")) for x in PARTS[c])
    name = r.choice("Orrin Velkar Maskell Zennor Tamsel Greloth".split())
    if c in ("zh", "ja"):
        return (a + w + o + v if c == "ja" else a + w + v + o) + "。"
    return f"{a} {name} {v} {o} {w}."


def _corpus(r, n):
    """(text, label, true language, true languages if mixed) with noisy labels."""
    out = []
    for _ in range(n):
        c = r.choice(list(PARTS))
        other = {"es": "pt", "pt": "es", "zh": "ja", "ja": "zh", "en": "es"}[c]
        lines = [_said(r, c) for _ in range(r.randint(6, 14))]
        mixed = r.random() < 0.15
        if mixed:
            lines[1 : 1 + r.randint(1, 3)] = [_said(r, other) for _ in range(2)]
        sep = "" if c in ("zh", "ja") else " "
        label = r.choice([None, other, "xx"]) if r.random() < 0.08 else c
        out.append((sep.join(lines), label, c, {c, other} if mixed else set()))
    return out


def test_fit_is_the_same_on_any_sample():
    """Recall and precision over samples: close languages, mixed texts, wrong labels."""
    for seed in range(5):
        r = random.Random(seed)
        model = langid.fit([(c, t) for t, label, _, _ in _corpus(r, 500) if (c := langid.label_code(label))])
        rows = _corpus(random.Random(100 + seed), 600)
        o = langid._cases(model, list(range(len(rows))), [x[0] for x in rows], [x[1] for x in rows])
        got = set(zip(o["doc_id"], o["case_kind"], o["lang"]))
        want = {(i, "label", c) for i, (_, label, c, _) in enumerate(rows) if langid.label_code(label) != c} | {(i, "mixed", m) for i, x in enumerate(rows) for m in x[3]}
        assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got), seed


def test_headings_mix_nothing(model):
    text = SAMPLE["en"] + "\nKapitel neun der alte Fährmann am Hafen\n" + SAMPLE["en"]
    assert langid._cases(model, [1], [text], ["en"])["lang"] == []


def test_document_confidence(spark, model):
    rows = [(1, SAMPLE["en"], None), (2, SAMPLE["en"] + " " + SAMPLE["de"].partition(".")[0] + ".", "en"), (3, "Zennor", "fr"), (4, None, "en"), (5, "12", None), (1, SAMPLE["en"], None)]
    got = {r.doc_id: (r.lang, r.confidence) for r in langid.document_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), model).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "en", 3: "fr"}
    assert got[1][1] > got[2][1] > got[3][1] == 0
    assert langid.document_languages(spark.createDataFrame([], "doc_id bigint, text string, lang string"), model).count() == 0
