import time

import numpy as np
import pytest

from lectern.llm import units
from lectern.llm.units import AFTER, BEFORE, OUTPUT, START, STATES, STEP, STOP_RULES, SYMBOLS, run, units_of


def split(t):
    return [t[a:b] for a, b in units_of([t])[0]]


@pytest.mark.parametrize(
    "want",
    [
        ["Dr. Cadwil sold it.", "L. A. Maskell left."], ["At 7.30 a.m. Ashmer sold the coat.", "Who came?"], ["He bought salt, rope, etc. at the inn.", "Then he left."],
        ["“Who sent you? Answer me,” said Lindrake.", "He left."], ["Orrin said: “Stop! The tide is rising.”", "Behind the mill, a man ran."],
        ["Am 3. August ging er ca. 4,5 Meilen.", "Er kam z. B. nie."], ["« Est-ce loin ? Je ne peux pas », dit Ashmer.", "Qui vint au port ?", "Elle partit."],
        ["El Sr. Orrin vivía en calle, núm. 8, y remendó p. ej. una carta.", "«Dame un día», dijo él."], ["Он купил соль и т. д. в подвале.", "Г-н Орлов ушёл."],
        ["Saltren waited… then forgot it.", "It rained."], ["He lived at No. 20, Saltgate.", "page_24.v2.txt went to shelf-24.example."],
        ["Ярнов сказал: «Стой! Прилив начинается».", "Он ушёл."], ["¿Quién vino? ".strip(), "¡Alto!"], ["The end.”".strip("”") , "“Yes!” she cried."],
    ],
)
def test_blank_scripts(want):
    assert split(" ".join(want)) == want


@pytest.mark.parametrize(
    "want",
    [
        ["1月20日，他笑了很久。", "机灵的小偷走了。"], ["“门是开着的。我什么也没看见。”维尔卡说。", "他走了。"], ["韦克库说：“停下！潮水涨上来了。”", "阿什默数了8个木箱。"],
        ["G.L.乌玛里卖掉了信。", "他等了很久……才走。"], ["「遠いのか？もう歩けない」と彼は言った。", "彼は去った。"], ["彼は「待て！潮が満ちてくる」と言った。", "誰？"],
        ["“花了4.5个银币。”多瓦斯说。", "“今晚谁也不许进去。”内斯里说。"], ["द्वीप पर चाबी खो दी।", "किसने लिया?"],
    ],
)
def test_scripts_without_blanks(want):
    assert split("".join(want)) == want


def test_lines_and_edges():
    assert split("Chapter 1 The end\n\n  a line  \r\nlast") == ["Chapter 1 The end", "a line", "last"]
    assert split("He left.The man came.") == ["He left.", "The man came."]
    assert split("It ended…\nNext.") == ["It ended…", "Next."]
    assert units_of(["", None, " \n　", "x"]) == [[], [], [], [(0, 1)]]
    assert split("“No end of it. He ran.") == ["“No end of it.", "He ran."]
    assert split("“远吗？我走不动了。”伊弗顿说\n他走了") == ["“远吗？我走不动了。”伊弗顿说", "他走了"]


def test_abbreviations_are_seen_through_odd_characters():
    assert split("С\u0430pt. Orrin left. He ran.") == ["С\u0430pt. Orrin left.", "He ran."]
    assert split("A las 8.30 a.\u00a0m. Orrin corrió. Luego nada.") == ["A las 8.30 a.\u00a0m. Orrin corrió.", "Luego nada."]


def test_scan_is_the_sequential_run():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 5000):
        sym = rng.integers(0, SYMBOLS, n)
        state, want = START, []
        for s in sym:
            want.append(OUTPUT[s, state])
            state = STEP[s, state]
        for chunk in (1, 7, 64):
            assert run(sym, chunk).tolist() == want


def test_every_rule_decides_something():
    left = {(b, a) for b in BEFORE for a in AFTER}
    for before, after, _ in STOP_RULES:
        own = {(b, a) for b, a in left if (before is None or b in before.split()) and (after is None or a in after.split())}
        assert own, (before, after)
        left -= own
    assert not left
    assert {units.NONE, units.ENDS, units.EXTENDS} == set(OUTPUT.ravel().tolist()) and set(STEP.ravel().tolist()) == set(range(STATES))
    assert (STEP[0] == START).all()  # a line's end leads every state to the start


LONG = "Dr. No asked: “Who came? Nobody.” At 7.30 a.m. Orrin ran (he said.) “Go! Now,” said Bob. He left. “门是开着的。”维尔卡说。他走了。No end “of it. Yes"


def test_one_long_text_is_many_chunks():
    """Ten megabytes in one line: the machine's chunks, whatever their size, give
    what short texts give."""
    own = units_of([LONG])[0]
    times = 10_000_000 // len(LONG.encode()) + 1
    text = "\n".join([LONG] * times)
    t = time.perf_counter()
    got = units_of([text])[0]
    assert time.perf_counter() - t < 20
    assert len(got) == times * len(own)
    assert got[-len(own) :] == [(a + (times - 1) * (len(LONG) + 1), b + (times - 1) * (len(LONG) + 1)) for a, b in own]
    line = (LONG.partition("No end")[0] + " ") * 4000
    assert len(units_of([line])[0]) == 4000 * (len(own) - 2)


def test_chunk_size_changes_nothing(monkeypatch):
    want = units_of([LONG * 20, LONG])
    for chunk in (1, 5, 1000):
        monkeypatch.setattr(units.run, "__defaults__", (chunk,))
        assert units_of([LONG * 20, LONG]) == want


def test_batches_and_long_texts():
    a = "One is. Two is! “Three? Four,” said Bob. " * 3000
    b = "一。二！"
    alone = [units_of([t])[0] for t in (a, b, a)]
    assert units_of([a, b, a]) == alone and len(alone[0]) == 9000
    for s, e in alone[0]:
        assert a[s:e] == a[s:e].strip() != ""
    assert units_of(["x" * 100_000]) == [[(0, 100_000)]]
    assert units_of([]) == []
