"""Problem 5: sentence units by a finite transducer.

A text is lexed without memory, in arrays: each line end, stop mark, quotation
mark and bracket behind one is an event, whose symbol tells what stands before
it (a class of the word or figure) and behind it (a class of what follows).
Everything that depends on more than that is the transducer's: whether a stop
ends (after an abbreviation, initial, figure, date, address), the quotation that
is open, of which kind, and whether it began the unit or follows other text.
The rules below (``STOP_RULES``, ``_step``) are compiled into one table of
(symbol, state) -> (next state, output).

All symbols of a batch form one stream, in which a line end leads every state to
the same one.  The stream is cut into chunks; each chunk is run for all states at
once, which makes it a state-transition function; the functions are composed by a
parallel prefix scan; a last pass with the known start states gives the outputs.
A document of any length is thus many chunks and no loop over its text.

Offsets count code points of the text as stored.  Defined results: a NULL,
empty or blank text has no units; a line without stop mark is a unit; repeated
texts give equal units.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from lectern.llm.look import CLASS_OF as LATIN_OF

# --- what is known of words -----------------------------------------------------
#: Abbreviations that stand before a name or word and never end.
BEFORE_NAME = set(
    "dr drs dra mr mrs ms mx prof profa capt cap cpt lt col gen sgt rev hon st ste sr sra srta sres d dª "
    "m mm mme mlle mgr me hr fr hrn kpt dipl ing univ fa г-н г-жа гр проф д-р кап акад им св доц инж डॉ प्रो श्री सुश्री कप्तान "
    "e.g i.e eg ie cf vgl vs z.b z d.h bzw sog p.ej p.ex ex ej напр т.е тов ул пер пл просп г".split()
)
#: Abbreviations that stand before a figure.
BEFORE_FIGURE = set(
    "no nos nr núm num n nº art fig figs vol vols p pp pág págs pag s str bd abb kap chap ch ed ca aprox approx env "
    "circa c ок кн стр гл рис т д кв h min tel ext".split()
)
#: Abbreviations that may stand at a sentence's end.
AT_END = set("etc usw u.a u.ä u.s.w a.m p.m a.c d.c b.c a.d inc ltd co corp jr sr.jr bros dept и.т.д т.д т.п др пр др u.dgl vv aa am pm m.a ph.d".split())
#: What a German ordinal with a full stop stands before.
AFTER_ORDINAL = set("januar jänner februar märz april mai juni juli august september oktober november dezember jahrhundert kapitel klasse tag stock etage auflage band mal".split())
#: Words of closed classes (articles, pronouns, prepositions,
#: conjunctions), which begin sentences and aren't names.
STARTERS = set(
    "the a an he she it they we i you on at in by near under behind beside before after during when while who what how where why then there this that these those but and so if as no not one nobody his her its their my our your "
    "der die das ein eine er sie es wir ich ihr am im in auf unter hinter neben beim vor nach während wer was wie wo warum dann da dies diese aber und so wenn als kein keine zu zur zum an niemand "
    "le la les un une il elle ils elles nous je vous tu on au aux à en dans sur sous près derrière avant après pendant qui que quel quelle comment où pourquoi puis ce cette ces mais et si comme aucun de du des "
    "el los las una él ella ellos nosotros yo tú usted al en sobre bajo cerca detrás antes después durante quién qué cómo dónde por luego este esta estos pero y si como ningún de del "
    "o os as um uma ele ela eles nós eu no na nos nas ao sob perto atrás depois quem onde então esta mas e se nenhum do da dos das "
    "он она они мы я вы ты на в во под за у возле перед после до когда кто что как где почему затем этот эта но и если ни через".split()
)
#: Verbs of speech, by which a tag after a quotation is known.
SAYS_HAN = "说|道|问|答|喊|叫|曰|嚷|骂|叹|念"
SAYS = (
    "said|says|asked|cried|replied|answered|whispered|shouted|called|added|muttered|sagte|fragte|rief|antwortete|flüsterte|dit|demanda|répondit|cria|"
    "dijo|preguntó|respondió|gritó|contestó|disse|perguntou|respondeu|gritou|сказал|сказала|спросил|спросила|ответил|ответила|крикнул|крикнула"
)
_TAG_HAN = re.compile(rf"[ 　]*[^。！？!?“”「」：\n\r]{{1,24}}?(?:{SAYS_HAN})(?:着|道|了)?(?:[。，！？；…]|[ 　]*(?:[\n\r]|\Z))")
_TAG = re.compile(rf"[   ]*(?:[^\W\d_a-zа-я][\w'’-]*[ ]){{1,4}}(?:{SAYS})\b")

# --- classes of characters --------------------------------------------------------
#: Kinds of events; a quotation mark's kind is ``QUOTE`` plus its place in MARKS.
LINE, DOT, HARD, BRACKET, QUOTE = 1, 2, 3, 4, 5
MARKS = "“”„«»「」『』‹›\"＂〝〞〟"
#: Opening marks and what closes them.
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›", "〝": "〞〟", '"': '"', "＂": "＂", "»": "«"}
OPENERS = tuple(PAIRS)
_CLOSING = frozenset("".join(PAIRS.values()))
#: Marks that go with the stop before them; these only where no blank parts them.
_TRAILING, _TIGHT = frozenset("»”“」』›\"＂〞〟"), frozenset("“\"＂")
#: What is taken along behind the mark that closes a quotation.
_BEHIND = "’'」』”»)）"
_ALPHA, _UPPER, _LOWER, _DIGIT, _ALNUM, _CJK, _WHITE, _BLANK, _DEVA, _WORD = (1 << i for i in range(10))
_STOPPED, _ABSORB, _GO, _NO_END = (1 << i for i in range(10, 14))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, flags, small letter, small letter of the Latin look-alike) by code."""
    n = 0x110000
    kind, flags = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint16)
    lower = np.arange(n, dtype=np.uint32)
    for c in (*range(0xD800), *range(0xE000, 0x20000)):
        ch = chr(c)
        if ch.isalnum():
            f = _ALNUM | (_ALPHA if ch.isalpha() else 0) | (_DIGIT if ch.isdigit() else 0) | (0 if ch.isdecimal() else _WORD)
            if ch.isupper():
                f |= _UPPER
            elif ch.islower():
                f |= _LOWER
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
        else:
            f = _WHITE if ch.isspace() else 0
        flags[c] = f
    flags[0x20000:0x32000] = _ALNUM | _ALPHA | _WORD
    for a, b in ((0x3040, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7B0)):
        flags[a:b] |= _CJK
    flags[0x900:0x964] |= _DEVA
    for chars, f in ((" \t  　 ", _BLANK), (".!?。！？।॥．｡…", _STOPPED), (_BEHIND, _ABSORB), (",，、;；:—–-と", _GO), (",;:-–—_/@,，；：、º°ª", _NO_END)):
        flags[[ord(c) for c in chars]] |= f
    flags[[*range(0x61, 0x7B), *range(0xE0, 0xF7), *range(0xF8, 0x100), *range(0x430, 0x450), 0x451]] |= _GO  # small letters
    for chars, k in (("\n\r  \x85\x0b\x0c", LINE), (".．", DOT), ("!?。！？।॥｡", HARD), ("’'）)]］】", BRACKET)):
        kind[[ord(c) for c in chars]] = k
    for i, c in enumerate(MARKS):
        kind[ord(c)] = QUOTE + i
    latin = lower.copy()
    for ch, to in LATIN_OF.items():
        latin[ord(ch)] = ord(to.lower())
    return kind, flags, lower, latin


# --- symbols ------------------------------------------------------------------------
#: What stands before a full stop: nothing; a list mark, short or long figure;
#: another sign, ASCII or not; or a word: abbreviation before a name or a figure
#: or at an end (also compound, before names), single letter, short or long word.
BEFORE = (
    "blank", "mark", "figure", "number", "sign", "wide_sign", "name", "figure_word", "end", "compound", "compound_end", "clock",
    "initial", "letter", "unit", "han", "short", "long",
)
#: What follows it: the line's end; at once (``+``): a figure, a mark that goes on,
#: a small, large, Chinese or other letter, a number sign, another sign; after
#: blanks: the like, also a letter that is an initial itself, and known words.
AFTER = (
    "end", "+figure", "+goes_on", "+small", "+large", "+han", "+letter", "+number", "+sign", "small", "large", "large.", "letter", "letter.",
    "figure", "comma", "dot", "degree", "sign", "sign.", "ordinal", "starter",
)
_B, _A = {k: i for i, k in enumerate(BEFORE)}, {k: i for i, k in enumerate(AFTER)}
ALL = None
_LARGE = "large large. starter ordinal"
_LETTERS = f"small letter letter. {_LARGE}"
#: Does a full stop end a sentence?  The first rule that fits decides.
STOP_RULES = (
    (ALL, "end", 1),
    ("blank", "+figure +small +large +han +letter +number", 0), ("blank", ALL, 1),
    (ALL, "+goes_on", 0), ("wide_sign", "+figure", 1), (ALL, "+figure", 0), (ALL, "+number +sign", 1), (ALL, "+small +letter", 0),
    ("mark figure number short long", "+large", 1), (ALL, "+large", 0),
    ("short long end", "+han", 1), (ALL, "+han", 0),
    ("compound", ALL, 0), ("clock", "starter", 1), ("clock", ALL, 0), ("compound_end", _LARGE, 1), ("compound_end", ALL, 0),
    ("initial", f"{_LETTERS} dot", 0), ("initial", ALL, 1),
    ("letter unit", "small figure large. letter. sign.", 0), ("letter unit", ALL, 1),
    ("name", ALL, 0), ("figure_word", "figure degree small", 0),
    ("end", "small figure comma", 0), ("end", ALL, 1),
    ("long", ALL, 1), ("short han", "small", 0), ("short han figure_word", ALL, 1),
    ("mark", ALL, 0), ("figure number", "small comma", 0), ("figure", "ordinal", 0), ("figure number sign wide_sign", ALL, 1),
)

#: States: at a unit's start; in a unit; just behind a stop that ended one; just
#: behind a quotation that did; and per kind of mark, in a quotation that began
#: the unit and in one that has text before it.
START, INSIDE, STOPPED, CLOSED, QUOTED = range(5)
TAGGED = QUOTED + len(OPENERS)
STATES = TAGGED + len(OPENERS)
#: Outputs: nothing, a unit ends here, the unit that has just ended goes on to here.
NONE, ENDS, EXTENDS = range(3)
#: How a quotation closes: the sentence goes on; its tag may follow; it ends.
GOES_ON, TAG, FULL = range(3)
_DOTS = 1
_HARDS = _DOTS + len(BEFORE) * len(AFTER) * 2
_BRACKETS = _HARDS + 2
_QUOTES = _BRACKETS + 6
SYMBOLS = _QUOTES + len(MARKS) * 72


def _dot_table() -> np.ndarray:
    ends = np.full((len(BEFORE), len(AFTER)), -1, dtype=np.int8)
    for before, after, value in STOP_RULES:
        rows = range(len(BEFORE)) if before is None else [_B[k] for k in before.split()]
        cols = range(len(AFTER)) if after is None else [_A[k] for k in after.split()]
        for i in rows:
            for j in cols:
                if ends[i, j] < 0:
                    ends[i, j] = value
    return ends


DOT_ENDS = _dot_table()


def _step(state: int, kind: str, gap: int, adjacent: int, mark: str = "", opens: int = 0, closes: int = 0, how: int = FULL, ends: int = 0) -> tuple[int, int]:
    """(next state, output).  ``gap``: text since the last event; ``adjacent``: 0
    right behind it, 1 after one blank, 2 neither."""
    if kind == "line":
        return START, ENDS
    if state >= QUOTED:
        opener = OPENERS[(state - QUOTED) % len(OPENERS)]
        if kind != "quote" or mark not in PAIRS[opener]:
            return state, NONE  # stops and other marks inside a quotation
        if how == FULL or how == TAG and state >= TAGGED:
            return CLOSED, ENDS
        return INSIDE, NONE
    if state == STOPPED and not gap:
        if kind == "bracket" and adjacent == 0:
            return STOPPED, EXTENDS
        if kind == "quote" and mark in _TRAILING and not opens and (adjacent == 0 or adjacent == 1 and mark not in _TIGHT):
            return STOPPED, EXTENDS
    if state == CLOSED and adjacent == 0 and (kind == "bracket" or mark and mark in _BEHIND):
        return CLOSED, NONE
    fresh = state != INSIDE and not gap
    if kind == "stop":
        return (STOPPED, ENDS) if ends else (INSIDE, NONE)
    if kind == "quote" and opens and closes and mark in OPENERS:
        return (QUOTED if fresh else TAGGED) + OPENERS.index(mark), NONE
    return INSIDE, NONE


def _compile() -> tuple[np.ndarray, np.ndarray]:
    to, out = np.zeros((SYMBOLS, STATES), dtype=np.uint8), np.zeros((SYMBOLS, STATES), dtype=np.uint8)
    for q in range(STATES):
        to[0, q], out[0, q] = _step(q, "line", 0, 2)
        for gap in (0, 1):
            for e in (0, 1):
                at = _DOTS + np.flatnonzero(DOT_ENDS.ravel() == e) * 2 + gap
                to[at, q], out[at, q] = _step(q, "stop", gap, 2, ends=e)
            to[_HARDS + gap, q], out[_HARDS + gap, q] = _step(q, "stop", gap, 2, ends=1)
            for adj in range(3):
                to[_BRACKETS + 2 * adj + gap, q], out[_BRACKETS + 2 * adj + gap, q] = _step(q, "bracket", gap, adj)
                for m, mark in enumerate(MARKS):
                    for opens in (0, 1):
                        for closes in (0, 1):
                            for how in range(3):
                                s = _QUOTES + ((((m * 2 + opens) * 2 + closes) * 3 + how) * 3 + adj) * 2 + gap
                                to[s, q], out[s, q] = _step(q, "quote", gap, adj, mark, opens, closes, how)
    return to, out


STEP, OUTPUT = _compile()
CHUNK = 64


def run(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The output of each symbol; the stream starts in ``START``."""
    n = len(symbols)
    if not n:
        return np.zeros(0, dtype=np.uint8)
    k = -(-n // chunk)
    grid = np.zeros(k * chunk, dtype=np.intp)
    grid[:n] = symbols
    grid = grid.reshape(k, chunk).T * STATES
    step, output = STEP.ravel(), OUTPUT.ravel()
    # Each chunk but the last as a function of states.
    fn = np.tile(np.arange(STATES, dtype=np.uint8), (k, 1))
    for i in range(chunk if k > 1 else 0):
        fn = step[grid[i][:, None] + fn]
    # Inclusive prefix composition: pre[i] = fn[i] after ... after fn[0].
    pre, d = fn, 1
    while d < k:
        nxt = pre.copy()
        nxt[d:] = np.take_along_axis(pre[d:], pre[:-d].astype(np.intp), axis=1)
        pre, d = nxt, d * 2
    state = np.full(k, START, dtype=np.uint8)
    state[1:] = pre[:-1, START]
    out = np.zeros((k, chunk), dtype=np.uint8)
    for i in range(chunk):
        at = grid[i] + state
        out[:, i] = output[at]
        state = step[at]
    return out.ravel()[:n]


# --- lexing -----------------------------------------------------------------------
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Longest abbreviation, beyond which a word is just a long one.
_LONGEST = 12
_POWERS = np.asarray([pow(_BASE, k, 1 << 64) for k in range(2 * _LONGEST + 4)], dtype=np.uint64)


def _key(word: str) -> int:
    return sum(ord(c) * int(_POWERS[k]) for k, c in enumerate(reversed(word), 1)) & _MASK


def _lookup(words: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((_key(w), _B[c]) for w, c in words.items())
    return np.asarray([r[0] for r in rows], dtype=np.uint64), np.asarray([r[1] for r in rows], dtype=np.int64)


_single = {w: "end" for w in AT_END} | {w: "figure_word" for w in BEFORE_FIGURE} | {w: "name" for w in BEFORE_NAME}
_WORDS = _lookup({w: c for w, c in _single.items() if "." not in w and len(w) > 1})
_FIGURE_LETTERS = np.asarray(sorted(ord(w) for w in BEFORE_FIGURE if len(w) == 1), dtype=np.uint32)
_COMPOUNDS = _lookup({w: "compound" if w in BEFORE_NAME else "clock" if w in ("a.m", "p.m") else "compound_end" for w in BEFORE_NAME | AT_END if "." in w})
_WORD_AFTER = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)?")


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    i = np.searchsorted(table[0], keys)
    i[i == len(table[0])] = 0
    return np.where(table[0][i] == keys, table[1][i], -1)


def _words_before(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, key, key by Latin look-alikes) of the words that end right before
    ``at``; a word longer than ``_LONGEST`` is no abbreviation and not read on."""
    _, flags, lower, latin = _tables()
    n = len(at)
    length = np.zeros(n, dtype=np.int64)
    key, alike = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    act = np.flatnonzero(flags[codes[at - 1]] & (_WORD | _DEVA))
    deva = (flags[codes[at - 1]] & _DEVA) > 0
    for k in range(1, _LONGEST + 1):
        p = at[act] - k
        ok = p > 0
        act, p = act[ok], p[ok]
        c = codes[p]
        f = flags[c]
        joint = ((c == 0x2D) | (c == 0x27) | (c == 0x2019)) & ((flags[codes[p - 1]] & _WORD) > 0) & (k > 1)
        ok = ((f & _WORD) > 0) | (deva[act] & ((f & _DEVA) > 0)) | joint
        act, c = act[ok], c[ok]
        if not len(act):
            break
        length[act] = k
        key[act] += lower[c].astype(np.uint64) * _POWERS[k]
        alike[act] += latin[c].astype(np.uint64) * _POWERS[k]
    return length, key, alike


def _before_dots(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    kind, flags, lower, _ = _tables()
    prev = codes[at - 1]
    f = flags[prev]
    length, key, alike = _words_before(codes, at)
    got = np.where(length > 4, _B["long"], _B["short"])
    got[length == 0] = np.where(prev[length == 0] < 128, _B["sign"], _B["wide_sign"])
    known = _found(_WORDS, key)
    known = np.where(known < 0, _found(_WORDS, alike), known)
    got = np.where((known >= 0) & (length > 1), known, got)
    one = length == 1
    got[one] = np.where(f[one] & _CJK, _B["han"], np.where(f[one] & _UPPER, _B["initial"], np.where(np.isin(lower[prev[one]], _FIGURE_LETTERS), _B["unit"], _B["letter"])))
    # Compounds such as "z. B" or "a.m": the part before, parted by a dot.
    i = np.flatnonzero((length > 0) & (length < 5) & (at > length + 3))
    if len(i):
        b = at[i] - length[i] - 1
        spaced = np.isin(codes[b], (0x20, 0xA0, 0x202F)) & (codes[b - 1] == 0x2E)
        inner = codes[b] == 0x2E
        d = np.where(spaced, b - 1, b)
        large = (f[i] & _UPPER) > 0
        ok = (inner | spaced) & ((flags[codes[d - 1]] & _ALPHA) > 0) & ~(spaced & large & (prev[i] < 128))
        i, d, large = i[ok], d[ok], large[ok]
        if len(i):
            size, head, _ = _words_before(codes, d)
            whole = key[i] + np.uint64(0x2E) * _POWERS[length[i] + 1] + head * _POWERS[length[i] + 1]
            c = _found(_COMPOUNDS, whole)
            ok = (c >= 0) & (size > 0)
            got[i[ok]] = np.where((c[ok] == _B["compound_end"]) & large[ok], _B["clock"], c[ok])
    # Figures: how long, and whether a list mark at the line's start.
    i = np.flatnonzero(((f & _DIGIT) > 0) & (length == 0))
    if len(i):
        size, act = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
        for k in range(1, 6):
            p = at[i[act]] - k
            act = act[(flags[codes[np.maximum(p, 0)]] & _DIGIT) > 0]
            size[act] = k
        first = kind[codes[np.maximum(at[i] - size - 1, 0)]] == LINE
        got[i] = np.where((size <= 2) & first, _B["mark"], np.where(size <= 4, _B["figure"], _B["number"]))
    got[(f & _WHITE) > 0] = _B["blank"]
    return got


def _after_dots(joined: str, codes: np.ndarray, end: np.ndarray, follow: np.ndarray, line: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Class of what follows; ``follow``: place of the next character that isn't
    blank, ``line``: of the next line end."""
    _, flags, _, _ = _tables()
    c = codes[end]
    f = flags[c]
    choose = lambda f, names: np.select([(f & b) > 0 for b, _ in names], [_A[k] for _, k in names], -1)
    got = choose(f, [(_DIGIT, "+figure"), (_NO_END, "+goes_on"), (_LOWER, "+small"), (_CJK, "+han"), (_UPPER, "+large"), (_ALPHA, "+letter"), (_ALNUM, "+number")])
    got[got < 0] = _A["+sign"]
    i = np.flatnonzero(f & _BLANK)
    g, c2 = flags[codes[follow[i]]], codes[follow[i]]
    then = codes[np.minimum(follow[i] + 1, len(codes) - 1)] == 0x2E
    own = choose(g, [(_DIGIT, "figure"), (_LOWER, "small"), (_UPPER, "large"), (_ALPHA, "letter")])
    own[own < 0] = _A["sign"]
    own = np.where(np.isin(c2, (0x2C, 0x3B, 0x3A)), _A["comma"], np.where(np.isin(c2, (0x2E, 0x2D)), _A["dot"], np.where(c2 == 0xB0, _A["degree"], own)))
    own = np.where(then & np.isin(own, (_A["large"], _A["letter"], _A["sign"])), own + 1, own)
    got[i] = own
    got[(line <= follow) & (((f & _BLANK) > 0) | (line == end))] = _A["end"]
    for cls, words, name in (("figure", AFTER_ORDINAL, "ordinal"), ("clock", STARTERS, "starter")):
        for j in np.flatnonzero((before == _B[cls]) & np.isin(got, (_A["large"], _A["large."]))).tolist():
            m = _WORD_AFTER.match(joined, follow[j])
            if m and m[0].lower() in words:
                got[j] = _A[name]
    return got


def lex(joined: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends of the events, nonblank counts, nonblank places) of texts
    each of which stands between line ends."""
    kind, flags, _, _ = _tables()
    all_kinds = kind[codes]
    at = np.flatnonzero(all_kinds)
    k = all_kinds[at]
    solid = (flags[codes] & _WHITE) == 0
    places = np.append(np.flatnonzero(solid), len(codes) - 1)
    count = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(solid, out=count[1:])
    # Runs of stop marks: one full stop, an ellipsis (no event), or a hard stop.
    end = at + 1
    keep = np.ones(len(at), dtype=bool)
    stop = (k == DOT) | (k == HARD)
    begins = stop & ~(np.concatenate(([False], stop[:-1])) & (np.diff(at, prepend=-2) == 1))
    first = np.flatnonzero(begins)
    if len(first):
        idx = np.flatnonzero(stop)
        where = np.searchsorted(idx, first)
        size = np.diff(np.append(where, len(idx)))
        hard = np.minimum.reduceat(np.where(k[idx] == HARD, np.arange(len(idx)), len(idx)), where)
        lead = np.minimum(hard - where, size)
        keep[idx] = False
        single = (size == 1) & (lead == 1)
        strong = lead < size
        event = np.where(strong & (lead > 1), first + lead, first)
        keep[event[single | strong]] = True
        k[event[strong]] = HARD
        end[event] = at[first] + size
    before_kind = kind[codes[np.maximum(at - 1, 0)]]
    keep &= (k != BRACKET) | (before_kind > LINE)
    at, k, end = at[keep], k[keep], end[keep]
    last = np.concatenate(([0], end[:-1]))
    gap = count[at] > count[last]
    near = at - last
    adjacent = np.where(near == 0, 0, np.where((near == 1) & np.isin(codes[last], (0x20, 0xA0, 0x202F)), 1, 2))
    symbols = np.zeros(len(at), dtype=np.intp)
    i = np.flatnonzero(k == HARD)
    symbols[i] = _HARDS + gap[i]
    i = np.flatnonzero(k == BRACKET)
    symbols[i] = _BRACKETS + 2 * adjacent[i] + gap[i]
    lines = at[k == LINE]
    next_line = lambda p: lines[np.minimum(np.searchsorted(lines, p), len(lines) - 1)]
    i = np.flatnonzero(k == DOT)
    if len(i):
        before = _before_dots(codes, at[i])
        after = _after_dots(joined, codes, end[i], places[count[end[i]]], next_line(end[i]), before)
        symbols[i] = _DOTS + (before * len(AFTER) + after) * 2 + gap[i]
    i = np.flatnonzero(k >= QUOTE)
    if len(i):
        symbols[i], end[i] = _quote_symbols(joined, codes, at[i], k[i] - QUOTE, adjacent[i], gap[i], count, places, next_line)
    return symbols, end, count, places


def _quote_symbols(joined, codes, at, mark, adjacent, gap, count, places, next_line):  # noqa: ANN001, ANN202
    """Symbols of quotation marks, and how far what closes there reaches."""
    _, flags, _, _ = _tables()
    before, behind = codes[at - 1], codes[np.minimum(at + 1, len(codes) - 1)]
    opens = np.isin(mark, [MARKS.index(c) for c in "“„«「『‹〝"])
    straight = np.isin(mark, [MARKS.index(c) for c in '"＂'])
    opens |= straight & ((flags[before] & _ALNUM) == 0) & ~np.isin(before, [ord(c) for c in ".!?,;:"])
    opens |= (mark == MARKS.index("»")) & ((flags[before] & _WHITE) > 0) & ((flags[behind] & _ALPHA) > 0)
    line = next_line(at)
    closes = np.zeros(len(at), dtype=bool)
    for c, by in PAIRS.items():
        i = np.flatnonzero((mark == MARKS.index(c)) & opens)
        for b in by if len(i) else "":
            own = at[mark == MARKS.index(b)]
            j = np.searchsorted(own, at[i] + 1)
            ok = j < len(own)
            closes[i[ok]] |= own[j[ok]] < line[i[ok]]
    # How a quotation would close here.
    end = at + 1
    act = np.flatnonzero(np.isin(mark, [MARKS.index(c) for c in _CLOSING]))
    shut = act
    while len(act):
        act = act[(flags[codes[np.minimum(end[act], len(codes) - 1)]] & _ABSORB) > 0]
        end[act] += 1
    how = np.full(len(at), GOES_ON)
    inner, act, p = np.zeros(len(at), dtype=bool), shut, at - 1
    while len(act):
        inner[act] = (flags[codes[p[act]]] & _STOPPED) > 0
        act = act[np.isin(codes[p[act]], (0x20, 0xA0, 0x202F))]
        p[act] -= 1
    follow = places[count[end]]
    goes_on = ((flags[codes[follow]] & _GO) > 0) & (follow < next_line(end))
    for i in shut[inner[shut] & ~goes_on[shut]].tolist():
        e = int(end[i])
        how[i] = TAG if _TAG_HAN.match(joined, e) or _TAG.match(joined, e) else FULL
    return _QUOTES + ((((mark.astype(np.intp) * 2 + opens) * 2 + closes) * 3 + how) * 3 + adjacent) * 2 + gap, end


#: Characters that hide an abbreviation or a boundary from the rules.
_ODD = re.compile(r"[\u00ad\u034f\u0300-\u036f\u2000-\u200f\u202a-\u202e\u205f-\u206f\ufe00-\ufe0f\ufeff\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff0e]")
_NOT_SEEN = re.compile(r"[\u00ad\u034f\u0300-\u036f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_PLAINER = {c: 0x20 for c in (*range(0x2000, 0x200B), 0x205F)} | {c: c - 0xFEE0 for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0xFF0E)}


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text without what isn't seen, wide letters narrow, and the offset of
    each of its characters (and of its end) in the text as stored; no offsets
    where nothing had to be changed."""
    if text.isascii() or not _ODD.search(text):
        return text, None
    at = [i for i, c in enumerate(text) if not _NOT_SEEN.match(c)]
    return _NOT_SEEN.sub("", text).translate(_PLAINER), [*at, len(text)]


def unit_arrays(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, start, end) of all units of a batch, in order."""
    seen, odd = [], {}
    for i, t in enumerate(texts):
        s, at = plain(t) if t else ("", None)
        if at is not None:
            odd[i] = at
        seen.append(s)
    joined = "\n" + "\n".join(seen) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbols, end, count, places = lex(joined, codes)
    out = run(symbols)
    cut = (out > NONE) & (np.append(out[1:], NONE) != EXTENDS)
    # A line's end ends a unit before its own character.
    b = np.where(symbols[cut] == 0, end[cut] - 1, end[cut])
    a = np.concatenate(([0], b[:-1]))
    some = count[b] > count[a]
    start, stop = places[count[a[some]]], places[count[b[some]] - 1] + 1
    size = np.fromiter((len(s) + 1 for s in seen), dtype=np.int64, count=len(seen))
    base = np.cumsum(size) - size + 1
    who = np.searchsorted(base, start, "right") - 1
    start, stop = start - base[who], stop - base[who]
    if not odd:
        return who, start, stop
    # Boundaries behind what isn't seen: stripped again in the text as stored.
    plain_ones = ~np.isin(who, np.fromiter(odd, dtype=np.int64))
    more: list[tuple[int, int, int]] = []
    for i, at in odd.items():
        t, last = texts[i], 0
        for x in b[slice(*np.searchsorted(b, (base[i], base[i] + size[i])))].tolist():
            e = at[x - base[i]]
            piece = t[last:e]
            kept = piece.lstrip()
            if kept:
                s = last + len(piece) - len(kept)
                more.append((i, s, s + len(kept.rstrip())))
            last = e
    rows = np.asarray(more, dtype=np.int64).reshape(-1, 3)
    who = np.concatenate((who[plain_ones], rows[:, 0]))
    start = np.concatenate((start[plain_ones], rows[:, 1]))
    stop = np.concatenate((stop[plain_ones], rows[:, 2]))
    order = np.argsort(who, kind="stable")
    return who[order], start[order], stop[order]


def units_of(texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """Units (start, end) of every text of a batch."""
    who, start, stop = unit_arrays(texts)
    rows = list(zip(start.tolist(), stop.tolist()))
    at = np.searchsorted(who, np.arange(len(texts) + 1)).tolist()
    return [rows[i:j] for i, j in zip(at, at[1:])]
