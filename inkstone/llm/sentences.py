"""Sentence boundaries across languages and scripts.

The Unicode sentence-break properties (STerm, ATerm, Close, SContinue, Lower) give the candidates in every script; what they
leave open is settled by abbreviation lists per language, by matched quotations and brackets, and by white space in scripts
without end marks. Offsets count code points from 0, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread_again

# Abbreviations that never end a sentence, by language; those of "any" hold in all of them.
NEVER = {
    "any": "mr mrs ms dr prof vs cf al st dept approx",
    "en": "rev hon capt lt col gen sgt gov sen rep mt viz eg ie incl",
    "de": "bzw ca vgl hr fr frl bde evtl ggf inkl sog str usf zzgl ggü mind dipl bspw geb mio mrd",
    "fr": "m mm mme mmes mlle mlles mgr av env ex réf",
    "es": "sra sres srta dra drs ud uds vd vds avda ej lic gral ee aprox",
    "it": "sig sigg dott avv ing pag es ecc arch",
    "pt": "sra sras dra exa av pág ex profa",
    "hi": "डॉ श्री श्रीमती प्रो पं कु",
    "ru": "г гг ул рис стр см ср им проф акад т п д пр тыс млн млрд напр обл пос ред изд табл",
}
# Words by which a language is known, and with which its sentences often begin.
FUNCTION_WORDS = {
    "en": "the he she it they we i you in on at this that these those there a an but and or if when what then as after before my his her our their its who how why where so not of to was is are were with for had have",
    "de": "der die das ein eine einen er sie es wir ich und aber wenn dann im am auf mit von den dem nicht ist war zu sich als auch nach bei",
    "fr": "le la les un une il elle ils elles nous vous je et mais dans ce cette ces puis des du est était au aux pour avec sur que qui pas",
    "es": "el la los las un una él ella ellos nosotros yo y pero en este esta entonces se del al es era por con para que no lo su",
    "it": "il lo la gli le un una lui lei noi e ma in questo questa poi di del della è era per con che non si",
    "pt": "o a os as um uma ele ela eles nós eu e mas em este esta então de do da é era por com para que não se",
}
# Abbreviations that do not end a sentence before a number.
NUMBERED = "no nos nr fig figs abb vol vols eq pp ch chap cap sec art bd bde núm pág págs ed tel"
# Abbreviations that can end a sentence; they do so before a capital.
MAYBE = "etc usw inc ltd co corp jr sr bros plc llc gmbh uu dgl am pm a.m p.m u.s u.k u.n d.c ph.d b.c a.d kg km cm mm min std"
DOTTED_MAYBE = "a.m p.m u.s u.k u.n d.c ph.d b.c a.d"
COMPANY = "inc ltd co corp plc llc gmbh"
# Month and weekday names and their short forms.
MONTHS_SHORT = "jan feb mar apr jun jul aug sep sept oct okt nov dec dez mon tue wed thu fri sat sun"
MONTHS_DE = "januar februar märz april mai juni juli august september oktober november dezember jahrhundert jh"
DAYS = "monday tuesday wednesday thursday friday saturday sunday"
# German words before an ordinal number.
ORDINAL_DE = "am im der den dem des die das vom zum zur bis seit ab jeden jedem beim ins"
# Words with which a Chinese sentence goes on after a quotation or a bracket.
GOES_ON_ZH = ("然后", "接着", "随后", "之后", "于是", "就", "便", "才", "又", "并", "的", "了", "是", "说", "问", "道", "也", "都", "却")

_NEVER = {language: frozenset(words.split()) for language, words in NEVER.items()}
_SOMEWHERE = frozenset().union(*_NEVER.values())
_FUNCTION = {language: frozenset(words.split()) for language, words in FUNCTION_WORDS.items()}
_LATIN_WORD = regex.compile(r"[\p{Latin}\p{M}]+")
_CYRILLIC, _DEVANAGARI = regex.compile(r"\p{Cyrillic}"), regex.compile(r"\p{Devanagari}")
#: Characters after a full stop by which the language of its surroundings is told as well.
AROUND = 80
_NUMBERED = set(NUMBERED.split())
_LIST_NUMBER = regex.compile(r"\d{1,3}[.)]\s+[\p{Lu}\p{Lo}]")
_TITLES = {"sr"}
_MAYBE = set(MAYBE.split()) | set(DOTTED_MAYBE.split())
_COMPANY, _SHORT, _MONTHS, _DAYS, _ORDINAL = (set(x.split()) for x in (COMPANY, MONTHS_SHORT, MONTHS_DE, DAYS, ORDINAL_DE))

_BLANK = regex.compile(r"(?:\r\n|[\n\r ])[^\S\n\r  ]*(?:\r\n|[\n\r ])\s*|\s* \s*")
_OPEN = {"“": "”", "‘": "’", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "(": ")", "[": "]", "【": "】", "〔": "〕", "«": "»", "„": "“", "‚": "‘", "｢": "｣", "［": "］", "{": "}"}
_BRACKETS = set("（([【〔［{")
_CLOSE = set(_OPEN.values()) - {"“", "‘", "’"}
_ELLIPSIS = r"…|⋯|\.{2,}|．{2,}|。{2,}"
_MARKS = regex.compile(rf"(?:{_ELLIPSIS}|[\p{{STerm}}\p{{SB=ATerm}}])+", regex.V1)
_ONLY_ELLIPSIS = regex.compile(r"(?:…|⋯|\.{2,}|．{2,}|。{2,})+")
_PAIRS = regex.compile(r"[“”‘「」『』《》〈〉（）()\[\]【】〔〕«»„‚｢｣［］{}\"]")
_CLOSERS = regex.compile(r"[\p{SB=Close}]*", regex.V1)
_CONTINUES = regex.compile(r"[,，、;；:：]")
_WORD = regex.compile(r"[[\p{L}\p{M}\p{N}.'’_\-]--[\p{Han}\p{Hiragana}\p{Katakana}]]*$", regex.V1)
_NEXT_WORD = regex.compile(r"[\p{L}\p{M}]+")
_DOTTED = regex.compile(r"(?:\p{L}\.)+\p{L}")
_LETTER = regex.compile(r"\p{L}")
_THAI_GAP = regex.compile(r"(?<=[\u0e00-\u0eff])\s+(?=[\u0e00-\u0eff一-鿿぀-ヿऀ-ॿ])")
_THAI_OR_LAO = regex.compile(r"[\u0e00-\u0eff]")
_KHMER = regex.compile(r"[\u1780-\u17d3]")
_GAP = regex.compile(r"(?<=[^\s\p{N}])\s+(?=[^\s\p{N}])")
_HAN, _KANA = regex.compile(r"[一-鿿]"), regex.compile(r"[぀-ヺー-ヿ]")
_CASED = regex.compile(r"[\p{Lu}\p{Ll}\p{Lt}]")
_SOME_MARK = regex.compile(r"[\p{STerm}．]|(?<!^\s*\d{1,3})\.(?=\s|$)", regex.V1)


def _script(c: str) -> str:
    """cased, kana, or the like of a letter; '' for none."""
    if not c:
        return ""
    if _CASED.match(c):
        return "cased"
    if _KANA.match(c):
        return "kana"
    return "other" if _LETTER.match(c) else ""


def _pairs(block: str) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Matched quotations and brackets, outermost only, in order; and the opener of each closer of those."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _PAIRS.finditer(block):
        c, i = m.group(), m.start()
        if c == '"':
            inside = [k for k, x in enumerate(stack) if x[0] == '"']
            opens = i == 0 or block[i - 1].isspace() or block[i - 1] in _OPEN or not inside and not block[i - 1].isalnum() and not block[i - 1] in ".!?,"
            if inside and not (opens and i + 1 < len(block) and not block[i + 1].isspace() and i and block[i - 1].isspace()):
                found.append((stack[inside[-1]][1], i))
                del stack[inside[-1] :]
            elif opens:
                stack.append(('"', i))
            continue
        for k in range(len(stack) - 1, -1, -1):
            if _OPEN.get(stack[k][0]) == c:
                found.append((stack[k][1], i))
                del stack[k:]
                break
        else:
            if c in _OPEN:
                stack.append((c, i))
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer, {b: a for a, b in outer}


def _block_ends(block: str) -> Iterator[int]:
    """Ends of the sentences of a block without blank lines (the last end, that of the block, is not given)."""
    outer, opener_of = _pairs(block)
    at, start, n = 0, 0, len(block)
    pos = 0
    while m := _MARKS.search(block, pos):
        pos = m.end()
        marks = m.group()
        while at < len(outer) and outer[at][1] < m.start():
            at += 1
        inside = at < len(outer) and outer[at][0] < m.start()
        if inside:
            closed = outer[at][1]
            if not all(c in _CLOSE or c in "\"”’“‘" or c.isspace() for c in block[m.end() : closed + 1]):
                continue  # more comes within the quotation
            end = closed + 1
        else:
            end = m.end()
            k = _CLOSERS.match(block, end).end()
            while end < k and block[end] not in _OPEN and not (block[end] == '"' and end not in opener_of):
                end += 1
        pos = max(pos, end)
        rest = end
        while rest < n and block[rest].isspace():
            rest += 1
        if rest >= n:
            return
        if _CONTINUES.match(block, rest):
            continue
        gap = rest > end
        letter = rest
        while letter < n and not block[letter].isalnum() and letter - rest < 4:
            letter += 1
        nx = block[letter] if letter < n else ""
        nx_script = _script(nx)
        if nx.islower() and block[rest] in "—–―-":
            continue  # a dash, then who spoke
        before = next((c for c in reversed(block[max(0, m.start() - 40) : m.start()]) if _LETTER.match(c)), "")
        while start < m.start() and block[start].isspace():
            start += 1
        if _ONLY_ELLIPSIS.fullmatch(marks):
            if _script(before) != "cased" or nx.islower() or not gap and end == m.end() and nx_script == "cased" and not nx.isupper():
                continue
            if _script(before) == "cased" and _HAN.search(block, start, m.start()) and not block[start:m.start()].isascii() and len(_HAN.findall(block, start, m.start())) > 3:
                continue
        elif marks == ".":
            if not inside and not _dot_ends(block, start, m.start(), end, rest, nx, gap):
                continue
            if inside and nx.islower():
                continue
        elif marks == "．" and m.start() and block[m.start() - 1].isdigit() and block[end : end + 1].isdigit():
            continue
        elif not gap and end == m.end() and nx_script == "cased" and letter == rest and marks[-1] in "!?.":
            if before and _script(before) == "cased" or nx.islower():
                continue  # within a name
        elif nx.islower() and (inside or end > m.end()):
            continue
        if inside and not _quotation_ends(block, start, opener_of[end - 1], end, rest, nx_script, nx):
            continue
        yield end
        start = end


def _languages(block: str, start: int, dot: int) -> list[str]:
    """The languages whose rules hold at a full stop: those of most known words around it; without any, all of the script."""
    around = block[start : dot + AROUND]
    counts = dict.fromkeys(_FUNCTION, 0)
    for m in _LATIN_WORD.finditer(around):
        word = m.group().lower()
        for language, words in _FUNCTION.items():
            counts[language] += word in words
    most = max(counts.values())
    found = [language for language, n in counts.items() if n == most]
    return found + (["ru"] if _CYRILLIC.search(around) else []) + (["hi"] if _DEVANAGARI.search(around) else [])


def _begins_sentence(block: str, rest: int, languages: list[str]) -> bool:
    """Whether the next word is one with which sentences begin rather than a name."""
    m = _NEXT_WORD.match(block, rest)
    return bool(m) and any(m.group().lower() in _FUNCTION.get(x, ()) for x in languages)


def _dot_ends(block: str, start: int, dot: int, end: int, rest: int, nx: str, gap: bool) -> bool:
    word = _WORD.search(block, max(start, dot - 40), dot).group()
    following = block[end : end + 1]
    if not gap and end == dot + 1 and (following.isalnum() and following.isascii() or _script(following) == "cased"):
        return False
    if start + len(word) >= dot and len(word) <= 3 and word.isdigit():
        return False  # a list number
    if nx.islower():
        return False
    low = word.lower().strip("'’-")
    if not low:
        return True
    is_han = bool(_HAN.match(nx)) if nx else False
    if low == "st":
        # a saint, or a street at the end of a sentence
        return bool(nx) and nx.isupper() and _begins_sentence(block, rest, _languages(block, start, dot))
    if low in _NEVER["any"]:
        return False
    if low in _SOMEWHERE and any(low in _NEVER.get(x, ()) for x in _languages(block, start, dot)):
        return False
    if low in _NUMBERED:
        return not nx.isdigit()
    if low in _TITLES:
        return not nx.isupper()
    if low in _SHORT and word[0].isupper():
        return not nx.isdigit() and not is_han
    if low in _MAYBE:
        if is_han:
            return low not in _COMPANY and not block.startswith(GOES_ON_ZH, rest)
        if nx.isdigit():
            return bool(_LIST_NUMBER.match(block, rest))
        nx_word = _NEXT_WORD.match(block, rest)
        return nx.isupper() and not (nx_word and nx_word.group().lower() in _DAYS) or not nx
    if len(low) == 1 and low.isalpha() and low.isascii():
        languages = _languages(block, start, dot)
        if word == "I" and languages == ["en"]:
            return True
        # an initial, or a part of an abbreviation, unless the next word is no name
        return nx.isupper() and bool(_NEXT_WORD.match(block, rest)) and len(_NEXT_WORD.match(block, rest).group()) > 1 and _begins_sentence(block, rest, languages)
    if _DOTTED.fullmatch(low):
        return False
    if word.isdigit() and len(word) <= 2 and nx.isupper():
        nx_word = _NEXT_WORD.match(block, rest)
        if nx_word and nx_word.group().lower() in _MONTHS:
            return False
        previous = _NEXT_WORD.findall(block, max(start, dot - 30), dot - len(word))
        if previous and previous[-1].lower() in _ORDINAL and nx_word and len(previous[-1]) > 1:
            return False
    return True


def _quotation_ends(block: str, start: int, opener: int, end: int, rest: int, nx_script: str, nx: str) -> bool:
    """Whether the sentence ends with a quotation or bracket that closes after an end mark; else it goes on after it."""
    if nx.islower():
        return False
    before = opener - 1
    while before >= start and block[before].isspace():
        before -= 1
    if block[opener] in _BRACKETS:
        return nx_script != "kana" and not block.startswith(GOES_ON_ZH, rest) if before >= start else True
    inner = next((c for c in reversed(block[opener:end]) if _LETTER.match(c)), "")
    inner_cased = _script(inner) == "cased" and not _HAN.search(block, opener, end)
    if before < start:
        # the quotation begins the sentence: what follows in the same kind of script says who spoke
        return (nx_script == "cased") != inner_cased or inner_cased
    if block[before] in ":：,，":
        return not (nx_script == "kana" or block.startswith(GOES_ON_ZH, rest))
    if _script(block[before]) == "cased":
        return True
    return False


def _unmarked(text: str) -> bool:
    """Whether a text is rather in a script that can do without end marks than in one with capitals."""
    letters = max(len(_HAN.findall(text)), len(_KHMER.findall(text)))
    return letters > 0 and letters >= len(_CASED.findall(text))


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text, without surrounding white space; [] for null, empty and blank texts."""
    if not text:
        return []
    spans: list[tuple[int, int]] = []
    bare = not _SOME_MARK.search(text) and not _KANA.search(text) and _unmarked(text)
    thai = _THAI_OR_LAO.search(text) is not None
    edges = [0]
    for m in _BLANK.finditer(text):
        edges += [m.start(), m.end()]
    edges.append(len(text))
    for a, b in zip(edges[::2], edges[1::2]):
        block = text[a:b]
        ends = list(_block_ends(block))
        if thai or bare:
            gaps = (_GAP if bare else _THAI_GAP).finditer(block)
            ends = sorted({*ends, *(m.start() for m in gaps)})
        low = 0
        for high in [*ends, len(block)]:
            s, e = low, high
            while s < e and block[s].isspace():
                s += 1
            while e > s and block[e - 1].isspace():
                e -= 1
            if s < e:
                spans.append((a + s, a + e))
            low = high
    return spans


def split_sentences(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos) of every sentence of every text.

    Rows of one key count once (with several texts under one key, the smallest is taken); a null key is a key. Null, empty
    and blank texts have no sentence. The texts are shuffled once, by key, to drop repeated rows; the rest is one Arrow pass.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null")
    one = spread_again(rows.groupBy("k").agg(F.min("t").alias("t")), rows, "k")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("start_pos", T.IntegerType(), False), T.StructField("end_pos", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                for s, e in sentence_spans(x):
                    rows.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [key, "start_pos", "end_pos"])

    return one.mapInArrow(run, schema)
