"""Sentence units across languages and scripts by semi-Markov dynamic programming.

A text falls into blocks at blank lines. Within a block every end mark (and, in Thai, Lao and Khmer, every
space between two letters) is a possible end of a span. The best segmentation maximises the sum of
span scores, each of which weighs jointly

* the closing words: abbreviations, numbers, initials, units, chained abbreviations, judged by the words
  before them within the span: a span that is but the number of what follows ends nowhere;
* the opening word of what follows: case, list and paragraph numbers, particles that go on with the
  sentence after a quotation;
* balanced quotations and brackets, of any length within the block: a span that cuts one pays for it;
* the length: spans without a letter pay, others a little for unusual lengths.

A block's end always ends a span. Offsets are Unicode code points, without outer white space.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from math import exp, inf, log

import pyarrow as pa
from pyspark.sql import DataFrame

from veldt.llm.tokens import slices

_NL = r"(?:\r\n|\r(?!\n)|[\n\x0b\x0c\x85\u2028\u2029])"
_H = r"[^\S\n\r\x0b\x0c\x85\u2028\u2029]*"
_BLANK = re.compile(rf"{_NL}{_H}{_NL}\s*|\u2029\s*")
_MARKS = re.compile(r"[.!?…。！？．｡।॥؟۔‼⁇⁈⁉។]+")
_THAI = re.compile(r"(?<=[ก-ฺเ-๎ກ-໎ក-៓])[^\S\n\r\x0b\x0c\x85\u2028\u2029]+(?=[ก-ฺเ-๎ກ-໎ក-៓])")
_PAIRS = re.compile(
    r"„[^„“”]{1,300}[“”]|‚[^‚‘’]{1,200}[‘’]|«[^«»]{1,300}»|»[^«»]{1,300}«|“[^“”]{1,300}”|(?<!\w)‘[^‘’]{1,200}’|‘[^‘’]{1,60}’|\"[^\"]{1,300}\"|"
    r"「[^「」]{1,300}」|『[^『』]{1,300}』|\((?:[^()]|\([^()]{0,80}\)){0,400}\)|（[^（）]{0,400}）|\[[^\[\]]{0,200}\]|【[^【】]{0,60}】|《[^《》]{1,200}》"
)
_DELIMITER = re.compile(r"[„‚«»“”‘’\"「」『』()（）\[\]【】《》]")
_CLOSES = {"„": "“”", "‚": "‘’", "«": "»", "»": "«", "“": "”", "‘": "’", '"': '"', "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》"}
_BRACKETS = frozenset("(（[【《「『")
#: Quotation marks whose direction is uncertain are paired by what is around them only beyond this length.
_LONG_QUOTATION = 200
_HAS_PAIR = re.compile(r"[„‚«»“‘\"「『(（\[【《]")
_CLOSERS = frozenset("\"”’»)]}」』】〉》）］｝›")
_OPENERS = frozenset("\"“„«»‘‚(（「『[【《‹¿¡")
_EMPHASIS = frozenset("*_`~")
_FULL = frozenset("。！？｡．")
_DANDA = frozenset("।॥۔។")
_LETTER = re.compile(r"[^\W\d_]")
_TOKEN = re.compile(r"[^\s(\[{\"“„«»‘‚（「『　-〿぀-ヿ㐀-鿿가-힣]*$")
_BEFORE = re.compile(r"(\S+)\s+$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_ITEM = re.compile(r"\d{1,3}[.)]\s+[^\W\d_a-zа-яß-ÿ]")
_PARAGRAPH = re.compile(r"[\[【]\s*\d{2,6}\s*[\]】]")
_CAMEL = re.compile(r"[a-z]{1,2}[A-Z]")
_UNSPACED = re.compile(r"[A-ZÀ-ÞА-Я](?:[^\W\d_A-ZÀ-ÞА-Я]|\s[a-zß-ÿа-я])")
_CAPITALS = re.compile(r"[A-ZÀ-ÞА-Я]+\s+[A-ZÀ-ÞА-Я]{2}")
_OPERATOR = re.compile(r"[+=·×÷*/^<>≤≥±−.]+")
_NUMBER = re.compile(r"[\d.,:/–-]*\d[\d.,:/–-]*")

#: Ends that score less are never worth taking: the rest of a span's score varies by less.
_HOPELESS = -1.0
#: What may end a sentence before the number of the claim that follows.
_BEFORE_CLAIM = ".!?。…」”\"»)؟।"
_SPEECH_END = ".!?。…”\"»)"
#: Closing words are judged by so many characters before the mark at most.
_CONTEXT = 48
#: From this length on a longer span scores less.
_USUAL = 90

# fixed values: abbreviations after which a sentence goes on
_ABBREVIATIONS = frozenset(
    "fig figs eq eqs sect sec ex exs comp tab abb abs nr no. cf vgl e.g i.e viz vs approx incl ca bzw insb min max u dr prof mr mrs ms st jan feb mar apr jun jul aug sep sept oct nov dec "
    "pat appl ser anm durchm evtl ggf sog vol pp chap ref refs réf fig env núm pág aprox ej art págs av табл рис пп ок см стр гл напр др. डॉ श्री d h s z i p co".split()
)
# fixed values: abbreviations only before a number
_BEFORE_NUMBER = frozenset("no nos nr nro núm p n v ch п г т вып art".split())
# fixed values: abbreviations that may also end a sentence
_MAY_END = frozenset("etc usw inc ltd corp p.m a.m len dia u.a jr bros uhr".split())
_NO_UNIT = frozenset("u o z d i e p r п т".split())
_CHAIN_MAY_END = frozenset(("т.д", "т.п", "u.a", "u.s.w", "p.m", "a.m"))
# fixed values: words before a German ordinal
_BEFORE_ORDINAL = frozenset("am der dem den des die das im vom zum zur beim bis ab seit jeder jedem jeden jede ihre ihrer seine seiner und".split())
# fixed values: what goes on with the sentence after a closed quotation
_GOES_ON = re.compile(
    r"と|という|の|は(?!じ)|が(?!い)|を|に(?!つ)|で(?!き)|も(?!し)|へ|や|から|まで|など|より|[、，,;；:：]|字样|的|等|之|后|时|并|就|便|而|地|得|ثم|و(?!ش)|라고|라는|이라|고 |는 |란 |에 |को |का |की |के |से |में |पर |ने "
)


def _opening(text: str, n: int, end: int) -> tuple[float, str]:
    """Score and kind of the word at ``n`` as the first of a sentence."""
    while text[n] in _EMPHASIS and n + 1 < end:
        n += 1
    c, quoted = text[n], False
    if c in _OPENERS:
        if _PARAGRAPH.match(text, n):
            return 4.0, "paragraph"
        while n < end and (text[n] in _OPENERS or text[n].isspace()):
            n += 1
        if n >= end:
            return -3.0, "other"
        c, quoted = text[n], True
    if c.isdigit():
        if not quoted and _ITEM.match(text, n):
            return 3.0, "item"
        return (0.0, "digit") if quoted else (-2.5, "digit")
    if c.islower():
        if _CAMEL.match(text, n):
            return 2.5, "upper"
        return (-3.0, "lower") if quoted else (-8.0, "lower")
    if c.isupper():
        return 3.0, "upper"
    if c.isalpha():
        return 3.0, "caseless"
    return -3.0, "other"


def _ends(text: str, start: int, word: str, at: int) -> bool:
    """Whether ``word``, which is at ``at`` and has an end mark, may be a sentence's last before a claim number."""
    if len(word) == 2 and word[0].isalpha() and word[1] == ".":
        # an initial, unless it is a unit after a number or the last sign of a formula
        earlier = _BEFORE.search(text, max(start, at - 24), at)
        return bool(earlier) and bool(_NUMBER.fullmatch(earlier.group(1)) or _OPERATOR.fullmatch(earlier.group(1)))
    return word.rstrip(_SPEECH_END).lower() not in _ABBREVIATIONS and word.rstrip(".").lower() not in _BEFORE_NUMBER


def _closing(text: str, start: int, at: int, kind: str, after: int) -> float:
    """Score of the word that ends in the full stop at ``at`` as the last of a sentence."""
    token = _TOKEN.search(text, max(start, at - 24), at).group()
    if not token:
        return 0.0
    low = token.lower()
    if low in _MAY_END:
        return 0.0
    if low in _BEFORE_NUMBER and len(token) > 1:
        return -8.0 if kind in ("digit", "item", "other") else 0.0
    before = _BEFORE.search(text, max(start, at - len(token) - 24), at - len(token))
    previous = before.group(1) if before else ""
    if token.isdigit() and len(token) <= 4:
        head = text[start : at - len(token)]
        if not head.strip() or _PARAGRAPH.fullmatch(head.strip()):
            return -9.0  # the number that introduces the block
        if kind in ("upper", "caseless") and len(token) <= 3 and previous and previous[-1] in _BEFORE_CLAIM and _ends(text, start, previous, before.start(1)):
            return -9.0  # the number of the claim that follows
        if kind == "upper" and previous.lower() in _BEFORE_ORDINAL:
            return -8.0
        return 0.0
    if len(token) == 1 and token.isalpha():
        if at - 2 >= start and text[at - 2] in "{=_^/*":
            return 0.0  # the last sign of a formula
        if _NUMBER.fullmatch(previous) and low not in _NO_UNIT:
            return 0.0  # a unit
        if _OPERATOR.fullmatch(previous):
            return 0.0  # the last sign of a formula
        if previous.endswith("."):
            return 0.0 if previous.lower() + low in _CHAIN_MAY_END else -8.0
        if token.isupper() and len(previous) > 1 and previous[-1].isalpha():
            return 0.0  # "Sample B."
        return -8.0 if token.islower() or not previous else -4.0
    if len(token) == 2 and token.isupper() and token[0] == token[1]:
        return -9.0  # plurals such as "EE. UU."
    if low in _ABBREVIATIONS:
        if _NUMBER.fullmatch(previous) and len(token) <= 2:
            return 0.0
        return -9.0
    if "." in token and len(token) <= 6 and all(len(x) <= 1 for x in token.split(".")) and token[0].isalpha():
        return 0.0 if low in _CHAIN_MAY_END else -6.0
    return 0.0


def _score(text: str, start: int, end: int, a: int, b: int, after: int, closed: bool) -> float:
    """Score of ending a span after ``after``, where the marks are text[a:b]; ``closed``: a quotation ends too."""
    mark = text[b - 1]
    n = after
    while n < end and text[n].isspace():
        n += 1
    spaced, c = n > after, text[n]
    prev = text[a - 1] if a > start else " "
    if mark in _DANDA:
        return 4.0
    if mark in _FULL:
        if mark == "．" and prev.isdigit() and not spaced and c.isdigit():
            return -8.0
        if closed and _GOES_ON.match(text, n):
            return -8.0
        if c in "、，；,;":
            return -8.0
        if prev.isascii() and prev.isalnum() and not _CJK.match(text, n):
            if c.islower() and not _CAMEL.match(text, n):
                return -6.0
            return 3.0 + _closing(text, start, a, "upper", after)
        return 4.0 if not (c.islower() and c.isascii()) or not closed else -4.0
    dots = b - a
    if mark == "…" or dots > 1 and set(text[a:b]) == {"."}:
        if mark == "…" and _CJK.match(prev) or _CJK.match(text, n):
            if c in "、，；,;" or closed and _GOES_ON.match(text, n):
                return -8.0
            return 3.0 if mark == "…" else -4.0
        if prev.isspace() and not closed:
            return -8.0
        score, kind = _opening(text, n, end)
        return (score - 0.5 if kind in ("upper", "paragraph", "item") else score - 2.5 if kind == "caseless" else -8.0) if spaced else -8.0
    if mark in "!?؟‼⁇⁈⁉":
        if not spaced and not closed:
            if _UNSPACED.match(text, n) and prev.isalpha():
                return 2.5
            return 3.0 if _CJK.match(text, n) else -8.0
        if closed and _GOES_ON.match(text, n):
            return -8.0
        score, kind = _opening(text, n, end)
        if not spaced:
            return 2.0 if kind == "upper" and _UNSPACED.match(text, n) or kind == "paragraph" or _CJK.match(text, n) else -8.0
        return score + 1 if kind != "digit" else 1.0
    # a full stop
    if prev.isspace():
        return -8.0
    if not spaced:
        if _CJK.match(text, n):
            return -8.0 if not closed or _GOES_ON.match(text, n) else 2.0
        if a - 3 >= start and text[a - 3 : a].isalpha() and text[a - 3 : a].islower() and _CAPITALS.match(text, n):
            return 1.5
        if _UNSPACED.match(text, n) and (prev.islower() or prev.isdigit() or not prev.isalnum() or closed or a - 2 >= start and not text[a - 2].isalpha()):
            return 1.5 + _closing(text, start, a, "upper", after)
        if c in _OPENERS and not closed and n + 1 < end and _UNSPACED.match(text, n + 1) and c not in "([":
            return 1.0 + _closing(text, start, a, "upper", after)
        return -8.0
    if closed and _GOES_ON.match(text, n):
        return -8.0
    score, kind = _opening(text, n, end)
    if closed:
        return score + 1
    return score + _closing(text, start, a, kind, after)


def _goes_on(text: str, b: int, end: int) -> bool:
    """Whether the sentence goes on after the quotation or bracket that ends before ``b``."""
    n = b
    while n < end and text[n].isspace():
        n += 1
    if n >= end:
        return False
    return text[n].islower() or text[n] in "、，,;；:：" or bool(_MARKS.match(text, n)) or bool(_GOES_ON.match(text, n)) or not _MARKS.match(text, b - 2)


def _long_pairs(text: str, start: int, end: int, short: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Quotations and brackets of any length besides the ``short`` ones that the sentence goes on after; none within another.

    A stack over the block: a bracket is no pair across an open bracket, a quotation none across anything open.
    """
    known, stack, found = set(short), [], []
    awaited = dict.fromkeys("".join(_CLOSES.values()), 0)  # open marks by what would close them
    for m in _DELIMITER.finditer(text, start, end):
        a, c = m.start(), m.group()
        before, after = text[a - 1] if a > start else " ", text[a + 1] if a + 1 < end else " "
        if c == "’" and before.isalnum() and after.isalnum():
            continue  # an apostrophe
        if awaited.get(c) and (c != '"' or not before.isspace()):
            at = next(k for k in range(len(stack) - 1, -1, -1) if c in _CLOSES[text[stack[k]]])
            opener = stack[at]
            for x in stack[at:]:
                for e in _CLOSES[text[x]]:
                    awaited[e] -= 1
            clean = all(text[x] not in _BRACKETS for x in stack[at + 1 :]) if text[opener] in _BRACKETS else at == len(stack) - 1
            del stack[at:]
            if clean and (opener, a + 1) not in known and (text[opener] in _BRACKETS or a - opener > _LONG_QUOTATION) and _goes_on(text, a + 1, end):
                found.append((opener, a + 1))
        elif c in _CLOSES and (c in _BRACKETS or c in "„“‚" or c == "«" and before.isspace() or not before.isalnum() and not after.isspace() and (before.isspace() or before in _OPENERS)):
            stack.append(a)
            for e in _CLOSES[c]:
                awaited[e] += 1
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if (not out or b > out[-1][1]) and not any(x <= a and b <= y for x, y in short[max(0, bisect_left(short, (a, a)) - 1) :][:2]):
            out.append((a, b))
    return out


def _overtakes(best: list[float], starts: list[int], older: int, newer: int) -> float:
    """From which end on the older start, of higher score, is better than the newer one; infinite where it never is."""
    if best[older] <= best[newer]:
        return inf
    r = exp(min(10.0 * (best[older] - best[newer]), 700.0))
    return (r * starts[newer] - starts[older]) / (r - 1.0) if r > 1.0 else inf


def _block(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    """Append the units of the block text[start:end], which has no outer white space."""
    marks = [m.span() for m in _MARKS.finditer(text, start, end)]
    spaces = [m.span() for m in _THAI.finditer(text, start, end)]
    if not marks and not spaces:
        out.append((start, end))
        return
    pairs = [m.span() for m in _PAIRS.finditer(text, start, end)] if _HAS_PAIR.search(text, start, end) else []
    ends, begins = {b for _, b in pairs}, [a for a, _ in pairs]
    opening = set(begins)
    if marks and _HAS_PAIR.search(text, start, end) and (long := _long_pairs(text, start, end, pairs)):
        ends |= {b for _, b in long}
        # what is within or across a longer pair is no pair of its own
        rest = []
        k = 0
        for a, b in pairs:
            while k < len(long) and long[k][1] <= a:
                k += 1
            if k == len(long) or b <= long[k][0]:
                rest.append((a, b))
        pairs = sorted(rest + long)
        begins = [a for a, _ in pairs]
    found: list[tuple[int, float]] = []  # possible ends with their scores
    marked: dict[int, tuple[int, int, bool]] = {}  # what the scores are of
    for a, b in marks:
        after, closed = b, False
        while after < end:
            c = text[after]
            if after + 1 in ends or c in _CLOSERS and not (c == '"' and after in opening):
                after, closed = after + 1, True
            elif c in _EMPHASIS and (after + 1 == end or text[after + 1].isspace()):
                after += 1
            elif c.isspace() and after + 2 in ends and after + 1 < end:
                after, closed = after + 2, True
            else:
                break
        if after >= end:
            continue
        score = _score(text, start, end, a, b, after, closed)
        if score > _HOPELESS:
            found.append((after, score))
            marked[after] = (a, b, closed)
    found += [(a, 3.0) for a, _ in spaces]
    if not found:
        out.append((start, end))
        return
    found.sort()
    cut = []
    for p, s in found:
        k = bisect_left(begins, p) - 1  # pairs do not overlap: only the last one before may be cut
        cut.append((p, s, 6.0 if k >= 0 and p < pairs[k][1] else 0.0))
    cut.append((end, 0.0, 0.0))
    letter: list[int] = []  # the first letter at or after each possible start
    for p in (start, *(x[0] for x in cut[:-1])):
        if not letter or letter[-1] < p:
            letter.append(m.start() if (m := _LETTER.search(text, p, end)) else end)
        else:
            letter.append(letter[-1])
    best, back = [0.0], [0]
    starts = [start, *(x[0] for x in cut)]
    # Starts more than the usual length back that may still win, with values that rise: one that an older
    # start beats stays beaten, as lengths of both cost ever more alike and letters come no sooner after it.
    far: list[int] = []
    near = 0  # the first start within the usual length
    for j, (p, s, cuts) in enumerate(cut):
        while near <= j and p - starts[near] >= _USUAL:
            alike = lambda i: letter[i] == letter[near] or letter[near] < p  # noqa: B023, E731
            while far and best[far[-1]] <= best[near] and alike(far[-1]):
                far.pop()
            while len(far) > 1 and alike(far[-2]) and _overtakes(best, starts, far[-2], far[-1]) <= _overtakes(best, starts, far[-1], near):
                far.pop()  # beaten by the older before it beats the newer
            far.append(near)
            near += 1
        top, at, bare, kept = -1e18, 0, -1e18, []
        for i in far:
            value = best[i] - 0.1 * log((p - starts[i]) / _USUAL)
            if value <= bare or letter[i] < p and value <= top:
                continue
            kept.append(i)
            if letter[i] >= p:
                bare, value = value, value - 8.0
            if value > top:
                top, at = value, i
        far = kept
        mark = marked.get(p)
        for i in range(near, j + 1):
            value = best[i] - (8.0 if letter[i] >= p else 0.0) - 0.1 * abs(log((p - starts[i]) / _USUAL))
            if i and mark and mark[0] - starts[i] <= _CONTEXT:
                # a short span: its closing words are judged without what is before it
                value += _score(text, starts[i], end, mark[0], mark[1], p, mark[2]) - s
            if value > top:
                top, at = value, i
        best.append(top - cuts + s)
        back.append(at)
    j, spans = len(cut), []
    while j:
        i = back[j]
        a, b = starts[i], starts[j]
        while text[a].isspace():
            a += 1
        spans.append((a, b))
        j = i
    out.extend(reversed(spans))


def sentence_units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit; none for null and blank texts."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    at = 0
    for m in _BLANK.finditer(text):
        _trimmed(text, at, m.start(), out)
        at = m.end()
    _trimmed(text, at, len(text), out)
    return out


def _trimmed(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if start < end:
        _block(text, start, end, out)


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_at, end_at), a row per sentence unit of every text.

    Narrow: no shuffle. Defined results: null and blank texts have no units; a text without marks is
    a unit per block; long texts are processed whole; repeated rows are repeated; other columns are
    not read; an empty table gives an empty result.
    """
    picked = df.select(key, text)
    kind = picked.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            index: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for i, value in enumerate(batch.column(1).to_pylist()):
                units = sentence_units(value)
                index.extend([i] * len(units))
                for a, b in units:
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "start_at", "end_at"])

    return picked.mapInArrow(rows, f"`{key}` {kind}, start_at int, end_at int")


def unit_faults(df: DataFrame) -> DataFrame:
    """(uncovered, overlapping, outer_space), 0 or 1 each, of rows (doc_id, text, spans) with a text's units in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: tuple[list[int], ...] = ([], [], [])
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, at, left, crossed, outer = text or "", 0, False, False, False
                for x in spans or ():
                    a, b = x["start_at"], x["end_at"]
                    left |= bool(text[at:a].strip())
                    crossed |= a < at or b <= a
                    outer |= text[a:b] != text[a:b].strip()
                    at = max(at, b)
                for kept, fault in zip(out, (left or bool(text[at:].strip()), crossed, outer), strict=True):
                    kept.append(int(fault))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["uncovered", "overlapping", "outer_space"])

    return df.mapInArrow(rows, "uncovered long, overlapping long, outer_space long")
