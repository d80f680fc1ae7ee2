"""Problem 9: sentences of every document, in many languages and scripts, with their places.

Method: a pushdown automaton. Lines first give the block structure (blank lines, headings, list
items, fenced code); inside a paragraph one pass over the marks keeps a stack of open
quotations and brackets. A terminator ends a sentence only when the stack is empty, the word
before a full stop is not one of the abbreviations in the trie, and what follows can start a
sentence in that script. Opening marks without a closing one in their paragraph are not pushed,
so a lost mark cannot swallow the rest. Offsets are code points. One map over the rows.

Defined cases: null, empty and blank texts give no rows; a text without any terminator is one
sentence per paragraph; an unclosed fence runs to the end; repeated rows give repeated rows
in sentences and each row once in sentence_places; texts are taken whole, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import map_rows

# fixed values: abbreviations after which a sentence goes on (any case), written without their last full stop
GO_ON = """
dr mr mrs ms prof rev hon st gen col sgt capt lt fig figs sec secs ch chap chaps pp p pg vol vols ed eds no nos cf vs viz approx ca e.g i.e al incl excl resp ref refs eq eqs app art dept est max min avg misc tel ext rel par para
jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun
nr abb abs bzw vgl evtl ggf z z.b d.h u.a s.o s.u kap hrsg bd str tab anm mind zzgl inkl exkl geb gest sog ff o.ä u.u i.d.r z.t bspw
m mm mme mlle janv févr avr juil déc n env av boul éd cf. p.ex p.ej
sr sra srta dra ud uds vd ee uu pág págs núm cap ap c.f aprox ej ex fig. tel. art. depto av. n.º
г гг см рис стр гл табл напр им ул тыс млн млрд руб проф акад д.т.н т.е т.к т.н ср ст п пп кв
डॉ श्री श्रीमती पं प्रो कु द د أ م ص
m.sc b.sc ph.d m.a b.a d.phil u.s e.u u.k u.n j.d
"""
# fixed values: abbreviations that may also end a sentence
MAY_END = "etc usw uam ltd inc co corp bros jr llc gmbh p.m a.m др пр т.д т.п д.д ecc usf"
#: Terminators that end a sentence whatever the word before them: ideographic, Indic, Arabic, Urdu, Ethiopic, Armenian, Burmese, Khmer, Tibetan and others.
HARD = "。！？।॥؟۔።፧։။។៕｡．‼⁇⁈⁉᠃᠉꓿།༎"
TERMS = ".!?…" + HARD
CLOSERS = ")]}\"'”’»›」』）】》*_"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "“": "”", "«": "»", "‹": "›", "„": "“"}
QUOTES = set("“„«‹「『\"")
EVENT = re.compile(r"`[^`\n]*`|\]\([^)\s]*\)|https?://[^\s<>\"」”]*[^\s<>\"」”.,;:!?。)]|[.!?…" + HARD + r"]+|[()\[\]{}（）【】「」『』《》“”„«»‹›\"]|[  \t]+(?=[ก-ๅ็-๛])")
FENCE = re.compile(r"[ \t]{0,3}(```+|~~~+)")
HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t\xa0]|$)")
ITEM = re.compile(r"[ \t]*(?:[-*+•‣◦–]|\(?\d{1,3}[.)])[ \t\xa0]+(?=\S)")
LAST_WORD = re.compile(r"(?:[^\W_]+\.)*[^\W_]+\Z|[^\W_][\wऀ-ॿ]*\Z")
# fixed values: months that may follow a day with a full stop
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez jänner januar".split())
JA_GOES_ON = set("とはがをにもでのや、，って")
ZH_GOES_ON = re.compile(r"这是|这|是|审|他|她|它|说|道|问|写|的|表示|，|、|为|在.{0,12}里")
HI_GOES_ON = re.compile(r"यह टिप्पणी|यह|कह|लिख|पूछ|ने|का|की|के|ऐसा")
THAI = re.compile("[ก-๛]")
CAPS_WORD = re.compile(r"[A-Z]{2,5}\b")


class Trie(dict):
    """Abbreviations read backwards from the full stop."""

    def add(self, word: str, value: int) -> None:
        node = self
        for c in reversed(word):
            node = node.setdefault(c, {})
        node["end"] = value

    def find(self, text: str, end: int) -> tuple[int, int]:
        """Value and length of the longest entry that ends before `end` and starts at a word's start; (0, 0) if none."""
        node, k, got = self, end - 1, (0, 0)
        while k >= 0:
            c = text[k]
            node = node.get(c.lower() if c not in node else c)
            if node is None:
                break
            if "end" in node and (k == 0 or not (text[k - 1].isalnum() or text[k - 1] in "._-/" or "ऀ" <= text[k - 1] <= "ॿ")):
                got = (node["end"], end - k)
            k -= 1
        return got


ABBREVIATIONS = Trie()
for _value, _list in ((1, GO_ON), (2, MAY_END)):
    for _w in _list.split():
        for _form in {_w.rstrip("."), unicodedata.normalize("NFD", _w.rstrip("."))}:
            ABBREVIATIONS.add(_form, _value)


def blocks(text: str) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, kind, end of the item's mark): `unit` is one unit, `text` is to be segmented."""
    at, n = 0, len(text)
    open_from, mark, fence, fence_from = -1, 0, "", -1
    while at <= n:
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        line = text[at:stop]
        if fence:
            m = FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line[m.end() :].strip():
                yield fence_from, stop, "unit", 0
                fence = ""
        else:
            kind = None
            m = FENCE.match(line)
            if m:
                kind = "fence"
            elif not line.strip():
                kind = "blank"
            elif HEADING.match(line):
                kind = "heading"
            else:
                i = ITEM.match(line)
                if i:
                    kind = "item"
            if kind and open_from >= 0:
                yield open_from, at, "text", mark
                open_from = -1
            if kind == "fence":
                fence, fence_from = m[1], at
            elif kind == "heading":
                yield at, stop, "unit", 0
            elif kind == "item":
                open_from, mark = at, at + i.end()
            elif kind is None and open_from < 0:
                open_from, mark = at, at
        if stop == n:
            break
        at = stop + 1
    if fence:
        yield fence_from, n, "unit", 0
    elif open_from >= 0:
        yield open_from, n, "text", mark


def pairs_of(events: list[tuple[int, str]], text: str, a: int, b: int) -> dict[int, int]:
    """Opening mark -> closing mark, both by offset; marks without a partner are left out."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}  # closing marks that are waited for, so that a stack without one is not searched

    def cut(k: int) -> None:
        for mark, _ in stack[k:]:
            held[PAIRS.get(mark, mark)] -= 1
        del stack[k:]

    def push(mark: str, at: int) -> None:
        stack.append((mark, at))
        held[PAIRS.get(mark, mark)] = held.get(PAIRS.get(mark, mark), 0) + 1

    for at, e in events:
        if e == '"':
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), -1) if held.get(e) else -1
            before = text[at - 1] if at > a else " "
            if k >= 0:
                out[stack[k][1]] = at
                cut(k)
            elif not before.isalnum() or ord(before) > 0x2E7F:
                push(e, at)
            continue
        k = next((k for k in range(len(stack) - 1, -1, -1) if PAIRS.get(stack[k][0]) == e), -1) if held.get(e) else -1
        if k >= 0 and not (e == "“" and stack[k][0] != "„"):
            out[stack[k][1]] = at
            cut(k)
        elif e in PAIRS:
            push(e, at)
    return out


def cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "一" <= c <= "鿿" or "㐀" <= c <= "䶿" or "　" <= c <= "〿" or "＀" <= c <= "￯"


def starts_sentence(c: str, lowered: bool) -> bool:
    """Can a sentence start with this character behind a full stop and white space?"""
    if c.islower():
        return True
    return c not in ",;:)]}»”’—–-=+/|"


def stop_ends(text: str, a: int, at: int, end: int, nxt: int, b: int, lowered: bool) -> bool:
    """Does the full stop at `at` (its closing marks end at `end`) end a sentence, given that `nxt` is the next visible place?"""
    c = text[nxt]
    if nxt == end and not cjk(c):
        return False
    if not starts_sentence(c, lowered):
        return False
    upper = c.isupper() or c in "`\"“„«¿¡[(*" or c.isdigit() or not (c.islower() or c.isupper())
    value, size = ABBREVIATIONS.find(text, at)
    k = at - 1
    if value:
        word = text[at - size : at]
        if word.lower() in ("ex", "ej") and re.search(r"(?i)\bp\.\s*\Z", text[max(a, at - size - 4) : at - size]):
            return False
        if word.lower() in ("no", "nos", "art", "app", "min", "max", "sec", "mar", "sat", "sun", "mon", "dec", "ex", "ap", "ed", "ref", "m", "n", "p", "s", "п", "ст", "al", "par", "str", "st", "ext", "est", "tab", "c", "c.f", "ch", "ff", "av"):
            if word.lower() in ("m",):
                return not (c.isupper() and word == "M" or c.islower())
            if word.lower() == "ff":
                return c.isupper()
            if word.lower() == "al":
                return c.isupper() and text[max(a, at - 6) : at].lower().find("et al") < 0
            if word.lower() in ("p", "n", "c", "s"):
                return _unit(text, a, at - size) and upper and not c.isdigit()
            return not c.isdigit() if word.lower() in ("no", "nos", "art", "app", "par", "ref", "ed", "ch", "ex", "ap", "tab", "п", "ст", "str", "st", "ext", "est", "sec", "min", "max", "av") and word.islower() else not (c.isdigit() or c.isupper() and word[0].isupper())
        if word.lower() in ("г", "гг"):
            return _unit(text, a, at - size) and c.isupper()
        if word.lower() in ("uu", "ee"):
            return False
        if value == 1:
            return False
        if word.lower() in ("p.m", "a.m"):
            return (c.isupper() or lowered) and not CAPS_WORD.match(text, nxt) and not text[nxt : nxt + 3].lower() in ("utc", "cet", "est", "pst", "gmt") or c in "`\"“("
        return upper or lowered
    if k >= a and text[k].isalpha() and (k == a or not (text[k - 1].isalnum() or text[k - 1] in "_`")):  # one letter
        letter = text[k]
        if text[k - 1 : k] == "." and k - 2 >= a and text[k - 2].isalpha():
            return False  # dotted letters, as in U.S.
        parts = text[max(a, k - 3) : at].replace("\n", " ").lower()
        if parts[-4:] in ("z. b", "d. h", "u. a", "т. е", "т. к", "т. н", "s. o", "i. d", "z. t"):
            return False
        if parts[-4:] in ("т. д", "т. п"):
            return upper or lowered
        if letter in "дтзи" and c.islower() and len(text[nxt : nxt + 2].rstrip(". ")) == 1:
            return False
        if letter.lower() in "tzdтdu" and re.match(r"[\w]\.", text[nxt : nxt + 2]):
            return False
        if not _unit(text, a, k) and (letter.isupper() or lowered) and "A" <= letter.upper() <= "Z" and (c.isupper() or lowered or c in "<[" or not c.isprintable()):
            return False
    if text[k : k + 1].isdigit():
        m = re.search(r"(?:^|[\s(])(\d{1,2})\Z", text[max(a, at - 4) : at])
        if m:
            w = re.match(r"[^\W\d_]+", text[nxt : nxt + 12])
            if w and w.group().lower() in MONTHS and re.search(r"(?i)(?:\b(?:am|vom|zum|bis|seit|ab|dem|der|den|des|und)\s+)\d{1,2}\Z", text[max(a, at - 10) : at]):
                return False
            if c.islower() and not lowered:
                return False
    return True


def _unit(text: str, a: int, k: int) -> bool:
    """Does a number stand right before the word at k?"""
    j = k - 1
    while j >= a and text[j] in "  ":
        j -= 1
    return j >= a and text[j].isdigit()


def quote_ends(text: str, inner: str, nxt: int, end: int, lowered: bool) -> bool:
    """Does a sentence end at a closing mark whose inside ended with the terminator `inner`?"""
    c = text[nxt]
    if c in ",;:—–-)]}、，；：":
        return False
    if cjk(c) or inner in "。！？":
        if "぀" <= c <= "ゟ" and c in JA_GOES_ON:
            return False
        if "一" <= c <= "鿿" and text[end - 1] in "”’\"》" and (inner in "！？!?" or ZH_GOES_ON.match(text, nxt)):
            return False
        return True
    if "ऀ" <= c <= "ॿ":
        return not (inner in "!?" or HI_GOES_ON.match(text, nxt))
    if nxt == end:
        return False
    if c.islower():
        return False
    return True


def segment(text: str, a: int, b: int, mark: int, lowered: bool) -> Iterator[tuple[int, int]]:
    """Sentences of one paragraph or list item."""
    events = [(m.start(), m.group()) for m in EVENT.finditer(text, max(a, mark), b)]
    closing = pairs_of([x for x in events if len(x[1]) == 1 and x[1] not in TERMS], text, a, b)
    opening = {v: k for k, v in closing.items()}
    start, until, depth, first = a, -1, 0, max(a, mark)
    for at, e in events:
        if at < until:
            continue
        c = e[0]
        if c in "`" or e.startswith(("](", "http")):
            if e.startswith("](") and at in opening:
                depth -= 1
            continue
        if at in closing:
            depth += 1
            continue
        if at in opening:
            depth = max(0, depth - 1)
            if depth:
                continue
            k = at - 1
            while k > start and text[k] in "   *_":
                k -= 1
            inner = text[k]
            if inner not in TERMS:
                continue
            end = at + 1
            while end < b and text[end] in CLOSERS and end not in closing and not (text[end] in "*_" and end + 1 < b and text[end + 1].isalnum()):
                end += 1
            nxt = end
            while nxt < b and text[nxt].isspace():
                nxt += 1
            if nxt >= b or text[end] in TERMS:
                continue
            whole = opening[at] <= first_visible(text, start, first)
            if text[opening[at]] in QUOTES:
                if not quote_ends(text, inner, nxt, end, lowered):
                    continue
                if inner == "." and text[nxt].islower():
                    continue
            elif not whole or text[nxt].islower() or nxt == end:
                continue
            yield start, end
            start = nxt
            first = nxt
            until = end
            continue
        if c in "  \t":
            if depth == 0 and at > first and _thai_gap(text, at, at + len(e), start):
                yield start, at
                start = first = at + len(e)
            continue
        if c not in TERMS or depth:
            continue
        end = at + len(e)
        while end < b and (text[end] in CLOSERS and end not in closing and not (text[end] in "*_" and end + 1 < b and text[end + 1].isalnum())):
            end += 1
        nxt = end
        while nxt < b and text[nxt].isspace():
            nxt += 1
        if nxt >= b:
            break
        d = text[nxt]
        if at == first_visible(text, start, first) and c == ".":
            continue
        if e == ".":
            ok = stop_ends(text, max(a, mark), at, end, nxt, b, lowered)
        elif c == "．" and text[at - 1 : at].isdigit() and d.isdigit():
            ok = False
        elif c in HARD or c in "!?" and at > a and (cjk(text[at - 1]) or nxt > end) or c == "…" and len(e) > 1 and nxt == end:
            ok = d not in ",;，、；：:" and not (c in "!?！？" and d in "—–") and not (c == "…" and d in JA_GOES_ON)
            if ok and c in "!?" and nxt == end and not cjk(d):
                ok = False
        elif c == "…" or e.startswith(".."):
            tail = e.strip(".…")
            ok = nxt > end and (not d.islower() or bool(tail) or lowered and c == "…") and d not in ",;:)—–" or cjk(d) and at > a and cjk(text[at - 1])
        else:
            ok = nxt > end and d not in ",;:"
        if ok:
            yield start, end
            start = first = nxt
            until = end
    yield start, b


def first_visible(text: str, start: int, first: int) -> int:
    k = max(start, first)
    while k < len(text) and (text[k].isspace() or text[k] in "*_"):
        k += 1
    return k


def _thai_gap(text: str, at: int, nxt: int, start: int) -> bool:
    """Is the blank at `at`, before a Thai letter, the end of a Thai sentence?"""
    p = text[at - 1]
    if "ก" <= p <= "๛":
        return True
    return p in "`)\"”'’»]%…!?" or p.isdigit() and THAI.search(text, start, at) is not None


def is_lowered(text: str) -> bool:
    """Prose whose sentences all start in lower case: capitals say nothing there."""
    prose = re.sub(r"```[\s\S]*?(?:```|\Z)|`[^`\n]*`", " ", text)
    return not any(c.isupper() for w in prose.split() if "/" not in w and "_" not in w for c in w)


def sentences_of(text: str | None) -> list[tuple[int, int]]:
    """Places of the sentences of a text, without surrounding white space."""
    if not text or not text.strip():
        return []
    lowered = is_lowered(text)
    out = []
    for a, b, kind, mark in blocks(text):
        for s, e in [(a, b)] if kind == "unit" else segment(text, a, b, mark, lowered):
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if e > s:
                out.append((s, e))
    return out


def _splitter(with_text: bool):
    def make():
        def one(doc_id, text):
            for k, (s, e) in enumerate(sentences_of(text)):
                yield (doc_id, k, s, e, text[s:e]) if with_text else (doc_id, s, e)

        return one

    return make


def sentences(documents: DataFrame) -> DataFrame:
    """Every sentence with its number, place and text."""
    return map_rows(documents.select("doc_id", "text"), _splitter(True), "doc_id long, sentence_no int, start_pos long, end_pos long, text string")


def sentence_places(documents: DataFrame) -> DataFrame:
    return map_rows(documents.select("doc_id", "text"), _splitter(False), "doc_id long, start_pos long, end_pos long").distinct()


#: What counts as white space, as a class that regular expressions of all engines know.
BLANKS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def covered(documents: DataFrame) -> DataFrame:
    """doc_id, number of visible characters in its sentences, and whether these are in order, apart and without white space around them."""
    w = Window.partitionBy("doc_id").orderBy("sentence_no")
    s = sentences(documents).withColumn("before", F.lag("end_pos").over(w))
    good = (F.col("before").isNull() | (F.col("before") <= F.col("start_pos"))) & (F.char_length("text") == F.col("end_pos") - F.col("start_pos")) & ~F.col("text").rlike(f"^{BLANKS}|{BLANKS}$")
    return s.groupBy("doc_id").agg(F.sum(F.char_length(F.regexp_replace("text", BLANKS, ""))).alias("visible"), F.bool_and(good).alias("is_apart"))
