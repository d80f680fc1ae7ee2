"""Problem 6: broken prompt and response pairs.

Method: response openings are clustered by MinHash over word shingles, every link verified by
the exact similarity; templates that recur across unrelated prompts reveal refusals. What tells
a refusal from any sentence that happens to recur is learned from the corpus itself: its words
are foreign to what the answers talk about. A word is known if many distinct openings hold it;
a sentence is set apart if a large part of its words is not known. A pair is a refusal if all of
its answer's sentences are set apart and its opening belongs to a cluster that recurs across
unrelated prompts, or, where a phrasing is rare, if its words are those of such clusters. No list
of phrases takes part. Copies, languages and terminations are checked pair by pair and label the
rest. Each pair gets at most one defect: empty, copied, refusal, truncated, other_language, in
this order.

Openings are made distinct before their words are counted; the table of known words is bounded
(a word is known at FREQUENT of all distinct openings, so there are at most 1 / FREQUENT times the
mean number of words) and broadcast. Only openings set apart are clustered: signatures exist once
per distinct opening; a bucket is linked to its smallest member first, and only members that are
not connected by then are compared with each other, so every similar pair of a bucket ends in one
cluster; prompts are made distinct per cluster before they are counted. The words of all revealed
templates are a table, joined with the words of the answers set apart, each answer once; neither is
gathered in one place. The join back to the pairs is salted, so an answer that a third of all pairs
share is no hot task.

Defined cases: a null or blank answer is empty; a null question switches the copy and language
checks off; answers of few words have no language; repeated rows are labelled alike and
reported once; answers of one or two words are never set apart.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import kept, map_rows

PERMUTATIONS, BAND_ROWS, SHINGLE, SIMILAR, RECURS, SALTS = 64, 4, 5, 0.8, 3, 16
#: A word is known from this share of all distinct openings on (LEAST of them at least); a sentence of FEW words or more is set apart if this share of its words is not known.
FREQUENT, LEAST, FEW, APART = 1 / 2000, 8, 3, 0.4
SHARED = 0.7
PRIME = (1 << 61) - 1
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 1 << 31, PERMUTATIONS, dtype=np.uint64)
_B = _RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint64)

FENCE = re.compile(r"```[\s\S]*?```|~~~[\s\S]*?~~~")
INLINE = re.compile(r"`[^`\n]*`")
PATH = re.compile(r"(?<![\w@.-])[\w@.-]+(?:/[\w@.-]+)+(?::\d+)?|\b[\w-]+\.(?:py|js|ts|php|go|java|json|md|ya?ml|sh|ini)\b", re.A)
QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』|‹[^›\n]*›")
NAME = re.compile(r"\b\w+\(\)|\b[A-Za-z]+(?:_[A-Za-z0-9]+)+\b|\b[a-z]+(?:[A-Z][a-z0-9]+)+\b", re.A)
SENTENCE = re.compile(r"(?<=[.!?])[\s*_]+|(?<=[。！？])[\s*_]*|\n+")
ENDS = re.compile(r"(?:[.!?。！？।؟…]|:\s*```)[)\]}\"'”’»」』*_`~>]*\Z")
ITEM = re.compile(r"\s*(?:[-*•+]|\d+[.)])(?:\s|\Z)")
# fixed values: what stands for no answer
NOTHING = set("n/a na none null nil undefined nan - -- --- ... … . ? tbd todo empty".split()) | {""}
DRESSED = re.compile(r"(?:you (?:asked|wrote|want)|the question|your question|question|sie frag|ihre frage|die frage|frage|vous (?:avez )?demand|la question|votre question|(?:su|tu|la) pregunta|pregunta|(?:sua|a) pergunta|pergunta|вы спро|ваш вопрос|вопрос|问题|質問|ご質問|asked|repeat)", re.I)
# fixed values: frequent words by language
STOPWORDS = {
    "en": "the a an of is are was were because when where which what why how if does not this that each every it in on for with without before after our under during once per so and or cannot can't there never yes by to from has have had be been i you here",
    "de": "der die das den dem des ein eine einen einem einer ist sind nicht und oder weil denn wenn wird werden im in auf für mit ohne vor nach unter jeden jede alle kann können wo warum welche welcher wie dabei ich hier zu von als auch sich mir keine kein nie ja nein zum zur beim",
    "fr": "le la les l d un une des du de et ou est sont ne pas car que qui quoi dans sur sous pour avec sans avant après chaque par où pourquoi quelle quel comment il elle ce cette se je vous au aux en oui non jamais si lorsque quand peut",
    "es": "el la los las un una unos unas de del y o es son no porque que qué cuando cuándo dónde donde por para con sin antes después cada en se lo su al cómo cuál si sí nunca puede esto está yo usted",
    "pt": "o a os as um uma uns umas de do da dos das e ou é são não porque que quando onde por para com sem antes depois cada em no na nos nas se ao à como qual sim nunca pode isto está eu você sob",
}
STOP = {k: set(v.split()) for k, v in STOPWORDS.items()}
MARKS = {"de": "ßäöü", "fr": "èêàçœùûîôâ", "es": "ñ¿¡", "pt": "ãõ"}
WORD = re.compile(r"[^\W\d_]+")
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1780-\u17ff\u1000-\u109f\u3040-\u30ff\u3400-\u9fff]")
WORDS = 200_000  # words that a task counts before it hands them on


def answer_of(raw: str | None) -> tuple[str, bool]:
    """The answer's text, and whether it is JSON that stops inside."""
    t = (raw or "").strip("﻿ \t\r\n")
    if t.startswith("{") and ('"sections' in t or '"section' in t or t.startswith('{"sec')):
        try:
            o = json.loads(t)
        except ValueError:
            return t, True
        parts = o.get("sections") if isinstance(o, dict) else None
        if isinstance(parts, list):
            texts = [p.get("text") if isinstance(p, dict) else p for p in parts]
            return "\n\n".join(x for x in texts if isinstance(x, str)), False
    elif t[:1] in "{[" and len(t) > 2 and '"' in t:
        try:
            json.loads(t)
        except ValueError:
            return t, t[0] == "{" and re.match(r"\{\s*\"[^\"]*\"?\s*:?", t) is not None
    return t, False


def visible(text: str) -> str:
    """Letters and digits, folded: what is left of a text without its dress."""
    t = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c for c in t if c.isalnum())


def is_empty(text: str) -> bool:
    t = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc", "Zs", "Zl", "Zp") or c == "\n").strip()
    bare = re.sub(r"```\w*|[`*_#>~|\"'{}\[\](),:;\s]+", "", t).casefold()
    return bare in NOTHING or not any(c.isalnum() for c in bare)


def is_copy(question: str | None, text: str) -> bool:
    """Only the question again, however dressed or spelled."""
    q, a = visible(question or ""), visible(text)
    if len(q) < 6 or not a:
        return False
    k = a.rfind(q)
    if k >= 0:
        before, after = a[:k].replace(q, ""), a[k + len(q) :]
        if len(after) <= 1 and (len(before) <= 24 or DRESSED.search(text) and len(before) <= 60):
            return True
        if len(after) <= 40 and len(before) <= 40 and DRESSED.search(text[-80:]) and len(after) < len(q) and not re.search(r"[.!?。！？]\s*\S+\s+\S+\s+\S+\s+\S+\s+\S+", text.rstrip()[-len(after) - 20 :]):
            return True
        return False
    if not 0.75 * len(q) <= len(a) <= 1.35 * len(q) + 24:
        return False
    same = common(q, a)
    return same >= 0.9 * len(q) and len(a) - same <= max(4, 0.15 * len(q)) or same >= 0.94 * len(q) and bool(DRESSED.search(text)) and len(a) - same <= 24


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit a character: as many steps as b is long."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def prose(text: str, quotes: bool = True) -> str:
    """The text without code, paths, names and (if asked) quotations."""
    t = INLINE.sub(" ", FENCE.sub(" ", text))
    t = NAME.sub(" ", PATH.sub(" ", t))
    return QUOTED.sub(" ", t) if quotes else t


def languages(text: str, least: int = 3) -> set[str]:
    """Languages that prose may be in, by script and frequent words: those not clearly beaten by another; none if there is too little to tell."""
    kana = han = cyr = thai = latin = other = 0
    for c in text:
        o = ord(c)
        if o < 0x250:
            latin += c.isalpha()
        elif 0x3040 <= o <= 0x30FF:
            kana += 1
        elif 0x4E00 <= o <= 0x9FFF:
            han += 1
        elif 0x400 <= o <= 0x52F:
            cyr += 1
        elif 0xE00 <= o <= 0xE7F:
            thai += 1
        elif c.isalpha():
            other += 1
    cjk = kana + han
    if cjk * 2 > latin and cjk >= max(cyr, thai, other) and cjk >= 2:
        return {"ja"} if kana * 8 >= cjk else {"zh"}
    if cyr > latin and cyr >= 4:
        return {"ru"}
    if thai > latin and thai >= 4:
        return {"th"}
    words = [w.casefold() for w in WORD.findall(text)]
    if len(words) < least:
        return set()
    score = {k: sum(w in s for w in words) + 0.7 * sum(any(c in MARKS.get(k, "") for c in w) for w in words) for k, s in STOP.items()}
    best = max(score.values())
    if best >= 2:
        return {k for k, v in score.items() if best < 1.25 * v + 0.5}
    return {k for k, v in score.items() if v == best} if best >= 1 and sum(v > 0 for v in score.values()) == 1 else set()


def is_truncated(text: str) -> bool:
    """Does the answer stop inside a sentence, list, code block or JSON value?"""
    t = text.rstrip()
    if len(re.findall(r"^[ \t]*(?:```|~~~)", t, re.M)) % 2:
        return True
    if re.search(r"(?:```|~~~)\Z", t):
        return False
    last = t.rpartition("\n")[2]
    outside = FENCE.sub(" ", t)
    if outside.count("`") % 2:
        return True
    if ITEM.match(last):
        rest = ITEM.sub("", last, count=1).strip()
        if not rest:
            return True
        if INLINE.fullmatch(rest.rstrip(".;")) or ENDS.search(rest) or PATH.fullmatch(rest):
            return False
        items = [ITEM.sub("", x, count=1).strip() for x in t.split("\n") if ITEM.match(x)]
        return bool(items[:-1]) and all(ENDS.search(x) for x in items[:-1]) or bool(re.search(r"[,:;(\[{]\Z", rest)) or len(items) == 1
    if ENDS.search(t):
        return False
    bare = t.strip("*_` \t()\"'")
    if PATH.fullmatch(bare) or NAME.fullmatch(bare) or re.fullmatch(r"[\w.:/()#-]+", bare) and (not bare.isalpha() or bare.isascii() and len(bare) > 1 and t.strip() != bare) or re.fullmatch(r"`[^`]*`", t.strip()):
        return False
    if bare.isdigit() or last.lstrip().startswith(("|", "#", ">")) and "\n" in t:
        return not bare.isdigit() and not last.rstrip().endswith("|") and last.lstrip().startswith("|")
    return True


def masked(sentence: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", sentence)).strip().casefold()


def sentences_of(text: str) -> list[str]:
    """Sentences with names, paths and numbers masked."""
    t = INLINE.sub(" X ", FENCE.sub(" ", text).strip().strip("*_#> "))
    t = NAME.sub(" X ", PATH.sub(" X ", t))
    return [masked(x) for x in SENTENCE.split(t) if any(c.isalnum() for c in x)]


def opening_of(text: str) -> str:
    """The first sentence."""
    got = sentences_of(text)
    return got[0] if got else ""


def units(sentence: str) -> set[str]:
    """Words; pairs of characters where words are not set apart."""
    out = set()
    for w in WORD.findall(sentence):
        if UNSPACED.match(w):
            out.update(w[k : k + 2] for k in range(max(1, len(w) - 1)))
        elif w != "x":
            out.add(w)
    return out


def set_apart(own: set[str], known: set[str]) -> bool:
    return len(own) >= FEW and sum(u not in known for u in own) >= APART * len(own)


def _openings():
    def one(question, raw):
        text = answer_of(raw)[0]
        opening = opening_of(text)
        if opening and not is_copy(question, text):
            yield (opening,)

    return one


def _counted(batches):
    """In how many openings of a task each word stands."""
    import pyarrow as pa

    def out():
        return pa.RecordBatch.from_pydict({"unit": list(counts), "n": list(counts.values())}, pa.schema([("unit", pa.string()), ("n", pa.int64())]))

    counts: Counter = Counter()
    for b in batches:
        for opening in b.column(0).to_pylist():
            counts.update(units(opening))
        if len(counts) > WORDS:
            yield out()
            counts.clear()
    if counts:
        yield out()


def known_words(pairs: DataFrame) -> frozenset[str]:
    """Words that many distinct openings hold. Their number is bounded, see the head of this module."""
    openings = kept(map_rows(pairs.select("question", "answer_text"), _openings, "opening string").distinct())
    least = max(LEAST, FREQUENT * openings.count())
    counts = openings.mapInArrow(_counted, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return frozenset(r["unit"] for r in counts.where(F.col("n") > least).select("unit").collect())


LOCAL = "qa_id long, first string, second string, opening string, prompt long, words array<string>"


def _local(known):
    def make():
        words = known.value

        def one(qa_id, question, raw):
            text, broken = answer_of(raw)
            if not broken and is_empty(text):
                yield qa_id, "empty", None, None, None, None
                return
            if not broken and is_copy(question, text):
                yield qa_id, "copied", None, None, None, None
                return
            second = None
            if broken or is_truncated(text):
                second = "truncated"
            else:
                q, a = languages(prose(question or "")), languages(prose(text))
                if q and a and not q & a:
                    second = "other_language"
            opening, own = None, None
            if not broken:
                parts = sentences_of(text)
                each = [units(x) for x in parts]
                if parts and all(set_apart(u, words) or k and len(x) < 12 for k, (x, u) in enumerate(zip(parts, each, strict=True))):
                    opening, own = parts[0], sorted({u for e in each for u in e if u not in words})
            if second or opening:
                yield qa_id, None, second, opening, digest(opening_of(question or "").encode()), own

        return one

    return make


def digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


def shingles(text: str) -> set[int]:
    """Hashes of word shingles; of character shingles where words are not set apart."""
    words = text.split()
    units = words if len(words) >= 3 or text.isascii() else [c for c in text if not c.isspace()]
    if len(units) <= SHINGLE:
        return {zlib.crc32(" ".join(units).encode())}
    return {zlib.crc32(" ".join(units[k : k + SHINGLE]).encode()) for k in range(len(units) - SHINGLE + 1)}


def _signatures():
    def one(key, opening):
        own = np.fromiter(shingles(opening), np.uint64)
        sig = ((own[:, None] * _A + _B) % np.uint64(PRIME)).min(axis=0)
        for b in range(PERMUTATIONS // BAND_ROWS):
            band = bytes([b]) + sig[b * BAND_ROWS : (b + 1) * BAND_ROWS].tobytes()
            yield digest(band), key

    return one


def _verified():
    def one(key, other, opening, text):
        a, b = shingles(opening), shingles(text)
        if len(a & b) >= SIMILAR * len(a | b):
            yield key, other

    return one


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (key, other) whose openings are similar enough, by the exact measure."""
    both = pairs.join(texts, "key").join(texts.select(F.col("key").alias("other"), F.col("opening").alias("text")), "other").select("key", "other", "opening", "text")
    return map_rows(both, _verified, "key long, other long")


def components(links: DataFrame) -> DataFrame:
    """key and head, the smallest key that can be reached from it, of each key with a link. One round of joins a step of the longest way."""
    both = links.unionAll(links.select(F.col("other").alias("key"), F.col("key").alias("other")))
    both = kept(both.distinct())
    heads = kept(both.groupBy("key").agg(F.least("key", F.min("other")).alias("head")))
    while True:
        near = both.join(heads.select(F.col("key").alias("other"), F.col("head").alias("near")), "other").groupBy("key").agg(F.min("near").alias("near"))
        new = kept(heads.join(near, "key").select("key", F.least("head", "near").alias("head"), (F.col("near") < F.col("head")).alias("moved")))
        heads = new.drop("moved")
        if new.where("moved").isEmpty():
            return heads


def clusters(openings: DataFrame) -> DataFrame:
    """openings(key, opening), each once -> key and head of its cluster. Buckets carry keys; texts are fetched for linked openings only."""
    bands = kept(map_rows(openings, _signatures, "bucket long, key long"))
    least = bands.groupBy("bucket").agg(F.min("key").alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = kept(verified(bands.join(least, "bucket").where("key <> other").select("key", "other").distinct(), openings))
    headed = bands.join(components(first), "key", "left").withColumn("head", F.coalesce("head", "key"))
    split = headed.groupBy("bucket").agg(F.min("head").alias("low"), F.max("head").alias("high")).where("low < high").select("bucket")
    apart = headed.join(split, "bucket")
    others = apart.select("bucket", F.col("key").alias("other"), F.col("head").alias("far"))
    rest = apart.join(others, "bucket").where("key < other AND head <> far").select("key", "other").distinct()
    heads = components(first.unionAll(verified(rest, openings)))
    return openings.select("key").join(heads, "key", "left").select("key", F.coalesce("head", "key").alias("head"))


def templates(apart: DataFrame) -> DataFrame:
    """key and opening of the clusters that recur across unrelated prompts."""
    asked = kept(apart.select("opening", "prompt").distinct().withColumn("key", F.xxhash64("opening")))
    openings = kept(asked.groupBy("key").agg(F.min("opening").alias("opening")))
    heads = kept(clusters(openings))
    recurring = asked.join(heads, "key").select("head", "prompt").distinct().groupBy("head").agg(F.count(F.lit(1)).alias("prompts")).where(f"prompts >= {RECURS}")
    return kept(openings.join(heads.join(recurring, "head", "left_semi"), "key", "left_semi"))


def _foreign(known):
    def make():
        words = known.value

        def one(opening):
            return ((u,) for u in units(opening) if u not in words)

        return one

    return make


def refusals(apart: DataFrame, found: DataFrame, known) -> DataFrame:
    """apart(key, opening, words), each once -> keys of those that begin with a template found or share their words with all templates. Words are many more than answers, which the optimizer does not foresee: their join is told to sort."""
    shared = map_rows(found.select("opening"), _foreign(known), "word string").distinct()
    spread = apart.select("key", F.size("words").alias("n"), F.explode("words").alias("word")).hint("merge")
    worded = spread.join(shared, "word").groupBy("key", "n").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= SHARED * F.col("n"))
    return apart.join(found, "opening", "left_semi").select("key").unionAll(worded.select("key")).distinct()


def defects(pairs: DataFrame) -> DataFrame:
    """qa_id and defect of each defective pair."""
    known = pairs.sparkSession.sparkContext.broadcast(known_words(pairs))
    local = kept(map_rows(pairs.select("qa_id", "question", "answer_text"), _local(known), LOCAL))
    found = templates(local.where("opening IS NOT NULL"))
    keyed = local.withColumn("key", F.when(F.col("opening").isNotNull(), F.sha2(F.concat_ws("\n", "opening", "words"), 256)))
    apart = keyed.where("key IS NOT NULL").select("key", "opening", "words").distinct()
    salted = refusals(apart, found, known).select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit("refusal").alias("refusal")).hint("merge")
    both = keyed.select("qa_id", "first", "second", "key", F.pmod(F.xxhash64("qa_id"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["key", "salt"], "left")
    return both.select("qa_id", F.coalesce("first", "refusal", "second").alias("defect")).where("defect IS NOT NULL").distinct()
