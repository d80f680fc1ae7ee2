"""Refusals by recurring templates, links of clusters against brute force, languages and copies."""

from __future__ import annotations

import random
import time

from lakelens.llm import qa_defects as Q

PHRASINGS = ["This topic is off limits here.", "That is beyond what my role covers.", "Non posso rispondere a questa domanda.", "Mir fehlt jede Befugnis, darüber zu sprechen."]
NOUNS = ["symbol table", "call graph", "stale snapshot", "diff hunk", "lock file", "quoted span"]
VERBS = ["loads", "drops", "groups", "validates", "caches", "reports"]
WHO = ["scanner", "indexer", "cache layer", "webhook handler", "chunk builder"]


def corpus(rng, n=900):
    def sentence():
        return f"The {rng.choice(WHO)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} before the {rng.choice(NOUNS)} {rng.choice(VERBS)} it."

    rows = []
    for k in range(n):
        rows.append((k, f"Why does the {rng.choice(WHO)} fail when the {rng.choice(NOUNS)} {rng.choice(VERBS)} in case {chr(97 + k % 26)}{chr(97 + k // 26)}?", " ".join(sentence() for _ in range(rng.randint(1, 3)))))
    return rows


def test_templates_that_recur_are_refusals_without_a_list_of_phrases(spark):
    rng = random.Random(1)
    rows = corpus(rng)
    ids = []
    for p in PHRASINGS:
        for _ in range(5):
            k = len(rows)
            rows.append((k, f"How many callers has handler {chr(97 + k % 26)}{chr(97 + (k // 26) % 26)}q?", p))
            ids.append(k)
    mixed = len(rows)
    rows.append((mixed, "What loads the lock file in zz?", PHRASINGS[0] + " The scanner loads the lock file before the diff hunk drops it."))
    yes = [len(rows) + k for k in range(6)]
    rows += [(k, f"Does it ever reload in case y{chr(97 + k % 26)}?", "Never.") for k in yes]
    got = {r.qa_id: r.defect for r in Q.defects(spark.createDataFrame(rows, "qa_id long, question string, answer_text string")).collect()}
    assert {k for k, d in got.items() if d == "refusal"} == set(ids)
    assert mixed not in got and not set(yes) & set(got)


def test_one_prompt_many_times_is_no_template(spark):
    rows = corpus(random.Random(2)) + [(10_000 + k, "How many callers has handler qq?", PHRASINGS[1]) for k in range(6)]
    got = Q.defects(spark.createDataFrame(rows, "qa_id long, question string, answer_text string")).collect()
    assert not [r for r in got if r.defect == "refusal"]


def test_words_of_all_templates_count_however_many_there_are(spark):
    """2,100 templates, each asked for thrice, and of each one phrasing met once that shares four of its five words."""

    def word(first, k):
        return first + "".join(chr(97 + k // 26**n % 26) for n in range(3))

    rows = []
    for k in range(2100):
        own = [word(c, k) for c in "klmnp"]
        for answer in (*[" ".join(own)] * 3, " ".join([*own[3::-1], word("q", k)]), " ".join([*own[2::-1], word("q", k), word("r", k)])):
            rows.append((len(rows), f"Why does handler {word('h', len(rows))} fail?", answer + "."))
    got = {r.qa_id: r.defect for r in Q.defects(spark.createDataFrame(rows, "qa_id long, question string, answer_text string")).collect()}
    assert got == {k: "refusal" for k in range(len(rows)) if k % 5 < 4}  # the last of five shares three words only


def test_clusters_keep_the_links_of_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(10)]
    texts = set()
    for _ in range(40):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(4):
            other = list(base)
            other[rng.choice([0, 59])] = rng.choice(words)
            texts.add(" ".join(other))
    texts = sorted(texts)
    sets = [Q.shingles(t) for t in texts]
    heads = {r.key: r["head"] for r in Q.clusters(spark.createDataFrame(list(enumerate(texts)), "key long, opening string")).collect()}
    links = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= Q.SIMILAR * len(sets[a] | sets[b])]
    assert links and sum(heads[a] == heads[b] for a, b in links) >= 0.9 * len(links)
    assert len(set(heads.values())) >= 40


def test_languages_in_pairs():
    assert Q.languages("¿Dónde se llama antes de la fusión?") and not Q.languages("¿Dónde se llama antes de la fusión?") & {"ru", "en", "de"}
    assert Q.languages(Q.prose("src/core/load.goで引用箇所を破棄する関数はどれですか？")) == {"ja"}
    assert Q.languages(Q.prose("`a_b()` src/core/x.py")) == set()


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        return row[-1]

    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert Q.common(a, b) == slow(a, b)
    start = time.process_time()
    Q.is_copy("why does this fail " * 1000, "why does that fail " * 1000)
    assert time.process_time() - start < 2
