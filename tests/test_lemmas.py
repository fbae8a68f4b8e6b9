"""Suffix detachment against plain Python."""

import random

from tagflow.operators import lemmas as lm
from tagflow.operators.tokens import tokenize_lemma

LEXICON = [("city", "NOUN", "city"), ("box", "NOUN", "box"), ("man", "NOUN", "man"), ("leaf", "NOUN", "leaf"), ("bus", "NOUN", "bus"),
           ("make", "VERB", "make"), ("walk", "VERB", "walk"), ("carry", "VERB", "carry"), ("go", "VERB", "go"), ("went", "VERB", "go"),
           ("nice", "ADJ", "nice"), ("cold", "ADJ", "cold"), ("walk", "NOUN", "walk")]
EXCEPTIONS = [("carried", "VERB", "carry"), ("geese", "NOUN", "goose"), ("better", "ADJ", "good"), ("went", "VERB", "never")]


def by_hand(form, entries, exceptions, rounds=2):
    if any(form == f for f, _, _ in entries):
        return {}
    known = {(lemma, pos) for _, pos, lemma in entries}
    out = {}
    for pos, rules in lm.RULES.items():
        odd = sorted((len(x), x) for f, p, x in exceptions if (f, p) == (form, pos))
        if odd:
            out[pos] = odd[0][1]
            continue
        words = [form]
        for _ in range(rounds):
            words = [(i, w[:len(w) - len(a)] + b) for w in words for i, (a, b) in enumerate(rules) if w.endswith(a) and len(w) > len(a)]
            hits = sorted((len(w), i, w) for i, w in words if (w, pos) in known)
            if hits:
                out[pos] = hits[0][2]
                break
            words = [w for _, w in words]
    return out


def test_detached_lemmas(spark):
    schema = "form string, pos string, lemma string"
    lex, odd = spark.createDataFrame(LEXICON, schema), spark.createDataFrame(EXCEPTIONS, schema)
    rng = random.Random(2)
    stems = [f for f, _, _ in LEXICON] + ["geese", "better", "citi", "leav", "mak", "carri", "nic", "xy", "s", ""]
    ends = ["", "s", "es", "ed", "ing", "er", "est", "ies", "men", "ves", "ings", "ses"]
    forms = sorted({rng.choice(stems) + rng.choice(ends) + rng.choice(["", "", "s"]) for _ in range(400)} | {"cities", "walks", "went"})
    df = spark.createDataFrame([(f,) for f in forms + forms[:5] + [None]], "form string")
    got = {}
    for r in lm.detached_lemmas(df, lex, odd).collect():
        assert r.pos not in got.setdefault(r.form, {})
        got[r.form][r.pos] = r.lemma
    want = {f: x for f in forms if (x := by_hand(f, LEXICON, EXCEPTIONS))}
    assert got == want
    assert want["cities"] == {"NOUN": "city"} and want["walks"] == {"NOUN": "walk", "VERB": "walk"} and "went" not in want
    assert lm.detached_lemmas(df.limit(0), lex).count() == 0 and lm.detached_lemmas(df, lex.limit(0)).count() == 0


def test_token_lists_with_an_extended_lexicon(spark):
    lex = spark.createDataFrame(LEXICON, "form string, pos string, lemma string")
    odd = spark.createDataFrame(EXCEPTIONS, "form string, pos string, lemma string")
    df = spark.createDataFrame([(1, "making boxes walks geese carried went nicest zzzing"), (2, "")], "id long, preprocessed string")
    forms = df.selectExpr("explode(split(preprocessed, ' ')) as form")
    got = {r.id: list(r.tokenized) for r in tokenize_lemma(df, stopwords=[], lexicon=lm.extend_lexicon(lex, forms, odd)).collect()}
    assert got == {1: ["make", "box", "walk", "goose", "carry", "nice", "zzzing"], 2: []}
