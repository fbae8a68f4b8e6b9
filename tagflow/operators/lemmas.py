"""Lemmas of forms that a lexicon lacks: ordered suffix detachment.

A form that is not in the lexicon loses a suffix by the rules of a word class;
what is left counts if the lexicon has it as a lemma of that class.  Exceptions
(``form, pos, lemma``) come first and need no lexicon.  If no rule gives a known
word, the rules are applied again to what they gave, ``rounds`` times in all.  Of
the known words of a round the shortest is taken, then that of the earliest rule.

The forms are distinct words and their candidates meet the lexicon in one
equi-join on (candidate, class), so the work grows with the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The detachment rules of English word classes, in order.
RULES = {
    "NOUN": [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
             ("men", "man"), ("ies", "y")],
    "VERB": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
    "ADJ": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
}


def _detach(rows: DataFrame, rules: dict, step: int) -> DataFrame:
    """``(form, pos, step, place, lemma)`` for each rule that fits ``lemma``; ``pos`` null takes the rules of all classes."""
    lemma, pos = F.col("lemma"), F.col("pos")
    fits = [F.when((pos.isNull() | (pos == kind)) & lemma.endswith(suffix) & (F.length(lemma) > len(suffix)),
                   F.struct(F.lit(kind).alias("pos"), F.lit(place).alias("place"),
                            F.concat(F.substring(lemma, F.lit(1), F.length(lemma) - len(suffix)), F.lit(new)).alias("lemma")))
            for kind, of_kind in rules.items() for place, (suffix, new) in enumerate(of_kind)]
    got = rows.select("form", F.explode(F.filter(F.array(*fits), lambda x: x.isNotNull())).alias("x"))
    return got.select("form", "x.pos", F.lit(step).alias("step"), "x.place", "x.lemma")


def detached_lemmas(forms: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None,
                    rules: dict = RULES, rounds: int = 2, col: str = "form") -> DataFrame:
    """``(form, pos, lemma)``: one row per form without an entry and class in which it has a known lemma.

    ``lexicon`` and ``exceptions`` have ``(form, pos, lemma)``.  Null and
    repeated forms count once or not at all.
    """
    known = lexicon.select("form").distinct()
    unknown = (forms.select(F.col(col).alias("form")).where(F.col("form").isNotNull()).distinct()
               .join(known, "form", "left_anti"))
    step = unknown.select("form", F.lit(None).cast("string").alias("pos"), F.col("form").alias("lemma"))
    steps = []
    for r in range(1, rounds + 1):
        step = _detach(step, rules, r)
        steps.append(step)
    candidates = steps[0]
    for more in steps[1:]:
        candidates = candidates.unionByName(more)
    found = candidates.join(lexicon.select("lemma", "pos").distinct(), ["lemma", "pos"], "left_semi")
    if exceptions is not None:
        odd = exceptions.join(unknown, "form", "left_semi")
        found = found.unionByName(odd.select("form", "pos", F.lit(0).alias("step"), F.lit(0).alias("place"), "lemma"))
    order = F.struct("step", F.length("lemma").alias("n"), "place", "lemma")
    return found.groupBy("form", "pos").agg(F.min(order).alias("x")).select("form", "pos", "x.lemma")


def extend_lexicon(lexicon: DataFrame, forms: DataFrame, exceptions: DataFrame | None = None, **how) -> DataFrame:
    """The lexicon with an entry for each of ``forms`` that has a lemma by detachment."""
    entries = lexicon.select("form", "pos", "lemma")
    return entries.unionByName(detached_lemmas(forms, lexicon, exceptions, **how))
