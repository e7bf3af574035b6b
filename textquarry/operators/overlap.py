"""Overlap of answers with references: BLEU and ROUGE-L, over whole batches in Python workers."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bleu(answer: str, reference: str, most: int = 4, epsilon: float = 0.1) -> float:
    """Sentence BLEU of white-space tokens: uniform weights, epsilon for orders without match."""
    a, r = answer.split(), reference.split()
    logs = 0.0
    for n in range(1, most + 1):
        own = Counter(tuple(a[i : i + n]) for i in range(len(a) - n + 1))
        ref = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        hits, total = sum(min(c, ref[g]) for g, c in own.items()), max(1, sum(own.values()))
        if n == 1 and not hits:
            return 0.0
        logs += math.log((hits or epsilon) / total) / most
    brevity = 1.0 if len(a) > len(r) else math.exp(1 - len(r) / len(a))
    return brevity * math.exp(logs)


_VOWEL = "aeiou"


def _consonant(w: str, i: int) -> bool:
    if w[i] == "y":
        return i == 0 or not _consonant(w, i - 1)
    return w[i] not in _VOWEL


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 1) and w[-1] not in "wxy"


# The suffix tables of the published Porter algorithm.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(w: str) -> str:
    """The stem of a lower-case word."""
    if len(w) < 3:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def rouge_tokens(text: str) -> list[str]:
    """Lower-case runs of a-z and digits; words over three characters are stemmed."""
    return [porter(t) if len(t) > 3 else t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, all of b's places in one integer: a bit is 0 where the length steps up."""
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    whole = (1 << len(b)) - 1
    row = whole
    for w in a:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & whole
    return len(b) - row.bit_count()


def rouge_l(answer: str, reference: str) -> float:
    """F1 of the longest common subsequence of tokens."""
    a, r = rouge_tokens(answer), rouge_tokens(reference)
    n = common_subsequence(r, a)
    return 2 * n / (len(a) + len(r)) if n else 0.0


def overlap(pairs: DataFrame) -> DataFrame:
    """(query_id, bleu, rouge_l) of pairs (query_id, resposta, referencia)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            both = list(zip(p["resposta"].fillna(""), p["referencia"].fillna(""), strict=True))
            yield pd.DataFrame({"query_id": p["query_id"], "bleu": [bleu(a, r) for a, r in both], "rouge_l": [rouge_l(a, r) for a, r in both]})

    kind = pairs.schema["query_id"].dataType.simpleString()
    out = pairs.select("query_id", "resposta", "referencia").mapInPandas(run, f"query_id {kind}, bleu double, rouge_l double")
    return out.withColumns({c: F.round(c, 6) for c in ("bleu", "rouge_l")})  # halves go up


def overlap_means(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), F.round(F.avg("bleu"), 6).alias("bleu"), F.round(F.avg("rouge_l"), 6).alias("rouge_l"))
