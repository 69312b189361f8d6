"""Stemmers. They run on the distinct terms of a vocabulary, whose stems are joined back."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.stemmers_world import WORLD, inflections
from scriptorium.session import arrow_map

# --- English, second version of Porter's stemmer ------------------------------------------------

#: Whole words with a stem of their own, and words left alone. Fixed values.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings of the second and third step with what replaces them, longest first. Fixed values.
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_V = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    m = re.match(r"(?:gener|commun|arsen)", w)
    r1 = m.end() if m else (x.end() if (x := re.search(r"[aeiouy][^aeiouy]", w)) else len(w))
    r2 = r1 + (x.end() if (x := re.search(r"[aeiouy][^aeiouy]", w[r1:])) else len(w) - r1)
    return r1, r2


def _short_end(w: str) -> bool:
    return bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w))


def english(word: str) -> str:
    """Stem of a lower-cased English word."""
    w = word.replace("’", "'")
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = w.lstrip("'") if w.startswith("'") else w
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"(?:'s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].+s$", w):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # past and progressive forms
    m = re.search(r"(eedly|ingly|edly|eed|ing|ed)$", w)
    if m:
        stem = w[: m.start()]
        if m[1] in ("eed", "eedly"):
            if m.start() >= r1:
                w = stem + "ee"
        elif re.search(r"[aeiouy]", stem):
            w = stem
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1] == "l") and (end != "li" or w[at - 1] in "cdeghkmnrt"):
                w = w[:at] + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (r2 if end == "ative" else r1):
                w = w[:at] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1] in "st"):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def german(word: str) -> str:
    """Light stem of a German word: plural and case endings, then two layers of suffixes."""
    w = word.replace("ß", "ss")
    w = re.sub(r"(?<=[aeiouyäöü])([uy])(?=[aeiouyäöü])", lambda m: m[1].upper(), w)
    v = "aeiouyäöü"
    m = re.search(rf"[{v}][^{v}]", w)
    r1 = max(3, m.end()) if m else len(w)
    m = re.search(rf"[{v}][^{v}]", w[r1:])
    r2 = r1 + m.end() if m else len(w)
    m = re.search(r"(ern|em|er|en|es|e|(?<=[bdfghklmnrt])s)$", w)
    if m and m.start() >= r1:
        w = w[: m.start()]
        if m[1] in ("en", "es", "e") and w.endswith("niss"):
            w = w[:-1]
    m = re.search(r"(est|en|er|(?<=...[bdfghklmnt])st)$", w)
    if m and m.start() >= r1:
        w = w[: m.start()]
    m = re.search(r"(isch|lich|heit|keit|end|ung|ig|ik)$", w)
    if m and m.start() >= r2 and not (m[1] in ("ig", "ik", "isch") and w[: m.start()].endswith("e")):
        w = w[: m.start()]
        if m[1] in ("end", "ung") and w.endswith("ig") and len(w) - 2 >= r2 and not w[:-2].endswith("e"):
            w = w[:-2]
        elif m[1] in ("lich", "heit") and w.endswith(("er", "en")) and len(w) - 2 >= r1:
            w = w[:-2]
        elif m[1] == "keit" and (x := re.search(r"(lich|ig)$", w)) and x.start() >= r2:
            w = w[: x.start()]
    return w.lower().translate(str.maketrans("äöü", "aou"))


#: Endings of the northern languages: those removed first, consonants an s may follow, pairs that
#: lose their last letter, and suffixes removed last. Fixed values.
_NORTHERN = {
    "swedish": (
        "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast",
        "bcdfghjklmnoprtvy", "dd gd nn dt gt kt tt", "lig ig els", {"löst": "lös", "fullt": "full"}, "aeiouyäåö",
    ),
    "danish": (
        "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret",
        "abcdfghjklmnoprtvyzå", "gd dt gt kt", "ig lig elig els", {"løst": "løs"}, "aeiouyæåø",
    ),
    "norwegian": (
        "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast",
        "bcdfghjlmnoprtvyz", "dt vt", "leg eleg ig eig lig elig els lov elov slov hetslov", {}, "aeiouyæåø",
    ),
}


def _northern(language: str) -> Callable[[str], str]:
    first, s_after, pairs, last, changed, vowels = _NORTHERN[language]
    by_length = lambda x: sorted(x.split(), key=len, reverse=True)
    first, last, pairs = by_length(first), by_length(last), tuple(pairs.split())

    def stem(w: str) -> str:
        m = re.search(rf"[{vowels}][^{vowels}]", w)
        r1 = max(3, m.end()) if m else len(w)
        end = next((e for e in first if w.endswith(e) and len(w) - len(e) >= r1), None)
        if language == "norwegian" and w.endswith(("erte", "ert")) and len(w) - (4 if w.endswith("e") else 3) >= r1:
            w = w[: -2 if w.endswith("e") else -1]
        elif end:
            w = w[: -len(end)]
        elif len(w) > 1 and w.endswith("s") and len(w) - 1 >= r1 and (w[-2] in s_after or (language == "norwegian" and w[-2] == "k" and w[-3:-2] not in vowels)):
            w = w[:-1]
        if w.endswith(pairs) and len(w) - 2 >= r1:
            w = w[:-1]
        if language == "danish" and w.endswith("igst"):
            w = w[:-2]
        for old, new in changed.items():
            if w.endswith(old) and len(w) - len(old) >= r1:
                return w[: -len(old)] + new
        end = next((e for e in last if w.endswith(e) and len(w) - len(e) >= r1), None)
        if end:
            w = w[: -len(end)]
            if language == "danish" and w.endswith(pairs) and len(w) - 2 >= r1:
                w = w[:-1]
        if language == "danish" and len(w) > 2 and w[-1] == w[-2] and w[-1] not in vowels and len(w) - 1 >= r1:
            w = w[:-1]
        return w

    return stem


def plural(word: str) -> str:
    """Only English plurals are undone."""
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 3 and word.endswith(("sses", "shes", "ches", "xes")):
        return word[:-2]
    if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")):
        return word[:-1]
    return word


#: Stemmer by name; users add their own with ``STEMMERS[name] = function``.
STEMMERS: dict[str, Callable[[str], str]] = {"none": lambda w: w, "porter2": english, "english": english, "german": german, "plural": plural, **{k: _northern(k) for k in _NORTHERN}, **WORLD}


def stem_key(word: str, stemmer: Callable[[str], str]) -> str:
    """Stems each part of a window key ``a~b``."""
    return "~".join(stemmer(p) for p in word.split("~"))


def stems(vocabulary: DataFrame, stemmer: str = "porter2") -> DataFrame:
    """(term, stem) of the distinct non-null terms of ``vocabulary``."""
    f = STEMMERS[stemmer]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([stem_key(t, f) for t in b.column(0).to_pylist()], pa.string())], names=["term", "stem"])

    return arrow_map(vocabulary.select("term").where(F.col("term").isNotNull()).distinct(), run, "term string, stem string")


def stemmed_tokens(documents: DataFrame, stemmer: str = "porter2") -> DataFrame:
    """``documents(docid, name, tokens)`` with stems for tokens; null tokens stay null."""
    f = STEMMERS[stemmer]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, str | None] = {None: None}
        for b in batches:
            if len(known) > 200_000:
                known = {None: None}
            out = []
            for row in b.column(2).to_pylist():
                for t in row or ():
                    if t not in known:
                        known[t] = f(t)
                out.append(None if row is None else [known[t] for t in row])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], names=["docid", "name", "tokens"])

    return arrow_map(documents.select("docid", "name", "tokens"), run, "docid bigint, name string, tokens array<string>")


def dictionary_stems(vocabulary: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(term, stem): English inflections undone where the result is a word of ``dictionary(term)``,
    by default of the vocabulary itself; other terms stay. Guesses are joined with the
    dictionary, so it may be of any size."""
    v = vocabulary.select("term").where(F.col("term").isNotNull()).distinct()
    d = (vocabulary if dictionary is None else dictionary).select(F.col("term").alias("guess")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, g, k) for t in b.column(0).to_pylist() for k, g in enumerate(inflections(t)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], names=["term", "guess", "k"])

    best = arrow_map(v, run, "term string, guess string, k int").join(d, "guess", "left_semi").groupBy("term").agg(F.min_by("guess", "k").alias("stem"))
    return v.join(best, "term", "left").select("term", F.coalesce("stem", "term").alias("stem"))


def stemmed_postings(postings: DataFrame, stemmer: str = "porter2", part: str = "postings") -> DataFrame:
    """Postings of stems, as part ``postings.<stemmer>``: positions of all forms in order."""
    p = postings.where(F.col("part") == part)
    j = p.join(dictionary_stems(p) if stemmer == "dictionary" else stems(p, stemmer), "term")
    g = j.groupBy("stem", "docid", "length").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return g.select(F.lit(f"{part}.{stemmer}").alias("part"), F.col("stem").alias("term"), "docid", F.size("positions").cast("bigint").alias("tf"), "positions", "length")
