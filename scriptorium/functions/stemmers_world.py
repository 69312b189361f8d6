"""Stemmers of further languages, after the published Snowball descriptions, a light one for
Arabic, and one that looks candidates up in a dictionary.

Words are lower-cased. Each description is a table of endings and a few rules; the tables hold
fixed values, in the order of the descriptions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable


class _Word:
    """A word on its way to the stem, with the regions in which endings may be taken off."""

    def __init__(self, w: str, vowels: str, rv: int | None = None):
        self.w, self.v = w, vowels
        self.r1 = self._after(0)
        self.r2 = self._after(self.r1)
        self.rv = len(w) if rv is None else rv

    def _after(self, start: int) -> int:
        m = re.compile(f"[{self.v}][^{self.v}]").search(self.w, start)
        return m.end() if m else len(self.w)

    def ending(self, endings: Iterable[str], within: int = 0) -> str:
        """The longest of ``endings`` that the word has from ``within`` on; empty without one."""
        for e in sorted(endings, key=len, reverse=True):
            if self.w.endswith(e) and len(self.w) - len(e) >= within:
                return e
        return ""

    def inside(self, e: str, region: int) -> bool:
        return len(self.w) - len(e) >= region

    def cut(self, e: str, by: str = "") -> bool:
        self.w = self.w[: len(self.w) - len(e)] + by
        return True

    def cut_if(self, endings: Iterable[str], region: int, by: str = "") -> bool:
        """Takes the longest ending off if it lies in the region."""
        e = self.ending(endings)
        return bool(e) and self.inside(e, region) and self.cut(e, by)


def _romance_rv(w: str, v: str) -> int:
    """Where the verb region of Spanish, Italian and Portuguese begins."""
    if len(w) < 2:
        return len(w)
    if w[1] not in v:
        m = re.compile(f"[{v}]").search(w, 2)
    elif w[0] in v:
        m = re.compile(f"[^{v}]").search(w, 2)
    else:
        return min(3, len(w))
    return m.end() if m else len(w)


def _adverb(x: _Word, e: str, inner: tuple[str, ...]) -> bool:
    """``amente``: in the first region, then what stands before it in the second."""
    if not x.inside(e, x.r1):
        return False
    x.cut(e)
    if x.w.endswith("iv") and x.inside("iv", x.r2):
        x.cut("iv")
        x.cut_if(["at"], x.r2)
    else:
        x.cut_if(inner, x.r2)
    return True


# --- Spanish --------------------------------------------------------------------------------

_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_1 = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_ES_2 = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais "
    "ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
_ACUTE = str.maketrans("áéíóú", "aeiou")


def spanish(word: str) -> str:
    v = "aeiouáéíóúü"
    x = _Word(word, v, _romance_rv(word, v))
    p = x.ending(_ES_PRONOUNS, x.rv)
    if p:
        stem = x.w[: -len(p)]
        for e in ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir"):
            if stem.endswith(e) and len(stem) - len(e) >= x.rv:
                x.w = stem[: -len(e)] + e.translate(_ACUTE)
                break
        else:
            if stem.endswith("uyendo") and len(stem) - 5 >= x.rv:
                x.w = stem
    if not _spanish_standard(x):
        e = x.ending(_ES_Y, x.rv)
        if e and x.w[: -len(e)].endswith("u"):
            x.cut(e)
        else:
            e = x.ending(_ES_VERBS + ["en", "es", "éis", "emos"], x.rv)
            if e:
                x.cut(e)
                if e in ("en", "es", "éis", "emos") and x.w.endswith("gu"):
                    x.cut("u")
    e = x.ending("os a o á í ó e é".split(), x.rv)
    if e:
        x.cut(e)
        if e in "eé" and x.w.endswith("gu") and x.inside("u", x.rv):
            x.cut("u")
    return x.w.translate(_ACUTE)


def _spanish_standard(x: _Word) -> bool:
    groups = {
        **dict.fromkeys(_ES_1, 1), **dict.fromkeys(_ES_2, 2), **dict.fromkeys(("logía", "logías"), 3), **dict.fromkeys(("ución", "uciones"), 4), **dict.fromkeys(("encia", "encias"), 5),
        "amente": 6, "mente": 7, **dict.fromkeys(("idad", "idades"), 8), **dict.fromkeys("iva ivo ivas ivos".split(), 9),
    }
    e = x.ending(groups)
    g = groups.get(e)
    if g is None:
        return False
    if g == 6:
        return _adverb(x, e, ("os", "ic", "ad"))
    if not x.inside(e, x.r2):
        return False
    x.cut(e, {3: "log", 4: "u", 5: "ente"}.get(g, ""))
    x.cut_if({2: ["ic"], 7: ["ante", "able", "ible"], 8: ["abil", "ic", "iv"], 9: ["at"]}.get(g, ()), x.r2)
    return True


# --- Italian --------------------------------------------------------------------------------

_IT_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split()
_IT_1 = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()
_IT_VERBS = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò "
    "erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti "
    "ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()


def italian(word: str) -> str:
    v = "aeiouàèìòù"
    w = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    w = re.sub(f"(?<=[{v}])[ui](?=[{v}])", lambda m: m[0].upper(), w)
    x = _Word(w, v, _romance_rv(w, v))
    p = x.ending(_IT_PRONOUNS, x.rv)
    if p:
        stem = x.w[: -len(p)]
        for ends, by in ((("ando", "endo"), ""), (("ar", "er", "ir"), "e")):
            if any(stem.endswith(e) and len(stem) - len(e) >= x.rv for e in ends):
                x.w = stem + by
    if not _italian_standard(x):
        x.cut_if([x.ending(_IT_VERBS, x.rv)] if x.ending(_IT_VERBS, x.rv) else (), x.rv)
    if x.ending("aeioàèìò", x.rv):
        x.cut("a")
        x.cut_if(["i"], x.rv)
    if x.ending(("ch", "gh"), x.rv):
        x.cut("h")
    return x.w.lower()


def _italian_standard(x: _Word) -> bool:
    groups = {
        **dict.fromkeys(_IT_1, 1), **dict.fromkeys("azione azioni atore atori".split(), 2), **dict.fromkeys(("logia", "logie"), 3), **dict.fromkeys("uzione uzioni usione usioni".split(), 4), **dict.fromkeys(("enza", "enze"), 5),
        "amente": 6, **dict.fromkeys("amento amenti imento imenti".split(), 7), "ità": 8, **dict.fromkeys("ivo ivi iva ive".split(), 9),
    }
    e = x.ending(groups)
    g = groups.get(e)
    if g is None:
        return False
    if g == 6:
        return _adverb(x, e, ("os", "ic", "abil"))
    if not x.inside(e, x.rv if g == 7 else x.r2):
        return False
    x.cut(e, {3: "log", 4: "u", 5: "ente"}.get(g, ""))
    if g == 9:
        if x.cut_if(["at"], x.r2):
            x.cut_if(["ic"], x.r2)
    else:
        x.cut_if({2: ["ic"], 8: ["abil", "ic", "iv"]}.get(g, ()), x.r2)
    return True


# --- Portuguese -------------------------------------------------------------------------------

_PT_1 = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split()
_PT_VERBS = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo "
    "indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis "
    "iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos "
    "imos armos ermos irmos eu iu ou ira iras"
).split()


def portuguese(word: str) -> str:
    v = "aeiouáéíóúâêô"
    w = word.replace("ã", "a~").replace("õ", "o~")
    x = _Word(w, v, _romance_rv(w, v))
    changed = _portuguese_standard(x)
    if not changed:
        e = x.ending(_PT_VERBS, x.rv)
        changed = bool(e) and x.cut(e)
    if changed:
        if x.w.endswith("ci") and x.inside("i", x.rv):
            x.cut("i")
    else:
        e = x.ending("os a i o á í ó".split(), x.rv)
        if e:
            x.cut(e)
    if x.ending("eéê", x.rv):
        x.cut("e")
        if (x.w.endswith("gu") or x.w.endswith("ci")) and x.inside("u", x.rv):
            x.cut("u")
    elif x.w.endswith("ç"):
        x.cut("ç", "c")
    return x.w.replace("a~", "ã").replace("o~", "õ")


def _portuguese_standard(x: _Word) -> bool:
    groups = {
        **dict.fromkeys(_PT_1, 1), **dict.fromkeys(("logia", "logias"), 3), **dict.fromkeys(("uça~o", "uço~es"), 4), **dict.fromkeys(("ência", "ências"), 5), "amente": 6, "mente": 7,
        **dict.fromkeys(("idade", "idades"), 8), **dict.fromkeys("iva ivo ivas ivos".split(), 9), **dict.fromkeys(("ira", "iras"), 10),
    }
    e = x.ending(groups)
    g = groups.get(e)
    if g is None:
        return False
    if g == 6:
        return _adverb(x, e, ("os", "ic", "ad"))
    if g == 10:
        return x.inside(e, x.rv) and x.w[: -len(e)].endswith("e") and x.cut(e, "ir")
    if not x.inside(e, x.r2):
        return False
    x.cut(e, {3: "log", 4: "u", 5: "ente"}.get(g, ""))
    x.cut_if({7: ["ante", "avel", "ível"], 8: ["abil", "ic", "iv"], 9: ["at"]}.get(g, ()), x.r2)
    return True


# --- French -----------------------------------------------------------------------------------

_FR_I = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
).split()
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
_FR_GROUPS = {
    **dict.fromkeys("ance iqUe isme able iste eux ances iqUes ismes ables istes".split(), "drop"), **dict.fromkeys("atrice ateur ation atrices ateurs ations".split(), "ation"), **dict.fromkeys(("logie", "logies"), "log"),
    **dict.fromkeys("usion ution usions utions".split(), "u"), **dict.fromkeys(("ence", "ences"), "ent"), **dict.fromkeys(("ement", "ements"), "ement"), **dict.fromkeys(("ité", "ités"), "ité"), **dict.fromkeys("if ive ifs ives".split(), "if"),
    "eaux": "eau", "aux": "al", **dict.fromkeys(("euse", "euses"), "euse"), **dict.fromkeys(("issement", "issements"), "issement"), "amment": "ant", "emment": "emment", **dict.fromkeys(("ment", "ments"), "ment"),
}


def french(word: str) -> str:
    v = "aeiouyâàëéêèïîôûù"
    w = re.sub(f"(?<=[{v}])[ui](?=[{v}])", lambda m: m[0].upper(), word.replace("qu", "qU"))
    w = re.sub(f"(?<=[{v}])y|y(?=[{v}])", "Y", w)
    if re.match(f"[{v}][{v}]", w) or w.startswith(("par", "col", "tap")):
        rv = min(3, len(w))
    else:
        m = re.compile(f"[{v}]").search(w, 1)
        rv = m.end() if m else len(w)
    x = _Word(w, v, rv)
    before = x.w
    standard, adverb = _french_standard(x)
    if not standard or adverb:
        e = x.ending(_FR_I, x.rv)
        if e and x.inside(e, x.rv + 1) and x.w[-len(e) - 1] not in v:
            x.cut(e)
        elif not standard or x.w != before or adverb:
            _french_verb(x)
    if x.w != before:
        if x.w.endswith("Y"):
            x.cut("Y", "i")
        elif x.w.endswith("ç"):
            x.cut("ç", "c")
    else:
        if len(x.w) > 1 and x.w.endswith("s") and x.w[-2] not in "aiouès":
            x.cut("s")
        e = x.ending("ion ier ière Ier Ière e ë".split(), x.rv)
        if e == "ion":
            if x.inside(e, x.r2) and x.w[:-3].endswith(("s", "t")) and x.inside("xion", x.rv):
                x.cut(e)
        elif e in ("ier", "ière", "Ier", "Ière"):
            x.cut(e, "i")
        elif e == "e" or (e == "ë" and x.w.endswith("guë")):
            x.cut(e)
    if x.w.endswith(("enn", "onn", "ett", "ell", "eill")):
        x.cut("n")
    x.w = re.sub(f"[éè](?=[^{v}]+$)", "e", x.w)
    return x.w.lower()


def _french_verb(x: _Word) -> None:
    e = x.ending([*_FR_E, *_FR_A, "ions"], x.rv)
    if e == "ions":
        if x.inside(e, x.r2):
            x.cut(e)
    elif e in _FR_E:
        x.cut(e)
    elif e:
        x.cut(e)
        if x.w.endswith("e") and x.inside("e", x.rv):
            x.cut("e")


def _french_standard(x: _Word) -> tuple[bool, bool]:
    """(was an ending taken off, was it one of the adverbs' that verbs may follow)."""
    e = x.ending(_FR_GROUPS)
    g = _FR_GROUPS.get(e, "")
    r1, r2, rv = (x.inside(e, r) for r in (x.r1, x.r2, x.rv))
    if g in ("drop", "log", "u", "ent") and r2:
        return x.cut(e, "" if g == "drop" else g), False
    if g == "ation" and r2:
        x.cut(e)
        if x.w.endswith("ic"):
            x.cut("ic", "" if x.inside("ic", x.r2) else "iqU")
        return True, False
    if g == "ement" and rv:
        x.cut(e)
        if x.w.endswith("iv") and x.inside("iv", x.r2):
            x.cut("iv")
            x.cut_if(["at"], x.r2)
        elif x.w.endswith("eus"):
            if x.inside("eus", x.r2):
                x.cut("eus")
            elif x.inside("eus", x.r1):
                x.cut("eus", "eux")
        elif x.w.endswith(("abl", "iqU")):
            x.cut_if(["abl", "iqU"], x.r2)
        elif x.w.endswith(("ièr", "Ièr")) and x.inside("ièr", x.rv):
            x.cut("ièr", "i")
        return True, False
    if g == "ité" and r2:
        x.cut(e)
        if x.w.endswith("abil"):
            x.cut("abil", "" if x.inside("abil", x.r2) else "abl")
        elif x.w.endswith("ic"):
            x.cut("ic", "" if x.inside("ic", x.r2) else "iqU")
        else:
            x.cut_if(["iv"], x.r2)
        return True, False
    if g == "if" and r2:
        x.cut(e)
        if x.cut_if(["at"], x.r2) and x.w.endswith("ic"):
            x.cut("ic", "" if x.inside("ic", x.r2) else "iqU")
        return True, False
    if g == "eau":
        return x.cut("x"), False
    if g == "al" and r1:
        return x.cut(e, "al"), False
    if g == "euse" and (r2 or r1):
        return x.cut(e, "" if r2 else "eux"), False
    if g == "issement" and r1 and x.w[-len(e) - 1] not in x.v:
        return x.cut(e), False
    if g in ("ant", "emment") and rv:
        return x.cut(e, "ant" if g == "ant" else "ent"), True
    if g == "ment" and x.inside(e, x.rv + 1) and x.w[-len(e) - 1] in x.v:
        return x.cut(e), True
    return False, False


# --- Dutch ------------------------------------------------------------------------------------

_PLAIN_NL = str.maketrans("äëïöüáéíóú", "aeiouaeiou")


def dutch(word: str) -> str:
    v = "aeiouyè"
    w = re.sub(r"^y", "Y", word.translate(_PLAIN_NL))
    w = re.sub(f"(?<=[{v}])y", "Y", w)
    w = re.sub(f"(?<=[{v}])i(?=[{v}])", "I", w)
    x = _Word(w, v)
    x.r1 = max(x.r1, min(3, len(w)))

    def undouble() -> None:
        if x.w.endswith(("kk", "dd", "tt")):
            x.cut("k")

    def en(e: str) -> None:
        rest = x.w[: -len(e)]
        if x.inside(e, x.r1) and rest and rest[-1] not in v and not rest.endswith("gem"):
            x.cut(e)
            undouble()

    def step2() -> bool:
        if x.w.endswith("e") and x.inside("e", x.r1) and len(x.w) > 1 and x.w[-2] not in v:
            x.cut("e")
            undouble()
            return True
        return False

    e = x.ending(("heden", "ene", "en", "se", "s"))
    if e == "heden":
        if x.inside(e, x.r1):
            x.cut(e, "heid")
    elif e in ("ene", "en"):
        en(e)
    elif e and x.inside(e, x.r1) and x.w[: -len(e)] and x.w[-len(e) - 1] not in v + "j":
        x.cut(e)
    removed = step2()
    if x.w.endswith("heid") and x.inside("heid", x.r2) and not x.w[:-4].endswith("c"):
        x.cut("heid")
        if x.w.endswith("en"):
            en("en")
    e = x.ending(("end", "ing", "ig", "lijk", "baar", "bar"))
    if e and x.inside(e, x.r2):
        if e in ("end", "ing"):
            x.cut(e)
            if x.w.endswith("ig") and x.inside("ig", x.r2) and not x.w[:-2].endswith("e"):
                x.cut("ig")
            else:
                undouble()
        elif e == "ig":
            if not x.w[:-2].endswith("e"):
                x.cut(e)
        elif e == "lijk":
            x.cut(e)
            step2()
        elif e == "baar" or removed:
            x.cut(e)
    m = re.search(f"[^{v}](aa|ee|oo|uu)[^{v}I]$", x.w)
    if m:
        x.w = x.w[: m.start(1)] + x.w[m.start(1) + 1 :]
    return x.w.lower()


# --- Russian ----------------------------------------------------------------------------------

_RU_GERUND = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
_RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RU_PARTICIPLE = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
_RU_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())
_RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def russian(word: str) -> str:
    v = "аеиоуыэюя"
    w = word.replace("ё", "е")
    m = re.search(f"[{v}]", w)
    x = _Word(w, v, m.end() if m else len(w))

    def grouped(groups: tuple[list[str], list[str]]) -> bool:
        """The longest ending of both groups; one of the first needs а or я before it."""
        e = x.ending([*groups[0], *groups[1]], x.rv)
        if e in groups[1] or (e and x.inside(e, x.rv + 1) and x.w[-len(e) - 1] in "ая"):
            return x.cut(e)
        return False

    if not grouped(_RU_GERUND):
        e = x.ending(("ся", "сь"), x.rv)
        if e:
            x.cut(e)
        e = x.ending(_RU_ADJECTIVE, x.rv)
        if e:
            x.cut(e)
            grouped(_RU_PARTICIPLE)
        elif not grouped(_RU_VERB):
            e = x.ending(_RU_NOUN, x.rv)
            if e:
                x.cut(e)
    if x.ending("и", x.rv):
        x.cut("и")
    e = x.ending(("ост", "ость"), max(x.r2, x.rv))
    if e:
        x.cut(e)
    e = x.ending(("ейш", "ейше"), x.rv)
    if e:
        x.cut(e)
    if x.w.endswith("нн") and x.inside("нн", x.rv):
        x.cut("н")
    elif not e and x.ending("ь", x.rv):
        x.cut("ь")
    return x.w


# --- Arabic, light ------------------------------------------------------------------------------

_AR_SIGNS = re.compile("[ً-ْـ]")
_AR_LETTERS = str.maketrans("أإآىة", "اااي" + "ه")
_AR_ARTICLES = ("وال", "بال", "كال", "فال", "ال", "لل")
_AR_ENDINGS = ("ها", "ان", "ات", "ون", "ين", "يه", "ه", "ي")


def arabic(word: str) -> str:
    """Signs of vowels and length go, letters of one sound become one, then the article and one
    or more endings are taken off as long as two letters are left."""
    w = _AR_SIGNS.sub("", word).translate(_AR_LETTERS)
    for a in _AR_ARTICLES:
        if w.startswith(a) and len(w) - len(a) >= 2:
            w = w[len(a) :]
            break
    else:
        if w.startswith("و") and len(w) > 3:
            w = w[1:]
    for e in _AR_ENDINGS:
        if w.endswith(e) and len(w) - len(e) >= 2:
            w = w[: -len(e)]
    return w


# --- English with a dictionary ------------------------------------------------------------------


def inflections(word: str) -> list[str]:
    """Words that ``word`` may be a form of, best guess first: plurals, past and progressive forms,
    comparisons and adverbs undone; the word itself comes last."""
    w, out = word, []
    if len(w) > 3:
        if w.endswith("ies"):
            out += [w[:-3] + "y", w[:-1]]
        elif w.endswith("es"):
            out += [w[:-1], w[:-2]]
        elif w.endswith("s") and not w.endswith(("ss", "us", "is")):
            out.append(w[:-1])
    for ending, least in (("ed", 4), ("ing", 5), ("er", 5), ("est", 6)):
        if w.endswith(ending) and len(w) >= least:
            s = w[: -len(ending)]
            if s.endswith("i"):
                out.append(s[:-1] + "y")
            if len(s) > 2 and s[-1] == s[-2] and s[-1] not in "lsz":
                out += [s[:-1], s]
            else:
                out += [s + "e", s] if ending != "ing" or re.search(r"[aeiou][^aeiouwxy]$", s) else [s, s + "e"]
                if len(s) > 2 and s[-1] == s[-2]:
                    out.append(s[:-1])
    if w.endswith("ly") and len(w) > 4:
        out += [w[:-3] + "y" if w.endswith("ily") else w[:-2], w[:-1] + "e"]
    return [*dict.fromkeys(x for x in out if len(x) > 1 and x != w), w]


def with_dictionary(words: Iterable[str]) -> Callable[[str], str]:
    """A stemmer that undoes an inflection only if the result is in ``words``."""
    known = frozenset(words)
    return lambda w: next((c for c in inflections(w) if c in known), w)


WORLD: dict[str, Callable[[str], str]] = {"spanish": spanish, "italian": italian, "portuguese": portuguese, "french": french, "dutch": dutch, "russian": russian, "arabic": arabic}
