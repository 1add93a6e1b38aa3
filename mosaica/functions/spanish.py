"""The Spanish Snowball stemmer as column expressions.

Written from the algorithm's published description: regions RV, R1 and R2, attached pronouns, standard suffixes, verb
suffixes, residual suffixes, and acute accents removed at the end.  A word is a struct of itself and its
three regions, computed once; every step is one longest-suffix look-up by regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_V = "aeiouáéíóúü"
# The suffixes of the published algorithm, by step.
_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_DELETE_R2 = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_IC_R2 = "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()
_YVERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_EN = "en es éis emos".split()
_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré"
    " aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais"
    " arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def _any(suffixes: list[str]) -> str:
    return "(?:" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")$"


def _length_after(word: Column, pattern: str) -> Column:
    """Characters behind the first match of ``pattern`` from the start, 0 without one."""
    return F.when(word.rlike(pattern), F.length(word) - F.length(F.regexp_extract(word, pattern, 0))).otherwise(0)


def _region(word: Column, size: Column) -> Column:
    return F.when(size > 0, F.substring(word, F.length(word) - size + 1, size)).otherwise("")


def _cut(word: Column, n: Column | int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - (n if isinstance(n, Column) else F.lit(n)))


def _ends(region: Column, suffixes: list[str]) -> Column:
    """The longest of the suffixes at the region's end, or the empty string."""
    return F.regexp_extract(region, _any(suffixes), 0)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _accents_off(word: Column) -> Column:
    return F.translate(word, "áéíóú", "aeiou")


def _step0(word: Column, rv: Column) -> Column:
    """An attached pronoun behind a gerund or an infinitive goes."""
    def decide(pronoun: Column) -> Column:
        stem = _cut(word, F.length(pronoun))
        head = _region(stem, F.length(rv) - F.length(pronoun))
        accented, plain = _ends(head, ["iéndo", "ándo", "ár", "ér", "ír"]), _ends(head, ["ando", "iendo", "ar", "er", "ir"])
        yendo = stem.rlike("uyendo$") & head.rlike("yendo$")
        return F.when(F.length(pronoun) == 0, word).when(F.length(accented) > 0, F.concat(_cut(stem, F.length(accented)), _accents_off(accented))).when((F.length(plain) > 0) | yendo, stem).otherwise(word)

    return _let(_ends(rv, _PRONOUNS), decide)


def _step1(word: Column, r1: Column, r2: Column) -> Column:
    """A standard suffix goes, or is replaced."""
    every = [*_DELETE_R2, *_IC_R2, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]

    def inside(region: Column, suffix: Column) -> Column:
        return F.length(region) >= F.length(suffix)

    def also(stem: Column, taken: Column, suffixes: list[str]) -> Column:
        """What is left of ``stem`` without one more suffix, if R2 holds it too."""
        return _let(_ends(_region(stem, F.length(r2) - taken), suffixes), lambda more: _cut(stem, F.length(more)))

    def decide(suffix: Column) -> Column:
        n = F.length(suffix)
        stem = _cut(word, n)
        two, one = inside(r2, suffix), inside(r1, suffix)
        adverb = _let(_ends(_region(stem, F.length(r2) - n), ["iv", "os", "ic", "ad"]), lambda more: F.when(more == "iv", also(_cut(stem, 2), n + 2, ["at"])).otherwise(_cut(stem, F.length(more))))
        return (
            F.when(n == 0, word)
            .when(suffix == "amente", F.when(one, adverb).otherwise(word))
            .when(~two, word)
            .when(suffix.isin(_DELETE_R2), stem)
            .when(suffix.isin(_IC_R2), also(stem, n, ["ic"]))
            .when(suffix.isin("logía", "logías"), F.concat(stem, F.lit("log")))
            .when(suffix.isin("ución", "uciones"), F.concat(stem, F.lit("u")))
            .when(suffix.isin("encia", "encias"), F.concat(stem, F.lit("ente")))
            .when(suffix == "mente", also(stem, n, ["ante", "able", "ible"]))
            .when(suffix.isin("idad", "idades"), also(stem, n, ["abil", "ic", "iv"]))
            .otherwise(also(stem, n, ["at"]))
        )

    return _let(_ends(word, every), decide)


def _step2(word: Column, rv: Column) -> Column:
    """A verb suffix goes: first those that begin with y behind a u, then the others."""
    def others(_: Column) -> Column:
        def decide(suffix: Column) -> Column:
            stem = _cut(word, F.length(suffix))
            return F.when(F.length(suffix) == 0, word).when(suffix.isin(_EN) & stem.rlike("gu$"), _cut(stem, 1)).otherwise(stem)

        return _let(_ends(rv, [*_EN, *_VERBS]), decide)

    return _let(_ends(rv, _YVERBS), lambda y: F.when((F.length(y) > 0) & _cut(word, F.length(y)).rlike("u$"), _cut(word, F.length(y))).otherwise(others(y)))


def _step3(word: Column, rv: Column) -> Column:
    """A residual suffix goes."""
    def decide(suffix: Column) -> Column:
        stem = _cut(word, F.length(suffix))
        left = F.length(rv) - F.length(suffix)
        return F.when(F.length(suffix) == 0, word).when(suffix.isin("e", "é") & stem.rlike("gu$") & (left >= 1), _cut(stem, 1)).otherwise(stem)

    return _let(_ends(rv, ["os", "a", "o", "á", "í", "ó", "e", "é"]), decide)


def spanish_stem(word: Column) -> Column:
    c = f"[^{_V}]"
    v = f"[{_V}]"

    def regions(w: Column) -> Column:
        r1 = _length_after(w, f"^{c}*{v}+{c}")
        r2 = _length_after(w, f"^{c}*{v}+{c}{c}*{v}+{c}")
        rv = (
            F.when(w.rlike(f"^.{c}"), _length_after(w, f"^.{c}.*?{v}"))  # the second letter is a consonant
            .when(w.rlike(f"^{v}{v}"), _length_after(w, f"^{v}{v}+{c}"))
            .when(F.length(w) > 3, F.length(w) - 3)
            .otherwise(0)
        )
        return F.struct(w.alias("w"), r1.alias("r1"), r2.alias("r2"), rv.alias("rv"))

    def stems(at: Column) -> Column:
        # a region is what is left of it: its size shrinks with the word
        size = lambda w, r: F.greatest(at[r] - (F.length(at["w"]) - F.length(w)), F.lit(0))
        zero = _step0(at["w"], _region(at["w"], at["rv"]))
        def after(w: Column) -> Column:
            def verbs(one: Column) -> Column:
                two = F.when(one != w, one).otherwise(_step2(w, _region(w, size(w, "rv"))))
                return _let(two, lambda x: _accents_off(_step3(x, _region(x, size(x, "rv")))))

            return _let(_step1(w, _region(w, size(w, "r1")), _region(w, size(w, "r2"))), verbs)

        return _let(zero, after)

    return _let(_let(word, regions), stems)
