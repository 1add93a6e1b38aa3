"""Text analysis as expressions: accents, words, stop words, stems.

Documents and query strings go through the same expressions, so a word is always found by itself.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from mosaica.functions.spanish import spanish_stem

# The stop words that results depend on (English, then Spanish).  They are compared after accents are
# stripped, so the accented ones never apply.
STOPWORDS = """
the a an and or in on at to of for is are was were be been by with from as that this these those it its into about over
under than then there here up down out off so but not
el la los las un una unos unas y o u en de del al a por para con sin sobre entre tras durante segun según contra como que
qué se su sus tu tus mi mis nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras lo le les ya muy más menos
tambien también pero porque cuando donde dónde cual cuál cuales cuáles quien quién quienes quiénes esto eso aquello aqui
aquí alli allí allá hoy ayer mañana si sí no ni cada casi tal tales otro otros otra otras donde desde hasta sino e ademas
además pues ante bajo cabe era eran es son ser será serán
""".split()
WORD = r"[\p{L}\p{N}_]+"
#: Ways to a term from a word: as it is, without the final s, or by the Spanish Snowball rules.
STEMS = ("none", "light", "spanish")


@cache
def accents() -> tuple[str, str]:
    """All characters that decompose into one character and marks, and that character (without marks)."""
    pairs = []
    for c in range(0x80, 0x30000):
        parts = unicodedata.normalize("NFKD", chr(c))
        bare = "".join(x for x in parts if not unicodedata.combining(x))
        if bare != chr(c) and len(bare) == 1 and c < 0x10000 and ord(bare) < 0x10000:
            pairs.append((chr(c), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents; combining marks that stand alone go."""
    return F.lower(F.regexp_replace(F.translate(text, *accents()), r"\p{M}+", ""))


def words(text: Column, stop: bool = True, normalize: bool = True) -> Column:
    """All words of a text in order, repeats included; none of null."""
    flat = fold(text) if normalize else F.lower(text)
    found = F.regexp_extract_all(F.coalesce(flat, F.lit("")), F.lit(WORD if normalize else r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS) if stop else F.length(t) > 0)


def stem(word: Column, how: str = "light") -> Column:
    """A stem; it may be empty and is a term all the same."""
    if how not in STEMS:
        raise ValueError(f"{how!r} is no way to stem")
    return {"none": lambda w: w, "light": lambda w: F.regexp_replace(w, "s+$", ""), "spanish": spanish_stem}[how](word)


def terms(text: Column, how: str = "light", normalize: bool = True) -> Column:
    return F.transform(words(text, normalize=normalize), lambda w: stem(w, how))


def query_terms(spark: SparkSession, query: str | None, how: str = "light", normalize: bool = True) -> list[str]:
    """The terms of a query string, by the expressions that documents go through."""
    return list(spark.range(1).select(terms(F.lit(query).cast("string"), how, normalize).alias("t")).first().t)
