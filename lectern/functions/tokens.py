"""Tokenisers and set measures. They differ on purpose: each belongs to one comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.arrays import bound
from lectern.functions.text import fold, normalise

# Function words of the topic, claim and explanation tokenisers.
TOPIC_STOPWORDS = """
a al algo algun alguna algunas alguno algunos ante antes aquel aquella aquello aqui asi aun
aunque cada como con contra cual cuales cuando cuanto de del desde donde dos el ella ellas
ello ellos en entre era eran eres es esa esas ese eso esos esta estan estas este esto estos
fue fueron ha haber habia han hasta hay la las le les lo los mas me mi mientras muy nada ni
no nos nuestra nuestro o os otra otras otro otros para pero poco por porque que quien quienes
se sea segun ser si sin sobre solo son su sus tambien tanto te tiene tienen toda todas todo
todos tras tu un una unas uno unos ya yo
about after all also am an and any are as at be because been before being between both but
by can could did do does for from had has have he her hers him his how if in into is it its
more most no nor not of on once only or other our out over own same she should so some such
than that the their them then there these they this those through to too under until up very
was we were what when where which while who whom why will with would you your
""".split()
CLAIM_STOPWORDS = """
the a an of and to in that is are was were for with on as by from it this these be been will would has have had
not or but at its their which than then so if when el la los las un una de del y que en por para con se es son fue
fueron no al como mas pero su sus lo le ya sobre entre sera seran ha han esta este esto
""".split()
EXPLANATION_STOPWORDS = """
a an the and or but if then than that this these those of to in on for with
by as at from is are was were be been being it its their there here we you
they he she them his her our your which who whom whose what when where how
de la el los las un una unos unas y o pero si entonces que este esta estos
estas del al en con por para como cuando donde su sus lo se es son era eran
ser sido siendo esto eso aquello no sin
""".split()

WORD = "[0-9a-z]+(?:[.,][0-9]+)*"


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in sorted(set(words))])


def comparison_tokens(text: Column) -> Column:
    """Words and figures of the normalised text; figures keep their separators."""
    return tokens(normalise(text))


def tokens(plain: Column) -> Column:
    """The comparison tokens of a text that is normalised already."""
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def topic_terms(text: Column, shortest: int = 4) -> Column:
    words = F.filter(F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= shortest)
    return F.array_except(F.array_distinct(words), _literal(TOPIC_STOPWORDS))


def claim_words(text: Column) -> Column:
    words = F.regexp_extract_all(fold(text), F.lit(r"\p{L}{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), _literal(CLAIM_STOPWORDS))


def explanation_tokens(text: Column) -> Column:
    """With repeats: letters, or numbers with one separator."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), lambda w: F.lower(w))
    return F.filter(words, lambda w: ~F.array_contains(_literal(EXPLANATION_STOPWORDS), w))


def shingles(tokens: Column, size: int = 5) -> Column:
    """Distinct runs of `size` tokens as text; fewer tokens give one run, none give none."""

    def cut(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - size + 1), lambda i: F.array_join(F.slice(t, i, F.lit(size)), " "))
        whole = F.array(F.array_join(t, " "))
        return F.array_distinct(F.when(F.size(t) >= size, runs).when(F.size(t) > 0, whole).otherwise(F.array().cast("array<string>")))

    return bound(tokens, cut)


def shingle_hashes(tokens: Column, size: int = 5) -> Column:
    """Hashes of the shingles; told apart as hashes, so that their texts aren't kept."""

    def cut(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(t) - size), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(t, i + k) for k in range(size)])))
        whole = F.array(F.xxhash64(F.array_join(t, " ")))
        return F.array_distinct(F.when(F.size(t) >= size, runs).when(F.size(t) > 0, whole).otherwise(F.array().cast("array<long>")))

    return bound(tokens, cut)


def features(tokens: Column) -> Column:
    """Terms of three letters or more that are no short number, and neighbouring ones as pairs."""
    words = F.filter(tokens, lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]{1,2}$"))
    pairs = lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit("_"), b))
    # the last word meets a null, and so has no pair
    return bound(words, lambda w: F.concat(w, F.array_compact(pairs(w))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared part of the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def coverage(claim: Column, evidence: Column) -> Column:
    """Shared part of the claim's words."""
    return F.when(F.size(claim) > 0, F.size(F.array_intersect(claim, evidence)) / F.size(claim)).otherwise(F.lit(0.0))


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(set(words))) + "]"
