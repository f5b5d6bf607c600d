"""Text analysis: the tokens of an index, the tokens of a query, stop words and stems.

Index tokens never leave the JVM: case and accents are folded by `translate` with a table that is built once from the
Unicode data, marks are dropped, and runs of letters and digits are cut out. Stemming works on distinct words, by an Arrow
function with the published Porter2 and Turkish Snowball suffix rules in `siftlake.functions.stems`.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions.stems import stemmer

# fixed values: stop words
ENGLISH_STOPS = frozenset(
    """the and or but a an is are was were be been being have has had do does did will would could should may might must shall can to of
    in for on with at by from up about into through during before after above below between out off over under again further then once here
    there when where why how all each every both few more most other some such no nor not only own same so than too very s t just don now""".split()
)
TURKISH_STOPS = frozenset(
    """ve veya ama fakat ancak çünkü zira eğer ise ki de da den dan ile gibi kadar için olarak göre bu şu o bir her bazı tüm çok az fazla
    en daha mi mı mu mü ne nasıl neden kim hangi""".split()
)
STOPS = {"en": ENGLISH_STOPS, "tr": TURKISH_STOPS}
INDEX_WORD = r"[\p{L}\p{N}]+"
QUERY_WORD = r"[\p{L}\p{Nd}_]+"


@cache
def _fold_table() -> tuple[str, str]:
    """Letters of the basic plane with a mark, and the bare letter for each; letters without one (ı, ß, đ) stay."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.category(parts[0]).startswith("L") and all(unicodedata.category(x) == "Mn" for x in parts[1:]):
            pairs.append((c, parts[0].lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """In lower case, without accents and other marks."""
    marked, bare = _fold_table()
    return F.regexp_replace(F.lower(F.translate(text, marked, bare)), r"\p{M}", "")


def index_tokens(text: Column) -> Column:
    """The words of a text as the index holds them, in order; null and empty texts have none."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(INDEX_WORD), 0), F.array().cast("array<string>"))


def fold_word(word: str) -> str:
    """`folded` for a word on the driver."""
    table = str.maketrans(*_fold_table())
    return re.sub(r"[̀-ͯ]", "", word.translate(table).lower())


def index_words(text: str) -> list[str]:
    """`index_tokens` on the driver, for the few words of a query."""
    return re.findall(r"[^\W_]+", fold_word(text))


def query_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, case kept."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(QUERY_WORD), 0), F.array().cast("array<string>"))


def without_stops(tokens: Column, language: str) -> Column:
    words = sorted(STOPS.get(language, ()))
    return F.filter(tokens, lambda w: ~w.isin(*words)) if words else tokens


def query_words(text: str) -> list[str]:
    return re.findall(r"\w+", text)


def is_stop_word(word: str, language: str) -> bool:
    return word in STOPS.get(language, ())


def stem(word: str, language: str) -> str:
    return stemmer(language)(word)


def stems(words: Column, language: str) -> Column:
    """The stem of each word of an array; languages other than en and tr have no stems."""
    if language not in STOPS:
        return words
    of = stemmer(language)

    @F.arrow_udf("array<string>")
    def run(column):
        import pyarrow as pa

        known: dict[str, str] = {}
        flat = [known.get(w) or known.setdefault(w, of(w)) if w is not None else None for w in column.flatten().to_pylist()]
        lengths = column.value_lengths().fill_null(0).to_pylist()
        ends = [0]
        for n in lengths:
            ends.append(ends[-1] + n)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))

    return run(words)


def analyzed(text: Column, language: str = "en", stop: bool = True, stemming: bool = True) -> Column:
    """Tokens in lower case, without stop words, stemmed."""
    tokens = F.transform(query_tokens(text), lambda w: F.lower(w))
    tokens = without_stops(tokens, language) if stop else tokens
    return stems(tokens, language) if stemming else tokens


def analyzed_words(text: str, language: str = "en", stop: bool = True, stemming: bool = True) -> list[str]:
    """`analyzed` on the driver."""
    words = [w.lower() for w in query_words(text)]
    if stop:
        words = [w for w in words if not is_stop_word(w, language)]
    return [stem(w, language) for w in words] if stemming else words


def query_terms(text: str, language: str = "en", stop: bool = True, stemming: bool = True) -> list[str]:
    """The terms a query asks for: a word that its stem changed is asked for by the stem as a prefix (`run*`)."""
    words = [w.lower() for w in query_words(text)]
    if stop:
        words = [w for w in words if not is_stop_word(w, language)]
    return [s + "*" if stemming and (s := stem(w, language)) != w else w for w in words]
