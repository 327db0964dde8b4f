"""String scalars as Column functions: chunking, stems, suffix classes, surface forms, citations, label parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that chunk and span trimming removes.
BLANK = " \t\n\x0b\f\r"

# Words that content tokens leave out.
STOP = (
    "that", "this", "with", "from", "have", "been", "were", "they", "them",
    "their", "there", "which", "what", "when", "where", "than", "then",
    "also", "more", "most", "some", "such", "only", "into", "about",
    "these", "those", "other", "between", "through", "during", "after",
    "before", "because", "while", "being", "does", "done", "each",
)
# Template words that are no roles.
ROLE_STOP = (
    "type", "types", "aspect", "aspects", "basic", "basics", "part", "parts",
    "kind", "kinds", "form", "forms", "thing", "things", "way", "ways",
    "overview", "summary", "example", "examples", "detail", "details",
    "role", "roles", "feature", "features", "element", "elements",
    "component", "components", "category", "categories", "variety", "varieties",
)
# Suffixes of the word classes.
NOUN_SUFFIXES = (
    "tion", "ment", "ness", "ity", "sion", "osis", "oma", "ism", "ist",
    "logy", "pathy", "emia", "uria", "graphy", "plasia", "rrhea",
    "cy", "ce", "cracy", "hood", "ship", "dom",
)
ADJECTIVE_SUFFIXES = ("ful", "less", "ous", "ive", "able", "ible", "ical", "ish", "like", "most", "ward")
SHORT_ADJECTIVE_SUFFIXES = ("al", "ic", "id", "an", "ar", "en", "or")
# Number words and numerals of chapter citations.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
}
CJK_DIGITS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def windows(text: Column | str, size: int = 1200, overlap: int = 100) -> Column:
    """array<string> of trimmed character windows, in order; the last one may be short."""
    t = _col(text)
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(t) > 0, F.transform(starts, lambda s: F.btrim(t.substr(s + 1, F.lit(size)), F.lit(BLANK)))).otherwise(F.expr("cast(array() as array<string>)"))


def words(text: Column | str, least: int = 1) -> Column:
    """array<string> of the runs of a-z in the lower-cased text with at least `least` letters."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z]+"), F.lit(0))
    return found if least <= 1 else F.filter(found, lambda w: F.length(w) >= least)


def content_tokens(text: Column | str, least: int = 4, stop: tuple[str, ...] = STOP) -> Column:
    """Distinct content words of a text."""
    return F.array_except(F.array_distinct(words(text, least)), F.array(*[F.lit(w) for w in stop]))


def stem(word: Column | str) -> Column:
    """Crude singular, a key for merging only."""
    w = F.lower(_col(word))
    return (
        F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(w.substr(F.lit(1), F.length(w) - 3), F.lit("y")))
        .when((F.length(w) > 4) & w.endswith("es"), w.substr(F.lit(1), F.length(w) - 2))
        .when((F.length(w) > 3) & w.endswith("s"), w.substr(F.lit(1), F.length(w) - 1))
        .otherwise(w)
    )


def dedupe_stem(word: Column | str) -> Column:
    """stem() without a following -ing, then -ed, of words over six letters."""
    w = stem(word)
    for suffix in ("ing", "ed"):
        w = F.when((F.length(w) > 6) & w.endswith(suffix), w.substr(F.lit(1), F.length(w) - len(suffix))).otherwise(w)
    return w


def normal_name(name: Column | str) -> Column:
    """Each word of a name stemmed."""
    return F.array_join(F.transform(F.split(F.btrim(F.lower(_col(name)), F.lit(BLANK)), r"\s+"), stem), " ")


def is_ascii(word: Column | str) -> Column:
    return _col(word).rlike(r"^[\x00-\x7F]*$")


def word_class(word: Column | str) -> Column:
    """SHORT, VBG, VBD, NN, NNS, JJ or UNK by suffix; the first rule that holds."""
    w = F.lower(_col(word))
    n = F.length(w)
    return (
        F.when(n < 3, "SHORT")
        .when(w.endswith("ing") & (n > 4), "VBG")
        .when(w.endswith("ed") & (n > 3) & ~w.endswith("eed"), "VBD")
        .when(w.rlike(f"({'|'.join(NOUN_SUFFIXES)})$"), "NN")
        .when(w.endswith("s") & ~w.rlike("(ss|us|is|os|xs)$"), "NNS")
        .when(w.rlike(f"..+.({'|'.join(ADJECTIVE_SUFFIXES)})$"), "JJ")
        .when(w.rlike(f"({'|'.join(SHORT_ADJECTIVE_SUFFIXES)})$") & (n > 5), "JJ")
        .otherwise("UNK")
    )


def is_fragment(word: Column | str, in_corpus: Column) -> Column:
    """Whether a word of up to six letters that the corpus lacks is likely a piece of one."""
    return (F.length(_col(word)) <= 6) & ~in_corpus


def statements(evidence: Column | str) -> Column:
    """array<string> of the ;-separated statements, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(_col(evidence), F.lit("")), ";"), lambda s: F.btrim(s, F.lit(BLANK))), lambda s: s != "")


def statement_list(evidence: Column | str) -> Column:
    """The same for an array of strings."""
    return F.flatten(F.transform(F.coalesce(_col(evidence), F.expr("cast(array() as array<string>)")), statements))


def chapters(text: Column | str, last: int = 61, last_cjk: int = 120) -> Column:
    """Sorted distinct chapter numbers that a text cites, as digits, English words or CJK numerals."""
    t = _col(text)
    table = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    cited = F.regexp_extract_all(F.lower(t), F.lit(rf"\b(?:chapter|chap\.?|ch\.?)\s+(\d{{1,3}}|{'|'.join(NUMBER_WORDS)})\b"), F.lit(1))
    plain = F.filter(F.transform(cited, lambda x: F.coalesce(x.try_cast("int"), F.try_element_at(table, x))), lambda n: (n >= 1) & (n <= last))
    digits = F.create_map(*[F.lit(x) for kv in CJK_DIGITS.items() for x in kv])

    def cjk(x: Column) -> Column:
        tens, ones = F.substring_index(x, "十", 1), F.substring_index(x, "十", -1)
        ten = F.when(tens == "", F.lit(1)).otherwise(F.coalesce(F.try_element_at(digits, tens), F.lit(1)))
        one = F.when(ones == "", F.lit(0)).otherwise(F.coalesce(F.try_element_at(digits, ones), F.lit(0)))
        return F.coalesce(x.try_cast("int"), F.when(F.instr(x, "十") > 0, ten * 10 + one).otherwise(F.coalesce(F.try_element_at(digits, x), F.lit(0))))

    other = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"第([一二三四五六七八九十百\d]{1,4})[章回节卷]"), F.lit(1)), cjk), lambda n: (n >= 1) & (n <= last_cjk))
    return F.array_sort(F.array_distinct(F.concat(plain, other)))


def themes(text: Column | str, keywords: dict[str, list[str]]) -> Column:
    """Sorted names of the themes any of whose keywords stands in the text."""
    t = F.lower(_col(text))
    hits = [F.when(t.rlike("|".join(quoted(k) for k in ks)), F.lit(name)) for name, ks in sorted(keywords.items())]
    return F.array_compact(F.array(*hits))


def quoted(text: str) -> str:
    """text as a regular expression of itself."""
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in text)


def names_in(text: Column | str, names: list[str]) -> Column:
    """Sorted names that stand in the text as they are."""
    t = _col(text)
    return F.array_compact(F.array(*[F.when(F.contains(t, F.lit(n)), F.lit(n)) for n in sorted(names)]))


def prefix_of(words_: Column | str, n: int, lead: str = "") -> Column:
    """The first n words, comma-joined, after a lead."""
    return F.concat(F.lit(lead), F.array_join(F.slice(_col(words_), 1, n), ", "))


def surface(word: Column | str, text: Column | str) -> Column:
    """The first occurrence of a lower-case word in a text, cased as it is there; the word itself if there is none."""
    w, t = _col(word), _col(text)
    at = F.position(w, F.lower(t))
    return F.when(at > 0, t.substr(at, F.length(w))).otherwise(w)


def is_caps(word: Column | str) -> Column:
    w = _col(word)
    return (F.length(w) >= 2) & (w == F.upper(w)) & (w != F.lower(w))


def strip_possessive(word: Column | str) -> Column:
    w = _col(word)
    bare = F.regexp_replace(F.regexp_replace(w, "['’][sS]$", ""), "['’]+$", "")
    return F.when(bare == "", w).otherwise(bare)


def label_weights(reply: Column | str) -> Column:
    """map<string,double> of a model's JSON reply, fenced or not: values from 0 to 1; keys trimmed and lower-cased."""
    body = F.regexp_extract(_col(reply), r"(?s)(\{.*\})", 1)
    got = F.from_json(body, "map<string,double>")
    kept = F.map_filter(got, lambda k, v: v.isNotNull() & (v >= 0) & (v <= 1))
    return F.coalesce(kept, F.expr("cast(map() as map<string,double>)"))
