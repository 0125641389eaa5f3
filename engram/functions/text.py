"""Tokens, stems, scripts and strings as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Scripts without spaces between words, by Unicode range: Han, Kana, Hangul, Thai, Lao, Myanmar, Khmer.
CJK = r"㐀-䶿一-鿿豈-﫿぀-ヿ가-힯฀-໿က-႟ក-៿"
NON_WORD = r"[^\p{L}\p{M}\p{N}_\s ]"
WHITE = r"[\s ]+"

#: Common English function words, the default stop list; every function that uses it takes another.
STOP_WORDS: dict[str, tuple[str, ...]] = {
    "en": tuple(
        "a about after all also an and any are as at be because been before but by can could did do does for from had has have he her here him his how i if in into is it its just me more most my no "
        "not now of on one only or other our out over said she should so some such than that the their them then there these they this those through to too up us very was we were what when where "
        "which who why will with would you your".split()
    ),
    "ja": ("の", "に", "は", "を", "が", "と", "で", "も", "から", "まで", "です", "ます", "する", "ある", "いる", "こと", "これ", "それ"),
    "ko": ("이", "그", "저", "것", "수", "등", "및", "에서", "으로", "하다", "있다"),
    "zh": ("的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "也", "很", "到", "说", "說", "要", "去", "你", "会", "會", "着", "没有", "沒有", "自己", "这", "這"),
}
#: Locales whose stop words a tokenizer mode uses.
MODE_LOCALES = {"en": ("en",), "intl": ("en", "ja", "ko", "zh"), "jieba": ("en", "zh"), "jieba_tw": ("en", "zh"), "tiny_segmenter": ("en", "ja"), "korean": ("en", "ko")}


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def stop_words(mode: str = "en", extra: Sequence[str] = ()) -> list[str]:
    """Stop words of a mode; an unknown mode is English."""
    return sorted({w for loc in MODE_LOCALES.get(mode, ("en",)) for w in STOP_WORDS[loc]} | {w.lower() for w in extra})


# Fixed values of the simplified Porter rules: suffix and what replaces it, in order of trial.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))


def _cut(s: Column, n: int) -> Column:
    return F.substring(s, F.lit(1), F.length(s) - n)


def _swap(s: Column, rules, keep: Column | None) -> Column:
    """The first rule whose suffix ends s and leaves more than two letters; with keep, whether a final e was made."""
    out = None
    for suffix, new in rules:
        test = s.endswith(suffix) & (F.length(s) > len(suffix) + 2)
        value = F.concat(_cut(s, len(suffix)), F.lit(new))
        if keep is not None:
            value = F.struct(value.alias("s"), (keep | F.lit(new.endswith("e"))).alias("e"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(s if keep is None else F.struct(s.alias("s"), keep.alias("e")))


def stem(word: Column) -> Column:
    """Simplified Porter stem: plurals, -eed/-ed/-ing, two tables of suffixes, final e.

    Words of up to two letters and Han words stay as they are; null stays null. A column chain, so it runs in the JVM; apply it to
    distinct terms where a corpus repeats them.
    """
    vowel = lambda s: s.rlike("[aeiou]")

    def plural(s: Column) -> Column:
        return F.when(s.endswith("sses") | s.endswith("ies"), _cut(s, 2)).when(s.endswith("ss"), s).when(s.endswith("s"), _cut(s, 1)).otherwise(s)

    def mend(base: Column) -> Column:
        add = base.rlike("(at|bl|iz)$")
        fixed = F.when(add, F.concat(base, F.lit("e"))).when(base.rlike(r"([^aeiouslz])\1$"), _cut(base, 1)).otherwise(base)
        return F.struct(fixed.alias("s"), add.alias("e"))

    def past(s: Column) -> Column:
        same = F.struct(s.alias("s"), F.lit(False).alias("e"))
        eed = F.when(F.length(s) > 3, F.struct(F.concat(_cut(s, 3), F.lit("ee")).alias("s"), F.lit(True).alias("e"))).otherwise(same)
        ed = F.when(vowel(_cut(s, 2)), bind(_cut(s, 2), mend)).otherwise(same)
        ing = F.when(vowel(_cut(s, 3)), bind(_cut(s, 3), mend)).otherwise(same)
        return F.when(s.endswith("eed"), eed).when(s.endswith("ed"), ed).when(s.endswith("ing"), ing).otherwise(same)

    def final_e(x: Column) -> Column:
        base = _cut(x["s"], 1)
        runs = F.size(F.regexp_extract_all(base, F.lit("[aeiou]+[^aeiou]+"), F.lit(0)))
        drop = (runs > 1) | ((runs == 1) & ~base.rlike("[^aeiou][aeiou][^aeiouxwy]$"))
        return F.when(x["s"].endswith("e") & (F.length(x["s"]) > 3) & ~x["e"] & drop, base).otherwise(x["s"])

    done = bind(bind(F.lower(word), plural), past)
    done = bind(done, lambda x: _swap(x["s"], STEP_2, x["e"]))
    done = bind(done, lambda x: F.struct(_swap(x["s"], STEP_3, None).alias("s"), x["e"].alias("e")))
    return F.when((F.length(word) <= 2) | word.rlike(r"[一-鿿㐀-䶿豈-﫿]"), word).otherwise(bind(done, final_e))


_HAN, _DOUBLED = re.compile(r"[一-鿿㐀-䶿豈-﫿]"), re.compile(r"([^aeiouslz])\1$")
_VOWEL, _RUN, _SHORT = re.compile("[aeiou]"), re.compile("[aeiou]+[^aeiou]+"), re.compile("[^aeiou][aeiou][^aeiouxwy]$")


@lru_cache(1 << 17)
def stem_word(word: str) -> str:
    """stem() of one word."""
    if len(word) <= 2 or _HAN.search(word):
        return word
    s, e = word.lower(), False
    if s.endswith(("sses", "ies")):
        s = s[:-2]
    elif s.endswith("s") and not s.endswith("ss"):
        s = s[:-1]
    if s.endswith("eed"):
        s, e = (s[:-3] + "ee", True) if len(s) > 3 else (s, e)
    elif s.endswith(("ed", "ing")):
        base = s[: -2 if s.endswith("ed") else -3]
        if _VOWEL.search(base):
            e = base.endswith(("at", "bl", "iz"))
            s = base + "e" if e else base[:-1] if _DOUBLED.search(base) else base
    for rules in (STEP_2, STEP_3):
        for suffix, new in rules:
            if s.endswith(suffix) and len(s) > len(suffix) + 2:
                s, e = s[: len(s) - len(suffix)] + new, e or (rules is STEP_2 and new.endswith("e"))
                break
    if s.endswith("e") and len(s) > 3 and not e:
        runs = len(_RUN.findall(s[:-1]))
        if runs > 1 or runs == 1 and not _SHORT.search(s[:-1]):
            return s[:-1]
    return s


def each_word(f: Callable[[str], object], kind) -> Callable[[Column], Column]:
    """f as a column function of words, called once for each distinct word of a batch; nulls stay."""

    @F.arrow_udf(kind)
    def run(words: pa.Array) -> pa.Array:
        d = words.dictionary_encode()
        return pa.array([f(w) for w in d.dictionary.to_pylist()], {"string": pa.string(), "bigint": pa.int64()}[kind.simpleString()]).take(d.indices)

    return run


#: stem() for columns of many words: in Python with a memory for words, some ten times as fast as the column chain.
stems = each_word(stem_word, StringType())


def cjk_tokens(text: Column) -> Column:
    """Two-letter pieces of each run without word spaces; a run of one letter is itself.

    The deterministic mode of segmentation: it needs no dictionary, and the same text always gives the same tokens.
    """
    spans = F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0))
    pieces = lambda s: F.when(F.length(s) < 2, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))
    return F.flatten(F.transform(spans, lambda s: F.when(F.length(s) < 2, F.array(s)).otherwise(pieces(s))))


def latin_tokens(text: Column, min_length: int = 2) -> Column:
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, f"[{CJK}]+", " ")), NON_WORD, " ")
    return F.filter(F.split(plain, WHITE), lambda t: F.length(t) >= max(1, min_length))


def tokenize(text: Column, stemmed: bool = True, remove_stop_words: bool = True, min_length: int = 2, dedupe: bool = True, mode: str = "en", extra_stop_words: Sequence[str] = ()) -> Column:
    """Tokens of a text: Latin words, then pieces of scripts without spaces; stop words out, stems, distinct if dedupe.

    Null and empty texts have none. Tokens of up to three letters and numbers aren't stemmed.
    """
    text = F.coalesce(text, F.lit(""))
    tokens = F.concat(latin_tokens(text, min_length), cjk_tokens(text))
    if remove_stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(stop_words(mode, extra_stop_words)))
    if stemmed:
        tokens = F.transform(tokens, lambda t: F.when((F.length(t) <= 3) | t.rlike(r"^\d+$"), t).otherwise(stem(t)))
    return F.array_distinct(tokens) if dedupe else tokens


def tokenize_simple(text: Column) -> Column:
    """Lower-case ASCII words with repetitions."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\w+"), F.lit(0))


def title_tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def script_of(text: Column) -> Column:
    """cjk, latin or mixed by the share of letters of scripts without word spaces: above 0.6, below 0.2, between."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    share = F.length(F.regexp_replace(text, f"[^{CJK}]", "")) / F.greatest(letters, F.lit(1))
    return F.when(share > 0.6, "cjk").when(share < 0.2, "latin").otherwise("mixed")


def language_hint(text: Column) -> Column:
    """ko, ja, zh or en by the first of Hangul, Kana, Han that the text has."""
    return F.when(text.rlike(r"[가-힯]"), "ko").when(text.rlike(r"[぀-ヿ]"), "ja").when(text.rlike(r"[一-鿿]"), "zh").otherwise("en")


# strings


def truncate(s: Column, most: int, ellipsis: str = "...", break_words: bool = False) -> Column:
    cut = F.substring(s, 1, max(0, most - len(ellipsis)))
    if not break_words:
        cut = bind(cut, lambda c: F.when(c.contains(" ") & ~c.rlike("^ [^ ]*$"), F.regexp_replace(c, " [^ ]*$", "")).otherwise(c))
    return F.when(F.length(s) <= most, s).otherwise(F.concat(cut, F.lit(ellipsis)))


def strip_html(s: Column, keep_spaces: bool = True) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), "<[^>]*>", " " if keep_spaces else ""), WHITE, " "))


def strip_markdown(s: Column) -> Column:
    rules = [(r"(?m)^#{1,6}\s+", ""), (r"(\*\*|__)(.*?)\1", "$2"), (r"(\*|_)(.*?)\1", "$2"), ("`([^`]+)`", "$1"), (r"```[\s\S]*?```", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"(?m)^(-{3,}|_{3,}|\*{3,})$", ""), (r"(?m)^>\s+", "")]
    out = F.coalesce(s, F.lit(""))
    for pattern, new in rules:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def edit_distance(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    return F.levenshtein(a, b) if case_sensitive else F.levenshtein(F.lower(a), F.lower(b))


def similarity(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - edit_distance(a, b, case_sensitive) / longer)


def camel_case(s: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(s, "^[^a-zA-Z0-9]+", ""), "[^a-zA-Z0-9]+"), lambda p: p != "")
    up = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(capitalize(p))), "")
    return F.concat(F.lower(F.substring(up, 1, 1)), F.substring(up, 2, 1 << 30))


def _separated(s: Column, mark: str) -> Column:
    out = F.regexp_replace(F.regexp_replace(s, "([A-Z])", f"{mark}$1"), "[^a-zA-Z0-9]+", mark)
    return F.lower(F.regexp_replace(out, f"^{mark}+|{mark}+$", ""))


def snake_case(s: Column) -> Column:
    return _separated(s, "_")


def kebab_case(s: Column) -> Column:
    return _separated(s, "-")


SMALL_WORDS = ("a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "by", "of", "in")


def title_case(s: Column, small: Sequence[str] = SMALL_WORDS) -> Column:
    keep = F.array(*map(F.lit, small))
    return F.array_join(F.transform(F.split(F.lower(s), r"\s+"), lambda w, i: F.when((i == 0) | ~F.array_contains(keep, w), capitalize(w)).otherwise(w)), " ")


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


_HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("/", "&#x2F;"))


def escape_html(s: Column) -> Column:
    out = F.coalesce(s, F.lit(""))
    for plain, entity in _HTML:
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def unescape_html(s: Column) -> Column:
    out = s
    for plain, entity in reversed(_HTML):  # the ampersand last, so no entity is made on the way
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def template(text: Column, values: Column, escape: bool = True) -> Column:
    """{key} replaced by values[key] of a map; unknown keys stay."""
    parts = F.regexp_extract_all(text, F.lit(r"\{([^}]+)\}"), F.lit(1))
    fill = lambda v: escape_html(v) if escape else v
    return F.aggregate(F.array_distinct(parts), text, lambda a, k: F.when(F.map_contains_key(values, k), F.replace(a, F.concat(F.lit("{"), k, F.lit("}")), fill(F.element_at(values, k)))).otherwise(a))


def word_count(s: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(s, F.lit("")), WHITE), lambda w: w != ""))


def char_count(s: Column, without_spaces: bool = False) -> Column:
    return F.length(F.regexp_replace(s, WHITE, "")) if without_spaces else F.length(s)


_ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_BARE = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def slugify(s: Column, separator: str = "-", lowercase: bool = True) -> Column:
    out = F.regexp_replace(F.translate(s, _ACCENTS, _BARE), r"[^a-zA-Z0-9\s-]", "")
    out = F.regexp_replace(F.regexp_replace(F.trim(out), r"\s+", separator), f"{separator}+", separator)
    return F.lower(out) if lowercase else out


def is_palindrome(s: Column) -> Column:
    clean = F.regexp_replace(F.lower(s), "[^a-z0-9]", "")
    return clean == F.reverse(clean)


def repeated(s: Column, n: int, separator: str = "") -> Column:
    return F.array_join(F.array_repeat(s, n), separator) if n > 0 else F.lit("")


def pad(s: Column, length: int, char: str = " ", side: str = "right") -> Column:
    if side == "left":
        out = F.lpad(s, length, char)
    elif side == "both":
        out = F.rpad(F.lpad(s, F.length(s) + F.floor((length - F.length(s)) / 2).cast("int"), F.lit(char)), F.lit(length), F.lit(char))
    else:
        out = F.rpad(s, length, char)
    return F.when(F.length(s) >= length, s).otherwise(out)


URL = r"https?://[^\s]+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b"


def extract_urls(s: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(URL), F.lit(0))


def extract_emails(s: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(EMAIL), F.lit(0))


def is_alphanumeric(s: Column) -> Column:
    return s.rlike("^[a-zA-Z0-9]+$")
