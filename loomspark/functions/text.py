"""Text expressions. Character classes are spelt out, so that they mean the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode-aware string functions strip it; combining marks; the elongation sign.
WS = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
MARKS = r"[\x{064B}-\x{0652}]"
MARKS_WIDE = r"[\x{0617}-\x{061A}\x{064B}-\x{0652}]"
ARABIC = r"\x{0600}-\x{06FF}"
ELONGATION = "ـ"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c) -> Column:
    return F.regexp_replace(col(c), f"^{WS}+|{WS}+$", "")


def collapse_ws(c) -> Column:
    """Every run of white space becomes one space, ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), f"{WS}+", " "))


def not_blank(c) -> Column:
    """Any other character than white space; the first one ends the search."""
    return col(c).rlike("[^" + WS[1:])


def strip_marks(c, wide: bool = False) -> Column:
    return F.regexp_replace(col(c), MARKS_WIDE if wide else MARKS, "")


def clean_light(c) -> Column:
    """Elongation signs go, runs of spaces (not tabs or newlines) become one, ends are trimmed."""
    return trim_ws(F.regexp_replace(F.replace(col(c), F.lit(ELONGATION), F.lit("")), " {2,}", " "))


def clean_hard(c) -> Column:
    """All white space becomes single spaces first; elongation signs go last, so spaces around a lone one stay."""
    return F.replace(collapse_ws(c), F.lit(ELONGATION), F.lit(""))


def clean_text(c) -> Column:
    """Collapsed white space; null becomes empty."""
    return F.coalesce(collapse_ws(c), F.lit(""))


def words(c) -> Column:
    """Words between white space; none for blank text."""
    # one range rules most characters out, where the class is many ranges
    return F.filter(F.split(col(c), f"(?![!-~]){WS}+"), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(words(c))


def token_signature(c) -> Column:
    """Lower-cased words, sorted and joined: equal for texts with the same words in any order."""
    return F.array_join(F.sort_array(words(F.lower(col(c)))), " ")


def bucket(c, digits: int = 6, method: str = "md5") -> Column:
    """The first hex digits of a hash."""
    c = col(c)
    hashed = {"md5": lambda: F.md5(c), "sha1": lambda: F.sha1(c), "sha256": lambda: F.sha2(c, 256)}[method]()
    return F.substring(hashed, 1, digits)


def only_script(c, letters: str = ARABIC) -> Column:
    """Only letters of the script and white space stay; others go without a trace."""
    return F.regexp_replace(col(c), f"[^{letters}{WS[1:-1]}]", "")


def has_script(c, letters: str = ARABIC) -> Column:
    return F.coalesce(col(c).rlike(f"[{letters}]"), F.lit(False))


def strip_numbering(c) -> Column:
    return F.regexp_replace(col(c), rf"^{WS}*[0-9]+\.{WS}*", "")


def strip_bullets(c) -> Column:
    return F.regexp_replace(col(c), "^[-• ]+|[-• ]+$", "")


def before_dash(c) -> Column:
    """What stands before the first dash."""
    return trim_ws(F.split(col(c), "-")[0])


def safe_name(c) -> Column:
    return F.regexp_replace(col(c), "[ ,/]", "_")


def token_estimate(*texts) -> Column:
    """A quarter of the characters, rounded down."""
    total = sum((F.coalesce(F.length(col(t)), F.lit(0)) for t in texts), F.lit(0))
    return F.floor(total / 4)


def thousands(c) -> Column:
    return F.format_number(col(c), 0)


def display_name(c) -> Column:
    """A template's key as a reader would have it: inputs, an arrow, outputs; names with spaces and capitals."""
    side = lambda x: F.array_join(F.transform(F.split(x, "__"), lambda w: F.initcap(F.replace(w, F.lit("_"), F.lit(" ")))), ", ")
    parts = F.split(col(c), "___")
    return F.array_join(F.transform(parts, side), " → ")


def escape_latex(c) -> Column:
    return F.regexp_replace(col(c), r"([&%$#_{}])", r"\\$1")


def model_name(c) -> Column:
    """A short name of a checkpoint path: the model's folder, shortened, and the training mode below it.

    Falls back to the last part of the path.
    """
    # Model families, sizes and modes that occur in paths.
    found = F.regexp_extract(col(c), r"(?:^|/)([^/]*(?:ALLaM|Qwen|Llama|jais|JAIS)[^/]*)", 1)
    mode = F.regexp_extract(col(c), r"(?:^|/)[^/]*(?:ALLaM|Qwen|Llama|jais|JAIS)[^/]*/(curriculum|random|mixed)(?:/|$)", 1)
    last = F.regexp_extract(col(c), r"([^/]+)/*$", 1)
    name = F.lower(F.when(found != "", found).otherwise(last))
    for part in ("-instruct-preview", "-instruct", "-7b", "-8b"):
        name = F.replace(name, F.lit(part), F.lit(""))
    return F.when((found != "") & (mode != ""), F.concat(name, F.lit("-"), mode)).otherwise(name)
