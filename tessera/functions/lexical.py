"""Lexical attributes of token texts: expressions for Catalyst, and exact Python forms for kernels.

The expressions (`*_col`) agree with the Python forms on text whose characters Java, RE2 and Python classify alike, such as
Latin letters; the kernels are exact for all text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import string_id

FLAGS = (
    "is_alpha", "is_ascii", "is_digit", "is_lower", "is_upper", "is_title", "is_punct", "is_space", "is_bracket", "is_quote", "is_left_punct", "is_right_punct", "is_currency",
    "is_stop", "like_num", "like_url", "like_email",
)
#: Members of the bracket and quote classes; fixed values.
BRACKETS = ("(", ")", "[", "]", "{", "}", "<", ">")
QUOTES = ('"', "'", "`", "«", "»", "‘", "’", "‚", "‛", "“", "”", "„", "‟", "‹", "›", "❮", "❯", "''", "``")
LEFT_PUNCT = ("(", "[", "{", "<", '"', "'", "«", "‘", "‚", "‛", "“", "„", "‟", "‹", "❮", "``")
RIGHT_PUNCT = (")", "]", "}", ">", '"', "'", "»", "’", "”", "›", "❯", "''")
#: English number words; fixed values.
NUMBER_WORDS = tuple(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety"
    " hundred thousand million billion trillion quadrillion gajillion bazillion first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth"
    " fifteenth sixteenth seventeenth eighteenth nineteenth twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth hundredth thousandth millionth billionth trillionth".split()
)
#: A small stop list for queries and tests; real ones are a parameter.
STOP_WORDS = tuple("a an and are as at be by for from has he in is it its of on or that the this to was were which with you".split())
TLDS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk")
EMAIL_START = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


@dataclass(frozen=True)
class Lexicon:
    """The tables that lexical attributes depend on."""

    stop_words: frozenset[str] = frozenset(STOP_WORDS)
    tlds: frozenset[str] = frozenset(TLDS)
    number_words: frozenset[str] = frozenset(NUMBER_WORDS)
    norms: Mapping[str, str] = field(default_factory=dict)
    symbols: Mapping[str, int] = field(default_factory=dict)
    vector_keys: frozenset[str] = frozenset()
    url: str = r"^(?:https?://)?(?:[\w-]+\.)+[A-Za-z]{2,63}(?::\d+)?(?:[/?#]\S*)?$"


def _every(test: Callable[[str], bool]) -> Callable[[str], bool]:
    return lambda s: bool(s) and all(map(test, s))


def shape(text: str) -> str:
    """X, x and d for upper-case, other letters and digits, runs of one class held at four; LONG from 100 characters."""
    if len(text) >= 100:
        return "LONG"
    out: list[str] = []
    for c in text:
        k = ("X" if c.isupper() else "x") if c.isalpha() else "d" if c.isdigit() else c
        if out[-4:] != [k] * 4:
            out.append(k)
    return "".join(out)


def is_space_char(c: str) -> bool:
    return c.isspace()


def like_num(text: str, words: Iterable[str] = NUMBER_WORDS) -> bool:
    text = text[1:] if text[:1] in ("+", "-", "±", "~") and text else text
    text = text.replace(",", "").replace(".", "")
    if text.isdigit():
        return True
    over, slash, under = text.partition("/")
    if slash and over.isdigit() and under.isdigit():
        return True
    low = text.lower()
    return low in words or low[-2:] in ("st", "nd", "rd", "th") and low[:-2].isdigit()


def like_url(text: str, lexicon: Lexicon) -> bool:
    low = text.lower()
    if low.startswith(("http://", "https://")) or low.startswith("www.") and len(text) > 4:
        return True
    if text[:1] in (".", "@") or text[-1:] in (".", "@") or "@" in text:
        return False
    host = re.split(r"[/?#:]", text, maxsplit=1)[0]
    return "." in host and host.rpartition(".")[2].lower() in lexicon.tlds and re.match(lexicon.url, text) is not None


def flags(text: str, lexicon: Lexicon) -> dict[str, bool]:
    return {
        "is_alpha": text.isalpha(), "is_ascii": bool(text) and text.isascii(), "is_digit": text.isdigit(), "is_lower": text.islower(), "is_upper": text.isupper(), "is_title": text.istitle(),
        "is_punct": _every(lambda c: unicodedata.category(c)[0] == "P")(text), "is_space": text.isspace(), "is_bracket": text in BRACKETS, "is_quote": text in QUOTES,
        "is_left_punct": text in LEFT_PUNCT, "is_right_punct": text in RIGHT_PUNCT, "is_currency": _every(lambda c: unicodedata.category(c) == "Sc")(text),
        "is_stop": text.lower() in lexicon.stop_words, "like_num": like_num(text, lexicon.number_words), "like_url": like_url(text, lexicon), "like_email": re.match(EMAIL_START, text) is not None,
    }


def norm(text: str, lexicon: Lexicon) -> str:
    return lexicon.norms.get(text) or text.lower()


def lexeme(text: str, lexicon: Lexicon) -> dict:
    """The lexical record of a string."""
    orth = string_id(text, lexicon.symbols)
    return {
        "text": text, "orth": orth - (1 << 64) if orth >= 1 << 63 else orth, "lower": text.lower(), "norm": norm(text, lexicon), "shape": shape(text), "prefix": text[:1], "suffix": text[-3:], "length": len(text),
        "has_vector": text in lexicon.vector_keys, **flags(text, lexicon),
    }


LEXEME_DDL = "text string, orth bigint, lower string, norm string, shape string, prefix string, suffix string, length int, has_vector boolean, " + ", ".join(f"{f} boolean" for f in FLAGS)


def lexemes(texts: DataFrame, column: str = "text", lexicon: Lexicon = Lexicon()) -> DataFrame:  # noqa: B008
    """The lexical records of the distinct strings of a column, exact for all text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            t = pa.Table.from_pylist([lexeme(x, lexicon) for x in batch.column(0).to_pylist()] or [lexeme("", lexicon)])
            schema = schema or t.schema.set(t.schema.get_field_index("length"), pa.field("length", pa.int32()))
            yield from t.slice(0, batch.num_rows).cast(schema).to_batches()

    return texts.select(F.col(column).alias("text")).where("text is not null").distinct().mapInArrow(kernel, LEXEME_DDL)


# ---- expressions ---------------------------------------------------------------------------------------------------

#: Words of a capital and small letters, apart from each other by characters without case. The ordinal signs count as small.
TITLE = r"[^\p{Lu}\p{Lt}\p{Ll}ªº]*(?:[\p{Lu}\p{Lt}][\p{Ll}ªº]*(?:[^\p{Lu}\p{Lt}\p{Ll}ªº]+|\z))+"
SPACE_CLASS = r"[\s\x1c-\x1f\x85\xa0]"


def shape_col(t: F.Column) -> F.Column:
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\p{Lu}", "X"), r"[\p{L}&&[^X]]", "x"), r"\p{Nd}", "d")
    return F.when(F.length(t) >= 100, F.lit("LONG")).otherwise(F.regexp_replace(s, r"(.)\1{4,}", "$1$1$1$1"))


def like_num_col(t: F.Column, words: Iterable[str] = NUMBER_WORDS) -> F.Column:
    bare = F.translate(F.regexp_replace(t, r"^[+\-±~]", ""), ",.", "")
    return bare.rlike(r"^[0-9]+$") | bare.rlike(r"^[0-9]+/[0-9]+$") | F.lower(bare).isin(*words) | F.lower(bare).rlike(r"^[0-9]+(st|nd|rd|th)$")


def flag_col(name: str, t: F.Column, lexicon: Lexicon = Lexicon()) -> F.Column:  # noqa: B008
    """One of FLAGS as an expression over a text column."""
    forms: dict[str, Callable[[], F.Column]] = {
        "is_alpha": lambda: t.rlike(r"^\p{L}+$"), "is_ascii": lambda: t.rlike(r"^[\x00-\x7F]+$"), "is_digit": lambda: t.rlike(r"^\p{Nd}+$"),
        "is_lower": lambda: t.rlike(r"[\p{Ll}ªº]") & ~t.rlike(r"[\p{Lu}\p{Lt}]"), "is_upper": lambda: t.rlike(r"\p{Lu}") & ~t.rlike(r"[\p{Ll}\p{Lt}ªº]"), "is_title": lambda: t.rlike(rf"^(?:{TITLE})\z"),
        "is_punct": lambda: t.rlike(r"^\p{P}+$"), "is_space": lambda: t.rlike(f"^{SPACE_CLASS}+$"), "is_bracket": lambda: t.isin(*BRACKETS), "is_quote": lambda: t.isin(*QUOTES),
        "is_left_punct": lambda: t.isin(*LEFT_PUNCT), "is_right_punct": lambda: t.isin(*RIGHT_PUNCT), "is_currency": lambda: t.rlike(r"^\p{Sc}+$"),
        "is_stop": lambda: F.lower(t).isin(*sorted(lexicon.stop_words)), "like_num": lambda: like_num_col(t, lexicon.number_words), "like_email": lambda: t.rlike(EMAIL_START),
        "like_url": lambda: F.lower(t).rlike(r"^https?://") | (F.lower(t).startswith("www.") & (F.length(t) > 4))
        | (~t.rlike(r"^[.@]|[.@]$") & ~t.contains("@") & t.rlike(lexicon.url) & F.lower(F.regexp_extract(t, r"^(?:[\w-]+\.)+([A-Za-z]{2,63})", 1)).isin(*sorted(lexicon.tlds))),
    }
    return F.coalesce(forms[name](), F.lit(False))


def attribute_col(name: str, t: F.Column, lexicon: Lexicon = Lexicon()) -> F.Column:  # noqa: B008
    """A lexical attribute (a flag, lower, shape, prefix, suffix, length) as an expression."""
    simple = {"text": lambda: t, "lower": lambda: F.lower(t), "shape": lambda: shape_col(t), "prefix": lambda: F.left(t, F.lit(1)), "suffix": lambda: F.right(t, F.lit(3)), "length": lambda: F.length(t)}
    return simple[name]() if name in simple else flag_col(name, t, lexicon)
