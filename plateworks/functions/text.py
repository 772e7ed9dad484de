"""Plate text as column expressions: folding, repair, grammar."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Canonical letters with their other spellings, dashes, look-alike digits.
LETTER_SPELLINGS = {
    "أ": "اإآٱٲٳﺍﺃٵ",
    "ب": "ٮپﺏﺑﺒﺐ",
    "د": "ذډڊﺩﺪ",
    "ه": "ةھہﻩﻪﻫﻬۀ",
    "و": "ؤۇۈۋﻭﻮ",
    "ط": "ظﻁﻄﻃﻂ",
}
DASHES = "–—−‒―ـ_/\\.·•"
LOOKALIKES = ("OQDIL|!ZEASGTBP", "000111123456789")

LETTERS = "".join(LETTER_SPELLINGS)
ARABIC_DIGITS = "".join(chr(0x660 + d) for d in range(10))
_FOLDS = [(c, to) for to, others in LETTER_SPELLINGS.items() for c in others]
_FOLDS += [(chr(zero + d), str(d)) for zero in (0x660, 0x6F0) for d in range(10)] + [(c, "-") for c in DASHES]
FOLD_FROM, FOLD_TO = ("".join(side) for side in zip(*_FOLDS, strict=True))
#: Texts of these characters alone come out the same with and without compatibility decomposition.
_GUARDED = "".join(sorted((set(FOLD_FROM) | set(LETTERS)) - {"ۀ", "ٵ", "\\", "-"}))
#: Those among them that are dropped: control characters, and marks that combine.
DROPPED = "\\x00-\\x1f\u200e\u200f\u064b-\u065f\u0670"
GUARD = "^[\\x20-\\x7e" + DROPPED + _GUARDED + "]*$"
#: Texts that are their own canonical form: digits, capitals and plate letters, parted by single blanks or dashes.
CANONICAL = f"^[0-9A-Z{LETTERS}]++(?:[ -][0-9A-Z{LETTERS}]++)*+\\z"

#: Sizes of a plate's number and region, of a temporary plate's number, and what ends that.
NUMBER_SIZE, REGION_SIZE, TEMPORARY_SIZE, TEMPORARY_END = (1, 5), (1, 2), (5, 6), "WW"


def fold(text: Column) -> Column:
    """Canonical form of text that is guarded, or decomposed and stripped."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{DROPPED}]", "")
    upper = F.upper(F.translate(bare, FOLD_FROM, FOLD_TO))
    return F.btrim(F.regexp_replace(F.regexp_replace(upper, r"\p{Z}+", " "), "-{2,}", "-"), F.lit(" -"))


def stripped(text: str) -> str:
    """Text in compatibility decomposition, without control characters and marks that combine.

    A mark combines if it has a combining class; enclosing and spacing marks and
    variation selectors have none, and stay.
    """
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c)[0] != "C")


@F.pandas_udf(StringType())
def _decompose(text: pd.Series) -> pd.Series:
    return text.map(stripped, na_action="ignore") if text.notna().any() else text


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once for a row, whatever is filtered or built on them later.

    A generator over one struct keeps the optimiser from copying their
    expressions into the steps above.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as :func:`once` does, in generated code, and with what they have in common computed once.

    What the optimiser takes to differ from row to row it neither copies into
    other steps nor filters ahead of; here that is a part which is never used.
    """
    never = F.when(F.spark_partition_id() < 0, F.lit(None))
    return df.withColumns({n: F.coalesce(c, never) for n, c in columns.items()})


def with_normal_text(df: DataFrame, source: str, target: str = "normal_text", key: str | None = None) -> DataFrame:
    """Add the canonical text; texts of usual characters alone reach Python as nulls, and canonical ones are not folded.

    Python's rows are dealt anew afterwards. Where ``df`` is dealt by ``key``
    already, and is cheap to make twice, only the other texts go to Python, and
    their decompositions come back to the tasks that their rows are in.
    """
    text = F.coalesce(F.col(source), F.lit(""))
    told = df.withColumn("_same", text.rlike(CANONICAL))
    if key:
        odd = df.select(key, source).where(~(text.rlike(CANONICAL) | text.rlike(GUARD))).distinct()
        told = told.join(odd.withColumn("_stripped", _decompose(F.col(source))).hint("shuffle_hash"), [key, source], "left")
        plain = told.withColumn("_plain", F.coalesce("_stripped", F.col(source))).drop("_stripped").select(*df.columns, "_same", "_plain")
    else:
        odd = F.when(~(F.col("_same") | text.rlike(GUARD)), F.col(source))
        plain = told.withColumn("_plain", F.coalesce(_decompose(odd), F.col(source)))
    return once(plain, **{target: F.when(F.col("_same"), F.col("_plain")).otherwise(fold(F.col("_plain")))}).drop("_plain", "_same")


def repair_digits(group: Column) -> Column:
    """Look-alikes to digits; null unless all digits then."""
    digits = F.translate(group, *LOOKALIKES)
    return F.when(digits.rlike(r"^\p{Nd}+$"), digits)


def _sized(part: Column, size: tuple[int, int]) -> Column:
    """Whether a part has that many characters, none of them a blank or dash."""
    return F.length(part).between(*size) & ~part.contains(" ") & ~part.contains("-")


def with_plate(df: DataFrame, text: str = "normal_text") -> DataFrame:
    """Add digits, letter, region, is_temporary and plate_text, all null where the text is no plate.

    Each plate letter is set between dashes, whatever blanks and dashes stood
    there, and the text is cut at dashes: a standard plate is three parts, of
    which the middle one is a letter. A text that has that form is no temporary
    plate, even if its numbers can't be repaired.
    """
    cut = F.split(F.regexp_replace(text, f"[ -]*([{LETTERS}])[ -]*", "-$1-"), "-")
    out = held(df, _cut=cut, _tight=F.translate(text, " ", ""))
    first, middle, last = (F.get("_cut", k) for k in range(3))
    standard = (F.size("_cut") == 3) & middle.isin(*LETTERS) & _sized(first, NUMBER_SIZE) & _sized(last, REGION_SIZE)
    dash = F.col("_tight").endswith(f"-{TEMPORARY_END}").cast("int")
    head = F.substring("_tight", F.lit(1), F.length("_tight") - len(TEMPORARY_END) - dash)
    temporary = F.col("_tight").endswith(TEMPORARY_END) & _sized(head, TEMPORARY_SIZE)
    number = F.when(standard, first).when(temporary, head)
    out = held(out, _standard=standard, _number=repair_digits(number), _region=repair_digits(F.when(standard, last)), _letter=middle)
    whole = F.col("_standard") & F.col("_number").isNotNull() & F.col("_region").isNotNull()
    found = whole | (~F.col("_standard") & F.col("_number").isNotNull())
    plate = F.when(whole, F.concat_ws("-", "_number", "_letter", "_region")).when(found, F.concat("_number", F.lit(f" {TEMPORARY_END}")))
    out = held(out, digits=F.when(found, F.col("_number")), letter=F.when(whole, F.col("_letter")), region=F.when(whole, F.col("_region")), is_temporary=F.when(found, ~whole), plate_text=plate)
    return out.drop("_cut", "_tight", "_standard", "_number", "_region", "_letter")


def reject_reason(text: Column, plate_text: Column) -> Column:
    """Why a canonical text is no plate; null for plates."""
    reason = F.when(text == "", "empty").when(~text.rlike(rf"[{LETTERS}]|WW"), "no letter").when(~text.rlike(r"[0-9]"), "no digits").otherwise("grammar")
    return F.when(plate_text.isNull(), reason)


def stem(path: Column) -> Column:
    """File name without folders and without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
