"""Column expressions: amounts, masks, texts and tokens. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magnitude bands in crores (10 million) and their labels.
CRORE = 10_000_000.0
BANDS = ((1.0, "under ₹1 Cr"), (5.0, "₹1–5 Cr"), (25.0, "₹5–25 Cr"), (100.0, "₹25–100 Cr"))
OVER = "over ₹100 Cr"
# Fixed value: an amount in prose is a grouped figure or five digits and more.
MONEY = r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b|\b\d{5,}(?:\.\d+)?\b"

# Fixed values of the tokeniser: words left out, and endings in the order in which they are tried.
STOP_WORDS = (
    "the a an and or of to in on for with is are was were be been it its this that "
    "they them their we our you your i at by from as has have had not no but if"
).split()
SUFFIXES = ("iness", "ingly", "edly", "ings", "ies", "ing", "ers", "est", "ed", "es", "er", "s")


def band(amount: Column) -> Column:
    """A magnitude band in place of an amount, with a minus sign for negative ones."""
    size = F.abs(amount) / CRORE
    label = F.lit(OVER)
    for edge, name in reversed(BANDS):
        label = F.when(size < edge, F.lit(name)).otherwise(label)
    return F.when(amount.isNotNull(), F.concat(F.when(amount < 0, F.lit("−")).otherwise(F.lit("")), label))


#: Fixed point of exact_sum(): 16 digits before the point, 12 behind it.
FIXED = "decimal(28,12)"


def exact_sum(value: Column) -> Column:
    """sum() of doubles that doesn't hang on the order of rows, so equal rows have equal sums and opposite ones none.

    Values are added up in fixed point; what that leaves of them (further digits, too large or not finite) is added as
    doubles.
    """
    value = value.cast("double")
    fixed = F.coalesce(value.try_cast(FIXED), F.lit(0).cast(FIXED))
    return F.sum(fixed).cast("double") + F.sum(value - fixed.cast("double"))


def alias(account_id: Column) -> Column:
    """One stable name for an account, whatever it is called where it stands."""
    return F.concat(F.lit("Account "), F.substring(F.sha2(account_id.cast("string").cast("binary"), 256), 1, 4))


def scrubbed(text: Column, names: list[str], name_marker: str = "[restricted]", money_marker: str = "[amount restricted]") -> Column:
    """Prose without restricted names, in any case, longest first, and without amounts: one pass each."""
    if names:
        quoted = ("".join(c if c.isalnum() else ("\\" + c if c.isascii() else c) for c in n) for n in sorted(names, key=lambda n: (-len(n), n)))
        text = F.regexp_replace(text, F.lit(f"(?i)(?:{'|'.join(quoted)})"), F.lit(name_marker))
    return F.regexp_replace(text, F.lit(MONEY), F.lit(money_marker))


def one_spaced(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\s+", " ")


def quotes(text: Column, quote: Column) -> Column:
    """Whether the text has the quote, whatever the white space in either."""
    return (F.length(one_spaced(quote)) > 0) & (F.instr(one_spaced(text), one_spaced(quote)) > 0)


def stem(token: Column) -> Column:
    """Without the first ending that fits and leaves three letters; 'ies' becomes 'y', and a doubled last consonant one."""
    out = token
    for suffix in reversed(SUFFIXES):
        base = F.substring(token, F.lit(1), F.length(token) - len(suffix))
        if suffix == "ies":
            base = F.concat(base, F.lit("y"))
        else:
            last, before = F.substring(base, -1, 1), F.substring(base, -2, 1)
            doubled = (F.length(base) > 2) & (last == before) & ~last.isin("l", "s", "z")
            base = F.when(doubled, F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)
        out = F.when((F.length(token) > len(suffix) + 2) & token.endswith(suffix), base).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Lower-case stems of a text's words without stop words, as an array."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9']+)"), 1)
    return F.transform(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), stem)


def minutes_crossed(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MINUTE", F.date_trunc("MINUTE", start), F.date_trunc("MINUTE", end))


def _formatted(value: Column, pattern: str) -> Column:
    return F.call_function("format_number", value, F.lit(pattern))


def crore(amount: Column) -> Column:
    return F.concat(F.when(amount < 0, F.lit("−")).otherwise(F.lit("")), F.lit("₹"), _formatted(F.abs(amount) / CRORE, "0.0"), F.lit(" Cr"))


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(F.when(value < 0, F.lit("−")).otherwise(F.lit("")), _formatted(F.abs(value) * 100, "0." + "0" * digits if digits else "0"), F.lit("%"))
