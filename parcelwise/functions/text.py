"""Text: labels, vertex codes, taxpayer numbers, provenance labels. Column functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelwise.functions.let import let

#: Latin letters and signs whose compatibility decomposition is one plain character besides marks; those of several characters.
_SINGLE, _SEVERAL = {}, {}
for _c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0xFB00, 0xFB07)]):
    _plain = "".join(x for x in unicodedata.normalize("NFKD", _c) if not unicodedata.combining(x))
    if _plain != _c:
        (_SINGLE if len(_plain) == 1 else _SEVERAL)[_c] = _plain
#: Weights of the check digits (first and second digit of each kind).
CPF_WEIGHTS = [[10, 9, 8, 7, 6, 5, 4, 3, 2], [11, 10, 9, 8, 7, 6, 5, 4, 3, 2]]
CNPJ_WEIGHTS = [[5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]]
#: The printed forms of both numbers.
CPF = "(?<!\\d)(\\d{3}\\.?\\d{3}\\.?\\d{3}-?\\d{2})(?!\\d)"
CNPJ = "(?<!\\d)(\\d{2}\\.?\\d{3}\\.?\\d{3}/?\\d{4}-?\\d{2})(?!\\d)"


def strip_accents(text: Column) -> Column:
    """Compatibility forms without their marks, composed or not, for Latin letters and signs (Spark has no normal forms)."""
    bare = F.translate(F.regexp_replace(text, "\\p{Mn}", ""), "".join(_SINGLE), "".join(_SINGLE.values()))
    several = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(bare, ""), lambda c: F.coalesce(several[c], c)), "")
    return F.when(text.rlike("[" + "".join(_SEVERAL) + "]"), spelled).otherwise(bare)


def normalize_label(text: Column) -> Column:
    """No accents, lower case, punctuation (the marks listed, no others) and white space as one space."""
    plain = F.regexp_replace(F.lower(strip_accents(text)), "[.\\-_/\\\\|()\\[\\]:;,]+", " ")
    return F.trim(F.regexp_replace(plain, "(?U)\\s+", " "))


def collapse_spaced_letters(text: Column) -> Column:
    """'A Z I M' as 'AZIM' where three or more tokens are all single letters."""
    parts = F.split(F.trim(text), "\\s+")
    return F.when((F.size(parts) >= 3) & F.forall(parts, lambda x: F.length(x) == 1), F.array_join(parts, "")).otherwise(text)


def clean_cell(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def normalize_code(code: Column) -> Column:
    """P-01, P 01 and P01 as P1; the prefix stays."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(code, F.lit(""))), "[^A-Z0-9]", ""), "^([A-Z]*)0*(\\d+)$", "$1$2")


def _check_digit(digits: Column, weights: list[int]) -> Column:
    total = sum((F.substring(digits, k + 1, 1).cast("int") * w for k, w in enumerate(weights)), F.lit(0))
    return let(total % 11, lambda rest: F.when(rest < 2, 0).otherwise(11 - rest))


def valid_tax_id(digits: Column) -> Column:
    """Whether both check digits of a CPF (11 digits) or CNPJ (14) hold; one digit repeated is none."""

    def holds(weights: list[list[int]]) -> Column:
        n = len(weights[0])
        return (F.substring(digits, n + 1, 1).cast("int") == _check_digit(digits, weights[0])) & (F.substring(digits, n + 2, 1).cast("int") == _check_digit(digits, weights[1]))

    varied = ~digits.rlike("^(\\d)\\1*$")
    return F.when(F.length(digits) == 11, varied & holds(CPF_WEIGHTS)).when(F.length(digits) == 14, varied & holds(CNPJ_WEIGHTS)).otherwise(F.lit(False))


def mask_tax_id(digits: Column) -> Column:
    cpf = F.regexp_replace(digits, "^(\\d{3})(\\d{3})(\\d{3})(\\d{2})$", "$1.$2.$3-$4")
    cnpj = F.regexp_replace(digits, "^(\\d{2})(\\d{3})(\\d{3})(\\d{4})(\\d{2})$", "$1.$2.$3/$4-$5")
    return F.when(F.length(digits) == 11, cpf).when(F.length(digits) == 14, cnpj).otherwise(digits)


def tax_ids(text: Column) -> Column:
    """array<struct<digits, valid, confidence>> of the CNPJs and CPFs in text, each once; a CPF within a found CNPJ is none."""
    found = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, "\\D", ""))
    cnpjs = F.array_distinct(found(CNPJ))
    cpfs = F.filter(F.array_distinct(found(CPF)), lambda c: ~F.exists(cnpjs, lambda n: F.contains(n, c)))
    checked = F.transform(F.concat(cnpjs, cpfs), lambda d: F.struct(d.alias("digits"), valid_tax_id(d).alias("valid")))
    return F.transform(checked, lambda x: F.struct(x["digits"].alias("digits"), x["valid"].alias("valid"), F.when(x["valid"], 1.0).otherwise(0.55).alias("confidence")))


def provenance_label(page: Column, table: Column, row: Column, column: Column) -> Column:
    shown = lambda x: F.coalesce((x + 1).cast("string"), F.lit("?"))
    place = F.when(table.isNotNull(), F.concat(F.lit("tabela "), shown(table), F.lit(", linha "), shown(row), F.lit(", col. "), shown(column)))
    return F.concat_ws(" · ", F.concat(F.lit("p. "), F.coalesce(page.cast("string"), F.lit("?"))), place)


def value_text(value: Column) -> Column:
    """Six decimals at most, without trailing zeros; null stays null, and what rounds to zero from below keeps its sign, as printed."""
    return F.when(value.isNotNull(), F.regexp_replace(F.format_string("%.6f", value), "\\.?0+$", ""))
